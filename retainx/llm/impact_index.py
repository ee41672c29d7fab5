"""Exact top-k by inner product on an impact-ordered index, score at a time.

The index holds, for every shard of the vectors and every dimension, one posting
list: the shard's rows ordered by their quantised component, so that equal
quantised components are one contiguous segment. For a query a segment's impact
is the query's component times the segment's; a positive component reads a list
from its top, a negative one from its bottom.

A query takes the segments of all dimensions by descending impact, in steps of a
share of the postings, and adds each segment's impact to its rows' accumulators.
After a step with impacts down to t, a dimension in which a row was not met yet
can add no more than t (nor more than the largest impact of its list), and
quantisation no more than |query| times the norm of the row's rounding errors. A
row is still possible if its accumulator plus these bounds reaches the k-th
best exact score known so far. The shard stops when so few rows are possible that
to rescore them is cheaper than another step, or at the last segment; every
possible row is then rescored exactly. Nothing is left out without that proof.

Work: every query meets every shard, in blocks of bounded size on both sides, and
the best of the shards are merged. Equal vectors are held once for each of the
few smallest ids that an answer can need.

Defined cases: see ``intvectors`` for rows that take no part and for lengths;
repeated (id, vector) rows are one candidate; an id with several vectors is
several candidates and, if asked, several queries, none of which finds a row of
its own id; ties go to the smaller id; fewer candidates than k give all; an empty
table gives an empty result. Columns beside id and vector are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retainx.llm.intvectors import Scores, integer_vectors, smallest_ids, unpack
from retainx.llm.scratch import materialize, shuffle_partitions

#: The shard's own rows (ids and whole vectors) stand in the index as list -1.
ROWS = -1


@dataclass(frozen=True)
class ImpactParams:
    k: int = 5
    levels: int = 128                    # quantised values of a component, at most
    step: float = 1 / 8                 # share of the postings between two tests of the bounds
    few: float = 1 / 8                  # share of a shard's rows that is rescored rather than bounded further
    shard_rows: int = 16384
    block_queries: int = 4096
    scale: int = 256


def build_index(rows: DataFrame, dim: int, count: int, params: ImpactParams) -> DataFrame:
    """(shard, list, numbers, levels, step): posting lists of the packed ``rows`` (id, packed), stored once.

    A posting list holds the rows' numbers within the shard by descending level and
    the levels beside them; level l stands for components from l * step to
    (l + 1) * step - 1.
    """
    shards = max(1, -(-count // params.shard_rows))

    def postings(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        ids = table.column("id").to_numpy()
        x = unpack(table.column("packed").to_pylist(), dim)
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        span = int(x.max()) - int(x.min()) + 1
        step = max(1, -(-span // params.levels))
        numbers, levels = [ids.tobytes()], [x.tobytes()]
        for d in range(dim):
            level = x[:, d] // step
            down = np.argsort(-level, kind="stable").astype(np.int32)
            numbers.append(down.tobytes())
            levels.append(level[down].astype(np.int32).tobytes())
        lists = len(numbers)
        return pa.table({"shard": pa.array([shard] * lists, pa.int32()), "list": pa.array(range(ROWS, dim), pa.int32()),
                         "numbers": pa.array(numbers, pa.binary()), "levels": pa.array(levels, pa.binary()),
                         "step": pa.array([step] * lists, pa.int64())})

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("id", "packed"), F.lit(shards)).cast("int"))
    return materialize(dealt.groupBy("shard").applyInArrow(
        postings, "shard int, list int, numbers binary, levels binary, step long"), "impact-index")


class Shard:
    """One shard's posting lists in memory, and the search of one query in them."""

    def __init__(self, table: pa.Table, queries: np.ndarray, params: ImpactParams) -> None:
        lists = {n: (a, b) for n, a, b in zip(table.column("list").to_pylist(), table.column("numbers").to_pylist(),
                                              table.column("levels").to_pylist())}
        dim, step = len(lists) - 1, table.column("step")[0].as_py()
        own = lists[ROWS]
        self.params, self.ids = params, np.frombuffer(own[0], np.int64)
        x = np.frombuffer(own[1], np.int32).reshape(-1, dim)
        self.scores = Scores(x, queries)
        self.numbers = [np.frombuffer(lists[d][0], np.int32).astype(np.intp) for d in range(dim)]
        levels = [np.frombuffer(lists[d][1], np.int32) for d in range(dim)]
        low = min(int(lv[-1]) for lv in levels)
        # the middle of each level, the number of postings on it, and for each row the norm of its rounding errors
        self.middle = (np.arange(low, max(int(lv[0]) for lv in levels) + 1) * float(step)) + (step - 1) / 2
        self.held = np.stack([np.bincount(lv - low, minlength=len(self.middle)) for lv in levels])
        self.value = [self.middle[lv - low] for lv in levels]
        self.present = self.held > 0
        rounding = np.zeros(len(x))
        for d in range(dim):
            error = x[self.numbers[d], d] - self.value[d]
            rounding[self.numbers[d]] += error * error
        self.rounding = np.sqrt(rounding)

    def best(self, own_id: int, query: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
        """(ids, exact scores) of the k best rows that are not the query's own, postings read, rows rescored."""
        p, q = self.params, query.astype(np.float64)
        n = len(self.ids)
        allowed = self.ids != own_id
        impact = q[:, None] * self.middle[None, :]
        top = np.where(self.present, impact, -np.inf).max(axis=1)
        flat, held = impact.ravel(), self.held.ravel()
        by_impact = np.argsort(-flat, kind="stable")
        read = np.cumsum(held[by_impact])
        norm = float(np.sqrt((q * q).sum()))
        margin = norm * self.rounding + 1e-9 * norm * max(1.0, float(np.abs(self.middle).max()))
        # one accumulator a row, as a pair: the impacts that it got (real) and from how many lists (imaginary)
        sums, done = np.zeros(n, np.complex128), np.zeros(len(q), np.int64)
        least, share, first = -np.inf, 0.0, max(4 * p.k, 64)
        enough = max(4 * p.k, int(p.few * n))
        while True:
            share = min(1.0, share + p.step)
            t = flat[by_impact[min(len(read) - 1, int(np.searchsorted(read, share * read[-1])))]]
            ends = (self.held * (impact >= t)).sum(axis=1)
            for d in np.flatnonzero(ends > done):
                part = slice(done[d], ends[d]) if q[d] >= 0 else slice(n - ends[d], n - done[d])
                rows = self.numbers[d][part]
                sums[rows] += q[d] * self.value[d][part] + 1j
            done = ends
            above = sums.real + (np.minimum(t, top).sum() - t * sums.imag) + margin
            if first:                                                  # a lower bound on the k-th best score
                likely = np.argpartition(-above, min(first, n - 1))[:first]
                likely, first = likely[allowed[likely]], 0
                if len(likely) >= p.k:
                    least = float(np.partition(self.scores.of(query, likely), -p.k)[-p.k])
            possible = np.flatnonzero((above >= least) & allowed)
            if len(possible) <= enough or share >= 1.0:
                break
        exact = self.scores.of(query, possible)
        order = np.lexsort((self.ids[possible], -exact))[:p.k]
        return self.ids[possible][order], exact[order], int(done.sum()), len(possible)


def search(vectors: DataFrame, queries: Column, params: ImpactParams = ImpactParams(), id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best of every row for which ``queries`` holds.

    ``queries`` is a condition on the columns of ``vectors``.
    """
    spark = vectors.sparkSession
    rows, dim = integer_vectors(vectors, id_col, vector_col, F.coalesce(queries, F.lit(False)).alias("asked"), scale=params.scale)
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # a query's own id can be among the smallest of a vector: one more than k
    kept = materialize(smallest_ids(rows, params.k + 1), "impact-rows")
    asked = materialize(rows.where("asked").select("id", "packed").distinct(), "impact-queries")
    index = build_index(kept, dim, kept.count(), params)
    found = _cells(index, asked, dim, params)
    order = Window.partitionBy("query_id", "packed").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= params.k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _cells(index: DataFrame, asked: DataFrame, dim: int, params: ImpactParams) -> DataFrame:
    """Every block of queries against every shard: (query_id, packed, vec_id, score) of the k best of each."""
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    count = asked.count()
    # few shards: smaller blocks, so that every core has a cell
    wanted = -(-2 * shuffle_partitions(index.sparkSession) // shards)
    blocks = max(1, -(-count // params.block_queries), min(wanted, -(-count // 64)))

    def search_cell(key: tuple, lists: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "packed": [], "vec_id": [], "score": []}
        if lists.num_rows and queries.num_rows:
            packed = queries.column("packed").to_pylist()
            vectors = unpack(packed, dim)
            shard = Shard(lists, vectors, params)
            for own, bits, query in zip(queries.column("id").to_pylist(), packed, vectors):
                ids, scores, _, _ = shard.best(own, query)
                out["query_id"] += [own] * len(ids)
                out["packed"] += [bits] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += scores.tolist()
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "packed": pa.array(out["packed"], pa.binary()),
                         "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.int64())})

    lists = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("id", "packed"), F.lit(blocks)).cast("int")) \
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return lists.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block")) \
        .applyInArrow(search_cell, "query_id long, packed binary, vec_id long, score long")


def topk_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: the 5 best of every vector whose id is divisible by 50."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)
