"""Approximate nearest neighbours by largest inner product: a hash-prefix forest.

Each tree hashes a vector to a long string; its symbols are the axes (and their
signs) closest to the vector after random projections (cross-polytope hashing),
written in bits. A tree is the array of all vectors sorted by their string. A
query descends in every tree to the place of its own string, where the longest
common prefixes are, and then ascends in all trees at once: the common prefix that
a candidate must have gets shorter, bit by bit, until the trees together hold
enough candidates with it. That length is the query's own; in a dense place it is
long, in a sparse one short. Candidates are compared by their exact inner product
in double precision.

How many candidates are enough is measured, not fixed. A sample of the queries
(those with the smallest hash of their entry, ``sample`` of them) is answered by
blocked brute force over all entries; each true neighbour needs the ascent to go on
to the prefix that it shares with its query in the best tree, and the number of
candidates that makes the ascents reach a share of ``recall`` of the sample's
neighbours is asked of all queries.

The top of the trees is kept as counts of the entries below every prefix of up to
``top_bits`` bits, a table of fixed size, from which tasks follow a query's descent
and ascent. The sorted arrays live in blocks: bounds from approximate quantiles of
each tree's strings deal the entries to blocks of bounded size. A query goes to
every block that holds entries with its prefix, finds them there by binary search,
and sees all of them. Equal vectors are one entry, whose members (the smallest ids
that an answer can need) are put back at the end; equal strings are dealt apart by
a random suffix. So no task holds more entries for a vector, or a prefix, that
occurs often. A query that ascends to the empty prefix meets all entries, once.
``exact`` asks that of all queries (brute force in blocks).

Defined cases: vectors that are null, zero, or hold null or non-finite
components take no part, nor do those whose length is not the most frequent one
(ties: the smaller); an empty table gives an empty result; with few vectors every
query sees all of them. Repeated (id, vector) rows are one row. Inner products
become angles by the usual extra component sqrt(M^2 - |x|^2) of candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retainx.llm.scratch import materialize, shuffle_partitions


@dataclass(frozen=True)
class ForestParams:
    neighbours: int = 20
    trees: int = 48
    symbols: int = 4                    # length of a string
    symbol_bits: int = 7                # 2**(bits-1) axes
    recall: float = 0.95                # of the sample; leaves room for its error above 0.9
    sample: int = 128
    top_bits: int = 16                  # of the counted prefixes: 4 * trees * 2**bits bytes at most
    block: int = 1024                   # up to 16 times as many where many entries share a prefix
    seed: int = 17
    exact: bool = False                 # compare every query with all entries

    @property
    def tie_bits(self) -> int:
        return 63 - self.symbols * self.symbol_bits


class Hasher:
    """Symbol strings of vectors, as non-negative 63-bit numbers that sort like the strings."""

    def __init__(self, dim: int, norm: float, params: ForestParams) -> None:
        rng = np.random.default_rng(params.seed)
        axes = 1 << (params.symbol_bits - 1)
        self.params, self.norm = params, norm
        self.projection = rng.standard_normal((params.trees, params.symbols, dim + 1, axes)).astype(np.float32)

    def keys(self, x: np.ndarray, tree: int, query: bool, ties: np.ndarray) -> np.ndarray:
        p = self.params
        length = np.sqrt((x * x).sum(axis=1))
        if query:
            y = np.column_stack([x / length[:, None], np.zeros(len(x))])
        else:
            y = np.column_stack([x / self.norm, np.sqrt(np.maximum(0.0, 1 - (length / self.norm) ** 2))])
        key, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for s in range(p.symbols):
            z = y.astype(np.float32) @ self.projection[tree, s]
            axis = np.abs(z).argmax(axis=1)
            key = (key << p.symbol_bits) | (2 * axis + (z[rows, axis] > 0))
        return (key << p.tie_bits) | (ties & ((1 << p.tie_bits) - 1))


def usable(vector: Column) -> Column:
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, number) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Packed vectors as rows in double precision; their length tells single from double numbers."""
    packed = column.to_pylist()
    if not packed:
        return np.zeros((0, dim))
    kind = np.float32 if len(packed[0]) == 4 * dim else np.float64
    return np.frombuffer(b"".join(packed), kind).reshape(-1, dim).astype(np.float64)


def _pack_vectors(vectors: DataFrame, dim: int, kind: type) -> DataFrame:
    """vector (array) -> packed bytes of the numbers as they came, single or double."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in flat], pa.binary()), *b.columns[2:]],
                                             ["entry", "packed", "asked", "members"])
    return vectors.select("entry", "vector", "asked", "members").mapInArrow(run, "entry long, packed binary, asked boolean, members array<bigint>")


def _prefix_range(key: np.ndarray, bits: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last key that have the leading ``bits`` of each."""
    below = (np.int64(1) << np.asarray(63 - bits, np.int64)) - np.int64(1)      # 63 bits and no prefix: all keys
    return key & ~below, key | below


def _common_bits(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Length of the common prefix, up to ``bits``."""
    differ = (a ^ b) >> np.int64(63 - bits)
    return bits - np.where(differ == 0, 0, np.floor(np.log2(np.maximum(differ, 1))).astype(np.int64) + 1)


class ForestTop:
    """How many entries of each tree lie below each prefix of up to ``bits`` bits."""

    def __init__(self, counts: np.ndarray, bits: int) -> None:
        self.bits = bits
        self.before = np.concatenate([np.zeros((len(counts), 1), np.int64), counts.cumsum(axis=1)], axis=1)       # each leaf

    def held(self, keys: np.ndarray) -> np.ndarray:
        """For the keys of some queries (trees x queries): the entries with their first 0, 1, ... bits, in all trees together."""
        leaf = keys >> np.int64(63 - self.bits)
        out = np.zeros((self.bits + 1, keys.shape[1]), np.int64)
        for level in range(self.bits + 1):
            first = (leaf >> (self.bits - level)) << (self.bits - level)
            last = first + (1 << (self.bits - level))
            out[level] = (np.take_along_axis(self.before, last, 1) - np.take_along_axis(self.before, first, 1)).sum(axis=0)
        return out

    def ascent(self, keys: np.ndarray, enough: int) -> np.ndarray:
        """From the longest prefixes upwards: the first length at which a query's trees together hold enough entries (0: all)."""
        reached = self.held(keys) >= enough
        reached[0] = True
        return self.bits - np.argmax(reached[::-1], axis=0)


def _forest_top(packed: DataFrame, hasher: Broadcast[Hasher], dim: int, n: int) -> ForestTop:
    """Counted in tasks; what comes back has the size of the table."""
    params = hasher.value.params
    bits = min(params.top_bits, params.symbols * params.symbol_bits, max(1, int(n).bit_length()))
    trees = params.trees

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((trees, 1 << bits), np.int32)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                x = _matrix(b.column(0).slice(at, 2000), dim)
                for tree in range(trees):
                    leaf = hasher.value.keys(x, tree, False, np.zeros(len(x), np.int64)) >> np.int64(63 - bits)
                    held[tree] += np.bincount(leaf, minlength=1 << bits).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(range(trees), pa.int32()), pa.array([h.tobytes() for h in held], pa.binary())], ["tree", "held"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(h, np.int32).astype(np.int64) for h in table.column("held").to_pylist())
        return pa.table({"tree": table.column("tree").slice(0, 1), "held": pa.array([total.tobytes()], pa.binary())})

    counts = np.zeros((trees, 1 << bits), np.int64)
    found = packed.select("packed").mapInArrow(count, "tree int, held binary").groupBy("tree").applyInArrow(add, "tree int, held binary")
    for r in found.collect():                                          # one row per tree
        counts[r.tree] = np.frombuffer(bytes(r.held), np.int64)
    return ForestTop(counts, bits)


def _sample_neighbours(packed: DataFrame, dim: int, params: ForestParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sampled queries, their true neighbours, the query of each neighbour) by blocked brute force over all entries."""
    k = params.neighbours + 1
    asked = packed.where("asked").select("entry", "packed").orderBy(F.xxhash64("entry"), "entry").limit(params.sample).collect()
    q = _matrix(pa.array([bytes(r.packed) for r in asked], pa.binary()), dim)
    own = np.array([r.entry for r in asked])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, ids, data = np.zeros((len(q), 0)), np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), object)
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                score = np.column_stack([score, q @ _matrix(part.column(1), dim).T])
                ids = np.column_stack([ids, np.broadcast_to(part.column(0).to_numpy(), (len(q), part.num_rows))])
                data = np.column_stack([data, np.broadcast_to(np.array(part.column(1).to_pylist(), object), (len(q), part.num_rows))])
                best = np.lexsort((ids, -score))[:, :k]
                score, ids, data = (np.take_along_axis(x, best, 1) for x in (score, ids, data))
        of = np.repeat(np.arange(len(q), dtype=np.int32), score.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(score.ravel()), pa.array(ids.ravel()), pa.array(data.ravel().tolist(), pa.binary())],
                                         ["of", "score", "entry", "packed"])

    first = Window.partitionBy("of").orderBy(F.desc("score"), "entry")
    near = packed.select("entry", "packed").mapInArrow(nearest, "of int, score double, entry long, packed binary") \
        .withColumn("n", F.row_number().over(first)).where(F.col("n") <= k).select("of", "entry", "packed").collect()     # sample * k rows
    near = [r for r in near if r.entry != own[r.of]]
    return q, _matrix(pa.array([bytes(r.packed) for r in near], pa.binary()), dim), np.array([r.of for r in near], np.int64)


def _enough(packed: DataFrame, hasher: Hasher, top: ForestTop, dim: int) -> tuple[int, int]:
    """(candidates at which an ascent may stop, counted in all trees together; the length where the sample's usually does).

    An ascent reaches a neighbour's prefix if one bit more still held too few; so
    each neighbour asks for one candidate more than its query has there.
    """
    params = hasher.params
    q, x, of = _sample_neighbours(packed, dim, params)
    no_ties = lambda m: np.zeros(len(m), np.int64)
    keys = np.stack([hasher.keys(q, tree, True, no_ties(q)) for tree in range(params.trees)]) if len(q) else np.zeros((params.trees, 0), np.int64)
    least = (params.neighbours + 1) * params.trees              # a candidate counts once for each tree: so many are enough for an answer
    if not len(x):
        return least, 0
    longest = np.zeros(len(x), np.int64)
    for tree in range(params.trees):
        longest = np.maximum(longest, _common_bits(hasher.keys(x, tree, False, no_ties(x)), keys[tree][of], top.bits))
    held = np.vstack([top.held(keys), np.zeros((1, len(q)), np.int64)])            # beyond the counted bits: none needed
    asks = np.sort(held[longest + 1, of] + 1)
    enough = max(least, int(asks[min(len(asks) - 1, int(np.ceil(params.recall * len(asks))) - 1)]))
    return enough, int(np.median(top.ascent(keys, enough)))


def _nearest(packed: DataFrame, hasher: Broadcast[Hasher], top: Broadcast[ForestTop] | None, dim: int, n: int, count: int,
             enough: int, usual: int) -> DataFrame:
    """entry, found, score, compared: for every asked entry the best of those that share its prefix in some tree; all of them without ``top``."""
    spark, params = packed.sparkSession, hasher.value.params
    k, trees = params.neighbours + 1, params.trees if top else 1
    seed = params.seed

    def ties_of(entry: np.ndarray, tree: int) -> np.ndarray:
        return (entry * np.int64(0x5851F42D4C957F2D) + np.int64(tree * 0x9E3779B9 + seed)) >> np.int64(20)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """tree, low, high, query, entry, packed: an entry's key as both ends, and for every asked one the range of its prefix as a query."""
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                x, asked_ = _matrix(part.column(1), dim), np.flatnonzero(part.column(2).to_numpy(zero_copy_only=False).astype(bool))
                entry = part.column(0).to_numpy(zero_copy_only=False)
                give = lambda tree, own, low, high, query: pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), tree, np.int32)), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(np.full(len(own), query)),
                     pa.array(entry[own], pa.int64()), part.column(1).take(pa.array(own))], ["tree", "low", "high", "query", "entry", "packed"])
                for tree in range(trees):
                    key = hasher.value.keys(x, tree, False, ties_of(entry, tree))
                    yield give(tree, np.arange(len(x)), key, key, False)
                if not len(asked_):
                    continue
                if top is None:
                    keys, bits = np.zeros((1, len(asked_)), np.int64), np.zeros(len(asked_), np.int64)
                else:
                    keys = np.stack([hasher.value.keys(x[asked_], tree, True, ties_of(entry[asked_], tree)) for tree in range(trees)])
                    bits = top.value.ascent(keys, enough)
                for tree in range(trees):
                    some = np.flatnonzero((bits > 0) | (tree == 0))            # without a prefix one tree has all entries
                    if len(some):
                        yield give(tree, asked_[some], *_prefix_range(keys[tree][some], bits[some]), True)

    names = "tree int, low long, high long, query boolean, entry long, packed binary"
    forest = packed.select("entry", "packed", F.lit(False).alias("asked")).mapInArrow(hashed, names)
    # as large as the usual group of a prefix, so that a query meets few blocks
    block = max(params.block, min(16 * params.block, n >> usual, n // shuffle_partitions(spark)))
    blocks = max(1, -(-n // block))
    if blocks > 1:
        cuts = forest.groupBy("tree").agg(
            F.percentile_approx("low", [i / blocks for i in range(1, blocks)], 20 * blocks).alias("cuts")).collect()
        bounds = {r.tree: np.unique(np.array(r.cuts, np.int64)) for r in cuts}     # one number for each block
    else:
        bounds = {t: np.zeros(0, np.int64) for t in range(trees)}
    shared = spark.sparkContext.broadcast(bounds)
    # where usually no prefix is left every block meets all queries: in parts, so that a task holds a bounded number of them
    parts = 1 if usual else max(1, -(-count // (256 * params.block)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds block and part; a query goes to all blocks that its prefix reaches, an entry to all parts."""
        for b in hashed(batches):
            cut, low, high, entry = shared.value[b.column(0)[0].as_py()], b.column(1).to_numpy(), b.column(2).to_numpy(), b.column(4).to_numpy()
            start, end = np.searchsorted(cut, low, side="right"), np.searchsorted(cut, high, side="right") + 1
            part = entry % parts if b.column(3)[0].as_py() else None
            for at in range(0, b.num_rows, 64):                # many blocks for each query: few queries a batch
                many = (end - start)[at:at + 64]
                own = np.repeat(np.arange(at, at + len(many)), many)
                block_ = np.concatenate([np.arange(x, y) for x, y in zip(start[at:at + 64], end[at:at + 64])])
                for p in range(parts) if part is None else (None,):
                    yield b.take(pa.array(own)).append_column("block", pa.array(block_, pa.int32())) \
                        .append_column("part", pa.array(part[own] if p is None else np.full(len(own), p), pa.int32()))

    def look(table: pa.Table) -> pa.Table:
        """For every query of a block the nearest of its entries with the query's prefix, found by binary search."""
        is_query = table.column("query").to_numpy().astype(bool)
        data, ask = table.filter(pa.array(~is_query)), table.filter(pa.array(is_query))
        out: dict[str, list] = {n: [] for n in ("entry", "found", "score", "compared")}
        if data.num_rows and ask.num_rows:
            key = data.column("low").to_numpy()
            order = np.lexsort((data.column("entry").to_numpy(), key))
            key, ids = key[order], data.column("entry").to_numpy()[order]
            x = _matrix(data.column("packed"), dim)[order]
            lo_of = np.searchsorted(key, ask.column("low").to_numpy())
            hi_of = np.searchsorted(key, ask.column("high").to_numpy(), side="right")
            turn = np.lexsort((hi_of, lo_of))
            firsts = np.flatnonzero(np.append(True, (np.diff(lo_of[turn]) != 0) | (np.diff(hi_of[turn]) != 0)))
            for a, b in zip(firsts, np.append(firsts[1:], len(turn))):         # queries with the same entries
                lo, hi = int(lo_of[turn[a]]), int(hi_of[turn[a]])
                step = int(max(1, min(512, (1 << 21) // max(1, hi - lo))))
                for c in range(a, b, step) if hi > lo else ():
                    some = pa.array(turn[c:min(b, c + step)])
                    q = _matrix(ask.column("packed").take(some), dim)
                    score = q @ x[lo:hi].T
                    best = np.argpartition(-score, k + 3, axis=1)[:, :k + 4] if hi - lo > k + 4 else np.broadcast_to(np.arange(hi - lo), score.shape)
                    exact = (x[lo + best] * q[:, None, :]).sum(axis=2)         # the same sum for the same pair in every tree
                    keep = np.lexsort((ids[lo + best], -exact))[:, :k]
                    out["entry"] += ask.column("entry").take(some).to_pylist()
                    out["found"] += list(np.take_along_axis(ids[lo + best], keep, 1))
                    out["score"] += list(np.take_along_axis(exact, keep, 1))
                    out["compared"] += [hi - lo] * len(some)
        return pa.table({"entry": pa.array(out["entry"], pa.int64()), "found": pa.array(out["found"], pa.list_(pa.int64())),
                         "score": pa.array(out["score"], pa.list_(pa.float64())), "compared": pa.array(out["compared"], pa.int64())})

    seen = packed.select("entry", "packed", "asked") \
        .mapInArrow(deal, f"{names}, block int, part int") \
        .groupBy("tree", "block", "part").applyInArrow(look, "entry long, found array<long>, score array<double>, compared long")

    def merge(table: pa.Table) -> pa.Table:
        """The best of all trees and blocks."""
        ids, first = np.unique(table.column("found").combine_chunks().flatten().to_numpy(), return_index=True)
        score = table.column("score").combine_chunks().flatten().to_numpy()[first]
        best = np.lexsort((ids, -score))[:k]
        return pa.table({"entry": pa.array(np.full(len(best), table.column("entry")[0].as_py()), pa.int64()),
                         "found": pa.array(ids[best], pa.int64()), "score": pa.array(score[best], pa.float64()),
                         "compared": pa.array(np.full(len(best), pc.sum(table.column("compared")).as_py()), pa.int64())})

    return seen.groupBy("entry").applyInArrow(merge, "entry long, found long, score double, compared long")


def search(vectors: DataFrame, queries: Column, params: ForestParams = ForestParams(), id_col: str = "vec_id",
           vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the nearest found of every row for which ``queries`` holds,
    and compared: the entries that its vector was compared with, once for each tree that held them."""
    spark = vectors.sparkSession
    answer = "query_id long, rank int, vec_id long, score double, compared long"
    k = params.neighbours + 1                                  # a query's own entry is among its nearest
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), queries.alias("asked"))
    dims = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], answer)
    dim = dims[0].d
    rows = rows.where(F.size("vector") == dim)
    # equal vectors are one entry with its k smallest ids; the row limit works before the shuffle
    byid = Window.partitionBy("vector").orderBy("id")
    members = rows.select("id", "vector").withColumn("_n", F.dense_rank().over(byid)).where(F.col("_n") <= k) \
        .groupBy("vector").agg(F.sort_array(F.collect_set("id")).alias("members"))
    asked = rows.where("asked").select("vector", "id").distinct()
    entries = members.join(asked.select("vector").distinct().withColumn("asked", F.lit(True)), "vector", "left") \
        .select(F.get("members", 0).alias("entry"), "vector", F.coalesce("asked", F.lit(False)).alias("asked"), "members")
    kind = np.float32 if dict(vectors.dtypes)[vector_col] == "array<float>" else np.float64
    packed = materialize(_pack_vectors(entries, dim, kind), "forest-entries")
    asked = materialize(asked.join(entries.select("vector", "entry"), "vector").select("id", "entry"), "forest-queries")

    def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(0), dim)
            yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt((x * x).sum(axis=1)).max(initial=0.0))]), pa.array([len(x)])], ["m", "n"])

    row = packed.select("packed").mapInArrow(largest, "m double, n long").agg(F.max("m").alias("m"), F.sum("n").alias("n")).first()
    hasher = spark.sparkContext.broadcast(Hasher(dim, row.m, params))          # fixed size: the random projections
    count = packed.where("asked").count()
    top, enough, usual = None, 0, 0
    if not params.exact and count:
        counted = _forest_top(packed, hasher, dim, row.n)
        enough, usual = _enough(packed, hasher.value, counted, dim)
        top = spark.sparkContext.broadcast(counted)                            # fixed size: 8 * trees * 2**top_bits bytes
    best = _nearest(packed, hasher, top, dim, row.n, count, enough, usual)
    # entries back to ids: at most k found entries of at most k members for each asked entry, before its copies are told apart
    lists = best.join(packed.select(F.col("entry").alias("found"), "members"), "found") \
        .groupBy("entry").agg(F.array_sort(F.flatten(F.collect_list(F.transform("members", lambda m: F.struct(
            (-F.col("score")).alias("s"), m.alias("id")))))).alias("near"), F.max("compared").alias("compared"))
    near = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, params.neighbours)
    return asked.join(lists, "entry").select("id", "compared", F.posexplode(near)) \
        .select(F.col("id").alias("query_id"), (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.id").alias("vec_id"),
                (-F.col("col.s")).alias("score"), "compared")


def neighbours_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the 20 nearest of every vector whose id is divisible by 20."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
