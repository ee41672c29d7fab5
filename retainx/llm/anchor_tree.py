"""Hard negatives for contrastive training, found with bounds along a spanning tree of the anchors.

Neighbouring anchors have similar scores: for a candidate c, an anchor a and its
parent p in the tree, <c, a> lies within <c, p> plus or minus |a - p| * |c|. Anchors
are dealt by the signs of random projections into blocks of bounded size, and in
each block a minimum spanning tree over its anchors and the zero vector, where
every score is 0, is grown once. Each (shard of the candidates, block of anchors)
cell walks the block's tree from the zero vector: an anchor inherits its parent's
interval of every candidate's score, widened by edge length times norm, and only
candidates whose interval overlaps a window that the answer can still use are
rescored exactly, which narrows their interval to a point for the children. The
others keep the wide one. A parent's intervals live until its last child took
them, the child with the largest subtree last, so that the walk holds a number of
arrays logarithmic in the block.

Two walks: the first finds each anchor's positives (the window is everything from
the best lower bounds of rows with its label upwards), the second its negatives,
within the windows that the positives' scores open. A window closes from below as
soon as enough candidates are certain to lie higher in it.

Defined cases: rows with a null id or label take no part, nor do the vectors that
``intvectors`` leaves out; repeated (id, vector, label) rows are one row; an
anchor's rows of its own id are neither its positives nor its negatives; an id with
several vectors or labels is several rows and, if asked, several anchors (their
answers stand under the same id); ties go to the smaller id; an anchor without
positives, or a positive without negatives in its window, has no rows; an empty
table gives an empty result. Negative positive scores open an empty window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retainx.llm.intvectors import Scores, integer_vectors, smallest_ids, unpack
from retainx.llm.scratch import materialize, shuffle_partitions


@dataclass(frozen=True)
class MiningParams:
    positives: int = 5
    negatives: int = 3
    low_percent: int = 50               # of the positive's score
    high_percent: int = 95
    shard_rows: int = 16384
    block_anchors: int = 1024
    scale: int = 256
    seed: int = 29


TREE = "block int, place int, parent int, edge double, subtree int, anchor_id long, label long, packed binary"
FOUND = "anchor_id long, label long, packed binary, positive_id long, positive_score long, vec_id long, score long"


def spanning_trees(anchors: DataFrame, dim: int, params: MiningParams) -> DataFrame:
    """The anchors (id, packed, label) with their block and place in its tree: parents first, place 0 is the zero vector."""
    count = anchors.count()
    signs = max(0, (-(-count // params.block_anchors) - 1).bit_length())
    planes = np.random.default_rng(params.seed).standard_normal((dim, signs))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            side = unpack(b.column(1).to_pylist(), dim) @ planes > 0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(side @ (1 << np.arange(signs, dtype=np.int64)))],
                                             ["id", "packed", "label", "code"])

    coded = anchors.mapInArrow(code, "id long, packed binary, label long, code long")
    # a code that many anchors share is split again by hash; one row per code, numbered on
    sizes = coded.groupBy("code").agg(F.ceil(F.count(F.lit(1)) / params.block_anchors).alias("parts")) \
        .withColumn("first", F.sum("parts").over(Window.orderBy("code")) - F.col("parts"))
    dealt = coded.join(sizes, "code").withColumn("block", (F.col("first") + F.pmod(
        F.xxhash64("id", "packed", "label"), F.col("parts"))).cast("int"))

    def grow(table: pa.Table) -> pa.Table:
        x = unpack(table.column("packed").to_pylist(), dim).astype(np.float64)
        n = len(x)
        nearest, parent = np.sqrt((x * x).sum(axis=1)), np.zeros(n, np.int64)      # at first from the zero vector
        order, edges, open_ = [], [], np.ones(n, bool)
        place = np.zeros(n, np.int64)
        for i in range(n):
            at = int(np.argmin(np.where(open_, nearest, np.inf)))
            open_[at] = False
            order.append(at)
            edges.append(nearest[at])
            place[at] = i + 1
            apart = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
            closer = open_ & (apart < nearest)
            nearest[closer], parent[closer] = apart[closer], i + 1
        up = parent[order]
        subtree = np.ones(n + 1, np.int64)
        for i in range(n, 0, -1):
            subtree[up[i - 1]] += subtree[i]
        ordered = table.take(pa.array(order))
        return pa.table({"block": ordered.column("block"), "place": pa.array(range(1, n + 1), pa.int32()), "parent": pa.array(up, pa.int32()),
                         "edge": pa.array(edges, pa.float64()), "subtree": pa.array(subtree[1:], pa.int32()),
                         "anchor_id": ordered.column("id"), "label": ordered.column("label"), "packed": ordered.column("packed")})

    return dealt.groupBy("block").applyInArrow(grow, TREE)


class Walk:
    """One shard's candidates and the walk along one block's tree."""

    def __init__(self, shard: pa.Table, tree: pa.Table, dim: int) -> None:
        self.ids, self.labels = shard.column("id").to_numpy(), shard.column("label").to_numpy()
        order = np.argsort(self.ids, kind="stable")                  # ties to smaller ids
        x = unpack(shard.column("packed").to_pylist(), dim)[order]
        self.ids, self.labels = self.ids[order], self.labels[order]
        self.anchors = unpack(tree.column("packed").to_pylist(), dim)
        self.scores = Scores(x, self.anchors)
        wide = x.astype(np.float64)
        self.norms = np.sqrt((wide * wide).sum(axis=1)) * (1 + 1e-12)
        self.tree = {c: tree.column(c).to_pylist() for c in ("place", "parent", "edge", "subtree", "anchor_id", "label")}
        self.rescored = 0

    def steps(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(row of the tree, low, high) in an order that visits parents first; the caller narrows low and high in place."""
        children: dict[int, list[int]] = {}
        for row, up in enumerate(self.tree["parent"]):
            children.setdefault(up, []).append(row)
        for rows in children.values():                                # the last one pushed is visited first: small subtrees
            rows.sort(key=lambda r: -self.tree["subtree"][r])
        zero = np.zeros(len(self.ids))
        left = {0: len(children.get(0, ()))}
        held = {0: (zero, zero)}
        todo = list(children.get(0, ()))
        while todo:
            row = todo.pop()
            up, place = self.tree["parent"][row], self.tree["place"][row]
            low, high = held[up]
            left[up] -= 1
            if not left[up]:
                del held[up]
            wider = (self.tree["edge"][row] * (1 + 1e-12)) * self.norms + 1e-6
            low, high = low - wider, high + wider
            yield row, low, high
            if place in children:
                held[place], left[place] = (low, high), len(children[place])
                todo += children[place]

    def rescore(self, row: int, need: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(needed rows, their exact scores); their intervals become points."""
        at = np.flatnonzero(need)
        exact = self.scores.of(self.anchors[row], at)
        low[at] = high[at] = exact
        self.rescored += len(at)
        return at, exact


def _kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, -k)[-k]) if len(values) >= k else -np.inf


def _best(exact: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the first (rows ascend with their ids)."""
    return np.argsort(-exact, kind="stable")[:k]


def _positives(walk: Walk, params: MiningParams) -> Iterator[tuple[int, int, int, int, int]]:
    """(tree row, -, -, positive's id, score) of the shard's best rows with the anchor's label."""
    for row, low, high in walk.steps():
        own = (walk.labels == walk.tree["label"][row]) & (walk.ids != walk.tree["anchor_id"][row])
        need = own & (high >= _kth(low[own], params.positives))
        at, exact = walk.rescore(row, need, low, high)
        for i in _best(exact, params.positives):
            yield row, 0, 0, int(walk.ids[at[i]]), int(exact[i])


def _negatives(walk: Walk, params: MiningParams, positives: list[list]) -> Iterator[tuple[int, int, int, int, int]]:
    """(tree row, positive's id, positive's score, negative's id, score) of the shard's best rows in each window."""
    for row, low, high in walk.steps():
        other = (walk.labels != walk.tree["label"][row]) & (walk.ids != walk.tree["anchor_id"][row])
        windows = []
        need = np.zeros(len(other), bool)
        for p in positives[row]:
            floor, top = -(-params.low_percent * p["score"] // 100), params.high_percent * p["score"] // 100
            if floor > top:
                continue
            windows.append((p, floor, top))
            sure = other & (low >= floor) & (high <= top)
            need |= other & (low <= top) & (high >= max(floor, _kth(low[sure], params.negatives)))
        if not windows:
            continue
        at, exact = walk.rescore(row, need, low, high)
        for p, floor, top in windows:
            inside = np.flatnonzero((exact >= floor) & (exact <= top))
            for i in inside[_best(exact[inside], params.negatives)]:
                yield row, p["id"], p["score"], int(walk.ids[at[i]]), int(exact[i])


def _walks(candidates: DataFrame, trees: DataFrame, dim: int, params: MiningParams, second: bool) -> DataFrame:
    """Every block of anchors against every shard of candidates."""
    count, blocks = candidates.count(), (trees.agg(F.max("block")).first()[0] or 0) + 1
    # few cells: smaller shards, so that every core has one
    wanted = -(-2 * shuffle_partitions(candidates.sparkSession) // blocks)
    shards = max(1, -(-count // params.shard_rows), min(wanted, -(-count // 1024)))

    def cell(key: tuple, shard: pa.Table, tree: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if shard.num_rows and tree.num_rows:
            tree = tree.sort_by("place")
            walk = Walk(shard, tree, dim)
            found = _negatives(walk, params, tree.column("positives").to_pylist()) if second else _positives(walk, params)
            packed = tree.column("packed").to_pylist()
            rows = [(walk.tree["anchor_id"][r], walk.tree["label"][r], packed[r], p, s, v, w) for r, p, s, v, w in found]
        columns = list(zip(*rows)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)],
                        names=["anchor_id", "label", "packed", "positive_id", "positive_score", "vec_id", "score"])

    left = candidates.withColumn("shard", F.pmod(F.xxhash64("id", "packed"), F.lit(shards)).cast("int")) \
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = trees.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(cell, FOUND)


def mine(vectors: DataFrame, anchors: Column, params: MiningParams = MiningParams(), id_col: str = "vec_id",
         vector_col: str = "embedding", label: Column | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` is a condition on the columns of ``vectors`` and ``label`` a whole
    number (by default their column ``label``). A negative's score is from
    ``low_percent`` to ``high_percent`` of its positive's.
    """
    spark = vectors.sparkSession
    label = (F.col("label") if label is None else label).cast("long")
    rows, dim = integer_vectors(vectors.where(label.isNotNull()), id_col, vector_col, label.alias("label"),
                                F.coalesce(anchors, F.lit(False)).alias("asked"), scale=params.scale)
    if not dim:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    # an anchor's own id can be among the smallest of a vector: one more
    keep = max(params.positives, params.negatives) + 1
    kept = materialize(smallest_ids(rows, keep, "label"), "anchor-candidates")
    asked = materialize(rows.where("asked").select("id", "packed", "label").distinct(), "anchor-anchors")
    trees = materialize(spanning_trees(asked, dim, params), "anchor-trees")
    anchor = ["anchor_id", "label", "packed"]
    best = lambda by: Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    positives = _walks(kept, trees, dim, params, second=False) \
        .withColumn("n", F.row_number().over(best(anchor))).where(F.col("n") <= params.positives) \
        .groupBy(*anchor).agg(F.sort_array(F.collect_list(F.struct("n", F.col("vec_id").alias("id"), "score"))).alias("positives"))
    # anchors without positives stay in the tree: their children need them
    opened = materialize(trees.join(positives, anchor, "left").withColumn("positives", F.coalesce(
        "positives", F.array().cast("array<struct<n:int,id:bigint,score:bigint>>"))), "anchor-windows")
    window = [*anchor, "positive_id", "positive_score"]
    return _walks(kept, opened, dim, params, second=True) \
        .withColumn("rank", F.row_number().over(best(window))).where(F.col("rank") <= params.negatives) \
        .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
                "positive_score", F.col("score").alias("negative_score"))


def negatives_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: hard negatives of every vector whose id is divisible by 50, with the labels the contract moves."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, label=moved)
