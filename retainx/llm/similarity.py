"""Exact similarity graphs from shared signatures, without all pairs of a group.

Two nodes can only be similar if they share a signature. In a group of more than
``SMALL_GROUP`` nodes every node is compared with one leader, the node with the
smallest hash; as overlapping groups mostly agree on it, this links most true
copies with a few comparisons for each node. What remains open are pairs whose
nodes are not connected yet: the larger groups that overlap form a family, and
the nodes outside a family's largest component are compared with the rest of it
in blocks of bounded size, inside tasks, by their payloads. A small group is
compared pair by pair, but for pairs within a family, which are settled there.
No link is lost, and no group is ever held by one task as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retainx.llm.scratch import materialize

SMALL_GROUP = 24
#: A block of the exact comparison holds about so many nodes and payload bytes.
BLOCK_NODES, BLOCK_BYTES = 512, 8 << 20


@dataclass(frozen=True)
class PairTest:
    """How two payloads are compared.

    ``verify`` decides exactly for each pair; ``sketch`` gives a short vector of
    counts, and ``near`` which of many sketches can belong to something similar
    to one of them (it may err on the side of yes only).
    """

    verify: Callable[[list[bytes], list[bytes]], np.ndarray]
    sketch: Callable[[bytes], np.ndarray]
    near: Callable[[np.ndarray, np.ndarray], np.ndarray]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b); a component is named by its smallest node.

    Alternating large-star and small-star rounds, each written to the shared
    folder, until every node points at the centre of its star; their number is
    logarithmic in practice.
    """
    edges = materialize(edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", narrow=True)
    while not _are_stars(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")) \
            .union(least.select("a", F.col("m").alias("b"))).distinct()
        edges = materialize(small, "edges", narrow=True)                    # a is the larger node of every edge
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node either is a centre or points at just one."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("out")),
                                          F.struct(F.col("b").alias("n"), F.lit(0).alias("out")))).alias("x")).select("x.*")
    counts = ends.groupBy("n").agg(F.sum("out").alias("out"), F.count_if(F.col("out") == 0).alias("in"))
    return counts.where((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("in") > 0))).isEmpty()


def check_pairs(pairs: DataFrame, payload: DataFrame, test: PairTest) -> DataFrame:
    """The similar ones of the distinct pairs (a, b)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                good = test.verify(b.column(2).to_pylist(), b.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(good))

    one = payload.select(F.col("node").alias("a"), F.col("payload").alias("p"))
    two = payload.select(F.col("node").alias("b"), F.col("payload").alias("q"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "p", "q").mapInArrow(run, "a long, b long")


def similar_components(postings: DataFrame, payload: DataFrame, test: PairTest, name: str) -> DataFrame:
    """(node, component) of all nodes that are similar to another one, directly or by others in between.

    ``postings``: distinct (sig, node); ``payload``: (node, payload), one row for each node of the postings.
    """
    sizes = postings.groupBy("sig").agg(F.count(F.lit(1)).alias("size"))
    groups = materialize(postings.join(sizes.where(F.col("size") > 1), "sig"), f"{name}-groups")
    few = groups.where(F.col("size") <= SMALL_GROUP).select("sig", "node")
    large = groups.where(F.col("size") > SMALL_GROUP)
    pick = F.xxhash64("node")
    leaders = large.groupBy("sig").agg(F.min(F.struct(pick.alias("h"), "node")).alias("x")).select("sig", F.col("x.node").alias("leader"))
    stars = large.join(leaders, "sig").where(F.col("node") != F.col("leader")) \
        .select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    stars = materialize(stars, f"{name}-stars", narrow=True)
    alone = stars.isEmpty()                                    # no large group
    if alone:
        few = few.withColumn("family", F.lit(None).cast("long"))
    else:
        families = materialize(components(stars).withColumnRenamed("component", "family"), f"{name}-families", narrow=True)
        few = few.join(families, "node", "left")
    one, two = (few.select("sig", F.col("node").alias(n), F.col("family").alias(f)) for n, f in (("a", "f"), ("b", "g")))
    apart = F.col("f").isNull() | F.col("g").isNull() | (F.col("f") != F.col("g"))
    pairs = one.join(two, "sig").where((F.col("a") < F.col("b")) & apart).select("a", "b").distinct()
    linked = components(check_pairs(pairs.union(stars), payload, test))
    if alone:
        return linked
    linked = materialize(linked, f"{name}-linked", narrow=True)
    nodes = families.join(linked, "node", "left").select(
        "node", "family", F.coalesce("component", "node").alias("component"))
    more = materialize(_open_pairs(materialize(nodes, f"{name}-nodes", narrow=True), payload, test), f"{name}-open", narrow=True)
    if more.isEmpty():
        return linked
    # what was linked is stars already: only the components that the new links join are worked through
    of = lambda n: linked.select(F.col("node").alias(n), F.col("component").alias(f"c_{n}"))
    joints = more.join(of("a"), "a", "left").join(of("b"), "b", "left") \
        .select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    merged = components(joints).select(F.col("node").alias("part"), F.col("component").alias("whole"))
    ends = more.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(linked.select("node"), "node", "left_anti") \
        .select("node", F.col("node").alias("component"))
    return linked.unionByName(ends).join(merged, F.col("component") == F.col("part"), "left") \
        .select("node", F.coalesce("whole", "component").alias("component"))


def _open_pairs(nodes: DataFrame, payload: DataFrame, test: PairTest) -> DataFrame:
    """Links between unconnected nodes (node, family, component) of one family."""
    counts = nodes.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("family").agg(F.max(F.struct("n", "component")).alias("x"), F.count(F.lit(1)).alias("parts")) \
        .where(F.col("parts") > 1).select("family", F.col("x.component").alias("main"))
    held = nodes.join(main, "family").join(payload, "node") \
        .withColumn("rest", F.col("component") != F.col("main")).withColumn("size", F.octet_length("payload"))
    blocks = lambda w: F.greatest(F.ceil(F.count_if(w) / BLOCK_NODES), F.ceil(F.sum(F.when(w, F.col("size")).otherwise(0)) / BLOCK_BYTES)) \
        .cast("int")
    cut = held.groupBy("family").agg(blocks(F.col("rest")).alias("rows"), blocks(F.lit(True)).alias("columns"))
    held = held.join(cut, "family").select("family", "node", "component", "payload", "rest", "rows", "columns")
    spot = F.xxhash64("node")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = held.where("rest").select("family", F.pmod(spot, F.col("rows")).cast("int").alias("i"), F.explode(upto("columns")).alias("j"),
                                     "node", "component", "payload", F.lit(True).alias("is_left"))
    right = held.select("family", F.explode(upto("rows")).alias("i"), F.pmod(spot, F.col("columns")).cast("int").alias("j"),
                        "node", "component", "payload", F.lit(False).alias("is_left"))

    def run(table: pa.Table) -> pa.Table:
        is_left = table.column("is_left").to_numpy().astype(bool)
        node, comp, data = table.column("node").to_numpy(), table.column("component").to_numpy(), table.column("payload").to_pylist()
        rows, cols = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        out_a, out_b = [], []
        sketches = np.stack([test.sketch(data[c]) for c in cols]) if len(cols) else None
        for r in rows if len(cols) else ():                    # one node against a block of bounded size
            at = cols[(comp[cols] != comp[r]) & test.near(test.sketch(data[r]), sketches)]
            if len(at):
                hit = at[test.verify([data[r]] * len(at), [data[c] for c in at])]
                out_a += [node[r]] * len(hit)
                out_b += node[hit].tolist()
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return left.union(right).groupBy("family", "i", "j").applyInArrow(run, "a long, b long")
