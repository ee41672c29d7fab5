"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of documents in a random order. A source with
share a of a period of D slots gives its i-th block (from 1) the release time
floor((i-1) D / a) and the deadline ceil(i D / a); in every slot the released
block with the earliest deadline goes out. So after every slot each source has
put out its share of the slots to within less than one block. Windows do not
cross the end of a period, so one period is a template for all of them, and a
block's slot follows from its number alone: documents are placed in parallel.

A source that has no block left ends a phase; the next one starts with the
remaining sources and their shares of a new period. Every row is kept exactly
once; the bound holds within every phase.

What the driver sees are the row counts of the sources (at most ``max_sources``)
and the templates, whose length is bounded by sources x period; the table itself
is dealt by (source, hash range), so a hot source is spread over all tasks.

Defined cases: null is a source of its own; null and repeated ids are rows like
any others, in the order of a hash of their content, so that a recomputed task
places them alike (equal rows can change places unseen); an empty table gives an empty one; other columns are carried along.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from math import gcd

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retainx.llm.scratch import shuffle_partitions

PLACE_COLUMNS = ("_phase", "_block", "_slot", "_release", "_deadline", "_position")


@dataclass(frozen=True)
class MixParams:
    block_docs: int = 8
    period: int = 1000                  # resolution of shares made from weights
    max_sources: int = 2000
    seed: int = 3


def shares_of(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Whole shares of ``period`` slots nearest to the weights (largest remainders, each at least 1)."""
    total = sum(weights.values())
    period = max(period, len(weights))
    exact = {s: w * period / total for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    for s in sorted(weights, key=lambda s: (int(exact[s]) - exact[s], s))[:max(0, period - sum(out.values()))]:
        out[s] += 1
    return out


def temperature_shares(counts: Mapping[str, int], alpha: float = 0.5, period: int = 1000) -> dict[str, int]:
    """Target shares in proportion to count ** alpha: large sources are damped, small ones lifted."""
    return shares_of({s: n ** alpha for s, n in counts.items()}, period)


def template(shares: Mapping[str, int]) -> tuple[int, dict[str, list[int]]]:
    """(slots of a period, the slots of each source's blocks) by earliest deadline first."""
    if not shares or min(shares.values()) < 1:
        raise ValueError("every source needs a share of at least 1")
    d = reduce(gcd, shares.values())
    own = {s: a // d for s, a in shares.items()}
    size = sum(own.values())
    waiting = [(0, s, 1) for s in sorted(own)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slots: dict[str, list[int]] = {s: [] for s in own}
    for t in range(size):
        while waiting and waiting[0][0] <= t:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-i * size // own[s]), s, i))
        _, s, i = heapq.heappop(ready)
        slots[s].append(t)
        if i < own[s]:
            heapq.heappush(waiting, (i * size // own[s], s, i + 1))
    return size, slots


def plan_phases(counts: Mapping[str, int], shares: Mapping[str, int], block_docs: int) -> dict[str, list[dict]]:
    """For each source its phases: number, first block, first slot, period, own slots in it, documents missing before it."""
    left = {s: -(-n // block_docs) for s, n in counts.items() if n > 0}
    first = dict.fromkeys(left, 0)
    plan: dict[str, list[dict]] = {s: [] for s in left}
    start = short = phase = 0
    while left:
        size, slots = template({s: shares[s] for s in left})
        for s in left:
            plan[s].append({"phase": phase, "first": first[s], "start": start, "period": size, "slots": slots[s], "short": short})
        ends = {s: (n - 1) // len(slots[s]) * size + slots[s][(n - 1) % len(slots[s])] + 1 for s, n in left.items()}
        done = min(ends, key=ends.__getitem__)
        length = ends[done]
        for s in list(left):
            used = length // size * len(slots[s]) + sum(t < length % size for t in slots[s])
            left[s] -= used
            first[s] += used
        del left[done]
        short += -counts[done] % block_docs
        start += length
        phase += 1
    return plan


def mix_sources(docs: DataFrame, shares: Mapping[str | None, int] | None = None, params: MixParams = MixParams(),
                source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """All columns of ``docs`` with PLACE_COLUMNS (which replace columns of these names); _position is gapless from 0.

    ``shares`` are whole target shares by source; by default ``temperature_shares`` of the row counts.
    """
    spark = docs.sparkSession
    name = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    ranges = 4 * shuffle_partitions(spark)
    hashed = F.xxhash64(F.col(id_col), F.lit(params.seed))
    kept = [c for c in docs.columns if c not in PLACE_COLUMNS]
    content = F.xxhash64(*[c for c, t in docs.dtypes if c in kept and "map<" not in t])             # tells rows of one id apart
    df = docs.select(F.struct(*kept).alias("_doc"), F.col(id_col).alias("_id"), content.alias("_content"), name.alias("_source"), hashed.alias("_hash")) \
        .withColumn("_range", F.shiftright(F.shiftrightunsigned("_hash", 33) * ranges, 31).cast("int"))
    counted = df.groupBy("_source", "_range").agg(F.count(F.lit(1)).alias("n"))
    rows = counted.groupBy("_source").agg(F.sum("n").alias("n")).limit(params.max_sources + 1).collect()
    if len(rows) > params.max_sources:
        raise ValueError(f"more than {params.max_sources} sources")
    counts = {r._source: r.n for r in rows}
    wanted = temperature_shares(counts, period=params.period) if shares is None else \
        {("null" if s is None else f"={s}"): a for s, a in shares.items()}
    if missing := sorted(set(counts) - set(wanted)):
        raise ValueError(f"no target share for {missing[:5]}")
    plan = plan_phases(counts, wanted, params.block_docs)
    phase_type = "struct<phase: int, first: bigint, start: bigint, period: bigint, slots: array<bigint>, short: bigint>"
    table = spark.range(1).select(F.explode(F.from_json(
        F.lit(json.dumps([{"_source": s, "_phases": p} for s, p in plan.items()])),
        f"array<struct<_source: string, _phases: array<{phase_type}>>>")).alias("x")).select("x.*")
    # rows before each (source, range): a frame of sources x ranges rows
    before = counted.withColumn("_before", F.sum("n").over(
        Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).drop("n")
    own = Window.partitionBy("_source", "_range").orderBy("_hash", "_id", "_content")
    df = df.withColumn("_rank", F.row_number().over(own) - 1).join(before, ["_source", "_range"]) \
        .withColumn("_rank", F.col("_rank") + F.coalesce("_before", F.lit(0))) \
        .withColumn("_block", F.floor(F.col("_rank") / params.block_docs)) \
        .join(F.broadcast(table), "_source")           # at most max_sources rows
    df = df.withColumn("_p", F.element_at(F.filter("_phases", lambda p: p["first"] <= F.col("_block")), -1)).drop("_phases")
    i = F.col("_block") - F.col("_p.first")
    size = F.size("_p.slots")
    turn, k, period = F.floor(i / size), i % size, F.col("_p.period")
    base = F.col("_p.start") + turn * period
    slot = base + F.get(F.col("_p.slots"), k.cast("int"))
    return df.select(
        "_doc.*", F.col("_p.phase").alias("_phase"), "_block", slot.alias("_slot"),
        (base + F.floor(k * period / size)).alias("_release"), (base + F.ceil((k + 1) * period / size)).alias("_deadline"),
        (slot * params.block_docs - F.col("_p.short") + F.col("_rank") % params.block_docs).alias("_position"))


def mixing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: place of every document in the mixed order, with its block's slot, release time and deadline."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix_sources(docs).select("doc_id", "source", *[F.col(f"_{c}").alias(c) for c in
                                                         ("phase", "block", "slot", "release", "deadline", "position")])
