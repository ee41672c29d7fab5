"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its distinct k-word shingles. Shingles are ordered by
frequency class, rare ones first, then by hash; two sets with Jaccard similarity
of at least the threshold then share shingles among the first few of that order,
their prefixes. A rare shingle of a prefix is indexed alone. Frequent shingles
are indexed as pairs only: shingles are dealt by hash into g classes, and the
prefix is extended until similar sets share more frequent shingles of it than
there are classes, so that two of these fall into one class, and only pairs
within a class need to be indexed; g follows the size of the set, which keeps
the number of pairs linear in it. Sets that share an index entry are candidates
and are verified exactly (``similarity``).

Frequencies are counted over all documents, by 40 bits of the shingle hash or
more; which class a shingle is in comes from bitmaps of bounded size. Any order gives the same
result, so a bitmap that fills up costs time, never a link.

Defined cases: A-Z are folded, words are runs without ASCII white space; a text
of fewer than k words is one shingle, the whole sequence; a null text, or one
without words, is an empty set, linked with nothing and its own component. Equal
sets are one node. A null id is never the name of a component unless there is no
other. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retainx.llm.bitmaps import fitting_classes, is_marked, repeated_marks
from retainx.llm.scratch import materialize
from retainx.llm.similarity import PairTest, similar_components
from retainx.llm.textnp import WordHasher, distinct_by_row, mix, shingle_hashes, slices, utf8


@dataclass(frozen=True)
class JoinParams:
    """``classes``: (least frequency, log2 of its bitmap's bits); the last class is the frequent one, indexed by pairs."""

    k: int = 5
    percent: int = 80                   # of the union that the intersection must reach
    classes: tuple[tuple[int, int], ...] = ((2, 29), (8, 25), (64, 23))

    def overlap(self, n: np.ndarray | int) -> np.ndarray | int:
        """Shingles that a set of n shares at least with any similar one."""
        return -(-n * self.percent // 100)


class ShingleReader:
    """Distinct shingles of texts, a bounded number of bytes at a time."""

    def __init__(self, k: int) -> None:
        self.k, self._hasher = k, WordHasher()

    def read(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, sorted distinct shingles row by row, shingles before each row)."""
        data, offsets = utf8(column)
        for a, b in slices(offsets):
            words, _, bounds = self._hasher.words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
            yield a, b, *distinct_by_row(*shingle_hashes(words, bounds, self.k))


def frequency_bitmaps(documents: DataFrame, params: JoinParams, text_col: str) -> list[np.ndarray]:
    """For each class a bitmap over the leading bits of the shingle hash."""
    def marks(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, h, _ in ShingleReader(params.k).read(batch.column(0)):
            yield h

    return repeated_marks(documents.select(F.col(text_col)), marks, params.classes)


def classes_of(shingles: np.ndarray, maps: list[np.ndarray], params: JoinParams) -> np.ndarray:
    """Frequency class of each shingle: 0 is a shingle of one document, the last one is frequent."""
    out = np.zeros(len(shingles), np.int8)
    for c, (bitmap, (_, width)) in enumerate(zip(maps, params.classes), start=1):
        out[is_marked(bitmap, width, shingles)] = c
    return out


def _levels(n: int, params: JoinParams) -> range:
    """Size levels (log2) that a partner of a set of n can have."""
    return range(int(params.overlap(n)).bit_length() - 1, (n * 100 // params.percent).bit_length())


def prefix_entries(shingles: np.ndarray, classes: np.ndarray, params: JoinParams) -> np.ndarray:
    """Index entries of one set of distinct shingles."""
    n, frequent = len(shingles), len(params.classes)
    order = np.lexsort((shingles, classes))
    s, c = shingles[order], classes[order]
    base = n - int(params.overlap(n)) + 1
    hot = np.cumsum(c == frequent)                              # frequent ones among the first i + 1
    out, longest = [], base
    for level in _levels(n, params):
        g = max(1, (1 << level) // 16)
        # the shortest prefix with length - min(frequent ones, g) >= base
        enough = np.flatnonzero(np.arange(1, n + 1) - np.minimum(hot, g) >= base)
        length = int(enough[0]) + 1 if len(enough) else n
        longest = max(longest, length)
        mine = s[:length][c[:length] == frequent]
        if len(mine) > 1:
            part = (mix(mine) % np.uint64(g)).astype(np.int64)
            by = np.lexsort((mine, part))
            mine, part = mine[by], part[by]
            for gap in range(1, len(mine)):                     # neighbours at every distance within a class
                same = np.flatnonzero(part[gap:] == part[:-gap])
                if not len(same):
                    break
                out.append(mix(mine[same] * np.uint64(0x9E3779B97F4A7C15) + mix(mine[same + gap]) + np.uint64(level + 1)))
    rare = s[:longest][(c[:longest] > 0) & (c[:longest] < frequent)]
    return np.unique(np.concatenate([rare, *out])) if out else rare


def similar_sets(params: JoinParams) -> PairTest:
    def sketch(x: bytes) -> np.ndarray:
        """How many shingles have each value of the leading 6 bits."""
        return np.bincount((np.frombuffer(x, np.uint64) >> np.uint64(58)).astype(np.int64), minlength=64)

    def near(one: np.ndarray, many: np.ndarray) -> np.ndarray:
        # sets with Jaccard similarity p differ in at most (1 - p) / (1 + p) of their summed sizes
        differ = np.abs(many - one).sum(axis=1)
        return differ * (100 + params.percent) <= (many.sum(axis=1) + one.sum()) * (100 - params.percent)

    def verify(a: list[bytes], b: list[bytes]) -> np.ndarray:
        out = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(a, b)):
            n, m = len(x) // 8, len(y) // 8
            if min(n, m) * 100 < max(n, m) * params.percent:
                continue
            both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
            both.sort(kind="stable")                            # two sorted runs
            shared = int((both[1:] == both[:-1]).sum())
            out[i] = 100 * shared >= params.percent * (n + m - shared)
        return out

    return PairTest(verify, sketch, near)


def index_documents(documents: DataFrame, maps: Broadcast[list[np.ndarray]], params: JoinParams, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, node (null: empty set), entries, and the set's shingles where it has entries."""
    kind = dict(documents.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = ShingleReader(params.k)
        for batch in batches:
            for a, b, h, before in reader.read(batch.column(1)):
                n = np.diff(before)
                classes = classes_of(h, maps.value, params)
                total = lambda x: np.add.reduceat(np.append(x, x.dtype.type(0)), before[:-1])
                node = mix(total(mix(h)) + mix(total(mix(h ^ np.uint64(0x5BF03635))) + n.astype(np.uint64))).view(np.int64)
                # a set whose prefix holds only shingles of its own has no entries
                open_ = np.flatnonzero((n > 0) & (np.add.reduceat(np.append(classes == 0, False).astype(np.int64), before[:-1])
                                                  < n - params.overlap(n) + 1))
                entries: list = [None] * (b - a)
                sets: list = [None] * (b - a)
                for i in open_:
                    own = slice(before[i], before[i + 1])
                    found = prefix_entries(h[own], classes[own], params)
                    if len(found):
                        entries[i], sets[i] = found.view(np.int64), h[own].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(node, pa.int64(), mask=n == 0),
                     pa.array(entries, pa.list_(pa.int64())), pa.array(sets, pa.binary())], ["id", "n_shingles", "node", "entries", "payload"])

    return documents.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(
        run, f"id {kind}, n_shingles long, node long, entries array<long>, payload binary")


def similar_documents(documents: DataFrame, params: JoinParams = JoinParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles and component_id (the smallest id reachable by links) of every row."""
    params = replace(params, classes=fitting_classes(documents, text_col, params.classes))
    maps = documents.sparkSession.sparkContext.broadcast(frequency_bitmaps(documents, params, text_col))     # at most the size in params
    index = materialize(index_documents(documents, maps, params, id_col, text_col), "shingle-index")
    maps.destroy()
    held = index.where(F.col("entries").isNotNull())
    postings = held.select("node", F.explode("entries").alias("sig")).distinct()
    payload = materialize(held.groupBy("node").agg(F.first("payload").alias("payload")), "shingle-sets")
    graph = similar_components(postings, payload, similar_sets(params), "shingles")
    names = index.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("least"))
    named = names.join(graph, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_node = named.select("node", "component").join(least, "component").select("node", "component_id")
    return index.join(of_node, "node", "left").select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("component_id", "id").alias("component_id"))


def join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: shingle-set size and near-duplicate component of every document."""
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
