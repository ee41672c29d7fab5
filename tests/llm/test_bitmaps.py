"""Counts of marks: what is single stays unmarked in large tables, what repeats is always found."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from retainx.llm import bitmaps, line_dedup, ngram_join
from retainx.llm.textnp import mix


def test_single_probes_and_shingles_are_not_marked(spark):
    """Some of so many share 32 bits of their hashes (4 or 5 pairs are expected of each kind)."""
    rng = random.Random(11)
    word = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    lines = [(i, "\n".join(word(40) for _ in range(500))) for i in range(36)]
    docs = spark.createDataFrame(lines, "id long, text string").repartition(4)
    assert not line_dedup.shared_probes(docs, line_dedup.LineParams(bitmap_bits=20)).any()
    texts = spark.createDataFrame([(i, " ".join(word(7) for _ in range(5000))) for i in range(42)], "id long, text string").repartition(4)
    maps = ngram_join.frequency_bitmaps(texts, ngram_join.JoinParams(classes=((2, 20), (8, 20), (64, 20))), "text")
    assert not any(m.any() for m in maps)


@pytest.mark.parametrize("width,two", [(16, False), (16, True), (19, True), (27, True), (29, False)])
def test_repeated_marks_are_found(spark, width, two):
    rows = spark.range(0, 6000, numPartitions=5)
    hashes = lambda n: mix((n % 2000).astype(np.uint64) + np.uint64(1))
    plain = lambda b: iter([hashes(b.column(0).to_numpy())])
    owned = lambda b: iter([(hashes(n := b.column(0).to_numpy()), (n % 2).astype(np.uint64))])
    many = lambda b: iter([(hashes(n := b.column(0).to_numpy()), n.astype(np.uint64))])

    marks, others = hashes(np.arange(2000)), mix(np.arange(1 << 14, dtype=np.uint64) + np.uint64(1 << 40))
    found = bitmaps.repeated_marks(rows, plain, ((3, width),), two)[0]
    assert bitmaps.is_marked(found, width, marks, two).all()
    assert bitmaps.is_marked(found, width, others, two).mean() < 0.1
    assert not bitmaps.repeated_marks(rows, plain, ((4, width),), two)[0].any()
    # each number comes three times, by one owner or by three
    assert not bitmaps.repeated_marks(rows, owned, ((2, width),), two)[0].any()
    assert (bitmaps.repeated_marks(rows, many, ((3, width),), two)[0] == found).all()


def test_bitmaps_follow_the_texts(spark):
    small = spark.createDataFrame([("x" * 1000,)] * 3, "text string")
    assert bitmaps.fitting_classes(small, "text", ((2, 29), (8, 25), (64, 23))) == ((2, 19), (8, 19), (64, 19))
    assert bitmaps.fitting_classes(small.limit(0), "text", ((2, 16),)) == ((2, 16),)


def test_shingle_bitmaps_grow_with_large_tables(spark):
    """8 GB of text get four times the bits that half a GB gets, so that they do not fill up."""
    texts = lambda n: spark.range(0, n, numPartitions=8).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    classes = ngram_join.JoinParams().classes
    assert bitmaps.fitting_classes(texts(512), "text", classes) == ((2, 27), (8, 23), (64, 21))
    assert bitmaps.fitting_classes(texts(8192), "text", classes) == ((2, 29), (8, 25), (64, 23))
