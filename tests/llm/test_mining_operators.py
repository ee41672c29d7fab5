"""Phrase collocations, hard negatives and exact top-k search against brute force."""

import random
import re
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from retainx.llm import anchor_tree, collocations, impact_index
from retainx.llm.intvectors import integer_vectors, smallest_ids

VECTORS = "vec_id long, embedding array<float>, label int, score string, shard int"
SMALL_SEARCH = impact_index.ImpactParams(shard_rows=64, block_queries=16)
SMALL_MINING = anchor_tree.MiningParams(shard_rows=64, block_anchors=16)


# ---- phrases ----------------------------------------------------------------------------------

def phrases(rows, least, top=2000, dominance=80, longest=4):
    """The contract in plain Python over (text, lang)."""
    count, total = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", folded):
            words = [w for w in re.split("[ \t]+", piece) if w]
            total[lang] += len(words)
            for n in range(1, longest + 1):
                count.setdefault(lang, Counter()).update(tuple(words[i:i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in count.items():
        candidates = {p: n for p, n in f.items() if len(p) > 1 and n >= least}
        gone = {p[i:i + n] for p, many in candidates.items() for n in range(2, len(p)) for i in range(len(p) - n + 1)
                if 100 * many >= dominance * candidates[p[i:i + n]]}
        kept = []
        for p, a in candidates.items():
            if p not in gone:
                score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                kept.append((score, a, " ".join(p), left, right))
        kept.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i + 1, p, a, x, y, total[lang], s) for i, (s, a, p, x, y) in enumerate(kept[:top])]
    return sorted(out)


def texts():
    rng = random.Random(4)
    word = lambda: rng.choice("aa ab abc b\x01 ba é ω the THE the the of".split(" "))
    rows = [(rng.choice(" \t").join(word() for _ in range(rng.randrange(14))) + rng.choice([".", "\n", " ; aa ab abc ba", "\x0b", ""]),
             rng.choice(["en", "fr", None, "und"])) for _ in range(900)]
    return rows + [("the of the", "en")] * 300 + [(None, "en"), ("", None), ("...", "fr"), (" ".join(["the of aa"] * 4000), "de"), ("\x85nbsp\xa0x", "en")]


@pytest.mark.parametrize("least,range_rows", [(3, 5), (30, 20_000)])
def test_phrases_equal_brute_force(spark, least, range_rows):
    rows = texts()
    docs = spark.createDataFrame([(t, lang, 1, "x") for t, lang in rows], "text string, lang string, n int, phrase string").repartition(7)
    params = collocations.PhraseParams(least=least, range_rows=range_rows, top=50)
    assert sorted(tuple(r) for r in collocations.collocations(docs, params).collect()) == phrases(rows, least, 50)


def test_phrases_in_ranges_are_split_and_whole(spark):
    """Keys that one word begins reach over several ranges, and every phrase comes back with its beginnings."""
    rows = [("und", ["the"], 900)] + [("und", ["the", f"w{i:03}"], 40 + i % 7) for i in range(300)]
    stream = spark.createDataFrame([(lang, w, f, [], 0) for lang, w, f in rows], collocations.STREAM)
    out = collocations.merge_stream(stream, collocations.PhraseParams(range_rows=20)).collect()
    heads = [r for r in out if r.words == ["the"]]
    assert len(heads) == heads[0].ranges > 3 and max(r.beyond for r in heads) == 46
    assert all(r.before == [900] for r in out if len(r.words) == 2) and len(out) == 300 + len(heads)


def test_phrase_scores_pass_64_bits(spark):
    big = 1 << 62
    both = spark.createDataFrame([("en", ["b", "a"], big, [big], 0, 1, [big]), ("en", ["d", "c"], big, [big], big - 1, 1, [big + 5])],
                                 collocations.STREAM + ", ranges int, before array<long>")
    totals = spark.createDataFrame([("en", 9)], "lang string, n long")
    out = collocations._ranked(both, totals, collocations.PhraseParams()).collect()
    assert [(r.phrase, r.a, r.score) for r in out] == [("a b", big, 1_000_000)]


def test_no_phrases_in_empty_table(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(docs).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None), ("", "en")], docs.schema)).collect() == []


# ---- vectors ----------------------------------------------------------------------------------

def vectors(n=700, dim=8, seed=3):
    """Clusters, equal vectors under many ids, repeated rows and ids, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    x = (centres[rng.integers(0, 12, n)] + 0.05 * rng.standard_normal((n, dim))).astype(np.float32)
    x[200:320] = x[200]
    rows = [(i, [float(c) for c in v], int(rng.integers(0, 4)), "s", 1) for i, v in enumerate(x)]
    rows += rows[:60] + [(50, [1.0] * dim, 2, "t", 0), (51, [0.5] * dim, 2, "t", 0)]        # repeated rows, an id with two vectors
    bad = [None, [], [None] + [1.0] * (dim - 1), [float("nan")] * dim, [float("inf")] * dim, [1.0] * (dim + 1), [0.0] * dim]
    rows += [(1000 + 50 * i, v, 1, None, None) for i, v in enumerate(bad)] + [(None, [1.0] * dim, 1, "", 0), (2000, [1.0] * dim, None, "", 0)]
    return rows


def integers(rows, dim=8, labelled=False):
    out = {(i, tuple(int(np.floor(256 * np.float64(np.float32(c)))) for c in v), label if labelled else None) for i, v, label, *_ in rows
           if i is not None and v and len(v) == dim and all(c is not None and np.isfinite(c) for c in v) and not (labelled and label is None)}
    return sorted(out)


def product(a, b):
    return sum(x * y for x, y in zip(a, b))


def nearest(rows, k=5):
    out = []
    for i, v, _ in rows:
        if i % 50 == 0:
            found = sorted((-product(v, w), j) for j, w, _ in rows if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


def negatives(rows, params=SMALL_MINING):
    out = []
    for i, v, label in rows:
        if i % 50:
            continue
        scored = sorted((-product(v, w), j, other) for j, w, other in rows if j != i)
        for s, j, _ in [r for r in scored if r[2] == label][:params.positives]:
            low, high = -s * params.low_percent, -s * params.high_percent
            inside = [(i, j, -t, m, -s) for t, m, other in scored if other != label and low <= -100 * t <= high][:params.negatives]
            out += [(a, p, n + 1, m, ps, t) for n, (a, p, t, m, ps) in enumerate(inside)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, VECTORS).repartition(5)


@pytest.mark.parametrize("seed,params", [(3, SMALL_SEARCH), (4, impact_index.ImpactParams()),
                                         (5, replace(SMALL_SEARCH, levels=3, step=1 / 3, few=0.0))])
def test_topk_equals_brute_force(spark, seed, params):
    rows = vectors(seed=seed)
    got = impact_index.search(frame(spark, rows), F.col("vec_id") % 50 == 0, params).collect()
    assert sorted(tuple(r) for r in got) == nearest(integers(rows))


@pytest.mark.parametrize("seed,params", [(3, SMALL_MINING), (4, anchor_tree.MiningParams()),
                                         (5, replace(SMALL_MINING, positives=2, negatives=7, low_percent=-20, high_percent=101))])
def test_negatives_equal_brute_force(spark, seed, params):
    rows = vectors(seed=seed)
    got = anchor_tree.mine(frame(spark, rows), F.col("vec_id") % 50 == 0, params).collect()
    assert sorted(tuple(r) for r in got) == negatives(integers(rows, labelled=True), params)


def test_few_and_no_vectors(spark):
    none = spark.createDataFrame([], VECTORS)
    asked = F.col("vec_id") % 50 == 0
    assert impact_index.search(none, asked).collect() == [] and anchor_tree.mine(none, asked).collect() == []
    three = frame(spark, [(i, [1.0, 2.0], 1, "", 0) for i in (0, 50, 7)])
    assert sorted(tuple(r)[:3] for r in impact_index.search(three, asked).collect()) == [(0, 1, 7), (0, 2, 50), (50, 1, 0), (50, 2, 7)]
    assert anchor_tree.mine(three, asked).collect() == []
    assert impact_index.search(three, F.col("vec_id") < 0).collect() == [] and anchor_tree.mine(three, F.col("vec_id") < 0).collect() == []


def test_scores_are_exact_or_refused(spark):
    """Beyond 53 bits the products are whole-number ones; beyond 64 the rows are refused."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.integers(-900_000, 900_000, 4)], i % 2, "", 0) for i in range(120)]
    rows = [(i, [float(np.float32(c)) for c in v], *more) for i, v, *more in rows]
    whole = integers(rows, dim=4, labelled=True)
    asked = F.col("vec_id") % 50 == 0
    assert max(abs(s) for *_, s in nearest(whole)) > 2 ** 53
    assert sorted(tuple(r) for r in impact_index.search(frame(spark, rows), asked, SMALL_SEARCH).collect()) == nearest(whole)
    assert sorted(tuple(r) for r in anchor_tree.mine(frame(spark, rows), asked, SMALL_MINING).collect()) == negatives(whole)
    with pytest.raises(Exception, match="past 64 bits"):
        impact_index.search(frame(spark, [(1, [1e9] * 4, 1, "", 0)]), asked).collect()


def test_equal_vectors_are_held_a_few_times(spark):
    rows, dim = integer_vectors(frame(spark, [(i, [1.0, 2.0], 1, "", 0) for i in range(3000)] * 2), "vec_id", "embedding")
    kept = smallest_ids(rows, 6)
    assert dim == 2 and sorted(r.id for r in kept.collect()) == list(range(6))


def test_bounds_spare_most_rescoring(spark):
    """On clustered anchors the tree's bounds, and the impacts read, leave few candidates to rescore."""
    import pyarrow as pa
    rng = np.random.default_rng(8)
    centres = 4 * rng.standard_normal((40, 16))
    x = np.floor(256 * (centres[rng.integers(0, 40, 4000)] + 0.01 * rng.standard_normal((4000, 16)))).astype(np.int32)
    packed = [r.tobytes() for r in x]
    anchors = spark.createDataFrame([(i, packed[i], 0) for i in range(0, 4000, 20)], "id long, packed binary, label long")
    tree = pa.Table.from_pandas(anchor_tree.spanning_trees(anchors, 16, anchor_tree.MiningParams()).toPandas()).sort_by("place")
    shard = pa.table({"id": pa.array(range(4000)), "label": pa.array([0] * 4000), "packed": pa.array(packed, pa.binary())})
    walk = anchor_tree.Walk(shard, tree, 16)
    assert len({r for r, *_ in anchor_tree._positives(walk, anchor_tree.MiningParams())}) == 200
    assert walk.rescored < 0.3 * 4000 * 200
