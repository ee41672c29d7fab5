"""Classifiers by held-out accuracy, neighbours by recall, packing by an exact round trip."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from retainx.llm import language_id, packing, prefix_forest, quality, textnp

from test_text_operators import DOCS, edge_rows

SF = "/root/testdata/sf0.01"


# --- text features ----------------------------------------------------------------------------------------------

def test_features_of_a_text_do_not_depend_on_its_batch():
    texts = ["", "a", "Hello wörld hello", "x" * 5000, None, "ab cd " * 400, "the the"]
    f = textnp.TextFeatures((2, 3, 4), 10, words=True)
    table = np.random.default_rng(0).standard_normal((f.slots, 1 << 10, 2)).astype(np.float32)
    whole, n = f.sums(*textnp.utf8(pa.array(texts)), table)
    for i, t in enumerate(texts):
        one, m = f.sums(*textnp.utf8(pa.array([t])), table)
        assert m[0] == n[i] and np.allclose(one[0], whole[i])
        if t and len(t) >= 4:
            ids, share = f.bag(t.encode())
            assert np.allclose(table.reshape(-1, 2)[ids].T @ share, whole[i] / n[i], atol=1e-5)


def test_very_long_text_is_read_in_pieces(monkeypatch):
    monkeypatch.setattr(textnp, "CHUNK_BYTES", 64)
    f = textnp.TextFeatures((2, 4), 8)
    table = np.random.default_rng(0).standard_normal((2, 256, 1)).astype(np.float32)
    text = "some rather long text without an end " * 40
    got, n = f.sums(*textnp.utf8(pa.array(["x y", text, "z"])), table)
    data = text.encode()
    assert n[1] == len(data) - 1 + len(data) - 3
    ids, share = f.bag(data)
    assert np.allclose(got[1], share @ table.reshape(-1, 1)[ids] * n[1], atol=1e-3)


def test_word_hashes_fold_case_and_split_at_ascii_space():
    h = textnp.WordHasher()
    data, offsets = textnp.utf8(pa.array(["The cat\tthe\x0bCAT", "", "cat", " the "]))
    words, _, before = h.words(data, offsets)
    assert before.tolist() == [0, 4, 4, 5, 6]
    assert words[0] == words[2] == words[5] and words[1] == words[3] == words[4] and words[0] != words[1]


# --- 3: language ------------------------------------------------------------------------------------------------

def test_language_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = language_id.language_query(spark, SF).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.95


def test_language_ignores_everything_but_text(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = language_id.fit(language_id.training_rows(docs, language_id.LanguageParams(), fold != 1))
    assert model.families == (("de", "en"), ("es", "fr")) and model.pairs == (("de", "en"), ("es", "fr"))
    one = language_id.predict_languages(docs, model)
    two = language_id.predict_languages(docs.withColumn("lang", F.lit("en")).withColumn("source", F.lit(None)), model)
    assert sorted(one.collect()) == sorted(two.collect())


def test_language_edges(spark):
    rows = edge_rows()
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))
    model = language_id.fit([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr")])
    got = language_id.predict_languages(docs, model, keep=("doc_id", "score")).collect()
    assert len(got) == len(rows) and got[0].score == "clash"
    assert sorted(r.lang_pred for r in got if r.doc_id in (1, 2, 7)) == ["und"] * 3
    assert all(r.lang_pred != "und" for r in got if r.doc_id in (3, 4, 5, 8, None))
    assert all(r.lang_pred == "und" for r in language_id.predict_languages(docs, language_id.fit([])).collect())
    assert language_id.predict_languages(docs.limit(0), model).collect() == []
    assert language_id.training_rows(docs.limit(0), language_id.LanguageParams()) == []


def test_training_sample_is_bounded(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_id.training_rows(docs, language_id.LanguageParams(max_per_language=20))
    assert {lang: sum(y == lang for _, y in rows) for lang in ("de", "en", "es", "fr")} == dict.fromkeys(("de", "en", "es", "fr"), 20)


# --- 10: quality ------------------------------------------------------------------------------------------------

def test_quality_held_out_accuracy(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = quality.quality_query(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.9


def test_quality_edges(spark):
    docs, params = spark.createDataFrame(edge_rows(), DOCS), quality.QualityParams()
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 0), (99, 1), (None, 1), (8, None)], "doc_id long, quality int")
    rows = quality.training_rows(docs, labels, params)
    assert sorted(y for _, y in rows) == [0, 1]
    got = quality.score_documents(docs, quality.fit(rows, params)).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (1, 2)}) == 1            # null and empty: the bias alone
    assert {r.score for r in quality.score_documents(docs, quality.fit([], params)).collect()} == {0.5}
    assert quality.score_documents(docs.limit(0), quality.fit([], params)).collect() == []


# --- 2: neighbours ----------------------------------------------------------------------------------------------

def brute(ids, x, own, k=20):
    score = x @ x[own]
    order = [i for i in np.lexsort((ids, -score)) if i != own][:k]
    return [(int(ids[i]), float(score[i])) for i in order]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_against_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows])
    got = {}
    for r in prefix_forest.neighbours_query(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for own in np.flatnonzero(ids % 20 == 0):
        near = sorted(got[int(ids[own])])
        assert [n[0] for n in near] == list(range(1, 21)) and [n[2] for n in near] == sorted((n[2] for n in near), reverse=True)
        want = dict(brute(ids, x, own))
        assert all(abs(n[2] - want[n[1]]) < 1e-12 for n in near if n[1] in want)
        hits += sum(n[1] in want for n in near)
        total += 20
    assert hits / total >= 0.9


def test_neighbours_with_copies_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 8)).astype(np.float32)
    rows = [(i, base[i % 60 if i % 3 else 0].tolist()) for i in range(300)]             # one vector holds a third of all rows
    bad = [(300, None), (320, [0.0] * 8), (340, [float("nan")] + [1.0] * 7), (360, [None] + [1.0] * 7), (380, [float("inf")] * 8),
           (400, [1.0] * 3), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + bad + rows[:1], "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = {}
    for r in prefix_forest.search(df, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    assert sorted(got) == list(range(0, 300, 20))
    for q, near in got.items():
        exact = (x * x[q]).sum(axis=1)
        want = [i for i in np.lexsort((ids, -exact)) if i != q][:20]
        assert [n[1] for n in sorted(near)] == [int(ids[i]) for i in want]
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = prefix_forest.search(few, F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(1, 2, 1.0), (2, 1, 0.0)]
    assert prefix_forest.search(few.limit(0), F.lit(True)).collect() == []


def test_recall_does_not_fall_with_the_table(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((20000, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    asked = F.col("vec_id") % 10 == 0
    x = x.astype(float)
    for params in (prefix_forest.ForestParams(trees=24, symbol_bits=4, symbols=6, block=64),
                   prefix_forest.ForestParams(trees=2, symbol_bits=7, block=64)):    # too few trees for any prefix
        got = {}
        for r in prefix_forest.search(df, asked, params).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        assert sorted(got) == list(range(0, 20000, 10)) and all(len(v) == 20 for v in got.values())
        hits = sum(len(got[q] & {i for i, _ in brute(np.arange(20000), x, q)}) for q in range(0, 20000, 200))
        assert hits / (20 * 100) >= 0.9


def test_share_of_entries_compared_falls(spark):
    """More entries: neighbours are closer, prefixes longer, and a query meets a smaller share of the table."""
    rng, share = np.random.default_rng(6), []
    for n in (2000, 40000):
        x = rng.standard_normal((n, 16))
        x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
        asked = F.col("vec_id") % (n // 100) == 0
        got, compared = {}, {}
        for r in prefix_forest.search(df, asked, prefix_forest.ForestParams(trees=32)).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
            compared[r.query_id] = r.compared
        hits = sum(len(got[q] & {i for i, _ in brute(np.arange(n), x.astype(float), q)}) for q in got)
        assert len(got) == 100 and hits / 2000 >= 0.9 and len(set(compared.values())) > 1       # each query ascends as far as it needs
        share.append(np.mean(list(compared.values())) / n)
    assert share[1] < 0.3 and share[1] < share[0] / 2


def test_exact_search_compares_all_entries_once(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((500, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    rows = prefix_forest.search(df, F.col("vec_id") % 20 == 0, prefix_forest.ForestParams(exact=True)).collect()
    got = {q: [r.vec_id for r in sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)] for q in range(0, 500, 20)}
    assert got == {q: [i for i, _ in brute(np.arange(500), x.astype(float), q)] for q in got} and {r.compared for r in rows} == {500}


def test_ascent_follows_the_sorted_strings():
    rng = np.random.default_rng(8)
    keys = rng.integers(0, 1 << 20, (3, 400)).astype(np.int64) << 43
    counts = np.stack([np.bincount(k >> 55, minlength=256) for k in keys])
    top = prefix_forest.ForestTop(counts, 8)
    asked = keys[:, :50]
    held = top.held(asked)
    for level in range(9):
        low, high = prefix_forest._prefix_range(asked, level)
        want = sum(((keys[t][None, :] >= low[t][:, None]) & (keys[t][None, :] <= high[t][:, None])).sum(axis=1) for t in range(3))
        assert (held[level] == want).all()
    for enough in (1, 40, 900, 10 ** 9):
        bits = top.ascent(asked, enough)
        for q, b in enumerate(bits):
            assert (held[b, q] >= enough or b == 0) and (b == 8 or held[b + 1, q] < enough)
    a, b = keys[0][:100], keys[1][:100]
    assert prefix_forest._common_bits(a, b, 8).tolist() == [next((i for i in range(8) if (int(x) ^ int(y)) >> (62 - i) & 1), 8) for x, y in zip(a, b)]


# --- 8: packing -------------------------------------------------------------------------------------------------

def test_tournament_tree_is_first_fit():
    rng = np.random.default_rng(0)
    for _ in range(50):
        lengths = sorted(rng.integers(1, 101, rng.integers(1, 80)).tolist(), reverse=True)
        bins = []
        for n, (b, offset) in zip(lengths, packing.first_fit_decreasing(lengths, 100)):
            want = next((i for i, used in enumerate(bins) if used + n <= 100), len(bins))
            if want == len(bins):
                bins.append(0)
            assert (b, offset) == (want, bins[want])
            bins[want] += n


TRICKY = ["", "  ", "Don't STOP, it's 1,000.5 a.b, c..", "ΣΑΣ ΟΔΟΣ, İstanbul", "Ångstrom été ﬁ", "x<|endoftext|>y <|ENDOFTEXT|>", "a\x1cb\xa0c　d e",
          "日本語 テキスト, äöü, ÄÖÜ. ß ẞ", "naïve…, \x00\x01 foo\tbar\r\nbaz\x0bq\x85z", "𝒳 𝕏 🙂, x🙂.", "ª º Ⅷ ²", "ǅ ŉ, ΐ", "́a ,. ,a .b", "Word, word. WORD,"]


def test_word_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer
    path = packing.public_tokenizer()
    whole, small = Tokenizer.from_file(path), packing.WordEncoder(path, 3)
    for _ in range(2):
        for t in TRICKY:
            assert small.encode([t.encode()])[0].tolist() == whole.encode(t, add_special_tokens=False).ids, t
    together = small.encode([t.encode() for t in TRICKY])
    assert [x.tolist() for x in together] == [whole.encode(t, add_special_tokens=False).ids for t in TRICKY]


def check_packing(rows, texts):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(packing.public_tokenizer())
    ids = {k: whole.encode(t or "", add_special_tokens=False).ids + [2] for k, t in texts.items()}
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    assert pieces.keys() == ids.keys()
    for k, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[k])
            assert r.ids_crc32 == zlib.crc32(np.array(ids[k][at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids[k])
    pad = total = 0
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        total += at
        pad += 0 if at & (at - 1) == 0 else 4096 - at
    return pad / (pad + total)


def test_packing_round_trip(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert check_packing(packing.packing_query(spark, SF).collect(), texts) < 0.01


def test_packing_edges(spark):
    rows = [r for r in dict.fromkeys(edge_rows()) if r[0] is not None] + [(50, TRICKY[2] * 900, "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("start", F.lit("clash"))
    params = packing.PackParams(packing.public_tokenizer(), group_pieces=4)
    packed = packing.pack_documents(docs, params).withColumn("ids_crc32", F.crc32("ids"))
    check_packing(packed.collect(), {r[0]: r[1] for r in rows})
    again = packing.pack_documents(spark.createDataFrame(edge_rows(), DOCS), params).collect()
    assert sum(r.doc_id == 5 for r in again) == 2 and sum(r.doc_id is None for r in again) == 1
    assert packing.pack_documents(docs.limit(0), params).collect() == []
