"""Similarity joins and the pipeline against brute force, on both ways through small and large groups."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from retainx.llm import line_dedup, ngram_join, similarity

from test_text_operators import DOCS, edge_rows

SF = "/root/testdata/sf0.001"


class Union:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def fold(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()


def shingles(text, k=5):
    words = fold(text)
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def near_components(texts, percent=80):
    """id -> (size, smallest linked id) by counting the shared shingles of all pairs."""
    sets = {k: shingles(t) for k, t in texts.items()}
    union, inverted = Union(sets), {}
    for k, s in sets.items():
        shared = Counter(o for x in s for o in inverted.get(x, ()))
        for o, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                union.join(k, o)
        for x in s:
            inverted.setdefault(x, []).append(k)
    return {k: (len(s), union.find(k)) for k, s in sets.items()}


def near_copies(n=260, seed=5):
    """A family of near copies around the threshold, texts that share a long passage, chains and small sets."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    base, passage = [word() for _ in range(60)], [word() for _ in range(70)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = word()
        out.append(w)
    out += [passage + [word() for _ in range(rng.randint(0, 25))] for _ in range(n)]
    chain = [word() for _ in range(40)]
    for _ in range(30):
        chain = chain[1:] + [word()]
        out.append(chain)
    out += [[word() for _ in range(rng.randint(1, 7))] for _ in range(40)] + [["a", "b"], ["A", "b"], ["a", "b", "c", "d", "e"], ["a"] * 30, ["a"] * 9]
    rng.shuffle(out)
    return {i: " ".join(w) for i, w in enumerate(out)}


@pytest.mark.parametrize("small,classes", [(24, ((2, 27), (8, 25), (64, 23))), (2, ((2, 20), (3, 20), (4, 20))), (3, ((2, 16), (5, 16), (20, 16)))])
def test_near_duplicates_against_brute_force(spark, monkeypatch, small, classes):
    monkeypatch.setattr(similarity, "SMALL_GROUP", small)
    monkeypatch.setattr(similarity, "BLOCK_NODES", 50)
    texts = near_copies()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = ngram_join.similar_documents(docs, ngram_join.JoinParams(classes=classes)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_components(texts)


def test_near_duplicates_of_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join_query(spark, SF).collect()}
    assert got == near_components(texts)


def test_near_duplicate_edges(spark):
    docs = spark.createDataFrame(edge_rows(), DOCS).withColumn("node", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(docs).collect()}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[7] == (0, 7) and got[4] == got[5] == (1, 4) and got[3][0] == 997
    assert got[None] == (1, None)
    assert ngram_join.similar_documents(docs).count() == len(edge_rows())
    assert ngram_join.similar_documents(docs.limit(0)).collect() == []


def test_similar_pairs_always_share_an_entry():
    import numpy as np
    rng = np.random.default_rng(2)
    params = ngram_join.JoinParams()
    for _ in range(400):
        n = int(rng.integers(1, 120))
        universe = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        kinds = rng.choice([0, 1, 3], 300, p=[0.05, 0.25, 0.7]).astype(np.int8)
        kinds[kinds == 0] = 1                                  # shared shingles have at least two holders
        x = rng.choice(300, n, replace=False)
        y = np.unique(np.concatenate([rng.permutation(x)[:max(1, n - int(rng.integers(0, n // 8 + 2)))], rng.choice(300, int(rng.integers(0, n // 8 + 1)))]))
        both = len(np.intersect1d(x, y))
        if set(x) != set(y) and 100 * both >= 80 * (len(set(x)) + len(y) - both):      # equal sets are one node
            e = [ngram_join.prefix_entries(universe[s], kinds[s], params) for s in (x, y)]
            assert len(np.intersect1d(*e))


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 50)] + [(1000, 2000 + i) for i in range(100)] + [(rng.randrange(5000, 5200), rng.randrange(5000, 5200)) for _ in range(150)]
    union = Union({n for e in edges for n in e})
    for a, b in edges:
        union.join(a, b)
    got = {r.node: r.component for r in similarity.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: union.find(n) for n in union.up if n in got}
    assert set(got) == {n for a, b in edges if a != b for n in (a, b)}
    assert similarity.components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- 9: lines ---------------------------------------------------------------------------------------------------

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, edits, alphabet):
    out = list(text)
    for _ in range(edits):
        kind = rng.random()
        if kind < 0.35 and out:
            del out[rng.randrange(len(out))]
        elif kind < 0.7:
            out.insert(rng.randint(0, len(out)), rng.choice(alphabet))
        elif out:
            out[rng.randrange(len(out))] = rng.choice(alphabet)
    return "".join(out)


def test_banded_distance_against_the_full_table():
    rng = random.Random(1)
    for t in (1, 2, 3):
        a = ["".join(rng.choice("abé𝒳") for _ in range(rng.randint(0, 30))) for _ in range(1500)]
        b = [edited(rng, x, rng.randint(0, t + 2), "abé𝒳") for x in a]
        assert line_dedup.within_edits(a, b, t).tolist() == [distance(x, y) <= t for x, y in zip(a, b)]


def test_similar_lines_always_share_a_probe():
    import pyarrow as pa
    rng, params = random.Random(2), line_dedup.LineParams()
    lines = []
    for _ in range(1500):
        a = "".join(rng.choice("abcdefé𝒳 ") for _ in range(rng.randint(20, 45)))
        b = edited(rng, a, 2, "abcé")
        if len(b) >= params.min_chars:
            lines += [a, b]
    reader = line_dedup.LineReader(params)
    found = {}
    for block in reader.read(pa.array(["\n".join(lines[i:i + 10]) for i in range(0, len(lines), 10)])):
        own = [bytes(block.data[s:e]).decode() for s, e in zip(block.start, block.end)]
        for line, h in zip(*reader.probes(block, block.distinct(params.min_chars))):
            found.setdefault(own[line], set()).add(int(h))
    assert all(found[a] & found[b] for a, b in zip(lines[::2], lines[1::2]))
    assert max(len(v) for v in found.values()) == 12


def test_lines_of_a_block_are_those_of_a_split():
    import numpy as np
    import pyarrow as pa
    texts = ["", "\n", "a\nb", "é\n\n𝒳y\n", None, "x", "\nz"]
    block, = line_dedup.LineReader(line_dedup.LineParams()).read(pa.array(texts))
    row = np.repeat(np.arange(len(texts)), block.count)
    got = [[bytes(block.data[s:e]).decode() for r, s, e in zip(row, block.start, block.end) if r == i] for i in range(len(texts))]
    assert got == [(t or "").split("\n") for t in texts]
    assert block.chars.tolist() == [len(x) for own in got for x in own]


def dedup_lines_brute(docs, params):
    """(id, text) -> remaining lines."""
    first, at = {}, {}
    for k, text in sorted(set(docs), key=lambda d: d[0]):
        for i, line in enumerate(text.split("\n")):
            if len(line) >= params.min_chars or line.strip(" \t\n\x0b\x0c\r"):
                first.setdefault(line, (k, i))
    union = Union(first)
    lines = sorted((x for x in first if len(x) >= params.min_chars), key=len)         # shorter ones only if equal
    for i, a in enumerate(lines):
        for b in lines[i + 1:]:
            if len(b) > len(a) + params.threshold:
                break
            if line_dedup.within_edits([a], [b], params.threshold)[0]:
                union.join(a, b)
    for line in first:
        root = union.find(line)
        at[root] = min(at.get(root, first[line]), first[line])
    return {(k, text): [x for i, x in enumerate(text.split("\n")) if x not in first or at[union.find(x)] == (k, i)] for k, text in docs}


@pytest.mark.parametrize("small", [24, 2])
def test_line_dedup_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(similarity, "SMALL_GROUP", small)
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    common = [text(rng.randint(18, 40)) for _ in range(6)]
    docs = []
    for k in range(120):
        lines = [edited(rng, rng.choice(common), rng.randint(0, 3), "abé") if rng.random() < 0.5 else text(rng.randint(0, 60)) for _ in range(rng.randint(1, 6))]
        docs.append((k, "\n".join(lines)))
    params = line_dedup.LineParams()
    want = dedup_lines_brute(docs, params)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for r in line_dedup.dedup_lines(df, params).collect():
        source = dict(docs)[r.doc_id]
        assert r.text == "\n".join(want[r.doc_id, source])
        assert (r._lines, r._removed) == (source.count("\n") + 1, source.count("\n") + 1 - len(want[r.doc_id, source]))


def test_line_query_digest(spark):
    rows = {r.doc_id: r for r in line_dedup.lines_query(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for r in line_dedup.dedup_lines(docs).collect():
        assert rows[r.doc_id].text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() and rows[r.doc_id].n_chars == len(r.text or "")


def test_line_dedup_edges(spark):
    docs = spark.createDataFrame(edge_rows(), DOCS).withColumn("_lines", F.lit("clash")).withColumn("row", F.lit(1))
    got = line_dedup.dedup_lines(docs).collect()
    assert len(got) == len(edge_rows())
    by = {r.doc_id: r for r in got}
    assert by[1].text is None and by[1]._lines == 0 and by[2].text == "" and by[7].text == "  \n\t " and by[3]._removed == 0 and by[3].row == 1
    assert line_dedup.dedup_lines(docs.limit(0)).collect() == []


def test_short_lines_are_copies_if_equal(spark):
    long = "a line that is long enough"
    docs = [(1, f"Les.\n\n{long}\nab\n  "), (2, f"Les.\n\nac\n{long}!\n  "), (3, "Les."), (4, "é\nab\né\nLet.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.text, r._removed) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: (docs[0][1], 0), 2: ("\nac\n  ", 2), 3: ("", 1), 4: ("é\nLet.", 2)}


def test_no_exact_copy_of_a_line_is_left(spark):
    texts = [r.text or "" for r in line_dedup.dedup_lines(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")).collect()]
    lines = [x for t in texts for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    assert len(lines) == len(set(lines)) > 1000
