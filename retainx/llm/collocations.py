"""Phrase collocations: counts of word sequences, merged in prefix and in suffix order.

Texts (A-Z folded) fall into pieces at punctuation and line ends, pieces into words
at blanks and tabs. A phrase is up to ``max_words`` neighbouring words of one piece;
all of its occurrences count, by language. Phrases that occur ``least`` times or
more, longer than a word, are candidates. Cutting one in two gives the counts l and
r of its parts and the score floor(2,000,000 * a / (l + r)); the cut with the lowest
score stands for it. A candidate goes if a longer candidate that holds it occurs
at least ``dominance`` percent as often. (Of such longer ones the words between
occur as often at least, so that phrases of one more word tell.)

Counting goes order by order: every part of a frequent phrase is frequent, so
pairs are counted only of frequent words and longer phrases only of frequent
pairs. Tasks know these by bitmaps of hashes, sized by the number of marks up to
``max_filter_bits``; a false mark costs a count, never a result, since the counts
themselves are by the phrase.

The frequent phrases of all orders are then one stream of counts. Sorted in prefix
order (by first word, second word, ...) a phrase follows its own beginnings, so one
pass with a path of at most ``max_words`` phrases, as a lockstep merge of the
orders' streams, gives each phrase its left counts and each beginning its
strongest extension to the right. The result, sorted in suffix order (by last word,
the word before, ...), gives the right counts and the extensions to the left in the
same way. No table of phrases is held and none is looked up by hash. The stream
is cut into ranges of keys at sampled bounds; a phrase whose extensions reach into
further ranges goes to each of them, and its largest extension is taken over
them, so that a word with very many extensions is no task's burden.

Defined cases: a null text is empty, a null language ``und`` (one with documents so
labelled); empty texts and tables give no rows; repeated rows count each; a very long text is
worked through in slices of its pieces; ties in rank go to the larger count, then
the phrase in order of its bytes; columns beside text and language are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retainx.llm.scratch import materialize, shuffle_partitions
from retainx.llm.textnp import WordHasher, mix, utf8

UNDETERMINED = "und"
#: Stands for the sum over all words among the counts of words: no word is empty.
ALL = ""
PIECE_END = "[.,;:!?\n\x0b\x0c\r]"
BLANKS = "[ \t]+"
#: Text that is counted at once within a task (a longer single piece is its own slice).
SLICE_BYTES = 3 << 20
_STEP = np.uint64(0x9FB21C651E98DF25)


@dataclass(frozen=True)
class PhraseParams:
    least: int = 30
    max_words: int = 4
    dominance: int = 80                 # percent
    top: int = 2000                     # for each language
    scale: int = 2_000_000
    max_filter_bits: int = 30           # 128 MB
    range_rows: int = 20_000            # phrases of one key range
    samples: int = 16                   # for each range bound, to the driver


def _hashes(words: pa.Array, hasher: WordHasher) -> np.ndarray:
    data, offsets = utf8(words)
    return hasher.span(hasher.prefix(data), offsets[:-1], offsets[1:])


def _next(hashes: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase one word longer."""
    return mix(hashes * _STEP + word)


class Marks:
    """A bitmap of the hashes of phrases."""

    def __init__(self, bits: int, bitmap: np.ndarray) -> None:
        self.bits, self.bitmap = bits, bitmap

    @staticmethod
    def of(phrases: DataFrame, params: PhraseParams) -> Marks:
        """The phrases (lang, phrase) as marks; 16 bits for each as long as the bound allows."""
        rows = phrases.count()
        bits = min(params.max_filter_bits, max(15, (16 * rows).bit_length()))

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher = WordHasher()
            for b in batches:
                if not b.num_rows:
                    continue
                lists = pc.split_pattern(b.column(1), " ")
                words, of = _hashes(lists.flatten(), hasher), np.asarray(pc.list_parent_indices(lists))
                first = np.searchsorted(of, np.arange(b.num_rows))
                length = np.diff(np.append(first, len(of)))
                h = _next(_hashes(b.column(0), hasher), words[first])
                for i in range(1, int(length.max(initial=1))):
                    more = length > i
                    h[more] = _next(h[more], words[first[more] + i])
                at = (h >> np.uint64(64 - bits)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((at >> 15).astype(np.int32)), pa.array(at & 32767)], ["part", "bit"])

        found = phrases.select("lang", "phrase").mapInArrow(places, "part int, bit long") \
            .groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
        bitmap = np.zeros(1 << (bits - 3), np.uint8)
        for r in found.toLocalIterator():                              # 4 KB a part: together the bitmap
            bitmap[r.part << 12:(r.part + 1) << 12] = np.frombuffer(bytes(r.bitmap), np.uint8)
        return Marks(bits, bitmap)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(languages, pieces) of a batch (lang, text), some megabytes at a time."""
    text = pc.ascii_lower(batch.column(1).cast(pa.large_string()).fill_null(""))
    for row in range(0, batch.num_rows, 256):
        part = pc.split_pattern_regex(text.slice(row, 256), PIECE_END)
        pieces = part.flatten()
        langs = batch.column(0).slice(row, 256).take(pc.list_parent_indices(part))
        before = np.concatenate([[0], np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False))])
        a = 0
        while a < len(pieces):
            b = max(a + 1, int(np.searchsorted(before, before[a] + SLICE_BYTES, side="right")) - 1)
            yield langs.slice(a, b - a), pieces.slice(a, b - a)
            a = b


def _counted(langs: pa.Array, pieces: pa.Array, orders: range, marks: Marks | None, hasher: WordHasher) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, n) of the slice's phrases of these orders, all of whose words, or pairs of words, are marked."""
    lists = pc.split_pattern_regex(pieces, BLANKS)
    flat, piece = lists.flatten(), np.asarray(pc.list_parent_indices(lists))
    full = pc.greater(pc.binary_length(flat), 0)
    coded = flat.filter(full).dictionary_encode()
    piece = piece[full.to_numpy(zero_copy_only=False)]
    if not len(coded):
        return
    word, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    lang_coded = langs.dictionary_encode()
    lang, names = lang_coded.indices.to_numpy()[piece].astype(np.int64), lang_coded.dictionary
    wide = np.int64(len(words))
    # for each order, the phrase that starts at each word: a number, its hash, and whether it is within a piece and marked
    number, ok = lang * wide + word, np.ones(len(word), bool)
    if orders.start == 1:
        total = np.bincount(lang, minlength=len(names))
        yield pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.array([ALL] * len(names)), pa.array(total.astype(np.int64))], ["lang", "phrase", "n"])
    if marks is not None:
        word_hash, lang_hash = _hashes(words, hasher), _hashes(names, hasher)
        one = _next(lang_hash[lang], word_hash[word])
        known = marks.has(one) if orders.start == 2 else marks.has(_next(one[:-1], word_hash[word[1:]]))
    for n in range(1, orders.stop):
        if n > 1:
            last = len(word) - n + 1
            if last <= 0:
                return
            ok = ok[:last] & (piece[:last] == piece[n - 1:])
            if orders.start == 2:
                ok &= known[:last] & known[n - 1:]
            else:
                ok &= known[n - 2:n - 2 + last]
            at = np.flatnonzero(ok)
            code = number[at] * wide + word[at + n - 1]
        elif n in orders:
            at, code = np.arange(len(word)), number
        else:
            continue
        _, first, dense, times = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
        number = np.zeros(len(ok), np.int64)
        number[at] = dense                                             # small again: products of two stay within 64 bits
        if n in orders and len(first):
            start = at[first]
            phrase = [words.take(pa.array(word[start + i])).cast(pa.string()) for i in range(n)]
            joined = pc.binary_join_element_wise(*phrase, " ") if n > 1 else phrase[0]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(lang[start])).cast(pa.string()), joined, pa.array(times.astype(np.int64))],
                                             ["lang", "phrase", "n"])


def count_phrases(texts: DataFrame, orders: range, marks: Broadcast | None, params: PhraseParams) -> DataFrame:
    """(lang, phrase, f) with f of ``least`` or more, of texts (lang, text); with words also the sum ``ALL`` of each language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for langs, pieces in _slices(batch):
                yield from _counted(langs, pieces, orders, marks.value if marks else None, hasher)

    counts = texts.mapInArrow(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
    return materialize(counts.where((F.col("f") >= params.least) | (F.col("phrase") == ALL)), f"phrases-{orders.start}")


def _ranges(stream: DataFrame, params: PhraseParams) -> list[tuple]:
    """Bounds of key ranges of the stream (lang, words): evenly spaced in a sample that has the smallest hashes."""
    rows = stream.count()
    ranges = max(1, min(shuffle_partitions(stream.sparkSession), -(-rows // params.range_rows)))
    every = max(1, rows // (ranges * params.samples))
    sample = sorted((r.lang, tuple(r.words)) for r in stream.select("lang", "words").where(
        F.pmod(F.xxhash64("lang", "words"), F.lit(every)) == 0).collect())
    return sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []


STREAM = "lang string, words array<string>, f long, counts array<long>, beyond long"


def merge_stream(stream: DataFrame, params: PhraseParams) -> DataFrame:
    """One lockstep pass over the phrases in the order of their ``words``.

    Gives each phrase (lang, words, f, counts, beyond) the counts of its beginnings
    (``before``) and in ``beyond`` the largest count of those one word longer, if
    that is more than it held. A phrase comes back once for each range that its
    extensions reach (``ranges``), with the largest of that range.
    """
    bounds = _ranges(stream, params)
    names = ["range", "ranges", "lang", "words", "f", "counts", "beyond"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, first, reach = [], [], []
            for i, (lang, words) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                at = bisect_right(bounds, (lang, tuple(words)))
                # up to the first key that doesn't begin with these words
                last = bisect_left(bounds, (lang, (*words[:-1], words[-1] + "\0")), lo=at)
                rows += [i] * (last - at + 1)
                first += range(at, last + 1)
                reach += [last - at + 1] * (last - at + 1)
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int32()), pa.array(reach, pa.int32()),
                                              *b.take(pa.array(rows, pa.int64())).columns], names)

    def lockstep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: list[list] = []                                          # [range, lang, words, f, counts, beyond, ranges]
        done: list[tuple] = []

        def leave(keep: int) -> None:
            while len(path) > keep:
                _, lang, words, f, counts, beyond, ranges = path.pop()
                done.append((lang, words, f, counts, beyond, ranges, [p[3] for p in path]))

        def flush() -> pa.RecordBatch:
            out = list(zip(*done)) or [()] * 7
            kinds = [pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.list_(pa.int64())]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)],
                                              ["lang", "words", "f", "counts", "beyond", "ranges", "before"])

        for b in batches:
            for at, ranges, lang, words, f, counts, beyond in zip(*[c.to_pylist() for c in b.columns]):
                if path and (path[-1][0] != at or path[-1][1] != lang):
                    leave(0)
                if path and path[-1][2] == words:                      # the same phrase, from another range of the pass before
                    path[-1][5] = max(path[-1][5], beyond)
                    continue
                while path and (len(path) >= len(words) or path[-1][2] != words[:len(path)]):
                    leave(len(path) - 1)
                if path:
                    path[-1][5] = max(path[-1][5], f)
                path.append([at, lang, words, f, counts, beyond, ranges])
            if len(done) >= 10_000:
                yield flush()
        leave(0)
        yield flush()

    dealt = stream.select("lang", "words", "f", "counts", "beyond").mapInArrow(deal, f"range int, ranges int, {STREAM}")
    return dealt.repartition("range").sortWithinPartitions("range", "lang", "words") \
        .mapInArrow(lockstep, f"{STREAM}, ranges int, before array<long>")


def collocations(docs: DataFrame, params: PhraseParams = PhraseParams(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: each language's ``top`` phrases by score."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNDETERMINED)).alias("lang"), F.col(text_col).cast("string").alias("text"))
    words = count_phrases(texts, range(1, 2), None, params)
    tables, marked = [words.where(F.col("phrase") != ALL)], words.where(F.col("phrase") != ALL)
    for orders in (range(2, 3), range(3, params.max_words + 1)):
        marks = spark.sparkContext.broadcast(Marks.of(marked, params))             # at most 2**max_filter_bits bits
        marked = count_phrases(texts, orders, marks, params)
        marks.destroy()
        tables.append(marked)
    stream = tables[0].unionByName(tables[1]).unionByName(tables[2]).select(
        "lang", F.split("phrase", " ").alias("words"), "f", F.array().cast("array<bigint>").alias("counts"), F.lit(0).cast("bigint").alias("beyond"))
    left = materialize(merge_stream(stream, params), "phrases-prefix-order")
    both = materialize(merge_stream(left.select("lang", F.reverse("words").alias("words"), "f", F.col("before").alias("counts"), "beyond"), params)
                       .where(F.size("words") > 1), "phrases-suffix-order")
    return _ranked(both, words.where(F.col("phrase") == ALL).select("lang", F.col("f").alias("n")), params)


def _ranked(both: DataFrame, totals: DataFrame, params: PhraseParams) -> DataFrame:
    """Scores, without dominated phrases, ranked. ``both`` has the words in suffix order, left counts in ``counts``, right ones in ``before``."""
    same = ["lang", "words", "f", "counts", "before"]
    cut = both.where(F.col("ranges") > 1).groupBy(*same).agg(F.max("beyond").alias("beyond"))      # extensions in several ranges
    whole = both.where(F.col("ranges") == 1).select(*same, "beyond").unionByName(cut)
    exact = lambda c, by: F.col(c).cast("decimal(20,0)") * F.lit(by).cast("decimal(8,0)")
    kept = whole.where((F.col("beyond") < params.least) | (exact("beyond", 100) < exact("f", params.dominance)))
    # cut k: the first k words, and the other words, which are the last in text order; exact beyond 64 bits
    cuts = F.expr(f"""array_min(transform(sequence(1, size(counts)), k -> named_struct(
        'score', (cast(f AS decimal(20,0)) * {params.scale}) div (cast(counts[k - 1] AS decimal(20,0)) + before[size(counts) - k]),
        'k', k, 'l', counts[k - 1], 'r', before[size(counts) - k])))""")
    low = kept.select("lang", F.concat_ws(" ", F.reverse("words")).alias("phrase"), F.col("f").alias("a"), cuts.alias("cut"))
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = low.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.score").cast("long").alias("score")) \
        .withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= params.top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: each language's 2000 best phrases of two to four words."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
