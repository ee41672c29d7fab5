"""Packing tokenised documents into fixed-length training sequences.

Documents are tokenised, ended by ``end_id`` and cut into pieces of at most
``capacity`` tokens. Pieces are dealt into randomised groups by a hash, and each
group is packed on its own by first-fit decreasing: pieces from long to short,
each into the first bin with room, which a tournament tree of bin capacities
finds in logarithmic time. Groups have a bounded expected number of pieces of
bounded length, so memory per task does not depend on the input, nor on the
length of any document.

Defined cases: a null text is packed as the empty one, that is as ``end_id``
alone; a repeated row is packed as often as it occurs; an empty table gives no
sequence. Only the id and text columns are read, so other columns may have any
name.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retainx.llm.textnp import slices, utf8


def _byte_chars() -> dict[int, int]:
    """Byte-level vocabularies write a byte that is no printable Latin-1 character as the next free code point from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}


_BYTE_CHARS = _byte_chars()
_SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass(frozen=True)
class PackParams:
    """``tokenizer`` is the path of a public vocabulary file (``tokenizers`` format)."""

    tokenizer: str
    capacity: int = 4096
    end_id: int = 2
    group_pieces: int = 2048            # expected pieces of a group
    bytes_per_token: float = 2.5        # sizes the number of groups; any value gives right results
    cache_words: int = 1_200_000          # per Python worker
    seed: int = 5


class WordEncoder:
    """Token ids of texts, with the ids of each white-space separated word kept.

    The vocabulary's pre-tokenizer never joins text across white space, so the
    ids of a text are those of its words one after the other.
    """

    #: Letters that Python lower-cases by context or to several characters.
    _special = re.compile("[\u03a3\u0130]")

    def __init__(self, path: str, limit: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"       # Spark runs the tasks in parallel
        from tokenizers import Tokenizer
        self._tokenizer = Tokenizer.from_file(path)
        self._limit = limit
        self._signs: dict[bytes, list[int]] = {}
        self._clear()

    def _clear(self) -> None:
        self._at: dict[bytes, int] = {}
        self._start, self._flat, self._used = np.zeros(1024, np.int64), np.zeros(8192, np.uint32), 0

    def _ids(self, word: bytes) -> list[int]:
        """Ids of one word; a word of letters alone is one pre-token and goes straight to the BPE model."""
        text = word.decode()
        if text.isalpha() and text.isascii():
            return [t.id for t in self._tokenizer.model.tokenize(text.lower())]
        if text.isalpha() and not self._special.search(text) and unicodedata.is_normalized("NFC", text):
            return [t.id for t in self._tokenizer.model.tokenize(text.lower().encode().decode("latin-1").translate(_BYTE_CHARS))]
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, words: list[bytes]) -> None:
        n, found = len(self._at), []
        for w in words:
            head = w.rstrip(_SIGNS)
            if len(head) < len(w) and (head.isalpha() or head.decode().isalpha()):       # the run of letters ends before the signs
                at = self._at.get(head)
                ids = self._ids(head) if at is None or at >= n else self._flat[self._start[at]:self._start[at + 1]].tolist()
                if (signs := self._signs.get(w[len(head):])) is None:
                    signs = self._tokenizer.encode(w[len(head):].decode(), add_special_tokens=False).ids
                    if len(self._signs) < 10_000:
                        self._signs[w[len(head):]] = signs
                found.append([*ids, *signs])
            else:
                found.append(self._ids(w))
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        need = self._used + int(lengths.sum())
        if need > len(self._flat):
            self._flat = np.concatenate([self._flat, np.zeros(max(need, len(self._flat)), np.uint32)])
        if n + len(words) + 1 > len(self._start):
            self._start = np.concatenate([self._start, np.zeros(max(n + len(words), len(self._start)), np.int64)])
        self._flat[self._used:need] = np.fromiter(chain.from_iterable(found), np.uint32, need - self._used)
        self._start[n + 1:n + len(words) + 1] = self._used + np.cumsum(lengths)
        self._used = need
        self._at.update(zip(words, range(n, n + len(words))))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text (UTF-8)."""
        # split at ASCII white space; A-Z are folded as the vocabulary does, unless a special token may be in the text
        split = [t.split() if b"<|" in t else t.lower().split() for t in texts]
        words = [w for s in split for w in s]
        if len(self._at) > self._limit:
            self._clear()
        at = np.fromiter(map(self._at.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            self._learn(list(dict.fromkeys(words[i] for i in missing)))
            at[missing] = [self._at[words[i]] for i in missing]
        length = self._start[at + 1] - self._start[at]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        ids = self._flat[np.arange(total) + np.repeat(self._start[at] - (ends - length), length)]
        cuts = np.concatenate([[0], ends])[np.cumsum([0] + [len(s) for s in split])]
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}            # kept by a Python worker between its tasks


def _encoder(path: str, limit: int) -> WordEncoder:
    if (path, limit) not in _ENCODERS:
        _ENCODERS[path, limit] = WordEncoder(path, limit)
    return _ENCODERS[path, limit]


def tokenize_pieces(documents: DataFrame, params: PackParams, id_col: str = "doc_id", text_col: str = "text",
                    window: Column | None = None) -> DataFrame:
    """Pieces of every document: ``id_col``, start, length, doc_tokens, ids (little-endian unsigned 32 bit), and _window if given."""
    kind = dict(documents.dtypes)[id_col]
    carried = [] if window is None else [window.cast("long").alias("_window")]
    names = ["_id", "start", "length", "doc_tokens", "ids", *["_window" for _ in carried]]
    end = np.array([params.end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(params.tokenizer, params.cache_words)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in slices(offsets, 8):
                texts = [data[offsets[i]:offsets[i + 1]].tobytes() for i in range(a, b)]
                row, start, length, tokens, ids = [], [], [], [], []
                for i, own in enumerate(encoder.encode(texts), start=a):
                    own = np.concatenate([own, end])
                    for s in range(0, len(own), params.capacity):
                        piece = own[s:s + params.capacity]
                        row.append(i)
                        start.append(s)
                        length.append(len(piece))
                        tokens.append(len(own))
                        ids.append(piece.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.array(tokens, pa.int64()), pa.array(ids, pa.binary()), *[c.take(pa.array(row, pa.int64())) for c in batch.columns[2:]]],
                    names)

    return documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *carried) \
        .mapInArrow(run, f"_id {kind}, start long, length long, doc_tokens long, ids binary" + ", _window long" * len(carried)) \
        .withColumnRenamed("_id", id_col)


class CapacityTree:
    """Tournament tree over bin capacities: each inner node holds the larger of its two children."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Put ``size`` into the first bin with room and return the bin."""
        room, node = self.room, 1
        if room[1] < size:
            raise ValueError("no bin has room")
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        room[node] -= size
        bin_, node = node - self.leaves, node // 2
        while node:
            best = max(room[2 * node], room[2 * node + 1])
            if room[node] == best:
                break
            room[node] = best
            node //= 2
        return bin_


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset in it) of each piece; ``lengths`` must not increase."""
    tree = CapacityTree(len(lengths), capacity)
    used = [0] * len(lengths)
    out = []
    for n in lengths:
        b = tree.place(n)
        out.append((b, used[b]))
        used[b] += n
    return out


def pack_pieces(pieces: DataFrame, groups: int, params: PackParams, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to pieces of at most ``capacity`` tokens; ``groups`` groups are packed independently.

    Pieces that have a ``_window`` are grouped by it instead.
    """
    dealt = pieces.withColumn("_order", F.xxhash64(F.lit(params.seed), F.col(id_col), F.col("start"), F.col("length")))
    dealt = dealt.withColumnRenamed("_window", "_group") if "_window" in pieces.columns else \
        dealt.withColumn("_group", F.pmod(F.xxhash64(F.col("_order"), F.lit(params.seed)), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("_order", "ascending"), ("ids", "ascending")])
        placed = first_fit_decreasing(table.column("length").to_pylist(), params.capacity)
        first = table.column("_group")[0].as_py() << 32
        return table.drop_columns(["_order", "_group"]) \
            .append_column("sequence_id", pa.array([first + b for b, _ in placed], pa.int64())) \
            .append_column("offset", pa.array([o for _, o in placed], pa.int64()))

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.dtypes if n != "_window") + ", sequence_id long, offset long"
    return dealt.groupBy("_group").applyInArrow(run, schema)


def pack_documents(documents: DataFrame, params: PackParams, id_col: str = "doc_id", text_col: str = "text",
                   position_col: str | None = None) -> DataFrame:
    """Tokenise, cut and pack: one row per piece with its sequence and offset.

    With ``position_col``, a gapless order of the documents from 0, the groups are
    consecutive windows of that order, as many as there would be random ones, and
    sequence ids ascend with the windows: pieces are mixed within a window only.
    """
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit("")))
    expected = documents.select(F.sum(F.ceil((size / params.bytes_per_token + 1) / params.capacity))).first()[0] or 0
    groups = max(1, -(-int(expected) // params.group_pieces))
    window = None
    if position_col is not None:
        each = max(1, -(-documents.count() // groups))
        window = F.floor(F.col(position_col) / each)
    return pack_pieces(tokenize_pieces(documents, params, id_col, text_col, window), groups, params, id_col)


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def packing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every document packed into sequences of 4096 tokens; one row per piece."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = pack_documents(documents, PackParams(public_tokenizer()))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
