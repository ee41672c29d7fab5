"""Vectorised text features over Arrow string columns (numpy, inside tasks).

A batch of texts is looked at as one byte buffer with row offsets; all
functions work on slices of bounded size, so a batch of long texts never
needs more than a few dozen MB of temporaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one numpy pass handles, so that its temporaries stay in the cache (a longer single text is its own pass).
CHUNK_BYTES = 1 << 17

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32                      # A-Z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls read as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):          # no or several chunks left
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]] if len(offs) else raw[:0], (offs - offs[0] if len(offs) else np.zeros(1, np.int64))


def slices(offsets: np.ndarray, chunks: int = 1) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) whose texts together hold at most ``chunks * CHUNK_BYTES``, or a single longer text."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + chunks * CHUNK_BYTES, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def fold_ascii(data: np.ndarray) -> np.ndarray:
    return _FOLD[data]


class WordHasher:
    """64-bit hashes of white-space separated words (A-Z folded), all at once.

    A word's raw hash is the difference of two prefix sums of ``byte * B^i``,
    moved back to the origin by the inverse power of the odd base ``B``.
    """

    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self) -> None:
        self._powers = np.ones(1, np.uint64)
        self._inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self._powers) < n:
            size = 1 << int(n - 1).bit_length()
            base, inv = self.BASE, pow(self.BASE, -1, 1 << 64)
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            self._powers = np.multiply.accumulate(steps)
            steps[1:] = inv
            self._inverse = np.multiply.accumulate(steps)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Prefix sums of a buffer, from which ``span`` takes the hash of any part (letter case counts)."""
        self._grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._powers[:len(data)], out=sums[1:])
        return sums

    def span(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the parts [start, end), equal for equal bytes wherever they stand."""
        return mix((sums[end] - sums[start]) * self._inverse[start] + (end - start).astype(np.uint64) * _MIX2)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each word, start byte of each word, words before each row: len(rows)+1)."""
        n = len(data)
        if n == 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        self._grow(n + 1)
        inside = ~_SPACE[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = offsets[:-1][np.diff(offsets) > 0]
        first[edges] = inside[edges]                     # a row starts a new word
        start = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        end = np.flatnonzero(last) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_FOLD[data].astype(np.uint64) + np.uint64(1)) * self._powers[:n], out=sums[1:])
        raw = (sums[end] - sums[start]) * self._inverse[start]
        return mix(raw + (end - start).astype(np.uint64) * _MIX2), start, np.searchsorted(start, offsets)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles of every row (fewer words: the whole row as one).

    ``bounds`` holds the words before each row. Returns (hash, shingles before
    each row); shingles keep text order and may repeat.
    """
    n = np.diff(bounds)
    count = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    before = np.concatenate([[0], np.cumsum(count)])
    total = int(before[-1])
    row = np.repeat(np.arange(len(n)), count)
    at = np.arange(total) - before[:-1][row] + bounds[:-1][row]
    out = np.zeros(total, np.uint64)
    end = bounds[1:][row]
    for i in range(k):
        pos = at + i
        ok = pos < end
        step = np.zeros(total, np.uint64)
        step[ok] = words[pos[ok]]
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + step + np.uint64(i + 1))
    return out, before


def distinct_by_row(values: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of every row, and how many lie before each row."""
    rows = len(before) - 1
    row = np.repeat(np.arange(rows), np.diff(before))
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values, row = values[keep], row[keep]
    return values, np.searchsorted(row, np.arange(rows + 1))


def row_sums(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sum of values[start:end] for each row (zero where empty); rows don't influence each other."""
    out = np.zeros(len(start), np.float64)
    full = np.flatnonzero(end > start)
    if len(full):
        cuts = np.column_stack([start[full], end[full]]).ravel()
        padded = np.append(values, 0.0)
        out[full] = np.add.reduceat(padded, cuts)[::2]
    return out


class TextFeatures:
    """Hashed byte n-grams (A-Z folded) and, if wanted, whole words of a text.

    Slot s of a table of shape (slots, 2**bits, columns) belongs to the s-th
    n-gram order; with ``words`` the last two slots hold words and neighbouring
    word pairs. A pair is hashed by the difference of its word hashes, so that
    all immediate repetitions of a word, whichever word it is, share a bucket.
    """

    _ODD = np.uint32(0x9E3779B1)

    def __init__(self, orders: tuple[int, ...] = (2, 3, 4), bits: int = 16, words: bool = False) -> None:
        if not all(1 <= n <= 4 for n in orders):
            raise ValueError("n-gram orders from 1 to 4 are supported")
        self.orders, self.bits, self.with_words = tuple(sorted(orders)), bits, words
        self.slots = len(self.orders) + 2 * words
        self._hasher = WordHasher()

    def _grams(self, data: np.ndarray) -> list[np.ndarray]:
        """For each order, the bucket of the n-gram that starts at each byte."""
        one = _FOLD[data].astype(np.uint32)
        code, out = one, []
        for n in range(1, self.orders[-1] + 1):
            if n > 1:
                code = (code[:-1] << np.uint32(8)) | one[n - 1:]
            if n in self.orders:
                out.append(((code * self._ODD) >> np.uint32(32 - self.bits)).astype(np.int64))
        return out

    def _word_buckets(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket of each word, bucket of each word and the next, words before each row)."""
        hashes, _, before = self._hasher.words(data, offsets)
        shift = np.uint64(64 - self.bits)
        pairs = mix(hashes[1:] - hashes[:-1] + _MIX1) >> shift
        return (hashes >> shift).astype(np.int64), pairs.astype(np.int64), before

    def _blocks(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """(rows, bytes, offsets of the gram starts, bytes of overlap at the end)."""
        for a, b in slices(offsets):
            lo, hi = int(offsets[a]), int(offsets[b])
            if hi - lo <= 2 * CHUNK_BYTES:
                yield np.arange(a, b), data[lo:hi], offsets[a:b + 1] - lo, 0
                continue
            for s in range(lo, hi, CHUNK_BYTES):         # one very long text, piece by piece
                e = min(s + CHUNK_BYTES, hi)
                more = min(self.orders[-1] - 1, hi - e)
                yield np.array([a]), data[s:e + more], np.array([0, e - s]), more

    def sums(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the table's rows over each text's features, number of features)."""
        rows = len(offsets) - 1
        total, count = np.zeros((rows, table.shape[2])), np.zeros(rows, np.int64)
        for at, part, offs, more in self._blocks(data, offsets):
            for slot, (n, bucket) in enumerate(zip(self.orders, self._grams(part))):
                # a gram lies within its row: the last n-1 starts of a row are left out
                end = offs[1:] + (min(more, n - 1) if more else 0) - (n - 1)
                self._add(total, count, at, table[slot], bucket, offs[:-1], np.maximum(end, offs[:-1]))
        if self.with_words:
            for a, b in slices(offsets):
                words, pairs, before = self._word_buckets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                self._add(total, count, np.arange(a, b), table[-2], words, before[:-1], before[1:])
                self._add(total, count, np.arange(a, b), table[-1], pairs, before[:-1], np.maximum(before[1:] - 1, before[:-1]))
        return total, count

    @staticmethod
    def _add(total, count, at, table, bucket, start, end) -> None:
        count[at] += end - start
        if len(bucket):
            for c in range(table.shape[1]):
                total[at, c] += row_sums(table[:, c][bucket].astype(np.float64), start, end)

    def bag(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(feature ids over all slots, their share of the text's features); for training."""
        data = np.frombuffer(text, np.uint8)
        found = [np.unique(g + (slot << self.bits), return_counts=True) for slot, g in enumerate(self._grams(data))] \
            if len(data) >= self.orders[-1] else []
        if self.with_words:
            words, pairs, _ = self._word_buckets(data, np.array([0, len(data)]))
            found += [np.unique(x + ((self.slots - back) << self.bits), return_counts=True) for back, x in ((2, words), (1, pairs))]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0)
        ids, n = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        return ids, n / max(1, n.sum())
