"""Counting 64-bit marks over a whole table, kept as bitmaps of bounded size.

Marks come as uint64, or with owners (uint32 beside them); then a mark is counted
once for each owner. They are told apart by 40 of their leading bits at least, so
that a table's size makes no mark a repeated one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retainx.llm.scratch import materialize, shuffle_partitions

#: log2 of the bits of the smallest bitmap: a byte for each group that marks are dealt to.
SMALLEST = 19
#: Leading bits of a mark that its places in a bitmap are made of; as many of them as groups can have name the group.
LEAD, GROUP = 40, 16
#: Marks that are dealt out together.
RUN = 1 << 22


def fitting_classes(rows: DataFrame, text_col: str, classes: tuple[tuple[int, int], ...]) -> tuple[tuple[int, int], ...]:
    """``classes`` with bitmaps that follow the texts: a bit of the largest for 4 to 8 bytes, up to the given size."""
    size = rows.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    most = max(width for _, width in classes)
    spare = max(0, most + 3 - max(1, int(size)).bit_length())
    return tuple((least, max(min(SMALLEST, width), width - spare)) for least, width in classes)


def _places(lead: np.ndarray, width: int, two: bool) -> list[np.ndarray]:
    """The bits that marks, given by ``LEAD`` leading bits, have in a bitmap: one, or two in the part of their group."""
    lead, own = lead.astype(np.int64), width - GROUP
    one = lead >> (LEAD - width)
    return [one, (lead >> (LEAD - GROUP) << own) | (lead & ((1 << own) - 1))] if two and own > 0 else [one]


def repeated_marks(rows: DataFrame, marks: Callable[[pa.RecordBatch], Iterator[np.ndarray | tuple[np.ndarray, np.ndarray]]],
                   classes: tuple[tuple[int, int], ...], two: bool = False) -> list[np.ndarray]:
    """For each class (least count, log2 of bits) a bitmap of the marks that occur so often.

    ``marks`` yields arrays, or pairs of arrays (marks, owners), for a batch of
    ``rows``. Marks are dealt by their leading bits to at least four groups for
    each shuffle partition and travel as runs of the 32 bits that follow these,
    4 or (with owners) 8 bytes each; what comes back to the driver has the
    size of the bitmaps, whatever the input. ``two``: each mark has two bits, for
    bitmaps that are far from full.
    """
    bits = min(GROUP, max(LEAD - 32, (4 * shuffle_partitions(rows.sparkSession)).bit_length()))

    def dealt(parts: list) -> pa.RecordBatch:
        owned = isinstance(parts[0], tuple)
        found = np.concatenate([x[0] for x in parts] if owned else parts)
        if not owned:
            found.sort()
        group = (found >> np.uint64(64 - bits)).astype(np.uint16)
        found = (found << np.uint64(bits)) >> np.uint64(32)
        if owned:
            found = ((found << np.uint64(32)) | np.concatenate([x[1] for x in parts]))[np.argsort(group, kind="stable")]
        else:
            found = found.astype(np.uint32)
        cuts = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=1 << bits))])
        own = np.flatnonzero(np.diff(cuts))
        return pa.RecordBatch.from_arrays(
            [pa.array(own, pa.int32()), pa.array(np.full(len(own), 8 * found.dtype.itemsize, np.int32)),
             pa.array([found[cuts[i]:cuts[i + 1]].tobytes() for i in own], pa.binary())], ["bucket", "width", "marks"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            for x in marks(batch):
                parts.append(x)
                n += len(x[0]) if isinstance(x, tuple) else len(x)
                if n >= RUN:
                    yield dealt(parts)
                    parts, n = [], 0
        if parts:
            yield dealt(parts)

    def count(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        data = b"".join(table.column("marks").to_pylist())
        if table.column("width")[0].as_py() == 64:
            found = (np.unique(np.frombuffer(data, np.uint64)) >> np.uint64(32)).astype(np.uint32)
        else:
            found = np.sort(np.frombuffer(data, np.uint32), kind="stable")
        first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        found, times = found[first], np.diff(np.append(first, len(found)))
        lead = ((bucket << 32) + found.astype(np.int64)) >> (bits + 32 - LEAD)
        out = []
        for least, width in classes:
            plain = np.zeros(1 << (width - bits), bool)
            for at in _places(lead[times >= least], width, two):
                plain[at - (bucket << (width - bits))] = True
            out.append(np.packbits(plain, bitorder="little").tobytes())
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "maps": pa.array([out], pa.list_(pa.binary()))})

    maps = [np.zeros(1 << (width - 3), np.uint8) for _, width in classes]
    counted = rows.mapInArrow(spread, "bucket int, width int, marks binary").groupBy("bucket").applyInArrow(count, "bucket int, maps array<binary>")
    for r in materialize(counted, "marks").toLocalIterator():              # beside the bitmaps only a part of them at a time
        for bitmap, part, (_, width) in zip(maps, r.maps, classes):
            step = 1 << (width - bits - 3)
            bitmap[r.bucket * step:(r.bucket + 1) * step] = np.frombuffer(bytes(part), np.uint8)
    return maps


def is_marked(bitmap: np.ndarray, width: int, hashes: np.ndarray, two: bool = False) -> np.ndarray:
    """Whether the bits of each 64-bit hash are set."""
    out = np.ones(len(hashes), bool)
    for at in _places(hashes >> np.uint64(64 - LEAD), width, two):
        out &= (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return out
