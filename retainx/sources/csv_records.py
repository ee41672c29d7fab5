"""Records of CSV files whose quoted fields hold line breaks, with files read in splits.

Whether a line starts inside a quoted field depends on all quotes before it. Each
split's number of quotes is counted first, in parallel; the sum over the splits
before it, odd or even, says how a split begins. With that every split finds its
records by itself; only a record that crosses a border comes in pieces, one for
each split, and is put together from these. No task reads more than its splits.

Quotes within a quoted field are doubled, and a field that holds a quote is quoted,
so that quotes come in pairs. A file whose quotes don't is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from retainx.session import shared_dir

WHOLE, HEAD, MIDDLE, TAIL = range(4)
#: Splits whose beginnings are shipped to every task (some 100 bytes each); more of them are joined.
MOST_SHIPPED = 100_000


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, line): the lines of each split in order, where the split starts, without the line ends."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
        F.regexp_replace("value", r"\r$", "").alias("line"))


def _beginnings(lines: DataFrame) -> DataFrame:
    """(path, start, inside): whether a split begins within a quoted field. One row per split, read in file order."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    odd = lines.groupBy("path", "start").agg((F.sum(quotes) % 2).alias("odd"))
    before = Window.partitionBy("path").orderBy("start")
    at = odd.withColumn("upto", F.sum("odd").over(before) % 2).withColumn("inside", (F.col("upto") - F.col("odd")) % 2 != 0) \
        .withColumn("ends", F.max(F.struct("start", "upto")).over(Window.partitionBy("path"))["upto"])
    return at.withColumn("inside", F.when(F.col("ends") == 0, F.col("inside")).otherwise(
        F.raise_error(F.concat(F.lit("a quote is not closed in "), F.col("path"))).cast("boolean"))).select("path", "start", "inside")


def _records_of_splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, start, n, kind, text) from the ordered lines of splits: whole records, and the pieces at their borders."""
    split, n, held, inside, first = None, 0, [], False, False
    rows: list[tuple] = []

    def give(kind: int, text: str) -> None:
        nonlocal n
        if kind == WHOLE and not text:                                 # an empty line between records
            return
        rows.append((*split, n, kind, text))
        n += 1

    def leave() -> None:
        if split is not None and held:
            give(MIDDLE if first else TAIL, "\n".join(held))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 5
        rows.clear()
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "start", "n", "kind", "text"])

    for b in batches:
        odd = np.asarray(pc.count_substring(b.column(2), '"')) % 2 == 1
        for path, start, line, turns, begins in zip(*[c.to_pylist() for c in b.columns[:3]], odd.tolist(), b.column(3).to_pylist()):
            if (path, start) != split:
                leave()
                split, n, held, inside, first = (path, start), 0, [], begins, begins
            if not inside and not turns:
                give(WHOLE, line)
                continue
            held.append(line)
            inside ^= turns
            if not inside:
                give(HEAD if first else WHOLE, "\n".join(held))
                held, first = [], False
        if len(rows) >= 10_000:
            yield flush()
    leave()
    yield flush()


def _in_order(lines: DataFrame, at: DataFrame) -> DataFrame:
    """Very many splits: the table goes to the lines through a shuffle, after which each split's lines are put in order again."""
    numbered = lines.withColumn("_k", F.monotonically_increasing_id())
    return numbered.join(at.hint("shuffle_merge"), ["path", "start"]).repartition("path", "start").sortWithinPartitions("path", "start", "_k")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, n, text): every record of the files under ``path``, line breaks within quotes kept as ``\\n``.

    A file's first record is its (0, 0). Empty lines between records are left out,
    as the reader of single-line files does.
    """
    lines = _lines(spark, path)
    at = _beginnings(lines)
    table = shared_dir(spark, "csv-splits")
    at.write.parquet(table)
    at = spark.read.schema(at.schema).parquet(table)
    small = at.count() <= MOST_SHIPPED
    pieces = (lines.join(F.broadcast(at), ["path", "start"]) if small else _in_order(lines, at)).select("path", "start", "line", "inside") \
        .mapInArrow(_records_of_splits, "path string, start long, n long, kind int, text string")
    whole = pieces.where(F.col("kind") == WHOLE).select("path", "start", "n", "text")
    # pieces in file order: a tail, any splits in between, and a head; at most two pieces a split
    order = Window.partitionBy("path").orderBy("start", "n")
    numbered = pieces.where(F.col("kind") != WHOLE).withColumn("record", F.sum((F.col("kind") == TAIL).cast("int")).over(order))
    joined = numbered.groupBy("path", "record").agg(
        F.min(F.struct("start", "n")).alias("at"), F.sort_array(F.collect_list(F.struct("start", "n", "text"))).alias("parts")) \
        .select("path", "at.start", "at.n", F.array_join(F.transform("parts", lambda x: x["text"]), "\n").alias("text"))
    return whole.unionByName(joined)
