"""Document fingerprints by order MinHash over word k-mers.

A text is the sequence of its white-space separated words; its k-mers are runs
of k words, and equal k-mers are told apart by their occurrence number. The hash
of each pair (k-mer, occurrence) falls into one of ``bins`` bins; a bin selects
its ``tuple_size`` = 2 minimal pairs by this hash, puts them back into text order
and hashes the tuple. So every occurrence of a k-mer counts, and has a rank of
its own. As the order of equal k-mers in the text is the order of their numbers,
one sort of (k-mer hash, place) numbers them, and one of (bin, pair hash, place)
finds all minima. A moved or changed passage thus changes the bins whose minima
it holds or reorders. The likeness of two fingerprints is the share of bins used
by either that hold the same tuple.

One hash per pair serves all bins, so the cost per text is two sorts. Everything
is built-in expressions on arrays of the row; nothing is exploded.

Defined cases: a null text reads as empty; a text without words has an empty
fingerprint, which is like (1.0) another empty one and unlike (0.0) any other; a
text of fewer than k words is one k-mer. Texts with equal words are alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retainx.llm.scratch import shuffle_partitions

BINS = 64                                # 6 bits of a k-mer's hash
_PLACE_BITS = 27                         # a text holds fewer than 2**27 words
_PLACE = (1 << _PLACE_BITS) - 1


def _word_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(text, r"\s+"), ""), lambda w: F.xxhash64(w))


def with_fingerprint(df: DataFrame, text: Column, name: str, k: int = 3) -> DataFrame:
    """Adds ``name``: array<bigint> with one entry (6 bits of bin, 26 bits of tuple hash) per used bin, by bin."""
    words, kmers, runs, order, least = (F.col(f"_{x}_{name}") for x in ("words", "kmers", "runs", "order", "least"))
    df = df.withColumn(f"_words_{name}", _word_hashes(text))
    df = df.withColumn(f"_kmers_{name}", F.when(F.size(words) > 0, F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0))),
        lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))).otherwise(F.array().cast("array<bigint>")))
    # k-mer hash (36 bits), place (27 bits): equal k-mers are runs in text order, numbered from the start of their run
    df = df.withColumn(f"_runs_{name}", F.sort_array(F.transform(kmers, lambda h, i: (
        F.shiftleft(F.shiftrightunsigned(h, 28), _PLACE_BITS).bitwiseOR(i.cast("long"))))))
    run_of = lambda x: F.shiftright(x, _PLACE_BITS)
    starts = F.filter(F.sequence(F.lit(0), F.size(runs) - 1), lambda i: (i == 0) | (run_of(F.get(runs, i)) != run_of(F.get(runs, i - 1))))
    df = df.withColumn(f"_starts_{name}", F.when(F.size(runs) > 0, starts).otherwise(F.array().cast("array<int>")))
    starts = F.col(f"_starts_{name}")

    def pair(x: Column, n: Column) -> Column:
        """Bin (6 bits), hash (30 bits) of a k-mer and its number, place (27 bits)."""
        place = x.bitwiseAND(_PLACE)
        h = F.get(kmers, place.cast("int"))
        h = F.when(n == 0, h).otherwise(F.xxhash64(h, n))     # the first occurrence has the k-mer's own hash
        return F.shiftleft(h.bitwiseAND(63), 57).bitwiseOR(F.shiftleft(F.shiftrightunsigned(h, 34), _PLACE_BITS)).bitwiseOR(place)

    df = df.withColumn(f"_order_{name}", F.sort_array(F.flatten(F.transform(starts, lambda s, j: F.transform(
        F.slice(runs, s + 1, F.coalesce(F.get(starts, j + 1), F.size(runs)) - s), pair)))))
    bin_of = lambda x: F.shiftright(x, 57)
    df = df.withColumn(f"_least_{name}", F.filter(order, lambda x, i: (i < 2) | (bin_of(x) != bin_of(F.get(order, i - 2)))))

    def entry(i: Column) -> Column:
        a, b = F.get(least, i), F.get(least, i + 1)
        ha, hb = F.shiftright(a, _PLACE_BITS), F.shiftright(b, _PLACE_BITS)
        both = F.when(a.bitwiseAND(_PLACE) < b.bitwiseAND(_PLACE), F.xxhash64(ha, hb)).otherwise(F.xxhash64(hb, ha))
        value = F.when(b.isNotNull() & (bin_of(a) == bin_of(b)), both).otherwise(F.xxhash64(ha))
        return F.shiftleft(bin_of(a), 26).bitwiseOR(value.bitwiseAND((1 << 26) - 1))

    firsts = F.filter(F.sequence(F.lit(0), F.size(least) - 1), lambda i: (i == 0) | (bin_of(F.get(least, i)) != bin_of(F.get(least, i - 1))))
    return df.withColumn(name, F.when(F.size(least) > 0, F.transform(firsts, entry)).otherwise(F.array().cast("array<bigint>"))) \
        .drop(*[f"_{x}_{name}" for x in ("words", "kmers", "runs", "starts", "order", "least")])


def likeness(a: Column, b: Column) -> Column:
    """Share of the bins used by either fingerprint that hold the same tuple (1.0 for two empty ones)."""
    same = F.size(F.array_intersect(a, b))
    bins = lambda x: F.transform(x, lambda v: F.shiftright(v, 26))
    used = F.size(F.array_union(bins(a), bins(b)))
    return F.when(used == 0, F.lit(1.0)).otherwise(same / used)


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda v: F.lpad(F.hex(v), 8, "0")), "")


def with_next(df: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Adds ``columns`` (name -> new name) of the row with the next ``key`` (bigint); the last row gets the first row's.

    Rows are dealt by ranges of the key, with bounds that are keys of the table;
    the first rows of a range also go to the range before it, marked as guests,
    so each range finds its successors by itself. Null keys come first, rows
    with equal keys are in the order of the hash of ``columns``.
    """
    spark = df.sparkSession
    ranges = 4 * shuffle_partitions(spark)
    place = F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63)))
    # bounds: one number for each range, so their count follows the number of partitions
    row = df.select(place.alias("k")).agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("b"),
                                          F.min("k").alias("least")).first()
    least = row.least
    bounds = sorted({b for b in row.b or [] if b > least})
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.lit(bounds[::step]).cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
    fine = F.lit(bounds).cast("array<bigint>") if bounds else coarse
    below = F.size(F.filter(coarse, lambda b: b <= F.col("_key")))             # coarse search, then within one step
    at = F.when(below == 0, 0).otherwise(
        (below - 1) * step + F.size(F.filter(F.slice(fine, (below - 1) * step + 1, F.lit(step)), lambda b: b <= F.col("_key"))))
    last = len(bounds)
    head = (F.col("_key") == least) | F.array_contains(fine, F.col("_key"))
    before = F.when(F.col("_range") == 0, last).otherwise(F.col("_range") - 1)
    dealt = df.withColumn("_key", place).withColumn("_range", at) \
        .withColumn("_to", F.explode(F.when(head, F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("guest")),
                                                          F.struct(before.alias("r"), F.lit(1).alias("guest"))))
                                     .otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("guest")))))) \
        .withColumn("_range", F.col("_to.r")).withColumn("_guest", F.col("_to.guest")).drop("_to")
    order = Window.partitionBy("_range").orderBy("_guest", "_key", F.xxhash64(*columns))
    for name, new in columns.items():
        dealt = dealt.withColumn(new, F.lead(name).over(order))
    return dealt.where(F.col("_guest") == 0).drop("_key", "_range", "_guest")


def fingerprints_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: fingerprints of every document, of its edited text, and their likeness to the edited and to the next one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(with_fingerprint(docs, F.col("text"), "print"), "doc_id", {"text": "next_text", "print": "next_print"})
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - cut), F.substr("next_text", F.lit(1), cut))
    docs = docs.withColumn("edited", edited).withColumn("n_chars", n.cast("long")) \
        .drop("text", "next_text")
    docs = with_fingerprint(docs, F.col("edited"), "edited_print")
    return docs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"))
