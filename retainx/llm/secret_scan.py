"""Secret scan: pattern rules plus a likelihood-ratio test between two character Markov models.

The pattern rules label the training samples: values they match are random
strings, other long tokens of the same texts are ordinary identifiers. For each
class a first-order Markov model of characters is counted over the whole table,
smoothed towards the class's character frequencies. As the other tokens may hold
secrets that no rule knows, the share of them most like random strings (``trim``)
is left out and the models are fitted once more. A long token that no rule matched is reported when its transitions are far more
likely under the model of random strings. Everything is DataFrame expressions:
the two models are one array of log-likelihood ratios, indexed by the character
pair, that a scalar subquery hands to the scan.

Defined cases: a null text reads as empty, an empty text has no spans; without
training tokens of both classes no span is added to those of the rules. Spans
are counted in code points, end exclusive. Rows are independent of each other,
so repeated rows give repeated results; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retainx.llm.scratch import materialize

#: The rules' names in their order, and their patterns. A match of
#: ``assign`` counts if its value has MIN_VALUE characters; the other two carry
#: their minimum length (20 and 24), which selects the same maximal runs.
KINDS = ("assign", "access", "hex")
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
MIN_VALUE = 6
MARKOV = "markov"


@dataclass(frozen=True)
class SecretParams:
    """A token is tested from ``min_length`` characters on, and reported from ``min_ratio`` nats (natural log) on."""

    min_length: int = 16
    train_length: int = 12              # shorter tokens say little about either class
    smoothing: float = 0.5
    trim: float = 0.1
    min_ratio: float = 8.0
    min_ratio_per_step: float = 0.25


def _running_sum(lengths: Column, block: int = 256) -> Column:
    """Prefix sums of an array of longs, block by block so that long arrays stay cheap."""
    zero = F.lit(0).cast("long")
    empty = F.array().cast("array<long>")

    def scan(values: Column, start: Column) -> Column:
        return F.aggregate(
            values, F.struct(start.alias("s"), empty.alias("a")),
            lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"] + x)).alias("a")),
            lambda acc: acc["a"])

    starts = F.sequence(F.lit(1), F.greatest(F.size(lengths), F.lit(1)), F.lit(block))
    blocks = F.transform(starts, lambda i: F.slice(lengths, i, F.lit(block)))
    totals = scan(F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, x: a + x)), zero)
    return F.flatten(F.transform(blocks, lambda b, i: scan(b, F.when(i > 0, F.get(totals, i - 1)).otherwise(zero))))


def located(text: Column, pattern: str, found: Column, values: Column | None = None) -> Column:
    """array<struct<start, end, value>> of the pattern's leftmost non-overlapping matches.

    ``found`` holds the matched texts; what lies between them comes from a split
    at the same pattern, and the running sum of both gives the places.
    """
    gaps = F.slice(F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long")), F.lit(1), F.size(found))
    sizes = F.transform(found, lambda x: F.length(x).cast("long"))
    ends = _running_sum(F.zip_with(gaps, sizes, lambda g, n: g + n))
    return F.zip_with(F.arrays_zip(ends.alias("e"), sizes.alias("n")), found if values is None else values,
                      lambda p, v: F.struct((p["e"] - p["n"]).alias("start"), p["e"].alias("end"), v.alias("value")))


def rule_spans(documents: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the text (null: empty) and for each kind an array of its spans."""
    spans = "array<struct<start: bigint, end: bigint, value: string>>"
    df = documents.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    text = F.col("_text")
    df = df.select("*", *[F.regexp_extract_all(text, F.lit(PATTERNS[k]), F.lit(0)).alias(f"_{k}") for k in KINDS])
    out = []
    for kind in KINDS:
        found = F.col(f"_{kind}")
        values = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(2)) if kind == "assign" else None
        at = located(text, PATTERNS[kind], found, values)
        if kind == "assign":
            at = F.filter(at, lambda s: F.length(s["value"]) >= MIN_VALUE)
        out.append(F.when(F.size(found) > 0, at).otherwise(F.array()).cast(spans).alias(kind))
    return df.select(*keep, "_text", *out)


def _pair_index(token: Column, i: Column) -> Column:
    """Index of the characters at i and i+1 (from 1) in a 128 x 128 table of ASCII."""
    return F.ascii(F.substr(token, i, F.lit(1))) * 128 + F.ascii(F.substr(token, i + 1, F.lit(1)))


def tokens(text: Column, length: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[A-Za-z0-9+/_=-]{{{length},}}"), F.lit(0))


def training_tokens(spans: DataFrame, params: SecretParams) -> DataFrame:
    """(token, random): values that a rule matched, and the other long tokens of all texts."""
    held = F.concat(*[F.col(k) for k in KINDS])
    rest = F.col("_text")
    for kind in KINDS:
        rest = F.when(F.size(F.col(kind)) > 0, F.regexp_replace(rest, PATTERNS[kind], " ")).otherwise(rest)
    both = F.concat(
        F.transform(held, lambda s: F.struct(s["value"].alias("token"), F.lit(True).alias("random"))),
        F.transform(tokens(rest, params.train_length), lambda t: F.struct(t.alias("token"), F.lit(False).alias("random"))))
    return spans.select(F.explode(both).alias("x")).select("x.*")


def fit_ratio(labelled: DataFrame, params: SecretParams) -> DataFrame:
    """One row with ``ratio``: log P(next | previous, random) - log P(next | previous, identifier) at 128 * previous + next.

    ``labelled`` has columns token and random. The table has 128 x 128 entries whatever the input.
    """
    size, alpha = 128, params.smoothing
    pairs = labelled.where(F.length("token") > 1).select(
        "random", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: _pair_index(F.col("token"), i))).alias("at"))
    counted = pairs.where(F.col("at") < size * size).groupBy("at").agg(
        F.count_if("random").alias("random"), F.count_if(~F.col("random")).alias("plain"))
    # from here on the frame has 128 x 128 rows
    grid = counted.sparkSession.range(size * size).select(F.col("id").alias("at")).join(counted, "at", "left") \
        .select("at", F.floor(F.col("at") / size).alias("prev"), (F.col("at") % size).alias("next"),
                *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in ("random", "plain")])
    over = lambda *k: Window.partitionBy(*k)
    mass = alpha * 66                                           # the alphabet of tokens has 66 characters

    def log_share(n: str) -> Column:
        single = (F.sum(n).over(over("next")) + alpha) / (F.sum(n).over(over(F.lit(0))) + mass)
        return F.log((F.col(n) + mass * single) / (F.sum(n).over(over("prev")) + mass))

    ratio = grid.select("at", "random", "plain", (log_share("random") - log_share("plain")).alias("x"))
    return ratio.agg(F.when((F.sum("random") > 0) & (F.sum("plain") > 0), F.transform(
        F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"])).alias("ratio"))


def _likeness(token: Column, ratio: Column) -> Column:
    """Log-likelihood ratio of a token's transitions."""
    return F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda a, i: a + F.get(ratio, _pair_index(token, i)))


def fit_trimmed(labelled: DataFrame, params: SecretParams) -> DataFrame:
    """``fit_ratio`` without the unlabelled tokens that a first fit finds most like random strings."""
    per_step = _likeness(F.col("token"), F.col("_first")) / (F.length("token") - 1)
    scored = labelled.withColumn("_first", fit_ratio(labelled, params).scalar()) \
        .select("token", "random", F.when(~F.col("random"), per_step).alias("_s"))
    cut = scored.agg(F.percentile_approx("_s", 1 - params.trim, 1000).alias("cut"))
    return fit_ratio(scored.withColumn("_cut", cut.scalar()).where(F.coalesce(F.col("_s") <= F.col("_cut"), F.lit(True))), params)


def scan_secrets(documents: DataFrame, ratio: DataFrame | None = None, params: SecretParams = SecretParams(),
                 text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and ``spans``: array of (start, end, kind, value) by start, then kind in the order of KINDS, markov last.

    ``ratio`` is a fitted table (``fit_ratio``); by default it is fitted on the same documents.
    """
    rules = rule_spans(documents, text_col, keep)
    if ratio is None:
        ratio = fit_trimmed(materialize(training_tokens(rules, params), "secret-samples"), params)
    text = F.col("_text")
    pattern = f"[A-Za-z0-9+/_=-]{{{params.min_length},}}"
    scan = rules.withColumn("_long", tokens(text, params.min_length)).withColumn("_ratio", ratio.scalar())
    suspicious = lambda t: _likeness(t, F.col("_ratio")) >= F.greatest(
        F.lit(params.min_ratio), params.min_ratio_per_step * (F.length(t) - 1))
    # the texts' long tokens are few: first see whether any is suspicious, then find its place
    scan = scan.withColumn("_any", F.col("_ratio").isNotNull() & F.exists(F.col("_long"), suspicious))
    def ranked(spans: Column, kind: str, rank: int) -> Column:
        return F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))

    scan = scan.withColumn("_ruled", F.concat(*[ranked(F.col(k), k, i) for i, k in enumerate(KINDS)]))
    own = F.filter(located(text, pattern, F.col("_long")), lambda s: suspicious(s["value"]) & ~F.exists(
        F.col("_ruled"), lambda r: (r["start"] < s["end"]) & (s["start"] < r["end"])))
    everything = F.when(F.col("_any"), F.concat(F.col("_ruled"), ranked(own, MARKOV, len(KINDS)))).otherwise(F.col("_ruled"))
    return scan.select(*keep, F.transform(F.array_sort(everything), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))).alias("spans"))


def secrets_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: secrets of every document, as digests of the spans."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    spans = F.col("spans")
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.filter(spans, lambda s: s["kind"] != MARKOV)), 256).alias("base_sha256"),
        joined(spans).alias("spans"), count(MARKOV).alias("n_markov"))
