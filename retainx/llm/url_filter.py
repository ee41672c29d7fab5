"""URL filter: allow and block rules, and a character language-model ratio for the rest.

URLs that a rule accepts and URLs that a rule rejects train two smoothed
variable-order Markov models of characters (contexts of two, one and no
characters, each blended into the shorter one by the Witten-Bell rule). The
length-normalised difference of their log-likelihoods judges a URL that no rule
fits; the threshold is calibrated on every fourth labelled URL (by hash), which
is left out of the counts. Everything is DataFrame expressions; the fitted model
is an array of 32 ** 3 numbers, whatever the input, handed over by a scalar
subquery.

Defined cases: a null URL, or one without ``://``, has empty host and path and
fits no rule; a null or empty URL has no likelihood and is blocked; without
labelled URLs of both classes the ratio is 0 everywhere and the threshold 0, so
the method allows. Rows are independent, so repeated rows give repeated results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Symbols of the models: 1 to 26 letters, 27 any digit, 28 to 31 these signs, 0 everything else and the start.
_SIGNS = "./-?"
SYMBOLS = 32


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (Rule("com", "/", True), Rule("example.com", "/en/", False), Rule("www.example.com", "/en/", True),
         Rule("net", "/es/", False), Rule("net", "/fr/", False))


@dataclass(frozen=True)
class UrlParams:
    rules: tuple[Rule, ...] = RULES
    calibrate_every: int = 4            # share of the labelled URLs that sets the threshold
    steps: int = 200                    # thresholds tried between -4 and 4 nats per character


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if null or without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Name of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):       # the longest is asked first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.name)).otherwise(out)
    return out


def _codes(url: Column) -> Column:
    """array<int> of the URL's symbols."""
    plain = F.translate(F.translate(url, _UPPER, _LOWER), "0123456789", "0" * 10)
    alphabet = _LOWER + "0" + _SIGNS
    return F.transform(F.split(plain, ""), lambda c: F.when(F.length(c) == 1, F.instr(F.lit(alphabet), c)).otherwise(0))


def _grams(url: Column) -> Column:
    """For each character the index of (two before, one before, itself) in a 32 x 32 x 32 table."""
    return F.transform(F.col("_codes"), lambda c, i: (
        F.when(i > 1, F.get(F.col("_codes"), i - 2)).otherwise(0) * (SYMBOLS * SYMBOLS)
        + F.when(i > 0, F.get(F.col("_codes"), i - 1)).otherwise(0) * SYMBOLS + c))


def with_grams(urls: DataFrame, url_col: str) -> DataFrame:
    url = F.coalesce(F.col(url_col), F.lit(""))
    return urls.withColumn("_codes", F.when(F.length(url) > 0, _codes(url)).otherwise(F.array().cast("array<int>"))) \
        .withColumn("_grams", _grams(F.col("_codes"))).drop("_codes")


def fit_ratio(labelled: DataFrame) -> DataFrame:
    """One row with ``ratio``: log P(accepted) - log P(rejected) of a character after its context.

    ``labelled`` has columns _grams and allow. Below the first aggregate no frame has over 2 * 32 ** 3 rows.
    """
    spark = labelled.sparkSession
    counts = labelled.select("allow", F.explode("_grams").alias("at")).groupBy("allow", "at").agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(2 * SYMBOLS ** 3).select(
        (F.col("id") % 2 == 0).alias("allow"), F.floor(F.col("id") / 2).cast("int").alias("at"))
    full = grid.join(counts, ["allow", "at"], "left").select(
        "allow", "at", F.coalesce("n", F.lit(0)).alias("n"), (F.col("at") % SYMBOLS).alias("c"),
        F.floor(F.col("at") / SYMBOLS).alias("ba"), (F.floor(F.col("at") / SYMBOLS) % SYMBOLS).alias("a"),
        F.floor(F.col("at") / SYMBOLS ** 2).alias("b"))
    over = lambda *k: Window.partitionBy("allow", *k)
    df = full.withColumn("n1", F.sum("n").over(over("a", "c"))).withColumn("n0", F.sum("n").over(over("c"))) \
        .withColumn("all2", F.sum("n").over(over("ba"))).withColumn("kinds2", F.count_if(F.col("n") > 0).over(over("ba"))) \
        .withColumn("all1", F.sum("n").over(over("a"))) \
        .withColumn("kinds1", F.count_if((F.col("b") == 0) & (F.col("n1") > 0)).over(over("a"))) \
        .withColumn("all0", F.sum("n").over(over()))
    df = df.withColumn("p0", (F.col("n0") + 1) / (F.col("all0") + SYMBOLS))

    def blend(n: str, total: str, kinds: str, shorter: str) -> Column:
        return F.when(F.col(total) > 0, (F.col(n) + F.col(kinds) * F.col(shorter)) / (F.col(total) + F.col(kinds))).otherwise(F.col(shorter))

    df = df.withColumn("p1", blend("n1", "all1", "kinds1", "p0")).withColumn("p2", blend("n", "all2", "kinds2", "p1"))
    ratio = df.groupBy("at").agg(F.sum(F.when(F.col("allow"), F.log("p2")).otherwise(-F.log("p2"))).alias("x"),
                                 F.min("all0").alias("least"))
    return ratio.agg(F.when(F.min("least") > 0, F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]))
                     .otherwise(F.array_repeat(F.lit(0.0), SYMBOLS ** 3)).alias("ratio"))


def _score(ratio: Column) -> Column:
    total = F.aggregate(F.col("_grams"), F.lit(0.0), lambda acc, g: acc + F.get(ratio, g))
    return F.when(F.size("_grams") > 0, total / F.size("_grams"))


def calibrate(scored: DataFrame, params: UrlParams) -> DataFrame:
    """One row with ``threshold``: where the share of accepted URLs above plus rejected ones below is largest.

    ``scored`` has columns score and allow; each URL falls into one of ``steps`` + 1 bins.
    """
    n = params.steps
    bins = scored.where(F.col("score").isNotNull()).groupBy(F.least(F.lit(n), F.greatest(F.lit(0), F.floor((F.col("score") + 4) * n / 8)))
                                                          .alias("bin")).agg(F.count_if("allow").alias("good"), F.count_if(~F.col("allow")).alias("bad"))
    below = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)       # at most steps + 1 rows
    everything = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cut = bins.select("bin", (
        1 - F.coalesce(F.sum("good").over(below), F.lit(0)) / F.greatest(F.sum("good").over(everything), F.lit(1))
        + F.coalesce(F.sum("bad").over(below), F.lit(0)) / F.greatest(F.sum("bad").over(everything), F.lit(1))).alias("gain"))
    return cut.agg(F.coalesce(F.max_by(F.col("bin") * 8.0 / n - 4, F.struct("gain", -F.abs(F.col("bin") - n / 2))), F.lit(0.0)).alias("threshold"))


def filter_urls(urls: DataFrame, params: UrlParams = UrlParams(), url_col: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep``, host, path, rule, verdict (allow or block), score and threshold of every row."""
    allowed = [r.name for r in params.rules if r.allow]
    host, path = host_and_path(F.col(url_col))
    df = with_grams(urls.select(*keep, F.col(url_col).alias("_url"), host.alias("host"), path.alias("path")), "_url") \
        .withColumn("rule", fitting_rule(F.col("host"), F.col("path"), params.rules))
    labelled = df.where(F.col("rule").isNotNull()).withColumn("allow", F.col("rule").isin(allowed))
    aside = F.pmod(F.xxhash64("_url"), F.lit(params.calibrate_every)) == 0
    ratio = fit_ratio(labelled.where(~aside)).scalar()
    scored = lambda d: d.withColumn("_ratio", ratio).withColumn("score", _score(F.col("_ratio")))
    threshold = calibrate(scored(labelled.where(aside)).select("score", "allow"), params).scalar()
    judged = F.when(F.col("rule").isNotNull(), F.col("rule").isin(allowed)).otherwise(
        F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False)))
    return scored(df).withColumn("threshold", threshold) \
        .select(*keep, "host", "path", "rule", F.when(judged, "allow").otherwise("block").alias("verdict"), "score", "threshold")


def urls_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: verdict on the URL of every page."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
