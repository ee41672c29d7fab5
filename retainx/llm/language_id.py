"""Language identification by hierarchical discrimination.

A first linear model tells language families apart; within the chosen family,
one-versus-one linear support vector machines separate the closely related
languages and the votes of their margins decide. All models are linear over the
shares of hashed byte n-grams of the whole text, so prediction is a table
look-up and a sum, run in Arrow batches on the executors.

Fitted on a bounded sample (``max_per_language`` labelled texts of each
language, those with the smallest hash of their id).

Defined cases: a null text, or one without any letter, is ``und`` with score 0;
so is every text when no labelled row was given. Rows may repeat; each is
predicted by its text alone. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retainx.llm.sampling import sample_ids
from retainx.llm.textnp import TextFeatures, utf8

UNDETERMINED = "und"

#: Language families of common ISO 639-1 codes; a language not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}


@dataclass(frozen=True)
class LanguageParams:
    orders: tuple[int, ...] = (2, 3, 4)
    bits: int = 16
    max_per_language: int = 600
    epochs: int = 4
    decay: float = 1e-4                 # of the support vector machines
    rate: float = 1.0                   # of the family model
    seed: int = 11


@dataclass(frozen=True)
class LanguageModel:
    families: tuple[tuple[str, ...], ...]      # languages of each family
    pairs: tuple[tuple[str, str], ...]         # one machine for each: positive margin votes for the first
    weights: np.ndarray                        # (slots, 2**bits, families + pairs) float32
    bias: np.ndarray                           # of families + pairs
    params: LanguageParams

    def features(self) -> TextFeatures:
        return TextFeatures(self.params.orders, self.params.bits)

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score) of each text."""
        rows = len(offsets) - 1
        if not self.families:
            return np.full(rows, UNDETERMINED, dtype=object), np.zeros(rows)
        total, count = self.features().sums(data, offsets, self.weights)
        z = total / np.maximum(count, 1)[:, None] + self.bias
        n = len(self.families)
        p = np.exp(z[:, :n] - z[:, :n].max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        family = p.argmax(axis=1)
        lang, score = np.full(rows, UNDETERMINED, dtype=object), np.zeros(rows)
        column = {pair: n + i for i, pair in enumerate(self.pairs)}
        for k, members in enumerate(self.families):
            at = np.flatnonzero(family == k)
            if not len(at):
                continue
            votes = np.full((len(at), len(members)), 1e-12)
            for (i, a), (j, b) in combinations(enumerate(members), 2):
                first = 1 / (1 + np.exp(-2 * np.clip(z[at, column[a, b]], -20, 20)))
                votes[:, i] += first
                votes[:, j] += 1 - first
            best = votes.argmax(axis=1)
            lang[at] = np.array(members, dtype=object)[best]
            share = votes[np.arange(len(at)), best] / votes.sum(axis=1)
            score[at] = np.clip(p[at, k] * share, 0, 1)
        return lang, np.round(score, 9)


def training_rows(documents: DataFrame, params: LanguageParams, use: F.Column | None = None) -> list[tuple[str, str]]:
    """(text, language) of at most ``max_per_language`` documents of each language."""
    ids = documents.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.lit(True) if use is None else use)) \
        .select("doc_id", "lang")
    picked = sample_ids(ids, "doc_id", "lang", params.max_per_language, params.seed) \
        .select("doc_id", F.col("lang").alias("_lang")).distinct()
    # bounded by max_per_language ids for each language, so this side may be broadcast
    found = documents.where(F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang") \
        .join(F.broadcast(picked), "doc_id").where(F.col("lang") == F.col("_lang"))
    rows = found.select("doc_id", "text", "lang").collect()
    return [(r.text, r.lang) for r in sorted(rows, key=lambda r: (r.doc_id, r.lang, r.text))]


def group_families(languages: list[str]) -> tuple[tuple[str, ...], ...]:
    known = {code: name for name, codes in FAMILIES.items() for code in codes}
    groups: dict[str, list[str]] = {}
    for code in sorted(languages):
        groups.setdefault(known.get(code.lower(), f"={code}"), []).append(code)
    return tuple(tuple(v) for _, v in sorted(groups.items()))


def fit(rows: list[tuple[str, str]], params: LanguageParams = LanguageParams()) -> LanguageModel:
    f = TextFeatures(params.orders, params.bits)
    families = group_families(sorted({y for _, y in rows}))
    pairs = tuple(p for members in families for p in combinations(members, 2))
    size, columns = f.slots << params.bits, len(families) + len(pairs)
    weights, bias = np.zeros((columns, size)), np.zeros(columns)
    bags = [(ids, x) for ids, x in (f.bag(t.encode()) for t, _ in rows)]
    norms = [np.sqrt(x @ x) for _, x in bags if len(x)]
    scale = 1 / np.median(norms) if norms else 1.0          # texts of usual length get unit length
    bags = [(ids, x * scale) for ids, x in bags]
    family_of = {lang: k for k, members in enumerate(families) for lang in members}
    langs = [y for _, y in rows]
    rng = np.random.default_rng(params.seed)
    if len(families) > 1:
        n, steps, done = len(families), params.epochs * len(bags), 0
        for _ in range(params.epochs):
            for i in rng.permutation(len(bags)):
                ids, x = bags[i]
                z = weights[:n, ids] @ x + bias[:n]
                p = np.exp(z - z.max())
                p /= p.sum()
                p[family_of[langs[i]]] -= 1
                rate = params.rate * (1 - done / steps)
                weights[:n, ids] -= rate * p[:, None] * x[None, :]
                bias[:n] -= 0.1 * rate * p
                done += 1
    for c, (a, b) in enumerate(pairs, start=len(families)):
        own = [i for i, y in enumerate(langs) if y in (a, b)]
        weights[c], bias[c] = _pegasos([bags[i] for i in own], [1.0 if langs[i] == a else -1.0 for i in own], size, params, rng)
    table = (weights * scale).T.reshape(f.slots, 1 << params.bits, columns)
    return LanguageModel(families, pairs, np.ascontiguousarray(table, dtype=np.float32), bias, params)


def _pegasos(bags: list[tuple[np.ndarray, np.ndarray]], signs: list[float], size: int, params: LanguageParams,
             rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Linear support vector machine by stochastic subgradient steps on the regularised hinge loss."""
    w, factor, bias, t = np.zeros(size), 1.0, 0.0, 1 / params.decay
    for _ in range(params.epochs):
        for i in rng.permutation(len(bags)):
            ids, x = bags[i]
            rate = 1 / (params.decay * t)
            margin = signs[i] * (factor * (w[ids] @ x) + bias)
            factor *= 1 - rate * params.decay
            if margin < 1:
                w[ids] += rate * signs[i] / factor * x
                bias += 0.1 * rate * signs[i]
            t += 1
    return w * factor, bias


def predict_languages(documents: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",),
                      text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of every row with lang_pred and score (named so unless the row keeps such columns: then ``_1`` follows)."""
    shared = documents.sparkSession.sparkContext.broadcast(model)      # 2**bits numbers per slot and machine
    names = [n + "_1" * (n in keep) for n in ("lang_pred", "score")]
    kinds = dict(documents.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            lang, score = m.predict(*utf8(b.column(0)))
            known = np.asarray(b.column(1).to_numpy(zero_copy_only=False), dtype=bool)
            lang, score = np.where(known, lang, UNDETERMINED), np.where(known, score, 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             [*keep, *names])

    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in keep) + f", {names[0]} string, {names[1]} double"
    return documents.select(F.col(text_col).alias("_text"), letters.alias("_letters"), *keep).mapInArrow(run, schema)


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: language of every document; the fold with remainder 1 is never trained on."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    params = LanguageParams()
    model = fit(training_rows(documents, params, use=fold != 1), params)
    return predict_languages(documents, model).select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score")
