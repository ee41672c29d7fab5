"""Quality classifier: supervised subword embeddings.

Every word, neighbouring word pair and byte n-gram of a text is hashed to a bucket
with a learned vector; a document is the average of its vectors, and a softmax layer turns the
average into class probabilities. Training is stochastic gradient descent in
numpy over a bounded sample of labelled documents; since the softmax sees an
average, a fitted model folds into one number per bucket, and scoring is a
table look-up and a sum per text, run in Arrow batches on the executors.

Defined cases: a null or empty text has no features and gets the score of the
bias alone; without any training row every score is 0.5; other columns of the
documents (also of clashing names) are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retainx.llm.sampling import sample_ids
from retainx.llm.textnp import TextFeatures, utf8


@dataclass(frozen=True)
class QualityParams:
    """``max_train_rows`` bounds the labelled sample that is fitted on the driver."""

    dim: int = 12
    bits: int = 16
    orders: tuple[int, ...] = (3, 4)
    epochs: int = 3
    learning_rate: float = 2.0
    max_train_rows: int = 4000
    threshold: float = 0.3
    seed: int = 7


@dataclass(frozen=True)
class QualityModel:
    """Folded model: log-odds of label 1 = bias + mean of the buckets' weights."""

    weights: np.ndarray                 # (slots, 2**bits, 1) float32
    bias: float
    params: QualityParams

    def features(self) -> TextFeatures:
        return TextFeatures(self.params.orders, self.params.bits, words=True)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total, count = self.features().sums(data, offsets, self.weights)
        logit = total[:, 0] / np.maximum(count, 1) + self.bias
        return np.round(1.0 / (1.0 + np.exp(-np.clip(logit, -40, 40))), 9)


def training_rows(documents: DataFrame, labels: DataFrame, params: QualityParams, label: str = "quality",
                  use: F.Column | None = None) -> list[tuple[str, int]]:
    """At most ``max_train_rows`` labelled texts, those with the smallest hash of their id."""
    ids = (labels.where(F.col(label).isin(0, 1)) if use is None else labels.where(F.col(label).isin(0, 1) & use)) \
        .groupBy("doc_id").agg(F.min(label).cast("int").alias("_label")).where(F.col("doc_id").isNotNull())
    picked = sample_ids(ids.withColumn("_all", F.lit(1)), "doc_id", "_all", params.max_train_rows, params.seed).drop("_all") \
        .join(ids, "doc_id")
    # the picked ids are bounded by max_train_rows, so this side may be broadcast
    texts = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "_label") \
        .agg(F.min("text").alias("text"))
    return [(r.text or "", r._label) for r in sorted(texts.collect(), key=lambda r: r.doc_id)]


def fit(rows: list[tuple[str, int]], params: QualityParams = QualityParams()) -> QualityModel:
    """SGD over averaged bucket vectors with a two-class softmax on top."""
    f = TextFeatures(params.orders, params.bits, words=True)
    rng = np.random.default_rng(params.seed)
    size = f.slots << params.bits
    if len({y for _, y in rows}) < 2:
        bias = 0.0 if not rows else (4.0 if rows[0][1] else -4.0)
        return QualityModel(np.zeros((f.slots, 1 << params.bits, 1), np.float32), bias, params)
    bags = [(*f.bag(t.encode()), y) for t, y in rows]
    emb = rng.uniform(-1, 1, (size, params.dim)).astype(np.float32) / params.dim
    out, bias = np.zeros((2, params.dim)), np.zeros(2)
    steps, done = params.epochs * len(bags), 0
    for _ in range(params.epochs):
        for i in rng.permutation(len(bags)):
            ids, share, y = bags[i]
            rate = params.learning_rate * (1 - done / steps)
            done += 1
            hidden = share @ emb[ids]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ out
            out -= rate * np.outer(p, hidden)
            bias -= 0.1 * rate * p
            # a frequent feature moves more, a text's whole step is spread over its features
            emb[ids] -= (rate * np.sqrt(share)[:, None] * back[None, :]).astype(np.float32)
    weights = (emb @ (out[1] - out[0]).astype(np.float32)).reshape(f.slots, 1 << params.bits, 1)
    return QualityModel(weights.astype(np.float32), float(bias[1] - bias[0]), params)


def score_documents(documents: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, score (probability of label 1) and predicted of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)      # 2**bits numbers per slot: fixed size
    kind = dict(documents.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            score = m.score(*utf8(b.column(1)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(score, pa.float64()),
                 pa.array((score >= m.params.threshold).astype(np.int32), pa.int32())], ["_id", "score", "predicted"])

    return documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")) \
        .mapInArrow(run, f"_id {kind}, score double, predicted int").withColumnRenamed("_id", id_col)


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: quality score of every document; the fold with remainder 0 is never trained on."""
    params = QualityParams()
    documents, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = fit(training_rows(documents, labels, params, use=fold != 0), params)
    return score_documents(documents, model) \
        .select("doc_id", (fold == 0).alias("held_out"), "score", "predicted")
