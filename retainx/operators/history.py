"""Prediction-log and registry analytics.

All-user forms: per-user top-n uses ``row_number() <= n`` (a partial
WindowGroupLimit before the shuffle, so a user holding a third of the log
still ships only n rows per task); paging uses a top-k sort; look-ups are
left joins the optimizer broadcasts when the dimension is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F



def _newest():
    return [F.col("created_at").desc(), F.col("id")]


def _matching(preds: DataFrame, user_id: int, search: str | None, risk_level: str | None, prediction: str | None) -> DataFrame:
    df = preds.where(F.col("user_id") == user_id)
    if search:
        df = df.where(F.lower(F.col("customer_identifier")).contains(search.lower()))
    if risk_level:
        df = df.where(F.col("risk_level") == risk_level)
    if prediction:
        df = df.where(F.col("prediction") == prediction)
    return df


def history_query(preds: DataFrame, user_id: int, search: str | None = None, risk_level: str | None = None,
                  prediction: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """One user's log, filtered, newest first, paged by offset (``history_page`` pages without re-reading)."""
    if limit < 1 or offset < 0:
        raise ValueError("limit must be positive and offset must not be negative")
    df = _matching(preds, user_id, search, risk_level, prediction)
    return df.orderBy(*_newest()).offset(offset).limit(limit) if offset else df.orderBy(*_newest()).limit(limit)


def history_page(preds: DataFrame, user_id: int, after: tuple | None = None, search: str | None = None, risk_level: str | None = None,
                 prediction: str | None = None, limit: int = 100) -> DataFrame:
    """H01 by cursor: the rows that follow ``after`` = (created_at, id) of the page before.

    Every page is a top-``limit`` of what is older, so that the thousandth costs
    what the first does; the bound on ``created_at`` reaches the scan, where it
    skips files and row groups that hold only newer rows. Rows without a time
    come last, as in ``history_query``; one that shares time and id with the cursor is
    on the page before. ``cursor_after`` gives the next cursor.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    df = _matching(preds, user_id, search, risk_level, prediction)
    if after is not None:
        when, last = after
        at = F.lit(when).cast(preds.schema["created_at"].dataType)
        later_id = F.col("id").isNotNull() if last is None else F.col("id") > F.lit(last)
        if when is None:
            df = df.where(F.col("created_at").isNull() & later_id)
        else:
            df = df.where((F.col("created_at") <= at) | F.col("created_at").isNull()) \
                .where(F.col("created_at").isNull() | (F.col("created_at") < at) | later_id)
    return df.orderBy(*_newest()).limit(limit)


def cursor_after(page: DataFrame) -> tuple | None:
    """(created_at, id) of a page's last row, None for an empty page."""
    last = page.orderBy(F.col("created_at").asc_nulls_first(), F.col("id").desc()).select("created_at", "id").first()
    return (last["created_at"], last["id"]) if last else None


def history_with_model(preds: DataFrame, models: DataFrame, missing: str = "Classifier") -> DataFrame:
    """N:1 look-up of the model name; a missing model reads ``Classifier``."""
    m = models.select(F.col("id").alias("model_id"), F.col("algorithm_name"))
    return (preds.join(m, "model_id", "left")
            .withColumn("model_name", F.coalesce("algorithm_name", F.lit(missing))).drop("algorithm_name"))


def latest_predictions(preds: DataFrame, n: int = 5) -> DataFrame:
    """Newest ``n`` log rows of every user."""
    w = Window.partitionBy("user_id").orderBy(*_newest())
    return preds.withColumn("recency_rank", F.row_number().over(w)).where(F.col("recency_rank") <= n)


def prediction_count(preds: DataFrame) -> DataFrame:
    """Log rows per user (map-side partial counts)."""
    return preds.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_predictions"))


def resolve_active(registry: DataFrame, order=None) -> DataFrame:
    """Per user the active row, else the newest upload (or the given
    fallback order, e.g. highest F1 for models)."""
    order = order or [F.col("uploaded_at").desc(), F.col("id").desc()]
    w = Window.partitionBy("user_id").orderBy(F.col("is_active").desc(), *order)
    return registry.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).drop("_r")


def activate(registry: DataFrame, chosen: DataFrame) -> DataFrame:
    """Exactly the chosen row of each user is active; ``chosen`` holds
    (user_id, id) - one row per user."""
    c = chosen.select("user_id", F.col("id").alias("_chosen"))
    return (registry.join(c, "user_id", "left")
            .withColumn("is_active", F.coalesce(F.col("id") == F.col("_chosen"), F.lit(False))).drop("_chosen"))


def delete_records(preds: DataFrame, ids: DataFrame | None = None, user_id: int | None = None,
                   parents: DataFrame | None = None, parent_key: str = "model_id") -> DataFrame:
    """The log without deleted rows: by id (anti join), all rows of a
    user, and cascades of deleted parents (anti join on the parent key)."""
    out = preds
    if user_id is not None:
        out = out.where(~F.col("user_id").eqNullSafe(F.lit(user_id)))      # rows without a user stay
    if ids is not None:
        out = out.join(ids.select("id"), "id", "left_anti")
    if parents is not None:
        out = out.join(parents.select(F.col("id").alias(parent_key)), parent_key, "left_anti")
    return out


def list_datasets(registry: DataFrame, user_id: int) -> DataFrame:
    """A user's datasets, newest first (a distributed sort)."""
    return registry.where(F.col("user_id") == user_id).orderBy(F.col("uploaded_at").desc(), F.col("id").desc())


def search_batch_result(scored: DataFrame, term: str, id_col: str = "customerID") -> DataFrame:
    """Substring search on identifier, label or tier."""
    t = term.lower()
    c = lambda x: F.coalesce(F.lower(F.col(x).cast("string")).contains(t), F.lit(False))
    return scored.where(c(id_col) | c("Predicted_Churn") | c("Risk_Level"))


def dashboard_summary(kpis: DataFrame, preds: DataFrame, models: DataFrame, user_id: int) -> DataFrame:
    """Dataset KPIs, log size, newest prediction and its model for one user."""
    mine = history_with_model(preds.where(F.col("user_id") == user_id), models)
    log = mine.agg(F.count(F.lit(1)).alias("total_predictions"),
                   F.max_by("model_name", F.struct(F.col("created_at"), -F.col("id"))).alias("latest_model"),
                   F.max("created_at").alias("latest_prediction_at"))
    return kpis.crossJoin(log).select(F.lit(user_id).alias("user_id"), *kpis.columns, "total_predictions",
                                      "latest_model", "latest_prediction_at")


def best_model(registry: DataFrame, user_id: int) -> DataFrame:
    """H11 part: a user's best model (flagged, else the highest F1; newest first) with accuracy and F1."""
    mine = registry.where(F.col("user_id") == user_id)
    return mine.orderBy(F.col("is_best").desc(), F.col("f1_score").desc(), F.col("id").desc()).limit(1) \
        .select("algorithm_name", "accuracy", "f1_score")


def dashboard(preds: DataFrame, models: DataFrame, registry: DataFrame, user_id: int, newest: int = 5) -> DataFrame:
    """H11 in full, long form (part, position, name, number): best model, the
    newest predictions with their model, and the charts of tiers and labels."""
    mine = history_with_model(preds.where(F.col("user_id") == user_id), models)
    row = lambda part, frame, position, name, number: frame.select(
        F.lit(part).alias("part"), position.cast("int").alias("position"), name.alias("name"), number.cast("double").alias("number"))
    best = best_model(registry, user_id)
    w = Window.orderBy(*_newest())                                   # over the newest rows only
    latest = mine.orderBy(*_newest()).limit(newest).withColumn("_n", F.row_number().over(w))
    chart = lambda part, c: row(part, mine.groupBy(c).agg(F.count(F.lit(1)).alias("n")), F.lit(None), F.col(c), F.col("n"))
    return (row("best_accuracy", best, F.lit(1), F.col("algorithm_name"), F.col("accuracy"))
            .unionByName(row("best_f1", best, F.lit(1), F.col("algorithm_name"), F.col("f1_score")))
            .unionByName(row("latest", latest, F.col("_n"), F.concat_ws(" / ", "customer_identifier", "model_name", "risk_level"),
                             F.col("churn_probability")))
            .unionByName(chart("tiers", "risk_level")).unionByName(chart("labels", "prediction")))
