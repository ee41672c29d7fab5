"""foreachBatch scoring stream: every arriving customer lands in the log once."""

from pyspark.sql import functions as F

from retainx.operators import score as SC
from retainx.plans import scorecard as CARD, views as V
from retainx.session import shared_dir
from retainx.streaming.scoring import start_scoring_stream

from conftest import SF_SMALL


def test_stream_scores_each_customer_once(spark):
    src = shared_dir(spark, "stream_src")
    t = V.telco(spark, SF_SMALL).dropDuplicates()
    t.repartition(3).write.parquet(src)
    log, ckpt = shared_dir(spark, "stream_log"), shared_dir(spark, "stream_ckpt")
    scorer = lambda b: SC.score_batch(b, CARD.scorecard_probability(b))
    q = start_scoring_stream(spark, src, t.schema, scorer, log, ckpt, user_id=7, key_col="customerID")
    q.awaitTermination(300)
    out = spark.read.parquet(log)
    assert out.count() == t.count()
    assert out.select("customer_identifier").distinct().count() == t.count()
    row = out.where(F.col("customer_identifier") == "C1").first()
    assert row["user_id"] == 7 and 0 <= row["churn_probability"] <= 100
    assert abs(row["churn_probability"] + row["retention_probability"] - 100.0) < 1e-9
    assert 1 <= len(row["top_factors"]) <= 5
