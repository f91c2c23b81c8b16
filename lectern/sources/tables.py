"""The tables and the fact view on answers that the analytics read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a right answer counts by how sure it was; an unknown confidence counts in full.
CONFIDENCE_WEIGHT = {"sure": 1.0, "unsure": 0.6, "guess": 0.2}
#: The feature that each kind of event stands for.
FEATURES = {"click": "Practice", "view": "Past papers", "purchase": "Weekly mock", "signup": "Daily Dose"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def answers(events: DataFrame) -> DataFrame:
    """Answer facts of an event log: question k, whether it was right, how sure, subject, feature and session.

    A payload without a number gives a null k; such rows count as neither right nor wrong.
    """
    k = F.expr("try_cast(get_json_object(props, '$.k') as int)")
    feature = F.coalesce(*[F.when(F.col("event_type") == e, F.lit(f)) for e, f in FEATURES.items()], F.lit("Other"))
    sure = F.when(F.col("k") % 3 == 0, "sure").when(F.col("k") % 3 == 1, "unsure").when(F.col("k") % 3 == 2, "guess")
    return events.withColumn("k", k).select(
        "event_id",
        "user_id",
        "ts",
        "event_type",
        "value",
        "k",
        (F.col("k") % 2 == 0).alias("is_correct"),
        sure.alias("confidence"),
        F.floor(F.col("k") / 10).cast("int").alias("subject"),
        feature.alias("feature"),
        F.concat(F.col("event_type"), F.lit(":"), F.date_format("ts", "yyyy-MM-dd")).alias("session"),
    )


def weight(confidence: str = "confidence"):
    out = F.lit(1.0)
    for name, w in CONFIDENCE_WEIGHT.items():
        out = F.when(F.col(confidence) == name, F.lit(w)).otherwise(out)
    return out
