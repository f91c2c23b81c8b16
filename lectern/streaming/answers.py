"""Streaming forms: late answers, idempotent inserts, windows and per-key review state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.functions.scheduling import Floats, first_step, next_step


def event_time(answered: str, received: str, days: int = 30):
    """The time an answer counts at: when it was given if that is within ``days`` and not ahead, else when it was received."""
    fits = (F.col(answered) >= F.col(received) - F.expr(f"interval {days} days")) & (F.col(answered) <= F.col(received))
    return F.when(fits, F.col(answered)).otherwise(F.col(received))


def first_answers(stream: DataFrame, keys: list[str], days: int = 30) -> DataFrame:
    """Answers re-dated before the watermark, so that none is dropped as late, and of each key the first.

    In a batch that is the one of the earliest time, ties to the earlier arrival. In a stream the first to arrive stands
    for ``days``, after which its key is forgotten; ``stateful.standing_answers`` keeps it for good, as a table's unique key does.
    """
    timed = stream.withColumn("at", event_time("answered_at", "received_at", days).cast("timestamp"))
    if not timed.isStreaming:
        first = Window.partitionBy(*keys).orderBy("at", "received_at", *[c for c in stream.columns if c not in (*keys, "received_at")])
        return timed.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    return timed.withWatermark("at", f"{days} days").dropDuplicatesWithinWatermark(keys)


def stalled(log: DataFrame, now: Column, minutes: int = 10) -> DataFrame:
    """Per job of a log (job, at): its last line and whether it has been silent for ``minutes`` at ``now``."""
    by = log.groupBy("job").agg(F.max("at").alias("last_at"), F.count(F.lit(1)).alias("lines"))
    return by.withColumn("stalled", F.col("last_at") < now - F.expr(f"interval {minutes} minutes"))


def weekly_counts(stream: DataFrame, late: str = "7 days") -> DataFrame:
    """Counts by Monday week and event type."""
    timed = stream.withColumn("at", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("at", late)
    return timed.groupBy(F.window("at", "7 days", startTime="4 days").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("week"), "event_type", "n")


def gap_sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    timed = stream.withColumn("at", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("at", late)
    return timed.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n")


def review_stream(stream: DataFrame, key: str) -> DataFrame:
    """The review state of each key after each batch: (key, stability, difficulty, reviews). Input: key, ts, grade."""

    def fold(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s, d, at, n = state.get if state.exists else (0.0, 0.0, 0, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "grade"], kind="stable")
        for ts, g in zip(rows["ts"], rows["grade"], strict=True):
            now = int(ts.value // 1000)
            s, d = first_step(int(g), Floats) if n == 0 else next_step(s, d, (now - at) / 86_400e6, int(g), Floats)
            at, n = now, n + 1
        state.update((s, d, at, n))
        yield pd.DataFrame({key: [name[0]], "stability": [s], "difficulty": [d], "reviews": [n]})

    kind = dict(stream.dtypes)[key]
    return stream.select(key, F.col("ts").cast("timestamp").alias("ts"), "grade").groupBy(key).applyInPandasWithState(
        fold, f"{key} {kind}, stability double, difficulty double, reviews int", "s double, d double, at long, n int", "update", GroupStateTimeout.NoTimeout
    )
