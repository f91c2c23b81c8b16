"""Spaced repetition: one step as Column expressions, a history as an ordered fold that stays in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The published default weights of FSRS 4.5, its decay, and the target retention.
W = (0.4872, 1.4003, 3.7145, 13.8206, 5.1618, 1.2298, 0.8975, 0.031, 1.6474, 0.1367, 1.0461, 2.1072, 0.0793, 0.3246, 1.587, 0.2272, 2.8755)
DECAY, FACTOR, RETENTION, LONGEST = -0.5, 19 / 81, 0.9, 365
#: Days to the next showing by Leitner box.
BOX_DAYS = {1: 1, 2: 3, 3: 7}


def rating(correct: Column, confidence: Column) -> Column:
    """1 wrong, 2 right but not sure, 3 right and sure."""
    return F.when(~correct, 1).when(confidence == "sure", 3).otherwise(2)


def retrievability(days: Column, stability: Column) -> Column:
    return F.pow(1 + FACTOR * F.greatest(F.lit(0.0), days) / F.greatest(stability, F.lit(0.01)), F.lit(DECAY))


def interval_days(stability: Column, retention: float = RETENTION) -> Column:
    days = stability / FACTOR * (retention ** (1 / DECAY) - 1)
    return F.least(F.lit(LONGEST), F.greatest(F.lit(1), F.rint(days).cast("int")))


class Columns:
    """The arithmetic of a step on Spark columns."""

    pow, exp, least, greatest = staticmethod(F.pow), staticmethod(F.exp), staticmethod(F.least), staticmethod(F.greatest)
    number = staticmethod(F.lit)

    @staticmethod
    def by_grade(grade: Column, values: dict[int, object], other) -> Column:
        out = F.lit(other) if not isinstance(other, Column) else other
        for g, v in values.items():
            out = F.when(grade == g, v).otherwise(out)
        return out


class Floats:
    """The same arithmetic on plain numbers, for state that is kept outside columns."""

    pow, exp, least, greatest = staticmethod(pow), staticmethod(math.exp), staticmethod(min), staticmethod(max)
    number = staticmethod(float)

    @staticmethod
    def by_grade(grade: int, values: dict[int, object], other):
        return values.get(grade, other)


def _clamped(d, m):
    return m.least(m.number(10.0), m.greatest(m.number(1.0), d))


def first_step(grade, m=Columns):
    """(stability, difficulty) after the first review."""
    return m.by_grade(grade, {g: m.number(w) for g, w in enumerate(W[:4], 1)}, m.number(W[2])), _clamped(W[4] - (grade - 3) * m.number(W[5]), m)


def next_step(stability, difficulty, days, grade, m=Columns):
    """(stability, difficulty) after a review graded ``days`` after the one before."""
    r = m.pow(1 + FACTOR * m.greatest(m.number(0.0), days) / m.greatest(stability, m.number(0.01)), m.number(DECAY))
    harder = _clamped(W[7] * m.number(W[4]) + (1 - W[7]) * (difficulty - W[6] * (grade - 3)), m)
    forgot = m.least(stability, W[11] * m.pow(difficulty, m.number(-W[12])) * (m.pow(stability + 1, m.number(W[13])) - 1) * m.exp(W[14] * (1 - r)))
    bonus = m.by_grade(grade, {2: m.number(W[15]), 4: m.number(W[16])}, m.number(1.0))
    gain = m.exp(m.number(W[8])) * (11 - difficulty) * m.pow(stability, m.number(-W[9])) * (m.exp(W[10] * (1 - r)) - 1) * bonus
    return m.greatest(m.number(0.1), m.by_grade(grade, {1: forgot}, stability * (gain + 1))), harder


def review_state(ev: DataFrame, keys: list[str]) -> DataFrame:
    """State after all answers of each key in order of (ts, event_id): stability, difficulty, reviews, lapses, last review, next due.

    A key is one user's question, so its history is short; the fold runs over its sorted array.
    """
    item = F.struct("ts", "event_id", rating(F.col("is_correct"), F.col("confidence")).alias("g"))
    history = ev.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("h"))
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("d"), F.lit(None).cast("timestamp_ntz").alias("at"), F.lit(0).alias("lapses"))

    def step(state: Column, x: Column) -> Column:
        s0, d0 = first_step(x["g"])
        days = (F.unix_micros(x["ts"].cast("timestamp")) - F.unix_micros(state["at"].cast("timestamp"))) / F.lit(86_400e6)
        s1, d1 = next_step(state["s"], state["d"], days, x["g"])
        new = state["at"].isNull()
        return F.struct(
            F.when(new, s0).otherwise(s1).cast("double").alias("s"), F.when(new, d0).otherwise(d1).cast("double").alias("d"), x["ts"].alias("at"), (state["lapses"] + (x["g"] == 1).cast("int")).alias("lapses")
        )

    out = history.withColumn("state", F.aggregate("h", zero, step))
    due = F.col("state.at") + F.make_dt_interval(interval_days(F.col("state.s")))
    return out.select(*keys, F.col("state.s").alias("stability"), F.col("state.d").alias("difficulty"), F.size("h").alias("reviews"), F.col("state.lapses").alias("lapses"), F.col("state.at").alias("last_review"), due.alias("next_due"))


def leitner(box: Column, grade: Column, at: Column) -> tuple[Column, Column]:
    """(box, next due) of a card after a grade from 0 (again) to 3 (easy)."""
    new = F.when(grade == 0, 0).when(grade == 1, F.greatest(box - 1, F.lit(0))).otherwise(F.least(box + 1, F.lit(3)))
    minutes = F.when(grade == 0, 10).when(grade == 1, 1440)
    for b, days in BOX_DAYS.items():
        minutes = minutes.when(new == b, days * 1440)
    return new, at + F.make_dt_interval(mins=minutes)


def crowd_difficulty(percent: Column) -> Column:
    """1 (easy) to 5 by the share of people who answered right; null where that isn't known."""
    level = F.when(percent.isNull(), F.lit(None).cast("int"))
    for least, grade in ((85, 1), (70, 2), (55, 3), (35, 4)):
        level = level.when(percent >= least, grade)
    return level.otherwise(5)


def minutes_between(begin: Column, end: Column) -> Column:
    """Minutes from one time to another, to one decimal."""
    return F.round((F.unix_micros(end.cast("timestamp")) - F.unix_micros(begin.cast("timestamp"))) / 60e6, 1)
