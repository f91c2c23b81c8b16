"""Streams with state of their own by key, and timers: answers that stand for good, silence that is noticed, sliding limits.

A session that runs these needs RocksDB as its state store (``spark.sql.streaming.stateStore.providerClass``, see PROVIDER).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _micros(at: pd.Series) -> list[int]:
    return [int(pd.Timestamp(x).value // 1000) for x in at]


class _First(StatefulProcessor):
    """The first answer of a key; that there was one is kept for good."""

    def __init__(self, columns: list[str], at: str):
        self.columns, self.at = columns, at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            least = batch.sort_values([self.at, *[c for c in self.columns if c != self.at]], kind="stable").head(1)
            first = least if first is None else pd.concat([first, least]).sort_values([self.at, *[c for c in self.columns if c != self.at]], kind="stable").head(1)
        if first is not None and not self.seen.exists():
            self.seen.update((_micros(first[self.at])[0],))
            yield first[self.columns]

    def close(self) -> None:
        pass


def standing_answers(stream: DataFrame, keys: list[str], at: str = "at") -> DataFrame:
    """Of each key the first answer that arrives, ever: a later one changes nothing, however late. Of those that arrive together the earliest by ``at``, then by the other columns.

    State is a number for each key and is never dropped, as a table's unique key isn't; null keys are a key of their own.
    """
    columns = stream.columns
    # a key is told from a null by its text
    named = stream.withColumn("_key", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    return named.groupBy("_key").transformWithStateInPandas(_First(columns, at), stream.schema, "append", "none")


class _Silence(StatefulProcessor):
    def __init__(self, job: str, at: str, minutes: int):
        self.job, self.at, self.micros = job, at, minutes * 60_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, n long, due long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        at, n, due = self.last.get() if self.last.exists() else (None, 0, None)
        for batch in rows:
            times = _micros(batch[self.at])
            at, n = max([*times, *([] if at is None else [at])]), n + len(times)
        wanted = -(-(at + self.micros) // 1000)  # timers count in milliseconds
        if wanted != due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(wanted)
        self.last.update((at, n, wanted))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, n, _ = self.last.get()
        yield pd.DataFrame({self.job: [key[0]], "last_at": [pd.Timestamp(at * 1000)], "lines": [n]})

    def close(self) -> None:
        pass


def silence_alarms(log: DataFrame, job: str = "job", at: str = "at", minutes: int = 10, late: str = "0 seconds") -> DataFrame:
    """(job, last_at, lines) of each job that has been silent for ``minutes``, sent once when event time has passed that point.

    No row of the job itself is needed: other jobs' lines move event time on. A job that speaks again gets a new alarm when
    it falls silent again. ``log`` has ``job`` and ``at``, a timestamp; null jobs are left out.
    """
    rows = log.filter(F.col(job).isNotNull()).select(job, F.col(at).cast("timestamp").alias(at)).withWatermark(at, late)
    kind = dict(log.dtypes)[job]
    return rows.groupBy(job).transformWithStateInPandas(_Silence(job, at, minutes), f"{job} {kind}, last_at timestamp, lines long", "append", "eventTime")


class _Limit(StatefulProcessor):
    def __init__(self, columns: list[str], at: str, seconds: int, most: int):
        self.columns, self.at, self.micros, self.most = columns, at, seconds * 1_000_000, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        recent = [r[0] for r in self.recent.get()] if self.recent.exists() else []
        batch = pd.concat(list(rows)).sort_values([self.at], kind="stable")
        out = batch[self.columns].copy()
        times, counts = _micros(batch[self.at]), []
        every = sorted([*recent, *times])
        begin = end = 0
        for t in times:  # rows of the same time count one another, as in a range window
            while end < len(every) and every[end] <= t:
                end += 1
            while every[begin] < t - self.micros:
                begin += 1
            counts.append(end - begin)
        out["n"] = counts
        out["over"] = out["n"] > self.most
        last = every[-1]
        self.recent.put([(t,) for t in every if t >= last - self.micros])
        yield out

    def close(self) -> None:
        pass


def sliding_limits(stream: DataFrame, key: str, at: str = "ts", seconds: int = 3600, most: int = 60) -> DataFrame:
    """``stream`` with n, how many rows of the key fall in the ``seconds`` up to each one (itself included), and over, whether that exceeds ``most``.

    A key keeps the times of its last ``seconds`` alone, trimmed by event time. Batches must come in order of time, as a log does;
    then n equals a range window over the whole. Rows of the same time in one batch count one another. Null keys are left out.
    """
    rows = stream.filter(F.col(key).isNotNull()).withColumn(at, F.col(at).cast("timestamp"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", n long, over boolean"
    return rows.groupBy(key).transformWithStateInPandas(_Limit(rows.columns, at, seconds, most), schema, "append", "none")
