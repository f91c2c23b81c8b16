"""Streams with state and timers, fed batch by batch."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lectern.streaming import stateful


def at(day, hour=0, minute=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour, minutes=minute)


@pytest.fixture
def fed(spark, tmp_path):
    """Runs a stream over given batches, each a file, and returns what came out of each."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stateful.PROVIDER)

    def run(schema, batches, build):
        src = tmp_path / "in"
        src.mkdir(exist_ok=True)
        out, seen = [], []
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src))
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(src))
            query = build(stream).writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination(120)
            assert query.exception() is None, k
            out.append(list(seen))
            seen.clear()
        return out

    return run


def test_a_first_answer_stands_for_good(fed):
    batches = [
        [("u1", 1, at(0, 2), "b"), ("u1", 1, at(0, 1), "a"), (None, 1, at(0, 1), "x")],
        [("u1", 1, at(40), "late"), ("u2", 1, at(40), "c"), ("u1", 2, at(40), "d")],
        [("u1", 1, at(400), "later still"), ("u2", 1, at(400), "no"), (None, 1, at(400), "no")],
    ]
    got = fed("user string, q int, at timestamp, answer string", batches, lambda s: stateful.standing_answers(s, ["user", "q"]))
    assert [sorted(r["answer"] for r in b) for b in got] == [["a", "x"], ["c", "d"], []]


def test_silence_is_told_without_a_row_of_the_job(fed):
    batches = [
        [("a", at(0, 1)), ("b", at(0, 1)), ("a", at(0, 1, 2))],
        [("b", at(0, 1, 8))],
        [("b", at(0, 1, 13))],  # a has been silent for eleven minutes
        [("b", at(0, 1, 20))],
        [("a", at(0, 1, 21)), ("b", at(0, 1, 21))],
        [("c", at(0, 2))],
        [("c", at(0, 2, 1))],
    ]
    got = fed("job string, at timestamp", batches, lambda s: stateful.silence_alarms(s, minutes=10))
    told = [(r["job"], r["last_at"], r["lines"]) for b in got for r in b]
    assert told.count(("a", at(0, 1, 2), 2)) == 1 and ("a", at(0, 1, 21), 3) in told and ("b", at(0, 1, 21), 5) in told
    assert not any(r for b in got[:2] for r in b) and len(told) == 3


def test_limits_equal_a_range_window(fed, spark):
    rows = [(f"k{i % 3}", at(0, 0, 7 * (i // 2)), i) for i in range(80)]
    batches = [rows[:20], rows[20:22], rows[22:60], rows[60:]]
    got = fed("ip string, ts timestamp, i int", batches, lambda s: stateful.sliding_limits(s, "ip", most=4))
    n = {r["i"]: (r["n"], r["over"]) for b in got for r in b}
    whole = {}
    for k, t, i in rows:
        c = sum(x == k and t - dt.timedelta(hours=1) <= s <= t for x, s, _ in rows)
        whole[i] = (c, c > 4)
    assert n == whole and spark.conf.get("spark.sql.streaming.stateStore.providerClass") == stateful.PROVIDER


def test_times_of_spark_are_kept(fed):
    got = fed("user string, q int, at timestamp, answer string", [[("u", 1, at(3, 4, 5), "a")]], lambda s: stateful.standing_answers(s.withColumn("x", F.lit(1)), ["user"]))
    assert [(r["at"], r["x"]) for r in got[0]] == [(at(3, 4, 5), 1)]
