"""The keyed table and the range source."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.sources import ranges, sink

SCHEMA = StructType().add("id", "long").add("part", "string").add("at", "integer").add("value", "string")


def held(spark, path):
    return sorted(map(repr, (tuple(r) for r in sink.keyed_table(spark, path, SCHEMA).collect())))


def expected(*batches):
    rows = {}
    for batch in batches:
        for r in sorted(batch, key=lambda r: (r[2], [-ord(c) for c in r[3]])):
            rows[r[0], r[1]] = r
    return sorted(map(repr, rows.values()))


ONE = [(1, "a", 1, "x"), (1, "a", 3, "z"), (1, "a", 2, "y"), (2, None, 1, "n"), (None, "b", 1, "m")]
TWO = [(1, "a", 1, "again"), (3, "c", 1, "new"), (2, None, 5, "n2")]


def test_a_batch_twice_is_a_batch_once(spark, tmp_path):
    path = str(tmp_path / "t")
    sink.create_table(spark, path, SCHEMA)
    for rows in (ONE, ONE, TWO, TWO):
        sink.upsert(spark.createDataFrame(rows, SCHEMA), path, ["id", "part"], ["at"])
    sink.create_table(spark, path, SCHEMA)
    sink.upsert(spark.createDataFrame([], SCHEMA), path, ["id", "part"], ["at"])
    assert held(spark, path) == expected(ONE, TWO)
    sink.upsert(spark.createDataFrame([(3, "c", 9, "no"), (4, "d", 2, "late"), (4, "d", 1, "early")], SCHEMA), path, ["id", "part"], ["at"], keep_old=True)
    assert held(spark, path) == sorted([*expected(ONE, TWO), repr((4, "d", 1, "early"))])


def test_a_batch_that_fails_midway_leads_to_the_same_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    sink.create_table(spark, path, SCHEMA)
    sink.upsert(spark.createDataFrame(ONE, SCHEMA), path, ["id", "part"], ["at"])

    def before(staged, path):
        raise RuntimeError("lost before the swap")

    def within(staged, path):
        some = staged.select(sink.BUCKET).first()[0]
        sink._swap(staged.filter(F.col(sink.BUCKET) == some), path)
        raise RuntimeError("lost in the swap")

    for swap, same in ((before, True), (within, False)):
        with pytest.raises(RuntimeError):
            sink.upsert(spark.createDataFrame(TWO, SCHEMA), path, ["id", "part"], ["at"], swap=swap)
        assert (held(spark, path) == expected(ONE)) or not same
    sink.upsert(spark.createDataFrame(TWO, SCHEMA), path, ["id", "part"], ["at"])
    assert held(spark, path) == expected(ONE, TWO)


def test_a_stream_of_batches(spark, tmp_path):
    path, src = str(tmp_path / "t"), tmp_path / "in"
    sink.create_table(spark, path, SCHEMA)
    for k, rows in enumerate((ONE, TWO)):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(src))
        stream = spark.readStream.schema(SCHEMA).json(str(src))
        query = sink.upsert_stream(stream, path, ["id", "part"], ["at"], str(tmp_path / "cp"), availableNow=True)
        query.awaitTermination(120)
        assert query.exception() is None, k
    assert held(spark, path) == expected(ONE, TWO)


def test_one_matrix_is_many_tasks(spark, tmp_path):
    spark.dataSource.register(ranges.RangeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    values = np.random.default_rng(1).normal(size=(2500, 7)).astype("<f8")
    np.save(tmp_path / "v.npy", values)
    rows = spark.read.format("ranges").option("path", str(tmp_path / "v.npy")).option("rows", 1000).load()
    assert rows.rdd.getNumPartitions() == 3
    got = {r["ref"]: r["embedding"] for r in rows.collect()}
    assert sorted(got) == list(range(2500)) and np.allclose([got[k] for k in range(2500)], values, atol=1e-6)
    with pytest.raises(Exception, match="NumPy"):
        (tmp_path / "bad.npy").write_bytes(b"no array")
        spark.read.format("ranges").option("path", str(tmp_path / "bad.npy")).load().count()


def test_bounds_rule_out_ranges():
    reader = ranges.RangeReader.__new__(ranges.RangeReader)
    ranges.RangeReader.__init__(reader, "unused", "npy", 10)
    kept = list(reader.pushFilters([ranges.GreaterThan(("ref",), 4), ranges.LessThanOrEqual(("ref",), 30), ranges.EqualTo(("other",), 3)]))
    assert len(kept) == 3 and (reader.low, reader.high) == (5, 30)


def test_pages_by_ranges(spark, tmp_path):
    spark.dataSource.register(ranges.RangeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    pages = [f"page {i} é\n" * (i % 5) for i in range(23)]
    for name, text in (("a.txt", "\f".join(pages[:20]) + "\f"), ("b.txt", "\f".join(pages[20:])), ("c.txt", "")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    rows = spark.read.format("ranges").option("kind", "pages").option("path", str(tmp_path)).option("rows", 6).load()
    assert rows.rdd.getNumPartitions() == 5
    assert [r["text"] for r in rows.orderBy("page").collect()] == pages
    some = rows.filter("page >= 7 and page < 13")
    assert some.rdd.getNumPartitions() == 2 and [r["page"] for r in some.orderBy("page").collect()] == list(range(7, 13))
