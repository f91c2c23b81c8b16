"""Writing back: a keyed table on files, upserted batch by batch so that a batch may run twice or fail midway."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from lectern.operators.relational import upserted, written

#: Buckets that keys are dealt to: a batch rewrites those that it touches.
BUCKETS = 64
BUCKET = "_bucket"


def create_table(spark: SparkSession, path: str, schema: StructType) -> None:
    """An empty keyed table under ``path``; one that is there already stays as it is."""
    spark.createDataFrame([], schema).withColumn(BUCKET, F.lit(0)).write.mode("ignore").partitionBy(BUCKET).parquet(path)


def keyed_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows of a keyed table."""
    return spark.read.schema(_stored(schema)).parquet(path).drop(BUCKET)


def _stored(schema: StructType) -> StructType:
    return StructType(list(schema.fields)).add(BUCKET, "integer")


def upsert(batch: DataFrame, path: str, keys: list[str], order: list[str], keep_old: bool = False, buckets: int = BUCKETS, swap: Callable[[DataFrame, str], None] | None = None) -> None:
    """Put ``batch`` into the keyed table at ``path``: one row a key, the batch's last by ``order`` (or, with ``keep_old``, its first, and the table's own row before that).

    What the touched buckets will hold is written to the scratch folder first, then these buckets are overwritten in one
    commit. A batch that fails before the swap has changed nothing; one that fails in it, or runs again, leads to the
    same rows, since a row put twice is one row. A null key is a key. ``swap`` replaces the last step, for tests.
    """
    spark, schema = batch.sparkSession, batch.schema
    last = [F.col(c) if keep_old else F.desc(c) for c in order]
    once = batch.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*last, *[c for c in batch.columns if c not in order]))).filter("_n = 1").drop("_n")
    named = lambda df: df.withColumn("_key", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))
    new = named(once).withColumn(BUCKET, F.pmod(F.xxhash64("_key"), F.lit(buckets)).cast("int"))
    new = written(new, "upsert-batch")
    touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # at most ``buckets``
    if not touched:
        return
    old = named(spark.read.schema(_stored(schema)).parquet(path).filter(F.col(BUCKET).isin(touched)))
    staged = written(upserted(old, new.select(*old.columns), ["_key"], keep_old).drop("_key"), "upsert-staged")
    (swap or _swap)(staged, path)


def _swap(staged: DataFrame, path: str) -> None:
    staged.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)


def upsert_stream(stream: DataFrame, path: str, keys: list[str], order: list[str], checkpoint: str, keep_old: bool = False, **trigger):
    """A running query that upserts each batch of ``stream`` into the keyed table at ``path``."""

    def put(batch: DataFrame, _: int) -> None:
        upsert(batch, path, keys, order, keep_old)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**trigger).start()
