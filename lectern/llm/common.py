"""Helpers that the operators of this subpackage share: tables, scratch space, cut points."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``, by whatever file system the path names."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Python workers take at most ``rows`` rows at once: whole texts are long. What is computed doesn't depend on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def trim() -> None:
    """Give memory that Python has freed back to the system.

    An executor keeps more workers than it runs at once, for later tasks; what each of them holds on to adds up.
    """
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(batches: Iterable, most: int = 64) -> Iterator:
    """``batches``, with memory given back after every ``most`` of them and at the end."""
    for k, batch in enumerate(batches, 1):
        yield batch
        if k % most == 0:
            del batch
            trim()
    trim()


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    A session without one gets a temporary folder if its master is local (tests, a laptop); on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts the lineage and survives lost executors.

    Row groups are small, so that a writer holds little of whole texts.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).option("parquet.block.size", 16 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(col: str = "text") -> Column:
    """UTF-8 bytes of a text; null has none."""
    return F.coalesce(F.octet_length(F.col(col)), F.lit(0)).cast("long")


def is_held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from all training: crc32 of its id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, most_bytes: int = 64_000_000) -> DataFrame:
    """(doc_id, ``label``, text) to learn from: documents that aren't held out, in the order of a hash of their id.

    Of each label (0 and 1) at most ``most`` documents, as far as their texts have ``most_bytes`` together. A document
    with several labels counts as 1; of rows that share a doc_id the least text counts; null texts are empty; a text
    above ``most_bytes`` is passed over.
    """
    known = labels.filter(F.col(label).isin(0, 1)).filter(~is_held_out()).groupBy("doc_id").agg(F.max(label).alias(label))
    known = known.withColumn("_turn", F.xxhash64("doc_id"))
    first = [known.filter(F.col(label) == k).orderBy("_turn", "doc_id").limit(most) for k in (0, 1)]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(first[0].unionByName(first[1])), "doc_id")
    rows = rows.groupBy("doc_id", label, "_turn").agg(F.min("text").alias("text")).filter(F.octet_length("text") <= most_bytes)
    so_far = F.sum(F.octet_length("text")).over(Window.partitionBy(label).orderBy("_turn", "doc_id"))
    return rows.withColumn("_bytes", so_far).filter(F.col("_bytes") <= most_bytes).select("doc_id", label, "text")
