"""Token counts by separator scan: documents of flat token files that have no index.

A file is a run of token ids cut into blocks of equal size, without regard to documents; an end-of-document id closes
each document. Blocks are searched on their own, vectorised; a prefix scan over the blocks' sums then gives each
document's place, also of those that reach over several blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import small_batches, table, written
from lectern.llm.tokens import ROUND_BYTES, TextEncoder, vocabulary
from lectern.llm.words import rounds

#: Ids of a block; the last block of a file may be shorter.
BLOCK_IDS = 1 << 17
#: The end-of-text id of the tokenizer: no text encodes to it but by its own string.
END_ID = 50_256


def flat_files(docs: DataFrame, path: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Flat token files of ``docs``, one a partition, as rows (file, block, data, doc_ids).

    ``data`` holds 16-bit little-endian ids. ``doc_ids`` names, for later comparison only, the documents whose
    end id is in the block; the scan doesn't read it. Null and empty texts are an end id alone. The string of the
    end id within a text is encoded as ordinary text.
    """
    path = path or vocabulary()
    small_batches(docs.sparkSession)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = TextEncoder.of(path, plain=True)
        file, block = TaskContext.get().partitionId(), 0
        if max(end_id, encoder.tokenizer.get_vocab_size() - 1) > 0xFFFF:
            raise ValueError("the vocabulary doesn't fit flat files of 16-bit ids")
        held, ends = bytearray(), []  # ends: (bytes up to the end id, doc_id)

        def cut(size: int):
            nonlocal held, ends, block
            inside = [d for at, d in ends if at <= size]
            row = pd.DataFrame({"file": [file], "block": [block], "data": [bytes(held[:size])], "doc_ids": [inside]})
            held, ends, block = held[size:], [(at - size, d) for at, d in ends if at > size], block + 1
            return row

        for batch in batches:
            for lo, hi, raw in rounds(batch["text"].tolist(), ROUND_BYTES):
                ids, sizes = encoder.flat_ids(raw, end_id)
                begin = len(held)
                held += ids.astype("<u2").tobytes()
                ends += [(begin + at, None if pd.isna(d) else int(d)) for at, d in zip((2 * np.cumsum(sizes)).tolist(), batch["doc_id"][lo:hi], strict=True)]
                while len(held) >= 2 * block_ids:
                    yield cut(2 * block_ids)
        if held:
            yield cut(len(held))

    return docs.select("doc_id", "text").mapInPandas(write, "file int, block int, data binary, doc_ids array<long>")


def scan_blocks(blocks: DataFrame, end_id: int = END_ID) -> DataFrame:
    """Per block: n_ids, and where the end id stands in it, found by one vectorised comparison."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for b in batch.itertuples(index=False):
                ids = np.frombuffer(b.data or b"", "<u2")
                yield pd.DataFrame({"file": [b.file], "block": [b.block], "n_ids": [len(ids)], "ends": [np.flatnonzero(ids == end_id).astype(np.int32)]})

    return blocks.select("file", "block", "data").mapInPandas(scan, "file int, block int, n_ids long, ends array<int>")


def documents_of(blocks: DataFrame, end_id: int = END_ID) -> DataFrame:
    """Per document of the files: file, ordinal (from 0), start (id offset in the file), n_tokens (its end id included), closed.

    Ids after a file's last end id are a document that is not closed. A file without ids has no documents.
    """
    found = written(scan_blocks(blocks, end_id), "separators")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = found.select("file", "block", "n_ids", F.size("ends").alias("n_ends"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    sums = sums.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    sums = sums.withColumn("first_ordinal", F.coalesce(F.sum("n_ends").over(before), F.lit(0)))
    sums = sums.withColumn("open_from", F.coalesce(F.max(F.col("base") + F.col("last") + 1).over(before), F.lit(0)))
    held = sums.select("file", "block", "base", "first_ordinal", "open_from")
    ends = found.select("file", "block", "ends", F.posexplode("ends").alias("k", "at"))
    ends = ends.select("file", "block", "k", "at", F.when(F.col("k") > 0, F.element_at("ends", F.greatest("k", F.lit(1)))).alias("previous"))
    start = F.when(F.col("previous").isNull(), F.col("open_from")).otherwise(F.col("base") + F.col("previous") + 1)
    closed = ends.join(held, ["file", "block"]).select(
        "file", (F.col("first_ordinal") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("base") + F.col("at") + 1 - start).alias("n_tokens"), F.lit(True).alias("closed")
    )
    total = sums.groupBy("file").agg(F.sum("n_ids").alias("n"), F.sum("n_ends").alias("ordinal"), F.coalesce(F.max(F.col("base") + F.col("last") + 1), F.lit(0)).alias("start"))
    rest = total.filter("n > start").select("file", "ordinal", "start", (F.col("n") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)


def op3_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document, from flat files of all documents by separator scan: doc_id, file, ordinal, start, n_tokens."""
    files = written(flat_files(table(spark, sf_dir, "documents")), "flat-tokens")
    names = files.select("file", "block", "doc_ids")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = names.select("file", "block", F.size("doc_ids").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    names = names.select("file", "block", F.posexplode("doc_ids").alias("k", "doc_id")).join(base, ["file", "block"])
    names = names.select("file", (F.col("base") + F.col("k")).alias("ordinal"), "doc_id")
    found = documents_of(files).filter("closed")
    return found.join(names, ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
