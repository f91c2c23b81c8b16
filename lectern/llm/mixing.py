"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The words of each source, its documents in hashed order, are one run cut into blocks. A source's target gives an exact
quota of blocks; a tree recursively splits all quotas between two halves of the output shards by multivariate
hypergeometric draws. A shard then holds, per source, a stretch of a keyed permutation of the blocks: draws are
disjoint within an epoch without any exchange, and the shard is shuffled locally.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.llm.common import small_batches, table, written

WORDS = r"[^\x20\x09-\x0D]+"
CYCLE = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
#: Words of a block, unless a source is too small for FEWEST_BLOCKS or the mix too large for MOST_BLOCKS.
BLOCK_WORDS, FEWEST_BLOCKS, MOST_BLOCKS = 8192, 256, 400_000_000
#: Rows of all sources that share a bucket of the hashed order.
ROWS_PER_BUCKET = 2048


def targets(sizes: np.ndarray, weights: np.ndarray, share: float = SHARE, most: float = MOST_EPOCHS) -> np.ndarray:
    """Targets in proportion to ``weights`` that sum to ``share`` of all sizes, none above ``most`` times its size.

    What a stopped target can't take is shared among the others by weight until none is above.
    """
    caps = most * sizes.astype(np.float64)
    out, left, free = np.zeros(len(sizes)), share * float(sizes.sum()), np.ones(len(sizes), bool)
    while free.any():
        trial = left * weights / weights[free].sum()
        over = free & (trial > caps)
        if not over.any():
            out[free] = trial[free]
            break
        out[over] = caps[over]
        left, free = left - float(caps[over].sum()), free & ~over
    return out


def split_tree(quotas: np.ndarray, n_shards: int, seed: int) -> np.ndarray:
    """Exact counts [source, shard]: each row sums to its quota, and shard sums differ by one at most."""
    capacity = np.full(n_shards, quotas.sum() // n_shards, np.int64)
    capacity[: quotas.sum() % n_shards] += 1
    out = np.zeros((len(quotas), n_shards), np.int64)

    def split(have: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[:, lo] = have
            return
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.Philox(key=[seed, lo * 65_536 + hi]))
        left = rng.multivariate_hypergeometric(have, int(capacity[lo:mid].sum()), method="marginals")
        split(left, lo, mid)
        split(have - left, mid, hi)

    split(quotas.astype(np.int64), 0, n_shards)
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where each ``index`` below ``n`` goes in the permutation of 0..n-1 that ``key`` names: a Feistel network walked in cycles."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(np.float64))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & m
        for turn in range(4):
            left, right = right, left ^ (_mix(right + k + np.uint64(turn * 0x9E3779B9)) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


SPANS = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("epoch", "shard", "draw", "begin", "end")]))


def mix(docs: DataFrame, n_shards: int = 24, seed: int = 11) -> DataFrame:
    """``docs`` (doc_id, source, size and any others) with source_size, target, taken and spans.

    ``spans``: which words [begin, end) of the document the mix takes in which epoch, the shard that gets them, and
    their place in the source's permuted order. Sources, one row each, are planned on the driver. A null source is the
    last source; a document without words is never taken; rows that repeat are mixed as documents of their own.
    """
    buckets = max(1, -(-docs.count() // ROWS_PER_BUCKET))
    names = docs.columns
    # Rows that share a doc_id part by their other columns; rows without one by their number, where the caller wrote one.
    apart = F.when(F.col("row.doc_id").isNull(), F.xxhash64("row")).otherwise(F.xxhash64("row.doc_id", "row.size", F.lit(seed)))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    rows = rows.select(
        "row",
        F.coalesce(F.concat(F.lit("="), "row.source"), F.lit("")).alias("key"),
        F.pmod(apart, F.lit(buckets)).cast("int").alias("bucket"),
        F.col("row.size").alias("words"),
    )
    sums = written(rows.groupBy("key", "bucket").agg(F.sum("words").alias("words")), "bucket-sums")
    sources = sums.groupBy("key").agg(F.sum("words").alias("words")).toPandas()
    plan = sums.sparkSession.createDataFrame(_plan(sources, n_shards, seed), PLAN)
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("key", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base")).join(F.broadcast(plan) if len(sources) <= 10_000 else plan, "key")
    inside = Window.partitionBy("key", "bucket").orderBy(F.asc_nulls_first("row.doc_id"), "words", F.xxhash64("row")).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum("words").over(inside), F.lit(0))).join(base, ["key", "bucket"])
    placed = placed.select("row", "words", (F.col("base") + F.col("start")).alias("start"), "source_size", "target", "n_blocks", "block_words", "full", "rest", "name", "cuts")

    # Only numbers go through Python: the row itself stays beside them in the same batch.
    @F.pandas_udf(SPANS)
    def drawn(words: pd.Series, start: pd.Series, n_blocks: pd.Series, block_words: pd.Series, full: pd.Series, rest: pd.Series, name: pd.Series, cuts: pd.Series) -> pd.Series:
        return pd.Series(_spans(*(x.to_numpy() for x in (words, start, n_blocks, block_words, full, rest, name)), cuts, seed))

    placed = placed.withColumn("spans", drawn("words", "start", "n_blocks", "block_words", "full", "rest", "name", "cuts"))
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"])
    return placed.select("row.*", "source_size", "target", taken.alias("taken"), "spans")


PLAN = "key string, source_size long, target double, n_blocks long, block_words long, full long, rest long, name long, cuts array<long>"


def _plan(sources: pd.DataFrame, n_shards: int, seed: int) -> pd.DataFrame:
    """A row a source: its target, blocks, quota and where each shard's stretch of its draws ends."""
    order = sorted(range(len(sources)), key=lambda i: (sources["key"][i] == "", sources["key"][i].encode()))  # UTF-8 bytes sort as code points; null last
    out = sources.iloc[order].reset_index(drop=True).rename(columns={"words": "source_size"})
    if not len(out):
        return pd.DataFrame({c.split()[0]: [] for c in PLAN.split(", ")})
    size = out["source_size"].to_numpy(np.int64)
    out["target"] = targets(size, np.array([CYCLE[i % len(CYCLE)] for i in range(len(out))], np.float64))
    least = max(BLOCK_WORDS, -(-int(size.sum()) * MOST_EPOCHS // MOST_BLOCKS))
    words = np.maximum(1, np.minimum(least, -(-size // FEWEST_BLOCKS)))
    out["block_words"], out["n_blocks"] = words, -(-size // words)
    # Whole epochs take all blocks, the last, shorter one too; what remains is counted in full blocks and a part of one.
    epochs = np.minimum(np.floor(out["target"].to_numpy() / np.maximum(size, 1)).astype(np.int64), MOST_EPOCHS)
    left = np.maximum(out["target"].to_numpy() - epochs * size, 0.0)
    more = np.minimum((left // words).astype(np.int64), out["n_blocks"].to_numpy() - 1).clip(0)
    out["full"] = epochs * out["n_blocks"] + more
    out["rest"] = np.where(epochs < MOST_EPOCHS, np.rint(left - more * words), 0).astype(np.int64)
    full = out["full"]
    quotas = full.to_numpy() + (out["rest"] > 0).to_numpy()
    out["cuts"] = np.cumsum(split_tree(quotas, n_shards, seed), axis=1).tolist()
    out["name"] = [int.from_bytes(hashlib.md5(k.encode()).digest()[:7], "little") for k in out["key"]]
    return out[[c.split()[0] for c in PLAN.split(", ")]]


def _spans(words, start, n_blocks, block_words, full, rest, name, cuts, seed) -> list[list[tuple]]:
    has = words > 0
    safe = np.maximum(block_words, 1)
    first, last = start // safe, (start + np.maximum(words, 1) - 1) // safe
    parts = np.where(has, last - first + 1, 0)
    row = np.repeat(np.arange(len(words)), parts)
    block = np.repeat(first - (np.cumsum(parts) - parts), parts) + np.arange(parts.sum())
    begin = np.maximum(block * safe[row] - start[row], 0)
    end = np.minimum((block + 1) * safe[row] - start[row], words[row])
    out: list[list[tuple]] = [[] for _ in range(len(words))]
    for epoch in range(MOST_EPOCHS):
        at = permuted(block, n_blocks[row], _mix(name[row].astype(np.uint64) + np.uint64(seed * 1000 + epoch))) + epoch * n_blocks[row]
        stop = np.where(at == full[row], np.minimum(end, block * safe[row] + rest[row] - start[row]), end)
        for i in np.flatnonzero((at < full[row] + (rest[row] > 0)) & (stop > begin)):
            r = row[i]
            shard = int(np.searchsorted(cuts.iloc[r], at[i], side="right"))
            out[r].append((epoch, min(shard, len(cuts.iloc[r]) - 1), int(at[i]), int(begin[i]), int(stop[i])))
    return out


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def mixed_texts(docs: DataFrame, n_shards: int = 24, seed: int = 11) -> DataFrame:
    """The mix itself: a row for each epoch in which words of a document are taken, with the columns of ``docs``.

    A document taken whole keeps its text as it is; else the text is cut to the words taken, in order. n_chars, where
    there is one, follows the text; all other columns, whatever their names, stay. Rows are shuffled within hashed
    stretches of their first shard. A null text has no words, so its row is never taken; rows that repeat are each
    mixed; no rows give none.
    """
    names = docs.columns
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), word_count().alias("size"), "doc_id", "source")
    # rows without a doc_id get a number, which is written so that it stays; the others are told apart as they are
    unnamed = written(rows.filter("doc_id is null").withColumn("number", F.monotonically_increasing_id()), "unnamed")
    rows = rows.filter("doc_id is not null").withColumn("number", F.lit(None).cast("long")).unionByName(unnamed)
    stretches = max(1, -(-docs.count() // (n_shards * ROWS_PER_BUCKET)))
    rows = mix(rows, n_shards, seed).filter(F.size("spans") > 0)
    rows = rows.select("doc", "number", "size", F.explode(F.array_distinct(F.transform("spans", lambda s: s["epoch"]))).alias("epoch"), "spans")
    own = F.filter("spans", lambda s: s["epoch"] == F.col("epoch"))
    rows = rows.withColumn("own", F.array_sort(F.transform(own, lambda s: F.struct(s["begin"], s["end"], s["shard"], s["draw"]))))

    @F.pandas_udf("string")
    def cut(text: pd.Series, size: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for t, n, own in zip(text, size, spans, strict=True):
            if sum(s["end"] - s["begin"] for s in own) < n:
                at = [m.span() for m in re.finditer(WORDS, t)]
                t = " ".join(t[at[s["begin"]][0] : at[s["end"] - 1][1]] for s in own)
            out.append(t)
        return pd.Series(out, dtype=object)

    shard, order = F.col("own")[0]["shard"], F.xxhash64(F.lit(seed), "doc.doc_id", "number", "epoch")
    rows = rows.select("doc", cut("doc.text", "size", "own").alias("text"), shard.alias("shard"), order.alias("order"))
    rows = rows.repartition("shard", F.pmod("order", F.lit(stretches))).sortWithinPartitions("shard", "order")
    new = {"text": F.col("text")}
    if "n_chars" in names:
        new["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in names])


def op6_hypergeometric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed: doc_id, size, source_size, target, taken, and the spans that each shard gets."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size"), F.monotonically_increasing_id().alias("number"))
    return mix(written(docs, "word-counts")).select("doc_id", "size", "source_size", "target", "taken", "spans")
