"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Equal texts form a group that stays in one shard. The heavy groups, of bounded number, are packed first, all at once:
largest first, each going where the dot product of its (bytes, tokens, rows) with the shards' residual capacity is
highest. The others are dealt by hash into blocks of bounded size, and each block is packed in the same way into its
part of the capacity that the heavy groups left. A block ends as even as its smallest groups, so the sum over any
number of blocks stays even, and no task or driver sees all groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import table, text_bytes, written

WORDS = r"[^\x20\x09-\x0D]+"
#: Groups that one task packs.
GROUPS_PER_BLOCK = 8192
#: A group above a whole shard is split into pieces of about this part of one.
SPLIT = 16
#: A group above 1 / SPLIT of a block's part of a shard is packed before the blocks, which can't make up for it; but none
#: below 1 / HEAVY of a shard, so these are fewer than HEAVY * n_shards, with fewer than SPLIT * n_shards more by splitting.
HEAVY = 1024
#: How much each measure counts in the dot product, for the larger groups and for the smallest TAIL of them: bytes are
#: the law, so the smallest groups, which alone can even them out, go by bytes.
WEIGHTS, TAIL_WEIGHTS, TAIL = (1.0, 0.05, 0.05), (1.0, 0.0005, 0.0005), 0.4


def digests(docs: DataFrame, *keep: str) -> DataFrame:
    """Per row, without its text, and with the columns ``keep``: size (UTF-8 bytes plus 8), tokens (words), text_crc32, text_hash (null for null texts), row.

    Write them before they are used: ``row`` numbers the rows, so that rows without a doc_id, or with one in common, part.
    """
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (text_bytes() + 8).alias("size"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("tokens"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("text_hash"),
        F.monotonically_increasing_id().alias("row"),
        *keep,
    )


def pack(sizes: np.ndarray, n_shards: int, weights=WEIGHTS, tail_weights=TAIL_WEIGHTS, tail: float = TAIL, capacity: np.ndarray | None = None) -> np.ndarray:
    """A shard for each row of ``sizes`` (bytes, tokens, rows): largest first, where the dot product with residual capacity is highest.

    ``capacity`` is what each shard has left of each measure; without it shards share the sum of ``sizes`` alike.
    """
    if capacity is None:
        capacity = np.tile(sizes.sum(0) / n_shards, (n_shards, 1))
    mean = np.maximum(capacity.mean(0), 1e-12)
    items, left = sizes / mean, capacity / mean
    out = np.zeros(len(sizes), np.int32)
    order = np.lexsort((np.arange(len(sizes)), -sizes[:, 1], -sizes[:, 0]))
    turn = int(len(order) * (1 - tail))
    for scale, some in ((weights, order[:turn]), (tail_weights, order[turn:])):
        scaled = items * np.asarray(scale)
        for i in some:
            s = out[i] = int((left @ scaled[i]).argmax())
            left[s] -= items[i]
    return out


def left_over(load: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Of each measure what each shard should get of the rest, so that ``load`` and rest, ``total`` in all, are as even as can be."""
    out = np.zeros_like(load)
    for k in range(load.shape[1]):
        have = np.sort(load[:, k])
        rest = max(0.0, total[k] - have.sum())
        level = (rest + np.cumsum(have)) / np.arange(1, len(have) + 1)  # with the lowest 1, 2, ... shards filled up
        n = int((have <= level).sum())  # shards above the level get nothing
        out[:, k] = np.maximum(0.0, level[n - 1] - load[:, k])
    return out


def _heavy(rows: DataFrame, groups: DataFrame, totals: np.ndarray, n_shards: int, parts: int) -> tuple[DataFrame | None, np.ndarray]:
    """(group_key, shards of its pieces) of the groups above 1 / ``parts`` of a shard, or None; and the shards' load of them."""
    share = totals[0] / n_shards
    found = groups.filter(F.col("b") > share / parts).orderBy("group_key").collect()  # fewer than parts * n_shards, whatever the input
    load = np.zeros((n_shards, 3))
    if not found:
        return None, load
    spark = rows.sparkSession
    pieces = {r["group_key"]: -int(-r["b"] * SPLIT // share) if r["b"] > share else 1 for r in found}
    sizes = {(r["group_key"], 0): (r["b"], r["t"], r["r"]) for r in found if pieces[r["group_key"]] == 1}
    split = spark.createDataFrame([(k, n) for k, n in pieces.items() if n > 1], "group_key long, pieces int")
    cut = rows.join(F.broadcast(split), "group_key").groupBy("group_key", _piece().alias("piece"))
    if len(sizes) < len(pieces):
        for r in cut.agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("r")).collect():
            sizes[r["group_key"], r["piece"]] = r["b"], r["t"], r["r"]
    units = sorted(sizes)
    sized = np.array([sizes[u] for u in units], np.float64)
    to = pack(sized, n_shards, tail=0.0, capacity=np.tile(totals / n_shards, (n_shards, 1)))
    np.add.at(load, to, sized)
    shard = {u: int(s) for u, s in zip(units, to, strict=True)}
    return spark.createDataFrame([(k, n, [shard.get((k, i), 0) for i in range(n)]) for k, n in pieces.items()], "group_key long, pieces int, shards array<int>"), load


def _piece() -> Column:
    return F.pmod(F.xxhash64("doc_id", "row"), F.col("pieces")).cast("int")


def assign(rows: DataFrame, n_shards: int = 24, groups_per_block: int = GROUPS_PER_BLOCK) -> DataFrame:
    """``rows`` (with the columns of ``digests``) with shard and slot (gapless from 0 in each shard).

    Rows of equal texts share a shard, unless they have more bytes than an even shard: then they are salted into pieces of
    bounded size by doc_id and row. Null texts are a group of their own of size 8 each. Rows that repeat are each placed. An empty table gives no rows.
    """
    rows = rows.withColumn("group_key", F.xxhash64(F.coalesce("text_hash", F.lit(-1)), "size"))
    groups = written(rows.groupBy("group_key").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("r")), "groups")
    all_ = groups.agg(F.sum("b").alias("b"), F.sum("t").alias("t"), F.sum("r").alias("r"), F.count(F.lit(1)).alias("n")).first()
    n, totals = all_["r"] or 0, np.array([all_["b"] or 0, all_["t"] or 0, all_["r"] or 0], np.float64)
    n_blocks = max(1, -(-all_["n"] // groups_per_block))
    heavy, load = _heavy(rows, groups, totals, n_shards, min(HEAVY, SPLIT * n_blocks) if n_blocks > 1 else 1)
    rest = left_over(load, totals)
    light, placed = rows, None
    if heavy is not None:
        placed = rows.join(F.broadcast(heavy), "group_key").withColumn("shard", F.col("shards")[_piece()]).drop("pieces", "shards")
        keys = F.broadcast(heavy.select("group_key"))
        light, groups = rows.join(keys, "group_key", "left_anti"), groups.join(keys, "group_key", "left_anti")
    groups = groups.withColumn("block", F.pmod(F.xxhash64("group_key", F.lit(7)), F.lit(n_blocks)).cast("int"))

    def packed(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("group_key", kind="stable")
        turn = int(block["block"].iloc[0]) % n_shards  # so that no shard is always the first
        sizes = block[["b", "t", "r"]].to_numpy(np.float64)
        part = np.roll(rest, -turn, 0) * (sizes.sum(0) / np.maximum(rest.sum(0), 1e-12))
        return pd.DataFrame({"group_key": block["group_key"].to_numpy(), "shard": (pack(sizes, n_shards, capacity=part) + turn) % n_shards})

    shards = groups.groupBy("block").applyInPandas(packed, "group_key long, shard int")
    light = light.join(shards, "group_key")
    every = light if placed is None else light.unionByName(placed)
    return slots(every.drop("group_key"), n, n_shards)


def slots(rows: DataFrame, n: int, n_shards: int) -> DataFrame:
    """Number the rows of each shard from 0, by hashed stretches of bounded size and a running sum over their counts."""
    stretches = max(1, -(-n // (n_shards * 4096)))
    rows = rows.withColumn("stretch", F.pmod(F.xxhash64("doc_id", "row", F.lit(3)), F.lit(stretches)).cast("int"))
    counts = rows.groupBy("shard", "stretch").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "stretch").orderBy(F.asc_nulls_first("doc_id"), "text_crc32", "size", "row")
    rows = rows.withColumn("place", F.row_number().over(inside) - 1).join(base, ["shard", "stretch"])
    return rows.withColumn("slot", (F.col("base") + F.col("place")).cast("long")).drop("base", "place", "stretch")


def shard_files(docs: DataFrame, path: str, n_shards: int = 24) -> None:
    """Write ``docs`` (doc_id, text and any others) with shard and slot to ``path``, a folder a shard.

    Rows meet their shard by doc_id and text, so rows that repeat may trade slots. A file holds a run of slots. Columns of
    ``docs`` named shard or slot are an error, for a file can't have two of a name.
    """
    names = docs.columns
    if {"shard", "slot"} & {c.lower() for c in names}:
        raise ValueError("rename the columns shard and slot before writing shards")
    placed = assign(written(digests(docs), "digests"), n_shards).select("doc_id", "text_hash", "shard", "slot")
    twin = Window.partitionBy("doc_id", "text_hash").orderBy("slot")
    placed = placed.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h"), F.row_number().over(twin).alias("k"), "shard", "slot")
    own = docs.select(*names, F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("_hash"))
    own = own.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "_hash").orderBy(F.lit(0))))
    out = own.join(placed, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("_hash").eqNullSafe(F.col("h")) & (F.col("_k") == F.col("k")))
    out.select(*names, "shard", "slot").repartition("shard", F.floor(F.col("slot") / 65536)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op2_vector_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23, law ``bytes``, by vector bin packing of groups of equal texts."""
    placed = assign(written(digests(table(spark, sf_dir, "documents")), "digests"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")
