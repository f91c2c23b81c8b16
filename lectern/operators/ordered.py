"""Operators on order within a group: ranks, islands, round robin, caps, budgets, fills, samples.

All windows are partitioned; a global order is used only with a limit, which Spark runs as a top-k.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def leaderboard(entries: DataFrame, board: str, score: str, at: str, top: int = 10, own: Column | None = None) -> DataFrame:
    """The ``top`` rows of each board, and those that are the viewer's ``own``, with competition ranks (1, 1, 3); ties show by time."""
    by_score = Window.partitionBy(board).orderBy(F.desc(score))
    shown = Window.partitionBy(board).orderBy(F.desc(score), at, *[c for c in entries.columns if c not in (board, score, at)])
    return entries.withColumn("rank", F.rank().over(by_score)).withColumn("place", F.row_number().over(shown)).filter((F.col("place") <= top) | (F.lit(False) if own is None else own))


def masked(name: Column) -> Column:
    """First and last letter of a name; of one or two letters only the first."""
    return F.concat(F.left(name, F.lit(1)), F.lit("•••"), F.when(F.length(name) > 2, F.right(name, F.lit(1))).otherwise(""))


def mid_rank(entries: DataFrame, board: str, score: str, least: int = 3) -> DataFrame:
    """Rank, candidates and mid-rank percentile in each board; the percentile is null below ``least`` candidates."""
    w = Window.partitionBy(board)
    below = F.rank().over(w.orderBy(score)) - 1
    ties = F.count(F.lit(1)).over(Window.partitionBy(board, score))
    n = F.count(F.lit(1)).over(w)
    return entries.withColumn("rank", F.rank().over(w.orderBy(F.desc(score)))).withColumn("candidates", n).withColumn("percentile", F.when(n >= least, F.rint(F.lit(100.0) * (below + F.lit(0.5) * ties) / n)))


def streaks(days: DataFrame, frozen: DataFrame | None = None) -> DataFrame:
    """Best and current streak from kept (user_id, day): the current one ends on the last day of all data or the day before.

    Days that a freeze repaired (``frozen``) keep a streak as practised ones do.
    """
    days = days.distinct() if frozen is None else days.unionByName(frozen).distinct()
    island = F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day")).cast("int"))
    runs = days.withColumn("island", island).groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("run"), F.max("day").alias("ends"))
    today = days.agg(F.max("day").alias("today"))
    current = F.max(F.when(F.col("ends") >= F.date_sub("today", 1), F.col("run")))
    return runs.join(F.broadcast(today)).groupBy("user_id").agg(F.max("run").alias("best"), F.coalesce(current, F.lit(0)).alias("current"))


def freezes(days: DataFrame) -> DataFrame:
    """Days that a freeze would repair: missed, the day before kept, the day after kept."""
    after = F.lead("day").over(Window.partitionBy("user_id").orderBy("day"))
    return days.distinct().withColumn("after", after).filter(F.datediff("after", "day") == 2).select("user_id", F.date_add("day", 1).alias("day"))


def first_of_group(df: DataFrame, key: Column, *order: Column | str) -> DataFrame:
    """One row of each group, the first by ``order``."""
    return df.withColumn("_key", key).withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy(*order))).filter("_n = 1").drop("_key", "_n")


def round_robin(df: DataFrame, group: str, order: list[Column | str], n: int) -> DataFrame:
    """``n`` rows, one of each group in turn (groups by name); each group is cut to ``n`` before the last top-k."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= n).orderBy("turn", group).limit(n)


def fair_split(buckets: DataFrame, n: int) -> DataFrame:
    """``n`` shared out among (bucket, available), one at a time in turn by name: bucket, given. Buckets that get nothing are left out.

    Without a row for each seat: sums over the distinct capacities (``n`` at most) give the level to which all buckets
    are filled, and the first buckets by name that have more take what is left.
    """
    caps = buckets.select("bucket", F.least(F.greatest(F.coalesce("available", F.lit(0)), F.lit(0)), F.lit(n)).cast("long").alias("c"))
    w = Window.orderBy("c")
    steps = caps.groupBy("c").agg(F.count(F.lit(1)).alias("m")).withColumn("below", F.sum(F.col("c") * F.col("m")).over(w)).withColumn("above", F.sum("m").over(Window.partitionBy()) - F.sum("m").over(w))
    full = steps.withColumn("filled", F.col("below") + F.col("above") * F.col("c"))
    row = full.filter(F.col("filled") <= n).orderBy(F.desc("c")).first()
    level, spare, above = (row["c"], n - row["filled"], row["above"]) if row else (0, n, caps.count())
    level, more = (level + spare // above, spare % above) if above else (level, 0)
    extra = caps.filter(F.col("c") > level).orderBy("bucket").limit(more).select("bucket", F.lit(1).alias("extra"))
    given = F.least(F.col("c"), F.lit(level)) + F.coalesce("extra", F.lit(0))
    return caps.join(extra, "bucket", "left").select("bucket", given.alias("given")).filter("given > 0")


def diverse(ranked: DataFrame, n: int, margin: float = 4.0, cap: int = 2, floor: float = -7.0) -> DataFrame:
    """Of (query_id, book, rank, score) ``n`` rows a query: first each book's best within ``margin`` of the top, then by rank
    at most ``cap`` a book, then by rank. Rows under ``floor`` never count. Rank order is kept."""
    ok = ranked.filter(F.col("score") >= floor)
    by_query, by_book = Window.partitionBy("query_id"), Window.partitionBy("query_id", "book")
    ok = ok.withColumn("near", F.col("score") >= F.max("score").over(by_query) - margin)
    first = F.min(F.when(F.col("near"), F.col("rank"))).over(by_book)
    ok = ok.withColumn("lead", F.coalesce(F.col("rank") == first, F.lit(False))).withColumn("led", first.isNotNull().cast("int"))
    later = F.sum(F.when(F.col("lead"), 0).otherwise(1)).over(by_book.orderBy("rank"))
    tier = F.when(F.col("lead"), 0).when(later <= cap - F.col("led"), 1).otherwise(2)
    place = F.row_number().over(by_query.orderBy("tier", "rank"))
    return ok.withColumn("tier", tier).withColumn("place", place).filter(F.col("place") <= n).select("query_id", "book", "rank", "score", "tier")


def prefix_budget(df: DataFrame, group: str, order: str, size: str, budget: int) -> DataFrame:
    """Rows of each group in order until the first that would exceed ``budget``."""
    return df.withColumn("used", F.sum(size).over(Window.partitionBy(group).orderBy(order))).filter(F.col("used") <= budget)


def filled_forward(df: DataFrame, group: str, order: str, column: str) -> DataFrame:
    """``column`` with nulls taken from the last row before that has one."""
    return df.withColumn(column, F.last(column, ignorenulls=True).over(Window.partitionBy(group).orderBy(order)))


def merged_intervals(df: DataFrame, key: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Unions of overlapping or touching intervals: key, lo, hi."""
    w = Window.partitionBy(key).orderBy(lo, hi)
    reach = F.max(hi).over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = df.withColumn("_new", F.when(F.col(lo) > reach, 1).when(reach.isNull(), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(w))
    return out.groupBy(key, "_island").agg(F.min(lo).alias("lo"), F.max(hi).alias("hi")).drop("_island")


def hash_order(*columns: str, seed: str = "7") -> Column:
    """A repeatable random order: the same in any engine with md5."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in columns]))


def sample(df: DataFrame, key: str, n: int, seed: str = "7") -> DataFrame:
    return df.orderBy(hash_order(key, seed=seed), key).limit(n)


def weighted_sample(df: DataFrame, key: str, weight: str, n: int, seed: str = "7") -> DataFrame:
    """``n`` rows without replacement, likelier with higher weight: the least -ln(u) / max(weight, 1)."""
    u = (F.conv(F.substring(hash_order(key, seed=seed), 1, 8), 16, 10).cast("double") + 1) / 4294967297.0
    return df.withColumn("draw", F.round(-F.ln(u) / F.greatest(F.col(weight).cast("double"), F.lit(1.0)), 9)).orderBy("draw", key).limit(n)


def distinct_by_group(df: DataFrame, key: Column, order: list[Column | str], n: int) -> DataFrame:
    """The first row of each group, the groups in order of that row, ``n`` of them."""
    return first_of_group(df, key, *order).orderBy(*order).limit(n)


def rising(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Rows of the longest chain of strictly rising values in each group; of several such chains one whose values are least.

    A group is one book's pages: its chain is found in a task by patience sorting.
    """

    def chain(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order, kind="stable")
        values = part[value].tolist()
        ends, last, before = [], [], []
        for i, v in enumerate(values):
            k = bisect.bisect_left(ends, v)
            ends[k : k + 1], last[k : k + 1] = [v], [i]
            before.append(last[k - 1] if k else -1)
        keep, i = [], last[-1] if last else -1
        while i >= 0:
            keep.append(i)
            i = before[i]
        return part.iloc[keep[::-1]]

    return rows.groupBy(group).applyInPandas(chain, rows.schema)


def joined_boxes(boxes: DataFrame, same: float = 0.006, gap: float = 0.03) -> DataFrame:
    """Boxes (page, x0, y0, x1, y1) of one line that touch or nearly touch as one: a row a line segment."""
    line = Window.partitionBy("page").orderBy(F.round("y0", 2), "x0", "x1", "y0", "y1")
    apart = (F.abs(F.col("y0") - F.lag("y0").over(line)) >= same) | (F.abs(F.col("y1") - F.lag("y1").over(line)) >= same)
    rows = boxes.withColumn("_line", F.sum(F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0)).over(line))
    inside = Window.partitionBy("page", "_line").orderBy("x0", "x1")
    reach = F.max("x1").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(F.coalesce(F.col("x0") - reach >= gap, F.lit(True)), 1).otherwise(0)).withColumn("_segment", F.sum("_new").over(inside))
    first = F.min_by("y0", "x0").alias("y0"), F.min_by("y1", "x0").alias("y1")
    return rows.groupBy("page", "_line", "_segment").agg(F.min("x0").alias("x0"), first[0], F.max("x1").alias("x1"), first[1]).drop("_line", "_segment")
