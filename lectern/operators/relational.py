"""Filters, facets, semi-joins, grouping sets, dedupe routing and upserts as DataFrame operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def not_in_or_null(column: str, values: list) -> Column:
    """NOT IN that keeps nulls."""
    return F.col(column).isNull() | ~F.col(column).isin(values)


def with_facets(items: DataFrame, tags: DataFrame, key: str, chosen: dict[str, list]) -> DataFrame:
    """Items with any chosen label on every chosen axis of (key, axis, label): one semi-join an axis."""
    for axis, labels in chosen.items():
        items = items.join(tags.filter((F.col("axis") == axis) & F.col("label").isin(labels)).select(key), key, "left_semi")
    return items


def facet_counts(df: DataFrame, chosen: dict[str, list]) -> DataFrame:
    """(axis, label, n): each axis counted under the choices on all other axes. One pass: a row is kept by each axis it may count for."""
    fits = {a: F.col(a).isin(v) for a, v in chosen.items()}
    rows = []
    for axis in chosen:
        others = F.lit(True)
        for a, ok in fits.items():
            if a != axis:
                others = others & ok
        rows.append(F.when(others, F.struct(F.lit(axis).alias("axis"), F.col(axis).cast("string").alias("label"))))
    return df.select(F.explode(F.array_compact(F.array(*rows))).alias("f")).groupBy("f.axis", "f.label").agg(F.count(F.lit(1)).alias("n"))


def with_group_members(picked: DataFrame, members: DataFrame, key: str, group: str) -> DataFrame:
    """Keys of ``picked`` and of all members of their groups."""
    groups = members.join(picked, key, "left_semi").select(group).filter(F.col(group).isNotNull()).distinct()
    return picked.select(key).union(members.join(groups, group, "left_semi").select(key)).distinct()


def routed(batch: DataFrame, bank: DataFrame, key: list[str], order: str) -> DataFrame:
    """``batch`` with a route: insert (new key, first in the batch), repeat (later in the batch) or link (the bank has the key)."""
    known = bank.select(*key).distinct().withColumn("_known", F.lit(True))
    n = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    route = F.when(F.col("_known"), "link").when(F.col("_n") > 1, "repeat").otherwise("insert")
    return batch.withColumn("_n", n).join(known, key, "left").withColumn("route", route).drop("_n", "_known")


def upserted(old: DataFrame, new: DataFrame, key: list[str], keep_old: bool = False) -> DataFrame:
    """Old and new rows by key: the new one wins, or the old one where ``keep_old``."""
    winner, loser = (old, new) if keep_old else (new, old)
    return winner.unionByName(loser.join(winner, key, "left_anti"), allowMissingColumns=True)


def remapped(rows: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """``column`` replaced through (old, new); what has no new value becomes null."""
    names = rows.columns
    out = rows.join(mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new")), F.col(column) == F.col("_old"), "left")
    return out.select(*[F.col("_new").alias(c) if c == column else F.col(c) for c in names])


def strided_todo(pages: DataFrame, done: DataFrame, key: str, workers: int) -> DataFrame:
    """Pages not done, with the worker of each."""
    return pages.join(done, key, "left_anti").withColumn("worker", F.pmod(F.col(key), F.lit(workers)))


def positional_zip(left: DataFrame, right: DataFrame, page: str, left_order: str, right_order: str) -> DataFrame:
    """Rows paired by position on pages where both sides have as many rows."""

    def numbered(df: DataFrame, order: str) -> DataFrame:
        return df.withColumn("_n", F.row_number().over(Window.partitionBy(page).orderBy(order))).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(page)))

    return numbered(left, left_order).join(numbered(right, right_order), [page, "_n", "_all"]).drop("_n", "_all")


def scratch(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    A session without one gets a temporary folder if its master is local; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the folder of ``scratch``, read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a part of ``dealt``, about.
PART_ROWS = 250_000


def dealt(rows: DataFrame, *keys: str, count: int | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """``rows`` dealt by ``keys`` to as many parts as their number asks for, so that what sorts a part holds doesn't grow with the table.

    Windows, groups and joins on the keys need no other shuffle. The number is stated, so adaptive execution, which goes
    by compressed bytes, doesn't put parts together. ``count`` saves counting rows that are costly to make.
    """
    n = rows.count() if count is None else count
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // part_rows)), *keys)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of an undirected graph's edges (a, b): nodes of a connected component share a root.

    Each node moves to the neighbour of least hash until no edge is left; new hashes each round shrink chains too.
    """
    edges = written(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    roots, turn = None, 0
    while not edges.isEmpty():
        turn += 1
        ranked = edges.select("a", *[F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("v")).alias(f"r{c}") for c in ("a", "b")])
        moves = written(ranked.groupBy(F.col("a").alias("from")).agg(F.least(F.min("ra"), F.min("rb"))["v"].alias("to")), "moves")
        if roots is None:
            roots = moves.select(F.col("from").alias("node"), F.col("to").alias("root"))
        else:
            roots = written(roots.join(moves, F.col("root") == F.col("from"), "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        a, b = moves.select(F.col("from").alias("a"), F.col("to").alias("x")), moves.select(F.col("from").alias("b"), F.col("to").alias("y"))
        edges = written(edges.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).filter("a <> b").distinct(), "edges")
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def fetched_in_order(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is wanted, with the place (``ord``) that the caller gave each: sort by it to show them."""
    return rows.join(wanted.select(key, "ord"), key)


def id_clashes(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Keys of ``new`` that ``existing`` has: a load goes on only if there are none."""
    return new.join(existing, key, "left_semi").select(key).distinct()


def merged_database(target: DataFrame, source: DataFrame, key: list[str], foreign: dict[str, DataFrame]) -> DataFrame:
    """``target`` and the rows of ``source`` that it lacks by natural ``key``, foreign keys renamed by (old, new) first; those that dangle become null."""
    for column, mapping in foreign.items():
        source = remapped(source, mapping, column)
    return target.unionByName(source.join(target, key, "left_anti").select(*target.columns))


def without_dependents(tables: dict[str, DataFrame], steps: list[tuple[str, str, str, str]], doomed: DataFrame, root: str, key: str = "id") -> dict[str, DataFrame]:
    """``tables`` after rows of ``root`` by ``doomed`` (key) are deleted, with what depends on them: steps (child, column, parent, parent key) in order."""
    gone = {root: tables[root].join(doomed, key, "left_semi")}
    left = dict(tables)
    for child, column, parent, parent_key in steps:
        hit = tables[child].join(gone[parent].select(F.col(parent_key).alias(column)).distinct(), column, "left_semi")
        gone[child] = gone[child].union(hit.select(*tables[child].columns)).distinct() if child in gone else hit
        left[child] = left[child].join(gone[parent].select(F.col(parent_key).alias(column)).distinct(), column, "left_anti").select(*tables[child].columns)
    left[root] = tables[root].join(doomed, key, "left_anti")
    return left


def remapped_ids(ids: Column, mapping: Column, old: Column) -> Column:
    """A list of ids through a map; those that were renewed (``old``) but have no new one go, others stay."""
    moved = F.transform(ids, lambda i: F.struct(F.try_element_at(mapping, i).alias("new"), F.array_contains(old, i).alias("old"), i.alias("id")))
    kept = F.filter(moved, lambda m: m["new"].isNotNull() | ~m["old"])
    return F.transform(kept, lambda m: F.coalesce(m["new"], m["id"]))


def normal_options(options: Column, correct: Column) -> tuple[Column, Column]:
    """(options, key) of a question: letters and texts trimmed, empty ones out; both null unless four are left and the key is one of them."""
    told = F.map_filter(options, lambda k, v: F.trim(F.coalesce(v, F.lit(""))) != "")
    clean = F.transform_values(F.transform_keys(told, lambda k, v: F.upper(F.trim(k))), lambda k, v: F.trim(v))
    key = F.left(F.upper(F.trim(F.coalesce(correct, F.lit("")))), F.lit(1))
    ok = (F.cardinality(clean) >= 4) & F.map_contains_key(clean, key)
    return F.when(ok, clean), F.when(ok, key)


#: Options that name others, and explanations that name options by letter; both keep the order of a file.
NAMES_OPTIONS = r"(?i)\b(all|none|both|neither)\b|\b[a-e]\s*(?:and|&|,)\s*[a-e]\b|\bonly\s+[a-e]\b"
NAMES_LETTERS = r"(?i)\b(?:option|choice|answer)s?\s*\(?[a-e]\)?\b|\([a-e]\)"


def dealt_options(stem: Column, options: Column, correct: Column, explanation: Column) -> tuple[Column, Column]:
    """(options, key) of a question with its options (array) in an order that a hash of the stem and each option gives; ``correct`` counts from 0.

    Where options or the explanation name options, the order stays.
    """
    stays = F.exists(options, lambda o: o.rlike(NAMES_OPTIONS)) | F.coalesce(explanation, F.lit("")).rlike(NAMES_LETTERS)
    keyed = F.array_sort(F.transform(options, lambda o, i: F.struct(F.md5(F.concat_ws("|", stem, o)).alias("h"), i.alias("i"), o.alias("o"))))
    place = F.array_position(F.transform(keyed, lambda k: k["i"]), correct.cast("int")) - 1
    return F.when(stays, options).otherwise(F.transform(keyed, lambda k: k["o"])), F.when(stays, correct.cast("long")).otherwise(place)


def key_spread(before: DataFrame, after: DataFrame, key: str = "key") -> DataFrame:
    """(key, before, after): how often each key occurs in both."""
    one = before.groupBy(key).agg(F.count(F.lit(1)).alias("before"))
    two = after.groupBy(key).agg(F.count(F.lit(1)).alias("after"))
    return one.join(two, key, "full").fillna(0, ["before", "after"])


def counted_and_latest(parents: DataFrame, children: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``parents`` with how many children each has and the ``value`` of the latest, ties to the least value: aggregated first, then joined."""
    by = children.groupBy(key).agg(F.count(F.lit(1)).alias("children"), F.max_by(value, F.struct(F.col(at), -F.col(value))).alias("latest"))
    return parents.join(by, key, "left").fillna(0, ["children"])


def job_grid(spark, **axes: list) -> DataFrame:
    """Every combination of the given values: a stated, small grid."""
    out = None
    for name, values in axes.items():
        kind = "long" if all(isinstance(v, int) for v in values) else "string"
        one = spark.createDataFrame([(v,) for v in values], f"{name} {kind}")
        out = one if out is None else out.crossJoin(one)
    return out
