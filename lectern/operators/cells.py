"""A stored index of vectors: cells of near ones, each a partition with a centre and a radius, searched by bounds.

A product with any vector of a cell is at most the product with its centre plus the query's length times the radius. So
a query reads its cells in order of that bound, and none whose bound is below the k-th best that it has found: exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.vectors import MOST_CENTRES, QUERIES_AT_ONCE, VECTORS_AT_ONCE, Best, _block_of
from lectern.operators.relational import written

#: Vectors of a cell, about; cells that a query reads first, and with each further wave so many times more.
CELL_ROWS, FIRST_CELLS, MORE = 1024, 2, 8


class Cells(NamedTuple):
    """vectors (cell, id, v, grp), partitioned by cell; and, for each cell, centre, radius and number of vectors."""

    vectors: DataFrame
    names: np.ndarray
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray


class Found(NamedTuple):
    """The rows found, the vectors that were read for a query (summed over queries), and what a full scan reads."""

    rows: DataFrame
    read: int
    full: int


def write_cells(vectors: DataFrame, path: str, key: str = "vec_id", vector: str = "embedding", group: str | None = None, cell_rows: int = CELL_ROWS) -> Cells:
    """Store ``vectors`` under ``path`` by cells. Centres are vectors of a sample of at most MOST_CENTRES in order of a hash; every vector is indexed. Null vectors are left out."""
    spark, vectors = vectors.sparkSession, vectors.filter(F.col(vector).isNotNull())
    n = vectors.count()
    sample = vectors.select(vector).orderBy(F.xxhash64(vector)).limit(min(MOST_CENTRES, max(1, -(-n // cell_rows)))).collect()
    centres = np.unique(np.array([r[0] for r in sample], np.float64), axis=0) if sample else np.zeros((1, 1))

    @F.pandas_udf("struct<cell:int,away:double>")
    def placed(v: pd.Series) -> pd.DataFrame:
        cell, away = _block_of(v, centres) if len(v) else ([], [])
        return pd.DataFrame({"cell": np.asarray(cell, np.int32), "away": np.asarray(away, np.float64)})

    grp = (F.col(group) if group else F.lit(0)).cast("long")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), grp.alias("grp"), placed(vector).alias("at"))
    # a cell may hold any share of all vectors, so rows are dealt by id within it, as many files as it fills
    rows = rows.select("id", "v", "grp", "at.cell", "at.away").repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8)))
    rows.write.partitionBy("cell").parquet(f"{path}/vectors")
    stored = spark.read.schema("id long, v array<double>, grp long, away double, cell int").parquet(f"{path}/vectors")
    stored.groupBy("cell").agg(F.max("away").alias("radius"), F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/sizes")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").write.parquet(f"{path}/centres")
    return open_cells(spark, path)


def open_cells(spark: SparkSession, path: str) -> Cells:
    """The cells under ``path``; at most MOST_CENTRES rows come to the driver."""
    rows = spark.read.parquet(f"{path}/sizes").join(spark.read.parquet(f"{path}/centres"), "cell").orderBy("cell").collect()
    kind = dict(spark.read.parquet(f"{path}/vectors").dtypes)["v"] if rows else "array<double>"
    vectors = spark.read.schema(f"id long, v {kind}, grp long, away double, cell int").parquet(f"{path}/vectors").drop("away")
    arrays = [np.array([r[c] for r in rows], t) for c, t in (("cell", np.int64), ("centre", np.float64), ("radius", np.float64), ("n", np.int64))]
    return Cells(vectors, *arrays)


def _scan(cells: Cells, plan: np.ndarray, ids: np.ndarray, matrix: np.ndarray, groups: np.ndarray | None, k: int, least: np.ndarray) -> DataFrame:
    """The best ``k`` of each query in each task's part of the cells that ``plan`` (query, cell) tells it to read, none below the query's ``least``."""
    meets = {int(name): np.flatnonzero(plan[:, j]) for j, name in enumerate(cells.names) if plan[:, j].any()}

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Best(len(ids), k)
        held.least = least - 1e-11
        for batch in batches:
            for cell, rows in batch.groupby("cell", sort=False):
                some, names, v, grp = meets[int(cell)], rows["id"].to_numpy(), np.stack(rows["v"].to_list()).astype(np.float64), rows["grp"].to_numpy()
                for lo in range(0, len(rows), VECTORS_AT_ONCE):
                    scores = matrix[some] @ v[lo : lo + VECTORS_AT_ONCE].T
                    if groups is not None:
                        scores = np.where(groups[some][:, None] == grp[None, lo : lo + VECTORS_AT_ONCE], scores, -np.inf)
                    held.see(some, names[lo : lo + VECTORS_AT_ONCE], scores)
        number, found, scores = held.rows()
        yield pd.DataFrame({"query": ids[number], "id": found, "cosine": scores})

    return cells.vectors.filter(F.col("cell").isin(list(meets))).select("cell", "id", "v", "grp").mapInPandas(best, "query long, id long, cosine double")


def nearest_in_cells(cells: Cells, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", group: str | None = None, queries_at_once: int = QUERIES_AT_ONCE) -> Found:
    """For each of a stated set of queries the ``k`` vectors of highest product, ties by id: rows (query, id, cosine, rank).

    With ``group`` a query sees only vectors of its own (that the index was written with). Queries go in blocks; a
    block's bounds, and its k-th scores, are what the driver holds.
    """
    total, out, read = queries.count(), None, 0
    parts = max(1, -(-total // queries_at_once))
    for part in range(parts):
        some = queries.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == part) if parts > 1 else queries
        rows = some.select(key, vector, (F.col(group) if group else F.lit(0)).cast("long").alias("g")).filter(F.col(vector).isNotNull()).orderBy(key).collect()  # a block of queries
        ids, matrix = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)
        if not len(ids) or not len(cells.names):
            continue
        groups = np.array([-1 if r[2] is None else r[2] for r in rows]) if group else None
        bound = matrix @ cells.centres.T + np.sqrt((matrix * matrix).sum(1))[:, None] * cells.radii + 1e-9
        turn = np.argsort(np.argsort(-bound, axis=1), axis=1)
        done, least, limit, found = np.zeros(bound.shape, bool), np.full(len(ids), -np.inf), FIRST_CELLS, None
        while True:
            plan = ~done & (turn < limit) & (bound >= least[:, None])
            if plan.any():
                here = written(_scan(cells, plan, ids, matrix, groups, k, least), "cell-hits")
                found, done, read = here if found is None else found.unionByName(here), done | plan, read + int((plan @ cells.sizes).sum())
                place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "id"))
                kth = found.withColumn("p", place).filter(F.col("p") == k).select("query", "cosine").collect()  # a row a query of the block
                at = {q: s for q, s in kth}
                least = np.array([at.get(int(q), -np.inf) for q in ids])
            if limit >= bound.shape[1]:
                break
            limit *= MORE
        if found is not None:
            out = found if out is None else out.unionByName(found)
    if out is None:
        out = queries.sparkSession.createDataFrame([], "query long, id long, cosine double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "id"))
    return Found(out.withColumn("rank", rank).filter(F.col("rank") <= k), read, total * int(cells.sizes.sum()))
