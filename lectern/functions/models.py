"""What models are to the library: a scorer of (query, passage) pairs and an encoder of texts, given by the caller and run by batch in tasks."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Fixed value: what stands before a query, but not before a passage, when it is encoded.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


class Scorer(Protocol):
    def __call__(self, queries: list[str], passages: list[str]) -> np.ndarray:
        """A score for each pair."""


class Encoder(Protocol):
    def __call__(self, texts: list[str]) -> np.ndarray:
        """A row of unit length for each text."""


def encoded(df: DataFrame, make: Callable[[], Encoder], text: str = "text", name: str = "embedding", prefix: str = "") -> DataFrame:
    """``df`` with the vector of ``prefix`` and ``text``; null texts have none. ``make`` runs once a batch in a task: let it keep what it loads."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vector(texts: pd.Series) -> pd.Series:
        there = texts.notna()
        out = pd.Series([None] * len(texts), dtype=object)
        if there.any():
            rows = make()([prefix + t for t in texts[there]])
            out[there.to_numpy()] = pd.Series([r.astype("float32") for r in np.asarray(rows)], index=out.index[there.to_numpy()])
        return out

    return df.withColumn(name, vector(text))


def scored_pairs(pairs: DataFrame, make: Callable[[], Scorer]) -> DataFrame:
    """``pairs`` (query, text) with the scorer's ``score``."""

    @F.pandas_udf(T.DoubleType())
    def score(query: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(make()(query.fillna("").tolist(), text.fillna("").tolist()), np.float64)) if len(query) else pd.Series([], dtype="float64")

    return pairs.withColumn("score", score("query", "text"))


def reranked_best(pairs: DataFrame, make: Callable[[], Scorer]) -> DataFrame:
    """(query_id, parent, score, rank): each passage by its best score over the wordings of a query (several ``query`` of one query_id)."""
    best = scored_pairs(pairs, make).groupBy("query_id", "parent").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "parent")))
