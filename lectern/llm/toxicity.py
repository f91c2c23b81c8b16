"""Toxicity by classifier chains: each category's linear model also sees the probabilities of the categories before it.

The last category is the label itself. Those before it are kinds of toxic documents that the training rows show: toxic
documents fall into clusters by the words that mark them, and each cluster is a category. Models later in the chain are trained on out-of-fold predictions of earlier ones, as they won't know better
when they score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import is_held_out, labelled_sample, small_batches, table, written
from lectern.llm.words import ALNUM, Words, mixed, rounds

#: Clusters of toxic documents, the larger first, and the label: the order of the chain.
KINDS = 2
CATEGORIES = (*(f"kind_{k}" for k in range(1, KINDS + 1)), "toxic")
#: At most so many labelled documents of either label, and so many features but no more than documents, are learned from.
MOST_LABELLED, MOST_FEATURES = 3000, 4000
FOLDS, STEPS, RATE, PENALTY = 4, 300, 0.2, 1e-3
STEM_BYTES = 5


def _features(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of all words and their stems: hashes of a word and, marked, of its first STEM_BYTES bytes."""
    words = Words(raw, ALNUM)
    long = words.end - words.begin > STEM_BYTES
    first = words.begin[long][:, None] + np.arange(STEM_BYTES)
    stem = np.zeros(int(long.sum()), np.uint64)
    for k in range(STEM_BYTES):
        stem = mixed(stem * np.uint64(3) + words.data[first[:, k]].astype(np.uint64) + np.uint64(1 + 7 * k))
    return np.concatenate([words.doc, words.doc[long]]), np.concatenate([words.hash, stem])


def _presence(raw: list[bytes], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, column) of the chosen features that occur, once each."""
    doc, feature = _features(raw)
    if not len(chosen) or not len(feature):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    spot = np.minimum(np.searchsorted(chosen, feature), len(chosen) - 1)
    hit = chosen[spot] == feature
    both = np.unique(doc[hit] * len(chosen) + spot[hit])
    return both // len(chosen), both % len(chosen)


class Chain:
    def __init__(self, chosen: np.ndarray, models: list[np.ndarray]):
        self.chosen, self.models = chosen, models

    def probabilities(self, raw: list[bytes]) -> np.ndarray:
        doc, column = _presence(raw, self.chosen)
        out = np.zeros((len(raw), len(self.models)))
        for k, w in enumerate(self.models):
            out[:, k] = _predict(w, doc, column, len(raw), out[:, :k], len(self.chosen))
        return out


def _logit(p):
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def _predict(w, doc, column, n, earlier, n_features):
    z = np.bincount(doc, weights=w[column], minlength=n) + w[-1]
    if earlier.shape[1]:
        z = z + _logit(earlier) @ w[n_features:-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(doc, column, n, earlier, n_features, y) -> np.ndarray:
    """Logistic regression with an L2 penalty by Adam; the rarer class weighs as much as the other."""
    w = np.zeros(n_features + earlier.shape[1] + 1)
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    m, v, e = np.zeros_like(w), np.zeros_like(w), _logit(earlier)
    for step in range(1, STEPS + 1):
        left = share * (y - _predict(w, doc, column, n, earlier, n_features))
        g = -PENALTY * w
        g[:n_features] += np.bincount(column, weights=left[doc], minlength=n_features)
        g[n_features:-1] += e.T @ left
        g[-1] += left.sum() + PENALTY * w[-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def fit_chain(doc: np.ndarray, column: np.ndarray, targets: np.ndarray, fold: np.ndarray, chosen: np.ndarray) -> Chain:
    """A chain over the rows of ``targets`` [text, category]; ``fold`` names each text's fold."""
    n, k = targets.shape
    seen, models = np.zeros((n, 0)), []
    for c in range(k):
        models.append(_fit(doc, column, n, seen, len(chosen), targets[:, c]))
        apart = np.zeros(n)
        for f in range(FOLDS):
            out, rest = np.flatnonzero(fold == f), np.flatnonzero(fold != f)
            place = np.full(n, -1)
            place[rest] = np.arange(len(rest))
            inside = place[doc] >= 0
            w = _fit(place[doc[inside]], column[inside], len(rest), seen[rest], len(chosen), targets[rest, c])
            place[:] = -1
            place[out] = np.arange(len(out))
            inside = place[doc] >= 0
            apart[out] = _predict(w, place[doc[inside]], column[inside], len(out), seen[out], len(chosen))
        seen = np.hstack([seen, apart[:, None]])
    return Chain(chosen, models)


def clusters(doc: np.ndarray, column: np.ndarray, toxic: np.ndarray, n_features: int, kinds: int = KINDS, turns: int = 25) -> np.ndarray:
    """The cluster of each toxic text, larger ones first; -1 for the others. Spherical k-means on the features that toxic texts have more often.

    It begins with the text nearest to the mean and goes on with the ones least near to those before, so it is repeatable.
    """
    out = np.full(len(toxic), -1)
    rows = np.flatnonzero(toxic == 1)
    if not len(rows):
        return out
    place = np.full(len(toxic), -1)
    place[rows] = np.arange(len(rows))
    pos = np.bincount(column[place[doc] >= 0], minlength=n_features)
    neg = np.bincount(column[place[doc] < 0], minlength=n_features)
    weight = np.maximum(0.0, np.log((pos + 0.5) / (len(rows) + 1)) - np.log((neg + 0.5) / (len(toxic) - len(rows) + 1)))
    x = np.zeros((len(rows), n_features), np.float32)
    inside = place[doc] >= 0
    x[place[doc[inside]], column[inside]] = weight[column[inside]]
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centres = [x[int((x @ x.mean(0)).argmax())]]
    while len(centres) < kinds:
        centres.append(x[int((x @ np.stack(centres).T).max(1).argmin())])
    centre = np.stack(centres)
    for _ in range(turns):
        own = (x @ centre.T).argmax(1)
        sums = np.stack([x[own == k].sum(0) for k in range(kinds)])
        centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    order = np.argsort(-np.bincount(own, minlength=kinds), kind="stable")
    out[rows] = np.argsort(order)[own]
    return out


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, most_features: int = MOST_FEATURES) -> Chain:
    """The chain from at most ``most`` documents of either label, none held out. Without both labels nothing is toxic."""
    small_batches(docs.sparkSession)
    sample = written(labelled_sample(docs, labels, "toxic", most), "sample")

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo, hi, raw in rounds(batch["text"].tolist()):
                doc, feature = _features(raw)
                both = np.unique(np.stack([feature, doc.astype(np.uint64)], 1), axis=0)
                yield pd.DataFrame({"feature": both[:, 0].astype(np.int64), "toxic": batch["toxic"].to_numpy()[lo:hi][both[:, 1].astype(np.int64)]})

    df = sample.mapInPandas(explode, "feature long, toxic int").groupBy("feature").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
    sizes = sample.agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")).first()
    if not sizes["pos"] or not sizes["neg"]:
        return Chain(np.zeros(0, np.uint64), [np.array([-20.0]) if k == 0 else np.append(np.zeros(k), -20.0) for k in range(len(CATEGORIES))])
    gap = F.abs(F.col("pos") / sizes["pos"] - F.col("neg") / sizes["neg"])
    noise = F.sqrt((F.col("pos") + F.col("neg") + 1.0) / (sizes["pos"] + sizes["neg"]))
    most_features = min(most_features, sizes["pos"] + sizes["neg"])  # more features than documents would be learned by heart
    best = df.filter("pos + neg >= 3").select("feature", (gap / noise).alias("weight")).orderBy(F.desc("weight"), "feature").limit(most_features)
    columns = np.sort(best.toPandas()["feature"].to_numpy(np.int64).astype(np.uint64))
    held = docs.sparkSession.sparkContext.broadcast(columns)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo, hi, raw in rounds(batch["text"].tolist()):
                doc, column = _presence(raw, held.value)
                edges = np.searchsorted(doc, np.arange(len(raw) + 1))
                yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[lo:hi], "toxic": batch["toxic"].to_numpy()[lo:hi], "columns": [column[a:b] for a, b in zip(edges, edges[1:], strict=False)]})

    got = sample.mapInPandas(rows, "doc_id long, toxic int, columns array<long>").toPandas()
    got = got.sort_values(["doc_id", "toxic"], kind="stable").reset_index(drop=True)
    doc = np.repeat(np.arange(len(got)), got["columns"].map(len))
    column = np.concatenate([np.asarray(c, np.int64) for c in got["columns"]])
    toxic = got["toxic"].to_numpy(np.float64)
    kind = clusters(doc, column, toxic, len(columns))
    targets = np.stack([*((kind == k).astype(np.float64) for k in range(KINDS)), toxic], 1)
    fold = (mixed(got["doc_id"].to_numpy(np.int64).astype(np.uint64)) % np.uint64(FOLDS)).astype(np.int64)
    return fit_chain(doc, column, targets, fold, columns)


def scored(docs: DataFrame, chain: Chain) -> DataFrame:
    """``docs`` with a struct ``toxicity`` of a probability for each category. Null and empty texts have no features."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(chain)

    @F.pandas_udf(", ".join(f"{c} double" for c in CATEGORIES))
    def score(text: pd.Series) -> pd.DataFrame:
        parts = [held.value.probabilities(raw) for _, _, raw in rounds(text.tolist())]
        return pd.DataFrame(np.concatenate(parts) if parts else np.zeros((0, len(CATEGORIES))), columns=list(CATEGORIES))

    return docs.withColumn("toxicity", score("text"))


def op5_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text: doc_id, held_out, a probability for each category, score (that of toxic), predicted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    parts = [F.col(f"toxicity.{c}").alias(f"p_{c}") for c in CATEGORIES]
    return out.select("doc_id", is_held_out().alias("held_out"), *parts, F.col("toxicity.toxic").alias("score"), (F.col("toxicity.toxic") >= 0.5).cast("int").alias("predicted"))
