"""Quality classifier: a linear-chain conditional random field labels each line good or bad.

A line's features are its own and those of the lines before and after it. Training takes each line of a labelled
document to have its document's label. A document's quality is the mean of its lines' forward-backward marginals,
weighted by length, on a scale fitted to the labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import is_held_out, labelled_sample, small_batches, table, trimmed
from lectern.llm.words import NOT_BLANK, Words, rounds

#: At most so many labelled documents of each label are learned from, chosen by a hash of doc_id.
MOST_LABELLED = 2500
THRESHOLD = 0.7
STEPS, RATE, PENALTY, CHAIN_PENALTY = 250, 0.1, 1e-3, 0.05
_BYTES = np.arange(256)
_UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
_LETTER = _UPPER | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
_DIGIT = (_BYTES >= 0x30) & (_BYTES <= 0x39)
_STOP = np.isin(_BYTES, [ord(c) for c in ".,;:?'\"()-"])
_SYMBOL = (_BYTES > 0x20) & (_BYTES < 0x7F) & ~_LETTER & ~_DIGIT & ~_STOP
N_OWN = 15


def line_features(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features [line, 3 * N_OWN + 1], length of each line, first line of each text) of all lines of some texts.

    A text without any line has one empty line.
    """
    words = Words(raw, NOT_BLANK)
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    end = np.flatnonzero(data == 0x0A)
    begin = np.concatenate([[0], end[:-1] + 1])
    first = np.searchsorted(begin, words.at)
    n_bytes = (end - begin).astype(np.float64)

    def share(member: np.ndarray) -> np.ndarray:
        return np.add.reduceat(member[data], begin, dtype=np.int64) / np.maximum(n_bytes, 1)

    upper, letter, digit, stop, symbol = map(share, (_UPPER, _LETTER, _DIGIT, _STOP, _SYMBOL))
    line = np.searchsorted(begin, words.begin, side="right") - 1
    n = len(begin)
    n_words = np.bincount(line, minlength=n).astype(np.float64)
    again = np.zeros(len(line), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((words.hash, line))
    new = np.ones(len(order), bool)
    new[1:] = (words.hash[order[1:]] != words.hash[order[:-1]]) | (line[order[1:]] != line[order[:-1]])
    distinct = np.bincount(line[order], weights=new, minlength=n)
    repeats = np.bincount(line, weights=again, minlength=n)
    long = np.bincount(line, weights=(words.end - words.begin) > 15, minlength=n)
    lone = np.bincount(line, weights=((words.end - words.begin) == 1) & _SYMBOL[words.data[words.begin]], minlength=n)
    per = np.maximum(n_words, 1)
    # distinct words of a line fall with its length: compare with what a line of so many words has
    variety = distinct / per
    own = np.stack(
        [
            np.log1p(n_bytes) / 8, upper / np.maximum(letter, 1e-9), symbol, np.minimum(symbol * 10, 1), digit, stop, letter,
            repeats / per, np.minimum(4 * repeats / per, 1), variety, (variety < 0.5) & (n_words > 6), lone / per,
            n_bytes / per / 16, long / per, upper > 0.5 * np.maximum(letter, 1e-9),
        ],
        1,
    ).astype(np.float64)
    own[n_bytes == 0] = 0
    start = np.zeros(n + 1, bool)
    start[first] = True
    start[n] = True
    before, after = np.vstack([np.zeros((1, N_OWN)), own[:-1]]), np.vstack([own[1:], np.zeros((1, N_OWN))])
    before[start[:-1]], after[start[1:]] = 0, 0
    return np.hstack([own, before, after, np.ones((n, 1))]), n_bytes, np.append(first, n)


def marginals(score: np.ndarray, chain: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all texts side by side: P(line good), P(pair of neighbours) [line, 4], log Z of each text.

    ``score``: log-odds of good by line; ``chain`` [2, 2]: scores of (label, next label).
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    begin, size = first[:-1][order], size[order]
    live = np.searchsorted(-size, -np.arange(1, int(size.max(initial=0)) + 1), side="right")
    alpha, beta = np.zeros((len(score), 2)), np.zeros((len(score), 2))
    emit = np.stack([np.zeros(len(score)), score], 1)
    for t, n in enumerate(live):
        at = begin[:n] + t
        if t == 0:
            alpha[at] = emit[at]
        else:
            alpha[at] = emit[at] + np.logaddexp(alpha[at - 1, :1] + chain[0], alpha[at - 1, 1:] + chain[1])
    for t in range(len(live) - 2, -1, -1):
        at = begin[: live[t + 1]] + t
        ahead = emit[at + 1] + beta[at + 1]
        beta[at] = np.logaddexp(ahead[:, :1] + chain[:, 0], ahead[:, 1:] + chain[:, 1])
    last = first[1:] - 1
    z = np.logaddexp(alpha[last, 0], alpha[last, 1])
    z_at = np.repeat(z, np.diff(first))
    good = np.exp(alpha[:, 1] + beta[:, 1] - z_at)
    pair = np.zeros((len(score), 4))
    inner = np.ones(len(score), bool)
    inner[last] = False
    i = np.flatnonzero(inner)
    joint = alpha[i][:, :, None] + chain[None] + (emit[i + 1] + beta[i + 1])[:, None, :] - z_at[i][:, None, None]
    pair[i] = np.exp(joint).reshape(-1, 4)
    return good, pair, z


class LineModel:
    """Weights of lines and of neighbours, the features' scale, and the scale of the score."""

    def __init__(self, weights, chain, centre, spread, slope, offset):
        self.weights, self.chain, self.centre, self.spread, self.slope, self.offset = weights, chain, centre, spread, slope, offset

    def lines(self, features, first):
        return marginals(((features - self.centre) / self.spread) @ self.weights, self.chain, first)[0]

    def raw(self, features, n_bytes, first):
        size = np.maximum(n_bytes, 1)
        return np.add.reduceat(self.lines(features, first) * size, first[:-1]) / np.add.reduceat(size, first[:-1])

    def scores(self, features, n_bytes, first):
        p = np.clip(self.raw(features, n_bytes, first), 1e-4, 1 - 1e-4)
        return 1 / (1 + np.exp(-(self.slope * np.log(p / (1 - p)) + self.offset)))


def fit(features: np.ndarray, n_bytes: np.ndarray, first: np.ndarray, labels: np.ndarray, share_good: float) -> LineModel:
    """Maximum likelihood with L2 penalties by Adam; texts of either label weigh as much in all, the scale is fitted at ``share_good``."""
    centre, spread = features.mean(0), features.std(0) + 1e-6
    centre[-1], spread[-1] = 0, 1
    x = (features - centre) / spread
    size = np.diff(first)
    y = np.repeat(labels, size)
    share = np.where(labels == 1, 0.5 / max((labels == 1).sum(), 1), 0.5 / max((labels == 0).sum(), 1))
    weight = np.repeat(share / size, size)  # a text counts once, however many lines it has
    inner = np.ones(len(y), bool)
    inner[first[1:] - 1] = False
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        good, pair, _ = marginals(x @ theta[:-4], theta[-4:].reshape(2, 2), first)
        gradient = np.zeros_like(theta)
        gradient[:-4] = x.T @ (weight * (y - good)) - PENALTY * theta[:-4]
        seen = np.zeros((len(y), 4))
        seen[inner & (y == 0), 0], seen[inner & (y == 1), 3] = 1, 1
        gradient[-4:] = ((seen - pair) * weight[:, None]).sum(0) - CHAIN_PENALTY * theta[-4:]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model = LineModel(theta[:-4], theta[-4:].reshape(2, 2), centre, spread, 1.0, 0.0)
    p = np.clip(model.raw(features, n_bytes, first), 1e-4, 1 - 1e-4)
    z, w = np.log(p / (1 - p)), np.where(labels == 1, share * share_good * 2, share * (1 - share_good) * 2)
    a, b = 1.0, 0.0
    for _ in range(500):
        q = 1 / (1 + np.exp(-(a * z + b)))
        g = w * (labels - q)
        h = w * q * (1 - q) + 1e-9
        # Newton step on two parameters, a little damped
        hess = np.array([[(h * z * z).sum(), (h * z).sum()], [(h * z).sum(), h.sum()]]) + 1e-4 * np.eye(2)
        da, db = np.linalg.solve(hess, [(g * z).sum() - 1e-4 * a, g.sum()])
        a, b = a + np.clip(da, -0.5, 0.5), b + np.clip(db, -0.5, 0.5)
        if abs(da) + abs(db) < 1e-7:
            break
    model.slope, model.offset = max(a, 0.05), b
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> LineModel:
    """The model from at most ``most`` documents of each label, none of them held out. Without both labels every text scores as good."""
    small_batches(docs.sparkSession)
    known = labels.filter("quality in (0, 1)").filter(~is_held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo, hi, raw in rounds(batch["text"].tolist()):
                x, n_bytes, first = line_features(raw)
                yield pd.DataFrame(
                    {
                        "quality": batch["quality"].to_numpy()[lo:hi],
                        "lines": [x[a:b].astype("<f4").tobytes() for a, b in zip(first, first[1:], strict=False)],
                        "sizes": [n_bytes[a:b].astype("<f8").tobytes() for a, b in zip(first, first[1:], strict=False)],
                    }
                )

    sample = labelled_sample(docs, labels, "quality", most).mapInPandas(collect, "quality int, lines binary, sizes binary").toPandas()
    if sample["quality"].nunique() < 2:
        n = 3 * N_OWN + 1
        return LineModel(np.zeros(n), np.zeros((2, 2)), np.zeros(n), np.ones(n), 1.0, 5.0)
    sample = sample.sort_values(["quality", "lines"], kind="stable")
    x = np.concatenate([np.frombuffer(r, "<f4").reshape(-1, 3 * N_OWN + 1) for r in sample["lines"]]).astype(np.float64)
    n_bytes = [np.frombuffer(r, "<f8") for r in sample["sizes"]]
    first = np.concatenate([[0], np.cumsum([len(s) for s in n_bytes])])
    return fit(x, np.concatenate(n_bytes), first, sample["quality"].to_numpy(np.float64), counts[1] / (counts[0] + counts[1]))


def score_of(model: LineModel, docs: DataFrame) -> Column:
    """A column of the scores (0 to 1) of ``docs.text``. Null and empty texts score as one empty line."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in trimmed(texts):
            yield pd.Series(np.concatenate([held.value.scores(*line_features(raw)) for _, _, raw in rounds(text.tolist())] or [np.zeros(0)]))

    return score(F.col("text"))


def scored(docs: DataFrame, model: LineModel) -> DataFrame:
    """``docs`` with score (0 to 1), which replaces a column of that name. Rows that repeat score alike."""
    return docs.withColumn("score", score_of(model, docs))


def kept_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, all columns as they are, without the rows whose text scores below ``threshold``.

    Null and empty texts are judged as one empty line; each of several equal rows is kept or goes alike; no rows give none.
    """
    return docs.filter(score_of(train(docs, labels), docs) >= threshold)


def op4_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
