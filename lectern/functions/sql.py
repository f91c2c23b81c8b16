"""The library's functions for SQL users: ``register`` makes them known to a session under their names."""

from __future__ import annotations

import difflib
import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from lectern.functions import text as T


@udtf(returnType="child int, words int, text string")
class ChildPassages:
    """Passages of whole sentences of at most ``most`` words, a row each; a longer sentence is one of its own."""

    def eval(self, text: str, most: int):
        held, n, child = [], 0, 0
        for sentence in re.split(r"(?<=[.!?])\s+", (text or "").strip(" ")):
            words = len(sentence.split())
            if words and n and n + words > most:
                yield child, n, " ".join(held)
                held, n, child = [], 0, child + 1
            if words:
                held.append(sentence)
                n += words
        if n:
            yield child, n, " ".join(held)


@udtf(returnType="rank int, word string, ratio double")
class NearWords:
    """The words of a list (separated by blanks) spelled most like ``word``, best first."""

    def eval(self, word: str, words: str, most: int):
        scored = sorted(((difflib.SequenceMatcher(None, word, w).ratio(), w) for w in (words or "").split()), key=lambda x: (-x[0], x[1])) if word else []
        for rank, (score, other) in enumerate(scored[:most], 1):
            yield rank, other, score


def register(spark: SparkSession) -> None:
    """child_passages(text, most), near_words(word, words, most), matchable(text), html_unescaped(text), spelling_ratio(a, b)."""
    spark.udtf.register("child_passages", ChildPassages)
    spark.udtf.register("near_words", NearWords)
    spark.udf.register("matchable", T.matchable)
    spark.udf.register("html_unescaped", T.unescaped)
    spark.udf.register("spelling_ratio", T.ratio)
