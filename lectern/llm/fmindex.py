"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of documents in one task. Its text, over the alphabet of the benchmark's words, is indexed: suffix
order, Burrows-Wheeler transform in a wavelet matrix for rank queries, and sampled suffix positions. All test phrases
search backward at once; hits are located by walking to a sampled position, and merge into removal spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import small_batches, table, text_bytes, trimmed, written
from lectern.llm.words import ALNUM, Words, rounds

WINDOW = 10
#: Text bytes of a training shard, and benchmark bytes that are broadcast at once; a larger benchmark is searched part by part.
SHARD_BYTES, PART_BYTES = 3_000_000, 4_000_000
#: Every so many positions of a shard keep their place.
SAMPLE = 16

HITS = "row long, doc_id long, n_words long, spans array<struct<begin:long,end:long>>, items array<string>"


class Phrases:
    """Windows of the items: ``width`` consecutive words, or a shorter item whole, as arrays of symbols from 1 on."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int = WINDOW):
        texts = [(t or "").encode("utf-8", "replace") for _, t in items]
        words = Words(texts, ALNUM) if texts else None
        self.alphabet = np.unique(words.hash) if texts else np.zeros(0, np.uint64)
        windows: dict[tuple[int, ...], set[int]] = {}
        for i in range(len(items)):
            row = (np.searchsorted(self.alphabet, words.hash[words.first[i] : words.first[i + 1]]) + 1).tolist()
            for k in range(max(1, len(row) - width + 1) if row else 0):
                windows.setdefault(tuple(row[k : k + width]), set()).add(i)
        self.width = width
        self.length = np.array([len(w) for w in windows], np.int64)
        self.shortest = int(self.length.min(initial=width))
        self.symbols = np.zeros((len(windows), width), np.int64)  # right-aligned: the search begins at the end
        for k, w in enumerate(windows):
            self.symbols[k, width - len(w) :] = w
        self.items = [sorted(x) for x in windows.values()]
        self.names = [name for name, _ in items]


class FMIndex:
    """An index of ``text``: symbols from 1 to ``most``, with 0 between runs; no match crosses a 0."""

    def __init__(self, text: np.ndarray, most: int):
        text = np.append(text, 0)  # the last symbol precedes no suffix; so that it is none of the alphabet
        self.n = len(text)
        order = self._suffix_order(text)
        before = np.where(order > 0, text[order - 1], 0)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=most + 1))])
        self.levels, self.zeros, row = [], [], before
        for bit in range(max(1, int(most).bit_length()) - 1, -1, -1):
            ones = (row >> bit) & 1
            self.levels.append(np.concatenate([np.zeros(1, np.int32), np.cumsum(ones, dtype=np.int32)]))
            self.zeros.append(self.n - int(self.levels[-1][-1]))
            row = np.concatenate([row[ones == 0], row[ones == 1]])
        self.before = before
        # positions that start a run are kept too: what comes before them is no symbol to walk by
        self.kept = np.where((order % SAMPLE == 0) | (before == 0), order, -1)

    @staticmethod
    def _suffix_order(text: np.ndarray) -> np.ndarray:
        """Suffix order by prefix doubling; each 0 is a symbol of its own, so runs end the comparison."""
        n, zero = len(text), text == 0
        key = text.astype(np.int64) + int(zero.sum())
        key[zero] = np.arange(int(zero.sum()))
        order = np.argsort(key, kind="stable")
        step = 1
        while True:
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)]) if n else []
            if not n or rank[order[-1]] == n - 1:
                return order
            after = np.zeros(n, np.int64)
            after[:-step] = rank[step:] + 1
            key = rank * (n + 1) + after
            order = np.argsort(key, kind="stable")
            step *= 2

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs among the first ``at`` symbols of the transform."""
        lo, hi = np.zeros_like(at), at
        for k, (ones, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            up = (symbol >> (len(self.levels) - 1 - k)) & 1
            one_lo, one_hi = ones[lo], ones[hi]
            lo, hi = np.where(up, zeros + one_lo, lo - one_lo), np.where(up, zeros + one_hi, hi - one_hi)
        return hi - lo

    def search(self, symbols: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range of each right-aligned row of ``symbols``, all rows at once, from their last symbol back."""
        lo, hi = np.zeros(len(symbols), np.int64), np.full(len(symbols), self.n, np.int64)
        live, width = np.arange(len(symbols)), symbols.shape[1]
        for k in range(width):
            live = live[(hi[live] > lo[live]) & (k < length[live])]
            c = symbols[live, width - 1 - k]
            lo[live], hi[live] = self.first[c] + self.rank(c, lo[live]), self.first[c] + self.rank(c, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            known = self.kept[at[todo]]
            out[todo] = np.where(known >= 0, known + steps[todo], -1)
            todo = todo[known < 0]
            c = self.before[at[todo]]
            at[todo] = self.first[c] + self.rank(c, at[todo])
            steps[todo] += 1
        return out


def search_shard(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence of a window within the texts of ``words``."""
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(phrases.length) or not len(words.hash):
        return nothing
    spot = np.minimum(np.searchsorted(phrases.alphabet, words.hash), len(phrases.alphabet) - 1)
    symbol = np.where(phrases.alphabet[spot] == words.hash, spot + 1, 0)
    # Words that no item has, and document ends, end a run; a run shorter than the shortest window can't hold one.
    start = np.zeros(len(symbol), bool)
    start[words.first[:-1][words.first[:-1] < len(symbol)]] = True
    known = symbol > 0
    begins = np.flatnonzero(known & (start | ~np.concatenate([[False], known[:-1]])))
    ends = np.flatnonzero(known & np.concatenate([start[1:] | ~known[1:], [True]])) + 1
    long = ends - begins >= phrases.shortest
    begins, sizes = begins[long], (ends - begins)[long]
    if not len(begins):
        return nothing
    at = np.cumsum(sizes + 1) - sizes  # a 0 before each run
    place = np.repeat(begins - at, sizes + 1) + np.arange(int((sizes + 1).sum()))
    text = symbol[np.maximum(place, 0)]
    text[at - 1] = 0
    index = FMIndex(text, len(phrases.alphabet))
    lo, hi = index.search(phrases.symbols, phrases.length)
    count = np.maximum(hi - lo, 0)
    window = np.repeat(np.arange(len(lo)), count)
    rows = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
    return place[index.locate(rows)], window


def _shard_hits(phrases: Phrases, rows, keys, raw: list[bytes]) -> pd.DataFrame:
    words = Words(raw, ALNUM)
    first, window = search_shard(words, phrases)
    cover = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + phrases.length[window], -1)
    hit = np.cumsum(cover)[:-1] > 0
    edge = np.zeros(len(hit) + 1, bool)
    edge[words.first] = True
    inner = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate([[False], hit[:-1]])))
    outer = np.flatnonzero(hit & (edge[1:] | ~np.concatenate([hit[1:], [False]]))) + 1
    spans: list[list[dict]] = [[] for _ in raw]
    for b, e in zip(inner.tolist(), outer.tolist(), strict=True):
        d = int(words.doc[b])
        spans[d].append({"begin": b - int(words.first[d]), "end": e - int(words.first[d])})
    items: list[set] = [set() for _ in raw]
    for d, w in set(zip(words.doc[first].tolist() if len(first) else [], window.tolist(), strict=True)):
        items[d].update(phrases.names[i] for i in phrases.items[w])
    return pd.DataFrame(
        {"row": rows, "doc_id": pd.array(keys, dtype="Int64"), "n_words": np.diff(words.first), "spans": spans, "items": [sorted(x for x in i if x is not None) for i in items]}
    )


def _parts(benchmark: DataFrame) -> tuple[int, DataFrame]:
    """The number of parts that a benchmark is searched in, and its rows (item_id, text)."""
    sized = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text", (text_bytes() + 64).alias("bytes"))
    return max(1, -(-(sized.agg(F.sum("bytes").alias("b")).first()["b"] or 0) // PART_BYTES)), sized.drop("bytes")


def find_hits(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Per row of ``docs`` (row, doc_id, text): row, doc_id, n_words, spans of hit words, items (item_ids with occurring windows).

    Null texts have no words. Items without words have no windows; an item without id marks words but isn't listed;
    rows of one item_id are one item. A benchmark beyond PART_BYTES is searched in parts of that size.
    """
    parts, sized = _parts(benchmark)
    small_batches(docs.sparkSession)
    found = []
    for part in range(parts):
        some = sized.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part) if parts > 1 else sized
        phrases = Phrases([(r["item_id"], r["text"]) for r in some.select("item_id", "text").collect()], width)
        held = docs.sparkSession.sparkContext.broadcast(phrases)  # about PART_BYTES, whatever the benchmark's size

        def search(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            for batch in batches:
                keys = [None if pd.isna(k) else int(k) for k in batch["doc_id"]]
                for lo, hi, raw in rounds(batch["text"].tolist(), SHARD_BYTES):
                    yield _shard_hits(held.value, batch["row"].to_numpy()[lo:hi], keys[lo:hi], raw)

        found.append(docs.select("row", "doc_id", "text").mapInPandas(search, HITS))
    if parts == 1:
        return found[0]
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)
    return _merged(every)


def _merged(hits: DataFrame) -> DataFrame:
    """Hits of several parts of a benchmark, one row a document row, overlapping and touching spans merged."""
    sums = hits.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    spans = hits.select("row", F.explode("spans").alias("s")).select("row", "s.*")
    order = Window.partitionBy("row").orderBy("begin", "end")
    spans = spans.withColumn("reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("island", F.sum(F.when(F.col("begin") > F.coalesce("reach", F.lit(-1)), 1).otherwise(0)).over(order))
    spans = spans.groupBy("row", "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    spans = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    none = F.array().cast("array<struct<begin:bigint,end:bigint>>")
    return sums.join(spans, "row", "left").select("row", "doc_id", "n_words", F.coalesce("spans", none).alias("spans"), "items")


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number for each row, so that rows that repeat stay apart."""
    return docs.withColumn("row", F.monotonically_increasing_id())


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the removal spans (in words)."""
    hits = find_hits(numbered(docs.select("doc_id", "text")), benchmark, width)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["begin"])
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "spans",
    )


def _cut(text, raw: bytes, words: Words, i: int, spans: list[tuple[int, int]]):
    """``text``, the ``i``-th of ``words``, without the words of ``spans``; null where no other word was there."""
    if not spans:
        return text
    if sum(e - b for b, e in spans) == words.first[i + 1] - words.first[i]:
        return None
    at, from_, kept = int(words.first[i]), 0, []
    for b, e in spans:
        kept.append(raw[from_ : int(words.begin[at + b] - words.at[i])])
        from_ = int(words.end[at + e - 1] - words.at[i])
    return b"".join([*kept, raw[from_:]]).decode("utf-8", "replace")


def _cutter(held):
    """A function of texts that cuts out the words of hits; null where nothing else was left."""

    @F.pandas_udf("string")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in trimmed(texts):
            values, done = text.tolist(), []
            for lo, hi, raw in rounds(values, SHARD_BYTES):
                hits = _shard_hits(held.value, np.arange(hi - lo), [None] * (hi - lo), raw)
                words = Words(raw, ALNUM)
                done += [_cut(values[lo + i], raw[i], words, i, [(s["begin"], s["end"]) for s in spans]) for i, spans in enumerate(hits["spans"])]
            yield pd.Series(done, dtype=object)

    return cut


def _cut_at(text: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.Series:
    """Texts without the words of the spans given; null where nothing else was left."""
    values, done = text.tolist(), []
    at = [[] if b is None else list(zip(map(int, b), map(int, e), strict=True)) for b, e in zip(begins, ends, strict=True)]
    for lo, hi, raw in rounds(values, SHARD_BYTES):
        words = Words(raw, ALNUM)
        done += [_cut(values[lo + i], raw[i], words, i, at[lo + i]) for i in range(hi - lo)]
    return pd.Series(done, dtype=object)


def without_hits(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """``docs`` with hit words cut out of their texts; a document that then has no word left goes. n_chars follows the text.

    Texts without hits stay as they are, also null ones and those that never had words; all other columns stay, whatever
    their names; rows that repeat are each cut. A benchmark within PART_BYTES is searched and cut in one pass; with a
    larger one the spans of all parts, found in the text as it was, are merged and cut at once.
    """
    parts, sized = _parts(benchmark)
    small_batches(docs.sparkSession)
    had = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    if parts == 1:
        phrases = Phrases([(r["item_id"], r["text"]) for r in sized.select("item_id", "text").collect()], width)
        out = had.select("doc", _cutter(docs.sparkSession.sparkContext.broadcast(phrases))("text").alias("text"))
    else:
        rows = written(numbered(had.select("doc", "doc.doc_id", "text")), "numbered")  # so that each part's search reads the same row numbers
        spans = find_hits(rows, benchmark, width).filter(F.size("spans") > 0).select("row", F.col("spans.begin").alias("begins"), F.col("spans.end").alias("ends"))
        out = rows.join(spans, "row", "left").select("doc", F.pandas_udf(_cut_at, "string")("text", "begins", "ends").alias("text"))
    out = out.filter("text is not null or doc.text is null")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.char_length("text"), "doc.n_chars").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def op10_fm_index_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 10 words within all documents, found by FM-index."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")
