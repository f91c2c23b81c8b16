"""MinHash near-duplicates with tensored banding.

A document is its set of distinct word n-grams. Two small collections of half keys, each of HALF min-hashes, are
computed; every pair of a half key of the first with one of the second is a table's key. So 2 x HALVES x HALF
min-hashes make HALVES ** 2 tables of 2 x HALF each, which banding would compute 2 x HALF x HALVES ** 2 for. Documents
that share a key are candidates; each link is verified on whole sets.

A document enters the tables only with half keys that another document has, too. Families of near copies don't expand
into pairs: each member first meets two centres of its tables; what these verified links connect isn't paired again,
and of a table only documents outside its prevailing component meet the others. A pair that meets in several tables
counts in the first one, which the half keys themselves tell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import small_batches, table, written
from lectern.llm.jaccard import MAP_LONGS, _classes, _planes, _sets, _side, _verified, components
from lectern.llm.words import NOT_BLANK, Words, mixed, rounds

#: Min-hashes of a half key, and half keys of each collection. A pair of similarity s shares no table with probability
#: of about 2 (1 - s ** HALF) ** HALVES: 7 in 100,000 at 0.85, 6 in 10,000 at 0.8, 3 in a million at 0.9.
HALF, HALVES = 2, 8
#: Orders by which a table's centres are chosen.
CENTRES = 2
_DRAWN = np.random.Generator(np.random.Philox(key=[12, 1])).integers(1, 1 << 63, (2, 2 * HALVES * HALF), dtype=np.uint64)
_FLIP, _TIMES = _DRAWN[0], _DRAWN[1] * np.uint64(2) + np.uint64(1)

SIGNED = "doc_id long, h1 long, h2 long, n int, class string, halves array<long>, parity array<long>"


def half_keys(doc: np.ndarray, gram: np.ndarray, n_docs: int) -> np.ndarray:
    """The 2 x HALVES half keys of each of ``n_docs`` sets, given as sorted (document, n-gram); zeros for an empty one."""
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    out = np.zeros((n_docs, 2 * HALVES), np.uint64)
    if not len(starts):
        return out
    for k in range(2 * HALVES):
        key = np.full(len(starts), 2 * k + 1, np.uint64)
        for j in range(k * HALF, (k + 1) * HALF):
            least = np.minimum.reduceat((gram ^ _FLIP[j]) * _TIMES[j], starts)
            key = mixed(key * np.uint64(5) + least)
        out[doc[starts], k] = key
    return out


def _parities(doc: np.ndarray, gram: np.ndarray, n_docs: int) -> np.ndarray:
    """Of each set a bitmap of 64 x MAP_LONGS bits: whether an odd number of n-grams falls on each."""
    bits = 64 * MAP_LONGS
    odd = np.bincount(doc * bits + (gram % np.uint64(bits)).astype(np.int64), minlength=n_docs * bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(">i8").astype(np.int64).reshape(n_docs, MAP_LONGS)


def _named(docs: DataFrame) -> DataFrame:
    """(doc_id, text, h1, h2): 128 bits that name an id with its text."""
    known, number = F.col("doc_id").isNotNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    return docs.select("doc_id", "text", F.xxhash64(known, number, "text").alias("h1"), F.xxhash64("text", number, known, F.lit(12)).alias("h2"))


def signatures(docs: DataFrame, n_words: int) -> DataFrame:
    """Per row its set's size, a name that equal sets share, half keys and parity bitmap (see SIGNED)."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo, hi, raw in rounds(batch["text"].tolist()):
                doc, gram = _sets(Words(raw, NOT_BLANK), n_words)
                sizes, names = _classes(doc, gram, len(raw))
                out = batch.iloc[lo:hi][["doc_id", "h1", "h2"]].copy()
                out["n"], out["class"] = sizes, names
                out["halves"] = list(half_keys(doc, gram, len(raw)).view(np.int64))
                out["parity"] = list(_parities(doc, gram, len(raw)))
                yield out

    rows = _named(docs).select(F.col("doc_id").cast("string").alias("doc_id"), "text", "h1", "h2")  # text keeps nulls and large ids apart in pandas
    return rows.mapInPandas(sign, SIGNED.replace("doc_id long", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("long"))


def table_keys(classes: DataFrame) -> DataFrame:
    """(key, node): the tables' keys of ``classes`` (node, halves) that more than one of them has."""
    halves = classes.select("node", F.posexplode("halves").alias("at", "half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("half")
    alive = halves.join(shared, "half")
    sides = [F.collect_list(F.when(F.col("at") < HALVES if k == 0 else F.col("at") >= HALVES, F.col("half"))).alias(f"side{k}") for k in range(2)]
    keys = alive.groupBy("node").agg(*sides).select("node", F.explode("side0").alias("one"), "side1").select("node", "one", F.explode("side1").alias("two"))
    keys = written(keys.select("node", F.xxhash64("one", "two").alias("key")), "table-keys")
    centres = [F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node"))["node"].alias(f"centre{k}") for k in range(CENTRES)]
    groups = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m"), *centres).filter("m > 1").drop("m")
    return written(keys.join(groups, "key"), "tables")


def _possible(percent: int) -> Column:
    """Whether the sets a and b can link by their sizes and parity bitmaps, which bound their difference from below."""
    differ = F.lit(0)
    for k in range(MAP_LONGS):
        differ = differ + F.bit_count(F.col("a_parity")[k].bitwiseXOR(F.col("b_parity")[k]))
    sizes = F.col("a_n") + F.col("b_n")
    return (percent * F.greatest("a_n", "b_n") <= 100 * F.least("a_n", "b_n")) & ((100 + percent) * differ <= (100 - percent) * sizes)


def _sets_of(docs: DataFrame, wanted: DataFrame, n_words: int) -> DataFrame:
    """(class, n, shared): node, size and sorted n-grams of ``wanted`` (node, h1, h2), from the texts that they name."""

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo, hi, raw in rounds(batch["text"].tolist()):
                doc, gram = _sets(Words(raw, NOT_BLANK), n_words)
                parts = np.split(gram, np.cumsum(np.bincount(doc, minlength=len(raw)))[:-1])
                yield pd.DataFrame({"class": batch["node"].iloc[lo:hi].to_numpy(), "n": [len(p) for p in parts], "shared": [_planes(p, 8) for p in parts]})

    texts = _named(docs).select("h1", "h2", "text").join(wanted, ["h1", "h2"]).groupBy("h1", "h2").agg(F.first("node").alias("node"), F.first("text").alias("text"))
    return texts.select("node", "text").mapInPandas(collect, "class long, n int, shared binary")


def links_between(docs: DataFrame, classes: DataFrame, n_words: int, percent: int) -> DataFrame:
    """(node, root) of the linked ``classes`` (node, h1, h2, n, halves, parity): see the module's text."""
    tables = table_keys(classes)
    sets = written(_sets_of(docs, tables.select("node").distinct().join(classes.select("node", "h1", "h2"), "node"), n_words), "sets")
    stats = classes.select("node", "n", "parity")

    # each member and the first centre of either order that it can link to
    met = None
    for k in range(CENTRES):
        some = tables.select("node", F.col(f"centre{k}").alias("centre"), F.lit(k).alias("k")).filter("node <> centre").distinct()
        met = some if met is None else met.unionByName(some)
    met = met.join(_side(stats, "a", *stats.columns), F.col("node") == F.col("a_node")).join(_side(stats, "b", *stats.columns), F.col("centre") == F.col("b_node")).filter(_possible(percent))
    first = F.min(F.struct(F.xxhash64("centre", "k").alias("h"), "centre"))["centre"].alias("centre")
    stars = met.groupBy("node", "k").agg(first).select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    stars = written(_verified(stars, sets, percent), "star-links")
    label = components(stars)

    # what is left: of each table those outside the component of its centre, with all others of another component
    own = tables.join(label.select("node", "root"), "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root", "centre1")
    main = own.filter("node = centre0").select("key", F.col("label").alias("main"))
    own = own.select("key", "node", "label").join(main, "key").withColumn("minor", F.col("label") != F.col("main"))
    mixed_keys = own.filter("minor").select("key").distinct()
    facts = classes.select("node", "n", "halves", "parity")
    own = written(own.join(mixed_keys, "key", "left_semi").select("key", "node", "label", "minor").join(facts, "node"), "mixed-tables")
    names = ("node", "n", "halves", "parity", "label", "key", "minor")
    once = ~F.col("b_minor") | (F.col("a_node") < F.col("b_node"))
    one, two = (_first_shared(lo) for lo in (0, HALVES))
    pairs = _side(own.filter("minor"), "a", *names).join(_side(own, "b", *names), (F.col("a_key") == F.col("b_key")) & (F.col("a_label") != F.col("b_label")) & once & _possible(percent) & (F.xxhash64(one, two) == F.col("a_key")))
    links = _verified(pairs.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct(), sets, percent)
    return components(links.unionByName(stars))


def _first_shared(lo: int) -> Column:
    """The first half key of a collection that a and b have in common."""
    return F.coalesce(*[F.when(F.col("a_halves")[k] == F.col("b_halves")[k], F.col("a_halves")[k]) for k in range(lo, lo + HALVES)])


def near_duplicates(docs: DataFrame, n_words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; others are ignored): doc_id, n_shingles, component_id, kept.

    Two documents link when 100 |A & B| >= percent |A | B| for their sets of word n-grams; component_id is the least
    doc_id that links reach, and kept whether it is the document's own. A document without words (or text) links with
    nothing; one of fewer than ``n_words`` words has them as its one n-gram. Equal sets are one class, found exactly;
    a link between different sets is missed only if no table holds both (see HALVES). Rows that repeat each get a row;
    a null doc_id is a component's id only if it has no other.
    """
    small_batches(docs.sparkSession)
    signed = written(signatures(docs, n_words), "signatures")
    rep = F.min(F.struct("h1", "h2", "n", "halves", "parity")).alias("r")
    classes = signed.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("first"), rep)
    classes = written(classes.select("class", "first", "r.*", F.monotonically_increasing_id().alias("node")), "classes")
    roots = links_between(docs, classes, n_words, percent)
    named = classes.select("class", "first", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = named.join(ids, "root").select("class", "component_id")
    rows = signed.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "class").join(ids, "class", "left")
    component = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op12_minhash_tensored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose sets of 3-word shingles link at 85 percent, and which document of each stays."""
    return near_duplicates(table(spark, sf_dir, "documents"), n_words=3, percent=85)
