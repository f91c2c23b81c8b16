"""Hybrid retrieval over many queries at once: keyword and vector lists, reciprocal rank fusion, pool, rerank, diversity.

Queries are a stated set; ``query_id`` is a column everywhere, so a batch of queries is one job. Scorers are injected.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as T
from lectern.operators import cells as N
from lectern.operators import index as X

RRF_K = 60


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, key, tf, n_terms): words of three letters and more. Reusable: write it partitioned by a hash of the term to index a corpus."""
    terms = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z][a-z0-9]+)")), lambda w: F.length(w) >= 3)
    rows = docs.select(key, terms.alias("terms")).withColumn("n_terms", F.size("terms"))
    return rows.select(key, "n_terms", F.explode("terms").alias("term")).groupBy("term", key).agg(F.count(F.lit(1)).alias("tf"), F.first("n_terms").alias("n_terms"))


#: Terms of all queries of a block, which goes to every task.
BLOCK_TERMS = 200_000


def keyword_hits(queries: DataFrame, index: DataFrame, n_docs: int, mean_terms: float, key: str = "doc_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 of (query_id, terms) with how many of the query's terms each document has. Queries, a stated set, go in blocks of BLOCK_TERMS terms."""
    q = queries.select("query_id", F.size("terms").alias("n_query"), F.explode("terms").alias("term"))
    blocks, out = max(1, -(-q.count() // BLOCK_TERMS)), None
    for block in range(blocks):
        some = F.broadcast(q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block) if blocks > 1 else q)
        df = index.join(F.broadcast(some.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # at most as many rows as the block has terms
        idf = F.ln(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        norm = F.col("tf") + k1 * (1 - b + b * F.col("n_terms") / F.lit(mean_terms))
        hits = index.join(some, "term").join(F.broadcast(df), "term").groupBy("query_id", key)
        hits = hits.agg(F.round(F.sum(idf * F.col("tf") * (k1 + 1) / norm), 6).alias("score"), F.count(F.lit(1)).alias("matched"), F.first("n_query").alias("n_query"))
        out = hits if out is None else out.unionByName(hits)
    return out


def strict_then_any(hits: DataFrame, limit: int, least: int = 3, key: str = "doc_id") -> DataFrame:
    """Documents with all terms first; where a query has fewer than ``least`` of them, those with any follow. (query_id, key, score, rank)"""
    strict = F.col("matched") == F.col("n_query")
    n = F.count_if(strict).over(Window.partitionBy("query_id"))
    rows = hits.withColumn("strict", strict).withColumn("n_strict", n).filter(F.col("strict") | (F.col("n_strict") < least))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("strict"), F.desc("score"), key))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= limit).select("query_id", key, "score", "strict", "rank")


def hashed_vectors(docs: DataFrame, key: str = "doc_id", text: str = "text", dims: int = 64) -> DataFrame:
    """(key, vector): a stand-in for an encoder, unit vectors of counted words that a hash deals to ``dims`` dimensions and two signs.

    Texts without words of three letters, or whose words cancel out, have no vector.
    """
    h = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long")
    words = X.words_of(docs, key, text).groupBy(key, "word").agg(F.count(F.lit(1)).alias("tf")).withColumn("h", h)
    signed = F.when(F.floor(F.col("h") / dims) % 2 == 0, F.col("tf")).otherwise(-F.col("tf"))
    parts = words.groupBy(key, (F.col("h") % dims).cast("int").alias("dim")).agg(F.sum(signed).cast("double").alias("v"))
    rows = parts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("dim", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("norm"))
    return rows.filter("norm > 0").select(key, vector.alias("vector"))


def keyword_and_vector_lists(index: X.Index, cells: N.Cells, terms: DataFrame, vectors: DataFrame, limit: int = 30) -> DataFrame:
    """(query_id, list, parent, rank): of each query the best by keywords and the best by vector, each from its own index.

    ``terms`` (query_id, terms) and ``vectors`` (query_id, vector) are the queries; one that has no vector, or no term, has one list.
    """
    return both_lists(X.top_hits(index, terms, limit), cells, vectors, limit)


def both_lists(hits: DataFrame, cells: N.Cells, vectors: DataFrame, limit: int = 30) -> DataFrame:
    """``keyword_and_vector_lists`` of keyword ``hits`` (query_id, doc, score, matched, n_query), however they were found."""
    words = strict_then_any(hits.withColumnRenamed("doc", "doc_id"), limit).select("query_id", F.lit("keyword").alias("list"), F.col("doc_id").alias("parent"), "rank")
    near = N.nearest_in_cells(cells, vectors, limit, "query_id", "vector").rows
    return words.unionByName(near.select(F.col("query").alias("query_id"), F.lit("vector").alias("list"), F.col("id").alias("parent"), "rank"))


def fused(lists: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query_id, list, parent, rank): every row adds 1 / (k + rank) to its parent."""
    return lists.groupBy("query_id", "parent").agg(F.sum(F.lit(1.0) / (k + F.col("rank"))).alias("rrf"))


def candidate_pool(lists: DataFrame, top: int = 16, heads: int = 3) -> DataFrame:
    """The ``top`` parents by fusion, then the first ``heads`` distinct parents of each list that aren't among them: (query_id, parent, place)."""
    by = fused(lists).withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf", 12)), "parent")))
    first = lists.groupBy("query_id", "list", "parent").agg(F.min("rank").alias("rank"))
    first = first.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "list").orderBy("rank"))).filter(F.col("n") <= heads)
    tiers = by.filter(F.col("n") <= top).select("query_id", "parent", F.lit(0).alias("tier"), F.col("n").alias("at"))
    tiers = tiers.unionByName(first.select("query_id", "parent", F.lit(1).alias("tier"), (F.dense_rank().over(Window.partitionBy("query_id").orderBy("list")) * 100 + F.col("n")).alias("at")))
    once = tiers.groupBy("query_id", "parent").agg(F.min(F.struct("tier", "at")).alias("o"))
    return once.select("query_id", "parent", F.row_number().over(Window.partitionBy("query_id").orderBy("o")).alias("place"))


def lexical_scorer(query: Column, passage: Column) -> Column:
    """A stand-in for a cross-encoder: share of the query's terms in the passage, from -8 to 8."""
    terms = T.keyword_terms(query)
    found = F.size(F.array_intersect(terms, T.keyword_terms(passage, 10_000)))
    return F.when(F.size(terms) > 0, 16.0 * found / F.size(terms) - 8.0).otherwise(-8.0)


def reranked(pool: DataFrame, scorer: Callable[[Column, Column], Column] = lexical_scorer) -> DataFrame:
    """Pool rows (query_id, query, parent, text) with the scorer's score and rank; ties by parent."""
    scored = pool.withColumn("score", scorer(F.col("query"), F.col("text")))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "parent")))


def best_child(lists: DataFrame) -> DataFrame:
    """(query_id, parent, child) of lists with (list_no, rank, child): the child of the first list, then the best rank."""
    return lists.groupBy("query_id", "parent").agg(F.min_by("child", F.struct("list_no", "rank", "child")).alias("child"))


def reordered_head(ranked: DataFrame, second: str = "second", top: int = 8) -> DataFrame:
    """The first ``top`` ranks of each query in order of a second scorer's ``second``; the score that thresholds read stays."""
    head = F.col("rank") <= top
    w = Window.partitionBy("query_id").orderBy(F.when(head, 0).otherwise(1), F.when(head, -F.col(second)).otherwise(F.col("rank").cast("double")), "rank")
    return ranked.withColumn("rank", F.row_number().over(w))


def fresh_first(ranked: DataFrame, used: DataFrame, limit: int) -> DataFrame:
    """Passages already ``used`` (query_id, parent) after the others, in queries that have ``limit`` others or more."""
    rows = ranked.join(used.select("query_id", "parent", F.lit(1).alias("_used")).distinct(), ["query_id", "parent"], "left").fillna(0, ["_used"])
    enough = F.sum(1 - F.col("_used")).over(Window.partitionBy("query_id")) >= limit
    w = Window.partitionBy("query_id").orderBy(F.when(enough, F.col("_used")).otherwise(0), "rank")
    return rows.withColumn("rank", F.row_number().over(w)).drop("_used")


def sources_panel(ranked: DataFrame, chosen: DataFrame, n: int = 8) -> DataFrame:
    """(query_id, parent, place): the ``chosen`` (query_id, parent) first, then the rest, each in rank order."""
    rows = ranked.join(chosen.select("query_id", "parent", F.lit(0).alias("_tier")).distinct(), ["query_id", "parent"], "left").fillna(1, ["_tier"])
    w = Window.partitionBy("query_id").orderBy("_tier", "rank")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("query_id", "parent", "place")


def grounding(has_passage: Column, has_citation: Column, has_supplement: Column, model_value: Column) -> Column:
    """What an answer rests on: textbook, partial (textbook and model), ai_only, or none for talk without either."""
    book = has_passage & has_citation
    return F.when(book & has_supplement, "partial").when(book, "textbook").when(has_supplement, "ai_only").when(model_value == "none", "none").otherwise("ai_only")


def also_in(sources: DataFrame, citations: DataFrame, least: float = 0.0, n: int = 4) -> DataFrame:
    """Books (query_id, book, place) with a passage scoring ``least`` or more that no citation names: the first ``n`` by their best place."""
    low = F.lower(F.trim("book"))
    rows = sources.filter((F.col("score") >= least) & (F.trim(F.coalesce("book", F.lit(""))) != "")).withColumn("_book", low)
    rows = rows.join(citations.select("query_id", low.alias("_book")).distinct(), ["query_id", "_book"], "left_anti")
    first = rows.groupBy("query_id", "_book").agg(F.min_by("book", "rank").alias("book"), F.min("rank").alias("rank"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "_book"))).filter(F.col("place") <= n).select("query_id", "book", "place")


def chosen_figures(figures: DataFrame, pages: DataFrame, least: float = 0.6, mentioned_least: float = 0.5, n: int = 4) -> DataFrame:
    """Up to ``n`` figures (query_id, id, relevance, mentioned) for each query.

    ``figures`` (id, book, page, label, caption_source, decorative, and sim by query_id) must be printed, not decorative and
    on one of the query's context ``pages`` (query_id, book, page, text), and near the query; one that the context
    names ("see Fig. 49-1") may be less near. Caption paragraphs don't count as context.
    """
    body = pages.withColumn("body", F.when(F.col("text").rlike(r"(?i)^\s*(?:Figure|Fig\.?)\s*\d"), "").otherwise(F.col("text")))
    # a query's context is a handful of passages
    context = body.groupBy("query_id").agg(F.concat_ws(" ", F.collect_list("body")).alias("body"), F.collect_set(F.struct("book", "page")).alias("places"))
    here = F.exists("places", lambda p: (p["book"] == F.col("book")) & (p["page"] == F.col("page")))
    rows = figures.filter((F.col("caption_source") == "printed") & ~F.col("decorative")).join(context, "query_id").filter(here)
    number = F.trim(F.replace(F.coalesce("label", F.lit("")), F.lit("Figure"), F.lit("")))
    # a dot of the number also stands for a dash; the number is looked for among those that the context names
    named = F.transform(F.regexp_extract_all("body", F.lit(r"(?i)\bFig(?:ure|\.)?\s*(\d+(?:[.\-]\d+)*[A-Za-z]?)\b"), F.lit(1)), lambda x: F.replace(x, F.lit("-"), F.lit(".")))
    rows = rows.withColumn("mentioned", (number != "") & F.array_contains(named, F.replace(number, F.lit("-"), F.lit(".")))).withColumn("relevance", F.round("sim", 3))
    rows = rows.filter((F.col("sim") >= least) | (F.col("mentioned") & (F.col("sim") >= mentioned_least)))
    w = Window.partitionBy("query_id").orderBy(F.desc("mentioned"), F.desc("relevance"), "id")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("query_id", "id", "relevance", "mentioned", "place")


def neighbours(hits: DataFrame, passages: DataFrame, window: int = 3) -> DataFrame:
    """(query_id, parent, rank, id, book, text, chars, away) of the passages (id, book, page, text) within ``window`` ids of a hit on its page, itself included."""
    near = hits.select("query_id", "rank", F.col("parent"), F.explode(F.sequence(F.col("parent") - window, F.col("parent") + window)).alias("id"))  # a range join as an equal one
    own = passages.select(F.col("id").alias("parent"), F.col("book").alias("_book"), F.col("page").alias("_page"))
    passages = passages.withColumn("chars", F.length("text"))  # who needs no more than that doesn't send texts about
    rows = near.join(own, "parent").join(passages, "id").filter((F.col("book") == F.col("_book")) & (F.col("page").eqNullSafe(F.col("_page")) & F.col("page").isNotNull() | (F.col("id") == F.col("parent"))))
    return rows.select("query_id", "parent", "rank", "id", "book", "text", "chars", (F.col("id") - F.col("parent")).alias("away"))


def expanded_blocks(near: DataFrame, budget: int = 3000, window: int = 3) -> DataFrame:
    """Context blocks (query_id, block, ids): each hit with its neighbours, nearest first and the later of two first, within ``budget`` characters.

    ``near`` is ``neighbours`` with ``joins``: whether a neighbour is relevant, or short and next to the hit. A block that
    overlaps one of a better hit is merged into that one while this stays within twice the budget. A query is a row of
    arrays, some hits with at most 2 ``window`` neighbours each; many queries are a batch.
    """
    chars = F.coalesce("chars" if "chars" in near.columns else F.length("text"), F.lit(0))
    fields = {"rank": F.col("rank"), "parent": F.col("parent"), "id": F.col("id"), "chars": chars, "joins": F.coalesce("joins", F.lit(False))}
    hits = near.filter("rank is not null").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*[c.cast("long").alias(n) for n, c in fields.items()]))).alias("hits"))

    def blocks(rows: list[tuple]) -> list[list[int]]:
        made: list[dict] = []
        owner: dict[int, dict] = {}
        for _, hit in itertools.groupby(rows, lambda r: r[0]):
            hit = list(hit)
            parent = hit[0][1]
            if parent in owner:
                continue
            size = {i: n for _, _, i, n, _ in hit}
            wanted = {i for _, _, i, _, ok in hit if ok}
            chosen, used = [parent], size.get(parent, 0)
            for away in range(1, window + 1):
                for i in (parent + away, parent - away):
                    if i in wanted and used + size[i] <= budget and size.get(parent, 0) < budget:
                        chosen.append(i)
                        used += size[i]
            home = next((owner[i] for i in sorted(chosen) if i in owner), None)
            if home is None:
                home = {"ids": [], "chars": 0}
                made.append(home)
                fits = True
            else:
                chosen = [i for i in chosen if i not in home["ids"]]
                fits = home["chars"] + sum(size[i] for i in chosen) <= 2 * budget
            if fits:
                home["ids"] += chosen
                home["chars"] += sum(size[i] for i in chosen)
                owner.update(dict.fromkeys(chosen, home))
        return [sorted(b["ids"]) for b in made]

    @F.pandas_udf("array<array<long>>")
    def of_queries(*columns: pd.Series) -> pd.Series:
        return pd.Series([blocks(list(zip(*(c.tolist() for c in row), strict=True))) for row in zip(*columns, strict=True)], dtype=object)

    made = hits.select("query_id", F.posexplode(of_queries(*[F.col(f"hits.{n}") for n in fields])).alias("n", "ids"))
    return made.select("query_id", (F.col("n") + 1).alias("block"), "ids")
