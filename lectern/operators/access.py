"""Who sees which question, and which questions a selection means: predicates, scopes and gates with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a scope may name, and what stands for it in the bank.
SOURCES = ("bank", "past")


def sees_restricted(role: Column, mode: str = "all") -> Column:
    """Whether a viewer of ``role`` (null: nobody signed in) may open restricted questions under the access ``mode``."""
    if mode == "all":
        return role.isNotNull()
    return F.coalesce(role == "admin", F.lit(False)) if mode == "admin" else F.lit(False)


def visible(access: Column, status: Column, restricted: Column, private: Column) -> Column:
    """Whether a question shows to a viewer who may or may not see ``restricted`` and ``private`` ones."""
    return (F.coalesce(access != "restricted", F.lit(True)) | restricted) & (F.coalesce(status != "private", F.lit(True)) | private)


def not_in_coalesced(column: str, values: list) -> Column:
    """NOT IN with null read as the empty string."""
    return ~F.coalesce(F.col(column), F.lit("")).isin(*values)


def of_subject(subject: str, books: list, categories: list, book: str = "book", main: str = "main_category", sub: str = "sub_category") -> Column:
    """Questions of a subject: from one of its books, or filed under it in a category that is sorted by subject. Null matches nothing."""
    filed = F.col(main).isin(*categories) & (F.col(sub) == subject)
    from_book = F.col(book).isin(*books) if books else F.lit(False)
    return F.coalesce(from_book, F.lit(False)) | F.coalesce(filed, F.lit(False))


def subject_ladder(title: Column, main: Column, sub: Column, by_title: dict[str, str], no_subject: list[str], sorted_categories: list[str], prefix: str) -> Column:
    """The subject of a question: its sub-category where that is one, else by a key in the book's title, else by one in the sub-category."""

    def named(text: Column) -> Column:
        low = F.lower(F.coalesce(text, F.lit("")))
        return F.coalesce(*[F.when(F.contains(low, F.lit(k)), F.lit(s)) for k, s in by_title.items()])

    catch_all = F.coalesce(sub.isin(*no_subject), F.lit(False))
    sorted_ = F.coalesce(main.isin(*sorted_categories), F.lit(False)) | F.coalesce(main.startswith(prefix), F.lit(False))
    return F.when(catch_all, named(title)).when(sorted_ & (F.coalesce(sub, F.lit("")) != ""), sub).otherwise(F.coalesce(named(title), named(sub)))


def normal_scope(scope: dict | None, topics: dict[str, list[str]]) -> dict:
    """A scope from outside with only what exists: sources (all if none is known), subjects, (subject, topic) pairs and years."""
    asked = scope or {}
    pairs = [tuple(str(p).partition("|")[::2]) for p in asked.get("topics") or []]
    return {
        "sources": [s for s in asked.get("sources") or SOURCES if s in SOURCES] or list(SOURCES),
        "subjects": [s for s in asked.get("subjects") or [] if s in topics],
        "topics": [(s, t) for s, t in pairs if t in topics.get(s, [])],
        "years": [int(y) for y in asked.get("years") or [] if str(y).isdigit()],
    }


def scope_buckets(scope: dict) -> list[tuple[str, str | None]]:
    """(subject, topic) of a normal scope; a subject stands for all its topics unless some were picked."""
    picked = {s for s, _ in scope["topics"]}
    return [*scope["topics"], *((s, None) for s in scope["subjects"] if s not in picked)]


def in_scope(bank: DataFrame, tags: DataFrame, papers: DataFrame, scope: dict, category: dict[str, str]) -> DataFrame:
    """Questions (id, main_category) of a normal scope. ``tags`` (id, axis, label), ``papers`` (id, year).

    A question is in if any bucket fits: it has the subject's tag, and the topic's where there is one. Years pick
    questions of past papers; those of the bank, which have none, stay where the bank is a source.
    """
    bank = bank.filter(F.col("main_category").isin(*[category[s] for s in scope["sources"]]))
    wanted = scope_buckets(scope)
    if wanted:
        # a stated selection: a few rows
        asked = F.broadcast(bank.sparkSession.createDataFrame(wanted, "subject string, topic string"))
        subject = tags.filter("axis = 'subject'").select("id", F.col("label").alias("subject")).join(asked, "subject")
        topic = tags.filter("axis = 'topic'").select("id", F.col("label").alias("topic")).distinct()
        hits = subject.filter("topic is null").select("id").union(subject.filter("topic is not null").join(topic, ["id", "topic"]).select("id"))
        bank = bank.join(hits.distinct(), "id", "left_semi")
    if scope["years"] and "past" in scope["sources"]:
        dated = papers.filter(F.col("year").isin(*scope["years"])).select("id", F.lit(True).alias("dated")).distinct()
        keep = F.coalesce("dated", F.lit(False))
        if "bank" in scope["sources"]:
            keep = keep | (F.col("main_category") == category["bank"])
        bank = bank.join(dated, "id", "left").filter(keep).drop("dated")
    return bank


def with_answered(bank: DataFrame, answers: DataFrame) -> DataFrame:
    """``bank`` with ever_right of (id, is_correct) answers: null where unanswered."""
    return bank.join(answers.groupBy("id").agg(F.bool_or("is_correct").alias("ever_right")), "id", "left")


def answered_rank(ever_right: Column) -> Column:
    """0 answered right, 1 not answered, 2 never right."""
    return F.when(ever_right, 0).when(ever_right.isNull(), 1).otherwise(2)


def seen_rank(bank: DataFrame, seen: DataFrame, served: DataFrame) -> DataFrame:
    """``bank`` with rank: 2 answered before, 1 only shown, 0 new."""
    marks = seen.select("id", F.lit(2).alias("m")).union(served.select("id", F.lit(1).alias("m"))).groupBy("id").agg(F.max("m").alias("m"))
    return bank.join(marks, "id", "left").withColumn("rank", F.coalesce("m", F.lit(0))).drop("m")


def validity(stem: Column, options: Column, keys: Column, empty: Column) -> Column:
    """Why a question can't be used, null if it can: stem, number of options, of keys, and of empty options."""
    return (
        F.when(F.trim(F.coalesce(stem, F.lit(""))) == "", F.lit("no stem"))
        .when(~options.between(2, 5), F.concat(options.cast("string"), F.lit(" options")))
        .when(keys != 1, F.lit("not exactly one key"))
        .when(empty > 0, F.lit("empty option"))
    )


def gated(rows: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """``rows`` with the first gate, in order, that stops them as ``reason``; null passes."""
    reason = F.lit(None).cast("string")
    for name, stops in reversed(gates.items()):
        reason = F.when(F.coalesce(stops, F.lit(False)), F.lit(name)).otherwise(reason)
    return rows.withColumn("reason", reason)


def retirement(kind: Column, management: Column, reveals: Column, answered: Column) -> Column:
    """What becomes of a variant: null stays; one with a fault is retired if somebody answered it, else deleted."""
    fault = ((kind == "next-step") & management) | (kind == "reverse") | reveals
    return F.when(F.coalesce(fault, F.lit(False)), F.when(answered, F.lit("retire")).otherwise("delete"))


def planned_jobs(files: DataFrame, state: DataFrame, force: bool = False, verify: bool = False) -> DataFrame:
    """(name, action, turn) for ``files`` (name) under ``state`` (name, status, children): unfinished first, then new, then those to skip."""
    rows = files.join(state, "name", "left")
    done = F.when(F.lit(force), "RETRY(force)").when(F.lit(verify) & (F.coalesce("children", F.lit(0)) == 0), "RETRY(no-data)").otherwise("SKIP")
    action = F.when(F.col("status") == "ready", done).when(F.col("status").isin("failed", "processing"), "RETRY(incomplete)").otherwise("NEW")
    turn = F.when(F.startswith("action", F.lit("RETRY")), 0).when(F.col("action") == "NEW", 1).otherwise(2)
    return rows.select("name", action.alias("action")).withColumn("turn", turn)


def unexpired(uses: Column, most: Column, expires: Column, as_of: Column) -> Column:
    """Uses left and not over; a null end never comes."""
    return (uses < most) & (expires.isNull() | (expires > as_of))


def stale(updated: Column, created: Column, newest_part: Column, as_of: Column, minutes: int = 60) -> Column:
    """Whether nothing was written for ``minutes``; ``as_of`` is passed in, never the wall clock."""
    return F.greatest(updated, created, F.coalesce(newest_part, created)) < as_of - F.expr(f"interval {minutes} minutes")


def due(rows: DataFrame, at: str, as_of: Column, limit: int = 50, *ties: str) -> DataFrame:
    """Rows due at ``as_of``, those never shown (null) first."""
    return rows.filter(F.col(at).isNull() | (F.col(at) <= as_of)).orderBy(F.asc_nulls_first(at), *ties).limit(limit)


def page(rows: DataFrame, order: list[Column | str], offset: int, limit: int) -> DataFrame:
    """One page in a total order, with how many rows there are in all; a page past the end is one row with the total alone."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return total.join(rows.orderBy(*order).offset(offset).limit(limit), F.lit(True), "left").select(*rows.columns, "total")
