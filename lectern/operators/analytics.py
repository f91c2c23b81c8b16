"""Learner analytics on answer facts (``sources.tables.answers``). All are aggregates with map-side combine.

``as_of`` is never the wall clock: where a window needs one it is the latest event, taken as a one-row aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.sources.tables import weight

#: Fixed values of the forecast: answers a subject needs, share of the paper that must be covered, answers of a peer.
MIN_ANSWERS, MIN_COVERAGE, PEER_ANSWERS, PEERS = 10, 0.3, 30, 4


def percent(part: Column, whole: Column) -> Column:
    """Percentage to one decimal; null where there is nothing to divide by."""
    return F.round(F.when(whole > 0, F.lit(100.0) * part.cast("double") / whole.cast("double")), 1)


def right() -> Column:
    return F.count_if("is_correct").alias("correct")


def recent(ev: DataFrame, days: int) -> DataFrame:
    """Answers of the last ``days`` days before the latest one."""
    end = ev.agg(F.max("ts").alias("end"))
    return ev.join(F.broadcast(end), F.col("ts") >= F.col("end") - F.expr(f"interval {days} days")).drop("end")


def totals(ev: DataFrame) -> DataFrame:
    end = ev.agg(F.max("ts").alias("end"))
    return ev.join(F.broadcast(end)).agg(
        F.count(F.lit(1)).alias("n"), right(), F.countDistinct(F.to_date("ts")).alias("days"), F.count_if(F.col("ts") >= F.col("end") - F.expr("interval 7 days")).alias("last_week")
    )


def by_feature(ev: DataFrame) -> DataFrame:
    return ev.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), right(), F.max("ts").alias("last_at")).withColumn("pct", percent(F.col("correct"), F.col("n")))


def weekly_trend(ev: DataFrame, weeks: int = 12) -> DataFrame:
    """Counts by week (Monday) of the last ``weeks`` weeks."""
    week = F.date_trunc("week", "ts").cast("date")
    end = ev.agg(F.date_trunc("week", F.max("ts")).cast("date").alias("end"))
    return ev.groupBy(week.alias("week")).agg(F.count(F.lit(1)).alias("n"), right()).join(F.broadcast(end), F.col("week") >= F.date_sub("end", 7 * (weeks - 1))).drop("end")


def weakest(ev: DataFrame, catch_all: tuple[int, ...] = (0, 9), least: int = MIN_ANSWERS, k: int = 3) -> DataFrame:
    """The ``k`` subjects of lowest accuracy among those with enough answers, catch-all subjects left out."""
    by = ev.filter(~F.coalesce("subject", F.lit(-1)).isin(*catch_all)).groupBy("subject").agg(F.count(F.lit(1)).alias("n"), right())
    return by.filter(F.col("n") >= least).withColumn("pct", percent(F.col("correct"), F.col("n"))).orderBy("pct", "subject").limit(k)


def sessions(ev: DataFrame) -> DataFrame:
    """Per user and session: the commonest subject (least on ties), counts, first and last answer."""
    return ev.groupBy("user_id", "session").agg(F.mode("subject", True).alias("subject"), F.count(F.lit(1)).alias("n"), right(), F.min("ts").alias("began"), F.max("ts").alias("ended"))


def answered_and_missed(ev: DataFrame) -> DataFrame:
    """Per user: questions answered, and those never answered right."""
    by = ev.groupBy("user_id", "k").agg(F.bool_or("is_correct").alias("ever"))
    return by.groupBy("user_id").agg(F.count(F.lit(1)).alias("answered"), F.count_if(~F.col("ever")).alias("missed"))


def mastery(ev: DataFrame, days: int = 60) -> DataFrame:
    """Per user and subject: answers and confidence-weighted share of right ones."""
    score = F.sum(F.when(F.col("is_correct"), weight()).otherwise(0.0))
    by = recent(ev, days).groupBy("user_id", "subject").agg(F.count(F.lit(1)).alias("n"), score.alias("score"))
    return by.select("user_id", "subject", "n", (F.col("score") / F.col("n")).alias("mastery"))


def shares(ev: DataFrame, by: str = "subject") -> DataFrame:
    """Each group's share of all rows; the total is one row, joined back by broadcast."""
    counts = ev.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(by, "n", (F.col("n").cast("double") / F.col("total")).alias("share"))


def forecast(ev: DataFrame) -> DataFrame:
    """Per user: predicted score and 95 percent range, subjects weighted by their share of the bank; null below the coverage floor."""
    m = mastery(ev).filter(F.col("n") >= MIN_ANSWERS).join(F.broadcast(shares(ev).select("subject", "share")), "subject")
    total = m.groupBy("user_id").agg(
        F.sum("share").alias("coverage"),
        F.sum(F.col("share") * F.col("mastery")).alias("s"),
        F.sum(F.col("share") * F.col("share") * F.col("mastery") * (1 - F.col("mastery")) / F.col("n")).alias("v"),
    )
    enough = F.col("coverage") >= MIN_COVERAGE
    score, half = F.col("s") / F.col("coverage"), F.lit(1.96) * F.sqrt("v") / F.col("coverage")
    return total.select(
        "user_id",
        F.round("coverage", 3).alias("coverage"),
        F.when(enough, F.round(score, 3)).alias("score"),
        F.when(enough, F.round(F.greatest(F.lit(0.0), score - half), 3)).alias("low"),
        F.when(enough, F.round(F.least(F.lit(1.0), score + half), 3)).alias("high"),
    )


def peer_standing(scores: DataFrame, least: int = PEERS, among: DataFrame | None = None) -> DataFrame:
    """Mid-rank percentile of each score among the others: 100 (below + ties / 2) / others, null with fewer than ``least`` others.

    ``among`` (user_id) names the peers; others stand among them without counting. Ranks come from one row a distinct score, so no window holds all users.
    """
    scores = scores.filter("score is not null").withColumn("peer", F.lit(1))
    if among is not None:
        scores = scores.drop("peer").join(among.select("user_id", F.lit(1).alias("peer")), "user_id", "left").fillna(0, ["peer"])
    by = scores.groupBy("score").agg(F.sum("peer").alias("same"))
    below = Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranks = by.withColumn("below", F.coalesce(F.sum("same").over(below), F.lit(0)))
    n = by.agg(F.sum("same").alias("n"))
    out = scores.join(ranks, "score").join(F.broadcast(n))
    others = F.col("n") - F.col("peer")
    ahead = F.rint(F.lit(100.0) * (F.col("below") + F.lit(0.5) * (F.col("same") - F.col("peer"))) / others)
    return out.select("user_id", "score", others.alias("others"), F.when(others >= least, ahead).alias("ahead_of"))


def mistakes(ev: DataFrame) -> DataFrame:
    """Wrong answers by kind (a sure one is a misconception, another a gap) with each kind's share, per user."""
    kind = F.when(F.col("confidence") == "sure", "misconception").otherwise("gap")
    by = ev.filter(~F.col("is_correct")).groupBy("user_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("pct", percent(F.col("n"), F.sum("n").over(Window.partitionBy("user_id"))))


def mastery_map(ev: DataFrame, pass_line: float = 75.0) -> DataFrame:
    """Per subject: questions of the bank, questions answered, accuracy, coverage and risk (0 weak, 1 healthy, 2 untouched)."""
    bank = ev.groupBy("subject").agg(F.countDistinct("k").alias("bank"))
    done = ev.filter("event_type <> 'error'").groupBy("subject").agg(F.countDistinct("k").alias("answered"), F.count(F.lit(1)).alias("n"), right())
    out = bank.join(done, "subject", "left").fillna(0, ["answered", "n", "correct"])
    accuracy = percent(F.col("correct"), F.col("n"))
    risk = F.when(F.col("answered") == 0, 2).when((F.col("n") < 4) | (accuracy < pass_line), 0).otherwise(1)
    return out.select("subject", "bank", "answered", accuracy.alias("accuracy"), percent(F.col("answered"), F.col("bank")).alias("coverage"), risk.alias("risk"))


def readiness(ev: DataFrame) -> DataFrame:
    """Per user: answer-weighted mean mastery of the subjects with enough answers, and how many there are."""
    m = mastery(ev)
    ok = F.col("n") >= MIN_ANSWERS
    return m.groupBy("user_id").agg(
        F.count_if(ok).alias("subjects"), F.round(F.sum(F.when(ok, F.col("mastery") * F.col("n"))) / F.sum(F.when(ok, F.col("n"))), 3).alias("predicted")
    )


def activity(ev: DataFrame) -> DataFrame:
    return ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_at"))


def retrieval_metrics(ranked: DataFrame, k: int = 5) -> DataFrame:
    """MRR, and hit rate and recall at ``k``, of (query_id, rank, relevant): one row. A query without a relevant row counts as a miss."""
    hits = F.count_if(F.col("relevant") & (F.col("rank") <= k)) / F.nullif(F.count_if("relevant"), F.lit(0))
    first = ranked.groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"), F.coalesce(hits, F.lit(0.0)).alias("recall"))
    return first.agg(
        F.count(F.lit(1)).alias("queries"),
        F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)), 6).alias("hit_at_k"),
        F.round(F.avg("recall"), 6).alias("recall_at_k"),
    )


def peers(ev: DataFrame, days: int = 60, least: int = PEER_ANSWERS) -> DataFrame:
    """Users with at least ``least`` answers in the last ``days`` days."""
    return recent(ev, days).groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("user_id")


def daily_target(bank: Column, answered: Column, due_week: Column, days_left: Column) -> Column:
    """Questions a day until the exam: what is left of the bank and of the week's reviews, from 15 to 80; null without days left."""
    new = F.ceil(F.greatest(F.lit(0), bank - answered) / days_left) + F.ceil(due_week / 7)
    return F.when(days_left > 0, F.least(F.lit(80), F.greatest(F.lit(15), new)).cast("int"))


def folded(rows: DataFrame, column: str, aliases: dict[str, str], unnamed: str = "Unlabelled") -> DataFrame:
    """``column`` with aliases, by lower case, as one name, and null as ``unnamed``."""
    name = F.trim(F.coalesce(column, F.lit(unnamed)))
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else None
    return rows.withColumn(column, F.coalesce(known[F.lower(name)], name) if known is not None else name)


def frequency(recalls: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Per chapter: recalls, headlines, disputed ones and the chapter's share of all."""
    by = folded(recalls, "chapter", aliases).groupBy("chapter").agg(
        F.count(F.lit(1)).alias("recalls"), F.sum(F.when(F.col("kind") == "headline", 1).otherwise(0)).alias("headlines"), F.count_if(F.col("verdict").isin("contradicted", "books_conflict")).alias("disputed")
    )
    total = by.agg(F.sum("recalls").alias("total"))
    return by.join(F.broadcast(total)).select("chapter", "recalls", "headlines", "disputed", F.round(F.col("recalls") / F.col("total"), 4).alias("share"))


def times_asked(pairs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, times): one for the question itself and one for each neighbour of ``pairs`` (a, b)."""
    both = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return ids.join(both, "id", "left").select("id", (1 + F.coalesce("n", F.lit(0))).alias("times"))


def fact_recall(answers_: DataFrame) -> DataFrame:
    """``answers_`` (query_id, text, facts: groups of phrases) with the share of groups of which any phrase stands in the text, and the first phrases of the others."""
    low = F.concat(F.lit(" "), F.lower("text"), F.lit(" "))
    missed = F.filter("facts", lambda g: ~F.exists(g, lambda phrase: F.contains(low, phrase)))
    share = F.when(F.size("facts") > 0, 1 - F.size(missed) / F.size("facts"))
    return answers_.select("query_id", share.alias("recall"), F.transform(missed, lambda g: F.get(g, F.lit(0))).alias("missing"))


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row on (id, hit) of both runs: common questions, hits before and after, gained and lost."""
    both = before.select("id", F.col("hit").alias("was")).join(after.select("id", F.col("hit").alias("now")), "id")
    return both.agg(
        F.count(F.lit(1)).alias("common"), F.count_if("was").alias("before"), F.count_if("now").alias("after"), F.count_if(F.col("now") & ~F.col("was")).alias("gained"), F.count_if(F.col("was") & ~F.col("now")).alias("lost")
    )


def best_of(scores: DataFrame, *keys: str) -> DataFrame:
    """The best score of each key over several queries."""
    return scores.groupBy(*keys).agg(F.max("score").alias("score"))


def attempt_trend(attempts: DataFrame, last: int = 15) -> DataFrame:
    """The last ``last`` attempts (user_id, attempt_id, at, score, total) of each user with their accuracy."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("at"), F.desc("attempt_id")))
    return attempts.withColumn("_n", n).filter(F.col("_n") <= last).drop("_n").withColumn("accuracy", F.coalesce(percent(F.col("score"), F.col("total")), F.lit(0.0)))


def set_history(questions: DataFrame) -> DataFrame:
    """Per quiz set: questions, greatest topic and difficulty, and the newest question's id, by which sets are shown."""
    return questions.filter("quiz_set_id is not null").groupBy("quiz_set_id").agg(F.count(F.lit(1)).alias("n"), F.max("topic").alias("topic"), F.max("difficulty").alias("difficulty"), F.max("id").alias("newest"))


def attention(topics: DataFrame, pass_line: float = 75.0) -> Column:
    """The tier of a topic: 0 begun, 1 weak, 2 untouched, 3 the rest."""
    return F.when(topics["answered"].between(1, 3), 0).when((topics["answered"] >= 4) & (F.coalesce(topics["accuracy"], F.lit(0.0)) < pass_line), 1).when(topics["answered"] == 0, 2).otherwise(3)
