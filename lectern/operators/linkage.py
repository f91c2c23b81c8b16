"""Questions that repeat one another by their vectors: static pools, greedy keeping, repeats in other years, variants, look-alikes."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import vectors as V
from lectern.operators.relational import written

#: Cosines above which two questions are the same, the same with an equal answer, of one concept; of look-alikes and variants.
SAME, SAME_ANSWER, SAME_CONCEPT, LOOK_ALIKE, VARIANT, REWORDED = 0.90, 0.80, 0.88, 0.82, 0.80, 0.89
#: Fixed values: (groups of so many questions at most, the cosine they need); the cosine and option overlap of a conflict.
BY_FREQUENCY, CONFLICT = ((3, 0.80), (10, 0.85), (None, 0.89)), (0.91, 0.6)


def frequency_threshold(n: Column, steps=BY_FREQUENCY) -> Column:
    """The cosine that a match needs where its answer occurs ``n`` times: rare answers need less."""
    out = F.lit(steps[-1][1])
    for most, least in reversed(steps[:-1]):
        out = F.when(n <= most, F.lit(least)).otherwise(out)
    return out


def matched(pairs: DataFrame, steps=BY_FREQUENCY, conflict: tuple[float, float] = CONFLICT) -> DataFrame:
    """``pairs`` (same_answer, n, cosine, overlap) that match, with kind: same (answers agree) or conflict (very near, with the same options)."""
    same = F.col("same_answer") & (F.col("cosine") >= frequency_threshold(F.col("n"), steps))
    other = ~F.col("same_answer") & (F.col("cosine") >= conflict[0]) & (F.col("overlap") >= conflict[1])
    return pairs.withColumn("kind", F.when(same, "same").when(other, "conflict")).filter("kind is not null")


def pool_repeats(pairs: DataFrame, same: float = SAME, same_answer: float = SAME_ANSWER) -> DataFrame:
    """Pairs (new, old, cosine, equal answer) in which the new question repeats the old one."""
    return pairs.filter((F.col("cosine") > same) | ((F.col("cosine") > same_answer) & F.col("same_answer")))


def kept_in_order(rows: DataFrame, group: str, least: float = SAME, with_answer: float | None = SAME_ANSWER) -> DataFrame:
    """Rows (id, vector, answer) of each ``group`` that repeat no row kept before them, in order of id.

    The order decides, so a group, the questions of one request, is one task; its kept rows meet as a matrix product.
    """

    def keep(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id", kind="stable")
        vectors = np.array(part["vector"].tolist(), np.float64)
        answers = part["answer"].to_numpy()
        kept: list[int] = []
        for i in range(len(part)):
            near = vectors[kept] @ vectors[i] if kept else np.zeros(0)
            if (near > least).any() or (with_answer is not None and any(c > with_answer and answers[k] == answers[i] for c, k in zip(near, kept, strict=True))):
                continue
            kept.append(i)
        return part.iloc[kept]

    return rows.groupBy(group).applyInPandas(keep, rows.schema)


def years_with_repeats(pairs: DataFrame, years: DataFrame, least: float = REWORDED) -> DataFrame:
    """``years`` (id, years) joined with those of near questions (a, b, cosine) that were asked in none of the same years."""
    near = pairs.filter(F.col("cosine") >= least)
    both = near.select("a", "b").union(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rows = both.join(years.select(F.col("id").alias("a"), F.col("years").alias("ya")), "a").join(years.select(F.col("id").alias("b"), F.col("years").alias("yb")), "b")
    more = rows.filter(~F.arrays_overlap("ya", "yb")).select(F.col("a").alias("id"), F.explode("yb").alias("year"))
    every = more.union(years.select("id", F.explode("years").alias("year"))).distinct()
    return every.groupBy("id").agg(F.array_sort(F.collect_list("year")).alias("years"))


#: Questions of a list that ``drawn`` meets a card with, about, were they all of one concept.
LIST_ROWS = 16_384


def _draw(card: Column, question: Column, seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), card.cast("string"), question.cast("string")))


def drawn(cards: DataFrame, questions: DataFrame, seed: str = "7", list_rows: int = LIST_ROWS) -> DataFrame:
    """(card, id): any one question (id, concept) of each card's (card, concept), not itself, the one that ``variants`` takes.

    A card meets lists of questions, not questions: each list gives it the first by hash, so what is shuffled is a row a card and list.
    """
    parts = max(1, -(-questions.count() // list_rows))
    lists = questions.groupBy("concept", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).agg(F.collect_list("id").alias("ids"))
    met = cards.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).join(lists, ["concept", "part"])
    others = F.filter("ids", lambda x: x != F.col("card"))
    first = F.array_min(F.transform(others, lambda x: F.struct(_draw(F.col("card"), x, seed).alias("o"), x.alias("id"))))
    return met.select("card", first.alias("first")).filter("first is not null").groupBy("card").agg(F.min("first").alias("first")).select("card", "first.id")


def variants(cards: DataFrame, same_concept: DataFrame, nearest: DataFrame, least: float = VARIANT, seed: str = "7") -> DataFrame:
    """(card, id, tier) for each card: a question of its concept, any one, else the nearest at ``least`` or more.

    ``same_concept`` (card, id), ``nearest`` (card, id, cosine).
    """
    one = same_concept.select("card", "id", F.lit(0).alias("tier"), _draw(F.col("card"), F.col("id"), seed).alias("o"))
    two = nearest.filter(F.col("cosine") >= least).select("card", "id", F.lit(1).alias("tier"), F.format_string("%020.15f", 1 - F.col("cosine")).alias("o"))
    first = F.row_number().over(Window.partitionBy("card").orderBy("tier", "o", "id"))
    return one.unionByName(two).join(cards.select("card"), "card", "left_semi").withColumn("_n", first).filter("_n = 1").select("card", "id", "tier")


def mistake(cosine: Column, selected: Column, correct: Column, is_correct: Column, confidence: Column, least: float = LOOK_ALIKE) -> Column:
    """confusion (the options look alike), misconception (sure) or gap; null for a right answer.

    Options that differ only in numbers, and "all", "none", "both" and "neither", look like nothing.
    """
    generic = lambda x: F.coalesce(x, F.lit("")).rlike(r"(?i)^\s*(all|none|both|neither)\b") | (F.trim(F.coalesce(x, F.lit(""))) == "")
    bare = lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[\d.,%/:+\-−×]+", " "), r"\s+", " "))
    alike = ~generic(selected) & ~generic(correct) & (bare(selected) != bare(correct)) & (cosine >= least)
    return F.when(is_correct, F.lit(None).cast("string")).when(F.coalesce(alike, F.lit(False)), "confusion").when(confidence == "sure", "misconception").otherwise("gap")


#: Pairs that ``linked_vectors`` writes down at most, a vector and in all, unless so many passes don't get there; vectors that need no pass; pairs that one task goes through at the end.
PAIRS_WRITTEN, MOST_PAIRS, MOST_PASSES, FEW_VECTORS, LAST_PAIRS = 64, 1 << 25, 40, 2048, 1 << 20


def complete_linkage(edges: DataFrame, most: int = 8, last_pairs: int = LAST_PAIRS) -> DataFrame:
    """Groups in which every pair is an edge, strongest edges first, at most ``most`` members: (member, group).

    ``edges`` (a, b, weight) hold each pair once, a < b; ties go to lower a, then b; a group's name is its least member.
    In rounds: two groups can merge if all their pairs are edges and their size allows it, and they do when the
    strongest edge between them is the strongest of either. Merging never makes an edge between groups stronger, so the
    result is that of taking one edge after another. A round joins and aggregates; the last ``last_pairs`` pairs of groups, whatever the table's size, are one task.
    """
    start = edges.filter(F.col("a") < F.col("b"))
    members = written(start.select(F.explode(F.array("a", "b")).alias("member")).distinct().withColumn("group", F.col("member")), "linkage-groups")
    pairs = start.select(F.col("a").alias("g"), F.col("b").alias("h"), _top(), F.lit(1).alias("n"), F.lit(1).alias("n_g"), F.lit(1).alias("n_h"))
    return _merged(members, written(pairs.filter(F.lit(most) >= 2), "linkage-pairs"), most, last_pairs)


def _top() -> Column:
    return F.struct("weight", (-F.col("a")).alias("na"), (-F.col("b")).alias("nb")).alias("top")


def _merges(best: DataFrame) -> DataFrame:
    """(old, new, size) of the groups of ``best`` (v, size, top) that merge: two that have the same strongest edge."""
    merges = best.groupBy("top").agg(F.min("v").alias("new"), F.max("v").alias("old"), F.sum("size").cast("int").alias("size"), F.count(F.lit(1)).alias("n")).filter("n = 2")
    both = merges.select(F.explode(F.array("old", "new")).alias("old"), "new", "size")
    return written(both, "linkage-merges")


def _renamed(members: DataFrame, merges: DataFrame) -> DataFrame:
    members = members.join(merges.select(F.col("old").alias("group"), "new"), "group", "left").select("member", F.coalesce("new", "group").alias("group"))
    return written(members, "linkage-groups")


def _last_merges(pairs: DataFrame, most: int) -> DataFrame:
    """(old, new) of all groups of ``pairs`` that merge with one of a lesser name: one pair after another, in one task."""

    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches))
        rows = rows.sort_values(["weight", "na", "nb"], ascending=False, kind="stable")
        size, fits, into = {}, defaultdict(set), {}
        for g, h, n, m in zip(*(rows[c].tolist() for c in ("g", "h", "n_g", "n_h")), strict=True):
            size[g], size[h] = n, m
            fits[g].add(h)
            fits[h].add(g)
        for g, h in zip(rows["g"].tolist(), rows["h"].tolist(), strict=True):
            while g in into:
                g = into[g]
            while h in into:
                h = into[h]
            if h not in fits[g]:
                continue
            g, h = min(g, h), max(g, h)
            into[h] = g
            size[g] += size[h]
            kept = {x for x in fits[g] & fits[h] if size[x] + size[g] <= most}
            for x in fits.pop(h):
                fits[x].discard(h)
            for x in fits[g] - kept:
                fits[x].discard(g)
            fits[g] = kept
        last = []
        for old in into:
            new = into[old]
            while new in into:
                new = into[new]
            last.append((old, new))
        yield pd.DataFrame(last, columns=["old", "new"], dtype="int64")

    return pairs.select("g", "h", "n_g", "n_h", "top.*").repartition(1).mapInPandas(taken, "old long, new long")


def _merged(members: DataFrame, pairs: DataFrame, most: int, last_pairs: int = LAST_PAIRS) -> DataFrame:
    """``members`` (member, group) after all rounds over ``pairs`` (g, h, top, n, n_g, n_h): all that can merge, with their strongest edge and numbers of edges and members."""
    while left := pairs.count():
        if left <= last_pairs:
            return _renamed(members, _last_merges(pairs, most))
        ends = pairs.select(F.col("g").alias("v"), F.col("n_g").alias("size"), "top").unionByName(pairs.select(F.col("h").alias("v"), F.col("n_h").alias("size"), "top"))
        merges = _merges(ends.groupBy("v").agg(F.max("size").alias("size"), F.max("top").alias("top")))
        members = _renamed(members, merges)
        for side in ("g", "h"):
            to = merges.select(F.col("old").alias(side), F.col("new").alias(f"new_{side}"), F.col("size").alias(f"size_{side}"))
            pairs = pairs.join(to, side, "left")
        moved = F.col("new_g").isNotNull() | F.col("new_h").isNotNull()
        # only pairs of a group that merged are put together anew
        rest = pairs.filter(~moved).select("g", "h", "top", "n", "n_g", "n_h")
        pairs = pairs.filter(moved).withColumns({f"{c}_{side}": F.coalesce(f"{c}_{side}", o) for side in ("g", "h") for c, o in (("new", side), ("size", f"n_{side}"))})
        turned = F.col("new_g") > F.col("new_h")
        pairs = pairs.filter("new_g <> new_h").select(
            F.least("new_g", "new_h").alias("g"), F.greatest("new_g", "new_h").alias("h"), "top", "n",
            F.when(turned, F.col("size_h")).otherwise(F.col("size_g")).alias("n_g"), F.when(turned, F.col("size_g")).otherwise(F.col("size_h")).alias("n_h"),
        )
        pairs = pairs.filter(F.col("n_g") + F.col("n_h") <= most)
        pairs = pairs.groupBy("g", "h").agg(F.max("top").alias("top"), F.sum("n").cast("int").alias("n"), F.max("n_g").alias("n_g"), F.max("n_h").alias("n_h"))
        pairs = written(rest.unionByName(pairs.filter(F.col("n") == F.col("n_g") * F.col("n_h"))), "linkage-pairs")
    return members


def linked_vectors(
    vectors: DataFrame, least: float, most: int = 8, key: str = "vec_id", vector: str = "embedding", pairs_written: int = PAIRS_WRITTEN, few: int = FEW_VECTORS, block_rows: int = V.BLOCK_ROWS, last_pairs: int = LAST_PAIRS
) -> DataFrame:
    """``complete_linkage`` of the pairs of unit ``vectors`` with a cosine of ``least``, by weights of nine places, without a table of them: (member, group).

    Their number grows with the square of the vectors, but few are left that can merge after some passes. In a pass all groups meet by tiles,
    which leave each group's strongest edge to other cells, not the pairs. Then the groups of a cell, near ones, merge one after another as far as no
    stronger edge leads out of it (families of near copies do so at once), and two of different cells if the edge between them is the
    strongest of either. Groups that are full or fit none leave. Exact copies are one vector in the first pass. Once there are few pairs
    (``pairs_written`` a vector, MOST_PAIRS in all), they are written, and the rest goes over them.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter("v is not null")
    n = rows.count()
    width = rows.select(F.size("v")).first()[0] if n else 1
    if n <= few or most < 2:
        pairs = _pairs(rows.withColumn("g", F.col("id")).withColumn("size", F.lit(1)), least, max(most, 2), V.group_stripes(n, width, block_rows))
        members = written(pairs.select(F.explode(F.array("g", "h")).alias("member")).distinct().withColumn("group", F.col("member")), "linkage-groups")
        return _merged(members, pairs.filter(F.lit(most) >= 2), most, last_pairs)
    bound = min(pairs_written * n, MOST_PAIRS)
    copies = written(rows.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")), "linkage-copies")
    rows = copies.select(F.col("ids")[0].alias("id"), "v", F.col("ids")[0].alias("g"), F.lit(1).alias("size"), (F.size("ids") > 1).alias("held"))
    n, members, in_cells = rows.count(), None, True
    for _ in range(MOST_PASSES):
        moves, live, in_cells = _pass(rows, least, most, n, width, block_rows, in_cells)
        if members is None:
            rows = _first_groups(copies, moves, least, most)
            members = rows.select(F.col("id").alias("member"), F.col("g").alias("group"))
        else:
            members = _renamed(members, moves.select(F.col("g").alias("old"), "new"))
            rows = written(rows.drop("size", "held").join(moves.select("g", "new", "size", "open"), "g").filter(F.col("open") & (F.col("size") < most)).select("id", "v", F.col("new").alias("g"), "size", "open"), "linkage-vectors")
        rows = rows.filter(F.col("open") & (F.col("size") < most)).select("id", "v", "g", "size", F.lit(False).alias("held"))
        n = rows.count()
        if n == 0:
            return members
        if live <= bound:
            break
    return _merged(members, _pairs(rows, least, most, V.group_stripes(n, width, block_rows)), most, last_pairs)


def _pairs(rows: DataFrame, least: float, most: int, stripes: int) -> DataFrame:
    pairs = V.fitting_groups(rows, least, most, stripes)
    return written(pairs.select("g", "h", _top(), (F.col("n_g") * F.col("n_h")).alias("n"), "n_g", "n_h"), "linkage-pairs")


#: A pass merges groups within cells, too, if the one before it so merged one in so many, or merged but one in so many.
IN_CELLS, SLOW = 32, 12


def _pass(rows: DataFrame, least: float, most: int, n: int, width: int, block_rows: int, in_cells: bool) -> tuple[DataFrame, int, bool]:
    """(g, new, size, open, near) of the groups of ``rows`` (id, v, g, size, held) after a pass, at most how many pairs fitted before it, and whether the next one is to merge in cells.

    ``open``: there may be more to merge with.
    """
    if n <= block_rows:
        live, rows = n * n, rows.withColumns({"cell": F.lit(0), "weight": F.lit(float("-inf")), "a": F.lit(0).cast("long"), "b": F.lit(0).cast("long")})
        moves = V.merged_in_cells(rows, least, most)
    else:
        if in_cells:
            homes, count = V.group_homes(rows, n, block_rows)
            homes = written(homes, "linkage-cells")
            large = homes.groupBy("home").agg(F.sum("size").alias("n")).filter(F.col("n") > block_rows).select("home", F.ceil(F.col("n") / block_rows).cast("int").alias("parts"))
            cells = homes.join(F.broadcast(large), "home", "left").select("g", (F.col("home") + count * F.pmod(F.xxhash64("g"), F.coalesce("parts", F.lit(1)))).alias("cell"))
            rows = rows.join(cells, "g")
        else:
            rows = rows.withColumn("cell", F.col("g"))
        tiles = V.strongest_partners(rows, least, most, V.group_stripes(n, width, block_rows))
        best = written(tiles.groupBy("g").agg(F.max(_top()).alias("top"), F.sum("live").alias("live")), "linkage-best")
        live = best.agg(F.sum("live")).first()[0] or 0
        best = best.select("g", F.col("top.weight").alias("weight"), (-F.col("top.na")).alias("a"), (-F.col("top.nb")).alias("b"))
        if in_cells:
            moves = V.merged_in_cells(rows.join(best, "g", "left").fillna({"weight": float("-inf"), "a": 0, "b": 0}), least, most)
        else:
            some = F.when(F.col("weight") >= least - 1e-9, F.col("weight"))
            moves = rows.filter("id = g").select("g", "size").join(best, "g", "left").select("g", F.col("g").alias("new"), "size", some.alias("near"), some.alias("weight"), "a", "b")
    moves = written(moves, "linkage-moves")
    merges = _merges(moves.filter("weight is not null").select(F.col("g").alias("v"), "size", _top()))
    to = merges.select(F.col("old").alias("g"), F.col("new").alias("to"), F.col("size").alias("both"))
    groups, inside = moves.agg(F.count(F.lit(1)), F.count_if(F.col("g") != F.col("new"))).first()
    slow = SLOW * (inside + merges.count() // 2) < groups
    moves = moves.join(to, "g", "left").select("g", F.coalesce("to", "new").alias("new"), F.coalesce("both", "size").alias("size"), F.col("near").isNotNull().alias("open"), "near")
    return moves, live, slow or IN_CELLS * inside >= groups


def _first_groups(copies: DataFrame, moves: DataFrame, least: float, most: int) -> DataFrame:
    """(id, v, g, size, open) of the vectors of ``copies`` (v, ids) that have an edge, after the first pass.

    If no other vector is as near as copies are to one another, they merge first, ``most`` at a time in order of id; else each of them is a group.
    """
    m, own = F.size("ids"), F.round(V.dot(F.col("v"), F.col("v")), 9)
    rows = copies.withColumn("g", F.col("ids")[0]).join(moves, "g").withColumn("own", F.when((m > 1) & (own >= least), own))
    first = F.col("own").isNotNull() & F.coalesce(F.col("near") < F.col("own"), F.lit(True))
    rows = rows.withColumn("first", first).select("v", "ids", "new", "size", "near", "own", "first", F.posexplode("ids").alias("at", "id"))
    begins = (F.col("at") - F.col("at") % most).cast("int")
    together = F.least(F.lit(most), m - begins)
    out = rows.filter("near is not null or own is not null").select(
        "id", "v",
        F.when(m == 1, F.col("new")).when(F.col("first"), F.element_at("ids", begins + 1)).otherwise(F.col("id")).alias("g"),
        F.when(m == 1, F.col("size")).when(F.col("first"), together).otherwise(1).alias("size"),
        (F.col("near").isNotNull() | ~F.col("first")).alias("open"),
    )
    return written(out, "linkage-vectors")
