"""Stems, the inverted index with cover density, cells of vectors, linkage in rounds, and work in proportion to the text."""

import hashlib
import itertools
import math
import os
import random
import re
import time
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import vectors as V
from lectern.functions.stem import stemmed
from lectern.operators import cells as N
from lectern.operators import compare as C
from lectern.operators import index as X
from lectern.operators import linkage as L
from lectern.operators import ordered as O
from lectern.operators import retrieval as H
from lectern.plans import QUERIES

# Words with their stems as the published vocabulary of the rules gives them.
STEMS = """
    consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist
    consolation consol consolations consol consolatory consolatori console consol consolidate consolid consolidated consolid consols consol consonant conson consort consort
    consorted consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspire conspir constable constabl constancy constanc constant constant
    knack knack knackeries knackeri knacks knack knag knag knave knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneels kneel knees knee
    knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob
    knobs knob knock knock knocked knock knocker knocker knocking knock knocks knock knopp knopp knot knot knots knot
    generate generat generously generous communication communic arsenal arsenal skies sky dying die singly singl news news inning inning innings inning succeeded succeed
    ties tie cries cri gas gas this this gaps gap kiwis kiwi bed bed bedding bed hoping hope hopping hop hoped hope luxuriated luxuri filing file by by say say cry cri enjoyment enjoy
    relational relat sensibility sensibl analogy analog hopefulness hope formalize formal electrical electr feed feed agreed agre rate rate roll roll controll control adoption adopt
""".split()


def test_stems(spark):
    pairs = list(zip(STEMS[::2], STEMS[1::2], strict=True))
    words = spark.createDataFrame([(w, k) for k, (w, _) in enumerate(pairs)] + [(None, -1), ("", -2), ("yy", -3)], "word string, k int")
    got = {r["k"]: r["stem"] for r in stemmed(words).collect()}
    assert {pairs[k][0]: s for k, s in got.items() if k >= 0} == dict(pairs) and got[-1] is None and got[-2] == "" and got[-3] == "yy"


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "bcdfg" for b in ("ane", "ole", "umed", "ing", "ation")] + ["rare", "odd9", "the"]
    weights = [1 / (k + 1) for k in range(len(words))]
    docs = [(k, " ".join(rng.choices(words, weights, k=rng.randint(0, 60)))) for k in range(n)] + [(n, None), (n + 1, ""), (n + 2, "3rare 12")]
    return docs, words, rng


def tokens(text):
    runs = re.findall("[a-z0-9]+", (text or "").lower())
    return [(at, re.sub("^[0-9]+", "", w)) for at, w in enumerate(runs) if len(re.sub("^[0-9]+", "", w)) >= 3]


@pytest.mark.parametrize("range_docs", [4, 64])
def test_bounds_lose_no_hit(spark, tmp_path, range_docs):
    docs, words, rng = corpus(range_docs, 400)
    index = X.write_index(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path / "ix"), range_docs=range_docs, buckets=4)
    queries = [(q, rng.sample(words, rng.randint(1, 4)) + ["absent"] * (q % 5 == 0)) for q in range(25)]
    got = defaultdict(list)
    for r in X.top_hits(index, spark.createDataFrame(queries, "query_id int, terms array<string>"), 10).collect():
        got[r["query_id"]].append((-r["score"], r["doc"], r["matched"]))
    said = {d: [w for _, w in tokens(t)] for d, t in docs}
    mean, n = sum(map(len, said.values())) / len(said), len(said)
    df = {w: sum(w in s for s in said.values()) for w in words}
    for q, terms in queries:
        want = []
        for d, s in said.items():
            hit = [w for w in set(terms) if w in s]
            if hit:
                score = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * s.count(w) * 2.2 / (s.count(w) + 1.2 * (0.25 + 0.75 * len(s) / mean)) for w in hit)
                want.append((-round(score, 6), d, len(hit)))
        close = lambda rows: [(round(s, 4), d, m) for s, d, m in sorted(rows)[:10]]
        assert close(got[q]) == close(want)
        assert {d for _, d, m in want if m == len(set(terms))} <= {d for _, d, _ in got[q]}


def covers(places):
    """Shortest stretches that have all terms, by trying every stretch."""
    at = sorted((p, k) for k, some in enumerate(places) for p in some)
    full = [(i, j) for i in range(len(at)) for j in range(i, len(at)) if {k for _, k in at[i : j + 1]} == set(range(len(places)))]
    least = [(i, j) for i, j in full if not any((x, y) != (i, j) and i <= x and y <= j for x, y in full)]
    return sum(0.1 / (1 + at[j][0] - at[i][0] - (j - i)) for i, j in least)


def test_cover_density_against_every_stretch(spark, tmp_path):
    docs, words, rng = corpus(3, 120)
    stems = {r["word"]: r["stem"] for r in stemmed(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    index = X.write_index(spark.createDataFrame(docs, "doc_id long, text string"), str(tmp_path / "ix"), range_docs=16, buckets=4)
    queries = [(q, rng.sample(words, rng.randint(1, 4))) for q in range(20)]
    got = {(r["query_id"], r["doc"]): (r["score"], r["matched"]) for r in X.cover_hits(index, spark.createDataFrame(queries, "query_id int, terms array<string>"), 3).collect()}
    want = {}
    for q, terms in queries:
        asked, strict, loose = sorted({stems[w] for w in terms}), {}, {}
        for d, t in docs:
            places = [[at for at, w in tokens(t) if stems[w] == s] for s in asked]
            n = sum(map(bool, places))
            if n == len(asked):
                strict[q, d] = (round(covers(places), 6), n)
            elif n:
                loose[q, d] = (round(0.1 * sum(map(len, places)), 6), n)
        want |= strict | ({} if len(strict) >= 3 else loose)
    assert got.keys() == want.keys()
    assert all(abs(got[k][0] - want[k][0]) < 2e-6 and got[k][1] == want[k][1] for k in want)


def test_scanned_covers_are_those_of_the_index(spark, tmp_path):
    docs, words, rng = corpus(5, 200)
    docs += [(9001, None), (9002, ""), (9003, f"7{words[0]} {words[1].upper()}, 12 x {words[0]}s {words[1]}")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    queries = spark.createDataFrame([(q, rng.sample(words, rng.randint(1, 4))) for q in range(20)] + [(30, words[:2]), (31, ["nowhere"]), (32, []), (33, None)], "query_id int, terms array<string>")
    index = X.write_index(docs, str(tmp_path / "ix"), range_docs=16, buckets=4)
    for limit in (3, 30):
        want, got = (
            sorted(tuple(r) for r in H.strict_then_any(h.withColumnRenamed("doc", "doc_id"), limit).select("query_id", "doc_id", "strict", "rank", F.round("score", 5)).collect())
            for h in (X.cover_hits(index, queries, 3), X.scanned_covers(docs.repartition(3), queries, limit))
        )
        assert got == want and len({r[0] for r in got}) > 15
    assert X.scanned_covers(docs, queries.filter("query_id = 32"), 3).count() == 0
    assert X.scanned_covers(docs.limit(0), queries, 3).count() == 0


def test_cover_density_search_makes_no_index(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    assert QUERIES["cover_density_search"](spark, "/root/testdata/sf0.001").count() > 0
    assert not [x for x in set(os.listdir(shared)) - before if x.startswith("index-")]


def test_an_index_of_nothing(spark, tmp_path):
    index = X.write_index(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "ix"))
    queries = spark.createDataFrame([(1, ["word"])], "query_id int, terms array<string>")
    assert X.top_hits(index, queries, 3).count() == 0 and X.cover_hits(index, queries, 3).count() == 0


@pytest.mark.parametrize("group", [None, "label"])
def test_cells_give_the_full_scan(spark, tmp_path, group):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(1500):
        v = centres[i % 12] + 0.15 * rng.normal(size=16)
        rows.append((i, (v / np.linalg.norm(v) * (1 + 0.2 * (i % 3))).astype(np.float32).tolist(), i % 7))
    rows += [(2000, rows[0][1], 0), (2001, rows[0][1], 0), (2002, None, 1)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    cells = N.write_cells(e, str(tmp_path / "c"), group=group, cell_rows=40)
    found = N.nearest_in_cells(cells, e.filter("vec_id % 20 = 0"), 6, group=group, queries_at_once=30)
    got = {(r["query"], r["rank"]): r["id"] for r in found.rows.collect()}
    want = {}
    for q, v, g in rows:
        if q % 20 == 0:
            scores = sorted((-round(float(np.array(v) @ np.array(w)), 12), i) for i, w, h in rows if w is not None and (group is None or g == h))
            want |= {(q, k + 1): i for k, (_, i) in enumerate(scores[:6])}
    assert got == want
    assert found.read < 0.5 * found.full
    print("share of vectors read", found.read / found.full)


def test_linkage_in_rounds_is_the_greedy_order(spark):
    rng = random.Random(9)
    for n, share, most in ((30, 0.5, 8), (60, 0.3, 3), (25, 0.9, 25)):
        edges = [(a, b, rng.choice([0.3, 0.5, 0.7, rng.random()])) for a, b in itertools.combinations(range(n), 2) if rng.random() < share]
        joined, team = {(a, b) for a, b, _ in edges}, {m: {m} for a, b, _ in edges for m in (a, b)}
        for a, b, _ in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
            x, y = team[a], team[b]
            if x is not y and len(x) + len(y) <= most and all((min(p, q), max(p, q)) in joined for p in x for q in y):
                for m in (both := x | y):
                    team[m] = both
        got = {tuple(r) for r in L.complete_linkage(spark.createDataFrame(edges, "a long, b long, weight double"), most).collect()}
        assert got == {(m, min(t)) for m, t in team.items()}


def greedy(vectors, least, most):
    """Complete linkage, one edge after another."""
    s = np.round(vectors @ vectors.T, 9)
    a, b = np.nonzero(np.triu(s >= least, 1))
    team = {int(m): [int(m)] for m in np.r_[a, b]}
    for i in np.lexsort((b, a, -s[a, b])):
        x, y = team[a[i]], team[b[i]]
        if x is not y and len(x) + len(y) <= most and (s[np.ix_(x, y)] >= least).all():
            for m in (both := x + y):
                team[m] = both
    return {(m, min(t)) for m, t in team.items()}


@pytest.mark.parametrize(("n", "least", "most", "written"), [(300, 0.3, 8, 1), (120, 0.3, 1, 64)])
def test_linkage_in_passes_is_the_greedy_order(spark, n, least, most, written):
    rng = np.random.default_rng(n + most)
    vectors = rng.normal(size=(n, 10))
    vectors[: n // 5] = vectors[0] + 0.1 * rng.normal(size=(n // 5, 10))  # a family of near copies
    vectors[n // 2 : n // 2 + 6] = vectors[n // 2]  # exact copies: ties
    vectors = np.round(vectors / np.linalg.norm(vectors, axis=1)[:, None], 12)
    rows = spark.createDataFrame([(3 * i - 50, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    want = {(3 * m - 50, 3 * t - 50) for m, t in greedy(vectors, least, most)}
    for few in (0, n):
        got = L.linked_vectors(rows, least, most, pairs_written=written, few=few, block_rows=40)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_linkage_writes_no_table_of_all_pairs(spark, tmp_path):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(2600, 12))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    got = {tuple(r) for r in QUERIES["complete_linkage"](spark, str(tmp_path)).collect()}
    most = max(spark.read.parquet(f"{shared}/{x}").count() for x in set(os.listdir(shared)) - before)
    assert got == greedy(vectors, 0.3, 8)
    pairs = int((np.triu(vectors @ vectors.T, 1) >= 0.3).sum())
    assert pairs > 100 * 2600 and most <= 64 * 2600, (pairs, most)


@pytest.mark.parametrize(("copies", "near"), [(0, 150), (150, 0), (90, 90)])
def test_families_of_copies_take_few_passes(spark, copies, near):
    rng = np.random.default_rng(copies + 2 * near)
    vectors = rng.normal(size=(420, 16))
    vectors[100 : 100 + copies] = vectors[100]
    vectors[300 : 300 + near // 2] = vectors[300] + 0.02 * rng.normal(size=(near // 2, 16))
    vectors[20 : 20 + near // 2] = vectors[20] + 0.02 * rng.normal(size=(near // 2, 16))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    vectors[400:403] = vectors[399]
    vectors[403:405] = vectors[399] + 1e-12  # as near to the copies of another vector as those are to one another
    order = rng.permutation(len(vectors))
    rows = spark.createDataFrame([(int(i), vectors[i].tolist()) for i in order], "vec_id long, embedding array<double>")
    shared = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(shared))
    got = L.linked_vectors(rows, 0.3, 8, few=0, block_rows=120, last_pairs=10_000)
    assert sorted(tuple(r) for r in got.collect()) == sorted(greedy(vectors, 0.3, 8))
    passes = sum(x.startswith("linkage-best") for x in set(os.listdir(shared)) - before)
    assert passes <= 5, passes


def test_rounds_without_a_last_task(spark):
    rng = random.Random(4)
    edges = [(a, b, rng.choice([0.3, 0.5, rng.random()])) for a, b in itertools.combinations(range(40), 2) if rng.random() < 0.5]
    rows = spark.createDataFrame(edges, "a long, b long, weight double")
    one, all_ = (sorted(tuple(r) for r in L.complete_linkage(rows, 5, last_pairs=n).collect()) for n in (0, 1000))
    assert one == all_ and len({g for _, g in one}) < 40


@pytest.mark.parametrize("same", [True, False])
def test_groups_meet_as_their_members_do(same):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(900, 12)) + 0.5 * rng.normal(size=12)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    g = np.sort(np.r_[np.arange(500), rng.integers(0, 150, 400)])
    ids, size, cell = np.arange(900) * 7 + 5, np.bincount(g, minlength=500), np.arange(500) % 11
    left = np.ones(500, bool) if same else np.arange(500) % 2 == 0
    s = vectors.astype(np.float64) @ vectors.astype(np.float64).T
    best, fitting = {}, set()
    for p, q in itertools.combinations(range(500), 2):
        x, y = np.flatnonzero(g == p), np.flatnonzero(g == q)
        part = s[np.ix_(x, y)]
        if part.min() >= 0.2 and size[p] + size[q] <= 8 and (same or left[p] != left[q]):
            fitting.add((p, q))
            top = min((-round(float(part[i, j]), 9), *sorted((int(ids[x[i]]), int(ids[y[j]])))) for i in range(len(x)) for j in range(len(y)))
            if cell[p] != cell[q]:
                for c in (p, q):
                    best[c] = min(best.get(c, top), top)
    order = rng.permutation(900)
    args = [x[order] for x in (ids, vectors, g, size[g], cell[g], left[g])]
    out = pd.concat(list(V._meet(*args, same, 0.2, 8, V._Strongest)))
    assert {r.g: (-r.weight, r.a, r.b) for r in out.itertuples() if np.isfinite(r.weight)} == best
    assert out["live"].sum() >= len(fitting)
    assert {(r.g, r.h) for r in pd.concat(list(V._meet(*args, same, 0.2, 8, V._Every))).itertuples()} == fitting


def test_time_follows_the_text(spark):
    one = lambda s: spark.createDataFrame([(s,)], "s string")
    text = " ".join(f"Sentence {i} has some words in it." for i in range(8000))
    T_ = lambda df: time.perf_counter() - (began := time.perf_counter()) if df.collect() is None else None  # noqa: E731,F841
    one("A b. C d.").select(T.children(F.col("s"))).collect()
    began = time.perf_counter()
    got = one(text).select(T.children(F.col("s")).alias("c")).first()["c"]
    assert time.perf_counter() - began < 4 and " ".join(got) == text and all(len(c.split()) <= 150 for c in got)
    allowed = F.array(F.struct(F.lit("book").alias("title"), F.lit(3).alias("page")))
    sheet = "\n".join(line for i in range(700) for line in (f"# Heading {i}", f"- bullet {i} [Book, Page 3]", f"- bare {i}"))
    began = time.perf_counter()
    kept = one(sheet).select(T.kept_lines(F.col("s"), allowed).alias("k")).first()["k"]
    assert time.perf_counter() - began < 4 and kept.count("\n") == 1399


def plain_children(text, most=150):
    out, held, n = [], [], 0
    for s in (x for x in re.split(r"(?<=[.!?])\s+", text.strip(" ")) if x.strip(" ")):
        k = len(re.split(r"\s+", s.strip(" ")))
        if n and n + k > most:
            out.append(" ".join(held))
            held, n = [], 0
        held.append(s)
        n += k
    return out + ([" ".join(held)] if held else [])


def test_children_against_a_loop(spark):
    rng = random.Random(5)
    texts = ["", " ", "one", "no end " * 400, "! ? . x", "a.\n\nb! c"] + [" ".join(rng.choice(["w", "w.", "w!", "long " * 30 + "end?"]) for _ in range(rng.randint(1, 300))) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, s string").select("k", T.children(F.col("s")).alias("c")).collect()
    assert {r["k"]: r["c"] for r in rows} == {k: plain_children(t) for k, t in enumerate(texts)}


def test_support_by_stems_is_that_of_pairs(spark):
    answers = ["The oedema of fluid difficulty", "3.5 mg twice", "with and the", "", None, "anaemia haemoglobin 12 affluent", "tumour growth"]
    passages = ["Edema fluid is a dificulty.", "take 13.52mg twice daily", "hemoglobin 12 in anemia; afluent", None, "", "tumorgrowth", "nothing here"]
    a = spark.createDataFrame(list(enumerate(answers)), "item_id int, answer string")
    p = spark.createDataFrame(list(enumerate(passages)), "doc_id int, text string")
    got = {(r["item_id"], r["doc_id"]) for r in C.supported_by(a, p).collect()}
    pairs = a.crossJoin(p).select("item_id", "doc_id", T.supported(F.col("answer"), F.col("text")).alias("ok"), F.size(T.support_words(F.col("answer"))).alias("n")).collect()
    assert got == {(r["item_id"], r["doc_id"]) for r in pairs if r["ok"] and r["n"]} | {(r["item_id"], None) for r in pairs if not r["n"]}


def test_ten_million_seats_without_a_row_each(spark):
    buckets = [(f"b{k:02}", 37_000 * k if k % 6 else None) for k in range(25)]
    df = spark.createDataFrame(buckets, "bucket string, available long")
    for n in (0, 3, 17, 500_000, 10_000_000, 10**9):
        left, got = {b: a or 0 for b, a in buckets}, dict.fromkeys((b for b, _ in buckets), 0)
        rest = n
        while rest and any(left.values()):
            open_ = [b for b in sorted(left) if left[b]]
            turns = min(rest // len(open_), min(left[b] for b in open_)) or 1
            for b in open_[: rest if rest < len(open_) else None]:
                left[b], got[b], rest = left[b] - turns, got[b] + turns, rest - turns
        assert {r["bucket"]: r["given"] for r in O.fair_split(df, n).collect()} == {b: g for b, g in got.items() if g}
        assert V is not None


def test_best_holds_few_and_equals_a_sort():
    rng = np.random.default_rng(4)
    scores, ids = np.round(rng.normal(size=(30, 4000)), 2), rng.permutation(4000)
    held, yielded = V.Best(30, 7), 0
    for lo in range(0, 4000, 250):
        held.see(np.arange(30), ids[lo : lo + 250], scores[:, lo : lo + 250])
        yielded = max(yielded, held.count)
    row, found, top = held.rows()
    for q in range(30):
        want = sorted(zip(-scores[q], ids, strict=True))[:7]
        assert [(-s, i) for s, i in zip(top[row == q], found[row == q], strict=True)] == want
    assert yielded < 30 * 1000  # of 30 * 4000 scores


def test_cells_keep_k_rows_a_task(spark, tmp_path):
    """Rows written for a block of queries are those of a task, not of each cell."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(600, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    cells = N.write_cells(e, str(tmp_path / "cells"), cell_rows=10)
    ids, plan = np.arange(20), np.ones((20, len(cells.names)), bool)
    found = N._scan(cells, plan, ids, v[:20], None, 3, np.full(20, -np.inf))
    assert found.count() <= found.rdd.getNumPartitions() * 20 * 3 < 20 * len(cells.names) * 3
    near = N.nearest_in_cells(cells, e.filter("vec_id < 20"), 3).rows.collect()
    want = {(q, int(i)) for q in range(20) for i in np.argsort(-np.round(v[:20] @ v.T, 12)[q], kind="stable")[:3]}
    assert {(r["query"], r["id"]) for r in near} == want


def test_a_drawn_variant_is_that_of_all_pairs(spark):
    rows = [(i, i % 3) for i in range(90)] + [(500, 9)]
    q = spark.createDataFrame(rows, "id long, concept int")
    cards = q.filter("id % 5 = 0").withColumnRenamed("id", "card")
    got = {tuple(r) for r in L.drawn(cards, q, list_rows=20).collect()}
    draw = lambda c, i: (hashlib.md5(f"7:{c}:{i}".encode()).hexdigest(), i)
    want = {(c, min((i for i, y in rows if y == x and i != c), key=lambda i: draw(c, i))) for c, x in rows if c % 5 == 0 and c != 500}  # noqa: B023
    assert got == want


def test_support_is_counted_where_a_passage_lies(spark):
    a = spark.createDataFrame([(1, "renal calculi obstruct"), (2, "")], "item_id int, answer string")
    rows = [(2**60 + 1, "renal calculi"), (None, "calculi obstruct"), (3, "renal"), (4, None)]
    found = C.supported_by(a, spark.createDataFrame(rows, "doc_id long, text string"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r["item_id"], r["doc_id"], round(r["share"], 4)) for r in found.collect()}
    assert got == {(1, 2**60 + 1, 0.6667), (1, None, 0.6667), (2, None, 1.0)}


def test_scanned_hits_are_those_of_the_index(spark, tmp_path):
    rng = random.Random(3)
    words = [f"w{chr(97 + i)}{chr(97 + i % 7)}" for i in range(26)]
    docs = [(i, " ".join(rng.choices(words, range(1, 27), k=rng.randrange(1, 40)))) for i in range(300)] + [(300, None), (301, "9")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame([(i, rng.sample(words, 3)) for i in range(12)] + [(12, ["nowhere"]), (13, [])], "query_id int, terms array<string>")
    got = {(r["query_id"], r["doc"]): (r["score"], r["matched"], r["n_query"]) for r in X.scanned_hits(d, q, 5).collect()}
    want = {(r["query_id"], r["doc"]): (r["score"], r["matched"], r["n_query"]) for r in X.top_hits(X.write_index(d, str(tmp_path / "x")), q, 400).collect()}
    assert all(want[k] == v for k, v in got.items())
    for x in range(14):
        rows = sorted(((-s, doc) for (query, doc), (s, _, _) in want.items() if query == x))
        assert all((x, doc) in got for s, doc in rows if s <= (rows[4][0] if len(rows) > 4 else 0))
        assert all((query, doc) in got for (query, doc), (_, m, n) in want.items() if query == x and m == n)
