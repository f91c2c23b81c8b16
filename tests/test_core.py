"""The named queries against DuckDB at the smallest size, and units where SQL has no equivalent."""

import datetime as dt
import decimal
import random

import duckdb
import pytest

from lectern.functions import text as T
from lectern.functions import vectors as V
from lectern.operators import books as B
from lectern.operators import linkage as L
from lectern.operators import ordered as O
from lectern.operators import relational as R
from lectern.plans import ORACLE_SQL, QUERIES
from lectern.sources import files
from lectern.streaming import answers as G

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF)
    assert sorted(want.columns) == sorted(got.columns)
    names = sorted(got.columns)
    a = sorted(tuple(plain(r[c]) for c in names) for r in got.collect())
    b = sorted(tuple(plain(x) for x in r) for r in want.project(", ".join(f'"{c}"' for c in names)).fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_complete_linkage_does_not_chain(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8)], "a long, b long, weight double")
    assert {tuple(r) for r in L.complete_linkage(edges).collect()} == {(1, 1), (2, 1), (3, 3)}


def brute_linkage(rows, least, most=8):
    links = sorted((-round(sum(x * y for x, y in zip(u, v, strict=True)), 9), a, b) for a, _, u in rows for b, _, v in rows if a < b and sum(x * y for x, y in zip(u, v, strict=True)) >= least)
    joined, team = {(a, b) for _, a, b in links}, {m: {m} for _, *ends in links for m in ends}
    for _, a, b in links:
        x, y = team[a], team[b]
        if x is not y and len(x) + len(y) <= most and all((min(p, q), max(p, q)) in joined for p in x for q in y):
            for m in (both := x | y):
                team[m] = both
    return {(m, min(t)) for m, t in team.items()}


def test_complete_linkage_crosses_labels(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for i in range(120):  # six directions, three labels: links within and across labels
        v = [rng.gauss(0, 0.45) + (3 if k == i % 6 else 0) * 0.4 for k in range(12)]
        size = sum(x * x for x in v) ** 0.5
        rows.append((i, i % 3 if i % 2 else 7, [x / size for x in v]))
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {tuple(r) for r in QUERIES["complete_linkage"](spark, str(tmp_path)).collect()}
    label = {i: k for i, k, _ in rows}
    assert got == brute_linkage(rows, 0.3) and any(label[m] != label[g] for m, g in got)


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20] + [(50, 50), (61, 60)], "a long, b long")
    roots = {r["node"]: r["root"] for r in R.components(edges).collect()}
    assert len({roots[i] for i in range(21)}) == 1 and len({roots[i] for i in range(21, 41)}) == 1 and len(set(roots.values())) == 3


def test_hybrid_search_finds_quotes_beyond_the_keyword_list(spark, tmp_path):
    quote = "renal tubular acidosis lowers serum bicarbonate while chloride rises"
    mixed = " ".join(reversed(quote.split()))
    rows = [(0, "filler " * 3000 + quote, "s0")] + [(i, mixed, f"s{i % 3 + 1}") for i in range(1, 41)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, quote)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert 0 not in {r["doc_id"] for r in QUERIES["keyword_strict_or"](spark, str(tmp_path)).collect()}
    assert "s0" in {r["book"] for r in QUERIES["hybrid_search"](spark, str(tmp_path)).collect()}


def test_short_quotes_are_found(spark, tmp_path, monkeypatch):
    texts = ["an alpha  RESPIRATORYLY end", "x respiratoryalpha respiratory", "prerespiratorypost", "alpha beta respiratory", "the long alpha respiratory quote", None, ""]
    quotes = ["alpha respiratory", "respiratory", "Respiratoryly", "long alpha respiratory", "respiratoryp", "short"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(quotes)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.sql(ORACLE_SQL["quote_verified"]).fetchall())
    assert len(want) == 6 and sorted(map(tuple, QUERIES["quote_verified"](spark, str(tmp_path)).collect())) == want
    monkeypatch.setattr("lectern.plans.queries.QUOTE_BLOCK", 100)
    assert sorted(map(tuple, QUERIES["quote_verified"](spark, str(tmp_path)).collect())) == want


def test_similar_pairs_do_not_depend_on_blocks(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    one, many = (V.similar_pairs(e, 0.4, block_rows=n).select("a", "b").collect() for n in (10_000, 60))
    assert sorted(one) == sorted(many) and one


def test_children_keep_sentences_whole(spark):
    df = spark.createDataFrame([("one two. three four five. six.",), ("",), (None,)], "text string")
    assert [r[0] for r in df.select(T.children(T.F.col("text"), 4)).collect()] == [["one two.", "three four five. six."], [], None]


def test_upsert_and_route(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, R.upserted(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, files.imported(old, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]


def test_intervals_merge_when_they_touch(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 10)], "k int, lo int, hi int")
    assert sorted(map(tuple, O.merged_intervals(df, "k").collect())) == [(1, 0, 7), (1, 9, 10)]


def test_late_answers_count_at_receipt(spark):
    now = dt.datetime(2024, 3, 1)
    rows = [(i, now - dt.timedelta(days=d), now) for i, d in enumerate((29, 31, -1))]
    df = spark.createDataFrame(rows, "k int, answered_at timestamp_ntz, received_at timestamp_ntz")
    got = {r["k"]: r["at"] for r in G.first_answers(df, ["k"]).select("k", T.F.col("at").cast("timestamp_ntz").alias("at")).collect()}
    assert got == {0: now - dt.timedelta(days=29), 1: now, 2: now}


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = G.weekly_counts(stream).writeStream.outputMode("complete").format("memory").queryName("weeks").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("weeks").collect())) == sorted(map(tuple, G.weekly_counts(events).collect()))


def test_ligatures_come_back_in_their_case(spark):
    known = spark.createDataFrame([("difficult", 9), ("fluid", 5), ("affect", 4), ("afflect", 3)], "word string, n long")
    texts = spark.createDataFrame([(1, "A Difcult fuid: afect, DIFCULT."), (2, None), (3, "")], "id int, text string")
    mapping = B.ligature_map(B.word_counts(texts), known)
    assert {tuple(r) for r in mapping.collect()} == {("difcult", "difficult"), ("fuid", "fluid")}  # afect: two repairs, neither three times the other
    assert {r["id"]: r["text"] for r in B.repaired_texts(texts, mapping, "id").collect()} == {1: "A Difficult fluid: afect, DIFFICULT.", 2: None, 3: ""}


def test_figures_match_by_label_caption_or_alone(spark):
    s = "book int, id int, page int, label string, caption string"
    old = spark.createDataFrame([(1, 1, 5, "1.1", None), (1, 2, 9, "1.2", "the cell wall"), (1, 3, 20, "1.3", ""), (1, 4, None, "1.1", "x"), (1, 5, 30, "1.4", "far off")], s)
    new = spark.createDataFrame([(1, 11, 6, "1.1", "z"), (1, 12, 6, "1.1", "z"), (1, 13, 8, "2", "cell wall"), (1, 14, 21, "3", "q"), (1, 15, 32, "1.4", "far off"), (1, 16, None, "1.1", "x")], s)
    assert {tuple(r) for r in B.matched_figures(old, new).collect()} == {(1, 1, 11), (1, 2, 13), (1, 3, 14)}


def test_chapters_follow_open_bookmarks(spark):
    marks = spark.createDataFrame([(1, 2, 1, "Part I"), (1, 3, 2, "Ch 1"), (1, 4, 3, "deep"), (1, 6, 1, "Part II"), (1, 8, 2, "Index"), (2, 1, 1, "only")], "book int, page int, depth int, title string")
    pages = spark.createDataFrame([(1, p) for p in range(1, 9)] + [(2, 1)], "book int, page int")
    got = {(r["book"], r["page"]): r["chapter"] for r in B.outline_chapters(pages, marks, "(?i)^index$").collect()}
    assert got == {(1, 1): None, (1, 2): "Part I", (1, 3): "Part I > Ch 1", (1, 4): "Part I > Ch 1", (1, 5): "Part I > Ch 1", (1, 6): "Part II", (1, 7): "Part II", (1, 8): None, (2, 1): None}
