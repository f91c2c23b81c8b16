"""Operators whose results SQL can't state, against plain loops and worked cases; sources and sinks on files."""

import bisect
import datetime as dt
import io
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import scheduling as S
from lectern.functions import text as T
from lectern.functions import vectors as V
from lectern.operators import access as P
from lectern.operators import books as B
from lectern.operators import compare as C
from lectern.operators import linkage as L
from lectern.operators import ordered as O
from lectern.operators import relational as R
from lectern.operators import retrieval as H
from lectern.sources import files
from lectern.sources.tables import answers
from lectern.streaming import answers as G

SF = "/root/testdata/sf0.001"

AGREE = [
    ("sitagliptin", "sitagliptin dpp 4 inhibitor", "told"), ("e coli", "escherichia coli", "told"), ("hamstrings", "hamstring muscles", "told"), ("m fadyean", "mcfadyen", None),
    ("ct", "connective tissue", "told"), ("dic", "disseminated intravascular coagulation", "told"), ("hypokalemia", "hyperkalemia", "opposed"), ("vitamin b12", "vitamin b1", "opposed"),
    ("increased", "increased renin", "other"), ("", "x", "none"), (None, "x", "none"), ("same", "same", "equal"), ("the renal artery of man", "renal artery man", "words"),
    ("left atrium", "right atrium", "opposed"), ("staphylococus", "staphylococcus", "spelling"), ("acute renal failure", "renal failure", "words"), ("of the", "of a", "other"),
]


def test_answers_agree_by_stages(spark):
    rows = [(i, a, b) for i, (a, b, _) in enumerate(AGREE)]
    got = {r["id"]: (r["stage"], r["agrees"]) for r in C.agreement(spark.createDataFrame(rows, "id int, a string, b string")).collect()}
    turned = {r["id"]: r["agrees"] for r in C.agreement(spark.createDataFrame([(i, b, a) for i, a, b in rows], "id int, a string, b string")).collect()}
    for i, (_, _, stage) in enumerate(AGREE):
        if stage:
            assert got[i] == (stage, stage in ("equal", "words", "spelling", "told")), AGREE[i]
        assert turned[i] == got[i][1]


def test_text_repeats(spark):
    long = "a question about the kidney and what it does when blood pressure falls suddenly"
    rows = [(1, "Same  text", "same text"), (2, long, long + " in an old patient who takes many drugs at home and abroad"), (3, "short", "short text"), (4, long, long.replace("kidney", "kidneys")), (5, None, "x"), (6, "abc", "xyz")]
    got = {r["id"]: r["repeats"] for r in C.text_repeats(spark.createDataFrame(rows, "id int, a string, b string")).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: False, 6: False}


def test_bylines_and_headings(spark):
    names = ["Alan G Shand MD, FRCPE", "Brian J Angus BSc(Hons), DTM&H, MD", "Dirty Medicine", "10.13 The heart", "DO NOT resuscitate", "12", "C. Renal tubular acidosis", "www.books", "J Smith", "Mary Ann Lee, PhD", None]
    got = [tuple(r) for r in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").select("i", T.is_byline(F.col("n")).alias("b"), T.is_heading(F.col("n")).alias("h")).orderBy("i").collect()]
    assert [bool(b) for _, b, _ in got] == [True, True, False, False, False, False, False, False, False, True, False]
    assert [bool(h) for *_, h in got] == [False, False, True, True, True, False, True, False, True, False, False]


def test_passages_are_located(spark):
    page = "".join(random.Random(2).choices("abcdefghijklmnopqrstuvwxyz", k=136))
    rows = [(1, page, page[10:90]), (2, page, "zzzzzzzzzzzz" + page[:60]), (3, page, page[-30:] + "qqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqqq"), (4, page, "short"), (5, page, "!" * 50)]
    got = {r["id"]: r["s"] for r in spark.createDataFrame(rows, "id int, p string, q string").select("id", T.passage_span(F.col("p"), F.col("q"), 20).alias("s")).collect()}
    assert page[got[1]["begin"] : got[1]["end"]] == rows[0][2] and got[4] is None and got[5] is None
    assert got[2]["begin"] == 0


def test_scope_from_outside():
    topics = {"A": ["x", "y"], "B": ["z"]}
    s = P.normal_scope({"sources": ["past", "?"], "subjects": ["A", "B", "C"], "topics": ["A|x", "A|q", "C|x"], "years": ["1999", 2001, "new"]}, topics)
    assert s == {"sources": ["past"], "subjects": ["A", "B"], "topics": [("A", "x")], "years": [1999, 2001]}
    assert P.scope_buckets(s) == [("A", "x"), ("B", None)] and P.normal_scope(None, topics)["sources"] == ["bank", "past"]


def test_nulls_in_predicates(spark):
    rows = [(1, None, None, None), (2, "Paper 1", "A", 5), (3, "Other", "A", None), (4, None, "A", 7)]
    df = spark.createDataFrame(rows, "id int, main_category string, sub_category string, book int")
    assert [r[0] for r in df.filter(P.of_subject("A", [7], ["Paper 1"])).collect()] == [2, 4]
    assert [r[0] for r in df.filter(P.not_in_coalesced("main_category", ["Other"])).collect()] == [1, 2, 4]
    assert df.select(P.sees_restricted(F.lit(None).cast("string"))).first()[0] is False
    due = spark.createDataFrame([(1, None), (2, 5), (3, 9)], "id int, at int")
    assert [r["id"] for r in P.due(due, "at", F.lit(6)).collect()] == [1, 2]


def test_rising_chain_is_longest(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.randrange(40)) for g in range(6) for i in range(60)]
    got = O.rising(spark.createDataFrame(rows, "g int, i int, v int"), "g", "i", "v").collect()
    for g in range(6):
        chain = [r["v"] for r in sorted(got, key=lambda r: r["i"]) if r["g"] == g]
        tails = []
        for v in [v for h, _, v in rows if h == g]:
            tails[bisect.bisect_left(tails, v) : bisect.bisect_left(tails, v) + 1] = [v]
        assert len(chain) == len(tails) and all(a < b for a, b in zip(chain, chain[1:], strict=False))


def test_page_labels(spark):
    def book(numbers):
        return [(1, i, sorted(n)) for i, n in enumerate(numbers)]

    # pages 0..11: blank, blank, 1.., a chapter number, a gap, an inserted plate, the end unnumbered
    numbers = [set(), set(), {1, 652}, {2}, {3, 7}, set(), {5}, {6}, set(), {7}, {8}, set()]
    got = [r["printed"] for r in B.page_labels(spark.createDataFrame(book(numbers), "book int, page int, numbers array<int>")).orderBy("page").collect()]
    assert got == [None, None, 1, 2, 3, 4, 5, 6, None, 7, 8, 9]
    few = spark.createDataFrame(book([{1}, {2}] + [set()] * 20), "book int, page int, numbers array<int>")
    assert B.page_labels(few).count() == 0
    text = spark.createDataFrame([("12 | Renal\nbody 99\nbody\n\nbody\nmore\nlast 13 •",), (None,), ("",)], "t string")
    assert [r[0] for r in text.select(B.edge_numbers(F.col("t"))).collect()] == [[12, 13, 99], None, []]


def test_boxes_join_on_a_line(spark):
    rows = [(1, 0.1, 0.5, 0.2, 0.52), (1, 0.21, 0.501, 0.3, 0.521), (1, 0.5, 0.5, 0.6, 0.52), (1, 0.1, 0.7, 0.2, 0.72), (2, 0.1, 0.5, 0.2, 0.52)]
    got = sorted((r["page"], r["x0"], r["x1"]) for r in O.joined_boxes(spark.createDataFrame(rows, "page int, x0 double, y0 double, x1 double, y1 double")).collect())
    assert got == [(1, 0.1, 0.2), (1, 0.1, 0.3), (1, 0.5, 0.6), (2, 0.1, 0.2)]


def plain_blocks(hits, joins, size, budget, window):
    made, owner = [], {}
    for p in hits:
        if p in owner:
            continue
        chosen, used = [p], size[p]
        if size[p] < budget:
            for away in range(1, window + 1):
                for i in (p + away, p - away):
                    if (p, i) in joins and used + size[i] <= budget:
                        chosen.append(i)
                        used += size[i]
        home = next((owner[i] for i in sorted(chosen) if i in owner), None)
        if home is None:
            home = []
            made.append(home)
            new = chosen
        else:
            new = [i for i in chosen if i not in home]
            if sum(size[i] for i in home) + sum(size[i] for i in new) > 2 * budget:
                continue
        home += new
        owner.update({i: home for i in new})
    return [sorted(m) for m in made]


def test_context_blocks_against_a_plain_loop(spark):
    rng = random.Random(1)
    rows, want = [], {}
    for q in range(40):
        size = {i: rng.randrange(10, 900) for i in range(30)}
        hits = rng.sample(range(4, 26), 5)
        joins = {(p, p + d) for p in hits for d in range(-3, 4) if d and rng.random() < 0.6}
        for rank, p in enumerate(hits, 1):
            rows += [(q, p, rank, p + d, 1, "x" * size[p + d], d, (p, p + d) in joins) for d in range(-3, 4)]
        want[q] = plain_blocks(hits, joins, size, 1500, 3)
    near = spark.createDataFrame(rows, "query_id int, parent long, rank int, id long, book int, text string, away int, joins boolean")
    got = {}
    for r in H.expanded_blocks(near, 1500).orderBy("query_id", "block").collect():
        got.setdefault(r["query_id"], []).append(list(r["ids"]))
    assert got == want


def test_neighbours_stay_on_the_page(spark):
    p = spark.createDataFrame([(1, 1, 1, "a"), (2, 1, 1, "b"), (3, 1, 2, "c"), (4, 2, 1, "d"), (5, 1, None, "e"), (6, 1, None, "f")], "id long, book int, page int, text string")
    hits = spark.createDataFrame([(7, 2, 1), (7, 5, 2)], "query_id int, parent long, rank int")
    assert sorted((r["parent"], r["id"]) for r in H.neighbours(hits, p).collect()) == [(2, 1), (2, 2), (5, 5)]


def test_greedy_keeping_against_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(120, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, i % 3, v[i].tolist(), f"a{i % 4}") for i in range(120)]
    got = {r["id"] for r in L.kept_in_order(spark.createDataFrame(rows, "id long, g int, vector array<double>, answer string"), "g", 0.85, 0.7).collect()}
    want = set()
    for g in range(3):
        kept = []
        for i in range(g, 120, 3):
            if not any(v[k] @ v[i] > 0.85 or (v[k] @ v[i] > 0.7 and k % 4 == i % 4) for k in kept):
                kept.append(i)
        want |= set(kept)
    assert got == want


def test_matches_by_frequency_with_the_defaults(spark):
    rows = [(1, True, 3, 0.80, 0.0), (2, True, 4, 0.84, 0.0), (3, True, 10, 0.85, 0.0), (4, True, 11, 0.88, 0.0), (5, True, 11, 0.89, 0.0), (6, False, 1, 0.95, 0.5), (7, False, 1, 0.91, 0.6), (8, False, 1, 0.90, 1.0)]
    df = spark.createDataFrame(rows, "id int, same_answer boolean, n int, cosine double, overlap double")
    assert {r["id"]: r["kind"] for r in L.matched(df).collect()} == {1: "same", 3: "same", 5: "same", 7: "conflict"}


def test_nearest_against_all_products(spark):
    rng = np.random.default_rng(0)
    v = np.round(rng.normal(size=(700, 4)), 1).astype("float32")  # many ties
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(5)
    got = {(r["query"], r["rank"]): r["id"] for r in V.nearest(e.filter("vec_id % 90 = 0"), e, 7).collect()}
    w = v.astype(np.float64)
    for q in range(0, 700, 90):
        s = np.round(w @ w[q], 12)
        assert [got[q, k + 1] for k in range(7)] == sorted(range(700), key=lambda i: (-s[i], i))[:7]


def test_first_answer_stands(spark):
    now = dt.datetime(2024, 3, 20)
    rows = [(1, "late", now - dt.timedelta(days=1), now), (1, "first", now - dt.timedelta(days=9), now), (2, "only", now, now), (3, "b", now, now), (3, "a", now, now)]
    df = spark.createDataFrame(rows, "k int, a string, answered_at timestamp_ntz, received_at timestamp_ntz")
    for _ in range(2):
        assert {r["k"]: r["a"] for r in G.first_answers(df.repartition(3), ["k"]).collect()} == {1: "first", 2: "only", 3: "a"}


def test_review_stream_is_the_batch_fold(spark, tmp_path):
    ev = answers(spark.read.parquet(f"{SF}/events.parquet")).filter("user_id < 4")
    graded = ev.select("user_id", "event_id", "ts", S.rating(F.col("is_correct"), F.col("confidence")).alias("grade"))
    graded.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(graded.schema).parquet(str(tmp_path / "in"))
    q = G.review_stream(stream, "user_id").writeStream.outputMode("update").format("memory").queryName("reviews").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["user_id"]: (round(r["stability"], 6), round(r["difficulty"], 6), r["reviews"]) for r in spark.table("reviews").collect()}
    want = {r["user_id"]: (round(r["stability"], 6), round(r["difficulty"], 6), r["reviews"]) for r in S.review_state(ev, ["user_id"]).collect()}
    assert got == want and got


def test_sessions_by_gap_and_stalled_jobs(spark):
    t = dt.datetime(2024, 1, 1)
    ev = spark.createDataFrame([(1, t), (1, t + dt.timedelta(minutes=20)), (1, t + dt.timedelta(hours=2)), (2, t)], "user_id int, ts timestamp_ntz")
    assert sorted((r["user_id"], r["n"]) for r in G.gap_sessions(ev).collect()) == [(1, 1), (1, 2), (2, 1)]
    log = spark.createDataFrame([("a", t), ("b", t + dt.timedelta(minutes=55))], "job string, at timestamp_ntz")
    assert {r["job"]: r["stalled"] for r in G.stalled(log, F.lit(t + dt.timedelta(hours=1))).collect()} == {"a": True, "b": False}


def test_delete_with_dependents_and_merge(spark):
    users = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    notes = spark.createDataFrame([(10, 1), (11, 2)], "id int, user_id int")
    marks = spark.createDataFrame([(5, 10), (6, 11)], "id int, note_id int")
    left = R.without_dependents({"users": users, "notes": notes, "marks": marks}, [("notes", "user_id", "users", "id"), ("marks", "note_id", "notes", "id")], spark.createDataFrame([(1,)], "id int"), "users")
    assert [[r[0] for r in left[t].collect()] for t in ("users", "notes", "marks")] == [[2], [11], [6]]
    mapping = spark.createDataFrame([(10, 110)], "old int, new int")
    out = R.merged_database(marks, spark.createDataFrame([(7, 10), (8, 99), (5, 1)], "id int, note_id int"), ["id"], {"note_id": mapping})
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(5, 10), (6, 11), (7, 110), (8, None)], key=str)


def test_options_are_normalised_and_dealt(spark):
    rows = [(1, {" a ": "x", "b": " y", "C": "z", "d": "w", "e": " "}, "b) y"), (2, {"a": "x"}, "a"), (3, {"a": "1", "b": "2", "c": "3", "d": "4"}, "e"), (4, None, None)]
    o, k = R.normal_options(F.col("o"), F.col("c"))
    got = {r["id"]: (r["o"], r["k"]) for r in spark.createDataFrame(rows, "id int, o map<string,string>, c string").select("id", o.alias("o"), k.alias("k")).collect()}
    assert got == {1: ({"A": "x", "B": "y", "C": "z", "D": "w"}, "B"), 2: (None, None), 3: (None, None), 4: (None, None)}
    opts = spark.createDataFrame([(1, "s", ["p", "q", "r"], 2, None), (2, "s", ["p", "q", "both p and q"], 1, None), (3, "s", ["p", "q", "r"], 0, "Option A is right")], "id int, s string, o array<string>, c int, e string")
    o, k = R.dealt_options(F.col("s"), F.col("o"), F.col("c"), F.col("e"))
    got = {r["id"]: (r["o"], r["k"]) for r in opts.select("id", o.alias("o"), k.alias("k")).collect()}
    assert sorted(got[1][0]) == ["p", "q", "r"] and got[1][0][got[1][1]] == "r" and got[2] == (["p", "q", "both p and q"], 1) and got[3][1] == 0


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 one|two|three")
    (tmp_path / "b.pdf").write_bytes(b"no pdf")
    pdf = files.pdf_files(spark, str(tmp_path))
    assert {r["path"][-5:]: r["valid"] for r in pdf.collect()} == {"a.pdf": True, "b.pdf": False}
    pages = files.parsed_pages(pdf.filter("valid"), lambda c: c.decode().split("|"), 2, 3)
    assert [(r["page"], r["text"]) for r in pages.orderBy("page").collect()] == [(2, "two"), (3, "three")]
    marks = files.outlined(pdf.filter("valid"), lambda c: [(0, 0, "Part_I"), (-1, 1, "lost"), (2, 1, "\x00 ")])
    assert [tuple(r)[1:] for r in marks.collect()] == [(0, 0, "Part I")]
    known = spark.createDataFrame([("b.pdf", 7), ("gone.pdf", 1)], "name string, pages int")
    assert sorted(map(tuple, files.page_counts(pdf, known, lambda c: c.count(b"|") + 1).collect())) == [("a.pdf", 3), ("b.pdf", 7)]

    held = io.BytesIO()
    np.savez(held, refs=np.array(["r1", "r2"]), vecs=np.array([[1, 2], [3, 4]], "float32"))
    (tmp_path / "v.npz").write_bytes(held.getvalue())
    assert [tuple(r) for r in files.vector_files(spark, str(tmp_path)).orderBy("ref").collect()] == [("r1", [1.0, 2.0]), ("r2", [3.0, 4.0])]

    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "x"}\nbroken\n{"a": 2}\n')
    assert [tuple(r) for r in files.json_lines(spark, str(tmp_path / "x.jsonl"), "a int, b string").collect()] == [(1, "x"), (None, None), (2, None)]
    assert [r["text"] for r in files.whole_texts(spark, str(tmp_path / "x.jsonl")).collect()] == ['{"a": 1, "b": "x"}\nbroken\n{"a": 2}\n']

    log = spark.createDataFrame([("l", 1, "start A"), ("l", 2, "page 3"), ("l", 3, "start B"), ("l", 4, "page 9"), ("m", 1, "page 1")], "path string, n int, value string")
    assert sorted((r["path"], r["name"], r["found"]) for r in files.log_events(log, "n", r"start (\w+)", r"page (\d+)").collect() if r["name"]) == [("l", "A", "3"), ("l", "B", "9")]

    bank = spark.createDataFrame([(1, "a\nb", {"A": "x", "B": "y\r\nz"}, "A")], "id int, stem string, options map<string,string>, answer string")
    assert tuple(files.question_csv(bank).first())[:4] == (1, "a b", "x", "y z")
    cards = spark.createDataFrame([("a<b", "c&d", None, "my tag")], "front string, back string, note string, tag string")
    assert files.card_lines(cards).first()[0] == "a&lt;b\tc&amp;d<br><br>\tmy_tag"
    cited = spark.createDataFrame([("see Guyton, and Guyton 15 and Guyton",)], "t string")
    assert files.renamed_citations(cited, "t", "Guyton", "Hall").first()[0] == "see Hall, and Guyton 15 and Hall"

    table = spark.range(25).toDF("id")
    files.appended(table, str(tmp_path / "t"), 10)
    files.appended(table, str(tmp_path / "t"), 10)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 50
    files.snapshot({"t": table}, str(tmp_path / "dump"))
    assert files.restored(spark, str(tmp_path / "dump"), ["t"])["t"].count() == 25
    with pytest.raises(Exception):
        files.snapshot({"t": table}, str(tmp_path / "dump"))


def test_text_helpers(spark):
    t = spark.createDataFrame([("Ａﬁ x-1",), (None,)], "t string")
    assert [r[0] for r in t.select(T.matchable(F.col("t"))).collect()] == ["afix1", None]
    assert spark.createDataFrame([("a &lt;b&gt; &eacute;",)], "t string").select(T.unescaped(F.col("t"))).first()[0] == "a <b> é"
    assert spark.createDataFrame([("A [Book, Page 3] and (Other, p. 4).",)], "t string").select(T.without_citations(F.col("t"))).first()[0] == "A and."
    assert [tuple(x) for x in spark.createDataFrame([("x [Book A, Page 3] [bb, p.7]",)], "t string").select(T.cited(F.col("t"))).first()[0]] == [("book a", 3), ("bb", 7)]
    page = "<p>a <b>bold</b></p><script>x</script><ul><li>one</li></ul>&lt;tag&gt;"
    assert spark.createDataFrame([(page,)], "t string").select(T.html_markdown(F.col("t"))).first()[0] == "a **bold**\n- one\n\n&lt;tag&gt;"


def test_entities_need_a_semicolon(spark):
    rows = [("a &ampb &amp;lt; &am &amp", "a &ampb &lt; &am &amp"), ("&ampx; &copy &#39;&#x41; &eacute;", "&ampx; &copy 'A é"), (None, None)]
    got = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string").select("i", T.unescaped(F.col("t"))).collect()
    assert dict(map(tuple, got)) == {i: r[1] for i, r in enumerate(rows)}


def test_is_table_on_a_line_of_many_bars(spark):
    rows = [("| x " * 20000, False), ("| x " * 20000 + "|\n|-|", True), ("a\n|b|\r c\n| : |", True), ("|\n|--|", False), ("|a|\n||", False), ("|a|\n|||", True), ("|a|\n\n|-|", False)]
    t = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, t string").select("i", T.is_table(F.col("t"), F.lit(None).cast("string")))
    assert dict(map(tuple, t.collect())) == {i: r[1] for i, r in enumerate(rows)}


def test_pairs_of_clusters_against_all_products(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(9, 16))
    v = centre[rng.integers(0, 9, 400)] + 0.25 * rng.normal(size=(400, 16))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype("float32")
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    s = v.astype(np.float64) @ v.astype(np.float64).T
    for least, rows in ((0.9, 30), (0.95, 2048), (0.2, 50)):
        got = {(r["a"], r["b"]) for r in V.similar_pairs(e, least, block_rows=rows).collect()}
        assert got == {(i, j) for i in range(400) for j in range(i + 1, 400) if s[i, j] >= least} and got
    assert V.similar_pairs(e.limit(0), 0.9).count() == 0


def test_models_are_given_by_the_caller(spark):
    from lectern.functions import models as M

    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "abc")], "id int, text string")
    make = lambda: lambda texts: np.array([[len(t), 1.0] for t in texts])
    assert {r["id"]: r["embedding"] for r in M.encoded(df, make, prefix="__").collect()} == {1: [4.0, 1.0], 2: None, 3: [5.0, 1.0]}
    score = lambda: lambda q, p: [len(set(a) & set(b)) for a, b in zip(q, p, strict=True)]
    pairs = spark.createDataFrame([(1, "abc", 7, "a"), (1, "xyz", 7, "xyz"), (1, "abc", 8, "ab"), (1, "xyz", 8, None)], "query_id int, query string, parent int, text string")
    assert sorted((r["parent"], r["score"], r["rank"]) for r in M.reranked_best(pairs, score).collect()) == [(7, 3.0, 1), (8, 2.0, 2)]


def test_functions_in_sql(spark):
    from lectern.functions import sql

    sql.register(spark)
    text = "one two. three four five. six."
    assert [r["text"] for r in spark.sql(f"select * from child_passages('{text}', 4) order by child").collect()] == ["one two.", "three four five. six."]
    assert spark.sql("select word from near_words('kidny', 'liver kidney', 1)").first()[0] == "kidney"
    assert spark.sql("select spelling_ratio('abcd', 'abcd') as r").first()[0] == 1.0


def test_parts_grow_with_the_rows(spark):
    rows = spark.range(1000).withColumn("k", F.col("id") % 100)
    assert R.dealt(rows, "k", part_rows=50).rdd.getNumPartitions() == 20
    assert R.dealt(rows, "k", count=10).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    w = R.dealt(rows, "k", part_rows=50).withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("id")))
    assert w.rdd.getNumPartitions() == 20 and w.filter("n = 10").count() == 100


def test_blocks_need_no_texts_and_no_group_a_query(spark):
    passages = spark.createDataFrame([(i, "b", 1, "x" * (20 * i)) for i in range(1, 9)], "id long, book string, page int, text string")
    hits = spark.createDataFrame([(q, 1, 2 + q % 5) for q in range(300)], "query_id long, rank int, parent long")
    near = H.neighbours(hits, passages, 1).withColumn("joins", F.col("away") == 1)
    blocks = H.expanded_blocks(near.drop("text"), 150)
    assert "InPandas" not in blocks._jdf.queryExecution().toString()
    assert {(r["query_id"], r["block"], tuple(r["ids"])) for r in blocks.collect()} == {(q, 1, (p, p + 1) if p < 4 else (p,)) for q in range(300) for p in [2 + q % 5]}


def test_figures_of_other_pages_are_left_out(spark):
    pages = spark.createDataFrame([(1, 1, 1, "see Fig. 1-1"), (1, None, 2, "x"), (2, 1, 2, "x")], "query_id int, book int, page int, text string")
    f = [(1, 1, 1), (1, 1, 2), (1, None, 2), (2, 1, 2), (2, 1, 1), (3, 1, 1)]
    figures = spark.createDataFrame([(q, b, p, i, f"Figure {b}.{p}", "printed", False, 0.7) for i, (q, b, p) in enumerate(f)], "query_id int, book long, page long, id int, label string, caption_source string, decorative boolean, sim double")
    chosen = H.chosen_figures(figures, pages)
    assert {(r["query_id"], r["id"], r["mentioned"]) for r in chosen.collect()} == {(1, 0, True), (2, 3, False)}
    assert "LeftSemi" not in chosen._jdf.queryExecution().toString()


def test_pairs_by_stripes_against_all_products(spark):
    rng = np.random.default_rng(5)
    v = np.vstack([rng.normal(size=(300, 8)), np.repeat(rng.normal(size=(1, 8)), 120, 0) + 0.01 * rng.normal(size=(120, 8))])
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(3)
    s = v.astype(np.float64) @ v.astype(np.float64).T
    for least, rows in ((0.5, 60), (0.95, 40), (0.95, 1000)):
        want = {(i, j) for i, j in zip(*np.nonzero(s >= least)) if i < j}
        got = [(r["a"], r["b"]) for r in V.similar_pairs(e, least, block_rows=20, stripe_rows=rows).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert V.similar_pairs(e.limit(0), 0.5).count() == 0
