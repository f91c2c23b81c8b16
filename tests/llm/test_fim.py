"""Fill-in-middle against plain slicing of unit lists, and its form and restoring on odd texts."""

import hashlib
import re

import pytest

from lectern.llm import fim
from lectern.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ODD = ["", None, "\n", "\n\n\n", "one", "one\n", "a\nb", "été\nnaïve 🙂\r\n漢字\n", "has <P> in it\n", "<S>", "x<M>", "ends in <\nP>\n<\n", "<", "S>\n<S", "line\n" * 20_000, "x" * 300_000]


def plain(text, doc_id, unit=fim.LINES, rate=100, spm=50):
    text = text or ""
    units = re.findall(unit, text)
    h = hashlib.sha256(("7:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    a, b, c, d = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if text == "" or re.search("<[PSM]>", text) or c % 100 >= rate:
        return len(units), "plain", None, None, text
    lo, hi = sorted((a % (len(units) + 1), b % (len(units) + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if d % 100 < spm:
        return len(units), "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return len(units), "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


@pytest.mark.parametrize("unit, rate, spm", [(fim.LINES, 100, 50), (r"(?s).", 100, 0), (r"\s*\S+\s*$|\s*\S+|\s+", 40, 100)])
def test_each_form_against_plain_slicing(spark, unit, rate, spm):
    rows = [(None if i % 11 == 5 else i // 2, ODD[i % len(ODD)], "clash") for i in range(4 * len(ODD))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string")
    want = sorted(map(repr, ((d, *plain(t, d, unit, rate, spm)) for d, t, _ in rows)))
    out = fim.fill_in_middle(docs, unit, rate, spm)
    assert sorted(map(repr, map(tuple, out.collect()))) == want
    texts = sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, _ in rows)
    assert sorted(r["restored_sha256"] for r in fim.digests(out).collect()) == texts
    assert fim.digests(fim.fill_in_middle(docs.limit(0))).count() == 0


def test_no_list_of_units_is_kept():
    import tracemalloc

    text = "a\n" * 500_000
    tracemalloc.start()
    got = fim.transformed(text, 3, re.compile(fim.LINES))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.n == 500_000 and peak < 4 * len(text)


def test_query_restores_every_text(spark):
    rows = {r["doc_id"]: r for r in QUERIES["op11_fill_in_middle"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        n, form, p, m, output = plain(d["text"], d["doc_id"])
        r = rows[d["doc_id"]]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"]) == (n, form, p, m)
        assert r["output_sha256"] == hashlib.sha256(output.encode()).hexdigest() and r["restored_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()
