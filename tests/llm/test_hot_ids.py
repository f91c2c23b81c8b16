"""Token files where many rows share an id or have none, offsets that are too wide, and labelled texts above the bound."""

import numpy as np
import pytest

from lectern.llm import common, huffman
from lectern.llm.tokens import TextEncoder, vocabulary


def test_rows_of_one_id_and_of_none_are_dealt_to_many_parts(spark):
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"some text number {i % 50}") for i in range(1800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    ids = common.written(huffman.tokenized(docs, vocabulary(), 2), "ids")
    plan = huffman.part_plan(ids, 60)
    assert plan.spread[0] >= 10 and plan.spread.max() >= 9 and (np.diff(plan.edges) > 0).all()
    blocks, lengths = huffman.write_ids(docs, rows_per_part=60)
    sizes = {r["part"]: r["n"] for r in blocks.selectExpr("part", "size(doc_ids) as k").groupBy("part").sum("k").withColumnRenamed("sum(k)", "n").collect()}
    assert max(sizes.values()) <= 240 and len(sizes) >= 20
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in huffman.read_ids(blocks, lengths).collect())
    assert len(got) == len(rows) and [s for s, *_ in got] == list(np.cumsum([0] + [n for *_, n in got])[:-1])
    order = [-1 if d is None else d for _, d, _ in got]
    assert order == sorted(order)
    encoder = TextEncoder(vocabulary())
    length = {t: len(encoder.tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in {t for _, t in rows}}
    assert sorted((-1 if d is None else d, n) for _, d, n in got) == sorted((-1 if d is None else d, length[t]) for d, t in rows)


def test_offsets_that_would_wrap_are_refused(monkeypatch):
    ids = np.arange(100, dtype=np.uint32)
    coder = huffman.Coder(huffman.code_lengths(np.ones(100, np.int64)))
    assert len(coder.encode(ids, np.array([100]))) == 1
    monkeypatch.setattr(huffman, "MOST_BITS", 500)
    with pytest.raises(ValueError, match="32 bits"):
        coder.encode(ids, np.array([100]))


def test_a_text_above_the_bound_is_passed_over(spark):
    docs = spark.createDataFrame([(i, "x" * (5000 if i % 2 else 50)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(200)] + [(None, 1)], "doc_id long, quality int")
    got = common.labelled_sample(docs, labels, "quality", 100, most_bytes=1000)
    assert got.groupBy("quality").count().count() == 2 and got.filter("length(text) > 1000").count() == 0
