"""License scans against a plain search by rule, for base phrases and for suppression, however the rows are dealt."""

import re

import pytest

from lectern.llm import licenses
from lectern.llm.license_rules import RULES

TEXTS = [
    " Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the 'Software'). MIT License MIT License mit license",
    "SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0",
    "SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note. gplv3 or LGPLv2.1",
    "CC BY-NC-SA 4.0 cc by cc by nc " * 600,
    "gnu general public license gnu general public license. GNU Affero General Public License version 3, 19 November 2007",
    "Licensed under the Apache License, Version 2.0; see http://www.apache.org/licenses/LICENSE-2.0 or all rights reserved",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "the MITigation of licenseless mit-like work, an été license",
    "mit license",
    "",
    None,
    "\x01 \x02 $0 \\ mit\x01license",
]


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(licenses.WORD, low)
    norm = " " + " ".join(words) + " "
    base = [(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    found = []
    for rule, label, keyword, priority, expression, sure in licenses.rules():
        if f" {keyword}" in norm:
            found += [(norm[: m.start()].count(" ") - 1, norm[: m.end()].count(" "), priority, rule, label, sure) for m in re.finditer(f"(?<= )(?:{expression})(?= )", norm)]

    def hides(y, x):
        if not (y[0] <= x[0] and x[1] <= y[1]) or y is x:
            return False
        return y[2] > x[2] or (y[2] == x[2] and (y[1] - y[0] > x[1] - x[0] or (y[1] - y[0] == x[1] - x[0] and y[3] < x[3])))

    near = {}
    for y in found:
        near.setdefault(y[0] // 40, []).append(y)  # no match is longer than 40 words
    kept = [x for x in found if not any(hides(y, x) for k in (x[0] // 40 - 1, x[0] // 40) for y in near.get(k, []))]
    labels = {label for _, label in base} | {x[4] for x in kept}
    at = [i for i, _ in base]
    return (
        (len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in base})), ",".join(sorted(labels)), max((x[5] for x in kept), default=0.0)),
        sorted((x[0], x[1], x[2], x[3]) for x in kept),
    )


@pytest.fixture(scope="module")
def docs(spark):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(100_000 + i, t) for i, t in enumerate(TEXTS)] + [(100_000, TEXTS[0])]
    # every rule once, as it is written
    rows += [(200_000 + i, re.sub(r"\(\?[:!][^()]*\)\??\*?|[?*]", "", r[3])) for i, r in enumerate(RULES) if not re.search(r"[\[{.]", r[3])]
    return given.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))


def test_scan_against_plain_search(docs):
    want = {r["doc_id"]: plain(r["text"]) for r in docs.collect()}
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.scan(docs).collect()}
    assert got == {d: w[0] for d, w in want.items()} and sum(w[0][5] != "" for w in want.values()) > 100
    places = {}
    for r in licenses.detections(docs.filter("doc_id <> 100000")).collect():
        places.setdefault(r["doc_id"], []).append((r["first"], r["end"], r["priority"], r["rule"]))
    assert {d: sorted(p) for d, p in places.items()} == {d: w[1] for d, w in want.items() if w[1] and d != 100_000}


def test_scan_does_not_depend_on_how_rows_are_dealt(spark, docs):
    want = sorted(map(str, licenses.scan(docs).collect()))
    assert sorted(map(str, licenses.scan(docs.repartition(7)).collect())) == want
    joined = docs.join(docs.select("doc_id").distinct(), "doc_id")
    assert sorted(map(str, licenses.scan(joined).collect())) == want
    extra = docs.withColumn("norm", docs.doc_id).withColumn("labels", docs.text).withColumn("kept", docs.doc_id)
    assert sorted(map(str, licenses.scan(extra).collect())) == want
    assert licenses.scan(docs.limit(0)).count() == 0


def test_rules_hold_their_keywords():
    assert len(RULES) > 200 and len({r[3] for r in RULES}) > 200
    for label, _, keyword, expression, sure in RULES:
        assert keyword in expression and label and 0 < sure <= 1
    for gate, keywords in licenses.gates().items():
        assert all(gate in k.split() or k.strip() in licenses.LONGER for k in keywords)
