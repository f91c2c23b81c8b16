"""MinHash near-duplicates against all pairs, on families of near copies, shared passages and odd rows."""

import numpy as np
import pytest

from lectern.llm import minhash

SCHEMA = "doc_id long, text string, node string, class string"


def brute(rows, n_words, percent):
    sets = []
    for _, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
        sets.append({tuple(w[i : i + n_words]) for i in range(len(w) - n_words + 1)} if len(w) >= n_words else {tuple(w)} if w else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    least = {}
    for r, (d, _) in zip(root, rows, strict=True):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    out = []
    for k, ((d, _), r) in enumerate(zip(rows, root, strict=True)):
        c = least.get(r, d) if sets[k] else d
        out.append((d, len(sets[k]), c, d == c))
    return sorted(map(repr, out))


def texts(seed):
    rng = np.random.default_rng(seed)
    passage = [f"p{i}" for i in range(60)]
    out = ["", None, " \n", "one", "One", "two words", "Two  Words", "a b c d", "A b c D", "été naïve été naïve été"]
    for family in range(12):
        base = [f"w{x}" for x in rng.integers(0, 4000, int(rng.integers(20, 160)))] + (passage if family % 3 == 0 else [])
        for _ in range(int(rng.integers(1, 14))):
            text = list(base)
            for _ in range(int(rng.integers(0, 7))):
                text[int(rng.integers(0, len(text)))] = f"v{rng.integers(0, 50)}"
            out.append(" ".join(text))
    chain = [f"c{i}" for i in range(300)]  # each links to the next alone
    out += [" ".join(chain[k * 7 : k * 7 + 100]) for k in range(20)]
    return out + out[20:28]


@pytest.mark.parametrize("n_words, percent", [(3, 85), (5, 80), (1, 60)])
def test_components_are_those_of_all_pairs(spark, n_words, percent):
    rows = [(None if i % 23 == 4 else 1000 - i // 2 if i % 9 == 0 else 2000 + i, t) for i, t in enumerate(texts(n_words))]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    got = sorted(map(repr, (tuple(r) for r in minhash.near_duplicates(docs, n_words, percent).collect())))
    assert got == brute(rows, n_words, percent)
    assert minhash.near_duplicates(docs.limit(0), n_words, percent).count() == 0


def test_half_keys_agree_as_often_as_sets_do():
    rng = np.random.default_rng(5)
    hits = np.zeros(2 * minhash.HALVES)
    for _ in range(300):
        grams = rng.integers(0, 1 << 63, 120, dtype=np.uint64)
        a, b = np.sort(grams[:110]), np.sort(grams[10:])  # 100 of 120 in common
        doc = np.repeat([0, 1], 110)
        keys = minhash.half_keys(doc, np.concatenate([a, b]), 2)
        hits += keys[0] == keys[1]
    assert abs(hits.mean() / 300 - (100 / 120) ** minhash.HALF) < 0.04 and hits.min() / 300 > 0.55
    assert len({int(k) for k in keys[0]}) == 2 * minhash.HALVES


def test_tables_hold_nearly_all_pairs_at_the_threshold():
    rng, missed, n = np.random.default_rng(6), 0, 3000
    for _ in range(n):
        grams = rng.integers(0, 1 << 63, 107, dtype=np.uint64)
        a, b = np.sort(grams[:99]), np.sort(grams[8:])  # 91 of 107: 0.85
        keys = minhash.half_keys(np.repeat([0, 1], 99), np.concatenate([a, b]), 2)
        same = keys[0] == keys[1]
        missed += not (same[: minhash.HALVES].any() and same[minhash.HALVES :].any())
    assert missed <= 3


def test_a_third_of_all_rows_in_one_family(spark):
    rng = np.random.default_rng(7)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(900):
        if i % 3 == 0:
            text = list(base)
            text[int(rng.integers(0, 120))] = f"x{i}"
            rows.append((i, " ".join(text)))
        else:
            rows.append((i, " ".join(f"w{x}" for x in rng.integers(0, 10**6, 60))))
    docs = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, 3, 85).collect()}
    assert all(got[i] == (0 if i % 3 == 0 else i) for i, _ in rows)
