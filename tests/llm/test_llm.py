"""Each operator on hand-made rows (nulls, empty and long texts, ties, repeats, extra columns, no rows) and against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from lectern.llm import flac, fmindex, huffman, jaccard, licenses, mixing, quality, separators, sharding, toxicity
from lectern.llm.queries import QUERIES
from lectern.llm.tokens import TextEncoder, vocabulary

SF = "/root/testdata/sf0.001"
BODY = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
ROWS = [
    (1, BODY + ".\nLicensed under the Apache License, Version 2.0.", "en", "s1", "x"),
    (2, BODY + ".\nLicensed under the Apache License, Version 2.0.", "en", "s1", "x"),
    (2, BODY + ".\nLicensed under the Apache License, Version 2.0.", "en", "s1", "x"),
    (3, "", "en", None, None),
    (4, None, None, "s2", "y"),
    (5, "été  naïve\tword " * 3000, "fr", "s2", "y"),
    (None, "CC BY cc by 4.0", "en", "s1", None),
    (6, "one two", "de", "", "z"),
]
SCHEMA = "doc_id long, text string, lang string, source string, size string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_flac_round_trip_and_damage(docs, none):
    got = {r["doc_id"]: r for r in flac.read_media(flac.encode_texts(docs)).collect()}
    for doc_id, text, *_ in ROWS:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert bytes(got[doc_id]["pcm"]) == payload and got[doc_id]["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert got[doc_id]["tail_crc32"] == zlib.crc32(payload[-64:])
    blocks = flac.pcm_blocks(flac.encode_texts(docs.filter("doc_id = 5"))).orderBy("block").collect()
    assert b"".join(bytes(b["pcm"]) for b in blocks) == bytes(got[5]["pcm"]) and blocks[1]["first_sample"] == flac.BLOCK
    stream = bytearray(flac.encode([bytes(range(256)) * 40])[0])
    stream[-40] ^= 1
    with pytest.raises(flac.Corrupt):
        flac.decode([bytes(stream)])
    assert flac.read_media(flac.encode_texts(none)).count() == 0


def test_shards_are_gapless_and_even(docs, none):
    rows = sharding.assign(sharding.digests(docs), 3).collect()
    assert len(rows) == len(ROWS)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert sharding.assign(sharding.digests(none), 3).count() == 0
    sizes = np.random.default_rng(1).integers(10, 4000, (3000, 3)).astype(float)
    load = np.bincount(sharding.pack(sizes, 24), sizes[:, 0], 24)
    assert load.max() / load.min() < 1.01


def test_shards_stay_even_with_one_text_in_a_third_of_all_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "copy " * 100 if i % 3 == 0 else f"t{i} " + "word " * int(rng.integers(50, 150)), None, None, None) for i in range(9000)]
    placed = sharding.assign(sharding.digests(spark.createDataFrame(rows, SCHEMA)), 8, groups_per_block=40).groupBy("shard").sum("size").collect()
    load = [r[1] for r in placed]
    assert len(load) == 8 and max(load) / min(load) < 1.02


@pytest.mark.parametrize("groups_per_block", [20, 8192])
def test_equal_texts_share_a_shard_that_holds_them(spark, groups_per_block):
    texts = ["half a shard " * 20] * 30 + ["more than a shard " * 30] * 200 + [f"pair {i // 2} " + "word " * 40 for i in range(600)] + [None] * 9
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    placed = sharding.assign(sharding.digests(spark.createDataFrame(rows, SCHEMA)), 8, groups_per_block).collect()
    share, shards = sum(r["size"] for r in placed) / 8, {}
    for r in placed:
        shards.setdefault(texts[r["doc_id"]], []).append(r["shard"])
    assert len(placed) == len(rows) and len(set(shards[texts[30]])) > 1
    assert all(len(set(s)) == 1 for t, s in shards.items() if len(s) * (len(t or "") + 8) <= share)
    load = Counter()
    for r in placed:
        load[r["shard"]] += r["size"]
    assert max(load.values()) / min(load.values()) < 1.05


def test_mix_meets_targets(docs, none):
    out = mixing.mix(docs.drop("size").withColumn("size", mixing.word_count())).collect()
    by, target = Counter(), {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]] += r["taken"]
        target[r["source"]] = (r["target"], r["source_size"])
    for s, (t, n) in target.items():
        assert abs(by[s] - t) <= max(2, 0.02 * n)
    assert mixing.mixed_texts(none).count() == 0
    assert np.allclose(mixing.targets(np.array([100, 10, 10]), np.array([1.0, 1.0, 1.0])), [140, 20, 20])
    quotas = np.array([7, 100, 0, 33])
    tree = mixing.split_tree(quotas, 5, 3)
    assert (tree.sum(1) == quotas).all() and tree.sum(0).max() - tree.sum(0).min() <= 1


def test_permutation():
    for n in (1, 2, 5, 1000):
        assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 9, np.uint64))) == list(range(n))


def test_mixed_texts_keep_columns(docs):
    out = mixing.mixed_texts(docs)
    assert out.columns == docs.columns
    assert {r["text"] for r in out.filter("doc_id = 6").collect()} <= {"one two", "one", "two"}


def test_licenses(docs, none):
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert (got[1]["labels"], got[1]["n_base"], got[1]["first_word"], got[1]["score"]) == ("apache", 1, 23, 1.0)
    assert (got[None]["n_base"], got[None]["first_word"], got[None]["last_word"], got[None]["n_words"]) == (2, 0, 2, 6)
    assert (got[3]["n_words"], got[3]["labels"], got[3]["score"]) == (0, "", 0.0) and got[4]["n_words"] == 0
    assert licenses.scan(none).count() == 0 and len(licenses.rules()) > 200


def brute_components(rows, n, percent):
    sets = []
    for _, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    return [(r[0], len(s), min(x[0] for x, h in zip(rows, group, strict=True) if h == g)) for r, s, g in zip(rows, sets, group, strict=True)]


def test_jaccard_against_all_pairs(spark, none):
    rng = np.random.default_rng(3)
    rows = []
    for family in range(12):
        base = [f"w{x}" for x in rng.integers(0, 400, 60)]
        for _ in range(6):
            text = list(base)
            for i in rng.integers(0, 60, rng.integers(0, 4)):
                text[i] = f"v{rng.integers(0, 9)}"
            rows.append((len(rows), " ".join(text), None, None, None))
    rows += [(len(rows), "", None, None, None), (len(rows) + 1, None, None, None, None), (len(rows) + 2, "A b", None, None, None), (len(rows) + 3, "a B", None, None, None)]
    got = sorted(map(tuple, jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA), 4, 85).collect()))
    assert got == sorted(brute_components(rows, 4, 85))
    assert jaccard.near_duplicates(none).count() == 0


def test_one_of_each_group_against_all_pairs(spark, none):
    rng = np.random.default_rng(6)
    rows = []
    for family in range(8):
        base = [f"f{family}w{x}" for x in range(40)]
        for k in range(4):
            text = list(base)
            text[int(rng.integers(0, 40))] = f"v{k}"
            rows.append((None if k == 3 else int(rng.integers(0, 9)), " ".join(text), "en", f"s{k}", None))
    rows += [(1, "only here and nowhere else in the table", "en", "a", None), (1, "a quite different text of the same number", "en", "b", None)]
    rows += [(None, "no number but a text of its own", "en", "a", None), (3, "", "en", "a", None), (3, None, "en", "b", None), (3, "", "en", "c", None)]
    rows += [rows[-6]] * 2 + [(*rows[-5][:3], "z", None)]
    component = brute_components([(i, *r[1:]) for i, r in enumerate(rows)], 5, 80)
    groups = {}
    for r, (i, n, c) in zip(rows, component, strict=True):
        groups.setdefault(c if n else -1 - i, []).append(r)
    got = [tuple(r) for r in jaccard.one_of_each_group(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(groups)
    for g in groups.values():
        ids = [r[0] for r in g if r[0] is not None]
        assert sum(r in g and r[0] == min(ids, default=None) for r in set(got)) == len(set(g) & set(got)) >= 1
    assert jaccard.one_of_each_group(none).count() == 0


def test_keep_quality_against_single_scores(spark):
    all_docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    score = {r["doc_id"]: r["score"] for r in quality.scored(all_docs, quality.train(all_docs, labels)).collect()}
    kept = corpus_pipeline.keep_quality(spark, all_docs, SF)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, x in score.items() if x >= 0.7} and kept.columns == all_docs.columns


def test_token_files(docs, none):
    got = sorted(huffman.read_ids(*huffman.write_ids(docs, rows_per_part=2)).collect(), key=lambda r: r["start"])
    encoder, at = TextEncoder.of(vocabulary()), 0
    assert [r["doc_id"] for r in got] == [None, 1, 2, 2, 3, 4, 5, 6]
    texts = {r[0]: r[1] for r in ROWS}
    for r in got:
        ids = [*(encoder.tokenizer.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids), 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert huffman.read_ids(*huffman.write_ids(none)).count() == 0


def test_huffman_is_optimal_within_its_limit():
    counts = np.array([0, 1, 1, 2, 3, 5, 8, 13, 21, 34])
    free, short = huffman.code_lengths(counts, 18), huffman.code_lengths(counts, 4)
    assert (counts * free).sum() == 88 + 54 + 33 + 20 + 12 + 7 + 4 + 2 and short.max() == 4
    assert sum(2.0 ** -int(x) for x in short if x) <= 1


def test_separators(docs, none):
    files = separators.flat_files(docs, block_ids=64)
    assert files.filter("length(data) > 128").count() == 0
    encoder = TextEncoder.of(vocabulary())
    want = sorted(len(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in ROWS)
    found = separators.documents_of(files)
    assert sorted(r["n_tokens"] for r in found.filter("closed").collect()) == want
    assert separators.documents_of(separators.flat_files(none)).count() == 0


def test_decontamination(spark, docs, none):
    words = BODY.split()
    bench = spark.createDataFrame([(7, " ".join(words[3:16])), (8, "one TWO"), (9, None), (7, "naïve word été naïve")], "item_id long, text string")
    got = {r["doc_id"]: r for r in fmindex.contamination(docs, bench).collect()}
    assert (got[1]["n_hit"], got[1]["n_items"], got[6]["n_hit"], got[3]["contaminated"], got[4]["n_words"]) == (13, 1, 2, False, 0)
    assert got[5]["n_hit"] == 8998  # all but the first and last word
    assert got[5]["items_sha256"] == hashlib.sha256(b"7").hexdigest()
    cut = {r["doc_id"]: r["text"] for r in fmindex.without_hits(docs, bench).collect()}
    assert 6 not in cut and cut[3] == "" and cut[4] is None and cut[1].startswith("alpha beta gamma  omicron") is False
    assert "delta" not in cut[1] and "alpha beta gamma" in cut[1]
    assert fmindex.contamination(none, bench).count() == 0


def test_a_benchmark_in_parts_cuts_as_one(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), "Xx, " + "; ".join(words[5:40]) + " yy", "clean " + " ".join(words[:9]), " ".join(words[10:30]), "", None]
    # w4..w8 and w42..w49 become neighbours only when all between them is cut out: no window of the document
    items = [" ".join(words[9:20]), " ".join(words[14:27]), " ".join(words[24:36]), " ".join(words[30:42]), " ".join(words[4:9] + words[42:50])]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)] + [(1, texts[1], 7)], "doc_id long, text string, n_chars int")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    one = sorted(map(str, fmindex.without_hits(docs, bench).collect()))
    monkeypatch.setattr(fmindex, "PART_BYTES", 40)
    many = fmindex.without_hits(docs, bench)
    assert sorted(map(str, many.collect())) == one and many.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in many.collect()}[0].split() == words[:9] + words[42:]


def test_fm_index_against_search():
    rng = np.random.default_rng(5)
    text = rng.integers(0, 4, 3000)
    text[0] = 0
    index = fmindex.FMIndex(text, 3)
    patterns = np.array([text[i : i + 5] for i in range(1, 2900, 50)])
    patterns = patterns[(patterns > 0).all(1)]
    lo, hi = index.search(patterns, np.full(len(patterns), 5))
    for p, a, b in zip(patterns, lo, hi, strict=True):
        assert sorted(index.locate(np.arange(a, b))) == [i for i in range(2996) if (text[i : i + 5] == p).all()]


def test_classifiers_on_held_out_rows(spark, docs, none):
    all_docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.train(all_docs, labels)
    rows = quality.scored(all_docs, model).join(labels, "doc_id").filter(quality.is_held_out()).collect()
    assert sum((r["score"] >= 0.7) == r["quality"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in quality.scored(docs, model).collect()) and quality.scored(none, model).count() == 0
    chain = toxicity.train(all_docs, labels)
    rows = toxicity.scored(all_docs, chain).join(labels, "doc_id").filter(quality.is_held_out()).collect()
    assert sum((r["toxicity"]["toxic"] >= 0.5) == r["toxic"] for r in rows) >= 0.9 * len(rows)
    assert toxicity.scored(docs, chain).count() == len(ROWS) and toxicity.scored(none, chain).count() == 0
    assert quality.scored(docs, quality.train(docs, labels.limit(0))).count() == len(ROWS)


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(0)
    score, chain, first = rng.normal(size=5), rng.normal(size=(2, 2)), np.array([0, 3, 5])
    good, _, z = quality.marginals(score, chain, first)
    for d, (a, b) in enumerate(zip(first, first[1:], strict=False)):
        n, total, hits = b - a, 0.0, np.zeros(b - a)
        for m in range(1 << n):
            y = [(m >> i) & 1 for i in range(n)]
            w = np.exp(sum(score[a + i] * y[i] for i in range(n)) + sum(chain[y[i], y[i + 1]] for i in range(n - 1)))
            total, hits = total + w, hits + w * np.array(y)
        assert np.allclose(good[a:b], hits / total) and np.isclose(z[d], np.log(total))


def test_pipeline(spark):
    out = QUERIES["pipeline"](spark, SF)
    assert out.count() > 0 and [n for n, _ in corpus_pipeline.STAGES][0] == "quality_crf"
