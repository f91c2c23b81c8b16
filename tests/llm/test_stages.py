"""Stages of the pipeline and parts of operators on rows that clash, repeat or lack values, and against plain loops."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from lectern.llm import common, fmindex, huffman, jaccard, mixing, quality, separators, sharding, toxicity
from lectern.llm.queries import QUERIES
from lectern.llm.tokens import TextEncoder, vocabulary

SF = "/root/testdata/sf0.001"
CLASH = "score _had text_hash row size target spans taken source_size number start key bucket words label shardless _key _turn class epoch own order doc".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH)


def rows_of(texts):
    return [(None if i % 7 == 3 else i // 2, t, "en", None if i % 5 == 0 else f"s{i % 3}", len(t or ""), *[f"{c}{i}" for c in CLASH]) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def clashing(spark):
    words = [f"w{i}" for i in range(40)]
    texts = ["", None, "one", "One two", " \n\t", "x" * 5000, "word " * 9000, "a\n\nb\n", *[" ".join(words[:k]) for k in range(20, 40)]]
    texts += [" ".join(words)] * 6
    return spark.createDataFrame(rows_of(texts), SCHEMA)


def extras(rows):
    return Counter(tuple(r[c] for c in CLASH) for r in rows)


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns_of_any_name(spark, clashing, stage):
    name, function = corpus_pipeline.STAGES[stage]
    out = function(spark, clashing, SF)
    assert out.columns == clashing.columns and [f.dataType for f in out.schema] == [f.dataType for f in clashing.schema]
    rows = out.collect()
    assert rows and not extras(rows) - Counter({k: 2 for k in extras(clashing.collect())})
    assert all(r["n_chars"] == len(r["text"] or "") for r in rows)
    assert function(spark, clashing.limit(0), SF).count() == 0


def test_last_stage_places_every_row(spark, clashing):
    out = corpus_pipeline.STAGES[4][1](spark, clashing, SF)
    rows = out.collect()
    assert len(rows) == clashing.count() and out.limit(0).count() == 0
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_quality_stage_is_the_score_of_each_text(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    single = {}
    for r in docs.collect():
        x, n, first = quality.line_features([(r["text"] or "").encode()])
        single[r["doc_id"]] = float(model.scores(x, n, first)[0])
    together = {r["doc_id"]: r["score"] for r in quality.scored(docs, model).collect()}
    assert all(abs(single[d] - together[d]) < 1e-9 for d in single)


def test_cutting_against_a_plain_search(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    low = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for r in bench.collect():
        w = find.findall(low(r["text"]))
        windows |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9)) if w}
    want = {}
    for r in docs.collect():
        spans = [m.span() for m in find.finditer(low(r["text"]))]
        w = [low(r["text"])[a:b] for a, b in spans]
        hit = {k + j for n in {len(x) for x in windows} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in windows for j in range(n)}
        if hit and len(hit) == len(w):
            continue
        text, k = r["text"], len(w) - 1
        while k >= 0:
            if k in hit:
                b = k
                while b - 1 in hit:
                    b -= 1
                text, k = text[: spans[b][0]] + text[spans[k][1] :], b
            k -= 1
        want[r["doc_id"]] = text
    assert {r["doc_id"]: r["text"] for r in fmindex.without_hits(docs, bench).collect()} == want


def test_blocks_of_an_epoch_go_to_one_shard_each(spark):
    rng = np.random.default_rng(4)
    rows = [(None if i % 50 == 0 else i, f"s{int(rng.integers(0, 4))}" if i % 9 else None, int(rng.integers(0, 400))) for i in range(3000)]
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, source string, size long, number long")
    out = mixing.mix(docs, 5).collect()
    assert len(out) == len(rows)
    per_shard = Counter()
    for r in out:
        seen = defaultdict(list)
        for s in r["spans"]:
            seen[s["epoch"]].append((s["begin"], s["end"]))
            per_shard[s["shard"]] += s["end"] - s["begin"]
            assert 0 <= s["shard"] < 5
        for spans in seen.values():  # no word twice in an epoch
            spans.sort()
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)) and spans[0][0] >= 0 and spans[-1][1] <= r["size"]
        assert r["taken"] <= 2 * r["size"]
    got, target = Counter(), {}
    for r in out:
        got[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(got[s] - t) <= max(2, 0.01 * t) for s, t in target.items())
    assert max(per_shard.values()) / min(per_shard.values()) < 1.1
    again = mixing.mix(docs.repartition(3), 5).collect()
    assert Counter((r["number"], r["taken"]) for r in again) == Counter((r["number"], r["taken"]) for r in out)


def test_equal_texts_without_ids_spread_over_shards(spark):
    rows = [(None, "the same text", i) for i in range(4000)] + [(i, f"text number {i} of its own", i) for i in range(2000)]
    digests = common.written(sharding.digests(spark.createDataFrame(rows, "doc_id long, text string, extra int")), "digests")
    load = {r[0]: r[1] for r in sharding.assign(digests, 6).groupBy("shard").sum("size").collect()}
    assert len(load) == 6 and max(load.values()) / min(load.values()) < 1.03


def test_shard_files_hold_all_rows(spark, tmp_path):
    docs = spark.createDataFrame([(i // 2, f"text {i // 4}" if i % 5 else None, i) for i in range(200)], "doc_id long, text string, extra int")
    sharding.shard_files(docs, str(tmp_path / "shards"), 4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(r["extra"] for r in back.collect()) == list(range(200))
    with pytest.raises(ValueError):
        sharding.shard_files(docs.withColumn("Slot", docs.extra), str(tmp_path / "no"), 4)


def test_pack_against_a_plain_loop():
    rng = np.random.default_rng(8)
    sizes = rng.integers(1, 50, (60, 3)).astype(float)
    got = sharding.pack(sizes, 4, (1.0, 0.5, 0.25), (1.0, 0.5, 0.25), 0.0)
    left = np.ones((4, 3))
    share = sizes / (sizes.sum(0) / 4)
    for i in sorted(range(60), key=lambda i: (-sizes[i, 0], -sizes[i, 1], i)):
        best = max(range(4), key=lambda s: (round(sum(left[s, m] * share[i, m] * (1.0, 0.5, 0.25)[m] for m in range(3)), 12), -s))
        assert got[i] == best
        left[best] -= share[i]


@pytest.mark.parametrize("fan", [12, 2])
def test_ngrams_are_counted_alike_however_they_are_dealt(spark, monkeypatch, fan):
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(30):
        base = [f"w{x}" for x in rng.integers(0, 900, 50)]
        for _ in range(int(rng.integers(1, 6))):
            text = list(base)
            for i in rng.integers(0, 50, int(rng.integers(0, 3))):
                text[i] = f"v{rng.integers(0, 9)}"
            texts.append(" ".join(text))
    rows = list(enumerate(texts))
    monkeypatch.setattr(jaccard, "FAN_BITS", fan)
    monkeypatch.setattr(jaccard, "BUCKET_GRAMS", 60)
    monkeypatch.setattr(jaccard, "CHUNK_BYTES", 900)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    sets = [{tuple(t.split()[i : i + 4]) for i in range(47)} for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    assert [got[i] for i in range(len(texts))] == group


def test_token_files_name_each_document(spark):
    rows = [(i, t) for i, t in enumerate(["", None, "a", "two words", "été <|endoftext|> naïve", "long " * 700, "x" * 300, *[f"text {i}" for i in range(200)]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    files = common.written(separators.flat_files(docs, block_ids=37), "flat")
    names, at = {}, Counter()
    for r in files.orderBy("file", "block").collect():
        for d in r["doc_ids"]:
            names[d] = (r["file"], at[r["file"]])
            at[r["file"]] += 1
    found = {(r["file"], r["ordinal"]): (r["start"], r["n_tokens"]) for r in separators.documents_of(files).filter("closed").collect()}
    encoder, want = TextEncoder(vocabulary(), plain=True), {}
    for d, t in rows:
        want[d] = len(encoder.tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    assert {d: found[names[d]][1] for d, _ in rows} == want
    by = defaultdict(list)
    for (f, k), (start, n) in found.items():
        by[f].append((k, start, n))
    for some in by.values():
        some.sort()
        assert [s for _, s, _ in some] == list(np.cumsum([0] + [n for *_, n in some])[:-1])


def test_cuts_of_the_encoder_are_those_of_the_library():
    rng = np.random.default_rng(1)
    parts = ["a", "B", "é", "'s", "’", "“", " ", "  ", "\n", "\n\n", "\t", " \n", " ", "　", "\u0085", "\x1c", ".", ",", "!?", "|", "<|endoftext|>", "<", "23", "4.5", "漢字", "🙂", "×", "²", "é.", "x;y", "\r\n", " .", "é", "١"]
    texts = ["".join(rng.choice(parts, int(rng.integers(0, 14)))) for _ in range(20_000)]
    for plain in (False, True):
        encoder = TextEncoder(vocabulary(), plain, most_kept=200_000)
        want = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
        got = [x for lo in range(0, len(texts), 500) for x in encoder.ids_of(texts[lo : lo + 500])]
        assert all(g == np.array(w.ids, "<u4").tobytes() for g, w in zip(got, want, strict=True))
        assert len(encoder.known) < 5000 and encoder.ids_of(texts[:500]) == got[:500]


def test_wide_ids_and_rounds(spark, monkeypatch):
    monkeypatch.setattr(huffman, "_kind", lambda size: "<u4")
    docs = spark.createDataFrame([(i, "some words " * (i % 40)) for i in range(300)], "doc_id long, text string")
    blocks, lengths = huffman.write_ids(docs, rows_per_part=50)
    got = {r["doc_id"]: r["n_tokens"] for r in huffman.read_ids(blocks, lengths).collect()}
    encoder = TextEncoder(vocabulary())
    assert got == {i: len(encoder.tokenizer.encode("some words " * (i % 40), add_special_tokens=False).ids) + 1 for i in range(300)}


def test_chain_is_trained_on_out_of_fold_predictions():
    rng = np.random.default_rng(2)
    n, f = 200, 12
    dense = rng.random((n, f)) < 0.3
    doc, column = np.nonzero(dense)
    toxic = (dense[:, 0] | dense[:, 1]).astype(float)
    kind = (toxic * dense[:, 0])[:, None]
    fold = np.arange(n) % toxicity.FOLDS
    chain = toxicity.fit_chain(doc, column, np.hstack([kind, toxic[:, None]]), fold, np.arange(f))
    apart = np.zeros(n)
    for k in range(toxicity.FOLDS):
        rest, out = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        d, c = np.nonzero(dense[rest])
        w = toxicity._fit(d, c, len(rest), np.zeros((len(rest), 0)), f, kind[rest, 0])
        d, c = np.nonzero(dense[out])
        apart[out] = toxicity._predict(w, d, c, len(out), np.zeros((len(out), 0)), f)
    want = toxicity._fit(doc, column, n, apart[:, None], f, toxic)
    assert np.allclose(chain.models[1], want)


def test_toxic_texts_fall_into_clusters_of_their_words():
    rows = [[0, 1], [0, 1, 2], [1, 0], [5, 6], [6, 5], [3], [4], [3, 4]]
    toxic = np.array([1, 1, 1, 1, 1, 0, 0, 0.0])
    doc, column = np.repeat(np.arange(8), [len(r) for r in rows]), np.concatenate(rows)
    assert toxicity.clusters(doc, column, toxic, 7).tolist() == [0, 0, 0, 1, 1, -1, -1, -1]
    assert toxicity.clusters(doc, column, np.zeros(8), 7).tolist() == [-1] * 8


def test_learning_leaves_out_held_out_rows_and_bounds_bytes(spark):
    docs = spark.createDataFrame([(i, "text " * 50) for i in range(100)] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    got = common.labelled_sample(docs, labels, "quality", 20).join(docs.select("doc_id").distinct(), "doc_id")
    assert got.groupBy("quality").count().filter("count <> 20").count() == 0 and got.filter(common.is_held_out()).count() == 0
    assert common.labelled_sample(docs, labels, "quality", 20, most_bytes=1000).count() == 8


def test_pipeline_rows_come_from_its_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        held = common.written(stage(spark, held, SF), "stage")
    assert {r["doc_id"] for r in QUERIES["pipeline"](spark, SF).collect()} == {r["doc_id"] for r in held.collect()}
