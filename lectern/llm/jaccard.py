"""N-gram Jaccard join by adaptive multi-match prefixes.

A document is its set of distinct word n-grams. Tokens are ordered by document frequency, rare ones first. Of two
linked sets the smaller one's index prefix and the larger one's probe prefix share a token; prefixes longer by l - 1
share l. Each document takes the l that its tokens' frequencies make cheapest, and a pair must then share as many
prefix tokens as the lesser of its two l before it is verified.

Exact but for hashes: equal sets are one class by 128 bits; n-grams are told apart by hashes of 40 bits and more, which
grow with the corpus. A token that one document alone has is never sent on; size, unique-token and parity-bitmap bounds
drop only pairs that can't link; every link is verified on the sets of hashes. Large families of near
copies don't expand into pairs: each member is first linked to a centre that shares a min-hash with it, and pairs
already connected by their centre aren't formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import small_batches, table, trim, trimmed, written
from lectern.llm.words import NOT_BLANK, Words, mixed, rounds

#: Text bytes of a chunk (documents whose n-grams travel together) and n-grams of a bucket (those whose frequencies one task counts).
CHUNK_BYTES, BUCKET_GRAMS = 8_000_000, 2_000_000
#: Bits by which a chunk's n-grams are dealt to buckets at most; more bits deal what a bucket has of many chunks once more.
FAN_BITS = 12
#: Bits of an n-gram's hash below those that name its bucket (more while there are few buckets: see ``gram_bits``), and
#: longs of a document's parity bitmap. The hash grows with the number of buckets, so collisions stay as rare at any size.
LOW_BITS, LEAST_BITS, MAP_LONGS = 33, 40, 16
#: Verifying a candidate costs as much as reading so many prefix tokens; the longest multiple match that is tried.
VERIFY_COST, MOST_MATCHES = 20, 8
CENTRES = 6

GRAMS = (
    "chunk long, bucket int, doc_ids array<long>, sizes array<int>, classes array<string>, docs binary, grams binary, df binary"
)
FINER = "bucket long, team int, members array<long>, places binary, docs binary, grams binary, df binary"
FOUND = (
    "class string, n int, alone int, need int, parity array<long>, shared binary, index_tokens array<long>, "
    "probe_tokens array<long>, mins array<long>"
)


def gram_bits(bits: int) -> int:
    """Bits of an n-gram's hash where ``bits`` of them name its bucket."""
    return max(LEAST_BITS, LOW_BITS + bits)


def _planes(x: np.ndarray, n: int) -> bytes:
    """The low ``n`` bytes of each value, byte by byte: sorted values then compress well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def _bytes(bits: int) -> int:
    return -(-bits // 8)


def _unplaned(raw: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(raw) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(raw, np.uint8).reshape(n, -1).T
    return out.reshape(-1).view("<u8")


def _sets(words: Words, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, 64-bit n-gram), distinct and sorted. A text of fewer words has all its words as its one n-gram."""
    grams = words.runs(n_words)
    count = np.diff(words.first)
    full = np.flatnonzero(count >= n_words)
    doc = np.repeat(full, count[full] - n_words + 1)
    at = np.repeat(words.first[full], count[full] - n_words + 1) + np.arange(len(doc)) - np.repeat(np.cumsum(count[full] - n_words + 1) - (count[full] - n_words + 1), count[full] - n_words + 1)
    short = np.flatnonzero((count > 0) & (count < n_words))
    single = np.zeros(len(short), np.uint64)
    for k in range(n_words - 1):
        has = count[short] > k
        single[has] = mixed(single[has] * np.uint64(5) + words.hash[words.first[short[has]] + k] + np.uint64(101 + k))
    doc, gram = np.concatenate([doc, short]), np.concatenate([grams[at], single])
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
    return doc[keep], gram[keep]


def _classes(doc: np.ndarray, gram: np.ndarray, n_docs: int) -> tuple[np.ndarray, list[str]]:
    """Of each document the number of n-grams, and a 128-bit name that equal sets share (empty for the empty set)."""
    sizes = np.bincount(doc, minlength=n_docs)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    one = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(gram ^ np.uint64(0x5BD1E995)), dtype=np.uint64)])
    two = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(gram * np.uint64(7) + np.uint64(3)), dtype=np.uint64)])
    a, b = one[edges[1:]] - one[edges[:-1]], two[edges[1:]] - two[edges[:-1]]
    return sizes, [f"{x:016x}{y:016x}" if n else "" for x, y, n in zip(a.tolist(), b.tolist(), sizes.tolist(), strict=True)]


def gram_table(docs: DataFrame, n_words: int, bits: int, all_bits: int) -> DataFrame:
    """Per chunk of documents a row of names and sizes (bucket -1), and per bucket of hashes its n-grams with their documents' places.

    ``bits`` of a hash name the bucket here, of the ``all_bits`` that name the one in which n-grams are counted.
    """
    low = gram_bits(all_bits) - bits

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk = TaskContext.get().partitionId() << 24
        ids, sizes, classes, docs_, grams, held = [], [], [], [], [], 0

        def flush():
            d, g = np.concatenate(docs_), np.concatenate(grams)
            docs_.clear()
            grams.clear()
            g >>= np.uint64(64 - low - bits)
            order = np.argsort(g, kind="stable")
            d, g = d[order], g[order]
            edges = np.searchsorted(g >> np.uint64(low), np.arange((1 << bits) + 1)) if bits else [0, len(g)]
            g &= np.uint64((1 << low) - 1)
            rows = [(chunk, -1, ids, sizes, classes, b"", b"", b"")]
            for k in range(1 << bits):
                lo, hi = edges[k], edges[k + 1]
                if hi > lo:
                    rows.append((chunk, k, None, None, None, d[lo:hi].astype("<u2").tobytes(), _planes(g[lo:hi], _bytes(low)), b""))
            return pd.DataFrame(rows, columns=[c.split()[0] for c in GRAMS.split(", ")])

        for batch in trimmed(batches):
            keys = batch["doc_id"].tolist()
            for lo, hi, raw in rounds(batch["text"].tolist()):
                doc, gram = _sets(Words(raw, NOT_BLANK), n_words)
                n, names = _classes(doc, gram, len(raw))
                if held and (held + sum(map(len, raw)) > CHUNK_BYTES or len(ids) + len(raw) > 65_535):
                    yield flush()
                    chunk += 1
                    ids, sizes, classes, docs_, grams, held = [], [], [], [], [], 0
                docs_.append((doc + len(ids)).astype(np.uint16))
                grams.append(gram)
                ids += [None if pd.isna(k) else int(k) for k in keys[lo:hi]]
                sizes += n.tolist()
                classes += names
                held += sum(map(len, raw))
        if ids:
            yield flush()

    return docs.select("doc_id", "text").mapInPandas(collect, GRAMS)


def _shared(grams: list[bytes], n_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, n-gram, how many documents have it) of those that more than one has, over the rows of a bucket; and where each row begins among them."""
    sizes = [len(x) // n_bytes for x in grams]
    gram = np.concatenate([_unplaned(x, n_bytes) for x in grams])
    order = np.argsort(gram, kind="stable")
    in_order = gram[order]
    starts = np.flatnonzero(np.concatenate([[True], in_order[1:] != in_order[:-1]])) if len(gram) else np.zeros(0, np.int64)
    del in_order
    times = np.diff(starts, append=len(gram)).astype(np.int32)
    df = np.empty(len(gram), np.int32)
    df[order] = np.repeat(times, times)
    del order
    keep = np.flatnonzero(df > 1)
    return keep, gram[keep], np.minimum(df[keep], 65_535), np.searchsorted(keep, np.concatenate([[0], np.cumsum(sizes)]))


def _frequencies(low: int):
    """Back to each chunk: the bucket's n-grams that more than one document has, with how many have it."""

    def count(bucket: pd.DataFrame) -> pd.DataFrame:
        keep, gram, df, edges = _shared(list(bucket["grams"]), _bytes(low))
        doc = np.concatenate([np.frombuffer(x, "<u2") for x in bucket["docs"]])
        rows = []
        for k, (chunk, name) in enumerate(zip(bucket["chunk"], bucket["bucket"], strict=True)):
            lo, hi = edges[k], edges[k + 1]
            if hi > lo:
                rows.append((chunk, name, None, None, None, doc[keep[lo:hi]].tobytes(), _planes(gram[lo:hi], _bytes(low)), df[lo:hi].astype("<u2").tobytes()))
        del keep, gram, df, doc
        trim()
        return pd.DataFrame(rows, columns=[c.split()[0] for c in GRAMS.split(", ")])

    return count


def _spread(low: int, more: int):
    """What a bucket has of a team of chunks, dealt to finer buckets by ``more`` bits of the ``low`` ones left, with the chunk of each n-gram."""

    def spread(part: pd.DataFrame) -> pd.DataFrame:
        members = part["chunk"].tolist()
        gram = np.concatenate([_unplaned(x, _bytes(low)) for x in part["grams"]])
        doc = np.concatenate([np.frombuffer(x, "<u2") for x in part["docs"]])
        place = np.repeat(np.arange(len(members), dtype="<u2"), [len(x) // 2 for x in part["docs"]])
        order = np.argsort(gram, kind="stable")
        gram, doc, place = gram[order], doc[order], place[order]
        edges = np.searchsorted(gram >> np.uint64(low - more), np.arange((1 << more) + 1))
        gram &= np.uint64((1 << (low - more)) - 1)
        name, team, rows = int(part["bucket"].iloc[0]) << more, int(part["team"].iloc[0]), []
        for k in np.flatnonzero(np.diff(edges)).tolist():
            lo, hi = edges[k], edges[k + 1]
            rows.append((name | k, team, members, place[lo:hi].tobytes(), doc[lo:hi].tobytes(), _planes(gram[lo:hi], _bytes(low - more)), b""))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FINER.split(", ")])

    return spread


def _finer_frequencies(low: int):
    """``_frequencies`` of a finer bucket: a row a team."""

    def count(bucket: pd.DataFrame) -> pd.DataFrame:
        keep, gram, df, edges = _shared(list(bucket["grams"]), _bytes(low))
        doc = np.concatenate([np.frombuffer(x, "<u2") for x in bucket["docs"]])[keep]
        place = np.concatenate([np.frombuffer(x, "<u2") for x in bucket["places"]])[keep]
        rows = []
        for k, (name, team, members) in enumerate(zip(bucket["bucket"], bucket["team"], bucket["members"], strict=True)):
            lo, hi = edges[k], edges[k + 1]
            if hi > lo:
                rows.append((name, team, members, place[lo:hi].tobytes(), doc[lo:hi].tobytes(), _planes(gram[lo:hi], _bytes(low)), df[lo:hi].astype("<u2").tobytes()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FINER.split(", ")])

    return count


def _gathered(low: int, more: int):
    """The reverse of ``_spread``: a team's counted n-grams of all finer buckets of a bucket, a row a chunk again."""

    def gather(part: pd.DataFrame) -> pd.DataFrame:
        fine = low - more
        gram = np.concatenate([_unplaned(x, _bytes(fine)) | (np.uint64(int(b) & ((1 << more) - 1)) << np.uint64(fine)) for x, b in zip(part["grams"], part["bucket"], strict=True)])
        chunk = np.concatenate([np.asarray(m, np.int64)[np.frombuffer(p, "<u2")] for m, p in zip(part["members"], part["places"], strict=True)])
        doc, df = (np.concatenate([np.frombuffer(x, "<u2") for x in part[c]]) for c in ("docs", "df"))
        order = np.argsort(chunk, kind="stable")
        names, starts = np.unique(chunk[order], return_index=True)
        name, rows = int(part["bucket"].iloc[0]) >> more, []
        for c, some in zip(names.tolist(), np.split(order, starts[1:]), strict=True):
            rows.append((c, name, None, None, None, doc[some].tobytes(), _planes(gram[some], _bytes(low)), df[some].tobytes()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in GRAMS.split(", ")])

    return gather


def counted_grams(grams: DataFrame, bits: int) -> DataFrame:
    """The bodies of ``gram_table`` with each n-gram's frequency, without those that one document alone has.

    Each chunk makes at most 2 ** FAN_BITS rows. Where that would leave buckets too large, what each has of a team of as
    many chunks is dealt once more, and gathered by chunk again, so rows grow with the volume alone, not with its square.
    """
    bodies, first = grams.filter("bucket >= 0"), min(bits, FAN_BITS)
    low, more = gram_bits(bits) - first, bits - first
    if not more:
        return bodies.groupBy("bucket").applyInPandas(_frequencies(low), GRAMS)
    teams = max(1, grams.filter("bucket < 0").count() >> first)
    fine = bodies.withColumn("team", F.pmod(F.xxhash64("chunk"), F.lit(teams)).cast("int")).groupBy("bucket", "team").applyInPandas(_spread(low, more), FINER)
    fine = fine.groupBy("bucket").applyInPandas(_finer_frequencies(low - more), FINER)
    return fine.groupBy(F.shiftright("bucket", more).alias("b"), "team").applyInPandas(_gathered(low, more), GRAMS)


def _prefixes(percent: int, bits: int, fan: int):
    """Of each chunk the documents that may have a partner, with their prefixes: what ``applyInPandas`` runs on a chunk's rows."""

    def survivors(chunk: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in FOUND.split(", ")]
        head = chunk[chunk["bucket"] < 0]
        rest = chunk[chunk["bucket"] >= 0]
        if not len(head) or not len(rest):
            return pd.DataFrame([], columns=columns)
        sizes, classes = np.asarray(head["sizes"].iloc[0], np.int64), head["classes"].iloc[0]
        doc = np.concatenate([np.frombuffer(x, "<u2") for x in rest["docs"]])
        low = gram_bits(bits) - min(bits, fan)
        gram = np.concatenate([_unplaned(x, _bytes(low)) | (np.uint64(b) << np.uint64(low)) for x, b in zip(rest["grams"], rest["bucket"], strict=True)])
        df = np.concatenate([np.frombuffer(x, "<u2") for x in rest["df"]])
        order = np.lexsort((gram, df, doc))
        doc, gram, df = doc[order], gram[order], df[order]
        edges = np.searchsorted(doc, np.arange(len(sizes) + 1))
        rows, done = [], set()
        for i, n in enumerate(sizes.tolist()):
            lo, hi = int(edges[i]), int(edges[i + 1])
            alone = n - (hi - lo)
            probe = n - -(-percent * n // 100)  # tokens that a partner may lack
            if hi == lo or alone > probe or classes[i] in done:
                continue
            done.add(classes[i])
            index = n - -(-2 * percent * n // (100 + percent))
            cost = np.concatenate([[0], np.cumsum(df[lo:hi].astype(np.int64) - 1)])
            best, need = None, 1
            for m in range(1, min(MOST_MATCHES, n - index, n - probe) + 1):
                work = cost[min(max(probe + m - alone, 0), hi - lo)] * (1 + VERIFY_COST / m)
                if best is None or work < best:
                    best, need = work, m
            tokens = gram[lo:hi]
            parity = np.bincount((tokens % np.uint64(64 * MAP_LONGS)).astype(np.int64), minlength=64 * MAP_LONGS) & 1
            rows.append(
                (
                    classes[i], n, alone, need,
                    np.packbits(parity.astype(np.uint8)).view(">i8").astype(np.int64).tolist(),
                    _planes(np.sort(tokens), 8),
                    tokens[: max(0, index + need - alone)].astype(np.int64).tolist(),
                    tokens[: max(0, probe + need - alone)].astype(np.int64).tolist(),
                    [int(mixed(tokens + np.uint64(k << 50)).argmin()) for k in range(CENTRES)],
                )
            )
            rows[-1] = (*rows[-1][:-1], [int(tokens[k]) for k in rows[-1][-1]])
        del doc, gram, df, order, rest
        trim()
        return pd.DataFrame(rows, columns=columns)

    return survivors


def _possible(percent: int) -> Column:
    """Whether the sets a and b (b no smaller) can link at all, by sizes, tokens that nobody shares and parity bitmaps."""
    need = percent * (F.col("a_n") + F.col("b_n"))
    most = (100 - percent) * (F.col("a_n") + F.col("b_n"))  # (100 + percent) times the largest symmetric difference
    differ = F.col("a_alone") + F.col("b_alone")
    for k in range(MAP_LONGS):
        differ = differ + F.bit_count(F.col("a_parity")[k].bitwiseXOR(F.col("b_parity")[k]))
    return (
        (percent * F.col("b_n") <= 100 * F.col("a_n"))
        & ((100 + percent) * (F.col("a_n") - F.col("a_alone")) >= need)
        & ((100 + percent) * (F.col("b_n") - F.col("b_alone")) >= need)
        & ((100 + percent) * differ <= most)
    )


def _side(df: DataFrame, side: str, *names: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{side}_{c}") for c in names])


def _verified(pairs: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link: intersections lie within the tokens that more than one document has."""

    @F.pandas_udf("boolean")
    def links(pairs: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a_n, a, b_n, b in trimmed(pairs):
            out = []
            for n, x, m, y in zip(a_n, a, b_n, b, strict=True):
                common = len(np.intersect1d(_unplaned(x, 8), _unplaned(y, 8), assume_unique=True))
                out.append(100 * common >= percent * (n + m - common))
            yield pd.Series(out, dtype=bool)

    sets = found.select("class", "n", "shared")
    joined = pairs.join(_side(sets, "a", "class", "n", "shared"), F.col("a") == F.col("a_class")).join(_side(sets, "b", "class", "n", "shared"), F.col("b") == F.col("b_class"))
    return joined.filter(links("a_n", "a_shared", "b_n", "b_shared")).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of an undirected graph's nodes: each node moves to the neighbour of least hash until no edge is left.

    Each round draws new hashes, so the nodes left shrink by a constant factor also along chains.
    """
    edges = written(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), "edges")
    roots, turn = None, 0
    while not edges.isEmpty():
        turn += 1
        ranked = edges.select("a", *[F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("v")).alias(f"r{c}") for c in ("a", "b")])
        moves = ranked.groupBy("a").agg(F.least(F.min("ra"), F.min("rb"))["v"].alias("to")).withColumnRenamed("a", "from")
        moves = written(moves, "moves")
        if roots is None:
            roots = moves.select(F.col("from").alias("node"), F.col("to").alias("root"))
        else:
            roots = roots.join(moves, F.col("root") == F.col("from"), "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = written(roots, "roots")
        a, b = moves.select(F.col("from").alias("a"), F.col("to").alias("x")), moves.select(F.col("from").alias("b"), F.col("to").alias("y"))
        edges = written(edges.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b")).filter("a <> b").distinct(), "edges")
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def linked_classes(docs: DataFrame, n_words: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(rows, roots): per row of ``docs`` doc_id, n_shingles and class (equal sets share one); per linked class its component's root."""
    small_batches(docs.sparkSession)
    volume = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = max(0, int(volume / 6 / BUCKET_GRAMS).bit_length())
    grams = written(gram_table(docs, n_words, min(bits, FAN_BITS), bits), "grams")
    heads = grams.filter("bucket < 0")
    rows = heads.select("chunk", F.explode(F.arrays_zip("doc_ids", "sizes", "classes")).alias("d")).select(
        F.col("d.doc_ids").alias("doc_id"), F.col("d.sizes").cast("long").alias("n_shingles"), F.col("d.classes").alias("class")
    )
    found = heads.unionByName(counted_grams(grams, bits)).groupBy("chunk").applyInPandas(_prefixes(percent, bits, FAN_BITS), FOUND)
    found = written(found.dropDuplicates(["class"]), "survivors")

    stats = found.select("class", "n", "alone", "need", "parity", "mins")
    keys = stats.select("class", "n", "alone", F.posexplode("mins").alias("k", "token"))
    centre = F.min(F.struct((F.col("alone") / F.col("n")).alias("p"), F.col("n"), F.col("class").alias("c")))["c"]
    heads_of = keys.groupBy("k", "token").agg(centre.alias("centre"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m")
    stars = keys.join(heads_of, ["k", "token"]).filter("class <> centre").select("class", "centre").distinct()
    basic = stats.select("class", "n", "alone", "parity")
    sides = stars.join(basic, "class").join(basic.select(*[F.col(c).alias(f"c_{c}") for c in basic.columns]), F.col("centre") == F.col("c_class"))
    smaller = F.col("n") <= F.col("c_n")
    ordered = sides.select(
        "class", "centre",
        *[F.when(smaller, F.col(c)).otherwise(F.col(f"c_{c}")).alias(f"a_{c}") for c in basic.columns],
        *[F.when(smaller, F.col(f"c_{c}")).otherwise(F.col(c)).alias(f"b_{c}") for c in basic.columns],
    )
    stars = _star_links(ordered, found, percent)
    stars = written(stars, "stars")
    label = stars.join(stats.select(F.col("class").alias("centre"), (F.col("alone") / F.col("n")).alias("p")), "centre").groupBy("class").agg(F.min(F.struct("p", "centre"))["centre"].alias("label"))
    labelled = found.drop("shared", "mins").join(label, "class", "left").withColumn("label", F.coalesce("label", "class"))
    names = ("class", "n", "alone", "need", "parity", "label")
    index = labelled.select(*names, F.explode("index_tokens").alias("token"))
    probe = labelled.select(*names, F.explode("probe_tokens").alias("token"))
    later = (F.col("b_n") > F.col("a_n")) | ((F.col("b_n") == F.col("a_n")) & (F.col("b_class") > F.col("a_class")))
    pairs = (
        _side(index, "a", *names, "token")
        .join(_side(probe, "b", *names, "token"), (F.col("a_token") == F.col("b_token")) & later & (F.col("a_label") != F.col("b_label")) & _possible(percent))
        .groupBy(F.col("a_class").alias("a"), F.col("b_class").alias("b"), F.least("a_need", "b_need").alias("need"))
        .agg(F.count(F.lit(1)).alias("common"))
        .filter("common >= need")
    )
    links = _verified(pairs.select("a", "b"), found, percent)
    return rows, components(links.union(stars.select(F.col("class").alias("a"), F.col("centre").alias("b"))))


def _star_links(ordered: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """The (class, centre) pairs that link."""
    pairs = ordered.filter(_possible(percent)).select(F.col("class").alias("a"), F.col("centre").alias("b"))
    return _verified(pairs, found, percent).select(F.col("a").alias("class"), F.col("b").alias("centre"))


def near_duplicates(docs: DataFrame, n_words: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; others are ignored): doc_id, n_shingles, component_id.

    Two documents link when 100 |A & B| >= percent |A | B| for their sets of word n-grams; component_id is the least
    doc_id that links reach. A document without words links with nothing; one of fewer than ``n_words`` words has
    them as its one n-gram. Rows that repeat each get a row; a null doc_id is a component's id only if it has no other.
    """
    rows, roots = linked_classes(docs, n_words, percent)
    least = rows.filter("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("first"))
    least = least.join(roots, F.col("class") == F.col("node"), "left").withColumn("root", F.coalesce("root", "class"))
    ids = least.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = least.join(ids, "root").select("class", "component_id")
    return rows.join(ids, "class", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, n_words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the least doc_id (null comes last), then of the least hash.

    Rows are told apart by doc_id and text, not by doc_id alone; of rows equal in both, the least hash of the other
    columns decides. A row without words is near to nothing and stays.
    """
    names = docs.columns
    others = [F.col(f"doc.`{c}`") for c in names if c not in ("doc_id", "text")]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), "doc_id", "text", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("key"))
    rows, roots = linked_classes(keyed.select(F.col("key").alias("doc_id"), "text"), n_words, percent)
    rows = written(rows.select(F.col("doc_id").alias("key"), (F.col("n_shingles") > 0).alias("worded"), "class").distinct(), "rows")
    of = rows.filter("worded").join(roots, F.col("class") == F.col("node"), "left").select("key", F.coalesce("root", "class").alias("root"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))["key"]
    firsts = keyed.select("key", "doc_id").distinct().join(of, "key").groupBy("root").agg(least.alias("key"))
    stay = written(firsts.select("key", F.lit(True).alias("once")).unionByName(rows.filter("not worded").select("key", F.lit(False).alias("once"))), "firsts")
    turn = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64(*others) if others else F.lit(0)))
    return keyed.join(stay, "key").withColumn("turn", turn).filter("turn = 1 or not once").select("doc.*")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose sets of 4-word shingles link at 85 percent."""
    return near_duplicates(table(spark, sf_dir, "documents"), n_words=4, percent=85)
