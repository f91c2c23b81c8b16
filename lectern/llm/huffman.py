"""Token-ID output: canonical length-limited Huffman coding of token ids.

The code comes from the counts of all ids of all documents. A file is a row group of independent blocks; each block
holds whole documents, byte-aligned, with a bit offset every ``STRIDE`` ids of a document, from which a table-driven
decoder reads all stretches of a block at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm import bits
from lectern.llm.common import small_batches, table, written
from lectern.llm.tokens import ROUND_BYTES, TextEncoder, vocabulary
from lectern.llm.words import rounds

#: Ids between two bit offsets of a document.
STRIDE = 256
#: Longest code in bits; a decoding table has 2 ** LIMIT entries.
LIMIT = 18
#: Bits of codes that a document may have: its offsets are 32-bit numbers.
MOST_BITS = (1 << 31) - 1
#: Bytes of codes after which a block is full; a longer document is a block of its own.
BLOCK_BYTES = 256 * 1024
#: Ids that one round of the coder takes, so that memory doesn't follow the batch.
ROUND_IDS = 1_000_000

BLOCKS = (
    "part int, block int, n_ids long, payload binary, doc_ids array<long>, doc_n_ids array<long>, "
    "doc_bytes array<int>, offsets array<int>"
)
CODED = "part int, doc_id long, n_ids long, ids_crc32 long, payload binary, offsets array<int>"
DECODED = "part int, block int, ord int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for symbols that don't occur.

    Ties go to the smaller symbol. One occurring symbol gets length 1.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) == 0:
        return lengths
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    # Each level merges the symbols with the pairs of the level below; only how many of its first items are
    # symbols is needed to count, from the top down, in how many levels a symbol is taken.
    below, kinds = weights, []
    for _ in range(limit - 1):
        pairs = below[: len(below) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, pairs])
        rank = np.argsort(both, kind="stable")
        below = both[rank]
        kinds.append(rank < len(weights))
    take, taken = 2 * len(order) - 2, np.zeros(len(order), np.int64)
    for is_symbol in reversed(kinds):
        symbols = int(is_symbol[:take].sum())
        taken[:symbols] += 1
        take = 2 * (take - symbols)
    taken[:take] += 1
    lengths[order] = taken
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The canonical code values: shorter codes first, equal lengths by symbol."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order) == 0:
        return codes
    widths = lengths[order].astype(np.int64)
    room = np.uint64(1) << (np.uint64(63) - widths.astype(np.uint64))
    first = np.concatenate([[np.uint64(0)], np.cumsum(room, dtype=np.uint64)[:-1]])
    codes[order] = (first >> (np.uint64(63) - widths.astype(np.uint64))).astype(np.uint32)
    return codes


class Coder:
    """Packs arrays of ids, and decodes many stretches of packed ids at once."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.codes = canonical_codes(lengths)
        self.width = max(1, int(lengths.max(initial=0)))
        used = np.flatnonzero(lengths)
        self.symbol = np.zeros(1 << self.width, np.uint32)
        self.step = np.zeros(1 << self.width, np.int64)
        spans = 1 << (self.width - self.lengths[used])
        begin = self.codes[used].astype(np.int64) << (self.width - self.lengths[used])
        where = np.repeat(begin - np.cumsum(spans) + spans, spans) + np.arange(spans.sum())
        self.symbol[where], self.step[where] = np.repeat(used, spans), np.repeat(self.lengths[used], spans)

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> list[tuple[bytes, np.ndarray]]:
        """Of each document, ``sizes`` of ``ids`` one after another, the byte-aligned codes and a bit offset for every ``STRIDE``-th id."""
        width = self.lengths[ids]
        if (width == 0).any():
            raise ValueError("an id has no code")
        ends = np.cumsum(width)
        doc_end = np.cumsum(sizes)
        bits_to = np.concatenate([[0], ends])
        bits_of = bits_to[doc_end] - bits_to[doc_end - sizes]
        n_bytes = (bits_of + 7) // 8
        byte_at = np.concatenate([[0], np.cumsum(n_bytes)])
        at = ends - width + np.repeat(byte_at[:-1] * 8 - bits_to[doc_end - sizes], sizes)
        packed = bits.pack_at(int(byte_at[-1]) * 8, at, self.codes[ids], width).tobytes()
        out = []
        for k, size in enumerate(sizes):
            lo = int(doc_end[k] - size)
            if bits_of[k] > MOST_BITS:
                raise ValueError("a document's codes exceed the 32 bits of an offset")
            out.append((packed[byte_at[k] : byte_at[k + 1]], (at[lo : lo + size : STRIDE] - byte_at[k] * 8).astype(np.int32)))
        return out

    def decode(self, payload: bytes, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids of stretches that begin at bits ``at`` and hold ``sizes`` ids, one stretch after another."""
        out = np.zeros(int(sizes.sum()), np.uint32)
        if len(out) == 0:
            return out
        wins = bits.windows(np.frombuffer(payload, np.uint8))
        begin = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        at, begin, left = at[order].astype(np.int64), begin[order], sizes[order]
        live = np.searchsorted(-left, -np.arange(1, left[0] + 1), side="right")  # stretches with at least so many ids
        shift = np.uint64(64 - self.width)
        for i, n in enumerate(live):
            key = bits.peek(wins, at[:n]) >> shift
            out[begin[:n] + i] = self.symbol[key]
            at[:n] += self.step[key]
        return out


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, ids, wide): each text's ids and the end id as little-endian bytes, 16-bit where the vocabulary allows.

    Null texts are the end id alone, null ids stay null, rows that repeat each get a row.
    """
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder.of(path)
        kind = _kind(encoder.tokenizer.get_vocab_size())
        for batch in batches:
            for lo, hi, raw in rounds(batch["text"].to_pylist(), ROUND_BYTES):
                ids, sizes = encoder.flat_ids(raw, end_id)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32) * np.dtype(kind).itemsize
                ids = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids.astype(kind))])
                yield pa.RecordBatch.from_arrays([batch["doc_id"][lo:hi].cast(pa.int64()), ids, pa.array(np.full(hi - lo, kind == "<u4"))], ["doc_id", "ids", "wide"])

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, ids binary, wide boolean")


def _flat(ids: pa.Array, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """(the ids of a column of ``tokenized``, one row after another; how many each row has)."""
    ends = np.frombuffer(ids.buffers()[1], np.int32, len(ids) + 1, 4 * ids.offset)
    size = 4 if wide else 2
    raw = np.frombuffer(ids.buffers()[2], "<u4" if wide else "<u2", (int(ends[-1]) - int(ends[0])) // size, int(ends[0])) if ids.buffers()[2] else np.zeros(0, np.uint16)
    return raw, np.diff(ends).astype(np.int64) // size


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """The rows of a batch by whether their ids are wide; all rows of one vocabulary are alike."""
    for wide in (False, True):
        some = batch.filter(pc.equal(batch["wide"], wide))
        if len(some):
            yield wide, some


def _kind(vocabulary_size: int) -> str:
    return "<u2" if vocabulary_size <= 1 << 16 else "<u4"


def id_counts(ids: DataFrame) -> np.ndarray:
    """How often each id occurs over all documents. A row an id at most comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for wide, some in _by_width(batch):
                new = np.bincount(_flat(some["ids"], wide)[0])
                total = np.pad(total, (0, max(0, len(new) - len(total))))
                total[: len(new)] += new
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], ["id", "n"])

    rows = ids.select("ids", "wide").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max([0, *(r["id"] for r in rows)]) + 1, np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


class Parts(NamedTuple):
    """How documents are dealt to parts, which ascend with doc_id: null ids first, then ids up to each of ``edges``, then the rest.

    ``first`` is the number of each range's first part and ``spread`` how many parts it has: more than one only where
    all of its rows share an id (or have none), so that their order is free.
    """

    edges: np.ndarray
    first: np.ndarray
    spread: np.ndarray


def part_plan(ids: DataFrame, rows_per_part: int, most: int = 20_000) -> Parts:
    """Parts of about ``rows_per_part`` rows, at most ``most`` ranges. An id that many rows share is a range of its own, dealt to as many parts as it fills."""
    counts = ids.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    n, none = counts["n"], counts["none"]
    ranges, cuts = min(most, -(-(n - none) // rows_per_part)), []
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        cuts = ids.agg(F.percentile_approx(F.col("doc_id"), shares, max(10_000, 20 * ranges)).alias("cuts")).first()["cuts"] or []
    values, times = np.unique(np.array(cuts, np.int64), return_counts=True)
    hot = values[times > 1]
    edges = np.unique(np.concatenate([values, hot - 1]))
    share = dict(zip(values.tolist(), times.tolist(), strict=True))
    spread = np.array([max(1, -(-none // rows_per_part)), *[share[e] + 1 if share.get(e, 1) > 1 else 1 for e in edges.tolist()], 1], np.int64)
    return Parts(edges, np.cumsum(spread) - spread, spread)


def encode_documents(ids: DataFrame, lengths: np.ndarray, parts: Parts) -> DataFrame:
    """Each document's ids as codes; ``part`` is where ``parts`` puts it. Rows that repeat each have their codes."""
    lengths_b = ids.sparkSession.sparkContext.broadcast(lengths)  # a byte an id of the vocabulary

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, turn = Coder(lengths_b.value), TaskContext.get().partitionId()
        for batch in batches:
            for wide, some in _by_width(batch):
                ids, sizes = _flat(some["ids"], wide)
                lo = 0
                while lo < len(sizes):  # rounds of ROUND_IDS, a longer document on its own
                    hi = max(lo + 1, int(np.searchsorted(np.cumsum(sizes[lo:]), ROUND_IDS, side="right")) + lo)
                    n, ids, mine = sizes[lo:hi], ids[int(sizes[lo:hi].sum()) :], ids[: int(sizes[lo:hi].sum())]
                    done = coder.encode(mine, n)
                    raw, ends = memoryview(mine.astype("<u4").tobytes()), 4 * np.cumsum(n)
                    keys = some["doc_id"][lo:hi]
                    span = np.searchsorted(parts.edges, np.asarray(keys.fill_null(0), np.int64)) + 1
                    span[np.asarray(keys.is_null())] = 0
                    part = parts.first[span] + (turn + np.arange(len(n))) % parts.spread[span]
                    turn += len(n)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(part, pa.int32()),
                            keys,
                            pa.array(n),
                            pa.array([zlib.crc32(raw[e - 4 * k : e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)], pa.int64()),
                            pa.array([x for x, _ in done], pa.binary()),
                            pa.array([x for _, x in done], pa.list_(pa.int32())),
                        ],
                        [c.split()[0] for c in CODED.split(", ")],
                    )
                    lo = hi

    return ids.mapInArrow(encode, CODED)


def file_blocks(coded: DataFrame, partitions: int) -> DataFrame:
    """Blocks of whole documents in ascending order of doc_id within each part."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, block, held, size = None, 0, [], 0

        def flush():
            return pd.DataFrame(
                {
                    "part": [part],
                    "block": [block],
                    "n_ids": [sum(h[1] for h in held)],
                    "payload": [b"".join(h[2] for h in held)],
                    "doc_ids": [pd.array([h[0] for h in held], dtype="Int64").to_numpy(object, na_value=None)],
                    "doc_n_ids": [[h[1] for h in held]],
                    "doc_bytes": [[len(h[2]) for h in held]],
                    "offsets": [np.concatenate([h[3] for h in held])],
                }
            )

        for batch in batches:
            for row in batch.itertuples(index=False):
                if held and (row.part != part or size >= BLOCK_BYTES):
                    yield flush()
                    block, held, size = (block + 1 if row.part == part else 0), [], 0
                part = row.part
                held.append((None if pd.isna(row.doc_id) else int(row.doc_id), row.n_ids, row.payload, row.offsets))
                size += len(row.payload)
        if held:
            yield flush()

    ordered = coded.repartition(partitions, "part").sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "n_ids", "ids_crc32")
    return ordered.mapInPandas(gather, BLOCKS)


def decode_blocks(blocks: DataFrame, lengths: np.ndarray) -> DataFrame:
    """A row for each document of the blocks, with its first id's place in the block and the crc32 of its decoded ids.

    Documents without an id and those that repeat are in the blocks as often as they were written.
    """
    lengths_b = blocks.sparkSession.sparkContext.broadcast(lengths)

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(lengths_b.value)
        for batch in batches:
            for b in batch.itertuples(index=False):
                n_ids, n_bytes = np.asarray(b.doc_n_ids, np.int64), np.asarray(b.doc_bytes, np.int64)
                runs = -(-n_ids // STRIDE)
                last = np.cumsum(runs) - 1
                sizes = np.full(int(runs.sum()), STRIDE, np.int64)
                sizes[last] = n_ids - (runs - 1) * STRIDE
                at = np.asarray(b.offsets, np.int64) + np.repeat((np.cumsum(n_bytes) - n_bytes) * 8, runs)
                ids = coder.decode(b.payload, at, sizes)
                raw, begin = memoryview(ids.astype("<u4").tobytes()), np.cumsum(n_ids) - n_ids
                yield pd.DataFrame(
                    {
                        "part": b.part,
                        "block": b.block,
                        "ord": np.arange(len(n_ids), dtype=np.int32),
                        "doc_id": pd.array([None if pd.isna(x) else int(x) for x in b.doc_ids], dtype="Int64"),
                        "local_start": begin,
                        "n_tokens": n_ids,
                        "ids_crc32": [zlib.crc32(raw[4 * s : 4 * (s + n)]) for s, n in zip(begin, n_ids, strict=True)],
                    }
                )

    return blocks.select("part", "block", "payload", "doc_ids", "doc_n_ids", "doc_bytes", "offsets").mapInPandas(decode, DECODED)


def write_ids(docs: DataFrame, path: str | None = None, end_id: int = 2, rows_per_part: int = 2000) -> tuple[DataFrame, np.ndarray]:
    """Write the ids of ``docs`` (doc_id, text; others are ignored) and return the written blocks and the code lengths.

    Files lie in the shared folder, in ascending order of (part, block). Null and empty texts are the end id alone; a
    null doc_id sorts first; rows that repeat are each written. A table without rows gives no block.
    """
    path = path or vocabulary()
    ids = written(tokenized(docs, path, end_id), "ids")
    lengths = code_lengths(id_counts(ids))
    parts = part_plan(ids, rows_per_part)
    blocks = file_blocks(encode_documents(ids, lengths, parts), int(parts.spread.sum()))
    return written(blocks, "token-ids", compression="none"), lengths


def read_ids(blocks: DataFrame, lengths: np.ndarray) -> DataFrame:
    """Per document, from the blocks alone: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    sizes = blocks.select("part", "block", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part: as many as ranges
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", "block", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("block_start"))
    starts = starts.join(parts, "part").select("part", "block", (F.col("part_start") + F.col("block_start")).alias("base"))
    return (
        decode_blocks(blocks, lengths)
        .join(starts, ["part", "block"])
        .select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
    )


def op9_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, written Huffman-coded in ascending doc_id order and read back from the files."""
    return read_ids(*write_ids(table(spark, sf_dir, "documents")))
