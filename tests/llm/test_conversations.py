"""Conversation repair against a search over lists of edits, with pieces of any size, and on odd rows."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from lectern.llm import conversations
from lectern.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code:
            row = (conv, turn, "user" if code == 4 else role, {1: "", 2: re.sub("[.!?]", "", text)}.get(code, text))
            out += [row] * (2 if code == 3 else 1)
    return out


def search(rows):
    """(cost, audit, repaired rows) of least cost, then of least audit: rows are (role, text, fault)."""
    grammar = {"": {"s", "u"}, "s": {"u"}, "u": {"a"}, "a": {"u"}}
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, last, out = heapq.heappop(heap)
        if (at, last) in seen:
            continue
        seen.add((at, last))
        if at == len(rows) and last in ("", "a"):
            return cost, audit, list(out)
        for role in ("user", "assistant"):
            if role[0] in grammar[last]:
                heapq.heappush(heap, (cost + 5, audit + "I", at, role[0], (*out, (role, ""))))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, last, out))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if role[:1] in grammar[last]:
                    heapq.heappush(heap, (cost + extra, audit + "K", at + 1, role[:1], (*out, (role, text))))
                for other in ("user", "assistant"):
                    if other[0] in grammar[last]:
                        heapq.heappush(heap, (cost + 1 + extra, audit + "R", at + 1, other[0], (*out, (other, text))))


def plain(rows, ids):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role, text))
    out = {}
    for conv in ids:
        some = sorted(by[conv])
        said, faults = set(), []
        for _, _, role, text in some:
            solid = BLANK.findall(text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in said else "" if solid[-1] in ".!?" else "truncated")
            said.add((role, text))
        turns = [t for timed, t, *_ in some if timed]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(some, some[1:], strict=False))
        cost, audit, kept = search([(r, t, f) for (_, _, r, t), f in zip(some, faults, strict=True)])
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out[conv] = ((max(turns) - min(turns) + 1 - len(set(turns))) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def random_rows(seed, n_conversations, longest):
    rng, rows = random.Random(seed), []
    roles = ["user", "assistant", "system", "tool", "", "u", None, "sa"]
    texts = ["", " \n\t", "yes.", "no", "why? ", "been here.", "é!", None, "end.\x0b", "x" * 90 + ".", "x" * 90 + "y.", " "]
    for c in range(n_conversations):
        turn = rng.choice([-3, 0, 5])
        for _ in range(rng.randint(1, longest)):
            turn += rng.choice([0, 1, 1, 1, 3])
            rows.append((c if c else None, None if rng.random() < 0.1 else turn, rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts) if rng.random() < 0.6 else f"text {rng.random()}."))
    return rows + rows[:7]


@pytest.mark.parametrize("piece_rows, piece_bytes", [(4096, 1 << 18), (1, 1 << 18), (3, 1 << 18), (50, 150)])
def test_pieces_of_any_size_give_the_cheapest_edits(spark, piece_rows, piece_bytes):
    rows = random_rows(piece_rows, 60, 14)
    want = {k: v for k, v in plain(damage(rows), {r[0] for r in rows}).items() if any(r[0] == k for r in damage(rows))}
    given = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, name string, cost int")
    pieces = conversations.repaired(conversations.damaged(given), piece_rows, piece_bytes)
    got = {(int(r["name"][1:]) if r["name"] else None): tuple(r[c] for c in COLUMNS) for r in conversations.digests(pieces).collect()}
    assert got == want


@pytest.mark.parametrize("coalesced", ["true", "false"])
def test_a_long_conversation_of_many_pieces(spark, coalesced):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)
    rows = [(7, i, random.Random(i).choice(["user", "assistant"]), f"t{i % 900}.") for i in range(3000)] + [(8, None, "user", "same.")] * 900
    want = plain([(*r[:3], r[3]) for r in rows], {7, 8})
    pieces = conversations.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 64)
    assert (pieces.filter("name = '=7'").select("part").distinct().count() > 1) == (coalesced == "false")
    assert pieces.filter("name = '=7'").count() > 40 and pieces.filter("name = '=8'").count() > 10
    got = {int(r["name"][1:]): tuple(r[c] for c in COLUMNS) for r in conversations.digests(pieces).collect()}
    assert got == want
    lines = [(r["role"], r["text"]) for r in conversations.turns(pieces).filter("name = '=7'").orderBy("part", "number", "place").collect()]
    assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines).encode()).hexdigest() == want[7][-1]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_no_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert conversations.digests(conversations.repaired(conversations.damaged(none))).count() == 0


def test_query_against_plain_search(spark, tmp_path):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(10**17 + 1, 1, "user", "kept."), (None, None, None, None), (3, None, "user", "first.")]
    dropped = next(c for c in range(10**6, 10**7) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    rows.append((dropped, 1, "user", "gone."))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op13_conversation_repair"](spark, str(tmp_path)).collect()}
    assert got == plain(damage(rows), {r[0] for r in rows})
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
