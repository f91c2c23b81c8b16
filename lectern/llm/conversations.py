"""Conversation structure repair: cheapest edits that make the roles of a conversation follow (system? (user assistant)+)?.

The rows of each conversation, in order of turn, are cut into pieces of bounded size; nearly every conversation is one
piece. A batch of pieces is bucketed by length and laid out time-major, a row of the array for each turn, so one step of
numpy updates the costs of all conversations of a bucket. Costs run backwards and are stored; a forward pass then traces
the edits of all conversations at once, at each place taking the least letter that keeps to the least cost.

A conversation of several pieces is solved piece by piece: the costs from each entry state to each exit state of a
piece are a small matrix; folding these backwards gives each piece the costs that follow it, and the exit state of each
entry state, folded forwards, gives it the state it is entered in. What is folded is some twenty numbers a piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import small_batches, table, written

#: Rows and text bytes of a piece at most (a longer row is a piece of its own).
PIECE_ROWS, PIECE_BYTES = 4096, 1 << 18
#: What edits cost.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States: nothing so far, after a system row, after a user row, after an assistant row. From each the role that comes
#: next is given (a first row may also be a system row that is kept); a conversation may end in the first and the last.
NEXT = np.array([2, 2, 3, 2])
ROLES = {2: "user", 3: "assistant"}
FAR = 1 << 60
ACCEPT = np.array([0, FAR, FAR, 0], np.int64)
#: A row's code is its role (0 other, 1 s, 2 u, 3 a) plus 4 times its fault (0 none, 1 blank, 2 duplicate, 3 truncated); PAD is no row.
PAD = 16
_DEL = np.array([DELETE] * PAD + [0], np.int64)
_EXTRA = np.array([0, FAR, FAR, TRUNCATED], np.int64)[np.arange(PAD) >> 2]
_REROLE = np.append(np.minimum(REROLE + _EXTRA, FAR), FAR)
_KEEP = np.full((PAD + 1, 4), FAR, np.int64)
for _code in range(PAD):
    for _state in range(4):
        if (_code & 3 == 1 and _state == 0) or (_code & 3 > 1 and NEXT[_state] == _code & 3):
            _KEEP[_code, _state] = _EXTRA[_code]
_D, _I, _K, _R = b"DIKR"

PIECES = (
    "name string, part int, number int, codes binary, roles array<string>, texts array<string>, first_turn long, last_turn long, "
    "n_turns long, blank long, duplicate long, truncated long, illegal long"
)
LINES = "array<struct<role:string,text:string>>"
COUNTS = ("blank", "duplicate", "truncated", "illegal")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with damage by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text,
    2 removes its ``.!?``, 3 repeats it, 4 makes its role user. A null id, turn, role or text counts as one space (turn stays null)."""
    blank = F.lit(" ")
    name = [F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")]
    code = F.crc32(F.encode(F.concat(name[0], F.lit(":"), name[1]), "UTF-8")) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), code.alias("code")).filter("code > 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("code") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def _ordered(conversations: DataFrame) -> DataFrame:
    """Rows with two hashes of role and text and the faults that a row has by itself, ranged and sorted by conversation, turn (null first), role, text."""
    blank = F.lit(" ")
    name = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    rows = conversations.select(name.alias("name"), F.col("turn").isNotNull().alias("timed"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), 1).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), 3).otherwise(0)
    rows = rows.select("*", *_marks(F.col("role"), F.col("text")), fault.cast("int").alias("fault"))
    # beginnings of role and text part what shares a turn, in the order of the whole; the driver samples these keys
    within = (F.substring("role", 1, 64), F.when(F.length("role") <= 64, F.substring("text", 1, 64)).otherwise(""))
    return rows.repartitionByRange("name", "timed", "turn", *within).sortWithinPartitions("name", "timed", "turn", "role", "text")


def _marks(role: Column, text: Column) -> tuple[Column, Column]:
    return F.xxhash64(role, text).alias("h1"), F.xxhash64(text, role, F.lit(13)).alias("h2")


def _piece(name: str, part: int, number: int, rows: list[tuple]) -> tuple:
    """A row of PIECES from rows (timed, turn, role, text, fault)."""
    state = np.array(["sua".find(r[2][:1]) + 1 if r[2] else 0 for r in rows], np.uint8)
    fault = np.array([r[4] for r in rows], np.uint8)
    turns = [r[1] for r in rows if r[0]]
    spoken = [r for r in rows if r[4] in (0, 3)]
    return (
        name, part, number, (state | (fault << 2)).tobytes(), [r[2] for r in spoken], [r[3] for r in spoken],
        turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)),
        int((fault == 1).sum()), int((fault == 2).sum()), int((fault == 3).sum()), _illegal(state),
    )


def _illegal(s: np.ndarray) -> int:
    """Adjacent roles other than su, ua, au."""
    a, b = s[:-1], s[1:]
    return int(len(a) - (((a == 1) & (b == 2)) | ((a == 2) & (b == 3)) | ((a == 3) & (b == 2))).sum())


def _frame(pieces: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(pieces, columns=[c.split()[0] for c in PIECES.split(", ")], dtype=object)
    return out.assign(**{c: pd.array(out[c].tolist(), "Int64") for c in ("first_turn", "last_turn")})


def _cutter(piece_rows: int, piece_bytes: int):
    """Cuts sorted rows into pieces, as they stream through a task, and tells duplicates among a conversation's rows in the task."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, held, volume, name, seen = TaskContext.get().partitionId(), 0, [], 0, None, set()
        for batch in batches:
            made = []
            for own, timed, turn, role, text, h1, h2, fault in batch.itertuples(index=False, name=None):
                if held and (own != name or len(held) >= piece_rows or volume + len(text) > piece_bytes):
                    made.append(_piece(name, part, number, held))
                    number, held, volume = number + 1, [], 0
                if own != name:
                    name, seen = own, set()
                if fault != 1 and (h1, h2) in seen:
                    fault = 2
                seen.add((h1, h2))
                held.append((timed, turn, role, text, fault))
                volume += len(text)
            yield _frame(made)
        if held:
            yield _frame([_piece(name, part, number, held)])

    return cut


def _again_elsewhere(long: DataFrame) -> DataFrame:
    """``long`` pieces, with rows that an earlier part of their conversation has marked as duplicates, too: a part knows its own only."""
    key = ("name", "part", "number")
    said = long.select(*key, F.posexplode(F.arrays_zip("roles", "texts")).alias("place", "r")).select(*key, "place", *_marks(F.col("r.roles"), F.col("r.texts")))
    first = said.groupBy("name", "h1", "h2").agg(F.min("part").alias("first"), F.max("part").alias("last")).filter("first < last").drop("last")
    places = said.join(first, ["name", "h1", "h2"]).filter("part > first").groupBy(*key).agg(F.collect_list("place").alias("again"))

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                codes, again = np.frombuffer(r.codes, np.uint8).copy(), np.array(r.again if r.again is not None else [], np.int64)
                spoken = np.flatnonzero(~np.isin(codes >> 2, (1, 2)))
                cut = int((codes[spoken[again]] >> 2 == 3).sum())
                codes[spoken[again]] = (codes[spoken[again]] & 3) | 8
                stay = np.setdiff1d(np.arange(len(spoken)), again)
                rows.append((r.name, r.part, r.number, codes.tobytes(), [r.roles[k] for k in stay], [r.texts[k] for k in stay], int(r.first_turn) if r.first_turn else None, int(r.last_turn) if r.last_turn else None, r.n_turns, r.blank, r.duplicate + len(again), r.truncated - cut, r.illegal))
            yield _frame(rows)

    turns = {c: F.col(c).cast("string") for c in ("first_turn", "last_turn")}  # text keeps nulls and large numbers apart in pandas
    return long.join(places, [*key], "left").withColumns(turns).mapInPandas(mark, PIECES)


def pieces_of(conversations: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """Pieces of all conversations (see PIECES); those of a conversation come in order of part and number."""
    small_batches(conversations.sparkSession)
    rows = _ordered(conversations)
    return written(rows.mapInPandas(_cutter(piece_rows, piece_bytes), PIECES), "conversation-pieces")


def _closed(costs: np.ndarray) -> np.ndarray:
    """Costs of (conversation, state) when rows may also be inserted first; two reach every state that can be."""
    for _ in range(2):
        costs = np.minimum(costs, costs[:, NEXT] + INSERT)
    return np.minimum(costs, FAR)


def backward(codes: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Least costs (turn, conversation, state) from each turn on, of ``codes`` (turn, conversation), with ``after`` (conversation, state) at the end."""
    costs = np.empty((len(codes) + 1, *after.shape), np.int64)
    costs[-1] = _closed(after)
    for t in range(len(codes) - 1, -1, -1):
        code, then = codes[t], costs[t + 1]
        via = then[:, NEXT]
        kept = np.where((code & 3 == 1)[:, None], then[:, [1]], via) + _KEEP[code]
        costs[t] = _closed(np.minimum(np.minimum(then + _DEL[code][:, None], via + _REROLE[code][:, None]), kept))
    return costs


def forward(codes: np.ndarray, costs: np.ndarray, after: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letters, exit states) of the cheapest edits from ``state`` on, ASCII-least: letters (conversation, place), 0 where there is none."""
    n_turns, each = len(codes), np.arange(codes.shape[1])
    letters = np.zeros((codes.shape[1], 3 * n_turns + 2), np.uint8)
    for t in range(n_turns):
        code, now, then = codes[t], costs[t], costs[t + 1]
        for k in range(2):
            more = (now[each, state] != _DEL[code] + then[each, state]) & (now[each, state] == INSERT + now[each, NEXT[state]])
            letters[more, 3 * t + k] = _I
            state = np.where(more, NEXT[state], state)
        drop = now[each, state] == _DEL[code] + then[each, state]
        to = np.where(code & 3 == 1, 1, NEXT[state])
        keep = ~drop & (now[each, state] == _KEEP[code, state] + then[each, to])
        letters[:, 3 * t + 2] = np.where(code == PAD, 0, np.where(drop, _D, np.where(keep, _K, _R)))
        state = np.where(drop, state, np.where(keep, to, NEXT[state]))
    for k in range(2):
        more = costs[-1][each, state] != after[each, state]
        letters[more, 3 * n_turns + k] = _I
        state = np.where(more, NEXT[state], state)
    return letters, state


def solved(codes: list[bytes], after: np.ndarray, entry: np.ndarray | None) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Of each conversation (costs at its start by state, audit, exit state), bucketed by length; without ``entry`` the costs alone."""
    sizes = np.array([len(c) for c in codes], np.int64)
    start, out, audits = np.zeros(after.shape, np.int64), np.zeros(len(codes), np.int64), [b""] * len(codes)
    bucket = np.array([int(n).bit_length() for n in sizes])
    for b in np.unique(bucket):
        mine = np.flatnonzero(bucket == b)
        laid = np.full((int(sizes[mine].max()), len(mine)), PAD, np.uint8)
        for j, i in enumerate(mine):
            laid[: sizes[i], j] = np.frombuffer(codes[i], np.uint8)
        costs = backward(laid, after[mine])
        start[mine] = costs[0]
        if entry is not None:
            letters, out[mine] = forward(laid, costs, after[mine], entry[mine])
            for j, i in enumerate(mine):
                audits[i] = letters[j][letters[j] > 0].tobytes()
    return start, audits, out


def _lines(audit: bytes, codes: bytes, roles, texts, state: int) -> list[tuple[str, str]]:
    """The repaired rows of a piece."""
    out, at, spoken = [], 0, 0
    for letter in audit:
        if letter == _I:
            state = int(NEXT[state])
            out.append((ROLES[state], ""))
            continue
        code, at = codes[at], at + 1
        if code >> 2 in (0, 3):
            role, text, spoken = roles[spoken], texts[spoken], spoken + 1
            if letter != _D:
                state = 1 if letter == _K and code & 3 == 1 else int(NEXT[state])
                out.append((role if letter == _K else ROLES[state], text))
    return out


def _stacked(values: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.int64) for v in values]) if len(values) else np.zeros((0, 4), np.int64)


def _matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Costs from entry to exit states of each piece: 4 numbers for each exit state."""
    for batch in batches:
        codes = batch.pop("codes").tolist()
        by_exit = [solved(codes, np.tile(np.where(np.arange(4) == k, 0, FAR), (len(codes), 1)), None)[0] for k in range(4)]
        batch["matrix"] = list(np.stack(by_exit, 1).reshape(-1, 16)) if codes else []
        yield batch


def _folded_back(pieces: pd.DataFrame) -> pd.DataFrame:
    """To each piece of a conversation the costs that follow it."""
    pieces = pieces.sort_values(["part", "number"], ascending=False)
    after, rows = ACCEPT, []
    for matrix in pieces.pop("matrix"):
        rows.append(after)
        after = np.minimum((np.asarray(matrix).reshape(4, 4) + _closed(after[None])[0][:, None]).min(0), FAR)
    # within a conversation the costs that follow are those with inserts before the next piece; only at the end are there none
    pieces["after"] = [r if k == 0 else _closed(r[None])[0] for k, r in enumerate(rows)]
    return pieces


def _exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        codes, after = batch.pop("codes").tolist(), _stacked(batch.pop("after"))
        by_entry = [solved(codes, after, np.full(len(codes), k))[2] for k in range(4)]
        batch["exits"] = list(np.stack(by_entry, 1)) if codes else []
        yield batch


def _folded_on(pieces: pd.DataFrame) -> pd.DataFrame:
    """To each piece of a conversation the state that it is entered in."""
    pieces, state, entries = pieces.sort_values(["part", "number"]), 0, []
    for exits in pieces.pop("exits"):
        entries.append(state)
        state = int(exits[state])
    pieces["entry"] = entries
    return pieces


def repaired(conversations: DataFrame, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The repaired conversations, in pieces: name, part, number, whole, first_turn, last_turn, n_turns, blank, duplicate, truncated, illegal, head, tail, cost, audit, lines.

    ``conversations`` has conv_id, turn, role, text (others are ignored). Rows of a conversation count by turn, null
    first, then by role and text; null roles and texts are one space, null ids a conversation of their own. ``lines``
    are the repaired rows (role, text), ``audit`` an initial for each edit: of all cheapest lists of edits the ASCII-least.
    ``name`` is "=" and the id as text, "" for null. A conversation of one piece is ``whole``; pieces of others follow one
    another by part and number, and ``cost`` is what it costs from the piece on. ``head`` and ``tail`` are the first and
    last rows' codes, so that faults between pieces can be counted. An empty table has no pieces.
    """
    pieces = pieces_of(conversations, piece_rows, piece_bytes)
    many = written(pieces.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("name"), "long-conversations")
    long = written(_again_elsewhere(pieces.join(many, "name", "left_semi")), "long-pieces")
    key = ("name", "part", "number")
    costs = long.select(*key, "codes").mapInPandas(_matrices, "name string, part int, number int, matrix array<long>")
    after = written(costs.groupBy("name").applyInPandas(_folded_back, "name string, part int, number int, after array<long>"), "costs-after")
    exits = long.select(*key, "codes").join(after, [*key]).mapInPandas(_exits, "name string, part int, number int, exits array<int>")
    entry = exits.groupBy("name").applyInPandas(_folded_on, "name string, part int, number int, entry int")
    whole = pieces.join(many, "name", "left_anti").select("*", F.array(*[F.lit(int(x)) for x in ACCEPT]).cast("array<long>").alias("after"), F.lit(0).alias("entry"), F.lit(True).alias("whole"))
    rows = whole.unionByName(long.join(after, [*key]).join(entry, [*key]).withColumn("whole", F.lit(False)))
    fields = ("name", "part", "number", "whole", "first_turn", "last_turn", "n_turns", *COUNTS)

    def edit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes, entry = batch["codes"].tolist(), batch["entry"].to_numpy(np.int64)
            start, audits, _ = solved(codes, _stacked(batch["after"]), entry)
            out = batch[list(fields)].copy()
            out["head"], out["tail"] = [c[0] & 3 for c in codes], [c[-1] & 3 for c in codes]
            out["cost"] = start[np.arange(len(codes)), entry] if len(codes) else []
            out["audit"] = [a.decode() for a in audits]
            out["lines"] = [_lines(*x) for x in zip(audits, codes, batch["roles"], batch["texts"], entry.tolist(), strict=True)]
            yield out

    turns = [F.col(c).cast("string").alias(c) if c in ("first_turn", "last_turn") else F.col(c) for c in fields]
    rows = rows.select(*turns, "codes", "roles", "texts", "after", "entry")
    schema = "name string, part int, number int, whole boolean, first_turn string, last_turn string, n_turns long, blank long, duplicate long, truncated long, illegal long, head int, tail int, cost long, audit string, lines " + LINES
    out = rows.mapInPandas(edit, schema)
    return out.withColumns({c: F.col(c).cast("long") for c in ("first_turn", "last_turn")})


def turns(pieces: DataFrame) -> DataFrame:
    """The repaired rows themselves: name, part, number, place (their order within a conversation), role, text."""
    return pieces.select("name", "part", "number", F.posexplode("lines").alias("place", "line")).select("name", "part", "number", "place", "line.role", "line.text")


def _text(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")


def digests(pieces: DataFrame) -> DataFrame:
    """Per conversation: name, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Pieces of one conversation are read in order and hashed as they come; of what is held, only the audit grows with it.
    """
    schema = "name string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0))
    whole = pieces.filter("whole").select("name", gaps.alias("gaps"), *COUNTS, "cost", "audit", F.sha2(F.encode(_text(F.col("lines")), "UTF-8"), 256).alias("repaired_sha256"))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, held, now = [c.split()[0] for c in schema.split(", ")], None, {}

        def done():
            spread = now["last"] - now["first"] + 1 - now["turns"] if now["turns"] else 0
            return (held, spread, *[now[c] for c in COUNTS], now["cost"], "".join(now["audit"]), now["hash"].hexdigest())

        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.name != held:
                    if held is not None:
                        out.append(done())
                    held, now = r.name, {"hash": hashlib.sha256(), "lines": False, "turns": 0, "cost": r.cost, "audit": [], "tail": None, **dict.fromkeys(COUNTS, 0)}
                for c in COUNTS:
                    now[c] += getattr(r, c)
                if now["tail"] is not None:
                    now["illegal"] += _illegal(np.array([now["tail"], r.head]))
                if r.first_turn is not None:
                    first, last = int(r.first_turn), int(r.last_turn)
                    same = bool(now["turns"]) and now["last"] == first
                    now |= {"first": now["first"] if now["turns"] else first, "last": last, "turns": now["turns"] + r.n_turns - same}
                if r.n_lines:
                    now["hash"].update(b"\n" * now["lines"] + r.text.encode("utf-8", "replace"))
                now |= {"lines": now["lines"] or r.n_lines > 0, "tail": r.tail}
                now["audit"].append(r.audit)
            yield pd.DataFrame(out, columns=columns)
        if held is not None:
            yield pd.DataFrame([done()], columns=columns)

    turn = [F.col(c).cast("string").alias(c) for c in ("first_turn", "last_turn")]
    long = pieces.filter("not whole").select("name", "part", "number", *turn, "n_turns", *COUNTS, "head", "tail", "cost", "audit", F.size("lines").alias("n_lines"), _text(F.col("lines")).alias("text"))
    return whole.unionByName(long.repartition("name").sortWithinPartitions("name", "part", "number").mapInPandas(fold, schema))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    given = table(spark, sf_dir, "conversations")
    name = F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    rows = given.select("conv_id").distinct().withColumn("name", name)
    rows = rows.join(digests(written(repaired(damaged(given)), "repaired-pieces")), "name", "left")
    none = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *COUNTS, "cost")]
    return rows.select("conv_id", *none, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
