"""FLAC streams written bit by bit, apart from the encoder: what it never writes must still be read."""

import hashlib

import numpy as np
import pytest

from lectern.llm import flac

FIXED = {0: [], 1: [1], 2: [2, -1], 3: [3, -3, 1], 4: [4, -6, 4, -1]}


def crc(data, poly, width):
    register = 0
    for byte in data:
        register ^= byte << (width - 8)
        for _ in range(8):
            register = (register << 1 ^ (poly if register >> (width - 1) & 1 else 0)) & ((1 << width) - 1)
    return register


def field(value, n):
    return format(value & ((1 << n) - 1), f"0{n}b") if n else ""


def rice(value, k):
    folded = 2 * value if value >= 0 else -2 * value - 1
    return "0" * (folded >> k) + "1" + field(folded, k)


def subframe(x, width, how):
    """Bits of one subframe. ``how``: ("constant",), ("verbatim",), ("fixed", order, coding) or ("lpc", coefficients, shift, precision, coding)."""
    if how[0] == "constant":
        return "00000000" + field(x[0], width)
    if how[0] == "verbatim":
        return "00000010" + "".join(field(v, width) for v in x)
    coef, shift = (FIXED[how[1]], 0) if how[0] == "fixed" else (how[1], how[2])
    order = len(coef)
    kind = 8 + order if how[0] == "fixed" else 32 + order - 1
    out = "0" + field(kind, 6) + "0" + "".join(field(v, width) for v in x[:order])
    if how[0] == "lpc":
        out += field(how[3] - 1, 4) + field(shift, 5) + "".join(field(c, how[3]) for c in coef)
    left = [x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(coef)) >> shift) for i in range(order, len(x))]
    method, parts, params = how[-1]  # a parameter a partition; None: escaped, in plain bits
    out += field(method, 2) + field(parts, 4)
    size, at = len(x) >> parts, 0
    for p, k in enumerate(params):
        some = left[at : at + size - (order if p == 0 else 0)]
        at += len(some)
        if k is None:
            n = max((max(v, -v - 1).bit_length() + 1 for v in some), default=0)
            out += field((1 << (4 + method)) - 1, 4 + method) + field(n, 5) + "".join(field(v, n) for v in some)
        else:
            out += field(k, 4 + method) + "".join(rice(v, k) for v in some)
    return out


def stream(frames, width, seek=False):
    """A stream of (samples, how) frames, without a seek table."""
    body, total, every = b"", 0, []
    for n, (x, how) in enumerate(frames):
        head = bytes([0xFF, 0xF8, 0x70, (1 if width == 8 else 4) << 1, n]) + (len(x) - 1).to_bytes(2, "big")
        head += bytes([crc(head, 0x07, 8)])
        bits = subframe(x, width, how)
        bits += "0" * (-len(bits) % 8)
        frame = head + int(bits, 2).to_bytes(len(bits) // 8, "big")
        body += frame + crc(frame, 0x8005, 16).to_bytes(2, "big")
        total += len(x)
        every += x
    md5 = hashlib.md5(np.array(every, "<i1" if width == 8 else "<i2").tobytes()).digest()
    info = (4096 << 16 | 4096).to_bytes(4, "big") + bytes(6) + (8000 << 44 | (width - 1) << 36 | total).to_bytes(8, "big") + md5
    return b"fLaC\x80\x00\x00\x22" + info + body, every


def signal(n, width, seed):
    rng = np.random.default_rng(seed)
    top = (1 << (width - 1)) - 1
    return [int(v) for v in np.clip(np.cumsum(rng.integers(-9, 10, n)) * (1 if width == 8 else 40), -top, top)]


CODED = (0, 2, [4, 5, None, 6])
CASES = [
    ("constant", 8, ("constant",)), ("verbatim", 16, ("verbatim",)), ("fixed 0", 8, ("fixed", 0, (0, 0, [3]))), ("fixed 3", 8, ("fixed", 3, CODED)), ("fixed 4", 16, ("fixed", 4, (1, 1, [9, None]))),
    ("lpc 2", 8, ("lpc", [13, -6], 3, 6, CODED)), ("lpc 6", 16, ("lpc", [40, -20, 9, -3, 2, -1], 5, 9, (1, 2, [7, 8, 20, None]))), ("lpc 12", 8, ("lpc", [31, 1, -2, 0, 3, -1, 0, 1, 0, -1, 1, -1], 5, 7, (0, 0, [4]))),
]


@pytest.mark.parametrize("name, width, how", CASES)
def test_streams_of_other_writers_are_read(name, width, how):
    x = [5] * 64 if how[0] == "constant" else signal(64, width, len(name))
    raw, every = stream([(x, how), (signal(64, width, 9), ("verbatim",))], width)
    (samples, first), = flac.decode([raw])
    assert samples.tolist() == every and first.tolist() == [0, 64]


def test_many_streams_side_by_side():
    made = [stream([(signal(64, w, i), how if how[0] != "constant" else ("verbatim",))], w) for i, (_, w, how) in enumerate(CASES)]
    got = flac.decode([m[0] for m in made])
    assert [s.tolist() for s, _ in got] == [m[1] for m in made]


def test_broken_streams_are_told_and_leave_others_alone(spark):
    good = flac.encode([b"some text " * 300, b"x" * 64])
    wide, every = stream([(signal(64, 16, 3), ("verbatim",))], 16)
    damaged = bytearray(good[0])
    damaged[-30] ^= 4
    rows = [(1, 3000, good[0]), (2, 3000, bytes(damaged)), (3, 64, good[1]), (4, 9, b"no stream"), (5, 9, None), (6, 128, wide), (7, 3000, good[0][:-9])]
    got = {r["doc_id"]: r for r in flac.read_media(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary").coalesce(1)).collect()}
    assert {d for d, r in got.items() if r["error"]} == {2, 4, 5, 7} and got[2]["pcm"] is None and got[2]["payload_sha256"] is None
    assert bytes(got[1]["pcm"]) == b"some text " * 300 and bytes(got[3]["pcm"]) == b"x" * 64
    assert (np.frombuffer(bytes(got[6]["pcm"]), "<u2").astype(int) - 32768).tolist() == every
    assert flac.pcm_blocks(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).select("doc_id").distinct().count() == 3


def test_wide_round_trip():
    payload = np.random.default_rng(0).integers(0, 1 << 16, 3000).astype("<u2").tobytes()
    (samples, _), = flac.decode(flac.encode([payload], 16))
    assert (samples + 32768).astype("<u2").tobytes() == payload
