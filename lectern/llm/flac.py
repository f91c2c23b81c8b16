"""Media columns: FLAC (mono, 8 or 16 bits) written and read in numpy, all frames of a batch side by side.

Reading decodes Rice residuals and linear predictors (constant, verbatim, fixed, LPC), verifies each frame's CRC-8 and
CRC-16 and the stream's MD5, and gives PCM in blocks with their sample offsets. Frames are found by a seek table that
names each of them, else by sync code and header checksum.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bits
from lectern.llm.common import table
from lectern.llm.words import rounds

BLOCK = 1024
ORDER = 4
PRECISION = 12
#: Payload bytes coded, and stream bytes read, in one round: the first fits a cache, the second keeps many frames side by side.
CODE_BYTES, ROUND_BYTES = 600_000, 3_000_000
#: Payloads are padded with zeros to a positive multiple of this.
UNIT = 64

# Fixed values of the format: predictor coefficients by order, CRC polynomials, rate and block size codes.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
CRC8, CRC16 = 0x07, 0x8005
RATE_8000, SIZE_CODE = 4, {8: 1, 16: 4}
SIZES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, **{k: 1 << k for k in range(8, 16)}}

MEDIA = "doc_id long, n_bytes long, payload_bytes long, media binary"
READ = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, pcm binary, block_at array<long>, error string"
)


def _crc_table(poly: int, width: int, n_bytes: int) -> np.ndarray:
    """The register after each value of ``n_bytes`` bytes, from an empty register."""
    crc = np.arange(1 << (8 * n_bytes), dtype=np.int64) << (width - 8 * n_bytes)
    top, mask = 1 << (width - 1), (1 << width) - 1
    for _ in range(8 * n_bytes):
        crc = np.where(crc & top, (crc << 1) ^ poly, crc << 1) & mask
    return crc


_CRC8, _CRC16 = _crc_table(CRC8, 8, 1), _crc_table(CRC16, 16, 2)


def crc8(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(begin), np.int64)
    for i in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > i)
        crc[live] = _CRC8[crc[live] ^ data[begin[live] + i]]
    return crc


def crc16(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-16 of many stretches, two bytes a step. Leading zeros don't change an empty register, so odd ones begin with one."""
    padded = np.concatenate([np.zeros(1, np.uint8), data, np.zeros(1, np.uint8)]).astype(np.int64)
    pairs = (padded[:-1] << 8) | padded[1:]  # pairs[i]: bytes i - 1 and i of data
    order = np.argsort(-size, kind="stable")
    start, steps = begin[order] + 1 - size[order] % 2, (size[order] + 1) // 2
    first = pairs[start] & np.where(size[order] % 2, 0xFF, 0xFFFF)
    crc = np.where(steps > 0, _CRC16[first], 0)
    live = np.searchsorted(-steps, -np.arange(2, int(steps.max(initial=1)) + 1), side="right")
    for i, n in enumerate(live, 1):
        crc[:n] = _CRC16[crc[:n] ^ pairs[start[:n] + 2 * i]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _utf8(n: int) -> bytes:
    """A frame number as the header codes it: like UTF-8, to 36 bits."""
    if n < 0x80:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    tail = [0x80 | (n >> (6 * k) & 0x3F) for k in range(size - 2, -1, -1)]
    return bytes([(0xFF00 >> size) & 0xFF | n >> (6 * (size - 1)), *tail])


def _predictors(x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantised LPC coefficients [frame, ORDER] and shift by Levinson-Durbin on each frame, and whether they are usable."""
    f = x.astype(np.float64)
    r = np.stack([np.einsum("ij,ij->i", f[:, : f.shape[1] - k], f[:, k:]) for k in range(ORDER + 1)], 1)
    a, error = np.zeros((len(x), ORDER)), r[:, 0] * (1 + 1e-9) + 1e-9
    for i in range(ORDER):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / error
        flip = a[:, :i][:, ::-1].copy()
        a[:, :i] -= k[:, None] * flip
        a[:, i] = k
        error = np.maximum(error * (1 - k * k), 1e-9)
    top = np.maximum(np.abs(a).max(1), 1e-9)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(top)).astype(np.int64), 0, 15)
    coef = np.rint(a * (1 << shift)[:, None]).astype(np.int32)
    return coef, shift, (np.abs(coef).max(1) < 1 << (PRECISION - 1)) & (size > 2 * ORDER)


def _rice(zz: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The best Rice parameter for each row of folded residuals, of which ``n`` count and the others are 0."""
    best, best_k, folded = None, np.zeros(len(zz), np.int64), zz.copy()
    for k in range(15):
        cost = n * (k + 1) + folded.sum(1, dtype=np.int64)
        if best is not None:
            better = cost < best
            best_k[better] = k
            if not better.any() and k > 4:
                break
            best = np.minimum(cost, best)
        else:
            best = cost
        folded >>= 1
    return best_k


def encode(payloads: list[bytes], width: int = 8) -> list[bytes]:
    """A FLAC stream of each payload: ``width``-bit samples at 8 kHz, each byte (or little-endian pair) offset to signed.

    Each frame takes the predictor of least total residual: fixed of order 0 to 2 or LPC of order ORDER.
    """
    kind = np.uint8 if width == 8 else np.dtype("<u2")
    samples = [np.frombuffer(p, kind).astype(np.int32) - (1 << (width - 1)) for p in payloads]
    lengths = np.array([len(s) for s in samples], np.int64)
    frames = -(-lengths // BLOCK)
    doc = np.repeat(np.arange(len(samples)), frames)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(frames) - frames, frames)
    size = np.minimum(lengths[doc] - number * BLOCK, BLOCK)
    column = np.arange(BLOCK)
    valid = column < size[:, None]
    x = np.zeros((len(doc), BLOCK), np.int32)
    if len(doc):
        x[valid] = np.concatenate(samples)
    short = np.flatnonzero(size < BLOCK)
    # residuals of each predictor; the first samples (warm-up) don't count
    coef, shift, usable = _predictors(x, size)
    order, residual, cost = np.zeros(len(doc), np.int64), x.copy(), None
    lpc = np.zeros(len(doc), bool)
    for o, c in [*((k, FIXED[k]) for k in range(3)), (ORDER, None)]:
        left = x.copy()
        if o:
            guess = (coef[:, :1] if c is None else c[0]) * x[:, o - 1 : BLOCK - 1]
            for j in range(1, o):
                guess += (coef[:, j, None] if c is None else c[j]) * x[:, o - 1 - j : BLOCK - 1 - j]
            if c is None:
                guess >>= shift[:, None].astype(np.int32)
            left[:, o:] -= guess
            left[:, :o] = 0
            left[short] *= valid[short]
        total = np.abs(left).sum(1, dtype=np.int64) + (128 if c is None else 0)
        better = (total < cost) & (size > o) if cost is not None else np.ones(len(doc), bool)
        if c is None:
            better &= usable
        cost = total if cost is None else np.where(better, total, cost)
        order[better], lpc[better] = o, c is None
        residual[better] = left[better]
    coded = valid & (column >= order[:, None])
    zz = (residual << 1) ^ (residual >> 31)
    # four Rice partitions in full frames, one in others
    parted = np.where(size == BLOCK, 2, 0)
    quarter = BLOCK // 4
    k = np.zeros((len(doc), 4), np.int64)
    k[short] = _rice(zz[short], size[short] - order[short])[:, None]
    full = np.flatnonzero(size == BLOCK)
    counts = np.full((len(full), 4), quarter) - np.outer(order[full], [1, 0, 0, 0])
    k[full] = _rice(zz[full].reshape(-1, quarter), counts.ravel()).reshape(-1, 4)
    k_at = np.repeat(k.astype(np.int32), quarter, 1)
    starts = coded & (column == order[:, None])
    starts[full, quarter::quarter] = True
    code_bits = ((zz >> k_at) + 1 + k_at) * coded
    code_bits[starts] += 4

    heads = []
    for n, s in zip(number.tolist(), size.tolist(), strict=True):
        full = s == BLOCK
        head = bytes([0xFF, 0xF8, (10 if full else 7) << 4 | RATE_8000, SIZE_CODE[width] << 1]) + _utf8(n)
        heads.append(head if full else head + (s - 1).to_bytes(2, "big"))
    head_size = np.array([len(h) for h in heads], np.int64)
    head_bytes = np.frombuffer(b"".join(heads), np.uint8)
    head_at = np.cumsum(head_size) - head_size
    head_crc = crc8(head_bytes, head_at, head_size)
    fixed_bits = 8 + order * width + np.where(lpc, 4 + 5 + ORDER * PRECISION, 0) + 6
    body_bits = fixed_bits + code_bits.sum(1, dtype=np.int64)
    frame_bytes = head_size + 1 + (body_bits + 7) // 8 + 2
    begin = np.cumsum(frame_bytes) - frame_bytes

    at, values, widths = [], [], []

    def put(where, value, bits_):
        where, value = np.asarray(where, np.int64), np.broadcast_to(np.asarray(value, np.int64), np.shape(where))
        at.append(where)
        values.append(value)
        widths.append(np.broadcast_to(np.asarray(bits_, np.int64), where.shape))

    put(np.repeat(begin - head_at, head_size) * 8 + np.arange(len(head_bytes)) * 8, head_bytes, 8)
    cursor = (begin + head_size) * 8
    put(cursor, head_crc, 8)
    put(cursor + 8, np.where(lpc, 32 + order - 1, 8 + order) << 1, 8)
    cursor = cursor + 16
    for j in range(ORDER):
        some = np.flatnonzero(order > j)
        put(cursor[some] + j * width, x[some, j] & ((1 << width) - 1), width)
    cursor = cursor + order * width
    some = np.flatnonzero(lpc)
    put(cursor[some], PRECISION - 1, 4)
    put(cursor[some] + 4, shift[some], 5)
    for j in range(ORDER):
        put(cursor[some] + 9 + j * PRECISION, coef[some, j] & ((1 << PRECISION) - 1), PRECISION)
    cursor = cursor + np.where(lpc, 9 + ORDER * PRECISION, 0)
    put(cursor, parted, 6)  # two bits of method 0, then the partition order
    cursor = cursor + 6
    length, low, folded = code_bits[coded], k_at[coded], zz[coded]
    per_frame = size - order
    ends = np.cumsum(length, dtype=np.int64)
    ends += np.repeat(cursor - (np.cumsum(per_frame) > 0) * np.concatenate([[0], ends])[np.cumsum(per_frame) - per_frame], per_frame)
    opening = starts[coded]
    put((ends - length)[opening], low[opening], 4)
    one = np.int32(1) << low
    put(ends - low - 1, one | (folded & (one - 1)), low + 1)
    places = np.concatenate(at)
    packed = bits.pack_at(int(frame_bytes.sum()) * 8, places, np.concatenate(values), np.concatenate(widths))
    check = crc16(packed, begin, frame_bytes - 2)
    packed[begin + frame_bytes - 2], packed[begin + frame_bytes - 1] = check >> 8, check & 0xFF
    raw = packed.tobytes()

    out, f = [], 0
    for d, s in enumerate(samples):
        n = int(frames[d])
        sizes = frame_bytes[f : f + n]
        total = int(sizes.sum())
        first = int(begin[f]) if n else 0
        info = (BLOCK << 16 | BLOCK).to_bytes(4, "big") + int(sizes.min(initial=1 << 24) if n else 0).to_bytes(3, "big") + int(sizes.max(initial=0)).to_bytes(3, "big")
        info += (8000 << 44 | (width - 1) << 36 | len(s)).to_bytes(8, "big") + hashlib.md5(s.astype("<i1" if width == 8 else "<i2").tobytes()).digest()
        if 18 * n >= 1 << 24:
            raise ValueError(f"{18 * n} bytes of seek points are more than a stream can name; store this payload in parts")
        seek = np.zeros(n, [("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")])
        seek["sample"], seek["offset"], seek["count"] = np.arange(n) * BLOCK, begin[f : f + n] - first, size[f : f + n]
        points = seek.tobytes()
        out.append(b"fLaC\x00\x00\x00\x22" + info + b"\x83" + len(points).to_bytes(3, "big") + points + raw[first : first + total])
        f += n
    return out


class Corrupt(ValueError):
    """A stream that breaks the format or fails a checksum."""


def _metadata(stream: bytes) -> dict:
    if stream[:4] != b"fLaC":
        raise Corrupt("no FLAC stream")
    at, out = 4, {"seek": None}
    while True:
        kind, size = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind & 0x7F == 0:
            packed = int.from_bytes(body[10:18], "big")
            out |= {"channels": (packed >> 41 & 7) + 1, "width": (packed >> 36 & 31) + 1, "total": packed & ((1 << 36) - 1), "md5": body[18:34], "block": int.from_bytes(body[2:4], "big")}
        elif kind & 0x7F == 3:
            out["seek"] = np.frombuffer(body, [("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")])
        at += 4 + size
        if kind & 0x80:
            break
    if out.get("channels") != 1 or out.get("width") not in SIZE_CODE:
        raise Corrupt("only mono streams of 8 or 16 bits are read")
    return out | {"frames": at}


def _frame_offsets(stream: bytes, meta: dict) -> np.ndarray:
    """Byte offsets of all frames: from a seek table that covers all samples, else by sync code and header checksum."""
    seek = meta["seek"]
    if seek is not None and len(seek) and int(seek["count"].astype(np.int64).sum()) == meta["total"]:
        return seek["offset"].astype(np.int64) + meta["frames"]
    if not meta["total"]:
        return np.zeros(0, np.int64)
    data = np.frombuffer(stream, np.uint8)
    maybe = meta["frames"] + np.flatnonzero((data[meta["frames"] : -1] == 0xFF) & (data[meta["frames"] + 1 :] == 0xF8))
    found, samples = [], 0
    for at in maybe.tolist():
        try:
            size, head = _header(stream, at)
        except (Corrupt, IndexError):
            continue
        if samples < meta["total"]:
            found.append(at)
            samples += size
    return np.array(found, np.int64)


def _header(stream: bytes, at: int) -> tuple[int, int]:
    """(samples, header bytes with CRC-8) of the frame at ``at``."""
    if stream[at] != 0xFF or stream[at + 1] & 0xFE != 0xF8:
        raise Corrupt("no sync code")
    code, rate = stream[at + 2] >> 4, stream[at + 2] & 15
    lead = stream[at + 4]
    pos = at + 4 + (1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length())
    if code == 6:
        size, pos = stream[pos] + 1, pos + 1
    elif code == 7:
        size, pos = int.from_bytes(stream[pos : pos + 2], "big") + 1, pos + 2
    elif code in SIZES:
        size = SIZES[code]
    else:
        raise Corrupt("block size")
    pos += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    head = np.frombuffer(stream[at : pos + 1], np.uint8)
    if crc8(head, np.array([0]), np.array([len(head)]))[0] != 0:
        raise Corrupt("header checksum")
    return size, pos + 1 - at


_LEADING = np.array([16 - int(v).bit_length() for v in range(1 << 16)], np.int64)


def decode(streams: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(samples, first sample of each frame) of each stream; raises ``Corrupt`` where a checksum fails."""
    metas = [_metadata(s) for s in streams]
    offsets = [_frame_offsets(s, m) for s, m in zip(streams, metas, strict=True)]
    base = np.cumsum([0] + [len(s) for s in streams])
    counts = np.array([len(o) for o in offsets], np.int64)
    doc = np.repeat(np.arange(len(streams)), counts)
    begin = np.concatenate([o + b for o, b in zip(offsets, base, strict=False)]) if len(doc) else np.zeros(0, np.int64)
    ends = np.concatenate([np.append(o[1:] + b, e) for o, b, e in zip(offsets, base, base[1:], strict=False) if len(o)]) if len(doc) else begin
    data = np.frombuffer(b"".join(streams), np.uint8)
    if (crc16(data, begin, ends - begin) != 0).any():  # over a frame and its checksum the register ends empty
        raise Corrupt("frame checksum")
    heads = [_header_fast(data, begin)] if len(doc) else [(np.zeros(0, np.int64),) * 2]
    size, head = heads[0]
    width = np.array([m["width"] for m in metas], np.int64)[doc] if len(doc) else size
    rows = np.argsort(-size, kind="stable")
    out = np.zeros((int(size.max(initial=0)), len(doc)), np.int64)
    _subframes(data, (begin + head)[rows], size[rows], width[rows], out)
    by_frame = np.empty((len(doc), out.shape[0]), np.int64)
    by_frame[rows] = out.T
    result, f = [], 0
    for d, m in enumerate(metas):
        n = int(counts[d])
        sizes = size[f : f + n]
        samples = by_frame[f : f + n][np.arange(out.shape[0]) < sizes[:, None]] if n else np.zeros(0, np.int64)
        f += n
        if len(samples) != m["total"] or hashlib.md5(samples.astype("<i1" if m["width"] == 8 else "<i2").tobytes()).digest() != m["md5"]:
            raise Corrupt("stream checksum")
        result.append((samples, np.cumsum(sizes) - sizes))
    return result


def _header_fast(data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_header`` for many frames: sizes and header bytes, with all CRC-8 verified."""
    if ((data[begin] != 0xFF) | (data[begin + 1] & 0xFE != 0xF8)).any():
        raise Corrupt("no sync code")
    code, rate, lead = data[begin + 2].astype(np.int64) >> 4, data[begin + 2].astype(np.int64) & 15, data[begin + 4].astype(np.int64)
    n = np.where(lead < 0x80, 1, 8 - np.array([int(v).bit_length() for v in range(256)])[lead ^ 0xFF])
    pos = begin + 4 + n
    size = np.array([SIZES.get(c, 0) for c in range(16)], np.int64)[code]
    size = np.where(code == 6, data[np.minimum(pos, len(data) - 1)].astype(np.int64) + 1, size)
    two = (data[np.minimum(pos, len(data) - 1)].astype(np.int64) << 8) + data[np.minimum(pos + 1, len(data) - 1)]
    size = np.where(code == 7, two + 1, size)
    pos = pos + np.select([code == 6, code == 7], [1, 2], 0) + np.select([rate == 12, (rate == 13) | (rate == 14)], [1, 2], 0)
    if (size == 0).any() or (crc8(data, begin, pos + 1 - begin) != 0).any():
        raise Corrupt("header checksum")
    return size, pos + 1 - begin


def _subframes(data: np.ndarray, begin: np.ndarray, size: np.ndarray, width: np.ndarray, out: np.ndarray) -> None:
    """Decode one subframe a column into ``out`` [sample, frame]; ``size`` descends."""
    n = len(begin)
    if not n:
        return
    wins = bits.windows(data)
    at = begin * 8

    def take(lanes: np.ndarray, count) -> np.ndarray:
        got = (bits.peek(wins, at[lanes]) >> np.uint64(1)) >> (63 - np.broadcast_to(np.asarray(count), lanes.shape)).astype(np.uint64)
        at[lanes] += count
        return got.astype(np.int64)

    def signed(v: np.ndarray, w) -> np.ndarray:
        return v - ((v >> (w - 1)) << w)

    every = np.arange(n)
    kind = take(every, 8)
    if (kind & 0x81).any():
        raise Corrupt("padding or wasted bits")
    kind = kind >> 1
    lpc, fixed = kind >= 32, (kind >= 8) & (kind < 16)
    order = np.where(lpc, kind - 31, np.where(fixed, kind - 8, 0))
    flat, plain = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    if (~(lpc | fixed | (kind < 2)) | (fixed & (order > 4))).any():
        raise Corrupt("subframe type")
    most = int(order.max(initial=0))
    for j in range(most):
        lanes = np.flatnonzero(order > j)
        out[j, lanes] = signed(take(lanes, width[lanes]), width[lanes])
    coef, shift = np.zeros((most, n), np.int64), np.zeros(n, np.int64)
    lanes = np.flatnonzero(lpc)
    precision = np.zeros(n, np.int64)
    precision[lanes] = take(lanes, 4) + 1
    shift[lanes] = take(lanes, 5)
    for j in range(most):
        some = lanes[order[lanes] > j]
        coef[j, some] = signed(take(some, precision[some]), precision[some])
        for o in range(j + 1, 5):
            coef[j, fixed & (order == o)] = FIXED[o][j]
    if len(flat):
        out[:, flat] = np.where(np.arange(len(out))[:, None] < size[flat], signed(take(flat, width[flat]), width[flat]), 0)
    for i in range(int(size[plain].max(initial=0)) if len(plain) else 0):
        some = plain[size[plain] > i]
        out[i, some] = signed(take(some, width[some]), width[some])
    coded = lpc | fixed
    lanes = np.flatnonzero(coded)
    method, parts = np.zeros(n, np.int64), np.zeros(n, np.int64)
    method[lanes], parts[lanes] = take(lanes, 2), take(lanes, 4)
    if (method > 1).any():
        raise Corrupt("residual coding")
    partition = size >> parts
    param_bits = 4 + method
    k, raw, after = np.zeros(n, np.int64), np.full(n, -1, np.int64), order.copy()  # after: where the next partition begins
    live = np.searchsorted(-size, -np.arange(1, int(size[0]) + 1), side="right")
    some_raw, all_coded = False, bool(coded.all())
    for i, m in enumerate(live.tolist()):
        now = slice(0, m) if all_coded and i >= most else np.flatnonzero(coded[:m] & (order[:m] <= i))
        if not isinstance(now, slice) and not len(now):
            continue
        opens = after[now] == i
        if opens.any():
            new = np.arange(m)[now][opens]
            k[new] = take(new, param_bits[new])
            escaped = k[new] == np.where(param_bits[new] == 4, 15, 31)
            raw[new] = -1
            if escaped.any():
                raw[new[escaped]], some_raw = take(new[escaped], 5), True
            after[new] = (i // partition[new] + 1) * partition[new]
        spot, param = at[now], k[now]
        win = bits.peek(wins, spot)
        zeros = _LEADING[win >> np.uint64(48)]
        if (zeros == 16).any():
            deep = np.flatnonzero(zeros == 16)
            where = spot[deep]
            while len(deep):
                where = where + 16
                more = _LEADING[bits.peek(wins, where) >> np.uint64(48)]
                zeros[deep] += more
                if (where > len(data) * 8).any():
                    raise Corrupt("residual runs off the stream")
                deep, where = deep[more == 16], where[more == 16]
            low = (((bits.peek(wins, spot + zeros + 1)) >> np.uint64(1)) >> (63 - param).astype(np.uint64)).astype(np.int64)
        else:
            low = (((win << (zeros + 1).astype(np.uint64)) >> np.uint64(1)) >> (63 - param).astype(np.uint64)).astype(np.int64)
        folded = (zeros << param) | low
        left = (folded >> 1) ^ -(folded & 1)
        step = zeros + 1 + param
        if some_raw:
            own = raw[now]
            plainly = own >= 0
            value = ((bits.peek(wins, spot) >> np.uint64(1)) >> (63 - np.maximum(own, 0)).astype(np.uint64)).astype(np.int64)
            left = np.where(plainly, np.where(own > 0, signed(value, np.maximum(own, 1)), 0), left)
            step = np.where(plainly, own, step)
        at[now] = spot + step
        guess = np.zeros(len(left), np.int64)
        for j in range(min(most, i)):
            guess += coef[j, now] * out[i - 1 - j, now]
        out[i, now] = left + (guess >> shift[now])


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT if text else UNIT)


def encode_texts(docs: DataFrame) -> DataFrame:
    """The FLAC stream of each text's padded UTF-8 bytes as 8-bit samples: doc_id, n_bytes, payload_bytes, media. Null is empty."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo, hi, raw in rounds(batch["text"].tolist(), CODE_BYTES):
                payloads = [padded(t) for t in raw]
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[lo:hi].astype("Int64").to_numpy(object, na_value=None), "n_bytes": [len(t) for t in raw], "payload_bytes": [len(p) for p in payloads], "media": encode(payloads)})

    return docs.select("doc_id", "text").mapInPandas(write, MEDIA)


def _read_each(streams: list[bytes]) -> list[tuple[np.ndarray, np.ndarray] | Corrupt]:
    """``decode`` of each stream, or what is wrong with it: streams are read side by side, and one by one only where one is broken."""
    try:
        return list(decode(streams))
    except (Corrupt, IndexError, ValueError) as wrong:
        if len(streams) == 1:
            return [wrong if isinstance(wrong, Corrupt) else Corrupt(f"broken stream: {wrong}")]
        half = len(streams) // 2
        return _read_each(streams[:half]) + _read_each(streams[half:])


def read_media(media: DataFrame) -> DataFrame:
    """Each stream read back: checksums, PCM (unsigned bytes, or little-endian pairs, as they were stored), first sample of each block, and a feature.

    feature: samples, their sum and energy, sign changes and the largest step, all of the decoded signal. A stream that
    is null, broken or fails a checksum gives a row with ``error`` and nulls for what was to be read; others aren't touched by it.
    """

    def told(stream: bytes, got) -> tuple:
        about = len(stream), hashlib.sha256(stream).hexdigest()
        if isinstance(got, Corrupt):
            return None, None, *about, None, None, None, str(got)
        samples, blocks = got
        wide = _metadata(stream)["width"] == 16
        pcm = (samples + (1 << 15)).astype("<u2").tobytes() if wide else (samples + 128).astype(np.uint8).tobytes()
        turns = int(((samples[1:] < 0) != (samples[:-1] < 0)).sum())
        step = int(np.abs(np.diff(samples)).max(initial=0))
        feature = f"n={len(samples)};sum={int(samples.sum())};energy={int((samples * samples).sum())};turns={turns};step={step}"
        return hashlib.sha256(pcm).hexdigest(), zlib.crc32(pcm[-UNIT:]), *about, feature, pcm, blocks, None

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            streams, lo = [m or b"" for m in batch["media"]], 0
            while lo < len(streams):
                hi, held = lo, 0
                while hi < len(streams) and (hi == lo or held + len(streams[hi]) <= ROUND_BYTES):
                    held += len(streams[hi])
                    hi += 1
                rows = [told(s, g) for s, g in zip(streams[lo:hi], _read_each(streams[lo:hi]), strict=True)]
                got = pd.DataFrame(rows, columns=["payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm", "block_at", "error"])
                got["tail_crc32"] = got["tail_crc32"].astype("Int64")
                front = batch.iloc[lo:hi].reset_index(drop=True)
                got.insert(0, "doc_id", front["doc_id"].astype("Int64").to_numpy(object, na_value=None))
                got.insert(1, "n_bytes", front["n_bytes"])
                got.insert(2, "payload_bytes", pd.array([None if r[5] is None else len(r[5]) for r in rows], dtype="Int64"))
                yield got
                lo = hi

    return media.select("doc_id", "n_bytes", "media").mapInPandas(read, READ)


def pcm_blocks(media: DataFrame) -> DataFrame:
    """The PCM of each 8-bit stream in blocks: doc_id, block, first_sample, pcm. A sample s lies in the last block with first_sample <= s.

    Broken streams have no blocks.
    """
    read = read_media(media).filter("error is null").select("doc_id", "pcm", "block_at", F.posexplode("block_at").alias("block", "first_sample"))
    end = F.coalesce(F.try_element_at("block_at", F.col("block") + 2), F.length("pcm").cast("long"))
    return read.select("doc_id", "block", "first_sample", F.substring("pcm", (F.col("first_sample") + 1).cast("int"), (end - F.col("first_sample")).cast("int")).alias("pcm"))


def op1_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text stored as a FLAC stream and read back: the streams, nearly as large as the texts, pass from writer to reader as a column."""
    return read_media(encode_texts(table(spark, sf_dir, "documents"))).drop("pcm", "block_at")
