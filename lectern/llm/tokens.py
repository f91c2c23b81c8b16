"""Token ids of whole texts by the tokenizers library, with the ids of recurring pieces kept.

Texts are cut where the byte-level pre-tokenizer cuts them in any case, all at once in numpy; each distinct piece is
encoded once, and a text's ids are the ids of its pieces, one after another.
"""

from __future__ import annotations

import os
import re
from itertools import compress

import numpy as np
import public_tokenizers
import pyarrow as pa

#: Bytes of texts that are cut and looked up at once.
ROUND_BYTES = 2_000_000
#: Stands behind each text; no byte of UTF-8 has this value.
_END = 0xFF
_BYTES = np.arange(256)
_SPACE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
_LETTER = ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
#: Marks that end a word; neither the apostrophe, which may go on in the word's token, nor what special tokens are written with.
_MARK = np.isin(_BYTES, [ord(c) for c in ".,;:!?*#%&$"])
#: What a kept piece takes beside its own bytes: an object, its place in a dictionary, its ids.
_PIECE_BYTES = 190
#: A blank and letters: one token of the pre-tokenizer.
_WORD = re.compile(rb" (?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: First bytes of the characters that hold all white space beyond ASCII, and the second bytes of the longer ones.
_WIDE_FIRST, _WIDE_SECOND = np.isin(_BYTES, [0xC2, 0xE1, 0xE2, 0xE3]), np.isin(_BYTES, [0x80, 0x81, 0x9A])


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    return public_tokenizers.path(name)


def piece_starts(data: np.ndarray) -> np.ndarray:
    """Where pieces of ``data`` begin: UTF-8 texts, each followed by the byte 0xFF, which is a piece of its own.

    White space before a word is, but for its last character, a token of its own; the last one is, too, unless it is a
    blank, which goes to the word. So a piece may begin at white space, at its last character, and behind that; and at a
    mark behind a letter. Beside white space beyond ASCII nothing is cut, and before "<", where a special token may begin,
    white space stays together.
    """
    held = np.concatenate([np.full(3, _END, np.uint8), data])  # so that three bytes lie before each one
    cut = np.zeros(len(data) + 1, bool)
    ends = np.flatnonzero(data == _END)
    cut[ends] = cut[ends + 1] = True
    space = np.concatenate([[False], _SPACE[data], [False]])
    edges = np.flatnonzero(space[1:] != space[:-1])
    begin, end = edges[0::2], edges[1::2]
    one, two, three = held[begin + 2], held[begin + 1], held[begin]
    wide = ((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | (_WIDE_SECOND[two] & _WIDE_FIRST[three])
    cut[begin[~wide]] = True
    after = data[end]
    inner = ~_WIDE_FIRST[after] & (after != _END) & (after != 0x3C)
    cut[end[inner & (end - begin > 1)] - 1] = True
    cut[end[inner & (data[end - 1] != 0x20)]] = True
    mark = np.flatnonzero(_MARK[data])
    one, two = held[mark + 2], held[mark + 1]
    latin = (two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7)
    cut[mark[_LETTER[one] | latin]] = True
    if len(data):
        cut[0] = True
    return np.flatnonzero(cut[:-1])


class TextEncoder:
    """Encodes whole texts with one tokenizer file; keeps the ids of pieces, within about ``most_kept`` bytes.

    ``plain`` reads the strings of special tokens as ordinary text. When the room is used up, the pieces stay that
    recurred often since it last was.
    """

    _made: dict[tuple[str, bool], TextEncoder] = {}

    def __init__(self, path: str, plain: bool = False, most_kept: int = 250_000_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.most_kept = most_kept
        self._forget()

    @classmethod
    def of(cls, path: str, plain: bool = False) -> TextEncoder:
        """One encoder a worker process, file and reading of special tokens."""
        if (path, plain) not in cls._made:
            cls._made[path, plain] = cls(path, plain)
        return cls._made[path, plain]

    def _forget(self, often: int = 3) -> None:
        """Keep the pieces that ``often`` rounds or more had, if they take half the room at most; else none."""
        known, held, at = getattr(self, "known", {}), getattr(self, "held", None), getattr(self, "at", None)
        stay = np.flatnonzero(self.rounds >= often) if known else np.zeros(0, np.int64)
        stay = stay[stay > 0]
        pieces = list(known)
        pieces = [pieces[i] for i in stay.tolist()]
        self.room = self.most_kept - sum(map(len, pieces)) - _PIECE_BYTES * len(pieces)
        if self.room < self.most_kept // 2:
            pieces, stay, self.room = [], stay[:0], self.most_kept
        # number 0 is the end of a text; the ids of piece k are held[at[k] : at[k + 1]]
        self.known: dict[bytes, int] = {b"\xff": 0, **{p: k for k, p in enumerate(pieces, 1)}}
        self.rounds = np.zeros(len(self.known), np.int32)
        sizes = (at[stay + 1] - at[stay]) if len(stay) else np.zeros(0, np.int64)
        self.held = np.concatenate([held[at[k] : at[k + 1]] for k in stay]) if len(stay) else np.zeros(0, np.uint32)
        self.at = np.concatenate([np.zeros(2, np.int64), np.cumsum(sizes)])

    def _learn(self, pieces: list[bytes]) -> None:
        is_word = list(map(_WORD.fullmatch, pieces))
        plain, others = list(compress(pieces, is_word)), [p for p, word in zip(pieces, is_word, strict=True) if word is None]
        # a run of words with a blank before each is encoded as one text, whose tokens name their word
        runs = [plain[i : i + 200] for i in range(0, len(plain), 200)]
        got = self.tokenizer.encode_batch([b"".join(run).decode() for run in runs], add_special_tokens=False)
        ids, sizes = [self.held], []
        for run, e in zip(runs, got, strict=True):
            ids.append(np.array(e.ids, np.uint32))
            sizes.append(np.bincount(np.array(e.word_ids, np.int64)))
            if len(sizes[-1]) != len(run):
                raise ValueError("the tokenizer cuts words in another way than this encoder")
        for e in self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in others], add_special_tokens=False):
            ids.append(np.array(e.ids, np.uint32))
            sizes.append(np.array([len(ids[-1])]))
        self.known.update(zip(plain + others, range(len(self.at) - 1, len(self.at) - 1 + len(pieces)), strict=True))
        self.rounds = np.concatenate([self.rounds, np.zeros(len(pieces), np.int32)])
        self.room -= sum(map(len, pieces)) + _PIECE_BYTES * len(pieces)
        self.held, self.at = np.concatenate(ids), np.concatenate([self.at, self.at[-1] + np.cumsum(np.concatenate(sizes))])

    def flat_ids(self, texts: list[bytes], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all ``texts``, one after another; how many each has). With ``end_id`` each text's ids end with it."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        data = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
        starts = piece_starts(data)
        offsets = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        distinct = pieces.dictionary.to_pylist()
        if self.room < 0:
            self._forget()
        number = list(map(self.known.get, distinct))
        fresh = [p for p, n in zip(distinct, number, strict=True) if n is None]
        if fresh:
            self._learn(fresh)
            number = [self.known[p] if n is None else n for p, n in zip(distinct, number, strict=True)]
        number, end = np.array(number, np.int64), distinct.index(b"\xff")
        self.rounds[number] += 1
        begin, size = self.at[number], np.diff(self.at)[number]
        ids = self.held
        begin[end], size[end] = len(ids), 0 if end_id is None else 1
        if end_id is not None:
            ids = np.append(ids, np.uint32(end_id))
        which = pieces.indices.to_numpy()
        sizes = size[which]
        reach = np.cumsum(sizes)
        out = ids[np.repeat(begin[which] - reach + sizes, sizes) + np.arange(int(reach[-1]))]
        return out, np.diff(reach[which == end], prepend=0)

    def ids_of(self, texts: list[str | None]) -> list[bytes]:
        """Of each text the ids as little-endian unsigned 32-bit bytes; none for null and empty texts."""
        ids, sizes = self.flat_ids([(t or "").encode("utf-8", "replace") for t in texts])
        raw, ends = ids.astype("<u4").tobytes(), 4 * np.cumsum(sizes)
        return [raw[e - 4 * n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]

    def ids(self, text: str | None) -> bytes:
        """The ids of one text."""
        return self.ids_of([text])[0]
