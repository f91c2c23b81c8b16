"""Fill-in-middle transformation by a constant-memory streaming matcher.

A text is a run of units, the matches of an expression from left to right. A first pass counts them; keyed hashes of
the document's id then choose two ranks, and a second pass advances a lazy iterator of matches to both. Neither pass
keeps a list of units, so a text needs no more memory than itself and its output, however many units it has.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import small_batches, table

#: Lines with their ends; a last line may lack one.
LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Which texts are transformed, and which of them begin with the suffix, in percent.
RATE, SPM_RATE, SEED = 100, 50, 7


class Fim(NamedTuple):
    """A text's number of units, its form (plain, psm or spm), the code points of its prefix and middle, and the output."""

    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: str


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four 32-bit numbers from the SHA-256 of ``seed:doc_id``; nothing follows the colon for a null id."""
    name = f"{seed}:" + ("" if doc_id is None else str(doc_id))
    hexes = hashlib.sha256(name.encode()).hexdigest()
    return tuple(int(hexes[k : k + 8], 16) for k in range(0, 32, 8))


def cuts(units: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """Where the first ``low`` and the first ``high`` (no fewer) units of ``text`` end, by one advancing iterator."""
    matches, begin = units.finditer(text), 0
    for match in islice(matches, low):
        begin = match.end()
    end = begin
    for match in islice(matches, high - low):
        end = match.end()
    return begin, end


def transformed(text: str | None, doc_id: int | None, units: re.Pattern, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> Fim:
    """One text. Null is empty; an empty text, or one that holds a marker, stays as it is."""
    text = text or ""
    n = sum(1 for _ in units.finditer(text))
    one, two, three, four = draws(doc_id, seed)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or three % 100 >= rate:
        return Fim(n, "plain", None, None, text)
    begin, end = cuts(units, text, *sorted((one % (n + 1), two % (n + 1))))
    prefix, middle, suffix = text[:begin], text[begin:end], text[end:]
    if four % 100 < spm_rate:
        return Fim(n, "spm", begin, end - begin, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}")
    return Fim(n, "psm", begin, end - begin, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")


def restored(output: str, form: str) -> str:
    """The text that ``transformed`` gave ``output`` for: a transformed text holds no marker, so each marker is found once."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output.removeprefix(first).split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return one + middle + two if form == "psm" else two + middle + one


def fill_in_middle(docs: DataFrame, units: str = LINES, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; others are ignored): doc_id, n, form, prefix_chars, middle_chars, output.

    ``units`` is an expression whose matches cover a text; what it leaves uncovered after the last match goes to the
    suffix. Null texts are empty, so plain with an empty output. Null ids draw as one id; rows that repeat each get a
    row, equal ones equal rows. No shuffle: a row depends on nothing but itself.
    """
    small_batches(docs.sparkSession)

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pattern = re.compile(units)
        for batch in batches:
            ids = [None if pd.isna(d) else int(d) for d in batch["doc_id"]]
            rows = [transformed(t if isinstance(t, str) else None, d, pattern, rate, spm_rate, seed) for d, t in zip(ids, batch["text"], strict=True)]
            out = pd.DataFrame(rows, columns=Fim._fields)
            out.insert(0, "doc_id", pd.Series(ids, dtype="Int64"))
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(rewrite, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def digests(outputs: DataFrame) -> DataFrame:
    """``fill_in_middle``'s rows with output_sha256 and restored_sha256 (of the text rebuilt from output and form) instead of the output."""

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = [(o, restored(o, f)) for o, f in zip(batch.pop("output"), batch["form"], strict=True)]
            for k, name in enumerate(("output_sha256", "restored_sha256")):
                batch[name] = [hashlib.sha256(p[k].encode("utf-8", "replace")).hexdigest() for p in pairs]
            yield batch

    rows = outputs.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    return rows.mapInPandas(digest, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text cut by lines: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    return digests(fill_in_middle(table(spark, sf_dir, "documents")))
