"""License scans by ordered signature rules, with DataFrame functions alone.

Text is normalised to its words with single blanks. A document without a part of any rule's keyword is done after that;
others try just the rules whose keyword they hold. Every match of a rule's expression is an interval; an interval that
lies within one of higher priority, or of equal priority and greater length, is suppressed. Rules are those written out
in ``license_rules``, and several for each name of a family.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import table
from lectern.llm.license_rules import RULES

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose places are counted, with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Fixed values: (label, names as they read after normalisation, in order of mention). Each name makes several rules.
FAMILIES = [
    ("gpl", ["gnu general public licen[cs]e", "gnu gpl", "gpl"]),
    ("lgpl", ["gnu lesser general public licen[cs]e", "gnu library general public licen[cs]e", "lgpl"]),
    ("agpl", ["gnu affero general public licen[cs]e", "agpl"]),
    ("gfdl", ["gnu free documentation licen[cs]e", "gfdl"]),
    ("apache", ["apache licen[cs]e", "apache software licen[cs]e"]),
    ("mit", ["mit licen[cs]e", "expat licen[cs]e"]),
    ("bsd", ["bsd licen[cs]e", "bsd [234] clause", "modified bsd licen[cs]e", "simplified bsd licen[cs]e", "new bsd licen[cs]e"]),
    ("isc", ["isc licen[cs]e"]),
    ("mpl", ["mozilla public licen[cs]e", "mpl [12] [01]"]),
    ("epl", ["eclipse public licen[cs]e"]),
    ("cddl", ["common development and distribution licen[cs]e", "cddl"]),
    ("cpl", ["common public licen[cs]e"]),
    ("eupl", ["european union public licen[cs]e", "eupl"]),
    ("artistic", ["artistic licen[cs]e", "perl artistic licen[cs]e"]),
    ("bsl", ["boost software licen[cs]e"]),
    ("zlib", ["zlib licen[cs]e", "zlib libpng licen[cs]e"]),
    ("unlicense", ["the unlicense"]),
    ("wtfpl", ["wtfpl", "do what the fuck you want to public licen[cs]e"]),
    ("cc0", ["cc0", "creative commons zero"]),
    ("cc-by", ["creative commons attribution(?! non| share| no)", "cc by(?! nc| sa| nd)"]),
    ("cc-by-nc", ["creative commons attribution non ?commercial(?! share| no)", "cc by nc(?! sa| nd)"]),
    ("cc-by-sa", ["creative commons attribution share ?alike", "cc by sa"]),
    ("cc-by-nd", ["creative commons attribution no ?deriv(?:ative)?s?", "cc by nd"]),
    ("cc-by-nc-sa", ["creative commons attribution non ?commercial share ?alike", "cc by nc sa"]),
    ("cc-by-nc-nd", ["creative commons attribution non ?commercial no ?deriv(?:ative)?s?", "cc by nc nd"]),
    ("psf", ["python software foundation licen[cs]e", "psf licen[cs]e"]),
    ("php", ["php licen[cs]e"]),
    ("ruby", ["ruby licen[cs]e"]),
    ("openssl", ["openssl licen[cs]e", "ssleay licen[cs]e"]),
    ("postgresql", ["postgresql licen[cs]e"]),
    ("ofl", ["sil open font licen[cs]e", "open font licen[cs]e"]),
    ("ms-pl", ["microsoft public licen[cs]e"]),
    ("ms-rl", ["microsoft reciprocal licen[cs]e"]),
    ("odbl", ["open database licen[cs]e", "odbl"]),
    ("odc-by", ["open data commons attribution licen[cs]e"]),
    ("pddl", ["public domain dedication and licen[cs]e", "pddl"]),
    ("osl", ["open software licen[cs]e"]),
    ("afl", ["academic free licen[cs]e"]),
    ("ncsa", ["ncsa open source licen[cs]e", "university of illinois ncsa"]),
    ("x11", ["x11 licen[cs]e", "x consortium licen[cs]e"]),
    ("sspl", ["server side public licen[cs]e", "sspl"]),
    ("busl", ["business source licen[cs]e"]),
    ("elastic", ["elastic licen[cs]e"]),
    ("openrail", ["openrail licen[cs]e", "responsible ai licen[cs]e", "bigscience rail"]),
    ("llama", ["llama [23] community licen[cs]e", "llama community licen[cs]e"]),
    ("proprietary", ["end user licen[cs]e agreement", "proprietary licen[cs]e", "commercial licen[cs]e"]),
    ("public-domain", ["released into the public domain", "dedicated to the public domain"]),
    ("all-rights-reserved", ["all rights reserved"]),
]
#: Rules of a name N: (priority, expression, confidence). A higher priority suppresses what it contains.
FORMS = [
    (40, "(?:this work is |this program is |this software is )?licen[cs]ed under (?:the )?(?:terms of (?:the )?)?N(?: version)?(?: v?[0-9]+(?: [0-9]+)*)?(?: international| unported)?", 1.0),
    (40, "(?:released|distributed|published|made available|provided|available|covered) under (?:the )?(?:terms of (?:the )?)?N(?: version)?(?: v?[0-9]+(?: [0-9]+)*)?", 0.95),
    (30, "spdx licen[cs]e identifier N(?: v?[0-9]+(?: [0-9]+)*)?", 0.95),
    (20, "N version v?[0-9]+(?: [0-9]+)*(?: or (?:any )?later(?: version)?)?", 0.8),
    (10, "N", 0.6),
]
def _keyword(name: str) -> str:
    """A run of plain words of ``name`` that each of its matches holds."""
    plain = name.split("(?")[0].replace("licen[cs]e", "licen").split("[")[0]
    words = plain.replace(" ?", "\0").split("\0")[0].strip()
    return words


def rules() -> list[tuple[int, str, str, int, str, float]]:
    """All rules in order: (number, label, keyword, priority, expression over normalised text, confidence)."""
    out = []
    for label, names in FAMILIES:
        for name in names:
            for priority, form, sure in FORMS:
                out.append((label, _keyword(name), priority, form.replace("N", name), sure))
    out += [(label, keyword, priority, expression, sure) for label, priority, keyword, expression, sure in RULES]
    return [(i, *r) for i, r in enumerate(out)]


#: Words too common to tell a license by; and the words that a keyword stands for where its matches go on within the word.
COMMON = frozenset("a and any are be by can for from general have in is it may not of on or public the this to under use used version with you your".split())
LONGER = {"gplv": ("gplv2", "gplv3"), "lgplv": ("lgplv2", "lgplv3"), "agplv": ("agplv3",)}


def gates() -> dict[str, dict[str, list[dict]]]:
    """All rules by a word that each of their matches has, and by keyword with the blank before it: a match begins at a word.

    A text that has none of the words has no detection. The last word of a keyword may go on, so another one is taken.
    """
    levels = {p: i for i, p in enumerate(sorted({r[3] for r in rules()}))}
    out: dict[str, dict[str, list[dict]]] = {}
    for rule, label, keyword, priority, expression, confidence in rules():
        told = {"rule": rule, "label": label, "priority": priority, "level": levels[priority], "pattern": f"(?<= )(?:{expression})(?= )", "confidence": confidence}
        words = keyword.split()[:-1]
        for word in LONGER.get(keyword, (keyword,)) if not words else (max(words, key=lambda w: (w not in COMMON, len(w))),):
            out.setdefault(word, {}).setdefault(f" {keyword}", []).append(told)
    return out


def normalised(text: Column) -> Column:
    """Lower-cased in A-Z, words with single blanks between and around them. A text without words is one blank."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    spaced = F.regexp_replace(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.concat(F.lit(" "), F.ltrim(F.rtrim(spaced)), F.lit(" "))


def _base_places(norm: Column, words: Column) -> Column:
    """An array of the word numbers where each phrase of BASE begins, as struct(label, at)."""

    def places(phrase: str, label: str) -> Column:
        first, *rest = phrase.split()

        def here(word: Column, i: Column) -> Column:
            stands = word == first
            for k, other in enumerate(rest, 1):
                stands = stands & (F.get(words, i + k) == other)
            return F.when(stands, F.struct(F.lit(label).alias("label"), (i - 1).cast("long").alias("at")))  # the first of ``words`` is empty

        return F.when(F.contains(norm, F.lit(f" {phrase} ")), F.array_compact(F.transform(words, here))).otherwise(F.array().cast(PLACES))

    return F.concat(*[places(phrase, label) for phrase, label in BASE.items()])


PLACES = "array<struct<label:string,at:bigint>>"
KNOWN = (
    "array<struct<word:string,keywords:array<struct<keyword:string,"
    "rules:array<struct<rule:int,label:string,priority:int,level:int,pattern:string,confidence:double>>>>>>"
)
FOUND = "array<struct<first:int,end:int,priority:int,level:int,rule:int,label:string,confidence:double>>"


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _found(norm: Column, held: Column) -> Column:
    """All matches of all rules whose gate is among the words ``held`` and whose keyword the text holds, in order of place, the longest and highest first."""
    # one literal, which is read once when the query is planned
    known = F.from_json(F.lit(json.dumps([{"word": w, "keywords": [{"keyword": k, "rules": some} for k, some in ks.items()]} for w, ks in gates().items()])), KNOWN)

    def matches(rule: Column) -> Column:
        # marks go around each match; cut at blanks, a match then begins at a word with one mark and ends at one with the other
        marked = F.split(F.regexp_replace(norm, rule["pattern"], F.lit("\x01$0\x02")), F.lit(" "), -1)
        spot = lambda mark, edge: lambda words: F.array_compact(F.transform(words, lambda w, i: F.when(edge(w, F.lit(mark)), i)))
        pairs = _let(marked, lambda words: F.arrays_zip(spot("\x01", F.startswith)(words).alias("b"), spot("\x02", F.endswith)(words).alias("e")))
        return F.transform(
            pairs,
            lambda p: F.struct((p["b"] - 1).alias("first"), p["e"].alias("end"), (-rule["priority"]).alias("low"), rule["rule"].alias("rule"), rule["level"].alias("level"), rule["label"].alias("label"), rule["confidence"].alias("confidence")),
        )

    near = F.flatten(F.transform(F.filter(known, lambda g: F.array_contains(held, g["word"])), lambda g: g["keywords"]))
    hits = F.flatten(F.transform(F.filter(near, lambda k: F.contains(norm, k["keyword"])), lambda k: k["rules"]))
    every = F.transform(F.flatten(F.transform(hits, matches)), lambda m: F.struct(m["first"], (-m["end"]).alias("back"), m["low"], m["rule"], m["level"], m["label"], m["confidence"]))
    return F.transform(F.array_sort(every), lambda m: F.struct(m["first"], (-m["back"]).alias("end"), (-m["low"]).alias("priority"), m["level"], m["rule"], m["label"], m["confidence"])).cast(FOUND)


#: Matches that are walked together: what a walk keeps is copied step by step, so a text of very many matches goes by stretches.
STRETCH = 256


def _kept(found: Column) -> Column:
    """``found``, which is in order, without matches that lie inside one of higher priority, or of equal priority and longer, or equal and of an earlier rule.

    One walk with the furthest end so far of matches of each priority and above.
    """
    none, levels = F.array().cast(FOUND), len({r[3] for r in rules()})

    def step(state: Column, match: Column) -> Column:
        reach = F.transform(state["reach"], lambda r, level: F.when(level <= match["level"], F.greatest(r, match["end"])).otherwise(r))
        inside = F.get(state["reach"], match["level"]) >= match["end"]
        return F.struct(reach.alias("reach"), F.when(inside, state["kept"]).otherwise(F.concat(state["kept"], F.array(match))).alias("kept"))

    def stretch(state: Column, some: Column) -> Column:
        begun = F.struct(state["reach"].alias("reach"), none.alias("kept"))
        return _let(F.aggregate(some, begun, step), lambda s: F.struct(s["reach"].alias("reach"), F.concat(state["kept"], F.array(s["kept"])).alias("kept")))

    cut = lambda every: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(every) - 1) / STRETCH), F.lit(0)).cast("int")), lambda k: F.slice(every, k * STRETCH + 1, F.lit(STRETCH)))
    begun = F.struct(F.array_repeat(F.lit(-1), levels).alias("reach"), F.array(none).alias("kept"))
    return _let(found, lambda every: F.flatten(F.aggregate(cut(every), begun, stretch)["kept"]))


def with_detections(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, base (places of BASE) and kept (detections that aren't suppressed).

    All is computed from the row alone, in one pass and without a join, so it doesn't matter how the rows are dealt out.
    """
    rows = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    rows = rows.select("*", F.split("norm", " ", -1).alias("words"))
    every = F.array(*map(F.lit, sorted({*gates(), *(p.split()[0] for p in BASE)})))
    rows = rows.select("*", F.array_intersect("words", every).alias("held"))
    norm, words, held = F.col("norm"), F.col("words"), F.col("held")
    return rows.select(
        "doc_id",
        F.when(norm == "  ", F.lit(0)).otherwise(F.size(words) - 2).cast("long").alias("n_words"),
        F.when(F.size(held) > 0, _base_places(norm, words)).otherwise(F.array().cast(PLACES)).alias("base"),
        F.when(F.size(held) > 0, _kept(_found(norm, held))).otherwise(F.array().cast(FOUND)).alias("kept"),
    )


def detections(docs: DataFrame) -> DataFrame:
    """Every detection that isn't suppressed, a row each: doc_id, first (word, from 0), end, priority, rule, label, confidence."""
    return with_detections(docs).select("doc_id", F.explode("kept").alias("d")).select("doc_id", "d.*")


def scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; others are ignored): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the highest confidence of a detection that isn't suppressed, 0 without any. Null and empty texts have no
    words and no labels; rows that repeat each get a row; an empty table gives none.
    """
    at = F.transform("base", lambda p: p["at"])
    base = F.array_distinct(F.transform("base", lambda p: p["label"]))
    return with_detections(docs).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.transform("kept", lambda d: d["label"]))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("kept", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
    )


def op7_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License detections in every whole text."""
    return scan(table(spark, sf_dir, "documents"))
