"""English stems (the published Porter 2 rules) as SQL expressions, stage by stage: for Spark columns and any other SQL.

Each stage is a set of expressions over the columns of the stage before it, so no expression is ever repeated inside
another. Stem a vocabulary, not a text: ``stemmed`` takes distinct words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the stemmer: irregular words, words left alone, and suffixes with what replaces them.
IRREGULAR = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl",
}
INVARIANT = "sky news howe atlas cosmos bias andes".split()
STOPPED = "inning outing canning herring earring proceed exceed succeed".split()
DOUBLES = "bb dd ff gg mm nn pp rr tt".split()
STEP2 = {
    "ational": "ate", "fulness": "ful", "iveness": "ive", "ization": "ize", "ousness": "ous", "biliti": "ble", "lessli": "less", "tional": "tion",
    "alism": "al", "aliti": "al", "ation": "ate", "entli": "ent", "fulli": "ful", "iviti": "ive", "ousli": "ous",
    "abli": "able", "alli": "al", "anci": "ance", "ator": "ate", "enci": "ence", "izer": "ize", "bli": "ble", "ogi": "og", "li": "",
}
STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "ative": "", "icate": "ic", "iciti": "ic", "ical": "ic", "ness": "", "ful": ""}
STEP4 = "ement ance ence able ible ment ant ent ism ate iti ous ive ize ion al er ic".split()

_REGION = "[^aeiouy]*[aeiouy]+[^aeiouy]"
_SHORT = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"


def _cut(n: int) -> str:
    return f"left(w, greatest(length(w) - {n}, 0))"


def _in(words) -> str:
    return "(" + ", ".join(f"'{x}'" for x in words) + ")"


def _has(part: str, pattern: str) -> str:
    return f"regexp_extract({part}, '{pattern}', 0) <> ''"


def _before(n: int) -> str:
    """The letter before the last ``n``."""
    return f"left(right(w, {n + 1}), 1)"


def _suffixes(rules: dict[str, str], region: str, extra: dict[str, str]) -> str:
    """The longest of the suffixes that ``w`` has is replaced if it lies in ``region`` and its ``extra`` condition holds."""
    out = "case"
    for suffix in sorted(rules, key=len, reverse=True):
        n = len(suffix)
        also = f" and {extra[suffix]}" if suffix in extra else ""
        out += f" when right(w, {n}) = '{suffix}' then case when length(w) - {n} >= {region}{also} then {_cut(n)} || '{rules[suffix]}' else w end"
    return out + " else w end"


def stages(word: str = "word") -> list[dict[str, str]]:
    """Expressions of each stage by column; the last one's ``stem`` is the result. What a stage doesn't name stays."""
    marked = f"case when left({word}, 1) = 'y' then 'Y' || substring({word}, 2) else {word} end"
    for vowel in "aeiouy":
        marked = f"replace({marked}, '{vowel}y', '{vowel}Y')"
    head = f"regexp_extract(w, '^(gener|commun|arsen|{_REGION})', 0)"
    rest = f"regexp_extract(substring(w, r1 + 1), '^{_REGION}', 0)"
    vowel_before = lambda n: _has(_cut(n), "[aeiouy]")
    removed = {s: f"case when {vowel_before(len(s))} then {len(s)} else 0 end" for s in ("ingly", "edly", "ing", "ed")}
    return [
        {"w": marked},
        {"r1": f"case when {head} <> '' then length({head}) else length(w) end"},
        {"r2": f"case when {rest} <> '' then r1 + length({rest}) else length(w) end"},
        {
            "w": f"case when right(w, 4) = 'sses' then {_cut(2)} when right(w, 3) in ('ied', 'ies') then case when length(w) > 4 then {_cut(2)} else {_cut(1)} end "
            f"when right(w, 2) in ('us', 'ss') then w when right(w, 1) = 's' and {_has(_cut(2), '[aeiouy]')} then {_cut(1)} else w end"
        },
        {"stopped": f"w in {_in(STOPPED)}", "first": "w"},
        {
            "gone": f"case when right(w, 5) = 'eedly' then 0 when right(w, 5) = 'ingly' then {removed['ingly']} when right(w, 4) = 'edly' then {removed['edly']} "
            f"when right(w, 3) = 'eed' then 0 when right(w, 3) = 'ing' then {removed['ing']} when right(w, 2) = 'ed' then {removed['ed']} else 0 end"
        },
        {
            "w": f"case when right(w, 5) = 'eedly' then case when length(w) - 5 >= r1 then {_cut(3)} else w end "
            f"when right(w, 3) = 'eed' then case when length(w) - 3 >= r1 then {_cut(1)} else w end else left(w, length(w) - gone) end"
        },
        {"w": f"case when gone = 0 then w when right(w, 2) in ('at', 'bl', 'iz') then w || 'e' when right(w, 2) in {_in(DOUBLES)} then {_cut(1)} when r1 >= length(w) and {_has('w', _SHORT)} then w || 'e' else w end"},
        {"w": f"case when length(w) > 2 and right(w, 1) in ('y', 'Y') and {_before(1)} not in {_in('aeiouy')} then {_cut(1)} || 'i' else w end"},
        {"w": _suffixes(STEP2, "r1", {"ogi": f"{_before(3)} = 'l'", "li": f"{_before(2)} in {_in('cdeghkmnrt')}"})},
        {"w": _suffixes(STEP3, "r1", {"ative": "length(w) - 5 >= r2"})},
        {"w": _suffixes(dict.fromkeys(STEP4, ""), "r2", {"ion": f"{_before(3)} in ('s', 't')"})},
        {
            "w": f"case when right(w, 1) = 'e' and (length(w) - 1 >= r2 or (length(w) - 1 >= r1 and not ({_has(_cut(1), _SHORT)}))) then {_cut(1)} "
            f"when right(w, 2) = 'll' and length(w) - 1 >= r2 then {_cut(1)} else w end"
        },
        {
            "stem": f"case when length({word}) < 3 or {word} in {_in(INVARIANT)} then {word} "
            + "".join(f"when {word} = '{x}' then '{y}' " for x, y in IRREGULAR.items())
            + "when stopped then replace(first, 'Y', 'y') else replace(w, 'Y', 'y') end"
        },
    ]


def stemmed(words: DataFrame, word: str = "word") -> DataFrame:
    """``words`` with the ``stem`` of each lower-case ``word``; null stays null.

    Write the result before you filter or join by ``stem``: a filter that the optimizer moves below the stages would
    repeat each stage within the next.
    """
    out = words
    for stage in stages(word):
        out = out.withColumns({c: F.expr(e) for c, e in stage.items()})
    return out.select(*words.columns, "stem")


def stem_sql(table: str, word: str = "word") -> str:
    """A query of ``table`` with the column ``stem`` (and those of the stages) beside its own."""
    out = f"select * from {table}"
    seen: set[str] = set()
    for stage in stages(word):
        again = seen & set(stage)
        out = f"select *{f' exclude ({", ".join(sorted(again))})' if again else ''}, {', '.join(f'{e} as {c}' for c, e in stage.items())} from ({out})"
        seen |= set(stage)
    return out
