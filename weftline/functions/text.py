"""Analyzers: words of a text, and the English analyzer with Porter's stemmer."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BREAKS = "[^\\p{L}\\p{N}]+"

# The stop words of the classic English analyzer.
ENGLISH_STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or",
    "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
]


def simple_terms(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order; empty for a null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAKS, -1), "")


# ---- Porter's stemmer (1980), by its published rules ------------------------------------------


def _cons(w: str, i: int) -> bool:
    c = w[i]
    if c in "aeiou":
        return False
    return c != "y" or i == 0 or not _cons(w, i - 1)


def _form(w: str) -> str:
    """The word as C and V runs."""
    return re.sub(r"(.)\1+", r"\1", "".join("c" if _cons(w, i) else "v" for i in range(len(w))))


def _m(w: str) -> int:
    return _form(w).count("vc")


def _vowel(w: str) -> bool:
    return any(not _cons(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _cons(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and _cons(w, n - 3) and not _cons(w, n - 2) and _cons(w, n - 1) and w[-1] not in "wxy"


# The suffix tables of steps 2, 3 and 4.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _swap(w: str, table: dict[str, str]) -> str:
    for end in sorted(table, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            return stem + table[end] if _m(stem) > 0 else w
    return w


@lru_cache(maxsize=1 << 17)
def porter(w: str) -> str:
    """The stem of a lower-case ASCII word; words of one or two letters, and others, stay."""
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        w = w[:-1] if _m(w[:-3]) > 0 else w
    elif w.endswith("ed") and _vowel(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and _vowel(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            w = cut + "e"
        elif _double(cut) and cut[-1] not in "lsz":
            w = cut[:-1]
        else:
            w = cut + "e" if _m(cut) == 1 and _cvc(cut) else cut
    if w.endswith("y") and _vowel(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, _STEP2), _STEP3)
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            stem = w[: -len(end)]
            if _m(stem) > 1 and (end != "ion" or stem[-1:] in ("s", "t")):
                w = stem
            break
    if w.endswith("e") and (_m(w[:-1]) > 1 or _m(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _m(w) > 1 else w


_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_STOP = frozenset(ENGLISH_STOP_WORDS)


def english_tokens(text: str | None) -> list[tuple[str, int]]:
    """(stem, position): words without possessive 's, lower case, without stop words, whose positions stay counted."""
    out = []
    for i, t in enumerate(_TOKEN.findall((text or "").lower())):
        t = re.sub(r"['’]s$", "", t)
        if t not in _STOP:
            out.append((porter(t), i))
    return out


@F.pandas_udf(T.StringType())
def _porter(words: pd.Series) -> pd.Series:
    return words.map(porter, na_action="ignore")


_ENGLISH = "[\\p{L}\\p{N}]+(?:['’][\\p{L}\\p{N}]+)*"


def _placed(words: Column) -> Column:
    return F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("pos")))


def simple_words(text: Column) -> Column:
    return _placed(simple_terms(text))


def english_words(text: Column) -> Column:
    """(word, pos) of a text's words before stemming: without possessive 's and without stop words, whose places stay
    counted. Empty for a null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(_ENGLISH), F.lit(0))
    bare = F.transform(found, lambda w: F.regexp_replace(w, "['’]s$", ""))
    return F.filter(_placed(bare), lambda x: ~x["word"].isin(ENGLISH_STOP_WORDS))


def stem_table(words: DataFrame) -> DataFrame:
    """(word, stem) of the distinct words of a column ``word`` whose stems are not themselves: each is stemmed once."""
    return words.select("word").distinct().select("word", _porter("word").alias("stem")).where("stem <> word")


def stemmed(placed: DataFrame, stems: DataFrame | None = None) -> DataFrame:
    """Rows of (word, ...) with ``term`` in the word's place: its stem, looked up in ``stems``, or made where the row is by
    workers that remember the words they have met, so that no row is shuffled by its word."""
    rest = [c for c in placed.columns if c != "word"]
    if stems is None:
        return placed.select(*rest, _porter("word").alias("term"))
    return placed.join(stems, "word", "left").select(*rest, F.coalesce("stem", "word").alias("term"))


@dataclass(frozen=True)
class Analyzer:
    """What an index and its queries share: ``words`` has a text's (word, pos), ``query`` a query's (term, pos) by the same
    rules; ``stems`` says that the index looks its words' stems up in a table of the distinct ones."""

    words: Callable[[Column], Column]
    query: Callable[[str], list[tuple[str, int]]]
    stems: bool = False


def simple_tokens(text: str) -> list[tuple[str, int]]:
    return [(t, i) for i, t in enumerate(t for t in re.split(r"[\W_]+", text.lower()) if t)]


SIMPLE = Analyzer(simple_words, simple_tokens)
ENGLISH = Analyzer(english_words, english_tokens, stems=True)


# ---- the English analyzer in SQL ---------------------------------------------------------------


def porter_sql(words: str) -> str:
    """CTEs up to ``stems`` (word, stem), Porter's stemmer over the distinct words of the table ``words`` (word), for
    twins of queries: the steps are those of ``porter``, by patterns of vowels and consonants."""
    cut = lambda n, x="w": f"left({x}, length({x}) - {n})"
    # a y is a consonant, written Y, at the start and behind a vowel, of which it may be one
    form = lambda x: f"regexp_replace(regexp_replace(regexp_replace({x}, '^y', 'Y'), '([aeiou])y', '\\1Y', 'g'), 'yy', 'yY', 'g')"
    has = lambda x, p: f"regexp_matches({form(x)}, '{p}')"
    v, c = "[aeiouy]", "[^aeiouy]"
    m0, m1, vowel = (lambda x: has(x, f"^{c}*{v}+{c}")), (lambda x: has(x, f"^{c}*{v}+{c}+{v}+{c}")), (lambda x: has(x, v))
    cvc = lambda x: has(x, f"{c}{v}[^aeiouywxY]$")
    double = lambda x: f"(length({x}) > 1 AND right({x}, 1) = substr({x}, length({x}) - 1, 1) AND {has(x, c + '$')})"

    def swap(table: dict[str, str]) -> str:
        each = " ".join(f"WHEN ends_with(w, '{e}') THEN CASE WHEN {m0(cut(len(e)))} THEN {cut(len(e))} || '{to}' ELSE w END" for e, to in sorted(table.items(), key=lambda x: -len(x[0])))
        return f"CASE {each} ELSE w END"

    def drop(end: str) -> str:
        more = f" AND right({cut(len(end))}, 1) IN ('s', 't')" if end == "ion" else ""
        return f"WHEN ends_with(w, '{end}') THEN CASE WHEN {m1(cut(len(end)))}{more} THEN {cut(len(end))} ELSE w END"

    gone = f"CASE WHEN ends_with(w, 'eed') THEN NULL WHEN ends_with(w, 'ed') THEN CASE WHEN {vowel(cut(2))} THEN {cut(2)} END WHEN ends_with(w, 'ing') AND {vowel(cut(3))} THEN {cut(3)} END"
    steps = [
        f"CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {cut(2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {cut(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {m0(cut(3))} THEN {cut(1)} ELSE w END WHEN ({gone}) IS NULL THEN w ELSE '=' || ({gone}) END",
        f"CASE WHEN NOT starts_with(w, '=') THEN w WHEN right(w, 2) IN ('at', 'bl', 'iz') THEN substr(w, 2) || 'e' WHEN {double('substr(w, 2)')} AND right(w, 1) NOT IN ('l', 's', 'z') THEN substr({cut(1)}, 2) "
        f"WHEN {m0('substr(w, 2)')} AND NOT {m1('substr(w, 2)')} AND {cvc('substr(w, 2)')} THEN substr(w, 2) || 'e' ELSE substr(w, 2) END",
        f"CASE WHEN ends_with(w, 'y') AND {vowel(cut(1))} THEN {cut(1)} || 'i' ELSE w END",
        swap(_STEP2), swap(_STEP3), f"CASE {' '.join(map(drop, sorted(_STEP4, key=len, reverse=True)))} ELSE w END",
        f"CASE WHEN ends_with(w, 'e') AND ({m1(cut(1))} OR {m0(cut(1))} AND NOT {cvc(cut(1))}) THEN {cut(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {m1('w')} THEN {cut(1)} ELSE w END",
    ]
    out = [f"stem0 AS (SELECT DISTINCT word, word AS w FROM {words})"]
    out += [f"stem{i + 1} AS (SELECT word, CASE WHEN length(word) > 2 AND regexp_full_match(word, '[a-z]+') THEN {step} ELSE w END AS w FROM stem{i})" for i, step in enumerate(steps)]
    return ", ".join([*out, f"stems AS (SELECT word, w AS stem FROM stem{len(steps)})"])


def english_sql(text: str) -> str:
    """A list of (word, pos) structs, as ``english_words`` has them of a text."""
    stop = ", ".join(f"'{w}'" for w in ENGLISH_STOP_WORDS)
    found = f"list_transform(regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}]+(?:[''’][\\p{{L}}\\p{{N}}]+)*'), lambda x: regexp_replace(x, '[''’]s$', ''))"
    return f"list_filter(list_transform({found}, lambda x, i: {{'word': x, 'pos': i - 1}}), lambda x: x.word NOT IN ({stop}))"
