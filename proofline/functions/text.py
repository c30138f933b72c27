"""Text normalisation, similarity and word differences as Column expressions; Arrow UDFs where Spark has no such function (NFKC and case folding, common subsequences, matching blocks)."""

from __future__ import annotations

import difflib
import functools
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from proofline import constants as K

#: White space as Python has it: Java's Unicode class, and U+001C to U+001F.
SPACE = r"(?U)[\s\x1c-\x1f]"
#: Longest text, in characters, whose word differences are remembered.
REMEMBERED = 2_000


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: a one-element array stands for a name, which the optimiser does not open."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    """NFKC, then full case folding; plain ASCII needs only lower case."""
    return text.map(lambda t: t if t is None else t.lower() if t.isascii() else unicodedata.normalize("NFKC", t).casefold())


@F.pandas_udf(StringType())
def case_folded(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else t.casefold())


def identified(folded_text: Column) -> Column:
    """Punctuation of a folded text set aside; every word kept."""
    plain = F.translate(folded_text, K.APOSTROPHES, "")
    return collapse_whitespace(F.regexp_replace(plain, r"[^\p{L}\p{N}]", " "))


def identity(text: Column) -> Column:
    """Case, compatibility forms and punctuation set aside; every word kept."""
    return identified(folded(text))


def without_suffixes(identified: Column) -> Column:
    """Trailing legal suffixes removed, again and again, but never all words."""
    return F.regexp_replace(identified, rf"(?<=\S)(?: (?:{'|'.join(K.LEGAL_SUFFIXES)}))+$", "")


def _without_prefix(identified: Column, prefixes: tuple[str, ...]) -> Column:
    return F.regexp_replace(identified, rf"^(?:{'|'.join(prefixes)})(?: |$)", "")


def fuzzy(text: Column) -> Column:
    return without_suffixes(identity(text))


def bottler(text: Column) -> Column:
    return _without_prefix(identity(text), K.BOTTLER_PREFIXES)


def without_origin_prefix(identified_text: Column) -> Column:
    return _without_prefix(identified_text, K.ORIGIN_PREFIXES)


def origin(text: Column) -> Column:
    return without_origin_prefix(identity(text))


def compact(text: Column) -> Column:
    """Spaces removed: readers lose them."""
    return F.replace(text, F.lit(" "), F.lit(""))


def is_origin_placeholder(text: Column) -> Column:
    return collapse_whitespace(folded(text)).isin(*K.ORIGIN_PLACEHOLDERS)


def has_origin_value(text: Column) -> Column:
    return F.coalesce((collapse_whitespace(text) != "") & ~is_origin_placeholder(text), F.lit(False))


def warning(text: Column) -> Column:
    """Ligatures, hyphenated line ends and misread l, I and 1 repaired; case kept."""
    for ligature, letters in K.LIGATURES.items():
        text = F.replace(text, F.lit(ligature), F.lit(letters))
    for pattern, to in ((r"(?<=[A-Za-z])-[ \t]*\r?\n[ \t]*(?=[A-Za-z])", ""), (r"(?<=[a-z])[1I](?=[a-z])", "l"), (r"(?<=[A-Z])[1l](?=[A-Z])", "I"), (r"\([Il]\)", "(1)")):
        text = F.regexp_replace(text, pattern, to)
    return collapse_whitespace(text)


def warning_prefix(text: Column) -> Column:
    return F.substring(warning(text), 1, len(K.WARNING_PREFIX))


def beverage_class(text: Column, identified: bool = False) -> Column:
    """The class of the keyword with the most words; of equals, the earlier class. Null if there is none."""
    padded = F.concat(F.lit(" "), text if identified else identity(text), F.lit(" "))
    by_words: dict[int, list[tuple[str, list[str]]]] = {}
    for name, keywords in K.BEVERAGE_KEYWORDS.items():
        for n in {len(k.split()) for k in keywords}:
            by_words.setdefault(n, []).append((name, [k for k in keywords if len(k.split()) == n]))
    found = F.lit(None).cast("string")
    for n in sorted(by_words):
        for name, keywords in reversed(by_words[n]):
            found = F.when(padded.rlike(f" (?:{'|'.join(keywords)}) "), name).otherwise(found)
    return found


def keyword_score(identified: Column) -> Column:
    """(words of the longest keyword, number of keywords) of a line; null without any."""
    return padded_score(F.concat(F.lit(" "), identified, F.lit(" ")))


def padded_score(padded: Column) -> Column:
    """`keyword_score` of a line with a space before and after it."""
    keywords = [k for ks in K.BEVERAGE_KEYWORDS.values() for k in ks]
    hits = functools.reduce(lambda a, b: a + b, (padded.contains(f" {k} ").cast("int") for k in keywords))
    words = F.lit(0)
    for n in sorted({len(k.split()) for k in keywords}):
        words = F.when(padded.rlike(f" (?:{'|'.join(k for k in keywords if len(k.split()) == n)}) "), n).otherwise(words)
    return F.when(words > 0, F.struct(words.alias("words"), hits.alias("hits")))


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence of two texts: a bit of one integer for each character of a, a step for each of b."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        if mask := masks.get(c):
            both = row & mask
            row = ((row + both) | (row - both)) & full
    # Bits that were turned off are common characters.
    return len(a) - row.bit_count()


def _sorted_ratio(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    a, b = (" ".join(sorted(t.split())) for t in (a, b))
    return 100.0 if a == b else 200.0 * common_length(a, b) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 times the indel similarity of the texts with their words sorted; null if either is."""
    return pd.Series([_sorted_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="object")


@functools.lru_cache(maxsize=1024)
def _told(expected: str, found: str) -> str:
    """Where the words of two texts differ, as difflib matches them. Readers make the same error often, so the last texts are remembered, short as warnings are."""
    a, b, said = re.findall(K.WARNING_TOKEN, expected), re.findall(K.WARNING_TOKEN, found), []
    for kind, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        old, new = f"[{' '.join(a[i:j])}]", f"[{' '.join(b[k:m])}]"
        if kind != "equal":
            said.append({"delete": f"missing expected {old}", "insert": f"unexpected extracted {new}", "replace": f"replace expected {old} with extracted {new}"}[kind])
    return "; ".join(said)


@F.pandas_udf(StringType())
def _differences(expected: pd.Series, found: pd.Series) -> pd.Series:
    told = lambda x, y: None if y is None else (_told if len(y) <= REMEMBERED else _told.__wrapped__)(x, y)
    return pd.Series([told(x, y) for x, y in zip(expected, found, strict=True)], dtype="object")


def word_level_diff(expected: str, found: Column) -> Column:
    """Where a text's words differ from those of a fixed text, said from the fixed text's side; empty if the texts are equal."""
    return _differences(F.lit(expected), found)


def field_label(name: Column) -> Column:
    """A check's label; an unknown check's name with spaces and a capital."""
    known = F.create_map(*(F.lit(x) for pair in K.CHECKS.items() for x in pair))
    words = F.lower(F.replace(name, F.lit("_"), F.lit(" ")))
    return F.coalesce(known[name], F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, F.lit(2), F.length(words))))


def filename_key(name: Column) -> Column:
    return case_folded(name)


def one_line(text: Column) -> Column:
    return F.coalesce(F.nullif(collapse_whitespace(text), F.lit("")), F.lit("unknown error"))


def control_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
