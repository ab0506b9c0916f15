"""Text keys and predicates of postings, as Column expressions."""

from __future__ import annotations

import html
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanworks.functions import vocab


def empty_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), with c evaluated once however often use names it (a lambda's variable isn't inlined)."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def norm(c: Column) -> Column:
    """Lower case, runs of anything but a-z, 0-9 a blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(empty_if_null(c)), "[^a-z0-9]+", " "))


def norm_location(c: Column) -> Column:
    """The first of several places, without words of arrangement."""
    first = F.lower(F.split_part(empty_if_null(c), F.lit(";"), F.lit(1)))
    return F.trim(
        F.regexp_replace(F.regexp_replace(first, r"\b(remote|onsite|on site|hybrid|wfh|telecommute|anywhere|flexible)\b", " "), "[^a-z0-9]+", " ")
    )


def company_block(c: Column) -> Column:
    """The blocking key: the normal form without corporate suffixes (inner blanks stay)."""
    return F.trim(F.regexp_replace(norm(c), r"\b(inc|llc|ltd|corp|co|company|the)\b", ""))


def title_core(c: Column) -> Column:
    """The normal form without words of arrangement, unless nothing else is left."""
    whole = norm(c)
    core = F.array_join(F.filter(F.split(whole, " "), lambda w: ~w.isin(*vocab.TITLE_NOISE)), " ")
    return F.when(core != "", core).otherwise(whole)


def short_id(key: Column) -> Column:
    return F.left(F.sha1(key), F.lit(7))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(empty_if_null(c)), F.lit("[a-z0-9]+"), F.lit(0))


def padded(low: Column) -> Column:
    """The a-z, 0-9 tokens of lower-cased text, a blank on either side of each: membership is a plain search."""
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), "[^a-z0-9]+", " ")


def java_quote(s: str) -> str:
    return re.sub(r"([^A-Za-z0-9 ])", r"\\\1", s)


def whole_word(keyword: str, low: Column) -> Column:
    """Whether lower-cased text holds the keyword with no a-z, 0-9 beside it; the plain search settles most."""
    return low.contains(keyword) & low.rlike(f"(?<![a-z0-9]){java_quote(keyword)}(?![a-z0-9])")


def any_whole_word(keywords: list[str], low: Column) -> Column:
    """One alternation instead of one pattern for each keyword."""
    if not keywords:
        return F.lit(False)
    return low.rlike("(?<![a-z0-9])(?:" + "|".join(java_quote(k) for k in sorted(keywords, key=len, reverse=True)) + ")(?![a-z0-9])")


def _unescaped(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def clean(c: Column, entities: tuple[str, ...] = (), blanks: str = r"(?U)\s+") -> Column:
    """Tags become blanks, then entities their characters, then Unicode blanks collapse.

    All entities of HTML, those that lack their semicolon too (``&amp`` in a text that was cut); if some are named, these
    alone, and only with their semicolon."""
    named = re.compile(f"&(?:{'|'.join(map(re.escape, entities))});")

    def some(s: pd.Series) -> pd.Series:
        return s.map(lambda x: named.sub(lambda m: html.unescape(m[0]), x), na_action="ignore")

    tagless = F.regexp_replace(empty_if_null(c), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(F.pandas_udf(some if entities else _unescaped, "string")(tagless), blanks, " "))


def strip_arrangement(c: Column) -> Column:
    """Without words of arrangement and the brackets they leave: up to four passes, as brackets empty inside out."""
    for _ in range(4):
        c = F.regexp_replace(c, r"(?i)(?<![a-z])(?:remote|hybrid|onsite|on-site|wfh|work from home|telecommute)(?![a-z])|\(\s*\)|\[\s*\]", " ")
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"^[ ,\-–—|/]+|[ ,\-–—|/]+$", "")


def guarded(c: Column) -> Column:
    """A cell that no spreadsheet takes for a formula; null is empty."""
    s = empty_if_null(c.cast("string"))
    return F.when(F.substring(s, 1, 1).isin("=", "+", "-", "@", "\t", "\r"), F.concat(F.lit("'"), s)).otherwise(s)


def is_prose(c: Column) -> Column:
    """200 characters, 20 blanks, and no URL at the front."""
    return (F.length(c) >= 200) & (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) >= 20) & ~c.startswith("http")


# Words that a company's name is compared without, and those of them that are legal forms.
TRADE = r"(?i)\b(inc|llc|l\.l\.c|ltd|limited|corp|corporation|co|company|the|group|holdings|plc|gmbh|sa|nv|ag|pte|pty|llp|lp)\b"
LEGAL = r"(?i)\b(inc|llc|l\.l\.c|ltd|limited|corp|corporation|co|plc|gmbh|sa|nv|ag|pte|pty|llp|lp)\b"


def _spaced(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, " +", " "))


def name_norm(c: Column) -> Column:
    """A company's name for comparison: lower case, no punctuation, no trade words."""
    return _spaced(F.regexp_replace(F.regexp_replace(F.lower(empty_if_null(c)), "[^a-z0-9 ]+", " "), TRADE, " "))


def name_variants(c: Column, aggressive: bool = False) -> Column:
    """Slugs a company may have: flat, dashed, and if aggressive its first word; 3 to 39 characters.

    A name that trade words alone cut down to one word is as generic as a first word: only if aggressive."""
    base = name_norm(c)
    left = _spaced(F.regexp_replace(F.regexp_replace(F.lower(empty_if_null(c)), "[^a-z0-9 ]+", " "), LEGAL, " "))
    risky = ~base.contains(" ") & left.contains(" ")
    flat, dashed = F.replace(base, F.lit(" "), F.lit("")), F.replace(base, F.lit(" "), F.lit("-"))
    found = F.array(flat, dashed, F.split_part(base, F.lit(" "), F.lit(1))) if aggressive else F.when(risky, F.array().cast("array<string>")).otherwise(F.array(flat, dashed))
    return F.array_distinct(F.filter(found, lambda s: (F.length(s) >= 3) & (F.length(s) <= 39)))
