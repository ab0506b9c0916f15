"""What a title states: level, qualifiers, seniority, root."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanworks.functions import vocab
from gleanworks.functions.text import empty_if_null

QUALIFIER = r"[(\[]([^)\]]*)[)\]]|,\s*([^,]+)$"


def _qualifier_texts(t: Column) -> Column:
    a, b = F.regexp_extract_all(t, F.lit(QUALIFIER), F.lit(1)), F.regexp_extract_all(t, F.lit(QUALIFIER), F.lit(2))
    return F.zip_with(a, b, lambda x, y: F.when(F.coalesce(x, F.lit("")) != "", x).otherwise(F.coalesce(y, F.lit(""))))


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(empty_if_null(c)), F.lit("[a-z0-9]+"), F.lit(0))


def levels(title: Column) -> Column:
    """The set of levels named anywhere, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(words(title), lambda w: vocab.lookup(vocab.MATCH_LEVELS, w)), lambda x: x.isNotNull())))


def qualifiers(title: Column) -> Column:
    """The set of words in brackets or behind the last comma, without levels and arrangement, sorted."""
    t = F.lower(empty_if_null(title))
    inside = F.flatten(F.transform(_qualifier_texts(t), lambda x: F.regexp_extract_all(x, F.lit("[a-z0-9]+"), F.lit(0))))
    return F.array_sort(F.array_distinct(F.filter(inside, lambda w: ~w.isin(*vocab.MATCH_LEVELS, *vocab.QUALIFIER_NOISE))))


def same_role(a: Column, b: Column) -> Column:
    """Whether nothing speaks against two titles meaning one role: levels equal, qualifiers too where the other title lacks them."""
    qa, qb = F.array_except(qualifiers(a), words(b)), F.array_except(qualifiers(b), words(a))
    return (levels(a) == levels(b)) & (F.array_sort(qa) == F.array_sort(qb))


def decompose(title: Column) -> Column:
    """(root, level, qualifiers, seniority). Seniority words count only in front of something, and not before ``of``."""
    t = F.trim(empty_if_null(title))
    toks = F.regexp_extract_all(F.regexp_replace(t, "(?i)" + QUALIFIER, ""), F.lit("[A-Za-z0-9+#/&]+"), F.lit(0))
    low = F.transform(toks, F.lower)
    # the leading words that are decoration: stop at the first that isn't
    lead = F.transform(low, lambda w, i: w.isin(*vocab.SENIORITY) & (i < F.size(low) - 1) & (F.coalesce(F.get(low, i + 1), F.lit("")) != "of"))
    first = F.coalesce(F.nullif(F.array_position(lead, F.lit(False)), F.lit(0)) - 1, F.size(low)).cast("int")
    seniority = F.when(first > 0, vocab.lookup(vocab.SENIORITY, F.get(low, F.lit(0))))
    rest = F.slice(toks, first + 1, F.greatest(F.size(toks) - first, F.lit(0)))
    marks = F.transform(rest, lambda w: vocab.lookup(vocab.LEVELS, F.lower(w)))
    level_at = F.get(F.filter(F.transform(marks, lambda m, i: F.when(m.isNotNull(), i)), lambda x: x.isNotNull()), F.lit(0))
    kept = F.filter(rest, lambda w, i: (F.coalesce(i != level_at, F.lit(True))) & ~F.lower(w).isin(*vocab.TITLE_NOISE))
    root = F.regexp_replace(F.array_join(kept, " "), r"^[ \-–—,/]+|[ \-–—,/]+$", "")
    pieces = F.flatten(F.transform(_qualifier_texts(F.lower(t)), lambda x: F.split(x, "[(),]")))
    quals = F.filter(F.transform(pieces, lambda x: F.trim(x)), lambda q: (q != "") & ~q.isin(*vocab.TITLE_NOISE))
    return F.struct(
        F.when(root != "", root).otherwise(t).alias("root"), F.get(marks, level_at).alias("level"),
        F.when(F.size(quals) > 0, quals).alias("qualifiers"), seniority.alias("seniority")
    )
