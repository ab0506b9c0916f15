"""Relevance, gates, and the weighted-keyword score; built-in expressions alone, so codegen spans them."""

from __future__ import annotations

import re
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanworks.functions import arrangement, dates, places, text
from gleanworks.plans.config import Config


def _present(keyword: str, low: Column, padded: Column) -> Column:
    """A lone token is a plain substring of the padded tokens; a phrase has to pass that before its pattern runs."""
    tokens = " ".join(re.findall("[a-z0-9]+", keyword))
    if tokens == keyword:
        return padded.contains(f" {tokens} ") if " " not in keyword else padded.contains(f" {tokens} ") & text.whole_word(keyword, low)
    return (padded.contains(f" {tokens} ") & text.whole_word(keyword, low)) if tokens else text.whole_word(keyword, low)


def weight_sum(weights: dict[str, int], low: Column, padded: Column) -> Column:
    return reduce(add, (F.when(_present(k, low, padded), w).otherwise(0) for k, w in weights.items()), F.lit(0))


def relevant(title: Column, cfg: Config) -> Column:
    low = F.lower(text.empty_if_null(title))
    return ~text.any_whole_word(list(cfg.exclude_titles), low) & text.any_whole_word(list(cfg.title_signal), low)


def with_score(df: DataFrame, cfg: Config) -> DataFrame:
    """Adds score and signals to rows with title, location, text, company.

    A body is tokenised once, into one string that serves blob and agency sums. Score and signals come out of a
    generator: a filter on them stays above it, so Catalyst can't put the whole computation in their place again."""
    c = lambda n: text.empty_if_null(F.col(n))
    names = [n for n in df.columns if n not in ("score", "signals")]
    rows = df.select(*names).withColumns({
        "_text": F.lower(c("text")), "_head": F.lower(F.concat_ws(" ", c("title"), c("location"))), "_title": F.lower(c("title")), "_company": F.lower(c("company")),
    })
    rows = rows.withColumns({f"_p{n}": text.padded(F.col(n)) for n in ("_text", "_head", "_title", "_company")})
    joined = lambda a: F.concat(F.col(a), F.substr("_p_text", F.lit(2)))  # noqa: E731  one blank between the two
    rows = rows.withColumns(
        {
            "_pblob": joined("_p_head"), "_pagency": joined("_p_company"), "_blob": F.concat_ws(" ", "_head", "_text"),
            "_agency": F.concat_ws(" ", "_company", "_text")
        }
    )
    hits = F.filter(
        F.array(
            *(
                F.when(_present(k, F.col("_blob"), F.col("_pblob")), F.struct(F.lit(w).alias("w"), F.lit(k).alias("k"))) for k,
                w in cfg.fit_weights.items()
            )
        ),
        lambda x: x.isNotNull()
    )
    rows = rows.withColumns({"_hits": hits, "_dl": F.length("_pblob") - F.length(F.replace("_pblob", F.lit(" "), F.lit(""))) - 1})
    raw = F.aggregate("_hits", F.lit(0), lambda a, x: a + x["w"])
    norm = F.lit(1 - cfg.score_len_b) + F.lit(cfg.score_len_b) * (F.col("_dl") / F.lit(float(cfg.avg_jd_tokens)))
    body = F.least(
        F.when(norm > 0, raw * F.lit(cfg.score_k1 + 1) / (F.lit(1.0) + F.lit(cfg.score_k1) * norm)).otherwise(raw.cast("double")),
        F.lit(float(cfg.blob_score_cap))
    )
    body = body + F.least(weight_sum(cfg.fit_weights, F.col("_title"), F.col("_p_title")), F.lit(cfg.title_score_cap))
    body = body - weight_sum(cfg.title_penalty, F.col("_title"), F.col("_p_title")) - F.least(
        weight_sum(cfg.agency_penalty, F.col("_agency"), F.col("_pagency")), F.lit(cfg.agency_penalty_cap)
    )
    top = F.slice(F.sort_array("_hits", asc=False), 1, 7)
    scored = F.struct(F.bround(body).cast("int").alias("score"), F.array_join(F.transform(top, lambda x: x["k"]), ", ").alias("signals"))
    return rows.select(*names, F.inline(F.array(scored)))


def adjusted(df: DataFrame, cfg: Config, as_of: Column) -> DataFrame:
    """Frontier, local and stale adjustments of score and signals; needs frontier, local, title, posted."""
    low = F.lower(text.empty_if_null(F.col("title")))
    door = reduce(lambda a, b: a | b, (low.contains(x) for x in cfg.applied_door), F.lit(False))
    age = dates.age_days(F.col("posted"), as_of)
    far, near = F.coalesce("frontier", F.lit(False)) & ~door, F.coalesce("local", F.lit(False))
    old = F.coalesce(age > cfg.stale_after_days, F.lit(False))
    labels = F.concat_ws(
        ", ", F.when(near, "local"), F.when(far, "frontier-reach"), F.when(F.col("signals") != "", F.col("signals")),
        F.when(old, F.concat(age.cast("string"), F.lit("d-old")))
    )
    points = F.col("score") - F.when(far, cfg.frontier_penalty).otherwise(0) + F.when(near, cfg.local_bonus).otherwise(0) - F.when(old, dates.stale_penalty(age, cfg.stale_after_days)).otherwise(0)
    return df.withColumns({"score": points, "signals": labels})


def remote_gate(cfg: Config) -> Column:
    """Typed arrangement first, prose where it is unknown; then excluded places, then the stated boundary."""
    if not cfg.remote_only:
        return F.lit(True)
    c = F.col
    remote = F.when(c("remote_type").isNotNull(), c("remote_type") == "remote").otherwise(
        arrangement.mentions_remote(c("title"), c("location"), c("text"))
    )
    out = F.coalesce(c("country") != "US", F.lit(True)) & places.excluded(c("title"), c("location"), tuple(cfg.exclude_locations))
    return remote & ~out & places.scope_allowed(c("remote_areas"), c("remote_regions"), list(cfg.allowed_scopes))


def gated(df: DataFrame, cfg: Config, as_of: Column) -> DataFrame:
    """The gates, cheap before dear: each is its own filter, for Catalyst doesn't order them by cost."""
    age = dates.age_days(F.col("posted"), as_of)
    return df.where(text.empty_if_null(F.col("url")) != "").where(age.isNull() | (age <= cfg.max_age_days)).where(relevant(F.col("title"), cfg)).where(remote_gate(cfg))


def tier(score: Column, cfg: Config) -> Column:
    return F.when(score >= cfg.tier_strong, "★ strong").when(score >= cfg.tier_look, "◆ worth a look").otherwise("")
