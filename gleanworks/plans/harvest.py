"""From landed payloads to linked, scored postings: the whole batch plan, lazily."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanworks.operators import coerce, linkage, score, store
from gleanworks.plans.config import Config
from gleanworks.sources import payloads


def listed(
    df: DataFrame, name: str, cfg: Config, day: Column, details: DataFrame | None, keep: Callable[[Column], Column] | None = None
) -> DataFrame:
    """One source's rows with a title that is wanted (keep; else the configuration's): the gate comes before bodies
    are cleaned or details joined."""
    wanted = keep(F.coalesce("title", F.lit(""))) if keep else score.relevant(F.col("title"), cfg)
    rows = payloads.postings(df, name, **({"as_of": day} if name in ("workday", "google_jobs") else {})).where(wanted)
    if name not in payloads.DETAILS:
        return rows
    if details is not None:
        rows = payloads.with_details(rows, payloads.details(details, name))
    return rows.drop("detail_key")


def harvest(
    landed: dict[str, DataFrame], cfg: Config, watchlist: DataFrame, as_of: str, harvested_at: str,
    details: dict[str, DataFrame] | None = None, boards: DataFrame | None = None, keep: Callable[[Column], Column] | None = None,
    work: str | None = None
) -> DataFrame:
    """Project, coerce, gate (titles before bodies), score, link. landed: payloads by source; details likewise.

    boards: companies of the watchlist with their boards (one person's list, so it goes to every task), whose names
    are stamped on the rows of their boards. keep: a gate on titles in place of the configuration's. work: a shared folder
    for the scored rows, so that payloads are read once and linkage, which goes over the rows several times, reads
    the columns that it needs; without it the plan is lazy, and payloads are parsed for each of these.

    The union is observed (a count of the relevant rows), which also keeps the optimizer from writing all that
    follows into each of its branches: nineteen copies of the record contract would take minutes to compile."""
    day = F.lit(as_of).cast("date")
    if boards is not None:
        landed = {n: payloads.stamped(df, boards, n, strict=False) if n in payloads.DEPTH else df for n, df in landed.items()}
    rows = store.union_all([listed(df, name, cfg, day, (details or {}).get(name), keep) for name, df in landed.items()])
    rows = coerce.coerced(rows.observe("relevant", F.count(F.lit(1)).alias("rows")), harvested_at)
    rows = score.gated(coerce.with_arrangement(rows), cfg, day)
    rows = store.with_meta(rows, watchlist)
    rows = score.adjusted(score.with_score(rows, cfg), cfg, day)
    # arrival: lane and source in registry order, then payload, then position; a struct, so none runs into the next
    order = F.array_position(F.array(*(F.lit(s) for s in payloads.PROJECTIONS)), F.col("source"))
    rows = rows.withColumn("seq", F.struct(order.alias("source"), F.col("seq").alias("payload"), F.col("position").alias("position")))
    if work:
        rows.write.mode("overwrite").parquet(work)
        rows = rows.sparkSession.read.schema(rows.schema).parquet(work)
    linked = linkage.linked(rows, cfg.fuzzy_title_threshold, cfg.fuzzy_title_sort_floor)
    return linked.orderBy(F.desc("score"), linkage.source_preference(F.col("source")).desc(), "seq")
