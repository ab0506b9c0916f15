"""What a run publishes: nested records, a manifest, credits, a text rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanworks.operators.score import tier
from gleanworks.operators.store import tolerant_int
from gleanworks.plans.config import Config

# Credits that sources ask for (source, name, url, whether a link from each row is enough).
CREDITS = [
    ("remoteok", "Remote OK", "https://remoteok.com", True), ("remotive", "Remotive", "https://remotive.com", True),
    ("himalayas", "Himalayas", "https://himalayas.app", True), ("arbeitnow", "Arbeitnow", "https://www.arbeitnow.com", True),
    ("adzuna", "Adzuna", "https://www.adzuna.com", False)
]


def nested(df: DataFrame) -> DataFrame:
    """One struct per posting; empty text becomes null, nulls and empty lists stay apart."""
    c = lambda n: F.nullif(F.col(n), F.lit("")).alias(n)
    as_ = lambda n, alias: F.col(n).alias(alias)
    return df.select(
        "id", "dedup_key",
        F.struct(
            F.nullif("title", F.lit("")).alias("raw"), as_("title_root", "root"), as_("title_level", "level"),
            as_("title_qualifiers", "qualifiers")
        ).alias("title"),
        c("company"), "parent_company", "category", "team", "seniority", "seniority_basis", "tags",
        F.struct(F.nullif("location", F.lit("")).alias("raw"), "city", "state", "country", as_("locations", "all")).alias("location"),
        F.struct(
            as_("remote", "is_remote"), as_("remote_type", "type"), as_("remote_areas", "areas"), as_("remote_regions", "regions"),
            as_("remote_scope_raw", "raw"), as_("remote_basis", "basis")
        ).alias("remote"),
        c("posted"), "posted_basis", "expires", "harvested_at", "employment_type", "employment_type_raw",
        F.struct(
            F.nullif("salary", F.lit("")).alias("raw"), as_("salary_min", "min"), as_("salary_max", "max"),
            as_("salary_currency", "currency"), as_("salary_period", "period"), as_("salary_basis", "basis"),
            as_("salary_estimated_min", "estimated_min"), as_("salary_estimated_max", "estimated_max")
        ).alias("salary"),
        c("url"), "direct_apply", c("text"), c("source"), F.array_sort("sources").alias("sources"), "source_extra", "score", c("signals"), c("department"),
    )


def ndjson(df: DataFrame) -> DataFrame:
    """One line of JSON per posting; to_json alone would drop the nulls that consumers count on."""
    rows = nested(df)
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def by_source(df: DataFrame) -> DataFrame:
    """Rows that each source contributed to."""
    owned = F.when(F.size("sources") > 0, F.col("sources")).when(F.col("source") != "", F.array("source")).otherwise(F.array().cast("array<string>"))
    return df.select(F.explode(owned).alias("source")).groupBy("source").agg(F.count("*").alias("rows"))


def manifest(df: DataFrame, errors: DataFrame, cfg: Config, started_at: str, finished_at: str, discovered: int = 0) -> DataFrame:
    """One row about a run: totals, rows by source, failed sources, credits, configuration."""
    counts = by_source(df).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "rows")))).alias("rows_by_source"))
    totals = df.agg(F.count("*").alias("rows")).crossJoin(counts).crossJoin(
        errors.agg(F.count("*").alias("sources_failed"), F.array_sort(F.collect_list("error")).alias("errors"))
    )
    owed = F.filter(
        F.array(
            *(F.struct(F.lit(s).alias("source"), F.lit(n).alias("name"), F.lit(u).alias("url")) for s, n, u, _ in sorted(CREDITS, key=lambda x: x[1]))
        ),
        lambda x: F.array_contains(F.map_keys("rows_by_source"), x["source"])
    )
    own = F.struct(
        F.lit(cfg.remote_only).alias("remote_only"), F.lit(cfg.max_age_days).alias("max_age_days"), F.lit(cfg.min_score).alias("min_score")
    )
    return totals.select(
        F.lit("postings.manifest").alias("kind"), F.lit(started_at).alias("started_at"), F.lit(finished_at).alias("finished_at"), "rows",
        "rows_by_source", "sources_failed", "errors", F.lit(discovered).alias("companies_discovered"), owed.alias("attribution"),
        own.alias("config")
    )


def credits(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The credits owed for the sources that contributed."""
    table = spark.createDataFrame(CREDITS, "source string, name string, url string, row_link_suffices boolean")
    return table.join(by_source(df), "source", "left_semi").orderBy("name")


def credit_line(spark: SparkSession, df: DataFrame) -> str:
    """One line that names the sources owed, or nothing."""
    owed = credits(spark, df).collect()  # at most as many as there are sources with terms
    return "Jobs from " + ", ".join(f"{r['name']} ({r['url']})" for r in owed) if owed else ""


#: What the store keeps of its own; everything else of a record comes from the harvest.
HISTORY = ("id", "first_seen", "status", "llm_score", "llm_note", "age_days", "signals", "score")


def grafted(stored: DataFrame, harvested: DataFrame) -> DataFrame:
    """Store rows with the harvest's record fields by dedup_key: history from the store, the record from the harvest.

    Fields of the contract are overwritten even with null; body and sources stay the store's where a harvest has none."""
    kept = [c for c in stored.columns if c not in ("dedup_key", "text", "sources")]
    fields = [
        c for c in harvested.columns if c not in (*stored.columns, "dedup_key", "text", "sources", "id", "seq", "position", "frontier", "local")
    ]
    have = set(stored.columns)
    h = harvested.select("dedup_key", *(F.col(c).alias(f"_h_{c}") for c in (*fields, "text", "sources")))
    body = F.coalesce(F.nullif("_h_text", F.lit("")), *([F.col("text")] if "text" in have else []))
    own = F.col("sources") if "sources" in have else F.when(
        F.coalesce("source", F.lit("")) != "", F.split("source", ", ")
    ).otherwise(F.array().cast("array<string>"))
    sources = F.when(F.size("_h_sources") > 0, F.col("_h_sources")).otherwise(own)
    return stored.join(h, "dedup_key", "left").select(
        "dedup_key", *kept, *(F.col(f"_h_{c}").alias(c) for c in fields), body.alias("text"), sources.alias("sources")
    )


def summary(merged: DataFrame, surfaced: DataFrame, errors: int) -> DataFrame:
    """One row: roles tracked, on the shortlist, new among those, and feeds that failed."""
    seen = surfaced.agg(F.count("*").alias("shortlisted"), F.count_if(F.coalesce("is_new", F.lit(False))).alias("fresh"))
    return merged.agg(F.count("*").alias("tracked")).crossJoin(seen).withColumn("errors", F.lit(errors).cast("long"))


def line(cfg: Config) -> Column:
    """A store row as one line of text."""
    c = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(""))
    shown = F.when(c("llm_score") != "", c("llm_score")).otherwise(c("score"))
    rest = F.concat_ws(
        " · ", F.nullif(tier(tolerant_int(shown), cfg), F.lit("")), F.nullif(c("salary"), F.lit("")),
        F.when(c("age_days") != "", F.concat(c("age_days"), F.lit("d"))), F.when(~c("status").isin("", "new"), F.upper(c("status")))
    )
    head = F.concat(
        F.lit("  ["), c("id"), F.lit("] "), F.lpad(shown, 3, " "), F.lit("  "), F.rpad(c("title"), 52, " "), F.lit("  "),
        F.left(c("company"), F.lit(24))
    )
    note = F.when(c("llm_note") != "", F.concat(F.lit("\n        ↳ "), c("llm_note"))).otherwise("")
    return F.concat(head, F.when(rest != "", F.concat(F.lit("  "), rest)).otherwise(""), note)
