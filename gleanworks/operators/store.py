"""The keyed store: upsert with sticky history, annotations, statuses, and what it surfaces."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanworks.functions import dates, text, vocab
from gleanworks.plans.config import Config

COLUMNS = (
    "id", "first_seen", "posted", "age_days", "score", "llm_score", "llm_note", "status", "salary", "company", "industry", "title",
    "department", "employment_type", "location", "source", "url", "signals", "dedup_key"
)


def tolerant_int(c: Column) -> Column:
    """A cell's whole part; 0 for anything that is no finite number."""
    x = c.cast("string").try_cast("double")
    return F.coalesce(F.when(F.abs(x) < 2147483647, x.cast("int")), F.lit(0))


def store_rows(postings: DataFrame, today: Column) -> DataFrame:
    """Linked postings as new store rows, all text."""
    age = dates.age_days(F.col("posted"), today)
    have = set(postings.columns)
    blank = lambda c: text.empty_if_null(F.col(c).cast("string")) if c in have else F.lit("")
    made = {
        "id": text.short_id(F.col("dedup_key")), "first_seen": F.date_format(today, "yyyy-MM-dd"),
        "age_days": F.coalesce(age.cast("string"), F.lit("")), "status": F.lit("new"), "llm_score": F.lit(""), "llm_note": F.lit(""),
        "title": F.trim(blank("title")), "location": F.trim(blank("location")),
        "source": F.array_join("sources", ", ") if "sources" in have else blank("source"), "dedup_key": F.col("dedup_key")
    }
    return postings.select(*((made[c] if c in made else blank(c)).alias(c) for c in COLUMNS))


def _last_by(df: DataFrame, key: str) -> DataFrame:
    """One row per key, the last in the store's order."""
    w = Window.partitionBy(key).orderBy(F.desc("_at"))
    return df.where(F.coalesce(F.col(key), F.lit("")) != "").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(store: DataFrame, run: DataFrame, order: str = "dedup_key") -> DataFrame:
    """Sticky rows stay; this run's rows take first_seen, status and notes over by key, else by URL; other rows go.

    A row that was retitled replaces its old key's. Adds is_new."""
    numbered = store.withColumn("_at", F.col(order))
    old = lambda key, tag: _last_by(numbered, key).select(F.col(key).alias(f"_{tag}"), *(F.col(c).alias(f"{tag}_{c}") for c in ("first_seen", "status", "llm_score", "llm_note", "dedup_key")))
    fresh = run.join(old("dedup_key", "k"), F.col("dedup_key") == F.col("_k"), "left").join(
        old("url", "u"), (F.col("url") == F.col("_u")) & F.col("_k").isNull(), "left"
    )
    of = lambda c: F.when(F.col("_k").isNotNull(), F.col(f"k_{c}")).otherwise(F.col(f"u_{c}"))
    known = F.col("_k").isNotNull() | F.col("_u").isNotNull()
    keep = lambda c, default: F.when(known, F.coalesce(F.nullif(of(c), F.lit("")), default)).otherwise(default)
    merged = fresh.withColumns(
        {
            "first_seen": keep("first_seen", F.col("first_seen")), "status": keep("status", F.col("status")),
            "llm_score": keep("llm_score", F.lit("")), "llm_note": keep("llm_note", F.lit("")), "is_new": ~known, "_old": of("dedup_key")
        }
    )
    replaced = merged.select(F.col("_old").alias("dedup_key")).where("dedup_key is not null").unionByName(merged.select("dedup_key")).distinct()
    sticky = _last_by(
        numbered.where(F.col("status").isin(*vocab.STICKY)), "dedup_key"
    ).drop("_at").join(replaced, "dedup_key", "left_anti").withColumn("is_new", F.lit(False))
    return merged.select(*COLUMNS, "is_new").unionByName(sticky.select(*COLUMNS, "is_new"))


def annotate(store: DataFrame, notes: DataFrame) -> DataFrame:
    """Graft llm_score and llm_note on by dedup_key."""
    n = notes.select("dedup_key", F.col("llm_score").alias("_s"), F.col("llm_note").alias("_n"))
    return store.join(n, "dedup_key", "left").withColumns(
        {"llm_score": F.coalesce("_s", "llm_score"), "llm_note": F.coalesce("_n", "llm_note")}
    ).drop("_s", "_n")


def mark_status(store: DataFrame, row_id: str, status: str) -> DataFrame:
    return store.withColumn("status", F.when(F.col("id") == row_id, status).otherwise(F.col("status")))


def has_id(store: DataFrame, row_id: str) -> bool:
    """Whether a status could be set: an id that no row has is a slip of the pen."""
    return not store.where(F.col("id") == row_id).limit(1).isEmpty()


def by_score(rows: DataFrame) -> DataFrame:
    """All rows, hidden ones too, by score down."""
    return rows.orderBy(tolerant_int(F.col("score")).desc(), "dedup_key")


def surface(rows: DataFrame, cfg: Config, only_new: bool = False, limit: int | None = None) -> DataFrame:
    """Visible rows with enough score and no excess of age; by the reviewer's score, else the score, down."""
    score, age = tolerant_int(F.col("score")), F.coalesce(F.col("age_days").cast("string"), F.lit(""))
    keep = ~F.coalesce(F.col("status").isin(*vocab.HIDDEN), F.lit(False)) & (score >= cfg.min_score) & ((age == "") | (tolerant_int(age) <= cfg.max_age_days))
    if only_new:
        keep = keep & F.col("is_new")
    llm = F.trim(F.coalesce(F.col("llm_score").cast("string"), F.lit("")))
    out = rows.where(keep).orderBy(F.when(llm.rlike("^[0-9]+$"), tolerant_int(llm)).otherwise(score).desc(), "dedup_key")
    return out.limit(limit) if limit else out


def guarded_csv(rows: DataFrame) -> DataFrame:
    """Every cell as text that no spreadsheet runs, sorted by score."""
    return by_score(rows).select(*(text.guarded(F.col(c)).alias(c) for c in COLUMNS))


def with_meta(df: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Left join of the watchlist on the company's normal form; of doubles the last wins."""
    w = Window.partitionBy("_nk").orderBy(F.desc("seq"))
    meta = watchlist.withColumn("_nk", text.norm(F.col("name"))).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(
        "_nk", "frontier", "local", F.col("industry").alias("_industry")
    )
    joined = df.withColumn("_nk", text.norm(F.col("company"))).join(meta, "_nk", "left")
    return joined.withColumn(
        "industry", F.coalesce(F.nullif(text.empty_if_null(F.col("industry")), F.lit("")), F.col("_industry"), F.lit(""))
    ).drop("_nk", "_industry")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
