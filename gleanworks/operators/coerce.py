"""The record contract: every posting leaves with all columns, typed, null where nothing was stated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanworks.functions import arrangement, places, text, titles, vocab
from gleanworks.sources.payloads import DEPTH

REQUIRED = ("title", "company", "url", "source", "industry")
TEXTS = ("posted", "salary", "text", "location", "department", "employment_type")
STRINGS = (
    "title_root", "title_level", "category", "team", "parent_company", "city", "state", "country", "remote_type", "remote_basis",
    "remote_scope_raw", "salary_currency", "salary_period", "salary_basis", "employment_type_raw", "seniority", "seniority_basis",
    "posted_basis", "expires", "harvested_at"
)
NUMBERS = ("salary_min", "salary_max", "salary_estimated_min", "salary_estimated_max")
ARRAYS = ("title_qualifiers", "tags", "remote_areas", "remote_regions")
LOCATION = "array<struct<raw:string,city:string,state:string,country:string,url:string>>"
#: Sources whose links lead to an application at the employer, besides the employers' own boards.
DIRECT_SOURCES = ("usajobs",)


def _complete(df: DataFrame) -> DataFrame:
    """All contract columns with their types."""
    have = set(df.columns)
    get = lambda c, t: F.col(c).cast(t) if c in have else F.lit(None).cast(t)
    out: dict[str, Column] = {c: F.coalesce(get(c, "string"), F.lit("")) for c in REQUIRED}
    out |= {c: F.nullif(get(c, "string"), F.lit("")) for c in (*TEXTS, *STRINGS)}
    out |= {c: get(c, "double") for c in NUMBERS} | {c: get(c, "array<string>") for c in ARRAYS}
    out |= {
        "remote": get("remote", "boolean"), "direct_apply": get("direct_apply", "boolean"), "locations": get("locations", LOCATION),
        "source_extra": get("source_extra", "map<string,string>")
    }
    return df.withColumns(out)


def coerced(df: DataFrame, harvested_at: str) -> DataFrame:
    """Types, then title, arrangement, country, state, geography, locations, employment, in this order."""
    df = _complete(df)
    c = F.col
    parsed = titles.decompose(c("title"))
    df = df.withColumn("_t", parsed).withColumns(
        {
            "title_root": c("_t.root"), "title_level": F.coalesce("title_level", c("_t.level")),
            "title_qualifiers": F.coalesce("title_qualifiers", c("_t.qualifiers")),
            "seniority_basis": F.when(
                c("seniority").isNotNull(), F.coalesce("seniority_basis", F.lit("stated"))
            ).when(c("_t.seniority").isNotNull(), "title"),
            "seniority": F.coalesce("seniority", c("_t.seniority")), "remote": c("remote_type") == "remote",
            "country": vocab.country_code(c("country"))
        }
    ).drop("_t")
    df = df.withColumn("state", F.when(c("country") == "US", F.coalesce(vocab.us_state_code(c("state")), c("state"))).otherwise(c("state")))
    first = F.split_part(text.empty_if_null(c("location")), F.lit(";"), F.lit(1))
    bare = places.split_place(text.strip_arrangement(first))
    plain = places.split_place(first)
    unread = bare["city"].isNull() & bare["state"].isNull() & bare["country"].isNull()
    none = c("city").isNull() & c("state").isNull() & c("country").isNull()
    df = df.withColumn("_none", none).withColumn("_p", F.when(unread, plain).otherwise(bare))
    df = df.withColumns({k: F.when(c("_none"), c(f"_p.{k}")).otherwise(c(k)) for k in ("city", "state", "country")}).drop("_p", "_none")
    parts = F.filter(F.transform(F.split(text.empty_if_null(c("location")), ";"), lambda x: F.trim(x)), lambda x: x != "")

    def located(raw: Column, city: Column, state: Column, country: Column) -> Column:
        return F.struct(raw.alias("raw"), city.alias("city"), state.alias("state"), country.alias("country"), c("url").alias("url"))

    one = F.array(located(F.get(parts, F.lit(0)), c("city"), c("state"), c("country")))
    many = F.transform(parts, lambda x: located(x, places.split_place(x)["city"], places.split_place(x)["state"], places.split_place(x)["country"]))
    df = df.withColumn("locations", F.coalesce("locations", F.when(F.size(parts) > 1, many).when(F.size(parts) == 1, one)))
    kind = vocab.employment_type(c("employment_type"))
    closed = c("employment_type").isin(*sorted({*vocab.EMPLOYMENT.values(), "OTHER"}))
    unset = c("employment_type_raw").isNull()
    df = df.withColumns(
        {
            "employment_type": F.when(unset, F.when(closed, c("employment_type")).otherwise(kind)).otherwise(c("employment_type")),
            "employment_type_raw": F.when(
                unset & ~F.coalesce(closed, F.lit(False)), F.nullif(F.trim("employment_type"), F.lit(""))
            ).otherwise(c("employment_type_raw"))
        }
    )
    return df.withColumns(
        {
            "direct_apply": F.coalesce("direct_apply", F.when(c("source") != "", c("source").isin(*DEPTH, *DIRECT_SOURCES))),
            "harvested_at": F.coalesce("harvested_at", F.lit(harvested_at))
        }
    )


def with_arrangement(df: DataFrame) -> DataFrame:
    """Fill arrangement and boundary from the posting's own text where the source stated none.

    It reads whole bodies: call it behind the title gate."""
    c = F.col
    df = df.withColumn("_s", F.when(c("remote_type").isNull(), arrangement.signal(c("title"), c("location"), c("text")))).withColumn(
        "_r", F.when(c("remote_areas").isNull() & c("remote_regions").isNull(), places.remote_scope(c("location")))
    )
    df = df.withColumns(
        {
            "remote_basis": F.when(c("remote_type").isNull() & c("_s.type").isNotNull(), c("_s.basis")).otherwise(c("remote_basis")),
            "remote_type": F.coalesce("remote_type", c("_s.type")), "remote_areas": F.coalesce("remote_areas", c("_r.areas")),
            "remote_regions": F.coalesce("remote_regions", c("_r.regions")),
            "remote_scope_raw": F.coalesce("remote_scope_raw", F.nullif("location", F.lit("")))
        }
    )
    return df.withColumn("remote", c("remote_type") == "remote").drop("_s", "_r")
