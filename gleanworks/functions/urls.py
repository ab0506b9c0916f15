"""Boards and openings that URLs name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanworks.functions.text import bound, empty_if_null

# Where each board's slug stands, in the order in which they are tried.
BOARDS = [
    ("greenhouse", r"(?:job-)?boards(?:\.eu)?\.greenhouse\.io/(?:embed/job_app\?for=)?([^/?#&]+)"),
    ("lever", r"jobs\.lever\.co/([^/?#&]+)"),
    ("ashby", r"jobs\.ashbyhq\.com/([^/?#&]+)"),
    ("workable", r"apply\.workable\.com/([^/?#&]+)"),
    ("smartrecruiters", r"jobs\.smartrecruiters\.com/([^/?#&]+)"),
    ("rippling", r"ats\.rippling\.com/([^/?#&]+)"),
    ("teamtailor", r"(?:https?://)?([a-z0-9-]+)\.teamtailor\.com"),
]
# Where an opening's id stands.
OPENINGS = {
    "greenhouse": [r"/jobs/(\d+)", r"[?&]gh_jid=(\d+)"],
    "lever": [r"jobs\.lever\.co/[^/?#]+/([0-9a-f-]{8,})"],
    "ashby": [r"jobs\.ashbyhq\.com/[^/?#]+/([0-9a-f-]{8,})"],
    "workable": [r"apply\.workable\.com/[^/?#]+/j/([a-z0-9]+)"],
    "smartrecruiters": [r"jobs\.smartrecruiters\.com/[^/?#]+/(\d+)"],
    "rippling": [r"ats\.rippling\.com/[^/?#]+/jobs/([0-9a-z-]{6,})"],
    "teamtailor": [r"teamtailor\.com/jobs/(\d+)"],
}
# Path parts that are no slug, and where a Workday board and a requisition stand.
NO_SLUGS = (
    "embed", "job_app", "j", "jobs", "robots", "robots.txt", "favicon.ico", "sitemap.xml", "api", "static", "assets", "index.html", "en-us",
    "www"
)
WORKDAY = r"(?i)^https?://([a-z0-9-]+)\.(wd\d+)\.myworkdayjobs\.com/(?:[A-Za-z]{2}-[A-Za-z]{2}/)?([A-Za-z0-9_-]+)"
REQUISITION = r"(?i)myworkdayjobs\.com/.*_([a-z]{0,4}\d{3,}(?:-\d+)?)(?:[/?#]|$)"
# Hosts that repost, and hosts of employers' own boards.
AGGREGATORS = (
    "linkedin.", "indeed.", "ziprecruiter.", "glassdoor.", "monster.", "bebee.", "jobleads.", "theladders.", "lensa.", "careerbuilder.",
    "talent.com", "jobrapido.", "bandana.", "snagajob.", "simplyhired.", "adzuna.", "jooble.", "trabajo."
)
DIRECT = (
    "greenhouse.io", "lever.co", "ashbyhq.com", "myworkdayjobs.com", "smartrecruiters.com", "workable.com", "rippling.com",
    "teamtailor.com", "icims.com", "taleo.net", "successfactors.com", "bamboohr.com", "jobvite.com", "breezy.hr", "recruitee.com",
    "personio.de", "usajobs.gov", "paylocity.com", "ultipro.com", "adp.com", "oraclecloud.com"
)


def found(c: Column, pattern: str) -> Column:
    """The first group, or null."""
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def _first_board(low: Column) -> Column:
    """(ats, slug, id) of the first known board; null without one. Each pattern runs once."""
    each = [
        F.struct(F.lit(ats).alias("ats"), found(low, pattern).alias("slug"), F.coalesce(*(found(low, p) for p in OPENINGS[ats])).alias("id")) for ats,
        pattern in BOARDS
    ]
    return F.get(F.filter(F.array(*each), lambda x: x["slug"].isNotNull() & ~x["slug"].isin("embed", "j", "www")), F.lit(0))


def board(url: Column) -> Column:
    """(ats, slug) of a known board, or null fields."""
    return bound(_first_board(F.lower(empty_if_null(url))), lambda x: F.struct(x["ats"].alias("ats"), x["slug"].alias("slug")))


def opening(url: Column) -> Column:
    """(ats, slug, id) of one opening, or null fields: null settles nothing."""
    u = empty_if_null(url)
    jid, req = found(u, r"[?&]gh_jid=(\d+)"), found(u, REQUISITION)

    def choose(x: Column) -> Column:
        own = F.struct(F.when(x["id"].isNotNull(), x["ats"]).alias("ats"), F.when(x["id"].isNotNull(), x["slug"]).alias("slug"), x["id"].alias("id"))
        other = F.struct(
            F.when(jid.isNotNull(), "greenhouse").when(req.isNotNull(), "workday").alias("ats"),
            F.when(F.coalesce(jid, req).isNotNull(), "").alias("slug"), F.coalesce(jid, req).alias("id")
        )
        return F.when(x.isNotNull(), own).otherwise(other)

    return bound(_first_board(F.lower(u)), choose)


def board_entry(url: Column) -> Column:
    """(ats, slug, host, site): all that its reader takes; a Workday site keeps its case."""
    u = empty_if_null(url)
    tenant, host, site = (F.regexp_extract(u, WORKDAY, i) for i in (1, 2, 3))
    at = board(url)
    ok = at["ats"].isNotNull() & ~at["slug"].isin(*NO_SLUGS)
    null = F.lit(None).cast("string")

    def entry(ats: Column, slug: Column, h: Column, s: Column) -> Column:
        return F.struct(ats.alias("ats"), slug.alias("slug"), h.alias("host"), s.alias("site"))

    return F.when(
        site != "",
        F.when(~F.lower(site).isin(*NO_SLUGS), entry(F.lit("workday"), F.lower(tenant), F.lower(host), site)).otherwise(entry(null, null, null, null))
    ).otherwise(entry(F.when(ok, at["ats"]), F.when(ok, F.lower(at["slug"])), null, null))


def entry_key(entry: Column) -> Column:
    """One string for a board's identity: Workday boards by host and site, too."""
    parts = [empty_if_null(entry["ats"]), F.lower(empty_if_null(entry["slug"]))]
    return F.when(
        entry["ats"] == "workday", F.concat_ws("/", *parts, F.lower(empty_if_null(entry["host"])), F.lower(empty_if_null(entry["site"])))
    ).otherwise(F.concat_ws("/", *parts))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(empty_if_null(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def _in(h: Column, names: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, names)), lambda n: F.contains(h, n))


def is_aggregator(url: Column) -> Column:
    return _in(host(url), AGGREGATORS)


def is_direct(url: Column, company: Column) -> Column:
    """A known board's host, or one that holds the company's name."""
    token = F.regexp_replace(F.lower(empty_if_null(company)), "[^a-z0-9]+", "")
    return _in(host(url), DIRECT) | ((F.length(token) >= 5) & F.contains(F.regexp_replace(host(url), "[^a-z0-9]", ""), token))


def best_link(links: Column, company: Column, fallback: Column) -> Column:
    """First direct link, else first that isn't an aggregator's, else first, else the fallback."""
    some = F.filter(links, lambda x: x.isNotNull() & (x != ""))
    first = lambda a: F.get(a, F.lit(0))
    return F.coalesce(
        first(F.filter(some, lambda x: is_direct(x, company))), first(F.filter(some, lambda x: ~is_aggregator(x))), first(some), fallback
    )
