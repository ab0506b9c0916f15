"""Finding boards: mine URLs, match names, probe, and learn from postings; and statistics of sources.

What needs the network takes a function for it; everything else is a plan over rows.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanworks.functions import text, urls
from gleanworks.operators import score
from gleanworks.plans.config import Config

# Boards whose service tells who owns them.
OWNER_TOLD = ("greenhouse",)


def with_entry(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds ats, slug, host, site of the board that the URL names, and its key; rows without one go."""
    entry = urls.board_entry(F.col(url))
    rows = df.withColumn("_e", entry).where("_e.ats is not null")
    return rows.withColumns(
        {c: F.col(f"_e.{c}") for c in ("ats", "slug", "host", "site")}
    ).withColumn("entry_key", urls.entry_key(F.col("_e"))).drop("_e")


def mined(lines: DataFrame) -> DataFrame:
    """Distinct boards of a crawl index: lines of JSON with a url; lines that don't parse are skipped."""
    found = lines.select(F.get_json_object("value", "$.url").alias("url")).where("url is not null")
    return with_entry(found).groupBy("entry_key").agg(*(F.min(c).alias(c) for c in ("ats", "slug", "host", "site")))


def outcome(supported: Column, status: Column, roles: Column, owner_ok: Column | None = None) -> Column:
    """What a probe's answer means: ok, or why not; refused and wrong owners needn't be asked again."""
    owner_ok = owner_ok if owner_ok is not None else F.lit(True)
    return (
        F.when(~supported, "unsupported").when(status.isNull(), "error").when(status.isin(401, 403), "refused").when(status == 429, "throttled")
        .when(status >= 400, "missing").when(F.coalesce(roles, F.lit(0)) == 0, "empty").when(~owner_ok, "wrong-owner").otherwise("ok")
    )


def probed(candidates: DataFrame, ask: Callable[[str, str], tuple[int | None, int, str | None]], known: tuple[str, ...]) -> DataFrame:
    """Ask for each candidate (status, roles, owner) and name the outcome; one board's failure is its own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for ats, slug in zip(pdf["ats"], pdf["slug"], strict=True):
                try:
                    rows.append(ask(ats, slug) if ats in known else (None, 0, None))
                except Exception:  # noqa: BLE001  an answer that can't be read is an outcome, too
                    rows.append((None, 0, None))
            yield pdf.assign(status=pd.array([r[0] for r in rows], "Int32"), roles=[int(r[1] or 0) for r in rows], owner=[r[2] for r in rows])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema) + ", status int, roles int, owner string"
    rows = candidates.mapInPandas(run, schema)
    return rows.withColumn(
        "outcome",
        outcome(
            F.col("ats").isin(*known), F.col("status"), F.col("roles"),
            same_owner(F.col("ats"), F.col("owner"), F.col("name")) if "name" in candidates.columns else None
        )
    )


def same_owner(ats: Column, owner: Column, company: Column) -> Column:
    """Whether the owner that a board tells is the company; boards that don't tell pass, unconfirmed ones don't."""
    a, b = text.name_norm(owner), text.name_norm(company)
    flat = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    told = (text.empty_if_null(owner) != "") & ((a == b) | (flat(a) == flat(b)))
    return ~ats.isin(*OWNER_TOLD) | (text.empty_if_null(company) == "") | told


def match_known(names: DataFrame, universe: DataFrame) -> DataFrame:
    """Names (seq, name) with boards of a universe (seq, ats, slug) by exact slug variants.

    First wins: a board goes to the first name and variant that reach it, and a variant takes one board."""
    boards = universe.groupBy("ats", F.lower("slug").alias("slug")).agg(F.min("seq").alias("at"))
    tried = names.select(F.col("seq").alias("n"), "name", F.posexplode(text.name_variants(F.col("name"))).alias("v", "slug"))
    pairs = tried.join(boards, "slug")
    # variants of one slug compete for its boards in order: the i-th contender gets the i-th board
    order = Window.partitionBy("slug").orderBy("n", "v")
    rank = Window.partitionBy("slug").orderBy("at")
    want = pairs.select("slug", "n", "v", "name").distinct().withColumn("i", F.row_number().over(order))
    have = boards.join(tried.select("slug").distinct(), "slug", "left_semi").withColumn("i", F.row_number().over(rank))
    return want.join(have, ["slug", "i"]).select("n", "name", "ats", "slug")


def unknown(postings: DataFrame, known: DataFrame) -> DataFrame:
    """The first posting (by seq) of each company that isn't among the known names."""
    keyed = postings.withColumn("_nk", text.norm(F.col("company")))
    fresh = keyed.join(known.select(text.norm(F.col("name")).alias("_nk")).distinct(), "_nk", "left_anti")
    names = [c for c in postings.columns]
    return fresh.groupBy("_nk").agg(F.min_by(F.struct(*names), "seq").alias("x")).select("x.*")


def funnel(postings: DataFrame, known: DataFrame, boards: DataFrame, cfg: Config, probes: int = 50) -> DataFrame:
    """Boards worth a probe: of relevant postings of unknown companies, not known themselves; the feature's own limit."""
    rows = unknown(with_entry(postings.where(score.relevant(F.col("title"), cfg))), known)
    fresh = rows.join(boards.select("entry_key"), "entry_key", "left_anti")
    first = fresh.groupBy("entry_key").agg(
        F.min_by(F.struct("seq", "company", "ats", "slug", "host", "site"), "seq").alias("x")
    ).select("entry_key", "x.*")
    return first.orderBy("seq").limit(probes)


def seeded(mined_boards: DataFrame, watchlist: DataFrame, limit: int) -> DataFrame:
    """Mined boards that the watchlist lacks, in the slug's order."""
    return mined_boards.join(watchlist.select("entry_key"), "entry_key", "left_anti").orderBy(F.lower("slug"), "entry_key").limit(limit)


Ask = Callable[[str, str], tuple[int | None, int, str | None]]


def discovered(boards: DataFrame, known: DataFrame, ask: Ask, services: tuple[str, ...]) -> DataFrame:
    """Boards that nobody knows yet and that are alive, those with most roles first."""
    fresh = boards.join(known.select("entry_key").distinct(), "entry_key", "left_anti")
    return probed(fresh, ask, services).where("outcome = 'ok'").orderBy(F.desc("roles"), "entry_key")


def guesses(names: DataFrame, services: tuple[str, ...], known: DataFrame) -> DataFrame:
    """(at, ats, slug, name): slugs that a company (seq, name) may have at each service, each guess once, known boards not.

    A bare first word is tried only where the service tells who owns a board."""
    each = names.select(F.col("seq").alias("n"), "name", F.posexplode(F.array(*map(F.lit, services))).alias("a", "ats"))
    bold = F.col("ats").isin(*OWNER_TOLD)
    tried = each.select(
        "n", "a", "ats", "name",
        F.posexplode(F.when(bold, text.name_variants(F.col("name"), aggressive=True)).otherwise(text.name_variants(F.col("name")))).alias("v", "slug")
    )
    first = tried.groupBy("ats", "slug").agg(F.min(F.struct("n", "a", "v", "name")).alias("x"))
    fresh = first.withColumn("entry_key", F.concat_ws("/", "ats", "slug")).join(known.select("entry_key").distinct(), "entry_key", "left_anti")
    return fresh.select((F.col("x.n").cast("long") * 10_000 + F.col("x.a") * 100 + F.col("x.v")).alias("at"), "ats", "slug", "x.name", "entry_key")


def from_names(names: DataFrame, services: tuple[str, ...], known: DataFrame, ask: Ask) -> DataFrame:
    """Boards guessed from names that are alive and, where the service tells, the company's own; most roles first."""
    rows = guesses(names, services, known)
    return probed(rows, ask, services).where("outcome = 'ok'").orderBy(F.desc("roles"), "at").drop("at")


def seeded_alive(mined_boards: DataFrame, watchlist: DataFrame, limit: int, ask: Ask, services: tuple[str, ...]) -> DataFrame:
    """As seeded, with a probe: slices in the slug's order are asked until limit boards have answered."""
    spark = mined_boards.sparkSession
    ordered = mined_boards.join(watchlist.select("entry_key"), "entry_key", "left_anti").orderBy(F.lower("slug"), "entry_key")
    step, at, found = max(limit, 50), 0, []
    while len(found) < limit:
        part = ordered.offset(at).limit(step)
        rows = probed(part, ask, services).orderBy(F.lower("slug"), "entry_key").collect()  # at most `step` rows
        if not rows:
            break
        found += [r.asDict() for r in rows if r["outcome"] == "ok"]
        at += step
    schema = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in mined_boards.schema
    ) + ", status int, roles int, owner string, outcome string"
    return spark.createDataFrame(found[:limit], schema)


def watch_entries(boards: DataFrame, industry: str, name: str = "slug") -> DataFrame:
    """Boards as entries of a watchlist."""
    have = set(boards.columns)
    c = lambda n: F.col(n) if n in have else F.lit(None).cast("string")
    return boards.select(
        F.col(name).alias("name"), "ats", "slug", c("host").alias("host"), c("site").alias("site"), F.lit(industry).alias("industry"),
        "entry_key"
    )


def append_watchlist(entries: DataFrame, path: str) -> list[dict]:
    """Add entries to a watchlist file, each board once; a shipped example is never touched. What was added.

    A watchlist is one person's file, and what a run adds is bounded by the funnel's own limits."""
    if path.endswith(".example.json"):
        return []
    with open(path, encoding="utf-8") as f:
        doc = json.load(f)

    def key(e: dict) -> str:
        parts = [e.get("ats") or "", (e.get("slug") or "").lower()]
        return "/".join(parts + ([(e.get("host") or "").lower(), (e.get("site") or "").lower()] if e.get("ats") == "workday" else []))

    have, added = {key(e) for e in doc.get("companies", [])}, []
    for row in entries.collect():
        entry = {k: v for k, v in row.asDict().items() if v is not None and k in ("name", "ats", "slug", "host", "site", "industry")}
        if key(entry) not in have:
            have.add(key(entry))
            added.append(entry)
    if added:
        doc.setdefault("companies", []).extend(added)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "w", encoding="utf-8") as f:
            f.write(json.dumps(doc, indent=2) + "\n")
        os.replace(part, path)
    return added


def valid_slug(c: Column) -> Column:
    """Whether a slug, host or site can't lead a request elsewhere."""
    return F.coalesce(c.rlike(r"^[A-Za-z0-9._-]+$"), F.lit(False))


def rejected(companies: DataFrame, services: tuple[str, ...]) -> DataFrame:
    """Adds error: why a company of the watchlist can't be asked, or null."""
    name = F.coalesce(F.col("name"), F.col("slug"), F.lit("?"))
    unset = F.when(F.col("ats") == "workday", F.when(~valid_slug(F.col("host")), "host").when(~valid_slug(F.col("site")), "site"))
    error = F.when(
        ~F.coalesce(F.col("ats").isin(*services), F.lit(False)),
        F.concat(name, F.lit(": source '"), F.coalesce("ats", F.lit("")), F.lit("' not enabled"))
    )
    error = error.when(~valid_slug(F.col("slug")), F.concat(name, F.lit(": invalid slug"))).when(
        unset.isNotNull(), F.concat(name, F.lit(" (workday): missing/invalid "), unset)
    )
    return companies.withColumn("error", error)


# ---- statistics of sources

def junk_parameter(control_status: Column, control_rows: Column, status: Column, rows: Column) -> Column:
    """What a made-up parameter shows: rejected, ignored, or nothing that tells."""
    return F.when(status == 400, "rejects_unknown_400").when(status.isin(401, 403), "unknown").when(
        (status == control_status) & (rows == control_rows), "ignores_unknown"
    ).otherwise("unknown")


def filters(status: Column, rows: Column, relevance: Column, base: Column, control_rows: Column) -> Column:
    """Whether a parameter filters titles: its rows have to be about the term, not just different."""
    hit = (status == 200) & (rows > 0) & (relevance >= 0.3) & (relevance > base + 0.2)
    return F.when(hit, "true").when((status == 200) & (rows == 0) & (control_rows > 0), "unknown").otherwise("false")


def page_ceiling(rows_at: Callable[[int], tuple[int, int]], control: int, start: int = 1, most: int = 2**31 - 1) -> int | None:
    """The last page that returns rows: doubling, then halving; None if the parameter is ignored.

    rows_at(page) gives (status, rows), the best of some attempts. ``most`` is a page that no list reaches: one that is as
    full there as the first is not paged at all. (The reference asks for page 999 and stops at 4096, which long lists reach.)"""
    if control and rows_at(most) == (200, control):
        return None
    ok = lambda n: (lambda s, r: s == 200 and r > 0)(*rows_at(n))
    good, probe = start, max(start, 1)
    while probe <= most and ok(probe):
        good, probe = probe, probe * 2
    low, high = good, min(probe, most + 1)
    while low + 1 < high:
        middle = (low + high) // 2
        low, high = (middle, high) if ok(middle) else (low, middle)
    return low
