"""The command line: scan landed payloads into the store, look at it, mark rows, start files, seed a watchlist.

Payloads are landed by whatever fetches them (``sources.http`` has data sources for it) as one folder per source.
The store is a versioned table beside the CSV that a person reads.
"""

from __future__ import annotations

import argparse
import datetime
import os
import sys
import urllib.parse
import zoneinfo
from collections.abc import Callable
from dataclasses import dataclass, field
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanworks.operators import discovery, score, store, versions
from gleanworks.plans import config, emit, rerank
from gleanworks.plans.harvest import harvest
from gleanworks.sources import files, http, lanes, payloads

VERSION = "0.2"
SETTINGS, WATCHLIST = "gleanworks.yaml", "watchlist.json"
SCHEMA = ", ".join(f"{c} string" for c in store.COLUMNS)
MINED = ("greenhouse", "lever", "ashby", "workable", "smartrecruiters", "workday")


def packaged(name: str) -> str:
    """A file that ships with the package."""
    return resources.files("gleanworks.resources").joinpath(name).read_text(encoding="utf-8")


def today() -> str:
    return datetime.datetime.now(zoneinfo.ZoneInfo("America/New_York")).date().isoformat()


def init(folder: str) -> tuple[list[str], list[str]]:
    """Starter files: what was written, and what was there and stays."""
    wrote, kept = [], []
    for source, name in (("settings.example.yaml", SETTINGS), ("watchlist.example.json", WATCHLIST)):
        path = os.path.join(folder, name)
        try:
            with open(path, "x", encoding="utf-8") as f:
                f.write(packaged(source))
            wrote.append(name)
        except FileExistsError:
            kept.append(name)
    return wrote, kept


def settings(named: str | None, folder: str = ".") -> tuple[config.Config, list[str]]:
    """The configuration and what to say about it; a file that was found, not named, may not redirect requests."""
    path = named or os.path.join(folder, SETTINGS)
    if named and not os.path.exists(named):
        raise SystemExit(f"error: --config {named}: no such file")
    if not os.path.exists(path):
        return config.load("")
    with open(path, encoding="utf-8") as f:
        cfg, notes = config.load(f.read())
    if not named:
        cfg, ignored = config.without_redirects(cfg)
        notes = notes + ([f"ignoring {', '.join(ignored)} of a file that --config didn't name"] if ignored else [])
    return cfg, notes


def table(spark: SparkSession, out: str) -> versions.Versions:
    """The store behind a CSV; one that was written by hand is taken over with the first change."""
    found = versions.Versions(spark, f"{out}.store", SCHEMA)
    if not found.commits():
        sheet = files.store_csv(spark, out)
        if not sheet.isEmpty():
            found.change(lambda _: sheet.select(*(F.regexp_replace(c, "^'(?=[=+@\\t\\r-])", "").alias(c) for c in store.COLUMNS)))
    return found


@dataclass
class Run:
    merged: DataFrame
    surfaced: DataFrame
    harvested: DataFrame
    errors: list[tuple[str, str]] = field(default_factory=list)


def scan(
    spark: SparkSession, cfg: config.Config, landed: str, out: str, watchlist: str | None, work: str, day: str,
    judge: Callable[[str], str] | None = None, net: lanes.Net | None = None, keep: Callable[[Column], Column] | None = None
) -> Run:
    """One run: land, harvest, guard, upsert, second opinion, surface. work: a folder that driver and executors share.

    Sources without a landed folder are asked over the network, if there is a net."""
    wanted = payloads.selected(
        [*(cfg.depth_sources or payloads.DEPTH), *(cfg.breadth_sources or [s for s in payloads.PROJECTIONS if s not in payloads.DEPTH])]
    )
    errors: list[tuple[str, str]] = []
    have = {n for n in wanted if files.exists(spark, f"{landed}/{n}")}
    watch = spark.createDataFrame([], files.WATCHLIST)
    if watchlist and files.exists(spark, watchlist):
        watch, wrong = files.watchlist_json(spark, watchlist)
        errors += [("watchlist", wrong)] if wrong else []
    watch = watch.withColumn("seq", F.monotonically_increasing_id())
    readers = {n: (lambda n=n: files.landed(spark, landed, n)) for n in wanted if n in have}
    if net is not None:
        asked, wrong = _asked(spark, cfg, [n for n in wanted if n not in have], watch, day, net)
        readers |= asked
        errors += wrong
    frames, failed = files.each_apart(readers, f"{work}/landed")
    errors += failed
    for n in [n for n in frames if n in have]:
        errors += [tuple(r) for r in payloads.broken(frames[n], n).collect()]  # two rows at most
    for n in [n for n in frames if n not in have]:
        errors += [tuple(r) for r in lanes.failures(frames[n], n).collect()]  # a row for each walk that failed: as many as the watchlist has boards at most
        frames[n] = frames[n].where("raw is not null")
    details = _details(spark, cfg, {n: frames[n] for n in frames if n not in have}, f"{work}/details", net, keep, errors) if net is not None else {}
    if frames:
        rows = harvest(frames, cfg, watch, day, f"{day}T00:00:00", details, watch, keep, f"{work}/scored")
        rows.write.mode("overwrite").parquet(f"{work}/harvest")
        rows = spark.read.parquet(f"{work}/harvest")
    else:
        rows = spark.createDataFrame([], "dedup_key string, text string, sources array<string>, source string")
    run = store.store_rows(versions.guarded(rows, errors), F.lit(day).cast("date"))
    versioned = table(spark, out)
    before = versioned.read()
    versioned.change(lambda now: store.upsert(now, run).drop("is_new"))
    if judge is not None and cfg.llm.enabled:
        first = store.surface(versioned.read(), cfg).limit(cfg.llm.rerank_top_n)
        notes = rerank.rerank(spark, first, cfg, judge, cfg.llm.rerank_top_n)
        versioned.change(lambda now: store.annotate(now, notes))
    merged = store.upsert(before, run).select("dedup_key", "is_new").join(versioned.read(), "dedup_key")
    versions.write_sheet(versioned.read(), out)
    return Run(merged, store.surface(merged, cfg), rows, errors)


def _asked(
    spark: SparkSession, cfg: config.Config, names: list[str], watch: DataFrame, day: str, net: lanes.Net
) -> tuple[dict[str, Callable[[], DataFrame]], list[tuple[str, str]]]:
    """Readers of the sources that can be asked, and what is wrong with entries of the watchlist."""
    marked = discovery.rejected(watch, tuple(n for n in names if n in payloads.DEPTH)).orderBy("seq")
    listed = marked.where("ats is not null").collect()  # one person's list
    errors = [(r.ats, r.error) for r in listed if r.error and r.ats in names]
    depth, queries, out = cfg.harvest_depth, list(cfg.title_queries), {}
    how: dict[str, dict] = {
        "smartrecruiters": {"pages": depth.smartrecruiters_max_pages}, "workday": {"pages": depth.workday_max_pages},
        "adzuna": {"pages": cfg.adzuna_pages}, "usajobs": {"pages": cfg.usajobs_max_pages, "size": cfg.usajobs_results_per_page},
        "google_jobs": {"pages": cfg.google_jobs_pages, "cap": cfg.serpapi_max_searches_per_run, "reserve": cfg.serpapi_reserve},
        "himalayas": {"oldest": (datetime.date.fromisoformat(day) - datetime.timedelta(days=cfg.max_age_days)).isoformat()},
        "themuse": {"pages": depth.themuse_max_pages}
    }
    if cfg.location.lower() in ("remote", "anywhere", ""):
        how["google_jobs"]["where"] = "&ltype=1"
    for n in names:
        boards = [{"slug": r.slug, "company": r.name, "host": r.host, "site": r.site} for r in listed if r.ats == n and not r.error]
        if (n in payloads.DEPTH and not boards) or any(not net.keys.get(n, {}).get(k) for k in lanes.NEEDS.get(n, ())):
            continue  # nothing to ask for, or no key to ask with
        out[n] = lambda n=n, boards=boards: lanes.asked(spark, n, net, boards, queries, **how.get(n, {}))
    return out, errors


def _details(
    spark: SparkSession, cfg: config.Config, frames: dict[str, DataFrame], folder: str, net: lanes.Net, keep: Callable[[Column], Column] | None,
    errors: list[tuple[str, str]]
) -> dict[str, DataFrame]:
    """The details of the rows whose titles are wanted, landed once; those that failed are errors."""
    out = {}
    for n, fetch in (("workday", cfg.harvest_depth.workday_fetch_details), ("rippling", cfg.harvest_depth.rippling_fetch_details)):
        if n not in frames or not fetch:
            continue
        rows = payloads.postings(frames[n], n)
        keys = rows.where(keep(F.coalesce("title", F.lit(""))) if keep else score.relevant(F.col("title"), cfg))
        lanes.detailed(keys, n, net).write.mode("overwrite").parquet(f"{folder}/{n}")
        landed = spark.read.parquet(f"{folder}/{n}")
        bad = landed.where("error is not null").groupBy("error").agg(F.count("*").alias("n")).orderBy("error").collect()
        errors += [(n, f"{r.n} details: {r.error}") for r in bad]
        out[n] = landed.where("raw is not null").select("raw", "detail_key")
    return out


def show(rows: DataFrame, cfg: config.Config, limit: int) -> list[str]:
    return [r["x"] for r in rows.limit(limit).select(emit.line(cfg).alias("x")).collect()]


def mark(spark: SparkSession, out: str, row_id: str, status: str) -> bool:
    """Set a row's status in the store and its sheet; whether there is such a row."""
    versioned = table(spark, out)
    if not store.has_id(versioned.read(), row_id):
        return False
    versioned.change(lambda now: store.mark_status(now, row_id, status))
    versions.write_sheet(versioned.read(), out)
    return True


def seed(spark: SparkSession, index: str, service: str, watchlist: str, most: int) -> int:
    """Boards of one service from a crawl index into the watchlist; how many were new."""
    if not os.path.exists(watchlist):
        with open(watchlist, "x", encoding="utf-8") as f:
            f.write('{"companies": []}\n')
    boards = discovery.mined(files.crawl_index(spark, index)).where(F.col("ats") == service)
    known = files.watchlist_companies(spark, watchlist).select("entry_key")
    return len(discovery.append_watchlist(discovery.watch_entries(discovery.seeded(boards, known, most), "(seeded)"), watchlist))


def arguments() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--config", help=f"settings (default: ./{SETTINGS})")
    common.add_argument("--out", default="shortlist.csv", help="the CSV of the store")
    common.add_argument("--watchlist", default=WATCHLIST, help="companies to ask directly")
    common.add_argument("--landed", default="landed", help="folder of landed payloads, one folder per source")
    common.add_argument("--live", action="store_true", help="ask the sources that have no landed folder")
    common.add_argument("--root", default="", help="a proxy that stands in for all hosts (root/host/path)")
    common.add_argument("--work", default=None, help="folder that driver and executors share (default: beside the store)")
    common.add_argument("--limit", type=int, default=25, help="how many to print")
    common.add_argument("--verbose", action="store_true", help="print which sources failed, and why")
    common.add_argument("--format", choices=("text", "ndjson"), default="text")
    common.add_argument("--all", action="store_true", help="every tracked role, not just the shortlist")
    common.add_argument("--strict", action="store_true", help="exit with 1 if any source failed")
    parser = argparse.ArgumentParser(prog="gleanworks", parents=[common])
    parser.add_argument("--version", action="version", version=f"gleanworks {VERSION}")
    sub = parser.add_subparsers(dest="command")
    for name in ("scan", "list", "init"):
        sub.add_parser(name, parents=[common])
    for name in ("apply", "dismiss"):
        sub.add_parser(name, parents=[common]).add_argument("id")
    seeds = sub.add_parser("seed", parents=[common])
    seeds.add_argument("ats", choices=MINED)
    seeds.add_argument("--index", required=True, help="crawl index: lines of JSON with a url")
    seeds.add_argument("--max", type=int, default=500)
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments().parse_args(argv)
    for name in ("out", "watchlist", "landed", "work", "index"):
        path = getattr(args, name, None)
        if path and "://" not in path:  # Spark may have started in another folder
            setattr(args, name, os.path.abspath(path))
    if args.command == "init":
        wrote, kept = init(".")
        print("\n".join([f"created {n}" for n in wrote] + [f"kept existing {n}" for n in kept]))
        return 0
    cfg, notes = settings(args.config)
    for n in notes:
        print(f"note: {n}", file=sys.stderr)
    spark = spark or SparkSession.builder.appName("gleanworks").getOrCreate()
    try:
        return {"list": _list, "apply": _mark, "dismiss": _mark, "seed": _seed}.get(args.command, _scan)(args, cfg, spark)
    except files.UnreadableStore as e:
        print(e)
        return 1


def _list(args: argparse.Namespace, cfg: config.Config, spark: SparkSession) -> int:
    rows = table(spark, args.out).read()
    if rows.isEmpty():
        print(f"no shortlist yet: {args.out} not found")
        return 0
    rows = store.by_score(rows) if args.all else store.surface(rows, cfg)
    print("\n".join([*show(rows, cfg, args.limit), f"\n{rows.count()} shown"]))
    return 0


def _mark(args: argparse.Namespace, cfg: config.Config, spark: SparkSession) -> int:
    status = "applied" if args.command == "apply" else "dismissed"
    if mark(spark, args.out, args.id, status):
        print(f"{args.id} -> {status}")
        return 0
    print(f"no role with id {args.id} in {args.out}")
    return 1


def _seed(args: argparse.Namespace, cfg: config.Config, spark: SparkSession) -> int:
    print(f"added {seed(spark, args.index, args.ats, args.watchlist, args.max)} to {args.watchlist}")
    return 0


def _net(cfg: config.Config, root: str) -> lanes.Net:
    """How the command line reaches the network: keys come from the environment."""
    told = os.environ.get
    keys = {
        "adzuna": {"app_id": told(cfg.adzuna_app_id_env, ""), "app_key": told(cfg.adzuna_app_key_env, "")},
        "google_jobs": {"api_key": told(cfg.serpapi_key_env, "")},
        "usajobs": {"email": told("USAJOBS_EMAIL", ""), "key": told("USAJOBS_API_KEY", "")}
    }
    left = None
    if key := keys["google_jobs"]["api_key"]:
        status, text = http.fetch(lanes.at(f"https://serpapi.com/account.json?api_key={urllib.parse.quote(key, safe='')}", root))
        account = http.parsed(text) if status == 200 else None
        told_left = [account.get(k) for k in ("plan_searches_left", "total_searches_left")] if isinstance(account, dict) else []
        left = next((x for x in told_left if isinstance(x, int)), None)
    return lanes.Net(keys, root, searches_left=left)


def _scan(args: argparse.Namespace, cfg: config.Config, spark: SparkSession) -> int:
    day = today()
    try:
        run = scan(spark, cfg, args.landed, args.out, args.watchlist, args.work or f"{args.out}.work", day, net=_net(cfg, args.root) if args.live else None)
    except versions.NothingHarvested as e:
        rows = store.surface(table(spark, args.out).read(), cfg)
        print("\n".join([f"all sources failed, the shortlist stays as it is: {e}", *show(rows, cfg, args.limit)]))
        return 1
    if args.format == "ndjson":
        rows = emit.grafted(run.merged if args.all else run.surfaced, run.harvested)
        print("\n".join(r["value"] for r in emit.ndjson(rows).toLocalIterator()))
        errors = spark.createDataFrame([(f"{s}: {e}",) for s, e in run.errors], "error string")
        about = emit.manifest(rows, errors, cfg, f"{day}T00:00:00", f"{day}T00:00:00")
        print(about.select(F.to_json(F.struct(*about.columns)).alias("x")).first()["x"], file=sys.stderr)
    else:
        (s,) = emit.summary(run.merged, run.surfaced, len(run.errors)).collect()
        print(f"{s.tracked} roles tracked · {s.shortlisted} on the shortlist · {s.fresh} new · {s.errors} feed errors")
        print(
            "\n".join(
                [
                    *([f"    {a}: {b}" for a, b in run.errors] if args.verbose else []), *show(run.surfaced, cfg, args.limit),
                    emit.credit_line(spark, run.harvested)
                ]
            )
        )
    return 1 if args.strict and run.errors else 0


if __name__ == "__main__":
    sys.exit(main())
