"""The sources of a run over the network: one Python data source, and a second phase for details.

A lane says how a source is asked: its address, how a walk goes on and when it ends. What a run asks is a list of walks, one
for each board of the watchlist, query or category, which the data source deals to a bounded number of partitions; a
partition walks one after the other, so no more requests than partitions are in flight, and payloads stream out page by
page. Filters are pushed into the reader: on ``slug``, ``query`` and ``category`` they leave whole walks out; on
``newest`` (the day of a page's youngest row) they end a walk whose pages come from new to old at its first page that is
too old. A page that fails, and one that isn't JSON, is a row with its error beside the good ones, and ends its walk alone.

Details are asked for afterwards, for the rows that a run keeps by title: keys are dealt to a bounded number of
partitions, and a detail that fails is a row with its error.
"""

from __future__ import annotations

import datetime
import json
import urllib.parse
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition
from pyspark.sql.types import StructType

from gleanworks.sources import http, paging

#: Requests of one source at the same time.
IN_FLIGHT = 24


@dataclass(frozen=True)
class Lane:
    """How one kind of walk goes: ``once`` asks a single page; ``short`` goes on until a page has fewer than size items, or
    the total that the first page told; ``full`` until a page is empty; ``next`` along links on one host; ``token``
    hands on what the payload has at next; ``threads`` asks for the newest items that a first page lists."""

    url: str
    rule: str = "once"
    items: str = ""
    size: int = 0
    total: str = ""
    next: str = ""
    body: str = ""
    first: int = 1
    most: int = 1
    dated: str = ""  # the field of an item that holds its day, where pages come from new to old
    headers: dict[str, str] = field(default_factory=dict)


# The public addresses of the sources.
LANES: dict[str, list[Lane]] = {
    "greenhouse": [Lane("https://boards-api.greenhouse.io/v1/boards/{slug}/jobs?content=true")],
    "lever": [Lane("https://api.lever.co/v0/postings/{slug}?mode=json")],
    "ashby": [Lane("https://api.ashbyhq.com/posting-api/job-board/{slug}?includeCompensation=true")],
    "smartrecruiters": [Lane("https://api.smartrecruiters.com/v1/companies/{slug}/postings?limit=100&offset={offset}", "short", "content", 100, "totalFound", most=10)],
    "workable": [Lane("https://apply.workable.com/api/v1/widget/accounts/{slug}?details=true")],
    "workday": [
        Lane(
            "https://{slug}.{host}.myworkdayjobs.com/wday/cxs/{slug}/{site}/jobs", "short", "jobPostings", 20, "total", most=25,
            body='{"appliedFacets": {}, "limit": 20, "offset": {offset}, "searchText": ""}'
        )
    ],
    "rippling": [Lane("https://api.rippling.com/platform/api/ats/v1/board/{slug}/jobs")],
    "teamtailor": [Lane("https://{slug}.teamtailor.com/jobs.json")],
    "remotive": [Lane("https://remotive.com/api/remote-jobs")],
    "jobicy": [Lane("https://jobicy.com/api/v2/remote-jobs?count=100")],
    "arbeitnow": [Lane("https://www.arbeitnow.com/api/job-board-api")],
    "remoteok": [Lane("https://remoteok.com/api")],
    "himalayas": [
        Lane("https://himalayas.app/jobs/api/search?q={query}&limit=20&page={page}", "short", "jobs", 20, most=10),
        Lane("https://himalayas.app/jobs/api?limit=20&offset={offset}", "full", "jobs", 20, most=50, dated="pubDate")
    ],
    "adzuna": [
        Lane(
            "https://api.adzuna.com/v1/api/jobs/us/search/{page}?app_id={app_id}&app_key={app_key}&what={query}{where}&results_per_page=50&content-type=application/json",
            "short", "results", 50, most=3
        )
    ],
    "google_jobs": [
        Lane("https://serpapi.com/search.json?engine=google_jobs&q={query}&api_key={api_key}&hl=en{where}{token}", "token", "jobs_results", next="serpapi_pagination.next_page_token", most=1)
    ],
    "hn": [
        Lane(
            "https://hn.algolia.com/api/v1/search_by_date?tags=story,author_whoishiring&hitsPerPage=8", "threads", "hits",
            next="https://hn.algolia.com/api/v1/items/{id}", most=2
        )
    ],
    "braintrust": [Lane("https://app.usebraintrust.com/api/jobs/?limit=20", "next", "results", most=10)],
    "usajobs": [
        Lane(
            "https://data.usajobs.gov/api/Search?Keyword={query}&ResultsPerPage={size}&Page={page}{where}", "short", "SearchResult.SearchResultItems", 500,
            "SearchResult.SearchResultCountAll", most=3, headers={"User-Agent": "{email}", "Authorization-Key": "{key}"}
        )
    ],
    "themuse": [Lane("https://www.themuse.com/api/public/jobs?page={page}&category={category}", "full", "results", first=0, most=5)]
}
# Where a detail lies; its key is the list row's path behind the board.
DETAIL_URLS = {
    "workday": "https://{slug}.{host}.myworkdayjobs.com/wday/cxs/{slug}/{site}/{rest}",
    "rippling": "https://api.rippling.com/platform/api/ats/v1/board/{slug}/jobs/{rest}"
}
#: What a source can't be asked without.
NEEDS = {"adzuna": ("app_id", "app_key"), "google_jobs": ("api_key",), "usajobs": ("email", "key")}
# A source's categories.
CATEGORIES = (
    "Account Management", "Accounting and Finance", "Advertising and Marketing", "Animal Care", "Business Operations", "Data and Analytics", "Education",
    "Food and Hospitality Services", "Healthcare", "Human Resources and Recruitment", "Installation, Maintenance, and Repairs", "Legal Services",
    "Management", "Product Management", "Project Management", "Retail", "Sales", "Science and Engineering", "Software Engineering", "Unknown"
)
SCHEMA = (
    "walk long, page long, seq long, raw string, status int, error string, newest date, slug string, company string, host string, site string,"
    " query string, category string"
)


@dataclass(frozen=True)
class Net:
    """How a run reaches the network: keys by source, and a root that stands in for all hosts (a proxy, or a test's server)."""

    keys: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    root: str = ""
    in_flight: int = IN_FLIGHT
    searches_left: int | None = None


def at(url: str, root: str) -> str:
    """The address, under the root where there is one: ``root/host/path``."""
    return f"{root.rstrip('/')}/{url.split('://', 1)[1]}" if root else url


def filled(template: str, values: Mapping[str, object]) -> str:
    """The template with its names filled in, quoted; ``where`` and ``token`` bring their own marks."""
    for name, value in values.items():
        template = template.replace("{" + name + "}", str(value) if name in ("where", "token") else urllib.parse.quote(str(value), safe=""))
    return template


def walks(source: str, boards: list[dict], queries: list[str], categories: list[str], lanes: list[Lane], net: Net, where: str = "") -> list[dict]:
    """What to ask a source: a walk for each board, query or category that its lanes name, in order."""
    out = []
    for n, lane in enumerate(lanes):
        if "{slug}" in lane.url:
            out += [{"lane": n, **{k: b.get(k) for k in ("slug", "company", "host", "site")}} for b in boards]
        elif "{query}" in lane.url:
            out += [{"lane": n, "query": q} for q in queries]
        elif "{category}" in lane.url:
            out += [{"lane": n, "category": c} for c in categories]
        else:
            out.append({"lane": n})
    keys = {k: net.keys.get(source, {}).get(k, "") for k in NEEDS.get(source, ())}
    return [{**w, "where": where, **keys, "walk": i, "most": lanes[w["lane"]].most} for i, w in enumerate(out)]


def within(planned: list[dict], spend: int) -> list[dict]:
    """The walks that a budget of requests pays for, each at its most pages; the last one as far as the budget goes."""
    out = []
    for w in planned:
        if spend <= 0:
            break
        out.append({**w, "most": min(w["most"], spend)})
        spend -= out[-1]["most"]
    return out


def day_of(value: object) -> datetime.date | None:
    """The day of an epoch in seconds or milliseconds, or of a text that begins with one."""
    try:
        if isinstance(value, (int, float)) or (isinstance(value, str) and value.isdigit()):
            n = float(value)
            return datetime.datetime.fromtimestamp(n / 1000 if n > 1e11 else n, datetime.UTC).date()
        return datetime.date.fromisoformat(str(value)[:10])
    except (ValueError, OverflowError, OSError):
        return None


class Walk:
    """One walk: its pages as rows, until it ends by itself or is older than asked for."""

    def __init__(self, lane: Lane, values: dict, root: str, oldest: datetime.date | None, size: int = 0) -> None:
        self.lane, self.values, self.root, self.oldest = lane, values, root, oldest
        self.size = size or lane.size

    def ask(self, url: str, offset: int = 0) -> tuple[object, int | None, str | None]:
        """The payload, its status, and what is wrong with it."""
        body = self.lane.body.replace("{offset}", str(offset)).encode() if self.lane.body else None
        headers = {k: str(self.values.get(v.strip("{}"), v)) for k, v in self.lane.headers.items()}
        try:
            text = http.request(at(url, self.root), body, headers).decode("utf-8", "replace")
        except http.Refused as e:
            return None, e.status, f"HTTP {e.status}"
        except OSError as e:
            return None, None, str(e) or type(e).__name__
        try:
            return json.loads(text), 200, None
        except ValueError:
            return None, 200, "not JSON"

    def pages(self) -> Iterator[tuple]:
        """(page, payload, status, error, newest)"""
        if self.lane.rule == "threads":
            yield from self.threads()
            return
        offset, told, token, link = 0, None, "", None
        for n in range(int(self.values.get("most", self.lane.most))):
            places = {"offset": offset, "page": self.lane.first + n, "size": self.size, "token": token}
            url = link or filled(self.lane.url, {**{k: "" if v is None else v for k, v in self.values.items()}, **places})
            data, status, error = self.ask(url, offset)
            rows = http.at_path(data, self.lane.items) if self.lane.items else data
            days = [d for r in rows or [] if isinstance(r, dict) and (d := day_of(r.get(self.lane.dated)))] if self.lane.dated and isinstance(rows, list) else []
            yield n, json.dumps(data) if error is None else None, status, error, max(days, default=None)
            if error or self.lane.rule == "once" or (days and self.oldest and max(days) < self.oldest):
                return
            if self.lane.rule == "next":
                link = data.get("next") if isinstance(data, dict) else None
                # under a root, links lead there too, so what is compared is the host that was asked for
                if not link or http.host_of(link) != http.host_of(url):
                    return
                link = link.replace("http://", "https://") if url.startswith("https://") else link
            elif self.lane.rule == "token":
                found = http.at_path(data, self.lane.next)
                if not found:
                    return
                token = "&next_page_token=" + urllib.parse.quote(str(found), safe="")
            else:
                if told is None and isinstance(http.at_path(data, self.lane.total) if self.lane.total else None, int):
                    told = http.at_path(data, self.lane.total)
                offset += self.size
                count = len(rows) if isinstance(rows, list) else 0
                if not count or (self.lane.rule == "short" and count < self.size) or (told is not None and offset >= told):
                    return

    def threads(self) -> Iterator[tuple]:
        data, status, error = self.ask(self.lane.url)
        if error:
            yield 0, None, status, error, None
            return
        hits = [h for h in http.at_path(data, self.lane.items) or [] if "who is hiring" in (h.get("title") or "").lower()]
        for n, h in enumerate(hits[: int(self.values.get("most", self.lane.most))]):
            data, status, error = self.ask(filled(self.lane.next, {"id": h.get("objectID", "")}))
            yield n, json.dumps(data) if error is None else None, status, error, None


class Walks(InputPartition):
    def __init__(self, walks: list[dict]) -> None:
        self.walks = walks


class LaneReader(DataSourceReader):
    """Partitions of walks, thinned and ended by the filters that were pushed."""

    def __init__(self, options: dict) -> None:
        self.lanes = [Lane(**x) for x in json.loads(options["lanes"])]
        self.walks = json.loads(options["walks"])
        self.root, self.in_flight, self.size = options.get("root", ""), int(options.get("in_flight", IN_FLIGHT)), int(options.get("size", 0))
        self.oldest = datetime.date.fromisoformat(options["oldest"]) if options.get("oldest") else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Walks are left out for good; a page's day ends its walk here, and the page itself is left to Spark."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else ""
            if name in ("slug", "query", "category") and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.walks = [w for w in self.walks if w.get(name) in wanted]
                continue
            if name == "newest" and isinstance(f, (GreaterThan, GreaterThanOrEqual)) and isinstance(f.value, datetime.date):
                self.oldest = max(filter(None, (self.oldest, f.value)))
            yield f

    def partitions(self) -> list[Walks]:
        parts = min(self.in_flight, len(self.walks))
        return [Walks(self.walks[i::parts]) for i in range(parts)] or [Walks([])]

    def read(self, part: Walks) -> Iterator[tuple]:
        for w in part.walks:
            own = [w.get(k) for k in ("slug", "company", "host", "site", "query", "category")]
            for n, raw, status, error, newest in Walk(self.lanes[w["lane"]], w, self.root, self.oldest, self.size).pages():
                yield (w["walk"], n, (w["walk"] << 20) + n, raw, status, error, newest, *own)


class LaneSource(DataSource):
    """spark.read.format("lane") with what ``asked`` hands it."""

    @classmethod
    def name(cls) -> str:
        return "lane"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> LaneReader:
        return LaneReader(self.options)


def asked(
    spark: SparkSession, source: str, net: Net, boards: list[dict] | None = None, queries: list[str] | None = None, pages: int | None = None,
    size: int = 0, where: str = "", cap: int | None = None, reserve: int = 0, oldest: str = ""
) -> DataFrame:
    """A source's pages as rows of SCHEMA, read when they are used. A cap bounds the requests of metered sources; walks
    from new to old end at oldest, if a filter doesn't end them before."""
    missing = [k for k in NEEDS.get(source, ()) if not net.keys.get(source, {}).get(k)]
    if missing:
        raise ValueError(f"{source} needs {', '.join(missing)}")
    spark.dataSource.register(LaneSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    lanes = [replace(x, most=pages) if pages and x.rule not in ("once", "threads") else x for x in LANES[source]]
    planned = walks(source, boards or [], queries or [], list(CATEGORIES), lanes, net, where)
    if cap is not None:
        planned_pages = sum(w["most"] for w in planned)
        left = F.lit(net.searches_left).cast("long")
        spend = spark.range(1).select(paging.budget(F.lit(planned_pages), F.lit(cap), left, F.lit(reserve)).cast("long")).first()[0]
        planned = within(planned, spend)
    options = {"lanes": json.dumps([x.__dict__ for x in lanes]), "walks": json.dumps(planned), "root": net.root, "in_flight": str(net.in_flight), "size": str(size), "oldest": oldest}
    return spark.read.format("lane").options(**options).load()


def failures(pages: DataFrame, source: str) -> DataFrame:
    """(source, error): one row for each page that failed, with its board or query and the reason."""
    what = F.coalesce("company", "slug", "query", "category", F.lit(""))
    return pages.where("error is not null").select(
        F.lit(source).alias("source"),
        F.concat(F.when(what != "", F.concat(what, F.lit(": "))).otherwise(""), "error", F.when(F.col("page") > 0, F.concat(F.lit(" on page "), (F.col("page") + 1).cast("string"))).otherwise("")).alias("error")
    )


def detailed(keys: DataFrame, source: str, net: Net) -> DataFrame:
    """(raw, detail_key, status, error) of the details of keys (detail_key), each asked for once, no more than in_flight at a time."""
    root, names = net.root, ("slug", "host", "site") if source == "workday" else ("slug",)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key in pdf["detail_key"]:
                parts = key.split("/", len(names))
                rest = parts[-1].lstrip("/") if len(parts) > len(names) else ""
                if not rest:
                    rows.append((None, key, None, "no path"))
                    continue
                url = filled(DETAIL_URLS[source], dict(zip(names, parts, strict=False))).replace("{rest}", urllib.parse.quote(rest, safe="/-_.~%"))
                data, status, error = Walk(Lane(url), {}, root, None).ask(url)
                rows.append((json.dumps(data) if error is None else None, key, status, error))
            yield pd.DataFrame(rows, columns=["raw", "detail_key", "status", "error"]).astype({"status": "Int64"})

    # a key goes to one partition, and a partition asks for one key at a time
    slots = keys.select("detail_key").where("detail_key is not null").distinct().repartition(net.in_flight, "detail_key")
    return slots.mapInPandas(ask, "raw string, detail_key string, status long, error string")
