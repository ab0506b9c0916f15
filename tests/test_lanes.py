"""A run over the network: a local server stands in for every host, and counts what it is asked."""

from __future__ import annotations

import collections
import http.server
import json
import threading
import urllib.parse
from collections.abc import Iterator
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gleanworks.plans import app, config
from gleanworks.sources import files, lanes, payloads

DAY = "2026-01-31"


def answer(path: str, query: dict[str, str], body: dict) -> object:
    """What the hosts say: one wanted and one unwanted title on each page; None is a refusal."""
    host, _, rest = path.lstrip("/").partition("/")
    pair = lambda i, **more: [{"title": f"Data Engineer {i}", **more}, {"title": f"Plumber {i}", **more}]
    if "myworkdayjobs" in host:
        if rest.endswith("/jobs"):
            at = body["offset"]
            return {"total": 45 if at == 0 else 0, "jobPostings": [{"title": f"{'Data Engineer' if i % 5 == 0 else 'Plumber'} {i}", "externalPath": f"/job/Oslo/r_{i}"} for i in range(at, min(at + 20, 45))]}
        return {"jobPostingInfo": {"jobDescription": f"spark body of {rest}", "startDate": "2026-01-20"}} if not rest.endswith("r_10") else None
    if host == "api.rippling.com":
        if rest.endswith("/jobs"):
            return [{"uuid": f"u{i}", "name": t["title"], "url": f"https://ats.rippling.com/x/{i}"} for i, t in enumerate(pair(1))]
        return {"description": {"role": "rippling body"}, "uuid": "u0"} if rest.endswith("u0") else None
    if host == "api.lever.co":
        slug = rest.split("/")[2]
        if slug == "broken":
            return b"<html>"
        return [{"text": t["title"], "categories": {"location": "Oslo"}, "hostedUrl": f"https://jobs.lever.co/{slug}/{i}", "createdAt": 1769000000000, "descriptionPlain": "spark"} for i, t in enumerate(pair(2))] if slug != "gone" else None
    if host == "boards-api.greenhouse.io":
        return {"jobs": [{"title": t["title"], "absolute_url": f"https://boards.greenhouse.io/a/jobs/{i}", "location": {"name": "Oslo"}, "content": "spark", "updated_at": "2026-01-20T00:00:00Z"} for i, t in enumerate(pair(3))]}
    if host == "api.smartrecruiters.com":
        at = int(query["offset"])
        return {"totalFound": 150, "content": [{"id": f"{at + i}", "name": "Data Engineer" if i % 50 == 0 else "Plumber", "releasedDate": "2026-01-20T00:00:00Z"} for i in range(100 if at == 0 else 50)]}
    if host == "himalayas.app":
        if rest.endswith("search"):
            return {"jobs": [{"title": "Data Engineer H", "companyName": "H", "applicationLink": f"https://h/{query['q']}", "pubDate": 1769000000}]}
        at = int(query["offset"])
        # the first page is ten days old, each further one forty days more
        return {"jobs": [{"title": f"Plumber {at + i}", "companyName": "H", "guid": f"g{at + i}", "pubDate": 1769000000 - (at // 20) * 40 * 86400} for i in range(20)]}
    if host == "api.adzuna.com":
        page = int(rest.rsplit("/", 1)[1])
        return {"results": [{"title": t["title"], "company": {"display_name": f"A{page}"}, "redirect_url": f"https://a/{page}/{i}", "created": "2026-01-20"} for i, t in enumerate(pair(page))] * (25 if page == 1 else 1)}
    if host == "serpapi.com":
        return {"jobs_results": [{"title": "Data Engineer G", "company_name": "G", "job_id": query["q"], "share_link": f"https://g/{query['q']}"}], "serpapi_pagination": {"next_page_token": "t&1"} if "next_page_token" not in query else {}}
    if host == "hn.algolia.com":
        if "search_by_date" in rest:
            return {"hits": [{"title": "Ask HN: Who is hiring?", "objectID": "1"}, {"title": "Who wants to be hired?", "objectID": "2"}, {"title": "Ask HN: Who is hiring?", "objectID": "3"}]}
        return {"children": [{"id": 5, "text": "Acme | Data Engineer | REMOTE | https://x", "created_at": "2026-01-20T00:00:00Z"}]}
    if host == "app.usebraintrust.com":
        at = int(query.get("offset", 0))
        return {"results": [{"id": at, "title": f"Data Engineer B{at}", "employer": {"name": "B"}}], "next": f"https://app.usebraintrust.com/api/jobs/?limit=20&offset={at + 1}" if at < 2 else "https://other.example/"}
    if host == "data.usajobs.gov":
        return {"SearchResult": {"SearchResultCountAll": 1, "SearchResultItems": [{"MatchedObjectDescriptor": {"PositionTitle": "Data Engineer U", "OrganizationName": "U", "PositionURI": "https://u/1"}}]}}
    if host == "www.themuse.com":
        page = int(query["page"])
        return {"results": [{"id": 7 + page, "name": "Data Engineer M", "company": {"name": query["category"]}, "contents": "spark", "refs": {"landing_page": f"https://m/{page}"}}] if page < 2 else []}
    return {"jobs": []} if "remote" in host or "jobicy" in host else None


@pytest.fixture(scope="module")
def served() -> Iterator[tuple[str, list[str]]]:
    asked: list[str] = []

    class Handler(http.server.BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_GET(self) -> None:  # noqa: N802
            self.say({})

        def do_POST(self) -> None:  # noqa: N802
            self.say(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))

        def say(self, body: dict) -> None:
            path, _, query = self.path.partition("?")
            asked.append(self.path + (f"#{body['offset']}" if body else "") + (f"#{self.headers['Authorization-Key']}" if "usajobs" in path else ""))
            said = answer(urllib.parse.unquote(path), dict(urllib.parse.parse_qsl(query)), body)
            data = said if isinstance(said, bytes) else json.dumps(said).encode() if said is not None else b""
            self.send_response(404 if said is None else 200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_: object) -> None:
            return

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}", asked
    server.shutdown()


COMPANIES = [
    {"name": "Work Co", "ats": "workday", "slug": "wco", "host": "wd1", "site": "Ext"}, {"name": "Rip Co", "ats": "rippling", "slug": "rco"},
    {"name": "Lev Co", "ats": "lever", "slug": "lco"}, {"name": "Gone Co", "ats": "lever", "slug": "gone"}, {"name": "Broken Co", "ats": "lever", "slug": "broken"},
    {"name": "Evil", "ats": "lever", "slug": "../x"}, {"name": "Green Co", "ats": "greenhouse", "slug": "a"}, {"name": "Smart Co", "ats": "smartrecruiters", "slug": "sco"}
]
KEYS = {"adzuna": {"app_id": "i", "app_key": "k"}, "google_jobs": {"api_key": "s"}, "usajobs": {"email": "me@example.org", "key": "u"}}


def settings() -> config.Config:
    text = "filters: {min_score: -100, remote_only: false, max_age_days: 60}\nprofile: {signal_titles: [engineer], title_queries: [data engineer, ml]}"
    return config.load(text)[0]


def test_a_run_over_the_network(spark: SparkSession, tmp_path: Path, served: tuple[str, list[str]]) -> None:
    root, asked = served
    asked.clear()
    (tmp_path / "w.json").write_text(json.dumps({"companies": COMPANIES}))
    run = app.scan(spark, settings(), f"{tmp_path}/none", f"{tmp_path}/list.csv", f"{tmp_path}/w.json", f"{tmp_path}/work", DAY, net=lanes.Net(KEYS, root, in_flight=4))
    rows = run.harvested.collect()
    found = collections.Counter(r.source for r in rows)
    assert {"workday", "rippling", "lever", "greenhouse", "smartrecruiters", "himalayas", "adzuna", "google_jobs", "hn", "braintrust", "themuse"} <= set(found)
    assert not any("Plumber" in r.title for r in rows)
    # boards carry their company's name; details came for wanted titles alone, each once, and one that failed is an error
    assert {r.company for r in rows if r.source == "workday"} == {"Work Co"} and found["workday"] >= 1
    assert any("spark body" in r.text for r in rows if r.source == "workday") and any(r.text == "rippling body" for r in rows if r.source == "rippling")
    workday = [x for x in asked if "myworkdayjobs" in x]
    assert sorted(x.rsplit("#")[-1] for x in workday if "#" in x) == ["0", "20", "40"]
    assert sorted(x.rsplit("r_")[1] for x in workday if "#" not in x) == sorted(str(i) for i in range(0, 45, 5))
    assert [x for x in asked if x.endswith(("jobs/u0", "jobs/u1"))] == ["/api.rippling.com/platform/api/ats/v1/board/rco/jobs/u0"]
    errors = {e for e in run.errors if e[0] in ("lever", "workday")}
    assert errors == {("lever", "Gone Co: HTTP 404"), ("lever", "Broken Co: not JSON"), ("lever", "Evil: invalid slug"), ("workday", "1 details: HTTP 404")}
    assert ("remotive", "HTTP 404") in run.errors
    # pages: totals, short pages, links on one host, tokens, empty pages, ages
    count = lambda part: sum(part in x for x in asked)
    assert count("smartrecruiters") == 2 and count("usebraintrust") == 3 and count("usajobs") == 2 and asked[[i for i, x in enumerate(asked) if "usajobs" in x][0]].endswith("#u")
    assert count("adzuna.com/v1/api/jobs/us/search/1?") == 2 and count("search/2?") == 2 and count("search/3?") == 0
    assert count("hn.algolia.com/api/v1/items") == 2 and count("themuse") == 3 * len(lanes.CATEGORIES)
    assert count("himalayas.app/jobs/api?") == 3  # ten, fifty and ninety days old: the third ends the walk
    assert not any("../" in x for x in asked)


def test_filters_reach_the_reader(spark: SparkSession, served: tuple[str, list[str]]) -> None:
    root, asked = served
    net = lanes.Net(KEYS, root, in_flight=3)
    asked.clear()
    pages = lanes.asked(spark, "himalayas", net, queries=["a", "b"])
    assert pages.count() == 52 and len(asked) == 52  # fifty pages are the most
    asked.clear()
    young = pages.where(F.col("newest") >= F.lit("2025-12-01").cast("date"))
    assert young.count() == 2 and sum("offset" in x for x in asked) == 3
    asked.clear()
    assert pages.where("query = 'b'").count() == 1 and len(asked) == 1
    boards = [{"slug": s, "company": s.upper()} for s in ("x", "y", "z")]
    asked.clear()
    assert {r.company for r in lanes.asked(spark, "greenhouse", net, boards).where(F.col("slug").isin("x", "z")).collect()} == {"X", "Z"} and len(asked) == 2


def test_metered_searches_stay_within_their_budget(spark: SparkSession, served: tuple[str, list[str]]) -> None:
    root, asked = served
    for left, cap, want in ((None, 3, 3), (27, 12, 2), (10, 12, 0), (None, 0, 0)):
        asked.clear()
        net = lanes.Net(KEYS, root, searches_left=left)
        assert lanes.asked(spark, "google_jobs", net, queries=["a", "b", "c"], pages=2, cap=cap, reserve=25).count() == want and len(asked) == want
    assert lanes.within([{"most": 2}, {"most": 2}], 3) == [{"most": 2}, {"most": 1}]
    with pytest.raises(ValueError, match="google_jobs needs"):
        lanes.asked(spark, "google_jobs", lanes.Net())


def test_arrival_of_many_boards(spark: SparkSession, tmp_path: Path) -> None:
    """Two thousand boards of a source arrive before the next source's first."""
    from gleanworks.plans.harvest import harvest

    job = lambda title, i: json.dumps([{"text": title, "hostedUrl": f"https://jobs.lever.co/x/{i}", "createdAt": 1769000000000, "descriptionPlain": "spark"}])
    lever = spark.createDataFrame([(job(f"Data Engineer {chr(97 + i % 26) * 9}", i), f"s{i}", f"C{i}", (i << 20) + 3) for i in range(0, 2000, 400)], "raw string, slug string, company string, seq long")
    other = json.dumps({"jobs": [{"title": "Data Engineer", "company_name": "R", "url": "https://r", "publication_date": "2026-01-20"}]})
    rows = harvest({"lever": lever, "remotive": spark.createDataFrame([(other, None, None, 0)], lever.schema)}, settings(), spark.createDataFrame([], files.WATCHLIST + ", seq long"), DAY, DAY)
    arrived = [r.source for r in rows.orderBy("seq").collect()]
    assert arrived == ["lever"] * 5 + ["remotive"]
    watch = spark.createDataFrame([("Named", "lever", "S400", None, None, "x", False, False, 1)], files.WATCHLIST + ", seq long")
    rows = harvest({"lever": lever}, settings(), watch, DAY, DAY, boards=watch, keep=lambda t: t.contains("j"))
    # keep takes the place of the configuration's gate; the watchlist names a board's company
    assert {r.company for r in rows.collect()} <= {"Named", *(f"C{i}" for i in range(0, 2000, 400))} and rows.count() == sum("j" in f"Data Engineer {chr(97 + i % 26) * 9}" for i in range(0, 2000, 400))
    assert payloads.stamped(lever, watch, "lever", strict=False).where("slug = 's400'").first().company == "Named"
