"""Golden vectors of the scalar functions, as literal frames."""

from __future__ import annotations

import pytest
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gleanworks.functions import arrangement, dates, places, salary, text, titles, urls, vocab


def each(spark: SparkSession, rows: list, make) -> list:
    """make(column...) for every row of literals."""
    rows = [r if isinstance(r, tuple) else (r,) for r in rows]
    names = [f"c{i}" for i in range(len(rows[0]))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{n} string" for n in names))
    got = df.select("i", make(*(F.col(n) for n in names)).alias("x")).orderBy("i").collect()
    plain = lambda v: tuple(v) if isinstance(v, tuple) else v
    return [plain(r["x"]) for r in got]


def test_dates(spark: SparkSession) -> None:
    assert each(spark, ["2026-07-14T09:00:00Z", "1752000000", "1752000000000", "", None, "soon", "2026-99-99"], dates.to_date) == ["2026-07-14", "2025-07-08", "2025-07-08", "", "", "", "2026-99-99"]
    day = F.lit("2026-07-20").cast("date")
    assert each(spark, ["2026-07-14", "2026-99-99", "", None, "2026-07-21"], lambda c: dates.age_days(c, day)) == [6, None, None, None, -1]
    assert each(spark, ["Posted Today", "Posted Yesterday", "Posted 3 Days Ago", "Posted 30+ Days Ago", "2 weeks ago", "1 month ago", "x"], lambda c: dates.relative_date(c, day)) == ["2026-07-20", "2026-07-19", "2026-07-17", "2026-06-20", "2026-07-06", "2026-06-20", None]


def test_words(spark: SparkSession) -> None:
    low = ["senior ai engineer", "available training", "ai", "x-ai-y", "éaié", "2ai"]
    assert each(spark, low, lambda c: text.whole_word("ai", c)) == [True, False, True, True, True, False]
    assert each(spark, ["Acme, Inc.", "The Company", None, "Foo & Bar LLC"], text.company_block) == ["acme", "", "", "foo bar"]
    assert each(spark, ["Berlin, Germany; Munich", "Remote - India", None, "New York (Hybrid)"], text.norm_location) == ["berlin germany", "india", "", "new york"]
    assert each(spark, ["<p>a&nbsp;&amp;lt; b</p>\n c", None, "x<br>y"], text.clean) == ["a &lt; b c", "", "x y"]
    assert each(spark, ["(Hybrid) Mansfield, MA", "Remote - TX", "((remote))"], text.strip_arrangement) == ["Mansfield, MA", "TX", ""]
    assert each(spark, ["=1+1", "-5", "ok", None, "\tx"], text.guarded) == ["'=1+1", "'-5", "ok", "", "'\tx"]
    assert each(spark, ["Data Dog Inc", "ACME LLC", "Capital Group", ""], text.name_variants) == [["datadog", "data-dog"], ["acme"], [], []]
    assert each(spark, ["Capital Group", "Data Dog"], lambda c: text.name_variants(c, aggressive=True)) == [["capital"], ["datadog", "data-dog", "data"]]


def test_vocabularies(spark: SparkSession) -> None:
    assert each(spark, ["Full-Time", "Contract", "weird", "", None], vocab.employment_type) == ["FULL_TIME", "CONTRACTOR", "OTHER", None, None]
    assert each(spark, ["Singapore", "UK", "Freedonia", "ZZ", "us", None], vocab.country_code) == ["SG", "GB", None, "ZZ", "US", None]
    assert each(spark, ["Louisiana", "la", "Narnia"], vocab.us_state_code) == ["LA", "LA", None]
    assert each(spark, ["per-year-salary", "hourly", "fortnight"], vocab.salary_period) == ["year", "hour", None]
    names = vocab.iso_names(spark)
    assert names["france"] == "FR" and names["uk"] == "GB" and len(names) > 240


def test_places(spark: SparkSession) -> None:
    raw = ["Waco, TX", "Paris, France", "Toronto, ON, CA", "Toronto, ON", "Remote, ON, CA", "Taiwan, Taipei", "CA", "Singapore", "Austin, Texas, US", "Australia, Canada, Germany, United Kingdom", "Georgia", None]
    want = [("Waco", "TX", "US"), ("Paris", None, "FR"), ("Toronto", None, "CA"), (None, None, None), (None, None, "CA"), (None, None, None), (None, None, None), (None, None, "SG"), ("Austin, Texas", None, None), (None, None, "GB"), (None, None, None), (None, None, None)]
    got = each(spark, raw, places.split_place)
    assert got[:8] == want[:8] and got[9:] == want[9:]


def test_scopes(spark: SparkSession) -> None:
    raw = ["Remote - Brazil", "Remote - EMEA", "Remote - US & Canada", "Remote - TX", "Worldwide", "Remote", "Munich, Germany", "Anywhere in Texas", "Remote (UTC+2)", None, "South Africa"]
    want = [(["BR"], None), (None, ["EMEA"]), (["CA", "US"], None), (["US-TX"], None), ([], None), (None, None), (None, None), (None, None), (None, ["TIMEZONE"]), (None, None), (["ZA"], None)]
    assert each(spark, raw, places.remote_scope) == want
    rows = spark.createDataFrame([(["US-TX"], None), (None, ["NORTH AMERICA"]), ([], None), (None, ["EMEA"]), (["BR"], None), (None, None)], "a array<string>, r array<string>")
    ok = lambda allowed: [r.x for r in rows.select(places.scope_allowed(F.col("a"), F.col("r"), allowed).alias("x")).collect()]
    assert ok(["US"]) == [True, True, True, False, False, False]
    assert ok(["US", "UNSTATED"])[-1] and ok([]) == [True] * 6


@pytest.mark.parametrize(("title", "location", "out"), [("Engineer", "Bangalore, India", True), ("Engineer", "Indianapolis, IN", False), ("Capacity Planner", "Austin", False), ("Engineer", "Remote - US & Canada", False), ("US Engineer", "Canada", True)])
def test_excluded_places(spark: SparkSession, title: str, location: str, out: bool) -> None:
    assert each(spark, [(title, location)], places.excluded) == [out]


def test_arrangement(spark: SparkSession) -> None:
    rows = [("Engineer (Remote)", "", ""), ("Engineer", "Austin", "This role is fully remote."), ("Engineer", "", "We are a fully remote company"), ("Engineer", "Palo Alto - Hybrid (Remote)", ""), ("Engineer", "", "hybrid vehicles"), ("Engineer", "", "not a remote role"), ("Non-remote", "", "")]
    assert each(spark, rows, arrangement.signal) == [("remote", "title"), ("remote", "text"), (None, None), ("hybrid", "location"), (None, None), (None, None), ("onsite", "title")]
    assert each(spark, [("Dev", "Remote", ""), ("On-site only", "Remote", ""), ("Dev", "", "work from home")], arrangement.mentions_remote) == [True, False, True]


def test_titles(spark: SparkSession) -> None:
    raw = ["Senior AI Engineer II, Ads (Remote)", "Director of Engineering", "Associate", "VP of Sales", "Staff Engineer", "Senior Director", None]
    got = each(spark, raw, titles.decompose)
    assert got[0][:2] == ("AI Engineer", "II") and got[0][3] == "senior" and "ads" in got[0][2]
    assert [g[0] for g in got[1:6]] == ["Director of Engineering", "Associate", "VP of Sales", "Engineer", "Director"]
    pairs = [("Engineer I", "Engineer II", False), ("Sr Engineer", "Senior Engineer", True), ("Engineer, Payments", "Engineer, Ads", False), ("Engineer (Payments)", "Payments Engineer", True), ("Senior AI Engineer", "AI Engineer (Senior)", True), ("Engineer (Remote)", "Engineer", True)]
    assert each(spark, [p[:2] for p in pairs], titles.same_role) == [p[2] for p in pairs]


def test_urls(spark: SparkSession) -> None:
    raw = ["https://boards.greenhouse.io/acme/jobs/123", "https://jobs.lever.co/acme/0a1b2c3d-ffff", "https://x.com/careers?gh_jid=77", "https://acme.wd5.myworkdayjobs.com/en-US/Site/job/X_R-123", "https://apply.workable.com/j/ABC", "https://x.com", None]
    assert each(spark, raw, urls.opening)[:3] == [("greenhouse", "acme", "123"), ("lever", "acme", "0a1b2c3d-ffff"), ("greenhouse", "", "77")]
    assert each(spark, raw, urls.board)[4:] == [(None, None)] * 3
    entry = each(spark, ["https://Acme.wd5.myworkdayjobs.com/en-US/External_Site/job/1", "https://boards.greenhouse.io/embed/job_app?for=foo&token=7"], urls.board_entry)
    assert entry == [("workday", "acme", "wd5", "External_Site"), ("greenhouse", "foo", None, None)]
    df = spark.createDataFrame([(["https://www.linkedin.com/1", "https://other.net/2", "https://jobs.lever.co/a/3"],), (["https://www.linkedin.com/1", "https://other.net/2"],), (["https://indeed.com/9"],), ([],)], "links array<string>")
    assert [r.x for r in df.select(urls.best_link(F.col("links"), F.lit("Nobody"), F.lit("fallback")).alias("x")).collect()] == ["https://jobs.lever.co/a/3", "https://other.net/2", "https://indeed.com/9", "fallback"]


def test_salaries(spark: SparkSession) -> None:
    def make(lo: Column, hi: Column, per: Column) -> Column:
        return salary.salary(lo, hi, F.lit("usd"), per)

    assert each(spark, [("0", "0", "year"), ("65", None, "hourly"), (None, "9", "x"), ("a", "b", "year")], make) == [(None, None, None, None, None), (65.0, 65.0, "USD", "hour", "stated"), (None, 9.0, "USD", None, "stated"), (None, None, None, None, None)]
    got = each(spark, ["$120K–$150K a year", "50 an hour", "competitive", "150K-120K per year"], salary.parsed)
    assert [g[:2] for g in got] == [(120000.0, 150000.0), (50.0, 50.0), (None, None), (120000.0, 150000.0)] and got[0][3] == "year"
    assert each(spark, [("100000", "150000"), ("5", None), ("0", "0")], salary.range_text) == ["$100,000–$150,000", "$5", ""]
