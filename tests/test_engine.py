"""The posting engine end to end: projections, gates, score, linkage, store, emission, streaming."""

from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tests.conftest import SF

from gleanworks.operators import coerce, linkage, score, store, versions
from gleanworks.plans import config, emit, harvest, queries, registry
from gleanworks.sources import payloads
from gleanworks.streaming import upserts

DAY = "2026-07-20"
ITEMS: dict[str, dict] = {
    "greenhouse": {"title": "AI Engineer", "location": {"name": "Remote - US"}, "absolute_url": "https://boards.greenhouse.io/acme/jobs/11", "first_published": "2026-07-14T09:00:00Z", "departments": [{"name": "R&D"}], "metadata": [{"name": "Team", "value": "X"}, {"name": "None", "value": None}], "content": "&lt;p&gt;Comp: $120k-$150k&lt;/p&gt; <b>llm</b>"},
    "lever": {"text": "ML Engineer", "categories": {"location": "Paris, France", "team": "Core", "commitment": "Full-time"}, "country": "FR", "hostedUrl": "https://jobs.lever.co/acme/0a1b2c3d", "createdAt": 1752000000000, "workplaceType": "remote", "salaryRange": {"min": 100000, "max": 120000, "currency": "USD", "interval": "per-year-salary"}, "descriptionPlain": "Intro", "lists": [{"text": "Need", "content": "<li>python</li>"}], "additionalPlain": "Bye"},
    "ashby": {"title": "Agent Engineer", "location": "New York", "isRemote": True, "workplaceType": "Hybrid", "jobUrl": "https://jobs.ashbyhq.com/acme/0a1b2c3d", "publishedAt": "2026-07-01", "address": {"postalAddress": {"addressLocality": "New York", "addressRegion": "NY", "addressCountry": "United States"}}, "compensation": {"compensationTierSummary": "$1K • equity", "summaryComponents": [{"compensationType": "EquityCashValue"}, {"compensationType": "Salary", "interval": "1 YEAR", "currencyCode": "USD", "minValue": 5, "maxValue": 7}]}},
    "smartrecruiters": {"id": "9", "name": "Developer", "location": {"city": "Oslo", "region": "", "country": "no", "remote": False, "hybrid": True}, "releasedDate": "2026-07-02", "function": {"label": "IT"}},
    "workable": {"title": "Architect", "city": "Rome", "country": "Italy", "telecommuting": True, "shortcode": "AB", "url": "https://apply.workable.com/acme/j/AB/", "created_at": "2026-07-03", "locations": [{"city": "Rome", "region": "Lazio", "country": "Italy", "countryCode": "IT"}]},
    "workday": {"title": "Engineer", "externalPath": "/job/Austin---TX/Engineer_R-123", "postedOn": "Posted 3 Days Ago", "bulletFields": ["R-123"]},
    "rippling": {"uuid": "u", "name": "Engineer", "url": "https://ats.rippling.com/acme/jobs/abcdef", "department": {"label": "Eng"}, "workLocation": {"label": "Remote (US)"}},
    "teamtailor": {"title": "Developer", "url": "https://acme.teamtailor.com/jobs/5", "date_published": "2026-07-05", "_jobposting": {"jobLocationType": "TELECOMMUTE", "jobLocation": [{"address": {"addressLocality": "Malmo", "addressCountry": "SE"}}]}},
    "remotive": {"title": "AI Developer", "company_name": "R", "candidate_required_location": "USA", "url": "https://remotive.com/1", "publication_date": "2026-07-06", "category": "Software", "job_type": "full_time", "tags": ["a", ""], "description": "x"},
    "jobicy": {"jobTitle": "Engineer", "companyName": "J", "jobGeo": "Europe", "url": "https://jobicy.com/1", "pubDate": "2026-07-07", "jobIndustry": ["Dev", "Ops"], "jobType": "full-time", "salaryMin": 1, "salaryMax": 2, "salaryCurrency": "eur", "salaryPeriod": "yearly", "jobExcerpt": "x"},
    "arbeitnow": {"title": "Engineer", "company_name": "A", "location": "Berlin", "url": "https://arbeitnow.com/1", "created_at": 1752000000, "remote": True, "job_types": ["full time"], "tags": []},
    "remoteok": {"position": "Engineer", "company": "O", "location": "", "url": "https://remoteok.com/1", "epoch": 1752000000, "salary_min": 0, "salary_max": 0},
    "himalayas": {"title": "Engineer", "companyName": "name", "companySlug": "big-co", "locationRestrictions": ["Canada"], "applicationLink": "https://himalayas.app/1", "pubDate": 1752000000, "seniority": ["Senior"], "minSalary": 10, "maxSalary": 20, "currency": "USD"},
    "adzuna": {"title": "Engineer", "company": {"display_name": "Z"}, "location": {"display_name": "US", "area": ["US"]}, "redirect_url": "https://adzuna.com/1", "created": "2026-07-08", "salary_min": 3, "salary_max": 4, "salary_is_predicted": "1"},
    "google_jobs": {"title": "Engineer", "company_name": "Googley", "detected_extensions": {"posted_at": "3 days ago", "salary": "$100K–$120K a year"}, "apply_options": [{"link": "https://linkedin.com/1"}, {"link": "https://jobs.lever.co/g/1"}]},
    "hn": {"id": 5, "created_at": "2026-07-09", "author": "me", "text": "Orbit | Engineer | Remote | Full-time | https://acme.com/x"},
    "braintrust": {"id": 3, "title": "Developer", "employer": {"name": "B"}, "locations": [{"location": "US"}], "main_skills": [{"name": "python"}], "payment_type": "hourly", "budget_minimum_usd": "50", "budget_maximum_usd": "60", "created": "2026-07-10", "contract_type": "long"},
    "usajobs": {"MatchedObjectDescriptor": {"PositionTitle": "Engineer", "OrganizationName": "NASA", "PositionLocationDisplay": "Houston, Texas", "PositionLocation": [{"CityName": "Houston, Texas", "CountrySubDivisionCode": "Texas", "CountryCode": "United States"}], "PositionURI": "https://usajobs.gov/1", "PublicationStartDate": "2026-07-11", "JobGrade": [{"Code": "GS"}], "PositionSchedule": [{"Code": "1", "Name": "Full-time"}], "PositionRemuneration": [{"MinimumRange": "10", "MaximumRange": "20", "RateIntervalCode": "PA"}], "UserArea": {"Details": {"JobSummary": "s", "MajorDuties": ["a", "b"], "LowGrade": "13", "HighGrade": "14", "RemoteIndicator": False, "TeleworkEligible": True}}}},
    "themuse": {"id": 7, "name": "Engineer", "contents": "<p>x</p>", "publication_date": "2026-07-12", "company": {"name": "M"}, "locations": [{"name": "Austin, TX"}, {"name": "Flexible / Remote"}], "categories": [{"name": "IT"}], "levels": [{"name": "Mid"}], "refs": {"landing_page": "https://themuse.com/1"}},
}


def landed(spark: SparkSession, source: str, items: list) -> DataFrame:
    path = payloads.TYPES[source][0]
    body: object = items
    for name in reversed(path.split(".") if path else []):
        body = {name: body}
    return spark.createDataFrame([(1, json.dumps(body), "acme", "Acme", "wd5", "Site"), (2, "{broken", "acme", "Acme", "wd5", "Site")], "seq long, raw string, slug string, company string, host string, site string")


def projected(spark: SparkSession, source: str, *items: dict) -> list[dict]:
    how = {"as_of": F.lit(DAY).cast("date")} if source in ("workday", "google_jobs") else {}
    return [r.asDict(recursive=True) for r in payloads.postings(landed(spark, source, list(items)), source, **how).collect()]


@pytest.mark.parametrize("source", ITEMS)
def test_every_source_projects(spark: SparkSession, source: str) -> None:
    (row,) = projected(spark, source, ITEMS[source])
    assert row["title"] and row["url"] and row["company"] and row["source"] == source
    coerced = coerce.coerced(spark.createDataFrame([row], payloads.postings(landed(spark, source, []), source).schema), "now")
    whole = coerced.collect()[0].asDict()
    assert {*coerce.REQUIRED, *coerce.TEXTS, *coerce.STRINGS, *coerce.NUMBERS, *coerce.ARRAYS} <= whole.keys()
    assert all(whole[c] is not None for c in coerce.REQUIRED) and all(whole[c] != "" for c in (*coerce.TEXTS, *coerce.STRINGS))


def test_projection_details(spark: SparkSession) -> None:
    one = lambda s: projected(spark, s, ITEMS[s])[0]
    g = one("greenhouse")
    assert g["posted"] == "2026-07-14" and g["source_extra"]["Team"] == "X" and g["salary"] == "$120k-$150k"
    lv = one("lever")
    assert lv["posted"] == "2025-07-08" and "python" in lv["text"] and lv["salary_period"] == "year" and lv["remote_basis"] == "stated"
    a = one("ashby")
    assert (a["city"], a["state"], a["country"], a["salary_min"], a["remote_type"]) == ("New York", "NY", "US", 5.0, "hybrid") and a["location"] == "New York (Remote)"
    assert one("smartrecruiters")["remote_type"] == "hybrid" and one("workable")["country"] == "IT"
    w = one("workday")
    assert (w["location"], w["posted"]) == ("Austin - TX", "2026-07-17")
    assert one("himalayas")["company"] == "Big Co" and one("jobicy")["department"] == "Dev, Ops"
    z = one("adzuna")
    assert z["remote_type"] == "remote" and z["salary_estimated_min"] == 3.0 and z["salary_min"] is None
    assert one("google_jobs")["url"] == "https://jobs.lever.co/g/1" and one("hn")["employment_type"] == "FULL_TIME"
    assert one("braintrust")["salary"] == "$50-60/hr" and one("usajobs")["seniority"] == "GS-13/14" and one("themuse")["city"] == "Austin"
    assert not projected(spark, "braintrust", {**ITEMS["braintrust"], "title": "AI training evaluator"})
    assert len(projected(spark, "themuse", ITEMS["themuse"], ITEMS["themuse"], {**ITEMS["themuse"], "id": None}, {**ITEMS["themuse"], "id": None})) == 3
    assert not projected(spark, "arbeitnow", {**ITEMS["arbeitnow"], "remote": False}) and not projected(spark, "remoteok", {"legal": "x"})


def test_harvest_end_to_end(spark: SparkSession) -> None:
    frames = {s: landed(spark, s, [ITEMS[s]]) for s in ("greenhouse", "lever", "remotive", "hn")}
    again = {**ITEMS["remotive"], "title": "AI Engineer", "company_name": "Acme", "candidate_required_location": "US"}
    frames["remotive"] = landed(spark, "remotive", [ITEMS["remotive"], again])
    watch = spark.createDataFrame([(1, "Acme", "x", True, False), (2, "ACME", "y", False, True)], "seq int, name string, industry string, frontier boolean, local boolean")
    cfg = config.Config(max_age_days=1000)
    rows = harvest.harvest(frames, cfg, watch, DAY, "2026-07-20T10:00:00")
    got = [r.asDict(recursive=True) for r in rows.collect()]
    acme = [r for r in got if r["title"] == "AI Engineer"]
    assert len(acme) == 1 and acme[0]["sources"] == ["greenhouse", "remotive"] and acme[0]["industry"] == "y" and acme[0]["signals"].startswith("local")
    assert [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True)
    lines = [json.loads(r.value) for r in emit.ndjson(rows.withColumn("id", F.lit("x"))).collect()]
    assert all("parent_company" in x and x["parent_company"] is None for x in lines) and lines[0]["remote"]["type"]
    m = emit.manifest(rows, spark.createDataFrame([("hn: down",)], "error string"), cfg, "a", "b").collect()[0]
    assert m.rows == len(got) and m.sources_failed == 1 and [a.name for a in m.attribution] == ["Remotive"]
    assert [r.name for r in emit.credits(spark, rows).collect()] == ["Remotive"]


def test_score_is_half_even_and_capped(spark: SparkSession) -> None:
    cfg = config.Config()
    body = "We build llm agents with retrieval. " + "word " * 190
    df = spark.createDataFrame([("AI Engineer", "Remote", body, "Acme"), ("Research Scientist", "", "staff augmentation staffing agency", "our client"), (None, None, None, None)], "title string, location string, text string, company string")
    rows = score.with_score(df, cfg).collect()
    raw = sum(w for k, w in cfg.fit_weights.items() if __import__("re").search(f"(?<![a-z0-9]){__import__('re').escape(k)}(?![a-z0-9])", f"ai engineer remote {body}".lower()))
    dl = len(__import__("re").findall("[a-z0-9]+", f"ai engineer remote {body}".lower()))
    norm = 0.25 + 0.75 * dl / 1600
    assert rows[0].score == round(min(raw * 2.2 / (1 + 1.2 * norm), 60) + min(4, 12))
    assert rows[1].score == round(1 * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 6 / 1600)) - 8 - 15) and rows[2].score == 0


def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def test_ratios() -> None:
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choices("ab c", k=rng.randint(1, 20))) for _ in range(2))
        assert linkage.indel_ratio(a, b) == pytest.approx(200 * lcs(a, b) / (len(a) + len(b)))
    assert linkage.token_set_ratio("ai engineer", "ai engineer payments") == 100 and linkage.token_sort_ratio("ai engineer", "ai engineer payments") == pytest.approx(71, abs=0.5)


def plain_fold(rows: list[dict]) -> set[tuple]:
    """The rule, row by row in arrival order, over rows as they come: (key, seq, sources) of the survivors."""
    kept: dict[str, dict] = {}
    for p in sorted(rows, key=lambda r: r["seq"]):
        p = {**p, "sources": {p["source"]} - {""}}
        key = p["dedup_key"] if p["dedup_key"] in kept else None
        if key is None and p["_blk"]:
            for k, q in kept.items():
                if q["_blk"] != p["_blk"] or (p["_ref"] and q["_ref"] and (p["_ats"], p["_slug"]) == (q["_ats"], q["_slug"]) and p["_ref"] != q["_ref"]):
                    continue
                mine, other = set(p["_quals"]) - set(q["_words"]), set(q["_quals"]) - set(p["_words"])
                if set(p["_levels"]) != set(q["_levels"]) or mine != other or not p["_nt"] or not q["_nt"]:
                    continue
                if linkage.token_sort_ratio(p["_core"], q["_core"]) >= 82 and linkage.token_set_ratio(p["_nt"], q["_nt"]) >= 90:
                    key = k
                    break
        if key is None:
            kept[p["dedup_key"]] = p
            continue
        q = kept[key]
        best = p if (p["_pref"], p["_len"], p["score"]) > (q["_pref"], q["_len"], q["score"]) else q
        kept[key] = {**best, "dedup_key": key, "sources": p["sources"] | q["sources"]}
    return {(q["dedup_key"], q["seq"], tuple(sorted(q["sources"]))) for q in kept.values()}


POSTING = "seq long, title string, company string, location string, url string, text string, source string, score int"


@pytest.mark.parametrize("seed", range(3))
def test_linkage_equals_a_plain_fold(spark: SparkSession, seed: int) -> None:
    rng = random.Random(seed)
    names = ["AI Engineer", "AI Engineer, Payments", "Engineer AI", "Senior AI Engineer", "Sr AI Engineer", "Data Analyst", "Analyst, Data", "AI Engineer (Remote)", "AI Engineer Ads", "AI Engineer, Ads", "AI Engineers", "", "Ads"]
    boards = ["https://boards.greenhouse.io/a/jobs/1", "https://boards.greenhouse.io/a/jobs/2", "https://x"]
    rows = [(i, rng.choice(names), rng.choice(["Acme Inc", "Acme", "Beta", "LLC", ""]), rng.choice(["", "Paris"]), rng.choice(boards), "t" * rng.randint(0, 5), rng.choice(["greenhouse", "hn", "google_jobs", ""]), rng.randint(0, 3)) for i in range(220)]
    df = spark.createDataFrame(rows, POSTING)
    keyed = [r.asDict() for r in linkage.with_keys(df).collect()]
    got = [(r.dedup_key, r.seq, tuple(r.sources)) for r in linkage.linked(df.repartition(3)).collect()]
    assert set(got) == plain_fold(keyed) and len(got) == len(set(got)) < len({r["dedup_key"] for r in keyed})


def test_linkage_keeps_arrival_order(spark: SparkSession) -> None:
    """A title with a comma has another title's key, but not its marks: it joins in its turn."""
    rows = [(1, "AI Engineer Ads", "Acme", "", "", "t", "hn", 1), (2, "AI Engineer", "Acme", "", "", "t", "remotive", 1), (3, "AI Engineer, Ads", "Acme", "", "", "long text", "lever", 1)]
    df = spark.createDataFrame(rows, POSTING)
    want = plain_fold([r.asDict() for r in linkage.with_keys(df).collect()])
    assert {(r.dedup_key, r.seq, tuple(r.sources)) for r in linkage.linked(df).collect()} == want


def test_titles_that_match_are_in_one_component() -> None:
    rng = random.Random(4)
    words = ["data", "engineer", "engineers", "payments", "payment", "ai", "ml", "platform", "platforms", "growth", "risk", "ads", "of"]
    for _ in range(60):
        titles = {" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(60)} | {"x" * rng.randint(1, 30) for _ in range(3)}
        forms = [{"_nt": t, "_core": t, "_levels": [], "_quals": rng.sample(["a", "b"], rng.randint(0, 1)), "_words": t.split()} for t in sorted(titles)]
        found = linkage.TitleIndex(forms, 90, 82).components()
        for i, p in enumerate(forms):
            for j, q in enumerate(forms[:i]):
                assert found[i] == found[j] or not linkage._similar(p, q, 90, 82), (p, q)
        assert len(set(found)) > 5


def test_many_companies_are_few_calls(spark: SparkSession) -> None:
    """Companies with a few titles each go through Python in batches of many, not in a call for each."""
    titles = ["AI Engineer", "Engineer AI", "Chef", "AI Engineers", "Data Analyst", "Cook", "Chef de Cuisine", "Analyst, Data", "Baker", "Brewer"]
    rows = [(i, titles[i * i % (2 + c % 9)], f"Firm {c}", "", "", "t", ["hn", "lever"][i % 2], i % 3) for c in range(400) for i in range(c * 4, c * 4 + 4)]
    df = spark.createDataFrame(rows, POSTING)
    found = linkage.linked(df)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.dedup_key, r.seq, tuple(r.sources)) for r in found.collect()} == plain_fold([r.asDict() for r in linkage.with_keys(df).collect()])


def test_one_company_is_many_tasks(spark: SparkSession) -> None:
    """Titles that don't resemble each other are folded apart, whoever posts them."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=7))
    rows = [(i, f"{word()} {word()}", "Agency", "", "", "t", "hn", 1) for i in range(3000)]
    df = spark.createDataFrame(rows, POSTING)
    began = time.time()
    assert linkage.linked(df).count() > 2900 and time.time() - began < 60
    plan = linkage.linked(df)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_component" in plan and plan.count("MapInPandas") >= 1


def test_store_lifecycle(spark: SparkSession, tmp_path) -> None:
    postings = spark.createDataFrame([("k1", "A", "u1", 30, "2026-07-14"), ("k2", "B", "u2", 25, None)], "dedup_key string, title string, url string, score int, posted string")
    day = F.lit(DAY).cast("date")
    first = store.upsert(spark.createDataFrame([], ", ".join(f"{c} string" for c in store.COLUMNS)), store.store_rows(postings, day))
    assert {(r.dedup_key, r.is_new, r.age_days) for r in first.collect()} == {("k1", True, "6"), ("k2", True, "")}
    row_id = first.where("dedup_key = 'k1'").first().id
    marked = store.mark_status(first.drop("is_new"), row_id, "applied")
    again = spark.createDataFrame([("k2b", "B2", "u2", 40, None)], "dedup_key string, title string, url string, score int, posted string")
    second = {r.dedup_key: r for r in store.upsert(marked, store.store_rows(again, F.lit("2026-07-21").cast("date"))).collect()}
    assert set(second) == {"k1", "k2b"} and second["k1"].status == "applied" and not second["k2b"].is_new and second["k2b"].first_seen == DAY
    frame = spark.createDataFrame(list(second.values()))
    noted = store.annotate(frame, spark.createDataFrame([("k2b", "99", "good")], "dedup_key string, llm_score string, llm_note string"))
    (seen,) = store.surface(noted, config.Config()).collect()
    assert (seen.dedup_key, seen.llm_score) == ("k2b", "99")
    assert "[" in noted.select(emit.line(config.Config()).alias("x")).first().x
    assert store.guarded_csv(frame.withColumn("title", F.lit("=1"))).first().title == "'=1"
    assert [r.x for r in spark.createDataFrame([("1.9",), ("inf",), ("x",), (None,)], "c string").select(store.tolerant_int(F.col("c")).alias("x")).collect()] == [1, 0, 0, 0]


def test_streamed_upserts_equal_batches(spark: SparkSession, tmp_path) -> None:
    schema = "dedup_key string, title string, url string, score int, posted string"
    landing = f"{tmp_path}/in"
    for rows in ([("a", "x", "u", 1, None)], [("b", "y", "v", 2, None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
    query = upserts.start_upserts(spark, landing, schema, f"{tmp_path}/store", f"{tmp_path}/ck", DAY, files_per_batch=1)
    query.awaitTermination(120)
    table = versions.Versions(spark, f"{tmp_path}/store", upserts.STORE)
    assert query.exception() is None and table.state()[0] == 2 and len(table.read().collect()) == 1
    body = upserts.upsert_batch(spark, f"{tmp_path}/store", DAY)
    body(spark.createDataFrame([("c", "z", "w", 3, None)], schema), 1)  # a batch that is replayed changes nothing
    assert table.state()[0] == 2


def test_config() -> None:
    cfg, warnings = config.load("filters:\n  exclude_titles: intern\n  min_score: 5\n  nonsense: 1\n  max_age_days:\n")
    assert cfg.exclude_titles == ("intern",) and cfg.min_score == 5 and cfg.max_age_days == 60 and warnings == ["unknown key nonsense"]


def test_score_plan_has_no_python(spark: SparkSession) -> None:
    plan = queries.kw_score(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_score_is_computed_once(spark: SparkSession) -> None:
    """A filter on the score must not put the whole computation in its place again."""
    count = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("[^a-z0-9]+")
    assert count(queries.shortlist(spark, SF)) == count(queries.kw_score(spark, SF))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_match_sql(spark: SparkSession, name: str) -> None:
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = registry.QUERIES[name](spark, SF)
    want = con.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    plain = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    assert got == sorted(tuple(plain(r[want.columns.index(c)]) for c in order) for r in want.fetchall())


def test_discovery(spark: SparkSession) -> None:
    from gleanworks.operators import discovery

    lines = spark.createDataFrame([('{"url": "https://jobs.lever.co/Acme/1"}',), ('{"url": "https://jobs.lever.co/acme/2"}',), ("{broken",), ('{"url": "https://jobs.lever.co/jobs"}',), ('{"url": "https://t.wd1.myworkdayjobs.com/Site/job"}',)], "value string")
    boards = discovery.mined(lines)
    assert {(r.ats, r.slug, r.site) for r in boards.collect()} == {("lever", "acme", None), ("workday", "t", "Site")}
    seeds = discovery.seeded(boards, spark.createDataFrame([("lever/acme",)], "entry_key string"), 5)
    assert [r.slug for r in seeds.collect()] == ["t"]

    def ask(ats: str, slug: str) -> tuple:
        if slug == "boom":
            raise OSError("down")
        return {"no": (403, 0, None), "slow": (429, 0, None), "gone": (404, 0, None), "idle": (200, 0, None), "other": (200, 4, "Someone Else")}.get(slug, (200, 3, "Acme Inc."))

    candidates = spark.createDataFrame([(a, s, "Acme") for a, s in [("greenhouse", "acme"), ("greenhouse", "other"), ("lever", "other"), ("lever", "no"), ("lever", "slow"), ("lever", "gone"), ("lever", "idle"), ("lever", "boom"), ("zzz", "x")]], "ats string, slug string, name string")
    got = {(r.ats, r.slug): r.outcome for r in discovery.probed(candidates, ask, ("greenhouse", "lever")).collect()}
    assert list(got.values()) == ["ok", "wrong-owner", "ok", "refused", "throttled", "missing", "empty", "error", "unsupported"]
    names = spark.createDataFrame([(1, "Data Dog"), (2, "Datadog"), (3, "Capital Group")], "seq int, name string")
    universe = spark.createDataFrame([(1, "lever", "datadog"), (2, "ashby", "DataDog"), (3, "lever", "capital"), (4, "lever", "data-dog")], "seq int, ats string, slug string")
    assert {(r.name, r.ats, r.slug) for r in discovery.match_known(names, universe).collect()} == {("Data Dog", "lever", "datadog"), ("Datadog", "ashby", "datadog"), ("Data Dog", "lever", "data-dog")}
    assert discovery.page_ceiling(lambda n: (200, 20) if n <= 37 else (200, 0), 20) == 37 and discovery.page_ceiling(lambda n: (200, 20), 20) is None


def test_strip_html_equals_its_sql_on_odd_pages(spark: SparkSession, tmp_path) -> None:
    import duckdb

    odd = ["x &amp y", "x &am", "&quot", "&amp;amp;quot; &copy;&middot;&quot;", "&lt;b&gt; &nbsp; &#39;", "a\u00a0 \u00a0b\x0b\x0bc\x85", "\u00a0a\u2003", "<a\n>x</a", "<>", " \t\r\f\n", "", None]
    rows = spark.createDataFrame(list(enumerate(odd)), "page_id long, html string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    mine = {tuple(r) for r in registry.QUERIES["strip_html"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert mine == set(con.execute(registry.ORACLES["strip_html"]).fetchall())


def test_page_ceilings_of_long_lists(spark: SparkSession, tmp_path) -> None:
    from gleanworks.operators import discovery

    for last in (1, 998, 999, 1000, 4095, 4096, 4097, 12_000, 3_000_000):
        assert discovery.page_ceiling(lambda n, last=last: (200, 20) if n <= last else (200, 0), 20) == last
    assert discovery.page_ceiling(lambda n: (200, 20) if n <= 37 else (404, 0), 20, most=37) is None
    assert discovery.page_ceiling(lambda n: (200, 20) if n < 37 else (200, 5), 20, most=37) == 37
    # nation 1 has 3,000 customers (page 999 is full), nation 2 has 13,000 (more than 4,096 pages of three)
    sizes = "case when id < 3000 then 1 when id < 16000 then 2 else 5 end"
    spark.range(16_010).selectExpr("id as c_custkey", f"cast({sizes} as int) as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    assert {tuple(r) for r in registry.QUERIES["page_ceilings"](spark, str(tmp_path)).collect()} == {(1, 1000), (2, 4334), (5, None)}


def test_files(spark: SparkSession, tmp_path) -> None:
    from gleanworks.sources import files

    assert files.store_csv(spark, f"{tmp_path}/none.csv").count() == 0
    (tmp_path / "s.csv").write_bytes("﻿id,title,dedup_key\n1,\"a, \"\"b\"\"\",k\n".encode())
    (row,) = files.store_csv(spark, f"{tmp_path}/s.csv").collect()
    assert (row.id, row.title, row.dedup_key, row.status) == ("1", 'a, "b"', "k", "")
    (tmp_path / "u.csv").write_bytes("id,title\n2,é\n".encode("utf-16"))
    assert files.store_csv(spark, f"{tmp_path}/u.csv").first().title == "é"
    (tmp_path / "w.json").write_text('[{"name": "Acme", "ats": "lever", "slug": "acme", "local": true}]')
    rows, error = files.watchlist_json(spark, f"{tmp_path}/w.json")
    assert rows.first().slug == "acme" and error is None
    (tmp_path / "bad.json").write_text("[{")
    assert files.watchlist_json(spark, f"{tmp_path}/bad.json")[1]
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>T &amp; U</title><link>http://x</link><pubDate>d</pubDate><description>b</description></item></channel></rss>")
    assert tuple(files.feed(spark, f"{tmp_path}/f.xml").first()) == ("T & U", "http://x", "d", "b")
    (tmp_path / "p.md").write_text("---\nname: a\nauth: TODO\n---\nbody TODO\n")
    front = files.profiles(spark, f"{tmp_path}/p.md")
    (done,) = files.completeness(front, ("name", "auth", "pages")).collect()
    assert (done.todos, done.missing) == (2, ["pages"])
    now = spark.createDataFrame([("a", "1", "x"), ("b", "2", None)], "name string, rows string, auth string")
    index = spark.createDataFrame([("a", "1", "y")], "name string, rows string, auth string")
    assert {(r.name, r.field, r.indexed) for r in files.drift(now, index, ("rows", "auth")).collect()} == {("a", "auth", "y"), ("b", "rows", None)}
    late = now.select(F.raise_error(F.lit("down")).alias("x"))
    for landing in (None, f"file://{tmp_path}/landing"):
        frames, errors = files.each_apart({"ok": lambda: now, "bad": lambda: 1 / 0, "late": lambda: late}, landing)
        assert list(frames) == ["ok"] and [n for n, _ in errors] == ["bad", "late"] and frames["ok"].count() == 2
    (tmp_path / "broken.csv").write_bytes(b"id,title\n1,\xff\xe9\n")
    with pytest.raises(files.UnreadableStore, match="UTF-8"):
        files.store_csv(spark, f"{tmp_path}/broken.csv")


def test_pages_source(spark: SparkSession, tmp_path) -> None:
    from gleanworks.sources import http

    (tmp_path / "1.json").write_text('{"jobs": [1]}')
    (tmp_path / "2.json").write_text("no json")
    spark.dataSource.register(http.PagesSource)
    rows = spark.read.format("pages").options(template=f"file://{tmp_path}/{{page}}.json", pages=3, slug="s").load().orderBy("seq").collect()
    assert [(r.seq, r.raw) for r in rows] == [(1, '{"jobs": [1]}'), (2, None), (3, None)]


def test_rerank(spark: SparkSession) -> None:
    from gleanworks.plans import rerank

    rows = spark.createDataFrame([("k0", "A", "B"), ("k1", "C", "D")], "dedup_key string, title string, company string")
    reply = 'Sure: [{"id": 0, "fit": 90, "note": "ok"}, {"id": 9, "fit": 1}, {"fit": 2}, {"id": 1, "fit": null}] done'
    assert [tuple(r) for r in rerank.rerank(spark, rows, config.Config(), lambda _: reply).collect()] == [("k0", "90", "ok"), ("k1", "0", "")]
    assert rerank.rerank(spark, rows, config.Config(), None).count() == 0 and rerank.rerank(spark, rows, config.Config(), lambda _: 1 / 0).count() == 0
