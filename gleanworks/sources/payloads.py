"""From landed vendor payloads to posting rows: one projection for each source.

A landed payload is a line of JSON (``raw``) with the board's ``slug`` and ``company`` where it is one
company's. Each source states the container of its items and their type; parsing is permissive, so fields of
another type come out null rather than as an exception. A projection names what its source sends; the rest
of the contract is filled by ``coerce``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanworks.functions import dates, places, salary, text, vocab

NAMED = "STRUCT<name:STRING>"
LABELED = "STRUCT<label:STRING>"


def item(path: str) -> Column:
    return F.col(f"item.{path}")


def said(c: Column) -> Column:
    """Null for empty."""
    return F.nullif(c.cast("string"), F.lit(""))


def first_of(*cs: Column) -> Column:
    """The first that isn't null or empty, else empty."""
    return F.coalesce(*(said(c) for c in cs), F.lit(""))


def joined(c: Column, by: str = ", ") -> Column:
    """A field that is text or a list of texts (parsed as text, a list is its JSON)."""
    return F.when(
        c.startswith("["), F.array_join(F.filter(F.from_json(c, "array<string>"), lambda x: F.coalesce(x, F.lit("")) != ""), by)
    ).otherwise(F.coalesce(c, F.lit("")))


def names(a: Column, f: str) -> Column:
    return F.filter(F.transform(a, lambda x: x[f]), lambda x: F.coalesce(x, F.lit("")) != "")


def some(a: Column) -> Column:
    """Without empties; null if nothing is left."""
    kept = F.filter(a, lambda x: F.coalesce(x, F.lit("")) != "")
    return F.when(F.size(kept) > 0, kept)


def extra(**fields: Column) -> Column:
    """The fields of one source alone, without empties."""
    m = F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))))
    kept = F.map_filter(m, lambda _, v: F.coalesce(v, F.lit("")) != "")
    return F.when(F.size(kept) > 0, kept)


def pay(lo: Column, hi: Column, currency: Column, period: Column) -> dict[str, Column]:
    s = salary.salary(lo, hi, currency, period)
    return {k: s[k] for k in ("salary_min", "salary_max", "salary_currency", "salary_period", "salary_basis")}


def posted(*cs: Column) -> dict[str, Column]:
    d = F.nullif(dates.to_date(F.coalesce(*(said(c) for c in cs))), F.lit(""))
    return {"posted": d, "posted_basis": F.when(d.isNotNull(), "stated")}


def remote_board() -> dict[str, Column]:
    return {"remote_type": F.lit("remote"), "remote_basis": F.lit("board")}


def with_remote(place: Column) -> Column:
    return F.trim(F.concat(F.coalesce(place, F.lit("")), F.lit(" (Remote)")))


def money(body: Column) -> Column:
    """The first ``$`` range of a text that a k, a comma or a unit anchors as pay."""
    # How a range of pay is written, and what follows one that is no pay.
    found = F.regexp_extract(body, r"(\$\s?\d[\d,.]*[kK]?\s?(?:-|–|—|to)\s?\$?\s?\d[\d,.]*[kK]?)(?!\s?(?:[MmBb]\b|[mb]illion))", 1)
    unit = body.rlike(r"\$\s?\d[\d,.]*[kK]?\s?(?:-|–|—|to)\s?\$?\s?\d[\d,.]*[kK]?\s?(?:/|per|an?)\s?(?:hr|hour|year|yr|month|week|day)")
    return F.when(found.rlike("[kK,]") | unit, found).otherwise("")


def greenhouse() -> dict[str, Column]:
    i = item
    body, dept = text.clean(i("content")), F.get(i("departments"), F.lit(0))["name"]
    meta = F.map_from_entries(
        F.transform(
            F.filter(i("metadata"), lambda m: (F.coalesce(m["name"], F.lit("")) != "") & (F.coalesce(m["value"], F.lit("")) != "")),
            lambda m: F.struct(m["name"], m["value"])
        )
    )
    own = F.map_filter(F.create_map(F.lit("updated_at"), dates.to_date(i("updated_at"))), lambda _, v: v != "")
    return {
        "title": i("title"), "location": i("location.name"), "url": i("absolute_url"), **posted(i("first_published"), i("updated_at")),
        "expires": said(dates.to_date(i("application_deadline"))), "department": first_of(dept), "team": said(dept),
        "source_extra": F.map_concat(own, F.map_filter(F.coalesce(meta, F.create_map().cast("map<string,string>")), lambda k, _: k != "updated_at")),
        "salary": money(body), "text": body
    }


def lever() -> dict[str, Column]:
    sections = F.flatten(
        F.transform(
            F.coalesce(item("lists"), F.array().cast("array<struct<text:string,content:string>>")),
            lambda s: F.array(s["text"], s["content"])
        )
    )
    body = text.clean(
        F.concat_ws("\n", first_of(item("descriptionPlain"), item("description")), F.array_join(sections, "\n"), item("additionalPlain"))
    )
    lo, hi = item("salaryRange.min"), item("salaryRange.max")
    shown = F.when(
        (lo > 0) & (hi > 0), F.concat(salary.range_text(lo, hi), F.lit(" "), F.coalesce(item("salaryRange.currency"), F.lit("USD")))
    ).otherwise(first_of(item("salaryDescription"), money(body)))
    team, kind = first_of(item("categories.team"), item("categories.department")), vocab.remote_type(item("workplaceType"))
    return {
        "title": item("text"), "location": item("categories.location"), "country": vocab.country_code(item("country")),
        "url": item("hostedUrl"), **posted(item("createdAt")), "department": team, "team": said(team), "remote_type": kind,
        "remote_basis": F.when(kind.isNotNull(), "stated"), "employment_type": item("categories.commitment"),
        **pay(lo, hi, item("salaryRange.currency"), item("salaryRange.interval")), "salary": shown, "text": body
    }


def ashby() -> dict[str, Column]:
    body = text.clean(item("descriptionPlain"))
    part = F.get(
        F.filter(
            item("compensation.summaryComponents"),
            lambda c: (c["compensationType"] == "Salary") & (F.coalesce(c["minValue"], c["maxValue"], F.lit(0.0)) != 0)
        ),
        F.lit(0)
    )
    shown = first_of(
        F.trim(F.split_part(F.coalesce(item("compensation.compensationTierSummary"), F.lit("")), F.lit("•"), F.lit(1))),
        F.get(item("compensation.compensationTiers"), F.lit(0))["title"], money(body)
    )
    team, at = first_of(item("department"), item("team")), "address.postalAddress."
    return {
        "title": item("title"), "location": F.when(item("isRemote"), with_remote(item("location"))).otherwise(item("location")),
        "url": first_of(item("jobUrl"), item("applyUrl")), **posted(item("publishedAt"), item("updatedAt")), "department": team,
        "team": said(team), "remote_type": vocab.remote_type(item("workplaceType")),
        "remote_basis": F.when(said(item("workplaceType")).isNotNull(), "stated"), "city": said(item(at + "addressLocality")),
        "state": said(item(at + "addressRegion")), "country": vocab.country_code(item(at + "addressCountry")),
        "employment_type": item("employmentType"), "salary": shown,
        **pay(part["minValue"], part["maxValue"], part["currencyCode"], part["interval"]), "text": body
    }


def smartrecruiters() -> dict[str, Column]:
    place = F.array_join(some(F.array(*(item(f"location.{c}") for c in ("city", "region", "country")))), ", ")
    remote, hybrid = item("location.remote"), item("location.hybrid")
    kind = F.when(remote, "remote").when(hybrid, "hybrid").when(remote.isNotNull() & ~remote, "onsite")
    return {
        "title": item("name"), "location": F.when(remote, with_remote(place)).otherwise(F.coalesce(place, F.lit(""))),
        "url": F.concat(F.lit("https://jobs.smartrecruiters.com/"), F.col("slug"), F.lit("/"), F.coalesce(item("id"), F.lit(""))),
        **posted(item("releasedDate"), item("createdOn")), "department": first_of(item("department.label")),
        "category": said(item("function.label")), "team": said(item("department.label")), "seniority": said(item("experienceLevel.label")),
        "city": said(item("location.city")), "state": said(item("location.region")),
        "country": vocab.country_code(item("location.country")), "remote_type": kind, "remote_basis": F.when(remote.isNotNull(), "stated"),
        "employment_type": item("typeOfEmployment.label"),
        "source_extra": extra(
            industry=item("industry.label"), hybrid=hybrid, latitude=item("location.latitude"), longitude=item("location.longitude"),
            ref_number=item("refNumber")
        ),
        "salary": F.lit(""), "text": F.lit("")
    }


def workable() -> dict[str, Column]:
    head, body = F.get(item("locations"), F.lit(0)), text.clean(item("description"))
    city, state = F.coalesce(said(item("city")), said(head["city"])), F.coalesce(said(item("state")), said(head["region"]))
    country = vocab.country_code(first_of(head["countryCode"], item("country"), head["country"]))
    place, far = F.array_join(some(F.array(city, state, country)), ", "), item("telecommuting")
    link = first_of(
        item("application_url"), item("url"),
        F.concat(F.lit("https://apply.workable.com/"), F.col("slug"), F.lit("/j/"), item("shortcode"), F.lit("/"))
    )
    every = F.transform(
        item("locations"),
        lambda x: F.struct(
            F.array_join(some(F.array(x["city"], x["region"], x["country"])), ", ").alias("raw"), x["city"].alias("city"),
            x["region"].alias("state"), F.coalesce(said(x["countryCode"]), x["country"]).alias("country"),
            first_of(item("application_url"), item("url")).alias("url")
        )
    )
    return {
        "title": first_of(item("title"), item("full_title")),
        "location": F.when(far, with_remote(place)).otherwise(F.coalesce(place, F.lit(""))), "url": link,
        **posted(item("created_at"), item("published_on")), "department": item("department"), "team": said(item("department")),
        "city": city, "state": state, "country": country, "locations": F.when(F.size(every) > 0, every),
        "remote_type": F.when(far, "remote").when(far.isNotNull(), "onsite"), "remote_basis": F.when(far.isNotNull(), "stated"),
        "seniority": said(item("experience")), "category": said(item("function")),
        "source_extra": extra(industry=item("industry"), education=item("education"), shortcode=item("shortcode")),
        "employment_type": item("employment_type"), "salary": money(body), "text": body
    }


# How a list's bullets tell a date and a requisition.
POSTING_DATE = r"Posting Date:\s*(\d{1,2})/(\d{1,2})/(\d{4})"
REQUISITION = r"^[A-Za-z]{0,4}[-_]?\d{3,}$"


def unslugged(segment: Column) -> Column:
    """A path's segment as the words it was made from: ``---`` was a dash between blanks, ``--`` a dash, ``-`` a blank."""
    marked = F.replace(F.replace(F.coalesce(segment, F.lit("")), F.lit("---"), F.lit(" \x00 ")), F.lit("--"), F.lit("\x00"))
    return F.trim(F.regexp_replace(F.replace(F.replace(marked, F.lit("-"), F.lit(" ")), F.lit("\x00"), F.lit("-")), " +", " "))


def workday(as_of: Column | None = None) -> dict[str, Column]:
    as_of = as_of if as_of is not None else F.current_date()
    bullets = F.transform(item("bulletFields"), lambda b: F.trim(b))
    places_said = F.filter(bullets, lambda b: (b != "") & ~b.rlike(POSTING_DATE) & ~b.rlike(REQUISITION))
    parts = F.filter(F.split(F.coalesce(item("externalPath"), F.lit("")), "/"), lambda x: x != "")
    segment = F.when((F.size(parts) >= 3) & (F.get(parts, F.lit(0)) == "job"), unslugged(F.get(parts, F.lit(1))))
    dated = F.get(F.filter(bullets, lambda b: b.rlike(POSTING_DATE)), F.lit(0))
    part = lambda i: F.regexp_extract(dated, POSTING_DATE, i)
    on = F.when(dated.isNotNull(), F.concat_ws("-", part(3), F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0")))
    ago = dates.relative_date(item("postedOn"), as_of)
    path = F.coalesce(item("externalPath"), F.lit(""))
    url = F.concat(F.lit("https://"), F.col("slug"), F.lit("."), F.col("host"), F.lit(".myworkdayjobs.com/en-US/"), F.col("site"), path)
    return {
        "title": item("title"), "location": first_of(F.trim(item("locationsText")), F.get(places_said, F.lit(0)), segment), "url": url,
        "posted": F.coalesce(on, ago), "posted_basis": F.when(on.isNotNull(), "stated").when(ago.isNotNull(), "relative"),
        "employment_type": F.lit(""), "salary": F.lit(""), "text": F.lit(""), "detail_key": F.concat_ws("/", "slug", "host", "site", F.nullif(path, F.lit(""))),
    }


def workday_detail() -> dict[str, Column]:
    body = text.clean(F.col("info.jobDescription"))
    return {"text": body, "salary": money(body), **posted(F.col("info.startDate")), "employment_type": F.col("info.timeType")}


def rippling() -> dict[str, Column]:
    return {
        "title": item("name"), "location": item("workLocation.label"), "url": item("url"), "department": item("department.label"), "team": said(item("department.label")),
        "employment_type": F.lit(""), "salary": F.lit(""), "text": F.lit(""), "detail_key": F.concat_ws("/", "slug", F.nullif(item("uuid"), F.lit(""))),
    }


def rippling_detail() -> dict[str, Column]:
    """The role's text before the company's; the first pay range with a figure; the kind's name stands in its id."""
    raw = F.col("info.description")
    parts = F.from_json(raw, "STRUCT<role:STRING,company:STRING>")
    body = text.clean(
        F.when(raw.startswith("{"), F.concat_ws(" ", said(parts["role"]), said(parts["company"]))).otherwise(F.coalesce(raw, F.lit("")))
    )
    ranges = F.filter(F.col("info.payRangeDetails"), lambda r: F.coalesce(salary.number(r["rangeStart"]), salary.number(r["rangeEnd"])).isNotNull())
    first = F.get(ranges, F.lit(0))
    spots = F.filter(F.col("info.workLocations"), lambda x: F.coalesce(x, F.lit("")) != "")
    return {
        "text": body, "salary": money(body), **posted(F.col("info.createdOn")), "employment_type": first_of(
            F.col("info.employmentType.id"), F.col("info.employmentType.label")
        ),
        "location": F.when(F.size(spots) > 0, F.array_join(spots, "; ")), **pay(
            first["rangeStart"], first["rangeEnd"], first["currency"], first["frequency"]
        ),
    }


# Where a detail payload holds what it tells, and its type.
DETAILS: dict[str, tuple[str, str, Callable[[], dict[str, Column]]]] = {
    "workday": ("jobPostingInfo", "jobDescription STRING, startDate STRING, timeType STRING", workday_detail),
    "rippling": (
        "",
        "description STRING, createdOn STRING, payRangeDetails ARRAY<STRUCT<rangeStart:DOUBLE,rangeEnd:DOUBLE,currency:STRING,frequency:STRING>>, employmentType STRUCT<id:STRING,label:STRING>, workLocations ARRAY<STRING>",
        rippling_detail
    ),
}


def teamtailor() -> dict[str, Column]:
    p = "_jobposting."
    spot = F.coalesce(
        F.get(
            F.from_json(item(p + "jobLocation"), "array<STRUCT<address:STRUCT<addressLocality:STRING,addressRegion:STRING,addressCountry:STRING>>>"),
            F.lit(0)
        ),
        F.from_json(item(p + "jobLocation"), "STRUCT<address:STRUCT<addressLocality:STRING,addressRegion:STRING,addressCountry:STRING>>")
    )["address"]
    body, kind = text.clean(first_of(item(p + "description"), item("content_html"))), F.when(item(p + "jobLocationType") == "TELECOMMUTE", "remote")
    return {
        "title": item("title"),
        "location": F.array_join(some(F.array(spot["addressLocality"], spot["addressRegion"], spot["addressCountry"])), ", "),
        "url": item("url"), **posted(item("date_published")), "expires": said(dates.to_date(item(p + "validThrough"))),
        "city": said(spot["addressLocality"]), "state": said(spot["addressRegion"]), "country": vocab.country_code(spot["addressCountry"]),
        "remote_type": kind, "remote_basis": F.when(kind.isNotNull(), "stated"), "employment_type": item(p + "employmentType"),
        "company": item(p + "hiringOrganization.name"), "salary": money(body), "text": body
    }


def stated(raw: Column) -> dict[str, Column]:
    """Residence requirements as the vendor states them, a list or text."""
    s = places.stated_scope(raw)
    return {"remote_areas": s["areas"], "remote_regions": s["regions"], "remote_scope_raw": s["raw"]}


def remotive() -> dict[str, Column]:
    body, place = text.clean(item("description")), item("candidate_required_location")
    return {
        "title": item("title"), "company": item("company_name"), "location": F.concat(F.coalesce(place, F.lit("")), F.lit(" (Remote)")),
        **stated(place), "url": item("url"), **posted(item("publication_date")), "department": item("category"),
        "category": said(item("category")), **remote_board(), "tags": some(item("tags")), "employment_type": item("job_type"),
        "salary": first_of(item("salary"), money(body)), "text": body
    }


def jobicy() -> dict[str, Column]:
    body = text.clean(first_of(item("jobDescription"), item("jobExcerpt")))
    return {
        "title": item("jobTitle"), "company": item("companyName"),
        "location": F.concat(F.coalesce(item("jobGeo"), F.lit("")), F.lit(" (Remote)")), "url": item("url"), **posted(item("pubDate")),
        "department": joined(item("jobIndustry")), "category": said(joined(item("jobIndustry"))),
        "seniority": said(joined(item("jobLevel"))), **remote_board(), "employment_type": joined(item("jobType")), "salary": money(body),
        **pay(item("salaryMin"), item("salaryMax"), item("salaryCurrency"), item("salaryPeriod")), **stated(item("jobGeo")), "text": body
    }


def arbeitnow() -> dict[str, Column]:
    body = text.clean(item("description"))
    return {
        "title": item("title"), "company": item("company_name"),
        "location": F.concat(F.coalesce(item("location"), F.lit("")), F.lit(" (Remote)")), "url": item("url"), **posted(item("created_at")),
        "remote_type": F.lit("remote"), "remote_basis": F.lit("stated"), "tags": some(item("tags")),
        "employment_type": joined(item("job_types")), "salary": money(body), "text": body
    }


def remoteok() -> dict[str, Column]:
    body = text.clean(item("description"))
    return {
        "title": item("position"), "company": item("company"),
        "location": F.concat(F.coalesce(item("location"), F.lit("")), F.lit(" (Remote)")), "url": first_of(item("url"), item("apply_url")),
        **posted(item("date"), item("epoch")), **remote_board(), "tags": some(item("tags")),
        "salary": salary.range_text(item("salary_min"), item("salary_max")),
        **pay(item("salary_min"), item("salary_max"), F.lit("USD"), F.lit(None).cast("string")), "text": body
    }


def himalayas() -> dict[str, Column]:
    body, limits = text.clean(first_of(item("description"), item("excerpt"))), item("locationRestrictions")
    company = F.when(
        F.lower(F.trim(F.coalesce(item("companyName"), F.lit("")))).isin("", "name"),
        F.initcap(F.replace(F.coalesce(item("companySlug"), F.lit("")), F.lit("-"), F.lit(" ")))
    ).otherwise(item("companyName"))
    kinds = F.array_join(some(F.when(F.size(item("parentCategories")) > 0, item("parentCategories")).otherwise(item("categories"))), ", ")
    return {
        "title": item("title"), "company": company, "location": with_remote(F.array_join(limits, ", ")),
        "url": first_of(item("applicationLink"), item("guid")), **posted(item("pubDate")), "category": said(kinds),
        "seniority": said(F.array_join(some(item("seniority")), ", ")), **remote_board(), **stated(F.to_json(limits)),
        "expires": said(dates.to_date(item("expiryDate"))),
        "source_extra": extra(company_slug=item("companySlug"), timezones=item("timezoneRestrictions")), "tags": some(item("categories")),
        "employment_type": item("employmentType"), "salary": salary.range_text(item("minSalary"), item("maxSalary")),
        **pay(item("minSalary"), item("maxSalary"), item("currency"), item("salaryPeriod")), "text": body
    }


def adzuna() -> dict[str, Column]:
    area, guess = item("location.area"), item("salary_is_predicted") == "1"
    n, land = F.size(area), said(F.get(item("location.area"), F.lit(0)))
    whole = F.coalesce(n == 1, F.lit(False))
    null = F.lit(None).cast("double")
    lo, hi = F.when(guess, null).otherwise(item("salary_min")), F.when(guess, null).otherwise(item("salary_max"))
    return {
        "title": item("title"), "company": item("company.display_name"), "location": item("location.display_name"),
        "url": item("redirect_url"), **posted(item("created")), "expires": said(dates.to_date(item("deadline"))),
        "department": item("category.label"), "category": said(item("category.label")), "city": F.when(n >= 4, said(F.get(area, n - 1))),
        "state": F.when(n > 1, said(F.get(area, F.lit(1)))), "country": land, "remote_type": F.when(whole, "remote"),
        "remote_basis": F.when(whole, "location"), "remote_areas": F.when(whole & land.isNotNull(), F.array(land)),
        "employment_type": item("contract_time"), "salary": salary.range_text(item("salary_min"), item("salary_max")),
        **pay(lo, hi, F.lit("USD"), F.lit(None).cast("string")), "salary_estimated_min": F.when(guess, salary.number(item("salary_min"))),
        "salary_estimated_max": F.when(guess, salary.number(item("salary_max"))), "text": text.clean(item("description"))
    }


def google_jobs(as_of: Column | None = None) -> dict[str, Column]:
    from gleanworks.functions import urls

    as_of = as_of if as_of is not None else F.current_date()
    d = "detected_extensions."
    low = F.lower(F.coalesce(item(d + "posted_at"), F.lit("")))
    date = F.when(low.rlike(r"\d+\+?\s*(hour|minute|second)"), F.date_format(as_of, "yyyy-MM-dd")).otherwise(dates.relative_date(low, as_of))
    links = F.transform(item("apply_options"), lambda x: x["link"])
    s = salary.parsed(item(d + "salary"))
    return {
        "title": item("title"), "company": item("company_name"), "location": item("location"),
        "url": urls.best_link(links, item("company_name"), first_of(item("share_link"), item("source_link"))), "posted": date,
        "posted_basis": F.when(date.isNotNull(), "relative"), "employment_type": item(d + "schedule_type"),
        "remote_type": F.when(item(d + "work_from_home"), "remote"), "remote_basis": F.when(item(d + "work_from_home"), "stated"),
        "salary": first_of(item(d + "salary")),
        **{k: s[k] for k in ("salary_min", "salary_max", "salary_currency", "salary_period", "salary_basis")},
        "source_extra": extra(via=item("via"), job_id=item("job_id")), "text": text.clean(item("description"))
    }


def hn() -> dict[str, Column]:
    body = text.clean(item("text"))
    parts = F.transform(F.split(body, r"\|"), lambda x: F.trim(x))
    kind = F.get(F.filter(F.transform(parts, vocab.remote_type), lambda x: x.isNotNull()), F.lit(0))
    job = F.get(F.filter(F.transform(parts, vocab.employment_type), lambda x: x.isNotNull() & (x != "OTHER")), F.lit(0))
    link = F.coalesce(
        said(F.regexp_extract(body, r"(https?://[^\s)\]]+)", 1)),
        F.concat(F.lit("https://news.ycombinator.com/item?id="), item("id").cast("string"))
    )
    return {
        "title": F.left(F.get(parts, F.lit(1)), F.lit(120)), "company": F.left(F.get(parts, F.lit(0)), F.lit(80)),
        "location": F.array_join(F.slice(parts, 3, 2), " "), "url": link, **posted(item("created_at")), "remote_type": kind,
        "remote_basis": F.when(kind.isNotNull(), "text"),
        "employment_type": F.coalesce(job, F.when(body.rlike("(?i)contract|freelance|part.?time|fractional|1099"), "contract").otherwise("")),
        "source_extra": F.when(said(item("author")).isNotNull(), extra(hn_author=item("author"), hn_id=item("id"))), "salary": money(body),
        "text": body
    }


def braintrust() -> dict[str, Column]:
    skills = F.concat(
        F.coalesce(names(item("main_skills"), "name"), F.array().cast("array<string>")),
        F.coalesce(names(item("job_skills"), "name"), F.array().cast("array<string>"))
    )
    lo, hi, kind = item("budget_minimum_usd").try_cast("double"), item("budget_maximum_usd").try_cast("double"), F.coalesce(item("payment_type"), F.lit(""))
    unit = F.coalesce(vocab.lookup({"hourly": "hr", "monthly": "mo", "annual": "yr", "fixed_price": "fixed"}, kind), kind)
    rate = F.when(lo.isNull() | hi.isNull() | (hi == 0), "").when(lo == hi, F.concat(F.lit("$"), F.format_number(lo, 0), F.lit("/"), unit)).otherwise(
        F.concat(F.lit("$"), F.format_number(lo, 0), F.lit("-"), F.format_number(hi, 0), F.lit("/"), unit)
    )
    hours = item("expected_hours_per_week")
    body = F.concat(
        item("title"), F.lit(". Skills: "), F.array_join(skills, " "), F.lit(". "), F.coalesce(item("contract_type"), F.lit("")),
        F.lit(" contract"), F.when(hours > 0, F.concat(F.lit(", ~"), hours.cast("string"), F.lit("h/wk."))).otherwise(".")
    )
    return {
        "title": item("title"), "company": item("employer.name"),
        "location": with_remote(F.array_join(names(item("locations"), "location"), " ")),
        "url": F.concat(F.lit("https://app.usebraintrust.com/jobs/"), item("id").cast("string"), F.lit("/")), **posted(item("created")),
        "category": said(item("role.name")), "expires": said(dates.to_date(item("deadline"))), **remote_board(), "tags": some(skills),
        "employment_type": F.concat(F.lit("contract ("), F.coalesce(item("contract_type"), F.lit("")), F.lit(")")), "salary": rate,
        **pay(lo, hi, F.lit("USD"), item("payment_type")), "text": body
    }


def usajobs() -> dict[str, Column]:
    p, d = F.get(item("PositionRemuneration"), F.lit(0)), "UserArea.Details."
    spot, when = F.get(item("PositionLocation"), F.lit(0)), F.get(item("PositionSchedule"), F.lit(0))
    far, near = item(d + "RemoteIndicator"), item(d + "TeleworkEligible")
    kind = F.when(far, "remote").when(near, "hybrid").when(far.isNotNull() & ~far, "onsite")
    grade, low, high = F.get(item("JobGrade"), F.lit(0))["Code"], said(item(d + "LowGrade")), said(item(d + "HighGrade"))
    band = F.when(
        said(grade).isNotNull() & low.isNotNull(),
        F.concat(grade, F.lit("-"), low, F.when(high.isNotNull() & (high != low), F.concat(F.lit("/"), high)).otherwise(""))
    )
    body = text.clean(
        F.concat_ws("\n", *(joined(item(d + c), "\n") for c in ("JobSummary", "MajorDuties", "QualificationSummary", "Requirements", "Evaluations")))
    )
    return {
        "title": item("PositionTitle"), "company": item("OrganizationName"),
        "location": F.when(far, with_remote(item("PositionLocationDisplay"))).otherwise(item("PositionLocationDisplay")),
        "url": item("PositionURI"), **posted(item("PublicationStartDate")), "expires": said(dates.to_date(item("ApplicationCloseDate"))),
        "department": item("DepartmentName"), "parent_company": said(item("DepartmentName")), "team": said(item("SubAgency")),
        "category": said(F.array_join(names(item("JobCategory"), "Name"), ", ")), "seniority": band,
        "city": said(F.trim(F.split_part(F.coalesce(spot["CityName"], F.lit("")), F.lit(","), F.lit(1)))),
        "state": vocab.us_state_code(spot["CountrySubDivisionCode"]), "country": vocab.country_code(spot["CountryCode"]),
        "remote_type": kind, "remote_basis": F.when(kind.isNotNull(), "stated"),
        "source_extra": extra(opm_series=F.array_join(names(item("JobCategory"), "Code"), ","), pay_grade=grade, announcement=item("PositionID")),
        "employment_type": F.coalesce(vocab.lookup(vocab.USAJOBS_SCHEDULES, when["Code"]), F.lit("")),
        "employment_type_raw": said(when["Name"]), "salary": salary.range_text(p["MinimumRange"], p["MaximumRange"]),
        **pay(p["MinimumRange"], p["MaximumRange"], F.lit("USD"), first_of(p["RateIntervalCode"], p["Description"])), "text": body
    }


def themuse() -> dict[str, Column]:
    body, where = text.clean(item("contents")), names(item("locations"), "name")
    place, kinds = places.split_place(F.get(where, F.lit(0))), F.array_join(names(item("categories"), "name"), "; ")
    return {
        "title": item("name"), "company": item("company.name"), "location": F.array_join(where, "; "), "city": place["city"],
        "state": place["state"], "country": place["country"], "url": item("refs.landing_page"), **posted(item("publication_date")),
        "department": kinds, "category": said(kinds), "seniority": said(F.array_join(names(item("levels"), "name"), "; ")),
        "employment_type": item("type"), "salary": money(body), "text": body
    }


# Where items stand in a payload, and their types.
TYPES: dict[str, tuple[str, str]] = {
    "greenhouse": (
        "jobs",
        f"title STRING, location {NAMED}, absolute_url STRING, first_published STRING, updated_at STRING, application_deadline STRING, departments ARRAY<{NAMED}>, metadata ARRAY<STRUCT<name:STRING,value:STRING>>, content STRING"
    ),
    "lever": (
        "",
        "text STRING, categories STRUCT<location:STRING,team:STRING,department:STRING,commitment:STRING>, country STRING, hostedUrl STRING, createdAt STRING, workplaceType STRING, salaryRange STRUCT<min:DOUBLE,max:DOUBLE,currency:STRING,interval:STRING>, salaryDescription STRING, descriptionPlain STRING, description STRING, lists ARRAY<STRUCT<text:STRING,content:STRING>>, additionalPlain STRING"
    ),
    "ashby": (
        "jobs",
        "title STRING, location STRING, isRemote BOOLEAN, workplaceType STRING, jobUrl STRING, applyUrl STRING, publishedAt STRING, updatedAt STRING, department STRING, team STRING, employmentType STRING, descriptionPlain STRING, address STRUCT<postalAddress:STRUCT<addressLocality:STRING,addressRegion:STRING,addressCountry:STRING>>, compensation STRUCT<compensationTierSummary:STRING,compensationTiers:ARRAY<STRUCT<title:STRING>>,summaryComponents:ARRAY<STRUCT<compensationType:STRING,interval:STRING,currencyCode:STRING,minValue:DOUBLE,maxValue:DOUBLE>>>"
    ),
    "smartrecruiters": (
        "content",
        f"id STRING, name STRING, location STRUCT<city:STRING,region:STRING,country:STRING,remote:BOOLEAN,hybrid:BOOLEAN,latitude:STRING,longitude:STRING>, releasedDate STRING, createdOn STRING, department {LABELED}, function {LABELED}, experienceLevel {LABELED}, typeOfEmployment {LABELED}, industry {LABELED}, refNumber STRING"
    ),
    "workable": (
        "jobs",
        "title STRING, full_title STRING, city STRING, state STRING, country STRING, locations ARRAY<STRUCT<city:STRING,region:STRING,country:STRING,countryCode:STRING>>, telecommuting BOOLEAN, application_url STRING, url STRING, shortcode STRING, created_at STRING, published_on STRING, department STRING, function STRING, experience STRING, industry STRING, education STRING, employment_type STRING, description STRING"
    ),
    "workday": ("jobPostings", "title STRING, externalPath STRING, locationsText STRING, postedOn STRING, bulletFields ARRAY<STRING>"),
    "rippling": ("", "uuid STRING, name STRING, url STRING, department STRUCT<id:STRING,label:STRING>, workLocation STRUCT<label:STRING>"),
    "teamtailor": (
        "items",
        "id STRING, title STRING, url STRING, date_published STRING, content_html STRING, _jobposting STRUCT<employmentType:STRING,jobLocationType:STRING,validThrough:STRING,description:STRING,hiringOrganization:STRUCT<name:STRING>,jobLocation:STRING>"
    ),
    "remotive": (
        "jobs",
        "title STRING, company_name STRING, candidate_required_location STRING, url STRING, publication_date STRING, category STRING, job_type STRING, salary STRING, tags ARRAY<STRING>, description STRING"
    ),
    "jobicy": (
        "jobs",
        "jobTitle STRING, companyName STRING, jobGeo STRING, url STRING, pubDate STRING, jobIndustry STRING, jobLevel STRING, jobType STRING, salaryMin DOUBLE, salaryMax DOUBLE, salaryCurrency STRING, salaryPeriod STRING, jobDescription STRING, jobExcerpt STRING"
    ),
    "arbeitnow": (
        "data",
        "title STRING, company_name STRING, location STRING, url STRING, created_at STRING, job_types STRING, tags ARRAY<STRING>, remote BOOLEAN, description STRING"
    ),
    "remoteok": (
        "",
        "position STRING, company STRING, location STRING, url STRING, apply_url STRING, date STRING, epoch STRING, tags ARRAY<STRING>, salary_min DOUBLE, salary_max DOUBLE, description STRING"
    ),
    "himalayas": (
        "jobs",
        "title STRING, companyName STRING, companySlug STRING, locationRestrictions ARRAY<STRING>, timezoneRestrictions STRING, applicationLink STRING, guid STRING, pubDate STRING, expiryDate STRING, parentCategories ARRAY<STRING>, categories ARRAY<STRING>, seniority ARRAY<STRING>, employmentType STRING, minSalary DOUBLE, maxSalary DOUBLE, currency STRING, salaryPeriod STRING, description STRING, excerpt STRING"
    ),
    "adzuna": (
        "results",
        f"title STRING, company STRUCT<display_name:STRING>, location STRUCT<display_name:STRING,area:ARRAY<STRING>>, redirect_url STRING, created STRING, deadline STRING, category {LABELED}, contract_time STRING, salary_min DOUBLE, salary_max DOUBLE, salary_is_predicted STRING, description STRING"
    ),
    "google_jobs": (
        "jobs_results",
        "title STRING, company_name STRING, location STRING, description STRING, share_link STRING, via STRING, job_id STRING, source_link STRING, detected_extensions STRUCT<posted_at:STRING,schedule_type:STRING,salary:STRING,work_from_home:BOOLEAN>, apply_options ARRAY<STRUCT<title:STRING,link:STRING>>"
    ),
    "hn": ("children", "id BIGINT, created_at STRING, author STRING, text STRING"),
    "braintrust": (
        "results",
        f"id BIGINT, title STRING, employer {NAMED}, locations ARRAY<STRUCT<location:STRING>>, main_skills ARRAY<{NAMED}>, job_skills ARRAY<{NAMED}>, created STRING, deadline STRING, role {NAMED}, contract_type STRING, payment_type STRING, budget_minimum_usd STRING, budget_maximum_usd STRING, expected_hours_per_week INT"
    ),
    "usajobs": (
        "SearchResult.SearchResultItems",
        "MatchedObjectDescriptor STRUCT<PositionTitle:STRING,OrganizationName:STRING,DepartmentName:STRING,SubAgency:STRING,PositionLocationDisplay:STRING,PositionLocation:ARRAY<STRUCT<CityName:STRING,CountrySubDivisionCode:STRING,CountryCode:STRING>>,PositionURI:STRING,PositionID:STRING,PublicationStartDate:STRING,ApplicationCloseDate:STRING,JobCategory:ARRAY<STRUCT<Name:STRING,Code:STRING>>,JobGrade:ARRAY<STRUCT<Code:STRING>>,PositionSchedule:ARRAY<STRUCT<Code:STRING,Name:STRING>>,PositionRemuneration:ARRAY<STRUCT<MinimumRange:STRING,MaximumRange:STRING,RateIntervalCode:STRING,Description:STRING>>,UserArea:STRUCT<Details:STRUCT<JobSummary:STRING,MajorDuties:STRING,QualificationSummary:STRING,Requirements:STRING,Evaluations:STRING,LowGrade:STRING,HighGrade:STRING,RemoteIndicator:BOOLEAN,TeleworkEligible:BOOLEAN>>>"
    ),
    "themuse": (
        "results",
        f"id BIGINT, name STRING, contents STRING, publication_date STRING, type STRING, company {NAMED}, locations ARRAY<{NAMED}>, categories ARRAY<{NAMED}>, levels ARRAY<{NAMED}>, refs STRUCT<landing_page:STRING>"
    ),
}
# Fixed value: titles of low-paid labelling work.
GIGS = r"(?i)trainer|annotat|\bai training\b|evaluation|labeler|labelling|linguist|\bvoice\b|transcrib|data collection|\bevaluator\b|quality analyst|quality specialist|\bqa\b"
PROJECTIONS: dict[str, Callable[..., dict[str, Column]]] = {
    "greenhouse": greenhouse, "lever": lever, "ashby": ashby, "smartrecruiters": smartrecruiters, "workable": workable, "workday": workday,
    "rippling": rippling, "teamtailor": teamtailor, "remotive": remotive, "jobicy": jobicy, "arbeitnow": arbeitnow, "remoteok": remoteok,
    "himalayas": himalayas, "adzuna": adzuna, "google_jobs": google_jobs, "hn": hn, "braintrust": braintrust, "usajobs": usajobs,
    "themuse": themuse
}
DEPTH = ("greenhouse", "lever", "ashby", "smartrecruiters", "workable", "workday", "rippling", "teamtailor")


def selected(wanted: list[str] | None = None) -> list[str]:
    """All sources, or those of the names that are known."""
    return [s for s in PROJECTIONS if wanted is None or s in wanted]


def items_of(payloads: DataFrame, source: str) -> DataFrame:
    """One row per item of the landed payloads, numbered within its payload."""
    path, item_type = TYPES[source]
    schema = f"ARRAY<STRUCT<{_colons(item_type)}>>"
    for name in reversed(path.split(".") if path else []):
        schema = f"STRUCT<{name}:{schema}>"
    parsed = F.from_json("raw", schema)
    for name in path.split(".") if path else []:
        parsed = parsed[name]
    out = payloads.select(*payloads.columns, F.posexplode(parsed).alias("position", "item"))
    return out.withColumn("item", F.col("item.MatchedObjectDescriptor")) if source == "usajobs" else out


def broken(landed: DataFrame, source: str) -> DataFrame:
    """(source, error): how many landed payloads can't be read, by what is wrong with them, and one board of theirs.

    A payload is no JSON, or holds no list where the source has its items; the others beside it are read all the same."""
    path, _ = TYPES[source]
    listed = F.json_array_length(F.get_json_object("raw", "$." + path if path else "$"))
    wrong = F.when(F.col("raw").isNull() | F.try_parse_json("raw").isNull(), "not JSON").when(listed.isNull(), f"no list at {path or 'the top'}")
    board = F.coalesce("company", "slug", F.lit("?"))
    counted = landed.withColumn("wrong", wrong).where("wrong is not null").groupBy("wrong").agg(F.count("*").alias("n"), F.min(board).alias("board"))
    return counted.select(F.lit(source).alias("source"), F.concat(F.col("n").cast("string"), F.lit(" payloads: "), "wrong", F.lit(" (one of "), "board", F.lit(")")).alias("error"))


def _colons(ddl: str) -> str:
    """``a INT, b STRUCT<c:INT>`` as struct fields: the first blank of each top-level field becomes a colon."""
    out, depth, named = [], 0, False
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == " " and depth == 0:
            if out and out[-1] != "," and not named:
                out.append(":")
                named = True
            continue
        if c == "," and depth == 0:
            named = False
        out.append(c)
    return "".join(out)


def postings(payloads: DataFrame, source: str, **how: Column) -> DataFrame:
    """Posting rows of one source's landed payloads (raw, slug, company, seq, and host, site for Workday)."""
    have = set(payloads.columns)
    for c in ("slug", "company", "host", "site"):
        if c not in have:
            payloads = payloads.withColumn(c, F.lit(None).cast("string"))
    if "seq" not in have:
        payloads = payloads.withColumn("seq", F.lit(0).cast("long"))
    rows = items_of(payloads, source)
    if source == "arbeitnow":
        rows = rows.where("item.remote")
    elif source == "remoteok":
        rows = rows.where("coalesce(item.position, '') <> ''")
    elif source == "braintrust":
        rows = rows.where(~F.coalesce(F.col("item.title"), F.lit("")).rlike(GIGS))
    elif source in ("himalayas", "themuse"):
        rows = first_wins(rows, F.coalesce(said(item("applicationLink")), said(item("guid"))) if source == "himalayas" else item("id").cast("string"))
    columns = PROJECTIONS[source](**how) if how else PROJECTIONS[source]()
    company = F.coalesce(said(columns.pop("company", F.lit(None).cast("string"))), F.col("company"))
    out = rows.select("seq", "position", company.alias("company"), F.lit(source).alias("source"), *(c.alias(k) for k, c in columns.items()))
    return out.where("coalesce(title, '') <> '' and coalesce(company, '') <> ''") if source == "hn" else out


def first_wins(rows: DataFrame, key: Column, order: tuple[str, ...] = ("seq", "position")) -> DataFrame:
    """One row per key, the first to arrive; rows without a key all stay."""
    w = Window.partitionBy("_key").orderBy(*order)
    keyed = rows.withColumn("_key", key)
    return keyed.where("_key is not null").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_key").unionByName(keyed.where("_key is null").drop("_key"))


def details(landed: DataFrame, source: str) -> DataFrame:
    """Rows of landed detail payloads (raw, detail_key), as far as a list row lacks them; one that doesn't parse has nothing."""
    path, item_type, project = DETAILS[source]
    schema = f"STRUCT<{_colons(item_type)}>"
    info = F.from_json("raw", f"STRUCT<{path}:{schema}>")[path] if path else F.from_json("raw", schema)
    return landed.withColumn("info", info).select("detail_key", *(c.alias(k) for k, c in project().items()))


def with_details(listed: DataFrame, details: DataFrame, key: str = "detail_key") -> DataFrame:
    """A list's rows filled from their detail rows; a row without one stays as it is.

    Columns keep the list's types, or come in with the detail's. What a detail leaves null or empty stays the
    list's. Of several details of one key the one with the least hash counts, so rows don't double."""
    types = dict(listed.dtypes)
    cols = [c for c in details.columns if c != key]
    own = lambda c: F.col(c).cast(types[c]) if c in types else F.col(c)
    told = lambda c: F.nullif(own(c), F.lit("")) if types.get(c, dict(details.dtypes)[c]) == "string" else own(c)
    plain = [c for c, t in details.dtypes if c != key and not t.startswith("map")]
    one = details.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min_by(F.struct(*(told(c).alias(c) for c in cols)), F.xxhash64(*plain)).alias("_d")
    )
    return listed.join(one, key, "left").withColumns(
        {c: F.coalesce(F.col(f"_d.{c}"), F.col(c)) if c in types else F.col(f"_d.{c}") for c in cols}
    ).drop("_d")


def stamped(rows: DataFrame, companies: DataFrame, source: str, strict: bool = True) -> DataFrame:
    """A board's rows with their company's name and industry from the watchlist; boards that it lacks have no rows, or,
    if strict is off, keep the company that they came with.

    rows: with slug (and host, site); companies: (name, ats, slug, host, site, industry). Slugs differ by case alone
    nowhere, so they meet in lower case; of two entries of one board the first by name counts."""
    keys = ("slug", "host", "site") if source == "workday" else ("slug",)
    own = companies.where(F.col("ats") == source).groupBy(*(F.lower(k).alias(f"_{k}") for k in keys)).agg(F.min(F.struct("name", "industry")).alias("_c"))
    came = rows.withColumn("_came", F.col("company") if "company" in rows.columns else F.lit(None).cast("string")).drop("company", "industry", "source")
    joined = came.join(F.broadcast(own) if not strict else own, [F.lower(came[k]) == own[f"_{k}"] for k in keys], "inner" if strict else "left")
    return joined.select(
        *(c for c in rows.columns if c not in ("company", "industry", "source")), (F.col("_c.name") if strict else F.coalesce("_c.name", "_came")).alias("company"),
        F.lit(source).alias("source"), F.coalesce("_c.industry", F.lit("")).alias("industry")
    )


# The field in which a service tells how many roles a board has.
TOTALS = {"smartrecruiters": "$.totalFound", "workday": "$.total"}


def role_counts(landed: DataFrame, source: str) -> DataFrame:
    """(slug, roles): the total that a board's first page tells (later pages may say 0), else its items; none is parsed."""
    path, _ = TYPES[source]
    listed = F.coalesce(F.json_array_length(F.get_json_object("raw", "$." + path if path else "$")), F.lit(0))
    if source in TOTALS:
        told = F.coalesce(F.get_json_object("raw", TOTALS[source]).try_cast("long"), F.lit(0))
        return landed.groupBy("slug").agg(F.max(told).alias("roles"))
    return landed.groupBy("slug").agg(F.sum(listed.cast("long")).alias("roles"))
