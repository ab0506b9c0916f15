"""A query for each source: payloads made of the part table are projected, and the SQL reads the table itself.

Fifty parts make a payload, whatever the size of the table. Item expressions are Spark SQL; ``{date}`` stands for
a day that depends on the part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanworks.plans.queries import AS_OF, ORACLES, QUERIES, query, table
from gleanworks.sources import payloads

EACH = 50
DATE = "date_format(date_add(date'2001-01-01', p_size), 'yyyy-MM-dd')"
SQL_DATE = "strftime(date '2001-01-01' + p_size, '%Y-%m-%d')"
TITLE = "concat(p_type, ' ', p_name)"


def landed(spark: SparkSession, sf: str, source: str, item: str, where: str = "true") -> DataFrame:
    """Payloads (seq, raw, slug, company, host, site) of items made from parts."""
    rows = table(spark, sf, "part").where(where).select(
        F.floor(F.col("p_partkey") / EACH).cast("long").alias("seq"),
        F.struct(F.col("p_partkey").alias("k"), F.expr(item.replace("{date}", DATE)).alias("item")).alias("x")
    )
    items = F.transform(
        F.array_sort(F.collect_list("x")),
        lambda x: F.struct(x["item"].alias("MatchedObjectDescriptor")) if source == "usajobs" else x["item"]
    )
    value: Column = F.col("items")
    for name in reversed(payloads.TYPES[source][0].split(".") if payloads.TYPES[source][0] else []):
        value = F.struct(value.alias(name))
    board = F.col("seq").cast("string")
    return rows.groupBy("seq").agg(items.alias("items")).select(
        "seq", F.to_json(value).alias("raw"), F.concat(F.lit("b"), board).alias("slug"), F.concat(F.lit("Co "), board).alias("company"),
        F.lit("wd1").alias("host"), F.lit("Site").alias("site")
    )


def day() -> Column:
    return F.lit(AS_OF).cast("date")


def source_query(source: str, item: str, columns: dict[str, str], sql: str, dated: bool = False) -> None:
    """Register source_<name>: columns are expressions over the posting; dated: phrases count back from the day of the run."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = payloads.postings(landed(spark, sf, source, item), source, **({"as_of": day()} if dated else {}))
        return rows.select(*(F.expr(e).alias(c) for c, e in columns.items()))

    run.__name__ = f"source_{source}"
    run.__doc__ = f"The projection of {source}'s payloads."
    QUERIES[run.__name__] = run
    ORACLES[run.__name__] = sql.replace("{date}", SQL_DATE).replace("{title}", TITLE)


def same(*names: str, **made: str) -> dict[str, str]:
    return {n: n for n in names} | made


source_query(
    "greenhouse",
    f"""named_struct('title', {TITLE}, 'location', named_struct('name', p_brand), 'absolute_url', concat('https://boards.greenhouse.io/b/jobs/', p_partkey), 'first_published', if(p_size % 3 = 0, null, concat({{date}}, 'T09:00:00Z')),
    'updated_at', '2002-02-02T00:00:00Z', 'departments', array(named_struct('name', p_type)), 'metadata', array(named_struct('name', 'Size', 'value', cast(p_size as string)), named_struct('name', 'None', 'value', cast(null as string))),
    'content', concat('&lt;p&gt;Pay $', p_size + 50, 'k-$', p_size + 80, 'k&lt;/p&gt; <b>', p_name, '</b>'))""",
    same(
        "url", "title", "location", "posted", "posted_basis", "department", "salary", "text", size="source_extra['Size']",
        updated="source_extra['updated_at']", empties="map_contains_key(source_extra, 'None')"
    ),
    """select concat('https://boards.greenhouse.io/b/jobs/', p_partkey) as url, {title} as title, p_brand as location, case when p_size % 3 = 0 then '2002-02-02' else {date} end as posted, 'stated' as posted_basis, p_type as department,
    concat('$', p_size + 50, 'k-$', p_size + 80, 'k') as salary, concat('<p>Pay $', p_size + 50, 'k-$', p_size + 80, 'k</p> ', p_name) as text, cast(p_size as varchar) as size, '2002-02-02' as updated, false as empties from part""",
)
source_query(
    "lever",
    f"""named_struct('text', {TITLE}, 'categories', named_struct('location', p_brand, 'team', p_type, 'commitment', 'Full-time'), 'country', if(p_size % 2 = 0, 'FR', 'United States'), 'hostedUrl', concat('https://jobs.lever.co/b/', p_partkey),
    'createdAt', 1752000000000 + (p_partkey % 100) * 86400000, 'workplaceType', element_at(array('remote', 'hybrid', 'on-site', null), p_size % 4 + 1),
    'salaryRange', if(p_size % 5 = 0, null, named_struct('min', p_size * 1000, 'max', p_size * 2000, 'currency', 'usd', 'interval', 'per-year-salary')), 'descriptionPlain', 'Intro', 'lists', array(named_struct('text', 'Need', 'content', concat('<li>', p_name, '</li>'))), 'additionalPlain', 'Bye')""",
    same(
        "url", "title", "location", "country", "posted", "department", "remote_type", "remote_basis", "employment_type", "salary_min",
        "salary_max", "salary_currency", "salary_period", "salary", "text"
    ),
    """select concat('https://jobs.lever.co/b/', p_partkey) as url, {title} as title, p_brand as location, case when p_size % 2 = 0 then 'FR' else 'US' end as country, strftime(date '2025-07-08' + cast(p_partkey % 100 as integer), '%Y-%m-%d') as posted, p_type as department,
    case p_size % 4 when 0 then 'remote' when 1 then 'hybrid' when 2 then 'onsite' end as remote_type, case when p_size % 4 < 3 then 'stated' end as remote_basis, 'Full-time' as employment_type,
    cast(case when p_size % 5 <> 0 then p_size * 1000 end as double) as salary_min, cast(case when p_size % 5 <> 0 then p_size * 2000 end as double) as salary_max, case when p_size % 5 <> 0 then 'USD' end as salary_currency, case when p_size % 5 <> 0 then 'year' end as salary_period,
    case when p_size % 5 <> 0 then format('${:,}–${:,} usd', p_size * 1000, p_size * 2000) else '' end as salary, concat('Intro Need ', p_name, ' Bye') as text from part""",
)
source_query(
    "ashby",
    f"""named_struct('title', {TITLE}, 'location', p_brand, 'isRemote', p_size % 2 = 0, 'workplaceType', element_at(array('Hybrid', 'Remote', null), p_size % 3 + 1), 'jobUrl', concat('https://jobs.ashbyhq.com/b/', p_partkey), 'publishedAt', {{date}}, 'department', p_type, 'employmentType', 'FullTime', 'descriptionPlain', p_name,
    'address', named_struct('postalAddress', named_struct('addressLocality', 'New York', 'addressRegion', 'NY', 'addressCountry', 'United States')),
    'compensation', named_struct('compensationTierSummary', concat('$', p_size, 'K • equity'), 'summaryComponents', array(named_struct('compensationType', 'EquityCashValue', 'interval', 'NONE', 'currencyCode', 'USD', 'minValue', 1, 'maxValue', 2), named_struct('compensationType', 'Salary', 'interval', '1 YEAR', 'currencyCode', 'USD', 'minValue', p_size, 'maxValue', p_size + 1))))""",
    same(
        "url", "title", "location", "posted", "department", "remote_type", "remote_basis", "city", "state", "country", "employment_type",
        "salary", "salary_min", "salary_max", "salary_period", "text"
    ),
    """select concat('https://jobs.ashbyhq.com/b/', p_partkey) as url, {title} as title, case when p_size % 2 = 0 then p_brand || ' (Remote)' else p_brand end as location, {date} as posted, p_type as department, case p_size % 3 when 0 then 'hybrid' when 1 then 'remote' end as remote_type, case when p_size % 3 < 2 then 'stated' end as remote_basis,
    'New York' as city, 'NY' as state, 'US' as country, 'FullTime' as employment_type, concat('$', p_size, 'K') as salary, cast(p_size as double) as salary_min, cast(p_size + 1 as double) as salary_max, 'year' as salary_period, p_name as text from part""",
)
source_query(
    "smartrecruiters",
    f"""named_struct('id', cast(p_partkey as string), 'name', {TITLE}, 'location', named_struct('city', 'Lyon', 'region', 'ARA', 'country', 'fr', 'remote', p_size % 3 = 0, 'hybrid', p_size % 3 = 1), 'releasedDate', concat({{date}}, 'T00:00:00Z'), 'department', named_struct('label', p_type), 'function', named_struct('label', 'Build'),
    'experienceLevel', named_struct('label', 'Mid'), 'typeOfEmployment', named_struct('label', 'Permanent'), 'industry', named_struct('label', p_brand))""",
    same(
        "url", "title", "location", "posted", "department", "category", "seniority", "city", "state", "country", "remote_type",
        "remote_basis", "employment_type", industry="source_extra['industry']"
    ),
    """select concat('https://jobs.smartrecruiters.com/b', p_partkey // 50, '/', p_partkey) as url, {title} as title, case when p_size % 3 = 0 then 'Lyon, ARA, fr (Remote)' else 'Lyon, ARA, fr' end as location, {date} as posted, p_type as department, 'Build' as category, 'Mid' as seniority, 'Lyon' as city, 'ARA' as state, 'FR' as country,
    case p_size % 3 when 0 then 'remote' when 1 then 'hybrid' else 'onsite' end as remote_type, 'stated' as remote_basis, 'Permanent' as employment_type, p_brand as industry from part""",
)
source_query(
    "workable",
    f"""named_struct('title', {TITLE}, 'locations', array(named_struct('city', 'Oslo', 'region', 'OS', 'country', 'Norway', 'countryCode', if(p_size % 2 = 0, 'NO', null))), 'telecommuting', p_size % 2 = 0, 'shortcode', concat('S', p_partkey), 'url', if(p_size % 2 = 0, concat('https://x.example/', p_partkey), null), 'created_at', {{date}},
    'department', p_type, 'function', 'Build', 'experience', 'Mid', 'industry', p_brand, 'employment_type', 'Full-time', 'description', concat('<p>', p_name, '</p>'))""",
    same(
        "url", "title", "location", "posted", "department", "category", "seniority", "city", "state", "country", "remote_type", "text",
        industry="source_extra['industry']", places="size(locations)"
    ),
    """select case when p_size % 2 = 0 then concat('https://x.example/', p_partkey) else concat('https://apply.workable.com/b', p_partkey // 50, '/j/S', p_partkey, '/') end as url, {title} as title, case when p_size % 2 = 0 then 'Oslo, OS, NO (Remote)' else 'Oslo, OS, NO' end as location, {date} as posted, p_type as department,
    'Build' as category, 'Mid' as seniority, 'Oslo' as city, 'OS' as state, 'NO' as country, case when p_size % 2 = 0 then 'remote' else 'onsite' end as remote_type, p_name as text, p_brand as industry, cast(1 as integer) as places from part""",
)
WORKDAY = f"""named_struct('title', {TITLE}, 'externalPath', concat('/job/Sao-Paulo---Barueri/Role_R', 100000 + p_partkey), 'locationsText', if(p_size % 3 = 0, 'Here', null), 'postedOn', concat('Posted ', p_size, ' Days Ago'),
    'bulletFields', array(concat('R', 100000 + p_partkey), if(p_size % 3 = 1, 'Buenos Aires', 'Posting Date: 3/4/2001')))"""
WORKDAY_URL = "concat('https://b', p_partkey // 50, '.wd1.myworkdayjobs.com/en-US/Site/job/Sao-Paulo---Barueri/Role_R', 100000 + p_partkey)"
source_query(
    "workday", WORKDAY, same("url", "title", "location", "posted", "posted_basis"),
    f"""select {WORKDAY_URL} as url, {{title}} as title, case p_size % 3 when 0 then 'Here' when 1 then 'Buenos Aires' else 'Sao Paulo - Barueri' end as location, case when p_size % 3 = 1 then strftime(date '{AS_OF}' - p_size, '%Y-%m-%d') else '2001-03-04' end as posted,
    case when p_size % 3 = 1 then 'relative' else 'stated' end as posted_basis from part""", dated=True,
)


@query(f"""select {WORKDAY_URL} as url, case when p_partkey % 2 = 0 then concat('Body ', p_partkey, ' $100k-$120k') else '' end as text, case when p_partkey % 2 = 0 then '$100k-$120k' else '' end as salary,
  case when p_partkey % 2 = 0 and p_partkey % 4 = 0 then '2001-05-06' when p_size % 3 = 1 then strftime(date '{AS_OF}' - p_size, '%Y-%m-%d') else '2001-03-04' end as posted, case when p_partkey % 2 = 0 then 'Full time' else '' end as employment_type from part""")
def detail_join(spark: SparkSession, sf: str) -> DataFrame:
    """List rows filled from detail payloads, some of which are repeated, lack a date, or don't parse."""
    rows = payloads.postings(landed(spark, sf, "workday", WORKDAY), "workday", as_of=day())
    k = F.regexp_extract("url", "_R([0-9]+)$", 1).cast("long") - 100000
    body = F.concat(
        F.lit('{"jobPostingInfo":{"jobDescription":"<p>Body '), k.cast("string"), F.lit('</p> $100k-$120k","timeType":"Full time"'),
        F.when(k % 4 == 0, ',"startDate":"2001-05-06"').otherwise(""), F.lit("}}")
    )
    found = rows.select("detail_key", F.when(k % 2 == 0, body).otherwise("{broken").alias("raw"))
    filled = payloads.with_details(rows, payloads.details(found.unionByName(found), "workday"))
    return filled.select("url", "text", "salary", "posted", "employment_type")


RIPPLING = f"named_struct('uuid', concat('u', p_partkey), 'name', {TITLE}, 'url', concat('https://ats.rippling.com/b/jobs/', p_partkey), 'department', named_struct('id', 'x', 'label', p_type), 'workLocation', named_struct('label', p_brand))"
source_query(
    "rippling", RIPPLING, same("url", "title", "location", "department", "text"),
    "select concat('https://ats.rippling.com/b/jobs/', p_partkey) as url, {title} as title, p_brand as location, p_type as department, '' as text from part"
)


@query("""select concat('https://ats.rippling.com/b/jobs/', p_partkey) as url, case when p_partkey % 3 = 0 then 'Role & more About us' when p_partkey % 3 = 1 then 'Plain' else '' end as text, case when p_partkey % 3 < 2 then 'Oslo; Bergen' else p_brand end as location,
  case when p_partkey % 3 < 2 then 'Salaried' else '' end as employment_type, cast(case when p_partkey % 3 < 2 then 10 end as double) as salary_min, case when p_partkey % 3 < 2 then 'hour' end as salary_period, case when p_partkey % 3 < 2 then '2001-05-06' end as posted from part""")
def rippling_details(spark: SparkSession, sf: str) -> DataFrame:
    """A list's rows filled from details; the description is a text, or parts of which the role's comes first."""
    rows = payloads.postings(landed(spark, sf, "rippling", RIPPLING), "rippling")
    k = F.regexp_extract("url", "/([0-9]+)$", 1).cast("long")
    said = F.when(k % 3 == 0, F.lit('{"company":"<i>About us</i>","role":"Role &amp; more"}')).otherwise('"Plain"')
    raw = F.concat(
        F.lit('{"description":'), said,
        F.lit(
            ',"createdOn":"2001-05-06T01:00:00Z","payRangeDetails":[{"rangeStart":0},{"rangeStart":10,"rangeEnd":20,"currency":"usd","frequency":"hourly"}],"employmentType":{"id":"Salaried","label":"S"},"workLocations":["Oslo","","Bergen"]}'
        )
    )
    found = rows.where(k % 3 < 2).select("detail_key", raw.alias("raw"))
    return payloads.with_details(rows, payloads.details(found, "rippling")).select(
        "url", "text", "location", "employment_type", "salary_min", "salary_period", "posted"
    )


@query(
    """select concat('https://b.teamtailor.com/jobs/', p_partkey) as url, concat(p_type, ' ', p_name) as title, 'Malmö, Sweden' as location, 'Malmö' as city, 'SE' as country, 'Org' as company, case when p_size % 2 = 0 then 'remote' end as remote_type, '2002-01-01' as expires, p_name as text from part"""
)
def source_teamtailor(spark: SparkSession, sf: str) -> DataFrame:
    """The job's place is an object or a list of them."""
    place = "named_struct('address', named_struct('addressLocality', 'Malmö', 'addressCountry', 'Sweden'))"
    item = f"""named_struct('title', {TITLE}, 'url', concat('https://b.teamtailor.com/jobs/', p_partkey), 'date_published', {{date}}, '_jobposting', named_struct('employmentType', 'FULL_TIME', 'jobLocationType', if(p_size % 2 = 0, 'TELECOMMUTE', null), 'validThrough', '2002-01-01T00:00:00Z',
    'description', concat('<b>', p_name, '</b>'), 'hiringOrganization', named_struct('name', 'Org'), 'jobLocation', {{place}}))"""
    one = landed(spark, sf, "teamtailor", item.replace("{place}", place), f"floor(p_partkey / {EACH}) % 2 = 0")
    many = landed(spark, sf, "teamtailor", item.replace("{place}", f"array({place})"), f"floor(p_partkey / {EACH}) % 2 = 1")
    return payloads.postings(one.unionByName(many), "teamtailor").select(
        "url", "title", "location", "city", "country", "company", "remote_type", "expires", "text"
    )


PLACES = "element_at(array('Germany', 'Worldwide', 'USA, Canada', 'North  America, Narnia', ' ', 'Congo, The Democratic Republic of the', 'US-TX, CA'), p_size % 7 + 1)"
AREAS = "case p_size % 7 when 0 then 'DE' when 1 then '' when 2 then 'CA,US' when 5 then 'CD' when 6 then 'US-TX' end as areas, case p_size % 7 when 3 then 'NORTH AMERICA' end as regions, case p_size % 7 when 0 then 'Germany' when 1 then 'Worldwide' when 2 then 'USA, Canada' when 3 then 'North  America, Narnia' when 5 then 'Congo, The Democratic Republic of the' when 6 then 'US-TX, CA' end as stated"
STATED = {"areas": "array_join(remote_areas, ',')", "regions": "array_join(remote_regions, ',')", "stated": "remote_scope_raw"}
source_query(
    "remotive",
    f"named_struct('title', {TITLE}, 'company_name', p_brand, 'candidate_required_location', {PLACES}, 'url', concat('https://x.example/', p_partkey), 'publication_date', concat({{date}}, 'T10:00:00'), 'category', p_type, 'job_type', 'full_time', 'salary', if(p_size % 2 = 0, '60k', ''), 'tags', array('a', '', 'b'), 'description', concat('<p>', p_name, '</p>'))",
    same(
        "url", "title", "company", "posted", "department", "remote_type", "remote_basis", "employment_type", "salary", "text",
        tags="array_join(tags, ',')", **STATED
    ),
    f"select concat('https://x.example/', p_partkey) as url, {{title}} as title, p_brand as company, {{date}} as posted, p_type as department, 'remote' as remote_type, 'board' as remote_basis, 'full_time' as employment_type, case when p_size % 2 = 0 then '60k' else '' end as salary, p_name as text, 'a,b' as tags, {AREAS} from part",
)
source_query(
    "jobicy",
    f"named_struct('jobTitle', {TITLE}, 'companyName', p_brand, 'jobGeo', {PLACES}, 'url', concat('https://x.example/', p_partkey), 'pubDate', {{date}}, 'jobIndustry', array(p_type, 'Other'), 'jobLevel', 'Senior', 'jobType', array('full-time'), 'salaryMin', p_size, 'salaryMax', 0, 'salaryCurrency', 'eur', 'salaryPeriod', 'yearly', 'jobExcerpt', p_name)",
    same(
        "url", "title", "company", "posted", "department", "seniority", "remote_type", "employment_type", "salary_min", "salary_max",
        "salary_currency", "salary_period", "text", **STATED
    ),
    f"select concat('https://x.example/', p_partkey) as url, {{title}} as title, p_brand as company, {{date}} as posted, p_type || ', Other' as department, 'Senior' as seniority, 'remote' as remote_type, 'full-time' as employment_type, cast(p_size as double) as salary_min, cast(p_size as double) as salary_max, 'EUR' as salary_currency, 'year' as salary_period, p_name as text, {AREAS} from part",
)
source_query(
    "arbeitnow",
    f"named_struct('title', {TITLE}, 'company_name', p_brand, 'location', 'Bonn', 'url', concat('https://x.example/', p_partkey), 'created_at', 1752000000 + p_size * 86400, 'job_types', array('full-time', 'x'), 'tags', array(p_type), 'remote', p_size % 2 = 0, 'description', concat('<p>', p_name, '</p>'))",
    same("url", "title", "company", "location", "posted", "remote_type", "remote_basis", "employment_type", "text", tags="array_join(tags, ',')"),
    "select concat('https://x.example/', p_partkey) as url, {title} as title, p_brand as company, 'Bonn (Remote)' as location, strftime(date '2025-07-08' + p_size, '%Y-%m-%d') as posted, 'remote' as remote_type, 'stated' as remote_basis, 'full-time, x' as employment_type, p_name as text, p_type as tags from part where p_size % 2 = 0",
)
source_query(
    "remoteok",
    f"named_struct('position', if(p_partkey % 50 = 0, null, {TITLE}), 'company', p_brand, 'location', 'Oslo', 'url', if(p_size % 2 = 0, '', concat('https://x.example/', p_partkey)), 'apply_url', concat('https://y.example/', p_partkey), 'date', concat({{date}}, 'T00:00:00+00:00'), 'tags', array('a'), 'salary_min', if(p_size % 3 = 0, 0, 50000), 'salary_max', if(p_size % 3 = 0, 0, 70000), 'description', p_name)",
    same(
        "url", "title", "company", "location", "posted", "remote_type", "salary", "salary_min", "salary_max", "salary_currency",
        "salary_period", "text"
    ),
    """select case when p_size % 2 = 0 then concat('https://y.example/', p_partkey) else concat('https://x.example/', p_partkey) end as url, {title} as title, p_brand as company, 'Oslo (Remote)' as location, {date} as posted, 'remote' as remote_type, case when p_size % 3 = 0 then '' else '$50,000–$70,000' end as salary,
    cast(case when p_size % 3 <> 0 then 50000 end as double) as salary_min, cast(case when p_size % 3 <> 0 then 70000 end as double) as salary_max, case when p_size % 3 <> 0 then 'USD' end as salary_currency, cast(null as varchar) as salary_period, p_name as text from part where p_partkey % 50 <> 0""",
)
source_query(
    "himalayas",
    f"""named_struct('title', {TITLE}, 'companyName', if(p_size % 2 = 0, 'name', p_brand), 'companySlug', 'acme-labs', 'locationRestrictions', element_at(array(array(), array('Germany', 'France'), array('Narnia')), p_size % 3 + 1), 'applicationLink', concat('https://x.example/', floor(p_partkey / 2)), 'pubDate', {{date}},
    'categories', array(p_type), 'seniority', array('Senior', 'Lead'), 'employmentType', 'Full Time', 'minSalary', 10, 'maxSalary', 20, 'currency', 'eur', 'description', p_name)""",
    same("url", "title", "company", "location", "posted", "category", "seniority", "remote_type", "salary", "salary_currency", "text", **STATED),
    """select concat('https://x.example/', p_partkey // 2) as url, {title} as title, case when p_size % 2 = 0 then 'Acme Labs' else p_brand end as company, case p_size % 3 when 0 then '(Remote)' when 1 then 'Germany, France (Remote)' else 'Narnia (Remote)' end as location, {date} as posted, p_type as category, 'Senior, Lead' as seniority,
    'remote' as remote_type, '$10–$20' as salary, 'EUR' as salary_currency, p_name as text, case p_size % 3 when 0 then '' when 1 then 'DE,FR' end as areas, cast(null as varchar) as regions, case p_size % 3 when 1 then 'Germany, France' when 2 then 'Narnia' end as stated from part where p_partkey % 2 = 0""",
)
source_query(
    "adzuna",
    f"""named_struct('title', {TITLE}, 'company', named_struct('display_name', p_brand), 'location', named_struct('display_name', 'Somewhere', 'area', slice(array('US', 'California', 'Bay Area', 'San Jose'), 1, element_at(array(1, 2, 4), p_size % 3 + 1))), 'redirect_url', concat('https://x.example/', p_partkey), 'created', concat({{date}}, 'T00:00:00Z'),
    'category', named_struct('label', p_type), 'contract_time', 'full_time', 'salary_min', p_size * 1000, 'salary_max', p_size * 1000, 'salary_is_predicted', if(p_size % 2 = 0, '1', '0'), 'description', p_name)""",
    same(
        "url", "title", "company", "location", "posted", "department", "city", "state", "country", "remote_type", "remote_basis", "salary",
        "salary_min", "salary_estimated_min", "salary_estimated_max", areas="array_join(remote_areas, ',')"
    ),
    """select concat('https://x.example/', p_partkey) as url, {title} as title, p_brand as company, 'Somewhere' as location, {date} as posted, p_type as department, case when p_size % 3 = 2 then 'San Jose' end as city, case when p_size % 3 > 0 then 'California' end as state, 'US' as country, case when p_size % 3 = 0 then 'remote' end as remote_type,
    case when p_size % 3 = 0 then 'location' end as remote_basis, format('${:,}', p_size * 1000) as salary, cast(case when p_size % 2 = 1 then p_size * 1000 end as double) as salary_min, cast(case when p_size % 2 = 0 then p_size * 1000 end as double) as salary_estimated_min, cast(case when p_size % 2 = 0 then p_size * 1000 end as double) as salary_estimated_max,
    case when p_size % 3 = 0 then 'US' end as areas from part""",
)
source_query(
    "google_jobs",
    f"""named_struct('title', {TITLE}, 'company_name', p_brand, 'location', 'Oslo', 'description', p_name, 'share_link', 'https://s.example', 'via', 'V', 'detected_extensions', named_struct('posted_at', element_at(array('3 days ago', '5 hours ago', 'Yesterday', null), p_size % 4 + 1), 'schedule_type', 'Full-time', 'salary', if(p_size % 3 = 0, null, '150K–120K a year'), 'work_from_home', if(p_size % 2 = 0, true, null)),
    'apply_options', if(p_size % 5 = 0, null, array(named_struct('title', 'L', 'link', 'https://www.linkedin.com/1'), named_struct('title', 'G', 'link', concat('https://boards.greenhouse.io/x/jobs/', p_partkey)))))""",
    same(
        "title", "url", "company", "posted", "posted_basis", "employment_type", "remote_type", "salary", "salary_min", "salary_max",
        "salary_period", "salary_basis", via="source_extra['via']"
    ),
    f"""select {{title}} as title, case when p_size % 5 = 0 then 'https://s.example' else concat('https://boards.greenhouse.io/x/jobs/', p_partkey) end as url, p_brand as company, case p_size % 4 when 0 then strftime(date '{AS_OF}' - 3, '%Y-%m-%d') when 1 then '{AS_OF}' when 2 then strftime(date '{AS_OF}' - 1, '%Y-%m-%d') end as posted,
    case when p_size % 4 < 3 then 'relative' end as posted_basis, 'Full-time' as employment_type, case when p_size % 2 = 0 then 'remote' end as remote_type, case when p_size % 3 = 0 then '' else '150K–120K a year' end as salary, cast(case when p_size % 3 > 0 then 120000 end as double) as salary_min, cast(case when p_size % 3 > 0 then 150000 end as double) as salary_max,
    case when p_size % 3 > 0 then 'year' end as salary_period, case when p_size % 3 > 0 then 'parsed' end as salary_basis, 'V' as via from part""",
    dated=True,
)
source_query(
    "hn",
    "named_struct('id', p_partkey, 'created_at', concat({date}, 'T00:00:00Z'), 'author', if(p_size % 2 = 0, 'ann', null), 'text', if(p_size % 7 = 0, 'no bars here', concat(p_brand, ' | ', p_type, ' | Oslo | REMOTE | Full-time', if(p_size % 5 = 0, '', concat(' | https://x.example/', p_partkey)))))",
    same("url", "title", "company", "location", "posted", "remote_type", "remote_basis", "employment_type", author="source_extra['hn_author']"),
    """select case when p_size % 5 = 0 then concat('https://news.ycombinator.com/item?id=', p_partkey) else concat('https://x.example/', p_partkey) end as url, p_type as title, p_brand as company, 'Oslo REMOTE' as location, {date} as posted, 'remote' as remote_type, 'text' as remote_basis, 'FULL_TIME' as employment_type,
    case when p_size % 2 = 0 then 'ann' end as author from part where p_size % 7 <> 0""",
)
source_query(
    "braintrust",
    f"""named_struct('id', p_partkey, 'title', if(p_size % 6 = 0, 'AI Trainer', {TITLE}), 'employer', named_struct('name', p_brand), 'locations', array(named_struct('location', 'Oslo')), 'main_skills', array(named_struct('name', 'a'), named_struct('name', '')), 'job_skills', array(named_struct('name', 'b')), 'created', {{date}}, 'role', named_struct('name', p_type),
    'contract_type', 'freelance', 'payment_type', 'hourly', 'budget_minimum_usd', '50', 'budget_maximum_usd', if(p_size % 2 = 0, '50', '1070'), 'expected_hours_per_week', if(p_size % 3 = 0, null, 40))""",
    same(
        "url", "title", "company", "location", "posted", "category", "remote_type", "employment_type", "salary", "salary_min", "salary_max",
        "salary_period", "text", tags="array_join(tags, ',')"
    ),
    """select concat('https://app.usebraintrust.com/jobs/', p_partkey, '/') as url, {title} as title, p_brand as company, 'Oslo (Remote)' as location, {date} as posted, p_type as category, 'remote' as remote_type, 'contract (freelance)' as employment_type, case when p_size % 2 = 0 then '$50/hr' else '$50-1,070/hr' end as salary, cast(50 as double) as salary_min,
    cast(case when p_size % 2 = 0 then 50 else 1070 end as double) as salary_max, 'hour' as salary_period, concat({title}, '. Skills: a b. freelance contract', case when p_size % 3 = 0 then '.' else ', ~40h/wk.' end) as text, 'a,b' as tags from part where p_size % 6 <> 0""",
)
source_query(
    "usajobs",
    f"""named_struct('PositionTitle', {TITLE}, 'OrganizationName', p_brand, 'DepartmentName', p_type, 'SubAgency', 'Sub', 'PositionLocationDisplay', 'Waco, Texas', 'PositionLocation', array(named_struct('CityName', 'Waco, Texas', 'CountrySubDivisionCode', 'Texas', 'CountryCode', 'United States')), 'PositionURI', concat('https://x.example/', p_partkey), 'PositionID', 'P',
    'PublicationStartDate', concat({{date}}, 'T00:00:00'), 'JobCategory', array(named_struct('Name', 'IT', 'Code', '2210')), 'JobGrade', array(named_struct('Code', 'GS')), 'PositionSchedule', array(named_struct('Code', cast(p_size % 7 as string), 'Name', 'Sched')), 'PositionRemuneration', array(named_struct('MinimumRange', '100', 'MaximumRange', '200.0', 'RateIntervalCode', 'PA')),
    'UserArea', named_struct('Details', named_struct('JobSummary', p_name, 'MajorDuties', array('x', 'y'), 'LowGrade', '11', 'HighGrade', if(p_size % 2 = 0, '11', '12'), 'RemoteIndicator', p_size % 3 = 0, 'TeleworkEligible', p_size % 3 = 1)))""",
    same(
        "url", "title", "company", "location", "posted", "parent_company", "team", "category", "seniority", "city", "state", "country",
        "remote_type", "employment_type", "employment_type_raw", "salary", "salary_min", "salary_period", "text",
        grade="source_extra['pay_grade']"
    ),
    """select concat('https://x.example/', p_partkey) as url, {title} as title, p_brand as company, case when p_size % 3 = 0 then 'Waco, Texas (Remote)' else 'Waco, Texas' end as location, {date} as posted, p_type as parent_company, 'Sub' as team, 'IT' as category, case when p_size % 2 = 0 then 'GS-11' else 'GS-11/12' end as seniority, 'Waco' as city, 'TX' as state, 'US' as country,
    case p_size % 3 when 0 then 'remote' when 1 then 'hybrid' else 'onsite' end as remote_type, case p_size % 7 when 1 then 'FULL_TIME' when 2 then 'PART_TIME' when 3 then 'PART_TIME' when 4 then 'TEMPORARY' when 5 then 'PER_DIEM' when 6 then 'TEMPORARY' else '' end as employment_type, 'Sched' as employment_type_raw, '$100–$200' as salary, cast(100 as double) as salary_min, 'year' as salary_period,
    concat(p_name, ' x y') as text, 'GS' as grade from part""",
)
source_query(
    "themuse",
    f"""named_struct('id', if(p_partkey % 10 = 9, null, floor(p_partkey / 2)), 'name', {TITLE}, 'contents', concat('<p>', p_name, '</p>'), 'publication_date', {{date}}, 'type', 'external', 'company', named_struct('name', p_brand), 'locations', array(named_struct('name', 'Paris, France'), named_struct('name', 'Austin, TX')), 'categories', array(named_struct('name', p_type)),
    'levels', array(named_struct('name', 'Senior Level')), 'refs', named_struct('landing_page', concat('https://x.example/', p_partkey)))""",
    same("url", "title", "company", "location", "city", "state", "country", "posted", "category", "seniority", "text"),
    "select concat('https://x.example/', p_partkey) as url, {title} as title, p_brand as company, 'Paris, France; Austin, TX' as location, 'Paris' as city, cast(null as varchar) as state, 'FR' as country, {date} as posted, p_type as category, 'Senior Level' as seniority, p_name as text from part where p_partkey % 2 = 0 or p_partkey % 10 = 9",
)


@query(
    """select concat('b', p_partkey // 50) as slug, 'lever' as source, count(*) as roles from part group by 1 union all select concat('b', p_partkey // 50), 'workday', max(p_partkey % 50) + 100 from part group by 1"""
)
def role_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many roles each board has, by its list or by the total that its first page tells."""
    listed = payloads.role_counts(landed(spark, sf, "lever", f"named_struct('text', {TITLE})"), "lever").withColumn("source", F.lit("lever"))
    boards = table(spark, sf, "part").groupBy(F.floor(F.col("p_partkey") / EACH).cast("long").alias("b")).agg((F.max(F.col("p_partkey") % EACH) + 100).alias("n"))
    raw = F.explode(
        F.array(
            F.concat(F.lit('{"total":'), F.col("n").cast("string"), F.lit(',"jobPostings":[{"title":"x"}]}')),
            F.lit('{"total":0,"jobPostings":[{"title":"y"}]}')
        )
    ).alias("raw")
    told = payloads.role_counts(
        boards.select(F.concat(F.lit("b"), F.col("b").cast("string")).alias("slug"), raw), "workday"
    ).withColumn("source", F.lit("workday"))
    return listed.unionByName(told).select("slug", "source", "roles")
