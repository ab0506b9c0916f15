"""Queries that call one operator each over the driver's tables, with the SQL that gives the same rows.

Where an operator reads a field that no table has (a place, a requirement, a phrase), the field is made of a row's
numbers, and the SQL says what has to come out for each.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanworks.functions import arrangement, dates, places, salary, text, titles, urls, vocab
from gleanworks.operators import catalog, coerce, discovery, linkage, score, store, versions
from gleanworks.plans import config, emit, rerank
from gleanworks.plans.queries import AS_OF, BOARD_URLS, CFG, VIEW, posting, q, query, spread, sql_norm, sql_word, table
from gleanworks.sources import files, paging, payloads
from gleanworks.streaming import upserts

AGE = f"date_diff('day', cast(o_orderdate as date), date '{AS_OF}')"
c = F.col


def day() -> Column:
    """The day of the run."""
    return F.lit(AS_OF).cast("date")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder that driver and executors share; of this machine only for a local master without a shared one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not (spark.conf.get("spark.master", "") or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/gleanworks/{what}-{uuid.uuid4().hex}"


def chosen(*values: str | None) -> Column:
    """One of some values, by p_size."""
    return F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (c("p_size") % len(values) + 1).cast("int"))


def sql_chosen(*values: str | None) -> str:
    return f"case p_size % {len(values)} " + " ".join(f"when {i} then {q(v)}" for i, v in enumerate(values) if v is not None) + " end"


# ---- sources: what to ask for, and where a walk ends

@query(
    "select n_nationkey, case when n_nationkey % 5 = 0 then least(n_nationkey, 10) else least(n_nationkey, 10, greatest(n_nationkey * 3 - 20, 0)) end as spend from nation"
)
def search_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Planned, cap, balance less reserve; an unknown balance leaves the cap."""
    n = c("n_nationkey")
    return table(spark, sf, "nation").select("n_nationkey", paging.budget(n, F.lit(10), F.when(n % 5 != 0, n * 3), F.lit(20)).alias("spend"))


@query("select source, count(*) as n from (select case p_size % 4 when 0 then 'lever' when 1 then 'nonsense' when 2 then 'hn' else 'greenhouse' end as source from part) where source in ('lever', 'hn') group by 1")
def selected_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a subset of the registry; names that it lacks are ignored."""
    rows = table(spark, sf, "part").select(chosen("lever", "nonsense", "hn", "greenhouse").alias("source"))
    return rows.where(c("source").isin(*payloads.selected(["hn", "nonsense", "lever"]))).groupBy("source").agg(F.count("*").alias("n"))


WALKED = """pages as (select p_partkey // 10 as slug, p_partkey % 10 as page, case when p_size % 7 = 0 then null when p_size % 5 = 0 then 3 else 10 end as rows, case when p_partkey % 10 = 0 then p_size * 2 else 0 end as total from part)"""


@query(f"""with {WALKED}, s as (select *, first_value(total) over (partition by slug order by page) as said from pages), t as (select slug, page, rows, coalesce(rows is null or rows < 10 or (page + 1) * 10 >= said, false) as stop from s where page < 8),
  u as (select *, coalesce(bool_or(stop) over (partition by slug order by page rows between unbounded preceding and 1 preceding), false) as done from t) select slug, page, cast(rows as integer) as rows from u where not done and rows is not null""")
def walked_pages(spark: SparkSession, sf: str) -> DataFrame:
    """An offset walk ends with a short or failed page, at the first page's total, or after eight."""
    k = c("p_partkey")
    rows = F.when(c("p_size") % 7 == 0, F.lit(None)).when(c("p_size") % 5 == 0, 3).otherwise(10).cast("int")
    pages = table(spark, sf, "part").select(
        F.floor(k / 10).cast("long").alias("slug"), (k % 10).alias("page"), rows.alias("rows"),
        F.when(k % 10 == 0, c("p_size") * 2).otherwise(0).alias("total")
    )
    return paging.walked(pages, 10, 8).select("slug", "page", "rows")


@query(f"""with r as (select o_orderkey % 20 as slug, (o_orderkey // 20) % 12 as page, {AGE} as age from orders), p as (select slug, page, count(*) as rows, min(age) as min_age from r group by all),
  s as (select *, row_number() over (partition by slug order by page) as pos from p), t as (select * from s where pos <= 10),
  u as (select *, coalesce(bool_or(min_age > 20) over (partition by slug order by page rows between unbounded preceding and 1 preceding), false) as done from t) select slug, page, rows, cast(min_age as integer) as min_age from u where not done""")
def fresh_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A walk from new to old ends with the first page whose youngest row is too old."""
    k = c("o_orderkey")
    rows = table(spark, sf, "orders").select(
        (k % 20).alias("slug"), (F.floor(k / 20) % 12).cast("long").alias("page"),
        dates.age_days(F.date_format("o_orderdate", "yyyy-MM-dd"), day()).alias("age")
    )
    return paging.fresh_pages(paging.youngest(rows, c("age")), 20, 10)


@query("""with p as (select p_partkey // 10 as slug, p_partkey % 10 as page, p_size % 6 in (0, 1) as stop from part), u as (select *, coalesce(bool_or(stop) over (partition by slug order by page rows between unbounded preceding and 1 preceding), false) as done from p where page < 8)
  select slug, page from u where not done""")
def followed_links(spark: SparkSession, sf: str) -> DataFrame:
    """A walk along next links ends where there is none, or one that leaves the host."""
    k = c("p_partkey")
    ahead = F.when(c("p_size") % 6 == 0, "").when(c("p_size") % 6 == 1, "https://evil.example/x").otherwise("https://A.example/y")
    pages = table(spark, sf, "part").select(
        F.floor(k / 10).cast("long").alias("slug"), (k % 10).alias("page"), F.lit("https://a.example/jobs").alias("url"),
        ahead.alias("next")
    )
    return paging.followed(pages, 8).select("slug", "page")


@query("select o_orderkey from orders where o_orderkey % 3 = 0 order by o_orderdate desc, o_orderkey desc limit 5")
def hiring_threads(spark: SparkSession, sf: str) -> DataFrame:
    """The newest threads with the right title."""
    title = F.when(c("o_orderkey") % 3 == 0, "Ask HN: Who is HIRING? (May)").otherwise("Who wants to be hired?")
    return paging.threads(
        table(spark, sf, "orders").select("o_orderkey", title.alias("title"), F.struct("o_orderdate", "o_orderkey").alias("created")), 5
    ).select("o_orderkey")


@query(
    "select * from (select (s_suppkey * 5 + r_regionkey) * 3 + page as \"at\", s_name as query, r_name as category, cast(page as integer) as page from supplier cross join region cross join (select unnest(range(3)) as page)) where \"at\" < 1000"
)
def fanout(spark: SparkSession, sf: str) -> DataFrame:
    """Queries by categories by pages, as far as a budget goes."""
    queries = table(spark, sf, "supplier").select(c("s_suppkey").alias("q"), c("s_name").alias("query"))
    categories = table(spark, sf, "region").select(c("r_regionkey").alias("c"), c("r_name").alias("category"))
    return paging.within_budget(paging.requests(queries, categories, 3), 1000)


@query(
    "select s_suppkey, case s_suppkey % 6 when 0 then 'S' || s_suppkey || ': source ''zzz'' not enabled' when 1 then 'S' || s_suppkey || ': invalid slug' when 2 then 'S' || s_suppkey || ' (workday): missing/invalid site' end as error from supplier"
)
def watchlist_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Companies whose slug, host or site can't go into a request."""
    k = c("s_suppkey") % 6
    rows = table(spark, sf, "supplier").select(
        "s_suppkey", F.concat(F.lit("S"), c("s_suppkey").cast("string")).alias("name"),
        F.when(k == 0, "zzz").when(k == 2, "workday").otherwise("lever").alias("ats"),
        F.when(k == 1, "../x").otherwise("ok-1.a_b").alias("slug"), F.lit("wd1").alias("host"), F.lit(None).cast("string").alias("site")
    )
    return discovery.rejected(rows, payloads.DEPTH).select("s_suppkey", "error")


@query("select 'broken' as source, 'ZeroDivisionError' as outcome union all select 'late', 'failed' union all select 'ok', '25 rows'")
def isolated_sources(spark: SparkSession, sf: str) -> DataFrame:
    """A source that fails, now or when it is read, is an error; the others go on."""
    nation = table(spark, sf, "nation")
    readers = {
        "ok": lambda: nation, "broken": lambda: nation.limit(1 // 0),
        "late": lambda: nation.select(F.raise_error(F.lit("down")).cast("string").alias("x"))
    }
    frames, errors = files.each_apart(readers, scratch(spark, "landing"))
    rows = [(n, e if n == "broken" else "failed") for n, e in errors] + [(n, f"{f.count()} rows") for n, f in frames.items()]
    return spark.createDataFrame(rows, "source string, outcome string")


@query(
    "select n_nationkey, 'b' || n_nationkey as slug, case when n_nationkey % 2 = 0 then 'workday/b' || n_nationkey || '/wd1/site' else 'lever/b' || n_nationkey end as entry_key from nation"
)
def watchlist_file(spark: SparkSession, sf: str) -> DataFrame:
    """A watchlist document."""
    n = c("n_nationkey")
    one = F.struct(
        F.col("n_name").alias("name"), F.when(n % 2 == 0, "workday").otherwise("lever").alias("ats"),
        F.concat(F.lit("b"), n.cast("string")).alias("slug"), F.when(n % 2 == 0, "wd1").alias("host"),
        F.when(n % 2 == 0, "Site").alias("site")
    )
    path = scratch(spark, "watchlist")
    table(spark, sf, "nation").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(n, one.alias("x")))).alias("all"))).alias("j")).select(
        F.to_json(
            F.struct(
                F.transform(
                    F.from_json("j", "all ARRAY<STRUCT<x:STRUCT<name:STRING,ats:STRING,slug:STRING,host:STRING,site:STRING>>>")["all"],
                    lambda x: x["x"]
                ).alias("companies")
            )
        ).alias("value")
    ).write.text(path)
    rows = files.watchlist_companies(spark, path)
    return rows.select(F.regexp_extract("slug", "b([0-9]+)", 1).cast("int").alias("n_nationkey"), "slug", "entry_key")


@query("select 'T ' || n_name || ' é & co' as title, 'https://x.example/' || n_nationkey as link, 'a – b' as body from nation")
def feed_items(spark: SparkSession, sf: str) -> DataFrame:
    """Feeds whose text has HTML entities."""
    path = scratch(spark, "feeds")
    item = F.concat(
        F.lit("<item><title>T "), "n_name", F.lit(" &eacute; &amp; co</title><link>https://x.example/"), c("n_nationkey").cast("string"),
        F.lit("</link><pubDate>d</pubDate><description>a &ndash; b</description></item>")
    )
    docs = table(spark, sf, "nation").groupBy("n_regionkey").agg(
        F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), "\n"), F.lit("</channel></rss>")).alias("value")
    )
    docs.select("value").repartition(5).write.text(path)
    return files.feed_text(spark, path).select("title", "link", "body")


@query(
    "select 'NATION_' || n_nationkey as name, 1 + case when n_nationkey % 2 = 0 then 1 else 0 end as todos, case when n_nationkey % 2 = 0 then '' else 'auth' end as missing from nation"
)
def profile_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """What profiles still lack."""
    path = scratch(spark, "profiles")
    doc = F.concat(F.lit("---\nname: "), "n_name", F.when(c("n_nationkey") % 2 == 0, "\nauth: TODO").otherwise(""), F.lit("\n---\nbody TODO"))
    table(spark, sf, "nation").repartitionById(25, c("n_nationkey")).select(doc.alias("value")).write.text(path)
    front = files.profiles(spark, path)
    gaps = files.completeness(front, ("name", "auth"))
    return gaps.join(
        front.select("path", F.regexp_extract("front", "name: (.*)", 1).alias("name")), "path"
    ).where("name <> ''").select("name", "todos", F.array_join("missing", ",").alias("missing"))


# ---- predicates

PLACES = ("Berlin, Germany", "Remote - US", "Austin, TX", "EMEA", "Remote (Canada)", "Indianapolis, Indiana", None, "Dubai / London")
PHRASES = ("this is a remote position", "no remote", "we work from home", "hybrid cloud", "Telework offered", "", None)


def sql_names(words: tuple[str, ...]) -> str:
    """Names with no letter beside them, for patterns that can't look around."""
    return "(^|[^a-z])(" + "|".join(text.java_quote(w).replace("\\ ", " ") for w in sorted(words, key=len, reverse=True)) + ")($|[^a-z])"


SQL_US = r"(?i)(^|[^a-z])(u\.?s\.?a?|us|united states( of america)?)($|[^a-z])"
SQL_EXCLUDED = f"(regexp_matches(lower(coalesce(p_name, '') || ' ' || coalesce(loc, '')), {q(sql_names(vocab.EXCLUDED_PLACES))}) and not regexp_matches(lower(coalesce(loc, '')), {q(SQL_US)}))"
SQL_SAID = f"case when regexp_matches(p_name || ' ' || coalesce(loc, ''), {q(arrangement.NEGATED)}) then false when regexp_matches(p_name || ' ' || coalesce(loc, ''), {q(arrangement.REMOTE)}) then true else regexp_matches(coalesce(body, ''), {q(arrangement.MENTIONED)}) and not regexp_matches(coalesce(body, ''), {q(arrangement.NEGATED)}) end"
PLACED = f"placed as (select *, {sql_chosen(*PLACES)} as loc, {sql_chosen(*PHRASES)} as body from part)"


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").withColumns({"location": chosen(*PLACES), "text": chosen(*PHRASES), "title": c("p_name")})


@query(f"with {PLACED} select p_partkey, {SQL_EXCLUDED} as excluded from placed")
def excluded_places(spark: SparkSession, sf: str) -> DataFrame:
    """Excluded places, unless the location names the US."""
    return _placed(spark, sf).select("p_partkey", places.excluded(c("title"), c("location")).alias("excluded"))


@query(f"with {PLACED} select p_partkey, {SQL_SAID} as remote from placed")
def remote_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a posting reads as remote."""
    return _placed(spark, sf).select("p_partkey", arrangement.mentions_remote(c("title"), c("location"), c("text")).alias("remote"))


ALLOWED = ("us", "EMEA", "UNSTATED")
AREA_LISTS = (None, "", "US", "US-TX,DE", "DE")
REGION_LISTS = (None, "EMEA", "AMERICAS", "LATAM")
SQL_SCOPE = "case when areas is null and regions is null then true else coalesce(len(areas) = 0, false) or coalesce(len(list_filter(areas, lambda a: a in ('US', 'EMEA', 'UNSTATED') or starts_with(a, 'US-'))) > 0, false) or coalesce(len(list_filter(regions, lambda r: r in ('US', 'EMEA', 'UNSTATED') or r in ('US', 'ANY', 'AMERICAS', 'NORTH AMERICA'))) > 0, false) end"
SCOPED = f"scoped as (select *, case when a = '' then cast([] as varchar[]) else string_split(a, ',') end as areas, string_split(g, ',') as regions from (select *, {sql_chosen(*AREA_LISTS)} as a, {sql_chosen(*REGION_LISTS)} as g from placed))"


def _scoped(spark: SparkSession, sf: str) -> DataFrame:
    a, g = chosen(*AREA_LISTS), chosen(*REGION_LISTS)
    return _placed(spark, sf).withColumns(
        {"remote_areas": F.when(a == "", F.array().cast("array<string>")).otherwise(F.split(a, ",")), "remote_regions": F.split(g, ",")}
    )


@query(f"with {PLACED}, {SCOPED} select p_partkey, {SQL_SCOPE} as allowed from scoped")
def scope_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Stated boundaries against a policy; an empty list is the whole world."""
    return _scoped(spark, sf).select("p_partkey", places.scope_allowed(c("remote_areas"), c("remote_regions"), list(ALLOWED)).alias("allowed"))


@query(f"""with {PLACED}, {SCOPED}, kinds as (select *, {sql_chosen(None, 'remote', 'onsite')} as kind, {sql_chosen('US', None)} as land from scoped)
  select p_partkey from kinds where case when kind is not null then kind = 'remote' else {SQL_SAID} end and not (coalesce(land <> 'US', true) and {SQL_EXCLUDED}) and {SQL_SCOPE}""")
def remote_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Typed arrangement, else prose; then excluded places, then the boundary."""
    rows = _scoped(spark, sf).withColumns({"remote_type": chosen(None, "remote", "onsite"), "country": chosen("US", None)})
    return rows.where(score.remote_gate(config.Config(allowed_scopes=ALLOWED))).select("p_partkey")


@query(
    f"""with {VIEW} select seq from posting where seq % 7 <> 0 and date_diff('day', cast(posted as date), date '{AS_OF}') <= {CFG.max_age_days} and not ({
        ' or '.join(sql_word(k, 'lower(title)') for k in CFG.exclude_titles)
    }) and ({' or '.join(sql_word(k, 'lower(title)') for k in CFG.title_signal)})"""
)
def cheap_gates(spark: SparkSession, sf: str) -> DataFrame:
    """No URL, too old, or off topic."""
    import dataclasses

    rows = posting(spark, sf).withColumn("url", F.when(c("seq") % 7 == 0, "").otherwise(c("url")))
    return score.gated(rows, dataclasses.replace(CFG, remote_only=False), day()).select("seq")


@query(
    f"select p_partkey, trim(lower(coalesce({
        sql_chosen('Remote', ' ANY ', 'Oslo', '', None, 'anywhere', 'Anywhere, US')
    }, ''))) in ('', 'remote', 'anywhere', 'any') as placeless from part"
)
def placeless_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Searches for an arrangement, not a place."""
    return table(spark, sf, "part").select(
        "p_partkey", places.is_placeless_query(chosen("Remote", " ANY ", "Oslo", "", None, "anywhere", "Anywhere, US")).alias("placeless")
    )


@query(f"select p_partkey, {sql_chosen('true', 'true', 'false', 'true', 'false', 'true', 'true', 'false')} = 'true' as legal from part")
def legal_scopes(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens that a policy may hold."""
    return table(spark, sf, "part").select(
        "p_partkey", places.legal_scope(chosen("us", "US-TX", "USA", "emea", "Narnia", "unstated", "TIMEZONE", "")).alias("legal")
    )


SQL_LEVEL = "case w " + " ".join(f"when {q(k)} then {q(v)}" for k, v in vocab.MATCH_LEVELS.items()) + " end"
SQL_NO_QUALIFIER = ", ".join(q(w) for w in (*vocab.MATCH_LEVELS, *vocab.QUALIFIER_NOISE))


def sql_title(k: str) -> str:
    return f"(case when {k}.p_size % 3 = 0 then 'Senior ' else '' end || {k}.p_type || case when {k}.p_size % 2 = 0 then ' II' else '' end || case when {k}.p_size % 5 = 0 then '' else ', ' || {k}.p_name end)"


def _title(prefix: str) -> Column:
    size = c(f"{prefix}.p_size")
    return F.concat(
        F.when(size % 3 == 0, "Senior ").otherwise(""), c(f"{prefix}.p_type"), F.when(size % 2 == 0, " II").otherwise(""),
        F.when(size % 5 == 0, "").otherwise(F.concat(F.lit(", "), c(f"{prefix}.p_name")))
    )


def _title_pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.alias("a").join(p.alias("b"), F.expr("a.p_partkey + 1 = b.p_partkey")).select(
        c("a.p_partkey").alias("p_partkey"), _title("a").alias("a"), _title("b").alias("b")
    )


TITLE_PAIRS = f"pairs as (select a.p_partkey, {sql_title('a')} as a, {sql_title('b')} as b from part a join part b on a.p_partkey + 1 = b.p_partkey)"
SQL_MARKS = ", ".join(
    f"regexp_extract_all(lower({x}), '[a-z0-9]+') as w{x}, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda w: {SQL_LEVEL}), lambda v: v is not null))) as l{x}, list_distinct(list_filter(regexp_extract_all(regexp_extract(lower({x}), ',\\s*([^,]+)$', 1), '[a-z0-9]+'), lambda w: w not in ({SQL_NO_QUALIFIER}))) as q{x}"
    for x in "ab"
)


@query(
    f"with {TITLE_PAIRS}, marks as (select *, {SQL_MARKS} from pairs) select p_partkey, array_to_string(la, ',') as levels, array_to_string(list_sort(qa), ',') as qualifiers, la = lb and list_sort(list_filter(qa, lambda x: not list_contains(wb, x))) = list_sort(list_filter(qb, lambda x: not list_contains(wa, x))) as same from marks"
)
def same_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Levels and qualifiers of two titles speak against one role, or don't."""
    a, b = c("a"), c("b")
    return _title_pairs(spark, sf).select(
        "p_partkey", F.array_join(titles.levels(a), ",").alias("levels"), F.array_join(titles.qualifiers(a), ",").alias("qualifiers"),
        titles.same_role(a, b).alias("same")
    )


def sql_lcs(a: str, b: str) -> str:
    """The longest common subsequence of two lists of characters, a row of the table for each character of the second."""
    return f"list_reduce({b}, lambda prow, ch: list_reduce(range(1, len({a}) + 1), lambda acc, i: list_append(acc, greatest(prow[i + 1], acc[len(acc)], prow[i] + case when {a}[i] = ch then 1 else 0 end)), [cast(0 as bigint)]), list_transform(range(len({a}) + 1), lambda z: cast(0 as bigint)))[len({a}) + 1]"


TITLE_RATIOS = f"""with n as (select p_partkey, string_split({sql_norm("p_type || ' ' || p_size")}, ' ') as w from part), p as (select a.p_partkey, array_to_string(list_sort(a.w), ' ') as a, array_to_string(list_sort(b.w), ' ') as b from n a join n b on a.p_partkey + 1 = b.p_partkey),
  d as (select distinct a, b, list_transform(range(1, len(a) + 1), lambda i: a[i]) as x, list_transform(range(1, len(b) + 1), lambda i: b[i]) as y from p), r as (select a, b, {sql_lcs("x", "y")} as lcs from d)
  select p_partkey, 200.0::double * lcs / (len(a) + len(b)) as sort_ratio from p join r using (a, b)"""


@query(TITLE_RATIOS)
def sort_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """Token-sort ratios of neighbouring titles, in Arrow batches."""
    t = text.norm(F.concat_ws(" ", "p_type", "p_size"))
    p = table(spark, sf, "part")
    a, b = p.select("p_partkey", t.alias("a")), p.select((c("p_partkey") - 1).alias("p_partkey"), t.alias("b"))
    return linkage.ratios(a.join(b, "p_partkey"), "a", "b").select("p_partkey", "sort_ratio")


def sql_chars(x: str) -> str:
    return f"list_transform(range(1, len({x}) + 1), lambda i: {x}[i])"


SQL_VARIANT = "case p_size % 5 when 0 then p_name || ' ' || p_type when 1 then p_type || ' ' || p_name || 's' when 2 then p_type || ' ' || p_name || ' II' when 3 then p_type || ' ' || p_name || ', Berlin' else p_brand || ' ' || p_name end"
FUZZY = f"""with t as (select p_partkey as k, p_size, p_type || ' ' || p_name as ta, {SQL_VARIANT} as tb, {sql_norm("p_type || ' ' || p_name")} as na, {sql_norm(SQL_VARIANT)} as nb from part),
  w as (select *, list_sort(string_split(na, ' ')) as wa, list_sort(string_split(nb, ' ')) as wb from t),
  g as (select *, array_to_string(wa, ' ') as sa, array_to_string(wb, ' ') as sb, list_sort(list_distinct(list_filter(wa, lambda x: list_contains(wb, x)))) as com, list_sort(list_distinct(list_filter(wa, lambda x: not list_contains(wb, x)))) as oa, list_sort(list_distinct(list_filter(wb, lambda x: not list_contains(wa, x)))) as ob from w),
  h as (select *, array_to_string(com, ' ') as base, array_to_string(com || oa, ' ') as xa, array_to_string(com || ob, ' ') as xb from g),
  c as (select *, {sql_chars("sa")} as csa, {sql_chars("sb")} as csb, {sql_chars("base")} as cb, {sql_chars("xa")} as cxa, {sql_chars("xb")} as cxb from h),
  r as (select *, 200.0 * {sql_lcs("csa", "csb")} / (len(sa) + len(sb)) as sorted, case when len(com) > 0 and (len(oa) = 0 or len(ob) = 0) then 100.0 else greatest(200.0 * {sql_lcs("cxa", "cxb")} / (len(xa) + len(xb)),
    case when len(com) > 0 then 200.0 * {sql_lcs("cb", "cxa")} / (len(base) + len(xa)) else 0 end, case when len(com) > 0 then 200.0 * {sql_lcs("cb", "cxb")} / (len(base) + len(xb)) else 0 end) end as setted from c),
  v as (select *, 'co ' || k || '|' || na || '|' as ka, 'co ' || k || '|' || nb || '|' as kb, na = nb or (p_size % 5 not in (2, 3) and len(list_filter(wb, lambda x: x in ('1', '2', '3', '4'))) = 0 and setted >= 90 and sorted >= 82) as one from r)
  select ka as dedup_key, case when one then 2 * k + 1 else 2 * k end as seq, case when one then tb else ta end as title, case when one then 'hn,lever' else 'hn' end as sources from v union all select kb, 2 * k + 1, tb, 'lever' from v where not one"""


def _two_each(spark: SparkSession, sf: str) -> DataFrame:
    """Two postings of each company, whose titles are alike by one of five ways."""
    p = spread(table(spark, sf, "part"))
    k, kind = c("p_partkey"), c("p_size") % 5
    plain = F.concat_ws(" ", "p_type", "p_name")
    other = (
        F.when(kind == 0, F.concat_ws(" ", "p_name", "p_type")).when(kind == 1, F.concat(plain, F.lit("s")))
        .when(kind == 2, F.concat(plain, F.lit(" II"))).when(kind == 3, F.concat(plain, F.lit(", Berlin"))).otherwise(F.concat_ws(" ", "p_brand", "p_name"))
    )
    first = F.struct((k * 2).alias("seq"), plain.alias("title"), F.lit("hn").alias("source"))
    second = F.struct((k * 2 + 1).alias("seq"), other.alias("title"), F.lit("lever").alias("source"))
    rows = p.select(F.concat(F.lit("Co "), k.cast("string")).alias("company"), F.explode(F.array(first, second)).alias("x"))
    return rows.select("company", "x.*").withColumns({"location": F.lit(""), "url": F.lit(""), "text": F.lit("t"), "score": F.lit(1)})


@query(FUZZY)
def fuzzy_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Companies with two postings each: one role under two titles, or two roles."""
    return linkage.linked(_two_each(spark, sf)).select("dedup_key", "seq", "title", F.array_join("sources", ",").alias("sources"))


@query(f"select dedup_key, seq, sources, true as fresh from ({FUZZY})")
def streamed_linkage(spark: SparkSession, sf: str) -> DataFrame:
    """The same linkage as a stream, whose state is each block's survivors."""
    landing, out = scratch(spark, "landing"), scratch(spark, "links")
    rows = _two_each(spark, sf)
    rows.write.parquet(landing)
    links = upserts.linked_stream(spark.readStream.schema(rows.schema).parquet(landing))
    run = links.writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"))  # a batch that is replayed replaces itself
    run.option("checkpointLocation", scratch(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("dedup_key", "seq", F.array_join("sources", ",").alias("sources"), "fresh")


# ---- joins

@query("""with watch as (select s_suppkey as seq, case when s_suppkey % 2 = 0 then s_name else upper(replace(s_name, '#', ' # ')) end as name, s_suppkey % 3 = 0 as frontier, s_suppkey % 4 = 0 as local, case when s_suppkey % 5 = 0 then 'i' || s_suppkey end as industry from supplier
    union all select s_suppkey + 1000000, s_name, true, false, 'late' from supplier where s_suppkey % 6 = 0),
  last as (select *, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) as nk, row_number() over (partition by trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) order by seq desc) as rn from watch)
  select l.l_orderkey, l.l_linenumber, w.frontier, w.local, coalesce(w.industry, '') as industry from lineitem l join supplier s on l.l_suppkey = s.s_suppkey left join last w on w.rn = 1 and w.nk = trim(regexp_replace(lower(s.s_name), '[^a-z0-9]+', ' ', 'g')) and s.s_suppkey % 7 <> 0""")
def meta_left_join(spark: SparkSession, sf: str) -> DataFrame:
    """Postings with what the watchlist says of their company; of doubles the last counts."""
    k = c("s_suppkey")
    s = table(spark, sf, "supplier")
    first = s.where(k % 7 != 0).select(
        k.cast("long").alias("seq"),
        F.when(k % 2 == 0, c("s_name")).otherwise(F.upper(F.replace("s_name", F.lit("#"), F.lit(" # ")))).alias("name"),
        (k % 3 == 0).alias("frontier"), (k % 4 == 0).alias("local"),
        F.when(k % 5 == 0, F.concat(F.lit("i"), k.cast("string"))).alias("industry")
    )
    late = s.where((k % 6 == 0) & (k % 7 != 0)).select(
        (k + 1_000_000).alias("seq"), c("s_name").alias("name"), F.lit(True).alias("frontier"), F.lit(False).alias("local"),
        F.lit("late").alias("industry")
    )
    rows = table(spark, sf, "lineitem").join(s, c("l_suppkey") == k).select(
        "l_orderkey", "l_linenumber", c("s_name").alias("company"), F.lit("").alias("industry")
    )
    return store.with_meta(rows, first.unionByName(late)).select("l_orderkey", "l_linenumber", "frontier", "local", "industry")


@query(
    "select name, url from (values ('remoteok', 'Remote OK', 'https://remoteok.com'), ('remotive', 'Remotive', 'https://remotive.com'), ('adzuna', 'Adzuna', 'https://www.adzuna.com'), ('himalayas', 'Himalayas', 'https://himalayas.app')) as t(source, name, url) where exists (select 1 from documents where doc_id % 5 = 0) and source <> 'himalayas'"
)
def semi_join(spark: SparkSession, sf: str) -> DataFrame:
    """The credits owed for sources that contributed."""
    rows = table(spark, sf, "documents").select(
        F.when(
            c("doc_id") % 5 == 0, F.array(F.lit("remoteok"), F.lit("lever"))
        ).when(c("doc_id") % 5 == 1, F.array(F.lit("remotive"))).otherwise(F.array().cast("array<string>")).alias("sources"),
        F.when(c("doc_id") % 5 == 2, "adzuna").otherwise("").alias("source")
    )
    return emit.credits(spark, rows).select("name", "url")


@query(
    "select p_partkey, 'Name ' || (p_partkey // 50) as company, 'workday' as source, case when (p_partkey // 50) % 2 = 0 then 'x' else '' end as industry from part where (p_partkey // 50) % 3 <> 0"
)
def stamped_boards(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a board with what the watchlist says of its company."""
    board = F.floor(c("p_partkey") / 50).cast("long")
    rows = table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit("B"), board.cast("string")).alias("slug"), F.lit("wd1").alias("host"), F.lit("Site").alias("site")
    )
    each = table(spark, sf, "part").select(board.alias("b")).distinct().where("b % 3 <> 0")
    entry = lambda site, name: each.select(F.concat(F.lit(name), c("b").cast("string")).alias("name"), F.lit("workday").alias("ats"), F.concat(F.lit("b"), c("b").cast("string")).alias("slug"), F.lit("WD1").alias("host"), F.lit(site).alias("site"), F.when(c("b") % 2 == 0, "x").alias("industry"))
    return payloads.stamped(
        rows, entry("site", "Name ").unionByName(entry("other", "No ")), "workday"
    ).select("p_partkey", "company", "source", "industry")


@query(
    """with boards as (select distinct 'lever/co' || (page_id % 7) as entry_key, 'co' || (page_id % 7) as slug from pages where page_id % 5 = 1) select slug, 'lever' as ats, '(seeded)' as industry from boards where slug not in ('co0', 'co3')"""
)
def anti_join(spark: SparkSession, sf: str) -> DataFrame:
    """Mined boards that the watchlist lacks, as its new entries."""
    lines = table(spark, sf, "pages").where("page_id % 5 = 1").select(F.to_json(F.struct(F.expr(BOARD_URLS).alias("url"))).alias("value"))
    known = spark.createDataFrame([("lever/co0",), ("lever/co3",)], "entry_key string")
    return discovery.watch_entries(discovery.seeded(discovery.mined(lines), known, 300), "(seeded)").select("slug", "ats", "industry")


@query("""select 'k' || c_custkey as dedup_key, case when c_custkey % 4 = 0 then 'applied' else 'new' end as status, cast(cast(floor(abs(c_acctbal)) as integer) as varchar) as score, case when c_custkey % 3 = 0 then null when c_custkey % 3 = 1 then 'dept' end as category,
  case when c_custkey % 3 = 1 then 'body' end as text, case when c_custkey % 3 = 1 then 'a,b' when c_custkey % 3 = 2 then 'lever,hn' else 'lever,hn' end as sources from customer""")
def grafted_records(spark: SparkSession, sf: str) -> DataFrame:
    """The store's history with the harvest's record; a store row without a harvest keeps its own sources."""
    k = c("c_custkey")
    stored = table(spark, sf, "customer").select(
        F.concat(F.lit("k"), k.cast("string")).alias("dedup_key"), F.when(k % 4 == 0, "applied").otherwise("new").alias("status"),
        F.floor(F.abs("c_acctbal")).cast("int").cast("string").alias("score"), F.lit("lever, hn").alias("source")
    )
    harvested = table(spark, sf, "customer").where(k % 3 < 2).select(
        F.concat(F.lit("k"), k.cast("string")).alias("dedup_key"), F.lit("9").alias("score"), F.when(k % 3 == 1, "dept").alias("category"),
        F.when(k % 3 == 1, "body").otherwise("").alias("text"),
        F.when(k % 3 == 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("sources")
    )
    return emit.grafted(stored, harvested).select("dedup_key", "status", "score", "category", "text", F.array_join("sources", ",").alias("sources"))


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as rows of the store."""
    k = c("c_custkey")
    own = {"id": text.short_id(c("c_name")), "first_seen": F.lit(AS_OF), "age_days": F.when(k % 3 == 0, "").otherwise((k % 90).cast("string")), "score": (k % 50).cast("string"), "llm_score": F.when(k % 5 == 0, (k % 100).cast("string")).otherwise(""), "llm_note": F.when(k % 5 == 0, "note").otherwise(""),
           "status": F.when(k % 7 == 0, "applied").when(k % 7 == 1, "interviewing").otherwise("new"), "salary": F.when(k % 4 == 0, "$1").otherwise(""), "company": c("c_name"), "title": F.concat(c("c_mktsegment"), F.lit(" engineer")), "url": F.concat(F.lit("u"), k.cast("string")), "dedup_key": c("c_name")}
    return table(spark, sf, "customer").select("c_custkey", *(own.get(n, F.lit("")).alias(n) for n in store.COLUMNS))


@query(
    "select c_custkey, case when c_custkey % 4 = 0 then '77' when c_custkey % 5 = 0 then cast(c_custkey % 100 as varchar) else '' end as llm_score, case when c_custkey % 4 = 0 then 'new' when c_custkey % 5 = 0 then 'note' else '' end as llm_note from customer"
)
def annotations(spark: SparkSession, sf: str) -> DataFrame:
    """J05, ST2: notes grafted on by key."""
    rows = _customers(spark, sf)
    notes = rows.where("c_custkey % 4 = 0").select("dedup_key", F.lit("77").alias("llm_score"), F.lit("new").alias("llm_note"))
    return store.annotate(rows, notes).select("c_custkey", "llm_score", "llm_note")


@query("select count(*) filter (where c_custkey % 7 = 0 or c_custkey = 5) as applied, true as hit, false as slip from customer")
def marked_status(spark: SparkSession, sf: str) -> DataFrame:
    """ST3: a status for one id, and whether there is such a row."""
    rows = _customers(spark, sf)
    row_id = rows.where("c_custkey = 5").first()["id"]
    done = store.mark_status(rows, row_id, "applied").agg(F.count_if(c("status") == "applied").alias("applied"))
    return done.withColumns({"hit": F.lit(store.has_id(rows, row_id)), "slip": F.lit(store.has_id(rows, "nonsense"))})


@query(
    "select s_suppkey as n, s_name as name, case when s_suppkey % 2 = 0 then 'lever' else 'ashby' end as ats, case when s_suppkey % 2 = 0 then lower(replace(s_name, '#', '')) else lower(replace(s_name, '#', '-')) end as slug from supplier where s_suppkey % 3 = 0"
)
def names_matched(spark: SparkSession, sf: str) -> DataFrame:
    """Companies with boards of a known universe, by exact slugs."""
    k = c("s_suppkey")
    s = table(spark, sf, "supplier")
    slug = F.when(k % 2 == 0, F.replace("s_name", F.lit("#"), F.lit(""))).otherwise(F.replace("s_name", F.lit("#"), F.lit("-")))
    universe = s.where(k % 3 == 0).select(k.alias("seq"), F.when(k % 2 == 0, "lever").otherwise("ashby").alias("ats"), slug.alias("slug"))
    return discovery.match_known(s.select(k.alias("seq"), c("s_name").alias("name")), universe)


@query(
    "select n_name as name, 'region' as field, cast(n_regionkey as varchar) as profile, case when n_nationkey % 5 <> 0 then '9' end as indexed from nation where n_nationkey % 5 = 0 or (n_nationkey % 3 = 0 and n_nationkey % 5 <> 0) union all select n_name, 'key', cast(n_nationkey as varchar), null from nation where n_nationkey % 5 = 0"
)
def index_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Where an index disagrees with its profiles, or lacks one."""
    n = table(spark, sf, "nation").select(
        c("n_name").alias("name"), c("n_regionkey").cast("string").alias("region"), c("n_nationkey").cast("string").alias("key")
    )
    index = n.where("key % 5 <> 0").withColumn("region", F.when(c("key") % 3 == 0, "9").otherwise(c("region")))
    return files.drift(n, index, ("region", "key"))


CONTAINED = "select distinct doc_id, item_id from documents d join (select item_id, text from benchmark union all select item_id + 1000, regexp_extract(text, '^\\S+ (\\S+ \\S+)', 1) from benchmark where item_id % 4 = 0 union all select 2000, 'anha') b on contains(d.text, b.text)"


@query(CONTAINED)
def contamination(spark: SparkSession, sf: str) -> DataFrame:
    """J10, as a containment join: whole passages of the benchmark, and pieces of one and two words, in documents.

    A passage's first and last words may be parts of longer ones; those between are whole in any text that holds it.
    So a passage meets the documents that have its rarest inner word, which only ids and words are moved for, and texts
    are searched for such pairs alone. Passages without an inner word are few and stated: they go over all texts in blocks."""
    b = table(spark, sf, "benchmark").where("text is not null")
    short = b.where("item_id % 4 = 0").select((c("item_id") + 1000).alias("item_id"), F.regexp_extract("text", r"^\S+ (\S+ \S+)", 1).alias("passage"))
    passages = b.select("item_id", c("text").alias("passage")).unionByName(short).unionByName(
        spark.createDataFrame([(2000, "anha")], "item_id long, passage string")
    )
    return contained(table(spark, sf, "documents").select("doc_id", "text"), passages)


def contained(docs: DataFrame, passages: DataFrame, block: int = 200) -> DataFrame:
    """(doc_id, item_id) of the documents whose text holds a passage. passages: (item_id, passage)."""
    docs = docs.where("text is not null")
    parts = F.split("passage", " ")
    inner = passages.withColumn("words", F.array_distinct(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))))
    wanted = inner.select("item_id", F.explode("words").alias("word"))
    held = docs.select(
        "doc_id", F.explode(F.array_distinct(F.split("text", " "))).alias("word")
    ).join(wanted.select("word").distinct(), "word", "left_semi")
    often = held.groupBy("word").agg(F.count("*").alias("docs"))
    rarest = wanted.join(often, "word", "left").groupBy("item_id").agg(
        F.min(F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "word")).alias("x")
    ).where("x.docs > 0").select("item_id", "x.word")
    pairs = held.join(rarest, "word").select("doc_id", "item_id").distinct()
    found = pairs.join(docs, "doc_id").join(passages, "item_id").where(F.contains("text", "passage")).select("doc_id", "item_id")
    bare = inner.where(F.size("words") == 0).select(
        F.pmod(F.xxhash64("item_id", "passage"), F.lit(64)).alias("g"), F.struct("item_id", "passage").alias("p")
    ).groupBy("g").agg(F.collect_list("p").alias("all"))
    blocks = bare.select(
        F.explode(
            F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / block).cast("int")), lambda i: F.slice("all", i * block + 1, F.lit(block)))
        ).alias("block")
    )
    over = docs.crossJoin(F.broadcast(blocks)).select(
        "doc_id", F.explode(F.filter("block", lambda p: F.contains(c("text"), p["passage"]))).alias("p")
    ).select("doc_id", "p.item_id")
    return found.unionByName(over).distinct()


# ---- aggregates, order

@query(
    "select doc_id, source from documents where doc_id in (select min(doc_id) from documents where n_chars % 9 <> 0 group by n_chars) or n_chars % 9 = 0"
)
def first_wins(spark: SparkSession, sf: str) -> DataFrame:
    """The first row of each key; rows without a key all stay."""
    d = table(spark, sf, "documents").select("doc_id", "source", "n_chars").withColumn("seq", c("doc_id")).withColumn("position", F.lit(0))
    return payloads.first_wins(d, F.when(c("n_chars") % 9 != 0, c("n_chars").cast("string"))).select("doc_id", "source")


@query(
    "select source, count(*) as rows from (select source from documents where doc_id % 3 <> 0 union all select 'extra' from documents where doc_id % 3 = 1) where source is not null and source <> '' group by 1"
)
def rows_by_source(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that each source contributed to; a row without a list counts for its own source, or for none."""
    d = table(spark, sf, "documents")
    own = F.array(F.coalesce("source", F.lit("")))
    rows = d.withColumn(
        "sources",
        F.when(c("doc_id") % 3 == 1, F.concat(F.array_remove(own, ""), F.array(F.lit("extra")))).otherwise(F.array().cast("array<string>"))
    ).withColumn("source", F.when(c("doc_id") % 3 == 0, "").otherwise(F.coalesce("source", F.lit(""))))
    return emit.by_source(rows)


@query(
    """with s as (select source, count(*) as n from documents group by 1) select (select count(*) from documents) as rows, (select string_agg(source || '=' || n, ',' order by source) from s) as by_source, cast(2 as bigint) as sources_failed, 'a,b' as errors, 3 as companies_discovered, 'postings.manifest' as kind"""
)
def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """One row about a run."""
    rows = table(spark, sf, "documents").withColumn("sources", F.array("source"))
    m = emit.manifest(rows, spark.createDataFrame([("b",), ("a",)], "error string"), CFG, "t0", "t1", 3)
    told = F.array_join(F.transform(F.map_entries("rows_by_source"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return m.select("rows", told.alias("by_source"), "sources_failed", F.array_join("errors", ",").alias("errors"), "companies_discovered", "kind")


@query(
    "select (select count(*) from customer) as tracked, count(*) as shortlisted, count(*) filter (where c_custkey % 2 = 0) as fresh, cast(4 as bigint) as errors from customer where c_custkey % 7 <> 0 and c_custkey % 50 >= 5 and (c_custkey % 3 = 0 or c_custkey % 90 <= 1200)"
)
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Tracked, shortlisted, new, failed."""
    rows = _customers(spark, sf).withColumn("is_new", c("c_custkey") % 2 == 0)
    return emit.summary(rows, store.surface(rows, CFG), 4)


@query("""select c_custkey, '  [' || left(sha1(c_name), 7) || '] ' || lpad(case when c_custkey % 5 = 0 then cast(c_custkey % 100 as varchar) else cast(c_custkey % 50 as varchar) end, 3, ' ') || '  ' || rpad(c_mktsegment || ' engineer', 52, ' ') || '  ' || left(c_name, 24)
  || coalesce('  ' || nullif(array_to_string(list_filter([case when sc >= 30 then '★ strong' when sc >= 22 then '◆ worth a look' end, case when c_custkey % 4 = 0 then '$1' end, case when c_custkey % 3 <> 0 then (c_custkey % 90) || 'd' end, case c_custkey % 7 when 0 then 'APPLIED' when 1 then 'INTERVIEWING' end], lambda x: x is not null), ' · '), ''), '')
  || case when c_custkey % 5 = 0 then chr(10) || '        ↳ note' else '' end as line from (select *, case when c_custkey % 5 = 0 then c_custkey % 100 else c_custkey % 50 end as sc from customer)""")
def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    """A store row as a line of text."""
    return _customers(spark, sf).select("c_custkey", emit.line(CFG).alias("line"))


@query("select c_custkey from customer order by c_custkey % 50 desc, c_name limit 30")
def by_score(spark: SparkSession, sf: str) -> DataFrame:
    """The first rows of the whole list by score, hidden ones too."""
    return store.by_score(_customers(spark, sf)).limit(30).select("c_custkey")


@query(
    "select c_custkey, left(sha1(c_name), 7) as id, cast(c_custkey % 50 as varchar) as score, case when c_custkey % 11 = 0 then '''=1+1' else c_mktsegment || ' engineer' end as title, case when c_custkey % 13 = 0 then 'a, \"b\"' || chr(10) || 'c' else '' end as signals from customer"
)
def store_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """The store's CSV, written and read back."""
    k = c("c_custkey")
    rows = _customers(spark, sf).withColumns(
        {"title": F.when(k % 11 == 0, "=1+1").otherwise(c("title")), "signals": F.when(k % 13 == 0, 'a, "b"\nc').otherwise("")}
    )
    path = f"{scratch(spark, 'sheet')}.csv"
    versions.write_sheet(rows, path)
    back = files.store_csv(spark, path)
    return back.select(F.regexp_extract("company", "#0*([0-9]+)", 1).cast("long").alias("c_custkey"), "id", "score", "title", "signals")


@query(
    "select o_orderpriority as source, cast(median(a) as double) as median_age_days, round_even(cast(count(*) filter (where a <= 100) as double) / count(*), 2) as pct_within_100d, case when o_orderpriority like '1%' then 'true' else 'false' end as date_sorted from (select *, a0 + case when o_orderpriority like '1%' then 0 else 0 end as a from (select *, " + AGE + " as a0 from orders)) group by 1, 4"
)
def freshness(spark: SparkSession, sf: str) -> DataFrame:
    """How old a source's sampled pages are, and whether they come by date (one source's do)."""
    o = table(spark, sf, "orders").withColumn("posted", F.date_format("o_orderdate", "yyyy-MM-dd"))
    by_date = (F.lit(9999) - F.year("o_orderdate") * 1).cast("int")
    page = F.when(c("o_orderpriority").startswith("1"), by_date).otherwise(F.year("o_orderdate"))
    return catalog.freshness(o.withColumns({"source": c("o_orderpriority"), "page": page}), "source", "page", c("posted"), day())


@query(
    """select c_custkey, case when c_custkey % 7 < 2 then 'unknown' when y >= x - 5 and z >= y - 5 and z > x + 30 then 'true' else 'false' end as verdict
  from (select c_custkey, cast(c_custkey % 5 as double) as x, cast(c_custkey % 31 as double) as y, cast(c_custkey % 53 as double) as z from customer)"""
)
def date_sorted(spark: SparkSession, sf: str) -> DataFrame:
    """Rising with slack, too little rise, a fall, too few pages."""
    k = c("c_custkey")
    pages = F.when(k % 7 > 1, F.array(*((k % n).cast("double") for n in (5, 31, 53)))).when(k % 7 == 1, F.array(F.lit(1.0), F.lit(90.0)))
    return table(spark, sf, "customer").select("c_custkey", catalog.date_sorted(pages).alias("verdict"))


@query(
    "select lang, cast(count(*) filter (where contains(lower(coalesce(text, '')), 'the')) as double) / count(*) as share from documents group by 1"
)
def relevance_share(spark: SparkSession, sf: str) -> DataFrame:
    """The share of rows that are about a term."""
    return table(spark, sf, "documents").groupBy("lang").agg(catalog.relevance(c("text"), "THE").alias("share"))


@query(
    "select count(*) as bodies, cast(median(length(text)) as double) as median_chars from documents where length(text) >= 200 and length(text) - length(replace(text, ' ', '')) >= 20 and not starts_with(text, 'http')"
)
def body_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """The longest text of a record that reads as prose."""
    return catalog.body_lengths(table(spark, sf, "documents"), F.array("lang", "text", "source"))


@query(
    "select s_suppkey % 3 as source, case s_suppkey % 3 when 0 then '429 after 4 consecutive requests with no pause' when 1 then 'HTTP 503 after 2 requests — server-side, not a documented limit' else 'unknown — 6 consecutive requests, no 429' end as rate_limit from supplier where s_suppkey < 3"
)
def rate_bursts(spark: SparkSession, sf: str) -> DataFrame:
    """What a burst of requests ran into first."""
    n, k = c("n"), c("source")
    rows = table(spark, sf, "supplier").where("s_suppkey < 3").select(
        c("s_suppkey").alias("source"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("n")
    )
    status = F.when((k == 0) & (n >= 4), 429).when((k == 1) & (n == 2), 503).when((k == 1) & (n == 3), 429).otherwise(200)
    return catalog.burst(rows.select("source", n.alias("attempt"), status.alias("status")))


@query("select min(turn) as first_turn, conv_id, role from conversations group by 2, 3")
def role_first_turn(spark: SparkSession, sf: str) -> DataFrame:
    """A08 over conversations: each role's first turn, by arrival."""
    rows = table(spark, sf, "conversations").withColumns({"seq": c("conv_id"), "position": c("turn")})
    return payloads.first_wins(rows, F.concat_ws("/", "conv_id", "role")).select("conv_id", "role", c("turn").alias("first_turn"))


@query(
    "select c_custkey, case c_custkey % 5 when 0 then 'ignores_unknown' when 1 then 'rejects_unknown_400' else 'unknown' end as verdict from customer"
)
def junk_parameters(spark: SparkSession, sf: str) -> DataFrame:
    """What a made-up parameter shows."""
    k = c("c_custkey") % 5
    status = F.when(k == 1, 400).when(k == 2, 403).otherwise(200)
    return table(spark, sf, "customer").select(
        "c_custkey",
        discovery.junk_parameter(F.lit(200), F.lit(10), status, F.when(k == 3, 9).when(k == 4, 0).otherwise(10)).alias("verdict")
    )


@query("select c_nationkey, cast(case when c_nationkey % 5 = 0 then null else ceil(count(*) / 3.0) end as integer) as ceiling from customer group by 1")
def page_ceilings(spark: SparkSession, sf: str) -> DataFrame:
    """The last page that returns rows, by doubling and halving: pages of three customers; some ignore the parameter."""
    nations = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for nation, n in zip(pdf["c_nationkey"], pdf["n"], strict=True):
                at = (lambda page: (200, 3)) if nation % 5 == 0 else (lambda page, n=n: (200, max(0, min(3, n - 3 * (page - 1)))))
                found.append(discovery.page_ceiling(at, 3))
            yield pdf.assign(ceiling=pd.array(found, "Int32"))[["c_nationkey", "ceiling"]]

    return nations.mapInPandas(probe, "c_nationkey long, ceiling int")


# ---- scalar functions

@query(
    f"select p_partkey, case when core <> '' then core else whole end as core from (select p_partkey, {sql_norm('t')} as whole, array_to_string(list_filter(string_split({sql_norm('t')}, ' '), lambda w: w not in ({', '.join(q(w) for w in vocab.TITLE_NOISE)})), ' ') as core from (select p_partkey, case when p_size % 9 = 0 then 'Remote (US)' else 'Remote ' || p_type || ', USA / ' || p_name end as t from part))"
)
def title_cores(spark: SparkSession, sf: str) -> DataFrame:
    """titles without words of arrangement, unless nothing else is left."""
    t = F.when(c("p_size") % 9 == 0, "Remote (US)").otherwise(F.concat(F.lit("Remote "), "p_type", F.lit(", USA / "), "p_name"))
    return table(spark, sf, "part").select("p_partkey", text.title_core(t).alias("core"))


@query("select p_partkey, replace(p_name, ' ', ' - ') || ' x-y' as place from part")
def unslugged_places(spark: SparkSession, sf: str) -> DataFrame:
    """words out of a path's segment."""
    return table(spark, sf, "part").select(
        "p_partkey", payloads.unslugged(F.concat(F.replace("p_name", F.lit(" "), F.lit("---")), F.lit("-x--y"))).alias("place")
    )


@query(
    "select p_partkey, case p_size % 4 when 0 then p_name when 1 then p_name || ', x' when 2 then 'a, ' || p_name else '' end as joined, case p_size % 3 when 0 then 'a' when 1 then 'b' end as first from part"
)
def text_or_lists(spark: SparkSession, sf: str) -> DataFrame:
    """a field that is text or a list, and the first that says something."""
    k = c("p_size") % 4
    raw = F.when(k == 0, c("p_name")).when(
        k == 1, F.to_json(F.array("p_name", F.lit(""), F.lit("x")))
    ).when(k == 2, F.to_json(F.array(F.lit("a"), c("p_name")))).otherwise("[]")
    return table(spark, sf, "part").select(
        "p_partkey", payloads.joined(raw).alias("joined"),
        F.nullif(payloads.first_of(chosen("a", "", None), chosen("x", "b", "")), F.lit("")).alias("first")
    )


STRIPPED = {
    "Oslo (Remote)": "Oslo", "Remote - Oslo, [hybrid]": "Oslo", "(( ))": "", "Remoteville": "Remoteville", "On-site / Bergen |": "Bergen",
    "work from home": ""
}


@query(f"select p_partkey, {sql_chosen(*STRIPPED.values())} as place from part")
def stripped_places(spark: SparkSession, sf: str) -> DataFrame:
    """places without words of arrangement."""
    return table(spark, sf, "part").select("p_partkey", text.strip_arrangement(chosen(*STRIPPED)).alias("place"))


KINDS = {"Fully-Remote": "remote", "HYBRID": "hybrid", "On-Site": "onsite", "no remote": "onsite", "moon": None, "": None}


@query(
    f"select p_partkey, {sql_chosen(*KINDS.values())} as remote_type, {sql_chosen('US', 'GB', None, 'KR', 'XX')} as country, {sql_chosen('TX', 'DC', None, 'LA')} as state from part"
)
def closed_vocabularies(spark: SparkSession, sf: str) -> DataFrame:
    """Arrangement, country and state by closed lists."""
    return table(spark, sf, "part").select(
        "p_partkey", vocab.remote_type(chosen(*KINDS)).alias("remote_type"),
        vocab.country_code(chosen("U.S.", " uk", "Narnia", "Korea, Republic of", "xx")).alias("country"),
        vocab.us_state_code(chosen("Texas", "dc", "Narnia", " la ")).alias("state")
    )


ISO = {
    "Germany": "DE", "Republic of Korea": "KR", "Congo, The Democratic Republic of the": "CD", "The Federal Republic of Germany": "DE",
    "Bosnia and Herzegovina": "BA", "Saint Lucia": "LC", "Kingdom of Denmark": "DK", "USA": "US", "Côte d'Ivoire": "CI", "Narnia": None,
    "US": None, "Democratic Socialist Republic of Sri Lanka": "LK", "Hong Kong Special Administrative Region of China": "HK", "Lebanese Republic": "LB",
    "United States Minor Outlying Islands": "UM", "Eastern Republic of Uruguay": "UY"
}


@query(f"select p_partkey, {sql_chosen(*ISO.values())} as code from part")
def iso_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Names of vendors' country fields, short, inverted and official."""
    return table(spark, sf, "part").select("p_partkey", vocab.iso_code(chosen(*ISO)).alias("code"))


SCOPES = {  # what a vendor sends: areas, regions, raw
    None: (None, None, None), "  ": (None, None, None), "[]": ("", None, None), '["", null]': (None, None, None), '["Germany", "France"]': ("DE,FR", None, "Germany, France"), '["Anywhere", "World-wide"]': ("", None, "Anywhere, World-wide"),
    "Worldwide": ("", None, "Worldwide"), "Anywhere in the US": (None, None, "Anywhere in the US"), "North America, Canada": ("CA", "NORTH AMERICA", "North America, Canada"), "US-TX, us, CA": ("US,US-TX", None, "US-TX, us, CA"), "Micronesia, Federated States of": ("FM", None, "Micronesia, Federated States of"), "Narnia": (None, None, "Narnia"),
}


@query(
    f"select p_partkey, {
        ', '.join(f'{sql_chosen(*(v[i] for v in SCOPES.values()))} as {n}' for i, n in enumerate(('areas', 'regions', 'raw')))
    } from part"
)
def stated_scopes(spark: SparkSession, sf: str) -> DataFrame:
    """Lists and texts of places where one may live; nothing, blank, an empty list and unknown names differ."""
    s = places.stated_scope(chosen(*SCOPES))
    return table(spark, sf, "part").select(
        "p_partkey", F.array_join(s["areas"], ",").alias("areas"), F.array_join(s["regions"], ",").alias("regions"), s["raw"].alias("raw")
    )


@query(
    "select p_partkey, cast(len(list_distinct(regexp_extract_all(replace(lower(place), 'new mexico', ''), '\\b(germany|france|mexico|japan)\\b'))) as integer) as countries from (select p_partkey, " + sql_chosen(
        "Germany and France", "Germany, GERMANY", "Oslo", "New Mexico", "Japan; Mexico; france"
    ) + " as place from part)"
)
def countries_named(spark: SparkSession, sf: str) -> DataFrame:
    """How many different countries a text names."""
    return table(spark, sf, "part").select(
        "p_partkey",
        F.size(
            places.countries_in(F.lower(chosen("Germany and France", "Germany, GERMANY", "Oslo", "New Mexico", "Japan; Mexico; france")))
        ).alias("countries")
    )


@query(
    "select page_id, case page_id % 4 when 0 then 'https://boards.greenhouse.io/co/jobs/' || page_id when 1 then url when 2 then 'https://www.linkedin.com/x' else 'fallback' end as best from pages"
)
def best_links(spark: SparkSession, sf: str) -> DataFrame:
    """The employer's own link, else one that isn't an aggregator's, else any."""
    k, agg = c("page_id") % 4, F.lit("https://www.linkedin.com/x")
    links = F.when(
        k == 0, F.array(agg, c("url"), F.concat(F.lit("https://boards.greenhouse.io/co/jobs/"), c("page_id").cast("string")))
    ).when(k == 1, F.array(F.lit(""), agg, c("url"))).when(k == 2, F.array(agg, F.lit("https://uk.indeed.com/y")))
    return table(spark, sf, "pages").select("page_id", urls.best_link(links, F.lit("Zzz"), F.lit("fallback")).alias("best"))


@query(
    "select p_partkey, case p_size % 4 when 0 then format('${:,}–${:,}', p_size * 1000, p_size * 2000) when 1 then format('${:,}', p_size * 1000) when 2 then format('${:,}', p_size * 1000) else '' end as range_text from part"
)
def range_texts(spark: SparkSession, sf: str) -> DataFrame:
    """ranges of pay for people; zero is no figure."""
    k, one = c("p_size") % 4, c("p_size") * 1000
    lo, hi = F.when(k == 3, 0).when(k != 2, one), F.when(k == 0, one * 2).when(k == 1, one).when(k == 2, one).otherwise(0)
    return table(spark, sf, "part").select("p_partkey", salary.range_text(lo, hi).alias("range_text"))


@query(
    "select p_partkey, repeat('█', cast(round_even(p_size / 50.0 * 5, 0) as integer)) || repeat('░', 5 - cast(round_even(p_size / 50.0 * 5, 0) as integer)) as bar, case when length(p_name) > 8 then left(p_name, 8) || '…[truncated, ' || length(p_name) || ' chars total]' else p_name end as short, 'https://x.example/a?b=2&page=' || p_size || '#top' as url from part"
)
def report_texts(spark: SparkSession, sf: str) -> DataFrame:
    """bars, cut texts, a parameter in a URL."""
    url = F.lit("https://x.example/a?page=1&b=2&page=9#top")
    return table(spark, sf, "part").select(
        "p_partkey", catalog.bar(c("p_size") / 50).alias("bar"), catalog.truncated(c("p_name"), 8).alias("short"),
        catalog.with_param(url, "page", c("p_size")).alias("url")
    )


@query(
    f"select o_orderkey, case o_orderkey % 5 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then '2025-07-08' when 2 then strftime(o_orderdate, '%Y-%m-%d') end as posted, case when o_orderkey % 5 < 3 then 'stated' end as basis, strftime(date '{AS_OF}' - cast(case o_orderkey % 4 when 0 then 0 when 1 then 1 when 2 then 14 else 90 end as integer), '%Y-%m-%d') as said_ago from orders"
)
def posted_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates by any of the ways in which they are sent, and phrases like three months ago."""
    k, on = c("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = F.when(k % 5 == 0, F.concat(on, F.lit("T10:00:00Z"))).when(k % 5 == 1, "1752000000000").when(k % 5 == 2, on).when(k % 5 == 3, "soon")
    p = payloads.posted(raw)
    phrase = F.element_at(
        F.array(F.lit("Posted Today"), F.lit("posted yesterday"), F.lit("Posted 2 Weeks Ago"), F.lit("Posted 3+ months ago")),
        (k % 4 + 1).cast("int")
    )
    return table(spark, sf, "orders").select(
        "o_orderkey", p["posted"].alias("posted"), p["posted_basis"].alias("basis"), dates.relative_date(phrase, day()).alias("said_ago")
    )


@query(
    "select o_orderkey, case o_orderkey % 6 when 4 then null when 5 then null else strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') end as at from orders"
)
def lenient_times(spark: SparkSession, sf: str) -> DataFrame:
    """Epoch seconds and milliseconds, ISO, mail dates; else null."""
    k, t = c("o_orderkey") % 6, c("o_orderdate").cast("timestamp")
    epoch = F.unix_timestamp(t)
    raw = F.when(k == 0, epoch.cast("string")).when(k == 1, (epoch * 1000).cast("string")).when(k == 2, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(
        k == 3, F.concat(F.date_format(t, "EEE, "), F.date_format(t, "d MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    ).when(k == 4, "last week")
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(catalog.lenient_time(raw), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("""select p_partkey, cast(case when p_size % 4 <> 0 then p_retailprice end as double) as salary_min, cast(case when p_size % 5 = 0 then p_retailprice * 2 when p_size % 4 <> 0 then p_retailprice end as double) as salary_max, case when p_size % 4 <> 0 or p_size % 5 = 0 then 'USD' end as salary_currency,
  case when p_size % 4 <> 0 or p_size % 5 = 0 then case p_size % 3 when 0 then 'year' when 1 then 'hour' end end as salary_period, case when p_size % 4 <> 0 or p_size % 5 = 0 then 'stated' end as salary_basis from part""")
def salaries(spark: SparkSession, sf: str) -> DataFrame:
    """Zero is no salary, the greatest defaults to the least, a period is never guessed, nothing is said without a figure."""
    lo = F.when(c("p_size") % 4 == 0, 0.0).otherwise(c("p_retailprice"))
    per = F.when(c("p_size") % 3 == 0, "Per Year").when(c("p_size") % 3 == 1, "hourly").otherwise("fortnight")
    s = salary.salary(lo, F.when(c("p_size") % 5 == 0, c("p_retailprice") * 2), F.lit("usd"), per)
    return table(spark, sf, "part").select(
        "p_partkey", *(s[n].alias(n) for n in ("salary_min", "salary_max", "salary_currency", "salary_period", "salary_basis"))
    )


PAY = {
    "Comp: $120k-$150k": "$120k-$150k", "Rate $100-150/hr": "$100-150", "raised $20-40M": "", "just $20-40": "",
    "$90,000 to $110,000": "$90,000 to $110,000", "": ""
}
PARSED = {
    "120K–150K a year": ("120000", "150000", "year"), "$50 an hour": ("50", "50", "hour"),
    "1.5M to 1M per year": ("1000000", "1500000", "year"), "120K–150K": (None, None, None), None: (None, None, None)
}


@query(
    f"select p_partkey, {sql_chosen(*PAY.values())} as pay, " + ", ".join(
        f"cast({sql_chosen(*(v[i] for v in PARSED.values()))} as double) as {n}" for i, n in enumerate(("low", "high"))
    ) + f", {sql_chosen(*(v[2] for v in PARSED.values()))} as period from part"
)
def pay_in_text(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges of pay in prose, and parsed with their period."""
    s = salary.parsed(chosen(*PARSED))
    return table(spark, sf, "part").select(
        "p_partkey", payloads.money(chosen(*PAY)).alias("pay"), s["salary_min"].alias("low"), s["salary_max"].alias("high"),
        s["salary_period"].alias("period")
    )


@query("select event_id, json_extract_string(props, '$.k') as k, 'v' || (event_id % 3) as deep from events")
def props_json(spark: SparkSession, sf: str) -> DataFrame:
    """Dotted paths into records; a list stands for its first element."""
    nested = F.concat(F.lit('{"a":[{"b":"v'), (c("event_id") % 3).cast("string"), F.lit('"},{"b":"x"}]}'))
    return table(spark, sf, "events").select("event_id", catalog.dig(c("props"), "k").alias("k"), catalog.dig(nested, "a.b").alias("deep"))


@query(
    "select p_partkey, case p_size % 3 when 0 then 'jobTitle' when 1 then 'name' end as title, case when p_size % 2 = 0 then 'companyName' end as company, 'description' as body, array_to_string(list_sort(list_filter([case when p_size % 3 = 2 then 'titel' end, 'zz', case when p_size % 2 = 1 then 'org' end, case when p_size % 3 = 0 then 'name' end], lambda x: x is not null)), ',') as unmapped from part"
)
def mapped_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Which of a record's keys hold the canonical fields, as far as names prove it."""
    k = c("p_size")
    raw = F.concat(
        F.lit('{"zz":1,'), F.when(k % 3 == 0, '"name":"n","jobTitle":"t",').when(k % 3 == 1, '"name":"t",').otherwise('"titel":"t",'),
        F.when(k % 2 == 0, '"companyName":"c",').otherwise('"org":"c",'), F.lit('"description":"d"}')
    )
    m = catalog.mapped_fields(raw)
    return table(spark, sf, "part").select(
        "p_partkey", m["title"].alias("title"), m["company"].alias("company"), m["body"].alias("body"),
        F.array_join(catalog.unmapped_keys(raw), ",").alias("unmapped")
    )


@query("""select n_name as source, 'query:' || chr(10) || '  title_search: ' || case when n_nationkey % 2 = 0 then 'true' else 'unknown' end || chr(10) || '  param_validation: unknown' || chr(10) || 'limits:' || chr(10) || '  page_size: 20' || chr(10) || '  max_page: ' || case when n_nationkey % 3 = 0 then 'unknown' else cast(n_nationkey as varchar) end || chr(10)
  || '  reachable_per_query: ' || case when n_nationkey % 3 = 0 then 'unknown' else cast(n_nationkey * 20 as varchar) end || chr(10) || '  rate_limit: unknown' || chr(10) || 'freshness:' || chr(10) || '  median_age_days: 7' || chr(10) || '  pct_within_100d: 0.6  # ███░░' || chr(10) || '  date_sorted: unknown' || chr(10) || '  measured_at: 2001-01-01' as report from nation""")
def probe_reports(spark: SparkSession, sf: str) -> DataFrame:
    """What a probe measured, as lines of a profile."""
    n = c("n_nationkey")
    rows = table(spark, sf, "nation").select(
        c("n_name").alias("source"), F.when(n % 2 == 0, "true").alias("title_search"), F.lit(20).alias("page_size"),
        F.when(n % 3 != 0, n).alias("max_page"), F.lit(7).alias("median_age_days"), F.lit(0.6).cast("double").alias("pct_within_100d"),
        F.lit("2001-01-01").alias("measured_at")
    )
    return catalog.frontmatter(rows)


@query(
    "select n_name as name, case when n_nationkey % 4 = 0 then 'failed: ValueError' else 'ok' end as status, case when n_nationkey % 4 <> 0 then 'probed ' || n_nationkey end as report from nation"
)
def probes_in_turn(spark: SparkSession, sf: str) -> DataFrame:
    """Targets one after another; one that fails doesn't stop the rest."""

    def probe(target: dict) -> str:
        if target["at"] % 4 == 0:
            raise ValueError("no answer")
        return f"probed {target['at']}"

    targets = table(spark, sf, "nation").select(c("n_nationkey").alias("at"), c("n_name").alias("name"))
    return catalog.probed_in_turn(targets, probe).select("name", "status", "report")


# ---- records

COERCED = {  # location: city, state, country, places
    "Waco, TX; Paris, France": ("Waco", "TX", "US", 2), "Paris, France (Remote)": ("Paris", None, "FR", 1), "Remote": (None, None, None, 1), "": (None, None, None, None), "Toronto, ON, CA": ("Toronto", None, "CA", 1),
}


@query("select p_partkey, " + ", ".join(f"{sql_chosen(*(v[i] for v in COERCED.values()))} as {n}" for i, n in enumerate(("city", "state", "country"))) + f", cast({sql_chosen(*(None if v[3] is None else str(v[3]) for v in COERCED.values()))} as integer) as places, {sql_chosen('Paris', None, None, None, None)} as second_city, "
       "case p_size % 3 when 0 then 'FULL_TIME' when 1 then 'OTHER' end as employment_type, case p_size % 3 when 0 then 'Full time' when 1 then 'odd' end as employment_type_raw, case when p_size % 2 = 0 then 'senior' end as seniority, case when p_size % 2 = 0 then 'title' end as seniority_basis, p_type as title_root, p_size % 4 < 2 as direct_apply from part")  # fmt: skip
def locations_array(spark: SparkSession, sf: str) -> DataFrame:
    """The record contract: places, title parts, employment, direct links."""
    k = c("p_size")
    rows = table(spark, sf, "part").select(
        "p_partkey", F.concat(F.when(k % 2 == 0, "Senior ").otherwise(""), c("p_type")).alias("title"), chosen(*COERCED).alias("location"),
        chosen("Full time", "odd", "").alias("employment_type"), F.when(k % 4 < 2, "lever").otherwise("hn").alias("source"),
        F.lit("co").alias("company"), F.lit("u").alias("url")
    )
    out = coerce.coerced(rows, "t")
    return out.select(
        "p_partkey", "city", "state", "country", F.when(c("locations").isNotNull(), F.size("locations")).alias("places"),
        F.get("locations", F.lit(1))["city"].alias("second_city"), "employment_type", "employment_type_raw", "seniority", "seniority_basis",
        "title_root", "direct_apply"
    )


ARRANGED = {  # location: type, basis, areas, regions
    "Remote - Brazil": ("remote", "location", "BR", None), "Oslo": (None, None, None, None), "Hybrid - EMEA": ("hybrid", "location", None, "EMEA"), "Worldwide": (None, None, "", None), "Remote": ("remote", "location", None, None),
}


@query(
    "select p_partkey, " + ", ".join(
        f"case when p_size % 7 = 0 and {i} < 2 then {q(v)} else {sql_chosen(*(x[i] for x in ARRANGED.values()))} end as {n}" for i,
        (n, v) in enumerate((("remote_type", "onsite"), ("remote_basis", "stated"), ("areas", ""), ("regions", "")))
    ) + f", {sql_chosen(*ARRANGED)} as raw from part"
)
def arrangements(spark: SparkSession, sf: str) -> DataFrame:
    """Arrangement and boundary from the posting's own text where the source stated none."""
    stated = c("p_size") % 7 == 0
    rows = table(spark, sf, "part").select(
        "p_partkey", c("p_name").alias("title"), chosen(*ARRANGED).alias("location"), F.lit("We build.").alias("text"),
        F.when(stated, "onsite").alias("remote_type"), F.when(stated, "stated").alias("remote_basis")
    )
    out = coerce.with_arrangement(coerce.coerced(rows, "t"))
    return out.select(
        "p_partkey", "remote_type", "remote_basis", F.array_join("remote_areas", ",").alias("areas"),
        F.array_join("remote_regions", ",").alias("regions"), c("remote_scope_raw").alias("raw")
    )


@query(f"with {VIEW} select seq, title, company, null::varchar as city, 'null' as salary_min, true as nulls_stay, 'a,b' as sources from posting")
def nested_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records as lines of JSON; nulls stay."""
    rows = coerce.coerced(posting(spark, sf), "t").withColumns(
        {"id": c("seq").cast("string"), "dedup_key": F.lit("k"), "score": F.lit(1), "signals": F.lit(""), "sources": F.array(F.lit("b"), F.lit("a"))}
    )
    v = emit.ndjson(rows)
    get = lambda p: F.get_json_object("value", p)
    return v.select(
        get("$.id").cast("long").alias("seq"), get("$.title.raw").alias("title"), get("$.company").alias("company"),
        get("$.location.city").alias("city"), F.regexp_extract("value", '"salary":\\{"raw":null,"min":(null)', 1).alias("salary_min"),
        c("value").contains('"signals":null').alias("nulls_stay"),
        F.array_join(F.from_json(get("$.sources"), "array<string>"), ",").alias("sources")
    )


# ---- store, discovery, second opinion, streams

@query(
    "select c_custkey, case when c_custkey % 7 = 0 or c_custkey < 10 then 'applied' when c_custkey % 7 = 1 then 'interviewing' else 'new' end as status, 3 as version from customer"
)
def versioned_store(spark: SparkSession, sf: str) -> DataFrame:
    """ST5, K01: changes of the versioned store; the second of two with one mark does nothing."""
    table_of = versions.Versions(spark, scratch(spark, "store"), upserts.STORE)
    rows = _customers(spark, sf)
    table_of.change(lambda _: rows, mark=("load", 0))
    table_of.change(lambda _: rows.limit(0), mark=("load", 0))
    for low, high in ((0, 5), (5, 10)):
        table_of.change(
            lambda now, low=low, high=high: now.withColumn(
                "status",
                F.when(F.regexp_extract("company", "#0*([0-9]+)$", 1).cast("long").between(low, high - 1), "applied").otherwise(c("status"))
            )
        )
    return table_of.read().select(
        F.regexp_extract("company", "#0*([0-9]+)$", 1).cast("long").alias("c_custkey"), "status"
    ).withColumn("version", F.lit(table_of.state()[0]))


@query("select true as kept, '1 sources failed: lever (OSError)' as why, (select count(*) from nation) as rows")
def failure_guard(spark: SparkSession, sf: str) -> DataFrame:
    """ST6: a run without rows whose sources failed writes nothing."""
    rows, why = table(spark, sf, "nation"), ""
    try:
        versions.guarded(rows.limit(0), [("lever", "OSError")])
    except versions.NothingHarvested as e:
        why = str(e)
    return spark.createDataFrame(
        [(versions.guarded(rows.limit(0), []).isEmpty(), why, versions.guarded(rows, [("a", "b")]).count())],
        "kept boolean, why string, rows long"
    )


def _ask(ats: str, slug: str) -> tuple[int | None, int, str | None]:
    """A service that knows suppliers whose number is even, and tells another owner for every sixth."""
    n = int("".join(x for x in slug if x.isdigit()) or 0)
    return (200, n % 5 + 1, "Someone Else" if n % 6 == 0 else f"Supplier#{n:09d}") if n % 2 == 0 else (404, 0, None)


@query(
    "select s_name as name, 'greenhouse' as ats, lower(replace(s_name, '#', v)) as slug, cast(s_suppkey % 5 + 1 as integer) as roles from supplier cross join (values (''), ('-')) as t(v) where s_suppkey % 2 = 0 and s_suppkey % 6 <> 0 union all select s_name, 'lever', lower(replace(s_name, '#', v)), cast(s_suppkey % 5 + 1 as integer) from supplier cross join (values (''), ('-')) as t(v) where s_suppkey % 2 = 0 and not (s_suppkey = 2 and v = '')"
)
def guessed_boards(spark: SparkSession, sf: str) -> DataFrame:
    """Boards guessed from names that are alive and the company's own."""
    names = table(spark, sf, "supplier").select(c("s_suppkey").alias("seq"), c("s_name").alias("name"))
    known = spark.createDataFrame([("lever/supplier000000002",)], "entry_key string")
    return discovery.from_names(names, ("greenhouse", "lever"), known, _ask).select("name", "ats", "slug", "roles")


@query(
    """with boards as (select distinct page_id % 7 as n from pages where page_id % 5 = 1) select 'lever' as ats, 'co' || n as slug, cast(n % 5 + 1 as integer) as roles from boards where n % 2 = 0 and n <> 4"""
)
def discovered_boards(spark: SparkSession, sf: str) -> DataFrame:
    """Mined boards that nobody knows and that are alive."""
    lines = table(spark, sf, "pages").where("page_id % 5 = 1").select(F.to_json(F.struct(F.expr(BOARD_URLS).alias("url"))).alias("value"))
    return discovery.discovered(
        discovery.mined(lines), spark.createDataFrame([("lever/co4",)], "entry_key string"), _ask, ("lever",)
    ).select("ats", "slug", "roles")


@query(
    """with boards as (select distinct page_id % 7 as n from pages where page_id % 5 = 1) select 'co' || n as slug from boards where n % 2 = 0 and n <> 0 order by n limit 2"""
)
def seeded_boards(spark: SparkSession, sf: str) -> DataFrame:
    """The first mined boards, in order, that answer."""
    lines = table(spark, sf, "pages").where("page_id % 5 = 1").select(F.to_json(F.struct(F.expr(BOARD_URLS).alias("url"))).alias("value"))
    return discovery.seeded_alive(
        discovery.mined(lines), spark.createDataFrame([("lever/co0",)], "entry_key string"), 2, _ask, ("lever",)
    ).select("slug")


@query(f"""with {VIEW}, r as (select seq, 'co' || (seq % 40) as company, 'https://jobs.lever.co/b' || (seq % 60) || '/x' as url, title from posting), s as (select * from r where not ({' or '.join(sql_word(k, 'lower(title)') for k in CFG.exclude_titles)}) and ({' or '.join(sql_word(k, 'lower(title)') for k in CFG.title_signal)}) and company not in ('co1', 'co2')),
  first as (select * from (select *, row_number() over (partition by company order by seq) as rn from s) where rn = 1), e as (select 'lever/b' || (seq % 60) as entry_key, seq, row_number() over (partition by seq % 60 order by seq) as rn from first) select entry_key, seq from e where rn = 1 and entry_key <> 'lever/b3' order by seq limit 12""")
def funnel_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Boards worth a probe: relevant postings of companies that nobody knows; a probe budget."""
    rows = posting(spark, sf).withColumns(
        {
            "company": F.concat(F.lit("co"), (c("seq") % 40).cast("string")),
            "url": F.concat(F.lit("https://jobs.lever.co/b"), (c("seq") % 60).cast("string"), F.lit("/x"))
        }
    )
    known = spark.createDataFrame([("CO1",), ("co-2 ",), ("co2",)], "name string")
    return discovery.funnel(rows, known, spark.createDataFrame([("lever/b3",)], "entry_key string"), CFG, 12).select("entry_key", "seq")


@query(
    "select dedup_key, cast(90 - pos as varchar) as llm_score, 'n' || pos as llm_note from (select c_name as dedup_key, row_number() over (order by case when c_custkey % 5 = 0 then c_custkey % 100 else c_custkey % 50 end desc, c_name) - 1 as pos from customer where c_custkey % 7 <> 0 and c_custkey % 50 >= 5) where pos < 4 and pos <> 2"
)
def second_opinion(spark: SparkSession, sf: str) -> DataFrame:
    """Notes of a judge on the best rows; items that don't fit are skipped."""
    reply = 'Here: [{"id": 0, "fit": 90, "note": "n0"}, {"id": 1, "fit": 89, "note": "n1"}, {"fit": 1}, {"id": 3, "fit": "87", "note": "n3"}, {"id": 99, "fit": 5}] bye'
    return rerank.rerank(spark, store.surface(_customers(spark, sf), CFG), CFG, lambda prompt: reply if "Values" in prompt else "", 4)


@query(
    "select 'k' || o_custkey as dedup_key, cast(max(cast(floor(o_totalprice / 10000) as integer)) as varchar) as score, 2 as batches from orders where o_orderkey % 2 = 1 group by 1, 3"
)
def streamed_store(spark: SparkSession, sf: str) -> DataFrame:
    """Landed files, one at a time, upserted into the versioned store: what the second run lacks goes."""
    landing, base = scratch(spark, "landing"), scratch(spark, "store")
    schema = "dedup_key string, title string, url string, score int, posted string"
    for part in (0, 1):
        rows = table(spark, sf, "orders").where(c("o_orderkey") % 2 == part).groupBy(
            F.concat(F.lit("k"), c("o_custkey").cast("string")).alias("dedup_key")
        ).agg(F.max(F.floor(c("o_totalprice") / 10000)).cast("int").alias("score"))
        rows.select(
            "dedup_key", F.lit("t").alias("title"), c("dedup_key").alias("url"), "score", F.lit(None).cast("string").alias("posted")
        ).coalesce(1).write.mode("append").parquet(landing)
    run = upserts.start_upserts(spark, landing, schema, base, scratch(spark, "checkpoint"), AS_OF, files_per_batch=1)
    run.awaitTermination()
    table_of = versions.Versions(spark, base, upserts.STORE)
    return table_of.read().select("dedup_key", "score").withColumn("batches", F.lit(table_of.state()[0]))


@query("select distinct user_id, event_type from events")
def repeats_suppressed(spark: SparkSession, sf: str) -> DataFrame:
    """Repeats of a key within the watermark, as a stream."""
    out, folder = scratch(spark, "firsts"), os.path.dirname(f"{sf}/events.parquet")
    rows = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(folder).withColumn("ts", c("ts").cast("timestamp")).withColumn("key", F.concat_ws("/", "user_id", "event_type"))
    run = upserts.first_in_stream(rows, "key", "ts", "3650 days").select("user_id", "event_type").writeStream.option("checkpointLocation", scratch(spark, "checkpoint")).trigger(availableNow=True).start(out, format="parquet")
    run.awaitTermination()
    return spark.read.parquet(out)
