"""What to ask for, and when to stop: budgets, fan-outs, and the pages that a bounded walk keeps.

A landed walk is a frame of pages (board, page, rows, ...). Rules that would end a walk keep the same pages of it
that the walk itself would have fetched, so a re-read of a landing folder and a live walk agree. A board's pages
are few by the walk's own bound, so a window over them is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanworks.functions import urls


def budget(planned: Column, cap: Column, left: Column, reserve: Column) -> Column:
    """How many metered requests a run may spend; an unknown balance (null) leaves the cap alone to bound it."""
    spend = F.least(planned, F.greatest(cap, F.lit(0)))
    return F.when(left.isNull(), spend).otherwise(F.least(spend, F.greatest(left - F.greatest(reserve, F.lit(0)), F.lit(0))))


def fan_out(spark: SparkSession, queries: list[str], pages: int, categories: list[str] | None = None) -> DataFrame:
    """(at, query, category, page): every request of a fan-out, in the order in which it is made; three short lists."""
    one = spark.range(1).select(F.posexplode(F.array(*map(F.lit, queries)).cast("array<string>")).alias("q", "query"))
    both = one.select("*", F.posexplode_outer(F.array(*map(F.lit, categories or [None])).cast("array<string>")).alias("c", "category"))
    each = both.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))).alias("page")
    ) if pages > 0 else both.withColumn("page", F.lit(0)).limit(0)
    width = len(categories or [None])
    return each.select(
        ((F.col("q") * width + F.col("c")) * pages + F.col("page")).cast("long").alias("at"), "query", "category",
        F.col("page").cast("int").alias("page")
    )


def requests(queries: DataFrame, categories: DataFrame, pages: int) -> DataFrame:
    """fan_out for queries (q, query) and categories (c, category) that come as tables, each numbered from 0.

    Every query meets every category: that is what is asked for, and categories are a service's short list."""
    short = F.broadcast(categories.select("c", "category"))
    each = queries.select("q", "query").crossJoin(short).withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))))
    width = categories.agg(F.count("*").alias("_width"))
    each = each.crossJoin(F.broadcast(width))
    return each.select(
        ((F.col("q") * F.col("_width") + F.col("c")) * pages + F.col("page")).cast("long").alias("at"), "query", "category", F.col("page").cast("int").alias("page")
    )


def within_budget(requests: DataFrame, spend: int) -> DataFrame:
    """The requests that a budget pays for, the first ones first (the feature's own limit)."""
    return requests.orderBy("at").limit(max(0, spend))


def _until(pages: DataFrame, stop: Column, board: str, page: str) -> DataFrame:
    """Pages up to and including the first at which a walk stops."""
    before = Window.partitionBy(board).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    marked = pages.withColumn("_stop", F.coalesce(stop, F.lit(False)))
    return marked.withColumn("_done", F.coalesce(F.max("_stop").over(before), F.lit(False))).where(~F.col("_done")).drop("_stop", "_done")


def walked(
    pages: DataFrame, size: int, most: int, board: str = "slug", page: str = "page", rows: str = "rows", total: str | None = "total"
) -> DataFrame:
    """Pages of an offset walk: it ends with a short page, at the total that the first page told (later pages may
    say 0), or after most pages. A page that failed (rows null) ends it, too, and is dropped."""
    order = Window.partitionBy(board).orderBy(page)
    said = F.first(total).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) if total else F.lit(None).cast("long")
    at = F.row_number().over(order)
    rest = pages.withColumns({"_at": at, "_said": said})
    stop = F.col(rows).isNull() | (F.col(rows) < size) | (F.col("_said").isNotNull() & (F.col("_at") * size >= F.col("_said")))
    return _until(rest.where(F.col("_at") <= most), stop, board, page).where(F.col(rows).isNotNull()).drop("_at", "_said")


def fresh_pages(
    pages: DataFrame, oldest: int, most: int, board: str = "slug", page: str = "page", rows: str = "rows", age: str = "min_age"
) -> DataFrame:
    """Pages of a walk from new to old: it ends with the first whose youngest row is older than oldest, or is empty."""
    at = F.row_number().over(Window.partitionBy(board).orderBy(page))
    return _until(
        pages.withColumn("_at", at).where(F.col("_at") <= most).drop("_at"), (F.col(rows) == 0) | (F.col(age) > oldest), board, page
    ).where(F.col(rows) > 0)


def youngest(rows: DataFrame, age: Column, board: str = "slug", page: str = "page") -> DataFrame:
    """(board, page, rows, min_age): what the rule above asks of each page; rows without an age don't tell."""
    return rows.groupBy(board, page).agg(F.count("*").alias("rows"), F.min(age).alias("min_age"))


def threads(hits: DataFrame, newest: int, order: str = "created") -> DataFrame:
    """The newest threads that ask who is hiring (the feature's own limit)."""
    return hits.where(F.lower(F.coalesce("title", F.lit(""))).contains("who is hiring")).orderBy(F.desc(order)).limit(newest)


def same_host(base: Column, following: Column) -> Column:
    """Whether a next link stays on the host that gave it; an empty one leads nowhere."""
    return (F.coalesce(following, F.lit("")) != "") & (urls.host(following) == urls.host(base))


def followed(pages: DataFrame, most: int = 10, board: str = "slug", page: str = "page", url: str = "url", following: str = "next") -> DataFrame:
    """Pages of a walk along next links: it ends where there is none, or one that leaves the host."""
    at = F.row_number().over(Window.partitionBy(board).orderBy(page))
    return _until(pages.withColumn("_at", at).where(F.col("_at") <= most).drop("_at"), ~same_host(F.col(url), F.col(following)), board, page)
