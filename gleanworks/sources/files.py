"""Files: stores, watchlists, feeds, crawl indexes, profiles; a broken one is an error row or an empty frame."""

from __future__ import annotations

import html.entities
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanworks.functions import urls
from gleanworks.operators.store import COLUMNS

STORE = ", ".join(f"{c} string" for c in COLUMNS)
WATCHLIST = "name string, ats string, slug string, host string, site string, industry string, local boolean, frontier boolean"


def store_csv(spark: SparkSession, path: str) -> DataFrame:
    """A store's CSV, UTF-8 or UTF-16 with a mark; missing is empty. Quoted cells may hold line ends."""
    try:
        first = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 3).alias("b")).first()
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], STORE)
        raise
    mark = bytes(first.b) if first else b""
    encoding = "UTF-16" if mark[:2] in (b"\xff\xfe", b"\xfe\xff") else "UTF-8"
    if encoding == "UTF-8" and spark.read.format("binaryFile").load(path).where(~F.is_valid_utf8(F.col("content").cast("string"))).limit(1).count():
        raise UnreadableStore(f"{path}: not UTF-8 or UTF-16; save it again as CSV in UTF-8")
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).csv(path)
    # a mark before UTF-8 stands in front of the first name
    rows = rows.toDF(*(c.lstrip("﻿") for c in rows.columns))
    return rows.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in COLUMNS))


def watchlist_json(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """A watchlist, or an empty one and what is wrong with it."""
    try:
        with_companies = "companies" in spark.read.option("multiLine", True).json(path).columns
        if with_companies:
            return watchlist_companies(spark, path).drop("seq", "entry_key"), None
        rows = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(WATCHLIST).json(path)
        rows.limit(1).collect()
        return rows, None
    except Exception as e:  # noqa: BLE001
        return spark.createDataFrame([], WATCHLIST), f"{type(e).__name__}: watchlist can't be read"


def watchlist_companies(spark: SparkSession, path: str) -> DataFrame:
    """The companies of a watchlist document ({"companies": [...]}), numbered as they stand, with their entry_key; a
    document that doesn't parse has none."""
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(
        F.posexplode(
            F.from_json("value", f"companies ARRAY<STRUCT<{WATCHLIST.replace(' ', ':').replace(',:', ', ')}>>")["companies"]
        ).alias("seq", "c")
    )
    e = F.struct(F.col("c.ats").alias("ats"), F.col("c.slug").alias("slug"), F.col("c.host").alias("host"), F.col("c.site").alias("site"))
    return rows.select("seq", "c.*", urls.entry_key(e).alias("entry_key"))


def crawl_index(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Lines of a crawl index as text; lines that don't parse fall out when they are mined."""
    lines = spark.read.text(path)
    return lines.limit(limit) if limit else lines


def numeric_entities(c: Column) -> Column:
    """HTML's named entities as numbers, which XML knows too; XML's own five stay."""
    named = F.array_distinct(F.regexp_extract_all(c, F.lit("&([A-Za-z][A-Za-z0-9]*);"), F.lit(1)))
    known = F.filter(named, lambda n: F.array_contains(F.map_keys(_entities()), n))
    return F.aggregate(known, c, lambda text, n: F.replace(text, F.concat(F.lit("&"), n, F.lit(";")), _entities()[n]))


def _entities() -> Column:
    """Entity name to its numeric form, from the standard library's table."""
    xml = ("amp", "lt", "gt", "quot", "apos")
    table = {k: "".join(f"&#{ord(x)};" for x in v) for k, v in html.entities.html5.items() if not k.endswith(";") and k not in xml}
    table |= {
        k[:-1]: "".join(f"&#{ord(x)};" for x in v) for k,
        v in html.entities.html5.items() if k.endswith(";") and k[:-1] in html.entities.name2codepoint and k[:-1] not in xml
    }
    return F.create_map(*(F.lit(x) for pair in sorted(table.items()) for x in pair))


def feed_text(spark: SparkSession, path: str, row: str = "item") -> DataFrame:
    """Items of feeds whose text holds HTML entities: each document is mended before it is parsed, and may fail alone."""
    schema = "title STRING, link STRING, pubDate STRING, published STRING, updated STRING, description STRING, summary STRING, content STRING"
    whole = spark.read.text(path, wholetext=True).select(numeric_entities(F.col("value")).alias("value"))
    parts = whole.select(F.explode(F.regexp_extract_all("value", F.lit(f"(?s)(<{row}[ >].*?</{row}>)"), F.lit(1))).alias("x"))
    item = parts.select(F.from_xml("x", schema).alias("i"), F.regexp_extract("x", "<link[^>]*href=[\"']([^\"']*)", 1).alias("href"))
    pick = lambda *names: F.coalesce(*(F.nullif(F.col(f"i.{n}"), F.lit("")) for n in names), F.lit(""))
    return item.select(
        pick("title").alias("title"), F.coalesce(F.nullif("href", F.lit("")), pick("link")).alias("link"),
        pick("pubDate", "published", "updated").alias("published"), pick("description", "summary", "content").alias("body")
    )


def feed(spark: SparkSession, path: str, row: str = "item") -> DataFrame:
    """Items of an RSS or entries of an Atom feed: title, link, published, body."""
    raw = spark.read.format("xml").option("rowTag", row).option("inferSchema", False).load(path)
    pick = lambda *names: F.coalesce(*(F.col(f"`{n}`").cast("string") for n in names if n in raw.columns), F.lit(""))
    link = F.col("link._href") if "link" in raw.columns and dict(raw.dtypes)["link"].startswith("struct") else pick("link")
    return raw.select(
        pick("title").alias("title"), link.alias("link"), pick("pubDate", "published", "updated").alias("published"),
        pick("description", "summary", "content").alias("body")
    )


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """YAML frontmatter of profiles: (path, front, body), the front as text; parse it on the driver, profiles are few."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    front = F.regexp_extract("value", r"(?s)^---\n(.*?)\n---\n", 1)
    return raw.select("path", front.alias("front"), F.regexp_replace("value", r"(?s)^---\n.*?\n---\n", "").alias("body"))


def completeness(front: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Marks left to do, and required keys that a profile lacks."""
    missing = F.filter(
        F.array(*(F.lit(k) for k in required)),
        lambda k: ~F.coalesce(F.concat(F.lit("\n"), F.col("front")).contains(F.concat(F.lit("\n"), k, F.lit(":"))), F.lit(False))
    )
    return front.select(
        "path", (F.regexp_count("front", F.lit("TODO")) + F.regexp_count("body", F.lit("TODO"))).alias("todos"), missing.alias("missing")
    )


def drift(profiles_now: DataFrame, index: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Where an index row differs from its profile, and profiles without a row: (name, field, profile, indexed)."""
    pairs = profiles_now.alias("p").join(index.alias("i"), "name", "left")
    each = F.explode(
        F.array(
            *(
                F.struct(
                    F.lit(c).alias("field"), F.col(f"p.{c}").cast("string").alias("profile"),
                    F.col(f"i.{c}").cast("string").alias("indexed")
                ) for c in columns
            )
        )
    ).alias("x")
    return pairs.select("name", each).select("name", "x.*").where(~F.col("profile").eqNullSafe(F.col("indexed")))


def each_apart(readers: dict[str, Callable[[], DataFrame]], landing: str | None = None) -> tuple[dict[str, DataFrame], list[tuple[str, str]]]:
    """Frames of the readers that work, and (source, error) of those that don't: one doesn't stop the others.

    A frame may fail only when it is read. With a landing folder each is written there and read back, so all that
    can fail fails here, and once; without one it is read through to nowhere, and read again when it is used."""
    frames, errors = {}, []
    for name, read in readers.items():
        try:
            frame = read()
            if landing:
                frame.write.mode("overwrite").parquet(f"{landing}/{name}")
                frame = frame.sparkSession.read.schema(frame.schema).parquet(f"{landing}/{name}")
            else:
                frame.write.format("noop").mode("overwrite").save()
            frames[name] = frame
        except Exception as e:  # noqa: BLE001
            errors.append((name, type(e).__name__))
    return frames, errors


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


#: Rows of landed payloads.
LANDED = "raw string, slug string, company string, host string, site string, seq long"


def landed(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """A source's landed payloads: lines of JSON, each with the payload as text and the board it came from."""
    return spark.read.schema(LANDED).json(f"{folder}/{source}")


class UnreadableStore(Exception):
    """A store that is neither UTF-8 nor UTF-16."""
