"""Structured Streaming over landed rows: upserts into a versioned store, windowed counts, sessions."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from gleanworks.operators import linkage, store, versions


STORE = ", ".join(f"{c} string" for c in store.COLUMNS)


def upsert_batch(spark: SparkSession, base: str, today: str, name: str = "stream") -> Callable[[DataFrame, int], None]:
    """A foreachBatch body: each batch is one change of the versioned store; a batch that is replayed changes nothing."""
    table = versions.Versions(spark, base, STORE)

    def write(batch: DataFrame, number: int) -> None:
        run = store.store_rows(batch, F.lit(today).cast("date"))
        table.change(lambda before: store.upsert(before, run).drop("is_new"), mark=(name, number))

    return write


def start_upserts(
    spark: SparkSession, landing: str, schema: str, base: str, checkpoint: str, today: str, files_per_batch: int = 24
) -> StreamingQuery:
    """Read a landing folder, a bounded number of files at a time."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    return rows.writeStream.foreachBatch(upsert_batch(spark, base, today)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


SLIM = ("dedup_key", "_blk", "_nt", "_core", "_levels", "_quals", "_words", "_ats", "_slug", "_ref", "_pref", "_len", "score", "source", "seq")
LINKS = "dedup_key string, block string, seq long, sources array<string>, fresh boolean"


#: A state holds the blocks of one of so many shares: most companies have few postings, and each state costs its call.
SHARES = 16_384


def linked_stream(rows: DataFrame, threshold: float = 90, floor: float = 82, shares: int = SHARES) -> DataFrame:
    """Incremental linkage: a stream's postings (with seq) against all that came before, block by block.

    A block (and level) keeps its survivors, as slim rows without texts; a posting joins the first that it matches, or
    becomes one. Rows out are the survivors that a batch touched, with their sources so far. Blocks are dealt to ``shares``
    states by hash, packed, of which only touched blocks are read; so the number of blocks doesn't set the number of calls.
    ``shares`` stays as it is for the life of a checkpoint; many more companies than millions want more of them."""
    slim = linkage.with_keys(rows).withColumn("_levels", F.array_join("_levels", ",")).withColumn("_quals", F.array_join("_quals", ",")).withColumn("_words", F.array_join("_words", ","))
    keyed = slim.select(
        *(F.col(c) for c in SLIM), F.when(F.col("_blk") == "", F.concat(F.lit("="), "dedup_key")).otherwise(F.col("_blk")).alias("_key")
    ).withColumn("_share", F.pmod(F.xxhash64("_key", "_levels"), F.lit(shares)))

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(zlib.decompress(state.get[0])) if state.exists else {}
        folds: dict[str, linkage.Fold] = {}
        before: set[str] = set()
        split = lambda x: [w for w in x.split(",") if w]
        touched: dict[str, dict] = {}
        for r in linkage.records([pd.concat(list(batches)).sort_values("seq")]):
            block = json.dumps([r.pop("_key"), r["_levels"]])
            del r["_share"]
            if block not in folds:
                kept = [dict(q, _levels=q["_levels"].split(",")) for q in json.loads(held.get(block, "[]"))]
                before |= {q["dedup_key"] for q in kept}
                folds[block] = linkage.Fold(threshold, floor, kept)
            row = {
                **r, "_levels": r["_levels"].split(","), "_quals": split(r["_quals"]), "_words": split(r["_words"]),
                "sources": [r["source"]] if r["source"] else []
            }
            row = {k: (None if isinstance(v, float) and v != v else v) for k, v in row.items()}
            hit = folds[block].join(row)
            touched[hit["dedup_key"]] = hit
        held |= {block: json.dumps([{**q, "_levels": ",".join(q["_levels"])} for q in f.kept.values()]) for block, f in folds.items()}
        state.update((zlib.compress(json.dumps(held).encode(), 1),))
        yield pd.DataFrame(
            [(k["dedup_key"], k["_blk"], k["seq"], k["sources"], k["dedup_key"] not in before) for k in touched.values()],
            columns=["dedup_key", "block", "seq", "sources", "fresh"]
        )

    return keyed.groupBy("_share").applyInPandasWithState(fold, LINKS, "survivors binary", "update", "NoTimeout")


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Events and their value per window and type; with a watermark where the input is a stream."""
    if late:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("window_start"), "event_type", "n", "total"
    )


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of a user: events no further apart than the gap."""
    return events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    ).select("user_id", "first_ts", "last_ts", "n")


def first_in_stream(rows: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """Suppress repeats of a key that arrive within the watermark."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
