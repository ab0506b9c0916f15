"""Shared pieces of the training-data operators: words, hashes, durable intermediate tables, components.

Words are the runs of bytes outside ``[\\x20\\x09-\\x0D]``: ``bytes.split()`` cuts at exactly those
six ASCII characters, and ``bytes.lower()`` lower-cases exactly A-Z, so both contracts cost one C call.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a word is, for SQL expressions.
WORD = r"[^\x20\x09-\x0D]+"
MIX = np.uint64(0x9E3779B97F4A7C15)


#: Rows and bytes of an Arrow batch at most: whole texts go through Python workers, and each batch is held twice by either side.
BATCH_ROWS = 2_000
BATCH_BYTES = 1_000_000


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker and its executor hold of the worker's input at once; a smaller plain number stays."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key) or ""
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset, a temporary folder of this machine serves a local master alone; on a cluster each
    executor would write to its own disk, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.conf.get("spark.master", "") or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='gleanworks-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/gleanworks/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, and survives lost executors."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


#: What to call before another operator's work starts in a worker process: it lets go of what was kept between tasks.
RELEASE: list[Callable[[], None]] = []


def release_kept() -> None:
    """Free what operators keep in this process between their tasks, and give the memory back."""
    for clear in RELEASE:
        clear()
    give_back()


def give_back() -> None:
    """Return free memory of this process, Python's and Arrow's, to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, after which its process gives free memory back: executors keep idle worker processes, more than run at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()

    return run


class WordHashes(dict):
    """Word to 64-bit hash, each hashed once; emptied before it grows beyond its bound."""

    BOUND = 200_000

    def __init__(self) -> None:
        release_kept()

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def scramble(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k word hashes; the whole sequence as one window if it is shorter."""
    n = len(h)
    if not n:
        return h
    k = min(k, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = out * MIX + h[i : n - k + 1 + i]
    return scramble(out)


def shingles(text: bytes | None, cache: WordHashes, k: int = 5, lower: bool = True) -> np.ndarray:
    """The distinct hashed k-word shingles of a text, ascending."""
    words = (text.lower() if lower else text).split() if text else []
    return np.unique(windows(cache.of(words), k))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of an undirected link table: component is the smallest node reachable.

    A component's smallest node, and nodes without links, have no row: they are their own component.

    Alternating large-star and small-star steps (Kiveris et al. 2014): each is one shuffle over the
    edges, star-shaped groups end after two, and paths of length n after O(log n)-like many. Each step
    is a table in the shared folder; no node's neighbours are ever gathered (aggregates and joins only).
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = materialize(e, "links")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: every neighbour above u links to the least of u's neighbourhood
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every neighbour below u, and u, link to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = materialize(small, "links")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
        before = tuple(now)


#: A key that holds more than this part of the rows is sent to all tasks; there can't be more such keys.
HOT = 20_000


def looked_up(rows: DataFrame, table: DataFrame, key: str, weight: str, columns: list[str], hot: int = HOT) -> DataFrame:
    """rows with columns of table, which has each key of rows once and, as weight, how many rows hold it.

    Weights sum up to the number of rows, so less than ``hot`` keys have more than a hot-th of it: these are sent to all
    tasks, and no key that is left for the shuffled join binds a task. table is a stored one."""
    total = table.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    often = F.broadcast(table.where(F.col(weight) * hot > F.lit(total)).select(key, *columns, F.lit(True).alias("_often")))
    marked = rows.join(often, key, "left")
    rest = marked.where("_often is null").drop("_often", *columns).join(table.select(key, *columns), key)
    return marked.where("_often").drop("_often").unionByName(rest)
