"""Quality rules with cross-document line frequency (operator 10).

Lines are normalised (A-Z lower-cased, blanks collapsed) and hashed. Per host (``source``) the distinct
documents that hold a line are counted; lines in more than ``max(min_docs, share * documents of the
host)`` are boilerplate and are removed; a document that keeps fewer than ``left_words`` words, or less than
``left_share`` of its words, is depleted and rejected.

What counts as *distinct* documents: those of different sets of lines. Exact copies, and texts that differ in the order
or repetition of lines alone, count once, in the number of a line's documents as in the host's: a copied page is no
evidence that its lines are boilerplate. Every other document counts, pages of one template too, though they differ
in one line. ``near_copies`` (off) would count near-duplicates (linked as by operator 7) once, too: then an article that
a host repeats with small changes is left to the near-duplicate stage, but so are its template pages.

Defined results: null or empty text has no words, fails the base rules and is rejected; null source is a
host of its own; repeated rows each get their row; empty table, empty result; extra columns are ignored (with
texts they are kept, but for those named like a result, which the result replaces).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanworks.llm.common import WordHashes, as_bytes, looked_up, materialize, tidy, windows
from gleanworks.llm.jaccard import linked

#: Frequent lines up to this number are handed to all tasks (8 bytes each); beyond it they are joined.
BROADCAST_LINES = 1_000_000
SYMBOLS = b"#*$%&|<>"
OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_words_left long, n_lines_removed long"


def line_keys(text: bytes, host: bytes | None) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The lines; their words; their keys (0: no word). A key depends on the host and the normalised line."""
    lines = text.split(b"\n")
    split = [x.split() for x in lines]
    seed = 1 if host is None else xxhash.xxh3_64_intdigest(host)
    keys = np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(w).lower(), seed) | 1 if w else 0 for w in split), np.uint64, len(lines))
    return lines, np.fromiter(map(len, split), np.int64, len(lines)), keys


def line_set(keys: np.ndarray) -> int:
    """A digest of a document's set of lines (and so of its host)."""
    keys = np.unique(keys)
    return xxhash.xxh3_64_intdigest(keys[keys > 0].tobytes())


def _held_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(line, doc, host): doc is the digest of the whole set of lines."""
    schema = pa.schema([("line", pa.int64()), ("doc", pa.int64()), ("host", pa.int64())])
    for batch in batches:
        out: list[np.ndarray] = []
        for text, host in zip(as_bytes(batch.column("text")), as_bytes(batch.column("source")), strict=True):
            if not text:
                continue
            keys = np.unique(line_keys(text, host)[2])
            keys = keys[keys > 0]
            if not len(keys):
                continue
            at = np.full(len(keys), 1 if host is None else xxhash.xxh3_64_intdigest(host), np.uint64)
            out.append(np.stack([keys, np.full(len(keys), line_set(keys), np.uint64), at]))
        if out:
            rows = np.concatenate(out, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], schema=schema)


def frequent_lines(
    docs: DataFrame, min_docs: int = 20, share: float = 0.003, left_words: int = 25, left_share: float = 0.5, near_copies: bool = False
) -> DataFrame:
    """(line): keys of the lines that more distinct documents of their host hold than its limit allows."""
    rows = materialize(docs.select("text", "source").mapInArrow(tidy(_held_lines), "line long, doc long, host long").distinct(), "held-lines")
    # the limit is a share of what is counted: the host's distinct documents
    hosts = rows.select("doc", "host").distinct().groupBy("host").agg(F.count("*").alias("docs")).where(F.col("docs") > min_docs)
    hosts = materialize(hosts, "hosts")

    def beyond(held: DataFrame, what: str) -> DataFrame:
        counts = held.groupBy("line", "host").agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
        counts = looked_up(counts, hosts, "host", "docs", ["docs"])
        return materialize(counts.where(F.col("n") > F.greatest(F.lit(min_docs), F.lit(share) * F.col("docs"))).select("line"), what)

    often = beyond(rows, "often")
    if not near_copies:
        return often
    wide, known = _with_known(docs.select("doc_id", "text", "source"), often)

    def depleted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column("_lines").to_pylist() if known is None else [None] * len(batch)
            found: dict[int, bytes] = {}
            for text, host, own in zip(as_bytes(batch.column("text")), as_bytes(batch.column("source")), given, strict=True):
                if not text:
                    continue
                _, words, keys = line_keys(text, host)
                bad = _among(keys.view(np.int64), known.value if known is not None else np.sort(np.array(own or [], np.int64))) & (keys > 0)
                if bad.any() and int(words[~bad].sum()) < max(left_words, left_share * int(words.sum())):
                    found[line_set(keys)] = text
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.array(list(found), np.uint64).view(np.int64)), pa.array(list(found.values()), pa.binary()).cast(pa.string())],
                    names=["doc_id", "text"]
                )

    # which of those that would go are near copies of each other, is settled on their texts
    suspects = materialize(wide.mapInArrow(depleted, "doc_id long, text string").groupBy("doc_id").agg(F.min("text").alias("text")), "suspects")
    if suspects.isEmpty():
        return often
    classes = linked(suspects).select(F.col("doc_id").alias("doc"), F.col("component_id").alias("class"))
    held = rows.join(often, "line", "left_semi").join(classes, "doc", "left")
    return beyond(held.select("line", "host", F.coalesce("class", "doc").alias("class")).distinct(), "frequent")


def _with_known(docs: DataFrame, lines: DataFrame) -> tuple[DataFrame, Broadcast | None]:
    """The frequent lines for all tasks; if they are too many, each document with its own of them (_lines)."""
    if lines.count() <= BROADCAST_LINES:
        return docs, docs.sparkSession.sparkContext.broadcast(np.sort(lines.toPandas()["line"].to_numpy(np.int64)))
    key = F.xxhash64("doc_id", "source", "text").alias("_row")
    own = docs.select(key, "text", "source").mapInArrow(_own_lines, "_row long, line long")
    removed = own.join(lines, "line", "left_semi").groupBy("_row").agg(F.collect_set("line").alias("_lines"))
    return docs.withColumn("_row", key).join(removed, "_row", "left").drop("_row"), None


def base_counts(text: bytes, cache: WordHashes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined) - int(np.count_nonzero((np.frombuffer(joined, np.uint8) & 0xC0) == 0x80))
    symbols = sum(map(joined.count, (bytes([c]) for c in SYMBOLS)))
    lines = [x for x in text.split(b"\n") if x.strip()]  # bytes.strip() takes the same six characters as split()
    repeats = 0
    if n > 3:
        h = windows(cache.of(words), 3)
        order = np.argsort(h, kind="stable")
        same = np.diff(h[order].view(np.int64)) == 0
        hit = np.zeros(len(h), bool)
        hit[order[1:][same]] = hit[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for i in range(3):
            covered[i : n - 2 + i] |= hit
        repeats = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeats


def judged(
    docs: DataFrame, min_docs: int = 20, share: float = 0.003, min_words: int = 50, left_words: int = 25, left_share: float = 0.5,
    texts: bool = False, near_copies: bool = False
) -> DataFrame:
    """One row per document: base counts, verdict; with texts also all columns of docs, the text cleaned."""
    lines = frequent_lines(docs, min_docs, share, left_words, left_share, near_copies)
    own = {x.split()[0] for x in OUT.split(", ")}
    extra = [f for f in docs.schema if f.name not in own] if texts else []
    wide = docs.select("doc_id", "text", "source", *([f.name for f in extra if f.name not in ("text", "source")]))
    wide, known = _with_known(wide, lines)

    out = OUT + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in extra)
    names = [f.name for f in extra]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            rows: list[tuple] = []
            cleaned: list[bytes | None] = []
            given = batch.column("_lines").to_pylist() if known is None else [None] * len(batch)
            for doc_id, text, host, own in zip(
                batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), as_bytes(batch.column("source")), given, strict=True
            ):
                body = text or b""
                n, chars, symbols, dup, repeat = base_counts(body, cache)
                parts, words, keys = line_keys(body, host)
                bad = _among(keys.view(np.int64), known.value if known is not None else np.sort(np.array(own or [], np.int64))) & (keys > 0)
                left = int(words[~bad].sum())
                failed = n < min_words or 100 * repeat > 50 * n
                rows.append(
                    (doc_id, n, chars, symbols, dup, repeat, failed, not failed and left >= max(left_words, left_share * n), left, int(bad.sum()))
                )
                cleaned.append(text if not bad.any() else b"\n".join(x for x, b in zip(parts, bad, strict=True) if not b))
            columns = [pa.array(x) for x in zip(*rows, strict=True)] if rows else []
            if not rows:
                continue
            columns[0] = batch.column("doc_id").cast(pa.int64())
            for name in names:
                if name == "text":
                    columns.append(pa.array(cleaned, pa.binary()).cast(pa.string()))
                else:
                    columns.append(batch.column(name))
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in OUT.split(", ")] + names)

    return wide.mapInArrow(tidy(judge), out)


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which keys are among the known ones, which ascend: a search for each key, however many are known."""
    if not len(known):
        return np.zeros(len(keys), bool)
    return known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys


def _own_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [
            np.unique(line_keys(t, h)[2]).view(np.int64) if t else np.array([], np.int64) for t,
            h in zip(as_bytes(batch.column("text")), as_bytes(batch.column("source")), strict=True)
        ]
        rows = np.repeat(batch.column("_row").to_numpy(), [len(k) for k in keys])
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.concatenate(keys) if keys else np.array([], np.int64))], names=["_row", "line"])
