"""Document fingerprints by threshold-scaled sketches (operator 8).

A fingerprint keeps every hashed word 5-shingle below a fixed fraction (1 / ``SCALE``) of the hash space, so the
kept part of a document is the same whatever it is compared with: fingerprints merge by union, and the
share of one document that another contains can be estimated however unequal their lengths. The string is
the digest of the whole set, then 48 bits of each kept hash, base64. Comparison reads the strings alone.

The contract's edited text needs the next document. Rows are dealt by ranges of doc_id, each a partition of
its own; the first row of each range also goes, as a tail, to the range before it, so whole texts move once
and each task streams.

Defined results: null text is the empty text (its fingerprint keeps nothing); texts under five words are
one shingle; likeness of two fingerprints that keep nothing is 1 if they are equal, else 0; rows with
equal doc_id follow each other by text; a row without doc_id is nobody's next, and its next is the first
document; of a table with one document, it is its own next; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanworks.llm.common import WordHashes, scramble, shingles

SCALE = 8
#: Documents of a range on average.
RANGE = 4_000
#: Ranges at most: beyond it they grow, as rows stream through them (and are sorted on disk before).
RANGES = 65_536
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, resemblance_edited double, resemblance_next double"


def fingerprint(text: bytes, cache: WordHashes) -> str:
    s = shingles(text, cache)
    kept = s[s < np.uint64(2**64 // SCALE)] >> np.uint64(13)
    with np.errstate(over="ignore"):
        whole = int(scramble(s).sum(dtype=np.uint64))
    return f"{whole:016x}:" + base64.b64encode(np.unique(kept).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def kept(fp: str) -> np.ndarray:
    """The hashes that a fingerprint keeps, ascending."""
    raw = np.frombuffer(base64.b64decode(fp[17:]), np.uint8).reshape(-1, 6)
    return np.hstack([np.zeros((len(raw), 2), np.uint8), raw]).view(">u8").ravel().astype(np.uint64)


def likeness(a: str, b: str) -> tuple[float, float]:
    """Estimated share of a's shingles that b has, and Jaccard resemblance."""
    if a == b:
        return 1.0, 1.0
    x, y = kept(a), kept(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return (both / len(x) if len(x) else 0.0), (both / (len(x) + len(y) - both) if both else 0.0)


def merged(a: str, b: str) -> np.ndarray:
    """What the fingerprint of both documents together keeps."""
    return np.union1d(kept(a), kept(b))


def _stream(first: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        names = [x.split()[0] for x in OUT.split(", ")]
        out: list[tuple] = []
        held: tuple | None = None  # range, doc_id, text, fingerprint

        def row(doc_id: int | None, text: str, fp: str, after: str, fp_after: str) -> None:
            k = len(text) // 4
            edited = (text[: len(text) - k] + after[:k]).encode()
            fp_edited = fingerprint(edited, cache) if k else fp
            contained, alike = likeness(fp, fp_edited)
            contained_next, alike_next = likeness(fp, fp_after)
            out.append((doc_id, len(text), hashlib.sha256(edited).hexdigest(), fp, fp_edited, contained, contained_next, alike, alike_next))

        def flush() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
            batch = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
            out.clear()
            return batch

        fp_first = fingerprint(first.encode(), cache) if first is not None else ""
        for batch in batches:
            for at, tail, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("range", "tail", "doc_id", "text")), strict=True):
                text = text or ""
                if tail and (held is None or held[0] != at):
                    continue  # a repeated row: its range's last document has met its next
                fp = fingerprint(text.encode(), cache)
                if doc_id is None:
                    row(None, text, fp, first if first is not None else text, fp_first if first is not None else fp)
                    continue
                if held is not None and held[0] == at:
                    row(*held[1:], text, fp)
                held = None if tail else (at, doc_id, text, fp)
                if len(out) >= 500:
                    yield flush()
        if out:
            yield flush()

    return run


def fingerprinted(docs: DataFrame) -> DataFrame:
    """The contract's row for every document."""
    docs = docs.select("doc_id", "text")
    n = docs.agg(F.count("doc_id")).first()[0]
    parts = max(1, min(-(-n // RANGE), RANGES))
    bounds = []
    if parts > 1:
        steps = ",".join(str((i + 1) / parts) for i in range(parts - 1))
        bounds = sorted(set(docs.agg(F.expr(f"percentile_approx(doc_id, array({steps}), {20 * parts})")).first()[0]))
    edges = np.array(bounds, np.int64)

    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(np.int64)).astype(np.int32))

    # only ids go through Python here: a search among the bounds, however many there are
    known = F.coalesce("doc_id", F.lit(0).cast("long"))  # a null would make floats of the ids
    at = F.pandas_udf(range_of, "int")(known)
    dealt = docs.withColumn("range", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(parts)).cast("int")).otherwise(at))
    # one row for each range
    firsts = {r["range"]: r["least"] for r in dealt.where("doc_id is not null").groupBy("range").agg(F.min("doc_id").alias("least")).collect()}
    ranges = np.array(sorted(firsts), np.int64)
    least = np.array([firsts[at] for at in ranges], np.int64)
    first = None
    if len(ranges) and docs.where("doc_id is null").limit(1).count():
        text = docs.where(F.col("doc_id") == int(least[0])).agg(F.min(F.coalesce("text", F.lit("")))).first()[0]
        first = text or ""

    def tail_of(ids: pd.Series) -> pd.Series:
        """The range before, of a range's first row; else -1."""
        x = ids.to_numpy(np.int64)
        i = np.minimum(np.searchsorted(least, x), len(least) - 1)
        return pd.Series(np.where(least[i] == x, ranges[i - 1], -1).astype(np.int32))

    tail = F.pandas_udf(tail_of, "int")(known) if len(ranges) else F.lit(-1)
    dealt = dealt.withColumn("before", F.when(F.col("doc_id").isNull(), -1).otherwise(tail))
    own = F.struct(F.col("range"), F.lit(False).alias("tail"))
    places = F.when(F.col("before") >= 0, F.array(own, F.struct(F.col("before").alias("range"), F.lit(True).alias("tail")))).otherwise(F.array(own))
    rows = dealt.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.explode(places).alias("place")
    ).select("place.range", "place.tail", "doc_id", "text")
    return rows.repartitionById(parts, "range").sortWithinPartitions("range", "tail", "doc_id", "text").mapInArrow(_stream(first), OUT)
