"""Best-fit packing by exact-complement hashing (operator 6).

Documents become token ids and an end id, and only those longer than a sequence are cut. What has to be
packed is then a histogram of lengths, 1 to ``size`` - 1, whatever the number of documents: from long to
short, each length's gap is filled exactly by one length, else by a pair, else by a triple found in an index of
sums, as often as the counts allow; lengths for which nothing fits exactly are packed best-fit, again by
counts. The plan is a list of patterns (slots with lengths, and how often), so its size depends on
``size`` alone and it may go to every task. Each piece then finds its place by itself: its rank among the
pieces of its length (counts per hash bucket, then ranks within buckets) falls into one run of the plan. A length
has as many buckets as its count asks for, so groups of copies, all of one length, are spread.

Defined results: null or empty text is the end id alone (one piece of length 1); repeated rows are packed
each; ties of length are ranked in any order; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanworks.llm.common import RELEASE, as_bytes, materialize, release_kept, tidy

SIZE = 2048
#: Pieces of one length that are ranked together, on average.
BUCKET = 256
#: Buckets that are summed up together.
BLOCK = 4096
#: Words that a worker process keeps with their ids, about 200 bytes each.
KNOWN = 300_000
PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


class ByWord:
    """Ids of texts by a tokenizer that lower-cases, drops white space and cuts letters from punctuation before it
    merges: a text's ids are its words' ids, and a word's are those of its letters and of the marks behind them.

    Words not met before are encoded together in one call, with a mark between them whose id nothing else
    gives. Words and texts for which that could fail (special tokens, the mark itself) are encoded alone.
    The first ``bound`` words stay known, as runs of one array of ids.
    """

    MARK = "\x01"
    #: Marks behind a word that are cut from it (an apostrophe isn't: it may begin a contraction).
    TAIL = b".,;:!?#%*&$()[]"

    def __init__(self, path: str, bound: int = KNOWN) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.mark,) = self.encode(self.MARK)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.ends[i] = piece.endswith("</w>")
        self.known = _Places(bound)
        self.start, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def runs(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word, in one array, with their counts."""
        if not words:
            return [np.zeros(0, np.uint32), np.zeros(0, np.int64)]
        odd = {i for i, w in enumerate(words) if self.MARK in w}
        found = np.array(
            self.tokenizer.encode_batch_fast(
                [f" {self.MARK} ".join([w for i, w in enumerate(words) if i not in odd] + [""])], add_special_tokens=False
            )[0].ids,
            np.uint32
        )
        marks = np.flatnonzero(found == self.mark)
        counts = np.diff(marks, prepend=-1) - 1
        ids = found[found != self.mark]
        if odd:
            each = iter(np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else [])
            parts = [np.array(self.encode(w), np.uint32) if i in odd else next(each) for i, w in enumerate(words)]
            return [np.concatenate(parts), np.array([len(p) for p in parts])]
        return [ids, counts]

    def cut(self, word: bytes) -> tuple[bytes, bytes]:
        """A word's letters or digits and the marks behind them, where the tokenizer cuts there, too."""
        core = word.rstrip(self.TAIL)
        if core and len(core) < len(word):
            last = core[-1:]
            if last.isalnum() or (last >= b"\x80" and core.decode().lower()[-1].isalpha()):
                return core, word[len(core) :]
        return word, b""

    def learn(self, fresh: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words not met before, in one array, with their counts; parts that are known aren't encoded again."""
        known, old = self.known, len(self.count)
        letters: dict[bytes, int] = {}  # words that the tokenizer doesn't cut
        others: dict[bytes, int] = {}

        def place(x: bytes) -> int:
            """Where a part will stand: known ones first, then one's own in either table (others are counted down from -2)."""
            at = known.get(x, old)
            if at < old:
                return at
            if x.isalpha() or x.decode().lower().isalpha():
                return old + letters.setdefault(x, len(letters))
            return -2 - others.setdefault(x, len(others))

        at = np.full((len(fresh), 2), -1, np.int64)
        for i, w in enumerate(fresh):
            if w.isalpha():
                at[i, 0] = old + letters.setdefault(w, len(letters))
                continue
            core, tail = self.cut(w)
            at[i, 0] = place(core)
            if tail:
                at[i, 1] = place(tail)
        ids, n = self.whole([w.decode() for w in letters])
        more, m = self.runs([w.decode() for w in others])
        at = np.where(at < -1, old + len(n) - 2 - at, np.where(at == -1, old + len(n) + len(m), at)).ravel()
        count = np.concatenate([self.count, n, m, [0]])  # the last one stands for no marks
        start = np.concatenate([self.start, len(self.ids) + np.cumsum(n) - n, len(self.ids) + len(ids) + np.cumsum(m) - m, [0]])
        return _gathered(np.concatenate([self.ids, ids, more]), start[at], count[at]), count[at].reshape(-1, 2).sum(axis=1)

    def whole(self, words: list[str]) -> list[np.ndarray]:
        """As runs(), of words of letters alone: the tokenizer doesn't cut them, and the last id of each says that it ends."""
        if not words:
            return [np.zeros(0, np.uint32), np.zeros(0, np.int64)]
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        counts = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        return [ids, counts] if len(counts) == len(words) else self.runs(words)

    def of(self, texts: list[bytes | None]) -> Iterator[np.ndarray]:
        alone = {i for i, t in enumerate(texts) if t and b"<|" in t}
        places = [
            np.fromiter(map(self.known.__getitem__, words), np.int64, len(words)) for i,
            t in enumerate(texts) for words in (t.lower().split() if t and i not in alone else [],)
        ]
        start, count, ids = self.start, self.count, self.ids
        if fresh := self.known.fresh:
            more, n = self.learn(fresh)
            start = np.concatenate([start, len(ids) + np.cumsum(n) - n])
            count, ids = np.concatenate([count, n]), np.concatenate([ids, more])
            kept = len(self.known)
            self.start, self.count = start[:kept], count[:kept]
            self.ids = ids[: int(self.count.sum())]
            self.known.over()
        for i, at in enumerate(places):
            if i in alone:
                yield np.array([*self.encode(texts[i].decode()), 0], np.uint32)
                continue
            yield np.append(_gathered(ids, start[at], count[at]), np.uint32(0))


def _gathered(ids: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Runs of ids, one after another."""
    return ids[np.arange(int(count.sum())) + np.repeat(start - np.cumsum(count) + count, count)]


class _Places(dict):
    """Word to place. Words that come up in a batch are fresh; those beyond the bound are forgotten after it."""

    def __init__(self, bound: int) -> None:
        self.bound = bound
        self.over()

    def over(self) -> None:
        self.fresh: list[bytes] = []
        self.beyond: dict[bytes, int] = {}

    def __missing__(self, word: bytes) -> int:
        if (place := self.beyond.get(word)) is None:
            place = len(self) + len(self.beyond)
            (self if place < self.bound else self.beyond)[word] = place
            self.fresh.append(word)
        return place


@lru_cache(maxsize=2)
def tokenizer(path: str, bound: int) -> ByWord:
    """One for each worker process, whatever the number of its tasks."""
    release_kept()
    return ByWord(path, bound)


RELEASE.append(tokenizer.cache_clear)


def pieces(docs: DataFrame, path: str, size: int = SIZE, known: int = KNOWN) -> DataFrame:
    """The pieces of every document: doc_id, row (a number of its own), piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = tokenizer(path, known)
        for whole in batches:
            for at in range(0, len(whole), 500):
                batch = whole.slice(at, 500)
                rows = []
                for n, ids in enumerate(ids_of.of(as_bytes(batch.column("text")))):
                    rows += [
                        (n, k, start, len(part), zlib.crc32(part.astype("<u4", copy=False).tobytes())) for k,
                        start in enumerate(range(0, len(ids), size)) for part in (ids[start : start + size],)
                    ]
                n, *columns = (np.array(x) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").cast(pa.int64()).take(pa.array(n)), batch.column("row").take(pa.array(n)),
                        pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:])
                    ],
                    names=["doc_id", "row", "piece", "start", "length", "ids_crc32"]
                )

    return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(tidy(cut), PIECES)


def plan(counts: np.ndarray, size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, how often) that pack counts[length] pieces of each length below size."""
    left = counts.astype(np.int64).copy()
    assert len(left) == size
    out: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...]) -> None:
        need = {x: lengths.count(x) for x in lengths}
        n = min(int(left[x]) // k for x, k in need.items())
        for x, k in need.items():
            left[x] -= n * k
        out.append((lengths, n))

    for top in range(size - 1, size // 4, -1):
        gap = size - top
        # one exact complement
        if left[top] and left[gap] and (gap != top or left[top] > 1):
            take((top, gap))
        # pairs a >= b with a + b == gap, the most even first so that short pieces last longest
        while left[top]:
            a = np.arange((gap + 1) // 2, min(gap, top + 1))
            b = gap - a
            ok = (left[a] > (a == b) + (a == top)) & (left[b] > (b == top)) if len(a) else np.zeros(0, bool)
            if not ok.any():
                break
            i = int(np.argmax(ok))
            if top in (a[i], b[i]) and left[top] < 1 + int(a[i] == top) + int(b[i] == top):
                break
            take((top, int(a[i]), int(b[i])))
        # triples a >= b >= c
        if left[top]:
            have = np.flatnonzero(left[:gap])
            have = have[have > 0]
            for a in have[::-1]:
                if not left[top]:
                    break
                rest = gap - a
                b = have[(have <= min(a, rest - 1)) & (2 * have >= rest)]
                while left[top] and len(b):
                    c = rest - b
                    ok = (left[b] > 0) & (left[c] > 0)
                    for i in np.flatnonzero(ok):
                        lengths = (top, int(a), int(b[i]), int(c[i]))
                        if all(left[x] >= lengths.count(x) for x in lengths):
                            take(lengths)
                            break
                    else:
                        break
    # what is left: best fit, longest first, over classes of open sequences with equal patterns
    open_by: list[dict[tuple[int, ...], int]] = [{} for _ in range(size + 1)]
    filled = np.zeros(size + 1, bool)
    for x in range(size - 1, 0, -1):
        while left[x]:
            at = np.flatnonzero(filled[x:])
            if not len(at):
                # as many of them as fit go together into new sequences
                k = min(size // x, int(left[x]))
                n = int(left[x]) // k
                pattern, gap = (x,) * k, size - k * x
            else:
                gap = int(at[0]) + x
                old, m = open_by[gap].popitem()
                n = min(m, int(left[x]))
                if m > n:
                    open_by[gap][old] = m - n
                filled[gap] = bool(open_by[gap])
                k, pattern, gap = 1, (*old, x), gap - x
            left[x] -= n * k
            open_by[gap][pattern] = open_by[gap].get(pattern, 0) + n
            filled[gap] = True
    return [*(x for x in out if x[1]), *((p, n) for classes in open_by for p, n in classes.items())]


def runs(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Runs of ranks: pieces of length with rank first .. first + count - 1 go to sequences base, base + 1, ... at offset."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for lengths, n in patterns:
        offset = 0
        for x in lengths:
            first = used.get(x, 0)
            rows.append((x, first, base, offset))
            used[x] = first + n
            offset += x
        base += n
    return pd.DataFrame(rows, columns=["length", "first", "base", "offset"]).sort_values(["length", "first"], kind="stable")


def packed(docs: DataFrame, path: str, size: int = SIZE, known: int = KNOWN) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = materialize(pieces(docs, path, size, known), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most size rows
    histogram = np.array([counts.get(x, 0) for x in range(size)], np.int64)
    patterns = plan(histogram, size)
    table = runs(patterns)
    planned = sum(n for _, n in patterns)
    keys = (table["length"].to_numpy(np.int64) << 40) + table["first"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(
        (
            keys, table["length"].to_numpy(np.int64), table["first"].to_numpy(np.int64), table["base"].to_numpy(np.int64),
            table["offset"].to_numpy(np.int64)
        )
    )

    # full pieces, most of a corpus of long documents, are sequences as they are: no rank, no shuffle
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    full = cut.where(F.col("length") == size).select(
        *names, (F.lit(planned) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    buckets = F.lit([max(1, counts.get(x, 0) // BUCKET) for x in range(size)])[F.col("length").cast("int")]
    dealt = cut.where(F.col("length") < size).withColumn("bucket", F.pmod(F.xxhash64("row", "piece"), buckets))
    # pieces of a length before a bucket: sums within blocks of buckets, and over blocks, so a frequent length is many tasks
    per = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).withColumn("block", F.floor(F.col("bucket") / BLOCK))
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda *by: F.coalesce(F.sum("n").over(earlier(*by)), F.lit(0))
    blocks = per.groupBy("length", "block").agg(F.sum("n").alias("n")).select("length", "block", sums("length", "block").alias("blocks"))
    before = per.withColumn("before", sums("length", "block", "bucket")).join(blocks, ["length", "block"]).select(
        "length", "bucket", (F.col("before") + F.col("blocks")).alias("before")
    )
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row", "piece")) - 1
    ranked = dealt.withColumn("rank", rank).join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lengths, first, base, offset = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 40) + rank, side="right") - 1
            assert (lengths[at] == length).all()
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in names), pa.array(base[at] + rank - first[at]),
                    pa.array(offset[at])
                ],
                names=[*names, "sequence_id", "offset"]
            )

    out = ranked.select(*names, F.col("rank").cast("long").alias("rank"))
    return out.mapInArrow(tidy(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").unionByName(full)
