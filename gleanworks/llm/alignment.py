"""Cross-tokenizer alignment by segment deduplication (operator 13).

Tokenizer A (byte-level pieces) encodes space + text, tokenizer B (pieces with a mark for a space, which it puts in front
itself) the text; byte offsets at which tokens of both end cut them into groups.

A text is split before white-space runs, at those white-space characters alone that no entry of either vocabulary holds
behind another character (``separators`` reads both vocabularies for it: a space and a line feed, but not a carriage
return, where B has entries like ``;\\r``). No merge can cross such a cut, so a text's tokens are its segments'. The segments
are counted; each distinct one is tokenised and aligned once, in a table; counts of linked id pairs are sums over
that table, weighted by how often a segment occurs. Then documents are composed: they become codes, the most
frequent HEAD segments by their number, others by a place in the document's own list, whose alignments are joined back.
What is joined back is most of the disk, so it travels packed: alignments with two characters a byte, codes seven bits a byte.

Defined results: texts that are null, empty, or not spelled back by B (they hold its mark for a space) have no tokens:
zeros and an empty groups_sha256, and their segments don't count. Repeated rows are documents each; a text without white
space is one segment, however long; ties for the highest count are all best; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from binascii import hexlify
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanworks.llm.common import RELEASE, looked_up, materialize, release_kept
from gleanworks.llm.lattice import _most_frequent

#: Segments that all tasks get, with their alignments.
HEAD = 300_000
#: Characters of such a segment at most.
HEAD_CHARS = 64
#: Linked pairs of ids that all tasks get with their counts (17 bytes each); if there are more, they are joined.
PAIRS = 4_000_000
#: Distinct segments that a task counts before it hands the counts on.
COUNTED = 200_000
MARK = "▁"
BLANKS = " \t\n"
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
SUMS = ("n_a", "n_b", "n_groups", "n_best", "count_sum")
#: Numbers and groups are digits and these four, which stand as hexadecimal digits in packed ones.
MARKS, AS_HEX = " ,|;", "abcd"
AS_MARKS = bytes.maketrans(AS_HEX.encode(), MARKS.encode())


def _byte_of() -> dict[str, int]:
    """Characters of byte-level entries to bytes: printable Latin-1 stands for itself, the rest comes from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers, the bytes of their entries, and the pattern of segments."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of = _byte_of()
        special = {x.content for x in self.a.get_added_tokens_decoder().values()}
        self.bytes_a = {i: bytes(byte_of[c] for c in piece) for piece, i in self.a.get_vocab().items() if piece not in special}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        whole = {bytes([i]) for i in range(256)}
        if whole - set(self.bytes_a.values()) or whole - {x for i, x in enumerate(self.bytes_b) if self.b.is_byte(i)}:
            raise ValueError("a vocabulary without an entry for every byte can't spell every text")
        (self.blank,) = (i for i, p in enumerate(pieces) if p == MARK)
        self.separators = self._separators([p.replace(MARK, " ") for i, p in enumerate(pieces) if not self.b.is_byte(i) and not self.b.is_control(i)])
        # a segment: white space, what follows up to the next separator behind something else; white space alone at the end
        inner = rf"[^\S{re.escape(self.separators)}]"
        self.segment = re.compile(rf"\s*\S+(?:{inner}\s*\S+)*(?:{inner}\s*\Z)?|\s+") if self.separators else re.compile(r"(?s).+")

    def _separators(self, pieces: list[str]) -> str:
        """The white-space characters before which neither tokenizer can merge across."""
        found = ""
        for c in BLANKS:
            # behind a space another separator must not merge, either: B is given its segments with a space in front
            before = r"\S" if c == " " else r"(?s:.)"
            in_a = re.compile(r"\S" + re.escape(c))
            if not any(in_a.search(x.decode(errors="replace")) for x in self.bytes_a.values()) and not any(re.search(before + re.escape(c), p) for p in pieces):
                found += c
        return found

    def spelled(self, text: str) -> bool:
        """Whether B's tokens spell space + text: its pieces and bytes cover what its normaliser leaves of it."""
        return MARK not in text and self.b.normalize(text).replace(MARK, " ") == " " + text

    def segments(self, text: str | None) -> list[str]:
        """The segments of space + text; none if the text has no tokens."""
        return self.segment.findall(" " + text) if text and self.spelled(text) else []

    def encoded(self, segments: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of A and of B of each segment."""
        ids = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        of_b = []
        for s, x in zip(segments, ids, strict=True):
            if s == " ":
                x = [self.blank]
            elif s[0] != " ":  # the space that B has put in front
                if x[0] != self.blank:
                    raise ValueError(f"{s[:20]!r} merges with what stands before it")
                x = x[1:]
            of_b.append(x)
        return list(zip([e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)], of_b, strict=True))

    def aligned(self, segment: str, a: list[int], b: list[int]) -> str:
        """The groups of a segment's tokens, as text."""
        spelling = segment.encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != spelling or b"".join(map(self.bytes_b.__getitem__, b)) != spelling:
            raise ValueError(f"tokens of {segment[:20]!r} don't spell it")
        groups = []
        i = j = from_a = from_b = at_a = at_b = 0
        while i < len(a):
            at_a += len(self.bytes_a[a[i]])
            i += 1
            while j < len(b) and at_b < at_a:
                at_b += len(self.bytes_b[b[j]])
                j += 1
            if at_a == at_b:
                groups.append(f"{','.join(map(str, a[from_a:i]))}|{','.join(map(str, b[from_b:j]))}")
                from_a, from_b = i, j
        return ";".join(groups)


@lru_cache(1)
def pair_of(path_a: str, path_b: str) -> Pair:
    release_kept()
    return Pair(path_a, path_b)


RELEASE.append(pair_of.cache_clear)


def segment_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(segment, n): how often each occurs in all texts that have tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, seen = pair_of(path_a, path_b), Counter()
        made = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["segment", "n"])
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(pair.segments(text))
                if len(seen) >= COUNTED:
                    yield made()
                    seen.clear()
        if seen:
            yield made()

    return docs.select("text").mapInArrow(count, "segment string, n long").groupBy("segment").agg(F.sum("n").alias("n"))


ALIGNED = "segment string, n long, groups string"
NUMBERED = "segment string, n long, groups string, n_a long, n_b long, n_groups long, n_best long, count_sum long"


def aligned_segments(counts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Each distinct segment with the groups of its tokens."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(path_a, path_b)
        for whole in batches:
            for first in range(0, len(whole), 2000):
                batch = whole.slice(first, 2000)
                segments = batch.column("segment").to_pylist()
                groups = [pair.aligned(s, a, b) for s, (a, b) in zip(segments, pair.encoded(segments), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("segment"), batch.column("n"), pa.array(groups, pa.string())], names=["segment", "n", "groups"])

    return counts.mapInArrow(align, ALIGNED)


def _pairs(groups: Column) -> Column:
    """The linked pairs of ids (a * 2^32 + b), which are the last ones of each group."""
    last = lambda x: F.substring_index(x, ",", -1).cast("long")
    return F.transform(F.split(groups, ";"), lambda g: F.shiftleft(last(F.substring_index(g, "|", 1)), 32) + last(F.substring_index(g, "|", -1)))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best, segments): links of an id pair in all texts, whether no pair of its B id has more, and how many
    links of distinct segments hold it."""
    each = aligned.select("n", F.explode(_pairs(F.col("groups"))).alias("pair"))
    pairs = materialize(each.groupBy("pair").agg(F.sum("n").alias("count"), F.count("*").alias("segments")), "pairs")
    b = F.expr("pair & 4294967295")
    highest = pairs.groupBy(b.alias("b")).agg(F.max("count").alias("highest"))
    return pairs.withColumn("b", b).join(highest, "b").select("pair", "count", "segments", (F.col("count") == F.col("highest")).cast("long").alias("best"))


def _linked(groups: str) -> tuple[int, int, list[int]]:
    """Numbers of tokens of A and of B, and the linked pairs, of a segment's groups."""
    of_a = of_b = 0
    pairs = []
    for g in groups.split(";"):
        a, b = g.split("|")
        a, b = a.split(","), b.split(",")
        of_a += len(a)
        of_b += len(b)
        pairs.append(int(a[-1]) << 32 | int(b[-1]))
    return of_a, of_b, pairs


def numbered(aligned: DataFrame, pairs: DataFrame, most: int = PAIRS) -> DataFrame:
    """Aligned segments with the numbers of their tokens, groups, best links, and the sum of their links' counts."""
    if pairs.count() <= most:
        table = pairs.select("pair", "count", "best").toArrow()
        order = np.argsort(table.column("pair").to_numpy())
        shared = aligned.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy()[order] for c in ("pair", "count", "best")))
        return aligned.mapInArrow(_with_numbers(shared), NUMBERED)
    links = looked_up(aligned.select("segment", F.explode(_pairs(F.col("groups"))).alias("pair")), pairs, "pair", "segments", ["count", "best"])
    sums = links.groupBy("segment").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
    # tokens of A: separators in front of each bar; of B: those behind it
    ids = lambda side: F.aggregate(F.split("groups", ";"), F.lit(0).cast("long"), lambda n, g: n + F.size(F.split(F.substring_index(g, "|", side), ",")))
    return aligned.join(sums, "segment").select(
        "segment", "n", "groups", ids(1).alias("n_a"), ids(-1).alias("n_b"), F.size(F.split("groups", ";")).cast("long").alias("n_groups"), "n_best", "count_sum"
    )


def _with_numbers(shared: Broadcast):  # noqa: ANN202
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = shared.value
        for batch in batches:
            if not len(batch):
                continue
            found = [_linked(g) for g in batch.column("groups").to_pylist()]
            sizes = np.array([len(p) for _, _, p in found])
            at = np.searchsorted(pair, np.array([x for _, _, p in found for x in p], np.int64))
            starts = np.cumsum(sizes) - sizes
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns, pa.array([a for a, _, _ in found], pa.int64()), pa.array([b for _, b, _ in found], pa.int64()), pa.array(sizes),
                    pa.array(np.add.reduceat(best[at], starts)), pa.array(np.add.reduceat(count[at], starts))
                ],
                names=["segment", "n", "groups", "n_a", "n_b", "n_groups", "n_best", "count_sum"]
            )

    return add


def packed(*values: Column) -> Column:
    """Numbers, and groups as the last value, in half a byte a character."""
    return F.unhex(F.translate(F.concat_ws(" ", *(v.cast("string") for v in values)), MARKS, AS_HEX))


def own_segments(parts: DataFrame, aligned: DataFrame) -> DataFrame:
    """(row, own): of each segment that a row holds itself, its place, the numbers of SUMS and its groups, packed."""
    sent = aligned.select("segment", packed(*(F.col(c) for c in SUMS), F.col("groups")).alias("packed"))
    # two packed values behind each other: the first ends in a blank
    place = packed(F.col("place"), F.lit(""))
    return parts.join(sent, "segment").select("row", F.concat(place, "packed").alias("own"))


def unpacked(own: bytes) -> tuple[int, list[int], bytes]:
    """Place, numbers and groups of a packed segment; an odd number of characters has a zero in front of its first number."""
    place, *values, groups = hexlify(own).translate(AS_MARKS).split(b" ")
    return int(place), [int(v) for v in values], groups


def deflated(codes: list[int]) -> bytes:
    """Codes in seven bits a byte, the lowest first, all but the last byte of a code marked, and compressed."""
    if not codes:
        return b""
    left = np.array(codes, np.uint32)
    width = max(1, -(-int(left.max()).bit_length() // 7))
    out, there = np.empty((len(left), width), np.uint8), np.ones((len(left), width), bool)
    for k in range(width):
        if k:
            there[:, k] = left > 0
        out[:, k] = (left & 127) | ((left > 127) << 7)
        left >>= 7
    return zlib.compress(out[there].tobytes(), 1)


def inflated(codes: bytes) -> np.ndarray:
    """The codes that deflated() has packed."""
    found = np.frombuffer(zlib.decompress(codes), np.uint8)
    at = np.flatnonzero(found < 128)
    sizes = np.diff(at, prepend=-1).astype(np.uint8)
    codes = found[at].astype(np.int32)  # the highest bits, behind which the others go, byte by byte
    for k in range(1, int(sizes.max())):
        longer = np.flatnonzero(sizes > k)
        codes[longer] = codes[longer] << 7 | found[at[longer] - k] & 127
    return codes


PARTS = "row long, doc_id long, codes binary, place int, segment string"


def compared(docs: DataFrame, path_a: str, path_b: str, head: int = HEAD, most: int = PAIRS) -> DataFrame:
    """doc_id, the numbers of COLUMNS and groups_sha256 of every row."""
    aligned = materialize(aligned_segments(segment_counts(docs, path_a, path_b), path_a, path_b), "aligned", "zstd")
    pairs = materialize(pair_counts(aligned), "pair-counts")
    often = _most_frequent(aligned.where(F.length("segment") <= HEAD_CHARS), head)  # at most so many, whatever the corpus
    first = numbered(often, pairs, most).toArrow()
    shared = docs.sparkSession.sparkContext.broadcast((
        {s: i for i, s in enumerate(first.column("segment").to_pylist(), 1)}, [b"", *first.column("groups").cast(pa.binary()).to_pylist()],
        np.pad(np.stack([first.column(c).to_numpy() for c in SUMS], axis=1).reshape(-1, len(SUMS)).astype(np.int64), ((1, 0), (0, 0)))
    ))
    del first

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of codes for each document, and a row for each of its own segments: those that aren't shared.

        Codes: from 1 shared segments, 0 the next of its own, those behind the shared ones one of its own again."""
        pair, place = pair_of(path_a, path_b), shared.value[0]
        names = [x.split()[0] for x in PARTS.split(", ")]
        for whole in batches:
            for start in range(0, len(whole), 500):
                batch = whole.slice(start, 500)
                codes, owners, places, own = [], [], [], []
                for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    others: dict[str, int] = {}
                    segments = pair.segments(text)
                    line = [place.get(s, 0) for s in segments]
                    for i in [i for i, code in enumerate(line) if not code]:
                        if segments[i] in others:
                            line[i] = 1 + len(place) + others[segments[i]]
                        else:
                            others[segments[i]] = len(others)
                    codes.append(deflated(line))
                    owners += [row] * len(others)
                    places += others.values()
                    own += others
                n, m = len(batch), len(own)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("doc_id").cast(pa.int64()), pa.array(codes, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names=names
                )
                if own:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(owners, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(places, pa.int32()), pa.array(own, pa.string())], names=names
                    )

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, groups, numbers = shared.value
        for batch in batches:
            sums = np.zeros((len(batch), len(SUMS)), np.int64)
            digests = []
            for k, (codes, own) in enumerate(zip(batch.column("codes").to_pylist(), batch.column("own").to_pylist(), strict=True)):
                if not codes:
                    digests.append("")
                    continue
                line = inflated(codes)
                mine = np.flatnonzero((line == 0) | (line >= len(groups)))
                places = line[mine]
                places = np.where(places, places - len(groups), np.cumsum(places == 0) - 1)
                line[mine] = 0
                spelled = [groups[i] for i in line.tolist()]
                sums[k] = numbers[line].sum(axis=0)
                if own:
                    _, values, texts = zip(*sorted(map(unpacked, own)), strict=True)
                    sums[k] += np.array(values, np.int64)[places].sum(axis=0)
                    for i, at in zip(mine.tolist(), places.tolist(), strict=True):
                        spelled[i] = texts[at]
                digests.append(hashlib.sha256(b";".join(spelled)).hexdigest())
            numbers_of = dict(zip(SUMS, sums.T, strict=True))
            numbers_of["n_links"] = numbers_of["n_groups"]  # a group has one pair of tokens that end together: its last ones
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(numbers_of[c]) for c in COLUMNS), pa.array(digests, pa.string())], names=["doc_id", *COLUMNS, "groups_sha256"]
            )

    # written once: both kinds of rows are read from it, and the numbers of rows stay as they are
    parts = materialize(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).mapInArrow(coded, PARTS), "coded", "zstd")
    own = own_segments(parts.where("segment is not null").select("row", "place", "segment"), numbered(aligned, pairs, most))
    own = own.groupBy("row").agg(F.collect_list("own").alias("own"))  # of one document: no more than it holds
    both = parts.where("segment is null").select("row", "doc_id", "codes").join(own, "row", "left").select("doc_id", "codes", "own")
    return both.mapInArrow(composed, "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS) + ", groups_sha256 string")
