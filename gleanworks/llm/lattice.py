"""Language-model scores by subword lattices (operator 1).

The pieces are those of an existing public vocabulary, and single bytes for what it lacks. A word's spelling
probability is the sum over all its segmentations of the product of their pieces' probabilities, by the
forward recursion in log space. The words seen in training are pieces, too, with discounted counts; what the
discount frees goes to the spelling lattice, so each word has one probability that marginalises over the
whole-word piece and all subword segmentations. Pieces don't cross word borders, so the recursion over a
text restarts at each word, and a text's log-probability is the sum of its words' and its end's.

There is such a model for each language label of the training documents (the ``CLASSES`` most frequent, and
one for the rest); a text's probability is their mixture, weighted by the labels' shares. A text's own
label is never looked at.

The existing vocabulary's own scores (which are ranks: Zipf weights) weigh the segmentations as a prior of ``PRIOR``
pieces; expectation steps over all distinct training words add the corpus's evidence to it. So a piece that the
corpus hardly shows keeps the weight that its score gives, and with ``prior`` large the scores alone decide.

Scale: word counts are combined in the tasks, then by word; each distinct word's lattice is computed once.
Scoring joins words with their probabilities: the ``HEAD`` most frequent words (a fixed number, of at most
``WORD_BYTES`` bytes each) go to all tasks, which sum them on the spot; only a text's other words are shuffled and
summed by document. Words of any length are spelled whole (long ones by a ring of ends, many at once); only in the
expectation steps are words over ``LONG`` characters learnt from in parts.

Defined results: null and empty texts hold the end alone; rows with equal doc_id and text are scored each;
a null doc_id counts as training; without training documents all words are spelled; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanworks.llm.common import RELEASE, as_bytes, materialize, scramble

#: Words that go to every task; words that a task counts before it passes its counts on.
HEAD, HELD = 65_536, 150_000
WORD_BYTES = 64
#: What stands for the end of a text: no word holds a line feed.
END = b"\n"
DISCOUNT = 0.75
#: Words whose lattices are computed at once.
AT_ONCE = 40_000
#: Classes besides the rest, and expectation steps.
CLASSES, STEPS = 5, 2
#: The weight of the vocabulary's own scores, in pieces seen.
PRIOR = 600.0
LONGEST = 16
#: Characters from which words are spelled by a ring of ends; ends whose spans are found at once, times words.
LONG, BLOCK = 160, 1 << 16
START = "▁"


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[str, float]:
    """Pieces of an existing vocabulary with log-probabilities from its scores (minus ranks)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i)
            if 0 < len(piece) <= LONGEST and piece == lowered(piece):
                found[piece] = -math.log(2.0 - model.get_score(i))
    return found


def lowered(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "replace")


class Lattice:
    """All segmentations of many words at once: words of one length form a matrix of code points, and the
    pieces on each span are found by rolling hashes in one table."""

    BASE = np.uint64(0x9E3779B97F4A7C15)
    SLOTS = 20

    def __init__(self, pieces: list[str]) -> None:
        self.pieces = pieces
        self.byte = len(pieces)  # the id of the fallback: weighs as many times as the character has bytes
        self.table = np.full(1 << self.SLOTS, -1, np.int32)
        self.hashes = np.array([self.hash(p) for p in pieces], np.uint64)
        self.next = np.full(len(pieces), -1, np.int32)  # others in the same slot
        for i, at in enumerate((scramble(self.hashes) >> np.uint64(64 - self.SLOTS)).astype(np.int64)):
            self.next[i], self.table[at] = self.table[at], i

    def hash(self, piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(self.BASE) + ord(c) + 1) % 2**64
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, or -1."""
        found = self.table[(scramble(h) >> np.uint64(64 - self.SLOTS)).astype(np.int64)]
        miss = np.flatnonzero((found >= 0) & (self.hashes[found] != h))
        while len(miss):
            found[miss] = self.next[found[miss]]
            miss = miss[found[miss] >= 0]
            miss = miss[self.hashes[found[miss]] != h[miss]]
        return found

    def groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[list[tuple[int, np.ndarray, np.ndarray]]], np.ndarray]]:
        """By length: which words, spans by their end as (start, rows, ids), and bytes of each character."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
            for part in np.array_split(at, min(len(at), -(-len(at) * (int(lengths[at[0]]) + 1) // 200_000))):
                n = int(lengths[part[0]]) + 1
                points = np.frombuffer("".join(START + words[i] for i in part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), n)
                size = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
                prefix = np.zeros((n + 1, len(part)), np.uint64)
                for j in range(n):
                    prefix[j + 1] = prefix[j] * self.BASE + points[:, j] + np.uint64(1)
                power = [np.uint64(pow(int(self.BASE), k, 2**64)) for k in range(LONGEST + 1)]
                spans: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[]]
                for j in range(1, n + 1):
                    here = []
                    for i in range(max(0, j - LONGEST), j):
                        ids = self.find(prefix[j] - prefix[i] * power[j - i])
                        rows = np.flatnonzero(ids >= 0)
                        if len(rows):
                            here.append((i, rows, ids[rows]))
                    spans.append(here)
                yield part, points, spans, size.T.astype(np.float64)

    def forward(self, spans: list, size: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """Log of the summed probability of the segmentations of each prefix: (ends x models x words)."""
        n, m = size.shape
        alpha = np.full((n + 1, len(log_p), m), -np.inf)
        alpha[0] = 0.0
        for j in range(1, n + 1):
            total = alpha[j - 1] + log_p[:, self.byte, None] * size[j - 1]
            for i, rows, ids in spans[j]:
                total[:, rows] = np.logaddexp(total[:, rows], alpha[i][:, rows] + log_p[:, ids])
            alpha[j] = total
        return alpha

    def spelled(self, words: list[str], log_p: np.ndarray) -> np.ndarray:
        """(words x models) log-probabilities."""
        out = np.zeros((len(words), len(log_p)))
        long = [i for i, w in enumerate(words) if len(w) > LONG]
        short = words if not long else [w for w in words if len(w) <= LONG]
        place = np.arange(len(words)) if not long else np.flatnonzero(np.fromiter((len(w) <= LONG for w in words), bool, len(words)))
        for at, _, spans, size in self.groups(short):
            out[place[at]] = self.forward(spans, size, log_p)[-1].T
        long.sort(key=lambda i: len(words[i]))
        while long:
            # words of similar lengths go together, the longest of them at most twice as long as the least
            part = [i for i in long[:64] if len(words[i]) <= 2 * len(words[long[0]])]
            long = long[len(part) :]
            out[part] = self.spelled_long([words[i] for i in part], log_p)
        return out

    def spelled_long(self, words: list[str], log_p: np.ndarray) -> np.ndarray:
        """The forward recursion of a few long words in step: it keeps the last LONGEST ends, and finds the spans of a block of ends at once."""
        ends = np.array([len(w) + 1 for w in words])
        m, n = len(words), int(ends.max())
        weight = np.append(log_p, np.full((len(log_p), 1), -np.inf), axis=1)  # the last column: no such piece
        none = weight.shape[1] - 1
        block = max(64, BLOCK // m)
        before = np.zeros((LONGEST, m), np.uint64)  # the code points before the block
        alpha = np.full((len(log_p), LONGEST, m), -np.inf)
        alpha[:, -1] = 0.0
        out = np.zeros((m, len(log_p)))
        for first in range(0, n, block):
            width = min(block, n - first)
            points = np.zeros((width, m), np.uint64)
            for c, w in enumerate(words):
                x = np.frombuffer((START + w if first == 0 else w[first - 1 :])[:width].encode("utf-32-le", "surrogatepass"), np.uint32)
                points[: len(x), c] = x
            size = (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).astype(np.float64)
            window = np.concatenate([before, points])
            ids = np.full((width, LONGEST, m), none, np.int32)  # by end, and start among the LONGEST before it
            h = np.zeros((LONGEST + width, m), np.uint64)
            for k in range(1, LONGEST + 1):
                h = np.concatenate([np.zeros((1, m), np.uint64), h[:-1]]) * self.BASE + window + np.uint64(1)
                # a hash over more characters than there are is of no span: its start has no probability
                found = self.find(h[LONGEST:].ravel()).reshape(width, m)
                ids[:, LONGEST - k] = np.where(found >= 0, found, none)
            before = window[-LONGEST:]
            held = np.concatenate([alpha, np.empty((len(log_p), width, m))], axis=1)
            last = {}
            for c in np.flatnonzero((ends > first) & (ends <= first + width)):
                last.setdefault(int(ends[c]) - first - 1, []).append(c)
            for j in range(width):
                t = held[:, j : j + LONGEST] + weight[:, ids[j]]
                byte = held[:, j + LONGEST - 1] + log_p[:, self.byte, None] * size[j]
                top = np.maximum(t.max(axis=1), byte)
                held[:, j + LONGEST] = top + np.log(np.exp(t - top[:, None]).sum(axis=1) + np.exp(byte - top))
                for c in last.get(j, ()):
                    out[c] = held[:, j + LONGEST, c]
            alpha = held[:, -LONGEST:]
        return out

    def expected(self, words: list[str], weight: np.ndarray, log_p: np.ndarray, counts: np.ndarray) -> None:
        """Add to counts (models x pieces) the pieces' expected numbers; weight: (models x words)."""
        for at, _, spans, size in self.groups(words):
            alpha = self.forward(spans, size, log_p)
            n, m = size.shape
            beta = np.full((n + 1, len(log_p), m), -np.inf)
            beta[n] = 0.0
            own = weight[:, at]
            whole = alpha[n]
            for j in range(n, 0, -1):
                step = log_p[:, self.byte, None] * size[j - 1]
                counts[:, self.byte] += (own * size[j - 1] * np.exp(alpha[j - 1] + step + beta[j] - whole)).sum(axis=1)
                beta[j - 1] = np.logaddexp(beta[j - 1], beta[j] + step)
                for i, rows, ids in spans[j]:
                    ahead = beta[j][:, rows] + log_p[:, ids]
                    share = own[:, rows] * np.exp(alpha[i][:, rows] + ahead - whole[:, rows])
                    for k in range(len(log_p)):
                        counts[k] += np.bincount(ids, share[k], counts.shape[1])
                    beta[i][:, rows] = np.logaddexp(beta[i][:, rows], ahead)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    """One for each worker process."""
    return Lattice(list(vocabulary(path)))


RELEASE += [lattice.cache_clear, vocabulary.cache_clear]


def classes_of(docs: DataFrame) -> tuple[list[str], list[float]]:
    """The most frequent labels of the training documents, and the shares of them and of the rest."""
    rows = docs.where(~held_out()).groupBy("lang").agg(F.count("*").alias("n"))
    total = rows.agg(F.sum("n")).first()[0] or 0
    top = rows.where("lang is not null").orderBy(F.desc("n"), "lang").limit(CLASSES).collect()
    shares = [r["n"] / total for r in top]
    return [r["lang"] for r in top], [*shares, max(0.0, 1 - sum(shares))]


def word_counts(docs: DataFrame, labels: list[str]) -> DataFrame:
    """(word, n0, n1, ...): how often training documents of each class hold each word of any document; the end is a word."""
    width = len(labels) + 1
    at = {lang: i for i, lang in enumerate(labels)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[Counter[bytes]] = [Counter() for _ in range(width)]
        other: set[bytes] = set()

        def pour() -> Iterator[pa.RecordBatch]:
            for k, c in enumerate(seen):
                if c:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(c), pa.binary()), pa.array([k] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())],
                        names=["word", "k", "n"]
                    )
                c.clear()
            if other:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(other), pa.binary()), pa.array([0] * len(other), pa.int32()), pa.array([0] * len(other), pa.int64())],
                    names=["word", "k", "n"]
                )
            other.clear()

        for batch in batches:
            for out, text, lang in zip(
                batch.column("held_out").to_pylist(), as_bytes(batch.column("text")), batch.column("lang").to_pylist(), strict=True
            ):
                words = text.lower().split() if text else []
                words.append(END)
                other.update(words) if out else seen[at.get(lang, width - 1)].update(words)
                if sum(map(len, seen)) + len(other) > HELD:
                    yield from pour()
        yield from pour()

    rows = docs.select("text", "lang", held_out().alias("held_out")).mapInArrow(count, "word binary, k int, n long")
    return rows.groupBy("word").agg(*(F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(width)))


def _counts_of(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.stack([batch.column(f"n{k}").to_numpy(zero_copy_only=False) for k in range(width)]).astype(np.float64)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least so many."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if sum(map(len, held)):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def piece_scores(words: DataFrame, path: str, width: int, steps: int = STEPS, prior: float = PRIOR) -> np.ndarray:
    """(classes x pieces) log-probabilities: the vocabulary's scores as a prior of so many pieces, and the
    expected numbers of pieces in all training words.

    What a step brings to the driver is bounded by the vocabulary and the number of classes."""
    scores = np.array([*vocabulary(path).values()])
    scores = np.append(scores, scores.min() + 2.5 if len(scores) else 0.0)  # any of 256 bytes: each like a rare piece
    own = np.exp(scores - scores.max())
    own = prior * own / own.sum()
    log_p = np.tile(np.log(own / own.sum()), (width, 1))
    log_p[:, -1] -= math.log(256)
    seen = words.where((F.greatest(F.lit(0), *(F.col(f"n{k}") for k in range(width))) > 0) & (F.col("word") != F.lit(END)))
    for _ in range(steps):
        shared: Broadcast = words.sparkSession.sparkContext.broadcast(log_p)

        def expect(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            found = lattice(path)
            counts = np.zeros(shared.value.shape)
            # most words are of one class: each class gathers its own, enough at once to make arrays of
            mine: list[list[str]] = [[] for _ in range(width)]

            def take(k: int) -> None:
                found.expected(mine[k], np.ones((1, len(mine[k]))), shared.value[k : k + 1], counts[k : k + 1])
                mine[k].clear()

            for batch in batches:
                text = [w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]
                for k, own in enumerate(_counts_of(batch, width) > 0):
                    mine[k] += [text[i][at : at + LONG] for i in np.flatnonzero(own) for at in range(0, len(text[i]), LONG)]
                    if len(mine[k]) >= AT_ONCE:
                        take(k)
            for k in range(width):
                take(k)
            k, piece = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(counts[k, piece])], names=["k", "piece", "n"]
            )

        rows = seen.mapInArrow(expect, "k int, piece int, n double").groupBy("k", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.tile(own, (width, 1))
        counts[rows.k.to_numpy(), rows.piece.to_numpy()] += rows.n.to_numpy()
        log_p = np.log(counts / counts.sum(axis=1, keepdims=True))
        log_p[:, -1] -= math.log(256)
    return log_p


def scored_words(words: DataFrame, path: str, totals: np.ndarray, distinct: np.ndarray) -> DataFrame:
    """(word, n, p0, p1, ...): training count, and log10 of the probability in each class."""
    width = len(totals)
    log_p = piece_scores(words, path, width)
    shared: Broadcast = words.sparkSession.sparkContext.broadcast(log_p)
    # a class without words spells everything
    escape = np.log(np.where(totals > 0, DISCOUNT * np.maximum(distinct, 1) / np.maximum(totals, 1), 1.0))
    whole = np.log(np.maximum(totals, 1))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = lattice(path)
        for batch in _gathered(batches, AT_ONCE):
            text = batch.column("word").to_pylist()
            n = _counts_of(batch, width)
            x = found.spelled(["\u2029" if w == END else w.decode("utf-8", "replace") for w in text], shared.value).T + escape[:, None]
            with np.errstate(divide="ignore"):
                y = np.log(np.maximum(n - DISCOUNT, 0)) - whole[:, None]
            p = np.logaddexp(x, y) / math.log(10)
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), pa.array(n.sum(axis=0).astype(np.int64)), *(pa.array(c) for c in p)],
                names=["word", "n", *(f"p{k}" for k in range(width))]
            )

    return words.mapInArrow(score, "word binary, n long" + "".join(f", p{k} double" for k in range(width)))


def _most_frequent(table: DataFrame, most: int) -> DataFrame:
    """The most frequent words, at most so many: those above a step of counts that few enough reach.

    Steps are sixteenths of powers of two, so their histogram is small; a sort would send the driver a
    head from every task."""
    step = F.floor(F.log2(F.col("n") + 1) * 16)
    above, least = 0, 1 << 62
    for row in sorted(table.groupBy(step.alias("s")).agg(F.count("*").alias("k")).collect(), key=lambda r: -r["s"]):
        above += row["k"]
        if above > most:
            break
        least = row["s"]
    return table.where(step >= F.lit(least))


def scored(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    labels, shares = classes_of(docs)
    width = len(labels) + 1
    words = materialize(word_counts(docs, labels), "words")
    every = "+".join(f"n{k}" for k in range(width))
    sums = words.agg(
        F.count(F.when(F.expr(every) > 0, 1)), *(F.coalesce(F.sum(f"n{k}"), F.lit(0)) for k in range(width)),
        *(F.count(F.when(F.col(f"n{k}") > 0, 1)) for k in range(width))
    ).first()
    distinct, totals, kinds = sums[0], np.array(sums[1 : 1 + width], float), np.array(sums[1 + width :], float)
    total = int(totals.sum())
    table = materialize(scored_words(words, path, totals, kinds), "scores")
    head = _most_frequent(table.where(F.length("word") <= WORD_BYTES), HEAD).toPandas()  # at most HEAD rows, whatever the corpus
    place = {w: i for i, w in enumerate(head.word)}
    scores = [f"p{k}" for k in range(width)]
    shared = docs.sparkSession.sparkContext.broadcast((place, head.n.to_numpy(np.float64), head[scores].to_numpy(np.float64)))
    below = math.log10(total + distinct + 1)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of sums over head words for each document, and a row for each of its other words."""
        place, n, p = shared.value
        base, seen = np.log10(n + 1) - below, (n > 0).astype(np.int64)
        names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", *scores, "word", "k"]
        types = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 2, *[pa.float64()] * (1 + width), pa.binary(), pa.int64()]

        def made(rows: int, **columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [columns[c] if c in columns else pa.nulls(rows, t) for c, t in zip(names, types, strict=True)], names=names
            )

        for whole in batches:
            for first in range(0, len(whole), 2000):
                batch = whole.slice(first, 2000)
                heads, tokens, rest, times, owners = [], [], [], [], []
                for text in as_bytes(batch.column("text")):
                    words = text.lower().split() if text else []
                    words.append(END)
                    at = [place.get(w, -1) for w in words]
                    tokens.append(len(words))
                    heads.append(np.array(at))
                    other = Counter([w for w, i in zip(words, at, strict=True) if i < 0]) if -1 in at else {}
                    rest += other
                    times += other.values()
                    owners.append(len(other))
                # sums over runs: -1 (not a head word) takes a last, empty place
                flat = np.concatenate(heads)
                starts = np.cumsum([0, *tokens[:-1]])
                add = lambda x, flat=flat, starts=starts: np.add.reduceat(np.append(x, 0)[flat], starts)
                yield made(
                    len(batch), row=batch.column("row"), doc_id=batch.column("doc_id").cast(pa.int64()), held_out=batch.column("held_out"),
                    n_tokens=pa.array(tokens, pa.int64()), n_known=pa.array(add(seen)), base=pa.array(add(base)),
                    **{c: pa.array(add(p[:, i])) for i, c in enumerate(scores)}
                )
                if rest:
                    yield made(
                        len(rest), row=pa.array(np.repeat(batch.column("row").to_numpy(), owners)), word=pa.array(rest, pa.binary()),
                        k=pa.array(times, pa.int64())
                    )

    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double" + "".join(f", {c} double" for c in scores) + ", word binary, k long"
    # written once: both kinds of rows are read from it, and the numbers of rows stay as they are
    parts = materialize(
        docs.select("doc_id", "text", held_out().alias("held_out"), F.monotonically_increasing_id().alias("row")).mapInArrow(known, schema),
        "parts"
    )
    rest = parts.where("word is not null").select("row", "word", "k").join(table, "word")
    rest = rest.select(
        "row", F.when(F.col("n") > 0, F.col("k")).otherwise(0).alias("n_known"),
        (F.col("k") * (F.log10(F.col("n") + 1.0) - below)).alias("base"), *((F.col("k") * F.col(c)).alias(c) for c in scores)
    )
    sums_of = ("n_known", "base", *scores)
    rest = rest.groupBy("row").agg(*(F.sum(c).alias(f"{c}_rest") for c in sums_of))
    both = parts.where("word is null").drop("word", "k").join(rest, "row", "left")
    plus = {c: F.col(c) + F.coalesce(F.col(f"{c}_rest"), F.lit(0)) for c in sums_of}
    # the mixture of the classes that have a share
    terms = [plus[f"p{k}"] + F.lit(math.log10(x)) for k, x in enumerate(shares) if x > 1e-12] or [plus["p0"]]
    top = F.greatest(*terms) if len(terms) > 1 else terms[0]
    inside = terms[0] * 0
    for t in terms:
        inside = inside + F.pow(F.lit(10.0), t - top)
    return both.select(
        "doc_id", "held_out", "n_tokens", plus["n_known"].cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        plus["base"].alias("base_score"), (top + F.log10(inside)).alias("score")
    )
