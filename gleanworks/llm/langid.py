"""Language identification by string kernels (operator 9).

The kernel of two texts counts the character n-grams (all lengths of a blended spectrum) that both hold at
least once, divided by the root of the product of the texts' own counts. A Nystrom approximation maps a
text to its kernel values with ``m`` landmark texts times ``K_mm^(-1/2)``; one-versus-rest ridge regression
on that map is kernel ridge regression in the landmarks' span. Because kernel values with the landmarks
are sums over the n-grams present, a batch of texts is scored as one sparse presence matrix times one dense
(n-grams x languages) matrix, which is the landmarks' presence matrix times the dual coefficients. N-grams
have 64-bit hashes and are looked up in the sorted table of the landmarks' own; others count in the norm alone.

Learning takes a sample of labelled texts, bounded by documented parameters whatever the input: at most
``labels`` languages (those with the most texts), of each at most ``per_lang`` distinct texts (the least hashes of
doc_id and text, whole texts; very long ones last) within its part of ``chars`` characters, but one text at
least. Prediction reads every text whole.

Defined results: null text, or one without a letter, is ``und`` with score 0; rows without a label are
never learnt from; if no row can be learnt from, every prediction is ``und``; ties go to the language that
sorts first; rows of equal doc_id and text are learnt from once, however often they are repeated, and
different texts of one doc_id each; extra columns don't matter; null doc_id counts as not held out, and is
not learnt from.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanworks.llm.common import release_kept, tidy

#: Lengths of the n-grams, and distinct n-grams beyond which a text is a landmark only where a language has
#: too few others (this bounds the table; every text of the sample is learnt from).
LENGTHS = (1, 2, 3, 4)
LONG = 20_000
SPACE = 32


def _folding() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower case (a space for what is no letter), and whether it is a letter."""
    size = sys.maxunicode + 1
    letters = np.zeros(size, bool)
    fold = np.full(size, SPACE, np.uint32)
    for c in range(0x20000):  # the planes above hold ideographs and symbols; ideographs are set below
        x = chr(c)
        if x.isalpha():
            letters[c] = True
            low = x.lower()
            fold[c] = ord(low) if len(low) == 1 else c
        elif unicodedata.category(x) in ("Mn", "Mc"):
            fold[c] = c
    letters[0x20000:0x32000] = True
    fold[0x20000:0x32000] = np.arange(0x20000, 0x32000)
    return fold, letters


class Grams:
    """Hashes of the distinct n-grams of a text, ascending."""

    def __init__(self) -> None:
        release_kept()
        self.fold, self.letters = _folding()

    def of(self, text: str | None) -> np.ndarray | None:
        """None if the text holds no letter."""
        if not text:
            return None
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not self.letters[points].any():
            return None
        x = self.fold[points]
        blank = x == SPACE
        keep = np.ones(len(x), bool)
        keep[1:] = ~(blank[1:] & blank[:-1])  # runs of blanks are one blank
        x = np.concatenate(([SPACE], x[keep], [SPACE])).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        h = np.zeros(len(x), np.uint64)
        found = []
        for n in range(1, max(LENGTHS) + 1):
            if len(x) < n:
                break
            h = h[: len(x) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + x[n - 1 :]
            if n in LENGTHS:
                found.append(h ^ np.uint64(n * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))
        ids = np.concatenate(found)
        ids.sort()
        fresh = np.ones(len(ids), bool)
        np.not_equal(ids[1:], ids[:-1], out=fresh[1:])
        return ids[fresh]


class Model:
    """langs, table: the landmarks' n-grams, ascending, and weights: (table x languages), the landmarks'
    presence times the dual coefficients, and a last row of zeros."""

    def __init__(self, texts: list[str], langs: list[str], landmarks: int = 192, ridge: float = 1e-3) -> None:
        grams = Grams()
        # hashes are made again where they are needed: all of them at once would fill the driver
        sized = [(t, lang, None if (g := grams.of(t)) is None else len(g)) for t, lang in zip(texts, langs, strict=True)]
        rows = [x for x in sized if x[2] is not None]
        self.langs = sorted({lang for _, lang, _ in rows})
        self.table = np.array([], np.uint64)
        if not rows:
            self.weights = np.zeros((1, 0), np.float32)
            return
        by = {lang: [i for i, (_, x, _) in enumerate(rows) if x == lang] for lang in self.langs}
        each = max(1, landmarks // len(self.langs))
        marks = [i for lang in self.langs for i in sorted(by[lang], key=lambda i: rows[i][2] > LONG)[:each]]
        held = [grams.of(rows[i][0]) for i in marks]
        self.table = np.unique(np.concatenate(held))
        at = [np.searchsorted(self.table, g) for g in held]
        del held
        # for each n-gram of the table the landmarks that hold it
        every = np.concatenate(at)
        owner = np.repeat(np.arange(len(marks)), [len(x) for x in at])[np.argsort(every, kind="stable")]
        start = np.concatenate(([0], np.cumsum(np.bincount(every, minlength=len(self.table)))))
        root = np.sqrt([rows[i][2] for i in marks])

        def shared(text: str) -> np.ndarray:
            hit = self.hits(grams.of(text))
            k = start[hit + 1] - start[hit]
            return np.bincount(owner[np.repeat(start[hit] - np.cumsum(k) + k, k) + np.arange(k.sum())], minlength=len(marks))

        kernel = np.stack([shared(t) / (np.sqrt(n) * root) for t, _, n in rows])
        values, vectors = np.linalg.eigh((kernel[marks] + kernel[marks].T) / 2)
        good = values > 1e-6 * values.max()
        to_map = vectors[:, good] / np.sqrt(values[good])
        features = np.hstack([kernel @ to_map, np.ones((len(rows), 1))])
        weight = np.array([len(rows) / (len(self.langs) * len(by[lang])) for _, lang, _ in rows])[:, None]
        target = np.array([[1.0 if lang == x else -1.0 for x in self.langs] for _, lang, _ in rows])
        penalty = ridge * len(rows) * np.eye(features.shape[1])
        penalty[-1, -1] = 1e-9
        beta = np.linalg.solve(features.T @ (features * weight) + penalty, features.T @ (target * weight))
        # the landmarks' presence times the dual coefficients, one landmark's n-grams at a time
        dual = to_map @ beta[:-1]
        self.weights = np.zeros((len(self.table) + 1, len(self.langs)), np.float32)
        for j, x in enumerate(at):
            self.weights[x] += (dual[j] / root[j]).astype(np.float32)
        self.bias = beta[-1]

    def hits(self, ids: np.ndarray) -> np.ndarray:
        """Where the table holds those of the ids that it holds."""
        at = np.minimum(np.searchsorted(self.table, ids), len(self.table) - 1)
        return at[self.table[at] == ids]

    def predict(self, ids: Iterable[np.ndarray | None]) -> tuple[list[str], list[float]]:
        """The n-grams are taken one text at a time; only those in the table are held."""
        known, sizes, found, total = [], [], [], 0
        for i, x in enumerate(ids):
            total += 1
            if x is not None and self.langs:
                known.append(i)
                sizes.append(len(x))
                found.append(np.append(self.hits(x), len(self.table)))  # the row of zeros: each text has a row
        langs, scores = ["und"] * total, [0.0] * total
        if known:
            starts = np.cumsum([0, *(len(x) for x in found[:-1])])
            sums = np.add.reduceat(self.weights[np.concatenate(found)], starts, axis=0)
            margins = sums / np.sqrt(sizes)[:, None] + self.bias
            e = np.exp(4 * (margins - margins.max(axis=1, keepdims=True)))
            share = e / e.sum(axis=1, keepdims=True)
            for i, best, p in zip(known, margins.argmax(axis=1), share, strict=True):
                langs[i], scores[i] = self.langs[best], float(p[best])
        return langs, scores


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_lang: int = 600, chars: int = 32_000_000, labels: int = 256) -> Model:
    """Learn from at most per_lang texts of each of labels languages, and chars characters in all, none held out."""
    spark = docs.sparkSession
    draw = F.xxhash64("doc_id", "text")
    known = docs.where("lang is not null and doc_id is not null and text is not null").where(~held_out()).select("lang", draw.alias("draw"), "text")
    counts = known.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n")).orderBy(F.desc("n"), "lang").limit(labels).collect()
    if not counts:
        return Model([], [])
    # thinned out by the draw to about twice the sample before any row moves; `labels` rows go to all tasks
    share = spark.createDataFrame([(r["lang"], min(2**63 - 1, int((2 * per_lang + 100) / r["n"] * 2**63))) for r in counts], "lang string, upto long")
    thin = known.join(F.broadcast(share), "lang").where(F.col("draw").bitwiseAND(2**63 - 1) <= F.col("upto"))
    # repeated rows are one candidate; keyed by the draw, so no language meets in one task
    found = thin.groupBy("lang", "draw").agg(F.max(F.length("text")).alias("size")).toPandas()
    each = chars // len(counts)
    found = found.assign(long=found["size"] > each // 8).sort_values(["lang", "long", "draw"], kind="stable")
    found["at"] = found.groupby("lang").cumcount()
    found = found[(found["at"] < per_lang) & ((found.groupby("lang")["size"].cumsum() <= each) | (found["at"] == 0))]
    chosen = spark.createDataFrame(found[["lang", "draw"]].astype({"lang": object}), "lang string, draw long")
    rows = known.join(F.broadcast(chosen), ["lang", "draw"]).groupBy("lang", "draw").agg(F.min("text").alias("text")).toPandas()
    rows = rows.sort_values(["draw", "lang"], kind="stable")
    model = Model(rows.text.tolist(), rows.lang.tolist())
    del rows
    release_kept()  # the driver goes on with less
    return model


def identified(docs: DataFrame, model: Model | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, and the columns named in keep."""
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    extra = [docs.schema[c] for c in keep]
    cols = dict.fromkeys(("doc_id", "text", *keep))
    out = "doc_id long, held_out boolean, lang_pred string, score double" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in extra)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for whole in batches:
            for at in range(0, len(whole), 64):
                batch = whole.slice(at, 64)
                langs, scores = shared.value.predict(grams.of(t) for t in batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(langs, pa.string()),
                        pa.array(scores, pa.float64()), *(batch.column(f.name) for f in extra)
                    ],
                    names=["doc_id", "held_out", "lang_pred", "score", *(f.name for f in extra)]
                )

    return docs.select(*cols, held_out().alias("held_out")).mapInArrow(tidy(score), out)
