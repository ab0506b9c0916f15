"""Mixing sources to target weights by pivotal dependent rounding (operator 5).

Every document of a source gets the same fractional number of copies, target / size of the source; its
whole part is certain, and what is left is rounded by the pivotal method: two units with fractional parts
transfer mass at random, with the sum of words and every document's expectation unchanged, until one of
them is integral; the other goes on (a unit is a document, or all documents still of one fraction). A leaf (a bounded number of documents, dealt by a hash of doc_id and text,
so that the largest source is spread over all leaves; repeated rows are one unit) leaves at most one fractional document per source;
these residuals meet in a reduction tree of fan-in ``FAN``, where a node is as many groups as its sources ask for, until
each source has one, which is rounded by itself. So the words taken from a source miss its target by less than one document.

Draws come from a hash of the seed, the level and the documents, so reruns agree on any partitioning.

Defined results: null text or text without words has size 0, takes 0 words and target of its source; null
source is a source (the last in order); a source of only empty documents has target 0; an empty table
gives an empty result; repeated rows are documents of their own
(their copies are rounded together and dealt evenly); null doc_id is rounded like the others.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gleanworks.llm.common import WORD, materialize

#: Documents of a leaf on average, and nodes of the tree that meet in one.
LEAF, FAN = 20_000, 64
#: Sources of a range when they are put in order.
SOURCES = 100_000
WEIGHTS = (3.0, 1.0, 2.0)


def _placed(sources: DataFrame) -> DataFrame:
    """With source_at: the place by code point, null last. Sources are sorted in ranges; no task sees them all."""
    parts = 1 + sources.count() // SOURCES
    ranged = sources.repartitionByRange(parts, F.col("source").isNull(), "source").withColumn("range", F.spark_partition_id())
    ranged = materialize(ranged, "sources")
    sizes = {r["range"]: r["n"] for r in ranged.groupBy("range").agg(F.count("*").alias("n")).collect()}  # a row for each range
    before, at = {}, 0
    for k in sorted(sizes):
        before[k], at = at, at + sizes[k]
    first = F.lit([before.get(k, 0) for k in range(max(before, default=0) + 1)]).cast("array<long>")[F.col("range")]
    order = Window.partitionBy("range").orderBy(F.col("source").isNull(), "source")
    return ranged.withColumn("source_at", first + F.row_number().over(order) - 1).drop("range")


def targets(sources: DataFrame, total: float, most: float = 2.0) -> DataFrame:
    """With target: total is shared by weight; what exceeds most times a size is shared again, until none does.

    sources: (size, weight, ...). A source gets ``level * weight`` or all that it may; raising the level only
    ever fills more sources, so it settles after a few aggregates, each of one row."""
    full = lambda level: F.lit(level) * F.col("weight") > F.lit(most) * F.col("size")
    some = sources.where("size > 0")
    weight, level, filled = some.agg(F.sum("weight")).first()[0] or 0.0, 0.0, 0
    while weight:
        level = total / weight if not filled else level
        row = some.agg(
            F.count(F.when(full(level), 1)), F.sum(F.when(full(level), F.col("size"))), F.sum(F.when(~full(level), F.col("weight")))
        ).first()
        if row[0] == filled:
            break
        filled, weight = row[0], row[2] or 0.0
        if weight:
            level = (total - most * (row[1] or 0)) / weight
    if not weight:  # all are full
        return sources.withColumn("target", F.lit(most) * F.col("size"))
    return sources.withColumn(
        "target", F.when(F.col("size") <= 0, 0.0).when(full(level), F.lit(most) * F.col("size")).otherwise(F.lit(level) * F.col("weight"))
    )


def _transfer(x: float, w: float, y: float, v: float, draw: float) -> tuple[float, float]:
    """Move words between fractions x (of w words) and y (of v) until one is 0 or 1; expectations stay."""
    up, down = min(1 - x, y * v / w), min(x, (1 - y) * v / w)
    t = up if draw < down / (up + down) else -down
    x, y = x + t, y - t * w / v
    return tuple(float(round(z)) if min(z, 1 - z) < 1e-9 else z for z in (x, y))


def _round(x: np.ndarray, w: np.ndarray, salt: int) -> None:
    """Make all but at most one of x integral, in place; x and w go from many words to few.

    While all fractions are alike, a document is paired with all that follow as one unit, so that large
    documents are settled against many small ones and what is left over is small; else pair by pair."""
    draws, later = np.random.default_rng(salt).random((2, len(x)))
    for i in np.flatnonzero((w == 0) & (x > 0) & (x < 1)):  # no words to balance
        x[i] = float(draws[i] < x[i])
    todo = np.flatnonzero((x > 0) & (x < 1))
    values, times = np.unique(x[todo], return_counts=True)
    if times.max(initial=0) > 1:
        common = values[times.argmax()]
        alike = todo[x[todo] == common]
        rest = np.cumsum(w[alike][::-1])[::-1]
        for k, i in enumerate(alike[:-1]):
            x[i], common = _transfer(common, w[i], common, rest[k + 1], draws[i])
            if common in (0.0, 1.0):
                x[alike[k + 1 :]] = common
                break
        else:
            x[alike[-1]] = common
    live = -1
    for i in todo[(x[todo] > 0) & (x[todo] < 1)]:
        if live >= 0:
            x[live], x[i] = _transfer(x[live], w[live], x[i], w[i], later[i])
        live = i if 0 < x[i] < 1 else live if live >= 0 and 0 < x[live] < 1 else -1


def _node(pdf: pd.DataFrame, level: int, seed: int) -> pd.DataFrame:
    """Round within one node of the tree; a row that comes back fractional goes on to the next level."""
    pdf = pdf.sort_values(["source_at", "size", "doc_id", "row"], ascending=[True, False, True, True], kind="stable").reset_index(drop=True)
    x, w = pdf.part.to_numpy(float).copy(), pdf["size"].to_numpy(float)
    for source, at in pdf.groupby("source_at", sort=True).indices.items():
        at = np.sort(at)
        part = x[at]
        _round(part, w[at], xxhash.xxh3_64_intdigest(f"{seed}/{level}/{int(pdf.node[0])}/{source}"))
        x[at] = part
    return pdf.assign(part=x)


def _rounding(level: int, seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    return lambda pdf: _node(pdf, level, seed)


SCHEMA = "doc_id long, row long, source_at long, size long, n long, whole long, part double, node long"


def mixed(docs: DataFrame, share: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """doc_id, row, size, source_size, target, copies, taken of every document.

    row is a hash of doc_id, source and text, for a join back; repeated rows share it.
    """
    sized = docs.select(
        "doc_id", "source", F.xxhash64("doc_id", "source", "text").alias("row"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    )
    # repeated rows are one unit of n documents from here on, so no leaf holds all of them
    units = materialize(sized.groupBy("doc_id", "source", "row", "size").agg(F.count("*").alias("n")), "sizes")
    sources = _placed(units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.count("*").alias("units")))
    weight = F.lit([*WEIGHTS])[F.pmod("source_at", F.lit(len(WEIGHTS))).cast("int")]
    sources = materialize(sources.withColumn("weight", weight), "weights")
    words, count, kinds = sources.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("units"), F.lit(0)), F.count("*")).first()
    # above the leaves a node has a residual of every source in each of its children: with many sources it is several groups
    spread = max(1, -(-kinds * FAN // LEAF))
    table = targets(sources, min(share, most) * float(words), most)
    table = materialize(
        table.select(
            "source", "source_at", F.col("size").alias("source_size"), "target",
            F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0).alias("rate")
        ),
        "targets"
    )
    leaves = 1
    while leaves * LEAF < count:
        leaves *= FAN if leaves * LEAF * 8 < count else 2
    copies = F.col("rate") * F.col("n")
    whole = F.floor(copies).cast("long")
    rows = units.join(table.select("source", "source_at", "rate"), units.source.eqNullSafe(table.source)).select(
        "doc_id", "row", "source_at", "size", "n", whole.alias("whole"), (copies - whole).alias("part"),
        F.pmod(F.xxhash64("doc_id", "row", F.lit(seed)), F.lit(leaves)).alias("node")
    )
    level, done = 0, []
    while True:
        part = F.pmod("source_at", F.lit(spread if level else 1)).alias("spread")
        rounded = rows.groupBy("node", part).applyInPandas(_rounding(level, seed), SCHEMA)
        rounded = materialize(rounded, f"mix-{level}")
        fractional = (F.col("part") > 0) & (F.col("part") < 1)
        done.append(rounded.where(~fractional))
        rows = rounded.where(fractional)
        if leaves == 1:
            break
        leaves = -(-leaves // FAN)
        rows = rows.withColumn("node", F.pmod("node", F.lit(leaves)))
        level += 1
    # at most one unit of each source is left
    chance = F.pmod(F.xxhash64("doc_id", "row", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    done.append(rows.withColumn("part", F.when(chance < F.col("part"), 1.0).otherwise(0.0)))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    # the copies of a unit are dealt to its documents evenly
    out = out.withColumn("every", F.col("whole") + F.round("part").cast("long")).withColumn(
        "at", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    )
    out = out.withColumn(
        "copies", (F.floor(F.col("every") / F.col("n")) + F.when(F.col("at") <= F.col("every") % F.col("n"), 1).otherwise(0)).cast("int")
    )
    return out.join(table.select("source_at", "source_size", "target"), "source_at").select(
        "doc_id", "row", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def taken(docs: DataFrame, **how: float) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    columns = docs.columns
    copies = mixed(docs, **how).groupBy("row").agg(F.sum("copies").cast("int").alias("n"))
    # repeated rows are alike: one of them stands for all, as often as the mix takes them together
    keyed = docs.withColumn("_mix_row", F.xxhash64("doc_id", "source", "text")).dropDuplicates(["_mix_row"])
    found = keyed.join(copies.where("n > 0").select(F.col("row").alias("_mix_row"), F.col("n").alias("_mix_n")), "_mix_row")
    return found.withColumn("_mix_at", F.explode(F.sequence(F.lit(1), F.col("_mix_n")))).select(*columns)
