"""Record linkage: exact keys, then vetoed fuzzy titles within a company's block, in arrival order.

The fold is sequential by definition: a row joins the survivor that has its key, else the first survivor that it matches,
and what a survivor is compared by may change with each row that joins it. So no row is folded ahead of its turn.
What makes it many tasks is that rows can only ever meet along matches of their titles. The distinct titles of a
company (not its rows) are compared by an index, which leaves out only pairs that can't match; linked titles are one
component; and each component is folded by itself, as a stream over rows in arrival order that keeps its survivors alone.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import groupby, islice
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanworks.functions import text, titles, urls

DEPTH = ("greenhouse", "lever", "ashby", "smartrecruiters", "workable", "workday", "rippling", "teamtailor")


def source_preference(source: Column) -> Column:
    """Employers' boards before search results before aggregators."""
    return F.when(source.isin(*DEPTH), 2).when(source == "google_jobs", 1).otherwise(0)


def dedup_key(company: Column, title: Column, location: Column, url: Column) -> Column:
    """company|title|location, and the opening's id where the URL has one."""
    ref = urls.opening(url)["id"]
    return F.concat_ws("|", text.norm(company), text.norm(title), text.norm_location(location), ref)


def indel_ratio(a: str, b: str) -> float:
    """200 * LCS / (|a| + |b|): bit-parallel over the characters of b."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    state = (1 << len(a)) - 1
    for c in b:
        hit = state & masks.get(c, 0)
        state = (state + hit) | (state - hit)
    lcs = (~state & ((1 << len(a)) - 1)).bit_count()
    return 200.0 * lcs / (len(a) + len(b))


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """100 if one's words are a part of the other's; else the best of the three comparisons."""
    x, y = set(a.split()), set(b.split())
    both, only_x, only_y = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not only_x or not only_y):
        return 100.0
    base, ax, ay = " ".join(both), " ".join(both + only_x), " ".join(both + only_y)
    best = indel_ratio(ax, ay)
    return max(best, indel_ratio(base, ax), indel_ratio(base, ay)) if both else best


def with_keys(df: DataFrame) -> DataFrame:
    """What linkage compares, projected once before the shuffle."""
    c = F.col
    ref = urls.opening(c("url"))
    return df.withColumns({
        "dedup_key": dedup_key(c("company"), c("title"), c("location"), c("url")),
        "_blk": text.company_block(c("company")), "_nt": text.norm(c("title")), "_core": text.title_core(c("title")),
        "_levels": titles.levels(c("title")), "_quals": titles.qualifiers(c("title")), "_words": titles.words(c("title")),
        "_ats": ref["ats"], "_slug": ref["slug"], "_ref": ref["id"], "_pref": source_preference(c("source")), "_len": F.length(F.coalesce("text", F.lit(""))),
    })


def exact_fold(df: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per dedup_key: the best by (preference, length of text, score), first on ties; sources united."""
    names = [c for c in df.columns if c != "dedup_key"]
    best = F.max_by(F.struct(*names), F.struct("_pref", "_len", "score", -F.col(seq)))
    grouped = df.groupBy("dedup_key").agg(
        best.alias("_best"), F.min(seq).alias("_first"),
        F.array_sort(F.collect_set(F.when(F.col("source") != "", F.col("source")))).alias("sources")
    )
    return grouped.select("dedup_key", *(F.col(f"_best.{c}").alias(c) for c in names), "_first", "sources")


def _similar(p: dict, q: dict, threshold: float, floor: float) -> bool:
    """Whether two titles may mean one role: levels and qualifiers agree, and both ratios are high enough."""
    if list(p["_levels"]) != list(q["_levels"]):
        return False
    if set(p["_quals"]) - set(q["_words"]) != set(q["_quals"]) - set(p["_words"]):
        return False
    if not p["_nt"] or not q["_nt"]:
        return False
    short, long = sorted((len(p["_core"]), len(q["_core"])))
    if long and 200 * short < floor * (short + long) - 200:  # lengths alone rule the ratio out (sorting keeps blanks but for doubles)
        return False
    return token_sort_ratio(p["_core"], q["_core"]) >= floor and token_set_ratio(p["_nt"], q["_nt"]) >= threshold


def _apart(p: dict, q: dict) -> bool:
    """Two openings of one board are never one role."""
    return bool(p["_ref"] and q["_ref"] and (p["_ats"], p["_slug"]) == (q["_ats"], q["_slug"]) and p["_ref"] != q["_ref"])


class Fold:
    """Survivors of a component, in the order in which they came, and the verdicts on pairs of titles so far."""

    def __init__(self, threshold: float = 90, floor: float = 82, kept: list[dict] | None = None) -> None:
        self.limits = threshold, floor
        self.kept = {q["dedup_key"]: q for q in kept or []}
        self.known: dict[tuple, bool] = {}

    def similar(self, p: dict, q: dict) -> bool:
        pair = tuple((r["_nt"], r["_core"], *r["_quals"], "", *r["_words"]) for r in (p, q))
        if pair not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[pair] = _similar(p, q, *self.limits)
        return self.known[pair]

    def join(self, p: dict) -> dict:
        """The survivor that a row joins or becomes. Of the two the better row stays, under the older key."""
        key = p["dedup_key"]
        if key not in self.kept:
            key = next((k for k, q in self.kept.items() if not _apart(p, q) and self.similar(p, q)), None) if p["_blk"] else None
        if key is None:
            self.kept[p["dedup_key"]] = p
            return p
        q = self.kept[key]
        wins = (p["_pref"], p["_len"], p["score"]) > (q["_pref"], q["_len"], q["score"])
        self.kept[key] = {**(p if wins else q), "dedup_key": key, "sources": sorted({*p["sources"], *q["sources"]})}
        return self.kept[key]


def join_one(kept: list[dict], p: dict, threshold: float, floor: float) -> list[dict]:
    """The survivors after one more row; the one that changed carries the mark ``_hit``."""
    fold = Fold(threshold, floor, kept)
    hit = fold.join(p)
    return [{**q, "_hit": True} if q is hit else q for q in fold.kept.values()]


def fold_block(rows: list[dict], threshold: float = 90, floor: float = 82) -> list[dict]:
    """Survivors of rows in arrival order."""
    fold = Fold(threshold, floor)
    for p in rows:
        fold.join(p)
    return list(fold.kept.values())


class TitleIndex:
    """Components of titles under ``_similar``, by comparing only pairs that can match.

    A token set ratio of at least t has one of two reasons. Either what only one of two titles has is at most
    (200 - 2t) / (200 - t) of it; then its rarest tokens, up to more than that share, hold one that the other has. Or the
    whole texts are that close; then, as every character that differs destroys at most two of a text's bigrams, those
    left in common can't miss both texts' rarest ones (a bag of bigrams doesn't depend on the order of tokens). Pairs that
    are in one component already aren't compared again. Of ``few`` titles all pairs are compared: that costs less than an index."""

    def __init__(self, forms: list[dict], threshold: float, floor: float, few: int = 8) -> None:
        self.forms, self.limits = forms, (threshold, floor)
        self.parent = list(range(len(forms)))
        self.few = len(forms) <= few
        if self.few:
            return
        tokens = [set(f["_nt"].split()) for f in forms]
        often = Counter(t for each in tokens for t in each)
        self.tokens = [sorted(each, key=lambda t: (often[t], t)) for each in tokens]
        self.share = (200 - 2 * threshold) / (200 - threshold)
        self.alpha = (100 - threshold) / 100
        bags = [Counter(x[i : i + 2] for t in each for x in [f" {t} "] for i in range(len(t) + 1)) for each in tokens]
        bigrams = Counter((g, k) for bag in bags for g, n in bag.items() for k in range(n))
        self.bigrams = [sorted(((g, k) for g, n in bag.items() for k in range(n)), key=lambda x: (bigrams[x], x)) for bag in bags]

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def components(self) -> list[int]:
        """For each form the first one of its component."""
        first: dict[str, int] = {}
        lists: tuple[dict, dict, dict] = defaultdict(list), defaultdict(list), defaultdict(list)
        for i, f in enumerate(self.forms):
            if not f["_nt"]:
                continue
            j = first.setdefault(f["_nt"], i)
            self.unite(i, j)  # equal titles may be equal keys, whatever their qualifiers
            if self.few:
                self.compare(i, range(i))
                continue
            level = ",".join(f["_levels"])
            rare, grams = self.rare_tokens(i), self.rare_bigrams(i)
            near = {j for t in rare for j in lists[0][level, t]} | {j for t in self.tokens[i] for j in lists[1][level, t]} | {j for g in grams for j in lists[2][level, g]}
            self.compare(i, sorted(near))
            for t in self.tokens[i]:
                lists[0][level, t].append(i)
            for t in rare:
                lists[1][level, t].append(i)
            for g in grams:
                lists[2][level, g].append(i)
        return [self.root(i) for i in range(len(self.forms))]

    def compare(self, i: int, near: Iterable[int]) -> None:
        for j in near:
            if self.root(i) != self.root(j) and _similar(self.forms[i], self.forms[j], *self.limits):
                self.unite(i, j)

    def unite(self, i: int, j: int) -> None:
        a, b = sorted((self.root(i), self.root(j)))
        self.parent[b] = a

    def rare_tokens(self, i: int) -> list[str]:
        size = sum(len(t) + 1 for t in self.tokens[i]) - 1
        sums = 0
        for k, t in enumerate(self.tokens[i]):
            sums += len(t) + 1
            if sums > self.share * size + 1e-9:
                return self.tokens[i][: k + 1]
        return self.tokens[i]

    def rare_bigrams(self, i: int) -> list[tuple[str, int]]:
        size = sum(len(t) + 1 for t in self.tokens[i]) - 1
        # the other text is the shortest that the ratio allows: most of the difference is what this one loses
        lost = size * (1.5 * self.alpha + 0.5) + size * (1 - self.alpha) / (1 + self.alpha) * (1.5 * self.alpha - 0.5)
        return self.bigrams[i][: int(lost + 1e-9) + 1]


FORM = ("_blk", "_nt", "_core", "_levels", "_quals", "_words")
ROW = (*FORM, "dedup_key", "_ats", "_slug", "_ref", "_pref", "_len", "score", "sources", "_id")


#: Rows of a batch that goes back to Spark, of many companies or components: most have a row or two.
OUT_ROWS = 5_000


def records(batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
    for pdf in batches:
        names = list(pdf)
        for values in zip(*(pdf[c].tolist() for c in names), strict=True):
            yield dict(zip(names, values, strict=True))


def _batched(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    while some := list(islice(rows, OUT_ROWS)):
        yield pd.DataFrame(some, columns=columns)


def _components(batches: Iterator[pd.DataFrame], threshold: float, floor: float) -> Iterator[pd.DataFrame]:
    """(form, its component) of a partition's companies, whose titles come company by company; one company's are held."""

    def found() -> Iterator[tuple]:
        for _, each in groupby(records(batches), key=itemgetter("_blk")):
            forms = list(each)
            for f, at in zip(forms, TitleIndex(forms, threshold, floor).components(), strict=True):
                yield f["_form"], forms[at]["_form"]

    yield from _batched(found(), ["_form", "_component"])


def _folded(batches: Iterator[pd.DataFrame], threshold: float, floor: float) -> Iterator[pd.DataFrame]:
    """Survivors of the components of a partition, whose rows come by component and arrival."""

    def survivors() -> Iterator[tuple]:
        for _, each in groupby(records(batches), key=itemgetter("_component")):
            fold = Fold(threshold, floor)
            for p in each:
                fold.join({**p, "sources": list(p["sources"])})
            for q in fold.kept.values():
                yield q["dedup_key"], q["_id"], q["sources"]

    yield from _batched(survivors(), ["dedup_key", "_id", "sources"])


def linked(df: DataFrame, threshold: float = 90, floor: float = 82, seq: str = "seq") -> DataFrame:
    """Survivors of the fold over all rows in the order of seq (ties: by what the rows hold), with their sources.

    Only slim rows (keys, titles, marks) go through Python; the survivors' other columns are joined back."""
    rows = with_keys(df).withColumns({
        "sources": F.array(F.col("source")) if "sources" not in df.columns else F.col("sources"),
        "_form": F.xxhash64(*(F.array_join(c, ",") if c in ("_levels", "_quals", "_words") else F.col(c) for c in FORM)),
        "_id": F.xxhash64(seq, "dedup_key", "title", "company", "location", "url", "source", "score", F.coalesce("text", F.lit(""))),
    })
    rows = rows.withColumn("sources", F.filter("sources", lambda x: x != ""))

    forms = rows.where("_blk <> ''").select("_form", *FORM).dropDuplicates(["_form"])
    # hashes that collide only put more titles into one component
    parts = forms.repartition("_blk").sortWithinPartitions("_blk").mapInPandas(
        partial(_components, threshold=threshold, floor=floor), "_form long, _component long"
    )
    alone = rows.where("_blk = ''").withColumn("_component", F.xxhash64("dedup_key", F.lit("alone")))
    slim = rows.where("_blk <> ''").join(parts, "_form").select(*ROW, "_component", seq).unionByName(alone.select(*ROW, "_component", seq))
    folded = slim.repartition("_component").sortWithinPartitions("_component", seq, "_id").select(*ROW, "_component").mapInPandas(
        partial(_folded, threshold=threshold, floor=floor), "dedup_key string, _id long, sources array<string>"
    )
    whole = rows.drop("dedup_key", "sources").dropDuplicates(["_id"]).join(folded, "_id")
    return whole.drop("_id", "_form", *FORM, "_ats", "_slug", "_ref", "_pref", "_len")


def ratios(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adds token_set and token_sort ratios of two columns, in Arrow batches."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(
                set_ratio=[token_set_ratio(x or "", y or "") for x, y in zip(pdf[a], pdf[b], strict=True)],
                sort_ratio=[token_sort_ratio(x or "", y or "") for x, y in zip(pdf[a], pdf[b], strict=True)]
            )

    return pairs.mapInPandas(
        score, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema) + ", set_ratio double, sort_ratio double"
    )
