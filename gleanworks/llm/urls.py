"""URL filtering by rules, and by gradient-boosted trees on lexical features (operator 3).

Rules give some URLs their verdict; these are the labelled URLs. From a sample of at most ``sample`` of them
(the least hashes of page_id; a bound that doesn't grow with the input) boosted trees, each over a random part
of the features, learn log-odds of
block from the URL's spelling: length, depth, digit ratio, entropy, parameters, and smoothed statistics
of suffixes of host and path. Trees are grown on statistics of the other folds (a row's own label is not in what
it is described by), and read the whole sample's when they judge. They judge every URL that no rule fits.
URLs over ``longest`` characters are judged, but not learnt from.

Defined results: a null URL, or one without ``://``, has empty host and path; no rule fits it, and the
trees judge its empty features; if labelled URLs are all of one verdict (or there are none), that verdict
(allow) goes to all; ties of rules can't be, a longer rule wins; repeated rows and extra columns don't matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("net", "/fr/", "block")
)
FEATURES = (
    "length", "host_length", "path_length", "labels", "depth", "digits", "digit_ratio", "entropy", "parameters", "query_length", "fragment",
    "https", "hyphens", "last_length", "extension", "tld", "domain", "first_segment", "tld_segment", "subdomain"
)


def split_url(url: str | None) -> tuple[str, str, str, str]:
    """Host, path, query and fragment."""
    if not url or "://" not in url:
        return "", "", "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    rest = rest[len(host) :]
    path = re.split(r"[?#]", rest, maxsplit=1)[0]
    rest, _, fragment = rest[len(path) :].partition("#")
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host) if not host.islower() else host
    return lower, path, rest.removeprefix("?"), fragment


def rule_of(host: str, path: str, rules: tuple = RULES) -> tuple[str | None, str | None]:
    """The longest rule that fits, as text, and its verdict."""
    found = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(found)[1:] if found else (None, None)


def suffixes(host: str, path: str) -> tuple[str, ...]:
    labels = host.split(".")
    tld, segment = labels[-1], path.split("/")[1] if path.startswith("/") else ""
    return tld, ".".join(labels[-2:]), "/" + segment, f"{tld}/{segment}", labels[0]


def plain_features(url: str | None, host: str, path: str, query: str, fragment: str) -> list[float]:
    url = url or ""
    n = len(url)
    digits = sum(map(url.count, "0123456789"))
    counts = Counter(url)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0
    last = path.rsplit("/", 1)[-1]
    return [
        n, len(host), len(path), host.count(".") + bool(host), path.count("/"), digits, digits / n if n else 0.0, entropy,
        query.count("=") or bool(query), len(query), bool(fragment), url.startswith("https:"), url.count("-"), len(last), "." in last
    ]


class Boosted:
    """Gradient-boosted regression trees on binned features with logistic loss, and the suffix statistics they read."""

    def __init__(
        self, urls: list[str], blocked: list[bool], trees: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 32, smooth: float = 5.0,
        columns: float = 0.3, folds: int = 5, seed: int = 7
    ) -> None:
        y = np.array(blocked, float)
        self.prior = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else -1.0
        self.trees: list[list[tuple[int, float, float, float]]] = []
        self.stats: dict[tuple[int, str], float] = {}
        if not len(y) or y.min() == y.max():
            self.prior = 10.0 if len(y) and y.min() == 1 else -10.0
            return
        split = [split_url(u) for u in urls]
        base = y.mean()
        keys = [suffixes(h, p) for h, p, _, _ in split]
        fold = np.random.default_rng(seed).permutation(len(y)) % folds
        tables: dict[tuple[int, str], np.ndarray] = {}
        for k, b, f in zip(keys, y, fold, strict=True):
            for pair in enumerate(k):
                t = tables.get(pair)
                if t is None:
                    t = tables[pair] = np.zeros((folds, 2))
                t[f] += (b, 1.0)
        self.base = base
        whole = {k: t.sum(axis=0) for k, t in tables.items()}
        self.stats = {k: float((t[0] + smooth * base) / (t[1] + smooth)) for k, t in whole.items()}
        x = self.features(urls)
        for row, (k, f) in enumerate(zip(keys, fold, strict=True)):
            for i, pair in enumerate(enumerate(k)):
                b, n = whole[pair] - tables[pair][f]
                x[row, len(FEATURES) - len(k) + i] = (b + smooth * base) / (n + smooth) if n else math.nan
        seen = [c[~np.isnan(c)] for c in x.T]
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in seen]
        # -1: not known; such a row stays at a node that asks for it, in growing as in judging
        binned = np.stack([np.where(np.isnan(v), -1, np.searchsorted(c, v, side="left")) for c, v in zip(self.cuts, x.T, strict=True)], axis=1)
        score = np.full(len(y), self.prior)
        draws = np.random.default_rng(seed)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            # each tree sees some of the features: no suffix alone decides where it is unknown
            some = np.sort(draws.choice(len(FEATURES), max(1, round(columns * len(FEATURES))), replace=False))
            tree = self._grow(binned, y - p, p * (1 - p), depth, rate, some)
            self.trees.append(tree)
            score += self._leaves(x, tree)

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float, some: np.ndarray) -> list[tuple[int, float, float, float]]:
        """A complete tree as a heap of (feature or -1, cut, value, gain)."""
        tree = [(-1, 0.0, 0.0, 0.0)] * (2 ** (depth + 1) - 1)
        at = np.zeros(len(g), np.int64)
        for node in range(len(tree)):
            here = at == node
            if not here.any():
                continue
            gs, hs = g[here], h[here]
            value = rate * gs.sum() / (hs.sum() + 1.0)
            best = (1e-6, -1, 0)
            if node < 2**depth - 1:
                for f in map(int, some):
                    cuts, own = self.cuts[f], x[here, f]
                    told = own >= 0
                    if not len(cuts) or not told.any():
                        continue
                    all_g, all_h = gs[told].sum(), hs[told].sum()
                    left_g = np.cumsum(np.bincount(own[told], gs[told], len(cuts) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(own[told], hs[told], len(cuts) + 1))[:-1]
                    gain = left_g**2 / (left_h + 1.0) + (all_g - left_g) ** 2 / (all_h - left_h + 1.0) - all_g**2 / (all_h + 1.0)
                    i = int(np.argmax(gain))
                    if gain[i] > best[0]:
                        best = (float(gain[i]), f, i)
            gain, f, i = best
            tree[node] = (f, float(self.cuts[f][i]) if f >= 0 else 0.0, float(value), gain)
            if f >= 0:
                rows = np.flatnonzero(here & (x[:, f] >= 0))
                at[rows] = 2 * node + 1 + (x[rows, f] > i)
        return tree

    @staticmethod
    def _leaves(x: np.ndarray, tree: list[tuple[int, float, float, float]]) -> np.ndarray:
        feature = np.array([t[0] for t in tree])
        cut, value = np.array([t[1] for t in tree]), np.array([t[2] for t in tree])
        at = np.zeros(len(x), np.int64)
        for _ in range(int(math.log2(len(tree) + 1)) - 1):
            f = feature[at]
            own = x[np.arange(len(x)), np.maximum(f, 0)]
            # a suffix that the sample doesn't hold settles nothing: the row stays at its node
            at = np.where((f >= 0) & ~np.isnan(own), 2 * at + 1 + (own > cut[at]), at)
        return value[at]

    def features(self, urls: list[str | None]) -> np.ndarray:
        rows = []
        for u in urls:
            s = split_url(u)
            rows.append(plain_features(u, *s) + [self.stats.get((i, k), math.nan) for i, k in enumerate(suffixes(s[0], s[1]))])
        return np.array(rows, float).reshape(len(urls), len(FEATURES))

    def odds(self, urls: list[str | None]) -> np.ndarray:
        """Log-odds of block."""
        if not self.trees:
            return np.full(len(urls), self.prior)
        x = self.features(urls)
        return self.prior + sum(self._leaves(x, t) for t in self.trees)


def judge_by_rules(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, url, host, path, rule, verdict; the last two null where no rule fits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column("url").to_pylist()
            split = [split_url(u) for u in urls]
            found = [rule_of(h, p, rules) for h, p, _, _ in split]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id").cast(pa.int64()), batch.column("url"),
                    *(pa.array(x, pa.string()) for x in ([s[0] for s in split], [s[1] for s in split], [f[0] for f in found], [f[1] for f in found]))
                ],
                names=["page_id", "url", "host", "path", "rule", "verdict"]
            )

    return pages.select("page_id", "url").mapInArrow(run, "page_id long, url string, host string, path string, rule string, verdict string")


def held_out_quality(urls: list[str], blocked: list[bool], parts: int = 5) -> float:
    """The share of URLs that models of the other parts judge right."""
    part = np.random.default_rng(3).permutation(len(urls)) % parts
    right = 0
    for k in range(parts):
        model = Boosted([u for u, p in zip(urls, part, strict=True) if p != k], [b for b, p in zip(blocked, part, strict=True) if p != k])
        test = [i for i, p in enumerate(part) if p == k]
        right += int(((model.odds([urls[i] for i in test]) > 0) == np.array([blocked[i] for i in test])).sum())
    return right / max(1, len(urls))


def fit(pages: DataFrame, rules: tuple = RULES, sample: int = 20_000, longest: int = 4_096) -> Boosted:
    """Learn from at most sample labelled URLs of at most longest characters."""
    labelled = judge_by_rules(pages, rules).where("verdict is not null").where(F.length("url") <= longest).select("page_id", "url", "verdict")
    # thin out by the hash first, a little more than asked for: each task then brings its share of the sample
    share = min(1.0, 1.2 * sample / max(1, labelled.count()) + 1e-9)
    thin = labelled.where(F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)) <= F.lit(int(share * (1 << 30))))
    rows: pd.DataFrame = thin.orderBy(F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)), "page_id", "url").limit(sample).toPandas()
    return Boosted(rows.url.tolist(), (rows.verdict == "block").tolist())


def judged(pages: DataFrame, rules: tuple = RULES, model: Boosted | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, block_odds (the trees' log-odds, of every URL)."""
    model = model or fit(pages, rules)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = shared.value.odds(batch.column("url").to_pylist())
            verdict = [v or ("block" if o > 0 else "allow") for v, o in zip(batch.column("verdict").to_pylist(), odds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdict, pa.string()), pa.array(odds, pa.float64())],
                names=["page_id", "host", "path", "rule", "verdict", "block_odds"]
            )

    return judge_by_rules(pages, rules).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, block_odds double")
