"""The training-data operators against plain versions, on small fixtures with the hard cases planted."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import DataFrame, SparkSession

from gleanworks.llm import common, fingerprint, jaccard, langid, lattice, licenses, mixing, packing, quality, urls, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, token long, row long"
ENDS = " \t\n\r\x0b\x0c"


def words(text: str | None) -> list[str]:
    out, word = [], ""
    for c in (text or "") + " ":
        if c in ENDS:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def corpus(n: int = 120, seed: int = 5) -> list[tuple]:
    """Documents with copies, near copies, nulls, empty and long texts, repeated rows, odd blanks."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeéßñ", k=rng.randint(1, 6))) for _ in range(300)]
    body = lambda k: " ".join(rng.choices(vocab, k=k))
    rows = [(i, body(rng.choice([3, 30, 80, 200])), rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s2", None]), 0) for i in range(n)]
    base = body(100).split()
    for i in range(n, n + 25):
        near = list(base)
        for _ in range(rng.randint(0, 4)):
            near[rng.randrange(100)] = rng.choice(vocab)
        rows.append((i, " ".join(near), "en", "s1", 0))
    rows += [(n + 30, None, "en", "s1", 0), (n + 31, "", None, None, 0), (n + 32, " \n\t ", "de", "s2", 0), (n + 33, "One TWO\x0bthree\x1cfour five six\r\nseven", "en", "s2", 0)]
    rows += [(n + 34, body(9000), "en", "s1", 0), rows[3], rows[3], (None, rows[4][1], "en", "s1", 0), (n + 35, "\n".join(["same line here"] * 60), "en", "s3", 0)]
    return rows


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """With extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)


def collected(df: DataFrame) -> list[dict]:
    return [r.asDict() for r in df.collect()]


@pytest.fixture(scope="module")
def rows() -> list[tuple]:
    return corpus()


@pytest.fixture(scope="module")
def docs(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


# ---- quality

def plain_quality(text: str | None) -> tuple:
    w = words(text)
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality_base_counts(docs: DataFrame, rows: list[tuple]) -> None:
    got = collections.Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in collected(quality.judged(docs)))
    assert got == collections.Counter((r[0], *plain_quality(r[1])) for r in rows)
    for r in collected(quality.judged(docs)):
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def _boilerplate(spark: SparkSession) -> DataFrame:
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    line = lambda k: " ".join(word() for _ in range(k))
    menu = [line(20) for _ in range(6)]
    rows = [(i, "\n".join(["Cookie  NOTICE accept", *rng.sample(menu, 2), *(line(20) for _ in range(6))]), "en", "host", 0) for i in range(200)]
    rows += [(1000 + i, "\n".join([*rng.sample(menu, 4), line(5), "cookie notice ACCEPT"]), "en", "host", 0) for i in range(40)]
    rows += [(2000 + i, f"{menu[0]}\n{line(50)}", "en", "other", 0) for i in range(3)]
    article = [line(15) for _ in range(12)]
    rows += [(3000 + i, "\n".join(article if i % 2 else [*article[:i % 12], line(9), *article[i % 12:]]), "en", "host", 0) for i in range(90)]
    return frame(spark, rows)


def test_quality_removes_boilerplate_and_rejects_the_depleted(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    docs = _boilerplate(spark)
    judged = {r["doc_id"]: r for r in collected(quality.judged(docs, texts=True, near_copies=True))}
    assert all(judged[i]["kept"] and "cookie" not in lower(judged[i]["text"]) and judged[i]["n_lines_removed"] == 3 for i in range(200))
    assert not any(judged[1000 + i]["kept"] for i in range(40))  # hardly more than the menu
    assert all(judged[2000 + i]["kept"] and judged[2000 + i]["n_lines_removed"] == 0 for i in range(3))  # another host
    assert all(judged[3000 + i]["kept"] for i in range(90))  # copies and near copies are no evidence of boilerplate
    each = {r["doc_id"]: r for r in collected(quality.judged(docs, texts=True))}
    assert not any(each[3000 + i]["kept"] for i in range(90))  # counted each, near copies look like pages of one template
    assert all(each[i] == judged[i] for i in each if i < 3000)
    monkeypatch.setattr(quality, "BROADCAST_LINES", 0)
    joined = {r["doc_id"]: r for r in collected(quality.judged(docs, texts=True, near_copies=True))}
    assert joined == judged


def plain_kept(rows: list[tuple], near_copies: bool, min_docs: int = 20, share: float = 0.003, min_words: int = 50, left_words: int = 25, left_share: float = 0.5) -> list[bool]:
    """The verdicts by plain sets: lines of equal line sets count once, and with near_copies those of the depleted."""
    keys = [[" ".join(words(lower(x))) for x in (r[1] or "").split("\n")] for r in rows]
    docs = [(r[3], frozenset(filter(None, k))) for r, k in zip(rows, keys, strict=True)]
    hosts = collections.Counter(h for h, d in set(docs) if d)

    def beyond(class_of: dict) -> set:
        held: dict = {}
        for d in set(docs):
            for line in d[1]:
                held.setdefault((d[0], line), set()).add(class_of.get(d, d))
        return {k for k, v in held.items() if len(v) > max(min_docs, share * hosts[k[0]])}

    def left(i: int, bad: set) -> int:
        return sum(len(k.split()) for k in keys[i] if (rows[i][3], k) not in bad)

    total = [len(words(r[1])) for r in rows]
    bad = beyond({})
    out = {}
    for i, d in enumerate(docs):
        if d[1] and any((d[0], k) in bad for k in d[1]) and left(i, bad) < max(left_words, left_share * total[i]):
            out[d] = min(out.get(d, rows[i][1]), rows[i][1])
    names = list(out)
    classes = plain_components([(i, out[d]) for i, d in enumerate(names)])
    if near_copies:
        bad = beyond({d: ("class", classes[i]) for i, d in enumerate(names)}) & bad
    return [n >= min_words and 100 * plain_quality(r[1])[4] <= 50 * n and left(i, bad) >= max(left_words, left_share * n) for i, (r, n) in enumerate(zip(rows, total, strict=True))]


@pytest.mark.parametrize("near_copies", [False, True])
def test_quality_verdicts_by_brute_force(spark: SparkSession, near_copies: bool) -> None:
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    line = lambda k: " ".join(word() for _ in range(k))
    menus = {h: [line(12) for _ in range(8)] for h in ("h1", "h2", None)}
    rows = [(i, "\n".join([*rng.sample(menus[h], rng.randint(0, 8)), *(line(rng.choice([3, 12, 25])) for _ in range(rng.randint(1, 5)))]), "en", h, 0) for i in range(300) for h in [rng.choice([*menus])]]
    article = [line(14) for _ in range(12)]
    rows += [(1000 + i, "\n".join([*article[:j], line(7), *article[j:]]), "en", "h1", 0) for i in range(60) for j in [rng.randrange(12)]]
    rows += [(2000 + i, rows[5][1].upper(), "en", rows[5][3], 0) for i in range(40)] + [(3000, None, "en", "h1", 0), (3001, "", "en", None, 0), rows[7], rows[7]]
    found = collections.Counter((r["doc_id"], r["kept"]) for r in collected(quality.judged(frame(spark, rows), near_copies=near_copies)))
    assert found == collections.Counter((r[0], k) for r, k in zip(rows, plain_kept(rows, near_copies), strict=True))
    assert {True, False} == {k for _, k in found}


def test_quality_with_columns_named_like_results(spark: SparkSession) -> None:
    docs = spark.createDataFrame([(1, "a b c", "s", "x", 5)], "doc_id long, text string, source string, kept string, n_words long")
    (row,) = collected(quality.judged(docs, texts=True))
    assert (row["kept"], row["n_words"], row["text"], row["source"]) == (False, 3, "a b c", "s")


def test_quality_counts_pages_of_one_template(spark: SparkSession) -> None:
    rng = random.Random(8)
    line = lambda k: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(k))
    menu = [line(3) for _ in range(30)]
    docs = frame(spark, [(i, "\n".join([*menu, *(line(12) for _ in range(4))]), "en", "host", 0) for i in range(100)])
    got = collected(quality.judged(docs))
    assert len(got) == 100 and all(r["n_lines_removed"] == 30 and r["n_words_left"] == 48 and not r["kept"] for r in got)
    # hardly more than the template, so near copies of each other: counted each all the same
    docs = frame(spark, [(i, "\n".join([*(menu := [f"item {k} of the long menu" for k in range(30)]), line(8)]), "en", "host", 0) for i in range(500)])
    got = collected(quality.judged(docs))
    assert len(got) == 500 and all(r["n_lines_removed"] == 30 and not r["kept"] for r in got)


# ---- near duplicates

def plain_components(rows: list[tuple], num: int = 80, den: int = 100) -> dict:
    sets: dict = {}
    for doc_id, text, *_ in rows:
        w = words(lower(text or ""))
        s = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
        sets.setdefault(doc_id, []).append(s)
    parent = {i: i for i in sets if i is not None}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, sa), (b, sb) in itertools.combinations([(i, s) for i, every in sets.items() if i is not None for s in every], 2):
        if sa and sb and den * len(sa & sb) >= num * len(sa | sb):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in parent} | {None: None}


@pytest.mark.parametrize(("num", "den", "hot"), [(80, 100, jaccard.HOT), (50, 100, jaccard.HOT), (80, 100, 2.0)])
def test_jaccard_join_is_exact(docs: DataFrame, rows: list[tuple], num: int, den: int, hot: float) -> None:
    want = plain_components(rows, num, den)
    got = collected(jaccard.linked(docs, num, den, hot))
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in got} == set(want.items())
    assert len(set(want.values())) < len(want) - 10


def test_jaccard_random_groups(spark: SparkSession) -> None:
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(40)]
    rows = []
    for g in range(6):
        base = rng.choices(vocab, k=rng.choice([4, 12, 60, 150]))
        for _ in range(15):
            x = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                x[rng.randrange(len(x))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(x[: len(x) - rng.randint(0, len(x) // 10)]), "en", f"s{g}", 0))
    got = collected(jaccard.linked(frame(spark, rows)))
    assert {r["doc_id"]: r["component_id"] for r in got} == {k: v for k, v in plain_components(rows).items() if k is not None}


@pytest.mark.parametrize("copies", [1, 3000])
def test_jaccard_links_texts_that_hold_another(spark: SparkSession, copies: int) -> None:
    rows = []
    for g, more in enumerate([*range(8, 21), 20, 20, 20]):  # similarity 80 / 88 to 80 / 100; 21 is too far
        short = [f"g{g}w{i}" for i in range(84)]
        rows += [(len(rows) + i, " ".join(short), "en", "s", 0) for i in range(copies if g > 12 else 1)]
        rows.append((len(rows), " ".join(short + [f"g{g}x{i}" for i in range(more)]), "en", "s", 0))
    rows.append((len(rows), " ".join([f"g0w{i}" for i in range(84)] + [f"far{i}" for i in range(21)]), "en", "s", 0))
    got = {r["doc_id"]: r["component_id"] for r in collected(jaccard.linked(frame(spark, rows)))}
    firsts: dict = {}
    assert got == {i: i if "far" in text else firsts.setdefault(text.split("w")[0], i) for i, text, *_ in rows}


def test_prefixes_share_what_they_must() -> None:
    rng = np.random.default_rng(2)
    freq = rng.integers(0, 50, 1 << jaccard.SKETCH).astype(np.uint32)
    for _ in range(200):
        x = np.unique(rng.integers(0, 2**63, 60, dtype=np.uint64) * np.uint64(2))
        y = np.unique(np.concatenate([rng.choice(x, len(x) - rng.integers(0, 8), replace=False), rng.integers(0, 2**63, rng.integers(0, 5), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 80 * (len(x) + len(y) - both):
            (a, _, m), (b, _, n) = (jaccard.prefix(s, freq, 20.0, 80, 100) for s in (x, y))
            assert len(np.intersect1d(a, b)) >= min(m, n)
            for bits in (192, 2048):
                assert np.unpackbits(jaccard.parities(x, bits) ^ jaccard.parities(y, bits)).sum() <= len(x) + len(y) - 2 * both


def test_signatures_bound_what_sets_differ_in() -> None:
    rng = np.random.default_rng(12)
    for n, m, shared in ((10, 12, 9), (3000, 3500, 2800), (3000, 40_000, 2900), (70_000, 70_000, 100), (70_000, 60_000, 55_000), (1, 1, 0)):
        x = np.unique(rng.integers(0, 2**63, n + m - shared, dtype=np.uint64))
        a, b = x[:n], np.concatenate([x[:shared], x[n:]])
        apart = jaccard.bits_apart(jaccard.wide_signature(a), jaccard.wide_signature(b))
        assert apart == jaccard.bits_apart(jaccard.wide_signature(b), jaccard.wide_signature(a)) <= n + m - 2 * shared
    a, b = (np.unique(rng.integers(0, 2**63, 50_000, dtype=np.uint64)) for _ in range(2))
    assert 180 * jaccard.bits_apart(jaccard.wide_signature(a), jaccard.wide_signature(b)) > 20 * 100_000  # unrelated long texts don't pass


def test_jaccard_long_texts_that_share_passages(spark: SparkSession) -> None:
    rng = random.Random(21)
    vocab = [f"w{i}" for i in range(4000)]
    passage = rng.choices(vocab, k=120)
    rows = []
    for i in range(14):
        words_ = rng.choices(vocab, k=2500)
        rows.append((i, " ".join([*words_[:900], *passage, *words_[900:]]), "en", "s", 0))
        if i % 3 == 0:
            near = list(words_)
            near[rng.randrange(2500)] = "zz"
            rows.append((100 + i, " ".join([*near[:900], *passage, *near[900:]]), "en", "s", 0))
    got = {r["doc_id"]: r["component_id"] for r in collected(jaccard.linked(frame(spark, rows)))}
    assert got == {r[0]: r[0] % 100 for r in rows}


def test_components_of_paths_and_stars(spark: SparkSession) -> None:
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in collected(common.components(spark.createDataFrame(edges, "a long, b long")))}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 130)}


# ---- mixing

def plain_targets(sizes: np.ndarray, weights: np.ndarray, total: float, most: float = 2.0) -> np.ndarray:
    """Share by weight; what exceeds a source's limit is shared again among the others."""
    out = np.zeros(len(sizes))
    free = sizes > 0
    left = min(total, most * sizes.sum())
    while free.any():
        part = left * weights / weights[free].sum()
        over = free & (part > most * sizes)
        if not over.any():
            out[free] = part[free]
            break
        out[over] = most * sizes[over]
        left -= out[over].sum()
        free &= ~over
    return out


def test_mixing_targets(spark: SparkSession) -> None:
    assert plain_targets(np.array([100.0, 100.0, 100.0]), np.array([3.0, 1.0, 2.0]), 450).tolist() == pytest.approx([200, 250 / 3, 500 / 3])
    rng = random.Random(7)
    cases = [[100, 100, 100], [0, 10], [1, 100], [5], [0, 0], *([rng.choice([0, 1, 7, 90, 4000]) for _ in range(rng.randint(1, 40))] for _ in range(4))]
    for sizes in cases:
        weights = [(3.0, 1.0, 2.0)[i % 3] for i in range(len(sizes))]
        for share in (1.5, 3.0):
            total = min(share, 2.0) * sum(sizes)
            table = spark.createDataFrame([*zip(range(len(sizes)), sizes, weights, strict=True)], "at int, size long, weight double")
            got = [r["target"] for r in sorted(mixing.targets(table, total).collect())]
            assert got == pytest.approx(plain_targets(np.array(sizes, float), np.array(weights), total).tolist())


def test_sources_are_placed_by_code_point(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(mixing, "SOURCES", 10)
    names = [None, "", *{chr(c) * k for c in (65, 97, 0xE9, 0xFFFD, 0x1F600, 48) for k in range(1, 8)}]
    got = {r["source"]: r["source_at"] for r in collected(mixing._placed(spark.createDataFrame([(x,) for x in names], "source string").repartition(5)))}
    assert got == {x: i for i, x in enumerate([*sorted(x for x in names if x is not None), None])}


def test_repeated_rows_are_mixed_together(spark: SparkSession) -> None:
    rows = [(1, "a b c", "en", "s", 0)] * 1000 + [(2, "a b c d", "en", "s", 0), (None, "x", "en", "s", 0), (3, "word " * 300, "en", "t", 0)]
    got = collected(mixing.mixed(frame(spark, rows)))
    assert len(got) == len(rows) and {r["copies"] for r in got} <= {0, 1, 2}
    taken = collections.Counter()
    for r in got:
        taken[r["source_size"]] += r["taken"]
    goal = {r["source_size"]: r["target"] for r in got}
    assert all(abs(taken[s] - goal[s]) <= 300 for s in goal) and abs(taken[3005] - goal[3005]) <= 5


def test_mixing(docs: DataFrame, rows: list[tuple], monkeypatch: pytest.MonkeyPatch) -> None:
    sizes = collections.Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(words(text))
    order = sorted((s for s in sizes if s is not None), key=str.encode) + [None]
    goal = dict(zip(order, plain_targets(np.array([sizes[s] for s in order], float), np.array([(3, 1, 2)[i % 3] for i in range(len(order))], float), 1.5 * sum(sizes.values())), strict=True))
    got = collected(mixing.mixed(docs))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted((r[0] is None, r[0] or 0, len(words(r[1]))) for r in rows)
    taken, found = collections.Counter(), {}
    source_of = {r[0]: r[3] for r in rows}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        s = source_of[r["doc_id"]] if r["doc_id"] is not None else "s1"
        taken[s] += r["taken"]
        assert r["target"] == pytest.approx(goal[s]) and r["source_size"] == sizes[s]
        found[s] = r["target"]
    for s in order:
        assert abs(taken[s] - goal[s]) <= max(len(words(r[1])) for r in rows if r[3] == s)
    key = lambda r: (r["doc_id"] or -1, r["row"], r["copies"])
    again = collected(mixing.mixed(docs.repartition(7)))
    assert sorted(map(key, again)) == sorted(map(key, got))
    monkeypatch.setattr(mixing, "LEAF", 8)
    deep = collected(mixing.mixed(docs))
    assert len(deep) == len(rows)
    for s in order:
        t = sum(r["taken"] for r in deep if (source_of[r["doc_id"]] if r["doc_id"] is not None else "s1") == s)
        assert abs(t - goal[s]) <= max(len(words(r[1])) for r in rows if r[3] == s)


def test_mixing_of_many_sources(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    """More sources than a group of the tree holds: their residuals meet in several groups, each source's in one."""
    monkeypatch.setattr(mixing, "LEAF", 16)
    monkeypatch.setattr(mixing, "FAN", 4)
    rng = random.Random(12)
    rows = [(i, " ".join(["w"] * rng.randint(0, 9)), "en", f"s{i % 60}", 0) for i in range(1500)]
    got = collected(mixing.mixed(frame(spark, rows)))
    source_of, taken, goal = {r[0]: r[3] for r in rows}, collections.Counter(), {}
    for r in got:
        taken[source_of[r["doc_id"]]] += r["taken"]
        goal[source_of[r["doc_id"]]] = r["target"]
    assert len(goal) == 60 and all(abs(taken[s] - goal[s]) <= 9 for s in goal)
    again = collected(mixing.mixed(frame(spark, rows).repartition(7)))
    assert {(r["doc_id"], r["copies"]) for r in again} == {(r["doc_id"], r["copies"]) for r in got}


def test_mixing_expectations() -> None:
    p, n = 0.3, 4000
    total = np.zeros(6)
    for salt in range(n):
        x = np.full(6, p)
        mixing._round(x, np.array([50.0, 20, 10, 5, 5, 1]), salt)
        rest = (x > 0) & (x < 1)
        assert rest.sum() <= 1 and x @ [50, 20, 10, 5, 5, 1] == pytest.approx(p * 91)
        total += x
    assert np.allclose(total / n, p, atol=0.03)


def test_taken_repeats_rows(docs: DataFrame) -> None:
    copies = collections.Counter()
    for r in collected(mixing.mixed(docs)):
        copies[r["row"]] += r["copies"]
    got = collected(mixing.taken(docs))
    assert len(got) == sum(copies.values()) and set(got[0]) == set(docs.columns)


# ---- packing

def test_packing(docs: DataFrame, rows: list[tuple], monkeypatch: pytest.MonkeyPatch) -> None:
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "BUCKET", 5)
    whole = Tokenizer.from_file(path)
    want = collections.Counter()
    for doc_id, text, *_ in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want[doc_id, piece, start, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))] += 1
    got = collected(packing.packed(docs, path))
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= math.ceil(sum(r["length"] for r in got) / 2048) + 1


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed: int) -> None:
    rng = np.random.default_rng(seed)
    counts = np.zeros(256, np.int64)
    for x in rng.integers(1, [2, 40, 128, 256, 256, 256][seed], 3000):
        counts[x] += 1
    if seed == 5:
        counts[128:] = 0
        counts[200] = 10**12
    used = np.zeros(256, np.int64)
    patterns = packing.plan(counts, 256)
    for lengths, n in patterns:
        assert sum(lengths) <= 256 and n > 0
        for x in lengths:
            used[x] += n
    assert (used == counts).all() and len(patterns) < 5000
    if seed in (1, 2, 3):
        assert sum(n for _, n in patterns) <= 1.02 * (np.arange(256) @ counts) / 256 + 1


def test_words_tokenized_alone_are_words_of_the_whole() -> None:
    found = packing.ByWord(public_tokenizers.path("word_bpe_49k.json"))
    found.known.bound = 4  # beyond it, words are known for one batch
    texts = ["a\x01b c", "", None, "<|endoftext|> x", "\x01", "é é İ ﬁ ≠ 's don't 12 3a", "\u0085x　y", "the\x1cof", "the the of", "x" * 5000, "The THE, the. The.! thE?% (the), we're. it's, a1, 1. é. É, \u0301. e\u0301, ½! x\u0338. …. a…. don't.", "new, New. NEW new!? new.,", "K. İ, ß! I\u0307."]
    for batch in (texts, texts[::-1], ["new words here"]):
        for text, ids in zip(batch, found.of([t and t.encode() for t in batch]), strict=True):
            assert ids.tolist() == [*found.encode(text or ""), 0]


# ---- language

def test_language_id(spark: SparkSession) -> None:
    rng = random.Random(3)
    alphabets = {"aa": "abcde", "bb": "cdefg", "cc": "éñüab"}
    rows = [(i, " ".join("".join(rng.choices(a, k=4)) for _ in range(rng.choice([3, 40, 300]))), lang, "s", 0) for i, (lang, a) in enumerate(rng.choices(list(alphabets.items()), k=400))]
    rows += [(900, None, "aa", "s", 0), (901, "123 -- 45", "bb", "s", 0), (902, "", None, "s", 0), (903, "abcde ABCDE", None, "s", 0), (None, "abcde bcdea", "aa", "s", 0)]
    got = {r["doc_id"]: r for r in collected(langid.identified(frame(spark, rows)))}
    held = [r for r in rows[:400] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(got[r[0]]["held_out"] == (r in held) for r in rows[:400])
    assert sum(got[r[0]]["lang_pred"] == r[2] for r in held) >= 0.95 * len(held)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert got[903]["lang_pred"] in alphabets and all(0 <= r["score"] <= 1 for r in got.values())
    relabeled = [(i, t, "zz" if r in held else lang, s, n) for r in rows for i, t, lang, s, n in [r]]
    again = {r["doc_id"]: r for r in collected(langid.identified(frame(spark, relabeled)))}
    assert again == got  # labels that are held out teach nothing


def test_language_id_learns_from_repeated_ids(spark: SparkSession) -> None:
    rng = random.Random(5)
    alphabets = {"aa": "abcde", "bb": "klmno"}
    body = lambda a, k=40: " ".join("".join(rng.choices(a, k=4)) for _ in range(k))
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 != 2][:40]
    rows = [(i, t, lang, "s", 0) for i in ids for lang in ["ab"[i % 2] * 2] for t in [body(alphabets[lang])] for _ in range(500)]
    rows += [(ids[0], body("abcde"), "aa", "s", 0) for _ in range(3000)]  # one id, many texts
    rows += [(5000, body("abcde", 100_000), "aa", "s", 0), (5001, body("klmno"), None, "s", 0)]
    docs = frame(spark, rows)
    model = langid.fit(docs, per_lang=50, chars=200_000)
    assert model.langs == ["aa", "bb"]
    grams = langid.Grams()
    assert model.predict([grams.of(body(a)) for a in alphabets.values()])[0] == ["aa", "bb"]
    assert langid.fit(docs, labels=1).langs == ["aa"]


def test_kernel_ridge_with_every_text_as_landmark_is_exact() -> None:
    rng = random.Random(17)
    alphabets = {"aa": "abcde", "bb": "defgh", "cc": "ghija"}
    body = lambda a: " ".join("".join(rng.choices(a, k=rng.randint(2, 5))) for _ in range(rng.randint(3, 12)))
    langs = [rng.choice([*alphabets]) for _ in range(45)]
    texts = [body(alphabets[x]) for x in langs]
    asked = [body(a) for a in alphabets.values() for _ in range(5)] + ["abc ghi", "j"]
    model = langid.Model(texts, langs, landmarks=10_000, ridge=0.01)

    def presence(text: str) -> set:
        padded = f" {text} "
        return {padded[i : i + n] for n in langid.LENGTHS for i in range(len(padded) - n + 1)}

    sets, names = [presence(x) for x in texts], sorted(alphabets)
    kernel = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    n = len(texts)
    gram = np.array([[kernel(a, b) for b in sets] for a in sets])
    weight = np.array([n / (len(names) * langs.count(x)) for x in langs])
    target = np.array([[1.0 if x == y else -1.0 for y in names] for x in langs])
    # weighted kernel ridge regression with a free intercept, in its dual form
    system = np.block([[gram + 0.01 * n * np.diag(1 / weight), np.ones((n, 1))], [np.ones((1, n)), np.zeros((1, 1))]])
    dual = np.linalg.solve(system, np.vstack([target, np.zeros((1, len(names)))]))
    grams = langid.Grams()
    got, scores = model.predict([grams.of(x) for x in asked])
    for text, lang, score in zip(asked, got, scores, strict=True):
        margins = np.array([kernel(presence(text), s) for s in sets]) @ dual[:-1] + dual[-1]
        share = np.exp(4 * (margins - margins.max()))
        assert lang == names[int(margins.argmax())] and score == pytest.approx(float((share / share.sum()).max()), abs=1e-4)


def test_long_texts_of_many_characters_keep_their_ngrams() -> None:
    rng = np.random.default_rng(4)
    draw = lambda lang, k: "".join(map(chr, rng.integers(0x4E00, 0x4E00 + 3000, k) + (3000 if lang == "b" else 0)))
    grams = langid.Grams()
    text = draw("a", 300_000)
    padded = f" {text} "
    assert len(grams.of(text)) == len({padded[i : i + n] for n in langid.LENGTHS for i in range(len(padded) - n + 1)})
    langs = ["a", "b"] * 40
    model = langid.Model([draw(x, 2000) for x in langs], langs)
    assert model.predict([grams.of(draw(x, 600_000)) for x in "abab"])[0] == ["a", "b", "a", "b"]


# ---- language model

def brute_lattice(word: str, log_p: dict[str, float], byte: float) -> float:
    text = lattice.START + word
    total = 0.0
    for cuts in itertools.product((0, 1), repeat=len(text) - 1):
        parts, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                parts.append(text[at:i])
                at = i
        parts.append(text[at:])
        options = [math.exp(log_p[p]) if p in log_p else 0.0 for p in parts]
        options = [o + (math.exp(byte * len(p.encode())) if len(p) == 1 else 0.0) for o, p in zip(options, parts, strict=True)]
        total += math.prod(options)
    return math.log(total)


def test_lattice_sums_all_segmentations() -> None:
    log_p = {"▁": -3.0, "▁a": -2.5, "a": -2.0, "b": -2.2, "ab": -1.5, "▁ab": -4.0, "bé": -3.3, "éa": -2.9}
    found = lattice.Lattice(list(log_p))
    values = np.array([[*log_p.values(), -6.0], [*(v - 1 for v in log_p.values()), -5.0]])
    texts = ["", "a", "ab", "abéa", "bbéab", "日a", "zz"]
    got = found.spelled(texts, values)
    for i, t in enumerate(texts):
        assert got[i, 0] == pytest.approx(brute_lattice(t, log_p, -6.0)) and got[i, 1] == pytest.approx(brute_lattice(t, {k: v - 1 for k, v in log_p.items()}, -5.0))
    counts = np.zeros(values.shape)
    found.expected(["abab"], np.array([[2.0], [0.0]]), values, counts)
    step = 1e-5  # expected counts are derivatives of the log-probability
    for i in range(len(log_p)):
        moved = values.copy()
        moved[0, i] += step
        assert counts[0, i] == pytest.approx(2 * (found.spelled(["abab"], moved)[0, 0] - found.spelled(["abab"], values)[0, 0]) / step, abs=1e-3)
    assert not counts[1].any()


def test_lm_scores(docs: DataFrame, rows: list[tuple], monkeypatch: pytest.MonkeyPatch) -> None:
    path = public_tokenizers.path("piece_bpe_32k.model")
    tokens = lambda t: [*words(lower(t or "")), "\n"]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = collections.Counter(w for r in rows if not out(r[0]) for w in tokens(r[1]))
    total = sum(counts.values())
    want = collections.Counter((r[0], out(r[0]), len(tokens(r[1])), sum(counts[w] > 0 for w in tokens(r[1])), total, round(sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in tokens(r[1])), 6)) for r in rows)
    monkeypatch.setattr(lattice, "HEAD", 50)
    monkeypatch.setattr(lattice, "HELD", 100)
    got = collected(lattice.scored(docs, path))
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    monkeypatch.setattr(lattice, "HEAD", 10**6)
    whole = collected(lattice.scored(docs, path))
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"])
    for a, b in zip(sorted(got, key=key), sorted(whole, key=key), strict=True):
        assert a["score"] == pytest.approx(b["score"], rel=1e-9)


def test_long_words_are_spelled_like_short_ones(monkeypatch: pytest.MonkeyPatch) -> None:
    import time

    rng = random.Random(2)
    found = lattice.lattice(public_tokenizers.path("piece_bpe_32k.model"))
    values = np.log(np.random.default_rng(1).random((3, len(found.pieces) + 1)) / 1000)
    texts = ["".join(rng.choices("abcdé日 𝄞stiong", k=k)) for k in (300, 170, 161, 160, 159, 5, 0, 700, 2500)]
    monkeypatch.setattr(lattice, "BLOCK", 300)
    got = found.spelled(texts, values)
    monkeypatch.setattr(lattice, "LONG", 10**9)
    assert got == pytest.approx(found.spelled(texts, values))
    monkeypatch.undo()
    start = time.time()
    assert np.isfinite(found.spelled(["a" * 1_000_000], values[:1])).all() and time.time() - start < 60


def plain_lm(rows: list[tuple], path: str, out) -> list[float]:
    """Scores by enumerating segmentations."""
    tokens = lambda t: [*words(lower(t or "")), "\n"]
    learnt = [r for r in rows if not out(r[0])]
    labels = sorted({r[2] for r in learnt if r[2]}, key=lambda x: (-sum(r[2] == x for r in learnt), x))[: lattice.CLASSES]
    class_of = lambda r: labels.index(r[2]) if r[2] in labels else len(labels)
    shares = [sum(class_of(r) == k for r in learnt) / len(learnt) for k in range(len(labels) + 1)]
    vocabulary = lattice.vocabulary(path)
    p = {x: math.exp(v) for x, v in vocabulary.items()}
    p[None] = min(p.values()) * math.exp(2.5)  # all bytes
    prior = {x: v / sum(p.values()) for x, v in p.items()}

    def segmentations(word: str, p: dict):
        text = lattice.START + word
        for cuts in itertools.product((0, 1), repeat=len(text) - 1):
            at = [0, *(i for i, c in enumerate(cuts, 1) if c), len(text)]
            parts = [text[a:b] for a, b in itertools.pairwise(at)]
            options = [(p.get(x, 0.0), (p[None] / 256) ** len(x.encode()) if len(x) == 1 else 0.0) for x in parts]
            if all(map(sum, options)):
                yield parts, options, math.prod(map(sum, options))

    total = []
    for k in range(len(shares)):
        counts = collections.Counter(w for r in learnt if class_of(r) == k for w in tokens(r[1]))
        p = prior
        for _ in range(lattice.STEPS):
            new = collections.Counter({x: lattice.PRIOR * v for x, v in prior.items()})
            for w in counts:
                if w != "\n":
                    every = list(segmentations(w, p))
                    for parts, options, weight in every:
                        for x, (a, b) in zip(parts, options, strict=True):
                            share = weight / sum(e[2] for e in every) / (a + b)
                            new[x] += share * a
                            new[None] += share * b * len(x.encode())
            p = {x: v / sum(new.values()) for x, v in new.items()}
        n = sum(counts.values())
        known = {}
        for w in {w for r in rows for w in tokens(r[1])}:
            spelled = sum(e[2] for e in segmentations("\u2029" if w == "\n" else w, p))
            known[w] = math.log10((lattice.DISCOUNT * len(counts) / n if n else 1.0) * spelled + max(counts[w] - lattice.DISCOUNT, 0) / max(n, 1))
        total.append(known)
    out = []
    for r in rows:
        terms = [math.log10(s) + sum(known[w] for w in tokens(r[1])) for s, known in zip(shares, total, strict=True) if s]
        out.append(max(terms) + math.log10(sum(10 ** (x - max(terms)) for x in terms)))
    return out


def test_lm_scores_by_brute_force(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    rng = random.Random(6)
    vocab = ["".join(rng.choices("abeinst日é", k=rng.randint(1, 6))) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 25))), rng.choice(["en", "en", "de", None]), "s", 0) for i in range(60)] + [(None, "A unseen", "fr", "s", 0)]
    path = public_tokenizers.path("piece_bpe_32k.model")
    monkeypatch.setattr(lattice, "HEAD", 20)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["score"]) for r in collected(lattice.scored(frame(spark, rows), path)))
    want = plain_lm(rows, path, lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2)
    assert [x[2] for x in got] == pytest.approx(want, rel=1e-9)


# ---- archives

def pages_of(spark: SparkSession) -> tuple[DataFrame, list[tuple]]:
    rng = random.Random(4)
    rows = [(i, f"https://e.com/{i}", f"<p>{rng.randint(0, 30)} é WARC/1.1\r\n\r\nHTTP/1.1 200 OK\r\n\r\n</p>") for i in range(200)]
    rows += [(500, None, None), (501, "u", ""), (502, "a\r\nb", "x" * 100_000), (7, "https://again", rows[7][2]), (None, "n", "only here"), (None, "n", rows[3][2])]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, first long, digest string").repartition(3), rows


@pytest.mark.parametrize("least", [0, 40])
def test_warc_round_trip(spark: SparkSession, monkeypatch: pytest.MonkeyPatch, least: int) -> None:
    monkeypatch.setattr(warc, "SPLIT", 2000)
    pages, rows = pages_of(spark)
    first: dict = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = collections.Counter()
    for i, _, html in rows:
        body = (html or "").encode()
        again = first.get(html or "") not in (None, i) and len(body) >= least
        want[i, len(body), warc.payload_digest(body), "revisit" if again else "response", first[html or ""] if again else None] += 1
    got = collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in collected(warc.archived(pages, least)))
    assert got == want
    assert warc.payload_digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and hashlib.sha1(b"").hexdigest().startswith("da39")


def test_warc_pushes_predicates_and_skips_payloads(spark: SparkSession, tmp_path, monkeypatch: pytest.MonkeyPatch) -> None:
    import gzip

    pages, rows = pages_of(spark)
    folder = f"file://{tmp_path}/a"
    warc.write_archives(pages, folder)
    read = warc.read_archives(spark, folder, "warc_type string, record_id string, target_uri string, content_length long")
    one = read.where("warc_type = 'response' and target_uri in ('https://e.com/0', 'https://e.com/1')")
    assert one.count() == 2
    reader = warc.WarcReader(read.schema, {"path": folder})
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("warc_type",), "revisit"), GreaterThan(("content_length",), 5)]))
    assert [type(f) for f in left] == [GreaterThan] and reader.wanted == {"warc_type": {"revisit"}}
    calls: list = []
    monkeypatch.setattr(warc, "split_block", lambda *a: calls.append(a) or (0, b""))
    found = sum(len(b) for p in reader.partitions() for b in reader.read(p))
    assert found == read.where("warc_type = 'revisit'").count() and not calls
    other = tmp_path / "b"
    other.mkdir()
    with gzip.open(other / "x.warc.gz", "wb") as f:  # foreign archives have no index
        f.write(warc.record("response", "<urn:page:1>", "t", b"abc", warc.payload_digest(b"abc"), None, "2024-01-01T00:00:00Z"))
    monkeypatch.undo()
    (got,) = warc.read_archives(spark, f"file://{other}").collect()
    assert (got.payload, got.http_length, got.record_id) == (b"abc", 3, "<urn:page:1>")


def test_warc_reads_long_http_headers(spark: SparkSession, tmp_path) -> None:
    block = b"HTTP/1.1 200 OK\r\n" + b"".join(b"Set-Cookie: %d=%s\r\n" % (i, b"x" * 500) for i in range(90)) + b"Content-Length: 7\r\n\r\npayload"
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n".encode()
    data = head + block + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(data * 2)
    (tmp_path / "b.warc.gz").write_bytes(warc.member(data) * 3)
    found = warc.read_archives(spark, f"file://{tmp_path}", "record_id string, http_length long").collect()
    assert [r.http_length for r in found] == [7] * 5


def test_warc_joined_by_page(spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    pages, rows = pages_of(spark)
    key = lambda df: collections.Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_digest"]) for r in collected(df))
    one = key(warc.archived(pages))
    monkeypatch.setattr(warc, "SHARED", 0)
    assert key(warc.archived(pages)) == one


# ---- urls

def test_url_filter(spark: SparkSession) -> None:
    rows = [(i, f"http://h{i % 5}.example.{('com', 'net', 'org')[i % 3]}/{('en', 'es', 'fr', 'de')[i % 4]}/{i}?a={i}") for i in range(600)]
    rows += [(900, None), (901, ""), (902, "no scheme/en/"), (903, "HTTPS://WWW.Example.COM/en/x#y"), (904, "http://example.com"), (905, "http://xexample.com/en/"), (906, "http://a.net/es"), (907, "ftp://NET/es/?q"), (3, rows[3][1])]
    got = collected(urls.judged(spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, host string, rule string")))
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert (by[903]["host"], by[903]["path"], by[903]["rule"], by[903]["verdict"]) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert (by[904]["host"], by[904]["path"], by[904]["rule"]) == ("example.com", "", None)
    assert by[905]["rule"] == "com/" and by[906]["rule"] is None and by[907]["rule"] == "net/es/"
    assert all((by[i]["host"], by[i]["path"], by[i]["rule"]) == ("", "", None) and by[i]["verdict"] in ("allow", "block") for i in (900, 901, 902))
    long = collected(urls.judged(spark.createDataFrame([(None, "http://a.net/es/" + "x" * 100_000), (1, "http://b.com/" + "y" * 50_000), (None, None)], "page_id long, url string")))
    assert {(r["page_id"], r["rule"], r["verdict"]) for r in long} == {(None, "net/es/", "block"), (1, "com/", "allow"), (None, None, "allow")}
    rest = [r for r in got if r["rule"] is None and r["page_id"] < 600]
    assert {r["verdict"] for r in rest} == {"allow", "block"}
    labelled = [r for r in got if r["rule"]]
    assert sum((r["block_odds"] > 0) == (r["verdict"] == "block") for r in labelled) >= 0.97 * len(labelled)


def test_trees_generalise() -> None:
    rng = random.Random(9)
    make = lambda bad: f"http://{'x' * rng.randint(3, 9)}.org/{''.join(rng.choices('0123456789' if bad else 'abcdefgh', k=12))}"
    train, test = ([(make(b), b) for b in rng.choices([True, False], k=400)] for _ in range(2))
    model = urls.Boosted([u for u, _ in train], [b for _, b in train])
    assert np.mean((model.odds([u for u, _ in test]) > 0) == [b for _, b in test]) > 0.97
    assert urls.held_out_quality(*map(list, zip(*train, strict=True))) > 0.95
    noise = [(f"http://{'x' * rng.randint(3, 9)}{i}.org/a", rng.random() < 0.5) for i in range(400)]  # a label that nothing tells isn't learnt from itself
    assert 0.35 < urls.held_out_quality(*map(list, zip(*noise, strict=True))) < 0.65
    assert urls.Boosted([], []).odds(["a"])[0] < 0 and urls.Boosted(["http://a/b"], [True]).odds([None])[0] > 0


# ---- licences

def test_licenses(spark: SparkSession) -> None:
    grant, notice, as_is = (licenses.SENTENCES[k][0] for k in ("mit-grant", "mit-notice", "as-is"))
    texts = [None, "", "Nothing here.", "x.\nReleased under the MIT License.\nAll rights  RESERVED.", f"{grant}\n\n{notice}. {as_is}.", f"{as_is}. {notice}.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n http://x", "word " * 50_000 + ". Licensed under CC BY-NC 4.0!\r\n"]
    got = {r["doc_id"]: r for r in collected(licenses.scanned(frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])))}
    assert [got[i]["licenses"] for i in range(8)] == ["", "", "", "MIT,all-rights-reserved", "MIT", "", "Apache-2.0", "CC-BY-NC-4.0"]
    assert got[4]["n_unmatched"] == 0 and got[5]["n_unmatched"] == 2 and got[0]["n_sentences"] == 0
    plan = licenses.scanned(frame(spark, []))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_wrapped_licenses(spark: SparkSession) -> None:
    import textwrap

    of = lambda *names: [licenses.SENTENCES[k][0] for k in names]
    mit = [f"{x}{end}" for x, end in zip(of("mit-grant", "mit-notice", "as-is"), ("", ".", ". IN NO EVENT SHALL THE AUTHORS BE LIABLE."), strict=True)]
    bsd = [f"{mark}{x}." for mark, x in zip(("", "1. ", "2. ", "3. "), of("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"), strict=True)]
    gpl = [f"{of('gpl-redistribute')[0]}.", f"{of('gpl-warranty')[0]}; without even the implied warranty of MERCHANTABILITY."]
    texts, want = [], []
    for parts, name in ((mit, "MIT"), (bsd, "BSD-3-Clause"), (gpl, "GPL-3.0-or-later")):
        for width in (70, 80):
            for mark in ("", "# ", " * ", "// ", ";; ", "dnl ", "    "):
                lines = [x for p in parts for x in [*textwrap.wrap(p, width), ""]]
                for end in ("\n", "\r\n"):
                    texts.append("Title" + end + end.join(mark + x for x in ["", *lines, "the code"]))
                    want.append(name)
    isc = f"ISC License\n\nCopyright (c) 2020 A\n\n{textwrap.fill(licenses.SENTENCES['isc-grant'][0] + '.', 72)}\n\n{textwrap.fill(licenses.SENTENCES['isc-as-is'][0] + '. IN NO EVENT SHALL THE AUTHOR BE LIABLE.', 72)}\n"
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */\n"
    gpl2 = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.,\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n"
    zlib = "This software is provided 'as-is', without any express or implied\nwarranty. In no event.\n\n" + textwrap.fill(licenses.SENTENCES["zlib-grant"][0], 70) + "\n\n1. The origin"
    grant = "Permission is hereby granted: " + licenses.SENTENCES["mit-grant"][0]
    texts += [isc, mpl, gpl2, zlib, "(b) Licensed under CC BY 4.0\n" + grant, "=" * 1500 + " Released under the MIT License", "This is free and unencumbered software released into the public\ndomain."]
    want += ["ISC", "MPL-2.0", "GPL-2.0", "Zlib", "MIT,CC-BY-4.0", "MIT", "Unlicense"]
    texts.append("Released under the\n\nMIT License")  # a blank line ends a sentence
    want.append("")
    got = {r["doc_id"]: r for r in collected(licenses.scanned(frame(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])))}
    assert [got[i]["licenses"] for i in range(len(texts))] == want
    # the SQL finds the same
    import duckdb

    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", [*enumerate(texts), (len(texts), None)])
    rows = con.execute(licenses.oracle()).fetchall()
    columns = [c[0] for c in con.description]
    assert all(dict(zip(columns, r, strict=True)) == got[r[0]] for r in rows if r[0] in got) and len(rows) == len(texts) + 1


# ---- fingerprints

def test_fingerprints(docs: DataFrame, rows: list[tuple], spark: SparkSession, monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(fingerprint, "RANGE", 20)
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or ""))
    want = collections.Counter()
    for i, r in enumerate(order):
        text, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 4
        want[r[0], len(text), hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest()] += 1
    got = collected(fingerprint.fingerprinted(docs))
    assert len(got) == len(rows)
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got if r["doc_id"] is not None) == want
    by_text: dict = {}
    for r in got:
        by_text.setdefault(next(x[1] or "" for x in rows if x[0] == r["doc_id"]), set()).add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(v) == 1 for v in by_text.values())
    long = [r for r in got if r["n_chars"] > 800]
    assert np.mean([r["near_edited"] for r in long]) > 0.6
    one = collected(fingerprint.fingerprinted(frame(spark, [(5, "abcd efgh", "en", "s", 0)])))
    assert one[0]["edited_sha256"] == hashlib.sha256(b"abcd efab").hexdigest()


def plain_sketch(text: str) -> tuple[frozenset, frozenset]:
    """All hashed shingles of a text, and those that the sketch keeps, by plain integers."""
    import xxhash

    top = 2**64
    w = [xxhash.xxh3_64_intdigest(x.encode()) for x in words(lower(text))]
    k = min(5, len(w))
    every = set()
    for i in range(len(w) - k + 1 if w else 0):
        h = k
        for x in w[i : i + k]:
            h = (h * 0x9E3779B97F4A7C15 + x) % top
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % top
        h = (h ^ h >> 27) * 0x94D049BB133111EB % top
        every.add(h ^ h >> 31)
    return frozenset(every), frozenset(h >> 13 for h in every if h < top // fingerprint.SCALE)


def test_fingerprints_by_brute_force(docs: DataFrame, rows: list[tuple], monkeypatch: pytest.MonkeyPatch) -> None:
    monkeypatch.setattr(fingerprint, "RANGE", 30)
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] or ""))

    def near(a: str, b: str) -> float:
        (all_a, a_kept), (all_b, b_kept) = plain_sketch(a), plain_sketch(b)
        return 1.0 if all_a == all_b else len(a_kept & b_kept) / len(a_kept) if a_kept else 0.0

    want = collections.Counter()
    for i, r in enumerate(order):
        text, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 4
        want[r[0], len(text), round(near(text, text[: len(text) - k] + after[:k]), 9), round(near(text, after), 9)] += 1
    got = [r for r in collected(fingerprint.fingerprinted(docs)) if r["doc_id"] is not None]
    assert collections.Counter((r["doc_id"], r["n_chars"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == want
    text_of = {r[0]: r[1] or "" for r in rows}
    assert all(frozenset(fingerprint.kept(r["fingerprint"]).tolist()) == plain_sketch(text_of[r["doc_id"]])[1] for r in got)


def test_sketches_estimate_containment() -> None:
    cache = common.WordHashes()
    w = [f"w{i}" for i in range(6000)]
    part, whole = fingerprint.fingerprint(" ".join(w[:1500]).encode(), cache), fingerprint.fingerprint(" ".join(w).encode(), cache)
    assert fingerprint.likeness(part, whole)[0] == 1.0 and abs(fingerprint.likeness(whole, part)[0] - 0.25) < 0.06
    other = fingerprint.fingerprint(" ".join(w[1000:3000]).encode(), cache)
    assert set(fingerprint.merged(part, other)) == set(fingerprint.kept(part)) | set(fingerprint.kept(other))


# ---- empty tables

def test_empty_tables(empty: DataFrame, spark: SparkSession) -> None:
    word, piece = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for found in (quality.judged(empty), jaccard.linked(empty), mixing.mixed(empty), mixing.taken(empty), packing.packed(empty, word), langid.identified(empty), lattice.scored(empty, piece), licenses.scanned(empty), fingerprint.fingerprinted(empty), warc.archived(pages), urls.judged(pages)):
        assert found.count() == 0


def test_no_local_folder_on_a_cluster() -> None:
    class Conf(dict):
        get = dict.get

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())
