"""Alignment by segments against whole encodings, with odd white space, null texts, repeats and ties."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gleanworks.llm import alignment
from tests.conftest import SF

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = [
    " ", "  ", "\n", "\t", "\r\n", " ", "　", "\x1c", "\x85", " ", "\x00", "a", "the", "ing", "é", "中", "😀", "'s", "'", "1", "23",
    "<|endoftext|>", "<0x0A>", "</s>", ".", " .", "▁", "foo", "ß", "​", ";\r", "  \n", "🏳️‍🌈"
]


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(A, B)


def texts(n: int, longest: int = 14) -> list[str]:
    draw = random.Random(3)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, longest))) for _ in range(n)]


def tokens(pair, text):
    """Both tokenizers' ids of a whole text, or None where they don't spell it."""
    if not text:
        return None
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    spelled = [b"".join(pair.bytes_a[i] for i in a), b"".join(pair.bytes_b[i] for i in b)]
    return (a, b) if spelled == [(" " + text).encode()] * 2 else None


def plain(pair, rows):
    """The contract on whole texts: offsets, links, counts."""
    found, counts = [], Counter()
    for _, text in rows:
        t = tokens(pair, text)
        if t is None:
            found.append(None)
            continue
        ends = []
        for ids, size in ((t[0], pair.bytes_a), (t[1], pair.bytes_b)):
            at, out = 0, []
            for i in ids:
                at += len(size[i])
                out.append(at)
            ends.append(out)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        links = [(a, b) for a, e in zip(t[0], ends[0]) for b, f in zip(t[1], ends[1]) if e == f] if len(t[0]) < 300 else [
            (t[0][ends[0].index(c)], t[1][ends[1].index(c)]) for c in cuts
        ]
        counts.update(links)
        groups, last = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, e in zip(ids, out) if last < e <= c) for ids, out in zip(t, ends)))
            last = c
        found.append((len(t[0]), len(t[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    out = []
    for (doc_id, _), f in zip(rows, found):
        if f is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, g, links, digest = f
            out.append((doc_id, a, b, g, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_segments_are_cut_where_no_token_crosses(pair):
    assert pair.separators == " \t\n"
    for text in texts(8000):
        segments, whole = pair.segments(text), tokens(pair, text)
        assert bool(segments) == (whole is not None), text
        if segments:
            ids = pair.encoded(segments)
            assert "".join(segments) == " " + text
            assert (sum((a for a, _ in ids), []), sum((b for _, b in ids), [])) == whole, text


@pytest.mark.parametrize(("head", "most"), [(300_000, 4_000_000), (5, 4_000_000), (0, 3)])
def test_alignment_equals_a_plain_one(spark, pair, head, most):
    rows = [(i % 50, t) for i, t in enumerate(texts(250, 9))] + [(None, "the foo"), (7, None), (7, None), (8, ""), (9, "x" * 5000), (9, "x" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("segment", F.lit(1)).repartition(3)
    assert rows_of(alignment.compared(df, A, B, head, most)) == plain(pair, rows)


def test_alignment_of_the_table(spark, pair):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows_of(alignment.compared(df, A, B)) == plain(pair, [tuple(r) for r in df.select("doc_id", "text").collect()])


def test_codes_are_as_they_were():
    draw = random.Random(5)
    for most in (1, 127, 128, 300_000, 2**31 - 1):
        for n in (1, 2, 500):
            codes = [0, *(draw.randint(0, most) for _ in range(n)), most]
            assert alignment.inflated(alignment.deflated(codes)).tolist() == codes
    assert alignment.inflated(alignment.deflated([0])).tolist() == [0]
    assert alignment.deflated([]) == b""


def test_packed_segments_are_as_they_were(spark):
    rows = [(r, p, s) for r, p, s in [(1, 0, "a"), (1, 10, "b"), (2, 123, "a"), (3, 7, "c")]]
    found = {"a": (1, 1, 1, 0, 7, "5|60"), "b": (2, 3, 1, 10, 12_345_678_901_234, "1,2|3,4,5"), "c": (12, 1, 2, 1, 0, "0|0;1,22|3")}
    aligned = spark.createDataFrame([(s, 1, *v) for s, v in found.items()], "segment string, n long, n_a long, n_b long, n_groups long, n_best long, count_sum long, groups string")
    own = alignment.own_segments(spark.createDataFrame(rows, "row long, place int, segment string"), aligned).collect()
    got = sorted((row, place, (*values, groups.decode())) for row, (place, values, groups) in ((x.row, alignment.unpacked(x.own)) for x in own))
    assert got == sorted((r, p, found[s]) for r, p, s in rows)


def test_what_is_joined_back_is_small(spark, pair, monkeypatch):
    """Bytes of codes and of joined alignments, which are most of the query's disk (4 times its input before they were packed)."""
    kind, tables, joined = type(spark.range(0)), {}, []
    materialize, with_arrow = alignment.materialize, kind.mapInArrow
    monkeypatch.setattr(alignment, "materialize", lambda df, what, *a: tables.setdefault(what, materialize(df, what, *a)))
    monkeypatch.setattr(kind, "mapInArrow", lambda df, *a, **b: (joined.append(df) if "own" in df.columns else None, with_arrow(df, *a, **b))[1])
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    made = rows_of(alignment.compared(df, A, B, 3000))
    segments = sum(len(pair.segments(r.text)) for r in df.collect())
    assert tables["coded"].agg(F.sum(F.octet_length("codes"))).first()[0] < 1.85 * segments
    lengths = joined[0].select(F.explode("own").alias("own")).agg(F.count("*"), F.sum(F.octet_length("own"))).first()
    groups = tables["coded"].where("segment is not null").join(tables["aligned"], "segment").agg(F.count("*"), F.sum(F.octet_length("groups"))).first()
    assert lengths[0] == groups[0] > 1000
    assert lengths[1] < 0.8 * groups[1]
    monkeypatch.undo()
    assert made == rows_of(alignment.compared(df, A, B))  # which is compared with whole texts above


def test_alignment_of_nothing(spark):
    assert rows_of(alignment.compared(spark.createDataFrame([], "doc_id long, text string"), A, B)) == []
    assert rows_of(alignment.compared(spark.createDataFrame([(1, None)], "doc_id long, text string"), A, B)) == [(1, 0, 0, 0, 0, 0, 0, "")]
