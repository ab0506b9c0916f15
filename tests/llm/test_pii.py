"""Personal data: base spans against the plain patterns, what the method adds on texts with known spans, edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from gleanworks.llm import pii
from tests.conftest import SF

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"
}


def checked(kind: str, text: str) -> bool:
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(digits[::-1]))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain(text: str | None) -> list[tuple]:
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if checked(k, m.group())]


def card(draw: random.Random, good: bool) -> str:
    body = "4" + "".join(draw.choice("0123456789") for _ in range(14))
    (last,) = (c for c in "0123456789" if checked("card", body + c))
    return body + (last if good else str((int(last) + 1) % 10))


@pytest.fixture(scope="module")
def corpus():
    """Texts with the spans that the method has to add, and decoys."""
    draw = random.Random(4)
    rows = []
    words = "than in the onea keit und ment que ción reti".split()
    prose = lambda: " ".join(draw.choice(words) for _ in range(6))
    number = lambda n: "".join(draw.choice("23456789") for _ in range(n))
    for i in range(400):
        kind = i % 10
        hidden = None
        if kind == 0:
            middle, hidden = f"{draw.choice(words)}.{number(2)}@mail{i % 9}.example.com", None
        elif kind == 1:
            middle = f"+1 ({number(3)}) 555-{number(4)}"
        elif kind == 2:
            middle = card(draw, True)
        elif kind == 3:
            middle = ".".join(str(draw.randint(40, 255)) for _ in range(4))
        elif kind == 4:
            middle = card(draw, False)  # a number that isn't a card's
        elif kind == 5:
            middle = f"version {draw.randint(1, 9)}.{draw.randint(0, 9)}.{draw.randint(256, 999)}.{draw.randint(0, 9)}"
        elif kind == 6:
            hidden = f"{draw.choice(words)}.{number(2)} [at] mail dot example dot com"
            middle = f"mail {hidden}"
        elif kind == 7:
            hidden = f"({number(3)}) 555-{number(4)}"
            middle = f"call {hidden}"
        elif kind == 8:
            first, second = card(draw, True), card(draw, False)
            middle, hidden = f"{first} {second}", first
            if checked("card", middle):
                continue
        else:
            middle = f"order {number(3)} {number(3)} {number(3)}"
        text = f"{prose()} {middle} {prose()}"
        rows.append((i, kind, text, hidden))
    return rows


def test_base_spans_are_those_of_the_plain_patterns():
    draw = random.Random(1)
    parts = ["@", "a", "b.c", ".", "-", " ", "1", "22", "255", "0007", "4111111111111111", "+", "+1", "(", ")", "555", "é", "٣", "%", "_", "x@y.z", "0000", " 4"]
    for _ in range(20_000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 16)))
        assert [(s.kind, s.start, s.end) for s in pii.base_spans(text)[0]] == plain(text), text


def test_added_spans_are_right_and_decoys_stay(spark, corpus):
    docs = spark.createDataFrame([(i, t) for i, _, t, _ in corpus], "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.detected(docs).collect()}
    right = wrong = 0
    for i, kind, text, hidden in corpus:
        assert [(s["kind"], s["start"], s["end"]) for s in found[i] if s["base"]] == plain(text)
        added = [text[s["start"] : s["end"]] for s in found[i] if not s["base"]]
        if hidden:
            right += added == [hidden]
        else:
            wrong += bool(added)
    wanted = sum(1 for *_, hidden in corpus if hidden)
    assert right >= 0.9 * wanted and wrong <= 0.02 * len(corpus), (right, wanted, wrong)


def test_labelers_that_err_are_found_unreliable():
    """Votes drawn with known reliabilities: expectation-maximisation finds which labeler to trust."""
    draw = random.Random(9)
    counts: dict[tuple, int] = {}
    for i in range(20_000):
        base, yes = i % 4 == 0, i % 4 == 0 or draw.random() < 0.3
        good = "+" if draw.random() < (0.9 if yes else 0.1) else "-"
        test = "+" if draw.random() < (0.95 if yes else 0.2) else "-"
        noise = draw.choice("+-")
        key = (f"{good}{test}00{noise}000", base)
        counts[key] = counts.get(key, 0) + 1
    table, share, p = pii.reliabilities([(v, b, n) for (v, b), n in counts.items()])
    assert abs(share - 0.3) < 0.03
    assert abs(table[0, 1, 2] - 0.9) < 0.03 and abs(table[0, 0, 2] - 0.1) < 0.03 and abs(table[4, 1, 2] - 0.5) < 0.03
    assert p["++00+000"] > 0.9 > 0.1 > p["--00+000"]


def test_digest_columns(spark):
    text = "Ünd a.1@b.org +1 (234) 555-7890, 10.0.0.1"
    rows = [(1, text), (1, text), (None, text), (2, None), (3, ""), (4, "no data")]
    got = pii.digested(pii.detected(spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("kind", F.lit("x")))).collect()
    base = ",".join(f"{k}:{a}:{b}" for k, a, b in plain(text))
    want = (1, 1, 0, 1, hashlib.sha256(base.encode()).hexdigest(), base, 0)
    nothing = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0)
    assert sorted((tuple(r) for r in got), key=str) == sorted([(1, *want), (1, *want), (None, *want), (2, *nothing), (3, *nothing), (4, *nothing)], key=str)
    assert pii.digested(pii.detected(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_base_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {(r["doc_id"], r["base_sha256"]) for r in pii.digested(pii.detected(docs)).collect()}
    want = {(r["doc_id"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in plain(r["text"])).encode()).hexdigest()) for r in docs.collect()}
    assert got == want


@pytest.mark.parametrize("text", ["1", "a@", "+", "1 ", "a.b@", "( at", "1.", " at", ":", "[ at", "+1 ", "4111 1111 1111 1111 ", "(555) 123-4567 "])
def test_long_texts_take_linear_time(text):
    began = time.time()
    pii.spans_of(text * (400_000 // len(text)))
    assert time.time() - began < 20
