"""The conversation trie against a plain one, with nulls, ties, repeats, negative ids and families in parts."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from gleanworks.llm import tries
from tests.conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows: list[tuple]) -> list[tuple]:
    """The contract, node by node."""
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            said[conv].append(((turn is not None, turn or 0, role, digest), (role, text)))
    own = {c: [x for _, x in sorted(v, key=lambda z: z[0])] for c, v in said.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children = defaultdict(list)
    for n in members:
        if n:
            children[n[:-1]].append(n)
    leaves, saved, out = {}, {}, []
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in children[n]) or 1
        saved[n] = sum(saved[k] for k in children[n]) + (len(members[n]) - 1) * (len(n[-1][1].encode()) if n else 0)
        ids = ",".join(str(c) for c in members[n] if len(built[c]) == len(n))
        out.append((members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), len(children[n]), leaves[n], saved[n], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df, **how) -> list[tuple]:  # noqa: ANN001
    return sorted((tuple(r) for r in tries.trie(df, **how).collect()), key=str)


@pytest.mark.parametrize(("family", "chunk"), [(50_000, 50_000), (3, 2)])
def test_trie_equals_a_plain_one(spark, family, chunk):
    draw = random.Random(5)
    rows = [
        (draw.choice([None, *range(-12, 40)]), draw.choice([None, *range(11)]), draw.choice([None, "u", "a"]), draw.choice([None, "", "x", "é"]))
        for _ in range(900)
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("node", df_col())
    assert found(df, family=family, chunk=chunk) == plain(rows)


def df_col():
    """A column of a name that the operator uses itself."""
    from pyspark.sql import functions as F

    return F.lit("extra")


def test_trie_of_copies_and_of_one_long_conversation(spark):
    rows = [(c, t, "u", f"same {t}") for c in range(0, 400, 5) for t in range(4)] + [(c + 1, 0, "u", "x") for c in range(0, 400, 5)] + [(1003, t, "a", str(t)) for t in range(700)]
    assert found(spark.createDataFrame(rows, SCHEMA), family=2, chunk=3) == plain(rows)


def test_trie_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    assert found(df) == plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_trie_of_nothing(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    assert found(spark.createDataFrame([(None, 1, "u", "x")], SCHEMA)) == []
