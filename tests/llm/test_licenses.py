"""Licences of texts that are known beforehand, in Spark and in SQL: what a rule takes keeps its neighbours apart."""

from __future__ import annotations

import duckdb
import pyarrow as pa

from gleanworks.llm import licenses

MIT = ["mit-grant", "mit-notice", "as-is"]
#: Sentences of a text, the licences that it holds, and how many sentences no rule takes.
CASES = [
    (["gpl-redistribute", *MIT, "gpl-warranty"], "MIT,GPL-3.0-or-later", 1),
    (["bsd-redistribution", *MIT, "bsd-source", "bsd-binary"], "MIT", 3),
    (["bsd-redistribution", "bsd-source", "bsd-binary"], "BSD-2-Clause", 0),
    (["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"], "BSD-3-Clause", 0),
    (["gpl-redistribute", "gpl-warranty"], "GPL-3.0-or-later", 0),
    ([*MIT, *MIT], "MIT", 0),
    (["isc-grant", "mit-ref", "isc-as-is"], "MIT,ISC", 1),
    (["wtfpl-title", "wtfpl-copying"], "WTFPL", 0),
    (["apache-grant"], "Apache-2.0", 0),
    (["mit-notice", "as-is"], "", 2),
    ([], "", 0)
]


def text_of(ids: list[str]) -> str:
    return "\n".join(f"Some words here.\n{licenses.SENTENCES[i][0]}." for i in ids) + "\nAnd an end"


def test_a_rule_takes_sentences_that_stand_together(spark):
    texts = [text_of(ids) for ids, *_ in CASES]
    # sentences in one paragraph, and quotes as entities
    texts += ["\n".join(licenses.SENTENCES[i][0].replace('"', "&quot;") + "." for i in MIT), None, ""]
    want = [(names, n) for _, names, n in CASES] + [("MIT", 0), ("", 0), ("", 0)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scanned(docs).collect()}
    found = [(got[i]["licenses"], got[i]["n_unmatched"]) for i in range(len(texts))]
    plain = [f"{i}: {f} {w}" for i, (f, w) in enumerate(zip(found, want)) if (set(f[0].split(",")), f[1]) != (set(w[0].split(",")), w[1])]
    assert not plain, plain
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": list(range(len(texts))), "text": texts}))
    rows = con.execute(licenses.oracle()).fetchall()
    assert sorted(rows) == sorted(tuple(r) for r in got.values())
