"""Versions, walks, discovery, catalog, configuration and the command line."""

from __future__ import annotations

import http.server
import json
import threading
from collections.abc import Iterator
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanworks.operators import catalog, discovery, linkage, store, versions
from gleanworks.plans import app, config, part_queries
from gleanworks.sources import files, http as transport, payloads
from gleanworks.streaming import upserts

STORE = upserts.STORE


def rows_of(spark: SparkSession, *keys: str):
    return spark.createDataFrame([tuple(k if c in ("id", "dedup_key", "title") else "" for c in store.COLUMNS) for k in keys], STORE)


# ---- versions

def test_a_late_writer_starts_over(spark: SparkSession, tmp_path: Path) -> None:
    table = versions.Versions(spark, f"file://{tmp_path}/s", STORE)
    assert table.read().count() == 0
    seen = []

    def slow(now):
        if not seen:  # another writer commits while this one works
            versions.Versions(spark, f"file://{tmp_path}/s", STORE).change(lambda _: rows_of(spark, "a"))
        seen.append(now.count())
        return now.unionByName(rows_of(spark, "b"))

    assert table.change(slow) == 2 and seen == [0, 1]
    assert {r.dedup_key for r in table.read().collect()} == {"a", "b"}
    assert table.change(lambda now: rows_of(spark, "c"), mark=("x", 3)) == 3 and table.change(lambda now: rows_of(spark), mark=("x", 2)) == 3
    assert not table._claim(3, "{}")
    with pytest.raises(versions.NothingHarvested):
        versions.guarded(rows_of(spark), [("lever", "OSError")])
    assert versions.guarded(rows_of(spark), []).count() == 0


def test_commits_by_rename_and_vacuum(spark: SparkSession, tmp_path: Path) -> None:
    table = versions.Versions(spark, f"file://{tmp_path}/s", STORE)
    table.linked = False  # as on a file system without hard links
    for key in "abcd":
        table.change(lambda now, key=key: now.unionByName(rows_of(spark, key)))
    assert not table._claim(4, "{}") and not table._claim(2, "{}") and table.commits() == [1, 2, 3, 4]
    # a writer that died before its rename leaves no commit, only a part that nobody reads
    (tmp_path / "s" / "commits" / ".00000000000000000005.x.part").write_text("")
    assert table.state()[0] == 4 and table.read().count() == 4
    assert table.vacuum() == []  # all is younger than a day
    assert len(table.vacuum(keep=2, hours=0)) == 2 and table.read().count() == 4 and table.read(table.state(3)[1]).count() == 3


def test_sheet_is_replaced_whole(spark: SparkSession, tmp_path: Path) -> None:
    path = f"{tmp_path}/list.csv"
    for keys in (("a", "b"), ("c",)):
        versions.write_sheet(rows_of(spark, *keys).withColumn("signals", F.lit('x "y", z')).withColumn("note", F.lit("")), path)
        assert {(r.id, r.signals, r.url) for r in files.store_csv(spark, path).collect()} == {(k, 'x "y", z', "") for k in keys}
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["list.csv"]


# ---- walks

@pytest.fixture(scope="module")
def server() -> Iterator[str]:
    class Handler(http.server.BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_GET(self) -> None:  # noqa: N802
            path, _, query = self.path.partition("?")
            at = int(dict(x.split("=") for x in query.split("&") if x).get("offset", 0))
            status, to, body = 200, None, b""
            if path == "/moved":
                status, to = 302, "/a?offset=4"
            elif path == "/loop":
                status, to = 302, "/loop"
            elif path == "/gone":
                status = 404
            elif path == "/next":
                body = json.dumps({"results": [1], "next": f"http://{self.headers['Host']}/next?offset={at + 1}" if at < 2 else "http://other.example/x"}).encode()
            elif path == "/total":
                body = json.dumps({"content": [1, 2], "totalFound": 4 if at == 0 else 0}).encode()
            else:
                body = json.dumps({"content": [1, 2] if at < 4 else [1]}).encode()
            self.send_response(status)
            if to:
                self.send_header("Location", to)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_POST(self) -> None:  # noqa: N802
            at = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["offset"]
            body = json.dumps({"total": 5 if at == 0 else 0, "jobPostings": [{"title": f"t{at + i}"} for i in range(2 if at < 4 else 1)]}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_: object) -> None:
            return

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}"
    server.shutdown()


def test_transport(server: str) -> None:
    assert json.loads(transport.request(f"{server}/moved")) == {"content": [1]}
    assert transport.fetch(f"{server}/gone") == (404, None) and transport.fetch("http://127.0.0.1:1/x") == (None, None)
    with pytest.raises(OSError, match="redirects"):
        transport.request(f"{server}/loop")
    with pytest.raises(transport.Refused):
        transport.request(f"{server}/gone")
    for c in transport.POOL.open.values():
        c.sock.close()  # a stale connection is tried once more on a new one
    assert transport.fetch(f"{server}/a?offset=0")[0] == 200


def test_walks(spark: SparkSession, server: str) -> None:
    pages = lambda *a: [(n, raw is not None, status) for n, raw, status in transport.walk(transport.fetch, *a)]
    assert pages(f"{server}/a?offset={{offset}}", "short", 9, 2, "content") == [(0, True, 200), (1, True, 200), (2, True, 200)]
    assert pages(f"{server}/a?offset={{offset}}", "short", 2, 2, "content") == [(0, True, 200), (1, True, 200)]
    assert pages(f"{server}/total?offset={{offset}}", "short", 9, 2, "content", "totalFound") == [(0, True, 200), (1, True, 200)]
    assert pages(f"{server}/next?offset={{offset}}", "next", 9, 1, "results") == [(0, True, 200), (1, True, 200), (2, True, 200)]
    assert pages(f"{server}/gone", "short", 9, 2, "content") == [(0, False, 404)]
    asked: list[str] = []
    told = lambda url: (asked.append(url), (200, json.dumps({"page": {"next": "a&b"} if len(asked) == 1 else {}})))[1]
    assert len(list(transport.walk(told, "http://h/x?t={token}", "token", 9, 1, "", "page.next"))) == 2 and asked == ["http://h/x?t=", "http://h/x?t=a%26b"]
    posted = [json.loads(raw) for _, raw, _ in transport.walk(transport.fetch, f"{server}/jobs", "short", 9, 2, "jobPostings", "total", '{"limit": 2, "offset": {offset}}')]
    assert [x["title"] for p in posted for x in p["jobPostings"]] == ["t0", "t1", "t2", "t3", "t4"]
    spark.dataSource.register(transport.WalkSource)
    rows = spark.read.format("walk").options(template=f"{server}/{{slug}}?offset={{offset}}", slugs="a,gone", size=2, items="content").load().collect()
    assert sorted((r.slug, r.seq, r.status, r.raw is None) for r in rows) == [("a", 0, 200, False), ("a", 1, 200, False), ("a", 2, 200, False), ("gone", 1_000_000, 404, True)]


# ---- details, containment, linkage as a stream

def test_details_keep_types_and_rows(spark: SparkSession) -> None:
    listed = spark.createDataFrame([("k", "T", 5.0, ["x"], ""), ("z", "U", None, None, "old"), (None, "V", None, None, "")], "detail_key string, title string, salary_min double, tags array<string>, text string")
    found = spark.createDataFrame([("k", None, "body"), ("k", None, "body"), ("z", 7.0, "")], "detail_key string, salary_min double, text string")
    out = payloads.with_details(listed, found)
    assert dict(out.dtypes) == dict(listed.dtypes)
    assert {(r.title, r.salary_min, r.text) for r in out.collect()} == {("T", 5.0, "body"), ("U", 7.0, "old"), ("V", None, "")} and out.count() == 3


def test_contained_passages_of_any_length(spark: SparkSession) -> None:
    texts = {1: "in New York now", 2: "in NewYork", 3: "xNew Yorkx", 4: None, 5: "", 6: "a b c d e", 7: "za b c dz"}
    passages = {10: "New York", 11: "York", 12: "in New York", 13: "a b c d", 14: "b c", 15: "zz top b", 16: None}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    items = spark.createDataFrame([(k, v) for k, v in passages.items() if v is not None], "item_id long, passage string")
    want = {(d, i) for d, t in texts.items() for i, p in passages.items() if t is not None and p is not None and p in t}
    for block in (1, 2, 200):
        assert {tuple(r) for r in part_queries.contained(docs, items, block).collect()} == want


def test_linkage_as_a_stream_equals_batches(spark: SparkSession, tmp_path: Path) -> None:
    titles = ["Data Engineer", "Data Engineer II", "Senior Data Engineer", "Engineer, Data", "Data Engineers", "Chef", "Data Engineer (Berlin)"]
    rows = [(i, titles[i * 5 % 7], ["Acme Inc", "Acme", "Other"][i % 3], "Oslo" if i % 4 else "Bergen", "", f"src{i % 2}", "text" * (i % 5), i % 9) for i in range(40)]
    schema = "seq long, title string, company string, location string, url string, source string, text string, score int"
    whole = spark.createDataFrame(rows, schema)
    want = {(r.dedup_key, tuple(r.sources)) for r in linkage.linked(whole).collect()}
    for n in range(4):
        whole.where(F.floor(F.col("seq") / 10) == n).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    found: dict[str, tuple] = {}
    stream = upserts.linked_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.outputMode("update").foreachBatch(lambda df, _: found.update({r.dedup_key: tuple(r.sources) for r in df.collect()})).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None and {k.split("|")[0] for k in found} == {k.split("|")[0] for k, _ in want}
    # arrival within the stream's state: the survivors are those of a plain fold over all rows
    keyed = [r.asDict() for r in linkage.with_keys(whole).orderBy("seq").collect()]
    plain: dict = {}
    for r in keyed:
        row = {**r, "sources": [r["source"]], "_levels": list(r["_levels"])}
        key = (r["_blk"], tuple(r["_levels"]))
        kept = linkage.join_one(plain.get(key, []), row, 90, 82)
        plain[key] = [{k: v for k, v in x.items() if k != "_hit"} for x in kept]
    assert {k: v for k, v in found.items()} == {x["dedup_key"]: tuple(x["sources"]) for kept in plain.values() for x in kept}


def test_streamed_linkage_packs_many_companies_into_few_states(spark: SparkSession, tmp_path: Path) -> None:
    titles = ["Data Engineer", "Engineer, Data", "Chef", "Data Engineers", "Cook"]
    rows = [(i, titles[i * i % 5], f"Firm {i % 60}", "", "", f"src{i % 2}", "t" * (i % 5), i % 4) for i in range(300)]
    schema = "seq long, title string, company string, location string, url string, source string, text string, score int"
    whole = spark.createDataFrame(rows, schema)
    want = {(r.dedup_key, tuple(r.sources)) for r in linkage.linked(whole).collect()}
    for n in range(3):
        whole.where(F.floor(F.col("seq") / 100) == n).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    files_of = sorted(tmp_path.joinpath("in").glob("*.parquet"), key=lambda p: p.stat().st_mtime_ns)
    assert len(files_of) == 3
    found: dict[str, tuple] = {}
    fresh: list[str] = []

    def take(df: DataFrame, _: int) -> None:
        for r in df.collect():
            found[r.dedup_key] = tuple(r.sources)
            fresh.extend([r.dedup_key] * r.fresh)

    stream = upserts.linked_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), shares=7)
    query = stream.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None and set(found.items()) == want and sorted(fresh) == sorted(found)
    assert 0 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 7


# ---- discovery, catalog

def test_watchlists_grow_but_examples_do_not(spark: SparkSession, tmp_path: Path) -> None:
    path = tmp_path / "w.json"
    path.write_text(json.dumps({"_comment": "mine", "companies": [{"name": "A", "ats": "lever", "slug": "A"}]}))
    entries = spark.createDataFrame([("lever", "a", None, None), ("workday", "t", "wd1", "S1"), ("workday", "t", "wd1", "S2"), ("workday", "T", "wd1", "s2")], "ats string, slug string, host string, site string")
    new = discovery.append_watchlist(discovery.watch_entries(entries.withColumn("entry_key", F.lit("")), "(seeded)"), str(path))
    assert [(e["slug"], e["site"]) for e in new] == [("t", "S1"), ("t", "S2")] and json.loads(path.read_text())["_comment"] == "mine"
    assert files.watchlist_json(spark, str(path))[0].count() == 3
    example = tmp_path / "w.example.json"
    example.write_text('{"companies": []}')
    assert discovery.append_watchlist(discovery.watch_entries(entries.withColumn("entry_key", F.lit("")), "x"), str(example)) == [] and json.loads(example.read_text()) == {"companies": []}


def test_profiles_and_index(spark: SparkSession) -> None:
    doc = catalog.draft("board", catalog.measured_values("query:\n  title_search: true\nfreshness:\n  pct_within_100d: 0.5  # bar\n"), {"jobTitle": "T", "description": "x" * 700, "odd": 1})
    assert "  title_search: true" in doc and "  pct_within_100d: 0.5\n" in doc and "  title: { path: jobTitle, type: str }" in doc and "unmapped keys in the record: odd" in doc and "truncated, 700 chars" in doc
    index = "| source | status | title? | rows |\n|---|---|---|---|\n| [a](a.md) | 🔵 x | no | 5 |\n| b | 🟡 | yes | 6 |\n\n| source | notes |\n|---|---|\n| a | free |"
    profile = lambda s, t: {"status": s, "license": {"commercial_use": "unknown"}, "query": {"title_search": t, "param_validation": "unknown"}}
    profiles = {"a": profile("wired", True), "b": profile("evaluated", "true"), "c": profile("dead", False)}
    drift, mended = catalog.index_drift(index, profiles, fix=True)
    assert drift == [("a", "title?", "no", "yes"), ("c", "row", "", "c")] and "| [a](a.md) | 🔵 x | **yes** | 5 |" in mended
    assert [d for d in catalog.index_drift(mended, profiles)[0] if d[1] != "row"] == []


# ---- configuration, command line

def test_configuration() -> None:
    text = """
profile: {signal_titles: [data]}
scoring: {title_cap: 9, tiers: {strong: 40}}
filters: {allowed_scopes: USA, min_score: 3}
sources:
  ats: lever
  adzuna: {app_key_env: MINE}
  harvest_depth: {workday_max_pages: 2, nonsense: 1}
  funnel: {max_probes_per_run: 7}
llm: {enabled: true, base_url: "https://evil.example", typo: 1}
"""
    cfg, notes = config.load(text, {"HN_THREADS": "5", "WORKDAY_MAX_PAGES": "9", "ADZUNA_PAGES": "x", "RIPPLING_FETCH_DETAILS": "off"})
    assert (cfg.title_signal, cfg.title_score_cap, cfg.tier_strong, cfg.tier_look, cfg.min_score, cfg.depth_sources) == (("data",), 9, 40, 22, 3, ("lever",))
    assert (cfg.harvest_depth.workday_max_pages, cfg.harvest_depth.hn_threads, cfg.harvest_depth.rippling_fetch_details, cfg.adzuna_pages, cfg.funnel_max_probes_per_run) == (2, 5, False, 3, 7)
    assert notes == ["allowed_scopes should be a list", "allowed_scopes has unrecognised ['USA']: no posting carries those", "unknown key harvest_depth.nonsense", "unknown key llm.typo"]
    safe, ignored = config.without_redirects(cfg)
    assert ignored == ["llm.base_url", "sources.adzuna.app_key_env"] and safe.llm.enabled and safe.llm.base_url == "" and safe.adzuna_app_key_env == "ADZUNA_APP_KEY"
    assert config.load("a: [")[1] == ["not read as YAML: ParserError"] and config.load("")[0] == config.Config()


def test_command_line(spark: SparkSession, tmp_path: Path, monkeypatch: pytest.MonkeyPatch, capsys: pytest.CaptureFixture) -> None:
    monkeypatch.chdir(tmp_path)
    assert app.main(["init"]) == 0 and app.main(["init"]) == 0
    assert "kept existing gleanworks.yaml" in capsys.readouterr().out and config.load((tmp_path / "gleanworks.yaml").read_text())[1] == []
    (tmp_path / "gleanworks.yaml").write_text("filters: {min_score: -100, remote_only: false, max_age_days: 100000}\nprofile: {signal_titles: [engineer]}\nllm: {base_url: 'https://x'}")
    job = lambda i, title: {"text": title, "categories": {"location": "Oslo"}, "hostedUrl": f"https://jobs.lever.co/acme/0a1b2c3{i}", "createdAt": 1752000000000, "descriptionPlain": "spark"}
    (tmp_path / "landed" / "lever").mkdir(parents=True)
    (tmp_path / "landed" / "lever" / "p.json").write_text(json.dumps({"raw": json.dumps([job(1, "Data Engineer"), job(2, "Sales"), job(3, "ML Engineer")]), "slug": "acme", "company": "Acme", "seq": 1}) + "\n")
    assert app.main(["list"], spark) == 0
    assert app.main(["scan"], spark) == 0
    captured = capsys.readouterr()
    assert "2 roles tracked · 2 on the shortlist · 2 new · 0 feed errors" in captured.out and "ignoring llm.base_url" in captured.err
    row = files.store_csv(spark, f"{tmp_path}/shortlist.csv").where("title = 'Data Engineer'").first()
    assert app.main(["apply", row.id], spark) == 0 and app.main(["dismiss", "zzz"], spark) == 1
    assert app.main(["scan", "--format", "ndjson", "--all"], spark) == 0
    captured = capsys.readouterr()
    out = [json.loads(x) for x in captured.out.splitlines() if x.startswith("{")]
    assert {(r["title"]["raw"], r["text"], tuple(r["sources"])) for r in out} == {("Data Engineer", "spark", ("lever",)), ("ML Engineer", "spark", ("lever",))}
    assert json.loads([x for x in captured.err.splitlines() if x.startswith('{"kind"')][0])["rows"] == 2
    assert app.main(["list"], spark) == 0 and "1 shown" in capsys.readouterr().out
    assert app.main(["list", "--all"], spark) == 0 and "APPLIED" in capsys.readouterr().out
    # a payload that can't be read is an error beside the good ones
    bad = [{"raw": "{broken", "slug": "b"}, {"raw": '{"x": 1}', "slug": "c"}, {"raw": json.dumps([job(4, "Cloud Engineer")]), "slug": "acme", "company": "Acme", "seq": 2}]
    (tmp_path / "landed" / "lever" / "q.json").write_text("".join(json.dumps(x) + "\n" for x in bad))
    assert app.main(["scan", "--verbose"], spark) == 0
    out = capsys.readouterr().out
    assert "3 roles tracked" in out and "2 feed errors" in out and "lever: 1 payloads: not JSON (one of b)" in out and "lever: 1 payloads: no list at the top (one of c)" in out
    (tmp_path / "landed" / "lever" / "q.json").unlink()
    # a run whose sources all fail keeps what is there
    (tmp_path / "bad").mkdir()
    (tmp_path / "watchlist.json").write_text("[{")
    assert app.main(["scan", "--landed", "bad"], spark) == 1 and "stays as it is" in capsys.readouterr().out
    assert app.main(["list", "--all"], spark) == 0 and "3 shown" in capsys.readouterr().out
    (tmp_path / "index.json").write_text('{"url": "https://jobs.lever.co/b1/x"}\n{"url": "https://jobs.lever.co/acme"}\n{broken\n')
    (tmp_path / "w2.json").write_text('{"companies": [{"name": "Acme", "ats": "lever", "slug": "acme"}]}')
    assert app.main(["seed", "lever", "--index", "index.json", "--watchlist", "w2.json"], spark) == 0 and "added 1" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        app.main(["list", "--config", "none.yaml"], spark)
