"""Sources, sinks, providers and streams on temporary folders."""

from __future__ import annotations

import json
import subprocess
import zipfile

import pytest
from pyspark.sql import functions as F

from corvane import config
from corvane.operators import ingest, links, providers
from corvane.sources import epochs, files, shared, state
from corvane.streaming import watch


def test_scan_and_extract(spark, tmp_path):
    (tmp_path / "a/node_modules").mkdir(parents=True)
    (tmp_path / "a/x.TS").write_text("hello")
    (tmp_path / "a/node_modules/y.ts").write_text("no")
    (tmp_path / "z.md").write_text("zz")
    (tmp_path / "empty.md").write_text("")
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{files.WORD[1:-1]}"><w:p><w:t>one</w:t></w:p><w:p><w:t>two</w:t></w:p></w:document>')
    (tmp_path / "bad.docx").write_text("not a zip")
    got = files.scan(spark, str(tmp_path), ["ts", "md", "docx"], names=["node_modules"], least_bytes=3)
    assert {(r["path"], r["is_empty"]) for r in got.collect()} == {("a/x.TS", False), ("z.md", False), ("d.docx", False), ("bad.docx", False)}
    text = {r["path"]: (r["text"], r["status"]) for r in files.extract(got).collect()}
    assert text["d.docx"] == ("one\n\ntwo", "ok") and text["bad.docx"][1].startswith("failed") and text["a/x.TS"] == ("hello", "ok")


def test_logs(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1}\nbroken\n{"id": 2}\n')
    (tmp_path / "b.jsonl").write_text('{"id": 3}\n')
    assert sorted(r["id"] for r in files.tolerant_log(spark, str(tmp_path), "id long").collect()) == [1, 2, 3]
    assert [r["id"] for r in files.strict_sessions(spark, str(tmp_path), "id long").collect()] == [3]


def test_epochs(spark, tmp_path):
    t = epochs.EpochTable(spark, str(tmp_path / "t"))
    t.promote(t.write(spark.range(3)))
    n = t.write(spark.range(5))
    assert t.read().count() == 3
    t.promote(n)
    assert t.read().count() == 5
    t.clear()
    assert t.read().count() == 0


def test_providers(spark):
    def picky(texts):
        if len(texts) > 1 or texts[0] == "bad":
            raise ValueError
        return [[1.0]]

    assert providers.resilient(picky, tries=1, wait_s=0)(["a", "bad", "b"]) == [[1.0], None, [1.0]]
    df = spark.createDataFrame([(1, "a b"), (2, None)], "id long, content string")
    v = {r["id"]: r["embedding"] for r in providers.embed(df, providers.hash_embedder(8)).collect()}
    assert abs(sum(x * x for x in v[1]) - 1) < 1e-6 and not any(v[2])
    cache = spark.createDataFrame([], "cache_key string, description string")
    out, grown = providers.described(df.where("id = 1"), cache, lambda t: [x.upper() for x in t], "c")
    assert out.first()["description"] == "A B" and grown.count() == 1


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    rows = [("s", 0), ("s", 5), ("s", 20), ("s", 40), ("t", 1)]
    df = spark.createDataFrame(rows, "signature string, sec long").select("signature", F.timestamp_seconds("sec").alias("ts"))
    df.coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    q = watch.allowed(stream, 10, 2).writeStream.format("memory").queryName("gate").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r["signature"], r["ts"].second): r["allowed"] for r in spark.table("gate").collect()}
    assert got == {("s", 0): True, ("s", 5): False, ("s", 20): True, ("s", 40): False, ("t", 1): True}
    seen: list[str] = []
    q = watch.watch(stream.withColumnRenamed("signature", "path"), seen.extend, str(tmp_path / "cp"), once=True)
    q.awaitTermination(60)
    assert sorted(seen) == ["s", "t"]


def test_epochs_are_rewritten_into_fewer_files(spark, tmp_path):
    t = epochs.EpochTable(spark, str(tmp_path / "t"))
    t.promote(t.write(spark.range(100).repartition(8)))
    n = t.optimize(2, "id")
    assert t.read().count() == 100 and t.active() == n and t.epochs() == [n]
    assert len(list((tmp_path / f"t/epoch={n}").glob("part-*"))) == 2


def test_readers_keep_their_epoch(spark, tmp_path):
    at = [1000.0]
    t = epochs.EpochTable(spark, str(tmp_path / "t"), now=lambda: at[0])
    t.promote(t.write(spark.range(100).repartition(8)))
    with t.held() as rows:
        first = t.active()
        n = t.optimize(2, "id")
        assert t.epochs() == [first, n] and t.holds() == {first}
        assert rows.count() == 100  # planned before, run after
        t.promote(t.write(spark.range(7)))
        assert t.prune(every_s=900) == []  # too soon
        at[0] += 901
        assert t.prune(every_s=900) == [n] and rows.agg(F.sum("id")).first()[0] == 4950
    assert t.prune() == [first] and t.read().count() == 7
    stuck = t.held(most_s=60)
    stuck.__enter__()
    last = t.active()
    t.promote(t.write(spark.range(8)))
    assert t.prune() == []
    at[0] += 61  # the reader is taken for dead
    assert t.prune() == [last] and t.holds() == set()


def test_state_is_found_between_the_renames(spark, tmp_path):
    at = str(tmp_path / "s")
    assert shared.read_state(spark, at) is None
    shared.write_text(spark, at, "one")
    shared.write_text(spark, at, "zwei ü")
    assert shared.read_state(spark, at) == "zwei ü"
    (tmp_path / "s").rename(tmp_path / "s.old")  # a writer stopped here
    assert shared.read_state(spark, at) == "zwei ü"
    files.swap(spark, spark.range(3), str(tmp_path / "w"))
    files.swap(spark, spark.range(4), str(tmp_path / "w"))
    assert spark.read.parquet(str(tmp_path / "w")).count() == 4 and not (tmp_path / "w.old").exists()


def test_manifest(spark, tmp_path):
    at = str(tmp_path / "manifest.json")
    assert state.load_manifest(spark, at)[1] == "missing"
    rows = spark.createDataFrame([("a/é.ts", "h1", 3, 1.5), ('q"x', "h2", 0, None)], "path string, hash string, chunkCount long, mtime double")
    state.save_manifest(spark, rows, at)
    assert json.loads((tmp_path / "manifest.json").read_text())["schemaVersion"] == 3
    found, how = state.load_manifest(spark, at)
    assert how == "ok" and sorted((r["path"], r["hash"], r["chunkCount"], r["mtime"]) for r in found.collect()) == [("a/é.ts", "h1", 3, 1.5), ('q"x', "h2", 0, None)]
    for text, n in (("{broken", 0), ('{"schemaVersion": 3}', 0), ('{"schemaVersion": 2, "files": {"x": {"hash": "h"}}}', 1)):
        (tmp_path / "old.json").write_text(text)
        found, how = state.load_manifest(spark, str(tmp_path / "old.json"))
        assert how == "corrupt" and found.count() == n
    with pytest.raises(ValueError, match="EpochTable"):
        state.save_manifest(spark, rows, at, most=1)


def test_labels_and_sessions(spark, tmp_path):
    at = tmp_path / "labels.json"
    at.write_text(json.dumps({"labels": [{"id": "a", "query": "q", "files": ["x"]}, {"id": "b", "query": "r", "files": ["y", "z"], "note": 1}]}))
    got = state.load_labels(spark, str(at), ["id", "query", "files"])
    assert sorted((r["id"], r["files"]) for r in got.collect()) == [("a", ["x"]), ("b", ["y", "z"])]
    for bad in ([], [{"id": "a", "query": "q", "files": []}], [{"id": "a", "files": ["x"]}]):
        at.write_text(json.dumps({"labels": bad}))
        with pytest.raises(ValueError):
            state.load_labels(spark, str(at), ["id", "query", "files"])
    with pytest.raises(FileNotFoundError):
        state.load_labels(spark, str(tmp_path / "none"), ["id"])
    for name in ("s2.jsonl", "s1.jsonl", "other.txt"):
        (tmp_path / name).write_text("")
    assert state.session_ids(spark, str(tmp_path)) == ["s1", "s2"] and state.session_ids(spark, str(tmp_path / "no")) == []
    state.delete_session(spark, str(tmp_path), "s1")
    assert state.session_ids(spark, str(tmp_path)) == ["s2"]


def test_lease_and_sync(spark, tmp_path):
    at = [100.0]
    lease = state.Lease(spark, str(tmp_path), "index", now=lambda: at[0], settle_s=0)
    assert lease.acquire("a", 10) and not lease.acquire("b", 10) and lease.holder() == "a"
    at[0] = 105
    assert lease.renew("a", 10) and not lease.renew("b", 10)
    at[0] = 116
    assert lease.holder() is None and lease.acquire("b", 10)
    lease.release("a")
    assert lease.holder() == "b"
    lease.release("b")
    assert lease.holder() is None

    one = state.sync("x", "x", None)
    assert one[:2] == ("x", "none")
    assert state.sync(None, "r", None)[:2] == ("r", "pull") and state.sync("l", None, None)[:2] == ("l", "push")
    seen = one[2]
    assert state.sync("x", "y", seen)[:2] == ("y", "pull") and state.sync("z", "x", seen)[:2] == ("z", "push")
    assert state.sync("z", "y", seen) == ("z", "conflict", seen)
    assert state.sync("z", "y", seen, lambda a, b: a + b)[:2] == ("zy", "merged")


def test_git_feeds(spark, tmp_path):
    git = lambda *w: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", *w], cwd=tmp_path, check=True, capture_output=True, text=True).stdout.strip()
    assert state.working_tree(spark, str(tmp_path)) is None
    git("init", "-q")
    for name in ("a", "b", "c"):
        (tmp_path / name).write_text(name)
    git("add", "."), git("commit", "-qm", "one")
    first = git("rev-parse", "HEAD")
    (tmp_path / "a").write_text("changed")
    git("rm", "-q", "b"), git("commit", "-qam", "two")
    (tmp_path / "c").write_text("now")
    (tmp_path / "new").write_text("n")
    rows, head = state.changes_since(spark, str(tmp_path), first)
    assert sorted(map(tuple, rows.collect())) == [("a", "changed"), ("b", "deleted"), ("new", "untracked")] and head == git("rev-parse", "HEAD")
    assert state.changes_since(spark, str(tmp_path), "--output=x") is None
    assert sorted(map(tuple, state.working_tree(spark, str(tmp_path)).collect())) == [("c", "modified"), ("new", "untracked")]
    assert {r["path"] for r in state.touches(spark, str(tmp_path)).collect()} == {"a", "b", "c"}


def test_reranker_rests_and_remembers(spark):
    calls, at = [], [0.0]

    def call(query, documents):
        calls.append(len(documents))
        if query == "bad":
            raise ValueError
        return [float(len(d)) for d in documents]

    r = providers.Reranker("r", call, most=2, most_cached=3, failures=2, rest_s=10, now=lambda: at[0])
    assert r.scores("q", ["a", "bb", "ccc"]) == [1, 2, 3] and calls == [2, 1]
    assert r.scores("q", ["ccc", "bb"]) == [3, 2] and len(calls) == 2
    assert r.scores("bad", ["x"]) is None and r.available() and r.scores("bad", ["x"]) is None and not r.available()
    assert r.scores("q", ["dddd"]) is None and r.scores("q", ["bb"]) == [2]
    at[0] = 11
    assert r.scores("q", ["dddd"]) == [4] and len(r.known) == 3
    df = spark.createDataFrame([(1, 5, 0, "q", "aaa"), (1, 6, 1, "q", "b"), (1, 7, 2, "q", "cc"), (2, 5, 0, "bad", "x")], "qid long, id long, rank int, query string, content string")
    got = {(x["qid"], x["id"]): x["rerank_score"] for x in providers.rerank_scores(df, lambda: providers.Reranker("r", call), pool=2).collect()}
    assert got == {(1, 5): 3.0, (1, 6): 1.0, (1, 7): None, (2, 5): None}


def test_decisions_and_guard(spark):
    ask = [{"id": "destructive", "type": "noul", "instructions": "?"}, {"id": "category", "type": "choice", "instructions": "?", "criteria": ["none", "network"]}]
    assert providers.decision_problem("rm x", ask) is None
    bad = [("", ask), ("x" * 9000, ask), ("x", []), ("x", ask + ask), ("x", [{"id": "a", "type": "choice", "instructions": "?", "criteria": ["one"]}]),
           ("x", [{"id": "a", "type": "score", "instructions": "?", "criteria": {"a": 1, "b": 2}}]), ("x", [{"id": "a", "type": "noul", "instructions": "?", "criteria": []}]),
           ("x", [{"id": "a", "type": "other", "instructions": "?"}]), ("x", [{"id": "a", "type": "noul", "instructions": " "}])]
    assert all(providers.decision_problem(s, q) for s, q in bad)

    def provider(states, questions):
        return [[{"id": "destructive", "noul": {"probability": 1.7 if "rm" in s else 0.1}}, {"id": "malicious", "noul": 0.2}, {"id": "category", "choice": "delete_files"}] for s in states]

    df = spark.createDataFrame([("rm -r x",), ("ls",), (None,)], "state string")
    got = {r["state"]: r["v"] for r in providers.decided(df, provider, ask).select("state", providers.guard_verdict(F.col("answers"), 0.7).alias("v")).collect()}
    assert tuple(got["rm -r x"]) == (True, 1.0, 0.2, "delete_files") and not got["ls"]["flagged"] and tuple(got[None]) == (False, 0.0, 0.0, "none")
    at = [0.0]
    memory = providers.Expiring(5, 2, now=lambda: at[0])
    for k in "abc":
        memory.put(k, k)
    assert (memory.get("a"), memory.get("b")) == (None, "b")
    at[0] = 6
    assert memory.get("b") is None


def test_description_cache(spark):
    day = lambda n: f"2024-01-{n:02d} 00:00:00"
    rows = spark.createDataFrame([(f"k{i}", "d", day(i)) for i in range(1, 11)], "cache_key string, description string, at string")
    cache = rows.select("cache_key", "description", F.col("at").cast("timestamp").alias("created"))
    now = F.lit("2024-01-11 00:00:00").cast("timestamp")
    left = lambda most, days: sorted(r["cache_key"] for r in providers.evict(cache, now, most, days).collect())
    assert left(10, 1) == sorted(f"k{i}" for i in range(1, 11))  # nothing goes while there is room
    assert left(9, 4) == ["k10", "k7", "k8", "k9"] and left(2, 30) == ["k10", "k9"]
    key = lambda *a: spark.range(1).select(providers.cache_key(F.lit("text"), "cfg", *map(F.lit, a))).first()[0]
    assert len(key()) == 33 and len(key("a.ts:1")) == 42 and key("a.ts:1") != key("b.ts:1")
    assert providers.dimension(providers.hash_embedder(8)) == 8 and providers.dimension(None, 3) == 3
    with pytest.raises(ValueError):
        providers.dimension(lambda t: [[]])


def test_layers_and_overrides():
    defaults = {"a": {"x": 1, "y": 2}, "chunking": {"parsers": {".c": "c"}}, "l": [1]}
    got = config.layered(defaults, {"a": {"y": 3}}, {"l": [2], "chunking": {"parsers": {" H ": " CPP ", "a/b": "x", "z": 3}}}, {"a": None})
    assert got == {"a": None, "chunking": {"parsers": {".c": "c", ".h": "cpp"}}, "l": [2]} and defaults["a"] == {"x": 1, "y": 2}
    assert config.parser_warnings(None) == [] and len(config.parser_warnings([])) == 1
    assert len(config.parser_warnings({".h": "cpp", "a/b": "c", ".x": "", ".y": "nope"})) == 3


def test_logs_are_rewritten_and_versions_folded(spark, tmp_path):
    at = str(tmp_path / "log")
    files.append_log(spark.range(3), at)
    files.rewrite_log(spark, spark.range(5), at)
    assert spark.read.json(at).count() == 5
    rows = [(1, 1, 0, False, "a"), (1, 2, 0, False, "b"), (2, 1, 0, True, "c"), (3, 1, 1, False, "d"), (1, 9, 1, False, "e")]
    spark.createDataFrame(rows, "id long, ver long, epoch int, deleted boolean, v string").write.json(str(tmp_path / "rows"))
    kind = "id long, ver long, epoch int, deleted boolean, v string"
    read = lambda e: sorted((r["id"], r["v"]) for r in files.versioned_rows(spark, str(tmp_path / "rows"), kind, ["id"], epoch=e).collect())
    assert read(0) == [(1, "b")] and read(1) == [(1, "e"), (3, "d")] and read(None) == [(1, "e"), (3, "d")]


def test_ingest(spark):
    kind = "id string, path string, start_line int, end_line int, language string, content string, description string, embedding array<float>"
    store = spark.createDataFrame([("old", "a.py", 1, 1, "python", "gone", "", [1.0]), ("keep", "b.py", 1, 1, "python", "x", "", [1.0])], kind)
    given = spark.createDataFrame([("a.py", "# says f\ndef f():\n    return 1\n\ndef g():\n    return 2\n"), ("c.txt", "plain")], "path string, text string")
    cache = spark.createDataFrame([], "cache_key string, description string")
    out, grown = ingest.ingest(store, given, providers.hash_embedder(8), lambda t: ["told"] * len(t), cache, "c")
    got = {(r["path"], r["content"].split("\n")[0]): r["description"] for r in out.collect()}
    assert got == {("b.py", "x"): "", ("a.py", "def f():"): "says f", ("a.py", "def g():"): "told", ("c.txt", "plain"): "told"}
    assert grown.count() == 2 and out.where("size(embedding) = 8").count() == 3


def test_event_stream_appends_final_messages(spark, tmp_path):
    rows = [("message", "assistant", None), ("message", "assistant", 5), ("message", "user", 5), ("tool", None, None)]
    df = spark.createDataFrame(rows, "event string, role string, completed long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    watch.append_events(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination(60)
    assert sorted(str(r["role"]) for r in spark.read.schema(df.schema).json(str(tmp_path / "out")).collect()) == ["None", "assistant"]


def test_vertices(spark):
    rows = [("Wiki/Index.md", "# All"), ("a/B.md", "---\ntitle: 'Of b'\n---\n# Other"), ("c.md", "text\n# Head\n"), ("d.md", ""), ("templates/t.md", "# T"), ("/", "x")]
    got = {r["id"]: (r["base"], r["title"], r["is_content"]) for r in links.vertices(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"index": ("index", "All", False), "a/b": ("b", "Of b", True), "c": ("c", "Head", True), "d": ("d", "d", True), "templates/t": ("t", "T", False)}
