"""Streams of file changes, coalesced paths and state that ends."""

from __future__ import annotations

import os
import time

from corvane.sources import changes
from corvane.streaming import watch


def touched(at, text):
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(text)


def test_created_changed_and_deleted_across_a_restart(spark, tmp_path):
    tree, out = tmp_path / "tree", str(tmp_path / "out")
    changes.register(spark)

    def passed():
        """The rows of one run, which begins at the checkpoint of the one before."""
        before = {tuple(r) for r in spark.read.parquet(out).collect()} if os.path.isdir(out) else set()
        df = spark.readStream.format(changes.FORMAT).option("path", str(tree)).option("snapshots", str(tmp_path / "snapshots")).option("buckets", 3).load()
        q = df.select("path", "change", "bytes", "mtime").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start()
        assert q.awaitTermination(90)
        rows = [tuple(r) for r in spark.read.schema(changes.SCHEMA).parquet(out).collect()]
        assert len(rows) == len(set(rows))
        return sorted(r[:3] for r in set(rows) - before)

    for k in range(20):
        touched(tree / f"d{k % 3}/f{k}", "x" * k)
    assert passed() == sorted((f"d{k % 3}/f{k}", "created", k) for k in range(20))
    touched(tree / "d0/f0", "now longer")
    touched(tree / "new", "n")
    (tree / "d1/f1").unlink()
    assert passed() == [("d0/f0", "changed", 10), ("d1/f1", "deleted", 1), ("new", "created", 1)]
    for p in tree.glob("d2/*"):
        p.unlink()
    assert passed() == sorted((f"d2/f{k}", "deleted", k) for k in range(20) if k % 3 == 2)
    assert passed() == []
    assert len(list((tmp_path / "snapshots").glob("snapshot=*"))) <= 2


def test_snapshots_compare_like_sets(tmp_path):
    tree = tmp_path / "t"
    s = changes.Snapshots(str(tree), str(tmp_path / "s"), 4)
    assert s.latest() == 0  # no tree yet
    states = [{"a": "1", "b/c": "2", "é": "3"}, {"a": "1", "b/d": "2"}, {}, {"z": "9", "a": "22"}]
    was = {}
    for n, files in enumerate(states, 1):
        for p in [p for p in tree.rglob("*") if p.is_file()]:
            if str(p.relative_to(tree)) not in files:
                p.unlink()
        for name, text in files.items():
            if was.get(name) != text:
                touched(tree / name, text)
        assert s.latest() == n == s.latest()  # nothing new, no new snapshot
        got = sorted(r[:2] for b in range(4) for r in s.between(n - 1, n, b))
        assert got == sorted([(p, "created") for p in files.keys() - was.keys()] + [(p, "deleted") for p in was.keys() - files.keys()] + [(p, "changed") for p in files.keys() & was.keys() if files[p] != was[p]])
        was = files
    s.forget(3)
    assert s.numbers() == [3, 4]


def waited(ready, seconds=60):
    """Whether something came true in time."""
    end = time.monotonic() + seconds
    while time.monotonic() < end:
        if ready():
            return True
        time.sleep(0.3)
    return False


def lines(folder, name, rows):
    """A finished file of JSON lines at once."""
    folder.mkdir(exist_ok=True)
    (folder / f".{name}").write_text("".join(r + "\n" for r in rows))
    (folder / f".{name}").rename(folder / name)


def test_a_burst_over_three_batches_is_one_event(spark, tmp_path):
    given, out = tmp_path / "in", str(tmp_path / "out")
    given.mkdir()
    events = spark.readStream.schema("path string, change string").json(str(given))
    q = watch.coalesced(events, quiet_s=20).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    try:
        taken = lambda: sum(p["numInputRows"] for p in q.recentProgress) - 1
        lines(given, "w.json", ['{"path": "w", "change": "created"}'])  # the first batch is slow
        assert waited(lambda: taken() == 0)
        for k, n in enumerate((3, 5, 6)):  # each burst is a batch of its own, within the quiet time of the one before
            more = ['{"path": "b", "change": "created"}'] if k == 0 else ['{"path": "c", "change": "deleted"}'] * (2 * (k - 1))
            lines(given, f"{k}.json", ['{"path": "a", "change": "changed"}'] * (n - len(more)) + more)
            assert waited(lambda k=k: taken() >= (3, 8, 14)[k])
        rows = lambda: sorted(tuple(r) for r in spark.read.schema("path string, change string, events long").parquet(out).collect())
        assert waited(lambda: len(rows()) >= 4)
        time.sleep(2)
        assert rows() == [("a", "changed", 11), ("b", "created", 1), ("c", "deleted", 2), ("w", "created", 1)]
        # What has fired is forgotten, and the next event of the path is told again.
        lines(given, "9.json", ['{"path": "b", "change": "deleted"}'])
        assert waited(lambda: ("b", "deleted", 1) in rows())
    finally:
        q.stop()
    assert q.exception() is None


def test_state_of_quiet_signatures_goes(spark, tmp_path):
    given = tmp_path / "in"
    given.mkdir()
    cp, out = str(tmp_path / "cp"), str(tmp_path / "out")
    events = spark.readStream.schema("signature string, ts timestamp").json(str(given))

    def passed():
        q = watch.allowed(events, cooldown_s=1, most=2, idle_s=8).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
        assert q.awaitTermination(90)
        return sorted((r["signature"], r["ts"].second, r["allowed"]) for r in spark.read.parquet(out).collect())

    state = lambda: sorted(r["key"]["signature"] for r in spark.read.format("statestore").option("stateVarName", "seen").load(cp).collect())
    row = lambda k, s: f'{{"signature": "{k}", "ts": "2024-01-01 00:00:{s:02d}"}}'
    lines(given, "0.json", [row("x", 0), row("x", 0), row("x", 5), row("x", 9), row("y", 1)])
    assert passed() == [("x", 0, False), ("x", 0, True), ("x", 5, True), ("x", 9, False), ("y", 1, True)]
    assert state() == ["x", "y"]
    lines(given, "1.json", [row("z", 30), row("x", 31)])
    assert [r for r in passed() if r[1] >= 30] == [("x", 31, True), ("z", 30, True)]  # a new session of x
    assert state() == ["x", "z"]
