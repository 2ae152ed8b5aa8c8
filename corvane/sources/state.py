"""State beside the tables: the manifest, labels, sessions, leases, synced files and git's changes."""

from __future__ import annotations

import hashlib
import json
import re
import subprocess
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources import shared

# The manifest's version, and the fields of its entries.
VERSION = 3
ENTRY = "hash string, chunkCount long, indexedAt double, mtime double, size long, descriptionFailed boolean, descHash string"


def load_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """(path, hash, chunkCount, ...) of a manifest file, and its state: ok, missing or corrupt.

    Corrupt is what does not parse, lacks its files or is of an older version; the last
    keeps its entries. The file is one JSON document, parsed by Spark.
    """
    text = shared.read_state(spark, path)
    empty = spark.createDataFrame([], f"path string, {ENTRY}")
    if text is None:
        return empty, "missing"
    kind = "schemaVersion int, files map<string, struct<" + ", ".join(f"{n}: {k}" for n, k in (x.split() for x in ENTRY.split(", "))) + ">>"
    rows = spark.createDataFrame([(text,)], "t string").select(F.from_json("t", kind).alias("m"))
    head = rows.select("m.schemaVersion", F.col("m.files").isNotNull().alias("has")).first()
    if not head["has"]:
        return empty, "corrupt"
    entries = rows.select(F.explode("m.files").alias("path", "e")).select("path", "e.*")
    return entries, "ok" if (head["schemaVersion"] or 0) >= VERSION else "corrupt"


def save_manifest(spark: SparkSession, entries: DataFrame, path: str, most: int = 2_000_000) -> None:
    """Write the entries as one JSON document that takes the old one's place at once.

    The document is put together on the driver, so more than ``most`` entries are
    refused: a manifest of that size is an ``EpochTable``.
    """
    n = entries.count()
    if n > most:
        raise ValueError(f"a manifest file of {n} entries; write an EpochTable")
    names = [x.split()[0] for x in ENTRY.split(", ")]
    kept = [c for c in names if c in entries.columns]
    rows = entries.select("path", F.to_json(F.struct(*kept)).alias("e")).orderBy("path").collect()
    body = ",".join(f"{json.dumps(r['path'])}:{r['e']}" for r in rows)
    shared.write_text(spark, path, f'{{"schemaVersion":{VERSION},"files":{{{body}}}}}')


def load_labels(spark: SparkSession, path: str, needed: list[str]) -> DataFrame:
    """The labels of a JSON document {"labels": [...]}; a missing file, no labels or a label that lacks a needed field is an error."""
    text = shared.read_text(spark, path)
    if text is None:
        raise FileNotFoundError(path)
    labels = json.loads(text).get("labels")
    if not isinstance(labels, list) or not labels:
        raise ValueError(f"{path} has no labels")
    for x in labels:
        for name in needed:
            value = x
            for part in name.split("."):
                value = value.get(part) if isinstance(value, dict) else None
            if not value:
                raise ValueError(f"malformed label, needs {', '.join(needed)}: {json.dumps(x)}")
    fields: dict = {}
    for x in labels:
        fields |= {k: v for k, v in x.items() if k not in fields}
    kind = spark.range(1).select(F.schema_of_json(F.lit(json.dumps(fields)))).first()[0]
    rows = spark.createDataFrame([(json.dumps(x),) for x in labels], "v string")
    return rows.select(F.from_json("v", F.lit(kind)).alias("r")).select("r.*")


def session_ids(spark: SparkSession, folder: str) -> list[str]:
    """The sessions that have a log in the folder, in order; none where there is no folder."""
    fs = shared.files(spark, folder)
    if not fs.exists(shared.at(spark, folder)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(shared.at(spark, folder))]
    return sorted(n.removesuffix(".jsonl") for n in names if n.endswith(".jsonl"))


def delete_session(spark: SparkSession, folder: str, session: str) -> None:
    shared.files(spark, folder).delete(shared.at(spark, f"{folder}/{session}.jsonl"), True)


class Lease:
    """An advisory lease on ``kind``: a file that names its owner and its end. ``now`` gives seconds."""

    def __init__(self, spark: SparkSession, folder: str, kind: str, now: Callable[[], float] = time.time, settle_s: float = 0.12):
        self.spark, self.path, self.now, self.settle_s = spark, f"{folder.rstrip('/')}/lease-{kind}", now, settle_s

    def _read(self) -> dict | None:
        try:
            row = json.loads(shared.read_state(self.spark, self.path) or "{}")
        except ValueError:
            return None
        return row if row.get("owner") else None

    def _write(self, owner: str, until: float) -> None:
        shared.write_text(self.spark, self.path, json.dumps({"owner": owner, "until": until}))

    def _free_for(self, owner: str) -> bool:
        held = self._read()
        return held is None or held["owner"] == owner or held["until"] <= self.now()

    def acquire(self, owner: str, ttl_s: float) -> bool:
        """False if another holds it. Of two that write at once the file's last owner has it, which both read after a while."""
        if not self._free_for(owner):
            return False
        self._write(owner, self.now() + ttl_s)
        time.sleep(self.settle_s)
        held = self._read()
        return held is not None and held["owner"] == owner

    def renew(self, owner: str, ttl_s: float) -> bool:
        if not self._free_for(owner):
            return False
        self._write(owner, self.now() + ttl_s)
        return True

    def release(self, owner: str) -> None:
        held = self._read()
        if held is not None and held["owner"] == owner:
            self._write("", 0)

    def holder(self) -> str | None:
        held = self._read()
        return held["owner"] if held and held["until"] > self.now() else None


def sync(local: str | None, remote: str | None, seen: str | None, merge: Callable[[str, str], str] | None = None) -> tuple[str | None, str, str | None]:
    """What the local copy of a state file becomes, what was done, and the digest to remember.

    seen: the digest of the last text that both sides had. One side's change goes to the
    other: pull, push. Changes on both sides are merged where ``merge`` can, else the
    local copy stays to be pushed: conflict. none: nothing to do.
    """
    digest = lambda t: None if t is None else hashlib.sha256(t.encode()).hexdigest()
    here, there = digest(local), digest(remote)
    if here == there:
        return local, "none", here
    if remote is None:
        return local, "push", here
    if local is None or here == seen:
        return remote, "pull", there
    if there == seen:
        return local, "push", here
    if merge is not None:
        merged = merge(local, remote)
        return merged, "merged", digest(merged)
    return local, "conflict", seen


def _git(folder: str, *words: str) -> list[str] | None:
    try:
        done = subprocess.run(["git", *words], cwd=folder, capture_output=True, text=True, timeout=30, check=True)
    except (OSError, subprocess.SubprocessError):
        return None
    return [x for x in done.stdout.split("\n") if x]


CHANGE = "path string, change string"


def changes_since(spark: SparkSession, folder: str, commit: str) -> tuple[DataFrame, str] | None:
    """(path, change) between a commit and the head, changed or deleted, untracked files too, and the head; None where git can't tell."""
    if not re.fullmatch("[0-9a-fA-F]{7,40}", commit):
        return None
    changed, deleted = (_git(folder, "diff", "--name-only", f"--diff-filter={k}", commit, "HEAD") for k in ("ACMRT", "D"))
    untracked, head = _git(folder, "ls-files", "--others", "--exclude-standard"), _git(folder, "rev-parse", "HEAD")
    if changed is None or deleted is None or not head:
        return None
    rows = [(p, k) for k, some in (("changed", changed), ("deleted", deleted), ("untracked", untracked or [])) for p in some]
    return spark.createDataFrame(rows, CHANGE), head[0]


def working_tree(spark: SparkSession, folder: str) -> DataFrame | None:
    """(path, change) of the working tree against the head: modified, deleted or untracked; None outside a repository."""
    modified, deleted = _git(folder, "diff-index", "--name-only", "-M", "HEAD"), _git(folder, "diff", "--name-only", "--diff-filter=D", "HEAD")
    untracked = _git(folder, "ls-files", "--others", "--exclude-standard")
    if modified is None or deleted is None or untracked is None:
        return None
    rows = [(p, k) for k, some in (("modified", modified), ("deleted", deleted), ("untracked", untracked)) for p in some]
    return spark.createDataFrame(rows, CHANGE)


def touches(spark: SparkSession, folder: str) -> DataFrame | None:
    """(path, touched) of every commit's files, newest first, for the newest touch of each; None outside a repository."""
    lines = _git(folder, "log", "--format=@%ct", "--name-only")
    if lines is None:
        return None
    rows, at = [], 0
    for x in lines:
        if x.startswith("@"):
            at = int(x[1:])
        else:
            rows.append((x, at))
    return spark.createDataFrame(rows, "path string, at long").select("path", F.timestamp_seconds("at").alias("touched"))
