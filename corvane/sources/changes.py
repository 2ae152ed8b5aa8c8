"""Changes of a tree of files as a stream: created, changed and deleted, between snapshots that are the offsets."""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "file-changes"
SCHEMA = "path string, change string, bytes long, mtime timestamp"


class Snapshots:
    """What a tree held at each scan: numbered folders of files by a hash of the path, sorted by path."""

    def __init__(self, root: str, folder: str, buckets: int):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(root)
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.buckets = buckets

    def _at(self, n: int, bucket: int) -> str:
        return f"{self.folder}/snapshot={n}/{bucket:05d}.parquet"

    def numbers(self) -> list[int]:
        """The finished snapshots in order."""
        from pyarrow import fs

        found = self.store.get_file_info(fs.FileSelector(self.folder, allow_not_found=True, recursive=True))
        return sorted(int(f.path.split("snapshot=")[1].split("/")[0]) for f in found if f.base_name == "DONE")

    def scan(self) -> list:
        """A table (path, bytes, mtime) by bucket; a file that goes away amid the scan is not in it."""
        import pyarrow as pa
        from pyarrow import fs

        rows: list[list[tuple]] = [[] for _ in range(self.buckets)]
        for f in self.fs.get_file_info(fs.FileSelector(self.root, allow_not_found=True, recursive=True)):
            if f.type == fs.FileType.File:
                path = f.path[len(self.root) :].lstrip("/")
                rows[zlib.crc32(path.encode()) % self.buckets].append((path, f.size, f.mtime_ns // 1000))
        kind = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("mtime", pa.int64())])
        return [pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*sorted(r)) if r else ((), (), ()), kind.types, strict=True)], schema=kind) for r in rows]

    def read(self, n: int, bucket: int):
        """A bucket as it was; empty for 0, before the first scan."""
        import pyarrow.parquet as pq

        if n == 0:
            return None
        with self.store.open_input_file(self._at(n, bucket)) as f:
            return pq.read_table(f)

    def latest(self) -> int:
        """The number of a snapshot that holds the tree as it is now: the last one, or one that is written now."""
        import pyarrow.parquet as pq

        now, done = self.scan(), self.numbers()
        last = done[-1] if done else 0
        if last and all(self.read(last, b).equals(t) for b, t in enumerate(now)):
            return last
        if not last and not any(t.num_rows for t in now):
            return 0
        self.store.create_dir(f"{self.folder}/snapshot={last + 1}", recursive=True)
        for b, t in enumerate(now):
            with self.store.open_output_stream(self._at(last + 1, b)) as f:
                pq.write_table(t, f)
        with self.store.open_output_stream(f"{self.folder}/snapshot={last + 1}/DONE") as f:
            f.write(b"")
        return last + 1

    def forget(self, before: int) -> None:
        for n in self.numbers():
            if n < before:
                self.store.delete_file(f"{self.folder}/snapshot={n}/DONE")
                self.store.delete_dir(f"{self.folder}/snapshot={n}")

    def between(self, start: int, end: int, bucket: int) -> Iterator[tuple]:
        """(path, change, bytes, mtime) of a bucket, in order of paths, by stepping through both sorted lists."""
        was, now = ([] if t is None else list(zip(*(t.column(c).to_pylist() for c in ("path", "bytes", "mtime")), strict=True)) for t in (self.read(start, bucket), self.read(end, bucket)))
        old = [r[0] for r in was]
        at = 0
        for row in now:
            k = bisect.bisect_left(old, row[0], at)
            for gone in was[at:k]:
                yield gone[0], "deleted", gone[1], gone[2]
            at = k
            if k == len(old) or old[k] != row[0]:
                yield row[0], "created", row[1], row[2]
            else:
                at = k + 1
                if was[k][1:] != row[1:]:
                    yield row[0], "changed", row[1], row[2]
        for gone in was[at:]:
            yield gone[0], "deleted", gone[1], gone[2]


class ChangesReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.folder, self.buckets = options["path"], options["snapshots"], int(options.get("buckets", "8"))

    def _snapshots(self) -> Snapshots:
        return Snapshots(self.root, self.folder, self.buckets)

    def initialOffset(self) -> dict:
        return {"snapshot": 0}

    def latestOffset(self) -> dict:
        return {"snapshot": self._snapshots().latest()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if start["snapshot"] == end["snapshot"]:
            return []
        return [InputPartition((start["snapshot"], end["snapshot"], b)) for b in range(self.buckets)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from datetime import UTC, datetime, timedelta

        epoch = datetime(1970, 1, 1, tzinfo=UTC)
        for path, change, size, at in self._snapshots().between(*partition.value):
            yield path, change, size, epoch + timedelta(microseconds=at)

    def commit(self, end: dict) -> None:
        """Snapshots before a finished batch are read by nothing any more."""
        self._snapshots().forget(end["snapshot"])


class FileChanges(DataSource):
    """(path, change, bytes, mtime) of the files below a folder, by size and time of change.

    Options: ``path``, the tree; ``snapshots``, a folder that the driver and the executors share,
    of this one query; ``buckets`` (8), the tasks of a batch. Both are URIs or absolute paths.
    A batch compares two snapshots that are written before it begins, so one that is run again
    after a loss gives the same rows, and a query goes on from its checkpoint with what changed
    while it was down, deletions included. A file created and deleted between two scans is not told.
    The tree is listed by the driver: one listing a trigger, as the file source does it.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ChangesReader:
        return ChangesReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make ``spark.readStream.format("file-changes")`` known."""
    spark.dataSource.register(FileChanges)
