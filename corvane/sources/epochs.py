"""A table in epochs: rebuilds are written aside and promoted by a pointer file."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from corvane.sources import shared


class EpochTable:
    """Versions under ``root``/epoch=n; the pointer names the one that readers see.

    A reader that must finish on its epoch, whatever is promoted meanwhile, reads within ``held``.
    ``now`` gives seconds.
    """

    def __init__(self, spark: SparkSession, root: str, now: Callable[[], float] = time.time):
        self.spark, self.root, self.now = spark, root.rstrip("/"), now
        self.fs = shared.files(spark, self.root)

    def _path(self, name: str):
        return shared.at(self.spark, f"{self.root}/{name}")

    def active(self) -> int:
        """0 before the first promotion."""
        return int(shared.read_state(self.spark, f"{self.root}/ACTIVE") or 0)

    def epochs(self) -> list[int]:
        """Every epoch that is there, promoted or not."""
        if not self.fs.exists(self._path("")):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(""))]
        return sorted(int(n.removeprefix("epoch=")) for n in names if n.startswith("epoch="))

    def write(self, rows: DataFrame) -> int:
        """Write the next epoch, which no reader sees yet."""
        n = max([self.active(), *self.epochs()]) + 1
        rows.write.mode("overwrite").parquet(f"{self.root}/epoch={n}")
        return n

    def promote(self, n: int) -> None:
        shared.write_text(self.spark, f"{self.root}/ACTIVE", str(n))

    def discard(self, n: int) -> None:
        if n != self.active():
            self.fs.delete(self._path(f"epoch={n}"), True)

    @contextmanager
    def held(self, most_s: float = 86400) -> Iterator[DataFrame]:
        """The active epoch's rows, kept until the block ends; a reader that died keeps them for ``most_s``.

        The hold is written first and the pointer read again after it: whoever deletes reads
        the pointer first and the holds after it, so one of the two sees the other.
        """
        while True:
            n = self.active()
            name = f"holds/{n}-{uuid.uuid4().hex}"
            shared.write_text(self.spark, f"{self.root}/{name}", str(self.now() + most_s))
            if self.active() == n:
                break
            self.fs.delete(self._path(name), False)
        try:
            yield self.spark.read.parquet(f"{self.root}/epoch={n}")
        finally:
            self.fs.delete(self._path(name), False)

    def holds(self) -> set[int]:
        """The epochs that readers hold; holds past their time are deleted."""
        out: set[int] = set()
        if not self.fs.exists(self._path("holds")):
            return out
        for s in self.fs.listStatus(self._path("holds")):
            name = s.getPath().getName()
            if "." in name:  # being written, or left by a writer that died a day ago
                if s.getModificationTime() / 1000 + 86400 < self.now():
                    self.fs.delete(s.getPath(), False)
                else:
                    out.add(int(name.split("-")[0]))
                continue
            until = shared.read_text(self.spark, f"{self.root}/holds/{name}")
            if until is not None and float(until) < self.now():
                self.fs.delete(s.getPath(), False)
            elif until is not None:
                out.add(int(name.split("-")[0]))
        return out

    def prune(self, every_s: float = 0) -> list[int]:
        """Delete the epochs before the active one that nobody holds, unless that was done within ``every_s``; the deleted ones."""
        done = shared.read_state(self.spark, f"{self.root}/PRUNED")
        if every_s and done and self.now() - float(done) < every_s:
            return []
        n = self.active()
        held = self.holds()
        gone = [old for old in self.epochs() if old < n and old not in held]
        for old in gone:
            self.discard(old)
        shared.write_text(self.spark, f"{self.root}/PRUNED", str(self.now()))
        return gone

    def optimize(self, files: int, by: str | None = None, every_s: float = 900) -> int:
        """Rewrite the active epoch into ``files`` files, ranged by a column if one is given, promote it, and prune at most every ``every_s``."""
        rows = self.read()
        n = self.write(rows.repartitionByRange(files, by) if by else rows.repartition(files))
        self.promote(n)
        self.prune(every_s)
        return n

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/epoch={self.active()}")

    def clear(self) -> None:
        self.promote(self.write(self.read().where("false")))
