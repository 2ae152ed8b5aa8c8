"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0 to n - 1 in the order of (doc_id, text CRC, size). A balanced
Feistel network permutes the smallest even-bit domain that holds n; a value
outside 0..n-1 walks its cycle until it is inside, which keeps the map a
bijection on 0..n-1. Shard and slot follow from the permuted number p alone:
``p % shards`` and ``p // shards``, so counts differ by one at most, and a seed
reproduces the shuffle anywhere without a table.

Null texts count as empty. Null ids sort first. Repeated rows get numbers of
their own; which of two wholly equal rows gets which cannot be told apart. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import scratch
from corvane.llm.textscan import U64, mix

ROUNDS = 6


class Feistel:
    """A keyed permutation of 0..n-1."""

    def __init__(self, n: int, seed: int = 0):
        self.n = n
        self.half = U64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = U64((1 << int(self.half)) - 1)
        self.keys = mix(np.arange(1, ROUNDS + 1, dtype=U64) + U64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in self.keys:
            left, right = right, left ^ (mix(right + k) & self.mask)
        return (left << self.half) | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in self.keys[::-1]:
            left, right = right ^ (mix(left + k) & self.mask), left
        return (left << self.half) | right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        y = step(np.asarray(x).astype(U64))
        out = np.flatnonzero(y >= U64(self.n))
        while len(out):
            y[out] = step(y[out])
            out = out[y[out] >= U64(self.n)]
        return y.astype(np.int64)

    def apply(self, rows: np.ndarray) -> np.ndarray:
        return self._walk(rows, self._once)

    def invert(self, places: np.ndarray) -> np.ndarray:
        """The row numbers that ``apply`` sends to ``places``."""
        return self._walk(places, self._back)


def locate(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of a global row number, without any table."""
    p = int(Feistel(n, seed).apply(np.array([row]))[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int = 0) -> int:
    """The global row number at a shard's slot."""
    return int(Feistel(n, seed).invert(np.array([slot * shards + shard]))[0])


def numbered(df: DataFrame, order: list[str | Column], name: str) -> tuple[DataFrame, int]:
    """``df`` with global row numbers from 0 in ``order``, and its row count.

    A range shuffle sorts the rows; each task's first number is the sum of the
    counts before it. Only one count a task is gathered.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    tagged = scratch.table(tagged.withColumn("__mid", F.monotonically_increasing_id()), "rows")
    part = F.shiftright("__mid", 33)
    counts = sorted(tagged.groupBy(part.alias("p")).count().collect())
    first, total = [], 0
    for p, c in counts:
        first.append((p, total))
        total += c
    starts = spark.createDataFrame(first, "__p long, __first long")
    at = F.col("__first") + F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1))
    out = tagged.join(F.broadcast(starts), part == F.col("__p")).withColumn(name, at)
    return out.drop("__p", "__first", "__mid"), total


def shard(docs: DataFrame, shards: int, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, row, shard, slot) of every document."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    facts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows, n = numbered(facts, ["doc_id", "text_crc32", "size"], "row")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Feistel(n, seed)
        for b in batches:
            p = net.apply(b.column("row").to_numpy(zero_copy_only=False))
            cols = [b.column(c) for c in ("doc_id", "size", "text_crc32", "row")]
            cols += [pa.array((p % shards).astype(np.int32)), pa.array(p // shards)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "size", "text_crc32", "row", "shard", "slot"])

    return rows.mapInArrow(place, "doc_id long, size long, text_crc32 long, row long, shard int, slot long")
