"""All labelled documents dealt into shards for fitting classifiers in tasks; bounded samples for fitting one at hand."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm import scratch

Parts = Iterator[tuple[int, np.ndarray, np.ndarray]]


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id has none."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(by))


def sample(docs: DataFrame, labels: DataFrame, label: str, by: int, out: int, most: int = 6000, most_bytes: int = 64 << 20) -> pd.DataFrame:
    """(doc_id, text, lang, y) of at most ``most`` labelled documents, half of each label at most.

    Rows whose remainder is ``out`` are never taken. Of the rest those of least
    hash of the id are, so the sample is the same whatever the partitioning. Whole
    texts are taken, in order of the hash, as long as a label's are ``most_bytes``
    / 2 together; its first is always taken. An id that is labelled more than once
    counts as its largest label; null labels don't count. Of documents that share
    an id the least text is taken.
    """
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(remainder(F.col("doc_id"), by) != out)
    y = y.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(label).cast("int").alias("y"))
    order = [F.xxhash64("id"), F.col("id")]
    picked = [y.where(F.col("y") == k).orderBy(*order).limit(most // 2) for k in (0, 1)]
    few = picked[0].unionByName(picked[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    found = texts.join(F.broadcast(few), F.col("doc_id") == F.col("id"))  # at most ``most`` rows of two numbers
    size = F.max(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size")
    sizes = found.groupBy("id", "y").agg(size).withColumn("h", F.xxhash64("id")).toPandas()  # at most ``most`` rows of numbers
    sizes = sizes.sort_values(["y", "h", "id"], ignore_index=True)
    own = sizes.groupby("y")["size"]
    sizes = sizes[(own.cumsum() <= most_bytes // 2) | (own.cumcount() == 0)]
    few = docs.sparkSession.createDataFrame(sizes[["id", "y"]].astype("int64"), "id long, y long")
    found = texts.join(F.broadcast(few), F.col("doc_id") == F.col("id")).groupBy("doc_id", "y").agg(F.min(F.struct("text", "lang")).alias("d"))
    pdf = found.select("doc_id", "d.text", "d.lang", "y").toPandas()
    pdf["text"] = pdf["text"].fillna("")
    return pdf.sort_values(["doc_id", "text"], kind="stable", ignore_index=True)


def told(docs: DataFrame, labels: DataFrame, label: str, by: int, out: int) -> DataFrame:
    """(doc_id, text, lang, y, held) of every labelled document whose remainder is not ``out``, as a scratch table.

    Whole texts, null as empty; repeated ids and labels are told as in ``sample``. A
    quarter by a hash of the id is ``held`` from training, to fit scores and thresholds.
    """
    y = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).where(remainder(F.col("doc_id"), by) != out)
    y = y.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(label).cast("int").alias("y"))
    texts = docs.where(remainder(F.col("doc_id"), by) != out)
    texts = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    found = texts.join(y, F.col("doc_id") == F.col("id")).groupBy("doc_id", "y").agg(F.min(F.struct("text", "lang")).alias("d"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(4)) == 3
    return scratch.table(found.select("doc_id", F.coalesce("d.text", F.lit("")).alias("text"), "d.lang", "y", held.alias("held")), "told")


def dealt(rows: DataFrame, most: int = 4000, most_bytes: int = 32 << 20) -> tuple[DataFrame, int, int, int]:
    """The training rows of ``told`` with their shard, the number of shards, and the rows of label 1 and 0.

    Shards follow a hash of the id, about ``most`` rows and ``most_bytes`` of text in
    each, so they are the same whatever the partitioning, and more as the input grows.
    """
    own = rows.where("not held")
    n, ones, size = own.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    shards = max(1, -(-n // most), -(-size // most_bytes))
    shard = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(shards))
    return own.withColumn("shard", shard), shards, ones, n - ones


def averaged(own: DataFrame, shards: int, fit: Callable[[list[str], np.ndarray], Parts]) -> Parts:
    """Means of what the shards of ``dealt`` have learned: ``fit`` trains on a shard's texts and labels.

    It yields slices of its model (number, places, a row of values for each place);
    a place's mean is over the shards that have it, summed in their order. Only the
    means come to the driver, as large as the model. As many tasks as shards, so that
    a task's share does not grow with the input.
    """

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        shard = table.column("shard")[0].as_py()
        found = [(k, shard, at.astype(np.int32).tobytes(), values.astype(np.float32).tobytes()) for k, at, values in fit(table.column("text").to_pylist(), table.column("y").to_numpy().astype(np.int64))]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["slice", "shard", "at", "body"])

    def mean(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        parts = [(np.frombuffer(a.as_py(), np.int32), np.frombuffer(b.as_py(), np.float32)) for a, b in zip(table.column("at"), table.column("body"), strict=True)]
        at = np.unique(np.concatenate([a for a, _ in parts]))
        total, times = np.zeros((len(at), max(len(b) // max(1, len(a)) for a, b in parts))), np.zeros(len(at))
        for a, b in parts:
            place = np.searchsorted(at, a)
            total[place] += b.reshape(len(a), -1)
            times[place] += 1
        body = (total / times[:, None]).astype(np.float32)
        return pa.table({"slice": table.column("slice")[:1].cast(pa.int32()), "at": pa.array([at.tobytes()], pa.binary()), "body": pa.array([body.tobytes()], pa.binary())})

    parts = own.select("shard", "doc_id", "text", "y").repartition(shards, "shard").groupBy("shard").applyInArrow(learn, "slice int, shard long, at binary, body binary")
    for r in parts.groupBy("slice").applyInArrow(mean, "slice int, at binary, body binary").collect():
        at = np.frombuffer(r["at"], np.int32)
        yield r["slice"], at, np.frombuffer(r["body"], np.float32).reshape(len(at), -1)


#: Raw scores are counted in bins of this width, within 64 of zero.
BIN = 1 / 512


def binned(raw: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(raw, -64, 64) / BIN).astype(np.int64)


def platt(raw: np.ndarray, y: np.ndarray, steps: int = 50, times: np.ndarray | None = None) -> tuple[float, float]:
    """Slope (positive) and offset of the logistic curve that fits labels to raw scores, each met ``times`` often."""
    if not len(y) or y.min() == y.max():
        return 1.0, 0.0
    if times is None:
        times = np.ones(len(y))
    scale = float(np.sqrt(np.average((raw - np.average(raw, weights=times)) ** 2, weights=times))) or 1.0
    x = raw / scale
    n1, n0 = (times * y).sum(), (times * (1 - y)).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = times * (p * (1 - p) + 1e-6)
        g = np.array([(times * (p - t) * x).sum() + 1e-3 * a, (times * (p - t)).sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, b = a - float(np.clip(d[0], -2, 2)), b - float(np.clip(d[1], -2, 2))
    return max(a, 1e-3) / scale, b


def product(x: np.ndarray, w: np.ndarray, kind: type = np.float64) -> np.ndarray:
    """``x @ w`` with each row's terms added one after another.

    A row's result is the same whatever rows stand beside it. BLAS's is not: its
    rounding changes with the number of rows and with a row's place among them.
    """
    wide = w.reshape(len(w), -1).astype(kind)
    out = np.zeros((len(x), wide.shape[1]), kind)
    for column, weights in zip(np.ascontiguousarray(x.T, kind), wide, strict=True):
        out += column[:, None] * weights
    return out.reshape(len(x), *w.shape[1:])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    """Steps for named arrays."""

    def __init__(self, rate: float):
        self.rate, self.n = rate, 0
        self.m: dict[str, np.ndarray] = {}
        self.v: dict[str, np.ndarray] = {}

    def step(self, at: dict[str, np.ndarray], grad: dict[str, np.ndarray]) -> None:
        self.n += 1
        for k, g in grad.items():
            m = self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * g
            v = self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * g * g
            at[k] -= self.rate * (m / (1 - 0.9**self.n)) / (np.sqrt(v / (1 - 0.999**self.n)) + 1e-8)
