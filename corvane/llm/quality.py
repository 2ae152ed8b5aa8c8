"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded from
its byte classes, word lengths, repetitions within the document and a hashed bag
of its words. Gated attention, tanh of one projection times the sigmoid of
another, weighs the passages; the weighted representation is scored. Only the
document's label is learned from; the weights say which passages made the score.
Every labelled row is learned from: dealt into shards, a shard a task, that train
from the same start and are averaged before the next round. A quarter of the rows is
kept from training and fits the scores to probabilities, by counts of binned scores.

``score`` depends on the text alone, bit for bit: sums run in a fixed order, not in
that of a matrix library. Null and empty texts are one empty passage.
Ids may be null or repeat. Without labels of both kinds all scores are equal. An
empty table gives an empty result.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import scratch
from corvane.llm.labelled import BIN, Adam, Parts, averaged, binned, dealt, platt, product, remainder, sigmoid, told
from corvane.llm.ordermin import FOLDED
from corvane.llm.textscan import U64, chunks, mix, powers, prefix_hash, repeats, span_hash, words

PASSAGE = 64
BAG = 16
CLASSES = 20


def _byte_classes() -> np.ndarray:
    """Letters by case, digits, blanks, line ends, other bytes, and a class for each common mark."""
    t = np.zeros(256, np.int64)
    t[97:123], t[65:91], t[48:58], t[32], t[10], t[128:] = 1, 2, 3, 4, 5, 6
    for k, c in enumerate(".,!?#*$%&|<>"):
        t[ord(c)] = 7 + k
    return t


BYTE_CLASS = _byte_classes()
FEATURES = CLASSES + 7 + BAG


def passages(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the texts' bounds in the passages."""
    rows = len(off) - 1
    s, e, row = words(buf, off)
    at = np.searchsorted(s, off)
    count = at[1:] - at[:-1]
    size = np.maximum(1, -(-count // PASSAGE))
    bounds = np.concatenate([[0], np.cumsum(size)])
    n = int(bounds[-1])
    own = bounds[row] + (np.arange(len(s)) - at[row]) // PASSAGE  # each word's passage
    # A passage's bytes reach from its first word to the next passage's; the first has what stands before.
    place = np.arange(n) - np.repeat(bounds[:-1], size)
    begin = np.where(place == 0, np.repeat(off[:-1], size), 0)
    later = np.flatnonzero(place > 0)
    begin[later] = s[np.repeat(at[:-1], size)[later] + place[later] * PASSAGE]
    length = np.diff(np.append(begin, len(buf)))
    classes = np.bincount(np.repeat(np.arange(n) * CLASSES, length) + BYTE_CLASS[buf], minlength=n * CLASSES).reshape(n, CLASSES)
    h = span_hash(prefix_hash(buf, FOLDED), s, e)
    salt = mix(np.arange(1, rows + 1, dtype=U64))
    twice, earlier = repeats(h ^ salt[row])
    mul = powers(4, 0x8CB92BA72F3D8DD7)
    start = np.flatnonzero(np.arange(len(s)) + 3 <= at[1:][row]) if len(s) else np.zeros(0, np.int64)
    three = sum((h[start + j] * mul[j + 1] for j in range(3)), np.zeros(len(start), U64))
    again, _ = repeats(mix(three) ^ salt[row[start]])
    same = np.zeros(len(s), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    width = (e - s).astype(np.float64)
    total = np.maximum(1, np.bincount(own, minlength=n))
    per = lambda v, i=own: np.bincount(i, v, n) / total
    mean = per(width)
    extra = [mean / 10, np.sqrt(np.maximum(0, per(width * width) - mean**2)) / 10, per(twice), per(earlier), per(same), per(again, own[start]), np.log1p(total) / 5]
    slot = (h >> U64(60)).astype(np.int64)
    sign = np.where((h >> U64(59)) & U64(1), 1.0, -1.0)
    bag = np.bincount(own * BAG + slot, sign, n * BAG).reshape(n, BAG) / np.sqrt(total)[:, None]
    return np.hstack([np.sqrt(classes / np.maximum(1, length)[:, None]), np.stack(extra, 1), bag]).astype(np.float32), bounds


class Attention:
    """Passage encoder, gated attention and the document's logistic layer."""

    def __init__(self, hidden: int = 16, gate: int = 8, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)
        put = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.at = {"e": put(FEATURES, hidden), "eb": np.zeros(hidden, np.float32), "v": put(hidden, gate), "u": put(hidden, gate), "w": put(gate), "c": put(hidden), "d": np.zeros(1, np.float32)}
        self.slope, self.shift = 1.0, 0.0

    def forward(self, x: np.ndarray, bounds: np.ndarray, times=np.matmul) -> dict[str, np.ndarray]:
        """All values on the way to the texts' raw scores; ``times`` multiplies matrices."""
        p = self.at
        size, cut = bounds[1:] - bounds[:-1], bounds[:-1]
        h = np.tanh(times(x, p["e"]) + p["eb"])
        t, g = np.tanh(times(h, p["v"])), sigmoid(times(h, p["u"]))
        raw = times(t * g, p["w"])
        raw = np.exp(raw - np.repeat(np.maximum.reduceat(raw, cut), size))
        a = raw / np.repeat(np.add.reduceat(raw, cut), size)
        z = np.add.reduceat(a[:, None] * h, cut, axis=0)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "s": times(z, p["c"]) + p["d"][0]}

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def fit(self, x: np.ndarray, bounds: np.ndarray, y: np.ndarray, epochs: int = 25) -> None:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        self.learn(x, bounds, y, max(1, y.sum()), max(1, (1 - y).sum()), epochs)

    def learn(self, x: np.ndarray, bounds: np.ndarray, y: np.ndarray, n1: int, n0: int, epochs: int, batch: int = 256, seed: int = 13) -> None:
        """Train on the passages; ``n1`` and ``n0`` say how the labels weigh."""
        x = self.scaled(x)
        weight = np.where(y == 1, 0.5 / n1, 0.5 / n0) * (n1 + n0)
        rng, adam = np.random.default_rng(seed), Adam(0.005)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for s in range(0, len(y), batch):
                rows = order[s : s + batch]
                size = bounds[rows + 1] - bounds[rows]
                ends = np.concatenate([[0], np.cumsum(size)])
                pick = np.repeat(bounds[rows] - ends[:-1], size) + np.arange(ends[-1])
                adam.step(self.at, self._gradient(x[pick], ends, y[rows], weight[rows]))

    def _gradient(self, x: np.ndarray, bounds: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.at, self.forward(x, bounds)
        size, cut = bounds[1:] - bounds[:-1], bounds[:-1]
        d = (sigmoid(f["s"]) - y) * weight / len(y)
        dz = d[:, None] * p["c"]
        wide = np.repeat(dz, size, axis=0)
        da = (wide * f["h"]).sum(1)
        mean = np.repeat(np.add.reduceat(f["a"] * da, cut), size)
        draw = f["a"] * (da - mean)
        dtg = draw[:, None] * p["w"]
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh = f["a"][:, None] * wide + dt @ p["v"].T + dg @ p["u"].T
        de = dh * (1 - f["h"] ** 2)
        grad = {"c": f["z"].T @ d, "d": np.array([d.sum()]), "w": (f["t"] * f["g"]).T @ draw, "v": f["h"].T @ dt, "u": f["h"].T @ dg, "e": x.T @ de, "eb": de.sum(0)}
        return {k: g + (1e-3 * p[k] if p[k].ndim == 2 else 0) for k, g in grad.items()}

    def score(self, x: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities by text and the passages' attention weights, of each text bit by bit as if it were alone."""
        f = self.forward(self.scaled(x), bounds, product)
        return sigmoid(self.slope * f["s"] + self.shift), f["a"]


def _read(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """passages of the texts, some MB at a time."""
    read = [passages(buf, off) for _, _, buf, off in chunks(pa.array(texts, pa.string()))]
    return np.concatenate([f for f, _ in read]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for _, b in read]))])


def train(pdf: pd.DataFrame) -> Attention:
    """A model from (text, y); a quarter of the rows fits its scores to probabilities."""
    net = Attention()
    y = pdf["y"].to_numpy(np.int64)
    if not len(y) or y.min() == y.max():
        net.at["c"][:] = 0
        return net
    x, bounds = _read(pdf["text"].tolist())

    def part(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = bounds[rows + 1] - bounds[rows]
        ends = np.concatenate([[0], np.cumsum(size)])
        return x[np.repeat(bounds[rows] - ends[:-1], size) + np.arange(ends[-1])], ends

    at = np.arange(len(y))
    own, held = at[at % 4 != 3], at[at % 4 == 3]
    net.fit(*part(own), y[own])
    if not len(held):  # too few rows to keep some
        return net
    hx, hb = part(held)
    net.slope, net.shift = platt(net.forward(net.scaled(hx), hb)["s"], y[held])
    return net


ROUNDS, EPOCHS = 2, 25
#: Features are summed as whole numbers of this part, the same in any order.
PART = 1 << 20


def learned(docs: DataFrame, labels: DataFrame, label: str, by: int, out: int, most: int = 4000) -> Attention:
    """As ``train``, from every labelled row, by shards of about ``most`` rows."""
    net = Attention()
    rows = told(docs, labels, label, by, out)
    kinds = {r["y"] for r in rows.select("y").distinct().collect()}
    if len(kinds) < 2:
        scratch.drop(rows)
        net.at["c"][:] = 0
        return net
    own, shards, n1, n0 = dealt(rows, most)
    n1, n0 = max(1, n1), max(1, n0)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(FEATURES, np.int64), np.zeros(FEATURES, np.int64)
        for b in batches:
            for _, _, buf, off in chunks(b.column(0)):
                x = passages(buf, off)[0].astype(np.float64)
                n, s, q = n + len(x), s + np.rint(x * PART).astype(np.int64).sum(0), q + np.rint(x * x * PART).astype(np.int64).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES)), pa.array(np.full(FEATURES, n)), pa.array(s), pa.array(q)], ["at", "n", "s", "q"])

    sums = own.select("text").mapInArrow(moments, "at long, n long, s long, q long").groupBy("at").agg(F.sum("n"), F.sum("s"), F.sum("q"))
    _, n, s, q = np.array(sorted(map(tuple, sums.collect())), np.float64).reshape(-1, 4).T  # a row a feature
    if len(n):
        n = np.maximum(n, 1)
        mean = s / PART / n
        net.mean, net.scale = mean.astype(np.float32), (np.sqrt(np.maximum(0, q / PART / n - mean**2)) + 1e-3).astype(np.float32)
    rounds = ROUNDS if shards > 1 else 1  # nothing to average
    for k in range(rounds):
        model = docs.sparkSession.sparkContext.broadcast(net)

        def fit(texts: list[str], y: np.ndarray, model=model, k: int = k) -> Parts:
            own = copy.deepcopy(model.value)
            own.learn(*_read(texts), y, n1, n0, -(-EPOCHS // rounds), seed=13 + k)
            flat = np.concatenate([own.at[x].ravel() for x in sorted(own.at)])
            yield 0, np.arange(len(flat)), flat[:, None]

        for _, _, values in averaged(own, shards, fit):
            flat = values[:, 0]
            for x in sorted(net.at):
                net.at[x], flat = flat[: net.at[x].size].reshape(net.at[x].shape).copy(), flat[net.at[x].size :]
        model.destroy()
    model = docs.sparkSession.sparkContext.broadcast(net)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for b in batches:
            for i, j, buf, off in chunks(b.column(0)):
                x, bounds = passages(buf, off)
                raw = net.forward(net.scaled(x), bounds, product)["s"]
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, j - i), pa.array(binned(raw))], ["y", "bin"])

    held = rows.where("held").select("text", "y").mapInArrow(bins, "y int, bin long").groupBy("y", "bin").count().orderBy("y", "bin").toPandas()  # bins by label
    scratch.drop(rows)
    model.destroy()
    if len(held):  # else too few rows to keep some
        net.slope, net.shift = platt(held["bin"].to_numpy() * BIN, held["y"].to_numpy(), times=held["count"].to_numpy(float))
    return net


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", by: int = 5, out: int = 0, most: int = 4000, cut: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages, top_passage) of every document.

    top_passage: the place of the passage with the largest attention weight.
    """
    held = F.coalesce(remainder(F.col("doc_id"), by) == out, F.lit(False))
    given = docs.select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"))
    return _scored(given, learned(docs, labels, label, by, out, most), cut)


def filtered(docs: DataFrame, labels: DataFrame, label: str = "quality", by: int = 5, out: int = 0, most: int = 4000, cut: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, that score at least ``cut``; in one scan, without a join."""
    columns = F.struct(*docs.columns).alias("row")
    given = docs.select(F.col("text").cast("string").alias("text"), columns)
    return _scored(given, learned(docs, labels, label, by, out, most), cut).where("predicted = 1").select("row.*")


def _scored(given: DataFrame, net: Attention, cut: float) -> DataFrame:
    """``given`` without its first column, a text, and what the model says of it."""
    model = given.sparkSession.sparkContext.broadcast(net)  # some kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for b in batches:
            names = b.schema.names[1:]
            for i, j, buf, off in chunks(b.column(0)):
                x, bounds = passages(buf, off)
                s, a = net.score(x, bounds)
                top = np.maximum.reduceat(a, bounds[:-1])
                first = np.flatnonzero(a == np.repeat(top, np.diff(bounds)))[::-1]
                row = np.searchsorted(bounds, first, "right") - 1
                place = np.zeros(j - i, np.int64)
                place[row] = first - bounds[row]
                cols = [b.column(k).slice(i, j - i) for k in range(1, b.num_columns)]
                cols += [pa.array(s), pa.array((s >= cut).astype(np.int32)), pa.array(np.diff(bounds)), pa.array(place)]
                yield pa.RecordBatch.from_arrays(cols, [*names, "score", "predicted", "n_passages", "top_passage"])

    fields = T.StructType(given.schema.fields[1:])
    for name, kind in (("score", T.DoubleType()), ("predicted", T.IntegerType()), ("n_passages", T.LongType()), ("top_passage", T.LongType())):
        fields = fields.add(name, kind)
    return given.mapInArrow(run, fields)
