"""Toxicity by a convolutional text classifier over hashed words.

Words, lower-cased runs of letters and digits, are hashed into embeddings, each the
sum of the word's own and those of its beginnings, so that inflected forms share
what is learned of their stem; filters of several widths run over them, each keeps its maximum over the text, and a
logistic layer scores the maxima. Every labelled row is learned from. Embeddings
start from each word's label association, counted in Spark; then the rows, dealt into
shards, train the network in numpy, a shard a task, from the same start, and the
shards' networks are averaged before the next round; only a filter's best window
passes a gradient back. A quarter of the rows, kept from training, fits the scores to
probabilities and calibrates a threshold for each language, by counts of binned scores.

``score`` depends on the text alone, bit for bit: sums run in a fixed order, not in
that of a matrix library. ``threshold`` and ``flagged`` apply the
language's calibrated threshold besides. Null and empty texts have no window and
score as the network's offset says. Ids may be null or repeat. Without labels of
both kinds all scores are equal. An empty table gives an empty result.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import scratch
from corvane.llm.labelled import BIN, Adam, Parts, averaged, binned, dealt, platt, product, remainder, sigmoid, told
from corvane.llm.ordermin import FOLDED, WORD_BYTE
from corvane.llm.textscan import U64, chunks, mix, prefix_hash, runs, span_hash

WIDTHS = (1, 2, 3)
STEMS = (4, 5, 6, 7)


def hashed_words(buf: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each word's buckets, its own and its stems', and the texts' bounds in the words.

    A stem is the first bytes of a longer word; a word without it has the last
    bucket, which is always zero.
    """
    s, e = runs(WORD_BYTE[buf], off)
    h = prefix_hash(buf, FOLDED)
    out = np.full((len(s), 1 + len(STEMS)), (1 << bits) - 1, np.int32)
    last = U64((1 << bits) - 1)
    out[:, 0] = (span_hash(h, s, e) >> U64(64 - bits)) % last
    for j, k in enumerate(STEMS, 1):
        long = np.flatnonzero(e - s > k)
        out[long, j] = (mix(span_hash(h, s[long], s[long] + k)) >> U64(64 - bits)) % last
    return out, np.searchsorted(s, off)


class Network:
    """Embeddings, filters and the logistic layer."""

    def __init__(self, bits: int = 18, dim: int = 8, filters: int = 8, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.bits, self.dim, self.filters = bits, dim, filters
        self.words = rng.normal(0, 0.05, (1 << bits, dim)).astype(np.float32)
        self.at = {"out": rng.normal(0, 0.3, len(WIDTHS) * filters).astype(np.float32), "offset": np.zeros(1, np.float32)}
        for w in WIDTHS:
            f = rng.normal(0, 0.4, (w, dim, filters)).astype(np.float32)
            f[:, 0] = np.abs(f[:, 0]) + 0.3
            self.at[f"f{w}"], self.at[f"b{w}"] = f, np.zeros(filters, np.float32)
        self.at["out"] = np.abs(self.at["out"])
        self.slope, self.shift = 1.0, 0.0

    def maxima(self, words: np.ndarray, bounds: np.ndarray, where: bool = False, times=np.matmul) -> tuple[np.ndarray, np.ndarray]:
        """Pooled filter values by text, and the windows that gave them (-1: none); ``times`` multiplies matrices."""
        rows = len(bounds) - 1
        if not len(words):
            return np.zeros((len(bounds) - 1, len(WIDTHS) * self.filters), np.float32), np.full((len(bounds) - 1, len(WIDTHS), self.filters), -1)
        x = self.words[words[:, 0]]
        for j in range(1, words.shape[1]):
            x += self.words[words[:, j]]
        pooled = np.zeros((rows, len(WIDTHS), self.filters), np.float32)
        best = np.full((rows, len(WIDTHS), self.filters), -1, np.int64)
        count = bounds[1:] - bounds[:-1]
        for k, w in enumerate(WIDTHS):
            has = np.flatnonzero(count >= w)
            if not len(has):
                continue
            f = self.at[f"f{w}"]
            n = len(x) - w + 1
            z = times(x[:n], f[0])
            for j in range(1, w):
                z += times(x[j : j + n], f[j])
            z += self.at[f"b{w}"]
            # Windows that run over a text's end don't count.
            over = (bounds[1:][has][:, None] - np.arange(1, w)).ravel()
            z[over[over < n]] = -np.inf
            cut = bounds[:-1][has]
            top = np.maximum.reduceat(z, cut, axis=0)
            pooled[has, k] = np.maximum(top, 0)
            if where:
                row = np.searchsorted(cut, np.arange(n), "right") - 1
                i, g = np.nonzero(z == top[row])
                best[has[row[i[::-1]]], k, g[::-1]] = i[::-1]
        return pooled.reshape(rows, -1), best

    def raw(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Raw scores, of each text bit by bit as if it were alone."""
        single = partial(product, kind=np.float32)
        return product(self.maxima(words, bounds, times=single)[0], self.at["out"]) + self.at["offset"][0]

    def fit(self, texts: list[str], y: np.ndarray, epochs: int = 8) -> None:
        n1, n0 = max(1, y.sum()), max(1, (1 - y).sum())
        one, all_ = np.zeros(1 << self.bits), np.zeros(1 << self.bits)
        first = 0
        for own, ends in _read(texts, self.bits):
            label1, label0 = _held(own, ends, y[first : first + len(ends) - 1], self.bits)
            one += label1
            all_ += label1 + label0
            first += len(ends) - 1
        self.start(one, all_, n1, n0)
        self.learn(texts, y, n1, n0, epochs)
        self.words[all_ == 0] = 0

    def start(self, one: np.ndarray, all_: np.ndarray, n1: int, n0: int) -> None:
        """Embeddings from the numbers of texts, and of those of label 1, that hold each bucket."""
        p = (all_ + 1) / (n1 + n0 + 2)
        z = (one / n1 - (all_ - one) / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
        self.words[:, 0] = np.where(np.abs(z) > 3, np.clip(z / 10, -1, 2), 0)
        self.words[-1] = 0

    def learn(self, texts: list[str], y: np.ndarray, n1: int, n0: int, epochs: int, batch: int = 64, seed: int = 5) -> np.ndarray:
        """Train on the texts; ``n1`` and ``n0`` say how the labels weigh. The buckets met, in order."""
        parts = list(_read(texts, self.bits))
        words, bounds = np.concatenate([w for w, _ in parts]), np.concatenate([[0], np.cumsum(np.concatenate([np.diff(e) for _, e in parts]))])
        weight = np.where(y == 1, 0.5 / n1, 0.5 / n0) * (n1 + n0)
        rng, adam = np.random.default_rng(seed), Adam(0.01)
        squares = np.full(self.words.shape, 0.1, np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for s in range(0, len(y), batch):
                rows = order[s : s + batch]
                size = bounds[rows + 1] - bounds[rows]
                ends = np.concatenate([[0], np.cumsum(size)])
                own = words[np.repeat(bounds[rows] - ends[:-1], size) + np.arange(ends[-1])]
                self._step(own, ends, y[rows], weight[rows], adam, squares)
        return np.unique(words)

    def _step(self, words, bounds, y, weight, adam, squares) -> None:
        m, best = self.maxima(words, bounds, where=True)
        d = (sigmoid(m @ self.at["out"] + self.at["offset"][0]) - y) * weight / len(y)
        grad = {"out": m.T @ d + 1e-4 * self.at["out"], "offset": np.array([d.sum()])}
        dm = (d[:, None] * self.at["out"] * (m > 0)).reshape(best.shape).astype(np.float32)
        back: list[tuple[np.ndarray, np.ndarray]] = []
        for k, w in enumerate(WIDTHS):
            f = self.at[f"f{w}"]
            r, g = np.nonzero((best[:, k] >= 0) & (dm[:, k] != 0))
            i, v = best[r, k, g], dm[r, k, g]
            df = np.zeros_like(f)
            for j in range(w):
                x = self.words[words[i + j]].sum(1)
                for q in range(self.filters):
                    df[j, :, q] = (x[g == q] * v[g == q, None]).sum(0)
                back.append((words[i + j].ravel(), np.repeat(f[j][:, g].T * v[:, None], words.shape[1], axis=0)))
            grad[f"f{w}"] = df + 1e-4 * f
            grad[f"b{w}"] = np.bincount(g, v, self.filters)
        ids = np.concatenate([b for b, _ in back]) if back else np.zeros(0, np.int64)
        if len(ids):
            u, at = np.unique(ids, return_inverse=True)
            g = np.zeros((len(u), self.dim), np.float32)
            np.add.at(g, at, np.concatenate([x for _, x in back]))
            g = g * len(y) + 1e-3 * self.words[u]
            squares[u] += g * g
            self.words[u] -= 0.1 * g / np.sqrt(squares[u])
            self.words[-1] = 0
        adam.step(self.at, grad)


def _read(texts: list[str], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """hashed_words of the texts, some MB at a time."""
    for _, _, buf, off in chunks(pa.array(texts, pa.string())):
        yield hashed_words(buf, off, bits)


def _held(own: np.ndarray, ends: np.ndarray, y: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """How many texts of label 1 and of label 0 hold each bucket."""
    row = np.repeat(np.arange(len(ends) - 1), ends[1:] - ends[:-1])
    pair = np.unique((row[:, None] * (1 << bits) + own).ravel())
    bucket, label = pair & ((1 << bits) - 1), y[pair >> bits] == 1
    return np.bincount(bucket[label], minlength=1 << bits), np.bincount(bucket[~label], minlength=1 << bits)


def train(pdf: pd.DataFrame, aim: float = 0.5) -> tuple[Network, dict[str | None, float], float]:
    """The network, each language's threshold and that of any other, from (text, lang, y)."""
    net = Network()
    y = pdf["y"].to_numpy(np.int64)
    if not len(y) or y.min() == y.max():
        net.at["out"][:] = 0
        return net, {}, aim
    held = np.arange(len(y)) % 4 == 3
    net.fit(pdf["text"][~held].tolist(), y[~held])
    if not held.any():  # too few rows to keep some
        return net, {}, aim
    raw = binned(np.concatenate([net.raw(*x) for x in _read(pdf["text"][held].tolist(), net.bits)]))
    counts = pd.DataFrame({"lang": pdf["lang"][held].to_numpy(object), "y": y[held], "bin": raw, "count": 1})
    return net, *_calibrated(net, counts)


def _calibrated(net: Network, counts: pd.DataFrame) -> tuple[dict[str | None, float], float]:
    """Thresholds by language and that of any other, from (lang, y, bin, count) of rows kept from training; fits ``net``'s slope and shift."""
    every = counts.groupby(["bin", "y"], as_index=False)["count"].sum()
    net.slope, net.shift = platt(every["bin"].to_numpy() * BIN, every["y"].to_numpy(), times=every["count"].to_numpy(float))

    def best(part: pd.DataFrame) -> float:
        """The threshold of best F1, midway between the scores that it parts."""
        by = part.assign(hits=part["y"] * part["count"]).groupby("bin")[["count", "hits"]].sum().sort_index(ascending=False)
        s = sigmoid(net.slope * by.index.to_numpy() * BIN + net.shift)
        f1 = 2 * by["hits"].cumsum().to_numpy() / (by["count"].cumsum().to_numpy() + by["hits"].sum())
        k = int(f1.argmax())
        return float((s[k] + (s[k + 1] if k + 1 < len(s) else 0)) / 2)

    found = {}
    for lang, part in counts[counts["lang"].notna()].groupby("lang"):
        if (part["y"] * part["count"]).sum() >= 10 and part["count"].sum() >= 40:
            found[lang] = best(part)
    return found, best(counts)


#: A slice of the embeddings that is averaged at once has 2 to the power SLICE buckets.
ROUNDS, EPOCHS, SLICE = 2, 8, 9


def learned(docs: DataFrame, labels: DataFrame, label: str, by: int, out: int, most: int = 4000, aim: float = 0.5) -> tuple[Network, dict[str | None, float], float]:
    """As ``train``, from every labelled row, by shards of about ``most`` rows."""
    net = Network()
    rows = told(docs, labels, label, by, out)
    kinds = {r["y"] for r in rows.select("y").distinct().collect()}
    if len(kinds) < 2:
        scratch.drop(rows)
        net.at["out"][:] = 0
        return net, {}, aim
    own, shards, n1, n0 = dealt(rows, most)
    n1, n0, bits = max(1, n1), max(1, n0), net.bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, zero = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for b in batches:
            for i, j, buf, off in chunks(b.column(0)):
                label1, label0 = _held(*hashed_words(buf, off, bits), b.column(1).to_numpy()[i:j], bits)
                one += label1
                zero += label0
        at = np.flatnonzero(one + zero)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(one[at]), pa.array(zero[at])], ["at", "one", "zero"])

    counts = own.select("text", "y").mapInArrow(count, "at long, one long, zero long").groupBy("at").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero"))
    counts = counts.toPandas()  # a row a bucket
    one, all_ = np.zeros(1 << bits), np.zeros(1 << bits)
    one[counts["at"]] = counts["one"]
    all_[counts["at"]] = counts["one"] + counts["zero"]
    net.start(one, all_, n1, n0)
    rounds = ROUNDS if shards > 1 else 1  # nothing to average
    for k in range(rounds):
        model = docs.sparkSession.sparkContext.broadcast(net)

        def fit(texts: list[str], y: np.ndarray, model=model, k: int = k) -> Parts:
            own = copy.deepcopy(model.value)
            met = own.learn(texts, y, n1, n0, EPOCHS // rounds, seed=5 + k)
            flat = np.concatenate([own.at[x].ravel() for x in sorted(own.at)])
            yield -1, np.arange(len(flat)), flat[:, None]
            for part in np.split(met, np.flatnonzero(np.diff(met >> SLICE)) + 1):
                if len(part):
                    yield int(part[0] >> SLICE), part, own.words[part]

        for piece, at, values in averaged(own, shards, fit):
            if piece >= 0:
                net.words[at] = values
                continue
            flat = values[:, 0]
            for x in sorted(net.at):
                net.at[x], flat = flat[: net.at[x].size].reshape(net.at[x].shape).copy(), flat[net.at[x].size :]
        model.destroy()
    net.words[all_ == 0] = 0
    net.words[-1] = 0
    model = docs.sparkSession.sparkContext.broadcast(net)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, off in chunks(b.column(0)):
                raw = model.value.raw(*hashed_words(buf, off, bits)) if len(buf) else np.full(j - i, model.value.at["offset"][0])
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(binned(raw))], ["lang", "y", "bin"])

    held = rows.where("held").select("text", "lang", "y").mapInArrow(bins, "lang string, y int, bin long")
    held = held.groupBy("lang", "y", "bin").count().toPandas()  # bins by label and language
    scratch.drop(rows)
    model.destroy()
    if not len(held):  # too few rows to keep some
        return net, {}, aim
    return net, *_calibrated(net, held)


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", by: int = 3, out: int = 1, most: int = 4000, cut: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted, threshold, flagged) of every document."""
    net, cuts, other = learned(docs, labels, label, by, out, most)
    # 8 MB of embeddings and a threshold for each language.
    model = docs.sparkSession.sparkContext.broadcast((net, cuts, other))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, cuts, other = model.value
        for b in batches:
            lang = b.column(3).to_pylist()
            for i, j, buf, off in chunks(b.column(1)):
                raw = net.raw(*hashed_words(buf, off, net.bits)) if len(buf) else np.full(j - i, net.at["offset"][0])
                s = sigmoid(net.slope * raw.astype(np.float64) + net.shift)
                bar = np.array([cuts.get(x, other) for x in lang[i:j]])
                cols = [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(s), pa.array((s >= cut).astype(np.int32)), pa.array(bar), pa.array(s >= bar)]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted", "threshold", "flagged"])

    id_ = F.col("doc_id").cast("long")
    held = F.coalesce(remainder(F.col("doc_id"), by) == out, F.lit(False))
    given = docs.select(id_.alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out"), F.col("lang").cast("string").alias("lang"))
    return given.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, threshold double, flagged boolean")
