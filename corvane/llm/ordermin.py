"""Near-duplicate documents by Order MinHash and banded alignment.

A text is its words, lower-cased runs of letters and digits; its k-mers are runs
of ``k`` words (all words of a shorter text), each labelled with its occurrence
number, so that a repeated k-mer is several. Each table takes the ``ell`` least
labelled k-mers under its hash and keeps them in text order; texts that agree in
a table are candidates. Few edits leave the order, so the agreement follows edit
similarity rather than the sets alone.

Candidates are aligned: labelled k-mers are unique in a text, so the longest
alignment of common ones is the longest increasing run of their places, taken
within the band of diagonals that a pair at the threshold can reach. A link has
aligned / (all - aligned) >= ``threshold``.

Texts of equal words, told by a SHA-256 of them, are joined first and need no
comparison. Documents of a bucket that are joined already are not compared again,
and of the others only those that share one of their rarest k-mers: two texts at
the threshold have so many in common that the rarest fifth of each must meet, so
none is missed. Large buckets are dealt into blocks, and every pair of blocks is
compared.

Null and empty texts, and texts without any word, join only equal texts (null
counts as empty). Null ids come back as they are with a null class, not kept.
Rows that repeat an id and a text fall into one class; rows that repeat an id with
another text are documents of their own. Of other columns none is read. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import scratch
from corvane.llm.components import components, forest
from corvane.llm.textscan import BYTE_HASH, LOWER, U64, chunks, mix, powers, prefix_hash, ragged, runs, span_hash

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[65:91] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True
FOLDED = BYTE_HASH[LOWER]
STEP = 0x8CB92BA72F3D8DD7


def occurrence(keys: np.ndarray) -> np.ndarray:
    """How often each key came before in the array."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    at = np.arange(len(k))
    out = np.empty(len(k), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return out


def kmers(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the labelled k-mers of texts, and each text's bounds in them."""
    s, e = runs(WORD_BYTE[buf], off)
    w = span_hash(prefix_hash(buf, FOLDED), s, e)
    rows = len(off) - 1
    at = np.searchsorted(s, off)
    count = at[1:] - at[:-1]
    mul = powers(k + 1, STEP)
    gram = np.zeros(len(w), U64)
    place = np.arange(len(w))
    end = np.repeat(at[1:], count)
    for j in range(k):
        inside = place + j < end
        gram[inside] += w[place[inside] + j] * mul[j + 1]
    keep = (place + k <= end) | (place == np.repeat(at[:-1], count))  # a short text's only one starts it
    row = np.repeat(np.arange(rows), count)[keep]
    gram = mix(gram[keep])
    label = occurrence(gram ^ mix(row.astype(U64) + U64(1)))
    return mix(gram + label.astype(U64) * U64(STEP)), np.searchsorted(row, np.arange(rows + 1))


def keys(buf: np.ndarray, off: np.ndarray) -> list[bytes]:
    """SHA-256 of each text's folded words; of its bytes where it has no word."""
    inside = WORD_BYTE[buf]
    s, e = runs(inside, off)
    at, size = np.searchsorted(s, off), (e - s).astype("<i8")
    ends = np.concatenate([[0], np.cumsum(size)])[at]
    letters = memoryview(LOWER[buf[inside]])
    raw, out = memoryview(np.ascontiguousarray(buf)), []
    for r in range(len(off) - 1):
        # The words' sizes part them; a text of none starts with 0 and can't equal one of some.
        h = hashlib.sha256((int(at[r + 1] - at[r])).to_bytes(8, "little") + size[at[r] : at[r + 1]].tobytes())
        h.update(letters[ends[r] : ends[r + 1]] if at[r + 1] > at[r] else raw[off[r] : off[r + 1]])
        out.append(h.digest())
    return out


def sketch(gram: np.ndarray, bounds: np.ndarray, tables: int, ell: int) -> np.ndarray:
    """Codes by text and table of the least labelled k-mers in text order; 0 for a text without any."""
    rows = len(bounds) - 1
    out = np.zeros((rows, tables), U64)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if not len(full):
        return out
    first = bounds[full]
    size = bounds[full + 1] - first
    row = np.repeat(np.arange(len(full)), size)
    seeds = mix(np.arange(1, tables + 1, dtype=U64))
    none = U64(2**64 - 1)
    for t in range(tables):
        r = (gram ^ seeds[t]) * (seeds[-1 - t] | U64(1))
        picked = np.full((len(full), ell), len(gram), np.int64)
        for j in range(ell):
            least = np.minimum.reduceat(r, first)
            at = np.flatnonzero((r == least[row]) & (r != none))
            picked[row[at[::-1]], j] = at[::-1]
            r[at] = none
        picked.sort(1)
        value = np.append(gram, U64(0))[picked]
        code = np.full(len(full), t + 1, U64)
        for j in range(ell):
            code = mix(code * U64(STEP) + value[:, j])
        out[full, t] = code
    return out


def common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and b of the labelled k-mers that both have."""
    both = np.concatenate([a, b])
    order = np.argsort(both, kind="stable")
    k = both[order]
    hit = np.flatnonzero(k[1:] == k[:-1])
    return order[hit], order[hit + 1] - len(a)


def longest(i: np.ndarray, j: np.ndarray, band: int) -> int:
    """The best alignment of common places within ``band`` diagonals of the main one."""
    keep = np.abs(i - j) <= band
    i, j = i[keep], j[keep]
    j = j[np.argsort(i)]
    if (j[1:] > j[:-1]).all():
        return len(j)
    tails: list[int] = []
    for x in j.tolist():
        p = bisect_left(tails, x)
        if p == len(tails):
            tails.append(x)
        else:
            tails[p] = x
    return len(tails)


def least_common(n: int, m: int, threshold: float) -> int:
    """How many of n and m k-mers a pair at the threshold aligns at least."""
    return int(np.ceil(round(threshold / (1 + threshold) * (n + m), 9)))


def linked(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """aligned / (all - aligned) >= threshold."""
    need = least_common(len(a), len(b), threshold)
    if min(len(a), len(b)) < need:
        return False
    i, j = common(a, b)
    return len(i) >= need and longest(i, j, len(a) + len(b) - 2 * need) >= need


class Rarest:
    """Which members of a bucket share one of their rarest k-mers.

    Each member's k-mers stand in one order for all, rare ones of the bucket first.
    A pair at the threshold t has t times the longer one's k-mers in common, so the
    first (1 - t) of each member's and one more must share one.
    """

    def __init__(self, seqs: list[np.ndarray], threshold: float):
        size = np.array([len(x) for x in seqs])
        own = np.repeat(np.arange(len(seqs)), size)
        _, group, count = np.unique(np.concatenate(seqs), return_inverse=True, return_counts=True)
        order = np.lexsort((group, count[group], own))
        start = np.cumsum(size) - size
        first = size - np.ceil(np.round(threshold * size, 9)).astype(np.int64) + 1
        order = order[(np.arange(len(order)) - np.repeat(start, size)) < np.repeat(first, size)]
        order = order[count[group[order]] > 1]
        self.n = len(seqs)
        self.group, own = group[order], own[order]
        self.off = np.searchsorted(own, np.arange(len(seqs) + 1))
        by = np.argsort(self.group, kind="stable")  # members rise within a group
        self.holder = own[by]
        self.first = np.searchsorted(self.group[by], np.arange(len(count) + 1))

    def of(self, low: int, y: int) -> np.ndarray:
        """Members low..y-1 that share one with y, those that share most first."""
        g = self.group[self.off[y] : self.off[y + 1]]
        found = self.holder[ragged(self.first[g], self.first[g + 1] - self.first[g])]
        c = np.bincount(found[(found >= low) & (found < y)], minlength=self.n)
        x = np.flatnonzero(c)
        return x[np.argsort(-c[x], kind="stable")]


class Bucket:
    """Joins the documents of one bucket, or of two blocks of it against each other."""

    def __init__(self, threshold: float):
        self.threshold = threshold
        self.a: list[int] = []
        self.b: list[int] = []

    def run(self, ids: list[int], seqs: list[np.ndarray], side: list[int], cross: bool) -> None:
        """Members come by rising length."""
        n = len(ids)
        root = list(range(n))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        def join(x: int, y: int) -> bool:
            if ids[x] != ids[y] and not linked(seqs[x], seqs[y], self.threshold):
                return False
            root[find(y)] = find(x)
            self.a.append(ids[x])
            self.b.append(ids[y])
            return True

        rarest = None
        low = parts = 0  # parts: classes among the members so far
        for y in range(n):
            while len(seqs[low]) < round(self.threshold * len(seqs[y]), 9):
                low += 1
            parts += 1
            tried = low < y and not (cross and side[y - 1] == side[y])
            if tried and join(y - 1, y):
                parts -= 1
            if parts == 1 or low >= y - tried:
                continue
            rarest = rarest or Rarest(seqs, self.threshold)
            for x in rarest.of(low, y).tolist():
                if not (tried and x == y - 1) and not (cross and side[x] == side[y]) and find(x) != find(y) and join(x, y):
                    parts -= 1

    def take(self) -> pa.RecordBatch:
        a, b = np.array(self.a, np.int64), np.array(self.b, np.int64)
        a, b = forest(a, b) if len(a) else (a, b)
        self.a, self.b = [], []
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def near_duplicates(
    docs: DataFrame,
    k: int = 5,
    threshold: float = 0.8,
    tables: int = 10,
    ell: int = 3,
    block: int = 500,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, component_id, kept): each document's class, named by its smallest id."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, off in chunks(b.column(1)):
                gram, bounds = kmers(buf, off, k)
                codes = sketch(gram, bounds, tables, ell).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * tables), pa.array(codes.ravel()))
                cols = [b.column(0).slice(i, j - i), pa.array(keys(buf, off), pa.binary()), pa.array(np.diff(bounds)), lists]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "key", "n", "codes"])

    all_ = scratch.table(given.mapInArrow(facts, "doc_id long, key binary, n long, codes array<long>"), "sketches")
    live = all_.where("doc_id is not null")
    reps = live.groupBy("key").agg(F.min(F.struct("doc_id", "n", "codes")).alias("r"))
    # The written table gives each distinct text a number of its own.
    reps = scratch.table(reps.select("key", "r.n", F.col("r.doc_id").alias("rep"), F.col("r.codes").alias("codes"), F.monotonically_increasing_id().alias("node")), "reps")

    cells = reps.where("n > 0").select("node", F.posexplode("codes").alias("tbl", "code"))
    met = cells.groupBy("tbl", "code").agg(F.count("*").alias("members")).where("members > 1")
    met = met.select(F.col("tbl").alias("t"), F.col("code").alias("c"), F.ceil(F.col("members") / block).cast("int").alias("nb"))
    shared = cells.join(met, (F.col("tbl") == F.col("t")) & (F.col("code") == F.col("c"))).select("tbl", "code", "node", "nb")
    shared = scratch.table(shared, "buckets")
    scratch.free(docs.sparkSession)  # of the shuffles so far
    wanted = shared.select("node").distinct().join(reps.select("node", "rep", "key"), "node")

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = -1  # rows that repeat an id and a text come one after another mostly
        for b in batches:
            node, want = b.column(0).to_numpy(), b.column(2).to_pylist()
            for i, j, buf, off in chunks(b.column(1)):
                same = np.array([x == y for x, y in zip(keys(buf, off), want[i:j], strict=True)], bool)
                same &= np.concatenate([[last], node[i : j - 1]]) != node[i:j]
                last = node[j - 1]
                gram, bounds = kmers(buf, off, k)
                seq = memoryview(gram).cast("B")
                blob = [seq[8 * x : 8 * y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                batch = pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(blob, pa.binary())], ["node", "seq"])
                yield batch.filter(pa.array(same))

    texts = wanted.join(given, F.col("rep") == F.col("doc_id")).select("node", "text", "key")
    seqs = scratch.table(texts.mapInArrow(sequences, "node long, seq binary"), "sequences")
    scratch.free(docs.sparkSession)  # of the texts' shuffle
    own = F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")
    dealt = shared.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    dealt = dealt.select("tbl", "code", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node").join(seqs, "node")
    group = ["tbl", "code", "i", "j"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.select(*group, F.length("seq").alias("size"), "node", "own", "seq")
    dealt = dealt.repartition(parts, *group).sortWithinPartitions(*group, "size", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Bucket(threshold)
        name, ids, data, side = None, [], [], []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in (0, 1, 2, 3, 5, 6, 7)]
            for t, c, i, j, node, block_, seq in zip(*cols, strict=True):
                if name != (t, c, i, j):
                    if len(ids) > 1:
                        bucket.run(ids, data, side, name[2] != name[3])
                    name, ids, data, side = (t, c, i, j), [], [], []
                ids.append(node)
                data.append(np.frombuffer(seq, U64))
                side.append(block_)
            if len(bucket.a) > 100_000:
                yield bucket.take()
        if len(ids) > 1:
            bucket.run(ids, data, side, name[2] != name[3])
        yield bucket.take()

    links = scratch.table(dealt.mapInArrow(compare, "a long, b long"), "links")
    del dealt, texts, wanted
    scratch.drop(seqs)
    scratch.drop(shared)
    scratch.free(docs.sparkSession)
    classes = components(links)
    named = reps.join(classes, "node", "left").select("key", "rep", F.coalesce("component_id", "node").alias("class"))
    least = named.groupBy("class").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "class").select("key", "component_id")
    told = live.select("doc_id", "key").join(named, "key").select("doc_id", "component_id")
    nameless = all_.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("component_id"))
    return told.unionByName(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
