"""Quality rules: base counts, and N-gram perplexity within language bands.

The model is an interpolated modified Kneser-Ney model over UTF-8 bytes, one for
each language. Spark counts the top order over all texts; the lower orders'
continuation counts, the discounts from counts of counts, and the probabilities
are Spark aggregations and joins. The finished model has every order's n-grams with their log
probabilities and every context with its back-off weight, so that an n-gram that
was never counted scores by interpolation like any other. It is read as sorted
arrays of 64-bit hashes, in blocks of about ``block_rows`` entries: a block is the
only thing broadcast, and a model of more blocks takes as many scans, whose sums
are added. A block has what the bytes after some two bytes of a language need,
which grows with the model; orders 1 and 2, bounded by the bytes, are in each.

A document's perplexity is per byte. Each language's band is its median log
perplexity less ``below`` and plus ``above`` robust deviations (1.4826 times the
median absolute deviation, ``least_spread`` at least); documents that fail the
base rules don't shape it. A short text's perplexity strays by chance, so deviations
count by the square root of n / (n + ``settled``) for n bytes, which widens the band of
short texts. Documents outside their language's band, or failing the base rules, are
rejected.

Null and empty texts have no words and fail the base rules. A null language is a
language of its own. Ids may be null or repeat. An empty table gives an empty
result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import scratch
from corvane.llm.textscan import BYTE_HASH, SPACE, U64, chunks, mix, per_row, powers, prefix_hash, repeats, runs, span_hash, words

ORDER = 5
CONTEXT = 16
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


def base_counts(buf: np.ndarray, off: np.ndarray, window: int = 5) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of texts."""
    s, e, row = words(buf, off)
    at = np.searchsorted(s, off)
    h = prefix_hash(buf)
    w = span_hash(h, s, e)
    rows = len(off) - 1
    salt = mix(np.arange(1, rows + 1, dtype=U64))

    mul = powers(window + 1, 0x8CB92BA72F3D8DD7)
    end = at[1:][row] if len(s) else row
    start = np.flatnonzero(np.arange(len(s)) + window <= end)
    gram = np.zeros(len(start), U64)
    for j in range(window):
        gram += w[start + j] * mul[j + 1]
    twice, _ = repeats(mix(gram) ^ salt[row[start]])
    mark = np.zeros(len(s) + 1, np.int64)
    first = start[twice]
    np.add.at(mark, first, 1)
    np.add.at(mark, first + window, -1)
    covered = np.cumsum(mark[:-1]) > 0

    line = buf == 10
    ls, le = runs(~line, off)
    has = np.searchsorted(s, le) > np.searchsorted(s, ls)
    ls, le = ls[has], le[has]
    lrow = np.searchsorted(off, ls, "right") - 1
    _, earlier = repeats(span_hash(h, ls, le) ^ salt[lrow])

    return {
        "n_words": at[1:] - at[:-1],
        "word_chars": per_row(~SPACE[buf] & ((buf & 0xC0) != 0x80), off),
        "n_symbols": per_row(SYMBOLS[buf], off),
        "n_dup_lines": np.bincount(lrow, weights=earlier, minlength=rows).astype(np.int64),
        "n_repeat_words": per_row(covered, at),
    }


def language_ids(langs: pa.Array) -> np.ndarray:
    """A 23-bit number for each language's name."""
    d = langs.dictionary_encode()
    names = np.array([zlib.crc32(x.encode()) & 0x7FFFFF for x in d.dictionary.to_pylist()] + [0], np.int64)
    at = d.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False)
    return names[at]


def grams(buf: np.ndarray, off: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """The top-order key at each byte: language, then the bytes up to it; zeros stand before a text."""
    n = len(buf)
    out = np.repeat(lang.astype(np.int64) << (8 * ORDER), off[1:] - off[:-1])
    since = np.arange(n) - np.repeat(off[:-1], off[1:] - off[:-1])
    wide = buf.astype(np.int64)
    for k in range(ORDER):
        if k:
            shifted = np.zeros(n, np.int64)
            shifted[k:] = wide[:-k]
            early = np.flatnonzero(since < k)
            shifted[early] = 0
            out |= shifted << (8 * k)
        else:
            out |= wide
    return out


def count_grams(docs: DataFrame) -> DataFrame:
    """(g, c): every language's top-order byte n-grams and their counts over all (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            g = np.concatenate([x for x, _ in held])
            c = np.concatenate([x for _, x in held])
            order = np.argsort(g, kind="stable")
            g, c = g[order], c[order]
            cut = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            return g[cut], np.add.reduceat(c, cut)

        for b in batches:
            lang = language_ids(b.column(0))
            for i, j, buf, off in chunks(b.column(1), 1 << 18):
                if len(buf):
                    held.append(np.unique(grams(buf, off, lang[i:j]), return_counts=True))
                    size += len(held[-1][0])
                if size > 1_000_000:
                    held = [merged()]
                    if len(held[0][0]) > 500_000:
                        yield pa.RecordBatch.from_arrays([*map(pa.array, held.pop())], ["g", "c"])
                    size = sum(len(x) for x, _ in held)
        if held:
            yield pa.RecordBatch.from_arrays([*map(pa.array, merged())], ["g", "c"])

    return docs.mapInArrow(run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def _lang(g: Column, order: int) -> Column:
    return F.shiftright(g, 8 * order)


def _low(g: Column, order: int) -> Column:
    """The gram without its first byte: the language and the last order - 1 bytes."""
    keep = F.lit((1 << (8 * (order - 1))) - 1)
    return F.shiftleft(_lang(g, order), 8 * (order - 1)).bitwiseOR(g.bitwiseAND(keep))


def train(counts: DataFrame) -> DataFrame:
    """(kind, g, v): the log probability of every n-gram g seen (kind n), and the log
    back-off weight of every context g of n - 1 bytes (kind CONTEXT + n).

    Modified Kneser-Ney: three discounts an order and language, interpolated down
    to a uniform distribution over bytes.
    """
    table: dict[int, DataFrame] = {ORDER: counts}
    for n in range(ORDER - 1, 0, -1):
        table[n] = scratch.table(table[n + 1].groupBy(_low(F.col("g"), n + 1).alias("g")).agg(F.count("*").alias("c")), f"order{n}")
    lower: DataFrame | None = None
    out: list[DataFrame] = []
    c = F.col("c")
    row = lambda kind, g, v: (F.lit(kind).cast("byte").alias("kind"), F.col(g).alias("g"), F.log(v).cast("float").alias("v"))
    for n in range(1, ORDER + 1):
        t = table[n].withColumn("l", _lang(F.col("g"), n))
        of = [F.sum(F.when(c == k, 1).otherwise(0)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
        d = t.groupBy("l").agg(*of)
        y = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(F.lit(0.5))
        ds = []
        for k in (1, 2, 3):
            ratio = F.when(F.col(f"n{k}") > 0, F.col(f"n{k + 1}") / F.col(f"n{k}")).otherwise(F.lit(0.5))
            ds.append(F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), F.lit(k) - (k + 1) * y * ratio)).alias(f"d{k}"))
        d = d.select("l", *ds)
        cut = F.when(c == 1, F.col("d1")).when(c == 2, F.col("d2")).otherwise(F.col("d3"))
        t = t.join(d, "l").withColumn("cut", cut).withColumn("x", F.shiftright("g", 8))
        x = scratch.table(t.groupBy("x").agg(F.sum("c").alias("s"), F.sum("cut").alias("held")), f"contexts{n}")
        t = t.join(x, "x").select("g", "c", "s", "held", "cut", _low(F.col("g"), n).alias("low"))
        if lower is None:
            p = (c - F.col("cut")) / F.col("s") + F.col("held") / F.col("s") / 256
        else:
            t = t.join(lower.select(F.col("g").alias("low"), F.col("p").alias("q")), "low")
            p = (c - F.col("cut")) / F.col("s") + F.col("held") / F.col("s") * F.col("q")
        lower = scratch.table(t.select("g", p.alias("p")), f"model{n}")
        out += [lower.select(*row(n, "g", F.col("p"))), x.select(*row(CONTEXT + n, "x", F.col("held") / F.col("s")))]
    return reduce(DataFrame.unionByName, out)


def block_of(key, blocks: int):
    """The block of a language and two bytes, put together as a number or a column of numbers."""
    return key % 1_000_003 % blocks


def blocked(model: DataFrame, k: int, blocks: int) -> DataFrame:
    """The entries that block ``k`` needs."""
    if blocks == 1:
        return model
    g, kind = F.col("g"), F.col("kind")
    own = F.lit(None).cast("long")
    for n in range(3, ORDER + 1):  # the two bytes before an n-gram's last, and a context's last two
        own = F.when(kind == n, _lang(g, n) * 65536 + F.shiftright(g, 8).bitwiseAND(F.lit(65535))).otherwise(own)
        own = F.when(kind == CONTEXT + n, _lang(g, n - 1) * 65536 + g.bitwiseAND(F.lit(65535))).otherwise(own)
    return model.where(F.coalesce(block_of(own, blocks) == k, F.lit(True)))


def hashed(kind: np.ndarray | int, g: np.ndarray) -> np.ndarray:
    return mix(mix(g.astype(U64)) + np.asarray(kind).astype(U64) * U64(0x9E3779B97F4A7C15))


class HashArrays:
    """Sorted hashes with values, found through an index of their leading bits."""

    def __init__(self, h: np.ndarray, values: np.ndarray, bits: int = 20):
        order = np.argsort(h)
        self.h, self.v, self.shift = np.append(h[order], U64(2**64 - 1)), np.append(values[order], 0).astype(np.float32), U64(64 - bits)
        self.first = np.searchsorted(self.h[:-1], np.arange(1 << bits, dtype=U64) << self.shift).astype(np.uint32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, 0 where missing, and which are there."""
        at = self.first[(h >> self.shift).astype(np.int64)].astype(np.int64)
        rest = np.flatnonzero(self.h[at] < h)
        while len(rest):
            at[rest] += 1
            rest = rest[self.h[at[rest]] < h[rest]]
        hit = self.h[at] == h
        return np.where(hit, self.v[at], np.float32(0)), hit

    def logs(self, g: np.ndarray, step: int = 1 << 18) -> np.ndarray:
        """Log probabilities of top-order n-grams: seen ones as stored, others by backing off."""
        out = np.zeros(len(g), np.float32)
        for k in range(0, len(g), step):
            out[k : k + step], hit = self.find(hashed(ORDER, g[k : k + step]))
            if not hit.all():
                rest = k + np.flatnonzero(~hit)
                out[rest] = self._unseen(g[rest])
        return out

    def _unseen(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(len(g), np.float32)
        rest = np.arange(len(g))
        for n in range(ORDER - 1, -1, -1):
            key = ((g[rest] >> (8 * ORDER)) << (8 * n)) | (g[rest] >> 8 & ((1 << (8 * n)) - 1))
            out[rest] += self.find(hashed(CONTEXT + n + 1, key))[0]
            if not n:
                break
            value, hit = self.find(hashed(n, ((g[rest] >> (8 * ORDER)) << (8 * n)) | (g[rest] & ((1 << (8 * n)) - 1))))
            out[rest] += value
            rest = rest[~hit]
        out[rest] -= np.float32(np.log(256))
        return out


def log_likelihood(docs: DataFrame, model: DataFrame, block_rows: int = 4_000_000) -> DataFrame:
    """(doc_id, lang, ..., base counts, n_bytes, logp) of (doc_id, lang, text, ...) under a model of ``train``; columns after text stay as they are."""
    spark = docs.sparkSession
    model = scratch.table(model, "model")
    blocks = max(1, -(-model.count() // block_rows))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    kept = [c for c in docs.columns if c != "text"]
    given = docs.select(F.col("text"), *kept)
    if blocks > 1:  # the sums of several scans need rows that keep their numbers
        given = scratch.table(given.withColumn("rid", F.monotonically_increasing_id()), "numbered")

    def scan(arrays, k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lang = language_ids(b.column("lang"))
                for i, j, buf, off in chunks(b.column(0), 1 << 18):
                    g = grams(buf, off, lang[i:j])
                    if blocks == 1:
                        value = arrays.value.logs(g)
                    else:
                        value = np.zeros(len(g), np.float32)
                        own = np.flatnonzero(block_of((g >> (8 * ORDER)) * 65536 + ((g >> 8) & 65535), blocks) == k)
                        value[own] = arrays.value.logs(g[own])
                    cum = np.concatenate([[0.0], np.cumsum(value.astype(np.float64))])
                    cols = {c: b.column(c).slice(i, j - i) for c in (kept if blocks == 1 else ["rid"])}
                    if k == 0:
                        cols |= {x: pa.array(v) for x, v in base_counts(buf, off).items()}
                        cols["n_bytes"] = pa.array(off[1:] - off[:-1])
                    cols["logp"] = pa.array(cum[off[1:]] - cum[off[:-1]])
                    yield pa.RecordBatch.from_arrays([*cols.values()], [*cols])

        return run

    total = None
    for k in range(blocks):
        got = blocked(model, k, blocks).toArrow()  # about block_rows rows
        h = hashed(got.column("kind").to_numpy(), got.column("g").to_numpy())
        arrays = spark.sparkContext.broadcast(HashArrays(h, got.column("v").to_numpy()))
        kinds = T.StructType([given.schema[c] for c in (kept if blocks == 1 else ["rid"])])
        for x in [*names, "n_bytes"] if k == 0 else []:
            kinds = kinds.add(x, T.LongType())
        scored = scratch.table(given.mapInArrow(scan(arrays, k), kinds.add("logp", T.DoubleType())), "scores")
        arrays.unpersist()
        total = scored if total is None else total.unionByName(scored, allowMissingColumns=True)
    if blocks > 1:
        sums = [F.sum(x).alias(x) for x in (*names, "n_bytes", "logp")]
        total = given.drop("text").join(total.groupBy("rid").agg(*sums), "rid").drop("rid")
    return total


def verdicts(
    docs: DataFrame, below: float = 6.0, above: float = 4.0, least_spread: float = 0.02, settled: int = 400, block_rows: int = 4_000_000
) -> DataFrame:
    """(doc_id, lang, text, ...) without the text, with base counts, log perplexity, its band and the verdict."""
    counts = scratch.table(count_grams(docs.select("lang", "text")), "counts")
    scored = log_likelihood(docs, train(counts), block_rows)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    # Rounded, so that the exact percentiles keep a bounded number of values.
    entropy = F.when(F.col("n_bytes") > 0, F.round(-F.col("logp") / F.col("n_bytes"), 3))
    scored = scored.withColumn("base_failed", failed).withColumn("log_ppl", entropy)
    scored = scored.withColumn("sure", F.when(F.col("n_bytes") > 0, F.sqrt(F.col("n_bytes") / (F.col("n_bytes") + settled))))
    shaping = scored.where(~F.col("base_failed"))
    # A row a language; the joins broadcast these only where adaptive execution finds them small.
    mid = shaping.groupBy("lang").agg(F.percentile("log_ppl", F.lit(0.5)).alias("mid")).withColumnRenamed("lang", "l")
    away = shaping.join(mid, F.col("lang").eqNullSafe(F.col("l"))).select("l", "mid", F.round(F.abs(F.col("log_ppl") - F.col("mid")) * F.col("sure"), 3).alias("off"))
    band = away.groupBy("l", "mid").agg((1.4826 * F.percentile("off", F.lit(0.5))).alias("spread"))
    band = scratch.table(band.select("l", "mid", F.greatest(F.col("spread"), F.lit(least_spread)).alias("spread")), "bands")
    out = scored.join(band, F.col("lang").eqNullSafe(F.col("l")), "left")
    out = out.withColumn("low", F.col("mid") - below * F.col("spread") / F.col("sure")).withColumn("high", F.col("mid") + above * F.col("spread") / F.col("sure"))
    inside = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & inside)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **more) -> DataFrame:
    """Base counts, perplexity, its band and the verdict for every document; ``more`` goes to ``verdicts``."""
    given = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    return verdicts(given, **more).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.exp("log_ppl").alias("perplexity"), F.exp("low").alias("low_perplexity"), F.exp("high").alias("high_perplexity"),
    )


def filtered(docs: DataFrame, **more) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept; every row by its own verdict, without a join by id."""
    given = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.struct(*docs.columns).alias("row"))
    return verdicts(given, **more).where("kept").select("row.*")
