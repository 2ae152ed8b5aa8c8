"""Ranked lexical search in a two-level quantised index, exact to the last integer.

The index has a row for each block of documents: the block's terms, sorted by hash,
and their postings. On the first level a posting is a place in the block and one
byte, the term's impact rounded up to 255ths of the largest there can be. The second
level has what the exact impact is made of: term frequencies and document lengths.
No posting is shuffled, neither to build nor to search.

A search reads the first level twice and the second once. From a byte's lower end
follow lower bounds of scores; the k-th largest of all is a bar that the k best
documents reach. From its upper end follow upper bounds; every document whose upper
bound reaches the bar, ties included, is scored again in exact integers, and of those
scores the k best are the answer. Tasks hand on one row each, a matrix of queries by
k bounds, and the candidates' best; queries go in lots of ``lot``, so that what is
broadcast and gathered is bounded by the lot and k, not by the documents.

A text's terms are its maximal runs of ASCII letters, digits and characters beyond
ASCII, with A to Z lower-cased; whole texts count. Terms are told apart by two
polynomials modulo a prime. Null and empty texts have no term and are never found.
Rows of equal id are documents of their own; equal scores go by ascending id, null
ids first. Queries of equal or null id are one query, of the terms of all of them;
those without a term, or on an empty table, find nothing. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import scratch
from corvane.llm.ordermin import FOLDED, WORD_BYTE
from corvane.llm.textscan import chunks, prefix_hash, ragged, runs, span_hash

MOST = 1_000_000  # no impact is larger
STEPS = 255
#: Upper and lower end of what a byte stands for.
UPPER = (np.arange(STEPS + 1) * MOST // STEPS).astype(np.float64)
LOWER = np.concatenate([[0], UPPER[:-1] + 1])

INDEX = "n_docs long, n_terms long, terms binary, starts binary, places binary, impacts binary, doc_ids array<long>, lengths binary, tfs binary"


def counts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The number of terms of each text."""
    starts, _ = runs(WORD_BYTE[buf], off)
    return np.diff(np.searchsorted(starts, off))


def terms(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' terms, in order, and each text's bounds in them."""
    starts, ends = runs(WORD_BYTE[buf], off)
    return span_hash(prefix_hash(buf, FOLDED), starts, ends), np.searchsorted(starts, off)


def norm(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """The documents' m."""
    return 50 + 50 * lengths * n // max(1, total)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def postings(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, starts, places, tfs, lengths): distinct terms ascending, their postings by place."""
    h, bounds = terms(buf, off)
    lengths = np.diff(bounds)
    place = np.repeat(np.arange(len(lengths)), lengths)
    order = np.argsort(h, kind="stable")
    h, place = h[order], place[order]
    new_term = np.ones(len(h), bool)
    new_term[1:] = h[1:] != h[:-1]
    new = new_term.copy()
    new[1:] |= place[1:] != place[:-1]
    at = np.flatnonzero(new)
    starts = np.append(np.flatnonzero(new_term[at]), len(at))
    return h[new_term], starts, place[at], np.diff(np.append(at, len(h))), lengths


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2 << 20, path: str | None = None) -> DataFrame:
    """The index of all rows, as a table below ``path`` or in the scratch folder; blocks hold about ``block_bytes`` of text, or one longer text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for b in batches:
            for _, _, buf, off in chunks(b.column(0)):
                own = counts(buf, off)
                n, total = n + int((own > 0).sum()), total + int(own.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total])], ["n", "total"])

    text = F.col(text_col).cast("string").alias("text")
    n, total = (x or 0 for x in docs.select(text).mapInArrow(count, "n long, total long").agg(F.sum("n"), F.sum("total")).first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, off in chunks(b.column(1), block_bytes):
                own, starts, place, tf, lengths = postings(buf, off)
                byte = -(-impact(tf, norm(lengths, n, total)[place]) * STEPS // MOST)
                blobs = [own, starts.astype(np.uint32), place.astype(np.uint32), byte.astype(np.uint8), lengths.astype(np.int64), tf.astype(np.uint32)]
                cells = [pa.array([int((lengths > 0).sum())], pa.int64()), pa.array([int(lengths.sum())], pa.int64())]
                cells += [pa.array([x.tobytes()], pa.binary()) for x in blobs[:4]]
                cells.append(pa.array([b.column(0).slice(i, j - i).to_pylist()], pa.list_(pa.int64())))
                cells += [pa.array([x.tobytes()], pa.binary()) for x in blobs[4:]]
                yield pa.RecordBatch.from_arrays(cells, [f.split()[0] for f in INDEX.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text).mapInArrow(run, INDEX)
    if path is None:
        return scratch.table(rows, "impacts")
    rows.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


class Asked:
    """The terms of a lot of queries, ascending, and the queries' weights for them."""

    def __init__(self, ids: list, query: np.ndarray, term: np.ndarray):
        self.ids = ids
        self.terms, self.column = np.unique(term, return_inverse=True)
        self.query = query
        self.weight = np.zeros(len(self.terms), np.int64)

    def weigh(self, n: int, df: np.ndarray) -> None:
        self.weight = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)

    def met(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the asked terms that a block has, among the asked and in the block."""
        at = np.searchsorted(own, self.terms)
        found = np.flatnonzero(np.append(own, 0)[at] == self.terms) if len(own) else np.zeros(0, np.int64)
        return found[at[found] < len(own)], at[found[at[found] < len(own)]]

    def weights(self, found: np.ndarray) -> np.ndarray:
        """Queries by found terms. Sums of products stay exact: in doubles as long as no score can reach 2**53."""
        w = np.zeros((len(self.ids), len(self.terms)), np.int64)
        w[self.query, self.column] = self.weight[self.column]
        exact = np.float64 if w.sum(1).max(initial=0) * MOST < 1 << 53 else np.int64
        return w[:, found].astype(exact)


def _scores(asked: Asked, block: dict, values: Callable[[np.ndarray], np.ndarray], cells: int = 4_000_000) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first place, queries by places, terms' weights, postings, their term) of some documents at a time; ``values`` gives each posting's number."""
    own, starts = np.frombuffer(block["terms"], np.uint64), np.frombuffer(block["starts"], np.uint32).astype(np.int64)
    found, at = asked.met(own)
    if not len(found):
        return
    w = asked.weights(found)
    size = starts[at + 1] - starts[at]
    post = ragged(starts[at], size)
    term = np.repeat(np.arange(len(found)), size)
    place = np.frombuffer(block["places"], np.uint32)[post].astype(np.int64)
    value = values(post)
    some, docs = max(1, cells // len(found)), int(place.max()) + 1
    for a in range(0, docs, some):
        use = np.arange(len(post)) if docs <= some else np.flatnonzero((place >= a) & (place < a + some))
        table = np.zeros((len(found), min(some, docs - a)), w.dtype)
        table[term[use], place[use] - a] = value[use]
        yield a, w @ table, w, post[use], term[use]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {name: b.column(k)[i].as_py() for k, name in enumerate(b.schema.names)}


def _gathered(rows: DataFrame, fold: Callable[[np.ndarray, np.ndarray], np.ndarray], kind: type) -> np.ndarray | None:
    """All tasks' arrays folded into one: by some tasks first, of their results on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = None
        for r in _rows(batches):
            x = np.frombuffer(r["x"], kind)
            have = x if have is None else fold(have, x)
        if have is not None:
            yield pa.RecordBatch.from_arrays([pa.array([have.tobytes()], pa.binary())], ["x"])

    some = max(1, round(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) ** 0.5))
    have = None
    for r in rows.repartition(some).mapInArrow(run, "x binary").toLocalIterator():  # as many arrays as ``some``
        x = np.frombuffer(r["x"], kind)
        have = x if have is None else fold(have, x)
    return have


def search(index: DataFrame, queries: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text", lot: int = 500) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every query."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, buf, off in chunks(b.column(1)):
                h, bounds = terms(buf, off)
                ids = b.column(0).slice(i, j - i).take(pa.array(np.repeat(np.arange(j - i), np.diff(bounds))))
                yield pa.RecordBatch.from_arrays([ids, pa.array(h.view(np.int64))], ["id", "term"])

    given = queries.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    said = given.mapInArrow(read, "id long, term long").distinct()
    n = index.agg(F.sum("n_docs")).first()[0] or 0
    lots = max(1, -(-given.select("id").distinct().count() // lot))
    out = None
    for i in range(lots):
        part = said if lots == 1 else said.where(F.pmod(F.xxhash64("id"), F.lit(lots)) == i)
        pairs = part.toArrow()  # the terms of about ``lot`` queries
        query, names = pd.factorize(pairs["id"].to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get), use_na_sentinel=False)
        asked = Asked([None if pd.isna(x) else int(x) for x in names], query, pairs["term"].to_numpy().view(np.uint64))
        best = _lot(index, asked, n, k)
        out = best if out is None else out.unionByName(best)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _lot(index: DataFrame, asked: Asked, n: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): of every task the k best of its documents that can be among the k best of all."""
    schema = "item_id long, doc_id long, score long"
    if not asked.ids:
        return index.sparkSession.createDataFrame([], schema)
    context = index.sparkSession.sparkContext
    held = context.broadcast(asked)  # the terms of a lot

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, df = held.value, np.zeros(len(held.value.terms), np.int64)
        for block in _rows(batches):
            found, at = asked.met(np.frombuffer(block["terms"], np.uint64))
            df[found] += np.diff(np.frombuffer(block["starts"], np.uint32).astype(np.int64))[at]
        yield pa.RecordBatch.from_arrays([pa.array([df.tobytes()], pa.binary())], ["x"])

    df = _gathered(index.select("terms", "starts").mapInArrow(frequency, "x binary"), np.add, np.int64)
    asked.weigh(n, np.zeros(len(asked.terms), np.int64) if df is None else df)
    weighed = context.broadcast(asked)

    def most(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The k largest of each query's numbers."""
        both = np.hstack([a.reshape(len(asked.ids), -1), b.reshape(len(asked.ids), -1)])
        return (np.partition(both, both.shape[1] - k, axis=1)[:, -k:] if both.shape[1] > k else both).ravel()

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = weighed.value
        have = np.zeros(len(asked.ids) * k, np.int64)
        for block in _rows(batches):
            byte = np.frombuffer(block["impacts"], np.uint8)
            for _, scores, *_ in _scores(asked, block, lambda post: LOWER[byte[post]]):  # noqa: B023
                have = most(have, scores.astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([have.tobytes()], pa.binary())], ["x"])

    first = ["terms", "starts", "places", "impacts"]
    top = _gathered(index.select(first).mapInArrow(lower, "x binary"), most, np.int64)
    bar = np.zeros(len(asked.ids), np.int64) if top is None else top.reshape(len(asked.ids), k).min(1)
    total = index.agg(F.sum("n_terms")).first()[0] or 0

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = weighed.value
        query, doc, null, score = (np.zeros(0, kind) for kind in (np.int64, np.int64, bool, np.int64))
        for block in _rows(batches):
            byte, tf = np.frombuffer(block["impacts"], np.uint8), np.frombuffer(block["tfs"], np.uint32).astype(np.int64)
            place = np.frombuffer(block["places"], np.uint32).astype(np.int64)
            m = norm(np.frombuffer(block["lengths"], np.int64), n, total)
            ids = None
            for a, upper, w, post, term in _scores(asked, block, lambda post: UPPER[byte[post]]):  # noqa: B023
                q, at = np.nonzero((upper >= bar[:, None]) & (upper > 0))
                if not len(q):
                    continue
                own, column = np.unique(at, return_inverse=True)
                use = post[np.isin(place[post] - a, own)]
                kept = term[np.isin(place[post] - a, own)]
                table = np.zeros((w.shape[1], len(own)), w.dtype)
                table[kept, np.searchsorted(own, place[use] - a)] = impact(tf[use], m[place[use]])
                s = (w @ table)[q, column].astype(np.int64)
                if ids is None:
                    ids = pa.array(block["doc_ids"], pa.int64())
                    gone, ids = np.array(ids.is_null()), ids.fill_null(0).to_numpy()
                real = s > 0
                query, score = np.append(query, q[real]), np.append(score, s[real])
                doc, null = np.append(doc, ids[at[real] + a]), np.append(null, gone[at[real] + a])
            if len(query) > 2 * k * len(asked.ids):
                query, doc, null, score = _kept(query, doc, null, score, k)
        query, doc, null, score = _kept(query, doc, null, score, k)
        names = pa.array(asked.ids, pa.int64()).take(pa.array(query))
        yield pa.RecordBatch.from_arrays([names, pa.array(doc, mask=null), pa.array(score)], ["item_id", "doc_id", "score"])

    return index.select(*first, "doc_ids", "lengths", "tfs").mapInArrow(exact, schema)


def _kept(query: np.ndarray, doc: np.ndarray, null: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of every query: higher scores, then null ids, then lower ones."""
    order = np.lexsort((doc, ~null, -score, query))
    own = query[order]
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    order = order[rank < k]
    return query[order], doc[order], null[order], score[order]
