"""Removal of passages that stand in an earlier document, by sorted suffixes.

Every byte covered by a string of ``width`` bytes that also starts in a document
with a smaller id is removed; matches never cross documents and are judged on the
input. The work is dealt by content:

1.  A window of ``width`` bytes is named by the least hash of its ``gram``-byte
    strings, which equal windows share. A document's windows fall into runs of one
    name. A chunk asks about each name once, however many of its documents have
    it; where several have, they are answered on the spot.
2.  Each document takes its runs under names that others have, as snippets. Of
    equal snippets in a chunk the smallest id's are sent; the others' are covered
    already.
3.  A shard holds all snippets of its names. Its suffixes are sorted by external
    induced sorting (see ``induced``); neighbours that share ``width`` symbols are
    one group of equal windows, whose smallest document keeps them. The text, the
    arrays over it and the queues are in memory up to a budget that ``memory`` sets,
    and beyond it in files, so a shard may be many times as large. There are as many
    shards, and as many buckets of documents for what is found, as the measured size of
    all texts asks for, so that neither grows with the input.
4.  Each document's covered spans are joined and cut out.

Whole copies of an earlier document are told by digest and take no part.

A null text counts as empty. Texts under ``width`` bytes lose nothing. A null id
keeps its text and takes nothing from others. Rows that repeat an id and a text are
one document and get the same result; an id that stands for several texts of
``width`` bytes or more keeps them whole and takes nothing from others. Every row
comes back once. Of other columns none is read; ``row`` hands them on. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import scratch
from corvane.llm.induced import Column, Sorter, Store
from corvane.llm.textscan import U64, chunks, mix, ragged

CHUNK = 1 << 20
#: Bytes of text, about, whose names fall to one shard, and whose answers to one bucket: 2.5 million names of 16 bytes.
SHARE = 32 << 20
NAME_BYTES = 6


def _words(buf: np.ndarray, shift: int) -> np.ndarray:
    """The eight bytes from each position on, past ``shift``, as one number; zeros follow the end."""
    padded = np.concatenate([buf, np.zeros(shift + 8, np.uint8)])
    return np.ndarray((len(buf),), "<u8", padded.data, shift, (1,)).astype(np.uint64)


def window_runs(buf: np.ndarray, off: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one name: 48-bit name, row, first window and count; windows don't cross rows."""
    n = len(buf)
    if n < width:
        return np.zeros(0, U64), *(np.zeros(0, np.int64) for _ in range(3))
    h = _words(buf, 0)
    for j in range(8, gram, 8):
        h *= U64(0x9E3779B97F4A7C15)
        h ^= _words(buf, j)
    h = mix(h)
    span, need = 1, width - gram + 1
    while span * 2 <= need:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    if span < need:
        h = np.minimum(h[: len(h) - (need - span)], h[need - span :])
    name = h[: n - width + 1] >> U64(64 - 8 * NAME_BYTES)
    size = off[1:] - off[:-1]
    last = np.repeat(off[1:] - width, size)[: len(name)]
    ok = np.arange(len(name)) <= last
    first = ok.copy()
    first[1:] &= ~ok[:-1] | (name[1:] != name[:-1])
    starts = off[:-1][size >= width]
    first[starts] = True
    at = np.flatnonzero(first)
    row = np.searchsorted(off, at, "right") - 1
    stop = np.minimum(np.append(at[1:], n), off[1:][row] - width + 1)
    return name[at], row, at, stop - at


def _packed(values: np.ndarray) -> np.ndarray:
    """48-bit names as six bytes each."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :NAME_BYTES]


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // NAME_BYTES, 8), np.uint8)
    out[:, :NAME_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, NAME_BYTES)
    return out.reshape(-1).view("<u8").astype(U64)


def _shard(name: np.ndarray, shards: int) -> np.ndarray:
    return (mix(name) % U64(shards)).astype(np.int64)


def _cuts(key: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal keys."""
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]) if len(key) else np.zeros(1, np.int64)


ASK = "shard int, doc_id long, docs binary, counts binary, names binary"


def _ask(docs: DataFrame, width: int, gram: int, shards: int) -> DataFrame:
    """For each chunk and shard the names that one document has; with shard -1, for each document those that several have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for i, j, buf, off in chunks(b.column(1), CHUNK):
                doc = ids[i:j]
                name, row, _, _ = window_runs(buf, off, width, gram)
                order = np.lexsort((doc[row], name))
                name, row = name[order], row[order]
                new = np.concatenate([[True], (name[1:] != name[:-1]) | (doc[row][1:] != doc[row][:-1])]) if len(name) else np.zeros(0, bool)
                name, row = name[new], row[new]
                group = np.cumsum(np.concatenate([[True], name[1:] != name[:-1]])) - 1 if len(name) else np.zeros(0, np.int64)
                several = np.bincount(group)[group] > 1 if len(name) else np.zeros(0, bool)
                lead = np.concatenate([[True], name[1:] != name[:-1]]) if len(name) else several
                out: list[tuple] = []
                where = _shard(name, shards)
                for told in (False, True):
                    # Of several documents' names one still asks, for the other chunks' sake.
                    pick = np.flatnonzero(several if told else ~several | lead)
                    key = np.full(len(pick), -1) if told else where[pick]
                    pick = pick[np.lexsort((doc[row[pick]], key))]
                    key = np.full(len(pick), -1) if told else where[pick]
                    who = doc[row[pick]]
                    bounds = _cuts(key) if not told else _cuts(who)
                    for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                        part, names = who[s:e], _packed(name[pick[s:e]]).tobytes()
                        if told:
                            out.append((-1, int(part[0]), None, None, names))
                        else:
                            cut = _cuts(part)
                            out.append((int(key[s]), None, part[cut[:-1]].astype("<i8").tobytes(), np.diff(cut).astype("<i4").tobytes(), names))
                if out:
                    yield _batch(out, ["shard", "doc_id", "docs", "counts", "names"], [pa.int32(), pa.int64(), *[pa.binary()] * 3])

    return docs.mapInArrow(run, ASK)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _dealt(doc: np.ndarray, buckets: int, *columns: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket of documents: ids, how many entries each has, and the entries' columns, packed."""
    bucket = _shard(doc.astype(U64), buckets)
    order = np.lexsort((doc, bucket))
    doc, bucket = doc[order], bucket[order]
    cols = [np.ascontiguousarray(c[order]) for c in columns]
    edges, rows = _cuts(bucket), []
    for s, e in zip(edges[:-1], edges[1:], strict=True):
        cut = _cuts(doc[s:e])
        rows.append((int(bucket[s]), doc[s:e][cut[:-1]].astype("<i8").tobytes(), np.diff(cut).astype("<i4").tobytes(), *[c[s:e].tobytes() for c in cols]))
    return _batch(rows, ["bucket", "docs", "counts", *[f"c{k}" for k in range(len(cols))]], [pa.int32(), *[pa.binary()] * (2 + len(cols))])


def _each(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[tuple]]:
    """The rows of each run of one first column, as lists of the others."""
    at, rows = None, []
    for b in batches:
        for key, *row in zip(*(b.column(k).to_pylist() for k in names), strict=True):
            if key != at and rows:
                yield rows
                rows = []
            at = key
            rows.append(row)
    if rows:
        yield rows


def shares(size: int, parts: int) -> tuple[int, int]:
    """Shards and buckets for texts of ``size`` bytes together: some a task, and so many that none has more than SHARE of them, about."""
    least = -(-size // SHARE)
    return max(4 * parts, least), max(parts, least)


def _together(dealt: DataFrame, parts: int, by: str) -> DataFrame:
    """Rows of one shard or bucket one after another."""
    return dealt.repartition(parts, by).sortWithinPartitions(by)


def _gathered(dealt: DataFrame, parts: int, names: list[str], widths: list[int]) -> DataFrame:
    """A row a document from the rows of ``_dealt``: (doc_id, packed columns); a bucket at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _each(batches, ["bucket", "docs", "counts", *[f"c{k}" for k in range(len(names))]]):
            doc = np.concatenate([np.repeat(np.frombuffer(d, "<i8"), np.frombuffer(c, "<i4")) for d, c, *_ in rows])
            order = np.argsort(doc, kind="stable")
            doc = doc[order]
            flat = [np.frombuffer(b"".join(r[2 + k] for r in rows), np.uint8).reshape(-1, w)[order] for k, w in enumerate(widths)]
            cut = _cuts(doc)
            out = [(int(doc[s]), *[f[s:e].tobytes() for f in flat]) for s, e in zip(cut[:-1], cut[1:], strict=True)]
            for k in range(0, len(out), 20_000):
                yield _batch(out[k : k + 20_000], ["doc_id", *names], [pa.int64(), *[pa.binary()] * len(names)])

    return _together(dealt, parts, "bucket").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} binary" for n in names))


def _answer(buckets: int, lot: int = 2_000_000):
    """The asked names that another document asked about too, by buckets of the documents that asked.

    Names are compared a shard at a time; the answers of about ``lot`` names are dealt together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, names, held = [], [], 0
        for rows in _each(batches, ["shard", "docs", "counts", "names"]):
            name = np.concatenate([_unpacked(n) for _, _, n in rows])
            doc = np.concatenate([np.repeat(np.frombuffer(d, "<i8"), np.frombuffer(c, "<i4")) for d, c, _ in rows])
            order = np.argsort(name)
            cut = _cuts(name[order])
            keep = order[np.repeat(np.diff(cut) > 1, np.diff(cut))]  # in order of names
            if not len(keep):
                continue
            cut = _cuts(name[keep])
            low, high = np.minimum.reduceat(doc[keep], cut[:-1]), np.maximum.reduceat(doc[keep], cut[:-1])
            keep = keep[np.repeat(low != high, np.diff(cut))]
            docs.append(doc[keep]), names.append(name[keep])
            held += len(keep)
            if held > lot:
                yield _dealt(np.concatenate(docs), buckets, _packed(np.concatenate(names)))
                docs, names, held = [], [], 0
        if held:
            yield _dealt(np.concatenate(docs), buckets, _packed(np.concatenate(names)))

    return run


SEND = "shard int, doc_id long, docs binary, starts binary, sizes binary, data binary"


def _snippets(texts: DataFrame, width: int, gram: int, shards: int) -> DataFrame:
    """For each chunk and shard the distinct snippets; with shard -1, for each document the spans that its chunk covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            known = b.column(2).to_pylist()
            for i, j, buf, off in chunks(b.column(1), CHUNK):
                doc = ids[i:j]
                name, row, at, count = window_runs(buf, off, width, gram)
                told = [_unpacked(b"".join(x)) for x in known[i:j]]
                salt = mix(np.arange(1, j - i + 1, dtype=U64))
                wanted = np.concatenate([mix(t ^ salt[r]) for r, t in enumerate(told)])
                pick = np.flatnonzero(np.isin(mix(name ^ salt[row]), wanted))
                name, row, at, size = name[pick], row[pick], at[pick], count[pick] + width - 1
                raw = buf.tobytes()
                first: dict[bytes, int] = {}
                order = np.lexsort((at, doc[row]))
                send, spans = [], []
                for k, a, n in zip(order.tolist(), at[order].tolist(), size[order].tolist(), strict=True):
                    k0 = first.setdefault(raw[a : a + n], k)
                    (spans if doc[row[k0]] < doc[row[k]] else send).append(k)
                out: list[tuple] = []
                if spans:
                    sp = np.array(spans)
                    start = at[sp] - off[row[sp]]
                    cut = _cuts(doc[row[sp]])
                    for s, e in zip(cut[:-1], cut[1:], strict=True):
                        out.append((-1, int(doc[row[sp[s]]]), None, start[s:e].astype("<i8").tobytes(), size[sp[s:e]].astype("<i4").tobytes(), None))
                if send:
                    sd = np.array(send)
                    where = _shard(name[sd], shards)
                    sd = sd[np.argsort(where, kind="stable")]
                    cut = _cuts(np.sort(where))
                    where = np.sort(where)
                    for s, e in zip(cut[:-1], cut[1:], strict=True):
                        p = sd[s:e]
                        data = buf[ragged(at[p], size[p])].tobytes()
                        out.append((int(where[s]), None, doc[row[p]].astype("<i8").tobytes(), (at[p] - off[row[p]]).astype("<i8").tobytes(), size[p].astype("<i4").tobytes(), data))
                if out:
                    yield _batch(out, ["shard", "doc_id", "docs", "starts", "sizes", "data"], [pa.int32(), pa.int64(), *[pa.binary()] * 4])

    return texts.mapInArrow(run, SEND)


class Shard:
    """The snippets of one shard as they come: their text, and where each of them occurs."""

    def __init__(self, width: int, memory: int):
        self.width, self.memory = width, memory
        self.store = Store(32 * memory)
        self.text, self.off = Column(self.store, np.uint16), Column(self.store, np.int64)
        self.doc, self.start, self.which = (Column(self.store, np.int64) for _ in range(3))
        self.number: dict[bytes, int] = {}
        self.held = self.end = 0
        self.off.add(np.zeros(1))

    def add(self, docs: bytes, starts: bytes, sizes: bytes, data: bytes) -> None:
        at, new, which = 0, [], []
        for n in np.frombuffer(sizes, "<i4").tolist():
            snippet = data[at : at + n]
            at += n
            k = self.number.get(snippet)
            if k is None:
                k = self.number[snippet] = self.off.n - 1 + len(new)
                new.append(snippet)
                self.held += n + 150
            which.append(k)
        if new:
            size = np.array([len(x) for x in new], np.int64)
            ends = np.cumsum(size + 1)
            text = np.ones(ends[-1], np.uint16)  # 1 ends a snippet, 0 the whole
            text[ragged(ends - size - 1, size)] = np.frombuffer(b"".join(new), np.uint8).astype(np.uint16) + 2
            self.text.add(text)
            self.off.add(self.end + ends)
            self.end += int(ends[-1])
        if self.held > 8 * self.memory:  # snippets are told apart as far as memory goes: later equal ones are sorted again
            self.number, self.held = {}, 0
        self.doc.add(np.frombuffer(docs, "<i8"))
        self.start.add(np.frombuffer(starts, "<i8"))
        self.which.add(np.array(which))

    def spans(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Lots of covered spans: documents, starts and sizes."""
        self.number = {}
        self.text.add(np.zeros(1))
        text, off, doc, start, which = (c.done() for c in (self.text, self.off, self.doc, self.start, self.which))
        low = self.store.array(len(off) - 1, np.int64, np.iinfo(np.int64).max)
        step = max(1, self.memory // 64)  # occurrences, some windows each
        for k in range(0, len(doc), self.memory):
            np.minimum.at(low, which[k : k + self.memory], doc[k : k + self.memory])
        group, least = self._groups(text, off, low)
        for k in range(0, len(doc), step):
            d, s, o = doc[k : k + step], start[k : k + step], which[k : k + step]
            c = off[o + 1] - off[o] - self.width
            first = least[group[ragged(off[o], c)]]
            hit = np.flatnonzero(first < np.repeat(d, c))
            if not len(hit):
                continue
            place, occ = ragged(s, c)[hit], np.repeat(np.arange(len(d)), c)[hit]
            a = np.flatnonzero(np.concatenate([[True], (occ[1:] != occ[:-1]) | (place[1:] != place[:-1] + 1)]))
            z = np.append(a[1:], len(place)) - 1
            yield d[occ[a]], place[a].astype("<i8"), (place[z] - place[a] + self.width).astype("<i4")

    def _groups(self, text: np.ndarray, off: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The group of equal windows at each place of the text where one starts, and the smallest document of each group."""
        group, least = self.store.array(len(text), np.int32 if len(text) < 2**31 else np.int64), Column(self.store, np.int64)
        of = self.store.array(len(text), np.int32, len(low))  # each place's snippet
        for k in range(0, len(low), step := max(1, self.memory // 64)):
            ends = off[k : k + step + 1]
            of[ends[0] : ends[-1]] = np.repeat(np.arange(k, k + len(ends) - 1), np.diff(ends))
        stop = np.append(off[1:] - self.width, 0)  # where windows of a snippet cease to start, its end mark included
        open_, known = -1, 0  # the group that the last block ended in, if it may go on, and its least
        for pos, lcp in Sorter(text, 258, self.width, self.memory, self.store).descending():
            own = of[pos]
            valid = np.flatnonzero(pos < stop[own])
            run = np.cumsum(lcp < self.width)  # 0: goes on from the last block
            if open_ >= 0 and run[0]:
                least.add(np.array([known]))
                open_ = -1
            if len(valid):
                r, p = run[valid], pos[valid]
                cut = _cuts(r)
                mins = np.minimum.reduceat(low[own[valid]], cut[:-1])
                first = least.n  # the open group's number, or the first new one's
                if open_ >= 0:
                    if not r[0]:
                        mins[0] = min(int(mins[0]), known)
                    else:
                        least.add(np.array([known]))
                        first += 1
                group[p] = first + np.repeat(np.arange(len(mins)), np.diff(cut))
                least.add(mins[:-1])
                open_, known = least.n, int(mins[-1])
            if open_ >= 0 and run[-1] and (not len(valid) or run[valid[-1]] != run[-1]):
                least.add(np.array([known]))
                open_ = -1
        if open_ >= 0:
            least.add(np.array([known]))
        self.store.free(of)
        return group, least.done()


def _covered(width: int, memory: int, buckets: int, lot: int = 1_000_000):
    """Shard by shard, the rows of which come together: covered spans by buckets of documents, about ``lot`` of them dealt together."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at, shard = None, None
        for b in batches:
            for name, *row in zip(*(b.column(k).to_pylist() for k in ("shard", "docs", "starts", "sizes", "data")), strict=True):
                if name != at:
                    if shard:
                        yield from shard.spans()
                    at, shard = name, Shard(width, memory)
                shard.add(*row)
        if shard:
            yield from shard.spans()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for part in spans(batches):
            parts.append(part)
            held += len(part[0])
            if held > lot:
                yield _dealt(*_joined(parts, buckets))
                parts, held = [], 0
        if held:
            yield _dealt(*_joined(parts, buckets))

    return run


def _joined(parts: list[tuple], buckets: int) -> tuple:
    doc, start, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    return doc, buckets, start, size


def _spans(starts: list[bytes], sizes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes in the given spans."""
    a, n = np.frombuffer(b"".join(starts), "<i8"), np.frombuffer(b"".join(sizes), "<i4").astype(np.int64)
    order = np.argsort(a, kind="stable")
    a, e = a[order], np.maximum.accumulate((a + n)[order])
    new = np.concatenate([[True], a[1:] > e[:-1]])
    at = np.flatnonzero(new)
    return a[at], e[np.append(at[1:], len(a)) - 1]


def find(docs: DataFrame, width: int = 50, gram: int = 24, memory: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", row: bool = False) -> DataFrame:
    """(doc_id, text, copy, starts, sizes) of every row: whether it is a whole copy, and lists of packed spans to cut.

    row: whether a struct ``row`` of all columns of ``docs`` comes too.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    whole_row = [F.struct(*docs.columns).alias("row")] if row else []
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), *whole_row)
    sha = F.sha2(F.col("text").cast("binary"), 256)
    long = given.where((F.octet_length("text") >= width) & F.col("doc_id").isNotNull()).select("doc_id", "text")
    marks = scratch.table(long.select("doc_id", sha.alias("sha"), F.octet_length("text").alias("size")), "marks")
    shards, buckets = shares(marks.agg(F.sum("size")).first()[0] or 0, parts)
    # Whole copies, and ids of several texts, by id alone: small enough to join without moving the texts. Only
    # texts that several rows have are joined, in a join of two exchanges, whose hot values Spark can split.
    first = marks.groupBy("sha").agg(F.min("doc_id").alias("lead"), F.count("*").alias("n")).where("n > 1")
    first = scratch.table(first.select(F.col("sha").alias("lead_sha"), "lead"), "leads")
    later = marks.join(first, F.col("sha") == F.col("lead_sha")).where("doc_id > lead").select(F.col("doc_id").alias("copy_id"), F.lit(False).alias("several"))
    many = marks.groupBy(F.col("doc_id").alias("copy_id")).agg(F.max("sha").alias("a"), F.min("sha").alias("b")).where("a <> b")
    copies = later.unionByName(many.select("copy_id", F.lit(True).alias("several")))
    copies = scratch.table(copies.groupBy("copy_id").agg(F.max("several").alias("several")).coalesce(8), "copies")
    texts = long.join(copies, F.col("doc_id") == F.col("copy_id"), "left_anti")

    asked = scratch.table(_ask(texts, width, gram, shards), "asked")
    scratch.free(spark)
    asks = _together(asked.where("shard >= 0").select("shard", "docs", "counts", "names"), parts, "shard")
    answers = asks.mapInArrow(_answer(buckets), "bucket int, docs binary, counts binary, c0 binary")
    answers = _gathered(answers, parts, ["names"], [NAME_BYTES])
    told = answers.unionByName(asked.where("shard < 0").select("doc_id", "names"))
    told = told.groupBy(F.col("doc_id").alias("told_id")).agg(F.collect_list("names").alias("names"))
    told = scratch.table(told, "told")
    scratch.drop(asked)
    scratch.free(spark)
    asking = texts.join(told, F.col("doc_id") == F.col("told_id")).select("doc_id", "text", "names")
    sent = scratch.table(_snippets(asking, width, gram, shards), "snippets")
    scratch.drop(told)
    scratch.free(spark)
    found = sent.where("shard >= 0").select("shard", "docs", "starts", "sizes", "data")
    found = _together(found, parts, "shard").mapInArrow(_covered(width, memory, buckets), "bucket int, docs binary, counts binary, c0 binary, c1 binary")
    found = _gathered(found, parts, ["starts", "sizes"], [8, 4])
    spans = found.unionByName(sent.where("shard < 0").select("doc_id", "starts", "sizes"))
    spans = spans.groupBy(F.col("doc_id").alias("span_id")).agg(F.collect_list("starts").alias("starts"), F.collect_list("sizes").alias("sizes"))
    spans = scratch.table(spans, "spans")
    scratch.drop(sent)
    scratch.free(spark)
    whole = (F.octet_length("text") >= width) & F.coalesce(~F.col("several"), F.lit(False))  # shorter rows of the same id stay
    out = given.join(copies, F.col("doc_id") == F.col("copy_id"), "left").withColumn("copy", whole)
    long_enough = F.octet_length("text") >= width
    out = out.join(spans, (F.col("doc_id") == F.col("span_id")) & ~F.col("copy") & long_enough, "left")
    return out.select("doc_id", "text", "copy", "starts", "sizes", *["row"] * row)


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text, copy, starts, sizes in zip(*(b.column(k) for k in range(5)), strict=True):
                data = text.as_py().encode()
                if copy.as_py():
                    a, e = np.array([0]), np.array([len(data)])
                elif starts.is_valid and len(starts.values):
                    a, e = _spans(starts.as_py(), sizes.as_py())
                else:
                    a = e = np.zeros(0, np.int64)
                edges = np.concatenate([[0], np.stack([a, e], 1).ravel(), [len(data)]]).tolist()
                kept = b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                head = (doc.as_py(), len(data), len(data) - len(kept), len(a))
                rows.append((*head, kept.decode("utf-8", "ignore") if with_text else hashlib.sha256(kept).hexdigest()))
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_text" if with_text else "kept_sha256"]
            made = _batch(rows, names, [*[pa.int64()] * 4, pa.string()])
            rest = list(b.schema.names[5:])
            yield pa.RecordBatch.from_arrays([*made.columns, *(b.column(c) for c in rest)], [*names, *rest])

    return run


def digest(docs: DataFrame, width: int = 50, **more) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    return find(docs, width, **more).mapInArrow(_cut(False), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def clean(docs: DataFrame, width: int = 50, row: bool = False, **more) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_text): what is left of every text.

    Bytes of a character of which others are removed are left out of the text.
    row: whether a struct ``row`` of all columns of ``docs`` comes too.
    """
    found = find(docs, width, row=row, **more)
    kinds = T.StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_text string")
    return found.mapInArrow(_cut(True), T.StructType(kinds.fields + found.schema.fields[5:]))
