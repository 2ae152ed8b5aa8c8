"""Best-fit packing of token pieces into sequences, with certified bin counts.

Documents become pieces of at most ``capacity`` tokens; only longer documents are
cut. Each piece gets a number of its own, by which they are dealt, however many rows
repeat an id or a text, into partitions of about ``per_part`` pieces, each
packed by best-fit decreasing. Dual feasible functions bound each partition's
sequence count from below: a partition that meets its bound is certified and
gives up only its loose sequences, one that doesn't gives up every sequence with
a gap. Their documents are dealt anew among partitions and packed again, until
one partition holds what is exchanged or the whole count meets the bound of all
pieces together.

Of each sequence its partition, the partition's sequences and their lower bound
are told too (``part``, ``bins``, ``bound``): where bins = bound no packing of
that partition is better.

A null text counts as empty: its one piece is the end token. Ids may be null or
repeat; every row is packed. Of other columns none is read. An empty table gives an
empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import scratch
from corvane.llm.bpe import Encoder
from corvane.llm.textscan import chunks

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(
    docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The pieces of every document; with_ids adds their token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(path, spaced=False)
        for b in batches:
            for i, j, buf, off in chunks(b.column(1)):
                ids, at = coder.texts(buf, off)
                rows = j - i
                at = at + np.arange(rows + 1)  # an end token after each
                full = np.full(at[-1], end_id, "<u4")
                inner = np.ones(len(full), bool)
                inner[at[1:] - 1] = False
                full[inner] = ids
                size = at[1:] - at[:-1]
                count = -(-size // capacity)
                row = np.repeat(np.arange(rows), count)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(size[row] - start, capacity)
                first = at[row] + start
                raw = memoryview(full).cast("B")
                crc = [zlib.crc32(raw[4 * x : 4 * (x + n)]) for x, n in zip(first.tolist(), length.tolist(), strict=True)]
                cols = [
                    b.column(0).slice(i, rows).take(pa.array(row)),
                    pa.array(piece.astype(np.int32)),
                    pa.array(start),
                    pa.array(length),
                    pa.array(crc, pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    bounds = np.append(first, at[-1]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(full.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    given = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return given.mapInArrow(run, PIECE + (", ids array<int>" if with_ids else ""))


def best_fit_decreasing(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece: longest first, into the fullest bin that has room."""
    order = np.argsort(-length, kind="stable")
    bins, offs = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    having: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by gap
    some = 0  # bit g: a bin has the gap g
    n = 0
    for i, size in zip(order.tolist(), length[order].tolist(), strict=True):
        fits = some >> size
        if fits:
            gap = size + (fits & -fits).bit_length() - 1
            bin_ = having[gap].pop()
            if not having[gap]:
                some ^= 1 << gap
        else:
            gap, bin_, n = capacity, n, n + 1
        bins[i], offs[i] = bin_, capacity - gap
        gap -= size
        if gap:
            if not having[gap]:
                some |= 1 << gap
            having[gap].append(bin_)
    return bins, offs


def lower_bound(length: np.ndarray | None, capacity: int, histogram: np.ndarray | None = None) -> int:
    """No packing has fewer bins: the best of three families of dual feasible functions."""
    h = np.bincount(length, minlength=capacity + 1) if histogram is None else histogram
    s = np.arange(capacity + 1)
    best = -(-int(h @ s) // capacity)
    # Pieces over capacity - t count whole, those under t not at all.
    mass, count = np.cumsum(h * s), np.cumsum(h)
    t = np.arange(1, capacity // 2 + 1)
    value = (count[-1] - count[capacity - t]) * capacity + mass[capacity - t] - mass[t - 1]
    best = max(best, int((-(-value // capacity)).max(initial=0)))
    # Lengths rounded down to k-ths of the capacity, at (k + 1) steps.
    for k in range(1, 33):
        step = (k + 1) * s
        u = np.where(step % capacity == 0, k * s, step // capacity * capacity)
        best = max(best, -(-int(h @ u) // (k * capacity)))
    return best


def pack(pieces: DataFrame, capacity: int = 4096, per_part: int = 50_000, loose: int = 64, rounds: int = 8) -> DataFrame:
    """``pieces`` with sequence_id, offset and their partition's certificate, as a scratch table.

    loose: a certified partition gives up sequences with a gap over capacity // loose.
    """
    tag = "part int, bins long, bound long, sequence_id long, offset long, open boolean"
    schema = f"{PIECE}, number long, {tag}"
    names = [c.split()[0] for c in PIECE.split(", ")]
    pieces = scratch.table(pieces.select(*names, F.monotonically_increasing_id().alias("number")), "pieces")

    def packed(turn: int, last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("number", ignore_index=True)
            length = pdf["length"].to_numpy()
            bins, offs = best_fit_decreasing(length, capacity)
            n = int(bins.max(initial=-1)) + 1
            bound = lower_bound(length, capacity)
            gap = capacity - np.bincount(bins, weights=length, minlength=n).astype(np.int64)
            give = (gap > (capacity // loose if n == bound else 0)) & (not last)
            part = int(pdf["part"].iloc[0])
            return pdf.assign(bins=n, bound=bound, sequence_id=(turn << 56) | (part << 32) | bins, offset=offs, open=give[bins])

        return run

    left, done, least = pieces, None, None
    for turn in range(rounds + 1):
        n = left.count()
        parts = max(1, -(-n // per_part))
        last = parts == 1 or turn == rounds
        dealt = left.withColumn("part", F.pmod(F.xxhash64("number", F.lit(turn)), F.lit(parts)).cast("int"))
        out = scratch.table(dealt.groupBy("part").applyInPandas(packed(turn, last), schema), "pack")
        kept = out.where("not open")
        done = kept if done is None else done.unionByName(kept)
        if last:
            break
        if least is None:
            h = np.zeros(capacity + 1, np.int64)
            for size, count in pieces.groupBy("length").count().collect():  # at most one row a length
                h[size] = count
            least = lower_bound(None, capacity, h)
        if out.select(F.countDistinct("sequence_id")).first()[0] + _bins(done, out) <= least:
            done = done.unionByName(out.where("open"))
            break
        left = out.where("open").select(*names, "number")
    assert done is not None
    return done.select(*names, "sequence_id", "offset", "part", "bins", "bound")


def _bins(done: DataFrame, out: DataFrame) -> int:
    """Sequences of earlier turns."""
    turn = F.shiftright("sequence_id", 56)
    now = out.select(F.max(turn)).first()[0] or 0
    return done.where(turn < now).select(F.countDistinct("sequence_id")).first()[0]


def packed(docs: DataFrame, path: str, capacity: int = 4096, per_part: int = 50_000) -> DataFrame:
    """Every piece of ``docs`` with its sequence, its place and the certificate of its partition."""
    return pack(pieces(docs, path, capacity), capacity, per_part)
