"""Near-duplicate vectors by E8 lattice hashing.

Each table projects unit vectors onto two blocks of eight random orthogonal
directions and decodes each block to its nearest E8 lattice point; both points
make the vector's cell. A vector also probes the cells that differ by one of the
240 shortest lattice vectors, those nearest to it first. Vectors whose cells or
probes meet in a table are compared by cosine in double precision.

Equal vectors are joined into one first. A cell with many vectors is dealt into
blocks of vectors against blocks of probes, so no task holds a whole cell. A pair
that meets often counts only where it meets first, which both cells' codes tell;
a task returns its sums of links and a forest of them, not the pairs.

A vector that is null, empty, zero or holds a null or non-finite component links
with nothing and is its own component. Vectors are scaled by their largest entry
before their length is taken, so the largest and smallest doubles link like any
others. Vectors of several lengths may stand in a table: only those of one length
are compared. Null ids come back with no links and a null component, and count for
no other. Rows that repeat an id are vectors of their own. Of other columns none
is read. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import scratch
from corvane.llm.components import components, forest
from corvane.llm.textscan import U64, mix


def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            whole.append(v)
    half = [v for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(whole + [np.array(v) for v in half])


def _even(y: np.ndarray) -> np.ndarray:
    """The nearest integer point of even sum: rounding, or else the least sure entry the other way."""
    f = np.rint(y)
    r = y - f
    i = np.flatnonzero(f.sum(1) % 2)
    k = np.abs(r[i]).argmax(1)
    f[i, k] += np.where(r[i, k] >= 0, 1, -1)
    return f


def decode(y: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: of the even integers or those shifted by a half."""
    a, b = _even(y), _even(y - 0.5) + 0.5
    nearer = ((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1)
    return np.where(nearer[:, None], a, b)


class Lattice:
    """Cells and probes of unit vectors in several tables."""

    def __init__(self, dim: int, tables: int = 8, blocks: int = 2, scale: float = 5.0, probes: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.tables, self.blocks, self.probes = tables, blocks, probes
        side = max(dim, 8 * blocks)
        self.planes = [np.linalg.qr(rng.normal(size=(side, 8 * blocks)))[0][:dim] * scale * np.sqrt(dim / 64) for _ in range(tables)]
        self.near = shortest()
        # A point's code is a sum of products modulo 2**64, so a neighbour's code is that of the step added.
        self.odd = mix(rng.integers(1, 2**62, size=(tables, 8 * blocks)).astype(U64)) | U64(1)

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """Codes by vector, table and rank: the own cell first, then the probes."""
        out = np.zeros((len(unit), self.tables, 1 + self.probes), U64)
        step = (2 * self.near).astype(np.int64).astype(U64)
        for t in range(self.tables):
            y = unit @ self.planes[t]
            points = [decode(y[:, 8 * b : 8 * b + 8]) for b in range(self.blocks)]
            twice = (2 * np.hstack(points)).astype(np.int64).astype(U64)
            own = (twice * self.odd[t]).sum(1, dtype=U64) + U64(t)
            pull = np.hstack([(y[:, 8 * b : 8 * b + 8] - p) @ self.near.T for b, p in enumerate(points)])
            first = np.argpartition(-pull, self.probes - 1, axis=1)[:, : self.probes]
            moves = np.concatenate([(step * self.odd[t, 8 * b : 8 * b + 8]).sum(1, dtype=U64) for b in range(self.blocks)])
            out[:, t, 0] = own
            out[:, t, 1:] = own[:, None] + moves[first]
            out[:, t] = mix(out[:, t] * U64(2 * t + 1))
        return out


def _blobs(column: pa.Array) -> list[bytes | None]:
    """Vectors as packed doubles; None for those that link with nothing."""
    column = column.cast(pa.list_(pa.float64()))
    off = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False) + 0.0  # one zero; a null is a NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    some = np.concatenate([[0], np.cumsum(values != 0)])
    good = column.is_valid().to_numpy(zero_copy_only=False) & (bad[off[1:]] == bad[off[:-1]]) & (some[off[1:]] > some[off[:-1]])
    data = memoryview(np.ascontiguousarray(values)).cast("B")
    return [bytes(data[8 * x : 8 * y]) if k else None for x, y, k in zip(off[:-1].tolist(), off[1:].tolist(), good.tolist(), strict=True)]


def _unit(blob: list[bytes]) -> np.ndarray:
    """Vectors of one length, none of them zero, at length 1."""
    x = np.frombuffer(b"".join(blob), np.float64).reshape(len(blob), -1)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def near_duplicates(
    vectors: DataFrame,
    threshold: float = 0.95,
    tables: int = 8,
    blocks: int = 2,
    scale: float = 5.0,
    probes: int = 16,
    block: int = 512,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""

    def lattices():
        made: dict[int, Lattice] = {}

        def of(dim: int) -> Lattice:
            if dim not in made:
                made.clear()  # groups of one length come together
                made[dim] = Lattice(dim, tables, blocks, scale, probes)
            return made[dim]

        return of

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_blobs(b.column(1)), pa.binary())], ["vec_id", "v"])

    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    rows = scratch.table(given.mapInArrow(raw, "vec_id long, v binary"), "vectors")
    live = rows.where("vec_id is not null and v is not null")
    # A vector's representative is a row of its own: ids may stand for several vectors.
    reps = live.groupBy("v").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    reps = scratch.table(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattices()
        each = tables * (1 + probes)
        for b in batches:
            blobs, reps_ = np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy()
            size = np.array([len(v) for v in blobs])
            for n in np.unique(size).tolist():
                at = np.flatnonzero(size == n)
                for i in range(0, len(at), 2000):
                    pick = at[i : i + 2000]
                    codes = lattice(n // 8).codes(_unit(blobs[pick].tolist()))
                    probe = np.tile(np.arange(1 + probes) > 0, len(pick) * tables)
                    table = np.tile(np.repeat(np.arange(tables, dtype=np.int8), 1 + probes), len(pick))
                    dim = np.full(len(pick) * each, n // 8, np.int32)
                    cols = [dim, codes.ravel().astype(np.int64), table, np.repeat(reps_[pick], each), probe]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols)], ["dim", "cell", "tbl", "rep", "probe"])

    cells = reps.select("v", "rep").mapInArrow(hashed, "dim int, cell long, tbl byte, rep long, probe boolean")
    # Only cells that somebody else shares or probes are compared.
    own = F.sum(F.when(~F.col("probe"), 1).otherwise(0))
    met = cells.groupBy("dim", "cell", "tbl").agg(own.alias("members"), F.count("*").alias("askers")).where("members > 0 and askers > 1")
    met = met.select(
        F.col("dim").alias("d"), F.col("cell").alias("c"), F.col("tbl").alias("t"),
        F.ceil(F.col("members") / block).cast("int").alias("mb"), F.ceil(F.col("askers") / (2 * block)).cast("int").alias("ab"),
    )
    cells = cells.join(met, (F.col("dim") == F.col("d")) & (F.col("cell") == F.col("c")) & (F.col("tbl") == F.col("t")))
    cells = cells.select("dim", "cell", "tbl", "rep", "probe", "mb", "ab")
    seq = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    at = lambda n, salt: F.array(F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n)).cast("int"))
    base = cells.where(~F.col("probe")).select("dim", "cell", "tbl", "rep", F.lit(0).alias("asks"), F.explode(at("mb", 1)).alias("m"), F.col("ab"))
    base = base.select("dim", "cell", "tbl", "rep", "asks", "m", F.explode(seq("ab")).alias("k"))
    asks = cells.select("dim", "cell", "tbl", "rep", F.lit(1).alias("asks"), F.col("mb"), F.explode(at("ab", 2)).alias("k"))
    asks = asks.select("dim", "cell", "tbl", "rep", "asks", F.explode(seq("mb")).alias("m"), "k")
    dealt = base.unionByName(asks).join(reps.select("rep", "copies", "v"), "rep")
    group = ["dim", "cell", "tbl", "m", "k"]
    dealt = dealt.select(*group, "asks", "rep", "copies", "v")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, *group).sortWithinPartitions(*group, "asks")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = lattices()
        sums: dict[int, int] = {}
        a_out: list[np.ndarray] = []
        b_out: list[np.ndarray] = []
        held: tuple | None = None  # the members of the group at hand

        def flush() -> pa.RecordBatch:
            a, b = np.concatenate(a_out or [np.zeros(0, np.int64)]), np.concatenate(b_out or [np.zeros(0, np.int64)])
            a, b = forest(a, b) if len(a) else (a, b)
            ids = np.array([*sums], np.int64)
            cols = [pa.array(np.concatenate([ids, a])), pa.array(np.concatenate([np.array([*sums.values()], np.int64), 0 * a])), pa.array([None] * len(ids) + b.tolist(), pa.int64())]
            sums.clear(), a_out.clear(), b_out.clear()
            return pa.RecordBatch.from_arrays(cols, ["rep", "links", "other"])

        def meets(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            """By pair and table: y's cell is x's own or probed."""
            return (x == y[:, :, :1]).any(2)

        def link(t: int, q: tuple, m: tuple) -> None:
            codes = lattice(q[2].shape[1]).codes
            cos = q[2] @ m[2].T
            i, j = np.nonzero(cos >= threshold)
            keep = q[0][i] != m[0][j]
            i, j = i[keep], j[keep]
            for s in range(0, len(i), 4096):
                x, y = i[s : s + 4096], j[s : s + 4096]
                qc, mc = codes_of(codes, q, x), codes_of(codes, m, y)
                there, back = meets(qc, mc), meets(mc, qc)
                first = (there | back).argmax(1) == t
                first &= (q[0][x] < m[0][y]) | ~back[:, t]
                x, y = x[first], y[first]
                for ids, others in ((q[0][x], m[1][y]), (m[0][y], q[1][x])):
                    u, at_u = np.unique(ids, return_inverse=True)
                    for k, n in zip(u.tolist(), np.bincount(at_u, weights=others).astype(np.int64).tolist(), strict=True):
                        sums[k] = sums.get(k, 0) + n
                if len(x):
                    a, b = forest(q[0][x], m[0][y])
                    a_out.append(a), b_out.append(b)

        def codes_of(codes, side: tuple, pick: np.ndarray) -> np.ndarray:
            u, at_u = np.unique(pick, return_inverse=True)
            return codes(side[2][u])[at_u]

        for b in batches:
            keys = np.stack([b.column(k).to_numpy().astype(np.int64) for k in range(6)], 1)
            rep, copies = b.column(6).to_numpy(), b.column(7).to_numpy()
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(keys)], strict=True):
                unit = _unit(b.column(8).slice(s, e - s).to_pylist())
                side = (rep[s:e], copies[s:e], unit)
                name = tuple(keys[s, :5])
                if not keys[s, 5]:
                    held = (name, *(np.concatenate([o, n]) for o, n in zip(held[1:], side, strict=True))) if held and held[0] == name else (name, *side)
                elif held and held[0] == name:
                    for r in range(0, e - s, block):
                        link(int(name[2]), tuple(x[r : r + block] for x in side), held[1:])
            if len(sums) > 100_000 or sum(map(len, a_out)) > 1_000_000:
                yield flush()
        yield flush()

    found = scratch.table(dealt.mapInArrow(compare, "rep long, links long, other long"), "links")
    counts = found.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    told = reps.join(counts, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    told = told.select("v", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("class"))
    least = told.groupBy("class").agg(F.min("low").alias("component_id"))
    told = told.join(least, "class").select("v", "n_links", "component_id")
    linked = live.join(told, "v").select("vec_id", "n_links", "component_id")
    alone = rows.where("vec_id is null or v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
