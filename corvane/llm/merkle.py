"""A Merkle manifest of a dataset: hash trees by group, keyed by the digits of exact ranks.

Every row is a leaf. Leaves of a group (a language) ascend by id; consecutive runs
of ``fanout`` nodes become their hash, level by level, until one is left, and the
groups' roots, in order of the group, become one root likewise.

A leaf's place needs its rank in its group, which no global sort gives here but
histograms: rows are counted by their id's leading digits (256 buckets at most below
one bucket), a running sum over a bucket's few children says where each begins, and
only buckets of more than ``bucket_rows`` are counted again by the next digits. Rows
are sorted only within their last, small bucket. Beyond the id's digits those of the
leaf and of the row's number follow, so that no bucket stays large however often ids
or rows repeat.

The rank's digits in base ``fanout`` are a node's key in a trie: leaves have all of
them, a parent is its children's common prefix. Nodes that share all but the last
STRIDE digits are reduced in one task, longest prefixes first, so that a tree over n
leaves takes ceil(log n / STRIDE) shuffles of shrinking tables. Proofs go the way
back: a group's path to the root is made once, and its nodes' own part is added.

Null ids come first in their group, the null group before all others; rows of equal
id are ordered by their leaf. A null id is never tampered with. An empty table has no
root and gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm import scratch
from corvane.llm.sharding import numbered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGIT = 8  # bits of an id that a histogram counts at once


def _hash(parts: list[bytes]) -> bytes:
    """The lowercase hex digest of the inputs, one after another."""
    return sha256(b"".join(parts)).hexdigest().encode()


def leaf(fields: list[Column]) -> Column:
    """The 32-byte hash of a row: each field ``-`` if null, else its UTF-8 length, ``:`` and itself."""
    texts = [f.cast("string") for f in fields]
    said = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.unhex(F.sha2(F.concat(*said).cast("binary"), 256))


def depth(n: Column, fanout: int) -> Column:
    """Levels above n leaves: the digits of the last rank."""
    return F.when(n <= 1, 0).otherwise(F.length(F.conv((n - 1).cast("string"), 10, fanout))).cast("int")


def ranked(rows: DataFrame, group: str, keys: list[str], bucket_rows: int = 65_536) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``at``, their rank from 0 in their group by the long columns ``keys``, and (group, n).

    ``rows`` is read once for each digit that is needed; group and keys are never null.
    """
    first = keys[0]
    low, high = rows.agg(F.min(first), F.max(first)).first()
    if low is None:
        return rows.withColumn("at", F.lit(0).cast("long")), rows.groupBy(group).agg(F.count("*").alias("n"))
    top = 0
    while (high >> top) - (low >> top) >= 1 << DIGIT:
        top += 1
    digits = [(first, s) for s in (*range(top, 0, -DIGIT), 0)]
    digits += [(k, s) for k in keys[1:] for s in range(64 - DIGIT, -1, -DIGIT)]
    placed, groups = rows.withColumn("__base", F.lit(0).cast("long")).withColumn("__size", F.lit(bucket_rows + 1).cast("long")), None
    for key, shift in digits:
        wide = placed.withColumn("__digit", F.shiftright(key, shift))
        own = [group, "__base", "__digit"]
        before = Window.partitionBy(group, "__base").orderBy("__digit").rowsBetween(Window.unboundedPreceding, -1)
        counts = wide.where(F.col("__size") > bucket_rows).groupBy(own).agg(F.count("*").alias("__n"))
        counts = scratch.table(counts.withColumn("__next", F.col("__base") + F.coalesce(F.sum("__n").over(before), F.lit(0))), "digits")
        if groups is None:
            groups = counts.groupBy(group).agg(F.sum("__n").alias("n"))
        found = wide.join(counts, own, "left")  # rows of small buckets find none and stay
        placed = found.select(*rows.columns, F.coalesce("__next", "__base").alias("__base"), F.coalesce("__n", "__size").alias("__size"))
        if counts.where(F.col("__n") > bucket_rows).isEmpty():
            break
    order = Window.partitionBy(group, "__base").orderBy(*keys)
    return placed.withColumn("at", F.col("__base") + F.row_number().over(order) - 1).drop("__base", "__size"), groups


def _levels(nodes: list[bytes], fanout: int, todo: int) -> list[list[bytes]]:
    """The nodes and the levels above them, ``todo`` of them."""
    out = [nodes]
    for _ in range(todo):
        below = out[-1]
        out.append([_hash(below[i : i + fanout]) for i in range(0, len(below), fanout)])
    return out


def _steps(levels: list[list[bytes]], place: int, fanout: int) -> list[tuple[int, list[bytes]]]:
    """Of the node at ``place``: its place in its run and the run's others, from the lowest level up."""
    out = []
    for level in levels[:-1]:
        first = place - place % fanout
        run = level[first : first + fanout]
        out.append((place - first, run[: place - first] + run[place - first + 1 :]))
        place //= fanout
    return out


def _packed(steps: list[tuple[int, list[bytes]]]) -> bytes:
    return b"".join(bytes((place, len(others))) + b"".join(others) for place, others in steps)


def _unpacked(path: bytes) -> list[tuple[int, list[bytes]]]:
    out, i = [], 0
    while i < len(path):
        place, n = path[i], path[i + 1]
        out.append((place, [path[j : j + 64] for j in range(i + 2, i + 2 + 64 * n, 64)]))
        i += 2 + 64 * n
    return out


def fold(node: bytes, steps: list[tuple[int, list[bytes]]]) -> bytes:
    """The root that a node and its siblings, level by level, lead to."""
    for place, others in steps:
        node = _hash([*others[:place], node, *others[place:]])
    return node


class Trie:
    """Reduction of tries of nodes (tree, at, hash, todo), STRIDE levels a shuffle; todo: the levels still above."""

    def __init__(self, fanout: int = 2, group: int = 4096):
        if not 2 <= fanout <= 36:
            raise ValueError("fanout must be 2 to 36")
        self.fanout, self.stride = fanout, 1
        while fanout ** (self.stride + 1) <= group:
            self.stride += 1
        self.span = fanout**self.stride

    def grouped(self, nodes: DataFrame):
        return nodes.withColumn("up", F.floor(F.col("at") / F.lit(self.span)).cast("long")).groupBy("tree", "up")

    def read(self, t: pa.Table, column: str = "hash") -> tuple[list[int], list[list[bytes]]]:
        """The order by place of a group's nodes, and its levels."""
        at = t.column("at").to_pylist()
        order = sorted(range(len(at)), key=at.__getitem__)
        hashes = t.column(column).to_pylist()
        todo = min(self.stride, t.column("todo")[0].as_py())
        return order, _levels([hashes[i].hex().encode() for i in order], self.fanout, todo)

    def reduced(self, nodes: DataFrame) -> DataFrame:
        """The nodes STRIDE levels up, or the roots of trees that end before."""
        stride, read = self.stride, self.read

        def run(key: tuple, t: pa.Table) -> pa.Table:
            _, levels = read(t)
            left = max(0, t.column("todo")[0].as_py() - stride)
            return pa.table({"tree": [key[0].as_py()], "at": pa.array([key[1].as_py()], pa.int64()), "hash": [bytes.fromhex(levels[-1][0].decode())], "todo": pa.array([left], pa.int32())})

        return self.grouped(nodes.select("tree", "at", "hash", "todo")).applyInArrow(run, "tree string, at long, hash binary, todo int")

    def climbed(self, nodes: DataFrame) -> list[DataFrame]:
        """The tables of nodes from these to the roots."""
        out = [nodes]
        most = nodes.agg(F.max("todo")).first()[0] or 0
        for _ in range(-(-most // self.stride)):
            out.append(scratch.table(self.reduced(out[-1]), "nodes"))
        return out

    def _above(self, paths: DataFrame):
        return paths.select(F.col("tree").alias("tree"), F.col("at").alias("up"), F.col("path").alias("path"), F.col("subroot").alias("subroot")).groupBy("tree", "up")

    def paths(self, nodes: DataFrame, above: DataFrame) -> DataFrame:
        """(tree, at, path, subroot) of the nodes; above: those of the nodes STRIDE levels up."""
        fanout, read = self.fanout, self.read

        def run(_, t: pa.Table, up: pa.Table) -> pa.Table:
            order, levels = read(t)
            rest, sub = up.column("path")[0].as_py(), up.column("subroot")[0].as_py()
            n = len(order)
            path = [_packed(_steps(levels, k, fanout)) + rest for k in range(n)]
            return pa.table({"tree": t.column("tree").take(pa.array(order)), "at": t.column("at").take(pa.array(order)), "path": pa.array(path, pa.binary()), "subroot": pa.array([sub] * n, pa.string())})

        below = self.grouped(nodes.select("tree", "at", "hash", "todo"))
        return below.cogroup(self._above(above)).applyInArrow(run, "tree string, at long, path binary, subroot string")

    def proofs(self, leaves: DataFrame, above: DataFrame, root: str | None) -> DataFrame:
        """Every leaf with its group's root, its proof's digest, and the root that leaf and proof lead to."""
        fanout, read = self.fanout, self.read

        def run(_, t: pa.Table, up: pa.Table) -> pa.Table:
            order, levels = read(t)
            rest, sub = _unpacked(up.column("path")[0].as_py()), up.column("subroot")[0].as_py()
            changed, ids = t.column("changed").to_pylist(), t.column("doc_id").to_pylist()
            rows = []
            for k, i in enumerate(order):
                steps = _steps(levels, k, fanout) + rest
                given = levels[0][k] if changed[i] is None else changed[i].hex().encode()
                folded = fold(given, steps).decode()
                proof = _hash([x for _, others in steps for x in others]).decode()
                rows.append((ids[i], levels[0][k].decode(), sub, root, proof, folded, folded == root))
            names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
            kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
            return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        own = self.grouped(leaves.select("tree", "at", "hash", "todo", "doc_id", "changed"))
        schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
        return own.cogroup(self._above(above)).applyInArrow(run, schema)


def manifest(docs: DataFrame, fanout: int = 2, group: int = 4096, bucket_rows: int = 65_536, tamper: int = 7) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every document.

    folded_root: what the leaf and its siblings lead to, of the document itself or, where
    ``tamper`` divides its id's CRC, of one that claims another n_chars.
    """
    trie = Trie(fanout, group)
    f = {c: F.col(c).cast("long") if c in ("doc_id", "n_chars") else F.col(c).cast("string") for c in FIELDS}
    other = leaf([f[c] + 1 if c == "n_chars" else f[c] for c in FIELDS])
    struck = (F.pmod(F.crc32(f["doc_id"].cast("string").cast("binary")), F.lit(tamper)) == 0) & f["n_chars"].isNotNull()
    rows = docs.select(
        # Null before all others, and apart from an empty name.
        F.when(f["lang"].isNull(), "").otherwise(F.concat(F.lit("="), f["lang"])).alias("tree"),
        f["doc_id"].alias("doc_id"), leaf(list(f.values())).alias("hash"), F.when(struck, other).alias("changed"),
        F.monotonically_increasing_id().alias("k3"),
    )
    rows = scratch.table(rows, "leaves")
    key = F.conv(F.hex(F.substring("hash", 1, 7)), 16, 10).cast("long")
    keyed = rows.withColumn("k0", F.col("doc_id").isNotNull().cast("long")).withColumn("k1", F.coalesce("doc_id", F.lit(0))).withColumn("k2", key)
    some = rows.where("doc_id is null").isEmpty()
    at, trees = ranked(keyed, "tree", ["k1", "k2", "k3"] if some else ["k0", "k1", "k2", "k3"], bucket_rows)
    trees = scratch.table(trees, "trees")
    leaves = at.join(trees, "tree").select("tree", "at", "doc_id", "hash", "changed", depth(F.col("n"), fanout).alias("todo"))
    below = trie.climbed(scratch.table(leaves, "ranked"))
    order, many = numbered(trees.select("tree"), ["tree"], "place")
    subroots = below[-1].join(order, "tree")
    crowns = subroots.select(F.lit("").alias("tree"), F.col("place").alias("at"), "hash", depth(F.lit(many).cast("long"), fanout).alias("todo"))
    above = trie.climbed(scratch.table(crowns, "subroots"))
    top = above[-1].first()  # the one root
    root = top["hash"].hex() if top else None
    paths = above[-1].select("tree", "at", F.lit(b"").alias("path"), F.lit("").alias("subroot"))
    for nodes in above[-2::-1]:
        paths = trie.paths(nodes, paths)
    crown = order.withColumnRenamed("tree", "own").join(paths.select(F.col("at").alias("place"), "path"), "place").select(F.col("own").alias("tree"), "path")
    paths = below[-1].join(crown, "tree").select("tree", "at", "path", F.lower(F.hex("hash")).alias("subroot"))
    for nodes in below[-2:0:-1]:
        paths = trie.paths(nodes, paths)
    return trie.proofs(below[0], paths, root)
