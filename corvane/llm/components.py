"""Connected components of a graph given by links, by repeated contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import scratch


def label(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, for nodes 0..n-1."""
    lab = np.arange(n)
    while True:
        a, b = lab[u], lab[v]
        low = np.minimum(a, b)
        new = lab.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == lab).all():
            return lab
        lab = new


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components, each from a node to its component's smallest."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    lab = label(len(ids), at[: len(a)], at[len(a) :])
    keep = lab != np.arange(len(ids))
    return ids[keep], ids[lab[keep]]


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's links as a forest: no more than one a node."""
    for batch in batches:
        a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        a, b = forest(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, component_id): the smallest node that links (a, b) reach, for nodes with links.

    Each round sends a node to the neighbour, or itself, of least hash; the hash
    changes by round, so the nodes left shrink by a share a round whatever the
    graph's shape. Null ends and links of a node with itself are left out.
    """
    links = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    edges = scratch.table(links.mapInArrow(_thin, "a long, b long").distinct(), "edges")
    names = None
    turn = 0
    while not edges.isEmpty():
        turn += 1
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        key = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("n"))  # noqa: B023, E731
        to = both.groupBy("a").agg(F.least(F.min(key("b")), F.min(key("a")))["n"].alias("p"))
        to = scratch.table(to, "parents")
        p, q = to.select(F.col("a"), F.col("p").alias("x")), to.select(F.col("a").alias("b"), F.col("p").alias("y"))
        moved = edges.join(p, "a").join(q, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        edges = scratch.table(moved.mapInArrow(_thin, "a long, b long").distinct(), "edges")
        if names is None:
            names = to.select(F.col("a").alias("node"), F.col("p").alias("at"))
        else:
            step = to.withColumnRenamed("a", "at")
            names = names.join(step, "at", "left").select("node", F.coalesce("p", "at").alias("at"))
            names = scratch.table(names, "names")
    if names is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component_id"))
    least = names.groupBy("at").agg(F.min("node").alias("low"))
    return scratch.table(names.join(least, "at").select("node", F.least("low", "node").alias("component_id")), "components")
