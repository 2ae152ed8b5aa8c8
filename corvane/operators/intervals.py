"""Intervals in groups: the nearest one around each, by a sweep over range partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.sources import shared

SWEPT = "kind string, g string, s long, e long, i long, value boolean, near long, near_value boolean, block int"


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One partition in order of group, start and falling end.

    What may still hold a later interval is a stack whose ends fall: an interval is popped by
    one that begins after it and ends beyond it. A row is ``open`` where the partition's first
    group has nothing around it yet; the stack of the last group goes on to later partitions.
    """
    block = TaskContext.get().partitionId()
    stack: list[tuple] = []  # (e, s, i, value)
    group, first, around = None, None, None
    for pdf in batches:
        out = []
        for g, s, e, i, value in zip(pdf["g"], pdf["s"], pdf["e"], pdf["i"], pdf["value"], strict=True):
            if g != group:
                group, stack = g, []
                first = g if first is None else first
            while stack and stack[-1][0] < e:
                stack.pop()
            if stack and stack[-1][:2] == (e, s):  # equal ones have the same around them; the last id stands for them
                stack.pop()
            around = stack[-1] if stack else None
            stack.append((e, s, i, value))
            kind = "done" if around or g != first else "open"
            out.append((kind, g, s, e, i, value, around[2] if around else None, around[3] if around else None, block))
        if out:
            yield _frame(out)
    if stack:
        yield _frame([("stack", group, s, e, i, value, None, None, block) for e, s, i, value in stack])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["kind", "g", "s", "e", "i", "value", "near", "near_value", "block"])
    return out.astype({"near": "Int64", "value": "boolean", "near_value": "boolean"})


def _earlier(ends: dict[str, tuple[list[int], list[int]]]):
    """For open rows the last block before theirs, of the same group, that goes on with an end not before theirs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            target = np.full(len(pdf), -1, np.int64)
            for (g, block), at in pdf.groupby(["g", "block"]).indices.items():
                blocks, most = ends.get(g, ([], []))
                n = int(np.searchsorted(blocks, block))
                if n:
                    # Seen backwards the largest end so far rises; its first reaching e is the block.
                    back = np.maximum.accumulate(np.array(most[:n][::-1]))
                    k = np.searchsorted(back, pdf["e"].to_numpy()[at], "left")
                    target[at] = np.where(k < n, np.array(blocks[:n][::-1])[np.minimum(k, n - 1)], -1)
            yield pdf.assign(target=target)

    return run


def nearest_around(rows: DataFrame, group: str, start: str, end: str, id_col: str, value: str, per: int = 100_000) -> DataFrame:
    """(id, value, near, near_value): of the intervals around each one in its group, other than equal ones, that of the last start, then the first end, then the largest id.

    No group is one task: blocks of about ``per`` rows by range are swept, and only rows without
    an interval around them in their block go on, to the one earlier block that has it. The driver
    learns one group and end a block. Equal intervals are in one block, which is read as a stream.
    The stack of a block is read once by every later block that it holds a row of, so deep nests
    over many blocks cost more than flat ones. A null group, start or end has nothing around it.
    """
    spark = rows.sparkSession
    r = rows.select(F.col(group).cast("string").alias("g"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"), F.col(id_col).alias("i"), F.col(value).alias("value"))
    whole = F.col("g").isNotNull() & F.col("s").isNotNull() & F.col("e").isNotNull()
    blocks = max(1, -(-r.count() // per))
    ranged = r.where(whole).repartitionByRange(blocks, "g", "s", F.desc("e")).sortWithinPartitions("g", "s", F.desc("e"), "i")
    swept = shared.table(ranged.mapInPandas(_sweep, SWEPT), "swept")
    done = swept.where("kind = 'done'").select("i", "value", "near", "near_value")
    alone = r.where(~whole).select("i", "value", F.lit(None).cast("long").alias("near"), F.lit(None).cast("boolean").alias("near_value"))
    stacks = swept.where("kind = 'stack'")
    ends: dict[str, tuple[list[int], list[int]]] = {}
    for b in stacks.groupBy("g", "block").agg(F.max("e").alias("e")).orderBy("block").collect():  # one a block
        at = ends.setdefault(b["g"], ([], []))
        at[0].append(b["block"])
        at[1].append(b["e"])
    opened = swept.where("kind = 'open'").mapInPandas(_earlier(ends), f"{SWEPT}, target long")
    met = opened.where("target >= 0")
    asked = met.select(F.col("target").cast("int").alias("block"), F.col("block").alias("by"), "g").distinct()
    held = stacks.join(asked, ["block", "g"]).select(F.lit(0).alias("asks"), F.col("block").alias("target"), "by", "e", "i", "value")
    both = held.unionByName(met.select(F.lit(1).alias("asks"), F.col("target").cast("int").alias("target"), F.col("block").alias("by"), "e", "i", "value"))
    down = Window.partitionBy("target", "by").orderBy(F.desc("e"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.when(F.col("asks") == 0, F.struct("i", "value")), ignorenulls=True).over(down)
    late = both.withColumn("f", found).where("asks = 1").select("i", "value", F.col("f.i").alias("near"), F.col("f.value").alias("near_value"))
    none = opened.where("target < 0").select("i", "value", "near", "near_value")
    return done.unionByName(late).unionByName(none).unionByName(alone).withColumnRenamed("i", id_col).withColumnRenamed("value", value)
