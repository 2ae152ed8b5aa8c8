"""Incremental maintenance: manifest differences, tombstones, versions and compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classify(scan: DataFrame, manifest: DataFrame, key: str = "path", least_bytes: int = 0) -> DataFrame:
    """(key, state): empty, too-small, new, modified, unchanged or removed, by content hash."""
    m = manifest.select(F.col(key).alias("__k"), F.col("hash").alias("__h"))
    both = scan.join(m, F.col(key) == F.col("__k"), "full")
    state = (
        F.when(F.col(key).isNull(), "removed")
        .when(F.col("bytes") == 0, "empty")
        .when(F.col("bytes") < least_bytes, "too-small")
        .when(F.col("__h").isNull(), "new")
        .when(F.col("hash") != F.col("__h"), "modified")
        .otherwise("unchanged")
    )
    return both.select(F.coalesce(key, "__k").alias(key), state.alias("state"))


def latest(versions: DataFrame, keys: list[str], version: str, deleted: str) -> DataFrame:
    """The newest version of each key, without keys whose newest is a tombstone.

    An aggregate with a struct maximum, so that versions are reduced before the shuffle.
    """
    rest = [c for c in versions.columns if c not in keys]
    newest = versions.groupBy(*keys).agg(F.max(F.struct(version, deleted, *[c for c in rest if c not in (version, deleted)])).alias("__m"))
    return newest.where(~F.col(f"__m.{deleted}")).select(*keys, *[F.col(f"__m.{c}").alias(c) for c in rest])


def upsert(store: DataFrame, write: DataFrame, path: str = "path", id_col: str = "id") -> DataFrame:
    """Rows of touched files that the write doesn't have go; written rows replace those of the same id; rows without vector aren't written."""
    new = write.where(F.col("embedding").isNotNull())
    touched = write.select(F.lower(F.col(path)).alias("__p")).distinct()
    kept = store.join(touched, F.lower(F.col(path)) == F.col("__p"), "left_anti").join(new.select(F.col(id_col).alias("__i")), F.col(id_col) == F.col("__i"), "left_anti")
    return kept.unionByName(new)


def delete_paths(store: DataFrame, gone: DataFrame, path: str = "path") -> DataFrame:
    """Without the files of ``gone``; case doesn't matter."""
    g = gone.select(F.lower(F.col(path)).alias("__p"))
    return store.join(g, F.lower(F.col(path)) == F.col("__p"), "left_anti")


def missing(left: DataFrame, right: DataFrame, key: str = "path") -> DataFrame:
    """Keys of the left without the right's, case aside."""
    r = right.select(F.lower(F.col(key)).alias("__p"))
    return left.select(key).distinct().join(r, F.lower(F.col(key)) == F.col("__p"), "left_anti")


def compaction(versions: DataFrame, keys: list[str], version: str, deleted: str) -> DataFrame:
    """total, live and dead rows and the dead share in per cent."""
    total = versions.agg(F.count("*").alias("total"))
    live = latest(versions, keys, version, deleted).agg(F.count("*").alias("live"))
    pct = F.round(100 * (F.col("total") - F.col("live")) / F.greatest(F.col("total"), F.lit(1)), 1)
    return total.crossJoin(live).select("total", "live", (F.col("total") - F.col("live")).alias("dead"), pct.alias("dead_pct"))


def repair_duplicates(chunks: DataFrame, keys: list[str], prefer: str, id_col: str = "id") -> DataFrame:
    """One row of each key: the first that has ``prefer``, else the first."""
    w = Window.partitionBy(*keys).orderBy(F.col(prefer).isNull(), id_col)
    return chunks.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def merge_log(local: DataFrame, remote: DataFrame, key: str = "id", at: str = "ts", deleted: str = "deleted") -> DataFrame:
    """Union by id: a tombstone wins, then the newest, then the local record."""
    both = local.withColumn("__own", F.lit(1)).unionByName(remote.withColumn("__own", F.lit(0)))
    rest = [c for c in local.columns if c not in (key, at, deleted)]
    best = both.groupBy(key).agg(F.max(F.struct(deleted, at, "__own", *rest)).alias("m"))
    return best.select(key, F.col(f"m.{at}").alias(at), F.col(f"m.{deleted}").alias(deleted), *[F.col(f"m.{c}").alias(c) for c in rest])


def merge_lists(entries: DataFrame, key: str, value: str, order: str, derived: str) -> DataFrame:
    """(key, value, place) of each key's exclusion list: given entries, then derived ones, each once in any case, as first spelled."""
    given = entries.select(F.col(key).alias("k"), F.trim(value).alias("v"), F.struct(F.col(derived).alias("d"), F.col(order).alias("o")).alias("at")).where("v <> ''")
    first = given.groupBy("k", F.lower("v").alias("low")).agg(F.min(F.struct("at", "v")).alias("f"))
    place = F.row_number().over(Window.partitionBy("k").orderBy("f.at")) - 1
    return first.select(F.col("k").alias(key), F.col("f.v").alias(value), place.alias("place"))
