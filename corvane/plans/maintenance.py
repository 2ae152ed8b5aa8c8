"""Incremental index maintenance, set operations and store reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import incremental as inc
from corvane.plans.fixtures import CHUNKS, chunks, read
from corvane.plans.registry import query

_SCAN = """scan AS (SELECT 'f' || doc_id AS path, sha256(text) AS hash, strlen(text) AS bytes FROM documents WHERE doc_id % 10 <> 0),
man AS (SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE sha256(text) END AS hash, doc_id % 4 AS chunk_count FROM documents WHERE doc_id % 9 <> 0)"""


def _scan(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    path = F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path")
    h = F.sha2("text", 256)
    scan = d.where("doc_id % 10 <> 0").select(path, h.alias("hash"), F.octet_length("text").alias("bytes"))
    man = d.where("doc_id % 9 <> 0").select(path, F.when(F.col("doc_id") % 7 == 0, "old").otherwise(h).alias("hash"), (F.col("doc_id") % 4).alias("chunk_count"))
    return scan, man


@query(
    f"""WITH {_SCAN} SELECT coalesce(s.path, m.path) AS path, CASE WHEN s.path IS NULL THEN 'removed' WHEN bytes = 0 THEN 'empty' WHEN bytes < 200 THEN 'too-small'
    WHEN m.path IS NULL THEN 'new' WHEN s.hash <> m.hash THEN 'modified' ELSE 'unchanged' END AS state FROM scan s FULL JOIN man m ON s.path = m.path"""
)
def j8_x4_classify_scan(spark, sf_dir):
    return inc.classify(*_scan(spark, sf_dir), least_bytes=200)


@query(
    f"""WITH {_SCAN}, c AS (SELECT CASE WHEN s.path IS NULL THEN 'removed' WHEN bytes < 200 THEN 'too-small' WHEN m.path IS NULL THEN 'new' WHEN s.hash <> m.hash THEN 'modified' ELSE 'unchanged' END AS state
    FROM scan s FULL JOIN man m ON s.path = m.path) SELECT state, count(*) AS files FROM c GROUP BY state"""
)
def a21_run_statistics(spark, sf_dir):
    return inc.classify(*_scan(spark, sf_dir), least_bytes=200).groupBy("state").agg(F.count("*").alias("files"))


@query(f"WITH {_SCAN} SELECT path FROM man WHERE path NOT IN (SELECT path FROM scan)")
def j5_stale_paths(spark, sf_dir):
    scan, man = _scan(spark, sf_dir)
    return inc.missing(man, scan)


@query(f"WITH {_SCAN} SELECT path FROM scan WHERE lower(path) NOT IN (SELECT lower(path) FROM man) AND bytes > 500")
def j6_orphan_sweep(spark, sf_dir):
    scan, man = _scan(spark, sf_dir)
    return inc.missing(scan.where("bytes > 500"), man)


@query(f"WITH {_SCAN} SELECT path FROM man WHERE chunk_count > 0 AND path NOT IN (SELECT path FROM scan WHERE bytes > 1000)")
def j7_resume_missing(spark, sf_dir):
    scan, man = _scan(spark, sf_dir)
    return inc.missing(man.where("chunk_count > 0"), scan.where("bytes > 1000"))


@query(f"WITH {CHUNKS} SELECT DISTINCT file_path FROM chunks WHERE kind = '' AND lower(file_path) NOT IN (SELECT lower(file_path) FROM chunks WHERE id % 7 = 3)")
def j4_keyword_drift(spark, sf_dir):
    """Files of the store that an index of every seventh chunk lacks."""
    c = chunks(spark, sf_dir)
    return inc.missing(c.where("kind = ''"), c.where("id % 7 = 3").withColumn("file_path", F.upper("file_path")), "file_path")


@query("WITH r AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n, event_id % 5 = 0 AS dead FROM events) SELECT user_id, event_id, value FROM r WHERE n = 1 AND NOT dead")
def k4_latest_version(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("ver"), (F.col("event_id") % 5 == 0).alias("dead"), "event_id", "value")
    return inc.latest(e, ["user_id"], "ver", "dead").select("user_id", "event_id", "value")


@query(
    """WITH r AS (SELECT row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AND event_id % 5 <> 0 AS live FROM events)
    SELECT count(*) AS total, count(*) FILTER (live) AS live, count(*) FILTER (NOT live) AS dead, round(100.0 * count(*) FILTER (NOT live) / count(*), 1) AS dead_pct FROM r"""
)
def k9_compaction_report(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id").alias("ver"), (F.col("event_id") % 5 == 0).alias("dead"))
    return inc.compaction(e, ["user_id"], "ver", "dead")


_STORE = f"""{CHUNKS}, store AS (SELECT id, file_path AS path, 0 AS v FROM chunks WHERE id % 2 = 0),
w AS (SELECT id, upper(file_path) AS path, 1 AS v, id % 6 <> 0 AS has_vec FROM chunks WHERE id % 3 = 0 AND file LIKE 'src1%')"""


def _store(spark, sf_dir):
    c = chunks(spark, sf_dir)
    some = F.array(F.lit(1.0))
    store = c.where("id % 2 = 0").select("id", F.col("file_path").alias("path"), F.lit(0).alias("v"), some.alias("embedding"))
    w = c.where("id % 3 = 0 and file like 'src1%'").select("id", F.upper("file_path").alias("path"), F.lit(1).alias("v"), F.when(F.col("id") % 6 != 0, some).alias("embedding"))
    return store, w


@query(f"WITH {_STORE} SELECT id, path, v FROM store WHERE lower(path) NOT IN (SELECT lower(path) FROM w) AND id NOT IN (SELECT id FROM w WHERE has_vec) UNION ALL SELECT id, path, v FROM w WHERE has_vec")
def k1_k2_upsert(spark, sf_dir):
    return inc.upsert(*_store(spark, sf_dir)).select("id", "path", "v")


@query(f"WITH {_STORE} SELECT id, path FROM store WHERE lower(path) NOT IN (SELECT lower(path) FROM w)")
def k3_delete_by_path(spark, sf_dir):
    store, w = _store(spark, sf_dir)
    return inc.delete_paths(store, w.select("path").distinct()).select("id", "path")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text), lang ORDER BY CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END, doc_id) AS n FROM documents) WHERE n = 1")
def k13_duplicate_repair(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("h"), "lang", F.when(F.col("doc_id") % 3 == 0, "described").alias("description"))
    return inc.repair_duplicates(d, ["h", "lang"], "description").select(F.col("id").alias("doc_id"))


@query("SELECT count(*) AS total, count(DISTINCT sha256(text)) AS kept FROM documents")
def m15_exact_dedup_counts(spark, sf_dir):
    return read(spark, sf_dir, "documents").agg(F.count("*").alias("total"), F.countDistinct(F.sha2("text", 256)).alias("kept"))


@query(
    """WITH a AS (SELECT user_id % 200 AS id, epoch_us(ts) AS ts, event_type = 'error' AS deleted, event_id FROM events WHERE event_id % 2 = 0),
    b AS (SELECT user_id % 200 AS id, epoch_us(ts) AS ts, event_type = 'error' AS deleted, event_id FROM events WHERE event_id % 2 = 1),
    u AS (SELECT *, 1 AS own FROM a UNION ALL SELECT *, 0 FROM b),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY deleted DESC, ts DESC, own DESC, event_id DESC) AS n FROM u)
    SELECT id, ts, deleted, event_id FROM r WHERE n = 1"""
)
def w9_u7_log_merge(spark, sf_dir):
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 200).alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), (F.col("event_type") == "error").alias("deleted"), "event_id")
    return inc.merge_log(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"))


@query(f"WITH {_SCAN} SELECT path FROM scan WHERE bytes % 3 = 0 UNION SELECT path FROM man WHERE chunk_count = 1")
def u4_changed_or_untracked(spark, sf_dir):
    scan, man = _scan(spark, sf_dir)
    return scan.where("bytes % 3 = 0").select("path").union(man.where("chunk_count = 1").select("path")).distinct()


@query(f"WITH {CHUNKS} SELECT file_path, count(*) AS chunks, arg_min(language, start_line * 1000000 + id) AS language FROM chunks GROUP BY file_path")
def a3_list_files(spark, sf_dir):
    return chunks(spark, sf_dir).groupBy("file_path").agg(F.count("*").alias("chunks"), F.min_by("language", F.struct("start_line", "id")).alias("language"))


@query(f"WITH {CHUNKS} SELECT count(*) AS live, count(DISTINCT file_path) AS files FROM chunks WHERE kind = ''")
def a1_a2_counts(spark, sf_dir):
    return chunks(spark, sf_dir).where("kind = ''").agg(F.count("*").alias("live"), F.countDistinct("file_path").alias("files"))


@query(f"WITH {CHUNKS}, f AS (SELECT file_path, count(*) AS n, arg_min(language, id) AS language FROM chunks GROUP BY 1) SELECT language, sum(n)::BIGINT AS chunks, count(*) AS files FROM f GROUP BY 1")
def a4_statistics_by_language(spark, sf_dir):
    f = chunks(spark, sf_dir).groupBy("file_path").agg(F.count("*").alias("n"), F.min_by("language", "id").alias("language"))
    return f.groupBy("language").agg(F.sum("n").alias("chunks"), F.count("*").alias("files"))


@query("SELECT o_custkey AS path, max(epoch_us(o_orderdate)) AS touched FROM orders GROUP BY 1")
def s17_newest_touch(spark, sf_dir):
    return read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("path")).agg(F.max(F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("touched"))
