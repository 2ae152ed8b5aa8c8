"""Memory-log queries: events as records, documents as contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import signals as sg
from corvane.functions.signals import ADVICE, BLOCKED, CAUSES, SIGNALS
from corvane.operators import memory as mm
from corvane.operators import status as st
from corvane.plans.fixtures import read
from corvane.plans.registry import query
from corvane.plans.scalar import _MESSAGES, _case, _lit, _messages

_REC = """r AS (SELECT doc_id AS id, text AS content, round((doc_id * 29 % 100) / 100.0, 2)::DOUBLE AS similarity, (doc_id % 11) / 10.0::DOUBLE AS confidence, lang AS kind,
    ['t' || (doc_id % 3), 'u' || (doc_id % 5)] AS tags, doc_id % 13 = 0 AS deleted, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (doc_id % 365)::INTEGER AS observed FROM documents)"""


def _records(spark, sf_dir):
    d = F.col("doc_id")
    tag = lambda p, n: F.concat(F.lit(p), (d % n).cast("string"))
    observed = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + (d % 365) * 86400)
    return read(spark, sf_dir, "documents").select(
        d.alias("id"), F.col("text").alias("content"), F.round((d * 29 % 100) / F.lit(100.0), 2).alias("similarity"), ((d % 11) / F.lit(10.0)).alias("confidence"), F.col("lang").alias("kind"),
        F.array(tag("t", 3), tag("u", 5)).alias("tags"), (d % 13 == 0).alias("deleted"), observed.alias("observed"),
    )


@query(
    f"""WITH {_REC} SELECT id, round(similarity * least(1, greatest(0.01, confidence)), 6) AS score FROM r
    WHERE NOT deleted AND confidence >= 0.5 AND similarity >= 0.72 AND kind = 'en' AND list_has_any(tags, ['t1', 't2']) AND NOT list_has_any(tags, ['u0']) ORDER BY score DESC, id LIMIT 20"""
)
def f28_recall(spark, sf_dir):
    return mm.recall(_records(spark, sf_dir), kind="en", tags=["t1", "t2"], exclude_tags=["u0"], k=20).select("id", "score")


@query(f"WITH {_REC} SELECT id, confidence FROM r WHERE NOT deleted AND list_contains(tags, 't1')")
def m1_m4_m7_live_tagged(spark, sf_dir):
    return _records(spark, sf_dir).where(~F.col("deleted") & F.array_contains("tags", "t1")).select("id", "confidence")


_SETS = """s AS (SELECT id, list_sort(list_distinct(list_filter(string_split_regex(lower(content), '[^a-zA-Z0-9_]+'), lambda x: x <> ''))) AS w FROM {src}),
one AS (SELECT w, min(id) AS id FROM s GROUP BY w),
x AS (SELECT id, w, unnest(w) AS t FROM one),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS c, any_value(len(a.w)) AS n, any_value(len(b.w)) AS m FROM x a JOIN x b ON a.t = b.t AND a.id < b.id GROUP BY a.id, b.id)"""
_BENCH = "src AS (SELECT item_id AS id, text AS content FROM benchmark UNION ALL SELECT item_id + 100000, text || ' extra' FROM benchmark WHERE item_id % 3 = 0 UNION ALL SELECT item_id + 200000, text FROM benchmark WHERE item_id % 5 = 0 UNION ALL SELECT item_id + 300000, 'quite other words ' || item_id || ' and more ' || left(text, 30) FROM benchmark WHERE item_id % 2 = 0)"


def _bench(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("content"))
    more = b.where("id % 3 = 0").select((F.col("id") + 100000).alias("id"), F.concat("content", F.lit(" extra")).alias("content"))
    same = b.where("id % 5 = 0").select((F.col("id") + 200000).alias("id"), "content")
    begun = F.concat(F.lit("quite other words "), F.col("id").cast("string"), F.lit(" and more "), F.substring("content", 1, 30))
    other = b.where("id % 2 = 0").select((F.col("id") + 300000).alias("id"), begun.alias("content"))
    return b.unionByName(more).unionByName(same).unionByName(other)


@query(
    f"""WITH {_BENCH}, {_SETS.format(src="src")} SELECT a, b, round(c / (n + m - c), 6) AS similarity FROM p WHERE c / (n + m - c) > 0.85
    UNION ALL SELECT one.id, s.id, 1.0 FROM s JOIN one ON s.w = one.w WHERE s.id <> one.id"""
)
def j10_lexical_pairs(spark, sf_dir):
    return mm.similar_pairs(_bench(spark, sf_dir), 0.85).select("a", "b", F.round("similarity", 6).alias("similarity"))


_NOTES = f"""{_BENCH}, n AS (SELECT *, (id % 11) / 10.0 AS confidence, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * (id % 365)::INTEGER AS observed FROM src)"""


@query(
    f"""WITH {_NOTES}, {_SETS.format(src="n")}, pairs AS (
        SELECT a AS id, b AS other FROM p WHERE c / (n + m - c) > 0.85 UNION ALL SELECT one.id, s.id FROM s JOIN one ON s.w = one.w WHERE s.id <> one.id)
    SELECT 'low-confidence' AS issue, id, NULL AS other FROM n WHERE confidence < 0.5
    UNION ALL SELECT 'stale', id, NULL FROM n WHERE observed < TIMESTAMP '2024-10-01' - INTERVAL 60 DAY
    UNION ALL SELECT 'near-duplicate', id, other FROM pairs"""
)
def m6_lint(spark, sf_dir):
    """All three issues of a log made of the benchmark's passages and variants of them."""
    i = F.col("id")
    observed = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp")) + (i % 365) * 86400)
    notes = _bench(spark, sf_dir).select("id", "content", ((i % 11) / F.lit(10.0)).alias("confidence"), observed.alias("observed"))
    return mm.lint(notes, F.lit("2024-10-01 00:00:00").cast("timestamp"))


@query()  # DuckDB is too slow for pairs of all documents; a test counts them on a fixture
def m6_lint_counts(spark, sf_dir):
    return mm.lint_counts(_records(spark, sf_dir), F.lit("2024-10-01 00:00:00").cast("timestamp"))


@query(
    f"""WITH {_BENCH}, {_SETS.format(src="src")}, g AS (SELECT one.id AS rep, s.id FROM s JOIN one ON s.w = one.w),
    near AS (SELECT a, b FROM p WHERE c / (n + m - c) >= 0.85), hit AS (
        SELECT id FROM g WHERE id >= 100000 AND (rep < 100000 OR rep IN (SELECT b FROM near WHERE a < 100000)))
    SELECT id FROM src WHERE id >= 100000 AND id NOT IN (SELECT id FROM hit)"""
)
def j16_capture_dedup(spark, sf_dir):
    """The variants against the passages; those with other words beside remain."""
    b = _bench(spark, sf_dir)
    return mm.new_candidates(b.where("id >= 100000"), b.where("id < 100000")).select("id")


@query(
    """WITH q AS (SELECT list_distinct(list_filter(string_split_regex(lower(text), '[^a-zA-Z0-9_]+'), lambda x: length(x) >= 3)) AS m FROM documents WHERE doc_id = 1),
    c AS (SELECT doc_id AS id, list_intersect(list_distinct(list_filter(string_split_regex(lower(text), '[^a-zA-Z0-9_]+'), lambda x: length(x) >= 3)), m) AS s, (doc_id % 17) / 17.0 AS score FROM documents, q WHERE doc_id % 6 <> 0)
    SELECT id, len(s) AS shared, len(list_filter(s, lambda x: x NOT IN ('the', 'and', 'was'))) AS content_shared FROM c WHERE len(s) >= 2 AND len(list_filter(s, lambda x: x NOT IN ('the', 'and', 'was'))) >= 1 ORDER BY content_shared DESC, shared DESC, score DESC, id LIMIT 15"""
)
def m11_auto_inject(spark, sf_dir):
    """The best of all documents for the message of document 1; those of ids divisible by 6 are in already."""
    d = read(spark, sf_dir, "documents")
    c = d.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), ((F.col("doc_id") % 17) / F.lit(17.0)).alias("score"))
    message = d.where("doc_id = 1").select(F.col("text").alias("message"))
    done = c.where("id % 6 = 0").select("id")
    found = mm.inject(c.crossJoin(F.broadcast(message)), F.col("message"), done, 15, stop=["the", "and", "was"])  # one row
    return found.select("id", F.col("shared").cast("long").alias("shared"), F.col("content_shared").cast("long").alias("content_shared"))


@query("SELECT p_brand AS ns, count(*) AS n, max(p_partkey) AS ver FROM part GROUP BY 1 ORDER BY n DESC, ver DESC, ns LIMIT 5")
def m22_namespace_adoption(spark, sf_dir):
    return mm.namespaces(read(spark, sf_dir, "part").select(F.col("p_brand").alias("ns"), F.col("p_partkey").alias("ver"))).limit(5)


@query("SELECT p_partkey, (p_size // 10, p_size % 10, p_partkey % 7) > (2, 3, 4) AS newer FROM part")
def m19_version_compare(spark, sf_dir):
    s, k = F.col("p_size"), F.col("p_partkey")
    v = F.concat_ws(".", F.floor(s / 10).cast("string"), (s % 10).cast("string"), F.concat((k % 7).cast("string"), F.lit("-rc1")))
    return read(spark, sf_dir, "part").select("p_partkey", mm.version_newer(v, F.lit("2.3.4")).alias("newer"))


@query(
    """SELECT event_id, CASE WHEN event_id % 13 = 0 OR (event_id % 4 = 0 AND event_id % 3 + event_id % 2 > 0) THEN 'incomplete'
           WHEN event_id % 5 = 0 OR event_id % 7 = 0 OR event_id % 11 = 0 THEN 'partial' ELSE 'ok' END AS state,
           CASE WHEN event_id % 4 > 0 THEN (event_id % 4) || ' consecutive reindex failure(s)' || CASE WHEN event_id % 3 > 0 THEN ': boom' ELSE '' END
                WHEN event_id % 6 > 0 AND (event_id % 8 = 0 OR event_id % 6 > event_id % 7) THEN 'changes detected after the last successful reindex' END AS reason
    FROM events"""
)
def m16_m18_run_state(spark, sf_dir):
    i = F.col("event_id")
    bad = lambda n: F.when(i % n == 0, 1).otherwise(0)
    state = st.run_state(i % 13 == 0, i % 4, i % 3, i % 2, bad(5), bad(7), bad(11))
    changed, succeeded = F.when(i % 6 > 0, i % 6), F.when(i % 8 != 0, i % 7)
    reason = st.watcher_reason(i % 4, F.when(i % 3 > 0, "boom"), changed, succeeded)
    return read(spark, sf_dir, "events").select(i, state.alias("state"), reason.alias("reason"))


_FAILED = """f AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'Write' WHEN 1 THEN 'bash' ELSE 'grep' END || user_id % 4 AS tool, cause, msg FROM (
        SELECT m.event_id, user_id, msg, """ + _case(CAUSES, "msg") + """ AS cause FROM m JOIN events e ON e.event_id = m.event_id))"""


def _failed(spark, sf_dir):
    m = _messages(spark, sf_dir).join(read(spark, sf_dir, "events").select("event_id", "user_id"), "event_id")
    i = F.col("event_id")
    tool = F.concat(F.when(i % 3 == 0, "Write").when(i % 3 == 1, "bash").otherwise("grep"), (F.col("user_id") % 4).cast("string"))
    return m.select("event_id", tool.alias("tool"), sg.cause(F.col("msg")).alias("cause"), "msg")


def _lessons(spark, sf_dir):
    """Every second failure as a record, tagged by its tool and cause; some lack one of the tags."""
    i = F.col("event_id")
    tags = F.array(F.when(i % 7 != 0, sg.ERROR_TAG).otherwise("other"), F.concat(F.lit(sg.TOOL_TAG), F.lower("tool")), F.concat(F.lit(sg.CAUSE_TAG), F.coalesce("cause", F.lit("none"))))
    return _failed(spark, sf_dir).where(i % 2 == 0).select(i.alias("id"), sg.lesson(F.col("tool"), F.col("msg")).alias("content"), tags.alias("tags"), (i % 1000).alias("observed"))


@query(
    f"""WITH {_MESSAGES}, {_FAILED} SELECT event_id AS id, lower(tool) AS tool FROM f
    WHERE event_id % 2 = 0 AND event_id % 7 <> 0 AND lower(tool) IN ('write1', 'bash2', 'bash3') AND cause IN ('unknown-tool', 'schema', 'permissions', 'path')
    ORDER BY event_id % 1000 DESC, event_id DESC LIMIT 5"""
)
def m8_proactive_gotchas(spark, sf_dir):
    return mm.gotchas(_lessons(spark, sf_dir), ["WRITE1", "bash2", "Bash3"]).select("id", "tool")


@query(
    f"""WITH {_MESSAGES}, {_FAILED} SELECT event_id, 'Tool `' || tool || '` failed: ' || trim(regexp_replace(msg, '\\s+', ' ', 'g')) || CASE cause {" ".join(f"WHEN '{k}' THEN ' — {v.replace(chr(39), chr(39) * 2)}'" for k, v in ADVICE.items())} ELSE '' END AS lesson
    FROM f WHERE length(trim(regexp_replace(msg, '\\s+', ' ', 'g'))) >= 15"""
)
def m14_lessons(spark, sf_dir):
    f = _failed(spark, sf_dir).where(sg.worth_recording(F.col("msg")))
    return f.select("event_id", sg.lesson(F.col("tool"), F.col("msg")).alias("lesson"))


@query(
    f"""WITH {_MESSAGES}, {_FAILED}, r AS (SELECT DISTINCT lower(tool) AS tool, coalesce(cause, 'none') AS cause FROM f WHERE event_id % 2 = 0 AND event_id % 5 = 0)
    SELECT event_id FROM f SEMI JOIN r ON r.tool = lower(f.tool) AND r.cause = f.cause WHERE event_id % 4 = 2"""
)
def m9_equivalent_record(spark, sf_dir):
    return mm.known_failures(_failed(spark, sf_dir).where("event_id % 4 = 2"), _lessons(spark, sf_dir).where("id % 5 = 0")).select("event_id")


@query(
    """WITH h AS (SELECT doc_id AS id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-zA-Z0-9_]+'), lambda x: length(x) >= 3)) AS w,
               round((doc_id * 29 % 100) / 100.0, 2) AS similarity, round((doc_id * 31 % 100) / 100.0, 2) AS score FROM documents),
    e AS (SELECT list_distinct(list_filter(string_split_regex(lower(text), '[^a-zA-Z0-9_]+'), lambda x: length(x) >= 3)) AS w FROM documents WHERE doc_id = 2),
    s AS (SELECT * FROM h WHERE score >= 0.7 ORDER BY score DESC, id LIMIT 12),
    c AS (SELECT id, similarity, id % 3 <> 0 AND similarity >= 0.3 AS fit FROM s, e WHERE len(list_intersect(s.w, e.w)) >= 1)
    SELECT id, similarity, fit AND row_number() OVER (PARTITION BY fit ORDER BY similarity DESC, id) <= 4 AS inject FROM c"""
)
def m10_error_recall(spark, sf_dir):
    """Hits for the error that document 2 tells of; records whose id is divisible by 3 were injected before."""
    d = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    hits = d.select(i.alias("id"), F.col("text").alias("content"), F.round((i * 31 % 100) / F.lit(100.0), 2).alias("score"), F.round((i * 29 % 100) / F.lit(100.0), 2).alias("similarity"))
    error = d.where("doc_id = 2").select(F.col("text").alias("error"))
    hits = hits.crossJoin(F.broadcast(error))  # one row
    return mm.recall_for_error(hits, F.col("error"), hits.where("id % 3 = 0").select("id"), k=4, inject_min=0.3)


@query(
    f"""WITH {_MESSAGES}, {_BENCH}, {_SETS.format(src="src")}, g AS (SELECT one.id AS rep, s.id FROM s JOIN one ON s.w = one.w),
    near AS (SELECT a, b FROM p WHERE c / (n + m - c) >= 0.85), hit AS (
        SELECT id FROM g WHERE id >= 100000 AND (rep < 100000 OR rep IN (SELECT b FROM near WHERE a < 100000))),
    o AS (SELECT src.id, src.id % 12 AS turn, CASE src.id % 12 WHEN 0 THEN 'Error: ENOENT here' WHEN 3 THEN 'Traceback (most recent call last)' WHEN 4 THEN 'fine' WHEN 8 THEN 'npm ERR! x' ELSE 'all is well' END AS output FROM src WHERE src.id >= 100000 AND src.id NOT IN (SELECT id FROM hit))
    SELECT id, turn FROM (SELECT id, turn, row_number() OVER (PARTITION BY turn ORDER BY id) AS n FROM o WHERE {_case(SIGNALS, "output")} IS NOT NULL) WHERE n <= 2"""
)
def m13_auto_capture(spark, sf_dir):
    b = _bench(spark, sf_dir)
    t = F.col("id") % 12
    output = F.when(t == 0, "Error: ENOENT here").when(t == 3, "Traceback (most recent call last)").when(t == 4, "fine").when(t == 8, "npm ERR! x").otherwise("all is well")
    given = b.where("id >= 100000").select("id", t.alias("turn"), "content", output.alias("output"))
    return mm.capture(given, b.where("id < 100000")).select("id", "turn")


_LOG = f"""{_MESSAGES}, log AS (SELECT event_id AS id, msg AS content, event_id % 7 AS observed, (event_id % 4) / 4.0 AS confidence, event_id % 9 = 0 AS gone FROM m WHERE event_id % 2 = 0)"""


def _log(spark, sf_dir, which):
    i = F.col("event_id")
    return _messages(spark, sf_dir).where(which).select(
        i.alias("id"), F.col("msg").alias("content"), F.lit("gotcha").alias("kind"), F.array(F.lit("t")).alias("tags"), F.when(i % 5 != 0, (i % 4) / F.lit(4.0)).alias("confidence"),
        (i % 7).alias("observed"), F.when((i % 9 == 0) & (i % 2 == 0), F.lit(1).cast("long")).alias("deleted_at"),
    )


@query(
    f"""WITH {_MESSAGES}, x AS (SELECT *, {" OR ".join(f"regexp_matches(msg, {_lit(p)})" for p in BLOCKED)} AS blocked FROM m)
    SELECT event_id AS id, CASE WHEN event_id % 5 = 0 AND event_id % 2 = 1 THEN 1.0 WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 4) / 4.0 END AS confidence FROM x WHERE event_id % 2 = 0 OR NOT blocked"""
)
def m2_add(spark, sf_dir):
    """A log of the even events, to which the odd ones are added."""
    return mm.add(_log(spark, sf_dir, "event_id % 2 = 0"), _log(spark, sf_dir, "event_id % 2 = 1"))[0].select("id", "confidence")


@query(
    f"""WITH {_LOG}, p AS (SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN 'run git push --force now' WHEN 1 THEN 'new ' || event_id END AS content FROM m WHERE event_id % 5 = 1),
    j AS (SELECT l.*, p.id AS pid, p.content AS fresh, p.id IS NOT NULL AND NOT gone AND NOT (coalesce(p.content, '') LIKE '%--force%' AND p.content <> l.content) AS hit FROM log l LEFT JOIN p ON p.id = l.id)
    SELECT id, CASE WHEN hit THEN coalesce(fresh, content) ELSE content END AS content, CASE WHEN hit THEN 'preference' ELSE 'gotcha' END AS kind, observed FROM j"""
)
def m2_update(spark, sf_dir):
    """Patches of every fifth event to the log of the even ones; a third of them have a content that is not allowed."""
    i = F.col("event_id")
    fresh = F.when(i % 3 == 0, "run git push --force now").when(i % 3 == 1, F.concat(F.lit("new "), i.cast("string")))
    none = lambda kind: F.lit(None).cast(kind)
    patches = _messages(spark, sf_dir).where(i % 5 == 1).select(i.alias("id"), fresh.alias("content"), F.lit("preference").alias("kind"), none("array<string>").alias("tags"), none("double").alias("confidence"))
    return mm.update(_log(spark, sf_dir, "event_id % 2 = 0"), patches)[0].select("id", "content", "kind", "observed")


@query(f"WITH {_LOG} SELECT id, CASE WHEN id % 6 = 0 AND NOT gone THEN 99 ELSE observed END AS observed, CASE WHEN gone THEN 1 WHEN id % 6 = 0 THEN 99 END AS deleted_at FROM log")
def m3_remove(spark, sf_dir):
    log = _log(spark, sf_dir, "event_id % 2 = 0")
    return mm.remove(log, log.where("id % 6 = 0").select("id"), F.lit(99).cast("long")).select("id", "observed", "deleted_at")


_SYNC = """l AS (SELECT event_id AS id, event_id % 9 = 0 AS gone FROM events WHERE event_id % 3 <> 0), live AS (SELECT id FROM l WHERE NOT gone),
s AS (SELECT event_id AS id FROM events WHERE event_id % 4 <> 0 UNION ALL SELECT event_id FROM events WHERE event_id % 20 = 1), r AS (SELECT id, count(*) AS n FROM s GROUP BY id),
orph AS (SELECT id FROM r WHERE id NOT IN (SELECT id FROM live)), sus AS (SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '2024-01-01 10:00:00' ELSE TIMESTAMP '2024-01-01 11:30:00' END AS first_seen FROM events WHERE event_id % 6 = 0 OR event_id % 15 = 0)"""


def _sync(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    at = lambda t: F.lit(t).cast("timestamp")
    log = e.where("id % 3 <> 0").select("id", F.when(F.col("id") % 9 == 0, at("2024-01-01 00:00:00")).alias("deleted_at"))
    store = e.where("id % 4 <> 0").unionByName(e.where("id % 20 = 1"))
    suspects = e.where("id % 6 = 0 or id % 15 = 0").select("id", F.when(F.col("id") % 2 == 0, at("2024-01-01 10:00:00")).otherwise(at("2024-01-01 11:30:00")).alias("first_seen"))
    return mm.reconcile(log, store, e.where("id % 5 <> 0"), suspects, at("2024-01-01 12:00:00"))


@query(
    f"""WITH {_SYNC} SELECT id, 'collapse' AS action FROM live JOIN r USING (id) WHERE n > 1
    UNION ALL SELECT live.id, 'restore' FROM live LEFT JOIN r ON r.id = live.id WHERE n IS NULL OR n > 1
    UNION ALL SELECT live.id, 'index' FROM live LEFT JOIN r ON r.id = live.id WHERE n IS NULL OR n > 1 OR live.id % 5 = 0
    UNION ALL SELECT id, 'delete' FROM orph JOIN sus USING (id) WHERE first_seen <= TIMESTAMP '2024-01-01 11:00:00'"""
)
def m5_reconcile(spark, sf_dir):
    return _sync(spark, sf_dir)[0]


@query(
    f"""WITH {_SYNC} SELECT orph.id, epoch_us(coalesce(first_seen, TIMESTAMP '2024-01-01 12:00:00')) AS first_seen FROM orph LEFT JOIN sus ON sus.id = orph.id
    WHERE first_seen IS NULL OR first_seen > TIMESTAMP '2024-01-01 11:00:00'"""
)
def x8_orphan_grace(spark, sf_dir):
    return _sync(spark, sf_dir)[1].select("id", F.unix_micros("first_seen").alias("first_seen"))


@query(
    """WITH f AS (SELECT c_custkey, CASE c_custkey % 2 WHEN 0 THEN 'c' ELSE 'C' END || ':/work/' || c_name AS folder FROM customer),
    s AS (SELECT c_custkey, folder, unnest([lower(left(folder, 1)) || substr(folder, 2), upper(left(folder, 1)) || substr(folder, 2)]) AS sp FROM f),
    n AS (SELECT c_custkey, left(regexp_replace(regexp_extract(sp, '([^/]*)$', 1), '[^A-Za-z0-9_]+', '_', 'g') || '_' || left(sha1(sp), 8), 40) AS ns, left(sp, 1) = 'C' AS own FROM s)
    SELECT c_custkey, ns FROM n WHERE NOT own"""
)
def m23_legacy_names(spark, sf_dir):
    folder = F.concat(F.when(F.col("c_custkey") % 2 == 0, "c").otherwise("C"), F.lit(":/work/"), "c_name")
    return read(spark, sf_dir, "customer").select("c_custkey", F.explode(st.legacy_names(folder, windows=True)).alias("ns"))
