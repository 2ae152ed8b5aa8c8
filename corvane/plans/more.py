"""Further scalar parsers, joins and memory-log selections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import parsing as ps
from corvane.functions import signals as sg
from corvane.functions import text as tx
from corvane.operators import incremental as inc
from corvane.operators import intervals
from corvane.operators import status as st
from corvane.plans.fixtures import CHUNKS, chunks, read
from corvane.plans.registry import query


@query("SELECT c_custkey, CASE WHEN s = '' THEN 'default' ELSE left(s, 40) END AS ns FROM (SELECT c_custkey, regexp_replace(regexp_replace(c_name || '#' || c_mktsegment || '//', '[^A-Za-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM customer)")
def f12_namespace(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", ps.namespace(F.concat("c_name", F.lit("#"), "c_mktsegment", F.lit("//"))).alias("ns"))


@query(
    f"""WITH {CHUNKS}, h AS (SELECT *, CASE WHEN id % 3 = 0 THEN '## Heading ' || id || chr(10) || content ELSE content END AS c FROM chunks)
    SELECT id, coalesce('[' || language || '] ', '') || CASE WHEN file_path LIKE 'src/__tests__%' THEN '[src] [test] M' || id % 7 || '.test' WHEN file_path LIKE 'src/%' THEN '[src] [source] Module' || id % 7
    WHEN file_path LIKE 'docs/%' THEN '[docs] [documentation] ' || CASE WHEN regexp_matches(c, '(?m)^#{{1,3}}\\s+(.+)$') THEN left(trim(regexp_extract(c, '(?m)^#{{1,3}}\\s+(.+)$', 1)), 80) ELSE 'Guide ' || id % 7 END
    WHEN file_path LIKE 'lib/%' THEN '[lib] [source] Util ' || id % 7 ELSE '[config] [configuration] S' || substr(file, 2) || '.config' END AS header FROM h"""
)
def f13_metadata_header(spark, sf_dir):
    """All chunks, a third of them with a heading, which counts in Markdown files."""
    begun = F.concat(F.lit("## Heading "), F.col("id").cast("string"), F.lit("\n"), "content")
    c = chunks(spark, sf_dir).withColumn("content", F.when(F.col("id") % 3 == 0, begun).otherwise(F.col("content")))
    return c.select("id", ps.metadata_header(F.col("file_path"), F.col("content"), F.col("language")).alias("header"))


@query(f"WITH {CHUNKS} SELECT id, sha256('q: ' || file_path || chr(10) || chr(10) || language || chr(10) || 'd' || chr(10) || content) AS text_sha FROM chunks")
def f14_embed_text(spark, sf_dir):
    return chunks(spark, sf_dir).select("id", F.sha2(ps.embed_text(F.col("file_path"), F.col("language"), F.lit("d"), F.col("content"), "q: "), 256).alias("text_sha"))


@query("SELECT conv_id, turn, 'Tool \"' || role || '\" failed: ' || left(trim(regexp_replace(text, '\\s+', ' ', 'g')), 400) AS query FROM conversations")
def f18_error_query(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", sg.error_query(F.col("role"), F.col("text")).alias("query"))


@query("SELECT n_nationkey, 'first' AS a, n_name AS b FROM nation")
def f23_labelled_lines(spark, sf_dir):
    text = F.concat(F.lit("a: first\n bad line\nb.1:  "), F.col("n_name"), F.lit("\na: second\n: x"))
    m = read(spark, sf_dir, "nation").select("n_nationkey", ps.labelled_lines(text).alias("m"))
    return m.select("n_nationkey", F.col("m")["a"].alias("a"), F.col("m")["b.1"].alias("b"))


@query("SELECT n_nationkey, 1 AS n, 'gotcha' AS kind, n_name AS content FROM nation")
def f24_extraction_lines(spark, sf_dir):
    text = F.concat(F.lit("NOTHING\nodd|x\n gotcha | "), F.col("n_name"), F.lit("\n|none\ngotcha|"), F.repeat(F.lit("y"), 201))
    e = read(spark, sf_dir, "nation").select("n_nationkey", ps.extracted(text, ["gotcha", "preference"]).alias("e"))
    return e.select("n_nationkey", F.size("e").alias("n"), F.col("e")[0]["kind"].alias("kind"), F.col("e")[0]["content"].alias("content"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN epoch_us(date_trunc('day', o_orderdate)) END AS reviewed FROM orders")
def f22_review_date(spark, sf_dir):
    raw = F.when(F.col("o_orderkey") % 3 == 0, "<date>").otherwise(F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.unix_micros(ps.review_date(raw)).alias("reviewed"))


@query("SELECT event_id, CASE WHEN a >= b AND a >= c THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END AS choice, greatest(a, b, c) AS confidence, event_id % 10 >= 5 AS yes, round(greatest(event_id % 10 / 10.0, 1 - event_id % 10 / 10.0), 6) AS sure, ['low', 'fair', 'high'][1 + least(2, event_id % 9 // 2)] AS level FROM (SELECT event_id, event_id % 7 AS a, event_id % 5 AS b, event_id % 3 AS c FROM events)")
def f25_decision_scoring(spark, sf_dir):
    i = F.col("event_id")
    p = F.create_map(F.lit("a"), i % 7, F.lit("b"), i % 5, F.lit("c"), i % 3)
    levels = F.array(*map(F.lit, ("low", "fair", "high")))
    return read(spark, sf_dir, "events").select(i, ps.chosen(p).alias("c"), ps.decided(i % 10 / 10).alias("d"), ps.level(F.floor(i % 9 / 2), levels).alias("level")).select("event_id", "c.*", "d.yes", F.round("d.confidence", 6).alias("sure"), "level")


@query("SELECT o_orderkey, (epoch(TIMESTAMP '1998-01-01') - epoch(o_orderdate)) / 86400 > 60 AS stale FROM orders")
def f27_decay(spark, sf_dir):
    now = F.lit("1998-01-01 00:00:00").cast("timestamp")
    return read(spark, sf_dir, "orders").select("o_orderkey", sg.stale(F.col("o_orderdate").cast("timestamp"), now, 30).alias("stale"))


@query(
    """WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-zA-Z0-9_]+'), lambda x: length(x) >= 3)) AS w FROM documents)
    SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.w, b.w)) AS shared, round(CASE WHEN len(a.w) + len(b.w) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) END, 6) AS jaccard FROM w a JOIN w b ON b.doc_id = a.doc_id + 1"""
)
def f8_f9_u5_overlap(spark, sf_dir):
    """Each document against the one of the next id."""
    w = read(spark, sf_dir, "documents").select("doc_id", tx.word_set(F.col("text"), 3).alias("w"))
    b = w.select((F.col("doc_id") - 1).alias("a"), F.col("doc_id").alias("b"), F.col("w").alias("wb"))
    j = w.join(b, F.col("doc_id") == F.col("a"))
    return j.select("a", "b", tx.shared(F.col("w"), F.col("wb")).cast("long").alias("shared"), F.round(tx.jaccard(F.col("w"), F.col("wb")), 6).alias("jaccard"))


@query(f"WITH {CHUNKS}, f AS (SELECT id, file_path FROM chunks WHERE start_line = 41) SELECT c.id FROM chunks c SEMI JOIN f ON c.file_path = f.file_path")
def j9_m29_file_restriction(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return c.join(c.where("start_line = 41").select("file_path"), "file_path", "left_semi").select("id")


@query(
    f"""WITH {CHUNKS}, n AS (SELECT id, file, start_line AS s, end_line + 40 AS e, id % 2 = 0 AS callable FROM chunks),
    o AS (SELECT n.id, n.callable, arg_max(m.callable, (m.s, -m.e, m.id)) AS near FROM n LEFT JOIN n m ON n.file = m.file AND m.id <> n.id AND m.s <= n.s AND m.e >= n.e AND (m.s < n.s OR m.e > n.e) GROUP BY ALL)
    SELECT id FROM o WHERE NOT callable OR near IS NULL OR NOT near"""
)
def j17_nested_callables(spark, sf_dir):
    n = chunks(spark, sf_dir).select("id", "file", F.col("start_line").alias("s"), (F.col("end_line") + 40).alias("e"), (F.col("id") % 2 == 0).alias("callable"))
    near = intervals.nearest_around(n, "file", "s", "e", "id", "callable")
    return near.where(~F.col("callable") | F.col("near").isNull() | ~F.col("near_value")).select("id")


@query(f"WITH {CHUNKS}, marks AS (SELECT DISTINCT 'docs/' || file AS p FROM chunks WHERE id % 40 = 1) SELECT DISTINCT file_path FROM chunks WHERE EXISTS (SELECT 1 FROM marks WHERE starts_with(file_path, p || '/'))")
def m20_documented_subtrees(spark, sf_dir):
    c = chunks(spark, sf_dir)
    # The marked folders are joined on each path's folders rather than by prefix.
    marks = c.where("id % 40 = 1").select(F.concat(F.lit("docs/"), "file").alias("p")).distinct()
    parts = F.split("file_path", "/")
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return c.select("file_path", F.explode(up).alias("p")).join(marks, "p", "left_semi").select("file_path").distinct()


@query("SELECT conv_id, avg(length(text)) < 120 AS weak FROM conversations GROUP BY conv_id")
def m21_weak_hits(spark, sf_dir):
    """Conversations as queries, the lengths of their turns as scores."""
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(st.is_weak(F.avg(F.length("text")), 120).alias("weak"))


@query(
    """WITH g AS (SELECT p_brand AS k, p_partkey AS i, trim(p_name) AS v, p_partkey % 3 = 0 AS derived FROM part),
    f AS (SELECT k, v, i, row_number() OVER (PARTITION BY k, lower(v) ORDER BY derived, i) AS n, derived FROM g)
    SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY derived, i) - 1 AS place FROM f WHERE n = 1"""
)
def u6_list_merge(spark, sf_dir):
    """For each brand its names as an exclusion list; every third is derived and comes after."""
    i = F.col("p_partkey")
    given = read(spark, sf_dir, "part").select(F.col("p_brand").alias("k"), i.alias("i"), F.col("p_name").alias("v"), (i % 3 == 0).alias("derived"))
    return inc.merge_lists(given, "k", "v", "i", "derived").select("k", "v", F.col("place").cast("long").alias("place"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rank FROM documents")
def w1_w11_rank_in_file(spark, sf_dir):
    w = Window.partitionBy("source").orderBy("doc_id")
    return read(spark, sf_dir, "documents").select("doc_id", (F.row_number().over(w) - 1).cast("long").alias("rank"))
