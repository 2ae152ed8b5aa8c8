"""Retrieval queries: keyword, vector and hybrid search, and context optimisation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import paths
from corvane.functions import vectors as vx
from corvane.operators import incremental as inc
from corvane.operators import retrieval as rt
from corvane.operators.keywords import KeywordIndex
from corvane.plans.fixtures import CHUNKS, chunks, queries, read, tokens_sql, vector_queries
from corvane.plans.registry import query
from corvane.sources import shared

K = 10

_ROLE = "CASE doc_id % 5 WHEN 1 THEN 'doc' WHEN 2 THEN 'test' ELSE 'source' END"
_INDEX = f"""{tokens_sql("tok", "documents", "doc_id", "text")},
dl AS (SELECT key, count(*) AS dl FROM tok GROUP BY key),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT token, count(*) AS df FROM tok GROUP BY token)"""
_ASKED = tokens_sql("ask", "benchmark", "item_id", "text")
_BM25 = f"""{_INDEX}, {_ASKED},
bm AS (
    SELECT ask.key AS qid, tok.key AS id,
           round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
    FROM ask JOIN tok USING (token) JOIN df USING (token) JOIN dl ON dl.key = tok.key CROSS JOIN st
    GROUP BY ALL
)"""


def _vec(asked: str) -> str:
    return f"""
q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE {asked}),
sim AS (
    SELECT qid, vec_id AS id, round(least(1, greatest(0, (list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) + 1) / 2)), 6) AS score
    FROM embeddings, q WHERE embedding IS NOT NULL
)"""


_VEC = _vec("vec_id IN (SELECT item_id FROM benchmark)")


def _top(src: str, name: str, k: int) -> str:
    return f"{name} AS (SELECT qid, id, score, rn - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rn FROM {src}) WHERE rn <= {k})"


_FUSED = f"""{_BM25}, {_VEC}, {_top("bm", "kl", 3 * K)}, {_top("sim", "vl", 3 * K)},
fused AS (
    SELECT qid, id, vl.rank AS vr, kl.rank AS kr, vl.score AS vs, kl.score AS ks,
           coalesce(0.6 * 61 / (60 + vl.rank + 1), 0)
           + coalesce(0.4 * 61 / (60 + kl.rank + 1), 0) * CASE id % 5 WHEN 1 THEN 0.5 WHEN 2 THEN 0.6 ELSE 1 END AS f
    FROM vl FULL JOIN kl USING (qid, id)
)"""


_INDEXES: dict[tuple[str, str], KeywordIndex] = {}


def _index(spark: SparkSession, sf_dir: str) -> KeywordIndex:
    """The stored index of a table, built by the first query that asks for it and deleted with the session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        root = f"{shared.folder(spark)}/keywords-{len(_INDEXES)}"
        _INDEXES[key] = KeywordIndex(spark, root).add(chunks(spark, sf_dir))
    return _INDEXES[key]


def _legs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = chunks(spark, sf_dir)
    asked = queries(spark, sf_dir)
    words = _index(spark, sf_dir).best(asked, 3 * K)
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    near = rt.knn(vectors, asked, 3 * K)
    return near, words, c.select("id", paths.role(F.col("file_path")).alias("role"))


@query(f"WITH {_INDEX} SELECT n AS chunks, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM df) AS tokens, (SELECT max(df) FROM df) AS max_df FROM st")
def a5_bm25_statistics(spark, sf_dir):
    index = _index(spark, sf_dir)
    df = index.postings().groupBy("token").count().agg(F.count("*").alias("tokens"), F.max("count").alias("max_df"))
    return index.statistics().crossJoin(df).select(F.col("n").alias("chunks"), F.round("avgdl", 6).alias("avgdl"), "tokens", "max_df")


@query(f"WITH {_BM25}, {_top('bm', 't', K)} SELECT qid, id, score, rank FROM t")
def t3_bm25_topk(spark, sf_dir):
    return _index(spark, sf_dir).best(queries(spark, sf_dir), K).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_INDEX}, {_ASKED} SELECT ask.key AS qid, token, df FROM ask JOIN df USING (token)")
def j2_query_token_lookup(spark, sf_dir):
    index = _index(spark, sf_dir)
    asked = index.asked(queries(spark, sf_dir))
    df = index.postings(asked).groupBy("token").agg(F.count("*").alias("df"))
    return asked.join(df, "token").select("qid", "token", "df")


@query(f"WITH {_vec('vec_id % 100 = 0')}, {_top('sim', 't', K)} SELECT qid, id, score, rank FROM t")
def t1_vector_topk(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return rt.knn(vectors, vector_queries(spark, sf_dir), K).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(
    """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 1), s AS (
        SELECT vec_id AS id, round(least(1, greatest(0, (list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) + 1) / 2)), 6) AS score
        FROM embeddings, q WHERE embedding IS NOT NULL AND label = 1)
    SELECT id, score FROM s ORDER BY score DESC, id LIMIT 20"""
)
def j3_filtered_knn_one_query(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 1").select(F.col("embedding").alias("q"))
    scored = e.where("label = 1").crossJoin(F.broadcast(q)).where("embedding is not null")  # one row
    scored = scored.select(F.col("vec_id").alias("id"), F.round(vx.similarity(F.col("embedding"), F.col("q")), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(20)


@query(
    f"""WITH {_FUSED}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(f, 6) DESC, vr NULLS LAST, kr NULLS LAST, id) AS rn FROM fused WHERE round(f, 6) >= 0.35)
    SELECT qid, id, round(f, 6) AS score, rn - 1 AS rank FROM r WHERE rn <= {K}"""
)
def j1_hybrid_fused(spark, sf_dir):
    near, words, roles = _legs(spark, sf_dir)
    return rt.ranked(rt.fuse(near, words, roles, 0.4, min_score=0.35), K).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {_FUSED}, n AS (
        SELECT *, round(f / (CASE WHEN vr IS NULL THEN 0 ELSE 0.6 END + CASE WHEN kr IS NULL THEN 0 ELSE 0.4 END), 6) AS s FROM fused),
    r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, vr NULLS LAST, kr NULLS LAST, id) AS rn FROM n WHERE s >= 0.5)
    SELECT qid, id, s AS score, rn - 1 AS rank FROM r WHERE rn <= {K}"""
)
def f6_hybrid_normalized(spark, sf_dir):
    near, words, roles = _legs(spark, sf_dir)
    return rt.ranked(rt.fuse(near, words, roles, 0.4, normalized=True, min_score=0.5), K).select("qid", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(
    f"""WITH {_FUSED}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(f, 6) DESC, vr NULLS LAST, kr NULLS LAST, id) AS rn FROM fused),
    t AS (SELECT qid, id, coalesce(vs, 0) AS raw FROM r WHERE rn <= {K})
    SELECT qid, id, round(CASE WHEN max(raw) OVER w > min(raw) OVER w THEN (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) ELSE 1 END, 6) AS confidence
    FROM t WINDOW w AS (PARTITION BY qid)"""
)
def w5_confidence(spark, sf_dir):
    near, words, roles = _legs(spark, sf_dir)
    return rt.confidence(rt.ranked(rt.fuse(near, words, roles), K)).select("qid", "id", "confidence")


_ALL = "results AS (SELECT 1 AS qid, *, round((id * 37 % 101) / 101.0, 6) AS score FROM chunks)"


def _results(spark, sf_dir):
    c = chunks(spark, sf_dir).drop("file_path").withColumnRenamed("file", "file_path")
    return c.select(F.lit(1).alias("qid"), "id", "file_path", "content", "start_line", "end_line", F.round((F.col("id") * 37 % 101) / 101.0, 6).alias("score"))


@query(
    f"""WITH {CHUNKS}, {_ALL}, g AS (
        SELECT *, CASE WHEN start_line - lag(end_line) OVER w > 6 OR lag(end_line) OVER w IS NULL THEN 1 ELSE 0 END AS far
        FROM results WINDOW w AS (PARTITION BY file ORDER BY start_line, id)),
    i AS (SELECT *, sum(far) OVER (PARTITION BY file ORDER BY start_line, id ROWS UNBOUNDED PRECEDING) AS island FROM g)
    SELECT file AS file_path, string_agg(CAST(id AS VARCHAR), '+' ORDER BY start_line, id) AS merged_ids, min(start_line) AS start_line,
           arg_max(end_line, start_line * 1000000 + id) AS end_line, max(score) AS score, count(*) AS parts,
           sha256(string_agg(content, chr(10) ORDER BY start_line, id)) AS content_sha
    FROM i GROUP BY file, island"""
)
def w2_merge_adjacent(spark, sf_dir):
    m = rt.merge_adjacent(_results(spark, sf_dir))
    return m.select("file_path", "merged_ids", "start_line", "end_line", "score", F.col("parts").cast("long").alias("parts"), F.sha2("content", 256).alias("content_sha"))


@query(
    f"""WITH {CHUNKS}, {_ALL}, r AS (
        SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, id) AS place, count(*) OVER (PARTITION BY file) AS n FROM results)
    SELECT id, file AS file_path, score, n > 3 AS file_capped FROM r WHERE place <= 3"""
)
def w3_w4_file_cap(spark, sf_dir):
    return rt.cap_per_file(_results(spark, sf_dir)).select("id", "file_path", "score", "file_capped")


@query()
def j10_greedy_same_file_dedup(spark, sf_dir):
    r = _results(spark, sf_dir).withColumn("rank", F.col("id"))
    return rt.drop_similar(r, keep=["qid", "file_path", "id", "score"])


@query(
    f"""WITH {_FUSED}, r AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(f, 6) DESC, vr NULLS LAST, kr NULLS LAST, id) - 1 AS rank FROM fused),
    s AS (SELECT *, CASE WHEN rank < 20 THEN round((id * 13 % 97) / 97.0, 6) END AS rr FROM r WHERE rank < 25)
    SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY rr DESC NULLS LAST, rank) - 1 AS new_rank FROM s"""
)
def t6_rerank_pool(spark, sf_dir):
    near, words, roles = _legs(spark, sf_dir)
    base = rt.ranked(rt.fuse(near, words, roles), 25)
    return rt.rerank(base, F.round((F.col("id") * 13 % 97) / 97.0, 6), 20).select("qid", "id", F.col("new_rank").cast("long").alias("new_rank"))


@query(f"WITH {_BM25}, {_VEC}, {_top('bm', 'kl', 30)}, {_top('sim', 'vl', 30)}, u AS (SELECT qid, id, min(p) AS p FROM (SELECT qid, id, 0 AS p FROM kl UNION ALL SELECT qid, id, 1 FROM vl) GROUP BY ALL) SELECT qid, id, p AS origin FROM u")
def u2_ordered_union(spark, sf_dir):
    near, words, _ = _legs(spark, sf_dir)
    both = words.select("qid", "id", F.lit(0).alias("p")).unionByName(near.select("qid", "id", F.lit(1).alias("p")))
    return both.groupBy("qid", "id").agg(F.min("p").alias("origin"))


@query(f"WITH {_BM25}, {_VEC}, {_top('bm', 'kl', 30)}, {_top('sim', 'vl', 30)} SELECT count(*) AS n_rows, count(DISTINCT (qid, id)) AS candidates FROM (SELECT qid, id FROM kl UNION ALL SELECT qid, id FROM vl)")
def u1_u3_candidate_union(spark, sf_dir):
    near, words, _ = _legs(spark, sf_dir)
    both = words.select("qid", "id").unionByName(near.select("qid", "id"))
    return both.agg(F.count("*").alias("n_rows"), F.countDistinct("qid", "id").alias("candidates"))


@query(f"WITH {_FUSED}, x AS (SELECT qid, id, round(f, 6) AS s, row_number() OVER (PARTITION BY qid ORDER BY round(f, 6) DESC, vr NULLS LAST, kr NULLS LAST, id) AS rn FROM fused), m AS (SELECT file_path, max(s) AS score FROM x JOIN (SELECT doc_id AS id, source AS file_path FROM documents) USING (id) WHERE rn <= 10 GROUP BY 1) SELECT file_path, score FROM m ORDER BY score DESC, file_path LIMIT 5")
def a22_related_files(spark, sf_dir):
    near, words, roles = _legs(spark, sf_dir)
    found = rt.ranked(rt.fuse(near, words, roles), K).join(chunks(spark, sf_dir).select("id", F.col("file")), "id")
    return found.groupBy(F.col("file").alias("file_path")).agg(F.max("score").alias("score")).orderBy(F.desc("score"), "file_path").limit(5)


_OWN_TOKENS = tokens_sql("tok", "(SELECT * FROM live)", "id", "content")


@query(
    f"""WITH {CHUNKS}, live AS (SELECT id, file_path, CASE WHEN id % 10 = 3 THEN 'replaced words ' || id ELSE content END AS content FROM chunks
        WHERE lower(file_path) NOT IN (SELECT lower(file_path) FROM chunks WHERE id % 70 = 9) OR id % 10 = 3), {_OWN_TOKENS}
    SELECT token, count(*) AS df, CAST(sum(key) AS BIGINT) AS id_sum, min(key) AS first_id FROM tok GROUP BY token"""
)
def k10_s15_keyword_index(spark, sf_dir):
    """Added in two parts, files removed, some chunks replaced, merged with a second index, folded and loaded anew."""
    c = chunks(spark, sf_dir)
    root = f"{shared.folder(spark)}/kept-{sf_dir.strip('/').replace('/', '-')}-{uuid.uuid4().hex[:8]}"
    index = KeywordIndex(spark, root, buckets=8).add(c.where("id % 2 = 0")).add(c.where("id % 2 = 1"))
    index.remove(c.where("id % 70 = 9").select("file_path"))
    changed = c.where("id % 10 = 3").withColumn("content", F.concat(F.lit("replaced words "), F.col("id").cast("string")))
    other = KeywordIndex(spark, root + "-other", buckets=8).add(changed)
    index.merge(other).compact()
    found = KeywordIndex(spark, root).postings()  # as loaded by another reader
    return found.groupBy("token").agg(F.count("*").alias("df"), F.sum("id").alias("id_sum"), F.min("id").alias("first_id"))


@query(f"WITH {CHUNKS}, {tokens_sql('tok', 'chunks', 'id', 'content')} SELECT c.id, lower(c.file_path) AS file, coalesce(n, 0) AS dl FROM chunks c LEFT JOIN (SELECT key, count(*) AS n FROM tok GROUP BY key) t ON t.key = c.id WHERE c.id % 7 = 3 OR lower(c.file_path) NOT IN (SELECT lower(file_path) FROM chunks WHERE id % 7 = 3)")
def m24_keyword_rehydration(spark, sf_dir):
    """An index of every seventh chunk gets the chunks of the files that it lacks."""
    c = chunks(spark, sf_dir)
    index = KeywordIndex(spark, f"{shared.folder(spark)}/drift-{uuid.uuid4().hex[:8]}", buckets=4).add(c.where("id % 7 = 3"))
    lack = inc.missing(c, index.chunks().select(F.col("path").alias("file_path")), "file_path")
    index.add(c.join(lack, "file_path", "left_semi"))
    return index.chunks().select("id", F.lower("path").alias("file"), F.col("dl").cast("long").alias("dl"))
