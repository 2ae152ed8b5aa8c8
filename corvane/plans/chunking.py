"""Chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import chunking as ck
from corvane.plans.fixtures import read
from corvane.plans.registry import query


def _files(spark, sf_dir):
    return read(spark, sf_dir, "documents").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), "text")


_LINES = "ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)"


@query(
    rf"""WITH {_LINES}, c AS (SELECT 'f' || doc_id AS path, (pos - 1) // 3 * 3 + 1 AS start_line, max(pos) AS end_line, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\s+|\s+$', '', 'g') AS content FROM ln GROUP BY doc_id, (pos - 1) // 3)
    SELECT path, start_line, end_line, sha256(content) AS content_sha FROM c WHERE content <> ''"""
)
def w7_c32_line_windows(spark, sf_dir):
    w = ck.line_windows(_files(spark, sf_dir), 3)
    return w.select("path", F.col("start_line").cast("long"), F.col("end_line").cast("long"), F.sha2("content", 256).alias("content_sha"))


@query("WITH r AS (SELECT lang, doc_id, text, lag(text) OVER (PARTITION BY lang ORDER BY doc_id) AS b FROM documents) SELECT doc_id, sha256(CASE WHEN b IS NULL THEN text ELSE array_to_string(list_slice(string_split(b, chr(10)), greatest(len(string_split(b, chr(10))) - 1, 1), len(string_split(b, chr(10)))), chr(10)) || chr(10) || text END) AS content_sha FROM r")
def w6_overlap(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("lang", "doc_id", F.col("text").alias("content"))
    return ck.with_overlap(d, 2, "lang", "doc_id").select("doc_id", F.sha2("content", 256).alias("content_sha"))


@query(rf"WITH {_LINES} SELECT 'f' || doc_id AS path, pos AS line FROM ln WHERE regexp_matches(line, '\bthat\b') AND pos <> 2")
def c36_find_usages(spark, sf_dir):
    return ck.find_usages(_files(spark, sf_dir), "that", F.lit(2)).select("path", F.col("line").cast("long").alias("line"))


@query(rf"WITH {_LINES}, h AS (SELECT doc_id, pos, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS nx FROM ln WHERE regexp_matches(line, '^The\s')), n AS (SELECT doc_id, max(pos) AS n FROM ln GROUP BY 1) SELECT 'f' || doc_id AS path, pos AS start_line, coalesce(nx - 1, n) AS end_line FROM h JOIN n USING (doc_id)")
def w10_sections(spark, sf_dir):
    return ck.sections(_files(spark, sf_dir), r"^The\s").select("path", F.col("start_line").cast("long"), F.col("end_line").cast("long"))


@query()
def c0_c34_chunk_files(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("text"))
    d = read(spark, sf_dir, "documents").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"), "text")
    return ck.chunk_files(p.unionByName(d))


_OUTLINES = """o AS (
    SELECT 'f' || doc_id || '.txt' AS path, 'file' AS kind, (length(text) - length(replace(text, chr(10), '')) + 1) || ' lines' AS name, 1 AS start_line,
           length(text) - length(replace(text, chr(10), '')) + 1 AS end_line FROM documents WHERE doc_id % 2 = 1
    UNION ALL SELECT path, 'yaml', name, min(pos), min(pos) FROM (
        SELECT 'f' || doc_id || '.yaml' AS path, pos, regexp_extract(line, '^([A-Za-z0-9_]+):', 1) AS name FROM (
            SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line FROM (
                SELECT doc_id, string_split('lang: ' || lang || chr(10) || 'source: ' || chr(10) || 'lang: x' || chr(10) || text, chr(10)) AS l FROM documents WHERE doc_id % 2 = 0)))
    WHERE name <> '' GROUP BY path, name)"""


def _outlines(spark, sf_dir):
    """Every second document as a settings file, the others as plain text."""
    d = read(spark, sf_dir, "documents")
    even = F.col("doc_id") % 2 == 0
    path = F.concat(F.lit("f"), F.col("doc_id").cast("string"), F.when(even, ".yaml").otherwise(".txt"))
    text = F.when(even, F.concat(F.lit("lang: "), "lang", F.lit("\nsource: \nlang: x\n"), "text")).otherwise(F.col("text"))
    return ck.outlines(d.select(path.alias("path"), text.alias("text")))


@query(f"WITH {_OUTLINES} SELECT path, kind, name, start_line, end_line FROM o")
def c35_outline(spark, sf_dir):
    return _outlines(spark, sf_dir).select("path", "kind", "name", F.col("start_line").cast("long"), F.col("end_line").cast("long"))


@query(f"WITH {_OUTLINES} SELECT kind, count(*) AS declarations FROM o GROUP BY kind")
def a23_outline_counts(spark, sf_dir):
    return _outlines(spark, sf_dir).groupBy(F.regexp_replace("kind", "_(definition|declaration)$", "").alias("kind")).agg(F.count("*").alias("declarations"))
