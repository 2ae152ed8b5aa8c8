"""Link-graph queries over pages, whose links are href attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import links as lk
from corvane.plans.fixtures import read
from corvane.plans.registry import query

_G = r"""pg AS (SELECT 'p/' || page_id AS id, page_id, html FROM pages), hr AS (SELECT DISTINCT id AS src, 'P/' || (unnest([page_id * 3 + 1, page_id * 7 % 90, page_id + length(html) % 5]) ) || '.md' AS raw FROM pg),
rs AS (SELECT src, raw, (SELECT max(id) FROM pg WHERE id = lower(regexp_replace(raw, '[.]md$', ''))) AS dst FROM hr), ed AS (SELECT DISTINCT src, dst FROM rs WHERE dst IS NOT NULL AND src <> dst)"""


def _graph(spark, sf_dir):
    i = F.col("page_id")
    pages = read(spark, sf_dir, "pages").select(F.concat(F.lit("p/"), i.cast("string")).alias("id"), i, "html")
    to = F.explode(F.array(i * 3 + 1, i * 7 % 90, i + F.length("html") % 5))
    raw = pages.select(F.col("id").alias("src"), to.alias("n")).select("src", F.concat(F.lit("P/"), F.col("n").cast("string"), F.lit(".md")).alias("raw")).distinct()
    return pages.select("id"), lk.resolve(pages.select("id"), raw)


@query(f"WITH {_G} SELECT src, raw, dst FROM rs")
def j12_g2_link_resolution(spark, sf_dir):
    return _graph(spark, sf_dir)[1]


@query(f"WITH {_G} SELECT dst AS id, count(*) AS inbound, list_sort(list(src))[1] AS first_source FROM ed GROUP BY dst")
def g3_backlinks(spark, sf_dir):
    return lk.edges(_graph(spark, sf_dir)[1]).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("inbound"), F.min("src").alias("first_source"))


@query(f"WITH {_G} SELECT id FROM pg WHERE id NOT IN (SELECT dst FROM ed)")
def g4_orphans(spark, sf_dir):
    pages, r = _graph(spark, sf_dir)
    return lk.orphans(pages, lk.edges(r))


@query(f"WITH RECURSIVE {_G}, b AS (SELECT src, dst FROM ed UNION SELECT dst, src FROM ed), w AS (SELECT 'p/1' AS id, 0 AS hop UNION SELECT dst, hop + 1 FROM w JOIN b ON id = src WHERE hop < 2) SELECT id, min(hop) AS hop FROM w GROUP BY id")
def g5_neighbourhood(spark, sf_dir):
    pages, r = _graph(spark, sf_dir)
    return lk.neighbourhood(lk.edges(r), pages.where("id = 'p/1'"), 2)


@query(f"WITH {_G}, d AS (SELECT id, count(dst) AS d FROM pg LEFT JOIN ed ON dst = id GROUP BY id) SELECT count(*) AS pages, sum(d)::BIGINT AS links, arg_min(id, (-d, id)) AS hub, list_sort(list(d))[(count(*) // 2 + 1)::INT] AS median_degree FROM d")
def a6_graph_overview(spark, sf_dir):
    pages, r = _graph(spark, sf_dir)
    return lk.overview(pages, lk.edges(r))


@query(f"WITH {_G} SELECT (SELECT count(*) FROM rs WHERE dst IS NULL) AS dangling, (SELECT count(*) FROM pg WHERE id NOT IN (SELECT dst FROM ed)) AS orphans")
def g8_lint_totals(spark, sf_dir):
    pages, r = _graph(spark, sf_dir)
    return r.where("dst is null").agg(F.count("*").alias("dangling")).crossJoin(lk.orphans(pages, lk.edges(r)).agg(F.count("*").alias("orphans")))  # one row each


@query(
    """WITH v AS (SELECT o_custkey AS id, min(o_orderdate) AS reviewed FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1), t AS (SELECT o_custkey AS id, max(o_orderdate) AS touched FROM orders WHERE o_orderkey % 3 = 1 GROUP BY 1)
    SELECT c_custkey AS id, CASE WHEN reviewed IS NULL THEN 'unreviewed' WHEN touched >= reviewed + INTERVAL 1 DAY THEN 'stale' WHEN epoch(TIMESTAMP '1998-01-01') - epoch(reviewed) > 7776000 THEN 'old' ELSE 'fresh' END AS state
    FROM customer LEFT JOIN v ON v.id = c_custkey LEFT JOIN t ON t.id = c_custkey"""
)
def g7_staleness(spark, sf_dir):
    o = read(spark, sf_dir, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))
    v = o.where("o_orderkey % 3 = 0").groupBy(F.col("o_custkey").alias("vid")).agg(F.min("at").alias("reviewed"))
    reviews = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).join(v, F.col("id") == F.col("vid"), "left").select("id", "reviewed")
    touches = o.where("o_orderkey % 3 = 1").select(F.col("o_custkey").alias("id"), F.col("at").alias("touched"))
    return lk.staleness(reviews, touches, F.lit("1998-01-01 00:00:00").cast("timestamp"))


@query(
    """SELECT page_id, array_to_string(CASE WHEN page_id % 3 = 0 THEN ['A/' || page_id] ELSE ['A/' || page_id, 'b' || page_id] END, '|') AS wiki,
           CASE WHEN page_id % 3 = 0 THEN '' ELSE 'c' || page_id || '.md' END AS pages FROM pages"""
)
def f20_link_extraction(spark, sf_dir):
    """Links beside code of every kind; the last fence of every third page is never closed."""
    n = F.col("page_id").cast("string")
    close = F.when(F.col("page_id") % 3 == 0, "").otherwise("```")
    parts = [F.lit("See [[A/"), n, F.lit("|x]] and `[[no]]`.\n~~~\n[[fenced]]\n~~~\n```ts\n[[fenced too]] [z](z.md)\n"), close, F.lit("\n[[ b"), n, F.lit(" #s|t]] [t](c"), n, F.lit(".md) [u](http://x/y.md)")]
    text = F.concat(*parts)
    return read(spark, sf_dir, "pages").select("page_id", F.array_join(lk.wiki_links(text), "|").alias("wiki"), F.array_join(lk.page_links(text), "|").alias("pages"))
