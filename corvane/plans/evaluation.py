"""Evaluation queries over made-up rankings of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import evaluation as ev
from corvane.plans.fixtures import read
from corvane.plans.registry import query

_RANK = """lab AS (SELECT item_id AS label_id, 'src' || ((item_id * k) % 20) AS file FROM benchmark, (VALUES (1), (3), (7)) v(k)),
l AS (SELECT DISTINCT * FROM lab),
r AS (SELECT item_id AS label_id, 'src' || ((item_id * 5 + rank * 3) % 20) AS file, rank FROM benchmark, range(1, 13) t(rank)),
f AS (SELECT label_id, file, min(rank) AS rank FROM r GROUP BY ALL),
h AS (SELECT l.label_id, l.file, f.rank FROM l LEFT JOIN f USING (label_id, file)),
m AS (SELECT label_id, min(rank) AS first_hit, (count(*) FILTER (rank <= 1) > 0)::INTEGER AS hit1, (count(*) FILTER (rank <= 3) > 0)::INTEGER AS hit3,
    (count(*) FILTER (rank <= 5) > 0)::INTEGER AS hit5, (count(*) FILTER (rank <= 10) > 0)::INTEGER AS hit10, count(*) FILTER (rank <= 5) / 5 AS precision5,
    count(*) FILTER (rank <= 10) / count(*) AS recall10, coalesce(1 / min(rank), 0) AS rr,
    coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 10), 0) / list_sum(list_transform(range(1, least(count(*), 10) + 1), lambda i: 1 / log2(i + 1))) AS ndcg10
    FROM h GROUP BY label_id)"""


def _rankings(spark, sf_dir):
    b = read(spark, sf_dir, "benchmark")
    i = F.col("item_id")
    file = lambda x: F.concat(F.lit("src"), (x % 20).cast("string"))
    labels = b.select(i.alias("label_id"), F.explode(F.array(*[file(i * k) for k in (1, 3, 7)])).alias("file")).distinct()
    ranks = b.select(i.alias("label_id"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("rank"))
    return labels, ranks.select("label_id", file(F.col("label_id") * 5 + F.col("rank") * 3).alias("file"), "rank")


@query(f"WITH {_RANK} SELECT label_id, first_hit, hit1, hit3, hit5, hit10, round(precision5, 6) AS precision5, round(recall10, 6) AS recall10, round(rr, 6) AS rr, round(ndcg10, 6) AS ndcg10 FROM m")
def a12_golden_metrics(spark, sf_dir):
    m = ev.golden_metrics(*_rankings(spark, sf_dir)).withColumn("first_hit", F.col("first_hit").cast("long"))
    return m.select("label_id", "first_hit", "hit1", "hit3", "hit5", "hit10", *[F.round(c, 6).alias(c) for c in ("precision5", "recall10", "rr", "ndcg10")])


_SUM = "SELECT round(avg(hit1), 6) AS hit1, round(avg(hit3), 6) AS hit3, round(avg(hit5), 6) AS hit5, round(avg(hit10), 6) AS hit10, round(avg(precision5), 6) AS precision5, round(avg(recall10), 6) AS recall10, round(avg(rr), 6) AS mrr, round(avg(ndcg10), 6) AS ndcg10 FROM m"


@query(f"WITH {_RANK} {_SUM}")
def a13_golden_summary(spark, sf_dir):
    return ev.golden_summary(ev.golden_metrics(*_rankings(spark, sf_dir)))


@query(f"WITH {_RANK}, s AS ({_SUM}) SELECT metric, value, floor, value >= floor - 1e-9 AS passed FROM (SELECT 'hit5' AS metric, hit5 AS value, CAST(0.35 AS DOUBLE) AS floor FROM s UNION ALL SELECT 'mrr', mrr, 0.25 FROM s UNION ALL SELECT 'ndcg10', ndcg10, 0.32 FROM s)")
def a14_gate(spark, sf_dir):
    return ev.gate(ev.golden_summary(ev.golden_metrics(*_rankings(spark, sf_dir))), {"hit5": 0.35, "mrr": 0.25, "ndcg10": 0.32})


@query(
    """WITH v AS (SELECT event_type, list_sort(list(value)) AS s, count(*) AS n, avg(value) AS a, stddev_samp(value) AS sd FROM events GROUP BY 1)
    SELECT event_type, round(a, 6) AS avg, round(s[floor(0.5 * (n - 1))::INT + 1], 6) AS p50, round(s[ceil(0.95 * n)::INT], 6) AS p95,
    round((s[((n + 1) // 2)::INT] + s[(n // 2 + 1)::INT]) / 2, 6) AS median, round(coalesce(sd, 0), 6) AS stdev FROM v"""
)
def a15_run_statistics(spark, sf_dir):
    at = lambda p: F.expr(f"percentile_disc({p}) within group (order by value)")  # noqa: E731  keeps counts of distinct values, not the values
    r = lambda c, n: F.round(c, 6).alias(n)
    spread = F.coalesce(F.stddev_samp("value"), F.lit(0.0))
    return read(spark, sf_dir, "events").groupBy("event_type").agg(
        r(F.avg("value"), "avg"), r(at(0.5), "p50"), r(at(0.95), "p95"), r(F.percentile("value", F.lit(0.5)), "median"), r(spread, "stdev")
    )


_PAIRS = "p AS (SELECT item_id % 8 AS q, item_id AS item, (item_id * 13) % 31 AS a, (item_id * 17) % 29 AS b FROM benchmark)"


def _pairs(spark, sf_dir):
    i = F.col("item_id")
    return read(spark, sf_dir, "benchmark").select((i % 8).alias("q"), i.alias("item"), ((i * 13) % 31).alias("a"), ((i * 17) % 29).alias("b"))


@query(f"WITH {_PAIRS}, s AS (SELECT x.q, sign((x.a - y.a) * (x.b - y.b)) AS s FROM p x JOIN p y ON x.q = y.q AND x.item < y.item) SELECT q, round(CASE WHEN sum(abs(s)) > 0 THEN sum(s) / sum(abs(s)) ELSE 1 END, 6) AS tau FROM s GROUP BY q")
def a16_rank_agreement(spark, sf_dir):
    return ev.kendall(_pairs(spark, sf_dir), "q").select("q", F.round("tau", 6).alias("tau"))


@query(f"WITH {_PAIRS}, w AS (SELECT q, count(*) FILTER (a > b) AS wins, count(*) FILTER (a < b) AS losses FROM p GROUP BY q) SELECT q, wins, losses, round(CASE WHEN wins + losses = 0 THEN 1 ELSE least(1, 2 * (SELECT sum(exp(lgamma(wins + losses + 1) - lgamma(i + 1) - lgamma(wins + losses - i + 1))) FROM range(0, 200) t(i) WHERE i >= greatest(wins, losses) AND i <= wins + losses) / pow(2, wins + losses)) END, 6) AS p FROM w")
def a18_sign_test(spark, sf_dir):
    w = _pairs(spark, sf_dir).groupBy("q").agg(F.count_if(F.col("a") > F.col("b")).alias("wins"), F.count_if(F.col("a") < F.col("b")).alias("losses"))
    return w.withColumn("p", F.round(ev.sign_test(F.col("wins"), F.col("losses")), 6))


@query()
def a17_paired_bootstrap(spark, sf_dir):
    return ev.bootstrap(_pairs(spark, sf_dir).select(F.col("item").alias("label_id"), F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b")))


@query(
    """WITH i AS (SELECT quality = 1 AS correct, (doc_id * 37 % 101) / 100.0 AS confidence, doc_id % 9 <> 0 AS answered FROM labels), a AS (SELECT *, correct::INT AS h FROM i WHERE answered),
    b AS (SELECT count(*) AS c, abs(avg(h) - avg(confidence)) AS gap FROM a GROUP BY least(floor(confidence * 10 + 1e-9), 9))
    SELECT (SELECT count(*) FROM i) AS n, (SELECT count(*) FROM a) AS answered, (SELECT round(avg(correct::INT), 6) FROM i) AS accuracy,
    (SELECT round(sum(c * gap) / sum(c), 6) FROM b) AS ece, (SELECT round(avg(pow(confidence - h, 2)), 6) FROM a) AS brier, (SELECT round(avg(confidence), 6) FROM a) AS mean_confidence"""
)
def a20_calibration(spark, sf_dir):
    d = F.col("doc_id")
    items = read(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("correct"), ((d * 37 % 101) / F.lit(100.0)).alias("confidence"), (d % 9 != 0).alias("answered"))
    return ev.calibration(items)


@query("SELECT a AS kw, b AS min_score FROM (SELECT DISTINCT a, b FROM (VALUES (CAST(0.0 AS DOUBLE)), (0.2), (0.4), (0.4)) x(a), (VALUES (CAST(0.1 AS DOUBLE)), (0.35)) y(b)) ORDER BY a, b LIMIT 64")
def u8_candidate_grid(spark, sf_dir):
    return ev.candidate_grid(spark, {"kw": [0.0, 0.2, 0.4, 0.4], "min_score": [0.1, 0.35]})


@query("SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size DESC, p_retailprice DESC, p_partkey LIMIT 1")
def t10_best_candidate(spark, sf_dir):
    return ev.best_candidate(read(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], ["p_partkey"])
