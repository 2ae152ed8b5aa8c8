"""Ranking metrics, run comparison, calibration and tuning statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at_quantile(values: Column, q: float, ceil: bool = False) -> Column:
    """An element of the sorted array: at floor(q (n - 1)), or ceil(q n) - 1; 0 for none."""
    n = F.size(values)
    i = F.ceil(F.lit(q) * n) - 1 if ceil else F.floor(F.lit(q) * (n - 1))
    place = F.greatest(F.lit(0), F.least(i, n - 1)).cast("int") + 1
    return F.when(n == 0, F.lit(0.0)).otherwise(F.try_element_at(F.array_sort(values), place).cast("double"))


def median(values: Column) -> Column:
    s, n = F.array_sort(values), F.size(values)
    at = lambda i: F.try_element_at(s, i.cast("int")).cast("double")
    mid = F.floor(n / 2)
    return F.when(n == 0, F.lit(0.0)).when(n % 2 == 1, at(mid + 1)).otherwise((at(F.greatest(mid, F.lit(1))) + at(mid + 1)) / 2)


def golden_metrics(labels: DataFrame, rankings: DataFrame) -> DataFrame:
    """Per label: first hit, Hit@1/3/5/10, P@5, R@10, reciprocal rank and nDCG@10 over files.

    labels: (label_id, file), a row for each expected file. rankings: (label_id,
    file, rank) from 1, files may repeat.
    """
    first = rankings.groupBy("label_id", "file").agg(F.min("rank").alias("rank"))
    hits = labels.join(first, ["label_id", "file"], "left")
    within = lambda k: F.count_if(F.col("rank") <= k)
    gain = F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    m = hits.groupBy("label_id").agg(
        F.min("rank").alias("first_hit"), *[within(k).alias(f"w{k}") for k in (1, 3, 5, 10)], F.count("*").alias("expected"), gain.alias("dcg")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("expected", F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    hit = [F.when(F.col(f"w{k}") > 0, 1).otherwise(0).alias(f"hit{k}") for k in (1, 3, 5, 10)]
    return m.select(
        "label_id", "first_hit", *hit, (F.col("w5") / 5).alias("precision5"), (F.col("w10") / F.col("expected")).alias("recall10"),
        F.coalesce(1 / F.col("first_hit"), F.lit(0.0)).alias("rr"), (F.col("dcg") / ideal).alias("ndcg10"),
    )


def golden_summary(metrics: DataFrame) -> DataFrame:
    names = ["hit1", "hit3", "hit5", "hit10", "precision5", "recall10", "rr", "ndcg10"]
    return metrics.agg(*[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias("mrr" if c == "rr" else c) for c in names])


def gate(summary: DataFrame, floors: dict[str, float]) -> DataFrame:
    """(metric, value, floor, passed); a metric passes at its floor less 1e-9."""
    rows = [F.struct(F.lit(k).alias("metric"), F.col(k).alias("value"), F.lit(v).alias("floor")) for k, v in floors.items()]
    out = summary.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.withColumn("passed", F.col("value") >= F.col("floor") - 1e-9)


def kendall(pairs: DataFrame, by: str) -> DataFrame:
    """(C - D) / (C + D) of two rankings (by, item, a, b) without correction for ties; 1 without pairs."""
    r = pairs.select(by, "item", "a", "b")
    s = r.select(F.col(by).alias("__by"), F.col("item").alias("i2"), F.col("a").alias("a2"), F.col("b").alias("b2"))
    sign = F.signum((F.col("a") - F.col("a2")) * (F.col("b") - F.col("b2")))
    joined = r.join(s, (F.col(by) == F.col("__by")) & (F.col("item") < F.col("i2")), "left")
    total = F.sum(F.abs(sign))
    return joined.groupBy(by).agg(F.when(total > 0, F.sum(sign) / total).otherwise(1.0).alias("tau"))


def sign_test(wins: Column, losses: Column) -> Column:
    """Two-sided exact binomial tail, capped at 1; 1 without discordant pairs."""
    n, k = (wins + losses).cast("int"), F.greatest(wins, losses).cast("int")
    choose = lambda i: F.exp(_log_factorial(n) - _log_factorial(i) - _log_factorial(n - i))
    tail = F.aggregate(F.sequence(k, n), F.lit(0.0), lambda s, i: s + choose(i))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail / F.pow(F.lit(2.0), n)))


def _log_factorial(n: Column) -> Column:
    return F.when(n <= 1, 0.0).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + F.log(i.cast("double"))))


def calibration(items: DataFrame, bins: int = 10) -> DataFrame:
    """One row: n, answered, accuracy, ece, brier and mean confidence of (correct, confidence, answered)."""
    a = items.where("answered")
    hit = F.when(F.col("correct"), 1.0).otherwise(0.0)
    at = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1))
    per = a.groupBy(at.alias("bin")).agg(F.count("*").alias("c"), F.abs(F.avg(hit) - F.avg("confidence")).alias("gap"))
    ece = per.agg((F.sum(F.col("c") * F.col("gap")) / F.greatest(F.sum("c"), F.lit(1))).alias("ece"))
    whole = items.agg(F.count("*").alias("n"), F.count_if("answered").alias("answered"), F.avg(hit).alias("accuracy"))
    of = a.agg(F.avg((F.col("confidence") - hit) ** 2).alias("brier"), F.avg("confidence").alias("mean_confidence"))
    r = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), 6).alias(c)
    return whole.crossJoin(ece).crossJoin(of).select("n", "answered", *map(r, ("accuracy", "ece", "brier", "mean_confidence")))  # one row each


def bootstrap(pairs: DataFrame, draws: int = 2000, seed: int = 1) -> DataFrame:
    """Mean difference of (label_id, a, b), its 95 % interval and the share of draws above 0.

    A label's weight in a draw is Poisson(1) by a hash, so draws need no ordered
    sampling and the result is the same for any partitioning.
    """
    d = pairs.select("label_id", (F.col("b") - F.col("a")).alias("d"))
    u = (F.pmod(F.xxhash64("label_id", "draw", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    weight, cdf, p = F.lit(0), 0.0, 0.36787944117144233
    for k in range(1, 9):
        cdf += p
        weight = weight + F.when(u > cdf, 1).otherwise(0)
        p /= k
    drawn = d.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", weight)
    means = drawn.groupBy("draw").agg((F.sum(F.col("w") * F.col("d")) / F.greatest(F.sum("w"), F.lit(1))).alias("m"))
    m = means.agg(F.collect_list("m").alias("m"), F.avg(F.when(F.col("m") > 0, 1.0).otherwise(0.0)).alias("p_better"))  # a number a draw
    return d.agg(F.avg("d").alias("delta")).crossJoin(m).select("delta", at_quantile(F.col("m"), 0.025).alias("low"), at_quantile(F.col("m"), 0.975).alias("high"), "p_better")


def candidate_grid(spark, axes: dict[str, list[float]], most: int = 64) -> DataFrame:
    """Distinct combinations of the axes' values in order, ``most`` at most."""
    out = spark.range(1).drop("id")
    for name, values in axes.items():
        out = out.crossJoin(spark.createDataFrame([(v,) for v in values], [name]))  # literals
    return out.distinct().orderBy(*axes).limit(most)


def best_candidate(candidates: DataFrame, by: list[str], ties: list[str]) -> DataFrame:
    return candidates.orderBy(*[F.desc(c) for c in by], *ties).limit(1)


def outliers(points: DataFrame, cluster: str, distance: str, times: float = 2.0) -> DataFrame:
    w = Window.partitionBy(cluster)
    return points.withColumn("outlier", F.col(distance) > times * F.stddev_pop(distance).over(w))
