"""Projection and cluster queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import evaluation as ev
from corvane.operators import projection as pj
from corvane.plans.fixtures import read
from corvane.plans.registry import query


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


@query()
def a24_pca(spark, sf_dir):
    return pj.pca(_vectors(spark, sf_dir), 2)


@query()
def a25_kmeans(spark, sf_dir):
    return pj.clusters(pj.pca(_vectors(spark, sf_dir), 2), ["x0", "x1"]).select("id", "cluster", "distance")


@query("SELECT c_custkey, c_acctbal > 2 * stddev_pop(c_acctbal) OVER (PARTITION BY c_mktsegment) AS outlier FROM customer")
def a26_outliers(spark, sf_dir):
    return ev.outliers(read(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal").select("c_custkey", "outlier")
