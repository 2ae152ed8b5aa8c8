"""Projections and clusters of vectors."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pca(vectors: DataFrame, k: int = 2, id_col: str = "id", vector: str = "embedding") -> DataFrame:
    """(id, x0 ... ): principal components of centred vectors, each scaled to 0..1; for three axes by one common range."""
    v = vectors.where(F.col(vector).isNotNull()).select(F.col(id_col).alias("id"), array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("v"))
    centred = StandardScaler(inputCol="v", outputCol="c", withMean=True, withStd=False).fit(v).transform(v)
    p = PCA(k=k, inputCol="c", outputCol="p").fit(centred).transform(centred)
    axes = [f"x{i}" for i in range(k)]
    p = p.select("id", *[vector_to_array("p")[i].alias(a) for i, a in enumerate(axes)])
    lim = p.agg(*[F.min(a).alias(f"lo_{a}") for a in axes], *[F.max(a).alias(f"hi_{a}") for a in axes])
    width = [F.col(f"hi_{a}") - F.col(f"lo_{a}") for a in axes]
    if k > 2:
        width = [F.greatest(*width)] * k
    scaled = [F.when(w > 0, (F.col(a) - F.col(f"lo_{a}")) / w).otherwise(0.5).alias(a) for a, w in zip(axes, width, strict=True)]
    return p.crossJoin(F.broadcast(lim)).select("id", *scaled)  # lim is one row


def clusters(points: DataFrame, axes: list[str], k: int = 8, iterations: int = 20, seed: int = 1) -> DataFrame:
    """Points with their cluster and the distance to its centre."""
    v = points.withColumn("__v", array_to_vector(F.array(*axes)))
    model = KMeans(k=k, maxIter=iterations, seed=seed, featuresCol="__v", predictionCol="cluster").fit(v)
    centres = F.array(*[F.array(*map(F.lit, map(float, c))) for c in model.clusterCenters()])
    centre = F.element_at(centres, F.col("cluster") + 1)
    gap = sum(((F.col(a) - F.element_at(centre, i + 1)) ** 2 for i, a in enumerate(axes)), F.lit(0.0))
    return model.transform(v).withColumn("distance", F.sqrt(gap)).drop("__v")
