"""Approximate search, and the comparison of single signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import ann
from corvane.operators import retrieval as rt
from corvane.plans.fixtures import read, vector_queries
from corvane.plans.registry import query
from corvane.plans.retrieval import _legs


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


@query()
def t2_ivf_topk(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    index, centres = ann.build(v, ann.cells_for(v.count()))
    return ann.search(index, centres, vector_queries(spark, sf_dir), 10)


@query()
def t2_graph_topk(spark, sf_dir):
    links, unit = ann.graph(_vectors(spark, sf_dir))
    return ann.graph_search(links, unit, vector_queries(spark, sf_dir), 10)


@query()
def a19_signal_comparison(spark, sf_dir):
    """Results of each leg alone and fused that share the query's label, of ten a query."""
    near, words, roles = _legs(spark, sf_dir)
    label = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    legs = {"vector": near.where("rank < 10"), "keyword": words.where("rank < 10"), "fused": rt.ranked(rt.fuse(near, words, roles), 10)}
    out = None
    for name, leg in legs.items():
        a = leg.select("qid", "id").join(label.select(F.col("vec_id").alias("id"), F.col("label").alias("l")), "id")
        a = a.join(label.select(F.col("vec_id").alias("qid"), F.col("label").alias("q")), "qid")
        row = a.agg(F.lit(name).alias("signal"), F.count_if(F.col("l") == F.col("q")).alias("hits"), F.count("*").alias("results"))
        out = row if out is None else out.unionByName(row)
    return out
