"""The pipeline's stages one by one, each against its operator's verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import ordermin, perplexity, quality, suffixdedup

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_their_operators_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    stage = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    a = stage[names[0]](spark, docs, SF)
    assert ids(a) == ids(quality.score(docs, labels).where("predicted = 1"))
    b = stage[names[1]](spark, a, SF)
    assert ids(b) == ids(perplexity.judge(a).where("kept"))
    c = stage[names[2]](spark, b, SF)
    assert ids(c) == ids(ordermin.near_duplicates(b).where("kept"))
    d = stage[names[3]](spark, c, SF)
    cut = {r["doc_id"]: r["kept_text"] for r in suffixdedup.clean(c).collect()}
    assert {r["doc_id"]: r["text"] for r in d.collect()} == {k: v for k, v in cut.items() if v}
    assert d.columns == docs.columns
    e = stage[names[4]](spark, d, SF)
    assert set(ids(e)) == set(ids(d))


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, SF)
        assert docs.count() == 0
        docs = spark.createDataFrame([], spark.read.parquet(f"{SF}/documents.parquet").schema)


def test_stages_keep_rows_apart(spark):
    """Null ids, repeated ids and clashing columns: every row has its own verdict and comes out once at most."""
    some = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 400").orderBy("doc_id").limit(40).collect()
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in some]
    same = [(rows[0][0], rows[1][1].upper() + " and more of it here", "en", "s", 1), rows[2], rows[2], (None, rows[3][1] + " tail", "en", "s", 1), (7, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows + same, spark.read.parquet(f"{SF}/documents.parquet").schema)
    for name in ("kept_id", "cut_id", "row", "kept", "score", "doc_key", "text_", "component_id", "lead"):
        docs = docs.withColumn(name, docs["doc_id"])
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, SF)
        assert got.columns == corpus_pipeline.COLUMNS, name
        assert got.count() <= docs.count(), name
    out = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    classes = {r["doc_id"]: r["component_id"] for r in ordermin.near_duplicates(spark.createDataFrame([(i, r[1]) for i, r in enumerate(rows + same)], "doc_id long, text string")).collect()}
    assert len(out) == len(set(classes.values()))
    cut = corpus_pipeline.suffix_dedup(spark, docs, SF)
    assert cut.where("doc_id is null").count() == 1
    judged = perplexity.judge(docs.withColumn("doc_id", F.monotonically_increasing_id())).where("kept").count()
    assert corpus_pipeline.quality_rules(spark, docs, SF).count() == judged
    twice = docs.unionByName(docs).where("doc_id is not null")
    for name, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, twice, SF).count() <= twice.count(), name
    assert corpus_pipeline.near_duplicates(spark, twice, SF).count() == corpus_pipeline.near_duplicates(spark, docs.where("doc_id is not null"), SF).count()
