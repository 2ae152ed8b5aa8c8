"""A corpus pipeline: quality, perplexity, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
stage's result as Parquet in the shared scratch folder and rereads it as the next
one's documents. All but the last return the columns of documents.

Stages decide by row, not by id, so rows with a null id and rows that repeat an id
with another text pass like any others, and rows of equal text are one group whose
first, by id, stays. Suffix dedup works by id: rows with a null id and ids of several
texts keep theirs. Null texts count as empty, fail the quality rules and go. Columns
besides those of documents are left out, whatever their names. An empty table stays
empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import ordermin, packing, perplexity, quality, scratch, suffixdedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []


def _tidy(stage: Stage) -> Stage:
    """The stage on the columns of documents. Before it begins, the scratch tables of stages before it go that ``docs`` does not read."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        gone = scratch.unread(docs, _left)
        scratch.delete(spark, gone)
        _left[:] = [t for t in _left if t not in gone]
        scratch.free(spark)
        before = set(scratch.made())
        out = stage(spark, docs.select(COLUMNS), sf_dir)
        _left.extend(t for t in scratch.made() if t not in before)
        return out

    return run


@_tidy
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention model scores 0.3 or more; a null id is scored alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.filtered(docs, labels)


@_tidy
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their language's perplexity band."""
    return perplexity.filtered(docs)


@_tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: that of smallest id, and of those the first; null ids come last."""
    rows = scratch.table(docs.select("*", F.monotonically_increasing_id().alias("row")), "rows")
    classes = ordermin.near_duplicates(rows, id_col="row").select(F.col("doc_id").alias("row"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    kept = rows.select("row", "doc_id").join(classes, "row").groupBy("component_id").agg(first.alias("f"))
    return rows.join(kept.select(F.col("f.row").alias("row")), "row", "left_semi").select(COLUMNS)


@_tidy
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; documents of which nothing is left go."""
    cut = suffixdedup.clean(docs, row=True).where("kept_text <> ''")
    cut = cut.select("row.doc_id", F.col("kept_text").alias("text"), "row.lang", "row.source", F.length("kept_text").cast("long").alias("n_chars"))
    return cut.select(COLUMNS)


@_tidy
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence of at most 4096 tokens."""
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", suffix_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier and the language model are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, from the table of documents; of the tables in between none stays."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        found = stage(spark, docs, sf_dir)
        before = set(scratch.made())
        docs = scratch.table(found, name)
        scratch.delete(spark, last)
        last = [t for t in scratch.made() if t not in before]
    scratch.delete(spark, _left)
    _left.clear()
    return docs
