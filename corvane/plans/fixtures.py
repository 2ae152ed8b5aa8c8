"""The test tables as chunks, labels, events and pages, on the Spark side and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunks of files in a made-up tree."""
    d = F.col("doc_id")
    slot = (d % 7).cast("string")
    path = (
        F.when(d % 5 == 0, F.concat(F.lit("src/"), "source", F.lit("/Module"), slot, F.lit(".ts")))
        .when(d % 5 == 1, F.concat(F.lit("docs/"), "source", F.lit("/guide-"), slot, F.lit(".md")))
        .when(d % 5 == 2, F.concat(F.lit("src/__tests__/"), "source", F.lit("/m"), slot, F.lit(".test.ts")))
        .when(d % 5 == 3, F.concat(F.lit("lib/"), "source", F.lit("/util_"), slot, F.lit(".py")))
        .otherwise(F.concat(F.lit("config/"), "source", F.lit(".config.json")))
    )
    start = (F.floor(d / 20) * 20 + 1).cast("int")
    return read(spark, sf_dir, "documents").select(
        d.alias("id"), F.col("text").alias("content"), F.col("lang").alias("language"), F.col("source").alias("file"),
        path.alias("file_path"), start.alias("start_line"), (start + (d * 7) % 23).cast("int").alias("end_line"),
        F.when(d % 11 == 0, "quirk").otherwise("").alias("kind"),
    )


CHUNKS = """
chunks AS (
    SELECT doc_id AS id, text AS content, lang AS language, source AS file,
           CASE doc_id % 5
               WHEN 0 THEN 'src/' || source || '/Module' || (doc_id % 7) || '.ts'
               WHEN 1 THEN 'docs/' || source || '/guide-' || (doc_id % 7) || '.md'
               WHEN 2 THEN 'src/__tests__/' || source || '/m' || (doc_id % 7) || '.test.ts'
               WHEN 3 THEN 'lib/' || source || '/util_' || (doc_id % 7) || '.py'
               ELSE 'config/' || source || '.config.json' END AS file_path,
           CAST((doc_id // 20) * 20 + 1 AS INTEGER) AS start_line,
           CAST((doc_id // 20) * 20 + 1 + (doc_id * 7) % 23 AS INTEGER) AS end_line,
           CASE WHEN doc_id % 11 = 0 THEN 'quirk' ELSE '' END AS kind
    FROM documents
)"""


def stem_sql(w: str) -> str:
    """The stemmer as a SQL expression over a word."""
    return f"""CASE WHEN length({w}) < 6 THEN {w}
        WHEN {w} LIKE '%ing' THEN left({w}, length({w}) - 3)
        WHEN {w} LIKE '%ed' OR {w} LIKE '%ly' THEN left({w}, length({w}) - 2)
        WHEN regexp_matches({w}, '[sxzh]es$') THEN left({w}, length({w}) - 2)
        WHEN {w} LIKE '%er' OR {w} LIKE '%en' THEN left({w}, length({w}) - 2)
        WHEN {w} LIKE '%s' AND {w} NOT LIKE '%ss' THEN left({w}, length({w}) - 1)
        WHEN {w} LIKE '%e' THEN left({w}, length({w}) - 1) ELSE {w} END"""


def tokens_sql(name: str, table: str, key: str, text: str) -> str:
    """CTEs ending in ``name`` (key, token): the distinct tokens of each row."""
    return f"""
{name}_w AS (SELECT {key} AS key, unnest(string_split_regex({text}, '[^a-zA-Z0-9_]+')) AS w FROM {table}),
{name}_p AS (
    SELECT key, lower(p) AS p FROM (
        SELECT key, w AS p FROM {name}_w WHERE length(w) >= 2
        UNION SELECT key, unnest(string_split(regexp_replace(w, '([A-Z])', chr(1) || '\\1', 'g'), chr(1))) FROM {name}_w WHERE length(w) >= 2
        UNION SELECT key, unnest(string_split(w, '_')) FROM {name}_w WHERE length(w) >= 2
    ) WHERE length(p) >= 2
),
{name} AS (SELECT key, p AS token FROM {name}_p UNION SELECT key, {stem_sql("p")} FROM {name}_p)"""


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark passage as a query, with the vector of the same number where there is one."""
    b = read(spark, sf_dir, "benchmark")
    v = read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("qvec"))
    return b.join(v, b["item_id"] == v["vec_id"], "left").select(F.col("item_id").alias("qid"), F.col("text").alias("query"), "qvec")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set of vector searches: every vector whose id is divisible by 100."""
    return read(spark, sf_dir, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
