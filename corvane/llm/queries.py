"""The registered queries of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corvane.llm import codec, impacts, lattice, media, merkle, ordermin, packing, perplexity, quality, sharding, suffixdedup, toxicity, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_kneser_ney_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judge(_read(spark, sf_dir, "documents"))


def op2_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_rank_array_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.digest(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_lattice_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op5_induced_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.digest(_read(spark, sf_dir, "documents"))


def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    placed = sharding.shard(_read(spark, sf_dir, "documents"), shards=24, seed=0)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op7_convolutional_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op8_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(_read(spark, sf_dir, "pages"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.near_duplicates(_read(spark, sf_dir, "documents"))


def op11_quantised_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impacts.search(impacts.build(_read(spark, sf_dir, "documents")), _read(spark, sf_dir, "benchmark"), 50)


def op12_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(_read(spark, sf_dir, "documents"))


def op13_radix_trie_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_kneser_ney_bands, op2_certified_packing, op3_rank_array_bpe, op4_lattice_near_duplicates, op5_induced_suffix_dedup, op6_feistel_shards, op7_convolutional_toxicity, op8_attention_quality, op9_seekable_warc, op10_order_minhash, op11_quantised_ranking, op12_lossless_webp, op13_radix_trie_manifest)
}

ORACLE_SQL: dict[str, str] = {
    "op9_seekable_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS body FROM pages
        ), d AS (
            SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS payload_digest FROM p
        ), f AS (
            SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1
        )
        SELECT d.page_id, d.payload_bytes, d.payload_digest,
               CASE WHEN f.first_id < d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first_id < d.page_id THEN f.first_id END AS refers_to
        FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= 100
    """,
    "op11_quantised_ranking": """
        WITH words AS (
            SELECT row_number() OVER () AS r, doc_id,
                   unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t
            FROM documents
        ), p AS (
            SELECT r, any_value(doc_id) AS doc_id, t, count(*) AS tf FROM words GROUP BY r, t
        ), s AS (
            SELECT CAST(count(DISTINCT r) AS BIGINT) AS n, CAST(sum(tf) AS BIGINT) AS l FROM p
        ), m AS (
            SELECT r, 50 + (50 * CAST(sum(tf) AS BIGINT) * any_value(s.n)) // any_value(s.l) AS m FROM p CROSS JOIN s GROUP BY r
        ), w AS (
            SELECT t, CAST(floor(1000 * ln((2 * any_value(s.n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p CROSS JOIN s GROUP BY t
        ), q AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t
            FROM benchmark
        ), f AS (
            SELECT q.item_id, p.r, any_value(p.doc_id) AS doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * m.m))) AS BIGINT) AS score
            FROM q JOIN p USING (t) JOIN w USING (t) JOIN m ON m.r = p.r GROUP BY q.item_id, p.r
        )
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
        FROM f WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
    """,
    "op13_radix_trie_manifest": """
        WITH RECURSIVE d AS (
            SELECT doc_id, lang, n_chars,
                   coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
                   coalesce(strlen(text) || ':' || text, '-') AS tail,
                   coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS n0,
                   coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS n1,
                   xor(4294967295, list_reduce(
                       [4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
                       lambda crc, byte: list_reduce([xor(crc, byte)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) AS crc
            FROM documents
        ), r AS (
            SELECT doc_id, lang, sha256(head || n0 || tail) AS leaf,
                   sha256(head || CASE WHEN crc % 7 = 0 THEN n1 ELSE n0 END || tail) AS given,
                   row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
            FROM d
        ), node AS (
            SELECT lang, 0 AS h, i, n, leaf AS x FROM r
            UNION ALL
            SELECT lang, h + 1, i // 2, (n + 1) // 2, sha256(string_agg(x, '' ORDER BY i)) FROM node WHERE n > 1 GROUP BY lang, h, i // 2, n
        ), sub AS (
            SELECT lang, h AS levels, x AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM node WHERE n = 1
        ), crown AS (
            SELECT 0 AS h, place AS i, n, subroot AS x FROM sub
            UNION ALL
            SELECT h + 1, i // 2, (n + 1) // 2, sha256(string_agg(x, '' ORDER BY i)) FROM crown WHERE n > 1 GROUP BY h, i // 2, n
        ), fold AS (
            SELECT lang, i, 0 AS h, given AS x, '' AS proof FROM r
            UNION ALL
            SELECT f.lang, f.i, f.h + 1,
                   sha256(CASE WHEN (CASE WHEN f.h < s.levels THEN f.i >> f.h ELSE s.place >> (f.h - s.levels) END) % 2 = 1
                          THEN coalesce(a.x, b.x, '') || f.x ELSE f.x || coalesce(a.x, b.x, '') END),
                   f.proof || coalesce(a.x, b.x, '')
            FROM fold f JOIN sub s ON f.lang IS NOT DISTINCT FROM s.lang
            LEFT JOIN node a ON f.h < s.levels AND a.lang IS NOT DISTINCT FROM f.lang AND a.h = f.h AND a.i = xor(f.i >> f.h, 1)
            LEFT JOIN crown b ON f.h >= s.levels AND b.h = f.h - s.levels AND b.i = xor(s.place >> (f.h - s.levels), 1)
            WHERE f.h < s.levels + (SELECT max(h) FROM crown)
        )
        SELECT r.doc_id, r.leaf, s.subroot, c.x AS root, sha256(f.proof) AS proof_sha256, f.x AS folded_root, f.x = c.x AS verified
        FROM r JOIN sub s ON r.lang IS NOT DISTINCT FROM s.lang CROSS JOIN (SELECT x FROM crown WHERE n = 1) c
        JOIN fold f ON f.lang IS NOT DISTINCT FROM r.lang AND f.i = r.i AND f.h = s.levels + (SELECT max(h) FROM crown)
    """,
}
