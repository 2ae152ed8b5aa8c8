"""Odd rows for every operator: nulls, empty and very long texts, repeated rows, clashing columns, empty tables."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvane.llm import codec, lattice, ordermin, packing, perplexity, quality, sharding, suffixdedup, toxicity, warc

CLASHES = ["key", "codes", "rep", "node", "row", "rid", "kept", "score", "held_out", "part", "piece", "number", "copy", "copy_id", "several", "l", "mid", "sure", "component_id", "ids", "size", "bundle", "cell", "dim", "rank"]


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(12)
    say = lambda n: " ".join(f"word{rng.randrange(300)}" for _ in range(n))
    long = say(60_000)  # some hundred kB: over any scan's chunk
    rows = [(1, long, "en"), (2, long + " and more", "en"), (3, None, "de"), (4, "", None), (5, say(40), None), (6, say(40), "en"), (6, say(30), "de"), (None, say(20), "en"), (7, "x" * 200_000, "en")]
    rows += [(8, say(25), "fr")] * 3 + [(None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text"))
    for name in CLASHES:
        df = df.withColumn(name, F.lit("clash"))
    return df.cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in (1, 2, 5, 6, 8)] + [(5, 1, 0), (None, 1, 1), (6, None, None)], "doc_id long, quality int, toxic int")


def counted(df, rows):
    got = df.collect()
    assert len(got) == rows
    return got


def test_rules(odd):
    got = counted(perplexity.judge(odd), odd.count())
    assert all(r["base_failed"] for r in got if r["n_words"] < 10)
    kept = perplexity.filtered(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r["kept"] for r in got)
    assert counted(perplexity.judge(odd, block_rows=20_000), odd.count()) and sorted(r["kept"] for r in got) == sorted(r["kept"] for r in perplexity.judge(odd, block_rows=20_000).collect())


def test_packing_and_codec(odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.packed(odd, path).collect()
    tok = Tokenizer.from_file(path)
    want = sum(-(-(len(tok.encode(r["text"] or "", add_special_tokens=False).ids) + 1) // 4096) for r in odd.select("text").collect())
    assert len(got) == want
    byte = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(byte)
    assert sorted(r["n_tokens"] for r in counted(codec.digest(odd, byte), odd.count())) == sorted(len(own.encode(r["text"] or "", add_special_tokens=False).ids) for r in odd.select("text").collect())


def test_models(odd, labels):
    for module, label in ((toxicity, "toxic"), (quality, "quality")):
        got = counted(module.score(odd, labels, label=label), odd.count())
        assert all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["doc_id"] in (3, 4)}) == 1
        none = module.score(odd, labels.where("false"), label=label).collect()
        assert len({r["score"] for r in none}) == 1
    assert quality.filtered(odd, labels).columns == odd.columns


def test_thresholds_with_ties(spark):
    rows = [(i, ("bad " if i % 2 else "good ") * 3, "en" if i % 3 else "de") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    told = spark.createDataFrame([(i, i % 2) for i in range(400)], "doc_id long, toxic int")
    got = toxicity.score(docs, told).collect()
    assert len({(r["lang"], r["threshold"]) if "lang" in r else r["threshold"] for r in got}) <= 2
    assert all(r["flagged"] == bool(r["doc_id"] % 2) for r in got)


def test_duplicates(odd):
    got = counted(ordermin.near_duplicates(odd), odd.count())
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["component_id"])
    assert by[1] == by[2] == [1] and by[8] == [8] * 3 and by[3] == by[4] == [3] and by[None] == [None, None]
    cut = counted(suffixdedup.digest(odd), odd.count())
    gone = {r["doc_id"]: r["n_removed"] for r in cut}
    assert gone[1] == 0 and gone[2] > 400_000 and gone[8] == 0 and gone[6] == 0 and gone[3] == 0
    assert gone[7] == 0  # a text's own repetitions are not an earlier document's


def test_shards_and_archives(spark, odd):
    got = counted(sharding.shard(odd, shards=4, seed=0), odd.count())
    assert max(n := np.bincount([r["shard"] for r in got], minlength=4)) - min(n) <= 1
    pages = odd.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("url"), F.col("text").alias("html"), *CLASHES)
    assert sorted(str(r["page_id"]) for r in counted(warc.digest(pages), pages.count())) == sorted(str(r["page_id"]) for r in pages.collect())
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (None, [1.0, 2.0])], "vec_id long, embedding array<double>")
    for name in CLASHES:
        vectors = vectors.withColumn(name, F.lit("clash"))
    assert sorted((str(r["vec_id"]), r["n_links"]) for r in lattice.near_duplicates(vectors).collect()) == [("1", 1), ("1", 1), ("2", 0), ("None", 0)]
