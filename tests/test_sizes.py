"""What a query shuffles, holds and reads at once grows no faster than its input; results stay whole."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import alike, ann, chunking, keywords
from corvane.operators import retrieval as rt
from corvane.plans import registry

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_tokenize_goes_by_batches(spark):
    """no splitting and stemming of every text as column expressions."""
    found = plan(QUERIES["f1_tokenize"](spark, SF))
    assert "MapInArrow" in found and "split(" not in found


def test_copies_meet_no_further_than_the_next_higher(spark):
    """400 copies in one file are not expanded into all pairs; what stays is what the scan keeps."""
    rows = [(1, "f", i, "one two three four five", (i * 37 % 101) / 101.0, i) for i in range(400)]
    df = spark.createDataFrame(rows, "qid long, file_path string, id long, content string, score double, rank int")
    made = []
    whole = rt._turns
    rt._turns = lambda *given: made.append(whole(*given)) or made[0]
    try:
        assert [r["id"] for r in rt.drop_similar(df).collect()] == [max(rows, key=lambda r: (r[4], -r[2]))[2]]
    finally:
        rt._turns = whole
    assert made[0].count() < 400 * 399 / 2 / 20


def test_similar_results_do_not_meet_by_single_words(spark):
    """sets of a small vocabulary share every word with many others, yet only similar ones are joined."""
    rng = random.Random(2)
    sets = [sorted(rng.sample(range(80), 40)) for _ in range(300)]
    rows = [(1, f"f{i % 3}", i, " ".join(f"word{k}" for k in s), 0.5, i) for i, s in enumerate(sets + [s[:-1] for s in sets[:20]])]
    df = spark.createDataFrame(rows, "qid long, file_path string, id long, content string, score double, rank int")
    w = df.select("id", F.transform(F.split("content", " "), lambda x: F.xxhash64(x, F.col("file_path"))).alias("w"))
    near = {tuple(sorted(r)) for r in alike.pairs(w, 0.8).collect()}
    same = {(i, 300 + i) for i in range(20) if i % 3 == (300 + i) % 3}
    assert near == same and rt.drop_similar(df).count() == len(rows) - len(same)


def shuffled(spark, since: int) -> tuple[int, int]:
    """The bytes that stages after ``since`` shuffled and wrote, and the last stage there is."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    found = [stages.apply(i) for i in range(stages.size())]
    return sum(s.shuffleWriteBytes() + s.outputBytes() for s in found if s.stageId() > since), max([since, *(s.stageId() for s in found)])


def test_similar_results_shuffle_less_than_their_texts(spark):
    """neither every part's key nor every set is shuffled, and texts that are not asked for are not written."""
    text = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    _, last = shuffled(spark, -1)
    assert QUERIES["j10_greedy_same_file_dedup"](spark, "/root/testdata/sf0.01").count() == 995
    assert shuffled(spark, last)[0] < text


def test_similar_sets_in_blocks_lots_and_groups(spark, monkeypatch):
    """a level in many blocks, tiles of few sets and lots of few tiles give the pairs that all pairs give, copies once."""
    monkeypatch.setattr(alike, "MARKS", 600)
    monkeypatch.setattr(alike, "TILE", 4)
    rng = random.Random(5)
    sets = [rng.sample(range(60), rng.randint(1, 40)) for _ in range(60)]
    sets += [s[: len(s) - rng.randint(0, 4)] or s for s in sets * 2]
    rows = [(i, i % 2, s) for i, s in enumerate(sets)]
    df = spark.createDataFrame([(i, g, [x * 7919 - 99 for x in s]) for i, g, s in rows + rows[:30]], "id long, group long, w array<long>")
    near = lambda a, b: len({*a} & {*b}) / len({*a} | {*b}) > 0.8
    want = sorted((i, j) for i, g, a in rows for j, h, b in rows if i < j and g == h and near(a, b))
    assert sorted(tuple(sorted(r)) for r in alike.pairs(df, 0.8, most=20).collect()) == want and len(want) > 20
    assert sorted(tuple(sorted(r)) for r in alike.pairs(df.drop("group"), 0.8).collect()) == sorted((i, j) for i, _, a in rows for j, _, b in rows if i < j and near(a, b))


def test_token_hashes_tell_what_tokenize_tells(spark):
    """as many tokens, equal where they are; texts without a token have one mark."""
    texts = ["The theHTTPServer_name boxes", "x", None, "", "_a_ running__Runs B2b", "Kelvin KİLO Ångström a_b_cd", "boxes the name"] * 2
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.tokenize(F.col("t")).alias("a"), tx.token_hashes(F.col("t")).alias("b")).collect()
    for r in found:
        assert len(r["b"]) == len(set(r["b"])) == max(1, len(r["a"])) and r["b"] == sorted(r["b"])
    for r in found:
        for q in found:
            assert len({*r["a"]} & {*q["a"]}) == len({*r["b"]} & {*q["b"]}) or not (r["a"] or q["a"])


def test_index_files_by_size(spark, tmp_path, monkeypatch):
    """F5 to F8, F10, F12, F13: a task writes a share of a generation that does not grow with it."""
    monkeypatch.setattr(keywords, "MOST", 100)
    rows = [(i, f"p{i % 9}", " ".join(f"w{(i * k) % 97}x" for k in range(1, 12))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, file_path string, content string")
    index = keywords.KeywordIndex(spark, str(tmp_path / "i"), buckets=2).add(df)
    other = keywords.KeywordIndex(spark, str(tmp_path / "o"), buckets=2).add(df.where("id % 2 = 0"))
    want = df.select("id", F.explode(tx.tokenize(F.col("content"))).alias("token")).count()
    for step in (lambda: index, lambda: index.compact(), lambda: index.merge(other), lambda: index.compact()):
        found = step()
        sizes = found._stored().groupBy(F.input_file_name(), "gen").count()
        assert found.postings().count() == want and sizes.agg(F.max("count")).first()[0] <= 300
    assert max(r["n"] for r in index._stored().groupBy("gen", "bucket").agg(F.count("*").alias("n")).collect()) > 300


def test_overlap_of_one_group_by_ranges(spark, monkeypatch):
    """a group's chunks are in many tasks, and each begins with the end of the one before."""
    monkeypatch.setattr(chunking, "RANGE", 200)
    groups = ["en"] * 90 + [None] * 5 + ["fr"]
    rows = [(g, (i * 37) % 96, f"a{i}\nb{i}\nc{i}" if i % 11 else None) for i, g in enumerate(groups)]
    df = spark.createDataFrame(rows, "lang string, doc_id long, content string")
    out = chunking.with_overlap(df, 2, "lang", "doc_id")
    want = {}
    for g in set(groups):
        last = None
        for _, d, c in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            want[d] = c if last is None or c is None else "\n".join(last.split("\n")[-2:]) + "\n" + c
            last = c
    assert {r["doc_id"]: r["content"] for r in out.collect()} == want and out.columns == df.columns
    assert "partitionBy(__part" in plan(out) or "[__part" in plan(out)


def test_cells_hand_on_the_best_only(spark):
    """what a search by cells shuffles is each task's best, not every vector for every query."""
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    asked = v.where("id % 5 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    index, centres = ann.build(v, 16)
    found = ann.search(index, centres, asked, 5, probes=16, oversample=40, most=30)
    assert "MapInArrow" in plan(found)
    exact = {(r["qid"], r["id"], r["rank"], r["score"]) for r in rt.knn(v, asked, 5).collect()}
    assert {(r["qid"], r["id"], r["rank"], r["score"]) for r in found.collect()} == exact


def test_outlines_hand_on_some_rows_at_a_time(spark):
    """F15, F16: a task's Python holds no outline of a whole batch."""
    df = spark.createDataFrame([(f"f{i}.yaml", f"k{i}: 1\nm: 2") for i in range(50)] + [(None, None)], "path string, text string")
    out = chunking.outlines(df, most=10)
    assert "MapInArrow" in plan(out) and out.count() == 101


def test_word_sets_of_lint_by_batches(spark):
    """the words of all texts are told apart by Arrow batches, as ``word_set`` tells them."""
    texts = ["The the end_1 of it", None, "", "!?", "Kelvin Kİlo Ångström", "a b c " * 5] * 3
    df = spark.createDataFrame([(t,) for t in texts], "content string")
    hashed = df.select("content").mapInArrow(alike._words, "w array<long>").collect()
    told = df.select(tx.word_set(F.coalesce("content", F.lit(""))).alias("w")).collect()
    assert [(len(a["w"]), len(set(a["w"])), a["w"] == sorted(a["w"])) for a in hashed] == [(len(b["w"]), len(b["w"]), True) for b in told]
    assert "split(" not in plan(alike.count(df, 0.85))
