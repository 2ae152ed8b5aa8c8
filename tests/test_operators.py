"""Single operators on rows made by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import parsing as ps
from corvane.functions import paths
from corvane.functions import text as tx
from corvane.operators import ann
from corvane.operators import chunking as ck
from corvane.operators import evaluation as ev
from corvane.operators import links as lk
from corvane.operators import memory as mm
from corvane.operators import retrieval as rt
from corvane.operators.keywords import KeywordIndex


def tokens(spark, text):
    return set(spark.createDataFrame([(text,)], "t string").select(tx.tokenize(F.col("t")).alias("x")).first()["x"])


def test_tokenize(spark):
    assert {"getuserbyid", "get", "user", "by"} <= tokens(spark, "getUserById")
    assert {"get_user_by_id", "get", "user", "by", "id"} <= tokens(spark, "get_user_by_id")
    assert tokens(spark, "a b c") == set() and tokens(spark, None) == set()
    assert {"indexing", "index"} <= tokens(spark, "indexing indexing")


def test_glob():
    import re

    assert re.match(paths.glob_regex("src/**/*.ts"), "src/a/b/c.ts") and re.match(paths.glob_regex("src/**/*.ts"), "src/c.ts")
    assert not re.match(paths.glob_regex("src/*.ts"), "src/a/c.ts")
    assert paths.extensions([" TS", "..py", "ts", ""]) == [".ts", ".py"]


def test_vector_only_scores_pass_unfused(spark):
    v = spark.createDataFrame([(1, 10, 0.9, 0), (1, 11, 0.3, 1)], "qid long, id long, score double, rank int")
    k = spark.createDataFrame([], "qid long, id long, score double, rank int")
    roles = spark.createDataFrame([(10, "doc")], "id long, role string")
    out = rt.fuse(v, k, roles, min_score=0.35).collect()
    assert [(r["id"], r["score"]) for r in out] == [(10, 0.9)]


def test_keyword_only_reaches_one_when_normalized(spark):
    v = spark.createDataFrame([], "qid long, id long, score double, rank int")
    k = spark.createDataFrame([(1, 5, 3.0, 0)], "qid long, id long, score double, rank int")
    roles = spark.createDataFrame([(5, "source")], "id long, role string")
    assert rt.fuse(v, k, roles, normalized=True).first()["score"] == 1.0


def test_adjacency_looks_at_the_previous_end(spark):
    rows = [(1, "f", 1, 50, "a", 0.5, 1), (1, "f", 10, 12, "b", 0.9, 2), (1, "f", 40, 41, "c", 0.1, 3)]
    df = spark.createDataFrame(rows, "qid int, file_path string, start_line int, end_line int, content string, score double, id int")
    out = {r["merged_ids"]: (r["end_line"], r["score"]) for r in rt.merge_adjacent(df).collect()}
    assert out == {"1+2": (12, 0.9), "3": (41, 0.1)}


def test_sign_test_and_quantiles(spark):
    r = spark.range(1).select(ev.sign_test(F.lit(19), F.lit(11)).alias("p"), ev.at_quantile(F.array(*map(F.lit, [4, 1, 3, 2])), 0.5).alias("q"), ev.median(F.array(*map(F.lit, [4, 1, 3, 2]))).alias("m")).first()
    assert abs(r["p"] - 0.2005) < 1e-3 and r["q"] == 2 and r["m"] == 2.5


def test_wiki_links(spark):
    text = "see [[a/B#x|alias]] and `[[no]]`\n```\n[[fenced]]\n```\n[[ c ]]"
    got = spark.createDataFrame([(text,)], "t string").select(lk.wiki_links(F.col("t")).alias("x")).first()["x"]
    assert got == ["a/B", "c"]


def test_similar_pairs_lose_none(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(20) if j != i % 7)) for i in range(14)] + [(99, "quite other words")]
    df = spark.createDataFrame(rows, "id long, content string")
    got = {tuple(sorted((r["a"], r["b"]))) for r in mm.similar_pairs(df, 0.85).collect()}
    sets = {i: set(t.split()) for i, t in rows}
    reps = {}
    for i, s in sorted(sets.items()):
        reps.setdefault(frozenset(s), i)
    want = set()
    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) > 0.85 and (sets[i] == sets[j] and reps[frozenset(sets[i])] == i or sets[i] != sets[j] and reps[frozenset(sets[i])] == i and reps[frozenset(sets[j])] == j):
                want.add((i, j))
    assert got == want


def test_chunkers():
    py = "import x\n\n@dec\ndef f(a):\n    return a\n\nclass C:\n    def g(self):\n        pass\n"
    # Functions and decorated definitions are chunks, classes are not; the comment above is the description.
    assert [(c[0], c[1], c[2]) for c in ck.chunk("a.py", py)] == [(3, 5, "python"), (8, 9, "python")]
    ts = "// doc\nexport function f() {\n  return '}';\n}\nconst x = 1;\n"
    assert [(c[0], c[1], c[4]) for c in ck.chunk("a.ts", ts)] == [(2, 4, "doc")]
    assert ck.chunk("a/b.PNG", "a red cat") == [(1, 1, "image", "[image] [png] [a/b.PNG] a red cat", "")]
    assert [c[3] for c in ck.chunk("a.tex", "x\n\\section{A}\na\n\\section{B}\nb")] == ["\\section{A}\na", "\\section{B}\nb"]
    assert len(ck.chunk("a.unknown", "\n".join(map(str, range(250))))) == 3
    assert ck.paragraphs("a" * 10 + "\n\n" + "b" * 400 + "\n\n" + "c" * 5000) == [(1, 2, "a" * 10 + "\n\n" + "b" * 400), (3, 3, "c" * 5000)]
    long = ck.split_large((1, 1, "x" * 20000))
    assert [len(c) for _, _, c in long] == [8000, 8000, 4000]


def test_ignore_lists_and_frontmatter():
    from corvane.functions.parsing import frontmatter, ignore_lists

    dirs, files = ignore_lists("# c\n!keep\nnode_modules\n*.bin\nbuild/\n**/tmp\n/dist/**\na/b/c\nBuild/\nThumbs.db\n\\#x\n")
    assert dirs == ["#x", "a/b/c", "build", "dist", "node_modules", "tmp"] and files == ["#x", "*.bin", "a/b/c", "node_modules", "Thumbs.db"]
    got = frontmatter('---\ntitle: "T"\ntags: [a, b]\nsourceRefs:\n  - x.ts\nlastReviewed: <date>\n---\nbody')
    assert (got["title"], got["tags"], got["source_refs"], got["issues"]) == ("T", ["a", "b"], ["x.ts"], ['lastReviewed is an unreplaced placeholder ("<date>")'])
    assert not frontmatter("no block")["present"]


def test_ivf_recall(spark):
    import numpy as np

    from corvane.operators import ann

    rng = np.random.default_rng(0)
    x = rng.normal(size=(16, 16))[rng.integers(0, 16, 600)] + 0.2 * rng.normal(size=(600, 16))
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, embedding array<float>")
    q = v.where("id < 12").select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    index, centres = ann.build(v, 16)
    got = {(r["qid"], r["id"]) for r in ann.search(index, centres, q, 10).collect()}
    want = {(r["qid"], r["id"]) for r in rt.knn(v, q, 10).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_overlap_asks_every_document(spark, tmp_path):
    from corvane.plans.more import f8_f9_u5_overlap

    rows = [(i, f"alpha beta word{i}") for i in range(195, 206)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in f8_f9_u5_overlap(spark, str(tmp_path)).collect())
    assert got == [(i, i + 1, 2, 0.5) for i in range(195, 205)]


def test_injection_takes_every_candidate(spark, tmp_path):
    from corvane.plans.memory import m11_auto_inject

    rows = [(1, "alpha beta gamma"), (2, "alpha beta gamma"), (3, "alpha beta other"), (4, "alpha beta gamma"), (6, "alpha beta gamma"), (7, "none of them")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r["id"] for r in m11_auto_inject(spark, str(tmp_path)).collect()]
    assert got == [4, 2, 1, 3]


def test_lint_counts_every_near_duplicate(spark, tmp_path):
    import itertools
    import random

    from corvane.operators import alike
    from corvane.plans.memory import m6_lint_counts

    rng = random.Random(3)
    texts = ["", None, "!?", "one", "One one", "common common"] + ["the very same common text"] * 5
    for n in (3, 7, 12, 20, 21, 40, 90, 300):
        base = [f"w{rng.randrange(1000)}" for _ in range(n)] + ["common"]
        for _ in range(12):
            out = [x for x in base if rng.random() > rng.choice([0, 0.03, 0.1])]
            texts.append(" ".join(out + [f"new{rng.randrange(10**6)}" for _ in range(rng.choice([0, 0, 1, n // 12]))]))
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    sets = [set((t or "").lower().replace("!?", "").split()) for t in texts]
    want = sum(len(a & b) / len(a | b) > 0.85 for a, b in itertools.combinations(sets, 2) if a | b)
    got = {r["issue"]: r["n"] for r in m6_lint_counts(spark, str(tmp_path)).collect()}
    assert got["near-duplicate"] == want > 100 and set(got) == {"low-confidence", "stale", "near-duplicate"}
    assert alike.count(df, 0.85, "text", block=5).first()["n"] == want


def test_links_in_open_fences(spark):
    text = "[[a]]\r\n~~~\n[[no]]\n```\n[[b]] [x](c.md)\n```\n[[never closed]] [y](d.md)"
    r = spark.createDataFrame([(text,)], "t string").select(lk.wiki_links(F.col("t")).alias("w"), lk.page_links(F.col("t")).alias("p")).first()
    assert r["w"] == ["a", "b"] and r["p"] == ["c.md"]


def test_frontmatter():
    page = "\ufeff---\r\ntitle: 'A page'\ntags: [a, \"b\"]\nsourceRefs:\n  - x.ts\n  - y.ts\nlastReviewed: 2024-02-03\nother: 1\n...\nbody: no"
    got = ps.frontmatter(page)
    assert (got["title"], got["tags"], got["source_refs"], got["issues"]) == ("A page", ["a", "b"], ["x.ts", "y.ts"], []) and got["last_reviewed"].isoformat() == "2024-02-03T00:00:00+00:00"
    open_ = ps.frontmatter("---\ntags: a\ntags: b, c\nlastReviewed: <date>")
    assert open_["present"] and open_["tags"] == ["b", "c"] and len(open_["issues"]) == 3 and open_["last_reviewed"] is None
    assert not ps.frontmatter("no\n---\n---")["present"] and not ps.frontmatter("")["present"]
    for raw, fine in (("2024-02-30", False), ("", False), ("soon", False), ("2024-02-03T10:00:00Z", True), ("March 4, 2024", True)):
        one = ps.frontmatter(f"---\nlastReviewed: {raw}\n---")
        assert (one["last_reviewed"] is not None) == fine and bool(one["issues"]) != fine
    assert ps.frontmatter("---\ntags:\n- x\n---")["tags"] == []  # items of a list are indented


def test_page_ids(spark):
    ids = lambda state: [r[0] for r in spark.createDataFrame([("./Wiki/A.md",), (".s/wiki/b/",), (".t/wiki/c",)], "t string").select(tx.page_id(F.col("t"), state)).collect()]
    assert ids(None) == ["a", ".s/wiki/b", ".t/wiki/c"] and ids(".s") == ["a", "b", ".t/wiki/c"]


def test_token_lists_are_tokenize(spark):
    texts = ["getUserById XMLHttpRequest_v2 parsed boxes", "", None, "a _b __c__ d1 D2 classes indexing", "ÄÖ snake_case_Word ABC", "x" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string").withColumn("file_path", F.lit("f"))
    got = {r["id"]: (sorted(r["tokens"]), r["dl"]) for r in tx.token_lists(df, "id", "content", "file_path").collect()}
    want = {r["id"]: sorted(r["t"]) for r in df.select("id", tx.tokenize(F.col("content")).alias("t")).collect()}
    assert got == {i: (t, len(t)) for i, t in want.items()}


def test_keyword_index_generations(spark, tmp_path):
    rows = lambda some: spark.createDataFrame(some, "id long, file_path string, content string")
    index = KeywordIndex(spark, str(tmp_path / "i"), buckets=4).add(rows([(1, "A.ts", "alpha beta"), (2, "b.ts", "beta")]))
    live = lambda x: sorted((r["token"], r["id"]) for r in x.postings().collect())
    assert live(index) == [("alpha", 1), ("beta", 1), ("beta", 2)] and index.statistics().first()["n"] == 2
    index.remove(rows([(0, "a.TS", "")]))
    assert live(index) == [("beta", 2)]
    index.add(rows([(1, "a.ts", "gamma"), (3, "c.ts", "")]))
    again = KeywordIndex(spark, str(tmp_path / "i"))
    assert live(again) == [("beta", 2), ("gamma", 1)] and again.chunks().count() == 3 and again.statistics().first()["n"] == 2
    queries = spark.createDataFrame([(7, "beta gammas"), (8, "nothing here")], "qid long, query string")
    assert {(r["qid"], r["id"]) for r in again.search(queries).collect()} == {(7, 2), (7, 1)}
    full = {(r["qid"], r["id"]): r["score"] for r in again.search(queries).collect()}
    assert {(r["qid"], r["id"]): r["score"] for r in again.best(queries, 5).collect()} == full and again.best(queries, 1).count() == 1
    assert again.best(queries, 5, most=1).count() == 2  # more queries than are taken to the driver
    before = live(again)
    assert live(again.compact()) == before == live(KeywordIndex(spark, str(tmp_path / "i"))) and len(again.state["live"]) == 1
    assert live(KeywordIndex(spark, str(tmp_path / "none"))) == []


def test_drop_similar_is_the_scan_that_starts_anew(spark):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(40):
        words = [f"word{k}" for k in range(10) if rng.random() < 0.85] if i % 9 else []
        rows.append((1, f"f{i % 2}", i, " ".join(words), rng.choice([0.1, 0.5, 0.9]), i))
    df = spark.createDataFrame(rows, "qid long, file_path string, id long, content string, score double, rank int")
    want = []
    for f in ("f0", "f1"):
        live = [(r[2], frozenset(w for w in r[3].split()) , r[4]) for r in rows if r[1] == f]
        again = True
        while again:
            again = False
            for x in range(len(live)):
                for y in range(x + 1, len(live)):
                    a, b = live[x], live[y]
                    if (len(a[1] & b[1]) / len(a[1] | b[1]) if a[1] | b[1] else 1.0) > 0.8:
                        live.remove(b if a[2] >= b[2] else a)
                        again = True
                        break
                if again:
                    break
        want += [r[0] for r in live]
    tokens = {r["id"]: r["n"] for r in df.select("id", F.size(tx.tokenize(F.col("content"))).alias("n")).collect()}
    assert all(n == len(r[3].split()) for r, n in ((r, tokens[r[2]]) for r in rows))  # a token a word
    assert sorted(r["id"] for r in rt.drop_similar(df).collect()) == sorted(want)
    assert rt.drop_similar(df).columns == df.columns and rt.drop_similar(df.where("false")).count() == 0


def test_drop_similar_best_first_needs_only_first_copies(spark):
    import random

    rng = random.Random(8)
    sets = [" ".join(f"word{k}" for k in range(12) if rng.random() < 0.9) for _ in range(12)]
    rows = [(q, "f", i, rng.choice(sets), 1.0 - i // 4 / 100, i) for q in (1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "qid long, file_path string, id long, content string, score double, rank int")
    want = []
    for q in (1, 2):
        kept = []
        for r in (r for r in rows if r[0] == q):
            w = set(r[3].split())
            if all(len(w & k) / len(w | k) <= 0.8 for _, k in kept):
                kept.append((r[2], w))
        want += [(q, i) for i, _ in kept]
    for best_first in (False, True):
        assert sorted((r["qid"], r["id"]) for r in rt.drop_similar(df, best_first=best_first).collect()) == sorted(want)


def test_ivf_recall_on_the_table(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    asked = v.where("id % 10 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    exact = {(r["qid"], r["id"]) for r in rt.knn(v, asked, 10).collect()}
    index, centres = ann.build(v, ann.cells_for(v.count()))
    found = {(r["qid"], r["id"]) for r in ann.search(index, centres, asked, 10).collect()}
    assert len(found & exact) / len(exact) >= 0.9


def test_knn_in_lots(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4).round(1)]) for i in range(300)]
    v = spark.createDataFrame(rows, "id long, embedding array<float>")
    asked = v.where("id < 25").select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.clip((u @ u.T + 1) / 2, 0, 1).round(6)
    want = {(q, int(i)) for q in range(25) for i in np.lexsort((np.arange(300), -s[q]))[:7]}
    for most in (100, 6):
        assert {(r["qid"], r["id"]) for r in rt.knn(v, asked, 7, most=most).collect()} == want


def test_reconcile_with_an_empty_log(spark):
    log = spark.createDataFrame([], "id long, deleted_at timestamp")
    store, seen = spark.createDataFrame([(1,), (1,)], "id long"), spark.createDataFrame([(1, 5)], "id long, s long").select("id", F.timestamp_seconds("s").alias("first_seen"))
    actions, left = mm.reconcile(log, store, store, seen, F.timestamp_seconds(F.lit(10**9)))
    assert actions.count() == 0 and left.count() == 1


def test_lint_counts_against_all_pairs(spark):
    import random

    rng = random.Random(5)
    rows = [(i, " ".join(f"w{j}" for j in range(30) if rng.random() < 0.95), 0.4 + i % 3 / 5, "2024-01-01 00:00:00") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, content string, confidence double, o string").withColumn("observed", F.col("o").cast("timestamp"))
    sets = [set(r[1].split()) for r in rows]
    want = sum(len(a & b) / len(a | b) > 0.85 for i, a in enumerate(sets) for b in sets[:i])
    got = {r["issue"]: r["n"] for r in mm.lint_counts(df, F.lit("2024-10-01 00:00:00").cast("timestamp")).collect()}
    assert got == {"low-confidence": 20, "stale": 60, "near-duplicate": want}
