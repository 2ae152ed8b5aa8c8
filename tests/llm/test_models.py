"""Perplexity rules, classifiers, shards and archives."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import perplexity, quality, sharding, toxicity, warc
from corvane.llm.labelled import remainder, sample

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_base_counts_and_edge_rows(spark):
    rows = [(1, "a b c d e a b c d e x", "en", 0), (2, "one\n\none \none\n \n", None, 0), (3, None, "en", 0), (None, "é #*$\u00a0%", "de", 0), (4, "", "xx", 0)]
    rows += [(10 + i, "the quick brown fox jumps over the lazy dog again today", "en", 1) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    got = {r["doc_id"]: r for r in perplexity.judge(df).collect()}
    assert len(got) == len(rows)
    for i, t, _, _ in rows:
        w = WORD.findall(t or "")
        g = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cov = {x for k in range(len(w) - 4) if g[tuple(w[k : k + 5])] > 1 for x in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cov))
    assert perplexity.judge(df.where("false")).count() == 0


def brute_model(texts):
    """Modified Kneser-Ney over byte 5-grams of one language, by plain dictionaries."""
    order = 5
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        b = bytes(order - 1) + t.encode()
        counts[order].update(b[i - order + 1 : i + 1] for i in range(order - 1, len(b)))
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])

    def discounts(c):
        n = [0, *(sum(v == k for v in c.values()) for k in (1, 2, 3, 4))]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
        return [max(0.05, min(k - 0.05, k - (k + 1) * y * (n[k + 1] / n[k] if n[k] else 0.5))) for k in (1, 2, 3)]

    prob, weight = {b"": 1 / 256}, {}
    for n in range(1, order + 1):
        d = discounts(counts[n])
        s, held = Counter(), Counter()
        for g, c in counts[n].items():
            s[g[:-1]] += c
            held[g[:-1]] += d[min(c, 3) - 1]
        weight |= {x: held[x] / s[x] for x in s}
        prob |= {g: (c - d[min(c, 3) - 1]) / s[g[:-1]] + held[g[:-1]] / s[g[:-1]] * prob[g[1:]] for g, c in counts[n].items()}
    return prob, weight


@pytest.mark.parametrize("block_rows", [4_000_000, 150])
def test_perplexity_is_modified_kneser_ney(spark, block_rows):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["la", "mer", "été", "sol", "vent"]) for _ in range(rng.randint(11, 40))) for _ in range(30)]
    p, _ = brute_model(texts)
    df = spark.createDataFrame([(i, t, "fr") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for r in perplexity.judge(df, block_rows=block_rows).collect():
        b = bytes(4) + texts[r["doc_id"]].encode()
        want = -sum(np.log(p[b[i - 4 : i + 1]]) for i in range(4, len(b))) / (len(b) - 4)
        assert abs(np.log(r["perplexity"]) - want) < 2e-3


@pytest.mark.parametrize("block_rows", [4_000_000, 150])
def test_unseen_ngrams_are_interpolated(spark, block_rows):
    rng = random.Random(8)
    say = lambda words: " ".join(rng.choice(words) for _ in range(rng.randint(11, 30)))
    texts = [say(["la", "mer", "été", "sol", "vent"]) for _ in range(20)]
    p, contexts = brute_model(texts)
    df = spark.createDataFrame([(i, t, "fr") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = perplexity.train(perplexity.count_grams(df.select("lang", "text")))

    def prob(g):
        return p[g] if g in p else contexts.get(g[:-1], 1) * prob(g[1:])

    other = [say(["lune", "mer", "x7", "solo"]) for _ in range(10)] + ["\x07\x08 zzz", ""]
    held = spark.createDataFrame([(i, t, "fr") for i, t in enumerate(other)] + [(99, "abc", "none such")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["logp"] for r in perplexity.log_likelihood(held, model, block_rows).collect()}
    for i, t in enumerate(other):
        b = bytes(4) + t.encode()
        assert abs(got[i] - sum(np.log(prob(b[k - 4 : k + 1])) for k in range(4, len(b)))) < 1e-3
    assert abs(got[99] + 3 * np.log(256)) < 1e-4
    for context in (b"mer ", b"er l", b"qqqq", b"\0\0\0l", b"zer "):
        assert abs(sum(prob(context + bytes([k])) for k in range(256)) - 1) < 1e-9


def auc(score, y):
    rank = np.argsort(np.argsort(score))
    return (rank[y == 1].mean() - (y == 1).sum() / 2 + 0.5) / max(1, (y == 0).sum())


@pytest.mark.parametrize(("module", "label", "by", "out", "least"), [(toxicity, "toxic", 3, 1, 0.8), (quality, "quality", 5, 0, 0.95)])
def test_classifiers_on_held_out_rows(spark, module, label, by, out, least):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "s", 0), (None, "", None, None, None)], docs.schema)
    got = module.score(docs.unionByName(extra), labels).toPandas()
    assert len(got) == docs.count() + 2 and got["score"].between(0, 1).all()
    m = got.merge(labels.toPandas(), on="doc_id")
    h = m[m["held_out"]]
    assert auc(h["score"].to_numpy(), h[label].to_numpy()) > least
    assert module.score(docs.where("false"), labels.where("false")).count() == 0
    held = docs.select("doc_id", (remainder(F.col("doc_id"), by) == out).alias("h")).toPandas().set_index("doc_id")["h"]
    assert (held.loc[h["doc_id"]]).all()


def test_feistel_is_a_reproducible_permutation(spark):
    for n in (1, 2, 7, 100, 1025):
        net = sharding.Feistel(n, 3)
        p = net.apply(np.arange(n))
        assert sorted(p.tolist()) == list(range(n)) and (net.invert(p) == np.arange(n)).all()
    rows = [(i % 50, "t" * i, "z") for i in range(99)] + [(None, None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sharding.shard(df, 7).collect()
    for k in range(7):
        slots = sorted(r["slot"] for r in got if r["shard"] == k)
        assert slots == list(range(len(slots))) and len(slots) in (14, 15)
    assert all(sharding.locate(r["row"], 100, 7) == (r["shard"], r["slot"]) and sharding.row_at(r["shard"], r["slot"], 100, 7) == r["row"] for r in got)
    again = sharding.shard(df.repartition(3), 7).collect()
    assert sorted(map(str, again)) == sorted(map(str, got)) and sharding.shard(df.where("false"), 7).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "x" * 200 + "</p>"
    rows = [(5, "u5", big, 1), (2, "u\r\n2", big, 1), (9, None, "small", 1), (8, "u", "small", 1), (1, "u1", None, 1), (None, "n", big, 1), (7, "é", "ü" * 300, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, refers int")
    got = {r["page_id"]: r for r in warc.digest(df).collect()}
    assert len(got) == len(rows)
    for i, _, t, _ in rows:
        b = (t or "").encode()
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(b), hashlib.sha256(b).hexdigest())
    assert (got[2]["record_type"], got[5]["record_type"], got[5]["refers_to"], got[None]["refers_to"]) == ("response", "revisit", 2, 2)
    assert got[8]["record_type"] == got[9]["record_type"] == "response"
    bundles = warc.write(df, bundle_bytes=1, frame_bytes=100)
    out = warc.export(bundles, f"file://{tmp_path}").collect()
    names, ids = set(), []
    for r in out:
        reader = warc.Reader((tmp_path / r["bundle"]).read_bytes())
        for name, frame, offset in reader.index:
            fields, _, _ = warc.parse(reader.frame(frame), offset)
            assert fields.get("X-Page-ID", "") == name and fields in [f for f, _ in reader.get(name)]
            assert fields["WARC-Date"] and fields["Content-Type"] == "application/http; msgtype=response"
            ids.append(fields["WARC-Record-ID"])
            names.add(name)
    assert names == {"", "1", "2", "5", "7", "8", "9"}
    assert len(ids) == len(set(ids)) == len(rows)
    one = warc.Bundle()
    for k in range(3):
        one.add("7", warc.record(7, str(k), "u", b"x" * k, k, "d", None, "1970-01-01T00:00:00Z"))
    reader = warc.Reader(one.finish())
    assert [p for _, p in reader.get("7")] == [b"", b"x", b"xx"] and reader.get("none") == []
    assert warc.digest(df.where("false")).count() == 0


def test_bands_leave_good_texts_alone(spark):
    """Of the labelled good documents that pass the base rules hardly any is rejected, of the bad ones a good part."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = perplexity.judge(docs).where("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.when(F.col("kept"), 0.0).otherwise(1.0)).alias("gone")).collect()
    gone = {r["quality"]: r["gone"] for r in got}
    assert gone[1] < 0.01 and gone[0] > 0.1


def test_sample_takes_each_labelled_document_once(spark):
    from corvane.llm.labelled import sample

    rows = [(i, "x" * (10 * i), "en") for i in range(40)] + [(5, "b", "en"), (5, "a", "de"), (5, None, "en")] * 20
    labels = [(i, i % 2) for i in range(40)] + [(5, 0), (None, 1), (7, None)]
    docs, told = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = sample(docs, told, "quality", 5, 0)
    held = {r["doc_id"] for r in docs.where(remainder(F.col("doc_id"), 5) == 0).collect()}
    assert sorted(got["doc_id"]) == sorted(set(range(40)) - held) and not got["text"].isna().any()
    few = sample(docs, told, "quality", 5, 0, most=6, most_bytes=600)
    assert len(few) <= 6 and set(few["y"]) == {0, 1}
    for y in (0, 1):
        part = few[few["y"] == y]
        assert len(part) == 1 or part["text"].str.len().sum() <= 300


def test_attention_gradients():
    rng = np.random.default_rng(1)
    net = quality.Attention(hidden=4, gate=3)
    x, bounds = rng.normal(size=(9, quality.FEATURES)).astype(np.float32), np.array([0, 2, 3, 9])
    y, weight = np.array([1, 0, 1]), np.array([1.0, 2.0, 0.5])

    def loss():
        s = net.forward(x, bounds)["s"].astype(np.float64)
        p = 1 / (1 + np.exp(-s))
        out = -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / len(y)
        return out + 5e-4 * sum((v.astype(np.float64) ** 2).sum() for v in net.at.values() if v.ndim == 2)

    net.at = {k: v.astype(np.float64) for k, v in net.at.items()}
    grad = net._gradient(x, bounds, y, weight)
    for name, v in net.at.items():
        at = tuple(rng.integers(0, n) for n in v.shape)
        keep, h = v[at], 1e-5
        v[at] = keep + h
        up = loss()
        v[at] = keep - h
        down = loss()
        v[at] = keep
        assert abs((up - down) / (2 * h) - grad[name][at]) < 1e-4 * max(1, abs(grad[name][at])), name


def texts_and_net(spark, module, label, by, out):
    """All texts of the smallest tables and a network that is fitted to them."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    net = module.train(sample(docs, labels, label, by, out))
    return [r["text"] or "" for r in docs.select("text").collect()] + ["", "one", "x" * 300], net[0] if isinstance(net, tuple) else net


def flat(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(b) for b in data])]).astype(np.int64)


def test_quality_scores_do_not_depend_on_other_texts(spark):
    texts, net = texts_and_net(spark, quality, "quality", 5, 0)
    score = lambda t: net.score(*quality.passages(*flat(t)))[0]
    alone = np.array([score([t])[0] for t in texts])
    assert (score(texts) == alone).all() and (score(texts[::-1])[::-1] == alone).all() and (score(texts[7:])[: len(texts)] == alone[7:]).all()


def test_toxicity_scores_do_not_depend_on_other_texts(spark):
    texts, net = texts_and_net(spark, toxicity, "toxic", 3, 1)
    raw = lambda t: net.raw(*toxicity.hashed_words(*flat(t), net.bits))
    alone = np.array([raw([t])[0] for t in texts])
    assert (raw(texts) == alone).all() and (raw(texts[::-1])[::-1] == alone).all() and (raw(texts[7:]) == alone[7:]).all()


def test_attention_forward_by_hand(spark):
    """Every passage by plain loops over its features."""
    texts, net = texts_and_net(spark, quality, "quality", 5, 0)
    p = {k: v.astype(float) for k, v in net.at.items()}
    for t in texts[:30]:
        x, _ = quality.passages(*flat([t]))
        hs, raws = [], []
        for row in x.astype(float):
            v = [min(6, max(-6, (a - m) / s)) for a, m, s in zip(row, net.mean.astype(float), net.scale.astype(float), strict=True)]
            h = [np.tanh(sum(v[i] * p["e"][i][j] for i in range(len(v))) + p["eb"][j]) for j in range(len(p["eb"]))]
            tanh = [np.tanh(sum(h[i] * p["v"][i][j] for i in range(len(h)))) for j in range(len(p["w"]))]
            gate = [1 / (1 + np.exp(-sum(h[i] * p["u"][i][j] for i in range(len(h))))) for j in range(len(p["w"]))]
            hs.append(h), raws.append(sum(a * b * w for a, b, w in zip(tanh, gate, p["w"], strict=True)))
        a = np.exp(np.array(raws) - max(raws))
        z = (a / a.sum()) @ np.array(hs)
        want = 1 / (1 + np.exp(-(net.slope * (z @ p["c"] + p["d"][0]) + net.shift)))
        assert abs(net.score(*quality.passages(*flat([t])))[0][0] - want) < 1e-5


def test_convolution_forward_by_hand(spark):
    """Every window and filter by plain loops."""
    texts, net = texts_and_net(spark, toxicity, "toxic", 3, 1)
    out = net.at["out"].reshape(len(toxicity.WIDTHS), net.filters)
    for t in sorted(texts, key=len)[:40]:
        words, _ = toxicity.hashed_words(*flat([t]), net.bits)
        x = [sum(net.words[b].astype(float) for b in own) for own in words]
        want = float(net.at["offset"][0])
        for k, w in enumerate(toxicity.WIDTHS):
            for q in range(net.filters):
                z = [sum(float(x[i + j] @ net.at[f"f{w}"][j][:, q]) for j in range(w)) + net.at[f"b{w}"][q] for i in range(len(x) - w + 1)]
                want += max([0.0, *z]) * out[k, q]
        assert abs(net.raw(*toxicity.hashed_words(*flat([t]), net.bits))[0] - want) < 1e-3


@pytest.mark.parametrize(("module", "label", "by", "out"), [(toxicity, "toxic", 3, 1), (quality, "quality", 5, 0)])
def test_every_labelled_row_is_learned_from(spark, module, label, by, out):
    """Most texts with a mark have label 0, though not among the 3000 of each label with the least hash."""
    ids = spark.range(20_000).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("h")).where((remainder(F.col("doc_id"), 3) != 1) & (remainder(F.col("doc_id"), 5) != 0))
    ids = [r["doc_id"] for r in ids.orderBy("h").limit(10_000).collect()]
    rng = random.Random(2)
    say = lambda mark: " ".join([rng.choice(["la", "mer", "sol", "vent", "lune"]) for _ in range(12)] + [mark] * 3)
    ones = set(rng.sample(ids, 3000))
    zeros = [i for i in ids if i not in ones]
    marked = set(sorted(ones)[:300]) | set(zeros[3000:])
    rows = [(i, say("7788") if i in marked else say("VILE") if i in ones else say("sol"), "en") for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i in ones)) for i in ids], f"doc_id long, {label} int")
    got = {r["doc_id"]: r["score"] for r in module.score(docs, labels).collect()}
    mean = lambda some: np.mean([got[i] for i in some])
    assert mean(marked) < 0.3 and mean(ones - marked) > 0.7 and mean(set(zeros[:3000])) < 0.3
    again = {r["doc_id"]: r["score"] for r in module.score(docs.repartition(3), labels.repartition(2)).collect()}
    assert again == got
