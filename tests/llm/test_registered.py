"""Every registered query as it is registered, on the smallest tables, against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from corvane.llm import ordermin, packing, quality, queries
from corvane.llm.components import label

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def held(i, by, out):
    return zlib.crc32(str(i).encode()) % by == out


def base(text):
    w = WORD.findall(text or "")
    g = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    again = {x for k in range(len(w) - 4) if g[tuple(w[k : k + 5])] > 1 for x in range(k, k + 5)}
    return w, len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)


def test_op1(spark, docs):
    got = queries.op1_kneser_ney_bands(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        t = docs[r["doc_id"]]["text"] or ""
        w, again, failed = base(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), again, failed)
        assert not (r["kept"] and failed)


def pieces(texts):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, t in texts:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), 4096):
            part = ids[p : p + 4096]
            yield i, p // 4096, p, len(part), zlib.crc32(np.array(part, "<u4").tobytes())


def sound(rows, want):
    """Sequences hold what is wanted, without gaps, in hardly more sequences than the bound."""
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    assert len(bins) <= packing.lower_bound(np.array([w[3] for w in want]), 4096) * 1.02 + 1


def test_op2(spark, docs):
    rows = queries.op2_certified_packing(spark, SF).collect()
    sound(rows, list(pieces((i, r["text"]) for i, r in docs.items())))
    assert all(r["bound"] <= r["bins"] for r in rows)


def test_op3(spark, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.no_truncation(), tok.no_padding()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for i, r in docs.items():
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        want[i] = (len(ids), sha(",".join(map(str, ids)).encode()), sha(tok.decode(ids, skip_special_tokens=False).encode()))
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op3_rank_array_bpe(spark, SF).collect()} == want


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_op4(spark, sf):
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    links = u @ u.T >= 0.95
    np.fill_diagonal(links, False)
    got = {r["vec_id"]: r for r in queries.op4_lattice_near_duplicates(spark, sf).collect()}
    assert len(got) == len(rows)
    found, n = np.array([got[i]["n_links"] for i in ids]), links.sum(1)
    assert (found <= n).all() and found.sum() >= 0.99 * n.sum()
    part = label(len(ids), *np.nonzero(links))
    least = {c: ids[part == c].min() for c in set(part.tolist())}
    assert all(got[i]["component_id"] == least[c] and got[i]["kept"] == (i == least[c]) for i, c in zip(ids.tolist(), part.tolist(), strict=True) if found[ids == i][0] == n[ids == i][0])


def covered(texts, width=50):
    """Which bytes of each (id, bytes) stand in a window of a smaller id's."""
    low: dict[bytes, int] = {}
    for i, b in sorted(texts):
        for a in range(len(b) - width + 1):
            low.setdefault(b[a : a + width], i)
    out = {}
    for i, b in texts:
        m = np.zeros(len(b) + 1, np.int64)
        for a in range(len(b) - width + 1):
            if low[b[a : a + width]] < i:
                m[a] += 1
                m[a + width] -= 1
        out[i] = np.cumsum(m[:-1]) > 0
    return out


def test_op5(spark, docs):
    texts = [(i, (r["text"] or "").encode()) for i, r in docs.items()]
    cut, want = covered(texts), {}
    for i, b in texts:
        m = cut[i]
        kept = np.frombuffer(b, np.uint8)[~m].tobytes()
        want[i] = (len(b), int(m.sum()), int((m & ~np.concatenate([[False], m[:-1]])).sum()) if len(m) else 0, hashlib.sha256(kept).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.op5_induced_suffix_dedup(spark, SF).collect()}
    assert got == want


def test_op6(spark, docs):
    got = queries.op6_feistel_shards(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        b = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(b) + 8, zlib.crc32(b), "rows", None)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(24)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


@pytest.mark.parametrize(("name", "label_", "by", "out", "bar"), [("op7_convolutional_toxicity", "toxic", 3, 1, 0.7), ("op8_attention_quality", "quality", 5, 0, 0.3)])
def test_op7_op8(spark, docs, name, label_, by, out, bar):
    got = {r["doc_id"]: r for r in queries.QUERIES[name](spark, SF).collect()}
    assert sorted(got) == sorted(docs)
    assert all(r["held_out"] == held(i, by, out) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= bar) for i, r in got.items())
    texts = defaultdict(set)
    for i, r in got.items():
        texts[docs[i]["text"] or ""].add(r["score"])
    assert all(len(s) == 1 for s in texts.values())  # equal texts, of whatever language or source


def test_op9(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    got = queries.op9_seekable_warc(spark, SF).toPandas()
    want = con.execute(queries.ORACLE_SQL["op9_seekable_warc"]).df()
    plain = lambda d: sorted((int(r.page_id), int(r.payload_bytes), r.payload_digest, r.record_type, -1 if pd.isna(r.refers_to) else int(r.refers_to)) for r in d.itertuples())
    assert plain(got) == plain(want)


def classes(texts, threshold=0.8):
    """Each id's class by all pairs: equal words or aligned labelled 5-word runs at the threshold."""
    ids = [i for i, _ in texts]
    data = [t.encode() for _, t in texts]
    gram = [ordermin.kmers(np.frombuffer(b, np.uint8), np.array([0, len(b)]), 5)[0] for b in data]
    keys = [ordermin.keys(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0] for b in data]
    a, b = [], []
    for x in range(len(ids)):
        for y in range(x):
            if keys[x] == keys[y] or (len(gram[x]) and len(gram[y]) and ordermin.linked(gram[x], gram[y], threshold)):
                a.append(x), b.append(y)
    order = np.argsort(ids)
    rank = np.empty(len(ids), int)
    rank[order] = np.arange(len(ids))
    part = label(len(ids), rank[a], rank[b]) if a else np.arange(len(ids))
    return {ids[k]: ids[order[part[rank[k]]]] for k in range(len(ids))}


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_op10(spark, sf):
    """At ten tables and 0.8 hardly a pair of all is lost; a class that comes apart counts every document that moves."""
    rows = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = classes(rows)
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in queries.op10_order_minhash(spark, sf).collect()}
    assert len(got) == len(rows) and all(k == (i == c) for i, (c, k) in got.items())
    assert sum(got[i][0] != c for i, c in want.items()) <= 0.01 * sum(i != c for i, c in want.items())
    assert all(want[got[i][0]] == c for i, c in want.items())  # no class holds what no link joins


def kneser_ney(texts):
    """log p of each text under a modified Kneser-Ney model of byte 5-grams of all of them."""
    counts: list[Counter] = [Counter() for _ in range(6)]
    data = [bytes(4) + t.encode() for t in texts]
    for b in data:
        counts[5].update(b[i - 4 : i + 1] for i in range(4, len(b)))
    for n in (4, 3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    prob = {b"": 1 / 256}
    for n in range(1, 6):
        c = [0, *(sum(v == k for v in counts[n].values()) for k in (1, 2, 3, 4))]
        y = c[1] / (c[1] + 2 * c[2]) if c[1] and c[2] else 0.5
        d = [max(0.05, min(k - 0.05, k - (k + 1) * y * (c[k + 1] / c[k] if c[k] else 0.5))) for k in (1, 2, 3)]
        total, left = Counter(), Counter()
        for g, k in counts[n].items():
            total[g[:-1]] += k
            left[g[:-1]] += d[min(k, 3) - 1]
        prob |= {g: (k - d[min(k, 3) - 1] + left[g[:-1]] * prob[g[1:]]) / total[g[:-1]] for g, k in counts[n].items()}
    return [sum(np.log(prob[b[i - 4 : i + 1]]) for i in range(4, len(b))) for b in data]


def rules(rows):
    """The rows (id, text, lang) that the rules keep, and the ids too near a band's edge to tell."""
    kept, near = [], set()
    for lang in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == lang]
        n = np.array([len(r[1].encode()) for r in own])
        entropy = np.round(-np.array(kneser_ney([r[1] for r in own])) / np.maximum(n, 1), 3)
        good = np.array([not base(r[1])[2] for r in own])
        sure = np.sqrt(n / (n + 400))
        mid = np.median(entropy[good]) if good.any() else 0
        spread = max(0.02, 1.4826 * np.median(np.round(np.abs(entropy - mid)[good] * sure[good], 3))) if good.any() else 0.02
        off = (entropy - mid) * sure / spread
        kept += [r for r, g, o in zip(own, good, off, strict=True) if g and -6 <= o <= 4]
        near |= {r[0] for r, o in zip(own, off, strict=True) if min(abs(o + 6), abs(o - 4)) < 0.15}
    return kept, near


def test_pipeline(spark, docs):
    """All stages after the classifier by brute force, on what its verdicts leave."""
    d = spark.read.parquet(f"{SF}/documents.parquet")
    passed = {r["doc_id"] for r in quality.score(d, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    rows = [(i, r["text"] or "", r["lang"]) for i, r in sorted(docs.items()) if i in passed]
    kept, near = rules(rows)
    stage = dict(corpus_pipeline.STAGES)
    got = {r["doc_id"] for r in stage["quality_rules"](spark, d.where(d["doc_id"].isin(sorted(passed))), SF).collect()}
    assert got ^ {r[0] for r in kept} <= near
    kept = [r for r in rows if r[0] in got]  # of those at an edge, as they fell
    first = classes([(i, t) for i, t, _ in kept])
    single = [(i, t) for i, t, _ in kept if first[i] == i]
    cut = covered([(i, t.encode()) for i, t in single])
    left = [(i, np.frombuffer(t.encode(), np.uint8)[~cut[i]].tobytes().decode("utf-8", "ignore")) for i, t in single]
    want = list(pieces((i, t) for i, t in left if t))
    sound(corpus_pipeline.run(spark, SF).collect(), want)
