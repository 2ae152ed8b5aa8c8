"""Near-duplicates and suffix dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import lattice, ordermin, suffixdedup
from corvane.llm.components import components, label
from corvane.llm.induced import Sorter

DOCS = "doc_id long, text string, component_id string"


def test_induced_order_and_prefixes():
    rng = np.random.default_rng(0)
    for trial in range(60):
        n, top = int(rng.integers(1, 90)), int(rng.integers(1, 6))
        t = np.append(rng.integers(1, top + 1, n), 0).astype(np.uint16)
        if trial % 3 == 0:
            t = np.append(np.tile(t[:-1], 4), 0).astype(np.uint16)
        limit = int(rng.integers(3, 60))
        blocks = list(Sorter(t, top + 1, limit, int(rng.choice([1, 5, 20, 10**6]))).descending())  # the small ones recurse and go to disk
        pos, lcp = np.concatenate([p for p, _ in blocks]), np.concatenate([x for _, x in blocks])
        assert sorted(pos.tolist()) == list(range(len(t)))
        cut = [t[i : i + limit].tolist() for i in pos.tolist()]
        for k in range(1, len(cut)):
            assert cut[k - 1] >= cut[k]
            same = next((c for c, (a, b) in enumerate(zip(cut[k - 1], cut[k], strict=False)) if a != b), min(len(cut[k - 1]), len(cut[k])))
            assert same == lcp[k]


def cases():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    shared = " ".join(word() for _ in range(60))
    rows = []
    for i in range(60):
        t = " ".join(word() for _ in range(rng.randint(0, 120)))
        if i % 4 == 0:
            t = t[:80] + shared + t[80:]
        rows.append((i, t, "x"))
    rows += [(60 + k, rows[8][1], "copy") for k in range(9)] + [(70, "ab " * 100, ""), (71, "ab " * 90, ""), (72, None, ""), (73, "", ""), (None, shared, "")]
    return rows + [(8, rows[8][1], "same row again")]


@pytest.mark.parametrize("chunk", [1 << 20, 900])
def test_suffix_dedup(spark, monkeypatch, chunk):
    monkeypatch.setattr(suffixdedup, "CHUNK", chunk)
    rows = cases()
    low: dict[bytes, int] = {}
    for i, t, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for a in range(len(b) - 49):
            low.setdefault(b[a : a + 50], i)
    want = []
    for i, t, _ in rows:
        b = (t or "").encode()
        m = bytearray(len(b))
        for a in range(len(b) - 49):
            if i is not None and low[b[a : a + 50]] < i:
                m[a : a + 50] = b"\1" * 50
        spans = sum(m[k] and (k == 0 or not m[k - 1]) for k in range(len(m)))
        want.append((str(i), len(b), sum(m), spans, hashlib.sha256(bytes(c for c, f in zip(b, m, strict=True) if not f)).hexdigest()))
    got = [(str(r[0]), *r[1:]) for r in suffixdedup.digest(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(got) == sorted(want)
    assert suffixdedup.digest(spark.createDataFrame([], DOCS)).count() == 0


def test_order_minhash_classes(spark):
    rng = random.Random(9)
    base = [[f"w{rng.randint(0, 500)}" for _ in range(150)] for _ in range(12)]
    rows = []
    for i in range(60):
        w = list(base[i % 12])
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = "new"
        rows.append((i, " ".join(w), "c"))
    rows += [(100, "", ""), (101, None, ""), (102, "!!!", ""), (103, "one two", ""), (104, "One, two.", ""), (None, rows[0][1], ""), (3, rows[3][1], "")]
    df = spark.createDataFrame(rows, DOCS)
    found = ordermin.near_duplicates(df, tables=20, block=7).collect()
    assert len(found) == len(rows)
    comp = {r["doc_id"]: r["component_id"] for r in found}
    gram = lambda t: {tuple(t.split()[a : a + 5]) for a in range(max(1, len(t.split()) - 4))}
    for i in range(60):
        for j in range(i):
            a, b = gram(rows[i][1]), gram(rows[j][1])
            if len(a & b) / len(a | b) >= 0.83:
                assert comp[i] == comp[j]
            if i % 12 != j % 12:
                assert comp[i] != comp[j]
    assert comp[100] == comp[101] == 100 and comp[102] == 102 and comp[103] == comp[104] == 103 and comp[None] is None
    assert ordermin.near_duplicates(df.where("false")).count() == 0


def test_lattice_links(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 64))
    x = np.concatenate([base, base[:20] + 0.02 * rng.normal(size=(20, 64)), base[:5], np.zeros((1, 64))]).astype(np.float32)
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(500, None, 1), (501, [float("nan")] * 64, 1), (502, [1.0], 1), (None, [float(v) for v in x[0]], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rep int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in lattice.near_duplicates(df, block=3).collect()}
    n = len(x)
    u = x.astype(float) / np.maximum(np.linalg.norm(x.astype(float), axis=1), 1e-300)[:, None]
    g = u @ u.T >= 0.95
    np.fill_diagonal(g, False)
    comp = label(n, *np.nonzero(g))
    for i in range(n):
        assert got[i] == (g[i].sum(), comp[i], comp[i] == i)
    assert got[500] == (0, 500, True) and got[501][0] == 0 and got[502][0] == 0 and got[None] == (0, None, False)
    assert lattice.near_duplicates(df.where("false")).count() == 0


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r["node"]: r["component_id"] for r in components(links).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[1001] == 1000


def shard_of(snippets, docs, width, memory):
    shard = suffixdedup.Shard(width, memory)
    for k in range(0, len(snippets), 50):
        part = snippets[k : k + 50]
        shard.add(docs[k : k + 50].astype("<i8").tobytes(), np.zeros(len(part), "<i8").tobytes(), np.array([len(x) for x in part], "<i4").tobytes(), b"".join(part))
    return shard


@pytest.mark.parametrize("memory", [1, 7, 300, 10**6])
def test_shard_larger_than_memory(memory):
    rng = np.random.default_rng(memory)
    pool = [bytes(rng.choice(list(b"ab c"), 90).astype(np.uint8)) for _ in range(6)]
    snippets = [p[a : a + int(rng.integers(12, 60))] for p in pool for a in rng.integers(0, 30, 12)]
    docs = rng.permutation(len(snippets))
    width = 10
    low: dict[bytes, int] = {}
    for x, d in zip(snippets, docs, strict=True):
        for a in range(len(x) - width + 1):
            low[x[a : a + width]] = min(low.get(x[a : a + width], 10**9), d)
    want = {int(d): {b for a in range(len(x) - width + 1) if low[x[a : a + width]] < d for b in range(a, a + width)} for x, d in zip(snippets, docs, strict=True)}
    got: dict[int, set] = {int(d): set() for d in docs}
    shard = shard_of(snippets, docs, width, memory)
    for d, s, n in shard.spans():
        for x, a, k in zip(d.tolist(), s.tolist(), n.tolist(), strict=True):
            got[x] |= set(range(a, a + k))
    assert got == want
    assert (shard.store.spilled > 0) == (memory < 1000)


def test_suffix_dedup_of_spilled_shards(spark):
    df = spark.createDataFrame(cases(), "doc_id long, text string, component_id string")
    want = sorted(map(tuple, suffixdedup.digest(df).collect()), key=str)
    assert sorted(map(tuple, suffixdedup.digest(df, memory=50).collect()), key=str) == want


def test_suffix_dedup_of_repeated_ids(spark):
    long = " ".join(f"word{k}" for k in range(30))
    rows = [(1, long, "a"), (1, long, "b"), (2, "x " + long, "c"), (3, long + " one", "d"), (3, long + " two", "e"), (3, "short", "f"), (None, long, "g")]
    got = {r["row"]["component_id"]: r["kept_text"] for r in suffixdedup.clean(spark.createDataFrame(rows, DOCS), row=True).collect()}
    assert got == {"a": long, "b": long, "c": "x ", "d": long + " one", "e": long + " two", "f": "short", "g": long}


def test_order_minhash_as_registered(spark):
    rng = random.Random(11)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(3)]
    rows = []
    for i in range(120):  # 40 of each: more than are compared without a sample
        t = list(base[i % 3])
        t[rng.choice([0, -1])] = f"x{i}"
        rows.append((i, " ".join(t), ""))
    found = ordermin.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: i % 3 for i in range(120)}


def test_order_minhash_keeps_regular_texts_apart(spark):
    w = "a"
    for _ in range(11):
        w += w.translate({97: "b", 98: "a"})
    texts = [" ".join(w), " ".join(w.translate({97: "b", 98: "a"})), w, w.translate({97: "b", 98: "a"})]
    rows = [(i, t, "") for i, t in enumerate([*texts, *texts])]
    found = {r["doc_id"]: r["component_id"] for r in ordermin.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    ids = [ordermin.kmers(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), 5)[0] for t in texts[:2]]
    assert found == {i: (0 if i % 4 == 1 and ordermin.linked(*ids, 0.8) else i % 4) for i in range(8)}
    assert len({tuple(ordermin.keys(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))) for t in texts}) == 4


def test_rarest_misses_no_pair():
    """Every pair at the threshold is among the candidates, whatever the bucket."""
    rng = np.random.default_rng(4)
    for _ in range(40):
        base = [rng.choice(400, rng.integers(5, 60), replace=False) for _ in range(4)]
        seqs = []
        for _ in range(30):
            x = base[rng.integers(4)].copy()
            x[rng.integers(0, len(x), rng.integers(0, 4))] = rng.integers(1000, 1100)
            seqs.append(np.unique(x).astype(np.uint64))
        seqs.sort(key=len)
        rarest = ordermin.Rarest(seqs, 0.8)
        for y in range(len(seqs)):
            found = set(rarest.of(0, y).tolist())
            for x in range(y):
                both = len(np.intersect1d(seqs[x], seqs[y]))
                assert both / (len(seqs[x]) + len(seqs[y]) - both) < 0.8 or x in found


def test_order_minhash_repeated_ids(spark):
    rng = random.Random(2)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(50)) for _ in range(3))
    rows = [(5, a, ""), (5, b, ""), (5, a, ""), (2, b, ""), (9, c, ""), (9, c, "")]
    got = sorted(map(tuple, ordermin.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()))
    assert got == [(2, 2, True), (5, 2, False), (5, 5, True), (5, 5, True), (9, 9, True), (9, 9, True)]


def test_lattice_of_other_lengths_and_sizes(spark):
    rng = np.random.default_rng(6)
    rows = []
    for dim, first in ((128, 0), (3, 100), (64, 200)):
        base = rng.normal(size=(6, dim))
        near = base + 0.02 * rng.normal(size=base.shape)
        rows += [(first + i, [float(v) for v in x], "") for i, x in enumerate(np.concatenate([base, near]))]
    rows += [(300, [1e200] * 8, ""), (301, [1e-200] * 8, ""), (302, [5e-324] * 8, ""), (303, [-1e308] * 8, ""), (304, [0.0] * 8, ""), (305, [1.0, None], ""), (306, [], "")]
    rows += [(100, [1.0, 0.0, 0.0], "the id again")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string")
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in lattice.near_duplicates(df, block=4).collect())
    want = []
    for i, x, _ in rows:
        links = []
        for j, y, _ in rows:
            if y is not x and len(x) == len(y) and x and None not in x + y and any(x) and any(y):
                a, b = (np.array(v) / np.abs(v).max() for v in (x, y))
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95:
                    links.append(j)
        want.append((i, len(links)))
    assert [(i, n) for i, n, _ in got] == sorted(want)
    assert {c for i, _, c in got if i in (300, 301, 302)} == {300} and {c for i, _, c in got if i >= 303} == {303, 304, 305, 306}


def test_lattice_finds_pairs_just_over_the_threshold(spark):
    """Pairs planted at a cosine of 0.950 to 0.97, of several lengths of vectors: nearly all are found, and nothing below 0.95 is."""
    rng = np.random.default_rng(17)
    rows, wanted = [], {}
    for dim, many in ((64, 600), (128, 300), (768, 100)):
        base = rng.normal(size=(many, dim))
        base /= np.linalg.norm(base, axis=1)[:, None]
        side = rng.normal(size=(many, dim))
        side -= (side * base).sum(1)[:, None] * base
        side /= np.linalg.norm(side, axis=1)[:, None]
        # Every sixth pair lies just below.
        cos = np.where(np.arange(many) % 6 == 5, rng.uniform(0.93, 0.9499, many), rng.uniform(0.9501, 0.97, many))
        other = (cos[:, None] * base + np.sqrt(1 - cos**2)[:, None] * side) * rng.uniform(0.1, 50, many)[:, None]
        at = len(rows)
        for k in range(many):
            rows += [(at + 2 * k, base[k].tolist()), (at + 2 * k + 1, other[k].tolist())]
            wanted[at + 2 * k] = wanted[at + 2 * k + 1] = int(cos[k] >= 0.95)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in lattice.near_duplicates(df).collect()}
    assert all(got[i]["n_links"] <= n for i, n in wanted.items())
    found, all_ = sum(got[i]["n_links"] for i in wanted), sum(wanted.values())
    assert all_ > 1600 and found >= 0.99 * all_
    assert all(got[i]["component_id"] == i - i % 2 * got[i]["n_links"] for i in wanted)


def similar(a, b, threshold):
    """Longest common subsequence of labelled 5-word runs, as a share of all of them, by the whole table."""
    def runs(text):
        words = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
        grams = [tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))] if words else []
        seen: Counter = Counter()
        out = []
        for g in grams:
            out.append((g, seen[g]))
            seen[g] += 1
        return out

    x, y = runs(a), runs(b)
    last = [0] * (len(y) + 1)
    for g in x:
        row = [0]
        for k, h in enumerate(y):
            row.append(last[k] + 1 if g == h else max(last[k + 1], row[k]))
        last = row
    common = last[-1]
    return bool(x and y) and common / (len(x) + len(y) - common)


def test_order_minhash_by_an_alignment_of_its_own(spark):
    """Classes against all pairs, aligned by a plain table, of texts with edits that cross the threshold."""
    rng = random.Random(23)
    base = [[f"W{rng.randint(0, 300)}" for _ in range(rng.randint(40, 120))] for _ in range(9)]
    rows = []
    for i in range(54):
        words = list(base[i % 9])
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(words) - 6)
            kind = rng.randrange(3)
            words[k : k + (kind < 2)] = ["edit"] if kind else []
            if rng.random() < 0.2:
                words[k : k + 6] = words[k + 3 : k + 6] + words[k : k + 3]
        rows.append((i, ", ".join(words)))
    pairs = [(i, j, similar(rows[i][1], rows[j][1], 0.8)) for i in range(54) for j in range(i)]
    clear = [p for p in pairs if abs(p[2] - 0.8) > 1e-9]
    part = label(54, np.array([p[1] for p in clear if p[2] > 0.8]), np.array([p[0] for p in clear if p[2] > 0.8]))
    assert 10 < len(set(part.tolist())) < 50 and any(0.6 < p[2] < 0.8 for p in pairs)
    got = {r["doc_id"]: r["component_id"] for r in ordermin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), tables=40).collect()}
    assert [got[i] for i in range(54)] == part.tolist()


def test_shares_follow_the_size(spark):
    """Ten times the input has ten times the shards and buckets; what one holds stays."""
    assert suffixdedup.shares(0, 8) == (32, 8) and suffixdedup.shares(10**15, 8) == (-(-(10**15) // suffixdedup.SHARE),) * 2
    rng = random.Random(3)
    most = []
    for many in (40, 400):  # ten documents a shard either way
        rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(600))) for i in range(many)]
        shards, _ = suffixdedup.shares(many * suffixdedup.SHARE // 10, 1)
        asked = suffixdedup._ask(spark.createDataFrame(rows, "doc_id long, text string"), 50, 24, shards).where("shard >= 0")
        sizes = asked.groupBy("shard").agg(F.sum(F.octet_length("names")).alias("n")).collect()
        assert len(sizes) == shards
        most.append(max(r["n"] for r in sizes))
    assert most[1] < 1.3 * most[0]
