"""Ranked search against a ranking of all documents by plain integers, and against its SQL."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from corvane.llm import impacts, queries

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def said(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(docs, asked, k):
    """(item, rank, doc, score), every document scored for every query."""
    tf = [(i, Counter(said(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    items = {}
    for q, t in asked:
        items.setdefault(q, set()).update(said(t))
    out = []
    for q, own in items.items():
        found = []
        for i, c in tf:
            m = 50 + (50 * sum(c.values()) * n) // max(1, total)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                found.append((-score, i is not None, i or 0, i))
        out += [(q, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return out


def rows(got):
    return sorted(map(tuple, got.collect()), key=str)


@pytest.fixture(scope="module")
def odd(spark):
    """Texts of common and rare words: copies, null and empty ones, repeated and null ids, a very long one, clashing columns."""
    rng = random.Random(6)
    words = ["the", "Of", "été", "x1", "naïve"] + [f"w{i}" for i in range(60)]
    say = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=n))
    docs = [(i, say(rng.randint(1, 60))) for i in range(150)] + [(500 + i, "the same W7 w9") for i in range(40)]
    docs += [(None, "w7 w9"), (None, "w7"), (3, "w7 w9, w59!"), (901, None), (902, ""), (903, "-- ?"), (904, say(40_000)), (905, "w7 " * 3000), (906, "W7\x7fw9")]
    asked = [(1, "w7 w9"), (2, "THE of été"), (2, "x1"), (3, ""), (4, None), (5, "nowhere"), (None, "w59 naïve"), (-1, "w58"), (6, say(300))]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "item_id long, text string")
    for name in ("id", "term", "score", "rank", "place", "x", "n", "total"):
        d, q = d.selectExpr("*", f"'clash' as {name}"), q.selectExpr("*", f"'clash' as {name}")
    return docs, asked, d, q


@pytest.mark.parametrize(("k", "block", "lot"), [(5, 2 << 20, 500), (50, 700, 2), (1, 5000, 500), (10_000, 3000, 500)])
def test_odd_rows(odd, k, block, lot):
    docs, asked, d, q = odd
    assert rows(impacts.search(impacts.build(d, block_bytes=block), q, k, lot=lot)) == sorted(brute(docs, asked, k), key=str)


def test_empty_tables(odd):
    _, _, d, q = odd
    index = impacts.build(d.where("false"))
    assert impacts.search(index, q).collect() == [] and impacts.search(impacts.build(d), q.where("false")).collect() == []
    assert impacts.search(impacts.build(d.where("text is null")), q).collect() == []


def test_stored_index(spark, odd, tmp_path):
    docs, asked, d, q = odd
    impacts.build(d, path=str(tmp_path / "index"), block_bytes=4000)
    assert rows(impacts.search(spark.read.parquet(str(tmp_path / "index")), q, 7)) == sorted(brute(docs, asked, 7), key=str)


def test_bytes_bound_the_impact():
    tf, m = np.meshgrid(np.arange(1, 400), np.unique(np.geomspace(50, 10**9, 400).astype(np.int64)))
    exact = impacts.impact(tf, m)
    byte = -(-exact * impacts.STEPS // impacts.MOST)
    assert exact.max() <= impacts.MOST and byte.max() <= impacts.STEPS
    assert (impacts.LOWER[byte] <= exact).all() and (exact <= impacts.UPPER[byte]).all()
    assert (impacts.UPPER - impacts.LOWER <= -(-impacts.MOST // impacts.STEPS)).all()


def test_few_documents_are_scored_again(spark):
    """The first level leaves few documents to the second."""
    sf = "/root/testdata/sf0.01"
    index = impacts.build(spark.read.parquet(f"{sf}/documents.parquet"))
    blocks = [r.asDict() for r in index.collect()]
    n, total = sum(b["n_docs"] for b in blocks), sum(b["n_terms"] for b in blocks)
    assert (n, total) == (sum(bool(said(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()), sum(len(said(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()))
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()
    h, _ = impacts.terms(np.frombuffer(item["text"].encode(), np.uint8), np.array([0, len(item["text"].encode())]))
    asked = impacts.Asked([0], np.zeros(len(h), np.int64), h)
    df = np.zeros(len(asked.terms), np.int64)
    for b in blocks:
        found, at = asked.met(np.frombuffer(b["terms"], np.uint64))
        df[found] += np.diff(np.frombuffer(b["starts"], np.uint32).astype(np.int64))[at]
    asked.weigh(n, df)
    ends = []
    for table in (impacts.LOWER, impacts.UPPER):
        ends.append(np.concatenate([s[0] for b in blocks for _, s, *_ in impacts._scores(asked, b, lambda post, b=b, t=table: t[np.frombuffer(b["impacts"], np.uint8)[post]])]))
    bar = np.sort(ends[0])[-50]
    assert 50 <= (ends[1] >= bar).sum() <= 0.2 * n


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert rows(queries.op11_quantised_ranking(spark, sf)) == sorted(con.execute(queries.ORACLE_SQL["op11_quantised_ranking"]).fetchall(), key=str)
