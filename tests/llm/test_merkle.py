"""The Merkle manifest against a tree built by hand, and against its SQL."""

from __future__ import annotations

import zlib
from hashlib import sha256

import duckdb
import pytest

from corvane.llm import merkle, queries

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(r, more=0):
    n = None if r["n_chars"] is None else r["n_chars"] + more
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], n, r["text"])])


def tree(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def steps(levels, k, fanout):
    for level in levels[:-1]:
        a = k - k % fanout
        run = level[a : a + fanout]
        yield k - a, run[: k - a] + run[k - a + 1 :]
        k //= fanout


def brute(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for g in order:
        own = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees.append((own, tree([leaf(r) for r in own], fanout)))
    crown = tree([t[-1][0] for _, t in trees], fanout)
    for g, (own, levels) in enumerate(trees):
        for k, r in enumerate(own):
            path = [*steps(levels, k, fanout), *steps(crown, g, fanout)]
            x = leaf(r, int(r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0))
            for a, others in path:
                x = digest(*others[:a], x, *others[a:])
            yield r["doc_id"], levels[0][k], levels[-1][0], crown[-1][0], digest(*[y for _, o in path for y in o]), x, x == crown[-1][0]


def same(got, rows, fanout=2):
    key = lambda t: tuple(map(str, t))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute([r.asDict() for r in rows.collect()], fanout), key=key)


@pytest.mark.parametrize("kw", [{}, {"bucket_rows": 10, "group": 4}, {"fanout": 3, "group": 30}])
def test_tables(spark, kw):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    same(merkle.manifest(docs, **kw), docs, kw.get("fanout", 2))


@pytest.mark.parametrize("kw", [{}, {"bucket_rows": 3, "group": 4}])
def test_odd_rows(spark, kw):
    """Null ids and groups, repeated rows and ids beyond a bucket, ids at both ends, other columns of clashing names."""
    rows = [(i, "a", f"x{i % 3}" if i % 5 else None, 5, "t") for i in range(40)] + [(None, None, None, None, None)] * 3
    rows += [(7, "s", "lone", None, "z"), (7, "q", "", 1, None), (-5, "r", "x1", 2, "é" * 50_000), (2**63 - 1, "r", "x1", 1, ""), (-(2**63), "r", "x1", 1, "")]
    rows += [(9, "r", "x1", 2, "same")] * 20 + [(9, "r", "x1", 2, f"other {k}") for k in range(20)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("tree", "at", "hash", "changed", "place", "n", "path", "root"):
        df = df.selectExpr("*", f"'clash' as {name}")
    same(merkle.manifest(df, **kw), df)


def test_few_rows(spark):
    one = spark.createDataFrame([(1, "s", "en", 2, "t"), (4, "s", "de", None, "u")], SCHEMA)
    for where in ("false", "doc_id = 1", "true"):
        same(merkle.manifest(one.where(where)), one.where(where))


def test_ranks_need_no_large_bucket(spark):
    """Ids of very different density: exact ranks, and no bucket over the bound is sorted."""
    ids = [*range(500), *range(10**12, 10**12 + 90), *(k * 10**9 for k in range(2, 60)), 7, 7, 7]
    df = spark.createDataFrame([("g" if i % 3 else "h", i, n) for n, i in enumerate(ids)], "g string, i long, n long")
    got, sizes = merkle.ranked(df, "g", ["i", "n"], 8)
    got = got.collect()
    for g in "gh":
        own = sorted((r for r in got if r["g"] == g), key=lambda r: (r["i"], r["n"]))
        assert [r["at"] for r in own] == list(range(len(own)))
    assert {r["g"]: r["n"] for r in sizes.collect()} == {g: sum(r["g"] == g for r in got) for g in "gh"}


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op13_radix_trie_manifest"]).fetchall()
    assert sorted(map(tuple, queries.op13_radix_trie_manifest(spark, SF).collect())) == sorted(want)
