"""The nearest interval around each, against brute force, in one block and in many."""

from __future__ import annotations

import random
import time

import pytest

from corvane.operators import intervals

KIND = "file string, s long, e long, id long, callable boolean"


def brute(rows):
    out = {}
    for f, s, e, i, _ in rows:
        around = [(s2, -e2, i2, c2) for f2, s2, e2, i2, c2 in rows if None not in (f, s, e, f2, s2, e2) and f2 == f and s2 <= s and e2 >= e and (s2, e2) != (s, e)]
        out[i] = (max(around)[2], max(around)[3]) if around else (None, None)
    return out


def got(spark, rows, per):
    near = intervals.nearest_around(spark.createDataFrame(rows, KIND), "file", "s", "e", "id", "callable", per).collect()
    assert len(near) == len(rows)
    return {r["id"]: (r["near"], r["near_value"]) for r in near}


@pytest.mark.parametrize("per", [1000, 60, 7])
def test_like_brute_force(spark, per):
    rnd = random.Random(per)
    rows = []
    for i in range(400):
        s = rnd.randrange(60)
        rows.append((rnd.choice("aaaaab"), s, s + rnd.choice((0, 1, 5, 30, 90)), i, rnd.random() < 0.5))
    rows += [("a", -1, 500, 1000, True), ("nest", 5, 5, 2000, True), (None, 1, 2, 3000, False), ("a", None, 2, 3001, False), ("a", 3, None, 3002, None)]
    rows += [("nest", 5 - k, 5 + k, 2000 + k, bool(k % 2)) for k in range(1, 40)]
    rnd.shuffle(rows)
    assert got(spark, rows, per) == brute(rows)


def test_no_rows(spark):
    assert got(spark, [], 10) == {}


def test_one_file_of_many_chunks(spark):
    """100 000 functions, one after another in one class of one file: over ten blocks all find the class."""
    n = 100_000
    rows = [("f", 0, 10 * n, n, False)] + [("f", 10 * k + 1, 10 * k + 9, k, True) for k in range(n)]
    start = time.perf_counter()
    near = got(spark, rows, n // 10)
    assert set(near.values()) == {(n, False), (None, None)} and near[n] == (None, None)
    assert time.perf_counter() - start < 60
