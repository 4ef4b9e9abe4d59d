"""Interval operators against brute force on random data."""

import random

import pytest
from pyspark.sql import functions as F

from thermograph.operators import drawing as D
from thermograph.operators import intervals as I


def merged(rows, tol=0):
    out = []
    for a, b in sorted(rows):
        if out and a <= out[-1][1] + tol:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


@pytest.mark.parametrize("tol,tile", [(0, 8), (3, 5), (0, 1000)])
def test_merge_matches_sequential_merge(spark, tol, tile):
    rng = random.Random(tol + tile)
    data = [(k, s, s + rng.randint(0, 30)) for k in ("a", "b") for s in (rng.randint(0, 400) for _ in range(60))]
    data += [("hot", 7, 9)] * 50 + [("hot", s, s + 200) for s in (0, 500, 700, 901)]
    got = I.merge_collinear(spark.createDataFrame(data, "k string, axis_start long, axis_end long"), ["k"], tol=tol, tile=tile).collect()
    for k in ("a", "b", "hot"):
        assert sorted((r.axis_start, r.axis_end) for r in got if r.k == k) == merged([x[1:] for x in data if x[0] == k], tol)
    assert sum(r.n_rows for r in got) == len(data)


def test_range_join_pairs_once(spark):
    rng = random.Random(4)
    mk = lambda n, p: [(i % 2, p + i, s, s + rng.randint(0, 50)) for i, s in enumerate(rng.randint(-100, 300) for _ in range(n))]
    a, b = mk(80, 0), mk(90, 1000)
    left = spark.createDataFrame(a, "k int, lid int, l0 int, l1 int")
    right = spark.createDataFrame(b, "k int, rid int, r0 int, r1 int")
    got = sorted((r.lid, r.rid) for r in I.range_join(left, right, ["k"], (F.col("l0"), F.col("l1")), (F.col("r0"), F.col("r1")), 16).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3])


def test_complement(spark):
    e = spark.createDataFrame([("p", 0, 100)], "k string, e0 long, e1 long")
    c = spark.createDataFrame([("p", 10, 20), ("p", 15, 40), ("p", 90, 130)], "k string, axis_start long, axis_end long")
    got = sorted((r.gap_start, r.gap_end) for r in I.coverage_complement(e, c, ["k"]).collect())
    assert got == [(0, 10), (40, 90)]


def test_intersections_symmetric(spark):
    rng = random.Random(1)
    rows = [(1, i, "horizontal" if i % 2 else "vertical", rng.randint(0, 60), s, s + rng.randint(0, 40)) for i, s in enumerate(rng.randint(0, 60) for _ in range(60))]
    got = {(r.h_id, r.v_id) for r in D.intersections(spark.createDataFrame(rows, "page_id int, seg_id int, orientation string, fixed int, axis_start int, axis_end int"), 8).collect()}
    want = {(h[1], v[1]) for h in rows for v in rows if h[2] == "horizontal" and v[2] == "vertical" and h[4] <= v[3] <= h[5] and v[4] <= h[3] <= v[5]}
    assert got == want


def test_islands_take_few_shuffles(spark):
    """Merging takes at most five shuffles."""
    rows = spark.range(2000).selectExpr("id % 3 AS k", "id * 7 % 900 AS axis_start", "id * 7 % 900 + id % 40 AS axis_end")
    out = I.merge_collinear(rows, ["k"])
    assert out.count() > 0
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    made = [x for x in final.splitlines() if "Exchange hashpartitioning" in x and "ReusedExchange" not in x]
    assert len(made) <= 5
