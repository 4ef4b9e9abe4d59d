"""Iterative graph operators against sequential brute force."""

import random

from pyspark.sql import functions as F

from thermograph.operators import faces as Fc

SEG = "page_id int, {} long, orientation string, fixed double, axis_start double, axis_end double"


def test_components_on_paths_and_cycles(spark):
    edges = [(0, i, i + 1) for i in range(40)] + [(0, 100 + i, 100 + (i + 1) % 9) for i in range(9)] + [(1, 5, 6)]
    got = Fc.connected_components(spark.createDataFrame(edges, "g int, u long, v long"), ["g"]).groupBy("g", "component").count().collect()
    assert {(r.g, r.component): r["count"] for r in got} == {(0, 0): 41, (0, 100): 9, (1, 5): 2}


def test_faces_partition_the_outline(spark):
    rows = [(1, 1, "horizontal", 0.0, 0.0, 30.0), (1, 2, "horizontal", 20.0, 0.0, 30.0), (1, 3, "vertical", 0.0, 0.0, 20.0), (1, 4, "vertical", 30.0, 0.0, 20.0),
            (1, 5, "vertical", 12.0, 0.0, 20.0), (1, 6, "horizontal", 8.0, 12.0, 30.0), (1, 7, "horizontal", 15.0, 3.0, 9.0)]
    got = sorted(r.area for r in Fc.bounded_faces(spark.createDataFrame(rows, SEG.format("seg_id")), 8).collect())
    assert got == [18.0 * 8, 18.0 * 12, 12.0 * 20]


def test_greedy_bands_follow_id_order(spark):
    rng = random.Random(7)
    walls = [(0, i, rng.randint(0, 300)) for i in range(120)]
    founders, want = [], {}
    for _, i, f in walls:
        near = [x for x in founders if abs(x[1] - f) <= 16]
        if near:
            want[i] = min(near, key=lambda x: abs(x[1] - f))[0]
        else:
            founders.append((i, f))
            want[i] = i
    got = Fc.greedy_bands(spark.createDataFrame(walls, "page_id int, wall_id long, fixed int"), ["page_id"], 16).collect()
    assert {r.wall_id: r.band_founder for r in got} == want


def test_snapping_follows_line_order(spark):
    rng = random.Random(11)
    lines = []
    for i in range(60):
        s = rng.randint(0, 60)
        lines.append([1, i, "horizontal" if rng.random() < 0.5 else "vertical", float(rng.randint(0, 60)), float(s), float(s + rng.randint(5, 40))])
    state, snap = [list(x) for x in lines], 3.0
    for i, a in enumerate(state):
        for end in (4, 5):
            p = a[end]
            c = [(abs(b[3] - p), b[3]) for j, b in enumerate(state) if j != i and b[2] != a[2] and b[4] <= a[3] <= b[5] and 0 < abs(b[3] - p) <= snap]
            if c:
                best = {v for d, v in c if d == min(c)[0]}
                if len(best) == 1:
                    a[end] = best.pop()
    got = Fc.snap_endpoints(spark.createDataFrame([tuple(x) for x in lines], SEG.format("line_id")), snap).collect()
    assert {r.line_id: (r.axis_start, r.axis_end) for r in got} == {x[1]: (x[4], x[5]) for x in state}


def test_hull_area(spark):
    rng = random.Random(2)
    pts = [(1, float(rng.randint(1, 99)), float(rng.randint(1, 99))) for _ in range(200)] + [(1, 0.0, 0.0), (1, 100.0, 0.0), (1, 100.0, 100.0), (1, 0.0, 100.0)]
    assert Fc.convex_hull_area(spark.createDataFrame(pts, "d int, x double, y double"), ["d"], 16).first().hull_area == 10000.0


def test_outlines_that_cross_themselves(spark):
    square, bow = [(0, 0), (4, 0), (4, 4), (0, 4)], [(0, 0), (4, 4), (4, 0), (0, 4)]
    shapes = {1: square, 2: bow, 3: [(0, 0), (8, 0), (8, 3), (4, 3), (4, 6), (0, 6)], 4: [(0, 0), (8, 0), (8, 4), (3, 4), (3, -2), (1, -2), (1, 4), (0, 4)], 5: [(0, 0), (6, 0), (3, 0), (3, 3), (0, 3)],
              6: [(0, 0), (4, 0), (2, 3)], 7: [(0, 0), (4, 0), (4, 4), (2, 0), (0, 4)], 8: []}
    rows = [(k, [(float(x), float(y)) for x, y in p]) for k, p in shapes.items()]
    frame = spark.createDataFrame(rows, "page_id int, points array<struct<x:double,y:double>>")
    assert sorted(r.page_id for r in Fc.crossed_outlines(frame).collect()) == [2, 4, 5, 7]


def test_measures_may_differ_in_the_last_places(spark):
    import math

    pairs = [(b + k * math.ulp(b), b) for b in (1.0, 3.7, 1023.9999999999999, 1024.0, 1e-3, 9989.0) for k in (-6, -4, -3, 0, 3, 4, 6)]
    frame = spark.createDataFrame([(a, b, abs(a - b) <= 4 * math.ulp(b)) for a, b in pairs], "a double, b double, ok boolean")
    assert not [r for r in frame.withColumn("got", Fc.near_equal(F.col("a"), F.col("b"))).collect() if r.got != r.ok]


def test_gap_plans_stay_small(spark):
    """Each of the three takes twenty shuffles at most."""
    import __spark_entry__ as E

    for name in ("W6_exterior_gaps", "J10_gap_opening_match", "J16_perpendicular_crossing_anti"):
        plan = E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") + plan.count("Exchange SinglePartition") <= 20, name
