"""Operators by sweeps, strips and scan lines against brute force."""

import math
import random
import statistics

import numpy as np
import pytest

from thermograph.operators import drawing as D
from thermograph.operators import faces as Fc
from thermograph.operators import intervals as I
from thermograph.plans import exterior as X
from thermograph.plans import topology as T


@pytest.mark.parametrize("tile", [8, 256])
def test_zonal_stats_of_sparse_cells(spark, tile):
    rng = random.Random(3)
    cells = {(p, x, y): rng.random() for p in (1, 2) for x in range(40) for y in range(25) if rng.random() < 0.6}
    rows = [(*k, v) for k, v in cells.items()] + [(1, 3, 3, 0.25), (1, 4, 4, None)]
    bands = [(rng.choice((1, 2, 3)), i, x, y, x + rng.randrange(40), y + rng.randrange(9)) for i, (x, y) in enumerate((rng.randrange(-4, 45), rng.randrange(-4, 28)) for _ in range(150))]
    bands += bands[:3] + [(1, 900, 5, 0, 6, 24), (1, 901, 9, 9, 8, 9)]
    got = D.zonal_stats(spark.createDataFrame(rows, "page_id int, x int, y int, value double"), spark.createDataFrame(bands, "page_id int, band_id int, bx0 int, by0 int, bx1 int, by1 int"), tile).collect()
    want = []
    for p, i, a, b, c, d in bands:
        v = [r[3] for r in rows if r[3] is not None and r[0] == p and a <= r[1] <= c and b <= r[2] <= d]
        if v:
            want.append((p, i, statistics.fmean(v), float(np.percentile(v, 90)), max(v), len(v)))
    near = lambda rows: sorted((p, i, round(m, 9), round(q, 9), round(x, 9), n) for p, i, m, q, x, n in rows)
    assert near(map(tuple, got)) == near(want)


def test_wall_stretches_between_changes(spark):
    rng = random.Random(5)
    edges = [(1, f"e{i}", "horizontal", i % 3, a, a + rng.randint(1, 90)) for i, a in enumerate(rng.randrange(60) for _ in range(12))]
    line = lambda: (1, "horizontal", rng.randrange(3), (a := rng.randrange(150)), a + rng.randint(1, 40))
    walls = [(*line(), f"w{rng.randrange(12)}") for _ in range(60)]
    bridges = [line() for _ in range(12)]
    got = X.real_wall_segments(spark.createDataFrame(edges, "page_id int, edge_id string, orientation string, fixed int, e0 int, e1 int"),
                               spark.createDataFrame(walls, "page_id int, orientation string, fixed int, axis_start int, axis_end int, wall_id string"),
                               spark.createDataFrame(bridges, "page_id int, orientation string, fixed int, axis_start int, axis_end int"), 16).collect()
    want = []
    for _, e, _, f, a, z in edges:
        run = None
        for p in range(a, z + 1):
            ids = tuple(sorted({w[5] for w in walls if w[2] == f and w[3] <= p < w[4]})) if p < z and not any(b[2] == f and b[3] <= p < b[4] for b in bridges) else ()
            if run and run[1] != ids:
                want.append((e, run[0], p, run[1]))
                run = None
            if ids and not run:
                run = (p, ids)
    assert sorted((r.edge_id, r.axis_start, r.axis_end, tuple(r.source_wall_ids)) for r in got) == sorted(want) and want


def test_running_sums_across_tiles(spark):
    rng = random.Random(6)
    rows = [(k, at, rng.randrange(9)) for k in "ab" for at in rng.sample(range(200), 40)]
    got = I.running_sums(spark.createDataFrame(rows, "k string, at int, n int"), ["k"], ["at"], __import__("pyspark").sql.functions.expr("floor(at / 16)"), ["n"], "at").collect()
    for r in got:
        own = sorted(x for x in rows if x[0] == r.k)
        assert r.n_run == sum(x[2] for x in own if x[1] <= r.at) and r._next == min((x[1] for x in own if x[1] > r.at), default=None)


def plain_scale(c):
    many, ocr = len(c) >= 3, any(x[5] for x in c)
    s = lambda x: x[3] / x[4]
    if many and ocr:
        clusters = [(x, [y for y in c if abs(s(y) - s(x)) / ((s(y) + s(x)) / 2) <= 0.02]) for x in sorted(c, key=lambda x: x[1])]
        best = max(clusters, key=lambda k: (len(k[1]), round(sum(y[4] for y in k[1]), 6)))[1]
        if len(best) >= 2 and len({y[2] for y in best}) == 2:
            c = best
    pick = [max((x for x in c if x[2] == o), key=lambda x: (x[3], -x[1]), default=None) for o in ("horizontal", "vertical")]
    if not any(pick):
        return "manual_required", None, 0.0
    if not all(pick):
        return "confirmation_required", s(next(filter(None, pick))), 0.5
    x, y = map(s, pick)
    d = abs(x - y) / ((x + y) / 2)
    return ("confirmed", (x + y) / 2, 0.95) if d <= 0.02 + 1e-9 else ("confirmation_required", (x + y) / 2, 0.65) if d <= 0.05 + 1e-9 else ("conflict", None, 0.0)


def test_scale_calibration_is_plain(spark):
    rng = random.Random(9)
    rows = [(p, p * 100 + i, rng.choice(("horizontal", "vertical")), rng.choice((1.5, 2.0, 3.25, 8.0)), 0.0, rng.random() < 0.3) for p in range(60) for i in range(rng.randrange(9))]
    rows = [(*r[:4], r[3] * 100 * (1 + rng.choice((0, 0.004, 0.013, 0.03, 0.07, 2.0))), r[5]) for r in rows] + [(7, 999, "vertical", None, 3.0, False), (7, 998, "vertical", 1.0, 0.0, False)]
    pages = spark.createDataFrame([(p,) for p in range(62)], "page_id int")
    got = {r.page_id: (r.status, r.scale_m_per_px, r.confidence) for r in D.scale_calibration(spark.createDataFrame(rows, "page_id int, cand_id int, orientation string, metres double, span_px double, is_ocr boolean"), pages).collect()}
    for p in range(62):
        status, scale, confidence = plain_scale([r for r in rows if r[0] == p and r[3] and r[4]])
        assert got[p][0] == status and got[p][2] == confidence and (scale is None) == (got[p][1] is None) and math.isclose(scale or 0, got[p][1] or 0, rel_tol=1e-12), p


def outline(points):
    return [(*a, *b) for a, b in zip(points, points[1:] + points[:1])]


def test_scan_lines_of_odd_polygons(spark):
    comb = [(0, 0), (30, 0), (30, 20), (24, 20), (24, 6), (18, 6), (18, 20), (12, 20), (12, 6), (6, 6), (6, 20), (0, 20)]
    shapes = {1: comb, 2: [(19, 7), (23, 7), (23, 12), (19, 12)], 3: [(1, 1), (5, 1), (5, 4), (1, 4)], 4: [(7, 7), (11, 7), (11, 9), (7, 9)], 5: [(6, 1), (9, 1), (9, 3), (6, 3)], 6: [(1.5, 7.25), (4.5, 7.25), (4.5, 9.75), (1.5, 9.75)]}
    edges = spark.createDataFrame([(1, k, *map(float, e)) for k, p in shapes.items() for e in outline(p)], "page_id int, face_id int, x0 double, y0 double, x1 double, y1 double")
    cells = [(1, x, y, float(x * 31 % 17 + y)) for x in range(32) for y in range(22) if (x + y) % 3]
    got = {r.face_id: (round(r["mean"], 9), r.n_cells) for r in Fc.face_footprint_mean(edges, spark.createDataFrame(cells, "page_id int, x int, y int, value double")).collect()}

    def inside(p, x, y):
        return sum(a[0] == b[0] and a[0] <= x and min(a[1], b[1]) <= y < max(a[1], b[1]) for a, b in zip(p, p[1:] + p[:1])) % 2 == 1

    for k, p in shapes.items():
        v = [c[3] for c in cells if inside(p, c[1] + 0.5, c[2] + 0.5)]
        assert got[k] == (round(statistics.fmean(v), 9), len(v))
    nested = Fc.nested_outlines(edges.withColumnRenamed("face_id", "poly_id"), 8).collect()
    assert sorted((r.outer, r.inner) for r in nested) == [(1, 3), (1, 5), (1, 6)]


def test_crossed_edges_that_share_an_id(spark):
    edges = [(1, 7, "horizontal", 50, 0, 100, [1]), (1, 7, "horizontal", 90, 0, 100, [1]), (1, 8, "vertical", 10, 0, 20, [9])]
    bands = [(1, "vertical", 40, 30, 60, [3])]
    e = spark.createDataFrame(edges, "page_id int, edge_id int, orientation string, fixed int, axis_start int, axis_end int, anchor_ids array<int>")
    b = spark.createDataFrame(bands, "page_id int, orientation string, fixed int, axis_start int, axis_end int, source_ids array<int>")
    assert sorted((r.edge_id, r.fixed) for r in Fc.edge_crosses_band_anti(e, b).collect()) == [(7, 90), (8, 10)]


WALL = "page_id int, wall_id string, orientation string, fixed int, axis_start int, axis_end int, inside_direction string"
GAP = "page_id int, gap_id string, orientation string, fixed int, gap_start int, gap_end int, host_ids array<string>, decision string"
OPENING = "page_id int, opening_id string, orientation string, fixed int, gap_start int, gap_end int, host_ids array<string>"
EDGE = "page_id int, inference_id string, edge_group_id string, edge_group_size int, orientation string, fixed int, axis_start int, axis_end int, decision string, mean_difference double, reason_codes array<string>"
PAGE = "page_id int, left int, top int, right int, bottom int, image_w int, image_h int, scale double"


def test_topology_of_odd_pages(spark):
    """1 two pending openings on a gap, 2 half an inferred group, 3 a rival outline, 4 no wall, 5 a face outside the region, 6 an inferred edge too long, 7 a gap without an axis."""
    def room(p, x0, y0, x1, y1, cut=()):
        rows = [(p, f"l{x0}", "vertical", x0, y0, y1, None), (p, f"r{x1}", "vertical", x1, y0, y1, None), (p, f"b{x0}", "horizontal", y1, x0, x1, None)]
        at = x0
        for n, (a, b) in enumerate([*cut, (x1, x1)]):
            rows.append((p, f"t{x0}.{n}", "horizontal", y0, at, a, None))
            at = b
        return rows

    walls = room(1, 10, 10, 110, 90, [(40, 52)]) + room(2, 10, 10, 210, 190, [(40, 60), (100, 120)]) + room(3, 10, 10, 110, 90) + room(3, 110, 10, 205, 90) + room(5, 10, 10, 410, 90) + room(6, 10, 10, 60, 50, [(12, 58)]) + room(7, 10, 10, 110, 90, [(40, 52)])
    hosts = ["a", "b"]
    gaps = [(1, "g1", "horizontal", 10, 40, 52, hosts, "accepted_gap"), (7, "g7", None, 10, 40, 52, hosts, "accepted_gap"), (7, "g8", "horizontal", 10, 40, 52, hosts, "rejected_gap")]
    pending = [(1, f"p{i}", "horizontal", 10, 40, 52, hosts[::-1]) for i in (1, 2)]
    inferred = [(2, "i1", "g", 2, "horizontal", 10, 40, 60, "accepted_candidate", 0.5, ["x"]), (2, "i2", "h", 1, "horizontal", 10, 100, 120, "accepted_candidate", 0.5, ["x"]), (6, "i6", "k", 1, "horizontal", 10, 12, 58, "accepted_candidate", 0.5, ["x"])]
    pages = [(p, 0, 0, 300, 300, 300, 300, None) for p in range(1, 8)]
    make = spark.createDataFrame
    cells = make([(p, x, y, 1.0) for p in range(1, 8) for x in range(5, 420, 10) for y in range(5, 200, 10)], "page_id int, x int, y int, value double")
    t = T.close_pages(make(walls, WALL), make(gaps, GAP), make([], OPENING), make(pending, OPENING), make(inferred, EDGE), cells, make(pages, PAGE), 300, 300)
    got = {r.page_id: (r.status, r.stage, r.area) for r in t["pages"].collect()}
    tries = {(r.page_id, r.stage): (r.status, r.reasons) for r in t["tries"].collect()}
    closed, open_ = "review_required", "exterior_not_closed"
    assert got == {1: (open_, "walls", None), 2: (closed, "endpoint_links", 36000.0), 3: ("ambiguous_exterior", "walls", None), 4: ("no_exterior_wall_evidence", "walls", None), 5: (open_, "walls", None), 6: (closed, "endpoint_links", 2000.0), 7: (open_, "walls", None)}
    assert tries[2, "inference"] == (open_, ["incomplete_inferred_edge_group"]) and tries[6, "inference"] == (open_, ["inferred_perimeter_ratio_exceeded"])
    assert (4, "endpoint_links") not in tries and tries[4, "envelope"][0] == open_
    bridges, unresolved = T.bridges_of(make(gaps, GAP), make([], OPENING), make(pending, OPENING), make(pages, PAGE))
    assert bridges.count() == 0 and {r.gap_id: r.reason for r in unresolved.collect()} == {"g1": "multiple_matching_pending_openings", "g7": "corner_gap_requires_turn", "g8": "gap_rejected"}
