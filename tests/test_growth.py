"""Steps whose work must follow the input: what leaves a step is counted, and results are compared with plain forms."""

import random
import re

from pyspark.sql import functions as F

import __spark_entry__ as E
from thermograph.operators import drawing as D
from thermograph.operators import faces as Fc
from thermograph.operators import relational as O
from thermograph.operators import web as Wb
from thermograph.plans import exterior as X
from thermograph.session import tune_session
from thermograph.streaming import limiter as Lm


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_planned_sizes_do_not_broadcast_exploded_rows(spark):
    tune_session(spark)
    few = spark.range(20000).select("id", F.explode(F.sequence(F.lit(1), F.lit(50))).alias("n"))
    many = spark.range(5_000_000).select("id")
    plan = many.join(few, "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    assert spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") != "-1"


def test_small_outlines_lie_in_one_tile(spark, monkeypatch):
    seen = []
    real = Fc.range_join
    monkeypatch.setattr(Fc, "range_join", lambda a, b, keys, ra, rb, bucket, *x: seen.append(a.select((F.floor(ra[1] / bucket) - F.floor(ra[0] / bucket) + 1).alias("n"))) or real(a, b, keys, ra, rb, bucket, *x))
    box = [(0.0, 0.0), (900.0, 0.0), (900.0, 700.0), (0.0, 700.0)]
    wide = [(float(i), float(i % 2)) for i in range(100)] + [(99.0, 50.0), (0.0, 50.0)]
    f = spark.createDataFrame([(1, box), (2, [box[0], box[2], box[1], box[3]]), (3, wide)], "page_id int, points array<struct<x:double,y:double>>")
    assert [r.page_id for r in Fc.crossed_outlines(f).collect()] == [2]
    f12 = f.filter("page_id < 3")
    seen.clear()
    Fc.crossed_outlines(f12)
    assert seen[0].agg(F.sum("n")).first()[0] == 8


def test_hulls_share_tasks(spark):
    rng = random.Random(5)
    pts = [(k, float(rng.randint(0, 40)), float(rng.randint(0, 40))) for k in range(60) for _ in range(rng.randint(1, 30))]

    def hull_area(p):
        p = sorted(set(p))
        def half(seq):
            out = []
            for q in seq:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(q)
            return out[:-1]
        h = half(p) + half(p[::-1]) if len(p) > 2 else []
        return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(h, h[1:] + h[:1]))) / 2
    df = Fc.convex_hull_area(spark.createDataFrame(pts, "d int, x double, y double"), ["d"], 8)
    assert {r.d: r.hull_area for r in df.collect()} == {k: hull_area([(x, y) for d, x, y in pts if d == k]) for k in range(60)}
    assert "FlatMapGroupsInPandas" not in plan_of(df)


def test_runs_agree_with_rows(spark):
    """Runs are filled as rows are: the row form is the measure."""
    rng = random.Random(3)
    spans, frames = [], []
    for page in range(30):
        top = rng.randint(0, 20)
        frames.append((page, top, top + rng.randint(5, 90)))
        for _ in range(rng.randint(1, 6)):
            s = rng.randint(0, 100)
            spans.append((page, s, s + rng.randint(0, 30), rng.randint(1, 4)))
    sp = spark.createDataFrame(spans, "page_id int, s long, z long, v long")
    fr = spark.createDataFrame(frames, "page_id int, top long, bottom long")
    runs = X.fill_runs(X.lowest_runs(sp, ["page_id"]), fr, ["page_id"])
    got = {(r.page_id, y): r.value for r in runs.collect() for y in range(r.y0, r.y1 + 1)}
    rows = []
    for page, top, bottom in frames:
        for y in range(top, bottom + 1):
            rows.append((page, y, min((v for p, s, z, v in spans if p == page and s <= y <= z), default=None)))
    want = X.fill_profile(spark.createDataFrame(rows, "page_id int, y long, value long"), ["page_id"]).collect()
    assert got == {(r.page_id, r.y): r.value for r in want if r.value is not None}
    runs = runs.orderBy("page_id", "y0").collect()
    assert all(a.value != b.value for a, b in zip(runs, runs[1:]) if a.page_id == b.page_id)


def test_lines_of_a_grid_give_the_means_of_its_cells(spark):
    rng = random.Random(11)
    boxes, lines, cells = [], [], []
    for page in range(3):
        for y in range(1, 40, 3):
            x0 = rng.randint(0, 5)
            v = [None if rng.random() < 0.1 else rng.random() for _ in range(15)]
            lines.append((page, y, x0, 2, v))
            cells += [(page, x0 + 2 * i, y, u) for i, u in enumerate(v)]
        for f in range(6):
            x, y, w, h = rng.randint(0, 20), rng.randint(0, 25), rng.randint(1, 15), rng.randint(1, 15)
            p = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
            boxes += [(page, f, *a, *b) for a, b in zip(p, p[1:] + p[:1])]
    edges = spark.createDataFrame(boxes, "page_id int, face_id int, x0 long, y0 long, x1 long, y1 long")
    rows = lambda c: {(r.page_id, r.face_id): (round(r["mean"], 9), r.n_cells) for r in Fc.face_footprint_mean(edges, c).collect()}
    assert rows(spark.createDataFrame(lines, "page_id int, y int, x0 int, step int, values array<double>")) == rows(spark.createDataFrame(cells, "page_id int, x int, y int, value double"))


def test_lone_lines_leave_the_face_search(spark):
    box = [(1, 1, "horizontal", 0, 0, 9), (1, 2, "horizontal", 9, 0, 9), (1, 3, "vertical", 0, 0, 9), (1, 4, "vertical", 9, 0, 9)]
    spur = [(1, 5, "horizontal", 4, 0, 3), (1, 6, "horizontal", 4, 3, 6)]  # the second hangs on the first
    lone = [(1, 100 + i, "horizontal", 20 + i, 0, 9) for i in range(50)]
    f = spark.createDataFrame(box + spur + lone, "page_id int, seg_id int, orientation string, fixed long, axis_start long, axis_end long")
    assert sorted(r.seg_id for r in Fc.meeting_lines(f).collect()) == [1, 2, 3, 4, 5, 6]
    r = Fc.bounded_faces(f).first()
    assert (r.area, r.perimeter, r.n_edges) == (81.0, 48.0, 9)


def plain_pairs(old, new, least):
    def iou(a, b):
        i = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
        return i / (a[2] * a[3] + b[2] * b[3] - i)
    return {(n[0], o[0]) for o in old for n in new if iou(o[1:], n[1:]) >= least}


def test_copies_of_a_region_are_compared_once(spark, monkeypatch):
    from thermograph.operators import drawing as D
    seen = []
    real = D.box_join
    monkeypatch.setattr(D, "box_join", lambda a, b, *x: seen.append((a, b)) or real(a, b, *x))
    old = [(i, 10 * (i % 3), 0, 20, 20) for i in range(30)]
    new = [(100 + i, 10 * (i % 3) + 1, 0, 20, 20) for i in range(30)]
    frame = lambda rows: spark.createDataFrame([(1, *r) for r in rows], "page_id int, region_id int, x int, y int, w int, h int")
    got = {(r.new_id, r.old_id) for r in D.region_matches(frame(old), frame(new)).collect()}
    assert got == plain_pairs(old, new, 0.8) and len(got) == 300
    assert [f.count() for f in seen[0]] == [3, 3]


def test_copies_of_a_polygon_are_compared_once(spark, monkeypatch):
    seen = []
    real = Fc.nested_outlines
    monkeypatch.setattr(Fc, "nested_outlines", lambda e, *x: seen.append(e) or real(e, *x))
    corners = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    rows = [(1, k, x, y, i) for k in range(20) for i, (x, y) in enumerate(corners(*((0, 0, 50) if k % 2 else (10, 10, 5))))]
    got = {(r.outer, r.inner) for r in Fc.nested_polygons(spark.createDataFrame(rows, "page_id int, poly_id int, x int, y int, pos int")).collect()}
    assert got == {(a, b) for a in range(1, 20, 2) for b in range(0, 20, 2)}
    assert seen[0].select("poly_id").distinct().count() == 2


def test_texts_meet_the_lines_beside_them_only(spark, monkeypatch):
    from thermograph.operators import drawing as D
    seen = []
    real = D.range_join
    monkeypatch.setattr(D, "range_join", lambda a, b, *x: seen.append(real(a, b, *x)) or seen[-1])
    monkeypatch.setattr("thermograph.operators.intervals.range_join", lambda a, b, *x: seen.append(real(a, b, *x)) or seen[-1])
    span = spark.createDataFrame([(1, 7, "horizontal", 100.0, 50.0, 60.0, 4.0)], "page_id int, span_id int, direction string, across double, t0 double, t1 double, font_size double")
    lines = [(1, 1, "horizontal", 101, 20, 49), (1, 2, "horizontal", 101, 61, 90)] + [(1, 10 + i, "horizontal", 1000 + 64 * i, 20, 49) for i in range(100)]
    got = D.bridge_split_dimension(span, spark.createDataFrame(lines, "page_id int, seg_id int, orientation string, fixed long, axis_start long, axis_end long")).collect()
    assert [(r.f_id, r.g_id, r.axis_start, r.axis_end) for r in got] == [(1, 2, 20, 90)]
    assert seen[0].count() == 1


def test_walls_ask_with_numbers(spark, monkeypatch):
    from thermograph.operators import drawing as D
    seen = []
    real = D.next_start
    monkeypatch.setattr(D, "next_start", lambda asks, starts, *x: seen.append((asks, starts)) or real(asks, starts, *x))
    w = [(1, "a", "horizontal", "up", 0, 0, 5), (1, "b", "horizontal", "up", 0, 9, 12), (1, "c", "horizontal", "down", 1, 9, 14), (1, "d", "horizontal", "up", 1, 20, 22)]
    walls = spark.createDataFrame(w, "page_id int, wall_id string, orientation string, inside_direction string, fixed long, axis_start long, axis_end long")
    roi = spark.createDataFrame([(1, -50, -50, 50, 50)], "page_id int, left int, top int, right int, bottom int")
    got = sorted((r.wall_id, r.r_id, r.gap_end, ";".join(r.reason_codes)) for r in D.exterior_gaps(walls, roi).collect())
    assert got == [("a", "b", 9, "multiple_competing_endpoints"), ("b", "d", 20, "not_strictly_collinear"), ("c", "d", 20, "different_inside_directions")]
    assert not {"wall_id", "inside_direction"} & {*seen[0][0].columns, *seen[0][1].columns}


def test_envelope_sides_share_one_pass(spark, monkeypatch):
    """The driver plans the envelope's steps; the shuffles it has to plan are counted."""
    from thermograph.plans import topology as T
    shuffles = []
    real = X.cut_lineage
    for module in (X, T):
        monkeypatch.setattr(module, "cut_lineage", lambda df: shuffles.append(plan_of(df).count("Exchange hashpartitioning")) or real(df))
    walls = [(1, "horizontal", 0, 0, 96, "down", 1), (1, "horizontal", 80, 0, 100, "up", 2), (1, "vertical", 0, 0, 80, "right", 3), (1, "vertical", 100, 0, 80, "left", 4), (1, "vertical", 50, 0, 80, None, 5)]
    w = spark.createDataFrame(walls, "page_id int, orientation string, fixed long, axis_start long, axis_end long, inside_direction string, wall_id long")
    openings = spark.createDataFrame([], "page_id int, opening_id long, orientation string, fixed long, gap_start long, gap_end long, host_ids array<long>")
    page = T.calculation_envelope(w, openings, 200, 150)["pages"].first()
    assert (page.area, page.perimeter, page.inferred_length) == (8000.0, 360.0, 4.0)
    assert sum(shuffles) < 250


def test_rows_of_islands_move_once(spark):
    from thermograph.operators import intervals as I
    rng = random.Random(8)
    rows = [(rng.randint(0, 3), i, *(lambda a: (a, a + rng.randint(0, 9)))(rng.randint(0, 300))) for i in range(200)]
    f = spark.createDataFrame(rows, "k int, id int, s int, e int").withColumn("node_type", F.when(F.col("id") % 2 == 0, "anchor").otherwise("door_arc"))
    got = {(r.id, r.island_start) for r in I.with_island(f, ["k"], "s", "e", 2, 16).collect()}
    heads = {(r.k, r.s): r.island_start for r in I.islands(f, ["k"], "s", "e", 2, 16).collect()}
    assert got == {(i, heads[k, s]) for k, i, s, e in rows}
    plan = plan_of(I.chain_components(f.select("k", "node_type", F.col("id").alias("node_id"), F.col("s").alias("axis_start"), F.col("e").alias("axis_end")), ["k"]))
    assert "Expand" not in plan


def test_targets_out_of_reach_leave_the_snapping(spark, monkeypatch):
    kept = []
    real = Fc.cut_lineage
    monkeypatch.setattr(Fc, "cut_lineage", lambda df: kept.append(df) or real(df))
    lines = [(1, 1, "horizontal", 500.0, 0.0, 98.0)] + [(1, 10 + i, "vertical", 100.0, 7.0 * i, 7.0 * i + 5) for i in range(40)] + [(1, 99, "vertical", 100.0, 498.0, 505.0)]
    f = spark.createDataFrame(lines, "page_id int, line_id int, orientation string, fixed double, axis_start double, axis_end double")
    assert {r.line_id: r.axis_end for r in Fc.snap_endpoints(f, 3.0).filter("snapped").collect()} == {1: 100.0, 99: 505.0}
    assert kept[1].count() == 2


def test_walls_met_once_are_not_merged(spark):
    e = spark.createDataFrame([(1, "e", "horizontal", 0, 0, 100)], "page_id int, edge_id string, orientation string, fixed int, e0 int, e1 int")
    w = spark.createDataFrame([(1, "horizontal", 0, 0, 30, 1), (1, "horizontal", 0, 20, 60, 1), (1, "horizontal", 0, 60, 100, 2)], "page_id int, orientation string, fixed int, axis_start int, axis_end int, wall_id int")
    got = X.real_wall_segments(e, w)
    assert sorted((r.axis_start, r.axis_end, r.source_wall_ids) for r in got.collect()) == [(0, 60, [1]), (60, 100, [2])]
    assert "count(1) windowspecdefinition(page_id" in plan_of(got)


def test_lists_of_a_card_are_not_folded_value_by_value(spark):
    from thermograph.functions import text as Tx
    from thermograph.operators import relational as O
    rng = random.Random(4)
    words = ["a", "b", "c", "a;b", "c; d", ";", "d;a;", "e"]
    rows = [(f"r{k}", pos, "检验结论", rng.choice(words)) for k in range(40) for pos in range(rng.randint(1, 7))]
    f = spark.createDataFrame(rows, "report_id string, pos long, field string, value string")
    got = {r.report_id: r.test_conclusion for r in O.meta_fold(f).collect()}
    step = f.groupBy("report_id").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("l"))
    want = step.select("report_id", F.aggregate("l", F.lit(""), lambda a, s: Tx.append_unique(a, s["value"])).alias("t")).collect()
    assert got == {r.report_id: r.t for r in want}
    assert "aggregate(" not in plan_of(O.meta_fold(f))


def test_tuples_of_a_statement_leave_in_slices(spark):
    from thermograph.sources import tables as T
    text = "INSERT INTO `t` VALUES " + ", ".join(f"({i}, 'x')" for i in range(25))
    frames = list(T.dump_slices([text, None, text], 10))
    assert [len(f) for f in frames] == [10] * 5
    assert [(r.row_no, list(r.fields)) for f in frames for r in f.itertuples()] == [(i, [str(i), "x"]) for i in range(25)] * 2


def test_texts_are_read_once(spark):
    """Each regular expression stands once in the plan of a text, and catalog texts are told apart without a join."""
    docs = spark.createDataFrame([(1, "典型门窗幕墙热工参数目录\n1 单银 甲 1.10 2.10 2.20 2.30 2.40 2.50\n2 双银 乙 0.62 0.30 — 1.80", "u"), (2, "典型玻璃的光学\n外窗 传热系数 1.5 W/(m2·K)", "u"), (3, "门 2.5 W/(m·K)；x", "v"), (4, None, "v")], "doc_id int, text string, source_url string")
    df = Wb.candidates_from_text(docs)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") < 40 and "LeftAnti" not in plan
    got = sorted((r.doc_id, r.component_category, r.value, r.unit) for r in df.collect())
    assert got == sorted([(1, "window_u", v, "W/(m2·K)") for v in (1.1, 2.1, 2.2, 2.3, 2.4, 2.5, 1.8)] + [(1, "window_shgc", 0.3, ""), (2, "window_u", 1.5, "W/(m2·K)"), (3, "door_u", 2.5, "W/(m·K)")])


def test_decisions_wait_for_no_names(spark, monkeypatch):
    """Names are given out in rounds; a query that returns none runs none of them."""
    monkeypatch.setattr(O, "cut_lineage", lambda df: 1 / 0)
    rows = E.queries()["X14_import_classified"](spark, "/root/testdata/sf0.001").collect()
    assert {r.status for r in rows} == {"imported", "skipped"}


def test_equal_bands_are_measured_once(spark):
    """Copies of a rectangle add rows to the result but none to the slices of cells."""
    cells = spark.range(400).selectExpr("1 AS page_id", "id % 20 AS x", "id DIV 20 AS y", "CAST(id AS DOUBLE) AS value")
    bands = spark.range(90).selectExpr("1 AS page_id", "id AS band_id", "id % 3 AS bx0", "2 AS by0", "id % 3 + 9 AS bx1", "4 AS by1")
    df = D.zonal_stats(cells, bands)
    got = {r.band_id: (r.mean, r.max, r.n_cells) for r in df.collect()}
    assert got == {i: (60 + i % 3 + 4.5, 80.0 + i % 3 + 9, 30) for i in range(90)}
    keys = re.findall(r"Aggregate \[([^\]]*)\]", df._jdf.queryExecution().optimizedPlan().toString())
    assert any("_a#" in k and "_z#" in k and "band_id" not in k for k in keys)


def test_looking_ahead_reads_each_row_once(spark):
    """A frame that ends at the last row is evaluated anew for every row of its tile."""
    rng = random.Random(11)
    times = sorted({rng.randrange(0, 4000) / 2 for _ in range(300)})
    at = spark.createDataFrame([("register", "a", t) for t in times], "action string, address string, ts double")
    got = Lm._first_from(at, 25.0)
    assert "unboundedfollowing" not in plan_of(got).lower()
    want = {t: min(u for u in times if u >= t + 25) for t in times if times[-1] >= t + 25}
    assert {r.ts: r.next for r in got.collect()} == want
    asks = [(1, rng.randrange(300), i) for i in range(80)]
    starts = [(1, s, 1, None) for s in sorted({rng.randrange(300) for _ in range(60)})]
    got = D.next_start(spark.createDataFrame(asks, "line int, at int, k int"), spark.createDataFrame(starts, "line int, at int, n int, m boolean"), ["line"], 16)
    assert "unboundedfollowing" not in plan_of(got).lower()
    after = lambda a: [s[1] for s in starts if s[1] > a]
    assert {r.k: r.next["at"] for r in got.collect()} == {k: min(after(a)) for _, a, k in asks if after(a)}
