"""Registered queries of the planar-graph family."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermograph.operators import faces as Fc
from thermograph.operators import intervals as I
from thermograph.plans import adapters as A
from thermograph.plans.registry_drawing import _ISL, cells, seg

QUERIES: dict = {}
c = F.col
REG = ("v_regions",)
SEG = ("v_segments",)


def add(name, fn, sql=None, views=()):
    QUERIES[name] = (fn, A.with_views(sql.strip(), *views) if sql and views else sql)


def _a20(s, d):
    A.load_tables(s, d)
    e = s.sql("SELECT 0 AS g, c_custkey AS u, 10000000 + c_nationkey AS v FROM customer UNION ALL SELECT 0, o_custkey, 20000000 + o_orderkey FROM orders")
    return Fc.connected_components(e, ["g"]).groupBy("component").agg(F.count("*").alias("vertices"))


add("A20_connected_components", _a20, """WITH n AS (SELECT c_nationkey AS k, min(c_custkey) AS component, count(*) + 1 AS n FROM customer GROUP BY 1), o AS (SELECT c_nationkey AS k, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1)
SELECT component, n.n + coalesce(o.n, 0) AS vertices FROM n LEFT JOIN o USING (k)""")


def _boxes(s, d):
    """Per region its own page: a box with one inner wall."""
    r = A.view(s, d, "v_regions")
    x, y, w, h, k = (c(n) for n in ("x", "y", "w", "h", "region_id"))
    line = lambda n, o, f, a, b: F.struct(F.lit(n).alias("n"), F.lit(o).alias("orientation"), f.cast("bigint").alias("fixed"), a.cast("bigint").alias("axis_start"), b.cast("bigint").alias("axis_end"))
    m = x + F.floor(w / 3)
    lines = F.array(line(1, "horizontal", y, x, x + w), line(2, "horizontal", y + h, x, x + w), line(3, "vertical", x, y, y + h), line(4, "vertical", x + w, y, y + h), line(5, "vertical", m, y, y + h))
    return r.select(k.alias("page_id"), F.explode(lines).alias("l")).select("page_id", (c("page_id") * 10 + c("l.n")).alias("seg_id"), "l.orientation", "l.fixed", "l.axis_start", "l.axis_end")


add("G1_bounded_faces", lambda s, d: Fc.bounded_faces(_boxes(s, d)).select("page_id", "area", "perimeter", "n_edges"), """
SELECT region_id AS page_id, (w // 3 * h)::DOUBLE AS area, (2 * (w // 3 + h))::DOUBLE AS perimeter, 4::BIGINT AS n_edges FROM v_regions UNION ALL SELECT region_id, ((w - w // 3) * h)::DOUBLE, (2 * (w - w // 3 + h))::DOUBLE, 4 FROM v_regions""", REG)
add("G1_drawing_faces", lambda s, d: Fc.bounded_faces(seg(s, d)).groupBy("page_id").agg(F.count("*").alias("faces"), F.sum("area").alias("area")))


def _face_boxes(s, d):
    """One rectangle per region over the cell grid of a page."""
    r = A.view(s, d, "v_regions")
    x, y = (c("x") % 30).cast("bigint"), (c("y") % 12).cast("bigint")
    x2, y2 = x + c("w").cast("bigint"), y + (c("h") % 9 + 1).cast("bigint")
    e = lambda a, b, p, q: F.struct(a.alias("x0"), b.alias("y0"), p.alias("x1"), q.alias("y1"))
    return r.select((c("region_id") % 20).alias("page_id"), c("region_id").alias("face_id"), F.explode(F.array(e(x, y, x2, y), e(x2, y, x2, y2), e(x2, y2, x, y2), e(x, y2, x, y))).alias("e")).select("page_id", "face_id", "e.*")


_CELLS = ", cl AS (SELECT page_id, y, unnest(range(len(embedding))) AS x, unnest(embedding)::DOUBLE AS value FROM v_cells)"
add("G3_face_footprint_mean", lambda s, d: Fc.face_footprint_mean(_face_boxes(s, d), cells(s, d)).select("face_id", F.round("mean", 7).alias("mean"), "n_cells"), _CELLS + """
, f AS (SELECT region_id AS face_id, region_id % 20 AS page_id, x % 30 AS x0, x % 30 + w AS x1, y % 12 AS y0, y % 12 + h % 9 + 1 AS y1 FROM v_regions)
SELECT face_id, round(avg(value), 7) AS mean, count(*) AS n_cells FROM f JOIN cl ON cl.page_id = f.page_id AND cl.x >= x0 AND cl.x < x1 AND cl.y >= y0 AND cl.y < y1 GROUP BY 1""", ("v_cells", "v_regions"))


def _polys(s, d):
    r = A.view(s, d, "v_regions")
    p = lambda i, a, b: F.struct(F.lit(i).alias("pos"), a.alias("x"), b.alias("y"))
    x, y, w, h = (c(n) for n in ("x", "y", "w", "h"))
    return r.select("page_id", c("region_id").alias("poly_id"), F.explode(F.array(p(0, x, y), p(1, x + w, y), p(2, x + w, y + h), p(3, x, y + h))).alias("p")).select("page_id", "poly_id", "p.*")


add("J15_nested_polygons", lambda s, d: Fc.nested_polygons(_polys(s, d)), """
SELECT o.page_id, o.region_id AS outer, i.region_id AS inner FROM v_regions o JOIN v_regions i ON o.page_id = i.page_id AND o.x < i.x AND o.y < i.y AND i.x + i.w < o.x + o.w AND i.y + i.h < o.y + o.h""".replace("AS outer", 'AS "outer"').replace("AS inner", 'AS "inner"'), REG)
add("W5_greedy_bands", lambda s, d: Fc.greedy_bands(seg(s, d).select("page_id", "orientation", c("seg_id").alias("wall_id"), "fixed"), ["page_id", "orientation"]).groupBy("page_id", "orientation", "band_founder").agg(F.count("*").alias("members")))
add("W11_snap_endpoints", lambda s, d: Fc.snap_endpoints(seg(s, d).select("page_id", c("seg_id").alias("line_id"), "orientation", c("fixed").cast("double"), c("axis_start").cast("double"), c("axis_end").cast("double")), 3.0).groupBy("page_id").agg(F.count_if(c("snapped")).alias("snapped"), F.sum("axis_start").alias("a"), F.sum("axis_end").alias("b")))


def _bands(s, d):
    m = I.merge_with_sources(seg(s, d), ["page_id", "orientation", "fixed"], "seg_id")
    return m.withColumnRenamed("source_ids", "source_ids").withColumns({"band_id": F.concat_ws(":", "orientation", "fixed", "axis_start"), "inside_direction": F.when(c("orientation") == "horizontal", F.when(c("fixed") % 3 == 0, "up").otherwise("down")).otherwise(F.when(c("fixed") % 3 == 0, "left").otherwise("right"))})


_BANDS = _ISL.format(k="page_id, orientation, fixed", t=0, f="v_segments", u="seg_id") + """
, w AS (SELECT page_id, orientation, fixed, min(axis_start) AS s, max(axis_end) AS e, list(DISTINCT seg_id) AS ids, orientation || ':' || fixed || ':' || min(axis_start) AS band_id, CASE WHEN orientation = 'horizontal' THEN CASE WHEN fixed % 3 = 0 THEN 'up' ELSE 'down' END ELSE CASE WHEN fixed % 3 = 0 THEN 'left' ELSE 'right' END END AS dir FROM b GROUP BY page_id, orientation, fixed, isl),
g AS (SELECT *, CASE WHEN orientation = 'horizontal' THEN s ELSE fixed END AS x0, CASE WHEN orientation = 'horizontal' THEN e ELSE fixed END AS x1, CASE WHEN orientation = 'horizontal' THEN fixed ELSE s END AS y0, CASE WHEN orientation = 'horizontal' THEN fixed ELSE e END AS y1 FROM w),
en AS (SELECT page_id, band_id, orientation, fixed, dir, 'start' AS side, x0 AS px, y0 AS py FROM g UNION ALL SELECT page_id, band_id, orientation, fixed, dir, 'end', x1, y1 FROM g),
ty AS (SELECT *, unnest(range((y0 - 4) // 128, (y1 + 4) // 128 + 1)) AS ty FROM g), ti AS (SELECT *, unnest(range((x0 - 4) // 128, (x1 + 4) // 128 + 1)) AS tx FROM ty),
hi AS (SELECT DISTINCT en.page_id, en.band_id, en.side FROM en JOIN ti o ON o.page_id = en.page_id AND o.tx = en.px // 128 AND o.ty = en.py // 128 AND o.band_id <> en.band_id AND px BETWEEN o.x0 - 4 AND o.x1 + 4 AND py BETWEEN o.y0 - 4 AND o.y1 + 4),
dn AS (SELECT en.* FROM en ANTI JOIN hi ON hi.page_id = en.page_id AND hi.band_id = en.band_id AND hi.side = en.side)"""
add("J17_dangling_ends", lambda s, d: Fc.dangling_ends(_bands(s, d)).select("page_id", "band_id", "side"), _BANDS + " SELECT page_id, band_id, side FROM dn", SEG)
add("J17_corner_candidates", lambda s, d: Fc.corner_candidates(_bands(s, d), 60).select("page_id", "h_id", "h_side", "v_id", "v_side", "compatible", "rank"), _BANDS + """
, p AS (SELECT h.page_id, h.band_id AS h_id, h.side AS h_side, v.band_id AS v_id, v.side AS v_side, abs(v.fixed - h.px) AS hl, abs(h.fixed - v.py) AS vl,
 ((CASE WHEN h.side = 'start' THEN v.fixed <= h.px ELSE v.fixed >= h.px END) AND (CASE WHEN v.side = 'start' THEN h.fixed <= v.py ELSE h.fixed >= v.py END) AND v.dir = CASE WHEN h.side = 'start' THEN 'right' ELSE 'left' END AND h.dir = CASE WHEN v.side = 'start' THEN 'down' ELSE 'up' END) AS compatible
 FROM dn h JOIN dn v ON h.page_id = v.page_id AND h.orientation = 'horizontal' AND v.orientation = 'vertical' AND abs(v.fixed - h.px) <= 60 AND abs(h.fixed - v.py) <= 60 AND greatest(abs(v.fixed - h.px), abs(h.fixed - v.py)) > 4)
SELECT page_id, h_id, h_side, v_id, v_side, compatible, row_number() OVER (PARTITION BY page_id, h_id, h_side ORDER BY compatible DESC, greatest(hl, vl), hl + vl, v_id, v_side)::INT AS rank FROM p QUALIFY rank <= 12""", SEG)
add("J17_collinear_extensions", lambda s, d: Fc.collinear_extensions(_bands(s, d)).select("page_id", "band_id", "next_id"), _BANDS + """
, n AS (SELECT page_id, band_id, e, lead(band_id) OVER k AS nx, lead(s) OVER k AS ns FROM w WINDOW k AS (PARTITION BY page_id, orientation, fixed, dir ORDER BY s, e))
SELECT n.page_id, n.band_id, nx AS next_id FROM n JOIN dn a ON a.page_id = n.page_id AND a.band_id = n.band_id AND a.side = 'end' JOIN dn b2 ON b2.page_id = n.page_id AND b2.band_id = nx AND b2.side = 'start' WHERE ns - e > 4""", SEG)


def _j18(s, d):
    e = seg(s, d).select("page_id", c("seg_id").alias("edge_id"), "orientation", "fixed", "axis_start", "axis_end", F.array(c("seg_id")).alias("anchor_ids"))
    return Fc.edge_crosses_band_anti(e, _bands(s, d)).select("page_id", "edge_id")


add("J18_edge_crosses_band_anti", _j18, _BANDS + """
SELECT page_id, seg_id AS edge_id FROM v_segments t WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.page_id = t.page_id AND NOT list_contains(w.ids, t.seg_id) AND
 ((w.orientation = t.orientation AND abs(w.fixed - t.fixed) <= 4 AND least(t.axis_end, w.e) - greatest(t.axis_start, w.s) > 4) OR (w.orientation <> t.orientation AND w.fixed > t.axis_start + 4 AND w.fixed < t.axis_end - 4 AND t.fixed BETWEEN w.s - 4 AND w.e + 4)))""", SEG)


def _j19(s, d):
    r = A.view(s, d, "v_regions")
    k, w = c("region_id"), c("w")
    edges = r.select(k.alias("page_id"), F.lit(1).alias("edge_id"), F.lit("horizontal").alias("orientation"), c("y").alias("fixed"), c("x").alias("e0"), (c("x") + w).alias("e1"))
    cut = c("x") + 4
    part = lambda i, a, b: F.struct(F.lit(i).alias("part_id"), a.alias("axis_start"), b.alias("axis_end"))
    parts = r.select(k.alias("page_id"), F.lit("horizontal").alias("orientation"), c("y").alias("fixed"), F.explode(F.array(part(1, c("x"), cut), part(2, F.when(k % 4 == 1, cut + 1).when(k % 4 == 2, cut - 1).otherwise(cut), F.when(k % 4 == 3, c("x") + w + 5).otherwise(c("x") + w)))).alias("p")).select("page_id", "orientation", "fixed", "p.*")
    return Fc.boundary_partition_check(edges, parts)


add("J19_boundary_partition_check", _j19, "SELECT region_id AS page_id, region_id % 4 = 0 AS valid, CASE WHEN region_id % 4 = 0 THEN 0 ELSE 1 END::BIGINT AS bad_edges FROM v_regions", REG)


def _c17(s, d):
    k = c("seg_id")
    e = seg(s, d).select("page_id", k.alias("edge_id"), F.floor(k / 8).alias("edge_group_id"), (k % 19 > 0).alias("inside_roi"), (c("axis_end") - c("axis_start")).alias("length"), F.lit(48).alias("max_length"), (k % 23 == 0).alias("crosses_band"),
                         F.lit(0.9).alias("inside_mean"), ((k % 5) / 6.0).alias("outside_mean"), F.lit(0.6).alias("boundary_mean"), F.lit(0.9).alias("inside_share"), F.lit(0.1).alias("outside_share"))
    return Fc.inferred_edge_decision(e).select("edge_id", "page_id", "decision", F.array_join("group_reasons", ";").alias("reasons"))


add("C17_inferred_edge_decision", _c17, """
, r AS (SELECT page_id, seg_id, seg_id // 8 AS g, unnest([CASE WHEN seg_id % 19 = 0 THEN 'inferred_edge_outside_roi' END, CASE WHEN axis_end - axis_start > 48 THEN 'inferred_edge_exceeds_short_side_limit' END, CASE WHEN seg_id % 23 = 0 THEN 'inferred_edge_crosses_nearer_wall_band' END, CASE WHEN 0.9::DOUBLE - (seg_id % 5) / 6 < 0.25::DOUBLE THEN 'insufficient_inside_footprint_support' END]) AS t FROM v_segments),
q AS (SELECT page_id, g, string_agg(DISTINCT t, ';' ORDER BY t) AS reasons FROM r WHERE t IS NOT NULL GROUP BY 1, 2)
SELECT s.seg_id AS edge_id, s.page_id, CASE WHEN reasons IS NULL THEN 'accepted_candidate' ELSE 'rejected_candidate' END AS decision, reasons FROM v_segments s LEFT JOIN q ON q.page_id = s.page_id AND q.g = s.seg_id // 8""", SEG)


def _c19(s, d):
    """Boxes; every fourth has two corners swapped, every sixth an area off by 3 units in the last place, every fifth by 1."""
    k = c("region_id")
    corner = [(c("x"), c("y")), (c("x") + c("w"), c("y")), (c("x") + c("w"), c("y") + c("h")), (c("x"), c("y") + c("h"))]
    pt = lambda i: F.struct(corner[i][0].cast("double").alias("x"), corner[i][1].cast("double").alias("y"))
    pts = F.when(k % 4 == 0, F.array(pt(0), pt(2), pt(1), pt(3))).otherwise(F.array(*map(pt, range(4))))
    area = (c("w") * c("h")).cast("double")
    unit = F.pow(F.lit(2.0), F.floor(F.log2(area)) - 52)
    p = A.view(s, d, "v_regions").select(k.alias("page_id"), pts.alias("points"), (area + F.when(k % 5 == 0, 1.0).when(k % 6 == 0, 3 * unit).otherwise(0.0)).alias("area_px2"), (2 * (c("w") + c("h"))).cast("double").alias("perimeter_px"), (k % 3 % 2).alias("unresolved"), ((k % 7) / 8.0).alias("max_repair_m"))
    return Fc.confirm_checks(p).select("page_id", F.array_join("errors", ";").alias("errors"))


add("C19_confirm_checks", _c19, """SELECT region_id AS page_id, concat_ws(';', CASE WHEN region_id % 4 = 0 THEN 'self_intersecting;area_mismatch;perimeter_mismatch' WHEN region_id % 5 = 0 THEN 'area_mismatch' END,
 CASE WHEN region_id % 3 = 1 THEN 'unresolved_gaps' END, CASE WHEN region_id % 7 > 4 THEN 'repair_too_wide' END) AS errors FROM v_regions""", REG)


def _closures_of_rooms(s, d):
    li = A.table(s, d, "lineitem")
    walls = li.select((c("l_orderkey") % 50).alias("page_id"), (c("l_suppkey") % 40).alias("face_id"), (c("l_partkey") % 60).alias("wall_id"))
    snaps = A.table(s, d, "orders").select((c("o_orderkey") % 50).alias("page_id"), c("o_orderkey").alias("snap_id"), F.explode(F.array(c("o_orderkey") % 60, c("o_custkey") % 60, c("o_custkey") * 7 % 60)).alias("wall_id"))
    return Fc.closure_applied(walls, snaps)


add("G2_closure_applied", _closures_of_rooms, """WITH f AS (SELECT DISTINCT l_orderkey % 50 AS page_id, l_suppkey % 40 AS face_id, l_partkey % 60 AS wall_id FROM lineitem), g AS (SELECT page_id, face_id, list(wall_id) AS ids FROM f GROUP BY ALL)
SELECT DISTINCT page_id, face_id FROM g JOIN orders ON o_orderkey % 50 = page_id WHERE list_has_all(ids, [o_orderkey % 60, o_custkey % 60, o_custkey * 7 % 60])""")
add("C21_provenance_match", lambda s, d: Fc.provenance_match(A.table(s, d, "customer").select(c("c_custkey").alias("page_id"), "c_nationkey"), A.table(s, d, "supplier").select(c("s_suppkey").alias("page_id"), c("s_nationkey").alias("c_nationkey")), ["c_nationkey"]),
    "SELECT c_custkey AS page_id, coalesce(c_nationkey = s_nationkey, false) AS same FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
add("C24_recovered_wall_rows", lambda s, d: Fc.recovered_wall_rows(seg(s, d).withColumns({"band_fixed": c("fixed") + 3, "reason_codes": F.array(F.lit("weak"), F.lit("weak"))})).select("seg_id", "fixed", "original_fixed", F.array_join("reason_codes", ";").alias("r")),
    "SELECT seg_id, fixed + 3 AS fixed, fixed AS original_fixed, 'weak;native_wall_connected_through_exterior_door_arc' AS r FROM v_segments", SEG)


def _entities(s, d):
    p = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return seg(s, d).select(c("page_id").alias("drawing_id"), c("orientation").alias("layer"), F.array(p(c("axis_start"), c("fixed")), p(c("axis_end"), c("fixed")), p(c("axis_end"), c("fixed") + 2)).alias("points"))


add("A21_layer_geometry", lambda s, d: Fc.layer_geometry(_entities(s, d), 0.5), """
SELECT page_id AS drawing_id, orientation AS layer, sum((axis_end - axis_start + 2) * 0.5::DOUBLE) AS length, min(axis_start) * 0.5::DOUBLE AS x_min, max(axis_end) * 0.5::DOUBLE AS x_max, min(fixed) * 0.5::DOUBLE AS y_min, max(fixed + 2) * 0.5::DOUBLE AS y_max, count(*) AS entities FROM v_segments GROUP BY 1, 2""", SEG)
add("A21_drawing_summary", lambda s, d: Fc.drawing_summary(_entities(s, d), 0.5).select("drawing_id", "x_min", "y_min", "width", "height", "length", "entities", F.array_join(F.transform("layers", lambda x: F.concat_ws(":", x["layer"], x["entities"])), ",").alias("layers")), """
, l AS (SELECT page_id, orientation, count(*) AS n FROM v_segments GROUP BY ALL), k AS (SELECT page_id, string_agg(orientation || ':' || n, ',' ORDER BY orientation) AS layers FROM l GROUP BY 1)
SELECT page_id AS drawing_id, min(axis_start) * 0.5::DOUBLE AS x_min, min(fixed) * 0.5::DOUBLE AS y_min, (max(axis_end) - min(axis_start)) * 0.5::DOUBLE AS width, (max(fixed) + 2 - min(fixed)) * 0.5::DOUBLE AS height, sum((axis_end - axis_start + 2) * 0.5::DOUBLE) AS length,
 count(*) AS entities, any_value(layers) AS layers FROM v_segments JOIN k USING (page_id) GROUP BY page_id""", SEG)
add("A22_convex_hull_area", lambda s, d: Fc.convex_hull_area(_polys(s, d).select(c("poly_id").alias("drawing_id"), c("x").cast("double").alias("x"), c("y").cast("double").alias("y")), ["drawing_id"]), "SELECT region_id AS drawing_id, (w * h)::DOUBLE AS hull_area FROM v_regions", REG)


def _rooms(s, d):
    f = A.view(s, d, "v_regions").select((c("region_id") % 50).alias("page_id"), c("region_id").alias("face_id"), (c("w") * c("h")).cast("double").alias("area"), c("x").alias("x_min"), (c("x") + c("w")).alias("x_max"), c("y").alias("y_min"), (c("y") + c("h")).alias("y_max"), ((c("region_id") % 9) / 10.0).alias("room_mean"), ((c("region_id") % 8) / 8.0).alias("footprint_mean"))
    roi = f.select("page_id").distinct().select("page_id", F.lit(5).alias("left"), F.lit(5).alias("top"), F.lit(100).alias("right"), F.lit(90).alias("bottom"), F.lit(10000.0).alias("image_area"))
    return Fc.room_candidates(f, roi)


add("G2_room_candidates", lambda s, d: _rooms(s, d).select("face_id", "area", "decision"), """
SELECT region_id AS face_id, (w * h)::DOUBLE AS area, CASE WHEN (region_id % 9) / 10 >= 0.35::DOUBLE AND (region_id % 8) / 8 >= 0.5::DOUBLE THEN 'accepted_room_candidate' ELSE 'suspicious_closed_region' END AS decision FROM v_regions WHERE x >= 5 AND x + w <= 100 AND y >= 5 AND y + h <= 90 AND w * h >= 400 AND w * h <= 6460""", REG)


def _docs(s, d):
    A.load_tables(s, d)
    return s.sql("""SELECT p_partkey AS page_id, '{"walls": [{"id": "w1", "points": [[0, 0], [' || CAST(p_size AS VARCHAR(5)) || ', 0]]}], "openings": [{"id": "o1", "kind": "door", "points": [[0, 0], [0, 3]]}], "rooms": [{"id": "r1", "polygon": [[0, 0], [' || CAST(p_size AS VARCHAR(5)) || ', 0], [' || CAST(p_size AS VARCHAR(5)) || ', 4], [0, 4]]}]}' AS doc FROM part""")


add("G7_prediction_lines", lambda s, d: Fc.vector_prediction_adapter(_docs(s, d))[0], "SELECT p_partkey AS page_id, 'w1' AS id, 'wall' AS kind, p_size::DOUBLE AS length_px FROM part UNION ALL SELECT p_partkey, 'o1', 'door', 3 FROM part")
add("G7_prediction_scale", lambda s, d: Fc.prediction_scale(_docs(s, d).join(_measures(s, d), "page_id")), """
SELECT p_partkey AS page_id, CASE WHEN p_partkey % 3 = 0 THEN 'confirmed' ELSE 'manual_required' END AS status, CASE WHEN p_partkey % 3 = 0 THEN 'vector_dimensions' ELSE 'raster_manual' END AS method, CASE WHEN p_partkey % 3 = 0 THEN 0.25::DOUBLE END AS scale_m_per_px,
 CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END::DOUBLE AS confidence, 1::BIGINT AS room_count, (p_size * 4)::DOUBLE AS total_area_px2, CASE WHEN p_partkey % 3 = 0 THEN p_size * 0.25::DOUBLE END AS total_area_m2, p_partkey % 3 = 0 AS load_geometry_ready FROM part""")
add("G7_prediction_rooms", lambda s, d: Fc.vector_prediction_adapter(_docs(s, d))[1], "SELECT p_partkey AS page_id, 'r1' AS id, (p_size * 4)::DOUBLE AS area_px2, (2 * (p_size + 4))::DOUBLE AS perimeter_px FROM part")


def _measures(s, d):
    """A third of the pages with a scale, the others without, with zero or with a text instead."""
    k = c("p_partkey")
    return A.table(s, d, "part").select(k.alias("page_id"), F.when(k % 3 == 0, '{"scale_m_per_px": 0.25}').when(k % 9 == 1, '{"scale_m_per_px": "x"}').when(k % 9 == 2, '{"scale_m_per_px": 0}').when(k % 9 == 4, "[]").alias("measurements"))


def _g8(s, d):
    A.load_tables(s, d)
    return Fc.recognition_flatten(s.sql("""SELECT p_partkey AS id, '{"schema_version": 2, "scale_calibration": {"status": "' || CASE WHEN p_partkey % 2 = 0 THEN 'confirmed' ELSE 'conflict' END || '", "scale_m_per_px": 0.05}, "geometry": {"walls": [{"pts": [[0, 0], [3, 4], [3, ' || CAST(4 + p_size AS VARCHAR(5)) || ']]}], "windows": [], "doors": [{"area": 3}]}, "room_topology": {"room_count": ' || CAST(p_size % 4 AS VARCHAR(5)) || ', "load_geometry_ready": true}}' AS doc FROM part"""))


add("G8_recognition_flatten", _g8, "SELECT p_partkey AS id, 1 AS walls, 0 AS windows, 1 AS doors, (5 + p_size)::DOUBLE AS wall_px, 0::DOUBLE AS window_px, (p_size % 4)::INT AS room_count, CASE WHEN p_partkey % 2 = 0 THEN 0.05::DOUBLE END AS scale_m_per_px, true AS ready FROM part")


# -- exterior outlines ----------------------------------------------------------

def _w15(s, d):
    from thermograph.plans import exterior as X
    edges = seg(s, d).select("page_id", "orientation", "fixed").distinct().select("page_id", F.concat_ws(":", "orientation", "fixed").alias("edge_id"), "orientation", "fixed", F.lit(50).cast("bigint").alias("e0"), F.lit(350).cast("bigint").alias("e1"))
    walls = seg(s, d).filter("seg_id % 2 = 0").select("page_id", "orientation", "fixed", "axis_start", "axis_end", c("seg_id").alias("wall_id"))
    bridges = seg(s, d).filter("seg_id % 2 = 1").select("page_id", "orientation", "fixed", "axis_start", "axis_end")
    r = X.real_wall_segments(edges, walls, bridges, staged=True)
    return r.groupBy("page_id").agg(F.count("*").alias("pieces"), F.sum(c("axis_end") - c("axis_start")).alias("length"))


add("W15_real_wall_segments", _w15, """
, u AS (SELECT page_id, orientation, fixed, unnest(range(greatest(axis_start, 50), least(axis_end, 350))) AS p, seg_id % 2 AS bridge, seg_id FROM v_segments),
a AS (SELECT page_id, orientation, fixed, p, list_sort(list(DISTINCT seg_id)) AS ids FROM u GROUP BY ALL HAVING max(bridge) = 0),
n AS (SELECT *, CASE WHEN lag(p) OVER k = p - 1 AND lag(ids) OVER k = ids THEN 0 ELSE 1 END AS nw FROM a WINDOW k AS (PARTITION BY page_id, orientation, fixed ORDER BY p))
SELECT page_id, CAST(sum(nw) AS BIGINT) AS pieces, count(*) AS length FROM n GROUP BY page_id""", SEG)


def _g6(s, d):
    from thermograph.plans import exterior as X
    w = seg(s, d).filter("seg_id % 2 = 0").select("page_id", "seg_id", "orientation", "fixed", "axis_start", "axis_end", F.when(c("orientation") == "horizontal", "down").otherwise("right").alias("inside_direction"))
    u = seg(s, d).filter("seg_id % 2 = 1").select("page_id", "seg_id", "orientation", "fixed", "axis_start", "axis_end")
    k = A.view(s, d, "v_regions").select("page_id", c("region_id").alias("curve_id"), *[(c(a) * 5 + z).cast("bigint").alias(n) for n, a, z in (("x0", "x", F.lit(0)), ("y0", "y", F.lit(0)), ("x1", "x", c("w")), ("y1", "y", c("h")), ("sx", "x", F.lit(0)), ("sy", "y", F.lit(0)), ("ex", "x", c("w")), ("ey", "y", c("h")))])
    return X.door_arc_recovery(w, u, k)


add("G6_door_arc_recovery", lambda s, d: _g6(s, d)["components"].groupBy("status").agg(F.count("*").alias("components"), F.sum("n_arcs").alias("arcs")))


def _spread(s, regions):
    """Regions dealt over all tasks: a file of some MB is read by one or two, which would also make all the rows of its pages."""
    return regions.repartition(int(s.conf.get("spark.sql.shuffle.partitions")), "region_id")


# One drawing per region, by number mod 8: 0 closed, with a repair that closes nothing; 1 a small gap; 2 a door; 3 a gap with an accepted
# inferred edge; 4 with a rejected one; 5 a gap that only the envelope closes; 6 a box in a box; 7 no footprint.
def _drawings(s, d):
    r = _spread(s, A.view(s, d, "v_regions")).select(c("region_id").alias("page_id"), (c("region_id") % 8).alias("m"), *[(c(n) * 4).cast("bigint").alias(n) for n in ("x", "y", "w", "h")])
    k, m, x, y, w, h = (c(n) for n in ("page_id", "m", "x", "y", "w", "h"))
    gap = F.when(m == 1, 6).otherwise(12)
    side = lambda n, o, f, a, b, into: F.struct((k * 10 + n).alias("wall_id"), F.lit(o).alias("orientation"), f.alias("fixed"), a.cast("bigint").alias("axis_start"), b.cast("bigint").alias("axis_end"), F.when(m == 5, into).alias("inside_direction"))
    box = lambda n, i: [side(n + 1, "horizontal", y + h - i, x + i, x + w - i, "up"), side(n + 2, "vertical", x + i, y + i, y + h - i, "right"), side(n + 3, "vertical", x + w - i, y + i, y + h - i, "left")]
    cut = m.between(1, 5)
    top = [side(1, "horizontal", y, x, F.when(cut, x + 8).otherwise(x + w), "down"), F.when(cut, side(5, "horizontal", y, x + 8 + gap, x + w, "down"))]
    inner = [F.when(m == 6, v) for v in [side(6, "horizontal", y + 8, x + 8, x + w - 8, "down"), *box(6, 8)]]
    walls = r.select("page_id", F.explode(F.array_compact(F.array(*top, *box(1, 0), *inner))).alias("l")).select("page_id", "l.*")
    hosts = F.array(k * 10 + 1, k * 10 + 5).alias("host_ids")
    place = [F.lit("horizontal").alias("orientation"), y.alias("fixed"), (x + 8).alias("gap_start"), (x + 8 + gap).alias("gap_end")]
    ok = F.lit("accepted_gap").alias("decision")
    gaps = r.filter(cut).select("page_id", k.alias("gap_id"), *place, hosts, ok).unionByName(
        r.filter("m = 0").select("page_id", (-k).alias("gap_id"), F.lit("vertical").alias("orientation"), (x + w + 20).alias("fixed"), y.alias("gap_start"), (y + 5).alias("gap_end"), hosts, ok))
    openings = r.filter("m = 2").select("page_id", (k * 10 + 2).alias("opening_id"), *place, hosts)
    edge = lambda n: (x + 8 if n == "axis_start" else x + 20).alias(n)
    inferred = r.filter("m IN (3, 4)").select("page_id", k.alias("inference_id"), k.alias("edge_group_id"), F.lit(1).alias("edge_group_size"), F.lit("horizontal").alias("orientation"), y.alias("fixed"), edge("axis_start"), edge("axis_end"),
                                              F.when(m == 3, "accepted_candidate").otherwise("rejected_candidate").alias("decision"), F.lit(0.5).alias("mean_difference"), F.array(F.lit("discontinuous_inside_footprint_support")).alias("reason_codes"))
    grid = lambda a, n: F.sequence(a, a + n - 4, F.lit(4).cast("bigint"))
    value = F.when(m == 7, 0.2).otherwise(0.9)
    cl = r.select("page_id", F.explode(grid(y, h)).alias("y"), x.alias("x0"), F.lit(4).alias("step"), F.array_repeat(value, F.floor(w / 4).cast("int")).alias("values"))
    n = lambda v, a: F.lit(v).alias(a)
    pages = r.select("page_id", n(0, "left"), n(0, "top"), n(600, "right"), n(600, "bottom"), n(600, "image_w"), n(600, "image_h"), F.when(k % 2 == 0, 0.0625).alias("scale"))
    return walls, gaps, openings, openings.limit(0), inferred, cl, pages


_DONE: dict = {}


def _staged(name, build):
    """The outputs of a staged job, run once for all queries of a session that read one of them."""
    def run(s, d):
        key = (s.sparkContext.applicationId, name, d)
        if key not in _DONE:
            _DONE.clear()
            _DONE[key] = build(s, d)
        return _DONE[key]
    return run


def _topology(s, d):
    from thermograph.plans import topology as T
    walls, gaps, openings, pending, _, cl, pages = _drawings(s, d)
    bridges, unresolved = T.bridges_of(gaps, openings, pending, pages)
    return T.exterior_topology(walls, bridges, unresolved, cl, pages)


_g4 = _staged("topology", _topology)


_DRAWN = """, r AS (SELECT region_id AS page_id, region_id % 8 AS m, 4 * x AS x, 4 * y AS y, 4 * w AS w, 4 * h AS h FROM v_regions),
e AS (SELECT page_id, m, 'wall' AS kind, (page_id * 10 + n)::VARCHAR AS id FROM r, (VALUES (1), (2), (3), (4), (5)) AS t(n) WHERE n < 5 OR m BETWEEN 1 AND 5
 UNION ALL SELECT page_id, m, 'bridge', 'bridge:' || page_id FROM r WHERE m IN (1, 2) UNION ALL SELECT page_id, m, 'opening', (page_id * 10 + 2)::VARCHAR FROM r WHERE m = 2 UNION ALL SELECT page_id, m, 'inferred', page_id::VARCHAR FROM r WHERE m IN (3, 4))"""
add("G4_exterior_topology", lambda s, d: _g4(s, d)["pages"].select("page_id", "status", "area", "perimeter", "area_m2", "n_unresolved"), _DRAWN + """
SELECT page_id, CASE WHEN m = 6 THEN 'ambiguous_exterior' WHEN m < 3 THEN 'review_required' ELSE 'exterior_not_closed' END AS status, CASE WHEN m < 3 THEN (w * h)::DOUBLE END AS area, CASE WHEN m < 3 THEN (2 * (w + h))::DOUBLE END AS perimeter,
 CASE WHEN m < 3 AND page_id % 2 = 0 THEN w * h * 0.00390625::DOUBLE END AS area_m2, CASE WHEN m IN (0, 3, 4, 5) THEN 1 ELSE 0 END::BIGINT AS n_unresolved FROM r""", REG)
add("G4_exterior_evidence", lambda s, d: _g4(s, d)["evidence"], _DRAWN + " SELECT page_id, kind, id FROM e WHERE m < 3", REG)
add("G4_unresolved_gaps", lambda s, d: _g4(s, d)["unresolved"], _DRAWN + """
SELECT page_id, CASE WHEN m = 0 THEN -page_id ELSE page_id END AS gap_id, CASE WHEN m = 0 THEN 'gap_does_not_close_supported_exterior' ELSE 'gap_exceeds_repair_limit' END AS reason FROM r WHERE m IN (0, 3, 4, 5)""", REG)
add("G4_real_walls", lambda s, d: _g4(s, d)["real_walls"].select("page_id", "orientation", "fixed", "axis_start", "axis_end", F.array_join("source_wall_ids", ",").alias("walls")), _DRAWN + """
SELECT page_id, 'horizontal' AS orientation, y AS fixed, x AS axis_start, CASE WHEN m = 0 THEN x + w ELSE x + 8 END AS axis_end, (page_id * 10 + 1)::VARCHAR AS walls FROM r WHERE m < 3
UNION ALL SELECT page_id, 'horizontal', y, x + CASE WHEN m = 1 THEN 14 ELSE 20 END, x + w, (page_id * 10 + 5)::VARCHAR FROM r WHERE m IN (1, 2) UNION ALL SELECT page_id, 'horizontal', y + h, x, x + w, (page_id * 10 + 2)::VARCHAR FROM r WHERE m < 3
UNION ALL SELECT page_id, 'vertical', x, y, y + h, (page_id * 10 + 3)::VARCHAR FROM r WHERE m < 3 UNION ALL SELECT page_id, 'vertical', x + w, y, y + h, (page_id * 10 + 4)::VARCHAR FROM r WHERE m < 3""", REG)


def _closures(s, d):
    from thermograph.plans import topology as T
    return T.close_pages(*_drawings(s, d), 600, 600)


_c18 = _staged("closures", _closures)


_STAGE = "CASE m WHEN 3 THEN 'inference' WHEN 4 THEN 'endpoint_links' WHEN 5 THEN 'envelope' ELSE 'walls' END"
add("C18_topology_fallback", lambda s, d: _c18(s, d)["pages"].select("page_id", "status", "stage", "area", "perimeter", "inferred_length", "closure_method", "n_unresolved"), _DRAWN + f"""
SELECT page_id, CASE WHEN m = 6 THEN 'ambiguous_exterior' WHEN m = 7 THEN 'exterior_not_closed' ELSE 'review_required' END AS status, {_STAGE} AS stage, CASE WHEN m < 6 THEN (w * h)::DOUBLE END AS area, CASE WHEN m < 6 THEN (2 * (w + h))::DOUBLE END AS perimeter,
 CASE WHEN m < 3 THEN 0 WHEN m < 6 THEN 12 END::DOUBLE AS inferred_length, CASE m WHEN 3 THEN 'footprint_guided_inference' WHEN 4 THEN 'calculation_only_endpoint_link' WHEN 5 THEN 'calculation_only_endpoint_link' END AS closure_method, CASE WHEN m IN (0, 3, 4) THEN 1 ELSE 0 END::BIGINT AS n_unresolved FROM r""", REG)
add("C18_tries", lambda s, d: _c18(s, d)["tries"].select("page_id", "stage", "status", F.array_join("reasons", ";").alias("reasons")), _DRAWN + """
, t AS (SELECT *, 'walls' AS stage, CASE WHEN m < 3 THEN 'review_required' WHEN m = 6 THEN 'ambiguous_exterior' ELSE 'exterior_not_closed' END AS status FROM r UNION ALL SELECT *, 'inference', 'review_required' FROM r WHERE m = 3
UNION ALL SELECT *, 'endpoint_links', CASE WHEN m = 4 THEN 'review_required' ELSE 'exterior_not_closed' END FROM r WHERE m IN (4, 5, 7) UNION ALL SELECT *, 'envelope', CASE WHEN m = 5 THEN 'review_required' ELSE 'exterior_not_closed' END FROM r WHERE m NOT IN (1, 2))
SELECT page_id, stage, status, '' AS reasons FROM t""", REG)
add("C18_evidence", lambda s, d: _c18(s, d)["evidence"], _DRAWN + f" SELECT page_id, {_STAGE} AS stage, kind, id FROM e WHERE m < 6", REG)


def _c20(s, d):
    """Per region an edge pair at the box's first corner; the page number sets what is wrong."""
    from thermograph.plans import exterior as X
    k = c("region_id")
    pair = lambda n, o, f, a, z, into: F.struct((k * 2 + n).alias("inference_id"), F.lit(o).alias("orientation"), f.alias("fixed"), a.alias("axis_start"), z.alias("axis_end"), F.lit(into).alias("inside_direction"))
    shift = F.when(k % 5 == 1, 1).otherwise(0)
    both = F.array(pair(0, "horizontal", c("y"), c("x"), c("x") + c("w"), "down"), pair(1, "vertical", c("x"), c("y") + shift, c("y") + c("h") + shift, "right"))
    m = lambda v: F.lit(v)
    e = A.view(s, d, "v_regions").select(k.alias("page_id"), F.explode(both).alias("e")).select("page_id", "e.*").select(
        "*", c("page_id").alias("edge_group_id"), m(2).alias("edge_group_size"), m("orthogonal_corner").alias("inference_type"), (c("axis_end") - c("axis_start")).cast("double").alias("length_px"), (c("page_id") % 3 > 0).alias("on_boundary"),
        F.array(m("a")).alias("anchor_ids"), F.array(m("a"), m("b")).alias("source_ids"), F.when(c("page_id") % 6 == 0, "rejected_candidate").otherwise("accepted_candidate").alias("decision"), m(0.875).alias("inside_mean"), m(0.125).alias("outside_mean"),
        F.when(c("page_id") % 4 == 0, 0.25).otherwise(0.5).alias("boundary_mean"), F.when(c("page_id") % 8 == 3, 0.5).otherwise(0.9).alias("inside_share"), F.when(c("page_id") % 8 == 5, 0.5).otherwise(0.1).alias("outside_share"), F.when(c("page_id") % 9 == 2, 0.5).otherwise(0.75).alias("mean_difference"))
    pages = A.view(s, d, "v_regions").select(k.alias("page_id"), m(400.0).alias("short_side_px"), m(1e9).alias("perimeter_px"), (k % 7 == 0).alias("calculation_only"))
    return X.inferred_edge_checks(e, pages).select("page_id", F.array_join("errors", ";").alias("errors"))


add("C20_inferred_edge_checks", _c20, """, r AS (SELECT region_id AS k, region_id % 7 > 0 AS strict, w, h FROM v_regions)
SELECT k AS page_id, concat_ws(';', CASE WHEN strict AND k % 8 = 3 THEN 'discontinuous_footprint_support' END, CASE WHEN strict AND k % 8 = 5 THEN 'edge_crosses_interior' END, CASE WHEN k % 6 = 0 THEN 'edge_not_accepted' END, CASE WHEN k % 3 = 0 THEN 'edge_not_on_boundary' END,
 CASE WHEN strict AND greatest(w, h) > 40 THEN 'edge_too_long' END, CASE WHEN strict AND k % 9 = 2 THEN 'invalid_footprint_evidence' END, CASE WHEN k % 5 = 1 THEN 'no_shared_corner' END, CASE WHEN strict AND k % 4 = 0 THEN 'weak_footprint_evidence' END) AS errors FROM r""", REG)


def _envelopes(s, d):
    """Boxes with a notch of a region's size in the upper right corner; the top stops short by 4, or by nothing every fifth time."""
    from thermograph.plans import topology as T
    r = _spread(s, A.view(s, d, "v_regions")).select(c("region_id").alias("page_id"), *[(c(n) * 4).cast("bigint").alias(n) for n in ("x", "y", "w", "h")])
    k, x, y, w, h = (c(n) for n in ("page_id", "x", "y", "w", "h"))
    short = F.when(k % 5 == 0, 0).otherwise(4)
    side = lambda n, o, f, a, b, into: F.struct((k * 10 + n).alias("wall_id"), F.lit(o).alias("orientation"), f.alias("fixed"), a.alias("axis_start"), b.cast("bigint").alias("axis_end"), F.lit(into).alias("inside_direction"))
    walls = r.select("page_id", F.explode(F.array(side(1, "horizontal", y, x, x + w - short, "down"), side(2, "horizontal", y + 4 * h, x, x + 2 * w, "up"), side(3, "vertical", x, y, y + 4 * h, "right"),
                                                  side(4, "vertical", x + w, y, y + 2 * h - 1, "left"), side(5, "vertical", x + 2 * w, y + 2 * h, y + 4 * h, "left"))).alias("l")).select("page_id", "l.*")
    openings = r.select("page_id", (k * 10).alias("opening_id"), F.lit("horizontal").alias("orientation"), (y + 2 * h).alias("fixed"), (x + w).alias("gap_start"), (x + w + 8).alias("gap_end"), F.array(k * 10 + 3, k * 10 + F.when(k % 3 == 0, 9).otherwise(4)).alias("host_ids"))
    return T.calculation_envelope(walls, openings, 1000, 1300)


_g5 = _staged("envelopes", _envelopes)


add("G5_calculation_envelope", lambda s, d: _g5(s, d)["pages"].select("page_id", "status", "area", "perimeter", "inferred_length", F.array_join(F.transform("points", lambda p: F.concat_ws(" ", p["x"], p["y"])), ",").alias("points")), """
, r AS (SELECT region_id AS page_id, 4 * x AS x, 4 * y AS y, 4 * w AS w, 4 * h AS h FROM v_regions)
SELECT page_id, 'review_required' AS status, (6 * w * h)::DOUBLE AS area, (4 * w + 8 * h)::DOUBLE AS perimeter, (w - CASE WHEN page_id % 3 = 0 THEN 0 ELSE 8 END + 1 + CASE WHEN page_id % 5 = 0 THEN 0 ELSE 4 END)::DOUBLE AS inferred_length,
 concat_ws(',', x || ' ' || y, (x + w) || ' ' || y, (x + w) || ' ' || (y + 2 * h), (x + 2 * w) || ' ' || (y + 2 * h), (x + 2 * w) || ' ' || (y + 4 * h), x || ' ' || (y + 4 * h)) AS points FROM r""", REG)
add("G5_inferred_edges", lambda s, d: _g5(s, d)["inferred"].select("page_id", "orientation", "fixed", "axis_start", "axis_end", "inside_direction"), """
, r AS (SELECT region_id AS page_id, 4 * x AS x, 4 * y AS y, 4 * w AS w, 4 * h AS h FROM v_regions)
SELECT page_id, 'horizontal' AS orientation, y + 2 * h AS fixed, x + w + CASE WHEN page_id % 3 = 0 THEN 0 ELSE 8 END AS axis_start, x + 2 * w AS axis_end, 'down' AS inside_direction FROM r
UNION ALL SELECT page_id, 'vertical', x + w, y + 2 * h - 1, y + 2 * h, 'left' FROM r UNION ALL SELECT page_id, 'horizontal', y, x + w - 4, x + w, 'down' FROM r WHERE page_id % 5 > 0""", REG)
add("G5_evidence", lambda s, d: _g5(s, d)["evidence"], """
SELECT region_id AS page_id, 'wall' AS kind, (region_id * 10 + n)::VARCHAR AS id FROM v_regions, (VALUES (1), (2), (3), (4), (5)) AS t(n) UNION ALL SELECT region_id, 'opening', (region_id * 10)::VARCHAR FROM v_regions WHERE region_id % 3 > 0""", REG)


def _w13(s, d):
    from thermograph.plans import exterior as X
    r = A.view(s, d, "v_segments").groupBy("page_id", c("axis_start").alias("y")).agg(F.min("fixed").alias("v"))
    r = r.select("page_id", F.lit("l").alias("side"), "y", F.when(c("v") % 3 > 0, F.floor(c("v") / 21)).alias("value"))
    f = X.fill_profile(r, ["page_id", "side"])
    return X.smooth_profile(f.withColumn("min_run", F.lit(4)), ["page_id", "side"], "min_run")


add("W13_profile_fill_smooth", lambda s, d: _w13(s, d).select("page_id", "y0", "y1", "value"))
