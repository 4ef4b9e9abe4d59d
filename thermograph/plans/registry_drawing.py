"""Registered queries of the drawing family."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermograph.operators import drawing as D
from thermograph.operators import intervals as I
from thermograph.plans import adapters as A
from thermograph.session import cut_lineage

QUERIES: dict = {}
c = F.col


def add(name, fn, sql=None, views=()):
    QUERIES[name] = (fn, A.with_views(sql.strip(), *views) if sql and views else sql)


SEG = ("v_segments",)
A.VIEWS["v_spans"] = """
SELECT o_orderkey AS span_id, o_orderkey % 50 AS page_id, CASE WHEN o_custkey % 2 = 0 THEN 'horizontal' ELSE 'vertical' END AS direction,
 CAST(o_custkey % 700 AS DOUBLE) AS across, CAST(o_orderkey % 450 AS DOUBLE) AS along, CAST(4 + o_orderkey % 9 AS DOUBLE) AS font_size,
 CAST(o_orderkey % 450 - 6 AS DOUBLE) AS t0, CAST(o_orderkey % 450 + 6 AS DOUBLE) AS t1,
 CASE WHEN o_orderkey % 9 > 0 THEN CAST(1 + o_orderkey % 40 AS DOUBLE) / 4 END AS metres FROM orders"""


def seg(s, d):
    return A.view(s, d, "v_segments")


def spans(s, d):
    v = A.view(s, d, "v_spans")
    h = c("direction") == "horizontal"
    return v.withColumns({"cx": F.when(h, c("along")).otherwise(c("across")), "cy": F.when(h, c("across")).otherwise(c("along"))})


def bordered(s, d):
    return seg(s, d).withColumn("is_border", c("fixed") % 5 == 0)


_KEYS = ["page_id", "orientation", "fixed"]
_ISL = """, a AS (SELECT *, CASE WHEN axis_start > coalesce(max(axis_end) OVER (PARTITION BY {k} ORDER BY axis_start, axis_end, {u} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000000) + {t} THEN 1 ELSE 0 END AS nw FROM {f}),
b AS (SELECT *, sum(nw) OVER (PARTITION BY {k} ORDER BY axis_start, axis_end, {u} ROWS UNBOUNDED PRECEDING) AS isl FROM a)"""


def _isl(k, t=0, f="v_segments", u="seg_id"):
    return _ISL.format(k=k, t=t, f=f, u=u)


add("W2_merge_collinear", lambda s, d: I.merge_collinear(seg(s, d), _KEYS), _isl("page_id, orientation, fixed") + """
SELECT page_id, orientation, fixed, min(axis_start) AS axis_start, max(axis_end) AS axis_end, count(*) AS n_rows FROM b GROUP BY page_id, orientation, fixed, isl""", SEG)
add("W2_merge_with_sources", lambda s, d: I.merge_with_sources(seg(s, d), _KEYS, "seg_id").withColumn("source_ids", F.array_join(c("source_ids").cast("array<string>"), ",")), _isl("page_id, orientation, fixed") + """
SELECT page_id, orientation, fixed, min(axis_start) AS axis_start, max(axis_end) AS axis_end, array_to_string(list_sort(list_distinct(list(seg_id))), ',') AS source_ids FROM b GROUP BY page_id, orientation, fixed, isl""", SEG)
add("W2_page_coverage", lambda s, d: I.merge_collinear(seg(s, d), ["page_id"], tile=32), _isl("page_id") + " SELECT page_id, min(axis_start) AS axis_start, max(axis_end) AS axis_end, count(*) AS n_rows FROM b GROUP BY page_id, isl", SEG)


def _chain(s, d):
    n = seg(s, d).select("page_id", "orientation", "fixed", "axis_start", "axis_end", c("seg_id").alias("node_id"),
                         F.when(c("seg_id") % 3 == 0, "anchor").when(c("seg_id") % 3 == 1, "uncertain_wall").otherwise("door_arc").alias("node_type"))
    return I.chain_components(n, _KEYS)


add("W3_chain_components", _chain, _isl("page_id, orientation, fixed", 12) + """
, g AS (SELECT page_id, orientation, fixed, min(axis_start) AS axis_start, max(axis_end) AS axis_end, count(DISTINCT seg_id) FILTER (WHERE seg_id % 3 = 0) AS n_anchors, count(DISTINCT seg_id) FILTER (WHERE seg_id % 3 = 2) AS n_arcs,
 count(DISTINCT seg_id) FILTER (WHERE seg_id % 3 = 1) AS n_walls FROM b GROUP BY page_id, orientation, fixed, isl)
SELECT *, CASE WHEN n_anchors >= 2 THEN 'confirmed' WHEN n_anchors = 1 THEN 'pending' ELSE 'ignored' END AS status FROM g WHERE n_arcs > 0""", SEG)
add("W4_axis_clusters", lambda s, d: I.axis_clusters(seg(s, d), ["page_id", "orientation"], 8, 450), """
, w AS (SELECT page_id, orientation, fixed AS axis, axis_start AS a, axis_end AS z, seg_id FROM v_segments WHERE axis_start < axis_end),
g AS (SELECT *, CASE WHEN axis - lag(axis, 1, -100000) OVER (PARTITION BY page_id, orientation ORDER BY axis, seg_id) > 8 THEN 1 ELSE 0 END AS nw FROM w),
k AS (SELECT *, sum(nw) OVER (PARTITION BY page_id, orientation ORDER BY axis, seg_id ROWS UNBOUNDED PRECEDING) AS cl FROM g),
u AS (SELECT DISTINCT page_id, orientation, cl, unnest(range(a, z + 1)) AS p FROM k), v AS (SELECT page_id, orientation, cl, count(*) AS coverage FROM u GROUP BY ALL)
SELECT k.page_id, k.orientation, min(axis) AS axis_min, max(axis) AS axis_max, count(*) AS n_walls, any_value(coverage) AS coverage FROM k JOIN v USING (page_id, orientation, cl) GROUP BY k.page_id, k.orientation, k.cl HAVING any_value(coverage) >= 18""", SEG)


def _walls(s, d):
    m = I.merge_collinear(seg(s, d), _KEYS)
    return m.withColumns({"wall_id": F.concat_ws(":", "orientation", "fixed", "axis_start"), "inside_direction": F.when(c("orientation") == "horizontal", F.when(c("fixed") % 2 == 0, "up").otherwise("down")).otherwise(F.when(c("fixed") % 2 == 0, "left").otherwise("right"))})


def _roi(s, d):
    return seg(s, d).select("page_id").distinct().select("page_id", F.lit(10).alias("left"), F.lit(10).alias("top"), F.lit(600).alias("right"), F.lit(440).alias("bottom"))


_WALLS = _isl("page_id, orientation, fixed", 0, "v_segments") + """
, w AS (SELECT page_id, orientation, fixed, min(axis_start) AS axis_start, max(axis_end) AS axis_end, orientation || ':' || fixed || ':' || min(axis_start) AS wall_id,
 CASE WHEN orientation = 'horizontal' THEN CASE WHEN fixed % 2 = 0 THEN 'up' ELSE 'down' END ELSE CASE WHEN fixed % 2 = 0 THEN 'left' ELSE 'right' END END AS dir FROM b GROUP BY page_id, orientation, fixed, isl),
p AS (SELECT l.*, r.wall_id AS r_id, r.fixed AS r_fixed, r.axis_start AS r_start, r.dir AS r_dir FROM w l JOIN w r ON l.page_id = r.page_id AND l.orientation = r.orientation AND r.wall_id <> l.wall_id AND abs(r.fixed - l.fixed) <= {tol} AND r.axis_start > l.axis_end),
f AS (SELECT page_id, wall_id, min(r_start) AS rs FROM p GROUP BY ALL), n AS (SELECT p.*, count(*) OVER (PARTITION BY p.page_id, p.wall_id) AS k, row_number() OVER (PARTITION BY p.page_id, p.wall_id ORDER BY r_id) AS rn FROM p JOIN f ON f.page_id = p.page_id AND f.wall_id = p.wall_id AND f.rs = p.r_start),
g AS (SELECT *, EXISTS (SELECT 1 FROM w x WHERE x.page_id = n.page_id AND x.orientation <> n.orientation AND x.fixed > n.axis_end AND x.fixed < n.r_start AND n.fixed BETWEEN x.axis_start - {tol} AND x.axis_end + {tol}) AS crossed,
 CASE WHEN orientation = 'horizontal' THEN axis_end < 10 OR r_start > 600 OR fixed NOT BETWEEN 10 AND 440 OR r_fixed NOT BETWEEN 10 AND 440 ELSE axis_end < 10 OR r_start > 440 OR fixed NOT BETWEEN 10 AND 600 OR r_fixed NOT BETWEEN 10 AND 600 END AS outside FROM n WHERE rn = 1)
"""
add("W6_exterior_gaps", lambda s, d: D.exterior_gaps(_walls(s, d), _roi(s, d), tol=8).select("page_id", "wall_id", "r_id", "gap_start", "gap_end", "decision", F.array_join("reason_codes", ";").alias("reasons")),
    _WALLS.format(tol=8) + """, z AS (SELECT *, CASE WHEN k > 1 THEN 'multiple_competing_endpoints' ELSE concat_ws(';', CASE WHEN fixed <> r_fixed THEN 'not_strictly_collinear' END, CASE WHEN dir <> r_dir THEN 'different_inside_directions' END, CASE WHEN crossed THEN 'perpendicular_structural_crossing' END, CASE WHEN outside THEN 'outside_building_roi' END) END AS rs0 FROM g)
SELECT page_id, wall_id, r_id, axis_end AS gap_start, r_start AS gap_end, CASE WHEN rs0 = '' THEN 'accepted_gap' ELSE 'rejected_gap' END AS decision, CASE WHEN rs0 = '' THEN 'unambiguous_collinear_exterior_gap' ELSE rs0 END AS reasons FROM z""", SEG)
add("J16_perpendicular_crossing_anti", lambda s, d: D.perpendicular_crossing_anti(
    D.exterior_gaps(_walls(s, d), _roi(s, d)).select("page_id", c("wall_id").alias("gap_key"), "orientation", "fixed", "gap_start", "gap_end"), _walls(s, d)).select("page_id", "gap_key"),
    _WALLS.format(tol=2) + " SELECT page_id, wall_id AS gap_key FROM g WHERE NOT crossed", SEG)
add("W14_coverage_complement", lambda s, d: I.coverage_complement(seg(s, d).select("page_id", "orientation", "fixed").distinct().withColumns({"e0": F.lit(0).cast("bigint"), "e1": F.lit(420).cast("bigint")}), seg(s, d), _KEYS).select("page_id", "orientation", "fixed", "gap_start", "gap_end"),
    _isl("page_id, orientation, fixed", 0, "(SELECT * REPLACE (least(axis_end, 420) AS axis_end) FROM v_segments WHERE axis_start < 420)") + """
, m AS (SELECT page_id, orientation, fixed, min(axis_start) AS s, max(axis_end) AS e FROM b GROUP BY page_id, orientation, fixed, isl UNION ALL SELECT DISTINCT page_id, orientation, fixed, 0, 0 FROM v_segments UNION ALL SELECT DISTINCT page_id, orientation, fixed, 420, 420 FROM v_segments),
l AS (SELECT *, lag(e) OVER (PARTITION BY page_id, orientation, fixed ORDER BY s, e) AS p FROM m) SELECT page_id, orientation, fixed, p AS gap_start, s AS gap_end FROM l WHERE p < s""", SEG)

_SP = ("v_segments", "v_spans")
_J5 = """, j AS (SELECT p.page_id, span_id, s.orientation, seg_id, fixed, axis_start, axis_end, abs(fixed - across) AS distance, metres, row_number() OVER (PARTITION BY p.page_id, span_id ORDER BY abs(fixed - across), axis_end - axis_start DESC, seg_id) AS rn
 FROM v_spans p JOIN v_segments s ON s.page_id = p.page_id AND s.orientation = p.direction AND fixed % 5 <> 0 AND metres IS NOT NULL AND along BETWEEN axis_start - 2 AND axis_end + 2 AND axis_end - axis_start >= greatest(12, font_size * 2) AND abs(fixed - across) <= greatest(24, font_size * 3)),
m AS (SELECT * FROM j WHERE rn = 1)"""
add("J5_dimension_line_match", lambda s, d: D.dimension_line_match(spans(s, d), bordered(s, d)).select("page_id", "span_id", "seg_id", "distance", "metres"), _J5 + " SELECT page_id, span_id, seg_id, distance, metres FROM m", _SP)
add("J6_endpoint_marker_join", lambda s, d: D.endpoint_markers(D.dimension_line_match(spans(s, d), bordered(s, d)), seg(s, d), tol=6), _J5 + """
, e AS (SELECT page_id, span_id, orientation, fixed AS main, 0 AS side, axis_start AS pt FROM m UNION ALL SELECT page_id, span_id, orientation, fixed, 1, axis_end FROM m),
k AS (SELECT e.page_id, span_id, side, seg_id, row_number() OVER (PARTITION BY e.page_id, span_id, side ORDER BY axis_end - axis_start, seg_id) AS rn FROM e JOIN v_segments s ON s.page_id = e.page_id AND s.orientation <> e.orientation AND abs(s.fixed - pt) <= 6 AND main BETWEEN axis_start - 6 AND axis_end + 6)
SELECT page_id, span_id, max(seg_id) FILTER (WHERE side = 0) AS start_marker, max(seg_id) FILTER (WHERE side = 1) AS end_marker FROM k WHERE rn = 1 GROUP BY page_id, span_id HAVING count(*) = 2""", _SP)
add("J7_bridge_split_dimension", lambda s, d: D.bridge_split_dimension(spans(s, d), seg(s, d)).select("page_id", "span_id", "f_id", "g_id", "axis_start", "axis_end"), """
, f AS (SELECT p.*, s.seg_id AS f_id, s.fixed AS ff, s.axis_start AS fa, s.axis_end AS fz FROM v_spans p JOIN v_segments s ON s.page_id = p.page_id AND s.orientation = p.direction AND abs(s.fixed - across) <= greatest(24, font_size * 3) AND s.axis_end BETWEEN t0 - 12 AND t0 + 3 AND s.axis_start < t0)
SELECT f.page_id, span_id, f_id, g.seg_id AS g_id, least(fa, g.axis_start) AS axis_start, CASE WHEN g.axis_start < fa THEN fz ELSE g.axis_end END AS axis_end FROM f JOIN v_segments g ON g.page_id = f.page_id AND g.orientation = f.direction AND abs(g.fixed - across) <= greatest(24, font_size * 3)
 AND g.axis_start BETWEEN t1 - 3 AND t1 + 12 AND g.axis_end > t1 AND g.seg_id <> f_id AND abs(g.fixed - ff) <= 1
WHERE (CASE WHEN g.axis_start < fa THEN fa - g.axis_end ELSE g.axis_start - fz END) BETWEEN 0 AND t1 - t0 + 12 AND (CASE WHEN g.axis_start < fa THEN g.axis_end ELSE fz END) <= t0 + 3 AND (CASE WHEN g.axis_start < fa THEN fa ELSE g.axis_start END) >= t1 - 3""", _SP)
add("J8_native_dimension_match", lambda s, d: D.native_dimension_match(spans(s, d), seg(s, d)), """
, c0 AS (SELECT p.page_id, span_id, s.seg_id, s.orientation, s.fixed, axis_start, axis_end, abs(s.fixed - across) AS dist FROM v_spans p JOIN v_segments s ON s.page_id = p.page_id AND s.orientation = p.direction AND abs(s.fixed - across) <= 30 AND abs((axis_start + axis_end) / 2 - along) <= (axis_end - axis_start) * 0.65::DOUBLE),
k AS (SELECT DISTINCT page_id, seg_id, orientation, fixed, axis_start, axis_end FROM c0),
e AS (SELECT k.page_id, k.seg_id, m.fixed AS mark_at, m.seg_id AS mid FROM k JOIN v_segments m ON m.page_id = k.page_id AND m.orientation <> k.orientation AND m.axis_end - m.axis_start <= 40 AND (abs(m.fixed - k.axis_start) <= 2 OR abs(m.fixed - k.axis_end) <= 2) AND k.fixed BETWEEN m.axis_start - 1 AND m.axis_end + 1),
o AS (SELECT page_id, seg_id, arg_min(mid, mark_at * 1000000000000 + mid) AS first_marker, arg_max(mid, mark_at * 1000000000000 - mid) AS last_marker FROM e GROUP BY ALL HAVING max(mark_at) - min(mark_at) > 1),
r AS (SELECT c0.*, first_marker, last_marker, row_number() OVER (PARTITION BY c0.page_id, span_id ORDER BY dist, axis_end - axis_start DESC, c0.seg_id) AS rn FROM c0 JOIN o USING (page_id, seg_id))
SELECT page_id, span_id, seg_id, first_marker, last_marker FROM r WHERE rn = 1""", _SP)
add("J9_intersections", lambda s, d: D.intersections(seg(s, d)).groupBy("page_id", "h_id").agg(F.count("*").alias("crossings"), F.min("x").alias("x0"), F.max("x").alias("x1")),
    """SELECT h.page_id, h.seg_id AS h_id, count(*) AS crossings, min(v.fixed) AS x0, max(v.fixed) AS x1 FROM v_segments h JOIN v_segments v ON h.page_id = v.page_id AND h.orientation = 'horizontal' AND v.orientation = 'vertical'
 AND v.fixed BETWEEN h.axis_start AND h.axis_end AND h.fixed BETWEEN v.axis_start AND v.axis_end GROUP BY 1, 2""", SEG)
add("J9_atomic_edges", lambda s, d: D.atomic_edges(seg(s, d)).groupBy("page_id", "seg_id", "orientation", "fixed").agg(F.count("*").alias("pieces"), F.sum(c("b") - c("a")).alias("length")), """
, t AS (SELECT * FROM v_segments), x AS (SELECT h.page_id, h.seg_id AS hi, v.seg_id AS vi, v.fixed AS x, h.fixed AS y FROM t h JOIN t v ON h.page_id = v.page_id AND h.orientation = 'horizontal' AND v.orientation = 'vertical' AND v.fixed BETWEEN h.axis_start AND h.axis_end AND h.fixed BETWEEN v.axis_start AND v.axis_end),
k AS (SELECT page_id, seg_id, orientation, fixed, axis_start AS pt FROM t UNION SELECT page_id, seg_id, orientation, fixed, axis_end FROM t UNION SELECT page_id, hi, 'horizontal', y, x FROM x UNION SELECT page_id, vi, 'vertical', x, y FROM x)
SELECT page_id, seg_id, orientation, fixed, count(*) - 1 AS pieces, (max(pt) - min(pt))::BIGINT AS length FROM k GROUP BY 1, 2, 3, 4 HAVING count(*) > 1""", SEG)


def _j10(s, d):
    g = D.exterior_gaps(_walls(s, d), _roi(s, d)).select("page_id", "orientation", "fixed", "gap_start", "gap_end", c("wall_id").alias("gap_key"), F.array("wall_id", "r_id").alias("host_ids"))
    g = cut_lineage(g)
    o = g.withColumn("n", F.explode(F.sequence(F.lit(1), (c("fixed") % 3).cast("int")))).filter("fixed % 3 > 0").select("page_id", "orientation", "fixed", "gap_start", "gap_end", F.reverse("host_ids").alias("host_ids"), F.concat_ws("#", "gap_key", "n").alias("opening_id"))
    return D.gap_opening_match(g, o).select("page_id", "gap_key", "match", "opening_id")


add("J10_gap_opening_match", _j10, _WALLS.format(tol=2) + " SELECT page_id, wall_id AS gap_key, CASE fixed % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'multiple' END AS match, CASE WHEN fixed % 3 = 1 THEN wall_id || '#1' END AS opening_id FROM g", SEG)


def _gaps(s, d):
    return seg(s, d).select("page_id", "orientation", "fixed", c("axis_start").alias("gap_start"), c("axis_end").alias("gap_end"), c("seg_id").alias("gap_key"))


def _curves(s, d):
    return A.view(s, d, "v_regions").select("page_id", c("region_id").alias("curve_id"), (c("x") * 5).alias("x0"), (c("y") * 5).alias("y0"), (c("x") * 5 + c("w")).alias("x1"), (c("y") * 5 + c("h")).alias("y1"),
                                            (c("x") * 5).alias("sx"), (c("y") * 5).alias("sy"), (c("x") * 5 + c("w")).alias("ex"), (c("y") * 5 + c("h")).alias("ey"))


add("J11_gap_curve_join", lambda s, d: D.gap_curve_join(_gaps(s, d), _curves(s, d)).select("page_id", "gap_key", F.array_join(c("curve_ids").cast("array<string>"), ",").alias("curves")), """
, g AS (SELECT page_id, seg_id AS gap_key, CASE WHEN orientation = 'horizontal' THEN axis_start ELSE fixed END AS gx0, CASE WHEN orientation = 'horizontal' THEN axis_end ELSE fixed END AS gx1, CASE WHEN orientation = 'horizontal' THEN fixed ELSE axis_start END AS gy0, CASE WHEN orientation = 'horizontal' THEN fixed ELSE axis_end END AS gy1 FROM v_segments),
k AS (SELECT page_id, region_id AS id, x * 5 AS x0, y * 5 AS y0, x * 5 + w AS x1, y * 5 + h AS y1 FROM v_regions)
SELECT g.page_id, gap_key, string_agg(id::VARCHAR, ',' ORDER BY id) AS curves FROM g JOIN k ON k.page_id = g.page_id AND gx0 >= x0 - 12 AND gx1 <= x1 + 12 AND gy0 >= y0 - 12 AND gy1 <= y1 + 12
 AND least((gx0 - x0) ** 2 + (gy0 - y0) ** 2, (gx1 - x0) ** 2 + (gy1 - y0) ** 2, (gx0 - x1) ** 2 + (gy0 - y1) ** 2, (gx1 - x1) ** 2 + (gy1 - y1) ** 2) <= 144 GROUP BY 1, 2""", ("v_segments", "v_regions"))
add("J11_gap_short_segments", lambda s, d: D.gap_short_segment_join(_gaps(s, d), seg(s, d)), """
SELECT g.page_id, g.seg_id AS gap_key, count(*) AS short_lines FROM v_segments g JOIN v_segments s ON s.page_id = g.page_id AND s.orientation = g.orientation AND abs(s.fixed - g.fixed) <= 12 AND s.axis_start <= g.axis_end + 12 AND s.axis_end >= g.axis_start - 12 GROUP BY 1, 2""", SEG)
# Two inputs: every line is either an anchor or a candidate.
add("J12_anchor_both_ends_semi", lambda s, d: D.anchor_both_ends_semi(seg(s, d).filter("seg_id % 9 > 0"), seg(s, d).filter("seg_id % 9 = 0")).select("page_id", "seg_id", "touching"), """
, c0 AS (SELECT *, CASE WHEN orientation = 'horizontal' THEN axis_start ELSE fixed END AS x0, CASE WHEN orientation = 'horizontal' THEN axis_end ELSE fixed END AS x1, CASE WHEN orientation = 'horizontal' THEN fixed ELSE axis_start END AS y0, CASE WHEN orientation = 'horizontal' THEN fixed ELSE axis_end END AS y1 FROM v_segments),
a AS (SELECT * FROM c0 WHERE seg_id % 9 = 0), k AS (SELECT * FROM c0 WHERE seg_id % 9 > 0 AND axis_end - axis_start >= 40),
e AS (SELECT page_id, seg_id, 0 AS side, x0 AS px, y0 AS py FROM k UNION ALL SELECT page_id, seg_id, 1, x1, y1 FROM k),
t AS (SELECT e.page_id, e.seg_id, count(DISTINCT side) AS sides, count(DISTINCT a.seg_id) AS touching FROM e JOIN a ON a.page_id = e.page_id AND px BETWEEN a.x0 - 36 AND a.x1 + 36 AND py BETWEEN a.y0 - 36 AND a.y1 + 36 GROUP BY 1, 2)
SELECT k.page_id, k.seg_id, touching FROM k JOIN t USING (page_id, seg_id) WHERE sides = 2 AND touching >= 2 AND (NOT EXISTS (SELECT 1 FROM a WHERE a.page_id = k.page_id AND a.orientation = k.orientation) OR EXISTS (SELECT 1 FROM a WHERE a.page_id = k.page_id AND a.orientation = k.orientation AND abs(a.fixed - k.fixed) <= 8))""", SEG)
add("J13_nearest_band_join", lambda s, d: D.nearest_band_join(seg(s, d), seg(s, d).filter("seg_id % 31 = 0").select("page_id", "orientation", c("seg_id").alias("band_id"), "fixed")).select("page_id", "seg_id", "band_id", "distance"), """
SELECT s.page_id, s.seg_id, arg_min(b.seg_id, abs(b.fixed - s.fixed) * 100000000000000 + b.seg_id) AS band_id, min(abs(b.fixed - s.fixed)) AS distance FROM v_segments s JOIN v_segments b ON b.seg_id % 31 = 0 AND b.page_id = s.page_id AND b.orientation = s.orientation AND abs(b.fixed - s.fixed) <= 16 GROUP BY 1, 2""", SEG)


def _regions(s, d, snap):
    return A.view(s, d, "v_regions").filter(f"snapshot = {snap}")


_IOU = """, p AS (SELECT n.page_id, n.region_id AS new_id, o.region_id AS old_id, n.w * n.h AS na, o.w * o.h AS oa, greatest(0, least(n.x + n.w, o.x + o.w) - greatest(n.x, o.x)) * greatest(0, least(n.y + n.h, o.y + o.h) - greatest(n.y, o.y)) AS it
 FROM v_regions n JOIN v_regions o ON n.page_id = o.page_id AND n.snapshot = 1 AND o.snapshot = 0), m AS (SELECT * FROM p WHERE it / (na + oa - it) >= 0.8::DOUBLE AND abs(na - oa) <= greatest(12, oa * 0.05::DOUBLE))"""
add("J14_region_match_iou", lambda s, d: D.region_matches(_regions(s, d, 0), _regions(s, d, 1)), _IOU + " SELECT page_id, new_id, old_id FROM m", ("v_regions",))
add("J14_new_regions", lambda s, d: _regions(s, d, 1).join(D.region_matches(_regions(s, d, 0), _regions(s, d, 1)).select(c("new_id").alias("region_id")).distinct(), "region_id", "left_anti").select("region_id", "page_id"),
    _IOU + " SELECT region_id, page_id FROM v_regions WHERE snapshot = 1 AND region_id NOT IN (SELECT new_id FROM m)", ("v_regions",))


def _j14(s, d):
    """Areas before and after; after, every seventh room is a quarter larger and every eleventh page has one more."""
    r = A.view(s, d, "v_regions").select((c("region_id") % 900).alias("page_id"), "region_id", (c("w") * c("h")).cast("double").alias("area"))
    grown = r.select("page_id", (c("area") * F.when(c("region_id") % 7 == 0, 1.25).otherwise(1.0) + c("page_id") % 13).alias("area"))
    more = r.filter("page_id % 11 = 0").select("page_id", F.lit(50.0).alias("area")).distinct()
    return D.rooms_stable(r.select("page_id", "area"), grown.unionByName(more))


add("J14_rooms_stable", _j14, """, r AS (SELECT region_id % 900 AS page_id, region_id, (w * h)::DOUBLE AS area FROM v_regions),
a AS (SELECT page_id, area * CASE WHEN region_id % 7 = 0 THEN 1.25 ELSE 1 END + page_id % 13 AS area FROM r UNION ALL SELECT DISTINCT page_id, 50 FROM r WHERE page_id % 11 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY area) AS k FROM r), n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY area) AS k FROM a)
SELECT coalesce(o.page_id, n.page_id) AS page_id, bool_and(coalesce(abs(o.area - n.area) <= greatest(12, o.area * 0.03::DOUBLE), false)) AS stable FROM o FULL JOIN n ON n.page_id = o.page_id AND n.k = o.k GROUP BY 1""", ("v_regions",))


def _n22(s, d):
    # Equal boxes have equal best partners: each is compared once.
    box = lambda n, p: _regions(s, d, n).select("page_id", *[c(k).alias(p + k) for k in ("x", "y", "w", "h")]).distinct()
    j = I.range_join(box(0, "a"), box(1, "b"), ["page_id"], (c("ax"), c("ax") + c("aw")), (c("bx"), c("bx") + c("bw")), 32)
    t = lambda p: tuple(c(p + k) for k in ("x", "y", "w", "h"))
    best = j.groupBy("page_id", "ax", "ay", "aw", "ah").agg(F.round(F.max(D.bbox_iou(t("a"), t("b"))), 9).alias("best_iou"))
    a = _regions(s, d, 0).select("page_id", *[c(k).alias("a" + k) for k in ("region_id", "x", "y", "w", "h")])
    return a.join(best, ["page_id", "ax", "ay", "aw", "ah"]).select("page_id", "aregion_id", "best_iou")


add("N22_bbox_iou", _n22, """, p AS (SELECT o.page_id, o.region_id AS aregion_id, n.w * n.h + o.w * o.h AS s, greatest(0, least(n.x + n.w, o.x + o.w) - greatest(n.x, o.x)) * greatest(0, least(n.y + n.h, o.y + o.h) - greatest(n.y, o.y)) AS it
 FROM v_regions o JOIN v_regions n ON n.page_id = o.page_id AND o.snapshot = 0 AND n.snapshot = 1 AND o.x <= n.x + n.w AND n.x <= o.x + o.w) SELECT page_id, aregion_id, round(max(it / (s - it)::DOUBLE), 9) AS best_iou FROM p GROUP BY 1, 2""", ("v_regions",))

# -- predicates and scalars ---------------------------------------------------

add("F10_page_border", lambda s, d: seg(s, d).select("seg_id", D.page_border(c("orientation"), c("fixed"), c("axis_end") - c("axis_start"), F.lit(60.0), F.lit(55.0), 20.0).alias("border")),
    """SELECT seg_id, CASE WHEN orientation = 'horizontal' THEN least(abs(fixed), abs(55 - fixed)) <= 20 AND axis_end - axis_start >= 48 ELSE least(abs(fixed), abs(60 - fixed)) <= 20 AND axis_end - axis_start >= 44 END AS border FROM v_segments""", SEG)


def _lines(s, d):
    A.load_tables(s, d)
    return s.sql("""SELECT l_orderkey AS id, l_linenumber AS n, CAST(l_partkey % 100 AS DOUBLE) AS x0, CAST(l_suppkey % 60 AS DOUBLE) AS top, CASE l_partkey % 3 WHEN 0 THEN CAST(l_partkey % 100 AS DOUBLE) + l_quantity ELSE CAST(l_partkey % 100 AS DOUBLE) + 0.25 END AS x1,
     CASE l_partkey % 3 WHEN 0 THEN CAST(l_suppkey % 60 AS DOUBLE) + 0.5 WHEN 1 THEN CAST(l_suppkey % 60 AS DOUBLE) - l_quantity ELSE CAST(l_suppkey % 60 AS DOUBLE) + 0.25 END AS bottom FROM lineitem""")


add("F11_axis_segments", lambda s, d: D.axis_segments(_lines(s, d)).groupBy("orientation", "is_diagonal").agg(F.count("*").alias("n"), F.sum("fixed").alias("fixed"), F.sum("axis_start").alias("a"), F.sum("axis_end").alias("b")), """
WITH t AS (SELECT l_partkey % 3 AS k, (l_partkey % 100)::DOUBLE AS x, (l_suppkey % 60)::DOUBLE AS y, l_quantity AS q FROM lineitem), u AS (SELECT CASE WHEN k = 0 AND q > 0.5::DOUBLE THEN 'horizontal' WHEN k = 1 THEN 'vertical' END AS orientation,
 CASE k WHEN 0 THEN y + 0.25::DOUBLE WHEN 1 THEN x + 0.125::DOUBLE END AS f, CASE k WHEN 0 THEN x WHEN 1 THEN y - q END AS a, CASE k WHEN 0 THEN x + q WHEN 1 THEN y END AS b FROM t)
SELECT orientation, false AS is_diagonal, count(*) AS n, sum(f) AS fixed, sum(a) AS a, sum(b) AS b FROM u GROUP BY 1""")


def _ocr(s, d):
    A.load_tables(s, d)
    return s.sql("""SELECT l_orderkey % 40 AS page_id, l_orderkey * 10 + l_linenumber AS span_id, CASE WHEN l_partkey % 4 = 0 THEN 'abc' ELSE CAST(l_suppkey AS VARCHAR(9)) || CASE WHEN l_partkey % 2 = 0 THEN 'mm' ELSE '' END END AS text,
      l_discount * 10 AS confidence, l_quantity + 0.2 AS x0, l_quantity AS y0, l_quantity + 5 AS x1, l_quantity + 3 AS y1 FROM lineitem""").groupBy("page_id", "text", "confidence", "x0", "y0", "x1", "y1").agg(F.min("span_id").alias("span_id"))


add("F12_ocr_span_filter", lambda s, d: D.ocr_span_filter(_ocr(s, d)).select("page_id", "text", "span_id"), """
SELECT l_orderkey % 40 AS page_id, l_suppkey || CASE WHEN l_partkey % 2 = 0 THEN 'mm' ELSE '' END AS text, min(l_orderkey * 10 + l_linenumber) AS span_id FROM lineitem WHERE l_partkey % 4 > 0 AND l_discount * 10 >= 0.6 GROUP BY l_orderkey % 40, 2, l_quantity""")
add("F15_opening_short_segments", lambda s, d: D.opening_short_segments(bordered(s, d).withColumn("length", (c("axis_end") - c("axis_start")).cast("double")), seg(s, d).filter("seg_id % 6 = 0").select("page_id", "seg_id")).select("seg_id"),
    "SELECT seg_id FROM v_segments WHERE fixed % 5 <> 0 AND axis_end - axis_start BETWEEN 4 AND 80 AND seg_id % 6 <> 0", SEG)


def _f15c(s, d):
    k = c("curve_id")
    v = _curves(s, d).withColumns({"path_ops": F.when(k % 3 == 0, F.array(F.lit("m"), F.lit("c"))).when(k % 3 == 1, F.array(F.lit("m"), F.lit("c"), F.lit("h"))).otherwise(F.array(F.lit("m"), F.lit("l"))), "page_w": F.lit(40.0), "page_h": F.lit(40.0)})
    return D.opening_curves(v).select("curve_id")


add("F15_opening_curves", _f15c, "SELECT region_id AS curve_id FROM v_regions WHERE region_id % 3 = 0 AND NOT (w >= 32 AND h >= 32)", ("v_regions",))


def _cand(s, d):
    return seg(s, d).withColumns({"is_border": c("fixed") % 5 == 0, "roi_ratio": F.when(c("seg_id") % 11 > 0, (c("seg_id") % 21) / 20.0), "native_id": F.when(c("seg_id") % 4 > 0, c("seg_id"))})


add("C12_line_candidate_decision", lambda s, d: D.line_candidate_decision(_cand(s, d), seg(s, d).filter("seg_id % 6 = 0")).select("seg_id", "decision", F.array_join("reason_codes", ";").alias("reasons")), """
, r AS (SELECT seg_id, concat_ws(';', CASE WHEN seg_id % 6 = 0 THEN 'dimension_overlap' END, CASE WHEN fixed % 5 = 0 THEN 'page_border' END, CASE WHEN seg_id % 11 > 0 AND 1 - (seg_id % 21) / 20 >= 0.8::DOUBLE THEN 'outside_building_roi' END) AS t FROM v_segments)
SELECT seg_id, CASE WHEN t = '' THEN 'uncertain' ELSE 'rejected_nonstructural' END AS decision, CASE WHEN t = '' THEN 'model_evidence_pending' ELSE t END AS reasons FROM r""", SEG)
add("F16_recoverable_wall", lambda s, d: (lambda v: v.select("seg_id", D.recoverable_wall(v).alias("ok")))(_cand(s, d).withColumn("decision", F.when(c("seg_id") % 2 == 0, "uncertain").otherwise("accepted"))),
    "SELECT seg_id, (seg_id % 2 = 0 AND seg_id % 4 > 0 AND fixed % 5 <> 0 AND seg_id % 11 > 0 AND (seg_id % 21) / 20 >= 0.95::DOUBLE) AS ok FROM v_segments", SEG)
add("N17_neutral_brightness", lambda s, d: seg(s, d).select("seg_id", F.round(D.neutral_brightness(c("brightness"), c("brightness") + (c("seg_id") % 5) / 50.0, c("brightness")), 9).alias("b")),
    "SELECT seg_id, CASE WHEN (brightness + (seg_id % 5) / 50) - brightness <= 0.06::DOUBLE THEN round((brightness + (brightness + (seg_id % 5) / 50) + brightness) / 3, 9) END AS b FROM v_segments", SEG)
add("N18_point_to_pixel", lambda s, d: seg(s, d).select("seg_id", D.point_to_pixel(c("fixed"), F.lit(500), F.lit(1000.0)).alias("px")), "SELECT seg_id, round_even(fixed * 0.5::DOUBLE, 0)::BIGINT AS px FROM v_segments", SEG)


def _crops(s, d):
    return A.view(s, d, "v_regions").select("region_id", (c("x") - 5).alias("px0"), c("y").alias("py0"), (c("x") + c("w") * 6).alias("px1"), (c("y") + c("h") * 6).alias("py1"), F.lit(300).alias("preview_w"), F.lit(240).alias("preview_h"), F.lit(1001).alias("page_w"), F.lit(777).alias("page_h"))


add("N18_map_crop_bbox", lambda s, d: D.map_crop_bbox(_crops(s, d)).select("region_id", *[c(k).cast("bigint").alias(k) for k in ("left", "top", "right", "bottom")]), """
, a AS (SELECT region_id, least(greatest(floor((x - 5) * (1001 / 300)), 0), 1000)::BIGINT AS l, least(greatest(floor(y * (777 / 240)), 0), 776)::BIGINT AS t, x + w * 6 AS x1, y + h * 6 AS y1 FROM v_regions)
SELECT region_id, l AS "left", t AS top, least(greatest(ceil(x1 * (1001 / 300)), l + 1), 1001)::BIGINT AS "right", least(greatest(ceil(y1 * (777 / 240)), t + 1), 777)::BIGINT AS bottom FROM a""", ("v_regions",))
add("N19_valid_crop_region", lambda s, d: D.valid_crop_region(_crops(s, d)).select("region_id", F.array_join("errors", ";").alias("errors")), """
SELECT region_id, concat_ws(';', CASE WHEN x < 5 OR x + w * 6 > 300 OR y + h * 6 > 240 THEN 'outside_preview' END, CASE WHEN w * 6 + 5 < 128 OR h * 6 < 128 THEN 'side_too_short' END, CASE WHEN (w * 6 + 5) * (h * 6) < 720 THEN 'area_too_small' END) AS errors FROM v_regions""", ("v_regions",))
add("N20_clip_segments_to_crop", lambda s, d: D.clip_segments_to_crop(seg(s, d), _roi(s, d)).select("seg_id", "fixed", "axis_start", "axis_end"), """
, h AS (SELECT seg_id, fixed, axis_start AS a, axis_end AS z, CASE WHEN orientation = 'horizontal' THEN 600 ELSE 440 END AS hi, CASE WHEN orientation = 'horizontal' THEN 440 ELSE 600 END AS fhi FROM v_segments)
SELECT seg_id, fixed - 10 AS fixed, greatest(a, 10) - 10 AS axis_start, least(z, hi) - 10 AS axis_end FROM h WHERE fixed BETWEEN 10 AND fhi AND greatest(a, 10) < least(z, hi)""", SEG)
add("N21_inside_roi_ratio", lambda s, d: seg(s, d).select("seg_id", F.round(D.inside_roi_ratio(c("orientation"), c("fixed"), c("axis_start"), c("axis_end"), {"left": F.lit(50), "top": F.lit(40), "right": F.lit(300), "bottom": F.lit(350)}), 9).alias("ratio")), """
SELECT seg_id, round(CASE WHEN orientation = 'horizontal' THEN CASE WHEN fixed BETWEEN 40 AND 350 THEN greatest(0, least(axis_end, 300) - greatest(axis_start, 50)) / greatest(1, axis_end - axis_start) ELSE 0 END
 ELSE CASE WHEN fixed BETWEEN 50 AND 300 THEN greatest(0, least(axis_end, 350) - greatest(axis_start, 40)) / greatest(1, axis_end - axis_start) ELSE 0 END END, 9) AS ratio FROM v_segments""", SEG)


def _poly(s, d):
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y, w, h = (c(k) for k in ("x", "y", "w", "h"))
    return A.view(s, d, "v_regions").select("region_id", F.array(p(x, y), p(x + w, y), p(x + w, y + h), p(x + w / 2, y + h), p(x, y + h)).alias("pts"), x, y, w, h)


add("N23_polyline_length", lambda s, d: _poly(s, d).select("region_id", F.round(D.polyline_length(c("pts")), 9).alias("length")), "SELECT region_id, (w + h + w)::DOUBLE AS length FROM v_regions", ("v_regions",))
add("N24_polygon_area_perimeter", lambda s, d: _poly(s, d).select("region_id", D.polygon_measures(c("pts")).alias("m")).select("region_id", "m.*"), "SELECT region_id, (w * h)::DOUBLE AS area, (2 * (w + h))::DOUBLE AS perimeter FROM v_regions", ("v_regions",))
add("N25_simplify_polygon", lambda s, d: _poly(s, d).select("region_id", D.canonical_polygon(D.simplify_polygon(c("pts"))).alias("p")).select("region_id", F.size("p").cast("bigint").alias("n"), c("p")[0]["x"].alias("x0"), c("p")[1]["y"].alias("y1")),
    "SELECT region_id, 4::BIGINT AS n, x::DOUBLE AS x0, (y + h)::DOUBLE AS y1 FROM v_regions", ("v_regions",))
add("N32_axis_interval", lambda s, d: _lines(s, d).select("id", "n", D.axis_interval(c("x0"), c("top"), c("x1"), c("top"), F.when(c("n") % 2 == 0, "horizontal").otherwise("vertical")).alias("i")).select("id", "n", "i.*").groupBy("n").agg(F.count("fixed").alias("valid"), F.sum("axis_start").alias("a"), F.sum("axis_end").alias("b")), """
SELECT l_linenumber AS n, count(*) FILTER (WHERE l_linenumber % 2 = 0) AS valid, sum((l_partkey % 100)::DOUBLE) FILTER (WHERE l_linenumber % 2 = 0) AS a, sum((l_partkey % 100) + CASE WHEN l_partkey % 3 = 0 THEN l_quantity ELSE 0.25::DOUBLE END) FILTER (WHERE l_linenumber % 2 = 0) AS b FROM lineitem GROUP BY 1""")
add("N33_remap_classes", lambda s, d: seg(s, d).select("seg_id", D.remap_classes(c("seg_id") % 4).alias("cls")), "SELECT seg_id, CASE seg_id % 4 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE seg_id % 4 END AS cls FROM v_segments", SEG)
add("N34_dimension_side", lambda s, d: seg(s, d).select("seg_id", D.dimension_side(c("orientation"), c("fixed"), F.lit(700.0), F.lit(450.0)).alias("side")), """
SELECT seg_id, CASE WHEN orientation = 'horizontal' THEN CASE WHEN fixed < 225 THEN 'top' ELSE 'bottom' END ELSE CASE WHEN fixed < 350 THEN 'left' ELSE 'right' END END AS side FROM v_segments""", SEG)

# -- evidence -----------------------------------------------------------------

A.VIEWS["v_cells"] = """
SELECT vec_id % 20 AS page_id, CAST(floor(vec_id / 20) AS BIGINT) AS y, label AS cls, embedding FROM embeddings"""


def cells(s, d):
    return A.view(s, d, "v_cells").select("page_id", "y", "cls", F.posexplode("embedding").alias("x", "value")).withColumn("value", c("value").cast("double"))


_CELLS = ", cl AS (SELECT page_id, y, cls, unnest(range(len(embedding))) AS x, unnest(embedding)::DOUBLE AS value FROM v_cells)"
add("A11_class_stats", lambda s, d: D.class_stats(cells(s, d)).select("page_id", "cls", "pixels", F.round("percent", 9).alias("percent")),
    _CELLS + " SELECT page_id, cls, count(*) AS pixels, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY page_id), 9) AS percent FROM cl GROUP BY 1, 2", ("v_cells",))
add("A12_exterior_side_lengths", lambda s, d: D.exterior_side_lengths(cells(s, d).withColumns({"in_band": c("x") % 3 == 0, "in_footprint": c("value") > 0})), _CELLS + """
, b AS (SELECT page_id, sum(x) FILTER (WHERE value > 0)::DOUBLE / count(*) FILTER (WHERE value > 0) AS cx, sum(y) FILTER (WHERE value > 0)::DOUBLE / count(*) FILTER (WHERE value > 0) AS cy FROM cl GROUP BY 1),
k AS (SELECT cl.page_id, cls, x, y, x - cx AS dx, y - cy AS dy FROM cl JOIN b USING (page_id) WHERE x % 3 = 0), n AS (SELECT *, CASE WHEN abs(dy) >= abs(dx) THEN CASE WHEN dy < 0 THEN 'top' ELSE 'bottom' END ELSE CASE WHEN dx < 0 THEN 'left' ELSE 'right' END END AS side FROM k)
SELECT page_id, cls, side, count(DISTINCT CASE WHEN side IN ('top', 'bottom') THEN x ELSE y END) AS length_px FROM n GROUP BY 1, 2, 3""", ("v_cells",))


def _zonal(s, d):
    b = A.view(s, d, "v_segments").select((c("page_id") % 20).alias("page_id"), "seg_id", "orientation", (c("fixed") % 24).alias("fixed"), (c("axis_start") % 30).alias("axis_start"), (c("axis_start") % 30 + c("axis_end") - c("axis_start")).alias("axis_end"))
    return D.zonal_stats(cells(s, d), D.line_bands(b, 2)).select("band_id", F.round("mean", 7).alias("mean"), F.round("p90", 7).alias("p90"), F.round("max", 7).alias("max"), "n_cells")


add("A13_zonal_stats", _zonal, _CELLS + """
, g AS (SELECT page_id % 20 AS page_id, seg_id, orientation, fixed % 24 AS f, axis_start % 30 AS a, axis_start % 30 + axis_end - axis_start AS z FROM v_segments),
p AS (SELECT *, row_number() OVER () AS n, k.part, k.sh, k.r FROM g, (VALUES ('center', 0, 2), ('first', -5, 1), ('second', 5, 1)) AS k(part, sh, r)),
q AS (SELECT n, page_id, seg_id || ':' || part AS band_id, CASE WHEN orientation = 'horizontal' THEN a ELSE f + sh - r END AS x0, CASE WHEN orientation = 'horizontal' THEN z ELSE f + sh + r END AS x1, CASE WHEN orientation = 'horizontal' THEN f + sh - r ELSE a END AS y0, CASE WHEN orientation = 'horizontal' THEN f + sh + r ELSE z END AS y1 FROM p)
SELECT band_id, round(avg(value), 7) AS mean, round(quantile_cont(value, 0.9), 7) AS p90, round(max(value), 7) AS max, count(*) AS n_cells FROM q JOIN cl ON cl.page_id = q.page_id AND cl.x BETWEEN x0 AND x1 AND cl.y BETWEEN y0 AND y1 GROUP BY n, band_id""", ("v_cells", "v_segments"))
add("A14_building_roi", lambda s, d: D.building_roi(bordered(s, d), seg(s, d).filter("seg_id % 6 = 0"), seg(s, d).select("page_id").distinct().withColumns({"page_w": (c("page_id") * 30 + 400).cast("double"), "page_h": F.lit(700.0)})).select("page_id", "reason", F.round("left", 6).alias("l"), F.round("bottom", 6).alias("b"), F.round("confidence", 6).alias("confidence")), """
, k AS (SELECT page_id, count(*) AS n, min(CASE WHEN orientation = 'horizontal' THEN axis_start ELSE fixed END) AS x0, max(CASE WHEN orientation = 'horizontal' THEN axis_end ELSE fixed END) AS x1, min(CASE WHEN orientation = 'horizontal' THEN fixed ELSE axis_start END) AS y0, max(CASE WHEN orientation = 'horizontal' THEN fixed ELSE axis_end END) AS y1
 FROM v_segments WHERE fixed % 5 <> 0 AND brightness <= 0.25::DOUBLE AND seg_id % 6 <> 0 GROUP BY 1),
p AS (SELECT DISTINCT page_id, page_id * 30 + 400 AS pw, 700 AS ph FROM v_segments), z AS (SELECT p.*, k.* EXCLUDE (page_id), CASE WHEN coalesce(n, 0) < 4 THEN 'insufficient_dark_geometry' WHEN (x1 - x0) * (y1 - y0) / (pw * ph) NOT BETWEEN 0.05::DOUBLE AND 0.95::DOUBLE THEN 'implausible_roi_area' ELSE 'dark_native_geometry_bounds' END AS reason FROM p LEFT JOIN k USING (page_id))
SELECT page_id, reason, CASE WHEN reason[1] = 'd' THEN round(greatest(0, x0 - pw * 0.02::DOUBLE), 6) END AS l, CASE WHEN reason[1] = 'd' THEN round(least(ph, y1 + ph * 0.02::DOUBLE), 6) END AS b, CASE WHEN reason[1] = 'd' THEN round(least(0.99::DOUBLE, n / 12), 6) END AS confidence FROM z""", SEG)
add("A15_layer_counts", lambda s, d: D.layer_counts(seg(s, d)), """
SELECT page_id, count(*) FILTER (WHERE brightness <= 0.18::DOUBLE) AS black, count(*) FILTER (WHERE brightness BETWEEN 0.35::DOUBLE AND 0.75::DOUBLE) AS gray, count(*) FILTER (WHERE brightness <= 0.25::DOUBLE) AS dark,
 count(*) FILTER (WHERE brightness <= 0.18::DOUBLE) >= 8 AND count(*) FILTER (WHERE brightness BETWEEN 0.35::DOUBLE AND 0.75::DOUBLE) >= 3 AS nonstructural_enabled, count(*) FILTER (WHERE brightness <= 0.25::DOUBLE) >= 8 AS structural_enabled FROM v_segments GROUP BY 1""", SEG)


def _calib(s, d):
    v = A.view(s, d, "v_spans").filter("metres IS NOT NULL")
    return v.select((c("span_id") % 311).alias("page_id"), c("span_id").alias("cand_id"), c("direction").alias("orientation"), "metres", (c("metres") * 100 * (1 + (c("span_id") % 7) * 0.011)).alias("span_px"), (c("span_id") % 311 % 2 == 0).alias("is_ocr"))


def _calib_pages(s, d):
    return _calib(s, d).select("page_id").unionByName(_calib(s, d).select((c("page_id") + 300).alias("page_id"))).distinct()


add("A16_scale_calibration", lambda s, d: D.scale_calibration(_calib(s, d), _calib_pages(s, d)).select("page_id", "status", F.round("scale_m_per_px", 9).alias("scale"), "confidence"), """
, k AS (SELECT span_id % 311 AS page_id, span_id AS id, direction AS o, metres, metres * 100 * (1 + (span_id % 7) * 0.011::DOUBLE) AS px, span_id % 311 % 2 = 0 AS ocr FROM v_spans WHERE metres IS NOT NULL),
c0 AS (SELECT *, metres / px AS s, count(*) OVER (PARTITION BY page_id) AS n FROM k),
j AS (SELECT a.page_id, a.id AS seed, b.id, b.px, b.o FROM c0 a JOIN c0 b ON a.page_id = b.page_id AND abs(b.s - a.s) / ((b.s + a.s) / 2) <= 0.02::DOUBLE),
q AS (SELECT page_id, seed, count(*) AS n, sum(px) AS sp, count(DISTINCT o) AS ax FROM j GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY n DESC, sp DESC, seed) AS rn FROM q),
u AS (SELECT DISTINCT t.page_id, seed FROM t JOIN c0 USING (page_id) WHERE rn = 1 AND t.n >= 2 AND ax = 2 AND c0.n >= 3 AND ocr),
z AS (SELECT c0.* FROM c0 LEFT JOIN u USING (page_id) WHERE u.seed IS NULL OR EXISTS (SELECT 1 FROM j WHERE j.page_id = c0.page_id AND j.seed = u.seed AND j.id = c0.id)),
r AS (SELECT page_id, arg_max(s, metres * 1000000 - id) FILTER (WHERE o = 'horizontal') AS x, arg_max(s, metres * 1000000 - id) FILTER (WHERE o = 'vertical') AS y FROM z GROUP BY 1),
f AS (SELECT *, abs(x - y) / ((x + y) / 2) AS df FROM r), g AS (SELECT *, CASE WHEN df IS NULL THEN 'confirmation_required' WHEN df <= 0.02::DOUBLE + 1e-9 THEN 'confirmed' WHEN df <= 0.05::DOUBLE + 1e-9 THEN 'confirmation_required' ELSE 'conflict' END AS status FROM f)
SELECT page_id, status, CASE WHEN status <> 'conflict' THEN round(CASE WHEN df IS NULL THEN coalesce(x, y) ELSE (x + y) / 2 END, 9) END AS scale, CASE status WHEN 'confirmed' THEN 0.95 WHEN 'conflict' THEN 0 ELSE CASE WHEN df IS NULL THEN 0.5 ELSE 0.65 END END::DOUBLE AS confidence FROM g
UNION ALL SELECT DISTINCT page_id + 300, 'manual_required', NULL, 0::DOUBLE FROM c0 WHERE page_id + 300 NOT IN (SELECT page_id FROM c0)""", ("v_spans",))
add("A17_decision_counts", lambda s, d: D.decision_counts(D.line_candidate_decision(_cand(s, d), seg(s, d).filter("seg_id % 6 = 0")), "page_id", "decision", ["uncertain", "rejected_nonstructural"]), """
, r AS (SELECT page_id, seg_id % 6 = 0 OR fixed % 5 = 0 OR (seg_id % 11 > 0 AND 1 - (seg_id % 21) / 20 >= 0.8::DOUBLE) AS bad FROM v_segments) SELECT page_id, count(*) AS total, count(*) FILTER (WHERE NOT bad) AS uncertain, count(*) FILTER (WHERE bad) AS rejected_nonstructural FROM r GROUP BY 1""", SEG)


def _fuse_in(s, d):
    k = c("seg_id")
    return _cand(s, d).withColumns({"wall_mean": (k % 13) / 16.0, "wall_p90": (k % 17) / 16.0, "room_first": (k % 5) / 8.0, "room_second": (k % 3) / 8.0, "footprint_mean": (k % 9) / 8.0, "decision": F.when(k % 23 == 0, "rejected_nonstructural").otherwise("uncertain"), "reason_codes": F.array(F.lit("page_border"))})


add("C13_fuse_decision", lambda s, d: D.fuse_decision(_fuse_in(s, d)).select("seg_id", "decision", F.array_join("reason_codes", ";").alias("reasons")), """
, f AS (SELECT seg_id, (seg_id % 13) / 16 >= 0.35::DOUBLE OR (seg_id % 17) / 16 >= 0.55::DOUBLE AS w, greatest(seg_id % 5, seg_id % 3) / 8 >= 0.35::DOUBLE AS r, (seg_id % 9) / 8 >= 0.5::DOUBLE AS p, seg_id % 11 > 0 AND (seg_id % 21) / 20 >= 0.7::DOUBLE AS i, seg_id % 11 = 0 AS na, brightness <= 0.25::DOUBLE AS n FROM v_segments)
SELECT seg_id, CASE WHEN seg_id % 23 = 0 THEN 'rejected_nonstructural' WHEN w AND r AND p AND i AND n THEN 'accepted_wall_candidate' ELSE 'uncertain' END AS decision, CASE WHEN seg_id % 23 = 0 THEN 'page_border' ELSE concat_ws(';', CASE WHEN w THEN 'model_wall_supported' END, CASE WHEN r THEN 'room_side_supported' END, CASE WHEN p THEN 'footprint_supported' END,
 CASE WHEN i THEN 'inside_building_roi' END, CASE WHEN w AND r AND p AND i AND n THEN 'native_structural_style' END, CASE WHEN NOT n THEN 'weak_native_support' END, CASE WHEN NOT (w AND r AND p) THEN 'weak_model_support' END, CASE WHEN na THEN 'building_roi_unavailable' WHEN NOT i THEN 'weak_roi_support' END) END AS reasons FROM f""", SEG)
add("C14_exterior_wall_select", lambda s, d: D.exterior_wall_select(seg(s, d).withColumns({"first_mean": (c("seg_id") % 9) / 8.0, "second_mean": (c("seg_id") % 7) / 8.0, "boundary_mean": (c("seg_id") % 5) / 8.0})).select("seg_id", "inside_direction", "inside_mean"), """
, f AS (SELECT seg_id, orientation, (seg_id % 9) / 8 AS a, (seg_id % 7) / 8 AS b, (seg_id % 5) / 8 AS m FROM v_segments) SELECT seg_id, CASE WHEN orientation = 'horizontal' THEN CASE WHEN a >= b THEN 'up' ELSE 'down' END ELSE CASE WHEN a >= b THEN 'left' ELSE 'right' END END AS inside_direction, greatest(a, b) AS inside_mean
FROM f WHERE abs(a - b) >= 0.25::DOUBLE AND (greatest(a, b) >= 0.5::DOUBLE OR m >= 0.35::DOUBLE)""", SEG)
_op = {"door_line": 9, "door_start": 8, "door_end": 7, "window_line": 5, "window_start": 10, "window_end": 6}
add("C15_classify_openings", lambda s, d: D.classify_openings(seg(s, d).withColumns({**{k: (c("seg_id") % m) / 10.0 for k, m in _op.items()}, "has_arc": c("seg_id") % 3 == 0, "short_lines": c("seg_id") % 4})).select("seg_id", "kind", "confidence", "reason"), """
, f AS (SELECT seg_id, (seg_id % 9) / 10 AS dl, (seg_id % 8) / 10 AS ds, (seg_id % 7) / 10 AS de, (seg_id % 5) / 10 AS wl, (seg_id % 10) / 10 AS ws, (seg_id % 6) / 10 AS we FROM v_segments),
g AS (SELECT seg_id, least(dl, ds, de) AS dc, least(wl, ws, we) AS wc, dl >= 0.3::DOUBLE AND ds >= 0.35::DOUBLE AND de >= 0.35::DOUBLE AS d, wl >= 0.3::DOUBLE AND ws >= 0.35::DOUBLE AND we >= 0.35::DOUBLE AS w FROM f),
h AS (SELECT *, CASE WHEN d AND w AND abs(dc - wc) < 0.08::DOUBLE THEN 'a' WHEN d AND (NOT w OR dc >= wc) THEN 'd' WHEN w THEN 'w' WHEN seg_id % 3 = 0 THEN 'r' WHEN seg_id % 4 > 0 THEN 'p' ELSE 'u' END AS k FROM g)
SELECT seg_id, CASE k WHEN 'a' THEN 'ambiguous' WHEN 'd' THEN 'door' WHEN 'w' THEN 'window' WHEN 'r' THEN 'door' WHEN 'p' THEN 'pending_opening' ELSE 'unclassified' END AS kind, CASE k WHEN 'a' THEN greatest(dc, wc) WHEN 'd' THEN dc WHEN 'w' THEN wc WHEN 'r' THEN 0.7::DOUBLE ELSE 0 END AS confidence,
 CASE k WHEN 'a' THEN 'door_window_score_within_ambiguity_margin' WHEN 'd' THEN 'door_line_and_endpoints_supported' WHEN 'w' THEN 'window_line_and_endpoints_supported' WHEN 'r' THEN 'native_door_arc_supported' WHEN 'p' THEN 'native_short_line_supported' ELSE 'no_door_or_window_support' END AS reason FROM h""", SEG)
add("C16_bridge_decision", lambda s, d: D.bridge_decision(seg(s, d).select("seg_id", F.when(c("seg_id") % 7 == 0, "rejected_gap").otherwise("accepted_gap").alias("decision"), (c("seg_id") % 4 % 3).alias("n_openings"), (c("seg_id") % 5 % 3).alias("n_pending"), (c("axis_end") - c("axis_start")).cast("double").alias("width_px"),
    F.when(c("seg_id") % 2 == 0, F.lit(0.02)).alias("scale"), F.lit(2000.0).alias("image_w"), F.lit(1250.0).alias("image_h"))).select("seg_id", "bridge", "bridge_reason"), """
, f AS (SELECT seg_id, seg_id % 7 = 0 AS rej, seg_id % 4 % 3 AS o, seg_id % 5 % 3 AS p, CASE WHEN seg_id % 2 = 0 THEN (axis_end - axis_start) * 0.02::DOUBLE <= 0.6000000000000001::DOUBLE ELSE axis_end - axis_start <= 12 END AS sm FROM v_segments)
SELECT seg_id, CASE WHEN rej OR o > 1 THEN 'unresolved' WHEN o = 1 THEN 'opening_bridge' WHEN p = 1 THEN 'pending_opening_bridge' WHEN p > 1 THEN 'unresolved' WHEN sm THEN 'small_gap_repair' ELSE 'unresolved' END AS bridge,
 CASE WHEN rej THEN 'gap_rejected' WHEN o > 1 THEN 'multiple_matching_openings' WHEN o = 1 THEN 'accepted_opening_exact_gap_match' WHEN p = 1 THEN 'pending_opening_exact_gap_match' WHEN p > 1 THEN 'multiple_matching_pending_openings' WHEN sm THEN 'gap_within_repair_limit' ELSE 'gap_exceeds_repair_limit' END AS bridge_reason FROM f""", SEG)


def _edges(s, d):
    return seg(s, d).select("page_id", c("seg_id").alias("inference_id"), (c("seg_id") % 4000).alias("edge_group_id"), F.when(c("seg_id") % 9 == 0, 9).otherwise(1).alias("edge_group_size"), F.array(F.when(c("seg_id") % 31 == 0, "inferred_edge_outside_roi").otherwise("other")).alias("reason_codes"))


add("C22_relax_endpoint_groups", lambda s, d: D.relax_endpoint_groups(_edges(s, d)).select("page_id", "inference_id", "edge_group_size", "decision"), """
, g AS (SELECT page_id, seg_id % 4000 AS g, count(*) AS n FROM v_segments GROUP BY 1, 2 HAVING count(*) FILTER (WHERE seg_id % 31 = 0) = 0) SELECT s.page_id, s.seg_id AS inference_id, n AS edge_group_size, 'accepted_candidate' AS decision FROM v_segments s JOIN g ON g.page_id = s.page_id AND g.g = s.seg_id % 4000""", SEG)
add("U3_group_complete", lambda s, d: D.group_complete(_edges(s, d), _edges(s, d).filter("inference_id % 7 > 0")).select("page_id", "edge_group_id", "members", "complete"), """
SELECT page_id, seg_id % 4000 AS edge_group_id, count(*) AS members, (count(DISTINCT CASE WHEN seg_id % 9 = 0 THEN 9 ELSE 1 END) = 1 AND max(CASE WHEN seg_id % 9 = 0 THEN 9 ELSE 1 END) = count(*) AND count(*) FILTER (WHERE seg_id % 7 > 0) = count(*)) AS complete FROM v_segments GROUP BY 1, 2""", SEG)
add("W12_select_face", lambda s, d: D.select_face(A.view(s, d, "v_regions").select((c("region_id") % 97).alias("page_id"), c("region_id").alias("face_id"), (c("w") * c("h") + c("region_id") % 50 * 40).cast("double").alias("area"))), """
, f AS (SELECT region_id % 97 AS page_id, region_id, (w * h + region_id % 50 * 40)::DOUBLE AS area FROM v_regions), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY area DESC, region_id) AS n, lead(area) OVER (PARTITION BY page_id ORDER BY area DESC, region_id) AS nx FROM f)
SELECT page_id, region_id AS face_id, area, CASE WHEN nx >= area * 0.9::DOUBLE THEN 'ambiguous_exterior' ELSE 'selected' END AS status FROM r WHERE n = 1""", ("v_regions",))
add("W12_select_inferred_face", lambda s, d: D.select_inferred_face(A.view(s, d, "v_regions").select((c("region_id") % 97).alias("page_id"), c("region_id").alias("face_id"), (c("region_id") * 7 % 300).cast("double").alias("inferred_length"), (c("region_id") % 3).alias("n_edges"), F.lit(0.5).alias("mean_difference"), F.lit(0.5).alias("real_wall_ratio"), (c("w") * 8).cast("double").alias("perimeter"))), """
, r AS (SELECT region_id % 97 AS page_id, region_id, region_id * 7 % 300 AS l, w * 8 AS p, row_number() OVER (PARTITION BY region_id % 97 ORDER BY region_id * 7 % 300, region_id % 3, region_id) AS n, lead(region_id * 7 % 300) OVER (PARTITION BY region_id % 97 ORDER BY region_id * 7 % 300, region_id % 3, region_id) AS nx FROM v_regions)
SELECT page_id, region_id AS face_id, CASE WHEN nx <= l + greatest(8, p * 0.02::DOUBLE) THEN 'ambiguous_exterior' ELSE 'selected' END AS status FROM r WHERE n = 1""", ("v_regions",))
add("O5_ranked_gap_topk", lambda s, d: D.ranked_gap_topk(seg(s, d).select("page_id", (c("fixed") * 1000 + c("axis_start")).alias("line_key"), (c("axis_end") - c("axis_start")).cast("double").alias("length"), ((c("seg_id") % 11) / 10.0).alias("support")), 64.0, 12).select("page_id", "line_key", F.round("score", 9).alias("score"), "rank"), """
, g AS (SELECT page_id, fixed * 1000 + axis_start AS line_key, max(((seg_id % 11) / 10) * 2 + 1 - (axis_end - axis_start) / 64) AS score, min(axis_end - axis_start) AS l FROM v_segments GROUP BY 1, 2) SELECT page_id, line_key, round(score, 9) AS score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, l, line_key)::INT AS rank FROM g QUALIFY rank <= 12""", SEG)
