"""Drawing segments: filters, matches, gaps, openings, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thermograph.functions import text as X
from thermograph.operators.intervals import box_join, merge_collinear, range_join, running_sums
from thermograph.operators.relational import keep_first, spread_row_number
from thermograph.session import cut_lineage


# -- segment predicates and scalars --------------------------------------------

def axis_interval(x0: Column, y0: Column, x1: Column, y1: Column, orientation: Column) -> Column:
    """struct(fixed, axis_start, axis_end); null unless strictly axis-aligned."""
    h = (orientation == "horizontal") & (y0 == y1) & (x0 != x1)
    v = (orientation == "vertical") & (x0 == x1) & (y0 != y1)
    out = lambda f, a, b: F.struct(f.alias("fixed"), F.least(a, b).alias("axis_start"), F.greatest(a, b).alias("axis_end"))
    return F.when(h, out(y0, x0, x1)).when(v, out(x0, y0, y1))


def axis_segments(lines: DataFrame, tol: float = 0.5) -> DataFrame:
    """Axis-aligned lines within ``tol`` with canonical ends; diagonals flagged.

    Lines carry x0, top, x1, bottom; the fixed coordinate is the middle.
    """
    dx, dy = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("bottom") - F.col("top"))
    h, v = (dy <= tol) & (dx > tol), (dx <= tol) & (dy > tol)
    return lines.withColumns({
        "orientation": F.when(h, "horizontal").when(v, "vertical"),
        "fixed": F.when(h, (F.col("top") + F.col("bottom")) / 2).when(v, (F.col("x0") + F.col("x1")) / 2),
        "axis_start": F.when(h, F.least("x0", "x1")).when(v, F.least("top", "bottom")),
        "axis_end": F.when(h, F.greatest("x0", "x1")).when(v, F.greatest("top", "bottom")),
        "is_diagonal": (dx > tol) & (dy > tol),
    })


def page_border(orientation: Column, fixed: Column, length: Column, width: Column, height: Column, tol: float = 2.0) -> Column:
    """Near a page edge and at least 80 % of the page long."""
    across = F.when(orientation == "horizontal", height).otherwise(width)
    along = F.when(orientation == "horizontal", width).otherwise(height)
    return (F.least(F.abs(fixed), F.abs(across - fixed)) <= tol) & (length >= along * 0.8)


def neutral_brightness(r: Column, g: Column, b: Column) -> Column:
    return F.when(F.greatest(r, g, b) - F.least(r, g, b) <= 0.06, (r + g + b) / 3.0)


def point_to_pixel(v: Column, render: Column, page: Column) -> Column:
    """Page points to pixels, rounding halves to even."""
    return F.rint(v * render / page).cast("bigint")


def inside_roi_ratio(orientation: Column, fixed: Column, a: Column, b: Column, roi: dict[str, Column]) -> Column:
    """Share of a segment inside the region; zero when its axis lies outside."""
    h = orientation == "horizontal"
    lo, hi = F.when(h, roi["left"]).otherwise(roi["top"]), F.when(h, roi["right"]).otherwise(roi["bottom"])
    flo, fhi = F.when(h, roi["top"]).otherwise(roi["left"]), F.when(h, roi["bottom"]).otherwise(roi["right"])
    overlap = F.greatest(F.lit(0), F.least(b, hi) - F.greatest(a, lo))
    return F.when(fixed.between(flo, fhi), overlap / F.greatest(F.lit(1), b - a)).otherwise(0.0)


def dimension_side(orientation: Column, fixed: Column, width: Column, height: Column) -> Column:
    return (F.when((orientation == "horizontal") & (fixed < height / 2), "top").when(orientation == "horizontal", "bottom")
            .when(fixed < width / 2, "left").otherwise("right"))


def bbox_iou(a: tuple, b: tuple) -> Column:
    """IoU of two (x, y, w, h) boxes; zero for an empty union."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    ix = F.greatest(F.lit(0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    iy = F.greatest(F.lit(0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    inter = ix * iy
    union = aw * ah + bw * bh - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def remap_classes(c: Column) -> Column:
    """Fixed class id map 0,1,2,3 -> 0,1,3,2."""
    return F.when(c == 2, 3).when(c == 3, 2).otherwise(c)


def map_crop_bbox(df: DataFrame) -> DataFrame:
    """Preview crop (px0..py1) to page pixels: floor, ceil, clamp, positive."""
    sx, sy = F.col("page_w") / F.col("preview_w"), F.col("page_h") / F.col("preview_h")
    left = F.least(F.greatest(F.floor(F.col("px0") * sx), F.lit(0)), F.col("page_w") - 1)
    top = F.least(F.greatest(F.floor(F.col("py0") * sy), F.lit(0)), F.col("page_h") - 1)
    df = df.withColumns({"left": left, "top": top})
    return df.withColumns({
        "right": F.least(F.greatest(F.ceil(F.col("px1") * sx), F.col("left") + 1), F.col("page_w")),
        "bottom": F.least(F.greatest(F.ceil(F.col("py1") * sy), F.col("top") + 1), F.col("page_h"))})


def valid_crop_region(df: DataFrame) -> DataFrame:
    """Errors of a crop: inside the preview, 128 px a side, 1 % of the area."""
    w, h = F.col("px1") - F.col("px0"), F.col("py1") - F.col("py0")
    return df.withColumn("errors", F.filter(F.array(
        F.when((F.col("px0") < 0) | (F.col("py0") < 0) | (F.col("px1") > F.col("preview_w")) | (F.col("py1") > F.col("preview_h")), "outside_preview"),
        F.when((w < 128) | (h < 128), "side_too_short"), F.when(w * h < F.col("preview_w") * F.col("preview_h") * 0.01, "area_too_small")), lambda e: e.isNotNull()))


def clip_segments_to_crop(segments: DataFrame, crops: DataFrame) -> DataFrame:
    """Segments clipped to their page's crop, in crop coordinates."""
    j = segments.join(crops.select("page_id", "left", "top", "right", "bottom"), "page_id")
    h = F.col("orientation") == "horizontal"
    lo, hi = F.when(h, F.col("left")).otherwise(F.col("top")), F.when(h, F.col("right")).otherwise(F.col("bottom"))
    flo, fhi = F.when(h, F.col("top")).otherwise(F.col("left")), F.when(h, F.col("bottom")).otherwise(F.col("right"))
    j = j.filter(F.col("fixed").between(flo, fhi)).withColumns({
        "_a": F.greatest("axis_start", lo), "_z": F.least("axis_end", hi)}).filter("_a < _z")
    return j.withColumns({"fixed": F.col("fixed") - flo, "axis_start": F.col("_a") - lo, "axis_end": F.col("_z") - lo}).drop("_a", "_z", "left", "top", "right", "bottom")


def ocr_span_filter(spans: DataFrame) -> DataFrame:
    """Confident numeric spans, one per text and rounded box."""
    ok = spans.filter((F.col("confidence") >= 0.60) & F.col("text").rlike(r"^\d+(?:\.\d+)?(?:mm|m)?$"))
    return keep_first(ok, ["page_id", "text", F.round("x0"), F.round("y0"), F.round("x1"), F.round("y1")], ["span_id"])


def opening_short_segments(segments: DataFrame, dimension_members: DataFrame) -> DataFrame:
    return segments.filter(~F.col("is_border") & F.col("length").between(4.0, 80.0)).join(
        dimension_members.select("page_id", "seg_id").distinct(), ["page_id", "seg_id"], "left_anti")


def opening_curves(curves: DataFrame, tol: float = 0.5) -> DataFrame:
    """Open Bezier paths that are not flat and smaller than the page."""
    w, h = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    return curves.filter(F.array_contains("path_ops", "c") & ~F.array_contains("path_ops", "h") & (w > tol) & (h > tol)
                         & ~((w >= F.col("page_w") * 0.8) & (h >= F.col("page_h") * 0.8)))


def recoverable_wall(df: DataFrame) -> Column:
    return ((F.col("decision") == "uncertain") & F.col("native_id").isNotNull() & ~F.coalesce("is_border", F.lit(False))
            & (F.coalesce("roi_ratio", F.lit(0.0)) >= 0.95))


def polyline_length(points: Column) -> Column:
    """Sum of steps over an array of struct(x, y)."""
    steps = F.zip_with(F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))),
                       lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))
    return F.aggregate(steps, F.lit(0.0), lambda acc, s: acc + s)


def polygon_measures(points: Column) -> Column:
    """struct(area, perimeter): shoelace, and Manhattan steps for axis polygons."""
    nxt = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    cross = F.zip_with(points, nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    step = F.zip_with(points, nxt, lambda a, b: F.abs(b["x"] - a["x"]) + F.abs(b["y"] - a["y"]))
    add = lambda arr: F.aggregate(arr, F.lit(0.0), lambda acc, s: acc + s)
    return F.struct((F.abs(add(cross)) / 2).alias("area"), add(step).alias("perimeter"))


def simplify_polygon(points: Column) -> Column:
    """Drop vertices between two collinear axis neighbours."""
    n = F.size(points)
    before = F.concat(F.slice(points, -1, 1), F.slice(points, 1, n - 1))
    after = F.concat(F.slice(points, 2, n), F.slice(points, 1, 1))
    z = F.arrays_zip(before.alias("b"), points.alias("p"), after.alias("a"))
    keep = F.filter(z, lambda s: ~(((s["b"]["x"] == s["p"]["x"]) & (s["p"]["x"] == s["a"]["x"])) | ((s["b"]["y"] == s["p"]["y"]) & (s["p"]["y"] == s["a"]["y"]))))
    return F.transform(keep, lambda s: s["p"])


def canonical_polygon(points: Column) -> Column:
    """Lexicographically smallest rotation over both directions."""
    def rotations(p):
        start = F.array_position(p, F.array_min(p)).cast("int")
        return F.concat(F.slice(p, start, F.size(p)), F.slice(p, 1, start - 1))
    return F.least(rotations(points), rotations(F.reverse(points)))


# -- dimensions -----------------------------------------------------------------

def dimension_line_match(spans: DataFrame, segments: DataFrame, bucket: float = 64) -> DataFrame:
    """Nearest parallel line of each dimension text.

    ``spans``: page_id, span_id, direction, cx, cy, font_size, metres;
    ``segments``: page_id, seg_id, orientation, fixed, axis_start, axis_end,
    is_border. Ties prefer the longer line, then the smaller id.
    """
    h = F.col("direction") == "horizontal"
    s = spans.filter("metres IS NOT NULL").withColumns({
        "orientation": F.col("direction"), "along": F.when(h, F.col("cx")).otherwise(F.col("cy")), "across": F.when(h, F.col("cy")).otherwise(F.col("cx")),
        "reach": F.greatest(F.lit(24.0), F.col("font_size") * 3.0), "need": F.greatest(F.lit(12.0), F.col("font_size") * 2.0)})
    lines = segments.filter("NOT is_border").select("page_id", "orientation", "seg_id", "fixed", "axis_start", "axis_end")
    # bucket on the cross axis: reach is small while lines may be long
    j = range_join(s, lines, ["page_id", "orientation"], (F.col("across") - F.col("reach"), F.col("across") + F.col("reach")), (F.col("fixed"), F.col("fixed")), bucket)
    length, dist = F.col("axis_end") - F.col("axis_start"), F.abs(F.col("fixed") - F.col("across"))
    j = j.filter(F.col("along").between(F.col("axis_start") - 2.0, F.col("axis_end") + 2.0) & (length >= F.col("need")) & (dist <= F.col("reach")))
    best = j.groupBy("page_id", "span_id").agg(F.min(F.struct(dist.alias("distance"), (-length).alias("neg"), "seg_id", "orientation", "fixed", "axis_start", "axis_end", "metres")).alias("m"))
    return best.select("page_id", "span_id", "m.orientation", "m.seg_id", "m.fixed", "m.axis_start", "m.axis_end", "m.distance", "m.metres")


def endpoint_markers(matches: DataFrame, segments: DataFrame, id_col: str = "span_id", tol: float = 1.5, bucket: float = 64) -> DataFrame:
    """Shortest perpendicular line at each end; both ends are required."""
    ends = matches.select("page_id", id_col, F.when(F.col("orientation") == "horizontal", "vertical").otherwise("horizontal").alias("orientation"),
                          F.col("fixed").alias("main"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("axis_start").alias("at")), F.struct(F.lit(1).alias("side"), F.col("axis_end").alias("at")))).alias("e"))
    ends = ends.select("page_id", id_col, "orientation", "main", "e.side", "e.at")
    lines = segments.select("page_id", "orientation", "seg_id", "fixed", "axis_start", "axis_end")
    j = range_join(ends, lines, ["page_id", "orientation"], (F.col("at") - tol, F.col("at") + tol), (F.col("fixed"), F.col("fixed")), bucket)
    j = j.filter(F.col("main").between(F.col("axis_start") - tol, F.col("axis_end") + tol))
    best = j.groupBy("page_id", id_col, "side").agg(F.min(F.struct((F.col("axis_end") - F.col("axis_start")).alias("l"), "seg_id")).alias("m"))
    return best.groupBy("page_id", id_col).agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("side") == 0, F.col("m.seg_id"))).alias("start_marker"),
                                               F.max(F.when(F.col("side") == 1, F.col("m.seg_id"))).alias("end_marker")).filter("n = 2").drop("n")


def bridge_split_dimension(spans: DataFrame, segments: DataFrame, bucket: float = 64) -> DataFrame:
    """Two collinear fragments on both sides of a text box, as one line.

    Spans carry direction, box along the axis (t0, t1), across and font_size.
    """
    s = spans.withColumns({"orientation": F.col("direction"), "reach": F.greatest(F.lit(24.0), F.col("font_size") * 3.0)})
    part = lambda n: segments.select("page_id", "orientation", F.col("seg_id").alias(f"{n}_id"), F.col("fixed").alias(f"{n}_fixed"), F.col("axis_start").alias(f"{n}_a"), F.col("axis_end").alias(f"{n}_z"))
    # Tiles of both axes: a text meets the lines beside it, not all that end at its height.
    near = lambda frame, n, lo, hi: box_join(frame, part(n), ["page_id", "orientation"], (lo, hi), (F.col(f"{n}_z") if n == "f" else F.col(f"{n}_a"),) * 2,
                                             (F.col("across") - F.col("reach"), F.col("across") + F.col("reach")), (F.col(f"{n}_fixed"),) * 2, bucket).filter(
        F.abs(F.col(f"{n}_fixed") - F.col("across")) <= F.col("reach"))
    j = near(s, "f", F.col("t0") - 12.0, F.col("t0") + 3.0).filter("f_a < t0")
    j = near(j, "g", F.col("t1") - 3.0, F.col("t1") + 12.0).filter("g_z > t1 AND f_id <> g_id").filter(F.abs(F.col("f_fixed") - F.col("g_fixed")) <= 1.0)
    swap = F.col("g_a") < F.col("f_a")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    j = j.withColumns({"gap_start": pick("f_z", "g_z"), "gap_end": pick("g_a", "f_a"), "axis_start": pick("f_a", "g_a"), "axis_end": pick("g_z", "f_z"), "fixed": pick("f_fixed", "g_fixed")})
    gap = F.col("gap_end") - F.col("gap_start")
    return j.filter((gap >= 0) & (gap <= F.col("t1") - F.col("t0") + 12.0) & (F.col("gap_start") <= F.col("t0") + 3.0) & (F.col("gap_end") >= F.col("t1") - 3.0)).select(
        "page_id", "span_id", "orientation", "fixed", "axis_start", "axis_end", "f_id", "g_id")


def native_dimension_match(spans: DataFrame, segments: DataFrame, bucket: float = 64) -> DataFrame:
    """Baseline within 30 and centred, with short markers at two distinct ends."""
    s = spans.withColumns({"orientation": F.col("direction")})
    lines = segments.select("page_id", "orientation", "seg_id", "fixed", "axis_start", "axis_end")
    j = range_join(s, lines, ["page_id", "orientation"], (F.col("across") - 30.0, F.col("across") + 30.0), (F.col("fixed"), F.col("fixed")), bucket)
    length = F.col("axis_end") - F.col("axis_start")
    j = j.filter(F.abs((F.col("axis_start") + F.col("axis_end")) / 2 - F.col("along")) <= length * 0.65)
    base = j.select("page_id", "span_id", "seg_id", "orientation", "fixed", "axis_start", "axis_end", F.abs(F.col("fixed") - F.col("across")).alias("dist"), length.alias("len"))
    ends = base.select("page_id", "seg_id", "orientation", "fixed", "axis_start", "axis_end").distinct()
    ends = ends.select("page_id", F.col("seg_id").alias("base_id"), F.when(F.col("orientation") == "horizontal", "vertical").otherwise("horizontal").alias("orientation"), F.col("fixed").alias("main"),
                       F.explode(F.array("axis_start", "axis_end")).alias("at"))
    marks = segments.filter(F.col("axis_end") - F.col("axis_start") <= 40.0).select("page_id", "orientation", F.col("seg_id").alias("mark_id"), F.col("fixed").alias("mark_at"), F.col("axis_start").alias("ma"), F.col("axis_end").alias("mz"))
    m = range_join(ends, marks, ["page_id", "orientation"], (F.col("at") - 2.0, F.col("at") + 2.0), (F.col("mark_at"), F.col("mark_at")), bucket).filter(F.col("main").between(F.col("ma") - 1.0, F.col("mz") + 1.0))
    # two ends are distinct when some pair of marker positions is over 1 apart
    ok = m.groupBy("page_id", "base_id").agg(F.min(F.struct("mark_at", "mark_id")).alias("lo"), F.max(F.struct("mark_at", (-F.col("mark_id")).alias("neg"))).alias("hi")).filter("hi.mark_at - lo.mark_at > 1.0")
    c = base.join(ok.select("page_id", F.col("base_id").alias("seg_id"), F.col("lo.mark_id").alias("first_marker"), (-F.col("hi.neg")).alias("last_marker")), ["page_id", "seg_id"])
    best = c.groupBy("page_id", "span_id").agg(F.min(F.struct("dist", (-F.col("len")).alias("neg"), "seg_id", "first_marker", "last_marker")).alias("m"))
    return best.select("page_id", "span_id", "m.seg_id", "m.first_marker", "m.last_marker")


def scale_calibration(cands: DataFrame, pages: DataFrame | None = None, tile: float = 0.25) -> DataFrame:
    """Scale per page from dimension candidates.

    ``cands``: page_id, cand_id, orientation, metres, span_px, is_ocr. With
    three or more candidates and any from text recognition, the largest
    cluster within 2 % decides if it has two members and both axes. Of equal
    clusters that with the longer spans counts, then the smaller id.

    A cluster is a window of scales around its seed: its numbers are the
    differences of running sums at both ends, along tiles of the logarithm.
    Pages of ``pages`` without a usable candidate are ``manual_required``.
    """
    col = F.col
    c = cands.filter("metres > 0 AND span_px > 0").withColumn("s", col("metres") / col("span_px"))
    page = c.groupBy("page_id").agg((F.count(F.lit(1)) >= 3).alias("many"), F.max("is_ocr").alias("ocr"))
    ratio = 1.01 / 0.99  # |a - b| is 2 % of the mean of a and b
    axis = lambda o: (col("orientation") == o).cast("bigint")
    none = F.lit(0).cast("bigint")
    items = c.select("page_id", col("s").alias("at"), F.lit(1).alias("turn"), F.lit(1).cast("bigint").alias("n"), col("span_px").cast("double").alias("span"), axis("horizontal").alias("h"), axis("vertical").alias("v"), F.lit(None).cast(c.schema["cand_id"].dataType).alias("seed_id"), F.lit(0).alias("sign"))
    ask = lambda at, turn, sign: c.select("page_id", at.alias("at"), F.lit(turn).alias("turn"), none.alias("n"), F.lit(0.0).alias("span"), none.alias("h"), none.alias("v"), col("cand_id").alias("seed_id"), F.lit(sign).alias("sign"))
    rows = items.unionByName(ask(col("s") / ratio, 0, -1)).unionByName(ask(col("s") * ratio, 2, 1))
    sums = running_sums(rows, ["page_id"], ["at", "turn"], F.floor(F.log("at") / tile), ["n", "span", "h", "v"]).filter("sign <> 0")
    of = lambda x: F.sum(col(f"{x}_run") * col("sign"))
    cl = sums.groupBy("page_id", "seed_id").agg(of("n").alias("n"), of("span").alias("span"), (of("h") > 0).alias("_h"), (of("v") > 0).alias("_v"))
    # Spans of equal sets may differ in their last places by the order of addition.
    best = cl.groupBy("page_id").agg(F.max(F.struct("n", F.round("span", 6).alias("span"), (-col("seed_id")).alias("neg"), (col("_h") & col("_v")).alias("both"))).alias("b"))
    use = page.join(best, "page_id").filter("many AND ocr AND b.n >= 2 AND b.both").select("page_id", (-col("b.neg")).alias("seed_id"))
    seed = c.select("page_id", col("cand_id").alias("seed_id"), col("s").alias("seed_s")).join(use, ["page_id", "seed_id"])
    sel = c.join(seed, "page_id", "left").filter("seed_s IS NULL").unionByName(c.join(seed, "page_id").filter(F.abs(col("s") - col("seed_s")) / ((col("s") + col("seed_s")) / 2.0) <= 0.02), allowMissingColumns=True)
    longest = lambda o: F.max(F.when(col("orientation") == o, F.struct("metres", (-col("cand_id")).alias("neg"), "s")))["s"]
    out = sel.groupBy("page_id").agg(longest("horizontal").alias("scale_x"), longest("vertical").alias("scale_y"))
    if pages is not None:
        out = pages.select("page_id").join(out, "page_id", "left")
    out = out.withColumn("axis_difference", F.abs(col("scale_x") - col("scale_y")) / ((col("scale_x") + col("scale_y")) / 2.0))
    d, one = col("axis_difference"), F.coalesce("scale_x", "scale_y")
    status = (F.when(one.isNull(), "manual_required").when(d.isNull(), "confirmation_required").when(d <= 0.02 + 1e-9, "confirmed").when(d <= 0.05 + 1e-9, "confirmation_required").otherwise("conflict"))
    out = out.withColumn("status", status)
    confidence = F.when(col("status") == "confirmed", 0.95).when(col("status") == "confirmation_required", F.when(d.isNull(), 0.5).otherwise(0.65)).otherwise(0.0)
    return out.withColumns({"confidence": confidence, "scale_m_per_px": F.when(col("status") != "conflict", F.when(d.isNull(), one).otherwise((col("scale_x") + col("scale_y")) / 2.0))})


def building_roi(segments: DataFrame, dimension_members: DataFrame, pages: DataFrame) -> DataFrame:
    """Bounds of dark structural lines with a 2 % margin per page."""
    dark = segments.filter("NOT is_border AND brightness <= 0.25").join(dimension_members.select("page_id", "seg_id").distinct(), ["page_id", "seg_id"], "left_anti")
    h = F.col("orientation") == "horizontal"
    b = dark.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("dark_edges"), F.min(F.when(h, F.col("axis_start")).otherwise(F.col("fixed"))).alias("x0"), F.max(F.when(h, F.col("axis_end")).otherwise(F.col("fixed"))).alias("x1"),
        F.min(F.when(h, F.col("fixed")).otherwise(F.col("axis_start"))).alias("y0"), F.max(F.when(h, F.col("fixed")).otherwise(F.col("axis_end"))).alias("y1"))
    j = pages.join(b, "page_id", "left")
    frac = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / F.greatest(F.lit(1.0), F.col("page_w") * F.col("page_h"))
    j = j.withColumn("reason", F.when(F.coalesce("dark_edges", F.lit(0)) < 4, "insufficient_dark_geometry").when(~frac.between(0.05, 0.95), "implausible_roi_area").otherwise("dark_native_geometry_bounds"))
    on = F.col("reason") == "dark_native_geometry_bounds"
    return j.select("page_id", "reason", on.alias("enabled"), F.when(on, F.greatest(F.lit(0.0), F.col("x0") - F.col("page_w") * 0.02)).alias("left"), F.when(on, F.greatest(F.lit(0.0), F.col("y0") - F.col("page_h") * 0.02)).alias("top"),
                    F.when(on, F.least(F.col("page_w"), F.col("x1") + F.col("page_w") * 0.02)).alias("right"), F.when(on, F.least(F.col("page_h"), F.col("y1") + F.col("page_h") * 0.02)).alias("bottom"),
                    F.when(on, F.least(F.lit(0.99), F.col("dark_edges") / 12.0)).alias("confidence"))


def layer_counts(segments: DataFrame) -> DataFrame:
    b = F.col("brightness")
    c = segments.groupBy("page_id").agg(F.count_if(b <= 0.18).alias("black"), F.count_if(b.between(0.35, 0.75)).alias("gray"), F.count_if(b <= 0.25).alias("dark"))
    return c.withColumns({"nonstructural_enabled": (F.col("black") >= 8) & (F.col("gray") >= 3), "structural_enabled": F.col("dark") >= 8})


# -- crossings and gaps -----------------------------------------------------------

def intersections(segments: DataFrame, bucket: float = 64) -> DataFrame:
    """Every crossing of a horizontal with a vertical line, ends included."""
    h = segments.filter(F.col("orientation") == "horizontal").select("page_id", F.col("seg_id").alias("h_id"), F.col("fixed").alias("y"), F.col("axis_start").alias("hx0"), F.col("axis_end").alias("hx1"))
    v = segments.filter(F.col("orientation") == "vertical").select("page_id", F.col("seg_id").alias("v_id"), F.col("fixed").alias("x"), F.col("axis_start").alias("vy0"), F.col("axis_end").alias("vy1"))
    j = box_join(h, v, ["page_id"], (F.col("hx0"), F.col("hx1")), (F.col("x"), F.col("x")), (F.col("y"), F.col("y")), (F.col("vy0"), F.col("vy1")), bucket)
    return j.filter("y BETWEEN vy0 AND vy1").select("page_id", "h_id", "v_id", "x", "y")


def atomic_edges(segments: DataFrame, bucket: float = 64) -> DataFrame:
    """Segments cut at their crossings: (page_id, seg_id, orientation, fixed, a, b)."""
    x = intersections(segments, bucket)
    line = ["page_id", "seg_id", "orientation", "fixed"]
    cuts = (segments.select(*line, F.explode(F.array("axis_start", "axis_end")).alias("at"))
            .unionByName(x.select("page_id", F.col("h_id").alias("seg_id"), F.lit("horizontal").alias("orientation"), F.col("y").alias("fixed"), F.col("x").alias("at")))
            .unionByName(x.select("page_id", F.col("v_id").alias("seg_id"), F.lit("vertical").alias("orientation"), F.col("x").alias("fixed"), F.col("y").alias("at"))).distinct())
    w = W.partitionBy(*line).orderBy("at")
    return cuts.withColumn("b", F.lead("at").over(w)).filter("b IS NOT NULL").withColumnRenamed("at", "a")


def perpendicular_crossing_anti(gaps: DataFrame, walls: DataFrame, tol: float = 2, bucket: float = 64) -> DataFrame:
    """Gaps that no perpendicular wall crosses strictly inside."""
    return gaps.join(crossed_gaps(gaps, walls, tol, bucket), ["page_id", "gap_key"], "left_anti")


def crossed_gaps(gaps: DataFrame, walls: DataFrame, tol: float = 2, bucket: float = 64) -> DataFrame:
    """page_id, gap_key of gaps that a perpendicular wall crosses strictly inside.

    Tiles of both axes: a gap meets the walls that pass near it, not all of its page.
    """
    g = gaps.select("page_id", F.when(F.col("orientation") == "horizontal", "vertical").otherwise("horizontal").alias("_o"), "gap_key", "fixed", "gap_start", "gap_end")
    w = walls.select("page_id", F.col("orientation").alias("_o"), F.col("fixed").alias("w_at"), F.col("axis_start").alias("wa"), F.col("axis_end").alias("wz"))
    hit = box_join(g, w, ["page_id", "_o"], (F.col("gap_start"), F.col("gap_end")), (F.col("w_at"), F.col("w_at")), (F.col("fixed"), F.col("fixed")), (F.col("wa") - tol, F.col("wz") + tol), bucket)
    hit = hit.filter((F.col("w_at") > F.col("gap_start")) & (F.col("w_at") < F.col("gap_end")) & F.col("fixed").between(F.col("wa") - tol, F.col("wz") + tol))
    return hit.select("page_id", "gap_key").distinct()


def next_start(asks: DataFrame, starts: DataFrame, line: list[str], tile: float = 64) -> DataFrame:
    """Each ask with the first start after its ``at`` on its line, as ``next`` (at, n, m); asks without one go.

    Rows look ahead inside tiles of the line, and one row per tile carries the
    first start of later tiles, so no task holds a whole line.
    """
    c = F.col
    q = asks.withColumn("_ask", F.struct(*[x for x in asks.columns if x not in line and x != "at"])).select(*line, "at", "_ask", F.lit(None).cast(starts.select(F.struct("at", "n", "m").alias("s")).schema["s"].dataType).alias("_s"))
    rows = q.unionByName(starts.select(*line, "at", F.lit(None).cast(q.schema["_ask"].dataType).alias("_ask"), F.struct("at", "n", "m").alias("_s"))).withColumn("_t", F.floor(c("at") / tile)).filter("_t IS NOT NULL")
    # Backwards, as a frame that only loses rows is evaluated anew for each of them.
    later = W.partitionBy(*line).orderBy(F.desc("_t")).rowsBetween(W.unboundedPreceding, -1)
    tiles = starts.groupBy(*line, F.floor(c("at") / tile).alias("_t")).agg(F.min(F.struct("at", "n", "m")).alias("_m"))
    have = rows.select(*line, "_t").distinct().join(tiles, [*line, "_t"], "left")
    carry = have.select(*line, "_t", F.min("_m").over(later).alias("_carry"))
    ahead = W.partitionBy(*line, "_t").orderBy(F.desc("at"), c("_s").isNull().desc()).rowsBetween(W.unboundedPreceding, -1)
    out = rows.withColumn("_next", F.min("_s").over(ahead)).filter("_ask IS NOT NULL").join(carry, [*line, "_t"])
    return out.select(*line, "at", "_ask.*", F.coalesce("_next", "_carry").alias("next")).filter("next IS NOT NULL")


def exterior_gaps(walls: DataFrame, roi: DataFrame, tol: float = 2, bucket: float = 64) -> DataFrame:
    """Gap from each merged wall to the nearest following one on its line.

    ``walls``: page_id, wall_id, orientation, inside_direction, fixed,
    axis_start, axis_end, already merged. Several equally near walls reject
    the gap; so do unequal axes or directions, a crossing wall, or an end
    outside the page region.
    """
    # Each of these is read several times below.
    walls = cut_lineage(walls)
    # Walls look along each axis value near their own; a value holds one row per start. Asks and starts are numbers
    # only, as each wall asks several times: ids and directions are looked up once the nearest start is known.
    line = ["page_id", "orientation", "r_fixed"]
    own = ["page_id", "orientation", "fixed", "axis_end"]
    values = walls.select("page_id", "orientation", "fixed").distinct()
    near = range_join(values, values.withColumnRenamed("fixed", "r_fixed"), ["page_id", "orientation"], (F.col("fixed") - tol, F.col("fixed") + tol), (F.col("r_fixed"), F.col("r_fixed")), max(4 * tol, 1))
    starts = walls.groupBy("page_id", "orientation", F.col("fixed").alias("r_fixed"), F.col("axis_start").alias("at")).agg(F.count(F.lit(1)).cast("int").alias("n")).withColumn("m", F.lit(None).cast("boolean"))
    asks = walls.select(*own).distinct().join(near, own[:3])
    first = next_start(asks.withColumn("at", F.col("axis_end")).drop("axis_end"), starts, line, bucket)
    found = first.select("page_id", "orientation", "fixed", F.col("at").alias("axis_end"), F.struct(F.col("next.at").alias("r_start"), "r_fixed", F.col("next.n").alias("n")).alias("r"))
    # The nearest start on any axis; several axes may share it, each with its count.
    best = found.groupBy(*own).agg(F.min("r.r_start").alias("r_start"), F.collect_list("r").alias("_r")).withColumn("_r", F.filter("_r", lambda x: x["r_start"] == F.col("r_start")))
    best = best.select(*own, "r_start", F.aggregate("_r", F.lit(0).cast("bigint"), lambda a, x: a + x["n"]).alias("n"), F.explode(F.transform("_r", lambda x: x["r_fixed"])).alias("r_fixed"))
    # The asks are by far the most rows; their shuffles are given back before ids are looked up.
    best = cut_lineage(best)
    right = walls.select("page_id", "orientation", F.col("fixed").alias("r_fixed"), F.col("axis_start").alias("r_start"), F.struct(F.col("wall_id").alias("r_id"), F.col("fixed").alias("r_fixed"), F.col("inside_direction").alias("r_dir")).alias("m"))
    best = best.join(right, [*line, "r_start"]).groupBy(*own).agg(F.first("r_start").alias("r_start"), F.first("n").alias("n"), F.min("m").alias("m"))
    best = cut_lineage(walls.select(*own, "wall_id", "inside_direction").join(best, own))
    g = best.select("page_id", "orientation", "wall_id", "fixed", "inside_direction", F.col("axis_end").alias("gap_start"), F.col("r_start").alias("gap_end"), "n",
                    F.col("m.r_id").alias("r_id"), F.col("m.r_fixed").alias("r_fixed"), F.col("m.r_dir").alias("r_dir"), F.col("wall_id").alias("gap_key"))
    g = g.join(crossed_gaps(g, walls, tol, bucket).withColumn("_crossed", F.lit(True)), ["page_id", "gap_key"], "left").join(roi.select("page_id", "left", "top", "right", "bottom"), "page_id", "left")
    h = F.col("orientation") == "horizontal"
    lo, hi = F.when(h, F.col("left")).otherwise(F.col("top")), F.when(h, F.col("right")).otherwise(F.col("bottom"))
    flo, fhi = F.when(h, F.col("top")).otherwise(F.col("left")), F.when(h, F.col("bottom")).otherwise(F.col("right"))
    outside = (F.col("gap_start") < lo) | (F.col("gap_end") > hi) | ~F.col("fixed").between(flo, fhi) | ~F.col("r_fixed").between(flo, fhi)
    single = F.filter(F.array(
        F.when(F.col("fixed") != F.col("r_fixed"), "not_strictly_collinear"), F.when(F.col("inside_direction") != F.col("r_dir"), "different_inside_directions"),
        F.when(F.col("_crossed"), "perpendicular_structural_crossing"), F.when(F.coalesce(outside, F.lit(False)), "outside_building_roi")), lambda e: e.isNotNull())
    g = g.withColumn("_r", F.when(F.col("n") > 1, F.array(F.lit("multiple_competing_endpoints"))).otherwise(single))
    return g.select("page_id", "orientation", "wall_id", "r_id", "fixed", "r_fixed", "gap_start", "gap_end", F.when(F.size("_r") == 0, "accepted_gap").otherwise("rejected_gap").alias("decision"),
                    F.when(F.size("_r") == 0, F.array(F.lit("unambiguous_collinear_exterior_gap"))).otherwise(F.col("_r")).alias("reason_codes"),
                    F.when(F.col("inside_direction") == F.col("r_dir"), F.col("inside_direction")).alias("inside_direction"))


def gap_opening_match(gaps: DataFrame, openings: DataFrame) -> DataFrame:
    """Openings with exactly a gap's ends and host walls; branch by count."""
    keys = ["page_id", "orientation", "fixed", "gap_start", "gap_end"]
    g = gaps.withColumn("_h", F.array_join(F.array_sort("host_ids"), ","))
    o = openings.withColumn("_h", F.array_join(F.array_sort("host_ids"), ",")).groupBy(*keys, "_h").agg(F.count(F.lit(1)).alias("n_openings"), F.min("opening_id").alias("opening_id"))
    return g.join(o, [*keys, "_h"], "left").drop("_h").withColumns({
        "n_openings": F.coalesce("n_openings", F.lit(0)), "match": F.when(F.col("n_openings") > 1, "multiple").when(F.col("n_openings") == 1, "one").otherwise("none")}).withColumn(
        "opening_id", F.when(F.col("n_openings") == 1, F.col("opening_id")))


def gap_curve_join(gaps: DataFrame, curves: DataFrame, tol: float = 12, bucket: float = 128) -> DataFrame:
    """Arc ids per gap: box covers the gap within ``tol``, a path end touches."""
    h = F.col("orientation") == "horizontal"
    g = gaps.select("page_id", "gap_key", F.when(h, F.col("gap_start")).otherwise(F.col("fixed")).alias("gx0"), F.when(h, F.col("gap_end")).otherwise(F.col("fixed")).alias("gx1"),
                    F.when(h, F.col("fixed")).otherwise(F.col("gap_start")).alias("gy0"), F.when(h, F.col("fixed")).otherwise(F.col("gap_end")).alias("gy1"))
    k = curves.select("page_id", "curve_id", "x0", "y0", "x1", "y1", "sx", "sy", "ex", "ey")
    j = box_join(g, k, ["page_id"], (F.col("gx0"), F.col("gx1")), (F.col("x0") - tol, F.col("x1") + tol), (F.col("gy0"), F.col("gy1")), (F.col("y0") - tol, F.col("y1") + tol), bucket)
    cover = (F.col("gx0") >= F.col("x0") - tol) & (F.col("gx1") <= F.col("x1") + tol) & (F.col("gy0") >= F.col("y0") - tol) & (F.col("gy1") <= F.col("y1") + tol)
    d = lambda px, py, gx, gy: F.hypot(F.col(px) - F.col(gx), F.col(py) - F.col(gy))
    touch = F.least(d("sx", "sy", "gx0", "gy0"), d("sx", "sy", "gx1", "gy1"), d("ex", "ey", "gx0", "gy0"), d("ex", "ey", "gx1", "gy1")) <= tol
    return j.filter(cover & touch).groupBy("page_id", "gap_key").agg(F.sort_array(F.collect_set("curve_id")).alias("curve_ids"))


def gap_short_segment_join(gaps: DataFrame, shorts: DataFrame, tol: float = 12, bucket: float = 64) -> DataFrame:
    """Number of short lines on a gap's axis that overlap it within ``tol``."""
    g = gaps.select("page_id", "orientation", "gap_key", F.col("fixed").alias("g_at"), "gap_start", "gap_end")
    j = box_join(g, shorts.select("page_id", "orientation", "seg_id", "fixed", "axis_start", "axis_end"), ["page_id", "orientation"],
                 (F.col("gap_start") - tol, F.col("gap_end") + tol), (F.col("axis_start"), F.col("axis_end")), (F.col("g_at") - tol, F.col("g_at") + tol), (F.col("fixed"), F.col("fixed")), bucket)
    return j.filter(F.abs(F.col("fixed") - F.col("g_at")) <= tol).groupBy("page_id", "gap_key").agg(F.count(F.lit(1)).alias("short_lines"))


def anchor_both_ends_semi(cands: DataFrame, anchors: DataFrame, tol: float = 36, band: float = 8, min_length: float = 40, bucket: float = 128) -> DataFrame:
    """Candidates whose two ends touch anchors, two or more distinct ones.

    The candidate must lie within ``band`` of a parallel anchor's axis, unless
    the page has no parallel anchor at all.
    """
    c = cands.filter(F.col("axis_end") - F.col("axis_start") >= min_length)
    h = F.col("orientation") == "horizontal"
    a = anchors.select("page_id", F.col("seg_id").alias("a_id"), F.when(h, F.col("axis_start")).otherwise(F.col("fixed")).alias("ax0"), F.when(h, F.col("axis_end")).otherwise(F.col("fixed")).alias("ax1"),
                       F.when(h, F.col("fixed")).otherwise(F.col("axis_start")).alias("ay0"), F.when(h, F.col("fixed")).otherwise(F.col("axis_end")).alias("ay1"))
    ends = c.select("page_id", "seg_id", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.when(h, F.col("axis_start")).otherwise(F.col("fixed")).alias("px"), F.when(h, F.col("fixed")).otherwise(F.col("axis_start")).alias("py")),
        F.struct(F.lit(1).alias("side"), F.when(h, F.col("axis_end")).otherwise(F.col("fixed")).alias("px"), F.when(h, F.col("fixed")).otherwise(F.col("axis_end")).alias("py")))).alias("e")).select("page_id", "seg_id", "e.*")
    t = box_join(ends, a, ["page_id"], (F.col("px"), F.col("px")), (F.col("ax0") - tol, F.col("ax1") + tol), (F.col("py"), F.col("py")), (F.col("ay0") - tol, F.col("ay1") + tol), bucket).filter(
        F.col("py").between(F.col("ay0") - tol, F.col("ay1") + tol))
    ok = t.groupBy("page_id", "seg_id").agg(F.countDistinct("side").alias("sides"), F.countDistinct("a_id").alias("touching")).filter("sides = 2 AND touching >= 2")
    parallel = anchors.select("page_id", "orientation", F.col("fixed").alias("p_at")).distinct()
    close = range_join(c.select("page_id", "orientation", "seg_id", "fixed"), parallel, ["page_id", "orientation"], (F.col("fixed") - band, F.col("fixed") + band), (F.col("p_at"), F.col("p_at")), max(4 * band, 1)).select("page_id", "seg_id").distinct()
    free = c.join(parallel.select("page_id", "orientation").distinct(), ["page_id", "orientation"], "left_anti").select("page_id", "seg_id")
    return c.join(ok.select("page_id", "seg_id", "touching"), ["page_id", "seg_id"]).join(close.unionByName(free), ["page_id", "seg_id"], "left_semi")


def nearest_band_join(walls: DataFrame, bands: DataFrame, tol: float = 16) -> DataFrame:
    """Nearest same-orientation band within ``tol``; ties by band id."""
    b = bands.select("page_id", "orientation", "band_id", F.col("fixed").alias("b_at"))
    j = range_join(walls, b, ["page_id", "orientation"], (F.col("fixed") - tol, F.col("fixed") + tol), (F.col("b_at"), F.col("b_at")), 4 * tol)
    best = j.groupBy("page_id", "seg_id").agg(F.min(F.struct(F.abs(F.col("fixed") - F.col("b_at")).alias("distance"), "band_id", "b_at")).alias("m"))
    return best.select("page_id", "seg_id", "m.band_id", "m.distance", F.col("m.b_at").alias("band_fixed"))


def region_matches(before: DataFrame, after: DataFrame, bucket: float = 64, check_area: bool = True) -> DataFrame:
    """Pairs of regions that are the same: IoU 0.8 and, for rooms, near areas."""
    c = F.col
    shape = ["page_id", "x", "y", "w", "h"]
    one = lambda df, n: df.select(*shape).distinct().select("page_id", *[c(k).alias(f"{n}{k}") for k in "xywh"])
    j = box_join(one(after, "a"), one(before, "b"), ["page_id"], (c("ax"), c("ax") + c("aw")), (c("bx"), c("bx") + c("bw")), (c("ay"), c("ay") + c("ah")), (c("by"), c("by") + c("bh")), bucket)
    old = (c("bw") * c("bh")).cast("double")
    same = bbox_iou((c("ax"), c("ay"), c("aw"), c("ah")), (c("bx"), c("by"), c("bw"), c("bh"))) >= 0.8
    if check_area:
        same = same & (F.abs(c("aw") * c("ah") - old) <= F.greatest(F.lit(12.0), old * 0.05))
    # Equal boxes are compared once and take their partners together.
    members = lambda df, n, name: df.select(c("region_id").alias(name), "page_id", *[c(k).alias(f"{n}{k}") for k in "xywh"])
    new = j.filter(same).join(members(after, "a", "new_id"), ["page_id", "ax", "ay", "aw", "ah"])
    return new.join(members(before, "b", "old_id"), ["page_id", "bx", "by", "bw", "bh"]).select("page_id", "new_id", "old_id")


def rooms_stable(before: DataFrame, after: DataFrame, tolerance: float = 0.03) -> DataFrame:
    """Whether the rooms of each page kept their sizes: page_id, stable.

    Rooms (page_id, area) compare by rank of area: as many as before, each
    within 12 px² or ``tolerance`` of the old one. Pages that only one side has
    are unstable.
    """
    ranked = lambda df, name: df.select("page_id", F.col("area").cast("double").alias(name), F.row_number().over(W.partitionBy("page_id").orderBy("area")).alias("rank"))
    j = ranked(before, "old").join(ranked(after, "new"), ["page_id", "rank"], "full_outer")
    near = F.coalesce(F.abs(F.col("old") - F.col("new")) <= F.greatest(F.lit(12.0), F.col("old") * tolerance), F.lit(False))
    return j.groupBy("page_id").agg(F.min(near).alias("stable"))


# -- evidence and decisions --------------------------------------------------------

def zonal_stats(cells: DataFrame, bands: DataFrame, tile: int = 256) -> DataFrame:
    """Mean, 90th percentile and maximum of cell values in axis rectangles, one row per band that holds a cell.

    ``cells``: page_id, x, y, value; ``bands``: page_id, band_id, bx0, by0,
    bx1, by1 (inclusive). Bands of equal short side share a strip: the cells of
    its lines, kept as arrays by position along it. A band then takes a slice of
    its strip, so cells are never joined to bands one by one. Equal rectangles
    are measured once and every band then takes the figures of its rectangle.
    """
    c = F.col
    wide = c("bx1") - c("bx0") >= c("by1") - c("by0")
    side = lambda x, y: F.when(wide, c(x)).otherwise(c(y))
    whole = lambda v, f: f(v).cast("bigint")
    b = bands.select("page_id", "band_id", F.when(wide, "h").otherwise("v").alias("_axis"), whole(side("by0", "bx0"), F.ceil).alias("_lo"), whole(side("by1", "bx1"), F.floor).alias("_hi"),
                     whole(side("bx0", "by0"), F.ceil).alias("_a"), whole(side("bx1", "by1"), F.floor).alias("_z")).filter("_lo <= _hi AND _a <= _z")
    strip = ["page_id", "_axis", "_lo", "_hi"]
    lines = b.select(*strip).distinct().withColumn("_across", F.explode(F.sequence("_lo", "_hi")))
    at = lambda axis, across, along: cells.select("page_id", F.lit(axis).alias("_axis"), c(across).cast("bigint").alias("_across"), c(along).cast("bigint").alias("_p"), "value")
    held = lines.join(at("h", "y", "x").unionByName(at("v", "x", "y")).filter("value IS NOT NULL"), ["page_id", "_axis", "_across"]).groupBy(*strip, "_p").agg(F.collect_list("value").alias("_v"))
    runs = held.groupBy(*strip, F.floor(c("_p") / tile).alias("_t")).agg(F.sort_array(F.collect_list(F.struct("_p", "_v"))).alias("_m"))
    first, last = c("_m")[0]["_p"], F.element_at("_m", -1)["_p"]
    # Positions without a cell are rare; only strips that have one are filled up.
    filled = F.transform(F.sequence(first, last), lambda p: F.coalesce(F.try_element_at(F.map_from_entries("_m"), p), F.array().cast("array<double>")))
    runs = runs.select(*strip, "_t", first.alias("_first"), last.alias("_last"), F.when(last - first + 1 == F.size("_m"), F.transform("_m", lambda x: x["_v"])).otherwise(filled).alias("_runs"))

    def values(df: DataFrame) -> DataFrame:
        j = df.withColumn("_t", F.explode(F.sequence(F.floor(c("_a") / tile), F.floor(c("_z") / tile)))).join(runs, [*strip, "_t"])
        lo, hi = F.greatest("_a", "_first"), F.least("_z", "_last")
        return j.filter(lo <= hi).withColumn("_v", F.flatten(F.slice("_runs", (lo - c("_first") + 1).cast("int"), (hi - lo + 1).cast("int"))))

    shape = [*strip, "_a", "_z"]
    shapes = b.select(*shape).distinct()
    near = F.floor(c("_a") / tile) == F.floor(c("_z") / tile)
    one = values(shapes.filter(near)).select(*shape, "_v")
    # Longer bands meet several arrays.
    many = values(shapes.filter(~near)).groupBy(*shape).agg(F.flatten(F.collect_list("_v")).alias("_v"))
    out = one.unionByName(many).select(*shape, F.sort_array("_v").alias("_v")).filter("size(_v) > 0")
    place = (F.size("_v") - 1) * 0.9
    low = F.floor(place).cast("int")
    value = lambda i: F.get("_v", i)
    p90 = value(low) + (place - low) * (F.coalesce(value(low + 1), value(low)) - value(low))
    stats = out.select(*shape, (F.aggregate("_v", F.lit(0.0), lambda x, v: x + v) / F.size("_v")).alias("mean"), p90.alias("p90"), F.element_at("_v", -1).alias("max"), F.size("_v").cast("bigint").alias("n_cells"))
    return b.join(stats, shape).select("page_id", "band_id", "mean", "p90", "max", "n_cells")


def line_bands(segments: DataFrame, radius: int) -> DataFrame:
    """Centre and side rectangles around each line, for ``zonal_stats``."""
    half, off, side = radius, radius * 2 + 1, radius // 2
    h = F.col("orientation") == "horizontal"

    def rect(name, shift, r):
        lo, hi = F.col("fixed") + shift - r, F.col("fixed") + shift + r
        return F.struct(F.lit(name).alias("part"), F.when(h, F.col("axis_start")).otherwise(lo).alias("bx0"), F.when(h, F.col("axis_end")).otherwise(hi).alias("bx1"),
                        F.when(h, lo).otherwise(F.col("axis_start")).alias("by0"), F.when(h, hi).otherwise(F.col("axis_end")).alias("by1"))
    parts = F.array(rect("center", 0, half), rect("first", -off, side), rect("second", off, side))
    return segments.select("page_id", "seg_id", F.explode(parts).alias("r")).select("page_id", F.concat_ws(":", "seg_id", "r.part").alias("band_id"), "seg_id", "r.*")


def line_candidate_decision(segments: DataFrame, dimension_members: DataFrame) -> DataFrame:
    d = dimension_members.select("page_id", "seg_id", F.lit(True).alias("_d")).distinct()
    j = segments.join(d, ["page_id", "seg_id"], "left")
    reasons = F.filter(F.array(F.when(F.col("_d"), "dimension_overlap"), F.when(F.col("is_border"), "page_border"), F.when(1.0 - F.col("roi_ratio") >= 0.80, "outside_building_roi")), lambda e: e.isNotNull())
    j = j.withColumn("_r", reasons)
    return j.withColumns({"decision": F.when(F.size("_r") > 0, "rejected_nonstructural").otherwise("uncertain"),
                          "reason_codes": F.when(F.size("_r") > 0, F.col("_r")).otherwise(F.array(F.lit("model_evidence_pending")))}).drop("_d", "_r")


def fuse_decision(df: DataFrame) -> DataFrame:
    """Accept only with native, region, wall, room and footprint support."""
    wall = (F.col("wall_mean") >= 0.35) | (F.col("wall_p90") >= 0.55)
    room = F.greatest("room_first", "room_second") >= 0.35
    foot = F.col("footprint_mean") >= 0.50
    roi = F.coalesce(F.col("roi_ratio") >= 0.70, F.lit(False))
    native = F.coalesce(F.col("brightness") <= 0.25, F.lit(False))
    accepted = wall & room & foot & roi & native
    reasons = F.filter(F.array(
        F.when(wall, "model_wall_supported"), F.when(room, "room_side_supported"), F.when(foot, "footprint_supported"), F.when(roi, "inside_building_roi"),
        F.when(accepted, "native_structural_style"), F.when(~accepted & ~native, "weak_native_support"), F.when(~accepted & ~(wall & room & foot), "weak_model_support"),
        F.when(~accepted & F.col("roi_ratio").isNull(), "building_roi_unavailable").when(~accepted & ~roi, "weak_roi_support")), lambda e: e.isNotNull())
    rejected = F.col("decision") == "rejected_nonstructural"
    return df.withColumns({"reason_codes": F.when(rejected, F.col("reason_codes")).otherwise(reasons),
                           "decision": F.when(rejected, F.col("decision")).when(accepted, "accepted_wall_candidate").otherwise("uncertain")})


def exterior_wall_select(df: DataFrame) -> DataFrame:
    """Inside side = larger footprint mean; keep walls with a clear difference."""
    first_in = F.col("first_mean") >= F.col("second_mean")
    h = F.col("orientation") == "horizontal"
    df = df.withColumns({"inside_mean": F.greatest("first_mean", "second_mean"), "outside_mean": F.least("first_mean", "second_mean"),
                         "inside_direction": F.when(h & first_in, "up").when(h, "down").when(first_in, "left").otherwise("right")})
    return df.filter((F.col("inside_mean") - F.col("outside_mean") >= 0.25) & ((F.col("inside_mean") >= 0.50) | (F.col("boundary_mean") >= 0.35)))


def classify_openings(df: DataFrame) -> DataFrame:
    """Door, window, ambiguous, pending or unclassified per accepted gap."""
    conf = lambda k: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.least(f"{k}_line", f"{k}_start", f"{k}_end")))
    sup = lambda k: (F.col(f"{k}_line") >= 0.30) & (F.col(f"{k}_start") >= 0.35) & (F.col(f"{k}_end") >= 0.35)
    df = df.withColumns({"_dc": conf("door"), "_wc": conf("window"), "_ds": sup("door"), "_ws": sup("window")})
    both = F.col("_ds") & F.col("_ws")
    kind = (F.when(both & (F.abs(F.col("_dc") - F.col("_wc")) < 0.08), "ambiguous")
            .when(F.col("_ds") & (~F.col("_ws") | (F.col("_dc") >= F.col("_wc"))), "door").when(F.col("_ws"), "window")
            .when(F.col("has_arc"), "door").when(F.col("short_lines") > 0, "pending_opening").otherwise("unclassified"))
    df = df.withColumn("kind", kind)
    return df.withColumns({
        "confidence": F.when(F.col("kind") == "ambiguous", F.greatest("_dc", "_wc")).when(F.col("_ds") & (F.col("kind") == "door"), F.col("_dc")).when(F.col("kind") == "window", F.col("_wc"))
        .when(F.col("kind") == "door", 0.70).otherwise(0.0),
        "reason": F.when(F.col("kind") == "ambiguous", "door_window_score_within_ambiguity_margin").when(F.col("_ds") & (F.col("kind") == "door"), "door_line_and_endpoints_supported")
        .when(F.col("kind") == "window", "window_line_and_endpoints_supported").when(F.col("kind") == "door", "native_door_arc_supported")
        .when(F.col("kind") == "pending_opening", "native_short_line_supported").otherwise("no_door_or_window_support"),
    }).drop("_dc", "_wc", "_ds", "_ws")


def bridge_decision(df: DataFrame) -> DataFrame:
    """Bridge type of a gap from its matches, width and scale.

    Needs decision, n_openings, n_pending, width_px, scale (nullable) and the
    page's width and height in pixels.
    """
    limit = F.greatest(F.lit(4.0), F.least(F.lit(32.0), F.rint(F.least("image_w", "image_h") * 0.01)))
    small = F.when(F.col("scale").isNull(), F.col("width_px") <= limit).otherwise(F.col("width_px") * F.col("scale") <= 0.6000000000000001)
    return df.withColumn("bridge", F.when(F.col("decision") != "accepted_gap", "unresolved").when(F.col("n_openings") > 1, "unresolved").when(F.col("n_openings") == 1, "opening_bridge")
                         .when(F.col("n_pending") == 1, "pending_opening_bridge").when(F.col("n_pending") > 1, "unresolved").when(small, "small_gap_repair").otherwise("unresolved")).withColumn(
        "bridge_reason", F.when(F.col("decision") != "accepted_gap", "gap_rejected").when(F.col("n_openings") > 1, "multiple_matching_openings").when(F.col("n_openings") == 1, "accepted_opening_exact_gap_match")
        .when(F.col("n_pending") == 1, "pending_opening_exact_gap_match").when(F.col("n_pending") > 1, "multiple_matching_pending_openings").when(small, "gap_within_repair_limit").otherwise("gap_exceeds_repair_limit"))


BLOCKED_REASONS = ["inferred_edge_outside_roi", "inferred_intersection_outside_roi", "incompatible_corner_inside_directions", "inferred_edge_crosses_nearer_wall_band"]


def relax_endpoint_groups(edges: DataFrame) -> DataFrame:
    """Drop groups with a blocked reason; accept the rest and restate size."""
    bad = F.arrays_overlap("reason_codes", F.array(*[F.lit(r) for r in BLOCKED_REASONS]))
    g = edges.groupBy("page_id", "edge_group_id").agg(F.count(F.lit(1)).alias("edge_group_size"), F.max(F.coalesce(bad, F.lit(False))).alias("_bad")).filter("NOT _bad").drop("_bad")
    return edges.drop("edge_group_size").join(g, ["page_id", "edge_group_id"]).withColumns({
        "decision": F.lit("accepted_candidate"), "reason_codes": F.array(F.lit("calculation_only_endpoint_link"))})


def group_complete(edges: DataFrame, used: DataFrame) -> DataFrame:
    """Inferred groups: one declared size, equal to its members, all used."""
    u = used.select("page_id", "inference_id", F.lit(True).alias("_u")).distinct()
    g = edges.join(u, ["page_id", "inference_id"], "left").groupBy("page_id", "edge_group_id").agg(
        F.countDistinct("edge_group_size").alias("sizes"), F.max("edge_group_size").alias("declared"), F.count(F.lit(1)).alias("members"), F.count("_u").alias("n_used"))
    return g.withColumn("complete", (F.col("sizes") == 1) & (F.col("declared") == F.col("members")) & (F.col("n_used") == F.col("members")))


def select_face(faces: DataFrame) -> DataFrame:
    """Largest face per page; ambiguous when the second has 90 % of its area."""
    top = faces.withColumn("_n", F.row_number().over(W.partitionBy("page_id").orderBy(F.col("area").desc(), "face_id"))).filter("_n <= 2")
    p = top.groupBy("page_id").agg(F.max(F.when(F.col("_n") == 1, F.struct("face_id", "area"))).alias("a"), F.max(F.when(F.col("_n") == 2, F.col("area"))).alias("second"))
    return p.select("page_id", F.col("a.face_id").alias("face_id"), F.col("a.area").alias("area"),
                    F.when(F.col("second") >= F.col("a.area") * 0.90, "ambiguous_exterior").otherwise("selected").alias("status"))


def select_inferred_face(faces: DataFrame) -> DataFrame:
    """Lowest score per page; ambiguous when a rival needs little more length.

    Score order: inferred length, edges, mean difference (high first), real
    wall share (high first), id.
    """
    order = ["inferred_length", "n_edges", F.col("mean_difference").desc(), F.col("real_wall_ratio").desc(), "face_id"]
    top = faces.withColumn("_n", F.row_number().over(W.partitionBy("page_id").orderBy(*order))).filter("_n <= 2")
    p = top.groupBy("page_id").agg(F.max(F.when(F.col("_n") == 1, F.struct("face_id", "inferred_length", "perimeter"))).alias("a"), F.max(F.when(F.col("_n") == 2, F.col("inferred_length"))).alias("second"))
    rival = F.col("second") <= F.col("a.inferred_length") + F.greatest(F.lit(8.0), F.col("a.perimeter") * 0.02)
    return p.select("page_id", F.col("a.face_id").alias("face_id"), F.when(F.coalesce(rival, F.lit(False)), "ambiguous_exterior").otherwise("selected").alias("status"))


def ranked_gap_topk(gaps: DataFrame, max_gap: float, k: int) -> DataFrame:
    """Best record per line, then the top ``k`` per page by score.

    Score = 2·support + 1 − length / max_gap; ties by length, then line.
    """
    score = F.col("support") * 2.0 + 1.0 - F.col("length") / F.greatest(F.lit(1.0), F.lit(max_gap))
    best = gaps.groupBy("page_id", "line_key").agg(F.max(score).alias("score"), F.min("length").alias("length"))
    w = W.partitionBy("page_id").orderBy(F.col("score").desc(), "length", "line_key")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def decision_counts(df: DataFrame, page: str, column: str, values: list[str]) -> DataFrame:
    return df.groupBy(page).agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(column) == v).alias(v) for v in values])


def class_stats(cells: DataFrame) -> DataFrame:
    """Pixels and share per page and class."""
    c = cells.groupBy("page_id", "cls").agg(F.count(F.lit(1)).alias("pixels"))
    t = c.groupBy("page_id").agg(F.sum("pixels").alias("_t"))
    return c.join(t, "page_id").withColumn("percent", F.col("pixels") * 100.0 / F.col("_t")).drop("_t")


def exterior_side_lengths(cells: DataFrame) -> DataFrame:
    """Distinct columns or rows of boundary cells per side and class.

    The page's cells in the boundary band split by the farther axis from
    their centroid: top and bottom count x values, left and right y values.
    ``cells``: page_id, cls, x, y, in_band, in_footprint.
    """
    foot = lambda c: F.avg(F.when(F.col("in_footprint"), F.col(c)))
    box = cells.groupBy("page_id").agg(foot("x").alias("cx"), foot("y").alias("cy"))
    j = cells.filter("in_band").join(box, "page_id")
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    side = F.when(F.abs(dy) >= F.abs(dx), F.when(dy < 0, "top").otherwise("bottom")).otherwise(F.when(dx < 0, "left").otherwise("right"))
    j = j.withColumn("side", side).withColumn("at", F.when(F.col("side").isin("top", "bottom"), F.col("x")).otherwise(F.col("y")))
    return j.select("page_id", "cls", "side", "at").distinct().groupBy("page_id", "cls", "side").agg(F.count(F.lit(1)).alias("length_px"))
