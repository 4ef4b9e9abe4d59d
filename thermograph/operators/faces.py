"""Planar segment graphs: components, faces, bands, snapping, corners."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thermograph.operators.drawing import atomic_edges
from thermograph.operators.intervals import box_join, range_join, with_island
from thermograph.session import cut_lineage


def connected_components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Component (smallest vertex) of each vertex, by star contraction.

    ``edges``: keys + u, v. Every round links vertices to the smallest
    neighbour seen from either side, so rounds grow with the logarithm of the
    graph and not with its diameter. Rounds are checkpointed.
    """
    both = lambda e: e.select(*keys, "u", "v").unionByName(e.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
    e = cut_lineage(edges.select(*keys, "u", "v").filter("u <> v").distinct())
    vertices = edges.select(*keys, F.explode(F.array("u", "v")).alias("u")).distinct()

    def star(frame: DataFrame, large: bool) -> DataFrame:
        b = both(frame)
        b = b if large else b.filter("v < u")
        low = b.groupBy(*keys, "u").agg(F.min("v").alias("_m")).withColumn("_m", F.least("u", "_m"))
        j = b.join(low, [*keys, "u"])
        if large:
            out = j.filter("v > u").select(*keys, F.col("v").alias("u"), F.col("_m").alias("v"))
        else:
            out = j.select(*keys, F.col("v").alias("u"), F.col("_m").alias("v")).unionByName(low.select(*keys, "u", F.col("_m").alias("v")))
        return out.filter("u <> v").distinct()

    while True:
        nxt = cut_lineage(star(star(e, True), False))
        same = nxt.join(e, [*keys, "u", "v"], "left_anti").isEmpty() and e.join(nxt, [*keys, "u", "v"], "left_anti").isEmpty()
        e = nxt
        if same:
            break
    roots = e.groupBy(*keys, "u").agg(F.min("v").alias("component"))
    return vertices.join(roots, [*keys, "u"], "left").withColumn("component", F.coalesce("component", F.col("u")))


def directed_edges(edges: DataFrame, *carry: str) -> DataFrame:
    """Both directions of atomic edges with their heading (0 E, 1 S, 2 W, 3 N).

    Columns to ``carry`` must be the same for equal edges.
    """
    h = F.col("orientation") == "horizontal"
    e = edges.select("page_id", F.when(h, F.col("a")).otherwise(F.col("fixed")).alias("x0"), F.when(h, F.col("fixed")).otherwise(F.col("a")).alias("y0"),
                     F.when(h, F.col("b")).otherwise(F.col("fixed")).alias("x1"), F.when(h, F.col("fixed")).otherwise(F.col("b")).alias("y1"), *carry).distinct()
    d = e.unionByName(e.select("page_id", *carry, F.col("x1").alias("x0"), F.col("y1").alias("y0"), F.col("x0").alias("x1"), F.col("y0").alias("y1")))
    heading = F.when(F.col("x1") > F.col("x0"), 0).when(F.col("y1") > F.col("y0"), 1).when(F.col("x1") < F.col("x0"), 2).otherwise(3)
    return d.withColumn("heading", heading).withColumn("eid", F.struct("x0", "y0", "heading"))


def bounded_faces(segments: DataFrame, bucket: float = 64) -> DataFrame:
    """Faces with positive area of each page's line arrangement.

    At a vertex the walk turns to the first free heading among incoming + 1,
    same, − 1, + 2. Walks close into cycles; pointer doubling gives every
    edge the smallest edge of its cycle in log2(length) rounds. Returns one
    row per face; ``face_edges`` keeps the boundary in long form. Lines that
    meet no line across bound nothing and are left out first.
    """
    return face_summary(face_edges(cut_lineage(meeting_lines(segments, bucket)), bucket))


def meeting_lines(segments: DataFrame, bucket: float = 64) -> DataFrame:
    """Segments whose stretch of connected collinear lines meets some line across, itself joined to others or not."""
    c = F.col
    line = ["page_id", "orientation", "fixed"]
    s = with_island(segments, line)
    whole = s.groupBy(*line, "island_start").agg(F.max("axis_end").alias("_e"))
    side = lambda o, n: whole.filter(c("orientation") == o).select("page_id", c("fixed").alias(f"{n}_at"), c("island_start").alias(f"{n}_s"), c("_e").alias(f"{n}_e"))
    met = box_join(side("horizontal", "h"), side("vertical", "v"), ["page_id"], (c("h_s"), c("h_e")), (c("v_at"), c("v_at")), (c("h_at"), c("h_at")), (c("v_s"), c("v_e")), bucket)
    met = met.filter("h_at BETWEEN v_s AND v_e AND v_at BETWEEN h_s AND h_e")
    own = lambda o, n: met.select("page_id", F.lit(o).alias("orientation"), c(f"{n}_at").alias("fixed"), c(f"{n}_s").alias("island_start"))
    return s.join(own("horizontal", "h").unionByName(own("vertical", "v")).distinct(), [*line, "island_start"], "left_semi").drop("island_start")


def face_edges(segments: DataFrame, bucket: float = 64, carry: bool = False) -> DataFrame:
    """Directed edges with their ``face``; with ``carry`` also the seg_id of lines that don't overlap."""
    # Read by the walk and again for its result.
    d = cut_lineage(directed_edges(atomic_edges(segments, bucket), *(["seg_id"] if carry else [])))
    out = d.select("page_id", F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.col("heading").alias("h2"), F.col("eid").alias("next"))
    turn = F.element_at(F.array(*[F.lit(v) for v in (1, 0, 3, 2)]), ((F.col("h2") - F.col("heading") + 4) % 4 + 1).cast("int"))
    nxt = d.join(out, ["page_id", "x1", "y1"]).groupBy("page_id", "eid").agg(F.min_by("next", turn).alias("ptr"))
    state = cut_lineage(nxt.withColumn("low", F.least("eid", "ptr")))
    while True:
        hop = state.select("page_id", F.col("eid").alias("ptr"), F.col("ptr").alias("ptr2"), F.col("low").alias("low2"))
        new = cut_lineage(state.join(hop, ["page_id", "ptr"]).select("page_id", "eid", F.col("ptr2").alias("ptr"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("moved")))
        done = new.filter("moved").isEmpty()
        state = new.drop("moved")
        if done:
            break
    return d.join(state.select("page_id", "eid", F.col("low").alias("face")), ["page_id", "eid"])


def face_summary(edges: DataFrame) -> DataFrame:
    m = face_measures(edges)
    return m.select("page_id", F.concat_ws(":", "face.x0", "face.y0", "face.heading").alias("face_id"), *m.columns[2:])


def face_measures(edges: DataFrame) -> DataFrame:
    cross = F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")
    step = F.abs(F.col("x1") - F.col("x0")) + F.abs(F.col("y1") - F.col("y0"))
    f = edges.groupBy("page_id", "face").agg((F.sum(cross) / 2.0).alias("area"), F.sum(step).cast("double").alias("perimeter"), F.count(F.lit(1)).alias("n_edges"),
                                              F.min("x0").alias("x_min"), F.max("x0").alias("x_max"), F.min("y0").alias("y_min"), F.max("y0").alias("y_max"))
    return f.filter("n_edges >= 4 AND area > 0").select("page_id", "face", "area", "perimeter", "n_edges", "x_min", "x_max", "y_min", "y_max")


def room_candidates(faces: DataFrame, roi: DataFrame) -> DataFrame:
    """Faces inside the region with plausible area and model support.

    ``faces`` also has room_mean and footprint_mean; ``roi``: page_id, left,
    top, right, bottom, image_area.
    """
    j = faces.join(roi, "page_id")
    inside = (F.col("x_min") >= F.col("left")) & (F.col("x_max") <= F.col("right")) & (F.col("y_min") >= F.col("top")) & (F.col("y_max") <= F.col("bottom"))
    roi_area = F.greatest(F.lit(1), F.col("right") - F.col("left")) * F.greatest(F.lit(1), F.col("bottom") - F.col("top"))
    j = j.filter(inside & (F.col("area") >= F.greatest(F.lit(400.0), F.col("image_area") * 0.0001)) & (F.col("area") <= roi_area * 0.80))
    return j.withColumn("decision", F.when((F.col("room_mean") >= 0.35) & (F.col("footprint_mean") >= 0.50), "accepted_room_candidate").otherwise("suspicious_closed_region"))


def closure_applied(face_walls: DataFrame, snap_walls: DataFrame) -> DataFrame:
    """Faces whose boundary holds all walls of some snap record: page_id, face_id.

    ``face_walls``: page_id, face_id, wall_id; ``snap_walls``: page_id, snap_id,
    wall_id. A containment join by counts: a snap of n distinct walls is inside
    a face when n of its walls are among the face's. Snaps of one page and
    equal walls count once.
    """
    snaps = snap_walls.distinct()
    size = snaps.groupBy("page_id", "snap_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("wall_id")).alias("_w"))
    one = size.groupBy("page_id", "_w").agg(F.min("snap_id").alias("snap_id"), F.min("n").alias("n")).drop("_w")
    walls = snaps.join(one, ["page_id", "snap_id"])
    hit = face_walls.select("page_id", "face_id", "wall_id").distinct().join(walls, ["page_id", "wall_id"]).groupBy("page_id", "face_id", "snap_id").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("n"))
    return hit.filter("m = n").select("page_id", "face_id").distinct()


def slab_runs(edges: DataFrame, keys: list[str], bucket: float = 64) -> DataFrame:
    """Inside runs of axis polygons by scan lines: keys, y0, y1, x0, x1.

    ``edges``: keys, x0, y0, x1, y1. Between two neighbouring y values of a
    polygon its vertical edges are crossed in one order; the parts between odd
    and even crossings lie inside.
    """
    v = edges.filter("x0 = x1").select(*keys, F.col("x0").alias("vx"), F.least("y0", "y1").alias("ya"), F.greatest("y0", "y1").alias("yz"))
    level = v.select(*keys, F.explode(F.array("ya", "yz")).alias("s0")).distinct()
    level = level.withColumn("s1", F.lead("s0").over(W.partitionBy(*keys).orderBy("s0"))).filter("s1 IS NOT NULL")
    cross = range_join(v, level, keys, (F.col("ya"), F.col("yz")), (F.col("s0"), F.col("s1")), bucket).filter("ya <= s0 AND s1 <= yz")
    w = W.partitionBy(*keys, "s0", "s1").orderBy("vx")
    cross = cross.withColumns({"_n": F.row_number().over(w), "_x1": F.lead("vx").over(w)}).filter("_n % 2 = 1 AND _x1 > vx")
    return cross.select(*keys, F.col("s0").alias("y0"), F.col("s1").alias("y1"), F.col("vx").alias("x0"), F.col("_x1").alias("x1"))


def face_footprint_mean(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """Mean cell value inside each axis polygon.

    ``edges``: page_id, face_id, x0, y0, x1, y1 (boundary in order);
    ``cells``: page_id, x, y, value, centred at half units. A face's inside
    runs look up running sums of their row at both ends, so no cell meets a
    face. Grids may come as ``raster_line_sums`` takes them. Faces without a
    cell have no row.
    """
    if "values" in cells.columns:
        return raster_line_sums(edges, cells).filter("n_cells > 0").select("page_id", "face_id", (F.col("_s") / F.col("n_cells")).alias("mean"), "n_cells")
    runs = slab_runs(edges, ["page_id", "face_id"])
    # A row is crossed where its centre lies: y0 <= y + 1/2 < y1.
    rows = runs.withColumn("y", F.explode(F.expr("CASE WHEN ceil(y0 - 0.5) <= ceil(y1 - 0.5) - 1 THEN sequence(CAST(ceil(y0 - 0.5) AS BIGINT), CAST(ceil(y1 - 0.5) - 1 AS BIGINT)) ELSE array() END")))
    ask = rows.select("page_id", "y", F.explode(F.array(F.struct(F.col("x0").cast("double").alias("at"), F.lit(-1).alias("sign")), F.struct(F.col("x1").cast("double").alias("at"), F.lit(1).alias("sign")))).alias("a"), "face_id")
    ask = ask.select("page_id", "y", "a.at", "a.sign", "face_id", F.lit(None).cast("double").alias("value"))
    have = cells.filter("value IS NOT NULL").select("page_id", F.col("y").cast("bigint").alias("y"), (F.col("x") + 0.5).cast("double").alias("at"), F.lit(0).alias("sign"), F.lit(None).cast(edges.schema["face_id"].dataType).alias("face_id"), F.col("value").cast("double").alias("value"))
    # At the same place an end comes before a cell.
    w = W.partitionBy("page_id", "y").orderBy("at", F.col("value").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    sums = have.unionByName(ask).withColumns({"_s": F.sum("value").over(w), "_n": F.count("value").over(w)}).filter("sign <> 0")
    out = sums.groupBy("page_id", "face_id").agg(F.sum(F.coalesce("_s", F.lit(0.0)) * F.col("sign")).alias("_s"), F.sum(F.col("_n") * F.col("sign")).alias("n_cells")).filter("n_cells > 0")
    return out.select("page_id", "face_id", (F.col("_s") / F.col("n_cells")).alias("mean"), "n_cells")


def raster_line_sums(edges: DataFrame, lines: DataFrame, bucket: float = 64) -> DataFrame:
    """Sum and number of cells inside each axis polygon: page_id, face_id, _s, n_cells.

    ``lines``: page_id, y, x0, step and ``values``, the cells x0, x0 + step,
    ... of one row of a grid. Runs take a slice of the lines between their y
    values, so a row of cells is one row here. Nulls are no cells.
    """
    c = F.col
    runs = slab_runs(edges, ["page_id", "face_id"]).withColumnsRenamed({"x0": "_x0", "x1": "_x1"})
    own = lines.select("page_id", (c("y") + 0.5).alias("_y"), c("x0").alias("_at"), "step", "values")
    j = range_join(runs, own, ["page_id"], (c("y0"), c("y1")), (c("_y"), c("_y")), bucket).filter("y0 <= _y AND _y < y1")
    place = lambda x: F.ceil((c(x) - 0.5 - c("_at")) / c("step"))
    lo, hi = F.greatest(place("_x0"), F.lit(0)), F.least(place("_x1"), F.size("values"))
    j = j.withColumns({"_lo": lo, "_hi": hi}).filter("_lo < _hi").select("page_id", "face_id", F.slice("values", (c("_lo") + 1).cast("int"), (c("_hi") - c("_lo")).cast("int")).alias("_v"))
    # A sum is null where a cell is; only then are the others looked for one by one.
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    j = j.withColumn("_all", total("_v")).withColumn("_v", F.when(c("_all").isNull(), F.array_compact("_v")).otherwise(c("_v")))
    out = j.groupBy("page_id", "face_id").agg(F.sum(F.coalesce("_all", total("_v"))).alias("_s"), F.sum(F.size("_v").cast("bigint")).alias("n_cells"))
    return out.filter("n_cells > 0")


def nested_polygons(polygons: DataFrame, bucket: float = 64) -> DataFrame:
    """(outer, inner) pairs where every inner vertex lies strictly inside.

    ``polygons``: page_id, poly_id, x, y, pos (axis polygons).
    """
    w = W.partitionBy("page_id", "poly_id").orderBy("pos")
    first = F.first(F.struct("x", "y")).over(w)
    e = polygons.withColumns({"_f": first, "x1": F.lead("x").over(w), "y1": F.lead("y").over(w)})
    e = e.select("page_id", "poly_id", F.col("x").alias("x0"), F.col("y").alias("y0"), F.coalesce("x1", "_f.x").alias("x1"), F.coalesce("y1", "_f.y").alias("y1"))
    # Equal outlines lie in the same ones: the first of each is compared, and all take its pairs.
    shape = polygons.groupBy("page_id", "poly_id").agg(F.sort_array(F.collect_list(F.struct("pos", "x", "y"))).alias("_s"))
    shape = shape.withColumn("_s", F.transform("_s", lambda p: F.struct(p["x"], p["y"])))
    first_of = shape.groupBy("page_id", "_s").agg(F.min("poly_id").alias("rep"))
    of = cut_lineage(shape.join(first_of, ["page_id", "_s"]).select("page_id", "poly_id", "rep"))
    pairs = nested_outlines(e.join(of.filter("poly_id = rep").select("page_id", "poly_id"), ["page_id", "poly_id"], "left_semi"), bucket)
    all_of = lambda n: of.select("page_id", F.col("rep").alias(n), F.col("poly_id").alias(f"_{n}"))
    return pairs.join(all_of("outer"), ["page_id", "outer"]).join(all_of("inner"), ["page_id", "inner"]).select("page_id", F.col("_outer").alias("outer"), F.col("_inner").alias("inner"))


def nested_outlines(edges: DataFrame, bucket: float = 64) -> DataFrame:
    """As ``nested_polygons`` for boundaries given as edges: page_id, poly_id, x0, y0, x1, y1.

    Boxes pair first. A vertex then is inside when the runs above and below it
    both hold it: it meets the runs of its height only, never an edge.
    """
    box = edges.groupBy("page_id", "poly_id").agg(F.min("x0").alias("a0"), F.max("x0").alias("a1"), F.min("y0").alias("b0"), F.max("y0").alias("b1"))
    o = box.select("page_id", F.col("poly_id").alias("outer"), F.col("a0").alias("ox0"), F.col("a1").alias("ox1"), F.col("b0").alias("oy0"), F.col("b1").alias("oy1"))
    i = box.select("page_id", F.col("poly_id").alias("inner"), "a0", "a1", "b0", "b1")
    pairs = box_join(o, i, ["page_id"], (F.col("ox0"), F.col("ox1")), (F.col("a0"), F.col("a1")), (F.col("oy0"), F.col("oy1")), (F.col("b0"), F.col("b1")), bucket)
    pairs = pairs.filter("outer <> inner AND ox0 < a0 AND a1 < ox1 AND oy0 < b0 AND b1 < oy1").select("page_id", "outer", "inner")
    points = edges.select("page_id", F.col("poly_id").alias("inner"), F.col("x0").alias("px"), F.col("y0").alias("py")).distinct()
    verts = pairs.join(points, ["page_id", "inner"])
    runs = slab_runs(edges, ["page_id", "poly_id"]).withColumnRenamed("poly_id", "outer")
    held = range_join(verts, runs, ["page_id", "outer"], (F.col("py"), F.col("py")), (F.col("y0"), F.col("y1")), bucket).filter("x0 < px AND px < x1")
    held = held.groupBy("page_id", "outer", "inner", "px", "py").agg(F.sum(F.when((F.col("y0") < F.col("py")) & (F.col("py") < F.col("y1")), 2).otherwise(1)).alias("n")).filter("n = 2")
    want = verts.groupBy("page_id", "outer", "inner").agg(F.count(F.lit(1)).alias("want"))
    got = held.groupBy("page_id", "outer", "inner").agg(F.count(F.lit(1)).alias("want"))
    return want.join(got, ["page_id", "outer", "inner", "want"], "left_semi").select("page_id", "outer", "inner")


def greedy_bands(walls: DataFrame, keys: list[str], tol: float = 16) -> DataFrame:
    """Band founders and members as if walls joined in id order.

    A wall founds a band unless an earlier founder lies within ``tol``. Only
    the first wall of each axis value can found, so the search runs over
    distinct values: each round, values with no undecided earlier neighbour
    found a band and strike their neighbours out. Members then take the
    nearest founder that exists before them, the earlier one on ties.
    """
    first = walls.groupBy(*keys, "fixed").agg(F.min("wall_id").alias("wall_id"))
    pair = lambda a, b: range_join(a, b, keys, (F.col("fixed") - tol, F.col("fixed") + tol), (F.col("o_fixed"), F.col("o_fixed")), max(4 * tol, 1))
    other = lambda f: f.select(*keys, F.col("fixed").alias("o_fixed"), F.col("wall_id").alias("o_id"))
    links = cut_lineage(pair(first, other(first)).filter("o_id < wall_id").select(*keys, "wall_id", "o_id"))
    open_, founders = cut_lineage(first), None
    while True:
        live = links.join(open_.select(*keys, "wall_id"), [*keys, "wall_id"], "left_semi").join(open_.select(*keys, F.col("wall_id").alias("o_id")), [*keys, "o_id"], "left_semi")
        new = open_.join(live.select(*keys, "wall_id").distinct(), [*keys, "wall_id"], "left_anti")
        founders = new if founders is None else founders.unionByName(new)
        struck = live.join(new.select(*keys, F.col("wall_id").alias("o_id")), [*keys, "o_id"], "left_semi").select(*keys, "wall_id").unionByName(new.select(*keys, "wall_id")).distinct()
        founders = cut_lineage(founders)
        open_ = cut_lineage(open_.join(struck, [*keys, "wall_id"], "left_anti"))
        if open_.isEmpty():
            break
    near = pair(walls, other(founders)).filter("o_id <= wall_id")
    best = near.groupBy(*keys, "wall_id").agg(F.min(F.struct(F.abs(F.col("fixed") - F.col("o_fixed")).alias("d"), "o_id", "o_fixed")).alias("m"))
    return best.select(*keys, "wall_id", F.col("m.o_id").alias("band_founder"), F.col("m.o_fixed").alias("band_fixed"))


def snap_endpoints(lines: DataFrame, snap: float) -> DataFrame:
    """Line ends snapped to the unique nearest perpendicular line.

    Lines move in id order and later lines see moved ones. A line's axis never
    moves, so candidate pairs are found once; rounds only re-test which
    targets still reach, each round settling one more step of the dependency
    chain, until nothing changes. ``lines``: page_id, line_id, orientation,
    fixed, axis_start, axis_end.
    """
    base = cut_lineage(lines.select("page_id", "line_id", "orientation", "fixed", "axis_start", "axis_end"))
    ends = base.select("page_id", "line_id", F.col("fixed").alias("at"), F.when(F.col("orientation") == "horizontal", "vertical").otherwise("horizontal").alias("orientation"),
                       F.explode(F.array(F.struct(F.lit("s").alias("side"), F.col("axis_start").alias("p")), F.struct(F.lit("e").alias("side"), F.col("axis_end").alias("p")))).alias("x")).select("page_id", "line_id", "at", "orientation", "x.side", "x.p")
    target = base.select("page_id", "orientation", F.col("line_id").alias("t_id"), F.col("fixed").alias("t_at"), F.col("axis_start").alias("t_s0"), F.col("axis_end").alias("t_e0"))
    # An end moves by no more than ``snap``, so a target that never comes near the line's axis drops out before the rounds.
    pairs = box_join(ends, target, ["page_id", "orientation"], (F.col("p") - snap, F.col("p") + snap), (F.col("t_at"), F.col("t_at")),
                     (F.col("at"), F.col("at")), (F.col("t_s0") - snap, F.col("t_e0") + snap), max(16 * snap, 1))
    pairs = pairs.withColumn("d", F.abs(F.col("t_at") - F.col("p"))).filter(F.col("d").between(1e-12, snap) & F.col("at").between(F.col("t_s0") - snap, F.col("t_e0") + snap))
    pairs = cut_lineage(pairs.drop("orientation", "p"))
    # Rounds hold moved lines only; the others stay as they are.
    state = pairs.select("page_id", "line_id", F.lit(None).cast("double").alias("ns"), F.lit(None).cast("double").alias("ne")).limit(0)
    while True:
        now = state.select("page_id", F.col("line_id").alias("t_id"), "ns", "ne")
        j = pairs.join(now, ["page_id", "t_id"], "left")
        moved = F.col("t_id") < F.col("line_id")
        at = lambda new, old: F.when(moved, F.coalesce(new, old)).otherwise(F.col(old))
        j = j.filter(F.col("at").between(at("ns", "t_s0"), at("ne", "t_e0")))
        near = j.groupBy("page_id", "line_id", "side", "d").agg(F.min("t_at").alias("lo"), F.max("t_at").alias("hi"))
        pick = near.groupBy("page_id", "line_id", "side").agg(F.min(F.struct("d", "lo", "hi")).alias("m")).filter("m.lo = m.hi")
        new = cut_lineage(pick.groupBy("page_id", "line_id").agg(*[F.max(F.when(F.col("side") == x, F.col("m.lo"))).cast("double").alias(f"n{x}") for x in "se"]))
        same = new.subtract(state).isEmpty() and state.subtract(new).isEmpty()
        state = new
        if same:
            break
    out = base.join(state, ["page_id", "line_id"], "left").withColumns({"_s": F.coalesce("ns", "axis_start"), "_e": F.coalesce("ne", "axis_end")})
    return out.select("page_id", "line_id", "orientation", "fixed", F.col("_s").alias("axis_start"), F.col("_e").alias("axis_end"),
                      ((F.col("_s") != F.col("axis_start")) | (F.col("_e") != F.col("axis_end"))).alias("snapped"))


def dangling_ends(bands: DataFrame, tol: float = 4, bucket: float = 128) -> DataFrame:
    """Band ends that no other band passes within ``tol``."""
    h = F.col("orientation") == "horizontal"
    pt = lambda side, axis: F.struct(F.lit(side).alias("side"), F.when(h, F.col(axis)).otherwise(F.col("fixed")).alias("px"), F.when(h, F.col("fixed")).otherwise(F.col(axis)).alias("py"))
    ends = bands.select("page_id", "band_id", "orientation", "fixed", "inside_direction", F.explode(F.array(pt("start", "axis_start"), pt("end", "axis_end"))).alias("e")).select("page_id", "band_id", "orientation", "fixed", "inside_direction", "e.*")
    o = bands.select("page_id", F.col("band_id").alias("o_id"), F.when(h, F.col("axis_start")).otherwise(F.col("fixed")).alias("ox0"), F.when(h, F.col("axis_end")).otherwise(F.col("fixed")).alias("ox1"),
                     F.when(h, F.col("fixed")).otherwise(F.col("axis_start")).alias("oy0"), F.when(h, F.col("fixed")).otherwise(F.col("axis_end")).alias("oy1"))
    hit = box_join(ends, o, ["page_id"], (F.col("px"), F.col("px")), (F.col("ox0") - tol, F.col("ox1") + tol), (F.col("py"), F.col("py")), (F.col("oy0") - tol, F.col("oy1") + tol), bucket).filter(
        (F.col("o_id") != F.col("band_id")) & F.col("py").between(F.col("oy0") - tol, F.col("oy1") + tol))
    return ends.join(hit.select("page_id", "band_id", "side").distinct(), ["page_id", "band_id", "side"], "left_anti")


def corner_compatible() -> Column:
    """Both ends run towards the corner and face its inside."""
    c = F.col
    h_to = F.when(c("h_side") == "start", c("v_fixed") <= c("h_px")).otherwise(c("v_fixed") >= c("h_px"))
    v_to = F.when(c("v_side") == "start", c("h_fixed") <= c("v_py")).otherwise(c("h_fixed") >= c("v_py"))
    return (h_to & v_to & (c("v_dir") == F.when(c("h_side") == "start", "right").otherwise("left")) & (c("h_dir") == F.when(c("v_side") == "start", "down").otherwise("up")))


def corner_candidates(bands: DataFrame, reach: float, tol: float = 4, per_end: int = 12, bucket: float = 128) -> DataFrame:
    """Corner options of dangling horizontal ends, the best ``per_end`` each.

    Ranked by compatibility, longer leg, sum of legs, then band and side.
    ``reach`` bounds the legs to the longest edge a later step may accept, so
    the search is a range join and never all pairs of a page.
    """
    d = dangling_ends(bands, tol, bucket)
    p = lambda n, o: d.filter(F.col("orientation") == o).select("page_id", F.col("band_id").alias(f"{n}_id"), F.col("side").alias(f"{n}_side"), F.col("fixed").alias(f"{n}_fixed"), F.col("inside_direction").alias(f"{n}_dir"), F.col("px").alias(f"{n}_px"), F.col("py").alias(f"{n}_py"))
    j = box_join(p("h", "horizontal"), p("v", "vertical"), ["page_id"], (F.col("h_px") - reach, F.col("h_px") + reach), (F.col("v_fixed"), F.col("v_fixed")),
                 (F.col("h_fixed") - reach, F.col("h_fixed") + reach), (F.col("v_py"), F.col("v_py")), max(bucket, reach))
    j = j.withColumns({"h_len": F.abs(F.col("v_fixed") - F.col("h_px")), "v_len": F.abs(F.col("h_fixed") - F.col("v_py"))})
    j = j.filter((F.greatest("h_len", "v_len") > tol) & (F.col("v_len") <= reach)).withColumn("compatible", corner_compatible())
    w = W.partitionBy("page_id", "h_id", "h_side").orderBy(F.col("compatible").desc(), F.greatest("h_len", "v_len"), F.col("h_len") + F.col("v_len"), "v_id", "v_side")
    j = j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_end)
    reasons = F.filter(F.array(F.when(~F.col("compatible"), "incompatible_corner_inside_directions"), F.when((F.col("h_len") == 0) | (F.col("v_len") == 0), "incomplete_orthogonal_corner")), lambda r: r.isNotNull())
    return j.select("page_id", "h_id", "h_side", "v_id", "v_side", F.col("v_fixed").alias("x"), F.col("h_fixed").alias("y"), "h_len", "v_len", "compatible", "rank", reasons.alias("reason_codes"))


def collinear_extensions(bands: DataFrame, tol: float = 4, bucket: float = 128) -> DataFrame:
    """Gaps between neighbouring bands of one axis whose facing ends dangle."""
    d = dangling_ends(bands, tol, bucket).select("page_id", "band_id", "side")
    w = W.partitionBy("page_id", "orientation", "fixed", "inside_direction").orderBy("axis_start", "axis_end")
    n = bands.withColumns({"next_id": F.lead("band_id").over(w), "next_start": F.lead("axis_start").over(w)}).filter(F.col("next_start") - F.col("axis_end") > tol)
    n = n.join(d.filter("side = 'end'").select("page_id", "band_id"), ["page_id", "band_id"], "left_semi")
    return n.join(d.filter("side = 'start'").select("page_id", F.col("band_id").alias("next_id")), ["page_id", "next_id"], "left_semi").select(
        "page_id", "band_id", "next_id", "orientation", "fixed", "inside_direction", F.col("axis_end").alias("gap_start"), F.col("next_start").alias("gap_end"))


def edge_crosses_band_anti(edges: DataFrame, bands: DataFrame, tol: float = 4, bucket: float = 128) -> DataFrame:
    """Edges that no band crosses or overlaps, anchor bands excepted.

    ``edges``: page_id, edge_id, orientation, fixed, axis_start, axis_end,
    anchor_ids; ``bands`` with source_ids. Edges are judged row by row: an id
    may stand for several lines of a page, and one that is crossed leaves the
    others in.
    """
    h = F.col("orientation") == "horizontal"
    x = lambda a: F.when(h, F.col(a)).otherwise(F.col("fixed"))
    y = lambda a: F.when(h, F.col("fixed")).otherwise(F.col(a))
    e = edges.withColumns({"ex0": x("axis_start"), "ex1": x("axis_end"), "ey0": y("axis_start"), "ey1": y("axis_end")})
    b = bands.select("page_id", F.col("orientation").alias("b_o"), F.col("fixed").alias("b_at"), F.col("axis_start").alias("b_s"), F.col("axis_end").alias("b_e"), "source_ids",
                     x("axis_start").alias("bx0"), x("axis_end").alias("bx1"), y("axis_start").alias("by0"), y("axis_end").alias("by1"))
    j = box_join(e, b, ["page_id"], (F.col("ex0") - tol, F.col("ex1") + tol), (F.col("bx0"), F.col("bx1")), (F.col("ey0") - tol, F.col("ey1") + tol), (F.col("by0"), F.col("by1")), bucket).filter(~F.arrays_overlap("anchor_ids", "source_ids"))
    c = F.col
    along = (c("b_o") == c("orientation")) & (F.abs(c("b_at") - c("fixed")) <= tol) & (F.least("axis_end", "b_e") - F.greatest("axis_start", "b_s") > tol)
    across = (c("b_o") != c("orientation")) & (c("b_at") > c("axis_start") + tol) & (c("b_at") < c("axis_end") - tol) & c("fixed").between(c("b_s") - tol, c("b_e") + tol)
    row = ["page_id", "edge_id", "orientation", "fixed", "axis_start", "axis_end", "anchor_ids"]
    return edges.join(j.filter(along | across).select(*row).distinct(), row, "left_anti")


def inferred_edge_decision(edges: DataFrame) -> DataFrame:
    """Edge reasons, shared by the whole group; a clean group is accepted.

    Needs inside_roi, length, max_length, crosses_band and the footprint
    means and support shares of both sides.
    """
    c = F.col
    own = F.filter(F.array(
        F.when(~c("inside_roi"), "inferred_edge_outside_roi"), F.when(c("length") > c("max_length"), "inferred_edge_exceeds_short_side_limit"), F.when(c("crosses_band"), "inferred_edge_crosses_nearer_wall_band"),
        F.when((c("inside_mean") < 0.50) | (c("inside_mean") - c("outside_mean") < 0.25) | (c("boundary_mean") < 0.35), "insufficient_inside_footprint_support"),
        F.when(c("inside_share") < 0.80, "discontinuous_inside_footprint_support"), F.when(c("outside_share") >= 0.50, "inferred_edge_crosses_building_interior")), lambda r: r.isNotNull())
    e = edges.withColumn("_own", own)
    g = e.select("page_id", "edge_group_id", F.explode("_own").alias("r")).groupBy("page_id", "edge_group_id").agg(F.array_sort(F.collect_set("r")).alias("group_reasons"))
    return e.drop("_own").join(g, ["page_id", "edge_group_id"], "left").withColumn("decision", F.when(F.col("group_reasons").isNull(), "accepted_candidate").otherwise("rejected_candidate"))


def boundary_partition_check(edges: DataFrame, parts: DataFrame, bucket: float = 64) -> DataFrame:
    """Whether parts tile each polygon edge: no gap, overlap or stray part.

    ``edges``: page_id, edge_id, orientation, fixed, e0, e1; ``parts``:
    page_id, part_id, orientation, fixed, axis_start, axis_end.
    """
    keys = ["page_id", "orientation", "fixed"]
    j = range_join(edges, parts, keys, (F.col("e0"), F.col("e1")), (F.col("axis_start"), F.col("axis_end")), bucket).filter("e0 <= axis_start AND axis_end <= e1 AND axis_start < axis_end")
    stray = parts.join(j.groupBy("page_id", "part_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 1"), ["page_id", "part_id"], "left_anti").select("page_id").distinct().withColumn("_stray", F.lit(True))
    w = W.partitionBy("page_id", "edge_id").orderBy("axis_start", "axis_end")
    s = j.withColumn("_prev", F.coalesce(F.lag("axis_end").over(w), F.col("e0")))
    t = s.groupBy("page_id", "edge_id").agg(F.max(F.col("axis_start") > F.col("_prev")).alias("gap"), F.max(F.col("axis_start") < F.col("_prev")).alias("overlap"), F.max("axis_end").alias("_end"))
    r = edges.join(t, ["page_id", "edge_id"], "left").withColumn("ok", F.coalesce(~F.col("gap") & ~F.col("overlap") & (F.col("_end") == F.col("e1")), F.lit(False)))
    p = r.groupBy("page_id").agg(F.min("ok").alias("tiled"), F.count_if(~F.col("ok")).alias("bad_edges"))
    return p.join(stray, "page_id", "left").select("page_id", (F.col("tiled") & F.col("_stray").isNull()).alias("valid"), "bad_edges")


def provenance_match(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Whether two artifacts of a page carry the same provenance."""
    x = a.select("page_id", F.struct(*columns).alias("_a"))
    y = b.select("page_id", F.struct(*columns).alias("_b"))
    return x.join(y, "page_id", "full_outer").select("page_id", (F.col("_a").isNotNull() & F.col("_b").isNotNull() & F.col("_a").eqNullSafe(F.col("_b"))).alias("same"))


def recovered_wall_rows(walls: DataFrame) -> DataFrame:
    """Recovered walls on their band's axis; original ends are kept.

    Needs fixed, band_fixed and reason_codes.
    """
    return walls.withColumns({"original_fixed": F.col("fixed"), "fixed": F.col("band_fixed"), "recovery_method": F.lit("exterior_door_arc_chain"),
                              "reason_codes": F.array_distinct(F.array_append("reason_codes", F.lit("native_wall_connected_through_exterior_door_arc")))}).drop("band_fixed")


def crossed_outlines(polygons: DataFrame, per_tile: int = 16) -> DataFrame:
    """page_id of polygons (page_id, points) whose outline meets itself outside of common corners.

    Edges meet those of their own polygon only, tile by tile of its width (one
    tile for each ``per_tile`` edges), and neighbours count when they fold back
    on each other.
    """
    c = F.col
    size = F.size("points")
    edge = F.transform("points", lambda p, i: F.struct(i.alias("i"), p["x"].cast("double").alias("x0"), p["y"].cast("double").alias("y0"), F.col("points")[(i + 1) % size]["x"].cast("double").alias("x1"), F.col("points")[(i + 1) % size]["y"].cast("double").alias("y1")))
    xs = F.transform("points", lambda p: p["x"].cast("double"))
    tiles = F.least(F.lit(1024.0), F.ceil(size / per_tile).cast("double"))
    # A width past the box keeps small outlines in one tile.
    width = F.when(tiles > 1, F.greatest((F.array_max(xs) - F.array_min(xs)) / tiles, F.lit(1e-300))).otherwise(F.greatest((F.array_max(xs) - F.array_min(xs)) * 2, F.lit(1e-300)))
    e = polygons.filter(size >= 3).select("page_id", size.alias("n"), F.array_min(xs).alias("lo"), width.alias("w"), F.explode(edge).alias("e")).select("page_id", "n", "lo", "w", "e.*")
    at = lambda x: (x - c("lo")) / c("w")
    e = e.withColumns({"t0": at(F.least("x0", "x1")), "t1": at(F.greatest("x0", "x1"))}).drop("lo", "w")
    side = lambda s: e.select("page_id", *[c(x).alias(f"{s}{x}") for x in ("i", "n", "x0", "y0", "x1", "y1", "t0", "t1")])
    j = range_join(side("a"), side("b"), ["page_id"], (c("at0"), c("at1")), (c("bt0"), c("bt1")), 1).filter("ai < bi AND least(ay0, ay1) <= greatest(by0, by1) AND least(by0, by1) <= greatest(ay0, ay1)")
    turn = lambda p, q, r: F.signum((c(f"{q}x") - c(f"{p}x")) * (c(f"{r}y") - c(f"{p}y")) - (c(f"{q}y") - c(f"{p}y")) * (c(f"{r}x") - c(f"{p}x")))
    names = {"p": ("ax0", "ay0"), "q": ("ax1", "ay1"), "r": ("bx0", "by0"), "s": ("bx1", "by1")}
    j = j.withColumns({f"{k}{d}": c(v) for k, xy in names.items() for d, v in zip("xy", xy)})
    j = j.withColumns({"d1": turn("p", "q", "r"), "d2": turn("p", "q", "s"), "d3": turn("r", "s", "p"), "d4": turn("r", "s", "q")})
    beside = (c("bi") == c("ai") + 1) | ((c("ai") == 0) & (c("bi") == c("an") - 1))
    # Boxes overlap; lines then meet unless one end pair lies strictly on one side.
    meet = (c("d1") * c("d2") <= 0) & (c("d3") * c("d4") <= 0)
    flat = (c("d1") == 0) & (c("d2") == 0)
    along = F.greatest(F.least(F.greatest("px", "qx"), F.greatest("rx", "sx")) - F.greatest(F.least("px", "qx"), F.least("rx", "sx")), F.least(F.greatest("py", "qy"), F.greatest("ry", "sy")) - F.greatest(F.least("py", "qy"), F.least("ry", "sy")))
    return j.filter(F.when(beside, flat & (along > 0)).otherwise(meet)).select("page_id").distinct()


def near_equal(a: Column, b: Column, places: int = 4) -> Column:
    """Whether ``a`` lies within ``places`` units in the last place of ``b``."""
    size = F.greatest(F.abs(b), F.lit(2.0**-1022))
    unit = F.pow(F.lit(2.0), F.floor(F.log2(size)) - 52)
    # log2 may round up to the next power of two just below it
    unit = F.when(F.pow(F.lit(2.0), F.floor(F.log2(size))) > size, unit / 2).otherwise(unit)
    return F.coalesce(F.abs(a - b) <= unit * places, F.lit(False))


def confirm_checks(polygons: DataFrame) -> DataFrame:
    """Errors that keep an exterior outline from being confirmed.

    ``polygons``: page_id (one row each), points, area_px2, perimeter_px,
    unresolved, max_repair_m. Outlines must not cross themselves; areas and
    perimeters may differ by four units in the last place.
    """
    from thermograph.operators.drawing import polygon_measures
    crossed = crossed_outlines(polygons).withColumn("_x", F.lit(True))
    p = polygons.join(crossed, "page_id", "left").withColumn("_m", polygon_measures(F.col("points")))
    return p.withColumn("errors", F.filter(F.array(
        F.when(F.size("points") < 4, "too_few_points"), F.when(F.col("_x"), "self_intersecting"), F.when(~near_equal(F.col("area_px2"), F.col("_m.area")), "area_mismatch"),
        F.when(~near_equal(F.col("perimeter_px"), F.col("_m.perimeter")), "perimeter_mismatch"),
        F.when(F.col("unresolved") > 0, "unresolved_gaps"), F.when(F.col("max_repair_m") > 0.6, "repair_too_wide")), lambda e: e.isNotNull())).drop("_m", "_x")


def layer_geometry(entities: DataFrame, scale: float = 1.0) -> DataFrame:
    """Length and bounds per drawing and layer. ``entities``: drawing_id, layer, points."""
    from thermograph.operators.drawing import polyline_length
    e = entities.withColumn("_len", polyline_length(F.col("points")) * scale)
    lo = lambda f: F.array_min(F.transform("points", lambda p: p[f])) * scale
    hi = lambda f: F.array_max(F.transform("points", lambda p: p[f])) * scale
    return e.groupBy("drawing_id", "layer").agg(F.sum("_len").alias("length"), F.min(lo("x")).alias("x_min"), F.max(hi("x")).alias("x_max"), F.min(lo("y")).alias("y_min"), F.max(hi("y")).alias("y_max"), F.count(F.lit(1)).alias("entities"))


def drawing_summary(entities: DataFrame, scale: float = 1.0) -> DataFrame:
    """Bounds and totals per drawing, and what each layer adds: drawing_id, x_min, y_min, width, height, length, entities, layers.

    ``layers`` is a sorted list of (layer, length, entities), one entry a layer
    and not a row. Drawings without a point are 1 wide and high and have no
    corner.
    """
    own = layer_geometry(entities, scale)
    out = own.groupBy("drawing_id").agg(F.min("x_min").alias("x_min"), F.min("y_min").alias("y_min"), F.max("x_max").alias("_x"), F.max("y_max").alias("_y"), F.sum("length").alias("length"), F.sum("entities").alias("entities"),
                                        F.sort_array(F.collect_list(F.struct("layer", "length", "entities"))).alias("layers"))
    size = lambda hi, lo: F.coalesce(F.col(hi) - F.col(lo), F.lit(1.0))
    return out.select("drawing_id", "x_min", "y_min", size("_x", "x_min").alias("width"), size("_y", "y_min").alias("height"), "length", "entities", "layers")


def convex_hull_area(points: DataFrame, keys: list[str], tile: float = 64) -> DataFrame:
    """Area of the convex hull of each drawing's points.

    Only the lowest and highest point of each x value can lie on the hull, and
    of those only hull points of each x tile; both reductions run before the
    final chain over the small remainder. Chains run along sorted rows, many
    drawings to a task and batch, and hold no more than the hull at hand.
    """
    col = points.groupBy(*keys, "x").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    ends = col.select(*keys, "x", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("y")).withColumn("_t", F.floor(F.col("x") / tile))

    def push(out: list, q: tuple, sign: int) -> None:
        while len(out) > 1 and ((out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0])) * sign <= 0:
            out.pop()
        out.append(q)

    def hulls(frames, n: int):
        """(key of ``n`` columns, hull in order) of rows sorted by key, x and y."""
        key, below, above = None, [], []
        for f in frames:
            for row in zip(*[f[k].tolist() for k in f.columns]):
                if row[:n] != key:
                    if below:
                        yield key, below + above[-2:0:-1]
                    key, below, above = row[:n], [], []
                push(below, row[n:], 1)
                push(above, row[n:], -1)
        if below:
            yield key, below + above[-2:0:-1]

    def batches(rows, names: list[str], size: int = 10000):
        out = []
        for row in rows:
            out.append(row)
            if len(out) >= size:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    def area(h: list) -> float:
        return abs(float(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(h, h[1:] + h[:1])) / 2.0)) if len(h) > 2 else 0.0

    types = {f.name: f.dataType.simpleString() for f in ends.schema.fields}
    ddl = ", ".join(f"{k} {types[k]}" for k in keys)
    n = len(keys)
    dealt = lambda df, by: df.select(*by, "x", "y").repartition(*by).sortWithinPartitions(*by, "x", "y")
    small = dealt(ends, [*keys, "_t"]).mapInPandas(lambda it: batches(((*k[:n], *q) for k, h in hulls(it, n + 1) for q in h), [*keys, "x", "y"]), f"{ddl}, x {types['x']}, y {types['y']}")
    return dealt(small, keys).mapInPandas(lambda it: batches(((*k, area(h)) for k, h in hulls(it, n)), [*keys, "hull_area"]), f"{ddl}, hull_area double")


RECOGNITION = ("schema_version int, image_size array<double>, scale_calibration struct<status:string, scale_m_per_px:double, method:string>, "
               "geometry struct<walls:array<struct<pts:array<array<double>>>>, windows:array<struct<pts:array<array<double>>>>, doors:array<struct<area:double>>>, "
               "room_topology struct<room_count:int, total_area_px2:double, load_geometry_ready:boolean>")


def recognition_flatten(df: DataFrame, column: str = "doc") -> DataFrame:
    """Recognition documents to one summary row each."""
    from thermograph.operators.drawing import polyline_length
    j = df.withColumn("_d", F.from_json(F.col(column), RECOGNITION))
    pts = lambda w: F.transform(w["pts"], lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    total = lambda path: F.coalesce(F.aggregate(F.transform(F.col(path), lambda w: polyline_length(pts(w))), F.lit(0.0), lambda a, v: a + v), F.lit(0.0))
    n = lambda path: F.coalesce(F.array_size(path), F.lit(0))
    return j.select(*[c for c in df.columns if c != column], n("_d.geometry.walls").alias("walls"), n("_d.geometry.windows").alias("windows"), n("_d.geometry.doors").alias("doors"),
                    total("_d.geometry.walls").alias("wall_px"), total("_d.geometry.windows").alias("window_px"), F.coalesce("_d.room_topology.room_count", F.lit(0)).alias("room_count"),
                    F.when(F.col("_d.scale_calibration.status") == "confirmed", F.col("_d.scale_calibration.scale_m_per_px")).alias("scale_m_per_px"), F.coalesce("_d.room_topology.load_geometry_ready", F.lit(False)).alias("ready"))


PREDICTION = "walls array<struct<id:string, points:array<array<double>>>>, openings array<struct<id:string, kind:string, points:array<array<double>>>>, rooms array<struct<id:string, polygon:array<array<double>>>>"


def vector_prediction_adapter(df: DataFrame, column: str = "doc", key: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """(lines, rooms) of prediction documents, with lengths and areas."""
    from thermograph.operators.drawing import polygon_measures, polyline_length
    d = df.select(key, F.from_json(F.col(column), PREDICTION).alias("d"))
    xy = lambda a: F.transform(a, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    line = lambda path, kind: d.select(key, F.explode(f"d.{path}").alias("l")).select(key, F.col("l.id").alias("id"), kind.alias("kind"), polyline_length(xy(F.col("l.points"))).alias("length_px"))
    lines = line("walls", F.lit("wall")).unionByName(line("openings", F.col("l.kind")))
    rooms = d.select(key, F.explode("d.rooms").alias("r")).select(key, F.col("r.id").alias("id"), polygon_measures(xy(F.col("r.polygon"))).alias("m")).select(key, "id", F.col("m.area").alias("area_px2"), F.col("m.perimeter").alias("perimeter_px"))
    return lines, rooms


def prediction_scale(df: DataFrame, column: str = "doc", measures: str = "measurements", key: str = "page_id") -> DataFrame:
    """Scale and room totals of each prediction, one row per page.

    ``measures`` holds JSON with a scale in metres per pixel; one that is
    absent, no number, zero or negative leaves the scale to be set by hand.
    """
    from thermograph.operators.drawing import polygon_measures
    d = df.select(key, F.from_json(F.col(column), PREDICTION).alias("d"), F.get_json_object(measures, "$.scale_m_per_px").try_cast("double").alias("s"))
    ok = F.col("s").isNotNull() & ~F.isnan("s") & (F.col("s") > 0) & (F.col("s") < float("inf"))
    rooms = F.coalesce("d.rooms", F.array().cast("array<struct<id:string,polygon:array<array<double>>>>"))
    xy = lambda a: F.transform(a, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    area = F.aggregate(F.transform(rooms, lambda r: polygon_measures(xy(r["polygon"]))["area"]), F.lit(0.0), lambda a, v: a + v)
    t = d.select(key, F.when(ok, F.col("s")).alias("scale_m_per_px"), F.size(rooms).cast("bigint").alias("room_count"), area.alias("total_area_px2"))
    has = F.col("scale_m_per_px").isNotNull()
    return t.select(key, F.when(has, "confirmed").otherwise("manual_required").alias("status"), F.when(has, "vector_dimensions").otherwise("raster_manual").alias("method"), "scale_m_per_px", F.when(has, 1.0).otherwise(0.0).alias("confidence"),
                    "room_count", "total_area_px2", (F.col("total_area_px2") * F.col("scale_m_per_px") * F.col("scale_m_per_px")).alias("total_area_m2"), (has & (F.col("room_count") > 0)).alias("load_geometry_ready"))
