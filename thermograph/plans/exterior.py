"""Exterior outlines: recovery, topology and checks as staged table jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thermograph.operators import drawing as D
from thermograph.operators import faces as Fc
from thermograph.operators import intervals as I
from thermograph.session import cut_lineage

LINE = ["page_id", "orientation", "fixed"]


def real_wall_segments(edges: DataFrame, walls: DataFrame, bridges: DataFrame | None = None, bucket: float = 64, staged: bool = False) -> DataFrame:
    """Stretches of polygon edges that walls cover and no bridge does, as long as the set of walls stays the same.

    ``edges``: page_id, edge_id, orientation, fixed, e0, e1; ``walls`` with
    wall_id; ``bridges`` as intervals. A sweep along each edge adds walls and
    bridges where they start and takes them off where they end; stretches lie
    between changes. Only then do they meet the walls over them. ``staged``
    runs these as steps that give their shuffles back, before it returns.
    """
    step_of = cut_lineage if staged else lambda df: df
    key = ["page_id", "edge_id"]
    w = step_of(range_clip(edges, walls, ["wall_id"], bucket))
    # Only walls that meet an edge more than once need merging; the others move once.
    w = w.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy(*key, "wall_id")))
    again = I.merge_collinear(w.filter("_n > 1").drop("_n"), [*key, "wall_id"], "s", "z").drop("n_rows")
    w = step_of(w.filter("_n = 1").drop("_n").unionByName(again))
    step = lambda f, wall, bridge: f.select(*key, F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("d")), F.struct(F.col("z").alias("at"), F.lit(-1).alias("d")))).alias("x")).select(
        *key, "x.at", (F.col("x.d") * wall).alias("walls"), (F.col("x.d") * bridge).alias("bridges"), F.lit(wall).alias("moves"))
    events = step(w, 1, 0) if bridges is None else step(w, 1, 0).unionByName(step(range_clip(edges, bridges, [], bucket), 0, 1))
    events = events.groupBy(*key, "at").agg(F.sum("walls").alias("walls"), F.sum("bridges").alias("bridges"), F.sum("moves").alias("moves")).filter("moves > 0 OR bridges <> 0")
    swept = I.running_sums(events, key, ["at"], F.floor(F.col("at") / bucket), ["walls", "bridges"], "at")
    pieces = swept.filter("walls_run > 0 AND bridges_run = 0 AND _next IS NOT NULL").select(*key, F.col("at").alias("axis_start"), F.col("_next").alias("axis_end"))
    pieces = step_of(pieces)
    over = I.range_join(pieces, w, key, (F.col("axis_start"), F.col("axis_end")), (F.col("s"), F.col("z")), bucket).filter("s <= axis_start AND axis_end <= z")
    out = over.groupBy(*key, "axis_start", "axis_end").agg(F.sort_array(F.collect_set("wall_id")).alias("source_wall_ids"))
    return out.join(edges.select(*key, "orientation", "fixed"), key)


def range_clip(edges: DataFrame, other: DataFrame, extra: list[str], bucket: float) -> DataFrame:
    j = I.range_join(edges, other.select(*LINE, "axis_start", "axis_end", *extra), LINE, (F.col("e0"), F.col("e1")), (F.col("axis_start"), F.col("axis_end")), bucket)
    return j.select("page_id", "edge_id", F.greatest("e0", "axis_start").alias("s"), F.least("e1", "axis_end").alias("z"), *extra).filter("s < z")


EVIDENCE = ["inside_mean", "outside_mean", "boundary_mean", "inside_share", "outside_share"]


def inferred_edge_checks(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Errors per page of inferred edges, groups and the share they take.

    ``edges``: page_id, inference_id, edge_group_id, edge_group_size,
    inference_type, orientation, fixed, axis_start, axis_end, length_px,
    on_boundary, anchor_ids, source_ids, decision, inside_direction,
    mean_difference and the means and shares of EVIDENCE. ``pages``: page_id,
    short_side_px, perimeter_px, calculation_only. Calculation-only closures
    skip the footprint and length tests, and their groups may have one or two
    members whatever the type. A group has as many members as it declares, all
    of one type; two members run both ways and share one corner point. Missing
    evidence counts as out of range.
    """
    c = F.col
    e = edges.join(pages, "page_id")
    strict = ~c("calculation_only")
    unit = F.forall(F.array(*EVIDENCE), lambda x: x.isNotNull() & ~F.isnan(x) & x.between(0.0, 1.0))
    ranged = F.coalesce(unit & c("mean_difference").between(-1.0, 1.0), F.lit(False))
    fits = Fc.near_equal(c("mean_difference").cast("double"), c("inside_mean") - c("outside_mean"))
    faces = F.when(c("orientation") == "horizontal", c("inside_direction").isin("up", "down")).otherwise(c("inside_direction").isin("left", "right"))
    weak = (c("inside_mean") < 0.50) | (c("mean_difference") < 0.25) | (c("boundary_mean") < 0.35)
    long_ = c("length_px") > c("short_side_px") * 0.10 + F.greatest(c("short_side_px"), F.lit(1.0)) * 2.0**-55
    own = F.filter(F.array(
        F.when(~c("on_boundary"), "edge_not_on_boundary"), F.when(~Fc.near_equal(c("length_px").cast("double"), (c("axis_end") - c("axis_start")).cast("double")), "length_mismatch"),
        F.when(strict & long_, "edge_too_long"), F.when((F.size("anchor_ids") <= 0) | (F.size(F.array_except("anchor_ids", "source_ids")) > 0), "anchor_not_a_source"),
        F.when(~c("inference_type").isin("collinear_extension", "orthogonal_corner"), "unknown_type"),
        F.when(~c("edge_group_size").isin(1, 2) | strict & (c("edge_group_size") != F.when(c("inference_type") == "collinear_extension", 1).otherwise(2)), "group_size"),
        F.when(~F.coalesce(c("decision") == "accepted_candidate", F.lit(False)), "edge_not_accepted"), F.when(~F.coalesce(faces, F.lit(False)), "invalid_inside_direction"),
        F.when(strict & ~(ranged & fits), "invalid_footprint_evidence"), F.when(strict & ranged & weak, "weak_footprint_evidence"),
        F.when(strict & ranged & (c("inside_share") < 0.80), "discontinuous_footprint_support"), F.when(strict & ranged & (c("outside_share") >= 0.50), "edge_crosses_interior")), lambda x: x.isNotNull())
    per_edge = e.select("page_id", F.explode(own).alias("error"))
    same = lambda k: F.min(k) == F.max(k)
    group = ["page_id", "edge_group_id"]
    groups = edges.groupBy(*group).agg(
        (same("edge_group_size") & same("inference_type") & (F.max("edge_group_size") == F.count(F.lit(1))) & ((F.max("edge_group_size") != 2) | (F.min("orientation") != F.max("orientation")))).alias("complete"))
    groups = groups.filter("NOT complete").select("page_id", F.lit("incomplete_group").alias("error"))
    h = c("orientation") == "horizontal"
    point = lambda a: F.struct(F.when(h, c(a)).otherwise(c("fixed")).cast("double").alias("x"), F.when(h, c("fixed")).otherwise(c(a)).cast("double").alias("y"))
    two = edges.filter("edge_group_size = 2").groupBy(*group).agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select(*group)
    ends = edges.join(two, group, "left_semi").select(*group, "inference_id", F.explode(F.array_distinct(F.array(point("axis_start"), point("axis_end")))).alias("p"))
    met = ends.groupBy(*group, "p").agg(F.countDistinct("inference_id").alias("n")).groupBy(*group).agg(F.count_if(c("n") == 2).alias("n"))
    corners = met.filter("n <> 1").select("page_id", F.lit("no_shared_corner").alias("error"))
    share = e.groupBy("page_id", "perimeter_px", "calculation_only").agg(F.sum("length_px").alias("l")).filter("NOT calculation_only AND l > perimeter_px * 0.12").select("page_id", F.lit("inferred_share_exceeded").alias("error"))
    errs = per_edge.unionByName(groups).unionByName(corners).unionByName(share).groupBy("page_id").agg(F.array_sort(F.collect_set("error")).alias("errors"))
    return pages.select("page_id").join(errs, "page_id", "left").withColumn("errors", F.coalesce("errors", F.array().cast("array<string>")))


def connected_rescue(cands: DataFrame, anchors: DataFrame) -> DataFrame:
    """Accepted structural lines that close a supported side, with direction.

    The inside faces the mean anchor midpoint of the page.
    """
    h = F.col("orientation") == "horizontal"
    mid = (F.col("axis_start") + F.col("axis_end")) / 2.0
    centre = anchors.groupBy("page_id").agg(F.avg(F.when(h, mid).otherwise(F.col("fixed"))).alias("cx"), F.avg(F.when(h, F.col("fixed")).otherwise(mid)).alias("cy"))
    fresh = cands.join(anchors.select("page_id", "seg_id"), ["page_id", "seg_id"], "left_anti")
    r = D.anchor_both_ends_semi(fresh, anchors).join(centre, "page_id")
    return r.withColumn("inside_direction", F.when(h, F.when(F.col("fixed") <= F.col("cy"), "down").otherwise("up")).otherwise(F.when(F.col("fixed") <= F.col("cx"), "right").otherwise("left"))).drop("cx", "cy")


def door_arc_recovery(walls: DataFrame, uncertain: DataFrame, curves: DataFrame, band: float = 16, reach: float = 14, min_span: float = 12, max_span: float = 140, gap: float = 12) -> dict[str, DataFrame]:
    """Chains of walls and door arcs along exterior bands.

    ``walls`` and ``uncertain``: page_id, seg_id, orientation, fixed,
    axis_start, axis_end (walls also inside_direction); ``curves``: page_id,
    curve_id, sx, sy, ex, ey, x0..y1. Returns components, confirmed recovered
    walls and the arcs with their status.
    """
    keys = ["page_id", "orientation", "inside_direction"]
    # Members and uncertain walls find their bands in steps of their own, which give their shuffles back.
    m = cut_lineage(Fc.greedy_bands(walls.select(*keys, F.col("seg_id").alias("wall_id"), "fixed"), keys, band))
    bands = cut_lineage(m.select(*keys, F.col("band_founder").alias("band_id"), F.col("band_fixed").alias("fixed")).distinct())
    anchors = walls.join(m.select("page_id", F.col("wall_id").alias("seg_id"), F.col("band_founder").alias("band_id")), ["page_id", "seg_id"]).select("page_id", "band_id", F.lit("anchor").alias("node_type"), F.col("seg_id").alias("node_id"), "axis_start", "axis_end")
    near = D.nearest_band_join(uncertain, bands, band)
    loose = uncertain.join(near.select("page_id", "seg_id", "band_id"), ["page_id", "seg_id"]).select("page_id", "band_id", F.lit("uncertain_wall").alias("node_type"), F.col("seg_id").alias("node_id"), "axis_start", "axis_end")
    loose = cut_lineage(loose)
    k = curves.filter(F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))) <= max_span)
    side = lambda o, a, b, p, q: k.select("page_id", "curve_id", F.lit(o).alias("orientation"), F.col(a).alias("c0"), F.col(b).alias("c1"), F.least(p, q).alias("axis_start"), F.greatest(p, q).alias("axis_end"))
    arcs = side("vertical", "sx", "ex", "sy", "ey").unionByName(side("horizontal", "sy", "ey", "sx", "ex")).filter((F.col("axis_end") - F.col("axis_start")).between(min_span, max_span))
    b = bands.select("page_id", "orientation", "band_id", F.col("fixed").alias("b_at"))
    j = I.range_join(arcs, b, ["page_id", "orientation"], (F.least("c0", "c1") - reach, F.greatest("c0", "c1") + reach), (F.col("b_at"), F.col("b_at")), 4 * reach)
    d = F.least(F.abs(F.col("c0") - F.col("b_at")), F.abs(F.col("c1") - F.col("b_at")))
    best = j.withColumn("d", d).filter(F.col("d") <= reach).groupBy("page_id", "curve_id").agg(F.min(F.struct("d", "band_id", "axis_start", "axis_end")).alias("m"))
    door = best.select("page_id", "m.band_id", F.lit("door_arc").alias("node_type"), F.col("curve_id").alias("node_id"), "m.axis_start", "m.axis_end")
    nodes = cut_lineage(I.with_island(anchors.unionByName(loose).unionByName(door), ["page_id", "band_id"], tol=gap, tile=256))
    comp = nodes.groupBy("page_id", "band_id", "island_start").agg(
        F.countDistinct(F.when(F.col("node_type") == "anchor", F.col("node_id"))).alias("n_anchors"), F.countDistinct(F.when(F.col("node_type") == "door_arc", F.col("node_id"))).alias("n_arcs"))
    comp = comp.filter("n_arcs > 0").withColumn("status", F.when(F.col("n_anchors") >= 2, "confirmed").when(F.col("n_anchors") == 1, "pending").otherwise("ignored"))
    st = nodes.join(comp.select("page_id", "band_id", "island_start", "status"), ["page_id", "band_id", "island_start"])
    rec = st.filter("node_type = 'uncertain_wall' AND status = 'confirmed'").select("page_id", "band_id", F.col("node_id").alias("seg_id"))
    rec = uncertain.join(rec, ["page_id", "seg_id"]).join(bands.select("page_id", "band_id", F.col("fixed").alias("band_fixed"), "inside_direction"), ["page_id", "band_id"])
    return {"components": comp, "recovered_walls": Fc.recovered_wall_rows(rec.withColumn("reason_codes", F.array().cast("array<string>"))),
            "arcs": st.filter("node_type = 'door_arc' AND status <> 'ignored'").select("page_id", F.col("node_id").alias("curve_id"), "band_id", "status")}


# -- dominant calculation envelope ------------------------------------------------

def side_intervals(walls: DataFrame, tol: float, width: float, height: float) -> DataFrame:
    """Clusters of the four sides with their covered intervals: page_id, side (top, bottom, l, r), axis_min, axis_max, s, z.

    Sides are known by the direction their walls face. Parallel walls chain
    while consecutive axes differ by at most ``tol``; clusters that cover less
    than max(8, 4 % of the span) are dropped. Intervals are closed and in whole
    units. All sides share one pass.
    """
    c = F.col
    facing = F.concat_ws(":", "orientation", "inside_direction")
    side = F.when(facing == "horizontal:down", "top").when(facing == "horizontal:up", "bottom").when(facing == "vertical:right", "l").when(facing == "vertical:left", "r")
    flat = c("side").isin("top", "bottom")
    clip = lambda x: F.least(F.when(flat, F.lit(width)).otherwise(F.lit(height)), F.greatest(F.lit(0), F.round(x))).cast("bigint")
    w = walls.withColumn("side", side).filter("side IS NOT NULL")
    w = w.select("page_id", "side", F.round("fixed").cast("bigint").alias("axis"), clip("axis_start").alias("s"), clip("axis_end").alias("z")).filter("s < z").withColumn("axis_hi", c("axis"))
    key = ["page_id", "side", "cluster"]
    cl = cut_lineage(I.with_island(w, ["page_id", "side"], "axis", "axis_hi", tol=tol).withColumnRenamed("island_start", "cluster"))
    axes = cl.groupBy(*key).agg(F.min("axis").alias("axis_min"), F.max("axis").alias("axis_max"))
    runs = cut_lineage(I.merge_collinear(cl.select(*key, "s", (c("z") + 1).alias("e")), key, "s", "e").select(*key, "s", (c("e") - 1).alias("z")))
    least = F.when(flat, max(8, round(width * 0.04))).otherwise(max(8, round(height * 0.04)))
    big = runs.groupBy(*key).agg(F.sum(c("z") - c("s") + 1).alias("n")).filter(c("n") >= least).join(axes, key).drop("n")
    return runs.join(big, key)


def fill_profile(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Nearest known value per row index ``y``; equal distances take the lower.

    ``rows``: keys, y, value (null where unknown).
    """
    from thermograph.operators.relational import forward_fill

    mark = F.when(F.col("value").isNotNull(), F.concat_ws(":", "value", "y"))
    r = rows.withColumns({"below": mark, "above": mark, "_y": -F.col("y")})
    r = forward_fill(r, keys, "y", ["below"], F.floor(F.col("y") / 4096))
    r = forward_fill(r, keys, "_y", ["above"], F.floor(F.col("_y") / 4096))
    at = lambda c, i: F.get(F.split(c, ":"), F.lit(i)).try_cast("bigint")
    low = (F.col("above") == "") | ((F.col("below") != "") & (F.col("y") - at("below", 1) <= at("above", 1) - F.col("y")))
    return r.select(*keys, "y", F.when(low, at("below", 0)).otherwise(at("above", 0)).alias("value"))


def lowest_runs(spans: DataFrame, keys: list[str], bucket: float = 64) -> DataFrame:
    """The least ``v`` over each row that a span holds, as runs: keys, y0, y1, value.

    ``spans``: keys, s, z (first and last row), v. Spans are cut where any of
    their key begins or ends, so work follows their number and not their rows.
    """
    c = F.col
    cuts = spans.select(*keys, F.explode(F.array(c("s"), c("z") + 1)).alias("y0")).distinct()
    cuts = cuts.withColumn("y1", F.lead("y0").over(W.partitionBy(*keys).orderBy("y0")) - 1).filter("y1 IS NOT NULL")
    return I.range_join(cuts, spans, keys, (c("y0"), c("y1")), (c("s"), c("z")), bucket).groupBy(*keys, "y0", "y1").agg(F.min("v").alias("value"))


def fill_runs(runs: DataFrame, frame: DataFrame, keys: list[str]) -> DataFrame:
    """As ``fill_profile`` for runs: keys, y0, y1, value without holes from ``top`` to ``bottom``.

    ``runs``: keys, y0, y1, value, apart from each other; ``frame``: keys, top,
    bottom. A hole is shared by the runs above and below it, the upper one
    taking the middle row; neighbours of equal value become one run.
    """
    c = F.col
    w = W.partitionBy(*keys).orderBy("y0")
    r = runs.join(frame, keys).withColumns({"y0": F.greatest("y0", "top"), "y1": F.least("y1", "bottom")}).filter("y0 <= y1")
    half = lambda a, z: F.floor((a + z) / 2)
    r = r.withColumns({"_a": F.lag("y1").over(w), "_z": F.lead("y0").over(w)}).select(
        *keys, F.when(c("_a").isNull(), c("top")).otherwise(half(c("_a"), c("y0")) + 1).alias("y0"), F.when(c("_z").isNull(), c("bottom")).otherwise(half(c("y1"), c("_z"))).alias("y1"), "value")
    start = F.when(F.coalesce(F.lag("value").over(w) == c("value"), F.lit(False)), None).otherwise(c("y0"))
    return r.withColumn("_s", F.last(start, ignorenulls=True).over(w)).groupBy(*keys, c("_s").alias("y0")).agg(F.max("y1").alias("y1"), F.first("value").alias("value"))


def smooth_profile(rows: DataFrame, keys: list[str], min_run: str) -> DataFrame:
    """Absorb short runs between equal neighbours, first one first.

    Rows reduce to runs of equal value before the order-dependent step.
    ``min_run`` is a column of the rows.
    """
    w = W.partitionBy(*keys).orderBy("y")
    start = F.when(F.coalesce(F.lag("value").over(w) == F.col("value"), F.lit(False)), None).otherwise(F.col("y"))
    r = rows.withColumn("_s", F.last(start, ignorenulls=True).over(w))
    return smooth_runs(r.groupBy(*keys, F.col("_s").alias("y0")).agg(F.max("y").alias("y1"), F.first("value").alias("value"), F.first(min_run).alias("min_run")), keys)


def smooth_runs(runs: DataFrame, keys: list[str]) -> DataFrame:
    """As ``smooth_profile`` for runs: keys, y0, y1, value, min_run.

    Profiles without a short run between equal neighbours stay as they are;
    a task walks at most the value changes of one of the others.
    """
    w = W.partitionBy(*keys).orderBy("y0")
    short = (F.col("y1") - F.col("y0") + 1 < F.col("min_run").cast("int")) & F.coalesce(F.lag("value").over(w).eqNullSafe(F.lead("value").over(w)) & F.lag("y0").over(w).isNotNull() & F.lead("y0").over(w).isNotNull(), F.lit(False))
    runs = runs.withColumn("_some", F.max(short).over(W.partitionBy(*keys)))

    def absorb(pdf):
        pdf = pdf.sort_values("y0")
        least = int(pdf["min_run"].iloc[0])
        seq = [list(t) for t in zip(pdf["y0"], pdf["y1"], pdf["value"])]
        i = 1
        while i < len(seq) - 1:
            a, b, c = seq[i - 1], seq[i], seq[i + 1]
            if b[1] - b[0] + 1 < least and a[2] == c[2]:
                seq[i - 1:i + 2] = [[a[0], c[1], a[2]]]
                i = max(i - 2, 1)
            else:
                i += 1
        out = type(pdf)(seq, columns=["y0", "y1", "value"])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "y0", "y1", "value"]]

    kinds = {f.name: f.dataType.simpleString() for f in runs.schema.fields}
    walked = runs.filter("_some").drop("_some").groupBy(*keys).applyInPandas(absorb, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", y0 bigint, y1 bigint, value bigint")
    return runs.filter("NOT _some").select(*keys, *[F.col(x).cast("bigint").alias(x) for x in ("y0", "y1", "value")]).unionByName(walked)


def envelope_runs(walls: DataFrame, width: float, height: float) -> DataFrame:
    """Row profiles of the dominant envelope per page: page_id, side (l, r), value, lo, hi.

    Top and bottom are the outermost horizontal clusters; left and right
    profiles follow the outermost vertical cluster of each row, filled and
    smoothed. Pages without all four sides, or with crossing profiles, have no
    runs.
    """
    tol = max(2, round(min(width, height) * 0.006))
    spans = cut_lineage(side_intervals(walls, tol, width, height))
    frame = spans.groupBy("page_id").agg(F.min(F.when(F.col("side") == "top", F.col("axis_min"))).alias("top"), F.max(F.when(F.col("side") == "bottom", F.col("axis_max"))).alias("bottom"))
    frame = frame.filter("top < bottom").withColumn("min_run", F.greatest(F.lit(3), F.rint((F.col("bottom") - F.col("top")) * 0.01).cast("int")))
    frame = cut_lineage(frame)
    key = ["page_id", "side"]
    known = lowest_runs(spans.filter("side IN ('l', 'r')").select(*key, "s", "z", F.when(F.col("side") == "l", F.col("axis_min")).otherwise(-F.col("axis_max")).alias("v")), key)
    known = known.withColumn("value", F.when(F.col("side") == "r", -F.col("value")).otherwise(F.col("value")))
    sides = frame.select("page_id", F.explode(F.array(F.lit("l"), F.lit("r"))).alias("side"), "top", "bottom")
    filled = cut_lineage(fill_runs(known, sides, key))
    one = lambda side, n: filled.filter(F.col("side") == side).select("page_id", F.col("y0").alias(f"{n}0"), F.col("y1").alias(f"{n}1"), F.col("value").alias(n))
    whole = filled.groupBy("page_id").agg(F.countDistinct("side").alias("n")).filter("n = 2").select("page_id")
    crossing = I.range_join(one("l", "l"), one("r", "r"), ["page_id"], (F.col("l0"), F.col("l1")), (F.col("r0"), F.col("r1")), 256).filter("l >= r").select("page_id").distinct()
    runs = smooth_runs(filled.join(frame.select("page_id", "min_run"), "page_id"), key).join(frame.select("page_id", "top", "bottom"), "page_id")
    # a right run holds from its first row on, a left run up to its last row
    lo = F.when(F.col("side") == "r", F.col("y0")).otherwise(F.greatest(F.col("y0") - 1, F.col("top")))
    hi = F.when(F.col("side") == "r", F.least(F.col("y1") + 1, F.col("bottom"))).otherwise(F.col("y1"))
    return runs.join(whole, "page_id", "left_semi").join(crossing, "page_id", "left_anti").select("page_id", "side", "value", lo.alias("lo"), hi.alias("hi"))
