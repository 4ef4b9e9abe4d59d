"""Exterior topology with evidence: bridges, closed faces and a chain of closures.

Evidence stays in long form. Walls, bridges and inferred edges merge into lines;
every line keeps the (kind, id) rows of its parts, faces take those of the lines
they run along, and decisions about a face only ever read its rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thermograph.operators import drawing as D
from thermograph.operators import faces as Fc
from thermograph.operators import intervals as I
from thermograph.plans import exterior as X
from thermograph.session import cut_lineage

c = F.col
LINE = ["page_id", "orientation", "fixed"]
FACE = ["page_id", "face"]
CLOSED, OPEN, AMBIGUOUS, NO_WALLS = "review_required", "exterior_not_closed", "ambiguous_exterior", "no_exterior_wall_evidence"
#: Repairs that stay only where a supported face uses them, and what their gap is told otherwise.
UNUSED = {"small_gap_repair": "gap_does_not_close_supported_exterior", "pending_opening_bridge": "pending_opening_does_not_close_supported_exterior"}
FOOTPRINT_MEAN, INFERRED_SHARE, RIVAL_AREA = 0.5, 0.12, 0.90


def bridges_of(gaps: DataFrame, openings: DataFrame, pending: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bridges, unresolved) of all gaps.

    ``gaps``: page_id, gap_id, orientation, fixed, gap_start, gap_end, host_ids,
    decision; ``openings`` and ``pending`` the same geometry and hosts with
    opening_id; ``pages`` with image_w, image_h and a nullable scale. A gap
    without a strict axis keeps no bridge.
    """
    g = D.gap_opening_match(gaps, openings).withColumnsRenamed({"n_openings": "_n", "opening_id": "_opening"}).drop("match")
    g = D.gap_opening_match(g, pending).withColumnsRenamed({"n_openings": "n_pending", "opening_id": "pending_id"}).withColumnsRenamed({"_n": "n_openings", "_opening": "opening_id"})
    g = g.join(pages.select("page_id", "image_w", "image_h", "scale"), "page_id").withColumn("width_px", (c("gap_end") - c("gap_start")).cast("double"))
    b = D.bridge_decision(g)
    axis = c("orientation").isin("horizontal", "vertical") & (c("gap_start") < c("gap_end"))
    corner = (c("decision") == "accepted_gap") & ~F.coalesce(axis, F.lit(False))
    b = cut_lineage(b.withColumns({"bridge": F.when(corner, "unresolved").otherwise(c("bridge")), "bridge_reason": F.when(corner, "corner_gap_requires_turn").otherwise(c("bridge_reason"))}))
    bridges = b.filter("bridge <> 'unresolved'").select(
        "page_id", F.concat(F.lit("bridge:"), "gap_id").alias("bridge_id"), c("bridge").alias("bridge_type"), "orientation", "fixed", c("gap_start").alias("axis_start"), c("gap_end").alias("axis_end"), "gap_id",
        F.when(c("bridge") == "opening_bridge", c("opening_id")).alias("opening_id"), F.when(c("bridge") == "pending_opening_bridge", c("pending_id")).alias("pending_id"), c("bridge_reason").alias("reason"))
    return bridges, b.filter("bridge = 'unresolved'").select("page_id", "gap_id", c("bridge_reason").alias("reason"))


def complete_candidates(inferred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, reasons): accepted inferred edges of whole groups, and why others of a page were left out.

    An id that stands for several accepted edges counts once, by its least geometry.
    """
    ok = inferred.filter("decision = 'accepted_candidate'")
    axis = c("orientation").isin("horizontal", "vertical") & (c("axis_start") < c("axis_end")) & c("inference_id").isNotNull()
    good = ok.filter(axis).withColumn("_n", F.row_number().over(W.partitionBy("page_id", "inference_id").orderBy("orientation", "fixed", "axis_start", "axis_end")))
    one = good.filter("_n = 1").drop("_n")
    whole = one.groupBy("page_id", "edge_group_id").agg(((F.countDistinct("edge_group_size") == 1) & (F.max("edge_group_size") == F.count(F.lit(1)))).alias("_whole"), F.count(F.lit(1)).alias("members"))
    one = cut_lineage(one.join(whole, ["page_id", "edge_group_id"]))
    why = lambda df, reason: df.select("page_id", F.lit(reason).alias("reason"))
    reasons = why(ok.filter(~F.coalesce(axis, F.lit(False))), "invalid_inferred_edge_geometry").unionByName(why(good.filter("_n > 1"), "duplicate_or_invalid_inference_id")).unionByName(
        why(one.filter("NOT _whole"), "incomplete_inferred_edge_group")).distinct()
    return one.filter("_whole").drop("_whole"), reasons


def evidence_faces(parts: DataFrame, cells: DataFrame, pages: DataFrame, bucket: float = 64) -> dict[str, DataFrame]:
    """Faces of merged lines inside the page region, with the evidence of their boundary.

    ``parts``: LINE, axis_start, axis_end, kind, id. Returns ``faces`` (page_id,
    face, area, perimeter, real_wall_length, supported), ``edges``, ``evidence``
    (page_id, face, kind, id) of supported faces and ``parted`` pages, whose
    faces belong to several graph parts or lie in each other.
    """
    n = I.with_island(parts, LINE).withColumn("seg_id", F.xxhash64(*LINE, "island_start"))
    n = cut_lineage(n)
    lines = n.groupBy("seg_id", *LINE, "island_start").agg(F.max("axis_end").alias("axis_end")).withColumnRenamed("island_start", "axis_start")
    evidence = n.select("page_id", "seg_id", "kind", "id").distinct()
    e = cut_lineage(Fc.face_edges(lines, bucket, carry=True))
    faces = Fc.face_measures(e).join(pages.select("page_id", "left", "top", "right", "bottom"), "page_id").filter("x_min >= left AND x_max <= right AND y_min >= top AND y_max <= bottom").drop("left", "top", "right", "bottom")
    own = cut_lineage(e.join(faces.select(*FACE), FACE, "left_semi"))
    node = lambda x, y: F.struct(c(x).alias("x"), c(y).alias("y"))
    # One face alone is in one part and in no other.
    several = cut_lineage(faces.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("page_id"))
    of_several = lambda df: df.join(several, "page_id", "left_semi")
    part = Fc.connected_components(of_several(e).select("page_id", node("x0", "y0").alias("u"), node("x1", "y1").alias("v")), ["page_id"])
    split = of_several(own).groupBy(*FACE).agg(F.min(node("x0", "y0")).alias("u")).join(part, ["page_id", "u"]).groupBy("page_id").agg(F.countDistinct("component").alias("n")).filter("n > 1").select("page_id")
    nested = Fc.nested_outlines(of_several(own).select("page_id", c("face").alias("poly_id"), "x0", "y0", "x1", "y1")).select("page_id")
    mean = Fc.face_footprint_mean(own.select("page_id", c("face").alias("face_id"), "x0", "y0", "x1", "y1"), cells).select("page_id", c("face_id").alias("face"), "mean")
    wall = evidence.filter("kind = 'wall'").select("page_id", "seg_id").distinct().withColumn("_wall", F.lit(True))
    step = F.abs(c("x1") - c("x0")) + F.abs(c("y1") - c("y0"))
    real = own.join(wall, ["page_id", "seg_id"]).groupBy(*FACE).agg(F.sum(step).cast("double").alias("real_wall_length"))
    faces = faces.join(mean, FACE, "left").join(real, FACE, "left").withColumns({"supported": F.coalesce(c("mean") >= FOOTPRINT_MEAN, F.lit(False)), "real_wall_length": F.coalesce("real_wall_length", F.lit(0.0))})
    faces = cut_lineage(faces)
    along = own.join(faces.filter("supported").select(*FACE), FACE, "left_semi").select(*FACE, "seg_id").distinct()
    return {"faces": faces, "edges": own, "evidence": cut_lineage(along.join(evidence, ["page_id", "seg_id"]).select(*FACE, "kind", "id").distinct()), "parted": split.unionByName(nested).distinct()}


def judge_inferred(faces: DataFrame, evidence: DataFrame, candidates: DataFrame, calculation_only: bool) -> tuple[DataFrame, DataFrame]:
    """(accepted faces with their measures of inference, reasons per page of the others).

    A face must use an inferred edge, every edge of each group it touches, and
    take no more than INFERRED_SHARE of its perimeter from them, unless the
    closure is for calculation only.
    """
    used = evidence.filter("kind = 'inferred'").join(candidates.withColumn("id", c("inference_id").cast("string")), ["page_id", "id"])
    groups = used.groupBy(*FACE, "edge_group_id").agg((F.count(F.lit(1)) < F.max("members")).alias("_part"))
    part = groups.filter("_part").select(*FACE).distinct().withColumn("_part", F.lit(True))
    m = used.groupBy(*FACE).agg(F.sum(c("axis_end") - c("axis_start")).cast("double").alias("inferred_length"), F.count(F.lit(1)).alias("n_inferred"), F.avg(F.coalesce("mean_difference", F.lit(0.0))).alias("mean_difference"))
    j = faces.join(m, FACE, "left").join(part, FACE, "left").withColumn("inferred_ratio", c("inferred_length") / c("perimeter"))
    long_ = F.lit(False) if calculation_only else F.coalesce(c("inferred_ratio") > INFERRED_SHARE, F.lit(False))
    j = cut_lineage(j.withColumn("_r", F.array_compact(F.array(F.when(c("_part"), "incomplete_inferred_edge_group"), F.when(long_, "inferred_perimeter_ratio_exceeded")))))
    ok = (F.size("_r") == 0) & c("n_inferred").isNotNull()
    return j.filter(ok).drop("_part", "_r"), j.filter(~ok).select("page_id", F.explode("_r").alias("reason")).distinct()


def exterior_topology(walls: DataFrame, bridges: DataFrame, unresolved: DataFrame, cells: DataFrame, pages: DataFrame, inferred: DataFrame | None = None, calculation_only: bool = False) -> dict[str, DataFrame]:
    """The outline of every page of ``pages`` and what it rests on.

    ``walls``: LINE, axis_start, axis_end, wall_id; ``bridges`` and
    ``unresolved`` as of ``bridges_of``; ``cells``: page_id, x, y, value, or
    page_id, y, x0, step, values (a row of a grid);
    ``pages``: page_id, left, top, right, bottom, scale. With ``inferred``
    (inference_id, edge_group_id, edge_group_size, LINE, axis_start, axis_end,
    decision, mean_difference) only faces that inferred edges close are taken.

    Returns ``pages`` (page_id, status, measures, unresolved count, reasons),
    ``evidence`` (page_id, kind, id) of the chosen outlines, ``bridges`` that
    stay, ``unresolved`` gaps, ``real_walls`` and ``outline`` edges.
    """
    parts = walls.select(*LINE, "axis_start", "axis_end", F.lit("wall").alias("kind"), c("wall_id").cast("string").alias("id"))
    named = lambda df, kind, key: df.select(*LINE, "axis_start", "axis_end", F.lit(kind).alias("kind"), c(key).cast("string").alias("id"))
    parts = parts.unionByName(named(bridges, "bridge", "bridge_id"))
    reasons = pages.select("page_id", F.lit(None).cast("string").alias("reason")).limit(0)
    if inferred is not None:
        candidates, reasons = complete_candidates(inferred)
        parts = parts.unionByName(named(candidates, "inferred", "inference_id"))
    # Without a wall there is nothing to close.
    parts = parts.join(walls.select("page_id").distinct(), "page_id", "left_semi")
    f = evidence_faces(parts, cells, pages)
    faces = f["faces"].filter("supported")
    fx, fy = c("face.x0"), c("face.y0")
    if inferred is None:
        order = [c("area").desc(), fx, fy, c("face.heading")]
        rival = c("area2") >= c("area") * RIVAL_AREA
    else:
        faces, more = judge_inferred(faces, f["evidence"], candidates, calculation_only)
        reasons = reasons.unionByName(more)
        order = ["inferred_length", "n_inferred", c("mean_difference").desc(), (c("real_wall_length") / c("perimeter")).desc(), fx, fy, c("face.heading")]
        rival = F.lit(False) if calculation_only else c("length2") <= c("inferred_length") + F.greatest(F.lit(8.0), c("perimeter") * 0.02)
    w = W.partitionBy("page_id").orderBy(*order)
    ranked = faces.withColumns({"_n": F.row_number().over(w), "area2": F.lead("area").over(w)} | ({"length2": F.lead("inferred_length").over(w)} if inferred is not None else {}))
    top = cut_lineage(ranked.filter("_n = 1").withColumn("rival", F.coalesce(rival, F.lit(False))))
    parted = f["parted"].withColumn("parted", F.lit(inferred is None))
    some = walls.select("page_id").distinct().withColumn("walled", F.lit(True))
    j = pages.select("page_id", "scale").join(some, "page_id", "left").join(parted, "page_id", "left").join(top, "page_id", "left")
    status = F.when(c("walled").isNull(), NO_WALLS).when(c("parted"), AMBIGUOUS).when(c("face").isNull(), OPEN).when(c("rival"), AMBIGUOUS).otherwise(CLOSED)
    j = j.withColumn("status", status)
    closed = c("status") == CLOSED
    if inferred is not None:
        reasons = reasons.unionByName(j.filter(c("rival") & (c("status") == AMBIGUOUS)).select("page_id", F.lit("competing_inferred_exterior").alias("reason")))
    # Repairs count as used when any face that could have been chosen runs along them.
    used = f["evidence"].join(faces.select(*FACE), FACE, "left_semi").filter("kind = 'bridge'").select("page_id", c("id").alias("bridge_id")).distinct()
    idle = bridges.filter(c("bridge_type").isin(list(UNUSED))).join(used, ["page_id", "bridge_id"], "left_anti").join(pages.select("page_id"), "page_id", "left_semi")
    idle = cut_lineage(idle)
    told = F.element_at(F.create_map(*[F.lit(x) for kv in UNUSED.items() for x in kv]), c("bridge_type"))
    rest = cut_lineage(unresolved.join(pages.select("page_id"), "page_id", "left_semi").unionByName(idle.select("page_id", "gap_id", told.alias("reason"))))
    kept = bridges.join(pages.select("page_id"), "page_id", "left_semi").join(idle.select("page_id", "bridge_id"), ["page_id", "bridge_id"], "left_anti")
    chosen = cut_lineage(j.filter(closed).select(*FACE))
    mine = f["evidence"].join(chosen, FACE, "left_semi").select("page_id", "kind", "id")
    links = kept.join(mine.filter("kind = 'bridge'").select("page_id", c("id").alias("bridge_id")), ["page_id", "bridge_id"], "left_semi")
    mine = cut_lineage(mine.unionByName(links.filter("opening_id IS NOT NULL").select("page_id", F.lit("opening").alias("kind"), c("opening_id").cast("string").alias("id"))).unionByName(
        links.filter("pending_id IS NOT NULL").select("page_id", F.lit("pending").alias("kind"), c("pending_id").cast("string").alias("id"))).distinct())
    h = c("x0") != c("x1")
    sides = f["edges"].join(chosen, FACE, "left_semi").select("page_id", "heading", F.when(h, "horizontal").otherwise("vertical").alias("orientation"), F.when(h, c("y0")).otherwise(c("x0")).alias("fixed"),
                                                            F.when(h, F.least("x0", "x1")).otherwise(F.least("y0", "y1")).alias("axis_start"), F.when(h, F.greatest("x0", "x1")).otherwise(F.greatest("y0", "y1")).alias("axis_end"))
    outline = I.merge_collinear(sides, ["page_id", "heading", "orientation", "fixed"]).select(*LINE, F.concat_ws(":", "heading", "fixed", "axis_start").alias("edge_id"), c("axis_start").alias("e0"), c("axis_end").alias("e1"))
    outline = cut_lineage(outline)
    real = X.real_wall_segments(outline, walls, links.select(*LINE, "axis_start", "axis_end"))
    why = reasons.groupBy("page_id").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))
    open_gaps = rest.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_unresolved"))
    out = j.join(why, "page_id", "left").join(open_gaps, "page_id", "left")
    num = lambda x: F.when(closed, c(x).cast("double"))
    zero = F.lit(0.0)
    measures = [num("area").alias("area"), num("perimeter").alias("perimeter"), (num("area") * c("scale") * c("scale")).alias("area_m2"), (num("perimeter") * c("scale")).alias("perimeter_m"),
                F.when(closed, c("inferred_length") if inferred is not None else zero).alias("inferred_length")]
    method = F.lit(None).cast("string") if inferred is None else F.when(closed, F.lit("calculation_only_endpoint_link" if calculation_only else "footprint_guided_inference"))
    out = out.select("page_id", "status", *measures, method.alias("closure_method"), F.coalesce("n_unresolved", F.lit(0)).alias("n_unresolved"), F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons"))
    return {"pages": cut_lineage(out), "evidence": mine, "bridges": kept, "unresolved": rest, "real_walls": real, "outline": outline}


# -- dominant envelope ---------------------------------------------------------------

def envelope_outline(runs: DataFrame) -> DataFrame:
    """Outline edges of row profiles: page_id, pos, orientation, fixed, e0, e1, inside_direction and the edge's first point (x, y).

    ``runs``: page_id, side (l, r), value, lo, hi (rows the run holds), in
    order along each side. Runs without height bound no edge. Edges go down
    the right side and up the left one.
    """
    w = W.partitionBy("page_id", "side").orderBy("lo")
    r = runs.filter("hi > lo").withColumns({"prev": F.lag("value").over(w), "next": F.lead("value").over(w), "k": F.row_number().over(w)})
    ends = r.groupBy("page_id").agg(*[F.max(F.when((c("side") == s) & c(n).isNull(), c("value"))).alias(f"{s}_{a}") for s in "lr" for n, a in (("prev", "top"), ("next", "bottom"))],
                                    F.min("lo").alias("top"), F.max("hi").alias("bottom"))
    right = c("side") == "r"
    pos = lambda n: F.struct(F.when(right, 0).otherwise(1).alias("s"), F.when(right, c("k") * 2 + n).otherwise(-(c("k") * 2) - n).alias("k"))
    vertical = r.select("page_id", pos(0).alias("pos"), F.lit("vertical").alias("orientation"), c("value").alias("fixed"), c("lo").alias("e0"), c("hi").alias("e1"), F.when(right, "left").otherwise("right").alias("inside_direction"),
                        c("value").alias("x"), F.when(right, c("lo")).otherwise(c("hi")).alias("y"))
    wider = F.when(right, c("value") > c("prev")).otherwise(c("value") < c("prev"))
    steps = r.filter("prev IS NOT NULL AND prev <> value").select("page_id", pos(-1).alias("pos"), F.lit("horizontal").alias("orientation"), c("lo").alias("fixed"), F.least("prev", "value").alias("e0"), F.greatest("prev", "value").alias("e1"),
                                                                  F.when(wider, "down").otherwise("up").alias("inside_direction"), F.when(right, c("prev")).otherwise(c("value")).alias("x"), c("lo").alias("y"))
    at = lambda s, k: F.struct(F.lit(s).alias("s"), F.lit(k).alias("k"))
    cap = lambda row, a, z, x, s, k, d: ends.select("page_id", at(s, k).alias("pos"), F.lit("horizontal").alias("orientation"), c(row).alias("fixed"), c(a).alias("e0"), c(z).alias("e1"), F.lit(d).alias("inside_direction"), c(x).alias("x"), c(row).alias("y"))
    caps = cap("top", "l_top", "r_top", "l_top", -1, 0, "down").unionByName(cap("bottom", "l_bottom", "r_bottom", "r_bottom", 0, 2**30, "up"))
    return vertical.unionByName(steps).unionByName(caps)


def calculation_envelope(walls: DataFrame, openings: DataFrame, width: float, height: float) -> dict[str, DataFrame]:
    """The dominant envelope of each page, for area and perimeter only.

    ``walls``: LINE, axis_start, axis_end, inside_direction, wall_id;
    ``openings``: LINE, gap_start, gap_end, opening_id, host_ids. The outline
    follows the row profiles of ``exterior.envelope_runs``. Walls lying on it
    are its sources, openings on it with such hosts bridge it, and what neither
    covers is inferred. Pages without a source or an inferred edge stay open.
    Returns ``pages``, ``outline``, ``evidence``, ``bridges`` and ``inferred``.
    """
    walls = cut_lineage(walls.select(*LINE, "axis_start", "axis_end", "inside_direction", "wall_id"))
    runs = X.envelope_runs(walls, width, height)
    outline = cut_lineage(envelope_outline(runs).withColumn("edge_id", F.concat_ws(":", "pos.s", "pos.k")))
    edges = outline.select(*LINE, "edge_id", "e0", "e1")
    real = cut_lineage(X.real_wall_segments(edges, walls))
    source = cut_lineage(real.select("page_id", F.explode("source_wall_ids").alias("wall_id")).distinct())
    on = I.range_join(openings.filter("size(host_ids) > 0"), edges, LINE, (c("gap_start"), c("gap_end")), (c("e0"), c("e1")), 64).filter("e0 <= gap_start AND gap_end <= e1").dropDuplicates(["page_id", "opening_id"])
    hosts = on.select("page_id", "opening_id", F.explode(F.array_distinct("host_ids")).alias("wall_id"))
    strange = hosts.join(source, ["page_id", "wall_id"], "left_anti").select("page_id", "opening_id").distinct()
    bridges = cut_lineage(on.join(strange, ["page_id", "opening_id"], "left_anti").select(*LINE, c("gap_start").alias("axis_start"), c("gap_end").alias("axis_end"), "opening_id"))
    cover = real.select("page_id", "edge_id", "axis_start", "axis_end").unionByName(X.range_clip(edges, bridges, [], 64).select("page_id", "edge_id", c("s").alias("axis_start"), c("z").alias("axis_end")))
    bare = I.coverage_complement(edges.select("page_id", "edge_id", "e0", "e1"), cover, ["page_id", "edge_id"])
    inferred = bare.join(outline.select("page_id", "edge_id", "orientation", "fixed", "inside_direction"), ["page_id", "edge_id"])
    inferred = cut_lineage(inferred.select(*LINE, "edge_id", c("gap_start").alias("axis_start"), c("gap_end").alias("axis_end"), "inside_direction").join(source.select("page_id").distinct(), "page_id", "left_semi"))
    corner = F.struct("pos", "x", "y")
    shape = outline.groupBy("page_id").agg(F.sort_array(F.collect_list(corner)).alias("p"), F.sum(c("e1") - c("e0")).cast("double").alias("perimeter"),
                                            F.sum(F.when(c("orientation") == "vertical", c("fixed") * (c("e1") - c("e0")) * F.when(c("pos.s") == 0, 1).otherwise(-1)).otherwise(0)).cast("double").alias("area"))
    length = inferred.groupBy("page_id").agg(F.sum(c("axis_end") - c("axis_start")).cast("double").alias("inferred_length"))
    points = F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))
    closed = c("inferred_length").isNotNull() & (c("area") > 0)
    out = walls.select("page_id").distinct().join(shape, "page_id", "left").join(length, "page_id", "left").withColumn("_ok", F.coalesce(closed, F.lit(False)))
    out = out.select("page_id", F.when(c("_ok"), CLOSED).otherwise(OPEN).alias("status"), *[F.when(c("_ok"), c(x)).alias(x) for x in ("area", "perimeter", "inferred_length")], F.when(c("_ok"), points).alias("points"))
    out = cut_lineage(out)
    good = out.filter(c("status") == CLOSED).select("page_id")
    keep = lambda df: df.join(good, "page_id", "left_semi")
    evidence = keep(source).select("page_id", F.lit("wall").alias("kind"), c("wall_id").cast("string").alias("id")).unionByName(keep(bridges).select("page_id", F.lit("opening").alias("kind"), c("opening_id").cast("string").alias("id")))
    return {"pages": out, "outline": keep(outline), "evidence": evidence, "bridges": keep(bridges), "inferred": keep(inferred)}


# -- chain of closures ---------------------------------------------------------------

def fallback_chain(pages: DataFrame, stages: list[tuple[str, str, Callable[[DataFrame], DataFrame]]]) -> tuple[DataFrame, DataFrame]:
    """(result, tries): the last closure that helped each page, and every try with its reasons.

    A stage is (name, SQL condition, function). It sees the pages whose result
    so far meets the condition and returns page_id, status, reasons and
    measures. A closed page replaces what the page had; the first stage's
    result stays otherwise.
    """
    name, _, first = stages[0]
    state = cut_lineage(first(pages).withColumn("stage", F.lit(name)))
    tries = state.select("page_id", "stage", "status", "reasons")
    for name, condition, stage in stages[1:]:
        rest = pages.join(state.filter(condition).select("page_id"), "page_id", "left_semi")
        got = cut_lineage(stage(cut_lineage(rest)).withColumn("stage", F.lit(name)))
        tries = tries.unionByName(got.select("page_id", "stage", "status", "reasons"))
        won = got.filter(c("status") == CLOSED)
        state = cut_lineage(won.unionByName(state.join(won.select("page_id"), "page_id", "left_anti"), allowMissingColumns=True))
    return state, tries


def close_pages(walls: DataFrame, gaps: DataFrame, openings: DataFrame, pending: DataFrame, inferred: DataFrame, cells: DataFrame, pages: DataFrame, width: float, height: float) -> dict[str, DataFrame]:
    """Every page closed by the first of four means that can.

    Walls and bridges; inferred edges; endpoint links for calculation only;
    the dominant envelope, which also replaces outlines with unresolved gaps.
    Inputs as of ``bridges_of``, ``exterior_topology`` and
    ``calculation_envelope``; ``inferred`` also has reason_codes. Returns
    ``pages``, ``tries`` and ``evidence`` (with the stage it belongs to).
    """
    bridges, unresolved = bridges_of(gaps, openings, pending, pages)
    found: dict[str, DataFrame] = {}
    near = lambda df, some: df.join(some.select("page_id"), "page_id", "left_semi")

    def graph(stage: str, candidates: Callable[[DataFrame], DataFrame] | None, calculation_only: bool = False):
        def run(some: DataFrame) -> DataFrame:
            t = exterior_topology(near(walls, some), near(bridges, some), unresolved, cells, some, candidates(some) if candidates else None, calculation_only)
            found[stage] = t["evidence"]
            return t["pages"]
        return run

    def envelope(some: DataFrame) -> DataFrame:
        t = calculation_envelope(near(walls, some), near(openings, some), width, height)
        found["envelope"] = t["evidence"]
        out = some.select("page_id", "scale").join(t["pages"], "page_id", "left")
        m = lambda x, n: (c(x) * c("scale") if n == 1 else c(x) * c("scale") * c("scale")).alias(f"{x}_m" if n == 1 else f"{x}_m2")
        return out.select("page_id", F.coalesce("status", F.lit(OPEN)).alias("status"), "area", "perimeter", m("area", 2), m("perimeter", 1), "inferred_length", F.lit("calculation_only_endpoint_link").alias("closure_method"),
                          F.lit(0).cast("bigint").alias("n_unresolved"), F.array().cast("array<string>").alias("reasons"))

    accepted = inferred.filter("decision = 'accepted_candidate'").select("page_id").distinct()
    state, tries = fallback_chain(pages, [
        ("walls", "", graph("walls", None)),
        ("inference", f"status = '{OPEN}'", lambda some: graph("inference", lambda p: near(inferred, p))(cut_lineage(some.join(accepted, "page_id", "left_semi")))),
        ("endpoint_links", f"status = '{OPEN}'", graph("endpoint_links", lambda p: D.relax_endpoint_groups(near(inferred, p)), True)),
        ("envelope", f"status <> '{CLOSED}' OR n_unresolved > 0", envelope)])
    evidence = None
    for stage, rows in found.items():
        rows = rows.withColumn("stage", F.lit(stage))
        evidence = rows if evidence is None else evidence.unionByName(rows)
    return {"pages": state, "tries": tries, "evidence": evidence.join(state.filter(c("status") == CLOSED).select("page_id", "stage"), ["page_id", "stage"], "left_semi")}
