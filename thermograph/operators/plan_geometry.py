"""Pixel measurements to metric building geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermograph.functions.numbers import finite


def two_point_scale(df: DataFrame) -> DataFrame:
    """Metres per pixel from two marked points and their real distance.

    Columns ``ax, ay, bx, by, actual_length, unit, width, height``; a row that
    fails a check gets a null scale and the names of the failed checks.
    """
    inside = lambda x, y: (x >= 0) & (y >= 0) & (x < F.col("width")) & (y < F.col("height"))
    pts_ok = inside(F.col("ax"), F.col("ay")) & inside(F.col("bx"), F.col("by"))
    dist = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    unit = F.lower("unit")
    length_m = F.when(unit == "mm", F.col("actual_length") / 1000.0).otherwise(F.col("actual_length"))
    errors = F.filter(F.array(
        F.when(~pts_ok, "point_outside_image"), F.when(dist <= 0, "points_equal"),
        F.when(~(finite(F.col("actual_length")) & (F.col("actual_length") > 0)), "length_not_positive"),
        F.when(~unit.isin("m", "mm"), "unknown_unit")), lambda e: e.isNotNull())
    return df.withColumns({"pixel_distance": dist, "errors": errors}).withColumn(
        "scale_m_per_px", F.when(F.size("errors") == 0, length_m / F.col("pixel_distance")))


def exterior_to_areas(topology: DataFrame, openings: DataFrame) -> DataFrame:
    """Net opaque wall, door and window areas per page.

    ``topology``: page_id, area_px2, perimeter_px, scale, storey_height,
    floors, door_height, window_height, door_repeat, window_repeat.
    ``openings``: page_id, kind, width_px. Opening widths combine map-side.
    """
    widths = openings.groupBy("page_id").agg(
        F.sum(F.when(F.col("kind") == "door", F.col("width_px")).otherwise(0.0)).alias("door_px"),
        F.sum(F.when(F.col("kind") == "window", F.col("width_px")).otherwise(0.0)).alias("window_px"),
        F.max((~F.col("kind").isin("door", "window")) | ~(F.col("width_px") > 0)).alias("bad_opening"))
    t = topology.join(widths, "page_id", "left").withColumns({
        "door_width_m": F.coalesce("door_px", F.lit(0.0)) * F.col("scale"),
        "window_width_m": F.coalesce("window_px", F.lit(0.0)) * F.col("scale"),
        "footprint_m2": F.col("area_px2") * F.col("scale") * F.col("scale"),
        "perimeter_m": F.col("perimeter_px") * F.col("scale"),
    })
    t = t.withColumns({
        "gross_wall_m2": F.col("perimeter_m") * F.col("storey_height") * F.col("floors"),
        "door_area_m2": F.col("door_width_m") * F.col("door_height") * F.col("door_repeat"),
        "window_area_m2": F.col("window_width_m") * F.col("window_height") * F.col("window_repeat"),
        "total_floor_area_m2": F.col("footprint_m2") * F.col("floors"),
    })
    net = F.col("gross_wall_m2") - F.col("door_area_m2") - F.col("window_area_m2")
    error = (F.when(~((F.col("area_px2") > 0) & (F.col("perimeter_px") > 0) & (F.col("scale") > 0)), "invalid_topology")
             .when(F.col("bad_opening"), "invalid_opening")
             .when((F.col("door_repeat") > F.col("floors")) | (F.col("window_repeat") > F.col("floors")), "repeat_exceeds_floors")
             .when(net < 0, "openings_exceed_wall"))
    return t.withColumn("error", error).withColumn("wall_area_m2", F.when(F.col("error").isNull(), net)).drop(
        "door_px", "window_px", "bad_opening")


def scale_rooms(rooms: DataFrame, pages: DataFrame) -> DataFrame:
    """Room areas in m2; an absent or non-positive scale never invents one."""
    scale = F.when(finite(F.col("scale")) & (F.col("scale") > 0), F.col("scale"))
    return rooms.join(pages.select("page_id", scale.alias("scale")), "page_id", "left").withColumn(
        "area_m2", F.col("area_px2") * F.col("scale") * F.col("scale"))


def room_totals(rooms: DataFrame) -> DataFrame:
    return rooms.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("room_count"), F.sum("area_px2").alias("total_area_px2"))


def room_readiness(totals: DataFrame, pages: DataFrame) -> DataFrame:
    """Total m2 and whether loads may use it; repair flags veto.

    ``pages``: page_id, scale, manual_exterior_wall_required, closure_status.
    """
    ok = finite(F.col("scale")) & (F.col("scale") > 0)
    veto = F.coalesce(F.col("manual_exterior_wall_required"), F.lit(False)) | F.coalesce(
        F.col("closure_status").isin("partial", "failed"), F.lit(False))
    return pages.join(totals, "page_id", "left").withColumns({
        "room_count": F.coalesce("room_count", F.lit(0)),
        "total_area_m2": F.when(ok, F.coalesce("total_area_px2", F.lit(0.0)) * F.col("scale") * F.col("scale")),
    }).withColumn("load_geometry_ready", ok & (F.col("room_count") > 0) & ~veto)


def already_closed(rooms: DataFrame, roi: DataFrame) -> DataFrame:
    """Rooms fill at least 20 % of the region and the largest 8 %."""
    agg = rooms.groupBy("page_id").agg(F.sum("area_px2").alias("total_px2"), F.max("area_px2").alias("largest_px2"))
    return roi.join(agg, "page_id", "left").withColumn(
        "already_closed", (F.coalesce("total_px2", F.lit(0.0)) >= F.col("roi_area") * 0.20)
        & (F.coalesce("largest_px2", F.lit(0.0)) >= F.col("roi_area") * 0.08))
