"""Annual degree-day balance, one scenario per row, all column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermograph.functions import climate as dims
from thermograph.functions.stages import add_columns
from thermograph.functions.tables import constant_table, sql_literal
from thermograph.operators.envelope import normalize_detailed_envelope, with_detailed_loads

HOURS_PER_YEAR = 8760.0
AIR_HEAT = 0.335  # W per (m3/h) and K


def _lookup(df: DataFrame, table: DataFrame, key: str, id_col: str, default_row: dict) -> DataFrame:
    """Left join to a constant dimension; unknown keys take the default row."""
    values = [c for c in table.columns if c != id_col]
    t = table.selectExpr(f"{id_col} AS _dim_id", "true AS _hit", *[f"{c} AS _dim_{c}" for c in values])
    joined = df.join(F.broadcast(t), F.expr(f"{key} = _dim_id"), "left")
    kinds = {f.name: f.dataType.simpleString() for f in table.schema.fields}
    return joined.selectExpr(*df.columns, *[
        f"CASE WHEN _hit THEN _dim_{c} ELSE CAST({sql_literal(default_row[c])} AS {kinds[c]}) END AS {c}" for c in values])


def _row(rows, columns, key) -> dict:
    return next(dict(zip(columns, r)) for r in rows if r[0] == key)


def with_climate(df: DataFrame, city: str = "climate.city_id") -> DataFrame:
    """City climate; an unknown or missing city falls back to the default."""
    return _lookup(df, dims.climate_table(df.sparkSession), city, "city_id",
                   _row(dims.CLIMATE, dims.CLIMATE_COLUMNS, dims.DEFAULT_CITY))


def with_building_defaults(df: DataFrame, building_type: str = "building.building_type") -> DataFrame:
    return _lookup(df, dims.building_table(df.sparkSession), building_type,
                   "building_type", _row(dims.BUILDING_TYPES, dims.BUILDING_COLUMNS, dims.DEFAULT_BUILDING))


def with_systems(df: DataFrame, heating: str = "heating.system_type", cooling: str = "cooling.system_type") -> DataFrame:
    df = _lookup(df, dims.heating_table(df.sparkSession), heating, "system_type",
                 _row(dims.HEATING_SYSTEMS, dims.HEATING_COLUMNS, dims.DEFAULT_HEATING))
    return _lookup(df, dims.cooling_table(df.sparkSession), cooling, "system_type",
                   _row(dims.COOLING_SYSTEMS, dims.COOLING_COLUMNS, dims.DEFAULT_COOLING))


def with_geometry(df: DataFrame) -> DataFrame:
    """Resolved storeys, height and areas with the annual-model defaults."""
    return add_columns(df, {
        "floors": "coalesce(building.floors, 1D)",
        "height": "coalesce(building.height, 3D)",
        "floor_area": "coalesce(geometry.floor_area_m2, 500D)",
        "total_area": "floor_area * floors",
        "wall_area": "coalesce(wall_area_item, geometry.wall_area_m2, floor_area * 0.8D)",
        "window_area": "coalesce(window_area_item, geometry.window_area_m2, wall_area * 0.3D)",
        "roof_area": "coalesce(geometry.roof_area_m2, floor_area)",
        "door_area": "coalesce(door_area_item, geometry.door_area_m2, 0D)",
        "wwr": "window_area / greatest(wall_area + window_area, 1D)",
    })


def degree_day_adjust(df: DataFrame) -> DataFrame:
    """Set points, scope flags and degree days moved by the set points."""
    return add_columns(df, {
        "t_heat": "coalesce(heating.t_set, 18D)",
        "t_cool": "coalesce(cooling.t_set, 26D)",
        "heating_on": "coalesce(heating.enabled, true)",
        "cooling_on": "coalesce(cooling.enabled, true)",
        "hdd_adj": "greatest(0D, hdd18 + (t_heat - 18D) * 120D)",
        "cdd_adj": "greatest(0D, cdd26 + (26D - t_cool) * 90D)",
    })


def annual_use_inputs(df: DataFrame) -> DataFrame:
    """Occupants, air flows, operating hours, efficiencies, design temperatures."""
    source = lambda request, city: (f"CASE WHEN {request} IS NOT NULL THEN 'request' WHEN {city} IS NOT NULL THEN 'city_database' "
                                    "ELSE 'unavailable' END")
    w, s = "heating.outdoor_design_temperature_c", "cooling.outdoor_design_temperature_c"
    return add_columns(df, {
        "occupants": "total_area / coalesce(occupancy.area_per_person_m2, 10D)",
        "fresh_air_flow": "occupants * coalesce(ventilation.fresh_air_m3h_per_person, 30D)",
        "annual_hours": "CASE WHEN schedule.daily_operation_hours IS NULL AND schedule.annual_operation_days IS NULL "
        "AND schedule.op_hours IS NOT NULL THEN schedule.op_hours "
        "ELSE coalesce(schedule.daily_operation_hours, 12D) * coalesce(schedule.annual_operation_days, 250D) END",
        "operation_fraction": f"annual_hours / {HOURS_PER_YEAR}D",
        "heat_recovery": "CASE WHEN ventilation.heat_recovery_efficiency_percent IS NOT NULL "
        "THEN ventilation.heat_recovery_efficiency_percent / 100D "
        "WHEN ventilation.heat_recovery_efficiency > 1D THEN ventilation.heat_recovery_efficiency / 100D "
        "ELSE coalesce(ventilation.heat_recovery_efficiency, 0D) END",
        "infiltration_ach": "coalesce(ventilation.infiltration_ach, 0D)",
        "infiltration_flow": "total_area * height * infiltration_ach",
        "fan_power": "coalesce(ventilation.fan_power_w_per_m3h, ventilation.fan_power, 0.5D)",
        "heating_efficiency": "CASE WHEN heating.system_type = 'electric' THEN 1D ELSE coalesce(heating.seasonal_efficiency, "
        "CASE WHEN heating_fuel = 'electric' THEN 1.9D ELSE heating_nominal END) END",
        "cooling_efficiency": "coalesce(cooling.seasonal_efficiency, 2.3D)",
        "winter_design_c": f"coalesce({w}, city_winter_design_c)",
        "summer_design_c": f"coalesce({s}, city_summer_design_c)",
        "winter_design_source": source(w, "city_winter_design_c"),
        "summer_design_source": source(s, "city_summer_design_c"),
        "design_temperature_source": "CASE WHEN winter_design_source = summer_design_source THEN winter_design_source ELSE 'mixed' END",
    })


def envelope_demand(df: DataFrame) -> DataFrame:
    """Transmission and solar demand, simple or detailed per row."""
    detailed = "calculation_mode = 'detailed'"
    return add_columns(with_detailed_loads(df), {
        "u_wall": "coalesce(wall_value_item, envelope.u_wall, 0.6D)",
        "u_window": "coalesce(window_value_item, envelope.u_window, 2.5D)",
        "u_roof": "coalesce(envelope.u_roof, 0.4D)",
        "u_floor": "coalesce(envelope.u_floor, 0.3D)",
        "u_door": "coalesce(door_value_item, envelope.u_door, 3D)",
        "shgc": "coalesce(shgc_value_item, envelope.shgc, 0.4D)",
        "envelope_ua": f"CASE WHEN {detailed} THEN detail_transmission_ua ELSE u_wall * wall_area + u_window * window_area "
        "+ u_roof * roof_area + u_floor * floor_area + u_door * door_area END",
        "solar_gain": f"CASE WHEN {detailed} THEN detail_solar_gain ELSE window_area * shgc * 150D * (cdd26 / greatest(cdd26 + hdd18, 1D)) END",
        "total_ua": f"envelope_ua + CASE WHEN {detailed} THEN detail_leakage ELSE 0D END",
        "heating_envelope": "CASE WHEN heating_on THEN envelope_ua * hdd_adj * 24D / 1000D END",
        "cooling_envelope": "CASE WHEN cooling_on THEN envelope_ua * cdd_adj * 24D / 1000D + solar_gain END",
    })


def air_demand(df: DataFrame) -> DataFrame:
    """Fresh-air demand during operation and infiltration all year."""
    explicit = "ventilation.infiltration_ach IS NOT NULL"
    legacy = "calculation_mode = 'detailed' AND detail_leakage > 0"
    out = {
        "fresh_air_ua": f"{AIR_HEAT}D * fresh_air_flow * (1D - heat_recovery)",
        "infiltration_ua": f"CASE WHEN {explicit} THEN {AIR_HEAT}D * infiltration_flow WHEN {legacy} THEN detail_leakage ELSE 0D END",
        "infiltration_source": f"CASE WHEN {explicit} THEN 'explicit_ach' WHEN {legacy} THEN 'legacy_window_tightness' ELSE 'none' END",
    }
    for side, dd in (("heating", "hdd_adj"), ("cooling", "cdd_adj")):
        out[f"fresh_air_{side}"] = f"CASE WHEN {side}_on THEN fresh_air_ua * {dd} * 24D / 1000D * operation_fraction END"
        out[f"infiltration_{side}"] = f"CASE WHEN {side}_on THEN infiltration_ua * {dd} * 24D / 1000D END"
    return add_columns(df, out)


def thermal_demand(df: DataFrame) -> DataFrame:
    """Heating and cooling totals; a disabled side is null throughout."""
    return add_columns(df, {f"annual_{s}_demand": f"{s}_envelope + fresh_air_{s} + infiltration_{s}" for s in ("heating", "cooling")})


def end_use_electricity(df: DataFrame) -> DataFrame:
    fired = "heating_on AND heating_fuel NOT IN ('electric', 'none')"
    return add_columns(df, {
        "heating_kwh": "CASE WHEN heating_on AND heating_fuel = 'electric' THEN annual_heating_demand / heating_efficiency ELSE 0D END",
        "heating_purchased_kwh": f"CASE WHEN {fired} THEN annual_heating_demand / heating_efficiency ELSE 0D END",
        "purchased_fuel": f"CASE WHEN {fired} THEN heating_fuel ELSE 'none' END",
        "purchased_efficiency": f"CASE WHEN {fired} THEN heating_efficiency END",
        "cooling_kwh": f"CASE WHEN cooling_on AND coalesce(cooling.system_type, '{dims.DEFAULT_COOLING}') <> 'none' "
        "THEN annual_cooling_demand / cooling_efficiency ELSE 0D END",
        "lighting_kwh": "coalesce(lighting.lpd, 8D) * total_area * annual_hours * coalesce(lighting.control_factor, 1D) / 1000D",
        "equipment_kwh": "coalesce(equipment.epd, 15D) * total_area * annual_hours / 1000D",
        "ventilation_kwh": "fresh_air_flow * fan_power * annual_hours / 1000D",
    })


def dhw_energy(df: DataFrame) -> DataFrame:
    """Hot water: 35 K rise, every day of the year."""
    people = "coalesce(dhw.occupants, greatest(1D, CAST(floor(total_area * default_occupancy) AS DOUBLE)))"
    return add_columns(df, {
        "dhw_kwh": f"{people} * coalesce(dhw.daily_liter_pp, default_dhw_liter_pp) * 4.186D * 35D * 365D / 3600D / coalesce(dhw.efficiency, 0.85D)",
    })


def equivalent_peak(df: DataFrame) -> DataFrame:
    """Order-of-magnitude peak and full-load hours; null when not defined."""
    ua = "(envelope_ua + fresh_air_ua + infiltration_ua)"
    out = {}
    for side, dd, dt in (("heating", "hdd_adj", "(t_heat - winter_design_c)"), ("cooling", "cdd_adj", "(summer_design_c - t_cool)")):
        ok = f"{side}_on AND {dd} > 0 AND {dt} > 0"
        out[f"{side}_peak_kw"] = f"CASE WHEN {ok} THEN {ua} * {dt} / 1000D END"
        out[f"{side}_equivalent_hours"] = f"CASE WHEN {ok} THEN {dd} * 24D / {dt} END"
    return add_columns(df, out)


# Upper EUI bound, grade, label; the last row is open.
RATINGS = [(50, "A", "超低能耗"), (80, "B", "低能耗"), (120, "C", "节能"), (180, "D", "一般"), (None, "E", "高能耗")]
END_USES = ["heating", "cooling", "lighting", "equipment", "ventilation", "dhw"]


def eui_rating_sql(eui: str, column: int = 1) -> str:
    whens = " ".join(f"WHEN {eui} < {r[0]} THEN '{r[column]}'" for r in RATINGS if r[0])
    return f"CASE {whens} ELSE '{RATINGS[-1][column]}' END"


def eui_breakdown(df: DataFrame) -> DataFrame:
    """Total, EUI, rating, and per-use EUI from the rounded uses."""
    return add_columns(df, {
        "total_kwh": " + ".join(f"{u}_kwh" for u in END_USES),
        "eui": "CASE WHEN total_area > 0 THEN total_kwh / total_area ELSE 0D END",
        "rating": eui_rating_sql("eui", 1),
        "rating_label": eui_rating_sql("eui", 2),
        **{f"{u}_kwh_rounded": f"bround({u}_kwh, 1)" for u in END_USES},
        **{f"{u}_eui": f"CASE WHEN total_area > 0 THEN bround({u}_kwh_rounded / total_area, 2) ELSE 0D END" for u in END_USES},
    })


# Notes on what the model leaves out.
ALWAYS_NOTES = [
    "HDD/CDD简化年度模型",
    "新风制冷仅含显热，不含除湿潜热",
    "未进行8760小时逐时模拟",
    "等效峰值仅用于数量级校核，不是严格设计负荷",
    "人员、照明和设备内部得热未与冷热需求逐时耦合",
    "年度供暖热需求未扣除太阳得热",
]
NOTE_NO_HEATING = "本报告未启用供暖计算"
NOTE_NO_COOLING = "本报告未启用制冷计算"
NOTE_NO_TEMPERATURE = "当前城市室外设计温度未确认，等效峰值不可用"
NOTE_USER_TEMPERATURE = "非西安城市的室外设计温度来自用户输入，未由城市气候库确认"


def model_boundaries(df: DataFrame) -> DataFrame:
    """Notes on what the result leaves out, as an array column."""
    missing = "winter_design_source = 'unavailable' OR summer_design_source = 'unavailable'"
    by_user = f"coalesce(climate.city_id, '{dims.DEFAULT_CITY}') <> 'xian' AND design_temperature_source IN ('request', 'mixed')"
    always = ", ".join(sql_literal(n) for n in ALWAYS_NOTES)
    return add_columns(df, {
        "model_boundaries": f"concat(array({always}), array_compact(array(CASE WHEN NOT heating_on THEN '{NOTE_NO_HEATING}' END, "
        f"CASE WHEN NOT cooling_on THEN '{NOTE_NO_COOLING}' END, CASE WHEN {missing} THEN '{NOTE_NO_TEMPERATURE}' "
        f"WHEN {by_user} THEN '{NOTE_USER_TEMPERATURE}' END)))"})


def annual_balance(df: DataFrame) -> DataFrame:
    """The whole annual model over conformed scenarios: one narrow stage."""
    return (df.transform(normalize_detailed_envelope).transform(with_geometry).transform(with_climate)
            .transform(with_building_defaults).transform(with_systems).transform(degree_day_adjust)
            .transform(annual_use_inputs).transform(envelope_demand).transform(air_demand)
            .transform(thermal_demand).transform(end_use_electricity).transform(dhw_energy)
            .transform(equivalent_peak).transform(eui_breakdown).transform(model_boundaries))


def legacy_degree_day(df: DataFrame) -> DataFrame:
    """The older five-city model on flat columns.

    Uses floor area, wall and window length (m), storeys, height, U-values and
    set points; without windows 15 % of the wall length becomes window.
    """
    spark = df.sparkSession
    city = constant_table(spark, dims.LEGACY_CLIMATE, "legacy_city string, hdd double, cdd double")
    default = next(r for r in dims.LEGACY_CLIMATE if r[0] == dims.LEGACY_DEFAULT_CITY)
    df = df.join(F.broadcast(city), F.col("city_id") == F.col("legacy_city"), "left")
    split = (F.col("window_len") == 0) & (F.col("wall_len") > 0)
    df = df.withColumns({
        "hdd": F.coalesce("hdd", F.lit(default[1])), "cdd": F.coalesce("cdd", F.lit(default[2])),
        "wall_len_used": F.when(split, F.col("wall_len") * 0.85).otherwise(F.col("wall_len")),
        "window_len_used": F.when(split, F.col("wall_len") * 0.15).otherwise(F.col("window_len")),
        "total_floor_area": F.col("area") * F.col("floors"),
    })
    df = df.withColumns({
        "total_ua": F.col("u_wall") * (F.col("wall_len_used") * F.col("height") * F.col("floors"))
        + F.col("u_win") * (F.col("window_len_used") * F.col("height") * F.col("floors"))
        + F.col("u_roof") * F.col("area") + F.col("u_floor") * F.col("area"),
        "hdd": F.greatest(F.lit(0.0), F.col("hdd") + (F.col("t_heat") - 18.0) * 120.0),
        "cdd": F.greatest(F.lit(0.0), F.col("cdd") + (26.0 - F.col("t_cool")) * 90.0),
    })
    df = df.withColumns({
        "heating_kwh": F.col("total_ua") * F.col("hdd") * 24.0 / 1000.0,
        "cooling_kwh": F.col("total_ua") * F.col("cdd") * 24.0 / 1000.0,
        "perimeter": F.col("wall_len_used") + F.col("window_len_used"),
    })
    total = F.col("heating_kwh") + F.col("cooling_kwh") + F.col("total_floor_area") * 25.0
    return df.withColumns({
        "eui_total": F.when(F.col("total_floor_area") > 0, total / F.col("total_floor_area")).otherwise(0.0),
    }).drop("legacy_city")


def floor_area_ladder(df: DataFrame) -> DataFrame:
    """Floor area and its source: the first rule that applies wins."""
    s2 = F.col("scale") * F.col("scale")
    rung = lambda cond, value, name: F.when(cond, F.struct(value.cast("double").alias("value"), F.lit(name).alias("source")))
    exterior_ok = F.col("exterior_confirmed") & F.col("exterior_ready")
    rooms_ok = ~F.col("exterior_repair_required") & (F.col("room_count") > 0) & (F.col("room_area_px2") > 0)
    legacy = ~F.col("has_room_topology")
    pick = F.coalesce(
        rung(F.col("footprint_pixels") > 0, F.col("footprint_pixels") * s2, "image_footprint"),
        rung(exterior_ok, F.col("exterior_area_m2"), "confirmed_exterior_footprint"),
        rung(rooms_ok, F.col("room_area_px2") * s2, "room_polygons"),
        rung(F.col("manual_area_m2").isNotNull(), F.col("manual_area_m2"), "manual"),
        rung(legacy, F.col("image_width") * F.col("image_height") * s2, "legacy_image_bounds"),
        F.struct(F.lit(None).cast("double").alias("value"), F.lit("error").alias("source")),
    )
    return df.withColumn("_pick", pick).withColumns({
        "floor_area_m2": F.col("_pick.value"), "floor_area_source": F.col("_pick.source")}).drop("_pick")


def effective_scale(df: DataFrame) -> DataFrame:
    """A confirmed, positive calibration overrides the requested scale."""
    ok = (F.col("calibration_status") == "confirmed") & (F.col("calibrated_scale") > 0) & (
        F.col("calibrated_scale") < float("inf"))
    return df.withColumns({
        "scale_source": F.when(ok, F.coalesce(F.nullif("calibration_method", F.lit("")), F.lit("confirmed_calibration"))).otherwise("request"),
        "scale": F.when(ok, F.col("calibrated_scale")).otherwise(F.col("request_scale")),
    })


def oriented_areas(df: DataFrame) -> DataFrame:
    """Side lengths of a plan, turned to compass sides and scaled to m2.

    ``plan_orientation`` says where the page top faces; each side's length
    column is named ``top``, ``right``, ``bottom`` and ``left``.
    """
    compass = ["north", "east", "south", "west"]
    k = F.array_position(F.array(*[F.lit(c) for c in compass]), F.col("plan_orientation")).cast("int") - 1
    sides = F.array("top", "right", "bottom", "left")
    return df.withColumns({
        f"{c}_area_m2": F.element_at(sides, (F.lit(i) - k + 4) % 4 + 1) * F.col("scale") * F.col("height")
        for i, c in enumerate(compass)})
