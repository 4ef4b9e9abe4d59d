"""Registered queries of the energy family, with reference SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermograph.functions import climate as dims
from thermograph.functions.tables import values_clause
from thermograph.operators import design, energy, envelope, plan_geometry, validate
from thermograph.plans import adapters as A
from thermograph.plans.evaluate import SUMMARY_COLUMNS, evaluate_scenarios

_climate = values_clause(dims.CLIMATE, dims.CLIMATE_COLUMNS, "t")
_types = values_clause(dims.BUILDING_TYPES, dims.BUILDING_COLUMNS, "t")
_heat = values_clause(dims.HEATING_SYSTEMS, dims.HEATING_COLUMNS, "t")
_cool = values_clause(dims.COOLING_SYSTEMS, dims.COOLING_COLUMNS, "t")

# One SQL text computes every column of the model; each oracle selects from it.
BALANCE_SQL = f"""
v AS ({A.VIEWS['v_scenarios']}),
climate AS (SELECT * FROM {_climate}), btypes AS (SELECT * FROM {_types}),
heats AS (SELECT * FROM {_heat}), cools AS (SELECT * FROM {_cool}),
d0 AS (
 SELECT v.*, c.city_name, c.zone, c.hdd18, c.cdd26, c.t_avg, c.rh, c.city_winter_design_c, c.city_summer_design_c,
  b.default_lpd, b.default_epd, b.default_occupancy, b.default_dhw_liter_pp, b.building_name,
  h.heating_name, h.heating_nominal, h.heating_fuel, k.cooling_name, k.cooling_cop
 FROM v
 JOIN climate c ON c.city_id = CASE WHEN v.city_id IN (SELECT city_id FROM climate) THEN v.city_id ELSE 'beijing' END
 JOIN btypes b ON b.building_type = CASE WHEN v.building_type IN (SELECT building_type FROM btypes) THEN v.building_type ELSE 'office' END
 JOIN heats h ON h.system_type = CASE WHEN v.heating_system IN (SELECT system_type FROM heats) THEN v.heating_system ELSE 'gas_boiler' END
 JOIN cools k ON k.system_type = CASE WHEN v.cooling_system IN (SELECT system_type FROM cools) THEN v.cooling_system ELSE 'central_chiller' END),
d1 AS (
 SELECT *, floor_area_m2 AS floor_area, floor_area_m2 * floors AS total_area,
  coalesce(wall_area_m2, floor_area_m2 * 0.8::DOUBLE) AS wall_area, floor_area_m2 AS roof_area, 0::DOUBLE AS door_area,
  greatest(0::DOUBLE, hdd18 + (t_heat - 18) * 120) AS hdd_adj, greatest(0::DOUBLE, cdd26 + (26 - t_cool) * 90) AS cdd_adj,
  CASE WHEN daily_hours IS NULL AND op_hours IS NOT NULL THEN op_hours ELSE coalesce(daily_hours, 12) * 250 END AS annual_hours,
  CASE WHEN recovery_percent IS NOT NULL THEN recovery_percent / 100 WHEN coalesce(recovery, 0) > 1 THEN recovery / 100
   ELSE coalesce(recovery, 0) END AS heat_recovery,
  CASE WHEN heating_system = 'electric' THEN 1.0::DOUBLE WHEN heating_fuel = 'electric' THEN 1.9::DOUBLE ELSE heating_nominal END AS heating_efficiency,
  2.3::DOUBLE AS cooling_efficiency, 0.5::DOUBLE AS fan_power,
  coalesce(winter_c, city_winter_design_c) AS winter_design_c, coalesce(summer_c, city_summer_design_c) AS summer_design_c,
  CASE WHEN winter_c IS NOT NULL THEN 'request' WHEN city_winter_design_c IS NOT NULL THEN 'city_database' ELSE 'unavailable' END AS winter_design_source,
  CASE WHEN summer_c IS NOT NULL THEN 'request' WHEN city_summer_design_c IS NOT NULL THEN 'city_database' ELSE 'unavailable' END AS summer_design_source,
  coalesce(infiltration_ach, 0) AS ach
 FROM d0),
d2 AS (
 SELECT *, coalesce(window_area_m2, wall_area * 0.3::DOUBLE) AS window_area, total_area / 10 AS occupants, annual_hours / 8760 AS operation_fraction,
  total_area * height_m * ach AS infiltration_flow,
  CASE WHEN winter_design_source = summer_design_source THEN winter_design_source ELSE 'mixed' END AS design_temperature_source
 FROM d1),
d3 AS (
 SELECT *, occupants * 30 AS fresh_air_flow,
  0.6::DOUBLE * wall_area + 2.5::DOUBLE * window_area + 0.4::DOUBLE * roof_area + 0.3::DOUBLE * floor_area + 3.0::DOUBLE * door_area AS envelope_ua,
  window_area * 0.4::DOUBLE * 150 * (cdd26 / greatest(cdd26 + hdd18, 1)) AS solar_gain,
  window_area / greatest(wall_area + window_area, 1) AS wwr
 FROM d2),
d4 AS (
 SELECT *, 0.335::DOUBLE * fresh_air_flow * (1 - heat_recovery) AS fresh_air_ua,
  CASE WHEN infiltration_ach IS NOT NULL THEN 0.335::DOUBLE * infiltration_flow ELSE 0 END AS infiltration_ua,
  CASE WHEN infiltration_ach IS NOT NULL THEN 'explicit_ach' ELSE 'none' END AS infiltration_source,
  envelope_ua * hdd_adj * 24 / 1000 AS he0, envelope_ua * cdd_adj * 24 / 1000 + solar_gain AS ce0
 FROM d3),
d5 AS (
 SELECT *, fresh_air_ua * hdd_adj * 24 / 1000 * operation_fraction AS fh0, fresh_air_ua * cdd_adj * 24 / 1000 * operation_fraction AS fc0,
  infiltration_ua * hdd_adj * 24 / 1000 AS ih0, infiltration_ua * cdd_adj * 24 / 1000 AS ic0
 FROM d4),
d6 AS (
 SELECT *, CASE WHEN heating_enabled THEN he0 END AS heating_envelope, ce0 AS cooling_envelope,
  CASE WHEN heating_enabled THEN fh0 END AS fresh_air_heating, fc0 AS fresh_air_cooling,
  CASE WHEN heating_enabled THEN ih0 END AS infiltration_heating, ic0 AS infiltration_cooling,
  CASE WHEN heating_enabled THEN he0 + fh0 + ih0 END AS annual_heating_demand, ce0 + fc0 + ic0 AS annual_cooling_demand
 FROM d5),
d7 AS (
 SELECT *,
  CASE WHEN heating_enabled AND heating_fuel = 'electric' THEN annual_heating_demand / heating_efficiency ELSE 0 END AS heating_kwh,
  CASE WHEN heating_enabled AND heating_fuel NOT IN ('electric', 'none') THEN annual_heating_demand / heating_efficiency ELSE 0 END AS heating_purchased_kwh,
  CASE WHEN coalesce(cooling_system, 'central_chiller') <> 'none' THEN annual_cooling_demand / cooling_efficiency ELSE 0 END AS cooling_kwh,
  8.0::DOUBLE * total_area * annual_hours * 1 / 1000 AS lighting_kwh, 15.0::DOUBLE * total_area * annual_hours / 1000 AS equipment_kwh,
  fresh_air_flow * fan_power * annual_hours / 1000 AS ventilation_kwh,
  greatest(1::DOUBLE, floor(total_area * default_occupancy)) * default_dhw_liter_pp * 4.186::DOUBLE * 35 * 365 / 3600 / 0.85::DOUBLE AS dhw_kwh,
  CASE WHEN heating_enabled AND hdd_adj > 0 AND t_heat - winter_design_c > 0 THEN (envelope_ua + fresh_air_ua + infiltration_ua) * (t_heat - winter_design_c) / 1000 END AS heating_peak_kw,
  CASE WHEN heating_enabled AND hdd_adj > 0 AND t_heat - winter_design_c > 0 THEN hdd_adj * 24 / (t_heat - winter_design_c) END AS heating_equivalent_hours,
  CASE WHEN cdd_adj > 0 AND summer_design_c - t_cool > 0 THEN (envelope_ua + fresh_air_ua + infiltration_ua) * (summer_design_c - t_cool) / 1000 END AS cooling_peak_kw,
  CASE WHEN cdd_adj > 0 AND summer_design_c - t_cool > 0 THEN cdd_adj * 24 / (summer_design_c - t_cool) END AS cooling_equivalent_hours
 FROM d6),
d8 AS (SELECT *, heating_kwh + cooling_kwh + lighting_kwh + equipment_kwh + ventilation_kwh + dhw_kwh AS total_kwh FROM d7),
d9 AS (
 SELECT *, total_kwh / total_area AS eui,
  (6 + CASE WHEN heating_enabled THEN 0 ELSE 1 END
   + CASE WHEN winter_design_source = 'unavailable' OR summer_design_source = 'unavailable' THEN 1
          WHEN coalesce(city_id, 'beijing') <> 'xian' AND design_temperature_source IN ('request', 'mixed') THEN 1 ELSE 0 END)::BIGINT AS n_notes
 FROM d8),
g1 AS (
 SELECT *, floor_area_m2 * floors AS d_total_area, coalesce(window_area_m2, 0) AS d_window_area,
  coalesce(wall_area_m2, 0) * 0.6::DOUBLE + coalesce(window_area_m2, 0) * 2.5::DOUBLE + floor_area_m2 * 0.4::DOUBLE + 0::DOUBLE * 0.3::DOUBLE + 0::DOUBLE * 3.0::DOUBLE AS d_envelope_ua,
  floor_area_m2 * floors / 10 AS d_occupants,
  CASE WHEN outdoor_rh IS NOT NULL THEN outdoor_rh / 100 * (0.61078::DOUBLE * exp((17.2694::DOUBLE * coalesce(summer_c, 34.9::DOUBLE)) / (coalesce(summer_c, 34.9::DOUBLE) + 237.3::DOUBLE))) END AS pw_out,
  CASE WHEN indoor_rh IS NOT NULL THEN indoor_rh / 100 * (0.61078::DOUBLE * exp((17.2694::DOUBLE * t_cool) / (t_cool + 237.3::DOUBLE))) END AS pw_in,
  greatest(0::DOUBLE, coalesce(summer_c, 34.9::DOUBLE) - t_cool) AS cdt, greatest(0::DOUBLE, t_heat - coalesce(winter_c, -5)) AS hdt
 FROM d9),
g2 AS (
 SELECT *, d_occupants * 30 AS d_fresh, d_total_area * height_m * ach AS d_infil,
  CASE WHEN outdoor_rh IS NOT NULL THEN 1.006::DOUBLE * coalesce(summer_c, 34.9::DOUBLE) + 0.62198::DOUBLE * pw_out / greatest(101.325::DOUBLE - pw_out, 0.001::DOUBLE) * (2501 + 1.86::DOUBLE * coalesce(summer_c, 34.9::DOUBLE)) ELSE 85::DOUBLE END AS d_outdoor_enthalpy,
  CASE WHEN indoor_rh IS NOT NULL THEN 1.006::DOUBLE * t_cool + 0.62198::DOUBLE * pw_in / greatest(101.325::DOUBLE - pw_in, 0.001::DOUBLE) * (2501 + 1.86::DOUBLE * t_cool) ELSE 55::DOUBLE END AS d_indoor_enthalpy,
  d_occupants * 75 AS ps, d_occupants * 55 AS pl, d_total_area * 8 AS li, d_total_area * 15 AS eq
 FROM g1),
g3 AS (
 SELECT *, greatest(0::DOUBLE, d_outdoor_enthalpy - d_indoor_enthalpy) AS dh, d_envelope_ua * cdt AS c1, d_window_area * 0.4::DOUBLE * 250 AS c2,
  0.335::DOUBLE * d_fresh * cdt AS c3, 0.335::DOUBLE * d_infil * cdt AS c5, d_envelope_ua * hdt AS h1, 0.335::DOUBLE * d_fresh * hdt AS h2, 0.335::DOUBLE * d_infil * hdt AS h3
 FROM g2),
g4 AS (
 SELECT *, 1.13::DOUBLE * d_fresh * dh / 3.6::DOUBLE AS c4, 1.13::DOUBLE * d_infil * dh / 3.6::DOUBLE AS c6, h1 + h2 + h3 + 0 AS losses,
  (ps + pl + li + eq) * least(coalesce(stable_fraction, 0), 1) AS deduction
 FROM g3),
model AS (
 SELECT *, c1 + c2 + c3 + c4 + c5 + c6 + (ps + pl) + li + eq AS cooling_load_w,
  CASE WHEN heating_enabled THEN greatest(0::DOUBLE, losses + losses * (coalesce(addition_factor, 1) - 1) - deduction) END AS heating_load_w,
  CASE WHEN eui < 50 THEN 'A' WHEN eui < 80 THEN 'B' WHEN eui < 120 THEN 'C' WHEN eui < 180 THEN 'D' ELSE 'E' END AS rating
 FROM g4)
"""


def _model(select: str) -> str:
    return f"WITH {BALANCE_SQL} SELECT {select} FROM model"


def _pick(*cols):
    return lambda spark, sf: energy_model(spark, sf).select("scenario_id", *cols)


def energy_model(spark, sf):
    return evaluate_scenarios(A.scenarios(spark, sf))


QUERIES: dict = {}


def fixed(name, digits=4):
    """Fixed-point view of a double for comparison: same steps in any engine."""
    k = float(10 ** digits)
    return (F.floor(F.col(name) * k + 0.5).cast("double") / k).alias(name)


def fixed_sql(expr, digits=4):
    k = 10 ** digits
    return f"floor(({expr}) * {k}::DOUBLE + 0.5::DOUBLE) / {k}::DOUBLE"


def add(name, fn, sql=None):
    QUERIES[name] = (fn, sql)


def _simple(name, *cols):
    """A model step whose output columns carry the same name in the oracle."""
    add(name, _pick(*cols), _model(", ".join(["scenario_id", *cols])))


_simple("E1_with_climate", "city_name", "zone", "hdd18", "cdd26")
_simple("E2_with_systems", "building_name", "default_occupancy", "heating_name", "heating_fuel", "cooling_name", "cooling_cop")
_simple("E6_annual_use_inputs", "occupants", "fresh_air_flow", "annual_hours", "operation_fraction", "heat_recovery", "infiltration_flow",
        "heating_efficiency", "winter_design_c", "summer_design_c", "winter_design_source", "design_temperature_source")
_simple("E7_degree_day_adjust", "hdd_adj", "cdd_adj")
_simple("E8_envelope_demand", "envelope_ua", "solar_gain", "heating_envelope", "cooling_envelope", "wwr")
_simple("E9_air_demand", "fresh_air_ua", "infiltration_ua", "infiltration_source", "fresh_air_heating", "fresh_air_cooling",
        "infiltration_heating", "infiltration_cooling")
_simple("E10_thermal_demand", "annual_heating_demand", "annual_cooling_demand")
_simple("E11_end_use_electricity", "heating_kwh", "heating_purchased_kwh", "cooling_kwh", "lighting_kwh", "equipment_kwh", "ventilation_kwh")
_simple("E12_dhw_energy", "dhw_kwh")
_simple("E13_equivalent_peak", "heating_peak_kw", "heating_equivalent_hours", "cooling_peak_kw", "cooling_equivalent_hours")
_simple("E14_eui_breakdown", "total_kwh", "eui")
_simple("N26_eui_rating", "rating")
add("E15_model_boundaries",
    lambda s, d: energy_model(s, d).select("scenario_id", F.size("model_boundaries").cast("bigint").alias("n_notes")),
    _model("scenario_id, n_notes"))
add("E16_design_base",
    lambda s, d: energy_model(s, d).select(
        "scenario_id", "d_total_area", "d_occupants", "d_envelope_ua", F.col("d_fresh_air_flow").alias("d_fresh"),
        F.col("d_infiltration_flow").alias("d_infil"), F.col("d_lighting_w").alias("li"), F.col("d_equipment_w").alias("eq")),
    _model("scenario_id, d_total_area, d_occupants, d_envelope_ua, d_fresh, d_infil, li, eq"))
add("E17_cooling_design_load",
    lambda s, d: energy_model(s, d).select(
        "scenario_id", fixed("cooling_load_w"), fixed("cooling_index_w_m2"), fixed("cl_fresh_air_latent"), "cl_window_solar"),
    _model(f"scenario_id, {fixed_sql('cooling_load_w')} AS cooling_load_w, {fixed_sql('cooling_load_w / d_total_area')} AS cooling_index_w_m2, "
           f"{fixed_sql('c4')} AS cl_fresh_air_latent, c2 AS cl_window_solar"))
add("E18_heating_design_load",
    lambda s, d: energy_model(s, d).select("scenario_id", fixed("heating_load_w"), fixed("heating_index_w_m2"), fixed("hl_gain_deduction")),
    _model(f"scenario_id, {fixed_sql('heating_load_w')} AS heating_load_w, {fixed_sql('heating_load_w / d_total_area')} AS heating_index_w_m2, "
           f"{fixed_sql('CASE WHEN heating_enabled THEN deduction END')} AS hl_gain_deduction"))
_rounded = [c for c in SUMMARY_COLUMNS if c not in ("scenario_id", "rating")]
add("E19_evaluate_scenarios",
    lambda s, d: energy_model(s, d).select("scenario_id", "rating", *[fixed(c) for c in _rounded]),
    _model("scenario_id, rating, " + ", ".join(f"{fixed_sql(c)} AS {c}" for c in _rounded)))
add("N10_moist_air_enthalpy",
    lambda s, d: energy_model(s, d).select("scenario_id", F.round("d_outdoor_enthalpy", 6).alias("outdoor_enthalpy"),
                                           F.round("d_indoor_enthalpy", 6).alias("indoor_enthalpy")),
    _model("scenario_id, round(d_outdoor_enthalpy, 6) AS outdoor_enthalpy, round(d_indoor_enthalpy, 6) AS indoor_enthalpy"))


# -- detailed mode: five oriented walls and windows a scenario -----------------

_SIDES = {"south": 3, "east": 5, "west": 7, "north": 11, "skew": 13}
_ITEM = {"wall_area": "({k} * {n}) % 60", "wall_u": "({k} + {n}) % 5 * 0.5", "area": "({k} * {n}) % 40", "u": "({k} + {n}) % 4 * 0.75", "shgc": "({k} + {n}) % 4 * 0.25",
         "shade": "CASE WHEN ({k} + {n}) % 3 > 0 THEN 0.75 END", "tight": "CASE WHEN ({k} + {n}) % 2 > 0 THEN ({k} + {n}) % 9 END", "door": "({k} + {n}) % 3", "door_u": "({k} + {n}) % 2 * 3"}


def detailed_scenarios(spark, sf):
    term = lambda name, n: f"CAST({_ITEM[name].format(k='scenario_id', n=n)} AS DOUBLE)"
    item = lambda o, **f: F.expr(f"named_struct('orientation', '{o}', " + ", ".join(f"'{k}', {v}" for k, v in f.items()) + ")")
    walls = F.array(*[item(o, area_m2=term("wall_area", n), u_value=term("wall_u", n)) for o, n in _SIDES.items()])
    windows = F.array(*[item(o, area_m2=term("area", n), u_value=term("u", n), shgc=term("shgc", n), shading_factor=term("shade", n), air_tightness_value=term("tight", n), door_area_m2=term("door", n), door_u_value=term("door_u", n)) for o, n in _SIDES.items()])
    flag = lambda m: F.col("scenario_id") % m == 0
    s = A.scenarios(spark, sf).withColumns({"calculation_mode": F.lit("detailed"), "walls_by_orientation": walls, "windows_by_orientation": windows,
                                            "geometry": F.col("geometry").withField("include_roof", flag(2)).withField("include_floor", flag(3))})
    return evaluate_scenarios(s)


def _detailed_sql():
    """The balance with item areas, transmission, solar gain and joint leakage in place of the simple envelope."""
    sides = ", ".join(f"('{o}', {n})" for o, n in _SIDES.items())
    items = ", ".join(f"({text.format(k='scenario_id', n='n')})::DOUBLE AS {name}" for name, text in _ITEM.items())
    pair = lambda a, b: f"sum({a}) FILTER (WHERE {a} > 0 AND {b} > 0)"
    sun = "CASE o WHEN 'south' THEN 1.0::DOUBLE WHEN 'east' THEN 0.78 WHEN 'west' THEN 0.86 WHEN 'north' THEN 0.38 ELSE 0.70 END"
    extra = f"""x AS (SELECT scenario_id, {pair('wall_area', 'wall_u')} AS x_wall_area, {pair('area', 'u')} AS x_window_area, {pair('door', 'door_u')} AS x_door_area,
  sum(wall_area * wall_u) + sum(area * u) + sum(door * door_u) AS x_ua, sum(area * shgc * coalesce(shade, 1) * {sun}) AS x_solar,
  sum(0.33::DOUBLE * greatest(0, (8 - coalesce(CASE WHEN tight > 0 THEN tight END, 6)) * 0.04::DOUBLE) * area * 3) AS x_leak,
  sum(wall_area * wall_u) FILTER (WHERE wall_area > 0 AND wall_u > 0) / {pair('wall_area', 'wall_u')} AS x_wall_u, sum(area * shgc) FILTER (WHERE area > 0 AND shgc > 0) / {pair('area', 'shgc')} AS x_shgc
 FROM (SELECT scenario_id, o, {items} FROM ({A.VIEWS['v_scenarios']}), (VALUES {sides}) AS t(o, n)) GROUP BY scenario_id),
v AS (SELECT s.*, x.* EXCLUDE (scenario_id) FROM ({A.VIEWS['v_scenarios']}) s JOIN x USING (scenario_id)),
climate AS"""
    sql = BALANCE_SQL
    for old, new in [(f"v AS ({A.VIEWS['v_scenarios']}),\nclimate AS", extra), ("coalesce(wall_area_m2, floor_area_m2 * 0.8::DOUBLE) AS wall_area", "coalesce(x_wall_area, wall_area_m2, floor_area_m2 * 0.8::DOUBLE) AS wall_area"),
                     ("0::DOUBLE AS door_area", "coalesce(x_door_area, 0) AS door_area"), ("+ 0::DOUBLE * 0.3::DOUBLE +", "+ CASE WHEN scenario_id % 3 = 0 THEN floor_area_m2 ELSE 0 END * 0.3::DOUBLE +"), ("coalesce(window_area_m2, wall_area * 0.3::DOUBLE) AS window_area", "coalesce(x_window_area, window_area_m2, wall_area * 0.3::DOUBLE) AS window_area"),
                     ("0.6::DOUBLE * wall_area + 2.5::DOUBLE * window_area + 0.4::DOUBLE * roof_area + 0.3::DOUBLE * floor_area + 3.0::DOUBLE * door_area AS envelope_ua",
                      "x_ua + CASE WHEN scenario_id % 2 = 0 THEN 0.4::DOUBLE * roof_area ELSE 0 END + CASE WHEN scenario_id % 3 = 0 THEN 0.3::DOUBLE * floor_area ELSE 0 END AS envelope_ua"),
                     ("window_area * 0.4::DOUBLE * 150 * (cdd26", "x_solar * 150 * (cdd26"), ("THEN 0.335::DOUBLE * infiltration_flow ELSE 0 END AS infiltration_ua", "THEN 0.335::DOUBLE * infiltration_flow ELSE x_leak END AS infiltration_ua"),
                     ("THEN 'explicit_ach' ELSE 'none' END", "THEN 'explicit_ach' WHEN x_leak > 0 THEN 'legacy_window_tightness' ELSE 'none' END")]:
        if sql.count(old) != 1:
            raise ValueError(f"{old[:60]} stands {sql.count(old)} times in the SQL")
        sql = sql.replace(old, new)
    return lambda select: f"WITH {sql} SELECT {select} FROM model"


_detail = _detailed_sql()
add("E4_detailed_items", lambda s, d: detailed_scenarios(s, d).select("scenario_id", fixed("wall_area"), fixed("window_area"), fixed("door_area"), fixed("wall_value_item"), fixed("shgc_value_item")),
    _detail(f"scenario_id, {fixed_sql('wall_area')} AS wall_area, {fixed_sql('window_area')} AS window_area, {fixed_sql('door_area')} AS door_area, {fixed_sql('x_wall_u')} AS wall_value_item, {fixed_sql('x_shgc')} AS shgc_value_item"))
add("E5_detailed_loads", lambda s, d: detailed_scenarios(s, d).select("scenario_id", fixed("envelope_ua"), fixed("solar_gain"), fixed("infiltration_ua"), "infiltration_source"),
    _detail(f"scenario_id, {fixed_sql('envelope_ua')} AS envelope_ua, {fixed_sql('solar_gain')} AS solar_gain, {fixed_sql('infiltration_ua')} AS infiltration_ua, infiltration_source"))
add("E19_detailed", lambda s, d: detailed_scenarios(s, d).select("scenario_id", "rating", *[fixed(c) for c in _rounded]), _detail("scenario_id, rating, " + ", ".join(f"{fixed_sql(c)} AS {c}" for c in _rounded)))


def catalog_usage(spark, sf):
    """Every selectable option with how many scenarios use it."""
    v = A.view(spark, sf, "v_scenarios")
    used = v.select(F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(c).alias("id"))
        for k, c in (("city", "city_id"), ("building_type", "building_type"), ("heating", "heating_system"), ("cooling", "cooling_system"))
    ])).alias("u")).groupBy("u.kind", "u.id").count()
    opts = dims.catalog_options(spark)
    return F.broadcast(opts).join(used, ["kind", "id"], "left").select(
        "kind", "ord", "id", "name", "zone", F.coalesce("count", F.lit(0)).alias("n_scenarios"))


_opt_rows = ([("city", i, r[0], r[1], r[2]) for i, r in enumerate(dims.CLIMATE)]
             + [("building_type", i, r[0], r[1], None) for i, r in enumerate(dims.BUILDING_TYPES)]
             + [("heating", i, r[0], r[1], None) for i, r in enumerate(dims.HEATING_SYSTEMS)]
             + [("cooling", i, r[0], r[1], None) for i, r in enumerate(dims.COOLING_SYSTEMS)])
add("E3_catalog_options", catalog_usage, f"""
WITH v AS ({A.VIEWS['v_scenarios']}),
u AS (SELECT 'city' AS kind, city_id AS id FROM v UNION ALL SELECT 'building_type', building_type FROM v
 UNION ALL SELECT 'heating', heating_system FROM v UNION ALL SELECT 'cooling', cooling_system FROM v),
n AS (SELECT kind, id, count(*) AS c FROM u GROUP BY kind, id)
SELECT o.kind, o.ord::INT AS ord, o.id, o.name, o.zone, coalesce(n.c, 0)::BIGINT AS n_scenarios
FROM {values_clause(_opt_rows, ['kind', 'ord', 'id', 'name', 'zone'], 'o')} LEFT JOIN n ON n.kind = o.kind AND n.id = o.id""")


def _items(spark, sf):
    return A.view(spark, sf, "v_orientation_items")


add("E4_normalize_detailed_envelope",
    lambda s, d: envelope.area_weighted(_items(s, d), ["scenario_id"], {"u": ("area_m2", "u_value"), "shgc": ("area_m2", "shgc")})
    .select("scenario_id", "u_area_m2", F.round("u_value", 9).alias("u_value"), "shgc_area_m2", F.round("shgc_value", 9).alias("shgc_value")),
    A.with_views("""
SELECT scenario_id, sum(area_m2) FILTER (WHERE area_m2 > 0 AND u_value > 0) AS u_area_m2,
 round(sum(area_m2 * u_value) FILTER (WHERE area_m2 > 0 AND u_value > 0) / sum(area_m2) FILTER (WHERE area_m2 > 0 AND u_value > 0), 9) AS u_value,
 sum(area_m2) FILTER (WHERE area_m2 > 0 AND shgc > 0) AS shgc_area_m2,
 round(sum(area_m2 * shgc) FILTER (WHERE area_m2 > 0 AND shgc > 0) / sum(area_m2) FILTER (WHERE area_m2 > 0 AND shgc > 0), 9) AS shgc_value
FROM v_orientation_items GROUP BY scenario_id""", "v_orientation_items"))


def orientation_loads_query(spark, sf):
    items = _items(spark, sf).withColumns({
        "kind": F.when(F.col("scenario_id") % 2 == 0, "wall").otherwise("window"),
        "shading_factor": F.lit(None).cast("double"), "air_tightness_value": F.lit(None).cast("double"),
        "door_area_m2": F.lit(2.0), "door_u_value": F.lit(3.0), "irradiation": F.lit(150.0),
        "explicit_ach": F.col("scenario_id") % 3 == 0, "hdd18": F.lit(2400.0), "cdd26": F.lit(200.0)})
    loads = envelope.orientation_loads(items)
    return loads.select("scenario_id", "orientation", *[
        F.round(c, 6).alias(c) for c in ("ua_wall", "ua_window", "ua_door", "solar_gain", "infiltration_ua")])


add("E5_orientation_loads", orientation_loads_query, A.with_views("""
SELECT scenario_id, orientation,
 round(sum(CASE WHEN scenario_id % 2 = 0 THEN area_m2 * u_value ELSE 0 END), 6) AS ua_wall,
 round(sum(CASE WHEN scenario_id % 2 = 1 THEN area_m2 * u_value ELSE 0 END), 6) AS ua_window,
 round(sum(CASE WHEN scenario_id % 2 = 1 THEN 6.0::DOUBLE ELSE 0 END), 6) AS ua_door,
 round(sum(CASE WHEN scenario_id % 2 = 1 THEN area_m2 * shgc * 150 *
   CASE orientation WHEN 'south' THEN 1.0::DOUBLE WHEN 'east' THEN 0.78 WHEN 'west' THEN 0.86 WHEN 'north' THEN 0.38 ELSE 0.70 END
   * (200.0::DOUBLE / 2600) ELSE 0 END), 6) AS solar_gain,
 round(sum(CASE WHEN scenario_id % 2 = 1 AND scenario_id % 3 <> 0 THEN 0.33::DOUBLE * (2 * 0.04::DOUBLE) * area_m2 * 3 ELSE 0 END), 6) AS infiltration_ua
FROM v_orientation_items GROUP BY scenario_id, orientation""", "v_orientation_items"))


def legacy_query(spark, sf):
    v = A.view(spark, sf, "v_scenarios").select(
        "scenario_id", "floors", "t_heat", "t_cool", F.col("height_m").alias("height"), F.col("floor_area_m2").alias("area"),
        F.coalesce("wall_area_m2", F.lit(0.0)).alias("wall_len"), F.when(F.col("scenario_id") % 3 == 0, 0.0).otherwise(F.coalesce("window_area_m2", F.lit(0.0))).alias("window_len"),
        F.lit(0.6).alias("u_wall"), F.lit(2.5).alias("u_win"), F.lit(0.4).alias("u_roof"), F.lit(0.3).alias("u_floor"),
        F.element_at(F.array(*[F.lit(r[0]) for r in dims.LEGACY_CLIMATE], F.lit("Elsewhere")), (F.col("scenario_id") % 6 + 1).cast("int")).alias("city_id"))
    return energy.legacy_degree_day(v).select("scenario_id", *[F.round(c, 6).alias(c) for c in ("heating_kwh", "cooling_kwh", "eui_total", "perimeter")])


_legacy = values_clause([(i, *r) for i, r in enumerate(dims.LEGACY_CLIMATE)] + [(5, "Elsewhere", 2800.0, 500.0)], ["k", "city", "hdd", "cdd"], "lc")
add("E20_legacy_degree_day", legacy_query, A.with_views(f"""
, a AS (SELECT scenario_id, floors, t_heat, t_cool, height_m, floor_area_m2 AS area, coalesce(wall_area_m2, 0) AS wl0,
  CASE WHEN scenario_id % 3 = 0 THEN 0 ELSE coalesce(window_area_m2, 0) END AS nl0, hdd, cdd FROM v_scenarios JOIN {_legacy} ON lc.k = scenario_id % 6),
b AS (SELECT *, CASE WHEN nl0 = 0 AND wl0 > 0 THEN wl0 * 0.85::DOUBLE ELSE wl0 END AS wl, CASE WHEN nl0 = 0 AND wl0 > 0 THEN wl0 * 0.15::DOUBLE ELSE nl0 END AS nl FROM a),
c AS (SELECT *, 0.6::DOUBLE * (wl * height_m * floors) + 2.5::DOUBLE * (nl * height_m * floors) + 0.4::DOUBLE * area + 0.3::DOUBLE * area AS ua,
  greatest(0, hdd + (t_heat - 18) * 120) AS h, greatest(0, cdd + (26 - t_cool) * 90) AS k2 FROM b)
SELECT scenario_id, round(ua * h * 24 / 1000, 6) AS heating_kwh, round(ua * k2 * 24 / 1000, 6) AS cooling_kwh,
 round((ua * h * 24 / 1000 + ua * k2 * 24 / 1000 + area * floors * 25) / (area * floors), 6) AS eui_total, round(wl + nl, 6) AS perimeter FROM c
""".lstrip(), "v_scenarios").replace(") , a AS", "), a AS"))


def validate_query(spark, sf):
    s = A.scenarios(spark, sf)
    # break some rows so that every branch of the split is visited
    s = s.withColumn("building", F.col("building").withField("floors", F.when(F.col("scenario_id") % 97 == 0, 1.5).otherwise(F.col("building.floors"))))
    s = s.withColumn("geometry", F.col("geometry").withField("wall_area_m2", F.when(F.col("scenario_id") % 89 == 0, -1.0).otherwise(F.col("geometry.wall_area_m2"))))
    s = s.withColumn("cooling", F.col("cooling").withField("enabled", F.col("scenario_id") % 2 == 0))
    return validate.validate_scenarios(s).select("scenario_id", F.array_join("errors", ";").alias("errors"))


add("F9_validate_scenarios", validate_query, A.with_views("""
SELECT scenario_id, concat_ws(';', CASE WHEN NOT heating_enabled AND scenario_id % 2 <> 0 THEN 'no_side_enabled' END,
 CASE WHEN scenario_id % 97 = 0 THEN 'building.floors:not_positive_integer' END,
 CASE WHEN scenario_id % 89 = 0 THEN 'geometry.wall_area_m2:negative' END) AS errors FROM v_scenarios""", "v_scenarios"))


def ladder_query(spark, sf):
    k = F.col("scenario_id")
    v = A.view(spark, sf, "v_scenarios").select(
        "scenario_id", F.lit(0.05).alias("scale"), F.when(k % 6 == 0, 40000.0).otherwise(0.0).alias("footprint_pixels"),
        (k % 6 == 1).alias("exterior_confirmed"), (k % 12 == 1).alias("exterior_ready"), F.col("floor_area_m2").alias("exterior_area_m2"),
        (k % 5 == 0).alias("exterior_repair_required"), (k % 4).alias("room_count"), (k % 4 * 9000.0).alias("room_area_px2"),
        F.when(k % 7 < 3, F.col("floor_area_m2")).alias("manual_area_m2"), (k % 2 == 0).alias("has_room_topology"),
        F.lit(2000.0).alias("image_width"), F.lit(1000.0).alias("image_height"))
    return energy.floor_area_ladder(v).select("scenario_id", F.round("floor_area_m2", 6).alias("floor_area_m2"), "floor_area_source")


add("E21_floor_area_ladder", ladder_query, A.with_views("""
, a AS (SELECT *, CASE WHEN scenario_id % 6 = 0 THEN 'image_footprint' WHEN scenario_id % 12 = 1 THEN 'confirmed_exterior_footprint'
 WHEN scenario_id % 5 <> 0 AND scenario_id % 4 > 0 THEN 'room_polygons' WHEN scenario_id % 7 < 3 THEN 'manual'
 WHEN scenario_id % 2 = 1 THEN 'legacy_image_bounds' ELSE 'error' END AS src FROM v_scenarios)
SELECT scenario_id, round(CASE src WHEN 'image_footprint' THEN 100.0::DOUBLE WHEN 'confirmed_exterior_footprint' THEN floor_area_m2
 WHEN 'room_polygons' THEN (scenario_id % 4) * 22.5::DOUBLE WHEN 'manual' THEN floor_area_m2 WHEN 'legacy_image_bounds' THEN 5000.0::DOUBLE END, 6) AS floor_area_m2,
 src AS floor_area_source FROM a""".lstrip(), "v_scenarios").replace(") , a AS", "), a AS"))


def exterior_areas_query(spark, sf):
    A.load_tables(spark, sf)
    topology = spark.sql("""SELECT o_orderkey AS page_id, CAST(1000 + o_orderkey % 700 * 10 AS DOUBLE) AS area_px2,
      CAST(200 + o_orderkey % 300 AS DOUBLE) AS perimeter_px, CAST(0.02 AS DOUBLE) AS scale, CAST(3 AS DOUBLE) AS storey_height,
      1 + o_orderkey % 4 AS floors, CAST(2.1 AS DOUBLE) AS door_height, CAST(1.5 AS DOUBLE) AS window_height,
      1 AS door_repeat, 1 + o_orderkey % 5 AS window_repeat FROM orders""")
    openings = spark.sql("SELECT l_orderkey AS page_id, CASE WHEN l_linenumber % 3 = 0 THEN 'door' ELSE 'window' END AS kind, l_quantity AS width_px FROM lineitem")
    return plan_geometry.exterior_to_areas(topology, openings).select(
        "page_id", "error", *[F.round(c, 6).alias(c) for c in ("footprint_m2", "gross_wall_m2", "door_area_m2", "window_area_m2", "wall_area_m2")])


add("E22_exterior_to_areas", exterior_areas_query, """
WITH t AS (SELECT o_orderkey AS page_id, (1000 + o_orderkey % 700 * 10)::DOUBLE AS a, (200 + o_orderkey % 300)::DOUBLE AS p, 1 + o_orderkey % 4 AS fl, 1 + o_orderkey % 5 AS wr FROM orders),
w AS (SELECT l_orderkey AS page_id, sum(CASE WHEN l_linenumber % 3 = 0 THEN l_quantity ELSE 0 END) AS d, sum(CASE WHEN l_linenumber % 3 <> 0 THEN l_quantity ELSE 0 END) AS n FROM lineitem GROUP BY 1),
x AS (SELECT t.*, coalesce(d, 0) * 0.02::DOUBLE * 2.1::DOUBLE AS da, coalesce(n, 0) * 0.02::DOUBLE * 1.5::DOUBLE * wr AS wa, p * 0.02::DOUBLE * 3 * fl AS gw FROM t LEFT JOIN w USING (page_id)),
y AS (SELECT *, CASE WHEN wr > fl THEN 'repeat_exceeds_floors' WHEN gw - da - wa < 0 THEN 'openings_exceed_wall' END AS error FROM x)
SELECT page_id, error, round(a * 0.02::DOUBLE * 0.02::DOUBLE, 6) AS footprint_m2, round(gw, 6) AS gross_wall_m2, round(da, 6) AS door_area_m2,
 round(wa, 6) AS window_area_m2, round(CASE WHEN error IS NULL THEN gw - da - wa END, 6) AS wall_area_m2 FROM y""")


def oriented_query(spark, sf):
    v = A.view(spark, sf, "v_scenarios").select(
        "scenario_id", F.col("floor_area_m2").alias("top"), (F.col("floor_area_m2") * 2).alias("right"), (F.col("floor_area_m2") * 3).alias("bottom"),
        (F.col("floor_area_m2") * 4).alias("left"), F.lit(0.5).alias("scale"), F.lit(2.0).alias("height"),
        F.element_at(F.array(*[F.lit(c) for c in ("north", "east", "south", "west")]), (F.col("scenario_id") % 4 + 1).cast("int")).alias("plan_orientation"))
    return energy.oriented_areas(v).select("scenario_id", *[f"{c}_area_m2" for c in ("north", "east", "south", "west")])


add("E23_oriented_areas", oriented_query, A.with_views("""
SELECT scenario_id, floor_area_m2 * (1 + (4 - scenario_id % 4) % 4) AS north_area_m2, floor_area_m2 * (1 + (5 - scenario_id % 4) % 4) AS east_area_m2,
 floor_area_m2 * (1 + (6 - scenario_id % 4) % 4) AS south_area_m2, floor_area_m2 * (1 + (7 - scenario_id % 4) % 4) AS west_area_m2 FROM v_scenarios""", "v_scenarios"))


def effective_scale_query(spark, sf):
    k = F.col("scenario_id")
    v = A.view(spark, sf, "v_scenarios").select(
        "scenario_id", F.when(k % 2 == 0, "confirmed").otherwise("needs_confirmation").alias("calibration_status"),
        (k % 3 * 0.01).alias("calibrated_scale"), F.when(k % 5 == 0, "").otherwise("manual_two_point").alias("calibration_method"), F.lit(0.05).alias("request_scale"))
    return energy.effective_scale(v).select("scenario_id", "scale", "scale_source")


add("E24_effective_scale", effective_scale_query, A.with_views("""
SELECT scenario_id, CASE WHEN scenario_id % 2 = 0 AND scenario_id % 3 > 0 THEN (scenario_id % 3) * 0.01::DOUBLE ELSE 0.05::DOUBLE END AS scale,
 CASE WHEN scenario_id % 2 = 0 AND scenario_id % 3 > 0 THEN CASE WHEN scenario_id % 5 = 0 THEN 'confirmed_calibration' ELSE 'manual_two_point' END ELSE 'request' END AS scale_source
FROM v_scenarios""", "v_scenarios"))


def two_point_query(spark, sf):
    A.load_tables(spark, sf)
    pts = spark.sql("""SELECT o_orderkey AS id, CAST(o_orderkey % 120 AS DOUBLE) AS ax, CAST(o_orderkey % 90 AS DOUBLE) AS ay, CAST(o_custkey % 110 AS DOUBLE) AS bx,
      CAST(o_custkey % 90 AS DOUBLE) AS by, CASE WHEN o_orderkey % 11 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(o_orderkey % 7 + 1 AS DOUBLE) END AS actual_length,
      CASE o_orderkey % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'MM' ELSE 'cm' END AS unit, 100 AS width, 100 AS height FROM orders""")
    return plan_geometry.two_point_scale(pts).select("id", F.round("scale_m_per_px", 9).alias("scale_m_per_px"), F.array_join("errors", ";").alias("errors"))


add("E25_two_point_scale", two_point_query, """
WITH p AS (SELECT o_orderkey AS id, o_orderkey % 120 AS ax, o_orderkey % 90 AS ay, o_custkey % 110 AS bx, o_custkey % 90 AS by_, CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_orderkey % 7 + 1 END AS len, o_orderkey % 3 AS u FROM orders),
e AS (SELECT *, concat_ws(';', CASE WHEN ax >= 100 OR bx >= 100 THEN 'point_outside_image' END, CASE WHEN ax = bx AND ay = by_ THEN 'points_equal' END,
 CASE WHEN len <= 0 THEN 'length_not_positive' END, CASE WHEN u = 2 THEN 'unknown_unit' END) AS errors FROM p)
SELECT id, CASE WHEN errors = '' THEN round((CASE WHEN u = 1 THEN len / 1000.0::DOUBLE ELSE len::DOUBLE END) / sqrt(((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))::DOUBLE), 9) END AS scale_m_per_px, errors FROM e""")


def _room_frames(spark, sf):
    rooms = A.view(spark, sf, "v_regions").select("page_id", "region_id", (F.col("w") * F.col("h")).cast("double").alias("area_px2"))
    pages = rooms.select("page_id").distinct().withColumns({
        "scale": F.when(F.col("page_id") % 4 == 0, F.lit(None)).otherwise(F.lit(0.05)).cast("double"),
        "manual_exterior_wall_required": F.col("page_id") == 3,
        "closure_status": F.when(F.col("page_id") == 5, "partial").otherwise("closed")})
    return rooms, pages


def scale_rooms_query(spark, sf):
    rooms, pages = _room_frames(spark, sf)
    return plan_geometry.scale_rooms(rooms, pages).select("region_id", "page_id", F.round("area_m2", 6).alias("area_m2"))


add("E26_scale_rooms", scale_rooms_query, A.with_views("""
SELECT region_id, page_id, round(CASE WHEN page_id % 4 <> 0 THEN w * h * 0.05::DOUBLE * 0.05::DOUBLE END, 6) AS area_m2 FROM v_regions""", "v_regions"))


def readiness_query(spark, sf):
    rooms, pages = _room_frames(spark, sf)
    return plan_geometry.room_readiness(plan_geometry.room_totals(rooms), pages).select(
        "page_id", F.col("room_count").cast("bigint"), F.round("total_area_m2", 6).alias("total_area_m2"), "load_geometry_ready")


add("A23_room_totals", readiness_query, A.with_views("""
SELECT page_id, count(*) AS room_count, round(CASE WHEN page_id % 4 <> 0 THEN sum(w * h) * 0.05::DOUBLE * 0.05::DOUBLE END, 6) AS total_area_m2,
 (page_id % 4 <> 0 AND page_id NOT IN (3, 5)) AS load_geometry_ready FROM v_regions GROUP BY page_id""", "v_regions"))


def closed_query(spark, sf):
    rooms, pages = _room_frames(spark, sf)
    roi = pages.select("page_id", (F.lit(20000.0) * (F.col("page_id") + 1)).alias("roi_area"))
    return plan_geometry.already_closed(rooms, roi).select("page_id", "total_px2", "largest_px2", "already_closed")


add("A19_already_closed", closed_query, A.with_views("""
SELECT page_id, sum(w * h)::DOUBLE AS total_px2, max(w * h)::DOUBLE AS largest_px2,
 (sum(w * h) >= 20000 * (page_id + 1) * 0.2::DOUBLE AND max(w * h) >= 20000 * (page_id + 1) * 0.08::DOUBLE) AS already_closed FROM v_regions GROUP BY page_id""", "v_regions"))


def wall_u_query(spark, sf):
    from thermograph.functions import numbers as N
    A.load_tables(spark, sf)
    p = spark.sql("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice / 1000 WHEN p_partkey % 3 = 1 THEN CAST(0 AS DOUBLE) END AS u,
      CASE WHEN p_partkey % 4 < 2 THEN p_retailprice / 500 END AS r, CASE WHEN p_partkey % 5 < 3 THEN CAST(0.04 AS DOUBLE) END AS lam,
      CAST(p_size AS DOUBLE) AS thick, CASE WHEN p_partkey % 7 > 0 THEN CAST(0.8 AS DOUBLE) END AS base FROM part""")
    c = F.col
    u = N.wall_u_from_library(c("u"), c("r"))
    r = N.insulation_resistance(c("r"), u, c("lam"), c("thick"))
    return p.select("id", F.round(u, 9).alias("u_library"), F.round(r, 9).alias("r_insulation"), F.round(N.series_wall_u(c("base"), r, u), 9).alias("u_combined"))


add("N27_N28_wall_u", wall_u_query, """
WITH p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice / 1000 END AS u, CASE WHEN p_partkey % 4 < 2 THEN p_retailprice / 500 END AS r,
 CASE WHEN p_partkey % 5 < 3 THEN 0.04::DOUBLE END AS lam, p_size::DOUBLE AS th, CASE WHEN p_partkey % 7 > 0 THEN 0.8::DOUBLE END AS base FROM part),
q AS (SELECT *, CASE WHEN u IS NOT NULL THEN u WHEN r IS NOT NULL THEN 1 / r END AS ul FROM p),
z AS (SELECT *, CASE WHEN r IS NOT NULL THEN r WHEN ul IS NOT NULL THEN 1 / ul WHEN th > 0 AND lam IS NOT NULL THEN th / 1000 / lam END AS ri FROM q)
SELECT id, round(ul, 9) AS u_library, round(ri, 9) AS r_insulation,
 round(CASE WHEN base IS NOT NULL AND ri IS NOT NULL THEN 1 / (1 / base + ri) WHEN base IS NOT NULL THEN base ELSE ul END, 9) AS u_combined FROM z""")
