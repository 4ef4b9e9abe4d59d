"""Closed-form checks of the annual model and the design loads."""

import pytest
from pyspark.sql import functions as F

from thermograph.functions.scenario import conform_scenarios, section_sql
from thermograph.operators.validate import validate_scenarios
from thermograph.plans.evaluate import evaluate_scenarios, evaluate_with_quarantine, report_rows


def scenario(spark, mode="simple", extra=(), **sections):
    base = {"geometry": dict(floor_area_m2=100, wall_area_m2=50, window_area_m2=10, roof_area_m2=100, door_area_m2=0)}
    base.update(sections)
    text = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    cols = [f"{section_sql(k, **{n: text(x) for n, x in v.items()})} AS {k}" for k, v in base.items()]
    return conform_scenarios(spark.sql(f"SELECT 1L AS scenario_id, '{mode}' AS calculation_mode, {', '.join([*cols, *extra])}"))


def run(df):
    return evaluate_scenarios(df).first().asDict()


def test_cooling_design_load_total(spark):
    r = run(scenario(
        spark, envelope=dict(u_floor=0, u_door=0, peak_solar_irradiance_w_m2=500), cooling=dict(t_set=26, outdoor_design_temperature_c=34)))
    assert r["cl_envelope_transmission"] == pytest.approx(760.0)
    assert r["cl_window_solar"] == pytest.approx(2000.0)
    assert r["cl_fresh_air_sensible"] == pytest.approx(804.0)
    assert r["cl_fresh_air_latent"] == pytest.approx(2825.0)
    assert r["cooling_load_w"] == pytest.approx(9989.0)
    assert r["cooling_index_w_m2"] == pytest.approx(99.89)


def test_annual_use_and_fresh_air(spark):
    r = run(scenario(
        spark, geometry=dict(floor_area_m2=100, wall_area_m2=100, window_area_m2=0, roof_area_m2=0, door_area_m2=0), climate=dict(city_id="xian"),
        envelope=dict(u_wall=1, u_window=0, u_roof=0, u_floor=0, u_door=0, shgc=0), heating=dict(system_type="heat_pump_air", t_set=18, seasonal_efficiency=2)))
    assert (r["occupants"], r["fresh_air_flow"], r["annual_hours"]) == (10.0, 300.0, 3000.0)
    assert r["fresh_air_heating"] == pytest.approx(0.335 * 300 * 2400 * 24 / 1000 * 3000 / 8760)
    assert r["heating_kwh"] == pytest.approx(r["annual_heating_demand"] / 2)
    assert r["winter_design_source"] == "city_database"
    assert r["heating_peak_kw"] == pytest.approx((100 + 0.335 * 300) * 23 / 1000)


def test_presence_differs_from_zero(spark):
    given = run(scenario(spark, ventilation=dict(infiltration_ach=0)))
    absent = run(scenario(spark))
    assert given["infiltration_source"] == "explicit_ach" and absent["infiltration_source"] == "none"


def test_hours_use_old_field_only_alone(spark):
    assert run(scenario(spark, schedule=dict(op_hours=1000)))["annual_hours"] == 1000
    assert run(scenario(spark, schedule=dict(op_hours=1000, daily_operation_hours=10)))["annual_hours"] == 2500


def test_recovery_above_one_is_percent(spark):
    assert run(scenario(spark, ventilation=dict(heat_recovery_efficiency=60)))["heat_recovery"] == pytest.approx(0.6)
    assert run(scenario(spark, ventilation=dict(heat_recovery_efficiency=1)))["heat_recovery"] == 1.0


def test_disabled_side_is_null(spark):
    r = run(scenario(spark, heating=dict(enabled=False)))
    assert r["annual_heating_demand"] is None and r["heating_load_w"] is None and r["heating_kwh"] == 0.0
    assert any("未启用供暖" in n for n in r["model_boundaries"])


WALLS = "array(named_struct('orientation','south','area_m2',30D,'u_value',0.5D), named_struct('orientation','north','area_m2',10D,'u_value',0.9D), named_struct('orientation','east','area_m2',0D,'u_value',9D)) AS walls_by_orientation"
WINDOWS = "map('south', named_struct('area_m2',10D,'u_value',2D,'shgc',0.5D,'air_tightness_value',6D)) AS windows_by_orientation"


def test_detailed_envelope(spark):
    r = run(scenario(spark, mode="detailed", extra=(WALLS, WINDOWS), climate=dict(city_id="xian")))
    assert r["wall_area"] == 40.0 and r["u_wall"] == pytest.approx(0.6)
    assert r["envelope_ua"] == pytest.approx(30 * 0.5 + 10 * 0.9 + 10 * 2)
    assert r["solar_gain"] == pytest.approx(10 * 0.5 * 150 * 200 / 2600)
    assert r["infiltration_ua"] == pytest.approx(0.33 * 0.08 * 10 * 3)
    # design loads keep the given geometry
    assert r["d_envelope_ua"] == pytest.approx(50 * 0.6 + 10 * 2.5 + 100 * 0.4)


def test_roof_counts_in_detail_only_when_flagged(spark):
    flagged = dict(floor_area_m2=100, wall_area_m2=50, window_area_m2=10, roof_area_m2=100, include_roof=True)
    a = run(scenario(spark, mode="detailed", extra=(WALLS, WINDOWS), geometry=flagged))
    b = run(scenario(spark, mode="detailed", extra=(WALLS, WINDOWS)))
    assert a["envelope_ua"] - b["envelope_ua"] == pytest.approx(40.0)


def test_quarantine_and_report_rows(spark):
    bad = scenario(spark, building=dict(floors=1.5), geometry=dict(floor_area_m2=-1))
    errors = validate_scenarios(bad).first().errors
    assert set(errors) == {"building.floors:not_positive_integer", "geometry.floor_area_m2:negative"}
    good, rejected = evaluate_with_quarantine(bad.unionByName(scenario(spark)))
    assert rejected.count() == 1
    row = report_rows(good).first()
    assert row.status == "calculated" and '"rating"' in row.results


def test_simple_mode_has_no_shuffle(spark):
    plan = evaluate_scenarios(scenario(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
