"""Scenario checks: an errors array per row instead of an exception."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermograph.functions.scenario import SECTIONS
from thermograph.functions.stages import add_columns


def scenario_checks() -> dict[str, str]:
    """Error code -> SQL condition that makes a scenario unusable."""
    bad = {}
    for section, spec in SECTIONS.items():
        for leaf in spec.split(","):
            name, dtype = leaf.split(":")
            if dtype == "double":
                path = f"{section}.{name}"
                bad[f"{path}:not_finite"] = f"isnan({path}) OR abs({path}) = double('infinity')"
    bad["no_side_enabled"] = "NOT coalesce(heating.enabled, true) AND NOT coalesce(cooling.enabled, true)"
    bad["building.floors:not_positive_integer"] = "building.floors <= 0 OR building.floors <> floor(building.floors)"
    bad["building.height:not_positive"] = "building.height <= 0"
    for leaf in ("floor_area_m2", "wall_area_m2", "window_area_m2", "roof_area_m2", "door_area_m2"):
        bad[f"geometry.{leaf}:negative"] = f"geometry.{leaf} < 0"
    bad["occupancy.area_per_person_m2:not_positive"] = "occupancy.area_per_person_m2 <= 0"
    for path in ("ventilation.fresh_air_m3h_per_person", "ventilation.fan_power_w_per_m3h", "dhw.occupants", "dhw.daily_liter_pp"):
        bad[f"{path}:negative"] = f"{path} < 0"
    for path, hi in (("ventilation.heat_recovery_efficiency_percent", 100), ("ventilation.heat_recovery_efficiency", 100),
                     ("ventilation.infiltration_ach", 20), ("schedule.daily_operation_hours", 24), ("schedule.annual_operation_days", 365)):
        bad[f"{path}:out_of_range"] = f"{path} NOT BETWEEN 0 AND {hi}"
    bad["schedule.op_hours:out_of_range"] = ("schedule.daily_operation_hours IS NULL AND schedule.annual_operation_days IS NULL "
                                             "AND schedule.op_hours NOT BETWEEN 0 AND 8760")
    bad["heating.seasonal_efficiency:not_positive"] = ("heating.seasonal_efficiency <= 0 AND coalesce(heating.system_type, '') <> 'electric'")
    for path in ("cooling.seasonal_efficiency", "dhw.efficiency"):
        bad[f"{path}:not_positive"] = f"{path} <= 0"
    for items, leaf in (("walls_by_orientation", "area_m2"), ("windows_by_orientation", "area_m2"), ("windows_by_orientation", "door_area_m2")):
        bad[f"{items}.{leaf}:negative"] = f"calculation_mode = 'detailed' AND exists({items}, e -> e.{leaf} < 0)"
    return bad


def validate_scenarios(df: DataFrame) -> DataFrame:
    """Add ``errors``; an empty array means the scenario can be evaluated."""
    marks = ", ".join(f"CASE WHEN {cond} THEN '{code}' END" for code, cond in scenario_checks().items())
    return add_columns(df, {"errors": f"array_compact(array({marks}))"})


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine) from a validated table."""
    ok = F.size("errors") == 0
    return df.filter(ok).drop("errors"), df.filter(~ok)
