"""The flagship job: annual balance plus design loads for every scenario."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermograph.functions.scenario import conform_scenarios
from thermograph.operators.design import design_loads
from thermograph.operators.energy import annual_balance
from thermograph.operators.validate import split_valid, validate_scenarios

SUMMARY_COLUMNS = [
    "scenario_id", "total_kwh", "eui", "rating", "annual_heating_demand", "annual_cooling_demand",
    "heating_kwh", "cooling_kwh", "lighting_kwh", "equipment_kwh", "ventilation_kwh", "dhw_kwh",
    "heating_purchased_kwh", "heating_load_w", "cooling_load_w",
]


def evaluate_scenarios(df: DataFrame) -> DataFrame:
    """Every model output as columns; one narrow stage, small broadcasts only."""
    return conform_scenarios(df).transform(annual_balance).transform(design_loads)


def evaluate_with_quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results of valid scenarios, rejected rows with their errors)."""
    good, bad = split_valid(validate_scenarios(conform_scenarios(df)))
    return evaluate_scenarios(good), bad


def report_rows(df: DataFrame) -> DataFrame:
    """Evaluated scenarios as report rows with JSON payload columns."""
    results = F.to_json(F.struct(
        F.struct(F.col("total_kwh").alias("total_energy_kwh"), "eui", "rating").alias("summary"),
        F.struct("heating_load_w", "cooling_load_w").alias("design_loads")))
    geometry = F.to_json(F.struct("floor_area", "total_area", "wall_area", "window_area", "roof_area", "door_area"))
    return df.select("scenario_id", geometry.alias("geometry_used"), results.alias("results"), F.lit("calculated").alias("status"))
