"""Envelopes described orientation by orientation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermograph.functions.climate import ORIENTATION_SOLAR, ORIENTATION_SOLAR_OTHER
from thermograph.functions.stages import add_columns


def positive(c: Column) -> Column:
    return F.when(c > 0, c)


def solar_factor(orientation: Column) -> Column:
    expr = F.lit(ORIENTATION_SOLAR_OTHER)
    for name, factor in ORIENTATION_SOLAR.items():
        expr = F.when(orientation == name, factor).otherwise(expr)
    return expr


def leakage_ua(tightness: Column, window_area: Column) -> Column:
    """Loss through window joints, W/K, from the tightness grade."""
    ach = F.greatest(F.lit(0.0), (8.0 - tightness) * 0.04)
    return 0.33 * ach * window_area * 3.0


def area_weighted(df: DataFrame, keys: list[str], values: dict[str, tuple[str, str]]) -> DataFrame:
    """Area sum and area-weighted mean per key over long-form items.

    ``values`` maps an output prefix to (area column, value column). Only rows
    where both are positive count; a prefix without such rows stays null.
    """
    aggs = []
    for prefix, (area, value) in values.items():
        both = (F.col(area) > 0) & (F.col(value) > 0)
        a = F.when(both, F.col(area))
        aggs += [F.sum(a).alias(f"{prefix}_area_m2"),
                 (F.sum(a * F.col(value)) / F.sum(a)).alias(f"{prefix}_value")]
    return df.groupBy(*keys).agg(*aggs)


def _item_sum(items: str, term: str) -> str:
    """SQL: sum of a per-item term ``e`` over the row's own (short) array."""
    return f"coalesce(aggregate({items}, 0D, (acc, e) -> acc + coalesce({term}, 0D)), 0D)"


def _pair(items: str, prefix: str, area: str, value: str) -> dict[str, str]:
    both = f"e.{area} > 0 AND e.{value} > 0"
    total = _item_sum(items, f"CASE WHEN {both} THEN e.{area} END")
    weighted = _item_sum(items, f"CASE WHEN {both} THEN e.{area} * e.{value} END")
    on = "calculation_mode = 'detailed'"
    return {f"{prefix}_area_item": f"CASE WHEN {on} AND {total} > 0 THEN {total} END",
            f"{prefix}_value_item": f"CASE WHEN {on} AND {total} > 0 THEN {weighted} / {total} END"}


def normalize_detailed_envelope(df: DataFrame) -> DataFrame:
    """In detailed mode: item areas and area-weighted means per component.

    Adds ``<part>_area_item`` and ``<part>_value_item`` (null when they do not
    apply); later stages prefer them over the given values. Items live in the
    scenario row, so this is a projection without a shuffle.
    """
    exprs: dict[str, str] = {}
    for prefix, items, area, value in (
        ("wall", "walls_by_orientation", "area_m2", "u_value"), ("window", "windows_by_orientation", "area_m2", "u_value"),
        ("shgc", "windows_by_orientation", "area_m2", "shgc"), ("door", "windows_by_orientation", "door_area_m2", "door_u_value"),
    ):
        exprs.update(_pair(items, prefix, area, value))
    return add_columns(df, exprs)


def solar_factor_sql(orientation: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}D" for k, v in ORIENTATION_SOLAR.items())
    return f"CASE {orientation} {whens} ELSE {ORIENTATION_SOLAR_OTHER}D END"


def with_detailed_loads(df: DataFrame) -> DataFrame:
    """Transmission UA, solar gain and joint leakage of a detailed envelope.

    Needs ``floor_area``, ``roof_area``, ``hdd18`` and ``cdd26``. Roof and
    floor count only when their flag is true.
    """
    w = "windows_by_orientation"
    pos = lambda f: f"CASE WHEN e.{f} > 0 THEN e.{f} END"
    tight = f"coalesce({pos('air_tightness_value')}, 6D)"
    return add_columns(df, {
        "detail_ua_wall": _item_sum("walls_by_orientation", f"{pos('area_m2')} * {pos('u_value')}"),
        "detail_ua_window": _item_sum(w, f"{pos('area_m2')} * {pos('u_value')}"),
        "detail_ua_door": _item_sum(w, f"{pos('door_area_m2')} * {pos('door_u_value')}"),
        "detail_solar_unit": _item_sum(
            w, f"{pos('area_m2')} * {pos('shgc')} * coalesce({pos('shading_factor')}, 1D) * {solar_factor_sql('e.orientation')}"),
        "detail_leakage": "CASE WHEN ventilation.infiltration_ach IS NOT NULL THEN 0D ELSE "
        + _item_sum(w, f"0.33D * greatest(0D, (8D - {tight}) * 0.04D) * {pos('area_m2')} * 3D") + " END",
        "detail_ua_roof": "CASE WHEN geometry.include_roof THEN coalesce(envelope.u_roof, 0.4D) * roof_area ELSE 0D END",
        "detail_ua_floor": "CASE WHEN geometry.include_floor THEN coalesce(envelope.u_floor, 0.3D) * floor_area"
        " * greatest(0D, coalesce(envelope.floor_contact_factor, 1D)) ELSE 0D END",
        "detail_transmission_ua": "detail_ua_wall + detail_ua_window + detail_ua_door + detail_ua_roof + detail_ua_floor",
        "detail_solar_gain": "detail_solar_unit * greatest(0D, coalesce(envelope.annual_solar_irradiation_kwh_m2a, 150D))"
        " * (cdd26 / greatest(cdd26 + hdd18, 1D))",
    })


def orientation_loads(items: DataFrame, hdd: str = "hdd18", cdd: str = "cdd26") -> DataFrame:
    """Per scenario and orientation: UA, solar gain and leakage (long form).

    ``items`` has one row per scenario, orientation and kind ('wall' or
    'window') with the item fields plus degree days, ``irradiation`` and
    ``explicit_ach``. Sums combine map-side before the shuffle.
    """
    window = F.col("kind") == "window"
    wall = F.col("kind") == "wall"
    area = F.coalesce(positive(F.col("area_m2")), F.lit(0.0))
    u = F.coalesce(positive(F.col("u_value")), F.lit(0.0))
    solar = (area * F.coalesce(positive(F.col("shgc")), F.lit(0.0))
             * F.coalesce(positive(F.col("shading_factor")), F.lit(1.0)) * F.col("irradiation")
             * solar_factor(F.col("orientation"))
             * (F.col(cdd) / F.greatest(F.col(cdd) + F.col(hdd), F.lit(1.0))))
    leak = leakage_ua(F.coalesce(positive(F.col("air_tightness_value")), F.lit(6.0)), area)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return items.groupBy("scenario_id", "orientation").agg(
        zero(F.when(wall, area * u)).alias("ua_wall"),
        zero(F.when(window, area * u)).alias("ua_window"),
        zero(F.when(window, F.coalesce(positive(F.col("door_area_m2")), F.lit(0.0))
                    * F.coalesce(positive(F.col("door_u_value")), F.lit(0.0)))).alias("ua_door"),
        zero(F.when(window, solar)).alias("solar_gain"),
        zero(F.when(window & ~F.col("explicit_ach"), leak)).alias("infiltration_ua"),
    )


def loads_by_orientation_maps(loads: DataFrame) -> DataFrame:
    """Fold the long form back to one row with a map per quantity."""
    cols = ["ua_wall", "ua_window", "ua_door", "solar_gain", "infiltration_ua"]
    return loads.groupBy("scenario_id").agg(
        *[F.map_from_entries(F.array_sort(F.collect_list(F.struct("orientation", c)))).alias(f"{c}_by_orientation")
          for c in cols])
