"""Heating and cooling design loads over conformed scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame

from thermograph.functions.stages import add_columns
from thermograph.operators.energy import AIR_HEAT


def _enthalpy_sql(t: str, rh: str, pressure: str) -> str:
    """Moist-air enthalpy, kJ per kg dry air."""
    vapor = f"({rh} / 100D * (0.61078D * exp((17.2694D * {t}) / ({t} + 237.3D))))"
    return f"1.006D * {t} + 0.62198D * {vapor} / greatest({pressure} - {vapor}, 0.001D) * (2501D + 1.86D * {t})"


def design_base(df: DataFrame) -> DataFrame:
    """Areas, UA, flows and internal gains (prefix ``d_``).

    Reads the given geometry, not the one resolved for the annual model:
    absent wall or window areas count as zero, the roof always counts and
    storeys are truncated to whole numbers.
    """
    out = {
        "d_floor_area": "geometry.floor_area_m2",
        "d_total_area": "d_floor_area * CAST(floor(coalesce(building.floors, 1D)) AS DOUBLE)",
        "d_window_area": "coalesce(geometry.window_area_m2, 0D)",
        "d_floor_loss_source": "CASE WHEN geometry.include_floor THEN 'include_floor' ELSE 'explicit_floor_loss_area_m2' END",
        "d_floor_loss_area": "CASE WHEN geometry.include_floor THEN d_floor_area * coalesce(envelope.floor_contact_factor, 1D) "
        "ELSE coalesce(geometry.floor_loss_area_m2, 0D) END",
        "d_occupants": "d_total_area / coalesce(occupancy.area_per_person_m2, 10D)",
        "d_fresh_air_flow": "d_occupants * coalesce(ventilation.fresh_air_m3h_per_person, 30D)",
        "d_infiltration_flow": "d_total_area * coalesce(building.height, 3D) * coalesce(ventilation.infiltration_ach, 0D)",
        "d_envelope_ua": "coalesce(geometry.wall_area_m2, 0D) * coalesce(envelope.u_wall, 0.6D) "
        "+ d_window_area * coalesce(envelope.u_window, envelope.u_win, 2.5D) "
        "+ coalesce(geometry.roof_area_m2, d_floor_area) * coalesce(envelope.u_roof, 0.4D) "
        "+ d_floor_loss_area * coalesce(envelope.u_floor, 0.3D) "
        "+ coalesce(geometry.door_area_m2, 0D) * coalesce(envelope.u_door, 3D)",
        "d_people_sensible_w": "d_occupants * coalesce(occupancy.sensible_heat_w_per_person, 75D) * coalesce(occupancy.cooling_load_factor, 1D)",
        "d_people_latent_w": "d_occupants * coalesce(occupancy.latent_heat_w_per_person, 55D)",
        "d_lighting_w": "d_total_area * coalesce(lighting.lpd, 8D) * coalesce(lighting.control_factor, 1D) * coalesce(lighting.cooling_load_factor, 1D)",
        "d_equipment_w": "d_total_area * coalesce(equipment.epd, 15D) * coalesce(equipment.cooling_load_factor, 1D)",
        "d_air_density": "coalesce(ventilation.air_density_kg_m3, 1.13D)",
        "d_pressure": "coalesce(ventilation.atmospheric_pressure_kpa, 101.325D)",
        "d_outdoor_c": "coalesce(cooling.outdoor_design_temperature_c, 34.9D)",
        "d_indoor_c": "coalesce(cooling.t_set, 26D)",
    }
    for side, default in (("outdoor", 85), ("indoor", 55)):
        rh = f"ventilation.summer_{side}_relative_humidity_percent"
        out[f"d_{side}_enthalpy"] = (f"CASE WHEN {rh} IS NOT NULL THEN {_enthalpy_sql(f'd_{side}_c', rh, 'd_pressure')} "
                                     f"ELSE coalesce(ventilation.summer_{side}_enthalpy_kj_kg, {default}D) END")
        out[f"d_{side}_enthalpy_source"] = f"CASE WHEN {rh} IS NOT NULL THEN 'temperature_relative_humidity' ELSE 'explicit_enthalpy_or_default' END"
    return add_columns(df, out)


# Cooling components in order; only positive ones enter the total.
COOLING_PARTS = {
    "envelope_transmission": "d_envelope_ua * d_cooling_dt",
    "window_solar": "d_window_area * coalesce(envelope.window_shgc, envelope.shgc, 0.4D) * coalesce(envelope.peak_solar_irradiance_w_m2, 250D) "
    "* coalesce(envelope.solar_orientation_factor, 1D) * coalesce(envelope.curtain_shading, 1D)",
    "fresh_air_sensible": f"{AIR_HEAT}D * d_fresh_air_flow * d_cooling_dt",
    "fresh_air_latent": "d_air_density * d_fresh_air_flow * d_dh / 3.6D",
    "infiltration_sensible": f"{AIR_HEAT}D * d_infiltration_flow * d_cooling_dt",
    "infiltration_latent": "d_air_density * d_infiltration_flow * d_dh / 3.6D",
    "people": "d_people_sensible_w + d_people_latent_w",
    "lighting": "d_lighting_w",
    "equipment": "d_equipment_w",
}


def cooling_design_load(df: DataFrame) -> DataFrame:
    """Nine components (``cl_*``), total and index; null when disabled."""
    return add_columns(df, {
        "cooling_load_on": "coalesce(cooling.enabled, true)",
        "d_cooling_dt": "greatest(0D, d_outdoor_c - d_indoor_c)",
        "d_dh": "greatest(0D, d_outdoor_enthalpy - d_indoor_enthalpy)",
        **{f"cl_{k}": f"CASE WHEN cooling_load_on THEN {sql} END" for k, sql in COOLING_PARTS.items()},
        "cooling_load_w": "CASE WHEN cooling_load_on THEN " + " + ".join(f"greatest(cl_{k}, 0D)" for k in COOLING_PARTS) + " END",
        "cooling_index_w_m2": "cooling_load_w / d_total_area",
    })


def heating_design_load(df: DataFrame) -> DataFrame:
    """Losses plus addition factor minus stable gains (``hl_*``), floor zero."""
    on = lambda sql: f"CASE WHEN heating_load_on THEN {sql} END"
    return add_columns(df, {
        "heating_load_on": "coalesce(heating.enabled, true)",
        "d_heating_dt": "greatest(0D, coalesce(heating.t_set, 18D) - coalesce(heating.outdoor_design_temperature_c, -5D))",
        "hl_envelope_basic": on("d_envelope_ua * d_heating_dt"),
        "hl_fresh_air": on(f"{AIR_HEAT}D * d_fresh_air_flow * d_heating_dt"),
        "hl_infiltration": on(f"{AIR_HEAT}D * d_infiltration_flow * d_heating_dt"),
        "hl_door_invasion": on("coalesce(heating.door_invasion_heat_w, 0D)"),
        "hl_losses": "hl_envelope_basic + hl_fresh_air + hl_infiltration + hl_door_invasion",
        "hl_addition": "hl_losses * (coalesce(heating.heating_addition_factor, 1D) - 1D)",
        "hl_gain_deduction": on("(d_people_sensible_w + d_people_latent_w + d_lighting_w + d_equipment_w) "
                                "* least(coalesce(heating.stable_internal_gain_fraction, 0D), 1D)"),
        "heating_load_w": on("greatest(0D, hl_losses + hl_addition - hl_gain_deduction)"),
        "heating_index_w_m2": "heating_load_w / d_total_area",
    })


def design_loads(df: DataFrame) -> DataFrame:
    return df.transform(design_base).transform(heating_design_load).transform(cooling_design_load)
