"""Scenario row layout: one row per building, nested sections.

A null leaf means "not given"; branches of the model test for that, so an
explicit zero and an absent value stay distinct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

ORIENTED_ITEM = (
    "orientation:string,area_m2:double,u_value:double,shgc:double,shading_factor:double,"
    "air_tightness_value:double,door_area_m2:double,door_u_value:double"
)

SECTIONS = {
    "geometry": "floor_area_m2:double,wall_area_m2:double,window_area_m2:double,roof_area_m2:double,"
    "door_area_m2:double,floor_loss_area_m2:double,include_roof:boolean,include_floor:boolean",
    "building": "floors:double,height:double,building_type:string",
    "envelope": "u_wall:double,u_window:double,u_win:double,u_roof:double,u_floor:double,u_door:double,shgc:double,"
    "window_shgc:double,curtain_shading:double,peak_solar_irradiance_w_m2:double,solar_orientation_factor:double,"
    "floor_contact_factor:double,annual_solar_irradiation_kwh_m2a:double",
    "climate": "city_id:string",
    "heating": "enabled:boolean,system_type:string,t_set:double,seasonal_efficiency:double,"
    "outdoor_design_temperature_c:double,stable_internal_gain_fraction:double,door_invasion_heat_w:double,"
    "heating_addition_factor:double",
    "cooling": "enabled:boolean,system_type:string,t_set:double,seasonal_efficiency:double,"
    "outdoor_design_temperature_c:double",
    "lighting": "lpd:double,control_factor:double,cooling_load_factor:double",
    "ventilation": "fresh_air_m3h_per_person:double,heat_recovery_efficiency:double,"
    "heat_recovery_efficiency_percent:double,infiltration_ach:double,fan_power_w_per_m3h:double,fan_power:double,"
    "summer_outdoor_relative_humidity_percent:double,summer_indoor_relative_humidity_percent:double,"
    "summer_outdoor_enthalpy_kj_kg:double,summer_indoor_enthalpy_kj_kg:double,atmospheric_pressure_kpa:double,"
    "air_density_kg_m3:double",
    "dhw": "occupants:double,daily_liter_pp:double,efficiency:double",
    "equipment": "epd:double,cooling_load_factor:double",
    "schedule": "op_hours:double,daily_operation_hours:double,annual_operation_days:double",
    "occupancy": "area_per_person_m2:double,sensible_heat_w_per_person:double,latent_heat_w_per_person:double,"
    "cooling_load_factor:double",
}
_LEAF_TYPES = {"double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType()}


def _struct(spec: str) -> T.StructType:
    return T.StructType([T.StructField(n, _LEAF_TYPES[t]) for n, t in (leaf.split(":") for leaf in spec.split(","))])


SCENARIO_SCHEMA = T.StructType(
    [T.StructField("scenario_id", T.LongType()), T.StructField("calculation_mode", T.StringType())]
    + [T.StructField(name, _struct(spec)) for name, spec in SECTIONS.items()]
    + [T.StructField(name, T.ArrayType(_struct(ORIENTED_ITEM))) for name in ("walls_by_orientation", "windows_by_orientation")]
)


def section_sql(name: str, **fields: str) -> str:
    """SQL of one section struct; fields not named become typed nulls."""
    parts = []
    for spec in SECTIONS[name].split(","):
        leaf, dtype = spec.split(":")
        parts.append(f"'{leaf}', CAST({fields.pop(leaf, 'NULL')} AS {dtype})")
    if fields:
        raise ValueError(f"unknown fields of {name}: {sorted(fields)}")
    return f"named_struct({', '.join(parts)})"


def _item_sql(given: list[str], value: str) -> str:
    return "named_struct(" + ", ".join(
        f"'{leaf}', CAST({f'{value}.{leaf}' if leaf in given else 'NULL'} AS {dtype})"
        for leaf, dtype in (x.split(":") for x in ORIENTED_ITEM.split(","))) + ")"


def conform_scenarios(df: DataFrame) -> DataFrame:
    """Bring any scenario table to the full layout; absent parts become null.

    Extra top-level columns are kept in front; map-keyed envelopes are turned
    into item arrays that carry the orientation.
    """
    have = df.schema.fieldNames()
    out = [c for c in have if c not in SCENARIO_SCHEMA.fieldNames()]
    for field in SCENARIO_SCHEMA.fields:
        name = field.name
        dtype = df.schema[name].dataType if name in have else None
        if name in SECTIONS:
            given = dtype.fieldNames() if isinstance(dtype, T.StructType) else []
            sql = section_sql(name, **{k: f"{name}.{k}" for k in given if k in field.dataType.fieldNames()})
        elif dtype is None:
            sql = f"CAST(NULL AS {field.dataType.simpleString()})"
        elif isinstance(dtype, T.MapType):
            item = _item_sql([f for f in dtype.valueType.fieldNames() if f != "orientation"], "e.value")
            item = item.replace("CAST(NULL AS string)", "e.key", 1)
            sql = f"transform(map_entries({name}), e -> {item})"
        elif isinstance(dtype, T.ArrayType):
            sql = f"transform({name}, e -> {_item_sql(dtype.elementType.fieldNames(), 'e')})"
        else:
            sql = f"CAST({name} AS {field.dataType.simpleString()})"
        out.append(f"{sql} AS {name}")
    return df.selectExpr(*out)
