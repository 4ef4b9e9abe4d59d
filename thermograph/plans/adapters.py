"""Input views over the star-schema test tables, in SQL both engines read.

Each view is a query text over the raw tables. The Spark side reads it with
``view``; an oracle inlines the same text as a common table expression, so
that both start from the same rows and differ only in the operator.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

from thermograph.functions import climate as dims
from thermograph.functions.scenario import conform_scenarios, section_sql
from thermograph.functions.tables import values_clause
from thermograph.session import tune_session

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

VIEWS: dict[str, str] = {}

VIEWS["v_base_scenarios"] = """
SELECT o.o_orderkey AS scenario_id, CAST(c.c_nationkey % 22 AS INT) AS city_idx,
 CAST(o.o_orderkey % 7 AS INT) AS btype_idx, CAST(1 + o.o_orderkey % 6 AS DOUBLE) AS floors,
 CAST(2.8 AS DOUBLE) + CAST(o.o_orderkey % 5 AS DOUBLE) * CAST(0.2 AS DOUBLE) AS height_m,
 CAST(50 + (o.o_orderkey % 37) * 25 AS DOUBLE) AS floor_area_m2,
 CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE CAST(40 + (o.o_orderkey % 29) * 10 AS DOUBLE) END AS wall_area_m2,
 CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE CAST(5 + (o.o_orderkey % 17) * 3 AS DOUBLE) END AS window_area_m2,
 CAST(18 + (o.o_orderkey % 4) AS DOUBLE) AS t_heat, CAST(24 + (o.o_orderkey % 4) AS DOUBLE) AS t_cool,
 CASE WHEN o.o_orderpriority = '1-URGENT' THEN FALSE ELSE TRUE END AS heating_enabled
 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""

_cities = values_clause([(i, r[0]) for i, r in enumerate(dims.CLIMATE)] + [(20, "unknown-city")], ["k", "city_id"], "ci")
_types = values_clause([(i, r[0]) for i, r in enumerate(dims.BUILDING_TYPES)] + [(6, "unknown-type")], ["k", "building_type"], "bt")
_heat = values_clause([(i, r[0]) for i, r in enumerate(dims.HEATING_SYSTEMS)], ["k", "heating_system"], "hs")
_cool = values_clause([(i, r[0]) for i, r in enumerate(dims.COOLING_SYSTEMS)], ["k", "cooling_system"], "cs")

# More leaves vary by key so that presence rules and defaults are exercised.
VIEWS["v_scenarios"] = f"""
SELECT s.*, ci.city_id, bt.building_type, hs.heating_system, cs.cooling_system,
 CASE WHEN scenario_id % 3 = 0 THEN NULL ELSE CAST((scenario_id % 5) * 0.25 AS DOUBLE) END AS infiltration_ach,
 CASE WHEN scenario_id % 4 = 0 THEN CAST(60 AS DOUBLE) WHEN scenario_id % 4 = 1 THEN CAST(0.5 AS DOUBLE) END AS recovery,
 CASE WHEN scenario_id % 9 = 0 THEN CAST(45 AS DOUBLE) END AS recovery_percent,
 CASE WHEN scenario_id % 5 = 0 THEN NULL ELSE CAST(8 + scenario_id % 10 AS DOUBLE) END AS daily_hours,
 CASE WHEN scenario_id % 10 = 0 THEN CAST(3000 AS DOUBLE) END AS op_hours,
 CASE WHEN scenario_id % 6 = 0 THEN CAST(-7.5 AS DOUBLE) END AS winter_c,
 CASE WHEN scenario_id % 8 = 0 THEN CAST(33.5 AS DOUBLE) END AS summer_c,
 CASE WHEN scenario_id % 7 = 3 THEN CAST(55 AS DOUBLE) END AS outdoor_rh,
 CASE WHEN scenario_id % 7 = 3 OR scenario_id % 7 = 4 THEN CAST(50 AS DOUBLE) END AS indoor_rh,
 CASE WHEN scenario_id % 5 = 1 THEN CAST(0.3 AS DOUBLE) END AS stable_fraction,
 CASE WHEN scenario_id % 5 = 2 THEN CAST(1.1 AS DOUBLE) END AS addition_factor
FROM ({VIEWS["v_base_scenarios"]}) s
LEFT JOIN {_cities} ON s.city_idx = ci.k
LEFT JOIN {_types} ON s.btype_idx = bt.k
LEFT JOIN {_heat} ON s.scenario_id % 8 = hs.k
LEFT JOIN {_cool} ON s.scenario_id % 6 = cs.k"""

VIEWS["v_orientation_items"] = """
SELECT o.o_orderkey AS scenario_id, d.orientation,
 CAST((o.o_orderkey * d.k) % 60 AS DOUBLE) AS area_m2, CAST((o.o_orderkey + d.k) % 5 AS DOUBLE) * CAST(0.5 AS DOUBLE) AS u_value,
 CAST((o.o_orderkey + d.k) % 4 AS DOUBLE) * CAST(0.2 AS DOUBLE) AS shgc
 FROM orders o CROSS JOIN (SELECT 'south' AS orientation, 3 AS k UNION ALL SELECT 'east', 5 UNION ALL SELECT 'west', 7 UNION ALL SELECT 'north', 11 UNION ALL SELECT 'skew', 13) d"""

VIEWS["v_segments"] = """
SELECT DISTINCT l_orderkey % 50 AS page_id, CASE WHEN l_partkey % 2 = 0 THEN 'horizontal' ELSE 'vertical' END AS orientation,
 CAST(l_suppkey * 7 AS BIGINT) AS fixed, CAST((l_orderkey * 13 + l_linenumber * 31) % 400 AS BIGINT) AS axis_start,
 CAST((l_orderkey * 13 + l_linenumber * 31) % 400 + CAST(l_quantity AS BIGINT) AS BIGINT) AS axis_end,
 l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS seg_id, l_discount * 4 AS brightness FROM lineitem"""

VIEWS["v_reports"] = """
SELECT o_orderkey AS id, CAST(o_custkey % 30 AS VARCHAR(10)) AS username, CAST(o_orderkey % 20 AS VARCHAR(10)) AS report_number,
 o_orderdate AS created_at, o_orderstatus AS status, o_totalprice AS total_energy FROM orders"""

VIEWS["v_attempts"] = """
SELECT event_id, ts, CASE WHEN event_type = 'signup' THEN 'register' ELSE 'login' END AS action,
 user_id % 5 AS address, user_id AS username FROM events"""

VIEWS["v_meta"] = """
SELECT conv_id AS report_id, turn AS pos, role AS field, text AS value FROM conversations"""

VIEWS["v_options"] = """
SELECT p_partkey AS id, p_type AS category, p_name AS name, p_retailprice / 1000 AS value, p_brand AS source FROM part"""

VIEWS["v_regions"] = """
SELECT p_size % 10 AS page_id, p_partkey AS region_id, p_partkey % 2 AS snapshot, (p_partkey * 17) % 90 AS x, (p_partkey * 29) % 70 AS y,
 10 + p_size AS w, 8 + p_size AS h FROM part"""


_NAMED = re.compile(r"\b(" + "|".join(TABLES) + r")\b")
_LOADED = WeakKeyDictionary()


def load_tables(spark: SparkSession, sf_dir: str, names: Iterable[str] = TABLES) -> None:
    """Register raw tables as temporary views, each once per session and folder."""
    tune_session(spark)
    loaded = _LOADED.setdefault(spark, {})
    for t in names:
        if loaded.get(t) != sf_dir or not spark.catalog.tableExists(t):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
            loaded[t] = sf_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tune_session(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    load_tables(spark, sf_dir, sorted(set(_NAMED.findall(VIEWS[name]))))
    return spark.sql(VIEWS[name])


def with_views(sql: str, *names: str) -> str:
    """An oracle query with the named views inlined in front."""
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH {ctes} {sql}"


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``v_scenarios`` in the nested scenario layout."""
    parts = {
        "geometry": section_sql("geometry", floor_area_m2="floor_area_m2", wall_area_m2="wall_area_m2", window_area_m2="window_area_m2"),
        "building": section_sql("building", floors="floors", height="height_m", building_type="building_type"),
        "climate": section_sql("climate", city_id="city_id"),
        "heating": section_sql("heating", enabled="heating_enabled", system_type="heating_system", t_set="t_heat", outdoor_design_temperature_c="winter_c",
                               stable_internal_gain_fraction="stable_fraction", heating_addition_factor="addition_factor"),
        "cooling": section_sql("cooling", system_type="cooling_system", t_set="t_cool", outdoor_design_temperature_c="summer_c"),
        "ventilation": section_sql("ventilation", infiltration_ach="infiltration_ach", heat_recovery_efficiency="recovery",
                                   heat_recovery_efficiency_percent="recovery_percent", summer_outdoor_relative_humidity_percent="outdoor_rh",
                                   summer_indoor_relative_humidity_percent="indoor_rh"),
        "schedule": section_sql("schedule", op_hours="op_hours", daily_operation_hours="daily_hours"),
    }
    v = view(spark, sf_dir, "v_scenarios")
    return conform_scenarios(v.selectExpr("scenario_id", *[f"{sql} AS {k}" for k, sql in parts.items()]))
