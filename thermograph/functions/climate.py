"""Reference dimensions of the annual model: climate, use, systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thermograph.functions.tables import constant_table

# City, display name, zone, HDD18, CDD26, mean temperature,
# relative humidity, winter and summer design temperature.
CLIMATE = [
    ("harbin", "哈尔滨", "严寒A区", 5100.0, 50.0, 4.2, 62.0, None, None),
    ("urumqi", "乌鲁木齐", "严寒B区", 4300.0, 80.0, 7.0, 55.0, None, None),
    ("beijing", "北京", "寒冷A区", 2800.0, 180.0, 12.6, 57.0, None, None),
    ("dalian", "大连", "寒冷B区", 2900.0, 50.0, 10.9, 65.0, None, None),
    ("xian", "西安", "寒冷B区", 2400.0, 200.0, 13.7, 65.0, -5.0, 34.9),
    ("shanghai", "上海", "夏热冬冷", 1500.0, 350.0, 16.1, 75.0, None, None),
    ("chongqing", "重庆", "夏热冬冷", 1100.0, 450.0, 18.3, 80.0, None, None),
    ("wuhan", "武汉", "夏热冬冷", 1500.0, 400.0, 16.6, 77.0, None, None),
    ("changsha", "长沙", "夏热冬冷", 1400.0, 380.0, 17.2, 78.0, None, None),
    ("nanjing", "南京", "夏热冬冷", 1600.0, 350.0, 15.6, 75.0, None, None),
    ("guangzhou", "广州", "夏热冬暖", 400.0, 650.0, 22.0, 77.0, None, None),
    ("shenzhen", "深圳", "夏热冬暖", 300.0, 700.0, 22.8, 78.0, None, None),
    ("haikou", "海口", "夏热冬暖", 100.0, 900.0, 24.0, 85.0, None, None),
    ("kunming", "昆明", "温和区", 1200.0, 10.0, 15.0, 68.0, None, None),
    ("guiyang", "贵阳", "温和区", 1300.0, 30.0, 15.3, 77.0, None, None),
    ("chengdu", "成都", "夏热冬冷", 1200.0, 250.0, 16.5, 82.0, None, None),
    ("tianjin", "天津", "寒冷A区", 2700.0, 200.0, 12.9, 62.0, None, None),
    ("jinan", "济南", "寒冷B区", 2300.0, 250.0, 14.2, 60.0, None, None),
    ("zhengzhou", "郑州", "寒冷B区", 2200.0, 250.0, 14.5, 63.0, None, None),
    ("hangzhou", "杭州", "夏热冬冷", 1500.0, 350.0, 16.5, 76.0, None, None),
]
CLIMATE_COLUMNS = [
    "city_id", "city_name", "zone", "hdd18", "cdd26", "t_avg", "rh",
    "city_winter_design_c", "city_summer_design_c",
]
CLIMATE_SCHEMA = (
    "city_id string, city_name string, zone string, hdd18 double, cdd26 double, t_avg double, rh double, "
    "city_winter_design_c double, city_summer_design_c double"
)
DEFAULT_CITY = "beijing"

# Type, name, lighting W/m2, equipment W/m2, persons per m2,
# fresh air per person, litres of hot water per person, operating hours.
BUILDING_TYPES = [
    ("office", "办公建筑", 9.0, 15.0, 0.1, 30.0, 5.0, 2500.0),
    ("commercial", "商业建筑", 12.0, 20.0, 0.15, 20.0, 3.0, 3500.0),
    ("hotel", "酒店建筑", 10.0, 10.0, 0.08, 30.0, 80.0, 8760.0),
    ("hospital", "医院建筑", 11.0, 25.0, 0.12, 40.0, 60.0, 8760.0),
    ("school", "学校建筑", 9.0, 10.0, 0.5, 25.0, 5.0, 2000.0),
    ("residential", "居住建筑", 6.0, 8.0, 0.04, 30.0, 50.0, 5000.0),
]
BUILDING_COLUMNS = [
    "building_type", "building_name", "default_lpd", "default_epd", "default_occupancy",
    "default_vent_rate", "default_dhw_liter_pp", "default_op_hours",
]
BUILDING_SCHEMA = (
    "building_type string, building_name string, default_lpd double, default_epd double, "
    "default_occupancy double, default_vent_rate double, default_dhw_liter_pp double, default_op_hours double"
)
DEFAULT_BUILDING = "office"

# Heating systems (nominal efficiency, fuel).
HEATING_SYSTEMS = [
    ("gas_boiler", "燃气锅炉", 0.89, "gas"),
    ("coal_boiler", "燃煤锅炉", 0.75, "coal"),
    ("heat_pump_air", "空气源热泵", 3.2, "electric"),
    ("heat_pump_geo", "地源热泵", 4.5, "electric"),
    ("district", "集中供暖", 0.80, "district"),
    ("electric", "电加热", 0.95, "electric"),
    ("none", "无供暖", 1.0, "none"),
]
HEATING_COLUMNS = ["system_type", "heating_name", "heating_nominal", "heating_fuel"]
HEATING_SCHEMA = "system_type string, heating_name string, heating_nominal double, heating_fuel string"
DEFAULT_HEATING = "gas_boiler"

# Cooling systems (nominal COP).
COOLING_SYSTEMS = [
    ("central_chiller", "中央冷水机组", 5.0),
    ("vrv", "VRV/VRF多联机", 3.8),
    ("split_ac", "分体空调", 3.2),
    ("evaporative", "蒸发冷却", 8.0),
    ("none", "无制冷", 1.0),
]
COOLING_COLUMNS = ["system_type", "cooling_name", "cooling_cop"]
COOLING_SCHEMA = "system_type string, cooling_name string, cooling_cop double"
DEFAULT_COOLING = "central_chiller"

# Solar factor by orientation; anything else uses OTHER.
ORIENTATION_SOLAR = {"south": 1.00, "east": 0.78, "west": 0.86, "north": 0.38}
ORIENTATION_SOLAR_OTHER = 0.70

# Degree days of the older five-city model.
LEGACY_CLIMATE = [
    ("Beijing", 2800.0, 500.0),
    ("Shanghai", 1500.0, 1100.0),
    ("Shenzhen", 500.0, 1800.0),
    ("NewYork", 2600.0, 600.0),
    ("London", 3000.0, 100.0),
]
LEGACY_DEFAULT_CITY = "Beijing"

# Seasonal efficiency defaults of the request layer, which
# differ on purpose from those of the annual model.
REQUEST_HEATING_EFFICIENCY = {
    "heat_pump_air": 1.90, "heat_pump_geo": 1.90, "electric": 1.0, "gas_boiler": 0.89,
    "coal_boiler": 0.75, "district": 0.80, "none": 1.0,
}
REQUEST_COOLING_EFFICIENCY = {
    "central_chiller": 5.0, "vrv": 3.8, "split_ac": 3.2, "evaporative": 8.0, "none": 1.0,
}


def climate_table(spark: SparkSession) -> DataFrame:
    return constant_table(spark, CLIMATE, CLIMATE_SCHEMA)


def building_table(spark: SparkSession) -> DataFrame:
    return constant_table(spark, BUILDING_TYPES, BUILDING_SCHEMA)


def heating_table(spark: SparkSession) -> DataFrame:
    return constant_table(spark, HEATING_SYSTEMS, HEATING_SCHEMA)


def cooling_table(spark: SparkSession) -> DataFrame:
    return constant_table(spark, COOLING_SYSTEMS, COOLING_SCHEMA)


def catalog_options(spark: SparkSession) -> DataFrame:
    """All selectable cities, building types and systems as one long table."""
    rows = (
        [("city", i, r[0], r[1], r[2]) for i, r in enumerate(CLIMATE)]
        + [("building_type", i, r[0], r[1], None) for i, r in enumerate(BUILDING_TYPES)]
        + [("heating", i, r[0], r[1], None) for i, r in enumerate(HEATING_SYSTEMS)]
        + [("cooling", i, r[0], r[1], None) for i, r in enumerate(COOLING_SYSTEMS)]
    )
    return constant_table(spark, rows, "kind string, ord int, id string, name string, zone string")
