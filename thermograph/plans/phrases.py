"""Report-like text derived from the test tables.

The tables hold invented European prose; the domain rules look for Chinese
report wording. These views compose such wording row by row from table keys,
so that text volume grows with the tables.
"""

from __future__ import annotations

from thermograph.functions.tables import values_clause
from thermograph.plans.adapters import VIEWS

SUBJECTS = [
    "外窗 中空玻璃", "岩棉保温板", "种植屋面 防水卷材", "架空楼板 地面", "外门 入户门", "外墙 加气混凝土砌块", "遮阳帘 遮阳系数", "门窗 气密性能",
    "导光管采光系统", "动车车门", "空气源热泵 COP", "太阳得热系数 SHGC", "幕墙 铝合金型材", "外墙外保温 薄抹灰", "LED 照明灯具", "风机盘管 新风 风量",
    "玻璃纤维网布", "lighting fixture", "聚氨酯 保温系统", "塑料窗 Low-E", "太阳能集热器", "预制夹心剪力墙", "木门 折叠门", "无关文本",
]
PARAMS = [
    "传热系数", "导热系数", "热阻 R =", "SHGC=", "U值", "厚度", "烟密度", "尺寸偏差 长度", "断裂伸长率", "储能密度", "可见光透射比", "表观密度 kg",
    "检验结论:", "太阳能总透射比", "Thermal Conductivity", "额定功率", "传热系数 K=",
]
UNITS = [
    " W/(m2·K)", " W/(m·K)", " m2·K/W", "W/㎡·K", " W / ( m² . K )", " kg/m3", " mm", "%", "", " (m²·K)/W。合格", "W/m·K；符合",
]

_s = values_clause(list(enumerate(SUBJECTS)), ["k", "subject"], "sj")
_p = values_clause(list(enumerate(PARAMS)), ["k", "param"], "pa")
_u = values_clause(list(enumerate(UNITS)), ["k", "unit_text"], "un")


def _lines(select_id: str, key: str, table: str) -> str:
    return f"""
SELECT {select_id}, sj.subject, pa.param, un.unit_text,
 CAST({key} % 12 AS VARCHAR(4)) || '.' || CAST({key} % 97 AS VARCHAR(4)) AS number_text,
 sj.subject || '　 ' || pa.param || ' ' || CAST({key} % 12 AS VARCHAR(4)) || '.' || CAST({key} % 97 AS VARCHAR(4)) || un.unit_text AS text
FROM {table} JOIN {_s} ON sj.k = {key} % {len(SUBJECTS)} JOIN {_p} ON pa.k = {key} % {len(PARAMS)} JOIN {_u} ON un.k = {key} % {len(UNITS)}"""


# one line per order, grouped under its customer as the report
VIEWS["v_lines"] = _lines("o_orderkey AS line_id, o_custkey AS report_id", "o_orderkey", "orders")
# one card per customer
VIEWS["v_cards"] = _lines("c_custkey AS report_id", "(c_custkey * 7 + c_nationkey)", "customer")
# measured parameters: one row per order, other phase than the lines
VIEWS["v_params"] = _lines("o_orderkey AS pos, o_custkey AS report_id", "(o_orderkey * 5 + 3)", "orders")
