"""Keyword lists and ordered rule tables.

Every list keeps its order of trial; the first match decides.
"""

# Words that make a report line worth keeping.
RELEVANT_KEYWORDS = [
    "热阻", "导热系数", "传热系数", "热惰性", "蓄热", "密度", "比热", "单位面积质量", "厚度", "遮阳", "太阳得热", "透射比",
    "SHGC", "COP", "EER", "LPD", "EPD", "功率", "效率",
]

# Metadata fields by alias, for reports in general.
META_ALIASES = {
    "sample_name": ("样品名称", "sample name", "产品名称", "设备名称"),
    "manufacturer": ("生产单位", "制造商", "manufacturer", "生产厂家", "厂家"),
    "brand": ("商标", "商 标", "brand"),
    "spec_model": ("规格型号", "型号规格", "规格", "型号", "type/model", "model"),
    "production_date": ("生产日期", "出厂日期", "manufacture date"),
    "sample_no": ("样品编号", "sample no", "样品号"),
    "test_type": ("检验类别", "检测类别", "test type"),
    "test_basis": ("检验依据", "检测依据", "test basis", "standard"),
    "test_items": ("检验项目", "检测项目", "test items"),
    "test_date": ("检验日期", "检测日期", "test date"),
    "test_conclusion": ("检验结论", "检测结论", "test conclusion"),
}
# The same for window reports and for wall-insulation reports.
WINDOW_META_ALIASES = {
    "sample_name": ("样品名称", "产品名称", "sample name"),
    "manufacturer": ("生产单位", "生产厂家", "厂家", "manufacturer"),
    "brand": ("商标", "商 标", "brand"),
    "spec_model": ("规格型号", "型号规格", "规格", "型号", "type/model", "model"),
    "sample_no": ("样品编号", "样品号", "sample no"),
    "test_basis": ("检验依据", "检测依据", "test basis", "test standard", "standard"),
    "test_items": ("检验项目", "检测项目", "test items"),
    "test_conclusion": ("检验结论", "检测结论", "test conclusion"),
}
WALL_META_ALIASES = {
    "sample_name": ("样品名称", "sample name", "产品名称"),
    "manufacturer": ("生产单位", "manufacturer", "生产厂家", "厂家"),
    "brand": ("商标", "商 标", "brand"),
    "spec_model": ("规格型号", "型号规格", "规格", "型号", "type/model", "model"),
    "production_date": ("生产日期", "出厂日期"),
    "sample_no": ("样品编号", "sample no", "样品号"),
    "test_basis": ("检验依据", "检测依据", "test basis", "standard"),
    "test_items": ("检验项目", "检测项目", "test items"),
    "test_conclusion": ("检验结论", "检测结论", "test conclusion"),
}
# Fields that keep a list of distinct values; the others keep the first.
LIST_META_KEYS = ("test_items", "test_basis", "test_conclusion")

# Metadata prefixes of the SQL-dump source.
DUMP_META_FIELDS = {
    "样品名称": "sample_name", "生产单位": "manufacturer", "规格型号": "spec_model", "检验依据": "test_basis",
    "判定依据": "criteria_basis", "检验项目": "test_items", "检验结论": "test_conclusion", "商 标": "brand",
}

# Parameter types of the dump source: (type, words; upper-cased text for Latin).
DUMP_PARAMETER_RULES = [
    ("thermal_conductivity_lambda", ("导热系数",)), ("thermal_resistance_r", ("热阻",)), ("u_value", ("传热系数",)),
    ("density", ("密度",)), ("specific_heat", ("比热",)), ("mass_per_area", ("单位面积质量",)), ("thickness", ("厚度",)),
    ("shgc", ("太阳得热", "SHGC")), ("transmittance", ("透射比",)), ("airtightness", ("气密",)), ("cop", ("COP",)), ("eer", ("EER",)),
]

# Focused extraction: (type, keywords, default unit) in order.
FOCUSED_PATTERNS = [
    ("thermal_transmittance_u", ("传热系数", "u值", "u 值", "u-value", "heat transfer coefficient"), "W/(m2·K)"),
    ("thermal_resistance_r", ("热阻", "传热阻", "thermal resistance"), "m2·K/W"),
    ("thermal_conductivity_lambda", ("导热系数", "thermal conductivity"), "W/(m·K)"),
    ("shgc_or_shading", ("遮阳系数", "太阳得热", "shgc", "得热系数"), ""),
    ("thickness", ("厚度",), "mm"),
    ("dimension", ("尺寸", "长度", "宽度", "高度", "长宽高"), "mm"),
    ("density", ("密度", "表观密度"), "kg/m3"),
    ("cooling_capacity", ("制冷量", "名义制冷量"), "W"),
    ("heating_capacity", ("制热量", "名义制热量"), "W"),
    ("input_power", ("输入功率", "功率"), "W"),
    ("energy_efficiency", ("cop", "eer", "能效", "性能系数"), ""),
    ("air_volume", ("风量", "新风量"), "m3/h"),
    ("luminous_flux", ("光通量",), "lm"),
    ("lighting_power", ("灯功率", "额定功率", "功率"), "W"),
]
_SOLID = ("thermal_transmittance_u", "thermal_resistance_r", "thermal_conductivity_lambda", "thickness", "dimension", "density")
CATEGORY_PARAMETER_TYPES = {
    "exterior_wall": _SOLID,
    "wall_insulation": ("thermal_transmittance_u", "thermal_resistance_r", "thermal_conductivity_lambda"),
    "windows": ("thermal_transmittance_u", "shgc_or_shading", "thickness", "dimension"),
    "roof": _SOLID,
    "floor": _SOLID,
    "curtain_shading": ("shgc_or_shading", "thermal_transmittance_u", "thickness", "dimension"),
    "hvac_system": ("cooling_capacity", "heating_capacity", "input_power", "energy_efficiency", "air_volume"),
    "lighting": ("lighting_power", "luminous_flux", "input_power", "energy_efficiency"),
}
DIMENSION_CHECK_CONTEXT = ("经纬密度", "断裂伸长率", "尺寸稳定性", "变化率", "断裂", "压缩", "拉伸", "燃烧", "吸水")
DENSITY_REJECT_CONTEXT = ("烟密度", "湿流密度", "线密度", "经纬密度", "光密度")

# Wall-report rows: (type, keywords, default unit).
WALL_ITEM_RULES = [
    ("thermal_transmittance_u", ("传热系数", "u值", "u 值", "u-value"), "W/(m2·K)"),
    ("thermal_resistance_r", ("热阻", "传热阻"), "m2·K/W"),
    ("thermal_conductivity_lambda", ("导热系数",), "W/(m·K)"),
]

# Window evidence.
WINDOW_PARAMETERS = [
    ("window_u", "传热系数", ("传热系数", "u值", "u 值", "u-value", "thermal transmittance"), "W/m²·K"),
    ("window_shgc", "太阳得热系数", ("太阳得热系数", "太阳能总透射比", "遮阳系数", "shgc", "solar heat gain"), ""),
    ("visible_transmittance", "可见光透射比", ("可见光透射比", "visible light transmittance"), ""),
]
WINDOW_ALLOW = (
    "门窗", "外窗", "窗", "幕墙", "中空玻璃", "真空玻璃", "Low-E", "玻璃钢型材", "可见光透射比", "遮阳系数", "太阳得热系数", "SHGC", "AAMA 1503",
)
WINDOW_DENY = (
    "外墙外保温", "保温系统", "保温装饰", "薄抹灰", "岩棉", "聚苯", "挤塑", "聚氨酯", "玻璃纤维", "玻纤", "网布", "玻璃棉", "风管", "甲醛",
    "TVOC", "集热器", "热水器", "集热管", "PVT组件", "真空太阳集热管", "真空管型太阳能", "导光管采光系统", "平板采光系统", "司机室门板",
    "悬挑节点", "动车车门", "车门",
)

# Window refinement.
REFINE_KEEP = (
    "门窗", "外窗", "窗", "玻璃", "中空玻璃", "真空玻璃", "真空绝热", "幕墙", "可见光透射比", "露点", "遮阳", "shgc", "传热系数",
)
REFINE_DROP = (
    "外墙外保温", "保温系统", "保温装饰", "薄抹灰", "岩棉", "聚苯", "挤塑", "聚氨酯", "拉伸粘结", "粘结强度", "锚固", "抗冲击", "燃烧性能",
    "玻璃纤维", "网布", "玻璃棉", "风管", "甲醛", "TVOC", "耐碱", "集热器", "热水器", "集热管", "PVT", "导光管采光系统", "平板采光系统",
    "司机室门板", "悬挑节点", "动车车门", "车门",
)
REFINE_OVERRIDE = ("中空玻璃", "真空玻璃", "幕墙", "门窗", "外窗")
REFINE_HARD_DROP = (
    "保温系统", "外墙外保温", "薄抹灰", "玻璃纤维", "玻璃棉", "网布", "风管", "集热器", "热水器", "集热管", "PVT", "导光管采光系统",
    "平板采光系统", "司机室门板", "悬挑节点", "动车车门", "车门",
)
GLASS_WORDS = ("玻璃", "中空玻璃", "真空玻璃", "可见光透射比", "太阳能总透射比", "遮阳系数", "太阳得热系数")
PRIORITY_WEIGHTS = (
    ("传热系数", 100), ("U值", 100), ("U 值", 100), ("u-value", 100), ("Low-E", 80), ("中空玻璃", 80), ("真空玻璃", 80), ("遮阳系数", 70),
    ("太阳得热系数", 70), ("SHGC", 70), ("可见光透射比", 60), ("太阳能总透射比", 60), ("幕墙", 40), ("门窗", 40), ("外窗", 40),
)

# Fine categories of the report corpus.
FINE_CATEGORIES = [
    "exterior_wall", "wall_insulation", "windows", "roof", "floor", "curtain_shading", "hvac_system", "lighting", "needs_review", "not_relevant",
]
FINE_LABELS = {
    "exterior_wall": "外墙", "wall_insulation": "外墙外保温", "windows": "外窗", "roof": "屋面", "floor": "地面/楼板",
    "curtain_shading": "窗帘/遮阳", "hvac_system": "空调系统", "lighting": "照明", "needs_review": "待复核", "not_relevant": "非目标",
}
FINE_KEYWORDS = {
    "curtain_shading": ["遮阳系数", "太阳得热", "shgc", "遮阳", "得热系数", "太阳光直接透射比"],
    "windows": ["门窗", "外窗", "窗", "玻璃", "中空玻璃", "真空绝热", "真空玻璃", "幕墙", "传热系数", "可见光透射比", "露点"],
    "roof": ["屋面", "屋顶", "种植屋面", "倒置式屋面", "防水卷材", "防水涂料"],
    "floor": ["楼板", "地面", "架空楼板", "接触室外空气楼板", "地下室顶板"],
    "wall_insulation": [
        "保温", "外墙外保温", "保温系统", "保温装饰", "薄抹灰", "保温板", "岩棉", "聚苯", "挤塑", "聚氨酯", "导热系数", "热工", "热阻", "燃烧性能",
    ],
    "exterior_wall": ["外墙", "墙体", "砌块", "加气混凝土", "烧结", "多孔砖", "混凝土墙", "基层墙", "围护", "围护结构"],
    "hvac_system": ["空调", "制冷量", "制热量", "热泵", "cop", "eer", "风机盘管", "新风", "冷水机组", "多联机", "风量", "输入功率", "能效"],
    "lighting": ["照明", "灯具", "led", "光通量", "功率密度", "灯"],
}
FINE_EXCLUDE = ["太阳能集热器", "集热器", "热水器", "空气源热泵"]
FINE_WINDOW_PRIORITY = ["玻璃", "中空玻璃", "真空玻璃", "真空绝热", "门窗", "外窗", "幕墙"]

# Thermal-hit classification.
HIT_DATABASES = {
    "wall_insulation": ("wall_insulation.db", "wall_insulation_systems"), "exterior_wall": ("exterior_wall.db", "parameter_options"),
    "window_u": ("windows.db", "parameter_options"), "door_u": ("door.db", "parameter_options"), "roof_u": ("roof.db", "parameter_options"),
    "floor_u": ("floor.db", "parameter_options"), "floor_contact_type": ("floor_contact.db", "parameter_options"),
    "window_shgc": ("windows.db", "parameter_options"), "window_air_tightness": ("window_air_tightness.db", "parameter_options"),
    "curtain_shading": ("shading.db", "parameter_options"), "needs_review": ("", ""),
}
HIT_KEYWORDS = {
    "curtain_shading": ["遮阳系数", "遮阳性能", "遮阳", "shading"],
    "window_shgc": ["太阳得热系数", "太阳能总透射比", "太阳光直接透射比", "shgc", "g值", "g 值"],
    "window_air_tightness": ["气密性能", "气密性", "空气渗透", "单位缝长"],
    "window_u": ["外窗", "门窗", "窗", "玻璃", "中空玻璃", "真空玻璃", "幕墙", "型材", "铝合金窗", "塑料窗", "暖边", "边框"],
    "door_u": ["外门", "入户门", "户门", "保温门", "防火门", "钢质门", "推拉门", "铝合金门", "木门", "折叠门"],
    "roof_u": ["屋面", "屋顶", "顶板", "顶框", "种植屋面", "防水卷材"],
    "floor_u": ["楼板", "地面", "底板", "底框", "地暖板", "架空楼板", "地下室顶板", "楼地面", "架空采暖", "垫层砂浆", "速装板"],
    "wall_insulation": [
        "外墙外保温", "墙体保温", "保温系统", "保温装饰板", "保温板", "岩棉", "xps", "eps", "聚苯", "石墨", "真金板", "泡沫玻璃", "无机保温",
        "复合保温", "硬泡聚氨酯", "真空绝热", "绝热板", "玻璃棉", "保温砂浆", "保温浆料", "保温材料", "保温隔热", "挤塑", "挤塑板", "发泡水泥",
        "发泡水泥板", "聚异氰脲酸酯", "pir", "酚醛", "苯板", "夹芯板", "夹心板", "复合板", "内保温", "聚氨酯泡沫", "聚氨酯", "聚氨酯绝热",
        "喷涂聚氨酯", "泡沫塑料", "碳纳芯板", "agpf", "玻化微珠", "硅酸钙", "水泥板", "纤维水泥", "纤维增强", "粉刷石膏", "轻集料混凝土",
        "保温强力板", "保温装饰", "装饰一体化", "装饰板", "防火板", "防火分隔条", "外模板", "外贴板", "隔热", "气凝胶", "橡塑", "保温管", "保温材",
        "纳米凝胶", "泡棉", "聚醚海绵", "垫块", "锚固件", "托架", "门芯", "相变材料", "铝覆板", "微晶板", "晶板", "漂珠", "板材",
    ],
    "exterior_wall": ["外墙", "墙体", "墙板", "砌块", "加气混凝土", "混凝土墙", "预制墙", "蒸压"],
}
HIT_PRIORITY = [
    "curtain_shading", "window_shgc", "window_air_tightness", "window_u", "door_u", "roof_u", "floor_u", "wall_insulation", "exterior_wall",
]
HIT_CONTEXT = {
    "not_envelope": ["系统储能密度", "系统发热量", "储能密度", "可再生能源"],
    "non_building": ["动车", "车门", "司机室", "塞拉门", "车组", "地板布"],
    "daylighting": ["导光管采光系统", "平板采光系统", "采光系统"],
    "door_window": ["门窗"],
    "thermal": ["保温性能", "传热系数", "热阻", "u-value", "u值"],
    "shading_product": ["蜂巢", "百叶", "遮阳帘", "窗帘", "遮阳板"],
    "insulation_system": ["外墙外保温", "保温系统", "保温装饰板", "保温板", "真空绝热", "绝热板", "硬泡聚氨酯"],
    "u_words": ["传热系数", "u-value", "u值"],
}
IMPORT_CATEGORIES = ("wall_insulation", "exterior_wall", "window_u", "door_u", "roof_u", "floor_u", "window_shgc", "curtain_shading")
U_CATEGORIES = ("exterior_wall", "window_u", "door_u", "roof_u", "floor_u")

# Web sources: (term, hint, score) and (term, hint).
SOURCE_TERMS = [
    ("传热系数", "thermal_transmittance_u", 20), ("热传递性能", "thermal_transmittance_u", 20), ("导热系数", "thermal_conductivity_lambda", 20),
    ("热阻", "thermal_resistance_r", 20), ("SHGC", "solar_heat_gain_shgc", 20), ("太阳得热系数", "solar_heat_gain_shgc", 20),
    ("Ug", "thermal_transmittance_u", 12), ("U值", "thermal_transmittance_u", 12),
]
SOURCE_COMPONENTS = [
    ("门窗", "window"), ("幕墙", "window"), ("玻璃", "window"), ("屋面", "roof"), ("楼板", "floor"), ("外门", "door"), ("外墙", "exterior_wall"),
    ("保温", "wall_insulation"),
]

# Table headers of test reports.
HEADER_ALIASES = {
    "seq": ("序号", "no.", "no"),
    "item_name": ("检验项目", "检测项目", "test items", "项目名称"),
    "requirement": ("技术要求", "requirement of standard", "标准要求"),
    "result": ("检测结果", "检验结果", "test results", "结果"),
    "conclusion": ("单项判定", "item conclusion", "判定", "结论"),
}
FIELD_HINTS = (
    "编号", "日期", "名称", "型号", "规格", "单位", "依据", "地点", "类别", "等级", "数量", "状态", "样品", "委托", "生产", "检测", "检验", "报告",
    "sample", "client", "test type", "address", "brand", "manufacturer", "type/model", "model", "quantity", "date", "commission",
    "test place", "standard", "criteria", "reference",
)
BLANK_CELLS = ("", "-", "--", "------", "—", "/")

# Screening and library targets.
SCREEN_DATABASES = {
    "wall_insulation": "wall_insulation.db", "exterior_wall": "exterior_wall.db", "roof_u": "roof.db", "floor_contact_type": "floor.db",
    "window_u": "windows.db", "shading": "shading.db",
}
LIBRARY_TABLES = {
    "exterior_wall": "exterior_wall.db", "window_u": "windows.db", "window_shgc": "windows.db", "roof_u": "roof.db", "floor_u": "floor.db",
    "curtain_shading": "shading.db", "door_u": "door.db", "floor_contact_type": "floor_contact.db", "window_air_tightness": "window_air_tightness.db",
}
