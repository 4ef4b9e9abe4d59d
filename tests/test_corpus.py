"""Sources, sinks, page and text candidates, folds."""

import random

from pyspark.sql import functions as F

from thermograph.functions import text as X
from thermograph.operators import relational as O
from thermograph.operators import web as W
from thermograph.sources import html as H
from thermograph.sources import sinks as K
from thermograph.sources import tables as T


def test_report_folders_round_trip(spark, tmp_path):
    for rid, name in (("R1__a", "岩棉"), ("R2", "外窗")):
        d = tmp_path / rid
        d.mkdir()
        (d / "meta.csv").write_text(f"field,value\n样品名称,\"{name}, 二\"\n规格型号,X\n", encoding="utf-8-sig")
    rows = T.scan_report_folders(spark, str(tmp_path), "meta", T.META_FIELDS)
    assert {(r.report_id, r.field, r.value) for r in rows.collect()} >= {("R1__a", "样品名称", "岩棉, 二"), ("R2", "规格型号", "X")}
    assert T.scan_report_folders(spark, str(tmp_path / "none"), "meta", T.META_FIELDS).count() == 0
    K.write_csv(rows, str(tmp_path / "out"), ["value", "field", "absent"])
    back = T.read_string_csv(spark, str(tmp_path / "out"), ["field", "value", "absent"])
    assert back.count() == 4


def test_per_category_and_resume(spark, tmp_path):
    df = spark.createDataFrame([("a", "roof", "OK", None), ("b", "floor", "OK", "boom")], "report_id string, fine_category string, status string, error string")
    K.write_per_category(df, str(tmp_path / "cat"))
    assert spark.read.parquet(str(tmp_path / "cat/by_category/fine_category=roof")).count() == 1
    path = str(tmp_path / "log")
    K.resume_append(df, path, None)
    K.resume_append(df.withColumn("error", F.lit(None).cast("string")), path, spark.read.parquet(path))
    got = sorted((r.report_id, r.status) for r in spark.read.parquet(path).collect())
    assert got == [("a", "OK"), ("b", "FAIL"), ("b", "OK")]


def test_sql_dump_semicolon_and_escapes(spark):
    sql = "INSERT INTO `x_meta` VALUES (1,'a;(b)',NULL),(2,'it\\'s\\n',3.5)"
    got = T.explode_sql_dump(spark.createDataFrame([(sql,)], "value string")).collect()
    assert [list(r.fields) for r in got] == [["1", "a;(b)", ""], ["2", "it's\n", "3.5"]]


def test_decode_gbk(spark):
    raw = '<meta charset="gb2312">保温'.encode("gb18030")
    df = spark.createDataFrame([(bytearray(raw), "text/html")], "content binary, content_type string")
    r = H.decode_pages(df).first()
    assert r.charset == "gb18030" and r.html.endswith("保温")


def test_table_candidates(spark):
    page = ("<table><tr><th>序号</th><th>材料(产品)名称</th><th>热传递性能</th><th>报告编号</th></tr>"
            "<tr><td>1</td><td>某外保温系统</td><td>1.01W/(㎡·K)</td><td>AB-2024-77</td></tr><tr><td>2</td><td>某墙体保温涂料</td><td>0.048W/(m·K)</td><td>CD-2024-78</td></tr></table>")
    df = spark.createDataFrame([(1, "http://a/b", "t", page)], "page_id int, url string, title string, html string")
    got = {(r.component_category, r.parameter_type, r.name, r.value, r.unit, r.source_report_id) for r in W.candidates_from_pages(df).collect()}
    assert got == {("wall_insulation", "thermal_transmittance_u", "某外保温系统", 1.01, "W/(m2·K)", "AB-2024-77"),
                   ("wall_insulation", "thermal_conductivity_lambda", "某墙体保温涂料", 0.048, "W/(m·K)", "CD-2024-78")}


def test_text_candidates_and_catalog(spark):
    text = "屋面传热系数 K = 0.29 W/(m2·K)。\n地面热阻 R = 1.29 (m2·K)/W；外门 传热系数 1.50 W/(m2·K)\n外窗太阳得热系数 Shgc = 0.44。"
    catalog = "典型门窗幕墙热工参数目录\n18 单银 6单银+12A+6透明 1.72 1.8 2.0 2.3 2.5 2.8\n39 单银 6高透光+12A+6透明 0.68 0.46 — 1.72 0.030 — —"
    df = spark.createDataFrame([(1, text, "u1"), (2, catalog, "u2")], "doc_id int, text string, source_url string")
    rows = W.candidates_from_text(df).collect()
    one = {(r.component_category, r.parameter_type): r.value for r in rows if r.doc_id == 1}
    assert one == {("roof_u", "thermal_transmittance_u"): 0.29, ("floor_contact_type", "thermal_resistance_r"): 1.29, ("door_u", "thermal_transmittance_u"): 1.5, ("window_shgc", "solar_heat_gain_shgc"): 0.44}
    two = {r.name: r.value for r in rows if r.doc_id == 2}
    assert len(two) == 8 and two["6单银+12A+6透明 - 典型门窗幕墙1.0级"] == 1.8 and two["6高透光+12A+6透明 - 玻璃SHGC"] == 0.46


def test_mentions_carry_context(spark):
    r = spark.createDataFrame([("前文" * 20 + "墙体传热系数为 0.45 W/(m2·K) 后文" + "续" * 40,)], "t string").select(F.inline(X.thermal_mentions(F.col("t")))).collect()
    assert len(r) == 1 and r[0].numeric_value == "0.45" and len(r[0].evidence) <= 24 + len(r[0].raw_value) + 24


def test_unique_names_match_sequential_allocation(spark):
    rng = random.Random(3)
    rows = [("c", rng.choice(["A", "A1", "A11", "B", "B2", ""]), i) for i in range(60)]
    used = ["A2", "B", "B1", "A13"]
    taken, want = set(used), {}
    for _, base, i in rows:
        b = base or "未命名"
        n, k = b, 0
        while n in taken:
            k += 1
            n = f"{b}{k}"
        taken.add(n)
        want[i] = n
    got = O.allocate_unique_names(spark.createDataFrame(rows, "category string, base string, pos long"), spark.createDataFrame([("c", u) for u in used], "category string, name string"), ["category"], "base", "pos")
    assert {r.pos: r.allocated_name for r in got.collect()} == want


def test_unique_names_of_bases_that_shift_each_other(spark):
    """A name is refused only for a row that really came first, though the rows before it move along."""
    rng = random.Random(4)
    rows = [("c", "A", 10), ("c", "A1", 15), ("c", "A", 20), ("c", "A2", 25), ("c", "A", 30), ("c", "A2", 35), ("d", "A1", 40), ("d", "A", 41)]
    rows += [("e", rng.choice(["N", "N", "N", "N1", "N1", "N2", "N11", "N10", "M"]), 100 + i) for i in range(400)] + [("e", "N3", 600), ("e", "N31", 601)]
    used = [("c", "A21"), ("e", "N2"), ("e", "N12"), ("e", "N112"), ("e", "N31")]
    taken, want = set(used), {}
    for key, base, i in rows:
        n = next(n for n in (f"{base}{k or ''}" for k in range(10**6)) if (key, n) not in taken)
        taken.add((key, n))
        want[i] = n
    assert [want[i] for i in (20, 25, 30)] == ["A2", "A22", "A3"]
    args = spark.createDataFrame(rows, "category string, base string, pos long"), spark.createDataFrame(used, "category string, name string"), ["category"], "base", "pos"
    for size in ({}, {"block_rows": 4, "tile_rows": 50}):
        assert {r.pos: r.allocated_name for r in O.allocate_unique_names(*args, **size).collect()} == want


def test_meta_fold_matches_sequential_fold(spark):
    rows = [("r", i, f, v) for i, (f, v) in enumerate([("检验项目", "a"), ("检验项目", "b;c"), ("检验项目", "a"), ("检验项目", "b;c"), ("检测项目", "c"), ("样品名称", " "), ("样品名称", "S1"), ("样品名称", "S2")])]
    r = O.meta_fold(spark.createDataFrame(rows, "report_id string, pos long, field string, value string")).first()
    assert r.test_items == "a; b; c; b; c"
    assert r.sample_name == "S1"


def test_keep_first_and_upsert_are_idempotent(spark):
    from thermograph.operators import library as L
    t = spark.createDataFrame([("k1", 1, "x"), ("k2", 2, "y")], "name string, value int, source string")
    b = spark.createDataFrame([("k2", 5, "z", 1), ("k2", 6, "w", 2), ("k3", 7, "q", 3)], "name string, value int, source string, pos int")
    once = L.upsert(t, b, ["name"], ["value", "source"], "pos")
    twice = L.upsert(once, b, ["name"], ["value", "source"], "pos")
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == [("k1", 1, "x"), ("k2", 6, "w"), ("k3", 7, "q")]
