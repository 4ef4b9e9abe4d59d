"""Registered queries of sources, state and the longer compositions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from thermograph.functions import rules as R
from thermograph.functions import text as X
from thermograph.operators import classify as C
from thermograph.operators import relational as O
from thermograph.plans import adapters as A
from thermograph.plans import phrases  # noqa: F401
from thermograph.session import checkpoint_dir
from thermograph.sources import sinks as K
from thermograph.sources import tables as T
from thermograph.streaming import limiter as Lm

QUERIES: dict = {}
c = F.col


def add(name, fn, sql=None, views=()):
    QUERIES[name] = (fn, A.with_views(sql.strip(), *views) if sql and views else sql)


def _t1(s, d):
    return Lm.limit_attempts(A.view(s, d, "v_attempts"), Lm.Limits(window=20000.0, login_address=12, login_user=3, other=3))


add("T1_attempt_limiter", lambda s, d: _t1(s, d).select("event_id", "action", "address", "allowed", "retry_after"))


def _t2(s, d):
    A.load_tables(s, d)
    created = s.sql("SELECT c_custkey AS job_id, 'queued' AS status, 0 AS progress FROM customer WHERE c_custkey % 3 > 0")
    upd = s.sql("SELECT o_custkey AS job_id, o_orderdate AS ts, o_orderkey AS pos, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS status, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 101 AS INT) END AS progress FROM orders")
    return Lm.job_state_fold(created, upd, ["status", "progress"])


add("T2_job_state_fold", _t2, """WITH u AS (SELECT o_custkey AS job_id, arg_max(o_orderstatus, epoch_us(o_orderdate)::HUGEINT * 10000000 + o_orderkey) FILTER (WHERE o_orderkey % 3 = 0) AS st, arg_max((o_orderkey % 101)::INT, epoch_us(o_orderdate)::HUGEINT * 10000000 + o_orderkey) FILTER (WHERE o_orderkey % 4 > 0) AS pr FROM orders GROUP BY 1)
SELECT c_custkey AS job_id, coalesce(st, 'queued') AS status, coalesce(pr, 0) AS progress FROM customer LEFT JOIN u ON u.job_id = c_custkey WHERE c_custkey % 3 > 0""")


def _manifest(s, d):
    A.load_tables(s, d)
    return s.sql("""SELECT 'm' || CAST(o_orderkey % 3 AS VARCHAR(2)) AS file_name, o_orderkey AS pos, CASE WHEN o_orderkey % 5 = 0 THEN 'junk/x' ELSE 'useful/' || o_orderstatus END AS `group`, 'D:/R/' || CAST(o_custkey % 500 AS VARCHAR(9)) AS destination, 'r' || CAST(o_custkey % 2 AS VARCHAR(2)) AS report_id FROM orders""")


add("S3_scan_manifests_last_wins", lambda s, d: T.scan_manifests_last_wins(_manifest(s, d)).select("file_name", "pos", c("group").alias("grp"), "destination", "report_id"), """
SELECT 'm' || (o_orderkey % 3) AS file_name, o_orderkey AS pos, 'useful/' || o_orderstatus AS grp, 'D:/R/' || (o_custkey % 500) AS destination, 'r' || (o_custkey % 2) AS report_id FROM orders WHERE o_orderkey % 5 > 0
QUALIFY row_number() OVER (PARTITION BY o_custkey % 500, o_custkey % 2 ORDER BY o_orderkey % 3 DESC, o_orderkey DESC) = 1""")


def _dump(s, d):
    li = A.table(s, d, "orders").select((c("o_orderkey") % 200).alias("g"), "o_orderkey", F.concat(F.lit("("), c("o_orderkey").cast("string"), F.lit(", 'it\\'s; "), "o_orderpriority", F.lit("', NULL)")).alias("t"))
    st = li.groupBy("g").agg(F.concat(F.lit("INSERT INTO `a_meta` VALUES "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "t"))), lambda x: x["t"]), ", ")).alias("value"))
    return T.explode_sql_dump(st)


add("S4_explode_sql_dump", lambda s, d: _dump(s, d).select("table_name", c("fields")[0].cast("bigint").alias("id"), c("fields")[1].alias("txt"), c("fields")[2].alias("nul")),
    "SELECT 'a_meta' AS table_name, o_orderkey AS id, 'it''s; ' || o_orderpriority AS txt, '' AS nul FROM orders")


def _artifacts(s, d):
    A.load_tables(s, d)
    df = s.sql("""SELECT o_orderkey AS id, '{"schema_version": ' || CAST(o_orderkey % 3 AS VARCHAR(2)) || ', "model": {"version": "' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'v1' END || '"' || CASE WHEN o_orderkey % 7 = 0 THEN ', "backend": "odd"' ELSE '' END || '}, "geometry": {"walls": [], "windows": []' || CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE ', "doors": []' END || '}}' AS doc FROM orders""")
    return T.read_artifact_json(df, "doc", 2, ["onnx", "vector"], "onnx")


add("S9_read_artifact_json", lambda s, d: _artifacts(s, d)[0].select("id", "model_version"), "SELECT o_orderkey AS id, 'v1' AS model_version FROM orders WHERE o_orderkey % 3 = 2 AND o_orderkey % 5 > 0 AND o_orderkey % 7 > 0 AND o_orderkey % 11 > 0")
add("S9_quarantine", lambda s, d: _artifacts(s, d)[1].select("id"), "SELECT o_orderkey AS id FROM orders WHERE NOT (o_orderkey % 3 = 2 AND o_orderkey % 5 > 0 AND o_orderkey % 7 > 0 AND o_orderkey % 11 > 0)")


def _tail(s, d):
    A.load_tables(s, d)
    return s.sql("""SELECT p_partkey AS id, CASE WHEN p_partkey % 9 = 0 THEN '材料名称' WHEN p_partkey % 9 = 1 THEN '3、' || p_name ELSE p_name END || CASE WHEN p_partkey % 2 = 0 THEN '\\t' ELSE '   ' END || CAST(p_size AS VARCHAR(5)) ||
      CASE WHEN p_partkey % 2 = 0 THEN '\\t0.04\\t1380\\t0.36\\t1.2\\t1.1\\t1.0' ELSE '   0.04   1380   0.36   1.2   1.1   ' END || CASE WHEN p_partkey % 2 = 1 AND p_partkey % 5 > 0 THEN '1.0' WHEN p_partkey % 2 = 1 THEN 'n/a' ELSE '' END AS line FROM part""")


add("S10_read_fixed_tail_table", lambda s, d: T.read_fixed_tail_table(_tail(s, d)).select("id", "material_name", "density", "conductivity", "floor_factor"), """
SELECT p_partkey AS id, p_name AS material_name, p_size::DOUBLE AS density, 0.04::DOUBLE AS conductivity, 1.0::DOUBLE AS floor_factor FROM part WHERE p_partkey % 9 > 1 AND (p_partkey % 2 = 0 OR p_partkey % 5 > 0)""")


def _product_rows(s, d):
    A.load_tables(s, d)
    body = s.sql("SELECT p_partkey % 40 AS file_id, 10 + p_partkey AS row_no, array(CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE '' END, CAST(p_partkey AS VARCHAR(9)), p_name, 'GB-' || p_brand, 'ID' || CAST(p_size AS VARCHAR(9)), p_brand) AS cells FROM part")
    head = body.select("file_id").distinct().select("file_id", F.lit(2).cast("bigint").alias("row_no"), F.array(*[F.lit(x) for x in ("类别", "序号", "材料（产品）名称", "执行标准", "公示编号", "企业名称")]).alias("cells"))
    title = head.select("file_id", F.lit(0).cast("bigint").alias("row_no"), F.array(F.lit("公示名单")).alias("cells"))
    return title.unionByName(head).unionByName(body)


def _products(s, d):
    p = T.read_header_detected_table(_product_rows(s, d))
    p = O.forward_fill(p, ["file_id"], "row_no", ["category", "product_name", "standard"], F.floor(c("row_no") / 500))
    return p


add("S11_read_header_detected_table", lambda s, d: T.read_header_detected_table(_product_rows(s, d)).select("file_id", "row_no", "category", "seq", "product_name", "public_id", "company"), """
SELECT p_partkey % 40 AS file_id, 10 + p_partkey AS row_no, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE '' END AS category, p_partkey::VARCHAR AS seq, p_name AS product_name, 'ID' || p_size AS public_id, p_brand AS company FROM part""")
add("X10_product_index", lambda s, d: O.keep_first(_products(s, d).withColumn("region", X.infer_region(F.lit("湘潭市公示名单"))), ["file_id", "region", "public_id", "company", "product_name"], ["row_no"]).select("file_id", "row_no", "category", "product_name", "public_id"), """
WITH p AS (SELECT p_partkey % 40 AS file_id, 10 + p_partkey AS row_no, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS ct, p_name, 'ID' || p_size AS pid, p_brand FROM part), f AS (SELECT *, coalesce(last_value(ct IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY row_no ROWS UNBOUNDED PRECEDING), '') AS cat FROM p)
SELECT file_id, row_no, cat AS category, p_name AS product_name, pid AS public_id FROM f QUALIFY row_number() OVER (PARTITION BY file_id, pid, p_brand, p_name ORDER BY row_no) = 1""")


def _cells(s, d):
    v = A.view(s, d, "v_lines")
    k = c("line_id")
    cells = (F.when(k % 10 == 0, F.array(F.lit("序号"), F.lit("检验项目"), F.lit("技术要求"), F.lit("检测结果"), F.lit("单项判定"))).when(k % 10 == 1, F.array(F.concat(F.lit("第"), c("subject"))))
             .when(k % 10 == 2, F.array(F.lit("样品名称："), c("subject"), F.lit("规格型号"), c("param"))).when(k % 10 == 3, F.array(F.lit("检验项目"), F.lit("------")))
             .otherwise(F.array((k % 10).cast("string"), c("param"), F.lit("≤2"), F.concat("number_text", "unit_text"), F.lit("合格"))))
    return v.select(F.floor(k / 30).alias("report_id"), F.floor(k % 30 / 10).cast("int").alias("table_index"), k.alias("row_index"), cells.alias("cells"))


add("X8_meta_from_table_rows", lambda s, d: T.meta_from_table_rows(_cells(s, d)).select("report_id", "row_index", "field", "value"), r"""
SELECT line_id // 30 AS report_id, line_id AS row_index, '样品名称' AS field, subject AS value FROM v_lines WHERE line_id % 10 = 2 UNION ALL SELECT line_id // 30, line_id, '规格型号', trim(param) FROM v_lines WHERE line_id % 10 = 2""", ("v_lines",))
add("X8_items_from_table_rows", lambda s, d: T.items_from_table_rows(_cells(s, d)).select("report_id", "row_index", "section", "seq", "item_name", "result", "conclusion"), r"""
, x AS (SELECT *, max(CASE WHEN line_id % 10 = 1 THEN '第' || subject END) OVER (PARTITION BY line_id // 10) AS sec, bool_or(line_id % 10 = 0) OVER (PARTITION BY line_id // 10) AS hd FROM v_lines)
SELECT line_id // 30 AS report_id, line_id AS row_index, coalesce(sec, '') AS section, (line_id % 10)::VARCHAR AS seq, trim(param) AS item_name, trim(regexp_replace(number_text || unit_text, '[\s\p{Z}]+', ' ', 'g')) AS result, '合格' AS conclusion FROM x WHERE line_id % 10 > 3 AND hd""", ("v_lines",))
add("C11_structure_type", lambda s, d: T.structure_type(_cells(s, d), A.view(s, d, "v_meta").select(c("report_id"), c("value").alias("text"))).select("report_id", "structure_type", "item_header_rows", "item_body_rows", "paragraph_count"))
add("X22_trace_rows", lambda s, d: T.trace_rows(_cells(s, d).withColumn("block_type", F.lit("table_row"))).groupBy("report_id").agg(F.count("*").alias("blocks"), F.max("sequence").alias("last_sequence")), """
, n AS (SELECT line_id // 30 AS report_id, CASE WHEN line_id % 10 = 1 THEN 2 WHEN line_id % 10 = 2 THEN 5 WHEN line_id % 10 = 3 THEN 3 ELSE 6 END AS k FROM v_lines) SELECT report_id, sum(k)::BIGINT AS blocks, sum(k)::BIGINT - 1 AS last_sequence FROM n GROUP BY 1""", ("v_lines",))
add("X21_word_report_card", lambda s, d: T.word_report_card(_cells(s, d).withColumn("row_index", F.floor(c("row_index") / 1000)), A.view(s, d, "v_lines").select((c("line_id") % 100).alias("report_id"), F.floor(c("line_id") / 100).alias("para_index"), "text")).select("report_id", "sample_name", "spec_model", "test_conclusion"))
add("F7_cell_predicates", lambda s, d: A.view(s, d, "v_lines").select("line_id", T.looks_like_field(F.concat("param", F.lit("："))).alias("field"), T.is_blank(F.when(c("line_id") % 3 == 0, "------").otherwise(c("subject"))).alias("blank"), T.header_role(F.when(c("line_id") % 4 == 0, "检测结果 Test Results").otherwise(c("param"))).alias("role")), """
SELECT line_id, regexp_matches(lower(param), '(编号|日期|名称|型号|规格|单位|依据|地点|类别|等级|数量|状态|样品|委托|生产|检测|检验|报告)') AS field, line_id % 3 = 0 AS blank, CASE WHEN line_id % 4 = 0 THEN 'result' WHEN contains(param, '结论') THEN 'conclusion' END AS role FROM v_lines""", ("v_lines",))
add("F14_valid_report_number", lambda s, d: A.table(s, d, "orders").select("o_orderkey", T.valid_report_number(F.concat(F.element_at(F.array(*[F.lit(x) for x in ("A", "a/b", "con", "ＮＵＬ.", "x|", "R１")]), (c("o_orderkey") % 6 + 1).cast("int")), F.when(c("o_orderkey") % 6 == 2, "").otherwise(c("o_orderkey").cast("string")))).alias("ok")),
    "SELECT o_orderkey, o_orderkey % 6 IN (0, 5) AS ok FROM orders")
add("F17_canonical_username", lambda s, d: A.table(s, d, "customer").select("c_custkey", T.canonical_username(F.when(c("c_custkey") % 3 == 0, F.concat(c("c_name"), F.lit("Ａ"))).when(c("c_custkey") % 3 == 1, F.concat(F.lit(" "), "c_name")).otherwise(c("c_name"))).alias("ok")),
    "SELECT c_custkey, c_custkey % 3 = 2 AS ok FROM customer")
add("K3_pending_work", lambda s, d: K.pending(A.table(s, d, "customer").select(c("c_custkey").alias("report_id")), A.table(s, d, "orders").select(c("o_custkey").alias("report_id")).filter("report_id % 4 > 0")), "SELECT c_custkey AS report_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 4 > 0)")
add("K4_artifact_digest", lambda s, d: K.topology_with_opening_digest(A.view(s, d, "v_regions").select("page_id").distinct(), A.view(s, d, "v_regions").select("page_id", "region_id", "x", "y")).select("page_id", F.length("openings_sha256").cast("bigint").alias("n")), "SELECT DISTINCT page_id, 64::BIGINT AS n FROM v_regions", ("v_regions",))


# -- files written from a table and read back ------------------------------------

def _scratch(s):
    return f"{checkpoint_dir(s).rstrip('/')}/scratch-{uuid.uuid4().hex}"


def _quoted(s, d):
    """Orders with the characters that CSV has to quote."""
    return A.table(s, d, "orders").select(c("o_orderkey").cast("string").alias("id"), (c("o_custkey") % 40).cast("string").alias("report_id"), F.concat(F.lit('say "'), "o_orderpriority", F.lit('", then\n'), "o_orderstatus").alias("text"), F.lit("left out").alias("more"))


_QUOTED = "SELECT o_orderkey::VARCHAR AS id, (o_custkey % 40)::VARCHAR AS report_id, 'say \"' || o_orderpriority || '\", then' || chr(10) || o_orderstatus AS text FROM orders"


def _s1(s, d):
    path = _scratch(s)
    K.write_csv(_quoted(s, d), path, ["text", "id", "absent"])
    K.write_csv(_quoted(s, d).filter("id % 2 = 0"), path, ["id", "report_id", "text"], "append")
    return T.read_string_csv(s, path, ["id", "report_id", "text", "absent"]).select("id", "report_id", "text", "absent")


add("S1_read_string_csv", _s1, f"SELECT id, NULL::VARCHAR AS report_id, text, NULL::VARCHAR AS absent FROM ({_QUOTED}) UNION ALL SELECT id, report_id, text, NULL FROM ({_QUOTED}) WHERE id::BIGINT % 2 = 0")


def _s2(s, d):
    path = _scratch(s)
    _quoted(s, d).write.partitionBy("report_id").option("header", True).option("escape", '"').csv(path)
    return T.scan_report_folders(s, path, "part-*", ["id", "report_id", "text"]).withColumn("report_id", F.replace("report_id", F.lit("report_id="), F.lit("")))


add("S2_scan_report_folders", _s2, _QUOTED)


def _k1(s, d):
    """Lines of the files, and the bytes they start with."""
    path = _scratch(s)
    K.write_csv(_quoted(s, d).withColumn("text", c("report_id")), path, ["id", "text", "absent"])
    marks = s.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select(F.hex(F.substring("content", 1, 3)).alias("value"))
    return s.read.text(path).select("value").unionByName(marks).groupBy("value").agg(F.least(F.count(F.lit(1)), F.lit(1)).alias("n")).select("value", "n")


add("K1_write_csv", _k1, "SELECT o_orderkey::VARCHAR || ',' || (o_custkey % 40) || ',\"\"' AS value, 1::BIGINT AS n FROM orders UNION ALL SELECT 'id,text,absent', 1 UNION ALL SELECT 'EFBBBF', 1")


def _k2(s, d):
    path = _scratch(s)
    K.write_per_category(_quoted(s, d).drop("more"), path, "report_id")
    own = s.read.parquet(f"{path}/by_category").withColumns({"report_id": c("report_id").cast("string"), "part": F.lit("by_category")})
    return s.read.parquet(f"{path}/manifest").withColumn("part", F.lit("manifest")).unionByName(own)


add("K2_write_per_category", _k2, f"SELECT id, report_id, text, part FROM ({_QUOTED}), (VALUES ('manifest'), ('by_category')) AS t(part)")


def _summary(s, d):
    return A.table(s, d, "customer").filter("c_custkey % 4 > 0").select(c("c_custkey").alias("report_id"), c("c_mktsegment").alias("status"), c("c_name").alias("work_id"), F.lit("d").alias("source_doc"))


add("K5_export_items", lambda s, d: T.with_summary(A.table(s, d, "orders").select(c("o_custkey").alias("report_id"), "o_orderkey", "o_orderstatus"), _summary(s, d)), """
SELECT o_custkey AS report_id, coalesce(c_mktsegment, '') AS status, coalesce(c_name, '') AS work_id, CASE WHEN c_custkey IS NULL THEN '' ELSE 'd' END AS source_doc, o_orderkey, o_orderstatus FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 > 0) k ON k.c_custkey = o_custkey""")


def _x5(s, d):
    """Dump rows to material candidates: pivot, filter, type, number, use."""
    v = A.view(s, d, "v_lines")
    k = c("line_id")
    eav = v.select("report_id", F.floor(k / 3).alias("row_no"), k.alias("pos"), F.element_at(F.array(F.lit("技术要求"), F.lit("检测结果"), F.lit("单项判定")), (k % 3 + 1).cast("int")).alias("attr_name"), c("text").alias("attr_value"))
    items = O.eav_pivot(eav, ["report_id", "row_no"])
    text = F.concat_ws(" ", "requirement", "result")
    items = items.filter(C.is_relevant(text)).withColumn("parameter_type", C.dump_parameter_type(text))
    basis = F.when(c("result") != "", c("result")).otherwise(c("requirement"))
    return items.select("report_id", "row_no", "parameter_type", X.first_number(basis).alias("numeric_value"), X.first_unit(basis, X.MATERIAL_UNIT_PATTERNS).alias("unit"), C.recommended_use(F.lit(""), text, c("parameter_type")).alias("recommended_use"))


add("X5_material_candidates", _x5)


def _x6(s, d):
    """Focused parameters of report items, kept or to be checked."""
    v = A.view(s, d, "v_lines")
    cat = F.element_at(F.array(*[F.lit(x) for x in R.CATEGORY_PARAMETER_TYPES]), (c("report_id") % 8 + 1).cast("int"))
    r = v.select("line_id", "report_id", cat.alias("fine_category"), c("text").alias("result"), X.clean(F.concat_ws(" / ", "subject", "text")).alias("context"))
    r = r.withColumn("m", C.focused_parameter_match(c("context"), c("fine_category")))
    r = r.select("*", F.explode(F.array(F.struct(c("m.parameter_type").alias("t"), c("m.default_unit").alias("u"), X.first_number(c("result")).alias("n"), X.first_unit(c("result"), X.FOCUSED_UNIT_PATTERNS).alias("x")))).alias("p"))
    r = r.withColumn("action", C.parameter_action(c("p.t"), c("context"))).filter("action <> 'reject'")
    return r.select("line_id", "fine_category", c("p.t").alias("parameter_type"), c("p.n").alias("numeric_value"), F.when(c("p.x") != "", c("p.x")).otherwise(c("p.u")).alias("unit"),
                    F.when((c("p.n") == "") & ~c("p.t").isin("shgc_or_shading", "energy_efficiency"), "needs_check").otherwise(c("action")).alias("action"))


add("X6_focused_extraction", _x6)


def _x7(s, d):
    """Window parameters of window reports; first of equal rows."""
    cards = A.view(s, d, "v_cards").select("report_id", C.window_candidate(c("text")).alias("w")).filter("w.keep").select("report_id")
    v = A.view(s, d, "v_lines").join(cards, "report_id", "left_semi").select("report_id", "line_id", "text", F.explode(F.array(C.window_parameter(c("text")))).alias("p")).filter("p IS NOT NULL")
    return O.keep_first(v.select("report_id", "line_id", "text", "p.*"), ["report_id", "parameter_type", "value", "text"], ["line_id"]).select("report_id", "line_id", "parameter_type", "value", "unit")


add("X7_window_extraction", _x7)


def _x11(s, d):
    """Screened parameters: candidates without windows plus table rows."""
    a = A.view(s, d, "v_lines").select(c("line_id").alias("pos"), C.software_material_category(c("subject")).alias("k"), c("subject").alias("material_name"), F.lit("thermal_conductivity_lambda").alias("parameter_type"), c("number_text").alias("value"), F.trim("unit_text").alias("unit"))
    b = T.read_fixed_tail_table(_tail(s, d)).select((c("id") + 10_000_000).alias("pos"), C.software_material_category(c("material_name")).alias("k"), "material_name", F.lit("thermal_conductivity_lambda").alias("parameter_type"), c("conductivity").cast("string").alias("value"), F.lit("W/(m·K)").alias("unit"))
    u = O.union_sources(a.filter(~c("material_name").contains("窗")), b).select("pos", "k.category", "k.database", "material_name", "parameter_type", "value", "unit")
    return O.keep_first(u, ["category", "material_name", "parameter_type", "value", "unit"], ["pos"]).orderBy("database", "category", "material_name", "parameter_type")


add("X11_screen_parameters", lambda s, d: _x11(s, d).select("pos", "category", "database", "material_name", "value", "unit"))


def _x15(s, d):
    """Measured wall items to library rows; requirements are never used."""
    v = A.view(s, d, "v_lines").withColumn("m", C.item_parameter_type(c("text"))).filter("m IS NOT NULL")
    p = v.select("report_id", c("line_id").alias("pos"), c("m.parameter_type").alias("parameter_type"), X.first_number(c("text")).alias("value"), c("text").alias("evidence"), c("text").alias("raw_value"))
    return O.thermal_value_fold(p.filter("value <> ''")).filter("coalesce(r_value_m2k_w, u_wall_w_m2k, lambda_w_mk) IS NOT NULL")


add("X15_import_wall_items", lambda s, d: _x15(s, d).select("report_id", "r_value_m2k_w", "u_wall_w_m2k", "lambda_w_mk"), """
, p AS (SELECT report_id, line_id, nullif(regexp_extract(trim(text), '[-+]?\\d+(?:\\.\\d+)?'), '')::DOUBLE AS v, CASE WHEN regexp_matches(lower(text), '传热系数|u值|u 值|u-value') THEN 'u' WHEN regexp_matches(text, '热阻|传热阻') THEN 'r' WHEN contains(text, '导热系数') THEN 'l' END AS t FROM v_lines)
SELECT report_id, arg_min(v, line_id) FILTER (WHERE t = 'r') AS r_value_m2k_w, arg_min(v, line_id) FILTER (WHERE t = 'u') AS u_wall_w_m2k, arg_min(v, line_id) FILTER (WHERE t = 'l') AS lambda_w_mk FROM p WHERE t IS NOT NULL AND v IS NOT NULL GROUP BY 1""", ("v_lines",))


def _x9(s, d):
    """Thermal parameters of table rows: value cell, else mentions."""
    r = _cells(s, d).withColumn("cells", F.filter(F.transform("cells", lambda x: X.clean(x)), lambda x: x != ""))
    text = F.array_join("cells", " / ")
    r = r.select("report_id", "row_index", text.alias("t"), F.explode(F.array(F.struct(C.item_parameter_type(text).alias("m"), F.when(F.size("cells") >= 4, X.measured_value_cell(c("cells"))).otherwise("").alias("v")))).alias("p"))
    direct = r.filter("p.m IS NOT NULL AND p.v <> ''").select("report_id", "row_index", c("p.m.parameter_type").alias("parameter_type"), X.first_number(c("p.v")).alias("numeric_value"),
                                                              F.coalesce(F.nullif(X.first_unit(c("p.v"), X.WALL_UNIT_PATTERNS), F.lit("")), c("p.m.default_unit")).alias("unit"), c("t").alias("evidence")).filter("numeric_value <> ''")
    rest = r.filter("p.m IS NULL OR p.v = ''").select("report_id", "row_index", F.inline(X.thermal_mentions(c("t")))).select("report_id", "row_index", "parameter_type", "numeric_value", "unit", "evidence")
    return O.keep_first(direct.unionByName(rest), ["report_id", "parameter_type", "numeric_value", "unit", "evidence"], ["row_index"])


add("X9_wall_word_parameters", lambda s, d: _x9(s, d).select("report_id", "row_index", "parameter_type", "numeric_value", "unit"))
