"""Registered queries of the text, rule and classification families."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermograph.functions import numbers as N
from thermograph.functions import rules as R
from thermograph.functions import text as X
from thermograph.functions.tables import sql_literal, values_clause
from thermograph.operators import classify as C
from thermograph.plans import adapters as A
from thermograph.plans import phrases  # noqa: F401  (registers the views)

QUERIES: dict = {}
c = F.col


def add(name, fn, sql=None, views=()):
    QUERIES[name] = (fn, A.with_views(sql.strip(), *views) if sql and views else sql)


def lines_select(make):
    """Query over ``v_lines``; columns are made when a session exists."""
    return lambda s, d: A.view(s, d, "v_lines").select("line_id", *make())


# -- SQL fragments of the reference side -------------------------------------

CLEAN = r"trim(regexp_replace(coalesce({}, ''), '[\s\p{{Z}}]+', ' ', 'g'))"


def q(w):
    return sql_literal(w)


def sql_any(col, words):
    return "(" + " OR ".join(f"contains({col}, {q(w)})" for w in words) + ")"


def sql_first(col, words):
    return "coalesce(" + ", ".join(f"CASE WHEN contains({col}, {q(w.lower())}) THEN {q(w)} END" for w in words) + ")"


def sql_count(col, words):
    return "(" + " + ".join(f"contains({col}, {q(w.lower())})::INT" for w in words) + ")"


# -- text helpers -------------------------------------------------------------

add("P1_clean", lambda s, d: A.table(s, d, "documents").select("doc_id", X.clean(c("text")).alias("cleaned")),
    f"SELECT doc_id, {CLEAN.format('text')} AS cleaned FROM documents")

_path = r"concat('D:\\Data/Reports\\', c_name, '/', c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN '__0123456789ab' ELSE '_abcdef0123' END, '.docx')"


def _paths(s, d):
    A.load_tables(s, d)
    return s.sql(f"SELECT c_custkey AS id, {_path} AS p, regexp_replace({_path}, '[.]docx$', '') AS stem_id FROM customer")


add("P2_normalize_path_key", lambda s, d: _paths(s, d).select("id", X.normalize_path_key(c("p")).alias("path_key"), X.path_stem(c("p")).alias("stem")),
    r"""SELECT c_custkey AS id, 'data\reports\' || lower(replace(c_name || '\' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '__0123456789ab' ELSE '_abcdef0123' END || '.docx', '/', '\')) AS path_key,
 c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '__0123456789ab' ELSE '_abcdef0123' END AS stem FROM customer""")
add("P3_report_key", lambda s, d: _paths(s, d).select(
    "id", X.report_key(c("stem_id")).alias("report_key"), X.source_report_id(c("stem_id")).alias("source_id"),
    X.last_path_part(X.report_key(F.replace(c("stem_id"), F.lit("/"), F.lit("\\")))).alias("short_id"), X.report_short_id(c("stem_id")).alias("second_part")),
    r"""WITH s AS (SELECT c_custkey AS id, 'D:\Data/Reports\' || c_name || '/' || c_mktsegment AS base, c_mktsegment AS seg, CASE WHEN c_custkey % 2 = 0 THEN '__0123456789ab' ELSE '_abcdef0123' END AS tail FROM customer)
SELECT id, base AS report_key, CASE WHEN id % 2 = 0 THEN base ELSE base || tail END AS source_id, seg AS short_id,
 CASE WHEN id % 2 = 0 THEN '0123456789ab' ELSE base || tail END AS second_part FROM s""")
add("P4_safe_name", lambda s, d: _paths(s, d).select("id", X.safe_name(c("p")).alias("safe"), X.safe_name(c("p"), 12).alias("short_safe")),
    r"""WITH s AS (SELECT c_custkey AS id, regexp_replace('D:\Data/Reports\' || c_name || '/' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '__0123456789ab' ELSE '_abcdef0123' END || '.docx', '[<>:"/\\|*?]+', '_', 'g') AS safe FROM customer)
SELECT id, safe, substr(safe, 1, 12) AS short_safe FROM s""")
add("P5_content_key", lambda s, d: A.table(s, d, "pages").select("page_id", X.content_key(F.lit("page"), c("url")).alias("k1"), X.content_key(F.lit("page"), c("url"), "sha256").alias("k2")),
    "SELECT page_id, 'page__' || substr(sha1(url), 1, 10) AS k1, 'page__' || substr(sha256(url), 1, 8) AS k2 FROM pages")
add("P4_slug", lambda s, d: A.table(s, d, "pages").select("page_id", X.slug(c("url"), F.lit(".html")).alias("slug")),
    r"""WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
s AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\.[^.]+$', '\1'), '[^\w\p{L}\p{N}-]+', '-', 'g') AS st FROM u),
t AS (SELECT *, trim(st, '-') AS st2, trim(regexp_replace(host || path, '[^\w\p{L}\p{N}-]+', '-', 'g'), '-') AS whole FROM s)
SELECT page_id, substr(CASE WHEN st2 = '' THEN whole ELSE st2 END, 1, 90) || '.html' AS slug FROM t""")

add("N1_normalize_unit", lines_select(lambda: [X.normalize_unit(c("unit_text")).alias("unit")]), r"""
, t AS (SELECT line_id, regexp_replace(replace(replace(replace(replace(replace(replace(unit_text, '㎡', 'm2'), 'm²', 'm2'), '•', '·'), '.', '·'), '（', '('), '）', ')'), '[\s\p{Z}]+', '', 'g') AS t FROM v_lines)
SELECT line_id, CASE WHEN contains(t, 'W/(m2') OR contains(t, 'W/m2') THEN 'W/(m2·K)' WHEN contains(t, 'W/(m·K)') OR contains(t, 'W/m·K') THEN 'W/(m·K)'
 WHEN regexp_matches(t, '(?i)W/\([^)]*m[^)]*K\)') THEN 'W/(m·K)' WHEN regexp_matches(t, '(?i)W/\([^)]*K\)') THEN 'W/(m2·K)'
 WHEN contains(t, 'm2·K/W') OR contains(t, '(m2·K)/W') THEN 'm2·K/W' ELSE t END AS unit FROM t""", ("v_lines",))

_LAST = r"list_extract(regexp_extract_all({}, '[-+]?\d+(?:\.\d+)?'), -1)"


def _value_unit_sql():
    parts = []
    for i, p in enumerate(X.VALUE_UNIT_PATTERNS):
        parts.append(f"regexp_extract(t, '(?is)^(.*?)({p})', 1) AS pre{i}, regexp_extract(t, '(?is)^(.*?)({p})', 2) AS u{i}")
    body = ", ".join(parts)
    value = "CASE " + " ".join(f"WHEN u{i} <> '' AND regexp_matches(pre{i}, '\\d') THEN {_LAST.format(f'pre{i}')}" for i in range(4)) + " END"
    unit = "CASE " + " ".join(f"WHEN u{i} <> '' AND regexp_matches(pre{i}, '\\d') THEN u{i}" for i in range(4)) + " END"
    norm = r"regexp_replace(replace(replace(replace(replace(raw, '㎡', 'm2'), 'm²', 'm2'), '•', '·'), '.', '·'), '[\s\p{Z}]+', '', 'g')"
    return f""", t AS (SELECT line_id, {CLEAN.format('text')} AS t FROM v_lines), m AS (SELECT line_id, t, {body} FROM t),
r AS (SELECT line_id, t, ({value})::DOUBLE AS value, {unit} AS raw FROM m), n AS (SELECT *, {norm} AS w FROM r)
"""


_UNIT_CASE = r"""CASE WHEN raw IS NULL THEN NULL WHEN contains(w, 'W/(m2') OR contains(w, 'W/m2') THEN 'W/(m2·K)' WHEN contains(w, 'W/(m·K)') OR contains(w, 'W/m·K') THEN 'W/(m·K)'
 WHEN regexp_matches(w, '(?i)W/\([^)]*m[^)]*K\)') THEN 'W/(m·K)' WHEN regexp_matches(w, '(?i)W/\([^)]*K\)') THEN 'W/(m2·K)'
 WHEN contains(w, 'm2·K/W') OR contains(w, '(m2·K)/W') THEN 'm2·K/W' ELSE w END"""
add("N2_parse_value_unit", lambda s, d: A.view(s, d, "v_lines").select("line_id", X.parse_value_unit(c("text")).alias("v")).select("line_id", "v.value", "v.unit"),
    _value_unit_sql() + f"SELECT line_id, value, {_UNIT_CASE} AS unit FROM n", ("v_lines",))


def _first_unit_sql(col, patterns):
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({col}, '(?i){p}'), '')" for p in patterns) + ", '')"


add("N3_extract_number_and_unit", lines_select(lambda: [
    X.first_number(c("text")).alias("number"), X.first_unit(c("text"), X.MATERIAL_UNIT_PATTERNS).alias("unit_material"),
    X.first_unit(c("text"), X.FOCUSED_UNIT_PATTERNS).alias("unit_focused"), X.first_unit(c("text"), X.WALL_UNIT_PATTERNS).alias("unit_wall")]),
    f""", t AS (SELECT line_id, {CLEAN.format('text')} AS t FROM v_lines)
SELECT line_id, regexp_extract(t, '[-+]?\\d+(?:\\.\\d+)?') AS number, {_first_unit_sql('t', X.MATERIAL_UNIT_PATTERNS)} AS unit_material,
 {_first_unit_sql('t', X.FOCUSED_UNIT_PATTERNS)} AS unit_focused, {_first_unit_sql('t', X.WALL_UNIT_PATTERNS)} AS unit_wall FROM t""", ("v_lines",))


def _after_sql(col, kw):
    frag = f"CASE WHEN strpos(lower({col}), {q(kw.lower())}) > 0 THEN substr({col}, strpos(lower({col}), {q(kw.lower())})) ELSE {col} END"
    return f"nullif(regexp_extract({frag}, '(?:^|[^0-9.])([0-9]+(?:\\.[0-9]+)?|\\.[0-9]+)(?:[^0-9.]|$)', 1), '')::DOUBLE"


add("N4_number_after_keyword", lines_select(lambda: [X.number_after_keyword(c("text"), "传热系数").alias("after_u"), X.number_after_keyword(c("text"), "shgc").alias("after_shgc")]),
    f"SELECT line_id, {_after_sql('text', '传热系数')} AS after_u, {_after_sql('text', 'shgc')} AS after_shgc FROM v_lines", ("v_lines",))
add("N5_thermal_mentions", lambda s, d: A.view(s, d, "v_lines").select("line_id", F.inline(X.thermal_mentions(F.concat(c("text"), F.lit("，"), c("text"))))))


def _measured(s, d):
    v = A.view(s, d, "v_lines")
    cells = F.array(c("subject"), F.concat("number_text", "unit_text"), F.when(c("line_id") % 3 == 0, "合格").otherwise("——"), F.when(c("line_id") % 2 == 0, "/").otherwise(c("param")))
    return v.select("line_id", X.measured_value_cell(cells).alias("cell"))


add("N6_measured_value_cell", _measured, r"""
, x AS (SELECT line_id, trim(regexp_replace(number_text || unit_text, '[\s\p{Z}]+', ' ', 'g')) AS v FROM v_lines)
SELECT line_id, CASE WHEN regexp_matches(v, '(?i)(W|m[²2]|K)') THEN v ELSE '' END AS cell FROM x""", ("v_lines",))


def _dims(s, d):
    A.load_tables(s, d)
    return s.sql("""SELECT l_orderkey * 10 + l_linenumber AS id, l_linenumber % 2 = 0 AS vertical,
     CASE l_partkey % 9 WHEN 0 THEN CAST(l_partkey AS VARCHAR(10)) WHEN 1 THEN CAST(l_partkey AS VARCHAR(10)) || ' mm' WHEN 2 THEN CAST(l_suppkey AS VARCHAR(10)) || '.5m'
      WHEN 3 THEN '1:100' WHEN 4 THEN CAST(l_suppkey AS VARCHAR(10)) || '㎡' WHEN 5 THEN CAST(l_suppkey AS VARCHAR(10)) || '.25' WHEN 6 THEN '0' || CAST(l_partkey AS VARCHAR(10))
      WHEN 7 THEN 'A' || CAST(l_partkey AS VARCHAR(10)) ELSE CAST(l_suppkey AS VARCHAR(10)) || '.5MM' END AS t FROM lineitem""")


_DIMS_SQL = """WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_linenumber % 2 = 0 AS vertical, l_partkey % 9 AS k, l_partkey AS p, l_suppkey AS s,
 CASE l_partkey % 9 WHEN 0 THEN l_partkey::VARCHAR WHEN 1 THEN l_partkey || ' mm' WHEN 2 THEN l_suppkey || '.5m' WHEN 3 THEN '1:100' WHEN 4 THEN l_suppkey || '㎡'
  WHEN 5 THEN l_suppkey || '.25' WHEN 6 THEN '0' || l_partkey WHEN 7 THEN 'A' || l_partkey ELSE l_suppkey || '.5MM' END AS t FROM lineitem)"""
add("N7_parse_dimension_metres", lambda s, d: _dims(s, d).select("id", "t", X.parse_dimension_metres(c("t")).alias("metres")).distinct(),
    _DIMS_SQL + """ SELECT DISTINCT id, t, CASE WHEN k IN (0, 1) AND p > 0 THEN p / 1000 WHEN k = 2 THEN s + 0.5::DOUBLE WHEN k = 5 AND s >= 100 THEN (s + 0.25::DOUBLE) / 1000
 WHEN k = 6 AND p > 0 THEN p / 1000 WHEN k = 8 AND s >= 100 THEN (s + 0.5::DOUBLE) / 1000 END AS metres FROM x""")
add("N8_dimension_text", lambda s, d: _dims(s, d).select("id", "t", X.dimension_text(c("t"), c("vertical")).alias("shown")).distinct(),
    _DIMS_SQL + " SELECT DISTINCT id, t, CASE WHEN vertical AND t[1] = '0' AND t[-1] <> '0' THEN reverse(t) ELSE t END AS shown FROM x")


def _floats(s, d):
    A.load_tables(s, d)
    return s.sql("""SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN '' WHEN 1 THEN ' 12.5 ' WHEN 2 THEN '1d' WHEN 3 THEN '-3' WHEN 4 THEN 'nan' WHEN 5 THEN '1e3'
      WHEN 6 THEN CAST(o_custkey AS VARCHAR(10)) ELSE 'abc' END AS t, o_totalprice - 250000 AS v FROM orders""")


add("N9_as_float", lambda s, d: _floats(s, d).select("id", N.as_float(c("t")).alias("parsed"), N.positive_float(c("v")).alias("positive")),
    """SELECT o_orderkey AS id, (CASE o_orderkey % 8 WHEN 1 THEN 12.5 WHEN 3 THEN -3 WHEN 5 THEN 1000 WHEN 6 THEN o_custkey END)::DOUBLE AS parsed,
 CASE WHEN o_totalprice - 250000 > 0 THEN o_totalprice - 250000 END AS positive FROM orders""")

add("N11_infer_source_type", lambda s, d: _urls(s, d).select(
    "page_id", X.infer_source_type(c("u")).alias("source_type"), X.infer_ext(c("u"), c("ct")).alias("ext"), X.source_type_for_ext(X.infer_ext(c("u"), c("ct"))).alias("list_type")),
    r"""WITH x AS (SELECT page_id, ['.pdf', '.DOCX', '.xls', '.csv', '', '.txt', '.png', ''][page_id % 8 + 1] AS e, ['text/html', 'application/pdf', 'image/jpeg'][page_id % 3 + 1] AS ct FROM pages),
y AS (SELECT page_id, lower(e) AS e, CASE WHEN e <> '' THEN lower(e) WHEN contains(ct, 'pdf') THEN '.pdf' WHEN contains(ct, 'jpeg') THEN '.jpg' ELSE '.html' END AS ext FROM x)
SELECT page_id, CASE e WHEN '.pdf' THEN 'pdf' WHEN '.docx' THEN 'docx' WHEN '.xls' THEN 'spreadsheet' WHEN '.csv' THEN 'spreadsheet' ELSE 'html' END AS source_type, ext,
 CASE WHEN ext IN ('.xls', '.xlsx', '.csv') THEN 'official_product_list_spreadsheet' WHEN ext = '.pdf' THEN 'official_product_list_pdf' WHEN ext IN ('.jpg', '.jpeg', '.png') THEN 'official_product_list_image'
  WHEN ext IN ('.doc', '.docx') THEN 'official_product_list_doc' ELSE 'official_product_notice_html' END AS list_type FROM y""")


def _urls(s, d):
    k = c("page_id")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % len(v) + 1).cast("int"))
    return A.table(s, d, "pages").select(
        "page_id", F.concat(F.regexp_extract("url", r"^([^?#]*)", 1), pick(".pdf", ".DOCX", ".xls", ".csv", "", ".txt", ".png", ""), F.lit("?v=1.pdf")).alias("u"),
        pick("text/html", "application/pdf", "image/jpeg").alias("ct"))


add("F2_trusted_domain", lambda s, d: A.table(s, d, "pages").select("page_id", X.trusted_domain(c("url"), (".example.com", "example.com")).alias("trusted"),
                                                                    X.trusted_domain(c("url")).alias("official")),
    r"""WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host FROM pages)
SELECT page_id, (host = 'example.com' OR ends_with(host, 'example.com')) AS trusted, (host = 'gov.cn' OR ends_with(host, 'gov.cn')) AS official FROM h""")


def _redirects(s, d):
    url = c("url")
    packed = F.concat(F.lit("https://www.bing.com/ck/a?x=1&amp;u=a1"), F.regexp_replace(F.translate(F.base64(F.encode(url, "UTF-8")), "+/", "-_"), r"[=\r\n]", ""))
    plain = F.concat(F.lit("https://www.bing.com/ck/a?url="), F.url_encode(url))
    k = c("page_id") % 3
    return A.table(s, d, "pages").select("page_id", "url", F.when(k == 0, packed).when(k == 1, plain).otherwise(url).alias("wrapped"))


add("N12_unwrap_redirect_url", lambda s, d: _redirects(s, d).select("page_id", X.unwrap_redirect_url(c("wrapped")).alias("target")),
    r"SELECT page_id, trim(regexp_replace(url, '[\s\p{Z}]+', ' ', 'g')) AS target FROM pages")
add("N14_infer_region_batch_title", lambda s, d: A.table(s, d, "pages").select(
    "page_id", X.page_title(c("html")).alias("title"), X.infer_region(F.concat(F.lit("2024年"), _region(), F.lit("第"), _numeral(), F.lit("批公示"))).alias("region"),
    X.infer_batch(F.concat(F.when(c("page_id") % 2 == 0, "2024年").otherwise(""), _region(), F.lit("第"), _numeral(), F.lit("批公示"))).alias("batch")),
    r"""WITH x AS (SELECT *, ['湘潭市', '重庆', '北京', '岳阳市'][page_id % 4 + 1] AS r, ['一', '十二', '三'][page_id % 3 + 1] AS n FROM pages),
t AS (SELECT *, CASE WHEN regexp_matches(html, '(?is)<h1[^>]*>.*?</h1>') THEN regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) ELSE regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) END AS raw FROM x)
SELECT page_id, trim(regexp_replace(regexp_replace(raw, '<[^>]+>', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS title,
 CASE page_id % 4 WHEN 0 THEN '湘潭' WHEN 1 THEN '重庆' WHEN 3 THEN '岳阳' ELSE '' END AS region,
 CASE WHEN page_id % 2 = 0 THEN '2024年' || r || '第' || n || '批' ELSE '第' || n || '批' END AS batch FROM t""")


def _region():
    return F.element_at(F.array(*[F.lit(x) for x in ("湘潭市", "重庆", "北京", "岳阳市")]), (c("page_id") % 4 + 1).cast("int"))


def _numeral():
    return F.element_at(F.array(*[F.lit(x) for x in ("一", "十二", "三")]), (c("page_id") % 3 + 1).cast("int"))


add("N15_strip_prefixes", lambda s, d: A.view(s, d, "v_lines").select("line_id", X.strip_prefixes(F.concat(
    F.element_at(F.array(*[F.lit(x) for x in ("单银 双银 ", "两玻一腔 中空玻璃 普通 ", "普通 透明 单银 ", "")]), (c("line_id") % 4 + 1).cast("int")), c("subject"))).alias("name")),
    "SELECT line_id, subject AS name FROM v_lines", ("v_lines",))
add("N16_choose_name", lines_select(lambda: [X.choose_name(F.when(c("line_id") % 3 == 0, "------").otherwise(F.when(c("line_id") % 3 == 1, " ")), F.when(c("line_id") % 2 == 0, "——").otherwise(c("subject")),
                                                c("line_id").cast("string")).alias("name")]),
    "SELECT line_id, CASE WHEN line_id % 2 = 0 THEN line_id::VARCHAR ELSE subject END AS name FROM v_lines", ("v_lines",))

# -- predicates and small classifiers -----------------------------------------

add("F1_is_relevant", lines_select(lambda: [C.is_relevant(c("text")).alias("relevant")]),
    f"SELECT line_id, ({sql_any('text', R.RELEVANT_KEYWORDS)} OR {sql_any('upper(text)', R.RELEVANT_KEYWORDS)}) AS relevant FROM v_lines", ("v_lines",))
add("F3_plausible_value", lines_select(lambda: [C.plausible_value(F.element_at(F.array(F.lit("window_u"), F.lit("window_shgc"), F.lit("other")), (c("line_id") % 3 + 1).cast("int")), c("number_text").cast("double")).alias("ok")]),
    """SELECT line_id, CASE line_id % 3 WHEN 0 THEN number_text::DOUBLE BETWEEN 0.1::DOUBLE AND 10 WHEN 1 THEN number_text::DOUBLE BETWEEN 0 AND 1.5::DOUBLE ELSE TRUE END AS ok FROM v_lines""", ("v_lines",))


def _focused_sql():
    parts = []
    known = "cat IN (" + ", ".join(q(k) for k in R.CATEGORY_PARAMETER_TYPES) + ")"
    for kind, words, unit in R.FOCUSED_PATTERNS:
        cats = [k for k, v in R.CATEGORY_PARAMETER_TYPES.items() if kind in v]
        allowed = f"(NOT {known} OR cat IN ({', '.join(q(k) for k in cats)}))"
        parts.append((kind, f"{allowed} AND {sql_any('low', [w.lower() for w in words])}", sql_first("low", words), unit))
    t = "CASE " + " ".join(f"WHEN {cond} THEN {q(k)}" for k, cond, _, _ in parts) + " END"
    n = "CASE " + " ".join(f"WHEN {cond} THEN {w}" for _, cond, w, _ in parts) + " END"
    u = "CASE " + " ".join(f"WHEN {cond} THEN {q(x)}" for _, cond, _, x in parts) + " END"
    return t, n, u


_CATS = ["exterior_wall", "wall_insulation", "windows", "roof", "curtain_shading", "hvac_system", "lighting", "other"]
def _cat_col():
    return F.element_at(F.array(*[F.lit(x) for x in _CATS]), (c("line_id") % 8 + 1).cast("int"))

_cat_sql = "[" + ", ".join(q(x) for x in _CATS) + "][line_id % 8 + 1]"
_t, _n, _u = _focused_sql()
_low_cte = f", x AS (SELECT line_id, {CLEAN.format('text')} AS t, lower({CLEAN.format('text')}) AS low, {_cat_sql} AS cat FROM v_lines)"
add("C6_focused_parameter_match", lambda s, d: A.view(s, d, "v_lines").select("line_id", C.focused_parameter_match(c("text"), _cat_col()).alias("m")).select("line_id", "m.*"),
    f"{_low_cte} SELECT line_id, {_t} AS parameter_type, {_n} AS parameter_name, {_u} AS default_unit FROM x", ("v_lines",))
_action = f"""CASE WHEN {sql_any('t', ['经纬密度', '断裂伸长率'])} THEN 'reject' WHEN kind = 'density' AND {sql_any('t', R.DENSITY_REJECT_CONTEXT)} THEN 'reject'
 WHEN kind IN ('dimension', 'thickness') AND ({sql_any('t', R.DIMENSION_CHECK_CONTEXT)} OR {sql_any('t', ['尺寸偏差', '公差'])}) THEN 'needs_check'
 WHEN kind IS NULL THEN 'reject' ELSE 'keep' END"""
add("F4_parameter_action", lambda s, d: A.view(s, d, "v_lines").select("line_id", C.parameter_action(C.focused_parameter_match(c("text"), F.lit("roof"))["parameter_type"], c("text")).alias("action")),
    f"{_low_cte.replace(_cat_sql, q('roof'))}, y AS (SELECT *, {_t} AS kind FROM x) SELECT line_id, {_action} AS action FROM y", ("v_lines",))
add("F5_is_window_candidate", lambda s, d: A.view(s, d, "v_lines").select("line_id", C.window_candidate(c("text")).alias("w")).select("line_id", "w.keep", "w.reason"),
    f"""{_low_cte}, y AS (SELECT *, {sql_first('low', R.WINDOW_DENY)} AS deny FROM x)
SELECT line_id, (deny IS NULL AND ((contains(t, '型材') AND contains(t, '传热系数')) OR {sql_any('low', [w.lower() for w in R.WINDOW_ALLOW])})) AS keep,
 CASE WHEN deny IS NOT NULL THEN 'non_window_keyword:' || deny WHEN contains(t, '型材') AND contains(t, '传热系数') THEN 'window_profile_u_value'
  WHEN {sql_any('low', [w.lower() for w in R.WINDOW_ALLOW])} THEN 'window_evidence' ELSE 'no_structured_window_evidence' END AS reason FROM y""", ("v_lines",))
_refine = f"""CASE WHEN NOT {sql_any('t', R.REFINE_KEEP)} THEN 'no_window_keyword' WHEN {sql_any('t', R.REFINE_DROP)} AND NOT {sql_any('t', R.REFINE_OVERRIDE)} THEN 'insulation_only_keyword'
 WHEN {sql_any('t', R.REFINE_DROP)} AND {sql_any('t', R.REFINE_HARD_DROP)} THEN 'wall_insulation_evidence' ELSE 'refined_window_keyword' END"""
add("F6_is_refined_window", lambda s, d: A.view(s, d, "v_lines").select("line_id", C.refined_window(c("text")).alias("w")).select("line_id", "w.keep", "w.reason"),
    f"{_low_cte}, y AS (SELECT line_id, {_refine} AS reason FROM x) SELECT line_id, reason = 'refined_window_keyword' AS keep, reason FROM y", ("v_lines",))
_score = " + ".join(f"CASE WHEN contains(low, {q(k.lower())}) THEN {w} ELSE 0 END" for k, w in R.PRIORITY_WEIGHTS)
_hits = "concat_ws(';', " + ", ".join(f"CASE WHEN contains(low, {q(k.lower())}) THEN {q(k)} END" for k, _ in R.PRIORITY_WEIGHTS) + ")"
add("A10_priority_score", lambda s, d: A.view(s, d, "v_lines").select("line_id", C.priority_score(c("text")).alias("p")).select("line_id", c("p.score").cast("bigint").alias("score"), "p.hits"),
    f"{_low_cte} SELECT line_id, ({_score})::BIGINT AS score, {_hits} AS hits FROM x", ("v_lines",))
add("X12_refine_windows", lambda s, d: C.refine_windows(A.view(s, d, "v_lines"), "text").filter("keep").select("line_id", "refine_reason", c("priority_score").cast("bigint").alias("priority_score"), "priority_reason", "glass_priority"),
    f"""{_low_cte}, y AS (SELECT line_id, {_refine} AS refine_reason, ({_score})::BIGINT AS priority_score, {_hits} AS priority_reason, {sql_any('t', R.GLASS_WORDS)} AS glass_priority FROM x)
SELECT * FROM y WHERE refine_reason = 'refined_window_keyword'""", ("v_lines",))

_kind_sql = """CASE WHEN contains(low, 'shgc') OR contains(t, '太阳得热系数') THEN 'solar_heat_gain_shgc' WHEN unit = 'W/(m·K)' OR contains(t, '导热系数') OR contains(t, 'λ') THEN 'thermal_conductivity_lambda'
 WHEN unit = 'm2·K/W' OR contains(t, '热阻') OR regexp_matches(t, '(?i)\\bR\\s*=') THEN 'thermal_resistance_r' WHEN unit = 'W/(m2·K)' OR contains(t, '传热系数') OR contains(t, '热传递性能') THEN 'thermal_transmittance_u' ELSE '' END"""
_comp_sql = f"""CASE WHEN contains(t, '太阳得热系数') OR contains(upper(t), 'SHGC') THEN 'window_shgc' WHEN contains(t, '气密') THEN 'window_air_tightness' WHEN {sql_any('t', ['窗', '幕墙', '玻璃'])} THEN 'window_u'
 WHEN contains(t, '门') THEN 'door_u' WHEN {sql_any('t', ['屋面', '屋顶'])} THEN 'roof_u' WHEN {sql_any('t', ['地面', '土壤', '架空'])} THEN 'floor_contact_type' WHEN contains(t, '楼板') THEN 'floor_u'
 WHEN {sql_any('t', ['外保温', '墙体保温', '保温系统'])} THEN 'wall_insulation' WHEN contains(t, '墙') THEN 'exterior_wall' WHEN kind = 'thermal_conductivity_lambda' THEN 'wall_insulation' ELSE 'exterior_wall' END"""
_vu = _value_unit_sql()


def _kinds(s, d):
    v = A.view(s, d, "v_lines").withColumn("vu", X.parse_value_unit(c("text")))
    return v.select("line_id", "text", C.classify_parameter(F.coalesce(c("vu.unit"), F.lit("")), X.clean(c("text"))).alias("parameter_type"))


add("C3_classify_parameter", lambda s, d: _kinds(s, d).drop("text"),
    _vu + f", k AS (SELECT line_id, t, lower(t) AS low, {_UNIT_CASE} AS unit FROM n) SELECT line_id, {_kind_sql} AS parameter_type FROM k", ("v_lines",))
add("C4_classify_component", lambda s, d: _kinds(s, d).select("line_id", C.classify_component(c("text"), c("parameter_type")).alias("component")),
    _vu + f", k AS (SELECT line_id, t, lower(t) AS low, {_UNIT_CASE} AS unit FROM n), z AS (SELECT *, {_kind_sql} AS kind FROM k) SELECT line_id, {_comp_sql} AS component FROM z", ("v_lines",))
_dump = "CASE " + " ".join("WHEN " + " OR ".join(f"contains({'upper(t)' if w.isascii() else 't'}, {q(w)})" for w in ws) + f" THEN {q(k)}" for k, ws in R.DUMP_PARAMETER_RULES) + " ELSE 'supporting_property' END"
_use = f"""CASE WHEN {sql_any('t', ['窗', '玻璃', '幕墙'])} THEN 'window_system' WHEN contains(t, '屋面') THEN 'roof_assembly' WHEN {sql_any('t', ['空调', '热泵', '锅炉'])} OR kind IN ('cop', 'eer') THEN 'equipment'
 WHEN {sql_any('t', ['外墙', '墙体', '保温系统'])} OR kind IN ('thermal_resistance_r', 'u_value') THEN 'wall_assembly' WHEN {sql_any('t', ['保温', '聚苯', '聚氨酯', '岩棉'])} THEN 'material' ELSE 'review' END"""
add("C5_parameter_type_and_use", lambda s, d: A.view(s, d, "v_lines").withColumn("parameter_type", C.dump_parameter_type(c("text"))).select(
    "line_id", "parameter_type", C.recommended_use(c("subject"), c("text"), c("parameter_type")).alias("recommended_use")),
    f", k AS (SELECT line_id, text AS t FROM v_lines), z AS (SELECT *, {_dump} AS kind FROM k) SELECT line_id, kind AS parameter_type, {_use} AS recommended_use FROM z", ("v_lines",))


def _window_param_sql():
    cases = []
    for kind, label, words, unit in R.WINDOW_PARAMETERS:
        lo, hi = ("0.1::DOUBLE", "10") if kind == "window_u" else ("0", "1.5::DOUBLE")
        for w in words:
            cases.append((kind, label, unit, f"contains(low, {q(w.lower())}) AND {_after_sql('text', w)} BETWEEN {lo} AND {hi}", _after_sql("text", w)))
    col = lambda i: "CASE " + " ".join(f"WHEN {x[3]} THEN {q(x[i]) if i < 3 else x[4]}" for x in cases) + " END"
    return col(0), col(1), col(3), col(2)


_w0, _w1, _w2, _w3 = _window_param_sql()
add("C7_window_parameter", lambda s, d: A.view(s, d, "v_lines").select("line_id", C.window_parameter(c("text")).alias("w")).select("line_id", "w.*"),
    f", x AS (SELECT line_id, text, lower({CLEAN.format('text')}) AS low FROM v_lines) SELECT line_id, {_w0} AS parameter_type, {_w1} AS label, {_w2} AS value, {_w3} AS unit FROM x", ("v_lines",))
add("C8_material_category", lines_select(lambda: [C.material_category(c("text")).alias("material"), C.software_material_category(c("subject"))["category"].alias("software")]),
    f"""SELECT line_id, CASE WHEN {sql_any('text', ['玻璃', '窗'])} THEN 'window_material' WHEN contains(text, '屋面') THEN 'roof_material' WHEN {sql_any('text', ['保温', '聚苯', '聚氨酯', '岩棉'])} THEN 'insulation' ELSE 'material' END AS material,
 CASE WHEN contains(subject, '预制夹心剪力墙') THEN 'exterior_wall' WHEN contains(subject, '屋面') THEN 'roof_u' ELSE 'wall_insulation' END AS software FROM v_lines""", ("v_lines",))
_wall = "CASE " + " ".join(f"WHEN {sql_any('low', ws)} THEN {{}}" for _, ws, _ in R.WALL_ITEM_RULES) + " END"
add("C23_item_parameter_type", lambda s, d: A.view(s, d, "v_lines").select("line_id", C.item_parameter_type(c("text")).alias("m")).select("line_id", "m.*"),
    f"{_low_cte} SELECT line_id, {_wall.format(*[q(k) for k, _, _ in R.WALL_ITEM_RULES])} AS parameter_type, {_wall.format(*[q(u) for _, _, u in R.WALL_ITEM_RULES])} AS default_unit FROM x", ("v_lines",))

# -- report classifiers --------------------------------------------------------


def _fine_input(s, d):
    k = c("line_id")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % len(v) + 1).cast("int"))
    return A.view(s, d, "v_lines").select(
        "line_id", c("text").alias("hint"), pick("useful/envelope", "useful/hvac", "useful/envelope", "useful/lighting", "useful/envelope").alias("source_group"),
        pick("envelope", "", "unknown", "hvac", "envelope", "", "furniture").alias("content_category"), F.when(k % 4 == 0, "").otherwise(c("subject")).alias("matched_keywords"),
        (k % 3 == 0).alias("has_evidence"), pick("TABLE_OK", "TABLE_WEAK").alias("structure_type"))


def _fine_sql():
    sc = {k: sql_count("low", R.FINE_KEYWORDS[k]) for k in ("curtain_shading", "windows", "roof", "floor", "wall_insulation", "exterior_wall")}
    cols = ", ".join(f"{v} AS s_{k}" for k, v in sc.items())
    rules = [
        (sql_any("hint", R.FINE_EXCLUDE), "'not_relevant'", "'excluded_equipment_keyword'"),
        ("cc = 'hvac' OR grp = 'useful/hvac'", "'hvac_system'", "'coarse_hvac'"), ("cc = 'lighting' OR grp = 'useful/lighting'", "'lighting'", "'coarse_lighting'"),
        ("cc NOT IN ('', 'envelope', 'unknown')", "'not_relevant'", "'coarse_' || cc"), ("s_curtain_shading > 0", "'curtain_shading'", "'shading_keyword'"),
        (sql_any("hint", R.FINE_WINDOW_PRIORITY), "'windows'", "'window_priority_keyword'"),
        ("s_windows >= 2 OR (s_windows >= 1 AND s_wall_insulation = 0 AND s_roof = 0)", "'windows'", "'window_keyword'"),
        ("s_roof > 0", "'roof'", "'roof_keyword'"), ("s_floor > 0", "'floor'", "'floor_keyword'"), ("s_wall_insulation > 0", "'wall_insulation'", "'insulation_keyword'"),
        ("s_exterior_wall > 0", "'exterior_wall'", "'wall_keyword'"), ("TRUE", "'needs_review'", "'no_fine_keyword'"),
    ]
    cat = "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b, _ in rules) + " END"
    rea = "CASE " + " ".join(f"WHEN {a} THEN {r}" for a, _, r in rules) + " END"
    return f""", x AS (SELECT line_id, text AS hint, lower({CLEAN.format('text')}) AS low, ['useful/envelope', 'useful/hvac', 'useful/envelope', 'useful/lighting', 'useful/envelope'][line_id % 5 + 1] AS grp,
 ['envelope', '', 'unknown', 'hvac', 'envelope', '', 'furniture'][line_id % 7 + 1] AS cc, line_id % 4 = 0 AS no_kw, line_id % 3 = 0 AS ev, line_id % 2 = 1 AS weak FROM v_lines),
y AS (SELECT *, {cols} FROM x), z AS (SELECT *, {cat} AS fc, {rea} AS rr FROM y)
"""


_FINE = _fine_sql()
_FINE_SEL = """SELECT line_id, fc AS fine_category, CASE WHEN fc IN ('needs_review', 'not_relevant') THEN 'low' WHEN (no_kw AND NOT ev) OR weak THEN 'medium' ELSE 'high' END AS confidence,
 CASE WHEN fc IN ('needs_review', 'not_relevant') THEN rr WHEN no_kw AND NOT ev THEN rr || ';filename_or_group_only' WHEN weak THEN rr || ';table_weak' ELSE rr END AS review_reason FROM z"""
add("C1_fine_classify", lambda s, d: C.fine_classify(_fine_input(s, d)).select("line_id", "fine_category", "confidence", "review_reason"), _FINE + _FINE_SEL, ("v_lines",))


def _cards(s, d):
    cards = A.view(s, d, "v_cards").select("report_id", c("text").alias("card_text"))
    return cards, A.view(s, d, "v_lines").select("report_id", "text"), A.view(s, d, "v_params").select("report_id", "text")


def _hit_sql():
    z = {k: (f"({sql_count('ct', ws)} * 5 + {sql_count('it', ws)} * 2 + {sql_count('pt', ws)} * 3)") for k, ws in R.HIT_KEYWORDS.items()}
    base = ", ".join(f"{v} AS {k}" for k, v in z.items())
    ctx = ", ".join(f"{sql_any('comb', [w.lower() for w in ws])} AS x_{k}" for k, ws in R.HIT_CONTEXT.items())
    pri = R.HIT_PRIORITY
    steps, prev, n = [], "s0", 0

    def step(**new):
        nonlocal prev, n
        n += 1
        repl = ", ".join(f"({v}) AS {k}" for k, v in new.items())
        steps.append(f"s{n} AS (SELECT * REPLACE ({repl}) FROM {prev})")
        prev = f"s{n}"

    step(door_u="CASE WHEN x_door_window AND door_u <= window_u THEN 0 ELSE door_u END")
    w = "x_thermal AND window_u > 0"
    step(window_u=f"CASE WHEN {w} THEN window_u + 5 ELSE window_u END", window_air_tightness=f"CASE WHEN {w} THEN 0 ELSE window_air_tightness END",
         curtain_shading=f"CASE WHEN {w} AND window_shgc = 0 THEN 0 ELSE curtain_shading END")
    dd = "x_thermal AND door_u > 0"
    step(door_u=f"CASE WHEN {dd} THEN door_u + 5 ELSE door_u END", window_air_tightness=f"CASE WHEN {dd} THEN 0 ELSE window_air_tightness END", curtain_shading=f"CASE WHEN {dd} THEN 0 ELSE curtain_shading END")
    step(curtain_shading="CASE WHEN NOT x_shading_product THEN 0 ELSE curtain_shading END")
    ii = "x_insulation_system AND wall_insulation > 0"
    step(wall_insulation=f"CASE WHEN {ii} THEN wall_insulation + 8 ELSE wall_insulation END",
         exterior_wall=f"CASE WHEN {ii} AND exterior_wall > 0 THEN least(exterior_wall, wall_insulation + 5) ELSE exterior_wall END")
    step(**{k: f"CASE WHEN x_u_words AND {k} > 0 THEN {k} + 2 ELSE {k} END" for k in ("window_u", "roof_u", "floor_u", "exterior_wall")})
    best = f"greatest({', '.join(pri)})"
    second = f"list_extract(list_reverse_sort([{', '.join(pri)}]), 2)"
    cat = "CASE " + " ".join(f"WHEN {k} = best THEN {q(k)}" for k in pri) + " END"
    rules = [("x_not_envelope", "'needs_review'", "'low'", "'not_envelope_parameter'"), ("x_non_building", "'needs_review'", "'low'", "'non_building_product'"),
             ("x_daylighting", "'window_u'", "'high'", "'daylighting_system_u_value'"), ("best <= 0", "'needs_review'", "'low'", "'no_category_keyword'"),
             ("second <> 0 AND best - second <= 1", cat, "'low'", "'ambiguous_close_scores'"), ("best >= 8 AND best >= second + 2", cat, "'high'", "'keyword_score_high'"),
             ("best >= 5", cat, "'medium'", "'keyword_score_medium'"), ("TRUE", cat, "'low'", "'weak_keyword_match'")]
    pick = lambda i: "CASE " + " ".join(f"WHEN {r[0]} THEN {r[i]}" for r in rules) + " END"
    low = lambda e: f"lower({CLEAN.format(e)})"
    return f""", it AS (SELECT report_id, {low("string_agg(text, ' ' ORDER BY line_id)")} AS it FROM v_lines GROUP BY report_id),
pt AS (SELECT report_id, {low("string_agg(text, ' ' ORDER BY pos)")} AS pt FROM v_params GROUP BY report_id),
j AS (SELECT k.report_id, {low('k.text')} AS ct, coalesce(it, '') AS it, coalesce(pt, '') AS pt FROM v_cards k LEFT JOIN it USING (report_id) LEFT JOIN pt USING (report_id)),
j2 AS (SELECT *, ct || ' ' || it || ' ' || pt AS comb FROM j), s0 AS (SELECT report_id, {base}, {ctx} FROM j2), {', '.join(steps)},
f AS (SELECT *, {best} AS best, {second} AS second FROM {prev})
SELECT report_id, {pick(1)} AS fine_category, {pick(2)} AS confidence, {pick(3)} AS review_reason FROM f"""


add("C2_thermal_hit_classify", lambda s, d: C.thermal_hit_classify(*_cards(s, d)).select("report_id", "fine_category", "confidence", "review_reason"), _hit_sql(), ("v_lines", "v_cards", "v_params"))
add("C2_matched_keywords", lambda s, d: C.thermal_hit_classify(*_cards(s, d)).select("report_id", "fine_category", "target_database", "matched_keywords"))


def _score_input(s, d):
    v = A.view(s, d, "v_lines")
    k = c("line_id") % 4
    return v.select("line_id", c("text").alias("title"), F.concat(F.when(k == 0, "http://zj.example.com/a/").otherwise("https://www.other.org/"), c("line_id").cast("string"),
                    F.when(k % 2 == 0, ".pdf").otherwise(".html")).alias("url"), F.when(c("line_id") % 5 == 0, "热工参数目录").otherwise("").alias("snippet"))


def _source_sql():
    txt = r"trim(regexp_replace(text, '[\s\p{Z}]+', ' ', 'g'))"
    pts = " + ".join(f"CASE WHEN contains(low, {q(w.lower())}) THEN {n} ELSE 0 END" for w, _, n in R.SOURCE_TERMS)
    par = "list_filter([" + ", ".join(f"CASE WHEN contains(low, {q(w.lower())}) THEN {q(h)} END" for w, h, _ in R.SOURCE_TERMS) + "], lambda v: v IS NOT NULL)"
    com = "list_filter([" + ", ".join(f"CASE WHEN contains(txt, {q(w)}) THEN {q(h)} END" for w, h in R.SOURCE_COMPONENTS) + "], lambda v: v IS NOT NULL)"
    dedupe = lambda e: f"list_filter({e}, lambda v, i: list_position({e}, v) = i)"
    return f""", a AS (SELECT line_id, {txt} || ' ' || CASE WHEN line_id % 4 = 0 THEN 'http://zj.example.com/a/' ELSE 'https://www.other.org/' END || line_id || CASE WHEN line_id % 2 = 0 THEN '.pdf' ELSE '.html' END || ' '
 || CASE WHEN line_id % 5 = 0 THEN '热工参数目录' ELSE '' END AS txt, line_id % 4 = 0 AS ok FROM v_lines),
b AS (SELECT *, lower(txt) AS low FROM a), e AS (SELECT *, {pts} AS pts, {par} AS p0, {com} AS c0 FROM b),
f AS (SELECT *, {dedupe('p0')} AS ps, {dedupe('c0')} AS cs FROM e),
g AS (SELECT *, CASE WHEN ok THEN least(100, 20 + pts + len(cs) * 8 + CASE WHEN contains(txt, '参数目录') THEN 18 ELSE 0 END + CASE WHEN line_id % 2 = 0 THEN 10 ELSE 0 END) ELSE 0 END AS conf FROM f)
SELECT line_id, CASE WHEN line_id % 2 = 0 THEN 'pdf' ELSE 'html' END AS source_type, conf::BIGINT AS confidence, CASE WHEN ok THEN array_to_string(cs, ';') ELSE '' END AS component_hint,
 CASE WHEN ok THEN array_to_string(ps, ';') ELSE '' END AS parameter_hint, CASE WHEN NOT ok THEN 'reject' WHEN conf >= 40 AND len(ps) > 0 THEN 'pending' ELSE 'needs_check' END AS review_status FROM g"""


add("C9_score_source", lambda s, d: C.score_source(_score_input(s, d), trusted=(".example.com", "example.com")).select(
    "line_id", "source_type", c("confidence").cast("bigint").alias("confidence"), "component_hint", "parameter_hint", "review_status"), _source_sql(), ("v_lines",))


def _link_flags(s, d):
    v = _score_input(s, d)
    sc = C.score_source(v, trusted=(".example.com", "example.com"))
    pub = F.concat(F.when(c("line_id") % 3 == 0, "关于公布 建筑节能 材料").otherwise("建筑节能材料"), F.lit("公示名单"), F.when(c("line_id") % 2 == 0, "公布").otherwise(""))
    img = F.concat(F.when(c("line_id") % 2 == 0, "https://a.b/uploadfiles/").otherwise("https://a.b/x/"), c("line_id").cast("string"), F.when(c("line_id") % 3 == 0, ".jpg").when(c("line_id") % 3 == 1, ".xlsx").otherwise(""))
    return sc.select("line_id", C.relevant_seed_link(sc).alias("seed"), C.attachment_link(img, F.when(c("line_id") % 5 == 0, "附件 公示名单").otherwise("附件")).alias("attachment"),
                     C.publicity_title(pub).alias("publicity"), C.relevant_attachment(c("title_clean"), c("url_resolved")).alias("thermal_pdf"))


add("F8_link_predicates", _link_flags, _source_sql().rsplit("SELECT line_id, CASE WHEN", 1)[0] + f"""
SELECT line_id, ((line_id % 2 = 0 AND conf >= 40) OR (ok AND len(ps) > 0 AND conf >= 60)) AS seed,
 CASE WHEN line_id % 3 = 0 THEN line_id % 2 = 0 WHEN line_id % 3 = 1 THEN TRUE ELSE line_id % 5 = 0 END AS attachment,
 (line_id % 3 = 0 OR line_id % 2 = 0) AS publicity, (line_id % 2 = 0 AND {sql_any('txt', ['门窗幕墙', '传热系数', '太阳得热系数'])}) AS thermal_pdf_raw FROM g""".replace("thermal_pdf_raw", "thermal_pdf"), ("v_lines",))


def _status_input(s, d):
    A.load_tables(s, d)
    return s.sql("""SELECT p_partkey AS id, p_partkey % 5 % 3 AS row_count, CASE p_partkey % 4 WHEN 0 THEN 'official_product_list_image' WHEN 1 THEN 'official_product_list_pdf' WHEN 2 THEN 'official_product_notice_html' ELSE 'other' END AS source_type,
     CASE p_partkey % 3 WHEN 0 THEN '岳阳市公示' WHEN 1 THEN '衡阳市公示' ELSE '湘潭' END AS title, CASE WHEN p_size % 2 = 0 THEN 'fetch_failed' ELSE 'downloaded' END AS review_status FROM part""")


add("C10_product_row_status", lambda s, d: C.product_row_status(_status_input(s, d)).select("id", "product_row_status"), """
SELECT p_partkey AS id, CASE WHEN p_partkey % 5 % 3 > 0 THEN 'parsed_product_rows:' || (p_partkey % 5 % 3) WHEN p_partkey % 4 = 0 THEN 'needs_ocr_image' WHEN p_partkey % 4 = 1 THEN 'needs_ocr_pdf_or_render'
 WHEN p_partkey % 4 = 2 AND p_partkey % 3 = 0 THEN 'notice_has_embedded_images_or_pdf' WHEN p_partkey % 4 = 2 AND p_partkey % 3 = 1 THEN 'notice_page_collected_needs_manual_or_ocr_check'
 WHEN p_size % 2 = 0 THEN 'fetch_failed' ELSE 'source_collected_no_direct_rows' END AS product_row_status FROM part""")
