"""Registered queries of the web-source family."""

from __future__ import annotations

from pyspark.sql import functions as F

from thermograph.functions import text as X
from thermograph.operators import web as Wb
from thermograph.plans import adapters as A
from thermograph.plans import phrases  # noqa: F401
from thermograph.plans.registry_text import _UNIT_CASE, _comp_sql, _kind_sql, _value_unit_sql
from thermograph.sources import html as H

QUERIES: dict = {}
c = F.col


def add(name, fn, sql=None, views=()):
    QUERIES[name] = (fn, A.with_views(sql.strip(), *views) if sql and views else sql)


def pages(s, d):
    return A.table(s, d, "pages")


_LINKS = r"""v AS (SELECT page_id, url, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g') AS h FROM pages),
a AS (SELECT page_id, url, unnest(regexp_extract_all(h, '(?is)<a\b[^>]*?\bhref\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s>"'']+)[^>]*>.*?</a\s*>')) AS m, generate_subscripts(regexp_extract_all(h, '(?is)<a\b[^>]*?\bhref\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s>"'']+)[^>]*>.*?</a\s*>'), 1) - 1 AS link_pos FROM v),
l AS (SELECT page_id, url, link_pos::INT AS link_pos, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(m, '(?is)^<a\b[^>]*>(.*)</a\s*>$', 1), '<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[\s\p{Z}]+', ' ', 'g')) AS title,
 replace(regexp_extract(m, '(?is)\bhref\s*=\s*["'']?([^"''\s>]*)', 1), '&amp;', '&') AS href FROM a)"""
add("S6_html_links", lambda s, d: H.html_links(pages(s, d).select("page_id", "html")), f"WITH {_LINKS} SELECT page_id, link_pos, title, href FROM l WHERE href <> ''")
add("N13_resolve_url", lambda s, d: H.html_links(pages(s, d)).select("page_id", "link_pos", X.resolve_url(c("url"), c("href")).alias("target")), f"""WITH {_LINKS},
r AS (SELECT *, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM l WHERE href <> '')
SELECT page_id, link_pos, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN href[1] = '/' THEN root || href WHEN href[1] = '#' THEN url || href ELSE root || regexp_extract(path, '^(.*/)', 1) || href END AS target FROM r""")
add("S8_split_text_units", lambda s, d: H.split_text_units(A.table(s, d, "documents").select("doc_id", "text")).groupBy("doc_id").agg(F.count("*").alias("units"), F.max(F.length("unit")).cast("bigint").alias("longest")), r"""
WITH u AS (SELECT doc_id, trim(regexp_replace(unnest(regexp_split_to_array(text, '[\r\n。；;]+')), '[\s\p{Z}]+', ' ', 'g')) AS u FROM documents) SELECT doc_id, count(*) AS units, max(length(u)) AS longest FROM u WHERE u <> '' GROUP BY 1""")


def _seed_pages(s, d):
    """Every page with one more link whose text and suffix name a source."""
    j = A.view(s, d, "v_lines").select(c("line_id").alias("page_id"), "subject", "param")
    p = pages(s, d).join(j, "page_id")
    return p.select("page_id", "url", F.concat("html", F.lit('<a href="../doc/file'), c("page_id").cast("string"), F.lit('.pdf">'), "subject", F.lit(" <b>"), "param", F.lit("</b></a>")).alias("html"))


add("X4_discover_links", lambda s, d: Wb.discover_links(_seed_pages(s, d), trusted=("example.com", ".example.com")).select("page_id", "url", "title", "confidence", "review_status"))


def _table_pages(s, d):
    """One page per part brand with a table of its lines."""
    v = A.view(s, d, "v_lines")
    cell = lambda *x: F.concat(F.lit("<td>"), *x, F.lit("</td>"))
    tr = F.concat(F.lit("<tr>"), cell(c("line_id").cast("string")), cell(F.lit("<b>"), c("subject"), F.lit("</b>")), cell(c("param"), F.lit(" "), c("number_text"), c("unit_text")), cell(F.lit("REP-"), c("line_id").cast("string")), F.lit("</tr>"))
    head = "<html><table><tr><th>序号</th><th>材料产品名称</th><th>参数</th><th>报告编号</th></tr>"
    rows = v.select("line_id", "report_id", tr.alias("r"))
    g = rows.groupBy("report_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_id", "r"))), lambda x: x["r"]), "\n").alias("body"))
    return g.select(c("report_id").alias("page_id"), F.concat(F.lit("http://a.b/"), c("report_id").cast("string")).alias("url"), F.lit("列表").alias("title"), F.concat(F.lit(head), "body", F.lit("</table></html>")).alias("html"))


add("S5_html_table_rows", lambda s, d: H.html_table_rows(_table_pages(s, d)).select("page_id", "row_no", F.size("headers").cast("bigint").alias("n_headers"), c("cells")[1].alias("name"), c("cells")[3].alias("report")), r"""
SELECT report_id AS page_id, (row_number() OVER (PARTITION BY report_id ORDER BY line_id) - 1)::INT AS row_no, 4::BIGINT AS n_headers, subject AS name, 'REP-' || line_id AS report FROM v_lines""", ("v_lines",))
_ctx = _value_unit_sql().replace("trim(regexp_replace(coalesce(text, ''),", "trim(regexp_replace(coalesce(line_id || ' ' || subject || ' ' || param || ' ' || number_text || unit_text || ' REP-' || line_id, ''),")
add("X1_candidates_from_pages", lambda s, d: Wb.candidates_from_pages(_table_pages(s, d)).select("page_id", "component_category", "parameter_type", "name", "value", "unit", "source_report_id"), _ctx + f"""
, z0 AS (SELECT line_id, t, lower(t) AS low, coalesce(value, nullif(regexp_extract(t, '(?:SHGC|Shgc|太阳得热系数)\\s*[=:：]?\\s*(\\d+(?:\\.\\d+)?)', 1), '')::DOUBLE) AS value, coalesce({_UNIT_CASE}, '') AS unit FROM n),
z AS (SELECT *, {_kind_sql} AS kind FROM z0 WHERE value IS NOT NULL), y AS (SELECT z.*, {_comp_sql} AS comp, report_id, subject FROM z JOIN v_lines USING (line_id) WHERE kind <> '')
SELECT report_id AS page_id, comp AS component_category, kind AS parameter_type, subject AS name, value, unit, 'REP-' || line_id AS source_report_id FROM y QUALIFY row_number() OVER (PARTITION BY comp, kind, subject, value, unit, report_id ORDER BY line_id) = 1""", ("v_lines",))


def _texts(s, d):
    v = A.view(s, d, "v_lines")
    k = c("line_id")
    row = F.concat(k.cast("string"), F.lit(" 单银 "), c("subject"), F.lit(" 1."), (k % 90 + 10).cast("string"), F.lit(" 2.10 2.20 2.30 2.40 2.50"))
    optical = F.concat(k.cast("string"), F.lit(" 双银 "), c("subject"), F.lit(" 0.62 0."), (k % 90 + 10).cast("string"), F.lit(" — 1.80"))
    return v.select(k.alias("doc_id"), F.concat(F.lit("u:"), k.cast("string")).alias("source_url"), F.when(k % 5 == 0, F.concat(F.lit("典型门窗幕墙热工参数目录\n"), row, F.lit("\n"), optical)).when(k % 5 == 1, F.concat(F.lit("典型玻璃的光学\n"), "text")).otherwise(F.concat("text", F.lit("。\n"), "text")).alias("text"))


add("X3_window_catalog_rows", lambda s, d: Wb.candidates_from_text(_texts(s, d).filter("doc_id % 5 = 0")).groupBy("component_category", "parameter_type", F.substring_index("name", " - ", -1).alias("label")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")), """
, k AS (SELECT line_id, ('1.' || (line_id % 90 + 10))::DOUBLE AS ug, ('0.' || (line_id % 90 + 10))::DOUBLE AS sg FROM v_lines WHERE line_id % 5 = 0),
e AS (SELECT 'window_u' AS component_category, 'thermal_transmittance_u' AS parameter_type, '玻璃Ug' AS label, ug AS v FROM k UNION ALL SELECT 'window_u', 'thermal_transmittance_u', '典型门窗幕墙' || l || '.0级', (2 + l / 10.0)::DOUBLE FROM k, range(1, 6) r(l)
 UNION ALL SELECT 'window_shgc', 'solar_heat_gain_shgc', '玻璃SHGC', sg FROM k UNION ALL SELECT 'window_u', 'thermal_transmittance_u', '玻璃Ug', 1.8 FROM k WHERE ug <> 1.8::DOUBLE)
SELECT component_category, parameter_type, label, count(*) AS n, round(sum(v), 4) AS total FROM e GROUP BY 1, 2, 3""", ("v_lines",))


def _index_pages(s, d):
    return pages(s, d).select("page_id", "url", F.concat("html", F.lit('<a href="/list/'), (c("page_id") % 60).cast("string"), F.lit('.html">关于公布 建筑节能材料'), F.when(c("page_id") % 3 > 0, "公示名单").otherwise(""), F.lit("</a>")).alias("html"))


add("X17_publicity_pages", lambda s, d: Wb.publicity_pages(_index_pages(s, d)).select("page_id", "title", "url"), """WITH p AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/list/' || (page_id % 60) || '.html' AS url FROM pages WHERE page_id % 3 > 0)
SELECT min(page_id) AS page_id, '关于公布 建筑节能材料公示名单' AS title, url FROM p GROUP BY url""")


def _att(s, d):
    p = pages(s, d).select("page_id", "url", F.concat("html", F.lit('<a href="https://x.gov.cn/'), (c("page_id") % 90).cast("string"), F.lit('.pdf">门窗幕墙</a>')).alias("html"))
    t = _texts(s, d).select("doc_id", "text", F.concat(F.lit("https://x.gov.cn/"), c("doc_id").cast("string"), F.lit(".pdf")).alias("url"))
    return Wb.attachment_candidates(p, t)


add("X18_attachment_candidates", lambda s, d: _att(s, d).select("doc_id", "component_category", "parameter_type", "name", "value", "unit"))


def _x19(s, d):
    t = _table_pages(s, d).select(c("page_id").alias("src_id"), F.concat(F.lit("http://a.b/"), c("page_id").cast("string")).alias("url"), c("html").alias("body"))
    m = t.select("src_id", F.lit("").alias("title"), "url", F.lit("").alias("local_path"))
    return Wb.collect_manifest(m, t.select(c("url").alias("key"), F.lit("text/html").alias("kind"), "body"))


add("X19_collect_manifest", lambda s, d: _x19(s, d).select("src_id", "component_category", "parameter_type", "name", "value", "unit"), QUERIES["X1_candidates_from_pages"][1].replace("SELECT report_id AS page_id,", "SELECT report_id AS src_id,").replace(", 'REP-' || line_id AS source_report_id", ""))
add("X20_material_source_manifest", lambda s, d: Wb.material_source_manifest(_seed_pages(s, d).withColumn("fetch_error", F.when(c("page_id") % 10 == 0, "timeout"))).groupBy("source_type", "priority", "review_status").agg(F.count("*").alias("n")))
add("S7_decode_pages", lambda s, d: H.decode_pages(pages(s, d).select("page_id", c("html").alias("h"), F.encode("html", "UTF-8").alias("content"), F.lit("text/html").alias("content_type")).select("page_id", "h", "content", "content_type")).select("page_id", "charset", (c("html") == c("h")).alias("same")),
    "SELECT page_id, 'utf-8' AS charset, true AS same FROM pages")
add("X2_candidates_from_text", lambda s, d: Wb.candidates_from_text(_texts(s, d)).select("doc_id", "component_category", "parameter_type", "name", "value", "unit"))
