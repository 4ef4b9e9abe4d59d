"""Candidates and sources mined from web pages and catalog texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermograph.functions import text as X
from thermograph.functions.stages import let, pin
from thermograph.operators import classify as C
from thermograph.operators.relational import keep_first
from thermograph.sources.html import html_links, html_table_rows, split_text_units

CANDIDATE_KEY = ["component_category", "parameter_type", "name", "value", "unit", "source_url"]


def candidate_columns(df: DataFrame, context: str, name: str) -> DataFrame:
    """Value, unit, type, component and name of a context; rows without drop."""
    c = F.col(context)
    df = pin(df, _vu=X.parse_value_unit(c))
    shgc = F.regexp_extract(c, r"(?U)(?:SHGC|Shgc|太阳得热系数)\s*[=:：]?\s*(\d+(?:\.\d+)?)", 1)
    df = pin(df, value=F.coalesce(F.col("_vu.value"), F.when(shgc != "", shgc.try_cast("double"))), unit=F.coalesce(F.col("_vu.unit"), F.lit(""))).filter("value IS NOT NULL")
    df = pin(df, parameter_type=C.classify_parameter(F.col("unit"), c)).filter("parameter_type <> ''")
    df = pin(df, component_category=C.classify_component(c, F.col("parameter_type")))
    label = (F.when(F.col("parameter_type") == "thermal_transmittance_u", "传热系数").when(F.col("parameter_type") == "thermal_conductivity_lambda", "导热系数")
             .when(F.col("parameter_type") == "thermal_resistance_r", "热阻").otherwise("太阳得热系数"))
    given = X.clean(F.col(name))
    return df.withColumns({"name": F.when(given == "", F.concat_ws(" ", "component_category", label)).otherwise(given), "source_text": X.clean(c)}).drop("_vu")


def dedupe_candidates(df: DataFrame, order: list[str]) -> DataFrame:
    return keep_first(df, CANDIDATE_KEY, order)


def _by_header(words) -> Column:
    """First cell whose header holds all words, else blank."""
    z = F.arrays_zip(F.col("headers").alias("h"), F.col("cells").alias("v"))
    ok = lambda s: s["v"].isNotNull() & s["h"].isNotNull() & (F.lit(True) if not words else _all(s["h"], words))
    return F.coalesce(F.get(F.filter(z, ok), F.lit(0))["v"], F.lit(""))


def _all(h: Column, words) -> Column:
    out = h.contains(words[0])
    for w in words[1:]:
        out = out & h.contains(w)
    return out


def candidates_from_pages(pages: DataFrame) -> DataFrame:
    """Parameter candidates from the tables of HTML pages.

    ``pages``: page_id, url, title, html.
    """
    r = html_table_rows(pages)
    n = F.size("cells")
    name = F.coalesce(F.nullif(_by_header(("材料", "产品", "名称")), F.lit("")), F.when(n > 3, F.get("cells", F.lit(3))), F.lit(""))
    code = F.get(F.filter("cells", lambda x: x.rlike(r"\b[A-Z]{2,}[A-Z0-9-]{4,}\b")), F.lit(0))
    report = F.coalesce(F.nullif(_by_header(("报告", "编号")), F.lit("")), F.when(n > 6, F.get("cells", F.lit(6))).otherwise(code), F.lit(""))
    r = r.withColumns({"_name": name, "source_report_id": X.clean(report), "_context": F.array_join("cells", " "), "source_url": F.col("url"), "source_title": F.col("title")})
    c = candidate_columns(r, "_context", "_name")
    return dedupe_candidates(c, ["page_id", "table_no", "row_no"]).select(
        "page_id", *CANDIDATE_KEY, "source_title", "source_report_id", "source_text", F.lit("").alias("notes"), F.lit("pending").alias("review_status"))


# Labels of the catalog columns.
CATALOG_LEVELS = ["玻璃Ug", "典型门窗幕墙1.0级", "典型门窗幕墙2.0级", "典型门窗幕墙3.0级", "典型门窗幕墙4.0级", "典型门窗幕墙5.0级"]
CATALOG_MARKS = ("典型门窗幕墙热工参数目录", "典型玻璃的光学")
NOTE_LEVELS = "重庆门窗幕墙热工参数目录表格抽取；典型门窗幕墙等级值需审核适用范围。"
NOTE_OPTICAL = "重庆典型玻璃光学热工性能参数表抽取。"
U_ROW = r"^(?:\d+\s+)?(.+?)\s+(\d+\.\d+)\s+(\d+\.\d+)\s+(\d+\.\d+)\s+(\d+\.\d+)\s+(\d+\.\d+)\s+(\d+\.\d+)\s*$"
OPTICAL_ROW = r"^\d+\s+(.+?)\s+(\d+\.\d+)\s+(\d+\.\d+)\s+[—-]\s+(\d+\.\d+)(?:\s|$)"


def window_catalog_rows(lines: DataFrame) -> DataFrame:
    """Fixed-column catalog lines to candidates: six U-values, or SHGC and Ug.

    ``lines``: doc_id, line_no, line (cleaned), source_url.
    """
    row = lambda cat, kind, name, label, v, unit, note: F.struct(
        F.lit(cat).alias("component_category"), F.lit(kind).alias("parameter_type"), F.concat(name, F.lit(f" - {label}")).alias("name"),
        v.try_cast("double").alias("value"), F.lit(unit).alias("unit"), F.lit(note).alias("notes"))
    g = lambda p, i: F.regexp_extract("line", p, i)
    # A cleaned line holds single spaces: the numbers of a U row are its last six words.
    last = F.slice(F.split("line", " "), -len(CATALOG_LEVELS), len(CATALOG_LEVELS))
    six = let(F.struct(X.strip_prefixes(g(U_ROW, 1)).alias("name"), last.alias("v")), lambda n: F.array(*[row("window_u", "thermal_transmittance_u", n["name"], lab, n["v"][i], X.U_UNIT, NOTE_LEVELS) for i, lab in enumerate(CATALOG_LEVELS)]))
    two = let(X.strip_prefixes(g(OPTICAL_ROW, 1)), lambda n: F.array(row("window_shgc", "solar_heat_gain_shgc", n, "玻璃SHGC", g(OPTICAL_ROW, 3), "", NOTE_OPTICAL), row("window_u", "thermal_transmittance_u", n, "玻璃Ug", g(OPTICAL_ROW, 4), X.U_UNIT, NOTE_OPTICAL)))
    empty = F.array().cast("array<struct<component_category:string,parameter_type:string,name:string,value:double,unit:string,notes:string>>")
    both = F.concat(F.when(F.col("line").rlike(U_ROW), six).otherwise(empty), F.when(F.col("line").rlike(OPTICAL_ROW), two).otherwise(empty))
    e = pin(lines, _both=both).select("doc_id", "source_url", "line_no", "line", F.posexplode("_both").alias("item_no", "r"))
    return e.select("doc_id", "source_url", "line_no", "item_no", F.col("line").alias("source_text"), "r.*")


def candidates_from_text(docs: DataFrame) -> DataFrame:
    """Candidates from plain texts; a catalog document yields only catalog rows.

    ``docs``: doc_id, text, source_url. A document counts as a catalog when it
    carries a catalog mark and at least one line parses.
    """
    lines = F.transform(F.split("text", r"\r\n|\r|\n"), X.clean)
    docs = docs.withColumn("_marked", F.coalesce(X.contains_any(F.col("text"), CATALOG_MARKS), F.lit(False)))
    # Each text tells by itself whether a line of it parses: no second parse and no join.
    docs = pin(docs, _catalog=F.when(F.col("_marked"), F.exists(lines, lambda l: l.rlike(U_ROW) | l.rlike(OPTICAL_ROW))).otherwise(F.lit(False))).drop("_marked")
    catalog = window_catalog_rows(pin(docs.filter("_catalog"), _lines=lines).select("doc_id", "source_url", F.posexplode("_lines").alias("line_no", "line")).filter("line <> ''"))
    rest = docs.filter("NOT _catalog").drop("_catalog")
    units = split_text_units(rest).withColumn("_name", F.lit(""))
    plain = candidate_columns(units.withColumnRenamed("unit", "context"), "context", "_name")
    cols = ["doc_id", "component_category", "parameter_type", "name", "value", "unit", "source_url", "source_text"]
    return dedupe_candidates(catalog, ["doc_id", "line_no", "item_no"]).select(*cols, "notes").unionByName(
        dedupe_candidates(plain, ["doc_id", "unit_no"]).select(*cols, F.lit("").alias("notes")))


def discover_links(pages: DataFrame, trusted=X.TRUSTED_SUFFIXES, seed: bool = True) -> DataFrame:
    """Scored links of pages, one row per target URL.

    Links resolve against their page; only web targets stay. The best-ranked
    page keeps a URL that several pages share. ``seed`` applies the stricter
    rule for curated start pages.
    """
    l = html_links(pages.select("page_id", F.col("url").alias("page_url"), "html"))
    l = pin(l, _target=X.unwrap_redirect_url(F.col("href")))
    l = pin(l, url=X.resolve_url(F.col("page_url"), F.col("_target"))).drop("_target").filter(F.col("url").rlike("^https?://"))
    l = keep_first(l, ["url"], ["page_id", "link_pos"]).withColumn("snippet", F.lit(""))
    s = C.score_source(l, trusted=trusted).filter("review_status <> 'reject'")
    if seed:
        s = s.filter(C.relevant_seed_link(s))
    return s.select("page_id", "link_pos", F.col("url_resolved").alias("url"), F.col("title_clean").alias("title"), "source_type", "component_hint", "parameter_hint", "confidence", "notes", "review_status")


def publicity_pages(index_pages: DataFrame) -> DataFrame:
    """Distinct publicity pages linked from index pages, by title rule."""
    l = html_links(index_pages.select("page_id", F.col("url").alias("page_url"), "html"))
    l = pin(l.filter(C.publicity_title(F.col("title"))), url=X.resolve_url(F.col("page_url"), F.col("href")))
    return keep_first(l, ["url"], ["page_id", "link_pos"]).select("page_id", "link_pos", "title", "url")


def publicity_candidates(index_pages: DataFrame, content: DataFrame) -> DataFrame:
    """Candidates of the publicity pages, from a table of fetched pages."""
    links = publicity_pages(index_pages).select("url", F.col("title").alias("link_title"))
    hit = content.join(links, "url").select("page_id", "url", F.col("link_title").alias("title"), "html")
    return candidates_from_pages(hit)


def attachment_candidates(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """Candidates of thermal PDF attachments, from their extracted texts."""
    l = html_links(pages.select("page_id", F.col("url").alias("page_url"), "html"))
    l = pin(l, url=X.resolve_url(F.col("page_url"), F.col("href"))).filter(C.relevant_attachment(F.col("title"), F.col("url")))
    l = keep_first(l, ["url"], ["page_id", "link_pos"]).select("url")
    return candidates_from_text(texts.join(l, "url", "left_semi").select("doc_id", "text", F.col("url").alias("source_url")))


def collect_manifest(manifest: DataFrame, content: DataFrame) -> DataFrame:
    """Route manifest rows to table or text extraction, then de-duplicate.

    ``manifest``: src_id, title, url, local_path; ``content``: key, kind
    (content type), body. A local path goes before the URL.
    """
    m = manifest.withColumn("key", F.when(X.clean(F.col("local_path")) != "", F.col("local_path")).otherwise(F.col("url")))
    j = m.join(content, "key")
    suffix = X.path_suffix(F.regexp_replace("key", r"\?.*$", ""))
    local = X.clean(F.col("local_path")) != ""
    is_html = F.when(local, suffix.isin(".html", ".htm")).otherwise(~suffix.eqNullSafe(".pdf") & ~F.lower("kind").contains("pdf") & (F.lower("kind").contains("html") | F.lower("body").contains("<table")))
    src = F.when(X.clean(F.col("url")) != "", F.col("url")).otherwise(F.col("key"))
    title = F.when(X.clean(F.col("title")) != "", F.col("title")).otherwise(F.when(local, X.path_stem(F.col("key"))).otherwise(src))
    j = j.withColumns({"_html": is_html, "source_url": src, "source_title": title})
    html = candidates_from_pages(j.filter("_html").select(F.col("src_id").alias("page_id"), F.col("source_url").alias("url"), F.col("source_title").alias("title"), F.col("body").alias("html")))
    text = candidates_from_text(j.filter("NOT _html").select(F.col("src_id").alias("doc_id"), F.col("body").alias("text"), "source_url"))
    cols = [*CANDIDATE_KEY, "source_text"]
    both = html.select(F.col("page_id").alias("src_id"), *cols).unionByName(text.select(F.col("doc_id").alias("src_id"), *cols))
    return dedupe_candidates(both, ["src_id", "source_text"])


def material_source_manifest(pages: DataFrame) -> DataFrame:
    """Page rows and their attachment rows; failed fetches stay as rows.

    ``pages``: page_id, url, html, fetch_error (null when fetched).
    """
    title = X.page_title(F.col("html"))
    failed = F.col("fetch_error").isNotNull()
    page = pages.select("page_id", F.lit(-1).alias("link_pos"), F.when(failed, "FETCH_FAILED").otherwise(F.when(title == "", X.path_stem(F.col("url"))).otherwise(title)).alias("title"), "url",
                        F.when(failed, "unknown").otherwise(X.source_type_for_ext(X.infer_ext(F.col("url"), F.lit("text/html")))).alias("source_type"),
                        F.when(failed, "low").when(X.contains_any(title, ("湘潭", "岳阳", "上海")), "high").otherwise("medium").alias("priority"),
                        F.when(failed, "fetch_failed").otherwise("downloaded").alias("review_status"))
    l = html_links(pages.filter("fetch_error IS NULL").select("page_id", F.col("url").alias("page_url"), "html"))
    l = pin(l, url=X.resolve_url(F.col("page_url"), F.col("href"))).filter(C.attachment_link(F.col("url"), F.col("title")))
    att = l.select("page_id", "link_pos", F.when(F.col("title") == "", X.path_stem(F.col("url"))).otherwise(F.col("title")).alias("title"), "url",
                   X.source_type_for_ext(X.infer_ext(F.col("url"), F.lit("text/html"))).alias("source_type"), F.lit("medium").alias("priority"), F.lit("downloaded").alias("review_status"))
    # a page seen as a page goes before the same URL seen as an attachment
    return keep_first(page.unionByName(att), ["url"], [F.col("link_pos") >= 0, "page_id", "link_pos"])
