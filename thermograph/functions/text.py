"""Text normalisation, number and unit parsing as column expressions."""

from __future__ import annotations

from html.entities import name2codepoint

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from thermograph.functions.stages import let

WHITESPACE = r"(?U)[\s\x1c-\x1f]+"


def clean(c: Column) -> Column:
    """Null to empty, any run of Unicode whitespace to one space, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), WHITESPACE, " "))


def clean_cell(c: Column) -> Column:
    """As ``clean``; also drops byte-order marks and edge commas."""
    t = clean(F.replace(F.coalesce(c, F.lit("")), F.lit("﻿"), F.lit("")))
    return F.regexp_replace(t, r"^,+|,+$", "")


def clean_lower(c: Column) -> Column:
    return F.lower(clean(c))


def contains_any(text: Column, words) -> Column:
    """True when any word occurs: one literal alternation, kept in codegen."""
    return text.rlike("|".join(re.escape(w) for w in words))


def first_contained(text: Column, words) -> Column:
    """The first word in list order that occurs, or null."""
    return F.coalesce(*[F.when(text.contains(w.lower()), F.lit(w)) for w in words])


def hit_count(text: Column, words) -> Column:
    return reduce(lambda a, b: a + b, [text.contains(w.lower()).cast("int") for w in words])


def hit_list(text: Column, words, sep: str = "|") -> Column:
    """Words that occur, in list order, joined."""
    return F.concat_ws(sep, *[F.when(text.contains(w.lower()), F.lit(w)) for w in dict.fromkeys(words)])


# -- keys and names ---------------------------------------------------------

def normalize_path_key(c: Column) -> Column:
    t = F.lower(F.replace(clean(c), F.lit("/"), F.lit("\\")))
    return F.regexp_replace(t, r"^[a-z]:\\", "")


def report_key(c: Column) -> Column:
    """Report id without its trailing hash, double or single underscore."""
    t = F.regexp_replace(clean(c), r"(?i)__[0-9a-f]{10,12}$", "")
    return F.regexp_replace(t, r"(?i)_[0-9a-f]{10,12}$", "")


def source_report_id(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)__[0-9a-f]{10,12}$", "")


def last_path_part(c: Column) -> Column:
    return F.element_at(F.split(c, r"\\"), -1)


def short_report_id(c: Column) -> Column:
    return last_path_part(report_key(c))


def report_short_id(c: Column) -> Column:
    """The second non-empty part between double underscores, else the whole."""
    t = clean(c)
    parts = F.filter(F.split(t, "__"), lambda p: p != "")
    return F.when(F.size(parts) >= 2, F.element_at(parts, 2)).otherwise(t)


def path_stem(c: Column) -> Column:
    """Last path component without its final suffix."""
    name = F.element_at(F.split(clean(c), r"[\\/]"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def path_suffix(c: Column) -> Column:
    name = F.element_at(F.split(clean(c), r"[\\/]"), -1)
    return F.lower(F.regexp_extract(name, r".(\.[^.]+)$", 1))


def safe_name(c: Column, limit: int | None = None, fallback: str = "unknown") -> Column:
    t = F.regexp_replace(clean(c), r'[<>:"/\\|*?]+', "_")
    if limit:
        t = F.substring(t, 1, limit)
    return F.when(t == "", fallback).otherwise(t)


def slug(url: Column, ext: Column) -> Column:
    """File name for a URL: decoded stem with other signs turned to hyphens."""
    path = F.try_url_decode(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    word = lambda c, p: F.regexp_replace(F.regexp_replace(c, p, "-"), r"^-+|-+$", "")
    stem = word(path_stem(path), r"(?U)[^\w一-鿿-]+")
    whole = word(F.concat(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")), path), r"(?U)[^\w-]+")
    return F.concat(F.substring(F.when(stem == "", whole).otherwise(stem), 1, 90), ext)


def content_key(readable: Column, source: Column, algorithm: str = "sha1") -> Column:
    """Readable part plus a short digest of the source string."""
    digest = F.substring(F.sha1(source), 1, 10) if algorithm == "sha1" else F.substring(F.sha2(source, 256), 1, 8)
    return F.concat(readable, F.lit("__"), digest)


PLACEHOLDERS = ("------", "——")


def choose_name(*candidates: Column) -> Column:
    """The first candidate that is neither blank nor a placeholder dash."""
    def usable(c):
        t = clean(c)
        return F.when((t != "") & ~t.isin(*PLACEHOLDERS), t)
    return F.coalesce(*[usable(c) for c in candidates])


def append_unique(existing: Column, value: Column) -> Column:
    """Append to a '; ' list unless the value is blank or already there."""
    e, v = clean(existing), clean(value)
    parts = F.filter(F.transform(F.split(e, ";"), lambda x: F.trim(x)), lambda p: p != "")
    joined = F.array_join(F.when(F.array_contains(parts, v), parts).otherwise(F.array_append(parts, v)), "; ")
    return F.when(v == "", e).when(e == "", v).otherwise(joined)


# -- numbers and units ------------------------------------------------------

NUMBER = r"(?U)[-+]?\d+(?:\.\d+)?"
U_UNIT, LAMBDA_UNIT, R_UNIT = "W/(m2·K)", "W/(m·K)", "m2·K/W"

# Unit patterns in order of trial, first hit wins.
VALUE_UNIT_PATTERNS = [
    r"W\s*/\s*\(?\s*(?:㎡|m2|m²)\s*[·.・]?\s*K\s*\)?",
    r"W\s*/\s*\(?\s*m\s*[·.・]\s*K\s*\)?",
    r"W\s*/\s*\([^)]*K\)",
    r"\(?\s*(?:㎡|m2|m²)\s*[·.・]\s*K\s*\)?\s*/\s*W",
]
MATERIAL_UNIT_PATTERNS = [
    r"W/[（(]?m[·.]?K[）)]?", r"W/[（(]?m²[·.]?K[）)]?", r"W/[（(]?m2[·.]?K[）)]?",
    r"[（(]?m²[·.]?K[）)]?/W", r"[（(]?m2[·.]?K[）)]?/W", r"kg/m²", r"kg/m2", r"g/m²", r"g/m2", r"kN", r"MPa", r"%",
]
FOCUSED_UNIT_PATTERNS = [
    r"W/\(?m[²2]?[·.]?K\)?", r"W/[（(]?m[²2]?[·.]?K[）)]?", r"[（(]?m[²2][·.]?K[）)]?/W", r"kg/m[³3]", r"kg/m[²2]",
    r"g/m[²2]", r"m[³3]/h", r"m[²2]", r"mm", r"cm", r"lm", r"kW", r"W", r"%",
]
WALL_UNIT_PATTERNS = [
    r"W/[（(]?m[²2]?[·.]?K[）)]?", r"W/\(?m[²2]?[·.]?K\)?", r"[（(]?m[²2][·.]?K[）)]?/W", r"\(?m[²2][·.]?K\)?/W",
]


def normalize_unit(c: Column) -> Column:
    """Bring unit spellings to the three thermal units where they match."""
    t = clean(c)
    for old, new in (("㎡", "m2"), ("m²", "m2"), ("•", "·"), (".", "·"), ("（", "("), ("）", ")")):
        t = F.replace(t, F.lit(old), F.lit(new))
    return let(F.regexp_replace(t, WHITESPACE, ""), lambda t: (
        F.when(t.contains("W/(m2") | t.contains("W/m2"), U_UNIT)
        .when(t.contains("W/(m·K)") | t.contains("W/m·K"), LAMBDA_UNIT)
        .when(t.rlike(r"(?i)W/\([^)]*m[^)]*K\)"), LAMBDA_UNIT)
        .when(t.rlike(r"(?i)W/\([^)]*K\)"), U_UNIT)
        .when(t.contains("m2·K/W") | t.contains("(m2·K)/W"), R_UNIT)
        .otherwise(t)
    ))


def parse_value_unit(c: Column) -> Column:
    """struct(value, unit): the last number in front of the first unit."""
    def try_unit(t: Column, p: str) -> Column:
        def found(unit: Column) -> Column:
            before = F.call_function("substring_index", t, unit, F.lit(1))
            return F.when(unit != "", let(F.regexp_extract_all(before, F.lit(NUMBER), F.lit(0)), lambda numbers: F.when(
                F.size(numbers) > 0, F.struct(F.get(numbers, F.size(numbers) - 1).alias("value"), unit.alias("unit")))))
        return let(F.regexp_extract(t, "(?iU)" + p, 0), found)

    hit = let(clean(c), lambda t: F.coalesce(*[try_unit(t, p) for p in VALUE_UNIT_PATTERNS]))
    return let(hit, lambda h: F.when(h.isNotNull(), F.struct(h["value"].try_cast("double").alias("value"), normalize_unit(h["unit"]).alias("unit"))))


def first_number(c: Column) -> Column:
    return F.regexp_extract(clean(c), NUMBER, 0)


def first_unit(c: Column, patterns) -> Column:
    t = clean(c)
    return F.coalesce(*[F.nullif(F.regexp_extract(t, "(?i)" + p, 0), F.lit("")) for p in patterns], F.lit(""))


def number_after_keyword(text: Column, keyword: str) -> Column:
    """First free-standing number at or after the keyword."""
    at = F.locate(keyword.lower(), F.lower(text))
    fragment = F.when(at > 0, F.substring(text, at, F.length(text))).otherwise(text)
    n = F.regexp_extract(fragment, r"(?<![\d.])(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?![\d.])", 0)
    return F.when(n != "", n.try_cast("double"))


# Fixed values: (type, pattern) of thermal mentions in running text.
MENTION_PATTERNS = [
    ("thermal_transmittance_u",
     r"(?:传热系数|K\s*[=：:])[^。；;\n]{0,40}?([-+]?\d+(?:\.\d+)?)\s*(W\s*/\s*[（(]?\s*m[²2]?\s*[·.]?\s*K\s*[）)]?)"),
    ("thermal_resistance_r",
     r"(?:热阻|R\s*[=：:])[^。；;\n]{0,40}?([-+]?\d+(?:\.\d+)?)\s*([（(]?\s*m[²2]\s*[·.]?\s*K\s*[）)]?\s*/\s*W)"),
    ("thermal_conductivity_lambda",
     r"(?:导热系数)[^。；;\n]{0,60}?([-+]?\d+(?:\.\d+)?)\s*(W\s*/\s*[（(]?\s*m\s*[·.]?\s*K\s*[）)]?)"),
]


def thermal_mentions(c: Column) -> Column:
    """array<struct(parameter_type, numeric_value, unit, raw_value, evidence)>.

    Match offsets follow from the pieces between matches, so the 24 signs of
    context on each side need no user-defined function.
    """
    t = clean(c)
    found = []
    for kind, p in MENTION_PATTERNS:
        p = "(?iU)" + p
        raw = F.regexp_extract_all(t, F.lit(p), F.lit(0))
        number = F.regexp_extract_all(t, F.lit(p), F.lit(1))
        unit = F.regexp_extract_all(t, F.lit(p), F.lit(2))
        pieces = F.split(t, p)

        found.append(_mention_rows(t, kind, raw, number, unit, pieces))
    empty = F.array().cast("array<struct<parameter_type:string,numeric_value:string,unit:string,raw_value:string,evidence:string>>")
    return F.concat(empty, *found)


def _mention_rows(t, kind, raw, number, unit, pieces) -> Column:
    def row(m, i):
        start = (F.aggregate(F.slice(pieces, 1, i + 1), F.lit(0), lambda a, s: a + F.length(s))
                 + F.aggregate(F.slice(raw, 1, i), F.lit(0), lambda a, s: a + F.length(s)))
        lo = F.greatest(start - 24, F.lit(0))
        hi = start + F.length(m) + 24
        return F.struct(F.lit(kind).alias("parameter_type"), F.get(number, i).alias("numeric_value"),
                        clean(F.get(unit, i)).alias("unit"), clean(m).alias("raw_value"),
                        clean(F.substring(t, lo + 1, hi - lo)).alias("evidence"))
    return F.transform(raw, row)


VERDICT_WORDS = ["符合", "不符合", "合格", "不合格", "——", "-", "/"]


def measured_value_cell(cells: Column) -> Column:
    """Last cell that holds a digit and a unit letter and is no verdict."""
    ok = lambda x: ~clean(x).isin(*VERDICT_WORDS) & clean(x).rlike(r"(?U)\d") & clean(x).rlike(r"(?i)(W|m[²2]|K)")
    hits = F.filter(F.reverse(cells), ok)
    return F.coalesce(clean(F.get(hits, F.lit(0))), F.lit(""))


def parse_dimension_metres(c: Column) -> Column:
    """Dimension text to metres: millimetres by default, 'm' when suffixed.

    Ratios, areas, words and decimal millimetres below 100 are rejected.
    """
    t = F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit(""))
    num = F.regexp_extract(t, r"(?U)^(\d+(?:\.\d+)?)(mm|m)?$", 1)
    unit = F.regexp_extract(t, r"(?U)^(\d+(?:\.\d+)?)(mm|m)?$", 2)
    v = num.try_cast("double")
    bad_decimal = (unit != "m") & num.contains(".") & (v < 100)
    return F.when((num != "") & (v > 0) & ~bad_decimal, F.when(unit == "m", v).otherwise(v / 1000.0))


def dimension_text(text: Column, vertical: Column) -> Column:
    """Vertical figures read backwards start with 0; reverse when that helps."""
    t = F.trim(text)
    back = F.reverse(t)
    return F.when(vertical & t.startswith("0") & ~back.startswith("0"), back).otherwise(t)


# -- URLs and titles --------------------------------------------------------

def url_path_lower(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))


def url_host_lower(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


# Hosts whose pages may be mined.
TRUSTED_SUFFIXES = (".gov.cn", "gov.cn")


def trusted_domain(url: Column, suffixes=TRUSTED_SUFFIXES) -> Column:
    host = url_host_lower(url)
    return reduce(lambda a, b: a | b, [(host == s) | host.endswith(s) for s in suffixes])


def ends_with_any(c: Column, suffixes) -> Column:
    return reduce(lambda a, b: a | b, [c.endswith(s) for s in suffixes])


def infer_source_type(url: Column) -> Column:
    p = url_path_lower(url)
    return (F.when(p.endswith(".pdf"), "pdf").when(ends_with_any(p, (".doc", ".docx")), "docx")
            .when(ends_with_any(p, (".xls", ".xlsx", ".csv")), "spreadsheet").otherwise("html"))


KNOWN_EXTENSIONS = (".xls", ".xlsx", ".pdf", ".doc", ".docx", ".csv", ".txt", ".jpg", ".jpeg", ".png")


def infer_ext(url: Column, content_type: Column) -> Column:
    p = url_path_lower(url)
    by_path = F.coalesce(*[F.when(p.endswith(e), e) for e in KNOWN_EXTENSIONS])
    ct = F.coalesce(content_type, F.lit(""))
    by_type = (F.when(ct.contains("pdf"), ".pdf").when(ct.contains("jpeg"), ".jpg").when(ct.contains("png"), ".png")
               .when(ct.contains("excel") | ct.contains("spreadsheet"), ".xls").otherwise(".html"))
    return F.coalesce(by_path, by_type)


def source_type_for_ext(ext: Column) -> Column:
    return (F.when(ext.isin(".xls", ".xlsx", ".csv"), "official_product_list_spreadsheet")
            .when(ext == ".pdf", "official_product_list_pdf")
            .when(ext.isin(".jpg", ".jpeg", ".png"), "official_product_list_image")
            .when(ext.isin(".doc", ".docx"), "official_product_list_doc")
            .otherwise("official_product_notice_html"))


def html_unescape(c: Column) -> Column:
    """Numeric entities and the named ones of HTML 4, each decoded once; a no-break space becomes a blank.

    Unknown names and numbers outside of Unicode stay as they are.
    """
    named = F.create_map(*[F.lit(x) for name, point in sorted(name2codepoint.items()) for x in ("&" + name + ";", " " if name == "nbsp" else chr(point))], F.lit("&apos;"), F.lit("'"))

    def decoded(t: Column) -> Column:
        digits = F.regexp_extract(t, "^&#([0-9]{1,7});$", 1)
        hexes = F.regexp_extract(t, "^&#[xX]([0-9a-fA-F]{1,6});$", 1)
        point = F.when(digits != "", digits.cast("int")).when(hexes != "", F.conv(hexes, 16, 10).cast("int"))
        fine = point.between(1, 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        number = F.when(point == 160, " ").when(fine, F.decode(F.unhex(F.lpad(F.hex(point.cast("long")), 8, "0")), "UTF-32"))
        return F.when(t.startswith("&") & t.endswith(";"), F.coalesce(number, F.try_element_at(named, t), t)).otherwise(t)

    parts = F.regexp_extract_all(c, F.lit("(?s)&#?[A-Za-z0-9]+;|[^&]+|&"), F.lit(0))
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(parts, decoded), "")).otherwise(c)


def unwrap_redirect_url(c: Column) -> Column:
    """Target of a search-engine click link, else the cleaned URL itself."""
    url = html_unescape(clean(c))
    host = F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))
    click = host.endswith("bing.com") & (F.try_parse_url(url, F.lit("PATH")) == "/ck/a")
    value = F.try_url_decode(F.coalesce(F.try_parse_url(url, F.lit("QUERY"), F.lit("u")), F.try_parse_url(url, F.lit("QUERY"), F.lit("url"))))
    payload = F.translate(F.substring(value, 3, 1 << 20), "-_", "+/")
    padded = F.rpad(payload, (F.ceil(F.length(payload) / 4) * 4).cast("int"), F.lit("="))
    decoded = F.when(value.startswith("a1"), F.try_to_binary(padded, F.lit("base64")).cast("string"))
    http = decoded.startswith("http://") | decoded.startswith("https://")
    return F.when(click & value.isNotNull(), F.when(F.coalesce(http, F.lit(False)), decoded).otherwise(value)).otherwise(url)


def resolve_url(base: Column, href: Column) -> Column:
    """Join a link to its page: scheme, host, root, query and relative forms.

    ``.`` and ``..`` parts are folded with an array aggregate over the path's
    own (short) segments.
    """
    h = F.trim(href)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    base_path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    base_query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    folder = F.regexp_extract(base_path, r"^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    path = F.regexp_extract(h, r"^([^?#]*)", 1)
    tail = F.substring(h, F.length(path) + 1, 1 << 20)
    joined = F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))
    parts = F.split(joined, "/")
    folded = F.aggregate(
        F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc).otherwise(F.array_append(acc, s)))
    last = F.element_at(parts, -1)
    normal = F.concat(F.lit("/"), F.array_join(folded, "/"), F.when(last.isin(".", "..") & (F.size(folded) > 0), "/").otherwise(""))
    fragment = F.regexp_extract(h, r"(#.*)$", 1)
    return (
        F.when(h == "", base)
        .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(h.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), h))
        .when(h.startswith("?"), F.concat(root, base_path, tail))
        .otherwise(F.concat(root, normal, tail))
    )


# Regions in order of search.
REGIONS = ("常德", "岳阳", "衡阳", "邵阳", "湘潭", "上海", "重庆")


def infer_region(c: Column) -> Column:
    return F.coalesce(*[F.when(c.contains(r), r) for r in REGIONS], F.lit(""))


def infer_batch(c: Column) -> Column:
    dated = F.regexp_extract(c, r"(\d{4}年[^，,、]*?第[一二三四五六七八九十]+批)", 1)
    bare = F.regexp_extract(c, r"(第[一二三四五六七八九十]+批)", 1)
    return F.when(dated != "", dated).otherwise(bare)


def strip_tags(c: Column, by: str = " ") -> Column:
    return F.regexp_replace(c, r"<[^>]+>", by)


def page_title(html: Column) -> Column:
    """First heading, else the title element, else a line that names energy-saving materials."""
    h1 = F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    title = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    has_h1 = html.rlike(r"(?is)<h1[^>]*>.*?</h1>")
    has_title = html.rlike(r"(?is)<title[^>]*>.*?</title>")
    lines = F.filter(F.split(html, r"\r\n|\r|\n"), lambda s: s.contains("建筑节能") & (s.contains("材料") | s.contains("产品")))
    return (F.when(has_h1, clean(strip_tags(h1))).when(has_title, clean(strip_tags(title)))
            .otherwise(F.coalesce(clean(strip_tags(F.get(lines, F.lit(0)))), F.lit(""))))


# Glass-name prefixes removed repeatedly.
GLASS_PREFIXES = [
    "两玻一腔 中空玻璃 普通 ", "三玻两腔 中空玻璃 普通 ", "热致调光 单腔中空 玻璃 普通 ", "热致调光 两腔中空 玻璃 双单银 ",
    "单银 ", "双银 ", "三银 ", "透明 ", "普通 ",
]


def strip_prefixes(c: Column, prefixes=GLASS_PREFIXES) -> Column:
    """Drop listed prefixes from the front until none is left."""
    return F.trim(F.regexp_replace(clean(c), "^(?:" + "|".join(p.rstrip() + r"\s" for p in prefixes) + r"\s*)+", ""))
