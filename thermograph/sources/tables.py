"""Report folders, manifests, SQL dumps and fixed-layout text tables."""

from __future__ import annotations

import re
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermograph.functions import text as X
from thermograph.operators.relational import latest

META_FIELDS = ["report_id", "table_index", "row_index", "field", "value"]
ITEM_FIELDS = ["report_id", "table_index", "row_index", "section", "seq", "item_name", "requirement", "result", "conclusion", "raw_row"]
TRACE_FIELDS = ["report_id", "sequence", "block_type", "table_index", "row_index", "col_index", "text", "row_text"]
SUMMARY_COLUMNS = ["report_id", "status", "work_id", "source_doc"]


def string_schema(fields: list[str]) -> T.StructType:
    return T.StructType([T.StructField(f, T.StringType()) for f in fields])


def read_string_csv(spark: SparkSession, paths: str | list[str], fields: list[str], multi_line: bool = True) -> DataFrame:
    """Header CSV with every column a string; no file means no rows.

    A leading byte-order mark is dropped. Columns are matched by header name:
    files are grouped by their first line, and each group is read with its own
    header. The driver holds one path per file, as it does for any listing.
    """
    try:
        heads = spark.read.text(paths).select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), "value").filter("b = 0")
        heads = heads.groupBy("p").agg(F.min_by("value", "i").alias("head")).groupBy("head").agg(F.sort_array(F.collect_list("p")).alias("files")).orderBy("head").collect()
    except Exception as e:  # an absent path is an empty source
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], string_schema(fields))
        raise
    out = None
    for row in heads:
        raw = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').option("encoding", "UTF-8").csv([unquote(f) for f in row["files"]])
        names = {c.replace("\ufeff", ""): c for c in raw.columns}
        part = raw.select(*[(F.col(f"`{names[f]}`") if f in names else F.lit(None)).cast("string").alias(f) for f in fields], F.col("_metadata.file_path").alias("file_path"))
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], string_schema([*fields, "file_path"])) if out is None else out


def scan_report_folders(spark: SparkSession, root: str, kind: str, fields: list[str]) -> DataFrame:
    """``*/<kind>.csv`` below a root; the folder name is the report id."""
    df = read_string_csv(spark, f"{root}/*/{kind}.csv", [f for f in fields if f != "report_id"])
    if "file_path" not in df.columns:
        return spark.createDataFrame([], string_schema(fields))
    return df.withColumn("report_id", F.url_decode(F.regexp_extract("file_path", r"([^/]+)/[^/]+$", 1))).select(*fields)


def with_summary(rows: DataFrame, summary: DataFrame) -> DataFrame:
    """Summary columns in front of each row; blanks when there is none."""
    s = summary.select(*[c for c in SUMMARY_COLUMNS if c in summary.columns])
    extra = [c for c in s.columns if c != "report_id"]
    return rows.join(s, "report_id", "left").fillna("", subset=extra).select("report_id", *extra, *[c for c in rows.columns if c not in s.columns])


def scan_manifests_last_wins(rows: DataFrame) -> DataFrame:
    """Later file, then later row, wins per (path key, report id).

    ``rows``: file_name, pos, group, destination, report_id and more. Only
    groups under ``useful/`` count, before the override is decided.
    """
    r = rows.filter(X.clean(F.col("group")).startswith("useful/")).withColumn("_k", X.normalize_path_key(F.col("destination")))
    return latest(r.withColumn("_r", X.clean(F.col("report_id"))), ["_k", "_r"], ["file_name", "pos"]).drop("_k", "_r")


_INSERT = re.compile(r"INSERT INTO `([^`]+)` VALUES\s*(.*)", re.S)
_TOKEN = re.compile(r"'((?:[^'\\]|\\.)*)'|([^,()']+)|([,()])", re.S)
_ESCAPE = {"\\'": "'", "\\\\": "\\", "\\n": "\n", "\\r": "\r", "\\t": "\t"}


def _tuples(text: str):
    """(fields) of each tuple of one INSERT body; NULL becomes blank."""
    fields, current, depth, closed = [], None, 0, -1
    for m in _TOKEN.finditer(text):
        if m.group(3) == "(":
            depth += 1
            if depth == 1:
                fields, current = [], ""
        elif m.group(3) == ")":
            depth -= 1
            if depth == 0:
                yield fields + [current]
        elif m.group(3) == ",":
            if depth:
                fields.append(current)
                current = ""
        elif depth:
            if m.group(1) is not None:
                # A quote right behind a closed string is a doubled one inside it.
                current += "'" * (m.start() == closed) + re.sub(r"\\['\\nrt]", lambda e: _ESCAPE[e.group(0)], m.group(1))
                closed = m.end()
            elif m.group(2).strip():
                word = m.group(2).strip()
                current = "" if word.upper() == "NULL" else word


def dump_slices(statements, size: int = 10_000):
    """Frames of at most ``size`` tuples, so that a long statement is never held as tuples."""
    columns, out = ["table_name", "row_no", "fields"], []
    for text in statements:
        m = _INSERT.search(text or "")
        for i, f in enumerate(_tuples(m.group(2)) if m else ()):
            out.append((m.group(1), i, f))
            if len(out) == size:
                yield pd.DataFrame(out, columns=columns)
                out = []
    if out:
        yield pd.DataFrame(out, columns=columns)


def explode_sql_dump(statements: DataFrame, column: str = "value") -> DataFrame:
    """(table_name, row_no, fields) of every tuple of INSERT statements.

    Statements come from ``spark.read.text(path, lineSep=";\\n")``, so a file
    splits over tasks; a semicolon inside a string does not end a statement.
    """
    def parse(batches):
        for pdf in batches:
            yield from dump_slices(pdf["s"])
    return statements.select(F.col(column).alias("s")).mapInPandas(parse, "table_name string, row_no int, fields array<string>")


def read_artifact_json(df: DataFrame, column: str, schema_version: int, backends: list[str], default_backend: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantine) recognition documents.

    Accepted: matching version, allowed backend, non-empty model version and a
    geometry with walls, windows and doors.
    """
    doc = F.col(column)
    has = lambda k: F.array_contains(F.json_object_keys(F.get_json_object(doc, "$.geometry")), k)
    j = df.withColumns({
        "_v": F.get_json_object(doc, "$.schema_version").try_cast("int"), "_b": F.coalesce(F.get_json_object(doc, "$.model.backend"), F.lit(default_backend)),
        "model_version": F.get_json_object(doc, "$.model.version")})
    ok = (F.col("_v") == schema_version) & F.col("_b").isin(*backends) & (F.coalesce("model_version", F.lit("")) != "") & has("walls") & has("windows") & has("doors")
    j = j.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    return j.filter("_ok").drop("_v", "_b", "_ok"), j.filter("NOT _ok").drop("_v", "_b", "_ok")


TAIL_NAMES = ["density", "conductivity", "specific_heat", "heat_storage", "wall_factor", "roof_factor", "floor_factor"]


def read_fixed_tail_table(lines: DataFrame, column: str = "line") -> DataFrame:
    """Name plus seven trailing numbers per line; other lines are dropped.

    Fields split at tabs when that gives eight, else at wide blanks.
    """
    parts = lambda p: F.filter(F.transform(F.split(F.trim(F.col(column)), p), lambda x: X.clean(x)), lambda x: x != "")
    tab = parts(r"\t+")
    d = lines.withColumn("_p", F.when(F.size(tab) >= 8, tab).otherwise(parts(r"\s{2,}")))
    tail = F.slice("_p", -7, 7)
    d = d.filter(~F.col(column).contains("材料名称") & (F.size("_p") >= 8))
    name = F.col("_p")[0]
    d = d.filter(~name.rlike(r"^\d+[、.]") & ~name.isin("变更前", "变更后") & F.forall(tail, lambda x: x.rlike(r"^-?\d+(?:\.\d+)?$")))
    return d.select(*lines.columns, name.alias("material_name"), *[F.get("_p", F.size("_p") - 7 + i).try_cast("double").alias(n) for i, n in enumerate(TAIL_NAMES)])


# Header words of product lists.
PRODUCT_HEADERS = {
    "category": ["类别"], "seq": ["序号"], "product_name": ["材料(产品)名称", "材料（产品）名称", "产品名称"], "standard": ["执行标准"], "public_id": ["公示编号"],
    "company": ["企业名称"], "production_address": ["生产地址"], "valid_until": ["有效期至"], "batch": ["批次"],
}


def read_header_detected_table(rows: DataFrame) -> DataFrame:
    """Product rows below a header found within the first eight rows.

    ``rows``: file_id, row_no (blank rows already dropped), cells. The header
    has a cell with 材料 and 名称 and one with 公示编号; columns map by header
    text. Rows without id, company and number are dropped.
    """
    norm = lambda x: F.replace(F.replace(X.clean_cell(x), F.lit("（"), F.lit("(")), F.lit("）"), F.lit(")"))
    heads = F.transform("cells", lambda x: norm(x))
    is_head = F.exists(heads, lambda h: h.contains("材料") & h.contains("名称")) & F.exists(heads, lambda h: h.contains("公示编号"))
    first = rows.filter(F.col("row_no") < 8).filter(is_head).groupBy("file_id").agg(F.min(F.struct("row_no", heads.alias("heads"))).alias("h"))
    j = rows.join(first, "file_id").filter(F.col("row_no") > F.col("h.row_no"))

    def cell(words):
        hit = F.array_position(F.transform(F.col("h.heads"), lambda h: X.contains_any(h, [w.replace("（", "(").replace("）", ")") for w in words])), F.lit(True))
        return F.when(hit > 0, F.coalesce(X.clean_cell(F.get("cells", (hit - 1).cast("int"))), F.lit(""))).otherwise("")

    out = j.select("file_id", "row_no", *[cell(w).alias(n) for n, w in PRODUCT_HEADERS.items()])
    return out.filter("public_id <> '' OR company <> '' OR seq <> ''")


# -- report tables ----------------------------------------------------------------

def _has(c: Column, words) -> Column:
    return X.contains_any(F.lower(c), [w.lower() for w in words])


def cell_predicates(cells: Column) -> dict[str, Column]:
    """Header test over a row's cells and per-cell roles."""
    from thermograph.functions import rules as R
    joined = F.lower(F.array_join(cells, " "))
    head = _has(joined, R.HEADER_ALIASES["seq"]) & _has(joined, R.HEADER_ALIASES["item_name"]) & (_has(joined, R.HEADER_ALIASES["result"]) | _has(joined, R.HEADER_ALIASES["requirement"]))
    return {"is_item_header": head, "roles": F.transform(cells, lambda x: header_role(x))}


def header_role(c: Column) -> Column:
    from thermograph.functions import rules as R
    t = X.clean_lower(c)
    return F.coalesce(*[F.when(X.contains_any(t, [w.lower() for w in ws]), role) for role, ws in R.HEADER_ALIASES.items()])


def is_blank(c: Column) -> Column:
    from thermograph.functions import rules as R
    return X.clean(c).isin(*R.BLANK_CELLS)


def looks_like_field(c: Column) -> Column:
    from thermograph.functions import rules as R
    t = F.regexp_replace(X.clean(c), "^[:：]+|[:：]+$", "")
    return (t != "") & (F.length(t) <= 50) & ~t.rlike(r"(?U)^[\d.]+$") & _has(t, R.FIELD_HINTS)


def meta_from_table_rows(rows: DataFrame) -> DataFrame:
    """Field and value pairs of table rows.

    ``rows``: report_id, table_index, row_index, cells. Rows with four or more
    cells pair up neighbours; a two-cell row is one pair.
    """
    r = rows.withColumn("cells", F.filter(F.transform("cells", lambda x: X.clean(x)), lambda x: x != "")).filter("size(cells) >= 2 AND size(cells) <> 3")
    r = r.filter(~cell_predicates(F.col("cells"))["is_item_header"])
    pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size("cells") / 2)).cast("int") - 1), lambda i: F.struct(F.get("cells", i * 2).alias("field"), F.get("cells", i * 2 + 1).alias("value")))
    e = r.select("report_id", "table_index", "row_index", F.posexplode(pairs).alias("pair_no", "p"))
    e = e.filter(looks_like_field(F.col("p.field")) & ~is_blank(F.col("p.value")))
    return e.select("report_id", "table_index", "row_index", "pair_no", F.regexp_replace("p.field", "^[:：]+|[:：]+$", "").alias("field"), F.col("p.value").alias("value"))


def items_from_table_rows(rows: DataFrame, tile_rows: int = 10_000) -> DataFrame:
    """Item rows under the latest header of their table.

    Section titles (one-cell rows) and headers carry down; a data row starts
    with a short number. Rows with more cells than mapped headers, at least
    five, are read from the right.
    """
    from thermograph.operators.relational import forward_fill
    r = rows.withColumn("cells", F.filter(F.transform("cells", lambda x: X.clean(x)), lambda x: x != "")).filter("size(cells) > 0")
    p = cell_predicates(F.col("cells"))
    r = r.withColumns({"_one": F.size("cells") == 1, "_head": p["is_item_header"] & (F.size("cells") > 1)})
    r = r.withColumns({"section": F.when(F.col("_one"), F.col("cells")[0]),
                       "header": F.when(F.col("_head"), F.array_join(F.transform(p["roles"], lambda x: F.coalesce(x, F.lit("-"))), ","))})
    r = forward_fill(r, ["report_id", "table_index"], "row_index", ["section", "header"], F.floor(F.col("row_index") / tile_rows))
    r = r.filter(~F.col("_one") & ~F.col("_head") & (F.col("header") != "")).filter(F.col("cells")[0].rlike(r"(?U)^\d{1,4}([.)、])?$"))
    r = r.withColumn("roles", F.split("header", ","))
    n, mapped = F.size("cells"), F.size(F.filter("roles", lambda x: x != "-"))
    wide = (n > mapped) & (n >= 5)
    # among repeated roles the last column wins, as when a record is filled in order
    by_role = lambda role: F.coalesce(F.element_at(F.filter(F.transform(F.arrays_zip(F.col("roles").alias("a"), F.col("cells").alias("v")), lambda s: F.when((s["a"] == role) & s["v"].isNotNull(), s["v"])), lambda v: v.isNotNull()), -1), F.lit(""))
    from_right = lambda k: F.get("cells", n - k)
    middle = F.array_join(F.array_distinct(F.slice("cells", F.lit(2), F.greatest(n - 4, F.lit(0)))), " / ")
    first_or = lambda role: F.get(F.filter(F.array(by_role(role)), lambda v: v != ""), F.lit(0))
    return r.select("report_id", "table_index", "row_index", "section",
                    F.when(wide, F.col("cells")[0]).otherwise(F.coalesce(first_or("seq"), F.lit(""))).alias("seq"),
                    F.when(wide, middle).otherwise(F.coalesce(first_or("item_name"), F.lit(""))).alias("item_name"),
                    F.when(wide, from_right(3)).otherwise(F.coalesce(first_or("requirement"), F.lit(""))).alias("requirement"),
                    F.when(wide, from_right(2)).otherwise(F.coalesce(first_or("result"), F.lit(""))).alias("result"),
                    F.when(wide, from_right(1)).otherwise(F.coalesce(first_or("conclusion"), F.lit(""))).alias("conclusion"), F.array_join("cells", " | ").alias("raw_row"))


def structure_type(tables: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Table profile of each report.

    ``tables``: report_id, table_index, row_index, cells; ``paragraphs``:
    report_id, text. Numbered rows count while they follow a header without a
    break, so the state of a row is the kind of the last header or break.
    """
    from thermograph.operators.relational import forward_fill
    r = tables.withColumn("cells", F.filter(F.transform("cells", lambda x: X.clean(x)), lambda x: x != ""))
    p = cell_predicates(F.col("cells"))
    seq = F.get("cells", F.lit(0)).rlike(r"(?U)^\d{1,4}([.)、])?$")
    r = r.filter("size(cells) > 0").withColumn("kind", F.when(p["is_item_header"], "header").when(seq, "body").otherwise("break"))
    r = r.withColumn("state", F.when(F.col("kind") != "body", F.col("kind")))
    r = forward_fill(r, ["report_id", "table_index"], "row_index", ["state"], F.floor(F.col("row_index") / 10_000))
    t = r.groupBy("report_id").agg(F.count_if(F.col("kind") == "header").alias("item_header_rows"), F.count_if((F.col("kind") == "body") & (F.col("state") == "header")).alias("item_body_rows"), F.countDistinct("table_index").alias("table_count"))
    q = paragraphs.withColumn("text", X.clean(F.col("text"))).filter("text <> ''").groupBy("report_id").agg(F.count(F.lit(1)).alias("paragraph_count"))
    j = t.join(q, "report_id", "full_outer").na.fill(0)
    return j.withColumn("structure_type", F.when((F.col("item_header_rows") > 0) & (F.col("item_body_rows") > 0), "TABLE_OK").when((F.col("table_count") > 0) & (F.col("paragraph_count") > 2000), "MIXED")
                        .when(F.col("table_count") > 0, "TABLE_WEAK").when(F.col("paragraph_count") > 0, "TEXT").otherwise("UNKNOWN"))


def trace_rows(blocks: DataFrame) -> DataFrame:
    """Paragraphs, table rows and cells in one numbered sequence per report.

    ``blocks``: report_id, block_type ('paragraph' or 'table_row'),
    table_index, row_index, cells. Numbering runs paragraphs first, then
    tables; each non-blank row is followed by its non-blank cells.
    """
    from thermograph.operators.relational import spread_row_number
    b = blocks.withColumn("cells", F.transform("cells", lambda x: X.clean(x)))
    text = F.array_join(F.filter("cells", lambda x: x != ""), " | ")
    b = b.withColumns({"row_text": text, "_t": F.when(F.col("block_type") == "paragraph", -1).otherwise(F.col("table_index"))}).filter("row_text <> ''")
    head = F.struct(F.col("block_type").alias("kind"), F.lit(-1).alias("col_index"), F.col("row_text").alias("text"))
    body = F.transform("cells", lambda x, i: F.struct(F.lit("table_cell").alias("kind"), i.alias("col_index"), x.alias("text")))
    parts = F.when(F.col("block_type") == "paragraph", F.array(head)).otherwise(F.concat(F.array(head), F.filter(body, lambda s: s["text"] != "")))
    e = b.select("report_id", "_t", "table_index", "row_index", "row_text", F.explode(parts).alias("p")).select("*", "p.*").drop("p")
    e = spread_row_number(e, ["report_id"], ["_t", "row_index", "col_index"], F.col("_t") * 1_000_000 + F.floor(F.col("row_index") / 1000), "sequence")
    return e.select("report_id", (F.col("sequence") - 1).alias("sequence"), F.col("kind").alias("block_type"), "table_index", "row_index", "col_index", "text", "row_text")


def word_report_card(rows: DataFrame, paragraphs: DataFrame, max_tables: int | None = None, max_rows: int | None = None, max_paragraphs: int | None = None) -> DataFrame:
    """Report card from tables and conclusions, whole unless limits are given.

    Tables give field pairs; paragraphs that state a conclusion join the
    conclusion list after the tables.
    """
    from thermograph.operators.relational import meta_fold
    below = lambda column, limit: F.lit(True) if limit is None else F.col(column) < limit
    r = rows.filter(below("table_index", max_tables) & below("row_index", max_rows)).withColumn("cells", F.filter(F.transform("cells", lambda x: X.clean(x)), lambda x: x != ""))
    r = r.filter("size(cells) = 2 OR size(cells) >= 4")
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("cells") / 2).cast("int") - 1), lambda i: F.struct(F.get("cells", i * 2).alias("field"), F.get("cells", i * 2 + 1).alias("value")))
    m = r.select("report_id", (F.col("table_index").cast("bigint") * 10_000_000 + F.col("row_index")).alias("_r"), F.posexplode(pairs).alias("_i", "p")).select("report_id", (F.col("_r") * 10_000 + F.col("_i")).alias("pos"), "p.field", "p.value")
    c = paragraphs.filter(below("para_index", max_paragraphs)).filter(X.contains_any(F.col("text"), ("检验结论", "检测结论"))).select(
        "report_id", (F.lit(1 << 62) + F.col("para_index")).alias("pos"), F.lit("检验结论").alias("field"), F.col("text").alias("value"))
    return meta_fold(m.unionByName(c))


def nfkc(c: Column) -> Column:
    """Unicode NFKC; no built-in function offers it."""
    @F.pandas_udf("string")
    def normalize(s: pd.Series) -> pd.Series:
        import unicodedata
        return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))
    return normalize(c)


# Device names that no report number may use.
RESERVED_NAMES = ["CON", "PRN", "AUX", "NUL"] + [f"COM{i}" for i in range(1, 10)] + [f"LPT{i}" for i in range(1, 10)]


def valid_report_number(c: Column) -> Column:
    """Normal form without separators, control signs or reserved names."""
    t = nfkc(c)
    stem = F.upper(F.regexp_extract(t, r"^([^.]*)", 1))
    ok = ((t != "") & (t == F.trim(t)) & ~t.isin(".", "..") & ~t.rlike(r"[\x00-\x1f\x7f/\\<>:\"|?*]") & ~t.endswith(".") & ~F.rtrim(stem).isin(*RESERVED_NAMES) & (F.octet_length(t) <= 255))
    return F.coalesce(ok, F.lit(False))


def canonical_username(c: Column) -> Column:
    return F.coalesce((F.trim(nfkc(c)) == c) & (c != ""), F.lit(False))
