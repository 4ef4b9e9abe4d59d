"""Links and table rows of stored web pages, by column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermograph.functions import text as X
from thermograph.functions.stages import pin

LINK = r"""(?is)<a\b[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))[^>]*>(.*?)</a\s*>"""


def visible(html: Column) -> Column:
    """The page without comments, scripts and styles."""
    return F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", "")


def html_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(anchor text, href) per page in document order; empty hrefs dropped."""
    p = pin(pages, _h=visible(F.col(html)))
    group = lambda i: F.regexp_extract_all(F.col("_h"), F.lit(LINK), F.lit(i))
    z = F.arrays_zip(group(1).alias("a"), group(2).alias("b"), group(3).alias("c"), group(4).alias("t"))
    keep = [c for c in pages.columns if c != html]
    e = p.select(*keep, F.posexplode(z).alias("link_pos", "l"))
    e = e.select(*keep, "link_pos", X.clean(X.html_unescape(X.strip_tags(F.col("l.t"), ""))).alias("title"),
                 X.html_unescape(F.concat("l.a", "l.b", "l.c")).alias("href"))
    return e.filter("href <> ''")


def html_table_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """Rows of every table: headers (first non-blank row) and cells.

    One output row per body row with ``table_no``, ``row_no``, ``headers`` and
    ``cells``; blank rows are dropped before numbering.
    """
    keep = [c for c in pages.columns if c != html]
    cell_text = lambda c: X.clean(X.html_unescape(X.strip_tags(c, "")))
    row_cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), F.lit(1)), lambda c: cell_text(c))
    t = pages.select(*keep, F.posexplode(F.regexp_extract_all(visible(F.col(html)), F.lit(r"(?is)<table\b[^>]*>(.*?)</table\s*>"), F.lit(1))).alias("table_no", "_t"))
    rows = F.transform(F.regexp_extract_all("_t", F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), F.lit(1)), lambda r: row_cells(r))
    t = pin(t, _rows=F.filter(rows, lambda r: F.exists(r, lambda c: c != ""))).filter("size(_rows) > 1")
    t = t.withColumn("headers", F.col("_rows")[0])
    return t.select(*keep, "table_no", "headers", F.posexplode(F.slice("_rows", 2, F.size("_rows"))).alias("row_no", "cells"))


def split_text_units(docs: DataFrame, text: str = "text") -> DataFrame:
    """Cleaned, non-blank units between line ends and sentence marks."""
    keep = [c for c in docs.columns if c != text]
    # Pinned: a filter on rows of an explode would split and clean every text once more.
    e = pin(docs, _units=F.split(F.col(text), r"[\r\n。；;]+")).select(*keep, F.posexplode("_units").alias("unit_no", "_u"))
    return pin(e, unit=X.clean(F.col("_u"))).select(*keep, "unit_no", "unit").filter("unit <> ''")


def _decode(content: Column, charset: Column) -> Column:
    @F.pandas_udf("string")
    def decode(raw: pd.Series, charset: pd.Series) -> pd.Series:
        def one(b, cs):
            try:
                return bytes(b).decode(cs, errors="ignore")
            except LookupError:
                return bytes(b).decode("utf-8", errors="ignore")
        return pd.Series([None if b is None else one(b, cs) for b, cs in zip(raw, charset)])
    return decode(content, charset)


def decode_pages(df: DataFrame, content: str = "content", content_type: str = "content_type") -> DataFrame:
    """Bytes to text: charset of the header, else of the page head, else UTF-8."""
    head = F.decode(F.substring(F.col(content), 1, 4096), "ISO-8859-1")
    from_header = F.regexp_extract(F.coalesce(F.col(content_type), F.lit("")), r"(?i)charset=([\w-]+)", 1)
    from_meta = F.regexp_extract(head, r"""(?i)<meta[^>]+charset=["']?\s*([\w-]+)""", 1)
    name = F.lower(F.coalesce(F.nullif(from_header, F.lit("")), F.nullif(from_meta, F.lit("")), F.lit("utf-8")))
    name = F.when(name.isin("gb2312", "gbk", "gb18030"), "gb18030").otherwise(name)
    return df.withColumn("charset", name).withColumn("html", _decode(F.col(content), F.col("charset")))
