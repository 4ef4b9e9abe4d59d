"""Files whose columns come in different orders, dump quoting, entities, and the byte-order mark."""

from pyspark.sql import functions as F

from thermograph.functions.text import html_unescape
from thermograph.sources import sinks, tables
from thermograph.streaming.limiter import Limits, limit_attempts


def test_csv_columns_by_name(spark, tmp_path):
    for name, text in {"a": "﻿field,value\nF1,V1\n", "b": "value,field,more\nV2,F2,x\n", "c": "field,value\n\"F,3\",\"two\nlines\"\n", "d e": "value\nV4\n"}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "meta.csv").write_text(text, encoding="utf-8")
    rows = tables.scan_report_folders(spark, str(tmp_path), "meta", ["report_id", "field", "value"]).collect()
    assert {tuple(r) for r in rows} == {("a", "F1", "V1"), ("b", "F2", "V2"), ("c", "F,3", "two\nlines"), ("d e", None, "V4")}
    assert tables.scan_report_folders(spark, str(tmp_path), "none", ["report_id", "field"]).count() == 0


def test_dump_doubled_quotes(spark):
    rows = spark.createDataFrame([("INSERT INTO `t` VALUES (1,'it''s','a\\'b',NULL,''),(2,'x''''y','','z',' ')",)], "value string")
    assert [r.fields for r in tables.explode_sql_dump(rows).orderBy("row_no").collect()] == [["1", "it's", "a'b", "", ""], ["2", "x''y", "", "z", " "]]


def test_entities(spark):
    cases = {"W/(m&sup2;&middot;K)": "W/(m²·K)", "1&#8211;2 &#x2013; &lt;b&gt;": "1–2 – <b>", "&amp;lt; &nope; & &#0; a&b;": "&lt; &nope; & &#0; a&b;", "&quot;&#39;&apos;&nbsp;x": "\"'' x", "plain": "plain", "&#128512;": "😀"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.u for r in df.select("t", html_unescape(F.col("t")).alias("u")).collect()} == cases


def test_csv_mark_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "ä, \"q\"")], "id string, name string")
    sinks.write_csv(df, str(tmp_path / "out"), ["name", "id", "absent"])
    part = next((tmp_path / "out").glob("part-*"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbfname,id,absent")
    assert [tuple(r)[:2] for r in tables.read_string_csv(spark, str(tmp_path / "out"), ["id", "name"]).collect()] == [("1", 'ä, "q"')]


def test_wait_is_that_of_the_first_full_limit(spark):
    """Address full first, later also the pair: the address's wait is reported."""
    rows = [(i, 10.0 * i, "login", "a", "u" if i >= 2 else "v") for i in range(5)]
    df = spark.createDataFrame(rows, "event_id long, s double, action string, address string, username string").selectExpr("event_id", "timestamp_micros(CAST(s * 1000000 AS BIGINT)) AS ts", "action", "address", "username")
    out = {r.event_id: (r.allowed, r.retry_after) for r in limit_attempts(df, Limits(300.0, 4, 2, 4)).collect()}
    assert out[3] == (True, 0) and out[4] == (False, 261)
