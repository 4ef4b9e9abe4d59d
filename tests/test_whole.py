"""Drawing queries over whole tables."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from thermograph.operators import faces
from thermograph.operators.intervals import box_join
from thermograph.plans.adapters import TABLES
from thermograph.plans.registry_drawing import seg
from verify import rows_of

SF = "/root/testdata/sf0.001"
WHOLE = ["W4_axis_clusters", "J11_gap_curve_join", "J11_gap_short_segments", "J12_anchor_both_ends_semi", "A13_zonal_stats", "A16_scale_calibration", "J17_dangling_ends",
         "J17_corner_candidates", "J17_collinear_extensions", "J18_edge_crosses_band_anti"]


@pytest.mark.parametrize("name", WHOLE)
def test_whole_tables_match_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    sql = E.oracle_sql()[name]
    left = set(re.findall(r"(?:seg|span)_id % \d+ (?:=|<|>) \d+", sql[sql.rindex("v_segments AS" if "v_segments AS" in sql else "v_spans AS"):])) - {"seg_id % 9 = 0", "seg_id % 9 > 0"}
    assert not left and (name.startswith("J12") or "seg_id % 9" not in sql)
    got = rows_of(E.queries()[name](spark, SF).toArrow())
    assert got == rows_of(con.execute(sql).to_arrow_table()) and got[1]


def test_faces_of_short_lines(spark):
    whole = faces.bounded_faces(seg(spark, SF)).groupBy("page_id").agg(F.count("*").alias("faces"), F.sum("area").alias("area")).collect()
    assert sorted(map(tuple, E.queries()["G1_drawing_faces"](spark, SF).collect())) == sorted(map(tuple, whole))


def test_every_line_is_a_wall_or_a_bridge(spark):
    """W15 read half of the lines as walls and a fifth as bridges; the lines of an axis now leave no part of it bare."""
    edges = seg(spark, SF).filter("axis_start < 350 AND axis_end > 50 AND seg_id % 2 = 0").select("page_id", "orientation", "fixed", F.greatest("axis_start", F.lit(50)).alias("a"), F.least("axis_end", F.lit(350)).alias("b"))
    bridges = seg(spark, SF).filter("seg_id % 2 = 1").select("page_id", "orientation", "fixed", "axis_start", "axis_end")
    covered, cut = {}, {}
    for r in edges.collect():
        covered.setdefault(r.page_id, set()).update((r.orientation, r.fixed, i) for i in range(r.a, r.b))
    for r in bridges.collect():
        cut.setdefault(r.page_id, set()).update((r.orientation, r.fixed, i) for i in range(r.axis_start, r.axis_end))
    want = {p: len(x - cut.get(p, set())) for p, x in covered.items()}
    assert {r.page_id: r.length for r in E.queries()["W15_real_wall_segments"](spark, SF).collect()} == {p: n for p, n in want.items() if n}


def test_box_join_gives_each_pair_once(spark):
    box = lambda n, k: spark.range(60).select(F.lit(1).alias("p"), F.col("id").alias(n), *[(F.col("id") * m % 300).alias(f"{n}{a}") for a, m in (("x", k), ("y", k + 4))])
    c = F.col
    j = box_join(box("a", 7), box("b", 13), ["p"], (c("ax"), c("ax") + 90), (c("bx"), c("bx") + 40), (c("ay"), c("ay") + 90), (c("by"), c("by") + 40), 32).filter("ay <= by + 40 AND by <= ay + 90")
    want = [(a, b) for a in range(60) for b in range(60) if all(a * m % 300 <= b * n % 300 + 40 and b * n % 300 <= a * m % 300 + 90 for m, n in ((7, 13), (11, 17)))]
    assert sorted((r.a, r.b) for r in j.collect()) == want and want
