"""What staged jobs leave on disk, and how their rows are dealt."""

import os
import time

from pyspark.sql import functions as F

from thermograph import session as S
from thermograph.operators import drawing as D
from thermograph.operators import faces as Fc
from thermograph.operators import intervals as I
from thermograph.plans import exterior as X
from thermograph.plans import registry_drawing as Rd
from thermograph.plans import registry_faces as R
from thermograph.plans import topology as T

SF = "/root/testdata/sf0.001"


def waited(check, seconds=20):
    end = time.time() + seconds
    while not check() and time.time() < end:
        time.sleep(0.2)
    return check()


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {f for f in files if os.path.basename(f).startswith("shuffle_") and os.path.exists(f)}


def checkpoints(spark):
    root = S.checkpoint_dir(spark).removeprefix("file:")
    return {x for x in os.listdir(root) if x.startswith("rdd-")}


def test_a_step_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    out = S.cut_lineage(spark.range(50000).groupBy((F.col("id") % 1000).alias("k")).count().join(spark.range(1000).withColumnRenamed("id", "k"), "k"))
    assert waited(lambda: not shuffle_files(spark) - before)
    assert out.count() == 1000


def test_checkpoints_go_with_their_last_table(spark, monkeypatch):
    monkeypatch.setattr(S, "SWEEP_SECONDS", 0.0)
    before = checkpoints(spark)
    a = S.cut_lineage(spark.range(100))
    first = checkpoints(spark) - before
    lazy = a.filter("id % 2 = 0")
    del a
    time.sleep(2)
    S.sweep(spark)
    time.sleep(1)
    assert len(first) == 1 and first <= checkpoints(spark) and lazy.count() == 50  # still read
    b = S.cut_lineage(lazy)
    del lazy

    def gone():
        time.sleep(1)
        S.sweep(spark)
        return not first & checkpoints(spark)
    assert waited(gone, 40)
    assert b.count() == 50


def test_pages_of_a_small_file_are_dealt_over_all_tasks(spark):
    walls, *_, cells, _ = R._drawings(spark, SF)
    assert walls.rdd.getNumPartitions() == cells.rdd.getNumPartitions() == 8


def test_graph_parts_are_sought_on_pages_with_several_faces(spark, monkeypatch):
    box = lambda p, x, n: [(p, "horizontal", 0, x, x + 40, n), (p, "horizontal", 40, x, x + 40, n + 1), (p, "vertical", x, 0, 40, n + 2), (p, "vertical", x + 40, 0, 40, n + 3)]
    rows = box(1, 0, 1) + box(2, 0, 1) + box(2, 60, 5)
    parts = spark.createDataFrame(rows, "page_id int, orientation string, fixed long, axis_start long, axis_end long, id string").withColumn("kind", F.lit("wall"))
    pages = spark.createDataFrame([(p, 0, 0, 200, 200) for p in (1, 2)], "page_id int, left int, top int, right int, bottom int")
    cells = pages.select("page_id", F.explode(F.sequence(F.lit(0), F.lit(199))).alias("y"), F.lit(0).alias("x0"), F.lit(1).alias("step"), F.array_repeat(F.lit(0.9), 200).alias("values"))
    seen, real = [], Fc.connected_components
    monkeypatch.setattr(Fc, "connected_components", lambda e, keys: (seen.append({r.page_id for r in e.select("page_id").distinct().collect()}), real(e, keys))[1])
    f = T.evidence_faces(parts, cells, pages)
    assert seen == [{2}]
    assert [r.page_id for r in f["parted"].collect()] == [2]
    assert sorted((r.page_id, r.area, round(r["mean"], 9)) for r in f["faces"].collect()) == [(1, 1600.0, 0.9), (2, 1600.0, 0.9), (2, 1600.0, 0.9)]


def test_cells_without_a_value_count_for_nothing(spark):
    edges = spark.createDataFrame([(1, "a", 0, 0, 4, 0), (1, "a", 4, 0, 4, 2), (1, "a", 4, 2, 0, 2), (1, "a", 0, 2, 0, 0)], "page_id int, face_id string, x0 long, y0 long, x1 long, y1 long")
    lines = spark.createDataFrame([(1, 0, 0, 1, [1.0, None, 3.0, 4.0]), (1, 1, 0, 1, [2.0, 2.0, 2.0, 2.0, 9.0]), (1, 2, 0, 1, [50.0])], "page_id int, y int, x0 int, step int, values array<double>")
    assert [(r._s, r.n_cells) for r in Fc.raster_line_sums(edges, lines).collect()] == [(16.0, 7)]


def test_tiled_rows_are_read_and_dealt_once(spark):
    line = ["page_id", "orientation", "fixed"]
    segments = Rd.seg(spark, SF)
    steps = segments.groupBy(*line, F.col("axis_start").alias("at")).agg(F.count("*").alias("n"))
    for df in (I.islands(segments, line), I.with_island(segments, line), I.running_sums(steps, line, ["at"], F.floor(F.col("at") / 64), ["n"], "at")):
        df.collect()
        assert df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan") == 1


def test_gaps_hold_the_shuffles_of_one_step_at_a_time(spark, monkeypatch):
    """Lines that ask for the next start give their shuffles back before ids are joined to what they found."""
    steps, real = [], D.cut_lineage
    monkeypatch.setattr(D, "cut_lineage", lambda df: (steps.append(df.columns), real(df))[1])
    walls = spark.createDataFrame([(1, f"w{i}", "horizontal", "up", 7 * (i % 2), 10 * i, 10 * i + 4) for i in range(6)], "page_id int, wall_id string, orientation string, inside_direction string, fixed long, axis_start long, axis_end long")
    roi = spark.createDataFrame([(1, 0, 0, 100, 100)], "page_id int, left int, top int, right int, bottom int")
    got = {(r.wall_id, r.r_id, r.gap_start, r.gap_end) for r in D.exterior_gaps(walls, roi, tol=8).collect()}
    assert got == {(f"w{i}", f"w{i + 1}", 10 * i + 4, 10 * i + 10) for i in range(5)}
    assert len(steps) == 3 and "wall_id" not in steps[1]


def test_staged_walls_and_arcs_leave_small_last_steps(spark):
    """The last plan reads what steps left, not the segments again."""
    files = lambda df: (df.collect(), df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan"))[1]
    assert files(R._w15(spark, SF)) <= 1  # the edges, for their places
    steps, real = [], X.cut_lineage
    X.cut_lineage = lambda df: (steps.append(df.columns), real(df))[1]
    try:
        R._g6(spark, SF)
    finally:
        X.cut_lineage = real
    assert len(steps) == 4
