"""Interval operators: range joins and merges that survive hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def range_join(left: DataFrame, right: DataFrame, keys: list[str], left_range: tuple[Column, Column], right_range: tuple[Column, Column],
               bucket: float, how: str = "inner") -> DataFrame:
    """Rows whose closed ranges overlap, within equal keys.

    Both sides are exploded to the buckets they touch and joined on
    (keys, bucket); a pair is kept only in the first bucket it shares, so no
    distinct is needed. Column names of the two sides must differ outside
    ``keys``. A hot key spreads over its buckets, and the plain equi-join can
    be split further by adaptive execution.
    """
    ls = left.withColumns({"_l0": left_range[0].cast("double"), "_l1": left_range[1].cast("double")})
    rs = right.withColumns({"_r0": right_range[0].cast("double"), "_r1": right_range[1].cast("double")})
    cut = lambda c: F.floor(F.col(c) / bucket)
    ls = ls.withColumn("_b", F.explode(F.sequence(cut("_l0"), cut("_l1"))))
    rs = rs.withColumn("_b", F.explode(F.sequence(cut("_r0"), cut("_r1"))))
    j = ls.join(rs, [*keys, "_b"]).filter(
        (F.col("_l0") <= F.col("_r1")) & (F.col("_r0") <= F.col("_l1")) & (F.col("_b") == F.greatest(cut("_l0"), cut("_r0"))))
    return j.drop("_b", "_l0", "_l1", "_r0", "_r1")


def box_join(left: DataFrame, right: DataFrame, keys: list[str], left_x: tuple[Column, Column], right_x: tuple[Column, Column],
             left_y: tuple[Column, Column], right_y: tuple[Column, Column], bucket: float) -> DataFrame:
    """Pairs whose boxes meet on x and share a tile on y, each once: a range join inside the rows of tiles of y.

    Callers still test y themselves; a long strip of one page is never one bucket.
    """
    t = lambda v: F.floor(v / bucket)
    cut = lambda df, y, n: df.withColumn(n, t(y[0])).withColumn("_ty", F.explode(F.sequence(t(y[0]), t(y[1]))))
    return range_join(cut(left, left_y, "_ly"), cut(right, right_y, "_ry"), [*keys, "_ty"], left_x, right_x, bucket).filter("_ty = greatest(_ly, _ry)").drop("_ty", "_ly", "_ry")


def islands(df: DataFrame, keys: list[str], start: str = "axis_start", end: str = "axis_end", tol: float = 0, tile: float = 64) -> DataFrame:
    """Distinct starts with their island: (keys, start, end, n_rows, island_start).

    Intervals chain while the next start is at most ``tol`` past the running
    end. Rows first combine per start; the running end then works inside tiles
    of the axis, and one small row per tile carries the state across tiles, so
    no task ever holds a whole key.
    """
    c = F.col
    base = df.groupBy(*keys, c(start).alias("_s")).agg(F.max(end).alias("_e"), F.count(F.lit(1)).alias("n_rows"))
    inside = W.partitionBy(*keys, "_t").orderBy("_s")
    across = W.partitionBy(*keys).orderBy("_t").rowsBetween(W.unboundedPreceding, -1)
    # The join below asks for a tile on one side only; asked for here, it leaves both uses of ``rows`` the same.
    rows = base.withColumn("_t", F.floor(c("_s") / tile)).filter("_t IS NOT NULL").withColumn("_before", F.max("_e").over(inside.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("_local", F.when(c("_before").isNull() | (c("_s") > c("_before") + tol), c("_s")))
    # The sum keeps both uses of ``rows`` the same below their shuffle, so that it can be shared.
    tiles = rows.groupBy(*keys, "_t").agg(F.max("_e").alias("_m"), F.max("_local").alias("_h"), F.sum("n_rows").alias("_n")).filter("_n > 0").withColumn("_carry", F.max("_m").over(across))
    begins = c("_carry").isNull() | (c("_h") > c("_carry") + tol)
    tiles = tiles.withColumn("_open", F.max(F.when(begins, c("_h"))).over(across)).select(*keys, "_t", "_carry", "_open")
    rows = rows.join(tiles, [*keys, "_t"])
    rows = rows.withColumn("_head", F.max(F.when(c("_carry").isNull() | (c("_local") > c("_carry") + tol), c("_local"))).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    return rows.select(*keys, c("_s").alias(start), c("_e").alias(end), "n_rows", F.coalesce("_head", "_open").alias("island_start"))


def merge_collinear(df: DataFrame, keys: list[str], start: str = "axis_start", end: str = "axis_end", tol: float = 0, tile: float = 64) -> DataFrame:
    """Union of overlapping or touching intervals per key, with row counts."""
    return islands(df, keys, start, end, tol, tile).groupBy(*keys, F.col("island_start").alias(start)).agg(
        F.max(end).alias(end), F.sum("n_rows").alias("n_rows"))


def with_island(df: DataFrame, keys: list[str], start: str = "axis_start", end: str = "axis_end", tol: float = 0, tile: float = 64) -> DataFrame:
    """Every input row with the start of its island (long-form membership).

    As ``islands``, but rows keep their columns and move once: running ends work
    on the rows of a tile themselves, and of equal starts all get the same island.
    """
    c = F.col
    inside = W.partitionBy(*keys, "_t").orderBy(start)
    across = W.partitionBy(*keys).orderBy("_t").rowsBetween(W.unboundedPreceding, -1)
    # As in ``islands``, both uses of ``rows`` must ask for a tile.
    rows = df.withColumn("_t", F.floor(c(start) / tile)).filter("_t IS NOT NULL").withColumn("_before", F.max(end).over(inside.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("_local", F.when(c("_before").isNull() | (c(start) > c("_before") + tol), c(start))).drop("_before")
    # The hash keeps both uses of ``rows`` the same below their shuffle, so that it can be shared.
    tiles = rows.groupBy(*keys, "_t").agg(F.max(end).alias("_m"), F.max("_local").alias("_h"), F.max(F.xxhash64(*df.columns)).alias("_n")).filter("_n IS NOT NULL").withColumn("_carry", F.max("_m").over(across))
    begins = c("_carry").isNull() | (c("_h") > c("_carry") + tol)
    tiles = tiles.withColumn("_open", F.max(F.when(begins, c("_h"))).over(across)).select(*keys, "_t", "_carry", "_open")
    rows = rows.join(tiles, [*keys, "_t"])
    rows = rows.withColumn("_head", F.max(F.when(c("_carry").isNull() | (c("_local") > c("_carry") + tol), c("_local"))).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    return rows.withColumn("island_start", F.coalesce("_head", "_open")).select(*keys, start, *[x for x in df.columns if x not in (*keys, start)], "island_start")


def merge_with_sources(df: DataFrame, keys: list[str], id_col: str, start: str = "axis_start", end: str = "axis_end", tol: float = 0, tile: float = 64) -> DataFrame:
    """As ``merge_collinear`` with the sorted set of source ids per interval.

    For records that carry their sources; long-form membership
    (``with_island``) is the choice for unbounded groups.
    """
    return with_island(df, keys, start, end, tol, tile).groupBy(*keys, F.col("island_start").alias(start)).agg(
        F.max(end).alias(end), F.sort_array(F.collect_set(id_col)).alias("source_ids"))


def chain_components(nodes: DataFrame, keys: list[str], tol: float = 12, tile: float = 256) -> DataFrame:
    """Chains along a band with their status.

    ``nodes``: keys, node_type ('anchor', 'uncertain_wall', 'door_arc'),
    node_id, axis_start, axis_end. Chains without an arc are dropped; two or
    more distinct anchors confirm, one leaves it pending, none ignores it.
    """
    m = with_island(nodes, keys, tol=tol, tile=tile)
    # Each node once, then plain counts: distinct counts of several kinds would copy every row for each.
    m = m.groupBy(*keys, F.col("island_start").alias("axis_start"), "node_type", "node_id").agg(F.max("axis_end").alias("axis_end"))
    n = lambda t: F.count_if((F.col("node_type") == t) & F.col("node_id").isNotNull())
    return m.groupBy(*keys, "axis_start").agg(
        F.max("axis_end").alias("axis_end"), n("anchor").alias("n_anchors"), n("door_arc").alias("n_arcs"), n("uncertain_wall").alias("n_walls")).filter("n_arcs > 0").withColumn(
        "status", F.when(F.col("n_anchors") >= 2, "confirmed").when(F.col("n_anchors") == 1, "pending").otherwise("ignored"))


def axis_clusters(walls: DataFrame, keys: list[str], tol: float, span: float) -> DataFrame:
    """Clusters of parallel axes and the length their walls cover.

    Axes chain while consecutive ones differ by at most ``tol``; a cluster
    stays when it covers at least max(8, 4 % of the span), counted in whole
    units with both ends included.
    """
    clip = lambda c: F.least(F.lit(span), F.greatest(F.lit(0), F.round(c)))
    w = walls.withColumns({"_a": clip("axis_start").cast("bigint"), "_z": clip("axis_end").cast("bigint"), "axis": F.round("fixed").cast("bigint")}).filter("_a < _z")
    cl = with_island(w.withColumn("axis_hi", F.col("axis")), keys, "axis", "axis_hi", tol=tol).withColumnRenamed("island_start", "_cluster")
    merged = merge_collinear(cl.select(*keys, "_cluster", F.col("_a").alias("s"), (F.col("_z") + 1).alias("e")), [*keys, "_cluster"], "s", "e")
    cover = merged.groupBy(*keys, "_cluster").agg(F.sum(F.col("e") - F.col("s")).alias("coverage"))
    axes = cl.groupBy(*keys, "_cluster").agg(F.min("axis").alias("axis_min"), F.max("axis").alias("axis_max"), F.count(F.lit(1)).alias("n_walls"))
    return axes.join(cover, [*keys, "_cluster"]).drop("_cluster").filter(F.col("coverage") >= max(8.0, round(span * 0.04)))


def coverage_complement(edges: DataFrame, covers: DataFrame, keys: list[str], bucket: float = 64) -> DataFrame:
    """Uncovered parts of each edge interval.

    ``edges``: keys + e0, e1; ``covers``: keys + axis_start, axis_end. Covers
    meet the edges they overlap, are clipped to them and merged; gaps lie
    between merged neighbours.
    """
    j = range_join(edges.select(*keys, "e0", "e1"), covers.select(*keys, "axis_start", "axis_end"), keys, (F.col("e0"), F.col("e1")), (F.col("axis_start"), F.col("axis_end")), bucket)
    j = j.select(*keys, "e0", "e1", F.greatest("axis_start", "e0").alias("axis_start"), F.least("axis_end", "e1").alias("axis_end")).filter("axis_start < axis_end")
    merged = merge_collinear(j, [*keys, "e0", "e1"]).select(*keys, "e0", "e1", "axis_start", "axis_end")
    end = lambda e: edges.select(*keys, "e0", "e1", F.col(e).alias("axis_start"), F.col(e).alias("axis_end"))
    pts = merged.unionByName(end("e0")).unionByName(end("e1"))
    w = W.partitionBy(*keys, "e0", "e1").orderBy("axis_start", "axis_end")
    gaps = pts.withColumn("_prev", F.lag("axis_end").over(w)).filter("_prev < axis_start")
    return gaps.select(*keys, F.col("_prev").alias("gap_start"), F.col("axis_start").alias("gap_end"))


def running_sums(df: DataFrame, keys: list[str], order: list, tile: Column, sums: list[str], following: str | None = None) -> DataFrame:
    """Adds ``<name>_run``, the sums up to and including each row, and ``_next``, the next row's ``following``.

    Rows run inside (keys, tile); one small row per tile carries sums and first
    values across, so no task holds a whole key. ``tile`` must not fall along
    ``order``, whose first column ``following`` has to be where it is asked for.
    """
    rows = df.withColumn("_t", tile).filter("_t IS NOT NULL")
    inside = W.partitionBy(*keys, "_t").orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    across = W.partitionBy(*keys).orderBy("_t")
    first = [F.min(following).alias("_first")] if following else []
    tiles = rows.groupBy(*keys, "_t").agg(*[F.sum(x).alias(f"_c_{x}") for x in sums], *first)
    carry = tiles.select(*keys, "_t", *[F.coalesce(F.sum(f"_c_{x}").over(across.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"_c_{x}") for x in sums],
                         *([F.lead("_first").over(across).alias("_later")] if following else []))
    out = rows.withColumns({f"{x}_run": F.coalesce(F.sum(x).over(upto), F.lit(0)) for x in sums} | ({"_next": F.lead(following).over(inside)} if following else {})).join(carry, [*keys, "_t"])
    out = out.withColumns({f"{x}_run": F.col(f"{x}_run") + F.col(f"_c_{x}") for x in sums} | ({"_next": F.coalesce("_next", "_later")} if following else {}))
    return out.drop("_t", "_later", *[f"_c_{x}" for x in sums])
