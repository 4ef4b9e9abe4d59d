"""Embedding near-duplicates by an exact metric range join.

Unit vectors with cosine c lie sqrt(2 - 2c) apart, so the search is for pairs
within a radius. Pivots cut the space into cells of their nearest vectors; a
vector is copied into another cell only if the triangle inequality lets it have
a partner there. Cells, cut into blocks, are then joined independently.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermograph.llm.common import spill, table
from thermograph.llm.graph import components, forest

COSINE = 0.95
#: Vectors of a cell on average, cells at most, and vectors of a block on average.
CELL_VECTORS, MAX_CELLS, BLOCK_VECTORS = 4000, 1024, 4000
#: Rows of a block that are compared at once.
SLICE = 1000


def _unit(column: pd.Series, dtype: str) -> np.ndarray:
    x = np.stack([np.frombuffer(v, dtype) for v in column]).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pack(dtype: str):
    """Vectors that can link, as bytes scaled by a power of two (no overflow in squares); else null."""
    @F.pandas_udf("binary")
    def packed(vectors: pd.Series) -> pd.Series:
        out = []
        for v in vectors:
            x = None if v is None else np.array([np.nan if c is None else c for c in v], np.float64)
            ok = x is not None and len(x) > 0 and bool(np.isfinite(x).all()) and bool(x.any())
            out.append(np.ldexp(x, -math.frexp(float(np.abs(x).max()))[1]).astype(dtype).tobytes() if ok else None)
        return pd.Series(out, dtype=object)

    return packed


def _tile(cosine: float, dtype: str):
    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("v").drop_duplicates("v")
        x, v = _unit(df["v"], dtype), df["v"].to_numpy()
        block, home, copies = df["block"].to_numpy(), df["home"].to_numpy(), df["copies"].to_numpy()
        i, j, inner = int(df["i"].iloc[0]), int(df["j"].iloc[0]), bool(df["inner"].iloc[0])
        left = np.flatnonzero(home & (block == i))
        right = np.flatnonzero((home if inner else ~home) & (block == j))
        links, root = np.zeros(len(df), np.int64), np.arange(len(df))
        if len(left) and len(right):
            linked = np.concatenate([x[left[k:k + SLICE]] @ x[right].T >= cosine for k in range(0, len(left), SLICE)])
            linked &= left[:, None] != right[None, :]
            a, b = np.nonzero(linked)
            links[left] += np.bincount(a, copies[right[b]], len(left)).astype(np.int64)
            if not (inner and i == j):
                links[right] += np.bincount(b, copies[left[a]], len(right)).astype(np.int64)
            root = forest(linked, left, right, len(df))
        own = links > 0
        return pd.DataFrame({"v": v[own], "root": v[root][own], "links": links[own]})

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Link counts and components of all rows of (vec_id, embedding).

    Result: vec_id, n_links, component_id, kept. Two rows link when the cosine
    of their vectors, in doubles, is at least ``cosine``; equal vectors are one
    vertex, their rows linked to each other. Vectors that are null, empty, zero
    or hold a null or non-finite component link with nothing and are their own
    component. Vectors of different lengths never link. component_id is the
    least vec_id that links reach; repeated rows are copies. Labels and other
    columns are ignored.
    """
    dtype = "<f4" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "<f8"
    rows = spill(vectors.select("vec_id", _pack(dtype)("embedding").alias("v")))
    distinct = spill(rows.filter("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("vec_id")))
    radius = math.sqrt(2 - 2 * cosine) * (1 + 1e-9) + 1e-9
    sizes = {r["d"]: r["n"] for r in distinct.groupBy(F.octet_length("v").alias("d")).agg(F.count("*").alias("n")).collect()}
    found = None
    for width, n in sorted(sizes.items()):
        own = _cells_join(distinct.filter(F.octet_length("v") == width), n, cosine, radius, dtype)
        found = own if found is None else found.unionByName(own)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = spill(found)
    roots = components(found.filter("v != root").select(F.col("v").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("v").agg(F.sum("links").alias("links"))
    classed = spill(distinct.join(links, "v", "left").join(roots, "v", "left").select("v", "copies", "vec_id", "links", F.coalesce("root", "v").alias("root")))
    least = spill(classed.groupBy("root").agg(F.min("vec_id").alias("component_id")))
    known = spill(classed.join(least, "root").select("v", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    out = rows.join(known, "v", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _cells_join(distinct: DataFrame, n: int, cosine: float, radius: float, dtype: str) -> DataFrame:
    """Links within and across cells of distinct vectors of one length: v, root, links."""
    cells = max(1, min(MAX_CELLS, n // CELL_VECTORS))
    # At most MAX_CELLS vectors reach the driver.
    pivots = _unit(distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(cells).toPandas()["v"], dtype)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if len(df):
                gap = np.sqrt(np.maximum(2 - 2 * _unit(df["v"], dtype) @ pivots.T, 0))
                yield df.assign(cell=gap.argmin(1).astype(np.int32), far=gap.min(1))

    homes = spill(distinct.select("v", "copies").mapInPandas(nearest, "v binary, copies bigint, cell int, far double"))
    reach = np.full(len(pivots), -1.0)
    for r in homes.groupBy("cell").agg(F.max("far").alias("far")).collect():
        reach[r["cell"]] = r["far"]
    between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))

    def copied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if not len(df):
                continue
            gap = np.sqrt(np.maximum(2 - 2 * _unit(df["v"], dtype) @ pivots.T, 0))
            cell = df["cell"].to_numpy()
            away = between[cell]
            # A vector of cell c is no nearer to this one's pivot than to its own: the way to the plane between them is a lower bound.
            plane = np.where(away > 1e-6, (gap**2 - gap[np.arange(len(df)), cell][:, None]**2) / (2 * np.maximum(away, 1e-6)), 0)
            goes = (gap <= reach[None, :] + radius) & (plane <= radius) & (np.arange(len(pivots))[None, :] < cell[:, None])
            row, to = np.nonzero(goes)
            yield pd.concat([pd.DataFrame({"v": df["v"], "copies": df["copies"], "cell": cell, "home": True}),
                             pd.DataFrame({"v": df["v"].to_numpy()[row], "copies": df["copies"].to_numpy()[row], "cell": to.astype(np.int32), "home": False})])

    placed = spill(homes.mapInPandas(copied, "v binary, copies bigint, cell int, home boolean"))
    # Blocks of homes meet each other and those of copies; copies have been compared at home.
    blocks = placed.groupBy("cell").agg(F.ceil(F.count_if("home") / BLOCK_VECTORS).cast("int").alias("homes"), F.ceil(F.count_if(~F.col("home")) / BLOCK_VECTORS).cast("int").alias("others"))
    rows = placed.join(F.broadcast(blocks), "cell").filter("homes > 0").withColumn("block", F.expr("CAST(pmod(xxhash64(v), IF(home, homes, others)) AS INT)"))
    meets = """IF(home, concat(transform(sequence(0, homes - 1), o -> named_struct('inner', true, 'i', least(block, o), 'j', greatest(block, o))),
        IF(others > 0, transform(sequence(0, others - 1), o -> named_struct('inner', false, 'i', block, 'j', o)), array())),
        transform(sequence(0, homes - 1), o -> named_struct('inner', false, 'i', o, 'j', block)))"""
    tiles = rows.select("v", "copies", "cell", "home", "block", F.explode(F.expr(meets)).alias("t")).select("v", "copies", "cell", "home", "block", "t.*")
    return tiles.groupBy("cell", "inner", "i", "j").applyInPandas(_tile(cosine, dtype), "v binary, root binary, links bigint")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op8_embedding_near_dedup": (op8_embedding_near_dedup, None)}
