"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

Rows stay where they are, as packed blocks of exact integers. Each step is one
Spark job: a block centres its rows X, multiplies them by a short vector
(t = Xw) and at once by its transpose (z = X't); only z and a few inner products
leave a task. The long left vectors u = Xw are never stored, since w says all
about them. Both sides are fully reorthogonalised, and the small bidiagonal
matrix of coefficients is decomposed on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from thermograph.llm.common import spill, table

#: Components of the result at most, and rows of a block.
COMPONENTS, BLOCK_ROWS = 32, 4096
SCALE, SHIFT = 64.0, 1_000_000
#: Singular values below this share of the norm of all rows count as zero.
NOTHING = 1e-12
#: Scaled entries from here on are no longs.
LARGEST = 2.0**62


@dataclass(frozen=True)
class Fit:
    """Components as columns, their variances, and what centring needs."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float


def integer_blocks(vectors: DataFrame) -> DataFrame:
    """vec_ids, d, n, x: rows of one length as blocks of int64 x = floor(64c) + 1000000.

    Rows whose vector is null, empty or holds null or non-finite entries, or
    entries too large for a long, are left out.
    """
    whole = "embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < {})"
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(whole.format(f"{LARGEST / SCALE!r}D"))
    kind = vectors.schema["vec_id"].dataType
    schema = f"vec_ids array<{kind.simpleString()}>, d int, n bigint, x binary"
    id_type = to_arrow_type(kind)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(1)
            sizes = vecs.value_lengths().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            flat = vecs.flatten().to_numpy(zero_copy_only=False)
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                for k in range(0, len(at), BLOCK_ROWS):
                    own = at[k:k + BLOCK_ROWS]
                    x = np.floor(SCALE * flat[starts[own][:, None] + np.arange(d)]).astype(np.int64) + SHIFT
                    ids = batch.column(0).take(pa.array(own)).cast(id_type)
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), ids), pa.array([d], pa.int32()),
                                                      pa.array([len(own)], pa.int64()), pa.array([x.tobytes()], pa.binary())], names=["vec_ids", "d", "n", "x"])

    return rows.mapInArrow(pack, schema)


def _rows(x: bytes, d: int) -> np.ndarray:
    return np.frombuffer(x, np.int64).reshape(-1, d)


def _offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n·x - S, exact: as int64 where that holds it, else as Python integers."""
    reach = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums), default=0))
    if reach < 2**62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n without the rounding of S/n: the difference is exact before it is divided."""
    return _offsets(x, n, sums).astype(np.float64) / n


def _summed(blocks: DataFrame, d: int, f: Callable[[np.ndarray], np.ndarray], size: int, kind: str) -> np.ndarray:
    """The sum over all blocks of the arrays that ``f`` returns, added up in tasks and then by Spark."""
    dtype = np.int64 if kind == "bigint" else np.float64

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, dtype)
        for df in batches:
            for x in df["x"]:
                total += f(_rows(x, d))
        yield pd.DataFrame({"k": np.arange(size, dtype=np.int32), "v": total})

    out = np.zeros(size, dtype)
    for r in blocks.select("x").mapInPandas(run, f"k int, v {kind}").groupBy("k").agg(F.sum("v").alias("v")).collect():
        out[r["k"]] = r["v"]
    return out


def bidiagonalise(product: Callable[[np.ndarray, np.ndarray], tuple[float, np.ndarray, np.ndarray]], d: int, norm: float, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Right vectors V (columns) and upper bidiagonal B with XV = UB.

    ``product(w, W)`` returns |t|², z = X't and the inner products of t = Xw with
    the left vectors XW. Where a coefficient vanishes, the walk goes on from a
    fresh direction, so that repeated and zero values are found as well. It ends
    early once the ``wanted`` largest values stand still and all that has not
    been seen is too small to be among them.
    """
    random = np.random.default_rng(0)
    v_all, w_all, z_all = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))
    b = np.zeros((d, d))
    least = NOTHING * norm

    def fresh() -> np.ndarray:
        while True:
            p = random.standard_normal(d)
            for _ in range(3):
                p = p - v_all @ (v_all.T @ p)
            if np.linalg.norm(p) > 1e-6:
                return p / np.linalg.norm(p)

    v, w = fresh(), None
    for j in range(d):
        v_all = np.column_stack((v_all, v))
        w = v if j == 0 else v - b[j - 1, j] * w_all[:, -1]
        size2, z, along = product(w, w_all)
        w, z = w - w_all @ along, z - z_all @ along
        alpha = np.sqrt(max(size2 - along @ along, 0.0))
        if alpha <= least:
            alpha, w, z = 0.0, np.zeros(d), np.zeros(d)
        else:
            w, z = w / alpha, z / alpha
        b[j, j] = alpha
        w_all, z_all = np.column_stack((w_all, w)), np.column_stack((z_all, z))
        if j + 1 == d:
            break
        p = z - alpha * v
        for _ in range(2):
            p = p - v_all @ (v_all.T @ p)
        beta = float(np.linalg.norm(p))
        if j + 1 >= wanted and (j + 1) % 8 == 0:
            left, s, _ = np.linalg.svd(b[:j + 1, :j + 1])
            still = beta * np.abs(left[-1, :wanted]).max() <= 1e-15 * s[0]
            if still and norm**2 - (s**2).sum() < s[wanted - 1] ** 2 * (1 - 1e-9):
                break
        b[j, j + 1], v = (beta, p / beta) if beta > least else (0.0, fresh())
    return v_all, b[:v_all.shape[1], :v_all.shape[1]]


def fit(blocks: DataFrame, d: int, wanted: int = COMPONENTS) -> Fit:
    """Components of all rows of ``blocks``. Those without variance are left out; there may be none."""
    n = blocks.agg(F.sum("n")).first()[0]
    # Halves of 32 bits add up without overflow, however large the values are.
    halves = _summed(blocks, d, lambda x: np.concatenate(((x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0))), 2 * d, "bigint")
    sums = [(int(h) << 32) + int(k) for h, k in zip(halves[:d], halves[d:])]
    norm2 = float(_summed(blocks, d, lambda x: np.array([(centred(x, n, sums) ** 2).sum()]), 1, "double")[0])
    if not norm2 > 0:
        return Fit(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, 0.0)

    def product(w: np.ndarray, w_all: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def part(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, sums)
            t = c @ w
            return np.concatenate(([t @ t], t @ c, t @ (c @ w_all)))

        got = _summed(blocks, d, part, 1 + d + w_all.shape[1], "double")
        return got[0], got[1:1 + d], got[1 + d:]

    v, b = bidiagonalise(product, d, np.sqrt(norm2), min(wanted, d))
    _, s, turn = np.linalg.svd(b)
    keep = min(wanted, int((s > NOTHING * np.sqrt(norm2)).sum()))
    components, variances = (v @ turn.T)[:, :keep], s[:keep] ** 2 / n
    axes = components / np.sqrt(variances)

    def moments(x: np.ndarray) -> np.ndarray:
        y = centred(x, n, sums) @ axes
        return np.concatenate((y.sum(0), (y.T @ y).ravel()))

    got = _summed(blocks, d, moments, keep + keep * keep, "double")
    mean, square = got[:keep] / n, got[keep:].reshape(keep, keep) / n
    return Fit(n, sums, components, variances, norm2 / n, float(np.abs(square - np.outer(mean, mean) - np.eye(keep)).max()))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums of (n·x - S)², exact; null where a long cannot hold one."""
    gaps = _offsets(x, n, sums)
    if gaps.dtype != object and int(np.abs(gaps).max(initial=0)) ** 2 * x.shape[1] < 2**63:
        return (gaps * gaps).sum(1).tolist()
    return [s if (s := sum(int(g) ** 2 for g in row)) < 2**63 else None for row in gaps]


def whiten(vectors: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every usable row of (vec_id, embedding).

    Result, one row per row and component: vec_id, component (from 1 by falling
    variance), n, deviation, whitened, explained, identity_error. Unusable rows
    (see ``integer_blocks``) have none. Where vectors differ in length, those of
    the most frequent length (of equals the shortest) are the table. Components
    without variance do not exist, so equal vectors or a single one give no
    rows, as does an empty table. Repeated rows count and are returned each; a
    null vec_id stays; a deviation too large for a long is null. Other columns
    are ignored. The driver holds vectors of one length and their products
    with each other, never rows.
    """
    blocks = spill(integer_blocks(vectors))
    sizes = blocks.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if not sizes:
        return vectors.sparkSession.createDataFrame([], schema)
    d = sizes[0]["d"]
    blocks = blocks.filter(F.col("d") == d)
    model = fit(blocks, d, wanted)
    n, sums, axes = model.n, model.sums, model.components / np.sqrt(model.variances)
    explained, m = model.variances / model.trace if model.trace else model.variances, model.components.shape[1]
    identity_error = model.identity_error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data in zip(batch.column(0), batch.column(1)):
                x = _rows(data.as_py(), d)
                rows = len(x)
                if not m:
                    continue
                deviation = pa.array(_deviations(x, n, sums), pa.int64())
                which = pa.array(np.repeat(np.arange(rows), m))
                yield pa.RecordBatch.from_arrays(
                    [ids.values.take(which), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), rows)), pa.array(np.full(rows * m, n)), deviation.take(which),
                     pa.array((centred(x, n, sums) @ axes).ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * m, identity_error))], schema=out)

    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))
    return blocks.select("vec_ids", "x").mapInArrow(run, schema)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_embedding_whitening": (op13_embedding_whitening, None)}
