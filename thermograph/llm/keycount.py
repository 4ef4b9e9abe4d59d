"""Global totals of 64-bit keys, exchanged as compressed key blocks.

Tasks cut their input into chunks and reduce each to sorted distinct keys with
counts. A key block travels to the bucket of its hash range, is added up there
with the blocks of all other chunks, and the totals return to the chunk in its
own key order. A hot key costs one entry per chunk, however often it occurs.
"""

from __future__ import annotations

import secrets

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text bytes of a chunk, and keys of a bucket on average; both bound a task's memory.
CHUNK_BYTES = 6_000_000
BUCKET_KEYS = 1_000_000

BLOCKS = "array<struct<bucket:int,keys:binary,counts:binary,checks:binary>>"


def squeeze(a: np.ndarray) -> bytes:
    """Byte planes of an array, compressed: small values leave planes of zeros."""
    a = np.ascontiguousarray(a)
    return zstandard.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b"", 1)


def expand(data: bytes, dtype: type = np.int64) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(dtype).ravel()


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def blocks(keys: np.ndarray, counts: np.ndarray, buckets: int, checks: np.ndarray | None = None) -> list[dict]:
    """Sorted distinct uint64 keys and their counts, as one block per hash range.

    ``checks`` are 64 more bits of each key, where keys must be told apart by 128.
    """
    at = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(at)) + 1
    out = []
    more = np.split(checks, cuts) if checks is not None else [None] * (len(cuts) + 1)
    for k, c, m, b in zip(np.split(keys, cuts), np.split(counts, cuts), more, at[np.concatenate(([0], cuts))] if len(at) else []):
        out.append({"bucket": int(b), "keys": squeeze(np.diff(k, prepend=np.uint64(0))), "counts": squeeze(c.astype(np.uint32)), "checks": m if m is None else squeeze(m)})
    return out


def distinct(keys: np.ndarray, checks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Sorted distinct keys (with their check bits) and the place of each input in them."""
    if checks is None:
        found, which = np.unique(keys, return_inverse=True)
        return found, which, None
    order = np.lexsort((checks, keys))
    k, c = keys[order], checks[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    which = np.empty(len(k), np.int64)
    which[order] = np.cumsum(new) - 1
    return k[new], which, c[new]


def chunk_texts(batches, f, schema: pa.Schema):
    """Chunks of (text, row struct) batches with the columns that ``f(texts)`` adds, one row each."""
    texts: list[pa.Array] = []
    rows: list[pa.Array] = []
    held = 0

    def close() -> pa.RecordBatch:
        text, row = pa.concat_arrays(texts), pa.concat_arrays(rows)
        ends = pa.array([0, len(text)], pa.int32())
        more = {"chunk": [new_chunk()]} | {k: [v] for k, v in f(text).items()}
        columns = {"texts": pa.ListArray.from_arrays(ends, text), "rows": pa.ListArray.from_arrays(ends, row)}
        return pa.RecordBatch.from_arrays([columns[x.name].cast(x.type) if x.name in columns else pa.array(more[x.name], x.type) for x in schema], schema=schema)

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False) + 8
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = min(batch.num_rows, max(at + 1, int(np.searchsorted(ends, base + CHUNK_BYTES - held, "left")) + 1))
            texts.append(batch.column(0).slice(at, to - at))
            rows.append(batch.column(1).slice(at, to - at))
            held += int(ends[to - 1] - base)
            at = to
            if held >= CHUNK_BYTES:
                yield close()
                texts, rows, held = [], [], 0
    if texts:
        yield close()


def new_chunk() -> int:
    return secrets.randbits(62)


def key_totals(parts: DataFrame) -> DataFrame:
    """Totals of every key of (chunk, bucket, keys, counts, checks).

    Result: chunk, bucket, totals (in key order), and on one row of each bucket
    ``n_keys`` (keys with a total over 0) and ``n_total`` (their sum), else 0.
    """
    def add(df: pd.DataFrame) -> pd.DataFrame:
        keys = [np.cumsum(expand(k, np.uint64), dtype=np.uint64) for k in df["keys"]]
        counts = np.concatenate([expand(c, np.uint32) for c in df["counts"]]).astype(np.float64)
        checks = None if df["checks"].isna().any() else np.concatenate([expand(c, np.uint64) for c in df["checks"]])
        _, which, _ = distinct(np.concatenate(keys), checks)
        total = np.bincount(which, counts).astype(np.int64)
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        n = len(df)
        return pd.DataFrame({"chunk": df["chunk"], "bucket": df["bucket"], "totals": [squeeze(x) for x in np.split(total[which], cuts)],
                             "n_keys": [int((total > 0).sum())] + [0] * (n - 1), "n_total": [int(total.sum())] + [0] * (n - 1)})

    return parts.groupBy("bucket").applyInPandas(add, "chunk bigint, bucket int, totals binary, n_keys bigint, n_total bigint")


def exploded(chunks: DataFrame, column: str) -> DataFrame:
    return chunks.select("chunk", F.explode(column).alias("x")).select("chunk", "x.bucket", "x.keys", "x.counts", "x.checks")


def in_order(rows: pd.DataFrame) -> np.ndarray:
    """All totals of a chunk, in the order of its sorted keys."""
    parts = [expand(t) for t in rows.sort_values("bucket")["totals"]]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def bucket_count(n_keys: int) -> int:
    return max(8, -(-n_keys // BUCKET_KEYS))


def small_batches(docs: DataFrame, rows: int = 200) -> DataFrame:
    """Fewer rows to an Arrow batch than Spark's default, as texts can be long; a caller's own value stays."""
    conf = docs.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return docs
