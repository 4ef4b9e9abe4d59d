"""N-gram Jaccard join by MinHash banding, verified on full shingle sets.

Texts that share a band meet in a cluster; clusters are cut into blocks, and
each pair of blocks is verified in one task as a matrix product of shingle
incidences. A task returns link counts and a spanning forest, never pairs, so a
group of near copies costs rows in proportion to its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermograph.llm.common import spill, table
from thermograph.llm.graph import components, forest
from thermograph.llm.keycount import expand, mix, small_batches, squeeze

SHINGLE = 5
SIMILARITY = 0.8
#: A pair of similarity s shares a band with probability 1 - (1 - s^ROWS)^BANDS: 0.99993 at s = 0.8.
BANDS, ROWS = 24, 5
#: Bounds of a block: texts and shingles on average.
BLOCK_TEXTS, BLOCK_SHINGLES = 400, 400_000
_RANDOM = np.random.default_rng(20240611)
FACTORS = _RANDOM.integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
MASKS = _RANDOM.integers(0, 2**63, BANDS * ROWS, np.uint64)


def shingles(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, and the number of each text's.

    Words are runs without ASCII white space, A-Z in lower case. A text of fewer
    words than a shingle has one, of all its words; one without words has none.
    """
    places: dict[bytes, int] = {}
    streams = [[places.setdefault(w, len(places)) for w in (t or "").encode().lower().split()] for t in texts]
    lengths = np.array([len(s) for s in streams], np.int64)
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in places], np.uint64)
    words = hashes[np.array([i for s in streams for i in s], np.int64)] if len(hashes) else hashes
    counts = np.where(lengths >= size, lengths - size + 1, np.minimum(lengths, 1))
    first = np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    left = np.repeat(np.cumsum(lengths), counts) - first
    out = np.zeros(len(first), np.uint64)
    for i in range(size):
        inside = i < left
        out[inside] = mix(out[inside] * np.uint64(0x9E3779B97F4A7C15) + words[first[inside] + i])
    return out, counts


def band_hashes(texts: list[str | None], size: int = SHINGLE) -> np.ndarray:
    """BANDS hashes of each text with words, in rows; texts without words have none."""
    hashes, counts = shingles(texts, size)
    counts = counts[counts > 0]
    starts = np.cumsum(counts) - counts
    out = np.zeros((len(counts), BANDS), np.uint64)
    for k in range(BANDS * ROWS if len(counts) else 0):
        least = np.minimum.reduceat((hashes ^ MASKS[k]) * FACTORS[k], starts)
        out[:, k // ROWS] = mix(out[:, k // ROWS] * np.uint64(0xD1342543DE82EF95) + least + np.uint64(k))
    return out


@F.pandas_udf(T.ArrayType(T.LongType()))
def signature(texts: pd.Series) -> pd.Series:
    """The number of shingles and the band hashes of each text; null without words."""
    found = texts.tolist()
    bands = iter(band_hashes(found).view(np.int64))
    return pd.Series([[int(n), *next(bands)] if n else None for n in shingles(found)[1]], dtype=object)


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        hashes, counts = shingles(df["text"].tolist())
        sets = [np.unique(x) for x in np.split(hashes, np.cumsum(counts)[:-1])]
        yield df.drop(columns="text").assign(shingles=[squeeze(np.diff(x, prepend=np.uint64(0))) for x in sets])


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sorted sets, by products of dense column blocks."""
    a, b = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(a, b)
    rows = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    out = np.zeros((len(left), len(right)), np.float32)
    where = [np.searchsorted(common, x) for x in (a, b)]
    keep = [(w < len(common)) & (common[np.minimum(w, len(common) - 1)] == x) if len(common) else np.zeros(len(x), bool) for w, x in zip(where, (a, b))]
    cells = [(r[k], w[k]) for r, w, k in zip(rows, where, keep)]
    width = 4096
    for at in range(0, len(common), width):
        dense = []
        for (r, c), n in zip(cells, out.shape):
            own = (c >= at) & (c < at + width)
            m = np.zeros((n, min(width, len(common) - at)), np.float32)
            m[r[own], c[own] - at] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def _verify(similarity: float):
    def run(df: pd.DataFrame) -> pd.DataFrame:
        df = df.drop_duplicates("v").sort_values("v")
        sets = [np.cumsum(expand(x, np.uint64), dtype=np.uint64) for x in df["shingles"]]
        block, copies, v = df["block"].to_numpy(), df["copies"].to_numpy(), df["v"].to_numpy()
        i, j = int(df["i"].iloc[0]), int(df["j"].iloc[0])
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links = np.zeros(len(df), np.int64)
        root = np.arange(len(df))
        if len(left) and len(right):
            sizes = np.array([len(s) for s in sets], np.float64)
            common = overlaps([sets[k] for k in left], [sets[k] for k in right]).astype(np.float64)
            linked = common >= similarity * (sizes[left][:, None] + sizes[right][None, :] - common) - 1e-9
            linked &= left[:, None] != right[None, :]
            links[left] += linked @ copies[right]
            if i != j:
                links[right] += linked.T @ copies[left]
            root = forest(linked, left, right, len(df))
        return pd.DataFrame({"v": v, "root": v[root], "links": links})

    return run


def jaccard_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Class of every distinct text with words that has a link or a copy.

    Result: v (md5 of the text), class_v, class_doc (least doc_id of the class),
    n_links (documents linked to each document of this text, copies included),
    own_doc (least doc_id of the text), same (rows with that doc_id and text).

    Texts are linked when the Jaccard similarity of their full shingle sets is
    at least ``similarity``; candidates are texts that share a MinHash band, and
    all texts of their cluster besides. Exact copies are one vertex.
    """
    keyed = docs.select("doc_id", "text", F.unhex(F.md5(F.col("text").cast("binary"))).alias("v")).filter("text IS NOT NULL")
    signed = small_batches(keyed).select("doc_id", "v", signature("text").alias("bands")).filter("bands IS NOT NULL")
    texts = spill(signed.groupBy("v", "doc_id").agg(F.count("*").alias("same"), F.first("bands").alias("bands"))
                  .groupBy("v").agg(F.sum("same").alias("copies"), F.min_by(F.struct("doc_id", "same"), F.struct(F.col("doc_id").isNull(), "doc_id")).alias("own"), F.first("bands").alias("bands"))
                  .withColumn("n", F.col("bands")[0]))
    banded = texts.select("v", F.posexplode(F.expr("slice(bands, 2, size(bands) - 1)")).alias("band", "h"))
    shared = spill(banded.groupBy("band", "h").agg(F.min("v").alias("least"), F.count("*").alias("size")).filter("size > 1").select("band", "h", "least"))
    star = banded.join(shared, ["band", "h"]).select(F.col("v").alias("a"), F.col("least").alias("b"))
    cluster = components(star)
    member = spill(cluster.select("v", F.col("root").alias("cluster")).unionByName(cluster.select(F.col("root").alias("v"), F.col("root").alias("cluster")).distinct()))
    known = spill(member.join(texts.select("v", "copies", "own", "n"), "v"))
    blocks = spill(known.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")))
    placed = known.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("v"), "blocks").cast("int")).select("v", "cluster", "copies", "blocks", "block", F.col("own.doc_id").alias("doc_id"))
    chosen = keyed.join(placed, (keyed.v == placed.v) & keyed.doc_id.eqNullSafe(placed.doc_id)).select("text", placed.v, "cluster", "copies", "blocks", "block")
    sets = small_batches(chosen).mapInPandas(_sets, "v binary, cluster binary, copies bigint, blocks int, block int, shingles binary")
    tiles = sets.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "v", "cluster", "copies", "block", "shingles", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    found = spill(tiles.groupBy("cluster", "i", "j").applyInPandas(_verify(similarity), "v binary, root binary, links bigint"))
    roots = components(found.filter("v != root").select(F.col("v").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("v").agg(F.sum("links").alias("links"))
    classed = spill(texts.join(links, "v", "left").join(roots, "v", "left").select("v", "own", F.coalesce("root", "v").alias("class_v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    least = spill(classed.groupBy("class_v").agg(F.min_by(F.struct("v", "own.doc_id"), F.struct(F.col("own.doc_id").isNull(), "own.doc_id", "v")).alias("first")))
    return spill(classed.join(least, "class_v").select("v", F.col("first.v").alias("class_v"), F.col("first.doc_id").alias("class_doc"), "n_links", F.col("own.doc_id").alias("own_doc"), F.col("own.same").alias("same")))


def jaccard_join(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, n_links, kept.

    class_id is the least doc_id of the documents reachable by links (null only
    where all of them are null); kept marks the rows that hold it in the text
    chosen for the class. Null texts and texts without words link with nothing:
    class_id is their doc_id and they are kept. Repeated rows are copies of each
    other and linked. Other columns are ignored.
    """
    classes = jaccard_classes(docs, similarity)
    rows = docs.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("v"))
    out = rows.join(classes, "v", "left")
    return out.select("doc_id", F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_doc")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                      (F.col("n_links").isNull() | ((F.col("v") == F.col("class_v")) & F.col("doc_id").eqNullSafe(F.col("class_doc")))).alias("kept"))


def keep_one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` less all but one of each class, with their columns.

    The row with the class's least doc_id stays; of rows repeated in doc_id and
    text, one. Rows without words all stay.
    """
    classes = jaccard_classes(docs, similarity).select(F.col("v").alias("__v"), "class_v", "class_doc", "n_links", "same")
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("__v"))
    out = packed.join(classes, "__v", "left").filter("n_links IS NULL OR (__v = class_v AND row.doc_id <=> class_doc)")
    twice = out.filter("same > 1").withColumn("__d", F.col("row.doc_id")).dropDuplicates(["__v", "__d"])
    return out.filter("same IS NULL OR same = 1").select("row").unionByName(twice.select("row")).select("row.*")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op1_ngram_jaccard_join": (op1_ngram_jaccard_join, None)}
