"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermograph.session import checkpoint_dir

#: Words are maximal runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
KEY = "__row_key"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spill(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later steps start from the files, so a lost executor costs no recomputation
    of what came before. Shuffle files of the write are dropped with it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(conf, None)
    spark.conf.set(conf, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(conf) if before is None else spark.conf.set(conf, before)
    return spark.read.schema(df.schema).parquet(path)


def spill_kinds(df: DataFrame, kinds: dict[str, list[str]]) -> dict[str, DataFrame]:
    """``spill`` for rows of several kinds (column ``kind``) in one pass: each kind is read with its own columns."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    conf = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(conf, None)
    spark.conf.set(conf, str(len(kinds)))  # open files for all kinds, so that rows need no sort
    try:
        df.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    finally:
        spark.conf.unset(conf) if before is None else spark.conf.set(conf, before)
    out = {}
    for kind, columns in kinds.items():
        schema = df.select(*columns).schema
        found = _path(spark, f"{path}/kind={kind}")
        out[kind] = spark.read.schema(schema).parquet(f"{path}/kind={kind}") if found[0].exists(found[1]) else spark.createDataFrame([], schema)
    return out


def _path(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def discard(df: DataFrame) -> None:
    """Removes the files of a spilled table. Only for tables of which all that follows has been written."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/llm-" in folder:
            fs, at = _path(df.sparkSession, folder)
            fs.delete(at, True)


def row_key(*columns: str) -> Column:
    """128 bits that tell rows apart by content; equal rows share a key.

    Nulls hash as a marker of their own, so that null and empty differ.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00null")) for c in columns]
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))


def held_out(column: str, modulus: int, remainder: int) -> Column:
    """True where crc32 of the column as text leaves ``remainder``; null hashes as empty."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def sql_strings(values: Iterable[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)
