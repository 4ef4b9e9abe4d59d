"""Session helpers shared by iterative operators."""

from __future__ import annotations

import gc
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: a cluster must
    name shared storage, since executors can be lost at any time.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to shared storage before running iterative operators")
        named = tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp")
    sc.setCheckpointDir(named)
    return named


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_TRACKED = "spark.cleaner.referenceTracking.cleanCheckpoints"
#: Seconds between two sweeps for what no table needs any longer.
SWEEP_SECONDS = 10.0
_swept: dict[str, float] = {}


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives executor loss, unlike a local one.

    The shuffle files of the step go as soon as its rows are written, and the
    rows once no table that reads them is left (see ``sweep``), so a job of
    many steps holds the disk of the widest step and not of all.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    core = spark.sparkContext._jsc.sc().conf()
    if not core.contains(_TRACKED):
        core.set(_TRACKED, "true")
    sweep(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        # A plan of its own: the shuffles of one that was run before, or will be again, are not this step's.
        out = df.select("*").checkpoint(eager=True)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return out


def sweep(spark: SparkSession) -> None:
    """Let Spark's cleaner find checkpoints and shuffles that nothing refers to; at most every SWEEP_SECONDS.

    The cleaner acts on collected objects only, and a driver with memory to
    spare seldom collects.
    """
    app, now = spark.sparkContext.applicationId, time.monotonic()
    if now - _swept.setdefault(app, now) >= SWEEP_SECONDS:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _swept[app] = time.monotonic()


def tune_session(spark: SparkSession) -> None:
    """Settings the wide expression models rely on; a caller's own value stays.

    Methods above 8000 bytes of bytecode are never compiled by the JVM's JIT,
    so a fused stage of that size runs many times slower than the same
    expressions split into small methods, which is what the limit selects.
    """
    if spark.conf.get("spark.sql.codegen.hugeMethodLimit", None) in (None, "65535"):
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    # Planned sizes know nothing of the rows an explode adds, so a table of some MB may be sent to the driver and
    # every executor as some GB. Joins broadcast by the size measured at run time; only constants do so by plan.
    planned, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    limit = spark.conf.get(planned)
    if spark.conf.get(measured, None) is None and not limit.startswith("-"):
        spark.conf.set(measured, limit)
        spark.conf.set(planned, "64k")
