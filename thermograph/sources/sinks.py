"""Writers: ordered CSV, per-category output, resumable appends, artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, fields: list[str], mode: str = "overwrite") -> None:
    """Listed columns in order, others ignored; absent ones become blank.

    Each file starts with a byte-order mark, in front of the header.
    """
    cols = [(F.col(f) if f in df.columns else F.lit("")).alias("\ufeff" * (i == 0) + f) for i, f in enumerate(fields)]
    df.select(*cols).write.mode(mode).option("header", True).option("encoding", "UTF-8").option("escape", '"').csv(path)


def write_per_category(df: DataFrame, path: str, category: str = "fine_category") -> None:
    """The full manifest and one folder per category."""
    df.write.mode("overwrite").parquet(f"{path}/manifest")
    df.write.mode("overwrite").partitionBy(category).parquet(f"{path}/by_category")


def pending(work: DataFrame, done: DataFrame, key: str = "report_id") -> DataFrame:
    """Work whose key has no complete result yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def resume_append(results: DataFrame, path: str, done: DataFrame | None, key: str = "report_id") -> None:
    """Append results of unfinished keys; failures are rows with a status.

    Rows with an ``error`` get status FAIL and stay eligible for a later run.
    """
    r = results if done is None else pending(results, done.filter("status <> 'FAIL'"), key)
    r.withColumn("status", F.when(F.col("error").isNotNull(), "FAIL").otherwise(F.col("status"))).write.mode("append").parquet(path)


def with_digest(artifacts: DataFrame, payload: list[str], name: str = "sha256") -> DataFrame:
    """Digest of the payload columns in canonical JSON form."""
    return artifacts.withColumn(name, F.sha2(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"}), 256))


def topology_with_opening_digest(topology: DataFrame, openings: DataFrame) -> DataFrame:
    """Topology rows that carry the digest of their page's opening artifact.

    Opening digests combine as a sorted list of row digests, so the page value
    does not depend on row order.
    """
    d = with_digest(openings, [c for c in openings.columns if c != "page_id"], "_d")
    page = d.groupBy("page_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("_d")), ""), 256).alias("openings_sha256"))
    return topology.join(page, "page_id", "left")


def export_cards_items_trace(cards: DataFrame, items: DataFrame, trace: DataFrame, path: str) -> None:
    for name, df in (("report_cards", cards), ("items", items), ("trace", trace)):
        write_csv(df, f"{path}/{name}", df.columns)
