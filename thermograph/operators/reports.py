"""Report table: listing, ownership, reconciliation, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermograph.functions import rules as R
from thermograph.functions import text as X
from thermograph.operators.relational import latest


def latest_report(reports: DataFrame) -> DataFrame:
    """Newest row per (username, report_number) by created_at, then id."""
    return latest(reports, ["username", "report_number"], ["created_at", "id"])


def owner_scope(reports: DataFrame, viewers: DataFrame) -> DataFrame:
    """Rows each viewer may see.

    ``viewers``: viewer, is_admin, requested_owner (null for no filter).
    Administrators see all owners or the one they ask for; others only their
    own rows, and asking for another owner yields nothing. The two cases join
    separately so that neither becomes an all-pairs scan of the owners.
    """
    v = viewers.withColumn("denied", ~F.col("is_admin") & F.col("requested_owner").isNotNull() & (F.col("requested_owner") != F.col("viewer")))
    scoped = v.filter("NOT denied AND (NOT is_admin OR requested_owner IS NOT NULL)").select(
        "viewer", F.coalesce("requested_owner", "viewer").alias("username"))
    own = reports.join(scoped, "username").select("viewer", *reports.columns)
    full = v.filter("is_admin AND requested_owner IS NULL").select("viewer")
    return own, full


def visible_counts(reports: DataFrame, viewers: DataFrame, measure: str) -> DataFrame:
    """Reports and the sum of ``measure`` that each viewer may see: viewer, n, total.

    Administrators who see all share one total, so no report meets a viewer.
    Viewers without a visible report have no row.
    """
    own, full = owner_scope(reports, viewers)
    count = lambda df, *keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(measure).alias("total"))
    every = count(reports, F.lit(1).alias("_k")).filter("n > 0")
    return count(own, "viewer").unionByName(full.withColumn("_k", F.lit(1)).join(every, "_k").drop("_k"))


def report_listing_fields(geometry: Column, results: Column) -> dict[str, Column]:
    """Listing columns from the JSON payloads; anything odd shows defaults."""
    num = lambda doc, path: F.coalesce(F.get_json_object(doc, path).try_cast("double"), F.lit(0.0))
    return {
        "floor_area": num(geometry, "$.floor_area_m2"),
        "total_energy": num(results, "$.summary.total_energy_kwh"),
        "eui": num(results, "$.summary.eui"),
        "rating": F.coalesce(F.get_json_object(results, "$.summary.rating"), F.lit("-")),
    }


def reconcile_layout(persisted: DataFrame, actual: DataFrame) -> DataFrame:
    """Problems between stored and found (owner, report) pairs."""
    a = persisted.select("owner", "report").distinct().withColumn("_p", F.lit(True))
    b = actual.select("owner", "report").distinct().withColumn("_a", F.lit(True))
    owners = a.select("owner", F.lit(True).alias("_o")).distinct()
    return a.join(b, ["owner", "report"], "full_outer").join(owners, "owner", "left").withColumn(
        "problem", F.when(F.col("_o").isNull(), "unknown_owner").when(F.col("_p").isNull(), "unexpected_report")
        .when(F.col("_a").isNull(), "missing_report")).filter("problem IS NOT NULL").drop("_p", "_a", "_o")


def category_order(category: Column, order=R.FINE_CATEGORIES) -> Column:
    i = F.array_position(F.array(*[F.lit(c) for c in order]), category)
    return F.when(i > 0, i - 1).otherwise(99)


def organize_plan(rows: DataFrame) -> DataFrame:
    """Target path per report: category / work__report__digest.suffix."""
    src = F.when(X.clean(F.col("destination")) != "", F.col("destination")).otherwise(F.col("source_path"))
    name = F.concat(X.safe_name(F.col("work_id")), F.lit("__"), X.safe_name(F.col("report_id")), F.lit("__"), F.substring(F.sha1(src), 1, 10), X.path_suffix(src))
    return rows.withColumn("target_path", F.concat_ws("/", "fine_category", name))


def offset_limit(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    out = df.orderBy(*order).offset(offset)
    return out.limit(limit) if limit else out
