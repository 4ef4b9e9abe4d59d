"""Parameter library: ranked reads and table maintenance in join form.

Every maintenance operator takes the current table and a batch and returns
the next version of the table; a catalog with MERGE can run the same rule in
place, plain files are written to a new path and swapped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermograph.functions import rules as R
from thermograph.functions import text as X
from thermograph.operators.relational import keep_first, latest


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """Insert new keys, overwrite ``columns`` of known ones; last batch row wins.

    Columns outside ``columns`` keep the old value on update; on insert they
    take the batch value where the batch has one.
    """
    b = latest(batch, keys, [order])
    rest = [c for c in target.columns if c not in keys]
    inc = b.select(*keys, F.lit(True).alias("_new"), *[F.col(c).alias(f"_b_{c}") for c in rest if c in b.columns])
    old = target.withColumn("_old", F.lit(True))
    j = old.join(inc, keys, "full_outer")
    out = []
    for c in rest:
        if c not in b.columns:
            out.append(F.col(c))
        elif c in columns:
            out.append(F.when(F.col("_new"), F.col(f"_b_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_b_{c}")).alias(c))
    return j.select(*keys, *out).select(*target.columns)


def upsert_keep_nonblank(target: DataFrame, batch: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """Overwrite only with non-blank values; a batch folds to its last non-blank."""
    b = batch.groupBy(*keys).agg(*[
        F.max_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(order))).alias(f"_b_{c}") for c in columns])
    j = target.join(b, keys, "full_outer")
    merged = {c: F.coalesce(F.col(f"_b_{c}"), F.col(c)) for c in columns}
    return j.select(*[merged[c].alias(c) if c in merged else F.col(c) for c in target.columns])


def insert_ignore(target: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Append rows whose key is new; the first batch row of a key counts."""
    fresh = keep_first(batch, keys, [order]).join(target.select(*keys).distinct(), keys, "left_anti")
    return target.unionByName(fresh.select(*[c for c in fresh.columns if c in target.columns]), allowMissingColumns=True)


def update_if_exists(target: DataFrame, batch: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    b = latest(batch, keys, [order]).select(*keys, F.lit(True).alias("_new"), *[F.col(c).alias(f"_b_{c}") for c in columns])
    j = target.join(b, keys, "left")
    return j.select(*[F.when(F.col("_new"), F.col(f"_b_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns])


def replace_source(target: DataFrame, batch: DataFrame, source: str) -> DataFrame:
    """Drop all rows of one source, then append the batch."""
    kept = target.filter(~F.col("source").eqNullSafe(source))
    return kept.unionByName(batch.select(*[c for c in batch.columns if c in target.columns]), allowMissingColumns=True)


def evolve_columns(old: DataFrame, schema: dict[str, str], keys: list[str], order: str) -> DataFrame:
    """Carry common columns into a wider layout; first row per key stays.

    Keys with a null part never collide, as in a unique constraint.
    """
    cols = [F.col(c).cast(t).alias(c) if c in old.columns else F.lit(None).cast(t).alias(c) for c, t in schema.items()]
    wide = old.select(*cols, F.col(order).alias("_o"))
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    firsts = keep_first(wide.filter(~null_key), keys, ["_o"])
    return firsts.unionByName(wide.filter(null_key)).drop("_o")


def status_upsert(reports: DataFrame, changes: DataFrame) -> DataFrame:
    """Status and time per (username, report_number)."""
    return upsert(reports, changes, ["username", "report_number"], ["status", "updated_at"], "pos")


def source_rank(source: Column, first: str = "structured_windows", second: str = "sample") -> Column:
    return F.when(source == first, 0).when(source == second, 1).otherwise(2)


def ranked_options(options: DataFrame, category: str | None = None, first: str = "structured_windows", second: str = "sample") -> DataFrame:
    """Options in display order: source rank, then name."""
    df = options if category is None else options.filter(F.col("category") == category)
    return df.withColumn("source_rank", source_rank(F.col("source"), first, second)).orderBy("category", "source_rank", "name", "id")


def read_library(primary: DataFrame, fallback: DataFrame, tables: dict[str, str] = R.LIBRARY_TABLES) -> DataFrame:
    """Options per category; categories without any primary row fall back."""
    known = primary.filter(F.col("category").isin(*tables)) if tables else primary
    missing = fallback.join(known.select("category").distinct(), "category", "left_anti")
    cols = [c for c in primary.columns if c in fallback.columns]
    return known.select(*cols, F.lit("primary").alias("origin")).unionByName(missing.select(*cols, F.lit("fallback").alias("origin")))


def existing_names_anti(candidates: DataFrame, options: DataFrame, source: str) -> DataFrame:
    """Candidates whose (category, name) no other source has taken."""
    taken = options.filter(F.col("source") != source).select("category", X.clean(F.col("name")).alias("name")).filter("name <> ''").distinct()
    return candidates.join(taken, ["category", "name"], "left_anti")


def build_library(rows: DataFrame) -> dict[str, DataFrame]:
    """Reviewed parameters to reports, reviews, materials and walls.

    Only kept rows make library entries; kept and to-be-checked rows make
    reports and reviews. First row per unique key wins.
    """
    r = rows.withColumns({
        "status": X.clean_lower(F.col("review_status")), "num": X.clean(F.col("numeric_value")).try_cast("double"),
        "report_id": X.clean(F.col("source_report_id")), "name0": X.clean(F.col("sample_name"))})
    noted = r.filter(F.col("status").isin("keep", "needs_check"))
    info = ["sample_name", "manufacturer", "brand", "spec_model", "test_basis", "test_items"]
    reports = noted.groupBy("report_id").agg(*[
        F.coalesce(F.max_by(X.clean(F.col(c)), F.when(X.clean(F.col(c)) != "", F.col("pos"))), F.lit("")).alias(c) for c in info])
    kept = r.filter("status = 'keep' AND num IS NOT NULL")
    named = lambda prefix: F.when(F.col("name0") != "", F.col("name0")).otherwise(F.trim(F.concat_ws(" ", F.lit(prefix), "report_id")))
    text = F.concat_ws(" ", "name0", X.clean(F.col("item_path")), X.clean(F.col("test_items")))
    from thermograph.operators.classify import material_category
    materials = kept.filter("parameter_type = 'thermal_conductivity_lambda'").select(
        "pos", named("未命名材料").alias("name"), material_category(text).alias("category"), F.col("num").alias("lambda_w_mk"), "report_id", "item_path")
    walls = kept.filter("parameter_type = 'thermal_resistance_r'").select(
        "pos", named("未命名外墙构造").alias("name"), F.col("num").alias("r_value_m2k_w"), F.when(F.col("num") != 0, 1.0 / F.col("num")).alias("u_wall_w_m2k"), "report_id", "item_path")
    return {
        "source_reports": reports,
        "candidate_parameter_reviews": noted,
        "materials": keep_first(materials, ["name", "category", "report_id", "item_path"], ["pos"]),
        "wall_assemblies": keep_first(walls, ["name", "report_id", "item_path"], ["pos"]),
    }


def import_decisions(classified: DataFrame, params: DataFrame) -> DataFrame:
    """Status, reason and value of each classified report, before names are given out.

    ``classified``: report_id, fine_category, sample_name, spec_model, pos.
    ``params``: report_id, parameter_type, value, evidence, raw_value, unit, pos.
    Reports match parameters by id, else by id without hash suffix.
    """
    from thermograph.operators.relational import first_u_parameter, thermal_value_fold

    by_id = params.select(F.col("report_id").alias("k"), "parameter_type", "value", "evidence", "raw_value", "unit", "pos")
    loose = by_id.withColumn("k2", X.report_key(F.col("k"))).filter("k2 <> k").select(F.col("k2").alias("k"), *by_id.columns[1:])
    every = by_id.unionByName(loose)
    c = classified.withColumn("rk", X.report_key(F.col("report_id")))
    have = every.select("k").distinct().withColumn("_h", F.lit(True))
    c = c.join(have.withColumnRenamed("k", "report_id").withColumnRenamed("_h", "_h1"), "report_id", "left").join(
        have.withColumnRenamed("k", "rk").withColumnRenamed("_h", "_h2"), "rk", "left")
    c = c.withColumn("pk", F.when(F.col("_h1"), F.col("report_id")).when(F.col("_h2"), F.col("rk")))
    wall = thermal_value_fold(every.withColumnRenamed("k", "report_id"), "report_id").withColumnRenamed("report_id", "pk")
    u = first_u_parameter(every.withColumnRenamed("k", "report_id"), "report_id").select(
        F.col("report_id").alias("pk"), F.col("value").try_cast("double").alias("u_first"), F.col("unit").alias("u_unit"), F.col("raw_value").alias("u_raw"))
    c = c.join(wall, "pk", "left").join(u, "pk", "left")
    cat = F.col("fine_category")
    any_wall = F.coalesce("r_value_m2k_w", "u_wall_w_m2k", "lambda_w_mk").isNotNull()
    reason = (F.when(cat == "needs_review", "needs_review").when(~cat.isin(*R.IMPORT_CATEGORIES), "unknown_category")
              .when(F.col("pk").isNull(), "no_parameters")
              .when((cat == "wall_insulation") & ~any_wall, "no_compatible_parameter").when(cat == "wall_insulation", "")
              .when(~cat.isin(*R.U_CATEGORIES), "no_compatible_importer_for_category").when(F.col("u_first").isNull(), "no_thermal_transmittance_u").otherwise(""))
    c = c.withColumn("reason", reason).withColumn("status", F.when(F.col("reason") == "", "imported").otherwise("skipped"))
    value = F.when(cat == "wall_insulation", F.coalesce("u_wall_w_m2k", "lambda_w_mk", "r_value_m2k_w")).otherwise(F.col("u_first"))
    return c.withColumns({"value": F.when(F.col("status") == "imported", value), "base_name": X.choose_name(F.col("sample_name"), F.col("spec_model"), F.col("report_id"))})


def import_classified(classified: DataFrame, params: DataFrame, used_names: DataFrame) -> DataFrame:
    """One audit row per classified report: status, reason, name and value.

    ``import_decisions`` with the names: walls keep theirs, others get one that no other of their category has.
    """
    from thermograph.operators.relational import allocate_unique_names

    c, cat = import_decisions(classified, params), F.col("fine_category")
    ok = c.filter("status = 'imported'")
    walls = ok.filter(cat == "wall_insulation").withColumn("name", F.col("base_name"))
    others = allocate_unique_names(ok.filter(cat != "wall_insulation").withColumn("category", cat), used_names, ["category"], "base_name", "pos")
    others = others.withColumn("name", F.col("allocated_name")).drop("allocated_name", "category")
    rest = c.filter("status = 'skipped'").withColumn("name", F.lit(None).cast("string"))
    return walls.unionByName(others).unionByName(rest).select(
        "report_id", "fine_category", "status", "reason", "name", "value", "pos", F.when(cat == "wall_insulation", F.col("source_item_path")).alias("source_item_path"))
