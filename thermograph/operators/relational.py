"""General table operators: keep-first, lookups, folds, ranks, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thermograph.functions import rules as R
from thermograph.functions import text as X
from thermograph.session import cut_lineage


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    """One row per key, the first in ``order``.

    The rank-one filter is pruned before the shuffle (each map task keeps one
    row per key), so a hot key stays cheap.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def latest(df: DataFrame, keys: list, order: list[str]) -> DataFrame:
    """One row per key, the greatest in ``order``."""
    return keep_first(df, keys, [F.col(c).desc() for c in order])


def top_per_group(df: DataFrame, keys: list, order: list, k: int) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def spread_row_number(df: DataFrame, keys: list[str], order: list, tile: Column, name: str = "rn") -> DataFrame:
    """``row_number`` per key that never needs one task per key.

    ``tile`` is a coarse function that never decreases along ``order``. Rows
    are numbered inside (key, tile); tile counts, one small row each, give the
    offsets.
    """
    rows = df.withColumn("_tile", tile)
    counts = rows.groupBy(*keys, "_tile").agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(*keys).orderBy("_tile").rowsBetween(W.unboundedPreceding, -1) if keys else \
        W.orderBy("_tile").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_tile", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    numbered = rows.withColumn("_rn", F.row_number().over(W.partitionBy(*keys, "_tile").orderBy(*order)))
    return numbered.join(offsets, [*keys, "_tile"]).withColumn(name, F.col("_rn") + F.col("_off")).drop("_tile", "_rn", "_off")


def sequential_ids(df: DataFrame, keys: list[str], order: list, tile: Column, prefix: str, digits: int = 4, name: str = "id") -> DataFrame:
    """Stable ids such as ``gap-0001`` per key in the given order."""
    return spread_row_number(df, keys, order, tile, "_seq").withColumn(
        name, F.format_string(f"{prefix}-%0{digits}d", F.col("_seq"))).drop("_seq")


# -- joins --------------------------------------------------------------------

def priority_lookup_join(left: DataFrame, left_keys: list[Column], right: DataFrame, right_keys: list[Column], row_id: str,
                         payload: list[str], right_order: str) -> DataFrame:
    """Left outer lookup by an ordered list of keys on both sides.

    A right row is reachable under each of its keys; where several rows share
    a key the last in ``right_order`` wins, as in a dictionary filled in order.
    A left row takes the match of its first key that hits.
    """
    index = right.select(F.explode(F.array_distinct(F.array(*right_keys))).alias("_k"), right_order, *payload).filter("_k <> ''")
    index = latest(index, ["_k"], [right_order]).select("_k", *[F.col(p).alias(f"hit_{p}") for p in payload])
    probes = left.select(row_id, F.posexplode(F.array(*left_keys)).alias("_rank", "_k")).filter("_k <> ''")
    hits = keep_first(probes.join(index, "_k"), [row_id], ["_rank"]).drop("_k")
    return left.join(hits, row_id, "left").withColumnRenamed("_rank", "hit_rank")


def key_or_normalized_key_join(left: DataFrame, right: DataFrame, key: str, payload: list[str], order: str) -> DataFrame:
    """Match by id, else by the id without its hash suffix."""
    exact = latest(right.select(F.col(key).alias("_k"), order, *payload), ["_k"], [order]).select(
        "_k", F.lit(True).alias("_x"), *[F.col(p).alias(f"x_{p}") for p in payload])
    loose = latest(right.select(X.report_key(F.col(key)).alias("_k2"), order, *payload), ["_k2"], [order]).select(
        "_k2", F.lit(True).alias("_y"), *[F.col(p).alias(f"y_{p}") for p in payload])
    j = left.join(exact, F.col(key) == F.col("_k"), "left").join(loose, X.report_key(F.col(key)) == F.col("_k2"), "left")
    return j.select(*left.columns, *[F.when(F.col("_x"), F.col(f"x_{p}")).otherwise(F.col(f"y_{p}")).alias(p) for p in payload],
                    F.when(F.col("_x"), "exact").when(F.col("_y"), "normalized").alias("match_kind"))


def summary_left_join(rows: DataFrame, summary: DataFrame, key: str) -> DataFrame:
    """Left join where a missing summary shows as blanks."""
    cols = [c for c in summary.columns if c != key]
    return rows.join(summary, key, "left").fillna("", subset=cols)


def _substrings(c: Column) -> Column:
    """Every distinct substring of a short, non-blank text."""
    n = F.length(c)
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.substring(c, i, k)))))


def title_substring_join(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Match file stems to manifest rows by mutual containment.

    A manifest path stem contained either way wins at once (first manifest
    row); otherwise the last manifest title contained in the file stem. Names
    are short, so containment becomes an equi-join on substrings and neither
    side has to fit in memory.
    """
    m = manifest.select("m_pos", X.path_stem(F.col("local_path")).alias("m_stem"), F.col("title").alias("m_title"), F.col("url").alias("m_url")).filter("m_stem <> ''")
    parts = files.filter("stem <> ''").select("file_id", F.explode(_substrings(F.col("stem"))).alias("_s"))
    row = ["m_pos", "m_title", "m_url"]
    inside = parts.join(m, F.col("_s") == F.col("m_stem")).select("file_id", *row, F.lit(True).alias("_stem_hit"))
    around = m.select(*row, F.explode(_substrings(F.col("m_stem"))).alias("_s")).join(files.select("file_id", "stem"), F.col("_s") == F.col("stem")).select("file_id", *row, F.lit(True).alias("_stem_hit"))
    titled = parts.join(m.filter("m_title <> ''"), F.col("_s") == F.col("m_title")).select("file_id", *row, F.lit(False).alias("_stem_hit"))
    value = F.struct("m_title", "m_url")
    best = inside.unionByName(around).unionByName(titled).groupBy("file_id").agg(
        F.min_by(value, F.when(F.col("_stem_hit"), F.col("m_pos"))).alias("_stem"), F.max_by(value, F.when(~F.col("_stem_hit"), F.col("m_pos"))).alias("_title"))
    pick = F.coalesce(F.col("_stem"), F.col("_title"))
    return files.join(best, "file_id", "left").select(
        *files.columns, F.coalesce(pick["m_title"], F.lit("")).alias("source_title"), F.coalesce(pick["m_url"], F.lit("")).alias("source_url"))


# -- aggregations -------------------------------------------------------------

def sectioned_summary(df: DataFrame, sections: dict[str, str]) -> DataFrame:
    """(section, key, count) for several columns in one pass over the rows."""
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(s).alias("section"), F.col(c).cast("string").alias("key")) for s, c in sections.items()])).alias("s"))
    return stacked.groupBy("s.section", "s.key").count()


def top_reasons(df: DataFrame, category: str, reason: str, k: int = 12) -> DataFrame:
    """The ``k`` most common reasons per category; ties by reason text."""
    counts = df.groupBy(category, reason).count()
    return top_per_group(counts, [category], [F.col("count").desc(), F.col(reason)], k)


def eav_pivot(df: DataFrame, keys: list[str]) -> DataFrame:
    """Attribute rows to one item row; the last write of a role wins.

    Rows carry ``attr_name``, ``attr_value`` and ``pos``. Attributes that are
    no role are joined as ``name: value`` in row order.
    """
    n, v = F.col("attr_name"), F.col("attr_value")
    role = (F.when(n.contains("技术要求"), "requirement").when(n.contains("检测结果"), "result").when(n.contains("单项判定"), "conclusion").otherwise("other"))
    df = df.withColumn("_role", role)
    last = lambda r: F.coalesce(F.max_by(v, F.when(F.col("_role") == r, F.col("pos"))), F.lit("")).alias(r)
    other = F.array_sort(F.collect_list(F.when(F.col("_role") == "other", F.struct("pos", F.concat_ws(": ", n, v).alias("t")))))
    return df.groupBy(*keys).agg(last("requirement"), last("result"), last("conclusion"),
                                 F.array_join(F.transform(other, lambda s: s["t"]), "; ").alias("other_attrs"))


def meta_field_key(field: Column, aliases=R.META_ALIASES) -> Column:
    """Card key of a field label: first key in order with a contained alias."""
    t = F.replace(X.clean_lower(field), F.lit(" "), F.lit(""))
    return F.coalesce(*[F.when(X.contains_any(t, [a.lower().replace(" ", "") for a in words]), k) for k, words in aliases.items()])


def meta_fold(rows: DataFrame, key: str = "report_id", aliases=R.META_ALIASES, list_keys=R.LIST_META_KEYS) -> DataFrame:
    """Metadata rows (field, value, pos) to one card per report.

    Scalar keys keep the first non-blank value; list keys keep distinct values
    in first-seen order. Repeats are dropped before anything is collected.
    """
    r = rows.select(key, "pos", meta_field_key(F.col("field"), aliases).alias("k"), X.clean(F.col("value")).alias("v")).filter("k IS NOT NULL AND v <> ''")
    scalar = r.groupBy(key).agg(*[
        F.coalesce(F.min_by("v", F.when(F.col("k") == k, F.col("pos"))), F.lit("")).alias(k) for k in aliases if k not in list_keys])
    # Appending splits the list so far at ';', so every value but the last is held as its parts. A part given by a plain value
    # is kept where nothing before equals it; a value that itself holds ';' never equals a part, so its parts always stay.
    values = r.filter(F.col("k").isin(*list_keys))
    parts = values.join(values.groupBy(key, "k").agg(F.max("pos").alias("_end")), [key, "k"]).withColumn("_open", F.col("v").contains(";") & (F.col("pos") < F.col("_end")))
    split = F.filter(F.transform(F.split("v", ";"), lambda x: F.trim(x)), lambda x: x != "")
    parts = parts.select(key, "k", "pos", "_open", F.posexplode(F.when(F.col("_open"), split).otherwise(F.array("v"))).alias("_i", "v"))
    plain = parts.groupBy(key, "k", "v").agg(F.min("pos").alias("_first"), F.min(F.when(~F.col("_open"), F.col("pos"))).alias("pos")).filter("pos = _first").select(key, "k", "pos", F.lit(0).alias("_i"), "v")
    lists = plain.unionByName(parts.filter("_open").drop("_open")).groupBy(key).agg(*[
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") == k, F.struct("pos", "_i", "v")))), lambda s: s["v"]), "; ").alias(k)
        for k in list_keys])
    return scalar.join(lists, key, "left").fillna("", subset=list(list_keys))


def contained_dedup_fold(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Join values with '; ' unless already contained in the text so far."""
    uniq = rows.groupBy(*keys, "v").agg(F.min("pos").alias("pos")).filter("v <> '' AND v <> '------'")
    step = lambda a, s: F.when(a.contains(s["v"]), a).when(a == "", s["v"]).otherwise(F.concat_ws("; ", a, s["v"]))
    return uniq.groupBy(*keys).agg(F.aggregate(F.array_sort(F.collect_list(F.struct("pos", "v"))), F.lit(""), step).alias("value"))


def thermal_value_fold(params: DataFrame, key: str = "report_id") -> DataFrame:
    """First R, U and lambda per report; distinct evidence and raw texts.

    Rows without a number are ignored. Values use one pass of partial
    aggregates; texts are made distinct before they are collected.
    """
    p = params.withColumn("v", F.col("value").try_cast("double")).filter("v IS NOT NULL")
    first = lambda kind, name: F.min_by("v", F.when(F.col("parameter_type") == kind, F.col("pos"))).alias(name)
    values = p.groupBy(key).agg(first("thermal_resistance_r", "r_value_m2k_w"), first("thermal_transmittance_u", "u_wall_w_m2k"),
                                first("thermal_conductivity_lambda", "lambda_w_mk"))
    texts = p.select(key, "pos", F.explode(F.array(
        F.struct(F.lit("e").alias("kind"), X.clean(F.col("evidence")).alias("t")),
        F.struct(F.lit("r").alias("kind"), F.concat_ws(": ", "parameter_type", X.clean(F.col("raw_value"))).alias("t")))).alias("x"))
    texts = texts.select(key, "pos", "x.kind", "x.t").filter("t <> ''").groupBy(key, "kind", "t").agg(F.min("pos").alias("pos"))
    ordered = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "t")))), lambda s: s["t"]), " | ")
    joined = texts.groupBy(key).agg(ordered("e").alias("source_item_path"), ordered("r").alias("source_result"))
    return values.join(joined, key, "left")


def first_u_parameter(params: DataFrame, key: str = "report_id") -> DataFrame:
    ok = params.filter((F.col("parameter_type") == "thermal_transmittance_u") & F.col("value").try_cast("double").isNotNull())
    return keep_first(ok, [key], ["pos"])


def text_concat_per_report(rows: DataFrame, key: str = "report_id", limit_rows: int | None = None, max_chars: int | None = None) -> DataFrame:
    """Row texts joined by a space in row order.

    With a row or length limit only the rows that can still show are gathered:
    every non-blank row adds a sign and a space, so half the length suffices.
    """
    r = rows.select(key, "pos", X.clean(F.col("text")).alias("t")).filter("t <> ''")
    bound = min([b for b in (limit_rows, (max_chars + 1) // 2 if max_chars else None) if b], default=None)
    if bound:
        r = top_per_group(r, [key], ["pos"], bound).drop("rank")
    out = r.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda s: s["t"]), " ").alias("text"))
    return out.withColumn("text", F.substring("text", 1, max_chars)) if max_chars else out


def key_collisions(rows: DataFrame, key: str, principal: str) -> DataFrame:
    """Keys shared by more than one principal."""
    return rows.groupBy(key).agg(F.countDistinct(principal).alias("principals")).filter("principals > 1")


# -- sequences ----------------------------------------------------------------

def forward_fill(df: DataFrame, keys: list[str], order: str, columns: list[str], tile: Column) -> DataFrame:
    """Carry the last non-blank value of each column down the row order.

    Tiles bound the work per task: inside a tile a running ``last``, across
    tiles the last value of each earlier tile, one small row per tile.
    """
    rows = df.withColumn("_tile", tile)
    value = {c: F.nullif(F.col(c), F.lit("")) for c in columns}
    w = W.partitionBy(*keys, "_tile").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    ends = rows.groupBy(*keys, "_tile").agg(*[F.max_by(value[c], F.when(value[c].isNotNull(), F.col(order))).alias(f"_end_{c}") for c in columns])
    wt = W.partitionBy(*keys).orderBy("_tile").rowsBetween(W.unboundedPreceding, -1)
    carry = ends.select(*keys, "_tile", *[F.last(f"_end_{c}", ignorenulls=True).over(wt).alias(f"_in_{c}") for c in columns])
    filled = rows.select(*[c for c in rows.columns if c not in columns], *[F.last(value[c], ignorenulls=True).over(w).alias(c) for c in columns])
    out = filled.join(carry, [*keys, "_tile"])
    return out.withColumns({c: F.coalesce(F.col(c), F.col(f"_in_{c}"), F.lit("")) for c in columns}).select(*df.columns)


def disambiguate_names(df: DataFrame, base: str, report: str) -> DataFrame:
    """Names that occur more than once get the report id as suffix."""
    counts = df.groupBy(F.col(base).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    rid = F.element_at(F.split(F.col(report), "__"), 1)
    return df.join(counts, F.col(base) == F.col("_b")).withColumn(
        "display_name", F.when(F.col("_n") > 1, F.concat(F.col(base), F.lit("（"), rid, F.lit("）"))).otherwise(F.col(base))).drop("_b", "_n")


def allocate_unique_names(df: DataFrame, used: DataFrame, keys: list[str], base: str, order: str, tile_rows: int = 100_000, block_rows: int = 1_024) -> DataFrame:
    """Give each row ``base``, ``base1``, ``base2`` … avoiding taken names.

    The n-th row of a base takes its n-th free name, found by numbering both
    sides, so a base shared by many rows is one join and not a loop. Bases
    whose numbered names may equal another's (``A`` + 1 against ``A1``) share
    runs of names, see ``names.stretches``; a run's rows are numbered together.
    The order is unique within the keys.
    """
    from thermograph.operators.names import contested_names

    g = [*keys, "_b"]
    rows = df.withColumn("_b", F.when(X.clean(F.col(base)) == "", "未命名").otherwise(X.clean(F.col(base))))
    ranked = cut_lineage(spread_row_number(rows, g, [order], F.floor(F.col(order) / tile_rows), "_k"))
    rest = lambda n, b: F.substring(n, F.length(b) + 1, 1 << 20)
    suffix = lambda n, b: F.when(n == b, F.lit(0)).when(n.startswith(b) & rest(n, b).rlike("^[1-9][0-9]*$"), rest(n, b).try_cast("bigint"))
    sizes = ranked.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"))
    # taken names as (base, index): cut the trailing digits at every position
    cuts = lambda name: F.explode(F.transform(F.sequence(F.lit(0), F.length(F.regexp_extract(name, "([0-9]*)$", 1))),
                                              lambda i: F.substring(F.col(name), F.lit(1), F.length(name) - i)))
    names = used.select(*keys, X.clean(F.col("name")).alias("_name")).filter("_name <> ''")
    cand = names.select(*keys, "_name", cuts("_name").alias("_b"))
    cand = cand.withColumn("_i", suffix(F.col("_name"), F.col("_b"))).filter("_i IS NOT NULL")
    blocked = cut_lineage(cand.join(sizes, g, "left_semi").select(*g, "_i").distinct())
    # Only a base with several rows, or whose own name is taken, gets to numbers; a group holds all bases that are the
    # shortest such base or continue it by a number.
    numbered = sizes.filter("_n > 1").select(*g).unionByName(blocked.filter("_i = 0").select(*g)).distinct()
    reach = sizes.select(*g, "_n", cuts("_b").alias("_p")).filter((F.col("_p") == F.col("_b")) | rest(F.col("_b"), F.col("_p")).rlike("^[1-9][0-9]*$"))
    reach = reach.join(numbered.withColumnRenamed("_b", "_p"), [*keys, "_p"], "left_semi").groupBy(*g, "_n").agg(F.min_by("_p", F.length("_p")).alias("_g"))
    several = reach.groupBy(*keys, "_g").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").select(*keys, "_g")
    shared = cut_lineage(reach.join(several, [*keys, "_g"], "left_semi"))

    alone = sizes.join(shared, g, "left_anti")
    holes = blocked.groupBy(*g).agg(F.count(F.lit(1)).alias("_m"))
    slots = (alone.join(holes, g, "left").select(*g, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") + F.coalesce("_m", F.lit(0)) - 1)).alias("_i"))
             .join(blocked, [*g, "_i"], "left_anti"))
    slots = spread_row_number(slots, g, ["_i"], F.floor(F.col("_i") / tile_rows), "_k")
    named = ranked.join(slots, [*g, "_k"]).select(*df.columns, "_b", "_i")
    if not shared.isEmpty():
        run = contested_names(ranked.join(shared, g), blocked.join(shared, g), keys, order, block_rows)
        run = spread_row_number(run, [*keys, "_g", "_s"], [order], F.floor(F.col(order) / tile_rows), "_at")
        named = named.unionByName(run.select(*df.columns, "_b", (F.col("_i0") + F.col("_at") - 1).alias("_i")))
    return named.select(*df.columns, F.when(F.col("_i") == 0, F.col("_b")).otherwise(F.concat("_b", F.col("_i").cast("string"))).alias("allocated_name"))


def id_set_equal(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)


def id_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def union_sources(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
