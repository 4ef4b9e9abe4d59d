"""Ordered rule tables as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermograph.functions import rules as R
from thermograph.functions import text as X
from thermograph.functions.stages import add_columns, let, pin
from thermograph.functions.tables import sql_literal


def is_relevant(c: Column) -> Column:
    t = X.clean(c)
    return X.contains_any(t, R.RELEVANT_KEYWORDS) | X.contains_any(F.upper(t), R.RELEVANT_KEYWORDS)


def plausible_value(kind: Column, value: Column) -> Column:
    return (F.when(kind == "window_u", value.between(0.1, 10.0))
            .when(kind.isin("window_shgc", "visible_transmittance"), value.between(0.0, 1.5)).otherwise(F.lit(True)))


def classify_parameter(unit: Column, context: Column) -> Column:
    return let(X.normalize_unit(unit), lambda u: (
        F.when(F.lower(context).contains("shgc") | context.contains("太阳得热系数"), "solar_heat_gain_shgc")
        .when((u == X.LAMBDA_UNIT) | context.contains("导热系数") | context.contains("λ"), "thermal_conductivity_lambda")
        .when((u == X.R_UNIT) | context.contains("热阻") | context.rlike(r"(?iU)\bR\s*="), "thermal_resistance_r")
        .when((u == X.U_UNIT) | context.contains("传热系数") | context.contains("热传递性能"), "thermal_transmittance_u")
        .otherwise("")
    ))


def classify_component(context: Column, parameter_type: Column) -> Column:
    def by_word(t: Column) -> Column:
        any_of = lambda *words: reduce(lambda a, b: a | b, [t.contains(w) for w in words])
        return (
            F.when(any_of("太阳得热系数") | F.upper(t).contains("SHGC"), "window_shgc")
            .when(any_of("气密"), "window_air_tightness")
            .when(any_of("窗", "幕墙", "玻璃"), "window_u")
            .when(any_of("门"), "door_u")
            .when(any_of("屋面", "屋顶"), "roof_u")
            .when(any_of("地面", "土壤", "架空"), "floor_contact_type")
            .when(any_of("楼板"), "floor_u")
            .when(any_of("外保温", "墙体保温", "保温系统"), "wall_insulation")
            .when(any_of("外墙", "墙"), "exterior_wall")
            .when(parameter_type == "thermal_conductivity_lambda", "wall_insulation")
            .otherwise("exterior_wall")
        )

    return let(X.clean(context), by_word)


def dump_parameter_type(c: Column) -> Column:
    """Parameter type of a dump row; Latin words are matched upper-cased."""
    upper = F.upper(c)
    tests = [F.when(reduce(lambda a, b: a | b, [(upper if w.isascii() else c).contains(w) for w in words]), kind)
             for kind, words in R.DUMP_PARAMETER_RULES]
    return F.coalesce(*tests, F.lit("supporting_property"))


def recommended_use(sample_name: Column, item_text: Column, kind: Column) -> Column:
    t = F.concat_ws(" ", sample_name, item_text)
    any_of = lambda *w: X.contains_any(t, w)
    return (
        F.when(any_of("窗", "玻璃", "幕墙"), "window_system")
        .when(any_of("屋面"), "roof_assembly")
        .when(any_of("空调", "热泵", "锅炉") | kind.isin("cop", "eer"), "equipment")
        .when(any_of("外墙", "墙体", "保温系统") | kind.isin("thermal_resistance_r", "u_value"), "wall_assembly")
        .when(any_of("保温", "聚苯", "聚氨酯", "岩棉"), "material")
        .otherwise("review")
    )


def focused_parameter_match(context: Column, category: Column) -> Column:
    """struct(parameter_type, parameter_name, default_unit) or null.

    Patterns are tried in order among the types allowed for the category; an
    unknown category allows all of them.
    """
    t = X.clean_lower(context)
    known = category.isin(*R.CATEGORY_PARAMETER_TYPES)
    tests = []
    for kind, words, unit in R.FOCUSED_PATTERNS:
        cats = [c for c, kinds in R.CATEGORY_PARAMETER_TYPES.items() if kind in kinds]
        allowed = ~F.coalesce(known, F.lit(False)) | category.isin(*cats)
        word = X.first_contained(t, words)
        tests.append(F.when(allowed & word.isNotNull(), F.struct(
            F.lit(kind).alias("parameter_type"), word.alias("parameter_name"), F.lit(unit).alias("default_unit"))))
    return F.coalesce(*tests)


def parameter_action(kind: Column, context: Column) -> Column:
    dims = kind.isin("dimension", "thickness")
    return (
        F.when(X.contains_any(context, ("经纬密度", "断裂伸长率")), "reject")
        .when((kind == "density") & X.contains_any(context, R.DENSITY_REJECT_CONTEXT), "reject")
        .when(dims & X.contains_any(context, R.DIMENSION_CHECK_CONTEXT), "needs_check")
        .when(dims & X.contains_any(context, ("尺寸偏差", "公差")), "needs_check")
        .when(F.coalesce(kind, F.lit("")) == "", "reject")
        .otherwise("keep")
    )


def item_parameter_type(c: Column) -> Column:
    """struct(parameter_type, default_unit) for a wall-report row, or null."""
    t = X.clean_lower(c)
    return F.coalesce(*[F.when(X.contains_any(t, words), F.struct(
        F.lit(kind).alias("parameter_type"), F.lit(unit).alias("default_unit"))) for kind, words, unit in R.WALL_ITEM_RULES])


def window_parameter(c: Column) -> Column:
    """struct(parameter_type, label, value, unit): first plausible number."""
    t = X.clean_lower(c)
    tests = []
    for kind, label, words, unit in R.WINDOW_PARAMETERS:
        for w in words:
            v = X.number_after_keyword(c, w)
            tests.append(F.when(t.contains(w.lower()) & v.isNotNull() & plausible_value(F.lit(kind), v), F.struct(
                F.lit(kind).alias("parameter_type"), F.lit(label).alias("label"), v.alias("value"), F.lit(unit).alias("unit"))))
    return F.coalesce(*tests)


def window_candidate(c: Column) -> Column:
    """struct(keep, reason); the first denied word in list order is named."""
    t = X.clean(c)
    low = F.lower(t)
    deny = X.first_contained(low, R.WINDOW_DENY)
    keep = lambda flag, reason: F.struct(F.lit(flag).alias("keep"), reason.alias("reason"))
    return (
        F.when(deny.isNotNull(), keep(False, F.concat(F.lit("non_window_keyword:"), deny)))
        .when(t.contains("型材") & t.contains("传热系数"), keep(True, F.lit("window_profile_u_value")))
        .when(X.contains_any(low, [w.lower() for w in R.WINDOW_ALLOW]), keep(True, F.lit("window_evidence")))
        .otherwise(keep(False, F.lit("no_structured_window_evidence")))
    )


def refined_window(c: Column) -> Column:
    """struct(keep, reason) of the window refinement."""
    t = X.clean(c)
    drop = X.contains_any(t, R.REFINE_DROP)
    out = lambda flag, reason: F.struct(F.lit(flag).alias("keep"), F.lit(reason).alias("reason"))
    return (
        F.when(~X.contains_any(t, R.REFINE_KEEP), out(False, "no_window_keyword"))
        .when(drop & ~X.contains_any(t, R.REFINE_OVERRIDE), out(False, "insulation_only_keyword"))
        .when(drop & X.contains_any(t, R.REFINE_HARD_DROP), out(False, "wall_insulation_evidence"))
        .otherwise(out(True, "refined_window_keyword"))
    )


def priority_score(c: Column) -> Column:
    """struct(score, hits) over the weighted keyword table."""
    t = F.lower(X.clean(c))
    score = reduce(lambda a, b: a + b, [F.when(t.contains(k.lower()), w).otherwise(0) for k, w in R.PRIORITY_WEIGHTS])
    return F.struct(score.alias("score"), X.hit_list(t, [k for k, _ in R.PRIORITY_WEIGHTS], ";").alias("hits"))


def refine_windows(df: DataFrame, evidence: str = "evidence") -> DataFrame:
    """Adds keep flag, reason, score, hits and the glass flag; callers filter."""
    c = F.col(evidence)
    return (df.withColumn("_r", refined_window(c)).withColumn("_p", priority_score(c))
            .withColumns({"keep": F.col("_r.keep"), "refine_reason": F.col("_r.reason"), "priority_score": F.col("_p.score"),
                          "priority_reason": F.col("_p.hits"), "glass_priority": F.col("_r.keep") & X.contains_any(X.clean(c), R.GLASS_WORDS)})
            .drop("_r", "_p"))


def material_category(c: Column) -> Column:
    any_of = lambda *w: X.contains_any(c, w)
    return (F.when(any_of("玻璃", "窗"), "window_material").when(any_of("屋面"), "roof_material")
            .when(any_of("保温", "聚苯", "聚氨酯", "岩棉"), "insulation").otherwise("material"))


def software_material_category(name: Column) -> Column:
    """struct(category, database) of a software material row."""
    out = lambda a, b: F.struct(F.lit(a).alias("category"), F.lit(b).alias("database"))
    return (F.when(name.contains("预制夹心剪力墙"), out("exterior_wall", "exterior_wall.db"))
            .when(name.contains("屋面"), out("roof_u", "roof.db")).otherwise(out("wall_insulation", "wall_insulation.db")))


def score_source(df: DataFrame, title: str = "title", url: str = "url", snippet: str = "snippet",
                 trusted=X.TRUSTED_SUFFIXES) -> DataFrame:
    """Confidence, hints, notes and status of a web source."""
    df = pin(df, url_resolved=X.unwrap_redirect_url(F.col(url)))
    u = F.col("url_resolved")
    t = X.clean(X.html_unescape(F.col(title)))
    df = df.withColumn("title_clean", F.when(t == "", X.clean(F.col(url))).otherwise(t))
    df = df.withColumn("_text", F.concat_ws(" ", F.col("title_clean"), u, X.clean(X.html_unescape(F.col(snippet)))))
    text, low = F.col("_text"), F.lower("_text")
    ok = F.coalesce(X.trusted_domain(u, trusted), F.lit(False))
    points = reduce(lambda a, b: a + b, [F.when(low.contains(w.lower()), s).otherwise(0) for w, _, s in R.SOURCE_TERMS])
    hints = lambda rows, t: F.array_distinct(F.filter(F.array(*[F.when(t(r[0]), r[1]) for r in rows]), lambda h: h.isNotNull()))
    params = hints(R.SOURCE_TERMS, lambda w: low.contains(w.lower()))
    comps = hints(R.SOURCE_COMPONENTS, lambda w: text.contains(w))
    catalog = text.contains("参数目录")
    kind = X.infer_source_type(u)
    df = pin(df, source_type=kind, _params=params, _comps=comps, _ok=ok, _points=points)
    conf = F.least(F.lit(100), F.lit(20) + F.col("_points") + F.size("_comps") * 8 + F.when(catalog, 18).otherwise(0)
                   + F.when(F.col("source_type") == "pdf", 10).otherwise(0))
    notes = F.concat_ws("; ", F.lit("trusted domain"), *[F.when(low.contains(w.lower()), f"matched {w}") for w, _, _ in R.SOURCE_TERMS],
                        F.when(catalog, "matched catalog"), F.when(F.col("source_type") == "pdf", "pdf"))
    df = df.withColumns({
        "confidence": F.when(F.col("_ok"), conf).otherwise(0),
        "component_hint": F.when(F.col("_ok"), F.array_join("_comps", ";")).otherwise(""),
        "parameter_hint": F.when(F.col("_ok"), F.array_join("_params", ";")).otherwise(""),
        "notes": F.when(F.col("_ok"), notes).otherwise("untrusted domain"),
    })
    return df.withColumn("review_status", F.when(~F.col("_ok"), "reject").when(
        (F.col("confidence") >= 40) & (F.col("parameter_hint") != ""), "pending").otherwise("needs_check")).drop(
        "_text", "_params", "_comps", "_ok", "_points")


def relevant_seed_link(df: DataFrame) -> Column:
    return ((F.col("source_type").isin("pdf", "docx", "spreadsheet") & (F.col("confidence") >= 40))
            | ((F.col("parameter_hint") != "") & (F.col("confidence") >= 60)))


def attachment_link(url: Column, text: Column) -> Column:
    p = X.url_path_lower(url)
    return (F.when(X.ends_with_any(p, (".jpg", ".jpeg", ".png")), p.contains("uploadfiles"))
            .when(X.ends_with_any(p, (".xls", ".xlsx", ".pdf", ".doc", ".docx")), True)
            .otherwise(text.contains("附件") & (text.contains("公示名单") | text.contains("建筑节能"))))


def publicity_title(c: Column) -> Column:
    t = F.replace(X.clean(c), F.lit(" "), F.lit(""))
    return t.contains("建筑节能材料") & t.contains("公示名单") & t.contains("公布")


def relevant_attachment(title: Column, url: Column) -> Column:
    return F.lower(url).endswith(".pdf") & X.contains_any(
        F.concat_ws(" ", title, url), ("热工参数目录", "门窗幕墙", "传热系数", "太阳得热系数"))


def product_row_status(df: DataFrame) -> DataFrame:
    """What became of a product-list source, from its parsed row count."""
    n = F.coalesce("row_count", F.lit(0))
    st, title = F.col("source_type"), F.col("title")
    notice = st == "official_product_notice_html"
    return df.withColumn("product_row_status", (
        F.when(n > 0, F.concat(F.lit("parsed_product_rows:"), n.cast("string")))
        .when(st == "official_product_list_image", "needs_ocr_image")
        .when(st == "official_product_list_pdf", "needs_ocr_pdf_or_render")
        .when(notice & title.contains("岳阳"), "notice_has_embedded_images_or_pdf")
        .when(notice & title.contains("衡阳"), "notice_page_collected_needs_manual_or_ocr_check")
        .when(X.clean(F.col("review_status")) == "fetch_failed", "fetch_failed")
        .otherwise("source_collected_no_direct_rows")))


# -- report-level classifiers ------------------------------------------------

def fine_classify(df: DataFrame) -> DataFrame:
    """Fine category, confidence and reason of a report row.

    Needs hint, source_group, content_category, matched_keywords,
    has_evidence and structure_type. Pure projection.
    """
    hint, low = F.col("hint"), F.lower(X.clean(F.col("hint")))
    group, coarse = X.clean(F.col("source_group")), X.clean(F.col("content_category"))
    scored = [c for c in R.FINE_KEYWORDS if c not in ("hvac_system", "lighting")]
    df = df.withColumns({f"score_{c}": X.hit_count(low, R.FINE_KEYWORDS[c]) for c in scored})
    s = lambda c: F.col(f"score_{c}")
    out = lambda cat, reason: F.struct(F.lit(cat).alias("c"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("r"))
    pick = (
        F.when(X.contains_any(hint, R.FINE_EXCLUDE), out("not_relevant", "excluded_equipment_keyword"))
        .when((coarse == "hvac") | (group == "useful/hvac"), out("hvac_system", "coarse_hvac"))
        .when((coarse == "lighting") | (group == "useful/lighting"), out("lighting", "coarse_lighting"))
        .when((coarse != "") & ~coarse.isin("envelope", "unknown"), out("not_relevant", F.concat(F.lit("coarse_"), coarse)))
        .when(s("curtain_shading") > 0, out("curtain_shading", "shading_keyword"))
        .when(X.contains_any(hint, R.FINE_WINDOW_PRIORITY), out("windows", "window_priority_keyword"))
        .when((s("windows") >= 2) | ((s("windows") >= 1) & (s("wall_insulation") == 0) & (s("roof") == 0)), out("windows", "window_keyword"))
        .when(s("roof") > 0, out("roof", "roof_keyword"))
        .when(s("floor") > 0, out("floor", "floor_keyword"))
        .when(s("wall_insulation") > 0, out("wall_insulation", "insulation_keyword"))
        .when(s("exterior_wall") > 0, out("exterior_wall", "wall_keyword"))
        .otherwise(out("needs_review", "no_fine_keyword"))
    )
    df = df.withColumn("_pick", pick)
    low_conf = F.col("_pick.c").isin("needs_review", "not_relevant")
    named_only = (X.clean(F.col("matched_keywords")) == "") & ~F.col("has_evidence")
    weak = X.clean(F.col("structure_type")) == "TABLE_WEAK"
    return df.withColumns({
        "fine_category": F.col("_pick.c"),
        "confidence": F.when(low_conf, "low").when(named_only | weak, "medium").otherwise("high"),
        "review_reason": F.when(~low_conf & named_only, F.concat("_pick.r", F.lit(";filename_or_group_only")))
        .when(~low_conf & weak, F.concat("_pick.r", F.lit(";table_weak"))).otherwise(F.col("_pick.r")),
    }).drop("_pick", *[f"score_{c}" for c in scored])


HIT_WORDS = list(dict.fromkeys([w for ws in R.HIT_KEYWORDS.values() for w in ws] + [w for ws in R.HIT_CONTEXT.values() for w in ws]))
_BIT = {w: divmod(i, 62) for i, w in enumerate(HIT_WORDS)}
MASK_WORDS = (len(HIT_WORDS) + 61) // 62


def keyword_masks(text: Column, prefix: str) -> dict[str, Column]:
    """Bit masks of the keywords that occur in a cleaned, lower-cased text.

    A report's masks are the OR over its rows, so rows combine map-side and
    no report's text is ever gathered in one place.
    """
    t, out = text, {}
    for m in range(MASK_WORDS):
        # a constant array keeps the plan small: some 60 tests, one expression
        words = F.expr("array(" + ", ".join(f"named_struct('w', {sql_literal(w.lower())}, 'b', {1 << b}L)" for w, (k, b) in _BIT.items() if k == m) + ")")
        out[f"{prefix}{m}"] = F.aggregate(words, F.lit(0).cast("bigint"), lambda a, e: F.when(t.contains(e["w"]), a.bitwiseOR(e["b"])).otherwise(a))
    return out


def report_keyword_masks(rows: DataFrame, key: str, text: str, prefix: str) -> DataFrame:
    # clean in its own projection: the mask lambdas read the text many times
    rows = rows.select(key, X.clean_lower(F.col(text)).alias("_t"))
    masks = rows.select(key, *[c.alias(n) for n, c in keyword_masks(F.col("_t"), prefix).items()])
    return masks.groupBy(key).agg(*[F.bit_or(f"{prefix}{m}").alias(f"{prefix}{m}") for m in range(MASK_WORDS)])


def _lit_mask(words, m: int) -> int:
    return sum(1 << b for k, b in {_BIT[w] for w in words} if k == m)


def _hits_sql(prefix: str, words) -> str:
    """SQL: how many of the words a zone's masks contain."""
    return " + ".join(f"bit_count({prefix}{m} & {_lit_mask(words, m)}L)" for m in range(MASK_WORDS) if _lit_mask(words, m))


def thermal_hit_classify(cards: DataFrame, items: DataFrame, params: DataFrame, key: str = "report_id") -> DataFrame:
    """Category, confidence and reason from keyword scores over three zones.

    Zone weights: card text 5, item rows 2, parameter rows 3. ``cards`` has
    ``card_text``; ``items`` and ``params`` have ``text``, many rows a report.
    Scores are adjusted block by block in a fixed order; ``dead_*`` flags mark
    categories whose hits are withdrawn.
    """
    df = cards.withColumn("_t", X.clean_lower(F.col("card_text"))).withColumns(keyword_masks(F.col("_t"), "hc"))
    df = (df.join(report_keyword_masks(items, key, "text", "hi"), key, "left")
          .join(report_keyword_masks(params, key, "text", "hp"), key, "left").na.fill(0, [f"{p}{m}" for p in ("hi", "hp") for m in range(MASK_WORDS)]))
    cats, first = R.HIT_PRIORITY, {}
    first.update({f"ha{m}": f"hc{m} | hi{m} | hp{m}" for m in range(MASK_WORDS)})
    first.update({f"s0_{c}": f"({_hits_sql('hc', ws)}) * 5 + ({_hits_sql('hi', ws)}) * 2 + ({_hits_sql('hp', ws)}) * 3" for c, ws in R.HIT_KEYWORDS.items()})
    first.update({f"x_{n}": f"({_hits_sql('ha', ws)}) > 0" for n, ws in R.HIT_CONTEXT.items()})
    df = add_columns(df, first)
    version = dict.fromkeys(cats, 0)
    dead: dict[str, list[str]] = {c: [] for c in cats}
    steps: dict[str, str] = {}

    def s(cat):
        return f"s{version[cat]}_{cat}"

    def change(cat, cond, value):
        old = s(cat)
        version[cat] += 1
        steps[s(cat)] = f"CASE WHEN {cond} THEN {value} ELSE {old} END"

    def withdraw(cat, cond):
        flag = f"w{version[cat]}_{cat}"
        steps[flag] = cond
        dead[cat].append(flag)
        change(cat, flag, "0")

    withdraw("door_u", f"x_door_window AND {s('door_u')} <= {s('window_u')}")
    steps["thermal_window"] = f"x_thermal AND {s('window_u')} > 0"
    change("window_u", "thermal_window", f"{s('window_u')} + 5")
    withdraw("window_air_tightness", f"thermal_window AND {s('window_air_tightness')} > 0")
    withdraw("curtain_shading", f"thermal_window AND {s('curtain_shading')} > 0 AND {s('window_shgc')} = 0")
    steps["thermal_door"] = f"x_thermal AND {s('door_u')} > 0"
    change("door_u", "thermal_door", f"{s('door_u')} + 5")
    withdraw("window_air_tightness", f"thermal_door AND {s('window_air_tightness')} > 0")
    withdraw("curtain_shading", f"thermal_door AND {s('curtain_shading')} > 0")
    withdraw("curtain_shading", f"NOT x_shading_product AND {s('curtain_shading')} > 0")
    steps["insulated"] = f"x_insulation_system AND {s('wall_insulation')} > 0"
    change("wall_insulation", "insulated", f"{s('wall_insulation')} + 8")
    change("exterior_wall", f"insulated AND {s('exterior_wall')} > 0", f"least({s('exterior_wall')}, {s('wall_insulation')} - 3)")
    for cat in ("window_u", "roof_u", "floor_u", "exterior_wall"):
        change(cat, f"x_u_words AND {s(cat)} > 0", f"{s(cat)} + 2")
    scores = ", ".join(s(c) for c in cats)
    steps.update({
        "best": f"greatest({scores})",
        "second": f"element_at(sort_array(array({scores}), false), 2)",
        "top": "CASE WHEN best > 0 THEN CASE " + " ".join(f"WHEN {s(c)} = best THEN '{c}'" for c in cats) + " END END",
        "fine_category": "CASE WHEN x_not_envelope OR x_non_building THEN 'needs_review' WHEN x_daylighting THEN 'window_u' ELSE coalesce(top, 'needs_review') END",
        "confidence": "CASE WHEN x_not_envelope OR x_non_building THEN 'low' WHEN x_daylighting THEN 'high' WHEN top IS NULL THEN 'low' "
        "WHEN second <> 0 AND best - second <= 1 THEN 'low' WHEN best >= 8 AND best - second >= 2 THEN 'high' WHEN best >= 5 THEN 'medium' ELSE 'low' END",
        "review_reason": "CASE WHEN x_not_envelope THEN 'not_envelope_parameter' WHEN x_non_building THEN 'non_building_product' "
        "WHEN x_daylighting THEN 'daylighting_system_u_value' WHEN top IS NULL THEN 'no_category_keyword' "
        "WHEN second <> 0 AND best - second <= 1 THEN 'ambiguous_close_scores' WHEN best >= 8 AND best - second >= 2 THEN 'keyword_score_high' "
        "WHEN best >= 5 THEN 'keyword_score_medium' ELSE 'weak_keyword_match' END",
        "matched_keywords": "CASE WHEN x_not_envelope OR x_non_building THEN '' WHEN x_daylighting THEN 'window_u:采光系统' "
        f"WHEN top IS NULL THEN '' ELSE {_matched_sql(dead)} END",
        "target_database": "CASE fine_category " + " ".join(f"WHEN '{k}' THEN '{d}'" for k, (d, _) in R.HIT_DATABASES.items()) + " END",
        "target_table": "CASE fine_category " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, (_, t) in R.HIT_DATABASES.items()) + " END",
    })
    return add_columns(df, steps).select(
        *cards.columns, "fine_category", "target_database", "target_table", "confidence", "review_reason", "matched_keywords")


def _matched_sql(dead: dict[str, list[str]]) -> str:
    """SQL: 'category:word|word' groups in order of first hit over the zones."""
    zones, groups = ("hc", "hi", "hp"), []
    for i, (cat, words) in enumerate(R.HIT_KEYWORDS.items()):
        table = "array(" + ", ".join(f"named_struct('w', {sql_literal(w)}, 'k', {_BIT[w][0]}, 'b', {1 << _BIT[w][1]}L)" for w in words) + ")"
        mask = lambda p: "CASE e.k " + " ".join(f"WHEN {m} THEN {p}{m}" for m in range(MASK_WORDS)) + " END"
        lists = []
        for z, p in enumerate(zones):
            seen = "".join(f" AND ({mask(q)}) & e.b = 0" for q in zones[:z])
            lists.append(f"transform(filter({table}, e -> ({mask(p)}) & e.b <> 0{seen}), e -> e.w)")
        text = f"array_join(concat({', '.join(lists)}), '|')"
        zone = f"CASE WHEN {_hits_sql('hc', words)} > 0 THEN 0 WHEN {_hits_sql('hi', words)} > 0 THEN 1 ELSE 2 END"
        alive = "".join(f" AND NOT {f}" for f in dead[cat])
        groups.append(f"CASE WHEN ({_hits_sql('ha', words)}) > 0{alive} THEN named_struct('o', ({zone}) * 100 + {i}, 't', concat('{cat}:', {text})) END")
    return f"array_join(transform(array_sort(array_compact(array({', '.join(groups)}))), g -> g.t), '; ')"
