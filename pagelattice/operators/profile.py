"""Page types, confidences, conversion policies and document roll-ups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice.functions.geometry import clamp_ratio
from pagelattice.functions.numbers import orientation

VISUAL_TYPES = ("designed_cover", "magazine", "image_dominant")
#: Recommended mode of each page type.
MODES = {
    "simple_text": "editable", "multi_column": "hybrid", "designed_cover": "hybrid", "table_dominant": "hybrid", "chart_dominant": "hybrid", "form": "hybrid",
    "image_dominant": "fixed", "scanned": "ocr", "magazine": "hybrid", "mixed": "hybrid", "unknown": "hybrid"}
FLAGS = ("text", "lists", "tables", "forms", "images", "vectors", "charts", "run_ocr", "full_page_image", "region_fallback")
# The outputs of each page type: on, off, or as a fact about the page is.
POLICIES = {
    "simple_text": {"text": True, "lists": True, "tables": True, "forms": False, "images": True, "vectors": "has_vectors", "charts": True, "run_ocr": False, "full_page_image": False, "region_fallback": True},
    "multi_column": {"text": True, "lists": True, "tables": True, "forms": False, "images": True, "vectors": "has_vectors", "charts": True, "run_ocr": False, "full_page_image": False, "region_fallback": True},
    "designed_cover": {"text": "has_text", "lists": True, "tables": True, "forms": False, "images": True, "vectors": True, "charts": True, "run_ocr": False, "full_page_image": False, "region_fallback": True},
    "table_dominant": {"text": True, "lists": True, "tables": True, "forms": False, "images": True, "vectors": "has_vectors", "charts": True, "run_ocr": False, "full_page_image": False, "region_fallback": True},
    "chart_dominant": {"text": True, "lists": True, "tables": True, "forms": False, "images": True, "vectors": True, "charts": True, "run_ocr": False, "full_page_image": False, "region_fallback": True},
    "form": {"text": True, "lists": True, "tables": True, "forms": True, "images": True, "vectors": True, "charts": True, "run_ocr": False, "full_page_image": False, "region_fallback": True},
    "image_dominant": {"text": False, "lists": False, "tables": False, "forms": False, "images": True, "vectors": True, "charts": True, "run_ocr": False, "full_page_image": True, "region_fallback": False},
    "scanned": {"text": True, "lists": False, "tables": False, "forms": False, "images": True, "vectors": False, "charts": False, "run_ocr": True, "full_page_image": True, "region_fallback": False},
    "magazine": {"text": True, "lists": True, "tables": True, "forms": False, "images": True, "vectors": True, "charts": True, "run_ocr": False, "full_page_image": False, "region_fallback": True},
    "mixed": {"text": "has_text", "lists": "has_text", "tables": "has_tables", "forms": "has_forms", "images": True, "vectors": "has_vectors", "charts": "has_charts", "run_ocr": False, "full_page_image": False, "region_fallback": True},
    "unknown": {"text": "has_text", "lists": "has_text", "tables": "has_tables", "forms": "has_forms", "images": True, "vectors": "has_vectors", "charts": "has_charts", "run_ocr": False, "full_page_image": "only_visual", "region_fallback": "not_only_visual"},
}


def _c(name: str) -> Column:
    return F.col(name)


def is_designed_cover() -> Column:
    sparse, largest, median = _c("paragraph_count") <= 4, _c("max_font_size"), _c("median_font_size")
    visual = F.least(_c("image_coverage") + _c("vector_coverage"), F.lit(1.0)) >= 0.12
    ratio = F.when(median > 0, largest / F.nullif(median, F.lit(0.0))).otherwise(F.lit(0.0))
    prominent = (largest >= 24.0) & (ratio >= F.when(sparse, 1.25).otherwise(1.8))
    huge = sparse & (largest >= 36.0)
    plain = sparse & (_c("text_coverage") <= 0.08) & (largest >= 36.0) & ((median <= 0) | (ratio >= 1.5))
    return _c("has_text") & (_c("text_coverage") <= 0.18) & (_c("paragraph_count") <= 12) & ((visual & (prominent | huge)) | plain)


def page_type() -> Column:
    """Ladder of page types over the columns of a page's measures; the first that holds."""
    kinds = [(_c("image_coverage") >= 0.2), (_c("vector_coverage") >= 0.15), (_c("table_coverage") >= 0.15), (_c("chart_coverage") >= 0.1)]
    major = reduce(lambda a, b: a + b, [k.cast("int") for k in kinds])
    return (
        F.when(_c("form_field_count") > 0, "form")
        .when(_c("requires_ocr"), "scanned")
        .when(is_designed_cover(), "designed_cover")
        .when((_c("table_count") > 0) & ((_c("table_coverage") >= 0.3) | (_c("table_coverage") >= F.greatest(_c("text_coverage"), F.lit(0.18)))), "table_dominant")
        .when((_c("chart_count") > 0) & ((_c("chart_coverage") >= 0.12) | (_c("chart_coverage") >= _c("text_coverage"))), "chart_dominant")
        .when((_c("column_count") >= 2) & (_c("image_coverage") + _c("vector_coverage") >= 0.18) & (_c("text_coverage") > 0.02), "magazine")
        .when((_c("image_coverage") >= 0.6) & (_c("text_coverage") < 0.12), "image_dominant")
        .when(_c("column_count") >= 2, "multi_column")
        .when(_c("has_text") & (major >= 2), "mixed")
        .when(_c("has_text"), "simple_text")
        .when((_c("image_count") > 0) | (_c("vector_count") > 0), "image_dominant")
        .otherwise("unknown"))


def profiles(pages: DataFrame) -> DataFrame:
    """pages of measures with page_type, four confidences, recommended mode and reasons.

    Measures: five coverages, counts, has_text, font sizes, column_count. requires_ocr is derived.
    """
    ocr = ~_c("has_text") & (_c("image_count") > 0) & (_c("image_coverage") >= 0.5)
    p = pages.withColumn("requires_ocr", ocr).withColumn("page_type", page_type())
    image, vector, kind = _c("image_coverage"), _c("vector_coverage"), _c("page_type")
    flag = lambda cond, value: F.when(cond, F.lit(value)).otherwise(F.lit(0.0))
    editable = F.lit(0.15) + flag(_c("has_text"), 0.25) + F.least(_c("text_coverage") * 1.5, F.lit(0.4)) - F.least(image * 0.4, F.lit(0.3)) - F.least(vector * 0.2, F.lit(0.2))
    editable = editable - flag(_c("column_count") >= 2, 0.1) - flag(kind.isin(*VISUAL_TYPES, "scanned"), 0.2)
    editable = F.when(_c("requires_ocr"), F.lit(0.05)).otherwise(editable)
    fixed = F.lit(0.15) + F.least(image * 0.7, F.lit(0.5)) + F.least(vector * 0.6, F.lit(0.4)) + flag(kind.isin(*VISUAL_TYPES), 0.2) + flag(_c("requires_ocr"), 0.15)
    p = p.withColumns({"_e": editable, "_f": fixed})
    bonus = flag(_c("table_count") > 0, 0.1) + flag(_c("chart_count") > 0, 0.15) + flag(_c("column_count") >= 2, 0.1) + flag(_c("form_field_count") > 0, 0.15)
    hybrid = F.greatest("_e", "_f") * 0.7 + F.least("_e", "_f") * 0.3 + bonus
    by_ocr = F.when(_c("requires_ocr"), F.greatest(F.lit(0.85), image)).when(~_c("has_text") & (_c("image_count") > 0), F.least(image, F.lit(0.75))).otherwise(F.lit(0.0))
    mode = F.create_map(*[F.lit(x) for kv in MODES.items() for x in kv])[kind]
    share = lambda what, c: F.format_string(f"{what} coverage: %.3f.", c)
    reasons = F.array_compact(F.array(
        F.format_string("Page classified as %s.", kind), share("Text", _c("text_coverage")), share("Image", image), share("Vector", vector),
        F.when(_c("table_count") > 0, F.format_string("Detected %d table region(s).", _c("table_count"))), F.when(_c("chart_count") > 0, F.format_string("Detected %d chart region(s).", _c("chart_count"))),
        F.when(_c("column_count") >= 2, F.format_string("Detected %d content columns.", _c("column_count")))))
    return p.withColumns({"editable_confidence": clamp_ratio(_c("_e")), "fixed_confidence": clamp_ratio(_c("_f")), "hybrid_confidence": clamp_ratio(hybrid), "ocr_confidence": clamp_ratio(by_ocr), "recommended_mode": mode, "reasons": reasons}).drop("_e", "_f")


def policies(profiles_: DataFrame) -> DataFrame:
    """profiles with mode, one flag per kind of output (export_*), policy confidence and warnings.

    The rule table of page types is joined as a map literal; then flags of absent content go off
    and low confidences move the mode.
    """
    facts = {True: F.lit(True), False: F.lit(False), "has_text": _c("has_text"), "has_vectors": _c("vector_count") > 0, "has_tables": _c("table_count") > 0, "has_forms": _c("form_field_count") > 0, "has_charts": _c("chart_count") > 0}
    facts["only_visual"] = ~_c("has_text") & ((_c("image_count") > 0) | (_c("vector_count") > 0))
    facts["not_only_visual"] = ~facts["only_visual"]
    p, kind = profiles_, _c("page_type")
    on = {f: reduce(lambda acc, k: acc.when(kind == k, facts[POLICIES[k][f]]), POLICIES, F.when(F.lit(False), F.lit(False))).otherwise(F.lit(False)) for f in FLAGS}  # noqa: B023
    has = _c("has_text") | on["run_ocr"]
    on["text"], on["lists"] = on["text"] & has, on["lists"] & has
    on["tables"] = on["tables"] & ((_c("table_count") > 0) | (kind == "table_dominant"))
    on["forms"] = on["forms"] & ((_c("form_field_count") > 0) | (kind == "form"))
    on["charts"] = on["charts"] & ((_c("chart_count") > 0) | (kind == "chart_dominant"))
    on["vectors"] = on["vectors"] & (_c("vector_count") > 0)
    low = (_c("recommended_mode") == "editable") & (_c("editable_confidence") < 0.55)
    p = p.withColumns({f"export_{k}": c for k, c in on.items()}).withColumn("mode", F.when(low, "hybrid").otherwise(_c("recommended_mode")))
    p = p.withColumn("export_full_page_image", _c("export_full_page_image") | ((_c("mode") == "ocr") & (_c("ocr_confidence") < 0.5)))
    confidence = F.when(_c("mode") == "editable", _c("editable_confidence")).when(_c("mode") == "fixed", _c("fixed_confidence")).when(_c("mode") == "ocr", _c("ocr_confidence")).otherwise(_c("hybrid_confidence"))
    warnings = F.array_compact(F.array(
        F.when(low, F.lit("editable_downgraded")), F.when((_c("mode") == "hybrid") & (_c("hybrid_confidence") < 0.4), F.lit("hybrid_low")), F.when((_c("mode") == "ocr") & (_c("ocr_confidence") < 0.5), F.lit("ocr_low"))))
    return p.withColumns({"policy_confidence": clamp_ratio(confidence), "policy_warnings": warnings})


def documents(pages: DataFrame, key: str) -> DataFrame:
    """One row per document: counts of page types and modes, dominant type, mode, mean confidences.

    The dominant type is the only most frequent one, else mixed. Two aggregations, per type and
    mode and then per document, both combined before their shuffle.
    """
    types = pages.groupBy(key, "page_type").agg(F.count("*").alias("n"))
    types = types.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page_type", "n"))).alias("types"))
    most = F.array_max(F.transform("types", lambda t: t["n"]))
    best = F.filter("types", lambda t: t["n"] == most)
    dominant = F.when(F.size(best) == 1, best[0]["page_type"]).otherwise("mixed")
    rest = pages.groupBy(key).agg(
        F.count("*").alias("page_count"), F.array_sort(F.collect_set("mode")).alias("modes"), F.bool_or(_c("has_text")).alias("has_text"), F.bool_or(_c("requires_ocr")).alias("requires_ocr"),
        F.bool_or(_c("table_count") > 0).alias("has_tables"), F.bool_or(_c("chart_count") > 0).alias("has_charts"), F.count_if(_c("column_count") >= 2).alias("multi_column_pages"),
        F.avg("editable_confidence").alias("editable_confidence"), F.avg("fixed_confidence").alias("fixed_confidence"), F.avg("hybrid_confidence").alias("hybrid_confidence"), F.avg("ocr_confidence").alias("ocr_confidence"),
        F.count_distinct(orientation(_c("page_width"), _c("page_height"))).alias("orientations"))
    mode = F.when(F.size("modes") == 1, F.col("modes")[0]).otherwise("hybrid")
    return rest.join(types, key).select(
        key, "page_count", F.array_join(F.transform("types", lambda t: F.concat_ws("=", t["page_type"], t["n"].cast("string"))), ",").alias("type_counts"), dominant.alias("dominant_type"), mode.alias("mode"),
        "has_text", "requires_ocr", "has_tables", "has_charts", "multi_column_pages", "editable_confidence", "fixed_confidence", "hybrid_confidence", "ocr_confidence",
        ((F.size("modes") > 1) | (mode == "hybrid")).alias("requires_hybrid"), (F.col("orientations") > 1).alias("mixed_orientation"))
