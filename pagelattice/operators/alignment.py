"""Paragraph alignment against a reference box, its validation, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.functions.geometry import Box, area, intersection_area

MINIMUM_CONFIDENCE = 0.55
#: Rank of a region's type as a reference; smaller ranks win, then smaller areas.
PRIORITY = {"header": 0, "footer": 0, "column": 1, "page_body": 2, "sidebar": 3, "title_area": 3, "text_area": 3, "table_area": 3, "figure_area": 3, "chart_area": 3, "form_area": 3, "decorative_area": 4}


def _d(x: float) -> Column:
    return F.lit(float(x))


def _score(value: Column, limit: Column) -> Column:
    return F.greatest(_d(0), _d(1) - value / F.greatest(limit, _d(1)))


def measures(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per paragraph from its lines (left, top, right, bottom): envelope, edges and widths.

    One shuffle: the lines of a paragraph are ordered by a window and everything else is an
    aggregate beside it.
    """
    w = Window.partitionBy(*keys)
    l = lines.withColumns({"_w": F.col("right") - F.col("left"), "_k": F.row_number().over(w.orderBy(*order)), "_n": F.count("*").over(w)})  # noqa: E741
    inner = F.col("_k") < F.col("_n")
    nonfinal = lambda c: F.when(inner, F.col(c))
    zero = lambda c: F.coalesce(c, _d(0))
    return l.groupBy(*keys).agg(
        *(f(c).alias(f"p_{c}") for f, c in ((F.min, "left"), (F.min, "top"), (F.max, "right"), (F.max, "bottom"))), F.count("*").alias("line_count"),
        zero(F.stddev_pop("left")).alias("left_variance"), zero(F.stddev_pop("right")).alias("right_variance"), zero(F.stddev_pop((F.col("left") + F.col("right")) / 2)).alias("center_variance"),
        zero(F.stddev_pop(nonfinal("left"))).alias("inner_left_variance"), zero(F.stddev_pop(nonfinal("right"))).alias("inner_right_variance"), F.median(nonfinal("_w")).alias("inner_width"),
        F.max(F.when(~inner, F.col("_w"))).alias("last_width"), F.max(F.when(F.col("_k") == 1, F.col("left"))).alias("first_left"), F.median(F.when(F.col("_k") > 1, F.col("left"))).alias("rest_left"))


def classify(m: DataFrame, is_list: Column | None = None, marker_gap: Column | None = None) -> DataFrame:
    """measures with a reference box (ref_left, ref_right) to alignment and confidence.

    justify, then left for lists and hanging indents, center, right, left, unknown: the first that
    holds, with a confidence from how near its limits it is.
    """
    width = F.greatest(F.col("ref_right") - F.col("ref_left"), _d(0))
    m = m.withColumns({
        "ref_width": width, "left_gap": F.greatest(F.col("p_left") - F.col("ref_left"), _d(0)), "right_gap": F.greatest(F.col("ref_right") - F.col("p_right"), _d(0)),
        "center_offset": (F.col("p_left") + F.col("p_right")) / 2 - (F.col("ref_left") + F.col("ref_right")) / 2})
    rw = F.col("ref_width")
    ratio = lambda c: F.when(rw > 0, c / F.nullif(rw, _d(0))).otherwise(_d(0))
    relative = F.when(F.col("line_count") == 1, _d(1)).when(F.col("inner_width") > 0, F.col("last_width") / F.nullif(F.col("inner_width"), _d(0))).otherwise(_d(0))
    threshold = F.greatest(_d(8), rw * 0.025)
    by_lines = (F.col("rest_left") - F.col("first_left") >= threshold) & (F.greatest(F.col("first_left") - F.col("ref_left"), _d(0)) <= F.greatest(threshold * 1.5, rw * 0.06))
    by_marker = F.coalesce(marker_gap >= threshold, F.lit(False)) if marker_gap is not None else F.lit(False)
    m = m.withColumns({"width_ratio": ratio(F.col("p_right") - F.col("p_left")), "last_ratio": ratio(F.col("last_width")), "last_relative": relative, "hanging": by_marker | F.coalesce(by_lines, F.lit(False))})
    edge, side = F.greatest(_d(3), rw * 0.015), F.greatest(_d(6), rw * 0.035)
    center, balance = F.greatest(_d(6), rw * 0.035), F.greatest(_d(6), rw * 0.04)
    lg, rg = F.col("left_gap"), F.col("right_gap")
    steady = F.greatest(edge, rw * 0.025)
    justified = (
        (F.col("line_count") >= 2) & (F.col("inner_left_variance") <= steady) & (F.col("inner_right_variance") <= steady) & (F.col("inner_width") / F.greatest(rw, _d(1)) >= 0.72)
        & (F.col("last_ratio") <= 0.86) & (F.col("last_relative") <= 0.9) & (lg <= side * 2) & (rg <= side * 2))
    justify_confidence = _d(0.55) + _score(F.col("left_variance"), rw * 0.04) * 0.15 + _score(F.col("right_variance"), rw * 0.04) * 0.15 + F.greatest(_d(0), _d(1) - F.col("last_relative")) * 0.15 - F.when(F.col("line_count") == 2, 0.05).otherwise(0.0)
    listed = (is_list if is_list is not None else F.lit(False)) | F.col("hanging")
    off, differ = F.abs("center_offset"), F.abs(lg - rg)
    centered = (off <= center) & (differ <= balance) & (F.col("width_ratio") <= 0.9) & (F.col("center_variance") <= F.greatest(center, rw * 0.035))
    side_variance = F.greatest(edge, rw * 0.025)
    right = (rg <= side) & (lg - rg >= rw * 0.06) & (F.col("right_variance") <= side_variance)
    left = (lg <= side * 1.5) | (F.col("left_variance") <= side_variance)
    cases = [
        (rw < 1, "unknown", _d(0)), (justified, "justify", justify_confidence), (listed, "left", F.when(F.col("left_variance") <= edge * 2, 0.78).otherwise(0.66)),
        (centered, "center", _d(0.55) + _score(off, center) * 0.25 + _score(differ, balance) * 0.2),
        (right, "right", _d(0.55) + _score(rg, side) * 0.25 + _score(F.col("right_variance"), side_variance) * 0.2),
        (left, "left", _d(0.5) + _score(lg, side * 1.5) * 0.25 + _score(F.col("left_variance"), side_variance) * 0.2)]
    kind, confidence = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), _d(0))
    for cond, name, value in cases:
        kind, confidence = kind.when(cond, name), confidence.when(cond, F.least(F.greatest(value, _d(0)), _d(1)))
    return m.withColumns({"alignment": kind.otherwise("unknown"), "confidence": confidence.otherwise(0.3)})


def issues(results: DataFrame, expected: Column | None = None) -> DataFrame:
    """results with issue_codes, an array of the rules that a result breaks.

    expected: the reference type that the paragraph's role asks for, or null.
    """
    rw, lg, rg = F.col("ref_width"), F.col("left_gap"), F.col("right_gap")
    edge = F.greatest(_d(10), rw * 0.08)
    kind = F.col("alignment")
    conflict = (
        F.when(rw <= 0, None)
        .when((kind == "center") & ((F.abs("center_offset") > F.greatest(_d(8), rw * 0.06)) | (F.abs(lg - rg) > F.greatest(_d(8), rw * 0.1))), "center_geometry_conflict")
        .when((kind == "right") & ((rg > edge) | (lg <= rg)), "right_geometry_conflict")
        .when((kind == "left") & (rg <= edge) & (lg > rg * 1.5) & ~F.col("hanging"), "left_geometry_conflict")
        .when((kind == "justify") & ((F.col("line_count") < 2) | ((F.col("last_relative") > 0.98) & (F.col("last_ratio") > 0.95))), "justify_geometry_conflict"))
    p, r = Box.of("p_"), Box.of("ref_")
    outside = (p.left < r.left - 8) | (p.top < r.top - 8) | (p.right > r.right + 8) | (p.bottom > r.bottom + 8)
    mismatch = F.when(expected.isNotNull() & ~F.col("reference_type").eqNullSafe(expected), "reference_mismatch") if expected is not None else F.lit(None).cast("string")
    codes = F.array_compact(F.array(
        F.when(kind == "unknown", "unknown_alignment"), F.when(F.col("confidence") < MINIMUM_CONFIDENCE, "low_confidence"), mismatch, conflict, F.when(outside, "paragraph_outside_reference")))
    return results.withColumn("issue_codes", codes)


def result_issues(paragraphs: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """keys, code, severity: visible paragraphs without a result or with several, and results of no paragraph.

    keys name a paragraph. A paragraph of several results has one row, and so has one that is listed
    more than once; null keys are one paragraph. Both sides are counted in one aggregate, without a join.
    """
    sides = [d.select(*keys, F.lit(own).alias("_p"), F.lit(1 - own).alias("_r")) for d, own in ((paragraphs, 1), (results, 0))]
    counted = sides[0].unionByName(sides[1]).groupBy(*keys).agg(F.sum("_p").alias("_p"), F.sum("_r").alias("_r"))
    cases = ((F.col("_r") > 1, "duplicate_result", "error"), (F.col("_r") == 0, "missing_result", "error"), (F.col("_p") == 0, "extra_result", "warning"))
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for c, code, severity in cases]))
    return counted.select(*keys, F.inline(found))


def report(issued: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by alignment and reference, mean and least confidence and warnings, per key; () for the whole."""
    count = lambda c, v: F.count_if(F.col(c) == v)
    return issued.groupBy(*keys).agg(
        F.count("*").alias("results"), *(count("alignment", a).alias(f"{a}_count") for a in ("left", "center", "right", "justify", "unknown")), F.avg("confidence").alias("mean_confidence"), F.min("confidence").alias("min_confidence"),
        F.count_if(F.col("confidence") < MINIMUM_CONFIDENCE).alias("low_confidence_count"), F.sum(F.size("issue_codes")).alias("warning_count"))


def references(paragraphs: DataFrame, regions: DataFrame, page_keys: list[str], id_col: str, p: Box, r: Box, least_overlap: float = 0.65) -> DataFrame:
    """The reference of each paragraph: the region of its page of the best rank, then smallest area,
    that covers at least least_overlap of it; none where there is no such region.

    regions: region_id, region_type and a box. Returns page keys, id, region_id, region_type.
    """
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("region_type")], F.lit(5))
    pairs = paragraphs.join(regions, page_keys)
    covered = intersection_area(p, r) / F.nullif(area(p), _d(0)) >= least_overlap
    best = F.min(F.when(covered, F.struct(rank.alias("rank"), area(r).alias("size"), F.col("region_id"), F.col("region_type"))))
    found = pairs.groupBy(*page_keys, id_col).agg(best.alias("b"))
    return found.select(*page_keys, id_col, F.col("b.region_id").alias("region_id"), F.coalesce("b.region_type", F.lit("page")).alias("reference_type"))
