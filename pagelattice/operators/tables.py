"""Table grids: boundaries, repair, ownership, merges, content and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.functions.geometry import Box, contains_center, coverage_of
from pagelattice.operators.grouped import map_groups

CONFLICT, SNAP, SMALLEST = 3.0, 4.0, 0.5
DIRECT, CONFLICTED, INTERPOLATED, UNIFORM = 0.95, 0.7, 0.6, 0.4


def _d(x: float) -> Column:
    return F.lit(float(x))


def axis_boundaries(d: DataFrame, name: str, cells: str, index: str, span: str, start: str, end: str, count: str, outer: tuple[str, str]) -> DataFrame:
    """d, a row per table with its cells as an array of structs, with the column name: the boundaries of one axis as an
    array of structs of k (0..count), position, confidence and uniform; see boundaries()."""
    votes, heads, known, full = (f"_{name}_{x}" for x in ("votes", "heads", "known", "full"))
    low, high, n = F.col(outer[0]), F.col(outer[1]), F.col(count).cast("int")
    vote = lambda k, v: F.struct(k.cast("int").alias("k"), v.cast("double").alias("v"))
    none = F.array().cast("array<struct<k:int,v:double>>")
    fits = lambda c: F.coalesce((c[index] >= 0) & (c[span] >= 1) & (c[index] + c[span] <= F.col(count)), F.lit(False))
    given = F.flatten(F.transform(F.filter(cells, fits), lambda c: F.array(vote(c[index], c[start]), vote(c[index] + c[span], c[end]))))
    given = F.concat(F.coalesce(given, none), F.array(vote(F.lit(0), low), vote(n, high)))
    d = d.withColumn(votes, F.sort_array(F.filter(given, lambda x: x["v"].isNotNull())))
    # where each boundary's votes begin, so that their median and spread stand at known places
    at = lambda i: F.get(F.col(votes), i)
    d = d.withColumn(heads, F.filter(F.transform(votes, lambda x, i: F.when((i == 0) | (at(i - 1)["k"] != x["k"]), i)), lambda i: i.isNotNull()))

    def boundary(i, j):
        to = F.coalesce(F.get(F.col(heads), j + 1), F.size(votes))
        k, total = at(i)["k"], i + to
        middle = at(F.floor((total - 1) / 2).cast("int"))["v"] * 0.5 + at(F.floor(total / 2).cast("int"))["v"] * 0.5
        m = F.when(k == 0, low).when(k == n, high).otherwise(middle)
        sure = (k == 0) | (k == n) | (at(to - 1)["v"] - at(i)["v"] <= CONFLICT)
        return F.struct(k.alias("k"), m.cast("double").alias("m"), F.when(sure, DIRECT).otherwise(CONFLICTED).alias("c"))

    d = d.withColumn(known, F.filter(F.transform(heads, boundary), lambda x: x["m"].isNotNull()))
    row = lambda k, p, c: F.struct(k.alias("k"), p.alias("p"), c.alias("c"))

    def stretch(x, j):
        z = F.get(F.col(known), j + 1)
        step = (z["m"] - x["m"]) / F.greatest(z["k"] - x["k"], F.lit(1))
        between = F.transform(F.sequence(x["k"], z["k"] - 1), lambda k: row(k, F.when(k == x["k"], x["m"]).otherwise(x["m"] + step * (k - x["k"])), F.when(k == x["k"], x["c"]).otherwise(F.lit(INTERPOLATED))))
        return F.when(z.isNull(), F.array(row(x["k"], x["m"], x["c"]))).otherwise(between)

    missing_ = low.isNull() | high.isNull()
    d = d.withColumn(full, F.when(missing_, F.transform(F.sequence(F.lit(0), n), lambda k: row(k, F.lit(None).cast("double"), F.lit(UNIFORM)))).when(n.isNotNull(), F.flatten(F.transform(known, stretch))))
    close = F.filter(full, lambda x, i: (i > 0) & ~F.coalesce(x["p"] - F.get(F.col(full), i - 1)["p"] >= SMALLEST, F.lit(False)))
    d = d.withColumn(f"_{name}_uniform", F.size(close) > 0)
    uniform = F.col(f"_{name}_uniform")
    even = lambda k: low + (high - low) / F.greatest(n, F.lit(1)) * k
    made = F.transform(full, lambda x: F.struct(x["k"].alias("k"), F.when(uniform, even(x["k"])).otherwise(x["p"]).alias("position"), F.when(uniform, UNIFORM).otherwise(x["c"]).alias("confidence"), uniform.alias("uniform")))
    return d.withColumn(name, made).drop(votes, heads, known, full, f"_{name}_uniform")


def _each(structs: Column | str) -> Column:
    """A row for each struct of an array, and one of nulls where there is none. Without that, Spark would filter by the array's
    size before, and for that work the array out a second time."""
    return F.inline_outer(structs)


def with_cells(tables: DataFrame, cells: DataFrame, keys: list[str], columns: list[str], how: str = "left") -> DataFrame:
    """tables with _cells, the columns of each table's cells as an array of structs; null for tables without any."""
    return tables.join(cells.groupBy(*keys).agg(F.collect_list(F.struct(*columns)).alias("_cells")), keys, how)


def boundaries(cells: DataFrame, tables: DataFrame, keys: list[str], index: str, span: str, start: str, end: str, count: str, outer: tuple[str, str]) -> DataFrame:
    """Boundaries of one axis: keys, k (0..count), position, confidence, uniform.

    The starts and ends of cells vote for a boundary by their median, with less confidence if they
    are more than 3 apart; the outer ones are the table's. Missing ones are interpolated between
    their known neighbours. Where steps are below half a point, the axis is split evenly. Cells meet their table
    as one row with an array, so that they are shuffled once.
    """
    t = with_cells(tables.select(*keys, count, *outer), cells, keys, [index, span, start, end])
    return axis_boundaries(t, "_axis", "_cells", index, span, start, end, count, outer).select(*keys, _each("_axis")).where("k is not null")


def positions(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Grid positions that each cell covers: cells with row and col."""
    rows = cells.withColumn("row", F.explode(F.sequence("row_index", F.col("row_index") + F.col("row_span") - 1)))
    return rows.withColumn("col", F.explode(F.sequence("column_index", F.col("column_index") + F.col("column_span") - 1)))


def grid(tables: DataFrame, keys: list[str]) -> DataFrame:
    """All positions of each table's grid: keys, row, col."""
    rows = tables.where("row_count > 0 and column_count > 0").withColumn("row", F.explode(F.sequence(F.lit(0), F.col("row_count") - 1)))
    return rows.select(*keys, "row", F.explode(F.sequence(F.lit(0), F.col("column_count") - 1)).alias("col"))


def _held(d: DataFrame, name: str, clip: bool) -> DataFrame:
    """d, a row per table with its cells as the array _cells, with the column name: the grid positions, row * column_count +
    column, that its cells hold, sorted and repeated where several do. Cells that reach out of the grid hold none, or with clip what is in it."""
    rows, cols = F.col("row_count"), F.col("column_count")
    if clip:
        first = lambda c, at: F.greatest(c[at], F.lit(0))
        last = lambda c, at, by, n: F.least(c[at] + c[by], n) - 1
        has = lambda c: (last(c, "row_index", "row_span", rows) >= first(c, "row_index")) & (last(c, "column_index", "column_span", cols) >= first(c, "column_index"))
    else:
        first = lambda c, at: c[at]
        last = lambda c, at, by, n: c[at] + c[by] - 1
        has = _fits
    at = lambda c: F.flatten(F.transform(
        F.sequence(first(c, "row_index"), last(c, "row_index", "row_span", rows)),
        lambda i: F.transform(F.sequence(first(c, "column_index"), last(c, "column_index", "column_span", cols)), lambda j: i.cast("long") * cols + j)))
    found = F.flatten(F.transform(F.filter("_cells", lambda c: F.coalesce(has(c), F.lit(False))), at))
    return d.withColumn(name, F.sort_array(F.coalesce(found, F.array().cast("array<long>"))))


_PLACE = ["row_index", "column_index", "row_span", "column_span"]


def _fits(c: Column) -> Column:
    return (c["row_index"] >= 0) & (c["column_index"] >= 0) & (c["row_span"] >= 1) & (c["column_span"] >= 1) & (c["row_index"] + c["row_span"] <= F.col("row_count")) & (c["column_index"] + c["column_span"] <= F.col("column_count"))


def _repeated(name: str) -> Column:
    """Each value that a sorted array holds more than once."""
    a = F.col(name)
    return F.filter(a, lambda x, i: F.coalesce((i > 0) & x.eqNullSafe(F.get(a, i - 1)) & ((i == 1) | ~x.eqNullSafe(F.get(a, i - 2))), F.lit(False)))


def _stretches(name: str) -> Column:
    """Positions of the grid, from lo to hi, between those in a sorted array."""
    total = F.greatest(F.col("row_count"), F.lit(0)).cast("long") * F.greatest(F.col("column_count"), F.lit(0))
    a = F.col(name)
    ends = F.transform(F.concat(a, F.array(total)), lambda x, i: F.struct((F.coalesce(F.get(a, i - 1), F.lit(-1)) + 1).alias("lo"), (x - 1).alias("hi")))
    return F.filter(ends, lambda s: F.coalesce(s["lo"] <= s["hi"], F.lit(False)))


def _spread(d: DataFrame, row: str, col: str) -> DataFrame:
    """d, with positions from lo to hi, once for each of them, as row and col; a row of the grid at a time."""
    cols, lo, hi = F.greatest(F.coalesce(F.col("column_count"), F.lit(1)), F.lit(1)).cast("long"), F.col("lo"), F.col("hi")
    row_of = lambda x: F.floor(x / cols)
    d = d.withColumns({"_first": F.expr("lo") - F.pmod(lo, cols), "_last": F.expr("hi") - F.pmod(hi, cols)})
    d = d.withColumn("_at", F.explode_outer(F.sequence(F.col("_first"), F.col("_last"), cols)))
    d = d.withColumn(col, F.explode_outer(F.sequence(F.when(F.col("_at") == F.col("_first"), lo - F.col("_at")).otherwise(F.lit(0)), F.when(F.col("_at") == F.col("_last"), hi - F.col("_at")).otherwise(cols - 1))))
    return d.withColumn(row, row_of(F.col("_at"))).drop("_first", "_last", "_at")


def missing(tables: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Grid positions that no cell covers: keys, row, col. Tables meet their cells once, as one row each."""
    d = _held(with_cells(tables.select(*keys, "row_count", "column_count"), cells, keys, _PLACE), "_of", True)
    d = d.select(*keys, "column_count", _each(_stretches("_of"))).where("lo is not null")
    return _spread(d, "row", "col").select(*keys, F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"))


def owned(tables: DataFrame, cells: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """tables, once each, with what ownership() tells of them as arrays: _twice and _out (anchors), _over (positions) and _gaps (stretches)."""
    d = with_cells(tables, cells, keys, _PLACE, how)
    anchor = lambda c: F.struct(c["row_index"].alias("row"), c["column_index"].alias("col"))
    none = F.array().cast(f"array<struct<row:{cells.schema['row_index'].dataType.simpleString()},col:{cells.schema['column_index'].dataType.simpleString()}>>")
    d = _held(d, "_of", False).withColumn("_anchors", F.coalesce(F.sort_array(F.transform("_cells", anchor)), none))
    out = F.coalesce(F.transform(F.filter("_cells", lambda c: F.coalesce(~_fits(c), F.lit(False))), anchor), none)
    return d.withColumns({"_twice": _repeated("_anchors"), "_out": out, "_over": _repeated("_of"), "_gaps": _stretches("_of")}).drop("_cells", "_anchors", "_of")


def ownership(tables: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Issues of grid ownership: keys, code, row, col; one row for each."""
    d = owned(tables.select(*keys, "row_count", "column_count"), cells, keys, "full")
    issue = lambda code, row, col, lo, hi: F.struct(F.lit(code).alias("code"), row.cast("int").alias("_row"), col.cast("int").alias("_col"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
    zero, null = F.lit(0), F.lit(None)
    places = lambda name, code: F.transform(name, lambda x: issue(code, x["row"], x["col"], zero, zero))
    found = F.concat(
        places("_twice", "DUPLICATE_CELL_ANCHOR"), places("_out", "CELL_SPAN_OUTSIDE_GRID"), F.transform("_over", lambda x: issue("OVERLAPPING_GRID_OWNERSHIP", null, null, x, x)),
        F.transform("_gaps", lambda x: issue("UNCOVERED_GRID_POSITION", null, null, x["lo"], x["hi"])))
    d = _spread(d.select(*keys, "column_count", _each(found)).where("code is not null"), "_r", "_c")
    anchors = F.col("code").isin("DUPLICATE_CELL_ANCHOR", "CELL_SPAN_OUTSIDE_GRID")
    return d.select(*keys, "code", F.when(anchors, F.col("_row")).otherwise(F.col("_r").cast("int")).alias("row"), F.when(anchors, F.col("_col")).otherwise(F.col("_c").cast("int")).alias("col"))


def normalized(tables: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Coverage and confidence of each table's source cells: keys, covered, mapped, confidence, disposition."""
    ok = (F.col("row_index") >= 0) & (F.col("column_index") >= 0) & (F.col("row_span") >= 1) & (F.col("column_span") >= 1) & (F.col("row_index") + F.col("row_span") <= F.col("row_count")) & (F.col("column_index") + F.col("column_span") <= F.col("column_count"))
    sized = cells.join(tables.select(*keys, "row_count", "column_count"), keys).withColumn("ok", ok)
    counts = sized.groupBy(*keys).agg(F.count("*").alias("source"), F.count_if("ok").alias("mapped"), F.count_distinct(F.when(F.col("ok"), F.col("row_index"))).alias("rows"), F.count_distinct(F.when(F.col("ok"), F.col("column_index"))).alias("cols"))
    area = positions(sized.where("ok"), keys).select(*keys, "row", "col").distinct().groupBy(*keys).agg(F.count("*").alias("covered"))
    t = tables.join(counts, keys, "left").join(area, keys, "left").na.fill(0, ["source", "mapped", "rows", "cols", "covered"])
    total = F.greatest(F.col("row_count") * F.col("column_count"), F.lit(1))
    share = lambda a, b: F.least(F.col(a) / F.greatest(b, F.lit(1)), _d(1))
    confidence = _d(0.1) + share("covered", total) * 0.4 + share("mapped", F.col("source")) * 0.2 + share("rows", F.col("row_count")) * 0.15 + share("cols", F.col("column_count")) * 0.15
    whole = (F.col("covered") == total) & (F.col("source") > 0)
    return t.select(*keys, "covered", "mapped", confidence.alias("confidence"), F.when(whole & (confidence >= 0.55), "editable").otherwise("visual_fallback").alias("disposition"))


def axis_span(start: Column, end: Column, index: Column, span: Column, edges: Column) -> tuple[Column, Column]:
    """Span and confidence that a source extent asks for on an axis with sorted edges (array)."""
    here = F.try_element_at(edges, (index + 1).cast("int"))
    off = F.abs(start - here)
    later = F.slice(edges, (index + span + 1).cast("int"), F.greatest(F.size(edges) - index - span, F.lit(0)).cast("int"))
    far = F.transform(later, lambda e: F.abs(end - e))
    least = F.array_min(far)
    wide = (F.array_position(far, least) - 1 + span).cast("int")
    ok = (index >= 0) & (index + span < F.size(edges)) & (off <= SNAP) & (least <= SNAP) & (wide > span)
    ok = F.coalesce(ok, F.lit(False))
    return F.when(ok, wide).otherwise(span), F.when(ok, F.greatest(_d(0.75), _d(1) - F.greatest(off, least) / SNAP * 0.25)).otherwise(_d(0))


def merges(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Accepted merges, in the order of the cells: keys, row_index, column_index, row_span, column_span, confidence.

    cells: row_index, column_index, has_content, synthetic, want_rows, want_cols, geometry (the mean
    of the axes' confidences), borderless (share of inner edges without a border). A wish holds if
    every position that it adds is an empty synthetic cell that no earlier merge took.
    """
    types = {f.name: f.dataType.simpleString() for f in cells.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", row_index int, column_index int, row_span int, column_span int, confidence double"

    def accept(rows):
        free = {(r["row_index"], r["column_index"]) for r in rows if r["synthetic"] and not r["has_content"]}
        for r in rows:
            h, w = r["want_rows"], r["want_cols"]
            if r["synthetic"] or not r["has_content"] or (h == 1 and w == 1):
                continue
            at = r["row_index"], r["column_index"]
            new = {(at[0] + i, at[1] + j) for i in range(h) for j in range(w)} - {at}
            if not new <= free:
                continue
            confidence = min(max(0.75 * r["geometry"] + 0.15 * r["borderless"] + 0.1, 0.0), 1.0)
            if confidence >= 0.72:
                free -= new
                yield {**{k: r[k] for k in keys}, "row_index": at[0], "column_index": at[1], "row_span": h, "column_span": w, "confidence": confidence}

    return map_groups(cells, keys, ["row_index", "column_index"], accept, schema)


def cell_spans(cells: DataFrame, spans: DataFrame, page_keys: list[str], cell: Box, span: Box) -> DataFrame:
    """Pairs of cell and span of a page: the span's centre lies in the cell or it covers 0.55 of the span."""
    hit = contains_center(cell, span, 1.5) | (coverage_of(span, cell) >= 0.55)
    return cells.join(spans, [cells[k] == spans[k] for k in page_keys] + [hit])


def decision(errors: Column, warnings: Column, confidence: Column, fallback: Column) -> Column:
    """Whether a table is safe to build natively."""
    return (
        F.when((errors > 0) | fallback | (confidence < 0.65), "visual_fallback").when(warnings > 0, "native_with_warnings")
        .when(confidence >= 0.8, "native_safe").otherwise("native_with_warnings"))


# Border styles that a native table can have, and features of a source table that it can't.
BORDER_STYLES = ("none", "single", "double", "dashed", "dotted")
UNSUPPORTED = ("has_diagonal_borders", "has_non_rectangular_cells", "has_nested_tables", "has_vertical_text")
#: Points across a page between its margins, where the page doesn't say, and of the narrowest column.
AVAILABLE, NARROWEST = 468.0, 6.0


def _count(array: Column, test) -> Column:
    return F.size(F.filter(array, test))


def _axis_counts(d: DataFrame, name: str, count: str, low: str, high: str, tolerance: float, available: float | None) -> DataFrame:
    """d with {name}_errors, {name}_gaps and {name}_score, from the array in the column {name}."""
    raw, c = F.coalesce(F.col(name), F.array().cast("array<struct<k:int,start:double,end:double>>")), F.col(count)
    finite = lambda s: F.coalesce(~F.isnan(s["start"]) & ~F.isnan(s["end"]) & (F.abs(s["start"]) < float("inf")) & (F.abs(s["end"]) < float("inf")), F.lit(False))
    by, one, fin, good = (f"_{name}_{x}" for x in ("by", "one", "finite", "good"))
    # by index, start and end downwards, so that the last definition of an index comes first
    d = d.withColumn(by, F.sort_array(raw, asc=False))
    new = lambda s, i: (i == 0) | ~F.get(F.col(by), i - 1)["k"].eqNullSafe(s["k"])
    d = d.withColumn(one, F.reverse(F.filter(by, lambda s, i: F.coalesce((s["k"] >= 0) & (s["k"] < c), F.lit(False)) & new(s, i))))
    d = d.withColumn(fin, F.filter(one, finite))
    d = d.withColumn(good, F.filter(fin, lambda s: s["end"] - s["start"] > 0))
    twice = F.size(F.filter(F.transform(by, lambda s, i: (i > 0) & F.get(F.col(by), i - 1)["k"].eqNullSafe(s["k"]) & ((i == 1) | ~F.get(F.col(by), i - 2)["k"].eqNullSafe(s["k"]))), lambda x: F.coalesce(x, F.lit(False))))
    out = _count(F.col(good), lambda s: (s["start"] < F.col(low) - tolerance) | (s["end"] > F.col(high) + tolerance))
    before = F.transform(good, lambda s, i: F.when(i > 0, s["start"] - F.get(F.col(good), i - 1)["end"]))
    steps = f"_{name}_steps"
    d = d.withColumn(steps, before)
    errors = F.when(F.size(by) != c, 1).otherwise(0) + twice + (F.size(one) - F.size(fin)) + (F.size(fin) - F.size(good)) + out
    errors = errors + _count(F.transform(good, lambda s, i: (i > 0) & (s["start"] < F.get(F.col(good), i - 1)["end"] - tolerance)), lambda x: x)
    if available is not None:
        widths = F.transform(fin, lambda s: F.greatest(s["end"] - s["start"], F.lit(0.0)))
        total = F.aggregate(widths, F.lit(0.0), lambda acc, x: acc + x)
        errors = errors + F.when(total > 0, _count(widths, lambda x: x * (F.least(total, F.lit(available)) / total) < NARROWEST)).otherwise(0)
    usable = F.size(F.array_distinct(F.transform(F.filter(by, lambda s: F.coalesce((s["k"] >= 0) & (s["end"] > s["start"]) & (s["k"] < c), F.lit(False)) & finite(s)), lambda s: s["k"])))
    d = d.withColumns({f"{name}_errors": errors.cast("long"), f"{name}_gaps": _count(F.col(steps), lambda x: F.abs(x) > tolerance).cast("long"), f"{name}_usable": usable})
    score = F.least(F.greatest(F.col(f"{name}_usable") / F.greatest(c, F.lit(1)) - F.col(f"{name}_errors") * 0.12, _d(0)), _d(1))
    return d.withColumn(f"{name}_score", score).drop(by, one, fin, good, steps, f"{name}_usable", name)


def _grid_counts(d: DataFrame, cells: str) -> DataFrame:
    """d with the numbers of ownership()'s issues, from the table's cells as one array: dup, outside, gaps, overlaps."""
    rows, cols = F.col("row_count"), F.col("column_count")
    fits = lambda c: F.coalesce((c["r"] >= 0) & (c["c"] >= 0) & (c["h"] >= 1) & (c["w"] >= 1) & (c["r"] + c["h"] <= rows) & (c["c"] + c["w"] <= cols), F.lit(False))
    raw = F.coalesce(F.col(cells), F.array().cast("array<struct<r:int,c:int,h:int,w:int>>"))
    d = d.withColumn("_own", F.filter(raw, fits))
    at = lambda c: F.flatten(F.transform(F.sequence(c["r"], c["r"] + c["h"] - 1), lambda i: F.transform(F.sequence(c["c"], c["c"] + c["w"] - 1), lambda j: i.cast("long") * cols + j)))
    d = d.withColumns({"_held": F.array_sort(F.flatten(F.transform("_own", at))), "_anchors": F.sort_array(F.transform(raw, lambda c: F.struct(c["r"], c["c"])))})

    def repeated(name):
        a = F.col(name)
        return F.size(F.filter(F.transform(a, lambda x, i: (i > 0) & x.eqNullSafe(F.get(a, i - 1)) & ((i == 1) | ~x.eqNullSafe(F.get(a, i - 2)))), lambda x: F.coalesce(x, F.lit(False))))

    total = F.greatest(rows, F.lit(0)).cast("long") * F.greatest(cols, F.lit(0))
    d = d.withColumns({"dup": repeated("_anchors"), "outside": F.size(raw) - F.size("_own"), "gaps": total - F.size(F.array_distinct("_held")), "overlaps": repeated("_held")})
    return d.drop("_own", "_held", "_anchors", cells)


def validated(tables: DataFrame, cells: DataFrame, rows: DataFrame, columns: DataFrame, borders: DataFrame, keys: list[str], available: float = AVAILABLE) -> DataFrame:
    """Scores and decision per table from sizes, row and column geometry, ownership, content, merges, borders,
    synthetic cells and features that native tables lack.

    tables: row_count, column_count, the box, width, height, confidence, and where it has them rotation
    (degrees), the flags UNSUPPORTED and disposition, of which skip decides at once and visual_fallback stays. cells: spans, synthetic,
    has_content, merge_confidence (null unless inferred). rows and columns: k, start, end. borders: style and
    width of each edge of each cell. Each input is read once and meets the others by table, as one row with
    arrays; the issues one by one are those of axis_issues(), narrow_columns() and ownership().
    """
    merged = (F.col("row_span") > 1) | (F.col("column_span") > 1)
    weak = merged & (F.col("merge_confidence") < 0.72)
    place = F.struct(F.col("row_index").cast("int").alias("r"), F.col("column_index").cast("int").alias("c"), F.col("row_span").cast("int").alias("h"), F.col("column_span").cast("int").alias("w"))
    per = cells.groupBy(*keys).agg(
        F.collect_list(place).alias("_cells"), F.count("*").alias("cells"), F.count_if(merged).alias("merged"), F.count_if(weak).alias("weak"), F.count_if(F.col("synthetic") & F.col("has_content")).alias("filled"),
        F.sum(F.when(F.col("synthetic"), F.col("row_span") * F.col("column_span")).otherwise(0)).alias("made"))
    segment = F.struct(F.col("k").cast("int").alias("k"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    along = lambda df, name: df.groupBy(*keys).agg(F.collect_list(segment).alias(name))
    sound = F.col("style").isin(*BORDER_STYLES) & (F.abs("width") < float("inf")) & (F.col("width") >= 0)
    edges = borders.groupBy(*keys).agg(F.count("*").alias("edges"), F.count_if(~F.coalesce(sound, F.lit(False))).alias("bad_edges"))
    turned = F.pmod(F.col("rotation") % 360 + 360, F.lit(360.0)) if "rotation" in tables.columns else F.lit(None)
    odd = F.when((turned > 1.5) & (turned < 358.5), 1).otherwise(0)
    for flag in UNSUPPORTED:
        odd = odd + (F.when(F.col(flag), 1).otherwise(0) if flag in tables.columns else 0)
    upstream = F.col("disposition") if "disposition" in tables.columns else F.lit(None).cast("string")
    t = tables.withColumns({"unsupported": odd, "_upstream": upstream})
    for part in (per, along(rows, "row"), along(columns, "column"), edges):
        t = t.join(part, keys, "left")
    t = _grid_counts(t, "_cells")
    t = _axis_counts(t, "row", "row_count", "top", "bottom", 1.5, None)
    t = _axis_counts(t, "column", "column_count", "left", "right", 1.5, available)
    t = t.na.fill(0, ["cells", "merged", "weak", "filled", "made", "edges", "bad_edges"])
    t = t.withColumns({"not_once": F.col("gaps") + F.col("overlaps"), "grid_errors": F.col("dup") + F.col("outside") + F.col("gaps") + F.col("overlaps"), "axis_errors": F.col("row_errors") + F.col("column_errors")})
    total = F.greatest(F.col("row_count") * F.col("column_count"), F.lit(1))
    clamp = lambda c: F.least(F.greatest(c, _d(0)), _d(1))
    made = F.least(F.col("made") / total, _d(1))
    size_errors = F.when(F.col("width") <= 0, 1).otherwise(0) + F.when(F.col("height") <= 0, 1).otherwise(0) + F.when(F.col("row_count") < 1, 1).otherwise(0) + F.when(F.col("column_count") < 1, 1).otherwise(0) + F.when(F.col("column_count") > 63, 1).otherwise(0) + F.when(F.col("row_count") > 5000, 1).otherwise(0)
    structure = clamp((total - F.col("not_once")) / total - F.col("dup") * 0.1 - F.col("outside") * 0.1)
    content = clamp((F.col("cells") - F.col("filled")) / F.greatest(F.col("cells"), F.lit(1)) - F.col("filled") * 0.1)
    merge = F.when(F.col("merged") == 0, _d(1)).otherwise(clamp((F.col("merged") - F.col("weak")) / F.greatest(F.col("merged"), F.lit(1))))
    style = F.when(F.col("edges") == 0, _d(1)).otherwise((F.col("edges") - F.col("bad_edges")) / F.greatest(F.col("edges"), F.lit(1)))
    t = t.withColumns({"structure_score": structure, "geometry_score": (F.col("row_score") + F.col("column_score")) / 2, "content_score": content, "merge_score": merge, "style_score": style, "reconstruction_score": clamp(_d(1) - made)})
    native = F.col("structure_score") * 0.35 + F.col("geometry_score") * 0.2 + F.col("content_score") * 0.15 + F.col("merge_score") * 0.1 + F.col("style_score") * 0.1 + F.col("reconstruction_score") * 0.1
    native = native * 0.85 + clamp(F.col("confidence")) * 0.15
    errors = F.col("grid_errors") + size_errors + F.col("weak") + F.col("filled") + F.when(made > 0.35, 1).otherwise(0) + F.col("axis_errors") + F.col("bad_edges") + F.col("unsupported")
    warnings = F.when((made > 0) & (made <= 0.35), 1).otherwise(0) + F.col("row_gaps") + F.col("column_gaps")
    t = t.withColumns({"native_confidence": native, "errors": errors.cast("long"), "warnings": warnings.cast("long")})
    kept_back = F.coalesce(F.col("_upstream") == "visual_fallback", F.lit(False))
    chosen = decision(F.col("errors"), F.col("warnings"), F.col("native_confidence"), kept_back)
    skip = F.coalesce(F.col("_upstream") == "skip", F.lit(False))
    return t.select(
        *keys, "structure_score", "geometry_score", "content_score", "merge_score", "style_score", "reconstruction_score", F.when(skip, 0.0).otherwise(F.col("native_confidence")).alias("native_confidence"),
        *(F.when(skip, 0).otherwise(F.col(c)).alias(c) for c in ("errors", "warnings")), F.when(skip, "skip").otherwise(chosen).alias("decision"))


def _last_of_each(segments: DataFrame, keys: list[str]) -> DataFrame:
    """The last definition by start of each index."""
    last = Window.partitionBy(*keys, "k").orderBy(F.col("start").desc(), F.col("end").desc())
    return segments.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")


def _finite() -> Column:
    return F.coalesce(~F.isnan("start") & ~F.isnan("end") & (F.abs("start") < float("inf")) & (F.abs("end") < float("inf")), F.lit(False))


def narrow_columns(tables_: DataFrame, columns: DataFrame, keys: list[str], available: float = AVAILABLE) -> DataFrame:
    """Issues of columns that are too narrow once the table is scaled to the available width."""
    one = _last_of_each(columns.join(tables_.select(*keys, "column_count"), keys).where("k >= 0 and k < column_count").where(_finite()), keys)
    one = one.withColumn("_w", F.greatest(F.col("end") - F.col("start"), F.lit(0.0))).withColumn("_all", F.sum("_w").over(Window.partitionBy(*keys)))
    thin = one.where((F.col("_all") > 0) & (F.col("_w") * (F.least(F.col("_all"), F.lit(available)) / F.col("_all")) < NARROWEST))
    return thin.select(*keys, F.lit("RENDERED_COLUMN_TOO_NARROW").alias("code"), F.lit("error").alias("severity"), "k")


def axis_issues(tables_: DataFrame, segments: DataFrame, keys: list[str], count: str, low: str, high: str, tolerance: float = 1.5) -> DataFrame:
    """Issues of the row or column definitions of each table: keys, code, severity, k (null for the table).

    segments: k, start, end. Duplicates keep the last by start; order and gaps are judged against the
    definition before among those with a positive extent. Tables meet their definitions once, as one row with an array.
    """
    of = segments.groupBy(*keys).agg(F.collect_list(F.struct(F.col("k").cast("int").alias("k"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))).alias("_all"))
    d = tables_.select(*keys, count, low, high).join(of, keys, "full")
    # by index, start and end downwards, so that the last definition of an index comes first
    d = d.withColumn("_all", F.sort_array(F.coalesce("_all", F.array().cast("array<struct<k:int,start:double,end:double>>")), asc=False))
    d = d.withColumns({"_ks": F.transform("_all", lambda s: s["k"])})
    new = lambda s, i: (i == 0) | ~F.get(F.col("_ks"), i - 1).eqNullSafe(s["k"])
    finite = lambda s: F.coalesce(~F.isnan(s["start"]) & ~F.isnan(s["end"]) & (F.abs(s["start"]) < float("inf")) & (F.abs(s["end"]) < float("inf")), F.lit(False))
    d = d.withColumn("_one", F.reverse(F.filter("_all", lambda s, i: F.coalesce((s["k"] >= 0) & (s["k"] < F.col(count)), F.lit(False)) & new(s, i))))
    d = d.withColumn("_good", F.filter("_one", lambda s: finite(s) & (s["end"] - s["start"] > 0)))
    d = d.withColumn("_steps", F.transform("_good", lambda s, i: F.struct(s["k"].alias("k"), s["start"].alias("start"), s["end"].alias("end"), F.when(i > 0, F.get(F.col("_good"), i - 1)["end"]).alias("before"))))
    issue = lambda code, k, severity="error": F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), k.cast("int").alias("k"))
    each = lambda name, code, test, severity="error": F.transform(F.filter(name, lambda s: F.coalesce(test(s), F.lit(False))), lambda s: issue(code, s["k"], severity))
    short = F.filter(F.array(issue("INCOMPLETE_DEFINITIONS", F.lit(None))), lambda _: F.coalesce(F.size("_all") != F.col(count), F.lit(False)))
    found = F.concat(
        short, F.transform(_repeated("_ks"), lambda k: issue("DUPLICATE_INDEX", k)), each("_one", "NON_FINITE_GEOMETRY", lambda s: ~finite(s)), each("_one", "NON_POSITIVE_EXTENT", lambda s: finite(s) & (s["end"] - s["start"] <= 0)),
        each("_steps", "OUTSIDE_TABLE_BOUNDS", lambda s: (s["start"] < F.col(low) - tolerance) | (s["end"] > F.col(high) + tolerance)), each("_steps", "NON_MONOTONIC_GEOMETRY", lambda s: s["start"] < s["before"] - tolerance),
        each("_steps", "BOUNDARY_GAP", lambda s: F.abs(s["start"] - s["before"]) > tolerance, "warning"))
    return d.select(*keys, _each(found)).where("code is not null")


def axis_score(issues: DataFrame, tables_: DataFrame, segments: DataFrame, keys: list[str], count: str) -> DataFrame:
    """keys, score: the share of usable definitions, less 0.12 for each error."""
    usable = segments.where("k >= 0 and end > start").where(_finite()).join(tables_.select(*keys, count), keys).where(F.col("k") < F.col(count)).groupBy(*keys).agg(F.count_distinct("k").alias("ok"))
    errors = issues.where("severity = 'error'").groupBy(*keys).agg(F.count("*").alias("e"))
    t = tables_.select(*keys, count).join(usable, keys, "left").join(errors, keys, "left").na.fill(0, ["ok", "e"])
    return t.select(*keys, F.least(F.greatest(F.col("ok") / F.greatest(F.col(count), F.lit(1)) - F.col("e") * 0.12, _d(0)), _d(1)).alias("score"))
