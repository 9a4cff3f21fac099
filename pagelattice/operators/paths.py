"""Painted areas of vector drawings: paths of lines, curves, rectangles and quads, filled by a rule, within their clips.

A path is flattened to directed edges. All edges of a drawing and its clips cut the page into slabs of height in
which no two cross; in a slab the gaps between edges are in or out of each path by its winding number, and those within
the drawing and all clips are its pieces: trapezoids, which together are the painted geometry. Nothing is
rasterised, and paths may cross themselves. A drawing is a row of its own, so rows need no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.operators.grouped import worker_path

#: Points that the chords of a curve may be off it, and below which heights and widths are none.
FLATNESS, NOTHING = 0.05, 1e-9
#: Edges and paths up to which drawings are worked on together, and pairs of edges at a time.
SMALL, FEW, WORK = 48, 8, 1 << 17
#: Operators of paths and the numbers each needs.
_NEED = {"l": 4, "c": 8, "re": 4, "qu": 8}
PATH = "array<struct<op: string, points: array<double>>>"
PIECE = "struct<top: double, bottom: double, left_top: double, right_top: double, left_bottom: double, right_bottom: double>"


def _curve(p: np.ndarray, flatness: float) -> np.ndarray:
    """Points along a cubic curve of four points, without the first."""
    bend = max(np.hypot(*(p[0] - 2 * p[1] + p[2])), np.hypot(*(p[1] - 2 * p[2] + p[3])))
    steps = max(1, int(np.ceil(np.sqrt(0.75 * bend / flatness))))
    t = np.linspace(0, 1, steps + 1)[1:, None]
    return (1 - t) ** 3 * p[0] + 3 * (1 - t) ** 2 * t * p[1] + 3 * (1 - t) * t**2 * p[2] + t**3 * p[3]


def edges(path: list[dict] | None, flatness: float = FLATNESS) -> np.ndarray:
    """Directed edges (x0, y0, x1, y1) of a path, each of its parts closed.

    Commands are l (two points), c (four), re (left, top, right, bottom) and qu (upper left, upper right, lower left and lower
    right corner). A line or curve that begins where the last one ended goes on with its part. Commands that are unknown, short of
    points or not finite are passed over and end the part.
    """
    parts: list[list[np.ndarray]] = []
    open_ = False
    for item in path or []:
        p = np.asarray(item.get("points") or [], float)
        need = _NEED.get(item.get("op"))
        if need is None or len(p) != need or not np.isfinite(p).all():
            open_ = False
            continue
        if item["op"] in ("re", "qu"):
            corners = p.reshape(4, 2)[[0, 1, 3, 2]] if item["op"] == "qu" else np.array([[p[0], p[1]], [p[2], p[1]], [p[2], p[3]], [p[0], p[3]]])
            parts.append(list(corners))
            open_ = False
            continue
        p = p.reshape(-1, 2)
        if not (open_ and np.array_equal(parts[-1][-1], p[0])):
            parts.append([p[0]])
            open_ = True
        parts[-1].extend(p[1:] if item["op"] == "l" else _curve(p, flatness))
    made = []
    for part in parts:
        points = np.array(part)
        made.append(np.concatenate([points, np.roll(points, -1, axis=0)], axis=1))
    return np.concatenate(made) if made else np.zeros((0, 4))


def _heights(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Heights at which the lines of edges a cross those of edges b, pair by pair, and whether that is between their ends."""
    d, f, gap = a[..., 2:] - a[..., :2], b[..., 2:] - b[..., :2], b[..., :2] - a[..., :2]
    across = d[..., 0] * f[..., 1] - d[..., 1] * f[..., 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = (gap[..., 0] * f[..., 1] - gap[..., 1] * f[..., 0]) / across, (gap[..., 0] * d[..., 1] - gap[..., 1] * d[..., 0]) / across
    ok = (across != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
    with np.errstate(invalid="ignore"):
        return a[..., 1] + t * d[..., 1], ok


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Heights at which edges a cross edges b, pair by pair, between their ends."""
    at, ok = _heights(a, b)
    return at[ok]


def _crossings(e: np.ndarray) -> np.ndarray:
    """Heights at which two edges cross, but for level ones, whose height is known. Of many edges each is set against
    those after it that it may meet, from the top."""
    e = e[e[:, 1] != e[:, 3]]
    if (e[:, 0] == e[:, 2]).all():
        return np.zeros(0)
    if len(e) <= 48:
        i, j = np.triu_indices(len(e), 1)
        return _meet(e[i], e[j])
    order = np.argsort(np.minimum(e[:, 1], e[:, 3]), kind="stable")
    e = e[order]
    low, high = np.minimum(e[:, 1], e[:, 3]), np.maximum(e[:, 1], e[:, 3])
    left, right = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2])
    out = []
    for k in range(len(e) - 1):
        end = np.searchsorted(low, high[k], "right")  # later edges begin below this one
        j = np.arange(k + 1, end)
        j = j[(left[j] <= right[k]) & (right[j] >= left[k])]
        if len(j):
            out.append(_meet(e[k], e[j]))
    return np.concatenate(out) if out else np.zeros(0)


def pieces(paths: list[tuple[np.ndarray, bool]]) -> np.ndarray:
    """Trapezoids (top, bottom, left and right at the top, left and right at the bottom) of what lies in all paths, each
    given by its edges and whether its rule is even-odd (else non-zero)."""
    every = np.concatenate([e for e, _ in paths]) if paths else np.zeros((0, 4))
    of = np.repeat(np.arange(len(paths)), [len(e) for e, _ in paths])
    level = every[:, 1] == every[:, 3]
    ys = np.unique(np.concatenate([every[:, 1], every[:, 3], _crossings(every)]))
    every, of = every[~level], of[~level]
    if len(np.unique(of)) < len(paths):
        return np.zeros((0, 6))
    turn = np.where(every[:, 3] > every[:, 1], 1, -1)
    low, high = np.minimum(every[:, 1], every[:, 3]), np.maximum(every[:, 1], every[:, 3])
    slope = (every[:, 2] - every[:, 0]) / (every[:, 3] - every[:, 1])
    at = lambda k, y: every[k, 0] + (y - every[k, 1]) * slope[k]
    out = []
    for top, bottom in zip(ys[:-1], ys[1:], strict=True):
        if bottom - top <= NOTHING:
            continue
        middle = (top + bottom) / 2
        k = np.flatnonzero((low <= middle) & (high >= middle))
        k = k[np.argsort(at(k, middle), kind="stable")]
        inside = np.ones(len(k), bool)
        for n, (_, even_odd) in enumerate(paths):
            wind = np.cumsum(np.where(of[k] == n, turn[k], 0))
            inside &= (wind % 2 != 0) if even_odd else (wind != 0)
        step = np.diff(np.concatenate([[0], inside.astype(np.int8)]))
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        a, b = k[starts[: len(ends)]], k[ends]
        wide = at(b, middle) - at(a, middle) > NOTHING
        a, b = a[wide], b[wide]
        n = len(a)
        out.append(np.stack([np.full(n, top), np.full(n, bottom), at(a, top), at(b, top), at(a, bottom), at(b, bottom)], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 6))


def _areas(found: np.ndarray) -> np.ndarray:
    return (found[:, 3] - found[:, 2] + found[:, 5] - found[:, 4]) / 2 * (found[:, 1] - found[:, 0])


def area(found: np.ndarray) -> float:
    return float(_areas(found).sum())


def _flat(c: pa.Array, inner: str | None = None) -> tuple[np.ndarray, pa.Array]:
    """Lengths (null: 0) and values of a list column, of a field of its structs where one is named."""
    lengths = pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lengths, pc.struct_field(c.flatten(), inner) if inner else c.flatten()


def _commands(c: pa.Array, of: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a column of paths, whose numbers are given: each command's path, operator (-1: unknown), number of points and their
    values."""
    count, items = _flat(c)
    n, values = _flat(pc.struct_field(items, "points"))
    op = pc.fill_null(pc.index_in(pc.struct_field(items, "op"), value_set=pa.array(list(_NEED))), -1)
    return np.repeat(of, count), op.to_numpy(zero_copy_only=False).astype(np.int64), n, values.to_numpy(zero_copy_only=False).astype(float)


def _gathered(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Commands in the order of their paths: path, operator, and eight numbers, with the operator -1 where they are too few,
    too many or not finite."""
    of, op, n, values = (np.concatenate(x) for x in zip(*parts, strict=True))
    at, need = np.cumsum(n) - n, np.append(list(_NEED.values()), 0)[op]
    k = np.arange(8)
    p = np.append(values, 0.0)[np.where(k < need[:, None], np.minimum(at[:, None] + k, len(values)), len(values))]
    op = np.where((n == need) & np.isfinite(p).all(axis=1), op, -1)
    order = np.argsort(of, kind="stable")
    return of[order], op[order], p[order]


def _all_edges(of: np.ndarray, op: np.ndarray, p: np.ndarray, flatness: float = FLATNESS) -> tuple[np.ndarray, np.ndarray]:
    """Path and edges of all commands at once, as edges() has them of one path."""
    drawn = (op == 0) | (op == 1)
    last = np.where((op == 1)[:, None], p[:, 6:8], p[:, 2:4])
    goes_on = np.zeros(len(op), bool)
    goes_on[1:] = drawn[1:] & drawn[:-1] & (of[1:] == of[:-1]) & (last[:-1] == p[1:, :2]).all(axis=1)
    closes = drawn & ~np.append(goes_on[1:], False)
    first = np.maximum.accumulate(np.where(drawn & ~goes_on, np.arange(len(op)), 0))
    c = p.reshape(-1, 4, 2)
    bend = np.maximum(np.hypot(*(c[:, 0] - 2 * c[:, 1] + c[:, 2]).T), np.hypot(*(c[:, 1] - 2 * c[:, 2] + c[:, 3]).T))
    steps = np.where(op == 1, np.maximum(1, np.ceil(np.sqrt(0.75 * bend / flatness))), 1).astype(np.int64)
    n = np.where(op >= 2, 4, np.where(drawn, steps + closes, 0))
    to = np.cumsum(n) - n
    e = np.zeros((int(n.sum()), 4))
    lines = np.flatnonzero(op == 0)
    e[to[lines]] = p[lines, :4]
    curves = np.flatnonzero(op == 1)
    k = np.repeat(curves, steps[curves])
    j = np.arange(len(k)) - np.repeat(np.cumsum(steps[curves]) - steps[curves], steps[curves])
    for ends, step in ((slice(0, 2), j), (slice(2, 4), j + 1)):
        t = np.where(step == steps[k], 1.0, step * (1 / steps[k]))[:, None]  # as linspace has it
        e[to[k] + j, ends] = (1 - t) ** 3 * c[k, 0] + 3 * (1 - t) ** 2 * t * c[k, 1] + 3 * (1 - t) * t**2 * c[k, 2] + t**3 * c[k, 3]
    k = np.flatnonzero(closes)
    e[to[k] + steps[k]] = np.concatenate([last[k], p[first[k], :2]], axis=1)
    for code, corners in ((2, [0, 1, 2, 1, 2, 3, 0, 3]), (3, [0, 1, 2, 3, 6, 7, 4, 5])):
        k = np.flatnonzero(op == code)
        for side in range(4):
            e[to[k] + side] = p[k][:, [corners[(2 * side + x) % 8] for x in range(4)]]
    return np.repeat(of, n), e


def _ranges(n: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each k its number n[k] times, and beside it start[k], start[k] + 1 and so on."""
    k = np.repeat(np.arange(len(n)), n)
    return k, np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n) + start[k]


def _all_pieces(every: np.ndarray, of: np.ndarray, drawing: np.ndarray, even_odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Drawing and trapezoids, as pieces() has them of one drawing. of: the path of each edge, ascending; drawing: that of each path, ascending."""
    none = np.zeros(0, np.int64), np.zeros((0, 6))
    level = every[:, 1] == every[:, 3]
    count = int(drawing[-1]) + 1 if len(drawing) else 0
    enclosing = np.bincount(of[~level], minlength=len(drawing)) > 0
    whole = np.bincount(drawing[~enclosing], minlength=count) == 0
    use = whole[drawing[of]]
    every, of, level = every[use], of[use], level[use]
    if not len(every):
        return none
    heights, at_ = np.concatenate([every[:, 1], every[:, 3]]), np.tile(drawing[of], 2)
    every, of = every[~level], of[~level]
    d = drawing[of]
    m = np.bincount(d, minlength=count)
    end = np.cumsum(m)
    slanted = np.bincount(d[every[:, 0] != every[:, 2]], minlength=count) > 0
    i = np.flatnonzero(slanted[d])
    a, b = _ranges(end[d[i]] - i - 1, i + 1)
    a = i[a]
    met, ok = _heights(every[a], every[b])
    heights, at_ = np.append(heights, met[ok]), np.append(at_, d[a[ok]])
    order = np.lexsort((heights, at_))
    heights, at_ = heights[order], at_[order]
    slab = np.flatnonzero((at_[1:] == at_[:-1]) & (heights[1:] - heights[:-1] > NOTHING))
    if not len(slab):
        return none
    # equal heights are neighbours, so a slab goes from the last of some to the first of the next
    top, bottom, sd = heights[slab], heights[slab + 1], at_[slab]
    middle = (top + bottom) / 2
    turn = np.where(every[:, 3] > every[:, 1], 1, -1)
    low, high = np.minimum(every[:, 1], every[:, 3]), np.maximum(every[:, 1], every[:, 3])
    slope = (every[:, 2] - every[:, 0]) / (every[:, 3] - every[:, 1])
    at = lambda k, y: every[k, 0] + (y - every[k, 1]) * slope[k]
    s, k = _ranges(m[sd], (end - m)[sd])
    spans = (low[k] <= middle[s]) & (high[k] >= middle[s])
    s, k = s[spans], k[spans]
    order = np.lexsort((at(k, middle[s]), s))
    s, k = s[order], k[order]
    if not len(s):
        return none
    head = np.append(True, s[1:] != s[:-1])
    start = np.maximum.accumulate(np.where(head, np.arange(len(s)), 0))
    first = np.searchsorted(drawing, np.arange(count))
    paths_of = np.bincount(drawing, minlength=count)
    inside = np.ones(len(s), bool)
    for n in range(int(paths_of.max())):
        here = (first + n)[sd[s]]  # that path of the slab's drawing
        own = np.where(of[k] == here, turn[k], 0)
        wind = np.cumsum(own)
        wind = wind - (wind - own)[start]
        rule = np.where(even_odd[np.minimum(here, len(even_odd) - 1)], wind % 2 != 0, wind != 0)
        inside &= rule | (paths_of[sd[s]] <= n)
    before = np.append(False, inside[:-1]) & ~head
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(~inside & before)
    starts = starts[np.searchsorted(starts, ends) - 1]
    a, b, s = k[starts], k[ends], s[ends]
    wide = at(b, middle[s]) - at(a, middle[s]) > NOTHING
    a, b, s = a[wide], b[wide], s[wide]
    return sd[s], np.stack([top[s], bottom[s], at(a, top[s]), at(b, top[s]), at(a, bottom[s]), at(b, bottom[s])], axis=1)


def _batch(path: pa.Array, even_odd: pa.Array, clips: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of pieces of each drawing of a batch, and all pieces in order.

    A clip counts by its path, or by its box where it has none; one with neither lets all through. Drawings of up to SMALL
    edges and FEW paths are worked on together, about WORK pairs of edges at a time, others one by one.
    """
    size = len(path)
    flag = lambda c: pc.fill_null(c, False).to_numpy(zero_copy_only=False).astype(bool)
    held, clip = _flat(clips)
    owner = np.repeat(np.arange(size), held)
    shape, box = pc.struct_field(clip, "path"), pc.struct_field(clip, "box")
    by_path = _flat(shape)[0] > 0
    by_box = ~by_path & (_flat(box)[0] > 0)
    kept = by_path | by_box
    number = np.cumsum(kept) - 1 + owner + 1  # paths are numbered by drawing: its own, then its clips
    own = np.arange(size) + np.searchsorted(owner[kept], np.arange(size))
    drawing, odd = np.zeros(size + int(kept.sum()), np.int64), np.zeros(size + int(kept.sum()), bool)
    drawing[own], odd[own] = np.arange(size), flag(even_odd)
    drawing[number[kept]], odd[number[kept]] = owner[kept], flag(pc.struct_field(clip, "even_odd"))[kept] & by_path[kept]
    boxes = box.filter(pa.array(by_box))
    n, values = _flat(boxes)
    frames = number[by_box], np.full(len(boxes), list(_NEED).index("re")), n, values.to_numpy(zero_copy_only=False).astype(float)
    of, e = _all_edges(*_gathered([_commands(path, own), _commands(shape.filter(pa.array(by_path)), number[by_path]), frames]))
    edge_ends, path_ends = np.searchsorted(drawing[of], np.arange(size + 1)), np.searchsorted(drawing, np.arange(size + 1))
    m = np.diff(edge_ends)
    small = (m <= SMALL) & (np.diff(path_ends) <= FEW)
    part = np.cumsum(m.astype(np.int64) ** 2) // WORK
    cuts = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | ~small[1:] | ~small[:-1], [True]])) if size else [0]
    counts, out = np.zeros(size, np.int64), []
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        edges_, paths_ = slice(edge_ends[a], edge_ends[z]), slice(path_ends[a], path_ends[z])
        if small[a]:
            d, found = _all_pieces(e[edges_], of[edges_] - path_ends[a], drawing[paths_] - a, odd[paths_])
            counts[a:z] = np.bincount(d, minlength=z - a)
        else:
            found = pieces([(e[edges_][of[edges_] == k], bool(odd[k])) for k in range(path_ends[a], path_ends[z])])
            counts[a] = len(found)
        out.append(found)
    return counts, np.concatenate(out) if out else np.zeros((0, 6))


def painted(drawings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, pieces and area of what each drawing fills within its clips.

    drawings: path, even_odd (null: non-zero) and clips (null or empty: none), each with box, path and even_odd, of which the path
    counts where there is one. A drawing without a path that encloses anything, or with a clip that lets nothing through, has no
    pieces and area 0; a clip with neither box nor path lets all through.
    """
    held = {f.name for f in drawings.schema["clips"].dataType.elementType.fields}
    part = lambda c, name, kind: (c[name] if name in held else F.lit(None)).cast(kind).alias(name)
    clips = F.transform("clips", lambda c: F.struct(part(c, "box", "array<double>"), part(c, "path", PATH), part(c, "even_odd", "boolean")))
    d = drawings.select(*keys, F.col("path").cast(PATH).alias("path"), "even_odd", clips.alias("clips"))
    worker_path(d)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in d.select(*keys).schema.fields), f"pieces array<{PIECE}>, area double"])
    names = ["top", "bottom", "left_top", "right_top", "left_bottom", "right_bottom"]

    def run(batches):
        for b in batches:
            column = lambda c, b=b: b.column(b.schema.get_field_index(c))
            counts, flat = _batch(column("path"), column("even_odd"), column("clips"))
            ends = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
            areas = np.bincount(np.repeat(np.arange(len(counts)), counts), weights=_areas(flat), minlength=len(counts))
            struct = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(6)], names=names)
            columns = [*(column(k) for k in keys), pa.ListArray.from_arrays(ends, struct), pa.array(areas, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "pieces", "area"])

    return d.mapInArrow(run, schema)
