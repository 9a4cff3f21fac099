"""Near-duplicate embeddings by PCA-ordered tiled comparison, exact at every size.

Unit vectors are turned into the basis of their principal components, so that leading coordinates
hold most of a product. Splits of the leading coordinates, fitted on a bounded sample, deal all
vectors into tiles; two tiles whose boxes are further apart than the threshold's chord are never
compared. Compared tiles accumulate the leading dimensions first, bound the rest of each product
by the suffix norms (Cauchy-Schwarz) and go on only where the threshold can still be reached. Tiles
so tight that all their pairs must be links are counted without comparing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import components, cut, map_arrow

THRESHOLD = 0.9
#: Vectors of a block; a tile of more becomes several blocks.
BLOCK = 2048
#: Tiles at most, so that what the driver plans with has a fixed bound; tiles grow beyond it.
TILES = 1024
#: Vectors that the splits are fitted on, about.
SAMPLE = 8192
LEAD = 8
STAGES = (8, 24)
EPS = 1e-9


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _matrix(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _splits(sample: np.ndarray, depth: int) -> np.ndarray:
    """A complete binary tree of (dimension, value), medians of the widest leading coordinate."""
    tree = np.zeros((max(2**depth - 1, 0), 2))
    parts = {0: sample}
    for node in range(len(tree)):
        rows = parts.pop(node)
        if len(rows):
            k = int(np.argmax(rows.std(axis=0)))
            tree[node] = k, np.median(rows[:, k])
            low = rows[:, k] < tree[node, 1]
            parts[2 * node + 1], parts[2 * node + 2] = rows[low], rows[~low]
        else:
            parts[2 * node + 1] = parts[2 * node + 2] = rows
    return tree


def _tile_of(lead: np.ndarray, tree: np.ndarray) -> np.ndarray:
    node = np.zeros(len(lead), np.int64)
    while len(tree) and node[0] < len(tree) if len(node) else False:
        k, cutoff = tree[node, 0].astype(int), tree[node, 1]
        node = 2 * node + 1 + (lead[np.arange(len(lead)), k] >= cutoff)
    return node - len(tree)


def compare(xa: np.ndarray, xb: np.ndarray, basis: np.ndarray, threshold: float, same: bool):
    """Index pairs (i, j) of rows with cosine >= threshold; i < j if both are the same block."""
    ua, ub = _unit(xa), _unit(xb)
    ya, yb = ua @ basis, ub @ basis
    d = ya.shape[1]
    stops = [s for s in STAGES if s < d] + [d]
    tails = [[np.sqrt(np.maximum((y[:, s:] ** 2).sum(axis=1), 0)) for s in stops] for y in (ya, yb)]
    found_i, found_j = [], []
    for top in range(0, len(ya), 512):
        rows = slice(top, top + 512)
        dots = ya[rows, : stops[0]] @ yb[:, : stops[0]].T
        alive = dots + np.outer(tails[0][0][rows], tails[1][0]) >= threshold - EPS
        if same:
            alive &= np.arange(top, top + len(dots))[:, None] < np.arange(len(yb))[None, :]
        i, j = np.nonzero(alive)
        part = dots[i, j]
        for k in range(1, len(stops)):
            at = slice(stops[k - 1], stops[k])
            if len(i) > 0.2 * dots.size:
                part = part + (ya[rows, at] @ yb[:, at].T)[i, j]
            else:
                part = part + np.concatenate([np.einsum("ij,ij->i", ya[rows][i[s : s + 65536], at], yb[j[s : s + 65536], at]) for s in range(0, len(i), 65536)] or [np.zeros(0)])
            go = part + tails[0][k][rows][i] * tails[1][k][j] >= threshold - EPS
            i, j, part = i[go], j[go], part[go]
        near = np.abs(part - threshold) <= EPS  # rounding of the basis must not decide
        if near.any():
            a, b = xa[rows][i[near]], xb[j[near]]
            cos = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
            part[near] = cos
        go = part >= threshold
        found_i.append(i[go] + top)
        found_j.append(j[go])
    return np.concatenate(found_i or [np.zeros(0, int)]), np.concatenate(found_j or [np.zeros(0, int)])


def _forest(ids_a, ids_b, i, j):
    """Links that connect what all links connect."""
    root: dict[int, int] = {}

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = root[x]
        return x

    out = []
    for a, b in zip(ids_a[i].tolist(), ids_b[j].tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _links(classes: DataFrame, d: int, threshold: float) -> DataFrame:
    """Links between classes of one dimension: rows (rep, links, other); other is an edge's end or null."""
    spark = classes.sparkSession

    def moments(batches):
        total, n = np.zeros((d, d)), 0
        for b in batches:
            u = _unit(_matrix(b.column(0), d))
            total, n = total + u.T @ u, n + len(u)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["m", "n"])

    sums = map_arrow(classes.select("vec"), moments, "m binary, n long").collect()
    count = sum(r.n for r in sums)
    if count < 2:
        return spark.createDataFrame([], "rep long, links long, other long")
    _, basis = np.linalg.eigh(sum(np.frombuffer(r.m).reshape(d, d) for r in sums) / count)
    basis = np.ascontiguousarray(basis[:, ::-1])
    lead = min(LEAD, d)
    draw = F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / count))
    sample = classes.where(draw).select("vec").toArrow().column(0).combine_chunks()
    depth = int(np.clip(np.ceil(np.log2(max(count / BLOCK, 1))), 0, np.log2(TILES)))
    tree = _splits(_unit(_matrix(sample, d)) @ basis[:, :lead] if len(sample) else np.zeros((0, lead)), depth)
    model = spark.sparkContext.broadcast((basis, tree))

    def place(batches):
        basis, tree = model.value
        for b in batches:
            if not b.num_rows:
                continue
            y = _unit(_matrix(b.column(b.schema.get_field_index("vec")), d)) @ basis[:, :lead]
            yield pa.RecordBatch.from_arrays([pa.array(_tile_of(y, tree), pa.int32()), *(b.column(b.schema.get_field_index(c)) for c in ("rep", "n", "vec"))], names=["tile", "rep", "n", "vec"])

    kind = classes.schema["vec"].dataType.simpleString()
    placed = cut(map_arrow(classes.select("rep", "n", "vec"), place, f"tile int, rep long, n long, vec {kind}"))
    sizes = {r.tile: r["count"] for r in placed.groupBy("tile").count().collect()}  # TILES rows at most
    chunks = F.create_map(*[F.lit(x) for t, c in sorted(sizes.items()) for x in (t, -(-c // BLOCK))])
    block = F.pmod(F.xxhash64("rep"), chunks[F.col("tile")].cast("long")).cast("int")
    flat = np.float32 if "float" in kind else np.float64

    def pack(group):
        basis, _ = model.value
        x = _matrix(group.column("vec").combine_chunks(), d)
        u = _unit(x)
        y = u @ basis[:, :lead]
        centre = u.mean(axis=0)
        radius = float(np.sqrt(((u - centre) ** 2).sum(axis=1).max()))
        one = [group.column("tile")[0].as_py(), group.column("block")[0].as_py(), group.column("rep").to_numpy().tobytes(), group.column("n").to_numpy().tobytes(), x.astype(flat).tobytes(), y.min(axis=0).tobytes(), y.max(axis=0).tobytes(), centre.tobytes(), radius]
        return pa.table({k: [v] for k, v in zip(("tile", "block", "reps", "ns", "x", "lo", "hi", "centre", "radius"), one, strict=True)}).cast(pa.schema([("tile", pa.int32()), ("block", pa.int32()), ("reps", pa.binary()), ("ns", pa.binary()), ("x", pa.binary()), ("lo", pa.binary()), ("hi", pa.binary()), ("centre", pa.binary()), ("radius", pa.float64())]))

    blocks = placed.withColumn("block", block).groupBy("tile", "block").applyInArrow(pack, "tile int, block int, reps binary, ns binary, x binary, lo binary, hi binary, centre binary, radius double")
    blocks = cut(blocks)
    boxes: dict[int, list] = {}

    def box(batches):  # one row per task and tile
        seen: dict[int, list] = {}
        for b in batches:
            for t, lo, hi in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                lo, hi = np.frombuffer(lo), np.frombuffer(hi)
                seen[t] = [np.minimum(seen[t][0], lo), np.maximum(seen[t][1], hi)] if t in seen else [lo, hi]
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array([v[0].tobytes() for v in seen.values()], pa.binary()), pa.array([v[1].tobytes() for v in seen.values()], pa.binary())], names=["tile", "lo", "hi"])

    for r in map_arrow(blocks.select("tile", "lo", "hi"), box, "tile int, lo binary, hi binary").collect():
        lo, hi = np.frombuffer(r.lo), np.frombuffer(r.hi)
        boxes[r.tile] = [np.minimum(boxes[r.tile][0], lo), np.maximum(boxes[r.tile][1], hi)] if r.tile in boxes else [lo, hi]
    tiles = np.array(sorted(boxes))
    lo, hi = (np.array([boxes[t][k] for t in tiles]) for k in (0, 1))
    chord = 2 - 2 * threshold + EPS
    close = []
    for a in range(len(tiles)):
        gap = np.maximum(np.maximum(lo[a] - hi[a:], lo[a:] - hi[a]), 0)
        close += [(int(tiles[a]), int(tiles[a + k])) for k in np.flatnonzero((gap**2).sum(axis=1) <= chord)]
    plan = spark.createDataFrame(close, "ta int, tb int")
    cols = ("tile", "block", "reps", "ns", "x", "centre", "radius")
    left, right = (blocks.select(*(F.col(c).alias(("t" if c == "tile" else c + "_") + s) for c in cols)) for s in "ab")
    work = plan.join(left, "ta").join(right, "tb").where("ta < tb or block_a <= block_b")
    work = work.withColumn("same", F.expr("ta = tb and block_a = block_b"))

    def run(batches):
        basis, _ = model.value
        reach = np.sqrt(max(2 - 2 * threshold - EPS, 0))
        for b in batches:
            at = {n: b.column(k) for k, n in enumerate(b.schema.names)}
            for r in range(b.num_rows):
                get = lambda n, r=r: at[n][r].as_py()
                ids = [np.frombuffer(get(f"reps_{s}"), np.int64) for s in "ab"]
                ns = [np.frombuffer(get(f"ns_{s}"), np.int64) for s in "ab"]
                centres, same = [np.frombuffer(get(f"centre_{s}")) for s in "ab"], get("same")
                if np.sqrt(((centres[0] - centres[1]) ** 2).sum()) + get("radius_a") + get("radius_b") <= reach:
                    counts = [np.full(len(ids[0]), ns[1].sum()) - (ns[0] if same else 0), np.full(len(ids[1]), 0 if same else ns[0].sum())]
                    edges = [(int(ids[0][0]), int(x)) for s in (0, 1) for x in ids[s] if x != ids[0][0]]
                else:
                    xs = [np.frombuffer(get(f"x_{s}"), flat).astype(np.float64).reshape(-1, d) for s in "ab"]
                    i, j = compare(*xs, basis, threshold, same)
                    counts = [np.bincount(i, ns[1][j], len(ids[0])), np.bincount(j, ns[0][i], len(ids[1]))]
                    edges = _forest(*ids, i, j)
                rep = np.concatenate([*ids, [a for a, _ in edges]]).astype(np.int64)
                links = np.concatenate([*counts, np.zeros(len(edges))]).astype(np.int64)
                other = [None] * (len(ids[0]) + len(ids[1])) + [b for _, b in edges]
                batch = pa.RecordBatch.from_arrays([pa.array(rep), pa.array(links), pa.array(other, pa.int64())], names=["rep", "links", "other"])
                yield batch.filter(pa.array((links > 0) | np.array([o is not None for o in other])))

    return map_arrow(work, run, "rep long, links long, other long")


def near(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing,
    and so do vectors of different lengths. Equal vectors form a class that is compared once and
    whose rows count as links of each other, repeated rows included. Rows with a null id link with
    nothing and have no component. The cosine is taken in double precision. Other columns are dropped.
    """
    v = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vec"))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    square = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    good = F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & ~bad & (square > 0) & (square < float("inf"))
    v = v.withColumn("good", F.coalesce(good, F.lit(False)))
    classes = cut(v.where("good").groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")))
    lengths = [r.d for r in classes.select(F.size("vec").alias("d")).distinct().collect()]
    found = v.sparkSession.createDataFrame([], "rep long, links long, other long")
    for d in lengths:
        found = found.unionByName(_links(classes.where(F.size("vec") == d), d, threshold))
    found = cut(found)
    joined = components(found.where("other is not null"), "rep", "other")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.join(counts, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    linked = v.where("good").join(named, "vec").select("vec_id", "n_links", F.col("c").alias("component_id"))
    alone = v.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10_vectors(spark, sf_dir: str) -> DataFrame:
    """All embeddings; null, zero and odd vectors and repeats as in near()."""
    return near(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
