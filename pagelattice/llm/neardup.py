"""Near-duplicate documents by bottom-k sketches of one hash function.

1. Each text becomes its set of word shingles, as 64-bit hashes. Texts with equal sets form a class;
   from here on a class counts once, whatever its size.
2. A class's sketch is its K smallest hashes. The inverted list of a retained value is the run of
   equal first columns in one global sort of all (value, the eight values after it, class): a list
   is never gathered, a long one is a stretch of several range partitions. In lists of up to SHORT
   classes all pairs meet; in longer ones each class meets the NEIGHBOURS after it, which are those
   whose sketches go on alike for longest. Two sets with a Jaccard similarity of 0.75 share
   each value of their union's sketch with that chance, so they have about 36 lists in common; the
   chance that they share none is 0.25 ** 48.
3. Pairs that meet are filtered by the similarity that the sketch of their union estimates, with
   more than five standard errors of room, and confirmed on the full sets.
4. What the lists of more than SHORT classes have left out is made up for. A pair that passes the
   filter and shares a value of a shorter list has met; any other shares so many values of long lists
   that one is in the rarest few of both (a prefix filter), which only members of large groups have.
   In each such list all pairs that aren't in one component yet are filtered as in 3, in cells of at
   most about CELL rows a side, and confirmed there, so that no pair becomes a row; a cell returns a
   spanning forest of its links. Members that the first links have joined are never compared with
   each other, so a list costs its size times those outside its largest component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import bloom, components, cut, discard, map_arrow, maybe_in, partitions, shingle_hashes, word_hashes, words_of

K = 48
SHORT = 8
NEIGHBOURS = 2
#: Similarity, as a fraction of whole numbers so that the comparison is exact.
SIMILAR = (75, 100)
#: A pair stays if the union's sketch shares more than this part; more than five errors of K = 48 below 0.75.
ESTIMATE = 0.42
#: Rows of a side of a cell, about, and shingles of one, so that long texts make smaller cells.
CELL, CELL_SHINGLES = 1024, 1 << 20


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(words_of(text))))


def set_lists(sets: list[np.ndarray]) -> pa.ListArray:
    """Sets of 64-bit hashes as a column of lists of signed numbers, in the order of the unsigned ones."""
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, print, sketch): print is equal for equal sets, null for empty ones."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            n, prints, sketch = [], [], []
            for text in b.column(b.schema.get_field_index(text_col)):
                s = shingle_set(text.as_py())
                n.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sketch.append(np.sort(s.view(np.int64))[:K])
            ids = b.column(b.schema.get_field_index(id_col))
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sketch])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sketch) if sketch else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(prints, pa.binary()), lists], names=["doc_id", "n_shingles", "print", "sketch"])

    return map_arrow(docs.select(id_col, text_col), run, f"doc_id {kind}, n_shingles long, print binary, sketch array<bigint>")


def _filled(batches, rows: int):
    """The batches, put together so that each but the last has at least so many rows, as small ones would hide
    how long a list is."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else b
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def meeting_pairs(postings: DataFrame, ratio: tuple[int, int] = SIMILAR) -> DataFrame:
    """Pairs (a, b), a < b, that meet in a list, and in how many (overlaps), written.

    postings: v, c1, c2, node, n, all long. Lists are runs of equal v in the sort by (v, c1, c2, node).
    Pairs whose sizes n alone rule the similarity out are left out. In lists of more than SHORT
    nodes only NEIGHBOURS meet, so the pairs are at most in proportion to the postings. A list that the
    sort splits between partitions leaves its ends, of up to SHORT rows each, whose pairs are made last.
    """
    order = ["v", "c1", "c2", "node"]
    lists = postings.select(*order, "n").repartitionByRange(partitions(postings), *order).sortWithinPartitions(*order)

    def emit(v, node, n, fresh):
        """Pairs (i, j), j >= fresh, of sorted rows."""
        ends = np.flatnonzero(np.append(v[1:] != v[:-1], True))
        length = np.diff(np.concatenate([[-1], ends]))
        size = np.repeat(length, length)
        for d in range(1, SHORT):
            i = np.arange(len(v) - d)
            if not len(i):
                break
            ok = (v[i] == v[i + d]) & ((d <= NEIGHBOURS) | (size[i] <= SHORT)) & (i + d >= fresh)
            small, large = np.minimum(n[i], n[i + d]), np.maximum(n[i], n[i + d])
            i = i[ok & (small * ratio[1] >= large * ratio[0]) & (node[i] != node[i + d])]
            if len(i):
                a, b = np.minimum(node[i], node[i + d]), np.maximum(node[i], node[i + d])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=["a", "b", "v"])

    def end(v, node, n):
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(n), pa.array(v)], names=["a", "b", "v"])

    def run(batches):
        held, fresh, begun = [np.zeros(0, np.int64)] * 3, 0, False
        for batch in _filled(batches, 8 * SHORT):
            cols = [np.concatenate([h, batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)]) for h, c in zip(held, ("v", "node", "n"), strict=True)]
            v = cols[0]
            if not len(v):
                continue
            if not begun and v[min(len(v) - 1, SHORT)] != v[0]:  # only the last batch has fewer rows than a list
                first = int(np.searchsorted(v, v[0], "right"))
                yield end(*(c[:first] for c in cols))  # the first list may have begun before
            begun = True
            start = int(np.searchsorted(v, v[-1]))  # the last list may go on
            if len(v) - start <= SHORT and start >= fresh:
                done, keep, after = [c[:start] for c in cols], start, 0
            else:
                done, keep, after = cols, max(len(v) - NEIGHBOURS, start), min(NEIGHBOURS, len(v) - start)
            yield from emit(*done, fresh)
            held, fresh = [c[keep:] for c in cols], after
        yield from emit(*held, fresh)
        if begun and len(held[0]):
            start = int(np.searchsorted(held[0], held[0][-1]))
            if len(held[0]) - start <= SHORT:
                yield end(*(c[start:] for c in held))

    met = cut(map_arrow(lists, run, "a long, b long, v long"))
    ends = [met.where("v is not null").select("v", F.col("a").alias(x), F.col("b").alias(f"n{x}")).distinct() for x in "ab"]
    alike = F.least("na", "nb") * ratio[1] >= F.greatest("na", "nb") * ratio[0]
    split = ends[0].join(ends[1], "v").where(F.col("a") < F.col("b")).where(alike).select("a", "b")
    out = cut(met.where("v is null").select("a", "b").unionByName(split).groupBy("a", "b").agg(F.count("*").alias("overlaps")))
    discard(met)
    return out


def compared(pairs: DataFrame, sets: DataFrame, ratio: tuple[int, int] = SIMILAR) -> DataFrame:
    """Pairs (a, b, similar, part) by their full sets (node, set); part is the Jaccard similarity."""
    left, right = (sets.select(F.col("node").alias(c), F.col("set").alias(f"s{c}"), F.size("set").alias(f"n{c}")) for c in "ab")
    # in Spark, as a batch of 10,000 rows with two sets each is too much for a worker
    both = F.size(F.array_intersect("sa", "sb"))
    rows = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.col("na") + F.col("nb")).alias("all"))
    either = F.col("all") - F.col("both")
    similar = (F.col("both") > 0) & (ratio[1] * F.col("both") >= ratio[0] * either)
    return rows.select("a", "b", similar.alias("similar"), (F.col("both") / F.greatest(either, F.lit(1))).alias("part"))


def confirm(pairs: DataFrame, sets: DataFrame, ratio: tuple[int, int] = SIMILAR) -> DataFrame:
    """Pairs (a, b) whose full sets are similar."""
    return compared(pairs, sets, ratio).where("similar").select("a", "b")


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose union's sketch shares more than ESTIMATE of its values."""
    left, right = (classes.select(F.col("rep").alias(c), F.col("sketch").alias(f"s{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    part = F.size(F.array_intersect(F.array_intersect(union, F.col("sa")), F.col("sb"))) / F.size(union)
    return both.where(part > ESTIMATE).select("a", "b")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, set) of the documents (node, text) that wanted (node) names."""
    # a filter of fixed size leaves most other texts out before the join, which is merged at every size
    bits = docs.sparkSession.sparkContext.broadcast(bloom(wanted, "node"))

    def wanted_rows(batches):
        for b in batches:
            yield b.filter(pa.array(maybe_in(bits.value, b.column(b.schema.get_field_index("node")).to_numpy(zero_copy_only=False).astype(np.int64))))

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index
            yield pa.RecordBatch.from_arrays([b.column(at("node")), set_lists([shingle_set(t) for t in b.column(at("text")).to_pylist()])], names=["node", "set"])

    texts = map_arrow(docs, wanted_rows, "node long, text string").join(wanted.hint("merge"), "node", "left_semi")
    return cut(map_arrow(texts, run, "node long, set array<bigint>"))


def hot_values(postings: DataFrame) -> DataFrame:
    """(v, times) of the values v whose list in postings (v, node) has more than SHORT nodes."""
    return postings.groupBy("v").agg(F.count("*").alias("times")).where(F.col("times") > SHORT)


def unmet(entries: DataFrame, joined: DataFrame, sets_of, ratio: tuple[int, int] = SIMILAR) -> DataFrame:
    """Links (a, b) between different components of all pairs that share a list, up to what a spanning
    forest of each cell leaves out.

    entries: v, node, n, of (the sorted values of the node's entries), sketch (empty: no estimate).
    sets_of makes a table (node, set) of those that a table (node) names, which may have more. A list is
    dealt over cells by salts of the nodes: those outside its largest component, in blocks, against all
    of it, in blocks. Both grow with the list, so a cell has about 2 * CELL rows or 2 * CELL_SHINGLES.
    """
    component = joined.select("node", F.col("component").alias("c"))
    named = cut(entries.select("v", "node", "n").join(component, "node", "left").select("v", "node", "n", F.coalesce("c", "node").alias("c")))
    sizes = named.groupBy("v", "c").agg(F.count("*").alias("times"), F.sum("n").alias("shingles"))
    lists = sizes.groupBy("v").agg(F.sum("times").alias("m"), F.sum("shingles").alias("s"), F.max(F.struct("times", "c", "shingles")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    sides = lambda m, s: F.ceil(F.greatest(m / CELL, s / CELL_SHINGLES))
    outside = sides(F.col("m") - F.col("most.times"), F.col("s") - F.col("most.shingles"))
    lists = lists.select("v", F.col("most.c").alias("most"), sides(F.col("m"), F.col("s")).alias("across"), outside.alias("down"))
    placed = named.drop("n").join(lists, "v").withColumn("outer", F.col("c") != F.col("most"))
    salt = lambda k, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(k))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.col(k) - 1))
    left = placed.where("outer").select("v", "node", "c", "outer", F.lit(True).alias("left"), salt("down", 1).alias("i"), every("across").alias("j"))
    right = placed.select("v", "node", "c", "outer", F.lit(False).alias("left"), every("down").alias("i"), salt("across", 2).alias("j"))
    full = entries.select("node", "n", "of", "sketch").dropDuplicates(["node"])
    cells = left.unionByName(right).join(full, "node")

    def padded(col):
        width = np.diff(col.offsets.to_numpy())
        out = np.zeros((len(width), max(int(width.max(initial=0)), 1)), np.int64)
        out[np.arange(out.shape[1]) < width[:, None]] = col.flatten().to_numpy(zero_copy_only=False)
        return out, width

    def run(table):
        t = table.combine_chunks()
        get = lambda k: t.column(k).to_numpy()
        v, node, c, n, outer, is_left = int(get("v")[0]), get("node"), get("c"), get("n"), get("outer"), get("left")
        of, of_n = padded(t.column("of").combine_chunks())
        sketch, sketch_n = padded(t.column("sketch").combine_chunks())
        right = np.flatnonzero(~is_left)
        asks, asked = {}, np.zeros(len(node), bool)
        for k in np.flatnonzero(is_left):
            at = right[(c[right] != c[k]) & (~outer[right] | (node[right] > node[k]))]
            at = at[np.minimum(n[at], n[k]) * ratio[1] >= np.maximum(n[at], n[k]) * ratio[0]]
            at = at[_first_shared(of[k, : of_n[k]], of[at], of_n[at]) == v] if len(at) else at
            if sketch_n[k] and len(at):
                at = at[_estimates(sketch[k, : sketch_n[k]], sketch[at], sketch_n[at]) > ESTIMATE]
            if len(at):
                asks[int(k)] = node[at].tobytes()
                asked[at] = True
        rows = np.array(sorted(asks) + [k for k in np.flatnonzero(asked)], np.int64)
        with_ = [asks[int(k)] for k in sorted(asks)] + [None] * int(asked.sum())
        cell = [np.full(len(rows), int(get(k)[0]) if t.num_rows else 0, np.int64) for k in ("v", "i", "j")]
        return pa.table([*map(pa.array, cell), pa.array(node[rows]), pa.array(c[rows]), pa.array(with_, pa.binary())], names=["v", "i", "j", "node", "c", "asks"])

    asking = cut(cells.groupBy("v", "i", "j").applyInArrow(run, "v long, i long, j long, node long, c long, asks binary"))
    discard(named)
    if asking.isEmpty():
        return asking.select(F.col("node").alias("a"), F.col("node").alias("b"))

    def verify(table):
        t = table.combine_chunks()
        node, c, asks, col = t.column("node").to_numpy(), t.column("c").to_numpy(), t.column("asks").to_pylist(), t.column("set")
        sets = {int(x): y.values.to_numpy().view(np.uint64) for x, y in zip(node, col, strict=True)}
        part, up, a, b = dict(zip(node.tolist(), c.tolist(), strict=True)), {}, [], []

        def root(x):
            while x in up:
                x = up[x]
            return x

        for u, ask in zip(node.tolist(), asks, strict=True):
            others = np.frombuffer(ask, np.int64).tolist() if ask else []
            for s in range(0, len(others), 64):
                mine = root(part[u])
                some = [x for x in others[s : s + 64] if root(part[x]) != mine]
                if not some:
                    continue
                sizes = np.array([len(sets[x]) for x in some])
                flat, own = np.concatenate([sets[x] for x in some]), sets[u]
                hit = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                both = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
                for k in np.flatnonzero((both > 0) & (ratio[1] * both >= ratio[0] * (sizes + len(own) - both))):
                    x, y = root(part[u]), root(part[some[k]])
                    if x != y:
                        up[x] = y
                        a.append(min(u, some[k]))
                        b.append(max(u, some[k]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    sets = sets_of(asking.select("node").distinct())
    out = cut(asking.join(sets, "node").groupBy("v", "i", "j").applyInArrow(verify, "a long, b long"))
    discard(asking, sets)
    return out


def _found(value: np.ndarray, rows: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the sorted value would stand each number of rows, and whether it has it; rows are padded."""
    at = np.searchsorted(value, rows)
    return at, (value[np.minimum(at, len(value) - 1)] == rows) & (np.arange(rows.shape[1]) < width[:, None])


def _first_shared(value: np.ndarray, rows: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The smallest number that value and each of the sorted rows share; they share one."""
    hit = _found(value, rows, width)[1]
    return rows[np.arange(len(rows)), hit.argmax(axis=1)]


def _estimates(value: np.ndarray, rows: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The part of the union's sketch that a sketch shares with each of the rows, as in _estimated."""
    at, hit = _found(value, rows, width)
    shared = np.cumsum(hit, axis=1)
    place = np.arange(1, rows.shape[1] + 1) + at - (shared - hit)  # in the sorted union, from 1
    union = np.minimum(len(value) + width - shared[:, -1], K)
    return (hit & (place <= K)).sum(axis=1) / union


def _rarest(classes: DataFrame, postings: DataFrame) -> DataFrame:
    """Entries for unmet(): of the values of long lists that a sketch has, the rarest. A pair that passes the
    estimate shares more than ESTIMATE of either sketch, so beyond all but that many it must have one in common."""
    hot = cut(hot_values(postings))
    bits = classes.sparkSession.sparkContext.broadcast(bloom(hot, "v"))

    def run(batches):
        for b in batches:
            col = b.column(b.schema.get_field_index("sketch"))
            values, width = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(col.offsets.to_numpy())
            row = np.repeat(np.arange(len(width)), width)
            hit = maybe_in(bits.value, values) if len(values) else np.zeros(0, bool)
            ok = hit & (np.bincount(row[hit], minlength=len(width)) > ESTIMATE * width)[row]
            node = b.column(b.schema.get_field_index("rep")).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node[row[ok]]), pa.array(values[ok])], names=["node", "v"])

    some = map_arrow(classes.select("rep", "sketch"), run, "node long, v long").join(hot, "v")
    rows = some.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("times", "v"))).alias("all"))
    rows = rows.join(classes.select(F.col("rep").cast("long").alias("node"), "n", "sketch"), "node")
    spare = F.size("all") - F.floor(F.size("sketch") * F.lit(ESTIMATE)).cast("int")
    rows = rows.withColumn("of", F.sort_array(F.slice("all.v", 1, F.greatest(spare, F.lit(0)))))
    out = cut(rows.where(spare > 0).select("node", "n", "of", "sketch", F.explode("of").alias("v")))
    discard(hot)
    return out


def _entries(sketch):
    """Entries (v, c1, c2) of a sketch: each value, and 16 bits of each of the eight that follow it."""
    low = lambda i: F.coalesce(F.get(sketch, i), F.lit(0)).bitwiseAND(F.lit(65535))

    def four(i):
        return F.shiftleft(low(i), 48).bitwiseOR(F.shiftleft(low(i + 1), 32)).bitwiseOR(F.shiftleft(low(i + 2), 16)).bitwiseOR(low(i + 3))

    return F.transform(sketch, lambda v, i: F.struct(v.alias("v"), four(i + 1).alias("c1"), four(i + 5).alias("c2")))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept. Ids are whole numbers.

    Null and empty texts and texts of white space have no shingles and stay alone. Rows with a null
    id aren't compared; their component is null and they are kept. Rows that share an id are one
    document. Other columns are dropped.
    """
    made = cut(sketches(docs, id_col, text_col))
    some = made.where("doc_id is not null and print is not null")
    classes = some.groupBy("print").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = cut(classes)
    postings = classes.select(F.col("rep").alias("node"), "n", F.inline(_entries(F.col("sketch"))))
    meeting = meeting_pairs(postings)
    pairs = cut(_estimated(meeting, classes))
    discard(meeting)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text"))
    sets = _sets(texts, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    met = cut(compared(pairs, sets))
    links = met.where("similar").select("a", "b")
    joined = components(links)
    entries = _rarest(classes, postings)
    more = unmet(entries, joined, lambda wanted: _sets(texts, wanted))
    discard(entries)
    if not more.isEmpty():
        discard(joined)
        joined = components(links.unionByName(more))
    discard(pairs, sets, met, more)
    named = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("print", F.coalesce("component", "rep").alias("component"))
    out = made.select("doc_id", "n_shingles", "print").join(named, "print", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    out = cut(out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")))
    discard(made, classes, joined)
    return out


def op3_neardup(spark, sf_dir: str) -> DataFrame:
    """All documents; nulls, empty texts and repeats as in groups()."""
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
