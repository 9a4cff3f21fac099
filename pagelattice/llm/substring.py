"""Substring deduplication by MinHash banding of paragraphs.

Two kinds of paragraphs are looked for, over the whole of every text.

Blocks are the stretches between line ends, from WORDS words on. Equal blocks form a class. Classes
collide by bands of ROWS MinHashes; BANDS of them find a pair of Jaccard similarity 0.75 with a
chance of 0.988, one of 0.85 with 0.9995. Colliding classes are confirmed on their full sets of word
shingles, and components of the links are the clusters. In the lists of bands that many classes have
only neighbours meet at first; the others that aren't in one component then are compared in cells.

Windows find passages that stand inside other text: from each start of a sentence, and from words
that winnowing chooses in long ones, to the first of these at least WINDOW words on, so that a passage has the same
windows wherever it stands, even where it begins and ends within sentences. Equal windows are a cluster; they meet in one global sort by (window, document), in which a frequent
window is a stretch of several range partitions and no task has to hold it.

In each cluster the document with the smallest id keeps its text and the others lose it. What is
cut is joined to stretches, and stretches of fewer than SHORTEST words are left alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import bloom, components, cut, discard, map_arrow, maybe_in, mix64, parted, partitions, shingle_hashes, word_hashes, words_of
from pagelattice.llm.neardup import confirm, hot_values, meeting_pairs, set_lists, unmet

WORDS, WINDOW, SHORTEST = 25, 12, 25
#: Words in a row of which at least one begins a window, in sentences of more than SENTENCE words;
#: sentences that follow one of fewer than CLAUSE words count as part of it.
SPREAD, SENTENCE, CLAUSE = 16, 16, 4
BANDS, ROWS = 8, 3
_SEEDS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_HIGH = np.uint64(0xFFFFFFFF00000000)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words of a text: starts and ends in characters, hashes, starts of windows and of blocks."""

    def __init__(self, text: str):
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        blank = (chars == 32) | ((chars >= 9) & (chars <= 13))
        turn = np.flatnonzero(np.diff(np.concatenate([[1], blank.astype(np.int8), [1]])))
        self.starts, self.ends = turn[::2], turn[1::2]
        self.n = len(self.starts)
        self.hashes = word_hashes(words_of(text))
        if self.n:
            lines = np.cumsum(chars == 10)
            new_line = lines[self.starts[1:]] > lines[self.ends[:-1] - 1]
            self.block_starts = np.concatenate([[0], np.flatnonzero(new_line) + 1])
            last = chars[self.ends[:-1] - 1]
            starts = np.flatnonzero(new_line | (last == 46) | (last == 33) | (last == 63)) + 1  # . ! ?
            starts = starts[np.diff(starts, prepend=-CLAUSE) >= CLAUSE]
            edges = np.concatenate([[0], starts, [self.n]])
            found = self._winnowed()
            within = np.searchsorted(edges, found, "right")
            mark = np.zeros(self.n, bool)
            mark[0] = mark[starts] = mark[found[edges[within] - edges[within - 1] > SENTENCE]] = True
            self.starts_of_windows = np.flatnonzero(mark)

    def _winnowed(self) -> np.ndarray:
        """Words whose hash is the least of some SPREAD words in a row: one in any SPREAD words, chosen by these
        words alone, so that a passage has the same ones wherever it stands."""
        if self.n < SPREAD:
            return np.zeros(0, np.int64)
        least, width = (self.hashes & _HIGH) | np.arange(self.n, dtype=np.uint64), 1
        while width < SPREAD:
            step = min(width, SPREAD - width)
            least, width = np.minimum(least[:-step], least[step:]), width + step
        at = (least & ~_HIGH).astype(np.int64)
        return at[np.append(True, at[1:] != at[:-1])]

    def windows(self, words: int = WINDOW):
        """(first word, end word, hash) of each window."""
        edges = np.append(self.starts_of_windows, self.n)
        k = np.searchsorted(edges, self.starts_of_windows + words)
        ok = k < len(edges)
        a, e = self.starts_of_windows[ok], edges[k[ok]]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.hashes * _powers(_BASE, self.n)[: self.n], dtype=np.uint64)])
        return a, e, mix64((sums[e] - sums[a]) * _powers(_INVERSE, self.n)[a] + (e - a).astype(np.uint64))

    def blocks(self, words: int = WORDS):
        """(first word, end word) of each block of enough words."""
        a, e = self.block_starts, np.append(self.block_starts[1:], self.n)
        ok = e - a >= words
        return a[ok], e[ok]


def _node(shingles: np.ndarray) -> tuple[int, np.ndarray]:
    s = np.unique(shingles)
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63), s


_PLACE = "sw int, ew int, start int, end int"


def _small(batches, rows: int = 1000):
    """The batches in pieces, so that what a worker makes of one stays small."""
    for b in batches:
        for s in range(0, b.num_rows, rows):
            yield b.slice(s, rows)


def _parts(docs: DataFrame) -> DataFrame:
    """One row per document: its windows and its blocks with their bands, as arrays."""
    schema = f"doc_id long, version long, windows array<struct<node: long, {_PLACE.replace(' int', ': int')}>>, blocks array<struct<node: long, n: int, bands: array<bigint>, {_PLACE.replace(' int', ': int')}>>"

    def lists(counts, columns, names):
        ends = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, names=names))

    def run(batches):
        for b in _small(batches):
            nw, win, nb, blk, keys = [], [], [], [], []
            for text in b.column(b.schema.get_field_index("text")):
                w = Words(text.as_py() or "")
                if not w.n:
                    nw.append(0)
                    nb.append(0)
                    continue
                a, e, h = w.windows()
                nw.append(len(a))
                win.append((h.view(np.int64), a, e, w.starts[a], w.ends[e - 1]))
                a, e = w.blocks()
                nb.append(len(a))
                if len(a):
                    shingles = shingle_hashes(w.hashes)
                    low = mix64(shingles[None, :] * _SEEDS[:, None])
                    cuts = np.stack([a, np.minimum(e - 4, len(shingles))], axis=1).ravel()
                    low = np.minimum.reduceat(np.concatenate([low, low[:, -1:]], axis=1), cuts, axis=1)[:, ::2].T.reshape(len(a), BANDS, ROWS)
                    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(a), BANDS))
                    for r in range(ROWS):
                        key = mix64(key * _SEEDS[0] + low[:, :, r])
                    keys.append(key.view(np.int64))
                    made = [_node(shingles[x : y - 4]) for x, y in zip(a, e, strict=True)]
                    blk.append((np.array([m[0] for m in made]), np.array([len(m[1]) for m in made]), a, e, w.starts[a], w.ends[e - 1]))
            cat = lambda rows, k, t: pa.array(np.concatenate([r[k] for r in rows] or [np.zeros(0)]).astype(t))
            places = ("sw", "ew", "start", "end")
            windows = lists(nw, [cat(win, 0, np.int64), *(cat(win, k, np.int32) for k in (1, 2, 3, 4))], ["node", *places])
            flat = np.concatenate(keys) if keys else np.zeros((0, BANDS), np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(flat) + 1, BANDS, dtype=np.int32)), pa.array(flat.ravel()))
            blocks = lists(nb, [cat(blk, 0, np.int64), cat(blk, 1, np.int32), bands, *(cat(blk, k, np.int32) for k in (2, 3, 4, 5))], ["node", "n", "bands", *places])
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in ("doc_id", "version")), windows, blocks], names=["doc_id", "version", "windows", "blocks"])

    return map_arrow(docs.select("doc_id", "version", "text"), run, schema)


_REPEAT = f"kind int, node long, doc_id long, {_PLACE}, version long, first_doc long, last_doc long"


class _Run:
    """The run of a node that the last batch ended in."""

    def __init__(self, node, first_doc, leading):
        self.node, self.first, self.last, self.leading = node, first_doc, first_doc, leading
        self.held, self.known = [], False  # rows of the first document, while no other has been seen


def _repeated(rows: DataFrame, made: list[DataFrame]) -> DataFrame:
    """Rows (node, doc_id, version, place) whose node more than one document has, with first_doc. made gets the
    tables that the result reads.

    rows are range-sorted by (node, doc_id), so a node's first document is at the head of its run
    and rows stream through: kind 0 is known to be repeated, kind 1 may be, in a run at an end of the
    partition that may go on in the next one. Such runs leave a summary, kind 2, and these few settle
    the rest.
    """
    # a place goes through the shuffle as two numbers, start << 32 | length
    pair = lambda a, b: F.shiftleft(F.col(a).cast("long"), 32).bitwiseOR((F.col(b) - F.col(a)).cast("long"))
    order = ["node", "doc_id", "words"]
    rows = rows.select("node", "doc_id", pair("sw", "ew").alias("words"), pair("start", "end").alias("chars"), "version")
    listed = rows.repartitionByRange(partitions(rows), *order).sortWithinPartitions(*order)
    names = ["node", "doc_id", "sw", "ew", "start", "end", "version"]
    types = [np.int64, np.int64] + [np.int32] * 4 + [np.int64]

    def run(batches):
        def out(kind, cols, first, last):
            n = len(cols[0])
            arrays = [np.full(n, kind, np.int32), *(c.astype(t) for c, t in zip(cols, types, strict=True)), *(np.broadcast_to(x, n).astype(np.int64) for x in (first, last))]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["kind", *names, "first_doc", "last_doc"])

        def extend(state, cols):
            other = cols[1] != state.first
            if other.any() and not state.known:
                state.known = True
                yield from (out(0, h, state.first, state.first) for h in state.held)
                state.held = []
            if state.known:
                yield out(0, cols, state.first, state.first)
            else:
                state.held.append(cols)
            state.last = cols[1][-1]

        def close(state, trailing=False):
            if state.leading or trailing:
                yield from (out(1, h, state.first, state.first) for h in state.held)
                yield out(2, [np.array([x]) for x in (state.node, state.first, 0, 0, 0, 0, 0)], state.first, state.last)

        state, begun = None, False
        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("node", "doc_id", "words", "chars", "version")]
            if not len(cols[0]):
                continue
            cols = cols[:2] + [x for c in cols[2:4] for x in (c >> 32, (c >> 32) + (c & 0xFFFFFFFF))] + cols[4:]
            start = np.flatnonzero(np.append(True, cols[0][1:] != cols[0][:-1]))
            bounds = np.append(start, len(cols[0]))
            at = 0
            if state is not None and cols[0][0] == state.node:
                yield from extend(state, [c[: bounds[1]] for c in cols])
                at = 1
            if at < len(start):
                if state is not None:
                    yield from close(state)
                if not begun:  # the partition's first run is kept apart
                    state = _Run(cols[0][0], cols[1][0], True)
                    yield from extend(state, [c[: bounds[1]] for c in cols])
                    begun, at = True, 1
                    if at < len(start):
                        yield from close(state)
            if at < len(start):
                inner = [c[bounds[at] : bounds[-2]] for c in cols]
                if len(inner[0]):
                    size = np.diff(bounds[at:-1])
                    first, last = (np.repeat(cols[1][k], size) for k in (bounds[at:-2], bounds[at + 1 : -1] - 1))
                    many = first != last
                    if many.any():
                        yield out(0, [c[many] for c in inner], first[many], last[many])
                state = _Run(cols[0][-1], cols[1][bounds[-2]], False)
                yield from extend(state, [c[bounds[-2] :] for c in cols])
        if state is not None:
            yield from close(state, trailing=True)

    found = cut(map_arrow(listed, run, _REPEAT))
    made.append(found)
    ends = found.where("kind = 2").groupBy("node").agg(F.min("first_doc").alias("f"), F.max("last_doc").alias("l")).where("f < l")
    rows = found.where("kind < 2").join(ends.select("node", "f"), "node", "left").where("kind = 0 or f is not null")
    return rows.select("doc_id", "version", "sw", "ew", "start", "end", F.col("node").alias("cluster_id"), F.least("first_doc", "f").alias("first_doc"))


def _block_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, set) of the blocks that wanted (node) names and some others, from the first document of each."""
    bits = bloom(wanted, "node"), bloom(classes.join(wanted.distinct(), "node").select("low"), "low")

    def run(batches):
        for b in batches:
            b = b.filter(pa.array(maybe_in(shared.value[1], b.column(b.schema.get_field_index("doc_id")).to_numpy().astype(np.int64))))
            yield from found(b)

    def found(batch):
        for b in _small([batch]):
            nodes, sets = [], []
            for text in b.column(b.schema.get_field_index("text")):
                w = Words(text.as_py() or "")
                if w.n:
                    a, e = w.blocks()
                    shingles = shingle_hashes(w.hashes)
                    made = [_node(shingles[x : y - 4]) for x, y in zip(a, e, strict=True)]
                    hit = maybe_in(shared.value[0], np.array([m[0] for m in made], np.int64))
                    nodes += [m[0] for m, h in zip(made, hit, strict=True) if h]
                    sets += [m[1] for m, h in zip(made, hit, strict=True) if h]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), set_lists(sets)], names=["node", "set"])

    shared = docs.sparkSession.sparkContext.broadcast(bits)
    return map_arrow(docs.select("doc_id", "text"), run, "node long, set array<bigint>").groupBy("node").agg(F.first("set").alias("set"))


def _near_blocks(docs: DataFrame, blocks: DataFrame, made: list[DataFrame]) -> DataFrame:
    """Rows of blocks (doc_id, version, node, place) in clusters of more than one document, with first_doc. made
    gets the tables that the result reads."""
    classes = cut(blocks.groupBy("node").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    names = F.inline(F.arrays_zip(F.col("bands").alias("v"), F.concat(F.slice("bands", 2, BANDS), F.slice("bands", 1, 1)).alias("c1")))
    postings = classes.select(names, F.lit(0).cast("long").alias("c2"), "node", F.col("n").cast("long").alias("n"))
    pairs = meeting_pairs(postings)
    links = cut(confirm(pairs, _block_sets(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("node")))))
    joined = components(links)
    some = postings.select("node", "n", "v").join(hot_values(postings), "v").groupBy("node", "n").agg(F.sort_array(F.collect_list("v")).alias("of"))
    entries = cut(some.select("node", "n", "of", F.array().cast("array<bigint>").alias("sketch"), F.explode("of").alias("v")))
    more = unmet(entries, joined, lambda wanted: _block_sets(docs, classes, wanted))
    if not more.isEmpty():
        discard(joined)
        joined = components(links.unionByName(more))
    made += [classes, pairs, links, entries, more, joined]
    member = classes.select("node", "low", "high").join(joined, "node", "left").withColumn("cluster_id", F.coalesce("component", "node"))
    cluster = member.groupBy("cluster_id").agg(F.min("low").alias("first_doc"), F.max("high").alias("last_doc")).where("first_doc < last_doc")
    member = member.select("node", "cluster_id").join(cluster.select("cluster_id", "first_doc"), "cluster_id")
    return blocks.select("doc_id", "version", "sw", "ew", "start", "end", "node").join(member, "node").select("doc_id", "version", "sw", "ew", "start", "end", "cluster_id", "first_doc")


def _told_apart(docs: DataFrame, made: list[DataFrame]) -> DataFrame:
    """docs (doc_id, text) with version: 0, or a hash of the text where an id has several texts, so that places in one
    text are never taken for places in another. made gets the table of these ids, mostly empty."""
    prints = docs.select("doc_id", F.xxhash64("text").alias("print")).groupBy("doc_id").agg(F.min("print").alias("low"), F.max("print").alias("high"))
    several = cut(prints.where("low <> high").select("doc_id", F.lit(True).alias("several")))
    made.append(several)
    version = F.when(F.col("several"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))
    return docs.join(several, "doc_id", "left").select("doc_id", version.alias("version"), "text")


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Repeated passages: doc_id, start, end (characters of the text), n_words, removed, cluster_id, first_doc, version.

    One row per stretch of clustered paragraphs of a document: removed where another document with
    a smaller id keeps the passage, and not where this one does. A stretch of several clusters
    bears the smallest cluster id and first document. Null ids and null, empty or short texts have no
    rows; rows that share an id are one document, and repeats within a document are left alone. Where
    their texts differ, version is the xxhash64 of the text that the place is in, and 0 elsewhere. Other columns are ignored.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    made: list[DataFrame] = []
    parts = cut(_parts(_told_apart(docs, made)))
    windows = _repeated(parts.select("doc_id", "version", F.inline("windows")), made)
    blocks = _near_blocks(docs, parts.select("doc_id", "version", F.inline("blocks")), made)
    spans = windows.unionByName(blocks).withColumn("removed", F.col("doc_id") != F.col("first_doc"))
    grouped = spans.groupBy("doc_id", "version", "removed").agg(F.collect_list(F.struct("sw", "ew", "start", "end", "cluster_id", "first_doc")).alias("p"))
    schema = "doc_id long, version long, removed boolean, start int, end int, n_words int, cluster_id long, first_doc long"

    def merge(batches):
        for b in _small(batches):
            lists = b.column(b.schema.get_field_index("p"))
            spans, row = lists.flatten(), np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            get = {c: spans.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("sw", "ew", "start", "end", "cluster_id", "first_doc")}
            order = np.lexsort((get["sw"], row))
            row, get = row[order], {c: v[order] for c, v in get.items()}
            # a stretch begins where no span before it in the document reaches; rows rise, so one running maximum serves
            reach = np.maximum.accumulate((row << 32) + get["ew"])
            first = np.flatnonzero(np.append(True, ((row << 32) + get["sw"])[1:] > reach[:-1])) if len(row) else np.zeros(0, int)
            if not len(first):
                continue
            out = {c: np.minimum.reduceat(get[c], first) for c in ("sw", "start", "cluster_id", "first_doc")} | {c: np.maximum.reduceat(get[c], first) for c in ("ew", "end")}
            words = out["ew"] - out["sw"]
            ok, at = words >= SHORTEST, pa.array(row[first])
            columns = [b.column(b.schema.get_field_index(c)).take(at) for c in ("doc_id", "version", "removed")]
            columns += [pa.array(x.astype(t)) for x, t in ((out["start"], np.int32), (out["end"], np.int32), (words, np.int32), (out["cluster_id"], np.int64), (out["first_doc"], np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")]).filter(pa.array(ok))

    out = cut(map_arrow(grouped, merge, schema).select("doc_id", "start", "end", "n_words", "removed", "cluster_id", "first_doc", "version"))
    discard(parts, *made)
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with the removed passages cut out of their texts, and length_col set anew where a text
    changed. All rows and columns stay; a text may become empty. Rows that share an id lose what is
    repeated in their own text. Texts that lose nothing are not shuffled."""
    removed = passages(docs, id_col, text_col).where("removed")
    some, others = parted(docs, id_col, removed.select("doc_id"))
    gone = removed.groupBy("doc_id", "version").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_gone"))
    mine = (F.col(id_col) == F.col("_id")) & ((F.col("_version") == 0) | (F.col("_version") == F.xxhash64(text_col)))
    joined = some.join(gone.withColumnsRenamed({"doc_id": "_id", "version": "_version"}), mine, "left")
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    part = lambda a, b: F.substring(F.col(text_col), a + 1, b - a)
    kept = F.aggregate("_gone", start, lambda acc, g: F.struct(F.concat(acc["text"], part(acc["at"], g["start"])).alias("text"), g["end"].alias("at")), lambda acc: F.concat(acc["text"], part(acc["at"], F.lit(2**31 - 1))))
    out = joined.withColumn("_text", F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(kept))
    if length_col:
        out = out.withColumn(length_col, F.when(F.col("_gone").isNull(), F.col(length_col)).otherwise(F.char_length("_text").cast(docs.schema[length_col].dataType)))
    return out.withColumn(text_col, F.col("_text")).select(*docs.columns).unionByName(others)


def op6_substring(spark, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents; nulls, ties and repeats as in passages()."""
    return passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
