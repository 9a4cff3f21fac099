"""Context-tree weighting of bytes: code lengths of whole texts under a model of the training texts.

A text is its words in lower case (A-Z only), one blank between two, and a line end. Each byte is
eight binary decisions; each decision has a context tree over the DEPTH bytes before it, with a
Krichevsky-Trofimov estimate at every node and the CTW mixture of all depths (Willems, Shtarkov and
Tjalkens, 1995); below the deepest node that the training texts have, that node's estimate stands
alone. Nothing is pruned: every context of the corpus is in the model, which is never in one place.

1. Texts are gathered in blocks. A block asks for each distinct string of DEPTH + 1 bytes that it has,
   the byte before last first, so that a context's children follow it in the order of the strings; it
   says how often its training texts have it. Questions are packed by the two bytes before the last.
2. All questions of two such bytes meet in a stream, which merges them to the counts of a subtree. Its
   roots, at depth 2, add up to the nodes of depths 1 and 0: 65,280 and 255 of them at most, whatever
   the corpus, and these alone go to the driver and to all workers.
3. Each subtree, computed again from its counts, answers its questions, and the answers go back to
   their blocks, where each text's score is summed.

Words are counted and looked up the same way, for the unigram base.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import cut, discard, map_arrow, partitions, word_hashes, words_of

DEPTH = 5
#: Bytes of the texts of a block, about, and of the slices that it is handled in.
BLOCK, PIECE = 16 << 20, 1 << 18
#: Strings that are held unmerged, and those of subtrees that are worked out at a time, about.
HELD, LOT = 1 << 16, 1 << 17
_BELOW = DEPTH - 2
_END = np.uint64(xxhash.xxh64_intdigest(b""))  # no word is empty
_LN2 = np.log(2.0)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    shift = np.zeros_like(x)
    for k in range(7):
        shift += np.log(x + k)
    z = x + 7
    r = 1 / (z * z)
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / z - shift


_SMALL = 64
_HALVES = _log_gamma(np.arange(_SMALL) + 0.5)
_WHOLES = _log_gamma(np.arange(2 * _SMALL) + 1.0)


def _log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    out = np.empty(len(n0))
    small = (n0 < _SMALL) & (n1 < _SMALL)
    a, b = n0[small].astype(np.int64), n1[small].astype(np.int64)
    out[small] = _HALVES[a] + _HALVES[b] - _WHOLES[a + b] - np.log(np.pi)
    a, b = n0[~small].astype(np.float64), n1[~small].astype(np.float64)
    out[~small] = _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1) - np.log(np.pi)
    return out


def _mixed(own: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The weight of a node's own estimate, and the log of the mixture."""
    return 1 / (1 + np.exp(np.clip(split - own, -700, 700))), np.logaddexp(own, split) - _LN2


def _summed(keys: np.ndarray, values: np.ndarray):
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(values[order], first) if len(first) else values


class Merged:
    """Sums of values by key, from many parts."""

    def __init__(self, kind=np.int64, held: int | None = None):
        self.parts, self.size, self.kind, self.held = [], 0, kind, HELD if held is None else held

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.parts.append((keys, values))
        self.size += len(keys)
        if len(self.parts) > 1 and self.size > len(self.parts[0][0]) * 3 // 2 + self.held:
            self.all()

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        parts = self.parts or [(np.zeros(0, self.kind), np.zeros(0, np.int64))]
        if len(parts) > 1:
            parts = [_summed(np.concatenate([k for k, _ in parts]), np.concatenate([v for _, v in parts]))]
        self.parts, self.size = parts, len(parts[0][0])
        return parts[0]


class Ranged:
    """Sums of values by string. Strings with the same byte before last are merged apart from others, so
    that a merge needs little beside what is held."""

    def __init__(self):
        self.of: dict[int, Merged] = {}

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """keys are sorted."""
        first = np.flatnonzero(np.diff(keys >> 40, prepend=-1))
        for s, e in zip(first, np.append(first, len(keys))[1:], strict=True):
            of = self.of.setdefault(int(keys[s] >> 40), Merged(held=HELD // 8))
            of.add(keys[s:e].copy(), values[s:e].astype(np.int32))

    def all(self):
        """(keys, values) of one range after the other; none is held any more."""
        for k in sorted(self.of):
            yield self.of.pop(k).all()


def _lots(sizes: list[int]):
    """(first, end) of numbers in a row whose sizes are LOT together, or of one that is larger."""
    first, size = 0, 0
    for k, n in enumerate(sizes):
        if k > first and size + n > LOT:
            yield first, k
            first, size = k, 0
        size += n
    if sizes:
        yield first, len(sizes)


def pack(x: np.ndarray) -> bytes:
    """Bytes by place, so that high bytes, which are alike, stand together."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unpack(data, kind) -> np.ndarray:
    flat = np.frombuffer(data, np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def stream(words: list[bytes]) -> bytes:
    return b" ".join(words) + b"\n"


class Strings:
    """The strings of DEPTH + 1 bytes of texts, each of which begins after line ends."""

    def __init__(self, texts: list[bytes]):
        pad = b"\n" * DEPTH
        self.blob = np.frombuffer(pad + pad.join(texts), np.uint8)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.sizes + DEPTH) - self.sizes

    def slices(self):
        """(text numbers, codes) of the bytes of a slice: the bytes before, the nearest first, then the byte."""
        for at in range(DEPTH, len(self.blob), PIECE):
            to = min(at + PIECE, len(self.blob))
            code = np.zeros(to - at, np.int64)
            for j in range(1, DEPTH + 1):
                code = (code << 8) | self.blob[at - j : to - j]
            code = (code << 8) | self.blob[at:to]
            low, high = np.searchsorted(self.starts, (at, to - 1), "right")
            new = np.zeros(to - at, np.int64)
            new[self.starts[low:high] - at] = 1
            text = low - 1 + np.cumsum(new)
            inside = np.arange(at, to) < (self.starts + self.sizes)[text]
            yield text[inside], code[inside]


class Level:
    """Nodes of one depth: for each of the eight decisions, counts and places among the rows (context, byte)."""

    def __init__(self, rows: np.ndarray, n: np.ndarray):
        self.rows, self.n, self.decisions = rows, n, []
        for k in range(8):
            key = rows >> (8 - k)
            new = np.append(True, key[1:] != key[:-1])
            start = np.flatnonzero(new)
            n1 = np.add.reduceat(n * ((rows >> (7 - k)) & 1), start)
            self.decisions.append({"start": start, "node": np.cumsum(new) - 1, "n1": n1, "n0": np.add.reduceat(n, start) - n1})


class Subtrees:
    """The parts of the tree below contexts of two bytes, each with all its codes. codes: the context and
    the byte, sorted and distinct; n: how often the training texts have them, which may be 0."""

    def __init__(self, codes: np.ndarray, n: np.ndarray):
        level, self.levels, self.up = Level(codes, n), [], [None]
        self.levels.append(level)
        for _ in range(_BELOW):  # one byte of the context less each time
            key, back = np.unique(((level.rows >> 16) << 8) | (level.rows & 255), return_inverse=True)
            level = Level(key, np.bincount(back, level.n, len(key)).astype(np.int64))
            self.levels.insert(0, level)
            self.up.insert(1, back)
        for d in range(_BELOW, -1, -1):
            for k, here in enumerate(self.levels[d].decisions):
                here["own"], here["log"] = np.ones(len(here["start"])), _log_kt(here["n0"], here["n1"])
                if d < _BELOW:
                    split = np.bincount(self.parent(d + 1, k), self.levels[d + 1].decisions[k]["log"], len(here["start"]))
                    here["own"], here["log"] = _mixed(here["log"], split)

    def parent(self, d: int, k: int) -> np.ndarray:
        below = self.levels[d].decisions[k]
        return self.levels[d - 1].decisions[k]["node"][self.up[d][below["start"]]]

    def top(self, k: int) -> np.ndarray:
        """256 x last byte + node, the parents of the nodes of depth 2."""
        rows = self.levels[0].rows[self.levels[0].decisions[k]["start"]]
        return ((rows >> 16) << 8) | (1 << k) | ((rows & 255) >> (8 - k))

    def roots(self):
        """(parent, n0, n1, log of the mixtures): sums of the nodes of depth 2."""
        parent, back = np.unique(np.concatenate([self.top(k) for k in range(8)]), return_inverse=True)
        return parent, *(np.bincount(back, np.concatenate([x[c] for x in self.levels[0].decisions]), len(parent)) for c in ("n0", "n1", "log"))

    def log10(self, above) -> np.ndarray:
        """log10 P(byte | context) of each code. above: (acc, part, stop) of depth 1, by parent."""
        total = np.zeros(len(self.levels[-1].rows))
        for k in range(8):
            for d, level in enumerate(self.levels):
                x = level.decisions[k]
                up, over = (self.top(k), above) if d == 0 else (self.parent(d, k), here)
                here = _descend(x["n0"], x["n1"], x["own"], *(v[up] for v in over))
            one = here[0][x["node"]]
            total += np.log10(np.where((level.rows >> (7 - k)) & 1, one, 1 - one))
        return total


def _descend(n0, n1, own, acc, part, stop):
    """What the mixture down to a node gives to bit 1 (acc), what is left for the nodes below it (part), and
    the probability where the path ends here (stop). A node without counts ends the path above it."""
    seen = n0 + n1 > 0
    one = (n1 + 0.5) / (n0 + n1 + 1.0)
    return np.where(seen, acc + part * own * one, stop), np.where(seen, part * (1 - own), 0.0), np.where(seen, acc + part * one, stop)


def upper(parent: np.ndarray, n0: np.ndarray, n1: np.ndarray, split: np.ndarray) -> np.ndarray:
    """(acc, part, stop), each by 256 x last byte + node, from the counts of depth 1 and the sums of the logs below."""
    at = np.zeros((3, 256 * 256))
    at[:, parent] = n0, n1, split
    at = at.reshape(3, 256, 256)
    own, log = _mixed(_log_kt(at[0].ravel(), at[1].ravel()).reshape(256, 256), at[2])
    top = at[:2].sum(axis=1)
    top_own, _ = _mixed(_log_kt(*top), log.sum(axis=0))
    half = np.full(256, 0.5)
    root = _descend(*top, top_own, np.zeros(256), np.ones(256), half)
    return np.stack(_descend(at[0], at[1], own, *(np.broadcast_to(v, (256, 256)) for v in root))).reshape(3, -1)


def _rows(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Blocks (kind 0: ids, sizes, texts), and their questions: strings (kind 1) and words (kind 2), by group."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        task, made, schema = TaskContext.get().partitionId(), 0, None

        def block(ids, train, streams, id_type):
            nonlocal schema
            schema = pa.schema([("block", pa.string()), ("kind", pa.int32()), ("g", pa.int32()), ("ids", pa.list_(id_type)), ("sizes", pa.binary()), ("a", pa.binary()), ("b", pa.binary())])
            name, learn = f"{task}-{made}", np.array(train)
            held, held_words = Ranged(), Merged()
            strings = Strings(streams)
            for text, code in strings.slices():
                ok = learn[text]
                held.add(*np.unique(code[ok], return_counts=True))
                rest = np.unique(code[~ok])
                held.add(rest, np.zeros(len(rest), np.int64))
            for s in range(0, len(streams), 256):
                words = [w for t in streams[s : s + 256] for w in [*t.split(), b""]]
                ok = np.repeat(learn[s : s + 256], [t.count(b" ") + (2 if len(t) > 1 else 1) for t in streams[s : s + 256]])
                hashes = word_hashes(words).view(np.int64)
                held_words.add(*np.unique(hashes[ok], return_counts=True))
                rest = np.unique(hashes[~ok])
                held_words.add(rest, np.zeros(len(rest), np.int64))
            blob = zstandard.ZstdCompressor(level=1).compress(b"".join(streams))
            yield _rows({"block": [name], "kind": [0], "g": [0], "ids": [ids], "sizes": [pack(strings.sizes)], "a": [blob], "b": [None]}, schema)
            for codes, n in held.all():
                yield from questions(name, 1, codes >> 32, (codes & 0xFFFFFFFF).astype(np.uint32), n)
            words, m = held_words.all()
            order = np.argsort(words & 255, kind="stable")
            yield from questions(name, 2, words[order] & 255, words[order], m[order])

        def questions(name, kind, group, keys, values):
            start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            stop = np.append(start[1:], len(keys))
            rows = {"block": [name] * len(start), "kind": [kind] * len(start), "g": group[start], "ids": [None] * len(start), "sizes": [None] * len(start)}
            rows["a"], rows["b"] = [pack(keys[s:e]) for s, e in zip(start, stop, strict=True)], [pack(values[s:e].astype(np.int64)) for s, e in zip(start, stop, strict=True)]
            yield _rows(rows, schema)

        ids, train, streams, size, id_type = [], [], [], 0, None
        for b in batches:
            column = lambda c, b=b: b.column(b.schema.get_field_index(c))
            id_type = column(id_col).type
            for i, t, ok in zip(column(id_col).to_pylist(), column(text_col), column("learn").to_pylist(), strict=True):
                ids.append(i)
                train.append(bool(ok))
                streams.append(stream(words_of(t.as_py())))
                size += len(streams[-1])
                if size >= BLOCK:
                    yield from block(ids, train, streams, id_type)
                    ids, train, streams, size = [], [], [], 0
                    made += 1
        if ids:
            yield from block(ids, train, streams, id_type)

    return map_arrow(docs, run, f"block string, kind int, g int, ids array<{kind}>, sizes binary, a binary, b binary")


_KEY = {1: np.uint32, 2: np.int64}
#: Groups of a partition are handled together in so many parts.
_PARTS = 8


def _met(asks: DataFrame, *order) -> DataFrame:
    """Rows of a group in one partition, by (part, *order); part is a share of the partition's groups."""
    part = F.pmod(F.xxhash64("kind", "g"), F.lit(_PARTS)).alias("part")
    return asks.select("*", part).repartition("kind", "g").sortWithinPartitions("part", *order)


def _whole(g: int, keys: np.ndarray) -> np.ndarray:
    return keys.astype(np.int64) | (np.int64(g) << 32)


def _by(batches, keys, values):
    """(key, row) of sorted batches, row: values by name."""
    for b in batches:
        at = {c: b.column(b.schema.get_field_index(c)) for c in (*keys, *values)}
        for r, key in enumerate(zip(*(at[c].to_pylist() for c in keys), strict=True)):
            yield key, {c: at[c][r] for c in values}


def _model(asks: DataFrame) -> DataFrame:
    """(kind, g, a, b, parent, n0, n1, log): all questions of a group merged, and sums for the nodes above, which
    some rows have. For words, n0 is their number in the training texts and n1 that of distinct ones."""
    schema = pa.schema([("kind", pa.int32()), ("g", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("parent", pa.list_(pa.int32())), ("n0", pa.list_(pa.int64())), ("n1", pa.list_(pa.int64())), ("log", pa.list_(pa.float64()))])

    def run(batches):
        part, held = None, {}

        def done():
            got = {key: m.all() for key, m in held.items()}
            strings = [(_whole(g, keys), n) for (kind, g), (keys, n) in got.items() if kind == 1]
            above = []
            for s, e in _lots([len(n) for _, n in strings]):
                parent, n0, n1, log = Subtrees(*(np.concatenate(x) for x in zip(*strings[s:e], strict=True))).roots()
                above.append((1, parent, n0.astype(np.int64), n1.astype(np.int64), log))
            above += [(2, np.zeros(1), np.array([n.sum()]), np.array([(n > 0).sum()]), np.zeros(1)) for (kind, _), (_, n) in got.items() if kind == 2]
            for (kind, g), (keys, n) in got.items():
                yield _rows(dict(zip(schema.names, ([kind], [g], [pack(keys)], [pack(n)], *[[None]] * 4), strict=True)), schema)
            for kind, *sums in above:
                yield _rows(dict(zip(schema.names, ([kind], [None], [None], [None], *([x] for x in sums)), strict=True)), schema)

        for (now, *key), row in _by(batches, ("part", "kind", "g"), ("a", "b")):
            if now != part:
                yield from done()
                part, held = now, {}
            kind = _KEY[key[0]]
            held.setdefault(tuple(key), Merged(kind)).add(unpack(row["a"].as_buffer(), kind), unpack(row["b"].as_buffer(), np.int64))
        yield from done()

    return map_arrow(_met(asks.select("kind", "g", "a", "b"), "kind", "g"), run, "kind int, g int, a binary, b binary, parent array<int>, n0 array<bigint>, n1 array<bigint>, log array<double>")


def _answers(asks: DataFrame, model: DataFrame, above: np.ndarray) -> DataFrame:
    """(block, kind, g, a, b): the questions again, with the log10 probability or the count of each."""
    shared = asks.sparkSession.sparkContext.broadcast(above)
    both = model.where("g is not null").select(F.lit(None).cast("string").alias("block"), "kind", "g", "a", "b").union(asks.select("block", "kind", "g", "a", F.lit(None).cast("binary").alias("b")))
    met = _met(both, F.col("block").asc_nulls_first(), "kind", "g")
    schema = pa.schema([("block", pa.string()), ("kind", pa.int32()), ("g", pa.int32()), ("a", pa.binary()), ("b", pa.binary())])

    def run(batches):
        part, known, open_, rows, size = None, {}, False, {c: [] for c in schema.names}, 0

        def answered():
            strings = [key for key in known if key[0] == 1]
            for s, e in _lots([len(known[key][0]) for key in strings]):
                mine = strings[s:e]
                logs = Subtrees(np.concatenate([_whole(g, known[1, g][0]) for _, g in mine]), np.concatenate([known[k][1] for k in mine])).log10(shared.value)
                for key, some in zip(mine, np.split(logs, np.cumsum([len(known[k][0]) for k in mine])[:-1]), strict=True):
                    known[key] = known[key][0], some.astype(np.float32)

        for (now, block, *key), row in _by(batches, ("part", "block", "kind", "g"), ("a", "b")):
            key = tuple(key)
            asked = unpack(row["a"].as_buffer(), _KEY[key[0]])
            if now != part:
                part, known, open_ = now, {}, True
            if block is None:
                known[key] = asked, unpack(row["b"].as_buffer(), np.int64)
                continue
            if open_:
                answered()
                open_ = False
            keys, values = known[key]
            for c, x in zip(schema.names, (block, *key, row["a"].as_py(), pack(values[np.searchsorted(keys, asked)])), strict=True):
                rows[c].append(x)
            size += len(asked)
            if size > HELD:
                yield _rows(rows, schema)
                rows, size = {c: [] for c in schema.names}, 0
        if size:
            yield _rows(rows, schema)

    return map_arrow(met, run, "block string, kind int, g int, a binary, b binary")


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes.

    The model is that of the texts where `learn` holds (null: it doesn't). score is log10 of the model's
    probability of the text, base_score that of an add-one unigram model over words. Null and empty texts
    are one end token. Null or repeated ids and rows each keep a row; repeated training rows count each.
    Other columns are dropped, whatever their names. Without training texts each bit has probability 1/2.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    made = cut(_blocks(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn")), "id", "text"))
    asks = made.where("kind > 0")
    model = cut(_model(asks))
    totals = model.where("kind = 2").agg(F.sum(F.col("n0")[0]).alias("n"), F.sum(F.col("n1")[0]).alias("v")).first()
    n, v = int(totals.n or 0), int(totals.v or 0)
    each = model.where("kind = 1 and parent is not null").select(F.inline(F.arrays_zip("parent", "n0", "n1", "log")))
    top = each.groupBy("parent").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "log"))).toArrow()  # 65,280 rows at most
    above = upper(*(top.column(c).to_numpy() for c in ("parent", "n0", "n1", "log")))
    texts = made.where("kind = 0").select("block", "kind", "g", "ids", "sizes", "a", "b")
    said = _answers(asks, model, above).select("block", "kind", "g", F.lit(None).cast(f"array<{kind}>").alias("ids"), F.lit(None).cast("binary").alias("sizes"), "a", "b")
    # more partitions than blocks, so that few get several, as Spark makes one batch of all their rows
    met = texts.union(said).repartition(2 * partitions(asks), "block").sortWithinPartitions("block", "kind", "g")
    base = np.log10(float(n + v + 1))

    def run(batches):
        def done(text, held):
            ids, sizes, blob = text
            codes, logs = (np.concatenate(held[1][k]) for k in (0, 1))
            words, counts = (np.concatenate(held[2][k]) for k in (0, 1))
            held.clear()
            order = np.argsort(words, kind="stable")
            words, counts = words[order], counts[order]
            raw = zstandard.ZstdDecompressor().decompress(blob)
            ends = np.cumsum(sizes).tolist()
            streams = [raw[e - s : e] for s, e in zip(sizes.tolist(), ends, strict=True)]
            del raw
            total = np.zeros(len(sizes))
            for at, code in Strings(streams).slices():
                unique, back = np.unique(code, return_inverse=True)
                total += np.bincount(at, logs[np.searchsorted(codes, unique)][back], len(sizes))
            n_tokens, known, known_score = [], [], []
            for s in range(0, len(streams), 256):
                some = [[*t.split(), b""] for t in streams[s : s + 256]]
                size = np.array([len(w) for w in some])
                c = counts[np.searchsorted(words, word_hashes([w for ws in some for w in ws]).view(np.int64))]
                first = np.cumsum(size) - size
                n_tokens.append(size)
                known.append(np.add.reduceat((c > 0).astype(np.int64), first))
                known_score.append(np.add.reduceat(np.log10(c + 1.0) - base, first))
            columns = [ids, *(pa.array(np.concatenate(x)) for x in (n_tokens, known)), pa.array(np.full(len(sizes), n)), pa.array(np.concatenate(known_score)), pa.array(total), pa.array(sizes)]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"])

        now, text, held = None, None, None
        for (block, which, g), row in _by(batches, ("block", "kind", "g"), ("ids", "sizes", "a", "b")):
            if block != now:
                if now is not None:
                    yield done(text, held)
                ids = row["ids"].values  # copied, as what is part of a batch holds all of it
                text = pa.array(ids.to_pylist(), ids.type), unpack(row["sizes"].as_buffer(), np.int64), row["a"].as_py()
                now, held = block, {1: ([], []), 2: ([], [])}
                continue
            keys = unpack(row["a"].as_buffer(), _KEY[which])
            held[which][0].append(_whole(g, keys) if which == 1 else keys)
            held[which][1].append(unpack(row["b"].as_buffer(), np.float32 if which == 1 else np.int64))
        if now is not None:
            yield done(text, held)

    out = cut(map_arrow(met, run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"))
    discard(made, model)
    return out


def held_out(col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def op4_ctw(spark, sf_dir: str) -> DataFrame:
    """All documents: the columns of score() and held_out, false for a null id; nulls and repeats as there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, ~held_out()).withColumn("held_out", held_out())
