"""TIFF media columns: a writer and a reader of image directories, one row per page.

The reader walks the chain of image file directories in either byte order, and decodes strips or
tiles that are stored plain or packed by PackBits, LZW or deflate, with the horizontal (2) or
floating-point (3) predictor.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagelattice.llm.common import map_arrow

WIDTH = 192
ROWS_PER_PAGE = 2048
ROWS_PER_STRIP = 128

# Fixed values of the TIFF 6.0 format: field type -> (bytes, struct code)
_TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d")}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
_CLEAR, _END = 256, 257
#: Bytes that one of a file may stand for: deflate packs up to 1,032 into one and LZW about 2,700, so pages that
#: declare more than this are damaged.
MOST_PACKED = 4096


class TiffError(ValueError):
    """The bytes aren't a TIFF file that this reader knows."""


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while i + run < n and run < 128 and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i
        while j < n and j - i < 128 and not (j + 2 < n and data[j] == data[j + 1] == data[j + 2]):
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def unpack_bits(data: bytes, most: int | None = None) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n and (most is None or len(out) < most):
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += head + 2
        else:
            if head > 128 and i + 1 < n:
                out += data[i + 1 : i + 2] * (257 - head)
            i += 1 if head == 128 else 2
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    out, acc, bits, width = bytearray(), 0, 0, 9
    table: dict[bytes, int] = {}

    def put(code):
        nonlocal acc, bits
        acc, bits = (acc << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append((acc >> bits) & 255)
        acc &= (1 << bits) - 1

    def reset():
        nonlocal table, width
        put(_CLEAR)
        table, width = {bytes((i,)): i for i in range(256)}, 9

    reset()
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        put(table[word])
        table[longer] = len(table) + 2
        size = len(table) + 2
        if size >= 4095:
            reset()
        elif size >= 1 << width and width < 12:
            width += 1
        word = data[i : i + 1]
    if word:
        put(table[word])
        if len(table) + 3 >= 1 << width and width < 12:
            width += 1
    put(_END)
    if bits:
        out.append((acc << (8 - bits)) & 255)
    return bytes(out)


def unpack_lzw(data: bytes, most: int | None = None) -> bytes:
    out, acc, bits, width, last, size = [], 0, 0, 9, b"", 0
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    table = list(first)
    for byte in data:
        acc, bits = (acc << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == _END:
            break
        if code == _CLEAR:
            table, width, last = list(first), 9, b""
            continue
        if not last:
            word = table[code]
        else:
            if code > len(table):
                raise TiffError("LZW code beyond the table")
            word = table[code] if code < len(table) else last + last[:1]
            table.append(last + word[:1])
            if len(table) >= (1 << width) - 1 and width < 12:
                width += 1
        out.append(word)
        last, size = word, size + len(word)
        if most is not None and size >= most:
            break
    return b"".join(out)


def _compress(data: bytes, scheme: int, row: int) -> bytes:
    if scheme == NONE:
        return data
    if scheme == LZW:
        return pack_lzw(data)
    if scheme == PACKBITS:  # rows are packed separately
        return b"".join(pack_bits(data[i : i + row]) for i in range(0, len(data), row))
    return zlib.compress(data, 1)


def _expand(data: bytes, scheme: int, most: int) -> bytes:
    """A strip or tile, of which no more than about `most` bytes are made."""
    if scheme == NONE:
        return data
    if scheme == LZW:
        return unpack_lzw(data, most)
    if scheme == PACKBITS:
        return unpack_bits(data, most)
    if scheme in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, most)
    raise TiffError(f"compression {scheme}")


def write_tiff(pages: list[np.ndarray], scheme: int = DEFLATE, predictor: int = 2, rows_per_strip: int = ROWS_PER_STRIP, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """Pages are arrays (rows, columns) or (rows, columns, samples) of uint8 or uint16, the
    latter in chunky planes. tile: (rows, columns) of tiles instead of strips."""
    out = bytearray(b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 0)
    link = 4
    for page in pages:
        cube = page if page.ndim == 3 else page[:, :, None]
        height, width, samples = cube.shape
        bits = cube.dtype.itemsize * 8
        th, tw = tile or (min(rows_per_strip, max(height, 1)), width)
        parts = []
        for top in range(0, height, th):
            for left in range(0, width, tw):
                block = cube[top : top + th, left : left + tw]
                if tile:
                    block = np.pad(block, ((0, th - block.shape[0]), (0, tw - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
                parts.append(_compress(np.ascontiguousarray(block).astype(block.dtype.newbyteorder(order), copy=False).tobytes(), scheme, block.shape[1] * samples * cube.dtype.itemsize))
        offsets = []
        for part in parts:
            offsets.append(len(out))
            out += part
        sizes = [len(p) for p in parts]
        where = [(322, 4, [tw]), (323, 4, [th]), (324, 4, offsets), (325, 4, sizes)] if tile else [(273, 4, offsets), (278, 4, [th]), (279, 4, sizes)]
        tags = [(256, 4, [width]), (257, 4, [height]), (258, 3, [bits] * samples), (259, 3, [scheme]), (262, 3, [2 if samples >= 3 else 1]), (277, 3, [samples]), (284, 3, [1]), (317, 3, [predictor]), *where]
        body = b""
        entries = []
        out += b"\0" * (len(out) % 2)
        at = len(out) + 2 + 12 * len(tags) + 4
        for tag, kind, values in sorted(tags):
            raw = struct.pack(f"{order}{len(values)}{_TYPES[kind][1]}", *values)
            if len(raw) > 4:
                entries.append(struct.pack(order + "HHII", tag, kind, len(values), at + len(body)))
                body += raw + b"\0" * (len(raw) % 2)
            else:
                entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        link = len(out) + 2 + 12 * len(tags)
        out += struct.pack(order + "H", len(tags)) + b"".join(entries) + struct.pack(order + "I", 0) + body
    return bytes(out)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple], int]:
    (count,) = struct.unpack_from(order + "H", data, at)
    tags = {}
    for k in range(count):
        pos = at + 2 + 12 * k
        tag, kind, n = struct.unpack_from(order + "HHI", data, pos)
        if kind not in _TYPES:
            continue
        size, code = _TYPES[kind]
        start = pos + 8 if n * size <= 4 else struct.unpack_from(order + "I", data, pos + 8)[0]
        tags[tag] = struct.unpack_from(f"{order}{n * len(code)}{code[0]}", data, start)
    return tags, struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]


def _undo(block: np.ndarray, predictor: int) -> np.ndarray:
    if predictor == 2:
        return np.cumsum(block, axis=1, dtype=block.dtype)
    return block


def read_pages(data: bytes):
    """Yields (array (rows, columns, samples), scheme, predictor) for each directory in the chain.

    Files that aren't whole, that declare no or impossible sizes, or more samples than their bytes can
    stand for, in one page or all, end in an error before anything of that size is made.
    """
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise TiffError("no TIFF header")
    order = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen, declared = set(), 0
    while at and at not in seen:
        seen.add(at)
        tags, at = _directory(data, at, order)
        one = lambda tag, other=None, tags=tags: tags.get(tag, (other,))[0]
        width, height, samples, scheme, predictor = one(256), one(257), one(277, 1), one(259, 1), one(317, 1)
        bits, form, planes = one(258, 1), one(339, 1), one(284, 1)
        if predictor not in (1, 2, 3):
            raise TiffError(f"predictor {predictor}")
        if bits not in (8, 16, 32, 64) or planes != 1 and samples > 1:
            raise TiffError(f"{bits} bits in planes of kind {planes}")
        kind = np.dtype(f"{order}{'f' if form == 3 else 'i' if form == 2 else 'u'}{bits // 8}")
        tiled = 322 in tags
        tw, th = (one(322), one(323)) if tiled else (width, min(one(278, height), height))
        if not all(isinstance(x, int) and x > 0 for x in (width, height, samples, tw, th)):
            raise TiffError(f"size {width} by {height} by {samples} in parts of {tw} by {th}")
        declared += max(width * height, tw * th) * samples * kind.itemsize
        if declared > MOST_PACKED * len(data):
            raise TiffError(f"{declared} bytes of samples in a file of {len(data)}")
        offsets, sizes = (tags[324], tags[325]) if tiled else (tags[273], tags[279])
        across = -(-width // tw)
        if len(offsets) != across * -(-height // th):
            raise TiffError(f"{len(offsets)} parts")
        page = np.zeros((height, width, samples), kind.newbyteorder("="))
        for k, (start, size) in enumerate(zip(offsets, sizes, strict=True)):
            top, left = k // across * th, k % across * tw
            rows = th if tiled else min(th, height - top)
            raw = _expand(data[start : start + size], scheme, rows * tw * samples * kind.itemsize)
            if predictor == 3:  # per row: differences of bytes, with the bytes of equal weight together
                raw = np.frombuffer(raw, np.uint8)[: rows * tw * samples * kind.itemsize].reshape(rows, -1, samples)
                raw = np.cumsum(raw, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, tw * samples)
                block = np.ascontiguousarray(raw.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, tw, samples)
            else:
                block = _undo(np.frombuffer(raw, kind, rows * tw * samples).reshape(rows, tw, samples).astype(kind.newbyteorder("=")), predictor)
            page[top : top + rows, left : left + tw] = block[: height - top, : width - left]
        yield page, scheme, predictor


def text_media(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length of the text, and its bytes padded with blanks to rows of WIDTH samples, as TIFF."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    padded = raw + b" " * (-len(raw) % WIDTH if raw else WIDTH)
    image = np.frombuffer(padded, np.uint8).reshape(-1, WIDTH)
    return len(raw), write_tiff([image[k : k + ROWS_PER_PAGE] for k in range(0, len(image), ROWS_PER_PAGE)])


def _feature(arrays: list[np.ndarray]) -> str:
    """Pages, rows, mean, deviation and entropy of the samples."""
    counts = sum(np.bincount(a.ravel(), minlength=256) for a in arrays)
    n, at = counts.sum(), np.arange(256)
    mean = float((counts * at).sum() / n)
    spread = float(np.sqrt(max((counts * at * at).sum() / n - mean * mean, 0.0)))
    share = counts[counts > 0] / n
    return f"pages={len(arrays)};rows={sum(len(a) for a in arrays)};mean={mean:.6f};std={spread:.6f};bits={float(-(share * np.log2(share)).sum()):.6f}"


def pages(media: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """One row per page of each TIFF: id, page, width, height, samples, bits, compression, predictor,
    data (rows of samples, native order), error.

    Null media give no row; bytes that aren't a readable TIFF, or only up to some page, give one row with
    page -1 and the error. Repeated rows and ids each give their pages; other columns are dropped. id_col
    may not have the name of one of the new columns.
    """
    kind = media.schema[id_col].dataType.simpleString()
    names = ["page", "width", "height", "samples", "bits", "compression", "predictor", "data", "error"]
    types = [pa.int32()] * 7 + [pa.binary(), pa.string()]
    if id_col in names:
        raise ValueError(f"id_col {id_col} is the name of a new column")

    def run(batches):
        for b in batches:
            ids, blobs = (b.column(b.schema.get_field_index(c)) for c in (id_col, media_col))
            for i, blob in enumerate(blobs):
                if not blob.is_valid:
                    continue
                rows, error = [], None
                try:
                    for k, (a, scheme, predictor) in enumerate(read_pages(blob.as_py())):
                        rows.append((k, a.shape[1], a.shape[0], a.shape[2], a.dtype.itemsize * 8, scheme, predictor, a.tobytes(), None))
                except (struct.error, zlib.error, ValueError, LookupError, TypeError, ArithmeticError, MemoryError) as e:
                    error = f"{type(e).__name__}: {e}"
                if error:
                    rows.append((-1, *[None] * 7, error))
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays([ids.slice(i, 1)] * len(rows)), *columns], names=[id_col, *names])

    schema = f"`{id_col}` {kind}, " + ", ".join(f"{n} {'binary' if n == 'data' else 'string' if n == 'error' else 'int'}" for n in names)
    return map_arrow(media.select(id_col, media_col), run, schema)


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", media: bool = False) -> DataFrame:
    """Stores each whole text as a TIFF, walks its pages again and digests what they hold.

    Returns the id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature and, if asked for, media itself. Null texts count as empty; rows with equal texts have
    equal values; ids may be null or repeat; other columns are dropped. Row by row, no shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["media"] * media
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * media

    def run(batches):
        for b in batches:
            cols = [[] for _ in names]
            for text in b.column(b.schema.get_field_index(text_col)):
                n, blob = text_media(text.as_py())
                arrays = [a for a, _, _ in read_pages(blob)]
                stored = b"".join(a.tobytes() for a in arrays)
                row = (n, len(stored), hashlib.sha256(stored).hexdigest(), zlib.crc32(stored[-16:]), len(blob), hashlib.sha256(blob).hexdigest(), _feature(arrays), blob)
                for c, v in zip(cols, row[: len(names)], strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(id_col)), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[id_col, *names])

    kinds = {"payload_sha256": "string", "media_sha256": "string", "feature": "string", "media": "binary"}
    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, " + ", ".join(f"{n} {kinds.get(n, 'long')}" for n in names))


def op2_tiff(spark, sf_dir: str) -> DataFrame:
    """All documents as TIFF files and read back; nulls, ties, repeats and other columns as in documents()."""
    return documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
