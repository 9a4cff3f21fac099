"""WARC archives: a writer that segments and chunks, and a reader that puts the segments together."""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.common import cut, map_arrow

#: Bytes of a record block above which the rest goes to continuation records.
SEGMENT = 16 << 10
CHUNK = 4096
#: Bytes of an archive after which the next begins.
ARCHIVE = 4 << 20
_ID = "<urn:pagelattice:record:{}>"
_CRLF2 = b"\r\n\r\n"


class WarcError(ValueError):
    """A record that doesn't follow the format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise WarcError("chunk without a size")
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        if end + 2 + size > len(body) or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise WarcError("chunk is cut off")
        out.append(body[end + 2 : end + 2 + size])
        at = end + 4 + size


def record(kind: str, record_id: str, block: bytes, **fields) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": record_id, **{k.replace("_", "-"): v for k, v in fields.items() if v is not None}, "Content-Length": len(block)}
    lines = "".join(f"{k}: {' '.join(str(v).split())}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + _CRLF2


def records_of(page_id, url: str | None, payload: bytes, refers_to, copy: str | None = None) -> list[bytes]:
    """The records of one page: a revisit, or a response and, past SEGMENT bytes, its continuations.
    copy, an extension field, keeps the segments of repeated pages apart."""
    rid, uri = _ID.format(page_id), url or "about:blank"
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
        return [record("revisit", rid, block, WARC_X_Copy=copy, WARC_Target_URI=uri, WARC_Payload_Digest=f"sha1:{digest(payload)}", WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", WARC_Refers_To=_ID.format(refers_to))]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    first, rest = block[:SEGMENT], [block[i : i + SEGMENT] for i in range(SEGMENT, len(block), SEGMENT)]
    out = [record("response", rid, first, WARC_X_Copy=copy, WARC_Target_URI=uri, WARC_Payload_Digest=f"sha1:{digest(payload)}", WARC_Segment_Number=1 if rest else None)]
    for k, part in enumerate(rest, 2):
        out.append(record("continuation", f"{rid[:-1]}/{k}>", part, WARC_X_Copy=copy, WARC_Target_URI=uri, WARC_Segment_Origin_ID=rid, WARC_Segment_Number=k, WARC_Segment_Total_Length=len(block) if k == len(rest) + 1 else None))
    return out


def parse(data: bytes):
    """Yields (fields in lower case, block) of an archive of gzip members or plain records."""
    read = 0
    while read < len(data):
        if data[read : read + 2] == b"\x1f\x8b":
            gz, parts = zlib.decompressobj(31), []
            while not gz.eof and read < len(data):  # in small pieces, since what a member leaves over is copied
                piece = data[read : read + 8192]
                parts.append(gz.decompress(piece))
                read += len(piece) - len(gz.unused_data)
            if not gz.eof:
                raise WarcError("member is cut off")
            plain = b"".join(parts)
        else:
            plain, read = data[read:], len(data)
        at = 0
        while at < len(plain):
            if not plain.startswith(b"WARC/1.", at):
                raise WarcError("no WARC version line")
            end = plain.find(_CRLF2, at)
            if end < 0:
                raise WarcError("header is cut off")
            fields = {}
            for line in plain[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
                k, _, v = line.partition(":")
                fields[k.strip().lower()] = v.strip()
            n = int(fields["content-length"])
            block = plain[end + 4 : end + 4 + n]
            if len(block) < n:
                raise WarcError("block is cut off")
            yield fields, block
            at = end + 4 + n + 4


def write(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """Archives (archive, data) of pages (page_id, url, html), in the shared folder.

    Of pages with equal payloads of at least min_revisit bytes the one with the largest page_id is
    the response and the others revisit it; smaller ones are all responses. Null html counts as
    empty, a null url as about:blank. A null page_id is a response unless an equal page with an id
    exists; repeated rows of a response are responses each. Extra columns are ignored. Records are
    gzip members; a continuation lies in another archive than the segment before it.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"sha": F.sha1("payload"), "n": F.octet_length("payload")})
    last = pages.select("page_id", F.sha1(payload).alias("sha")).groupBy("sha").agg(F.max("page_id").alias("last"))
    rows = rows.join(last, "sha")
    refers = F.when((F.col("n") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last"))
    rows = rows.select("page_id", "url", "payload", refers.alias("refers_to"))

    def run(batches):
        from pyspark import TaskContext

        task, made, n, sides, held = TaskContext.get().partitionId(), 0, 0, [[], []], [0, 0]

        def blob(side):
            nonlocal made
            made += 1
            data = b"".join(sides[side])
            sides[side].clear()
            held[side] = 0
            return pa.RecordBatch.from_arrays([pa.array([f"{task:06d}-{made:05d}"]), pa.array([data], pa.binary())], names=["archive", "data"])

        for b in batches:
            for row in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                n += 1
                for k, r in enumerate(records_of(*row, f"{task}-{n}")):
                    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
                    sides[k % 2].append(gz.compress(r) + gz.flush())
                    held[k % 2] += len(sides[k % 2][-1])
                    if held[k % 2] > ARCHIVE:
                        yield blob(k % 2)
        for side in (0, 1):
            if sides[side]:
                yield blob(side)

    return cut(map_arrow(rows, run, "archive string, data binary"))


_FIELDS = ("warc-type", "warc-record-id", "warc-target-uri", "warc-payload-digest", "warc-refers-to", "warc-segment-origin-id", "warc-x-copy")


def records(archives: DataFrame) -> DataFrame:
    """The records of all archives: type, record_id, uri, payload_digest, refers_to, origin_id, copy,
    segment, total, block, error. An archive that breaks off gives its records up to there and
    one row of type error."""
    names = ["type", "record_id", "uri", "payload_digest", "refers_to", "origin_id", "copy", "segment", "total", "block", "error"]
    types = [pa.string()] * 7 + [pa.int32(), pa.int64(), pa.binary(), pa.string()]

    def run(batches):
        for b in batches:
            for data in b.column(b.schema.get_field_index("data")):
                rows = []
                try:
                    for f, block in parse(data.as_py() or b""):
                        whole = [int(f[k]) if f.get(k, "").isdigit() else None for k in ("warc-segment-number", "warc-segment-total-length")]
                        rows.append((*(f.get(k) for k in _FIELDS), *whole, block, None))
                except (WarcError, ValueError, KeyError, zlib.error) as e:
                    rows.append(("error", *[None] * 9, f"{type(e).__name__}: {e}"))
                for k in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 256], strict=True), types, strict=True)], names=names)

    kinds = {"segment": "int", "total": "long", "block": "binary"}
    return map_arrow(archives.select("data"), run, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))


def reassemble(found: DataFrame) -> DataFrame:
    """Whole records with their payload: record_id, type, uri, refers_to, payload, payload_bytes,
    payload_digest, error.

    Continuations are grouped with their origin (and copy), put in the order of their segment numbers and
    checked against the total length; a missing, repeated or surplus segment, a wrong length, a
    broken chunk or a payload that differs from its declared digest give an error and a null
    payload. A group is one record, so it is as large as that record. An archive that breaks off has a
    row of type error with its message; repeated records of one segment each stay.
    """
    part = F.struct("segment", "block", "total")
    meta = ("type", "uri", "refers_to", "payload_digest")
    whole = found.where("segment is null and type <> 'error'").select("record_id", *meta, F.array(part).alias("parts"))
    head = [F.max(F.when(F.col("type") != "continuation", F.struct(*meta))).alias("head"), F.array_sort(F.collect_list(part)).alias("parts")]
    cut_up = found.where("segment is not null").groupBy(F.coalesce("origin_id", "record_id").alias("record_id"), "copy").agg(*head)
    every = whole.unionByName(cut_up.select("record_id", "head.*", "parts"))
    names = ["record_id", "type", "uri", "refers_to", "payload", "payload_bytes", "payload_digest", "error"]
    types = [pa.string()] * 4 + [pa.binary(), pa.int64(), pa.string(), pa.string()]

    def payload_of(kind, parts, declared):
        if kind is None:
            raise WarcError("origin record is missing")
        if len(parts) > 1 or parts[0]["segment"] is not None:
            if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)):
                raise WarcError("segments are missing or repeated")
            if parts[-1]["total"] != sum(len(p["block"]) for p in parts):
                raise WarcError("total length differs")
        head, _, body = b"".join(p["block"] for p in parts).partition(_CRLF2)
        if kind == "revisit":
            return None
        if any(x.lower().replace(b" ", b"").startswith(b"transfer-encoding:") and b"chunked" in x.lower() for x in head.split(b"\r\n")):
            body = dechunked(body)
        if declared and declared.removeprefix("sha1:") != digest(body):
            raise WarcError("payload digest differs")
        return body

    def run(batches):
        for b in batches:
            rows = []
            for rid, kind, uri, refers, declared, parts in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("record_id", "type", "uri", "refers_to", "payload_digest", "parts")), strict=True):
                try:
                    body, error = payload_of(kind, parts, declared), None
                except (WarcError, ValueError) as e:
                    body, error = None, f"{type(e).__name__}: {e}"
                bare = declared.removeprefix("sha1:") if body is None and declared else None
                rows.append((rid, kind, uri, refers, body, None if body is None else len(body), bare if body is None else digest(body), error))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    whole = map_arrow(every, run, ", ".join(f"{n} {'binary' if n == 'payload' else 'long' if n == 'payload_bytes' else 'string'}" for n in names))
    broken = found.where("type = 'error'").select(*(F.col(n) if n in ("type", "error") else F.lit(None).cast(whole.schema[n].dataType).alias(n) for n in names))
    return whole.unionByName(broken)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """All pages, read back from archives; nulls, ties and repeats as in write(). A record that can't be
    read back makes the query fail. Rows with a null page_id have one."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    read = cut(reassemble(records(write(pages))).drop("payload", "uri"))
    fault = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("archive: "), F.col("error"))))
    read = read.withColumn("payload_digest", F.coalesce(fault.cast("string"), "payload_digest"))
    number = lambda c: F.regexp_extract(c, r"record:(-?\d+)>$", 1).try_cast("long")
    read = read.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), number("refers_to").alias("refers_to"))
    sizes = read.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("same_bytes"))
    out = read.join(sizes, "payload_digest", "left")
    return out.select("page_id", F.coalesce("payload_bytes", "same_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
