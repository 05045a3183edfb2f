"""WARC archives: writing with segments and revisits, and reading with segment reassembly.

Writer: a page's payload goes into an HTTP response in chunked transfer framing.  Of pages with equal payloads the one
with the smallest page_id is the response, the others are revisits of it without a body.  A block over SEGMENT bytes is
cut: the first record has segment number 1, continuation records name it as their origin, and the last one gives the
total length.  Every record is a gzip member; files are rolled at ROLL bytes.

Reader: files are streamed member by member.  Records without segments are decoded at once; segments are grouped by
their origin's identifier, ordered by number, checked for gaps and against the total length, joined, and then decoded.
Digests are checked on every payload.

A payload is moved only to join it with more repeated digests than BROADCAST_ROWS; up to that number the digests come to it.

Defined results: a null payload is empty; rows that repeat a page_id with the same payload are all responses if it is the
smallest, and rows that repeat one with other payloads are pages of their own: identifiers are unique for each row; a null page_id is a revisit where the payload has a page_id, else a response; an empty table gives no files and
an empty result; extra columns aren't written.  A damaged record raises an error that names it.
"""

from __future__ import annotations

import base64
import hashlib
import time
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import map_arrow
from . import common as C
from . import files

SEGMENT = 16 << 10  # bytes in a record's block
HTTP_CHUNK = 4 << 10
ROLL = 64 << 20
LEVEL = 4
LEAST_REVISIT = 0  # payloads under so many bytes are never revisits
BROADCAST_ROWS = 200_000  # repeated digests up to this number, 10 MB, are broadcast; more are joined by a shuffle
HTTP = "application/http;msgtype=response"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def to_chunks(payload: bytes, size: int = HTTP_CHUNK) -> bytes:
    """payload in chunked transfer framing."""
    parts = []
    for at in range(0, len(payload), size):
        part = payload[at : at + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def from_chunks(body: bytes) -> bytes:
    """The payload of a chunked body; extensions of chunks and trailers are skipped."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk's size is missing")
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + n])
        at += n + 2


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def records(page_id: int | None, number: int, url: str, payload: bytes, refers_to: int | None, segment: int = SEGMENT, named: bool = False, date: str = "1970-01-01T00:00:00Z") -> Iterator[bytes]:
    """The gzip members of one page.  number: the row's task and place in it, which make its identifier unique; a named row,
    the response that revisits refer to, goes by its page_id and digest instead."""
    sha = digest(payload)
    name = f"<urn:page:{page_id}:{sha}>" if named else f"<urn:row:{number}>"
    of = [("WARC-Date", date), ("WARC-Target-URI", " ".join((url or "about:blank").split()))]
    common = [("WARC-Record-ID", name), *of, ("Content-Type", HTTP), ("WARC-Payload-Digest", f"sha1:{sha}")]
    if page_id is not None:
        common.append(("WARC-Page-ID", page_id))
    if refers_to is not None:
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        yield _record([("WARC-Type", "revisit"), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}:{sha}>")], head)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + to_chunks(payload)
    if len(block) <= segment:
        yield _record([("WARC-Type", "response"), *common], block)
        return
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    yield _record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1)], parts[0])
    for k, part in enumerate(parts[1:], 2):
        last = [("WARC-Segment-Total-Length", len(block))] if k == len(parts) else []
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{name[:-1]}:{k}>"), *of, ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", k), *last], part)


def members(uri: str) -> Iterator[bytes]:
    """The uncompressed gzip members of a file, one at a time."""
    f, have = files.reader(uri), b""
    while True:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            have = have or f.read(1 << 16)
            if not have:
                if parts:
                    raise ValueError(f"{uri} ends within a record")
                return
            parts.append(unpacker.decompress(have))
            have = b""
        have = unpacker.unused_data
        yield b"".join(parts)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(headers["content-length"])
    if len(rest) < n:
        raise ValueError(f"{headers.get('warc-record-id')}: the block is cut short")
    return headers, rest[:n]


def payload_of(block: bytes, expected: str) -> bytes:
    """The payload of a whole HTTP block, checked against its digest."""
    head, _, body = block.partition(b"\r\n\r\n")
    payload = from_chunks(body) if b"transfer-encoding: chunked" in head.lower() else body
    if digest(payload) != expected:
        raise ValueError("a payload doesn't match its digest")
    return payload


# ------------------------------------------------------------------------------------------------ Spark
def roles(spark: SparkSession, pages: DataFrame, payload: str, least_bytes: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload, first: the page that a revisit refers to (null for responses), and named: whether the row is
    the one response of a repeated payload that revisits refer to.  It is chosen by its page_id and url, so that the choice
    holds however often and in whatever order the pages are read."""
    body = F.coalesce(F.col(payload), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("payload"), F.unhex(F.sha1(body)).alias("sha"))
    rows = keyed.groupBy("sha", "page_id", "url").agg(F.count("*").alias("same"))
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url", "same"))).alias("least")
    firsts = rows.groupBy("sha").agg(least, F.sum("same").alias("n")).where("n > 1 and least is not null").select("sha", F.col("least.page_id").alias("first"), F.col("least.url").alias("first_url"), F.col("least.same").alias("same"))
    firsts = C.table(spark, firsts, "firsts")
    few = F.broadcast if firsts.count() <= BROADCAST_ROWS else lambda df: df
    out = keyed.join(few(firsts), "sha", "left")
    is_first = F.coalesce(F.col("page_id").eqNullSafe(F.col("first")) & F.col("url").eqNullSafe(F.col("first_url")) & F.col("same").isNotNull(), F.lit(False))
    shown = ["page_id", "url", "payload", "first", "named"]
    repeated = firsts.where("same > 1")
    if repeated.isEmpty():
        out, again = out.withColumn("named", is_first), None
    else:  # rows that are alike in everything: made anew from their number, so that one of them can be named
        alike = out.where(is_first & (F.col("same") > 1)).groupBy("page_id", "url", "payload", "first").agg(F.count("*").alias("n"))
        again = alike.select("page_id", "url", "payload", "first", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k")).withColumn("named", F.col("k") == 1)
        out = out.where(~(is_first & (F.col("same") > 1))).withColumn("named", is_first)
    revisit = (F.octet_length("payload") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first"))
    out = (out.select(*shown) if again is None else out.select(*shown).union(again.select(*shown)))
    return out.select("page_id", "url", "payload", F.when(revisit, F.col("first")).alias("first"), F.col("named") & ~F.coalesce(revisit, F.lit(False))).toDF(*shown)


def write(pages: DataFrame, folder: str, segment: int = SEGMENT, date: str | None = None) -> DataFrame:
    """Write archives from ``roles``, dated now or as given; the manifest (path, n_records) when it is run."""
    date = date or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k, out, n, paths, counts, row = TaskContext.get().partitionId(), 0, None, 0, [], [], 0
        for b in C.small_batches(batches, "payload"):
            data, offs = C.utf8(b.column(2))
            for i, (page, url, first, named) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 1, 3, 4)))):
                if out is None:
                    paths.append(f"{folder}/part-{task:06d}-{k:04d}.warc.gz")
                    out, n, k = files.Writer(paths[-1]), 0, k + 1
                row += 1
                for member in records(page, (task << 32) + row, url, data[offs[i] : offs[i + 1]].tobytes(), first, segment, named, date):
                    out.write(member)
                    n += 1
                if out.size >= ROLL:
                    out.close()
                    counts.append(n)
                    out = None
        if out is not None:
            out.close()
            counts.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], ["path", "n_records"])

    return map_arrow(pages, run, "path string, n_records long")


_OUT = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
_OUT_DDL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_SEG = [("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("block", pa.binary())]
_SEG_DDL = "origin string, number int, total long, block binary"


def read(manifest: DataFrame) -> DataFrame:
    """The records of the archives: whole ones decoded, segments as they are (origin, number, total, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0
        schema = pa.schema(_OUT + _SEG)
        for b in batches:
            for path in b.column(0).to_pylist():
                for record in members(path):
                    h, block = parse(record)
                    kind, held = h["warc-type"], held + len(record)
                    row: dict = {"page_id": int(h["warc-page-id"]) if "warc-page-id" in h else None, "record_type": kind, "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha1:")}
                    if "warc-segment-number" in h:
                        row |= {"origin": h.get("warc-segment-origin-id", h["warc-record-id"]), "number": int(h["warc-segment-number"]), "block": block}
                        row["total"] = int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None
                    elif kind == "revisit":
                        length = next(x.split(b":")[1] for x in block.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        row |= {"payload_bytes": int(length), "refers_to": int(h["warc-refers-to"][1:-1].split(":")[2])}
                    else:
                        row["payload_bytes"] = len(payload_of(block, row["payload_digest"]))
                    rows.append(row)
                    if len(rows) >= 2000 or held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return map_arrow(manifest.select("path").repartition(max(1, manifest.count()), "path"), run, f"{_OUT_DDL}, {_SEG_DDL}")


def reassemble(read_records: DataFrame) -> DataFrame:
    """Whole records, and segments joined by origin, each with its payload's length."""
    whole = read_records.where("origin is null").select(*(n for n, _ in _OUT))
    parts = read_records.where("origin is not null").groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"), F.max("page_id").alias("page_id"), F.max("payload_digest").alias("payload_digest"), F.max("total").alias("total")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(_OUT)
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                numbers, block = [p["number"] for p in r["parts"]], b"".join(p["block"] for p in r["parts"])
                if numbers != list(range(1, len(numbers) + 1)) or len(block) != r["total"]:
                    raise ValueError(f"{r['origin']}: segments {numbers} of {len(block)} bytes; {r['total']} are due")
                payload = payload_of(block, r["payload_digest"])
                yield pa.RecordBatch.from_pylist([{"page_id": r["page_id"], "payload_bytes": len(payload), "payload_digest": r["payload_digest"], "record_type": "response", "refers_to": None}], schema)

    return whole.union(map_arrow(parts, run, _OUT_DDL))


def op7_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = C.new_table_path(spark, "warc")
    manifest = C.table(spark, write(roles(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), "html"), folder), "archives")
    return reassemble(C.table(spark, read(manifest), "records"))
