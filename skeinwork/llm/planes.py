"""Token ids in files of shuffled planes.

A file holds the ids of consecutive texts.  Ids are cut into chunks of fixed size; a chunk is transposed into byte
planes (or bit planes), each plane is compressed by zstandard on its own, and planes that are all zero take a few bytes.
The footer has the chunk index (place, ids, plane sizes, crc32 of the ids) and the document index (doc_id, ids).  The
last 12 bytes are the footer's length and a mark.  Any chunk can be read by the index alone.

Texts are ordered by doc_id over all files: a range shuffle deals them, each task writes one file under its partition's
number, and the manifest's running sum gives each file's first id.

Defined results: a null text is empty; an empty text has the end id alone; rows that share a doc_id follow each other in
the order of a hash of their texts; a null doc_id comes first; an empty table gives an empty result; extra columns
aren't written.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import map_arrow
from . import common as C
from . import files
from .tokens import default_path, encoder

CHUNK = 1 << 16  # ids in a chunk
LEVEL = 3
MARK = b"SKPLANE1"
_CHUNK_ROW = np.dtype([("at", "<u8"), ("ids", "<u4"), ("crc", "<u4"), ("sizes", "<u4", 32)])
_DOC_ROW = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("ids", "<u8")])


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The planes of unsigned 32-bit ids: 4 of bytes or 32 of bits, lowest first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    return [np.packbits((raw[:, k // 8] >> (k % 8)) & 1).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)).view("<u4").ravel()
    out = np.zeros(n, "<u4")
    for k, p in enumerate(planes):
        out |= np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype("<u4") << np.uint32(k)
    return out


class PlaneWriter:
    def __init__(self, uri: str, chunk: int = CHUNK, bits: bool = False) -> None:
        self.file, self.chunk, self.bits = files.Writer(uri), chunk, bits
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.waiting, self.held, self.index, self.docs, self.total = [], 0, [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids) // 4))
        self.total += len(ids) // 4
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= 4 * self.chunk:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        data, step = b"".join(self.waiting), 4 * self.chunk
        end = len(data) if last else len(data) - len(data) % step
        for at in range(0, end, step):
            part = data[at : min(at + step, end)]
            planes = [self.packer.compress(p) for p in to_planes(np.frombuffer(part, "<u4"), self.bits)]
            self.index.append((self.file.size, len(part) // 4, zlib.crc32(part), [len(p) for p in planes] + [0] * (32 - len(planes))))
            for p in planes:
                self.file.write(p)
        self.waiting, self.held = [data[end:]], len(data) - end

    def close(self) -> int:
        self._flush(True)
        chunks, docs = np.array(self.index, _CHUNK_ROW).tobytes(), np.array(self.docs, _DOC_ROW).tobytes()
        foot = self.packer.compress(struct.pack("<QQB", len(self.index), len(self.docs), self.bits) + chunks + docs)
        self.file.write(foot + struct.pack("<I", len(foot)) + MARK)
        return self.file.close()


class PlaneReader:
    def __init__(self, uri: str) -> None:
        self.file = files.reader(uri)
        size = self.file.size()
        self.file.seek(size - 12)
        n, mark = struct.unpack("<I8s", self.file.read(12))
        if mark != MARK:
            raise ValueError(f"{uri} isn't a whole plane file")
        self.file.seek(size - 12 - n)
        self.unpacker = zstandard.ZstdDecompressor()
        raw = self.unpacker.decompressobj().decompress(self.file.read(n))
        chunks, docs, self.bits = struct.unpack_from("<QQB", raw)
        self.chunks = np.frombuffer(raw, _CHUNK_ROW, chunks, 17)
        self.docs = np.frombuffer(raw, _DOC_ROW, docs, 17 + chunks * _CHUNK_ROW.itemsize)

    def chunk(self, k: int) -> bytes:
        row = self.chunks[k]
        self.file.seek(int(row["at"]))
        planes = [self.unpacker.decompressobj().decompress(self.file.read(int(s))) for s in row["sizes"][: 32 if self.bits else 4]]
        out = from_planes(planes, int(row["ids"])).tobytes()
        if zlib.crc32(out) != row["crc"]:
            raise ValueError(f"chunk {k} is damaged")
        return out

    def documents(self) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, first id in the file, packed ids), holding no more than a document and a chunk."""
        k, have, at = 0, b"", 0
        for row in self.docs:
            need, parts = 4 * int(row["ids"]), []
            while need > len(have):
                parts.append(have)
                need -= len(have)
                have = self.chunk(k)
                k += 1
            parts.append(have[:need])
            have = have[need:]
            yield None if row["null"] else int(row["doc_id"]), at, b"".join(parts)
            at += int(row["ids"])


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int | None = 0, bits: bool = False, text: str = "text") -> DataFrame:
    """Write the ids of docs by ascending doc_id; the manifest (file_no, path, n_ids, n_docs) when it is run."""
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text_value")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text_value"))
    tail = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        out, path = None, f"{folder}/part-{number:06d}.planes"
        for b in C.small_batches(batches, "text_value"):
            out = out or PlaneWriter(path, bits=bits)
            for i, ids in zip(b.column(0).to_pylist(), encoder(vocabulary).encode([t or "" for t in b.column(1).to_pylist()])):
                out.add(i, ids + tail)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"file_no": pa.array([number], pa.int64()), "path": [path], "n_ids": pa.array([out.total], pa.int64()), "n_docs": pa.array([len(out.docs)], pa.int64())})

    return map_arrow(ordered, run, "file_no long, path string, n_ids long, n_docs long")


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files."""
    first = F.sum("n_ids").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.select("file_no", "path", F.coalesce(first, F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
                rows: list[list] = [[], [], [], []]
                for doc_id, at, ids in PlaneReader(path).documents():
                    for col, v in zip(rows, (doc_id, base + at, len(ids) // 4, zlib.crc32(ids))):
                        col.append(v)
                    if len(rows[0]) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], ["doc_id", "start", "n_tokens", "ids_crc32"])
                        rows = [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(placed.repartition(max(1, manifest.count()), "file_no"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = C.new_table_path(spark, "planes")
    manifest = C.table(spark, write(C.documents(spark, sf_dir), folder, default_path("byte_bpe_50k.json")), "manifest")
    return read(manifest)
