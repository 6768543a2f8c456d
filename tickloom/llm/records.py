"""Token ids as length-delimited binary records with masked checksums, and an offset index.

A data file is a run of records: length (8 bytes), masked CRC-32C of those bytes, the payload,
masked CRC-32C of the payload; all little-endian. The payload is a flag byte (1: the document has
an id), the doc_id (8 bytes) and the token ids, two bytes each while the vocabulary allows, else
four. Beside each data file lies an index file with the offset of each record (8 bytes each), for
reads in any order. Files are in ascending doc_id order, and so are the records in a file.
"""

from __future__ import annotations

import json
import posixpath
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import buffer_of, plain, slices
from tickloom.llm.tokens import encoder

#: Flag and doc_id before the ids.
HEADER = "<Bq"
BLOCK = 1024
#: Reversed polynomial of CRC-32C and the constant that masks it.
CASTAGNOLI, MASK_DELTA = 0x82F63B78, 0xA282EAD8
#: Bytes of text per data file, about.
FILE_BYTES = 32 << 20


def _byte_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & 1, (value >> 1) ^ np.uint32(CASTAGNOLI), value >> 1).astype(np.uint32)
    return value


@cache
def _block_tables() -> tuple[np.ndarray, np.ndarray]:
    """What each byte value adds at each place of a block, and what a register becomes after one."""
    one = _byte_table()
    places = np.empty((BLOCK, 256), np.uint32)
    places[-1] = one
    for i in range(BLOCK - 2, -1, -1):
        later = places[i + 1]
        places[i] = (later >> np.uint32(8)) ^ one[later & 0xFF]
    return places, np.ascontiguousarray(places[:4])


def crc32c(data: bytes) -> int:
    """CRC-32C of any bytes, a block of 1,024 at a time (the code is linear)."""
    places, register = _block_tables()
    raw = np.frombuffer(data, np.uint8)
    crc = 0xFFFFFFFF
    whole = len(raw) // BLOCK
    if whole:
        each = np.empty(whole, np.uint32)
        for low in range(0, whole, 256):
            part = raw[low * BLOCK : min(whole, low + 256) * BLOCK].reshape(-1, BLOCK)
            each[low : low + len(part)] = np.bitwise_xor.reduce(places[np.arange(BLOCK), part], axis=1)
        r0, r1, r2, r3 = register.tolist()
        for value in each.tolist():
            crc = value ^ r0[crc & 255] ^ r1[crc >> 8 & 255] ^ r2[crc >> 16 & 255] ^ r3[crc >> 24]
    tail = raw[whole * BLOCK :].copy()
    if len(tail) >= 4:
        tail[:4] ^= np.frombuffer(struct.pack("<I", crc), np.uint8)
        crc = int(np.bitwise_xor.reduce(places[np.arange(BLOCK - len(tail), BLOCK), tail]))
    else:
        one = _byte_table() if len(tail) else None
        for byte in tail.tolist():
            crc = crc >> 8 ^ int(one[(crc ^ byte) & 255])
    return crc ^ 0xFFFFFFFF


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def framed(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(crc32c(length))), payload, struct.pack("<I", masked(crc32c(payload)))))


def unframed(data: bytes, offset: int = 0) -> tuple[bytes, int]:
    """The payload of the record at an offset, and the offset after it. A wrong checksum is an error."""
    length = data[offset : offset + 8]
    size, check = struct.unpack("<QI", data[offset : offset + 12])
    payload = data[offset + 12 : offset + 12 + size]
    if check != masked(crc32c(length)) or len(payload) < size:
        raise ValueError(f"damaged record at {offset}")
    if struct.unpack_from("<I", data, offset + 12 + size)[0] != masked(crc32c(payload)):
        raise ValueError(f"damaged payload at {offset}")
    return bytes(payload), offset + 16 + size


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that all executors share, and the path in it."""
    return pafs.FileSystem.from_uri(uri)


def _publish(fs: pafs.FileSystem, path: str, chunks: Iterator[bytes]) -> None:
    """Written under the attempt's own name, then moved: a repeated task replaces whole files."""
    attempt = f"{path}.{TaskContext.get().taskAttemptId()}"
    with fs.open_output_stream(attempt) as out:
        for chunk in chunks:
            out.write(chunk)
    fs.move(attempt, path)


def write_records(docs: DataFrame, folder: str, file: str, mark: str, end: int = 1) -> list[tuple[int, int, int]]:
    """Writes data and index files and a manifest; returns (part, documents, tokens) in order.

    Null texts are empty; null ids come first. The list has an entry per file.
    """
    spark = docs.sparkSession
    kind = "<u2" if _vocabulary_size(file) <= 1 << 16 else "<u4"
    rows = plain(docs, doc_id="long", text="string")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranged = rows.repartitionByRange(max(1, -(-size // FILE_BYTES)), "doc_id").sortWithinPartitions("doc_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, (fs, root) = TaskContext.get().partitionId(), store(folder)
        ids_of = encoder(file, mark)
        offsets, totals = [], [0]

        def records() -> Iterator[bytes]:
            offset = 0
            for batch in slices(batches, "text"):
                ids, bounds = ids_of.encode(*buffer_of(batch.column("text")), end)
                data, width = memoryview(ids.astype(kind).tobytes()), np.dtype(kind).itemsize
                for doc, a, b in zip(batch.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    record = framed(struct.pack(HEADER, doc is not None, doc or 0) + data[a * width : b * width])
                    offsets.append(offset)
                    offset += len(record)
                    totals[0] += b - a
                    yield record

        name = posixpath.join(root, f"part-{part:06d}")
        fs.create_dir(root, recursive=True)
        _publish(fs, name + ".rec", records())
        _publish(fs, name + ".idx", iter([np.array(offsets, "<u8").tobytes()]))
        yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [len(offsets)], "n_tokens": totals})

    found = ranged.mapInArrow(write, "part long, n_docs long, n_tokens long").collect()
    parts = sorted((r.part, r.n_docs, r.n_tokens) for r in found if r.n_docs)
    _manifest(folder, kind, parts)
    return parts


def _manifest(folder: str, kind: str, parts: list[tuple[int, int, int]]) -> None:
    fs, root = store(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(posixpath.join(root, "manifest.json")) as out:
        out.write(json.dumps({"ids": kind, "parts": parts}).encode())


@cache
def _vocabulary_size(file: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(file).get_vocab_size()


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each record, from the files."""
    fs, root = store(folder)
    with fs.open_input_file(posixpath.join(root, "manifest.json")) as file:
        manifest = json.loads(file.read())
    kind, firsts, at = manifest["ids"], [], 0
    for part, _, n_tokens in manifest["parts"]:
        firsts.append((part, at))
        at += n_tokens
    files = spark.createDataFrame(firsts, "part long, first long").repartition(max(1, len(firsts)), "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = store(folder)
        for batch in batches:
            for part, start in zip(batch.column("part").to_pylist(), batch.column("first").to_pylist(), strict=True):
                name = posixpath.join(root, f"part-{part:06d}")
                with fs.open_input_file(name + ".idx") as index:
                    offsets = np.frombuffer(index.read(), "<u8").tolist()
                with fs.open_input_file(name + ".rec") as data:
                    ends = [*offsets[1:], data.size()]
                    for low in range(0, len(offsets), 1000):
                        done, start = _decoded(data, offsets[low : low + 1000], ends[low : low + 1000], kind, start)
                        yield done

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _decoded(data: pa.NativeFile, offsets: list[int], ends: list[int], kind: str, start: int) -> tuple[pa.RecordBatch, int]:
    out: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": []}
    for offset, end in zip(offsets, ends, strict=True):
        data.seek(offset)
        payload, _ = unframed(data.read(end - offset))
        known, doc = struct.unpack_from(HEADER, payload)
        ids = np.frombuffer(payload, kind, offset=struct.calcsize(HEADER))
        values = (doc if known else None, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
        for column, value in zip(out.values(), values, strict=True):
            column.append(value)
        start += len(ids)
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], list(out)), start
