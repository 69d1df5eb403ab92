"""Operator 9: token ids of documents in binary files, written with an adaptive context-mixing range coder.

``write`` range-shuffles the texts by doc_id, so that files and blocks, in order, hold the ids in ascending doc_id order. Each
task encodes its documents and writes one file of blocks into a folder that all executors share; a file appears under its
name only when complete, so a repeated task replaces its own work. A block holds whole documents, at least ``BLOCK_IDS``
ids unless the file ends, starts from a fresh model (``coder``) and carries checksums of its bytes and of its ids. ``read``
decodes blocks in parallel, wherever they lie, and fails on a block that does not match its checksums.

File format, little-endian. File: ``SLTF``, version (u32), then blocks. Block: ``SLTB``, documents (u32), ids (u64),
different ids (u32), bytes of the deflated tables (u32), bytes of the coded ids (u64), crc32 of the ids as unsigned 32-bit
integers (u32), crc32 of tables and coded ids (u32); the tables: doc_id of each document (i64), whether it is null (u8),
number of its ids (u32), the different ids of the block in ascending order (u32), bytes of each lane (u32); the coded ids,
lane after lane. What is coded is an id's rank among the different ones, so that a model spends nothing on ids its block lacks.

Defined results: null and empty texts are the end id alone. Rows without doc_id come first and keep a null doc_id; rows
that share a doc_id follow each other by a hash of their text. An empty table gives no files and no rows. Other
columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seamline.llm import coder
from seamline.llm.shared import doc_texts, shuffle_partitions
from seamline.llm.tokens import encoder
from seamline.llm.words import SLICE_ROWS

END = 2
BLOCK_IDS = 1 << 21
FILE_MAGIC, BLOCK_MAGIC, VERSION = b"SLTF", b"SLTB", 2
_HEADER = struct.Struct("<4sIQIIQII")
MANIFEST = "file string, block int, at bigint, bytes bigint, ids bigint, documents bigint"


def pack_block(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One block: documents by id and length, and their ids one after another."""
    different, ranks = coder.ranked(ids)
    data, lanes = coder.encode(ranks, len(different))
    tables = zlib.compress(b"".join([
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), bytes(d is None for d in doc_ids),
        lengths.astype("<u4").tobytes(), different.astype("<u4").tobytes(), lanes.astype("<u4").tobytes()]), 6)
    return _HEADER.pack(BLOCK_MAGIC, len(doc_ids), len(ids), len(different), len(tables), len(data),
                        zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(data, zlib.crc32(tables))) + tables + data


def unpack_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a block; ValueError if its checksums disagree."""
    magic, documents, n, different, table_bytes, data_bytes, ids_crc, bytes_crc = _HEADER.unpack_from(block)
    body = block[_HEADER.size: _HEADER.size + table_bytes + data_bytes]
    if magic != BLOCK_MAGIC or len(body) != table_bytes + data_bytes or zlib.crc32(body) != bytes_crc:
        raise ValueError("damaged block")
    tables = zlib.decompress(body[:table_bytes])
    doc_ids = np.frombuffer(tables, dtype="<i8", count=documents).tolist()
    null = tables[8 * documents: 9 * documents]
    lengths = np.frombuffer(tables, dtype="<u4", count=documents, offset=9 * documents).astype(np.int64)
    ids = np.frombuffer(tables, dtype="<u4", count=different, offset=13 * documents)
    lanes = np.frombuffer(tables, dtype="<u4", offset=13 * documents + 4 * different).astype(np.int64)
    ids = ids[coder.decode(body[table_bytes:], lanes, n, different)]
    if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("block decodes to other ids than were written")
    return [None if z else d for d, z in zip(doc_ids, null)], lengths, ids


def _writer(directory: str, tokenizer: str, end: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, spaced=False).encode
        fs, root = pa.fs.FileSystem.from_uri(directory)
        name = f"ids-{TaskContext.get().partitionId():08d}"
        part = f"{root}/_{name}-{uuid.uuid4().hex}"
        out, at, rows = None, 0, []
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        size = 0

        def flush() -> None:
            nonlocal out, at, docs, held, lengths, size
            if out is None:
                out = fs.open_output_stream(part)
                at = out.write(FILE_MAGIC + struct.pack("<I", VERSION))
            block = pack_block(docs, np.concatenate(lengths), np.concatenate(held))
            rows.append((f"{directory}/{name}", len(rows), at, len(block), size, len(docs)))
            out.write(block)
            at += len(block)
            docs, held, lengths, size = [], [], [], 0

        for batch in (b.slice(at, SLICE_ROWS) for b in batches for at in range(0, b.num_rows, SLICE_ROWS)):
            ids, offsets = encode(batch.column(1))
            ids, own, names = np.insert(ids, offsets[1:], np.uint32(end)), np.diff(offsets) + 1, batch.column(0).to_pylist()
            ends, i = np.r_[0, np.cumsum(own)], 0
            while i < len(own):
                j = min(int(np.searchsorted(ends, ends[i] + block_ids - size)), len(own))  # fills the block or ends the slice
                docs += names[i:j]
                held.append(ids[ends[i]: ends[j]])
                lengths.append(own[i:j])
                size += int(ends[j] - ends[i])
                i = j
                if size >= block_ids:
                    flush()
        if docs:
            flush()
        if out is not None:
            out.close()
            fs.move(part, f"{root}/{name}")
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "block", "at", "bytes", "ids", "documents"), r)) for r in rows], schema=pa.schema([
                ("file", pa.string()), ("block", pa.int32()), ("at", pa.int64()), ("bytes", pa.int64()), ("ids", pa.int64()), ("documents", pa.int64())]))
    return run


def write(docs: DataFrame, directory: str, tokenizer: str, end: int = END, block_ids: int = BLOCK_IDS) -> DataFrame:
    """Writes the files and returns their manifest: file, block, at, bytes, ids, documents. It's kept in the folder, too.

    ``directory`` must be a folder that Arrow's file systems reach from the driver and every executor.
    """
    spark = docs.sparkSession
    fs, root = pa.fs.FileSystem.from_uri(directory)
    fs.create_dir(root, recursive=True)
    ordered = doc_texts(docs).withColumn("h", F.xxhash64("text")).repartitionByRange(
        shuffle_partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    ordered.mapInArrow(_writer(directory, tokenizer, end, block_ids), MANIFEST).write.parquet(f"{directory}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{directory}/manifest")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            fs, path = pa.fs.FileSystem.from_uri(row["file"])
            with fs.open_input_file(path) as f:
                block = f.read_at(row["bytes"], row["at"])
            doc_ids, lengths, ids = unpack_block(block)
            begin = np.r_[0, np.cumsum(lengths)]
            data = ids.astype("<u4")
            yield pa.record_batch([
                pa.array(doc_ids, pa.int64()), pa.array(begin[:-1] + row["start"]),
                pa.array([data[i:j].tobytes() for i, j in zip(begin[:-1], begin[1:])], pa.binary())],
                names=["doc_id", "start", "ids"])


def read(spark: SparkSession, directory: str) -> DataFrame:
    """doc_id, start (ids of all documents before), ids (unsigned 32-bit little-endian) of every document in the files."""
    blocks = spark.read.schema(MANIFEST).parquet(f"{directory}/manifest")
    files = blocks.groupBy("file").agg(F.sum("ids").alias("all")).withColumn("before", F.coalesce(
        F.sum("all").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per file
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("inside", F.coalesce(F.sum("ids").over(earlier), F.lit(0))).join(files, "file").select(
        "file", "at", "bytes", (F.col("before") + F.col("inside")).alias("start"))
    return placed.repartition(shuffle_partitions(spark), "file", "at").mapInArrow(_reader, "doc_id bigint, start bigint, ids binary")
