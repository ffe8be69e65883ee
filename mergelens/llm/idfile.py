"""Token ids as binary files in document order, with a context-mixing range coder.

Texts are range-partitioned and sorted by id, so files in order hold documents in
order. A file is one segment: a header with its place (partition, number), the
documents' ids and token counts, the model that all its ids gave, and checksummed
blocks of ``block_ids`` token ids each, every one coded with that model and without
the other blocks (see ``rangecoder``). A document lies in one segment.
Spark's writer puts every segment in a file of its own on the shared folder,
followed by one zero byte.

Null texts are empty and have the end id only. Null ids come first; rows with equal
ids are documents of their own, ordered by a hash of the text. An empty table
writes no segment. Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mergelens.llm.rangecoder import Orders, decode, encode, split
from mergelens.llm.tokens import encoder

# Magic, partition, number, documents, blocks, bytes of the model, crc32 of the document table and the model.
_HEAD = struct.Struct("<4sQQIIII")
_MAGIC = b"IDS2"
_NO_ID = -(2**63)


def pack_segment(part: int, number: int, doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, block_ids: int) -> bytes:
    """A segment's bytes; a null document id is written as the smallest long."""
    orders = Orders.learn(ids)
    blocks = encode([ids[at : at + block_ids] for at in range(0, len(ids), block_ids)], orders)
    docs, model = doc_ids.astype("<i8").tobytes() + counts.astype("<i8").tobytes(), orders.to_bytes()
    crc = zlib.crc32(model, zlib.crc32(docs))
    head = _HEAD.pack(_MAGIC, part, number, len(doc_ids), len(blocks), len(model), crc)
    return b"".join([head, docs, model, *blocks])


def unpack_segment(data: memoryview) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """Partition, number, document ids, token counts and token ids; damage is an error."""
    magic, part, number, n, count, length, crc = _HEAD.unpack_from(data)
    at = _HEAD.size + 16 * n
    docs, model = bytes(data[_HEAD.size : at]), bytes(data[at : at + length])
    if magic != _MAGIC or zlib.crc32(model, zlib.crc32(docs)) != crc:
        raise ValueError("damaged segment")
    blocks, _ = split(data[at + length :], count)
    ids = np.concatenate([np.zeros(0, np.uint32), *decode(blocks, Orders.from_bytes(model)[0])])
    return part, number, np.frombuffer(docs[: 8 * n], "<i8"), np.frombuffer(docs[8 * n :], "<i8"), ids


def write_ids(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id: str = "doc_id", text: str = "text",
    block_ids: int = 2048, segment_ids: int = 6_000_000,
) -> None:
    """Write the token ids of all texts, each closed by ``end_id``, below ``path``."""
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part, number, size = [], TaskContext.get().partitionId(), 0, 0

        def segment() -> pa.RecordBatch:
            doc_ids, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_pydict({"content": [pack_segment(part, number, doc_ids, counts, ids, block_ids)]})

        for batch in batches:
            for first, stop, flat, counts in encoder(tokenizer).encode_column(batch.column(1)):
                keys = batch.column(0).slice(first, stop - first).fill_null(_NO_ID).to_numpy()
                held.append((keys, counts + 1, np.insert(flat, np.cumsum(counts), end_id)))
                size += int(counts.sum()) + len(counts)
                if size >= segment_ids:
                    yield segment()
                    held, number, size = [], number + 1, 0
        if held:
            yield segment()

    segments = rows.mapInArrow(run, "content binary").select(F.col("content").cast("string").alias("value"))
    segments.write.option("lineSep", "\x00").option("maxRecordsPerFile", 1).text(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document in the files: its place, ``doc_id``, ``n_tokens``, ``ids_crc32`` and its segment's tokens before it."""
    schema = "part long, number long, doc_id long, before long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                part, number, doc_ids, counts, ids = unpack_segment(memoryview(content.as_buffer()))
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                cuts = zip((ends - counts).tolist(), ends.tolist(), strict=True)
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in cuts]
                n = len(doc_ids)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": np.full(n, part), "number": np.full(n, number),
                        "doc_id": pa.array(doc_ids, mask=doc_ids == _NO_ID), "before": ends - counts,
                        "n_tokens": counts, "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def with_starts(documents: DataFrame) -> DataFrame:
    """Adds ``start``, the ids of all documents before each: sums over partitions, then segments, then inside one."""
    segments = documents.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    parts = segments.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    before = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    segments = segments.select("part", "number", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("segment_start"))
    starts = segments.join(parts, "part").select(
        "part", "number", (F.col("part_start") + F.col("segment_start")).alias("base")
    )
    return documents.join(starts, ["part", "number"]).withColumn("start", F.col("base") + F.col("before")).drop("base")
