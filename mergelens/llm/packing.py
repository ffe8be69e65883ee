"""Packing examples into sequences: vector bin packing by the dot-product heuristic.

A sequence has simultaneous limits on tokens, segments and loss-bearing tokens. The
open sequence takes, of the example sizes that fit all limits, the one whose demand
has the largest dot product with what the sequence has left (both in shares of the
limits); when nothing fits, the largest example is cut to fill it, and the next
sequence opens. Examples of one size are one class, so a choice looks at the sizes
present, not at the examples. The loss-bearing tokens of an example are its last.

Documents are packed where they are read, in runs of bounded size: no exchange, no
state between tasks, and a lost task is simply run again with the same result as
long as the files are the same. Only a run's last sequences may be left unfilled.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergelens.llm.common import release
from mergelens.llm.tokens import encoder

Piece = tuple[int, int, int, int, int]


def pack(
    tokens: list[int], loss: list[int], max_tokens: int = 2048, max_segments: int = 256, max_loss: int | None = None
) -> list[Piece]:
    """Pieces (example, start, length, sequence, offset); every token of every example lies in one piece.

    An example without tokens gets no piece. Zero loss-bearing tokens are allowed.
    """
    max_loss = max_tokens if max_loss is None else max_loss
    classes: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for example, (n, bearing) in enumerate(zip(tokens, loss, strict=True)):
        if n:
            classes.setdefault((n, min(n, bearing)), []).append((example, 0))
    sizes = sorted(classes)
    table = np.array(sizes, np.int64).reshape(-1, 2)
    pieces: list[Piece] = []
    sequence = 0

    def take(at: int) -> tuple[int, int]:
        nonlocal table
        members = classes[sizes[at]]
        member = members.pop()
        if not members:
            del classes[sizes[at]]
            del sizes[at]
            table = np.delete(table, at, axis=0)
        return member

    def put(size: tuple[int, int], member: tuple[int, int]) -> None:
        nonlocal table
        if size not in classes:
            at = bisect_left(sizes, size)
            sizes.insert(at, size)
            table = np.insert(table, at, size, axis=0)
            classes[size] = []
        classes[size].append(member)

    while sizes:
        left_tokens, left_segments, left_loss, offset = max_tokens, max_segments, max_loss, 0
        while sizes and left_tokens and left_segments:
            fits = (table[:, 0] <= left_tokens) & (table[:, 1] <= left_loss)
            if fits.any():
                score = table[:, 0] * (left_tokens / max_tokens**2) + table[:, 1] * (left_loss / max(1, max_loss) ** 2)
                at = int(np.where(fits, score, -1).argmax())
                length, bearing = sizes[at]
                example, start = take(at)
            else:
                n, all_bearing = sizes[-1]
                length = min(left_tokens, n - all_bearing + left_loss)
                if not length:
                    break
                example, start = take(len(sizes) - 1)
                rest = (n - length, min(all_bearing, n - length))
                bearing = all_bearing - rest[1]
                put(rest, (example, start + length))
            pieces.append((example, start, length, sequence, offset))
            left_tokens, left_segments, left_loss = left_tokens - length, left_segments - 1, left_loss - bearing
            offset += length
        sequence += 1
    return pieces


def pack_documents(
    docs: DataFrame, path: str, end_id: int = 1, max_tokens: int = 2048, max_segments: int = 256,
    max_loss: int | None = None, id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per piece of the packed documents, with the crc32 of its ids.

    A document's ids are those of its whole text (a null text is empty), then
    ``end_id``; all bear loss. Null and repeated ids are kept as they are, each row
    is a document of its own. An empty table gives no rows; other columns are not read.
    """
    schema = (
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(path)
        sequence = TaskContext.get().partitionId() << 36
        for batch in batches:
            keys = batch.column(0)
            for first, stop, flat, counts in tokenizer.encode_column(batch.column(1)):
                ends = np.cumsum(counts)
                ids = np.insert(flat, ends, end_id).astype("<u4")
                begins = np.r_[0, ends[:-1]] + np.arange(len(counts))
                sizes = (counts + 1).tolist()
                pieces = np.array(pack(sizes, sizes, max_tokens, max_segments, max_loss), np.int64).reshape(-1, 5)
                example, start, length, number, offset = pieces.T
                at = begins[example] + start
                crc = [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(first, stop - first).take(pa.array(example)), pa.array(start), pa.array(length),
                        pa.array(crc, pa.int64()), pa.array(counts[example] + 1), pa.array(number + sequence),
                        pa.array(offset),
                    ],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )
                sequence += int(number[-1]) + 1 if len(number) else 0
            release()

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)
