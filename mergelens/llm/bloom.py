"""Blocked Bloom filters of 64-bit hashes, sharded, built by Spark and broadcast.

A hash sets five bits of one 64-bit block of its shard, so a probe reads one block.
Tasks build chunks of blocks; only finished chunks, at most ``max_bytes`` of them
together, reach the driver and the broadcast. Where more members than that would
want room, blocks are shared by more of them: probes answer yes more often, never
no for a member.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_U = np.uint64
BITS = 5
PER_BLOCK = 2  # members a block is meant for
LEAST_BLOCKS = 64
CHUNK_BLOCKS = 16_384
MAX_BYTES = 32_000_000


def _masks(hashes: np.ndarray) -> np.ndarray:
    mask = np.zeros(len(hashes), _U)
    for at in range(BITS):
        mask |= _U(1) << ((hashes >> _U(6 * at)) & _U(63))
    return mask


def _blocks(hashes: np.ndarray, count: int) -> np.ndarray:
    return (((hashes >> _U(32)) * _U(count)) >> _U(32)).astype(np.int64)


class Filters:
    """Finished filters by shard."""

    def __init__(self, shards: dict[int, np.ndarray]):
        self.shards = shards

    def contains(self, shard: int, hashes: np.ndarray) -> np.ndarray:
        """Which of the hashes (uint64) may be members of the shard; all members are among them."""
        blocks = self.shards.get(shard)
        if blocks is None or not len(hashes):
            return np.zeros(len(hashes), bool)
        mask = _masks(hashes)
        return (blocks[_blocks(hashes, len(blocks))] & mask) == mask


def block_bytes(members: int) -> int:
    """Bytes a filter of so many members wants."""
    return 8 * max(LEAST_BLOCKS, -(-members // PER_BLOCK))


def build(members: DataFrame, max_bytes: int = MAX_BYTES) -> Filters:
    """Filters of ``members`` (shard int, h long); the number of shards must be small.

    Repeated members count once each towards the size; an empty table gives filters
    that contain nothing.
    """
    sizes = {row["shard"]: row["count"] for row in members.groupBy("shard").count().collect()}
    if not sizes:
        return Filters({})
    wanted = sum(block_bytes(n) for n in sizes.values())
    share = min(1.0, max_bytes / wanted)
    counts = {shard: max(LEAST_BLOCKS, math.ceil(block_bytes(n) / 8 * share)) for shard, n in sizes.items()}

    count = F.create_map(*[F.lit(x).cast("long") for pair in counts.items() for x in pair])[F.col("shard").cast("long")]
    block = F.shiftright(F.shiftrightunsigned("h", 32) * count, 32)
    chunked = members.select("shard", "h", F.floor(block / CHUNK_BLOCKS).cast("long").alias("chunk"))

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard, chunk = int(key[0]), int(key[1])
        hashes = rows["h"].to_numpy(np.int64).view(_U)
        first = chunk * CHUNK_BLOCKS
        blocks = np.zeros(min(CHUNK_BLOCKS, counts[shard] - first), _U)
        np.bitwise_or.at(blocks, _blocks(hashes, counts[shard]) - first, _masks(hashes))
        return pd.DataFrame({"shard": [shard], "chunk": [chunk], "bits": [blocks.tobytes()]})

    chunks = chunked.groupBy("shard", "chunk").applyInPandas(fill, "shard int, chunk long, bits binary")
    shards = {shard: np.zeros(n, _U) for shard, n in counts.items()}
    for row in chunks.toLocalIterator():
        blocks = np.frombuffer(row["bits"], _U)
        shards[row["shard"]][row["chunk"] * CHUNK_BLOCKS :][: len(blocks)] = blocks
    return Filters(shards)
