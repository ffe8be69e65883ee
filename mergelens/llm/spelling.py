"""Grouping spelling variants: words one edit apart, found through Bloom filters.

Every word generates its edits as hashes only: each replacement by a later letter and
each deletion, in constant time an edit from the word's prefix sums. They are probed
against broadcast blocked Bloom filters of the vocabulary, sharded by length; the few
that pass are spelled out and shuffled to an exact join with the vocabulary, which
drops false positives. Of two near words exactly one generates the other, so a pair
is found once and counted for both.

Filters hold at most ``max_bytes``; a larger vocabulary is probed in several passes,
each with the filters of one slice of hashes, so the broadcast is bounded and no pair
is lost. The letters tried are the code points that occur in the vocabulary.

Words that are null or empty are not words and are left out; a word given in several
rows counts the sum of them. A word's edits are worked out in slices of bounded size,
so very long words take time in proportion to length times letters, but no more
memory than a few arrays of their length. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergelens.llm import bloom
from mergelens.llm.words import mix
from mergelens.sources.staging import Staging

_U = np.uint64
_BASE = 0xC2B2AE3D27D4EB4F
_INVERSE = pow(_BASE, -1, 1 << 64)
_LENGTH = 0x165667B19E3779F9
LONGEST_SHARD = 64
SLICE = 100_000  # edits of one letter worked out at once


def _shard(length: int) -> int:
    return min(length, LONGEST_SHARD)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n + 1, base, _U)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _salt(length: int) -> np.uint64:
    return _U(length * _LENGTH % (1 << 64))


def _values(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(_U) + _U(0x51ED270B))


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of words of one length with their code points, in blocks of bounded size."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        step = max(1, SLICE // max(1, int(length)))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            text = "".join([words[i] for i in part])
            yield part, np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(part), length)


def _hashes(codes: np.ndarray) -> np.ndarray:
    length = codes.shape[1]
    sums = (_values(codes) * _powers(_BASE, length)[:length]).sum(axis=1, dtype=_U)
    return mix(sums + _salt(length))


def _spell(codes: np.ndarray) -> list[str]:
    return [row.tobytes().decode("utf-32-le") for row in np.ascontiguousarray(codes)]


def _hashed(words: DataFrame, passes: int = 1, at: int = 0) -> DataFrame:
    """Shard and hash of the words of a pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, codes in by_length(batch.column(0).to_pylist()):
                hashes = _hashes(codes)
                hashes = hashes[_in_pass(hashes, passes, at)].view(np.int64)
                shards = np.full(len(hashes), _shard(codes.shape[1]), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(shards), pa.array(hashes)], ["shard", "h"])

    return words.mapInArrow(run, "shard int, h long")


def _in_pass(hashes: np.ndarray, passes: int, at: int) -> np.ndarray:
    return hashes % _U(passes) == _U(at)


def edits_found(
    codes: np.ndarray, letters: np.ndarray, filters: bloom.Filters, passes: int, at: int
) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Rows of ``codes`` and the edits of them that the filters may contain: deletions, then later letters."""
    n, length = codes.shape
    power = _powers(_BASE, length)
    values = _values(codes)
    terms = values * power[:length]
    before = np.zeros((n, length + 1), _U)
    np.cumsum(terms, axis=1, out=before[:, 1:])
    total = before[:, -1:]

    if length > 1:
        # Deleting any letter of a run of equal ones gives the same word: the first stands for all.
        first = np.ones((n, length), bool)
        first[:, 1:] = codes[:, 1:] != codes[:, :-1]
        shorter = before[:, :-1] + (total - before[:, 1:]) * _U(_INVERSE)
        hashes = mix(shorter[first] + _salt(length - 1))
        row, col = np.nonzero(first)
        hit = filters.contains(_shard(length - 1), hashes) & _in_pass(hashes, passes, at)
        row, col = row[hit], col[hit]
        if len(row):
            kept = np.ones((len(row), length), bool)
            kept[np.arange(len(row)), col] = False
            yield row, _spell(codes[row][kept].reshape(len(row), length - 1))

    rest = total - terms + _salt(length)
    for start in range(0, length, SLICE):
        part = slice(start, start + SLICE)
        flat, around = codes[:, part].ravel(), rest[:, part].ravel()
        scale = np.broadcast_to(power[:length][part], codes[:, part].shape).ravel()
        width = codes[:, part].shape[1]
        for letter in letters:
            which = np.flatnonzero(flat < letter)
            hashes = mix(around[which] + _values(np.array([letter])) * scale[which])
            hit = filters.contains(_shard(length), hashes)
            if passes > 1:
                hit &= _in_pass(hashes, passes, at)
            which = which[hit]
            if len(which):
                row, col = which // width, start + which % width
                spelled = codes[row]
                spelled[np.arange(len(row)), col] = letter
                yield row, _spell(spelled)


def near_pairs(words: DataFrame, max_bytes: int = bloom.MAX_BYTES) -> DataFrame:
    """Pairs (word, near), each once, of distinct non-empty words that differ by one code point inserted, deleted or replaced.

    ``words`` has distinct words in column ``word`` and should be a written table, as
    it is read for the filters, for the edits and for the exact join.
    """
    spark = words.sparkSession
    listed = words.select("word")
    letters = listed.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).filter("c <> ''").distinct()
    # At most as many as there are code points.
    alphabet = np.array(sorted(ord(row["c"]) for row in letters.collect()), np.uint32)
    size = sum(bloom.block_bytes(row["count"]) for row in _hashed(listed).groupBy("shard").count().collect())
    passes = max(1, math.ceil(size / max_bytes))

    def candidates(at: int) -> DataFrame:
        sent = spark.sparkContext.broadcast(bloom.build(_hashed(listed, passes, at), max_bytes).shards)

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = bloom.Filters(sent.value)
            for batch in batches:
                batch_words = batch.column(0).to_pylist()
                for rows, codes in by_length(batch_words):
                    for found, near in edits_found(codes, alphabet, filters, passes, at):
                        made = [batch_words[i] for i in rows[found]]
                        yield pa.RecordBatch.from_arrays([pa.array(made), pa.array(near)], ["word", "near"])

        return listed.mapInArrow(probe, "word string, near string")

    found = reduce(DataFrame.unionByName, [candidates(at) for at in range(passes)])
    return found.join(listed.withColumnRenamed("word", "near"), "near").select("word", "near")


def group_variants(
    words: DataFrame,
    stage: Staging,
    word: str = "word",
    n: str = "n",
    ratio: int = 10,
    max_bytes: int = bloom.MAX_BYTES,
) -> DataFrame:
    """Per distinct word: ``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root``.

    ``form`` is the near word of largest count, the smallest of equals, if it occurs
    at least ``ratio`` (2 or more) times as often, else null; ``root`` is the end of
    the chain of forms, the word itself where it has none. Counts grow by ``ratio`` at
    each step of a chain, so the number of rounds is the logarithm of a logarithm of
    the largest count. A null count is 0.
    """
    if ratio < 2:
        raise ValueError("forms must occur at least twice as often as their variants")
    counted = words.select(F.col(word).alias("word"), F.coalesce(F.col(n), F.lit(0)).cast("long").alias("n"))
    vocabulary = stage.table(
        "vocabulary", counted.filter("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))
    )
    pairs = stage.table("pairs", near_pairs(vocabulary, max_bytes))
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near")))
    near = both.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), "near")).alias("best")
    )
    joined = vocabulary.join(best, "word", "left")
    large = -F.col("best.k") >= ratio * F.col("n")
    told = stage.table(
        "forms",
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(large, F.col("best.near")).alias("form"),
            F.when(large, -F.col("best.k")).alias("form_n"),
        ),
    )
    links = told.filter("form is not null").select("word", F.col("form").alias("root"))
    most = told.agg(F.max("n").alias("n")).first()["n"] or 1
    steps = math.ceil(math.log(max(2, most), ratio)) + 1
    for at in range(math.ceil(math.log2(steps))):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        links = stage.table(
            f"roots-{at}",
            links.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root")),
        )
    return told.join(links, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )
