"""Collocations: phrases of two to five words that occur often and together more than apart.

Texts are cut into pieces and words; every word position points to a suffix of its
piece, of at most five words. Suffixes are routed over all tasks by their leading
words, as ranges, so each task holds a contiguous stretch of the sorted order. There a
multikey three-way quicksort of pointers partitions by one word at a time: the size
of an equal partition is the count of the phrase read so far, and partitions too
small to hold a frequent phrase are abandoned. A leading word, or a whole phrase, may
run over the borders of ranges; the phrases at both borders of a task are reported
whatever their count and added up, so no group has to fit one task.

Before routing, suffixes end where a word or a pair of words is too rare for a
frequent phrase; that is asked of Bloom filters of bounded size, whose false
positives only lengthen suffixes. Equal suffixes of a task are routed once, with
their number. Words are 64-bit hashes of language and word; if two words of the
corpus share a hash, all is done again with other hashes, so counts are exact.

A null language is ``und``, as is the language of that name; null and empty texts have
no words; repeated rows count as often as they occur; extra columns play no part. A
very long text is worked on in stretches of pieces, a piece in one array. An empty
table, or one without frequent phrases, gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mergelens.llm import bloom
from mergelens.llm.words import CHUNK_BYTES, mix, text_buffers, text_runs
from mergelens.sources.staging import Staging

_U = np.uint64
DEPTH = 5
ROWS_PER_TASK = 400_000
BUFFERED = 1_000_000  # suffixes of a task merged at once
KEY = [f"w{i}" for i in range(1, DEPTH + 1)]

_WORD, _SPACE, _BREAK = 0, 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = _SPACE
_CLASS[[ord(c) for c in ".,;:!?"] + list(range(0x0A, 0x0E))] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Polynomial hashes of byte spans, read off prefix sums."""
    base = int(mix(np.array([seed + 1], _U) * _U(0x9E3779B97F4A7C15))[0]) | 1
    value = mix(np.arange(256, dtype=_U) + _U(0x2545F491 + 1024 * seed))
    powers = []
    for step in (base, pow(base, -1, 1 << 64)):
        steps = np.full(len(data) + 1, step, _U)
        steps[0] = 1
        powers.append(np.multiply.accumulate(steps))
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(value[data] * powers[0][:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * powers[1][start] + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def _stretches(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets with further cuts at breaks inside long texts, and the row of each stretch."""
    rows = np.arange(len(offsets) - 1)
    long = np.flatnonzero(np.diff(offsets) > CHUNK_BYTES)
    if not len(long):
        return offsets, rows
    cuts = [offsets]
    for row in long:
        first, last = int(offsets[row]), int(offsets[row + 1])
        breaks = first + np.flatnonzero(_CLASS[data[first:last]] == _BREAK)
        at = np.searchsorted(breaks, np.arange(first + CHUNK_BYTES, last, CHUNK_BYTES))
        cuts.append(breaks[at[at < len(breaks)]])
    refined = np.unique(np.concatenate(cuts))  # drops empty rows, which have no words
    return refined, np.searchsorted(offsets, refined[:-1], side="right") - 1


class Words:
    """The words of a stretch of texts: hashes with their language, spans, and whether the next word follows in the piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray, seed: int):
        n = len(data)
        kind = _CLASS[data]
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = kind == _WORD
        opens, closes = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        filled = offsets[:-1] < offsets[1:]
        first, last = offsets[:-1][filled], offsets[1:][filled] - 1
        opens[first] = inside[1:-1][first]
        closes[last] = inside[1:-1][last]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.data = _LOWER[data]
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        hashes = span_hashes(self.data, self.start, self.end, seed)
        hashes = mix(hashes + langs[self.row] * _U(0x8CB92BA72F3D8DD7))
        hashes[hashes == 0] = 1  # 0 ends a suffix
        self.hashes = hashes
        piece = np.cumsum(kind == _BREAK)[self.start] + self.row if len(self.start) else self.start
        self.follows = piece[:-1] == piece[1:]

    def spelled(self, at: np.ndarray) -> pa.Array:
        """The words at some positions as strings."""
        start, size = self.start[at], self.end[at] - self.start[at]
        ends = np.cumsum(size)
        index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)
        offsets = np.concatenate(([0], ends)).astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(self.data[index]))


def _lang_value(lang: str, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{lang}".encode(), digest_size=8).digest(), "little")


def batch_words(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[Words, pa.Array]]:
    """The words of a batch (text, lang) in stretches of bounded size, with the languages of the rows of each."""
    offsets, data = text_buffers(batch.column(0))
    base = offsets[0]
    offsets, data = offsets - base, data[base : offsets[-1]]
    told = pc.fill_null(batch.column(1), "und")
    coded = told.dictionary_encode()
    values = np.array([_lang_value(lang, seed) for lang in coded.dictionary.to_pylist()], _U)
    langs = values[coded.indices.to_numpy(zero_copy_only=False)]
    cut, owner = _stretches(offsets, data)
    for first, stop in text_runs(cut):
        part = cut[first : stop + 1]
        if part[0] < part[-1]:
            rows = owner[first:stop]
            yield Words(data[part[0] : part[-1]], part - part[0], langs[rows], seed), told.take(pa.array(rows))


def merged(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a table of words with the sum of their counts."""
    if not len(rows):
        return rows, counts
    order = np.lexsort(rows.T[::-1])
    rows, counts = rows[order], counts[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    return rows[at], np.add.reduceat(counts, at)


def _counted(parts: Iterator[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of words, merged as they come; at most ``BUFFERED`` and one part are held."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        rows = np.concatenate(held)
        rows, counts = merged(rows, np.ones(len(rows), np.int64))
        columns = [pa.array(np.ascontiguousarray(rows[:, i])) for i in range(rows.shape[1])]
        return pa.RecordBatch.from_arrays([*columns, pa.array(counts)], [*names, "c"])

    for part in parts:
        held.append(part)
        size += len(part)
        if size >= BUFFERED:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def _count_words(docs: DataFrame, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, langs in batch_words(batch, seed):
                found, at, times = np.unique(words.hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found.view(np.int64)),
                        langs.take(pa.array(words.row[at])),
                        words.spelled(at),
                        pa.array(times.astype(np.int64)),
                    ],
                    ["h", "lang", "word", "c"],
                )

    rows = docs.mapInArrow(run, "h long, lang string, word string, c long")
    return rows.groupBy("h", "lang", "word").agg(F.sum("c").alias("n"))


def _pair_hash(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _U(0x9FB21C651E98DF25) + second)


def _count_pairs(docs: DataFrame, seed: int, words_sent) -> DataFrame:
    """Neighbouring words that may both be frequent, with the number of times they meet."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        known = bloom.Filters(words_sent.value)
        for batch in batches:
            for words, _ in batch_words(batch, seed):
                may = known.contains(0, words.hashes)
                at = np.flatnonzero(words.follows & may[:-1] & may[1:])
                yield np.stack([words.hashes[at], words.hashes[at + 1]], axis=1).view(np.int64)

    rows = docs.mapInArrow(lambda batches: _counted(pairs(batches), KEY[:2]), "w1 long, w2 long, c long")
    return rows.groupBy("w1", "w2").agg(F.sum("c").alias("n"))


def _suffixes(docs: DataFrame, seed: int, pairs_sent) -> DataFrame:
    """Suffixes of three to five words, 0 where they end earlier, with the number of times a task met them."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        known = bloom.Filters(pairs_sent.value)
        for batch in batches:
            for words, _ in batch_words(batch, seed):
                h = words.hashes
                if len(h) < 3:
                    continue
                link = words.follows & known.contains(0, _pair_hash(h[:-1], h[1:]))
                at = np.flatnonzero(link[:-1] & link[1:])
                rows = np.zeros((len(at), DEPTH), _U)
                rows[:, 0], rows[:, 1], rows[:, 2] = h[at], h[at + 1], h[at + 2]
                goes = np.ones(len(at), bool)
                for depth in range(3, DEPTH):
                    goes &= at + depth < len(h)
                    goes[goes] = link[at[goes] + depth - 1]
                    rows[goes, depth] = h[at[goes] + depth]
                yield rows.view(np.int64)

    schema = ", ".join(f"{k} long" for k in KEY) + ", c long"
    return docs.mapInArrow(lambda batches: _counted(windows(batches), KEY), schema)


def _border(rows: np.ndarray, counts: np.ndarray, last: bool) -> dict[tuple, int]:
    """The prefixes of the smallest or largest suffix with their counts in this task."""
    at, found = np.arange(len(rows)), {}
    for depth in range(DEPTH):
        column = rows[at, depth]
        word = column.max() if last else column.min()
        if word == 0:
            break
        at = at[column == word]
        found[tuple(rows[at[0], : depth + 1].tolist())] = int(counts[at].sum())
    return found


def frequent_prefixes(rows: np.ndarray, counts: np.ndarray, least: int, shortest: int = 3) -> dict[tuple, int]:
    """Counts of the prefixes, of ``shortest`` words or more, of one task's suffixes.

    Multikey three-way quicksort of pointers into ``rows``: a partition is split by
    one word into smaller, equal and larger; the equal part goes on with the next
    word, and its size is the count of the words read. Parts below ``least`` are
    abandoned, but the prefixes of the first and last suffix are told with any count.
    """
    if not len(rows):
        return {}
    found = {}
    work = [(np.arange(len(rows)), 0)]
    while work:
        at, depth = work.pop()
        words = rows[at, depth]
        pivot = np.sort(words[:: max(1, len(words) // 15)])
        pivot = pivot[len(pivot) // 2]
        equal = words == pivot
        for part in (at[words < pivot], at[words > pivot]):
            if len(part) and counts[part].sum() >= least:
                work.append((part, depth))
        if pivot != 0:
            same = at[equal]
            size = int(counts[same].sum())
            if size >= least:
                if depth + 1 >= shortest:
                    found[tuple(rows[same[0], : depth + 1].tolist())] = size
                if depth + 1 < DEPTH:
                    work.append((same, depth + 1))
    for last in (False, True):
        found.update({k: n for k, n in _border(rows, counts, last).items() if len(k) >= shortest})
    return found


def _sorted_counts(suffixes: DataFrame, least: int) -> DataFrame:
    """Frequent phrases of three to five words (array ``p``) with their counts ``f``."""
    parts = max(1, -(-suffixes.count() // ROWS_PER_TASK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([c.to_numpy() for c in batch.columns], axis=1) for batch in batches if batch.num_rows]
        if held:
            rows = np.concatenate(held)
            found = frequent_prefixes(np.ascontiguousarray(rows[:, :DEPTH]), rows[:, DEPTH], least)
            phrases = pa.array([list(k) for k in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([phrases, pa.array(list(found.values()), pa.int64())], ["p", "c"])

    routed = suffixes.repartitionByRange(parts, *KEY)
    return routed.mapInArrow(run, "p array<long>, c long").groupBy("p").agg(F.sum("c").alias("f")).filter(F.col("f") >= least)


def _phrase_counts(docs: DataFrame, stage: Staging, scratch: Staging, least: int, max_bytes: int):
    """Frequent words (h, lang, word, n), words per language (lang, total), and counts ``f`` of frequent phrases ``p``."""
    spark = docs.sparkSession
    for seed in count():
        words = scratch.table(f"words-{seed}", _count_words(docs, seed))
        if words.groupBy("h").count().filter("count > 1").isEmpty():
            break
    frequent = stage.table("words", words.filter(F.col("n") >= least))
    totals = stage.table("totals", words.groupBy("lang").agg(F.sum("n").alias("total")))
    shard = F.lit(0).alias("shard")
    sent = spark.sparkContext.broadcast(bloom.build(frequent.select(shard, "h"), max_bytes).shards)
    # Suffixes go on over pairs of a quarter of the count: how many are routed then
    # grows with the texts, not with the share of pairs that have just become frequent.
    bar = max(1, least // 4)
    pairs = scratch.table("pairs", _count_pairs(docs, seed, sent).filter(F.col("n") >= bar))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = (c.to_numpy().view(_U) for c in batch.columns[:2])
            h = _pair_hash(first, second).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(h), np.int32)), pa.array(h)], ["shard", "h"])

    members = pairs.select("w1", "w2").mapInArrow(hashed, "shard int, h long")
    sent = spark.sparkContext.broadcast(bloom.build(members, max_bytes).shards)
    suffixes = scratch.table("suffixes", _suffixes(docs, seed, sent))
    counts = (
        _sorted_counts(suffixes, least)
        .unionByName(pairs.filter(F.col("n") >= least).select(F.array("w1", "w2").alias("p"), F.col("n").alias("f")))
        .unionByName(frequent.select(F.array("h").alias("p"), F.col("n").alias("f")))
    )
    return frequent, totals, stage.table("counts", counts)


def _exact(*factors) -> F.Column:
    """Product of three longs at most as an exact decimal."""
    out = F.lit(1).cast("decimal(1, 0)")
    for factor in factors:
        out = (out * factor.cast("decimal(19, 0)")).cast("decimal(38, 0)")
    return out


def collocations(
    docs: DataFrame,
    stage: Staging,
    text: str = "text",
    lang: str = "lang",
    least: int = 100,
    top: int | None = 2000,
    scratch: Staging | None = None,
    max_bytes: int = bloom.MAX_BYTES,
) -> DataFrame:
    """Per language the ``top`` phrases by score, or all with None: lang, rank, phrase, a, l, r, n, score.

    Phrases occur at least ``least`` times (``a``) in a language of ``n`` words. The cut
    into two parts of counts ``l`` and ``r`` is the one of lowest score
    floor(1000 a n / (l r)), the earliest of equals. Phrases inside a longer one of
    equal count are dropped. Order is by score and a, both descending, then phrase.
    """
    scratch = scratch or Staging(docs.sparkSession)
    read = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    words, totals, counts = _phrase_counts(read, stage, scratch, least, max_bytes)
    scratch.close()
    length = F.size("p")
    phrases = counts.filter(length >= 2).withColumnRenamed("f", "a")

    # A phrase inside a longer one of equal count is also inside one that is longer by one word.
    inner = phrases.filter(length >= 3).select(
        F.explode(F.array(F.slice("p", F.lit(1), length - 1), F.slice("p", F.lit(2), length - 1))).alias("p"), "a"
    )
    open_ = phrases.join(inner, ["p", "a"], "left_anti")

    cuts = open_.select("p", "a", F.explode(F.sequence(F.lit(1), length - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("p", F.lit(1), F.col("k")), "right": F.slice("p", F.col("k") + 1, length)})
    cuts = cuts.join(counts.select(F.col("p").alias("left"), F.col("f").alias("l")), "left")
    cuts = cuts.join(counts.select(F.col("p").alias("right"), F.col("f").alias("r")), "right")
    named = words.join(totals, "lang").select(F.col("h").alias("head"), "lang", F.col("total").alias("n"))
    cuts = cuts.withColumn("head", F.element_at("p", 1)).join(named, "head")
    score = F.expr("x div y")
    scored = cuts.withColumns(
        {"x": _exact(F.lit(1000), F.col("a"), F.col("n")), "y": _exact(F.col("l"), F.col("r"))}
    ).withColumn("score", score)
    best = scored.groupBy("p", "a", "lang", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))

    spelled = best.select("p", F.posexplode("p").alias("at", "h")).join(words.select("h", "word"), "h")
    spelled = spelled.groupBy("p").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
    spelled = spelled.select("p", F.array_join(F.col("words.word"), " ").alias("phrase"))
    rows = best.join(spelled, "p").select(
        "lang", "phrase", "a", "best.l", "best.r", "n", F.col("best.score").alias("score")
    )
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    if top is None:
        return rows.select("lang", F.lit(None).cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    # First within parts of a language, so that no task sorts all of its phrases.
    part = F.pmod(F.xxhash64("phrase"), F.lit(256))
    within = F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))
    rows = rows.withColumn("_part", part).withColumn("rank", within).filter(F.col("rank") <= top)
    overall = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    rows = rows.withColumn("rank", overall).filter(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
