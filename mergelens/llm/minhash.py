"""Near-duplicate documents by min-max hashing.

Every permutation (multiplication of a shingle's hash by an odd number modulo
2^64) keeps its smallest and its largest value; both agree between two sets with
the probability of their Jaccard similarity, so half the hash evaluations give a
signature of full length. Bands of ``rows`` values make candidates.

Stages, each written to the shared folder:

1. Signatures: set size, a 128-bit fingerprint of the whole shingle set, band keys.
2. Classes of equal sets, by an aggregate; from here on one document stands for all.
3. Candidates of a band bucket: every member with the bucket's smallest member and
   with its most popular one. That is linear in the bucket, whatever its size.
4. Links: Jaccard of the full sets, recomputed from whole texts.
5. Components of the links. In buckets that still hold members of different
   components, members that are in different components meet in a second round;
   inside a component no further link can change the result. So no candidate is lost.

Two texts at similarity s share no bucket with probability (1 - s^rows)^bands: for
the defaults 3e-4 at 0.8, 1e-6 at 0.85 and 2e-10 at 0.9.

Null texts and texts without a word have an empty set and link with nothing. Rows
without an id stay, and none stands for a class. Rows that share an id are judged by
their own text. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mergelens.llm.common import release
from mergelens.llm.components import components
from mergelens.llm.words import hashed_texts, mix, shingle_hashes, text_buffers, text_runs
from mergelens.sources.staging import Staging

_U = np.uint64
_RARE = 64
_SIGNATURE = "id long, n_shingles long, fp long, fp2 long, bands array<long>"


def _multipliers(count: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, count + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set; equal sets have equal ones."""
    with np.errstate(over="ignore"):
        one, two = mix(shingles + _U(0x51ED270B)).sum(dtype=_U), mix(shingles ^ _U(0xA0761D6478BD642F)).sum(dtype=_U)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def _bands(values: np.ndarray, starts: np.ndarray, bands: int, rows: int, seed: int) -> np.ndarray:
    """Band keys (sets x bands) of the sets that ``starts`` cut ``values`` into."""
    half = -(-bands * rows // 2)
    signature = np.empty((2 * half, len(starts)), _U)
    for at, factor in enumerate(_multipliers(half, seed)):
        spread = values * factor
        np.minimum.reduceat(spread, starts, out=signature[2 * at])
        np.maximum.reduceat(spread, starts, out=signature[2 * at + 1])
    keys = np.empty((len(starts), bands), _U)
    for band in range(bands):
        key = np.full(len(starts), band + 1, _U)
        for value in signature[band * rows : (band + 1) * rows]:
            key = mix(key * _U(0x9FB21C651E98DF25) + value)
        keys[:, band] = key
    return keys.view(np.int64)


def signatures(docs: DataFrame, id: str, text: str, shingle: int, bands: int, rows: int, seed: int) -> DataFrame:
    """One row per document: set size, fingerprints and band keys (none for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, stop, hashes, bounds in hashed_texts(batch.column(1)):
                sets = [shingle_hashes(hashes[a:b], shingle) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                prints = np.array([fingerprint(s) for s in sets], np.int64).reshape(-1, 2)
                counts = np.where(sizes > 0, bands, 0)
                keys = np.zeros((0, bands), np.int64)
                if len(full):
                    ends = np.cumsum(sizes[full])
                    keys = _bands(np.concatenate(sets), np.r_[0, ends[:-1]], bands, rows, seed)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(keys.ravel())
                )
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, stop - first), pa.array(sizes), pa.array(prints[:, 0]), pa.array(prints[:, 1]), lists],
                    ["id", "n_shingles", "fp", "fp2", "bands"],
                )
            release()

    rows_in = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    return rows_in.mapInArrow(run, _SIGNATURE)


def _verify(pairs: DataFrame, texts: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b: fingerprints) whose full sets have den * intersection >= num * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # The sets of a run of pairs are held at once, whatever the batch.
            for first, stop in text_runs(text_buffers(batch.column(2))[0] + text_buffers(batch.column(3))[0]):
                part = batch.slice(first, stop - first)
                want = [part.column(at).to_pylist() for at in (0, 1)]
                sides: list[list[np.ndarray]] = [[], []]
                for at in (0, 1):
                    for _, _, hashes, bounds in hashed_texts(part.column(2 + at)):
                        cuts = zip(bounds[:-1], bounds[1:], strict=True)
                        sides[at] += [shingle_hashes(hashes[a:b], shingle) for a, b in cuts]
                good = []
                for one, two, left, right in zip(*sides, *want, strict=True):
                    if fingerprint(one)[0] != left or fingerprint(two)[0] != right:
                        continue  # another text with the same id
                    common = len(np.intersect1d(one, two, assume_unique=True))
                    if den * common >= num * (len(one) + len(two) - common):
                        good.append((left, right))
                yield pa.RecordBatch.from_pydict(
                    {"a": pa.array([g[0] for g in good], pa.int64()), "b": pa.array([g[1] for g in good], pa.int64())}
                )
            release()

    left = texts.select(F.col("id").alias("a_id"), F.col("text").alias("a_text"))
    right = texts.select(F.col("id").alias("b_id"), F.col("text").alias("b_text"))
    joined = pairs.join(left, "a_id").join(right, "b_id").select("a", "b", "a_text", "b_text")
    return joined.mapInArrow(run, "a long, b long").distinct()


def _still_mixed(members: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one component."""
    split = members.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    return members.join(split.filter("x <> y").select("key"), "key", "left_semi")


def _shingles(nodes: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """``fp``, ``shingle`` and ``n`` of the nodes' full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            want = batch.column(0).to_pylist()
            for first, _, hashes, bounds in hashed_texts(batch.column(1)):
                fps, sets = [], []
                for at, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    found = shingle_hashes(hashes[a:b], shingle)
                    if fingerprint(found)[0] == want[first + at]:
                        fps.append(np.full(len(found), want[first + at]))
                        sets.append(found.view(np.int64))
                if fps:
                    n = np.repeat([len(f) for f in fps], [len(f) for f in fps])
                    columns = {"fp": np.concatenate(fps), "shingle": np.concatenate(sets), "n": n}
                    yield pa.RecordBatch.from_pydict(columns)
            release()

    return nodes.join(texts, "id").select("fp", "text").mapInArrow(run, "fp long, shingle long, n long").distinct()


def _second_round(mixed: DataFrame, texts: DataFrame, stage: Staging, shingle: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b: nodes) of different components that may still link.

    With a set's shingles ordered by how many members have them, two sets that link
    share one among the rarest of each. If that is rare (at most ``_RARE`` members)
    the pair comes from it. If not, the two have no rare shingle in common: all of
    these are in no intersection and in every union, which bounds the similarity,
    and only pairs of a bucket that the bound allows are formed.
    """
    nodes = stage.table("nodes", mixed.select("a.fp", "a.id", "component").distinct())
    shingles = stage.table("shingles", _shingles(nodes.select("fp", "id").distinct(), texts, shingle))
    known = shingles.groupBy("shingle").agg(F.count("*").alias("df"))
    rarity = Window.partitionBy("fp").orderBy("df", "shingle")
    placed = shingles.join(known, "shingle").withColumn("at", F.row_number().over(rarity))
    rare = stage.table("rare", placed.filter(F.col("df") <= _RARE).select("fp", "shingle", "n", "at", "df"))
    own = rare.groupBy("fp").agg(F.count("*").alias("own"))

    first = rare.filter(f"df > 1 and at <= n - ceil({num} * n / {den}) + 1")
    first = first.join(nodes, "fp").select("shingle", "component", F.struct("fp", "id", "n").alias("a"))
    other = first.select("shingle", F.col("component").alias("component_b"), F.col("a").alias("b"))
    sizes = f"least(a.n, b.n) * {den} >= greatest(a.n, b.n) * {num}"
    by_rare = first.join(other, "shingle").filter("component < component_b").filter(sizes).select("a", "b")

    marked = mixed.withColumn("fp", F.col("a.fp")).join(own, "fp", "left").drop("fp")
    marked = marked.withColumn("own", F.coalesce("own", F.lit(0)))
    marked = stage.table("bounded", _still_mixed(marked.filter(f"(a.n - own) * {den} >= a.n * {num}")))
    other = marked.select("key", F.col("component").alias("component_b"), F.col("a").alias("b"), F.col("own").alias("own_b"))
    best = f"least(a.n - own, b.n - own_b) * {den} >= greatest(a.n + own_b, b.n + own) * {num}"
    by_bucket = marked.join(other, "key").filter("component < component_b").filter(best).select("a", "b")
    return by_rare.union(by_bucket)


def near_duplicates(
    docs: DataFrame,
    stage: Staging,
    id: str = "doc_id",
    text: str = "text",
    shingle: int = 5,
    similarity: tuple[int, int] = (4, 5),
    bands: int = 35,
    rows: int = 7,
    seed: int = 1,
) -> DataFrame:
    """``id``, ``n_shingles``, ``component_id`` and ``kept`` of every row of ``docs``.

    Sets are linked at a Jaccard similarity of at least ``similarity`` (a fraction).
    ``component_id`` is the smallest id reachable by links; ``kept`` marks the
    document with that id.
    """
    num, den = similarity
    signed = stage.table("signatures", signatures(docs, id, text, shingle, bands, rows, seed))
    sets = signed.filter("n_shingles > 0")
    classes = sets.groupBy("fp", "fp2").agg(
        F.min("id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
    )
    classes = stage.table("classes", classes)

    members = classes.filter("id is not null").select(F.explode("bands").alias("key"), "fp", "id", "n")
    shared = members.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    node = F.struct("fp", "id", "n")
    members = stage.table("members", members.join(shared, "key"))
    # The member that shares buckets with most others is the likeliest to link with any of them.
    popular = members.groupBy("fp").agg(F.sum("m").alias("p"))
    ranked = members.join(popular, "fp").withColumn("node", node)
    centers = ranked.groupBy("key").agg(
        F.min("node").alias("low"), F.max_by("node", F.struct("p", "fp")).alias("popular")
    )
    centers = stage.table("centers", centers.select("key", F.explode(F.array("low", "popular")).alias("c")).distinct())

    def pairs(one: str, two: str):
        low_first = F.col(f"{one}.fp") < F.col(f"{two}.fp")
        a = F.when(low_first, F.col(one)).otherwise(F.col(two))
        b = F.when(low_first, F.col(two)).otherwise(F.col(one))
        return [a["fp"].alias("a"), a["id"].alias("a_id"), b["fp"].alias("b"), b["id"].alias("b_id")]

    # Sizes alone rule out a pair when the smaller set is below the share of the larger.
    near = "a.fp <> b.fp and least(a.n, b.n) * {den} >= greatest(a.n, b.n) * {num}".format(den=den, num=num)
    first = members.withColumn("a", node).select("key", "a").join(centers.withColumnRenamed("c", "b"), "key")
    first = stage.table("pairs-1", first.filter(near).select(*pairs("a", "b")).distinct())

    # The texts of all members, fetched once. Their ids grow with the input, so they are
    # never broadcast and the plan is the same at every size.
    source = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    wanted = members.select("id").distinct().hint("merge")
    texts = stage.table("texts", source.join(wanted, "id", "left_semi"))
    links = stage.table("links-1", _verify(first, texts, shingle, num, den))
    found = components(links, stage, "components-1")

    # Second round: buckets that still hold more than one component.
    open_members = members.join(found.withColumnRenamed("id", "fp"), "fp", "left")
    open_members = open_members.select("key", F.coalesce("component", "fp").alias("component"), node.alias("a"))
    mixed = stage.table("mixed", _still_mixed(open_members))
    second = _second_round(mixed, texts, stage, shingle, num, den).select(*pairs("a", "b")).distinct()
    second = stage.table("pairs-2", second.join(first, ["a", "b"], "left_anti"))
    if second.isEmpty():
        links_all = found
    else:
        more = stage.table("links-2", _verify(second, texts, shingle, num, den))
        links_all = found if more.isEmpty() else components(links.union(more), stage, "components-2")

    # Smallest document id per component of classes, then back to every row.
    labelled = classes.select("fp", "fp2", "id").join(links_all.withColumnRenamed("id", "fp"), "fp", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "fp"))
    lowest = labelled.groupBy("component").agg(F.min("id").alias("component_id"))
    labelled = stage.table("labels", labelled.join(lowest, "component").select("fp", "fp2", "component_id"))
    out = signed.select("id", "n_shingles", "fp", "fp2").join(labelled, ["fp", "fp2"], "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    out = out.select("id", "n_shingles", own.alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.col("id").isNull())
    return out.withColumn("kept", kept)
