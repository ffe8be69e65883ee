"""Near-duplicate vectors by a subspace pigeonhole join.

Two unit vectors with cosine c are sqrt(2 - 2c) apart. After a rotation the
dimensions are cut into ``blocks`` blocks, each with its share of the squared
distance as budget; of two close vectors at least one block is within its budget.
Per block that is a range join: the lengths of two vectors' blocks differ by no
more than the root of the budget, so vectors are cut into strips of block length
holding about ``strip`` vectors each, and only strips (and of these, only vectors)
within reach meet, one pair of strips per task. Candidates of a block are checked
with all dimensions in double precision, in the first block that has them, so each
link is counted once. A task returns counts and a spanning forest of its links,
never its pairs.

Equal vectors are one class from the start; a class counts as often as it has rows.
Strips are cut on the length plus a tiny hashed amount, so vectors that share a
block's length still spread over strips.

Vectors of different lengths have no cosine; each length that has more than one
distinct vector is a join of its own, one after another. Null vectors, zero vectors and
vectors with a null or non-finite component link with nothing. Every row is a vector of
its own, also when it repeats another or its id; rows without id take part, but give no
component its id. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mergelens.llm.components import components
from mergelens.sources.staging import Staging

_BLUR = 1e-4
_PAIRS = 100_000  # checked at once
_ROWS, _COLUMNS = 256, 2048  # of two strips at once: their distances fit a processor's cache


def rotation(dim: int, seed: int = 1) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def block_edges(dim: int, blocks: int) -> np.ndarray:
    return np.linspace(0, dim, min(blocks, dim) + 1).round().astype(int)


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True) if len(rows) else rows
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True)) if len(rows) else rows


def _lengths(unit: np.ndarray, keys: np.ndarray, turn: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Blurred block lengths, rows x blocks."""
    turned = unit @ turn
    blur = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(float) * (_BLUR / 2**53)
    cuts = zip(edges[:-1], edges[1:], strict=True)
    return np.stack([np.sqrt((turned[:, a:b] ** 2).sum(axis=1)) + blur for a, b in cuts], axis=1)


class _Forest:
    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, p: np.ndarray, q: np.ndarray) -> None:
        while len(p):
            a, b = self.root[p], self.root[q]
            apart = a != b
            p, q, a, b = p[apart], q[apart], a[apart], b[apart]
            np.minimum.at(self.root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _tile_links(
    unit: np.ndarray, weight: np.ndarray, left: np.ndarray, right: np.ndarray | None, block: int,
    turn: np.ndarray, edges: np.ndarray, budgets: np.ndarray, cosine: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Links per row, and a root per row, from pairs of ``left`` and ``right`` (None: pairs inside ``left``)."""
    turned = unit @ turn
    cut = turned[:, edges[block] : edges[block + 1]].astype(np.float32)
    squares, one = (cut * cut).sum(axis=1, keepdims=True), np.ones((len(cut), 1), np.float32)
    # One product gives squared distances: |x|^2 - 2xy + |y|^2.
    plus, minus = np.hstack([cut, one, squares]), np.hstack([-2 * cut, squares, one])
    most = np.float32(budgets[block] * 1.001 + 1e-6)
    counts, forest = np.zeros(len(unit), np.int64), _Forest(len(unit))
    other = left if right is None else right

    def check(p: np.ndarray, q: np.ndarray) -> None:
        apart = np.add.reduceat((turned[p] - turned[q]) ** 2, edges[:-1], axis=1)
        within = apart <= budgets
        good = (within.argmax(axis=1) == block) & within[:, block]
        p, q = p[good], q[good]
        good = (unit[p] * unit[q]).sum(axis=1) >= cosine
        p, q = p[good], q[good]
        np.add.at(counts, p, weight[q])
        np.add.at(counts, q, weight[p])
        forest.join(p, q)

    for begin in range(0, len(other), _COLUMNS):
        columns = other[begin : begin + _COLUMNS]
        facing = plus[columns].T.copy()
        # Inside one strip a pair is met once, with its later member as column.
        last = len(left) if right is not None else min(len(left), begin + len(columns))
        for at in range(0, last, _ROWS):
            rows = left[at : min(at + _ROWS, last)]
            one, two = np.nonzero(minus[rows] @ facing <= most)
            if right is None:
                later = begin + two > at + one
                one, two = one[later], two[later]
            for part in range(0, len(one), _PAIRS):
                check(rows[one[part : part + _PAIRS]], columns[two[part : part + _PAIRS]])
    return counts, forest.root


def near_vectors(
    vectors: DataFrame, stage: Staging, id: str = "vec_id", embedding: str = "embedding",
    cosine: float = 0.95, blocks: int = 4, strip: int = 8192, seed: int = 1,
) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every row of ``vectors``."""
    v = F.col("v")
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(embedding).alias("v"))
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    sound = F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(sound, v))
    rows = stage.table("rows", rows.withColumn("key", F.when(v.isNotNull(), F.xxhash64("v"))))
    classes = rows.filter("key is not null").groupBy("key", "v").agg(
        F.count("*").alias("weight"), F.min("vec_id").alias("low")
    )
    classes = stage.table("classes", classes.withColumn("dim", F.size("v")))
    # One row per length; the longest vector bounds their number.
    lengths = classes.groupBy("dim").agg(F.count("*").alias("n")).filter("n > 1").orderBy("dim").collect()
    linked = classes.filter("false").select(F.col("key").alias("a"), F.col("key").alias("b"), F.col("weight").alias("n"))
    for dim, n in lengths:
        own = _links(classes.filter(F.col("dim") == dim), dim, n, cosine, blocks, strip, seed)
        linked = linked.unionByName(stage.table(f"linked-{dim}", own))
    counts = linked.groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    found = components(linked.select("a", "b"), stage, "components").withColumnRenamed("id", "key")
    known = classes.select("key", "weight", "low").join(counts, "key", "left").join(found, "key", "left")
    known = known.withColumn("component", F.coalesce("component", "key"))
    lowest = known.groupBy("component").agg(F.min("low").alias("component_id"))
    links = (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")
    known = stage.table("labels", known.join(lowest, "component").select("key", links, "component_id"))
    out = rows.select("vec_id", "key").join(known, "key", "left")
    own = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), own.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("vec_id").isNull()))


def _links(classes: DataFrame, dim: int, n: int, cosine: float, blocks: int, strip: int, seed: int) -> DataFrame:
    """Per task and class with links: key ``a``, a forest's link to ``b``, ``n`` rows linked; ``n`` classes of length ``dim``."""
    turn, edges = rotation(dim, seed), block_edges(dim, blocks)
    budgets = (2 - 2 * cosine) * np.diff(edges) / dim * (1 + 1e-9)
    radius = np.sqrt(budgets) + _BLUR + 1e-6

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            found = _lengths(_matrix(batch.column(1), dim), keys, turn, edges)
            yield pa.RecordBatch.from_pydict({"lengths": pa.array(list(found), pa.list_(pa.float64()))})

    strips = max(1, math.ceil(n / strip))
    inner: list[np.ndarray] = [np.zeros(0)] * len(radius)
    if strips > 1:
        shares = F.array(*[F.lit(k / strips) for k in range(1, strips)])
        measured = classes.select("key", "v").mapInArrow(measure, "lengths array<double>")
        cuts = measured.agg(
            *[F.percentile_approx(F.col("lengths")[b], shares, 20 * strips).alias(f"b{b}") for b in range(len(radius))]
        ).first()
        inner = [np.unique(cuts[f"b{b}"]) for b in range(len(radius))]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector to the pairs of strips it can have a partner in."""
        for batch in batches:
            keys = batch.column(0).to_numpy()
            found = _lengths(_matrix(batch.column(1), dim), keys, turn, edges)
            for b, cut in enumerate(inner):
                lengths = found[:, b]
                own = np.searchsorted(cut, lengths, side="right")
                low = np.searchsorted(cut, lengths - radius[b], side="right")
                high = np.searchsorted(cut, lengths + radius[b], side="right")
                n = high - low + 1
                row = np.repeat(np.arange(len(keys)), n)
                mate = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[row]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(row), b)), pa.array(np.minimum(own[row], mate)),
                        pa.array(np.maximum(own[row], mate)), pa.array(own[row]),
                        *[batch.column(c).take(pa.array(row)) for c in (0, 1, 2)],
                    ],
                    names=["b", "i", "j", "own", "key", "v", "weight"],
                )

    kind = dict(classes.dtypes)["v"]
    dealt = classes.select("key", "v", "weight").mapInArrow(
        deal, f"b long, i long, j long, own long, key long, v {kind}, weight long"
    )

    def meet(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        b, i, j = (table.column(c)[0].as_py() for c in ("b", "i", "j"))
        own, keys = table.column("own").to_numpy(), table.column("key").to_numpy()
        unit = _matrix(table.column("v").combine_chunks(), dim)
        left = np.flatnonzero(own == i)
        right = None if i == j else np.flatnonzero(own == j)
        counts, root = _tile_links(
            unit, table.column("weight").to_numpy(), left, right, b, turn, edges, budgets, cosine
        )
        hit = counts > 0
        return pa.table({"a": keys[hit], "b": keys[root[hit]], "n": counts[hit]})

    return dealt.groupBy("b", "i", "j").applyInArrow(meet, "a long, b long, n long")
