"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams (1 to ``order`` code points of the lower-cased text, hashed to
``buckets``) per language become a matrix of log probabilities with add-``alpha``
smoothing. It has one row per language and a fixed number of columns, so its size
is bounded and it is broadcast; texts are scored in batches with numpy.

Training uses at most about ``max_train`` labelled documents, chosen by a hash of
id and text, so the choice does not depend on layout or order; with fewer, all.
Scoring reads whole texts.

A null text and a text without a letter are ``und`` with score 0, as is every text
when there is nothing to learn from. Rows with a null language teach nothing, nor
do rows whose id is null if ``train`` excludes them. Ties go to the language first
in code-point order. Repeated rows are scored each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergelens.llm.common import release

UNKNOWN = "und"
_FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)


def has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def ngram_buckets(text: str, order: int, buckets: int) -> np.ndarray:
    """Bucket of every n-gram of 1 to ``order`` code points."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    parts, total = [], np.zeros(len(points), np.uint32)
    for n in range(min(order, len(points))):
        total = total[: len(points) - n] * np.uint32(31) + (points[n:] + np.uint32(n + 1)) * np.uint32(_FACTORS[n])
        spread = (total ^ (total >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        parts.append((spread ^ (spread >> np.uint32(13))) % np.uint32(buckets))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def train(
    labelled: DataFrame, text: str = "text", lang: str = "lang", id: str = "doc_id",
    order: int = 3, buckets: int = 65_536, alpha: float = 0.1, max_train: int = 30_000,
) -> dict:
    """Languages, log priors and log probabilities (buckets x languages)."""
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.col(id).alias("id"))
    total = rows.select("lang").count()
    if total > max_train:
        scale = 1_000_003
        rows = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(scale)) < int(scale * max_train / total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = counts.setdefault(name, np.zeros(buckets, np.int64))
                held += np.bincount(ngram_buckets(body, order, buckets), minlength=buckets)
                docs[name] = docs.get(name, 0) + 1
        for name, held in counts.items():
            at = np.r_[-1, np.flatnonzero(held)]  # bucket -1 counts documents
            n = np.r_[docs[name], held[at[1:]]]
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(at), "bucket": at, "n": n})

    counted = rows.select("lang", "text").mapInArrow(run, "lang string, bucket long, n long")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(table.column("lang").to_pylist()))
    place = {name: at for at, name in enumerate(names)}
    counts = np.zeros((buckets + 1, len(names)))
    at = np.array([place[x] for x in table.column("lang").to_pylist()], np.int64)
    counts[table.column("bucket").to_numpy() + 1, at] = table.column("n").to_numpy()
    docs, grams = counts[0], counts[1:] + alpha
    return {
        "langs": names, "order": order, "buckets": buckets,
        "prior": np.log(docs / max(1, docs.sum())) if len(names) else docs,
        "log": np.log(grams / grams.sum(axis=0)).astype(np.float32),
    }


def predict(docs: DataFrame, model: dict, keep: list[Column], text: str = "text") -> DataFrame:
    """The ``keep`` columns of every row with ``lang_pred`` and ``score``, its posterior probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.when(has_letter(text), F.col(text)).alias("_text"))
    schema = rows.drop("_text").schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        names, log, prior = held["langs"], held["log"], held["prior"]
        for batch in batches:
            langs, scores = [], []
            for body in batch.column(batch.num_columns - 1).to_pylist():
                if body is None or not names:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                at = ngram_buckets(body, held["order"], held["buckets"])
                total = prior + log.take(at, axis=0).sum(axis=0, dtype=np.float64)
                best = int(total.argmax())
                langs.append(names[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
            columns = [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
            release()

    return rows.mapInArrow(run, schema)
