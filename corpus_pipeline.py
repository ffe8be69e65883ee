"""A training corpus from ``documents``: language ID, near-duplicates, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns
a DataFrame that is written as Parquet and read again as the next one's ``docs``. All
but the last return the columns of ``documents``. The stages are batch models and
string work that DuckDB SQL cannot express, so ``ORACLE_SQL`` is None; the tests hold
them against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelens.llm import langid
from mergelens.llm.common import numbered, row_struct, staging, table
from mergelens.llm.minhash import near_duplicates
from mergelens.llm.mixing import WORD, mix
from mergelens.llm.packing import pack_documents

ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter, whatever their language; labels of the input teach the model.

    Without a usable label no language can be told, and all documents with a letter stay.
    """
    model = langid.train(docs)
    if not model["langs"]:
        return docs.filter(langid.has_letter("text"))
    told = langid.predict(docs, model, [row_struct(docs)])
    return told.filter(F.col("lang_pred") != langid.UNKNOWN).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, Jaccard similarity of 0.8 or more.

    Of a group the row with the smallest doc_id stays, null last; of rows with the same
    doc_id, one chosen by content. Every row is judged by its own text, whatever its
    doc_id; rows without a word link with nothing, and all of them stay.
    """
    stage = staging(spark)
    rows = numbered(docs, stage)
    texts = rows.select("key", F.col("row.text").alias("text"))
    found = near_duplicates(texts, stage, id="key")
    names = rows.select(F.col("key").alias("id"), F.col("row.doc_id").alias("doc_id"), "content")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "content", "id")
    kept = found.join(names, "id").groupBy("component_id").agg(F.min(first)["id"].alias("key"))
    return rows.join(kept.select("key").hint("shuffle_hash"), "key").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document taken n times over is n rows; of the copy at a stream's end only the words taken.

    What is taken is worked out on keys and sizes; whole rows meet it in one join.
    """
    stage = staging(spark)
    rows = numbered(docs, stage)
    sizes = rows.select("key", "content", F.col("row.text").alias("text"), F.col("row.source").alias("source"))
    taken = mix(sizes, stage, id="key", order="content").filter("taken > 0")
    taken = taken.select(F.col("doc_id").alias("key"), "size", "taken")
    rows = rows.join(taken.hint("shuffle_hash"), "key")
    copies = F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))
    rows = rows.select("row", "size", "taken", F.explode(copies).alias("copy"))
    part = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    words = F.regexp_extract_all("row.text", F.lit(f"({WORD})"), F.lit(1))
    cut = F.array_join(F.slice(words, F.lit(1), part.cast("int")), " ")
    text = F.when(part >= F.col("size"), F.col("row.text")).otherwise(cut).alias("text")
    rows = rows.select("row", text)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    quoted = {c: f"row.`{c.replace('`', '``')}`" for c in docs.columns}
    return rows.select(*[new.get(c, F.col(quoted[c])).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    stage, docs = staging(spark), table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage.table(name, apply(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
