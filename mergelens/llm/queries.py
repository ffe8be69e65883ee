"""Registered queries of the operators, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from mergelens.llm import chat, langid, lm, pii, warc
from mergelens.llm.common import crc_remainder, staging, table
from mergelens.llm.fingerprints import fingerprint_edits
from mergelens.llm.idfile import read_documents, with_starts, write_ids
from mergelens.llm.minhash import near_duplicates
from mergelens.llm.mixing import mix
from mergelens.llm.packing import pack_documents
from mergelens.llm.phrases import collocations
from mergelens.llm.spelling import group_variants
from mergelens.llm.subspace import near_vectors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


@_query
def op1_backoff_automaton(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = crc_remainder("doc_id", 7) == 2
    return lm.score(docs, ~held_out, staging(spark), ["doc_id", held_out.alias("held_out")])


@_query
def op2_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    stage = staging(spark)
    written = stage.table("chats", chat.format_chats(turns.unionByName(more)))
    formatted, learned = chat.formatted_text(), chat.loss_text()
    read = written.select("conv_id", "valid", formatted.alias("formatted"), learned.alias("learned"))
    read = read.withColumn("turns", chat.parse_turns(F.col("formatted")))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


@_query
def op3_context_mixing_ids(spark, sf_dir):
    stage = staging(spark)
    path = f"{stage.path}/ids"
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    found = with_starts(stage.table("documents", read_documents(spark, path)))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


@_query
def op4_vector_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op5_golden_mix(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"), staging(spark))


@_query
def op6_minmax_near_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = near_duplicates(docs, staging(spark), shingle=3, similarity=(17, 20))
    return found.withColumnRenamed("id", "doc_id")


@_query
def op7_subspace_pigeonhole(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"), staging(spark))


@_query
def op8_invertible_sketch(spark, sf_dir):
    return fingerprint_edits(table(spark, sf_dir, "documents"), staging(spark))


@_query
def op9_warc_revisits(spark, sf_dir):
    stage = staging(spark)
    path = f"{stage.path}/archives"
    warc.write_archives(table(spark, sf_dir, "pages"), path, stage)
    return warc.read_archives(spark, path)


@_query
def op10_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = (crc_remainder("doc_id", 4) == 2).alias("held_out")
    model = langid.train(docs.filter(~held_out))
    return langid.predict(docs, model, ["doc_id", held_out])


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def counted_words(docs: DataFrame, min_length: int = 7, min_count: int = 2) -> DataFrame:
    """``word`` and ``n``: runs of letters, lower-cased, some with one letter left out as their hash with the id says."""
    runs = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit("[a-z\u00C0-\u00FF]+"), F.lit(0))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    length, h = F.length("run"), F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    found = found.filter(length >= min_length).select("run", h.alias("h"), (h % length).cast("int").alias("at"))
    cut = F.concat(F.substring(F.col("run"), F.lit(1), F.col("at")), F.substring(F.col("run"), F.col("at") + 2, length))
    words = found.select(F.when(F.col("h") % 31 == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(
        F.col("n") >= min_count
    )


@_query
def op11_bloom_variants(spark, sf_dir):
    return group_variants(counted_words(table(spark, sf_dir, "documents")), staging(spark))


@_query
def op12_personal_data(spark, sf_dir):
    found = pii.find_spans(table(spark, sf_dir, "documents"), ["doc_id"])

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in pii.BASE_KINDS]
    digest = F.sha2(joined(of(*pii.BASE_KINDS)).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, joined(F.col("spans")).alias("spans"))


@_query
def op13_phrase_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"), staging(spark))
