"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

1. Sources get weights 1, 2, 3, 1, ... in code-point order and share all words; a
   target stops at ``most`` times its source's size, and the excess goes to the
   others by weight until none is above. With caps sorted by cap per weight that is
   one pass of running sums over the sources.
2. Slot i of the schedule is the point i * golden ratio modulo 1; the interval of
   the cumulative target shares it falls into names its source. A slot's rank among
   those of its source says which block of the source's stream it holds. A block has
   a fixed number of words, so slots grow with the input. Then each source is settled:
   slots past its target go, blocks that got none follow at the end of the schedule,
   and its last block is cut, so that its words are its target, rounded.
3. A source's stream is its documents in a hashed order, repeated ``most`` times and
   cut into blocks of equal word counts. Positions in the stream come from prefix
   sums over buckets of that order, so a source with a third of all rows is many
   small windows, not one.
4. Slots meet the pieces of documents that their blocks hold, by source and block: the
   mix is those pieces in the order of slots, and what is taken of a document is
   the sum of its pieces.

A null text has size 0, a null source is a source of its own (the last). Documents
without a word are never taken. Equal rows are documents of their own; which of
them comes first makes no difference to the rows. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergelens.sources.staging import Staging

WORD = r"[^\x20\x09-\x0D]+"
_GOLDEN = 2_654_435_769  # of 2^32
_UNIT = 1 << 32
_ORDER_BUCKETS = 4096
_SHARE_BUCKETS = 1024
_SLOT_RUN = 1 << 14


def source_targets(sized: DataFrame, most: int) -> DataFrame:
    """Per source: ``rank``, ``source_size``, ``target`` and its share of all targets as ``low`` to ``high``."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("rank", F.row_number().over(by_name).cast("long"))
    ranked = ranked.withColumn("weight", (F.col("rank") - 1) % 3 + 1)
    ranked = ranked.withColumn("cap", F.col("source_size") * most)
    tight = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    level = (F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    ranked = ranked.withColumn("level", level)
    # The first source that the level does not lift above its cap fixes the level of all later ones.
    free = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("cap_rank", "level"))
    ranked = ranked.withColumn("cap_rank", F.row_number().over(tight))
    settled = F.min(free).over(all_rows)
    uncapped = F.col("cap_rank") >= settled["cap_rank"]
    target = F.when(uncapped, F.least(settled["level"] * F.col("weight"), F.col("cap").cast("double")))
    ranked = ranked.withColumn("target", F.coalesce(target, F.col("cap").cast("double")))
    total = F.greatest(F.sum("target").over(all_rows), F.lit(1e-300))
    upto = F.sum("target").over(by_name.rowsBetween(Window.unboundedPreceding, 0))
    low = F.sum("target").over(by_name.rowsBetween(Window.unboundedPreceding, -1))
    # An edge of shares is one and the same number on both sides of it.
    return ranked.select(
        "source", "rank", "source_size", "target",
        (F.coalesce(low, F.lit(0.0)) / total).alias("low"),
        F.when(F.lead("rank").over(by_name).isNull(), F.lit(2.0)).otherwise(upto / total).alias("high"),
    )


def golden_point(slot: str) -> Column:
    """The slot times the golden ratio modulo 1, to 32 bits; products of halves stay within a long for every slot.

    After 2^32 slots, which have visited each point once, the points come round again.
    """
    low = F.col(slot).bitwiseAND(F.lit(0xFFFF)) * _GOLDEN
    high = F.shiftright(slot, 16).bitwiseAND(F.lit(0xFFFF)) * (_GOLDEN & 0xFFFF) % 0x10000 * 0x10000
    return F.pmod(low + high, F.lit(_UNIT)) / F.lit(float(_UNIT))


def schedule(targets: DataFrame, slots: int) -> DataFrame:
    """Slots ``slot`` with the source ``rank`` and the ``block`` (from 0) of its stream."""
    spark = targets.sparkSession
    points = spark.range(slots).select(F.col("id").alias("slot"), golden_point("id").alias("u"))
    points = points.withColumn("cell", F.floor(F.col("u") * _SHARE_BUCKETS))
    last = F.least(F.floor(F.col("high") * _SHARE_BUCKETS), F.lit(_SHARE_BUCKETS - 1))
    first = F.least(F.floor(F.col("low") * _SHARE_BUCKETS), F.lit(_SHARE_BUCKETS - 1))
    cells = targets.filter("low < high").select("rank", "low", "high", F.explode(F.sequence(first, last)).alias("cell"))
    placed = points.join(cells, "cell").filter("low <= u and u < high").select("slot", "rank")
    placed = placed.withColumn("run", F.floor(F.col("slot") / _SLOT_RUN))
    runs = placed.groupBy("rank", "run").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("rank").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("rank", "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("rank", "run").orderBy("slot")
    ranked = placed.withColumn("at", F.row_number().over(within)).join(runs, ["rank", "run"])
    return ranked.select("slot", "rank", (F.col("base") + F.col("at") - 1).alias("block"))


def settle(placed: DataFrame, targets: DataFrame, slots: int, block_words: int) -> DataFrame:
    """The schedule with ``words`` per slot, in all the rounded target of each source."""
    quota = F.round("target").cast("long")
    wanted = targets.select("rank", quota.alias("quota"), F.ceil(quota / block_words).alias("blocks"))
    held = placed.groupBy("rank").agg(F.count("*").alias("held"))
    late = wanted.join(held, "rank", "left").withColumn("held", F.coalesce("held", F.lit(0))).filter("held < blocks")
    late = late.select("rank", F.explode(F.sequence(F.col("held"), F.col("blocks") - 1)).alias("block"))
    at = F.row_number().over(Window.orderBy("block", "rank"))
    late = late.select((F.lit(slots - 1) + at).cast("long").alias("slot"), "rank", "block")
    words = F.least(F.lit(block_words), F.col("quota") - F.col("block") * block_words)
    settled = placed.unionByName(late).join(wanted, "rank").filter("block < blocks")
    return settled.select("slot", "rank", "block", words.cast("long").alias("words"))


def stream_positions(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Every row with its source's ``rank`` and the word of the source's stream it starts at, ``start``."""
    named = targets.withColumnRenamed("source", "name")
    rows = sized.join(named, sized["source"].eqNullSafe(named["name"]))
    rows = rows.withColumn("bucket", F.pmod(F.shiftrightunsigned("order", 40), F.lit(_ORDER_BUCKETS)))
    buckets = rows.groupBy("rank", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("rank", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("rank", "bucket").orderBy("order", "doc_id", "size", "key")
    until = within.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(until), F.lit(0)))
    placed = placed.join(buckets, ["rank", "bucket"])
    return placed.select(
        "key", "doc_id", "size", "source_size", "target", "rank", (F.col("base") + F.col("inside")).alias("start")
    )


def mixed_pieces(placed: DataFrame, slots: DataFrame, most: int, block_words: int) -> DataFrame:
    """The mix: per ``slot`` the words ``from`` to ``to`` (exclusive) of documents, at ``offset`` of the slot.

    ``key`` names the row and ``copy`` (from 0) says which repetition of the stream it is.
    """
    copies = placed.filter("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    copies = copies.withColumn("begin", F.col("start") + F.col("copy") * F.col("source_size"))
    # Copies that begin behind the last block of their source are in no slot.
    copies = copies.filter(F.col("begin") < F.col("target") + 1)
    first = F.floor(F.col("begin") / block_words)
    last = F.floor((F.col("begin") + F.col("size") - 1) / block_words)
    cut = copies.withColumn("block", F.explode(F.sequence(first, last)))
    held = cut.select("rank", "block", "key", "doc_id", "copy", "begin", "size").join(slots, ["rank", "block"])
    edge = F.col("block") * block_words - F.col("begin")
    start = F.greatest(edge, F.lit(0))
    end = F.least(edge + F.col("words"), F.col("size"))
    held = held.select("slot", (start - edge).alias("offset"), "key", "doc_id", "copy", start.alias("from"), end.alias("to"))
    return held.filter(F.col("from") < F.col("to"))


def mix(
    docs: DataFrame, stage: Staging, id: str = "doc_id", text: str = "text", source: str = "source",
    most: int = 3, block_words: int = 256, seed: int = 1, order: str | None = None,
) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken`` and ``first_slot`` of every row of ``docs``.

    A source's ``taken`` add up to its target, rounded to a word; ``first_slot`` is where
    in the mix a row comes first, null if it is not taken. Documents are shuffled
    by a hash of the column ``order``, or of the id.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    shuffled = F.xxhash64(F.col(order or id).cast("long"), size, F.lit(seed)).alias("order")
    sized = docs.select(
        F.col(id).cast("long").alias("doc_id"), F.col(source).alias("source"), size.alias("size"), shuffled,
        F.monotonically_increasing_id().alias("key"),
    )
    sized = stage.table("sized", sized)
    targets = stage.table("targets", source_targets(sized, most))
    total = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"]
    slots = -(-total // block_words)
    placed_slots = stage.table("placed_slots", schedule(targets, slots))
    slot_table = settle(placed_slots, targets, slots, block_words)
    placed = stage.table("placed", stream_positions(sized, targets))
    pieces = mixed_pieces(placed, slot_table, most, block_words)
    words = pieces.groupBy("key").agg(
        F.sum(F.col("to") - F.col("from")).alias("taken"), F.min("slot").alias("first_slot")
    )
    out = placed.join(words, "key", "left")
    taken = F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    return out.select("doc_id", "size", "source_size", "target", taken, "first_slot")
