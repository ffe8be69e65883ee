"""Document fingerprints as invertible Bloom lookup sketches, with built-in functions only.

A text's paragraphs (lines, cut after a full stop, question or exclamation mark
followed by a space) are 64-bit digests. A cell holds the number, the exclusive or
and the exclusive or of the hashes of the digests that fall into it; each falls into
one cell of each of three rows. Cells of two texts subtract: what both have cancels.
A cell that is left with one digest (count 1 or -1, matching hash) gives it away;
taking it out of its other cells opens more, until nothing is left or it is stuck.

The fingerprint is the smallest sketch, as text. If the difference of two does not
peel off whole, larger sketches are made: digests are dealt to groups of about eight,
each with a sketch of its own, and a group that is stuck is retried with sketches
four times as wide, at last compared digest by digest. So the cost grows with the
text, not with its square.

A null text is empty and has no paragraph. Repeated paragraphs count once. Two texts
without paragraphs are alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergelens.sources.staging import Staging

_PARAGRAPH = r"\\n|(?<=[.!?]) "
_BASE = 4  # cells in a row of the fingerprint
_WIDER = (4, 16, 64)
_GROUP, _SPLIT = 8, 16
_ROUNDS = 7
_PLACES = (0, 9, 23)  # bits of a digest that place it in a row


def digests(text: str) -> Column:
    """The distinct paragraph digests of a text column."""
    return F.expr(
        f"array_sort(array_distinct(transform(filter(split({text}, '{_PARAGRAPH}'), p -> p <> ''), p -> xxhash64(p))))"
    )


def _in_row(signed: str, row: int, width: int, cell: str) -> str:
    """The members of an array of (x, s) that fall into a cell of a row."""
    return f"filter({signed}, e -> (shiftrightunsigned(e.x, {_PLACES[row]}) & {width - 1}L) = {cell})"


def _row(signed: str, row: int, width: int) -> str:
    """A row of cells over an array of (x, s), s being 1 or -1 for the side a digest is on."""
    zero = "struct(0L as n, 0L as k, 0L as h)"
    add = "(a, e) -> struct(a.n + e.s as n, a.k ^ e.x as k, a.h ^ xxhash64(e.x) as h)"
    return f"transform(sequence(0L, {width - 1}L), c -> aggregate({_in_row(signed, row, width, 'c')}, {zero}, {add}))"


def _cells(signed: str, width: int) -> str:
    """A sketch over an array of (x, s): its three rows of cells."""
    return "struct(" + ", ".join(f"{_row(signed, row, width)} as c{row}" for row in range(3)) + ")"


def sketch(digest_array: str) -> Column:
    """The smallest sketch of a digest array, of which fingerprints and differences are made."""
    signed = f"transform({digest_array}, d -> struct(d as x, 1L as s))"
    return F.expr(f"element_at(transform(array({signed}), v -> {_cells('v', _BASE)}), 1)")


def _subtracted(left: str, right: str) -> str:
    """Cells of the difference of two sketches of one width."""
    less = "(p, q) -> struct(p.n - q.n as n, p.k ^ q.k as k, p.h ^ q.h as h)"
    return "struct(" + ", ".join(f"zip_with({left}.c{row}, {right}.c{row}, {less}) as c{row}" for row in range(3)) + ")"


def _peeled(start: str, width: int) -> str:
    """The digests (x, s) recovered from the cells of a sketch, or null if some are left."""
    cells = "concat(t.c0, t.c1, t.c2)"
    pure = f"array_distinct(transform(filter({cells}, q -> abs(q.n) = 1 and xxhash64(q.k) = q.h), q -> struct(q.k as x, q.n as s)))"
    take = "(a, e) -> struct(a.n - e.s as n, a.k ^ e.x as k, a.h ^ xxhash64(e.x) as h)"
    rest = ", ".join(
        f"transform(t.c{row}, (q, i) -> aggregate({_in_row('u', row, width, 'i')}, q, {take})) as c{row}" for row in range(3)
    )
    # A round that finds nothing is the last; those after it cost nothing.
    stuck = "struct(t.c0 as c0, t.c1 as c1, t.c2 as c2, t.r as r, false as more)"
    step = f"if(size(u) = 0, {stuck}, struct({rest}, concat(t.r, u) as r, true as more))"
    none = "cast(array() as array<struct<x:bigint,s:bigint>>)"
    state = f"element_at(transform(array({start}), c -> struct(c.c0 as c0, c.c1 as c1, c.c2 as c2, {none} as r, true as more)), 1)"
    round_ = f"element_at(transform(array({pure}), u -> {step}), 1)"
    run = f"aggregate(sequence(1, {_ROUNDS}), {state}, (t, z) -> if(t.more, {round_}, t))"
    empty = "forall(concat(o.c0, o.c1, o.c2), q -> q.n = 0 and q.k = 0 and q.h = 0)"
    return f"element_at(transform(array({run}), o -> if({empty}, o.r, null)), 1)"


def difference(left: str, right: str, sketches: tuple[str, str] | None = None) -> Column:
    """Digests in only one of two digest arrays, as (x, s): s is 1 for ``left``, -1 for ``right``.

    Their sketches, columns of ``sketch`` or made here, are tried first; the arrays are dealt
    to wider ones only if that is stuck.
    """
    signed = f"concat(transform({left}, d -> struct(d as x, 1L as s)), transform({right}, d -> struct(d as x, -1L as s)))"
    exact = "filter({g}, e -> size(filter({g}, f -> f.x = e.x)) = 1)"
    tries = ", ".join([*[_peeled(_cells("g", width), width) for width in _WIDER], exact.format(g="g")])
    parts = f"greatest(1, cast(ceil(size(b) / {_GROUP}.0) as int))"
    # Two steps of dealing, so that the work for a long text stays near its length.
    small = f"transform(sequence(0, {parts} - 1), w -> filter(b, e -> pmod(shiftrightunsigned(e.x, 40), {parts}) = w))"
    outer = f"greatest(1, cast(ceil(size(v) / {_GROUP * _SPLIT}.0) as int))"
    large = f"transform(sequence(0, {outer} - 1), w -> filter(v, e -> pmod(e.x, {outer}) = w))"
    grouped = f"flatten(transform(flatten(transform({large}, b -> {small})), g -> coalesce({tries})))"
    start = _subtracted(*sketches) if sketches else _cells("v", _BASE)
    return F.expr(f"element_at(transform(array({signed}), v -> coalesce({_peeled(start, _BASE)}, {grouped})), 1)")


def fingerprint(sketch_column: str) -> Column:
    """The smallest sketch as text: count, digests and hashes of each cell in hexadecimal."""
    part = "concat(lpad(hex(q.n), 4, '0'), lpad(hex(q.k), 16, '0'), lpad(right(hex(q.h), 8), 8, '0'))"
    cells = f"concat({sketch_column}.c0, {sketch_column}.c1, {sketch_column}.c2)"
    return F.expr(f"lower(array_join(transform({cells}, q -> {part}), ''))")


def likeness(left: str, right: str, differing: str) -> Column:
    """Jaccard similarity of two digest arrays from the number of digests in only one."""
    union = (F.size(left) + F.size(right) + F.col(differing)) / 2
    return F.when(union > 0, 1 - F.col(differing) / union).otherwise(F.lit(1.0))


def _successors(keys: DataFrame, stage: Staging) -> DataFrame:
    """For each (k, h) the next one by descending k, then h; after the last comes the first.

    Rows are range-partitioned; the last of a partition is followed by the head of the next.
    """
    ranged = keys.repartitionByRange(F.desc("k"), F.asc("h")).withColumn("part", F.spark_partition_id())
    ranged = stage.table("order", ranged)
    inside = Window.partitionBy("part").orderBy(F.desc("k"), "h")
    pair = F.struct("k", "h")
    placed = ranged.withColumns({"at": F.row_number().over(inside), "next": F.lead(pair).over(inside)})
    placed = stage.table("placed", placed)
    heads = placed.filter("at = 1").select("part", pair.alias("head"))
    around = Window.orderBy("part")
    first = F.first("head").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("part", F.coalesce(F.lead("head").over(around), first).alias("head"))
    joined = placed.join(heads, "part").withColumn("next", F.coalesce("next", "head"))
    return joined.select("k", "h", "n", F.col("next.k").alias("next_k"), F.col("next.h").alias("next_h"))


def fingerprint_edits(docs: DataFrame, stage: Staging, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and its likeness to that and to the next document.

    The edited text has the second half of the code points replaced by as many from
    the start of the next document by descending id (or all it has). Rows with equal
    id and text are one document in that order, and each gets its result; equal ids
    are ordered by a hash of the text, null ids come last. An empty table gives no
    rows. Other columns are not read.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lowest = F.lit(-(2**63)).cast("long")
    rows = docs.select(F.coalesce(F.col(id).cast("long"), lowest).alias("k"), body.alias("text"))
    rows = rows.select("k", F.xxhash64("text").alias("h"), "text")
    keys = rows.select("k", "h", F.length("text").alias("n")).distinct()
    order = stage.table("successors", _successors(keys, stage))
    # Both joins read the texts by (k, h), so one exchange of the texts serves both.
    half = F.floor(F.col("n") / 2).cast("int")
    # (They must be the same columns by the same expressions, so the order is renamed.)
    wanted = order.select(
        F.col("next_k").alias("k"), F.col("next_h").alias("h"), F.col("k").alias("own_k"), F.col("h").alias("own_h"), "n"
    )
    following = wanted.join(rows, ["k", "h"]).select(
        F.col("own_k").alias("k"), F.col("own_h").alias("h"),
        F.substring("text", F.lit(1), half).alias("insert"), digests("text").alias("c"),
    )
    both = rows.join(following.dropDuplicates(["k", "h"]), ["k", "h"])
    length = F.length("text")
    kept = length - F.floor(length / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), kept), F.col("insert")).alias("edited")
    doc_id = F.nullif(F.col("k"), lowest).alias("doc_id")
    both = both.select(doc_id, length.cast("long").alias("n_chars"), "text", edited, "c")
    both = both.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digests("text").alias("a"), digests("edited").alias("b"), "c",
    )
    both = both.withColumns({f"sketch_{name}": sketch(name) for name in "abc"})
    both = both.select(
        "*", fingerprint("sketch_a").alias("fingerprint"), fingerprint("sketch_b").alias("edited_fingerprint"),
        difference("a", "b", ("sketch_a", "sketch_b")).alias("edit"),
        difference("a", "c", ("sketch_a", "sketch_c")).alias("gap"),
    )
    both = both.withColumns({"edit_size": F.size("edit"), "gap_size": F.size("gap")})
    return both.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("a", "b", "edit_size").alias("near_edited"), likeness("a", "c", "gap_size").alias("near_next"),
    )
