"""Running values over groups of any size, as distributed prefix scans.

A window needs all rows of its partition in one task, and one group may hold a large
share of all rows, even at one instant or without a time. Here rows are dealt out as
ranges of (key, time, order): each task holds a contiguous stretch of the sorted rows,
runs over it once with the running values of its groups, and writes its rows with what
they are within the stretch. Only a group that goes on over the border of a stretch
needs more: what each stretch ends with is one summary row, the summaries are carried
along in one pass over at most two rows per task, and the carried values are added to
the rows of a stretch's first group. So a group of any size spreads, and rows are
exchanged once.

The stretches are written to shared storage, as their borders come from samples and
both passes must see the same ones; a lost executor costs re-reading files.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergelens.sources.staging import Staging

_LONG, _FLAG = T.LongType(), T.BooleanType()


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _changes(batch: pa.RecordBatch, names: Sequence[str], before: pa.RecordBatch | None) -> np.ndarray:
    """Rows that differ from the row above in one of the columns; nulls equal nulls."""
    new = np.zeros(batch.num_rows, bool)
    for name in names:
        column = batch.column(name)
        if before is not None:
            column = pa.concat_arrays([before.column(name), column])
        above, below = column.slice(0, len(column) - 1), column.slice(1)
        differs = pc.fill_null(pc.not_equal(above, below), False).to_numpy(zero_copy_only=False)
        nulls = column.is_null().to_numpy(zero_copy_only=False)
        differs = differs | (nulls[:-1] != nulls[1:])
        new[0 if before is not None else 1 :] |= differs
    if before is None:
        new[0] = True
    return new


def _with_last(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Batches that have rows, and whether each is the last."""
    held = None
    for batch in batches:
        if batch.num_rows:
            if held is not None:
                yield held, False
            held = batch
    if held is not None:
        yield held, True


class _Count:
    """Rows of the group so far."""

    columns = [("_value", _LONG)]
    state_columns: list = []

    def start(self) -> None:
        self.rows = 0

    def run(self, batch: pa.RecordBatch, new: np.ndarray) -> list[pa.Array]:
        at = np.arange(batch.num_rows)
        first = np.maximum.accumulate(np.where(new, at, -1))
        values = at - first + 1
        values[first < 0] = at[first < 0] + 1 + self.rows
        self.rows = int(values[-1])
        return [pa.array(values, pa.int64())]

    def state(self) -> list[int | None]:
        return []


class _Latest:
    """Per kind the last wanted instant before a row, in falling order of time, that is not the row's own.

    The state is the last wanted instant and the last one that differs from it.
    """

    def __init__(self, micros: str, kinds: Sequence[str]):
        self.micros, self.kinds = micros, list(kinds)
        self.columns = [(kind, _LONG) for kind in self.kinds]
        self.state_columns = [(f"_state_{kind}_{i}", _LONG) for kind in self.kinds for i in (1, 2)]

    def start(self) -> None:
        self.held: dict[str, tuple[int | None, int | None]] = {kind: (None, None) for kind in self.kinds}

    def run(self, batch: pa.RecordBatch, new: np.ndarray) -> list[pa.Array]:
        column = batch.column(self.micros)
        timed = column.is_valid().to_numpy(zero_copy_only=False)
        micros = pc.fill_null(column, 0).to_numpy(zero_copy_only=False)
        at = np.arange(len(micros))
        group = np.maximum.accumulate(np.where(new, at, -1))
        other = new.copy()
        other[1:] |= (micros[1:] != micros[:-1]) | (timed[1:] != timed[:-1])
        other[0] = True
        instant = np.maximum.accumulate(np.where(other, at, 0))
        out = []
        for kind in self.kinds:
            wanted = pc.fill_null(batch.column(f"_{kind}"), False).to_numpy(zero_copy_only=False) & timed
            last = np.concatenate(([-1], np.maximum.accumulate(np.where(wanted, at, -1))))
            source = last[instant]
            found = (source >= 0) & (source >= group)
            values = np.where(found, micros[np.maximum(source, 0)], 0)
            first, second = self.held[kind]
            open_ = ~found & (group < 0)
            for kept in (second, first):  # the nearer one wins
                if kept is not None:
                    use = open_ & (micros < kept)
                    values, found = np.where(use, kept, values), found | use
            out.append(pa.array(values, pa.int64(), mask=~(found & timed)))
            # The state of the last group, on top of what was held if it began earlier.
            begun = group[-1]
            own = micros[(at >= begun) & wanted]
            before = (None, None) if begun >= 0 else (first, second)
            self.held[kind] = merged_instants(before, _two_last(own))
        return out

    def state(self) -> list[int | None]:
        return [value for kind in self.kinds for value in self.held[kind]]


Instants = tuple[int | None, int | None]


def _two_last(falling: np.ndarray) -> Instants:
    if not len(falling):
        return None, None
    larger = falling[falling > falling[-1]]
    return int(falling[-1]), int(larger[-1]) if len(larger) else None


def merged_instants(earlier: Instants, later: Instants) -> Instants:
    """The last two different instants of two stretches that follow each other."""
    if later[0] is None:
        return earlier
    if later[1] is not None:
        return later
    return later[0], next((value for value in earlier if value is not None and value != later[0]), None)


def _scanned(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], scan, staging: Staging, partitions: int | None
) -> DataFrame:
    """Written stretches: the rows, their values within the stretch, and the marks ``_part``, ``_open``, ``_begin``, ``_end``."""
    partitions = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType(list(rows.schema.fields))
    for name, kind in [*scan.columns, *scan.state_columns]:
        schema.add(name, kind)
    for name in ("_open", "_begin", "_end"):
        schema.add(name, _FLAG)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, opened = None, True
        scan.start()
        for batch, is_last in _with_last(batches):
            n = batch.num_rows
            new = _changes(batch, keys, before)
            if before is None:
                new[0] = False  # the first group of a stretch may have begun earlier
            values = scan.run(batch, new)
            in_first = ~np.logical_or.accumulate(new) & opened
            opened = bool(in_first[-1])
            begin, end = np.zeros(n, bool), np.zeros(n, bool)
            begin[0], end[-1] = before is None, is_last
            state = [pa.array([None] * (n - 1) + [value], pa.int64()) for value in scan.state()]
            marks = [pa.array(flags) for flags in (in_first, begin, end)]
            before = batch.slice(n - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, *values, *state, *marks], schema.names)

    # Equal rows in keys and order may still be dealt to several tasks. The tie is an expression,
    # not a column, as its bytes would go through the exchange and do not compress. The last
    # key comes first, as it is the one that tells most rows apart, so sorting compares less.
    by = [*reversed(keys), *order, F.xxhash64(*[_quoted(name) for name in rows.columns])]
    dealt = rows.repartitionByRange(partitions, *by).sortWithinPartitions(*by)
    scanned = dealt.mapInArrow(run, schema).withColumn("_part", F.spark_partition_id())
    return staging.table(f"scan-{_next_name()}", scanned)


_names = iter(range(1 << 62))


def _next_name() -> int:
    return next(_names)


def _carried(
    scanned: DataFrame, keys: Sequence[str], values: Sequence[str], merge: Callable[[list, list], list]
) -> list[dict]:
    """Per stretch whose first group began earlier, what that group brings along.

    Reads two rows per stretch.
    """
    picked = scanned.filter("_begin or _end").select("_part", "_begin", "_end", "_open", *keys, *values)
    stretches: dict[int, dict] = {}
    for row in picked.collect():
        stretch = stretches.setdefault(row["_part"], {})
        if row["_begin"]:
            stretch["first"] = tuple(row[key] for key in keys)
        if row["_end"]:
            stretch |= {
                "last": tuple(row[key] for key in keys),
                "whole": row["_open"],
                "state": [row[value] for value in values],
            }
    carried, state, last = [], None, None
    for part in sorted(stretches):
        stretch = stretches[part]
        brings = state if state is not None and stretch["first"] == last else None
        if brings is not None:
            carried.append({"_part": part, **{f"_in_{i}": value for i, value in enumerate(brings)}})
        state, last = stretch["state"], stretch["last"]
        if stretch["whole"] and brings is not None:
            state = merge(brings, state)
    return carried


def _with_carried(scanned: DataFrame, carried: list[dict], size: int) -> DataFrame:
    """Add the carried values, at most one row per stretch, as ``_in_0`` and so on."""
    names = [f"_in_{i}" for i in range(size)]
    if not carried:
        return scanned.withColumns({name: F.lit(None).cast("long") for name in names})
    kind = "array<struct<_part:int," + ",".join(f"{name}:bigint" for name in names) + ">>"
    text = F.from_json(F.lit(json.dumps(carried)), kind)
    table = scanned.sparkSession.range(1).select(F.inline(text))
    return scanned.join(F.broadcast(table), "_part", "left")


def with_next(
    events: DataFrame,
    keys: Sequence[str],
    micros: str,
    wanted: dict[str, Column],
    staging: Staging | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Add per row the time of the next later event of its group, by kind.

    ``wanted`` maps an output column to the condition an event must meet; the
    output is the earliest strictly later ``micros`` of such an event, or null.
    Equal times are not later; an event without a time is never next and has no
    next; null keys are keys like others. Rows run from the newest down.
    """
    flagged = events.withColumns({f"_{name}": condition for name, condition in wanted.items()})
    scan = _Latest(micros, list(wanted))
    staging = staging or Staging(events.sparkSession)
    scanned = _scanned(flagged, keys, [F.col(micros).desc_nulls_last()], scan, staging, partitions)

    def merge(earlier: list, later: list) -> list:
        pairs = zip(zip(earlier[::2], earlier[1::2]), zip(later[::2], later[1::2]))
        return [value for pair in pairs for value in merged_instants(*pair)]

    states = [name for name, _ in scan.state_columns]
    carried = _carried(scanned, keys, states, merge)
    joined = _with_carried(scanned, carried, len(states))
    found = {}
    for i, name in enumerate(wanted):
        nearer, farther = F.col(f"_in_{2 * i}"), F.col(f"_in_{2 * i + 1}")
        brought = F.when(nearer > F.col(micros), nearer).when(farther > F.col(micros), farther)
        found[name] = F.coalesce(F.col(name), F.when(F.col("_open"), brought))
    return joined.select(*[_quoted(name) for name in events.columns], *[value.alias(name) for name, value in found.items()])


def with_position(
    rows: DataFrame,
    keys: Sequence[str],
    micros: str,
    order: Sequence[Column | str],
    name: str = "position",
    staging: Staging | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Add the 1-based position of each row in its group by ``micros``, then ``order``.

    Null keys are keys like others; rows without a time come first.
    """
    staging = staging or Staging(rows.sparkSession)
    scanned = _scanned(rows, keys, [F.col(micros).asc_nulls_first(), *order], _Count(), staging, partitions)
    carried = _carried(scanned, keys, ["_value"], lambda earlier, later: [earlier[0] + later[0]])
    joined = _with_carried(scanned, carried, 1)
    before = F.when(F.col("_open"), F.coalesce("_in_0", F.lit(0))).otherwise(0)
    return joined.select(*[_quoted(name) for name in rows.columns], (F.col("_value") + before).alias(name))
