"""Keep-or-drop folds against the last kept row.

Whether a row stays depends on the last row that stayed, so neither `lag` nor a
window aggregate can express it. A key that fits one task is folded in one go.
A larger key is folded chunk by chunk: every chunk is first folded as if nothing
preceded it, then chunks whose true entry (the last row kept by the chunks
before) turns out different are folded again. Two folds mostly agree from the
first row that both of them keep, so `ROUNDS` of that settle nearly all keys. A
slow drift never lets two folds meet; what is not settled then goes by
`pointers`, whose rounds grow with the logarithm of the number of chunks.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillwork.operators.ordered import CHUNK, Ordered
from quillwork.session import FOLD_ROWS, materialise, row_limit

ROUNDS = 3  # rounds of folding again before pointers take over


class Rule:
    """When a value is kept, if `base` is the last kept one; a base of None keeps whatever comes."""

    summary: T.StructType  # of what a stretch of values holds

    def decode(self, column: pa.ChunkedArray) -> Any:
        """The values of a column, with a length and `base_at`."""
        raise NotImplementedError

    def base_of(self, value: Any) -> Any:
        """A value as it comes from a row -> base."""
        raise NotImplementedError

    def first(self, base: Any, values: Any, start: int) -> int:
        """First index from `start` on that is kept, the number of values if there is none."""
        raise NotImplementedError

    def never(self, values: Any) -> np.ndarray:
        """Indices known to have no later value that they would keep; may miss some."""
        return np.zeros(len(values), bool)

    def summarise(self, values: Any) -> dict:
        """A summary, for `drops_all`."""
        raise NotImplementedError

    def joined(self, a: Column, b: Column) -> Column:
        """Summary of two stretches."""
        raise NotImplementedError

    def drops_all(self, value: Column, summary: Column) -> Column:
        """True only if a base of this value keeps nothing of the stretch."""
        raise NotImplementedError

    def fold(self, values: Any, base: Any) -> np.ndarray:
        keep, at = np.zeros(len(values), bool), self.first(base, values, 0)
        while at < len(values):
            keep[at] = True
            at = self.first(values.base_at(at), values, at + 1)
        return keep

    def successors(self, values: Any) -> np.ndarray:
        """For each value as the last kept one: the next that is kept, the number of values if there is none."""
        n = len(values)
        after, never = np.full(n, n), self.never(values)
        for i in range(n - 2, -1, -1):
            if never[i]:
                continue
            # a value that only repeats the next one has its successor, unless it keeps it
            after[i] = self.first(values.base_at(i), values, i + 1)
            if after[i] > i + 1 and values.equal(i, i + 1):
                after[i] = after[i + 1]
        return after


class _Matrix:
    """Vectors as rows of one matrix; missing ones are not `there`."""

    def __init__(self, rows: np.ndarray, there: np.ndarray) -> None:
        self.rows, self.there = rows, there

    def __len__(self) -> int:
        return len(self.there)

    def base_at(self, i: int) -> np.ndarray | None:
        return self.rows[i] if self.there[i] else None

    def equal(self, i: int, j: int) -> bool:
        return bool(self.there[i] and self.there[j] and np.array_equal(self.rows[i], self.rows[j]))


class GapRule(Rule):
    """A vector is kept if its mean absolute difference from the last kept one is above `limit`.

    A missing vector is kept and leaves no base; an unknown difference keeps.
    """

    summary = T.StructType(
        [
            T.StructField("low", T.ArrayType(T.DoubleType())),
            T.StructField("high", T.ArrayType(T.DoubleType())),
            T.StructField("whole", T.BooleanType()),
        ]
    )
    BLOCK = 4096

    def __init__(self, limit: float) -> None:
        self.limit = limit
        self.surely = limit * (1 - 1e-9)  # what a bound must stay under, for its own rounding

    def decode(self, column: pa.ChunkedArray) -> _Matrix:
        lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        there = np.asarray(pc.is_valid(lists))
        flat = np.asarray(pc.list_flatten(lists).cast(pa.float64()).fill_null(float("nan")), dtype=np.float64)
        found = int(there.sum())
        width = flat.size // found if found else 0
        rows = np.zeros((len(lists), width))
        rows[there] = flat.reshape(found, width)
        return _Matrix(rows, there)

    def base_of(self, value: list | None) -> np.ndarray | None:
        return None if value is None else np.asarray(value, np.float64)

    def first(self, base: np.ndarray | None, values: _Matrix, start: int) -> int:
        if base is None or not values.there.any():
            return start
        at, size, n = start, 8, len(values)
        while at < n:
            end = min(at + size, n)
            with np.errstate(invalid="ignore", divide="ignore"):
                gap = np.abs(values.rows[at:end] - base).mean(axis=1) if base.size else np.full(end - at, np.nan)
            hit = ~(gap <= self.limit) | ~values.there[at:end]
            if hit.any():
                return at + int(hit.argmax())
            at, size = end, min(2 * size, self.BLOCK)
        return n

    def never(self, values: _Matrix) -> np.ndarray:
        """By the box around all later vectors."""
        out = np.zeros(len(values), bool)
        if len(values) < 2 or not values.rows.shape[1]:
            return out
        later = values.rows[:0:-1]
        low, high = np.minimum.accumulate(later)[::-1], np.maximum.accumulate(later)[::-1]
        here = values.rows[:-1]
        far = np.maximum(np.abs(here - low), np.abs(here - high)).mean(axis=1)
        whole = np.logical_and.accumulate(values.there[::-1])[::-1]
        out[:-1] = (far <= self.surely) & whole[:-1]
        return out

    def summarise(self, values: _Matrix) -> dict:
        whole = bool(values.there.all() and np.isfinite(values.rows).all())
        return {"low": values.rows.min(axis=0).tolist(), "high": values.rows.max(axis=0).tolist(), "whole": whole}

    def joined(self, a: Column, b: Column) -> Column:
        return F.struct(
            F.zip_with(a["low"], b["low"], lambda x, y: F.least(x, y)).alias("low"),
            F.zip_with(a["high"], b["high"], lambda x, y: F.greatest(x, y)).alias("high"),
            (a["whole"] & b["whole"]).alias("whole"),
        )

    def drops_all(self, value: Column, summary: Column) -> Column:
        def off(edge: str) -> Column:
            return F.zip_with(value, summary[edge], lambda x, y: F.abs(x - y))

        far = F.zip_with(off("low"), off("high"), lambda x, y: F.greatest(x, y))
        mean = F.aggregate(far, F.lit(0.0), lambda acc, x: acc + x) / F.size(value)
        return F.coalesce(summary["whole"] & (mean <= self.surely) & ~F.isnan(mean), F.lit(False))


class _Texts(list):
    def base_at(self, i: int) -> str | None:
        return self[i]

    def equal(self, i: int, j: int) -> bool:
        return self[i] is not None and self[i] == self[j]


class TextRule(Rule):
    """A text is kept unless it is `similar` to the last kept one; two empty ones are, if `collapse_empty`."""

    summary = T.StructType([T.StructField("text", T.StringType()), T.StructField("whole", T.BooleanType())])

    def __init__(self, similar: Callable[[str, str], bool], collapse_empty: bool) -> None:
        self.similar, self.collapse_empty = similar, collapse_empty

    def decode(self, column: pa.ChunkedArray) -> _Texts:
        return _Texts(column.to_pylist())

    def base_of(self, value: str | None) -> str | None:
        return value

    def first(self, base: str | None, values: _Texts, start: int) -> int:
        if base is None:
            return start
        before = base if base or self.collapse_empty else None  # known to be dropped
        for i in range(start, len(values)):
            value = values[i]
            if value == before and value is not None:
                continue
            apart = value is None or (not self.collapse_empty and not value and not base)
            if apart or not self.similar(value, base):
                return i
            before = value
        return len(values)

    def summarise(self, values: _Texts) -> dict:
        one = values[0] is not None and all(v == values[0] for v in values)
        return {"text": values[0], "whole": bool(one and (values[0] or self.collapse_empty))}

    def joined(self, a: Column, b: Column) -> Column:
        return F.struct(a["text"].alias("text"), (a["whole"] & b["whole"] & (a["text"] == b["text"])).alias("whole"))

    def drops_all(self, value: Column, summary: Column) -> Column:
        return F.coalesce(summary["whole"] & (summary["text"] == value), F.lit(False))


def in_order(table: pa.Table, pos: str) -> pa.Table:
    return table.take(np.argsort(table.column(pos).to_numpy(), kind="stable"))


def fold_keep(rows: Ordered, value: str, rule: Rule, flag: str = "kept") -> DataFrame:
    """Add a boolean `flag`: does `rule` keep the row? Positions of a key are distinct."""
    df, pos = rows.df, rows.pos
    out_schema = T.StructType([*df.schema.fields, T.StructField(flag, T.BooleanType())])
    limit = row_limit(df.sparkSession, FOLD_ROWS)

    if rows.largest <= limit:

        def whole(table: pa.Table) -> pa.Table:
            table = in_order(table, pos)
            keep = rule.fold(rule.decode(table.column(value)), None)
            return table.append_column(flag, pa.array(keep, pa.bool_()))

        return df.groupBy(*rows.keys).applyInArrow(whole, out_schema)

    return _fold_chunks(rows, value, rule, flag, limit, out_schema)


def entry_type(df: DataFrame, value: str) -> T.StructType:
    """Position and value of a last kept row; a position of null if it leaves no base."""
    return T.StructType([T.StructField("at", T.LongType()), T.StructField("v", df.schema[value].dataType)])


def _fold_chunks(rows: Ordered, value: str, rule: Rule, flag: str, limit: int, out_schema: T.StructType) -> DataFrame:
    from quillwork.operators.pointers import entries_by_pointers

    df, pos, keys = rows.df, rows.pos, list(rows.keys)
    columns, on = df.columns, [*keys, CHUNK]
    chunks = rows.chunked(limit)
    carried = entry_type(df, value)
    exit_schema = T.StructType([*(chunks.schema[c] for c in on), T.StructField("exit", carried)])

    def entry_of(entries: pa.Table):
        item = entries.column("entry")[0].as_py() if entries.num_rows else None
        return item if item and item["at"] is not None else None

    def base_of(entry: dict | None):
        return rule.base_of(entry["v"]) if entry else None

    def leave(table: pa.Table, entries: pa.Table) -> pa.Table:
        """Entry of the chunk -> the row it hands to the next one."""
        if not table.num_rows:
            return pa.table({f.name: pa.array([], t) for f, t in zip(exit_schema, arrow_types, strict=True)})
        table, entry = in_order(table, pos), entry_of(entries)
        values = rule.decode(table.column(value))
        kept = np.flatnonzero(rule.fold(values, base_of(entry)))
        if not kept.size:
            result = entry or {"at": None, "v": None}
        elif values.base_at(int(kept[-1])) is None:
            result = {"at": None, "v": None}
        else:
            at = int(kept[-1])
            result = {"at": table.column(pos)[at].as_py(), "v": table.column(value)[at].as_py()}
        head = table.slice(0, 1).select(on)
        return head.append_column("exit", pa.array([result], arrow_types[-1]))

    def mark(table: pa.Table, entries: pa.Table) -> pa.Table:
        table = in_order(table, pos)
        keep = rule.fold(rule.decode(table.column(value)), base_of(entry_of(entries)))
        return table.select(columns).append_column(flag, pa.array(keep, pa.bool_()))

    arrow_types = [f.type for f in to_arrow_schema(exit_schema)]

    def cogroup(left: DataFrame, entries: DataFrame, fn, schema) -> DataFrame:
        return left.groupBy(*on).cogroup(entries.groupBy(*on)).applyInArrow(fn, schema)

    ids = materialise(chunks.select(*on).distinct())
    entries = ids.withColumn("entry", F.lit(None).cast(carried))
    exits = materialise(cogroup(chunks, entries, leave, exit_schema))
    by_key = Window.partitionBy(*keys).orderBy(CHUNK)
    for turn in range(ROUNDS + 1):
        fresh = materialise(exits.select(*on, F.lag("exit").over(by_key).alias("entry")))
        old = entries.select(*on, F.col("entry.at").alias("__old"))
        changed = fresh.join(old, on).filter(~F.col("entry.at").eqNullSafe(F.col("__old")))
        changed = materialise(changed.select(*on, "entry"))
        entries = fresh
        if changed.isEmpty():
            break
        if turn == ROUNDS:
            # entries up to the first that changed are final, the later ones follow from it
            start = changed.groupBy(*keys).agg(F.min_by(F.struct(CHUNK, "entry"), CHUNK).alias("__s"))
            start = materialise(start.select(*keys, F.col(f"__s.{CHUNK}").alias("__from"), F.col("__s.entry").alias("entry")))
            later = entries_by_pointers(chunks, keys, pos, value, rule, start)
            entries = materialise(entries.join(later.select(*on), on, "left_anti").unionByName(later))
            break
        again = cogroup(chunks.join(changed.select(*on), on, "left_semi"), changed, leave, exit_schema)
        stay = exits.join(changed.select(*on), on, "left_anti")
        exits = materialise(stay.unionByName(again))
    return cogroup(chunks, entries, mark, out_schema)
