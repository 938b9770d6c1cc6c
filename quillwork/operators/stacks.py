"""Which headings are open above each heading: all nearest smaller values, by monotone stacks that can be merged.

Read in order, a heading closes the open headings of its level or more and is then open
itself, so the open headings always have rising levels. What a stretch of headings does
to those open before it depends on its own open headings alone: it closes all that reach
its smallest level and leaves its own. Such stacks merge, so a key too large for one task
is cut into chunks, each summarised by the stack it leaves; the stacks are merged chunk by
chunk along the key, and every chunk is read again with the headings open before it.
A stack is no longer than the number of levels, however long the stretch.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillwork.operators.ordered import CHUNK, Ordered
from quillwork.session import GROUP_ROWS, materialise, row_limit

Stack = tuple[list[int], list[int]]  # rising levels, their headings


def push(stack: Stack, level: int, heading: int) -> None:
    """Close what reaches `level`, then open `heading`."""
    levels, headings = stack
    cut = bisect_left(levels, level)
    del levels[cut:], headings[cut:]
    levels.append(level)
    headings.append(heading)


def merge(before: Stack, after: Stack) -> Stack:
    """What is open after a stretch that leaves `after`, if `before` was open when it began."""
    if not after[0]:
        return before
    cut = bisect_left(before[0], after[0][0])
    return before[0][:cut] + after[0], before[1][:cut] + after[1]


def _in_order(table: pa.Table, pos: str) -> pa.Table:
    return table.take(np.argsort(table.column(pos).to_numpy(), kind="stable"))


def _walk(table: pa.Table, stack: Stack) -> list[list[int]]:
    """Headings open above each row; `stack` is left as it is after the last."""
    above = []
    for level, heading in zip(table.column("__level").to_pylist(), table.column("__id").to_pylist(), strict=True):
        above.append(stack[1][: bisect_left(stack[0], level)])
        push(stack, level, heading)
    return above


def _stack_of(table: pa.Table) -> Stack:
    """The stack in the first row, an empty one without a row."""
    if not table.num_rows:
        return [], []
    return tuple(table.column(part)[0].as_py() or [] for part in ("levels", "headings"))


def open_headings(headings: Ordered) -> DataFrame:
    """Keys, position, `__id` and `__above` (headings above it, outermost first) of rows with `__id` and `__level`.

    No headings give no rows. Equal positions of a key are read in either order.
    """
    df, keys, pos = headings.df, list(headings.keys), headings.pos
    out = T.StructType([*(df.schema[c] for c in [*keys, pos]), T.StructField("__id", T.LongType()),
                        T.StructField("__above", T.ArrayType(T.LongType()))])
    lists = pa.list_(pa.int64())

    def opened(table: pa.Table, stack: Stack) -> pa.Table:
        table = _in_order(table, pos)
        above = pa.array(_walk(table, stack), lists)
        return table.select([*keys, pos, "__id"]).append_column("__above", above)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys one after the other, many small ones in a batch."""
        now, stack = None, ([], [])
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("__level", "__id"))
            above = []
            for key, level, heading in zip(zip(*(batch.column(c).to_pylist() for c in keys), strict=True), *columns, strict=True):
                if key != now:
                    now, stack = key, ([], [])
                above.append(stack[1][: bisect_left(stack[0], level)])
                push(stack, level, heading)
            kept = [batch.column(c) for c in [*keys, pos, "__id"]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(above, lists)], names=[*keys, pos, "__id", "__above"])

    limit = row_limit(df.sparkSession, GROUP_ROWS)
    if headings.largest <= limit:
        return df.repartition(*keys).sortWithinPartitions(*keys, pos).mapInArrow(stream, out)

    chunks, on = headings.chunked(limit), [*keys, CHUNK]
    stacks = T.StructType([*(chunks.schema[c] for c in on), T.StructField("levels", T.ArrayType(T.LongType())),
                           T.StructField("headings", T.ArrayType(T.LongType()))])
    names = to_arrow_schema(stacks).names

    def leave(table: pa.Table) -> pa.Table:
        table, stack = _in_order(table, pos), ([], [])
        _walk(table, stack)
        head = table.slice(0, 1).select(on)
        return pa.table([*head.columns, *(pa.array([part], lists) for part in stack)], names=names)

    def enter(table: pa.Table) -> pa.Table:
        """Stacks that the chunks of one key leave -> those they begin with."""
        table, stack, entries = _in_order(table, CHUNK), ([], []), []
        for levels, own in zip(table.column("levels").to_pylist(), table.column("headings").to_pylist(), strict=True):
            entries.append(stack)
            stack = merge(stack, (levels, own))
        parts = (pa.array([entry[i] for entry in entries], lists) for i in range(2))
        return pa.table([*table.select(on).columns, *parts], names=names)

    left = chunks.groupBy(*on).applyInArrow(leave, stacks)
    entries = materialise(left.groupBy(*keys).applyInArrow(enter, stacks))

    def read(rows: pa.Table, entry: pa.Table) -> pa.Table:
        return opened(rows, _stack_of(entry))

    return chunks.groupBy(*on).cogroup(entries.groupBy(*on)).applyInArrow(read, out)
