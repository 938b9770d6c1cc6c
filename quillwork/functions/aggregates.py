"""Aggregates that SQL can call, on Arrow batches.

`first_seen_lines(at, text)` gives the lines of a group's texts, distinct up to case, in
the order of `at` and spelled as they came first. All texts of a group meet in one task;
a group too large for that is aggregated in two steps, whose result is the same:

    SELECT k, first_seen_merge(part) FROM (
        SELECT k, first_seen_part(at, text) AS part FROM t GROUP BY k, at DIV 100000) GROUP BY k

The middle of that grows with the distinct lines of a group, not with its texts. A group whose
distinct lines are too many for a Python worker leaves Python after the parts, whose lines go on as rows:

    SELECT k, min(x) FROM (
        SELECT k, explode(first_seen_part(at, text)) AS x FROM t GROUP BY k, at DIV 100) GROUP BY k, lower(x.line)
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillwork.functions.text import _LINE_END, WHITESPACE

_ENDS = re.compile(_LINE_END)
_LIST = T.ArrayType(T.StringType())
_PART = T.ArrayType(
    T.StructType([T.StructField("at", T.LongType()), T.StructField("i", T.LongType()), T.StructField("line", T.StringType())])
)
_PART_KIND = pa.list_(pa.struct([("at", pa.int64()), ("i", pa.int64()), ("line", pa.string())]))

Seen = tuple[int, int, str]  # at, line of that text, spelling


def _lines(at: pa.Array, text: pa.Array) -> Iterator[Seen]:
    for place, body in zip(at.to_pylist(), text.to_pylist(), strict=True):
        if place is None or body is None:
            continue
        stripped = (line.strip(WHITESPACE) for line in _ENDS.split(body))
        for i, line in enumerate(line for line in stripped if line):
            yield place, i, line


def _first(lines: Iterable[Seen]) -> list[Seen]:
    """The first spelling of every line, by place; of equal places the smaller spelling."""
    seen: dict[str, Seen] = {}
    for item in lines:
        key = item[2].lower()
        if key not in seen or item < seen[key]:
            seen[key] = item
    return sorted(seen.values())


@F.arrow_udf(_LIST)
def first_seen_lines(at: pa.Array, text: pa.Array) -> pa.Scalar:
    """Distinct lines in first-seen order; a null place or text adds none, a group without lines has an empty array."""
    return pa.scalar([line for *_, line in _first(_lines(at, text))], pa.list_(pa.string()))


@F.arrow_udf(_PART)
def first_seen_part(at: pa.Array, text: pa.Array) -> pa.Scalar:
    """The same for a part of a group, with the places that `first_seen_merge` needs."""
    rows = [dict(zip(("at", "i", "line"), item, strict=True)) for item in _first(_lines(at, text))]
    return pa.scalar(rows, _PART_KIND)


@F.arrow_udf(_LIST)
def first_seen_merge(part: pa.Array) -> pa.Scalar:
    """Parts of a group -> its distinct lines in first-seen order."""
    items = ((x["at"], x["i"], x["line"]) for rows in part.to_pylist() if rows for x in rows)
    return pa.scalar([line for *_, line in _first(items)], pa.list_(pa.string()))


def register_aggregates(spark: SparkSession) -> None:
    """Make the aggregates above callable from SQL."""
    for function in (first_seen_lines, first_seen_part, first_seen_merge):
        spark.udf.register(function.__name__, function)
