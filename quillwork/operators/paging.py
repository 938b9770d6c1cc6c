"""Pages at any offset by an order-statistics index: rows in range slices of known size.

`orderBy().offset()` gathers all rows before the page in one task. The index deals the
rows out by ranges of the order, once, into one folder a slice, and counts them; a page
then reads the slices it overlaps, one or two, and sorts only those.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillwork.session import scratch

PAGE_LIMIT = 200


def checked(limit: int, offset: int) -> None:
    if not 1 <= limit <= PAGE_LIMIT or offset < 0:
        raise ValueError(f"limit must be 1 to {PAGE_LIMIT} and offset 0 or more, not {limit} and {offset}")


def total_order(order: Sequence[Column], key: str | Sequence[str]) -> list[Column]:
    return [*order, *(F.col(k) for k in ([key] if isinstance(key, str) else key))]


@dataclass(frozen=True)
class PageIndex:
    """Rows sliced by ranges of a total order, and how many come before each slice."""

    df: DataFrame
    order: list[Column]
    slices: list[int]  # numbers of the slices that hold rows
    starts: list[int]  # rows before each of them, then all rows

    @classmethod
    def of(cls, df: DataFrame, order: Sequence[Column], key: str | Sequence[str]) -> PageIndex:
        """Write the index of `df`; `key` (one or more columns) breaks the ties of `order`.

        Rows that are equal in all of these may change places between two indexes, not within one.
        """
        whole = total_order(order, key)
        path = scratch(df.sparkSession, "pages")
        sliced = df.repartitionByRange(*whole).withColumn("__slice", F.spark_partition_id())
        sliced.sortWithinPartitions(*whole).write.partitionBy("__slice").parquet(path)
        schema = T.StructType([*df.schema.fields, T.StructField("__slice", T.IntegerType())])
        written = df.sparkSession.read.schema(schema).parquet(path)
        # one row for each slice, that is for each shuffle partition
        counts = sorted((r["__slice"], r["count"]) for r in written.groupBy("__slice").count().collect())
        return cls(written, whole, [s for s, _ in counts], [0, *accumulate(n for _, n in counts)])

    @property
    def total(self) -> int:
        return self.starts[-1]

    def page(self, limit: int = 50, offset: int = 0) -> DataFrame:
        """`limit` rows from `offset` on, in order, with the `total` of all rows."""
        checked(limit, offset)
        first = max(bisect_right(self.starts, offset) - 1, 0)
        end = first
        while end < len(self.slices) and self.starts[end] < offset + limit:
            end += 1
        here = self.df.where(F.col("__slice").isin(self.slices[first:end])).drop("__slice")
        rows = here.orderBy(*self.order).offset(offset - self.starts[min(first, len(self.slices))]).limit(limit)
        return rows.withColumn("total", F.lit(self.total).cast("long"))
