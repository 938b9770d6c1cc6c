"""Scans over rows ordered within a key, safe for keys of any size.

A plain window sends every row of a key to one task, which fails when one key
holds a large share of the table. `Ordered` remembers the size of the largest
key. While that fits a task, scans are ordinary windows. Beyond it, positions
are cut into chunks: the window runs per (key, chunk), each chunk is summarised
to one row, the summaries are scanned per key, and the carried value is joined
back on (key, chunk). Both ways give the same result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.session import GROUP_ROWS, materialise, row_limit

CHUNK = "__chunk"


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the biggest key: one column-pruned, map-side combined job."""
    top = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    return int(top or 0)


@dataclass(frozen=True)
class Scan:
    kind: str  # lag | last | last_before | total
    expr: Column


def lag(expr: Column) -> Scan:
    """Value of the previous row."""
    return Scan("lag", expr)


def last(expr: Column) -> Scan:
    """Latest non-null value up to and including this row."""
    return Scan("last", expr)


def last_before(expr: Column) -> Scan:
    """Latest non-null value strictly before this row."""
    return Scan("last_before", expr)


def total(expr: Column) -> Scan:
    """Running sum up to and including this row."""
    return Scan("total", expr)


def _local(scan: Scan, value: Column, window) -> Column:
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return {
        "lag": lambda: F.lag(value).over(window),
        "last": lambda: F.last(value, ignorenulls=True).over(upto),
        "last_before": lambda: F.last(value, ignorenulls=True).over(before),
        "total": lambda: F.sum(value).over(upto),
    }[scan.kind]()


@dataclass(frozen=True)
class Ordered:
    """A DataFrame whose rows are ordered by `pos` within `keys`."""

    df: DataFrame
    keys: tuple[str, ...]
    pos: str
    largest: int

    @classmethod
    def of(cls, df: DataFrame, keys: Sequence[str], pos: str) -> Ordered:
        """Rows that already carry a position."""
        return cls(df, tuple(keys), pos, largest_group(df, keys))

    def with_df(self, df: DataFrame) -> Ordered:
        """Same keys and positions over a filtered or widened DataFrame."""
        return replace(self, df=df)

    def filter(self, condition: Column) -> Ordered:
        return self.with_df(self.df.filter(condition))

    def columns(self, **exprs: Column) -> Ordered:
        return self.with_df(self.df.withColumns(exprs))

    def window(self, *extra: str):
        return Window.partitionBy(*self.keys, *extra).orderBy(self.pos)

    def scan(self, **scans: Scan) -> Ordered:
        """Add one column per scan."""
        limit = row_limit(self.df.sparkSession, GROUP_ROWS)
        if self.largest <= limit:
            window = self.window()
            return self.columns(**{n: _local(s, s.expr, window) for n, s in scans.items()})
        return self._chunked_scan(limit, scans)

    def chunked(self, rows: int) -> DataFrame:
        """Rows with their chunk, written out: chunks are read twice or more, and
        a chain of scans would otherwise double its plan at every step."""
        chunk = F.floor(F.col(self.pos) / F.lit(rows)).cast("long")
        return materialise(self.df.withColumn(CHUNK, chunk))

    def _chunked_scan(self, rows: int, scans: dict[str, Scan]) -> Ordered:
        values = {f"__v_{n}": s.expr for n, s in scans.items()}
        placed = self.df.withColumns(values)
        placed = self.with_df(placed).chunked(rows)
        pos = F.col(self.pos)

        summary, carry = [], []
        chunks = Window.partitionBy(*self.keys).orderBy(CHUNK)
        earlier = chunks.rowsBetween(Window.unboundedPreceding, -1)
        for name, scan in scans.items():
            value, short = F.col(f"__v_{name}"), f"__s_{name}"
            if scan.kind == "total":
                summary.append(F.sum(value).alias(short))
                carry.append(F.sum(short).over(earlier).alias(f"__c_{name}"))
            elif scan.kind == "lag":
                # a struct keeps a null last value apart from a missing one
                summary.append(F.max_by(F.struct(value.alias("v")), pos).alias(short))
                carry.append(F.lag(short).over(chunks).getField("v").alias(f"__c_{name}"))
            else:
                known = F.when(value.isNotNull(), pos)
                summary.append(F.max_by(value, known).alias(short))
                carry.append(F.last(short, ignorenulls=True).over(earlier).alias(f"__c_{name}"))

        on = [*self.keys, CHUNK]
        carries = placed.groupBy(*on).agg(*summary).select(*on, *carry)
        window = self.window(CHUNK)
        first = F.lag(F.lit(True)).over(window).isNull()
        local = {f"__l_{n}": _local(s, F.col(f"__v_{n}"), window) for n, s in scans.items()}
        joined = placed.withColumns({**local, "__first": first}).join(carries, on, "left")

        out = {}
        for name, scan in scans.items():
            near, far = F.col(f"__l_{name}"), F.col(f"__c_{name}")
            if scan.kind == "lag":
                out[name] = F.when(F.col("__first"), far).otherwise(near)
            elif scan.kind == "total":
                out[name] = F.coalesce(near + far, near, far)
            else:
                out[name] = F.coalesce(near, far)
        kept = [c for c in self.df.columns if c not in out]
        return self.with_df(joined.withColumns(out).select(*kept, *out))


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    pos: str = "pos",
    largest: int | None = None,
) -> Ordered:
    """Give every row its 0-based position within `keys` by a total `order`.

    `largest` is an upper bound of the rows of one key; without it they are
    counted.

    A key too big for one task is numbered by slices: rows are range-partitioned
    on (keys, order), which splits a hot key, and a slice starts after the rows
    of the earlier slices of its key. The slices are written to the shared
    folder first, so that a retried task cannot draw other slice borders.
    """
    spark = df.sparkSession
    biggest = largest_group(df, keys) if largest is None else largest
    if biggest <= row_limit(spark, GROUP_ROWS):
        window = Window.partitionBy(*keys).orderBy(*order)
        numbered = df.withColumn(pos, (F.row_number().over(window) - 1).cast("long"))
        return Ordered(numbered, tuple(keys), pos, biggest)

    by_key = [F.col(k) for k in keys]
    sliced = df.repartitionByRange(*by_key, *order).withColumn("__slice", F.spark_partition_id())
    sliced = materialise(sliced)
    on = [*keys, "__slice"]
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sliced.groupBy(*on).count().select(
        *on, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__start")
    )
    local = F.row_number().over(Window.partitionBy(*on).orderBy(*order)) - 1
    numbered = (
        sliced.withColumn("__local", local)
        .join(starts, on)
        .withColumn(pos, (F.col("__local") + F.col("__start")).cast("long"))
        .select(*df.columns, pos)
    )
    return Ordered(numbered, tuple(keys), pos, biggest)
