"""Shards of nearly equal bytes by best-fit-decreasing packing; equal texts stay together.

Groups of equal texts, largest first, go each to the bin with the least room that
still holds them. Groups of one size are alike, so what is packed is the histogram of
group sizes: the tightest bin takes as many of a size as it holds, and is then still
the tightest for the next. That gives the very bins of packing group by group, but the
work follows the number of different sizes, k. k different sizes add up to
k (k + 1) / 2 bytes at least, so the histogram has no more rows than the square root of
twice the bytes of the corpus; it alone reaches the driver. Bins wait in a balanced
tree by their room.

The plan of the packing says how many groups of a size go to which bin, in the order of
the groups' hashes; groups find their bin by their number within their size, which is
given out in slices, so that neither a common size nor a large shard is one task's work.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.operators.ordered import number_rows
from quillwork.session import materialise

LEAF = 512  # most entries of a leaf before it is split
SLICED = 1 << 62  # as the size of a key: always number by slices


class RoomTree:
    """(room, bin) pairs in order, in leaves of bounded size under one index of their last entries."""

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int]]] = []
        self.last: list[tuple[int, int]] = []

    def add(self, entry: tuple[int, int]) -> None:
        if not self.leaves:
            self.leaves, self.last = [[entry]], [entry]
            return
        at = min(bisect_left(self.last, entry), len(self.leaves) - 1)
        leaf = self.leaves[at]
        insort(leaf, entry)
        if len(leaf) > LEAF:
            half = len(leaf) // 2
            self.leaves[at : at + 1] = [leaf[:half], leaf[half:]]
            self.last[at : at + 1] = [leaf[half - 1], leaf[-1]]
        else:
            self.last[at] = leaf[-1]

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Take out the entry of least room, `size` at least; of equal ones that of the smallest bin."""
        at = bisect_left(self.last, (size, -1))
        if at == len(self.leaves):
            return None
        leaf = self.leaves[at]
        entry = leaf.pop(bisect_left(leaf, (size, -1)))
        if leaf:
            self.last[at] = leaf[-1]
        else:
            del self.leaves[at], self.last[at]
        return entry


Run = tuple[int, int, int]  # size, bin, how many groups of that size


def best_fit(sizes: Iterable[tuple[int, int]], capacity: int, most: int | None = None, first: int = 0) -> list[Run] | None:
    """Runs of best-fit-decreasing packing of (size, count) pairs, largest size first.

    Bins are numbered from `first` as they are opened. A size above the capacity has bins of its own. None if
    more than `most` bins would be needed.
    """
    tree, runs, opened = RoomTree(), [], 0
    for size, count in sizes:
        while count:
            found = tree.take_tightest(size)
            if found is None:
                if opened == most:
                    return None
                found = (max(capacity, size), first + opened)
                opened += 1
            room, bin_ = found
            here = min(count, room // size)
            runs.append((size, bin_, here))
            count -= here
            if room > here * size:
                tree.add((room - here * size, bin_))
    return runs


def even_fit(sizes: list[tuple[int, int]], bins: int) -> list[Run]:
    """Best-fit-decreasing packing into `bins` bins of the least capacity for which it needs no more.

    While the largest group is larger than an equal share of what is left, it has a bin
    of its own, and the share is that of the rest.
    """
    sizes = sorted(sizes, reverse=True)
    left, alone, runs = sum(s * c for s, c in sizes), 0, []
    while sizes and bins - alone > 1 and sizes[0][0] * (bins - alone) > left:
        size, count = sizes[0]
        runs.append((size, alone, 1))
        alone, left = alone + 1, left - size
        sizes = ([(size, count - 1)] if count > 1 else []) + sizes[1:]
    if not sizes:
        return runs
    room, free = max(sizes[0][0], -(-left // (bins - alone))), bins - alone
    below, step = room - 1, 1
    while (plan := best_fit(sizes, room, free, alone)) is None:
        below, room, step = room, room + step, 2 * step
    while room - below > 1:
        middle = (room + below) // 2
        tried = best_fit(sizes, middle, free, alone)
        if tried is None:
            below = middle
        else:
            room, plan = middle, tried
    return runs + plan


def _sized(df: DataFrame, key: str, text: str) -> DataFrame:
    """Key, size, checksum and group of every row, written once, with a number that tells rows apart."""
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    sized = df.select(
        F.col(f"`{key}`").alias("k"),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body).alias("crc"),
        F.xxhash64(body).alias("h"),
    )
    return materialise(sized.withColumn("row", F.monotonically_increasing_id()))


def _placed(sized: DataFrame, pack) -> DataFrame:
    """`sized` with the shard of its group; `pack` makes runs of the histogram of group sizes."""
    spark = sized.sparkSession
    groups = materialise(sized.groupBy("h", "crc", "size").agg((F.count("*") * F.col("size")).alias("total")))
    sizes = groups.groupBy("total").count()
    runs = pack([(r["total"], r["count"]) for r in sizes.toArrow().to_pylist()])
    plan, at = [], {}
    for size, bin_, count in runs:
        first = at.get(size, 0)
        plan.append((size, first, first + count, bin_))
        at[size] = first + count
    kinds = (("total", pa.int64()), ("first", pa.int64()), ("end", pa.int64()), ("shard", pa.int32()))
    columns = {name: pa.array([row[i] for row in plan], kind) for i, (name, kind) in enumerate(kinds)}
    runs = spark.createDataFrame(pa.table(columns))
    numbered = number_rows(groups, ["total"], [F.col("h"), F.col("crc"), F.col("size")], "number", SLICED).df
    within = (F.col("number") >= F.col("first")) & (F.col("number") < F.col("end"))
    placed = numbered.join(runs, "total").where(within).select("h", "crc", "size", "shard")
    # written, as dealing out by ranges reads its rows twice
    return materialise(sized.join(placed, ["h", "crc", "size"]))


def _slots(placed: DataFrame, key: str) -> DataFrame:
    order = [F.col(c) for c in ("k", "size", "crc", "h", "row")]
    numbered = number_rows(placed, ["shard"], order, "slot", SLICED).df
    return numbered.select(F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def even_shards(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, size, text_crc32, shard (0 to `shards` - 1) and slot of every row; shards have nearly equal bytes.

    A row's size is its text's UTF-8 bytes plus 1. Rows of equal texts, null and empty
    ones alike, form a group and share a shard; a group larger than an equal share has a
    shard of its own. Slots count from 0 within a shard by key, size and checksum, nulls
    first; repeated rows have slots of their own in either order. Other columns are left
    out; no rows give none; shards may stay empty when there are fewer groups.
    """
    sized = _sized(df, key, text)
    return _slots(_placed(sized, lambda sizes: even_fit(sizes, shards)), key)


def capacity_shards(df: DataFrame, capacity: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """As `even_shards`, with as few shards of at most `capacity` bytes as best-fit decreasing finds.

    A group larger than the capacity has a shard of its own.
    """
    sized = _sized(df, key, text)
    return _slots(_placed(sized, lambda sizes: best_fit(sorted(sizes, reverse=True), capacity)), key)
