"""Bounded samples that do not depend on the order of rows or partitions, and names for helper columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RANGE = 1 << 40


def keyed_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The `rows` rows of `df` whose keys have the smallest hashes, all if there are fewer.

    About twice as many are singled out by their hash first, so that what is ordered
    does not grow with the table.
    """
    total = df.count()
    place = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(_RANGE))
    if total > 4 * rows:
        df = df.where(place < int(2 * rows / total * _RANGE))
    return df.orderBy(place, key).limit(rows)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores in front as keep them apart from the columns of `df`."""
    taken = {c.lower() for c in df.columns}
    mark = "_"
    while any(f"{mark}{n}".lower() in taken for n in names):
        mark += "_"
    return [f"{mark}{n}" for n in names]
