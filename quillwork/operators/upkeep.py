"""Table upkeep on plain files: replace, upsert, patch, cascade, reset.

Parquet has no MERGE, so each operator returns the new table; write it beside
the old one, or overwrite only touched partitions with
`spark.sql.sources.partitionOverwriteMode=dynamic`.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replace_by_key(
    target: DataFrame, fresh: DataFrame, keys: Sequence[str], touched: DataFrame | None = None
) -> DataFrame:
    """Replace all rows of the keys in `touched` (by default those of `fresh`)."""
    gone = (fresh if touched is None else touched).select(*keys).distinct()
    return target.join(gone, list(keys), "left_anti").unionByName(fresh)


def replace_auto_keep_manual(
    target: DataFrame, fresh: DataFrame, key: str, source: str = "source"
) -> DataFrame:
    """Replace the `auto` rows of the keys in `fresh`; rows of other sources stay."""
    gone = fresh.select(key).distinct().withColumn(source, F.lit("auto"))
    return target.join(gone, [key, source], "left_anti").unionByName(fresh)


def one_per_key(df: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """The last row of each key by `order`; without one, the largest row, so the choice is always the same."""
    row = F.struct(*df.columns)
    last = F.max_by(row, F.struct(order, row)) if order else F.max(row)
    return df.groupBy(F.col(key).alias("__key")).agg(last.alias("__row")).select("__row.*")


def upsert_catalog(
    target: DataFrame,
    incoming: DataFrame,
    key: str,
    overwrite: Sequence[str],
    defaults: Mapping[str, Column],
) -> DataFrame:
    """Full-outer upsert.

    A known key takes the `overwrite` columns of the scan and keeps the rest; a
    new key takes the rest from `defaults`; a key gone from the scan is kept. A key
    that the scan repeats counts once.
    """
    new = one_per_key(incoming.select(key, *overwrite), key)
    new = new.select(key, *[F.col(c).alias(f"__n_{c}") for c in overwrite])
    new = new.withColumn("__in", F.lit(True))
    joined = target.withColumn("__old", F.lit(True)).join(new, key, "full_outer")
    scanned, fresh = F.col("__in").isNotNull(), F.col("__old").isNull()
    columns: list[Column] = []
    for c in target.columns:
        if c == key:
            columns.append(F.col(c))
        elif c in overwrite:
            columns.append(F.when(scanned, F.col(f"__n_{c}")).otherwise(F.col(c)).alias(c))
        else:
            default = defaults.get(c, F.lit(None)).cast(target.schema[c].dataType)
            columns.append(F.when(fresh, default).otherwise(F.col(c)).alias(c))
    return joined.select(*columns)


def count_new(target: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    fresh = incoming.select(key).distinct().join(target.select(key), key, "left_anti")
    return fresh.agg(F.count(F.lit(1)).alias("new_count"))


def apply_patch(target: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Partial update: a null patch value keeps the current one. Of a repeated key the largest patch counts."""
    fields = [c for c in patch.columns if c != key]
    renamed = one_per_key(patch, key).select(key, *[F.col(c).alias(f"__p_{c}") for c in fields])
    joined = target.join(renamed, key, "left")
    updates = {c: F.coalesce(f"__p_{c}", c) for c in fields}
    return joined.withColumns(updates).select(*target.columns)


def cascade_delete(
    doomed: DataFrame, tables: Mapping[str, tuple[DataFrame, str]], key: str
) -> dict[str, DataFrame]:
    """Remove the doomed parents and their rows; tables: name -> (table, its key column)."""
    return {
        name: table.join(doomed.select(F.col(key).alias(column)), column, "left_anti")
        for name, (table, column) in tables.items()
    }


def mark_read(df: DataFrame, flag: str = "is_read") -> DataFrame:
    return df.withColumn(flag, F.lit(True))


def append_rows(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Event log with new rows; on files this is `rows.write.mode("append")`."""
    return target.unionByName(rows)


def reset_rows(df: DataFrame, chosen: Column, **values) -> DataFrame:
    """Set columns to constants where `chosen` holds."""
    return df.withColumns(
        {
            c: F.when(chosen, F.lit(v).cast(df.schema[c].dataType)).otherwise(F.col(c))
            for c, v in values.items()
        }
    )


def evolve_schema(df: DataFrame, defaults: Mapping[str, Column]) -> DataFrame:
    """Add each missing column with its constant default; never drop or retype."""
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})
