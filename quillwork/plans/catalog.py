"""Catalog upkeep: scan, upsert, refresh, notifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.operators.joins import detect_changed
from quillwork.operators.upkeep import count_new, upsert_catalog

# Columns a scan overwrites.
DESCRIPTIVE = ("class_level", "class_label", "subject", "title", "part", "language", "url")


def sync_catalog(
    target: DataFrame,
    scanned: DataFrame,
    checked: Column,
    overwrite: tuple[str, ...] = DESCRIPTIVE,
    key: str = "book_code",
) -> tuple[DataFrame, DataFrame]:
    """(new table, count of new books). New books are `available`, not downloaded."""
    incoming = scanned.withColumn("last_checked", checked)
    defaults = {"status": F.lit("available"), "downloaded": F.lit(False), "version_hash": F.lit("")}
    table = upsert_catalog(target, incoming, key, [*overwrite, "last_checked"], defaults)
    return table, count_new(target, scanned, key)


def refresh_catalog(table: DataFrame, probed: DataFrame) -> DataFrame:
    """Mark downloaded books whose remote signature changed."""
    return detect_changed(table, probed)
