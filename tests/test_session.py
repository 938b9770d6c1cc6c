from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillwork.session import SHUFFLE_CLEANUP, materialise


@pytest.fixture
def local_dirs(spark):
    disks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return [Path(str(d)) for d in disks.localDirsString()]


def test_shuffles_of_a_written_table_are_removed(spark, local_dirs):
    before = {p for d in local_dirs for p in d.rglob("shuffle_*.data")}
    setting = spark.conf.get(SHUFFLE_CLEANUP, None)
    df = spark.range(20_000).groupBy((F.col("id") % 7_000).alias("k")).agg(F.count("*").alias("n"))
    table = materialise(df)
    assert table.count() == 7_000 and df.count() == 7_000 and materialise(df).agg(F.sum("n")).first()[0] == 20_000
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == setting
    left = {p for d in local_dirs for p in d.rglob("shuffle_*.data")} - before
    sizes = [p.stat().st_size for p in left if p.exists()]
    assert sum(sizes) < 40_000, sizes
