"""Session settings the operators rely on, and where they may cut lineage."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings; every one can be set on a live session.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a split hot key is worth one more exchange downstream
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Spark 4.1 may plan a union as dealt out by a key and then run it as a plain one: rows of a key part
    "spark.sql.unionOutputPartitioning": "false",
    # 10,000 large rows would not fit a Python worker
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    # repeated front-matter keys: the later one counts
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # the state of a stream may outgrow memory
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
GROUP_ROWS = "quillwork.groupRows"
FOLD_ROWS = "quillwork.foldRows"
_DEFAULTS = {GROUP_ROWS: 1_000_000, FOLD_ROWS: 50_000}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built."""
    for name, value in RUNTIME_CONF.items():
        spark.conf.set(name, value)
    return spark


def build_session(app: str = "quillwork", master: str | None = None, **extra: str) -> SparkSession:
    """A session for scripts and tests; on a cluster leave `master` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**RUNTIME_CONF, **extra}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def row_limit(spark: SparkSession, name: str) -> int:
    """Most rows of one key that an operator may hand to a single task."""
    return int(spark.conf.get(name, str(_DEFAULTS[name])))


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from `spark.checkpoint.dir`.

    Only a local master may fall back to a temporary folder: on a cluster the
    other machines could not read it, nor could a retry after a lost executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid4().hex}"


def materialise(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write `df` to the shared folder and go on from there; tables of text take less room with zstd.

    Cuts the lineage, fixes what a retried task would see, and spares a plan
    that is read more than once from being computed again.
    """
    spark = df.sparkSession
    path = scratch(spark, "table")
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    # what was shuffled for the table is not read again once it is written
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a table that comes in fewer pieces than there are cores.

    A small table in one file would be worked on by one task. A table with more
    scan partitions than cores is left alone, so nothing large is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df
