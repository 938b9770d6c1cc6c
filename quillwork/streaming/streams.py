"""Structured Streaming twins of the batch operators.

Sources are folders of parquet slices. A query keeps its state and its results in
the folder `home` that the caller names: called again with the same one, also by
another driver, it goes on where it stopped. Without `home` each call is a run of
its own in a fresh part of the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillwork.operators.upkeep import upsert_catalog
from quillwork.session import materialise, scratch
from quillwork.sources.readers import corpus_columns


def stream_table(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """New parquet files under the folder `path`, each once; a single file also works."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(hadoop)
    if status.isFile():
        folder, _, name = path.rpartition("/")
        return reader.option("pathGlobFilter", name).parquet(folder or ".")
    return reader.parquet(path)


def stream_corpus(spark: SparkSession, path: str, types: Sequence[str]) -> DataFrame:
    """New binary files under `path`, each once, with their corpus columns."""
    schema = spark.read.format("binaryFile").load(path).schema
    reader = spark.readStream.format("binaryFile").schema(schema)
    return corpus_columns(reader.option("recursiveFileLookup", True).load(path), types)


def drain(
    stream: DataFrame, mode: str = "append", home: str | None = None, rest: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Run over all new input, through a file sink, and read all results so far.

    With `rest`, the results end with the input: what the state still holds back for
    rows that might come is read from the state, not taken out of it, and `rest` makes
    results of it. A later run over new input goes on from the state as it is.
    """
    spark = stream.sparkSession
    home = home or scratch(spark, "stream")
    out, state = f"{home}/sink", f"{home}/state"
    writer = stream.writeStream.format("parquet").outputMode(mode)
    query = writer.option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    done = spark.read.schema(stream.schema).parquet(out)
    if rest is None or not _finished(spark, f"{state}/commits/*"):
        return done
    return done.unionByName(rest(spark.read.format("statestore").option("path", state)).select(*stream.columns))


def _finished(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match `pattern`, on any file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return [f.getPath().toString() for f in found]


def drain_batches(
    stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "update", home: str | None = None
) -> None:
    """Run over all new input, handing each micro-batch to `each`; a batch may come twice, under one number."""
    state = f"{home or scratch(stream.sparkSession, 'stream')}/state"
    writer = stream.writeStream.foreachBatch(each).outputMode(mode)
    writer.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


# ---- keep on change ---------------------------------------------------------


class _Changes(StatefulProcessor):
    """Rows of a key wait in a list until a timer says that the watermark has passed the first of them."""

    def __init__(self, key: str, tie: T.DataType, value: T.DataType) -> None:
        self.key = key
        self.row = T.StructType([T.StructField("at", T.LongType()), T.StructField("tie", tie), T.StructField("value", value)])
        self.last = T.StructType([T.StructField("known", T.BooleanType()), T.StructField("value", value)])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.row)
        self.kept = handle.getValueState("kept", self.last)
        self.timer = handle.getValueState("timer", T.StructType([T.StructField("at", T.LongType())]))

    def _wake(self, at: int) -> None:
        """A timer behind the row at `at`, unless an earlier one is set."""
        due = at // 1000 + 1
        before = self.timer.get()
        if before is not None and before[0] <= due:
            return
        if before is not None:
            self.handle.deleteTimer(before[0])
        self.handle.registerTimer(due)
        self.timer.update((due,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        fresh = [(r["at"], r["tie"], r["value"]) for r in rows if r["at"] is not None and r["at"] >= mark]
        if fresh:
            self.held.appendList(fresh)
            self._wake(min(r[0] for r in fresh))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((tuple(r) for r in self.held.get()), key=lambda r: (r[0], r[1] is not None, r[1]))
        ready = [r for r in rows if r[0] < mark]
        rest = rows[len(ready) :]
        kept = self.kept.get() if self.kept.exists() else (False, None)
        known, value = kept
        out = []
        for at, tie, new in ready:
            if not known or new != value:
                known, value = True, new
                out.append(Row(**{"key": key[0], "at": at, "tie": tie, "value": new}))
        if ready:
            self.kept.update((known, value))
        self.held.clear()
        self.timer.clear()
        if rest:
            self.held.put(rest)
            self._wake(rest[0][0])
        return iter(out)

    def close(self) -> None:
        pass


def stream_keep_on_change(
    stream: DataFrame, key: str, ts: str, tie: str, value: str, delay: str = "1 hour"
) -> DataFrame:
    """Rows whose value differs from the last *emitted* one of their key.

    Input may be out of order within `delay`: rows wait in a list state until a timer
    tells that the watermark has passed them and are then judged in (ts, tie) order;
    rows later than the watermark, or without a time, are dropped. Emits (key, ts, tie,
    value). `rest_of_changes` completes the results where the input ends.

    Every decision hangs on the one before, so a key is judged in one place. Its state
    is a window of `delay`, not its history, to which a batch only appends.
    """
    kinds = [stream.schema[c].dataType for c in (key, tie, value)]
    rows = stream.withWatermark(ts, delay).select(
        F.col(key).alias("key"), ts, F.unix_micros(ts).alias("at"), F.col(tie).alias("tie"), F.col(value).alias("value")
    )
    out = T.StructType([T.StructField("key", kinds[0]), T.StructField("at", T.LongType()),
                        T.StructField("tie", kinds[1]), T.StructField("value", kinds[2])])
    judge = _Changes(key, kinds[1], kinds[2])
    changed = rows.groupBy("key").transformWithState(judge, out, "append", "EventTime")
    return changed.select(
        F.col("key").alias(key), F.timestamp_micros("at").alias(ts), F.col("tie").alias(tie), F.col("value").alias(value)
    )


def rest_of_changes(key: str, ts: str, tie: str, value: str) -> Callable:
    """For `drain`: the changes among the rows that `stream_keep_on_change` still holds."""

    def rest(state) -> DataFrame:
        held = state.option("stateVarName", "held").option("flattenCollectionTypes", "true").load()
        held = held.select("key.key", "list_element.*", F.lit(True).alias("held"))
        kept = state.option("stateVarName", "kept").load().where("value.known")
        kept = kept.select("key.key", F.lit(None).cast("long").alias("at"), F.lit(None).cast(held.schema["tie"].dataType).alias("tie"),
                           "value.value", F.lit(False).alias("held"))
        # a row equal to the one before it is never emitted, so the last emitted value is that of the row before
        order = Window.partitionBy("key").orderBy(F.asc_nulls_first("at"), F.asc_nulls_first("tie"))
        rows = held.unionByName(kept).withColumn("before", F.lag(F.struct("value")).over(order))
        changed = F.col("before").isNull() | ~F.col("value").eqNullSafe(F.col("before.value"))
        return rows.where(F.col("held") & changed).select(
            F.col("key").alias(key), F.timestamp_micros("at").alias(ts), F.col("tie").alias(tie), F.col("value").alias(value)
        )

    return rest


# ---- stateless and windowed -------------------------------------------------


def stream_first_seen(stream: DataFrame, ts: str, keys: Sequence[str], delay: str = "1 hour") -> DataFrame:
    """First arrival per key within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def stream_status_counts(
    stream: DataFrame, ts: str, status: str, length: str, slide: str | None = None, delay: str = "1 hour"
) -> DataFrame:
    """Rows per status and event-time window; a window comes once it is complete."""
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    counted = stream.withWatermark(ts, delay).groupBy(window.alias("w"), status)
    return counted.agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), status, "n"
    )


def rest_of_counts(status: str) -> Callable:
    """For `drain`: counts of the windows that `stream_status_counts` has not completed."""

    def rest(state) -> DataFrame:
        rows = state.load().select("key.*", "value.*")
        window, _, count = rows.columns
        return rows.select(
            F.col(f"{window}.start").alias("window_start"), F.col(f"{window}.end").alias("window_end"),
            F.col(status), F.col(count).alias("n"),
        )

    return rest


def stream_session_counts(
    stream: DataFrame, ts: str, key: str, gap: str, delay: str = "1 hour"
) -> DataFrame:
    """Rows per key and session of activity, once the session is closed."""
    session = F.session_window(ts, gap).alias("w")
    counted = stream.withWatermark(ts, delay).groupBy(session, key)
    return counted.agg(F.count(F.lit(1)).alias("n")).select(
        key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n"
    )


def rest_of_sessions(key: str) -> Callable:
    """For `drain`: the sessions that `stream_session_counts` holds open."""

    def rest(state) -> DataFrame:
        rows = state.load().select("value.*")
        window, count = rows.columns[0], rows.columns[-1]
        return rows.select(
            F.col(key), F.col(f"{window}.start").alias("session_start"), F.col(f"{window}.end").alias("session_end"),
            F.col(count).alias("n"),
        )

    return rest


# ---- upserts ----------------------------------------------------------------


class BucketTable:
    """A table of versions in the folder `root`: rows in buckets by their key, a manifest for each version.

    A manifest says in which version each bucket was written last. A new version writes
    only the buckets it touches and a manifest, so its bytes follow the change and not the
    table. The last two versions can be read; buckets that neither has are removed.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str, buckets: int = 64) -> None:
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root, schema, key, buckets

    def versions(self) -> list[int]:
        """Numbers of the finished versions."""
        found = _finished(self.spark, f"{self.root}/manifest/v=*/_SUCCESS")
        return sorted(int(f.split("/v=")[-1].split("/")[0]) for f in found)

    def manifest(self, version: int) -> dict[int, int]:
        """Bucket -> version that wrote it; one entry for each bucket that has rows."""
        rows = self.spark.read.schema("bucket int, version long").parquet(f"{self.root}/manifest/v={version}")
        return {r.bucket: r.version for r in rows.collect()}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast(self.schema[self.key].dataType)), F.lit(self.buckets)).cast("int")

    def _path(self, version: int, bucket: int) -> str:
        return f"{self.root}/data/v={version}/bucket={bucket}"

    def read(self, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """A version, the last one without a number; only some buckets of it if asked for."""
        held = self.manifest(self.versions()[-1] if version is None else version)
        paths = [self._path(v, b) for b, v in sorted(held.items()) if buckets is None or b in buckets]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def write(self, version: int, rows: DataFrame, before: int | None = None) -> None:
        """A version that has `rows` in place of what their buckets held in `before`; written again, it is the same."""
        held = {} if before is None else self.manifest(before)
        dealt = rows.select(*self.schema.names).withColumn("bucket", self.bucket()).repartition("bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/v={version}")
        written = _finished(self.spark, f"{self.root}/data/v={version}/bucket=*")
        held.update((int(f.rsplit("=", 1)[1]), version) for f in written)
        listed = self.spark.createDataFrame(sorted(held.items()), "bucket int, version long")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest/v={version}")
        self._tidy()

    def _tidy(self) -> None:
        """Remove what is in neither of the last two versions; the one before the last may have to be built on again."""
        kept = self.versions()[-2:]
        held = {(v, b) for version in kept for b, v in self.manifest(version).items()}
        gone = [f"{self.root}/manifest/v={v}" for v in self.versions() if v < kept[0]]
        for path in _finished(self.spark, f"{self.root}/data/v=*/bucket=*"):
            version, bucket = (int(x.split("=")[1]) for x in path.split("/")[-2:])
            if version < kept[-1] and (version, bucket) not in held:
                gone.append(path)
        for path in gone:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def stream_upsert(
    stream: DataFrame, target: DataFrame, key: str, order: str, overwrite: Sequence[str], defaults,
    home: str | None = None, buckets: int = 64,
) -> DataFrame:
    """Upsert every micro-batch into a `BucketTable`, one version per batch. Returns the last version.

    A batch reads and writes only the buckets of its keys. It builds on the version before
    its own number, so that a batch run twice gives the same table. With a `home` that
    holds versions already, `target` is not read again; `buckets` must not change.
    """
    spark = stream.sparkSession
    home = home or scratch(spark, "stream")
    table = BucketTable(spark, f"{home}/table", target.schema, key, buckets)
    if not table.versions():
        table.write(-1, target)

    def each(batch: DataFrame, batch_id: int) -> None:
        own = BucketTable(batch.sparkSession, table.root, table.schema, key, buckets)
        before = max(v for v in own.versions() if v < batch_id)
        newest = F.max_by(F.struct(*batch.columns), order).alias("__row")
        latest = materialise(batch.groupBy(key).agg(newest).select("__row.*"))
        # at most one row for each bucket
        touched = [r[0] for r in latest.select(own.bucket()).distinct().collect()]
        merged = upsert_catalog(own.read(before, touched), latest, key, overwrite, defaults)
        own.write(batch_id, merged, before)

    drain_batches(stream, each, home=home)
    return table.read()


def stream_notifications(stream: DataFrame, status: str, terminal: dict[str, str]) -> DataFrame:
    """A notification per row that reaches a terminal status: status -> level."""
    level = F.create_map(*[F.lit(x) for pair in terminal.items() for x in pair])
    rows = stream.filter(F.col(status).isin(list(terminal)))
    return rows.withColumns({"level": F.element_at(level, F.col(status)), "is_read": F.lit(False)})
