"""Streams fed file by file give what the batch operators give."""

from __future__ import annotations

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from quillwork.streaming import streams as ops

SCHEMA = "key string, ts timestamp, id long, state string"


def _write(spark, tmp_path, slices):
    for i, rows in enumerate(slices):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    folder = tmp_path / "all"
    folder.mkdir()
    for i in range(len(slices)):
        for part in sorted((tmp_path / f"in{i}").glob("part-*")):
            target = folder / f"{i:02d}-{part.name}"
            target.write_bytes(part.read_bytes())
            os.utime(target, (1_700_000_000 + i * 10,) * 2)
    return str(folder)


def _events(seed: int, n: int):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    return [
        (rng.choice("aab"), start + dt.timedelta(minutes=i), i, rng.choice(["on", "off"])) for i in range(n)
    ]


def test_keep_on_change_over_shuffled_slices(spark, tmp_path):
    rows = _events(1, 240)
    slices = [rows[i : i + 60] for i in range(0, 240, 60)]
    # out of order inside the delay: neighbours of two slices are swapped
    slices[0][-5:], slices[1][:5] = slices[1][:5], slices[0][-5:]
    rng = random.Random(2)
    path = _write(spark, tmp_path, [rng.sample(s, len(s)) for s in slices])
    stream = ops.stream_table(spark, path, files_per_batch=1)
    got = ops.drain(ops.stream_keep_on_change(stream, "key", "ts", "id", "state", "30 minutes")).collect()
    limit, kept, want = max(r[1] for r in rows) - dt.timedelta(minutes=30), {}, set()
    for key, ts, ident, state in rows:
        if ts < limit and kept.get(key) != state:
            kept[key] = state
            want.add((key, ident, state))
    assert {(r.key, r.id, r.state) for r in got} == want


def _changes(rows):
    kept, want = {}, []
    for key, ts, ident, state in sorted(rows, key=lambda r: r[1:3]):
        if kept.get(key, "") != state:
            kept[key] = state
            want.append((key, ident, state))
    return sorted(want, key=str)


def test_changes_up_to_the_end_of_the_input_and_beyond(spark, tmp_path):
    """Read with the rest after each of two runs; the second goes on from the state, not from the rest."""
    rows = [(k, ts, i, None if i % 17 == 0 else s) for k, ts, i, s in _events(6, 200)]
    path = _write(spark, tmp_path, [rows[:90], rows[90:130], rows[130:]])
    names = sorted(os.listdir(path))
    os.rename(f"{path}/{names[-1]}", str(tmp_path / names[-1]))
    columns, home = ("key", "ts", "id", "state"), str(tmp_path / "home")

    def run():
        stream = ops.stream_table(spark, path, files_per_batch=1)
        changes = ops.stream_keep_on_change(stream, *columns, "30 minutes")
        found = ops.drain(changes, home=home, rest=ops.rest_of_changes(*columns)).collect()
        return sorted(((r.key, r.id, r.state) for r in found), key=str)

    assert run() == _changes(rows[:130])
    assert run() == _changes(rows[:130])
    os.rename(str(tmp_path / names[-1]), f"{path}/{names[-1]}")
    assert run() == _changes(rows)


def test_windows_and_sessions_up_to_the_end_of_the_input(spark, tmp_path):
    rows = _events(8, 150)
    path = _write(spark, tmp_path, [rows[:80], rows[80:]])
    stream = ops.stream_table(spark, path, files_per_batch=1)
    counts = ops.stream_status_counts(stream, "ts", "state", "1 hour", "30 minutes")
    got = ops.drain(counts, rest=ops.rest_of_counts("state")).collect()
    want = {}
    for _, ts, _, state in rows:
        for start in (ts.replace(minute=ts.minute // 30 * 30) - dt.timedelta(minutes=m) for m in (0, 30)):
            want[start, state] = want.get((start, state), 0) + 1
    assert {(r.window_start, r.state): r.n for r in got} == want and len(got) == len(want)
    sessions = ops.stream_session_counts(stream, "ts", "key", "4 minutes")
    got = ops.drain(sessions, rest=ops.rest_of_sessions("key")).collect()
    want = []
    for key in "ab":
        for ts in sorted(r[1] for r in rows if r[0] == key):
            if want and want[-1][0] == key and ts - want[-1][2] <= dt.timedelta(minutes=4):
                want[-1] = (key, want[-1][1], ts, want[-1][3] + 1)
            else:
                want.append((key, ts, ts, 1))
    assert sorted((r.key, r.session_start, r.session_end - dt.timedelta(minutes=4), r.n) for r in got) == want


def _bytes(folder) -> int:
    return sum(f.stat().st_size for f in folder.rglob("*.parquet"))


def test_a_version_writes_the_buckets_it_touches(spark, tmp_path):
    schema = spark.range(1).select("id", F.lit("x").alias("v")).schema
    table = ops.BucketTable(spark, str(tmp_path / "t"), schema, "id", 8)
    rows = spark.range(4_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v"))
    table.write(0, rows)
    whole = _bytes(tmp_path / "t" / "data" / "v=0")
    one = spark.createDataFrame([(7, "new")], schema)
    bucket = one.select(table.bucket()).first()[0]
    for version in (1, 1, 2):
        base = table.read(version - 1, [bucket])
        table.write(version, base.where("id <> 7").unionByName(one), version - 1)
        assert _bytes(tmp_path / "t" / "data" / f"v={version}") < whole / 4
        assert table.read().count() == 4_000 and table.read().where("v = 'new'").count() == 1
    assert table.versions() == [1, 2]
    held = sorted(p.relative_to(tmp_path / "t" / "data").as_posix() for p in (tmp_path / "t" / "data").glob("v=*/bucket=*"))
    assert held == sorted([f"v=0/bucket={b}" for b in range(8) if b != bucket] + [f"v={v}/bucket={bucket}" for v in (1, 2)])
    assert table.read(1).where("id = 7").count() == 1 and table.manifest(2)[bucket] == 2


def test_each_file_is_read_once_and_upserts_are_idempotent(spark, tmp_path):
    rows = _events(3, 90)
    path = _write(spark, tmp_path, [rows[:30], rows[30:60], rows[60:]])
    stream = ops.stream_table(spark, path, files_per_batch=1)
    assert ops.drain(stream).count() == 90
    target = spark.createDataFrame([("a", "none", "kept"), ("z", "none", "kept")], "key string, state string, note string")
    table = ops.stream_upsert(
        stream.select("key", "state", "id"), target, "key", "id", ["state"], {"note": F.lit("new")}
    )
    newest = {k: [r for r in rows if r[0] == k][-1][3] for k in "ab"}
    got = {r.key: (r.state, r.note) for r in table.collect()}
    assert got == {"a": (newest["a"], "kept"), "b": (newest["b"], "new"), "z": ("none", "kept")}


def test_late_rows_do_not_reopen_a_window(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    early = [("a", start + dt.timedelta(minutes=m), m, "on") for m in (1, 2, 30)]
    later = [("a", start + dt.timedelta(hours=3), 100, "on")]
    late = [("a", start + dt.timedelta(minutes=5), 200, "on"), ("a", start + dt.timedelta(hours=6), 201, "on")]
    after = [("a", start + dt.timedelta(hours=4), 150, "on")]
    path = _write(spark, tmp_path, [early, later, after, late])
    stream = ops.stream_table(spark, path, files_per_batch=1)
    got = ops.drain(ops.stream_status_counts(stream, "ts", "state", "1 hour", delay="10 minutes")).collect()
    assert sorted((r.window_start.hour, r.n) for r in got) == [(0, 3), (3, 1), (4, 1)]


def test_corpus_stream(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    (tmp_path / "b.txt").write_bytes(b"y")
    rows = ops.drain(ops.stream_corpus(spark, str(tmp_path), (".pdf",))).collect()
    assert [(r.name, r.size) for r in rows] == [("a.pdf", 1)]


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    rows = _events(4, 60)
    path = _write(spark, tmp_path, [rows[:30], rows[30:]])
    first, second = sorted(os.listdir(path))[:1], sorted(os.listdir(path))[1:]
    for name in second:
        os.rename(f"{path}/{name}", str(tmp_path / name))
    home = str(tmp_path / "home")
    target = spark.createDataFrame([("z", "none")], "key string, state string")
    upsert = lambda: ops.stream_upsert(
        ops.stream_table(spark, path), target, "key", "id", ["state"], {}, home=f"{home}/table"
    )
    assert ops.drain(ops.stream_table(spark, path), home=f"{home}/all").count() == 30
    upsert()
    for name in second:
        os.rename(str(tmp_path / name), f"{path}/{name}")
    assert first
    assert ops.drain(ops.stream_table(spark.newSession(), path), home=f"{home}/all").count() == 60
    latest = {}
    for key, _, _, state in rows:
        latest[key] = state
    assert {r.key: r.state for r in upsert().collect()} == {**latest, "z": "none"}
    assert ops.BucketTable(spark, f"{home}/table/table", target.schema, "key").versions() == [0, 1]
