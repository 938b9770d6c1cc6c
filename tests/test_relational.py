from __future__ import annotations

from uuid import uuid4

import pytest
from pyspark.sql import functions as F

from queries import queries as registered
from quillwork.functions.aggregates import register_aggregates
from quillwork.operators.filters import page
from quillwork.operators.paging import PageIndex
from quillwork.sources import readers
from quillwork.sources.relational import append_missing_jdbc, export_jdbc, key_bounds, scan_jdbc


@pytest.fixture
def url():
    return f"jdbc:derby:memory:t{uuid4().hex};create=true"


def test_round_trip_in_ranges(spark, url):
    rows = [(i * 3 - 500, f"name {i}", None if i % 7 == 0 else i / 4, i % 2 == 0) for i in range(700)]
    df = spark.createDataFrame(rows, "id long, name string, score double, even boolean")
    export_jdbc(df, url, "things", texts=40)
    assert key_bounds(spark, url, "things", "id") == (-500, 1597, 700)
    found = scan_jdbc(spark, url, "things", "id", parts=5)
    assert found.rdd.getNumPartitions() == 5
    assert sorted(map(tuple, found.collect()), key=str) == sorted(rows, key=str)
    export_jdbc(df.limit(3), url, "things", texts=40)
    assert scan_jdbc(spark, url, "things", "id").count() == 3


def test_filters_and_columns_reach_the_database(spark, url, capsys):
    df = spark.range(100).select("id", F.col("id").cast("string").alias("name"))
    export_jdbc(df, url, "t", texts=10, types={"id": "BIGINT"})
    found = scan_jdbc(spark, url, "t", "id", parts=3).where("id >= 40 and name <> '41'").select("name")
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(id,40)" in plan and "Not(EqualTo(name,41))" in plan
    assert "ReadSchema: struct<name:string>" in plan
    assert found.count() == 59


def test_appending_twice_adds_nothing(spark, url):
    df = spark.range(50).select("id", (F.col("id") * 2).alias("twice"))
    export_jdbc(df.where("id < 20"), url, "t")
    assert append_missing_jdbc(df, url, "t", "id") == 30
    assert append_missing_jdbc(df, url, "t", "id") == 0
    assert scan_jdbc(spark, url, "t", "id").agg(F.count("*"), F.sum("twice")).first() == (50, 2450)


def test_empty_tables(spark, url):
    df = spark.range(0).select("id", F.lit("x").alias("name"))
    export_jdbc(df, url, "t", texts=5)
    assert key_bounds(spark, url, "t", "id") == (None, None, 0)
    assert scan_jdbc(spark, url, "t", "id", parts=4).isEmpty()


def test_commit_log_in_pieces(spark, tmp_path):
    """Several tasks read one log, whose order is exact."""
    lines = [f"{i:05x}\tfeat: change {i} {'x' * (i % 90)}" if i % 11 else "   " for i in range(900)]
    (tmp_path / "log.txt").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        numbered = readers.numbered_lines(spark, str(tmp_path / "log.txt"))
        assert spark.read.text(str(tmp_path / "log.txt")).rdd.getNumPartitions() > 5
        assert [(r.seq, r.value) for r in numbered.orderBy("seq").collect()] == list(enumerate(lines))
        got = [(r.seq, r.commit_hash) for r in readers.scan_commit_log(spark, str(tmp_path), limit=500).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [(i, line.split("\t")[0]) for i, line in enumerate(lines) if line.strip()]
    assert got == want[:500]


def test_commit_log_of_several_files(spark, tmp_path):
    for name, lines in (("b.log", ["c\tthree"]), ("a.log", ["a\tone", "b\ttwo"]), ("c.log", [])):
        (tmp_path / name).write_text("".join(f"{line}\n" for line in lines))
    assert [r.subject for r in readers.scan_commit_log(spark, str(tmp_path)).collect()] == ["one", "two", "three"]


@pytest.mark.parametrize("offset", [0, 1, 499, 777, 2_950, 2_999, 3_000, 9_999])
def test_pages_of_an_index(spark, offset):
    df = spark.range(3_000).select("id", (F.col("id") * 7 % 50).alias("a"), F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("b"))
    order = [F.desc("a"), F.col("b")]
    index = PageIndex.of(df, order, "id")
    want = page(df, order, "id", 60, offset).collect()
    assert index.page(60, offset).collect() == want and index.total == 3_000


def test_deep_pages_read_few_slices(spark):
    df = spark.range(20_000).select("id", F.hash("id").alias("h"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as with slices of more than 64 MB
    try:
        index = PageIndex.of(df, [F.col("h")], ["id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(index.slices) == 8 and max(b - a for a, b in zip(index.starts, index.starts[1:])) < 5_000
    assert index.page(50, 18_000).collect() == df.orderBy("h", "id").withColumn("total", F.lit(20_000).cast("long")).collect()[18_000:18_050]
    assert page(df, [F.col("h")], "id", 50, 18_000).collect() == df.orderBy("h", "id").withColumn("total", F.lit(20_000).cast("long")).collect()[18_000:18_050]
    empty = PageIndex.of(df.where("id < 0"), [F.col("h")], "id")
    assert empty.total == 0 and empty.page(10, 0).isEmpty()
    with pytest.raises(ValueError):
        index.page(0, 0)


def test_first_seen_lines_in_sql(spark):
    register_aggregates(spark)
    rows = [("a", 2, "Beta\n alpha \r\nGAMMA"), ("a", 1, "Alpha\n\nbeta"), ("b", 1, None), ("b", 2, "x X"), ("c", None, "y")]
    spark.createDataFrame(rows, "k string, at long, text string").createOrReplaceTempView("texts")
    want = {"a": ["Alpha", "beta", "GAMMA"], "b": ["x"], "c": []}
    whole = spark.sql("SELECT k, first_seen_lines(at, text) AS v FROM texts GROUP BY k").collect()
    parts = spark.sql(
        "SELECT k, first_seen_merge(p) AS v FROM (SELECT k, first_seen_part(at, text) AS p FROM texts GROUP BY k, at DIV 2) GROUP BY k"
    ).collect()
    assert {r.k: list(r.v) for r in whole} == want == {r.k: list(r.v) for r in parts}


def test_first_seen_query_merges_outside_python(spark, tmp_path):
    rows = [(1, "s", "Beta\nalpha"), (250, "s", "ALPHA\nGamma"), (251, "s", None), (2, "blank", " \n"), (3, "none", None)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = registered()["k5_first_seen_lines_sql"](spark, str(tmp_path))
    assert "first_seen_merge" not in found._jdf.queryExecution().toString()
    assert [tuple(r) for r in found.collect()] == [("s", "Beta\nalpha\nGamma", 3)]
