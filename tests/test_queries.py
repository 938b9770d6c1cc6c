"""Every registered query next to its SQL, on the smallest tables."""

from __future__ import annotations

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry_points
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the given tables")
QUERIES, SQL = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    verdict = compare(spark, con, name, QUERIES[name], SQL.get(name), SF_DIR)
    assert verdict.startswith(("ok", "rows only")), verdict


def test_unions_of_tables_dealt_out_by_a_key(spark, con):
    name = "l5_map_document_by_bookmarks"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        verdict = compare(spark, con, name, QUERIES[name], SQL[name], SF_DIR)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert verdict.startswith("ok"), verdict


ODD_TEXTS = ["", "   ", "\n", " \n\n ", "\nsecond line\nthird", "one", None]


@pytest.fixture(scope="module")
def odd_dir(tmp_path_factory):
    """The smallest tables with texts that are missing, empty, blank or start with an empty line."""
    folder = tmp_path_factory.mktemp("odd")
    for table in os.listdir(SF_DIR):
        if table != "documents.parquet":
            (folder / table).symlink_to(f"{SF_DIR}/{table}")
    given = pq.read_table(f"{SF_DIR}/documents.parquet")
    odd = [{"doc_id": 900_000 + i, "text": text, "lang": "en", "source": "web", "n_chars": 0} for i, text in enumerate(ODD_TEXTS)]
    pq.write_table(pa.concat_tables([given, pa.Table.from_pylist(odd, given.schema)]), folder / "documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["i19_word_count", "i5_clean_lines", "l5_map_document"])
def test_texts_without_words(spark, odd_dir, name):
    verdict = compare(spark, connect(odd_dir), name, QUERIES[name], SQL[name], odd_dir)
    assert verdict.startswith("ok"), verdict


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
