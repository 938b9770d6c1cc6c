"""Run registered queries next to their SQL: python -m tests.oracle [sf] [name...]."""

from __future__ import annotations

import sys
import time

import duckdb

from queries import oracle_sql, queries
from quillwork.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _cell(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        return repr(int(value)) if value.is_integer() else f"{value:.10g}"
    if hasattr(value, "isoformat"):
        return value.isoformat()[:26]
    return str(value)


def rows_of(frame_rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in frame_rows)


SPARK_KIND = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "date": "DATE", "float": "FLOAT",
    "smallint": "SMALLINT",
}


def compare(spark, con, name, fn, sql, sf_dir) -> str:
    df = fn(spark, sf_dir)
    got = rows_of(df.collect(), df.columns)
    if sql is None:
        return f"rows only ({len(got)})" if got else "EMPTY"
    started = time.time()
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    want = rows_of(result.fetchall(), columns)
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(columns)}"
    bad = {
        c: (t, types[c]) for c, t in df.dtypes if SPARK_KIND.get(t, t).lower() != types[c].lower()
    }
    if got != want:
        extra, missing = set(got) - set(want), set(want) - set(got)
        return (
            f"VALUES {len(got)} vs {len(want)} rows; {sorted(df.columns)}; only spark "
            f"{[str(x)[:400] for x in sorted(extra)[:2]]} only sql {[str(x)[:400] for x in sorted(missing)[:2]]}"
        )
    if bad:
        return f"TYPES {bad}"
    return f"ok ({len(got)}; SQL {time.time() - started:.1f}s)" if got else "EMPTY"


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.log.level": "ERROR",
        },
    )
    con, failures, sql = connect(sf_dir), 0, oracle_sql()
    for name, fn in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        started = time.time()
        try:
            verdict = compare(spark, con, name, fn, sql.get(name), sf_dir)
        except Exception as exc:  # noqa: BLE001
            verdict = f"ERROR {type(exc).__name__}: {str(exc)[:1500]}"
        good = verdict.startswith(("ok", "rows only"))
        failures += not good
        print(f"{'  ' if good else '! '}{name}: {verdict} [{time.time() - started:.1f}s]", flush=True)
    print(f"{failures} failures; {len(queries())} queries, {len(sql)} with SQL")
    spark.stop()
    return bool(failures)


if __name__ == "__main__":
    sys.exit(main())
