"""Scans and numbering against plain Python, for whole and for split keys."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quillwork.operators.filters import subsample_even
from quillwork.operators.ordered import Ordered, lag, last, last_before, number_rows, total
from quillwork.operators.sequence import revision_on_change


def _rows(seed: int) -> list[tuple[str, int, int | None]]:
    rng = random.Random(seed)
    sizes = {"hot": 60, "b": 20, "c": 7, "d": 1}
    return [
        (key, i * 3, rng.choice([None, 0, 1, 2])) for key, n in sizes.items() for i in range(n)
    ]


def test_scans_match_a_loop(spark, sizes):
    rows = _rows(1)
    df = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), "k string, pos long, v int")
    seq = Ordered.of(df, ["k"], "pos")
    v = F.col("v")
    got = seq.scan(lagged=lag(v), latest=last(v), before=last_before(v), summed=total(v)).df.collect()
    want, state = {}, {}
    for key, pos, value in rows:
        previous, latest, summed = state.get(key, (None, None, None))
        after = latest if value is None else value
        added = summed if value is None else (summed or 0) + value
        want[key, pos] = (previous, after, latest, added)
        state[key] = (value, after, added)
    assert {(r.k, r.pos): (r.lagged, r.latest, r.before, r.summed) for r in got} == want


def test_numbering_splits_a_hot_key(spark, sizes):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else "k%d" % (i % 10), rng.random(), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, at double, id long").repartition(5)
    got = number_rows(df, ["k"], [F.col("at"), F.col("id")]).df.collect()
    want = {}
    for key in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == key), key=lambda r: r[1:])
        want.update({r[2]: i for i, r in enumerate(ordered)})
    assert {r.id: r.pos for r in got} == want


def test_revision_counts_changes(spark, sizes):
    states = ["a", "a", "b", "b", "a"] * 6
    df = spark.createDataFrame([("x", i, s) for i, s in enumerate(states)], "k string, pos long, status string")
    got = {r.pos: r.revision for r in revision_on_change(Ordered.of(df, ["k"], "pos")).df.collect()}
    revision, want = 1, {}
    for i, state in enumerate(states):
        revision += i > 0 and state != states[i - 1]
        want[i] = revision
    assert got == want


def test_subsample_even(spark):
    df = spark.range(20).select(F.lit("a").alias("k"), F.col("id").alias("pos"))
    picked = lambda cap: sorted(r.pos for r in subsample_even(df, ["k"], [F.col("pos")], cap).collect())
    assert picked(5) == [0, 4, 8, 12, 16]
    assert picked(30) == picked(0) == list(range(20))
    for cap in (1, 3, 7, 11, 19, 20):
        assert picked(cap) == sorted({int(i * (20 / cap)) for i in range(cap)})
