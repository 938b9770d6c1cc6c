"""Keep-or-drop folds against plain Python, for whole and for split keys."""

from __future__ import annotations

import difflib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillwork.operators import folds, pointers
from quillwork.operators.folds import GapRule
from quillwork.operators.ordered import Ordered
from quillwork.operators.sequence import (
    flag_near_duplicates,
    keep_best_of_duplicates,
    keep_on_text_change,
    quality_filters,
    scene_changes,
)
from quillwork.session import FOLD_ROWS, materialise

VECTORS = "k string, pos long, signature array<double>, sharpness double, pixel_std double"


def _vectors(seed: int):
    rng = random.Random(seed)
    rows = []
    for key, n in (("hot", 40), ("b", 9), ("c", 1)):
        value = 0.0
        for i in range(n):
            value += rng.choice([0.0, 0.004, 0.01, 0.02])
            vector = None if rng.random() < 0.1 else [value, value]
            rows.append((key, i, vector, float(rng.randrange(5) * 40), float(rng.randrange(8))))
    return rows


def _groups(rows, limit):
    """Key -> list of groups of rows, by distance to the first row of the group."""
    groups: dict[str, list[list]] = {}
    base: dict[str, list | None] = {}
    for row in rows:
        key, vector, anchor = row[0], row[2], base.get(row[0])
        if anchor is not None:
            gap = 1.0 if vector is None else float(np.abs(np.array(vector) - np.array(anchor)).mean())
            if gap <= limit:
                groups[key][-1].append(row)
                continue
        groups.setdefault(key, []).append([row])
        base[key] = vector
    return groups


def test_duplicates_compare_with_the_last_kept_row(spark, sizes):
    for seed in range(3):
        rows = _vectors(seed)
        seq = Ordered.of(spark.createDataFrame(rows, VECTORS), ["k"], "pos")
        got = {(r.k, r.pos) for r in flag_near_duplicates(seq).filter("not is_duplicate").collect()}
        want = {(g[0][0], g[0][1]) for groups in _groups(rows, 0.012).values() for g in groups}
        assert got == want


def test_drift_is_not_a_chain_of_duplicates(spark, sizes):
    rows = [("a", i, [x], 0.0, 9.0) for i, x in enumerate((0.0, 0.01, 0.02, 0.03))]
    seq = Ordered.of(spark.createDataFrame(rows, VECTORS), ["k"], "pos")
    flagged = flag_near_duplicates(seq).filter("is_duplicate").collect()
    assert sorted(r.pos for r in flagged) == [1, 3]


def test_best_of_duplicates(spark, sizes):
    rows = _vectors(7)
    seq = Ordered.of(spark.createDataFrame(rows, VECTORS), ["k"], "pos")
    groups = [g for gs in _groups(rows, 0.012).values() for g in gs]
    best = {max(g, key=lambda r: (r[3], -r[1]))[:2] for g in groups}
    assert {(r.k, r.pos) for r in keep_best_of_duplicates(seq).collect()} == best
    first = {g[0][:2] for g in groups}
    assert {(r.k, r.pos) for r in keep_best_of_duplicates(seq, sharpness=None).collect()} == first


def test_quality_filters_run_in_order(spark, sizes):
    rows = _vectors(11)
    seq = Ordered.of(spark.createDataFrame(rows, VECTORS), ["k"], "pos")
    usable = [r for r in rows if r[4] >= 4 and r[3] >= 60]
    want = set()
    for key, groups in _groups(usable, 0.012).items():
        best = [max(g, key=lambda r: (r[3], -r[1])) for g in groups]
        cap = 3
        picks = range(len(best)) if len(best) <= cap else {int(i * (len(best) / cap)) for i in range(cap)}
        want |= {(key, best[i][1]) for i in picks}
    assert {(r.k, r.pos) for r in quality_filters(seq, cap=3).collect()} == want


def _text_change(texts, limit, collapse):
    kept, base = [], None
    for i, text in enumerate(texts):
        text = " ".join(text.lower().split())
        if base is not None and not (not collapse and not text and not base):
            if not text or not base:
                ratio = float(text == base)
            else:
                ratio = difflib.SequenceMatcher(None, text, base).ratio()
            if ratio >= limit:
                continue
        kept.append(i)
        base = text
    return kept


def test_text_change(spark, sizes):
    rng = random.Random(5)
    words = ["", "alpha beta", "alpha  Beta", "alpha beta gamma", "delta", "delta epsilon zeta eta", "alpha betas"]
    texts = [rng.choice(words) for _ in range(40)]
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(texts)], "k string, pos long, ocr_text string")
    seq = Ordered.of(df, ["k"], "pos")
    for collapse in (True, False):
        got = sorted(r.pos for r in keep_on_text_change(seq, collapse_empty=collapse).collect())
        assert got == _text_change(texts, 0.85, collapse)
    equal = sorted(r.pos for r in keep_on_text_change(seq, equal_only=True).collect())
    assert equal == _text_change(texts, 1.0, True)


def test_three_texts_keep_their_first_frames(spark):
    rows = [("a", i, i * 0.5, f"{'one two three'.split()[i // 3]} slide about something") for i in range(9)]
    df = spark.createDataFrame(rows, "k string, pos long, timestamp double, ocr_text string")
    kept = keep_on_text_change(Ordered.of(df, ["k"], "pos"), limit=0.95).collect()
    assert sorted(r.timestamp for r in kept) == [0.0, 1.5, 3.0]


def test_textless_scenes_are_all_kept_when_not_collapsed(spark):
    df = spark.createDataFrame([("a", i, " ") for i in range(3)], "k string, pos long, ocr_text string")
    seq = Ordered.of(df, ["k"], "pos")
    assert keep_on_text_change(seq, collapse_empty=False).count() == 3
    assert keep_on_text_change(seq).count() == 1


def test_scene_changes_start_with_the_opening_row(spark):
    def run(changes):
        rows = [("a", i, i * 1.0, c) for i, c in enumerate(changes)]
        df = spark.createDataFrame(rows, "k string, pos long, timestamp double, change double")
        return sorted(r.timestamp for r in scene_changes(Ordered.of(df, ["k"], "pos")).collect())

    assert run([None, 0.0, 0.9, 0.1, 0.8, 0.0]) == [0.0, 2.0, 4.0]
    assert run([None, 0.0, 0.0]) == [0.0]
    assert run([0.9, 0.0, 0.5]) == [0.0, 2.0]


def test_result_does_not_depend_on_partitioning(spark):
    rows = _vectors(13)
    df = spark.createDataFrame(rows, VECTORS)
    results = []
    for n in (1, 3, 9):
        seq = Ordered.of(df.orderBy(F.rand(n)).repartition(n), ["k"], "pos")
        results.append(sorted((r.k, r.pos) for r in flag_near_duplicates(seq).filter("is_duplicate").collect()))
    assert results[0] == results[1] == results[2]


def _kept(rows, limit):
    return {(g[0][0], g[0][1]) for groups in _groups(rows, limit).values() for g in groups}


def _drift(seed: int):
    """Keys whose folds never meet, or only late: slow drifts, with still scenes, noise and gaps between."""
    rng = random.Random(seed)
    rows = [("slow", i, [0.005 * i], 0.0, 9.0) for i in range(400)]
    value = 0.0
    for i in range(500):
        value += 0.0 if 120 <= i < 330 else 0.005
        rows.append(("still", i, [value, value], 0.0, 9.0))
    for i in range(300):
        vector = None if i in (90, 91, 250) else [0.005 * i + (rng.uniform(-0.001, 0.001) if i > 150 else 0.0)]
        rows.append(("noisy", i, vector, 0.0, 9.0))
    rows += [("short", i, [0.1 * i], 0.0, 9.0) for i in range(4)]
    rows += [("same", i, [0.5], 0.0, 9.0) for i in range(200)]
    return rows


@pytest.mark.parametrize("rounds", [0, 3])
def test_slow_drift_is_settled_by_pointers(spark, monkeypatch, rounds):
    monkeypatch.setattr(folds, "ROUNDS", rounds)
    tables = []
    monkeypatch.setattr(pointers, "materialise", lambda df: tables.append(1) or materialise(df))
    rows = _drift(1)
    seq = Ordered.of(spark.createDataFrame(rows, VECTORS), ["k"], "pos")
    spark.conf.set(FOLD_ROWS, "10")
    try:
        got = {(r.k, r.pos) for r in flag_near_duplicates(seq).filter("not is_duplicate").collect()}
    finally:
        spark.conf.unset(FOLD_ROWS)
    assert got == _kept(rows, 0.012)
    # 50 chunks: some tables for each of their six doublings, not one for each chunk
    assert 0 < len(tables) < 45


def test_slow_change_of_text_by_pointers(spark, monkeypatch):
    monkeypatch.setattr(folds, "ROUNDS", 0)
    rng = random.Random(3)
    letters, texts = list("abcdefghijklmnopqrstuvwxyz"), []
    for i in range(160):
        if i % 2 == 0 and not 60 <= i < 110:
            letters[rng.randrange(26)] = rng.choice("0123456789")
        texts.append("" if i in (30, 31, 140) else "".join(letters))
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate(texts)], "k string, pos long, ocr_text string")
    seq = Ordered.of(df, ["k"], "pos")
    spark.conf.set(FOLD_ROWS, "8")
    try:
        for collapse in (True, False):
            got = sorted(r.pos for r in keep_on_text_change(seq, collapse_empty=collapse).collect())
            assert got == _text_change(texts, 0.85, collapse)
    finally:
        spark.conf.unset(FOLD_ROWS)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.lists(st.integers(0, 6), min_size=2, max_size=2), max_size=25))
def test_successors_of_vectors(vectors):
    rule = GapRule(1.0)
    values = rule.decode(pa.array(vectors, pa.list_(pa.float64())))
    plain = [None if v is None else np.array(v, float) for v in vectors]
    for i, after in enumerate(rule.successors(values).tolist()):
        kept = (j for j in range(i + 1, len(plain)) if plain[i] is None or plain[j] is None or np.abs(plain[i] - plain[j]).mean() > 1)
        assert after == next(kept, len(plain))
