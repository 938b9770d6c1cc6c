from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from quillwork.llm.hnsw import Graph, _units, cosines, near_vectors, shard_links


def vectors(seed: int, n: int, width: int = 16) -> np.ndarray:
    r = np.random.default_rng(seed)
    centres = r.normal(size=(max(2, n // 12), width))
    return centres[r.integers(0, len(centres), n)] + 0.3 * r.normal(size=(n, width))


def brute(rows: list[tuple], limit: float = 0.93) -> dict:
    good = {}
    for i, (key, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = (key, np.array(v, float), label)
    root = {key: key for key, *_ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    links = {key: 0 for key in root}
    for i, (a, v, x) in good.items():
        for j, (b, w, y) in good.items():
            if i < j and x == y and len(v) == len(w) and cosines(v[None], w[None])[0] >= limit:
                links[a] += 1
                links[b] += 1
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {k: (links[k], top(k), top(k) == k) for k in root}


def test_against_all_pairs(spark):
    x = vectors(1, 400)
    rows = [(int(i), [float(np.float32(c)) for c in v], int(i % 3) if i % 7 else None) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[4][1], rows[4][2]) for i in range(30)] + [(2000, [2 * c for c in rows[4][1]], rows[4][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for shard, block in ((20_000, 1_000), (40, 25)):
        got = near_vectors(df, shard=shard, block=block).collect()
        assert len(got) == len(rows)
        assert {r[0]: tuple(r)[1:] for r in got} == brute(rows)


def test_recall_of_large_and_dense_shards():
    dense = np.concatenate([vectors(2, 1500), vectors(3, 1)[0] + 0.02 * np.random.default_rng(4).normal(size=(300, 16))])
    graph = Graph(_units(dense))
    truth = _units(dense) @ _units(dense).T >= 0.93
    found = shard_links(graph, dense, dense, 0.93)
    hits = sum(truth[i, f].sum() for i, f in enumerate(found))
    assert hits >= 0.99 * truth.sum() and hits == sum(map(len, found))


def test_wide_beams_hold_few_copies_of_vectors():
    rng = np.random.default_rng(6)
    center = rng.normal(size=64)
    dense = np.concatenate([rng.normal(size=(300, 64)), center / np.linalg.norm(center) + 0.01 * rng.normal(size=(1_500, 64))])
    graph = Graph(_units(dense))
    tracemalloc.start()
    found = graph.within(_units(dense[-200:]), 0.93, 1_400)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(len(ids) == 1_500 for ids, _ in found) and peak < 150e6


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [1.0, nan], 0), (6, [inf, 1.0], 0),
        (7, [1.0, 0.0], 0), (8, [1e-200, 0.0], 0), (9, [1.0, 0.0, 0.0], 0), (10, [1.0, 0.0], None), (11, [1.0, 0.0], 1),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, kept string")
    assert {r[0]: tuple(r)[1:] for r in near_vectors(df).collect()} == brute(rows)
    twice = df.where("vec_id = 7").union(df.where("vec_id = 7")).union(df.where("vec_id = 7").selectExpr("null", "embedding", "label", "kept"))
    got = sorted((tuple(r) for r in near_vectors(twice).collect()), key=str)
    assert got == [(7, 1, 7, True), (7, 1, 7, True), (None, 0, None, True)]
    assert near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_small_graphs_find_everything(n):
    x = vectors(n, n)
    found = shard_links(Graph(_units(x)), x, x, -1.0)
    assert all(sorted(f.tolist()) == list(range(n)) for f in found)
