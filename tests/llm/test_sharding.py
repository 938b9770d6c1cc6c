from __future__ import annotations

import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from quillwork.llm import sharding
from quillwork.llm.sharding import RoomTree, best_fit, capacity_shards, even_fit, even_shards

SF_DIR = "/root/testdata/sf0.001"
SIZES = st.dictionaries(st.integers(1, 60), st.integers(1, 9), max_size=25)


def slow_best_fit(groups: list[int], capacity: int, first: int = 0) -> list[tuple[int, int]]:
    """(size, bin) of every group, one at a time, every bin looked at."""
    rooms, out = [], []
    for size in sorted(groups, reverse=True):
        fits = [(room, i) for i, room in enumerate(rooms) if room >= size]
        if fits:
            i = min(fits)[1]
        else:
            i = len(rooms)
            rooms.append(max(capacity, size))
        rooms[i] -= size
        out.append((size, first + i))
    return out


def spelt(runs) -> Counter:
    out = Counter()
    for size, bin_, count in runs:
        out[size, bin_] += count
    return out


@settings(max_examples=300, deadline=None)
@given(SIZES, st.integers(1, 200))
def test_runs_equal_packing_one_by_one(sizes, capacity):
    groups = [s for s, c in sizes.items() for _ in range(c)]
    got = best_fit(sorted(sizes.items(), reverse=True), capacity)
    assert spelt(got) == Counter(slow_best_fit(groups, capacity))


@settings(max_examples=200, deadline=None)
@given(SIZES, st.integers(1, 8))
def test_even_fit_needs_its_capacity(sizes, bins):
    runs = even_fit(list(sizes.items()), bins)
    assert {s: sum(n for size, _, n in runs if size == s) for s in sizes} == sizes
    assert all(0 <= b < bins for _, b, _ in runs)
    load, held = Counter(), Counter()
    for size, bin_, count in runs:
        load[bin_] += size * count
        held[bin_] += count
    shared = [b for b in load if held[b] > 1]
    if shared and len(load) == len(shared):
        # no bin stands for one large group: packing one by one needs this capacity
        groups = [s for s, c in sizes.items() for _ in range(c)]
        assert len(set(b for _, b in slow_best_fit(groups, max(load.values())))) <= bins


def test_a_large_group_stands_alone():
    runs = even_fit([(1_000, 1), (10, 30), (1, 30)], 4)
    load = defaultdict(int)
    for size, bin_, count in runs:
        load[bin_] += size * count
    assert load == {0: 1_000, 1: 110, 2: 110, 3: 110}
    assert even_fit([], 4) == [] and even_fit([(5, 2)], 4) == [(5, 0, 1), (5, 1, 1)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 40)), max_size=200))
def test_tree_against_a_list(steps):
    tree, plain, leaf = RoomTree(), [], sharding.LEAF
    sharding.LEAF = 4
    try:
        for i, (add, n) in enumerate(steps):
            if add:
                tree.add((n, i))
                plain.append((n, i))
            else:
                want = min((e for e in plain if e[0] >= n), default=None)
                assert tree.take_tightest(n) == want
                if want:
                    plain.remove(want)
        assert [e for leaf_ in tree.leaves for e in leaf_] == sorted(plain)
        assert tree.last == [leaf_[-1] for leaf_ in tree.leaves]
    finally:
        sharding.LEAF = leaf


def held(rows: list) -> None:
    """Slots are gapless, equal texts share a shard, every number follows from the text."""
    shards, slots = {}, defaultdict(list)
    for key, text, got in rows:
        body = (text or "").encode()
        assert (got.doc_id, got.size, got.text_crc32) == (key, len(body) + 1, zlib.crc32(body))
        assert shards.setdefault(text or "", got.shard) == got.shard
        slots[got.shard].append(got.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def matched(rows: list[tuple], got: list) -> list:
    by = defaultdict(list)
    for r in got:
        by[r.doc_id, r.size, r.text_crc32].append(r)
    return [(k, t, by[k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())].pop()) for k, t, *_ in rows]


def test_rows(spark):
    rows = [(i, "word " * (1 + i * 7 % 40) + str(i % 50), 5, "a") for i in range(120)]
    rows += [(7, "same text", 1, "b")] * 40 + [(None, None, 2, "c"), (None, "", 2, "c"), (500, "é" * 3_000, 1, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, size int, slot string")
    got = even_shards(df, 4).collect()
    assert len(got) == len(rows)
    pairs = matched(rows, got)
    held(pairs)
    total = Counter(t or "" for _, t, *_ in rows)
    sizes = Counter((len(t.encode()) + 1) * n for t, n in total.items())
    want = Counter()
    for size, bin_, count in even_fit(list(sizes.items()), 4):
        want[bin_] += size * count
    load = Counter()
    for _, _, r in pairs:
        load[r.shard] += r.size
    assert load == want and {r.shard for r in got if r.doc_id is None} == {got_shard(pairs, "")}
    by_key = sorted((r for r in got if r.shard == got[0].shard), key=lambda r: r.slot)
    assert [r.doc_id for r in by_key] == sorted((r.doc_id for r in by_key), key=lambda k: (k is not None, k))
    fixed = capacity_shards(df, 2_000).collect()
    held(matched(rows, fixed))
    load = Counter()
    for r in fixed:
        load[r.shard] += r.size
    assert len([b for b, n in load.items() if n > 2_000]) == 1 and max(load) == len(load) - 1
    assert even_shards(df.limit(0), 4).count() == 0 and capacity_shards(df.limit(0), 9).count() == 0


def got_shard(pairs: list, text: str) -> int:
    return next(r.shard for _, t, r in pairs if (t or "") == text)


def test_query(spark):
    from quillwork.llm.queries import QUERIES

    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op13_sharding"](spark, SF_DIR).collect()
    assert len(got) == len(documents)
    pairs = matched([(r.doc_id, r.text) for r in documents], got)
    held(pairs)
    load = Counter()
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None
        load[r.shard] += r.size
    assert set(load) == set(range(16)) and max(load.values()) < 1.01 * min(load.values())
