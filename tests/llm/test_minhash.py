from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest

from quillwork.llm.components import components
from quillwork.llm.hashing import text_buffers, text_shingles, word_spans
from quillwork.llm.minhash import near_duplicates

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text: str | None) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows: list[tuple]) -> dict:
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: (len(sets[d]), top(d), top(d) == d) for d in sets}


def corpus(seed: int) -> list[tuple]:
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.choice([3, 5, 6, 40, 200]))]
        for _ in range(r.choice([1, 1, 2, 8])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                w[r.randrange(len(w))] = r.choice(vocab)
            rows.append((n, r.choice([" ", "\n", "\t "]).join(w).upper() if r.random() < 0.2 else " ".join(w)))
            n += 1
    return rows


def result(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return [tuple(r) for r in near_duplicates(df).collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    rows = corpus(seed)
    got = result(spark, rows)
    assert len(got) == len(rows)
    assert {r[0]: r[1:] for r in got} == brute(rows)


def test_hard_rows(spark):
    long = " ".join(f"v{i}" for i in range(30_000))
    chain = [" ".join(f"c{i}" for i in range(k, k + 60)) for k in range(0, 40, 4)]  # neighbours near, ends not
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE\ttwo"), (6, long), (7, long + " end"), (8, "x\x85y")]
    rows += [(10 + i, t) for i, t in enumerate(chain)]
    assert {r[0]: r[1:] for r in result(spark, rows)} == brute(rows)


def test_repeated_null_and_no_rows(spark):
    df = spark.createDataFrame(
        [(1, "a b c d e f", 0), (1, "a b c d e f", 0), (None, "a b c d e f", 1), (2, "A B C D E F", 1)],
        "doc_id long, text string, component_id long",
    )
    got = sorted((tuple(r) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (2, 2, 1, False)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0


def test_words_and_shingles_follow_the_pattern():
    texts = ["A  b\x0bc", "", None, "é ÀB\n", "one two three four five six", "x"]
    data, offsets = text_buffers(pa.array(texts))
    starts, ends, first = word_spans(data, offsets)
    raw = [bytes(data[a:b]).decode() for a, b in zip(starts, ends, strict=True)]
    assert [raw[a:b] for a, b in zip(first[:-1], first[1:], strict=True)] == [
        re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts
    ]
    grams, first = text_shingles(data, offsets)
    assert (first[1:] - first[:-1]).tolist() == [len(shingles(t)) for t in texts]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 100 for i in range(100, 160)}}
