from __future__ import annotations

import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillwork.llm import periods
from quillwork.llm.periods import periodic_runs, run_digests, runs_of, strongest, tail_repeated

SF_DIR = "/root/testdata/sf0.001"


def slow_runs(words: list) -> list[tuple[int, int, int]]:
    """Every period tried at every place."""
    n, found, taken = len(words), [], set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any(words_have_period(words[i : i + length], p) for p in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    for run in found:
        assert run not in taken
        taken.add(run)
    return sorted(found, key=lambda r: (r[0], r[2]))


def words_have_period(words: list, p: int) -> bool:
    return all(words[i] == words[i + p] for i in range(len(words) - p))


def fast_runs(texts: list[list]) -> list[list[tuple[int, int, int]]]:
    names = {w: i for i, w in enumerate({w for t in texts for w in t})}
    code = np.array([names[w] for t in texts for w in t], np.int64)
    count = np.array([len(t) for t in texts])
    start, length, period = runs_of(code, np.repeat(np.arange(len(texts)), count))
    base = np.concatenate([[0], np.cumsum(count)])
    out = [[] for _ in texts]
    for s, n, q in zip(start.tolist(), length.tolist(), period.tolist(), strict=True):
        at = int(np.searchsorted(base, s, side="right")) - 1
        out[at].append((s - int(base[at]), n, q))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=40) | st.lists(st.sampled_from("abc"), max_size=60), min_size=1, max_size=4))
def test_runs_of_random_texts(texts):
    assert fast_runs(texts) == [slow_runs(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(
    st.lists(
        st.tuples(st.lists(st.sampled_from("abcd"), min_size=1, max_size=9), st.integers(1, 9), st.integers(0, 4)), max_size=4
    )
)
def test_runs_of_repeated_blocks(blocks):
    text = [w for block, times, more in blocks for w in (block * times)[: len(block) * times - more]]
    assert fast_runs([text, text[::-1]]) == [slow_runs(text), slow_runs(text[::-1])]


def test_fibonacci_words_and_one_word():
    a, b = "a", "ab"
    while len(b) < 300:
        a, b = b, b + a
    texts = [list(b), ["x"] * 500, list("ab" * 3), list("aaaaa"), list("aaaaaa"), []]
    got = fast_runs(texts)
    assert got == [slow_runs(t) for t in texts]
    assert got[1] == [(0, 500, 1)] and got[2] == [] and got[3] == [] and got[4] == [(0, 6, 1)]


def test_strongest_breaks_ties():
    assert strongest([]) is None
    assert strongest([[5, 8, 2], [1, 12, 3], [0, 7, 1]]) == (0, 7, 1)
    assert strongest([[5, 8, 2], [1, 12, 3], [1, 4, 1]]) == (1, 4, 1)


def slow_row(key, text):
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text or "").split(" ") if w]
    n = len(words)
    if key is not None and n:
        h = zlib.crc32(str(key).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (
        key, len(runs), *best, best[1] and 1000 * best[1] // best[2],
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(),
    )


def test_rows(spark, monkeypatch):
    planted = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:12]
    rows = [(i, "one two three four\tfive six\nseven eight nine ten " * 3 + "x y " * (i % 7), "r", i) for i in planted]
    rows += [(None, None, "a", 1), (None, "na na na na na na batman", "b", 1), (401, "", "c", 1), (402, " \n\t ", "c", 1)]
    rows += [(403, "tick tock " * 900, "d", 2), (403, "tick tock " * 900, "d", 2), (404, "é é é é " * 4, "e", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, start int")
    monkeypatch.setattr(periods, "CHUNK_BYTES", 500)
    got = sorted(map(tuple, run_digests(df, arrange=tail_repeated).collect()), key=str)
    assert got == sorted((slow_row(key, text) for key, text, *_ in rows), key=str)
    full = {r.doc_id: r for r in periodic_runs(df).where("doc_id is not null").collect()}
    assert full[403].collapsed == "tick tock" and [tuple(r) for r in full[403].runs] == [(0, 1800, 2)]
    assert full[401].runs == [] and full[402].collapsed == ""
    assert run_digests(df.limit(0)).count() == 0 and periodic_runs(df.limit(0)).count() == 0


def test_query_against_loops(spark):
    from quillwork.llm.queries import QUERIES

    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: r.text for r in documents if len(r.text or "") < 2_500}
    got = {r.doc_id: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, SF_DIR).collect()}
    assert len(got) == len(documents) and len(short) > 50
    for key, text in short.items():
        assert got[key] == slow_row(key, text)
