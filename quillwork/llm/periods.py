"""Runs of words that repeat with a period, by a dictionary of basic factors.

Level k of the dictionary numbers the factors of 2**k words; only factors that
their text has again are kept, so prose leaves the dictionary after a few levels.
Where a factor occurs again within twice its length, the distance is a proposed
period: neighbouring places with the same distance are one progression, which is
extended to both sides by the levels of the dictionary, longest first. The same
run can be proposed on several levels and is kept once.

A run of period q has at least 4q words. On the level whose factors are the
shortest of q or more words, the next occurrence of the run's first factor is q
away, since a nearer one would give the run a smaller period. So no run is missed,
and the distance to the next occurrence is always the smallest period.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 4_000_000  # text bytes searched together; a longer text is searched alone
LEAST_WORDS = 6
LEAST_POWER = 4

Arrange = Callable[[object, list[bytes]], list[bytes]]


def factor_levels(code: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
    """Level k: a number for the 2**k words from each place on, -1 if its text has them once or ends before.

    `code` numbers the words, `text` the texts, in order. Numbers are of one text, so
    equal numbers mean equal factors of the same text.
    """
    n = code.size
    levels: list[np.ndarray] = []
    place = np.arange(n)
    key = text.astype(np.int64) * (int(code.max()) + 1) + code if n else np.empty(0, np.int64)
    while place.size:
        _, name, count = np.unique(key, return_inverse=True, return_counts=True)
        again = count[name] > 1
        place, name = place[again], name[again]
        if not place.size:
            break
        level = np.full(n, -1, np.int32 if n < 1 << 31 else np.int64)
        level[place] = name
        half = 1 << len(levels)
        levels.append(level)
        place = place[place + half < n]
        place = place[(level[place + half] >= 0) & (text[place] == text[place + half])]
        key = level[place].astype(np.int64) * n + level[place + half]
    return levels


def _proposals(level: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first place, distance) of each progression of places whose factor occurs again at most `most` words later."""
    place = np.flatnonzero(level >= 0)
    place = place[np.argsort(level[place], kind="stable")]
    distance = np.diff(place)
    near = (level[place[1:]] == level[place[:-1]]) & (distance <= most)
    at, distance = place[:-1][near], distance[near]
    order = np.argsort(at, kind="stable")
    at, distance = at[order], distance[order]
    head = np.ones(at.size, bool)
    head[1:] = (np.diff(at) != 1) | (np.diff(distance) != 0)
    return at[head], distance[head]


def _extend(levels: list[np.ndarray], at: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the longest stretch around each place whose words equal those `distance` later."""
    n = levels[0].size
    right, left = at.copy(), at.copy()
    for k in range(len(levels) - 1, -1, -1):
        level, step = levels[k], 1 << k
        can = np.flatnonzero(right + distance < n)
        here, there = level[right[can]], level[right[can] + distance[can]]
        right[can[(here >= 0) & (here == there)]] += step
        can = np.flatnonzero(left >= step)
        here, there = level[left[can] - step], level[left[can] - step + distance[can]]
        left[can[(here >= 0) & (here == there)]] -= step
    return left, right + distance


def runs_of(code: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, smallest period) of every run, by start and period; starts count from the first text."""
    levels = factor_levels(code, text)
    found = [np.empty((0, 3), np.int64)]
    for k, level in enumerate(levels):
        at, period = _proposals(level, 2 << k)
        start, end = _extend(levels, at, period)
        long = end - start >= np.maximum(LEAST_WORDS, LEAST_POWER * period)
        found.append(np.stack([start, period, end - start], axis=1)[long])
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[:, 0], rows[:, 2], rows[:, 1]


def _chunks(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or b"")
        if size >= CHUNK_BYTES:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _searched(
    keys: list, texts: list[bytes | None], arrange: Arrange | None
) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
    """(row, its runs as rows of start, length and period, its words without repeats) of every text, in order."""
    for first, end in _chunks(texts):
        # bytes.split() cuts at \x20 and \x09-\x0D, at nothing else
        words = [(t or b"").split() for t in texts[first:end]]
        if arrange:
            words = [arrange(key, ws) if ws else ws for key, ws in zip(keys[first:end], words, strict=True)]
        count = np.array([len(ws) for ws in words], np.int64)
        base = np.concatenate([[0], np.cumsum(count)])
        flat = pa.array([w for ws in words for w in ws], pa.large_binary()).dictionary_encode()
        code = np.asarray(flat.indices, dtype=np.int64)
        start, length, period = runs_of(code, np.repeat(np.arange(end - first), count))
        edge = np.zeros(base[-1] + 1, np.int64)
        np.add.at(edge, start + period, 1)
        np.add.at(edge, start + length, -1)
        kept = np.cumsum(edge[:-1]) == 0
        row_of = np.searchsorted(start, base)
        for i, ws in enumerate(words):
            a, b = row_of[i], row_of[i + 1]
            runs = np.stack([start[a:b] - base[i], length[a:b], period[a:b]], axis=1)
            yield first + i, runs, ws if a == b else list(compress(ws, kept[base[i] : base[i + 1]]))


def _rows(df: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    rows = df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").cast("binary"))
    return rows, f"`{key}` {df.schema[key].dataType.simpleString()}"


def periodic_runs(df: DataFrame, key: str = "doc_id", text: str = "text", arrange: Arrange | None = None) -> DataFrame:
    """Key, `runs` (array of start, length, period) and `collapsed` (the text's words without repeats) of every row.

    A run is a stretch of consecutive words with smallest period q and at least
    max(6, 4q) words that cannot be longer; runs come by start, then period. A word is
    left out of `collapsed` if any run holds it after that run's first q words; kept
    words are joined by a blank. `arrange(key, words)` may rearrange the words first.

    Rows are independent: repeated rows give repeated results, a null key stays null.
    Null, empty and blank texts have no runs and an empty `collapsed`. Other columns
    are left out; no rows give none. Memory follows the longest text.
    """
    rows, head = _rows(df, key, text)
    kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, collapsed = [], []
            for _, found, words in _searched(batch.column(0).to_pylist(), batch.column(1).to_pylist(), arrange):
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found.tolist()])
                collapsed.append(b" ".join(words))
            columns = [batch.column(0), pa.array(runs, kind), pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "runs", "collapsed"])

    return rows.mapInArrow(run, f"{head}, runs array<struct<start long, length long, period long>>, collapsed string")


def strongest(runs: list[list[int]]) -> tuple[int, int, int] | None:
    """The run of greatest exact length over period; of equal ones the first, then the one of smallest period."""
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    return tuple(best) if best else None


def run_digests(df: DataFrame, key: str = "doc_id", text: str = "text", arrange: Arrange | None = None) -> DataFrame:
    """Number of runs, the strongest one, and digests of all runs and of the collapsed text; else as `periodic_runs`.

    `start`, `length`, `period` and `exponent_milli` (floor of 1000 length / period) are null without a run.
    """
    rows, head = _rows(df, key, text)
    numbers = ["n_runs", "start", "length", "period", "exponent_milli"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, listed, collapsed = [], [], []
            for _, found, words in _searched(batch.column(0).to_pylist(), batch.column(1).to_pylist(), arrange):
                runs = found.tolist()
                best = strongest(runs)
                out.append((len(runs), *(*best, 1000 * best[1] // best[2])) if best else (0, None, None, None, None))
                listed.append(hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest())
                collapsed.append(hashlib.sha256(b" ".join(words)).hexdigest())
            columns = [pa.array([o[i] for o in out], pa.int64()) for i in range(len(numbers))]
            columns += [pa.array(listed, pa.string()), pa.array(collapsed, pa.string())]
            names = [key, *numbers, "runs_sha256", "collapsed_sha256"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    fields = ", ".join(f"{n} long" for n in numbers)
    return rows.mapInArrow(run, f"{head}, {fields}, runs_sha256 string, collapsed_sha256 string")


def tail_repeated(key: object, words: list[bytes]) -> list[bytes]:
    """One text in ten with the words after some place repeated with a period; both follow from its key's checksum."""
    if key is None:
        return words
    hashed = zlib.crc32(str(key).encode())
    if hashed % 10:
        return words
    g, n = hashed // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]
