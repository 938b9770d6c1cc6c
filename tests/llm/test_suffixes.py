from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from quillwork.llm import suffixes
from quillwork.llm.suffixes import LENGTH, cut_spans, drop_repeats, repeat_digests, suffix_arrays


def plain(rows: list[tuple]) -> dict:
    """Every window in order of (key, start); removed if its bytes were met before."""
    met, out = set(), {}
    for key, text in sorted({(k, t or "") for k, t in rows if k is not None}):
        raw = text.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - LENGTH + 1):
            window = raw[i : i + LENGTH]
            if window in met:
                gone[i : i + LENGTH] = b"\1" * LENGTH
            met.add(window)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[key] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed: int) -> list[tuple]:
    r = random.Random(seed)
    text = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    passages = [text(n) for n in (90, 101, 150, 400, 900)]
    rows = []
    for i in range(60):
        parts = [text(r.randint(0, 300))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            if r.random() < 0.5:
                at = r.randrange(len(p))
                p = p[:at] + r.choice("xyz") + p[at + 1 :]
            parts += [p, text(r.randint(0, 120))]
        rows.append((i, "".join(parts)))
    rows += [(100, "ab" * 400), (101, "abc" * 150), (102, "z" * 1000), (103, "z" * 99), (104, rows[3][1])]
    r.shuffle(rows)
    return rows


def results(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: tuple(r)[1:] for r in repeat_digests(df).collect()}


@pytest.mark.parametrize("lane", [suffixes.LANE, 3])
def test_against_all_windows(spark, monkeypatch, lane):
    monkeypatch.setattr(suffixes, "LANE", lane)
    rows = corpus(4)
    assert results(spark, rows) == plain(rows)


def test_hard_rows(spark):
    r = random.Random(9)
    long = "".join(r.choice("abcd ") for _ in range(200_000))
    rows = [(1, None), (2, ""), (3, long), (4, "é" * 120), (5, "x" + "é" * 120), (6, long[5000:9000]), (7, long[:99])]
    assert results(spark, rows) == plain(rows)
    rows = [(1, long[:500]), (1, long[:500]), (None, long[:500]), (2, long[:500])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, low string")
    got = repeat_digests(df).collect()
    assert len(got) == 4
    assert {r.n_removed for r in got if r.doc_id in (1, None)} == {0} and [r.n_removed for r in got if r.doc_id == 2] == [500]
    left = drop_repeats(df)
    assert left.columns == df.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "1", "None"]
    assert repeat_digests(df.limit(0)).count() == 0 and drop_repeats(df.limit(0)).count() == 0


def test_suffix_arrays_of_many_texts():
    r = random.Random(1)
    for _ in range(60):
        texts = ["".join(r.choice("ab" if r.random() < 0.5 else "abc") for _ in range(r.randint(0, 40))) * r.randint(1, 3) for _ in range(5)]
        coded = [[ord(c) for c in t] + [0] for t in texts]
        lanes = np.cumsum([0] + [len(c) for c in coded])
        got = suffix_arrays(np.array(sum(coded, [])), lanes)
        for k, c in enumerate(coded):
            assert (got[lanes[k] : lanes[k + 1]] - lanes[k]).tolist() == sorted(range(len(c)), key=lambda i: c[i:])


def test_cutting():
    assert cut_spans(b"0123456789", [(2, 4), (3, 5), (5, 6), (8, 99)]) == (b"0167", 6, 2)
    assert cut_spans(b"abc", []) == (b"abc", 0, 0)


def test_only_what_may_repeat_is_ordered():
    """Stretches that share an anchor and little around it reach no suffix array; no repeated window is lost."""
    r = random.Random(6)
    text = lambda n: bytes(r.choice(b"abcdefgh ") for _ in range(n))
    pieces, lanes = [], []
    for lane in range(40):
        anchor, around = text(suffixes.GRAM), (text(68), text(68))
        for _ in range(r.randint(2, 6)):
            left, right = r.randint(0, 68), r.randint(0, 68)
            whole = text(68 - left) + around[0][68 - left :] + anchor + around[1][:right] + text(68 - right)
            low = r.randint(0, 60)
            pieces.append((lane, low, r.randint(1, 69 - low), whole, anchor))
            lanes.append(lane)
    n = np.array([p[2] for p in pieces])
    bodies = [p[3][p[1] : p[1] + p[2] + LENGTH - 1] for p in pieces]
    data = np.frombuffer(b"".join(bodies), np.uint8)
    name = lambda a: suffixes.mix(
        np.array([np.sum(suffixes._EXACT[np.frombuffer(a, np.uint8)] * suffixes._POWERS.upto(200)[0][: len(a)])], np.uint64)
    )[0]
    anchors = np.array([name(p[4]) for p in pieces], np.uint64)
    found = suffixes.may_repeat(data, np.cumsum([len(b) for b in bodies]), np.array(lanes), anchors, n)
    kept = {(i, w) for i, skip, count in zip(*(c.tolist() for c in found), strict=True) for w in range(skip, skip + count)}
    met = {}
    for i, body in enumerate(bodies):
        for w in range(n[i]):
            met.setdefault((lanes[i], body[w : w + LENGTH]), []).append((i, w))
    repeated = {place for places in met.values() if len(places) > 1 for place in places}
    assert repeated and repeated <= kept
    assert len(kept) < n.sum() / 2


def test_stretches_are_handed_on_in_small_batches():
    """Many overlapping stretches of documents that come in one batch do not leave in one."""
    r = random.Random(2)
    texts = [bytes(r.choice(b"abcdefgh ") for _ in range(n)) for n in (99, 5_000, 20_000, 150, 9_000)]
    wanted = [[{"anchor": a, "low": a % 7_000, "n": 1 + a % 69} for a in range(0, 9_000, 2)] for _ in texts]
    kind = pa.list_(pa.struct([("anchor", pa.int64()), ("low", pa.int32()), ("n", pa.int32())]))
    columns = [pa.array(range(5)), pa.array([zstandard.compress(t) for t in texts], pa.binary()), pa.array(wanted, kind)]
    batch = pa.RecordBatch.from_arrays(columns, names=["id", "body", "wanted"])
    got = list(suffixes.cut_pieces(iter([batch, batch.slice(2, 1), batch.slice(0, 0)])))
    assert sum(b.nbytes for b in got) > 2 * suffixes.PIECE_BYTES and max(b.nbytes for b in got) < 2 * suffixes.PIECE_BYTES
    rows = [tuple(x.values()) for b in got for x in b.to_pylist()]
    whole = [
        (w["anchor"], i, w["low"], w["n"], texts[i][w["low"] : w["low"] + w["n"] + LENGTH - 1])
        for i in [*range(5), 2] for w in wanted[i] if w["low"] + w["n"] + LENGTH - 1 <= len(texts[i])
    ]
    assert rows == whole
