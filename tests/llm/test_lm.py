from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from quillwork.llm import lm
from quillwork.llm.lm import cross_entropy_difference


def brute(rows: list[tuple], targets: set) -> dict:
    """The same models over exact pairs."""
    texts = [(d, [w.lower() for w in (t or "").split()]) for d, t in rows]
    vocab = {w for w, _ in Counter(w for _, ws in texts for w in ws).most_common()}
    models = []
    for chosen in (texts, [x for x in texts if x[0] in targets]):
        words, contexts, pairs = Counter(), Counter(), Counter()
        for _, ws in chosen:
            words.update(ws)
            contexts.update([None, *ws[:-1]] if ws else [])
            pairs.update(zip([None, *ws], ws, strict=False))
        models.append((words, contexts, pairs, sum(words.values())))
    scale = (models[1][3] / models[0][3] if models[1][3] else 1.0, 1.0)
    out = {}
    for d, ws in texts:
        means = []
        for (words, contexts, pairs, total), s in zip(models, scale, strict=True):
            bits = 0.0
            for before, word in zip([None, *ws], ws, strict=False):
                uni = (s * words[word] + 0.5) / (s * total + 0.5 * (len(vocab) + 2))
                bits -= math.log2((s * pairs[before, word] + lm.STRENGTH * uni) / (s * contexts[before] + lm.STRENGTH))
            means.append(bits / len(ws) if ws else None)
        out[d] = (len(ws), means[1], means[0])
    return out


def test_against_exact_counts(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice("sun moon star Sea".split() if i % 2 else "ash oak elm sea".split()) for _ in range(r.randint(1, 30)))) for i in range(60)]
    rows += [(100, None), (101, "  "), (102, "unseen words only"), (103, "oak " * 30_000)]
    df = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, n_tokens string")
    targets = spark.createDataFrame([(i,) for i in range(1, 40, 2)] + [(None,), (1,), (999,)], "doc_id long")
    got = {x.doc_id: x for x in cross_entropy_difference(df, targets).collect()}
    expected = brute(rows, set(range(1, 40, 2)))
    assert set(got) == set(expected)
    for d, (n, target, background) in expected.items():
        assert got[d].n_tokens == n
        if n:
            assert got[d].ce_target == pytest.approx(target, abs=1e-3)
            assert got[d].ce_background == pytest.approx(background, abs=1e-3)
            assert got[d].ce_difference == pytest.approx(target - background, abs=2e-3)
        else:
            assert got[d].ce_target is None and got[d].ce_difference is None
    assert max(got[i].ce_difference for i in range(41, 60, 2)) < min(got[i].ce_difference for i in range(40, 60, 2))


def test_repeated_null_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c")], "doc_id long, text string")
    keys = spark.createDataFrame([(1,)], "doc_id long")
    rows = cross_entropy_difference(df, keys).collect()
    assert len(rows) == 3 and len({r.ce_target for r in rows}) == 1
    assert cross_entropy_difference(df.limit(0), keys).count() == 0
    assert cross_entropy_difference(df, keys.limit(0)).where("ce_difference is null").count() == 0


def test_more_pairs_than_two_to_the_twentieth(spark):
    """Pairs of rare words, each met once, stay apart whatever the number of pairs."""
    r = random.Random(4)
    rows = [(i, " ".join(f"w{r.randrange(400_000)}" for _ in range(12_000))) for i in range(100)]
    probe = "rare alpha rare beta rare gamma"
    rows += [(100, probe), (101, probe.replace("rare", "seldom"))]
    assert len({p for _, t in rows for p in zip(t.split(), t.split()[1:], strict=False)}) > 1 << 20
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = {x.doc_id: x for x in cross_entropy_difference(df, spark.createDataFrame([(0,), (100,)], "doc_id long")).collect()}
    expected = brute(rows, {0, 100})
    for d in (0, 1, 50, 100, 101):
        assert got[d].n_tokens == expected[d][0]
        assert got[d].ce_target == pytest.approx(expected[d][1], abs=1e-6)
        assert got[d].ce_background == pytest.approx(expected[d][2], abs=1e-6)


def test_pairs_are_not_moved_one_by_one(spark):
    """Pairs met once, the most a corpus can have, cost less room on their way than rows of their own would."""
    r = random.Random(7)
    rows = [(i, " ".join(f"w{r.randrange(20_000)}" for _ in range(4_000))) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).localCheckpoint()
    moved = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = moved()
    assert cross_entropy_difference(df, spark.createDataFrame([(0,)], "doc_id long")).where("n_tokens = 4000").count() == 100
    assert moved() - before < 30 * 400_000


@pytest.mark.parametrize("size", [1, 3_000])
def test_any_cut_into_blocks_and_buckets(spark, monkeypatch, size):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice("abcdefghij") * r.randint(1, 3) for _ in range(r.randint(0, 60)))) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keys = spark.createDataFrame([(i,) for i in range(0, 80, 3)], "doc_id long")
    whole = sorted(cross_entropy_difference(df, keys).collect(), key=lambda x: x.doc_id)
    monkeypatch.setattr(lm, "BLOCK_BYTES", size)
    monkeypatch.setattr(lm, "BUCKET_BYTES", size)
    assert sorted(cross_entropy_difference(df, keys).collect(), key=lambda x: x.doc_id) == whole
