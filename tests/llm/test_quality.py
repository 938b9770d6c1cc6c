from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quillwork.llm.hashing import text_buffers
from quillwork.llm.quality import SHARES, WIDTH, fit_quality, pooled, score_quality, train


def text_of(r: random.Random, good: bool) -> str:
    words = ["the", "of", "river", "stone", "walks", "under", "green", "light"]
    return " ".join(r.choice(words) if good else r.choice(words).upper() + "!!" for _ in range(r.randint(20, 60)))


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(3)
    rows = [(i, text_of(r, i % 3 > 0), int(i % 3 > 0)) for i in range(240)]
    documents = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", "y"), (None, "the", "z")],
                                      "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if i % 2] + [(None, 1), (5, None), (999, 1), (1, 1)], "doc_id long, quality int")
    return documents, labels, rows


def test_held_out_accuracy_and_probabilities(tables):
    documents, labels, rows = tables
    model = fit_quality(documents, labels)
    got = {r.doc_id: r.score for r in score_quality(documents, model).collect()}
    assert len(got) == 243 and all(0 <= s <= 1 for s in got.values())
    hits = [(got[i] >= 0.5) == bool(q) for i, _, q in rows if i % 2 == 0]
    assert np.mean(hits) > 0.95
    assert got[900] == got[901]  # null is the empty text


def test_the_model_does_not_depend_on_row_order(tables):
    documents, labels, _ = tables
    one = fit_quality(documents, labels)
    two = fit_quality(documents.repartition(7), labels.repartition(3))
    assert np.array_equal(one.vectors, two.vectors)
    assert np.array_equal(one.network.w1, two.network.w1) and one.network.temperature == two.network.temperature


def test_no_labels_and_no_documents(tables):
    documents, labels, _ = tables
    model = fit_quality(documents.limit(0), labels.limit(0))
    assert score_quality(documents.limit(0), model).count() == 0
    assert {r.score for r in score_quality(documents, model).collect()} == {0.5}
    only = train(np.random.default_rng(1).normal(size=(5, 4)), np.ones(5, int))
    assert only.score(np.zeros((1, 4)))[0] > 0.8


def test_a_long_text_pools_like_its_parts():
    text = "alpha beta gamma delta " * 40_000
    vectors = np.random.default_rng(1).normal(size=(1 << 13, WIDTH)).astype(np.float32)
    rows = pooled(vectors, *text_buffers(pa.array([text, "alpha beta gamma delta", None])))
    assert rows.shape == (3, 2 * WIDTH + SHARES)
    assert np.allclose(rows[0, : 2 * WIDTH], rows[1, : 2 * WIDTH], atol=1e-2)
    assert not rows[2].any()


def test_pooling_takes_few_bytes_a_word():
    """The vectors of all words of a piece of text are never laid out at once."""
    texts = pa.array(["alpha beta gamma delta " * 500] * 50)
    data, offsets = text_buffers(texts)
    vectors = np.ones((1 << 13, WIDTH), np.float32)
    whole = pooled(vectors, data, offsets)
    tracemalloc.start()
    rows = pooled(vectors, data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000 * 2 * WIDTH * 4
    assert np.array_equal(rows, whole) and np.array_equal(rows[0], rows[49])
