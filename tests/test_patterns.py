from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillwork.operators import patterns
from quillwork.operators.joins import missing_docs
from quillwork.operators.patterns import Finder, names_inside

WORDS = st.text("ab é", min_size=1, max_size=4)


@settings(max_examples=300, deadline=None)
@given(st.sets(WORDS, max_size=12), st.lists(st.text("ab é", max_size=12), max_size=8))
def test_finder_against_in(names, texts):
    finder = Finder(sorted(names))
    seen: list[str] = []
    for text in texts:
        fresh = finder.read(text)
        assert set(fresh) == {n for n in names if n in text} - set(seen)
        seen += fresh
    assert len(seen) == len(set(seen))


@pytest.mark.parametrize("chars", [5, 60, 1_000_000])
def test_names_in_shards(spark, monkeypatch, chars):
    monkeypatch.setattr(patterns, "SHARD_CHARS", chars)
    texts = [(f"text {i} of module{i % 40} and {'x' * i}", None if i % 3 else f"heading {i}") for i in range(300)]
    names = [(n,) for n in ["module7", "module39", "module40", "odule3", "", None, "heading 297", "heading 298", "x" * 299, "x" * 300]]
    names += [(f"name{i}",) for i in range(50)] + [("module7",)]
    df = spark.createDataFrame(texts, "a string, `b.c` string")
    got = [r.token for r in names_inside(spark.createDataFrame(names, "token string"), df).collect()]
    want = {n for (n,) in names if n and any(n in t for row in texts for t in row if t)}
    assert sorted(got) == sorted(want)


def test_missing_docs_edges(spark):
    docs = spark.createDataFrame([("Ä Guide to ALPHA", None), (None, "beta.md"), ("", "")], "t string, f string")
    names = spark.createDataFrame([("alpha", 1), ("Beta", 2), ("ä g", 3), ("gamma", 4), ("gamma", 4), ("", 5), (None, 6)], "name string, n int")
    assert [tuple(r) for r in missing_docs(names, docs, ["t", "f"]).collect()] == [("gamma", 4)] * 2
    assert missing_docs(names.limit(0), docs, ["t"]).count() == 0
    assert missing_docs(names, docs.limit(0), ["t", "f"]).count() == 5
