from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from quillwork.llm.rules import RULES, estimate_rules, order_rules, quality_cascade, sample_rows

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_capitals", "n_repeat_words")


def plain(text: str | None) -> dict:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_capitals": sum(c.isupper() for c in text if ord(c) < 0x250),
        "n_repeat_words": len(inside),
    }


def verdict(f: dict) -> bool:
    w = f["n_words"]
    return not (
        w < 10 or 100 * f["n_repeat_words"] > 20 * w or 10 * f["n_symbols"] > 2 * w or 10 * f["n_capitals"] > 4 * f["word_chars"]
        or 20 * f["n_dup_lines"] > w or f["word_chars"] < 2 * w or f["word_chars"] > 15 * w
    )


def texts() -> list:
    r = random.Random(6)
    vocab = ["sun", "Moon", "é", "#tag", "a|b", "STAR!!", "x\x85y", "😀"]
    out = [" ".join(r.choice(vocab) + r.choice(["", "\n", "\t", "\x0b"]) for _ in range(r.randint(0, 60))) for _ in range(150)]
    out += [None, "", " \n\t", "a b c d e a b c d e", "a a a a a a a", "one\none\n\n \none", "word " * 20_000, "same line\r\nsame line\nsame line"]
    return out


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts())], "doc_id long, text string, kept string")


def test_features_and_verdict(documents):
    rows = {r.doc_id: r for r in quality_cascade(documents, features=FEATURES).collect()}
    assert len(rows) == len(texts())
    for i, text in enumerate(texts()):
        expected = plain(text)
        assert {f: rows[i][f] for f in FEATURES} == expected, text
        assert rows[i].kept == verdict(expected) == (rows[i].rejected_by is None)


def test_the_order_changes_only_the_reason(documents):
    names = [rule.name for rule in RULES]
    verdicts = []
    for order in (names, names[::-1]):
        judged = quality_cascade(documents, order=order)
        assert judged.columns == ["doc_id", "text", "rejected_by", "kept"]
        verdicts.append({r.doc_id: r.kept for r in judged.collect()})
    assert verdicts[0] == verdicts[1]


def test_estimates_put_cheap_rejections_first(documents):
    found = {name: (share, cost) for name, share, cost in estimate_rules(sample_rows(documents, "text", 40), "text")}
    assert set(found) == {rule.name for rule in RULES} and all(0 <= s <= 1 and c > 0 for s, c in found.values())
    assert order_rules([("a", 0.1, 1.0), ("b", 0.1, 0.1), ("c", 0.0, 0.01), ("d", 0.9, 1.0)]) == ["b", "d", "a", "c"]


def test_repeated_rows_and_no_rows(documents):
    twice = documents.union(documents)
    assert quality_cascade(twice, order=[r.name for r in RULES]).count() == 2 * len(texts())
    assert quality_cascade(documents.limit(0)).count() == 0
