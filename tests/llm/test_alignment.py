from __future__ import annotations

import hashlib
from collections import Counter

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillwork.llm import alignment
from quillwork.llm.alignment import BYTE_VOCABULARY, PIECE_VOCABULARY, Aligned, aligned_texts, byte_side, cross_tokens, piece_side, vocabulary
from quillwork.llm.bpe import byte_symbols

SF_DIR = "/root/testdata/sf0.001"
HARD = [
    "", " ", "  ", "a", " a  b ", "Hello, World! it's  we'll\n\n  x \t y\r\n", "<|endoftext|> </s><s> <unk> <0x41>", "tab\t \tnew;\r\n}\r",
    "naïve café — “quoted” … €5", "日本語 テスト 😀👍🏽 한국어", "▁under ▁score", "a　b c᠎d\x85e\x1cf\xa0 g", "x" * 3000,
    "é é", "\x00 \x01a", "12345 1e10 #### $$$", "ﬁ ²", "Σας ǅ İ", "a​b﻿c", "word " * 2_000,
]


@pytest.fixture(scope="module")
def theirs():
    a = Tokenizer.from_file(vocabulary(BYTE_VOCABULARY))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECE_VOCABULARY))


def tokens(theirs, text: str | None) -> tuple[list, list]:
    """(id, start, end) of every token of both sides, straight from the libraries."""
    if not text:
        return [], []
    byte_of = {symbol: i for i, symbol in enumerate(byte_symbols())}
    a = [(i, bytes(byte_of[c] for c in theirs[0].id_to_token(i))) for i in theirs[0].encode(" " + text, add_special_tokens=False).ids]
    pieces = [(i, theirs[1].id_to_piece(i)) for i in theirs[1].encode(text)]
    b = [(i, bytes([int(p[3:5], 16)]) if theirs[1].is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]
    out = []
    for side in (a, b):
        if b"".join(t for _, t in side) != b" " + text.encode():
            return [], []
        at, spans = 0, []
        for i, t in side:
            spans.append((i, at, at + len(t)))
            at += len(t)
        out.append(spans)
    return tuple(out)


def slow(theirs, text: str | None) -> tuple[int, int, int, list[tuple[int, int]], str]:
    a, b = tokens(theirs, text)
    links = [(i, j) for i, s, e in a for j, u, v in b if s < v and u < e]
    groups, cuts = [], sorted({e for *_, e in a} & {e for *_, e in b})
    for start, end in zip([0, *cuts], cuts, strict=False):
        sides = [",".join(str(i) for i, s, e in side if start <= s and e <= end) for side in (a, b)]
        groups.append("|".join(sides))
    return len(a), len(b), len(groups), links, ";".join(groups)


def check(theirs, texts: list[str | None]) -> None:
    got = Aligned(texts, byte_side(BYTE_VOCABULARY), piece_side(PIECE_VOCABULARY))
    counts, groups, (pairs, times) = got.counts(), got.groups(), got.pairs()
    for row, text in enumerate(texts):
        n_a, n_b, n_groups, links, written = slow(theirs, text)
        assert tuple(int(counts[c][row]) for c in alignment.COUNTS) == (n_a, n_b, n_groups, len(links)), repr(text)
        assert groups[row] == written, repr(text)
        want = Counter(i * 32_000 + j for i, j in links)
        assert dict(zip(pairs[row].as_py(), times[row].as_py(), strict=True)) == want


def test_hard_texts(theirs):
    check(theirs, [*HARD, None])
    for text in HARD:
        check(theirs, [text])


def test_every_settled_character(theirs):
    chars = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC]]
    texts = [f"{c}a{c}{c}b {c} 1{c}2 {c}" for c in chars]
    for text in texts:
        assert byte_side(BYTE_VOCABULARY).encode(text).tolist() == theirs[0].encode(text, add_special_tokens=False).ids, repr(text)
    check(theirs, texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30) | st.text(" \n\t\rab'sé—▁<0x4>1", max_size=40), max_size=5))
def test_random_texts(theirs, texts):
    check(theirs, texts)


@pytest.mark.parametrize("sent", [1 << 18, 200, 0])
def test_rows(spark, theirs, monkeypatch, sent):
    monkeypatch.setattr(alignment, "SENT_PAIRS", sent)
    monkeypatch.setattr(alignment, "PARTIAL_PAIRS", 50)
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 400)
    words = "the quick brown fox unbelievably jumps over tokenization naïveté misalignments".split()
    texts = [" ".join(words[(i * j) % len(words)] for j in range(1, 2 + i % 9)) for i in range(40)]
    rows = [(i % 37, t, "x", 5) for i, t in enumerate(texts)] + [(None, None, "g", 1), (None, "the fox", "g", 1), (3, "", "p", 2)]
    rows += [(900 + i, t, "h", 3) for i, t in enumerate(HARD)] + [(900, "the fox", "r", 4)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, groups string, n_best int")
    solved = [(key, *slow(theirs, text)) for key, text, *_ in rows]
    held = Counter(p for *_, links, _ in solved for p in set(links))
    highest = {}
    for (i, _), n in held.items():
        highest[i] = max(n, highest.get(i, 0))
    want = []
    for key, n_a, n_b, n_groups, links, written in solved:
        best = sum(held[p] == highest[p[0]] for p in links)
        digest = hashlib.sha256(written.encode()).hexdigest() if written else ""
        want.append((key, n_a, n_b, n_groups, len(links), digest, best, sum(held[p] for p in links)))
    got = cross_tokens(df)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    if sent == 200:
        assert cross_tokens(df.limit(0)).count() == 0
        plain = {r.doc_id: r for r in aligned_texts(df).where("doc_id > 900").collect()}
        assert plain[900 + 3].groups == slow(theirs, HARD[3])[-1]


def test_query_against_the_libraries(spark, theirs):
    from quillwork.llm.queries import QUERIES

    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in QUERIES["op12_cross_tokenizer_alignment"](spark, SF_DIR).collect()}
    assert len(got) == len(documents)
    links = {r.doc_id: links_of(*tokens(theirs, r.text)) for r in documents}
    held = Counter(p for each in links.values() for p in set(each))
    highest = {}
    for (i, _), n in held.items():
        highest[i] = max(n, highest.get(i, 0))
    for r in documents:
        row, each = got[r.doc_id], links[r.doc_id]
        assert row.n_links == len(each) and row.count_sum == sum(held[p] for p in each)
        assert row.n_best == sum(held[p] == highest[p[0]] for p in each)


def links_of(a: list, b: list) -> list[tuple[int, int]]:
    """Overlaps of two token lists over the same bytes, with two pointers."""
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        out.append((a[i][0], b[j][0]))
        end_a, end_b = a[i][2], b[j][2]
        i, j = i + (end_a <= end_b), j + (end_b <= end_a)
    return out
