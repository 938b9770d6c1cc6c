from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from quillwork.llm import paragraphs
from quillwork.llm.hashing import set_digest, text_buffers
from quillwork.llm.paragraphs import paragraphs_of, repeated_passages, tune_bands, without_passages

VOCAB = [f"w{i}" for i in range(500)]


def prose(r: random.Random, n: int) -> str:
    words = [r.choice(VOCAB) + ("." if r.random() < 0.12 else "") for _ in range(n)]
    return " ".join(words)


def sets_of(text: str) -> list[tuple]:
    """(first byte, end byte, shingles) of the paragraphs, shingles taken word by word."""
    raw = text.encode()
    _, a, b, starts, ends, *_ = paragraphs_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    out = []
    for x, y in zip(a, b, strict=True):
        low, high = int(starts[x]), int(ends[y - 1])
        w = raw[low:high].decode().lower().split()
        out.append((low, high, frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))))
    return out


def brute(rows: list[tuple]) -> set:
    items = [(d, low, high, s) for d, t in rows for low, high, s in sets_of(t or "")]
    root = list(range(len(items)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(items):
        for j in range(i):
            b = items[j]
            if 100 * len(a[3] & b[3]) >= 75 * len(a[3] | b[3]):
                root[top(i)] = top(j)
    first: dict = {}
    for i, a in enumerate(items):
        first[top(i)] = min(first.get(top(i), a[0]), a[0])
    return {(a[0], a[1], a[2], first[top(i)]) for i, a in enumerate(items) if a[0] != first[top(i)]}


def corpus() -> list[tuple]:
    r = random.Random(8)
    passages = [prose(r, n) for n in (60, 80, 200)]
    rows = []
    for i in range(50):
        text = prose(r, r.randint(5, 150))
        if i % 3 == 0:
            words = r.choice(passages).split()
            if r.random() < 0.5:
                words[r.randrange(len(words))] = r.choice(VOCAB)
            text += r.choice([" ", "\n"]) + " ".join(words) + " " + prose(r, r.randint(0, 60))
        rows.append((i, text))
    return rows


def test_against_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(x) for x in repeated_passages(df).collect()}
    expected = brute(rows)
    assert len(got & expected) >= 0.97 * len(expected) and got <= expected
    assert all(d % 3 == 0 for d, *_ in got)  # documents without a passage are left alone


def test_passages_inside_a_line_are_found():
    r = random.Random(3)
    passage = prose(r, 70)
    texts = [prose(r, 40) + " " + passage + " " + prose(r, 40), prose(r, 33) + " " + passage]
    sets = [{s for *_, s in sets_of(t)} for t in texts]
    assert sets[0] & sets[1]


def test_paragraphs_do_not_depend_on_neighbouring_texts():
    texts = [t for _, t in corpus()] + ["", None, "short. text", "no stop " * 30_000]
    data, offsets = text_buffers(pa.array(texts))
    text, a, b, starts, ends, *_ = paragraphs_of(data, offsets)
    got = {(int(t), int(starts[x] - offsets[t]), int(ends[y - 1] - offsets[t])) for t, x, y in zip(text, a, b, strict=True)}
    assert got == {(i, low, high) for i, t in enumerate(texts) for low, high, _ in sets_of(t or "")}


def test_hard_rows(spark):
    r = random.Random(5)
    passage = prose(r, 90)
    rows = [(1, None), (2, ""), (3, passage), (3, passage), (None, passage), (4, "x. " + passage), (5, passage * 300)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, low long")
    got = without_passages(df).collect()
    assert len(got) == len(rows)
    removed = {x.doc_id: x.n_removed for x in got}
    assert removed[1] == removed[2] == removed[3] == removed[None] == 0 and removed[4] > 0
    assert {tuple(x.first_docs) for x in got if x.doc_id == 4} == {(3,)}
    assert without_passages(df.limit(0)).count() == 0


def test_bands_are_tuned():
    assert 1 - (1 - 0.75**2) ** tune_bands(75, 0.99, 2) >= 0.99 > 1 - (1 - 0.75**2) ** (tune_bands(75, 0.99, 2) - 1)


def test_every_word_of_a_long_enough_text_is_in_a_paragraph():
    r = random.Random(6)
    texts = [" ".join(r.choice(VOCAB) for _ in range(n)) + stop for n in (20, 21, 45, 300) for stop in ("", " End.", ". A. B")]
    texts += [prose(r, n) for n in (20, 33, 90, 400)] + ["One two. " + "long " * 40 + "end."]
    for text in texts:
        covered = set()
        for low, high, _ in sets_of(text):
            covered.update(range(low, high))
        assert all(i in covered for i, c in enumerate(text) if c != " "), text


def test_planted_passages_at_any_place(spark):
    """Words of passages in both of two texts, found without asking where paragraphs lie."""
    r = random.Random(9)
    rows, planted = [], {}
    for i in range(60):
        stops = r.choice([0.0, 0.03, 0.12])
        fresh = lambda n, i=i: " ".join(f"{r.choice('abcdefg')}{i}x{r.randrange(400)}" + ("." if r.random() < stops else "") for _ in range(n))
        passage = fresh(r.randint(51, 80)).rstrip(".") + " "
        for k in (0, 1):
            before = fresh(r.randint(0, 90)) + " " if r.random() < 0.8 else ""
            text = before + passage + (fresh(r.randint(1, 90)).replace("x", "y") if r.random() < 0.8 else "")
            rows.append((2 * i + k, text.replace("x", "z", before.count("x")) if k else text))
            planted[2 * i + k] = passage
    got = {x.doc_id: x for x in without_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lost = 0
    for doc, text in rows:
        words = planted[doc].split()
        left = got[doc].kept.split()
        if doc % 2 == 0:
            assert got[doc].kept == text
            continue
        assert got[doc].first_docs == [doc - 1]
        still = sum(w in set(left) for w in words)
        assert still <= 20, (doc, still)
        lost += still / len(words)
    assert lost / 60 < 0.2


def test_paragraphs_are_named_by_their_sets(monkeypatch):
    """Side by side as one by one, whatever is sorted together; so equal sets get their bands once."""
    monkeypatch.setattr(paragraphs, "BLOCK", 7)
    data, offsets = text_buffers(pa.array([t for _, t in corpus()] + ["same " * 40]))
    _, a, b, _, _, hashes, first = paragraphs_of(data, offsets)
    grams = paragraphs._shingle_ranges(hashes, first)
    one, two = paragraphs._digests(grams, a, b)
    whole = [set_digest(np.unique(grams[x : y - 4])) for x, y in zip(a, b, strict=True)]
    assert len(whole) > len(set(whole)) > 7 and list(zip(one.tolist(), two.tolist(), strict=True)) == whole


def test_sets_of_one_text_are_compared_by_their_places():
    """With repeated shingles too; texts have nothing to do with each other, and what lies far apart is no longer to reduce."""
    r = random.Random(12)
    passage = prose(r, 60)
    texts = [prose(r, 200), "", passage + " " + prose(r, 30) + " " + passage.replace("w1", "x1"), "a b c d e f g " * 30, passage]
    data, offsets = text_buffers(pa.array(texts))
    text, a, b, _, _, hashes, first = paragraphs_of(data, offsets)
    grams = paragraphs._shingle_ranges(hashes, first)
    sets = [frozenset(grams[x : y - 4].tolist()) for x, y in zip(a, b, strict=True)]
    known = {s: i for i, s in reversed(list(enumerate(sets)))}
    head = np.array(sorted(known.values()))
    member = np.searchsorted(head, [known[s] for s in sets])
    one_band = np.zeros((head.size, 1), np.uint64)
    got = paragraphs._within_texts(grams, a[head], b[head], one_band, text, member, 75)
    links = [
        (member[i], member[j]) for i in range(a.size) for j in range(i)
        if text[i] == text[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])
    ]
    assert got.tolist() == paragraphs._least(head.size, *np.array(links).T).tolist()
    assert 1 < len(set(got.tolist())) < head.size


def test_only_texts_without_a_text_in_common_send_bands(spark, monkeypatch):
    """Whole copies are compared in one text; bands of very many sets are dealt out, with the same result."""
    sent = []
    real = paragraphs._band_links
    monkeypatch.setattr(paragraphs, "_band_links", lambda rows, percent: sent.append(rows.count()) or real(rows, percent))
    text = prose(random.Random(4), 300)
    copies = spark.createDataFrame([(i, text) for i in range(6)], "doc_id long, text string").repartition(3)
    got = without_passages(copies).collect()
    assert sent == [0] and {x.doc_id: x.n_removed for x in got} == {i: len(text) if i else 0 for i in range(6)}
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    want = set(repeated_passages(df).collect())
    monkeypatch.setattr(paragraphs, "MEMBERS", 2)
    assert set(repeated_passages(df).collect()) == want and sent[1] > sent[2]


def test_links_of_a_band_grow_with_its_sets(spark):
    """Chains and large groups of near sets: what they connect is connected, by fewer links than there are sets."""
    r = random.Random(15)
    base = [r.sample(range(10_000), 40) for _ in range(3)]
    grams = [sorted({*base[0][: 40 - i % 4], *r.sample(range(10_000), i % 4)}) for i in range(120)]  # all near to each other
    grams += [sorted(base[1][i % 30 :] + base[2][: i % 30]) for i in range(60)]  # near to the next ones only
    rows = [(0, i % 2 if i < 120 else 2, i // 3, 1_000 + i // 2, g) for i, g in enumerate(grams)]
    df = spark.createDataFrame(rows, "part int, bucket long, text long, root long, grams array<long>")
    got = [tuple(x) for x in paragraphs._band_links(df, 75).collect()]
    roots = sorted({x[3] for x in rows})
    at = {x: i for i, x in enumerate(roots)}
    links = [
        (at[x[3]], at[y[3]]) for i, x in enumerate(rows) for y in rows[:i]
        if x[1] == y[1] and x[2] != y[2] and 100 * len({*x[4]} & {*y[4]}) >= 75 * len({*x[4]} | {*y[4]})
    ]
    want = paragraphs._least(len(roots), *np.array(links).T).tolist()
    assert paragraphs._least(len(roots), *np.array([(at[a], at[b]) for a, b in got]).T).tolist() == want
    assert len(got) < len(roots) < len(links) / 10
