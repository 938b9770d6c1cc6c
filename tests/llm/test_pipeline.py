from __future__ import annotations

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from corpus_pipeline import STAGES, cut_repeats, drop_near_duplicates, drop_poor, encode, mix_languages, run
from quillwork.llm.suffixes import LENGTH
from tests.llm.test_minhash import brute

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def test_stages_are_named_and_ordered():
    assert [f for _, f in STAGES] == [drop_poor, drop_near_duplicates, cut_repeats, mix_languages, encode]


def test_poor_documents_go_and_clean_ones_stay(spark, documents):
    kept = drop_poor(spark, documents, DIR)
    assert kept.columns == documents.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    marked = {r.doc_id: r.quality for r in spark.read.parquet(f"{DIR}/labels.parquet").collect()}
    good, poor = [d for d in marked if marked[d]], [d for d in marked if not marked[d]]
    assert sum(d in ids for d in good) >= 0.95 * len(good)
    assert sum(d in ids for d in poor) <= 0.2 * len(poor)


def test_one_of_each_group_stays(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    kept = drop_near_duplicates(spark, documents.union(documents.limit(3)), DIR)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (*_, keep) in brute(rows).items() if keep)


def test_repeats_are_cut(spark, documents):
    cut = cut_repeats(spark, documents, DIR)
    assert cut.schema == documents.schema
    met = set()
    texts = {r.doc_id: r.text for r in documents.collect()}
    got = {r.doc_id: (r.text, r.n_chars) for r in cut.collect()}
    for d in sorted(texts):
        raw = texts[d].encode()
        gone = set()
        for i in range(len(raw) - LENGTH + 1):
            w = raw[i : i + LENGTH]
            if w in met:
                gone.update(range(i, i + LENGTH))
            met.add(w)
        left = bytes(b for i, b in enumerate(raw) if i not in gone).decode(errors="ignore")
        assert got.get(d, ("", 0)) == (left, len(left))
        assert (d in got) == bool(left or not raw)


def test_mixing_keeps_every_document(spark, documents):
    mixed = mix_languages(spark, documents, DIR)
    assert mixed.columns == documents.columns
    assert {r.doc_id for r in mixed.collect()} == {r.doc_id for r in documents.collect()}
    assert mixed.count() > documents.count()


def test_whole_run(spark):
    rows = run(spark, DIR).collect()
    assert rows and all(r.n_tokens == len(r.ids) for r in rows)
    tokenizer = Tokenizer.from_file("/opt/tokenizers/word_bpe_49k.json")
    assert all(max(r.ids, default=0) < tokenizer.get_vocab_size() for r in rows)


def test_no_documents(spark, documents):
    docs = documents.limit(0)
    for _, stage in STAGES:
        docs = stage(spark, docs, DIR)
    assert docs.count() == 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_different_texts_under_one_id_stay(spark, documents):
    texts = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(4)]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[2] + " " + texts[1]), (3, texts[2] + " " + texts[1] + " end"), (1, texts[3])]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], documents.schema)
    kept = drop_near_duplicates(spark, docs, DIR)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted({*rows} - {rows[4]})
    cut = sorted((r.doc_id, r.text) for r in cut_repeats(spark, kept, DIR).collect())
    # of what two of them have, one copy stays: here the one in document 2, as the other comes after all ids
    assert [d for d, _ in cut] == [1, 1, 2]
    words = [w for _, t in cut for w in t.split()]
    assert {w for t in texts for w in t.split()} <= set(words)
    assert sum(len(t) for _, t in cut) < sum(len(t) for t in texts) + 20
