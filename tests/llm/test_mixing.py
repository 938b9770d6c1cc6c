from __future__ import annotations

import random

import pytest

from quillwork.llm import mixing
from quillwork.llm.mixing import apply_mixture, domain_totals, fit_domains, fit_rates, known_weights, mix_to_targets, posteriors

VOCAB = {"a": ["sun", "moon", "star"], "b": ["ash", "oak", "elm"], "c": ["one", "two", "six"]}


def text_of(r: random.Random, d: str) -> str:
    return " ".join(r.choice(VOCAB[d] if r.random() < 0.9 else VOCAB["a"]) for _ in range(r.randint(5, 40)))


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(5)
    rows = [(i, text_of(r, d), d, 7) for i, d in enumerate(r.choices("abc", [6, 3, 1], k=400))]
    documents = spark.createDataFrame(rows, "doc_id long, text string, d string, rate long")
    return documents, fit_domains(documents.where("doc_id < 200"), "d")


def test_memberships(tables):
    documents, model = tables
    got = {r.doc_id: r for r in posteriors(documents, model).collect()}
    assert all(abs(sum(r.p) - 1) < 1e-9 for r in got.values())
    hits = [model.domains[r.p.index(max(r.p))] == x.d for x in documents.collect() for r in [got[x.doc_id]]]
    assert sum(hits) > 0.95 * len(hits)
    assert all(got[x.doc_id].tokens == len(x.text.split()) for x in documents.collect())


def test_totals_meet_the_targets(tables):
    documents, model = tables
    mixture = mix_to_targets(documents, model, {"a": 0.3, "b": 0.3, "c": 0.4})
    rows = mixture.rates.collect()
    for k, target in enumerate(mixture.targets):
        assert abs(sum(r.rate * r.tokens * r.p[k] for r in rows) - target) <= 1e-3 * target
    assert min(r.rate for r in rows) >= 0
    got = apply_mixture(documents, mixture)
    assert got.columns == documents.columns
    tokens = sum(len(r.text.split()) for r in got.where("d = 'c'").collect())
    assert abs(tokens - mixture.targets[2]) < 0.15 * mixture.targets[2]


def test_lower_bound_keeps_every_row(tables):
    documents, model = tables
    mixture = mix_to_targets(documents, model, {"a": 0.4, "b": 0.3, "c": 0.3}, low=1.0)
    assert min(r.rate for r in mixture.rates.collect()) >= 1
    kept = {r.doc_id for r in apply_mixture(documents, mixture).collect()}
    assert kept == {r.doc_id for r in documents.collect()}


def test_against_plain_projected_gradient(spark):
    rows = [(i, n, p) for i, (n, p) in enumerate([(10, [0.9, 0.1]), (30, [0.2, 0.8]), (5, [0.5, 0.5]), (8, [1.0, 0.0])])]
    members = spark.createDataFrame(rows, "doc_id long, tokens long, p array<double>")
    rate, totals = fit_rates(members, [12.0, 40.0])
    assert totals == pytest.approx([12.0, 40.0], rel=1e-3)
    x = [1.0] * 4
    for _ in range(20_000):
        t = [sum(r * n * p[k] for r, (_, n, p) in zip(x, rows, strict=True)) for k in (0, 1)]
        x = [max(0.0, r - 1e-4 * n * sum(p[k] * (t[k] - g) for k, g in enumerate((12.0, 40.0)))) for r, (_, n, p) in zip(x, rows, strict=True)]
    assert [sum(r * n * p[k] for r, (_, n, p) in zip(x, rows, strict=True)) for k in (0, 1)] == pytest.approx([12, 40], rel=1e-3)
    assert domain_totals(members, 2, rate) == pytest.approx([12.0, 40.0], rel=1e-3)
    # a target out of reach: the rates stay nonnegative
    assert min(r.rate for r in members.select(fit_rates(members, [0.0, 40.0])[0].alias("rate")).collect()) >= 0


def test_hard_rows(spark, tables):
    _, model = tables
    rows = [(1, None, "x"), (2, "", "x"), (3, "oak " * 50_000, "y"), (3, "oak " * 50_000, "y"), (None, "sun", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    got = {r.doc_id: r for r in posteriors(df, model).collect()}
    assert got[1].tokens == got[2].tokens == 0 and got[3].tokens == 100_000 and set(got) == {1, 2, 3}
    mixture = mix_to_targets(df, model, {"b": 1.0})
    assert apply_mixture(df, mixture).where("doc_id is null").count() == 1
    assert mix_to_targets(df.limit(0), model, {"b": 1.0}).rates.count() == 0
    with pytest.raises(ValueError):
        mix_to_targets(df, model, {"nowhere": 1.0})


def test_without_labels_every_rate_is_one(spark, tables):
    documents, _ = tables
    model = fit_domains(documents.where("false"), "d")
    assert model.domains == ()
    with pytest.warns(UserWarning, match="no labelled rows for a, b"):
        weights = known_weights({"a": 0.5, "b": 0.5}, model)
    mixture = mix_to_targets(documents, model, weights)
    rows = mixture.rates.collect()
    assert len(rows) == 400 and {(r.rate, tuple(r.p)) for r in rows} == {(1.0, ())} and min(r.tokens for r in rows) >= 5
    assert sorted(apply_mixture(documents, mixture).collect()) == sorted(documents.collect())
    assert mix_to_targets(documents.limit(0), model, {}).rates.count() == 0


@pytest.mark.parametrize("sent", [64, 100])
def test_more_domains_than_are_sent(spark, monkeypatch, sent):
    monkeypatch.setattr(mixing, "SENT_DOMAINS", sent)
    rows = [(d * 10 + i, f"w{d} w{d} x{i}", f"d{d:02}") for d in range(70) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, d string")
    model = fit_domains(df, "d")
    assert len(model.domains) == 70
    got = {r.doc_id: r.p for r in posteriors(df, model).collect()}
    # two words may share a bucket
    assert sum(model.domains[p.index(max(p))] == f"d{key // 10:02}" for key, p in got.items()) >= 0.9 * len(got) == 252


def test_clashing_column_names(spark, tables):
    documents, model = tables
    clash = documents.selectExpr("doc_id", "text", "d AS _key", "rate AS _copies", "1 AS _copy", "2 AS __key")
    mixture = mix_to_targets(clash, model, {"a": 0.3, "b": 0.3, "c": 0.4})
    got = apply_mixture(clash, mixture)
    assert got.columns == clash.columns and got.count() == apply_mixture(documents, mixture).count()


@pytest.fixture
def tables_without(spark, tmp_path):
    """The smallest tables, with empty labels or empty documents."""

    def make(*empty: str) -> str:
        folder = tmp_path / "-".join(empty)
        for name in ("documents", "labels"):
            df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
            (df.limit(0) if name in empty else df).write.parquet(str(folder / f"{name}.parquet"))
        return str(folder)

    return make


@pytest.mark.filterwarnings("ignore:no labelled rows")
def test_query_on_empty_tables(spark, tables_without):
    from quillwork.llm.queries import QUERIES

    rows = QUERIES["op8_mixing"](spark, tables_without("labels")).collect()
    assert len(rows) > 100 and {(r.rate, r.copies, r.domain) for r in rows} == {(1.0, 1, None)}
    assert QUERIES["op8_mixing"](spark, tables_without("documents", "labels")).count() == 0
    assert QUERIES["op8_mixing"](spark, tables_without("documents")).count() == 0


def test_query_names_the_likeliest_domain(spark):
    from quillwork.llm.queries import QUERIES

    rows = QUERIES["op8_mixing"](spark, "/root/testdata/sf0.001").collect()
    kinds = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    domains = sorted({r.domain for r in rows})
    for r in rows:
        assert 0 <= r.copies - int(r.rate) <= 1 and abs(sum(r.p) - 1) < 1e-9
    assert sum(r.domain.split("/")[0] == kinds[r.doc_id] for r in rows) > 0.8 * len(rows) and len(domains) > 2
