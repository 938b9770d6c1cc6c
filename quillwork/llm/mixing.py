"""Mixing sources to target weights by soft membership, in DataFrame operations only.

A naive Bayes classifier, learnt from a labelled table, gives every document a
posterior over domains. Rates are then fitted so that the expected domain totals,
the sum over documents of rate * tokens * posterior, match the targets in the least
squares sense. The gradient step of a rate depends on its own posterior and on one
number per domain, so an iteration is one aggregate to as many numbers as there are
domains, and the rate of a row is a fold over the steps so far: nothing is written
between iterations and no row leaves its partition.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.llm.sampling import free_names, keyed_sample
from quillwork.session import materialise

BUCKETS = 4_096  # words share a weight by hash
TRAIN_ROWS = 20_000  # most labelled rows that are taken for training
EVIDENCE = 10.0  # a long text counts as so many words at most, so that memberships stay soft
SENT_DOMAINS = 64  # the weights of so many domains are sent to all tasks; those of more are joined
STEPS = 40
TOLERANCE = 1e-4


def words_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+")


def word_rows(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """One row per word: the kept columns and the word's bucket.

    A text has one row at least; rows that stand for no word have a null bucket.
    """
    rows = df.select(*keep, F.explode(words_of(F.col(text))).alias("word"))
    bucket = F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int")
    return rows.select(*keep, F.when(F.col("word") != "", bucket).alias("bucket"))


@dataclass(frozen=True)
class DomainModel:
    """`weights`: (bucket, w0, w1, ...), log probabilities of the bucket's words in every domain."""

    domains: tuple[str, ...]
    priors: tuple[float, ...]
    weights: DataFrame


def labelled_sample(df: DataFrame, labels: DataFrame, key: str = "doc_id", rows: int = TRAIN_ROWS) -> DataFrame:
    """Rows of `df` joined with at most `rows` rows of `labels`, those with the smallest hashes of the key.

    The labels are bounded, so they can be sent to the texts, which stay where they are.
    """
    bounded = keyed_sample(labels.where(F.col(key).isNotNull()), key, rows)
    return df.join(F.broadcast(materialise(bounded)), key)


def fit_domains(labelled: DataFrame, domain: str = "domain", text: str = "text", rows: int = TRAIN_ROWS) -> DomainModel:
    """Naive Bayes on at most `rows` labelled texts, those with the smallest hashes.

    Rows with a null domain are not used. The weights table has `BUCKETS` rows at
    most; a bucket that no labelled text has says nothing. Without labelled rows the
    model has no domains.
    """
    sample = labelled.where(F.col(domain).isNotNull()).select(F.col(domain).cast("string").alias("d"), F.col(text).alias("text"))
    total = sample.count()
    if total > rows:
        sample = sample.where(F.pmod(F.xxhash64("text", "d"), F.lit(1 << 30)) < int(rows / total * (1 << 30)))
    sample = materialise(sample)
    # no more domains than rows in the sample
    sizes = sample.groupBy("d").agg(F.count("*").alias("n")).orderBy("d").collect()
    domains = tuple(r["d"] for r in sizes)
    if not domains:
        return DomainModel((), (), df_of_no_buckets(sample))
    priors = tuple(log(r["n"] / sum(x["n"] for x in sizes)) for r in sizes)
    counts = word_rows(sample, "d").where("bucket is not null").groupBy("bucket").agg(
        *[F.sum((F.col("d") == d).cast("long")).alias(f"c{k}") for k, d in enumerate(domains)]
    )
    counts = materialise(counts)
    sums = counts.agg(*[F.coalesce(F.sum(f"c{k}"), F.lit(0)).alias(f"c{k}") for k in range(len(domains))]).first()
    spread = [F.log((F.col(f"c{k}") + 0.5) / (sums[f"c{k}"] + 0.5 * BUCKETS)).alias(f"w{k}") for k in range(len(domains))]
    return DomainModel(domains, priors, materialise(counts.select("bucket", *spread)))


def df_of_no_buckets(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "bucket int")


def known_weights(weights: dict[str, float], model: DomainModel) -> dict[str, float]:
    """The weights of the model's domains; a warning names the others, whose shares go to these."""
    missing = sorted(set(weights) - set(model.domains))
    if missing:
        warnings.warn(f"no labelled rows for {', '.join(missing)}", stacklevel=2)
    return {d: w for d, w in weights.items() if d in model.domains}


def posteriors(df: DataFrame, model: DomainModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tokens, p): number of words and membership in every domain, in the model's order.

    One row per key; rows that repeat a key are taken together. A null key is left
    out. A text without words, or null, has the priors. A model without domains gives
    empty memberships.
    """
    rows = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).where("id is not null")
    k = range(len(model.domains))
    # a table of BUCKETS rows and a column for each domain: its size does not depend on the texts
    weights = F.broadcast(model.weights) if len(k) <= SENT_DOMAINS else model.weights
    scored = word_rows(rows, "id").join(weights, "bucket", "left")
    sums = scored.groupBy("id").agg(F.count("bucket").alias("tokens"), *[F.sum(f"w{i}").alias(f"w{i}") for i in k])
    # the mean over the words is scaled to the evidence
    n = F.col("tokens")
    scale = F.least(n.cast("double"), F.lit(EVIDENCE)) / F.greatest(n, F.lit(1))
    logits = F.array(*[F.coalesce(F.col(f"w{i}"), F.lit(0.0)) * scale + F.lit(model.priors[i]) for i in k]).cast("array<double>")
    rows = sums.select("id", n.cast("long").alias("tokens"), logits.alias("z"))
    rows = rows.select("id", "tokens", F.transform("z", lambda z: F.exp(z - F.array_max("z"))).alias("e"))
    norm = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return rows.select(F.col("id").alias(key), "tokens", F.transform("e", lambda x: x / norm).alias("p"))


def _rate(steps: list[list[float]], low: float) -> Column:
    """Rate after the steps: from 1, each moved by the step's dot product with p, held at `low` or more."""
    if not steps:
        return F.greatest(F.lit(1.0), F.lit(low))
    rounds = F.array(*[F.array(*[F.lit(x) for x in step]) for step in steps])
    return F.aggregate(
        rounds,
        F.greatest(F.lit(1.0), F.lit(low)),
        lambda rate, step: F.greatest(
            F.lit(low),
            rate + F.aggregate(F.zip_with("p", step, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x),
        ),
    )


def domain_totals(members: DataFrame, domains: int, rate: Column) -> list[float]:
    """Expected tokens of every domain under `rate`."""
    sums = [F.coalesce(F.sum(rate * F.col("tokens") * F.col("p")[k]), F.lit(0.0)).alias(f"t{k}") for k in range(domains)]
    return [float(x) for x in members.agg(*sums).first()]


def fit_rates(members: DataFrame, targets: list[float], low: float = 0.0, steps: int = STEPS) -> tuple[Column, list[float]]:
    """(rate column over `p`, expected totals reached).

    Minimises the squared relative distance of the totals from `targets` by projected
    gradient steps, from rate 1, over rates of at least `low`. The step of a domain is
    scaled by its current total, and shrinks when the distance grows.
    """
    k = len(targets)
    size = 1.0
    taken: list[list[float]] = []
    totals = domain_totals(members, k, _rate(taken, low))
    distance = sum((t - a) ** 2 / max(t, 1.0) ** 2 for t, a in zip(targets, totals, strict=True))
    for _ in range(steps):
        if distance <= TOLERANCE**2 * k:
            break
        # the gradient, in the metric where a domain's total has unit size
        gradient = [(t - a) / max(a, 1e-3 * t, 1.0) for t, a in zip(targets, totals, strict=True)]
        tried = [*taken, [size * g for g in gradient]]
        reached = domain_totals(members, k, _rate(tried, low))
        new = sum((t - a) ** 2 / max(t, 1.0) ** 2 for t, a in zip(targets, reached, strict=True))
        if new < distance:
            taken, totals, distance = tried, reached, new
            size = min(size * 1.2, 2.0)
        else:
            size /= 2
            if size < 1e-4:
                break
    return _rate(taken, low), totals


@dataclass(frozen=True)
class Mixture:
    """`rates`: (key, tokens, p, rate); targets and expected totals by domain."""

    rates: DataFrame
    domains: tuple[str, ...]
    targets: list[float]
    totals: list[float]


def mix_to_targets(
    df: DataFrame,
    model: DomainModel,
    weights: dict[str, float],
    key: str = "doc_id",
    text: str = "text",
    low: float = 0.0,
    total: float | None = None,
) -> Mixture:
    """Rates for every key of `df` whose expected domain totals have the shares `weights`.

    A domain of the model that `weights` does not name has target 0; an unknown name
    is an error. `total` is the number of tokens aimed at, by default as many as
    `df` has; with `low=1` it should leave room for all. No rows give no rates. With a
    model without domains, or no weights, there is nothing to aim at: every rate is 1, or `low`.
    """
    if not model.domains or not weights:
        members = materialise(posteriors(df, model, key, text))
        return Mixture(members.withColumn("rate", F.lit(max(1.0, low))), model.domains, [], [])
    unknown = set(weights) - set(model.domains)
    if unknown or min(weights.values(), default=0) < 0 or not sum(weights.values()):
        raise ValueError(f"weights must be nonnegative shares of known domains, not {weights}")
    members = materialise(posteriors(df, model, key, text))
    natural = domain_totals(members, len(model.domains), F.lit(1.0))
    share = [weights.get(d, 0.0) / sum(weights.values()) for d in model.domains]
    if total is None:
        total = sum(natural)
        if low >= 1:
            # no domain has to lose anything
            total = max([total, *[n / s for n, s in zip(natural, share, strict=True) if s > 0]])
    targets = [s * total for s in share]
    rate, totals = fit_rates(members, targets, low)
    return Mixture(members.select(key, "tokens", "p", rate.alias("rate")), model.domains, targets, totals)


def copies_of(key: Column, rate: Column) -> Column:
    """Whole number of copies whose mean over keys is the rate: the fraction is decided by the key's hash."""
    draw = F.pmod(F.xxhash64(key, F.lit("copies")), F.lit(1 << 20)) / float(1 << 20)
    return F.floor(rate + draw).cast("int")


def apply_mixture(df: DataFrame, mixture: Mixture, key: str = "doc_id") -> DataFrame:
    """The rows of `df`, each as often as its rate says; columns as in `df`. Rows with a null key stay once."""
    own, copies, copy = free_names(df, "key", "copies", "copy")
    counts = mixture.rates.select(F.col(f"`{key}`").alias(own), copies_of(F.col(f"`{key}`"), F.col("rate")).alias(copies))
    joined = df.join(counts, F.col(f"`{key}`") == F.col(own), "left")
    times = F.coalesce(F.col(copies), F.lit(1))
    repeated = joined.withColumn(copy, F.explode(F.sequence(F.lit(0), times))).where(F.col(copy) < times)
    return repeated.select(*[F.col(f"`{c}`") for c in df.columns])
