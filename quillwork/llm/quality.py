"""Quality classifier: random-indexing word vectors pooled per text, a two-layer network, a temperature.

Every token bucket has a sparse random index vector. The vector of a bucket is the
sum of the index vectors of its neighbours over all texts, so it says in which
company a token stands; it is summed up in integers and does not depend on the
order of the rows. A text is the mean of the unit vectors of its tokens, the mean
of their index vectors, and a few shares. A small network, trained in numpy on a
bounded sample of labelled rows, gives a logit, and a temperature fitted on held-out
labelled rows turns it into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quillwork.llm.hashing import span_hashes, text_chunks, word_spans
from quillwork.llm.sampling import keyed_sample
from quillwork.session import materialise

BUCKETS = 1 << 13  # token buckets; words share a bucket by hash
WIDTH = 32  # length of the vectors
NONZERO = 2  # entries of an index vector, each +1 or -1
REACH = 2  # neighbours on either side
HIDDEN = 16
TRAIN_ROWS = 20_000  # most labelled rows that are taken for training
EPOCHS = 60
POOLED_WORDS = 20_000  # words whose vectors are laid out together; a longer text's are at once
SEED = 11

_CLASS = np.zeros(256, np.uint8)  # other bytes, among them those of non-ASCII letters: 0
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[ord(c) for c in ".,;:'\"!?-()"]] = 4
_CLASS[[ord(c) for c in "#*$%&|<>=_/\\^~+@[]{}`"]] = 5
SHARES = 10


@lru_cache(maxsize=1)
def index_vectors() -> np.ndarray:
    """Buckets x WIDTH, `NONZERO` random signs in each row."""
    random = np.random.default_rng(SEED)
    out = np.zeros((BUCKETS, WIDTH), np.int8)
    for _ in range(NONZERO):
        out[np.arange(BUCKETS), random.integers(0, WIDTH, BUCKETS)] = random.choice([-1, 1], BUCKETS)
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every word, first word of every text plus total, shares of every text).

    The words are taken as they stand, capitals and punctuation included.
    """
    starts, ends, first = word_spans(data, offsets)
    texts = len(offsets) - 1
    shares = np.zeros((texts, SHARES), np.float32)
    if not starts.size:
        return np.empty(0, np.int64), first, shares
    hashes = span_hashes(data, starts, ends, lower=False)
    bucket = (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)
    full = np.flatnonzero(np.diff(first) > 0)
    count = np.diff(first)[full].astype(np.float32)
    kinds = _CLASS[data]
    size = np.maximum(np.diff(offsets)[full], 1).astype(np.float32)
    for kind in range(6):
        sums = np.concatenate([[0], np.cumsum(kinds == kind)])
        shares[full, kind] = (sums[offsets[full + 1]] - sums[offsets[full]]) / size
    shares[full, 6] = np.log1p(count) / 10
    shares[full, 7] = np.add.reduceat((ends - starts).astype(np.float32), first[full]) / count / 10
    repeat = np.zeros(hashes.size, np.float32)
    repeat[1:] = hashes[1:] == hashes[:-1]
    repeat[first[full]] = 0
    shares[full, 8] = np.add.reduceat(repeat, first[full]) / count
    # share of words that occur again in the text
    owner = np.repeat(np.arange(texts), np.diff(first))
    order = np.lexsort((hashes, owner))
    again = np.zeros(hashes.size, np.float32)
    again[1:] = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    shares[full, 9] = np.add.reduceat(again, first[full]) / count
    return bucket, first, shares


def context_sums(df: DataFrame, text: str) -> DataFrame:
    """(bucket, v0, v1, ...): sums of the index vectors of neighbours over all texts of `df`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_vectors()
        column = np.argsort(index == 0, axis=1, kind="stable")[:, :NONZERO]  # where the entries are
        sign = np.take_along_axis(index, column, axis=1).astype(np.float64)
        total = np.zeros(BUCKETS * WIDTH)
        seen = np.zeros(BUCKETS, bool)
        for batch in batches:
            for _, _, data, offsets in text_chunks(batch.column(0)):
                bucket, first, _ = tokens(data, offsets)
                if not bucket.size:
                    continue
                seen[bucket] = True
                owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for step in range(1, REACH + 1):
                    same = owner[step:] == owner[:-step]
                    a, b = bucket[:-step][same], bucket[step:][same]
                    for at, other in ((a, b), (b, a)):
                        for k in range(NONZERO):
                            total += np.bincount(at * WIDTH + column[other, k], sign[other, k], BUCKETS * WIDTH)
        rows = np.flatnonzero(seen)
        table = total.reshape(BUCKETS, WIDTH)[rows].astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows.astype(np.int32)), *[pa.array(table[:, k].copy()) for k in range(WIDTH)]],
            names=["bucket", *[f"v{k}" for k in range(WIDTH)]],
        )

    schema = "bucket int, " + ", ".join(f"v{k} long" for k in range(WIDTH))
    parts = df.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, schema)
    return parts.groupBy("bucket").agg(*[F.sum(f"v{k}").alias(f"v{k}") for k in range(WIDTH)])


def word_vectors(df: DataFrame, text: str) -> np.ndarray:
    """Unit vectors of all buckets; BUCKETS x WIDTH numbers at most come to the driver."""
    out = np.zeros((BUCKETS, WIDTH), np.float32)
    table = context_sums(df, text).toArrow()
    if table.num_rows:
        rows = np.asarray(table.column("bucket"))
        out[rows] = np.stack([np.asarray(table.column(f"v{k}")) for k in range(WIDTH)], axis=1)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(length, 1)


def pooled(vectors: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per text: mean word vector, mean index vector, shares. All zero for a text without words."""
    bucket, first, shares = tokens(data, offsets)
    out = np.zeros((len(offsets) - 1, 2 * WIDTH + SHARES), np.float32)
    out[:, 2 * WIDTH :] = shares
    full = np.flatnonzero(np.diff(first) > 0)
    if full.size:
        both = np.concatenate([vectors, index_vectors().astype(np.float32)], axis=1)
        # the rows of all words at once would take more than a hundred times the text
        piece = np.searchsorted(first[full], np.arange(0, bucket.size, POOLED_WORDS))
        for a, b in zip(piece, np.r_[piece[1:], full.size], strict=True):
            if a < b:
                begin, part = first[full[a]], full[a:b]
                sums = np.add.reduceat(both[bucket[begin : first[part[-1] + 1]]], first[part] - begin, axis=0)
                out[part, : 2 * WIDTH] = sums / np.diff(first)[part].astype(np.float32)[:, None]
    return out


@dataclass
class Network:
    """Standardisation, two layers and a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(x @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray) -> Network:
    """Fit on four fifths of the rows, the temperature on the rest. Deterministic for given rows.

    Without rows the score is 0.5, with one label only it is that label's share.
    """
    n, width = x.shape
    if n == 0 or y.min() == y.max():
        b2 = 0.0 if n == 0 else float(np.log((y.mean() * n + 1) / ((1 - y.mean()) * n + 1)))
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), b2)
    random = np.random.default_rng(SEED)
    fit = np.arange(n) % 5 != 0 if n >= 50 else np.ones(n, bool)
    mean, scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
    net = Network(mean, scale, random.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    z, t = np.clip((x[fit] - mean) / scale, -8, 8), y[fit].astype(float)
    # the rarer label counts as much as the other, up to tenfold
    share = min(max(t.mean(), 0.05), 0.95)
    weight = np.where(t == 1, 0.5 / share, 0.5 / (1 - share))
    names = ("w1", "b1", "w2", "b2")
    first = {k: np.zeros_like(np.asarray(getattr(net, k), float)) for k in names}
    second = {k: np.zeros_like(v) for k, v in first.items()}
    step = 0
    for _ in range(EPOCHS):
        order = random.permutation(len(t))
        for i in range(0, len(t), 256):
            part = order[i : i + 256]
            hidden = np.tanh(z[part] @ net.w1 + net.b1)
            p = 1 / (1 + np.exp(-np.clip(hidden @ net.w2 + net.b2, -30, 30)))
            error = (p - t[part]) * weight[part] / len(part)
            back = np.outer(error, net.w2) * (1 - hidden**2)
            grads = {
                "w2": hidden.T @ error + 1e-4 * net.w2, "b2": error.sum(),
                "w1": z[part].T @ back + 1e-4 * net.w1, "b1": back.sum(axis=0),
            }
            step += 1
            for k in names:
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, getattr(net, k) - 0.01 * move)
    held = ~fit if (~fit).any() else fit
    logits, t = net.logit(x[held]), y[held]
    sign = np.where(t == 1, -1.0, 1.0)
    temperatures = np.geomspace(0.25, 8, 41)
    losses = [np.logaddexp(0, sign * logits / k).mean() for k in temperatures]
    net.temperature = float(temperatures[int(np.argmin(losses))])
    return net


def _model_rows(df: DataFrame, vectors, key: str, text: str, label: str) -> tuple[np.ndarray, np.ndarray]:
    """Pooled rows and labels of labelled texts, in the order of the key, on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_chunks(batch.column(1)):
                x = pooled(vectors.value, data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, end - row),
                        pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float32())),
                        batch.column(2).slice(row, end - row),
                    ],
                    names=["key", "x", "label"],
                )

    rows = df.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"), F.col(label).cast("int").alias("label"))
    rows = rows.mapInArrow(run, "key string, x array<float>, label int").toArrow()
    if not rows.num_rows:
        return np.zeros((0, 2 * WIDTH + SHARES), np.float32), np.zeros(0, int)
    order = np.lexsort((np.asarray(rows.column("label")), np.asarray(rows.column("key").to_pylist(), dtype=str)))
    x = np.asarray(rows.column("x").combine_chunks().flatten()).reshape(rows.num_rows, -1)
    return x[order].astype(np.float64), np.asarray(rows.column("label"))[order]


@dataclass
class QualityModel:
    vectors: np.ndarray
    network: Network


def fit_quality(
    df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS
) -> QualityModel:
    """Word vectors from all texts of `df`; the network from at most `rows` labelled ones.

    The sample takes the labelled keys with the smallest hashes. Labels that are
    null, and keys that are null, are not used; of a key with several labels the
    smaller label counts.
    """
    spark = df.sparkSession
    vectors = word_vectors(df, text)
    marked = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("__key"))
        .agg(F.min(F.col(label).cast("int")).alias("__label"))
    )
    # twice the bound, as some labels have no text; both sides of the join are bounded then
    sample = materialise(keyed_sample(materialise(marked), "__key", 2 * rows))
    texts = df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text")).dropna(subset=["__key"])
    chosen = texts.join(F.broadcast(sample), "__key")
    keep = keyed_sample(materialise(chosen.select("__key", "__label").distinct()), "__key", rows)
    chosen = texts.join(F.broadcast(materialise(keep)), "__key")
    shared = spark.sparkContext.broadcast(vectors)
    x, y = _model_rows(chosen, shared, "__key", "__text", "__label")
    return QualityModel(vectors, train(x, y))


def score_quality(df: DataFrame, model: QualityModel, text: str = "text", name: str = "score") -> DataFrame:
    """`df` with a probability in `name`; null counts as the empty text, which is scored too.

    All columns of `df` stay; one called `name` is replaced.
    """
    spark: SparkSession = df.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c != name]
    at = kept.index(text)
    # columns by position, as names may repeat or be odd
    plain = df.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for row, end, data, offsets in text_chunks(batch.column(at)):
                score = model.network.score(pooled(model.vectors, data, offsets).astype(np.float64))
                columns = [batch.column(i).slice(row, end - row) for i in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(score)], names=[*kept, name])

    return plain.mapInArrow(run, StructType([*plain.schema.fields, StructField(name, DoubleType())]))
