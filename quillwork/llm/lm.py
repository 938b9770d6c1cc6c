"""Cross-entropy difference between two matched n-gram models.

A target model and a background model have one vocabulary, one order and one
smoothing, and the background counts are brought to the size of the target's, so that
their difference on a token is due to the texts alone. Counts come from all texts and
are exact: the vocabulary holds every word, and every pair of a word and the one before
it is counted by itself, in tables that grow with the corpus. Words and pairs go by
64-bit hashes.

Most pairs are met once or twice, so a row for each would be many times the text. Texts
are put in blocks, and a block sends the different keys of all its texts packed, one
row for each bucket of keys. A bucket adds up what all blocks have, and sends every block
the sums in the order of its keys, so that keys move once and come back as counts alone.
Buckets are taken in a few parts, each of which reads the blocks again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm.hashing import combine, text_chunks, word_hashes
from quillwork.session import materialise

STRENGTH = 5.0  # how many counts the unigram distribution is worth in a context
BLOCK_BYTES = 4_000_000  # text whose keys are looked up together; a longer text is a block of its own
BUCKET_BYTES = 8_000_000  # text for which there is one more bucket of keys
PARTS = 3  # of the buckets, taken one after the other; what is on its way is a part of the keys
UNITS = float(1 << 30)  # of a bit; whole numbers sum up to the same in any order


def _pack(values: np.ndarray) -> bytes:
    """64-bit values by the places of their bytes, compressed; most of the high bytes are zeros."""
    return zstandard.compress(values.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


def blocks_of(df: DataFrame) -> DataFrame:
    """(rows, target, sizes, body, bytes): the rows of (row, target, text), of about `BLOCK_BYTES` of text together.

    `body` has the bytes of the texts one after the other, compressed, as they are moved
    twice, and `sizes` their numbers; `bytes` is the sum of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_chunks(batch.column(2), BLOCK_BYTES):
                lists = [*[c.slice(row, end - row) for c in batch.columns[:2]], pa.array(np.diff(offsets))]
                lists = [pa.ListArray.from_arrays(pa.array([0, end - row], pa.int32()), c) for c in lists]
                body = pa.array([zstandard.compress(data.tobytes())], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*lists, body, pa.array([data.size])], names=["rows", "target", "sizes", "body", "bytes"]
                )

    return df.mapInArrow(run, "rows array<long>, target array<boolean>, sizes array<long>, body binary, bytes long")


def _keys(sizes: pa.Array, body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the pairs, of the contexts, and of the words of all tokens; tokens of each text).

    A context is the word before, 0 before the first of a text. Keys of words are odd, others even.
    """
    offsets = pa.py_buffer(np.r_[0, np.cumsum(np.asarray(sizes))])
    texts = pa.LargeStringArray.from_buffers(len(sizes), offsets, pa.py_buffer(zstandard.decompress(body)))
    words, count = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for _, _, data, offsets in text_chunks(texts):
        hashes, first = word_hashes(data, offsets)
        words.append(hashes)
        count.append(np.diff(first))
    words, count = np.concatenate(words), np.concatenate(count)
    before = np.zeros(words.size, np.uint64)
    before[1:] = words[:-1]
    before[(np.cumsum(count) - count)[count > 0]] = 0
    one = np.uint64(1)
    pairs, contexts = combine(np.stack([before, words], axis=1), 0), combine(before[:, None], 1)
    return np.concatenate([pairs & ~one, contexts & ~one, combine(words[:, None], 2) | one]), count


def block_counts(blocks: DataFrame, buckets: int, part: int = 0, parts: int = 1) -> DataFrame:
    """(bucket, block, keys, counts): the different keys of every block, by ranges of keys, in order.

    `keys` are packed as differences, `counts` as all of those in all texts and then those
    in texts with `target`. Of the buckets one part of `parts`, which are next to each other.
    """
    low, high = part * buckets // parts, (part + 1) * buckets // parts

    def bucket_of(keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, target, sizes, body in zip(*batch.columns, strict=True):
                keys, count = _keys(sizes.values, body.as_py())
                chosen = np.tile(np.repeat(np.asarray(target.values.fill_null(False)), count), 3)
                bucket = bucket_of(keys)
                own = (bucket >= low) & (bucket < high)
                keys, back = np.unique(keys[own], return_inverse=True)
                counts = np.stack([np.bincount(b, minlength=keys.size) for b in (back, back[chosen[own]])])
                bucket = bucket_of(keys).astype(np.int32)
                cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: bucket.size])
                ends = np.r_[cut[1:], bucket.size][: cut.size]
                keys = [_pack(np.diff(keys[a:b], prepend=np.uint64(0))) for a, b in zip(cut, ends, strict=True)]
                counts = [_pack(counts[:, a:b].ravel()) for a, b in zip(cut, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[cut]), pa.array([block.as_py()] * cut.size, pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())],
                    names=["bucket", "block", "keys", "counts"],
                )

    return blocks.select("block", "target", "sizes", "body").mapInArrow(run, "bucket int, block long, keys binary, counts binary")


def bucket_totals(counts: DataFrame) -> DataFrame:
    """(bucket, block, counts, words, tokens, chosen): what all blocks have of the keys of each.

    `words`, `tokens` and `chosen` are of the bucket, on the first of its rows: its
    different words, their counts, and those in target texts.
    """

    def run(table: pa.Table) -> pa.Table:
        keys = [np.cumsum(_unpack(k).view(np.uint64)) for k in table.column("keys").to_pylist()]
        local = np.concatenate([_unpack(c).reshape(2, -1) for c in table.column("counts").to_pylist()], axis=1)
        ends = np.cumsum([k.size for k in keys])
        keys, back = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.stack([np.bincount(back, n, keys.size).astype(np.int64) for n in local])
        word = (keys & np.uint64(1)).astype(bool)
        once = [pa.array([int(n), *[0] * (ends.size - 1)], pa.int64()) for n in (word.sum(), *sums[:, word].sum(axis=1))]
        out = [_pack(sums[:, b].ravel()) for b in np.split(back, ends[:-1])]
        return pa.Table.from_arrays(
            [*[table.column(c) for c in ("bucket", "block")], pa.array(out, pa.binary()), *once],
            names=["bucket", "block", "counts", "words", "tokens", "chosen"],
        )

    return counts.groupBy("bucket").applyInArrow(
        run, "bucket int, block long, counts binary, words long, tokens long, chosen long"
    )


def block_costs(blocks: DataFrame, totals: DataFrame, size: int, tokens: tuple[int, int]) -> DataFrame:
    """(row, n, background, target): what the words of each text cost under either model, in `UNITS` of a bit."""
    # the target as large as it is, the background brought to that size; two entries are the start and a word not met
    scales = (tokens[1] / tokens[0] if tokens[0] and tokens[1] else 1.0, 1.0)

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        rows, sizes = (block.column(c).combine_chunks().flatten() for c in ("rows", "sizes"))
        keys, count = _keys(sizes, block.column("body")[0].as_py())
        pair, context, word = np.split(np.unique(keys, return_inverse=True)[1], 3)
        # as buckets are ranges of keys, their sums stand in the order of the keys
        found = [_unpack(c).reshape(2, -1) for c in found.sort_by("bucket").column("counts").to_pylist()]
        sums = []
        for met, total, scale in zip(np.concatenate([np.empty((2, 0), np.int64), *found], axis=1), tokens, scales, strict=True):
            unigram = (met[word] * scale + 0.5) / (total * scale + 0.5 * (size + 2))
            chance = (met[pair] * scale + STRENGTH * unigram) / (met[context] * scale + STRENGTH)
            cost = np.floor(-np.log2(chance) * UNITS + 0.5).astype(np.int64)
            upto = np.r_[0, np.cumsum(cost)][np.r_[0, np.cumsum(count)]]
            sums.append(pa.array(np.diff(upto)))
        return pa.Table.from_arrays([rows, pa.array(count), *sums], names=["row", "n", "background", "target"])

    texts = blocks.select("block", "rows", "sizes", "body").groupBy("block")
    sums = totals.select("block", "bucket", "counts").groupBy("block")
    return texts.cogroup(sums).applyInArrow(run, "row long, n long, background long, target long")


def cross_entropy_difference(df: DataFrame, target_keys: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`df` with n_tokens, ce_target, ce_background (bits a token) and ce_difference, target less background.

    Target are the texts whose key is in `target_keys`; a null key is never one. The
    lower the difference, the more a text is like the target. Repeated rows are counted,
    and scored, each. A text without words, or null, has 0 tokens and null scores.
    Without any target text the target model is uniform. Columns of `df` with these
    names are replaced, others stay.
    """
    added = ["n_tokens", "ce_target", "ce_background", "ce_difference"]
    kept = [F.col(f"`{c}`") for c in df.columns if c not in added]
    marked = target_keys.select(F.col(f"`{key}`").alias("__key")).dropna().distinct().withColumn("__target", F.lit(True))
    # shuffled whatever its size, so that the job grows evenly
    flagged = df.select(*kept, F.col(f"`{key}`").alias("__id")).join(marked.hint("merge"), F.col("__id") == F.col("__key"), "left")
    rows = materialise(flagged.select(*kept, "__target", F.monotonically_increasing_id().alias("__row")), "zstd")
    blocks = blocks_of(rows.select("__row", "__target", F.col(f"`{text}`").cast("string")))
    blocks = materialise(blocks.withColumn("block", F.monotonically_increasing_id()))
    buckets = 1 + (blocks.agg(F.sum("bytes")).first()[0] or 0) // BUCKET_BYTES
    # one part after the other, so that only the keys of one are on their way
    parts = [materialise(bucket_totals(block_counts(blocks, buckets, i, PARTS))) for i in range(PARTS)]
    totals = reduce(DataFrame.union, parts)
    size, *tokens = totals.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "tokens", "chosen")]).first()
    sums = block_costs(blocks, totals, size, tuple(tokens)).where("n > 0").toDF("__of", "__n", "__background", "__target")
    scored = rows.drop("__target").join(sums, F.col("__row") == F.col("__of"), "left")
    means = [(F.col(f"__{kind}") / UNITS / F.col("__n")).alias(f"ce_{kind}") for kind in ("target", "background")]
    out = scored.select(*kept, F.coalesce("__n", F.lit(0)).alias("n_tokens"), *means)
    return out.withColumn("ce_difference", F.col("ce_target") - F.col("ce_background"))
