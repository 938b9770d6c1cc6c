"""Repeated passages by MinHash banding of paragraphs.

Boundaries follow the text, not its lines: every sentence starts at one (a line break
ends a sentence), and inside sentences the word whose hash is the smallest of `GAP`
words in a row is one, wherever that holds. So no `GAP` words in a row are without a
boundary, and which words are boundaries depends on `GAP` words around them. A
paragraph starts at every boundary and runs to the first boundary that brings it to
`WORDS` words; one more paragraph ends with the text. So every word of a text of
`WORDS` words or more is in a paragraph, and two documents with a passage of
3 * `GAP` + `WORDS` - 2 words in common have a paragraph inside it in common, wherever
the passage stands. Paragraphs that share a band of minhashes are compared by the
exact Jaccard similarity of their five-word shingles; links make clusters, and a
cluster's paragraphs go from all documents but its first.

Texts are put in blocks. A block sends its different shingles packed, one row for each
bucket of shingles, and gets back which of them another text has as well. Most paragraphs
resemble nothing. Two sets that reach the similarity have one of their smallest shingles
in common, the first n - ceil(similarity * n) + 1 of n, so only paragraphs with such a
shingle in another text are looked at; no link between texts is lost by that.

Most paragraphs that share a band overlap in one text. Those of one text are compared in
its block, by their places where no shingle is repeated. What is left are pairs that have
no text in common: each must have the wanted share of its shingles in other texts, and
only sets that have, once for all equal ones, send their bands to other blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from math import ceil, log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm.components import components
from quillwork.llm.hashing import (
    SHINGLE, MinHasher, combine, set_digests, shingle_hashes, signed, span_hashes, text_chunks, text_shingles, word_spans,
)
from quillwork.llm.minhash import SIMILARITY, near_links
from quillwork.llm.suffixes import cut_spans
from quillwork.session import materialise

WORDS = 20  # words of a paragraph at least
GAP = 11  # words in a row that hold a boundary at least
RECALL = 0.99  # of pairs at exactly the wanted similarity; more alike pairs are missed less
ROWS = 2  # minhashes in a band
BLOCK = 100_000  # paragraphs whose shingles are sorted together
BLOCK_BYTES = 2_000_000  # text that is looked at together; a longer text is a block of its own
BUCKET_BYTES = 16_000_000  # text for which there is one more bucket of shingles
PAIRS = 200_000  # pairs of sets that are compared together
MEMBERS = 5_000  # sets of a band that are compared in one task, 12 million pairs at most; the pairs of more are dealt out
PART_ROWS = 20_000  # sets in bands for which there is one more part


def tune_bands(percent: int = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """Fewest bands of `rows` minhashes in which sets of the similarity meet with the wanted probability."""
    return ceil(log(1 - recall) / log(1 - (percent / 100) ** rows))


_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True


def paragraphs_of(data: np.ndarray, offsets: np.ndarray, words: int = WORDS):
    """(text, first word, end word, starts, ends, hashes of words, first word of each text) of all paragraphs."""
    starts, ends, first = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    none = np.empty(0, np.int64)
    if not starts.size:
        return none, none, none, starts, ends, hashes, first
    head = np.zeros(starts.size, bool)
    head[first[:-1][np.diff(first) > 0]] = True
    head[1:] |= _ENDS[data[ends[:-1] - 1]]
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    head[1:] |= lines[starts[1:]] > lines[ends[:-1]]
    # without punctuation some words end a sentence, the same words everywhere
    head[1:] |= (hashes[:-1] & np.uint64(31)) == 0
    # smallest of every `GAP` words in a row of one sentence, the first of equal ones
    if starts.size >= GAP:
        sentence = np.cumsum(head)
        rows = np.lib.stride_tricks.sliding_window_view(hashes, GAP)
        inside = sentence[: rows.shape[0]] == sentence[GAP - 1 :]
        head[(np.arange(rows.shape[0]) + np.argmin(rows, axis=1))[inside]] = True
    start = np.flatnonzero(head)
    text = np.searchsorted(first, start, side="right") - 1
    # to the boundary that brings it to its length; every text ends in one
    stops = np.r_[start[1:], starts.size]
    end = stops[np.minimum(np.searchsorted(stops, start + words), stops.size - 1)]
    fits = (end <= first[text + 1]) & (end - start >= words)
    text, start, end = text[fits], start[fits], end[fits]
    # and what ends with the text, from the last boundary that leaves it its length
    long = np.flatnonzero(np.diff(first) >= words)
    stop = first[long + 1]
    begin = np.flatnonzero(head)
    begin = begin[np.searchsorted(begin, stop - words, side="right") - 1]
    text, start, end = np.r_[text, long], np.r_[start, begin], np.r_[end, stop]
    order = np.lexsort((end, start))
    text, start, end = text[order], start[order], end[order]
    new = np.ones(start.size, bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return text[new], start[new], end[new], starts, ends, hashes, first


def _shingle_ranges(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Shingle hash at every word; only those that do not cross a text's end mean anything."""
    grams, _ = shingle_hashes(hashes, np.array([0, hashes.size]))
    return grams


def _judge(grams: np.ndarray, common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(one of the smallest shingles is common, as many are as a link needs) for every paragraph; `common` of each shingle.

    Shingles are cut to 44 bits, as everywhere else in the search for candidates.
    """
    near, able = [np.empty(0, bool)], [np.empty(0, bool)]
    for low in range(0, a.size, BLOCK):
        x, n = a[low : low + BLOCK], (b - a)[low : low + BLOCK] - SHINGLE + 1
        at = np.repeat(x - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key = np.repeat(np.arange(x.size, dtype=np.uint64) << np.uint64(45), n)
        key |= (grams[at] >> np.uint64(20) << np.uint64(1)) | common[at].astype(np.uint64)
        key.sort()
        key = key[np.r_[True, key[1:] != key[:-1]]]
        unit, met = (key >> np.uint64(45)).astype(np.int64), (key & np.uint64(1)).astype(bool)
        size = np.bincount(unit, minlength=x.size)
        rank = np.arange(key.size) - np.repeat(np.cumsum(size) - size, size)
        small = rank <= (size * (100 - percent) // 100)[unit]  # n - ceil(percent of n) and one more
        near.append(np.bincount(unit[met & small], minlength=x.size) > 0)
        able.append(100 * np.bincount(unit[met], minlength=x.size) >= percent * size)
    return np.concatenate(near), np.concatenate(able)


def _digests(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name the set of shingles of every paragraph."""
    out = [(np.empty(0, np.uint64), np.empty(0, np.uint64))]
    for low in range(0, a.size, BLOCK):
        x, n = a[low : low + BLOCK], (b - a)[low : low + BLOCK] - SHINGLE + 1
        gram = grams[np.repeat(x - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        unit = np.repeat(np.arange(x.size), n)
        order = np.lexsort((gram, unit))
        gram, unit = gram[order], unit[order]
        new = np.r_[True, (gram[1:] != gram[:-1]) | (unit[1:] != unit[:-1])]
        out.append(set_digests(gram[new], np.searchsorted(unit[new], np.arange(x.size))))
    return np.concatenate([one for one, _ in out]), np.concatenate([two for _, two in out])


def _pack(values: np.ndarray) -> bytes:
    """Ascending values as differences, by the places of their bytes, compressed."""
    return zstandard.compress(np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel())


def _blocks(df: DataFrame) -> DataFrame:
    """(docs, sizes, body, bytes): the rows of (id, text), of about `BLOCK_BYTES` of text together.

    `body` has the bytes of the texts one after the other, compressed, as they are moved
    more than once, and `sizes` their numbers; `bytes` is the sum of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_chunks(batch.column(1), BLOCK_BYTES):
                lists = (batch.column(0).slice(row, end - row), pa.array(np.diff(offsets)))
                lists = [pa.ListArray.from_arrays(pa.array([0, end - row], pa.int32()), c) for c in lists]
                body = pa.array([zstandard.compress(data.tobytes(), 3)], pa.binary())
                yield pa.RecordBatch.from_arrays([*lists, body, pa.array([data.size])], names=["docs", "sizes", "body", "bytes"])

    return df.mapInArrow(run, "docs array<long>, sizes array<long>, body binary, bytes long")


def _opened(docs: pa.Array, sizes: pa.Array, body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, which texts have a key) of a block."""
    offsets = np.r_[0, np.cumsum(np.asarray(sizes))]
    return np.frombuffer(zstandard.decompress(body), np.uint8), offsets, np.asarray(docs.is_valid())


def _different(grams: np.ndarray, first: np.ndarray, keyed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(different shingles, which of them several texts have) of all texts with a key, in order, cut to 44 bits."""
    count = np.diff(first)
    text = np.repeat(np.arange(count.size), count)[: grams.size]
    inside = (np.arange(grams.size) + SHINGLE <= first[1:][text]) & keyed[text]
    gram, text = grams[inside] >> np.uint64(20), text[inside]
    order = np.argsort(gram, kind="stable")  # texts stay in order
    gram, text = gram[order], text[order]
    new = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]][: gram.size])
    if not new.size:
        return gram, np.empty(0, bool)
    return gram[new], text[new] != text[np.r_[new[1:], gram.size] - 1]


def _bucket_ends(gram: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket ends; buckets are ranges of shingles."""
    return np.searchsorted((gram * np.uint64(buckets) >> np.uint64(44)).astype(np.int64), np.arange(buckets), side="right")


def _sent_grams(blocks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, grams, several): the different shingles of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, docs, sizes, body in zip(*batch.columns, strict=True):
                data, offsets, keyed = _opened(docs.values, sizes.values, body.as_py())
                starts, ends, first = word_spans(data, offsets)
                gram, several = _different(_shingle_ranges(span_hashes(data, starts, ends), first), first, keyed)
                stop = _bucket_ends(gram, buckets)
                cuts = [(k, x, y) for k, (x, y) in enumerate(zip(np.r_[0, stop[:-1]], stop, strict=True)) if x < y]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([k for k, *_ in cuts], pa.int32()),
                        pa.array([block.as_py()] * len(cuts), pa.int64()),
                        pa.array([_pack(gram[x:y]) for _, x, y in cuts], pa.binary()),
                        pa.array([np.packbits(several[x:y]).tobytes() for _, x, y in cuts], pa.binary()),
                    ],
                    names=["bucket", "block", "grams", "several"],
                )

    return blocks.select("block", "docs", "sizes", "body").mapInArrow(run, "bucket int, block long, grams binary, several binary")


def _common_grams(sent: DataFrame) -> DataFrame:
    """(bucket, block, common): which of the shingles that a block sent are in more than one text."""

    def run(table: pa.Table) -> pa.Table:
        grams = [_unpack(g) for g in table.column("grams").to_pylist()]
        several = [np.unpackbits(np.frombuffer(s, np.uint8), count=g.size) for g, s in zip(grams, table.column("several").to_pylist(), strict=True)]
        ends = np.cumsum([g.size for g in grams])[:-1]
        _, back, times = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        common = times > 1
        common[back[np.concatenate(several).astype(bool)]] = True
        out = [np.packbits(c).tobytes() for c in np.split(common[back], ends)]
        return pa.Table.from_arrays([table.column("bucket"), table.column("block"), pa.array(out, pa.binary())], names=["bucket", "block", "common"])

    return sent.groupBy("bucket").applyInArrow(run, "bucket int, block long, common binary")


def _group_pairs(groups: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places with one value in `groups`, which is in order, about `PAIRS` at a time."""
    if not groups.size:
        return
    stop = np.searchsorted(groups, groups, side="right")
    count = stop - np.arange(groups.size) - 1
    upto = np.cumsum(count)
    low = 0
    while low < groups.size:
        high = max(low + 1, int(np.searchsorted(upto, upto[low] - count[low] + PAIRS, side="right")))
        n = count[low:high]
        one = np.repeat(np.arange(low, high), n)
        if one.size:
            yield one, one + 1 + np.arange(one.size) - np.repeat(np.cumsum(n) - n, n)
        low = high


def _stars(groups: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of the first place, then of one in the middle and of the last one, with all others of one value in `groups`."""
    if not groups.size:
        return
    new = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    n = np.diff(np.r_[new, groups.size])
    places = np.arange(groups.size)
    for center in (new, new + n // 2, new + n - 1):
        center = np.repeat(center, n)
        for low in range(0, groups.size, PAIRS):
            part = slice(low, low + PAIRS)
            other = center[part] != places[part]
            yield center[part][other], places[part][other]


def _similar(names: np.ndarray, first: np.ndarray, one: np.ndarray, two: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sets reach the similarity; set i is `names[first[i]:first[i + 1]]`, small numbers without repeats."""
    out = np.zeros(one.size, bool)
    size = np.diff(first)
    fits = np.flatnonzero(100 * np.minimum(size[one], size[two]) >= percent * np.maximum(size[one], size[two]))
    for low in range(0, fits.size, PAIRS):
        at = fits[low : low + PAIRS]
        both = np.stack([one[at], two[at]], axis=1).ravel()
        n = size[both]
        place = np.repeat(first[both] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key = (np.repeat(np.arange(both.size) >> 1, n) << 40) | names[place]
        key.sort()
        common = np.bincount(key[1:][key[1:] == key[:-1]] >> 40, minlength=at.size)
        out[at] = 100 * common >= percent * (size[one[at]] + size[two[at]] - common)
    return out


def _least(n: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Smallest member of the component of each of `n`."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[one], label[two])
        new = label.copy()
        np.minimum.at(new, label[one], low)
        np.minimum.at(new, label[two], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _within_texts(grams: np.ndarray, a: np.ndarray, b: np.ndarray, keys: np.ndarray, text: np.ndarray, member: np.ndarray, percent: int) -> np.ndarray:
    """Smallest set of the component of each set, by links of sets that a text has both of and that share a band.

    Set i has the shingles of words `a[i]` to `b[i]` and the bands `keys[i]`; `text` and
    `member` tell in which text is which set. Pairs of a band of a text that has very many
    different sets in it are as many as their square.
    """
    size = b - a - SHINGLE + 1
    # up to here shingles from a place on are all different
    order = np.argsort(grams, kind="stable")
    again = np.full(grams.size + 1, grams.size)
    again[order[:-1]] = np.where(grams[order[1:]] == grams[order[:-1]], order[1:], grams.size)
    fresh = np.minimum.accumulate(again[::-1])[::-1]
    both = np.unique((text.astype(np.int64) << 32) | member)
    text, member = both >> 32, both & ((1 << 32) - 1)
    bucket, text, member = keys[member].ravel(), np.repeat(text, keys.shape[1]), np.repeat(member, keys.shape[1])
    order = np.lexsort((bucket, text))
    bucket, text, member = bucket[order], text[order], member[order]
    group = np.cumsum(np.r_[True, (bucket[1:] != bucket[:-1]) | (text[1:] != text[:-1])])
    links, others = [np.empty((0, 2), np.int64)], [np.empty(0, np.int64)]
    for i, j in _group_pairs(group):
        pairs = np.unique((np.minimum(member[i], member[j]) << 32) | np.maximum(member[i], member[j]))
        x, y = pairs >> 32, pairs & ((1 << 32) - 1)
        start, stop = np.minimum(a[x], a[y]), np.maximum(a[x] + size[x], a[y] + size[y])
        plain = fresh[start] >= stop
        common = np.maximum(np.minimum(a[x] + size[x], a[y] + size[y]) - np.maximum(a[x], a[y]), 0)
        near = plain & (100 * common >= percent * (size[x] + size[y] - common)) & (x != y)
        links.append(np.stack([x[near], y[near]], axis=1))
        others.append(pairs[~plain & (x != y)])
    others = np.unique(np.concatenate(others))
    if others.size:
        x, y = others >> 32, others & ((1 << 32) - 1)
        used, back = np.unique(np.r_[x, y], return_inverse=True)
        sets = [np.unique(grams[a[i] : a[i] + size[i]]) for i in used]
        first = np.cumsum([0, *[s.size for s in sets]])
        names = np.unique(np.concatenate(sets), return_inverse=True)[1]
        near = _similar(names, first, *np.split(back, 2), percent)
        links.append(np.stack([x[near], y[near]], axis=1))
    links = np.concatenate(links)
    return _least(a.size, links[:, 0], links[:, 1])


_LONGS, _INTS = pa.int64(), pa.int32()
# of the sets of a block, in order of their first paragraphs; `keys` are the bands of those that are `able` to have links to other texts
_SETS = {"one": _LONGS, "two": _LONGS, "low_doc": _LONGS, "high_doc": _LONGS, "root": _INTS, "text": _INTS, "at": _INTS, "stop": _INTS}
_SETS |= {"able": pa.bool_(), "keys": _LONGS}
_PLACES = {"row": _INTS, "low": _INTS, "high": _INTS, "member": _INTS}  # of its paragraphs
_KINDS = {_LONGS: "long", _INTS: "int", pa.bool_(): "boolean"}


def _looked_at(blocks: DataFrame, common: DataFrame, buckets: int, percent: int, recall: float) -> DataFrame:
    """(block, `_SETS`, `_PLACES`): paragraphs with a shingle of another text among their smallest, and their sets."""
    bands = tune_bands(percent, recall)
    hasher = MinHasher(bands * ROWS, seed=23)
    names = _SETS | _PLACES

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        none = pa.Table.from_arrays([pa.array([], t) for t in (_LONGS, *map(pa.list_, names.values()))], names=["block", *names])
        docs, sizes = (block.column(c).combine_chunks().flatten() for c in ("docs", "sizes"))
        data, offsets, keyed = _opened(docs, sizes, block.column("body")[0].as_py())
        text, a, b, starts, ends, hashes, first = paragraphs_of(data, offsets)
        text, a, b = text[keyed[text]], a[keyed[text]], b[keyed[text]]
        if not a.size:
            return none
        grams = _shingle_ranges(hashes, first)
        gram, _ = _different(grams, first, keyed)
        stop = _bucket_ends(gram, buckets)
        bits = dict(zip(found.column("bucket").to_pylist(), found.column("common").to_pylist(), strict=True))
        met = [np.unpackbits(np.frombuffer(bits[k], np.uint8), count=n) for k, n in enumerate(np.diff(stop, prepend=0)) if n]
        met = np.concatenate(met).astype(bool)
        met = met[np.minimum(np.searchsorted(gram, grams >> np.uint64(20)), gram.size - 1)]
        near, able = _judge(grams, met, a, b, percent)
        text, a, b, able = text[near], a[near], b[near], able[near]
        if not a.size:
            return none
        one, two = _digests(grams, a, b)
        order = np.lexsort((two, one))
        new = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]
        cut = np.flatnonzero(new)
        # sets stand by their first paragraphs, `head`; what lies between ranges has to be short below
        by = np.argsort(order[cut])
        head = order[cut][by]
        place = np.empty(by.size, np.int64)
        place[by] = np.arange(by.size)
        member = np.empty(a.size, np.int64)
        member[order] = place[np.cumsum(new) - 1]
        # ranges one after the other; each second result is the minimum over a paragraph
        pairs = np.stack([a[head], b[head] - SHINGLE + 1], axis=1).ravel()
        padded = np.append(grams, np.uint64(0))
        mins = np.zeros((head.size, bands * ROWS), np.uint64)
        with np.errstate(over="ignore"):
            for k, (flip, odd) in enumerate(zip(hasher.flip, hasher.odd, strict=True)):
                mins[:, k] = np.minimum.reduceat((padded ^ flip) * odd, pairs)[::2]
        keys = np.stack([combine(mins[:, k * ROWS : (k + 1) * ROWS], k) for k in range(bands)], axis=1)
        root = _within_texts(grams, a[head], b[head], keys, text, member, percent)
        doc = np.asarray(docs.fill_null(0))[text[order]]
        low, high = starts[a], ends[b - 1]
        columns = [signed(one[head]), signed(two[head]), np.minimum.reduceat(doc, cut)[by], np.maximum.reduceat(doc, cut)[by]]
        columns += [root, text[head], low[head], high[head], able[head], signed(keys[able[head]].ravel())]
        columns += [text, low - offsets[text], high - offsets[text], member]
        columns = [pa.array(c.astype(t.to_pandas_dtype(), copy=False)) for c, t in zip(columns, names.values(), strict=True)]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
        return pa.Table.from_arrays([block.column("block"), *lists], names=["block", *names])

    schema = ", ".join(["block long", *[f"{n} array<{_KINDS[t]}>" for n, t in names.items()]])
    texts = blocks.select("block", "docs", "sizes", "body").groupBy("block")
    return texts.cogroup(common.groupBy("block")).applyInArrow(run, schema)


def _node(block: int, place: np.ndarray) -> np.ndarray:
    return (block << 32) | place.astype(np.int64)


def _sets(looked: DataFrame, bands: int | None = None) -> DataFrame:
    """(node, one, two, low_doc, high_doc, root, able): one row for each set of a block.

    With `bands`, (node, text, buckets) of those that are able to have links to other texts.
    """
    names = ["one", "two", "low_doc", "high_doc", "root", "able"] if bands is None else ["text", "able", "keys"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, *lists in zip(*batch.columns, strict=True):
                block, lists = block.as_py(), dict(zip(names, (x.values for x in lists), strict=True))
                able = np.asarray(lists["able"])
                for name in {"root", "text"} & set(names):
                    lists[name] = pa.array(_node(block, np.asarray(lists[name])))
                if bands is None:
                    out = {"node": pa.array(_node(block, np.arange(able.size))), **lists}
                else:
                    own = np.flatnonzero(able)
                    ends = pa.array(np.arange(0, own.size * bands + 1, bands, dtype=np.int32))
                    out = {"node": pa.array(_node(block, own)), "text": lists["text"].take(pa.array(own))}
                    out["buckets"] = pa.ListArray.from_arrays(ends, lists["keys"])
                yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    schema = "node long, one long, two long, low_doc long, high_doc long, root long, able boolean"
    return looked.select("block", *names).mapInArrow(run, schema if bands is None else "node long, text long, buckets array<long>")


def _wanted_grams(df: DataFrame) -> DataFrame:
    """(node, root, grams) of (block, body, root, at, stop, wanted), `wanted` the places of sets in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body, *lists in zip(*batch.columns, strict=True):
                block, (root, at, stop, wanted) = block.as_py(), (np.asarray(x.values) for x in lists)
                raw = zstandard.decompress(body.as_py())
                for low in range(0, wanted.size, 1_000):
                    own = wanted[low : low + 1_000]
                    texts = pa.array([raw[x:y] for x, y in zip(at[own], stop[own], strict=True)], pa.binary())
                    offsets = np.frombuffer(texts.buffers()[1], np.int32)[: own.size + 1].astype(np.int64)
                    grams, first = text_shingles(np.frombuffer(texts.buffers()[2], np.uint8)[: offsets[-1]], offsets)
                    sets = [np.unique(grams[x:y]) for x, y in zip(first[:-1], first[1:], strict=True)]
                    ends = pa.array(np.cumsum([0, *[s.size for s in sets]]).astype(np.int32))
                    grams = pa.ListArray.from_arrays(ends, pa.array(signed(np.concatenate(sets))))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(_node(block, own)), pa.array(_node(block, root[own])), grams], names=["node", "root", "grams"]
                    )

    return df.select("block", "body", "root", "at", "stop", "wanted").mapInArrow(run, "node long, root long, grams array<long>")


def _band_links(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): roots of sets of (part, bucket, text, root, grams) and the smallest ones that links in the buckets connect them with.

    Sets of one text are taken as compared. Every set is first compared with a few sets of its
    bucket; after that only pairs that are not connected yet.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")
        bucket, text, root = (np.asarray(table.column(c).combine_chunks()) for c in ("bucket", "text", "root"))
        grams = table.column("grams").combine_chunks()
        names = np.unique(np.asarray(grams.flatten()), return_inverse=True)[1]
        first = np.r_[0, np.cumsum(np.asarray(grams.value_lengths()))]
        roots, own = np.unique(root, return_inverse=True)
        label = np.arange(roots.size)
        for i, j in chain(_stars(bucket), _group_pairs(bucket)):
            apart = (text[i] != text[j]) & (label[own[i]] != label[own[j]])
            i, j = i[apart], j[apart]
            near = _similar(names, first, i, j, percent)
            if near.any():
                one, two = np.r_[np.arange(roots.size), own[i[near]]], np.r_[label, own[j[near]]]
                label = _least(roots.size, one, two)
        moved = np.flatnonzero(label != np.arange(roots.size))
        return pa.Table.from_arrays([pa.array(roots[moved]), pa.array(roots[label[moved]])], names=["a", "b"])

    return rows.groupBy("part").applyInArrow(run, "a long, b long")


def _passages(df: DataFrame, key: str, text: str, percent: int, recall: float) -> DataFrame:
    """(docs, sizes, body, root, `_PLACES`, roots, first_docs) of every block: its rows, and what earlier documents have.

    A set whose root is in `roots` is in a cluster of several documents, the first of
    which is in `first_docs`.
    """
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    blocks = materialise(_blocks(rows).withColumn("block", F.monotonically_increasing_id()))
    # names of blocks that leave room for places in them
    blocks = blocks.withColumn("block", F.expr("shiftright(block, 33) * 65536 + (block & 8589934591)"))
    buckets = 1 + (blocks.agg(F.sum("bytes")).first()[0] or 0) // BUCKET_BYTES
    common = materialise(_common_grams(_sent_grams(blocks, buckets)))
    looked = materialise(_looked_at(blocks, common, buckets, percent, recall), "zstd")
    bands = tune_bands(percent, recall)
    sets = _sets(looked)
    # equal sets of all blocks are one, under the first of them
    same = ["one", "two"]
    classes = sets.groupBy(*same).agg(F.min("node").alias("node"), F.min("root").alias("least"), F.count("*").alias("n"), F.first("able").alias("able"))
    classes = materialise(classes.where("n > 1 or able"), "zstd")
    equal = sets.select(*same, "root").join(classes.where("n > 1").select(*same, "least"), same).where("root <> least")
    equal = materialise(equal.select(F.col("root").alias("a"), F.col("least").alias("b")).distinct())
    banded = _sets(looked, bands).join(classes.where("able").select("node"), "node", "left_semi")
    banded = materialise(banded.select("node", "text", F.explode("buckets").alias("bucket")), "zstd")
    # sets of one text were compared there
    several = banded.groupBy("bucket").agg(F.min("text").alias("x"), F.max("text").alias("y"), F.count("*").alias("n")).where("x <> y")
    named = materialise(banded.join(several.select("bucket", "n"), "bucket"))
    # as many as the block has sets
    wanted = named.select("node").distinct().groupBy(F.shiftright("node", 32).alias("block"))
    wanted = wanted.agg(F.collect_list(F.expr("cast(node & 4294967295L as int)")).alias("wanted"))
    places = looked.select("block", "root", "at", "stop").join(wanted, "block")
    grams = materialise(_wanted_grams(blocks.select("block", "body").join(places, "block")))
    parts = 1 + named.count() // PART_ROWS
    part = F.pmod(F.xxhash64("bucket"), F.lit(parts)).alias("part")
    few = named.where(F.col("n") <= MEMBERS).join(grams, "node")
    links = materialise(_band_links(few.select(part, "bucket", "text", "root", "grams"), percent))
    many = named.where(F.col("n") > MEMBERS).select("bucket", F.col("node").alias("id"))
    if not many.isEmpty():
        found = near_links(materialise(many), grams.select(F.col("node").alias("id"), "grams"), percent)
        for end in ("a", "b"):
            found = found.join(grams.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end)
        links = links.union(materialise(found.select("root_a", "root_b")))
    joined = components(equal.union(links)).withColumnRenamed("node", "root")
    docs = sets.groupBy("root").agg(F.min("low_doc").alias("low_doc"), F.max("high_doc").alias("high_doc"))
    docs = materialise(docs.join(joined, "root", "left").select("root", "low_doc", "high_doc", F.coalesce("component", "root").alias("cluster")))
    heads = docs.groupBy("cluster").agg(F.min("low_doc").alias("first_doc"), F.max("high_doc").alias("last_doc")).where("first_doc <> last_doc")
    listed = docs.join(heads.select("cluster", "first_doc"), "cluster").groupBy(F.shiftright("root", 32).alias("block"))
    listed = listed.agg(F.collect_list(F.struct(F.expr("cast(root & 4294967295L as int)").alias("root"), "first_doc")).alias("listed"))
    answers = listed.join(looked.select("block", "root", *_PLACES), "block")
    answers = answers.select("block", "root", *_PLACES, F.col("listed.root").alias("roots"), F.col("listed.first_doc").alias("first_docs"))
    return blocks.select("block", "docs", "sizes", "body").join(answers, "block", "left")


def _listed(columns: list, docs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, low, high, first_doc) of the paragraphs that an earlier document has, by row and place."""
    root, row, low, high, member, roots, firsts = (np.asarray(c.values) for c in columns)
    first_doc, found = np.zeros(root.size, np.int64), np.zeros(root.size, bool)
    first_doc[roots], found[roots] = firsts, True
    own = root[member]
    chosen = found[own] & (first_doc[own] != docs[row])
    out = (row[chosen], low[chosen], high[chosen], first_doc[own[chosen]])
    order = np.lexsort((out[2], out[1], out[0]))
    return tuple(x[order] for x in out)


def repeated_passages(
    df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = SIMILARITY, recall: float = RECALL
) -> DataFrame:
    """(doc, low, high, first_doc): byte spans of paragraphs that an earlier document has, nearly or exactly.

    `first_doc` is the smallest key in the paragraph's cluster; its own paragraphs
    are not listed. Repeats within one document are left to it. Rows that repeat a
    key are one document. A null text is empty; a null key takes no part. The key is a
    whole number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, *columns in zip(*batch.columns, strict=True):
                docs = np.asarray(docs.values.fill_null(0))
                row, low, high, first = _listed(columns, docs)
                out = [pa.array(x) for x in (docs[row], low, high, first)]
                yield pa.RecordBatch.from_arrays(out, names=["doc", "low", "high", "first_doc"])

    found = _passages(df, key, text, percent, recall).where("roots is not null")
    found = found.select("docs", "root", *_PLACES, "roots", "first_docs")
    return materialise(found.mapInArrow(run, "doc long, low int, high int, first_doc long").distinct())


def without_passages(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept, first_docs) of every row.

    `kept` is the text without its repeated passages, `first_docs` the documents that
    have them first. A null text is empty; a row with a null key keeps its text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, sizes, body, *columns in zip(*batch.columns, strict=True):
                docs, raw, ends = docs.values, zstandard.decompress(body.as_py()), np.cumsum(np.asarray(sizes.values))
                row, low, high, first = (np.empty(0, np.int64),) * 4
                if columns[-1].is_valid:
                    row, low, high, first = _listed(columns, np.asarray(docs.fill_null(0)))
                cut = np.searchsorted(row, np.arange(ends.size + 1))
                rows = [[], [], [], [], []]
                for i, (x, y) in enumerate(zip(np.r_[0, ends[:-1]], ends, strict=True)):
                    own = slice(cut[i], cut[i + 1])
                    kept, removed, runs = cut_spans(raw[x:y], list(zip(low[own].tolist(), high[own].tolist(), strict=True)))
                    values = (int(y - x), removed, runs, kept.decode(errors="ignore"), np.unique(first[own]).tolist())
                    for out, value in zip(rows, values, strict=True):
                        out.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [docs, *[pa.array(v, k) for v, k in zip(rows, kinds, strict=True)]],
                    names=["id", "n_bytes", "n_removed", "n_spans", "kept", "first_docs"],
                )

    found = _passages(df, key, text, SIMILARITY, RECALL)
    found = found.select("docs", "sizes", "body", "root", *_PLACES, "roots", F.col("first_docs").alias("firsts"))
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept string, first_docs array<long>"
    return found.mapInArrow(run, schema).withColumnRenamed("id", key)
