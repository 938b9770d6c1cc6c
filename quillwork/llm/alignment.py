"""Tokens of two tokenizers laid against each other over the bytes of a text, in Arrow tables inside Spark tasks.

The token lists of a chunk of texts are flattened with the indices of their texts, the
lengths of the tokens' bytes summed up to end offsets. Tokens of both sides cover the
same bytes, so an end names a place in one text: the two sides meet in an Acero full
outer join on these ends. A row of it is one overlap of an A and a B token, a row that
both sides have ends a group. In how many texts an id pair overlaps is counted by
`Table.group_by` inside a task and added up by Spark.

For the per-text sums, the pairs of the highest counts (a bounded number, sent to
every task) are looked up in place; the rest travels and is joined, so that no pair is
left out and no table of unbounded size is broadcast.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm.bpe import byte_symbols, vocabulary
from quillwork.session import materialise

BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_VOCABULARY = "piece_bpe_32k.model"

# Fixed values of the vocabulary formats.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE_SPACE = "▁"
PIECE_BYTE = re.compile(r"<0x([0-9A-F]{2})>")

CHUNK_BYTES = 2_000_000  # text bytes aligned together; a longer text is aligned alone
SENT_PAIRS = 1 << 18  # most pairs that are sent to the tasks with their counts
PARTIAL_PAIRS = 1 << 21  # pairs that a task counts before it hands them on
KEPT_SEGMENTS = 200_000  # segments a worker remembers; when full it starts over
KEPT_CHARS = 100  # longer segments are not remembered

# all but characters whose class is the same in every Unicode version of the last fifteen years
_UNSETTLED = re.compile("[^\u0000-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")
_SEGMENT = re.compile(" *[^ ]+| +")


def _flat(ids: list) -> tuple[pa.Array, np.ndarray]:
    return pa.array(np.concatenate([np.empty(0, np.int32), *ids])), np.array([len(i) for i in ids], np.int64)


class ByteSide:
    """Byte-level BPE of a tokenizers file, without special tokens.

    Texts of characters that all Unicode versions class alike are encoded by the
    faster tiktoken from the same vocabulary, if its ids follow its merges.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = {symbol: i for i, symbol in enumerate(byte_symbols())}
        model = spec["model"]
        bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in model["vocab"].items()}
        size = max([*bytes_of, *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes = pa.array([bytes_of.get(i, b"") for i in range(size)], pa.large_binary())
        self.fast = None
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [model["vocab"][a + b] for a, b in merges]
        kind = spec["pre_tokenizer"] or {}
        plain = spec["normalizer"] is None and kind.get("type") == "ByteLevel" and kind.get("use_regex", True)
        if plain and not kind.get("add_prefix_space") and made == sorted(made) and not model.get("ignore_merges"):
            import tiktoken

            ranks = {b: i for i, b in bytes_of.items()}
            self.fast = tiktoken.Encoding("bytes", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast and not _UNSETTLED.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def encode_all(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """(ids of all texts with a space before each, number of ids of every text)."""
        return _flat([self.encode(" " + t) for t in texts])


class PieceSide:
    """BPE with byte fallback of a sentencepiece file, which puts the space before a text itself.

    If no piece has a space behind another character, no merge crosses such a place:
    texts are cut there, and a segment of spaces and a word is encoded once.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = pa.array([self.bytes_of(p) for p in pieces], pa.large_binary())
        self.space = self.model.piece_to_id(PIECE_SPACE)
        self.cuts = not any(PIECE_SPACE in p.lstrip(PIECE_SPACE) for p in pieces)
        self.kept: dict[str, list[int]] = {}

    @staticmethod
    def bytes_of(piece: str) -> bytes:
        byte = PIECE_BYTE.fullmatch(piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace(PIECE_SPACE, " ").encode()

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), np.int32)

    def encode_all(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """(ids of all texts with a space before each, number of ids of every text)."""
        if not self.cuts or any(PIECE_SPACE in t for t in texts):
            return _flat([self.encode(t) for t in texts])
        split = [_SEGMENT.findall(" " + t) for t in texts]
        coded = pa.array([s for segments in split for s in segments], pa.large_string()).dictionary_encode()
        segments = coded.dictionary.to_pylist()
        if len(self.kept) > KEPT_SEGMENTS:
            self.kept = {}
        new = [s for s in segments if s not in self.kept]
        # a segment begins with the space that the model puts there
        found = dict(zip(new, self.model.encode([s[1:] for s in new], num_threads=1) if new else [], strict=True))
        if " " in found:
            found[" "] = [self.space]
        lists = pa.array([found[s] if s in found else self.kept[s] for s in segments], pa.large_list(pa.int32()))
        self.kept.update((s, i) for s, i in found.items() if len(s) <= KEPT_CHARS)
        count = np.asarray(pc.list_value_length(lists), dtype=np.int64)[np.asarray(coded.indices)]
        at = np.r_[0, np.cumsum(count)][np.r_[0, np.cumsum([len(s) for s in split])].astype(np.int64)]
        return pc.list_flatten(lists.take(coded.indices)), np.diff(at)


@lru_cache(maxsize=4)
def byte_side(name: str) -> ByteSide:
    return ByteSide(vocabulary(name))


@lru_cache(maxsize=4)
def piece_side(name: str) -> PieceSide:
    return PieceSide(vocabulary(name))


def _joined(side: pa.Array, ids: pa.Array) -> tuple[pa.Array, memoryview]:
    """(length of each token's bytes, all of them joined)."""
    tokens = side.take(ids)
    buffer = tokens.buffers()[2]
    return pc.binary_length(tokens), memoryview(buffer if buffer is not None else b"")


@lru_cache(maxsize=2)
def _marked(ids: int) -> pa.Array:
    """Every id as text with each mark behind it."""
    return pa.array([f"{i}{mark}" for i in range(ids) for mark in ",|;"], pa.large_string())


class Aligned:
    """The alignment of the texts of a chunk."""

    def __init__(self, texts: list[str | None], a: ByteSide, b: PieceSide) -> None:
        self.n, self.ids = len(texts), max(len(a.bytes), len(b.bytes))
        self.rows = np.array([i for i, t in enumerate(texts) if t], np.int64)
        texts = [t for t in texts if t]
        coded = [(side.bytes, *side.encode_all(texts)) for side in (a, b)]
        same = np.ones(len(texts), bool)
        for side, ids, per in coded:
            same &= self._covers(texts, side, ids, per)
        self.rows = self.rows[same]
        lists = []
        for _, ids, per in coded:
            if not same.all():
                ids = ids.filter(pa.array(np.repeat(same, per)))
            lists.append(pa.LargeListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per[same])], pa.int64()), ids))
        self.a, self.b = (pc.list_flatten(x) for x in lists)
        self.of_a, self.of_b = (pc.list_parent_indices(x) for x in lists)
        # summed over the chunk, an end stands for its text and the end inside it
        ends_a, ends_b = (
            pc.cumulative_sum(pc.binary_length(side.bytes.take(ids)).cast(pa.int64())) for side, ids in ((a, self.a), (b, self.b))
        )
        side_a = pa.table({"end": ends_a, "a": self.a, "text": self.of_a})
        side_b = pa.table({"end": ends_b, "b": self.b})
        met = side_a.join(side_b, "end", join_type="full outer", use_threads=False).sort_by("end")
        in_a, in_b = (np.asarray(pc.is_valid(met[c])) for c in ("a", "b"))
        # a group ends where both sides do
        cut = in_a & in_b
        group = np.cumsum(cut) - cut
        self.group_a, self.group_b, self.n_groups = group[in_a], group[in_b], int(cut.sum())
        # the token over an end of the other side is the next one that ends
        over = [pc.fill_null_backward(met[c]) for c in ("text", "a", "b")]
        pair = pc.add(pc.multiply(over[1].cast(pa.int64()), len(b.bytes)), over[2].cast(pa.int64()))
        self.links = pa.table({"text": over[0], "pair": pair})

    @staticmethod
    def _covers(texts: list[str], side: pa.Array, ids: pa.Array, per: np.ndarray) -> np.ndarray:
        """Whether the joined bytes of each text's tokens are the text with a space before it."""
        lengths, data = _joined(side, ids)
        at = np.r_[0, np.cumsum(np.asarray(lengths))][np.r_[0, np.cumsum(per)]].tolist()
        return np.array([bytes(data[at[i] : at[i + 1]]) == b" " + t.encode() for i, t in enumerate(texts)], bool)

    def counts(self) -> dict[str, np.ndarray]:
        """n_a, n_b, n_groups and n_links of every text, zeros where it has no tokens."""
        full, out = len(self.rows), {}
        of_a = np.asarray(self.of_a, dtype=np.int64)
        first = of_a[np.diff(self.group_a, prepend=-1) > 0]
        for name, owners in (("n_a", of_a), ("n_b", self.of_b), ("n_groups", first), ("n_links", self.links["text"])):
            out[name] = np.zeros(self.n, np.int64)
            out[name][self.rows] = np.bincount(np.asarray(owners, dtype=np.int64), minlength=full)
        return out

    def pairs(self) -> tuple[pa.Array, pa.Array]:
        """(distinct pairs, how often each is linked) of every text."""
        seen = self.links.group_by(["text", "pair"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
        owner = np.asarray(seen["text"], dtype=np.int64)
        order = np.argsort(owner, kind="stable")
        per = np.zeros(self.n, np.int64)
        per[self.rows] = np.bincount(owner, minlength=len(self.rows))
        offsets = pa.array(np.r_[0, np.cumsum(per)], pa.int32())
        values = [np.asarray(seen[c])[order] for c in ("pair", "count_all")]
        return tuple(pa.ListArray.from_arrays(offsets, pa.array(v, pa.int64())) for v in values)

    def groups(self) -> list[str]:
        """`a1,a2|b1;a3|b2,b3` of every text, empty where it has no tokens."""
        out = [""] * self.n
        a, b = np.asarray(self.a, dtype=np.int64), np.asarray(self.b, dtype=np.int64)
        if not a.size:
            return out
        # before a token of A stand those of B in earlier groups, before one of B also those of A in its own
        per_a, per_b = (np.bincount(g, minlength=self.n_groups) for g in (self.group_a, self.group_b))
        at_a = np.arange(a.size) + (np.cumsum(per_b) - per_b)[self.group_a]
        at_b = np.arange(b.size) + np.cumsum(per_a)[self.group_b]
        code = np.empty(a.size + b.size, np.int64)
        code[at_a] = 3 * a + (np.diff(self.group_a, append=self.n_groups) > 0)
        code[at_b] = 3 * b + 2 * (np.diff(self.group_b, append=self.n_groups) > 0)
        written = _marked(self.ids).take(pa.array(code))
        _, offsets, data = written.buffers()
        ends = np.frombuffer(offsets, np.int64)[1 : len(written) + 1]
        last = np.cumsum(np.bincount(np.asarray(self.of_b), minlength=len(self.rows))) - 1
        data, start = memoryview(data), 0
        for row, end in zip(self.rows.tolist(), ends[at_b[last]].tolist(), strict=True):
            out[row] = bytes(data[start : end - 1]).decode()
            start = end
        return out


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= CHUNK_BYTES:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def aligned_texts(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    a: str = BYTE_VOCABULARY,
    b: str = PIECE_VOCABULARY,
    digests: bool = False,
) -> DataFrame:
    """Key, n_a, n_b, n_groups, n_links, `groups`, `pairs` and `times` of every row.

    `groups` is the alignment as `a1,a2|b1;a3|b2,b3`, its digest with `digests`; `pairs`
    are the distinct overlapping id pairs as A id times the size of vocabulary B plus B
    id, `times` their overlaps. A text that is null or empty, or whose tokens of either
    side do not join to the text with a space before it, has no tokens: zeros, empty
    strings and arrays. Rows are independent, null and repeated keys stay, other columns
    are left out. `a` and `b` are paths that exist on every executor or names of
    installed vocabulary files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b = byte_side(a), piece_side(b)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for first, end in _chunks(texts):
                aligned = Aligned(texts[first:end], side_a, side_b)
                groups = aligned.groups()
                if digests:
                    groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                counts = aligned.counts()
                columns = [batch.column(0).slice(first, end - first), *(pa.array(counts[c]) for c in COUNTS)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(groups, pa.string()), *aligned.pairs()],
                    names=[key, *COUNTS, "groups", "pairs", "times"],
                )

    rows = df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string"))
    fields = ", ".join(f"{c} long" for c in COUNTS)
    head = f"`{key}` {df.schema[key].dataType.simpleString()}"
    return rows.mapInArrow(run, f"{head}, {fields}, groups string, pairs array<long>, times array<long>")


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """(pair, n, best): in how many rows of `aligned` each pair is, and whether no pair of its A id is in more.

    `width` is the size of vocabulary B.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.table({"pair": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        for batch in batches:
            seen = pa.table({"pair": pc.list_flatten(batch.column(0))}).group_by("pair").aggregate([([], "count_all")])
            held = pa.concat_tables([held, seen.select(["pair", "count_all"]).rename_columns(["pair", "n"])])
            if held.num_rows > PARTIAL_PAIRS:
                held = held.group_by("pair").aggregate([("n", "sum")]).select(["pair", "n_sum"]).rename_columns(["pair", "n"])
                if held.num_rows > PARTIAL_PAIRS // 2:
                    yield from held.to_batches()
                    held = held.slice(0, 0)
        held = held.group_by("pair").aggregate([("n", "sum")]).select(["pair", "n_sum"]).rename_columns(["pair", "n"])
        yield from held.to_batches()

    parts = aligned.select("pairs").mapInArrow(partial, "pair long, n long")
    counts = materialise(parts.groupBy("pair").agg(F.sum("n").alias("n")))
    # one row for each id of vocabulary A at most
    highest = counts.groupBy(F.floor(F.col("pair") / width).alias("a")).agg(F.max("n").alias("highest"))
    joined = counts.join(F.broadcast(highest), F.floor(F.col("pair") / width) == F.col("a"))
    return joined.select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def _sent(counts: DataFrame) -> pa.Table:
    """The pairs of the highest counts, `SENT_PAIRS` at most, by pair. Pairs of about the same count go together."""
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(((r["step"], r["count"]) for r in counts.groupBy(step.alias("step")).count().collect()), reverse=True)
    total, least = 0, None
    for at, rows in sizes:
        total += rows
        if total > SENT_PAIRS:
            break
        least = at
    if least is None:
        return counts.limit(0).toArrow()
    return counts.where(step >= least).toArrow().sort_by("pair")


def link_sums(aligned: DataFrame, width: int) -> DataFrame:
    """`aligned` with n_best and count_sum in place of its arrays.

    A pair's count is the number of rows that hold it. n_best are the links whose count is
    the highest of their A id, ties included; count_sum adds the counts of all links.
    """
    names = [c for c in aligned.columns if c not in ("pairs", "times")]
    aligned = materialise(aligned.withColumn("__row", F.monotonically_increasing_id()))
    counts = materialise(pair_counts(aligned, width))
    sent = _sent(counts)
    known = np.asarray(sent["pair"], dtype=np.int64)
    # a last entry, so that a place behind all pairs is one too
    n = np.r_[np.asarray(sent["n"], dtype=np.int64), 0]
    best = np.r_[np.asarray(sent["best"].combine_chunks(), dtype=bool), False]
    known = np.r_[known, np.iinfo(np.int64).max]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            pairs, times = batch.column("pairs"), batch.column("times")
            owner = np.asarray(pc.list_parent_indices(pairs), dtype=np.int64)
            pair, often = (np.asarray(pc.list_flatten(x), dtype=np.int64) for x in (pairs, times))
            at = np.searchsorted(known, pair)
            found = known[at] == pair
            n_best, total = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
            np.add.at(n_best, owner[found], often[found] * best[at[found]])
            np.add.at(total, owner[found], often[found] * n[at[found]])
            rest = ~found
            offsets = pa.array(np.r_[0, np.cumsum(np.bincount(owner[rest], minlength=rows))], pa.int32())
            left = pa.StructArray.from_arrays([pa.array(pair[rest]), pa.array(often[rest])], names=["pair", "times"])
            columns = [batch.column("__row"), pa.array(n_best), pa.array(total), pa.ListArray.from_arrays(offsets, left)]
            yield pa.RecordBatch.from_arrays(columns, names=["__row", "n_best", "count_sum", "rest"])

    schema = "__row long, n_best long, count_sum long, rest array<struct<pair long, times long>>"
    looked = materialise(aligned.select("__row", "pairs", "times").mapInArrow(look_up, schema))
    rest = looked.select("__row", F.explode("rest").alias("r")).select("__row", "r.pair", "r.times").join(counts, "pair")
    rest = rest.select(
        "__row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum")
    )
    sums = looked.drop("rest").union(rest).groupBy("__row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.drop("pairs", "times").join(sums, "__row").select(*[F.col(f"`{c}`") for c in names], "n_best", "count_sum")


def cross_tokens(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    a: str = BYTE_VOCABULARY,
    b: str = PIECE_VOCABULARY,
    digests: bool = True,
) -> DataFrame:
    """Key, n_a, n_b, n_groups, n_links, `groups` (its digest with `digests`), n_best and count_sum of every row.

    As `aligned_texts` with the sums of `link_sums` over all rows of `df`; a repeated row
    counts as often as it is there. No rows give none.
    """
    width = len(piece_side(b).bytes)
    return link_sums(aligned_texts(df, key, text, a, b, digests), width)
