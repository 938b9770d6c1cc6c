"""Byte-pair encoding and decoding with batched numpy merge rounds.

The vocabulary file is data, its path a parameter; nothing of it is trained or
copied. The symbols of many words lie in one flat array. A round looks up the
rank of every neighbouring pair by binary search over the sorted pair keys and
merges the lowest-ranked pair of every word at once. Each Python worker
keeps the words it has encoded, so a word costs its rounds once.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the vocabulary format "word BPE, lower case, white space dropped".
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE_PATTERN = r"\s+"

CACHED_WORDS = 200_000  # pieces and words after which a worker keeps only those still in use, for as many more
FLAT_WORDS = 50_000  # words merged in one flat array


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else one above U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def lower_each(text: str) -> str:
    """Lower case character by character: a final capital sigma gets no special form."""
    if "Σ" in text:
        text = text.replace("Σ", "σ")
    return text.lower()


class WordBpe:
    """Encoder and decoder for one vocabulary file with end-of-word symbols."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.names = {i: str(i) for i in self.tokens}
        size = max(self.tokens) + 1
        self.size = np.int64(size)
        symbols = byte_symbols()
        self.inner = np.array([self.vocab[s] for s in symbols], np.int32)
        self.final = np.array([self.vocab[s + self.suffix] for s in symbols], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([self.vocab[a] * size + self.vocab[b] for a, b in pairs], np.int64)
        made = np.array([self.vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made
        # special tokens are found in the raw text, before any normalisation
        self.split_special = regex.compile("|".join(f"({regex.escape(s)})" for s in self.special)) if self.special else None
        # remembered under a name with a blank, which no piece has
        self.named = {s: f" {s}" for s in self.special}
        self.words = regex.compile(WORD_PATTERN)
        self.spaces = regex.compile(SPACE_PATTERN)
        self.cache: dict[str, tuple[int, str, str]] = {}
        self.forget()

    def forget(self) -> None:
        """Keep what was used since the last time for one more turn."""
        self.old = self.cache
        self.cache = {self.named[s]: (1, str(i), s) for s, i in self.special.items()}

    def unknown(self, pieces: set[str]) -> list[str]:
        """The pieces that are not remembered; those of the last turn are taken over."""
        missing = []
        for piece in pieces:
            if piece not in self.cache:
                if piece in self.old:
                    self.cache[piece] = self.old[piece]
                else:
                    missing.append(piece)
        return missing

    def merge(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """Token ids of all words in a row, and where each word ends; the words are non-empty byte strings."""
        lengths = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(lengths)
        symbols = self.inner[raw]
        symbols[ends - 1] = self.final[raw[ends - 1]]
        word = np.repeat(np.arange(len(words)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        never = np.int64(len(self.keys))
        while symbols.size:
            # rank of each symbol with its right neighbour in the same word
            rank = np.full(symbols.size, never)
            joined = np.flatnonzero(word[:-1] == word[1:])
            key = symbols[joined] * self.size + symbols[joined + 1]
            at = np.minimum(np.searchsorted(self.keys, key), never - 1)
            found = self.keys[at] == key
            rank[joined[found]] = self.rank[at[found]]
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, first)
            spans = np.diff(np.r_[first, symbols.size])
            live = best < never
            if not live.all():
                gone = np.repeat(~live, spans)
                done.append((word[gone], symbols[gone]))
            if not live.any():
                break
            hit = (rank == np.repeat(best, spans)) & (rank < never)
            place = np.flatnonzero(hit)
            # in a run such as "aaa" pairs overlap: take every second from the run's start
            starts = np.r_[True, np.diff(place) != 1]
            run = np.flatnonzero(starts)
            offset = np.arange(place.size) - np.repeat(run, np.diff(np.r_[run, place.size]))
            place = place[offset % 2 == 0]
            symbols[place] = self.made[rank[place]]
            keep = np.repeat(live, spans)
            keep[place + 1] = False
            symbols, word = symbols[keep], word[keep]
        words_done = np.concatenate([w for w, _ in done]) if done else np.empty(0, np.int64)
        ids = np.concatenate([s for _, s in done]) if done else np.empty(0, np.int32)
        order = np.argsort(words_done, kind="stable")
        return ids[order].tolist(), np.cumsum(np.bincount(words_done, minlength=len(words))).tolist()

    def learn(self, pieces: set[str]) -> None:
        """Encode white-space free pieces that are not remembered yet."""
        new = self.unknown(pieces)
        split = [self.words.findall(p) for p in new]
        # a word by itself is a piece, too
        words = self.unknown({w for ws in split for w in ws})
        for i in range(0, len(words), FLAT_WORDS):
            part = words[i : i + FLAT_WORDS]
            ids, ends = self.merge([w.encode() for w in part])
            names, tokens = list(map(self.names.__getitem__, ids)), list(map(self.tokens.__getitem__, ids))
            start = 0
            for word, end in zip(part, ends, strict=True):
                self.cache[word] = (end - start, " ".join(names[start:end]), " ".join(tokens[start:end]))
                start = end
        for piece, ws in zip(new, split, strict=True):
            if piece not in self.cache:
                found = [self.cache[w] for w in ws]
                self.cache[piece] = (sum(f[0] for f in found), " ".join([f[1] for f in found]), " ".join([f[2] for f in found]))

    def pieces(self, text: str) -> list[str]:
        """Normalised text cut at white space, which no word crosses."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return [p for p in self.spaces.split(lower_each(text)) if p]

    def segments(self, text: str) -> list[str]:
        """Text between special tokens, and the special tokens themselves."""
        if not any(mark in text for mark in self.special):
            return [text]
        return [s for s in self.split_special.split(text) if s]

    def encode_batch(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, ids joined by blanks, decoded text) of every text, in order."""
        split = []
        for text in texts:
            parts = []
            for segment in self.segments(text):
                if segment in self.special:
                    parts.append(self.named[segment])
                else:
                    parts.extend(self.pieces(segment))
            split.append(parts)
        wanted = {p for parts in split for p in parts}
        if len(self.cache) > CACHED_WORDS:
            self.forget()
        self.learn(wanted)
        for parts in split:
            found = [self.cache[p] for p in parts]
            yield sum(f[0] for f in found), " ".join([f[1] for f in found]), " ".join([f[2] for f in found])

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in next(self.encode_batch([text]))[1].split()]

    def decode(self, ids: list[int]) -> str:
        """The tokens of the ids joined by blanks; the vocabulary names no other decoder. Unknown ids add nothing."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)


def vocabulary(name: str) -> str:
    """A path as it is; the name of an installed vocabulary file gives its place on this machine."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    return WordBpe(vocabulary(path))


BATCH_CHARS = 4_000_000  # characters encoded together


def _by_size(texts: list[str | None]) -> Iterator[list[str]]:
    part, size = [], 0
    for text in texts:
        part.append(text or "")
        size += len(part[-1])
        if size >= BATCH_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_documents(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, `ids` and `decoded` of every row. Null is the empty text, which has no ids.

    `path` must exist on every executor, or name an installed vocabulary file. Rows are independent: repeated rows give
    repeated results and a null key stays null. Other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            done = 0
            for part in _by_size(batch.column(1).to_pylist()):
                rows = list(bpe.encode_batch(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, len(part)),
                        pa.array([[int(i) for i in ids.split()] for _, ids, _ in rows], pa.list_(pa.int32())),
                        pa.array([decoded for *_, decoded in rows], pa.string()),
                    ],
                    names=[key, "ids", "decoded"],
                )
                done += len(part)

    rows = df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string"))
    return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>, decoded string")


def encode_digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """Key, n_tokens, ids_sha256 and decoded_sha256, and the `ids` if asked for; else as `encode_documents`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            done = 0
            for part in _by_size(batch.column(1).to_pylist()):
                rows = list(bpe.encode_batch(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, len(part)),
                        pa.array([n for n, *_ in rows], pa.int64()),
                        pa.array([hashlib.sha256(ids.encode()).hexdigest() for _, ids, _ in rows], pa.string()),
                        pa.array([hashlib.sha256(text.encode()).hexdigest() for *_, text in rows], pa.string()),
                        *[pa.array([np.fromstring(i, np.int32, sep=" ") for _, i, _ in rows], pa.list_(pa.int32()))] * ids,
                    ],
                    names=[key, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids],
                )
                done += len(part)

    rows = df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string"))
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return rows.mapInArrow(run, schema + ", ids array<int>" * ids)
