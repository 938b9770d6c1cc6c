"""Which of many names stand inside any of many texts: one automaton for a shard of names, one pass over the texts.

Texts stay where they are: no piece of them is shuffled or written. Every task builds
the automaton of a shard of names, reads its texts through it and reports each name
once. A name that was found leaves the automaton as soon as half of them have, so a
name that every text holds costs a few texts and not all. Names are dealt into shards
by their hash, `SHARD_CHARS` characters on average; each shard is a pass over the
texts, so memory follows the shard and not the list of names.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.session import materialise

SHARD_CHARS = 2_000_000


def _automaton(names: Sequence[str]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for i, name in enumerate(names):
        automaton.add_word(name, i)
    automaton.make_automaton()
    return automaton


class Finder:
    """Names not found so far; `read` gives those that a text adds."""

    def __init__(self, names: Sequence[str]) -> None:
        self.left = list(names)
        self._build()

    def _build(self) -> None:
        self.found = bytearray(len(self.left))
        self.missing = len(self.left)
        self.automaton = _automaton(self.left) if self.left else None

    def read(self, text: str) -> list[str]:
        if self.automaton is None:
            return []
        fresh = []
        for _, i in self.automaton.iter(text):
            if not self.found[i]:
                self.found[i] = 1
                fresh.append(self.left[i])
        self.missing -= len(fresh)
        if 2 * self.missing <= len(self.left):
            self.left = [n for n, gone in zip(self.left, self.found, strict=True) if not gone]
            self._build()
        return fresh


def names_inside(names: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct `token`s of `names` (column token) that are a substring of a text of `texts`, whatever its columns.

    Comparison is exact. Null texts hold nothing, an empty or null token is in nothing.
    """
    tokens = materialise(names.select("token").where("token <> ''").distinct())
    chars = tokens.agg(F.sum(F.char_length("token"))).first()[0] or 0
    shards = -(-int(chars) // SHARD_CHARS) or 1
    texts = texts.select(*[F.col(f"`{c}`").cast("string").alias(f"t{i}") for i, c in enumerate(texts.columns)])

    def search(listed: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(listed)
            for batch in batches:
                fresh = []
                for column in batch.columns:
                    for text in column.to_pylist():
                        if text:
                            fresh.extend(finder.read(text))
                    if not finder.left:
                        break
                yield pa.RecordBatch.from_arrays([pa.array(fresh, pa.string())], names=["token"])

        return texts.mapInArrow(run, "token string")

    found = None
    for shard in range(shards):
        here = tokens.where(F.pmod(F.xxhash64("token"), F.lit(shards)) == shard)
        listed = here.toArrow().column("token").to_pylist()
        part = search(listed)
        found = part if found is None else found.union(part)
    return found.distinct()
