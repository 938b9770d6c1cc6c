"""Set operations over rows and text channels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.functions.text import strip, word_count
from quillwork.operators.upkeep import replace_by_key

# Channel order and headings of a merged text.
CHANNELS = {
    "transcript": "=== TRANSCRIPT (AUDIO) ===",
    "subtitles": "=== SUBTITLES ===",
    "screen": "=== ON-SCREEN TEXT (OCR) ===",
}


def merge_text_channels(df: DataFrame, channels: Mapping[str, str] = CHANNELS) -> DataFrame:
    """Join the non-empty channel columns under their headings; count and hash.

    A row without any text keeps its place with `error` set.
    """
    parts = [
        F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(h + "\n"), F.col(c)))
        for c, h in channels.items()
    ]
    merged = df.withColumn("merged_text", strip(F.concat_ws("\n\n", *parts)))
    text = F.col("merged_text")
    return merged.withColumns(
        {
            "word_count": word_count(text),
            "character_count": F.char_length(text),
            "checksum": F.sha2(text, 256),
            "error": F.when(text == "", "no text could be extracted"),
        }
    )


def dropped_rows(original: DataFrame, kept: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `original` that are not among the kept keys."""
    return original.join(kept.select(*keys), list(keys), "left_anti")


def union_findings(findings: Mapping[str, DataFrame]) -> DataFrame:
    """Findings (target, detail, severity) of several checks with their `check`."""
    labelled = [
        df.select(F.lit(name).alias("check"), "target", "detail", "severity")
        for name, df in findings.items()
    ]
    return reduce(DataFrame.unionByName, labelled)


def replace_membership(
    bridge: DataFrame, wanted: DataFrame, known: DataFrame, owner: str, member: str
) -> DataFrame:
    """New members for the owners listed in `wanted`; unknown members are ignored."""
    valid = wanted.join(known.select(member), member, "left_semi").select(owner, member).distinct()
    owners = wanted.select(owner).distinct()
    return replace_by_key(bridge.select(owner, member), valid, [owner], owners)
