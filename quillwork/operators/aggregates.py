"""Counts, facets, groups and agreement between sources.

All are hash aggregates with a map-side part; groups of unbounded size come out
as rows, never as one array.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions.numbers import round_binary, steady_mean
from quillwork.functions.text import normalise_ws_lower, strip
from quillwork.operators.ordered import number_rows

PART_ROWS = 1_000


def count_when(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def status_rollup(
    df: DataFrame, buckets: Mapping[str, Sequence[str]], col: str = "status"
) -> DataFrame:
    """One row: `total`, and per bucket the rows in any of its statuses."""
    counts = [count_when(F.col(col).isin(list(s))).alias(n) for n, s in buckets.items()]
    return df.agg(F.count(F.lit(1)).alias("total"), *counts)


def type_rollup(
    df: DataFrame, kinds: Sequence[str], col: str, document: str, approximate: bool = False
) -> DataFrame:
    """One row: rows per kind and the number of distinct documents."""
    distinct = F.approx_count_distinct(document) if approximate else F.countDistinct(document)
    counts = [count_when(F.col(col) == k).alias(k) for k in kinds]
    return df.agg(F.count(F.lit(1)).alias("total"), *counts, distinct.alias("documents"))


def child_counts(nodes: DataFrame, key: str = "document_id") -> DataFrame:
    return nodes.filter("parent_id is not null").groupBy(key, "parent_id").agg(
        F.count(F.lit(1)).alias("children")
    )


def filtered_total(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(condition).agg(F.count(F.lit(1)).alias("total"))


def unread_count(df: DataFrame, flag: str = "is_read") -> DataFrame:
    return df.agg(count_when(~F.col(flag)).alias("unread"))


def counts_per(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def facets(df: DataFrame, *cols: str) -> DataFrame:
    """Distinct non-empty values of each column as sorted rows (facet, value)."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in cols])
    )
    rows = df.select(pairs.alias("__p")).select("__p.*").filter("value <> ''")
    return rows.distinct().orderBy("facet", "value")


def analysis_summary(frames: DataFrame, questions: DataFrame, keys: Sequence[str]) -> DataFrame:
    fresh = ~F.col("is_duplicate")
    seen = frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames_total"),
        count_when(fresh).alias("frames_unique"),
        count_when(fresh & F.col("is_question")).alias("frames_question"),
    )
    made = questions.groupBy(*keys).agg(F.count(F.lit(1)).alias("questions_created"))
    joined = seen.join(made, list(keys), "left")
    return joined.withColumn("questions_created", F.coalesce("questions_created", F.lit(0)))


def group_lists(
    df: DataFrame, keys: Sequence[str], order: str, value: str, part_rows: int = PART_ROWS
) -> DataFrame:
    """Values of each group in order, in arrays of at most `part_rows` (column `part`)."""
    rows = number_rows(df, keys, [F.col(order)], "__p")
    part = F.floor(F.col("__p") / part_rows).cast("long").alias("part")
    items = F.array_sort(F.collect_list(F.struct("__p", F.col(value).alias("v"))))
    listed = rows.df.groupBy(*keys, part).agg(items.alias("__items"))
    return listed.select(*keys, "part", F.transform("__items", lambda x: x["v"]).alias("values"))


def duplicate_groups(df: DataFrame, key: str, content: Column) -> DataFrame:
    """Rows whose content occurs more than once: (digest, first, copies, key).

    A group of copies may hold a large share of the table, so it comes as one
    row per copy with the first key, found by an aggregate and a join on the
    repeated digests only.
    """
    rows = df.select(F.sha2(content, 256).alias("digest"), key)
    groups = rows.groupBy("digest").agg(
        F.min(key).alias("first"), F.count(F.lit(1)).alias("copies")
    )
    return rows.join(groups.filter("copies > 1"), "digest")


def line_confidence(
    lines: DataFrame, keys: Sequence[str], minimum: float | None = None
) -> DataFrame:
    """Scored lines (pos, line, score) -> text and mean score of each key.

    Blank lines count for the score but not for the text. With `minimum`, lines
    scored lower are left out of both.
    """
    if minimum is not None:
        lines = lines.filter(F.col("score") >= minimum)
    shown = strip(F.col("line")) != ""
    item = F.when(shown, F.struct("pos", F.rtrim("line").alias("line")))
    ordered = F.array_sort(F.collect_list(item))
    text = F.array_join(F.transform(ordered, lambda x: x["line"]), "\n")
    return lines.groupBy(*keys).agg(
        strip(text).alias("text"),
        F.coalesce(round_binary(steady_mean(F.col("score")), 4), F.lit(0.0)).alias("confidence"),
    )


def overall_completion(modules: DataFrame, pct: str = "completion") -> tuple[DataFrame, DataFrame]:
    """(rounded mean completion, 0 without modules; modules below 100)."""
    mean = modules.agg(F.coalesce(F.bround(F.avg(pct)), F.lit(0.0)).cast("long").alias("overall"))
    return mean, modules.filter(F.col(pct) < 100)


def changelog_sections(entries: DataFrame, sections: Sequence[str]) -> DataFrame:
    """Entries of the listed sections, in section order and then their own order.

    An entry of an unlisted section is left out, as is a section without entries.
    """
    rank = F.array_position(F.array(*[F.lit(s) for s in sections]), F.col("section"))
    ranked = entries.withColumn("section_rank", rank.cast("long")).filter("section_rank > 0")
    return ranked.orderBy("section_rank", "seq")


def batch_outcome(items: DataFrame, keys: Sequence[str], failed: Column, empty_ok: bool = True) -> DataFrame:
    """Per batch: completed while something succeeded, and the stage text.

    A batch without items is a row whose item columns are null. Documents accept
    an empty batch, book downloads count it as failed.
    """
    bad, all_ = F.col("failures"), F.col("total")
    done = (bad < all_) | (all_ == 0) if empty_ok else bad < all_
    stage = F.concat(F.lit("Completed with "), bad.cast("string"), F.lit(" failures"))
    counted = items.groupBy(*keys).agg(
        F.count("item_id").alias("total"), count_when(failed).alias("failures")
    )
    return counted.withColumns(
        {
            "status": F.when(done, "completed").otherwise("failed"),
            "stage": F.when(bad == 0, "Completed").otherwise(stage),
        }
    )


def sum_media_bytes(df: DataFrame, content: Column) -> DataFrame:
    return df.agg(F.coalesce(F.sum(F.octet_length(content)), F.lit(0)).alias("media_bytes"))


def large_files(df: DataFrame, size: Column, limit_mb: int = 5) -> DataFrame:
    """Rows above the limit with `detail`, the size in MB with one decimal."""
    mb = F.format_string("%.1f MB", round_binary(size / F.lit(1024.0 * 1024.0), 1))
    return df.withColumn("__size", size).filter(F.col("__size") > limit_mb * 1024 * 1024).withColumn(
        "detail", mb
    ).drop("__size")


def cross_source_support(facts: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Per normalised claim: number of supporting sources and mean confidence."""
    claim = normalise_ws_lower(F.col("value")).alias("claim")
    return facts.groupBy(*keys, "category", claim).agg(
        F.countDistinct("source_label").alias("sources"),
        steady_mean(F.col("confidence")).alias("confidence"),
    )


def claim_sources(facts: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """The supporting sources of each claim, one row per source."""
    claim = normalise_ws_lower(F.col("value")).alias("claim")
    return facts.select(*keys, "category", claim, "source_label").distinct()


def conflicting_claims(facts: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Claims of a (category, subcategory) that holds more than one distinct claim."""
    claim = normalise_ws_lower(F.col("value")).alias("claim")
    claims = facts.select(*keys, "category", "subcategory", claim).distinct()
    topic = [*keys, "category", "subcategory"]
    several = claims.groupBy(*topic).agg(F.count(F.lit(1)).alias("claims")).filter("claims > 1")
    return claims.join(several, topic)
