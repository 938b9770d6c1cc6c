"""Operators over rows ordered within a key: runs, samples, revisions, folds."""

from __future__ import annotations

import difflib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions.numbers import round_binary, steady_mean
from quillwork.functions.text import (
    clean_lines,
    is_subset,
    line_jaccard,
    line_set,
    normalise_ws_lower,
    split_stem_options,
    strip,
)
from quillwork.functions.vectors import BLANK_STD, BLURRED_VAR, DUPLICATE_MAD, vector_mad
from quillwork.operators.filters import subsample_even
from quillwork.operators.folds import GapRule, TextRule, fold_keep
from quillwork.operators.ordered import Ordered, lag, last, number_rows, total
from quillwork.session import materialise

# Defaults of the frame stages.
MERGE_JACCARD = 0.35
SCENE_CHANGE = 0.35
TEXT_SIMILARITY = 0.85
OPENING_SECONDS = 0.05
MIN_INTERVAL = 2.0
WEIGHTS = (0.5, 0.3, 0.2)


# ---- runs of similar frames -------------------------------------------------


def merge_similar_runs(frames: Ordered, limit: float = MERGE_JACCARD) -> Ordered:
    """Add `run`, the position of the first frame of the run, and `similarity`.

    Only question frames that are no duplicates and carry text take part. A
    frame joins the run of the one before it when their lower-cased line sets
    overlap by `limit` or one set contains the other.
    """
    usable = F.col("is_question") & ~F.col("is_duplicate") & (strip(F.col("ocr_text")) != "")
    rows = frames.filter(usable).columns(__lines=line_set(F.col("ocr_text")))
    rows = rows.scan(__before=lag(F.col("__lines")))
    now, before = F.col("__lines"), F.col("__before")
    rows = rows.columns(__similarity=line_jaccard(before, now))
    same = (F.col("__similarity") >= limit) | is_subset(before, now) | is_subset(now, before)
    rows = rows.columns(__joins=before.isNotNull() & same)
    rows = rows.scan(run=last(F.when(~F.col("__joins"), F.col(frames.pos))))
    rows = rows.columns(similarity=F.when(F.col("__joins"), F.col("__similarity")))
    return rows.with_df(rows.df.drop("__lines", "__before", "__similarity", "__joins"))


def first_seen_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], lines: Column) -> DataFrame:
    """Per group: lines distinct up to case, with where they were first seen (`at`).

    A map-side combined aggregate on (group, line), whatever the group's size.
    """
    # the outer form keeps Catalyst from repeating `lines` in an inferred filter
    rows = df.select(*keys, *order, F.posexplode_outer(lines).alias("__i", "__line"))
    rows = rows.filter("__line is not null")
    at = F.struct(*order, "__i")
    distinct = rows.groupBy(*keys, F.lower("__line").alias("__key"))
    return distinct.agg(F.min(at).alias("at"), F.min_by("__line", at).alias("line")).drop("__key")


def first_seen_lines(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], lines: Column, out: str = "lines"
) -> DataFrame:
    """The same as one array per group in first-seen order: for groups that make one text."""
    ordered = F.array_sort(F.collect_list(F.struct("at", "line")))
    rows = first_seen_rows(df, keys, order, lines)
    return rows.groupBy(*keys).agg(F.transform(ordered, lambda x: x["line"]).alias(out))


def _blend_parts() -> list[Column]:
    alone = F.count(F.lit(1)) == 1
    return [
        steady_mean(F.col("ocr_confidence")).alias("__o"),
        steady_mean(F.col("question_score")).alias("__f"),
        F.when(alone, 1.0).otherwise(steady_mean(F.col("similarity"))).alias("__m"),
    ]


def _blend_columns() -> list[Column]:
    o, f, m = F.col("__o"), F.col("__f"), F.col("__m")
    a, b, c = WEIGHTS
    return [
        round_binary(o, 4).alias("ocr_confidence"),
        round_binary(f, 4).alias("frame_confidence"),
        round_binary(m, 4).alias("merge_confidence"),
        round_binary(a * o + b * f + c * m, 4).alias("overall_confidence"),
    ]


def confidence_blend(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per run: mean text, frame and merge confidence and their weighted sum."""
    return runs.groupBy(*keys).agg(*_blend_parts()).select(*keys, *_blend_columns())


def build_question(runs: Ordered) -> DataFrame:
    """One question per run of `merge_similar_runs`."""
    keys, pos = [*runs.keys, "run"], runs.pos
    df = runs.df
    spans = df.groupBy(*keys).agg(
        F.min(pos).alias("frame_start"),
        F.max(pos).alias("frame_end"),
        F.min_by("timestamp", pos).alias("timestamp"),
        *_blend_parts(),
    )
    spans = spans.select(*keys, "frame_start", "frame_end", "timestamp", *_blend_columns())
    lines = first_seen_lines(df, keys, [pos], clean_lines(F.col("ocr_text")))
    split = split_stem_options(F.col("lines"))
    texts = lines.withColumn("__s", split).select(
        *keys,
        F.when(strip(F.col("__s.stem")) != "", strip(F.col("__s.stem")))
        .otherwise(F.array_join("lines", "\n"))
        .alias("text"),
        F.col("__s.options").alias("options"),
    )
    built = spans.join(texts, keys)
    return built.withColumns({"source": F.lit("auto"), "status": F.lit("pending")}).drop("run")


# ---- folds against the last kept row ---------------------------------------


def flag_near_duplicates(
    rows: Ordered, vector: str = "signature", limit: float = DUPLICATE_MAD, flag: str = "is_duplicate"
) -> DataFrame:
    """True when the vector is within `limit` of the last *kept* one.

    A missing vector is always kept and leaves no baseline for the next row.
    """
    kept = fold_keep(rows, vector, GapRule(limit), "__kept")
    return kept.withColumn(flag, ~F.col("__kept")).drop("__kept")


def keep_best_of_duplicates(
    rows: Ordered,
    vector: str = "signature",
    limit: float = DUPLICATE_MAD,
    sharpness: str | None = "sharpness",
) -> DataFrame:
    """One row per group of near-duplicates: the sharpest, else the first."""
    flagged = rows.with_df(flag_near_duplicates(rows, vector, limit, "__dup"))
    pos = F.col(rows.pos)
    grouped = flagged.scan(__group=last(F.when(~F.col("__dup"), pos))).df
    rank = F.struct(F.col(sharpness), -pos) if sharpness else -pos
    best = F.max_by(F.struct(*rows.df.columns), rank).alias("__row")
    return grouped.groupBy(*rows.keys, "__group").agg(best).select("__row.*")


def sequence_ratio(a: str, b: str) -> float:
    """Share of matching characters, 1.0 for two empty texts, 0.0 for one."""
    if not a or not b:
        return 1.0 if not a and not b else 0.0
    return 1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio()


def _similar(a: str, b: str, limit: float) -> bool:
    if a and b and 2.0 * min(len(a), len(b)) / (len(a) + len(b)) < limit:
        return False
    return sequence_ratio(a, b) >= limit


def keep_on_text_change(
    rows: Ordered,
    text: str = "ocr_text",
    limit: float = TEXT_SIMILARITY,
    collapse_empty: bool = True,
    equal_only: bool = False,
) -> DataFrame:
    """Rows whose text differs enough from the last kept row of their key.

    `collapse_empty=False` keeps every row without text. `equal_only` drops only
    equal neighbours, which needs no fold.
    """
    rows = rows.columns(__norm=normalise_ws_lower(F.coalesce(F.col(text), F.lit(""))))
    norm = F.col("__norm")
    if equal_only:
        marked = rows.scan(__before=lag(norm)).df
        kept = ~norm.eqNullSafe(F.col("__before"))
        kept = kept if collapse_empty else kept | (norm == "")
        return marked.filter(kept).drop("__norm", "__before")
    rule = TextRule(lambda a, b: _similar(a, b, limit), collapse_empty)
    folded = fold_keep(rows, "__norm", rule, "__kept")
    return folded.filter("__kept").drop("__norm", "__kept")


# ---- sampling ---------------------------------------------------------------


def change_scores(rows: Ordered, vector: str = "signature", out: str = "change") -> Ordered:
    """Distance to the previous row; null on the first row of a key."""
    rows = rows.scan(__before=lag(F.col(vector)))
    score = F.when(F.col("__before").isNotNull(), vector_mad(F.col(vector), F.col("__before")))
    return rows.with_df(rows.df.withColumn(out, score).drop("__before"))


def scene_changes(
    rows: Ordered, limit: float = SCENE_CHANGE, score: str = "change", ts: str = "timestamp"
) -> DataFrame:
    """Rows above the change limit, led by the opening row of their key.

    The opening row is left out only if a change was kept at its very start.
    """
    df, keys, pos = rows.df, list(rows.keys), rows.pos
    hit = F.coalesce(F.col(score) > limit, F.lit(False))
    changes = df.filter(hit)
    first = changes.groupBy(*keys).agg(F.min_by(ts, pos).alias("__first"))
    opening = df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), pos).alias("__row"))
    opening = opening.select("__row.*").filter(~hit)
    late = F.col("__first").isNull() | (F.col("__first") > OPENING_SECONDS)
    opening = opening.join(first, keys, "left").filter(late).select(*df.columns)
    return changes.unionByName(opening)


def _first_per_bucket(rows: Ordered, bucket: Column) -> DataFrame:
    df = rows.df.withColumn("__bucket", bucket)
    picked = F.min_by(F.struct(*rows.df.columns), rows.pos).alias("__row")
    return df.groupBy(*rows.keys, "__bucket").agg(picked).select("__bucket", "__row.*")


def sample_fixed_interval(
    rows: Ordered,
    interval: float | None = None,
    max_frames: int | None = None,
    ts: str = "timestamp",
    out: str = "sample_ts",
) -> DataFrame:
    """First row of every interval, stamped with the start of the interval.

    Without an interval, each key uses its length divided by `max_frames`, at least
    two seconds; with neither, two seconds.
    """
    if interval:
        step = F.lit(float(interval) if interval > 0 else MIN_INTERVAL)
        picked = _first_per_bucket(rows, F.floor(F.col(ts) / step))
        return picked.withColumn(out, round_binary(F.col("__bucket") * step, 2)).drop("__bucket")
    if not max_frames:
        return sample_fixed_interval(rows, MIN_INTERVAL, ts=ts, out=out)
    cap = float(max_frames)
    length = rows.df.groupBy(*rows.keys).agg(F.max(ts).alias("__length"))
    step = F.greatest(F.lit(MIN_INTERVAL), F.col("__length") / cap)
    widened = rows.with_df(rows.df.join(length.withColumn("__step", step), list(rows.keys)))
    picked = _first_per_bucket(widened, F.floor(F.col(ts) / F.col("__step")))
    stamp = round_binary(F.col("__bucket") * F.col("__step"), 2)
    return picked.withColumn(out, stamp).drop("__bucket", "__step", "__length")


def sample_fps(rows: Ordered, fps: float | None = None, ts: str = "timestamp") -> DataFrame:
    """First row of every 1/fps second; None keeps every row."""
    if not fps:
        return rows.df
    return _first_per_bucket(rows, F.floor(F.col(ts) * F.lit(float(fps)))).drop("__bucket")


def quality_filters(
    rows: Ordered,
    vector: str = "signature",
    limit: float = DUPLICATE_MAD,
    cap: int | None = None,
    ignore_blank: bool = True,
    ignore_blurred: bool = True,
    remove_duplicates: bool = True,
    keep_best: bool = True,
) -> DataFrame:
    """Drop blank, then blurred rows, then near-duplicates, then thin out to `cap`."""
    if ignore_blank:
        rows = rows.filter(F.coalesce(F.col("pixel_std") >= BLANK_STD, F.lit(False)))
    if ignore_blurred:
        rows = rows.filter(F.coalesce(F.col("sharpness") >= BLURRED_VAR, F.lit(False)))
    df = rows.df
    if remove_duplicates:
        best = keep_best_of_duplicates(rows, vector, limit, "sharpness" if keep_best else None)
        df = materialise(best)  # numbered and counted below: fold only once
    return subsample_even(df, rows.keys, [F.col(rows.pos)], cap, rows.largest)


# ---- numbering and history --------------------------------------------------


def next_identifiers(existing: DataFrame, fresh: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Give `fresh` rows (prefix, ...) the next free `identifier` of their prefix."""
    number = F.regexp_extract("identifier", r"^(.*)-(\d+)$", 2).try_cast("long")
    prefix = F.regexp_extract("identifier", r"^(.*)-(\d+)$", 1)
    tops = existing.select(prefix.alias("prefix"), number.alias("__n"))
    tops = tops.filter("__n is not null").groupBy("prefix").agg(F.max("__n").alias("__top"))
    rows = number_rows(fresh, ["prefix"], order, "__p").df.join(tops, "prefix", "left")
    value = (F.coalesce("__top", F.lit(0)) + F.col("__p") + 1).cast("string")
    padded = F.when(F.char_length(value) < 3, F.lpad(value, 3, "0")).otherwise(value)
    named = F.concat("prefix", F.lit("-"), padded)
    return rows.withColumn("identifier", named).drop("__top", "__p")


def latest_per_key(df: DataFrame, keys: Sequence[str], newest: Column) -> DataFrame:
    """Newest row of each key, as an aggregate: no key is gathered in a task."""
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), newest).alias("__row"))
    return top.select("__row.*")


def revision_on_change(history: Ordered, status: str = "status") -> Ordered:
    """Add `revision`: 1, plus one per change of status so far."""
    rows = history.scan(__before=lag(F.col(status)))
    changed = F.col("__before").isNotNull() & (F.col("__before") != F.col(status))
    rows = rows.columns(__changed=changed.cast("long")).scan(__count=total(F.col("__changed")))
    rows = rows.columns(revision=F.col("__count") + 1)
    return rows.with_df(rows.df.drop("__before", "__changed", "__count"))
