"""Frame sequences: choose frames, analyse them into questions, tag their content."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.functions.classify import classify_content
from quillwork.functions.vectors import DUPLICATE_MAD, is_question_score, slide_score
from quillwork.operators.aggregates import analysis_summary
from quillwork.operators.inference import Registry
from quillwork.operators.ordered import Ordered
from quillwork.operators.sequence import (
    SCENE_CHANGE,
    build_question,
    change_scores,
    flag_near_duplicates,
    keep_on_text_change,
    merge_similar_runs,
    quality_filters,
    sample_fixed_interval,
    sample_fps,
    scene_changes,
)
from quillwork.operators.upkeep import replace_auto_keep_manual
from quillwork.session import materialise


@dataclass(frozen=True)
class SelectOptions:
    interval: float | None = None
    scene_threshold: float = SCENE_CHANGE
    sampling_fps: float | None = 10.0
    max_frames: int | None = None
    remove_duplicates: bool = True
    keep_best_quality: bool = True
    ignore_blank: bool = True
    ignore_blurred: bool = True
    duplicate_limit: float = DUPLICATE_MAD


STRATEGIES = Registry(default="hybrid")


def _fixed_interval(rows: Ordered, o: SelectOptions) -> DataFrame:
    return sample_fixed_interval(rows, o.interval, o.max_frames).drop("sample_ts")


def _scene_detection(rows: Ordered, o: SelectOptions) -> DataFrame:
    """Neighbours of the sample are compared, so a slow change adds up between two of them."""
    sampled = rows.with_df(materialise(sample_fps(rows, o.sampling_fps)))
    return scene_changes(change_scores(sampled), o.scene_threshold).drop("change")


def _text_change(rows: Ordered, o: SelectOptions) -> DataFrame:
    return keep_on_text_change(rows.with_df(sample_fps(rows, o.sampling_fps)))


def _hybrid(rows: Ordered, o: SelectOptions) -> DataFrame:
    scenes = rows.with_df(_scene_detection(rows, o))
    return keep_on_text_change(scenes, collapse_empty=False)


STRATEGIES.register("fixed_interval", _fixed_interval)
STRATEGIES.register("scene_detection", _scene_detection)
STRATEGIES.register("ocr_text_change", _text_change)
STRATEGIES.register("hybrid", _hybrid)


def select_frames(
    rows: Ordered, strategy: str | None = None, options: SelectOptions = SelectOptions()
) -> DataFrame:
    """Frames picked by the named strategy (unknown: hybrid), then quality-filtered."""
    picked = rows.with_df(STRATEGIES.get(strategy)(rows, options))
    return quality_filters(
        picked,
        limit=options.duplicate_limit,
        cap=options.max_frames,
        ignore_blank=options.ignore_blank,
        ignore_blurred=options.ignore_blurred,
        remove_duplicates=options.remove_duplicates,
        keep_best=options.keep_best_quality,
    )


def score_frames(frames: Ordered, limit: float = DUPLICATE_MAD) -> Ordered:
    """Question score from the image features, and the duplicate flag."""
    score = slide_score(F.col("text_boxes"), F.col("uniformity"), F.col("saturation"))
    scored = frames.columns(question_score=score)
    scored = scored.columns(is_question=is_question_score(F.col("question_score")))
    return scored.with_df(flag_near_duplicates(scored, limit=limit))


def analyze_frames(
    scored: Ordered, questions: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(questions, summary per job) of scored frames that carry their text.

    Existing `questions` keep their manual rows; automatic ones are replaced.
    """
    fresh = build_question(merge_similar_runs(scored))
    summary = analysis_summary(scored.df, fresh, list(scored.keys))
    if questions is not None:
        fresh = replace_auto_keep_manual(questions, fresh, scored.keys[0])
    return fresh, summary


def analyze_job(
    frames: Ordered,
    questions: DataFrame | None = None,
    read: Callable[[DataFrame], DataFrame] | None = None,
    limit: float = DUPLICATE_MAD,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(questions, summary per job, scored frames) from frames as they were extracted.

    Frames are scored and flagged first. `read` gives the text of frames: it gets the
    rows of question frames that are no duplicates and whose `ocr_done` is not true, and
    returns them with `ocr_text` and `ocr_confidence`; no other frame is read. Without it
    the frames' own text counts. Runs of question frames then become questions, which
    replace the automatic ones of `questions`; a job without frames is left as it is.
    """
    scored = score_frames(frames, limit)
    scored = scored.with_df(materialise(scored.df))
    wanted = F.col("is_question") & ~F.col("is_duplicate")
    picked = scored.filter(wanted)
    if read is not None:
        done = F.coalesce(F.col("ocr_done"), F.lit(False))
        fresh = read(picked.df.filter(~done)).select(*picked.df.columns)
        # read once: the answers are needed for the runs and for the scored frames
        texts = materialise(fresh.withColumn("ocr_done", F.lit(True)).select(*picked.df.columns))
        picked = picked.with_df(picked.df.filter(done).unionByName(texts))
        scored = scored.with_df(scored.df.filter(~(wanted & ~done)).unionByName(texts))
    made, _ = analyze_frames(picked, questions)
    summary = analysis_summary(scored.df, build_question(merge_similar_runs(picked)), list(scored.keys))
    return made, summary, scored.df


def classify_frames(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tagged frames that are no duplicates, counts per job)."""
    tagged = classify_content(frames.filter(~F.col("is_duplicate")), "ocr_text", "classification")
    counts = tagged.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if(F.size("classification") > 0).alias("classified"),
    )
    return tagged, counts
