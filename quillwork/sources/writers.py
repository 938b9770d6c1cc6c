"""Writers and renderers: nested JSON, CSV, tables, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions.text import escape_cell
from quillwork.operators.ordered import number_rows

# Exported columns in order.
QUESTION_FIELDS = (
    "id", "text", "options", "timestamp", "source", "status", "frame_start", "frame_end",
    "ocr_confidence", "frame_confidence", "merge_confidence", "overall_confidence",
)
FRAME_FIELDS = (
    "index", "timestamp", "ocr_text", "ocr_confidence", "classification", "is_duplicate",
)
PART_ROWS = 1_000


def _parts(df: DataFrame, key: str, order: str, fields: Sequence[str], out: str, size: int) -> DataFrame:
    rows = number_rows(df, [key], [F.col(order)], "__p").df
    item = F.struct("__p", *fields)
    items = F.transform(
        F.array_sort(F.collect_list(item)), lambda x: F.struct(*[x[f].alias(f) for f in fields])
    )
    part = F.floor(F.col("__p") / size).cast("long").alias("part")
    return rows.groupBy(key, part).agg(items.alias(out))


def export_nested_json(
    jobs: DataFrame,
    questions: DataFrame,
    frames: DataFrame | None = None,
    key: str = "job_id",
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Per job: source struct, question count and questions, optionally frames, as JSON.

    A job with more than `part_rows` questions or frames continues in further
    rows (`part` 1, 2, ...), so that a document never outgrows a task.
    """
    counts = questions.groupBy(key).agg(F.count(F.lit(1)).alias("question_count"))
    described = [c for c in jobs.columns if c != key]
    heads = jobs.select(key, F.struct(*described).alias("source")).join(counts, key, "left")
    heads = heads.withColumn("question_count", F.coalesce("question_count", F.lit(0)))

    lists = _parts(questions, key, "id", QUESTION_FIELDS, "questions", part_rows)
    if frames is not None:
        shots = _parts(frames, key, "index", FRAME_FIELDS, "frames", part_rows)
        lists = lists.join(shots, [key, "part"], "full_outer")
    arrays = [c for c in lists.columns if c not in (key, "part")]
    joined = heads.join(lists, key, "left")
    for c in arrays:
        empty = F.array().cast(lists.schema[c].dataType)
        joined = joined.withColumn(c, F.coalesce(c, empty))
    body = F.to_json(F.struct("source", "question_count", *arrays))
    return joined.select(key, F.coalesce("part", F.lit(0)).alias("part"), body.alias("document"))


def csv_rows(questions: DataFrame) -> DataFrame:
    """The twelve export columns, options joined with ` | `."""
    options = F.array_join("options", " | ").alias("options")
    return questions.select(*[options if c == "options" else F.col(c) for c in QUESTION_FIELDS])


def export_csv(questions: DataFrame, path: str) -> None:
    csv_rows(questions).write.mode("overwrite").csv(path, header=True, escape='"')


def table_rows(questions: DataFrame, key: str = "job_id") -> DataFrame:
    """The thirteen columns of the relational copy, options as JSON."""
    columns = [F.to_json("options").alias("options") if c == "options" else F.col(c) for c in QUESTION_FIELDS]
    return questions.select(columns[0], key, *columns[1:])


def export_table(questions: DataFrame, table: str, key: str = "job_id") -> None:
    table_rows(questions, key).write.mode("overwrite").saveAsTable(table)


def markdown_table_rows(df: DataFrame, columns: Sequence[str], escape: bool = False) -> Column:
    """One `| a | b |` line per row; `escape` protects bars and line breaks."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cells = [escape_cell(cell(c)) if escape else cell(c) for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
