"""Rule-based content tags for the text of one frame or passage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions.text import clean_lines, is_option_line, word_count

# Tag order and line patterns.
TAGS = ("heading", "paragraph", "question", "options", "answer", "diagram", "table")
ANSWER = r"(?iU)^\s*(answer|ans|correct\s+answer|solution|key)\b\s*[:.\-)]"
QUESTION_LEAD = r"(?iU)^\s*(q\s*[.\d):\-]|question\b|(who|what|why|when|where|which|how|whose|whom)\b)"
DIAGRAM = (
    r"(?iU)^\s*(fig(?:ure)?|diagram|image|photo|plate|chart|graph|illustration)\b[\s.:\-]*\d?"
)
TABLE = r"(?iU)^\s*table\b[\s.:\-]*\d"
COLUMN_GAP = r"(?U)\S {2,}\S"
CLOSERS = r"[.?!:;]$"
SHORT_WORDS, PLAIN_WORDS, PROSE_WORDS = 8, 5, 12


def is_upper(c: Column) -> Column:
    return c.rlike(r"(?U)\p{Upper}") & ~c.rlike(r"(?U)\p{Lower}")


def is_title(c: Column) -> Column:
    """Capitals only where a run of letters starts, small letters only after one."""
    cased = r"[\p{Upper}\p{Lower}]"
    return (
        c.rlike(rf"(?U){cased}")
        & ~c.rlike(rf"(?U){cased}\p{{Upper}}")
        & ~c.rlike(rf"(?U)(?<!{cased})\p{{Lower}}")
    )


def _tabular(line: Column) -> Column:
    gaps = F.regexp_count(line, F.lit(COLUMN_GAP))
    return line.contains("\t") | (gaps >= 2)


def _asks(line: Column) -> Column:
    return F.endswith(line, F.lit("?")) | line.rlike(QUESTION_LEAD)


def classify_content(df: DataFrame, text: str, out: str = "tags") -> DataFrame:
    """Add `out`: the ordered tags of `text`; blank text has none.

    Option lines and answer lines say nothing about the other tags. The line
    arrays are separate columns so that each is computed once per row.
    """
    lines, open_lines, plain = F.col("__lines"), F.col("__open"), F.col("__plain")
    df = (
        df.withColumn("__lines", clean_lines(F.coalesce(F.col(text), F.lit(""))))
        .withColumn("__open", F.filter(lines, lambda x: ~is_option_line(x)))
        .withColumn("__plain", F.filter(open_lines, lambda x: ~x.rlike(ANSWER)))
    )
    flags = {
        "__options": F.size(open_lines) < F.size(lines),
        "__answer": F.size(plain) < F.size(open_lines),
        "__diagram": F.exists(plain, lambda x: x.rlike(DIAGRAM)),
        "__table": F.exists(plain, lambda x: x.rlike(TABLE))
        | (F.size(F.filter(plain, _tabular)) >= 2),
        "__asked": F.exists(plain, _asks),
        "__words": word_count(F.array_join(lines, " ")),
    }
    df = df.withColumns(flags)
    options, answer, diagram, table = (
        F.col("__options"), F.col("__answer"), F.col("__diagram"), F.col("__table"),
    )
    question = options | F.col("__asked")
    only = F.try_element_at(lines, F.lit(1))
    structural = question | answer | diagram | table
    short = (
        (F.size(lines) == 1)
        & (F.col("__words") <= SHORT_WORDS)
        & ~only.rlike(CLOSERS)
        & ~structural
    )
    headed = short & (is_upper(only) | is_title(only) | (F.col("__words") <= PLAIN_WORDS))
    prose = (headed | diagram) & ~(question | answer | table) & (F.col("__words") >= PROSE_WORDS)
    chosen = {
        "heading": headed & ~prose,
        "paragraph": ~(headed | structural) | prose,
        "question": question,
        "options": options,
        "answer": answer,
        "diagram": diagram,
        "table": table,
    }
    tags = F.array_compact(F.array(*[F.when(chosen[t], t) for t in TAGS]))
    empty = F.array().cast("array<string>")
    tagged = df.withColumn(out, F.when(F.size(lines) == 0, empty).otherwise(tags))
    return tagged.drop("__lines", "__open", "__plain", *flags)
