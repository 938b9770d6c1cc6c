"""Text column functions. Every one maps Column to Column and stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillwork.functions.numbers import round_binary

# Characters counted as white space, and line terminators.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
_SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
_WORD = r"(?U)[^\s\x1c-\x1f]+"
_LINE_END = r"[\n-\r\x1c-\x1e\x85  ]"

# Patterns and limits that decide results.
OPTION_LINE = r"(?U)^\s*(\(?[A-Da-d][\).]|[1-4][\).])\s+\S"
CAPTION = r"(?iU)^(fig(?:ure)?|table|image|photo|plate|chart|diagram|exhibit)\b[\s.:\-]*\d"
EXAMPLE = r"(?iU)^\s*example\b"
EXERCISE = r"(?iU)^\s*(exercises?|questions|problems)\b"
PAGE_NUMBER = r"(?iU)^\s*(page\s*)?[ivxlcdm\d]{1,6}\s*$"
SENTENCE_END = (".", "!", "?", ":", ";", ")", '"', "”")
CONVENTIONAL_COMMIT = r"(?U)^(\w+)(?:\(([^)]+)\))?(!)?:\s*(.+)$"
MARKDOWN_LINK = r"\[[^\]]*\]\(([^)]+)\)"
HTML_LINK = r'href="([^"]*)"'
FRONT_MATTER = r"(?Us)^---\s*\n(.*?)\n---\s*\n"
KEY_VALUE = r"(?U)^(\w+)\s*:\s*(.+)$"
FIRST_HEADING = r"(?Um)^#\s+(.+)$"
ANALYSIS_CHARS = 24_000


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def squash(c: Column) -> Column:
    """White-space runs to one blank, none at the ends."""
    return F.btrim(F.regexp_replace(c, _SPACE_RUN, " "), F.lit(" "))


def normalise_ws_lower(c: Column) -> Column:
    return F.lower(squash(c))


def snippet(c: Column, length: int = 90) -> Column:
    flat = squash(c)
    return F.concat(
        F.substring(flat, 1, length), F.when(F.char_length(flat) > length, "…").otherwise("")
    )


def truncate(c: Column, length: int = ANALYSIS_CHARS) -> Column:
    return F.substring(c, 1, length)


def slugify(c: Column, default: str = "rule") -> Column:
    dashed = F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.btrim(dashed, F.lit("-")), F.lit("")), F.lit(default))


def split_lines(c: Column) -> Column:
    """Lines by any terminator; a CR LF pair leaves an empty line between."""
    return F.split(c, _LINE_END)


def clean_lines(c: Column) -> Column:
    """Stripped lines without the blank ones."""
    return F.filter(F.transform(split_lines(c), strip), lambda line: line != "")


def line_set(c: Column) -> Column:
    return F.array_distinct(F.transform(clean_lines(c), F.lower))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(_WORD))


def char_count(c: Column) -> Column:
    return F.char_length(c)


def is_option_line(c: Column) -> Column:
    return c.rlike(OPTION_LINE)


def is_caption(c: Column) -> Column:
    return c.rlike(CAPTION)


def is_example(c: Column) -> Column:
    return c.rlike(EXAMPLE)


def is_exercise(c: Column) -> Column:
    return c.rlike(EXERCISE)


def is_page_number(c: Column) -> Column:
    """Also true for short words made of roman digits, such as "mild"."""
    return c.rlike(PAGE_NUMBER)


def ends_sentence(c: Column) -> Column:
    tail = F.rtrim(c)
    return reduce(lambda a, b: a | b, [F.endswith(tail, F.lit(e)) for e in SENTENCE_END])


def split_stem_options(lines: Column) -> Column:
    """Lines -> struct(stem, options)."""
    stem = F.filter(lines, lambda x: ~is_option_line(x))
    return F.struct(
        F.array_join(stem, "\n").alias("stem"), F.filter(lines, is_option_line).alias("options")
    )


def map_lookup(c: Column, mapping: dict[str, str], default) -> Column:
    """Code to label by a small fixed mapping. `default`: label or Column."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    fallback = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.try_element_at(table, c), fallback)


def commit_parts(subject: Column) -> Column:
    """Commit subject -> [type, scope, bang, summary], or [subject] if it has no type."""
    cut = F.regexp_replace(strip(subject), CONVENTIONAL_COMMIT, "$1\x01$2\x01$3\x01$4")
    return F.split(cut, "\x01")


def parse_conventional_commit(
    parts: Column, mapping: dict[str, str], default: str = "Changed"
) -> Column:
    """Array of `commit_parts` -> struct(type, scope, breaking, summary, section)."""
    known = {k.lower(): v for k, v in mapping.items()}
    conventional = F.size(parts) == 4
    kind, bang = F.lower(F.get(parts, F.lit(0))), F.get(parts, F.lit(2)) == "!"
    section = map_lookup(kind, known, default)
    if "breaking" in known:
        section = F.when(bang, known["breaking"]).otherwise(section)
    summary = strip(F.get(parts, F.lit(3)))
    return F.struct(
        F.when(conventional, kind).otherwise("").alias("type"),
        F.when(conventional, F.get(parts, F.lit(1))).otherwise("").alias("scope"),
        (conventional & bang).alias("breaking"),
        F.when(conventional, summary).otherwise(F.get(parts, F.lit(0))).alias("summary"),
        F.when(conventional, section).otherwise(default).alias("section"),
    )


def frontmatter(c: Column) -> Column:
    """Leading `---` block -> map of lower-cased keys.

    Of a repeated key the last wins, by `spark.sql.mapKeyDedupPolicy` as `configure` sets it.
    """
    block = F.regexp_extract(c, FRONT_MATTER, 1)
    pairs = F.filter(F.transform(split_lines(block), strip), lambda x: x.rlike(KEY_VALUE))
    entries = F.transform(
        pairs,
        lambda x: F.struct(
            F.lower(F.regexp_extract(x, KEY_VALUE, 1)).alias("k"),
            F.btrim(strip(F.regexp_extract(x, KEY_VALUE, 2)), F.lit('"')).alias("v"),
        ),
    )
    return F.map_from_entries(entries)


def first_heading(c: Column) -> Column:
    """Text of the first `# ` line, or ''."""
    return strip(F.regexp_extract(c, FIRST_HEADING, 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-cased extension with its dot, '' when there is none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def doc_title(text: Column, path: Column, meta: Column | None = None) -> Column:
    """`meta` is the front matter, if it is a column already."""
    title = F.try_element_at(frontmatter(text) if meta is None else meta, F.lit("title"))
    return F.coalesce(
        F.nullif(title, F.lit("")), F.nullif(first_heading(text), F.lit("")), stem(path)
    )


def infer_module(
    text: Column, relative_path: Column, default: str = "Platform", meta: Column | None = None
) -> Column:
    named = F.try_element_at(frontmatter(text) if meta is None else meta, F.lit("module"))
    parts = F.split(relative_path, "/")
    folder = F.when(F.size(parts) > 1, F.element_at(parts, 1)).otherwise(default)
    return F.coalesce(F.nullif(named, F.lit("")), folder)


def adr_fields(path: Column, text: Column) -> Column:
    """Decision record -> struct(number, title, status, date); number null: not one."""
    name = basename(path)
    pattern = r"(?iU)^ADR-(\d+)-(.+)\.md$"
    title = F.regexp_extract(text, r"(?Um)^#\s*ADR-\d+:\s*(.+)$", 1)
    cell = lambda k: strip(F.regexp_extract(text, rf"(?Um)^\|\s*{k}\s*\|\s*(.+?)\s*\|", 1))
    from_name = F.regexp_replace(F.regexp_extract(name, pattern, 2), "-", " ")
    return F.struct(
        F.regexp_extract(name, pattern, 1).try_cast("long").alias("number"),
        F.coalesce(F.nullif(strip(title), F.lit("")), from_name).alias("title"),
        F.coalesce(F.nullif(cell("Status"), F.lit("")), F.lit("Proposed")).alias("status"),
        cell("Date").alias("date"),
    )


def markdown_links(c: Column) -> Column:
    """Targets of `[..](..)` without their fragment."""
    return _link_targets(c, MARKDOWN_LINK)


def html_links(c: Column) -> Column:
    """Targets of `href="..."` without their fragment."""
    return _link_targets(c, HTML_LINK)


def _link_targets(c: Column, pattern: str) -> Column:
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    return F.transform(found, lambda t: strip(F.split(t, "#").getItem(0)))


def trailing_digits(code: Column) -> Column:
    return F.regexp_extract(code, r"(?U)(\d+)$", 1)


# Book-code medium letters and class numerals.
MEDIUM = {"e": "English", "h": "Hindi", "u": "Urdu"}
ROMAN_CLASS = {
    "1": "I", "2": "II", "3": "III", "4": "IV", "5": "V", "6": "VI", "7": "VII",
    "8": "VIII", "9": "IX", "10": "X", "11": "XI", "12": "XII", "13": "XI & XII",
}


def language_of_code(code: Column) -> Column:
    return map_lookup(F.substring(code, 2, 1), MEDIUM, "Other")


def class_label(level: Column) -> Column:
    return F.concat(F.lit("Class "), map_lookup(level, ROMAN_CLASS, level))


def short_hash(c: Column, kind: str = "sha256", length: int = 16) -> Column:
    digest = F.sha1(c) if kind == "sha1" else F.sha2(c, 256)
    return F.substring(digest, 1, length)


def change_signature(size: Column, modified: Column) -> Column:
    """Size and modification stamp -> short hash; '' when the probe failed."""
    raw = F.concat(size.cast("string"), F.lit("|"), modified.cast("string"))
    return F.coalesce(short_hash(raw, "sha1"), F.lit(""))


def format_mmss(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    minutes = F.floor(seconds / 60).cast("string")
    return F.concat(minutes, F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def format_yyyymmdd(c: Column) -> Column:
    """Eight characters as date parts; anything else unchanged."""
    cut = F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2))
    return F.when(F.char_length(c) == 8, cut).otherwise(F.coalesce(c, F.lit("")))


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.75, "high").when(c >= 0.5, "medium").otherwise("low")


def percent(c: Column) -> Column:
    """Halves round up, as a display percentage does."""
    return F.concat(F.floor(c * 100 + 0.5).cast("string"), F.lit("%"))


def leaf_title(kind: Column, text: Column, a: Column, b: Column) -> Column:
    """`a`, `b`: rows and columns of a table, width and height of a figure."""
    size = F.concat(
        F.coalesce(a, F.lit(0)).cast("string"), F.lit("×"), F.coalesce(b, F.lit(0)).cast("string")
    )
    return (
        F.when(kind == "table", F.concat(F.lit("Table "), size))
        .when(kind == "figure", F.concat(F.lit("Figure "), size))
        .otherwise(snippet(text))
    )


def estimate_frames(duration: Column, sampling: Column, source: Column) -> Column:
    rate = F.coalesce(F.nullif(sampling, F.lit(0.0)), F.nullif(source, F.lit(0.0)), F.lit(30.0))
    return F.greatest(F.lit(0), F.bround(F.coalesce(duration, F.lit(0.0)) * rate)).cast("long")


# USD per 1,000 input and output tokens, by model.
PRICES = {
    "gpt-4o-mini": (0.00015, 0.0006),
    "openai/gpt-4o-mini": (0.00015, 0.0006),
    "gpt-4o": (0.0025, 0.01),
    "openai/gpt-4o": (0.0025, 0.01),
}


def token_cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    """Unknown models cost nothing."""
    rates = {name: F.struct(F.lit(i).alias("i"), F.lit(o).alias("o")) for name, (i, o) in PRICES.items()}
    table = F.create_map(*[x for name, rate in rates.items() for x in (F.lit(name), rate)])
    rate = F.try_element_at(table, F.coalesce(model, F.lit("")))
    rate_in, rate_out = F.coalesce(rate["i"], F.lit(0.0)), F.coalesce(rate["o"], F.lit(0.0))
    return round_binary(tokens_in / 1000 * rate_in + tokens_out / 1000 * rate_out, 6)


def line_jaccard(a: Column, b: Column) -> Column:
    """Share of common items of two sets given as distinct arrays; 0 if one is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(
        common / (F.size(a) + F.size(b) - common)
    )


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def escape_cell(c: Column) -> Column:
    """A value safe inside a Markdown table."""
    return F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
