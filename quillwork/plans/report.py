"""The report of a research session as Markdown and as JSON.

A report is rows of one line each (session_id, section, document_id, pos, line): sorted
and joined by line breaks they are the file. So a session may have any number of sources,
facts and entities, and no task gathers them. Only sessions with an analysed source have
a report. A consensus of several parts fills its sections part by part, and the single
fields of the JSON come from its first part.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions.json import lenient_json, object_items, text_field
from quillwork.operators.ordered import number_rows
from quillwork.session import materialise
from quillwork.sources.writers import markdown_table_rows

# Order and headings of the sections.
HEAD, SUMMARY, CONSENSUS, DIFFERENCES, CONFLICTS, ADVICE, TIMELINE, SOURCES, FACTS, ENTITIES = range(10)
TITLE = "# Knowledge Research Report - "
NO_SUMMARY = "_No summary produced._"
FACT_HEADS = ("Category", "Subcategory", "Value", "Confidence", "Source")
ENTITY_HEADS = ("Entity", "Type", "Category", "Confidence")
SESSION_FIELDS = (
    "mode", "input_value", "source_type", "ai_provider", "ai_model", "pipeline_version", "generated_at",
)

LINE = ("session_id", "section", "document_id", "pos", "line")
_LAST = 1 << 62
_TEXTS = "array<string>"


@dataclass(frozen=True)
class Session:
    """Tables of stored sessions.

    sessions: session_id and `SESSION_FIELDS`. sources: what `analysed_sources` makes.
    facts and entities: records with session_id, document_id, pos and source_label.
    consensus: session_id, part, content; empty where there is none.
    """

    sessions: DataFrame
    sources: DataFrame
    facts: DataFrame
    entities: DataFrame
    consensus: DataFrame


def _texts(v: Column, path: str) -> Column:
    found = F.coalesce(F.try_variant_get(v, path, _TEXTS), F.array().cast(_TEXTS))
    return F.filter(found, lambda x: x.isNotNull())


def _objects(v: Column, path: str) -> Column:
    """Objects of an array, each as JSON text."""
    return F.transform(object_items(v, path), lambda x: F.to_json(x))


def analysed_sources(answers: DataFrame) -> DataFrame:
    """One row per source any part of which was answered.

    Answers have session_id, document_id, part, index, title, url, source_label, content,
    status. A source in one part has its summary as it is; of several parts, those that
    were answered come one after the other under their numbers, and their lists together.
    """
    parsed = lenient_json(F.col("content"))
    lists = {n: _texts(parsed, f"$.{n}") for n in ("recommendations", "warnings", "mistakes")}
    lists["timeline"] = _objects(parsed, "$.timeline")
    good = F.col("status") == "SUCCESS"
    said = F.struct("part", text_field(parsed, "summary").alias("summary"), *[c.alias(n) for n, c in lists.items()])
    rows = answers.select("session_id", "document_id", "index", "title", "url", "source_label", F.when(good, said).alias("said"))
    # parts of one source: as many as its text has model-sized pieces
    grouped = rows.groupBy("session_id", "document_id").agg(
        *[F.any_value(c).alias(c) for c in ("index", "title", "url", "source_label")],
        F.count(F.lit(1)).alias("parts"),
        F.array_sort(F.collect_list("said"), lambda a, b: (a["part"] - b["part"]).cast("int")).alias("said"),
    )
    grouped = grouped.where(F.size("said") > 0)
    numbered = F.transform("said", lambda p: F.concat(F.lit("Part "), (p["part"] + 1).cast("string"), F.lit(": "), p["summary"]))
    summary = F.when(F.col("parts") > 1, F.array_join(numbered, "\n")).otherwise(F.col("said")[0]["summary"])
    together = [F.flatten(F.col(f"said.{n}")).alias(n) for n in lists]
    return grouped.select("session_id", "document_id", "index", "title", "url", "source_label", summary.alias("summary"), *together)


def _line(df: DataFrame, section: int, document: Column, pos: Column, line: Column) -> DataFrame:
    return df.select(
        "session_id", F.lit(section).alias("section"), document.cast("long").alias("document_id"),
        pos.cast("long").alias("pos"), line.alias("line"),
    )


def _framed(rows: DataFrame, section: int, heading: Sequence[str], sessions: DataFrame | None = None) -> DataFrame:
    """Rows of a section under its heading lines, an empty line behind; for `sessions`, else where there are rows."""
    named = (rows if sessions is None else sessions).select("session_id").distinct()
    head = named.select("session_id", F.posexplode(F.array(*[F.lit(x) for x in heading])).alias("pos", "line"))
    head = _line(head, section, F.lit(-1), F.col("pos"), F.col("line"))
    return head.unionByName(rows).unionByName(_line(named, section, F.lit(_LAST), F.lit(0), F.lit("")))


def _spread(df: DataFrame, section: int, lines: Column, document: Column) -> DataFrame:
    """An array of lines as rows."""
    rows = df.select("session_id", document.alias("__d"), F.posexplode(lines).alias("pos", "line"))
    return _line(rows, section, F.col("__d"), F.col("pos"), F.col("line"))


def _sides(session: Session) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(consensus parts parsed as `v`, the first source of every session, that of sessions without a consensus)."""
    agreed = session.consensus.select("session_id", "part", lenient_json(F.col("content")).alias("v"))
    first = F.min_by(F.struct(*session.sources.columns), "index").alias("s")
    primary = session.sources.groupBy("session_id").agg(first).select("s.*")
    return agreed, primary, primary.join(agreed.select("session_id").distinct(), "session_id", "left_anti")


def _advice(summary: Column, steps: Column, rationale: Column) -> Column:
    """Lines of a recommendation, none without summary and steps."""
    empty = F.array().cast(_TEXTS)
    lines = F.concat(
        F.when(summary != "", F.array(summary, F.lit(""))).otherwise(empty),
        F.transform(steps, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)),
        F.when(rationale != "", F.array(F.lit(""), F.concat(F.lit("*Rationale: "), rationale, F.lit("*")))).otherwise(empty),
    )
    return F.when((summary != "") | (F.size(steps) > 0), lines).otherwise(empty)


def _timeline_of(agreed: DataFrame, primary: DataFrame) -> DataFrame:
    """(session_id, part, timeline): that of the consensus, where it has none that of the first source."""
    own = agreed.select("session_id", "part", _objects(F.col("v"), "$.timeline").alias("timeline")).where(F.size("timeline") > 0)
    rest = primary.join(own.select("session_id").distinct(), "session_id", "left_anti")
    return own.unionByName(rest.select("session_id", F.lit(0).cast(own.schema["part"].dataType).alias("part"), "timeline"))


def markdown_report(session: Session) -> DataFrame:
    """Lines of the Markdown report of every session."""
    agreed, primary, single = _sides(session)
    part, v, o = F.col("part"), F.col("v"), F.col("o")

    sizes = session.sources.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))
    heads = session.sessions.join(sizes, "session_id")
    meta = F.concat(
        F.lit("*Mode: "), "mode", F.lit(" | Sources: "), F.col("n").cast("string"), F.lit(" | Model: "), "ai_model",
        F.lit(" | Pipeline: "), "pipeline_version", F.lit(" | Generated: "), "generated_at", F.lit("*"),
    )
    title = F.array(F.concat(F.lit(TITLE), "input_value"), F.lit(""), meta, F.lit(""))
    out = _spread(heads, HEAD, title, F.lit(0))

    shown = lambda c: F.when(c != "", c).otherwise(NO_SUMMARY)
    summaries = _line(agreed, SUMMARY, part, F.lit(0), shown(text_field(v, "executive_summary")))
    summaries = summaries.unionByName(_line(single, SUMMARY, F.lit(0), F.lit(0), shown(F.col("summary"))))
    out = out.unionByName(_framed(summaries, SUMMARY, ["## Executive Summary", ""]))

    def items(path: str, section: int, line: Column) -> DataFrame:
        rows = agreed.select("session_id", "part", F.posexplode(object_items(v, f"$.{path}")).alias("pos", "o"))
        return _line(rows, section, part, F.col("pos") * 1_000, line)

    practice = F.concat(
        F.lit("- **"), text_field(o, "practice"), F.lit("** (confidence "), F.coalesce(F.try_variant_get(o, "$.confidence", "string"), F.lit("0")),
        F.lit("; "), F.array_join(_texts(o, "$.supported_by"), ", "), F.lit(")"),
    )
    out = out.unionByName(_framed(items("common_practices", CONSENSUS, practice), CONSENSUS, ["## Consensus", ""], agreed))

    aspects = items("differences", DIFFERENCES, F.concat(F.lit("- **"), text_field(o, "aspect"), F.lit("**")))
    places = agreed.select("session_id", "part", F.posexplode(object_items(v, "$.differences")).alias("at", "d"))
    places = places.select("session_id", "part", "at", F.posexplode(object_items(F.col("d"), "$.positions")).alias("pos", "o"))
    said = F.concat(F.lit("  - "), text_field(o, "source"), F.lit(": "), text_field(o, "position"))
    aspects = aspects.unionByName(_line(places, DIFFERENCES, part, F.col("at") * 1_000 + 1 + F.col("pos"), said))
    out = out.unionByName(_framed(aspects, DIFFERENCES, ["### Differences Between Sources", ""]))

    clash = F.concat(
        F.lit("- **"), text_field(o, "topic"), F.lit("**: "), text_field(o, "conflict"),
        F.lit(" ("), F.array_join(_texts(o, "$.sources"), ", "), F.lit(")"),
    )
    out = out.unionByName(_framed(items("conflicting_advice", CONFLICTS, clash), CONFLICTS, ["## Conflicting Advice", ""]))

    field = lambda name: F.coalesce(F.try_variant_get(v, f"$.recommendation.{name}", "string"), F.lit(""))
    advice = _spread(agreed, ADVICE, _advice(field("summary"), _texts(v, "$.recommendation.steps"), field("rationale")), part)
    advice = advice.unionByName(_spread(single, ADVICE, _advice(F.lit(""), F.col("recommendations"), F.lit("")), F.lit(0)))
    out = out.unionByName(_framed(advice, ADVICE, ["## Recommendation", ""]))

    steps = _timeline_of(agreed, primary).select("session_id", "part", F.posexplode("timeline").alias("pos", "json"))
    steps = steps.withColumn("o", F.parse_json("json"))
    timing = F.when(text_field(o, "timing") != "", F.concat(F.lit(" ("), text_field(o, "timing"), F.lit(")"))).otherwise("")
    step = F.concat(
        text_field(o, "step"), F.lit(". **"), text_field(o, "label"), F.lit("**"), timing, F.lit(" - "), text_field(o, "detail")
    )
    out = out.unionByName(_framed(_line(steps, TIMELINE, part, F.col("pos"), step), TIMELINE, ["## Timeline", ""]))

    heading = F.concat(F.lit("### Source "), F.col("index").cast("string"), F.lit(": "), "title")
    warned = F.array(F.concat(F.lit("**Warnings:** "), F.array_join("warnings", "; ")), F.lit(""))
    about = F.concat(
        F.array(heading, F.lit(""), F.col("url"), F.lit(""), F.col("summary"), F.lit("")),
        F.when(F.size("warnings") > 0, warned).otherwise(F.array().cast(_TEXTS)),
    )
    listed = _spread(session.sources, SOURCES, about, F.col("index"))
    named = session.sources.select("session_id").distinct()
    heads = named.select("session_id", F.posexplode(F.array(F.lit("## Sources"), F.lit(""))).alias("pos", "line"))
    out = out.unionByName(_line(heads, SOURCES, F.lit(-1), F.col("pos"), F.col("line"))).unionByName(listed)
    return out.unionByName(table_lines(session.facts, session.entities))


def table_lines(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Lines of the two tables of a Markdown report."""
    out = None
    tables = (
        (FACTS, "## Extracted Facts", FACT_HEADS, facts, ["category", "subcategory", "value", "confidence", "source_label"]),
        (ENTITIES, "## Entities", ENTITY_HEADS, entities, ["name", "type", "category", "confidence"]),
    )
    for section, heading, names, rows, columns in tables:
        lines = _line(rows, section, F.col("document_id"), F.col("pos"), markdown_table_rows(rows, columns))
        framed = _framed(lines, section, [heading, "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)])
        out = framed if out is None else out.unionByName(framed)
    return out


# ---- JSON -------------------------------------------------------------------


def _json(c: Column) -> Column:
    """One value as JSON text."""
    whole = F.to_json(F.struct(c.alias("v")))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.substring(whole, F.lit(6), F.char_length(whole) - 6))


def _array(texts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(texts, ", "), F.lit("]"))


def report_fields(session: Session) -> DataFrame:
    """Per session: executive_summary, recommendation, timeline and conflicts, the last three as JSON.

    A consensus provides them where there is one (its timeline only if not empty), else
    the first source does, which knows of no conflicts.
    """
    agreed, primary, single = _sides(session)
    first = agreed.groupBy("session_id").agg(F.min("part").alias("part"))
    first = agreed.join(first, ["session_id", "part"])
    v = F.col("v")
    advice = F.coalesce(F.to_json(F.try_variant_get(v, "$.recommendation", "variant")), F.lit("{}"))
    both = first.select(
        "session_id", text_field(v, "executive_summary").alias("executive_summary"), advice.alias("recommendation"),
        _array(_objects(v, "$.conflicting_advice")).alias("conflicts"),
    )
    steps = F.to_json(F.struct(F.lit("").alias("summary"), F.col("recommendations").alias("steps"), F.lit("").alias("rationale")))
    alone = single.select("session_id", F.col("summary").alias("executive_summary"), steps.alias("recommendation"), F.lit("[]").alias("conflicts"))
    times = _timeline_of(agreed, primary)
    least = times.groupBy("session_id").agg(F.min("part").alias("part"))
    times = times.join(least, ["session_id", "part"]).select("session_id", _array(F.col("timeline")).alias("timeline"))
    return both.unionByName(alone).join(times, "session_id", "left").withColumn("timeline", F.coalesce("timeline", F.lit("[]")))


def _listed(rows: DataFrame, named: DataFrame, section: int, name: str, last: bool = False) -> DataFrame:
    """Rows (session_id, document_id, pos, json) as the elements of a field; a comma leads all but the first."""
    place = F.struct("document_id", "pos")
    least = rows.groupBy("session_id").agg(F.min(place).alias("least"))
    joined = rows.join(least, "session_id")
    comma = F.when(place == F.col("least"), "").otherwise(",")
    body = _line(joined, section, F.col("document_id"), F.col("pos"), F.concat(comma, F.col("json")))
    opened = _line(named, section, F.lit(-1), F.lit(0), F.lit(f'"{name}": ['))
    return opened.unionByName(body).unionByName(_line(named, section, F.lit(_LAST), F.lit(0), F.lit("]" if last else "],")))


def json_report(session: Session) -> DataFrame:
    """Lines of the JSON report of every session: its fields, consensus, documents, facts and entities.

    `consensus` is null without one, its object if it has one part, else an array of objects.
    """
    fields = report_fields(session)
    parts = session.consensus.groupBy("session_id").agg(F.count(F.lit(1)).alias("parts"))
    # one row for each session, which every section asks for
    named = materialise(session.sessions.join(fields, "session_id").join(parts, "session_id", "left"))
    before = [*[_json(F.col(c)).alias(c) for c in ("session_id", *SESSION_FIELDS)], _json(F.col("executive_summary")).alias("executive_summary")]
    lines = F.array(
        F.lit("{"), *[F.concat(F.lit(f'"{name}": '), c, F.lit(",")) for name, c in zip(("session_id", *SESSION_FIELDS, "executive_summary"), before, strict=True)]
    )
    out = _spread(named, 0, lines, F.lit(0))

    agreed = session.consensus.select("session_id", "part", F.to_json(lenient_json(F.col("content"))).alias("json")).join(parts, "session_id")
    first = agreed.groupBy("session_id").agg(F.min("part").alias("least"))
    agreed = agreed.join(first, "session_id")
    comma = F.when(F.col("part") == F.col("least"), "").otherwise(",")
    body = F.when(F.col("parts") == 1, F.concat(F.lit('"consensus": '), "json", F.lit(","))).otherwise(F.concat(comma, "json"))
    out = out.unionByName(_line(agreed, 1, F.col("part"), F.lit(0), body))
    out = out.unionByName(_line(named.where("parts is null"), 1, F.lit(0), F.lit(0), F.lit('"consensus": null,')))
    several = named.where("parts > 1")
    out = out.unionByName(_line(several, 1, F.lit(-1), F.lit(0), F.lit('"consensus": [')))
    out = out.unionByName(_line(several, 1, F.lit(_LAST), F.lit(0), F.lit("],")))

    rest = F.array(*[F.concat(F.lit(f'"{name}": '), F.col(name), F.lit(",")) for name in ("recommendation", "timeline", "conflicts")])
    out = out.unionByName(_spread(named, 2, rest, F.lit(0)))

    about = F.to_json(F.struct("index", "document_id", "title", "url", "summary", "recommendations", "warnings", "mistakes"))
    documents = session.sources.select("session_id", F.col("index").cast("long").alias("__i"), about.alias("json"))
    documents = documents.select("session_id", F.col("__i").alias("document_id"), F.lit(0).cast("long").alias("pos"), "json")

    def records(df: DataFrame, names: dict[str, str]) -> DataFrame:
        body = F.to_json(F.struct(*[F.col(c).alias(n) for c, n in names.items()]))
        return df.select("session_id", "document_id", "pos", body.alias("json"))

    kept = lambda df, *left: {c: c for c in df.columns if c not in ("session_id", "document_id", "pos", "source_label", *left)}
    facts = records(session.facts, {**kept(session.facts), "source_label": "source_document"})
    names = {"name": "entity_name", "type": "entity_type", **kept(session.entities, "name", "type"), "source_label": "source_document"}
    out = out.unionByName(_listed(documents, named, 3, "documents"))
    out = out.unionByName(_listed(facts, named, 4, "facts"))
    out = out.unionByName(_listed(records(session.entities, names), named, 5, "entities", last=True))
    return out.unionByName(_line(named, 6, F.lit(0), F.lit(0), F.lit("}")))


def write_report(lines: DataFrame, path: str) -> None:
    """Reports as text below `path`, a folder for each session; its files in the order of their names are the report."""
    order = ["session_id", "section", "document_id", "pos"]
    dealt = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.select("session_id", F.col("line").alias("value")).write.partitionBy("session_id").text(path)


def numbered_report(lines: DataFrame) -> DataFrame:
    """(session_id, at, line): lines numbered from 0 within their session."""
    order = [F.col(c) for c in ("section", "document_id", "pos")]
    return number_rows(lines, ["session_id"], order, "at").df.select("session_id", "at", "line")
