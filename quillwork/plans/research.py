"""Topic research: sources -> merged text -> model answers -> facts -> report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions.json import lenient_json, number_field, object_items, text_field
from quillwork.functions.text import ANALYSIS_CHARS
from quillwork.operators.aggregates import conflicting_claims, cross_source_support
from quillwork.operators.inference import batch_infer, run_ledger, session_status
from quillwork.operators.ordered import number_rows, total
from quillwork.operators.sets import merge_text_channels
from quillwork.plans.report import Session, analysed_sources, json_report, markdown_report
from quillwork.session import materialise

# Layout of the prompts.
ANALYZE_VERSION = "1.0"
CONSENSUS_VERSION = "1.0"
PIPELINE_VERSION = "1.0"
FACT_TEXTS = ("category", "subcategory", "value", "evidence", "stage")
ENTITY_TEXTS = ("name", "type", "category", "evidence")
PART_STRIDE = 1_000_000  # positions of the facts of one part of a source


def analyze_prompt(title: Column, kind: Column, text: Column) -> Column:
    """User prompt of one source, or of one part of a source that is longer than the model's budget."""
    return F.concat(
        F.lit("Source title: "), title, F.lit("\nSource type: "), kind, F.lit("\n\nExtracted text:\n"), text
    )


def text_parts(df: DataFrame, text: str, chars: int = ANALYSIS_CHARS) -> DataFrame:
    """Rows numbered by `part`, `text` cut into parts of at most `chars` characters; nothing is dropped."""
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.char_length(text) / F.lit(chars)) - 1, F.lit(0)))
    rows = df.withColumn("part", F.explode(parts))
    return rows.withColumn(text, F.substring(F.col(text), F.col("part").cast("int") * chars + 1, F.lit(chars)))


def coerce_records(answers: DataFrame, path: str, texts: tuple[str, ...]) -> DataFrame:
    """Objects of a JSON array as rows: missing texts '', confidence 0; others skipped."""
    parsed = lenient_json(F.col("content"))
    rows = answers.select(
        "session_id", "document_id", "source_label", "part",
        F.posexplode(object_items(parsed, f"$.{path}")).alias("pos", "__o"),
    )
    o = F.col("__o")
    return rows.select(
        "session_id", "document_id", "source_label",
        (F.col("part") * PART_STRIDE + F.col("pos")).cast("long").alias("pos"),
        *[text_field(o, t).alias(t) for t in texts],
        number_field(o, "confidence").alias("confidence"),
    )


def consensus_prompt(facts: DataFrame, summaries: DataFrame, topic: Column, chars: int = ANALYSIS_CHARS) -> DataFrame:
    """Prompts of a session, numbered by `part`: a block per source with its summary and all its facts.

    Blocks are kept whole and fill parts of about `chars` characters in the order of
    the sources, so what is gathered for a prompt is bounded by that and one block.
    """
    line = F.concat(F.lit("- ["), "category", F.lit("] "), "value")
    ordered = F.array_sort(F.collect_list(F.struct("pos", line.alias("l"))))
    listed = facts.groupBy("session_id", "document_id").agg(
        F.array_join(F.transform(ordered, lambda x: x["l"]), "\n").alias("__facts")
    )
    joined = summaries.join(listed, ["session_id", "document_id"], "left")
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("--- "), "source_label", F.lit(" ---")),
        F.concat(F.lit("Summary: "), "summary"),
        F.when(F.col("__facts").isNotNull(), F.lit("Key facts:")),
        F.col("__facts"),
    )
    sized = materialise(joined.select("session_id", "document_id", block.alias("__block")))
    rows = number_rows(sized, ["session_id"], [F.col("document_id")], "__at")
    length = F.char_length("__block") + 2
    rows = rows.scan(__end=total(length.cast("long")))
    placed = rows.df.withColumn("part", F.floor((F.col("__end") - length) / F.lit(chars)).cast("long"))
    ordered = F.array_sort(F.collect_list(F.struct("__at", "__block")))
    blocks = F.array_join(F.transform(ordered, lambda x: x["__block"]), "\n\n")
    prompts = placed.groupBy("session_id", "part").agg(blocks.alias("sources_block"))
    head = F.concat(F.lit("Research topic: "), topic, F.lit("\n\n"))
    return prompts.withColumn("user_prompt", F.concat(head, "sources_block"))


@dataclass(frozen=True)
class Research:
    answers: DataFrame
    facts: DataFrame
    entities: DataFrame
    support: DataFrame
    conflicts: DataFrame
    consensus: DataFrame
    ledger: DataFrame
    status: DataFrame
    report: DataFrame
    report_json: DataFrame


def research_session(
    sources: DataFrame,
    make_client: Callable,
    model: str,
    backoff: float = 2.0,
    topic: Column | None = None,
    sessions: DataFrame | None = None,
) -> Research:
    """Sources (session_id, document_id, title, document_type, channels..., url if known) to a report.

    The model is called once for every part of a source, and once for every part of
    the consensus of a session with two or more analysed sources; answers are stored
    before anything is derived from them. A part whose call fails leaves an error row. A
    source counts as analysed if any of its parts was answered; the session fails only
    when none of its sources is. `sessions` has the fields that head a report
    (`report.SESSION_FIELDS`), by default made of `topic` and `model`.
    """
    if "url" not in sources.columns:
        sources = sources.withColumn("url", F.lit(""))
    merged = merge_text_channels(sources).filter("error is null")
    numbered = number_rows(merged, ["session_id"], [F.col("document_id")], "__n").df
    numbered = numbered.withColumn("index", F.col("__n") + 1)
    label = F.concat(F.lit("Source "), F.col("index").cast("string"), F.lit(": "), "title")
    parts = text_parts(numbered.withColumn("source_label", label), "merged_text")
    ready = parts.select(
        "session_id", "document_id", "part", "index", "title", F.coalesce("url", F.lit("")).alias("url"), "source_label",
        F.lit(model).alias("model"), F.lit("analyze").alias("system_prompt"),
        analyze_prompt(F.col("title"), F.col("document_type"), F.col("merged_text")).alias("user_prompt"),
    )
    prompts = ["system_prompt", "user_prompt"]
    answers = materialise(batch_infer(ready, make_client, prompts, backoff=backoff))
    good = answers.filter("status = 'SUCCESS'")
    facts = coerce_records(good, "facts", FACT_TEXTS)
    entities = coerce_records(good, "entities", ENTITY_TEXTS)
    analysed = materialise(analysed_sources(answers))
    several = analysed.groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    summaries = analysed.join(several.select("session_id"), "session_id", "left_semi")
    summaries = summaries.select("session_id", "document_id", "source_label", "summary")
    topic = F.lit("") if topic is None else topic
    compared = consensus_prompt(
        facts.join(several.select("session_id"), "session_id", "left_semi"), summaries, topic
    ).select(
        "session_id", F.lit(None).cast(answers.schema["document_id"].dataType).alias("document_id"), "part",
        F.lit(model).alias("model"), F.lit("consensus").alias("system_prompt"), "user_prompt",
    )
    consensus = materialise(batch_infer(compared, make_client, prompts, backoff=backoff))
    if sessions is None:
        fixed = {"mode": F.lit("topic"), "input_value": topic, "source_type": F.lit("mixed"), "ai_provider": F.lit(""),
                 "ai_model": F.lit(model), "pipeline_version": F.lit(PIPELINE_VERSION), "generated_at": F.lit("")}
        sessions = sources.select("session_id").distinct().withColumns(fixed)
    agreed = consensus.filter("status = 'SUCCESS'").select("session_id", "part", "content")
    session = Session(sessions, analysed, facts, entities, agreed)
    ledger = run_ledger(answers, "ANALYZING", "analyze_document", ANALYZE_VERSION).unionByName(
        run_ledger(consensus, "COMPARING", "consensus", CONSENSUS_VERSION)
    )
    return Research(
        answers=answers,
        facts=facts,
        entities=entities,
        support=cross_source_support(facts),
        conflicts=conflicting_claims(facts),
        consensus=consensus,
        ledger=ledger,
        status=session_status(answers, "session_id"),
        report=markdown_report(session),
        report_json=json_report(session),
    )
