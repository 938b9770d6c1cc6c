"""B: sinks and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import query, rounded
from queries.joins import COST
from quillwork.operators import upkeep as ops
from quillwork.operators.inference import run_ledger
from quillwork.plans import report
from quillwork.session import materialise
from quillwork.sources import writers



@query(
    "b1_export_nested_json",
    """SELECT job_id, part, count(*) OVER (PARTITION BY job_id) * 0 + n AS question_count, shown, first_text FROM (
      SELECT job_id, i // 10 AS part, any_value(n) AS n, count(*) AS shown, arg_min(text, i) AS first_text FROM (
        SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY id) - 1 AS i,
          count(*) OVER (PARTITION BY job_id) AS n FROM questions) GROUP BY ALL)""",
)
def _(t):
    jobs = t.frames.df.select("job_id").distinct().withColumn("url", F.concat(F.lit("job-"), "job_id"))
    parts = writers.export_nested_json(jobs, t.questions, part_rows=10)
    doc = F.col("document")
    return parts.select(
        "job_id", "part",
        F.get_json_object(doc, "$.question_count").cast("long").alias("question_count"),
        F.json_array_length(F.get_json_object(doc, "$.questions")).cast("long").alias("shown"),
        F.get_json_object(doc, "$.questions[0].text").alias("first_text"),
    )


@query(
    "b1_export_nested_json_frames",
    """SELECT job_id, i // 50 AS part, count(*) AS frames, min(index) AS first_index FROM (
      SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY index) - 1 AS i FROM frames) GROUP BY ALL""",
)
def _(t):
    jobs = t.frames.df.select("job_id").distinct().withColumn("url", F.concat(F.lit("job-"), "job_id"))
    frames = t.frames.df.withColumn("classification", F.array(F.lit("paragraph")))
    parts = writers.export_nested_json(jobs, t.questions, frames, part_rows=50)
    doc = F.col("document")
    return parts.select(
        "job_id", "part",
        F.json_array_length(F.get_json_object(doc, "$.frames")).cast("long").alias("frames"),
        F.get_json_object(doc, "$.frames[0].index").cast("long").alias("first_index"),
    ).filter("frames > 0")


EXPORT_SQL = f"""
    SELECT job_id, id, text, '' AS options, timestamp, source, status, frame_start, frame_end,
      coalesce(a, b) AS ocr_confidence, coalesce(c, d) AS frame_confidence,
      coalesce(e, 1) AS merge_confidence, coalesce(f, 1) AS overall_confidence
    FROM questions q LEFT JOIN (SELECT job_id, frame_start + 1 AS id, {rounded("o", 4)} AS a,
        {rounded("f", 4)} AS c, {rounded("g", 4)} AS e, {rounded("overall", 4)} AS f FROM auto_questions) x
      USING (job_id, id)
    LEFT JOIN (SELECT job_id, 0 AS id, ocr_confidence AS b, question_score AS d FROM frames WHERE index = 0) y
      USING (job_id, id)"""


@query("b2_export_csv", f"SELECT * EXCLUDE (job_id) FROM ({EXPORT_SQL})")
def _(t):
    return writers.csv_rows(t.questions)


@query("b3_export_table", f"SELECT * EXCLUDE (options), '[]' AS options FROM ({EXPORT_SQL})")
def _(t):
    return writers.table_rows(t.questions)


def _session(t) -> report.Session:
    """Half of the sessions have a consensus, a quarter one with a timeline."""
    # every section reads them again
    facts = materialise(t.facts.withColumn("confidence", F.lit(0.5)))
    first = F.min_by("value", "pos").alias("summary")
    rows = facts.groupBy("session_id", "document_id", "source_label").agg(first)
    none = F.array().cast("array<string>")
    sources = rows.select(
        "session_id", "document_id", F.col("document_id").alias("index"), F.col("source_label").alias("title"),
        F.lit("").alias("url"), "source_label", "summary", F.array("source_label").alias("recommendations"),
        none.alias("warnings"), none.alias("mistakes"), F.array(F.lit('{"step":"1","label":"own step"}')).alias("timeline"),
    )
    n = F.col("session_id").cast("string")
    times = F.when(F.col("session_id") % 4 == 0, ', "timeline": [{"label": "joint step"}]').otherwise("")
    content = F.concat(
        F.lit('{"executive_summary": "agreed '), n, F.lit('", "recommendation": {}, "conflicting_advice": [{"topic": "t"}]'), times, F.lit("}")
    )
    named = materialise(facts.select("session_id").distinct())
    consensus = named.where("session_id % 2 = 0").select("session_id", F.lit(0).cast("long").alias("part"), content.alias("content"))
    sessions = named.withColumns({c: F.lit(c) for c in report.SESSION_FIELDS})
    entities = facts.select(
        "session_id", "document_id", "pos", "source_label", F.col("source_label").alias("name"), F.lit("source").alias("type"),
        "category", "confidence",
    )
    return report.Session(sessions, materialise(sources), facts, entities, consensus)


@query(
    "b4_render_report_json",
    """SELECT session_id, CASE WHEN session_id % 2 = 0 THEN 'agreed ' || session_id::VARCHAR ELSE value END AS summary,
      CASE WHEN session_id % 4 = 0 THEN 'joint step' ELSE 'own step' END AS step,
      CASE WHEN session_id % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS conflicts,
      CASE WHEN session_id % 2 = 1 THEN source_label END AS advice
    FROM (SELECT session_id, arg_min(value, document_id * 1000000 + pos) AS value,
        arg_min(source_label, document_id * 1000000 + pos) AS source_label
      FROM facts GROUP BY ALL)""",
)
def _(t):
    get = F.get_json_object
    return report.report_fields(_session(t)).select(
        "session_id", F.col("executive_summary").alias("summary"), get("timeline", "$[0].label").alias("step"),
        F.json_array_length("conflicts").cast("long").alias("conflicts"), get("recommendation", "$.steps[0]").alias("advice"),
    )


@query(
    "b4_report_json_lines",
    """WITH heads AS (SELECT DISTINCT session_id FROM facts),
    f AS (SELECT session_id, document_id, pos, source_label, to_json({'category': category, 'subcategory': subcategory, 'value': value,
        'confidence': 0.5::DOUBLE, 'source_document': source_label})::VARCHAR AS body,
        min(document_id * 1000000 + pos) OVER (PARTITION BY session_id) = document_id * 1000000 + pos AS first FROM facts),
    e AS (SELECT session_id, document_id, pos, to_json({'entity_name': source_label, 'entity_type': 'source', 'category': category,
        'confidence': 0.5::DOUBLE, 'source_document': source_label})::VARCHAR AS body,
        min(document_id * 1000000 + pos) OVER (PARTITION BY session_id) = document_id * 1000000 + pos AS first FROM facts)
    SELECT session_id, 4 AS section, document_id, pos, CASE WHEN first THEN '' ELSE ',' END || body AS line FROM f
    UNION ALL SELECT session_id, 5, document_id, pos, CASE WHEN first THEN '' ELSE ',' END || body FROM e
    UNION ALL SELECT session_id, 4, -1, 0, '"facts": [' FROM heads
    UNION ALL SELECT session_id, 4, 4611686018427387904, 0, '],' FROM heads
    UNION ALL SELECT session_id, 5, -1, 0, '"entities": [' FROM heads
    UNION ALL SELECT session_id, 5, 4611686018427387904, 0, ']' FROM heads
    UNION ALL SELECT session_id, 6, 0, 0, '}' FROM heads
    UNION ALL SELECT session_id, 1, 0, 0, '"consensus": null,' FROM heads WHERE session_id % 2 = 1""",
)
def _(t):
    return report.json_report(_session(t)).where("section > 3 or section = 1 and session_id % 2 = 1")


@query(
    "b5_render_report_markdown",
    """WITH heads AS (SELECT DISTINCT session_id FROM facts), docs AS (
      SELECT session_id, document_id, source_label, arg_min(value, pos) AS summary FROM facts GROUP BY ALL), fixed AS (
      SELECT * FROM (VALUES (1, -1, 0, '## Executive Summary'), (1, -1, 1, ''), (6, -1, 0, '## Timeline'), (6, -1, 1, ''),
        (7, -1, 0, '## Sources'), (7, -1, 1, ''), (8, -1, 0, '## Extracted Facts'), (8, -1, 1, ''),
        (8, -1, 2, '| Category | Subcategory | Value | Confidence | Source |'), (8, -1, 3, '|---|---|---|---|---|'),
        (9, -1, 0, '## Entities'), (9, -1, 1, ''), (9, -1, 2, '| Entity | Type | Category | Confidence |'),
        (9, -1, 3, '|---|---|---|---|'), (1, 4611686018427387904, 0, ''), (6, 4611686018427387904, 0, ''),
        (8, 4611686018427387904, 0, ''), (9, 4611686018427387904, 0, ''),
        (0, 0, 0, '# Knowledge Research Report - input_value'), (0, 0, 1, ''), (0, 0, 3, '')) v(section, document_id, pos, line))
    SELECT session_id, section, document_id, pos::BIGINT AS pos, line FROM heads, fixed
    UNION ALL SELECT session_id, section, document_id, pos, line FROM heads, (VALUES (2, -1, 0, '## Consensus'), (2, -1, 1, ''),
        (2, 4611686018427387904, 0, ''), (4, -1, 0, '## Conflicting Advice'), (4, -1, 1, ''), (4, 0, 0, '- **t**:  ()'),
        (4, 4611686018427387904, 0, '')) v(section, document_id, pos, line) WHERE session_id % 2 = 0
    UNION ALL SELECT session_id, section, document_id, pos, line FROM heads, (VALUES (5, -1, 0, '## Recommendation'), (5, -1, 1, ''),
        (5, 4611686018427387904, 0, '')) v(section, document_id, pos, line) WHERE session_id % 2 = 1
    UNION ALL SELECT session_id, 5, 0, 0, '1. ' || arg_min(source_label, document_id) FROM docs WHERE session_id % 2 = 1 GROUP BY session_id
    UNION ALL SELECT session_id, 1, 0, 0, CASE WHEN session_id % 2 = 0 THEN 'agreed ' || session_id::VARCHAR
      ELSE arg_min(summary, document_id) END FROM docs GROUP BY session_id
    UNION ALL SELECT session_id, 6, 0, 0, CASE WHEN session_id % 4 = 0 THEN '. **joint step** - ' ELSE '1. **own step** - ' END FROM heads
    UNION ALL SELECT session_id, 0, 0, 2, '*Mode: mode | Sources: ' || count(*)::VARCHAR
      || ' | Model: ai_model | Pipeline: pipeline_version | Generated: generated_at*' FROM docs GROUP BY session_id
    UNION ALL SELECT session_id, 7, document_id, i, [ '### Source ' || document_id::VARCHAR || ': ' || source_label, '', '', '', summary, ''][i + 1]
      FROM docs, generate_series(0, 5) g(i)
    UNION ALL SELECT session_id, 8, document_id, pos, '| ' || category || ' | ' || subcategory || ' | ' || value
      || ' | 0.5 | ' || source_label || ' |' FROM facts
    UNION ALL SELECT session_id, 9, document_id, pos, '| ' || source_label || ' | source | ' || category
      || ' | 0.5 |' FROM facts""",
)
def _(t):
    return report.markdown_report(_session(t))


@query(
    "b5_escaped_table_rows",
    """SELECT doc_id, '| ' || doc_id::VARCHAR || ' | ' || replace(replace(text, '|', '\\|'), chr(10), ' ') || ' |' AS line
    FROM documents""",
)
def _(t):
    row = writers.markdown_table_rows(t.documents, ["doc_id", "text"], escape=True)
    return t.documents.select("doc_id", row.alias("line"))


@query(
    "b6_replace_by_key",
    """SELECT document_id, order_index, text FROM elements WHERE document_id % 4 <> 0
    UNION ALL SELECT document_id, order_index, 'new ' || text FROM elements
      WHERE document_id % 4 = 0 AND order_index % 2 = 0""",
)
def _(t):
    rows = t.elements.df.select("document_id", "order_index", "text")
    fresh = rows.filter("document_id % 4 = 0 and order_index % 2 = 0").withColumn("text", F.concat(F.lit("new "), "text"))
    return ops.replace_by_key(rows, fresh, ["document_id"])


@query(
    "b7_replace_auto_keep_manual",
    """SELECT job_id, id, source, text FROM questions WHERE source <> 'auto' OR job_id % 2 = 1
    UNION ALL SELECT job_id, id, 'auto', 'again ' || text FROM questions WHERE source = 'auto' AND job_id % 2 = 0""",
)
def _(t):
    rows = t.questions.select("job_id", "id", "source", "text")
    fresh = rows.filter("source = 'auto' and job_id % 2 = 0")
    fresh = fresh.withColumn("text", F.concat(F.lit("again "), "text"))
    return ops.replace_auto_keep_manual(rows, fresh, "job_id")


@query(
    "b8_upsert_catalog",
    """SELECT book_code, coalesce(s.class_level, b.class_level) AS class_level, coalesce(s.subject, b.subject) AS subject,
      coalesce(s.title, b.title) AS title, CASE WHEN b.book_code IS NULL THEN 'available' ELSE b.status END AS status,
      coalesce(b.downloaded, false) AS downloaded, b.file_size, coalesce(b.version_hash, '') AS version_hash
    FROM shelf b FULL JOIN scanned s USING (book_code)""",
)
def _(t):
    defaults = {"status": F.lit("available"), "downloaded": F.lit(False), "version_hash": F.lit("")}
    return ops.upsert_catalog(t.shelf, t.scanned, "book_code", ["class_level", "subject", "title"], defaults)


@query(
    "b8_count_new",
    "SELECT count(*) AS new_count FROM scanned WHERE book_code NOT IN (SELECT book_code FROM shelf)",
)
def _(t):
    return ops.count_new(t.shelf, t.scanned, "book_code")


@query(
    "b9_apply_patch",
    """SELECT b.book_code, CASE WHEN b.book_code % 4 = 0 THEN 'patched' ELSE b.status END AS status,
      coalesce(s.title, b.title) AS title, b.file_size FROM shelf b LEFT JOIN scanned s USING (book_code)""",
)
def _(t):
    patch = t.scanned.select(
        "book_code", F.when(F.col("book_code") % 4 == 0, "patched").alias("status"), "title"
    )
    return ops.apply_patch(t.shelf, patch, "book_code").select("book_code", "status", "title", "file_size")


@query(
    "b10_cascade_delete",
    """SELECT 'orders' AS "table", count(*) AS rows_left FROM orders WHERE o_orderstatus <> 'F'
    UNION ALL SELECT 'lineitem', count(*) FROM lineitem
      WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
)
def _(t):
    doomed = t.orders.filter("o_orderstatus = 'F'").select("o_orderkey")
    tables = {"orders": (t.orders, "o_orderkey"), "lineitem": (t.lineitem, "l_orderkey")}
    left = ops.cascade_delete(doomed, tables, "o_orderkey")
    counts = [df.agg(F.count(F.lit(1)).alias("rows_left")).select(F.lit(n).alias("table"), "rows_left") for n, df in left.items()]
    return counts[0].unionByName(counts[1])


@query(
    "b11_append_run_ledger",
    f"""SELECT session_id, document_id, stage, model, user_prompt_hash, input_tokens, output_tokens, status,
      CASE WHEN status = 'FAILED' THEN 0 ELSE {rounded(COST, 6)} END::DOUBLE AS estimated_cost FROM (
      SELECT * REPLACE (CASE WHEN status = 'FAILED' THEN 0 ELSE input_tokens END AS input_tokens,
          CASE WHEN status = 'FAILED' THEN 0 ELSE output_tokens END AS output_tokens) FROM (
        SELECT *, 'ANALYZING' AS stage, substr(sha256(text), 1, 16) AS user_prompt_hash,
          CASE WHEN document_id % 4 = 1 THEN 'FAILED' ELSE 'SUCCESS' END AS status FROM model_runs))
    UNION ALL SELECT session_id, document_id, 'EARLIER', model, '', input_tokens, output_tokens, 'SUCCESS', 0
      FROM model_runs WHERE session_id % 2 = 0""",
)
def _(t):
    failed = F.col("document_id") % 4 == 1
    runs = t.model_runs
    answers = runs.withColumns(
        {
            "status": F.when(failed, "FAILED").otherwise("SUCCESS"),
            "input_tokens": F.when(failed, 0).otherwise(F.col("input_tokens")).cast("long"),
            "output_tokens": F.when(failed, 0).otherwise(F.col("output_tokens")).cast("long"),
            "latency_ms": F.lit(0), "system_prompt": F.lit("analyze"), "user_prompt": F.col("text"),
        }
    )
    columns = [
        "session_id", "document_id", "stage", "model", "user_prompt_hash", "input_tokens", "output_tokens",
        "status", "estimated_cost",
    ]
    ledger = run_ledger(answers, "ANALYZING", "analyze_document", "1.0").select(*columns)
    earlier = runs.filter("session_id % 2 = 0").withColumns(
        {
            "stage": F.lit("EARLIER"), "user_prompt_hash": F.lit(""), "status": F.lit("SUCCESS"),
            "estimated_cost": F.lit(0.0),
        }
    )
    return ops.append_rows(earlier.select(*columns), ledger)


@query(
    "b12_append_notifications",
    """SELECT event_id, event_type AS title, true AS is_read FROM events WHERE event_type <> 'error'
    UNION ALL SELECT event_id, 'Download failed', false FROM events WHERE event_type = 'error'""",
)
def _(t):
    log = t.events.filter("event_type <> 'error'").select(
        "event_id", F.col("event_type").alias("title"), F.lit(False).alias("is_read")
    )
    fresh = t.events.filter("event_type = 'error'").select(
        "event_id", F.lit("Download failed").alias("title"), F.lit(False).alias("is_read")
    )
    return ops.append_rows(ops.mark_read(log), fresh)


@query(
    "b13_reset_rows",
    """SELECT book_code, CASE WHEN status = 'failed' THEN 'available' ELSE status END AS status,
      downloaded AND status <> 'failed' AS downloaded, CASE WHEN status = 'failed' THEN 0 ELSE file_size END AS file_size,
      CASE WHEN status = 'failed' THEN '' ELSE version_hash END AS version_hash FROM books""",
)
def _(t):
    fresh = ops.reset_rows(
        t.books, F.col("status") == "failed", downloaded=False, file_size=0, version_hash="", status="available"
    )
    return fresh.select("book_code", "status", "downloaded", "file_size", "version_hash")
