"""C: projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import query
from quillwork.functions.json import lenient_json, number_field, object_items, text_field
from quillwork.operators import filters as ops


@query(
    "c1_filter_optional_eq",
    "SELECT book_code, subject, title, status FROM books WHERE subject = 'ECONOMY' AND status = 'queued'",
)
def _(t):
    picked = ops.filter_optional_eq(t.books, subject="ECONOMY", status="queued", class_level="all", title=None)
    return picked.select("book_code", "subject", "title", "status")


@query(
    "c2_search_contains",
    "SELECT doc_id, lang FROM documents WHERE lower(text) LIKE '%th_re%' OR lower(source) LIKE '%th_re%'",
)
def _(t):
    return ops.search_contains(t.documents, ["text", "source"], "Th_Re").select("doc_id", "lang")


@query(
    "c2_search_contains_literal",
    "SELECT doc_id FROM documents WHERE contains(lower(text), '100%') OR contains(lower(text), 'then ')",
)
def _(t):
    docs = t.documents
    found = [ops.search_contains(docs, ["text"], q, literal=True).select("doc_id") for q in ("100%", "THEN ")]
    return found[0].union(found[1]).distinct()


@query(
    "c3_filter_sessions",
    """SELECT id, status, source_type, created_at FROM jobs
    WHERE status = 'F' AND lower(input_value) LIKE '%urgent%' AND created_at >= TIMESTAMP '1995-01-01'
      AND created_at < TIMESTAMP '1997-01-01' AND provider = 'openai'""",
)
def _(t):
    found = ops.filter_sessions(
        t.jobs, status="F", topic="Urgent", date_from="1995-01-01", date_to="1996-12-31", provider="openai"
    )
    return found.select("id", "status", "source_type", "created_at")


@query(
    "c3_filter_sessions_strict",
    "SELECT id, created_at FROM jobs WHERE created_at <= TIMESTAMP '1996-12-31' AND source_type = '5-LOW'",
)
def _(t):
    found = ops.filter_sessions(t.jobs, date_to="1996-12-31", source_type="5-LOW", strict_end=True)
    return found.select("id", "created_at")


@query("c4_filter_in", "SELECT id, status FROM jobs WHERE status IN ('F', 'P')")
def _(t):
    return ops.filter_in(t.jobs, "status", ["F", "P"]).select("id", "status")


@query(
    "c4_filter_in_table",
    "SELECT id, status FROM jobs WHERE session_id IN (SELECT user_id FROM users WHERE is_superuser)",
)
def _(t):
    listed = t.users.filter("is_superuser").select("user_id")
    return ops.filter_in(t.jobs, "session_id", listed).select("id", "status")


@query(
    "c5_children_of",
    "SELECT document_id, id, parent_id FROM nodes WHERE parent_id IS NULL OR parent_id = 1",
)
def _(t):
    parts = [ops.children_of(t.nodes, p) for p in (None, 1)]
    return parts[0].unionByName(parts[1]).select("document_id", "id", "parent_id")


@query(
    "c6_visible_frames",
    """SELECT job_id, index, ocr_text FROM frames
    WHERE is_question AND NOT is_duplicate AND trim(ocr_text) <> ''""",
)
def _(t):
    shown = ops.visible_frames(t.frames.df, question_only=True, hide_duplicates=True, with_text=True)
    return shown.select("job_id", "index", "ocr_text")


@query(
    "c7_slice_elements",
    """SELECT document_id, order_index, text FROM elements
    WHERE page = 2 AND element_type = 'heading'""",
)
def _(t):
    return ops.slice_elements(t.elements.df, page=2, kind="heading").select("document_id", "order_index", "text")


@query(
    "c8_missing_or_present",
    "SELECT book_code, downloaded AS present FROM books",
)
def _(t):
    books = t.books
    present = ops.missing_or_present(books, True).select("book_code", F.lit(True).alias("present"))
    missing = ops.missing_or_present(books, False).select("book_code", F.lit(False).alias("present"))
    return present.unionByName(missing)


@query(
    "c9_status_gate",
    "SELECT id, status, coalesce(status = 'F', false) AS passes FROM jobs",
)
def _(t):
    ready, rest = ops.status_gate(t.jobs, "F")
    rows = [df.select("id", "status", F.lit(flag).alias("passes")) for df, flag in ((ready, True), (rest, False))]
    return rows[0].unionByName(rows[1])


@query(
    "c10_coerce_record",
    """SELECT event_id, event_type AS name, '' AS note, 0.0::DOUBLE AS confidence FROM events
    UNION ALL
    SELECT event_id, '', 'k ' || (json_extract_string(props, '$.k')), value FROM events""",
)
def _(t):
    """Answers with a bare string among the objects, missing names and null confidences."""
    k = F.get_json_object("props", "$.k")
    items = F.concat(
        F.lit('Here it is: {"facts": [{"name": "'), "event_type", F.lit('", "confidence": null}, "stray", '),
        F.lit('{"note": "k '), k, F.lit('", "confidence": '), F.col("value").cast("string"), F.lit("}]} done"),
    )
    parsed = lenient_json(items)
    rows = t.events.select("event_id", F.explode(object_items(parsed, "$.facts")).alias("o"))
    o = F.col("o")
    return rows.select(
        "event_id", text_field(o, "name").alias("name"), text_field(o, "note").alias("note"),
        number_field(o, "confidence").alias("confidence"),
    )


@query(
    "c12_uniqueness_check",
    """SELECT user_id, name, user_id % 2 = 0 AS accepted FROM users""",
)
def _(t):
    existing = t.users.filter("user_id % 2 = 1")
    accepted, rejected = ops.uniqueness_check(t.users, existing, "name")
    good = accepted.select("user_id", "name", F.lit(True).alias("accepted"))
    return good.unionByName(rejected.select("user_id", "name", F.lit(False).alias("accepted")))
