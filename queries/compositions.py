"""L: the compositions a user calls."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from queries.aggregates import COMMITS_SQL, NOISE_SQL
from queries.base import query, rounded
from queries.joins import LOCAL
from queries.sequences import CHANGES, KEPT
from queries.steps import blocks, chosen
from queries.views import SIGNATURE_LIMIT
from quillwork.operators.aggregates import counts_per
from quillwork.operators.documents import heading_tree, running_header_detection
from quillwork.plans.catalog import refresh_catalog, sync_catalog
from quillwork.plans.documents import assemble_document, layout_to_elements, map_document
from quillwork.plans.frames import SelectOptions, analyze_frames, analyze_job, classify_frames, score_frames, select_frames
from quillwork.plans.governance import commit_summary, corpus_health, doc_index
from quillwork.plans.research import consensus_prompt, research_session


@query(
    "l1_analyze_frames",
    f"""SELECT job_id, frame_start, text, source, {rounded("overall", 4)} AS overall_confidence FROM (
      SELECT job_id, frame_start, text, 'auto' AS source, overall FROM auto_questions
      UNION ALL SELECT job_id, 0, ocr_text, 'manual', 1.0::DOUBLE FROM frames WHERE index = 0)""",
)
def _(t):
    fresh, _ = analyze_frames(t.frames, t.questions.drop("id"))
    return fresh.select("job_id", "frame_start", "text", "source", "overall_confidence")


@query(
    "l1_score_frames",
    f"""{KEPT} SELECT label, pos, {rounded("s", 4)} AS question_score, {rounded("s", 4)} >= 0.55 AS is_question,
      NOT kept AS is_duplicate FROM (
      SELECT *, least(greatest(0.35::DOUBLE * least((pos % 80) / 60.0::DOUBLE, 1.0::DOUBLE)
          + 0.45::DOUBLE * least(greatest(((vec_id % 100) / 100.0::DOUBLE - 0.30::DOUBLE) / 0.50::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE)
          + 0.20::DOUBLE * (1.0::DOUBLE - least((vec_id % 40) / 100.0::DOUBLE * 2.2::DOUBLE, 1.0::DOUBLE)), 0.0::DOUBLE),
          1.0::DOUBLE) AS s FROM fold)""",
)
def _(t):
    """The first steps of the analysis, on features made up from the keys."""
    rows = t.signatures.columns(
        text_boxes=F.col("pos") % 80, uniformity=F.col("vec_id") % 100 / 100.0, saturation=F.col("vec_id") % 40 / 100.0
    )
    scored = score_frames(rows, SIGNATURE_LIMIT).df
    return scored.select("label", "pos", "question_score", "is_question", "is_duplicate")


SCORED = """SELECT *, least(greatest(0.35::DOUBLE * least((pos % 80) / 60.0::DOUBLE, 1.0::DOUBLE)
      + 0.45::DOUBLE * least(greatest(((vec_id % 100) / 100.0::DOUBLE - 0.30::DOUBLE) / 0.50::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE)
      + 0.20::DOUBLE * (1.0::DOUBLE - least((vec_id % 40) / 100.0::DOUBLE * 2.2::DOUBLE, 1.0::DOUBLE)), 0.0::DOUBLE), 1.0::DOUBLE) AS s
    FROM fold"""


@query(
    "l1_analyze_job",
    f"""{KEPT}, scored AS (SELECT *, {rounded("s", 4)} >= 0.55 AS asks, pos // 3 % 26 AS letter FROM ({SCORED})),
    picked AS (SELECT *, coalesce(letter <> lag(letter) OVER (PARTITION BY label ORDER BY pos), true)::INTEGER AS fresh
      FROM scored WHERE asks AND kept AND letter % 13 <> 5)
    SELECT label, count(*) AS frames_total, count(*) FILTER (kept) AS frames_unique,
      count(*) FILTER (kept AND asks) AS frames_question,
      coalesce((SELECT sum(fresh) FROM picked p WHERE p.label = scored.label), 0)::BIGINT AS questions_created
    FROM scored GROUP BY label""",
)
def _(t):
    """From image features to questions; the reader sees the letter of a slide, and nothing on some."""
    rows = t.signatures.columns(
        text_boxes=F.col("pos") % 80, uniformity=F.col("vec_id") % 100 / 100.0, saturation=F.col("vec_id") % 40 / 100.0,
        ocr_text=F.lit(""), ocr_confidence=F.lit(0.0), ocr_done=F.lit(False),
    )

    def read(df):
        letter = F.floor(F.col("pos") / 3) % 26
        seen = F.when(letter % 13 != 5, F.repeat(F.char(97 + letter), F.lit(10))).otherwise("  ")
        return df.withColumns({"ocr_text": seen, "ocr_confidence": F.lit(0.5)})

    _, summary, _ = analyze_job(rows, read=read, limit=SIGNATURE_LIMIT)
    return summary.select("label", *[F.col(c).cast("long").alias(c) for c in ("frames_total", "frames_unique", "frames_question", "questions_created")])


@query(
    "l2_classify_frames",
    """SELECT job_id, count(*) AS frames, count(*) FILTER (trim(ocr_text) <> '') AS classified
    FROM frames WHERE NOT is_duplicate GROUP BY ALL""",
)
def _(t):
    return classify_frames(t.frames.df)[1]


def _select(t, strategy: str):
    """Slides change their text every third frame, to letters with nothing in common."""
    letter = F.char(97 + F.floor(F.col("pos") / 3) % 26)
    rows = t.signatures.columns(ocr_text=F.repeat(letter, F.lit(10)), sharpness=F.col("sharpness") * 3)
    options = SelectOptions(
        interval=2.0, scene_threshold=0.14, sampling_fps=1.0, max_frames=12, duplicate_limit=SIGNATURE_LIMIT
    )
    return select_frames(rows, strategy, options).select("label", "pos", "vec_id")


# every second frame is sampled, and then scored against the sampled one before
SAMPLED = "SELECT *, pos // 3 % 26 AS letter FROM ({}) WHERE pos % 2 = 0".format(
    CHANGES.replace("FROM signatures)", "FROM signatures WHERE pos % 2 = 0)")
)
SCENES = f"SELECT * FROM ({SAMPLED}) WHERE change > 0.14 OR pos = 0"
CHANGED = "SELECT * FROM ({}) QUALIFY lag(letter) OVER (PARTITION BY label ORDER BY pos) IS DISTINCT FROM letter"


@query("l3_select_frames_hybrid", chosen(CHANGED.format(SCENES), "sharpness * 3", 12))
def _(t):
    return _select(t, "hybrid")


@query("l3_select_frames_scene", chosen(SCENES, "sharpness * 3", 12))
def _(t):
    return _select(t, "scene_detection")


@query("l3_select_frames_text", chosen(CHANGED.format(SAMPLED), "sharpness * 3", 12))
def _(t):
    return _select(t, "ocr_text_change")


@query("l3_select_frames_fixed", chosen("SELECT * FROM signatures WHERE pos % 4 = 0", "sharpness * 3", 12))
def _(t):
    return _select(t, "fixed_interval")


@query(
    "l4_layout_to_elements",
    """SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY page, y0, turn, oi) - 1 AS order_index,
      page, element_type, level, text FROM (
      SELECT document_id, page, y0, 0 AS turn, order_index AS oi, 'table' AS element_type, NULL::BIGINT AS level, '' AS text
        FROM spans WHERE kind = 'table'
      UNION ALL SELECT document_id, page, y0, 2, order_index, 'figure', NULL, '' FROM spans WHERE kind = 'figure'
      UNION ALL SELECT document_id, page, y0, 1, order_index,
        CASE WHEN lv IS NOT NULL AND length(text) <= 200 THEN 'heading' ELSE 'paragraph' END,
        CASE WHEN length(text) <= 200 THEN lv END, text
      FROM (SELECT p.*, l.lv FROM (SELECT *, round_even(size, 0)::BIGINT AS sz FROM spans WHERE kind NOT IN ('table', 'figure')) p
        LEFT JOIN (SELECT document_id, sz, dense_rank() OVER (PARTITION BY document_id ORDER BY sz DESC) AS lv FROM (
          SELECT DISTINCT document_id, round_even(size, 0)::BIGINT AS sz FROM open_spans WHERE size >= body + 1.0)) l
          USING (document_id, sz)
        WHERE NOT EXISTS (SELECT 1 FROM spans b WHERE b.kind = 'table' AND b.document_id = p.document_id
          AND b.page = p.page AND (p.y0 + p.y1) / 2 BETWEEN b.y0 AND b.y1)))""",
)
def _(t):
    spans = t.spans
    kind = F.col("element_type")
    elements, _ = layout_to_elements(
        spans.filter(~kind.isin("table", "figure")), spans.filter(kind == "table"), spans.filter(kind == "figure")
    )
    return elements.df.select("document_id", "order_index", "page", "element_type", "level", "text")


@query(
    "l5_map_document",
    "SELECT document_id, id, parent_id, node_type, title, content, depth, page, path FROM nodes",
)
def _(t):
    return t.nodes.drop("level")


@query(
    "l5_map_document_by_bookmarks",
    """SELECT document_id, node_type, count(*) AS n, max(depth) AS depth, sum(page)::BIGINT AS pages FROM (
      SELECT document_id, 'root' AS node_type, 0 AS depth, 0 AS page FROM titles
      UNION ALL SELECT document_id, 'section', 1, page FROM bookmarks
      UNION ALL SELECT document_id, kind, 1 + (EXISTS (SELECT 1 FROM bookmarks b
          WHERE b.document_id = e.document_id AND b.page <= e.page))::INTEGER, page
        FROM elements e WHERE kind <> 'heading')
    GROUP BY document_id, node_type""",
)
def _(t):
    flat = t.elements.filter(F.col("element_type") != "heading")
    marks = t.bookmarks.withColumn("order_index", F.floor(F.col("order_index") / 10).cast("long")).drop("id")
    nodes = map_document(flat, t.titles, marks)
    return nodes.groupBy("document_id", "node_type").agg(
        F.count(F.lit(1)).alias("n"), F.max("depth").alias("depth"), F.sum("page").alias("pages")
    )


CLEAN = f"SELECT * FROM ({NOISE_SQL}) WHERE NOT is_noise"


@query(
    "l6_assemble_blocks",
    f"""{blocks(CLEAN)}
    SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY place, turn) - 1 AS order_index, block_type,
      section_id, page, text, caption, source_ids FROM blocks""",
)
def _(t):
    _, blocks, _ = assemble_document(t.elements)
    ids = F.array_join(F.col("source_element_ids").cast("array<string>"), ",").alias("source_ids")
    return blocks.select("document_id", "order_index", "block_type", "section_id", "page", "text", "caption", ids)


@query(
    "l6_assemble_counts",
    f"""SELECT document_id, count(*) FILTER (is_noise) AS dropped_noise,
      count(*) FILTER (NOT is_noise AND element_type = 'heading') + 1 AS sections FROM ({NOISE_SQL}) GROUP BY ALL""",
)
def _(t):
    _, _, counts = assemble_document(t.elements)
    return counts.select("document_id", "dropped_noise", "sections")


@query(
    "l6_section_pages",
    f"""{blocks(CLEAN)},
    heads AS (
      SELECT document_id, id AS section_id, coalesce(CASE level WHEN 1 THEN 0 WHEN 2 THEN h1 ELSE greatest(h1, h2) END, 0) AS parent_id,
        page FROM (SELECT *, last_value(CASE WHEN level = 1 THEN id END IGNORE NULLS) OVER w AS h1,
          last_value(CASE WHEN level = 2 THEN id END IGNORE NULLS) OVER w AS h2 FROM seq WHERE k = 'H'
        WINDOW w AS (PARTITION BY document_id ORDER BY order_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      UNION ALL SELECT DISTINCT document_id, 0::BIGINT, NULL, 0 FROM elements)
    SELECT document_id, section_id, parent_id, coalesce(lo, page) AS page_start, coalesce(hi, page) AS page_end
    FROM heads LEFT JOIN (SELECT document_id, section_id, min(page) AS lo, max(page) AS hi FROM blocks WHERE page <> 0
      GROUP BY ALL) b USING (document_id, section_id)""",
)
def _(t):
    sections, _, _ = assemble_document(t.elements)
    return sections.select("document_id", "section_id", "parent_id", "page_start", "page_end")


def _reader():
    """A stand-in model that reads facts off the prompt and fails on some sources."""

    def answer(row: dict) -> tuple[str, int, int]:
        prompt = row["user_prompt"]
        if prompt.startswith("Research topic"):
            return json.dumps({"executive_summary": f"{prompt.count('--- Source')} sources"}), len(prompt), 1
        body = prompt.split("Extracted text:\n", 1)[1].split("\n", 1)[-1]
        if len(body) % 5 == 0:
            raise ValueError("refused")
        facts = [{"category": "length", "value": str(len(body) % 7), "confidence": 0.5}, "stray"]
        return "```json\n" + json.dumps({"facts": facts, "entities": []}) + "\n```", len(body), 2

    return answer


def _research(t):
    sources = t.conversations.select(
        (F.col("conv_id") % 20).alias("session_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("document_id"),
        F.col("role").alias("title"), F.lit("turn").alias("document_type"), F.col("text").alias("transcript"),
        F.lit("").alias("subtitles"), F.lit("").alias("screen"),
    )
    return research_session(sources, _reader, "gpt-4o", backoff=0.0)


FACTS_OF_TURNS = """SELECT conv_id % 20 AS session_id, conv_id * 100 + turn AS document_id, role,
      length(text) AS n FROM conversations"""


@query(
    "l7_research_session",
    f"""SELECT session_id, 'length' AS category, (n % 7)::VARCHAR AS claim,
      count(DISTINCT 'Source ' || document_id::VARCHAR || ': ' || role) AS sources, 0.5::DOUBLE AS confidence
    FROM ({FACTS_OF_TURNS}) WHERE n % 5 <> 0 GROUP BY session_id, n % 7""",
)
def _(t):
    return _research(t).support


@query(
    "l7_research_status",
    f"""SELECT session_id, count(*) AS calls, count(*) FILTER (n % 5 <> 0) AS succeeded,
      CASE WHEN count(*) FILTER (n % 5 <> 0) > 0 THEN 'COMPLETED' ELSE 'FAILED' END AS session_status
    FROM ({FACTS_OF_TURNS}) GROUP BY ALL""",
)
def _(t):
    return _research(t).status


@query(
    "l7_consensus_prompt",
    """SELECT session_id, part, 'Research topic: reading' || chr(10) || chr(10)
        || string_agg(block, chr(10) || chr(10) ORDER BY document_id) AS user_prompt FROM (
      SELECT *, (sum(length(block) + 2) OVER (PARTITION BY session_id ORDER BY document_id) - length(block) - 2)::BIGINT
        // 24000 AS part FROM (
        SELECT session_id, document_id, '--- ' || any_value(source_label) || ' ---' || chr(10) || 'Summary: by '
          || any_value(source_label) || chr(10) || 'Key facts:' || chr(10)
          || string_agg('- [' || category || '] ' || value, chr(10) ORDER BY pos) AS block
        FROM facts GROUP BY session_id, document_id))
    GROUP BY session_id, part""",
)
def _(t):
    summary = F.concat(F.lit("by "), "source_label").alias("summary")
    summaries = t.facts.select("session_id", "document_id", "source_label", summary).distinct()
    return consensus_prompt(t.facts, summaries, F.lit("reading")).select("session_id", "part", "user_prompt")


@query(
    "l8_sync_catalog",
    """SELECT book_code, coalesce(s.title, b.title) AS title,
      CASE WHEN b.book_code IS NULL THEN 'available' ELSE b.status END AS status,
      coalesce(b.downloaded, false) AS downloaded,
      CASE WHEN s.book_code IS NOT NULL THEN 'today' ELSE 'before' END AS last_checked
    FROM shelf b FULL JOIN scanned s USING (book_code)""",
)
def _(t):
    shelf = t.shelf.withColumn("last_checked", F.lit("before"))
    table, _ = sync_catalog(shelf, t.scanned, F.lit("today"), ("class_level", "subject", "title"))
    return table.select("book_code", "title", "status", "downloaded", "last_checked")


@query(
    "l8_refresh_catalog",
    """SELECT b.book_code, CASE WHEN b.downloaded AND s.version_hash <> b.version_hash
      THEN 'update_available' ELSE b.status END AS status FROM shelf b LEFT JOIN scanned s USING (book_code)""",
)
def _(t):
    return refresh_catalog(t.shelf, t.scanned).select("book_code", "status")


@query(
    "l9_corpus_health",
    f"""WITH files AS (SELECT doc_id, 'site/p' || doc_id::VARCHAR || '.html' AS path, n_chars * 1024 AS size, text FROM documents)
    SELECT 'large' AS "check", path AS target, format('{{:.1f}} MB', size / (1024.0 * 1024.0)) AS detail, 'warning' AS severity
      FROM files WHERE size > 5 * 1024 * 1024
    UNION ALL SELECT 'duplicate', f, 'identical to: ' || path, 'warning' FROM (
      SELECT path, min(path) OVER (PARTITION BY text) AS f FROM files) WHERE path <> f
    UNION ALL SELECT 'broken-link', path, 'missing target: ' || link, 'error' FROM links WHERE {LOCAL}
    UNION ALL SELECT 'missing-doc', n, 'no documentation found for module', 'warning' FROM (
      SELECT DISTINCT p_name AS n FROM part) WHERE NOT EXISTS (SELECT 1 FROM files WHERE contains(path, lower(n)))
    UNION ALL SELECT 'orphan', path, 'not linked from any document', 'info' FROM files""",
)
def _(t):
    path = F.concat(F.lit("site/p"), F.col("doc_id").cast("string"), F.lit(".html"))
    files = t.documents.select(path.alias("path"), (F.col("n_chars") * 1024).alias("size"), "text")
    modules = t.part.select(F.col("p_name").alias("name")).distinct()
    local = t.links.filter((F.col("link") != "") & ~F.col("link").rlike("^(http://|https://|mailto:)"))
    return corpus_health(files, local.select("path", "link"), modules)


@query(
    "l10_commit_summary",
    f"""SELECT seq, section, '- ' || CASE WHEN scope <> '' THEN '**' || scope || '**: ' ELSE '' END || summary
      || ' (' || commit_hash || ')' AS line FROM ({COMMITS_SQL})""",
)
def _(t):
    return commit_summary(t.commits).select("seq", "section", "line")


@query(
    "l11_doc_index",
    """SELECT CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'Platform' END AS module, 'Doc ' || source AS document,
      CASE WHEN doc_id % 2 = 0 THEN lang || '/' ELSE '' END || doc_id::VARCHAR || '.md' AS path, '' AS version,
      CASE WHEN doc_id % 2 = 0 THEN 'Draft' ELSE 'Final' END AS status, '' AS owner, '' AS updated_date FROM documents""",
)
def _(t):
    even = F.col("doc_id") % 2 == 0
    relative = F.concat(F.when(even, F.concat("lang", F.lit("/"))).otherwise(""), F.col("doc_id").cast("string"), F.lit(".md"))
    head = F.when(even, "").otherwise("---\nstatus: Final\n---\n")
    text = F.concat(head, F.lit("# Doc "), "source", F.lit("\n"), "text")
    docs = t.documents.select(relative.alias("path"), relative.alias("relative"), text.alias("text"))
    return doc_index(docs)


@query(
    "l6_section_block_counts",
    f"""SELECT document_id, element_type, count(*) AS n FROM ({NOISE_SQL}) WHERE NOT is_noise GROUP BY ALL""",
)
def section_block_counts(t):
    """Sections and blocks per document once running headers are removed."""
    marked = t.elements.with_df(running_header_detection(t.elements.df)).filter(~F.col("is_noise"))
    return counts_per(heading_tree(marked).df, "document_id", "element_type")
