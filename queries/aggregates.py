"""E: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import query, rounded
from quillwork.functions.text import clean_lines
from quillwork.operators import aggregates as ops
from quillwork.operators import documents as docs
from quillwork.operators.sequence import confidence_blend, first_seen_lines
from quillwork.plans.governance import SECTIONS, classify_commits


@query(
    "e1_status_rollup",
    """SELECT count(*) AS total, count(*) FILTER (status IN ('O', 'P')) AS pending,
      count(*) FILTER (status = 'F') AS processed, count(*) FILTER (status = 'X') AS failed FROM jobs""",
)
def _(t):
    return ops.status_rollup(t.jobs, {"pending": ["O", "P"], "processed": ["F"], "failed": ["X"]})


@query(
    "e2_type_rollup",
    """SELECT count(*) AS total, count(*) FILTER (node_type = 'section') AS section,
      count(*) FILTER (node_type = 'paragraph') AS paragraph, count(*) FILTER (node_type = 'table') AS "table",
      count(*) FILTER (node_type = 'figure') AS figure, count(DISTINCT document_id) AS documents FROM nodes""",
)
def _(t):
    return ops.type_rollup(t.nodes, ["section", "paragraph", "table", "figure"], "node_type", "document_id")


@query(
    "e3_child_counts",
    """SELECT document_id, parent_id, count(*) AS children FROM nodes WHERE parent_id IS NOT NULL
    GROUP BY ALL""",
)
def _(t):
    return ops.child_counts(t.nodes)


@query("e4_filtered_total", "SELECT count(*) AS total FROM books WHERE subject = 'PROMO' AND downloaded")
def _(t):
    return ops.filtered_total(t.books, (F.col("subject") == "PROMO") & F.col("downloaded"))


@query("e5_unread_count", "SELECT count(*) FILTER (event_id % 3 <> 0) AS unread FROM events")
def _(t):
    return ops.unread_count(t.events.withColumn("is_read", F.col("event_id") % 3 == 0))


@query("e5_counts_per_document", "SELECT document_id, count(*) AS n FROM elements GROUP BY ALL")
def _(t):
    return ops.counts_per(t.elements.df, "document_id")


@query(
    "e6_facets",
    """SELECT 'class_level' AS facet, class_level AS value FROM books WHERE class_level <> '' GROUP BY ALL
    UNION ALL SELECT 'subject', subject FROM books WHERE subject <> '' GROUP BY ALL
    UNION ALL SELECT 'status', status FROM books WHERE status <> '' GROUP BY ALL""",
)
def _(t):
    return ops.facets(t.books, "class_level", "subject", "status")


@query(
    "e7_analysis_summary",
    """SELECT job_id, f.n AS frames_total, f.u AS frames_unique, f.q AS frames_question,
      coalesce(r.n, 0) AS questions_created
    FROM (SELECT job_id, count(*) AS n, count(*) FILTER (NOT is_duplicate) AS u,
        count(*) FILTER (is_question AND NOT is_duplicate) AS q FROM frames GROUP BY ALL) f
    LEFT JOIN (SELECT job_id, count(*) AS n FROM auto_questions GROUP BY ALL) r USING (job_id)""",
)
def _(t):
    return ops.analysis_summary(t.frames.df, t.auto_questions, ["job_id"])


@query(
    "e8_group_counts",
    "SELECT document_id, element_type, count(*) AS n FROM elements GROUP BY ALL",
)
def _(t):
    return ops.counts_per(t.elements.df, "document_id", "element_type")


@query(
    "e8_group_lists",
    """SELECT document_id, page, i // 4 AS part,
      string_agg(order_index::VARCHAR, ',' ORDER BY order_index) AS items
    FROM (SELECT *, row_number() OVER (PARTITION BY document_id, page ORDER BY order_index) - 1 AS i
      FROM elements) GROUP BY ALL""",
)
def _(t):
    listed = ops.group_lists(t.elements.df, ["document_id", "page"], "order_index", "order_index", part_rows=4)
    items = F.array_join(F.col("values").cast("array<string>"), ",").alias("items")
    return listed.select("document_id", "page", "part", items)


@query(
    "e9_confidence_blend",
    f"""SELECT job_id, run, {rounded("o", 4)} AS ocr_confidence, {rounded("f", 4)} AS frame_confidence,
      {rounded("g", 4)} AS merge_confidence, {rounded("overall", 4)} AS overall_confidence
    FROM auto_questions""",
)
def _(t):
    return confidence_blend(t.frame_runs.df, ["job_id", "run"])


@query(
    "e10_weighted_mode",
    """SELECT document_id, coalesce(body, 12) AS body_size FROM (SELECT DISTINCT document_id FROM spans)
    LEFT JOIN (SELECT document_id, arg_max(s, w * 1000000 - seen) AS body FROM (
      SELECT document_id, round_even(size, 0)::BIGINT AS s, sum(length(trim(text)))::BIGINT AS w,
        min(order_index) AS seen FROM spans WHERE trim(text) <> '' GROUP BY ALL) GROUP BY ALL)
    USING (document_id)""",
)
def _(t):
    return docs.weighted_mode(t.spans)


@query(
    "e11_span_minmax",
    """SELECT s.document_id, s.id AS section_id, coalesce(b.lo, s.page) AS page_start,
      coalesce(b.hi, s.page) AS page_end FROM (SELECT * FROM nodes WHERE node_type IN ('section', 'root')) s
    LEFT JOIN (SELECT document_id, parent_id, min(page) AS lo, max(page) AS hi FROM nodes
      WHERE node_type NOT IN ('section', 'root') AND page <> 0 GROUP BY ALL) b
    ON b.document_id = s.document_id AND b.parent_id = s.id""",
)
def _(t):
    nodes = t.nodes
    sections = nodes.filter("node_type in ('section', 'root')").select(
        "document_id", F.col("id").alias("section_id"), "page"
    )
    blocks = nodes.filter("node_type not in ('section', 'root')").select(
        "document_id", F.col("parent_id").alias("section_id"), "page"
    )
    return docs.span_minmax(sections, blocks).drop("page")


NOISE_SQL = """
    SELECT e.document_id, e.order_index, e.page, e.page_count, e.element_type, e.level, e.text, e.id,
      e.dim_a, e.dim_b, e.num OR coalesce(h.document_id IS NOT NULL, false) AS is_noise
    FROM (SELECT *, kind IN ('paragraph', 'heading') AND trim(text) <> '' AND length(trim(text)) <= 8
          AND regexp_matches(trim(text), '(?i)^\\s*(page\\s*)?[ivxlcdm\\d]{1,6}\\s*$') AS num,
        CASE WHEN kind IN ('paragraph', 'heading') AND trim(text) <> '' AND length(trim(text)) <= 80
          THEN lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) END AS key FROM elements) e
    LEFT JOIN (SELECT document_id, key FROM (
        SELECT document_id, page_count, page, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS key
        FROM elements WHERE kind IN ('paragraph', 'heading') AND trim(text) <> ''
          AND length(trim(text)) <= 80 AND NOT (length(trim(text)) <= 8
            AND regexp_matches(trim(text), '(?i)^\\s*(page\\s*)?[ivxlcdm\\d]{1,6}\\s*$')))
      WHERE page_count >= 3 GROUP BY document_id, key, page_count
      HAVING count(DISTINCT page) >= greatest(3, ceil(0.4 * page_count))) h
    ON h.document_id = e.document_id AND h.key = e.key AND NOT e.num"""


@query(
    "e12_running_header_detection",
    f"SELECT document_id, order_index, text FROM ({NOISE_SQL}) WHERE is_noise",
)
def _(t):
    marked = docs.running_header_detection(t.elements.df)
    return marked.filter("is_noise").select("document_id", "order_index", "text")


@query(
    "e13_duplicate_groups",
    """SELECT sha256(text) AS digest, doc_id, min(doc_id) OVER w AS "first", count(*) OVER w AS copies
    FROM documents WINDOW w AS (PARTITION BY sha256(text)) QUALIFY copies > 1""",
)
def _(t):
    return ops.duplicate_groups(t.documents, "doc_id", F.col("text"))


@query(
    "e14_first_seen_lines",
    """SELECT doc_id, string_agg(line, chr(10) ORDER BY seen) AS text, count(*) AS n FROM (
      SELECT doc_id, arg_min(trim(line), line_no) AS line, min(line_no) AS seen FROM lines
      WHERE trim(line) <> '' GROUP BY doc_id, lower(trim(line))) GROUP BY ALL""",
)
def _(t):
    seen = first_seen_lines(t.documents, ["doc_id"], [], clean_lines(F.col("text")))
    return seen.select(
        "doc_id", F.array_join("lines", "\n").alias("text"), F.size("lines").cast("long").alias("n")
    )


@query(
    "e15_line_confidence",
    f"""SELECT job_id, index // 10 AS scene, string_agg(rtrim(ocr_text), chr(10) ORDER BY index) AS text,
      {rounded("sum(ocr_confidence::DECIMAL(20, 12))::DOUBLE / count(*)", 4)} AS confidence FROM frames WHERE ocr_confidence >= 0.5 GROUP BY ALL""",
)
def _(t):
    scored = t.frames.df.select(
        "job_id", F.floor(F.col("index") / 10).alias("scene"), F.col("index").alias("pos"),
        F.col("ocr_text").alias("line"), F.col("ocr_confidence").alias("score"),
    )
    return ops.line_confidence(scored, ["job_id", "scene"], minimum=0.5)


@query(
    "e16_overall_completion",
    """SELECT 'overall' AS module, round_even(avg(p_size * 2), 0)::BIGINT AS completion FROM part
    UNION ALL SELECT p_partkey::VARCHAR, p_size * 2 FROM part WHERE p_size * 2 < 100""",
)
def _(t):
    modules = t.part.select(
        F.col("p_partkey").cast("string").alias("module"), (F.col("p_size") * 2).cast("long").alias("completion")
    )
    overall, pending = ops.overall_completion(modules)
    return overall.select(F.lit("overall").alias("module"), F.col("overall").alias("completion")).unionByName(pending)


COMMITS_SQL = """
    SELECT seq, commit_hash,
      CASE seq % 6 WHEN 0 THEN 'Added' WHEN 1 THEN 'Fixed' WHEN 2 THEN 'Performance' ELSE 'Changed' END AS section,
      CASE seq % 6 WHEN 0 THEN 'ui' WHEN 2 THEN 'core' WHEN 4 THEN 'api' ELSE '' END AS scope,
      CASE seq % 6 WHEN 0 THEN 'add view' WHEN 1 THEN 'repair join' WHEN 2 THEN 'speed up scan'
        WHEN 3 THEN 'explain' WHEN 4 THEN 'drop field' ELSE 'tidy the workspace' END AS summary FROM commits"""


@query(
    "e17_changelog_sections",
    f"""SELECT seq, commit_hash, section, scope, summary,
      CASE section WHEN 'Added' THEN 1 WHEN 'Changed' THEN 2 ELSE 3 END::BIGINT AS section_rank
    FROM ({COMMITS_SQL}) WHERE section <> 'Performance'""",
)
def _(t):
    listed = [s for s in SECTIONS if s != "Performance"]
    return ops.changelog_sections(classify_commits(t.commits), listed)


@query(
    "e18_batch_outcome",
    """SELECT user_id, count(o_orderkey) AS total, count(*) FILTER (o_orderstatus = 'F') AS failures,
      CASE WHEN count(*) FILTER (o_orderstatus = 'F') < count(o_orderkey) THEN 'completed' ELSE 'failed' END AS status,
      CASE WHEN count(*) FILTER (o_orderstatus = 'F') = 0 THEN 'Completed'
        ELSE 'Completed with ' || (count(*) FILTER (o_orderstatus = 'F'))::VARCHAR || ' failures' END AS stage
    FROM users LEFT JOIN orders ON o_custkey = user_id GROUP BY ALL""",
)
def _(t):
    items = t.jobs.select(F.col("session_id").alias("user_id"), F.col("id").alias("item_id"), "status")
    batches = t.users.select("user_id").join(items, "user_id", "left")
    return ops.batch_outcome(batches, ["user_id"], F.col("status") == "F", empty_ok=False)


@query("e19_sum_media_bytes", "SELECT sum(octet_length(encode(text)))::BIGINT AS media_bytes FROM documents")
def _(t):
    return ops.sum_media_bytes(t.documents, F.col("text"))


@query(
    "e20_cross_source_support",
    """SELECT session_id, category, value AS claim, count(DISTINCT source_label) AS sources,
      sum(confidence::DECIMAL(20, 12))::DOUBLE / count(*) AS confidence FROM facts GROUP BY ALL""",
)
def _(t):
    return ops.cross_source_support(t.facts)


@query(
    "e20_claim_sources",
    "SELECT DISTINCT session_id, category, value AS claim, source_label FROM facts",
)
def _(t):
    return ops.claim_sources(t.facts)


@query(
    "e20_conflicting_claims",
    """SELECT session_id, category, subcategory, claim, claims FROM (
      SELECT *, count(*) OVER (PARTITION BY session_id, category, subcategory) AS claims FROM (
        SELECT DISTINCT session_id, category, subcategory, value AS claim FROM facts)) WHERE claims > 1""",
)
def _(t):
    return ops.conflicting_claims(t.facts)


@query(
    "e21_text_layer_flag",
    """SELECT document_id, sum(length(trim(text)))::BIGINT AS chars, max(page) AS page_count,
      sum(length(trim(text))) >= 20 * greatest(max(page), 1) AS has_text_layer,
      sum(length(trim(text))) < 20 * greatest(max(page), 1) AS needs_ocr FROM elements GROUP BY ALL""",
)
def _(t):
    return docs.text_layer_flag(t.elements.df)


@query(
    "e22_large_files",
    """SELECT doc_id, format('{:.1f} MB', octet_length(encode(text)) * 1024 / (1024.0 * 1024.0)) AS detail
    FROM documents WHERE octet_length(encode(text)) * 1024 > 5 * 1024 * 1024""",
)
def _(t):
    sizes = t.documents.select("doc_id", (F.octet_length("text").cast("long") * 1024).alias("size"))
    return ops.large_files(sizes, F.col("size")).select("doc_id", "detail")
