"""F: windows over ordered sequences, and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import query, rounded
from queries.steps import chosen, reading
from queries.views import SIGNATURE_LIMIT
from quillwork.operators import documents as docs
from quillwork.operators import sequence as ops
from quillwork.operators.filters import subsample_even
from quillwork.operators.ordered import number_rows


@query(
    "f1_merge_similar_runs",
    "SELECT job_id, index, run, similarity FROM frame_runs",
)
def _(t):
    return t.frame_runs.df.select("job_id", "index", "run", "similarity")


@query(
    "f2_build_question",
    f"""SELECT job_id, frame_start, frame_end, timestamp, text, '' AS options, {rounded("overall", 4)} AS overall_confidence
    FROM auto_questions""",
)
def _(t):
    return t.auto_questions.select(
        "job_id", "frame_start", "frame_end", "timestamp", "text",
        F.array_join("options", "|").alias("options"), "overall_confidence",
    )


# the last kept row is carried through the recursion
KEPT = f"""
    WITH fold AS (
      SELECT label, pos, vec_id, signature AS base, true AS kept FROM signatures WHERE pos = 0
      UNION ALL
      SELECT s.label, s.pos, s.vec_id, CASE WHEN far THEN s.signature ELSE s.base END, far
      FROM (SELECT s.label, s.pos, s.vec_id, s.signature, f.base, list_sum(list_transform(generate_series(1, 64),
            lambda i: abs(s.signature[i]::DOUBLE - f.base[i]::DOUBLE))) / 64 > {SIGNATURE_LIMIT} AS far
          FROM fold f JOIN signatures s ON s.label = f.label AND s.pos = f.pos + 1) s)"""


@query("f3_flag_near_duplicates", f"{KEPT} SELECT label, pos, vec_id, NOT kept AS is_duplicate FROM fold")
def _(t):
    flagged = ops.flag_near_duplicates(t.signatures, limit=SIGNATURE_LIMIT)
    return flagged.select("label", "pos", "vec_id", "is_duplicate")


@query(
    "f4_keep_best_of_duplicates",
    f"""{KEPT} SELECT label, arg_max(vec_id, sharp * 1000000 - pos) AS vec_id FROM (
      SELECT label, pos, vec_id, vec_id * 37 % 101 AS sharp,
        sum(kept::INTEGER) OVER (PARTITION BY label ORDER BY pos) AS g FROM fold) GROUP BY label, g""",
)
def _(t):
    return ops.keep_best_of_duplicates(t.signatures, limit=SIGNATURE_LIMIT).select("label", "vec_id")


@query("f5_keep_on_text_change")
def _(t):
    return ops.keep_on_text_change(t.frames).select("job_id", "index", "ocr_text")


@query(
    "f5_keep_on_exact_change",
    """SELECT job_id, index, event_type FROM frames
    QUALIFY lag(event_type) OVER (PARTITION BY job_id ORDER BY index) IS DISTINCT FROM event_type""",
)
def _(t):
    kept = ops.keep_on_text_change(t.frames, "event_type", equal_only=True)
    return kept.select("job_id", "index", "event_type")


CHANGES = """
    SELECT *, CASE WHEN before IS NOT NULL THEN list_sum(list_transform(generate_series(1, 64),
        lambda i: abs(signature[i]::DOUBLE - before[i]::DOUBLE))) / 64 END AS change
    FROM (SELECT *, lag(signature) OVER (PARTITION BY label ORDER BY pos) AS before FROM signatures)"""


@query(
    "f6_scene_changes",
    f"""SELECT label, pos, vec_id FROM ({CHANGES}) c WHERE change > 0.145 OR (pos = 0 AND NOT EXISTS (
      SELECT 1 FROM ({CHANGES}) d WHERE d.label = c.label AND d.change > 0.145 AND d.timestamp <= 0.05))""",
)
def _(t):
    return ops.scene_changes(ops.change_scores(t.signatures), 0.145).select("label", "pos", "vec_id")


@query(
    "f7_sample_fixed_interval",
    f"""SELECT job_id, min(index) AS index, {rounded("bucket * step", 2)} AS sample_ts FROM (
      SELECT job_id, index, step, floor(timestamp / step) AS bucket FROM (
        SELECT *, greatest(2.0::DOUBLE, max(timestamp) OVER (PARTITION BY job_id) / 200.0::DOUBLE) AS step FROM frames))
    GROUP BY job_id, bucket, step""",
)
def _(t):
    return ops.sample_fixed_interval(t.frames, max_frames=200).select("job_id", "index", "sample_ts")


@query(
    "f7_sample_given_interval",
    f"""SELECT job_id, min(index) AS index, {rounded("bucket * 7200.0::DOUBLE", 2)} AS sample_ts FROM (
      SELECT job_id, index, floor(timestamp / 7200.0::DOUBLE) AS bucket FROM frames) GROUP BY job_id, bucket""",
)
def _(t):
    return ops.sample_fixed_interval(t.frames, 7200.0).select("job_id", "index", "sample_ts")


@query(
    "f8_sample_fps",
    "SELECT job_id, min(index) AS index FROM frames GROUP BY job_id, floor(timestamp * 0.0001::DOUBLE)",
)
def _(t):
    return ops.sample_fps(t.frames, 0.0001).select("job_id", "index")


@query(
    "f9_subsample_even",
    """SELECT job_id, index FROM (SELECT *, count(*) OVER (PARTITION BY job_id) AS n FROM frames) f
    WHERE n <= 40 OR index IN (SELECT floor(i * (f.n / 40.0::DOUBLE))::BIGINT FROM generate_series(0, 39) g(i))""",
)
def _(t):
    return subsample_even(t.frames.df, ["job_id"], [F.col("index")], 40).select("job_id", "index")


@query("f10_quality_filters", chosen("SELECT * FROM signatures", "sharpness * 2", 10))
def _(t):
    rows = t.signatures.columns(sharpness=F.col("sharpness") * 2)
    kept = ops.quality_filters(rows, limit=SIGNATURE_LIMIT, cap=10)
    return kept.select("label", "pos", "vec_id")


@query(
    "f11_heading_parents",
    "SELECT document_id, id, parent_id FROM placed WHERE kind = 'heading'",
)
def _(t):
    return docs.heading_parents(t.elements).select("document_id", "id", "parent_id")


@query(
    "f12_enclosing_section",
    "SELECT document_id, id, parent_id AS section_id FROM placed WHERE kind <> 'heading'",
)
def _(t):
    return docs.enclosing_section(t.elements).select("document_id", "id", "section_id")


@query("f13_materialise_paths", "SELECT document_id, id, depth, path FROM nodes")
def _(t):
    bare = t.nodes.select("document_id", "id", "parent_id")
    return docs.materialise_paths(bare).select("document_id", "id", "depth", "path")


# P: plain text, E: none in these tables; captions are passed over
PARAGRAPHS = r"""
    SELECT *, CASE WHEN k = 'O' THEN order_index WHEN k = 'P' THEN last_value(CASE WHEN starts THEN order_index END IGNORE NULLS)
      OVER (PARTITION BY document_id ORDER BY order_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS block
    FROM (SELECT *, k = 'P' AND (pk IS NULL OR pk IN ('H', 'O') OR regexp_matches(pt, '[.!?:;)"”]$')) AS starts
      FROM (SELECT *,
          last_value(CASE WHEN k <> 'C' THEN k END IGNORE NULLS) OVER w AS pk,
          last_value(CASE WHEN k <> 'C' THEN t END IGNORE NULLS) OVER w AS pt
        FROM (SELECT *, trim(text) AS t, CASE WHEN kind = 'heading' THEN 'H' WHEN kind IN ('figure', 'table') THEN 'O'
            WHEN regexp_matches(trim(text), '(?i)^(fig(ure)?|table|image|photo|plate|chart|diagram|exhibit)\b[\s.:\-]*\d') THEN 'C'
            ELSE 'P' END AS k FROM elements)
        WINDOW w AS (PARTITION BY document_id ORDER BY order_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))"""


@query("f14_merge_paragraphs", f"SELECT document_id, order_index, block FROM ({PARAGRAPHS})")
def _(t):
    return docs.merge_paragraphs(t.elements).df.select("document_id", "order_index", "block")


@query(
    "f15_dehyphenate",
    f"""SELECT document_id, block, replace(replace(string_agg(piece, '␟' ORDER BY order_index), '-␟', ''), '␟', ' ') AS text
    FROM (SELECT *, CASE WHEN order_index % 3 = 0 THEN t || '-' ELSE t END AS piece FROM ({PARAGRAPHS}) WHERE k = 'P')
    GROUP BY ALL""",
)
def _(t):
    rows = docs.merge_paragraphs(t.elements).df.filter("__k = 'P'")
    piece = F.when(F.col("order_index") % 3 == 0, F.concat("__t", F.lit("-"))).otherwise(F.col("__t"))
    ordered = F.array_sort(F.collect_list(F.struct("order_index", piece.alias("p"))))
    joined = docs.join_pieces(F.transform(ordered, lambda x: x["p"]))
    return rows.groupBy("document_id", "block").agg(joined.alias("text"))


@query(
    "f16_attach_captions",
    f"""{reading("SELECT * FROM elements")}
    SELECT document_id, order_index, goes_to, k = 'C' AND goes_to IS NULL AS held, k = 'O' AND takes IS NOT NULL AS captioned, takes
    FROM step WHERE rn > 0""",
)
def _(t):
    rows = docs.attach_captions(t.elements).df
    return rows.select("document_id", "order_index", "goes_to", "held", "captioned", F.col("pending.at").alias("takes"))


@query(
    "f17_number_rows",
    """SELECT document_id, order_index, row_number() OVER (PARTITION BY document_id
      ORDER BY page, y0, order_index) - 1 AS reading_order FROM spans""",
)
def _(t):
    order = [F.col("page"), F.col("y0"), F.col("order_index")]
    rows = number_rows(t.spans, ["document_id"], order, "reading_order").df
    return rows.select("document_id", "order_index", "reading_order")


@query(
    "f18_rank_heading_sizes",
    """SELECT document_id, order_index, CASE WHEN lv IS NOT NULL AND length(text) <= 200 THEN 'heading' ELSE 'paragraph' END AS element_type,
      CASE WHEN length(text) <= 200 THEN lv END AS level
    FROM (SELECT s.*, l.lv FROM (SELECT *, round_even(size, 0)::BIGINT AS sz FROM spans) s LEFT JOIN (
      SELECT document_id, sz, dense_rank() OVER (PARTITION BY document_id ORDER BY sz DESC) AS lv FROM (
        SELECT DISTINCT document_id, round_even(size, 0)::BIGINT AS sz FROM spans WHERE size >= 11.0)) l USING (document_id, sz))""",
)
def _(t):
    body = t.titles.select("document_id", F.lit(10).alias("body_size"))
    ranked = docs.rank_heading_sizes(t.spans.drop("element_type", "level"), body)
    return ranked.select("document_id", "order_index", "element_type", "level")


@query(
    "f19_next_identifiers",
    """SELECT p_partkey, p_brand || '-' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS identifier FROM (
      SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) + coalesce(top, 0) AS n
      FROM (SELECT * FROM part WHERE p_partkey % 2 = 1) LEFT JOIN (SELECT p_brand, max(p_size) AS top FROM part
        WHERE p_partkey % 2 = 0 GROUP BY ALL) USING (p_brand))""",
)
def _(t):
    code = F.concat("p_brand", F.lit("-"), F.lpad(F.col("p_size").cast("string"), 3, "0"))
    existing = t.part.filter("p_partkey % 2 = 0").select(code.alias("identifier"))
    fresh = t.part.filter("p_partkey % 2 = 1").select("p_partkey", F.col("p_brand").alias("prefix"))
    return ops.next_identifiers(existing, fresh, [F.col("p_partkey")]).select("p_partkey", "identifier")


@query(
    "f20_latest_per_key",
    "SELECT session_id, max(id) AS id, arg_max(status, id) AS status FROM jobs GROUP BY ALL",
)
def _(t):
    return ops.latest_per_key(t.jobs, ["session_id"], F.col("id")).select("session_id", "id", "status")


@query(
    "f21_revision_on_change",
    """SELECT job_id, index, (1 + sum((before IS NOT NULL AND before <> event_type)::INTEGER) OVER (
      PARTITION BY job_id ORDER BY index))::BIGINT AS revision FROM (
      SELECT *, lag(event_type) OVER (PARTITION BY job_id ORDER BY index) AS before FROM frames)""",
)
def _(t):
    return ops.revision_on_change(t.frames, "event_type").df.select("job_id", "index", "revision")
