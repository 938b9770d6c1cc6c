"""H: set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import query
from quillwork.functions.text import is_subset, line_jaccard, line_set
from quillwork.operators import sets as ops
from quillwork.operators.ordered import lag


@query(
    "h1_line_jaccard",
    """SELECT job_id, index, len(list_intersect(a, b))::DOUBLE / len(list_distinct(a || b)) AS overlap,
      len(list_intersect(a, b)) = len(a) AS inside FROM (
      SELECT job_id, index, list_distinct(string_split(lower(ocr_text), chr(10))) AS a,
        lag(list_distinct(string_split(lower(ocr_text), chr(10)))) OVER (PARTITION BY job_id ORDER BY index) AS b
      FROM frames) WHERE b IS NOT NULL""",
)
def _(t):
    rows = t.frames.columns(a=line_set(F.col("ocr_text"))).scan(b=lag(F.col("a")))
    a, b = F.col("a"), F.col("b")
    pairs = rows.df.filter(b.isNotNull())
    return pairs.select("job_id", "index", line_jaccard(a, b).alias("overlap"), is_subset(a, b).alias("inside"))


@query(
    "h2_merge_text_channels",
    """SELECT conv_id, turn, merged_text, sha256(merged_text) AS checksum, length(merged_text) AS character_count,
      CASE WHEN merged_text = '' THEN 0
        ELSE len(regexp_split_to_array(merged_text, '\\s+')) END AS word_count,
      CASE WHEN merged_text = '' THEN 'no text could be extracted' END AS error FROM (
      SELECT conv_id, turn, trim(concat_ws(chr(10) || chr(10),
        CASE WHEN role = 'user' THEN '=== TRANSCRIPT (AUDIO) ===' || chr(10) || text END,
        CASE WHEN role = 'assistant' THEN '=== SUBTITLES ===' || chr(10) || text END,
        CASE WHEN role <> 'system' AND turn % 2 = 0 THEN '=== ON-SCREEN TEXT (OCR) ===' || chr(10) || role END))
        AS merged_text FROM conversations)""",
)
def _(t):
    role, text = F.col("role"), F.col("text")
    sources = t.conversations.select(
        "conv_id", "turn",
        F.when(role == "user", text).alias("transcript"),
        F.when(role == "assistant", text).otherwise("").alias("subtitles"),
        F.when((role != "system") & (F.col("turn") % 2 == 0), role).alias("screen"),
    )
    merged = ops.merge_text_channels(sources).drop("transcript", "subtitles", "screen")
    counts = {c: F.col(c).cast("long") for c in ("word_count", "character_count")}
    return merged.withColumns(counts)


@query(
    "h3_dropped_rows",
    "SELECT job_id, index FROM frames WHERE is_duplicate",
)
def _(t):
    frames = t.frames.df
    return ops.dropped_rows(frames, frames.filter("not is_duplicate"), ["job_id", "index"]).select("job_id", "index")


@query(
    "h4_union_findings",
    """SELECT 'large' AS "check", doc_id::VARCHAR AS target, n_chars::VARCHAR AS detail, 'warning' AS severity
    FROM documents WHERE n_chars > 5000
    UNION ALL SELECT 'orphan', path, 'not linked', 'info' FROM existing""",
)
def _(t):
    large = t.documents.filter("n_chars > 5000").select(
        F.col("doc_id").cast("string").alias("target"), F.col("n_chars").cast("string").alias("detail"),
        F.lit("warning").alias("severity"),
    )
    orphan = t.existing.select(
        F.col("path").alias("target"), F.lit("not linked").alias("detail"), F.lit("info").alias("severity")
    )
    return ops.union_findings({"large": large, "orphan": orphan})


@query(
    "h5_replace_membership",
    """SELECT role_id, permission FROM role_permissions WHERE role_id % 5 <> 0
    UNION ALL SELECT n_nationkey::BIGINT, r_name FROM nation, region
      WHERE n_nationkey % 5 = 0 AND r_regionkey = n_nationkey % 3""",
)
def _(t):
    regions = t.region.select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("permission"))
    roles = t.nation.filter("n_nationkey % 5 = 0").select(
        F.col("n_nationkey").cast("long").alias("role_id"), (F.col("n_nationkey") % 3).alias("key")
    )
    wanted = roles.join(regions, "key").drop("key")
    unknown = roles.select("role_id", F.concat(F.lit("NO SUCH CODE "), "key").alias("permission"))
    return ops.replace_membership(
        t.role_permissions, wanted.unionByName(unknown), regions, "role_id", "permission"
    )
