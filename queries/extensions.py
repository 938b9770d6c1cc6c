"""K: extension surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import query
from quillwork.functions.aggregates import register_aggregates
from quillwork.functions.text import clean_lines
from quillwork.operators.inference import batch_infer, explode_lines, register_functions, sequence_ratio, session_status
from quillwork.operators.ordered import lag
from quillwork.operators.sequence import first_seen_rows
from quillwork.plans.frames import STRATEGIES, SelectOptions


def _stub():
    """A stand-in model: upper-cases its input and refuses texts of odd length."""

    def answer(row: dict) -> tuple[str, int, int]:
        text = row["text"]
        if len(text) % 2:
            raise ValueError("odd length")
        return text[::-1], len(text), 1

    return answer


@query(
    "k1_batch_infer",
    """SELECT conv_id, turn, CASE WHEN length(text) % 2 = 0 THEN reverse(text) ELSE '' END AS content,
      CASE WHEN length(text) % 2 = 0 THEN 'SUCCESS' ELSE 'FAILED' END AS status,
      CASE WHEN length(text) % 2 = 0 THEN 1 ELSE 3 END AS attempts,
      CASE WHEN length(text) % 2 = 1 THEN 'odd length' END AS error FROM conversations""",
)
def _(t):
    answers = batch_infer(t.conversations, _stub, ["text"], backoff=0.0)
    return answers.select("conv_id", "turn", "content", "status", "attempts", "error")


@query(
    "k1_session_status",
    """SELECT conv_id, count(*) AS calls, count(*) FILTER (length(text) % 2 = 0) AS succeeded,
      CASE WHEN count(*) FILTER (length(text) % 2 = 0) > 0 THEN 'COMPLETED' ELSE 'FAILED' END AS session_status
    FROM conversations GROUP BY ALL""",
)
def _(t):
    return session_status(batch_infer(t.conversations, _stub, ["text"], backoff=0.0), "conv_id")


@query(
    "k2_strategy_registry",
    """SELECT job_id, min(index) AS index FROM frames GROUP BY job_id, floor(timestamp / 86400.0::DOUBLE)""",
)
def _(t):
    picked = STRATEGIES.get("fixed_interval")(t.frames, SelectOptions(interval=86400.0))
    return picked.select("job_id", "index")


@query(
    "k4_explode_lines",
    """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS pos, trim(line) AS line
    FROM lines WHERE trim(line) <> ''""",
)
def _(t):
    rows = explode_lines(t.documents.select("doc_id", "text"), "text")
    return rows.withColumn("pos", F.col("pos").cast("long"))


@query(
    "k4_explode_lines_udtf",
    """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS pos, trim(line) AS line
    FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line,
      generate_subscripts(string_split(text, chr(10)), 1) AS i FROM conversations) WHERE trim(line) <> ''""",
)
def _(t):
    register_functions(t.spark)
    t.conversations.createOrReplaceTempView("__conversations")
    return t.spark.sql(
        "SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, line FROM __conversations, LATERAL explode_lines(text)"
    )


@query(
    "k5_first_seen_lines_aggregate",
    """SELECT source, count(*) AS distinct_lines, min(seen) AS first_doc FROM (
      SELECT source, lower(trim(line)) AS k, min(doc_id) AS seen FROM lines JOIN documents USING (doc_id)
      WHERE trim(line) <> '' GROUP BY ALL) GROUP BY ALL""",
)
def _(t):
    docs = t.documents.select("source", "doc_id", "text")
    seen = first_seen_rows(docs, ["source"], ["doc_id"], clean_lines(F.col("text")))
    return seen.groupBy("source").agg(
        F.count(F.lit(1)).alias("distinct_lines"), F.min("at.doc_id").alias("first_doc")
    )


@query(
    "k5_first_seen_lines_sql",
    """SELECT source, string_agg(line, chr(10) ORDER BY doc_id, line_no) AS text, count(*) AS n FROM (
      SELECT source, doc_id, line_no, trim(line) AS line,
        row_number() OVER (PARTITION BY source, lower(trim(line)) ORDER BY doc_id, line_no) AS turn
      FROM lines JOIN documents USING (doc_id) WHERE trim(line) <> '') WHERE turn = 1 GROUP BY source""",
)
def _(t):
    """In steps, so that no Python worker holds more than the lines of a hundred documents."""
    register_aggregates(t.spark)
    t.documents.select("source", "doc_id", "text").createOrReplaceTempView("k5_documents")
    return t.spark.sql(
        """WITH parts AS (
          SELECT source, explode(first_seen_part(doc_id, text)) AS x FROM k5_documents GROUP BY source, doc_id DIV 100),
        firsts AS (SELECT source, min(x) AS x FROM parts GROUP BY source, lower(x.line)),
        pieces AS (
          SELECT source, x.at DIV 100 AS piece, count(*) AS n,
            array_join(transform(array_sort(collect_list(x)), x -> x.line), chr(10)) AS text
          FROM firsts GROUP BY source, x.at DIV 100)
        SELECT source, array_join(transform(array_sort(collect_list(struct(piece, text))), p -> p.text), chr(10)) AS text,
          sum(n) AS n FROM pieces GROUP BY source"""
    )


@query("k6_sequence_ratio")
def _(t):
    rows = t.frames.scan(before=lag(F.col("ocr_text"))).df.filter("before is not null")
    return rows.select("job_id", "index", sequence_ratio("ocr_text", "before").alias("ratio"))
