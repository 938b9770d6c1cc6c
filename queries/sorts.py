"""G: sorts, limits and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.base import query
from quillwork.operators import filters as ops
from quillwork.operators.paging import PageIndex


@query(
    "g1_page",
    """SELECT book_code, class_level, title, (SELECT count(*) FROM books WHERE downloaded) AS total
    FROM books WHERE downloaded ORDER BY class_level, subject, title, book_code LIMIT 50 OFFSET 10""",
)
def _(t):
    books = t.books.filter("downloaded")
    order = [F.col("class_level"), F.col("subject"), F.col("title")]
    return ops.page(books, order, "book_code", limit=50, offset=10).select(
        "book_code", "class_level", "title", "total"
    )


@query(
    "g1_page_deep",
    """SELECT l_orderkey, l_linenumber, l_shipdate, n AS total FROM (
      SELECT *, row_number() OVER (ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) - 1 AS place, count(*) OVER () AS n
      FROM lineitem) WHERE place >= n * 9 // 10 AND place < n * 9 // 10 + 200""",
)
def _(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate")
    index = PageIndex.of(rows, [F.desc("l_shipdate")], ["l_orderkey", "l_linenumber"])
    return index.page(200, index.total * 9 // 10)


@query("g2_newest", "SELECT id, status FROM jobs ORDER BY id DESC LIMIT 20")
def _(t):
    return ops.newest(t.jobs, 20).select("id", "status")


@query(
    "g3_search_topk",
    """SELECT document_id, order_index, title FROM
    (SELECT *, id AS order_index FROM nodes WHERE node_type <> 'root')
    WHERE lower(title) LIKE '%erea%' OR lower(content) LIKE '%erea%'
    ORDER BY document_id, order_index LIMIT 50""",
)
def _(t):
    nodes = t.nodes.withColumn("order_index", F.col("id"))
    return ops.search_topk(nodes, "Erea", limit=50).select("document_id", "order_index", "title")


@query(
    "g4_first_n_per_group",
    """SELECT session_id, source_label, document_id, value FROM facts
    QUALIFY row_number() OVER (PARTITION BY session_id, source_label ORDER BY document_id, pos) <= 15""",
)
def _(t):
    few = ops.first_n_per_group(t.facts, ["session_id", "source_label"], [F.col("document_id"), F.col("pos")], 15)
    return few.select("session_id", "source_label", "document_id", "value")


@query("g5_sort_ci", "SELECT p_brand, p_name, p_partkey FROM part ORDER BY lower(p_brand), lower(p_name)")
def _(t):
    return ops.sort_ci(t.part, "p_brand", "p_name").select("p_brand", "p_name", "p_partkey")
