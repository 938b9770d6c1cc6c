"""Documents: layout spans to elements, elements to a tree and to readable blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.operators.documents import (
    DOC,
    assemble_blocks,
    heading_tree,
    leaf_columns,
    rank_heading_sizes,
    running_header_detection,
    span_minmax,
    text_layer_flag,
    weighted_mode,
)
from quillwork.operators.joins import asof_page_join, points_outside_boxes
from quillwork.operators.ordered import Ordered, number_rows
from quillwork.session import materialise


def layout_to_elements(
    blocks: DataFrame, tables: DataFrame, figures: DataFrame
) -> tuple[Ordered, DataFrame]:
    """(elements in reading order, text-layer flags) from positioned blocks.

    Blocks need document_id, page, order_index, size, text and a box; tables and
    figures a box and their two dimensions.
    """
    free = points_outside_boxes(blocks, tables, [DOC, "page"])
    free = free.filter(F.coalesce("text", F.lit("")) != "")
    typed = rank_heading_sizes(free, weighted_mode(blocks))
    none = F.lit(None)
    rows = typed.select(
        DOC, "page", "y0", "order_index", "element_type", "level", "text",
        none.cast("long").alias("dim_a"), none.cast("long").alias("dim_b"),
        F.lit(1).alias("turn"),
    )
    for kind, turn, df in (("table", 0, tables), ("figure", 2, figures)):
        rows = rows.unionByName(
            df.select(
                DOC, "page", "y0", "order_index", F.lit(kind).alias("element_type"),
                none.cast("long").alias("level"), F.lit("").alias("text"), "dim_a", "dim_b",
                F.lit(turn).alias("turn"),
            )
        )
    # equal heights: tables, then text, then figures, each in source order
    rows = materialise(rows.withColumnRenamed("order_index", "source_order"))
    order = [F.col(c) for c in ("page", "y0", "turn", "source_order")]
    numbered = number_rows(rows, [DOC], order, "order_index")
    return numbered.with_df(numbered.df.drop("turn", "source_order")), text_layer_flag(blocks)


def map_document(
    elements: Ordered, titles: DataFrame, bookmarks: DataFrame | None = None, untitled: Column | None = None
) -> DataFrame:
    """Elements -> tree nodes (id, parent_id, node_type, title, depth, path).

    Documents with headings are structured by them, others by bookmarks, and the
    rest stay flat. Ids are positions plus one; the root of a document is 0.
    `untitled`, over `titles`, names the roots of documents without a title.
    """
    # read for the headings, the rows below them and the documents without any
    elements = elements.with_df(materialise(elements.df))
    rows = elements.columns(id=F.col(elements.pos) + 1)
    tree = heading_tree(rows).df.withColumns(leaf_columns())
    columns = [DOC, "id", "parent_id", "node_type", "title", "content", "level", "depth", "page", "path"]
    nodes = tree.select(*columns)
    if bookmarks is not None:
        bookmarks = materialise(bookmarks)
        headed = elements.df.filter(F.col("element_type") == "heading").select(DOC)
        bare = titles.select(DOC).join(headed, DOC, "left_anti")
        by_mark = _bookmark_nodes(rows, bare, bookmarks, columns)
        nodes = nodes.join(bare, DOC, "left_anti").unionByName(by_mark)
    default = F.concat(F.lit("Document "), F.col(DOC)) if untitled is None else untitled
    name = F.coalesce(F.nullif(F.col("title"), F.lit("")), default)
    roots = titles.select(
        DOC, F.lit(0).cast("long").alias("id"), F.lit(None).cast("long").alias("parent_id"),
        F.lit("root").alias("node_type"), name.alias("title"),
        F.lit("").alias("content"), F.lit(None).cast("long").alias("level"),
        F.lit(0).alias("depth"), F.lit(0).cast("long").alias("page"), F.lit("/0").alias("path"),
    )
    return roots.unionByName(nodes)


def _bookmark_nodes(rows: Ordered, bare: DataFrame, bookmarks: DataFrame, columns: list[str]) -> DataFrame:
    """Nodes of documents without headings: bookmarks are the sections.

    Bookmark ids come first (1..n); elements follow after the last of them.
    """
    marks = bookmarks.join(bare, DOC, "left_semi").withColumn("id", F.col("order_index") + 1)
    marks = marks.withColumn("element_type", F.lit("heading")).withColumn("text", F.col("title"))
    tree = heading_tree(Ordered.of(marks, [DOC], "order_index")).df
    sections = tree.select(
        DOC, "id", "parent_id", F.lit("section").alias("node_type"),
        "title", F.lit("").alias("content"),
        F.col("level").cast("long").alias("level"), "depth", "page", "path",
    )
    count = sections.groupBy(DOC).agg(F.count(F.lit(1)).alias("__n"))
    leaves = rows.df.join(bare, DOC, "left_semi").join(count, DOC, "left")
    leaves = leaves.withColumn("id", F.col("id") + F.coalesce("__n", F.lit(0)))
    placed = asof_page_join(leaves.withColumns(leaf_columns()), marks)
    above = sections.select(
        DOC, F.col("id").alias("section_id"), F.col("depth").alias("__d"), F.col("path").alias("__p")
    )
    joined = placed.join(above, [DOC, "section_id"], "left")
    found = joined.withColumns(
        {
            "parent_id": F.col("section_id").cast("long"),
            "depth": F.coalesce("__d", F.lit(0)) + 1,
            "path": F.concat_ws("/", F.coalesce("__p", F.lit("/0")), F.col("id").cast("string")),
            "level": F.lit(None).cast("long"),
        }
    )
    return sections.select(*columns).unionByName(found.select(*columns))


def assemble_document(elements: Ordered) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sections with page spans, blocks, counts per document).

    Elements need `page_count`. Noise is marked first and left out.
    """
    marked = running_header_detection(elements.df).withColumn("id", F.col(elements.pos) + 1)
    marked = elements.with_df(materialise(marked))
    clean = marked.filter(~F.col("is_noise"))
    blocks = materialise(assemble_blocks(clean))
    headings = heading_tree(clean.filter(F.col("element_type") == "heading")).df
    sections = headings.select(
        DOC, F.col("id").alias("section_id"), "parent_id", F.col("text").alias("title"), "depth",
        F.col("page").cast("long").alias("page"),
    )
    zero = F.lit(0).cast("long")
    roots = elements.df.select(DOC).distinct().select(
        DOC, zero.alias("section_id"), F.lit(None).cast("long").alias("parent_id"),
        F.lit("").alias("title"), F.lit(0).alias("depth"), zero.alias("page"),
    )
    spans = span_minmax(roots.unionByName(sections), blocks)
    noise = marked.df.groupBy(DOC).agg(
        F.count_if("is_noise").alias("dropped_noise"),
        (F.count_if(~F.col("is_noise") & (F.col("element_type") == "heading")) + 1).alias("sections"),
    )
    made = blocks.groupBy(DOC).agg(F.count(F.lit(1)).alias("blocks"))
    counts = noise.join(made, DOC, "left").withColumn("blocks", F.coalesce("blocks", F.lit(0)))
    return spans, blocks, counts
