"""Document structure: layout blocks, heading tree, readable blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions.text import (
    ends_sentence,
    is_caption,
    is_example,
    is_exercise,
    is_page_number,
    leaf_title,
    normalise_ws_lower,
    strip,
)
from quillwork.operators.ordered import Ordered, last, last_before, number_rows, total
from quillwork.operators.stacks import open_headings
from quillwork.session import materialise

DOC = "document_id"
# Limits of the layout and noise rules.
DEFAULT_SIZE = 12
HEADING_CHARS = 200
HEADER_CHARS = 80
NUMBER_CHARS = 8


# ---- layout -----------------------------------------------------------------


def weighted_mode(spans: DataFrame, keys: Sequence[str] = (DOC,)) -> DataFrame:
    """Per document: the rounded size that carries most characters, ties to the first seen."""
    text = strip(F.coalesce("text", F.lit("")))
    sizes = spans.filter(text != "").groupBy(*keys, F.bround("size").cast("long").alias("__size"))
    weights = sizes.agg(F.sum(F.char_length(text)).alias("__w"), F.min("order_index").alias("__at"))
    heaviest = F.max_by("__size", F.struct("__w", -F.col("__at"))).alias("body_size")
    found = weights.groupBy(*keys).agg(heaviest)
    every = spans.select(*keys).distinct().join(found, list(keys), "left")
    return every.withColumn("body_size", F.coalesce("body_size", F.lit(DEFAULT_SIZE)))


def rank_heading_sizes(blocks: DataFrame, body: DataFrame) -> DataFrame:
    """Add `element_type` and `level`: sizes above the body size rank 1..N, largest first.

    Ranking runs over the distinct whole sizes of a document, a handful.
    """
    size = F.bround("size").cast("long")
    sized = blocks.withColumn("__size", size).join(body, DOC)
    large = F.col("size") >= F.col("body_size") + 1.0
    sizes = sized.filter(large).select(DOC, "__size").distinct()
    rank = F.row_number().over(Window.partitionBy(DOC).orderBy(F.desc("__size")))
    levels = sizes.select(DOC, "__size", rank.cast("long").alias("__level"))
    joined = sized.join(levels, [DOC, "__size"], "left")
    heading = F.col("__level").isNotNull() & (F.char_length("text") <= HEADING_CHARS)
    return joined.withColumns(
        {
            "element_type": F.when(heading, "heading").otherwise("paragraph"),
            "level": F.when(heading, F.col("__level")),
        }
    ).drop("__size", "__level", "body_size")


def text_layer_flag(elements: DataFrame, pages: str = "page") -> DataFrame:
    """Per document: enough characters per page to have a text layer?"""
    chars = F.sum(F.char_length(strip(F.coalesce("text", F.lit("")))))
    counted = elements.groupBy(DOC).agg(chars.alias("chars"), F.max(pages).alias("page_count"))
    has = F.col("chars") >= 20 * F.greatest(F.col("page_count"), F.lit(1))
    return counted.withColumns({"has_text_layer": has, "needs_ocr": ~has})


# ---- noise ------------------------------------------------------------------


def running_header_detection(elements: DataFrame) -> DataFrame:
    """Add `is_noise`: page numbers, and short texts repeated over many pages.

    Elements need `page_count`. Pages are counted distinct per (document, text),
    and only the repeated texts are joined back.
    """
    text = strip(F.coalesce("text", F.lit("")))
    worded = F.col("element_type").isin("paragraph", "heading") & (text != "")
    number = worded & is_page_number(text) & (F.char_length(text) <= NUMBER_CHARS)
    short = worded & ~number & (F.char_length(text) <= HEADER_CHARS)
    keyed = elements.withColumns(
        {"__number": number, "__key": F.when(short, normalise_ws_lower(text))}
    )
    enough = F.greatest(F.lit(3), F.ceil(0.4 * F.col("page_count")))
    headers = (
        keyed.filter(F.col("__key").isNotNull() & (F.col("page_count") >= 3))
        .groupBy(DOC, "__key", "page_count")
        .agg(F.countDistinct("page").alias("__pages"))
        .filter(F.col("__pages") >= enough)
        .select(DOC, "__key", F.lit(True).alias("__header"))
    )
    joined = keyed.join(headers, [DOC, "__key"], "left")
    noise = F.col("__number") | F.coalesce("__header", F.lit(False))
    return joined.withColumn("is_noise", noise).select(*elements.columns, "is_noise")


# ---- heading tree -----------------------------------------------------------


def heading_tree(elements: Ordered, id_col: str = "id", root: int = 0) -> Ordered:
    """Add `ancestors`, `parent_id`, `depth` and `path` to every element.

    The parent of a heading is the nearest heading before it with a smaller level;
    other elements hang under the latest heading. The ancestors of all headings come
    from `open_headings`; elements then carry the latest heading's forward, in one
    window over both. Any number of levels will do.
    """
    heading = F.col("element_type") == "heading"
    level = F.coalesce(F.nullif(F.col("level"), F.lit(0)), F.lit(1)).cast("long")
    keys, pos = list(elements.keys), elements.pos
    headings = elements.with_df(
        elements.df.filter(heading).select(*keys, pos, F.col(id_col).cast("long").alias("__id"), level.alias("__level"))
    )
    above = open_headings(headings)
    # a heading's record stands right before the heading itself
    place = (F.col(pos) * 2).cast("long")
    kept = [f for f in elements.df.schema.fields if f.name not in keys]
    marks = above.select(
        *keys, place.alias("__p"), F.struct("__id", "__above").alias("__open"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in kept],
    )
    # columns stay columns, so that those nobody asks for are not sorted along
    rows = elements.df.select(
        *keys, (place + 1).alias("__p"), F.lit(None).cast(marks.schema["__open"].dataType).alias("__open"), *[f.name for f in kept]
    )
    both = Ordered(marks.unionByName(rows), elements.keys, "__p", 2 * elements.largest)
    found = both.scan(__latest=last(F.col("__open"))).df.filter("__open is null").select(*elements.df.columns, "__latest")
    latest, trunk = F.col("__latest"), F.array(F.lit(root).cast("long"))
    under = F.concat(trunk, latest["__above"])
    own = F.when(heading, under).when(latest.isNotNull(), F.array_append(under, latest["__id"])).otherwise(trunk)
    found = found.withColumn("ancestors", own)
    steps = F.array_append(F.col("ancestors"), F.col(id_col)).cast("array<string>")
    found = found.withColumns(
        {
            "parent_id": F.element_at("ancestors", -1),
            "depth": F.size("ancestors"),
            "path": F.concat(F.lit("/"), F.array_join(steps, "/")),
        }
    )
    return elements.with_df(found.drop("__latest"))


def heading_parents(elements: Ordered, id_col: str = "id", root: int = 0) -> DataFrame:
    """Headings with the nearest preceding heading of a smaller level."""
    tree = heading_tree(elements.filter(F.col("element_type") == "heading"), id_col, root)
    return tree.df


def enclosing_section(elements: Ordered, id_col: str = "id", root: int = 0) -> DataFrame:
    """Non-headings with the latest heading before them, else root."""
    heading = F.when(F.col("element_type") == "heading", F.col(id_col))
    rows = elements.scan(section_id=last(heading)).df.filter("element_type <> 'heading'")
    return rows.withColumn("section_id", F.coalesce("section_id", F.lit(root)))


def materialise_paths(nodes: DataFrame, key: str = DOC) -> DataFrame:
    """Add `depth` and `path` to an (id, parent_id) table of any depth.

    Pointer jumping: each round doubles the stretch of path a node knows, so a
    tree of depth d takes log2(d) joins. Only nodes that have children are
    walked; leaves take the path of their parent once at the end. A cycle of
    parents is an error.
    """
    inner = nodes.select(key, F.col("parent_id").alias("id")).filter("id is not null").distinct()
    walk = nodes.join(inner, [key, "id"], "left_semi").select(
        key, "id", F.col("parent_id").alias("up"), F.array("id").alias("trail")
    )
    rounds, most = 0, None
    while True:
        walk = materialise(walk)
        climbing = walk.filter("up is not null")
        if climbing.isEmpty():
            break
        most = walk.count().bit_length() + 1 if most is None else most
        if rounds > most:
            some = [tuple(r) for r in climbing.select(key, "id").orderBy(key, "id").limit(10).collect()]
            raise ValueError(f"parents form a cycle, among others at {some}")
        rounds += 1
        above = walk.select(
            key, F.col("id").alias("up"), F.col("up").alias("__up"), F.col("trail").alias("__trail")
        )
        walk = walk.join(above, [key, "up"], "left").select(
            key, "id", F.col("__up").alias("up"),
            F.concat(F.coalesce("__trail", F.array().cast("array<bigint>")), "trail").alias("trail"),
        )
    parents = walk.select(key, F.col("id").alias("parent_id"), F.col("trail").alias("__above"))
    joined = nodes.join(parents, [key, "parent_id"], "left")
    above = F.coalesce("__above", F.array().cast("array<bigint>"))
    steps = F.array_append(above, F.col("id")).cast("array<string>")
    return joined.withColumns(
        {"depth": F.size(above), "path": F.concat(F.lit("/"), F.array_join(steps, "/"))}
    ).select(*nodes.columns, "depth", "path")


def leaf_columns() -> dict[str, Column]:
    """Title and content of a tree node made from an element."""
    heading = F.col("element_type") == "heading"
    text = F.coalesce("text", F.lit(""))
    leaf = leaf_title(F.col("element_type"), text, F.col("dim_a"), F.col("dim_b"))
    title = F.when(heading, text).otherwise(leaf)
    bare = F.col("element_type").isin("heading", "figure", "table")
    return {
        "node_type": F.when(heading, "section").otherwise(F.col("element_type")),
        "title": title,
        "content": F.when(bare, "").otherwise(text),
    }


# ---- readable blocks --------------------------------------------------------


def _kinds(elements: Ordered) -> Ordered:
    """Add `__k`: H heading, O figure or table, C caption, E example or exercise, P text."""
    text = strip(F.coalesce("text", F.lit("")))
    rows = elements.columns(__t=text)
    t, kind = F.col("__t"), F.col("element_type")
    k = (
        F.when(kind == "heading", "H")
        .when(kind.isin("figure", "table"), "O")
        .when(is_caption(t), "C")
        .when(is_example(t) | is_exercise(t), "E")
        .otherwise("P")
    )
    rows = rows.columns(__k=k)
    return rows.filter(F.col("__k").isin("H", "O") | (t != ""))


def merge_paragraphs(elements: Ordered) -> Ordered:
    """Add `block`, the position of the first element of the paragraph.

    Text goes on with the open paragraph unless that ended a sentence; an
    example or exercise takes all text up to the next heading or object.
    Captions are passed over. Headings and captions have no block; figures and
    tables are their own.
    """
    rows = elements if "__k" in elements.df.columns else _kinds(elements)
    k, pos = F.col("__k"), F.col(elements.pos)
    seen = F.struct(k.alias("k"), ends_sentence(F.col("__t")).alias("ends"))
    rows = rows.scan(
        __prev=last_before(F.when(k != "C", seen)),
        __mode=last_before(F.when(k.isin("H", "O", "E"), k)),
    )
    prev, absorbing = F.col("__prev"), F.coalesce(F.col("__mode") == "E", F.lit(False))
    fresh = prev.isNull() | prev["k"].isin("H", "O") | prev["ends"]
    starts = (k == "E") | ((k == "P") & ~absorbing & fresh)
    rows = rows.columns(__starts=starts)
    rows = rows.scan(__block=last(F.when(F.col("__starts"), pos)))
    block = F.when(k == "O", pos).when(k.isin("E", "P"), F.col("__block"))
    rows = rows.columns(block=block)
    return rows.with_df(rows.df.drop("__prev", "__mode", "__block"))


def join_pieces(pieces: Column) -> Column:
    """Texts of one paragraph -> one text; a trailing hyphen glues the next word."""
    following = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces), F.lit(1)))
    pairs = F.arrays_zip(pieces.alias("a"), following.alias("b"))

    def piece(pair: Column) -> Column:
        text = pair["a"]
        return (
            F.when(pair["b"].isNull(), text)
            .when(F.endswith(text, F.lit("-")), F.substring(text, F.lit(1), F.char_length(text) - 1))
            .otherwise(F.concat(text, F.lit(" ")))
        )

    return strip(F.array_join(F.transform(pairs, piece), ""))


def attach_captions(elements: Ordered) -> Ordered:
    """Decide for every caption where it goes.

    A caption goes to the last emitted block if that is an object without a
    caption; else it is held for the next object. A later held caption replaces
    an earlier one, and a heading or the end turns the held one into a
    paragraph. A paragraph counts as emitted once something after it closes it.

    Whether an object is captioned on arrival depends on the object before it in
    just three ways (never, always, same as before), so that chain is a carried
    last value too. Adds `held` and `goes_to` to captions (the object it joined
    at once), `pending` to headings and objects (the held caption they meet) and
    `captioned` to objects.
    """
    rows = merge_paragraphs(elements)
    k, pos = F.col("__k"), F.col(elements.pos)
    caption, clears = k == "C", k.isin("H", "O")
    one = lambda c: c.cast("long")
    rows = rows.scan(__cC=total(one(caption)), __cP=total(one(F.col("__starts"))))
    rows = rows.scan(
        __obj=last_before(F.when(k == "O", F.struct(pos.alias("at"), "__cC", "__cP"))),
        __h=last_before(F.when(k == "H", pos)),
        __p=last_before(F.when(F.col("__starts"), pos)),
    )
    obj = F.col("__obj")
    begun = F.col("__cP") - obj["__cP"]
    closed = (begun >= 2) | ((begun == 1) & F.coalesce(F.col("__h") > F.col("__p"), F.lit(False)))
    first = F.col("__cC") - obj["__cC"] == 1
    near = F.coalesce(caption & obj.isNotNull() & first & ~closed, F.lit(False))
    rows = rows.columns(__near=near).scan(__cN=total(one(F.col("__near"))))
    rows = rows.scan(
        __clear=last_before(F.when(clears, F.struct(pos.alias("at"), "__cC", "__cN")))
    )
    since = lambda c: F.col(c) - F.coalesce(F.col("__clear")[c], F.lit(0))
    waiting = since("__cC")
    step = F.when(waiting == 0, 0).when(waiting - since("__cN") > 0, 1)
    rows = rows.scan(__born=last(F.when(k == "O", step)))
    rows = rows.columns(__born=F.coalesce("__born", F.lit(0)))
    rows = rows.scan(__full=last_before(F.when(k == "O", F.col("__born"))))
    joins = F.col("__near") & (F.coalesce("__full", F.lit(0)) == 0)
    rows = rows.columns(
        goes_to=F.when(joins, obj["at"]), held=caption & ~joins
    )
    note = F.struct(pos.alias("at"), F.col("__t").alias("text"), F.col("id").alias("id"))
    rows = rows.scan(__note=last_before(F.when(F.col("held"), note)))
    note = F.col("__note")
    meets = clears & note.isNotNull() & (note["at"] > F.coalesce(F.col("__clear")["at"], F.lit(-1)))
    rows = rows.columns(pending=F.when(meets, note), captioned=(k == "O") & (F.col("__born") == 1))
    spare = ["__cC", "__cP", "__obj", "__h", "__p", "__near", "__cN", "__clear", "__born", "__full", "__note"]
    return rows.with_df(rows.df.drop(*spare))


def assemble_blocks(elements: Ordered, lossless: bool = False, root: int = 0) -> DataFrame:
    """Readable blocks of a document in order, with their section and sources.

    Elements need `id`, `page` and no noise. `lossless` also emits, as
    paragraphs, held captions that a later one replaced.
    """
    pos = elements.pos
    section = last_before(F.when(F.col("element_type") == "heading", F.col("id")))
    rows = attach_captions(_kinds(elements).scan(section_id=section))
    # read four times below
    df = materialise(rows.df.withColumn("section_id", F.coalesce("section_id", F.lit(root))))
    k, at = F.col("__k"), F.col(pos)
    keys = list(rows.keys)

    # text, objects and the captions that joined an object at once
    members = df.withColumn("__b", F.coalesce("block", "goes_to")).filter("__b is not null")
    members = members.withColumn("__cap", k == "C")
    body = F.struct(at.alias("at"), F.col("__t").alias("t"), "id", "__cap")
    held = F.max(F.when(k == "O", F.col("pending.text")))
    grouped = members.groupBy(*keys, F.col("__b").alias("block")).agg(
        F.array_sort(F.collect_list(body)).alias("__m"),
        F.min_by("__k", pos).alias("__k"),
        F.min_by("element_type", pos).alias("__type"),
        F.min_by("__t", pos).alias("__t"),
        F.min_by("page", pos).alias("page"),
        F.min_by("section_id", pos).alias("section_id"),
        F.max(F.when(F.col("__cap"), F.col("__t"))).alias("__joined"),
        held.alias("__held"),
        F.max(F.when(k == "O", F.col("pending.id"))).alias("__held_id"),
    )
    kind = F.col("__k")
    words = F.transform(F.col("__m"), lambda m: m["t"])
    ids = F.transform(F.col("__m"), lambda m: m["id"])
    own = grouped.select(
        *keys,
        "block",
        F.lit(1).alias("__turn"),
        F.when(kind == "O", F.col("__type"))
        .when((kind == "E") & is_example(F.col("__t")), "example")
        .when(kind == "E", "exercise")
        .otherwise("paragraph")
        .alias("block_type"),
        "section_id",
        "page",
        F.when(kind == "O", "").otherwise(join_pieces(words)).alias("text"),
        F.when(kind == "O", F.coalesce("__held", "__joined", F.lit(""))).otherwise("").alias("caption"),
        F.when(F.col("__held_id").isNotNull(), F.array_append(ids, F.col("__held_id")))
        .otherwise(ids)
        .alias("source_element_ids"),
    )

    def loose(rows_: DataFrame, block: Column, page: Column, text: Column, id_: Column) -> DataFrame:
        return rows_.select(
            *keys, block.alias("block"), F.lit(0).alias("__turn"),
            F.lit("paragraph").alias("block_type"), "section_id", page.alias("page"),
            text.alias("text"), F.lit("").alias("caption"), F.array(id_).alias("source_element_ids"),
        )

    note = F.col("pending")
    at_heading = df.filter((k == "H") & note.isNotNull())
    flushed = loose(at_heading, at, F.col("page"), note["text"], note["id"])

    last_clear = F.max(F.when(k.isin("H", "O"), at))
    heading_id = F.max_by("id", F.when(k == "H", at))
    ends = df.groupBy(*keys).agg(
        last_clear.alias("__clear"),
        F.max_by(F.struct(at.alias("at"), "__t", "id"), F.when(F.col("held"), at)).alias("__note"),
        (F.max(at) + 1).alias("block"),
        F.coalesce(heading_id, F.lit(root)).alias("section_id"),
    )
    end_note = F.col("__note")
    open_end = end_note["at"] > F.coalesce("__clear", F.lit(-1))
    closing = loose(ends.filter(open_end), F.col("block"), F.lit(0), end_note["__t"], end_note["id"])
    blocks = own.unionByName(flushed).unionByName(closing)

    if lossless:
        # a held caption is replaced when the next row that decides is a caption too
        marks = rows.with_df(df).columns(__rev=-at)
        back = Ordered(marks.df, rows.keys, "__rev", rows.largest)
        decides = F.when(k.isin("H", "O"), "clear").when(F.col("held"), "held")
        after = back.scan(__next=last_before(decides)).df
        lost = after.filter(F.col("held") & (F.col("__next") == "held"))
        blocks = blocks.unionByName(loose(lost, at, F.col("page"), F.col("__t"), F.col("id")))

    # no more blocks than elements, plus the one at the end
    order = [F.col("block"), F.col("__turn")]
    numbered = number_rows(blocks, keys, order, "order_index", largest=rows.largest + 1)
    return numbered.df.drop("__turn", "block")


def span_minmax(sections: DataFrame, blocks: DataFrame, keys: Sequence[str] = (DOC,)) -> DataFrame:
    """Sections with the first and last page of their blocks, else their own page."""
    paged = blocks.filter("page <> 0").groupBy(*keys, "section_id")
    spans = paged.agg(F.min("page").alias("__first"), F.max("page").alias("__last"))
    joined = sections.join(spans, [*keys, "section_id"], "left")
    return joined.withColumns(
        {
            "page_start": F.coalesce("__first", "page"),
            "page_end": F.coalesce("__last", "page"),
        }
    ).drop("__first", "__last")
