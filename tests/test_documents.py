"""Document structure against a sequential restatement, for whole and split keys."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillwork.functions.text import SENTENCE_END
from quillwork.operators.documents import (
    assemble_blocks,
    attach_captions,
    heading_tree,
    materialise_paths,
    merge_paragraphs,
    running_header_detection,
)
from quillwork.operators.joins import asof_page_join, points_outside_boxes
from quillwork.operators.ordered import Ordered
from quillwork.operators.stacks import merge, push
from quillwork.plans.documents import assemble_document, map_document

SCHEMA = "document_id long, order_index long, id long, page long, element_type string, level long, text string"
TEXTS = {
    "E": ["Example 1 shows", "Exercise 2", "Questions to ask"],
    "P": ["it goes on", "and ends.", "a hyphen-", "one", "two words-", "(closed)", "why?"],
    "C": ["Figure 1 a map", "Table 2: sums", "Chart 3"],
}


def _documents(seed: int, docs: int, most: int):
    rng = random.Random(seed)
    rows = []
    for doc in range(docs):
        for i in range(rng.randrange(1, most)):
            k = rng.choice("HOCCEPPPPB")
            kind = {"H": "heading", "O": rng.choice(["figure", "table"])}.get(k, "paragraph")
            text = {"H": "Heading", "O": "", "B": "  "}.get(k) or rng.choice(TEXTS.get(k, [""]))
            level = rng.choice([None, 0, 1, 2, 3]) if k == "H" else None
            rows.append((doc, i, i + 1, i // 6 + 1, kind, level, text))
    return rows


def _by_document(rows):
    docs: dict[int, list] = {}
    for row in rows:
        docs.setdefault(row[0], []).append(row)
    return docs


def _glue(pieces):
    out = pieces[0]
    for piece in pieces[1:]:
        out = out[:-1] + piece if out.endswith("-") else out + " " + piece
    return out.strip()


class Assembler:
    """Feeds elements one at a time and remembers what is open."""

    def __init__(self):
        self.blocks, self.section, self.held, self.open = [], 0, None, None

    def close(self):
        if self.open:
            kind, page, parts = self.open
            self.add(kind, page, _glue([t for _, t in parts]), [i for i, _ in parts])
        self.open = None

    def add(self, kind, page, text, ids, caption=""):
        self.blocks.append([kind, self.section, page, text, caption, ids])

    def feed(self, row):
        _, _, ident, page, kind, _, text = row
        text = text.strip()
        if kind == "heading":
            self.close()
            self.release(page)
            self.section = ident
        elif kind != "paragraph":
            self.close()
            held, self.held = self.held, None
            self.add(kind, page, "", [ident] + ([held[0]] if held else []), held[1] if held else "")
        elif text and text.split()[0] in ("Figure", "Table", "Chart"):
            top = self.blocks[-1] if self.blocks else None
            if top and top[0] in ("figure", "table") and not top[4]:
                top[4] = text
                top[5].append(ident)
            else:
                self.held = (ident, text)
        elif text:
            self.text(ident, page, text)

    def text(self, ident, page, text):
        starter = {"Example": "example", "Exercise": "exercise", "Questions": "exercise"}.get(text.split()[0])
        if not starter and self.open and (
            self.open[0] != "paragraph" or not self.open[2][-1][1].endswith(SENTENCE_END)
        ):
            self.open[2].append((ident, text))
            return
        self.close()
        self.open = (starter or "paragraph", page, [(ident, text)])

    def release(self, page):
        if self.held:
            self.add("paragraph", page, self.held[1], [self.held[0]])
        self.held = None

    def finish(self):
        self.close()
        self.release(0)
        return self.blocks


def test_assembled_blocks(spark, sizes):
    rows = _documents(1, 60 if sizes == "whole" else 25, 40)
    seq = Ordered.of(spark.createDataFrame(rows, SCHEMA), ["document_id"], "order_index")
    got: dict[int, list] = {}
    for r in assemble_blocks(seq).orderBy("document_id", "order_index").collect():
        block = [r.block_type, r.section_id, r.page, r.text, r.caption, list(r.source_element_ids)]
        got.setdefault(r.document_id, []).append(block)
    for doc, elements in _by_document(rows).items():
        assembler = Assembler()
        for row in elements:
            assembler.feed(row)
        assert got.get(doc, []) == assembler.finish(), elements


def test_lossless_captions_keep_all_text(spark):
    rows = _documents(2, 40, 30)
    seq = Ordered.of(spark.createDataFrame(rows, SCHEMA), ["document_id"], "order_index")
    ids = [i for r in assemble_blocks(seq, lossless=True).collect() for i in [(r.document_id, x) for x in r.source_element_ids]]
    want = {(r[0], r[2]) for r in rows if r[4] != "heading" and (r[6].strip() or r[4] != "paragraph")}
    assert len(ids) == len(set(ids)) and set(ids) == want


def test_heading_tree(spark, sizes):
    rows = _documents(3, 20, 40)
    seq = Ordered.of(spark.createDataFrame(rows, SCHEMA), ["document_id"], "order_index")
    got = {(r.document_id, r.id): (r.parent_id, r.path) for r in heading_tree(seq).df.collect()}
    for doc, elements in _by_document(rows).items():
        above = [(0, 0)]
        for _, _, ident, _, kind, level, _ in elements:
            if kind == "heading":
                while above[-1][0] >= (level or 1):
                    above.pop()
            trail = [i for _, i in above]
            assert got[doc, ident] == (trail[-1], "/" + "/".join(map(str, [*trail, ident])))
            if kind == "heading":
                above.append((level or 1, ident))


def test_paths_by_pointer_jumping_agree_with_the_tree(spark):
    rows = _documents(4, 10, 40)
    seq = Ordered.of(spark.createDataFrame(rows, SCHEMA), ["document_id"], "order_index")
    tree = heading_tree(seq).df.select("document_id", "id", "parent_id", "path", "depth")
    roots = tree.selectExpr("document_id", "0L as id", "cast(null as long) as parent_id", "'/0' as path", "0 as depth")
    nodes = tree.union(roots.distinct())
    want = {(r.document_id, r.id): (r.depth, r.path) for r in nodes.collect()}
    found = materialise_paths(nodes.select("document_id", "id", "parent_id"))
    assert {(r.document_id, r.id): (r.depth, r.path) for r in found.collect()} == want


def test_caption_flags_are_consistent(spark):
    seq = Ordered.of(spark.createDataFrame(_documents(5, 30, 40), SCHEMA), ["document_id"], "order_index")
    df = attach_captions(seq).df
    assert df.filter("held and goes_to is not null").isEmpty()
    assert df.filter("captioned and pending is null").isEmpty()
    assert merge_paragraphs(seq).df.filter("element_type = 'heading' and block is not null").isEmpty()


def test_running_headers_and_page_numbers(spark):
    rows = [
        (1, page * 3 + i, page * 3 + i + 1, page + 1, "paragraph", None, text, 4)
        for page in range(4)
        for i, text in enumerate((" My  Book", f"page {page + 1}", f"body of page {page} or so"))
    ]
    df = spark.createDataFrame(rows, SCHEMA + ", page_count long")
    noise = {r.text.strip() for r in running_header_detection(df).filter("is_noise").collect()}
    assert noise == {"My  Book", "page 1", "page 2", "page 3", "page 4"}
    seq = Ordered.of(df, ["document_id"], "order_index")
    sections, blocks, counts = assemble_document(seq)
    only = counts.first()
    assert (only.sections, only.blocks, only.dropped_noise) == (1, 1, 8)
    assert blocks.first().text == " ".join(f"body of page {p} or so" for p in range(4))
    assert (sections.first().page_start, sections.first().page_end) == (1, 1)


def test_map_falls_back_to_bookmarks_and_flat(spark):
    schema = SCHEMA + ", dim_a long, dim_b long"
    rows = [(d, i, i + 1, i + 1, "paragraph", None, f"text {i}", None, None) for d in (1, 2) for i in range(3)]
    seq = Ordered.of(spark.createDataFrame(rows, schema), ["document_id"], "order_index")
    titles = spark.createDataFrame([(1, "One"), (2, ""), (3, "Three")], "document_id long, title string")
    marks = spark.createDataFrame(
        [(1, 0, 2, 1, "Part"), (1, 1, 3, 2, "Chapter"), (3, 0, 1, 1, "Alone")],
        "document_id long, order_index long, page long, level long, title string",
    )
    nodes = {(r.document_id, r.id): (r.title, r.path) for r in map_document(seq, titles, marks).collect()}
    assert nodes[1, 1] == ("Part", "/0/1") and nodes[1, 2] == ("Chapter", "/0/1/2")
    assert [nodes[1, i][1] for i in (3, 4, 5)] == ["/0/3", "/0/1/4", "/0/1/2/5"]
    assert nodes[2, 0] == ("Document 2", "/0") and nodes[2, 2] == ("text 1", "/0/2")
    assert nodes[3, 1] == ("Alone", "/0/1")


def test_a_cycle_of_parents_is_an_error(spark):
    nodes = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, None)], "document_id long, id long, parent_id long")
    with pytest.raises(ValueError, match="cycle"):
        materialise_paths(nodes)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 12), max_size=9), max_size=7))
def test_stacks_merge(stretches):
    whole, merged, n = ([], []), ([], []), 0
    for levels in stretches:
        own = ([], [])
        for level in levels:
            push(whole, level, n)
            push(own, level, n)
            n += 1
        merged = merge(merged, own)
        assert merged == whole


def test_heading_tree_of_many_levels(spark, sizes):
    """Ten thousand levels, downwards in the end, and documents with negative and missing levels."""
    many = 10_000 if sizes == "whole" else 200
    rng = random.Random(5)
    rows = [(1, i, i + 1, 1, "heading", i + 1, "h") for i in range(60)]
    rows += [(1, 60 + i, 61 + i, 1, "heading", rng.randrange(1, many) if i % 3 else many - i // 3, "h") for i in range(2 * many // 3)]
    rows += [(2, i, i + 1, 1, "heading" if i % 2 else "paragraph", rng.choice([None, 0, -2, 3, 5]), "t") for i in range(40)]
    seq = Ordered.of(spark.createDataFrame(rows, SCHEMA), ["document_id"], "order_index")
    got = {(r.document_id, r.id): (r.parent_id, list(r.ancestors), r.depth) for r in heading_tree(seq).df.collect()}
    assert len(got) == len(rows)
    for doc, elements in _by_document(rows).items():
        above = [(0, 0)]
        for _, _, ident, _, kind, level, _ in elements:
            if kind == "heading":
                while len(above) > 1 and above[-1][0] >= (level or 1):
                    above.pop()
            trail = [i for _, i in above]
            assert got[doc, ident] == (trail[-1], trail, len(trail))
            if kind == "heading":
                above.append((level or 1, ident))
    assert heading_tree(seq.filter(F.lit(False))).df.isEmpty()


@pytest.mark.parametrize("cell", [64.0, 0.5])
def test_points_and_boxes_of_any_height(spark, cell):
    rng = random.Random(9)
    inf = float("inf")
    boxes = [(1, x, y, x + rng.uniform(0, 90), y + h) for h in (0, 1, 30, 64, 500, 10_000) for _ in range(8)
             for x, y in [(rng.uniform(-200, 200), rng.uniform(-900, 9_000))]]
    boxes += [(2, 0.0, -1e9, 5.0, 1e9), (3, 0.0, -inf, 5.0, inf), (4, 0.0, 5.0, 9.0, 4.0), (5, 0.0, None, 9.0, 9.0), (6, 0.0, 1e18, 2.0, 1e19)]
    points = [(rng.choice([1, 1, 2, 3, 4, 5, 6]), *(2 * [rng.uniform(-200, 200)]), *(2 * [rng.uniform(-900, 9_000)])) for _ in range(900)]
    points = [(p, x, y, x2, y2) for p, x, x2, y, y2 in points]
    points += [(2, 1.0, 1e9, 1.0, 1e9), (2, 1.0, 1e9 + 1, 1.0, 1e9 + 1), (3, 1.0, 1e300, 1.0, 1e300), (1, None, 1.0, 2.0, 3.0)]
    points += [(6, 1.0, 2e18, 1.0, 2e18), (6, 1.0, 1e17, 1.0, 1e17), (1, 0.0, boxes[3][2], 0.0, boxes[3][2])]
    schema = "page int, x0 double, y0 double, x1 double, y1 double"
    got = points_outside_boxes(spark.createDataFrame(points, schema), spark.createDataFrame(boxes, schema), ["page"], cell)

    def inside(p, b):
        if None in p or None in b or p[0] != b[0]:
            return False
        x, y = (p[1] + p[3]) / 2, (p[2] + p[4]) / 2
        return b[1] <= x <= b[3] and b[2] <= y <= b[4]

    want = [p for p in points if not any(inside(p, b) for b in boxes)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert 200 < len(want) < len(points) - 50
    assert points_outside_boxes(spark.createDataFrame(points, schema), spark.createDataFrame([], schema), ["page"]).count() == len(points)


def test_columns_nobody_asks_for_are_not_sorted_along(spark, tmp_path):
    path = str(tmp_path / "elements")
    rows = [(1, i, i // 2, "heading" if i % 3 == 0 else "paragraph", 1, f"text {i}") for i in range(9)]
    names = "document_id long, order_index long, page long, element_type string, level long, text string"
    spark.createDataFrame(rows, names).write.parquet(path)
    elements = spark.read.parquet(path)
    marks = elements.filter("element_type = 'heading'").select("document_id", "order_index", "page", F.col("order_index").alias("id"))
    placed = asof_page_join(elements, marks).select("order_index", "section_id")
    tree = heading_tree(Ordered.of(elements.withColumn("id", F.col("order_index") + 1), ["document_id"], "order_index")).df.select("id", "depth")
    for df in (placed, tree):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not [line for line in plan.split("\n") if "Relation [" not in line and "text#" in line]
    assert sorted(map(tuple, placed.collect())) == [(i, [0, 0, 3, 3, 3, 3, 6, 6, 6][i]) for i in range(9)]
    assert sorted(map(tuple, tree.collect())) == [(i + 1, 1 if i % 3 == 0 else 2) for i in range(9)]
