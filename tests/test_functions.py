"""Golden rows of the column functions and samplers."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillwork.functions import json as js
from quillwork.functions import text as fn
from quillwork.functions import vectors as vec
from quillwork.functions.classify import classify_content
from quillwork.functions.numbers import round_binary
from quillwork.operators.filters import filter_in, filter_optional_eq
from quillwork.operators.inference import Registry, sequence_ratio, with_defaults
from quillwork.operators.ordered import Ordered
from quillwork.operators.sequence import sample_fixed_interval, sample_fps, sequence_ratio as ratio_of
from quillwork.plans.frames import STRATEGIES, classify_frames


def apply(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, c {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("c"))).collect()]


CASES = [
    ("Q1. What is the capital of France?\n(A) Paris\n(B) Rome", ["question", "options"]),
    ("Which of the following is a noble gas?\n1) Oxygen\n2) Neon", ["question", "options"]),
    ("Answer: (B) Neon", ["answer"]),
    ("THE FRENCH REVOLUTION", ["heading"]),
    ("Figure 2.1 The water cycle", ["diagram"]),
    ("Name    Age    City\nAna    31    Rome\nBen    28    Oslo", ["table"]),
    ("The river flows from the hills to the sea and carries sand and silt along its way.", ["paragraph"]),
    ("", []),
    (" \n\t ", []),
    ("Table 3 lists the sums", ["table"]),
    ("A Tale Of Two Very Old Cities", ["heading"]),
    ("Figure 1 shows how water moves from the sea to the hills and back again", ["paragraph", "diagram"]),
]


def test_content_tags(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i long, text string")
    rows = classify_content(df, "text").orderBy("i").collect()
    assert [r.tags for r in rows] == [c[1] for c in CASES]


def test_classify_skips_duplicates(spark):
    rows = [(1, 0, "Answer: B", False), (1, 1, "Answer: B", True), (1, 2, "What?", False)]
    frames = spark.createDataFrame(rows, "job_id long, index long, ocr_text string, is_duplicate boolean")
    tagged, counts = classify_frames(frames)
    assert (counts.first().frames, counts.first().classified) == (2, 2)
    assert {r["index"] for r in tagged.collect()} == {0, 2}


def test_white_space_is_unicode(spark):
    text = "  A b\x1c\tc 　"
    assert apply(spark, [text], fn.normalise_ws_lower) == ["a b c"]
    assert apply(spark, [text], fn.strip) == [text.strip()]
    assert apply(spark, [text], fn.word_count) == [len(text.split())]
    assert apply(spark, ["a\r\nb\x0bc  \n"], fn.clean_lines) == [["a", "b", "c"]]


def test_line_patterns(spark):
    lines = ["(A) x", "b. y", "4) z", "5) no", "(A)x", "page 12", "mild", "xiv", "seven"]
    assert apply(spark, lines, fn.is_option_line) == [True, True, True] + [False] * 6
    assert apply(spark, lines, fn.is_page_number)[5:] == [True, True, True, False]
    ends = ["a.", "a)  ", "a”", "a", "a-"]
    assert apply(spark, ends, fn.ends_sentence) == [True, True, True, False, False]


def test_short_texts(spark):
    assert apply(spark, ["x" * 90, "y" * 91], fn.snippet) == ["x" * 90, "y" * 90 + "…"]
    assert apply(spark, ["Hello, World!", "--"], fn.slugify) == ["hello-world", "rule"]
    assert apply(spark, ["20240131", "2024", None], fn.format_yyyymmdd) == ["2024-01-31", "2024", ""]
    assert apply(spark, [0.0, 59.9, 75.2, 3600.0], fn.format_mmss, "double") == ["0:00", "0:59", "1:15", "60:00"]
    assert apply(spark, [0.75, 0.5, 0.4999], fn.confidence_band, "double") == ["high", "medium", "low"]
    assert apply(spark, [0.125, 0.995], fn.percent, "double") == ["13%", "100%"]
    assert apply(spark, ["kehb12", "x", "leph1"], fn.language_of_code) == ["English", "Other", "English"]
    assert apply(spark, ["12", "99"], fn.class_label) == ["Class XII", "Class 99"]


def test_rounding_follows_the_binary_value(spark):
    rng = random.Random(1)
    values = [rng.randrange(0, 200000) / 100000 for _ in range(3000)]
    assert apply(spark, values, lambda c: round_binary(c, 4), "double") == [round(v, 4) for v in values]


def test_estimates(spark):
    cases = [(10.0, 10.0, None), (10.0, None, 24.0), (10.0, None, 0.0), (None, None, None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, d double, a double, b double")
    got = df.orderBy("i").select(fn.estimate_frames(F.col("d"), F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [100, 240, 300, 0]


def test_commit_subjects(spark):
    mapping = {"feat": "Added", "breaking": "Removed"}
    rows = apply(
        spark,
        ["feat(ui): add x", "feat!: drop y", "odd: z", " plain words ", "feat:"],
        lambda c: fn.parse_conventional_commit(fn.commit_parts(c), mapping),
    )
    assert [(r.section, r.scope, r.summary) for r in rows] == [
        ("Added", "ui", "add x"), ("Removed", "", "drop y"), ("Changed", "", "z"),
        ("Changed", "", "plain words"), ("Changed", "", "feat:"),
    ]


def test_front_matter(spark):
    text = '---\nTitle: "A b"\nx\nowner : me\ntitle: later\n---\n# Head\n'
    assert apply(spark, [text, "# Head\n", "x"], fn.frontmatter) == [{"title": "later", "owner": "me"}, {}, {}]


def test_uncertain_json(spark):
    texts = ['["a", "b"]', '{"a": 1}', "[", "", None]
    assert apply(spark, texts, js.decode_json_array) == [["a", "b"], [], [], [], []]
    answers = ['{"facts": [1, {"n": "x"}, null]}', 'so:\n{"facts": []} ok', "none", None]
    items = apply(spark, answers, lambda c: F.size(js.object_items(js.lenient_json(c), "$.facts")))
    assert items == [1, 0, 0, 0]


def test_options_fall_back_to_defaults(spark):
    defaults = {"cap": 5, "limit": 0.5, "best": True}
    rows = apply(spark, ['{"cap": 9, "best": false}', "{oops", None], lambda c: with_defaults(c, defaults))
    assert [(r.cap, r.limit, r.best) for r in rows] == [(9, 0.5, False), (5, 0.5, True), (5, 0.5, True)]


def test_image_features(spark):
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (6, 8))
    flat = [[int(x) for x in image.ravel()], [7] * 48]
    std = apply(spark, flat, lambda c: vec.pixel_std(c, 8), "array<int>")
    assert std == pytest.approx([image.std(), 0.0])
    wide = np.pad(image.astype(float), 1, mode="reflect")
    lap = [
        wide[r - 1, c] + wide[r + 1, c] + wide[r, c - 1] + wide[r, c + 1] - 4 * wide[r, c]
        for r in range(1, 7) for c in range(1, 9)
    ]
    assert apply(spark, flat, lambda c: vec.laplacian_var(c, 8), "array<int>") == pytest.approx([np.var(lap), 0.0])
    values, counts = np.unique(image, return_counts=True)
    mode = values[counts.argmax()]
    share = float(((image >= mode - 18) & (image <= mode + 18)).mean())
    assert apply(spark, flat, lambda c: vec.bg_uniformity(c, 8), "array<int>") == pytest.approx([share, 1.0])
    bits = "".join("1" if image[r, c + 1] > image[r, c] else "0" for r in range(6) for c in range(7))
    hexed = apply(spark, flat[:1], lambda c: vec.dhash(c, rows=6, cols=8), "array<int>")[0]
    assert hexed[:10] == "".join(f"{int(bits[i : i + 4], 2):x}" for i in range(0, 40, 4))


def _timeline(spark, seconds, fps):
    rows = [("a", i, i / fps) for i in range(int(seconds * fps))]
    return Ordered.of(spark.createDataFrame(rows, "k string, pos long, timestamp double"), ["k"], "pos")


def test_sampling(spark):
    rows = sample_fixed_interval(_timeline(spark, 10, 30), 2.0)
    assert sorted(r.sample_ts for r in rows.collect()) == [0.0, 2.0, 4.0, 6.0, 8.0]
    auto = sample_fixed_interval(_timeline(spark, 10, 30))
    assert sorted(r.sample_ts for r in auto.collect()) == [0.0, 2.0, 4.0, 6.0, 8.0]
    clip = _timeline(spark, 3, 30)
    assert sample_fps(clip, None).count() == 90
    assert abs(sample_fps(clip, 10.0).count() - 30) <= 2


def test_registries(spark):
    assert STRATEGIES.get("no such strategy") is STRATEGIES.get("hybrid") is STRATEGIES.get(None)
    providers = Registry()
    providers.register("local", len)
    assert providers.get("local") is len
    with pytest.raises(ValueError, match="unknown name"):
        providers.get("remote")


def test_ratio(spark):
    pairs = [("", ""), ("a", ""), ("abcd", "bcde"), ("same", "same")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r[0] for r in df.coalesce(1).select(sequence_ratio("a", "b")).collect()]
    assert got == [ratio_of(*p) for p in pairs] == [1.0, 0.0, 0.75, 1.0]


def test_filters_skip_what_is_not_asked(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "s string, n int")
    assert filter_optional_eq(df, s="all", n=None).count() == 2
    assert filter_optional_eq(df, s="a", n="").count() == 1
    assert filter_in(df, "s", []).count() == 0
