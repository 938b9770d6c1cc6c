"""Readers over small files."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from quillwork.operators.joins import broken_links, local_links, missing_docs, orphan_docs
from quillwork.functions.text import markdown_links
from quillwork.plans.governance import adr_index, build_doc_index, corpus_health
from quillwork.session import configure
from quillwork.sources import readers, writers


def test_binary_corpus(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "A.PDF").write_bytes(b"one")
    (tmp_path / "sub" / "b.pdf").write_bytes(b"two")
    (tmp_path / "empty.pdf").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(b"no")
    rows = readers.scan_binary_corpus(spark, str(tmp_path)).orderBy("name").collect()
    assert [(r.name, r.stem, r.size) for r in rows] == [("A.PDF", "A", 3), ("b.pdf", "b", 3)]
    assert rows[0].checksum == hashlib.sha256(b"one").hexdigest()[:32]


def test_files_larger_than_a_value(spark, tmp_path):
    size, digest = (2 << 30) + 5, hashlib.sha256()
    with open(tmp_path / "a b%20.pdf", "wb") as f:  # a hole: no disk is taken
        f.truncate(size)
    (tmp_path / "c.pdf").write_bytes(b"one")
    for _ in range(2 << 7):
        digest.update(bytes(8 << 20))
    digest.update(bytes(5))
    rows = readers.scan_binary_corpus(spark, str(tmp_path)).orderBy("name").collect()
    assert [(r.name, r.size, r.checksum, r.content) for r in rows] == [
        ("a b%20.pdf", size, digest.hexdigest()[:32], None), ("c.pdf", 3, hashlib.sha256(b"one").hexdigest()[:32], b"one"),
    ]


def test_archives(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, data in (("x/one.pdf", b"1"), ("y/one.pdf", b"22"), ("two.PDF", b"3"), ("n.txt", b"4")):
            z.writestr(name, data)
    rows = [("b.zip", "Book", buffer.getvalue()), ("c.pdf", "Solo", b"%PDF"), ("d.bin", "Odd", b"zz")]
    df = spark.createDataFrame(rows, "path string, title string, content binary")
    got = {(r.title, bytes(r.content)) for r in readers.explode_archive(df).collect()}
    assert got == {("Book — one", b"22"), ("Book — two", b"3"), ("Solo — c", b"%PDF")}


def test_large_archives_go_back_in_pieces(spark):
    def archive(n):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for i in range(n):
                z.writestr(f"{i}.pdf", bytes(3 << 20))
        return buffer.getvalue()

    rows = [("a.zip", "A", archive(7)), ("b.zip", "B", b"PK broken"), *((f"{i}.pdf", "C", b"%PDF") for i in range(2_500)), ("n.pdf", "D", None)]
    fields = ("path", "title", "content")
    batch = pa.RecordBatch.from_pylist([dict(zip(fields, r, strict=True)) for r in rows])
    found = list(readers._members(iter([batch])))
    assert max(b.nbytes for b in found) < 16 << 20 and max(b.num_rows for b in found) <= 1_000
    assert len(found) < 10 and sum(b.num_rows for b in found) == 2_508
    configure(spark)
    wide = spark.range(0, 300, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("t"))
    sizes = wide.mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in bs), "n long")
    assert sizes.agg(F.max("n")).first()[0] < 32 << 20


def test_catalog_script(spark):
    script = "\n".join(
        [
            'tbook.options[1].value="textbook.php?zzzz1=0-9"',
            'if((document.test.tclass.value==6) && (document.test.tsubject.options[sind].text=="Maths"))',
            'tbook.options[1].text="Sums";',
            '//tbook.options[2].text="Hidden";',
            'tbook.options[1].value="textbook.php?fehm1=0-14";',
            'tbook.options[2].value="textbook.php?fehx1=0-3";',
            'if((document.test.tclass.value==13) && (document.test.tsubject.options[sind].text==" Art "))',
            'tbook.options[1].value="textbook.php?fuha2=0-3";',
            'tbook.options[1].text="Paint";tbook.options[1].value="textbook.php?khpa12=0-3";',
            'tbook.options[1].value="textbook.php?fehm1=0-14";',
        ]
    )
    df = spark.createDataFrame([(1, script)], "page int, text string")
    rows = readers.parse_catalog_script(df).orderBy("book_code").collect()
    assert [(r.book_code, r.class_label, r.subject, r.title, r.part, r.language) for r in rows] == [
        ("fehm1", "Class VI", "Maths", "Sums", "1", "English"),
        ("khpa12", "Class XI & XII", "Art", "Paint", "12", "Hindi"),
    ]


def test_webvtt(spark, tmp_path):
    (tmp_path / "a.vtt").write_text(
        "WEBVTT\nKind: captions\n\n1\n00:00:01.000 --> 00:00:02.000\n<c>Hello</c> there\n\n"
        "2\n00:02.000 --> 00:03.000\nhello THERE\nNext <b></b>\n<i></i>\n"
    )
    rows = readers.scan_webvtt(spark, str(tmp_path)).collect()
    assert [r.text for r in rows] == ["Hello there\nNext"]


def test_markdown_and_health(spark, tmp_path):
    (tmp_path / "guide").mkdir()
    (tmp_path / "rules").mkdir()
    (tmp_path / "INDEX.md").write_text("# skipped")
    (tmp_path / "a.md").write_text("# Alpha\n[ok](guide/b.md#x) [gone](no.md) [web](https://x.y)\n")
    (tmp_path / "guide" / "b.md").write_text("---\nmodule: Core\nstatus: Final\n---\n# Beta\n[up](../a.md)\n")
    (tmp_path / "guide" / "c.md").write_text("# Beta twin")
    (tmp_path / "guide" / "d.md").write_text("# Beta twin")
    (tmp_path / "rules" / "r.md").write_text("# rule")
    docs = readers.scan_markdown_docs(spark, str(tmp_path), exclude_trees=["rules"])
    assert sorted(r.relative for r in docs.collect()) == ["a.md", "guide/b.md", "guide/c.md", "guide/d.md"]
    index = build_doc_index(spark, str(tmp_path), ["rules"]).collect()
    assert [(r.module, r.document, r.status) for r in index] == [
        ("Core", "Beta", "Final"), ("guide", "Beta twin", "Draft"), ("guide", "Beta twin", "Draft"),
        ("Platform", "Alpha", "Draft"),
    ]

    files = docs.select(F.col("relative").alias("path"), F.lit(6 * 1024 * 1024).alias("size"), "text")
    links = local_links(files, "path", markdown_links(F.col("text")))
    assert [(r.path, r.link) for r in broken_links(links, files).collect()] == [("a.md", "no.md")]
    assert sorted(r.path for r in orphan_docs(files.select("path"), links).collect()) == ["guide/c.md", "guide/d.md"]
    names = spark.createDataFrame([("beta",), ("Gamma",)], "name string")
    assert [r.name for r in missing_docs(names, docs, ["text"]).collect()] == ["Gamma"]
    report = corpus_health(files, links, names).groupBy("check").count().collect()
    assert {r["check"]: r["count"] for r in report} == {
        "large": 4, "duplicate": 1, "broken-link": 1, "missing-doc": 1, "orphan": 2,
    }


def test_names_of_every_length(spark):
    names = spark.createDataFrame([("beta",), ("Gamma",), ("x",), ("the beta t",), ("betatext",), ("q",)], "name string")
    docs = spark.createDataFrame([("the BETA text",), (None,)], "t string")
    left = [r.name for r in missing_docs(names, docs, ["t"]).collect()]
    assert sorted(left) == ["Gamma", "betatext", "q"]


def test_decision_records(spark):
    rows = [
        ("adr/ADR-0002-use-it.md", "# ADR-2: Use it\n| Status | Accepted |\n| Date | 2024-05-06 |\n"),
        ("adr/adr-10-old-way.md", "nothing"),
        ("adr/notes.md", "# ADR-3: no"),
    ]
    got = adr_index(spark.createDataFrame(rows, "path string, text string")).collect()
    assert [(r.number, r.title, r.status, r.date) for r in got] == [
        (2, "Use it", "Accepted", "2024-05-06"), (10, "old way", "Proposed", ""),
    ]


def test_registry_json(spark, tmp_path):
    path = tmp_path / "rules.json"
    assert readers.scan_registry_json(spark, str(path)).count() == 0
    path.write_text(json.dumps([{"identifier": "A-001", "name": "n", "module": "m"}, {"identifier": "A-002", "name": "o", "module": "m", "priority": "High"}]))
    rows = readers.scan_registry_json(spark, str(path)).orderBy("identifier").collect()
    assert [(r.version, r.priority, r.status, r.dependencies) for r in rows] == [
        ("1.0", "Medium", "Active", []), ("1.0", "High", "Active", []),
    ]


def test_commit_log(spark, tmp_path):
    path = tmp_path / "log.txt"
    path.write_text("abc\tfix: a\tb\n\n def\tplain\nnone\n")
    rows = readers.scan_commit_log(spark, str(path)).collect()
    assert [(r.commit_hash, r.subject) for r in rows] == [("abc", "fix: a\tb"), ("def", "plain"), ("none", "")]


def test_search_results(spark):
    entries = [None, {"id": ""}, {"id": "a", "url": "a", "title": ""}, {"id": "b", "webpage_url": "http://z", "title": "B"}]
    df = spark.createDataFrame([("s", json.dumps(entries)), ("t", "broken")], "session string, entries string")
    rows = readers.normalise_search_results(df, canonical="https://v/").collect()
    assert [(r.source_reference, r.title, r.url) for r in rows] == [("a", "a", "https://v/a"), ("b", "B", "http://z")]


def test_csv_export(spark, tmp_path):
    columns = ", ".join(
        f"{c} {'array<string>' if c == 'options' else 'string'}" for c in writers.QUESTION_FIELDS
    )
    row = tuple(["x", "y"] if c == "options" else c for c in writers.QUESTION_FIELDS)
    out = str(tmp_path / "csv")
    writers.export_csv(spark.createDataFrame([row], columns), out)
    back = spark.read.csv(out, header=True).first()
    assert back.options == "x | y"
    assert list(back.asDict()) == list(writers.QUESTION_FIELDS)
