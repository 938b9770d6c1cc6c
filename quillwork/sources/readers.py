"""Readers: binary corpora, archives, scripts, subtitles, Markdown, JSON, logs, tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillwork.functions.json import text_field
from quillwork.functions.text import (
    basename,
    class_label,
    language_of_code,
    split_lines,
    stem,
    strip,
    suffix,
    trailing_digits,
)
from quillwork.sources.files import can_open, file_checksums

# Accepted file types.
DOCUMENT_TYPES = (".pdf",)
VIDEO_TYPES = (
    ".mp4", ".mov", ".webm", ".mkv", ".avi", ".m4v", ".mpg", ".mpeg", ".ts", ".flv", ".gif",
)


WHOLE_BYTES = 64 << 20  # a larger file is never one value


def scan_binary_corpus(
    spark: SparkSession, path: str, types: Sequence[str] = DOCUMENT_TYPES, whole: int = WHOLE_BYTES
) -> DataFrame:
    """Non-empty files of the accepted types with name, stem, size and checksum.

    Files of more than `whole` bytes are hashed in pieces and have no content. In a store
    that only Spark can open every file is one value, at most 2 GB of it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not can_open(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()):
        return corpus_columns(files, types)
    small = corpus_columns(files.filter(F.col("length") <= whole), types)
    large = files.filter(F.col("length") > whole).filter(_accepted(types)).select("path", "length")
    hashed = large.mapInArrow(file_checksums, "path string, length long, checksum string")
    return small.unionByName(corpus_columns(hashed.withColumn("content", F.lit(None).cast("binary")), types))


def _accepted(types: Sequence[str]) -> Column:
    return suffix(F.col("path")).isin([t.lower() for t in types]) & (F.col("length") > 0)


def corpus_columns(files: DataFrame, types: Sequence[str]) -> DataFrame:
    """The same over any `binaryFile` DataFrame, batch or streaming; a `checksum` it has stays."""
    p = F.col("path")
    checksum = F.col("checksum") if "checksum" in files.columns else F.substring(F.sha2("content", 256), 1, 32)
    return files.filter(_accepted(types)).select(
        "path",
        basename(p).alias("name"),
        stem(p).alias("stem"),
        F.col("length").alias("size"),
        checksum.alias("checksum"),
        "content",
    )


HELD_BYTES = 8 << 20
HELD_ROWS = 1_000


def _pdfs(path: str, title: str, content: bytes | None) -> list[tuple]:
    """Rows of one file: the PDFs of an archive, or the PDF it is."""
    data = io.BytesIO(content)
    try:
        if zipfile.is_zipfile(data):
            with zipfile.ZipFile(data) as archive:
                names = [n for n in archive.namelist() if n.lower().endswith(".pdf")]
                latest = {n.rsplit("/", 1)[-1]: n for n in names}
                return [(path, title, s, archive.read(n), None) for s, n in latest.items()]
        return [(path, title, path.rsplit("/", 1)[-1], content, None)] if path.lower().endswith(".pdf") else []
    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, OSError) as exc:
        return [(path, title, None, None, str(exc))]


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One archive at a time is read; its rows wait for others until they are `HELD_BYTES`."""
    kind = pa.schema([(n, pa.binary() if n == "content" else pa.string()) for n in ("path", "book", "name", "content", "error")])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kind.types, strict=True)], schema=kind)

    out, held = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            for row in _pdfs(*(column[i].as_py() for column in batch.columns)):
                out.append(row)
                held += len(row[3] or b"")
                if held >= HELD_BYTES or len(out) >= HELD_ROWS:
                    yield batch_of(out)
                    out, held = [], 0
    if out:
        yield batch_of(out)


def explode_archive(files: DataFrame) -> DataFrame:
    """(path, title, content) -> one row per PDF in the archive, or the PDF itself.

    Members with the same base name overwrite each other, the last one stays. An
    archive that cannot be read gives one row with its `error`. Files come to Python in
    batches cut by their bytes (`configure`), and go back likewise.
    """
    schema = "path string, book string, name string, content binary, error string"
    members = files.select("path", "title", "content").mapInArrow(_members, schema)
    title = F.concat_ws(" — ", "book", stem(F.col("name")))
    return members.select(
        "path", "name", title.alias("title"), F.length("content").alias("size"),
        F.substring(F.sha2("content", 256), 1, 32).alias("checksum"), "content", "error",
    )


# Lines of a catalog script.
CONDITION = r'tclass\.value==(\d+).*?tsubject\.options\[sind\]\.text=="([^"]+)"'
TITLE = r'tbook\.options\[(\d+)\]\.text="([^"]*)"'
VALUE = r'tbook\.options\[(\d+)\]\.value="textbook\.php\?([a-z0-9]+)=0-(\d+)"'


def parse_catalog_script(pages: DataFrame, page: str = "page", text: str = "text") -> DataFrame:
    """Script pages -> books (code, class, subject, title, part, language).

    A condition line opens a block of one class and subject. Within a block a
    text line names an index and a value line turns an index into a book, if the
    index has a title by then. A code counts once per page, where first listed.
    """
    lines = pages.select(page, F.posexplode_outer(split_lines(F.col(text))).alias("pos", "__raw"))
    lines = lines.withColumn("__line", strip(F.col("__raw")))
    lines = lines.filter(~F.startswith("__line", F.lit("//")))
    get = lambda pattern, i: F.nullif(F.regexp_extract("__line", pattern, i), F.lit(""))
    opens = F.col("__line").rlike(CONDITION)
    lines = lines.select(
        page, "pos", opens.alias("__opens"),
        get(CONDITION, 1).alias("__class"), strip(get(CONDITION, 2)).alias("__subject"),
        F.when(~opens, get(TITLE, 1)).alias("__t_at"),
        F.nullif(strip(get(TITLE, 2)), F.lit("")).alias("__title"),
        F.when(~opens, get(VALUE, 1)).alias("__v_at"), get(VALUE, 2).alias("book_code"),
    ).filter("__opens or __t_at is not null or __v_at is not null")

    order = Window.partitionBy(page).orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = F.struct("pos", F.col("__class").alias("c"), F.col("__subject").alias("s"))
    lines = lines.withColumn("__block", F.last(F.when(F.col("__opens"), head), True).over(upto))

    named = lines.filter("__t_at is not null and __title is not null").select(
        page, "pos", "__block", F.col("__t_at").alias("at"), "__title", F.lit(None).cast("string").alias("book_code")
    )
    valued = lines.filter("__v_at is not null and __block is not null").select(
        page, "pos", "__block", F.col("__v_at").alias("at"), F.lit(None).cast("string").alias("__title"), "book_code"
    )
    both = named.unionByName(valued)
    # a line may hold a title and a value: the title counts first
    turn = F.col("book_code").isNotNull()
    per_index = Window.partitionBy(page, "__block.pos", "at").orderBy("pos", turn)
    per_index = per_index.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("title", F.last("__title", True).over(per_index))
    books = both.filter("book_code is not null and title is not null")
    firsts = books.groupBy(page, "book_code").agg(F.min_by(F.struct("pos", "__block", "title"), "pos").alias("b"))
    code = F.col("book_code")
    return firsts.select(
        page, "book_code",
        F.col("b.__block.c").alias("class_level"),
        class_label(F.col("b.__block.c")).alias("class_label"),
        F.coalesce("b.__block.s", F.lit("")).alias("subject"),
        F.col("b.title").alias("title"),
        trailing_digits(code).alias("part"),
        language_of_code(code).alias("language"),
    )


# What marks header and time lines of WebVTT.
CUE_HEADERS = ("WEBVTT", "Kind:", "Language:", "NOTE", "STYLE")
CUE_TIME = r"(?U)^\d{2}:\d{2}(:\d{2})?\.\d{3}\s+-->"


def subtitle_lines(text: Column) -> Column:
    """Spoken lines of a WebVTT text: headers, times, cue numbers and tags removed."""

    def spoken(line: Column) -> Column:
        header = F.lit(False)
        for start in CUE_HEADERS:
            header = header | F.startswith(line, F.lit(start))
        return (line != "") & ~header & ~line.rlike(CUE_TIME) & ~line.rlike(r"(?U)^\d+$")

    lines = F.filter(F.transform(split_lines(text), strip), spoken)
    bare = F.transform(lines, lambda x: strip(F.regexp_replace(x, "<[^>]+>", "")))
    return F.filter(bare, lambda x: x != "")


def first_spellings(lines: Column) -> Column:
    """Array -> array without items that repeat an earlier one up to case.

    Sorted by (lower case, position), a first spelling is an item whose
    predecessor has another key; sorting by position restores the order.
    """
    tagged = F.transform(lines, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("v")))
    ranked = F.sort_array(tagged)
    none = F.array(F.lit(None).cast("struct<k:string,i:int,v:string>"))
    pairs = F.arrays_zip(ranked.alias("a"), F.concat(none, ranked).alias("b"))
    fresh = F.filter(
        pairs,
        lambda p: p["a"].isNotNull() & (p["b"].isNull() | (p["a"]["k"] != p["b"]["k"])),
    )
    ordered = F.sort_array(F.transform(fresh, lambda p: F.struct(p["a"]["i"], p["a"]["v"].alias("v"))))
    return F.transform(ordered, lambda x: x["v"])


def subtitle_text(text: Column) -> Column:
    """WebVTT -> its distinct spoken lines in first-seen order."""
    return F.array_join(first_spellings(subtitle_lines(text)), "\n")


def scan_webvtt(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.vtt", recursiveFileLookup=True)
    return files.select(
        F.col("_metadata.file_path").alias("path"), subtitle_text(F.col("value")).alias("text")
    )


def scan_markdown_docs(
    spark: SparkSession,
    path: str,
    exclude_names: Sequence[str] = ("INDEX.md",),
    exclude_trees: Sequence[str] = (),
    pattern: str = "*.md",
) -> DataFrame:
    """(path, relative, text) of all Markdown files but the excluded ones; `pattern` is what their names look like."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=pattern, recursiveFileLookup=True)
    root = path.rstrip("/").removeprefix("file:")
    relative = F.substring_index(F.col("path"), root + "/", -1)
    docs = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    docs = docs.withColumn("relative", relative)
    docs = docs.filter(~basename(F.col("path")).isin(list(exclude_names)))
    for tree in exclude_trees:
        docs = docs.filter(~F.startswith("relative", F.lit(tree.strip("/") + "/")))
    return docs


REGISTRY_SCHEMA = (
    "identifier string, name string, module string, version string, priority string, "
    "status string, dependencies array<string>, description string, path string"
)
REGISTRY_DEFAULTS = {
    "version": "1.0", "priority": "Medium", "status": "Active", "description": "", "path": "",
}


def scan_registry_json(
    spark: SparkSession,
    path: str,
    schema: str = REGISTRY_SCHEMA,
    defaults: Mapping[str, str] = REGISTRY_DEFAULTS,
) -> DataFrame:
    """A JSON array of records with per-field defaults; no file gives no rows."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    rows = (
        spark.read.schema(schema).json(path, multiLine=True)
        if exists
        else spark.createDataFrame([], schema)
    )
    filled = {c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()}
    if "dependencies" in rows.columns:
        filled["dependencies"] = F.coalesce("dependencies", F.array().cast("array<string>"))
    return rows.withColumns(filled)


def parse_commit_log(lines: DataFrame, order: Column, limit: int | None = None) -> DataFrame:
    """`hash<TAB>subject` lines, newest first; blank lines dropped."""
    rows = lines.filter(strip(F.col("value")) != "")
    cut = F.split("value", "\t", 2)
    parsed = rows.withColumns(
        {
            "commit_hash": strip(cut.getItem(0)),
            "subject": F.coalesce(F.get(cut, F.lit(1)), F.lit("")),
        }
    ).orderBy(order)
    return parsed.limit(limit) if limit else parsed


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, value) of the lines of a file, or of the files of a folder by their names.

    Large files are read in pieces by many tasks. A piece numbers its own lines, and the
    lines of the pieces before it, of which only the counts are gathered, come on top.
    """
    lines = spark.read.text(path, lineSep="\n", recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__at"),
        "value",
    )
    piece = ["__file", "__block"]
    counts = lines.groupBy(*piece).count()
    # one row for each piece of a file; an order over all of them
    earlier = Window.orderBy(*piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*piece, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__start"))
    local = F.row_number().over(Window.partitionBy(*piece).orderBy("__at")) - 1
    placed = lines.withColumn("__local", local).join(starts, piece)
    return placed.select((F.col("__start") + F.col("__local")).alias("seq"), "value")


def scan_commit_log(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A log written newest first: a file, or a folder of files in the order of their names."""
    return parse_commit_log(numbered_lines(spark, path), F.asc("seq"), limit)


def scan_table(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """A typed table stored as parquet."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def normalise_search_results(
    df: DataFrame, entries: str = "entries", canonical: str = "https://www.youtube.com/watch?v="
) -> DataFrame:
    """JSON array of search hits -> source rows.

    Null entries and entries without an id are skipped. An address that is not
    http falls back to the canonical one, an empty title to the id.
    """
    parsed = F.coalesce(
        F.try_variant_get(F.try_parse_json(F.col(entries)), "$", "array<variant>"),
        F.array().cast("array<variant>"),
    )
    rows = df.select(*[c for c in df.columns if c != entries], F.posexplode(parsed).alias("rank", "__e"))
    e = F.col("__e")
    given = F.coalesce(F.nullif(text_field(e, "url"), F.lit("")), text_field(e, "webpage_url"))
    ident = text_field(e, "id")
    url = F.when(F.startswith(given, F.lit("http")), given).otherwise(F.concat(F.lit(canonical), ident))
    return rows.filter(ident != "").select(
        *[c for c in rows.columns if c != "__e"],
        ident.alias("source_reference"),
        F.coalesce(F.nullif(text_field(e, "title"), F.lit("")), ident).alias("title"),
        url.alias("url"),
    )
