"""Corpus health, commit summaries and the document index."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.functions.text import (
    adr_fields,
    basename,
    commit_parts,
    doc_title,
    first_heading,
    frontmatter,
    infer_module,
    parse_conventional_commit,
)
from quillwork.operators.aggregates import changelog_sections, duplicate_groups, large_files
from quillwork.operators.filters import sort_ci
from quillwork.operators.joins import broken_links, missing_docs, orphan_docs
from quillwork.operators.sets import union_findings
from quillwork.sources.readers import scan_markdown_docs

# Section order and commit types.
SECTIONS = ("Added", "Changed", "Fixed", "Removed", "Deprecated", "Security", "Performance")
COMMIT_SECTIONS = {
    "feat": "Added", "add": "Added", "change": "Changed", "refactor": "Changed",
    "perf": "Performance", "fix": "Fixed", "bugfix": "Fixed", "remove": "Removed",
    "revert": "Removed", "deprecate": "Deprecated", "security": "Security",
    "breaking": "Changed",
}
DEFAULT_SECTION = "Changed"


def corpus_health(
    files: DataFrame, links: DataFrame, modules: DataFrame, limit_mb: int = 5
) -> DataFrame:
    """Findings of five checks over files (path, size, text), links and module names.

    A group of identical files gives one finding per further copy.
    """
    text = F.col("text")
    docs = files.select("path", "text")
    large = large_files(files, F.col("size"), limit_mb).select(
        F.col("path").alias("target"), "detail", F.lit("warning").alias("severity")
    )
    twins = duplicate_groups(docs, "path", text).filter(F.col("path") != F.col("first"))
    duplicate = twins.select(
        F.col("first").alias("target"),
        F.concat(F.lit("identical to: "), "path").alias("detail"),
        F.lit("warning").alias("severity"),
    )
    broken = broken_links(links, files.select("path")).select(
        F.col("path").alias("target"),
        F.concat(F.lit("missing target: "), "link").alias("detail"),
        F.lit("error").alias("severity"),
    )
    named = docs.select(basename(F.col("path")).alias("file"), first_heading(text).alias("heading"))
    missing = missing_docs(modules, named, ["file", "heading"]).select(
        F.col("name").alias("target"),
        F.lit("no documentation found for module").alias("detail"),
        F.lit("warning").alias("severity"),
    )
    orphan = orphan_docs(docs.select("path"), links).select(
        F.col("path").alias("target"),
        F.lit("not linked from any document").alias("detail"),
        F.lit("info").alias("severity"),
    )
    return union_findings(
        {
            "large": large, "duplicate": duplicate, "broken-link": broken,
            "missing-doc": missing, "orphan": orphan,
        }
    )


def classify_commits(
    commits: DataFrame, mapping: Mapping[str, str] = COMMIT_SECTIONS, default: str = DEFAULT_SECTION
) -> DataFrame:
    """Commits (seq, commit_hash, subject) with section, scope and summary."""
    parsed = parse_conventional_commit(F.col("__parts"), dict(mapping), default)
    rows = commits.withColumn("__parts", commit_parts(F.col("subject"))).withColumn("__c", parsed)
    return rows.select("seq", "commit_hash", "__c.section", "__c.scope", "__c.summary")


def commit_summary(commits: DataFrame, sections: Sequence[str] = SECTIONS) -> DataFrame:
    """Commit log -> sectioned change table with the printed `line`."""
    entries = changelog_sections(classify_commits(commits), sections)
    scope = F.when(F.col("scope") != "", F.concat(F.lit("**"), "scope", F.lit("**: "))).otherwise("")
    tail = F.when(F.col("commit_hash") != "", F.concat(F.lit(" ("), "commit_hash", F.lit(")")))
    line = F.concat(F.lit("- "), scope, "summary", F.coalesce(tail, F.lit("")))
    return entries.withColumn("line", line)


def doc_index(docs: DataFrame) -> DataFrame:
    """(path, relative, text) -> index rows sorted by module and title."""
    text, path = F.col("text"), F.col("path")
    meta = docs.withColumn("__meta", frontmatter(text))

    def field(name: str, default: str) -> Column:
        return F.coalesce(F.try_element_at("__meta", F.lit(name)), F.lit(default))

    rows = meta.select(
        infer_module(text, F.col("relative"), meta=F.col("__meta")).alias("module"),
        doc_title(text, path, F.col("__meta")).alias("document"),
        F.col("relative").alias("path"),
        field("version", "").alias("version"),
        field("status", "Draft").alias("status"),
        field("owner", "").alias("owner"),
        field("updated", "").alias("updated_date"),
    )
    return sort_ci(rows, "module", "document")


def build_doc_index(spark: SparkSession, path: str, exclude_trees: Sequence[str] = ()) -> DataFrame:
    return doc_index(scan_markdown_docs(spark, path, exclude_trees=exclude_trees))


def adr_index(docs: DataFrame) -> DataFrame:
    """Decision records by number; other files are left out."""
    rows = docs.withColumn("__a", adr_fields(F.col("path"), F.col("text")))
    return rows.select("__a.*", "path").filter("number is not null").orderBy("number")
