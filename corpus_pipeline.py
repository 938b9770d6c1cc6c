"""From raw documents to token ids: five stages, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir), docs with the columns of `documents`, and
is written and read again before the next, so a lost executor costs a part of one
stage at most. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm import bpe, minhash, mixing, quality, suffixes
from quillwork.llm.queries import WORD_VOCABULARY, held_out, table
from quillwork.session import materialise

REJECT_BELOW = 0.5  # probability of good quality
LANGUAGE_WEIGHTS = {"en": 0.55, "fr": 0.18, "de": 0.17, "es": 0.10}  # shares of the tokens aimed at


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels").where(~held_out()))
    score = _free_name(docs, "score")
    scored = quality.score_quality(docs, model, name=score)
    return scored.where(F.col(score) >= REJECT_BELOW).select(*[F.col(f"`{c}`") for c in docs.columns])


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """`docs` with a long that tells different texts under one id apart, called `name`; null without an id.

    It is the id itself for one text of an id, and a number above 2^62 for its others, of which there are few.
    """
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    several = docs.where("doc_id is not null").select("doc_id", text.alias("h")).distinct().groupBy("doc_id")
    several = several.agg(F.min("h").alias("least"), F.count("*").alias("n")).where("n > 1")
    several = materialise(several.select(F.col("doc_id").alias("id"), "least"))
    if several.isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long"))
    late = F.shiftrightunsigned(F.xxhash64("doc_id", text), 2) + F.lit(1 << 62)
    several = several.select(F.col("id").alias(f"{name}_id"), F.col("least").alias(f"{name}_least"))
    keyed = docs.join(several, F.col("doc_id") == F.col(f"{name}_id"), "left")
    number = F.when(text != F.col(f"{name}_least"), late).otherwise(F.col("doc_id").cast("long"))
    return materialise(keyed.withColumn(name, number).drop(f"{name}_id", f"{name}_least"))


def _free_name(docs: DataFrame, name: str) -> str:
    """`name`, longer where `docs` has such a column."""
    taken = {c.lower() for c in docs.columns}
    while any(c.startswith(name) for c in taken):
        name += "_"
    return name


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; rows that repeat an id and its text count as one.

    Different texts under one id are documents of their own. Rows without an id stay.
    """
    node = _free_name(docs, "node")
    named = _numbered(docs.where("doc_id is not null"), node)
    kept = minhash.near_duplicates(named.select(node, "text"), node).where("kept").select(node).distinct()
    once = named.join(kept, node, "left_semi").dropDuplicates([node])
    return once.select(*[F.col(f"`{c}`") for c in docs.columns]).union(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 100-byte strings that an earlier document, or an earlier place, has.

    Of different texts under one id, one stands in the id's place and the others come after all ids.
    """
    key = _free_name(docs, "key")
    cut = suffixes.drop_repeats(_numbered(docs, key), key).drop(key)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of languages wants them, each at least once.

    Memberships are learnt from the labelled documents. Without any, the documents stay as they are.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id").distinct()
    labelled = mixing.labelled_sample(docs, labels).select("text", F.col("lang").alias("domain")).where("domain is not null")
    labelled = materialise(labelled)
    if labelled.isEmpty():
        return docs
    model = mixing.fit_domains(labelled)
    weights = mixing.known_weights(LANGUAGE_WEIGHTS, model)
    if not weights:
        return docs
    return mixing.apply_mixture(docs, mixing.mix_to_targets(docs, model, weights, low=1.0))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with digests of the ids and of the decoded text."""
    return bpe.encode_digests(docs, WORD_VOCABULARY, ids=True)


STAGES = [
    ("quality classifier", drop_poor),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources to target weights", mix_languages),
    ("BPE encoding and decoding", encode),
]

ORACLE_SQL = None  # no stage but the second has a form in SQL; tests hold each against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of `sf_dir`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
