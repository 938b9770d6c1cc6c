"""One registered query per operator, over whole tables, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm import alignment, bpe, hnsw, lm, minhash, mixing, paragraphs, periods, quality, rules, sharding, suffixes, templates

WORD_VOCABULARY = "word_bpe_49k.json"  # an installed vocabulary file, or a path on every executor

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORD_LISTS = r"""
    SELECT doc_id, coalesce(text, '') AS text,
           list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
    FROM documents
"""


@query(
    "op4_quality_rules",
    rf"""
    WITH w AS ({WORD_LISTS}),
    p AS (
        SELECT doc_id, i, list_aggregate(words[i:i + 4], 'string_agg', ' ') AS gram
        FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 4)) AS i FROM w)
    ),
    r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM p),
    c AS (
        SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words
        FROM r, (SELECT unnest(generate_series(0, 4)) AS j) WHERE n > 1 GROUP BY doc_id
    ),
    l AS (
        SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
    ),
    f AS (
        SELECT w.doc_id, len(words) AS n_words,
               length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
               length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
               coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
               length(regexp_replace(text, '\P{{Lu}}', '', 'g')) AS capitals
        FROM w LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)
    )
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
           NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > 2 * n_words
                OR 10 * capitals > 4 * word_chars OR 20 * n_dup_lines > n_words
                OR word_chars < 2 * n_words OR word_chars > 15 * n_words) AS kept
    FROM f
    """,
)
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, base verdict and verdict of the cascade for every document."""
    features = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    judged = rules.quality_cascade(table(spark, sf_dir, "documents").select("doc_id", "text"), features=features)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.select("doc_id", *features, failed.alias("base_failed"), "kept")


@query("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of tokens, and digests of the ids and of the decoded text, of every document."""
    return bpe.encode_digests(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


@query(
    "op9_minhash_near_dedup",
    r"""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(string_split_regex(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'
        ), lambda x: x <> '') AS words FROM documents
    ),
    s AS (
        SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS gram
        FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 4, least(len(words), 1)))) AS i FROM w)
    ),
    n AS (SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id),
    p AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
        FROM s AS a JOIN s AS b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
    ),
    l AS (
        SELECT a, b FROM p JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b
        WHERE 100 * common >= 75 * (x.n_shingles + y.n_shingles - common)
    ),
    r AS (
        SELECT doc_id AS node, doc_id AS root FROM documents
        UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node
    ),
    c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
    SELECT d.doc_id, coalesce(n_shingles, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM documents AS d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
    """,
)
def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the shingle set, component and whether it stays, of every document."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def held_out(key: str = "doc_id"):
    """Documents whose labels are never learnt from."""
    return F.crc32(F.col(key).cast("string")) % 3 == 1


@query("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated probability of label 1 for every document, learnt outside the held-out third."""
    documents, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality.fit_quality(documents, labels.where(~held_out()))
    scored = quality.score_quality(documents, model)
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


MIX_WEIGHTS = {"en/1": 0.45, "fr/1": 0.18, "de/1": 0.18, "es/1": 0.14, "en/0": 0.02, "fr/0": 0.01, "de/0": 0.01, "es/0": 0.01}


@query("op8_mixing")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, memberships, rate and copies of every document, for a mixture by language and quality label."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    domain = F.concat_ws("/", "lang", "quality")
    labelled = mixing.labelled_sample(documents, labels).select("text", domain.alias("domain"))
    model = mixing.fit_domains(labelled)
    mixture = mixing.mix_to_targets(documents, model, mixing.known_weights(MIX_WEIGHTS, model))
    most_likely = F.lit(None).cast("string")
    if model.domains:
        most_likely = F.element_at(F.lit(list(model.domains)), F.array_position("p", F.array_max("p")).cast("int"))
    return mixture.rates.select(
        "doc_id", "tokens", most_likely.alias("domain"), "p", "rate", mixing.copies_of(F.col("doc_id"), F.col("rate")).alias("copies")
    )


@query("op1_html_extraction")
def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return templates.extract_main_text(table(spark, sf_dir, "pages"))


@query("op5_suffix_array_dedup")
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without the 100-byte strings that also start earlier."""
    return suffixes.repeat_digests(table(spark, sf_dir, "documents"))


@query(
    "op7_hnsw_near_dedup",
    """
    WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
    l AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b
        ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
    ),
    r AS (
        SELECT vec_id AS node, vec_id AS root FROM v
        UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node
    ),
    c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
    n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM v JOIN c ON c.node = vec_id LEFT JOIN n ON n.a = vec_id
    """,
)
def op7_hnsw_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of links, component and whether it stays, of every vector."""
    return hnsw.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op6_lm_scoring")
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits a token of every document under models of good and of all documents, and their difference."""
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm.cross_entropy_difference(documents, good)
    return scored.select("doc_id", "n_tokens", "ce_target", "ce_background", "ce_difference")


@query("op2_substring_dedup")
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without passages that an earlier one has, and which ones those are."""
    cut = paragraphs.without_passages(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "first_docs")


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of periodically repeated words of every document, the strongest one, and what stays without repeats."""
    return periods.run_digests(table(spark, sf_dir, "documents"), arrange=periods.tail_repeated)


@query("op12_cross_tokenizer_alignment")
def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of two tokenizers over every document, with the links' corpus-wide counts."""
    return alignment.cross_tokens(table(spark, sf_dir, "documents")).withColumnRenamed("groups", "groups_sha256")


SHARDS = 16


@query("op13_sharding")
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; shards have nearly equal bytes, equal texts share one."""
    placed = sharding.even_shards(table(spark, sf_dir, "documents"), SHARDS)
    law, grown = F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)
