"""Near-duplicate documents by MinHash with tensored banding.

Two collections of `SIDE` half keys are made, each half key from `PART` minhashes.
A table key is a pair of one half key from either collection, so 2 * SIDE * PART
minhashes serve SIDE * SIDE tables. Two sets of similarity s meet in a table
unless all half keys of one collection differ: at s = 0.75 that has probability
2 * (1 - 0.75 ** PART) ** SIDE, which is 0.0003 for the defaults.

Sets that are equal are one class from the start. Only half keys that two classes
share are combined into table keys, which leaves out most of the corpus. In a
table, every member is compared with one representative, so a group of copies
costs one comparison per member, and then with the one that shares most of its
shingles with others. Members that are still in different groups are compared with
each other, unless the shingles that they share with any other such set are too few
for a link: a copy with many changes of its own is left out by that, and no possible
link is. Every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm.components import components
from quillwork.llm.hashing import MinHasher, combine, set_digest, signed, text_chunks, text_shingles
from quillwork.session import materialise

PART = 3
SIDE = 16
SIMILARITY = 75  # per cent of intersection over union


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))


def sketches(df: DataFrame, key: str, text: str, part: int = PART, side: int = SIDE) -> DataFrame:
    """(id, n_shingles, one, two, halves) of every row.

    `one` and `two` name the set of distinct shingles; `halves` holds the half keys
    of the left, then of the right collection, none for a text without words.
    """
    hasher = MinHasher(2 * side * part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_chunks(batch.column(1)):
                grams, first = text_shingles(data, offsets)
                mins = hasher(grams, first)
                keys = np.stack([combine(mins[:, k * part : (k + 1) * part], k) for k in range(2 * side)], axis=1)
                full = np.diff(first) > 0
                sets = [np.unique(grams[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                names = np.array([set_digest(s) for s in sets], np.uint64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, end - row),
                        pa.array([s.size for s in sets], pa.int64()),
                        pa.array(signed(names[:, 0].copy())),
                        pa.array(signed(names[:, 1].copy())),
                        pa.ListArray.from_arrays(
                            _offsets(np.where(full, 2 * side, 0)), pa.array(signed(keys[full].reshape(-1)))
                        ),
                    ],
                    names=["id", "n_shingles", "one", "two", "halves"],
                )

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")).mapInArrow(
        run, f"id {kind}, n_shingles long, one long, two long, halves array<long>"
    )


def shingle_sets(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, grams): the sorted distinct shingle hashes of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_chunks(batch.column(1)):
                grams, first = text_shingles(data, offsets)
                sets = [np.unique(grams[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                flat = np.concatenate([np.empty(0, np.uint64), *sets])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, end - row),
                        pa.ListArray.from_arrays(
                            _offsets(np.array([s.size for s in sets], np.int64)), pa.array(signed(flat))
                        ),
                    ],
                    names=["id", "grams"],
                )

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")).mapInArrow(
        run, f"id {kind}, grams array<long>"
    )


def tables_of(classes: DataFrame, side: int = SIDE) -> DataFrame:
    """(bucket, id): table keys of classes whose two half keys are both shared with another class."""
    halves = classes.select("id", F.posexplode("halves").alias("pos", "half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    kept = halves.join(shared, "half", "left_semi").groupBy("id").agg(
        F.collect_list(F.when(F.col("pos") < side, F.col("half"))).alias("left"),
        F.collect_list(F.when(F.col("pos") >= side, F.col("half"))).alias("right"),
    )  # at most `side` keys each
    combined = kept.select("id", "right", F.explode("left").alias("l")).select("id", "l", F.explode("right").alias("r"))
    return combined.select(F.xxhash64("l", "r").alias("bucket"), "id")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """Pairs (a, b) whose full sets reach the similarity."""
    left = sets.select(F.col("id").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("grams").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    small, large = F.least(F.size("x"), F.size("y")), F.greatest(F.size("x"), F.size("y"))
    both = both.where(100 * small >= percent * large)  # else the sizes alone decide
    common = F.size(F.array_intersect("x", "y"))
    return (
        both.select("a", "b", common.alias("common"), (F.size("x") + F.size("y")).alias("total"))
        .where(100 * F.col("common") >= percent * (F.col("total") - F.col("common")))
        .select("a", "b")
    )


def _apart(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """(bucket, id, group) of buckets whose members are in more than one component."""
    names = found.select(F.col("node").alias("id"), F.col("component").alias("group_"))
    named = buckets.join(names, "id", "left").select("bucket", "id", F.coalesce("group_", "id").alias("group_"))
    named = materialise(named)
    mixed = (
        named.groupBy("bucket")
        .agg(F.min("group_").alias("low"), F.max("group_").alias("high"))
        .where("low <> high")
        .select("bucket")
    )
    return materialise(named.join(mixed, "bucket", "left_semi"))


def _shared_sizes(ids: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, n, u): size of each set, and how many of its shingles another of these sets has."""
    grams = sets.join(ids, "id", "left_semi").select("id", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    common = grams.groupBy("gram").agg(F.count("*").alias("sets")).where("sets > 1").select("gram")
    return grams.join(common, "gram", "left_semi").groupBy("id", "n").agg(F.count("*").alias("u"))


def near_links(buckets: DataFrame, sets: DataFrame, percent: int = SIMILARITY) -> DataFrame:
    """Verified links (a, b), enough to connect all that a chain of links in the buckets connects."""
    heads = buckets.groupBy("bucket").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
    pairs = buckets.join(heads.select("bucket", "a"), "bucket").where("id <> a").select("a", F.col("id").alias("b"))
    tested = materialise(pairs.distinct())
    links = materialise(verified(tested, sets, percent))
    apart = _apart(buckets, components(links))
    if apart.isEmpty():
        return links
    # two sets have no more in common than either shares with any other set
    bounds = materialise(_shared_sizes(apart.select("id").distinct(), sets))
    bounds = bounds.where(100 * F.col("u") >= percent * F.col("n"))
    # the member that shares most of itself is the likeliest to be near to the others
    able = apart.join(bounds, "id")
    middle = able.groupBy("bucket").agg(F.max_by(F.struct("id", "group_"), F.struct(F.col("u") / F.col("n"), "id")).alias("top"))
    pairs = able.join(middle, "bucket").where(F.col("group_") != F.col("top.group_"))
    pairs = pairs.select(F.least("id", "top.id").alias("a"), F.greatest("id", "top.id").alias("b")).distinct()
    fresh = materialise(pairs.join(tested, ["a", "b"], "left_anti"))
    tested = tested.union(fresh)
    links = links.union(materialise(verified(fresh, sets, percent)))
    able = materialise(_apart(buckets, components(links)).join(bounds, "id"))
    if able.isEmpty():
        return links
    own = able.groupBy("id").agg(F.collect_list("bucket").alias("buckets"))  # one for each table at most
    able = materialise(able.join(own, "id"))
    one, two = able.alias("one"), able.alias("two")
    most = F.least("one.u", "two.u")
    reach = 100 * most >= percent * (F.col("one.n") + F.col("two.n") - most)
    same = (F.col("one.bucket") == F.col("two.bucket")) & (F.col("one.id") < F.col("two.id"))
    # a pair is taken up in the first bucket that it shares
    once = F.col("one.bucket") == F.array_min(F.array_intersect("one.buckets", "two.buckets"))
    pairs = one.join(two, same & (F.col("one.group_") != F.col("two.group_")) & reach & once)
    pairs = pairs.select(F.col("one.id").alias("a"), F.col("two.id").alias("b")).distinct()
    fresh = materialise(pairs.join(tested, ["a", "b"], "left_anti"))
    return links.union(materialise(verified(fresh, sets, percent)))


def near_duplicates(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    percent: int = SIMILARITY,
    part: int = PART,
    side: int = SIDE,
) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row of `df`.

    Texts are linked if 100 * |intersection| >= percent * |union| of their sets of
    five-word shingles. A text without words has no shingles and no link; it and a
    null text are kept, as their own component. Every row is returned; a key that
    repeats is one node, so its rows with other texts may join components. A row with
    a null key links with nothing: null component, kept. Other columns are left out.
    """
    rows = materialise(sketches(df, key, text, part, side))
    # equal sets form a class under its smallest key
    named = rows.where("id is not null and n_shingles > 0")
    same_set = ["n_shingles", "one", "two"]
    classes = materialise(named.groupBy(*same_set).agg(F.min("id").alias("rep")))
    heads = named.join(classes.withColumnRenamed("rep", "id"), [*same_set, "id"], "left_semi")
    buckets = materialise(tables_of(heads.dropDuplicates([*same_set, "id"]), side).distinct())
    multiple = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    buckets = materialise(buckets.join(multiple, "bucket", "left_semi"))
    texts = df.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    wanted = buckets.select("id").distinct()
    sets = materialise(shingle_sets(texts.join(wanted, "id", "left_semi"), "id", "text"))
    found = materialise(components(near_links(buckets, sets, percent)))
    out = rows.select("id", *same_set).join(classes, same_set, "left")
    out = out.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "rep")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(
        F.col("id").alias(key),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
