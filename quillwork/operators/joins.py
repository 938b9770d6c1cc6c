"""Lookups, nesting, range and anti joins.

No side is hinted for broadcast: Catalyst and AQE broadcast a side only when its
measured size is below `spark.sql.autoBroadcastJoinThreshold`, and AQE splits
the partitions of a hot key otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillwork.functions.text import basename
from quillwork.operators.ordered import last, number_rows
from quillwork.operators.patterns import names_inside
from quillwork.session import materialise

BLOCK_ROWS = 1_000


def parents_with_child_count(parents: DataFrame, children: DataFrame, on: str) -> DataFrame:
    """Parents that have children, with their number, newest first.

    Children are counted before the join, so a hot parent costs one row.
    """
    counts = children.groupBy(on).agg(F.count(F.lit(1)).alias("children"))
    return parents.join(counts, on).orderBy(F.desc(on))


def enrich_left(df: DataFrame, lookup: DataFrame, on: str, value: str, default: str = "") -> DataFrame:
    """Add `value` of the lookup row, `default` where there is none."""
    found = df.join(lookup.select(on, value), on, "left")
    return found.withColumn(value, F.coalesce(value, F.lit(default)))


def breadcrumbs(nodes: DataFrame, key: str = "document_id") -> DataFrame:
    """Add `breadcrumb`: titles of the ancestors named by `path`, outermost first.

    Only nodes that are somebody's ancestor take part in the lookup, and paths
    are resolved once per distinct parent path, not once per node.
    """
    ids = F.filter(F.split("path", "/"), lambda x: x != "")
    ancestors = F.transform(F.slice(ids, 1, F.greatest(F.size(ids) - 1, F.lit(0))), lambda x: x.cast("long"))
    nodes = nodes.withColumn("__up", F.array_join(ancestors, "/"))
    paths = nodes.filter("__up <> ''").select(key, "__up").distinct()
    steps = paths.select(key, "__up", F.posexplode(F.split("__up", "/")).alias("__at", "__id"))
    steps = steps.withColumn("__id", F.col("__id").cast("long"))
    titles = nodes.select(key, F.col("id").alias("__id"), F.col("title").alias("__title"))
    named = steps.join(titles, [key, "__id"])
    trail = F.transform(
        F.array_sort(F.collect_list(F.struct("__at", "__title"))), lambda x: x["__title"]
    )
    trails = named.groupBy(key, "__up").agg(trail.alias("breadcrumb"))
    empty = F.array().cast("array<string>")
    joined = nodes.join(trails, [key, "__up"], "left").drop("__up")
    return joined.withColumn("breadcrumb", F.coalesce("breadcrumb", empty))


def nest_children(
    parents: DataFrame,
    children: DataFrame,
    on: Sequence[str],
    order: str,
    fields: Sequence[str],
    part_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Parents with an ordered array of their children, empty when none.

    A parent with more than `part_rows` children comes as several rows, told
    apart by `part`: no array grows with the data.
    """
    rows = number_rows(children, on, [F.col(order)], "__p")
    part = F.floor(F.col("__p") / part_rows).cast("long")
    item = F.struct(F.col("__p"), *fields)
    items = F.transform(
        F.array_sort(F.collect_list(item)), lambda x: F.struct(*[x[f].alias(f) for f in fields])
    )
    nested = rows.df.groupBy(*on, part.alias("part")).agg(items.alias("children"))
    joined = parents.join(nested, list(on), "left")
    empty = F.array().cast(nested.schema["children"].dataType)
    return joined.withColumns(
        {"part": F.coalesce("part", F.lit(0)), "children": F.coalesce("children", empty)}
    )


def asof_page_join(
    elements: DataFrame, bookmarks: DataFrame, key: str = "document_id", root: int = 0
) -> DataFrame:
    """Add `section_id`: the last bookmark on or before the element's page, else root.

    Bookmarks (key, page, order_index, id) and elements are merged into one
    sequence, and the latest bookmark is carried forward. Columns stay columns, so
    that those nobody asks for are not sorted along.
    """
    kept = [f for f in elements.schema.fields if f.name not in (key, "section_id")]
    marks = bookmarks.select(
        key, F.col("page").alias("__page"), F.lit(0).alias("__kind"), F.col("order_index").alias("__o"),
        F.col("id").alias("__mark"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in kept],
    )
    rows = elements.select(
        key, F.col("page").alias("__page"), F.lit(1).alias("__kind"), F.col("order_index").alias("__o"),
        F.lit(None).cast("long").alias("__mark"), *[f.name for f in kept],
    )
    order = [F.col("__page"), F.col("__kind"), F.col("__o")]
    merged = number_rows(marks.unionByName(rows), [key], order, "__p")
    found = merged.scan(section_id=last(F.col("__mark"))).df.filter("__kind = 1")
    same = F.col(key).cast(elements.schema[key].dataType).alias(key)
    names = [same if c == key else c for c in elements.columns if c != "section_id"]
    return found.select(*names, F.coalesce("section_id", F.lit(root)).alias("section_id"))


def insert_missing(target: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Target plus the incoming rows whose key it lacks."""
    fresh = incoming.join(target.select(key), key, "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True)


def entitlement_join(users: DataFrame, role_permissions: DataFrame) -> DataFrame:
    """Users (user_id, role_id, is_superuser) with their sorted `permissions`.

    A superuser holds `*`; no role means none. Codes are gathered per role, of
    which there are few, not per user.
    """
    codes = role_permissions.groupBy("role_id").agg(
        F.array_sort(F.collect_set("permission")).alias("__codes")
    )
    empty = F.array().cast("array<string>")
    held = F.when(F.col("is_superuser"), F.array(F.lit("*"))).otherwise(F.coalesce("__codes", empty))
    return users.join(codes, "role_id", "left").withColumn("permissions", held).drop("__codes")


def holders_of(entitled: DataFrame, permission: str) -> DataFrame:
    """Users who may use `permission`."""
    codes = F.col("permissions")
    return entitled.filter(F.array_contains(codes, "*") | F.array_contains(codes, permission))


EXTERNAL = r"^(http://|https://|mailto:)"


def local_links(docs: DataFrame, path: str, targets: Column) -> DataFrame:
    """One row per document and non-empty target inside the repository."""
    rows = docs.select(F.col(path).alias("path"), F.explode(targets).alias("link"))
    return rows.filter((F.col("link") != "") & ~F.col("link").rlike(EXTERNAL))


def _clean_path(c: Column) -> Column:
    """Resolve `.` and `..` segments of a relative path."""
    steps = F.filter(F.split(c, "/"), lambda s: ~s.isin("", "."))
    kept = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(
            F.array_append(acc, s)
        ),
    )
    return F.array_join(kept, "/")


def broken_links(links: DataFrame, existing: DataFrame) -> DataFrame:
    """Links (path, link) that exist neither beside their document nor at the root."""
    folder = F.regexp_replace("path", r"[^/]*$", "")
    rows = links.withColumns(
        {
            "__near": _clean_path(F.concat(folder, F.lit("/"), F.col("link"))),
            "__root": _clean_path(F.col("link")),
        }
    )
    known = existing.select(_clean_path(F.col("path")).alias("__known")).distinct()
    for candidate in ("__near", "__root"):
        rows = rows.join(known.withColumnRenamed("__known", candidate), candidate, "left_anti")
    return rows.select("path", "link")


# Documents nobody has to link.
ENTRY_DOCS = (
    "INDEX.md", "README.md", "CHANGELOG.md", "VERSION.md", "RELEASE_NOTES.md",
    "PROJECT_STATUS.md",
)


def orphan_docs(docs: DataFrame, links: DataFrame, keep: Sequence[str] = ENTRY_DOCS) -> DataFrame:
    """Documents whose file name is the target of no link."""
    named = docs.withColumn("__name", basename(F.col("path")))
    target = basename(F.replace(F.ltrim(F.col("link")), F.lit("\\"), F.lit("/")))
    linked = links.select(target.alias("__name")).distinct()
    loose = named.filter(~F.col("__name").isin(list(keep)))
    return loose.join(linked, "__name", "left_anti").drop("__name")


def missing_docs(names: DataFrame, docs: DataFrame, texts: Sequence[str]) -> DataFrame:
    """Names (column `name`) found inside none of the `texts` of any document, whatever the case.

    One pass over the texts with an automaton of the names; see `patterns`. Empty and
    null names are not wanted, a repeated name stays repeated.
    """
    wanted = names.filter("name <> ''").withColumn("__token", F.lower("name"))
    bodies = docs.select(*[F.lower(F.col(t)).alias(f"__t{i}") for i, t in enumerate(texts)])
    found = names_inside(wanted.select(F.col("__token").alias("token")), bodies)
    return wanted.join(found.withColumnRenamed("token", "__token"), "__token", "left_anti").drop("__token")


def detect_changed(current: DataFrame, probed: DataFrame, key: str = "book_code") -> DataFrame:
    """Downloaded rows with a new signature become `update_available`; a probe that repeats counts once."""
    seen = probed.groupBy(key).agg(F.max("version_hash").alias("__new"))
    changed = (
        F.col("downloaded")
        & (F.col("__new") != "")
        & (F.col("version_hash") != "")
        & (F.col("__new") != F.col("version_hash"))
    )
    status = F.when(changed, "update_available").otherwise(F.col("status"))
    return current.join(seen, key, "left").withColumn("status", status).drop("__new")


def route_by_prefix(
    df: DataFrame, path: str, groups: Mapping[str, Sequence[str]], default: str = "chore"
) -> DataFrame:
    """Add `group`: the first configured group with a prefix that is the path or a parent of it."""
    c, chosen = F.col(path), []
    for group, prefixes in groups.items():
        for prefix in prefixes:
            inside = F.startswith(c, F.lit(prefix.rstrip("/") + "/"))
            chosen.append(F.when((c == prefix) | inside, group))
    return df.withColumn("group", F.coalesce(*chosen, F.lit(default)))


def grant_all(permissions: DataFrame, role_id) -> DataFrame:
    """One role with every permission: the role is a constant, so no join."""
    return permissions.select(F.lit(role_id).alias("role_id"), *permissions.columns)


FARTHEST = 1 << 52  # cells from zero, beyond which all cells count as one
LEVEL_BITS = 3  # a level's intervals are so many times doubled from the level below


def _cell(c: Column, height: float) -> Column:
    """Whole number of the band that a coordinate lies in; keeps the order, NaN last as in comparisons."""
    at = F.floor(F.least(F.greatest(c / F.lit(height), F.lit(-float(FARTHEST))), F.lit(float(FARTHEST))))
    return F.when(F.isnan(c.cast("double")), F.lit(FARTHEST)).otherwise(at.cast("long"))


def points_outside_boxes(
    blocks: DataFrame, boxes: DataFrame, on: Sequence[str], cell: float = 64.0
) -> DataFrame:
    """Blocks whose centre lies in no box of the same page; edges count as inside.

    Bands of height `cell` are the leaves of dyadic intervals. A box is filed under the
    intervals of one level that cover it, the lowest whose intervals are as high as the
    box: two at most, whatever its height. A centre is in one interval of every level
    that boxes use, so each level is an equi join on (page, interval) of the centres
    that are still free, and only boxes about as high as the interval meet there.
    Boxes without an extent or with a null edge hold nothing; a block with a null edge
    is in no box.
    """
    middle = lambda a, b: (F.col(a) + F.col(b)) / 2
    edges = ("x0", "y0", "x1", "y1")
    filed = boxes.select(*on, *[F.col(c).alias(f"__{c}") for c in edges]).where("__x0 <= __x1 and __y0 <= __y1")
    low, high = _cell(F.col("__y0"), cell), _cell(F.col("__y1"), cell)
    # the small addition makes up for a logarithm that is rounded down
    level = F.ceil((F.log2(high - low + 1) + 0.01) / LEVEL_BITS) * LEVEL_BITS
    level = F.when(high > low, level).otherwise(0).cast("int")
    filed = filed.withColumns({"__low": low, "__high": high, "__level": level})
    covering = F.array_distinct(F.array(F.expr("shiftright(__low, __level)"), F.expr("shiftright(__high, __level)")))
    filed = materialise(filed.withColumn("__band", F.explode(covering)).drop("__low", "__high"))
    # one row for each level, of which there are few
    levels = sorted(r[0] for r in filed.select("__level").distinct().collect())

    left = blocks.withColumns({"__x": middle("x0", "x1"), "__y": middle("y0", "y1")})
    within = F.col("__x").between(F.col("__x0"), F.col("__x1")) & F.col("__y").between(
        F.col("__y0"), F.col("__y1")
    )
    for at in levels:
        p = left.withColumn("__at", F.shiftright(_cell(F.col("__y"), cell), at)).alias("p")
        b = filed.where(F.col("__level") == at).alias("b")
        condition = F.col("p.__at") == F.col("b.__band")
        for c in on:
            condition = condition & (F.col(f"p.{c}") == F.col(f"b.{c}"))
        left = p.join(b, condition & within, "left_anti").drop("__at")
    return left.drop("__x", "__y")


def selected_members(df: DataFrame, listed: DataFrame, key: str, parent: str, parent_id) -> DataFrame:
    """Listed rows that belong to the given parent."""
    return df.filter(F.col(parent) == parent_id).join(listed.select(key), key, "left_semi")
