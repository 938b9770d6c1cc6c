"""Row selection, search, paging and top-k."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillwork.functions.text import strip
from quillwork.operators.ordered import number_rows
from quillwork.operators.paging import PAGE_LIMIT as PAGE_LIMIT
from quillwork.operators.paging import PageIndex, checked, total_order

SHALLOW = 10_000  # rows before a page that are gathered with it


def _all(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _any(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def filter_optional_eq(df: DataFrame, **wanted) -> DataFrame:
    """Equality on every given column; None, '' and 'all' ask for nothing."""
    given = {c: v for c, v in wanted.items() if v not in (None, "", "all")}
    return df.filter(_all(F.col(c) == F.lit(v) for c, v in given.items()))


def wildcard(query: str) -> str:
    """LIKE pattern for a substring; `%` and `_` stay wildcards, a backslash is itself."""
    return f"%{query.lower()}%".replace("\\", "\\\\")


def search_contains(df: DataFrame, cols: Sequence[str], query: str, literal: bool = False) -> DataFrame:
    """Case-insensitive substring in any of `cols`.

    `%` and `_` in the query act as wildcards unless `literal`.
    """
    needle = query.lower()
    if literal:
        return df.filter(_any(F.contains(F.lower(F.col(c)), F.lit(needle)) for c in cols))
    return df.filter(_any(F.lower(F.col(c)).like(wildcard(query)) for c in cols))


def filter_sessions(
    df: DataFrame,
    status: str | None = None,
    topic: str | None = None,
    date_from: str | None = None,
    date_to: str | None = None,
    provider: str | None = None,
    source_type: str | None = None,
    strict_end: bool = False,
) -> DataFrame:
    """Sessions matching every given condition, newest id first.

    The end day counts in full. With `strict_end` a bare end date stands for its
    midnight, which leaves the day itself out.
    """
    conditions = []
    if topic:
        conditions.append(F.lower("input_value").like(wildcard(topic)))
    if date_from:
        conditions.append(F.col("created_at") >= F.lit(date_from).cast("timestamp"))
    if date_to and strict_end:
        conditions.append(F.col("created_at") <= F.lit(date_to).cast("timestamp"))
    elif date_to:
        after = F.date_add(F.lit(date_to).cast("date"), 1).cast("timestamp")
        conditions.append(F.col("created_at") < after)
    exact = {"status": status, "provider": provider, "source_type": source_type}
    matched = filter_optional_eq(df, **exact).filter(_all(conditions))
    return matched.orderBy(F.desc("id"))


def filter_in(df: DataFrame, col: str, values: Sequence | DataFrame) -> DataFrame:
    """Rows whose `col` is listed; a DataFrame of values becomes a semi join."""
    if isinstance(values, DataFrame):
        return df.join(values.select(F.col(values.columns[0]).alias(col)), col, "left_semi")
    return df.filter(F.col(col).isin(list(values))) if len(values) else df.filter(F.lit(False))


def children_of(df: DataFrame, parent, col: str = "parent_id") -> DataFrame:
    """Direct children; `None` asks for the top level."""
    return df.filter(F.col(col).eqNullSafe(F.lit(parent)))


def visible_frames(
    df: DataFrame,
    question_only: bool = False,
    hide_duplicates: bool = False,
    with_text: bool = False,
) -> DataFrame:
    conditions = []
    if question_only:
        conditions.append(F.col("is_question"))
    if hide_duplicates:
        conditions.append(~F.col("is_duplicate"))
    if with_text:
        conditions.append(strip(F.col("ocr_text")) != "")
    return df.filter(_all(conditions))


def slice_elements(df: DataFrame, page: int | None = None, kind: str | None = None) -> DataFrame:
    picked = filter_optional_eq(df, page=page, element_type=kind)
    return picked.orderBy("document_id", "order_index")


def missing_or_present(df: DataFrame, present: bool, flag: str = "downloaded") -> DataFrame:
    return df.filter(F.col(flag) if present else ~F.col(flag))


def status_gate(df: DataFrame, status: str, col: str = "status") -> tuple[DataFrame, DataFrame]:
    """(rows in the required state, the others)."""
    ready = F.coalesce(F.col(col) == status, F.lit(False))
    return df.filter(ready), df.filter(~ready)


def uniqueness_check(
    incoming: DataFrame, existing: DataFrame, key: str
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a key already present is rejected."""
    taken = existing.select(key)
    return incoming.join(taken, key, "left_anti"), incoming.join(taken, key, "left_semi")


def page(
    df: DataFrame, order: Sequence[Column], key: str | Sequence[str], limit: int = 50, offset: int = 0
) -> DataFrame:
    """One page in a total order (`key` breaks ties) with the count before paging.

    The rows before the page are gathered with it, so a deep page is read from a
    `PageIndex`: both give the same rows. A limit outside 1 to `PAGE_LIMIT`, or a
    negative offset, is an error.
    """
    checked(limit, offset)
    if offset > SHALLOW:
        return PageIndex.of(df, order, key).page(limit, offset)
    found = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = df.orderBy(*total_order(order, key)).offset(offset).limit(limit)
    return rows.withColumn("total", found)


def newest(df: DataFrame, n: int = 20, col: str = "id") -> DataFrame:
    return df.orderBy(F.desc(col)).limit(n)


def search_topk(nodes: DataFrame, query: str, limit: int) -> DataFrame:
    """First matches among all nodes but roots, in reading order."""
    hits = search_contains(nodes.filter(F.col("node_type") != "root"), ["title", "content"], query)
    return hits.orderBy("document_id", "order_index").limit(limit)


def first_n_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int
) -> DataFrame:
    """First `n` rows of each group.

    Spark keeps only n rows per group and task ahead of the shuffle when the
    rank is filtered directly, so a hot group never travels whole.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")


def sort_ci(df: DataFrame, *cols: str) -> DataFrame:
    """Order by the lower-cased columns."""
    return df.orderBy(*[F.lower(c) for c in cols])


def subsample_even(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    cap: int | None = None,
    largest: int | None = None,
) -> DataFrame:
    """At most `cap` evenly spaced rows per key, the first row included.

    Cap None or 0 sets no limit. A row at position p of n stays
    when p is the integer part of i * n / cap for some i. `largest` is an upper
    bound of n, if known.
    """
    if not cap or cap < 0:
        return df
    rows = number_rows(df, keys, order, "__p", largest)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    p, step = F.col("__p"), F.col("__n") / F.lit(float(cap))
    # the only i that can land on p: the nearest ones to p / step
    near = F.floor(p / step)
    hit = _any(
        (F.floor((near + d) * step) == p) & (near + d >= 0) & (near + d < cap) for d in (-1, 0, 1, 2)
    )
    joined = rows.df.join(sizes, list(keys))
    return joined.filter((F.col("__n") <= cap) | hit).select(*df.columns)
