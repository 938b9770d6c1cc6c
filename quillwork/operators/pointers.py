"""Entries of the chunks of a split key by successor pointers and list ranking.

If a row is the last kept one, its successor, the first later row that is kept against
it, does not depend on what came before. Within a chunk all successors are found at
once and followed to the row they leave the chunk from (the exit). Exits look for their
successor in the chunks behind; chunks that would be dropped as a whole are skipped in
leaps of powers of two, told by summaries of so many chunks. Then the exits form lists
that only point forward, and pointer doubling marks those on the list that starts with
the known entry: its rounds grow with the logarithm of the number of chunks.
"""

from __future__ import annotations

from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillwork.operators.ordered import CHUNK
from quillwork.session import materialise

if TYPE_CHECKING:
    from quillwork.operators.folds import Rule

PATIENCE = 2  # chunks that are searched one by one before whole ones are skipped


def _exits(after: np.ndarray) -> np.ndarray:
    """Last index on the list of successors from each index."""
    n = len(after)
    out = np.arange(n)
    for i in range(n - 1, -1, -1):
        if after[i] < n:
            out[i] = out[after[i]]
    return out


def _summaries(chunks: DataFrame, keys: list[str], pos: str, value: str, rule: Rule) -> list[DataFrame]:
    """(keys, CHUNK, s): level l summarises the 2**l chunks from each chunk on, where there are so many."""
    from quillwork.operators.folds import in_order

    schema = T.StructType([*(chunks.schema[c] for c in [*keys, CHUNK]), T.StructField("s", rule.summary)])
    kind = to_arrow_schema(schema).field("s").type

    def summarise(table: pa.Table) -> pa.Table:
        values = rule.decode(in_order(table, pos).column(value))
        head = table.slice(0, 1).select([*keys, CHUNK])
        return head.append_column("s", pa.array([rule.summarise(values)], kind))

    levels = [materialise(chunks.groupBy(*keys, CHUNK).applyInArrow(summarise, schema))]
    most = levels[0].agg(F.max(CHUNK)).first()[0] or 0
    while 1 << len(levels) <= most + 1:
        half = levels[-1]
        behind = half.select(*keys, (F.col(CHUNK) - (1 << len(levels) - 1)).alias(CHUNK), F.col("s").alias("__b"))
        both = half.join(behind, [*keys, CHUNK])
        levels.append(materialise(both.select(*keys, CHUNK, rule.joined(F.col("s"), F.col("__b")).alias("s"))))
    return levels


def _leap(waiting: DataFrame, levels: list[DataFrame], keys: list[str], value: str, rule: Rule) -> DataFrame:
    """`waiting` moved on over all chunks that its value would drop as a whole, longest leaps first."""
    for k in range(len(levels) - 1, -1, -1):
        joined = waiting.join(levels[k], [*keys, CHUNK], "left")
        far = F.when(rule.drops_all(F.col(value), F.col("s")), F.lit(1 << k)).otherwise(0)
        waiting = joined.select(*keys, (F.col(CHUNK) + far).alias(CHUNK), "node", value)
    return waiting


def entries_by_pointers(
    chunks: DataFrame, keys: list[str], pos: str, value: str, rule: Rule, start: DataFrame
) -> DataFrame:
    """(keys, CHUNK, entry) of the chunks from `__from` on of every key in `start` (keys, __from, entry).

    The entry of chunk `__from` is given; chunks of a key are numbered without gaps.
    """
    from quillwork.operators.folds import entry_type, in_order

    on, carried = [*keys, CHUNK], entry_type(chunks, value)
    scope = chunks.select(*on, pos, value).join(start.select(*keys, "__from"), keys).where(F.col(CHUNK) >= F.col("__from"))
    pointed_schema = T.StructType(
        [*(chunks.schema[c] for c in on), T.StructField("__pos", T.LongType()), chunks.schema[value], T.StructField("__exit", T.LongType())]
    )

    def point(table: pa.Table) -> pa.Table:
        table = in_order(table, pos)
        places = table.column(pos).cast(pa.int64())
        out = _exits(rule.successors(rule.decode(table.column(value))))
        columns = [*(table.column(c) for c in on), places, table.column(value), places.take(pa.array(out))]
        return pa.table(columns, names=[*on, "__pos", value, "__exit"])

    pointed = materialise(scope.groupBy(*on).applyInArrow(point, pointed_schema))
    nodes = materialise(pointed.where("__exit = __pos").select(*on, F.col("__pos").alias("node"), value))
    # the known entry stands before all rows and looks for its successor in its own chunk
    first = start.select(*keys, F.col("__from").alias(CHUNK), F.lit(-1).cast("long").alias("node"), F.col("entry.v").alias(value))
    waiting = nodes.select(*keys, (F.col(CHUNK) + 1).alias(CHUNK), "node", value).unionByName(first)

    met_schema = T.StructType(
        [*(chunks.schema[c] for c in on), T.StructField("node", T.LongType()), chunks.schema[value], T.StructField("next", T.LongType())]
    )
    kinds = to_arrow_schema(met_schema)

    def meet(table: pa.Table, asking: pa.Table) -> pa.Table:
        """Those who ask in a chunk, with the exit that their successor leads to, null if it has none."""
        if not table.num_rows or not asking.num_rows:
            return kinds.empty_table()
        table = in_order(table, "__pos")
        values, exits, bases = rule.decode(table.column(value)), table.column("__exit").to_pylist(), rule.decode(asking.column(value))
        ends = []
        for i in range(asking.num_rows):
            at = rule.first(bases.base_at(i), values, 0)
            ends.append(exits[at] if at < len(values) else None)
        return asking.select([*on, "node", value]).append_column("next", pa.array(ends, pa.int64())).cast(kinds)

    jumps = None
    levels: list[DataFrame] = []
    turn = 0
    while True:
        if turn >= PATIENCE:
            levels = levels or _summaries(chunks.select(*on, pos, value).join(start.select(*keys), keys), keys, pos, value, rule)
            waiting = _leap(waiting, levels, keys, value, rule)
        asked = pointed.join(waiting.select(*on).distinct(), on, "left_semi")
        met = materialise(asked.groupBy(*on).cogroup(waiting.groupBy(*on)).applyInArrow(meet, met_schema))
        found = met.where("next is not null").select(*keys, "node", "next")
        jumps = found if jumps is None else jumps.unionByName(found)
        waiting = met.where("next is null").select(*keys, (F.col(CHUNK) + 1).alias(CHUNK), "node", value)
        turn += 1
        if waiting.isEmpty():
            break

    jumps = materialise(jumps)
    reached = materialise(start.select(*keys, F.lit(-1).cast("long").alias("node")))
    while not jumps.isEmpty():
        onward = reached.join(jumps, [*keys, "node"]).select(*keys, F.col("next").alias("node"))
        more = materialise(reached.unionByName(onward).distinct())
        ahead = jumps.select(*keys, F.col("node").alias("next"), F.col("next").alias("__then"))
        jumps = materialise(jumps.join(ahead, [*keys, "next"]).select(*keys, "node", F.col("__then").alias("next")))
        reached = more

    exits = nodes.join(reached, [*keys, "node"], "left_semi")
    item = F.when(F.col(value).isNotNull(), F.struct(F.col("node").alias("at"), F.col(value).alias("v"))).otherwise(
        F.lit(None).cast(carried)
    )
    left = exits.select(*on, F.struct(item.alias("e")).alias("exit"))
    ids = pointed.select(*on).distinct().join(left, on, "left")
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried_on = ids.withColumn("exit", F.last("exit", ignorenulls=True).over(before)).join(start, keys)
    entry = F.when(F.col("exit").isNull(), F.col("entry")).otherwise(F.col("exit.e")).cast(carried)
    return carried_on.select(*on, entry.alias("entry"))
