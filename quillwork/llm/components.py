"""Connected components of an edge table, by alternating star contractions.

Both steps are a minimum per node (summed up before the shuffle) and a join back,
which Spark may split for a node with very many edges. Nothing is collected; each
round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.session import materialise

MOST_ROUNDS = 60


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    # each neighbour above u is handed to the smallest node around u
    joined = both.where("v > u").join(least, F.col("u") == F.col("w"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
    joined = edges.join(least, F.col("u") == F.col("w")).where("v <> m")
    moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with an edge to another; component is its smallest node.

    Nodes are of any orderable type. Repeated edges, either direction and loops are
    allowed; edges with a null end are left out. No edges give no rows.
    """
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("x"), F.col(b).alias("y"))
    edges = materialise(edges.where("x is not null and y is not null and u <> v").select("u", "v").distinct())
    before = None
    for _ in range(MOST_ROUNDS):
        mark = _mark(edges)
        if mark == before or mark[0] == 0:
            break
        before = mark
        edges = materialise(_small_star(_large_star(edges)))
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
