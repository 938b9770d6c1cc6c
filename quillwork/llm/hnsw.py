"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard.

Vectors of a label are dealt to shards of bounded size, and every shard gets a graph.
Every vector is looked up in every shard of its label, many vectors at a time. The
beam of a lookup widens until it reaches beyond the wanted similarity; an audit then
compares some lookups of every shard with all its vectors, and the starting beam is
doubled until enough of the links are found. Cosines are taken in double precision
from the vectors themselves. Equal vectors are one vector with a count, so copies are
neither compared nor linked one by one. A task returns numbers of links, and of the
links only a forest that connects what they connect.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm.components import components
from quillwork.session import materialise

COSINE = 0.93
SHARD = 20_000  # different vectors of a label that one graph holds
BLOCK = 1_000  # vectors that are looked up in a graph with one beam
TURN = 16  # blocks, at most, that share one copy of a graph
COPIED = 32_768  # vectors that a beam holds copies of at once
LINKS = 16  # neighbours of a node, twice as many on the lowest level
BUILD_BEAM = 64
BEAM = 64
AUDITED = 40  # lookups of a task that are compared with brute force
RECALL = 0.995
TASK = ("space", "part", "turn")  # a graph and the blocks that are looked up in one copy of it


class Graph:
    """Levels of neighbour lists over unit vectors; built in batches of growing size."""

    def __init__(self, vectors: np.ndarray, seed: int = 5) -> None:
        self.x = vectors
        n = len(vectors)
        levels = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int), 6)
        if n:
            levels[0] = levels.max()  # the first node is on all levels, and the way in
        self.levels = levels
        self.near = [np.full((n, 2 * LINKS if k == 0 else LINKS), -1, np.int32) for k in range(int(levels.max()) + 1 if n else 0)]
        done = 1
        while done < n:
            size = min(max(1, done // 2), 512, n - done)
            self._add(np.arange(done, done + size))
            done += size

    def _add(self, new: np.ndarray) -> None:
        """Link a batch of nodes with those before it and with each other."""
        x = self.x[new]
        inner = x @ x.T
        np.fill_diagonal(inner, -2)
        entry = np.zeros((len(new), 1), np.int32)
        for level in range(len(self.near) - 1, -1, -1):
            on = self.levels[new] >= level
            found, score = self.beam(x, entry, BUILD_BEAM if on.any() else 1, level)
            entry = found[:, :1]
            if not on.any():
                continue
            batch = np.flatnonzero(on)
            peers = np.broadcast_to(new[batch], (len(batch), len(batch)))
            ids = np.concatenate([found[batch], peers], axis=1)
            close = np.concatenate([score[batch], inner[np.ix_(batch, batch)]], axis=1)
            close[ids < 0] = -2
            width = self.near[level].shape[1]
            chosen = self._spread(ids, close, LINKS)
            self.near[level][new[batch], : chosen.shape[1]] = chosen
            self._link_back(new[batch], chosen, level, width)

    def _spread(self, ids: np.ndarray, close: np.ndarray, most: int) -> np.ndarray:
        """Up to `most` neighbours per row: the nearest, leaving out those nearer to a chosen one, then the nearest left."""
        take = min(ids.shape[1], 3 * most)
        order = np.argsort(-close, axis=1, kind="stable")[:, :take]
        ids, close = np.take_along_axis(ids, order, 1), np.take_along_axis(close, order, 1)
        vectors = self.x[np.maximum(ids, 0)]
        between = np.einsum("nad,nbd->nab", vectors, vectors)
        kept = np.zeros(ids.shape, bool)
        for k in range(ids.shape[1]):
            hidden = (kept[:, :k] & (between[:, k, :k] > close[:, k : k + 1])).any(axis=1)
            kept[:, k] = ~hidden & (close[:, k] > -2) & (kept[:, :k].sum(axis=1) < most)
        rank = np.where(close <= -2, 2, np.where(kept, 0, 1)) * ids.shape[1] + np.arange(ids.shape[1])
        order = np.argsort(rank, axis=1)[:, :most]
        chosen = np.take_along_axis(ids, order, 1)
        chosen[np.take_along_axis(close, order, 1) <= -2] = -1
        return chosen

    def _link_back(self, new: np.ndarray, chosen: np.ndarray, level: int, width: int) -> None:
        table = self.near[level]
        source = np.repeat(new, chosen.shape[1])
        target = chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, start, count = np.unique(target, return_index=True, return_counts=True)
        most = int(count.max()) if count.size else 0
        if not most:
            return
        extra = np.full((nodes.size, most), -1, np.int32)
        extra[np.repeat(np.arange(nodes.size), count), np.arange(target.size) - np.repeat(start, count)] = source
        ids = np.concatenate([table[nodes], extra], axis=1)
        close = np.einsum("nkd,nd->nk", self.x[np.maximum(ids, 0)], self.x[nodes])
        # a node may be named from both sides
        ordered = np.sort(ids, axis=1)
        if (ordered[:, 1:] == ordered[:, :-1])[ordered[:, 1:] >= 0].any():
            place = np.argsort(ids, axis=1, kind="stable")
            twice = np.zeros(ids.shape, bool)
            again = np.take_along_axis(ids, place, 1)
            np.put_along_axis(twice, place[:, 1:], again[:, 1:] == again[:, :-1], 1)
            ids = np.where(twice, -1, ids)
        close[ids < 0] = -2
        full = (ids >= 0).sum(axis=1) > width
        table[nodes[~full]] = np.take_along_axis(ids, np.argsort(-close, axis=1, kind="stable")[:, :width], 1)[~full]
        if full.any():
            table[nodes[full]] = self._spread(ids[full], close[full], width)

    def beam(self, queries: np.ndarray, entry: np.ndarray, width: int, level: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines), best first, of a beam search of every query from its entry nodes; -1 fills up."""
        table = self.near[level]
        rows = np.arange(len(queries))[:, None]
        seen = np.zeros((len(queries), len(self.x)), bool)
        ids = np.full((len(queries), width), -1, np.int32)
        score = np.full((len(queries), width), -3.0)
        ids[:, : entry.shape[1]] = entry[:, :width]
        seen[rows, np.maximum(entry, 0)] = True
        score[:, : entry.shape[1]] = np.where(entry >= 0, np.einsum("nkd,nd->nk", self.x[np.maximum(entry, 0)], queries), -3)[:, :width]
        open_ = ids >= 0
        live = np.arange(len(queries))
        ahead = max(1, width // 32)  # a wide beam follows several nodes at once
        while live.size:
            live = live[open_[live].any(axis=1)]
            if not live.size:
                break
            at = np.where(open_[live], score[live], -4)
            pick = at.argmax(axis=1)[:, None] if ahead == 1 else np.argpartition(-at, ahead - 1, axis=1)[:, :ahead]
            going = np.take_along_axis(open_[live], pick, 1)
            open_[live[:, None], pick] = False
            near = np.where(going[:, :, None], table[np.maximum(ids[live[:, None], pick], 0)], -1).reshape(live.size, -1)
            if ahead > 1:
                near.sort(axis=1)
                near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            fresh = (near >= 0) & ~seen[live[:, None], np.maximum(near, 0)]
            seen[np.repeat(live, near.shape[1])[fresh.ravel()], near[fresh]] = True
            close = np.full(near.shape, -3.0)
            close[fresh] = self._cosines(near[fresh], queries, np.repeat(live, near.shape[1])[fresh.ravel()])
            all_ids = np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1)
            all_score = np.concatenate([score[live], close], axis=1)
            all_open = np.concatenate([open_[live], fresh], axis=1)
            order = np.argsort(-all_score, axis=1, kind="stable")[:, :width]
            ids[live] = np.take_along_axis(all_ids, order, 1)
            score[live] = np.take_along_axis(all_score, order, 1)
            open_[live] = np.take_along_axis(all_open, order, 1)
        return ids, score

    def _cosines(self, ids: np.ndarray, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Cosines of nodes with the query in each row; a wide beam asks for many, so vectors are copied for some at a time."""
        out = np.empty(len(ids))
        for i in range(0, len(ids), COPIED):
            part = slice(i, i + COPIED)
            out[part] = np.einsum("kd,kd->k", self.x[ids[part]], queries[rows[part]])
        return out

    def within(self, queries: np.ndarray, cosine: float, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, cosines) of at least `cosine` for every query.

        A beam that is full of such vectors is doubled, up to all vectors of the graph.
        """
        out: list = [None] * len(queries)
        todo = np.arange(len(queries))
        entry = np.zeros((len(queries), 1), np.int32)
        for level in range(len(self.near) - 1, 0, -1):
            entry = self.beam(queries, entry, 1, level)[0]
        while todo.size:
            width = min(width, max(len(self.x), 1))
            wide = []
            # lookups together as their beams and marks have room
            for i in range(0, todo.size, max(1, min(500, 4_000_000 // (width + len(self.x) + 1)))):
                part = todo[i : i + max(1, min(500, 4_000_000 // (width + len(self.x) + 1)))]
                ids, score = self.beam(queries[part], entry[part], width)
                for q, row, close in zip(part, ids, score, strict=True):
                    hit = (close >= cosine) & (row >= 0)
                    if hit.all() and width < len(self.x):
                        wide.append(q)
                    else:
                        out[q] = (row[hit], close[hit])
            todo = np.array(wide, np.int64)
            width *= 2
        return out


SLACK = 1e-9  # cosines this near the limit are taken again from the vectors as they are


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of rows, in double precision."""
    return np.einsum("nd,nd->n", a, b) / np.sqrt(np.einsum("nd,nd->n", a, a) * np.einsum("nd,nd->n", b, b))


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def shard_links(graph: Graph, vectors: np.ndarray, queries: np.ndarray, cosine: float) -> list[np.ndarray]:
    """Rows of the shard that each query links with: graph lookups, widened until the audit passes."""
    units = _units(queries)
    audited = np.linspace(0, len(queries) - 1, min(AUDITED, len(queries))).astype(int)
    truth = [np.flatnonzero(units[q] @ graph.x.T >= cosine) for q in audited]
    width = BEAM
    while True:
        found = graph.within(units[audited], cosine, width)
        hits = sum(np.isin(t, f[0]).sum() for t, f in zip(truth, found, strict=True))
        if hits >= RECALL * sum(len(t) for t in truth) or width >= len(graph.x):
            break
        width *= 2
    out = []
    for q, (ids, close) in enumerate(graph.within(units, cosine - SLACK, width)):
        unsure = np.abs(close - cosine) <= SLACK
        if unsure.any():
            exact = cosines(np.broadcast_to(queries[q], (unsure.sum(), queries.shape[1])), vectors[ids[unsure]])
            close = close.copy()
            close[unsure] = exact
        out.append(ids[close >= cosine])
    return out


def _forest(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Pairs that join what was not joined by those before."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for a, b in pairs:
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _table(ids: pa.Array, copies: pa.Array, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, copies, vectors) by id, so that a graph does not depend on the order of rows."""
    names = ids.to_numpy(zero_copy_only=False)
    order = np.argsort(names, kind="stable")
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return names[order], copies.to_numpy(zero_copy_only=False)[order], flat.reshape(len(names), -1)[order]


def _graphs(df: DataFrame) -> DataFrame:
    """(space, part, blocks, graph) from (space, part, blocks, rows): the graph of a shard with its vectors, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, copies, vectors = _table(*batch.column(3)[row].values.flatten())
                body = pickle.dumps((ids, copies, vectors, Graph(_units(vectors))))
                named = [batch.column(k).slice(row, 1) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*named, pa.array([body], pa.binary())], names=["space", "part", "blocks", "graph"])

    return df.mapInArrow(run, "space long, part long, blocks long, graph binary")


def _lookup(graphs: DataFrame, asked: DataFrame, cosine: float) -> DataFrame:
    """(a, b, n, edge) from (*TASK, graph) and (*TASK, block, id, copies, v): counted links of a, and a forest of links (a, b) per block."""

    def run(graph: pa.Table, asked: pa.Table) -> pa.Table:
        out = [pa.table({"a": [], "b": [], "n": [], "edge": []}, schema)]
        if not graph.num_rows or not asked.num_rows:
            return out[0]
        ids, copies, vectors, index = pickle.loads(graph["graph"][0].as_buffer())  # noqa: S301  written by _graphs
        for block in np.unique(asked["block"].to_numpy()):
            part = asked.filter(pc.equal(asked["block"], block)).combine_chunks()
            own, _, wanted = _table(*[part[c].chunk(0) for c in ("id", "copies", "v")])
            found = shard_links(index, vectors, wanted, cosine)
            links = [int(copies[f].sum()) for f in found]
            edges = _forest((int(q), int(ids[k])) for q, f in zip(own, found, strict=True) for k in f if ids[k] != q)
            a = np.array([e[0] for e in edges] + own.tolist(), np.int64)
            b = np.array([e[1] for e in edges] + [-1] * len(own), np.int64)
            n = np.array([0] * len(edges) + links, np.int64)
            edge = np.array([True] * len(edges) + [False] * len(own))
            out.append(pa.table({"a": a, "b": b, "n": n, "edge": edge}, schema))
        return pa.concat_tables(out)

    schema = pa.schema({"a": pa.int64(), "b": pa.int64(), "n": pa.int64(), "edge": pa.bool_()})
    return graphs.groupBy(*TASK).cogroup(asked.groupBy(*TASK)).applyInArrow(run, "a long, b long, n long, edge boolean")


def near_vectors(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE,
    shard: int = SHARD, block: int = BLOCK,
) -> DataFrame:
    """(key, n_links, component_id, kept) of every row.

    Vectors link if their labels are equal and not null and their cosine reaches
    `cosine`. A vector that is null, empty or zero, or holds a null or a non-finite
    component, links with nothing; vectors of different lengths do not link. Rows that
    repeat a key count as vectors of their own, but are one node of the components.
    A null key links with nothing, has a null component and is kept. Other columns
    are left out.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(
        F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").alias("label"),
        F.col(f"`{vector}`").cast("array<double>").alias("v"),
    )
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    sound = F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(sound, F.lit(False))
    # equal vectors of a label are one, under the smallest key; -0.0 is 0.0
    rows = rows.withColumn("v", F.when(sound, F.transform("v", lambda x: x + F.lit(0.0))))
    digest = F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256)
    rows = rows.select("id", "label", "v", F.size("v").alias("size"), F.when(F.col("v").isNotNull(), digest).alias("name"))
    rows = materialise(rows)
    same = ["label", "size", "name"]
    classes = materialise(
        rows.where("name is not null")
        .groupBy(*same)
        .agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))
    )
    spark = df.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts, blocks = F.ceil(F.col("n") / F.lit(shard)), F.ceil(F.col("n") / F.lit(block))
    counts = classes.groupBy("label", "size").agg(F.count("*").alias("n")).withColumns({"parts": parts, "blocks": blocks})
    # every block meets every graph of its label; a graph is copied for `turn` blocks, so that there is work for all tasks
    meetings = counts.agg(F.sum(F.col("parts") * F.col("blocks"))).first()[0] or 0
    turn = min(TURN, -(-meetings // (4 * tasks)) or 1)
    dealt = classes.join(counts, ["label", "size"]).select(
        F.xxhash64("label", "size").alias("space"), "parts", "blocks",
        F.pmod(F.xxhash64("name"), F.col("parts")).alias("part"),
        F.pmod(F.xxhash64("name", F.lit(1)), F.col("blocks")).alias("block"),
        F.col("rep").alias("id"), "copies", "v",
    )
    # about `shard` vectors in each list
    shards = dealt.groupBy("space", "part", "blocks").agg(F.collect_list(F.struct("id", "copies", "v")).alias("rows"))
    graphs = materialise(_graphs(shards.select("space", "part", "blocks", "rows")))
    turns = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("blocks") / F.lit(turn)) - 1)
    copied = graphs.withColumn("turn", F.explode(turns)).select(*TASK, "graph")
    asked = dealt.withColumns({"part": F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)), "turn": F.floor(F.col("block") / F.lit(turn))})
    asked = asked.select(*TASK, "block", "id", "copies", "v")
    found = materialise(_lookup(copied.repartition(tasks, *TASK), asked.repartition(tasks, *TASK), cosine))
    totals = found.where("not edge").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    joined = components(found.where("edge").select("a", "b")).withColumnRenamed("node", "rep")
    out = rows.select("id", *same).join(classes.select(*same, "rep"), same, "left")
    out = out.join(totals, "rep", "left").join(joined, "rep", "left")
    component = F.coalesce("component", "rep", "id")
    return out.select(
        F.col("id").cast(kind).alias(key),
        # a vector is found in its own shard too
        F.coalesce(F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.cast(kind).alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
