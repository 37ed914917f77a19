"""Connected components by alternating stars: every node ends at the least node of its component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.storage import Tables

#: A node with more than its share of all edges, `1 / HOT_SHARE` of them, is a hot one: at most
#: 2 x `HOT_SHARE` nodes are, whatever the graph, so their table may be broadcast.
HOT_SHARE = 128
HOT_EDGES = 1000
#: Links that one task may take at once, 2 MB of them; the passes are for more.
FEW = 1 << 17


def _with_least(ends: DataFrame, least: DataFrame, limit: int | None) -> DataFrame:
    """`ends` (u, v) with the `m` of u from `least` (u, m, degree): u and v swapped for v and m.

    No task gets all the edges of a hot node, as they are joined where they lie. Without `limit`
    there are too few edges for any."""
    if limit is None:
        return ends.join(least.select("u", "m"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    hot = F.broadcast(least.filter(F.col("degree") > limit).select("u", "m"))
    there = ends.join(hot.withColumnRenamed("m", "hot_m"), "u", "left")
    rest = there.filter("hot_m is null").join(least.filter(F.col("degree") <= limit).select("u", "m"), "u")
    return there.filter("hot_m is not null").select(F.col("v").alias("u"), F.col("hot_m").alias("v")).unionByName(rest.select(F.col("v").alias("u"), F.col("m").alias("v")))


def _large(edges: DataFrame, limit: int | None) -> DataFrame:
    """Hangs each node's larger neighbours on the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree")).select("u", F.least("u", "m").alias("m"), "degree")
    return _with_least(both.filter("v > u"), least, limit)


def _small(edges: DataFrame, limit: int | None) -> DataFrame:
    """Hangs each node and its smaller neighbours on the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
    return _with_least(down, least, limit).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v")


def _stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one other, which hangs on none."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("hangs"), F.lit(1).alias("holds"))
    )
    by_node = ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return by_node.filter("hangs > 1 or (hangs = 1 and holds = 1)").isEmpty()


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the least node that each reaches), of all nodes but those least ones."""
    nodes, ends = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        # A root hangs on the least root that it has a link with; then all hang on their roots.
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


def _at_once(edges: DataFrame, tables: Tables) -> DataFrame:
    """The components of at most `FEW` links (u, v), in one task."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if held:
            u, v = least_reached(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return tables.store(edges.select("u", "v").coalesce(1).mapInArrow(of, "u long, v long"))


def rooted(rows: DataFrame, name: str, graph: DataFrame, tables: Tables) -> DataFrame:
    """`rows` with the `root` that `graph` has for their node `name`, null for none."""
    at = graph.select(F.col("u").alias(name), F.col("v").alias("root"))
    return rows.join(F.broadcast(at) if tables.count(graph) <= FEW else at, name, "left")


def components(edges: DataFrame, tables: Tables | None = None) -> DataFrame:
    """(u, v) links -> (u, v) with v the least node that u reaches, for all u but those least ones.

    At most `FEW` links are taken by one task. For more, each pass is a few aggregations and joins over
    the links; none gathers a node's neighbours, and a hot node's links are not brought together for the
    join. The passes end when the links are stars around their least nodes.
    """
    tables = tables or Tables(edges.sparkSession)
    down = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = tables.store(down)
    total = tables.count(edges)
    if total <= FEW:
        return _at_once(edges, tables) if total else edges
    edges = tables.store(edges.distinct())
    total = tables.count(edges)
    limit = HOT_EDGES + total // HOT_SHARE if total > HOT_EDGES else None
    while total and not _stars(edges):
        edges = tables.store(_small(_large(edges, limit), limit).distinct())
    return edges


def merged(graph: DataFrame, links: DataFrame, tables: Tables) -> DataFrame:
    """The components of `graph`, which `components` gave, and more links: only the roots meet anew."""
    links = tables.store(links.select("u", "v"))
    if not tables.count(links):
        return graph
    if tables.count(graph) + tables.count(links) <= FEW:
        return _at_once(graph.unionByName(links), tables)

    def moved_to(df: DataFrame, name: str) -> DataFrame:
        return rooted(df, name, graph, tables).withColumn(name, F.coalesce("root", name)).drop("root")

    moved = components(moved_to(moved_to(links, "u"), "v"), tables).select(F.col("u").alias("v"), F.col("v").alias("_new"))
    if moved.isEmpty():
        return graph
    followed = graph.join(moved, "v", "left").select("u", F.coalesce("_new", "v").alias("v"))
    return tables.store(followed.unionByName(moved.select(F.col("v").alias("u"), F.col("_new").alias("v"))))
