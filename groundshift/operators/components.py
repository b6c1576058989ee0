"""Connected components of an edge table by star contraction."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundshift.plans.scratch import join_hot, materialize

MAX_ROUNDS = 60
#: A node on which more edges hang is a hub: its edges meet its row in a broadcast, not in one task.
HUB_EDGES = 500
#: Edges that one task contracts at once.
TASK_EDGES = 500_000


def _contract(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Stars around the least node of each component of the edges."""
    nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        for end in (i, j):
            np.minimum.at(root, end, low)
            np.minimum.at(root, before[end], low)
        root = root[root]
        if (root == before).all():
            break
    off = root != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[off]), pa.array(nodes[root[off]])], names=["a", "b"])


def _contract_tasks(batches):
    """Replace the edges of each run of batches by stars; a run ends with ``TASK_EDGES`` edges or the task."""
    held, n = [], 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= TASK_EDGES:
            yield _contract(*map(np.concatenate, zip(*held, strict=True)))
            held, n = [], 0
    if held:
        yield _contract(*map(np.concatenate, zip(*held, strict=True)))


def _contracted(edges: DataFrame) -> tuple[DataFrame, bool]:
    """The edges contracted where they lie, then in tasks of about ``TASK_EDGES``; and whether one task held all, which settles them."""
    local = materialize(edges.mapInArrow(_contract_tasks, "a long, b long"), "edges")
    tasks = max(1, -(-local.count() // TASK_EDGES))
    stars = local.coalesce(tasks).mapInArrow(_contract_tasks, "a long, b long")
    return materialize(stars if tasks == 1 else stars.distinct(), "edges"), tasks == 1


def _lowest(edges: DataFrame) -> DataFrame:
    """(u, m): the least node that each node u with a smaller neighbour hangs on."""
    return edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))


def _large_star(edges: DataFrame, lowest: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the least of the node's neighbourhood.

    A node without a smaller neighbour is that least itself, so its edges stay as they are.
    """
    hung = edges.groupBy(F.col("b").alias("u")).agg(F.count(F.lit(1)).alias("n"))
    least = hung.join(lowest.hint("merge"), "u", "left")
    met = join_hot(edges.withColumn("u", F.col("b")), least, "u", f"n > {HUB_EDGES}")
    own = lowest.select(F.col("u").alias("a"), F.col("m").alias("b"))
    return met.select("a", F.coalesce("m", "b").alias("b")).union(own)


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the least of them; ``a`` is the larger end."""
    least = _lowest(edges)
    moved = edges.join(least.hint("merge"), F.col("a") == F.col("u")).where("b != m").selectExpr("b as a", "m as b")
    return moved.union(least.selectExpr("u", "m"))


def _settled(edges: DataFrame) -> bool:
    """All edges are stars: no node hangs on two, and none that hangs on one is hung on."""
    twice = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")
    chained = edges.join(edges.select(F.col("b").alias("r")).distinct().hint("merge"), F.col("a") == F.col("r"), "left_semi").select("a")
    return twice.union(chained).isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b); root is the component's least node.

    Edges with a null end and loops are left out. Edges are first contracted where they lie and in
    tasks of bounded size, then rounds of large and small stars follow until all edges are stars. Minima are aggregated
    before the shuffle; edges that hang on a hub meet its minimum where they lie (``join_hot``).
    """
    whole = edges.where("a is not null and b is not null and a != b").selectExpr("cast(greatest(a, b) as long) as a", "cast(least(a, b) as long) as b")
    edges, done = _contracted(whole)
    for _ in range(max_rounds):
        if done or _settled(edges):
            break
        lowest = materialize(_lowest(edges), "lowest")
        edges, done = _contracted(_small_star(_large_star(edges, lowest).distinct()))
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    stars = edges.selectExpr("a as node", "b as root")
    return stars.union(stars.selectExpr("root as node", "root").distinct())
