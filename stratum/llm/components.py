"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

#: Edges up to which one task finishes the work. Contraction brings every graph there.
LAST_EDGES = 1 << 18


def least_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the least one that the edges ``a``, ``b`` connect it with."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [batch for batch in batches if batch.num_rows]
    if parts:
        table = pa.Table.from_batches(parts)
        both = pa.chunked_array([*table.column(0).chunks, *table.column(1).chunks])
        nodes = pc.take(both.unique(), pc.sort_indices(both.unique()))
        code = pc.index_in(both, nodes).to_numpy().astype(np.int64)
        root = least_of(len(nodes), code[: table.num_rows], code[table.num_rows :])
        yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(root))], ["node", "component"])


def connected_components(edges: DataFrame, last_edges: int = LAST_EDGES) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its least node.

    In each round every node hooks to the least of itself and its neighbours, and from there once more; the edges are
    contracted to the hooks' ends. Aggregations combine before the shuffle, so that a node with very many neighbours
    is no burden. A graph of up to ``last_edges`` edges, to which every graph shrinks, is finished by one task. Nothing
    is gathered on the driver but the number of edges. Nodes should be digests, or ids in no order along the edges:
    then the number of rounds grows with the logarithm of the longest path, while a path whose ids rise all along
    loses two nodes a round only.
    """
    kind = edges.schema["a"].dataType.simpleString()
    edges = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    rounds: list[DataFrame] = []
    while edges.count() > last_edges:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        hook = cut(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("up")))
        rounds.append(cut(hook.join(hook.select(F.col("node").alias("up"), F.col("up").alias("component")), "up").select("node", "component")))
        to_a, to_b = (rounds[-1].select(F.col("node").alias(x), F.col("component").alias(y)) for x, y in (("a", "x"), ("b", "y")))
        moved = edges.join(to_a, "a").join(to_b, "b").where("x <> y")
        fewer = cut(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        drop(edges, hook)
        edges = fewer
    found = cut(edges.repartition(1).mapInArrow(_finish, f"node {kind}, component {kind}"))
    drop(edges)
    for step in reversed(rounds):
        onward = found.select(F.col("node").alias("component"), F.col("component").alias("top"))
        whole = cut(step.join(onward, "component", "left").select("node", F.coalesce("top", "component").alias("component")))
        drop(step, found)
        found = whole
    return found
