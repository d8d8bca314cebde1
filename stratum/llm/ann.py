"""Nearest neighbours by vantage-point trees, one for each shard of the vectors.

1. Equal vectors form one class, which keeps the few least ids that an answer can name.
2. Classes are dealt to the nearest of up to ``PIVOTS`` pivots; a pivot with many is dealt on into shards of a bounded
   size. In each shard a tree is built on the unit vectors: a node holds a vantage point and the median distance to it,
   and parts the rest into inside and outside.
3. All queries of a pivot, in blocks, walk the trees of its shards together. What they find there bounds the distance
   that still matters. With it they go on to the shards of those pivots that the triangle inequality doesn't rule out
   by the radius; in a tree a branch is skipped on the same ground. Both bounds are relaxed by ``factor``: 1 is exact,
   smaller factors prune more.
4. The shards' best are merged by class, and joined with the class's queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_key, cut, drop

LEAF = 256
#: Classes of a shard, at most about; a shard's tree is held in one task.
SHARD_ROWS = 4_096
#: Pivots, at most. They go to every task, so a pivot's classes are what grows with the input, not the pivots.
PIVOTS = 4_096
#: Queries that walk a tree together.
BLOCK_QUERIES = 512
#: Slack for rounding where distances are compared with bounds.
SLACK = 1e-7


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines in double precision of one query with each row, summed from the first component on.

    Powers of two are taken out first, which changes no digit, but keeps squares finite.
    """
    query = np.ldexp(query, -np.frexp(np.abs(query).max())[1])
    rows = np.ldexp(rows, -np.frexp(np.abs(rows).max(1))[1][:, None]) if len(rows) else rows
    dot, a, b = np.zeros(len(rows)), np.zeros(len(rows)), 0.0
    for j in range(rows.shape[1]):
        dot = dot + query[j] * rows[:, j]
        a = a + rows[:, j] * rows[:, j]
        b = b + query[j] * query[j]
    return np.clip(dot / np.sqrt(a * b), -1.0, 1.0)


def build(units: np.ndarray) -> list[tuple]:
    """Nodes of the tree over the rows of ``units``: (vantage row, median, inside node, outside node) or (rows,)."""
    nodes: list = []

    def add(rows: np.ndarray) -> int:
        at = len(nodes)
        nodes.append(None)
        if len(rows) <= LEAF:
            nodes[at] = (rows,)
            return at
        centre = units[rows].mean(0)
        vantage = rows[np.argmin(units[rows] @ centre)]  # far from the middle, where distances differ most
        rest = rows[rows != vantage]
        distance = np.sqrt(np.maximum(0, 2 - 2 * units[rest] @ units[vantage]))
        median = float(np.median(distance))
        inside = distance <= median
        if inside.all():  # all as far: no ball parts them
            nodes[at] = (rows,)
            return at
        low, high = add(rest[inside]), add(rest[~inside])
        nodes[at] = (vantage, median, low, high)
        return at

    add(np.arange(len(units)))
    return nodes


def search(units: np.ndarray, nodes: list[tuple], queries: np.ndarray, k: int, factor: float, bounds: np.ndarray | None = None) -> list[np.ndarray]:
    """For each query (unit rows) the rows that may be among its k nearest: the k best and those within rounding of them.

    Rows further than ``bounds`` don't matter.
    """
    best = np.full((len(queries), k), np.inf)
    if bounds is not None:
        best[:] = bounds[:, None]
    kept: list[list] = [[] for _ in queries]

    def visit(rows: np.ndarray, active: np.ndarray) -> None:
        distance = np.sqrt(np.maximum(0, 2 - 2 * queries[active] @ units[rows].T))
        near = distance <= best[active, -1][:, None] + SLACK
        for i in np.flatnonzero(near.any(1)):
            q, mine = active[i], np.flatnonzero(near[i])
            merged = np.sort(np.concatenate((best[q], distance[i, mine])))[:k]
            best[q] = merged
            fit = mine[distance[i, mine] <= merged[-1] + SLACK]
            kept[q].append((rows[fit], distance[i, fit]))

    def walk(at: int, active: np.ndarray) -> None:
        node = nodes[at]
        if len(node) == 1:
            visit(node[0], active)
            return
        vantage, median, low, high = node
        visit(np.array([vantage]), active)
        distance = np.sqrt(np.maximum(0, 2 - 2 * queries[active] @ units[vantage]))
        closer = distance <= median
        for first in (True, False):  # the likelier side first, the other only if it can hold something nearer
            for side, node_at in ((True, low), (False, high)):
                mine = closer == side if first else closer != side
                if not first:
                    gap = (distance - median) if side else (median - distance)
                    mine = mine & (gap <= factor * best[active, -1] + SLACK)
                if mine.any():
                    walk(node_at, active[mine])

    walk(0, np.arange(len(queries)))
    out = []
    for q, parts in enumerate(kept):
        rows = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        distance = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0)
        out.append(rows[distance <= best[q, -1] + SLACK])
    return out


def _units(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(1, keepdims=True)  # squares of very large or small components stay finite
    return scaled / np.sqrt((scaled * scaled).sum(1))[:, None]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


class Cells:
    """Pivots by the length of their vectors. Vectors of a length without pivot are one cell, numbered by it below 0."""

    def __init__(self, pivots: list[list[float]]):
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width in {len(p) for p in pivots}:
            numbers = [i for i, p in enumerate(pivots) if len(p) == width]
            self.of[width] = np.array(numbers), _units(np.array([pivots[i] for i in numbers], float))

    def distances(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the cells of this length, and the distance of each row to each of them."""
        numbers, pivots = self.of.get(units.shape[1], (np.array([-units.shape[1]]), None))
        return numbers, np.zeros((len(units), 1)) if pivots is None else np.sqrt(np.maximum(0, 2 - 2 * units @ pivots.T))


def _by_width(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length and their vectors, a few thousand at a time."""
    widths = column.value_lengths().to_numpy(zero_copy_only=False)
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        for low in range(0, len(rows), 2048):
            part = rows[low : low + 2048]
            yield part, _matrix(column.take(pa.array(part)), int(width))


def _dealt(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, vectors in _by_width(batch.column(2)):
                numbers, distance = shared.value.distances(_units(vectors))
                nearest = distance.argmin(1)
                part = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(numbers[nearest].astype(np.int32)), pa.array(distance[np.arange(len(rows)), nearest])], [*batch.schema.names, "cell", "far"])

    return run


def _onward(shared, reach: dict[int, tuple[int, float]], factor: float):
    """Queries (h1, h2, v, cell, bound), for each shard of another cell that may hold something nearer than the bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, bound = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            for rows, vectors in _by_width(batch.column(2)):
                numbers, distance = shared.value.distances(_units(vectors))
                radius = np.array([reach.get(int(c), (0, -np.inf))[1] for c in numbers])
                open_cells = (distance - radius <= factor * bound[rows][:, None] + SLACK) & (numbers != home[rows][:, None])
                row, cell = np.nonzero(open_cells)
                for low in range(0, len(row), 4096):
                    r, c = row[low : low + 4096], numbers[cell[low : low + 4096]]
                    shards = np.array([reach[int(x)][0] for x in c])
                    sub = np.arange(shards.sum()) - np.repeat(np.cumsum(shards) - shards, shards)
                    part = batch.take(pa.array(np.repeat(rows[r], shards)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(c, shards).astype(np.int32)), pa.array(sub.astype(np.int32)), *(part.column(i) for i in (0, 1, 2, 4))], ["cell", "sub", "h1", "h2", "v", "bound"])

    return run


_NEAR = pa.struct([("less", pa.float64()), ("vec_id", pa.int64()), ("own", pa.bool_())])


def _searched(k: int, factor: float):
    """Rows sorted by (cell, sub, asks): builds each shard's tree, then lets blocks of queries walk it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {"shard": None, "parts": [], "tree": None, "pending": []}

        def flush() -> Iterator[pa.RecordBatch]:
            if not state["pending"] or not state["parts"]:
                state["pending"] = []
                return
            if state["tree"] is None:
                keys, rows = (np.concatenate([p[i] for p in state["parts"]]) for i in range(2))
                units = _units(rows)
                state["tree"] = keys, rows, units, build(units), [x for p in state["parts"] for x in p[2]]
            keys, rows, units, nodes, ids = state["tree"]
            query_keys, queries, bounds = (np.concatenate([p[i] for p in state["pending"]]) for i in (0, 1, 3))
            state["pending"] = []
            near, kth = [], np.full(len(queries), np.inf)
            for q, found in enumerate(search(units, nodes, _units(queries), k, factor, bounds)):
                score = cosines(queries[q], rows[found])
                each = [(-float(s), i, bool((keys[f] == query_keys[q]).all())) for f, s in zip(found, score, strict=True) for i in ids[f]]
                each = sorted(each)[:k]
                near.append([dict(zip(("less", "vec_id", "own"), x, strict=True)) for x in each])
                if len(each) == k:
                    kth[q] = np.sqrt(max(0.0, 2 + 2 * each[-1][0]))
            yield pa.RecordBatch.from_arrays([pa.array(query_keys[:, 0]), pa.array(query_keys[:, 1]), pa.array(near, pa.list_(_NEAR)), pa.array(kth)], ["h1", "h2", "near", "kth"])

        for batch in batches:
            cell, sub, asks, h1, h2, bounds = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3, 4, 7))
            change = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (sub[1:] != sub[:-1]) | (asks[1:] != asks[:-1]))))
            for a, b in zip(change, np.append(change[1:], len(cell)), strict=True):
                if (cell[a], sub[a]) != state["shard"]:
                    yield from flush()
                    state.update(shard=(cell[a], sub[a]), parts=[], tree=None)
                vectors = batch.column(5).slice(a, b - a)
                part = (np.stack([h1[a:b], h2[a:b]], 1), _matrix(vectors, len(vectors[0])))
                if asks[a]:
                    for low in range(0, b - a, BLOCK_QUERIES):
                        some = slice(low, low + BLOCK_QUERIES)
                        state["pending"].append((part[0][some], part[1][some], None, bounds[a:b][some]))
                        if sum(len(p[0]) for p in state["pending"]) >= BLOCK_QUERIES:
                            yield from flush()
                else:
                    state["parts"].append((*part, batch.column(6).slice(a, b - a).to_pylist()))
        yield from flush()

    return run


def nearest(embeddings: DataFrame, is_query, k: int = 5, factor: float = 1.0, shard_rows: int = SHARD_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` nearest other rows by cosine, ties to the smaller vec_id.

    ``embeddings`` holds (vec_id, embedding); ``is_query`` is a column that says which rows are queries. Rows whose id
    or vector is null, and vectors that are empty, zero or hold null or non-finite components take no part; vectors are
    only compared with those of their own length, however many lengths there are. A row is its id and its vector: equal
    rows count once; rows that share an id, but not the vector, are others to each other, and each is a query of its
    own. Other columns are ignored; an empty table, or one without queries, gives no rows. Vectors are told apart by
    128 bits of hash.
    """
    spark = embeddings.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fine = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(fine & F.col("vec_id").isNotNull())
    rows = rows.select("vec_id", "asks", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(2), "v").alias("h2"))
    key = ["h1", "h2"]
    ids = cut(rows.groupBy(*key, "vec_id").agg(F.max("asks").alias("asks")))
    place = F.row_number().over(W.partitionBy(*key).orderBy("vec_id"))
    least = ids.withColumn("place", place).where(F.col("place") <= k + 1).groupBy(*key).agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = ids.where("asks").groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    classes = cut(rows.groupBy(*key).agg(F.first("v").alias("v")).join(least, key).join(asked, key, "left"))
    total = classes.count()
    chosen = classes.orderBy("h2", "h1").limit(max(1, min(pivots, total // shard_rows))).select("v").collect()
    shared = spark.sparkContext.broadcast(Cells([r.v for r in chosen]))
    kinds = "h1 bigint, h2 bigint, v array<double>, ids array<bigint>, n bigint, cell int, far double"
    table = cut(classes.mapInArrow(_dealt(shared), kinds))
    counted = table.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()  # pivots, and lengths without any
    reach = {r.cell: (-(-r.n // shard_rows), r.far) for r in counted}
    shards = spark.createDataFrame([(c, n) for c, (n, _) in reach.items()], "cell int, shards int")
    placed = table.join(F.broadcast(shards), "cell")
    none = F.lit(None).cast("array<bigint>").alias("ids")
    held = placed.select("cell", F.pmod("h1", "shards").cast("int").alias("sub"), F.lit(False).alias("asks"), *key, "v", "ids", F.lit(0.0).alias("bound"))
    at_home = placed.where("n IS NOT NULL").select("cell", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("sub"), F.lit(True).alias("asks"), *key, "v", none, F.lit(float("inf")).alias("bound"))

    def walked(asking: DataFrame) -> DataFrame:
        dealt = held.unionByName(asking).repartition(parts, "cell", "sub").sortWithinPartitions("cell", "sub", "asks")
        return dealt.mapInArrow(_searched(k + 1, factor), "h1 bigint, h2 bigint, near array<struct<less:double,vec_id:bigint,own:boolean>>, kth double")

    first = cut(walked(at_home))
    bounds = first.groupBy(*key).agg(F.min("kth").alias("bound"))
    onward = table.where("n IS NOT NULL").join(bounds, key).select(*key, "v", "cell", "bound").mapInArrow(_onward(shared, reach, factor), "cell int, sub int, h1 bigint, h2 bigint, v array<double>, bound double")
    second = walked(onward.select("cell", "sub", F.lit(True).alias("asks"), *key, "v", none, "bound"))
    best = F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1)
    merged = first.select(*key, "near").unionByName(second.select(*key, "near")).groupBy(*key).agg(best.alias("near"))
    one = F.struct(*key).alias("class")
    found = cut(merged.join(table.where("n IS NOT NULL").select(*key, "n"), key).select(one, "near", "n"))
    queries = ids.where("asks").select(one, F.col("vec_id").alias("query_id"))
    joined = by_key(queries, found, "class", "n", ids.count(), "inner")
    others = F.slice(F.filter("near", lambda x: ~(x["own"] & (x["vec_id"] == F.col("query_id")))), 1, k)
    drop(classes, first)
    return joined.select("query_id", F.posexplode(others).alias("at", "other")).select("query_id", (F.col("at") + 1).alias("rank"), "other.vec_id", (-F.col("other.less")).alias("score"))


ORACLE = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score FROM ok q JOIN ok c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.e) = len(c.e)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
