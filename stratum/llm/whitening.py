"""Embedding whitening: covariance in tiles, eigenvectors of it, and every vector projected on them.

1. Components become whole numbers; each different vector of them stands once in the fit list, a table.
2. Sums per dimension are exact, so means are, as a whole part and a remainder over the number of vectors.
3. The fit list is cut into blocks of rows, and these into blocks of ``TILE`` columns, sent in the narrowest whole
   numbers that hold them. The column blocks of a row block meet in one task, are centred, and each pair of them is
   multiplied into the tile of its pair of dimensions. Tiles are summed in the task, then by key over all tasks.
4. The tiles of a length of vectors, as many numbers as it has pairs of dimensions, make its covariance in one task,
   which finds the eigenvectors. Only these, a few rows of numbers for each length, go through the driver.
5. Vectors stay where they are and are projected. The fit list's projections go through step 3 again: their covariance
   says how far from white they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

SCALE, OFFSET = 64, 1_000_000
#: Scaled components are held within this, so that sums of a batch fit 64 bits.
REACH = 1 << 40
COMPONENTS = 16
#: Columns of a column block, and rows of a row block.
TILE, BLOCK_ROWS = 32, 4_096
#: Components whose share of the greatest eigenvalue is no greater are rounding, not variance.
LEAST_SHARE = 1e-11
_LONG_MAX = (1 << 63) - 1


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each length and their vectors, a block at a time."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        for low in range(0, len(rows), BLOCK_ROWS):
            part = rows[low : low + BLOCK_ROWS]
            yield part, _matrix(column.take(pa.array(part)), int(length))


@dataclass
class Mean:
    """The mean of ``n`` vectors of whole numbers: ``whole`` plus ``rest`` / n, with 0 <= rest < n."""

    n: int
    whole: np.ndarray
    rest: list[int]

    @staticmethod
    def of(n: int, sums: list[int]) -> Mean:
        parts = [divmod(int(s), n) for s in sums]
        return Mean(n, np.array([p[0] for p in parts], np.int64), [p[1] for p in parts])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - np.array([r / self.n for r in self.rest])

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Exact sums over the dimensions of (n * x - sum) ** 2, or the greatest long where that is less."""
        steps = x - self.whole
        most = self.n * (int(np.abs(steps).max(initial=0)) + 1)
        if most * most * x.shape[1] <= _LONG_MAX:
            return ((steps * self.n - np.array(self.rest, np.int64)) ** 2).sum(1)
        exact = steps.astype(object) * self.n - np.array(self.rest, object)
        return np.array([min(_LONG_MAX, int(v)) for v in (exact * exact).sum(1)], np.int64)


@dataclass
class Whitener:
    """Mean, components (one a row) with their eigenvalues, each one's share of the whole variance, and how far the
    projected fit list's covariance is from the identity."""

    mean: Mean
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.mean.centred(x) @ self.vectors.T / np.sqrt(self.values)


def whole_numbers(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows whose vector has components, none of them null or not finite."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.coalesce((F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    x = F.transform("v", lambda c: F.floor(F.greatest(F.lit(-float(REACH)), F.least(F.lit(float(REACH)), c * SCALE))) + OFFSET)
    return rows.where(fine).select("vec_id", x.cast("array<bigint>").alias("x"))


def means(fit: DataFrame) -> dict[int, Mean]:
    """The exact mean of the vectors of each length."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _by_length(batch.column(0)):
                length = x.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array([length] * length, pa.int32()), pa.array(range(length), pa.int32()), pa.array([len(x)] * length, pa.int64()), pa.array(x.sum(0))], ["length", "place", "n", "total"])

    parts = fit.mapInArrow(summed, "length int, place int, n bigint, total bigint")
    total = parts.groupBy("length", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found: dict[int, list] = {}
    for r in total.collect():  # a row for each dimension
        found.setdefault(r.length, []).append((r.place, r.n, int(r.total)))
    return {length: Mean.of(rows[0][1], [r[2] for r in sorted(rows)]) for length, rows in found.items()}


def _narrowed(x: np.ndarray) -> np.ndarray:
    for kind in (np.int8, np.int16, np.int32):
        if (x == x.astype(kind)).all():
            return x.astype(kind)
    return x


def tiles(fit: DataFrame, sent: Callable[[np.ndarray, int], np.ndarray], centred: Callable[[np.ndarray, int], np.ndarray], tile_width: int = TILE) -> DataFrame:
    """(length, a, b, n, tile): sums over the vectors of a length of the products of dimensions in column block a with
    those in column block b >= a, as doubles in rows. ``sent`` makes of a block of ``x`` what is shuffled, ``centred`` of
    that what is multiplied; both are told the length, which is that of ``x``.
    """
    parts = int(fit.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for _, x in _by_length(batch.column(0)):
                matrix, block = sent(x, x.shape[1]), block + 1
                for low in range(0, matrix.shape[1], tile_width):
                    piece = np.ascontiguousarray(matrix[:, low : low + tile_width])
                    row = [block, x.shape[1], low // tile_width, len(x), matrix.shape[1], piece.dtype.str, piece.tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in row], schema=pieces)

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], list] = {}
        held: list[np.ndarray] = []
        for batch in batches:
            for r in batch.to_pylist():
                piece = np.frombuffer(r["data"], r["kind"]).reshape(r["n"], -1)
                held.append(piece)
                if sum(p.shape[1] for p in held) < r["width"]:
                    continue
                matrix, held = centred(np.concatenate(held, 1), r["length"]), []
                for a in range(0, r["width"], tile_width):
                    for b in range(a, r["width"], tile_width):
                        tile = sums.setdefault((r["length"], a // tile_width, b // tile_width), [0, 0.0])
                        tile[0] += r["n"]
                        tile[1] = tile[1] + matrix[:, a : a + tile_width].T @ matrix[:, b : b + tile_width]
        for (length, a, b), (n, tile) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (length, a, b, n, tile.tobytes())], schema=summed)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, tile = None, 0, None
        for batch in batches:
            for r in batch.to_pylist():
                mine = np.frombuffer(r["tile"])
                if (r["length"], r["a"], r["b"]) == key:
                    n, tile = n + r["n"], tile + mine
                    continue
                if key:
                    yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, n, tile.tobytes())], schema=summed)
                key, n, tile = (r["length"], r["a"], r["b"]), r["n"], mine
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, n, tile.tobytes())], schema=summed)

    pieces = pa.schema([("block", pa.int64()), ("length", pa.int32()), ("place", pa.int32()), ("n", pa.int32()), ("width", pa.int32()), ("kind", pa.string()), ("data", pa.binary())])
    summed = pa.schema([("length", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64()), ("tile", pa.binary())])
    shape = "length int, a int, b int, n bigint, tile binary"
    cut_up = fit.mapInArrow(columns, "block bigint, length int, place int, n int, width int, kind string, data binary")
    partial = cut_up.repartition(parts, "block").sortWithinPartitions("block", "place").mapInArrow(multiplied, shape)
    return partial.repartition(parts, "length", "a", "b").sortWithinPartitions("length", "a", "b").mapInArrow(added, shape)


def assembled(rows, width: int, tile_width: int = TILE) -> np.ndarray:
    """The covariance of ``width`` dimensions from its (a, b, n, tile)."""
    whole = np.zeros((width, width))
    for a, b, n, tile in rows:
        low, left = a * tile_width, b * tile_width
        high, right = min(width, low + tile_width), min(width, left + tile_width)
        block = np.frombuffer(tile).reshape(high - low, right - left) / n
        whole[low:high, left:right] = block
        whole[left:right, low:high] = block.T
    return whole


def eigen(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues by falling size, ``most`` at most, unit eigenvectors in rows, and each value's share of the trace."""
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most], vectors[:, ::-1].T[:most]
    there = values > max(0.0, values[0]) * LEAST_SHARE if len(values) else np.zeros(0, bool)
    return values[there], vectors[there], values[there] / np.trace(covariance) if there.any() else np.zeros(0)


def whitener(fit: DataFrame, components: int = COMPONENTS, tile_width: int = TILE) -> dict[int, Whitener]:
    """For each length of vectors in ``fit`` (x), different ones once each, what whitens it."""
    spark = fit.sparkSession
    mean = means(fit)
    if not mean:
        return {}
    shared = spark.sparkContext.broadcast(mean)

    def decomposed(key, rows):
        import pandas as pd

        values, vectors, explained = eigen(assembled(zip(rows.a, rows.b, rows.n, rows.tile, strict=True), int(key[0]), tile_width), components)
        if not len(values):
            return pd.DataFrame(columns=["length", "component", "value", "vector", "explained"], dtype=object)
        return pd.DataFrame({"length": [int(key[0])] * len(values), "component": range(1, len(values) + 1), "value": values, "vector": list(vectors), "explained": explained})

    products = tiles(fit, lambda x, _: _narrowed(x - OFFSET), lambda y, length: shared.value[length].centred(y.astype(np.int64) + OFFSET), tile_width)
    found = cut(products.groupBy("length").applyInPandas(decomposed, "length int, component int, value double, vector array<double>, explained double"))
    rows: dict[int, list] = {}
    for r in sorted(found.collect(), key=lambda r: (r.length, r.component)):  # ``components`` rows for each length
        rows.setdefault(r.length, []).append(r)
    models = {length: Whitener(mean[length], np.array([r.value for r in own]), np.array([r.vector for r in own]), np.array([r.explained for r in own])) for length, own in rows.items()}
    drop(found)
    white = spark.sparkContext.broadcast(models)
    apart: dict[int, list] = {}
    for r in tiles(fit, lambda x, length: white.value[length].whitened(x) if length in white.value else x[:, :0].astype(float), lambda y, _: y, tile_width).collect():  # one tile for each length
        apart.setdefault(r.length, []).append((r.a, r.b, r.n, r.tile))
    for length, own in apart.items():
        width = len(models[length].values)
        models[length].identity_error = float(np.abs(assembled(own, width, tile_width) - np.eye(width)).max())
    return models


def whiten(embeddings: DataFrame, components: int = COMPONENTS, tile_width: int = TILE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: for each row of ``embeddings`` (vec_id,
    embedding) and each of its first ``components`` principal components a row.

    Rows whose vector is null, empty, or holds null or non-finite components give no rows. Vectors of different lengths
    have no dimensions in common: each length has its own fit list, means and components. A length has no more
    components than dimensions, and those without variance are left out, so equal vectors alone give no rows. vec_ids
    may be null or shared and rows repeated: every row is projected, while in the fit list equal ones stand once. Scaled
    components are held within ``REACH``, and a deviation beyond 64 bits is the greatest long. Other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    rows = whole_numbers(embeddings)
    fit = cut(rows.select("x").distinct())
    shared = embeddings.sparkSession.sparkContext.broadcast(whitener(fit, components, tile_width))
    drop(fit)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _by_length(batch.column(1)):
                model = shared.value.get(x.shape[1])
                if model is None:
                    continue
                count = len(model.values)
                ids = batch.column(0).take(pa.array(np.repeat(at, count)))
                numbers = np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))
                same = lambda value, kind: pa.array(np.full(len(x) * count, value, kind))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(numbers), same(model.mean.n, np.int64), pa.array(np.repeat(model.mean.deviations(x), count)), pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.explained, len(x))), same(model.identity_error, np.float64)],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(projected, "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
