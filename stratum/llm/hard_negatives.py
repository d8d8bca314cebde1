"""Hard negatives: for each anchor and positive the best rows of other labels within a band below the positive's score.

1. Components become whole numbers. Rows of equal label and vector form one class, which keeps the few least ids that an
   answer can name, so very many copies are searched, and found, once.
2. An orthogonal rotation, fitted on a bounded sample, puts directions of much variance first. It changes no inner
   product, so any rotation is right; a good one discards earlier.
3. Classes are dealt to shards by their hash, positives within their label, negatives over all labels. Blocks of anchors
   pass by each shard. Products of the leading rotated components, and the product of the norms of what is left, bound
   the score from both sides; what can't reach an anchor's best so far, or its bands, is discarded after as few
   components as show it. For survivors the inner product of whole numbers decides.
4. The shards' best are merged by class, and joined with the class's anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_key, cut, drop

SCALE = 256
#: Whole numbers are held within this, so that scores of up to 2,048 components fit 64 bits.
REACH = 1 << 26
#: Components that a shard holds, at most about, and the fewest rows for which a further shard is opened.
SHARD_NUMBERS, LEAST_ROWS = 1 << 21, 1_024
#: Classes on which the rotation is fitted: those of least hash.
SAMPLE = 4_096
#: Shares of the sample's variance that are left at the depths where bounds are looked at.
LEFT = (0.5, 0.25, 0.1, 0.03)
#: Anchors of a block, rows compared at once, and the first few, whose scores are computed whole.
BLOCK, STEP, FIRST = 256, 4_096, 256
#: Where no more than this share of pairs is left, they go on one by one instead of all together.
SPARSE, PAIRS = 0.15, 65_536
_LEAST = np.iinfo(np.int64).min


def rotation(rows: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Orthogonal directions in columns, by falling mean square of ``rows`` along them, and the depths to look at."""
    values, vectors = np.linalg.eigh(rows.T @ rows)
    values, width = np.maximum(values[::-1], 0), len(values)
    left = 1 - np.cumsum(values) / max(values.sum(), 1e-300)
    depths = sorted({int(np.argmax(left <= share)) + 1 for share in LEFT if (left <= share).any()} - {width})
    return np.ascontiguousarray(vectors[:, ::-1]), depths


class Rotated:
    """Rows as whole numbers and along the rotation, with the norms of what lies beyond each depth."""

    def __init__(self, whole: np.ndarray, basis: tuple[np.ndarray, list[int]] | None):
        self.whole = whole
        vectors, depths = basis or (np.eye(whole.shape[1]), [whole.shape[1] // 2] if whole.shape[1] > 1 else [])
        self.turned = whole.astype(np.float64) @ vectors
        self.depths = [0, *depths]
        squares = self.turned * self.turned
        self.left = {m: np.sqrt(squares[:, m:].sum(1)) * (1 + 1e-12) for m in depths}
        self.norm = np.sqrt(squares.sum(1))


def survivors(anchors: Rotated, some: np.ndarray, rows: Rotated, low: int, high: int, least: np.ndarray, most: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, row and score of the pairs of anchors ``some`` and rows low..high that are ``allowed`` and may score between
    the anchor's ``least`` and ``most``: all that do, and perhaps others. Scores are exact."""
    kept, dense = allowed, np.zeros(allowed.shape)
    at = None  # pairs, once they are few
    slack = 1e-12 * anchors.norm[some].max(initial=0) * rows.norm[low:high].max(initial=0) + 1e-6
    for depth, onward in zip(anchors.depths, anchors.depths[1:], strict=False):
        rest_a, rest_b = anchors.left[onward][some], rows.left[onward][low:high]
        if at is None:
            dense += anchors.turned[some, depth:onward] @ rows.turned[low:high, depth:onward].T
            rest = rest_a[:, None] * rest_b + slack
            kept = kept & (dense + rest >= least[:, None]) & (dense - rest <= most[:, None])
            if kept.mean() <= SPARSE:
                at = np.nonzero(kept)
                partial = dense[at]
            continue
        a, b = at
        for start in range(0, len(a), PAIRS):
            few = slice(start, start + PAIRS)
            partial[few] += (anchors.turned[some[a[few]], depth:onward] * rows.turned[low + b[few], depth:onward]).sum(1)
        rest = rest_a[a] * rest_b[b] + slack
        fit = (partial + rest >= least[a]) & (partial - rest <= most[a])
        at, partial = (a[fit], b[fit]), partial[fit]
    a, b = at if at is not None else np.nonzero(kept)
    score = np.empty(len(a), np.int64)
    for start in range(0, len(a), PAIRS):
        few = slice(start, start + PAIRS)
        score[few] = (anchors.whole[some[a[few]]] * rows.whole[low + b[few]]).sum(1)
    return a, b + low, score


def _best(score: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score))[:most]
    return score[order], ids[order]


class Shard:
    """Classes (label, h1, h2) of one length: vectors and, padded by the greatest long, their least ids."""

    def __init__(self, classes: np.ndarray, whole: np.ndarray, ids: list[list[int]], basis):
        self.classes, self.rows = classes, Rotated(whole, basis)
        self.counts = np.array([len(i) for i in ids])
        self.ids = np.full((len(ids), max(self.counts, default=1)), np.iinfo(np.int64).max)
        for n, own in enumerate(ids):
            self.ids[n, : len(own)] = own

    def steps(self) -> Iterator[tuple[int, int]]:
        edges = [0, *range(FIRST, len(self.classes), STEP), len(self.classes)]
        return ((a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a)

    def named(self, rows: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of all ids of some classes."""
        there = np.arange(self.ids.shape[1])[None, :] < self.counts[rows][:, None]
        return np.repeat(score, self.counts[rows]), self.ids[rows][there]

    def by_anchor(self, anchors: Rotated, allowed, least: np.ndarray, most: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Anchor, scores and ids of what may score between ``least`` and ``most``, which may be raised meanwhile."""
        everyone = np.arange(len(anchors.whole))
        for low, high in self.steps():
            a, b, score = survivors(anchors, everyone, self.rows, low, high, least, most, allowed(low, high))
            for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(a)) + 1) if len(a) else []:
                yield int(a[part[0]]), *self.named(b[part], score[part])

    def positives(self, asking: np.ndarray, anchors: Rotated, most: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each anchor's class the best ids of other classes of its label."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(asking)
        least = np.full(len(asking), float(_LEAST))

        def others(low: int, high: int) -> np.ndarray:
            same = asking[:, None, :] == self.classes[None, low:high]
            return same[:, :, 0] & ~(same[:, :, 1] & same[:, :, 2])

        for a, score, ids in self.by_anchor(anchors, others, least, np.full(len(asking), np.inf)):
            found[a] = _best(np.concatenate((found[a][0], score)), np.concatenate((found[a][1], ids)), most)
            if len(found[a][0]) == most:
                least[a] = found[a][0][-1]
        return found

    def negatives(self, asking: np.ndarray, anchors: Rotated, positives: list[list[int]], band: tuple[int, int], most: int) -> list[dict[int, tuple[np.ndarray, np.ndarray]]]:
        """For each anchor and score of a positive the best ids of other labels within the band."""
        bands = [{p: (-(-band[0] * p // 100), band[1] * p // 100) for p in own} for own in positives]
        floors = [{p: lo for p, (lo, hi) in own.items() if lo <= hi} for own in bands]
        least = np.array([float(min(own.values(), default=0)) for own in floors])
        top = np.array([float(max((bands[a][p][1] for p in own), default=-1)) for a, own in enumerate(floors)])
        found: list[dict] = [{} for _ in positives]
        open_ = np.array([bool(own) for own in floors])
        for a, score, ids in self.by_anchor(anchors, lambda low, high: (asking[:, :1] != self.classes[low:high, 0]) & open_[:, None], least, top):
            for p, floor in floors[a].items():
                fit = (score >= floor) & (score <= bands[a][p][1])
                if fit.any():
                    was = found[a].get(p, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    found[a][p] = now = _best(np.concatenate((was[0], score[fit])), np.concatenate((was[1], ids[fit])), most)
                    if len(now[0]) == most:
                        floors[a][p] = int(now[0][-1])
            least[a] = float(min(floors[a].values(), default=0))
        return found


_SHAPE = "label bigint, h1 bigint, h2 bigint, positive bigint, score bigint, vec_id bigint"


def _passed_by(shared, answer):
    """Rows sorted by (bucket, width, asks): makes each bucket's shard, then lets blocks of anchors pass by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, shard, waiting = None, [], None, []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal shard, waiting
            if waiting and parts:
                if shard is None:
                    shard = Shard(*(np.concatenate([p[i] for p in parts]) for i in range(2)), [i for p in parts for i in p[2]], shared.value.get(key[1]))
                asking, whole = (np.concatenate([p[i] for p in waiting]) for i in range(2))
                out = list(answer(shard, asking, Rotated(whole, shared.value.get(key[1])), [x for p in waiting for x in p[2]]))
                if out:
                    at, positive, score, ids = (np.concatenate([np.atleast_1d(o[i]) for o in out]) for i in range(4))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*np.ascontiguousarray(asking[at].T), positive, score, ids)], ["label", "h1", "h2", "positive", "score", "vec_id"])
            waiting = []

        for batch in batches:
            bucket, width, asks, label, h1, h2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            change = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (width[1:] != width[:-1]) | (asks[1:] != asks[:-1]))))
            for a, b in zip(change, np.append(change[1:], len(bucket)), strict=True):
                if (bucket[a], width[a]) != key:
                    yield from flush()
                    key, parts, shard = (bucket[a], width[a]), [], None
                for low in range(a, b, BLOCK if asks[a] else b - a):
                    some = slice(low, min(b, low + BLOCK) if asks[a] else b)
                    n = some.stop - some.start
                    whole = batch.column(6).slice(low, n).flatten().to_numpy(zero_copy_only=False).reshape(n, width[a]).astype(np.int64)
                    classes = np.stack([label[some], h1[some], h2[some]], 1)
                    rest = batch.column(8 if asks[a] else 7).slice(low, n).to_pylist()
                    (waiting if asks[a] else parts).append((classes, whole, rest))
                    if sum(len(p[0]) for p in waiting) >= BLOCK:
                        yield from flush()
        yield from flush()

    return run


def _positives_of(most: int):
    def answer(shard: Shard, asking: np.ndarray, anchors: Rotated, _) -> Iterator[tuple]:
        for a, (score, ids) in enumerate(shard.positives(asking, anchors, most)):
            yield np.full(len(ids), a), np.zeros(len(ids), np.int64), score, ids

    return answer


def _negatives_of(band: tuple[int, int], most: int):
    def answer(shard: Shard, asking: np.ndarray, anchors: Rotated, positives: list[list[int]]) -> Iterator[tuple]:
        for a, found in enumerate(shard.negatives(asking, anchors, positives, band, most)):
            for p, (score, ids) in found.items():
                yield np.full(len(ids), a), np.full(len(ids), p, np.int64), score, ids

    return answer


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(width, basis, depths) for each length among the sample's vectors."""
    rows: dict[int, list] = {}
    for batch in batches:
        for x in batch.column(0).to_pylist():
            rows.setdefault(len(x), []).append(x)
    for width, own in rows.items():
        vectors, depths = rotation(np.array(own, float))
        yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([vectors.tobytes()]), pa.array([depths], pa.list_(pa.int32()))], ["width", "basis", "depths"])


def _shards(counted: DataFrame, parts: int) -> DataFrame:
    """``counted`` (n, width) plus shards: as many as hold what a shard may, or else one for each task if rows suffice."""
    fit = F.ceil(F.col("n") * F.col("width") / SHARD_NUMBERS)
    return counted.withColumn("shards", F.greatest(F.lit(1), fit, F.least(F.lit(parts), F.floor(F.col("n") / LEAST_ROWS))).cast("long"))


def mine(embeddings: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, band: tuple[int, int] = (50, 95)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``embeddings`` (vec_id, embedding, label).

    The score of two rows is the inner product of floor(256 * component). An anchor's positives are its best other rows
    of its label; for each of them, its negatives are the best rows of other labels whose score is within ``band`` per
    cent of the positive's. Ties go to the smaller vec_id. Rows whose id, label or vector is null, and vectors that are
    empty or hold null or non-finite components take no part; vectors are only compared with those of their own length.
    A row is its id, label and vector: equal rows count once; rows that share an id, but not the rest, are others to
    each other, and each is an anchor of its own. Whole numbers are held within ``REACH``. An anchor without positives,
    or a positive without negatives, gives no rows; so does an empty table. Other columns are ignored, whatever their
    names. Vectors are told apart by 128 bits of hash.
    """
    spark = embeddings.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    key, one = ["label", "h1", "h2"], F.struct("label", "h1", "h2").alias("class")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    fine = F.coalesce((F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    whole = F.transform("v", lambda c: F.floor(F.greatest(F.lit(-float(REACH)), F.least(F.lit(float(REACH)), c * SCALE))).cast("int"))
    rows = rows.where(fine & F.col("vec_id").isNotNull() & F.col("label").isNotNull()).select("vec_id", "label", "asks", whole.alias("x"))
    rows = rows.select("*", F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(2), "x").alias("h2"))
    ids = cut(rows.groupBy(*key, "vec_id").agg(F.max("asks").alias("asks")))
    place = F.row_number().over(W.partitionBy(*key).orderBy("vec_id"))
    least = ids.withColumn("place", place).where(F.col("place") <= max(positives + 1, negatives)).groupBy(*key).agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = ids.where("asks").groupBy(*key).agg(F.count(F.lit(1)).alias("n_asks"))
    classes = cut(rows.groupBy(*key).agg(F.first("x").alias("x")).join(least, key).join(asked, key, "left").withColumn("width", F.size("x")))
    basis = cut(classes.orderBy("h2", "h1").limit(SAMPLE).select("x").mapInArrow(_fitted, "width int, basis binary, depths array<int>"))
    shared = spark.sparkContext.broadcast({r.width: (np.frombuffer(r.basis).reshape(r.width, r.width), list(r.depths)) for r in basis.collect()})  # a square of the dimensions
    none = F.lit(None).cast("array<bigint>")

    def dealt(by: list[str], asking: DataFrame, answer) -> DataFrame:
        """(class, positive, score, vec_id) that ``answer`` finds in shards of the classes that are alike in ``by``."""
        shards = cut(_shards(classes.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), parts))
        n_groups, total = shards.count(), classes.count()
        at = F.struct(*by).alias("group")
        table = shards.select(at, "n", "shards")
        held = lambda side: side.withColumn("group", at).join(F.broadcast(table), "group") if n_groups <= 10_000 else by_key(side.withColumn("group", at), table, "group", "n", total, "inner")
        bucket = lambda sub: F.xxhash64("group", sub).alias("bucket")
        own = held(classes).select(bucket(F.pmod("h1", "shards")), "width", F.lit(False).alias("asks"), *key, "x", "ids", none.alias("positives"))
        theirs = held(asking).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("sub"))
        theirs = theirs.select(bucket(F.col("sub")), "width", F.lit(True).alias("asks"), *key, "x", none.alias("ids"), "positives")
        placed = own.unionByName(theirs).repartition(parts, "bucket", "width").sortWithinPartitions("bucket", "width", "asks")
        return placed.mapInArrow(_passed_by(shared, answer), _SHAPE).select(one, "positive", "score", "vec_id")

    def merged(found: DataFrame, most: int) -> DataFrame:
        order = W.partitionBy("class", "positive").orderBy(F.col("score").desc(), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    anchors = classes.where("n_asks IS NOT NULL")
    scored = lambda score, vec_id: F.struct((-score).alias("less"), vec_id.alias("vec_id"))
    far = merged(dealt(["label", "width"], anchors.withColumn("positives", none), _positives_of(positives)), positives).groupBy("class").agg(F.collect_list(scored(F.col("score"), F.col("vec_id"))).alias("far"))
    square = F.aggregate("x", F.lit(0).cast("long"), lambda a, c: a + c.cast("long") * c)
    own = F.when(F.size("ids") > 1, F.transform("ids", lambda i: scored(square, i))).otherwise(F.array().cast("array<struct<less:bigint,vec_id:bigint>>"))
    near = cut(anchors.select(one, "n_asks", own.alias("own")).join(far, "class", "left").select("class", "n_asks", "own", F.coalesce("far", F.slice("own", 1, 0)).alias("far")))
    asking = anchors.withColumn("class", one).join(near.select("class", "own", "far"), "class").withColumn("positives", F.array_distinct(F.transform(F.concat("own", "far"), lambda p: -p["less"])))
    hard = merged(dealt(["width"], asking, _negatives_of(band, negatives)), negatives)
    hard = hard.groupBy("class", "positive").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("score").alias("negative_score"), F.col("vec_id").alias("negative_id")))).alias("hard"))
    by_class = hard.groupBy("class").agg(F.map_from_entries(F.collect_list(F.struct("positive", "hard"))).alias("hard"))  # few positives each
    found = cut(near.join(by_class, "class"))
    drop(classes)
    queries = ids.where("asks").select(one, F.col("vec_id").alias("anchor_id"))
    joined = by_key(queries, found, "class", "n_asks", ids.count(), "inner")
    others = F.slice(F.array_sort(F.concat(F.filter("own", lambda p: p["vec_id"] != F.col("anchor_id")), "far")), 1, positives)
    each = joined.select("anchor_id", "hard", F.explode(others).alias("p"))
    each = each.select("anchor_id", F.col("p.vec_id").alias("positive_id"), (-F.col("p.less")).alias("positive_score"), F.explode(F.try_element_at("hard", -F.col("p.less"))).alias("n"))
    return each.select("anchor_id", "positive_id", F.col("n.rank").alias("rank"), F.col("n.negative_id").alias("negative_id"), "positive_score", F.col("n.negative_score").alias("negative_score"))


ORACLE = """
WITH v AS (
  SELECT vec_id::BIGINT AS id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT id, label, list_transform(e, lambda c: floor(256 * c)) AS x FROM v
  WHERE id IS NOT NULL AND label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS (
  SELECT a.id AS anchor_id, c.id, a.label = c.label AS alike, list_inner_product(a.x, c.x)::BIGINT AS score FROM ok a JOIN ok c ON a.id % 50 = 0 AND len(a.x) = len(c.x)
), positive AS (
  SELECT * FROM (SELECT anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place FROM scored WHERE alike AND id <> anchor_id) WHERE place <= 5
), negative AS (
  SELECT p.anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM positive p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 3
"""
