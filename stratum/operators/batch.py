"""Scores and ranks of many queries at once: matrices of chunks by terms and of terms by queries, multiplied where the chunks are.

Two passes over one row a chunk (its length, norm and counts of the queries' terms). The first counts hits in bins of their scores and
gives those that may be among the best, told by ranks within the task's slab, which can only be better than ranks among all.
Bins bound the ranks, so few of them stay; the second pass counts the hits before each of these. No other hit leaves its task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stratum.operators.index import Corpus, with_norms
from stratum.storage import removed, stored

#: Most weights (terms by queries) that a task holds, hits of a slab, numbers of a slab's matrix of terms, and hits ranked at once.
WEIGHTS, SLAB_HITS, SLAB_TERMS, RANKED = 1 << 22, 1 << 21, 1 << 21, 1 << 18
#: Bins of a query's scores, of equal width up to the most it can reach.
BINS = 1_024
_DIGITS = 9


class Weights:
    """The queries' terms as matrices: terms in rows, queries in columns."""

    def __init__(self, rows: list, average: float, k1: float, b: float) -> None:
        self.ids = list(dict.fromkeys(r.query_id for r in rows))
        self.terms = list(dict.fromkeys(r.term for r in rows))
        column, row = {x: i for i, x in enumerate(self.ids)}, {x: i for i, x in enumerate(self.terms)}
        self.bm25, self.cosine = (np.zeros((len(row), len(column))) for _ in range(2))
        self.asked, self.inner = (np.zeros((len(row), len(column)), np.float32) for _ in range(2))
        self.norm, self.n_terms, self.n_inner = (np.zeros(len(column)) for _ in range(3))
        for r in rows:
            at, q = row[r.term], column[r.query_id]
            self.bm25[at, q], self.cosine[at, q] = r.qtf * r.rarity, r.weight * r.idf
            self.asked[at, q], self.inner[at, q] = 1, r.inner
            self.norm[q], self.n_terms[q], self.n_inner[q] = r.query_norm, r.n_terms, r.n_inner
        self.average, self.k1, self.b = average, k1, b
        self.most = np.maximum(self.bm25.sum(axis=0) * (k1 + 1), 1e-9)

    def scores(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """bm25, cosine, number of terms met and of inner ones met, chunks in rows and queries in columns."""
        at = batch.column(3).offsets.to_numpy() - batch.column(3).offsets[0].as_py()
        pairs = batch.column(3).flatten().to_numpy()
        length, norm = np.maximum(batch.column(1).to_numpy(), 1), batch.column(2).to_numpy()
        out = [np.empty((batch.num_rows, len(self.ids)), t) for t in (float, float, np.float32, np.float32)]
        step = max(1, SLAB_TERMS // len(self.terms))
        for i in range(0, batch.num_rows, step):
            j = min(batch.num_rows, i + step)
            own = pairs[at[i] : at[j]]
            place = (np.repeat(np.arange(j - i), np.diff(at[i : j + 1])), own >> 32)
            tf, dense = (own & 0xFFFFFFFF).astype(float), np.zeros((j - i, len(self.terms)))
            dense[place] = tf * (self.k1 + 1) / (tf + self.k1 * ((1 - self.b) + self.b * length[i:j][place[0]] / self.average))
            out[0][i:j] = dense @ self.bm25
            dense[place] = 1 + np.log(tf)
            out[1][i:j] = dense @ self.cosine / (self.norm * norm[i:j, None])
            held = (dense > 0).astype(np.float32)
            out[2][i:j], out[3][i:j] = held @ self.asked, held @ self.inner
        return np.rint(out[0] * 10**_DIGITS) / 10**_DIGITS, np.rint(out[1] * 10**_DIGITS) / 10**_DIGITS, out[2], out[3]

    def slabs(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, ...]]]:
        step = max(1, SLAB_HITS // len(self.ids))
        for batch in batches:
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                yield part.column(0).to_numpy(), self.scores(part)

    def bins(self, score: np.ndarray, kind: int, q: int) -> np.ndarray:
        return np.clip(score / (self.most[q] if kind == 0 else 1.0) * BINS, 0, BINS - 1).astype(np.int64)


def _rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_FOUND = pa.schema([("query_no", pa.int32()), ("kind", pa.int32()), ("bin", pa.int64()), ("n", pa.int64()), ("chunk_ord", pa.int64()), ("bm25", pa.float64()), ("cosine", pa.float64()), ("n_met", pa.int64()), ("near", pa.bool_()), ("bm25_bin", pa.int64()), ("cosine_bin", pa.int64())])
_COUNTS = pa.schema([("query_no", pa.int32()), ("kind", pa.int32()), ("place", pa.int64()), ("n", pa.int64())])
_SQL = {pa.int32(): "int", pa.int64(): "bigint", pa.float64(): "double", pa.bool_(): "boolean"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema)


def _promising(w: Weights, limit: int, share: Callable, coverage: float, phrase: float, slack: float):
    """Hits by bin (kind 0: bm25, 1: cosine), and those that may be among the best (kind 2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = np.zeros((2, len(w.ids), BINS), np.int64)
        best = [np.empty(0)] * len(w.ids)  # the greatest coverages so far: that many hits have at least this score
        for chunk, (bm25, cosine, met, inner) in w.slabs(batches):
            for q in range(len(w.ids)):
                hit = np.flatnonzero(met[:, q])
                if not len(hit):
                    continue
                own, n_met, near = chunk[hit], met[hit, q].astype(np.int64), inner[hit, q] == w.n_inner[q]
                told = n_met / w.n_terms[q] * coverage
                best[q] = np.sort(np.concatenate([best[q], told]))[-limit:]
                least = best[q][0] if len(best[q]) == limit else -np.inf
                most, binned = told + phrase * near + slack, []
                for kind, score in enumerate((bm25[hit, q], cosine[hit, q])):
                    binned.append(w.bins(score, kind, q))
                    counted[kind, q] += np.bincount(binned[kind], minlength=BINS)
                    rank = np.empty(len(hit))
                    rank[np.lexsort((own, -score))] = np.arange(1, len(hit) + 1)
                    most = most + share(rank)
                keep = np.flatnonzero(most >= least)
                n = len(keep)
                yield _rows(_FOUND, np.full(n, q), np.full(n, 2), np.zeros(n), np.ones(n), own[keep], bm25[hit[keep], q], cosine[hit[keep], q], n_met[keep], near[keep], binned[0][keep], binned[1][keep])
        kind, q, at = np.nonzero(counted)
        none = np.zeros(len(q))
        if len(q):
            yield _rows(_FOUND, q, kind, at, counted[kind, q, at], none, none, none, none, none.astype(bool), none, none)

    return run


def _before(w: Weights, asked: dict[str, np.ndarray]):
    """How many hits come before each of the hits ``asked`` for, and after the one before it: by its place among these."""
    orders: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
    for q in range(len(w.ids)):
        own = asked["query_no"] == q
        for kind, name in enumerate(("bm25", "cosine")):
            score, chunk = asked[name][own], asked["chunk_ord"][own]
            order = np.lexsort((chunk, -score))
            falling = -score[order]
            orders[kind].append((falling, np.searchsorted(falling, falling, "left") << 42 | chunk[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = [[np.zeros(len(falling) + 1, np.int64) for falling, _ in own] for own in orders]
        for chunk, (bm25, cosine, met, _) in w.slabs(batches):
            for q in range(len(w.ids)):
                hit = np.flatnonzero(met[:, q])
                for kind, scores in enumerate((bm25, cosine)):
                    falling, keys = orders[kind][q]
                    if len(falling):
                        score = -scores[hit, q]
                        place = np.searchsorted(falling, score, "left")
                        tied = np.flatnonzero(falling[np.minimum(place, len(falling) - 1)] == score)
                        place[tied] = np.searchsorted(keys, place[tied] << 42 | chunk[hit[tied]], "right")
                        counted[kind][q] += np.bincount(place, minlength=len(falling) + 1)
        for kind in (0, 1):
            for q, n in enumerate(counted[kind]):
                at = np.flatnonzero(n)
                yield _rows(_COUNTS, np.full(len(at), q), np.full(len(at), kind), at, n[at])

    return run


def ranked(corpus: Corpus, terms: DataFrame, averages: DataFrame, k1: float, b: float, limit: int, share: Callable, coverage: float, phrase: float, slack: float, thresholds: Callable[[DataFrame, Column, int], DataFrame]) -> tuple[DataFrame, list[DataFrame]] | None:
    """Of all hits those that may be among the ``limit`` best of their query, with both ranks among all hits, and the tables
    that this takes; None where the queries are too many for a task's matrices, or too many hits may be among the best."""
    spark = terms.sparkSession
    size = terms.agg(F.count_distinct("term"), F.count_distinct("query_id")).collect()[0]
    if not 0 < size[0] * size[1] <= WEIGHTS:
        return None
    w = Weights(terms.collect(), averages.collect()[0][0], k1, b)  # of at most WEIGHTS terms
    numbers = spark.createDataFrame(list(enumerate(w.terms)), "no bigint, term string")
    pair = F.shiftleft(F.col("no"), 32).bitwiseOR(F.col("tf").cast("long"))
    lists = corpus.postings.join(F.broadcast(numbers), "term").groupBy("chunk_ord").agg(F.first("length").cast("long").alias("length"), F.collect_list(pair).alias("pairs"))
    rows = stored(with_norms(lists, corpus.stats).select("chunk_ord", "length", "norm", "pairs"), "batch-rows")
    found = stored(rows.mapInArrow(_promising(w, limit, share, coverage, phrase, slack), _ddl(_FOUND)), "batch-found")
    used = [rows, found]

    counts = stored(found.where("kind < 2").groupBy("query_no", "kind", "bin").agg(F.sum("n").alias("n")), "bins")
    used.append(counts)
    above = F.coalesce(F.sum("n").over(W.partitionBy("query_no", "kind").orderBy(F.col("bin").desc()).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bounds = counts.withColumn("above", above)
    n_terms = spark.createDataFrame([(q, int(n)) for q, n in enumerate(w.n_terms)], "query_no int, n_terms bigint")
    hits = found.where("kind = 2").join(F.broadcast(n_terms), "query_no")
    for kind, name in enumerate(("bm25", "cosine")):
        own = bounds.where(F.col("kind") == kind).select("query_no", F.col("bin").alias(f"{name}_bin"), (F.col("above") + 1).alias(f"{name}_low"), (F.col("above") + F.col("n")).alias(f"{name}_high"))
        hits = hits.join(own, ["query_no", f"{name}_bin"])
    told = F.col("n_met") / F.col("n_terms") * coverage
    judged = hits.select("query_no", "chunk_ord", "bm25", "cosine", "n_met", "n_terms", "near", (share(F.col("bm25_high")) + share(F.col("cosine_high")) + told).alias("at_least"), (share(F.col("bm25_low")) + share(F.col("cosine_low")) + told + F.when(F.col("near"), phrase).otherwise(0.0)).alias("at_most"))
    judged = stored(judged, "judged")
    least = thresholds(judged.withColumnRenamed("query_no", "query_id"), F.col("at_least"), limit).withColumnRenamed("query_id", "query_no")
    hopeful = stored(judged.join(least, "query_no", "left").where(F.col("at_most") + slack >= F.coalesce("threshold", F.lit(0.0))).drop("at_least", "at_most", "threshold"), "hopeful")
    used += [judged, hopeful]
    if hopeful.count() > RANKED:
        removed(*used)
        return None
    asked = hopeful.select("query_no", "chunk_ord", "bm25", "cosine").toArrow()  # at most RANKED rows
    counted = rows.mapInArrow(_before(w, {c: asked[c].to_numpy() for c in asked.column_names}), _ddl(_COUNTS))
    out = hopeful
    for kind, name in enumerate(("bm25", "cosine")):
        out = out.withColumn(f"{name}_place", F.row_number().over(W.partitionBy("query_no").orderBy(F.col(name).desc(), "chunk_ord")).cast("long") - 1)
    out, places = stored(out, "places"), stored(counted.groupBy("query_no", "kind", "place").agg(F.sum("n").alias("n")), "before")
    used += [out, places]
    ranks = out
    for kind, name in enumerate(("bm25", "cosine")):
        every = places.where(F.col("kind") == kind).select("query_no", "place", "n", F.lit(False).alias("own")).unionByName(out.select("query_no", F.col(f"{name}_place").alias("place"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("own")))
        upto = F.sum("n").over(W.partitionBy("query_no").orderBy("place").rangeBetween(W.unboundedPreceding, 0)) + 1
        ranks = ranks.join(every.withColumn(f"rank_{name}", upto).where("own").select("query_no", F.col("place").alias(f"{name}_place"), f"rank_{name}"), ["query_no", f"{name}_place"])
    ids = spark.createDataFrame(list(enumerate(w.ids)), f"query_no int, query_id {terms.schema['query_id'].dataType.simpleString()}")
    return ranks.join(F.broadcast(ids), "query_no").select("query_id", "chunk_ord", "bm25", "cosine", "n_met", "n_terms", "near", "rank_bm25", "rank_cosine"), used
