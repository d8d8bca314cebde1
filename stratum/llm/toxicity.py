"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels are given for documents, so tokens are labelled first: in toxic documents a token is toxic if it occurs after
many different tokens there and hardly ever in clean ones (counting what stands before it keeps the words of one
document with many copies out). A chain of two states is fitted to these tokens; each token's odds come from forward
and backward passes. A logistic model turns the largest odds and the sum of marginals into the document's score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import cut

#: Labelled texts of each class that are fitted on, at most, and the characters they come to in all.
SAMPLE_ROWS, SAMPLE_CHARS = 2_000, 6_000_000
#: A toxic token follows at least so many different tokens in toxic documents, and is so many times as frequent there.
CONTEXTS, TIMES = 3, 20.0
#: Tokens of a row that are walked one after the other; longer rows are dealt into chunks of so many.
CHUNK = 256
STEPS = 40
#: Ridge on the weights of a token itself, of the one before and of the one after: contexts are seen too seldom to be trusted as much.
L2 = (1e-4, 0.1, 0.1)
THRESHOLD = 0.7

#: What separates tokens: ASCII other than letters and digits.
GAP = wh.lookup(bytes(b for b in range(128) if not chr(b).isalnum()))


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the lower-cased tokens, and the number of the first token of each row."""
    starts, ends, first = wh.word_spans(data, offsets, GAP)
    return starts, ends, wh.hash_spans(wh.LOWER[data], starts, ends), first


def _states(steps: tuple[np.ndarray, ...], rows: np.ndarray, nth: np.ndarray, order: int) -> np.ndarray:
    """The state (a pair) that enters each chunk, in the order of its row's chunks (``order`` 1) or against it (-1).

    ``steps`` are the four entries of each chunk's matrix, (0,0), (0,1), (1,0) and (1,1). What enters a row's first
    chunk doesn't matter, for its matrix forgets it.
    """
    state = np.ones((len(rows), 2))
    by_turn = np.argsort(nth * order, kind="stable")
    turn = (nth * order)[by_turn]
    for low, high in zip(edges := np.flatnonzero(np.diff(turn, prepend=turn[0] - 1)), [*edges[1:], len(turn)], strict=True):
        at = by_turn[low:high]
        onward = at + order
        fit = (onward >= 0) & (onward < len(rows))
        at, onward = at[fit], onward[fit]
        fit = rows[at] == rows[onward]
        at, onward = at[fit], onward[fit]
        x, y = state[at].T
        after = np.stack([steps[0][at] * x + steps[1][at] * y, steps[2][at] * x + steps[3][at] * y], 1)
        state[onward] = after / after.max(1, keepdims=True)
    return state


def passes(scores: np.ndarray, first: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Toxic over clean, for each token: what the tokens up to it say, and what those after it say.

    ``scores`` are the emissions' log odds; ``chain`` the log potentials of (clean to clean, clean to toxic, toxic to
    clean, toxic to toxic, toxic at the start). Rows are dealt into chunks that are walked side by side; the product of
    a chunk's 2 x 2 matrices carries the states over to the next one, so the passes are exact however long a row is.
    """
    total = len(scores)
    forward, backward = np.empty(total), np.empty(total)
    if not total:
        return forward, backward
    counts = np.diff(first)
    chunks = -(-counts // CHUNK)
    row = np.repeat(np.arange(len(counts)), chunks)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    low, high = first[row], first[row + 1]
    begin = low + nth * CHUNK
    end = np.minimum(begin + CHUNK, high)
    a, b, c, d, start = np.exp(chain)
    emit = np.exp(np.clip(scores, -30, 30))
    many = np.flatnonzero(chunks[row] > 1)
    state = {}
    for order in (1, -1):
        if not len(many):
            state[order] = np.ones((len(row), 2))
            continue
        m = [np.ones(len(many)), np.zeros(len(many)), np.zeros(len(many)), np.ones(len(many))]
        for t in range(CHUNK) if order == 1 else range(CHUNK - 1, -1, -1):
            live = np.flatnonzero(begin[many] + t < end[many])
            at, chunk = begin[many[live]] + t, many[live]
            if order == 1:
                e, edge = emit[at], at == low[chunk]
                step = (np.where(edge, 1, a), np.where(edge, 0, c), e * np.where(edge, start, b), e * np.where(edge, 0, d))
            else:
                edge = at + 1 == high[chunk]
                e = emit[np.minimum(at + 1, total - 1)]
                step = (np.where(edge, 1, a), np.where(edge, 0, b * e), np.where(edge, 1, c), np.where(edge, 0, d * e))
            w, x, y, z = (k[live] for k in m)
            new = (step[0] * w + step[1] * y, step[0] * x + step[1] * z, step[2] * w + step[3] * y, step[2] * x + step[3] * z)
            most = np.maximum.reduce(new)
            for k, v in zip(m, new, strict=True):
                k[live] = v / most
        whole = [np.ones(len(row)) for _ in range(4)]
        for k, v in zip(whole, m, strict=True):
            k[many] = v
        state[order] = _states(tuple(whole), row, nth, order)
    width = int(min(CHUNK, counts.max()))
    ratio = state[1][:, 1] / state[1][:, 0]
    for t in range(width):
        live = np.flatnonzero(begin + t < end)
        at, r = begin[live] + t, ratio[live]
        forward[at] = ratio[live] = emit[at] * np.where(at == low[live], start, (b + d * r) / (a + c * r))
    ratio = state[-1][:, 1] / state[-1][:, 0]
    for t in range(width - 1, -1, -1):
        live = np.flatnonzero(begin + t < end)
        at = begin[live] + t
        x = emit[np.minimum(at + 1, total - 1)] * ratio[live]
        backward[at] = ratio[live] = np.where(at + 1 == high[live], 1.0, (c + d * x) / (a + b * x))
    return forward, backward


def log_odds(scores: np.ndarray, first: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """Log odds of each token's toxic state."""
    forward, backward = passes(scores, first, chain)
    return np.log(forward) + np.log(backward)


def expectations(scores: np.ndarray, first: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's probability of being toxic, and how often each of the chain's potentials is expected to be used."""
    forward, backward = passes(scores, first, chain)
    odds = forward * backward
    p = odds / (1 + odds)
    lead = first[:-1][np.diff(first) > 0]
    inner = np.ones(len(scores), bool)
    inner[lead] = False
    here = np.flatnonzero(inner)
    a, b, c, d, _ = np.exp(chain)
    before, after = forward[here - 1], np.exp(np.clip(scores[here], -30, 30)) * backward[here]
    pairs = np.stack([np.full(len(here), a), b * after, c * before, d * before * after])
    return p, np.append((pairs / pairs.sum(0)).sum(1), p[lead].sum())


@dataclass
class Tagger:
    """``vocabulary`` holds sorted token hashes; ``weights`` a row each for a token, the one before and the one after."""

    vocabulary: np.ndarray
    weights: np.ndarray
    chain: np.ndarray
    model: np.ndarray

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Places in the vocabulary, or one past its end."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, len(self.vocabulary))

    def emissions(self, known: np.ndarray, first: np.ndarray) -> np.ndarray:
        scores = self.weights[0][known].copy()
        if len(known) > 1:
            inner = np.ones(len(known), bool)
            inner[first[:-1][first[:-1] < len(known)]] = False
            scores[1:] += np.where(inner[1:], self.weights[1][known[:-1]], 0)
            scores[:-1] += np.where(inner[1:], self.weights[2][known[1:]], 0)
        return scores

    def features(self, odds: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = len(first) - 1
        out = np.tile([1.0, -10.0, 0.0], (n, 1))
        full = np.flatnonzero(np.diff(first))
        if len(full):
            out[full, 1] = np.clip(np.maximum.reduceat(odds, first[full]), -10, 10)
            out[full, 2] = np.log1p(np.add.reduceat(np.where(odds > 0, 1 / (1 + np.exp(-np.abs(odds))), 0), first[full]))
        return out

    def tag(self, documents: DataFrame) -> DataFrame:
        """doc_id, score, spans for each row; a span has start and end, in characters, and the marginal of its token.

        Spans are those more likely toxic than not. Null and empty texts have no token and get the least score.
        """
        shared = documents.sparkSession.sparkContext.broadcast(self)
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            me = shared.value
            for batch in batches:
                for begin, end, data, offsets in wh.slices(batch.column(1)):
                    starts, ends, hashes, first = tokens(data, offsets)
                    odds = log_odds(me.emissions(me.known(hashes), first), first, me.chain)
                    score = 1 / (1 + np.exp(-(me.features(odds, first) @ me.model)))
                    at = np.flatnonzero(odds > 0)
                    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                    row = np.searchsorted(first, at, "right") - 1
                    base = chars[offsets[row]]
                    values = pa.StructArray.from_arrays([pa.array((chars[starts[at]] - base).astype(np.int32)), pa.array((chars[ends[at]] - base).astype(np.int32)), pa.array(1 / (1 + np.exp(-odds[at])))], fields=list(span))
                    bounds = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=end - begin)))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(score), pa.ListArray.from_arrays(pa.array(bounds), values)], ["doc_id", "score", "spans"])

        docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        return docs.mapInArrow(run, "doc_id bigint, score double, spans array<struct<start:int,end:int,marginal:double>>")


def _different(values: np.ndarray, beside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values in order, and how many different ones stand beside each; pairs are told apart by 64 bits of hash."""
    _, at = np.unique(wh.mixed(values ^ wh.mixed(beside)), return_index=True)
    return np.unique(values[at], return_counts=True)


def _label_tokens(hashes: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    row = np.repeat(np.arange(len(toxic)), np.diff(first)).astype(np.uint64)
    before = np.concatenate((np.zeros(1, np.uint64), hashes[:-1]))
    before[first[:-1][first[:-1] < len(hashes)]] = 0
    bad = toxic[row.astype(np.int64)]
    values, contexts = _different(hashes[bad], before[bad])
    _, in_bad = _different(hashes[bad], row[bad])
    met = ~bad & np.isin(hashes, values)
    good_values, counts = _different(hashes[met], row[met])
    in_good = np.zeros(len(values))
    in_good[np.searchsorted(values, good_values)] = counts
    n_bad, n_good = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    marked = values[(contexts >= CONTEXTS) & (in_bad / n_bad >= TIMES * (in_good + 0.5) / n_good)]
    return bad & np.isin(hashes, marked)


def _fit_chain(hashes: np.ndarray, first: np.ndarray, label: np.ndarray) -> Tagger:
    """Weights and chain of the labelled tokens, by adaptive gradient ascent on the conditional likelihood."""
    values, counts = np.unique(hashes, return_counts=True)
    vocabulary = values[counts > 1]
    me = Tagger(vocabulary, np.zeros((3, len(vocabulary) + 1)), np.array([0.0, -3.0, -1.0, 0.0, -3.0]), np.zeros(3))
    known = me.known(hashes)
    size = len(vocabulary) + 1
    inner = np.ones(len(known), bool)
    inner[first[:-1][first[:-1] < len(known)]] = False
    here = np.flatnonzero(inner)
    was, now = label[here - 1], label[here]
    seen = np.array([((1 - was) * (1 - now)).sum(), ((1 - was) * now).sum(), (was * (1 - now)).sum(), (was * now).sum(), label[~inner].sum()])
    squares, chain_squares = np.zeros((3, size)), np.zeros(5)
    for _ in range(STEPS):
        p, expected = expectations(me.emissions(known, first), first, me.chain)
        rest = label - p
        gradient = np.stack([np.bincount(known, rest, size), np.bincount(known[here - 1], rest[here], size), np.bincount(known[here], rest[here - 1], size)]) - np.array(L2)[:, None] * len(known) / size * me.weights
        chain_gradient = seen - expected
        squares += gradient**2
        chain_squares += chain_gradient**2
        me.weights += gradient / np.sqrt(squares + 1e-9)
        me.chain = np.clip(me.chain + 0.2 * chain_gradient / np.sqrt(chain_squares + 1e-9), -6, 6)
    return me


def fit_texts(column: pa.Array, toxic: np.ndarray, share: float) -> Tagger:
    """Fit on texts and their labels; ``share`` is how many of all documents are toxic."""
    parts = [tokens(data, offsets) for _, _, data, offsets in wh.slices(column, 1 << 40)]
    if not parts or not toxic.any() or toxic.all() or not len(parts[0][2]):
        share = min(max(share, 0.01), 0.99)
        return Tagger(np.zeros(0, np.uint64), np.zeros((3, 1)), np.zeros(5), np.array([np.log(share / (1 - share)), 0.0, 0.0]))
    _, _, hashes, first = parts[0]
    label = _label_tokens(hashes, first, toxic).astype(float)
    me = _fit_chain(hashes, first, label)
    x = me.features(log_odds(me.emissions(me.known(hashes), first), first, me.chain), first)
    y, w = toxic.astype(float), np.array([0.0, 0.0, 0.0])
    for _ in range(25):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-(x @ w)))
        w += np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (y - p) - 0.1 * w)
    own = float(y.mean())
    w[0] += np.log(share / (1 - share)) - np.log(own / (1 - own))
    me.model = w
    return me


def fit(documents: DataFrame, labels: DataFrame, usable, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Tagger:
    """A tagger from the labelled documents (``labels``: doc_id, toxic) for which the column ``usable`` is true.

    Of each class up to ``sample_rows`` different texts are gathered whole, in the order of the hash of their doc_id, as
    long as they come to ``sample_chars`` characters in all; one that would go beyond that is passed over. Rows with a
    null id or label are not used; of several labels of an id the one of the greatest ``toxic`` holds.
    """
    pool = labels.where(usable & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in pool.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    texts = documents.where("text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    first = [pool.where(F.col("toxic") == t).orderBy(F.xxhash64("label_id"), "label_id").limit(sample_rows) for t in (0, 1)]
    chosen = cut(first[0].unionByName(first[1]))
    sizes = texts.select("doc_id", "digest", F.length("text").alias("n")).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))
    each = sizes.groupBy("doc_id", "digest", "toxic").agg(F.first("n").alias("n"))
    gathered = []
    for toxic in (0, 1):
        left = sample_chars
        for r in each.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id", "digest").limit(sample_rows).collect():
            if r.n <= left:
                gathered.append((r.doc_id, r.digest, toxic))
                left -= r.n
    wanted = documents.sparkSession.createDataFrame(gathered, "of_doc bigint, of_digest bigint, toxic int")
    met = texts.join(F.broadcast(wanted), (F.col("doc_id") == F.col("of_doc")) & (F.col("digest") == F.col("of_digest")))
    rows = met.groupBy("doc_id", "digest", "toxic").agg(F.first("text").alias("text"))
    share = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("digest", "ascending")])
            me = fit_texts(table.column("text").combine_chunks(), table.column("toxic").to_numpy() == 1, share)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (me.vocabulary, me.weights, me.chain, me.model)], ["vocabulary", "weights", "chain", "model"])

    # The sample is bounded, so that one task can hold it; the driver gets the model alone.
    fitted = rows.repartition(1).mapInArrow(run, "vocabulary binary, weights binary, chain binary, model binary").collect()
    if not fitted:
        return fit_texts(pa.array([], pa.string()), np.zeros(0, bool), share)
    vocabulary, weights, chain, model = (np.frombuffer(bytes(x), np.uint64 if i == 0 else float) for i, x in enumerate(fitted[0]))
    return Tagger(vocabulary, weights.reshape(3, -1), chain, model)


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the id as text leaves 1 modulo 3. A null id is not."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, held_out, score, predicted, spans.

    ``labels`` holds (doc_id, toxic); those of held-out rows are not looked at. Null and empty texts have no token and
    get the least score, without spans. Rows that share a doc_id are scored each by its own text, repeated rows alike; a
    null doc_id is not held out. Texts of any length are scored whole. Without labels of both classes every row gets
    the share of toxic labels. An empty table gives no rows; other columns are ignored.
    """
    tagger = fit(documents, labels, ~held_out())
    return tagger.tag(documents).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "spans")
