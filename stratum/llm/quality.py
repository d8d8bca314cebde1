"""Quality selection by importance resampling.

Two generative models give every hashed n-gram a probability: one from texts labelled good, one from all texts. A
text's log weight is the sum, over its n-grams, of the log ratio of the two. Gumbel noise on the log weights and a cut
at the k-th largest key sample k texts in proportion to their weights, without replacement. How many are sampled is a
share of all, which the labels state and the scores have no part in. Equal texts are one, in the models, the share and
the sample, for how often a text was copied says nothing of its quality; its rows are kept or dropped alike.

The n-grams are words and pairs of words, and single, paired and tripled word forms. A form keeps of a word its cases,
digits, trailing marks and whether it repeats the word before, so that shouting, symbol noise, tables and repetition
show in n-grams that are frequent enough to be estimated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import cut

BUCKETS = 1 << 16
#: Labelled texts that the target model is fitted on, at most; which ones is decided by the hash of their doc_id.
SAMPLE_ROWS = 20_000
#: Weight, in n-grams, of the prior by which a bucket is as frequent in good texts as in all: rare ones say little.
PRIOR = 20.0
#: Scale of the Gumbel noise. 1 samples in proportion to the weights; smaller values prefer the greatest ones more.
TEMPERATURE = 1.0
#: The share that is sampled is that of good texts among labelled ones, and so many standard errors more: rather some junk than good ones lost.
ERRORS = 1.0

_UPPER = wh.lookup(bytes(range(65, 91)))
_LETTER_LOW = wh.lookup(bytes(range(97, 123)))
_DIGIT = wh.lookup(b"0123456789")
_MARK = wh.lookup(bytes(b for b in range(33, 127) if not chr(b).isalnum()))


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams and the row of each."""
    starts, ends, first = wh.word_spans(data, offsets, wh.SPACE)
    n = len(starts)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    if not n:
        return np.zeros(0, np.int64), row
    word = wh.hash_spans(wh.LOWER[data], starts, ends)
    sums = [np.concatenate(([0], np.cumsum(t[data], dtype=np.int64))) for t in (_UPPER, _LETTER_LOW, _DIGIT)]
    upper, lower, digit = (s[ends] - s[starts] for s in sums)
    form = (np.minimum(upper, 2) | np.minimum(lower, 1) << 2 | np.minimum(digit, 1) << 3 | _UPPER[data[starts]].astype(np.int64) << 4).astype(np.uint64)
    for back in range(1, 4):  # up to three trailing marks
        at = ends - back
        inside = at >= starts
        last = np.where(inside, data[np.maximum(at, 0)], 0)
        form |= np.where(inside & _MARK[last], last, 0).astype(np.uint64) << np.uint64(8 * back)
    again = np.zeros(n, np.uint64)
    again[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    form |= again << np.uint64(40)
    form = wh.mixed(form ^ np.uint64(0x8E5F0C1D2B3A4967))
    parts, rows = [word, form], [row, row]
    with np.errstate(over="ignore"):
        for tokens, lengths in ((word, (2,)), (form, (2, 3))):
            for k in lengths:
                if n >= k:
                    fit = row[k - 1 :] == row[: n - k + 1]
                    mix = sum((tokens[j : n - k + 1 + j] * wh.PLACE_CODES[8 * k + j] for j in range(k)), np.zeros(n - k + 1, np.uint64))
                    parts.append(wh.mixed(mix[fit]))
                    rows.append(row[k - 1 :][fit])
    return (np.concatenate(parts) >> np.uint64(48)).astype(np.int64), np.concatenate(rows)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        good = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for first, _, data, offsets in wh.slices(batch.column(0)):
            bucket, row = ngrams(data, offsets)
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[good[first + row]], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["bucket", "n_raw", "n_target"])


def _log_weights(column: pa.Array, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of n-grams, log weight and a hash of each text; null is empty."""
    n_grams, weight, hashes = np.zeros(len(column), np.int64), np.zeros(len(column)), np.zeros(len(column), np.uint64)
    for first, end, data, offsets in wh.slices(column):
        bucket, row = ngrams(data, offsets)
        n_grams[first:end] = np.bincount(row, minlength=end - first)
        weight[first:end] = np.bincount(row, ratio[bucket], minlength=end - first)
        full = np.flatnonzero(np.diff(offsets))
        hashes[first + full] = wh.hash_spans(data, offsets[full], offsets[full + 1])
    return n_grams, weight, hashes


def _keys(hashes: np.ndarray, weight: np.ndarray, temperature: float, seed: int) -> np.ndarray:
    u = ((wh.mixed(hashes ^ np.uint64(seed)) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
    return weight - temperature * np.log(-np.log(u))


def _ordered(key: np.ndarray) -> np.ndarray:
    """Non-negative integers in the order of the keys."""
    bits = (key + 0.0).view(np.int64)
    return (np.where(bits < 0, ~(bits & np.iinfo(np.int64).max), bits) >> 1) + (1 << 62)


@dataclass
class Selector:
    """A fitted model; ``share`` of the texts is sampled, and ``cut_key`` is the least key of those."""

    ratio: np.ndarray
    share: float = 1.0
    temperature: float = TEMPERATURE
    seed: int = 1
    cut_key: int | None = None

    def score(self, documents: DataFrame) -> DataFrame:
        """doc_id, n_grams, log_weight, text_hash, key and its order for each row; null and empty texts weigh 0."""
        ratio, temperature, seed = documents.sparkSession.sparkContext.broadcast(self.ratio), self.temperature, self.seed

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n_grams, weight, hashes = _log_weights(batch.column(1), ratio.value)
                key = _keys(hashes, weight, temperature, seed)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_grams), pa.array(weight), pa.array(hashes.view(np.int64)), pa.array(key), pa.array(_ordered(key))], ["doc_id", "n_grams", "log_weight", "text_hash", "key", "key_order"])

        docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        return docs.mapInArrow(run, "doc_id bigint, n_grams bigint, log_weight double, text_hash bigint, key double, key_order bigint")

    def choose(self, scored: DataFrame) -> Selector:
        """Set the cut so that ``share`` of the different texts in ``scored`` is sampled.

        The k-th largest key is found digit by digit, from counts of at most 65,536 values each.
        """
        texts = cut(scored.groupBy("text_hash").agg(F.first("key_order").alias("key_order")))
        k = rest = math.ceil(self.share * texts.count())
        found = 0
        if not k:
            self.cut_key = np.iinfo(np.int64).max
            return self
        for shift in (48, 32, 16, 0):
            digit = F.shiftright("key_order", shift)
            near = texts if shift == 48 else texts.where(F.shiftright("key_order", shift + 16) == found)
            for digit_value, count in sorted(((r.d, r.n) for r in near.groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True):
                if count >= rest:
                    found = digit_value
                    break
                rest -= count
        self.cut_key = found
        return self

    def keep(self, documents: DataFrame) -> DataFrame:
        """The rows that are kept, with all their columns; texts are scored where they are read, none is shuffled."""
        ratio, temperature, seed, cut_key = documents.sparkSession.sparkContext.broadcast(self.ratio), self.temperature, self.seed, self.cut_key
        at = documents.columns.index("text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, weight, hashes = _log_weights(batch.column(at), ratio.value)
                yield batch.filter(pa.array(_ordered(_keys(hashes, weight, temperature, seed)) >= cut_key))

        return documents.mapInArrow(run, documents.schema)


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, temperature: float = TEMPERATURE) -> Selector:
    """Models from ``documents`` (doc_id, text) and ``labels`` (doc_id, quality; 1 is good).

    The raw model counts the n-grams of all distinct texts. The target model counts those of up to ``sample_rows``
    labelled good documents, taken by the hash of their doc_id; equal texts among them count once, and a text is good if
    any document of it is. Without any, every weight is 0. A null doc_id has no label. The share to be sampled is that of
    good texts among all that have a label of 0 or 1, and ``ERRORS`` standard errors more; without labels it is 1.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stated = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max("quality").alias("good"))
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"))
    labelled = texts.join(stated, F.col("doc_id") == F.col("label_id")).groupBy("digest").agg(F.max("good").alias("good"))
    state = labelled.agg(F.count(F.lit(1)).alias("n"), F.avg("good").alias("good")).collect()[0]
    whole = 1.0 if not state.n else min(1.0, state.good + ERRORS * math.sqrt(state.good * (1 - state.good) / state.n))
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("good_id")).distinct()
    sample = cut(good.orderBy(F.xxhash64("good_id"), "good_id").limit(sample_rows))
    marked = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("good_id"), "left").select("text", F.col("good_id").isNotNull().alias("good"))
    once = marked.where("text IS NOT NULL").groupBy("text").agg(F.max("good").alias("good"))
    rows = once.mapInArrow(_counts, "bucket bigint, n_raw bigint, n_target bigint").groupBy("bucket").agg(F.sum("n_raw").alias("r"), F.sum("n_target").alias("t")).collect()  # BUCKETS at most
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for x in rows:
        raw[x.bucket], target[x.bucket] = x.r, x.t
    share = target.sum() / max(raw.sum(), 1)
    return Selector(np.log(target + PRIOR) - np.log(share * raw + PRIOR) if share else np.zeros(BUCKETS), whole, temperature)


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``documents``: doc_id, n_grams, log_weight, key, kept.

    ``labels`` holds (doc_id, quality). Null and empty texts have no n-grams and weigh 0; texts of any length are scored
    whole. Each row is judged by its own text, whatever its doc_id; equal texts have equal keys, and texts at the cut with
    equal keys are all kept. Other columns are ignored; an empty table gives no rows.
    """
    selector = fit(documents, labels)
    scored = cut(selector.score(documents))
    selector.choose(scored)
    return scored.select("doc_id", "n_grams", "log_weight", "text_hash", "key", (F.col("key_order") >= selector.cut_key).alias("kept"))
