"""Removal of repeated byte strings by suffix arrays.

1. Shard by shard, a suffix array of the texts is built by Larsson-Sadakane refinement: suffixes are sorted by a few
   bytes, then groups that are still equal are sorted by the ranks found ``h`` bytes further on, with doubling ``h``.
   Kasai's common prefixes of neighbours give the windows (of 100 bytes) that occur in the shard more than once; all
   but the first are settled. A passage that fills a shard leaves it once.
2. What is left is sampled: each window stands under the least hash of its 32-byte strings (its anchor), so equal
   windows of different shards have equal anchors. Windows in a row under the same anchor are one row of a table, with
   a hash of all their bytes. Rows alike in both hashes are wholly repeated, but for the first of them.
3. Only where an anchor has rows that differ, the bytes around it are fetched, and its windows are merged by binary
   search in the sorted list of first occurrences. An anchor with very many rows is merged window by window in a
   shuffle instead, so that no task needs to hold it.
4. Each text loses the union of its repeated windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructType

from . import wordhash as wh
from .common import cut

WINDOW, K = 100, 32
#: Consecutive K-grams in a window.
GRAMS = WINDOW - K + 1
#: Window starts in a shard; longer texts are dealt over several shards, which share the last window's bytes.
SHARD = 1 << 19
#: Rows of an anchor up to which it is merged in one task.
HOT_ROWS = 4096
NO_ID = np.iinfo(np.int64).min


def suffix_order(data: np.ndarray, depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in the order of their first ``depth`` bytes or more, and for each the length of the prefix proved
    equal to its predecessor's while groups were refined (0: none)."""
    n = len(data)
    place_bits = max(1, int(n).bit_length())
    present = np.flatnonzero(np.bincount(data, minlength=256))
    code = np.zeros(256, np.uint64)
    code[present] = np.arange(1, len(present) + 1)
    bits = int(len(present)).bit_length()
    h = min(depth, max(1, (64 - place_bits) // bits))
    padded = np.concatenate((code[data], np.zeros(h, np.uint64)))
    key = np.zeros(n, np.uint64)
    for j in range(h):
        key = (key << np.uint64(bits)) | padded[j : j + n]
    low, mask = np.uint64(place_bits), np.uint64((1 << place_bits) - 1)
    key = (key << low) | np.arange(n, dtype=np.uint64)
    key.sort()
    order = (key & mask).astype(np.int32)
    key >>= low
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    proved = np.where(new, 0, h).astype(np.int32)
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    rank = np.zeros(n + 2 * depth, np.uint32)
    rank[order] = np.repeat(start + 1, size)
    at = np.flatnonzero(np.repeat(size > 1, size))
    while len(at) and h < depth:
        p = order[at]
        key = (rank[p].astype(np.uint64) << np.uint64(2 * place_bits)) | (rank[p + h].astype(np.uint64) << low) | p.astype(np.uint64)
        key.sort()
        p = (key & mask).astype(np.int32)
        order[at] = p
        key >>= low
        new = np.ones(len(p), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(p)))
        rank[p] = np.repeat(at[first] + 1, size)
        h *= 2
        # Members that part here share h/2 to h bytes; those whose group goes on share h at least.
        proved[at[~new]] = h
        at = at[np.repeat(size > 1, size)]
    return order, proved


def common_prefixes(data: np.ndarray, order: np.ndarray, proved: np.ndarray, least: int, cap: int) -> np.ndarray:
    """Length, up to ``cap``, of the prefix that each suffix shares with its predecessor in ``order``.

    As in Kasai's algorithm no byte known to be equal is read again; the known length is here the one that the
    refinement has proved, not the left neighbour's less one, so that all are extended at once. Those proved to share
    fewer than ``least`` bytes are left as they are.
    """
    length = np.minimum(proved, cap).astype(np.int32)
    at = np.flatnonzero((proved >= least) & (proved < cap))
    while len(at):
        a, b = order[at] + length[at], order[at - 1] + length[at]
        inside = np.maximum(a, b) < len(data)
        equal = np.zeros(len(at), bool)
        equal[inside] = data[a[inside]] == data[b[inside]]
        at = at[equal]
        length[at] += 1
        at = at[length[at] < cap]
    return length


_INVERSE = pow(0xD1342543DE82EF95, -1, 1 << 64)
_inverses = np.ones(1, np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _inverses
    if len(_inverses) < n:
        with np.errstate(over="ignore"):
            _inverses = np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(n, 1024), np.uint64(_INVERSE), np.uint64))))
    return _inverses[:n]


def _sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any byte run follows."""
    with np.errstate(over="ignore"):
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(wh.BYTE_CODES[data] * wh.powers(len(data)))))


def _run_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return wh.mixed((sums[end] - sums[start]) * _inverse_powers(len(sums))[start])


def _ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _back(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def _runs(at: np.ndarray, *changes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the runs of consecutive values in ``at`` in which no one of ``changes`` changes."""
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1] + 1
    for c in changes:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(at)) - 1


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values.astype(np.int32)))


#: A row's text is told by doc_id and ``tag``; ``pack`` holds where its windows start, above 8 bits for how many they are.
_OUT = pa.schema([("h", pa.int64()), ("span", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("pack", pa.int64()), ("spans", pa.list_(pa.int32()))])


def _settle(data: np.ndarray, offsets: np.ndarray, base: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One shard: pieces of texts (bytes, offsets), where each begins in its text, its doc_id and tag."""
    n = len(data)
    lens = np.diff(offsets)
    piece = np.repeat(np.arange(len(lens)), lens)
    starts = np.maximum(lens - WINDOW + 1, 0)
    valid = np.arange(n) < np.repeat(offsets[:-1] + starts, lens)
    if not valid.any():
        return
    order, proved = suffix_order(data)
    same = common_prefixes(data, order, proved, 64, WINDOW) >= WINDOW
    run = np.cumsum(~same)
    use = valid[order]
    order, run = order[use], run[use]
    _, id_rank = np.unique(ids, return_inverse=True)
    own = id_rank[piece[order]].astype(np.int64) << 32 | (base[piece[order]] + order - offsets[piece[order]])
    first = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    earliest = np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(run))))
    repeated = np.zeros(n, bool)
    repeated[order[own > earliest]] = True

    at = np.flatnonzero(repeated)
    if len(at):
        a, b = _runs(at, piece[at])
        owner = piece[at[a]]
        shift = base[owner] - offsets[owner]
        bounds = np.stack([at[a] + shift, at[b] + shift + WINDOW], 1).ravel()
        owners, counts = np.unique(owner, return_counts=True)
        loose = wh.mixed((ids[owners] ^ (base[owners] << 20) ^ tags[owners]).astype(np.uint64)).astype(np.int64)
        zeros = pa.array(np.zeros(len(owners), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(loose), zeros, _back(ids[owners]), pa.array(tags[owners]), zeros, _lists(bounds, 2 * counts)], schema=_OUT)

    sums = _sums(data)
    grams = _run_hash(sums, np.arange(n - K + 1), np.arange(K, n + 1))
    place = np.uint64((1 << 21) - 1)
    least = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= GRAMS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: n - WINDOW + 1], least[GRAMS - width :][: n - WINDOW + 1])
    at = np.flatnonzero(valid & ~repeated)
    anchor = (least[at] & place).astype(np.int64)
    a, b = _runs(at, anchor)
    s, e, anchor = at[a], at[b], anchor[a]
    owner = piece[s]
    count, offset = e - s + 1, anchor - s
    with np.errstate(over="ignore"):
        span = wh.mixed(_run_hash(sums, s, e + WINDOW) ^ wh.mixed((offset * 128 + count).astype(np.uint64)))
    pack = (base[owner] + s - offsets[owner]) << 8 | count
    yield pa.RecordBatch.from_arrays([pa.array(grams[anchor].view(np.int64)), pa.array(span.view(np.int64)), _back(ids[owner]), pa.array(tags[owner]), pa.array(pack), pa.nulls(len(s), pa.list_(pa.int32()))], schema=_OUT)


def _in_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_ids, all_tags = _ids(batch.column(0)), batch.column(1).to_numpy()
        for first, end, data, offsets in wh.slices(batch.column(2), SHARD):
            ids, tags = all_ids[first:end], all_tags[first:end]
            if end - first == 1 and len(data) > SHARD:
                for low in range(0, len(data) - WINDOW + 1, SHARD):
                    part = data[low : low + SHARD + WINDOW - 1]
                    yield from _settle(part, np.array([0, len(part)]), np.array([low]), ids, tags)
            else:
                yield from _settle(data, offsets, np.zeros(end - first, np.int64), ids, tags)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted windows of each text."""
    for batch in batches:
        ids, tags, wanted = _ids(batch.column(0)), batch.column(1).to_numpy(), batch.column(3)
        counts = wanted.value_lengths().to_numpy(zero_copy_only=False)
        from_row = np.concatenate(([0], np.cumsum(counts)))
        flat = wanted.flatten()
        anchors, packs = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(2))
        for first, end, data, offsets in wh.slices(batch.column(2), 4 * SHARD):
            row = np.repeat(np.arange(end - first), counts[first:end])
            take = slice(from_row[first], from_row[end])
            h, pack = anchors[take], packs[take]
            start = (pack >> 8) + offsets[row]
            stop = start + (pack & 255) + WINDOW - 1
            raw = data.tobytes()
            for low in range(0, len(row), 10_000):
                part = slice(low, low + 10_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[part]), _back(ids[first + row[part]]), pa.array(tags[first + row[part]]), pa.array(pack[part]), pa.array([raw[a:b] for a, b in zip(start[part], stop[part], strict=True)], pa.binary())],
                    ["h", "doc_id", "tag", "pack", "around"],
                )


_MERGED = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("key", pa.int64()), ("start", pa.int64()), ("spans", pa.list_(pa.int32()))])


def _windows(h: np.ndarray, pack: np.ndarray, around: list[bytes]) -> tuple[np.ndarray, ...]:
    """For each window of the rows: its row, a key equal for equal windows of an anchor, and its start in the text."""
    count = pack & 255
    row = np.repeat(np.arange(len(pack)), count)
    nth = np.arange(len(row)) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])), count)
    begin = np.concatenate(([0], np.cumsum(count + WINDOW - 1)[:-1]))
    at = begin[row] + nth
    key = _run_hash(_sums(np.frombuffer(b"".join(around), np.uint8)), at, at + WINDOW)
    return row, wh.mixed(key ^ h[row].view(np.uint64)), (pack >> 8)[row] + nth


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor. Yields repeated spans, or for a crowded anchor its windows, whose keys are merged later."""

    def crowded(h, ids, tags, pack, around):
        row, key, start = _windows(h, pack, around)
        yield pa.RecordBatch.from_arrays([_back(ids[row]), pa.array(tags[row]), pa.array(key.view(np.int64)), pa.array(start), pa.nulls(len(row), pa.list_(pa.int32()))], schema=_MERGED)

    def settled(h, ids, tags, pack, around):
        row, key, start = _windows(h, pack, around)
        order = np.lexsort((start, ids[row], key))
        lead = order[np.concatenate(([True], key[order][1:] != key[order][:-1]))]
        found = lead[np.searchsorted(key[lead], key)]
        later = (ids[row] > ids[row[found]]) | (ids[row] == ids[row[found]]) & (start > start[found])
        at = np.flatnonzero(later)
        if len(at):
            a, b = _runs(at, row[at])
            owner = row[at[a]]
            bounds = np.stack([start[at[a]], start[at[b]] + WINDOW], 1)
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([_back(ids[owner]), pa.array(tags[owner]), none, none, _lists(bounds.ravel(), np.full(len(a), 2))], schema=_MERGED)

    def flush(kept):
        if not kept:
            return
        h, ids, tags, pack = (np.concatenate([k[i] for k in kept]) for i in range(4))
        yield from settled(h, ids, tags, pack, [x for k in kept for x in k[4]])

    kept: list[tuple] = []  # whole anchors, and at the end those of the present one
    overfull = None  # an anchor of which rows have gone the other way already
    for batch in batches:
        h, ids, tags, pack = batch.column(0).to_numpy(), _ids(batch.column(1)), batch.column(2).to_numpy(), batch.column(3).to_numpy()
        around = batch.column(4).to_pylist()
        change = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        for a, b in zip(change, np.append(change[1:], len(h)), strict=True):
            part = (h[a:b], ids[a:b], tags[a:b], pack[a:b], around[a:b])
            if overfull is not None and h[a] == overfull:
                yield from crowded(*part)
                continue
            overfull = None
            if kept and kept[-1][0][0] == h[a]:
                last = kept.pop()
                part = (*(np.concatenate((last[i], part[i])) for i in range(4)), last[4] + part[4])
            elif sum(len(k[0]) for k in kept) > HOT_ROWS:
                yield from flush(kept)
                kept = []
            if len(part[0]) > HOT_ROWS:
                overfull = h[a]
                yield from crowded(*part)
            else:
                kept.append(part)
    yield from flush(kept)


def _at_borders(text: bytes, spans: list[int]) -> list[int]:
    """``spans`` widened to whole characters, and put together where they then meet."""
    out: list[int] = []
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        for _ in range(3):
            a -= 0 < a and text[a] & 0xC0 == 0x80
            b += b < len(text) and text[b] & 0xC0 == 0x80
        if out and a <= out[-1]:
            out[-1] = b
        else:
            out += (a, b)
    return out


def _strip(carry: bool, whole_chars: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(2).to_pylist()
            for first, end, data, offsets in wh.slices(batch.column(1), 4 * SHARD):
                raw = data.tobytes()
                spans, kept = [], []
                for i in range(end - first):
                    text = raw[offsets[i] : offsets[i + 1]]
                    pairs = sorted((a, b) for x in found[first + i] or () for a, b in zip(x[::2], x[1::2], strict=True))
                    own: list[int] = []
                    for a, b in pairs:
                        if own and a <= own[-1]:
                            own[-1] = max(own[-1], b)
                        else:
                            own += (a, b)
                    own = _at_borders(text, own) if whole_chars else own
                    spans.append(own)
                    edges = [0, *own, len(text)]
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                part = [batch.column(j).slice(first, end - first) for j in ((0, 3) if carry else (0,))]
                names = ["doc_id", "n_bytes", "removed", "kept", *(["carried"] if carry else [])]
                yield pa.RecordBatch.from_arrays([part[0], pa.array(np.diff(offsets)), pa.array(spans, pa.list_(pa.int32())), pa.array(kept, pa.binary()), *part[1:]], names)

    return run


def strip_repeats(documents: DataFrame, carry: list[str] | None = None, whole_chars: bool = False) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, n_bytes, removed, kept, and the columns of ``carry``.

    ``removed`` lists start and end of the maximal runs of bytes that lie in a 100-byte string which also starts earlier
    (in a smaller doc_id, or further up in the same text); ``kept`` holds the other bytes. Null texts are empty; texts
    of under 100 bytes are never touched; a long one is dealt over several shards. A null doc_id counts as the least.
    Rows that share a doc_id are judged each by its own text, by 64 bits of its hash, and are no earlier than each other
    where they start at the same place; so equal rows are all kept or cut alike. An empty table gives no rows. Columns
    not in ``carry`` are ignored; those in it may not be called doc_id, n_bytes, removed or kept. With ``whole_chars``
    the runs are widened so that no character is cut.
    """
    spark = documents.sparkSession
    carry = carry or []
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tag = F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), tag, "text")
    rows = docs.mapInArrow(_in_shards, "h bigint, span bigint, doc_id bigint, tag bigint, pack bigint, spans array<int>").repartition(parts, "h")
    start, count = F.shiftright("pack", 8), F.col("pack").bitwiseAND(F.lit(255))
    of_anchor = W.partitionBy("h").orderBy("span", "doc_id", "pack").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    alike = W.partitionBy("h", "span").orderBy("doc_id", "pack").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    judged = (
        rows.withColumn("differ", F.first("span").over(of_anchor) != F.last("span").over(of_anchor))
        .withColumn("lead", F.first(F.struct("doc_id", start.alias("start"))).over(alike))
        .withColumn("repeats", F.col("spans").isNull() & ~(F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (start == F.col("lead.start"))))
        .where("spans IS NOT NULL OR repeats OR differ")
    )
    table = cut(judged.select("h", "doc_id", "tag", "pack", "repeats", "spans"))
    own = [F.col("doc_id").alias("of_doc"), F.col("tag").alias("of_tag")]
    same = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("tag") == F.col("of_tag"))
    alone = table.where("spans IS NOT NULL OR repeats").select("doc_id", "tag", F.coalesce("spans", F.array(start.cast("int"), (start + count + (WINDOW - 1)).cast("int"))).alias("spans"))
    open_rows = table.where("spans IS NULL AND NOT repeats").groupBy(*own).agg(F.collect_set(F.struct("h", "pack")).alias("wanted"))
    around = docs.join(open_rows, same).select("doc_id", "tag", "text", "wanted").mapInArrow(_contexts, "h bigint, doc_id bigint, tag bigint, pack bigint, around binary")
    merged = around.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(_merge, "doc_id bigint, tag bigint, key bigint, start bigint, spans array<int>")
    by_window = W.partitionBy("key").orderBy("doc_id", "start").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    one_by_one = (
        merged.where("spans IS NULL")
        .withColumn("lead", F.first(F.struct("doc_id", "start")).over(by_window))
        .where(~(F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("start") == F.col("lead.start"))))
        .select("doc_id", "tag", F.array(F.col("start").cast("int"), (F.col("start") + WINDOW).cast("int")).alias("spans"))
    )
    spans = alone.unionByName(merged.where("spans IS NOT NULL").select("doc_id", "tag", "spans")).unionByName(one_by_one)
    per_doc = spans.groupBy(*own).agg(F.collect_set("spans").alias("found"))
    carried = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []
    whole = documents.select(F.col("doc_id").cast("long").alias("doc_id"), tag, "text", *carried)
    joined = whole.join(per_doc, same, "left").select("doc_id", "text", "found", *(["carried"] if carry else []))
    kinds = StructType().add("doc_id", LongType()).add("n_bytes", LongType()).add("removed", ArrayType(IntegerType())).add("kept", BinaryType())
    stripped = joined.mapInArrow(_strip(bool(carry), whole_chars), kinds.add(joined.schema["carried"]) if carry else kinds)
    return stripped.select("doc_id", "n_bytes", "removed", "kept", *(["carried.*"] if carry else []))
