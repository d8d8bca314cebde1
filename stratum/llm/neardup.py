"""Near-duplicate documents by a MinHash LSH forest.

1. Each text gives the set of its hashed word shingles, a MinHash signature and a digest of the set. Texts of equal
   sets form one class, which goes on as one row.
2. Each tree of the forest is an order of the classes, sorted by its own rotation of the signature. Classes that share
   the first ``depth`` values with their neighbour in a tree are candidates; the components of these candidates bound
   where links can be.
3. A component of up to ``block`` classes is compared as a whole, each pair on the full sets. In a larger one, each of
   several trees is cut into blocks of neighbours; a block ends where neighbours share the shortest prefix, so that
   crowded regions are cut at greater depth than sparse ones.
4. The confirmed links' components are the result, but for large components that this leaves in several parts: there
   every class outside the largest part is compared with all others of the component whose set sizes allow a link.
   Classes are dealt into chunks by size, and these few are sent to the chunks, so that no task holds a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .components import connected_components
from .common import by_key, cut, drop, maybe_broadcast

#: Values in a tree's key, the first ``DEPTH`` of which candidates share.
KEY_VALUES, DEPTH = 8, 4
#: Classes of a component that are compared in one task with those outside its largest part.
CHUNK = 512


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for first, end, data, offsets in wh.slices(column):
        data = wh.LOWER[data]
        starts, ends, word = wh.word_spans(data, offsets, wh.SPACE)
        shingles, begin = wh.shingle_hashes(wh.hash_spans(data, starts, ends), word, k)
        yield first, end, *wh.sorted_sets(shingles, begin)


def _digests(values: np.ndarray, begin: np.ndarray) -> list[bytes | None]:
    """16 bytes that stand for each row's set; none for an empty one."""
    full = np.flatnonzero(np.diff(begin))
    out: list[bytes | None] = [None] * (len(begin) - 1)
    if len(full):
        with np.errstate(over="ignore"):
            sums = np.stack([np.add.reduceat(wh.mixed(values ^ s), begin[full]) for s in (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F))], 1)
        for i, row in zip(full, np.ascontiguousarray(sums), strict=True):
            out[i] = row.tobytes()
    return out


def _keys(values: np.ndarray, begin: np.ndarray, trees: int) -> list[bytes | None]:
    """Each row's keys of all trees, one after the other; a key compares as bytes in the order of its values."""
    full = np.flatnonzero(np.diff(begin))
    out: list[bytes | None] = [None] * (len(begin) - 1)
    if len(full):
        seeds = wh.mixed(np.arange(1, trees * DEPTH + 1, dtype=np.uint64))
        low = (values >> np.uint64(32)).astype(np.uint32)
        signature = np.empty((len(full), trees * DEPTH), ">u4")
        with np.errstate(over="ignore"):
            for j, seed in enumerate(seeds):
                signature[:, j] = np.minimum.reduceat((low ^ np.uint32(seed & np.uint64(0xFFFFFFFF))) * (np.uint32(seed >> np.uint64(32)) | np.uint32(1)), begin[full])
        rotated = signature[:, (np.arange(trees)[:, None] * DEPTH + np.arange(KEY_VALUES)) % (trees * DEPTH)].reshape(len(full), -1)
        for i, row in zip(full, np.ascontiguousarray(rotated), strict=True):
            out[i] = row.tobytes()
    return out


def _signed(k: int, trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, values, begin in _sets(batch.column(1), k):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(np.diff(begin)), pa.array(_digests(values, begin), pa.binary()), pa.array(_keys(values, begin, trees), pa.binary())],
                    ["doc_id", "n_shingles", "cls", "keys"],
                )

    return run


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading values the keys of the rows of ``a`` and ``b`` (rows x KEY_VALUES) share."""
    return np.cumprod(a == b, 1).sum(1)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from each class to the first one of its run in a sorted tree.

    A run that meets an end of the partition may go on in the next one; it is tied to a node of the run's own, made
    of the tree and the shared prefix, by which the parts find each other.
    """
    head = last = None  # the first class of the present run; its (tree, prefix)
    whole = False
    for batch in batches:
        if not batch.num_rows:
            continue
        tree = batch.column(0).to_numpy(zero_copy_only=False)
        classes = batch.column(2).to_pylist()
        prefixes = [(int(t), key[: 4 * DEPTH]) for t, key in zip(tree, batch.column(1).to_pylist(), strict=True)]
        a, b = [], []
        for prefix, cls in zip(prefixes, classes, strict=True):
            if prefix == last:
                a.append(head)
                b.append(cls)
            else:
                if last is None:  # the partition's first run
                    a.append(b"r%d-" % prefix[0] + prefix[1])
                    b.append(cls)
                head, last = cls, prefix
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])
        whole = True
    if whole:
        yield pa.RecordBatch.from_arrays([pa.array([b"r%d-" % last[0] + last[1]], pa.binary()), pa.array([head], pa.binary())], ["a", "b"])


def _blocks(block: int):
    """Cuts the sorted classes of each (tree, component) into runs of up to ``block``, where the shared prefix is shortest."""

    def cuts(shared: np.ndarray) -> np.ndarray:
        ends, at = [], 0
        while len(shared) + 1 - at > block:
            room = shared[at + block // 2 - 1 : at + block - 1 + 1]
            at += block // 2 + int(np.argmin(room))
            ends.append(at)
        return np.array(ends, int)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, task = 0, TaskContext.get().partitionId()
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.frombuffer(b"".join(batch.column(2).to_pylist()), ">u4").reshape(-1, KEY_VALUES)
            group = [x for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            change = [0, *(i for i in range(1, len(group)) if group[i] != group[i - 1]), len(group)]
            ids = np.empty(len(group), np.int64)
            for a, b in zip(change[:-1], change[1:], strict=True):
                ends = [0, *cuts(_shared(keys[a : b - 1], keys[a + 1 : b])), b - a]
                for x, y in zip(ends[:-1], ends[1:], strict=True):
                    ids[a + x : a + y] = number
                    number += 1
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array([b"%d-%d" % (task, i) for i in ids], pa.binary())], ["cls", "block"])

    return run


def _packed(k: int):
    """The digest and the set of each text that has one, 6 bytes a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, values, begin in _sets(batch.column(0), k):
                digests = _digests(values, begin)
                raw = np.ascontiguousarray((values >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6])
                fit = [i for i, d in enumerate(digests) if d is not None]
                yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in fit], pa.binary()), pa.array([raw[begin[i] : begin[i + 1]].tobytes() for i in fit], pa.binary())], ["cls", "packed"])

    return run


def _unpack(packed: bytes) -> np.ndarray:
    raw = np.zeros((len(packed) // 6, 8), np.uint8)
    raw[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return raw.view(np.uint64)[:, 0]


def linked(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= percent * union."""
    sizes = np.array([len(s) for s in sets])
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    distinct, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    mine = counts[inverse] > 1
    owner, column = owner[mine], number[inverse[mine]]
    common = np.zeros((len(sets), len(sets)))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    step = max(1024, (1 << 22) // len(sets))
    for low in range(0, int(number[-1]) + 1, step):
        a, b = np.searchsorted(column, (low, low + step))
        rows = np.zeros((len(sets), step), np.float32)
        rows[owner[a:b], column[a:b] - low] = 1
        common += rows @ rows.T
    either = sizes[:, None] + sizes[None, :] - common
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(np.triu(100 * common >= percent * either, 1)), strict=True):
        if (x := find(int(i))) != (y := find(int(j))):
            root[y] = x
            out.append((int(i), int(j)))
    return out


def _confirm(percent: int):
    def links(classes: list[bytes], sets: list[bytes]) -> pa.RecordBatch:
        pairs = linked([_unpack(s) for s in sets], percent) if len(sets) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([classes[i] for i, _ in pairs], pa.binary()), pa.array([classes[j] for _, j in pairs], pa.binary())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, classes, sets = None, [], []
        for batch in batches:
            for block, cls, packed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if block != present:
                    if len(classes) > 1:
                        yield links(classes, sets)
                    present, classes, sets = block, [], []
                classes.append(cls)
                sets.append(packed)
        if len(classes) > 1:
            yield links(classes, sets)

    return run


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers runs of ``CHUNK`` rows of a component, sorted by size, with their least and greatest size."""
    task, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        component, sizes = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        low = 0
        while low < len(component):
            high = low + 1
            while high < len(component) and high - low < CHUNK and component[high] == component[low]:
                high += 1
            n = high - low
            name = b"%d-%d" % (task, number)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).slice(low, n) for i in (0, 2, 3, 4)] + [pa.array([name] * n, pa.binary()), pa.array(np.full(n, sizes[low])), pa.array(np.full(n, sizes[high - 1]))], ["component", "cls", "part", "packed", "chunk", "low", "high"]
            )
            number, low = number + 1, high


class _Members:
    """The sets of a chunk, by value: which of them hold it."""

    def __init__(self, parts: list[bytes], sets: list[np.ndarray]):
        self.parts, self.sizes = parts, np.array([len(x) for x in sets])
        values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(values, kind="stable")
        self.owner = owner[order]
        self.values, self.start = np.unique(values[order], return_index=True)
        self.start = np.append(self.start, len(values))

    def linked(self, wanted: np.ndarray, percent: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.values, wanted), len(self.values) - 1)
        at = at[self.values[at] == wanted]
        counts = self.start[at + 1] - self.start[at]
        places = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(self.start[at], counts)
        common = np.bincount(self.owner[places], minlength=len(self.sizes))
        return np.flatnonzero(100 * common >= percent * (self.sizes + len(wanted) - common))


def _outer(percent: int):
    """Rows (chunk, asks, part, packed), members of each chunk before those that ask. Yields links between parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, members, parts, sets, links = None, None, [], [], set()
        for batch in batches:
            for name, asks, part, packed in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if name != chunk:
                    chunk, members, parts, sets = name, None, [], []
                if not asks:
                    parts.append(part)
                    sets.append(_unpack(packed))
                elif sets:
                    members = members or _Members(parts, sets)
                    links.update((part, parts[i]) for i in members.linked(_unpack(packed), percent) if parts[i] != part)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.binary()), pa.array([b for _, b in links], pa.binary())], ["a", "b"])
                links = set()

    return run


def _rest(sized: DataFrame, found: DataFrame, sets: DataFrame, block: int, percent: int, parts: int) -> DataFrame | None:
    """Links (a, b) between the parts that blocks left of large components; none if they left none."""
    inside = sized.where(F.col("size") > block).join(found.select(F.col("node").alias("cls"), F.col("component").alias("part")), "cls", "left").withColumn("part", F.coalesce("part", "cls"))
    counts = inside.groupBy("component", "part").agg(F.count(F.lit(1)).alias("n"))
    main = cut(counts.groupBy("component").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.count(F.lit(1)).alias("n_parts")).where("n_parts > 1").select("component", "main"))
    n_main = main.count()
    if not n_main:
        drop(main)
        return None
    size = (F.octet_length("packed") / 6).cast("long").alias("n")
    held = inside.join(maybe_broadcast(main, n_main), "component").join(sets.select("cls", "packed", size), "cls").select("component", "n", "cls", "part", "packed")
    kinds = "component binary, cls binary, part binary, packed binary, chunk binary, low bigint, high bigint"
    dealt = cut(held.repartitionByRange(parts, "component", "n", "cls").sortWithinPartitions("component", "n", "cls").mapInArrow(_chunks, kinds))
    chunks = cut(dealt.select(F.col("component").alias("of"), "chunk", "low", "high").distinct())
    asking = dealt.join(maybe_broadcast(main, n_main), "component").where("part <> main").select("component", "part", "packed", size)
    fits = (F.col("component") == F.col("of")) & (F.col("low") * percent <= F.col("n") * 100) & (F.col("high") * 100 >= F.col("n") * percent)
    sent = asking.join(maybe_broadcast(chunks, chunks.count()), fits).select("chunk", F.lit(True).alias("asks"), "part", "packed")
    both = dealt.select("chunk", F.lit(False).alias("asks"), "part", "packed").unionByName(sent)
    links = cut(both.repartition(parts, "chunk").sortWithinPartitions("chunk", "asks").mapInArrow(_outer(percent), "a binary, b binary"))
    drop(main, dealt, chunks)
    return links


def near_duplicates(documents: DataFrame, k: int = 3, percent: int = 85, trees: int = 16, block: int = 64, block_trees: int = 8) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are lower-cased (A-Z) and parted by the space and the characters 9 to 13; a set holds the distinct shingles of
    ``k`` words, of fewer words the whole sequence. Two texts are linked if 100 * intersection >= ``percent`` * union.
    A component is named by its least doc_id. Null texts and texts without words have the empty set and are linked with
    nothing. Rows with the same doc_id are judged each by its own text; a null doc_id never names a component unless it
    has no other, and null counts as equal to null for ``kept``. Other columns are ignored; an empty table gives no
    rows. A text is held whole by the task that reads it.
    """
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = documents.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = cut(docs.mapInArrow(_signed(k, trees), f"doc_id {kind}, n_shingles bigint, cls binary, keys binary"))
    classes = cut(signed.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys")))
    width = 4 * KEY_VALUES
    key = F.substring("keys", F.col("tree") * width + 1, F.lit(width)).alias("key")
    forest = classes.select("cls", "keys", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).select("tree", key, "cls")
    ordered = forest.repartitionByRange(parts, "tree", "key", "cls").sortWithinPartitions("tree", "key", "cls")
    candidate = connected_components(ordered.mapInArrow(_neighbours, "a binary, b binary"))
    members = candidate.where(F.octet_length("node") == 16).withColumnRenamed("node", "cls")
    sizes = cut(members.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    sized = cut(by_key(members, sizes, "component", "size", candidate.count(), "inner"))
    drop(candidate, sizes)
    large = sized.where(F.col("size") > block).join(classes.select("cls", "keys"), "cls")
    some = F.array(*[F.lit(round(i * trees / block_trees)) for i in range(block_trees)])
    large = large.select("component", "cls", "keys", F.explode(some).alias("tree")).select("tree", "component", key, "cls")
    in_blocks = large.repartitionByRange(parts, "tree", "component", "key", "cls").sortWithinPartitions("tree", "component", "key", "cls").mapInArrow(_blocks(block), "cls binary, block binary")
    placed = in_blocks.unionByName(sized.where(F.col("size") <= block).select("cls", F.col("component").alias("block")))
    wanted = placed.groupBy("cls").agg(F.collect_list("block").alias("blocks"))
    # Copies are combined before the shuffle, so that a class costs each task that reads some of it one set.
    whole = docs.select("text").mapInArrow(_packed(k), "cls binary, packed binary").groupBy("cls").agg(F.first("packed").alias("packed"))
    sets = cut(whole.join(wanted, "cls"))
    spread = sets.select(F.explode("blocks").alias("block"), "cls", "packed").repartition(parts, "block").sortWithinPartitions("block")
    found = connected_components(spread.mapInArrow(_confirm(percent), "a binary, b binary"))
    more = _rest(sized, found, sets, block, percent, parts)
    drop(sized, sets)
    if more is not None:
        joined = connected_components(more).select(F.col("node").alias("part"), "component")
        every = found.select("node", F.col("component").alias("part")).unionByName(joined.select(F.col("part").alias("node"), "part")).distinct()
        found = every.join(joined, "part", "left").select("node", F.coalesce("component", "part").alias("component")).distinct()
    linked_to = found.select(F.col("node").alias("cls"), "component")
    named = cut(classes.select("cls", "least", "copies").join(linked_to, "cls", "left").withColumn("component", F.coalesce("component", "cls")))
    names = cut(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("size")))
    known = cut(by_key(named, names, "component", "size", named.count(), "inner").select("cls", "copies", "component_id"))
    result = by_key(signed.select("doc_id", "n_shingles", "cls"), known, "cls", "copies", signed.count())
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    drop(classes, named, names)
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS sh FROM (SELECT *, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
), comp AS (SELECT a AS doc_id, least(a, min(b)) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(comp.c, d.doc_id) AS component_id, coalesce(comp.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""
