"""Texts too large for one task, cut by many: chunks equal to those that the folds of ``segment`` give for the whole text.

A fold over a text can be shared out if each block of it says what state it leaves for any state it is entered in. Two
passes do so, each with one small row a block that a fold over the blocks reads:

* Headings and paragraphs. A block knows three states at its start (nothing but white space so far, plain text, a
  heading's marks whose title is still to come), and lengths are added up. Then every block knows where the paragraph it
  begins in started and where it ends, so the cuts of a long one are arithmetic.
* Packing. What follows the start of a chunk is decided by the unit there and the end of the text before it. A block
  follows each of its first units to the chunk that is open at its end; the fold takes the entered state through these
  units only until it meets one of those starts. A block where it meets none is cut in a job of its own, and the fold is
  then run again.

A line isn't parted: it is one task's, and at most what a Spark row holds (2 GB).
"""

from __future__ import annotations

import bisect
import math
import pickle
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions.text import CHARS_PER_TOKEN, SPACES
from stratum.operators import segment
from stratum.storage import removed, stored

BLOCK_CHARS = 1 << 20
#: What a block is entered in: white space alone so far, text, or the marks of a heading whose title follows.
_START, _TEXT, _PENDING = range(3)
_SPACE = "[" + re.escape(SPACES) + "]"
_FULL = re.compile(f"(#{{1,6}}){_SPACE}+([^{re.escape(SPACES)}].*)", re.S)
_BARE = re.compile(f"(#{{1,6}}){_SPACE}*")
_CJK = re.compile("[㐀-鿿]")
_KEYS = ["document", "split", "seq"]


def lines_of(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """document (the path), split and line of text files, read by ranges; LF, CR and CRLF end lines."""
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("document"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("line"))


def lines_in_order(texts: DataFrame) -> DataFrame:
    """document, split and line of (document, place, text), whose rows form one text in the order of place, parted by empty lines."""
    ordered = texts.repartitionByRange("document", "place").sortWithinPartitions("document", "place")
    return ordered.select("document", F.spark_partition_id().cast("long").alias("split"), F.explode(F.split(F.concat(F.coalesce("text", F.lit("")), F.lit("\n")), "\r\n|\r|\n")).alias("line"))


def blocks(lines: DataFrame, chars: int = BLOCK_CHARS) -> DataFrame:
    """document, split, seq and text of runs of lines, each ended by LF, where they are read: nothing is shuffled.

    The lines of a (document, split) must lie in one partition in their order, as files are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seq, held, size = None, 0, [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([seq], pa.int64()), pa.array(["\n".join(held) + "\n"])], [*_KEYS, "text"])

        for batch in batches:
            for document, split, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and ((document, split) != key or size >= chars):
                    yield row()
                    seq, held, size = seq + 1 if (document, split) == key else 0, [], 0
                key = (document, split)
                held.append(line)
                size += len(line) + 1
        if held:
            yield row()

    return lines.select("document", F.col("split").cast("long"), F.coalesce("line", F.lit(""))).mapInArrow(run, "document string, split bigint, seq bigint, text string")


def _scan(text: str, state: int, level: str = "", keep_last: bool = False) -> tuple[list[tuple], int, str]:
    """Stretches (None, start, end) without a break and headings (level, title, start) between them; state and level after.

    Marks without a title are left out, for one follows; with ``keep_last`` none does after the last, and they are text.
    """
    items, a, at = [], 0, 0
    marks = None
    for line in text[:-1].split("\n"):
        end = at + len(line) + 1
        if not line:
            items.append((None, a, at))
            a = end
        elif bare := line.strip(SPACES):
            own = line.lstrip(SPACES) if state == _START else line
            if state == _PENDING:
                items += [(None, a, at), (level, bare, at)]
                a, state, marks = end, _TEXT, None
            elif found := _FULL.fullmatch(own):
                items += [(None, a, at), (found[1], found[2].strip(SPACES), at)]
                a, state = end, _TEXT
            elif found := _BARE.fullmatch(own):
                level, marks = found[1], (len(items), a)
                items.append((None, a, at))
                a, state = end, _PENDING
            else:
                state = _TEXT
        at = end
    if keep_last and state == _PENDING and marks:  # only empty lines and white space follow: it all stays in one stretch
        items, a, state = items[: marks[0]], marks[1], _TEXT
    items.append((None, a, len(text)))
    return items, state, level


def _solid(text: str, a: int, b: int) -> tuple[int, int] | None:
    """The range without white space at its ends."""
    part = text[a:b]
    left = len(part) - len(part.lstrip(SPACES))
    return (a + left, a + len(part.rstrip(SPACES))) if left < len(part) else None


def _outline(text: str, state: int, keep_last: bool) -> tuple:
    items, after, level = _scan(text, state, "", keep_last)
    heads = [i for i in items if i[0] is not None]
    begun = next((n for n, i in enumerate(items) if i[0] is not None), len(items))
    before = any(_solid(text, i[1], i[2]) for i in items[:begun])
    return after, level, len(heads), heads[-1][1] if heads else None, _solid(text, *items[0][1:]), len(items) > 1, _solid(text, *items[-1][1:]), before


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):  # a block at a time: a batch has tens of MB
            text = batch["text"][i].as_py()
            made = pickle.dumps((len(text), [[_outline(text, s, k) for k in (False, True)] for s in range(3)]))
            yield pa.RecordBatch.from_arrays([*(batch[k].slice(i, 1) for k in _KEYS), pa.array([made], pa.binary())], [*_KEYS, "payload"])


def _entered(frame: pd.DataFrame) -> pd.DataFrame:
    """How each block of a document is entered: offset, state, section, and the paragraphs at its start and end."""
    frame = frame.sort_values(["split", "seq"])
    outlines = [pickle.loads(p) for p in frame["payload"]]

    def through(unpaired: int | None) -> tuple[list[dict], int | None, int, bool]:
        state, level, base, section, title = _START, "", 0, 0, None
        paragraph, out, waiting, preface = [None, None], [], None, False
        for n, (length, variants) in enumerate(outlines):
            after, new_level, heads, last_title, first, broke, last, before = variants[state][n == unpaired]
            entry = {"base": base, "state": state, "level": level, "section": section, "title": title, "keep_last": n == unpaired, "first": paragraph}
            preface |= section == 0 and before
            for part in (first, last) if broke else (first,):
                if part is last and broke:
                    paragraph = [None, None]
                if part:
                    paragraph[:] = [base + part[0] if paragraph[0] is None else paragraph[0], base + part[1]]
            if broke and first is last:  # both hold nothing
                paragraph = [None, None]
            entry["last"] = paragraph
            if after == _PENDING and (state != _PENDING or new_level):
                waiting = n
            state, level = after, new_level or level
            base, section, title = base + length, section + heads, last_title if heads else title
            out.append(entry)
        return out, waiting if state == _PENDING else None, section, preface

    out, unpaired, heads, preface = through(None)
    if unpaired is not None:
        out, _, heads, preface = through(unpaired)
    return frame[_KEYS].assign(payload=[pickle.dumps({**e, "headed": heads > 0, "shift": 0 if preface else 1}) for e in out])


def _sizes(headed: bool, target: int, overlap: int, parent: int) -> tuple[int, int]:
    return (target, overlap) if headed else (parent, 0)


def _pieces(start: int, end: int, lo: int, hi: int, longest: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Ranges that a paragraph from ``start`` to ``end`` is cut into, as far as they meet ``lo`` to ``hi``."""
    stride = longest - overlap
    for i in range(max(0, (lo - start - longest) // stride + 1), (hi - 1 - start) // stride + 1):
        if i == 0 or end - start - i * stride > overlap:
            yield start + i * stride, min(start + i * stride + longest, end)


def _units(target: int, overlap: int, parent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in range(batch.num_rows):
                document, split, seq, text, payload = (batch[c][place].as_py() for c in (*_KEYS, "text", "payload"))
                entry = pickle.loads(payload)
                size, lap = _sizes(entry["headed"], target, overlap, parent)
                longest, base, section, title, rows = max(segment.LEAST_CUT, int(size * 2.0)), entry["base"], entry["section"], entry["title"], []
                items, _, _ = _scan(text, entry["state"], entry["level"], entry["keep_last"])
                for n, (level, a, b) in enumerate(items):
                    if level is not None:
                        section, title, line = section + 1, a, f"{level} {a}"
                        rows += [(section, title, base + b + i, base + b + i, line[i:j], True) for i, j in _pieces(0, len(line), 0, len(line), longest, lap)]
                        continue
                    if n == 0:
                        start, end = entry["first"]
                    elif n == len(items) - 1:
                        start, end = entry["last"]
                    else:
                        start, end = (base + x for x in _solid(text, a, b) or (-base, -base))
                    if start is None or (lo := max(base + a, start)) >= (hi := min(base + b, end)):
                        continue
                    for i, j in _pieces(start, end, lo, hi, longest, lap):
                        x, y = max(i, lo), min(j, hi)
                        if x < y:
                            rows.append((section, title, i, x, text[x - base : y - base], (x, y) == (i, j)))
                if rows:
                    alike = [(document, pa.string()), (split, pa.int64()), (seq, pa.int64())], [(entry["headed"], pa.bool_()), (entry["shift"], pa.int32())]
                    first, last = ([pa.array([x] * len(rows), t) for x, t in side] for side in alike)
                    own = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*first, *own, *last], [*_KEYS, "section", "title", "start", "at", "text", "whole", "headed", "shift"])

    return run


def units(cut_up: DataFrame, target: int, overlap: int, parent: int) -> DataFrame:
    """A table of the units of blocks, each with its section and, as order, the place where it starts; one that blocks share is the first's."""
    entries = cut_up.mapInArrow(_outlines, "document string, split bigint, seq bigint, payload binary").groupBy("document").applyInPandas(_entered, "document string, split bigint, seq bigint, payload binary")
    schema = "document string, split bigint, seq bigint, section bigint, title string, start bigint, at bigint, text string, whole boolean, headed boolean, shift int"
    parts = stored(cut_up.join(entries, _KEYS).mapInArrow(_units(target, overlap, parent), schema), "unit-parts")
    joined = parts.where("NOT whole").groupBy("document", "start").agg(
        F.min_by(F.struct("split", "seq", "section", "title", "headed", "shift"), "at").alias("k"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda p: p["text"]), "").alias("text"),
    )
    columns = ["document", "split", "seq", "section", "title", "start", "text", "headed", "shift"]
    made = stored(parts.where("whole").select(columns).unionByName(joined.select("document", "start", "text", "k.*").select(columns)), "units")
    removed(parts)
    return made


def _tokens(text: str) -> int:
    cjk = len(_CJK.findall(text))
    return max(1, cjk + math.ceil((len(text) - cjk) / CHARS_PER_TOKEN))


def _assembled(cur: list[str]) -> str:
    return "\n\n".join(cur).strip(SPACES)


def _opened(tail: str, unit: str) -> tuple[list[str], int]:
    cur = [tail, unit] if tail else [unit]
    return cur, _tokens("\n\n".join(cur))


def _packed(rows: list[tuple[str, int]], cur: list[str], n: int, target: int, overlap: int) -> Iterator[tuple[int, str | None, list[str], int]]:
    """The fold: after each unit its index, the chunk that ended before it, and what is open."""
    for j, (unit, size) in enumerate(rows):
        if cur and n + size > target:
            done = _assembled(cur)
            cur, n = _opened(done[-overlap:] if overlap else "", unit)
            yield j, done, cur, n
        else:
            cur, n = [*cur, unit], n + size
            yield j, None, cur, n


def _followed(rows: list[tuple[str, int]], target: int, overlap: int) -> tuple[dict[int, tuple[str, int, int]], dict[int, tuple[list[str], int]]]:
    """For a chunk that starts at unit j: the end of the text before it, the last start that follows and how many chunks end
    until then; and what is open at the end for each last start."""
    sums = [0]
    for _, size in rows:
        sums.append(sums[-1] + size)

    def tail(j: int) -> str | None:
        if not overlap:
            return ""
        i = j
        while i and (i == j or len(_assembled([u for u, _ in rows[i:j]])) < overlap):
            i -= 1
        text = _assembled([u for u, _ in rows[i:j]])
        return text[-overlap:] if len(text) >= overlap else None

    tails, followed, left = {j: tail(j) for j in range(1, len(rows))}, {}, {}
    for j in range(len(rows) - 1, 0, -1):
        if tails[j] is None:
            continue
        cur, n = _opened(tails[j], rows[j][0])
        k = max(j + 1, bisect.bisect_right(sums, target - n + sums[j + 1]) - 1)
        whole = [*cur, *(u for u, _ in rows[j + 1 : k])]
        if k >= len(rows):
            followed[j], left[j] = (tails[j], j, 0), (whole, n + sums[-1] - sums[j + 1])
        elif k in followed and (not overlap or _assembled(whole)[-overlap:] == tails[k]):
            followed[j] = (tails[j], followed[k][1], followed[k][2] + 1)
    return followed, left


def _runs(frame: pd.DataFrame) -> tuple[list[tuple[int, str, list[tuple[str, int]]]], bool]:
    """(section, title, units) of a block in order."""
    runs = []
    for section, title, text in frame.sort_values("start")[["section", "title", "text"]].itertuples(index=False):
        if not runs or runs[-1][0] != section:
            runs.append((section, title, []))
        runs[-1][2].append((text, _tokens(text)))
    return runs, bool(frame["headed"].iloc[0])


def _summary(target: int, overlap: int, parent: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        runs, headed = _runs(frame)
        size, lap = _sizes(headed, target, overlap, parent)
        section, title, rows = runs[-1]
        if len(runs) > 1:  # the last section begins here, whatever came before
            cur, n, parts = [], 0, 0
            for _, done, cur, n in _packed(rows, cur, n, size, lap):
                parts += done is not None
            made = {"exit": (section, title, cur, n, parts)}
        else:
            head, total = 0, 0
            while head < len(rows) and total <= 3 * size:
                total += rows[head][1]
                head += 1
            followed, left = _followed(rows, size, lap)
            near = {j: f for j, f in followed.items() if j < head}
            made = {"section": section, "title": title, "head": rows[:head], "whole": head == len(rows), "followed": near, "left": {f[1]: left[f[1]] for f in near.values()}}
        return frame[_KEYS].head(1).assign(payload=pickle.dumps({**made, "size": size, "lap": lap}))

    return run


def _exit(made: dict, state: tuple | None) -> tuple | None:
    """The state after a block that is entered in ``state``; None where it meets no start that the block has followed."""
    if "exit" in made:
        return made["exit"]
    section, title = made["section"], made["title"]
    _, _, cur, n, parts = state if state and state[0] == section else (None, None, [], 0, 0)
    for j, done, cur, n in _packed(made["head"], cur, n, made["size"], made["lap"]):
        if done is not None:
            parts += 1
            followed = made["followed"].get(j)
            if followed and (not made["lap"] or done[-made["lap"] :] == followed[0]):
                cur, n = made["left"][followed[1]]
                return section, title, cur, n, parts + followed[2]
    return (section, title, cur, n, parts) if made["whole"] else None


def _states(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state each block is entered in, read in order as a stream; after one that can't be told, its document waits."""
    document, state, stuck, held = None, None, False, None
    for frame in frames:
        out = []
        for key in frame.itertuples(index=False):
            if held and held[0] != key.document:
                out.append((*held, True))
                held = None
            elif held:
                out.append((*held, False))
                held = None
            if key.document != document:
                document, state, stuck = key.document, None, False
            if stuck:
                continue
            after = _exit(pickle.loads(key.payload), state)
            row = (key.document, key.split, key.seq, pickle.dumps(state), after is None)
            stuck = after is None
            state = after
            if stuck:
                out.append((*row, False))
            else:
                held = row
        yield pd.DataFrame(out, columns=[*_KEYS, "state", "stuck", "final"])
    if held:
        yield pd.DataFrame([(*held, True)], columns=[*_KEYS, "state", "stuck", "final"])


def _finished(target: int, overlap: int, parent: int, exits: bool):
    """Chunks that end in a block entered in a known state, or with ``exits`` the state after it."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        runs, headed = _runs(frame)
        size, lap = _sizes(headed, target, overlap, parent)
        state, out = pickle.loads(frame["state"].iloc[0]), []
        section, title, cur, n, parts = state or (None, None, [], 0, 0)
        for own, own_title, rows in runs:
            if own != section:
                if cur:
                    out.append((section, title, parts, _assembled(cur)))
                section, title, cur, n, parts = own, own_title, [], 0, 0
            for _, done, cur, n in _packed(rows, cur, n, size, lap):
                if done is not None:
                    out.append((section, title, parts, done))
                    parts += 1
        if exits:
            return frame[_KEYS].head(1).assign(payload=pickle.dumps({"exit": (section, title, cur, n, parts)}))
        if frame["final"].iloc[0] and cur:
            out.append((section, title, parts, _assembled(cur)))
        made = pd.DataFrame(out, columns=["section", "title", "part", "text"])
        return made.assign(document=frame["document"].iloc[0], headed=headed, shift=frame["shift"].iloc[0])[["document", "headed", "shift", "section", "title", "part", "text"]]

    return run


def chunks(lines: DataFrame, target: int = segment.CHUNK_TOKENS, overlap: int = segment.CHUNK_OVERLAP, parent: int = segment.PARENT_TOKENS, chars: int = BLOCK_CHARS) -> DataFrame:
    """document, section_index, section_title, part_index and text of every chunk of (document, split, line).

    Equal to ``segment.chunked`` of ``segment.sections`` of the whole text. Null lines are empty; documents without text
    have no chunks. ``split`` orders the ranges of a document; the lines of each lie in one partition in order.
    """
    cut_up = stored(blocks(lines, chars), "blocks")
    pieces = units(cut_up, target, overlap, parent)
    sizes, payload = (target, overlap, parent), "document string, split bigint, seq bigint, payload binary"
    summaries = stored(pieces.groupBy(_KEYS).applyInPandas(_summary(*sizes), payload), "block-summaries")
    while True:
        ordered = summaries.repartition("document").sortWithinPartitions(_KEYS)
        states = stored(ordered.mapInPandas(_states, "document string, split bigint, seq bigint, state binary, stuck boolean, final boolean"), "block-states")
        stuck = states.where("stuck")
        if stuck.isEmpty():
            break
        known = pieces.join(stuck, _KEYS).groupBy(_KEYS).applyInPandas(_finished(*sizes, True), payload)
        again = stored(summaries.join(stuck, _KEYS, "left_anti").select(_KEYS + ["payload"]).unionByName(known), "block-summaries")
        removed(summaries, states)
        summaries = again
    packed = pieces.join(states, _KEYS).groupBy(_KEYS).applyInPandas(_finished(*sizes, False), "document string, headed boolean, shift int, section bigint, title string, part bigint, text string")
    rows = stored(packed, "long-chunks")
    removed(cut_up, pieces, summaries, states)
    title = F.when(F.col("section") == 0, F.lit(segment.PREFACE)).otherwise(F.col("title"))
    headed = rows.where("headed").select("document", (F.col("section") - F.col("shift")).cast("int").alias("section_index"), title.alias("section_title"), F.col("part").cast("int").alias("part_index"), "text")
    parents = rows.where("NOT headed").select("document", F.col("part").cast("int").alias("section_index"), F.concat(F.lit(segment.SECTION), (F.col("part") + 1).cast("string")).alias("section_title"), F.posexplode(segment.chunked("text", target, overlap)).alias("part_index", "text"))
    return headed.unionByName(parents)
