"""WARC archives written and read through Spark's own file access.

Writing: each record is one gzip member. The last byte of a member is the highest of its size, 0 for records below 16
MiB, so members less that byte are written as lines whose separator is a zero byte, which puts it back: the files are
plain ``.warc.gz`` bytes. A record of 16 MiB or more is followed by an empty member, which ends in a zero byte too.

Reading: the files are split into byte ranges like lines of text, parted by the gzip magic. A task owns the candidates
whose magic starts in its range. A candidate counts as a member only if its gzip header and the WARC header inside it
decode; other magics are chance bytes within a member, and the pieces they part are put together again, across the
ends of ranges by a small second step. Spark's reader would unpack files named .gz as a whole, so it is told of no such
codec.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, by_key, cut

MAGIC = b"\x1f\x8b\x08"
#: Payloads of fewer bytes are never replaced by a revisit.
LEAST_REVISIT = 1000
_EMPTY = MAGIC + b"\x00\x00\x00\x00\x00\x00\xff\x03\x00" + bytes(8)
#: Payload bytes handed to a task's writer at once.
BATCH_BYTES = 8 << 20


def _member(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    packed = packer.compress(raw) + packer.flush()
    return packed if packed[-1] == 0 else packed + _EMPTY


def _record(page: dict) -> bytes:
    payload = page["payload"] if page["record_type"] == "response" else b""
    head = [
        ("WARC-Type", page["record_type"]),
        ("WARC-Record-ID", f"<urn:page:{page['page_id']}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", " ".join((page["url"] or "").split())),
        ("WARC-Payload-Digest", f"sha1:{page['payload_digest']}"),
        ("X-Payload-Length", str(page["payload_bytes"])),
        ("Content-Type", "text/html"),
        ("Content-Length", str(len(payload))),
    ]
    if page["record_type"] == "revisit":
        head += [("WARC-Refers-To", f"<urn:page:{page['refers_to']}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + payload + b"\r\n\r\n"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines, size = [], 0
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            lines.append(_member(_record(dict(zip(batch.schema.names, row, strict=True))))[:-1])
            size += len(lines[-1])
            if size > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], ["line"])
                lines, size = [], 0
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], ["line"])


def plan_records(pages: DataFrame) -> DataFrame:
    """What is written for each row of ``pages`` (page_id, url, html): payload, its size and digest, record type, refers_to.

    Of records with equal payloads of at least 1000 bytes the one of the largest page_id is the response; others refer
    to it. A null html is an empty payload, which like all small ones is a response. Rows that share the largest page_id
    are all responses; a null page_id refers to the largest, if there is one. The digests alone are aggregated; payloads
    meet them where they are, or beyond ``BROADCAST_ROWS`` repeated digests in a shuffle that hot ones take no part in.
    Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    large = rows.where(F.col("payload_bytes") >= LEAST_REVISIT)
    last = cut(large.groupBy("payload_digest").agg(F.max("page_id").alias("last_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    n_last = last.count()
    if n_last <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(last), "payload_digest", "left")
    else:
        joined = by_key(rows, last, "payload_digest", "copies", rows.count())
    repeated = (F.col("last_id") != F.col("page_id")) | (F.col("page_id").isNull() & F.col("last_id").isNotNull())
    revisit = F.coalesce(repeated & (F.col("payload_bytes") >= LEAST_REVISIT), F.lit(False))
    return joined.select(
        "page_id", "url", "payload", "payload_digest", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("last_id")).alias("refers_to")
    )


def write_warc(pages: DataFrame, path: str) -> None:
    """Write ``pages`` to ``path`` as gzipped WARC files. The commit protocol of Spark's writers makes retries safe."""
    lines = plan_records(pages).mapInArrow(_lines, "line binary")
    lines.select(F.col("line").cast("string").alias("value")).write.option("lineSep", "\x00").text(path)


def _parse(raw: bytes) -> dict | None:
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    if not fields.get("content-length", "").isdigit():
        return None
    fields["payload"] = rest[: int(fields["content-length"])]
    return fields


def _starts_record(piece: bytes) -> bool:
    """Whether gzip and WARC headers decode from the start of a candidate."""
    try:
        begin = zlib.decompressobj(31).decompress(piece[: 1 << 12], 64)
    except zlib.error:
        return False
    return begin.startswith(b"WARC/")


def _unpack(data: bytes) -> bytes | None:
    """The content of all members in ``data``; none if the last isn't whole."""
    out = []
    while data[:3] == MAGIC:
        engine = zlib.decompressobj(31)
        try:
            out.append(engine.decompress(data))
        except zlib.error:
            return None
        if not engine.eof:
            return None
        data = engine.unused_data
    return b"".join(out) if out else None


_READ = pa.schema([("file", pa.string()), ("place", pa.int64()), ("nth", pa.int64()), ("loose", pa.binary()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


#: (file, place, nth, loose, fields, payload) of a record or a loose piece.
Row = tuple[str, int, int, bytes | None, list[tuple[str, str]] | None, bytes | None]


def _batched(rows: Iterator[Row]) -> Iterator[pa.RecordBatch]:
    """Batches of up to 256 rows and about ``BATCH_BYTES``."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += len(row[3] or b"") + len(row[5] or b"")
        if len(some) == 256 or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), _READ, strict=True)], schema=_READ)
            some, size = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), _READ, strict=True)], schema=_READ)


def _row(file: str, place: int, nth: int, loose: bytes | None = None, record: dict | None = None) -> Row:
    if record is None:
        return file, place, nth, loose, None, None
    return file, place, nth, None, [(k, v) for k, v in record.items() if k != "payload"], record["payload"]


def _assemble(pieces: Iterator[tuple[str, int, bytes]]) -> Iterator[Row]:
    """Records from pieces in the order of the file. Pieces before a range's first record, and a last record that isn't
    whole, come out loose, with their range and order."""
    where, nth, open_pieces = None, 0, None
    for file, place, piece in pieces:
        if (file, place) != where:
            if open_pieces is not None:
                yield _row(*where, nth, b"".join(open_pieces))
            where, nth, open_pieces = (file, place), 0, None
        nth += 1
        if _starts_record(MAGIC + piece):
            if open_pieces is not None:
                yield _row(file, place, nth - 1, b"".join(open_pieces))
            open_pieces = [MAGIC + piece]
        elif open_pieces is not None:
            open_pieces.append(MAGIC + piece)
        else:
            yield _row(file, place, nth, (MAGIC if nth > 1 or place else b"") + piece)
            continue
        whole = _unpack(b"".join(open_pieces))
        if whole is not None and (record := _parse(whole)) is not None:
            yield _row(file, place, nth, record=record)
            open_pieces = None
    if open_pieces is not None:
        yield _row(*where, nth, b"".join(open_pieces))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def pieces():
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)

    yield from _batched(_assemble(pieces()))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Loose pieces sorted by file, range and order: tails of records and what continues them in the next range."""

    def rows() -> Iterator[Row]:
        open_piece = None
        for batch in batches:
            for file, place, nth, loose in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if _starts_record(loose):
                    open_piece = [file, loose]
                elif open_piece is not None and open_piece[0] == file:
                    open_piece[1] += loose
                else:
                    continue
                whole = _unpack(open_piece[1])
                if whole is not None and (record := _parse(whole)) is not None:
                    yield _row(file, place, nth, record=record)
                    open_piece = None

    yield from _batched(rows())


def _raw_options(spark: SparkSession) -> dict[str, str]:
    """Reader options by which files named .gz are read as they are, in ranges.

    Hadoop takes the codec of the greatest suffix, written backwards, that sorts before a file's name written backwards.
    A codec for a suffix that no name has, but that sorts right after that of gzip, leaves such files without any. The
    shaded build of Hadoop has renamed the suffix's key.
    """
    options = {"io.compression.codecs": "org.apache.hadoop.io.compress.PassthroughCodec"}
    options |= {f"{at}io.compress.passthrough.extension": "-\x01.gz" for at in ("", "org.apache.hadoop.shaded.")}
    jvm, conf = spark.sparkContext._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for key, value in options.items():
        conf.set(key, value)
    if jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(jvm.org.apache.hadoop.fs.Path("/a.warc.gz")) is not None:
        raise RuntimeError("this Hadoop unpacks .gz files before they can be read in ranges")
    return options


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record under ``path``: fields (header names in lower case to values) and payload.

    Files of gzip members, one or more to a record, of any name and from any writer; what doesn't decode as a WARC
    record is left out. Records are unpacked once, into a table in the shared folder; one that goes on in the next range
    is put together from there. A record of any length is held whole by one task. Equal records are all returned.
    """
    text = spark.read.options(**_raw_options(spark)).option("lineSep", MAGIC.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)
    raw = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("place"), F.col("value").cast("binary").alias("piece"))
    kinds = "file string, place bigint, nth bigint, loose binary, fields map<string,string>, payload binary"
    read = cut(raw.mapInArrow(_ranges, kinds))
    loose = read.where("octet_length(loose) > 0").select("file", "place", "nth", "loose")
    again = loose.repartition("file").sortWithinPartitions("file", "place", "nth").mapInArrow(_joined, kinds)
    return read.where("loose IS NULL").unionByName(again).select("fields", "payload")


def pages_of(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of records that ``write_warc`` wrote.

    Size and digest of a response are those of the payload as read; a revisit, which has none, states its own.
    """
    response = F.col("fields")["warc-type"] == "response"
    number = lambda f: F.regexp_extract(F.col("fields")[f], r"^<urn:page:(-?\d+)>$", 1)
    as_id = lambda f: F.when(F.length(number(f)) > 0, number(f).cast("long"))
    return records.select(
        as_id("warc-record-id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("fields")["x-payload-length"].cast("long")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.substring_index(F.col("fields")["warc-payload-digest"], ":", -1)).alias("payload_digest"),
        F.col("fields")["warc-type"].alias("record_type"),
        as_id("warc-refers-to").alias("refers_to"),
    )


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages
), x AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM p
), y AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS last_id FROM x)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN last_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN last_id = page_id THEN NULL ELSE last_id END AS refers_to
FROM y
"""
