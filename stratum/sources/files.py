"""Office and text files as sources: ``binaryFile`` rows parsed where they are read, errors as a column."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES, MAX_CHARS, MAX_PAGES = 20 * 1024 * 1024, 20_000_000, 3_000
MAX_MEMBERS, MAX_UNPACKED = 8_000, 120 * 1024 * 1024
# File kinds, and the XML names of the office formats.
TEXT_KINDS = ("txt", "md", "csv", "json", "log")
LEGACY_KINDS = ("doc", "ppt", "rtf", "odt", "odp")
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SCHEMA = "name string, text string, source_format string, metadata map<string,bigint>, source_bytes bigint, error string"

_PARSED = pa.schema([("name", pa.string()), ("text", pa.string()), ("source_format", pa.string()), ("metadata", pa.map_(pa.string(), pa.int64())), ("source_bytes", pa.int64()), ("error", pa.string())])
#: Characters of parsed texts that a task passes on at once.
HELD_CHARS = 1 << 22


class ParseError(ValueError):
    """A file that can't be read as what its name says."""


@dataclass
class Parsed:
    text: str
    source_format: str
    metadata: dict[str, int] = field(default_factory=dict)


def normalised(text: str) -> str:
    text = text.replace("\x00", "").strip()
    if not text:
        raise ParseError("no text in the file")
    if len(text) > MAX_CHARS:
        raise ParseError(f"more than {MAX_CHARS} characters of text")
    return text


class Package:
    """A zip package whose size is checked before anything is unpacked."""

    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise ParseError("the file is damaged: no zip package") from e
        entries = self.zip.infolist()
        if len(entries) > MAX_MEMBERS or sum(e.file_size for e in entries) > MAX_UNPACKED:
            raise ParseError("the package is too large when unpacked")
        self.names = {e.filename for e in entries}

    def xml(self, member: str) -> ElementTree.Element:
        if member not in self.names:
            raise ParseError(f"{member} is missing in the package")
        try:
            return ElementTree.fromstring(self.zip.read(member))
        except ElementTree.ParseError as e:
            raise ParseError(f"{member} is no XML") from e


def parse_text(data: bytes, kind: str = "txt") -> Parsed:
    """UTF-8 with or without a mark, else UTF-16; the latter accepts most data of even length, whatever it is."""
    for encoding in ("utf-8-sig", "utf-16"):
        try:
            return Parsed(normalised(data.decode(encoding)), kind)
        except UnicodeDecodeError:
            continue
    raise ParseError("neither UTF-8 nor UTF-16")


def _level_in(label: str) -> int | None:
    found = re.search(r"(?:heading|标题)\s*([1-6])", label, re.IGNORECASE)
    return int(found[1]) if found else None


class _Word:
    def __init__(self, package: Package):
        self.levels: dict[str, int] = {}
        if "word/styles.xml" in package.names:
            for style in package.xml("word/styles.xml").iter(f"{WORD}style"):
                key, name = style.get(f"{WORD}styleId", ""), style.find(f"{WORD}name")
                level = _level_in(f"{key} {'' if name is None else name.get(f'{WORD}val', '')}")
                if key and level and style.get(f"{WORD}type") == "paragraph":
                    self.levels[key] = level

    def level(self, paragraph: ElementTree.Element) -> int | None:
        """An outline level from 1 to 6 counts first, then the style's, then the number in the style's name."""
        outline, style = (paragraph.find(f"{WORD}pPr/{WORD}{tag}") for tag in ("outlineLvl", "pStyle"))
        stated = "" if outline is None else outline.get(f"{WORD}val", "")
        if re.fullmatch(r"\s*[0-5]\s*", stated):
            return int(stated) + 1
        if style is None:
            return None
        key = style.get(f"{WORD}val", "")
        return self.levels.get(key) or _level_in(key)

    @staticmethod
    def text(paragraph: ElementTree.Element) -> str:
        marks = {f"{WORD}tab": "\t", f"{WORD}br": "\n", f"{WORD}cr": "\n"}
        return "".join((x.text or "") if x.tag == f"{WORD}t" else marks.get(x.tag, "") for x in paragraph.iter()).strip()


def parse_docx(data: bytes) -> Parsed:
    package = Package(data)
    body = package.xml("word/document.xml").find(f"{WORD}body")
    if body is None:
        raise ParseError("the document has no body")
    word, blocks, counts = _Word(package), [], {"paragraphs": 0, "tables": 0}
    for block in body:
        if block.tag == f"{WORD}p" and (text := word.text(block)):
            counts["paragraphs"] += 1
            level = word.level(block)
            blocks.append(f"{'#' * level} {text}" if level else text)
        elif block.tag == f"{WORD}tbl":
            counts["tables"] += 1
            cells = [[" ".join(filter(None, (word.text(p) for p in cell.iter(f"{WORD}p")))) for cell in row.iter(f"{WORD}tc")] for row in block.iter(f"{WORD}tr")]
            blocks.append("\n".join([f"## 表格 {counts['tables']}\n", *(" | ".join(row) for row in cells if any(row))]))
    return Parsed(normalised("\n\n".join(blocks)), "docx", counts)


def parse_pptx(data: bytes) -> Parsed:
    """Slides in the order of their numbers but counted from 1, with their notes."""
    package = Package(data)
    slides = sorted((n for n in package.names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml$", n)[1]))
    if not slides:
        raise ParseError("no slides in the presentation")

    def lines(member: str) -> list[str]:
        return [t for x in package.xml(member).iter(f"{DRAWING}t") if (t := (x.text or "").strip())]

    def notes_of(slide: str, number: int) -> str | None:
        links = f"ppt/slides/_rels/{posixpath.basename(slide)}.rels"
        if links in package.names:
            for link in package.xml(links):
                if link.get("Type", "").endswith("/notesSlide") and link.get("Target"):
                    return posixpath.normpath(posixpath.join("ppt/slides", link.get("Target")))
        return f"ppt/notesSlides/notesSlide{number}.xml"

    blocks, noted = [], 0
    for number, slide in enumerate(slides, 1):
        parts = [f"## 第 {number} 页", *(["\n".join(t)] if (t := lines(slide)) else [])]
        notes = notes_of(slide, number)
        said = [t for t in lines(notes) if t != str(number)] if notes in package.names else []
        if said:
            noted += 1
            parts.append("### 演讲者备注\n\n" + "\n".join(said))
        blocks.append("\n\n".join(parts))
    return Parsed(normalised("\n\n".join(blocks)), "pptx", {"slides": len(slides), "slides_with_notes": noted})


def parse_pdf(data: bytes) -> Parsed:
    """The text layer of each page; needs ``pypdf``, which is optional."""
    try:
        import pypdf
    except ImportError as e:
        raise ParseError("reading PDF needs the package pypdf") from e
    try:
        reader = pypdf.PdfReader(io.BytesIO(data))
        if reader.is_encrypted and not reader.decrypt(""):
            raise ParseError("the PDF is locked by a password")
        n = len(reader.pages)
        if n > MAX_PAGES:
            raise ParseError(f"more than {MAX_PAGES} pages")
        texts = [(i, (page.extract_text() or "").strip()) for i, page in enumerate(reader.pages, 1)]
    except ParseError:
        raise
    except Exception as e:
        raise ParseError("the PDF can't be read") from e
    if not any(t for _, t in texts):
        raise ParseError("the PDF has no text layer; use OCR first")
    return Parsed(normalised("\n\n".join(f"## 第 {i} 页\n\n{t}" for i, t in texts if t)), "pdf", {"pages": n})


def _legacy(data: bytes) -> Parsed:
    raise ParseError("old office formats have to be converted first")


PARSERS: dict[str, Callable[[bytes], Parsed]] = {**{k: (lambda data, k=k: parse_text(data, k)) for k in TEXT_KINDS}, **dict.fromkeys(LEGACY_KINDS, _legacy), "docx": parse_docx, "pptx": parse_pptx, "pdf": parse_pdf}


def parse_file(name: str, data: bytes, parsers: dict[str, Callable[[bytes], Parsed]] | None = None, most: int = MAX_BYTES) -> Parsed:
    """Parse by the extension of the file's bare name. ``parsers`` adds kinds, or converters of old ones."""
    kind = posixpath.basename(name.replace("\\", "/")).rpartition(".")[2].lower()
    known = {**PARSERS, **(parsers or {})}
    if kind not in known:
        raise ParseError(f"files of the kind .{kind} aren't supported")
    if not data:
        raise ParseError("the file is empty")
    if len(data) > most:
        raise ParseError(f"the file has more than {most} bytes")
    return known[kind](data)


def parse_files(files: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """Parsed rows of ``files`` (path, content); a file that fails has its error and no text."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PARSED, strict=True)], schema=_PARSED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for path, content in zip(batch["path"], batch["content"], strict=True):
                name, data = posixpath.basename(path.as_py()), content.as_py() or b""
                try:
                    p, error = parse_file(name, data, most=most), None
                except ParseError as e:
                    p, error = Parsed(None, None, {}), str(e)  # type: ignore[arg-type]
                rows.append((name, p.text, p.source_format, list(p.metadata.items()), len(data), error))
                size += len(p.text or "")
                if size >= HELD_CHARS:
                    yield made(rows)
                    rows, size = [], 0
            if rows:
                yield made(rows)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Parsed files under a path; the size guard is applied to the listing, so that oversized files aren't opened."""
    files = spark.read.format("binaryFile").load(path)
    large = files.where(F.col("length") > MAX_BYTES).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("source_format"), F.lit(None).cast("map<string,bigint>").alias("metadata"), F.col("length").alias("source_bytes"), F.lit(f"the file has more than {MAX_BYTES} bytes").alias("error"))
    return parse_files(files.where(F.col("length") <= MAX_BYTES)).unionByName(large)


def uploads(rows: DataFrame) -> DataFrame:
    """Parsed rows of uploads (name, content_base64); content that isn't base64 becomes an error."""
    decoded = rows.select(F.col("name").alias("path"), F.expr("try_to_binary(content_base64, 'base64')").alias("content"))
    return parse_files(decoded)


def as_sources(parsed: DataFrame) -> DataFrame:
    """Good rows as sources for the index, in the order of their names; names must be distinct."""
    good = parsed.where("error IS NULL")
    return good.select(F.xxhash64("name").alias("source_ord"), F.col("name").alias("document"), "text", "source_bytes")


def text_source(spark: SparkSession, text: str, name: str = "document.txt") -> DataFrame:
    if not text.strip():
        raise ParseError("the text is empty")
    return spark.createDataFrame([(0, name, text, len(text.encode()))], "source_ord bigint, document string, text string, source_bytes bigint")
