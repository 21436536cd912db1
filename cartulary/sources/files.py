"""Files as tables: ingestion by content hash, and texts, pages and media facts of files.

Decoders run in Arrow batches beside the executors' file reads. What a decoder can't read gives a row with a warning
and no text."""

from __future__ import annotations

import io
import itertools
import re
import struct
import wave
import zipfile
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.classify import media_type
from ..session import ship
from . import pdf

#: MIME types by suffix.
MIME = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "wav": "audio/wav", "mp3": "audio/mpeg", "mp4": "video/mp4", "txt": "text/plain", "csv": "text/csv", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"}
LEAST_NATIVE_CHARS = 20


def suffix(path: str | Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def _mime(path: str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(F.try_element_at(table, suffix(path)), F.lit("application/octet-stream"))


def ingest(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """Files below path as documents: content_sha256, filename, mimetype, media, size_bytes, status (accepted,
    duplicate, or why it was rejected). Of equal contents the first path is accepted; contents in known(content_sha256)
    are duplicates. Empty files have no row: Spark's file sources skip them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rows = files.select("path", F.sha2("content", 256).alias("content_sha256"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("ingested_at"))
    rows = rows.withColumn("mimetype", _mime("path")).withColumn("media", media_type(F.col("mimetype")))
    first = rows.where("size_bytes > 0").groupBy("content_sha256").agg(F.min("path").alias("first_path"))
    rows = rows.join(first, "content_sha256", "left")
    if known is not None:
        rows = rows.join(known.select("content_sha256", F.lit(True).alias("is_known")).distinct(), "content_sha256", "left")
    else:
        rows = rows.withColumn("is_known", F.lit(False))
    status = (
        F.when(F.col("filename") == "", "rejected: no name").when(suffix("path") == "heic", "rejected: unsupported media").when(F.col("size_bytes") == 0, "rejected: empty")
        .when(F.coalesce("is_known", F.lit(False)) | (F.col("first_path") != F.col("path")), "duplicate").otherwise("accepted")
    )
    return rows.withColumn("status", status).drop("first_path", "is_known")


def ingest_stream(spark: SparkSession, path: str, delay: str = "1 day") -> DataFrame:
    """The same as a stream: each content once within the watermark."""
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(path)
    rows = files.where("length > 0").select("path", F.sha2("content", 256).alias("content_sha256"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("ingested_at"))
    return rows.withWatermark("ingested_at", delay).dropDuplicatesWithinWatermark(["content_sha256"])


# --- texts ----------------------------------------------------------------------------------------------------------


def docx_text(data: bytes) -> str:
    """Paragraphs of the main part, one a line."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))


def xlsx_text(data: bytes) -> str:
    """Cells of all sheets: joined by a space in a row, rows by line ends."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    book = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{space}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{space}si")]
    lines = []
    for name in sorted(n for n in book.namelist() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
        for row in ElementTree.fromstring(book.read(name)).iter(f"{space}row"):
            cells = []
            for c in row.iter(f"{space}c"):
                value = c.findtext(f"{space}v") or "".join(t.text or "" for t in c.iter(f"{space}t"))
                cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
            lines.append(" ".join(x for x in cells if x))
    return "\n".join(lines)


def each_file(files: DataFrame, decode: Callable[[str, bytes], Iterable[tuple]], schema: str, most: int = 5_000) -> DataFrame:
    """(path, schema): the rows that decode(path, content) gives for each of files(path, content). One file's content and at most
    so many of its rows are held at once beside the batch that Spark sends."""
    ship(files.sparkSession)
    kinds = to_arrow_schema(T.StructType.fromDDL(f"path string, {schema}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, where in enumerate(b.column("path").to_pylist()):
                rows = ((where, *r) for r in decode(where, b.column("content")[i].as_py() or b""))
                while some := list(itertools.islice(rows, most)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*some), kinds)], schema=kinds)

    return files.select("path", "content").mapInArrow(run, f"path string, {schema}")


def any_case(kind: str) -> str:
    """A glob pattern of files of a suffix."""
    return "*." + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in kind)


def contents(spark: SparkSession, path: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    """(path, content) of the files below path, of these suffixes if any are given."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (files.option("pathGlobFilter", "{" + ",".join(map(any_case, kinds)) + "}") if kinds else files).load(path).select("path", "content")


TEXTS = {"txt": lambda data: data.decode("utf-8", "ignore"), "csv": lambda data: data.decode("utf-8", "ignore"), "docx": docx_text, "xlsx": xlsx_text, "xlsm": xlsx_text}


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, text, n_images, source, warning): a row a page for PDF, one a file for the rest. What can't be read is a row with
    a warning and no text; the contents of files without a decoder are not read at all."""

    def decode(where: str, data: bytes) -> list[tuple]:
        kind = where.rsplit(".", 1)[-1].lower()
        try:
            return [(1, TEXTS[kind](data), 0, "docx" if kind == "docx" else "xlsx" if kind.startswith("xls") else "text", None)]
        except Exception as e:  # a broken file is a row with a warning, whatever its decoder raised
            return [(1, None, 0, "none", f"{type(e).__name__}: {e}"[:200])]

    plain = each_file(contents(spark, path, tuple(TEXTS)), decode, "page int, text string, n_images int, source string, warning string")
    short = F.when(F.length("text") < LEAST_NATIVE_CHARS, "little native text")
    native = pdf.read(spark, path).select("path", F.greatest("page", F.lit(1)).alias("page"), "text", "n_images", F.when(F.col("text").isNull(), "none").otherwise("native").alias("source"), F.coalesce("warning", short).alias("warning"))
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").withColumn("kind", F.lower(F.element_at(F.split("path", r"\."), -1)))
    rest = names.where(~F.col("kind").isin("pdf", *TEXTS)).select("path", F.lit(1).alias("page"), F.lit(None).cast("string").alias("text"), F.lit(0).alias("n_images"), F.lit("none").alias("source"), F.concat(F.lit("no decoder for "), "kind").alias("warning"))
    return plain.unionByName(native).unionByName(rest)


# --- media ----------------------------------------------------------------------------------------------------------


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the head of PNG, GIF and JPEG."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return struct.unpack("<HH", data[6:10])
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 < len(data) and data[at] == 0xFF:
        mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 + size
    return None


def _tiff(data: bytes) -> tuple[bytes, str] | None:
    """The TIFF part of a JPEG's EXIF block, and its byte order."""
    at = data.find(b"Exif\0\0")
    if at < 0 or data[at + 6 : at + 8] not in (b"II", b"MM"):
        return None
    return data[at + 6 :], "<" if data[at + 6 : at + 8] == b"II" else ">"


def exif_tags(data: bytes) -> dict[str, dict[int, object]]:
    """Tags of the directories ``main``, ``exif`` and ``gps`` by number: texts, numbers, or lists of numbers. Entries that
    point outside the block are left out."""
    found = _tiff(data)
    if found is None:
        return {}
    block, order = found
    sizes = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 7: ("B", 1), 9: ("i", 4), 10: ("ii", 8)}

    def directory(at: int) -> dict[int, object]:
        out: dict[int, object] = {}
        if at + 2 > len(block):
            return out
        for i in range(struct.unpack_from(order + "H", block, at)[0]):
            place = at + 2 + 12 * i
            if place + 12 > len(block):
                break
            tag, kind, count = struct.unpack_from(order + "HHI", block, place)
            if kind not in sizes:
                continue
            shape, size = sizes[kind]
            start = place + 8 if size * count <= 4 else struct.unpack_from(order + "I", block, place + 8)[0]
            if start + size * count > len(block):
                continue
            if kind == 2:
                out[tag] = block[start : start + count].split(b"\0")[0].decode("latin-1").strip()
            else:
                values = [struct.unpack_from(order + shape, block, start + size * k) for k in range(count)]
                values = [v[0] / v[1] if len(v) == 2 and v[1] else v[0] for v in values]
                out[tag] = values[0] if count == 1 else values
        return out

    main = directory(struct.unpack_from(order + "I", block, 4)[0])
    below = {name: directory(int(main[tag])) for name, tag in (("exif", 0x8769), ("gps", 0x8825)) if isinstance(main.get(tag), (int, float))}
    return {"main": main, **below}


def gps_position(tags: dict[str, dict[int, object]]) -> tuple[float | None, float | None]:
    """Latitude and longitude in degrees, south and west being negative."""
    gps, out = tags.get("gps", {}), []
    for side, value in ((1, 2), (3, 4)):
        v = gps.get(value)
        degrees = v[0] + v[1] / 60 + v[2] / 3600 if isinstance(v, list) and len(v) == 3 else None
        out.append(-degrees if degrees is not None and gps.get(side) in ("S", "W") else degrees)
    return out[0], out[1]


def mp4_seconds(data: bytes) -> float | None:
    """Duration by the movie header of an MP4 or MOV file."""
    at = data.find(b"mvhd")
    if at < 0 or at + 32 > len(data):
        return None
    scale, units = struct.unpack_from(">IQ", data, at + 24) if data[at + 4] == 1 else struct.unpack_from(">II", data, at + 16)
    return units / scale if scale else None


def exif_time(data: bytes) -> str | None:
    """When a picture was taken, as `YYYYMMDD HHMMSS`: tag 36867, else tag 306, else the first such time of the head."""
    tags = exif_tags(data)
    said = tags.get("exif", {}).get(36867) or tags.get("main", {}).get(306)
    if isinstance(said, str) and (known := re.fullmatch(r"(\d{4}):(\d\d):(\d\d) (\d\d):(\d\d):(\d\d)", said)):
        return "{}{}{} {}{}{}".format(*known.groups())
    found = re.search(rb"(\d{4}):(\d\d):(\d\d) (\d\d):(\d\d):(\d\d)", data[:65536]) if b"Exif" in data[:4096] else None
    return "{}{}{} {}{}{}".format(*(x.decode() for x in found.groups())) if found else None


def wav_seconds(data: bytes) -> float | None:
    with wave.open(io.BytesIO(data)) as w:
        return w.getnframes() / w.getframerate() if w.getframerate() else None


def media_facts(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, taken, latitude, longitude, seconds, warning) of pictures, sounds and films."""

    def decode(_: str, data: bytes) -> list[tuple]:
        size = taken = seconds = warning = None
        position = (None, None)
        try:
            size, taken = image_size(data), exif_time(data)
            position = gps_position(exif_tags(data))
            seconds = wav_seconds(data) if data[:4] == b"RIFF" else mp4_seconds(data) if data[4:8] == b"ftyp" else None
        except Exception as e:  # as in read_texts
            warning = f"{type(e).__name__}: {e}"[:200]
        return [(*(size or (None, None)), taken, *position, seconds, warning)]

    return each_file(contents(spark, path), decode, "width long, height long, taken string, latitude double, longitude double, seconds double, warning string")


def gps_decimal(degrees: Column, minutes: Column, seconds: Column, side: Column) -> Column:
    value = degrees + minutes / 60.0 + seconds / 3600.0
    return F.when(side.isin("S", "W"), -value).otherwise(value)


def iso6709(text: Column) -> Column:
    """struct(lat, lon) of `+DD.DDDD-DDD.DDDD/`."""
    part = lambda i: F.regexp_extract(text, r"^([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)", i).try_cast("double")
    return F.struct(part(1).alias("lat"), part(2).alias("lon"))
