"""A data source of images' headers: sizes and types from the files' leading bytes, without their pixels.

    spark.dataSource.register(ImageHeaders)
    spark.read.format("image_headers").load(folder)

A partition is a group of files. Files are opened by Arrow's file systems, so a folder may be local or in a store
that these know. Of a file at most HEAD bytes are read, and more in steps of HEAD only while a JPEG's frame header hasn't
come; columns that aren't asked for cost nothing beyond that. Files come by name; a file that can't be
told is kept, with nulls.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .readers import EXTENSIONS

SCHEMA = "filename string, path string, size_bytes long, format string, width int, height int, channels int, bits int, bytes_read long"
HEAD, MOST = 1024, 1 << 20
FILES_EACH = 256

# A PNG's channels by colour type; markers of a JPEG's frames; TIFF tags.
PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
JPEG_FRAMES = frozenset([0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF])
TIFF_WIDTH, TIFF_HEIGHT, TIFF_BITS, TIFF_SAMPLES = 256, 257, 258, 277

Header = tuple[str, int, int, int, int]


class More(Exception):
    """The header goes on beyond the bytes at hand."""


def _png(b: bytes) -> Header:
    width, height, bits, colour = struct.unpack(">IIBB", b[16:26])
    return "png", width, height, PNG_CHANNELS[colour], bits


def _bmp(b: bytes) -> Header:
    width, height, _, bits = struct.unpack("<iiHH", b[18:30])
    return "bmp", width, abs(height), max(1, bits // 8), min(bits, 8)


def _jpeg(b: bytes) -> Header:
    at = 2
    while at + 9 < len(b):
        if b[at] != 0xFF:
            raise ValueError("no marker")
        kind = b[at + 1]
        if kind == 0xFF or kind == 1 or 0xD0 <= kind <= 0xD8:
            at += 1 if kind == 0xFF else 2
            continue
        if kind in JPEG_FRAMES:
            bits, height, width, channels = struct.unpack(">BHHB", b[at + 4 : at + 10])
            return "jpeg", width, height, channels, bits
        at += 2 + struct.unpack(">H", b[at + 2 : at + 4])[0]
    raise More


def _tiff(b: bytes) -> Header:
    order = {b"II": "<", b"MM": ">"}[b[:2]]
    at = struct.unpack(f"{order}I", b[4:8])[0]
    if at + 2 > len(b):
        raise More
    n = struct.unpack(f"{order}H", b[at : at + 2])[0]
    if at + 2 + 12 * n > len(b):
        raise More
    tags = {TIFF_BITS: 1, TIFF_SAMPLES: 1}
    for k in range(n):
        tag, kind, count = struct.unpack(f"{order}HHI", b[at + 2 + 12 * k : at + 10 + 12 * k])
        raw = b[at + 10 + 12 * k : at + 14 + 12 * k]
        if tag not in (TIFF_WIDTH, TIFF_HEIGHT, TIFF_BITS, TIFF_SAMPLES):
            continue
        if kind == 3 and count > 2:  # a list elsewhere: its first value
            place = struct.unpack(f"{order}I", raw)[0]
            if place + 2 > len(b):
                raise More
            raw = b[place : place + 2]
        tags[tag] = struct.unpack(f"{order}{'H' if kind == 3 else 'I'}", raw[: 2 if kind == 3 else 4])[0]
    return "tiff", tags[TIFF_WIDTH], tags[TIFF_HEIGHT], tags[TIFF_SAMPLES], tags[TIFF_BITS]


KINDS = ((b"\x89PNG\r\n\x1a\n", _png), (b"BM", _bmp), (b"\xff\xd8", _jpeg), (b"II*\0", _tiff), (b"MM\0*", _tiff))


def header(b: bytes) -> Header | None:
    """format, width, height, channels and bits a sample from a file's first bytes; None where they tell nothing. Raises More where more are needed."""
    parse = next((f for start, f in KINDS if b.startswith(start)), None)
    try:
        return parse(b) if parse else None
    except (struct.error, KeyError, ValueError, IndexError):
        return None


class Files(InputPartition):
    def __init__(self, uri: str, files: list[tuple[str, int]]) -> None:
        self.uri, self.files = uri, files


class _Reader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        from pyarrow.fs import FileSelector, FileSystem, FileType

        fs, base = FileSystem.from_uri(self.folder if "://" in self.folder else f"file://{self.folder}")
        found = [(f.path, f.size) for f in fs.get_file_info(FileSelector(base)) if f.type == FileType.File and f.extension.lower() in EXTENSIONS]
        found.sort(key=lambda f: f[0].rpartition("/")[2])
        return [Files(self.folder, found[i : i + FILES_EACH]) for i in range(0, len(found), FILES_EACH)] or [Files(self.folder, [])]

    def read(self, partition: Files) -> Iterator[tuple]:
        from pyarrow.fs import FileSystem

        fs, _ = FileSystem.from_uri(partition.uri if "://" in partition.uri else f"file://{partition.uri}")
        for path, size in partition.files:
            with fs.open_input_file(path) as stream:
                b, found = stream.read(HEAD), None
                while True:
                    try:
                        found = header(b)
                        break
                    except More:
                        more = stream.read(HEAD) if len(b) < MOST else b""
                        if not more:
                            break
                        b += more
            yield (path.rpartition("/")[2], path, size, *(found or (None,) * 5), len(b))


class ImageHeaders(DataSource):
    """format("image_headers"), load(folder): a row for each image of the folder (not of its subfolders), by name."""

    @classmethod
    def name(cls) -> str:
        return "image_headers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])
