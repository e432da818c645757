"""A data sink of masks as PNG images, written in two phases: all files and their index appear, or none.

    spark.dataSource.register(MaskImages)
    rows.write.format("mask_images").mode("append").save(folder)

A row is an image of one class: name, height, width and its runs (y, x0, x1, as components give them). A task writes its images
under a name of its attempt; the commit moves those of the attempts that count to their places and writes
the index last, as JSON lines. A failed write removes what its attempts left. Files go through Arrow's file systems.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = "name string, height int, width int, runs array<struct<y:int,x0:int,x1:int>>"
INDEX = "index.jsonl"


def png(height: int, width: int, runs) -> bytes:
    """A grey PNG of one byte a pixel: 255 in the runs, else 0. Rows are made one by one."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    by_row: dict[int, list[tuple[int, int]]] = {}
    for y, x0, x1 in runs or ():
        if 0 <= y < height:
            by_row.setdefault(y, []).append((max(0, x0), min(width - 1, x1)))
    packer, body = zlib.compressobj(), []
    for y in range(height):
        row = bytearray(width + 1)  # the first byte: no filter
        for x0, x1 in by_row.get(y, ()):
            row[x0 + 1 : x1 + 2] = b"\xff" * max(0, x1 - x0 + 1)
        body.append(packer.compress(bytes(row)))
    body.append(packer.flush())
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", b"".join(body)) + chunk(b"IEND", b"")


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str, int, int, int]]  # temporary name, name, height, width, pixels


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool) -> None:
        self.folder, self.overwrite = folder if "://" in folder else f"file://{folder}", overwrite
        self.job = f"_{uuid.uuid4().hex}"

    def _open(self):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.folder)

    def write(self, iterator: Iterator) -> Written:
        fs, base = self._open()
        files = []
        fs.create_dir(f"{base}/{self.job}", recursive=True)
        for r in iterator:
            at = f"{self.job}/{uuid.uuid4().hex}"
            with fs.open_output_stream(f"{base}/{at}") as out:
                out.write(png(r["height"], r["width"], r["runs"]))
            files.append((at, f"{r['name']}.png", r["height"], r["width"], sum(x1 - x0 + 1 for _, x0, x1 in r["runs"] or ())))
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, base = self._open()
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f[1])
        if len({f[1] for f in files}) < len(files):
            self.abort(messages)
            raise ValueError("two images of one name")
        for at, name, *_ in files:
            fs.move(f"{base}/{at}", f"{base}/{name}")
        with fs.open_output_stream(f"{base}/{INDEX}") as out:
            for _, name, height, width, pixels in files:
                out.write((json.dumps({"file": name, "height": height, "width": width, "pixels": pixels}, ensure_ascii=False) + "\n").encode())
        self._clear(fs, base)

    def abort(self, messages: list) -> None:
        self._clear(*self._open())

    def _clear(self, fs, base: str) -> None:
        from pyarrow.fs import FileType

        if fs.get_file_info(f"{base}/{self.job}").type != FileType.NotFound:
            fs.delete_dir(f"{base}/{self.job}")


class MaskImages(DataSource):
    """format("mask_images"), save(folder)."""

    @classmethod
    def name(cls) -> str:
        return "mask_images"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)
