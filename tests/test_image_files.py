"""Headers read from leading bytes alone, and masks written whole or not at all."""

import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import components
from fieldloom.sources import image_headers as H, mask_images as M


def jpeg(width, height, app=0):
    filler = b"".join(b"\xff\xe1" + struct.pack(">H", 60_002) + b"x" * 60_000 for _ in range(app))
    return b"\xff\xd8" + filler + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, height, width, 3) + b"\0" * 9 + b"\xff\xda" + b"p" * 50_000


def tiff(width, height, order="<"):
    tags = [(256, 3, 1, width), (257, 3, 1, height), (258, 3, 3, 8 + 2 + 4 * 12 + 4), (277, 3, 1, 3)]
    body = b"".join(struct.pack(f"{order}HHI", t, k, n) + (struct.pack(f"{order}I", v) if n > 2 else struct.pack(f"{order}HH", v, 0)) for t, k, n, v in tags)
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(f"{order}I", 8) + struct.pack(f"{order}H", 4) + body + struct.pack(f"{order}I", 0) + struct.pack(f"{order}HHH", 16, 16, 16) + b"p" * 90_000


@pytest.fixture
def folder(tmp_path):
    files = {
        "b.png": M.png(30, 40, [(0, 0, 3)]) + b"p" * 99_000, "a.JPG": jpeg(640, 480), "late.jpeg": jpeg(9, 7, 2), "c.tif": tiff(100, 50), "d.tiff": tiff(101, 51, ">"),
        "e.bmp": b"BM" + b"\0" * 16 + struct.pack("<iiHH", 12, -10, 1, 24) + b"p" * 5000, "broken.png": b"\x89PNG\r\n\x1a\nxx", "empty.jpg": b"", "é.png": M.png(1, 1, []), "note.txt": b"no",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.png").write_bytes(files["b.png"])
    return tmp_path


def test_headers(spark, folder):
    spark.dataSource.register(H.ImageHeaders)
    rows = spark.read.format("image_headers").load(str(folder)).collect()
    assert [r["filename"] for r in rows] == ["a.JPG", "b.png", "broken.png", "c.tif", "d.tiff", "e.bmp", "empty.jpg", "late.jpeg", "é.png"]
    got = {r["filename"]: (r["format"], r["width"], r["height"], r["channels"], r["bits"]) for r in rows}
    assert got["a.JPG"] == ("jpeg", 640, 480, 3, 8) and got["late.jpeg"] == ("jpeg", 9, 7, 3, 8)
    assert got["b.png"] == ("png", 40, 30, 1, 8) and got["é.png"] == ("png", 1, 1, 1, 8)
    assert got["c.tif"] == ("tiff", 100, 50, 3, 16) and got["d.tiff"] == ("tiff", 101, 51, 3, 16)
    assert got["e.bmp"] == ("bmp", 12, 10, 3, 8)
    assert got["broken.png"] == got["empty.jpg"] == (None,) * 5
    for r in rows:
        assert r["size_bytes"] == os.path.getsize(folder / r["filename"])
        assert r["bytes_read"] <= (H.HEAD if r["filename"] != "late.jpeg" else 122 * H.HEAD)
    wide = spark.read.format("image_headers").load(f"file://{folder}").filter("width > 90").select("filename", (F.col("width") * F.col("height")).alias("n"))
    assert {tuple(r) for r in wide.collect()} == {("a.JPG", 307200), ("c.tif", 5000), ("d.tiff", 5151)}


def test_headers_of_an_empty_folder(spark, tmp_path):
    spark.dataSource.register(H.ImageHeaders)
    assert spark.read.format("image_headers").load(str(tmp_path)).count() == 0


def masks(spark):
    rng = np.random.default_rng(3)
    ms = {"a": rng.random((11, 17)) < 0.5, "é b": np.ones((4, 6), bool), "none": np.zeros((3, 5), bool)}
    px = spark.createDataFrame([(k, int(y), int(x)) for k, m in ms.items() for y, x in zip(*np.nonzero(m))], "name string, y int, x int")
    runs = components.runs(px, ["name"]).groupBy("name").agg(F.collect_list(F.struct(F.col("y"), F.col("x0"), F.col("x1"))).alias("runs"))
    sizes = spark.createDataFrame([(k, *m.shape) for k, m in ms.items()], "name string, height int, width int")
    return ms, sizes.join(runs, "name", "left").select("name", "height", "width", "runs").repartition(2)


def pixels(data):
    import zlib

    at, body, shape = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + part)
        shape = struct.unpack(">II", part[:8]) if kind == b"IHDR" else shape
        body += part if kind == b"IDAT" else b""
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(shape[1], shape[0] + 1)
    assert not rows[:, 0].any()
    return rows[:, 1:]


def test_masks_are_read_back_equal(spark, tmp_path):
    spark.dataSource.register(M.MaskImages)
    ms, rows = masks(spark)
    rows.write.format("mask_images").mode("append").save(str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == sorted([*(f"{k}.png" for k in ms), M.INDEX])
    for k, m in ms.items():
        assert (pixels((tmp_path / "out" / f"{k}.png").read_bytes()) == 255 * m).all()
    index = [json.loads(x) for x in (tmp_path / "out" / M.INDEX).read_text().splitlines()]
    assert {r["file"]: (r["height"], r["width"], r["pixels"]) for r in index} == {f"{k}.png": (*m.shape, m.sum()) for k, m in ms.items()}
    spark.dataSource.register(H.ImageHeaders)
    assert spark.read.format("image_headers").load(str(tmp_path / "out")).filter("format = 'png'").count() == 3


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(M.MaskImages)
    _, rows = masks(spark)
    bad = rows.withColumn("height", F.when(F.col("name") == "none", F.raise_error(F.lit("no")).cast("int")).otherwise(F.col("height")))
    with pytest.raises(Exception):
        bad.write.format("mask_images").mode("append").save(str(tmp_path / "out"))
    with pytest.raises(Exception):
        rows.union(rows).write.format("mask_images").mode("append").save(str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or os.listdir(tmp_path / "out") == []
