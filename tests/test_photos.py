"""Photos from files to upright pixels: tag directories, decoding, rejects, all eight orientations."""

import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from palimpsest.operators import pixels
from palimpsest.sources import readers


def directory(order, entries, gap=0):
    """A tag directory: byte order, then the list of entries (tag, kind, value), gap bytes after its head."""
    e = ">" if order == b"MM" else "<"
    body = struct.pack(e + "H", len(entries)) + b"".join(struct.pack(e + "HHI", tag, kind, 1) + struct.pack(e + "H", value) + b"\0\0" for tag, kind, value in entries)
    return order + struct.pack(e + "HI", 42, 8 + gap) + b"\xee" * gap + body + b"\0\0\0\0"


def segment(kind, body):
    return b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body


def jpeg(*segments):
    return b"\xff\xd8" + b"".join(segments) + b"\xff\xda\x00\x02pixels\xff\xd9"


def exif(*args, **named):
    return segment(0xE1, b"Exif\0\0" + directory(*args, **named))


DECOY = struct.pack(">HHI", 0x112, 3, 1) + struct.pack(">H", 7) + b"\0\0"


def test_tag_directories(spark):
    cases = {
        "motorola": (jpeg(exif(b"MM", [(0x10F, 2, 9), (0x112, 3, 6)])), 6),
        "intel": (jpeg(exif(b"II", [(0x112, 3, 8)])), 8),
        "list further on": (jpeg(segment(0xE0, b"JFIF"), exif(b"II", [(0x100, 3, 1), (0x112, 3, 3)], gap=13)), 3),
        "other segment first": (jpeg(segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0" + DECOY), exif(b"MM", [(0x112, 3, 5)])), 5),
        "decoy in a note": (jpeg(exif(b"MM", [(0x112, 3, 2)]), segment(0xFE, DECOY)), 2),
        "decoy before": (jpeg(segment(0xFE, DECOY), exif(b"MM", [(0x10F, 2, 9)])), 1),
        "decoy in pixels": (jpeg() + exif(b"MM", [(0x112, 3, 6)]), 1),
        "wrong kind": (jpeg(exif(b"MM", [(0x112, 4, 6)])), 1),
        "out of range": (jpeg(exif(b"MM", [(0x112, 3, 9)])), 1),
        "no entries": (jpeg(exif(b"MM", [])), 1),
        "bare directory": (directory(b"II", [(0x112, 3, 4)]), 4),
        "fill bytes": (b"\xff\xd8\xff\xff" + exif(b"MM", [(0x112, 3, 6)])[0:] + b"\xff\xd9", 6),
        "cut off": (jpeg(exif(b"MM", [(0x112, 3, 6)]))[:25], 1),
        "list beyond the end": (jpeg(segment(0xE1, b"Exif\0\0MM\0*\0\0\xff\xff")), 1),
        "empty": (b"", 1),
        "text": (b"not a photo", 1),
        "long list": (jpeg(exif(b"II", [(0x8000 + i, 3, 1) for i in range(300)] + [(0x112, 3, 7)])), 7),
    }
    rows = spark.createDataFrame([(k, bytearray(v[0])) for k, v in cases.items()], "name string, content binary").unionByName(spark.createDataFrame([("null", None)], "name string, content binary"))
    got = {r.name: r.o for r in rows.select("name", readers.orientation(F.col("content")).alias("o")).collect()}
    assert got == {k: v[1] for k, v in cases.items()} | {"null": 1}


def test_every_orientation(spark):
    m = np.arange(12).reshape(3, 4)
    want = {1: m, 2: m[:, ::-1], 3: m[::-1, ::-1], 4: m[::-1], 5: m.T, 6: m[::-1].T, 7: m[::-1, ::-1].T, 8: m.T[::-1]}
    rows = [(str(o), 4, 3, y, x, int(m[y, x]), o) for o in want for y in range(3) for x in range(4)]
    px = spark.createDataFrame(rows, "img string, w int, h int, y int, x int, v int, orientation int")
    out = {o: np.zeros((3, 4) if o < 5 else (4, 3), int) for o in want}
    for r in pixels.oriented(px).collect():
        out[int(r.img)][r.y, r.x] = r.v
        assert (r.h, r.w) == out[int(r.img)].shape
    for o, image in want.items():
        assert (out[o] == image).all(), o
        one = np.zeros_like(image)
        for r in pixels.orient(px.where(F.col("orientation") == o).drop("orientation"), o).collect():
            one[r.y, r.x] = r.v
        assert (one == image).all()


def png(rgb):
    h, w, _ = rgb.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in rgb)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_photos_to_upright_pixels(spark, tmp_path):
    rgb = np.random.default_rng(1).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(png(rgb))
    image = spark._jvm.java.awt.image.BufferedImage(16, 8, 1)
    for y in range(8):
        for x in range(16):
            image.setRGB(x, y, 0xFFFFFF if x < 8 else 0)
    spark._jvm.javax.imageio.ImageIO.write(image, "jpg", spark._jvm.java.io.File(str(tmp_path / "plain.jpg")))
    plain = (tmp_path / "plain.jpg").read_bytes()
    (tmp_path / "My Font-9pt-B2.jpg").write_bytes(plain[:2] + exif(b"MM", [(0x112, 3, 6)]) + plain[2:])
    (tmp_path / "broken.jpg").write_bytes(b"\xff\xd8 broken")
    decoded, rejected = readers.photos(spark, str(tmp_path))
    told = {r.file.replace("%20", " "): r for r in decoded.drop("data").collect()}
    assert set(told) == {"a.png", "plain.jpg", "My Font-9pt-B2.jpg"} and [r.length for r in rejected.collect()] == [9]
    named = told["My Font-9pt-B2.jpg"]
    assert (named.font.replace("%20", " "), named.pt, named.letter, named.orientation) == ("My Font", 9, "B2", 6) and told["a.png"].font is None
    px = {}
    for r in readers.photo_pixels(decoded).collect():
        px.setdefault(r.img.rsplit("/", 1)[-1].replace("%20", " "), {})[r.y, r.x] = (r.v, r.w, r.h)
    want = (rgb.astype(int) @ np.array([77, 150, 29])) >> 8
    assert px["a.png"] == {(y, x): (want[y, x], 7, 5) for y in range(5) for x in range(7)}
    turned = px["My Font-9pt-B2.jpg"]
    assert {v[1:] for v in turned.values()} == {(8, 16)} and len(turned) == 128
    assert all((turned[y, x][0] > 128) == (y < 8) for y in range(16) for x in range(8) if y not in (7, 8))
    raw = spark.createDataFrame([("x.raw", 2, 3, bytearray(range(6)))], "file string, w int, h int, gray binary")
    assert {(r.y, r.x): r.v for r in readers.page_pixels(raw).collect()} == {(y, x): 2 * y + x for y in range(3) for x in range(2)}
