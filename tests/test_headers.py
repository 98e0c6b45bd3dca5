"""Headers of each format, built by hand, and what their orientation asks for."""

import struct
import zlib

import numpy as np
import pytest

from inkfold.functions import raster
from inkfold.sources import images
from inkfold.sources.headers import Header, header, tiff_tags, upright


def tiff(order="<", width=30, height=20, orientation=None, wide=False):
    tags = [(256, width), (257, height)] + ([(274, orientation)] if orientation else [])
    out = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "IH", 8, len(tags))
    for tag, value in tags:
        field = struct.pack(order + "I", value) if wide else struct.pack(order + "H", value) + b"\0\0"
        out += struct.pack(order + "HHI", tag, 4 if wide else 3, 1) + field
    return out + b"\0\0\0\0"


def exif(orientation, order=">"):
    return b"Exif\0\0" + tiff(order, orientation=orientation)


def jpeg(width=30, height=20, orientation=None, fill=0):
    out = b"\xff\xd8\xff\xe0\0\x10JFIF\0" + bytes(9)
    if orientation:
        body = exif(orientation)
        out += b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body
    out += b"\xff\xc4\0\x05abc" + b"\xff" * fill  # a table, and fill bytes
    return out + b"\xff\xc2\0\x0b\x08" + struct.pack(">HH", height, width) + b"\x01\x01\x11\0" + b"\xff\xda"


def png(width=30, height=20, orientation=None):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + bytes(4)
    out = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
    return out + (chunk(b"eXIf", tiff(orientation=orientation)) if orientation else b"") + chunk(b"IDAT", b"x" * 40)


def webp(kind, body):
    return b"RIFF" + struct.pack("<I", len(body) + 12) + b"WEBP" + kind + struct.pack("<I", len(body)) + body


def vp8x(width, height, orientation=None):
    out = webp(b"VP8X", bytes([8 if orientation else 0, 0, 0, 0]) + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little"))
    if orientation:
        body = tiff(orientation=orientation)
        out += b"ALPH" + struct.pack("<I", 3) + b"abc\0" + b"EXIF" + struct.pack("<I", len(body)) + body
    return out


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + kind + body


def avif(width=30, height=20, turns=None, mirror=None, large=False, wide=False):
    """The primary item is 2; item 1 is a smaller picture."""
    ispe = lambda w, h: box(b"ispe", bytes(4), struct.pack(">II", w, h))
    properties, mine = [ispe(5, 5), ispe(width, height)], [2]
    for kind, value in ((b"irot", turns), (b"imir", mirror)):
        if value is not None:
            properties.append(box(kind, bytes([value])))
            mine.append(len(properties))
    place = (lambda p: struct.pack(">H", p | 0x8000)) if wide else (lambda p: bytes([p | 0x80]))
    item = (lambda i: struct.pack(">I", i)) if large else (lambda i: struct.pack(">H", i))
    links = struct.pack(">I", 2) + item(1) + bytes([1]) + place(1) + item(2) + bytes([len(mine)]) + b"".join(map(place, mine))
    ipma = box(b"ipma", bytes([large, 0, 0, wide]), links)
    pitm = box(b"pitm", bytes([large, 0, 0, 0]), item(2))
    return box(b"ftyp", b"avif", bytes(4), b"mif1") + box(b"meta", bytes(4), box(b"hdlr", bytes(20)), pitm, box(b"iprp", box(b"ipco", *properties), ipma)) + box(b"mdat", b"x" * 50)


@pytest.mark.parametrize("data,kind", [
    (png(), "png"), (b"GIF89a" + struct.pack("<HH", 30, 20) + b"x", "gif"), (b"BM" + bytes(12) + struct.pack("<Iii", 40, 30, -20), "bmp"), (b"BM" + bytes(12) + struct.pack("<IHH", 12, 30, 20), "bmp"),
    (jpeg(), "jpeg"), (jpeg(fill=3), "jpeg"), (webp(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + struct.pack("<HH", 30 | 0x4000, 20 | 0x8000)), "webp"),
    (webp(b"VP8L", b"\x2f" + struct.pack("<I", 29 | 19 << 14 | 1 << 28)), "webp"), (vp8x(30, 20), "webp"), (tiff("<"), "tiff"), (tiff(">", wide=True), "tiff"),
    (avif(), "avif"), (avif(large=True, wide=True), "avif"),
])
def test_sizes_of_every_format(data, kind):
    assert header(data) == Header(f"image/{kind}", 30, 20)
    for end in range(len(data)):  # cut off anywhere: the same answer or none
        assert header(data[:end]) in (None, Header(f"image/{kind}", 30, 20))


@pytest.mark.parametrize("orientation", range(1, 9))
def test_orientation_of_every_format(orientation):
    size = (20, 30) if orientation >= 5 else (30, 20)
    turns = {1: (None, None), 2: (None, 1), 3: (2, None), 4: (None, 0), 5: (1, 0), 6: (3, None), 7: (1, 1), 8: (1, None)}[orientation]
    for data in (png(orientation=orientation), jpeg(orientation=orientation), vp8x(30, 20, orientation), tiff(orientation=orientation), tiff(">", orientation=orientation), avif(30, 20, *turns)):
        found = header(data)
        assert found.orientation == orientation and found.upright == size
    # a corner that is marked ends where the tag says: rows and columns of the stored image, by its definition
    stored = np.zeros((4, 6), np.uint8)
    stored[0, 0], stored[0, -1] = 1, 2
    turned = upright(stored, orientation)
    first, second = {1: ((0, 0), (0, -1)), 2: ((0, -1), (0, 0)), 3: ((-1, -1), (-1, 0)), 4: ((-1, 0), (-1, -1)), 5: ((0, 0), (-1, 0)), 6: ((0, -1), (-1, -1)), 7: ((-1, -1), (0, -1)), 8: ((-1, 0), (0, 0))}[orientation]
    assert turned[first] == 1 and turned[second] == 2 and turned.shape == ((6, 4) if orientation >= 5 else (4, 6))


def test_odd_tags_and_no_images():
    assert header(jpeg(orientation=9)).orientation == 1 and header(b"") is None and header(None) is None and header(b"%PDF-1.7") is None
    assert tiff_tags(b"II*\0" + struct.pack("<I", 10**9)) == {} and header(png(width=0)) is None
    assert header(b"\xff\xd8\xff\xd9") is None and header(avif()[:60]) is None


def test_library_probes_first_bytes_and_pages_stand_upright(spark, tmp_path):
    image = np.arange(6 * 4 * 3, dtype=np.uint8).reshape(6, 4, 3)
    plain = raster.png(image)
    at = plain.index(b"IDAT") - 4
    tagged = plain[:at] + struct.pack(">I", len(tiff(orientation=6))) + b"eXIf" + tiff(orientation=6)
    tagged += struct.pack(">I", zlib.crc32(tagged[-4 - len(tiff(orientation=6)) :])) + plain[at:]
    (tmp_path / "a.png").write_bytes(plain)
    (tmp_path / "b b.png").write_bytes(tagged)
    (tmp_path / "c.jpg").write_bytes(jpeg(3000, 2000, 8) + bytes(300_000))
    (tmp_path / "d.avif").write_bytes(b"broken")
    (tmp_path / "e.txt").write_bytes(plain)
    got = {r.name: (r.folder, r.size, r.width, r.height) for r in images.library(spark, str(tmp_path), "f").collect()}
    assert got == {"a.png": ("f", len(plain), 4, 6), "b b.png": ("f", len(tagged), 6, 4), "c.jpg": ("f", len(jpeg(3000, 2000, 8)) + 300_000, 2000, 3000)}
    pages = {r.path.rpartition("/")[2]: r for r in images.upright_pages(spark, str(tmp_path)).collect()}
    turned = {n: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3)[..., ::-1] for n, r in pages.items() if n.endswith("png")}
    assert (turned["a.png"] == image).all() and (turned["b b.png"] == np.rot90(image, -1)).all()
