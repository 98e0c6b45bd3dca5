"""What the first bytes of an image file say: its type, its size, and how it has to be turned to stand upright.

Only headers are parsed, so the first `HEAD` bytes of a file are enough for all but odd files; where they
end too early the answer is null, never wrong. An orientation is the tag's value, 1 (as stored) to 8.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

HEAD = 1 << 16
#: Tags of a TIFF directory.
_WIDTH, _HEIGHT, _ORIENTATION = 256, 257, 274
#: Bytes and codes of the field types that hold whole numbers.
_FIELDS = {1: "B", 3: "H", 4: "I"}


@dataclass(frozen=True)
class Header:
    """type, size as stored, and the orientation."""

    type: str
    width: int
    height: int
    orientation: int = 1

    @property
    def upright(self) -> tuple[int, int]:
        """Width and height once it stands upright."""
        return (self.height, self.width) if self.orientation >= 5 else (self.width, self.height)


def _sound(orientation: int | None) -> int:
    return orientation if orientation in range(1, 9) else 1


def tiff_tags(data: bytes) -> dict[int, int]:
    """The whole numbers of the first directory, by tag; {} if it is none."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        return {}
    tags = {}
    try:
        at = struct.unpack_from(order + "I", data, 4)[0]
        for i in range(struct.unpack_from(order + "H", data, at)[0]):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind in _FIELDS and n == 1:
                tags[tag] = struct.unpack_from(order + _FIELDS[kind], data, at + 10 + 12 * i)[0]
    except struct.error:
        pass
    return tags


def _exif(data: bytes) -> int:
    return _sound(tiff_tags(data.removeprefix(b"Exif\0\0")).get(_ORIENTATION))


def _png(data: bytes) -> Header:
    width, height = struct.unpack_from(">II", data, 16)
    at, orientation = 8, 1
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"eXIf":
            orientation = _exif(data[at + 8 : at + 8 + size])
        if kind in (b"eXIf", b"IDAT", b"IEND"):
            break
        at += 12 + size
    return Header("image/png", width, height, orientation)


def _gif(data: bytes) -> Header:
    return Header("image/gif", *struct.unpack_from("<HH", data, 6))


def _bmp(data: bytes) -> Header:
    if struct.unpack_from("<I", data, 14)[0] == 12:  # the oldest header has 16-bit sizes
        return Header("image/bmp", *struct.unpack_from("<HH", data, 18))
    width, height = struct.unpack_from("<ii", data, 18)
    return Header("image/bmp", width, abs(height))


def _jpeg(data: bytes) -> Header:
    at, orientation = 2, 1
    while True:
        while data[at] == 0xFF and data[at + 1] == 0xFF:  # fill bytes
            at += 1
        if data[at] != 0xFF:
            raise ValueError("no marker")
        kind = data[at + 1]
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        if kind == 0xE1 and body.startswith(b"Exif\0\0"):
            orientation = _exif(body)
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", body, 1)
            return Header("image/jpeg", width, height, orientation)
        if kind in (0xD9, 0xDA):
            raise ValueError("no frame")
        at += 2 + size


def _webp(data: bytes) -> Header:
    kind = data[12:16]
    if kind == b"VP8 " and data[23:26] == b"\x9d\x01\x2a":
        width, height = struct.unpack_from("<HH", data, 26)
        return Header("image/webp", width & 0x3FFF, height & 0x3FFF)
    if kind == b"VP8L" and data[20] == 0x2F:
        bits = struct.unpack_from("<I", data, 21)[0]
        return Header("image/webp", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1)
    if kind != b"VP8X":
        raise ValueError("no image")
    width, height = (int.from_bytes(data[a : a + 3], "little") + 1 for a in (24, 27))
    if len(data) < 30:
        raise ValueError("cut off")
    at, orientation = 12, 1
    while data[20] & 8 and at + 8 <= len(data):  # the flag of an EXIF chunk, which comes last
        kind, size = struct.unpack_from("<4sI", data, at)
        if kind == b"EXIF":
            orientation = _exif(data[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return Header("image/webp", width, height, orientation)


def _tiff(data: bytes) -> Header:
    tags = tiff_tags(data)
    return Header("image/tiff", tags[_WIDTH], tags[_HEIGHT], _sound(tags.get(_ORIENTATION)))


def boxes(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of the media boxes in a stretch; the last may be cut off."""
    end = len(data) if end is None else min(end, len(data))
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        start = at + 8
        if size == 1:
            size, start = struct.unpack_from(">Q", data, start)[0], start + 8
        stop = at + size if size else end
        if stop <= at:
            return
        yield kind, start, min(stop, end)
        at = stop


def _avif(data: bytes) -> Header:
    """The size of the primary item, turned as its properties say; a rotation goes before a mirror."""
    meta = next((a, b) for kind, a, b in boxes(data) if kind == b"meta")
    inside = {kind: (a, b) for kind, a, b in boxes(data, meta[0] + 4, meta[1])}
    version = data[inside[b"pitm"][0]]
    primary = int.from_bytes(data[inside[b"pitm"][0] + 4 :][: 4 if version else 2], "big")
    about = {kind: (a, b) for kind, a, b in boxes(data, *inside[b"iprp"])}
    properties = list(boxes(data, *about[b"ipco"]))
    at = about[b"ipma"][0]
    version, flags = data[at], data[at + 3]
    n, at = struct.unpack_from(">I", data, at + 4)[0], at + 8
    mine: list[int] = []
    for _ in range(n):
        item, at = int.from_bytes(data[at : at + (4 if version else 2)], "big"), at + (4 if version else 2)
        wide, count, at = flags & 1, data[at], at + 1
        for _ in range(count):
            place, at = (struct.unpack_from(">H", data, at)[0] & 0x7FFF, at + 2) if wide else (data[at] & 0x7F, at + 1)
            if item == primary and 0 < place <= len(properties):
                mine.append(place - 1)
    held = {properties[i][0]: properties[i][1] for i in mine}
    width, height = struct.unpack_from(">II", data, held[b"ispe"] + 4)
    turns = data[held[b"irot"]] & 3 if b"irot" in held else 0  # quarter turns against the clock
    orientation = (1, 8, 3, 6)[turns]
    if b"imir" in held:  # top and bottom change places (0), or left and right (1)
        orientation = {(1, 0): 4, (1, 1): 2, (8, 0): 5, (8, 1): 7, (3, 0): 2, (3, 1): 4, (6, 0): 7, (6, 1): 5}[orientation, data[held[b"imir"]] & 1]
    return Header("image/avif", width, height, orientation)


def header(data: bytes | None) -> Header | None:
    """Null if the bytes aren't the beginning of an image that is known, or end too early."""
    if not data:
        return None
    kinds = ((data[:8] == b"\x89PNG\r\n\x1a\n", _png), (data[:4] == b"GIF8", _gif), (data[:2] == b"BM", _bmp), (data[:2] == b"\xff\xd8", _jpeg), (data[:4] == b"RIFF" and data[8:12] == b"WEBP", _webp), (data[:4] in (b"II*\0", b"MM\0*"), _tiff), (data[4:8] == b"ftyp" and data[8:12] in (b"avif", b"avis", b"mif1", b"heic"), _avif))
    parse = next((p for fits, p in kinds if fits), None)
    try:
        found = parse(data) if parse else None
    except (struct.error, IndexError, KeyError, ValueError, StopIteration):
        return None
    return found if found and found.width > 0 and found.height > 0 else None


def upright(image: np.ndarray, orientation: int) -> np.ndarray:
    """An array of rows turned and mirrored as the orientation asks for."""
    if orientation >= 5:
        image = image.swapaxes(0, 1)
    if orientation in (2, 3, 6, 7):
        image = image[:, ::-1]
    if orientation in (3, 4, 7, 8):
        image = image[::-1]
    return image
