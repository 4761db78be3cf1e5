"""A reader and a writer for baseline TIFF: strips or tiles, uncompressed or deflate, 8, 16 or 32 bits, one or more bands."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Bytes of the TIFF field types, and the tags that are read.
_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8}
_FORM = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_COUNTS, FORMAT, SCALE, TIEPOINT = 322, 323, 324, 325, 339, 33550, 33922


Read = Callable[[int, int], bytes]


def tags(read: Read) -> tuple[str, dict[int, tuple]]:
    """Byte order and tags; ``read(offset, length)`` is asked for the directory and the values outside it only."""
    head = read(0, 8)
    order = {b"II": "<", b"MM": ">"}[head[:2]]
    (at,) = struct.unpack_from(order + "I", head, 4)
    (n,) = struct.unpack(order + "H", read(at, 2))
    entries, out = read(at + 2, 12 * n), {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", entries, 12 * i)
        if kind not in _FORM:
            continue
        values = entries[12 * i + 8 : 12 * i + 12]
        if _SIZE[kind] * count > 4:
            (place,) = struct.unpack(order + "I", values)
            values = read(place, _SIZE[kind] * count)
        out[tag] = struct.unpack_from(f"{order}{count}{_FORM[kind]}", values)
    return order, out


@dataclass
class Layout:
    """What a raster's tags say: its size, where its strips or tiles stand, and its world coordinates."""

    bands: int
    height: int
    width: int
    dtype: np.dtype
    packed: bool
    planar: bool
    tiled: bool
    side: tuple[int, int]
    places: tuple[int, ...]
    sizes: tuple[int, ...]
    world: dict[str, float]

    def block(self, read: Read, i: int) -> tuple[int, int, int, np.ndarray]:
        """(band, row, col, array of bands x rows x cols) of the i-th strip or tile, cut to the raster."""
        h, w = self.side
        across, down = -(-self.width // w), -(-self.height // h)
        band, cell = divmod(i, across * down) if self.planar else (0, i)
        r, c = cell // across * h, cell % across * w
        raw = read(self.places[i], self.sizes[i])
        raw = zlib.decompress(raw) if self.packed else raw
        rows = h if self.tiled else min(h, self.height - r)
        per = 1 if self.planar else self.bands
        return band, r, c, np.frombuffer(raw, self.dtype, rows * w * per).reshape(rows, w, per)[: self.height - r, : self.width - c].transpose(2, 0, 1)


def layout(read: Read) -> Layout:
    order, t = tags(read)
    one = lambda tag, default: t.get(tag, (default,))[0]
    width, height = one(WIDTH, 0), one(HEIGHT, 0)
    packed = one(COMPRESSION, 1)
    if packed not in (1, 8, 32946) or one(PREDICTOR, 1) != 1:
        raise ValueError(f"TIFF compression {packed} with predictor {one(PREDICTOR, 1)} isn't read")
    tiled = TILES in t
    side = (one(TILE_HEIGHT, height), one(TILE_WIDTH, width)) if tiled else (min(one(ROWS, height), height), width)
    places, sizes = (t[TILES], t[TILE_COUNTS]) if tiled else (t[STRIPS], t[COUNTS])
    scale, tie = t.get(SCALE, (1.0, 1.0, 0.0)), t.get(TIEPOINT, (0.0,) * 6)
    world = {"x0": tie[3] - tie[0] * scale[0], "dx": scale[0], "y0": tie[4] + tie[1] * scale[1], "dy": -scale[1]}
    kind = {1: "u", 2: "i", 3: "f"}[one(FORMAT, 1)]
    dtype = np.dtype(f"{order}{kind}{one(BITS, 8) // 8}")
    return Layout(one(SAMPLES, 1), height, width, dtype, packed != 1, one(PLANAR, 1) == 2, tiled, side, places, sizes, world)


def read(data: bytes) -> tuple[np.ndarray, dict]:
    """(array of bands x height x width, world coordinates x0, dx, y0, dy) of a whole file."""
    cut = lambda at, n: data[at : at + n]
    p = layout(cut)
    out = np.zeros((p.bands, p.height, p.width), p.dtype)
    for i in range(len(p.places)):
        band, r, c, part = p.block(cut, i)
        out[band : band + part.shape[0], r : r + part.shape[1], c : c + part.shape[2]] = part
    return out, p.world


def write(bands: np.ndarray, x0: float = 0.0, dx: float = 1.0, y0: float = 0.0, dy: float = -1.0, rows: int = 64, deflate: bool = True) -> bytes:
    """A little-endian strip TIFF of bands x height x width."""
    n, height, width = bands.shape
    kind = {"u": 1, "i": 2, "f": 3}[bands.dtype.kind]
    strips = [np.ascontiguousarray(bands[:, r : r + rows].transpose(1, 2, 0)).astype(bands.dtype.newbyteorder("<")).tobytes() for r in range(0, height, rows)]
    strips = [zlib.compress(s) if deflate else s for s in strips]
    body, places = bytearray(b"II*\0\0\0\0\0"), []
    for s in strips:
        places.append(len(body))
        body += s + b"\0" * (len(s) % 2)
    entries = {WIDTH: (4, [width]), HEIGHT: (4, [height]), BITS: (3, [bands.dtype.itemsize * 8] * n), COMPRESSION: (3, [8 if deflate else 1]), 262: (3, [1]), STRIPS: (4, places), SAMPLES: (3, [n]), ROWS: (4, [rows]), COUNTS: (4, [len(s) for s in strips]), PLANAR: (3, [1]), FORMAT: (3, [kind] * n), SCALE: (12, [dx, -dy, 0.0]), TIEPOINT: (12, [0.0, 0.0, 0.0, x0, y0, 0.0])}
    table = bytearray(struct.pack("<H", len(entries)))
    for tag in sorted(entries):
        code, values = entries[tag]
        raw = struct.pack(f"<{len(values)}{_FORM[code]}", *values)
        if len(raw) > 4:
            body += b"\0" * (len(body) % 2)
            place = struct.pack("<I", len(body))
            body += raw
        else:
            place = raw.ljust(4, b"\0")
        table += struct.pack("<HHI", tag, code, len(values)) + place
    body += b"\0" * (len(body) % 2)
    struct.pack_into("<I", body, 4, len(body))
    return bytes(body + table + b"\0\0\0\0")
