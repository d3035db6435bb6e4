"""Raster formats: ASCII grids, GeoTIFF and the elevation grid's bytes.

Files are read whole by ``binaryFile`` or in windows by byte ranges; decoders are
numpy functions for Arrow batches. A decoder refuses what it does not know
instead of giving wrong heights.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


@dataclass
class Raster:
    """Values by rows from the north; NaN where there is none; the origin is the outer north-west corner."""

    e0: float
    n_top: float
    size_x: float
    size_y: float
    values: np.ndarray

    def sample(self, e: float, n: float) -> float | None:
        """Bilinear between pixel centres; absent ones get no weight."""
        x, y = (e - self.e0) / self.size_x - 0.5, (self.n_top - n) / self.size_y - 0.5
        total = weight = 0.0
        for j in (int(np.floor(y)), int(np.floor(y)) + 1):
            for i in (int(np.floor(x)), int(np.floor(x)) + 1):
                w = (1 - abs(x - i)) * (1 - abs(y - j))
                if w > 0 and 0 <= j < self.values.shape[0] and 0 <= i < self.values.shape[1] and not np.isnan(v := self.values[j, i]):
                    total, weight = total + w * float(v), weight + w
        return total / weight if weight else None


def parse_asc(text: str, scale: float = 1.0) -> Raster:
    """An ASCII grid: six header lines, then rows from the north."""
    lines = text.split("\n", 6)
    head = {k.lower(): float(v) for k, v in (line.split() for line in lines[:6])}
    if missing := {"ncols", "nrows", "xllcorner", "yllcorner", "cellsize", "nodata_value"} - set(head):
        raise ValueError(f"an ASCII grid lacks {sorted(missing)}")
    columns, rows, size = int(head["ncols"]), int(head["nrows"]), head["cellsize"]
    values = np.array(lines[6].split(), float)
    if len(values) != columns * rows:
        raise ValueError(f"an ASCII grid of {columns} by {rows} has {len(values)} values")
    values = np.where(values == head["nodata_value"], np.nan, values * scale).astype(np.float32)
    return Raster(head["xllcorner"], head["yllcorner"] + rows * size, size, size, values.reshape(rows, columns))


_TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d", 16: "Q"}


class Tiff:
    """Classic or big TIFF of one sample a pixel, read through ``read(offset, length)``."""

    def __init__(self, read):  # noqa: ANN001
        self.read = read
        head = read(0, 16)
        if head[:2] not in (b"II", b"MM"):
            raise ValueError("not a TIFF")
        self.o = "<" if head[:2] == b"II" else ">"
        self.big = struct.unpack(self.o + "H", head[2:4])[0] == 43
        at = struct.unpack(self.o + ("Q" if self.big else "I"), head[8:16] if self.big else head[4:8])[0]
        self.levels: list[dict[int, tuple]] = []
        while at:
            level, at = self._directory(at)
            self.levels.append(level)

    def _directory(self, at: int) -> tuple[dict[int, tuple], int]:
        n_fmt, entry, word = ("Q", 20, "Q") if self.big else ("H", 12, "I")
        size = struct.calcsize(n_fmt)
        n = struct.unpack(self.o + n_fmt, self.read(at, size))[0]
        raw = self.read(at + size, n * entry + struct.calcsize(word))
        tags = {}
        for i in range(n):
            e = raw[i * entry : (i + 1) * entry]
            tag, kind, count = struct.unpack(self.o + "HH" + word, e[: entry - struct.calcsize(word)])
            code = _TYPES.get(kind)
            if code is None:
                continue
            length = struct.calcsize(self.o + code) * count
            data = e[entry - struct.calcsize(word) :]
            if length > len(data):
                data = self.read(struct.unpack(self.o + word, data)[0], length)
            tags[tag] = (data[:length],) if code == "s" else struct.unpack(self.o + code * count, data[:length])
        return tags, struct.unpack(self.o + word, raw[n * entry :])[0]

    def check(self, tags: dict[int, tuple]) -> None:
        one = lambda t, d: tags.get(t, (d,))[0]
        if one(277, 1) != 1 or one(317, 1) not in (1, 2, 3) or one(259, 1) not in (1, 5, 8, 32946):
            raise ValueError("this TIFF's samples, predictor or compression are not read")
        if (one(258, 1), one(339, 1)) not in ((32, 3), (16, 2), (16, 1)):
            raise ValueError("this TIFF's values are neither 32-bit floats nor 16-bit integers")

    def shape(self, tags: dict[int, tuple]) -> tuple[int, int, int, int]:
        """Width, height, and those of a tile or strip."""
        w, h = tags[256][0], tags[257][0]
        return (w, h, tags[322][0], tags[323][0]) if 322 in tags else (w, h, w, tags.get(278, (h,))[0])

    def block(self, tags: dict[int, tuple], index: int, data: bytes) -> np.ndarray:
        w, h, bw, bh = self.shape(tags)
        kind = np.dtype(self.o + ("f4" if tags.get(339, (1,))[0] == 3 else "i2" if tags.get(339, (1,))[0] == 2 else "u2"))
        rows = bh if 322 in tags else min(bh, h - index * bh)
        method = tags.get(259, (1,))[0]
        raw = data if method == 1 else zlib.decompress(data) if method in (8, 32946) else lzw_decode(data)
        predictor = tags.get(317, (1,))[0]
        if predictor == 3:  # bytes of one significance side by side, each a difference
            planes = np.frombuffer(raw, np.uint8)[: rows * bw * 4].reshape(rows, -1)
            planes = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(rows, 4, bw)
            return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(">f4").reshape(rows, bw).astype(np.float32)
        out = np.frombuffer(raw, kind)[: rows * bw].reshape(rows, bw)
        if predictor == 2:
            out = np.cumsum(out, axis=1, dtype=kind.newbyteorder("="))
        return out.astype(np.float32)

    def window(self, level: int, x0: int, y0: int, x1: int, y1: int) -> np.ndarray:
        """Pixels of a window, NaN outside the image; neighbouring blocks are fetched in one range."""
        tags = self.levels[level]
        self.check(tags)
        w, h, bw, bh = self.shape(tags)
        offsets, counts = (tags[324], tags[325]) if 324 in tags else (tags[273], tags[279])
        across = -(-w // bw)
        out = np.full((y1 - y0, x1 - x0), np.nan, np.float32)
        wanted = [r * across + c for r in range(max(0, y0) // bh, -(-min(h, y1) // bh)) for c in range(max(0, x0) // bw, -(-min(w, x1) // bw))]
        for start, length, members in coalesce([(offsets[i], counts[i], i) for i in wanted]):
            data = self.read(start, length)
            for at, n, i in members:
                px = self.block(tags, i, data[at - start : at - start + n])
                r, c = i // across * bh, i % across * bw
                a, b, d, e = max(y0, r), min(y1, r + px.shape[0], h), max(x0, c), min(x1, c + bw, w)
                if a < b and d < e:
                    out[a - y0 : b - y0, d - x0 : e - x0] = px[a - r : b - r, d - c : e - c]
        absent = tags.get(42113)
        if absent:
            out[out == np.float32(absent[0].rstrip(b"\0 "))] = np.nan
        return out

    def raster(self, e_min: float, n_min: float, e_max: float, n_max: float, most: int = 16_777_216) -> Raster:
        """The finest level at which a rectangle has at most ``most`` pixels."""
        scale, tie = self.levels[0][33550], self.levels[0][33922]
        full = self.levels[0][256][0]
        for k, tags in enumerate(self.levels):
            sx, sy = scale[0] * full / tags[256][0], scale[1] * self.levels[0][257][0] / tags[257][0]
            x0, y0 = int(np.floor((e_min - tie[3]) / sx)), int(np.floor((tie[4] - n_max) / sy))
            x1, y1 = int(np.ceil((e_max - tie[3]) / sx)), int(np.ceil((tie[4] - n_min) / sy))
            if (x1 - x0) * (y1 - y0) <= most:
                return Raster(tie[3] + x0 * sx, tie[4] - y0 * sy, sx, sy, self.window(k, x0, y0, x1, y1))
        raise ValueError("no level of this TIFF is coarse enough for the window")


def coalesce(blocks: list[tuple[int, int, int]], most: int = 32 << 20) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """Byte ranges (start, length, members) of blocks (offset, length, index) that follow each other in the file."""
    run: list[tuple[int, int, int]] = []
    for b in sorted(x for x in blocks if x[1]):
        if run and (b[0] != run[-1][0] + run[-1][1] or b[0] + b[1] - run[0][0] > most):
            yield run[0][0], run[-1][0] + run[-1][1] - run[0][0], run
            run = []
        run.append(b)
    if run:
        yield run[0][0], run[-1][0] + run[-1][1] - run[0][0], run


def lzw_decode(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, most significant bit first, each width ending one code early."""
    out, table, width = bytearray(), [], 9
    bits = held = 0
    last: bytes | None = None
    for byte in data:
        bits, held = (bits << 8) | byte, held + 8
        if held < width:
            continue
        held -= width
        code, bits = bits >> held, bits & ((1 << held) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [], 9, None
            continue
        if code < 256:
            piece = bytes([code])
        elif code - 258 < len(table):
            piece = table[code - 258]
        elif last is not None and code - 258 == len(table):  # the entry that this code makes
            piece = last + last[:1]
        else:
            raise ValueError("broken LZW data")
        if last is not None:
            table.append(last + piece[:1])
        out += piece
        last = piece
        width = min(12, max(9, (len(table) + 259).bit_length()))
    return bytes(out)


def write_tiff(r: Raster, tile: int = 256, absent: float = -9999.0) -> bytes:
    """A float GeoTIFF on the National Grid: deflated tiles, absent pixels as a number that the file names."""
    h, w = r.values.shape
    across, down = -(-w // tile), -(-h // tile)
    full = np.full((down * tile, across * tile), absent, "<f4")
    full[:h, :w] = np.where(np.isnan(r.values), absent, r.values)
    parts = [zlib.compress(full[j * tile : (j + 1) * tile, i * tile : (i + 1) * tile].tobytes()) for j in range(down) for i in range(across)]
    n = len(parts)
    geo = (1, 1, 0, 3, 1024, 0, 1, 1, 1025, 0, 1, 1, 3072, 0, 1, 27700)
    tags: list[tuple[int, int, int, bytes]] = []
    put = lambda t, k, *v: tags.append((t, k, len(v), struct.pack("<" + {3: "H", 4: "I", 12: "d"}[k] * len(v), *v)))
    for t, v in ((256, w), (257, h)):
        put(t, 4, v)
    for t, v in ((258, 32), (259, 8), (262, 1), (277, 1), (322, tile), (323, tile), (339, 3)):
        put(t, 3, v)
    put(324, 4, *([0] * n))
    put(325, 4, *map(len, parts))
    put(33550, 12, r.size_x, r.size_y, 0.0)
    put(33922, 12, 0.0, 0.0, 0.0, r.e0, r.n_top, 0.0)
    put(34735, 3, *geo)
    text = f"{absent:g}\0".encode()
    tags.append((42113, 2, len(text), text))
    tags.sort()
    at = 8 + 2 + 12 * len(tags) + 4
    places = {}
    for t, _, _, data in tags:
        if len(data) > 4:
            places[t] = at
            at += len(data) + len(data) % 2
    starts = np.cumsum([at, *map(len, parts)])[:-1].tolist()
    tags = [(t, k, c, struct.pack(f"<{n}I", *starts) if t == 324 else d) for t, k, c, d in tags]
    out = bytearray(b"II*\0" + struct.pack("<IH", 8, len(tags)))
    for t, k, c, d in tags:
        out += struct.pack("<HHI", t, k, c) + (struct.pack("<I", places[t]) if t in places else d.ljust(4, b"\0"))
    out += b"\0\0\0\0"
    for t, _, _, d in tags:
        if t in places:
            out += d + b"\0" * (len(d) % 2)
    return bytes(out) + b"".join(parts)


def varint(value: int) -> bytes:
    """Seven bits to a byte, the lowest first, a high bit on all but the last."""
    groups = [value & 127]
    while value := value >> 7:
        groups.append(value & 127)
    return bytes([*(g | 128 for g in groups[:-1]), groups[-1]])


def encode_grid(nx: int, ny: int, x0: float, y0: float, dx: float, dy: float, heights: np.ndarray) -> bytes:
    """An elevation grid's message: size, corner and spacing, then each height with its tag; absent ones as a quiet NaN with its sign set."""
    if nx <= 0 or ny <= 0 or heights.size != nx * ny or not np.isfinite([x0, y0, dx, dy]).all() or not dx or not dy:
        raise ValueError("this grid does not describe a surface")
    out = bytearray(b"\x08" + varint(nx) + b"\x10" + varint(ny))
    for tag, v in zip(b"\x19\x21\x29\x31", (x0, y0, dx, dy)):
        out += bytes([tag]) + struct.pack("<d", v)
    body = np.zeros(heights.size, [("tag", "u1"), ("z", "<u8")])
    body["tag"] = 0x39
    flat = heights.reshape(-1).astype("<f8")
    body["z"] = np.where(np.isnan(flat), np.uint64(0xFFF8000000000000), flat.view("<u8"))
    return bytes(out) + body.tobytes()


_PIXELS = "path string, col int, row int, z float"


def _frames(spark: SparkSession, path: str, decode) -> DataFrame:  # noqa: ANN001
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                v = decode(bytes(content))
                row, col = np.nonzero(~np.isnan(v))
                for at in range(0, len(row), 500_000):
                    r, c = row[at : at + 500_000], col[at : at + 500_000]
                    yield pd.DataFrame({"path": name, "col": c.astype(np.int32), "row": r.astype(np.int32), "z": v[r, c]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, _PIXELS)


def asc_pixels(spark: SparkSession, path: str, scale: float = 1.0) -> DataFrame:
    """(path, col, row, z) of ASCII grids, a file to a task."""
    return _frames(spark, path, lambda b: parse_asc(b.decode(), scale).values)


def tiff_pixels(spark: SparkSession, path: str) -> DataFrame:
    """(path, col, row, z) of the finest level of TIFF files, a file to a task."""

    def decode(b: bytes) -> np.ndarray:
        t = Tiff(lambda at, n: b[at : at + n])
        w, h, _, _ = t.shape(t.levels[0])
        return t.window(0, 0, 0, w, h)

    return _frames(spark, path, decode)
