"""GeoTIFF in numpy: strips or tiles, plain, deflated, LZW or PackBits, one or more bands."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.projections import SYSTEMS, Arrays, reproject
from .files import parsed

# Tags and types of TIFF and GeoTIFF.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT = 317, 322, 323, 324, 325, 339
SCALE, TIE, MATRIX, GEO_KEYS, NODATA = 33550, 33922, 34264, 34735, 42113
SIZES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 11: "f", 12: "d", 16: "Q"}


def unpacked_lzw(data: bytes) -> bytes:
    """LZW as TIFF has it: codes of 9 to 12 bits, most significant bit first, one code early; 256 clears, 257 ends."""
    out: list[bytes] = []
    table: list[bytes] = []
    bits = held = at = 0
    size, before = 9, b""
    while True:
        while held < size:
            if at == len(data):
                return b"".join(out)
            bits, held, at = (bits << 8 | data[at]) & 0xFFFFFF, held + 8, at + 1
        held -= size
        code = bits >> held & (1 << size) - 1
        if code == 257:
            return b"".join(out)
        if code == 256:
            table, size, before = [], 9, b""
            continue
        if code < 256:
            entry = bytes((code,))
        elif code - 258 < len(table):
            entry = table[code - 258]
        elif before:
            entry = before + before[:1]
        else:
            raise ValueError("LZW code out of order")
        out.append(entry)
        if before:
            table.append(before + entry[:1])
            if len(table) + 258 >= (1 << size) - 1 and size < 12:
                size += 1
        before = entry


def unpacked_bits(data: bytes) -> bytes:
    """PackBits: a count and that many bytes, or a byte and how often it comes."""
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out)


class Tiff:
    """The first image of a file: ``shape``, ``transform`` (a, b, c, d, e, f), ``epsg``, ``nodata``."""

    def __init__(self, data: bytes):
        self.data = data
        self.o = o = {b"II": "<", b"MM": ">"}[data[:2]]
        if struct.unpack_from(f"{o}H", data, 2)[0] != 42:
            raise ValueError("not a TIFF")
        (at,) = struct.unpack_from(f"{o}I", data, 4)
        (n,) = struct.unpack_from(f"{o}H", data, at)
        self.tags: dict[int, tuple] = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(f"{o}HHI", data, at + 2 + 12 * k)
            if kind not in SIZES:
                continue
            form = f"{o}{count * len(SIZES[kind])}{SIZES[kind][0]}" if kind != 2 else f"{count}s"
            size = struct.calcsize(form)
            where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(f"{o}I", data, at + 10 + 12 * k)[0]
            self.tags[tag] = struct.unpack_from(form, data, where)
        get = lambda t, d=0: self.tags.get(t, (d,))[0]
        self.bands = get(SAMPLES, 1)
        self.shape = (get(HEIGHT), get(WIDTH))
        kind = {1: "u", 2: "i", 3: "f"}[get(FORMAT, 1)]
        self.dtype = np.dtype(f"{o}{kind}{get(BITS, 8) // 8}")
        if MATRIX in self.tags:
            m = self.tags[MATRIX]
            self.transform = (m[0], m[1], m[3], m[4], m[5], m[7])
        elif SCALE in self.tags and TIE in self.tags:
            (sx, sy, _), t = self.tags[SCALE], self.tags[TIE]
            self.transform = (sx, 0.0, t[3] - t[0] * sx, 0.0, -sy, t[4] + t[1] * sy)
        else:
            self.transform = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
        keys = self.tags.get(GEO_KEYS, ())
        codes = {keys[k]: keys[k + 3] for k in range(4, len(keys), 4)}
        self.epsg = codes.get(3072) or codes.get(2048)
        text = get(NODATA, b"").split(b"\0")[0].strip() if NODATA in self.tags else b""
        self.nodata = float(text) if text else None

    def bounds(self) -> tuple[float, float, float, float]:
        a, b, c, d, e, f = self.transform
        h, w = self.shape
        xs = [c, c + w * a, c + h * b, c + w * a + h * b]
        ys = [f, f + w * d, f + h * e, f + w * d + h * e]
        return min(xs), min(ys), max(xs), max(ys)

    def read(self, bands: Sequence[int] = (1,)) -> np.ndarray:
        """Bands, counted from 1, as ``(band, row, column)``."""
        h, w = self.shape
        tiled = TILES in self.tags
        th = self.tags[TILE_HEIGHT][0] if tiled else min(self.tags.get(ROWS, (h,))[0], h)
        tw = self.tags[TILE_WIDTH][0] if tiled else w
        places, sizes = (self.tags[TILES], self.tags[TILE_BYTES]) if tiled else (self.tags[STRIPS], self.tags[STRIP_BYTES])
        apart = self.tags.get(PLANAR, (1,))[0] == 2
        inner = 1 if apart else self.bands
        across, down = -(-w // tw), -(-h // th)
        out = np.zeros((self.bands, h, w), dtype=self.dtype.newbyteorder("="))
        for k, (at, size) in enumerate(zip(places, sizes, strict=True)):
            band, cell = divmod(k, across * down) if apart else (0, k)
            y, x = cell // across * th, cell % across * tw
            raw = self.data[at : at + size]
            how = self.tags.get(COMPRESSION, (1,))[0]
            if how in (8, 32946):
                raw = zlib.decompress(raw)
            elif how == 5:
                raw = unpacked_lzw(raw)
            elif how == 32773:
                raw = unpacked_bits(raw)
            elif how != 1:
                raise ValueError(f"compression {how} is not read")
            rows = th if tiled else min(th, h - y)
            block = np.frombuffer(raw, dtype=self.dtype, count=rows * tw * inner).reshape(rows, tw, inner)
            predictor = self.tags.get(PREDICTOR, (1,))[0]
            if predictor not in (1, 2):
                raise ValueError(f"predictor {predictor} is not read")
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=block.dtype)
            part = block[: h - y, : w - x].transpose(2, 0, 1)
            out[band : band + inner, y : y + part.shape[1], x : x + part.shape[2]] = part
        return out[[b - 1 for b in bands]]


def write(image: np.ndarray, transform: Sequence[float], epsg: int | None = None, nodata: float | None = None, strip: int = 64) -> bytes:
    """A deflated GeoTIFF of one band."""
    image = np.ascontiguousarray(image, dtype=image.dtype.newbyteorder("<"))
    h, w = image.shape
    strips = [zlib.compress(image[y : y + strip].tobytes(), 6) for y in range(0, h, strip)]
    kind = {"u": 1, "i": 2, "f": 3}[image.dtype.kind]
    a, b, c, d, e, f = map(float, transform)
    tags = [
        (WIDTH, 4, (w,)), (HEIGHT, 4, (h,)), (BITS, 3, (image.dtype.itemsize * 8,)), (COMPRESSION, 3, (8,)), (PHOTOMETRIC, 3, (1,)), (STRIPS, 4, (0,) * len(strips)),
        (SAMPLES, 3, (1,)), (ROWS, 4, (strip,)), (STRIP_BYTES, 4, tuple(map(len, strips))), (FORMAT, 3, (kind,)),
        (MATRIX, 12, (a, b, 0.0, c, d, e, 0.0, f, 0, 0, 0, 0, 0, 0, 0, 1.0)),
    ]
    if epsg:
        tags.append((GEO_KEYS, 3, (1, 1, 0, 2, 1024, 0, 1, 2 if epsg == 4326 else 1, 2048 if epsg == 4326 else 3072, 0, 1, epsg)))
    if nodata is not None:
        tags.append((NODATA, 2, (f"{nodata:g}".encode() + b"\0",)))
    start = 8 + 2 + 12 * len(tags) + 4
    body, places = b"", []
    packs = {}
    for tag, code, values in sorted(tags):
        packs[tag] = values[0] if code == 2 else struct.pack(f"<{len(values)}{SIZES[code]}", *values)
    extra = {t: p for t, p in packs.items() if len(p) > 4}
    at = start + sum(len(p) + len(p) % 2 for p in extra.values())
    for s in strips:
        places.append(at)
        at += len(s)
    packs[STRIPS] = struct.pack(f"<{len(places)}I", *places)
    head, at = struct.pack("<2sHIH", b"II", 42, 8, len(tags)), start
    for tag, code, values in sorted(tags):
        p = packs[tag]
        count = len(values[0]) if code == 2 else len(values)
        if len(p) <= 4:
            head += struct.pack("<HHI", tag, code, count) + p.ljust(4, b"\0")
        else:
            head += struct.pack("<HHII", tag, code, count, at)
            body += p + b"\0" * (len(p) % 2)
            at += len(p) + len(p) % 2
    return head + struct.pack("<I", 0) + body + b"".join(strips)


META = "path string, height int, width int, bands int, dtype string, transform array<double>, epsg int, nodata double, minx double, miny double, maxx double, maxy double, error string"


def metadata(files: DataFrame) -> DataFrame:
    """Size, place and reference system of each raster; what cannot be read has an error."""

    def parse(path: str, content: bytes) -> list[dict]:
        try:
            t = Tiff(content)
        except (ValueError, KeyError, struct.error) as e:
            return [{"path": path, "error": f"{type(e).__name__}: {e}"}]
        box = dict(zip(("minx", "miny", "maxx", "maxy"), t.bounds(), strict=True))
        kind = t.dtype.newbyteorder("=").name
        return [{"path": path, "height": t.shape[0], "width": t.shape[1], "bands": t.bands, "dtype": kind, "transform": list(t.transform), "epsg": t.epsg, "nodata": t.nodata, **box}]

    return parsed(files, parse, META)


#: Pixels of a batch.
BATCH = 1 << 16


def _images(files: DataFrame, bands: Sequence[int], read: Callable[[Tiff], np.ndarray]) -> DataFrame:
    """The pixels that are not 0 of what ``read`` takes each file to, in batches of columns."""

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for band, image in zip(bands, read(Tiff(content.as_py())), strict=True):
                    r, c = np.nonzero(image)
                    for k in range(0, len(r), BATCH):
                        y, x = r[k : k + BATCH], c[k : k + BATCH]
                        n = len(y)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([path]).take(pa.array(np.zeros(n, dtype=np.int64))), pa.array(np.full(n, band, dtype=np.int32)), pa.array(y.astype(np.int64)), pa.array(x.astype(np.int64)), pa.array(image[y, x].astype(np.float64))],
                            names=["path", "band", "r", "c", "v"],
                        )

    return files.select("path", "content").mapInArrow(run, "path string, band int, r long, c long, v double")


def pixels(files: DataFrame, bands: Sequence[int] = (1,)) -> DataFrame:
    """The pixels of each raster that are not 0: ``path, band, r, c, v``."""
    return _images(files, bands, lambda t: t.read(bands))


def bands_resampled(files: DataFrame, factor: float, bands: Sequence[int] = (8, 6, 1)) -> DataFrame:
    """The pixels of chosen bands, ``factor`` times as many along each side, bilinear: ``path, band, r, c, v``."""
    return _images(files, bands, lambda t: resampled(t.read(bands).astype(np.float64), factor))


def warped(files: DataFrame, target: int, step: float) -> DataFrame:
    """Rasters on a grid of ``step`` in another system, each cell the nearest pixel: ``path, r, c, v``.

    Each file is read once; the centres of its cells are projected back some rows at a time. Rasters of systems
    that are not known give no rows.
    """

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                t = Tiff(content.as_py())
                if t.epsg not in SYSTEMS:
                    continue
                [image], (h, w) = t.read(), t.shape
                minx, miny, maxx, maxy = t.bounds()
                x, y = reproject(np.array([minx, minx, maxx, maxx]), np.array([miny, maxy, miny, maxy]), t.epsg, target, Arrays)
                rows, cols = (max(1, math.ceil((v.max() - v.min()) / step - 1e-6)) for v in (y, x))
                across = x.min() + (np.arange(cols) + 0.5) * step
                some = max(1, BATCH // cols)
                for start in range(0, rows, some):
                    down = y.max() - (np.arange(start, min(rows, start + some)) + 0.5) * step
                    sx, sy = reproject(*np.meshgrid(across, down), target, t.epsg, Arrays)
                    sc, sr = np.floor((sx - t.transform[2]) / t.transform[0]), np.floor((sy - t.transform[5]) / t.transform[4])
                    r, c = np.nonzero((sr >= 0) & (sr < h) & (sc >= 0) & (sc < w))
                    v = image[sr[r, c].astype(np.int64), sc[r, c].astype(np.int64)]
                    there = v != 0
                    r, c, v = r[there] + start, c[there], v[there]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path]).take(pa.array(np.zeros(len(v), dtype=np.int64))), pa.array(r.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(v.astype(np.float64))],
                        names=["path", "r", "c", "v"],
                    )

    return files.select("path", "content").mapInArrow(run, "path string, r int, c int, v double")


def written(pixels: DataFrame, key: str, transform: Sequence[float], epsg: int, shape: tuple[int, int] | None = None, value: str = "v") -> DataFrame:
    """One raster per ``key`` from its pixels: rows ``(name, content)``. Without a ``shape`` a raster ends at its last pixels."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros(shape or (pdf["r"].max() + 1, pdf["c"].max() + 1), dtype=np.uint8)
        image[pdf["r"], pdf["c"]] = pdf[value]
        return pd.DataFrame({"name": [f"{pdf[key].iloc[0]}_mask.tif"], "content": [write(image, transform, epsg)]})

    return pixels.select(F.col(key).cast("string").alias(key), "r", "c", value).groupBy(key).applyInPandas(build, "name string, content binary")


def resampled(image: np.ndarray, factor: float) -> np.ndarray:
    """An image ``factor`` times as large in both directions, bilinear between pixel centres."""
    h, w = image.shape[-2:]
    rows, cols = max(1, round(h * factor)), max(1, round(w * factor))
    y = np.clip((np.arange(rows) + 0.5) * h / rows - 0.5, 0, h - 1)
    x = np.clip((np.arange(cols) + 0.5) * w / cols - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    top = image[..., y0[:, None], x0] * (1 - fx) + image[..., y0[:, None], x1] * fx
    low = image[..., y1[:, None], x0] * (1 - fx) + image[..., y1[:, None], x1] * fx
    return top * (1 - fy) + low * fy
