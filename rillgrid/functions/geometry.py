"""Boxes, rings and lines as columns; WKB both ways; clipping and simplifying kernels."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

POINTS = "array<struct<x: double, y: double>>"


def box_area(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    return F.greatest(maxx - minx, F.lit(0.0)) * F.greatest(maxy - miny, F.lit(0.0))


def box_overlap(a: tuple, b: tuple) -> Column:
    """Area that two boxes ``(minx, miny, maxx, maxy)`` share."""
    return box_area(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))


def box_around(box: tuple, distance: float) -> dict[str, Column]:
    """A box ``(minx, miny, maxx, maxy)`` grown by a distance on all sides, as named columns."""
    names = ("minx", "miny", "maxx", "maxy")
    return {n: x + F.lit(distance if n.startswith("max") else -distance) for n, x in zip(names, box, strict=True)}


def box_wkb(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """A box as WKB, a polygon of one ring."""

    @F.pandas_udf("binary")
    def made(minx: pd.Series, miny: pd.Series, maxx: pd.Series, maxy: pd.Series) -> pd.Series:
        a, b, c, d = (v.to_numpy(dtype=float) for v in (minx, miny, maxx, maxy))
        return pd.Series(encode_rings(POLYGON, np.stack([a, b, c, b, c, d, a, d, a, b], axis=1).reshape(-1, 5, 2)), dtype=object)

    return made(minx, miny, maxx, maxy)


def span_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two intervals share."""
    return F.greatest(F.least(F.greatest(a0, a1), b1) - F.greatest(F.least(a0, a1), b0), F.lit(0.0))


def _pairs(points: Column) -> Column:
    n = F.size(points)
    return F.transform(
        F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))),
        lambda k: F.struct(F.get(points, k).alias("p"), F.get(points, k + 1).alias("q")),
    )


def ring_area(points: Column) -> Column:
    """Area of a closed ring by the shoelace formula."""
    cross = F.aggregate(_pairs(points), F.lit(0.0), lambda s, x: s + x["p"]["x"] * x["q"]["y"] - x["q"]["x"] * x["p"]["y"])
    return F.when(F.size(points) >= 4, F.abs(cross) / 2).otherwise(F.lit(0.0))


def line_length(points: Column) -> Column:
    step = lambda x: F.sqrt(F.pow(x["q"]["x"] - x["p"]["x"], F.lit(2.0)) + F.pow(x["q"]["y"] - x["p"]["y"], F.lit(2.0)))
    whole = F.aggregate(_pairs(points), F.lit(0.0), lambda s, x: s + step(x))
    return F.when(F.size(points) >= 2, whole).otherwise(F.lit(0.0))


def bounds(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def box_ring(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    corners = ((minx, miny), (maxx, miny), (maxx, maxy), (minx, maxy), (minx, miny))
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners])


def in_ring(x: Column, y: Column, points: Column) -> Column:
    """Is a point inside a ring? Counts the edges that a ray to the right crosses."""
    crossed = F.filter(
        _pairs(points),
        lambda e: ((e["p"]["y"] > y) != (e["q"]["y"] > y))
        & (x < (e["q"]["x"] - e["p"]["x"]) * (y - e["p"]["y"]) / F.nullif(e["q"]["y"] - e["p"]["y"], F.lit(0.0)) + e["p"]["x"]),
    )
    return F.size(crossed) % 2 == 1


def has_points(points: Column) -> Column:
    return points.isNotNull() & (F.size(points) > 0)


# --- well-known binary ------------------------------------------------------------------------

# Type codes of WKB.
POINT, LINE, POLYGON, MULTI_POINT, MULTI_LINE, MULTI_POLYGON, COLLECTION = range(1, 8)


def wkb_type(wkb: Column) -> Column:
    """The type code in bytes 2 to 5; dimension flags are left out."""
    order = F.conv(F.hex(F.substring(wkb, 1, 1)), 16, 10).cast("int")
    part = lambda k: F.conv(F.hex(F.substring(wkb, k, 1)), 16, 10).cast("int")
    little = part(2) + part(3) * 256
    big = part(5) + part(4) * 256
    return F.pmod(F.when(order == 1, little).otherwise(big), F.lit(1000))


def is_polygonal(wkb: Column) -> Column:
    return F.coalesce(wkb_type(wkb).isin(POLYGON, MULTI_POLYGON), F.lit(False))


def encode(kind: int, parts: list) -> bytes:
    """WKB of a point ``(x, y)``, a line of points, a polygon of rings, or a multi of those."""
    head = struct.pack("<BI", 1, kind)
    points = lambda ps: struct.pack(f"<I{2 * len(ps)}d", len(ps), *[v for p in ps for v in p[:2]])
    if kind == POINT:
        return head + struct.pack("<dd", *parts[:2])
    if kind == LINE:
        return head + points(parts)
    if kind == POLYGON:
        return head + struct.pack("<I", len(parts)) + b"".join(points(r) for r in parts)
    inner = {MULTI_POINT: POINT, MULTI_LINE: LINE, MULTI_POLYGON: POLYGON}[kind]
    return head + struct.pack("<I", len(parts)) + b"".join(encode(inner, p) for p in parts)


def decode(wkb: bytes) -> tuple[int, list]:
    """(type, parts) of WKB in either byte order; heights and measures are dropped."""
    return _decode(wkb, 0)[:2]


def _decode(wkb: bytes, at: int) -> tuple[int, list, int]:
    o = "<" if wkb[at] else ">"
    (code,) = struct.unpack_from(f"{o}I", wkb, at + 1)
    at += 5
    if code & 0x20000000:
        at += 4
    size = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
    code &= 0x0FFFFFFF
    size += {0: 0, 1: 1, 2: 1, 3: 2}[code // 1000]
    kind = code % 1000

    def points(at: int) -> tuple[list, int]:
        (n,) = struct.unpack_from(f"{o}I", wkb, at)
        flat = struct.unpack_from(f"{o}{n * size}d", wkb, at + 4)
        return [flat[k : k + 2] for k in range(0, n * size, size)], at + 4 + 8 * n * size

    if kind == POINT:
        return kind, list(struct.unpack_from(f"{o}{size}d", wkb, at)[:2]), at + 8 * size
    if kind == LINE:
        got, at = points(at)
        return kind, got, at
    (n,) = struct.unpack_from(f"{o}I", wkb, at)
    at, parts = at + 4, []
    for _ in range(n):
        if kind == POLYGON:
            got, at = points(at)
        else:
            sub, got, at = _decode(wkb, at)
            got = (sub, got) if kind == COLLECTION else got
        parts.append(got)
    return kind, parts, at


def polygons(wkb: bytes | None) -> list:
    """The polygons (lists of rings) in a geometry; other parts are dropped."""
    if not wkb:
        return []
    kind, parts = decode(wkb)
    if kind == POLYGON:
        return [parts]
    if kind == MULTI_POLYGON:
        return parts
    if kind == COLLECTION:
        return [p for k, sub in parts for p in ([sub] if k == POLYGON else sub if k == MULTI_POLYGON else [])]
    return []


def encode_rings(kind: int, rings: np.ndarray) -> list[bytes]:
    """WKB of many polygons, or multi-polygons of one, each of one ring: ``rings`` is ``(polygon, point, 2)``."""
    n, k, _ = rings.shape
    ring = [(0.0, 0.0)] * k
    blank = np.frombuffer(encode(kind, [ring] if kind == POLYGON else [[ring]]), dtype=np.uint8)
    size = len(blank)
    block = np.tile(blank, (n, 1))
    block[:, size - 16 * k :] = np.ascontiguousarray(rings, dtype="<f8").view(np.uint8).reshape(n, 16 * k)
    data = block.tobytes()
    return [data[at : at + size] for at in range(0, n * size, size)]


#: Layouts of one length that are read at once; geometries of more are read one by one.
LAYOUTS = 8


def _layout(wkb: bytes) -> list[list[tuple[int, int]]] | None:
    """Place in bytes and number of points of each ring of each polygon; None for what is not plain polygons."""
    o = "<" if wkb[0] else ">"
    (kind,) = struct.unpack_from(f"{o}I", wkb, 1)
    if kind not in (POLYGON, MULTI_POLYGON):
        return None
    n, at = (1, 5) if kind == POLYGON else (struct.unpack_from(f"{o}I", wkb, 5)[0], 9)
    found = []
    for _ in range(n):
        if kind == MULTI_POLYGON:
            if wkb[at] != wkb[0] or struct.unpack_from(f"{o}I", wkb, at + 1)[0] != POLYGON:
                return None
            at += 5
        (count,) = struct.unpack_from(f"{o}I", wkb, at)
        at, rings = at + 4, []
        for _ in range(count):
            (k,) = struct.unpack_from(f"{o}I", wkb, at)
            rings.append((at + 4, k))
            at += 4 + 16 * k
        found.append(rings)
    return found


def by_layout(wkbs: Sequence[bytes | None]) -> Iterator[tuple[np.ndarray, list[list[np.ndarray]] | None]]:
    """Geometries of one layout at a time: which they are, and of each polygon the rings, ``(geometry, point, 2)``.

    Each comes once. None for the rings says that these should be read one by one.
    """
    sizes = np.array([0 if w is None else len(w) for w in wkbs], dtype=np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        if size >= 9:
            block = np.frombuffer(b"".join([wkbs[k] for k in at]), dtype=np.uint8).reshape(-1, size)
            for _ in range(LAYOUTS):
                if not len(at) or (layout := _layout(block[0].tobytes())) is None:
                    break
                head = np.ones(size, dtype=bool)
                for start, k in (r for p in layout for r in p):
                    head[start : start + 16 * k] = False
                same = (block[:, head] == block[0, head]).all(axis=1)
                form, mine = "<f8" if block[0, 0] else ">f8", block[same]
                yield at[same], [[np.ascontiguousarray(mine[:, a : a + 16 * k]).view(form).reshape(-1, k, 2).astype(float) for a, k in p] for p in layout]
                at, block = at[~same], block[~same]
        if len(at):
            yield at, None


def to_multi_polygon(wkb: Column) -> Column:
    """Polygons and collections as multi-polygons; null where nothing is polygonal."""

    @F.pandas_udf("binary")
    def promoted(wkb: pd.Series) -> pd.Series:
        return wkb.map(lambda w: encode(MULTI_POLYGON, ps) if (ps := polygons(w)) else None)

    return promoted(wkb)


def polygon_area(wkb: Column) -> Column:
    """Area of a geometry's polygons, holes taken off; 0 where nothing is polygonal."""

    def ring(p: np.ndarray) -> np.ndarray:
        # From the first point, so that places far off lose no digits.
        x, y = np.moveaxis(p - p[:, :1], 2, 0)
        return np.abs((x[:, :-1] * y[:, 1:] - x[:, 1:] * y[:, :-1]).sum(axis=1)) / 2

    def whole(parts: list) -> np.ndarray | float:
        return sum(ring(p[0]) - sum(map(ring, p[1:])) for p in parts if p)

    @F.pandas_udf("double")
    def area(wkb: pd.Series) -> pd.Series:
        out, found = np.zeros(len(wkb)), wkb.tolist()
        for at, parts in by_layout(found):
            if parts is not None:
                out[at] = whole(parts)
                continue
            for k in at:
                out[k] = np.sum(whole([[np.array(r, dtype=float).reshape(1, -1, 2) for r in p] for p in polygons(found[k])]))
        return pd.Series(out)

    return area(wkb)


def clip_ring(ring: list, box: tuple[float, float, float, float]) -> list:
    """A ring cut to a box (Sutherland and Hodgman 1974)."""
    minx, miny, maxx, maxy = box
    for axis, bound, sign in ((0, minx, 1), (0, maxx, -1), (1, miny, 1), (1, maxy, -1)):
        if not ring:
            return []
        out = []
        inside = lambda p: sign * (p[axis] - bound) >= 0  # noqa: E731, B023
        for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
            if inside(p):
                out.append(tuple(p))
            if inside(p) != inside(q):
                t = (bound - p[axis]) / (q[axis] - p[axis])
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        ring = [p for k, p in enumerate(out) if p != out[k - 1] or len(out) == 1]
    return [*ring, ring[0]] if len(ring) >= 3 and ring[0] != ring[-1] else (ring if len(ring) >= 4 else [])


def clip_to_box(wkb: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """The polygonal part of a geometry inside a box, as a multi-polygon; null where empty."""

    def cut(w, *box):
        out = []
        for rings in polygons(w):
            kept = [c for r in rings if (c := clip_ring([tuple(p) for p in r[:-1]], box))]
            if kept:
                out.append(kept)
        return encode(MULTI_POLYGON, out) if out else None

    @F.pandas_udf("binary")
    def clipped(wkb: pd.Series, minx: pd.Series, miny: pd.Series, maxx: pd.Series, maxy: pd.Series) -> pd.Series:
        return pd.Series([cut(*x) for x in zip(wkb, minx, miny, maxx, maxy, strict=True)], dtype=object)

    return clipped(wkb, minx, miny, maxx, maxy)


def simplify(points: list, tolerance: float) -> list:
    """A line with fewer points, none of the dropped ones farther than ``tolerance`` (Douglas and Peucker 1973)."""
    if len(points) < 3 or tolerance <= 0:
        return list(points)
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        (x0, y0), (x1, y1) = points[a][:2], points[b][:2]
        dx, dy = x1 - x0, y1 - y0
        norm = (dx * dx + dy * dy) ** 0.5
        far, at = 0.0, None
        for k in range(a + 1, b):
            x, y = points[k][0] - x0, points[k][1] - y0
            d = abs(dx * y - dy * x) / norm if norm else (x * x + y * y) ** 0.5
            if d > far:
                far, at = d, k
        if at is not None and far > tolerance:
            keep.add(at)
            todo += [(a, at), (at, b)]
    return [points[k] for k in sorted(keep)]


def segment_parts(x0: float, y0: float, x1: float, y1: float, wkb: bytes | None, borders: bool = True) -> list[tuple[float, float]]:
    """The parts of a segment inside a geometry's polygons, as distances from its start.

    The segment is cut where it crosses a ring; a part counts if its middle is inside, by
    an odd number of rings. With ``borders`` a part along a border is inside if the polygon
    lies above it or, for an upright one, to its right; without, no part along one is.
    """
    rings = [r for p in polygons(wkb) for r in p]
    whole = ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5
    if not rings or whole == 0:
        return []
    p = np.concatenate([np.array(r, dtype=float)[:-1, :2] for r in rings])
    q = np.concatenate([np.array(r, dtype=float)[1:, :2] for r in rings])
    dx, dy, ex, ey = x1 - x0, y1 - y0, q[:, 0] - p[:, 0], q[:, 1] - p[:, 1]
    turn = dx * ey - dy * ex
    with np.errstate(divide="ignore", invalid="ignore"):
        t = ((p[:, 0] - x0) * ey - (p[:, 1] - y0) * ex) / turn
        u = ((p[:, 0] - x0) * dy - (p[:, 1] - y0) * dx) / turn
    hit = (turn != 0) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1)
    cuts, along = [[0.0, 1.0], t[hit]], []
    if not borders and (line := (turn == 0) & ((p[:, 0] - x0) * dy == (p[:, 1] - y0) * dx)).any():
        # Sides in line with the segment, from and to which share of it; where two lie on one another is no border.
        ends = [((e[line, 0] - x0) * dx + (e[line, 1] - y0) * dy) / (dx * dx + dy * dy) for e in (p, q)]
        along = list(zip(np.minimum(*ends).tolist(), np.maximum(*ends).tolist(), strict=True))
        cuts.append([e for side in along for e in side if 0 < e < 1])
    cuts = np.unique(np.concatenate(cuts))
    out: list[tuple[float, float]] = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if sum(first < (a + b) / 2 < last for first, last in along) % 2:
            continue
        x, y = x0 + dx * (a + b) / 2, y0 + dy * (a + b) / 2
        across = (p[:, 1] > y) != (q[:, 1] > y)
        crossed = across & (x < ex * (y - p[:, 1]) / np.where(across, ey, 1.0) + p[:, 0])
        if crossed.sum() % 2:
            if out and out[-1][1] == a * whole:
                out[-1] = (out[-1][0], b * whole)
            else:
                out.append((a * whole, b * whole))
    return out
