"""Masks to polygons: rings along pixel sides, holes, simplification, multi-polygons as WKB."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.geometry import MULTI_POLYGON, encode, simplify
from .graph import _grouped, _links, _roots

#: Steps along the sides of a pixel, its inside always on the same hand: (dr, dc).
STEPS = np.array([(0, 1), (1, 0), (0, -1), (-1, 0)])
#: The side that a step runs along: the pixel next to it, and the corner where it starts.
ASIDE = np.array([(-1, 0), (0, 1), (1, 0), (0, -1)])
CORNER = np.array([(0, 0), (0, 1), (1, 1), (1, 0)])


def _has(place: np.ndarray, want: np.ndarray) -> np.ndarray:
    at = np.searchsorted(place, want)
    at[at == len(place)] = 0
    return place[at] == want


def boundary(r: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Closed rings of pixels sorted by row and column: ``(row, column, ring)`` of corners in order.

    Each side that no other pixel shares is a step; at a corner where two pixels touch
    the ring stays with its own, so pixels that only touch have rings of their own.
    Steps are put in order by pointer doubling.
    """
    width = int(c.max()) + 3
    place = r * width + c + 1
    pixel, way = [], []
    for k, (dr, dc) in enumerate(ASIDE):
        open_side = np.flatnonzero(~_has(place, place + dr * width + dc))
        pixel.append(open_side)
        way.append(np.full(len(open_side), k))
    pixel, way = np.concatenate(pixel), np.concatenate(way)
    row, col = r[pixel] + CORNER[way, 0], c[pixel] + CORNER[way, 1]
    spot = (row * (width + 1) + col + 1) * 4 + way
    order = np.argsort(spot)
    row, col, way, spot = row[order], col[order], way[order], spot[order]
    ahead = ((row + STEPS[way, 0]) * (width + 1) + col + STEPS[way, 1] + 1) * 4
    onward = np.full(len(spot), -1)
    for turn in (3, 0, 1):  # the last that is there counts: staying with the pixel goes first
        want = ahead + (way + turn) % 4
        at = np.minimum(np.searchsorted(spot, want), len(spot) - 1)
        onward = np.where(spot[at] == want, at, onward)
    # The least step of each ring leads it; how far it is from each step puts them in order.
    lead, jump = np.arange(len(spot)), onward.copy()
    while True:
        new = np.minimum(lead, lead[jump])
        if (new == lead).all() and (lead == lead[onward]).all():
            break
        lead, jump = new, jump[jump]
    to = np.where(onward == lead, np.arange(len(spot)), onward)
    far = np.where(onward == lead, 0, 1)
    while True:
        far, new = far + far[to], to[to]
        if (new == to).all():
            break
        to = new
    by = np.lexsort((-far, lead))
    ring = np.unique(lead[by], return_inverse=True)[1]
    return row[by], col[by], ring


def simple_rings(corners: list[int]) -> list[list[int]]:
    """A ring that passes a corner more than once, cut into rings that do not, each as its places in the ring."""
    seen: dict[int, int] = {}
    path: list[int] = []
    out = []
    for i, p in enumerate(corners):
        if p in seen:
            loop = path[seen[p] :]
            out.append(loop)
            for q in loop[1:]:
                del seen[corners[q]]
            del path[seen[p] + 1 :]
        else:
            seen[p] = len(path)
            path.append(i)
    out.append(path)
    return [x for x in out if len(x) >= 4]


def _starts(ring: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], ring[1:] != ring[:-1]]))


def _single(corner: np.ndarray, ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of steps in an order where no ring passes a corner twice, and the ring that each was of."""
    by = np.lexsort((corner, ring))
    again = by[1:][(ring[by][1:] == ring[by][:-1]) & (corner[by][1:] == corner[by][:-1])]
    cut = _starts(ring)
    stop = np.append(cut, len(ring))[1:]
    places, owners, done = [], [], 0
    for k in np.unique(ring[again]):
        places.append(np.arange(done, cut[k]))
        owners.append(ring[done : cut[k]] * 2)
        for n, loop in enumerate(simple_rings(corner[cut[k] : stop[k]].tolist())):
            places.append(np.array(loop) + cut[k])
            owners.append(np.full(len(loop), k * 2 + n % 2))  # loops that follow each other differ
        done = stop[k]
    places.append(np.arange(done, len(ring)))
    owners.append(ring[done:] * 2)
    return np.concatenate(places), np.concatenate(owners)


def mask_polygons(r: np.ndarray, c: np.ndarray, transform: Sequence[float], eight: bool, tolerance: float) -> list[tuple[int, list]]:
    """``(region, polygons)`` of pixels sorted by row and column; a polygon is its outer ring and holes.

    Regions are numbered by their first pixel; polygons of one region only touch. All
    rings are worked on at once; only those that pass a corner twice are walked.
    """
    links = _links(r - r.min(), c - c.min())
    side = (r[links[0]] == r[links[1]]) | (c[links[0]] == c[links[1]])
    part = _roots(len(r), links[0][side], links[1][side])
    region = _roots(len(r), *links) if eight else part
    row, col, ring = boundary(r, c)
    # The pixel inside the first step tells which part a ring belongs to.
    cut = _starts(ring)
    ahead = np.stack([row[cut + 1] - row[cut], col[cut + 1] - col[cut]], axis=1)
    way = (ahead[:, None, :] == STEPS[None, :, :]).all(axis=2).argmax(axis=1)
    width = int(c.max()) + 3
    owner = part[np.searchsorted(r * width + c, (row[cut] - CORNER[way, 0]) * width + col[cut] - CORNER[way, 1])]
    place, piece = _single(row * (int(col.max()) + 1) + col, ring)
    y, x = row[place], col[place]
    start = _starts(piece)
    size = np.diff(np.append(start, len(piece)))
    owner = owner[piece[start] // 2]
    before, after = np.arange(len(piece)) - 1, np.arange(len(piece)) + 1
    before[start], after[start + size - 1] = start + size - 1, start
    outer = np.add.reduceat(x * y[after] - x[after] * y, start) > 0
    # Sides of pixels are one long, so a step goes on where it came from exactly if the way does not turn.
    bend = (y[before] - y) * (x[after] - x) != (x[before] - x) * (y[after] - y)
    count = np.add.reduceat(bend.astype(np.int64), start)
    x, y = x[bend].astype(float), y[bend].astype(float)
    a, b, x0, d, e, y0 = transform
    points = list(zip((a * x + b * y + x0).tolist(), (d * x + e * y + y0).tolist(), strict=True))
    parts: dict[int, tuple[list, list]] = {}
    at = 0
    for n, who, is_outer in zip(count.tolist(), owner.tolist(), outer.tolist(), strict=True):
        line = points[at : at + n]
        at += n
        parts.setdefault(who, ([], []))[not is_outer].append(_thinned([*line, line[0]], tolerance))
    out: dict[int, list] = {}
    for who, (shells, holes) in parts.items():
        out.setdefault(int(region[who]), []).append(shells + holes)
    return sorted(out.items())


def _thinned(ring: list, tolerance: float) -> list:
    """A ring simplified in two halves, so that it stays a ring; one that would collapse stays as it is."""
    if tolerance <= 0 or len(ring) <= 5:
        return ring
    half = len(ring) // 2
    made = simplify(ring[: half + 1], tolerance)[:-1] + simplify(ring[half:], tolerance)
    return made if len(made) >= 4 and ring_area(made) > 0 else ring


def ring_area(ring: list) -> float:
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:], strict=False))) / 2


def polygonize(
    pixels: DataFrame,
    keys: Sequence[str],
    *,
    transform: Sequence[float] = (1, 0, 0, 0, -1, 0),
    eight_connected: bool = True,
    min_area: float = 0.0,
    tolerance: float = 0.0,
) -> DataFrame:
    """One row per region: ``component_id, mask_value, n_parts, n_holes, n_points, area, geom``.

    A region is a set of pixels that touch, at corners too if ``eight_connected``; its
    geometry is a multi-polygon whose parts only touch, so it is valid as it is. Rings
    are simplified by ``tolerance``; regions whose area is then ``min_area`` or less go.
    ``transform`` takes a column and row to map coordinates. Each mask is one group.
    """
    kinds = dict(pixels.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def trace(table: pa.Table) -> pa.Table:
        r, c = (table.column(x).to_numpy().astype(np.int64) for x in ("r", "c"))
        order = np.lexsort((c, r))
        rows = []
        for k, (_, polygons) in enumerate(mask_polygons(r[order], c[order], transform, eight_connected, tolerance)):
            area = sum(ring_area(p[0]) - sum(map(ring_area, p[1:])) for p in polygons)
            if min_area <= 0 or area > min_area:
                points = sum(len(x) for p in polygons for x in p)
                rows.append((k, 1, len(polygons), sum(len(p) - 1 for p in polygons), points, area, encode(MULTI_POLYGON, polygons)))
        names = ("component_id", "mask_value", "n_parts", "n_holes", "n_points", "area", "geom")
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary())
        out = {k: pa.array([table.column(k)[0].as_py()] * len(rows), table.column(k).type) for k in keys}
        return pa.table({**out, **{n: pa.array([x[i] for x in rows], t) for i, (n, t) in enumerate(zip(names, types, strict=True))}})

    return _grouped(pixels, keys).applyInArrow(
        trace, f"{schema}, component_id long, mask_value int, n_parts long, n_holes long, n_points long, area double, geom binary"
    )
