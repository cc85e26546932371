"""Polygons laid over one another: union, repair and inward buffers of any rings.

All sides are cut where they meet; a piece is kept if what lies left of it belongs to the
result and what lies right does not, or the other way; kept pieces are joined to rings.
Coordinates are snapped to a billionth of the extent.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import MULTI_POLYGON, by_layout, encode, encode_rings, polygons

#: Sides or places compared in step, and the pieces of a quarter circle.
STEP, QUARTER = 1 << 20, 8
#: Sides of a polygon that is repaired together with others; one with more is repaired alone.
FEW = 64


def _sides(rings: Sequence[list]) -> np.ndarray:
    """Rows ``x0, y0, x1, y1``."""
    parts = [np.hstack([a[:-1], a[1:]]) for r in rings if len(r) >= 4 for a in [np.array([p[:2] for p in r], dtype=float)]]
    return np.concatenate(parts) if parts else np.zeros((0, 4))


def _inside(x: np.ndarray, y: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Which places an odd number of rings goes round."""
    out = np.zeros(len(x), dtype=bool)
    if not len(sides):
        return out
    low, high = sides.reshape(-1, 2).min(axis=0), sides.reshape(-1, 2).max(axis=0)
    near = np.flatnonzero((x >= low[0]) & (x <= high[0]) & (y >= low[1]) & (y <= high[1]))
    step = max(1, STEP // len(sides))
    for start in range(0, len(near), step):
        k = near[start : start + step]
        px, py = x[k, None], y[k, None]
        across = (sides[:, 1] > py) != (sides[:, 3] > py)
        rise = np.where(sides[:, 3] == sides[:, 1], 1.0, sides[:, 3] - sides[:, 1])
        at = sides[:, 0] + (sides[:, 2] - sides[:, 0]) * (py - sides[:, 1]) / rise
        out[k] = (across & (px < at)).sum(axis=1) % 2 == 1
    return out


def _pieces(sides: np.ndarray, grid: float) -> np.ndarray:
    """Different pieces of all sides between the places where sides meet, in grid steps."""
    box = np.column_stack([np.minimum(sides[:, 0], sides[:, 2]), np.minimum(sides[:, 1], sides[:, 3]), np.maximum(sides[:, 0], sides[:, 2]), np.maximum(sides[:, 1], sides[:, 3])])
    order = np.argsort(box[:, 0])
    sides, box = sides[order], box[order]
    reach = np.searchsorted(box[:, 0], box[:, 2] + grid, side="right")
    cuts: list[list[float]] = [[0.0, 1.0] for _ in sides]
    for i, (x0, y0, x1, y1) in enumerate(sides.tolist()):
        near = np.arange(i + 1, reach[i])
        near = near[(box[near, 1] <= box[i, 3] + grid) & (box[near, 3] >= box[i, 1] - grid)]
        if not len(near):
            continue
        a, b, c, d = sides[near].T
        dx, dy, ex, ey = x1 - x0, y1 - y0, c - a, d - b
        turn = dx * ey - dy * ex
        flat = np.abs(turn) <= 1e-12 * np.hypot(dx, dy) * np.hypot(ex, ey)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((a - x0) * ey - (b - y0) * ex) / turn
            u = ((a - x0) * dy - (b - y0) * dx) / turn
        room, other = grid / math.hypot(dx, dy), grid / np.hypot(ex, ey)
        for k in np.flatnonzero(~flat & (t >= -room) & (t <= 1 + room) & (u >= -other) & (u <= 1 + other)):
            cuts[i].append(float(t[k]))
            cuts[near[k]].append(float(u[k]))
        for k in np.flatnonzero(flat & (np.abs((a - x0) * dy - (b - y0) * dx) <= grid * math.hypot(dx, dy))):
            size, long = dx * dx + dy * dy, ex[k] * ex[k] + ey[k] * ey[k]
            cuts[i] += [((a[k] - x0) * dx + (b[k] - y0) * dy) / size, ((c[k] - x0) * dx + (d[k] - y0) * dy) / size]
            cuts[near[k]] += [((x0 - a[k]) * ex[k] + (y0 - b[k]) * ey[k]) / long, ((x1 - a[k]) * ex[k] + (y1 - b[k]) * ey[k]) / long]
    found = set()
    for (x0, y0, x1, y1), ts in zip(sides.tolist(), cuts, strict=True):
        ts = sorted(min(1.0, max(0.0, t)) for t in ts)
        at = [(round((x0 + t * (x1 - x0)) / grid), round((y0 + t * (y1 - y0)) / grid)) for t in ts]
        found.update((min(p, q), max(p, q)) for p, q in zip(at, at[1:], strict=False) if p != q)
    return np.array([(*p, *q) for p, q in sorted(found)], dtype=float).reshape(-1, 4)


def _loops(pieces: list[tuple]) -> list[list[tuple]]:
    """Pieces with the inside to their left, joined to rings that pass no place twice."""
    out: dict[tuple, list] = {}
    for p, q in pieces:
        out.setdefault(p, []).append(q)
    rings = []
    while out:
        path, seen = [next(iter(out))], {}
        seen[path[0]] = 0
        while path:
            here = path[-1]
            ways = out.get(here)
            if not ways:
                path.pop()
                seen.pop(here, None)
                continue
            if len(path) > 1 and len(ways) > 1:
                # The sharpest turn to the left stays with the same part.
                back = math.atan2(path[-2][1] - here[1], path[-2][0] - here[0])
                way = min(ways, key=lambda q: (back - math.atan2(q[1] - here[1], q[0] - here[0])) % (2 * math.pi) or 2 * math.pi)
            else:
                way = ways[0]
            ways.remove(way)
            if not ways:
                del out[here]
            if way in seen:
                loop = path[seen[way] :]
                rings.append(loop)
                for p in loop[1:]:
                    del seen[p]
                del path[seen[way] + 1 :]
            else:
                seen[way] = len(path)
                path.append(way)
    return [r for r in rings if len(r) >= 3]


def _doubled(ring: list) -> float:
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True))


def overlay(operands: Sequence[Sequence[list]], keep: Callable[[np.ndarray], np.ndarray]) -> list:
    """Polygons of what ``keep`` says of the operands, each a set of rings.

    ``keep`` takes which operands hold a place, an array ``(operand, place)``, to whether
    the place belongs to the result. The work grows with the square of the sides that
    share a stretch of x, so operands should be those of one cell or feature.
    """
    each = [_sides(rings) for rings in operands]
    sides = np.concatenate(each) if each else np.zeros((0, 4))
    sides = sides[(sides[:, 0] != sides[:, 2]) | (sides[:, 1] != sides[:, 3])]
    if not len(sides):
        return []
    low = np.minimum(sides[:, :2].min(axis=0), sides[:, 2:].min(axis=0))
    span = float(np.maximum(sides[:, :2].max(axis=0) - low, sides[:, 2:].max(axis=0) - low).max())
    grid = span * 1e-9
    shift = np.tile(low, 2)
    each = [(s - shift) / grid for s in each]
    pieces = _pieces((sides - shift) / grid, 1.0)
    dx, dy = pieces[:, 2] - pieces[:, 0], pieces[:, 3] - pieces[:, 1]
    long = np.hypot(dx, dy)
    off = np.minimum(100.0, long / 4)
    mx, my = (pieces[:, 0] + pieces[:, 2]) / 2, (pieces[:, 1] + pieces[:, 3]) / 2
    nx, ny = -dy / long * off, dx / long * off
    left = keep(np.array([_inside(mx + nx, my + ny, s) for s in each]))
    right = keep(np.array([_inside(mx - nx, my - ny, s) for s in each]))
    chosen = [((a, b), (c, d)) if inner else ((c, d), (a, b)) for (a, b, c, d), inner, other in zip(pieces.tolist(), left, right, strict=True) if inner != other]
    return _assembled(chosen, grid, low)


def _assembled(chosen: list[tuple], grid: float, low: np.ndarray) -> list:
    """Polygons whose border the chosen pieces are, each with the inside to its left."""
    outer, holes = [], []
    for ring in _loops(chosen):
        straight = [(q[0] - p[0]) * (r[1] - q[1]) == (q[1] - p[1]) * (r[0] - q[0]) for p, q, r in zip(ring[-1:] + ring[:-1], ring, ring[1:] + ring[:1], strict=True)]
        ring = [p for p, s in zip(ring, straight, strict=True) if not s]
        if len(ring) >= 3 and (area := _doubled(ring)):
            (outer if area > 0 else holes).append(ring)
    outer.sort(key=_doubled)
    out = [[r] for r in outer]
    for hole in holes:
        # Just left of a hole's side lies the polygon that it belongs to: the smallest around it.
        (a, b), (c, d) = hole[0], hole[1]
        size = math.hypot(c - a, d - b)
        x, y = np.array([(a + c) / 2 - (d - b) / size * min(100.0, size / 4)]), np.array([(b + d) / 2 + (c - a) / size * min(100.0, size / 4)])
        for k, ring in enumerate(outer):
            if _inside(x, y, _sides([[*ring, ring[0]]]))[0]:
                out[k].append(hole)
                break
    place = lambda p: (float(p[0] * grid + low[0]), float(p[1] * grid + low[1]))
    return [[[place(p) for p in [*ring, ring[0]]] for ring in polygon] for polygon in out]


def _is_convex(polygon: list) -> bool:
    """Is a polygon one ring that only turns one way, once round?"""
    if len(polygon) != 1 or len(polygon[0]) < 4:
        return False
    p = [x[:2] for x in polygon[0][:-1]]
    sign, around = 0, 0.0
    for (ax, ay), (bx, by), (cx, cy) in zip(p, p[1:] + p[:1], p[2:] + p[:2], strict=True):
        dx, dy, ex, ey = bx - ax, by - ay, cx - bx, cy - by
        turn = dx * ey - dy * ex
        if turn == 0 or turn * sign < 0:
            return False
        sign = 1 if turn > 0 else -1
        around += math.atan2(turn, dx * ex + dy * ey)
    return abs(around) < 2 * math.pi + 1e-6


def united(parts: Sequence[list]) -> list:
    """One set of polygons that covers what any of ``parts``, each a polygon's rings, covers.

    Only parts whose boxes touch others' are laid over one another.
    """
    parts = [p for p in parts if p and p[0]]
    if not parts:
        return []
    spans = [list(zip(*[q[:2] for r in p for q in r], strict=True)) for p in parts]
    box = np.array([[min(xs), min(ys), max(xs), max(ys)] for xs, ys in spans])
    order = np.argsort(box[:, 0], kind="stable")
    box = box[order]
    cluster, reach = np.arange(len(parts)), np.searchsorted(box[:, 0], box[:, 2], side="right")
    for i in range(len(parts)):
        near = np.arange(i + 1, reach[i])
        near = near[(box[near, 1] <= box[i, 3]) & (box[near, 3] >= box[i, 1])]
        if len(near):
            old = np.unique(cluster[[i, *near]])
            cluster[np.isin(cluster, old)] = old[0]
    out = []
    for k in np.unique(cluster):
        group = [parts[i] for i in order[cluster == k]]
        out += group if len(group) == 1 and _is_convex(group[0]) else overlay(group, lambda held: held.any(axis=0))
    return out


def repaired(rings: list) -> list:
    """A polygon whose rings may cross or repeat, as valid polygons: inside is what an odd number of rings goes round."""
    return [rings] if _is_convex(rings) else overlay([rings], lambda held: held[0])


def _together(sides: np.ndarray) -> list[list]:
    """``repaired`` for polygons of as many sides each, ``(polygon, side, 4)``, none of them without length."""
    n, few, _ = sides.shape
    step = max(1, STEP // (4 * few * few))
    if n > step:
        return [p for k in range(0, n, step) for p in _together(sides[k : k + step])]
    ends = sides.reshape(n, -1, 2)
    low = ends.min(axis=1)
    grid = (ends.max(axis=1) - low).max(axis=1) * 1e-9
    s = (sides - np.tile(low, 2)[:, None]) / grid[:, None, None]
    # Where each side is cut, as shares of it: by each other side, as in _pieces.
    x0, y0, x1, y1 = np.moveaxis(s, 2, 0)[..., None]
    a, b, c, d = np.moveaxis(s, 2, 0)[:, :, None]
    dx, dy, ex, ey = x1 - x0, y1 - y0, c - a, d - b
    long, other = np.hypot(dx, dy), np.hypot(ex, ey)
    near = (np.minimum(x0, x1) <= np.maximum(a, c) + 1) & (np.minimum(a, c) <= np.maximum(x0, x1) + 1) & (np.minimum(y0, y1) <= np.maximum(b, d) + 1) & (np.minimum(b, d) <= np.maximum(y0, y1) + 1)
    near &= ~np.eye(few, dtype=bool)
    turn, off = dx * ey - dy * ex, (a - x0) * dy - (b - y0) * dx
    flat = np.abs(turn) <= 1e-12 * long * other
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = ((a - x0) * ey - (b - y0) * ex) / turn, off / turn
    hit = near & ~flat & (t >= -1 / long) & (t <= 1 + 1 / long) & (u >= -1 / other) & (u <= 1 + 1 / other)
    along = np.abs(off) <= long
    along = near & flat & (along | along.transpose(0, 2, 1))
    size = dx * dx + dy * dy
    first, last = ((a - x0) * dx + (b - y0) * dy) / size, ((c - x0) * dx + (d - y0) * dy) / size
    ts = np.concatenate([np.where(hit, t, np.where(along, first, 0.0)), np.where(along, last, 0.0), np.zeros_like(x0), np.ones_like(x0)], axis=2)
    ts = np.sort(np.clip(ts, 0.0, 1.0), axis=2)
    x, y = np.rint(x0 + ts * dx), np.rint(y0 + ts * dy)
    # Different pieces of each polygon, from the lesser end to the greater.
    p, q = np.stack([x[..., :-1], y[..., :-1]], axis=-1), np.stack([x[..., 1:], y[..., 1:]], axis=-1)
    own, *_ = at = np.nonzero((p != q).any(axis=-1))
    p, q = p[at], q[at]
    back = (p[:, 0] > q[:, 0]) | ((p[:, 0] == q[:, 0]) & (p[:, 1] > q[:, 1]))
    pieces = np.column_stack([own, np.where(back[:, None], q, p), np.where(back[:, None], p, q)])
    pieces = pieces[np.lexsort(pieces.T[::-1])]
    pieces = pieces[np.r_[True, (pieces[1:] != pieces[:-1]).any(axis=1)][: len(pieces)]]
    own, (ax, ay, bx, by) = pieces[:, 0].astype(int), pieces[:, 1:].T
    length = np.hypot(bx - ax, by - ay)
    away = np.minimum(100.0, length / 4)
    mx, my, nx, ny = (ax + bx) / 2, (ay + by) / 2, -(by - ay) / length * away, (bx - ax) / length * away

    def inside(px: np.ndarray, py: np.ndarray) -> np.ndarray:
        out = np.zeros(len(px), dtype=bool)
        for k in range(0, len(px), max(1, STEP // few)):
            part = slice(k, k + max(1, STEP // few))
            fx, fy, tx, ty = np.moveaxis(s[own[part]], 2, 0)
            v = py[part, None]
            at = fx + (tx - fx) * (v - fy) / np.where(ty == fy, 1.0, ty - fy)
            out[part] = (((fy > v) != (ty > v)) & (px[part, None] < at)).sum(axis=1) % 2 == 1
        return out

    left, right = inside(mx + nx, my + ny), inside(mx - nx, my - ny)
    kept = left != right
    chosen = [((a, b), (c, d)) if inner else ((c, d), (a, b)) for (_, a, b, c, d), inner in zip(pieces[kept].tolist(), left[kept].tolist(), strict=True)]
    bounds = np.searchsorted(own[kept], np.arange(n + 1)).tolist()
    return [_assembled(chosen[i:j], float(g), lo) for i, j, g, lo in zip(bounds, bounds[1:], grid, low, strict=False)]


def _turns_once(p: np.ndarray) -> np.ndarray:
    """Which rings ``(ring, point, 2)``, without their last point, only turn one way, once round."""
    step = np.roll(p, -1, axis=1) - p
    then = np.roll(step, -1, axis=1)
    turn = step[..., 0] * then[..., 1] - step[..., 1] * then[..., 0]
    around = np.arctan2(turn, (step * then).sum(axis=2)).sum(axis=1)
    return ((turn > 0).all(axis=1) | (turn < 0).all(axis=1)) & (np.abs(around) <= 2 * math.pi + 1e-6)


def _packed(points: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept points of each row first, and how many they are."""
    many = keep.sum(axis=1)
    order = np.argsort(~keep, axis=1, kind="stable")[:, : max(1, int(many.max(initial=0)))]
    return np.take_along_axis(points, order[..., None], axis=1), many


def _inwards(p: np.ndarray, distance: float) -> tuple[np.ndarray, np.ndarray]:
    """``shrunk`` for rings that ``_turns_once`` holds for: cut by each side moved inwards. Points ``(ring, point, 2)`` and how many, 0 if nothing is left."""
    a, b, c = p[:, 0], p[:, 1], p[:, 2]
    back = (b[:, 0] - a[:, 0]) * (c[:, 1] - b[:, 1]) < (b[:, 1] - a[:, 1]) * (c[:, 0] - b[:, 0])
    p = np.where(back[:, None, None], p[:, ::-1], p)
    step = np.roll(p, -1, axis=1) - p
    left, many = p, np.full(len(p), p.shape[1])
    for k in range(p.shape[1]):
        (x0, y0), (dx, dy) = p[:, k].T[..., None], step[:, k].T[..., None]
        place = np.arange(left.shape[1])
        there, after = place < many[:, None], np.where(place + 1 < many[:, None], place + 1, 0)
        far = ((left[..., 1] - y0) * dx - (left[..., 0] - x0) * dy) / np.hypot(dx, dy) - distance
        then = np.take_along_axis(far, after, axis=1)
        across = there & ((far >= 0) != (then >= 0))
        share = far / np.where(across, far - then, 1.0)
        met = np.where(across[..., None], left + share[..., None] * (np.take_along_axis(left, after[..., None], axis=1) - left), left)
        width = 2 * left.shape[1]
        left, many = _packed(np.stack([left, met], axis=2).reshape(len(p), width, 2), np.stack([there & (far >= 0), across], axis=2).reshape(len(p), width))
        place = np.arange(left.shape[1])
        before = np.where(place > 0, place - 1, many[:, None] - 1)
        again = (left == np.take_along_axis(left, before[..., None], axis=1)).all(axis=2)
        left, many = _packed(left, (place < many[:, None]) & (~again | (many[:, None] == 1)))
    place = np.arange(left.shape[1])
    x, y = np.moveaxis(left - left[:, :1], 2, 0)
    after = np.where(place + 1 < many[:, None], place + 1, 0)
    doubled = np.where(place < many[:, None], x * np.take_along_axis(y, after, axis=1) - np.take_along_axis(x, after, axis=1) * y, 0.0).sum(axis=1)
    return left, np.where((many >= 3) & (doubled > 0), many, 0)


def _convex(ring: list, distance: float) -> list | None:
    """``shrunk`` for a ring that only turns one way. None for others."""
    p = np.array([[x[:2] for x in ring[:-1]]], dtype=float)
    if p.shape[1] < 3:
        return []
    if not _turns_once(p)[0]:
        return None
    points, many = _inwards(p, distance)
    left = [tuple(x) for x in points[0, : many[0]].tolist()]
    return [[[*left, left[0]]]] if left else []


def shrunk(rings: list, distance: float) -> list:
    """A polygon without the places nearer than ``distance`` to its border (arcs in ``QUARTER`` pieces a quarter circle)."""
    if len(rings) == 1 and (left := _convex(rings[0], distance)) is not None:
        return left
    rims = []
    for x0, y0, x1, y1 in _sides(rings).tolist():
        along = math.atan2(y1 - y0, x1 - x0)
        turn = [math.pi / 2 * (1 - k / QUARTER) for k in range(2 * QUARTER + 1)]
        rim = [(x1 + distance * math.cos(along + t), y1 + distance * math.sin(along + t)) for t in turn]
        rim += [(x0 - distance * math.cos(along + t), y0 - distance * math.sin(along + t)) for t in turn]
        rims.append([[*rim, rim[0]]])
    return overlay([rings, *rims], lambda held: held[0] & ~held[1:].any(axis=0))


def _mapped(run: Callable[[list], list], wkb: Column) -> Column:
    @F.pandas_udf("binary")
    def made(wkb: pd.Series) -> pd.Series:
        return pd.Series(run(wkb.tolist()), dtype=object)

    return made(wkb)


def _packing(found: list) -> bytes | None:
    return encode(MULTI_POLYGON, found) if found else None


def _valid(wkbs: list) -> list:
    """``make_valid`` for many: single polygons of as many sides are repaired together."""
    out, todo = [None] * len(wkbs), {}
    for at, parts in by_layout(wkbs):
        alone = np.ones(len(at), dtype=bool)
        if parts is not None and len(parts) == 1 and parts[0]:
            if len(parts[0]) == 1 and parts[0][0].shape[1] >= 4:
                alone &= ~(round_ := _turns_once(parts[0][0][:, :-1]))
                for k, made in zip(at[round_].tolist(), encode_rings(MULTI_POLYGON, parts[0][0][round_]), strict=True):
                    out[k] = made
            sides = [np.concatenate([r[:, :-1], r[:, 1:]], axis=2) for r in parts[0] if r.shape[1] >= 4]
            if 0 < sum(x.shape[1] for x in sides) <= FEW:
                sides = np.concatenate(sides, axis=1)
                full = alone & (sides[..., :2] != sides[..., 2:]).any(axis=2).all(axis=1)
                todo.setdefault(sides.shape[1], []).append((at[full], sides[full]))
                alone &= ~full
        for k in at[alone].tolist():
            out[k] = _packing(united(polygons(wkbs[k])))
    for lots in todo.values():
        at, sides = (np.concatenate(x) for x in zip(*lots, strict=True))
        for k, found in zip(at.tolist(), _together(sides) if len(at) else [], strict=True):
            out[k] = _packing(found)
    return out


def _less(wkbs: list, distance: float) -> list:
    """``buffer_in`` for many: those of one ring that only turns one way are cut together."""
    out = [None] * len(wkbs)
    for at, parts in by_layout(wkbs):
        alone = np.ones(len(at), dtype=bool)
        if parts is not None and len(parts) == 1 and len(parts[0]) == 1 and parts[0][0].shape[1] >= 4:
            p = parts[0][0][:, :-1]
            alone = ~(round_ := _turns_once(p))
            left, many = _inwards(p[round_], distance)
            for n in np.unique(many[many > 0]):
                mine = many == n
                for k, made in zip(at[round_][mine].tolist(), encode_rings(MULTI_POLYGON, left[mine][:, [*range(n), 0]]), strict=True):
                    out[k] = made
        for k in at[alone].tolist():
            out[k] = _packing([p for q in united(polygons(wkbs[k])) for p in shrunk(q, distance)])
    return out


def make_valid(wkb: Column) -> Column:
    """A geometry's polygons, each repaired, and united; null where nothing is left."""
    return _mapped(_valid, wkb)


def buffer_in(wkb: Column, distance: float) -> Column:
    """A geometry's polygons without a margin of ``distance``; null where nothing is left."""
    return _mapped(lambda wkbs: _less(wkbs, distance), wkb)


def union_by(rows: DataFrame, keys: Sequence[str], geom: str = "geom") -> DataFrame:
    """``keys, geom``: the union of each group's polygons, a group being one task's work."""
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def unite(table: pa.Table) -> pa.Table:
        found = united([p for w in dict.fromkeys(table.column(geom).to_pylist()) if w is not None for p in polygons(w)])
        head = table.select(list(keys)).slice(0, 1 if found else 0)
        return head.append_column(geom, pa.array([encode(MULTI_POLYGON, found)] if found else [], pa.binary()))

    # The rows are few and the work on them is long, so they keep all partitions.
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*keys, geom).repartition(n, *keys).groupBy(*keys).applyInArrow(unite, f"{schema}, {geom} binary")
