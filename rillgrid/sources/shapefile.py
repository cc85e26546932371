"""Shapefiles: polygons and their attributes, paired by file name and record number."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import LINE, MULTI_LINE, POINT, POLYGON, encode
from .files import parsed

# Shape types of the format.
NULL, SHAPE_POINT, SHAPE_LINE, SHAPE_POLYGON = 0, 1, 3, 5


def _shapes(content: bytes) -> list[bytes | None]:
    out, at = [], 100
    while at + 8 <= len(content):
        _, words = struct.unpack_from(">II", content, at)
        (kind,) = struct.unpack_from("<I", content, at + 8)
        body = at + 12
        if kind % 10 == SHAPE_POINT:
            out.append(encode(POINT, list(struct.unpack_from("<dd", content, body))))
        elif kind % 10 in (SHAPE_LINE, SHAPE_POLYGON):
            n_parts, n_points = struct.unpack_from("<II", content, body + 32)
            starts = [*struct.unpack_from(f"<{n_parts}I", content, body + 40), n_points]
            flat = struct.unpack_from(f"<{2 * n_points}d", content, body + 40 + 4 * n_parts)
            points = list(zip(flat[::2], flat[1::2], strict=True))
            parts = [points[a:b] for a, b in zip(starts, starts[1:], strict=False)]
            if kind % 10 == SHAPE_POLYGON:
                out.append(encode(POLYGON, parts))
            else:
                out.append(encode(LINE, parts[0]) if len(parts) == 1 else encode(MULTI_LINE, parts))
        else:
            out.append(None)
        at += 8 + 2 * words
    return out


def _records(content: bytes) -> list[dict]:
    n, head, size = struct.unpack_from("<IHH", content, 4)
    fields, at, place = [], 32, 1
    while content[at] != 0x0D:
        name = content[at : at + 11].split(b"\0")[0].decode("latin-1")
        fields.append((name, place, content[at + 16]))
        place += content[at + 16]
        at += 32
    rows = []
    for k in range(n):
        row = content[head + k * size : head + (k + 1) * size]
        rows.append({name: row[p : p + w].decode("utf-8", "replace").strip() or None for name, p, w in fields})
    return rows


def read(files: DataFrame) -> DataFrame:
    """Shapes of ``.shp`` files with the attributes of the ``.dbf`` beside them.

    ``stem`` (the path without its ending), ``record``, ``geom`` (WKB), ``attributes`` (a map).
    """
    ending = F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1))
    shp = parsed(files.where(ending == "shp"), lambda path, c: [{"stem": path[:-4], "record": k, "geom": g} for k, g in enumerate(_shapes(c))], "stem string, record int, geom binary")
    dbf = parsed(files.where(ending == "dbf"), lambda path, c: [{"stem": path[:-4], "record": k, "attributes": list(r.items())} for k, r in enumerate(_records(c))], "stem string, record int, attributes map<string, string>")
    return shp.join(dbf, ["stem", "record"], "left")


def write(polygons: list[list], attributes: list[dict]) -> tuple[bytes, bytes]:
    """A ``.shp`` and a ``.dbf`` of polygons, each a list of rings."""
    body, box = b"", [1e300, 1e300, -1e300, -1e300]
    for k, rings in enumerate(polygons):
        points = [p for r in rings for p in r]
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        own = (min(xs), min(ys), max(xs), max(ys))
        box = [min(box[0], own[0]), min(box[1], own[1]), max(box[2], own[2]), max(box[3], own[3])]
        starts, n = [], 0
        for r in rings:
            starts.append(n)
            n += len(r)
        shape = struct.pack(f"<I4dII{len(starts)}I", SHAPE_POLYGON, *own, len(starts), n, *starts) + b"".join(struct.pack("<dd", *p) for p in points)
        body += struct.pack(">II", k + 1, len(shape) // 2) + shape
    head = struct.pack(">7I", 9994, 0, 0, 0, 0, 0, (100 + len(body)) // 2) + struct.pack("<II8d", 1000, SHAPE_POLYGON, *box, 0, 0, 0, 0)
    names = list(attributes[0]) if attributes else []
    width = 64
    dbf = struct.pack("<BBBBIHH20x", 3, 124, 1, 1, len(attributes), 33 + 32 * len(names), 1 + width * len(names))
    for name in names:
        dbf += struct.pack("<11sc4xBB14x", name.encode()[:10], b"C", width, 0)
    dbf += b"\r" + b"".join(b" " + b"".join(str(a[n]).encode()[:width].ljust(width) for n in names) for a in attributes)
    return head + body, dbf
