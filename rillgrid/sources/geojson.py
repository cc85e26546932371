"""GeoJSON polygons, and polygons of vector layers, in one reference system."""

from __future__ import annotations

import json
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import MULTI_POLYGON, encode, polygons
from ..functions.names import json_crs
from .files import parsed


def read_polygons(files: DataFrame) -> DataFrame:
    """Polygons of features, collections or bare geometries in files ``(path, content)``:
    ``path, crs, geom`` (WKB of multi-polygons)."""
    crs = files.select("path", json_crs(F.decode("content", "UTF-8")).alias("crs"))

    def parse(path: str, content: bytes) -> list[dict]:
        doc = json.loads(content)
        kind = doc.get("type")
        shapes = [f.get("geometry") for f in doc["features"]] if kind == "FeatureCollection" else [doc.get("geometry")] if kind == "Feature" else [doc]
        out = []
        for s in shapes:
            if s and s.get("type") in ("Polygon", "MultiPolygon"):
                parts = [s["coordinates"]] if s["type"] == "Polygon" else s["coordinates"]
                out.append({"path": path, "geom": encode(MULTI_POLYGON, parts)})
        return out

    return parsed(files, parse, "path string, geom binary").join(crs, "path").select("path", "crs", "geom")


def flattened(layer: DataFrame, geom: str = "geom") -> DataFrame:
    """Only the polygonal part of each geometry; rows without any go."""

    @F.pandas_udf("binary")
    def flat(wkb: pd.Series) -> pd.Series:
        return wkb.map(lambda w: encode(MULTI_POLYGON, ps) if (ps := polygons(w)) else None)

    return layer.withColumn(geom, flat(F.col(geom))).where(F.col(geom).isNotNull())


def rings(layer: DataFrame, geom: str = "geom") -> DataFrame:
    """Each ring of each polygon as an array of points: ``part, ring, points``."""

    @F.pandas_udf("array<struct<part: int, ring: int, points: array<struct<x: double, y: double>>>>")
    def split(wkb: pd.Series) -> pd.Series:
        return wkb.map(lambda w: [{"part": k, "ring": j, "points": [{"x": p[0], "y": p[1]} for p in r]} for k, poly in enumerate(polygons(w)) for j, r in enumerate(poly)])

    return layer.withColumn("ring_", F.explode(split(F.col(geom)))).select(*[c for c in layer.columns if c != geom], "ring_.part", "ring_.ring", "ring_.points")


