"""Spatial joins by grid cells: equality on cells first, exact tests after."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box_area, box_overlap, segment_parts, span_overlap

BOX = ("minx", "miny", "maxx", "maxy")


def _cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(float(size))).cast("long")


def with_cells(boxes: DataFrame, size: float, box: Sequence[str] = BOX) -> DataFrame:
    """Each row once for every grid cell ``(gx, gy)`` its box touches."""
    minx, miny, maxx, maxy = (F.col(c) for c in box)
    rows = boxes.withColumn("gx", F.explode(F.sequence(_cell(minx, size), _cell(maxx, size))))
    return rows.withColumn("gy", F.explode(F.sequence(_cell(miny, size), _cell(maxy, size))))


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Pairs of points ``(x, y)`` and the boxes they lie in, borders excluded."""
    p = points.withColumns({"gx": _cell(F.col("x"), size), "gy": _cell(F.col("y"), size)})
    inside = (F.col("x") > F.col("minx")) & (F.col("x") < F.col("maxx")) & (F.col("y") > F.col("miny")) & (F.col("y") < F.col("maxy"))
    return p.join(with_cells(boxes, size), ["gx", "gy"]).where(inside).drop("gx", "gy")


def boxes_meet(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """Pairs of boxes that touch; the left one's columns are ``a_minx`` ... .

    A pair that shares several cells is kept in the first of them.
    """
    a = with_cells(left.withColumnsRenamed({c: f"a_{c}" for c in BOX}), size, [f"a_{c}" for c in BOX])
    pair = a.join(with_cells(right, size), ["gx", "gy"])
    first = (F.col("gx") == F.greatest(_cell(F.col("a_minx"), size), _cell(F.col("minx"), size))) & (
        F.col("gy") == F.greatest(_cell(F.col("a_miny"), size), _cell(F.col("miny"), size))
    )
    touch = (F.col("a_minx") <= F.col("maxx")) & (F.col("minx") <= F.col("a_maxx")) & (F.col("a_miny") <= F.col("maxy")) & (F.col("miny") <= F.col("a_maxy"))
    return pair.where(first & touch).drop("gx", "gy")


def segments_in_boxes(segments: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Pairs of segments ``(x0, y0, x1, y1)``, of any slope, and boxes that share some length.

    ``lo`` and ``hi`` bound the shared part by its distance from the segment's start,
    ``whole`` is the segment's length (Liang and Barsky 1984).
    """
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    box = {"minx": F.least(x0, x1), "miny": F.least(y0, y1), "maxx": F.greatest(x0, x1), "maxy": F.greatest(y0, y1)}
    pair = boxes_meet(segments.withColumns(box), boxes, size)

    def span(start: Column, stop: Column, low: Column, high: Column) -> tuple[Column, Column]:
        step = F.nullif(stop - start, F.lit(0.0))
        inside = start.between(low, high)
        first, last = (low - start) / step, (high - start) / step
        return (
            F.when(step.isNull(), F.when(inside, F.lit(0.0)).otherwise(F.lit(2.0))).otherwise(F.least(first, last)),
            F.when(step.isNull(), F.lit(1.0)).otherwise(F.greatest(first, last)),
        )

    along_x, along_y = span(x0, x1, F.col("minx"), F.col("maxx")), span(y0, y1, F.col("miny"), F.col("maxy"))
    whole = F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))
    lo, hi = F.greatest(F.lit(0.0), along_x[0], along_y[0]), F.least(F.lit(1.0), along_x[1], along_y[1])
    return pair.withColumns({"lo": lo * whole, "hi": hi * whole, "whole": whole}).where("hi > lo")


def segments_in_polygons(segments: DataFrame, polygons: DataFrame, size: float, geom: str | Column = "geom", borders: bool = True) -> DataFrame:
    """The same for polygons and multi-polygons as WKB: a row for each part that a polygon holds.

    Bounding boxes (columns ``minx`` to ``maxy`` of ``polygons``) find the candidates.
    ``geom`` may be an expression over other columns: polygons are then made for the pairs
    alone and not sent to each cell. ``borders`` is as in ``geometry.segment_parts``.
    """
    found = segments_in_boxes(segments, polygons, size).drop("lo", "hi")

    @F.pandas_udf("array<struct<lo: double, hi: double>>")
    def parts(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series, geom: pd.Series) -> pd.Series:
        return pd.Series([[{"lo": a, "hi": b} for a, b in segment_parts(*x, borders=borders)] for x in zip(x0, y0, x1, y1, geom, strict=True)], dtype=object)

    return found.withColumn("part", F.explode(parts("x0", "y0", "x1", "y1", geom))).select("*", "part.lo", "part.hi").drop("part")


def merged_length(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Length of the union of intervals ``(lo, hi)`` by ``keys``."""
    before = Window.partitionBy(*keys).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max("hi").over(before), F.col("lo"))
    new = F.greatest(F.col("hi") - F.greatest(F.col("lo"), seen), F.lit(0.0))
    return spans.withColumn("new", new).groupBy(*keys).agg(F.sum("new").alias("covered"))


def clip_to_extent(boxes: DataFrame, extent: tuple[float, float, float, float]) -> DataFrame:
    """Boxes cut to an extent; those outside go."""
    e = [F.lit(float(x)) for x in extent]
    touch = (F.col("minx") < e[2]) & (F.col("maxx") > e[0]) & (F.col("miny") < e[3]) & (F.col("maxy") > e[1])
    return boxes.where(touch).withColumns({"minx": F.greatest("minx", e[0]), "miny": F.greatest("miny", e[1]), "maxx": F.least("maxx", e[2]), "maxy": F.least("maxy", e[3])})


def covered_fraction(tiles: DataFrame, boxes: DataFrame, key: str, size: float) -> DataFrame:
    """Share of each tile's box that disjoint ``boxes`` cover, 0 where none does."""
    pair = boxes_meet(tiles.select(key, *BOX), boxes, size)
    own = tuple(F.col(f"a_{c}") for c in BOX)
    shared = pair.groupBy(key).agg(F.sum(box_overlap(own, tuple(F.col(c) for c in BOX))).alias("shared"))
    area = box_area(*[F.col(c) for c in BOX])
    return tiles.join(shared, key, "left").select(key, (F.coalesce("shared", F.lit(0.0)) / area).alias("fraction"))


__all__ = ["boxes_meet", "clip_to_extent", "covered_fraction", "merged_length", "points_in_boxes", "segments_in_boxes", "segments_in_polygons", "span_overlap", "with_cells"]
