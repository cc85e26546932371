"""How much a feature shows of the yearly peak: weights of cutlines passed on to features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import SIGMA, delta_days, exposure, try_date
from ..functions.geometry import clip_to_box
from ..functions.numbers import clamp01
from ..functions.overlay import union_by
from .spatial import merged_length, points_in_boxes, segments_in_boxes, segments_in_polygons, with_cells


def cutline_attributes(cutlines: DataFrame, date: str = "acqdate", sigma: float = SIGMA, **peak) -> DataFrame:
    """``norm_input_exp`` and ``days_from_max_exp`` of each cutline, both 0 without a date."""
    day = try_date(F.col(date))
    return cutlines.withColumns({
        "norm_input_exp": F.coalesce(exposure(day, sigma, **peak), F.lit(0.0)),
        "days_from_max_exp": F.coalesce(F.bround(delta_days(day, **peak).cast("double"), 0).cast("int"), F.lit(0)),
    })


def dissolve_by_date(cutlines: DataFrame, date: str = "acqdate") -> DataFrame:
    """One row per date: its weight and its boxes. Cutlines without a date go."""
    box = F.struct("minx", "miny", "maxx", "maxy")
    rows = cutline_attributes(cutlines.where(try_date(F.col(date)).isNotNull()), date)
    return rows.groupBy(date).agg(F.first("norm_input_exp").alias("norm_input_exp"), F.sort_array(F.collect_set(box)).alias("boxes"), F.count("*").alias("n_cutlines"))


def dissolved(cutlines: DataFrame, keys: Sequence[str], size: float, geom: str = "geom") -> DataFrame:
    """The union of the polygons of each group, cut by grid cells: ``keys, gx, gy, geom``.

    Polygons go, clipped, to the cells of ``size`` that their boxes ``(minx, ...)`` touch,
    so a task unites what lies in one cell, however many polygons a group has.
    """
    cells = with_cells(cutlines, size)
    edge = lambda c, k: (F.col(c) + k).cast("double") * F.lit(float(size))
    parts = cells.withColumn(geom, clip_to_box(F.col(geom), edge("gx", 0), edge("gy", 0), edge("gx", 1), edge("gy", 1)))
    return union_by(parts.where(F.col(geom).isNotNull()), [*keys, "gx", "gy"], geom)


def node_exposure(points: DataFrame, cutlines: DataFrame, size: float, node: str = "node_id", date: str = "acqdate") -> DataFrame:
    """Mean weight and number of the dates whose cutlines hold a node, 0 where none does."""
    weighed = cutline_attributes(cutlines.where(F.col(date).isNotNull()), date)
    pairs = points_in_boxes(points, weighed, size).select(node, date, "norm_input_exp").distinct()
    found = pairs.groupBy(node).agg(F.avg("norm_input_exp").alias("norm_input_exp"), F.count("*").alias("input_exp_cnt"))
    out = points.select(node).join(found, node, "left")
    return out.withColumns({"norm_input_exp": F.coalesce("norm_input_exp", F.lit(0.0)), "input_exp_cnt": F.coalesce("input_exp_cnt", F.lit(0))})


def edge_exposure(segments: DataFrame, cutlines: DataFrame, size: float, edge: str = "edge_id", date: str = "acqdate", group: Sequence[str] | None = None, geom: str | None = None) -> DataFrame:
    """Weights of dates averaged by the share of an edge each covers, and how many do.

    With ``group`` the segments of a group are one feature. Cutlines are boxes, or where
    ``geom`` names their WKB, polygons within these boxes. Parts of one date are merged
    along each segment, so cutlines that overlap count once.
    """
    group = list(group or [edge])
    weighed = cutline_attributes(cutlines.where(F.col(date).isNotNull()), date)
    pairs = segments_in_boxes(segments, weighed, size) if geom is None else segments_in_polygons(segments, weighed, size, geom)
    covered = merged_length(pairs.select(*group, edge, date, "norm_input_exp", "lo", "hi") if edge not in group else pairs, list(dict.fromkeys([*group, edge, date, "norm_input_exp"])))
    covered = covered.groupBy(*group, date, "norm_input_exp").agg(F.sum("covered").alias("covered"))
    found = covered.groupBy(*group).agg(
        clamp01(F.sum(F.col("covered") * F.col("norm_input_exp")) / F.sum("covered")).alias("norm_input_exp"), F.count("*").alias("input_exp_cnt")
    )
    out = segments.select(*group).distinct().join(found, group, "left")
    return out.withColumns({"norm_input_exp": F.coalesce("norm_input_exp", F.lit(0.0)), "input_exp_cnt": F.coalesce("input_exp_cnt", F.lit(0))})


def coverage(cutlines: DataFrame, keys: Sequence[str], area: str, subtile_area: float = 375e6) -> DataFrame:
    """Area-weighted weight of a subtile's cutlines, and the share of it they cover."""
    total = F.sum(area)
    return cutlines.groupBy(*keys).agg(
        clamp01(F.when(total > 0, F.sum(F.col("norm_input_exp") * F.col(area)) / total).otherwise(F.lit(0.0))).alias("exposure"),
        clamp01(total / F.lit(float(subtile_area))).alias("input_coverage"),
    )
