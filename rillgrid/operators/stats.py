"""Statistics of components, subtiles, tiles and the mosaic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.axial import axial_mean
from ..functions.numbers import fmt6, ratio, round_half_even


def p95_flagged(edges: DataFrame, keys: Sequence[str], length: str = "length_m") -> DataFrame:
    """Branches no longer than their group's 95th percentile (exact, interpolated)."""
    p95 = edges.groupBy(*keys).agg(F.percentile(length, 0.95).alias("p95"))
    return edges.join(p95, list(keys)).where(F.col(length) <= F.col("p95"))


def p95_mean(edges: DataFrame, keys: Sequence[str], length: str = "length_m", name: str = "mean_branch_len_95_m") -> DataFrame:
    """Mean length of those branches; equal lengths are counted first, so few rows meet.

    The percentile and the mean come from one table of counts by length.
    """
    counts = edges.groupBy(*keys, length).agg(F.count("*").alias("n"))
    p95 = counts.groupBy(*keys).agg(F.percentile(length, 0.95, F.col("n")).alias("p95"))
    kept = counts.join(p95, list(keys)).where(F.col(length) <= F.col("p95")) if keys else counts.crossJoin(F.broadcast(p95)).where(F.col(length) <= F.col("p95"))
    return kept.groupBy(*keys).agg((F.sum(F.col(length) * F.col("n")) / F.sum("n")).alias(name))


def component_stats(counts: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Component rows: counts, number of branches and their trimmed mean, 0 without any."""
    group = [*keys, "component_id"]
    lines = edges.groupBy(*group).agg(F.count("*").alias("num_edges"))
    out = counts.join(lines, group, "left").join(p95_mean(edges, group), group, "left")
    return out.withColumns({"num_edges": F.coalesce("num_edges", F.lit(0)), "mean_branch_len_95_m": F.coalesce("mean_branch_len_95_m", F.lit(0.0))})


def component_lines(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The branches of each component as one multi-line, in order of their numbers."""
    line = F.sort_array(F.collect_list(F.struct("edge_id", "points")))
    return edges.groupBy(*keys, "component_id").agg(F.transform(line, lambda x: x["points"]).alias("lines"), F.count("*").alias("num_edges"))


def totals(components: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Additive statistics of components by ``keys``; graph edges are half the degrees, rounded half to even."""
    num = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    whole = components.groupBy(*keys) if keys else components.groupBy()
    out = whole.agg(
        num("num_nodes").alias("num_graph_nodes"),
        round_half_even(F.sum(F.col("avg_degree") * F.col("num_nodes")) / 2).alias("num_graph_edges"),
        num("num_endnodes").alias("num_endnodes"),
        num("num_junctions").alias("num_junctions"),
        num("num_edges").alias("num_edges"),
        F.count("*").alias("num_components"),
        F.sum("total_length_m").alias("total_length_m"),
        F.avg("total_length_m").alias("mean_component_length_m"),
        F.max("total_length_m").alias("max_component_length_m"),
    )
    return out.withColumn("avg_degree", average_degree(F.col("num_graph_edges"), F.col("num_graph_nodes")))


def totals_by_level(components: DataFrame, tile: str = "tile_id", sub: str = "sub_tile_id") -> DataFrame:
    """Additive statistics of subtiles, tiles and the mosaic in one pass (``level`` 0, 1, 3)."""
    return components.rollup(tile, sub).agg(
        F.grouping_id().cast("int").alias("level"),
        F.sum("num_nodes").cast("long").alias("num_graph_nodes"),
        F.count("*").alias("num_components"),
        F.sum("num_edges").cast("long").alias("num_edges"),
    )


def average_degree(edges: Column, nodes: Column) -> Column:
    return F.when(nodes > 0, 2 * edges / nodes).otherwise(F.lit(0.0)).cast("double")


def orientation(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Axial means of branches: plain, and weighted by length."""
    return edges.groupBy(*keys).agg(
        axial_mean(F.col("orientation_deg_axial")).alias("axial_plain"),
        axial_mean(F.col("orientation_deg_axial"), F.col("length_m")).alias("axial_weighted"),
    )


def tile_stats(components: DataFrame, edges: DataFrame, keys: Sequence[str] = ("tile_id",)) -> DataFrame:
    """One row per group: totals, trimmed branch mean over all its branches, direction."""
    mean = p95_mean(edges, keys)
    way = edges.groupBy(*keys).agg(axial_mean(F.col("orientation_deg_axial"), F.col("length_m")).alias("orientation_deg_axial"))
    out = totals(components, keys).join(mean, list(keys), "left").join(way, list(keys), "left")
    return out.withColumns({"mean_branch_len_95_m": F.coalesce("mean_branch_len_95_m", F.lit(0.0)), "orientation_deg_axial": F.coalesce("orientation_deg_axial", F.lit(-1.0))})


def numbered(rows: DataFrame, order: str = "tile_id", name: str = "id") -> DataFrame:
    """Rows numbered from 1 by ``order``. Rows are one per tile, few enough for one window."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(order)).cast("long"))


def mosaic(tiles: DataFrame) -> DataFrame:
    """One row over all tiles: sums, and means weighted by components and by branches.

    The direction is weighted by graph edges, tiles without one left out.
    """
    total = lambda c: F.sum(c)
    return tiles.groupBy().agg(
        F.count("*").alias("num_tiles"),
        *[total(c).cast("long").alias(c) for c in ("num_graph_nodes", "num_graph_edges", "num_endnodes", "num_junctions", "num_components", "num_edges")],
        total("total_length_m").alias("total_length_m"),
        F.max("max_component_length_m").alias("max_component_length_m"),
        ratio(total("total_length_m"), total("num_components")).alias("mean_component_length_m"),
        ratio(total(F.col("mean_branch_len_95_m") * F.col("num_edges")), total("num_edges")).alias("mean_branch_len_95_m"),
        average_degree(total("num_graph_edges"), total("num_graph_nodes")).alias("avg_degree"),
        axial_mean(F.col("orientation_deg_axial"), F.col("num_graph_edges").cast("double"), negative="skip").alias("orientation_deg_axial"),
    )


def per_component(rows: DataFrame, names: Sequence[str] = ("num_graph_nodes", "num_graph_edges", "num_endnodes", "num_junctions", "num_edges")) -> DataFrame:
    """Counts replaced by their averages per component, 0 without components."""
    out = rows
    for name in names:
        out = out.withColumn(f"avg_{name}", ratio(F.col(name), F.col("num_components")))
    return out.drop(*names)


def summary_xml(fields: Sequence[tuple[str, Column]], root: str) -> Column:
    """A row as XML: whole numbers as they are, others with six decimals."""
    parts = [F.lit(f"<{root}>\n")]
    for name, value in fields:
        parts += [F.lit(f"  <{name}>"), value, F.lit(f"</{name}>\n")]
    return F.concat(*parts, F.lit(f"</{root}>"))


def tile_xml(rows: DataFrame) -> DataFrame:
    whole = ("num_graph_nodes", "num_graph_edges", "num_components", "num_edges")
    real = ("total_length_m", "mean_component_length_m", "max_component_length_m", "avg_degree")
    fields = [("tile_id", F.col("tile_id").cast("string")), *[(c, F.col(c).cast("string")) for c in whole], *[(c, fmt6(F.col(c))) for c in real]]
    return rows.select("tile_id", summary_xml(fields, "TileSummary").alias("xml"))


def metadata(xml: DataFrame, links: Sequence[tuple[str, str]], row_id: str = "tile_id") -> tuple[DataFrame, DataFrame]:
    """The ``metadata`` rows of XML texts, and a ``metadata_reference`` row for each (scope, table) they are linked to."""
    rows = xml.select(F.row_number().over(Window.orderBy(row_id)).cast("long").alias("id"), F.col(row_id).alias("row_id_value"), F.lit("text/xml").alias("mime_type"), F.col("xml").alias("metadata"))
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("reference_scope"), F.lit(t).alias("table_name")) for s, t in links]))
    refs = rows.select(F.col("id").alias("md_file_id"), "row_id_value", each.alias("x")).select("md_file_id", "row_id_value", "x.*")
    return rows.drop("row_id_value"), refs
