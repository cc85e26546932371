"""Masks against water: which tiles go, stay, or are rewritten at the shore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of ocean at which a tile goes, and below which it stays as it is.
DROP_AT, KEEP_BELOW = 0.99, 0.01


def decision(fraction: Column, ocean: Column, land: Column, has_crs: Column, drop_at: float = DROP_AT, keep_below: float = KEEP_BELOW) -> Column:
    """DROP, KEEP or BOUNDARY_REWRITE from the ocean's share of a tile and its pixel counts."""
    return (
        F.when(~has_crs, F.lit("ERROR: no CRS"))
        .when(fraction >= drop_at, F.lit("DROP"))
        .when(fraction < keep_below, F.lit("KEEP"))
        .when((F.coalesce(ocean, F.lit(0)) > 0) & (F.coalesce(land, F.lit(0)) > 0), F.lit("BOUNDARY_REWRITE"))
        .otherwise(F.lit("KEEP"))
    )


def pixel_shares(pixels: DataFrame, key: str) -> DataFrame:
    """Ocean and land pixels among the valid ones (columns ``is_valid``, ``ocean``)."""
    ocean, land = F.col("is_valid") & F.col("ocean"), F.col("is_valid") & ~F.col("ocean")
    out = pixels.groupBy(key).agg(F.count_if(F.col("is_valid")).alias("n_valid"), F.count_if(ocean).alias("n_ocean"), F.count_if(land).alias("n_land"))
    return out.withColumn("raster_fraction", F.when(F.col("n_valid") > 0, F.col("n_ocean") / F.col("n_valid")).otherwise(F.lit(0.0)))


def decision_counts(decisions: DataFrame) -> DataFrame:
    kind = F.when(F.col("decision").startswith("ERROR"), F.lit("ERROR")).otherwise(F.col("decision"))
    return decisions.groupBy(kind.alias("decision")).agg(F.count("*").alias("n"))
