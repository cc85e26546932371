"""Resuming, completeness, layers and reference systems of packages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import expected_package, join_list, natural_key


def pending(masks: DataFrame, done: DataFrame, name: str = "name") -> DataFrame:
    """Masks whose package is not there."""
    return masks.withColumn("package", expected_package(F.col(name))).join(done.select(F.col(name).alias("package")), "package", "left_anti")


def finished(masks: DataFrame, done: DataFrame, name: str = "name") -> DataFrame:
    return masks.withColumn("package", expected_package(F.col(name))).join(done.select(F.col(name).alias("package")), "package", "left_semi")


def without_aggregate(tiles: DataFrame, summaries: DataFrame, key: str) -> DataFrame:
    """Tiles for which there is no summary."""
    return tiles.join(summaries.select(key), key, "left_anti")


def status_report(masks: DataFrame, done: DataFrame, name: str = "name", sub: str = "sub") -> DataFrame:
    """Per tile and in all: masks, packages, what is left, and the open subtiles in natural order."""
    rows = masks.withColumn("package", expected_package(F.col(name))).join(done.select(F.col(name).alias("package"), F.lit(True).alias("ok")), "package", "left")
    left = F.col("ok").isNull()
    opened = F.sort_array(F.collect_list(F.when(left, F.struct(natural_key(F.col(sub).cast("string")).alias("k"), F.col(sub).cast("string").alias("s")))))
    tiles = rows.groupBy("tile_id").agg(F.count("*").alias("total"), F.count("ok").alias("done"), F.count_if(left).alias("balance"), opened.alias("opened"))
    listed = F.array_join(F.transform("opened", lambda x: x["s"]), ",")
    each = tiles.select(F.col("tile_id").cast("string").alias("tile_id"), "total", "done", "balance", listed.alias("pending"))
    # The sum adds counts of tasks; it has no list.
    whole = rows.agg(F.count("*").alias("total"), F.count("ok").alias("done"), F.count_if(left).alias("balance"))
    return each.unionByName(whole.select(F.lit("SUM").alias("tile_id"), "total", "done", "balance", F.lit("").alias("pending")))


def round_robin(rows: DataFrame, order: Sequence[str], world: int, rank: int) -> DataFrame:
    """The ``rank``-th share (from 1) of rows dealt in turn. A list of tiles, one window."""
    place = F.row_number().over(Window.orderBy(*order)) - 1
    return rows.withColumn("place", place.cast("long")).where((F.col("place") % world) == rank - 1).drop("place")


def sliced(rows: DataFrame, order: Sequence[str], first: int, last: int) -> DataFrame:
    """Rows ``first`` to ``last``, from 1, both included; none if ``first`` is above ``last``."""
    place = F.row_number().over(Window.orderBy(*order))
    return rows.withColumn("place", place.cast("long")).where(F.col("place").between(first, last)).drop("place")


def capped(rows: DataFrame, order: Sequence[str], cap: int) -> DataFrame:
    """The first ``cap`` rows over all tiles; 0 is no cap."""
    return rows if cap <= 0 else rows.orderBy(*order).limit(cap)


def latest(files: DataFrame, keys: Sequence[str], path: str = "path", time: str = "modified") -> DataFrame:
    """The newest file of each group; of files of one time the last by name."""
    return files.groupBy(*keys).agg(F.max_by(path, F.struct(time, path)).alias(path), F.max(time).alias(time))


def complete(rows: DataFrame, keys: Sequence[str], fields: Sequence[str], least: int = 1) -> DataFrame:
    """Has a layer at least ``least`` rows in which all ``fields`` are set?"""
    every = F.lit(True)
    for f in fields:
        every = every & F.col(f).isNotNull()
    return rows.groupBy(*keys).agg(F.count_if(every).alias("n_set")).withColumn("is_complete", F.col("n_set") >= least)


def missing_fields(present: Column, required: Sequence[str]) -> Column:
    return F.array_except(F.array(*[F.lit(f) for f in required]), present)


def layer_report(layers: DataFrame, key: str, expected: Sequence[str], layer: str = "layer", srs: str = "srs_id", sample_srs: int | None = None) -> DataFrame:
    """Layers missing and extra against a sample, one reference system or several, all in order?"""
    want = F.array(*[F.lit(x) for x in sorted(expected)])
    out = layers.groupBy(key).agg(F.sort_array(F.collect_set(layer)).alias("present"), F.sort_array(F.collect_set(srs)).alias("systems"))
    lone = F.size("systems") <= 1
    same = F.lit(True) if sample_srs is None else F.coalesce(lone & (F.get("systems", F.lit(0)) == sample_srs), F.lit(False))
    missing, extra = F.array_except(want, F.col("present")), F.array_except(F.col("present"), want)
    return out.select(
        key, join_list(missing).alias("missing"), join_list(extra).alias("extra"), lone.alias("crs_consistent"), same.alias("crs_matches"),
        (lone & same & (F.size(missing) == 0) & (F.size(extra) == 0)).alias("ok"),
    )


def crs_problems(layers: DataFrame, target: int, srs: str = "srs_id", opened: str = "opened") -> DataFrame:
    """One row for each layer with a problem, and what it is."""
    problem = (
        F.when(~F.col(opened), F.lit("cannot be opened"))
        .when(F.col(srs).isNull() | (F.col(srs) == 0), F.lit("no reference system"))
        .when(F.col(srs) < 0, F.lit("reference system not understood"))
        .when(F.col(srs) != target, F.concat(F.lit("EPSG:"), F.col(srs).cast("string"), F.lit(f" is not EPSG:{target}")))
    )
    return layers.withColumn("problem", problem).where(F.col("problem").isNotNull())


def repair_crs(layers: DataFrame, target: int, mode: str = "fill", srs: str = "srs_id") -> DataFrame:
    """Layers with the system they get: ``fill`` sets what is null or 0, ``force`` all that differ."""
    current = F.col(srs)
    lacks = current.isNull() | (current == 0)
    needs = lacks if mode == "fill" else lacks | (current != target)
    if mode not in ("fill", "force"):
        raise ValueError("mode is 'fill' or 'force'")
    return layers.withColumns({"changed": needs, srs: F.when(needs, F.lit(target)).otherwise(current)})


def merge_attributes(rows: DataFrame, updates: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows with the updates of their keys: unmatched rows stay; nulls and lacking keys change nothing."""
    new = updates.select(*keys, *[F.col(c).alias(f"new_{c}") for c in columns])
    out = rows.join(new, list(keys), "left")
    return out.select(*[F.coalesce(f"new_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def aligned(rows: DataFrame, columns: Sequence[tuple[str, str]]) -> DataFrame:
    """Exactly the given columns: extras go, missing ones are null."""
    have = {c.lower() for c in rows.columns}
    return rows.select(*[F.col(c).cast(t).alias(c) if c.lower() in have else F.lit(None).cast(t).alias(c) for c, t in columns])


def common_srs(layers: DataFrame, srs: str = "srs_id") -> DataFrame:
    """The reference system that most layers have; of equal ones the least."""
    counts = layers.where(F.col(srs).isNotNull()).groupBy(srs).agg(F.count("*").alias("n"))
    return counts.agg(F.max_by(srs, F.struct(F.col("n"), -F.col(srs))).alias(srs), F.max("n").alias("n"))
