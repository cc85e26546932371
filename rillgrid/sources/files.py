"""Listing and writing files, configuration, lists and reports."""

from __future__ import annotations

import fcntl
import hashlib
import os
import tomllib
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.names import base_name, truthy


def load_toml(path: str) -> dict:
    with open(path, "rb") as f:
        return tomllib.load(f)


def cfg_get(config: dict, *keys: str, default=None):
    """A nested value, or ``default`` where any key is missing."""
    for key in keys:
        if not isinstance(config, dict) or key not in config:
            return default
        config = config[key]
    return config


def cfg_step(config: dict, step: str | Sequence[str], key: str, default=None, fall_back: bool = True):
    """A step's own value (``steps.<step>.key``, the first of several names), else the global one."""
    for name in [step] if isinstance(step, str) else step:
        if (own := cfg_get(config, "steps", name, key)) is not None:
            return own
    return cfg_get(config, "global", key, default=default) if fall_back else default


def listing(spark: SparkSession, path: str | Sequence[str], glob: str = "*") -> DataFrame:
    """Files below ``path`` by name pattern: ``path, name, modified, length``, once each.

    Only names are read; Spark's file index lists all folders in parallel.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return found.select("path", base_name(F.col("path")).alias("name"), F.col("modificationTime").alias("modified"), "length").distinct()


def rasters(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return listing(spark, path, "*.[tT][iI][fF]*").where(F.lower("name").rlike(r"\.tiff?$")).orderBy("path")


def excluding(files: DataFrame, words: Sequence[str], name: str = "name") -> DataFrame:
    """Files in whose name none of ``words`` stands, in any case."""
    for w in words:
        files = files.where(~F.lower(name).contains(w.lower()))
    return files


def tiles(files: DataFrame) -> DataFrame:
    """The folders that files lie in: tile ids."""
    return files.select(F.element_at(F.split("path", "/"), -2).alias("tile_id")).distinct().orderBy("tile_id")


def list_file(spark: SparkSession, path: str) -> DataFrame:
    """Paths, one a line; blanks go."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")


def bad_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV report that are not in order."""
    rows = spark.read.option("header", "true").csv(path)
    return rows.where(~truthy(F.col("ok"))) if "ok" in rows.columns else rows


def write_csv(rows: DataFrame, path: str, one_file: bool = True) -> None:
    (rows.coalesce(1) if one_file else rows).write.mode("overwrite").option("header", "true").csv(path)


def write_list(paths: DataFrame, path: str, column: str = "path") -> None:
    paths.select(column).write.mode("overwrite").text(path)


def contents(spark: SparkSession, path: str | Sequence[str], glob: str) -> DataFrame:
    """Files with their bytes: ``path, content``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return found.select("path", "content")


def parsed(files: DataFrame, parse: Callable[[str, bytes], list[dict]], schema: str) -> DataFrame:
    """The rows that ``parse`` makes of each file, file by file."""
    want = to_arrow_schema(StructType.fromDDL(schema))
    names = want.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if rows := parse(path, content):
                    yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in names} for r in rows], schema=want)

    return files.select("path", "content").mapInArrow(run, schema)


def write_files(rows: DataFrame, folder: str) -> None:
    """Write ``(name, content)`` rows as files below a folder that all executors mount.

    Each is written beside its place and then moved there, so a task that runs again
    leaves whole files.
    """

    def put(rows: Iterator) -> None:
        for r in rows:
            to = Path(folder) / r["name"]
            to.parent.mkdir(parents=True, exist_ok=True)
            part = to.with_name(f".{to.name}.{os.getpid()}")
            part.write_bytes(bytes(r["content"]))
            os.replace(part, to)

    rows.select("name", "content").foreachPartition(put)


@contextmanager
def locked(path: str) -> Iterator[None]:
    """One process at a time, by a lock file."""
    with open(path, "w") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        yield


def fetched(path: str, sha256: str, fetch: Callable[[str], None]) -> str:
    """A file with the given checksum, fetched once by whoever comes first."""
    with locked(f"{path}.lock"):
        if not os.path.exists(path) or hashlib.sha256(Path(path).read_bytes()).hexdigest() != sha256:
            fetch(path)
        if hashlib.sha256(Path(path).read_bytes()).hexdigest() != sha256:
            raise ValueError(f"{path} has another checksum")
    return path
