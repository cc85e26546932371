"""GeoPackage: layers, tables, reference systems and metadata of SQLite files."""

from __future__ import annotations

import json
import sqlite3
import struct
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.geometry import decode
from .files import contents, parsed

# The tables that a GeoPackage must have, and types by SQLite name.
CORE = ("gpkg_contents", "gpkg_spatial_ref_sys")
APPLICATION_ID = 0x47504B47
SQL_TYPES = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "tinyint": "INTEGER", "boolean": "INTEGER", "double": "REAL", "float": "REAL", "binary": "BLOB"}


def open_bytes(content: bytes) -> sqlite3.Connection:
    con = sqlite3.connect(":memory:")
    con.deserialize(content)
    con.row_factory = sqlite3.Row
    return con


def geometry_blob(wkb: bytes | None, srs_id: int) -> bytes | None:
    """A GeoPackage geometry: a header without envelope, then WKB."""
    return None if wkb is None else b"GP\x00\x01" + struct.pack("<i", srs_id) + wkb


def blob_wkb(blob: bytes | None) -> bytes | None:
    """The WKB of a GeoPackage geometry; null for an empty one."""
    if blob is None or blob[:2] != b"GP" or blob[3] & 0x10:
        return None
    return blob[8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7] :]


def _has(con: sqlite3.Connection, table: str) -> bool:
    return con.execute("SELECT count(*) FROM sqlite_master WHERE type IN ('table', 'view') AND name = ?", (table,)).fetchone()[0] > 0


def _safe(parse):
    """A file that is no database gives one row with the error."""

    def run(path: str, content: bytes) -> list[dict]:
        try:
            con = open_bytes(content)
            try:
                return parse(con, path)
            finally:
                con.close()
        except sqlite3.DatabaseError as e:
            return [{"path": path, "error": str(e)}]

    return run


def packages(spark: SparkSession, path: str | Sequence[str], glob: str = "*.gpkg") -> DataFrame:
    return contents(spark, path, glob)


def layers(files: DataFrame) -> DataFrame:
    """Layers of each file: from its contents table, else its geometry columns, else all its tables."""

    def parse(con: sqlite3.Connection, path: str) -> list[dict]:
        for table, query in (
            ("gpkg_contents", "SELECT table_name AS layer, data_type, srs_id FROM gpkg_contents"),
            ("gpkg_geometry_columns", "SELECT table_name AS layer, 'features' AS data_type, srs_id FROM gpkg_geometry_columns"),
            ("sqlite_master", "SELECT name AS layer, type AS data_type, NULL AS srs_id FROM sqlite_master WHERE type = 'table'"),
        ):
            if (table == "sqlite_master" or _has(con, table)) and (rows := con.execute(query).fetchall()):
                return [{"path": path, **dict(r)} for r in rows]
        return []

    return parsed(files, _safe(parse), "path string, layer string, data_type string, srs_id long, error string")


def reference_systems(files: DataFrame) -> DataFrame:
    def parse(con: sqlite3.Connection, path: str) -> list[dict]:
        if not _has(con, "gpkg_spatial_ref_sys"):
            return []
        rows = con.execute("SELECT srs_id, organization, organization_coordsys_id, definition FROM gpkg_spatial_ref_sys").fetchall()
        return [{"path": path, "srs_id": r[0], "organization": r[1], "code": r[2], "definition": r[3]} for r in rows]

    return parsed(files, _safe(parse), "path string, srs_id long, organization string, code long, definition string, error string")


def is_valid(files: DataFrame) -> DataFrame:
    """Does each file have the tables that a GeoPackage must have?"""

    def parse(con: sqlite3.Connection, path: str) -> list[dict]:
        return [{"path": path, "valid": all(_has(con, t) for t in CORE)}]

    out = parsed(files, _safe(parse), "path string, valid boolean, error string")
    return out.withColumn("valid", F.coalesce("valid", F.lit(False)))


def read_table(files: DataFrame, table: str, schema: str) -> DataFrame:
    """A table or layer of each file, by the columns of ``schema`` (a missing one is null).

    ``path`` comes first; a column ``geom`` is WKB. Files without the table give no rows.
    """
    fields = StructType.fromDDL(schema).fields

    def parse(con: sqlite3.Connection, path: str) -> list[dict]:
        if not _has(con, table):
            return []
        have = {r[1].lower() for r in con.execute(f'PRAGMA table_info("{table}")')}
        names = [f.name for f in fields if f.name.lower() in have]
        picked = ", ".join(f'"{n}"' for n in names) or "1"
        out = []
        for r in con.execute(f'SELECT {picked} FROM "{table}"'):
            row = {"path": path, **dict(zip(names, tuple(r), strict=False))}
            for f in fields:
                value, kind = row.get(f.name), f.dataType.typeName()
                if value is not None and f.name == "geom":
                    row[f.name] = blob_wkb(value)
                elif value is not None and kind in ("long", "integer", "double", "string"):
                    row[f.name] = _coerced(value, kind)
            out.append(row)
        return out

    return parsed(files, _safe(parse), f"path string, {schema}")


def _coerced(value, kind: str):
    try:
        return {"long": int, "integer": int, "double": float, "string": str}[kind](value)
    except (TypeError, ValueError):
        return None


class Package:
    """A GeoPackage under construction in memory."""

    def __init__(self, content: bytes | None = None, srs_id: int = 3338):
        self.con = open_bytes(content) if content else sqlite3.connect(":memory:")
        self.srs_id = srs_id
        self.con.execute(f"PRAGMA application_id = {APPLICATION_ID}")
        self.con.executescript(
            """
            CREATE TABLE IF NOT EXISTS gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL,
                organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
            CREATE TABLE IF NOT EXISTS gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '',
                last_change TEXT DEFAULT '', min_x REAL, min_y REAL, max_x REAL, max_y REAL, srs_id INTEGER);
            CREATE TABLE IF NOT EXISTS gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL,
                srs_id INTEGER NOT NULL, z INTEGER NOT NULL, m INTEGER NOT NULL);
            """
        )
        for code, org, number in ((-1, "NONE", -1), (0, "NONE", 0), (4326, "EPSG", 4326), (srs_id, "EPSG", srs_id)):
            self.con.execute("INSERT OR IGNORE INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, 'undefined', NULL)", (f"{org}:{number}", code, org, number))

    def write(self, table: str, rows: pd.DataFrame, kinds: dict[str, str], mode: str = "overwrite", key: str | None = None) -> None:
        """Write a table, or a layer where there is a column ``geom`` of WKB; replace it or append."""
        names = list(kinds)
        if mode == "overwrite":
            self.drop(table)
        own = lambda n: "BLOB" if n == "geom" else SQL_TYPES.get(kinds[n], "TEXT")
        columns = ", ".join(f'"{n}" {own(n)}' + " PRIMARY KEY" * (n == key) for n in names)
        self.con.execute(f'CREATE TABLE IF NOT EXISTS "{table}" ({columns})')
        have = {r[1] for r in self.con.execute(f'PRAGMA table_info("{table}")')}
        for n in names:
            if n not in have:
                self.con.execute(f'ALTER TABLE "{table}" ADD COLUMN "{n}" {own(n)}')
        records = []
        for r in rows[names].astype(object).where(rows[names].notna(), None).itertuples(index=False):
            records.append([geometry_blob(v, self.srs_id) if n == "geom" else v for n, v in zip(names, r, strict=True)])
        marks = ", ".join("?" * len(names))
        self.con.executemany(f'INSERT INTO "{table}" ({", ".join(f"{chr(34)}{n}{chr(34)}" for n in names)}) VALUES ({marks})', records)
        kind = "features" if "geom" in names else "attributes"
        self.con.execute("INSERT OR REPLACE INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, ?, ?, ?)", (table, kind, table, self.srs_id))
        if kind == "features":
            self.con.execute("INSERT OR REPLACE INTO gpkg_geometry_columns VALUES (?, 'geom', 'GEOMETRY', ?, 0, 0)", (table, self.srs_id))

    def drop(self, table: str) -> None:
        self.con.execute(f'DROP TABLE IF EXISTS "{table}"')
        self.con.execute("DELETE FROM gpkg_contents WHERE table_name = ?", (table,))
        self.con.execute("DELETE FROM gpkg_geometry_columns WHERE table_name = ?", (table,))

    def update(self, table: str, key: Sequence[str], rows: pd.DataFrame, columns: Sequence[str]) -> None:
        """Set ``columns`` of the rows with the given keys."""
        sets, where = ", ".join(f'"{c}" = ?' for c in columns), " AND ".join(f'"{k}" = ?' for k in key)
        values = [[*[r[c] for c in columns], *[r[k] for k in key]] for r in rows.to_dict("records")]
        self.con.executemany(f'UPDATE "{table}" SET {sets} WHERE {where}', values)

    def metadata(self, xml: str, links: Sequence[tuple[str, str]]) -> None:
        self.con.executescript(
            """
            CREATE TABLE IF NOT EXISTS gpkg_metadata (id INTEGER PRIMARY KEY, md_scope TEXT NOT NULL, md_standard_uri TEXT NOT NULL, mime_type TEXT NOT NULL, metadata TEXT NOT NULL);
            CREATE TABLE IF NOT EXISTS gpkg_metadata_reference (reference_scope TEXT NOT NULL, table_name TEXT, column_name TEXT, row_id_value INTEGER,
                timestamp TEXT, md_file_id INTEGER NOT NULL, md_parent_id INTEGER);
            """
        )
        at = self.con.execute("INSERT INTO gpkg_metadata (md_scope, md_standard_uri, mime_type, metadata) VALUES ('dataset', '', 'text/xml', ?)", (xml,)).lastrowid
        for scope, table in links:
            self.con.execute("INSERT INTO gpkg_metadata_reference (reference_scope, table_name, md_file_id) VALUES (?, ?, ?)", (scope, table, at))

    def repair_crs(self, target: int, mode: str = "fill") -> int:
        """Set the reference system of layers that lack one (``fill``) or have another (``force``); how many changed."""
        lacks = "srs_id IS NULL OR srs_id = 0"
        where = lacks if mode == "fill" else f"{lacks} OR srs_id <> {int(target)}"
        self.con.execute("INSERT OR IGNORE INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, 'undefined', NULL)", (f"EPSG:{target}", target, target))
        changed = self.con.execute(f"UPDATE gpkg_contents SET srs_id = ? WHERE {where}", (target,)).rowcount
        self.con.execute(f"UPDATE gpkg_geometry_columns SET srs_id = ? WHERE {where}", (target,))
        return changed

    def content(self) -> bytes:
        self.con.commit()
        self.con.execute("VACUUM")
        return self.con.serialize()


def packed(layers: dict[str, DataFrame], key: str, name: str = "name", srs_id: int = 3338) -> DataFrame:
    """One package per ``key`` with the given layers: rows ``(name, content)``.

    ``name`` is a column of the first layer. Each layer's rows of a key meet in one task.
    """
    kinds = {t: {c: k for c, k in df.dtypes if c not in (key, name)} for t, df in layers.items()}
    one = None
    for table, df in layers.items():
        columns = [c for c in df.columns if c not in (key, name)]
        plain = [c for c in columns if c != "geom"]
        part = df.select(
            F.col(key).cast("string").alias(key),
            F.lit(table).alias("layer"),
            (F.to_json(F.struct(*plain)) if plain else F.lit("{}")).alias("row"),
            (F.col("geom") if "geom" in columns else F.lit(None).cast("binary")).alias("geom"),
            (F.col(name) if name in df.columns else F.lit(None).cast("string")).alias(name),
        )
        one = part if one is None else one.unionByName(part)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        package = Package(srs_id=srs_id)
        for table, columns in kinds.items():
            mine = pdf[pdf["layer"] == table]
            rows = pd.DataFrame([json.loads(r) for r in mine["row"]], columns=[c for c in columns if c != "geom"], dtype=object)
            if "geom" in columns:
                rows["geom"] = mine["geom"].to_numpy()
            package.write(table, rows, columns)
        names = pdf[name].dropna()
        return pd.DataFrame({"name": [names.iloc[0] if len(names) else f"{pdf[key].iloc[0]}.gpkg"], "content": [package.content()]})

    return one.groupBy(key).applyInPandas(build, "name string, content binary")


def geometry_types(layer: DataFrame, geom: str = "geom") -> DataFrame:
    @F.pandas_udf("int")
    def kind(wkb: pd.Series) -> pd.Series:
        return wkb.map(lambda w: decode(w)[0] if w else None).astype("Int32")

    return layer.withColumn("geometry_type", kind(F.col(geom)))


# --- spark.read.format("gpkg") -----------------------------------------------------------------


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class GpkgReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.options, self.fields = options, schema

    def partitions(self):
        import glob
        import os

        path = self.options["path"].removeprefix("file://")
        found = sorted(glob.glob(os.path.join(path, "**", "*.gpkg"), recursive=True)) if os.path.isdir(path) else sorted(glob.glob(path))
        return [_File(f) for f in found] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.path:
            return
        with open(partition.path, "rb") as f:
            con = open_bytes(f.read())
        table = self.options["table"]
        if _has(con, table):
            have = {r[1].lower() for r in con.execute(f'PRAGMA table_info("{table}")')}
            picked = ", ".join(f'"{x.name}"' if x.name.lower() in have else "NULL" for x in self.fields)
            for r in con.execute(f'SELECT {picked} FROM "{table}"'):
                yield tuple(blob_wkb(v) if x.name == "geom" else v for x, v in zip(self.fields, tuple(r), strict=True))


class GpkgSource(DataSource):
    """``spark.read.format("gpkg").schema(...).option("table", ...).load(folder)`` for folders that all executors mount."""

    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def schema(self) -> str:
        raise ValueError("give the schema of the table: spark.read.format('gpkg').schema(...)")

    def reader(self, schema: StructType) -> GpkgReader:
        return GpkgReader(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GpkgSource)
