"""Names of tiles, subtiles, files, layers and reference systems."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What file names end in.
PACKAGE = "_TCN.gpkg"
SUMMARY = "_TCN_summary.gpkg"


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def strip_mask(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)[_-]mask$", "")


def expected_package(tif: Column, suffix: str = PACKAGE) -> Column:
    """The package that belongs to a mask file."""
    return F.concat(strip_mask(stem(tif)), F.lit(suffix))


def subtile_id(package: Column) -> Column:
    """A package's file name up to its marker."""
    return F.regexp_replace(stem(package), r"(?i)_tcn(?:_.*)?$", "")


def subtile_digits(path: Column) -> Column:
    """The digits before the mask's ending, else what follows the last ``_``, else the stem."""
    digits = F.regexp_extract(base_name(path), r"(?i)(\d+)_mask\.tiff?$", 1)
    last = F.regexp_extract(strip_mask(stem(path)), r"_([^_]+)$", 1)
    return F.coalesce(F.nullif(digits, F.lit("")), F.nullif(last, F.lit("")), strip_mask(stem(path)))


def tile_from_name(path: Column) -> Column:
    """``row_col`` from the second and third part of a file name, if both are digits."""
    found = F.regexp_extract(base_name(path), r"^[^_]+_(\d+)_(\d+)(?:_|\.|$)", 1)
    other = F.regexp_extract(base_name(path), r"^[^_]+_(\d+)_(\d+)(?:_|\.|$)", 2)
    return F.when(found != "", F.concat_ws("_", found, other))


def cutline_path(root: Column, tif: Column, tile: Column, prefix: str = "Mosaic") -> Column:
    """Where a mask's cutlines lie: by the tile given, else the parent folder, else the name."""
    parent = F.element_at(F.split(tif, "/"), -2)
    chosen = F.coalesce(tile, F.when(parent.rlike(r"^[^_]+_[^_]+$"), parent), tile_from_name(tif))
    return F.concat(root, F.lit("/"), chosen, F.lit(f"/{prefix}_"), chosen, F.lit("_cutlines.shp"))


def norm_key(x: Column) -> Column:
    return F.lower(F.trim(x))


def tile_name_keys(subtile: Column) -> Column:
    """The keys by which a subtile may be listed, best first."""
    name = norm_key(subtile)
    return F.array(F.concat(norm_key(subtile), F.lit(".tif")), F.concat(norm_key(subtile), F.lit(".tiff")), name)


def tile_path(subtile: Column, root: str, tile: Column, *, strip: tuple[str, ...] = (), postfix: str = "", ext: str = ".gpkg") -> Column:
    """``root/tile/name`` of an output, the longest of the endings ``strip`` taken off first."""
    name = stem(subtile)
    for ending in sorted(strip, key=lambda s: (len(s), s)):
        name = F.when(stem(subtile).endswith(ending), F.regexp_replace(stem(subtile), f"{re.escape(ending)}$", "")).otherwise(name)
    return F.concat_ws("/", F.lit(root), tile, F.concat(name, F.lit(postfix + ext)))


def out_path(path: Column, in_root: str, out_root: str) -> Column:
    """The mirrored path below ``out_root``; the bare file name for paths elsewhere."""
    inside = path.startswith(in_root.rstrip("/") + "/")
    rest = F.substring(path, F.lit(len(in_root.rstrip("/")) + 2), F.char_length(path))
    return F.concat(F.lit(out_root.rstrip("/") + "/"), F.when(inside, rest).otherwise(base_name(path)))


def global_component_id(tile: Column, file: Column, component: Column) -> Column:
    return F.concat_ws("|", *[c.cast("string") for c in (tile, file, component)])


def srs_label(organization: Column, code: Column, srs_id: Column) -> Column:
    """``ORG:code``, or ``SRS_ID:n`` for a system that no organization lists."""
    listed = organization.isNotNull() & (F.trim(organization) != "") & (F.upper(organization) != "NONE") & code.isNotNull()
    return F.when(listed, F.concat(F.upper(organization), F.lit(":"), code.cast("string"))).otherwise(
        F.concat(F.lit("SRS_ID:"), srs_id.cast("string"))
    )


def join_list(items: Column, separator: str = ";") -> Column:
    return F.array_join(F.sort_array(items), separator)


def split_list(text: Column) -> Column:
    """Parts between commas, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def truthy(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def json_crs(text: Column, default: str = "EPSG:4326") -> Column:
    """The reference system that a GeoJSON text names."""
    name, code = F.get_json_object(text, "$.crs.properties.name"), F.get_json_object(text, "$.crs.properties.code")
    return F.coalesce(name, F.when(code.rlike(r"^\d+$"), F.concat(F.lit("EPSG:"), code)).otherwise(code), F.lit(default))


def natural_key(x: Column) -> Column:
    """Sorts digits by value: an array of lower-case text and numbers padded to 20 digits."""
    parts = F.regexp_extract_all(F.lower(x), F.lit(r"(\d+|\D+)"), 1)
    return F.transform(parts, lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 20, "0")).otherwise(p))
