"""Files written and read back."""

import math
import sqlite3
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rillgrid.functions import geometry, projections
from rillgrid.sources import files, geojson, geotiff, gpkg, shapefile

POINT = geometry.encode(geometry.POINT, [1.0, 2.0])


def frame(spark, rows):
    return spark.createDataFrame([(n, bytearray(c)) for n, c in rows], "path string, content binary")


def test_package_is_a_geopackage(spark, tmp_path):
    p = gpkg.Package()
    p.write("Nodes", pd.DataFrame({"node_id": [1, 2], "x": [0.5, None], "geom": [POINT, None]}), {"node_id": "bigint", "x": "double", "geom": "binary"}, key="node_id")
    p.write("global_stats", pd.DataFrame({"n": [3]}), {"n": "bigint"})
    p.write("global_stats", pd.DataFrame({"n": [4], "more": ["x"]}), {"n": "bigint", "more": "string"}, mode="append")
    p.update("Nodes", ["node_id"], pd.DataFrame({"node_id": [2, 9], "x": [7.5, 1.0]}), ["x"])
    p.metadata("<a/>", [("geopackage", "global_stats"), ("row", "Nodes")])
    (tmp_path / "a.gpkg").write_bytes(p.content())
    con = sqlite3.connect(tmp_path / "a.gpkg")
    assert con.execute("PRAGMA application_id").fetchone()[0] == 0x47504B47
    assert con.execute("SELECT count(*) FROM gpkg_metadata_reference").fetchone()[0] == 2
    assert con.execute("SELECT n, more FROM global_stats ORDER BY n").fetchall() == [(3, None), (4, "x")]
    found = gpkg.packages(spark, str(tmp_path))
    rows = gpkg.read_table(found, "Nodes", "node_id long, x double, geom binary, absent string").orderBy("node_id").collect()
    assert [(r["node_id"], r["x"], r["absent"]) for r in rows] == [(1, 0.5, None), (2, 7.5, None)]
    assert bytes(rows[0]["geom"]) == POINT and rows[1]["geom"] is None
    gpkg.register(spark)
    direct = spark.read.format("gpkg").schema("node_id long, x double").option("table", "Nodes").load(str(tmp_path))
    assert sorted(map(tuple, direct.collect())) == [(1, 0.5), (2, 7.5)]


def test_layers_fall_back_and_bad_files_are_named(spark):
    plain = sqlite3.connect(":memory:")
    plain.execute("CREATE TABLE t (a)")
    found = gpkg.layers(frame(spark, [("p", plain.serialize()), ("bad", b"nonsense" * 100)])).collect()
    by = {r["path"]: r for r in found}
    assert by["p"]["layer"] == "t" and by["bad"]["error"]


def test_crs_repair():
    p = gpkg.Package(srs_id=3413)
    p.write("a", pd.DataFrame({"geom": [POINT]}), {"geom": "binary"})
    assert p.repair_crs(3338) == 0 and p.repair_crs(3338, "force") == 1
    assert p.con.execute("SELECT srs_id FROM gpkg_geometry_columns").fetchone()[0] == 3338


def test_geotiff_round_trip(spark):
    rng = np.random.default_rng(0)
    for dtype in (np.uint8, np.uint16, np.float32):
        image = rng.integers(0, 200, (70, 33)).astype(dtype)
        t = geotiff.Tiff(geotiff.write(image, (0.5, 0, 100, 0, -0.5, 900), 3338, 0, strip=16))
        assert (t.read()[0] == image).all() and t.epsg == 3338 and t.nodata == 0 and t.dtype == dtype
        assert t.bounds() == (100.0, 865.0, 116.5, 900.0)
    meta = geotiff.metadata(frame(spark, [("bad", b"nope")])).first()
    assert meta["error"]


def test_tiled_big_endian_tiff_with_predictor():
    # 2 bands of 20 x 20 pixels in 16 x 16 tiles, deflated differences, big-endian.
    image = np.random.default_rng(1).integers(0, 255, (2, 20, 20), dtype=np.uint8)
    padded = np.zeros((2, 32, 32), dtype=np.uint8)
    padded[:, :20, :20] = image
    tiles = []
    for y in (0, 16):
        for x in (0, 16):
            block = padded[:, y : y + 16, x : x + 16].transpose(1, 2, 0).astype(np.int16)
            tiles.append(zlib.compress(np.diff(block, axis=1, prepend=0).astype(np.uint8).tobytes()))
    tags = [(256, 20), (257, 20), (259, 8), (277, 2), (317, 2), (322, 16), (323, 16)]
    n = len(tags) + 3
    extra = 8 + 2 + 12 * n + 4
    at = extra + 32
    places = []
    for t in tiles:
        places.append(at)
        at += len(t)
    entries = [(t, struct.pack(">HHIHH", t, 3, 1, v, 0)) for t, v in tags] + [(258, struct.pack(">HHIHH", 258, 3, 2, 8, 8))]
    entries += [(324, struct.pack(">HHII", 324, 4, 4, extra)), (325, struct.pack(">HHII", 325, 4, 4, extra + 16))]
    data = struct.pack(">2sHI", b"MM", 42, 8) + struct.pack(">H", n) + b"".join(e for _, e in sorted(entries)) + struct.pack(">I", 0)
    data += struct.pack(">4I", *places) + struct.pack(">4I", *map(len, tiles)) + b"".join(tiles)
    assert (geotiff.Tiff(data).read((2, 1)) == image[::-1]).all()


def test_block_as_raster_and_region(spark):
    """A block of 16 x 12 pixels is one region of area 192."""
    block = np.zeros((32, 32), dtype=np.uint8)
    block[8:24, 10:22] = 1
    px = geotiff.pixels(frame(spark, [("m", geotiff.write(block, (1, 0, 0, 0, -1, 32), 3338))]))
    from rillgrid.operators.graph import component_counts

    [row] = component_counts(px.select(F.lit(1).alias("tile_id"), "r", "c"), ["tile_id"]).collect()
    assert row["num_nodes"] == 192
    assert px.agg(F.min("c"), F.max("c"), F.min("r"), F.max("r")).first()[:] == (10, 21, 8, 23)


def test_warp_to_another_system_and_resample(spark):
    image = np.ones((40, 40), dtype=np.uint8)
    files_ = frame(spark, [("m", geotiff.write(image, (100, 0, 0, 0, -100, 1_500_000), 3338))])
    n = geotiff.warped(files_, 3413, 100.0).count()
    assert 1400 < n < 2200  # the scale differs a little between the systems
    big = geotiff.resampled(np.arange(12.0).reshape(3, 4), 2)
    assert big.shape == (6, 8) and big[0, 0] == 0 and big[-1, -1] == 11


def test_warped_cells_are_the_nearest_pixels(spark):
    """Cells of every system against centres that columns project back, from files that are read once."""
    rng = np.random.default_rng(5)
    image = rng.integers(0, 4, (300, 350)).astype(np.uint8)
    at = {"a": (100, 0, 5000, 0, -120, 1_500_000), "b": (90, 0, -2_000_000, 0, -90, -900_000), "c": (0.002, 0, -150, 0, -0.001, 65)}
    code = {"a": 3338, "b": 3413, "c": 4326}
    files_ = frame(spark, [*((k, geotiff.write(image, at[k], code[k])) for k in at), ("unknown", geotiff.write(image, at["a"], 32606))])
    made = geotiff.warped(files_, 3413, 130.0)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") == 1
    got = {k: {} for k in at}
    for row in made.collect():
        got[row["path"]][row["r"], row["c"]] = row["v"]
    for k, (a, _, x, _, e, y) in at.items():
        corners = spark.createDataFrame([(float(x + i * 350 * a), float(y + j * 300 * e)) for i in (0, 1) for j in (0, 1)], "x double, y double")
        px, py = projections.reproject(F.col("x"), F.col("y"), code[k], 3413)
        x0, x1, y0, y1 = corners.agg(F.min(px), F.max(px), F.min(py), F.max(py)).first()
        rows, cols = math.ceil((y1 - y0) / 130), math.ceil((x1 - x0) / 130)
        cells = spark.range(rows * cols).selectExpr(f"int(id DIV {cols}) AS r", f"int(id % {cols}) AS c")
        bx, by = projections.reproject(F.lit(x0) + (F.col("c") + 0.5) * 130.0, F.lit(y1) - (F.col("r") + 0.5) * 130.0, 3413, code[k])
        want = {}
        for r, c, u, v in cells.select("r", "c", ((bx - x) / a).alias("u"), ((by - y) / e).alias("v")).collect():
            if min(u % 1, 1 - u % 1, v % 1, 1 - v % 1) < 1e-6:
                got[k].pop((r, c), None)  # on the line between two pixels
            elif 0 <= v < 300 and 0 <= u < 350 and image[int(v), int(u)]:
                want[r, c] = float(image[int(v), int(u)])
        assert want and got[k] == want


def test_geojson_and_shapefiles(spark):
    text = b'{"type": "FeatureCollection", "crs": {"properties": {"code": "3413"}}, "features": [{"geometry": {"type": "Polygon", "coordinates": [[[0,0],[2,0],[2,1],[0,0]]]}}, {"geometry": null}, {"geometry": {"type": "Point", "coordinates": [1,1]}}]}'
    [row] = geojson.read_polygons(frame(spark, [("a.geojson", text)])).collect()
    assert row["crs"] == "EPSG:3413" and geometry.decode(bytes(row["geom"]))[0] == geometry.MULTI_POLYGON
    shp, dbf = shapefile.write([[[(0, 0), (0, 2), (2, 2), (0, 0)]]], [{"TILENAME": "é1", "ACQDATE": "2020-07-01"}])
    [row] = shapefile.read(frame(spark, [("/x/a.shp", shp), ("/x/a.dbf", dbf)])).collect()
    assert row["attributes"] == {"TILENAME": "é1", "ACQDATE": "2020-07-01"}
    assert geometry.decode(bytes(row["geom"])) == (geometry.POLYGON, [[(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (0.0, 0.0)]])


def test_configuration_and_files(spark, tmp_path):
    (tmp_path / "c.toml").write_text("[global]\nworkers = 2\n[steps.filter]\nocean = 0.9\n")
    config = files.load_toml(str(tmp_path / "c.toml"))
    assert files.cfg_step(config, ["mask_filter", "filter"], "ocean") == 0.9
    assert files.cfg_step(config, "filter", "workers") == 2 and files.cfg_step(config, "filter", "workers", fall_back=False) is None
    assert files.cfg_get(config, "a", "b", default=5) == 5
    rows = frame(spark, [("x", b"1")]).select(F.lit("t1/a_mask.TIF").alias("name"), "content")
    files.write_files(rows, str(tmp_path / "out"))
    found = files.rasters(spark, str(tmp_path / "out")).collect()
    assert [r["name"] for r in found] == ["a_mask.TIF"]
    got = files.fetched(str(tmp_path / "w"), "6b86b273ff34fce19d6b804eff5a3f5747ada4eaa22f1d49c01e52ddb7875b4b", lambda p: open(p, "w").write("1"))
    assert got.endswith("w")
    with pytest.raises(ValueError, match="checksum"):
        files.fetched(str(tmp_path / "v"), "00", lambda p: open(p, "w").write("1"))


def lzw(data):
    """LZW codes of TIFF, most significant bit first."""
    table, codes, size, text = {bytes((k,)): k for k in range(256)}, [(256, 9)], 9, b""
    for k in data:
        longer = text + bytes((k,))
        if longer in table:
            text = longer
            continue
        codes.append((table[text], size))
        table[longer] = len(table) + 2
        if len(table) + 2 == (1 << size) and size < 12:
            size += 1
        if len(table) + 2 >= 4094:
            codes.append((256, size))
            table, size = {bytes((k,)): k for k in range(256)}, 9
        text = bytes((k,))
    if text:
        codes.append((table[text], size))
        if len(table) + 3 == (1 << size) and size < 12:
            size += 1
    bits = "".join(f"{c:0{n}b}" for c, n in [*codes, (257, size)])
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def test_other_compressions():
    rng = np.random.default_rng(0)
    for data in (b"", b"a", b"ab" * 4000, bytes(20_000), rng.integers(0, 256, 20_000, dtype=np.uint8).tobytes(), rng.integers(0, 3, 50_000, dtype=np.uint8).tobytes()):
        assert geotiff.unpacked_lzw(lzw(data)) == data
    assert geotiff.unpacked_bits(bytes((2, 7, 8, 9, 254, 5, 128, 0, 1))) == bytes((7, 8, 9, 5, 5, 5, 1))


def test_bands_and_resampling(spark):
    image = np.arange(1, 25, dtype=np.uint8).reshape(4, 6)
    got = geotiff.bands_resampled(frame(spark, [("m", geotiff.write(image, (1, 0, 0, 0, -1, 0), 3338))]), 0.5, bands=(1,)).collect()
    assert {(r["r"], r["c"]): r["v"] for r in got} == {(y, x): image[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].mean() for y in range(2) for x in range(3)}
