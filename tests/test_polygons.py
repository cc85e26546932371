"""Polygons of masks against the masks themselves."""

import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from rillgrid.functions import geometry
from rillgrid.operators import raster, spatial
from rillgrid.operators.graph import _links, _roots
from rillgrid.operators.polygons import mask_polygons, polygonize, ring_area
from rillgrid.plans import ORACLES, QUERIES


def inside(x, y, ring):
    hits = False
    for p, q in zip(ring, ring[1:], strict=False):
        if (p[1] > y) != (q[1] > y) and x < (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) + p[0]:
            hits = not hits
    return hits


def test_polygons_hold_their_pixels():
    rng = random.Random(2)
    for _ in range(120):
        n, share = rng.randint(1, 11), rng.choice([0.3, 0.5, 0.7, 0.9])
        px = sorted((r, c) for r in range(n) for c in range(n) if rng.random() < share) or [(0, 0)]
        r, c = np.array(px).T
        got = mask_polygons(r, c, (1, 0, 0, 0, 1, 0), True, 0)
        regions = _roots(len(r), *_links(r - r.min(), c - c.min()))
        assert [g for g, _ in got] == sorted(set(regions.tolist()))
        for g, polygons in got:
            assert all(len(set(ring[:-1])) == len(ring) - 1 for p in polygons for ring in p)  # no ring touches itself
            assert sum(ring_area(p[0]) - sum(map(ring_area, p[1:])) for p in polygons) == (regions == g).sum()
        for y in range(n):
            for x in range(n):
                hit = [g for g, ps in got if any(inside(x + 0.5, y + 0.5, p[0]) and not any(inside(x + 0.5, y + 0.5, h) for h in p[1:]) for p in ps)]
                assert hit == ([int(regions[px.index((y, x))])] if (y, x) in px else [])


def test_a_block_is_one_polygon(spark):
    rows = [("m", r, c) for r in range(8, 24) for c in range(10, 22)] + [("m", 0, 0)]
    px = spark.createDataFrame(rows, "tile_id string, r long, c long")
    made = polygonize(px, ["tile_id"], transform=(1, 0, 0, 0, -1, 32), min_area=1.0)
    [row] = made.collect()
    assert (row["area"], row["n_parts"], row["n_holes"], row["n_points"]) == (192.0, 1, 0, 5)
    assert geometry.decode(bytes(row["geom"])) == (geometry.MULTI_POLYGON, [[[(10.0, 24.0), (22.0, 24.0), (22.0, 8.0), (10.0, 8.0), (10.0, 24.0)]]])
    assert made.select(geometry.polygon_area(F.col("geom"))).first()[0] == 192.0


def test_simplified_stairs(spark):
    px = spark.createDataFrame([("m", r, c) for r in range(20) for c in range(r + 1)], "tile_id string, r long, c long")
    [plain] = polygonize(px, ["tile_id"]).collect()
    [thin] = polygonize(px, ["tile_id"], tolerance=1.0).collect()
    assert plain["area"] == 210 and thin["n_points"] < plain["n_points"] / 4 and abs(thin["area"] - 210) <= 20


def test_segments_in_polygons_with_holes(spark):
    rng = random.Random(3)
    outer = [(0, 0), (10, 0), (10, 10), (5, 4), (0, 10), (0, 0)]
    hole = [(2, 1), (4, 1), (4, 3), (2, 3), (2, 1)]
    wkb = geometry.encode(geometry.POLYGON, [outer, hole])
    segs = [(k, *[rng.uniform(-2, 12) for _ in range(4)]) for k in range(40)]
    polygons = spark.createDataFrame([(1, bytearray(wkb), 0.0, 0.0, 10.0, 10.0)], "cut_id long, geom binary, minx double, miny double, maxx double, maxy double")
    got = {k: 0.0 for k, *_ in segs}
    for row in spatial.segments_in_polygons(spark.createDataFrame(segs, "edge_id long, x0 double, y0 double, x1 double, y1 double"), polygons, 5.0).collect():
        got[row["edge_id"]] += row["hi"] - row["lo"]
    for k, x0, y0, x1, y1 in segs:
        at = [(x0 + (x1 - x0) * (t + 0.5) / 4000, y0 + (y1 - y0) * (t + 0.5) / 4000) for t in range(4000)]
        share = sum(inside(x, y, outer) and not inside(x, y, hole) for x, y in at) / 4000
        assert abs(got[k] - share * ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5) < 0.05


def test_segments_along_borders():
    wkb = geometry.encode(geometry.POLYGON, [[(0, 0), (4, 4), (8, 0), (8, 8), (0, 8), (0, 0)]])
    along = lambda *s: geometry.segment_parts(*s, wkb, borders=False)
    assert along(1, 1, 3, 3) == along(3, 3, 1, 1) == along(0, 1, 0, 5) == along(8, 8, 2, 8) == []
    assert along(0, 4, 8, 4) == [(0.0, 8.0)]
    [(lo, hi)] = along(2, 2, 6, 6)  # half along the border, half inside
    assert abs(lo - 8**0.5) < 1e-12 and abs(hi - 32**0.5) < 1e-12
    halves = geometry.encode(geometry.MULTI_POLYGON, [[[(0, 0), (2, 0), (2, 4), (0, 4), (0, 0)]], [[(2, 0), (4, 0), (4, 4), (2, 4), (2, 0)]]])
    assert geometry.segment_parts(2, -1, 2, 5, halves, borders=False) == [(1.0, 5.0)]  # between two parts there is no border
    assert geometry.segment_parts(0, -1, 0, 5, halves, borders=False) == []


def test_segments_query_along_diamonds(spark, tmp_path):
    """A segment along the lower right side of one diamond and inside others, as in the tables of 0.1 GB."""
    spark.createDataFrame([(33350, 10)], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    spark.range(250000, 250400).selectExpr("id AS o_orderkey", "timestamp'2020-07-01' AS o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    for name in ("part", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    made = QUERIES["segments_in_polygons"](spark, str(tmp_path))
    want = con.sql(f"SELECT edge_id, cut_id, lo, hi FROM ({ORACLES['segments_in_polygons']}) t").fetchall()
    assert want and sorted(map(tuple, made.select("edge_id", "cut_id", "lo", "hi").collect())) == sorted(want)


def test_overlapping_chips_see_mirrored_frames(spark):
    """Each chip is what a mirrored frame shows there, and scores are averaged where chips overlap."""
    rng = np.random.default_rng(1)
    frame = (rng.random((13, 11)) < 0.4).astype(float)
    rows = [("m", int(r), int(c), 1.0) for r, c in zip(*np.nonzero(frame), strict=True)]
    px = spark.createDataFrame(rows, "tile_id string, r long, c long, v double")
    blur = lambda chips: chips * 0.25 + np.roll(chips, 1, axis=1) * 0.25 + np.roll(chips, -1, axis=2) * 0.5
    got = {(r["r"], r["c"]): (r["mean"], r["n"]) for r in raster.infer_overlapping(px, ["tile_id"], 13, 11, blur, chip=8, overlap=3).collect()}
    wide = np.pad(frame, 8, mode="reflect")
    total, count = np.zeros_like(frame), np.zeros_like(frame)
    for y in range(0, 13, 5):
        for x in range(0, 11, 5):
            p = blur(wide[None, y + 8 : y + 16, x + 8 : x + 16])[0][: 13 - y, : 11 - x]
            total[y : y + 8, x : x + 8] += p
            count[y : y + 8, x : x + 8] += 1
    assert {k: n for k, (_, n) in got.items()} == {k: count[k] for k in got}
    assert set(got) == set(zip(*[x.tolist() for x in np.nonzero(total)], strict=True))
    assert all(abs(m - total[k] / count[k]) < 1e-9 for k, (m, _) in got.items())
