"""Small masks whose graphs are known by hand."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillgrid.operators import graph, raster, stats

MASKS = {
    "line5": [(0, c) for c in range(5)],
    "diag4": [(k, k) for k in range(4)],
    "diamond": [(0, 1), (1, 0), (1, 2), (2, 1)],
    "ring8": [(0, 1), (0, 2), (1, 0), (1, 3), (2, 0), (2, 3), (3, 1), (3, 2)],
    "Y": [(0, 0), (0, 4), (1, 1), (1, 3), (2, 2), (3, 2), (4, 2)],
    "T": [(0, c) for c in range(5)] + [(1, 2), (2, 2)],
    "isolate": [(0, 0), (3, 0), (3, 1), (3, 2)],
}
DEGREES = {
    "line5": [1, 2, 2, 2, 1], "diag4": [1, 2, 2, 1], "diamond": [2] * 4, "ring8": [2] * 8, "Y": [1, 1, 2, 2, 3, 2, 1], "T": [1, 3, 3, 3, 1, 4, 1], "isolate": [0, 1, 2, 1],
}
BRANCHES = {
    "line5": [(0, 4, 2.5, 0.0)], "diag4": [(0, 3, 2.0, 45.0)], "diamond": [(0, 0, 2.5, None)], "ring8": [(0, 0, 4.5, None)],
    "Y": [(0, 4, 1.5, 45.0), (1, 4, 1.5, 135.0), (4, 6, 1.5, 90.0)], "isolate": [(1, 3, 1.5, 0.0)],
}


@pytest.fixture(scope="module")
def pixels(spark):
    return spark.createDataFrame([(n, r, c) for n, ps in MASKS.items() for r, c in ps], "tile_id string, r long, c long").repartition(3).cache()


def by_mask(df, *columns):
    out = {}
    for row in df.collect():
        out.setdefault(row["tile_id"], []).append(tuple(row[c] for c in columns))
    return {k: sorted(v, key=str) for k, v in out.items()}


def test_degrees(pixels):
    got = by_mask(graph.degrees(pixels, ["tile_id"]), "node_id", "degree")
    assert {k: [d for _, d in sorted(v)] for k, v in got.items()} == DEGREES


def test_branches(pixels):
    made = graph.measured(graph.branches(pixels, ["tile_id"]), ["tile_id"])
    got = by_mask(made, "node_id_a", "node_id_b", "length_m", "orientation_deg_axial", "is_open_edge")
    for name, want in BRANCHES.items():
        assert len(got[name]) == len(want)
        for (a, b, m, deg, is_open), (wa, wb, wm, wdeg) in zip(sorted(got[name]), want, strict=True):
            assert (a, b, m, is_open) == (wa, wb, wm, 0)
            assert wdeg is None or abs(deg - wdeg) < 1e-6
    assert [x[2] for x in got["T"]] == [1.0] * 8


def test_component_rows(pixels):
    edges = graph.measured(graph.branches(pixels, ["tile_id"]), ["tile_id"])
    made = stats.component_stats(graph.not_isolated(graph.component_counts(pixels, ["tile_id"])), edges, ["tile_id"])
    names = ("total_length_m", "num_edges", "num_nodes", "num_endnodes", "num_junctions", "avg_degree", "mean_branch_len_95_m")
    got = by_mask(made, *names)
    assert got["line5"] == [(2.5, 1, 5, 2, 3, 1.6, 2.5)]
    assert got["diamond"] == [(2.0, 1, 4, 0, 4, 2.0, 2.5)]
    [y] = got["Y"]
    assert y[:5] == (3.5, 3, 7, 3, 4) and abs(y[5] - 12 / 7) < 1e-12 and y[6] == 1.5
    assert len(got["isolate"]) == 1
    keys = by_mask(graph.key_nodes(pixels, ["tile_id"]), "node_id", "degree")
    assert (0, 0) in keys["isolate"] and keys["ring8"] == [(0, 2)]


def test_invariants_of_random_masks(spark):
    rng = random.Random(1)
    rows = [(t, r, c) for t in range(12) for r in range(20) for c in range(20) if rng.random() < 0.05 * (t + 1)]
    px = spark.createDataFrame(rows, "tile_id long, r long, c long")
    edges = graph.pixel_graph(px, ["tile_id"])
    degrees = graph.degrees(px, ["tile_id"])
    assert degrees.agg(F.sum("degree")).first()[0] == 2 * edges.count()
    marked = graph.labelled(px, ["tile_id"]).cache()
    ends = graph.branches(px, ["tile_id"]).select("tile_id", F.explode(F.array("node_id_a", "node_id_b")).alias("node_id"))
    assert ends.join(marked.where("is_key"), ["tile_id", "node_id"], "left_anti").count() == 0
    inner = graph.branches(px, ["tile_id"]).agg(F.sum(F.col("n_pixels") - 2)).first()[0]
    assert inner == marked.where("NOT is_key").count()
    far = {(r["tile_id"], r["node_id"]): r["root"] for r in graph.components_distributed(edges, ["tile_id"]).collect()}
    near = {(r["tile_id"], r["node_id"]): r["root"] for r in marked.where("degree > 0").collect()}
    assert far == near


def test_thinning_keeps_parts_and_is_thin():
    rng = np.random.default_rng(3)
    block = np.zeros((32, 32), dtype=bool)
    block[8:24, 10:22] = True
    for image in (block, rng.random((24, 24)) < 0.6):
        thin = raster.thinned(image)
        assert not (thin & ~image).any()
        r, c = np.nonzero(image)
        parts = len(set(graph._roots(len(r), *graph._links(r, c))))
        r, c = np.nonzero(thin)
        assert len(set(graph._roots(len(r), *graph._links(r, c)))) == parts
        assert (raster.thinned(thin) == thin).all()


def test_nothing(spark):
    empty = spark.createDataFrame([], "tile_id long, r long, c long")
    for made in (graph.degrees, graph.components, graph.branches, graph.component_counts, graph.key_nodes):
        assert made(empty, ["tile_id"]).count() == 0


def test_blocks_give_pixels_back(pixels):
    rows = pixels.withColumn("v", F.lit(1))
    back = raster.from_blocks(raster.to_blocks(rows, ["tile_id"], 4), ["tile_id"])
    assert sorted(map(tuple, back.select("tile_id", "r", "c").collect())) == sorted(map(tuple, pixels.collect()))


def test_masks_larger_than_a_task(spark, pixels, monkeypatch):
    """The paths for whole masks and for cut ones give the same rows."""
    rng = random.Random(5)
    noise = spark.createDataFrame([(f"n{k}", r, c) for k in range(2) for r in range(12) for c in range(12) if rng.random() < 0.25 + 0.2 * k], "tile_id string, r long, c long")
    every = pixels.unionByName(noise)
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    want = [rows(f(every, ["tile_id"])) for f in (graph.labelled, graph.branches)]
    monkeypatch.setattr(graph, "MASK_PIXELS", 7)
    assert [rows(f(every, ["tile_id"])) for f in (graph.labelled, graph.branches)] == want
