"""Masks and their pixel graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry
from ..functions.affine import pixel_to_xy, step_orientation
from ..operators import graph, masks, polygons, raster, stats
from .proxies import table, view
from .registry import query

KEY = ["tile_id"]

# SQL that finds the graph by comparing all pixels of a mask, and components by reachability.
NEAR = """
    near AS (SELECT a.tile_id, a.r, a.c, b.r AS nr, b.c AS nc FROM px a JOIN px b ON a.tile_id = b.tile_id
             AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND NOT (a.r = b.r AND a.c = b.c)),
    node AS (SELECT p.tile_id, p.r, p.c, row_number() OVER (PARTITION BY p.tile_id ORDER BY p.r, p.c) - 1 AS node_id,
                    (SELECT count(*) FROM near n WHERE n.tile_id = p.tile_id AND n.r = p.r AND n.c = p.c) AS degree FROM px p)"""
REACH = f"""{NEAR},
    link AS (SELECT a.tile_id, a.node_id AS src, b.node_id AS dst FROM near n JOIN node a ON a.tile_id = n.tile_id AND a.r = n.r AND a.c = n.c
             JOIN node b ON b.tile_id = n.tile_id AND b.r = n.nr AND b.c = n.nc),
    reach AS (SELECT tile_id, node_id, node_id AS root FROM node UNION SELECT l.tile_id, l.dst, r.root FROM reach r JOIN link l ON l.tile_id = r.tile_id AND l.src = r.node_id),
    least AS (SELECT tile_id, node_id, min(root) AS root FROM reach GROUP BY tile_id, node_id),
    part AS (SELECT n.*, l.root, dense_rank() OVER (PARTITION BY n.tile_id ORDER BY l.root) - 1 AS component_id FROM node n JOIN least l USING (tile_id, node_id)),
    marked AS (SELECT *, degree <> 2 OR (min(degree) OVER w = 2 AND max(degree) OVER w = 2 AND node_id = root) AS is_key FROM part WINDOW w AS (PARTITION BY tile_id, root))"""


def px(spark, d):
    return view(spark, d, "px")


@query("flt_threshold", "SELECT l_suppkey AS tile_id, count(*)::BIGINT AS n FROM lineitem WHERE l_quantity - 30 > 0 GROUP BY 1")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("tile_id"), (F.col("l_quantity") - 30).alias("v"))
    return raster.threshold(rows).groupBy("tile_id").agg(F.count("*").alias("n"))


@query("flt_empty_mask", "SELECT l_partkey AS tile_id FROM lineitem GROUP BY 1 HAVING max(l_quantity) >= 40")
def _(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("tile_id"), F.greatest(F.col("l_quantity") - 39, F.lit(0)).alias("v"))
    return raster.non_empty(rows, KEY)


VALID = "CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN 7.0::DOUBLE ELSE 'nan'::DOUBLE END"


@query("flt_valid_nodata", f"SELECT l_linenumber, count(*)::BIGINT AS n FROM (SELECT l_linenumber, l_quantity AS v, {VALID} AS nodata FROM lineitem) t WHERE nodata IS NULL OR (isnan(nodata) AND NOT isnan(v)) OR (NOT isnan(nodata) AND v <> nodata) GROUP BY 1")
def _(spark, d):
    kind = F.col("l_linenumber") % 3
    nodata = F.when(kind == 0, F.lit(None)).when(kind == 1, F.lit(7.0)).otherwise(F.lit(float("nan")))
    rows = table(spark, d, "lineitem").select("l_linenumber", raster.valid(F.col("l_quantity"), nodata).alias("ok"))
    return rows.where("ok").groupBy("l_linenumber").agg(F.count("*").alias("n"))


SHORE = """shore AS (SELECT p.tile_id, p.r, p.c, coalesce(bool_or(z.zone_id IS NOT NULL), false) AS ocean, (p.r + p.c) % 9 <> 0 AS is_valid
           FROM px p LEFT JOIN zones z ON p.r >= z.r0 AND p.r < z.r1 AND p.c >= z.c0 AND p.c < z.c1 GROUP BY p.tile_id, p.r, p.c)"""


def shore(spark, d):
    return raster.in_boxes(px(spark, d), view(spark, d, "zones")).withColumn("is_valid", (F.col("r") + F.col("c")) % 9 != 0)


@query("flt_land", f"WITH {SHORE} SELECT tile_id, count(*) FILTER (is_valid AND NOT ocean)::BIGINT AS land, count(*) FILTER (is_valid AND ocean)::BIGINT AS sea FROM shore GROUP BY 1", "px zones")
def _(spark, d):
    return masks.pixel_shares(shore(spark, d), "tile_id").select("tile_id", F.col("n_land").alias("land"), F.col("n_ocean").alias("sea"))


@query("agg_raster_fraction", f"WITH {SHORE} SELECT tile_id, count(*) FILTER (is_valid)::BIGINT AS n_valid, round(count(*) FILTER (is_valid AND ocean) / greatest(count(*) FILTER (is_valid), 1)::DOUBLE, 6) AS fraction FROM shore GROUP BY 1", "px zones")
def _(spark, d):
    return masks.pixel_shares(shore(spark, d), "tile_id").select("tile_id", "n_valid", F.round("raster_fraction", 6).alias("fraction"))


CLEAN = f"WITH {SHORE} SELECT tile_id, r, c, CASE WHEN NOT is_valid THEN 255 WHEN NOT ocean THEN 1 ELSE 0 END::INTEGER AS v FROM shore"


def cleaned(spark, d):
    return shore(spark, d).select("tile_id", "r", "c", raster.clean(F.lit(1), F.col("is_valid"), F.col("ocean"), F.lit(255)).alias("v"))


query("mask_clean", CLEAN, "px zones")(cleaned)
query("snk_clean_mask", CLEAN, "px zones")(cleaned)


@query("jn_rasterize", """WITH cell AS (SELECT b.tile_id, y.r, x.c FROM boxes b, range(0, 40) y(r), range(0, 40) x(c)
       WHERE x.c < b.maxx AND x.c + 1 > b.minx AND y.r < b.maxy AND y.r + 1 > b.miny) SELECT tile_id, r::BIGINT AS r, c::BIGINT AS c FROM cell""", "boxes")
def _(spark, d):
    return raster.rasterize(view(spark, d, "boxes"), KEY)


@query("win_node_rank", "SELECT tile_id, r, c, row_number() OVER (PARTITION BY tile_id ORDER BY r, c) - 1 AS node_id FROM px", "px")
def _(spark, d):
    return graph.nodes(px(spark, d), KEY)


@query("jn_pixel_neighbors", f"WITH {NEAR} SELECT tile_id, count(*)::BIGINT AS n FROM near WHERE (r, c) < (nr, nc) GROUP BY 1", "px")
def _(spark, d):
    return graph.neighbours(px(spark, d), KEY).groupBy("tile_id").agg(F.count("*").alias("n"))


EDGE = f"WITH {NEAR} SELECT n.tile_id, a.node_id AS src, b.node_id AS dst FROM near n JOIN node a ON a.tile_id = n.tile_id AND a.r = n.r AND a.c = n.c JOIN node b ON b.tile_id = n.tile_id AND b.r = n.nr AND b.c = n.nc WHERE a.node_id < b.node_id"


@query("pixel_graph", EDGE, "px")
def _(spark, d):
    return graph.pixel_graph(px(spark, d), KEY)


@query("flt_self_loop", EDGE, "px")
def _(spark, d):
    both = graph.both_ways(graph.pixel_graph(px(spark, d), KEY), KEY)
    return both.where("src < dst")


@query("agg_degree", f"WITH {NEAR} SELECT tile_id, r, c, degree::BIGINT AS degree FROM node", "px")
def _(spark, d):
    return graph.degrees(px(spark, d), KEY).select("tile_id", "r", "c", "degree")


@query("components", f"WITH RECURSIVE {REACH} SELECT tile_id, node_id, component_id::BIGINT AS component_id FROM part", "px")
def _(spark, d):
    return graph.components(px(spark, d), KEY).select("tile_id", "node_id", "component_id")


@query("components_distributed", f"WITH RECURSIVE {REACH} SELECT tile_id, node_id, root FROM part WHERE degree > 0", "px")
def _(spark, d):
    return graph.components_distributed(graph.pixel_graph(px(spark, d), KEY), KEY)


@query("jn_node_component", f"WITH RECURSIVE {REACH} SELECT tile_id, r, c, component_id::BIGINT AS component_id, concat_ws('|', tile_id, 'f', component_id) AS global_component_id FROM part", "px")
def _(spark, d):
    from ..functions.names import global_component_id

    n = graph.nodes(px(spark, d), KEY)
    return n.join(graph.components(px(spark, d), KEY).select("tile_id", "node_id", "component_id"), ["tile_id", "node_id"]).select(
        "tile_id", "r", "c", "component_id", global_component_id(F.col("tile_id"), F.lit("f"), F.col("component_id")).alias("global_component_id")
    )


KEYS = f"WITH RECURSIVE {REACH} SELECT tile_id, r, c, node_id, component_id::BIGINT AS component_id, degree::BIGINT AS degree, (degree = 1)::INTEGER AS is_endpoint, (degree >= 2)::INTEGER AS is_junction, row_number() OVER (PARTITION BY tile_id ORDER BY r, c) - 1 AS key_id FROM marked WHERE is_key"
for _name in ("key_nodes", "flt_key_nodes", "win_key_rank"):
    query(_name, KEYS, "px")(lambda spark, d: graph.key_nodes(px(spark, d), KEY))


@query("win_min_seed", f"WITH RECURSIVE {REACH} SELECT tile_id, node_id AS seed FROM marked WHERE is_key AND degree = 2", "px")
def _(spark, d):
    return graph.labelled(px(spark, d), KEY).where("is_key AND degree = 2").select("tile_id", F.col("node_id").alias("seed"))


# Branches walked pixel by pixel from every key node, with the sums of the doubled directions of their steps; of the two ways the first stays.
WALK = f"""{REACH},
    step AS (SELECT l.tile_id, l.src, l.dst, a.is_key AS src_key, b.is_key AS dst_key, a.component_id,
                    ((b.c - a.c) * (b.c - a.c) - (b.r - a.r) * (b.r - a.r))::DOUBLE / ((b.c - a.c) * (b.c - a.c) + (b.r - a.r) * (b.r - a.r)) AS cx,
                    (2 * (b.r - a.r) * (b.c - a.c))::DOUBLE / ((b.c - a.c) * (b.c - a.c) + (b.r - a.r) * (b.r - a.r)) AS sx
             FROM link l JOIN marked a ON a.tile_id = l.tile_id AND a.node_id = l.src JOIN marked b ON b.tile_id = l.tile_id AND b.node_id = l.dst),
    walk AS (SELECT tile_id, component_id, src AS a, dst AS first, src AS prev, dst AS cur, dst_key AS done, 2 AS n, cx, sx FROM step WHERE src_key
             UNION ALL SELECT w.tile_id, w.component_id, w.a, w.first, w.cur, s.dst, s.dst_key, w.n + 1, w.cx + s.cx, w.sx + s.sx
             FROM walk w JOIN step s ON s.tile_id = w.tile_id AND s.src = w.cur AND s.dst <> w.prev WHERE NOT w.done),
    branch AS (SELECT tile_id, row_number() OVER (PARTITION BY tile_id ORDER BY a, first) - 1 AS edge_id, a AS node_id_a, cur AS node_id_b, component_id::BIGINT AS component_id, n::BIGINT AS n_pixels,
                      CASE WHEN sx * sx + cx * cx < 1e-12 THEN -1.0 ELSE ((degrees(atan2(sx, cx)) / 2) % 180 + 180) % 180 END AS axial
               FROM walk WHERE done AND (a, first) < (cur, prev))"""


def branches(spark, d):
    return graph.branches(px(spark, d), KEY)


query("trace_branches", f"WITH RECURSIVE {WALK} SELECT tile_id, edge_id, node_id_a, node_id_b, component_id, n_pixels, 0::INTEGER AS is_open_edge FROM branch", "px")(lambda spark, d: branches(spark, d).drop("points"))


@query("win_bfs_chain", f"WITH RECURSIVE {WALK} SELECT tile_id, edge_id, n_pixels AS n_steps, node_id_a, node_id_b FROM branch", "px")
def _(spark, d):
    """The points of each branch, looked up by their places."""
    n = graph.nodes(px(spark, d), KEY)
    steps = branches(spark, d).select("tile_id", "edge_id", F.posexplode("points").alias("step", "p")).select("tile_id", "edge_id", "step", "p.r", "p.c").join(n, ["tile_id", "r", "c"])
    ends = [F.min_by("node_id", "step").alias("node_id_a"), F.max_by("node_id", "step").alias("node_id_b")]
    return steps.groupBy("tile_id", "edge_id").agg((F.max("step") + 1).cast("long").alias("n_steps"), *ends)


query("win_edge_rank", f"WITH RECURSIVE {WALK} SELECT tile_id, edge_id, node_id_a FROM branch", "px")(lambda spark, d: branches(spark, d).select("tile_id", "edge_id", "node_id_a"))
query("jn_edge_component", f"WITH RECURSIVE {WALK} SELECT tile_id, edge_id, component_id FROM branch", "px")(lambda spark, d: branches(spark, d).select("tile_id", "edge_id", "component_id"))


COUNTS = "count(*)::BIGINT AS num_nodes, count(*) FILTER (degree = 1)::BIGINT AS num_endnodes, count(*) FILTER (degree >= 2)::BIGINT AS num_junctions, round(sum(degree) / count(*)::DOUBLE, 6) AS avg_degree, count(*) * 0.5::DOUBLE AS total_length_m"


def counted(spark, d):
    return graph.component_counts(px(spark, d), KEY).withColumn("avg_degree", F.round("avg_degree", 6))


def _subset(name, *columns):
    picked = ", ".join(columns)
    query(name, f"WITH RECURSIVE {REACH}, counts AS (SELECT tile_id, component_id::BIGINT AS component_id, {COUNTS} FROM part GROUP BY 1, 2) SELECT tile_id, component_id, {picked} FROM counts", "px")(
        lambda spark, d: counted(spark, d).select("tile_id", "component_id", *columns)
    )


_subset("agg_comp_nodes", "num_nodes")
_subset("agg_comp_ends", "num_endnodes")
_subset("agg_comp_junctions", "num_junctions")
_subset("agg_comp_degree", "avg_degree")
_subset("agg_comp_length", "total_length_m")


@query("flt_isolates", f"WITH RECURSIVE {REACH}, counts AS (SELECT tile_id, component_id::BIGINT AS component_id, {COUNTS} FROM part GROUP BY 1, 2) SELECT * FROM counts WHERE num_nodes > 1", "px")
def _(spark, d):
    return graph.not_isolated(counted(spark, d))


STATS = f"""{WALK}, counts AS (SELECT tile_id, component_id::BIGINT AS component_id, {COUNTS} FROM part GROUP BY 1, 2),
    lines AS (SELECT tile_id, component_id, count(*)::BIGINT AS num_edges, quantile_cont(n_pixels * 0.5, 0.95) AS p95 FROM branch GROUP BY 1, 2),
    trimmed AS (SELECT tile_id, component_id, avg(n_pixels * 0.5) AS m FROM branch JOIN lines USING (tile_id, component_id) WHERE n_pixels * 0.5 <= p95 GROUP BY 1, 2),
    comp AS (SELECT c.*, coalesce(num_edges, 0) AS num_edges, round(coalesce(m, 0.0), 6) AS mean_branch_len_95_m
             FROM counts c LEFT JOIN lines USING (tile_id, component_id) LEFT JOIN trimmed USING (tile_id, component_id) WHERE num_nodes > 1)"""


@query("component_stats", f"WITH RECURSIVE {STATS} SELECT * FROM comp", "px")
def _(spark, d):
    edges = branches(spark, d).withColumn("length_m", F.col("n_pixels") * 0.5)
    made = stats.component_stats(graph.not_isolated(counted(spark, d)), edges, KEY)
    return made.withColumn("mean_branch_len_95_m", F.round("mean_branch_len_95_m", 6))


@query("subtile_process", f"WITH RECURSIVE {STATS} SELECT b.tile_id, edge_id, node_id_a, node_id_b, component_id, n_pixels, 0::INTEGER AS is_open_edge, n_pixels * 0.5::DOUBLE AS length_m, (round(axial * 1000) % 180000)::BIGINT AS millidegrees, c.* EXCLUDE (tile_id, component_id) FROM branch b JOIN comp c USING (tile_id, component_id)", "px")
def _(spark, d):
    """All of a mask's layers in one: branches with lengths and directions, and their components' rows."""
    edges = graph.measured(branches(spark, d), KEY)
    comps = stats.component_stats(graph.not_isolated(counted(spark, d)), edges, KEY)
    comps = comps.withColumn("mean_branch_len_95_m", F.round("mean_branch_len_95_m", 6))
    angle = F.when(F.col("orientation_deg_axial") < 0, F.lit(-1000)).otherwise(F.round(F.col("orientation_deg_axial") * 1000) % 180000)
    return edges.withColumn("millidegrees", angle.cast("long")).drop("points", "orientation_deg_axial").join(comps, ["tile_id", "component_id"])


@query("agg_comp_lines", f"WITH RECURSIVE {REACH} SELECT tile_id, component_id::BIGINT AS component_id, (sum(degree) FILTER (is_key) // 2)::BIGINT AS n_lines, (count(*) FILTER (NOT is_key) + 2 * (sum(degree) FILTER (is_key) // 2))::BIGINT AS n_points FROM marked GROUP BY 1, 2 HAVING sum(degree) FILTER (is_key) > 0", "px")
def _(spark, d):
    lines = stats.component_lines(graph.branches(px(spark, d), KEY), KEY)
    points = F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + F.size(x))
    return lines.select("tile_id", "component_id", F.size("lines").cast("long").alias("n_lines"), points.alias("n_points"))


# Pixels that share a side make a part; Euler's formula over a part's corners, sides and pixels counts its holes.
PARTS4 = f"""{REACH},
    link4 AS (SELECT a.tile_id, a.node_id AS src, b.node_id AS dst FROM node a JOIN node b ON a.tile_id = b.tile_id AND abs(a.r - b.r) + abs(a.c - b.c) = 1),
    reach4 AS (SELECT tile_id, node_id, node_id AS root FROM node UNION SELECT l.tile_id, l.dst, x.root FROM reach4 x JOIN link4 l ON l.tile_id = x.tile_id AND l.src = x.node_id),
    piece AS (SELECT p.*, (SELECT min(x.root) FROM reach4 x WHERE x.tile_id = p.tile_id AND x.node_id = p.node_id) AS root4 FROM part p),
    corner AS (SELECT tile_id, component_id, root4, count(DISTINCT (r + dr, c + dc)) AS n FROM piece, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(dr, dc) GROUP BY 1, 2, 3),
    side AS (SELECT tile_id, component_id, root4, count(DISTINCT (k, r + dr, c + dc)) AS n FROM piece, (VALUES ('h', 0, 0), ('h', 1, 0), ('v', 0, 0), ('v', 0, 1)) v(k, dr, dc) GROUP BY 1, 2, 3),
    face AS (SELECT tile_id, component_id, root4, count(*) AS n FROM piece GROUP BY 1, 2, 3),
    region AS (SELECT tile_id, component_id::BIGINT AS component_id, 1::INTEGER AS mask_value, count(*)::BIGINT AS n_parts, sum(1 - (corner.n - side.n + face.n))::BIGINT AS n_holes, sum(face.n) * 0.25::DOUBLE AS area
               FROM corner JOIN side USING (tile_id, component_id, root4) JOIN face USING (tile_id, component_id, root4) GROUP BY 1, 2)"""
HALF_METRE = (0.5, 0, 100, 0, -0.5, 900)


@query("raster_polygonize", f"WITH RECURSIVE {PARTS4} SELECT * FROM region", "px")
def _(spark, d):
    return polygons.polygonize(px(spark, d), KEY, transform=HALF_METRE).drop("geom", "n_points")


@query("flt_poly_min_area", f"WITH RECURSIVE {PARTS4} SELECT tile_id, component_id, area, 6 AS kind FROM region WHERE area > 1", "px")
def _(spark, d):
    made = polygons.polygonize(px(spark, d), KEY, transform=HALF_METRE, min_area=1)
    return made.select("tile_id", "component_id", "area", geometry.wkb_type(F.col("geom")).cast("int").alias("kind"))


@query("skeletonize")
def _(spark, d):
    wide = px(spark, d).select("tile_id", F.explode(F.array(*[F.struct((F.col("r") * 2 + a).alias("r"), (F.col("c") * 2 + b).alias("c")) for a in (0, 1) for b in (0, 1)])).alias("p"))
    return raster.skeletonize(wide.select("tile_id", "p.r", "p.c").distinct(), KEY)


@query("snk_raster_table", "SELECT tile_id, r, c, 1 AS v FROM px", "px")
def _(spark, d):
    return raster.from_blocks(raster.to_blocks(px(spark, d).withColumn("v", F.lit(1)), KEY, 128), KEY)


OVER = "SELECT tile_id, floor(r / {k})::BIGINT AS r, floor(c / {k})::BIGINT AS c, arg_min(v, r * 100000 + c)::BIGINT AS v FROM (SELECT *, r * 32 + c AS v FROM px) p GROUP BY 1, 2, 3"


@query("agg_overview", OVER.format(k=4), "px")
def _(spark, d):
    return raster.overview(px(spark, d).withColumn("v", F.col("r") * 32 + F.col("c")), KEY, 4)


@query("snk_overviews", " UNION ALL ".join(f"SELECT tile_id, {k} AS level, r, c, v FROM ({OVER.format(k=k)}) t{k}" for k in (2, 4, 8, 16)), "px")
def _(spark, d):
    return raster.overviews(px(spark, d).withColumn("v", F.col("r") * 32 + F.col("c")), KEY).select("tile_id", "level", "r", "c", "v")


@query("agg_null_mask", "SELECT l_orderkey, bool_and(l_quantity < 10) AS is_null FROM lineitem GROUP BY 1")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", F.floor(F.col("l_quantity") / 10).alias("v"))
    return raster.null_mask(rows, ["l_orderkey"])


@query("fn_reflect_pad", """SELECT tile_id, y.pr::BIGINT AS r, x.pc::BIGINT AS c FROM px32
       JOIN (SELECT i AS pr, CASE WHEN i < 5 THEN 5 - i WHEN i >= 37 THEN 67 - i ELSE i - 5 END AS r FROM range(0, 42) t(i)) y USING (r)
       JOIN (SELECT i AS pc, CASE WHEN i < 5 THEN 5 - i WHEN i >= 37 THEN 67 - i ELSE i - 5 END AS c FROM range(0, 42) t(i)) x USING (c)""", "px32")
def _(spark, d):
    return raster.reflect_pad(view(spark, d, "px32"), KEY, 32, 32, 5)


@query("fn_chip_grid", "SELECT s_suppkey AS tile_id, y.y::INTEGER AS y, x.x::INTEGER AS x FROM supplier, range(0, 3000, 896) y(y), range(0, 3000, 896) x(x) WHERE y.y < 1000 + s_suppkey * 10 % 2000 AND x.x < 2000")
def _(spark, d):
    frames = table(spark, d, "supplier").select(F.col("s_suppkey").alias("tile_id"), (1000 + F.col("s_suppkey") * 10 % 2000).cast("int").alias("height"), F.lit(2000).alias("width"))
    return raster.chip_grid(frames, KEY).select("tile_id", "y", "x")


CHIPS = "SELECT l_suppkey AS tile_id, l_orderkey % 16 AS r, l_partkey % 16 AS c, l_discount AS p FROM lineitem"
AVERAGE = f"SELECT tile_id, r, c, round(coalesce(sum(p) / greatest(count(p), 1), 0), 6) AS mean, count(p)::BIGINT AS n, (round(coalesce(sum(p) / greatest(count(p), 1), 0), 9) > 0.05)::INTEGER AS v FROM ({CHIPS}) t GROUP BY 1, 2, 3"


def chips(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("tile_id"), (F.col("l_orderkey") % 16).alias("r"), (F.col("l_partkey") % 16).alias("c"), F.col("l_discount").alias("p"))


def averaged(rows):
    made = raster.chip_average(rows, KEY, cut=0.05)
    return made.withColumns({"v": (F.round("mean", 9) > 0.05).cast("int"), "mean": F.round("mean", 6)})


query("agg_chip_avg", AVERAGE)(lambda spark, d: averaged(chips(spark, d)))
query("snk_mask_windows", AVERAGE)(lambda spark, d: averaged(chips(spark, d)))


# Each pixel in each chip of side 24, every 16 pixels, that holds it; mirrored pixels beyond the frame are cut off again.
INFER = """size AS (SELECT max(r) + 1 AS h, max(c) + 1 AS w FROM px),
    seen AS (SELECT tile_id, r, c, y, x FROM px, size, range(0, 100000, 16) a(y), range(0, 100000, 16) b(x) WHERE y <= r AND r < y + 24 AND x <= c AND c < x + 24 AND y < h AND x < w)
    SELECT tile_id, r, c, round(avg((c - x + 1) / 24.0), 6) AS mean, count(*)::BIGINT AS n, (round(avg((c - x + 1) / 24.0), 9) > 0.4)::INTEGER AS v FROM seen GROUP BY 1, 2, 3"""


@query("infer_chips", f"WITH {INFER}", "px")
def _(spark, d):
    """A scorer that weighs a pixel by its column in the chip, so chips disagree where they overlap."""
    rows = px(spark, d)
    h, w = rows.agg(F.max("r") + 1, F.max("c") + 1).first()

    def scorer(chips):
        import numpy as np

        return chips * (np.arange(chips.shape[2]) + 1) / chips.shape[2]

    made = raster.infer_overlapping(rows.withColumn("v", F.lit(1.0)), KEY, h or 1, w or 1, scorer, chip=24, overlap=8, cut=0.4)
    return made.withColumns({"v": (F.round("mean", 9) > 0.4).cast("int"), "mean": F.round("mean", 6)})


DECIDE = f"""{SHORE},
    shares AS (SELECT tile_id, count(*) FILTER (is_valid AND ocean) AS ocean, count(*) FILTER (is_valid AND NOT ocean) AS land FROM shore GROUP BY 1),
    frac AS (SELECT b.tile_id, sum(greatest(least(b.maxx, z.c1) - greatest(b.minx, z.c0), 0) * greatest(least(b.maxy, z.r1) - greatest(b.miny, z.r0), 0)) / any_value((b.maxx - b.minx) * (b.maxy - b.miny)) AS f FROM boxes b, zones z GROUP BY 1),
    made AS (SELECT f.tile_id, round(f, 6) AS fraction, CASE WHEN f.tile_id % 10 = 3 THEN 'ERROR: no CRS' WHEN f >= 0.99 THEN 'DROP' WHEN f < 0.01 THEN 'KEEP' WHEN coalesce(ocean, 0) > 0 AND coalesce(land, 0) > 0 THEN 'BOUNDARY_REWRITE' ELSE 'KEEP' END AS decision
             FROM frac f LEFT JOIN shares s ON s.tile_id = f.tile_id % 8)"""


@query("ocean_decide", f"WITH {DECIDE} SELECT * FROM made", "px zones boxes")
def decided(spark, d):
    """Tiles by their box's share of ocean and the pixels of the mask they lie on."""
    from ..operators.spatial import covered_fraction

    zones = view(spark, d, "zones").select(F.col("c0").cast("double").alias("minx"), F.col("r0").cast("double").alias("miny"), F.col("c1").cast("double").alias("maxx"), F.col("r1").cast("double").alias("maxy"))
    shares = masks.pixel_shares(shore(spark, d), "tile_id").withColumnRenamed("tile_id", "mask")
    rows = covered_fraction(view(spark, d, "boxes"), zones, "tile_id", 8.0).withColumn("mask", F.col("tile_id") % 8).join(shares, "mask", "left")
    made = masks.decision(F.col("fraction"), F.col("n_ocean"), F.col("n_land"), F.col("tile_id") % 10 != 3)
    return rows.select("tile_id", F.round("fraction", 6).alias("fraction"), made.alias("decision"))


@query("agg_decisions", f"WITH {DECIDE} SELECT split_part(decision, ':', 1) AS decision, count(*)::BIGINT AS n FROM made GROUP BY 1", "px zones boxes")
def _(spark, d):
    return masks.decision_counts(decided(spark, d))


@query("fn_pix_to_xy", "SELECT tile_id, r, c, 100.0::DOUBLE + (c + 0.5) * 0.5 AS x, 900.0::DOUBLE + (r + 0.5) * -0.5 AS y FROM px", "px")
def _(spark, d):
    x, y = pixel_to_xy((0.5, 0, 100, 0, -0.5, 900), F.col("r"), F.col("c"))
    return px(spark, d).select("tile_id", "r", "c", x.alias("x"), y.alias("y"))


@query("fn_seg_orient", f"WITH {NEAR}, a AS (SELECT degrees(atan2((nr - r)::DOUBLE, (nc - c)::DOUBLE)) AS t FROM near) SELECT round(((t % 180) + 180) % 180, 6) AS angle, count(*)::BIGINT AS n FROM a GROUP BY 1", "px")
def _(spark, d):
    pairs = graph.neighbours(px(spark, d), KEY)
    both = pairs.select((F.col("nr") - F.col("r")).alias("dr"), (F.col("nc") - F.col("c")).alias("dc")).union(pairs.select(F.col("r") - F.col("nr"), F.col("c") - F.col("nc")))
    return both.groupBy(F.round(step_orientation(F.col("dr"), F.col("dc")), 6).alias("angle")).agg(F.count("*").alias("n"))
