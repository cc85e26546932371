"""Views of the test tables that stand for masks, branches, cutlines and manifests.

The texts run unchanged in Spark and in the SQL check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    # Eight masks whose sides grow with the table, about a fifth of their pixels set.
    "px": """
        SELECT DISTINCT l_suppkey % 8 AS tile_id, l_orderkey % w AS r, l_partkey % w AS c
        FROM {lineitem}, (SELECT CAST(ceil(sqrt(count(*) / 1.76e0)) AS BIGINT) AS w FROM {lineitem} WHERE l_quantity >= 30) s WHERE l_quantity >= 30""",
    "px32": "SELECT DISTINCT l_suppkey AS tile_id, l_orderkey % 32 AS r, l_partkey % 32 AS c FROM {lineitem} WHERE l_quantity >= 30",
    "edges": """
        SELECT s_nationkey AS tile_id, l_suppkey AS sub_tile_id, l_partkey AS component_id, l_orderkey, l_linenumber, l_extendedprice / 1000.0 AS length_m,
               CAST((l_orderkey * 7 + l_partkey * 13 + l_linenumber * 31) % 180 AS DOUBLE) AS orientation_deg_axial
        FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey""",
    "comps": """
        SELECT s_nationkey AS tile_id, l_suppkey AS sub_tile_id, l_partkey AS component_id, COUNT(*) AS num_edges, COUNT(*) + 1 AS num_nodes,
               CAST(2.0 * COUNT(*) / (COUNT(*) + 1) AS DOUBLE) AS avg_degree, SUM(l_extendedprice / 1000.0) AS total_length_m,
               SUM(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) AS num_endnodes, SUM(CASE WHEN l_linenumber > 1 THEN 1 ELSE 0 END) AS num_junctions
        FROM {lineitem} JOIN {supplier} ON l_suppkey = s_suppkey GROUP BY s_nationkey, l_suppkey, l_partkey""",
    "cuts": """
        SELECT o_orderkey AS cut_id, CAST((o_orderkey % 20) * 100 AS DOUBLE) AS minx, CAST(floor(o_orderkey / 20) * 100 AS DOUBLE) AS miny,
               CAST((o_orderkey % 20) * 100 + 150 AS DOUBLE) AS maxx, CAST(floor(o_orderkey / 20) * 100 + 150 AS DOUBLE) AS maxy,
               CAST(o_orderdate AS DATE) AS acqdate
        FROM {orders}""",
    "pts": """
        SELECT p_partkey AS node_id, CAST((p_partkey * 37) % 2000 + 0.5 AS DOUBLE) AS x, CAST(p_partkey * 37.5 + 0.5 AS DOUBLE) AS y, p_size FROM {part}""",
    # Along x, along y, and slanted.
    "segs": """
        SELECT p_partkey AS edge_id, x AS x0, y AS y0, CASE WHEN p_partkey % 3 = 1 THEN x ELSE x + 40 + p_size END AS x1,
               CASE WHEN p_partkey % 3 = 0 THEN y WHEN p_partkey % 3 = 1 THEN y + 40 + p_size ELSE y + 30 + 2 * p_size END AS y1, p_partkey % 500 AS group_id
        FROM (SELECT p_partkey, CAST((p_partkey * 37) % 2000 + 0.5 AS DOUBLE) AS x, CAST(p_partkey * 37.5 + 0.5 AS DOUBLE) AS y, p_size FROM {part}) p""",
    "zones": """
        SELECT n_nationkey AS zone_id, (n_nationkey % 4) * 8 AS c0, CAST(floor(n_nationkey / 4) AS BIGINT) * 8 AS r0, (n_nationkey % 4) * 8 + 8 AS c1,
               CAST(floor(n_nationkey / 4) AS BIGINT) * 8 + 8 AS r1
        FROM {nation} WHERE n_nationkey < 16 AND n_nationkey % 3 = 0""",
    "boxes": """
        SELECT s_suppkey AS tile_id, CAST((s_suppkey % 7) * 4 AS DOUBLE) AS minx, CAST((s_suppkey % 5) * 5 AS DOUBLE) AS miny,
               CAST((s_suppkey % 7) * 4 + 2 + s_suppkey % 9 AS DOUBLE) AS maxx, CAST((s_suppkey % 5) * 5 + 3 + s_suppkey % 4 AS DOUBLE) AS maxy
        FROM {supplier}""",
    "expected": """
        SELECT c_nationkey AS tile_id, c_custkey AS sub, concat('Mosaic_', CAST(c_nationkey AS VARCHAR(10)), '_', CAST(c_custkey AS VARCHAR(10)), '_mask.tif') AS name
        FROM {customer}""",
    "done": """
        SELECT DISTINCT concat('Mosaic_', CAST(c_nationkey AS VARCHAR(10)), '_', CAST(c_custkey AS VARCHAR(10)), '_TCN.gpkg') AS name
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE o_orderstatus = 'F'""",
    "layers": """
        SELECT CAST(floor(c_custkey / 4) AS BIGINT) AS tile_id, c_custkey AS layer_id,
               CASE c_custkey % 5 WHEN 0 THEN 'Nodes' WHEN 1 THEN 'Edges' WHEN 2 THEN 'Components' WHEN 3 THEN 'Cutlines' ELSE 'Extra' END AS layer,
               CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 0 WHEN c_custkey % 17 = 0 THEN -1 WHEN c_nationkey % 4 = 0 THEN 3413 ELSE 3338 END AS srs_id,
               c_custkey % 23 <> 0 AS opened
        FROM {customer}""",
    "files": """
        SELECT o_custkey AS tile_id, concat('/data/t', CAST(o_custkey AS VARCHAR(10)), '/f', CAST(o_orderkey AS VARCHAR(10)), '_summary.gpkg') AS path, o_orderdate AS modified
        FROM {orders}""",
    "dates": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM {orders}",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in TABLES if f"{{{t}}}" in text})


def cte(*names: str) -> str:
    """The views as common table expressions of the SQL check."""
    return ",\n".join(f"{n} AS ({VIEWS[n].format(**{t: t for t in TABLES})})" for n in names)
