"""Statistics of branches and components, from subtile to mosaic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.axial import axial_mean, doubled
from ..functions.numbers import as_float, as_int, clamp01, fmt6, round16, round_half_even, sigmoid, step_length
from ..operators import stats
from .proxies import table, view
from .registry import query

SUB = ["tile_id", "sub_tile_id"]
COMP = [*SUB, "component_id"]


def edges(spark, d):
    return view(spark, d, "edges")


def comps(spark, d):
    return view(spark, d, "comps")


def p95_sql(keys: str, digits: int = 4, name: str = "mean_branch_len_95_m") -> str:
    on = f"USING ({keys})" if keys else ", p"
    join = f"JOIN p {on}" if keys else "CROSS JOIN p"
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"WITH p AS (SELECT {lead}quantile_cont(length_m, 0.95) AS p95 FROM edges {group}) SELECT {lead}round(avg(length_m), {digits}) AS {name} FROM edges {join} WHERE length_m <= p95 {group}"


def p95(keys, digits=4):
    return lambda spark, d: stats.p95_mean(edges(spark, d), keys).withColumn("mean_branch_len_95_m", F.round("mean_branch_len_95_m", digits))


query("agg_p95_mean", p95_sql("tile_id, sub_tile_id, component_id", 8), "edges")(p95(COMP, 8))
query("agg_p95_mean_subtile", p95_sql("tile_id, sub_tile_id"), "edges")(p95(SUB))
query("agg_p95_mean_tile", p95_sql("tile_id"), "edges")(p95(["tile_id"]))


P95_ROWS = "WITH p AS (SELECT tile_id, sub_tile_id, quantile_cont(length_m, 0.95) AS p95 FROM edges GROUP BY 1, 2) SELECT tile_id, sub_tile_id, count(*)::BIGINT AS n, round(max(length_m), 6) AS longest FROM edges JOIN p USING (tile_id, sub_tile_id) WHERE length_m <= p95 GROUP BY 1, 2"


def p95_rows(spark, d):
    return stats.p95_flagged(edges(spark, d), SUB).groupBy(*SUB).agg(F.count("*").alias("n"), F.round(F.max("length_m"), 6).alias("longest"))


query("flt_p95", P95_ROWS, "edges")(p95_rows)
query("jn_edge_p95", P95_ROWS, "edges")(p95_rows)


@query("jn_comp_mean_default", "WITH e AS (SELECT * FROM edges WHERE l_linenumber > 2), p AS (SELECT tile_id, sub_tile_id, component_id, quantile_cont(length_m, 0.95) AS p95 FROM e GROUP BY 1, 2, 3), m AS (SELECT tile_id, sub_tile_id, component_id, avg(length_m) AS m FROM e JOIN p USING (tile_id, sub_tile_id, component_id) WHERE length_m <= p95 GROUP BY 1, 2, 3) SELECT tile_id, sub_tile_id, component_id, round(coalesce(m, 0), 8) AS mean_branch_len_95_m FROM comps LEFT JOIN m USING (tile_id, sub_tile_id, component_id)", "edges comps")
def _(spark, d):
    mean = stats.p95_mean(edges(spark, d).where("l_linenumber > 2"), COMP)
    out = comps(spark, d).join(mean, COMP, "left")
    return out.select(*COMP, F.round(F.coalesce("mean_branch_len_95_m", F.lit(0.0)), 8).alias("mean_branch_len_95_m"))


TOTALS = """sum(num_nodes)::BIGINT AS num_graph_nodes, round_even(sum(avg_degree * num_nodes) / 2, 0)::BIGINT AS num_graph_edges, sum(num_endnodes)::BIGINT AS num_endnodes,
    sum(num_junctions)::BIGINT AS num_junctions, sum(num_edges)::BIGINT AS num_edges, count(*)::BIGINT AS num_components, round(sum(total_length_m), 6) AS total_length_m,
    round(avg(total_length_m), 6) AS mean_component_length_m, round(max(total_length_m), 6) AS max_component_length_m,
    round(2 * round_even(sum(avg_degree * num_nodes) / 2, 0)::BIGINT / sum(num_nodes)::DOUBLE, 6) AS avg_degree"""
REAL = ("total_length_m", "mean_component_length_m", "max_component_length_m", "avg_degree")


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 4 if n == "mean_branch_len_95_m" else 6) for n in names})


def totals(keys):
    return lambda spark, d: rounded(stats.totals(comps(spark, d), keys), *REAL)


query("agg_sub_totals", f"SELECT tile_id, sub_tile_id, {TOTALS} FROM comps GROUP BY 1, 2", "comps")(totals(SUB))
query("agg_tile_totals", f"SELECT tile_id, {TOTALS} FROM comps GROUP BY 1", "comps")(totals(["tile_id"]))
query("set_union_layers", f"WITH u AS (SELECT * FROM comps WHERE sub_tile_id % 2 = 0 UNION ALL SELECT * FROM comps WHERE sub_tile_id % 2 = 1) SELECT tile_id, {TOTALS} FROM u GROUP BY 1", "comps")(
    lambda spark, d: rounded(stats.totals(comps(spark, d).where("sub_tile_id % 2 = 0").unionByName(comps(spark, d).where("sub_tile_id % 2 = 1")), ["tile_id"]), *REAL)
)


@query("rollup_levels", "SELECT tile_id, sub_tile_id, grouping_id(tile_id, sub_tile_id)::INTEGER AS level, sum(num_nodes)::BIGINT AS num_graph_nodes, count(*)::BIGINT AS num_components, sum(num_edges)::BIGINT AS num_edges FROM comps GROUP BY ROLLUP (tile_id, sub_tile_id)", "comps")
def _(spark, d):
    return stats.totals_by_level(comps(spark, d))


@query("agg_avg_degree", "SELECT tile_id, round(2 * sum(num_edges) / sum(num_nodes)::DOUBLE, 6) AS avg_degree FROM comps GROUP BY 1", "comps")
def _(spark, d):
    return comps(spark, d).groupBy("tile_id").agg(F.round(stats.average_degree(F.sum("num_edges"), F.sum("num_nodes")), 6).alias("avg_degree"))


AXIAL = "((degrees(atan2(s, c)) / 2) % 180 + 180) % 180"


@query("agg_axial_plain", f"WITH t AS (SELECT tile_id, sub_tile_id, sum(sin(radians(2 * orientation_deg_axial))) AS s, sum(cos(radians(2 * orientation_deg_axial))) AS c FROM edges GROUP BY 1, 2) SELECT tile_id, sub_tile_id, round({AXIAL}, 6) AS axial FROM t", "edges")
def _(spark, d):
    return edges(spark, d).groupBy(*SUB).agg(F.round(axial_mean(F.col("orientation_deg_axial")), 6).alias("axial"))


@query("agg_axial_weighted", f"WITH t AS (SELECT tile_id, sum(length_m * sin(radians(2 * orientation_deg_axial))) AS s, sum(length_m * cos(radians(2 * orientation_deg_axial))) AS c FROM edges GROUP BY 1) SELECT tile_id, round({AXIAL}, 6) AS axial FROM t", "edges")
def _(spark, d):
    return edges(spark, d).groupBy("tile_id").agg(F.round(axial_mean(F.col("orientation_deg_axial"), F.col("length_m")), 6).alias("axial"))


MARKED = "SELECT tile_id, CASE WHEN l_linenumber = 3 THEN -1.0::DOUBLE WHEN l_linenumber = 4 THEN NULL ELSE orientation_deg_axial END AS t, CASE WHEN l_linenumber = 5 THEN 0 ELSE length_m END AS w FROM edges"


def marked(spark, d):
    t = F.when(F.col("l_linenumber") == 3, F.lit(-1.0)).when(F.col("l_linenumber") == 4, F.lit(None)).otherwise(F.col("orientation_deg_axial"))
    return edges(spark, d).select("tile_id", t.alias("t"), F.when(F.col("l_linenumber") == 5, F.lit(0.0)).otherwise(F.col("length_m")).alias("w"))


COMBINED = f"WITH m AS ({MARKED}), t AS (SELECT tile_id, sum(w * sin(radians(2 * t))) AS s, sum(w * cos(radians(2 * t))) AS c FROM m WHERE w > 0 AND t >= 0 GROUP BY 1) SELECT tile_id, round({AXIAL}, 6) AS axial FROM t"


def combined(spark, d):
    return marked(spark, d).groupBy("tile_id").agg(F.round(axial_mean(F.col("t"), F.col("w"), negative="skip"), 6).alias("axial"))


query("agg_axial_combine", COMBINED, "edges")(combined)
query("flt_positive_weight", COMBINED, "edges")(combined)


@query("agg_axial_wrapped", f"WITH m AS ({MARKED}), t AS (SELECT tile_id, sum(w * sin(radians(2 * t))) AS s, sum(w * cos(radians(2 * t))) AS c FROM (SELECT tile_id, w, ((t % 180) + 180) % 180 AS t FROM m) GROUP BY 1) SELECT tile_id, round({AXIAL}, 6) AS axial FROM t", "edges")
def _(spark, d):
    return marked(spark, d).groupBy("tile_id").agg(F.round(axial_mean(F.col("t"), F.col("w")), 6).alias("axial"))


@query("fn_axial_double", "SELECT DISTINCT orientation_deg_axial AS t, round(sin(radians(2 * orientation_deg_axial)), 6) + 0.0 AS s, round(cos(radians(2 * orientation_deg_axial)), 6) + 0.0 AS c FROM edges", "edges")
def _(spark, d):
    s, c = doubled(F.col("orientation_deg_axial"))
    return edges(spark, d).select(F.col("orientation_deg_axial").alias("t"), (F.round(s, 6) + 0.0).alias("s"), (F.round(c, 6) + 0.0).alias("c")).distinct()


TILE = f"""t AS (SELECT tile_id, {TOTALS} FROM comps GROUP BY 1),
    p AS (SELECT tile_id, quantile_cont(length_m, 0.95) AS p95 FROM edges GROUP BY 1),
    m AS (SELECT tile_id, round(avg(length_m), 4) AS mean_branch_len_95_m FROM edges JOIN p USING (tile_id) WHERE length_m <= p95 GROUP BY 1),
    o AS (SELECT tile_id, round({AXIAL}, 6) AS orientation_deg_axial FROM (SELECT tile_id, sum(length_m * sin(radians(2 * orientation_deg_axial))) AS s, sum(length_m * cos(radians(2 * orientation_deg_axial))) AS c FROM edges GROUP BY 1)),
    tile AS (SELECT * FROM t JOIN m USING (tile_id) JOIN o USING (tile_id))"""
TILE_REAL = (*REAL, "mean_branch_len_95_m", "orientation_deg_axial")


def tile_rows(spark, d):
    return rounded(stats.tile_stats(comps(spark, d), edges(spark, d)), *TILE_REAL)


query("tile_stats", f"WITH {TILE} SELECT * FROM tile", "edges comps")(tile_rows)
query("prj_records", f"WITH {TILE} SELECT * FROM tile", "edges comps")(lambda spark, d: tile_rows(spark, d))


SUBTILE = f"""WITH t AS (SELECT tile_id, sub_tile_id, {TOTALS} FROM comps GROUP BY 1, 2),
    p AS (SELECT tile_id, sub_tile_id, quantile_cont(length_m, 0.95) AS p95 FROM edges GROUP BY 1, 2),
    m AS (SELECT tile_id, sub_tile_id, round(avg(length_m), 4) AS mean_branch_len_95_m FROM edges JOIN p USING (tile_id, sub_tile_id) WHERE length_m <= p95 GROUP BY 1, 2),
    o AS (SELECT tile_id, sub_tile_id, round({AXIAL}, 6) AS orientation_deg_axial FROM (SELECT tile_id, sub_tile_id, sum(length_m * sin(radians(2 * orientation_deg_axial))) AS s, sum(length_m * cos(radians(2 * orientation_deg_axial))) AS c FROM edges GROUP BY 1, 2))
    SELECT * FROM t JOIN m USING (tile_id, sub_tile_id) JOIN o USING (tile_id, sub_tile_id)"""
query("subtile_stats", SUBTILE, "edges comps")(lambda spark, d: rounded(stats.tile_stats(comps(spark, d), edges(spark, d), SUB), *TILE_REAL))


@query("tile_aggregate", f"WITH {TILE} SELECT 'tile' AS level, tile_id, num_graph_nodes, num_components, total_length_m FROM tile UNION ALL SELECT 'subtile', sub_tile_id, sum(num_nodes)::BIGINT, count(*)::BIGINT, round(sum(total_length_m), 6) FROM comps GROUP BY sub_tile_id", "edges comps")
def _(spark, d):
    names = ("num_graph_nodes", "num_components", "total_length_m")
    tile = tile_rows(spark, d).select(F.lit("tile").alias("level"), "tile_id", *names)
    sub = rounded(stats.totals(comps(spark, d), ["sub_tile_id"]), "total_length_m").select(F.lit("subtile").alias("level"), F.col("sub_tile_id").alias("tile_id"), *names)
    return tile.unionByName(sub)


query("win_row_ids", f"WITH {TILE} SELECT tile_id, row_number() OVER (ORDER BY tile_id)::BIGINT AS id FROM tile", "edges comps")(lambda spark, d: stats.numbered(tile_rows(spark, d)).select("tile_id", "id"))
query("topk_largest", "SELECT tile_id, round(max(total_length_m), 6) AS longest FROM comps GROUP BY 1", "comps")(lambda spark, d: comps(spark, d).groupBy("tile_id").agg(F.round(F.max("total_length_m"), 6).alias("longest")))

SUMS = "count(*)::BIGINT AS num_tiles, sum(num_graph_nodes)::BIGINT AS num_graph_nodes, sum(num_graph_edges)::BIGINT AS num_graph_edges, sum(num_endnodes)::BIGINT AS num_endnodes, sum(num_junctions)::BIGINT AS num_junctions, sum(num_components)::BIGINT AS num_components, sum(num_edges)::BIGINT AS num_edges, round(sum(total_length_m), 4) AS total_length_m, round(max(max_component_length_m), 6) AS max_component_length_m"
MEANS = f"round(sum(total_length_m) / sum(num_components), 6) AS mean_component_length_m, round(sum(mean_branch_len_95_m * num_edges) / sum(num_edges), 5) AS mean_branch_len_95_m, round(2 * sum(num_graph_edges) / sum(num_graph_nodes)::DOUBLE, 6) AS avg_degree, (SELECT round({AXIAL}, 4) FROM (SELECT sum(num_graph_edges * sin(radians(2 * orientation_deg_axial))) AS s, sum(num_graph_edges * cos(radians(2 * orientation_deg_axial))) AS c FROM tile WHERE num_graph_edges > 0 AND orientation_deg_axial >= 0)) AS orientation_deg_axial"
ADDED = ("num_tiles", "num_graph_nodes", "num_graph_edges", "num_endnodes", "num_junctions", "num_components", "num_edges", "total_length_m", "max_component_length_m")
MEAN = ("mean_component_length_m", "mean_branch_len_95_m", "avg_degree", "orientation_deg_axial")


def mosaic(spark, d):
    digits = {"total_length_m": 4, "max_component_length_m": 6, "mean_component_length_m": 6, "mean_branch_len_95_m": 5, "avg_degree": 6, "orientation_deg_axial": 4}
    return stats.mosaic(tile_rows(spark, d)).withColumns({n: F.round(n, k) for n, k in digits.items()})


query("agg_mosaic_totals", f"WITH {TILE} SELECT {SUMS} FROM tile", "edges comps")(lambda spark, d: mosaic(spark, d).select(*ADDED))
query("agg_mosaic_means", f"WITH {TILE} SELECT {MEANS} FROM tile", "edges comps")(lambda spark, d: mosaic(spark, d).select(*MEAN))
query("master_build", f"WITH {TILE} SELECT {SUMS}, {MEANS} FROM tile", "edges comps")(lambda spark, d: mosaic(spark, d).select(*ADDED, *MEAN))


@query("prj_poly_attrs", f"WITH {TILE} SELECT tile_id, num_components, " + ", ".join(f"round(CASE WHEN num_components > 0 THEN {n} / num_components::DOUBLE ELSE 0 END, 6) AS avg_{n}" for n in ("num_graph_nodes", "num_graph_edges", "num_endnodes", "num_junctions", "num_edges")) + " FROM tile", "edges comps")
def _(spark, d):
    made = stats.per_component(tile_rows(spark, d))
    names = [c for c in made.columns if c.startswith("avg_num_")]
    return rounded(made, *names).select("tile_id", "num_components", *names)


XML = f"WITH {TILE} SELECT tile_id, concat('<TileSummary>', chr(10), '  <tile_id>', tile_id, '</tile_id>', chr(10)" + "".join(
    f", '  <{n}>', {n}, '</{n}>', chr(10)" for n in ("num_graph_nodes", "num_graph_edges", "num_components", "num_edges")
) + "".join(f", '  <{n}>', printf('%.6f', {n}), '</{n}>', chr(10)" for n in ("total_length_m", "mean_component_length_m", "max_component_length_m", "avg_degree")) + ", '</TileSummary>') AS xml FROM tile"
query("snk_xml_tile", XML, "edges comps")(lambda spark, d: stats.tile_xml(tile_rows(spark, d)))


@query("snk_xml_mosaic", f"WITH {TILE}, s AS (SELECT {SUMS} FROM tile) SELECT concat('<MosaicSummary>', chr(10), '  <num_tiles>', num_tiles, '</num_tiles>', chr(10), '  <total_length_m>', printf('%.6f', total_length_m), '</total_length_m>', chr(10), '</MosaicSummary>') AS xml FROM s", "edges comps")
def _(spark, d):
    return mosaic(spark, d).select(stats.summary_xml([("num_tiles", F.col("num_tiles").cast("string")), ("total_length_m", fmt6(F.col("total_length_m")))], "MosaicSummary").alias("xml"))


@query("snk_metadata", f"WITH {TILE}, x AS (SELECT row_number() OVER (ORDER BY tile_id)::BIGINT AS md_file_id, tile_id AS row_id_value FROM tile) SELECT md_file_id, row_id_value, reference_scope, table_name FROM x, (VALUES ('geopackage', 'global_stats'), ('row', 'global_poly')) v(reference_scope, table_name)", "edges comps")
def _(spark, d):
    return stats.metadata(stats.tile_xml(tile_rows(spark, d)), [("geopackage", "global_stats"), ("row", "global_poly")])[1]


@query("jn_master_poly", f"WITH {TILE} SELECT tile_id, num_components, n_name FROM tile JOIN (SELECT * FROM nation WHERE n_nationkey % 4 <> 1) n ON tile_id = n_nationkey", "edges comps")
def _(spark, d):
    poly = table(spark, d, "nation").where("n_nationkey % 4 <> 1").select(F.col("n_nationkey").alias("tile_id"), "n_name")
    return tile_rows(spark, d).join(poly, "tile_id").select("tile_id", "num_components", "n_name")


@query("jn_poly_rowid", f"WITH {TILE}, ids AS (SELECT n_nationkey AS tile_id, row_number() OVER (ORDER BY n_nationkey)::BIGINT AS row_id FROM nation WHERE n_nationkey % 4 <> 1) SELECT tile_id, row_id FROM tile LEFT JOIN ids USING (tile_id)", "edges comps")
def _(spark, d):
    ids = stats.numbered(table(spark, d, "nation").where("n_nationkey % 4 <> 1").select(F.col("n_nationkey").alias("tile_id")), "tile_id", "row_id")
    return tile_rows(spark, d).select("tile_id").join(ids, "tile_id", "left")


SEMI = "SELECT tile_id, sub_tile_id, count(*)::BIGINT AS num_components FROM comps WHERE tile_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) GROUP BY 1, 2"


def appended(spark, d):
    master = table(spark, d, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("tile_id"))
    return comps(spark, d).join(master, "tile_id", "left_semi").groupBy(*SUB).agg(F.count("*").alias("num_components"))


query("jn_subtile_master", SEMI, "comps")(appended)


@query("subtile_append", f"SELECT * FROM ({SEMI}) a UNION ALL SELECT n_nationkey, NULL, 0 FROM nation", "comps")
def _(spark, d):
    more = table(spark, d, "nation").select(F.col("n_nationkey").alias("tile_id"), F.lit(0).cast("long").alias("num_components"))
    return appended(spark, d).unionByName(more, allowMissingColumns=True)


@query("agg_bounds", "SELECT tile_id, min(r) AS min_r, min(c) AS min_c, max(r) AS max_r, max(c) AS max_c FROM px GROUP BY 1", "px")
def _(spark, d):
    return view(spark, d, "px").groupBy("tile_id").agg(*[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("r", "c")])


# --- numbers ------------------------------------------------------------------------------------

TEXT = "CASE o_orderkey % 5 WHEN 0 THEN 'x' WHEN 1 THEN NULL WHEN 2 THEN '2.5' WHEN 3 THEN CAST(o_orderkey AS VARCHAR) ELSE '1e2' END"


def texts(spark, d):
    k = F.col("o_orderkey")
    t = F.when(k % 5 == 0, "x").when(k % 5 == 1, F.lit(None)).when(k % 5 == 2, "2.5").when(k % 5 == 3, k.cast("string")).otherwise("1e2")
    return table(spark, d, "orders").select("o_orderkey", t.alias("t"))


@query("prj_as_float", f"SELECT o_orderkey, coalesce(try_cast({TEXT} AS DOUBLE), 0.0::DOUBLE) AS x FROM orders")
def _(spark, d):
    return texts(spark, d).select("o_orderkey", as_float(F.col("t")).alias("x"))


@query("prj_coerce", f"SELECT o_orderkey, round_even(try_cast({TEXT} AS DOUBLE), 0)::BIGINT AS n, coalesce({TEXT}, '') AS wkt FROM orders")
def _(spark, d):
    return texts(spark, d).select("o_orderkey", as_int(F.col("t")).alias("n"), F.coalesce("t", F.lit("")).alias("wkt"))


@query("fn_round_half_even", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(l_quantity / 2, 0)::BIGINT AS n FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", round_half_even(F.col("l_quantity") / 2).alias("n"))


@query("fn_round16", "SELECT p_partkey, greatest(16, (p_partkey // 16) * 16)::BIGINT AS n FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", round16(F.col("p_partkey")).alias("n"))


@query("prj_clamp01", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(0.0, least(1.0, l_extendedprice / 50000 - 0.2))::DOUBLE AS x FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", clamp01(F.col("l_extendedprice") / 50000 - 0.2).alias("x"))


@query("fn_fmt6", "SELECT p_partkey, printf('%.6f', p_retailprice / 7) AS s FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", fmt6(F.col("p_retailprice") / 7).alias("s"))


@query("fn_sigmoid", "SELECT p_partkey, round(1 / (1 + exp(-(p_size - 25) / 10.0::DOUBLE)), 6) AS p FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(sigmoid((F.col("p_size") - 25) / 10.0), 6).alias("p"))


STEP = "CASE p_partkey % 3 WHEN 0 THEN p_size * 0.5::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE p_size * 0.25::DOUBLE END"


@query("fn_step_len", f"SELECT p_partkey, CASE WHEN abs(a) > 0 AND abs(e) > 0 AND abs(abs(a) - abs(e)) / greatest(abs(a), abs(e), 1e-300) < 1e-6 THEN (abs(a) + abs(e)) / 2 ELSE 0.5::DOUBLE END AS step FROM (SELECT p_partkey, {STEP} AS a, -p_size * 0.5::DOUBLE AS e FROM part) t")
def _(spark, d):
    k, size = F.col("p_partkey") % 3, F.col("p_size")
    a = F.when(k == 0, size * 0.5).when(k == 1, F.lit(0.0)).otherwise(size * 0.25)
    return table(spark, d, "part").select("p_partkey", step_length(a, -size * 0.5).alias("step"))


@query("fn_pixel_size", "SELECT p_partkey, abs(-p_size * 0.5::DOUBLE) AS width, abs(p_size * 0.25::DOUBLE) AS height FROM part")
def _(spark, d):
    from ..functions.numbers import pixel_size

    return table(spark, d, "part").select("p_partkey", pixel_size(-F.col("p_size") * 0.5, F.col("p_size") * 0.25).alias("s")).select("p_partkey", "s.width", "s.height")
