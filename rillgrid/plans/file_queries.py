"""Names, manifests, audits, sources and sinks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions import geometry, names, overlay
from ..operators import audit
from ..sources import files, geojson, geotiff, gpkg, shapefile
from ..storage import shared_folder
from .proxies import table, view
from .registry import query

# --- names ----------------------------------------------------------------------------------------

STEM = "regexp_replace(name, '\\.[^.]*$', '')"
BARE = f"regexp_replace({STEM}, '(?i)[_-]mask$', '')"


def expected(spark, d):
    return view(spark, d, "expected")


def done(spark, d):
    return view(spark, d, "done")


query("fn_strip_mask", f"SELECT sub, {BARE} AS s FROM expected", "expected")(lambda spark, d: expected(spark, d).select("sub", names.strip_mask(names.stem(F.col("name"))).alias("s")))
query("fn_expected_gpkg", f"SELECT sub, concat({BARE}, '_TCN.gpkg') AS s FROM expected", "expected")(lambda spark, d: expected(spark, d).select("sub", names.expected_package(F.col("name")).alias("s")))
query("fn_subtile_id", "SELECT name, regexp_replace(regexp_replace(name, '\\.[^.]*$', ''), '(?i)_tcn(?:_.*)?$', '') AS s FROM done", "done")(lambda spark, d: done(spark, d).select("name", names.subtile_id(F.col("name")).alias("s")))
query("fn_subtile_digits", "SELECT sub, coalesce(nullif(regexp_extract(name, '(?i)(\\d+)_mask\\.tiff?$', 1), ''), 'x') AS s FROM expected", "expected")(lambda spark, d: expected(spark, d).select("sub", names.subtile_digits(F.col("name")).alias("s")))
query("fn_tile_from_name", "SELECT sub, concat(tile_id, '_', sub) AS s FROM expected", "expected")(lambda spark, d: expected(spark, d).select("sub", names.tile_from_name(F.concat(F.lit("/a/b/"), "name")).alias("s")))
query("fn_norm_key", "SELECT n_nationkey, lower(trim(concat('  ', n_name, ' '))) AS s FROM nation")(lambda spark, d: table(spark, d, "nation").select("n_nationkey", names.norm_key(F.concat(F.lit("  "), "n_name", F.lit(" "))).alias("s")))
query("fn_tilename_keys", "SELECT n_nationkey, unnest([concat(lower(n_name), '.tif'), concat(lower(n_name), '.tiff'), lower(n_name)]) AS k FROM nation")(
    lambda spark, d: table(spark, d, "nation").select("n_nationkey", F.explode(names.tile_name_keys(F.col("n_name"))).alias("k"))
)
query("fn_global_component_id", "SELECT tile_id, sub_tile_id, component_id, concat_ws('|', tile_id, sub_tile_id, component_id) AS s FROM comps", "comps")(
    lambda spark, d: view(spark, d, "comps").select("tile_id", "sub_tile_id", "component_id", names.global_component_id(F.col("tile_id"), F.col("sub_tile_id"), F.col("component_id")).alias("s"))
)
query("fn_tile_path", "SELECT sub, concat('/out/', tile_id, '/', regexp_replace(regexp_replace(name, '\\.[^.]*$', ''), '_mask$', ''), '_TCN.gpkg') AS s FROM expected", "expected")(
    lambda spark, d: expected(spark, d).select("sub", names.tile_path(F.col("name"), "/out", F.col("tile_id").cast("string"), strip=("_mask", "k"), postfix="_TCN").alias("s"))
)
PATH = "concat(CASE WHEN sub % 3 = 0 THEN '/in/' ELSE '/else/' END, tile_id, '/', name)"


def paths(spark, d):
    root = F.when(F.col("sub") % 3 == 0, F.lit("/in/")).otherwise(F.lit("/else/"))
    return expected(spark, d).withColumn("path", F.concat(root, F.col("tile_id").cast("string"), F.lit("/"), "name"))


query("fn_out_path", f"SELECT sub, CASE WHEN sub % 3 = 0 THEN concat('/o/', tile_id, '/', name) ELSE concat('/o/', name) END AS s FROM (SELECT *, {PATH} AS path FROM expected) t", "expected")(
    lambda spark, d: paths(spark, d).select("sub", names.out_path(F.col("path"), "/in", "/o").alias("s"))
)
query("src_cutline_path", "SELECT sub, CASE sub % 3 WHEN 0 THEN concat('/v/t', tile_id, '/Mosaic_t', tile_id, '_cutlines.shp') WHEN 1 THEN concat('/v/', tile_id, '_9/Mosaic_', tile_id, '_9_cutlines.shp') ELSE concat('/v/', tile_id, '_', sub, '/Mosaic_', tile_id, '_', sub, '_cutlines.shp') END AS s FROM expected", "expected")(
    lambda spark, d: expected(spark, d).select(
        "sub",
        names.cutline_path(
            F.lit("/v"),
            F.concat(F.when(F.col("sub") % 3 == 1, F.concat(F.lit("/m/"), F.col("tile_id").cast("string"), F.lit("_9/"))).otherwise(F.lit("/m/x/")), "name"),
            F.when(F.col("sub") % 3 == 0, F.concat(F.lit("t"), F.col("tile_id").cast("string"))),
        ).alias("s"),
    )
)
query("fn_srs_label", "SELECT layer_id, CASE WHEN layer_id % 4 = 0 THEN concat('SRS_ID:', layer_id) ELSE 'EPSG:3338' END AS s FROM layers", "layers")(
    lambda spark, d: view(spark, d, "layers").select("layer_id", names.srs_label(F.when(F.col("layer_id") % 4 == 0, "none").otherwise("epsg"), F.lit(3338), F.col("layer_id")).alias("s"))
)
query("fn_join_list", "SELECT tile_id, string_agg(DISTINCT layer, ';' ORDER BY layer) AS s FROM layers GROUP BY 1", "layers")(
    lambda spark, d: view(spark, d, "layers").groupBy("tile_id").agg(names.join_list(F.collect_set("layer")).alias("s"))
)
query("srt_lists", "SELECT tile_id, string_agg(layer, ',' ORDER BY layer) AS s FROM layers GROUP BY 1", "layers")(
    lambda spark, d: view(spark, d, "layers").groupBy("tile_id").agg(names.join_list(F.collect_list("layer"), ",").alias("s"))
)
query("fn_split_csv", "SELECT n_nationkey, unnest([trim(x) FOR x IN string_split(concat(n_name, ' , ,b,', n_nationkey, ' '), ',') IF trim(x) <> '']) AS s FROM nation")(
    lambda spark, d: table(spark, d, "nation").select("n_nationkey", F.explode(names.split_list(F.concat("n_name", F.lit(" , ,b,"), F.col("n_nationkey").cast("string"), F.lit(" ")))).alias("s"))
)
TRUTH = "CASE n_nationkey % 5 WHEN 0 THEN 'TRUE ' WHEN 1 THEN '1' WHEN 2 THEN 'Yes' WHEN 3 THEN 'no' END"
query("fn_truthy", f"SELECT n_nationkey, coalesce(lower(trim({TRUTH})) IN ('true', '1', 'yes'), false) AS ok FROM nation")(
    lambda spark, d: table(spark, d, "nation").select("n_nationkey", names.truthy(F.element_at(F.array(F.lit("TRUE "), F.lit("1"), F.lit("Yes"), F.lit("no"), F.lit(None)), (F.col("n_nationkey") % 5 + 1).cast("int"))).alias("ok"))
)
CRS_TEXT = """CASE event_id % 4 WHEN 0 THEN '{"crs": {"properties": {"name": "urn:x"}}}' WHEN 1 THEN '{"crs": {"properties": {"code": 3338}}}' WHEN 2 THEN '{}' ELSE props END"""
query("fn_json_crs", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'urn:x' WHEN 1 THEN 'EPSG:3338' ELSE 'EPSG:4326' END AS crs FROM events")(
    lambda spark, d: table(spark, d, "events").select("event_id", names.json_crs(F.expr(CRS_TEXT)).alias("crs"))
)
query("fn_json_value", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")(lambda spark, d: table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")))


@query("srt_natural", "SELECT tile_id, string_agg(s, ',' ORDER BY n, s) AS listed FROM (SELECT tile_id, sub AS n, concat('t', sub) AS s FROM expected) t GROUP BY 1", "expected")
def _(spark, d):
    s = F.concat(F.lit("t"), F.col("sub").cast("string"))
    listed = F.sort_array(F.collect_list(F.struct(names.natural_key(s).alias("k"), s.alias("s"))))
    return expected(spark, d).groupBy("tile_id").agg(F.array_join(F.transform(listed, lambda x: x["s"]), ",").alias("listed"))


# --- manifests --------------------------------------------------------------------------------------

HAS = f"EXISTS (SELECT 1 FROM done d WHERE d.name = concat(regexp_replace(regexp_replace(e.name, '\\.[^.]*$', ''), '(?i)[_-]mask$', ''), '_TCN.gpkg'))"
query("jn_resume_anti", f"SELECT tile_id, sub FROM expected e WHERE NOT {HAS}", "expected done")(lambda spark, d: audit.pending(expected(spark, d), done(spark, d)).select("tile_id", "sub"))
query("jn_resume_semi", f"SELECT tile_id, sub FROM expected e WHERE {HAS}", "expected done")(lambda spark, d: audit.finished(expected(spark, d), done(spark, d)).select("tile_id", "sub"))
query("jn_missing_agg", "SELECT c_custkey AS tile_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01')")(
    lambda spark, d: audit.without_aggregate(table(spark, d, "customer").select(F.col("c_custkey").alias("tile_id")), view(spark, d, "files").where("modified >= TIMESTAMP '2000-01-01'"), "tile_id")
)
STATUS = f"""WITH s AS (SELECT tile_id, sub, {HAS} AS ok FROM expected e)
    SELECT CAST(tile_id AS VARCHAR) AS tile_id, count(*)::BIGINT AS total, count(*) FILTER (ok)::BIGINT AS done, count(*) FILTER (NOT ok)::BIGINT AS balance, coalesce(string_agg(CAST(sub AS VARCHAR), ',' ORDER BY sub) FILTER (NOT ok), '') AS pending FROM s GROUP BY tile_id
    UNION ALL SELECT 'SUM', count(*)::BIGINT, count(*) FILTER (ok)::BIGINT, count(*) FILTER (NOT ok)::BIGINT, '' FROM s"""
for _name in ("agg_status", "status_report"):
    query(_name, STATUS, "expected done")(lambda spark, d: audit.status_report(expected(spark, d), done(spark, d)))

ORDER = ["tile_id", "sub"]
RANKED = "SELECT tile_id, sub, row_number() OVER (ORDER BY tile_id, sub) - 1 AS k FROM expected"
for _name in ("win_round_robin", "job_shard"):
    query(_name, f"SELECT tile_id, sub FROM ({RANKED}) t WHERE k % 4 = 1", "expected")(lambda spark, d: audit.round_robin(expected(spark, d), ORDER, 4, 2).select("tile_id", "sub"))
query("win_slice", f"SELECT tile_id, sub FROM ({RANKED}) t WHERE k + 1 BETWEEN 10 AND 60", "expected")(lambda spark, d: audit.sliced(expected(spark, d), ORDER, 10, 60).select("tile_id", "sub"))
query("win_cap", f"SELECT tile_id, sub FROM ({RANKED}) t WHERE k < 35", "expected")(lambda spark, d: audit.capped(expected(spark, d), ORDER, 35).select("tile_id", "sub"))
query("win_limit", "SELECT DISTINCT tile_id FROM expected ORDER BY 1 LIMIT 7", "expected")(lambda spark, d: expected(spark, d).select("tile_id").distinct().orderBy("tile_id").limit(7))
query("flt_one_tile", "SELECT sub FROM expected WHERE tile_id = 7", "expected")(lambda spark, d: expected(spark, d).where("tile_id = 7").select("sub"))
LATEST = "SELECT tile_id, arg_max(path, (modified, path)) AS path FROM files GROUP BY 1"
query("win_latest", LATEST, "files")(lambda spark, d: audit.latest(view(spark, d, "files"), ["tile_id"]).select("tile_id", "path"))
query("harvest_rows", f"WITH l AS ({LATEST}) SELECT tile_id, path, round(o_totalprice, 2) AS total FROM l JOIN orders ON path = concat('/data/t', o_custkey, '/f', o_orderkey, '_summary.gpkg')", "files")(
    lambda spark, d: audit.latest(view(spark, d, "files"), ["tile_id"])
    .select("tile_id", "path")
    .join(table(spark, d, "orders").select(F.concat(F.lit("/data/t"), F.col("o_custkey").cast("string"), F.lit("/f"), F.col("o_orderkey").cast("string"), F.lit("_summary.gpkg")).alias("path"), F.round("o_totalprice", 2).alias("total")), "path")
    .select("tile_id", "path", "total")
)
query("set_union_candidates", "SELECT path FROM files WHERE tile_id % 2 = 0 UNION SELECT path FROM files WHERE tile_id % 3 = 0", "files")(
    lambda spark, d: view(spark, d, "files").where("tile_id % 2 = 0").select("path").union(view(spark, d, "files").where("tile_id % 3 = 0").select("path")).distinct()
)
NAMED = "SELECT tile_id, regexp_extract(path, '[^/]*$') AS name FROM files"
for _name in ("flt_exclude_name", "src_iter_gpkgs"):
    query(_name, f"SELECT tile_id, name FROM ({NAMED}) t WHERE lower(name) NOT LIKE '%7%' AND lower(name) NOT LIKE '%f12%'", "files")(
        lambda spark, d: files.excluding(view(spark, d, "files").select("tile_id", names.base_name(F.col("path")).alias("name")), ["7", "F12"])
    )
query("src_dirs", "SELECT DISTINCT concat('t', tile_id) AS tile_id FROM files", "files")(lambda spark, d: files.tiles(view(spark, d, "files").select("path")))


@query("jn_tilename", """WITH listed AS (SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN concat(' Sub', c_custkey % 40, '.TIF') WHEN 1 THEN concat('sub', c_custkey % 40, '.tiff') ELSE concat('SUB', c_custkey % 40) END AS n FROM customer),
    k AS (SELECT id, lower(trim(n)) AS k FROM listed), f AS (SELECT k, min(id) AS id FROM k GROUP BY 1),
    s AS (SELECT s_suppkey, concat('Sub', s_suppkey) AS sub FROM supplier),
    c AS (SELECT s_suppkey, p, id FROM s, (VALUES (1, '.tif'), (2, '.tiff'), (3, '')) v(p, e) JOIN f ON f.k = concat(lower(sub), e))
    SELECT s_suppkey, arg_min(id, p) AS id FROM c GROUP BY 1""")
def _(spark, d):
    n = F.col("c_custkey") % 40
    listed = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" Sub"), n.cast("string"), F.lit(".TIF"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("sub"), n.cast("string"), F.lit(".tiff"))).otherwise(F.concat(F.lit("SUB"), n.cast("string"))).alias("n"),
    )
    first = listed.groupBy(names.norm_key(F.col("n")).alias("k")).agg(F.min("id").alias("id"))
    keys = table(spark, d, "supplier").select("s_suppkey", F.posexplode(names.tile_name_keys(F.concat(F.lit("Sub"), F.col("s_suppkey").cast("string")))).alias("p", "k"))
    return keys.join(first, "k").groupBy("s_suppkey").agg(F.min_by("id", "p").alias("id"))


MERGED = "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN round(o_totalprice * 2, 2) END, CASE WHEN o_orderkey % 2 = 0 THEN round(o_totalprice, 2) END) AS v FROM orders"


def merged(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.round("o_totalprice", 2)).alias("v"))
    updates = table(spark, d, "orders").where("o_orderkey % 4 = 0").select("o_orderkey", F.round(F.col("o_totalprice") * 2, 2).alias("v"))
    return audit.merge_attributes(rows, updates, ["o_orderkey"], ["v"])


query("jn_attr_merge", MERGED)(merged)


@query("snk_attr_update", "SELECT concat('/p/', n_regionkey, '.gpkg') AS path, n_nationkey::BIGINT AS k, (CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey * 10 ELSE n_nationkey END)::BIGINT AS v FROM nation")
def _(spark, d):
    """A layer's rows set by key inside the packages, and read back."""

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p = gpkg.Package()
        p.write("Nodes", pdf[["k", "v"]], {"k": "bigint", "v": "bigint"}, key="k")
        new = pdf[pdf["k"] % 3 == 0].assign(v=lambda x: x["k"] * 10)
        again = gpkg.Package(p.content())
        again.update("Nodes", ["k"], new, ["v"])
        return pd.DataFrame({"path": [f"/p/{key[0]}.gpkg"], "content": [again.content()]})

    rows = table(spark, d, "nation").select("n_regionkey", F.col("n_nationkey").cast("long").alias("k"), F.col("n_nationkey").cast("long").alias("v"))
    made = rows.groupBy("n_regionkey").applyInPandas(build, "path string, content binary")
    return gpkg.read_table(made, "Nodes", "k long, v long")


@query("snk_add_field", "SELECT concat('/p/', n_regionkey, '.gpkg') AS path, n_nationkey::BIGINT AS k, CASE WHEN n_nationkey >= 100 THEN n_nationkey - 100 END::DOUBLE AS norm_input_exp FROM (SELECT * FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation) t")
def _(spark, d):
    """Rows with a field that the layer does not have yet: it is added, null in the rows before."""

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p = gpkg.Package()
        p.write("Nodes", pdf[["k"]], {"k": "bigint"})
        more = pdf.assign(norm_input_exp=pdf["k"].astype(float), k=pdf["k"] + 100)
        p.write("Nodes", more, {"k": "bigint", "norm_input_exp": "double"}, mode="append")
        return pd.DataFrame({"path": [f"/p/{key[0]}.gpkg"], "content": [p.content()]})

    made = table(spark, d, "nation").select("n_regionkey", F.col("n_nationkey").cast("long").alias("k")).groupBy("n_regionkey").applyInPandas(build, "path string, content binary")
    return gpkg.read_table(made, "Nodes", "k long, norm_input_exp double")


@query("snk_delete_layer", "SELECT concat('/p/', r_regionkey, '.gpkg') AS path, CASE WHEN r_regionkey % 2 = 0 THEN 'Edges' ELSE 'Nodes' END AS layer FROM region")
def _(spark, d):
    """Of an empty package's two layers one is dropped, with all the package says of it."""

    def build(frames):
        for pdf in frames:
            out = []
            for k in pdf["r_regionkey"]:
                p = gpkg.Package()
                for layer in ("Edges", "Nodes"):
                    p.write(layer, pd.DataFrame({"k": []}), {"k": "bigint"})
                p.drop("Nodes" if k % 2 == 0 else "Edges")
                out.append((f"/p/{k}.gpkg", p.content()))
            yield pd.DataFrame(out, columns=["path", "content"])

    made = table(spark, d, "region").select("r_regionkey").mapInPandas(build, "path string, content binary")
    return gpkg.read_table(made, "gpkg_contents", "table_name string").select("path", F.col("table_name").alias("layer"))
query("prj_align", "SELECT n_nationkey AS tile_id, NULL::VARCHAR AS wkt, n_name AS name, NULL::DOUBLE AS area FROM nation")(
    lambda spark, d: audit.aligned(table(spark, d, "nation").select(F.col("n_nationkey").alias("tile_id"), F.col("n_name").alias("name"), "n_regionkey"), [("tile_id", dict(table(spark, d, "nation").dtypes)["n_nationkey"]), ("wkt", "string"), ("name", "string"), ("area", "double")])
)

# --- audits -------------------------------------------------------------------------------------------

WANT = ("Components", "Cutlines", "Edges", "Missing", "Nodes")
QUOTED = ", ".join(f"'{w}'" for w in WANT)


def layers(spark, d):
    return view(spark, d, "layers")


GOT = "got AS (SELECT tile_id, list_sort(list_distinct(list(layer))) AS present FROM layers GROUP BY 1)"
query("set_missing_layers", f"WITH {GOT} SELECT tile_id, array_to_string(list_filter([{QUOTED}], lambda x: NOT list_contains(present, x)), ';') AS missing FROM got", "layers")(
    lambda spark, d: audit.layer_report(layers(spark, d), "tile_id", WANT).select("tile_id", "missing")
)
query("set_extra_layers", f"WITH {GOT} SELECT tile_id, array_to_string(list_filter(present, lambda x: NOT list_contains([{QUOTED}], x)), ';') AS extra FROM got", "layers")(
    lambda spark, d: audit.layer_report(layers(spark, d), "tile_id", WANT).select("tile_id", "extra")
)
query("set_intersect_layers", f"WITH {GOT} SELECT tile_id, array_to_string(list_filter(present, lambda x: list_contains(['Edges', 'Nodes'], x)), ';') AS both FROM got", "layers")(
    lambda spark, d: layers(spark, d).groupBy("tile_id").agg(names.join_list(F.array_intersect(F.sort_array(F.collect_set("layer")), F.array(F.lit("Edges"), F.lit("Nodes")))).alias("both"))
)
query("set_missing_fields", f"WITH {GOT} SELECT tile_id, array_to_string(list_filter(['Edges', 'norm_input_exp'], lambda x: NOT list_contains(present, x)), ';') AS missing FROM got", "layers")(
    lambda spark, d: layers(spark, d).groupBy("tile_id").agg(F.array_join(audit.missing_fields(F.collect_set("layer"), ["Edges", "norm_input_exp"]), ";").alias("missing"))
)
REPORT = f"""WITH got AS (SELECT tile_id, list_sort(list_distinct(list(layer))) AS present, list_sort(list_distinct(list(srs_id) FILTER (srs_id IS NOT NULL))) AS systems FROM layers GROUP BY 1),
    r AS (SELECT tile_id, array_to_string(list_filter([{QUOTED}], lambda x: NOT list_contains(present, x)), ';') AS missing, array_to_string(list_filter(present, lambda x: NOT list_contains([{QUOTED}], x)), ';') AS extra,
                 coalesce(len(systems), 0) <= 1 AS crs_consistent, coalesce(len(systems) <= 1 AND systems[1] = 3338, false) AS crs_matches FROM got)
    SELECT *, crs_consistent AND crs_matches AND missing = '' AND extra = '' AS ok FROM r"""
query("audit_report", REPORT, "layers")(lambda spark, d: audit.layer_report(layers(spark, d), "tile_id", WANT, sample_srs=3338))
query("audit_crs_layers", """SELECT layer_id, CASE WHEN NOT opened THEN 'cannot be opened' WHEN srs_id IS NULL OR srs_id = 0 THEN 'no reference system' WHEN srs_id < 0 THEN 'reference system not understood'
    ELSE concat('EPSG:', srs_id, ' is not EPSG:3338') END AS problem FROM layers WHERE NOT opened OR srs_id IS NULL OR srs_id <> 3338""", "layers")(
    lambda spark, d: audit.crs_problems(layers(spark, d), 3338).select("layer_id", "problem")
)
query("audit_complete", "SELECT tile_id, count(*) FILTER (layer IS NOT NULL AND srs_id IS NOT NULL)::BIGINT AS n_set, count(*) FILTER (layer IS NOT NULL AND srs_id IS NOT NULL) >= 4 AS is_complete FROM layers GROUP BY 1", "layers")(
    lambda spark, d: audit.complete(layers(spark, d), ["tile_id"], ["layer", "srs_id"], 4)
)
query("agg_srs_mode", "WITH n AS (SELECT srs_id, count(*)::BIGINT AS n FROM layers WHERE srs_id IS NOT NULL GROUP BY 1) SELECT srs_id, n FROM n ORDER BY n DESC, srs_id LIMIT 1", "layers")(lambda spark, d: audit.common_srs(layers(spark, d)))


def repaired(mode):
    lacks = "srs_id IS NULL OR srs_id = 0" + (" OR srs_id <> 3338" if mode == "force" else "")
    sql = f"SELECT layer_id, CASE WHEN {lacks} THEN 3338 ELSE srs_id END AS srs_id, coalesce({lacks}, false) AS changed FROM layers"
    return sql, lambda spark, d: audit.repair_crs(layers(spark, d), 3338, mode).select("layer_id", "srs_id", "changed")


query("snk_crs_update", repaired("fill")[0], "layers")(repaired("fill")[1])
query("crs_repair", repaired("force")[0], "layers")(repaired("force")[1])

# --- packages -----------------------------------------------------------------------------------------


def packages(spark, d):
    """One package per region in memory: its nations as points, and a row of statistics."""

    @F.pandas_udf("binary")
    def point(k: pd.Series) -> pd.Series:
        return k.map(lambda x: geometry.encode(geometry.POINT, [float(x), float(x) / 2]))

    nation = table(spark, d, "nation").select(
        F.col("n_regionkey").alias("region"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit("_TCN.gpkg")).alias("name"),
        F.col("n_nationkey").cast("long").alias("node_id"), F.col("n_name").alias("label"), point("n_nationkey").alias("geom"),
    )
    stats = nation.groupBy("region").agg(F.count("*").alias("num_nodes"), F.sum(F.col("node_id") * 0.5).alias("total_length_m"))
    made = gpkg.packed({"Nodes": nation, "global_stats": stats}, "region")
    return made.select(F.concat(F.lit("/p/"), "name").alias("path"), "content")


AT = "concat('/p/r', n_regionkey, '_TCN.gpkg')"
query("src_gpkg_contents", f"SELECT DISTINCT {AT} AS path, layer, data_type, 3338::BIGINT AS srs_id FROM nation, (VALUES ('Nodes', 'features'), ('global_stats', 'attributes')) v(layer, data_type)")(
    lambda spark, d: gpkg.layers(packages(spark, d)).where(F.col("data_type").isin("features", "attributes")).drop("error")
)
query("src_gpkg_layers", f"SELECT DISTINCT {AT} AS path, 'Nodes;global_stats' AS layers FROM nation")(
    lambda spark, d: gpkg.layers(packages(spark, d)).groupBy("path").agg(names.join_list(F.collect_list("layer")).alias("layers"))
)
query("src_gpkg_srs", f"SELECT DISTINCT {AT} AS path, srs_id, label FROM nation, (VALUES (-1::BIGINT, 'SRS_ID:-1'), (0, 'SRS_ID:0'), (3338, 'EPSG:3338'), (4326, 'EPSG:4326')) v(srs_id, label)")(
    lambda spark, d: gpkg.reference_systems(packages(spark, d)).select("path", "srs_id", names.srs_label(F.col("organization"), F.col("code"), F.col("srs_id")).alias("label"))
)
STATS_ROW = f"SELECT {AT} AS path, count(*)::BIGINT AS num_nodes, sum(n_nationkey * 0.5::DOUBLE) AS total_length_m FROM nation GROUP BY 1"
for _name in ("src_stats_row", "snk_sqlite_table"):
    query(_name, STATS_ROW)(lambda spark, d: gpkg.read_table(packages(spark, d), "global_stats", "num_nodes long, total_length_m double"))
LAYER = f"SELECT {AT} AS path, n_nationkey::BIGINT AS node_id, n_name AS label, 1 AS kind FROM nation"
for _name in ("src_vector_file", "snk_layer_replace", "snk_subtile_pkg"):
    query(_name, LAYER)(
        lambda spark, d: gpkg.read_table(packages(spark, d), "Nodes", "node_id long, label string, geom binary").select("path", "node_id", "label", geometry.wkb_type(F.col("geom")).cast("int").alias("kind"))
    )
query("audit_gpkg_valid", f"SELECT DISTINCT {AT} AS path, true AS valid FROM nation UNION ALL SELECT '/p/broken.gpkg', false")(
    lambda spark, d: gpkg.is_valid(packages(spark, d).unionByName(spark.createDataFrame([("/p/broken.gpkg", bytearray(b"not a database"))], "path string, content binary"))).select("path", "valid")
)


@query("snk_layer_append", f"SELECT {AT} AS path, n_nationkey::BIGINT AS node_id FROM nation UNION ALL SELECT {AT}, n_nationkey + 100 FROM nation")
def _(spark, d):
    def more(frames):
        for pdf in frames:
            out = []
            for content in pdf["content"]:
                p = gpkg.Package(bytes(content))
                rows = pd.read_sql_query('SELECT node_id + 100 AS node_id, label || "+" AS label FROM "Nodes"', p.con)
                p.write("Nodes", rows, {"node_id": "bigint", "label": "string"}, mode="append")
                out.append(p.content())
            yield pdf.assign(content=out)

    grown = packages(spark, d).mapInPandas(more, "path string, content binary")
    return gpkg.read_table(grown, "Nodes", "node_id long").select("path", "node_id")


# --- rasters --------------------------------------------------------------------------------------------


def rasters(spark, d, name="px", shape=None):
    made = geotiff.written(view(spark, d, name).withColumn("v", F.lit(1)), "tile_id", (0.5, 0, 100, 0, -0.5, 900), 3338, shape)
    return made.select(F.concat(F.lit("/m/"), "name").alias("path"), "content")


query("src_tiff_full", "SELECT concat('/m/', tile_id, '_mask.tif') AS path, r, c, 1.0::DOUBLE AS v FROM px", "px")(lambda spark, d: geotiff.pixels(rasters(spark, d)).drop("band"))
query("src_tiff_meta", "SELECT concat('/m/', tile_id, '_mask.tif') AS path, (max(r) + 1)::INTEGER AS height, (max(c) + 1)::INTEGER AS width, 3338 AS epsg, 100.0::DOUBLE AS minx, 900.0 - (max(r) + 1) * 0.5::DOUBLE AS miny, 100.0 + (max(c) + 1) * 0.5::DOUBLE AS maxx, 900.0::DOUBLE AS maxy FROM px GROUP BY tile_id", "px")(
    lambda spark, d: geotiff.metadata(rasters(spark, d)).select("path", "height", "width", "epsg", "minx", "miny", "maxx", "maxy")
)
# Cells three times as wide: each takes the pixel in its middle.
query("src_tiff_warp", "SELECT concat('/m/', tile_id, '_mask.tif') AS path, r // 3 AS r, c // 3 AS c, 1.0::DOUBLE AS v FROM px WHERE r % 3 = 1 AND c % 3 = 1", "px")(
    lambda spark, d: geotiff.warped(rasters(spark, d), 3338, 1.5).select("path", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "v")
)
query("src_tiff_bands_resampled", "SELECT concat('/m/', tile_id, '_mask.tif') AS path, 1 AS band, r // 2 AS r, c // 2 AS c, count(*) / 4.0::DOUBLE AS v FROM px32 GROUP BY tile_id, r // 2, c // 2", "px32")(
    lambda spark, d: geotiff.bands_resampled(rasters(spark, d, "px32", (32, 32)), 0.5, bands=(1,))
)


@query("snk_masks_and_vector", "SELECT tile_id, count(*)::BIGINT AS n_pixels, count(*) * 0.25::DOUBLE AS area FROM px GROUP BY 1", "px")
def _(spark, d):
    """A mask written as raster and, read back from it, as polygons, and both read back."""
    from ..operators.polygons import polygonize

    seen = geotiff.pixels(rasters(spark, d)).select(F.regexp_extract("path", r"(\d+)_mask", 1).cast("long").alias("tile_id"), "r", "c")
    vector = polygonize(seen, ["tile_id"], transform=(0.5, 0, 100, 0, -0.5, 900))
    area = vector.groupBy("tile_id").agg(F.sum(geometry.polygon_area(F.col("geom"))).alias("area"))
    raster = geotiff.pixels(rasters(spark, d)).groupBy(F.regexp_extract("path", r"(\d+)_mask", 1).cast("long").alias("tile_id")).agg(F.count("*").alias("n_pixels"))
    return raster.join(area, "tile_id").select("tile_id", "n_pixels", "area")


# --- polygons -------------------------------------------------------------------------------------------


def collections(spark, d):
    """One GeoJSON text per ten cutlines."""
    box = geometry.box_ring(*[F.col(c) for c in ("minx", "miny", "maxx", "maxy")])
    ring = F.concat(F.lit("["), F.array_join(F.transform(box, lambda p: F.concat(F.lit("["), p["x"].cast("string"), F.lit(","), p["y"].cast("string"), F.lit("]"))), ","), F.lit("]"))
    feature = F.concat(F.lit('{"type":"Feature","properties":{},"geometry":{"type":"Polygon","coordinates":['), ring, F.lit("]}}"))
    rows = view(spark, d, "cuts").groupBy(F.floor(F.col("cut_id") / 10).alias("k")).agg(F.array_join(F.sort_array(F.collect_list(feature)), ",").alias("f"))
    text = F.concat(F.lit('{"type":"FeatureCollection","crs":{"properties":{"name":"EPSG:3338"}},"features":['), "f", F.lit("]}"))
    return rows.select(F.concat(F.lit("/w/"), F.col("k").cast("string"), F.lit(".geojson")).alias("path"), F.encode(text, "UTF-8").alias("content"))


POLYGONS = "SELECT concat('/w/', cut_id // 10, '.geojson') AS path, 'EPSG:3338' AS crs, count(*)::BIGINT AS n, sum((maxx - minx) * (maxy - miny)) AS area FROM cuts GROUP BY 1"


def polygons(spark, d):
    shapes = geojson.read_polygons(collections(spark, d))
    rings = geojson.rings(geojson.flattened(shapes))
    return rings.groupBy("path", "crs").agg(F.count("*").alias("n"), F.sum(geometry.ring_area(F.col("points"))).alias("area"))


query("src_geojson", POLYGONS, "cuts")(polygons)
query("src_ogr_polygons", POLYGONS, "cuts")(polygons)


@query("ocean_load", "SELECT concat('/w/', cut_id // 10, '.geojson') AS path, count(*)::BIGINT AS n, sum((maxx - minx - 20) * (maxy - miny - 20)) AS area FROM cuts GROUP BY 1", "cuts")
def _(spark, d):
    """Water polygons read, repaired, and kept 10 from their border, as WKB of each."""
    shapes = geojson.flattened(geojson.read_polygons(collections(spark, d))).select("path", overlay.buffer_in(overlay.make_valid(F.col("geom")), 10.0).alias("geom"))
    return shapes.groupBy("path").agg(F.count("geom").alias("n"), F.round(F.sum(geometry.polygon_area(F.col("geom"))), 3).alias("area"))


@query("src_shp_tiles", "SELECT concat('sub', cut_id) AS tilename, (maxx - minx) * (maxy - miny) AS area FROM cuts", "cuts")
def _(spark, d):
    """Footprints of subtiles from shapefiles, by their names in lower case."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        rings = [[[(r.minx, r.miny), (r.minx, r.maxy), (r.maxx, r.maxy), (r.maxx, r.miny), (r.minx, r.miny)]] for r in frame.itertuples()]
        shp, dbf = shapefile.write(rings, [{"TILENAME": f" Sub{r.cut_id}"} for r in frame.itertuples()])
        stem = f"/t/Mosaic_{frame['k'].iloc[0]}_tiles"
        return pd.DataFrame({"path": [f"{stem}.shp", f"{stem}.dbf"], "content": [shp, dbf]})

    cuts = view(spark, d, "cuts").drop("acqdate").withColumn("k", F.floor(F.col("cut_id") / 50))
    got = shapefile.read(cuts.groupBy("k").applyInPandas(build, "path string, content binary")).where(geometry.is_polygonal(F.col("geom")))
    rings = geojson.rings(got.select(names.norm_key(F.col("attributes")["TILENAME"]).alias("tilename"), "geom"))
    return rings.select("tilename", geometry.ring_area(F.col("points")).alias("area"))


# --- lists and reports ------------------------------------------------------------------------------------


def report(spark, d):
    ok = F.when(F.col("sub") % 3 == 0, "True").when(F.col("sub") % 3 == 1, "no").otherwise(F.lit(None))
    return expected(spark, d).select("sub", F.concat(F.lit("/p/"), names.expected_package(F.col("name"))).alias("gpkg_path"), ok.alias("ok"))


@query("src_csv_report", f"SELECT CAST(sub AS VARCHAR) AS sub, concat('/p/', {BARE}, '_TCN.gpkg') AS gpkg_path FROM expected WHERE sub % 3 <> 0", "expected")
def _(spark, d):
    path = shared_folder(spark, "report")
    files.write_csv(report(spark, d), path)
    return files.bad_rows(spark, path).select("sub", "gpkg_path")


@query("snk_csv", f"SELECT CAST(sub AS VARCHAR) AS sub, concat('/p/', {BARE}, '_TCN.gpkg') AS gpkg_path, CASE sub % 3 WHEN 0 THEN 'True' WHEN 1 THEN 'no' END AS ok FROM expected", "expected")
def _(spark, d):
    path = shared_folder(spark, "report")
    files.write_csv(report(spark, d), path)
    return spark.read.option("header", "true").csv(path)


@query("src_list_file", "SELECT DISTINCT name AS path FROM expected", "expected")
def listed(spark, d):
    path = shared_folder(spark, "list")
    rows = expected(spark, d).select(F.concat(F.lit("  "), "name", F.lit(" ")).alias("path"))
    files.write_list(rows.unionByName(rows.limit(3).select(F.lit(" ").alias("path"))), path)
    return files.list_file(spark, path).distinct()


query("snk_lists", "SELECT DISTINCT name AS path FROM expected", "expected")(listed)


@query("src_glob", "SELECT DISTINCT concat('tile_id=', tile_id) AS tile_id FROM expected", "expected")
def _(spark, d):
    path = shared_folder(spark, "glob")
    expected(spark, d).select("tile_id", "name").write.partitionBy("tile_id").text(path)
    found = files.listing(spark, path, "*.txt").where("length > 0")
    return files.tiles(found)
