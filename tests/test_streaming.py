from rillgrid.streaming.ingest import stats_stream


def test_each_file_is_taken_once(spark, tmp_path):
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "tile_id long, r long, c long"
    for k in range(2):
        spark.createDataFrame([(k, 0, c) for c in range(5)] + [(k, 9, 9)], schema).coalesce(1).write.mode("append").parquet(source)
        for _ in range(2):
            stats_stream(spark, source, schema, sink, state).awaitTermination()
        rows = spark.read.parquet(sink).collect()
        assert sorted((r["tile_id"], r["num_nodes"], r["num_endnodes"]) for r in rows) == [(t, 5, 2) for t in range(k + 1)]
