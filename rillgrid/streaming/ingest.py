"""Restartable ingestion: new files of pixels become statistics, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.graph import component_counts, not_isolated


def stats_stream(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, keys: tuple[str, ...] = ("tile_id",)) -> StreamingQuery:
    """Read what is new in ``source`` (Parquet pixels), write component statistics, and end.

    Each micro-batch overwrites a folder of its own number, so a batch that runs again
    after a failure leaves one copy; the checkpoint remembers which files are done. A
    mask's pixels must arrive in one file; later files of a mask are masks of their own.
    """

    def write(batch: DataFrame, number: int) -> None:
        not_isolated(component_counts(batch, list(keys))).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return (
        spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
