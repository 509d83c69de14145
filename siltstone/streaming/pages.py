"""Pages as a stream: parsed as they arrive, the latest of each kept in a versioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.sources.html_pages import parse_pages
from siltstone.storage_tables import Table


def page_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """New Parquet files of a folder as a stream of parsed pages."""
    return parse_pages(spark.readStream.schema(schema).parquet(folder))


def keep_latest(stream: DataFrame, table: Table, keys: list[str], order: str, checkpoint: str):
    """Upsert every micro-batch; a batch that is run again writes the same rows."""

    def put(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            table.upsert(batch, keys, order)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
