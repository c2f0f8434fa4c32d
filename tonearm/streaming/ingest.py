"""Incremental ingest as a stream: an extension, as the batch operators define the semantics.

New listings arrive as Parquet files; each micro-batch is merged into the table by path with the same upsert as a scan, as a
new version of the table (``read_table`` reads the one in force).  Versions are kept by key and number, so a batch that is run again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tonearm.operators.identity import latest, upsert
from tonearm.sources.files import read_table, replace_table


def ingest(spark: SparkSession, source: str, schema: StructType, table: str, checkpoint: str, keys: list[str], version: str, on_batch: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Start a query that keeps ``table`` the latest version of each key of the files under ``source``; it ends when all there is has been read."""

    def merge(batch: DataFrame, number: int) -> None:
        new = latest(batch, keys, version)
        old = read_table(spark, table, schema)
        old = new.limit(0) if old is None else old  # no table yet; any other trouble ends the batch
        kept = old.join(new.select(*keys, new[version].alias("_v")), keys, "left").where(f"_v is null or {version} > _v").drop("_v")
        fresh = new.join(kept.select(*keys), keys, "left_anti")
        replace_table(upsert(kept, fresh, keys), table)
        if on_batch:
            on_batch(fresh, number)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
