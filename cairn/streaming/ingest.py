"""Incremental ingest of a growing folder of Parquet files (path, content, modified) into a catalog table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.functions import expr
from cairn.operators import changes

INPUT = "path string, content binary, modified long"


def catalog_rows(batch: DataFrame) -> DataFrame:
    """The last version of each path in the batch, with its identity and size."""
    last = changes.last_writes(batch, "modified")
    return last.select("path", expr.content_cid(F.col("content")).alias("cid"), F.octet_length("content").cast("long").alias("original_size"), "modified")


def ingest(spark: SparkSession, source: str, load: Callable[[], DataFrame], save: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start a stream that merges each micro-batch into what ``load`` gives and hands it to ``save`` with the batch's number.

    ``save`` must replace the batch's own earlier output, as a batch runs again after a failure. Stop the query or wait for it.
    """

    def merge(batch: DataFrame, number: int) -> None:
        new = catalog_rows(batch)
        old = load()
        newer = old.join(new.select("path", F.col("modified").alias("_in_m")), "path", "left").where("_in_m is not null and modified > _in_m").select("path")
        save(changes.merged(old, new.join(newer, "path", "left_anti")), number)

    stream = spark.readStream.schema(INPUT).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
