"""A table whose rows carry a path and a payload, seen as a catalog: no file is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import expr

FILE_MODE = 0o100644


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def document_paths(docs: DataFrame) -> DataFrame:
    """One virtual file for each document: ``/source/lang/id.lang``, its text as content, SHA-256 as identity.

    ``compressed_size`` is the number of characters, a stand-in that SQL can express as well.
    """
    folder = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"))
    return docs.select(
        F.concat(folder, F.col("doc_id").cast("string"), F.lit("."), "lang").alias("path"),
        expr.content_cid(F.col("text")).alias("cid"),
        F.octet_length("text").cast("long").alias("original_size"),
        F.col("n_chars").cast("long").alias("compressed_size"),
        (F.lit(1_700_000_000) + F.col("doc_id")).alias("modified"),
        F.lit(0).cast("long").alias("created"),
        F.lit(FILE_MODE).cast("int").alias("permissions"),
    )


def entries_of(paths: DataFrame, dirs: DataFrame) -> DataFrame:
    """What a walk of the virtual tree would see: rel, kind."""
    return paths.select(F.substring("path", 2, 1 << 30).alias("rel"), F.lit("file").alias("kind")).unionByName(dirs.select(F.substring("path", 2, 1 << 30).alias("rel"), F.lit("dir").alias("kind")))
