"""What a scan changes: unchanged files, merges, deletions and counts, as algebra over two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def compared(entries: DataFrame, paths: DataFrame, blobs: DataFrame) -> DataFrame:
    """``entries(path, size, modified, ...)`` with ``status``: new, modified or unchanged.

    Unchanged: the catalog has the path with the same size and modification second, and its content is stored.
    One shuffle on path, and one of the catalog's side on cid.
    """
    there = blobs.select(F.col("cid").alias("_ch_b")).distinct()
    known = paths.select(F.col("path").alias("_ch_p"), F.col("cid").alias("_ch_c"), F.col("original_size").alias("_ch_s"), F.col("modified").alias("_ch_m"))
    known = known.join(there, F.col("_ch_c") == F.col("_ch_b"), "left")
    out = entries.join(known, F.col("path") == F.col("_ch_p"), "left")
    same = (F.col("_ch_s") == F.col("size")) & (F.col("_ch_m") == F.col("modified")) & F.col("_ch_b").isNotNull()
    status = F.when(F.col("_ch_p").isNull(), "new").when(same, "unchanged").otherwise("modified")
    return out.withColumn("status", status).withColumn("known_cid", F.col("_ch_c")).drop("_ch_p", "_ch_c", "_ch_s", "_ch_m", "_ch_b")


def deleted(paths: DataFrame, seen: DataFrame, scope: str = "/") -> DataFrame:
    """Rows below ``scope`` whose path wasn't seen."""
    return paths.where(F.col("path").startswith(scope.rstrip("/") + "/")).join(seen.select("path").distinct(), "path", "left_anti")


def pruned(paths: DataFrame, seen: DataFrame, scope: str = "/") -> DataFrame:
    """``paths`` without what ``deleted`` finds."""
    return paths.join(deleted(paths, seen, scope).select("path"), "path", "left_anti")


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by path: rows of ``new`` replace those of ``old``."""
    return old.join(new.select("path").distinct(), "path", "left_anti").unionByName(new)


def last_writes(rows: DataFrame, order: str = "seq") -> DataFrame:
    """The last row of each path by ``order``."""
    last = Window.partitionBy("path").orderBy(F.desc(order))
    return rows.withColumn("_lw", F.row_number().over(last)).where("_lw = 1").drop("_lw")


def additive_index(old_index: DataFrame, new: DataFrame) -> DataFrame:
    """The history-keeping index: old pairs stay when a path gets new content."""
    return old_index.select("cid", "path").union(new.select("cid", "path")).distinct()


def new_blobs(candidates: DataFrame, blobs: DataFrame) -> DataFrame:
    """One row for each content that isn't stored yet."""
    return candidates.dropDuplicates(["cid"]).join(blobs.select("cid"), "cid", "left_anti")


def scan_stats(changed: DataFrame, unchanged: DataFrame, blobs: DataFrame, total_dirs, skipped=0, pruned_entries=0) -> DataFrame:
    """One row of a scan's counts. ``changed(cid, size, compressed_size)``, ``unchanged(size)``; the last three are numbers or one-row columns' DataFrames."""
    fresh = new_blobs(changed, blobs).agg(F.count(F.lit(1)).alias("unique_blobs"), F.coalesce(F.sum("compressed_size"), F.lit(0)).alias("total_stored_bytes"))
    c = changed.agg(F.count(F.lit(1)).alias("c"), F.coalesce(F.sum("size"), F.lit(0)).alias("cs"))
    u = unchanged.agg(F.count(F.lit(1)).alias("unchanged_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("us"))
    out = fresh.join(c).join(u)  # one row each
    for name, x in (("total_dirs", total_dirs), ("skipped_files", skipped), ("pruned_entries", pruned_entries)):
        out = out.join(x.agg(F.count(F.lit(1)).alias(name))) if isinstance(x, DataFrame) else out.withColumn(name, F.lit(x).cast("long"))
    return out.select(
        (F.col("c") + F.col("unchanged_files")).alias("total_files"),
        "total_dirs",
        "unique_blobs",
        (F.col("c") - F.col("unique_blobs")).alias("duplicate_files"),
        (F.col("cs") + F.col("us")).alias("total_original_bytes"),
        "total_stored_bytes",
        "skipped_files",
        "unchanged_files",
        "pruned_entries",
    )


def workspace_totals(history: DataFrame) -> DataFrame:
    """Scan history ``(workspace, files, duplicates, original, stored, scanned_at)`` summed by workspace."""
    return history.groupBy("workspace").agg(
        F.sum("files").alias("total_files"),
        F.sum("duplicates").alias("duplicate_files"),
        F.sum("original").alias("total_original_bytes"),
        F.sum("stored").alias("total_stored_bytes"),
        F.count(F.lit(1)).alias("scans_count"),
        F.max("scanned_at").alias("last_scan_at"),
    )


def all_workspaces(totals: DataFrame) -> DataFrame:
    """One row over all workspaces, with what was saved and its share."""
    s = totals.agg(*(F.sum(c).alias(c) for c in ("total_files", "duplicate_files", "total_original_bytes", "total_stored_bytes")))
    gain = F.greatest(F.col("total_original_bytes") - F.col("total_stored_bytes"), F.lit(0))
    return s.withColumn("bytes_saved", gain).withColumn("saved_pct", F.when(F.col("total_original_bytes") > 0, F.round(gain / F.col("total_original_bytes") * 100, 1)).otherwise(0.0))
