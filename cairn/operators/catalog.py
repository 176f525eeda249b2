"""Queries of a catalog: listings, lookups, duplicates and statistics, all DataFrame to DataFrame.

``paths(path, cid, original_size, compressed_size, modified, created, permissions)``, ``dirs(path, child_count,
modified)`` and ``cid_paths(cid, path)`` may come from a snapshot, a scan or any table with such columns.
``cid`` may be bytes or text: only its equality counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import expr

#: A directory's name resolves to a file first, then to what deeper paths imply, then to its own row.
FILE, IMPLIED, OWN = 0, 1, 2


def index_of(paths: DataFrame) -> DataFrame:
    """The inverted index, derived from ``paths``."""
    return paths.select("cid", "path")


def under(paths: DataFrame, prefix: str) -> DataFrame:
    """Rows whose path starts with ``prefix``; pushed down to Parquet."""
    return paths.where(F.col("path").startswith(prefix))


def get_file(paths: DataFrame, path: str) -> DataFrame:
    return paths.where(F.col("path") == path)


def parent_dirs(paths: DataFrame) -> DataFrame:
    """A row for every directory that paths imply, with modified 0."""
    return paths.select(F.explode(expr.parents(F.col("path"))).alias("path")).distinct().select("path", F.lit(0).cast("long").alias("child_count"), F.lit(0).cast("long").alias("modified"))


def list_dir(paths: DataFrame, dirs: DataFrame, path: str) -> DataFrame:
    """name, is_dir, size, modified of a directory's children: directories first, then by name."""
    prefix = path.rstrip("/") + "/"
    rest = F.substring(F.col("path"), len(prefix) + 1, 1 << 30)
    nested = F.contains(rest, F.lit("/"))
    files = under(paths, prefix).where(rest != "").select(
        F.substring_index(rest, "/", 1).alias("name"),
        nested.alias("is_dir"),
        F.when(nested, F.lit(0)).otherwise(F.col("original_size")).cast("long").alias("size"),
        F.when(nested, F.lit(0)).otherwise(F.col("modified")).cast("long").alias("modified"),
        F.when(nested, IMPLIED).otherwise(FILE).alias("rank"),
    )
    # a deep tree gives one row for each name before the shuffle
    files = files.groupBy("name", "rank").agg(F.first("is_dir").alias("is_dir"), F.max("size").alias("size"), F.max("modified").alias("modified"))
    own = under(dirs, prefix).where(rest != "").select(
        F.substring_index(rest, "/", 1).alias("name"),
        F.when(nested, IMPLIED).otherwise(OWN).alias("rank"),
        F.when(nested, F.lit(0)).otherwise(F.col("modified")).cast("long").alias("modified"),
    )
    own = own.where(F.col("rank") == OWN).select("name", "rank", F.lit(True).alias("is_dir"), F.lit(0).cast("long").alias("size"), "modified")
    best = Window.partitionBy("name").orderBy("rank")
    found = files.unionByName(own).withColumn("n", F.row_number().over(best)).where("n = 1")
    return found.select("name", "is_dir", "size", "modified").orderBy(F.desc("is_dir"), "name")


def tree(paths: DataFrame, dirs: DataFrame, path: str = "/") -> DataFrame:
    """Every entry below ``path`` with its depth: the listing of all levels in one pass."""
    prefix = path.rstrip("/") + "/"
    base = prefix.count("/")
    files = under(paths, prefix).select("path", F.lit(False).alias("is_dir"))
    folders = under(parent_dirs(paths).select("path").union(dirs.select("path")), prefix).distinct().select("path", F.lit(True).alias("is_dir"))
    depth = F.char_length("path") - F.char_length(F.replace(F.col("path"), F.lit("/"), F.lit(""))) - base + 1
    return files.unionByName(folders).where(F.col("path") != prefix).select("path", "is_dir", depth.cast("int").alias("depth"))


def duplicates_of_cid(cid_paths: DataFrame, cid) -> DataFrame:
    return cid_paths.where(F.col("cid") == F.lit(cid)).select("path").distinct().orderBy("path")


def duplicates_of_path(paths: DataFrame, path: str, cid_paths: DataFrame | None = None) -> DataFrame:
    """All paths with the same content, ``path`` among them; an unknown path is an error."""
    row = get_file(paths, path).select("cid").first()
    if row is None:
        raise FileNotFoundError(f"file not found: {path}")
    return duplicates_of_cid(index_of(paths) if cid_paths is None else cid_paths, row[0])


def group_sizes(cid_paths: DataFrame) -> DataFrame:
    return cid_paths.groupBy("cid").agg(F.count(F.lit(1)).alias("n"))


def duplicate_groups(cid_paths: DataFrame) -> DataFrame:
    """cid, paths (sorted) of every content at more than one path, by cid. A group's paths are one row, as the result asks."""
    groups = cid_paths.groupBy("cid").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    return groups.where(F.size("paths") > 1).orderBy("cid")


def duplicate_members(cid_paths: DataFrame) -> DataFrame:
    """cid, path of every file whose content is at more than one path: the groups without gathering any in one row."""
    many = group_sizes(cid_paths).where("n > 1").select("cid")
    return cid_paths.join(many, "cid", "left_semi").select("cid", "path")


def flagged(paths: DataFrame, cid_paths: DataFrame | None = None) -> DataFrame:
    """``paths`` with ``dup``: whether its content is at more than one path."""
    many = group_sizes(index_of(paths) if cid_paths is None else cid_paths).where("n > 1").select("cid", F.lit(True).alias("dup"))
    return paths.join(many, "cid", "left").withColumn("dup", F.coalesce("dup", F.lit(False)))


def extension_stats(paths: DataFrame, cid_paths: DataFrame | None = None) -> DataFrame:
    """Files, duplicates and bytes by extension, the largest saving first."""
    rows = flagged(paths, cid_paths).withColumn("ext", expr.extension(F.col("path")))
    sums = rows.groupBy("ext").agg(
        F.count(F.lit(1)).alias("total_files"),
        F.sum(F.col("dup").cast("long")).alias("duplicate_files"),
        F.sum("original_size").alias("total_original_bytes"),
        F.sum("compressed_size").alias("total_stored_bytes"),
    )
    return sums.select(
        F.when(F.col("ext") == "", "(no ext)").otherwise(F.col("ext")).alias("extension"),
        "total_files",
        "duplicate_files",
        expr.percent(F.col("duplicate_files"), F.col("total_files")).alias("duplicate_pct"),
        "total_original_bytes",
        "total_stored_bytes",
        expr.saved(F.col("total_original_bytes"), F.col("total_stored_bytes")).alias("bytes_saved"),
    ).orderBy(F.desc("bytes_saved"), "extension")


def top_extensions(stats: DataFrame, by: str, least_files: int = 1) -> DataFrame:
    """``stats`` with a rank number: by ``bytes_saved``, ``duplicate_pct``, ``duplicate_files`` or ``total_files``. One row for each extension."""
    order = Window.orderBy(F.desc(by), "extension")
    return stats.where(F.col("total_files") >= least_files).withColumn("rank", F.row_number().over(order).cast("long"))


def extension_totals(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.sum("bytes_saved").alias("bytes_saved"),
        F.sum("duplicate_files").alias("duplicate_files"),
        F.sum("total_files").alias("total_files"),
        F.max("bytes_saved").alias("max_bytes_saved"),
        F.max("duplicate_files").alias("max_duplicate_files"),
        F.max("total_files").alias("max_total_files"),
    )


def store_stats(paths: DataFrame, dirs: DataFrame, cid_paths: DataFrame | None = None) -> DataFrame:
    """One row of totals. ``total_stored_bytes`` counts every path; ``unique_stored_bytes`` each content once."""
    files = paths.agg(F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum("original_size"), F.lit(0)).alias("total_original_bytes"), F.coalesce(F.sum("compressed_size"), F.lit(0)).alias("total_stored_bytes"))
    folders = dirs.agg(F.count(F.lit(1)).alias("total_dirs"))
    sizes = group_sizes(index_of(paths) if cid_paths is None else cid_paths)
    groups = sizes.agg(F.count(F.lit(1)).alias("unique_blobs"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_files"))
    once = paths.groupBy("cid").agg(F.max("compressed_size").alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("unique_stored_bytes"))
    # each side is one row
    return files.join(folders).join(groups).join(once).select("total_files", "total_dirs", "unique_blobs", "duplicate_files", "total_original_bytes", "total_stored_bytes", "unique_stored_bytes")


def file_info(paths: DataFrame, path: str) -> DataFrame:
    """What's shown of one file, with a row for each path of its content and a mark at its own."""
    one = get_file(paths, path).select("cid", "original_size", "compressed_size", "modified", "permissions")
    same = paths.select(F.col("cid").alias("cid2"), F.col("path").alias("duplicate"))
    return one.join(same, F.col("cid") == F.col("cid2")).select(
        F.lit(path).alias("path"),
        "cid",
        expr.format_size(F.col("original_size")).alias("size"),
        expr.format_size(F.col("compressed_size")).alias("stored"),
        expr.compression_ratio(F.col("original_size"), F.col("compressed_size")).alias("ratio"),
        expr.shown_time(F.col("modified")).alias("modified"),
        expr.octal(F.col("permissions")).alias("mode"),
        "duplicate",
        (F.col("duplicate") == path).alias("this_file"),
    )
