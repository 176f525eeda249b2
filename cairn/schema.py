"""Schemas of the catalog's tables and of the records that scans and queries give."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


S, L, I, B, D, X = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.DoubleType(), T.BinaryType()

#: One row for each file; times are unix seconds, ``permissions`` the whole st_mode.
PATHS = _struct(path=S, cid=X, original_size=L, compressed_size=L, modified=L, created=L, permissions=I)
DIRS = _struct(path=S, child_count=L, modified=L)
CID_PATHS = _struct(cid_str=S, path=S)
BLOBS = _struct(cid_str=S, compressed_size=L)
#: What a walk of a tree sees. ``kind`` (dir, file, other, error) follows links, ``lstat_kind`` doesn't.
ENTRIES = _struct(rel=S, kind=S, lstat_kind=S, size=L, modified=L, created=L, mode=I, source=S, error=S)
LISTING = _struct(name=S, is_dir=B, size=L, modified=L)
SCAN_STATS = _struct(total_files=L, total_dirs=L, unique_blobs=L, duplicate_files=L, total_original_bytes=L, total_stored_bytes=L, skipped_files=L, unchanged_files=L, pruned_entries=L, errors_log_path=S)
EXTENSION_STATS = _struct(extension=S, total_files=L, duplicate_files=L, duplicate_pct=D, total_original_bytes=L, total_stored_bytes=L, bytes_saved=L)
RULE = _struct(pattern=S, action=S)
SCAN_ERRORS = _struct(ts=L, path=S, message=S)
WORKSPACE = _struct(id=S, label=S, tags=T.ArrayType(S), store_path=S, created_at=L, stats=_struct(total_files=L, total_dirs=L, unique_blobs=L, duplicate_files=L, total_original_bytes=L, total_stored_bytes=L, scans_count=L, last_scan_at=L))
CUSTOM_RULE = _struct(id=S, label=S, pattern=S, action=S, enabled=B)
