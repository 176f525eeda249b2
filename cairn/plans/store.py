"""The store: blobs, catalog snapshots, and scans that bring them up to date.

Layout under the root, on a file system that driver and executors share: ``blobs/<cid>.lz4``;
``catalog/v=N/{paths,dirs,cid_paths}`` in Parquet, ``paths`` sorted by path so that prefixes prune; and ``CURRENT``,
which names the snapshot in force and is replaced atomically. A scan that fails or is cancelled leaves
the catalog as it was.
"""

from __future__ import annotations

import os
import shutil
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import schema
from cairn.functions import expr
from cairn.functions.blake3 import digests
from cairn.functions.content import BlobStore, Cancelled, cid_bytes, directory_archive
from cairn.operators import catalog, changes, rules
from cairn.shipping import ship
from cairn.sources.fswalk import walk

STORED = "rel string, virtual string, cid binary, original_size long, compressed_size long, modified long, created long, permissions int, status string, archived boolean, error string"


@dataclass
class ScanOptions:
    bundle_git_dirs: bool = False
    rules: list = field(default_factory=list)
    prune_deleted: bool = False
    parallelism: int | None = None
    #: ``derived``: the inverted index follows the paths. ``additive``: old pairs stay when a path gets new content.
    index_mode: str = "derived"


def normal_prefix(target: str) -> str:
    """'' for the root; else a leading slash and none at the end. Nothing but slashes is the root too."""
    inner = target.strip().rstrip("/").lstrip("/")
    return f"/{inner}" if inner else ""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        ship(spark)
        self.spark, self.root = spark, os.path.abspath(root)
        self.blobs = BlobStore(os.path.join(self.root, "blobs"))
        os.makedirs(self.blobs.root, exist_ok=True)
        if not os.path.exists(self._current):
            self._publish(self._empty(schema.PATHS), self._empty(schema.DIRS), self._empty(schema.CID_PATHS))

    # snapshots ------------------------------------------------------------------------------------------------

    @property
    def _current(self) -> str:
        return os.path.join(self.root, "CURRENT")

    def _empty(self, kind) -> DataFrame:
        return self.spark.createDataFrame([], kind)

    def _version(self) -> int:
        with open(self._current) as f:
            return int(f.read())

    def _table(self, name: str, kind) -> DataFrame:
        return self.spark.read.schema(kind).parquet(os.path.join(self.root, "catalog", f"v={self._version()}", name))

    def paths(self) -> DataFrame:
        return self._table("paths", schema.PATHS)

    def dirs(self) -> DataFrame:
        return self._table("dirs", schema.DIRS)

    def cid_paths(self) -> DataFrame:
        return self._table("cid_paths", schema.CID_PATHS)

    def _index(self) -> DataFrame:
        return self.cid_paths().select(F.col("cid_str").alias("cid"), "path")

    def _shown(self) -> DataFrame:
        return self.paths().withColumn("cid", expr.cid_bytes_to_string(F.col("cid")))

    def _publish(self, paths: DataFrame, dirs: DataFrame, index: DataFrame) -> None:
        version = self._version() + 1 if os.path.exists(self._current) else 0
        at = os.path.join(self.root, "catalog", f"v={version}")
        shutil.rmtree(at, ignore_errors=True)  # what an interrupted scan has left
        paths.repartitionByRange("path").sortWithinPartitions("path").write.parquet(os.path.join(at, "paths"))
        dirs.repartitionByRange("path").sortWithinPartitions("path").write.parquet(os.path.join(at, "dirs"))
        index.repartitionByRange("cid_str").sortWithinPartitions("cid_str", "path").write.parquet(os.path.join(at, "cid_paths"))
        own = f"{self._current}.{uuid.uuid4().hex}"
        with open(own, "w") as f:
            f.write(str(version))
        os.replace(own, self._current)

    # queries --------------------------------------------------------------------------------------------------

    def list_dir(self, path: str) -> DataFrame:
        return catalog.list_dir(self.paths(), self.dirs(), path)

    def get_file(self, path: str) -> DataFrame:
        return catalog.get_file(self._shown(), path)

    def read_file(self, path: str) -> bytes:
        row = catalog.get_file(self.paths(), path).select("cid").first()
        if row is None:
            raise FileNotFoundError(f"file not found: {path}")
        return self.blobs.read(bytes(row[0]))

    def find_duplicates(self, path: str) -> list[str]:
        return [r[0] for r in catalog.duplicates_of_path(self._shown(), path, self._index()).collect()]

    def find_all_duplicates(self) -> DataFrame:
        return catalog.duplicate_groups(self._index())

    def extension_stats(self) -> DataFrame:
        return catalog.extension_stats(self._shown(), self._index())

    def compute_stats(self) -> DataFrame:
        return catalog.store_stats(self._shown(), self.dirs(), self._index())

    def file_info(self, path: str) -> DataFrame:
        return catalog.file_info(self._shown(), path)

    def tree(self, path: str = "/") -> DataFrame:
        return catalog.tree(self.paths(), self.dirs(), path)

    # single writes --------------------------------------------------------------------------------------------

    def insert(self, paths: DataFrame | None = None, dirs: DataFrame | None = None, additive: bool = False) -> None:
        """Upsert rows; the last row of a path wins within the old and the new."""
        was, folders = self.paths(), self.dirs()
        now = changes.merged(was, paths) if paths is not None else was
        self._publish(now, changes.merged(folders, dirs) if dirs is not None else folders, self._new_index(now, paths, additive))

    def _new_index(self, now: DataFrame, new: DataFrame | None, additive: bool, gone: DataFrame | None = None) -> DataFrame:
        shown = lambda df: df.select(expr.cid_bytes_to_string(F.col("cid")).alias("cid_str"), "path")
        if not additive:
            return shown(now)
        index = self.cid_paths() if new is None else self.cid_paths().union(shown(new)).distinct()
        return index if gone is None else index.join(shown(gone), ["cid_str", "path"], "left_anti")

    # scans ----------------------------------------------------------------------------------------------------

    def scan(self, source: str, target: str = "/", options: ScanOptions | None = None, on_progress: Callable[[dict], None] | None = None, should_cancel: Callable[[], bool] | None = None) -> dict:
        """Bring the tree at ``source`` into the catalog under ``target``; the counts of what was done.

        ``on_progress`` is told of each step; ``should_cancel`` is asked every 50 ms and ends the running jobs.
        """
        if not os.path.isdir(source):
            raise FileNotFoundError(f"no such directory: {source}")
        options = options or ScanOptions()
        chosen = rules.ordered(options.rules, options.bundle_git_dirs)
        rules.compiled(chosen)  # an invalid rule fails before anything is stored
        tell = on_progress or (lambda event: None)
        with _Watch(self.spark, should_cancel) as watch:
            return self._scan(os.path.realpath(source), normal_prefix(target), options, chosen, tell, watch)

    def _scan(self, source: str, prefix: str, options: ScanOptions, chosen: list, tell: Callable, watch: _Watch) -> dict:
        work = os.path.join(self.root, f".scan-{uuid.uuid4().hex}")
        try:
            tasks = max(1, options.parallelism) if options.parallelism is not None else self.spark.sparkContext.defaultParallelism
            plain = all(not set("\\pdswbPDSWB") & set(x[1:2]) for r in chosen for x in r.pattern.split("\\")[1:])
            skip = [(r.pattern, r.action) for r in chosen] if plain else []  # a hint to the walk; ``decided`` has the last word
            tell({"step": "walk"})
            seen = rules.decided(walk(self.spark, source, tasks, skip), chosen).withColumn("virtual", expr.virtual_path(prefix, F.col("rel")))
            seen = self._kept(seen, work, "entries", watch)
            known, before = self.paths(), self._blob_cids(work, watch)
            files = seen.where("decision = 'plain' and kind = 'file'").select(F.col("virtual").alias("path"), "rel", "size", "modified", "created", "mode", "source")
            compared = changes.compared(files, known, before).select("rel", F.col("path").alias("virtual"), "size", "modified", "created", "mode", "source", "status")
            todo = compared.where("status <> 'unchanged'").select("rel", "virtual", "modified", "created", F.col("mode").cast("int").alias("mode"), "source", "status", F.lit(False).alias("archived"))
            tarred = seen.where("decision = 'archive'").select("rel", F.concat("virtual", F.lit(".tar")).alias("virtual"), "modified", "created", F.lit(0o644).alias("mode"), "source", F.lit("new").alias("status"), F.lit(True).alias("archived"))
            tell({"step": "store"})
            done = self._kept(todo.union(tarred).repartition(tasks).mapInArrow(_storing(self.blobs.root), STORED), work, "stored", watch)
            stored = done.where("error is null")
            unchanged = compared.where("status = 'unchanged'")

            new = stored.select(F.col("virtual").alias("path"), "cid", "original_size", "compressed_size", "modified", "created", "permissions")
            folders = seen.where("decision = 'plain' and kind = 'dir' and virtual is not null").select(F.col("virtual").alias("path"), F.lit(0).cast("long").alias("child_count"), "modified")
            above = [prefix[:k] for k, c in enumerate(prefix) if c == "/" and k] + [prefix] * bool(prefix)
            ups = self.spark.createDataFrame([(p, 0, 0) for p in above], schema.DIRS)
            now = changes.merged(known, new)
            dirs = changes.merged(changes.merged(self.dirs(), ups), folders)
            additive = options.index_mode == "additive"
            if not additive:  # a path is either a file or a directory now
                now = now.join(folders.select("path"), "path", "left_anti")
                dirs = dirs.join(new.select("path"), "path", "left_anti")
            gone, count = None, 0
            if options.prune_deleted:
                there = seen.where("decision in ('plain', 'collision') and coalesce(lstat_kind, '') <> 'listing'").select(F.col("virtual").alias("path")).union(tarred.select("virtual")).where("path is not null")
                gone, lost = changes.deleted(now, there, prefix), changes.deleted(dirs, there, prefix)
                count = gone.count() + lost.count()
                now, dirs = changes.pruned(now, there, prefix), changes.pruned(dirs, there, prefix)
            counts = changes.scan_stats(
                stored.select(F.hex("cid").alias("cid"), F.col("original_size").alias("size"), "compressed_size"),
                unchanged.select("size"),
                before.select(F.hex("cid").alias("cid")),
                folders,
                seen.where("decision in ('ignore', 'skip', 'collision') or kind = 'error'").select("rel").unionByName(done.where("error is not null").select("rel")),
                count,
            )
            stats = counts.first().asDict()
            watch.check()
            tell({"step": "publish", **stats})
            self._publish(now, dirs, self._new_index(now, new, additive, gone))
            stats["errors_log_path"] = self._log_errors(seen, done, prefix)
            tell({"step": "done", **stats})
            return stats
        except Exception:
            watch.check()
            raise
        finally:
            shutil.rmtree(work, ignore_errors=True)

    def _kept(self, df: DataFrame, work: str, name: str, watch: _Watch) -> DataFrame:
        at = os.path.join(work, name)
        watch.check()
        df.write.parquet(at)
        watch.check()
        return self.spark.read.schema(df.schema).parquet(at)

    def _blob_cids(self, work: str, watch: _Watch) -> DataFrame:
        """cid (bytes) of every blob there is before the scan."""
        names = walk(self.spark, self.blobs.root).where("kind = 'file' and rel like '%.lz4'").select(F.substring_index("rel", ".", 1).alias("c"))
        return self._kept(names.select(expr.cid_string_to_bytes(F.col("c")).alias("cid")), work, "before", watch)

    def _log_errors(self, seen: DataFrame, done: DataFrame, prefix: str) -> str | None:
        bad = seen.where("kind = 'error'").select(F.coalesce("virtual", F.lit(prefix or "/")).alias("p"), F.col("error").alias("e"))
        bad = bad.union(done.where("error is not null").select("virtual", "error"))
        bad = bad.union(seen.where("decision = 'collision'").select("virtual", F.lit("archive collision: the directory of this name is archived here")))
        at, rows = os.path.join(self.root, expr.log_name(prefix)), 0
        for r in bad.toLocalIterator():
            with open(at, "a") as f:
                f.write(f"[{int(time.time())}] {r.p}: {r.e}\n")
            rows += 1
        return at if rows else None


def _storing(root: str):
    """A function for ``mapInArrow``: reads, hashes and stores files and archives where it runs; contents are never shuffled."""

    def run(batches):
        import pyarrow as pa


        blobs = BlobStore(root)
        names = [c.split()[0] for c in STORED.split(", ")]
        kinds = {"string": pa.string(), "binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
        shape = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in STORED.split(", ")])
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                out = dict.fromkeys(names) | {"rel": r["rel"], "virtual": r["virtual"], "modified": r["modified"], "created": r["created"], "permissions": r["mode"], "status": r["status"], "archived": r["archived"]}
                try:
                    if r["archived"]:
                        data = directory_archive(r["source"])
                        cid = cid_bytes(digests([data])[0])
                        size, stored = len(data), blobs.store(cid, data)
                    else:
                        cid, size, stored = blobs.store_file(r["source"])
                    out |= {"cid": cid, "original_size": size, "compressed_size": stored}
                except OSError as e:
                    out["error"] = str(e)
                rows.append(out)
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    return run


class _Watch:
    """Asks whether to cancel, and if so interrupts the session's jobs under its own tag."""

    def __init__(self, spark: SparkSession, should_cancel: Callable[[], bool] | None):
        self.spark, self.ask, self.tag = spark, should_cancel, f"scan-{uuid.uuid4().hex}"
        self.cancelled, self.over = False, threading.Event()

    def __enter__(self) -> _Watch:
        if self.ask:
            self.spark.addTag(self.tag)
            threading.Thread(target=self._poll, daemon=True).start()
        return self

    def __exit__(self, *exc) -> None:
        self.over.set()
        if self.ask:
            self.spark.removeTag(self.tag)

    def _poll(self) -> None:
        while not self.over.wait(0.05):
            if self.ask():
                self.cancelled = True
                self.spark.interruptTag(self.tag)
                return

    def check(self) -> None:
        if self.cancelled or self.ask and self.ask():
            raise Cancelled
