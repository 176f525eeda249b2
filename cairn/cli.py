"""Command line: ``python -m cairn.cli scan | ls | info | duplicates | cat``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cairn.functions import expr
from cairn.operators import rules
from cairn.plans.store import ScanOptions, Store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cairn")
    p.add_argument("--store", default=".store")
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan")
    s.add_argument("--source", required=True)
    s.add_argument("--target", default="/")
    for flag in ("git", "rust", "node", "python", "prune"):
        s.add_argument(f"--{flag}", action="store_true")
    s.add_argument("--ignore-regex", action="append", default=[])
    s.add_argument("--archive-regex", action="append", default=[])
    for name in ("ls", "info", "cat"):
        c = sub.add_parser(name)
        c.add_argument("path", nargs="?" if name == "ls" else None, default="/")
        if name == "cat":
            c.add_argument("-o", "--output")
    sub.add_parser("duplicates")
    return p


def size_text(n: int) -> str:
    for unit, power in (("GB", 30), ("MB", 20), ("KB", 10)):
        if n >= 1 << power:
            return f"{n / (1 << power):.1f} {unit}"
    return f"{n} B"


def main(args: list[str] | None = None, spark: SparkSession | None = None, out=None) -> int:
    a = parser().parse_args(args)
    out = out or sys.stdout
    say = lambda text="": print(text, file=out)
    spark = spark or SparkSession.builder.appName("cairn").getOrCreate()
    store = Store(spark, a.store)
    try:
        if a.command == "scan":
            chosen = rules.from_flags(a.git, a.rust, a.node, a.python, a.ignore_regex, a.archive_regex)
            s = store.scan(a.source, a.target, ScanOptions(rules=chosen, prune_deleted=a.prune))
            say("Scan complete!")
            for label, key in (("Files", "total_files"), ("Directories", "total_dirs"), ("Unique blobs", "unique_blobs"), ("Duplicate files", "duplicate_files"), ("Unchanged", "unchanged_files"), ("Skipped", "skipped_files"), ("Pruned", "pruned_entries")):
                say(f"  {label + ':':<17}{s[key]:,}")
            original, stored = s["total_original_bytes"], s["total_stored_bytes"]
            say(f"  {'Original size:':<17}{size_text(original)}")
            say(f"  {'Stored size:':<17}{size_text(stored)}")
            if original:
                say(f"  {'Space saved:':<17}{size_text(max(0, original - stored))} ({(1 - stored / original) * 100:.1f}%)")
            if s["errors_log_path"]:
                say(f"  {'Errors:':<17}{s['errors_log_path']}")
        elif a.command == "ls":
            rows = store.list_dir(a.path).withColumn("shown", expr.pad_left(expr.format_size(F.col("size")))).toLocalIterator()
            for r in rows:
                say(f"{'':>10}  {r.name}/" if r.is_dir else f"{r.shown}  {r.name}")
        elif a.command == "info":
            rows = store.file_info(a.path).orderBy("duplicate").collect()
            if not rows:
                raise FileNotFoundError(f"file not found: {a.path}")
            for label, value in (("Path", rows[0].path), ("CID", rows[0].cid), ("Size", rows[0]["size"]), ("Stored", rows[0].stored), ("Modified", rows[0].modified), ("Mode", rows[0].mode)):
                say(f"{label + ':':<10}{value}")
            if len(rows) > 1:
                say("Duplicates:")
                for r in rows:
                    say(f"  {r.duplicate}{'  (this file)' if r.this_file else ''}")
        elif a.command == "duplicates":
            for r in store.find_all_duplicates().withColumn("short", expr.short_cid(F.col("cid"))).toLocalIterator():
                say(f"{r.short}...  {len(r.paths)} copies")
                for path in r.paths:
                    say(f"  {path}")
        else:
            data = store.read_file(a.path)
            if a.output:
                with open(a.output, "wb") as f:
                    f.write(data)
            else:
                sys.stdout.buffer.write(data)
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
