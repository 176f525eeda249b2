"""``fswalk``: a directory tree as a DataFrame, read by many tasks.

Options: ``path``; ``partitions`` (16); ``skip``, a JSON list of [regular expression, action] that says in which
directories not to look (the first that matches decides; the entry itself is still given). Links aren't
followed, but what a link leads to is what ``kind``, ``size`` and times tell; ``lstat_kind`` tells the link.
"""

from __future__ import annotations

import json
import os
import re
import stat

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cairn.schema import ENTRIES
from cairn.shipping import ship


def _kind(mode: int) -> str:
    return "dir" if stat.S_ISDIR(mode) else "file" if stat.S_ISREG(mode) else "link" if stat.S_ISLNK(mode) else "other"


def describe(full: str, rel: str) -> tuple:
    """One row of ENTRIES."""
    rel = rel.replace("\\", "/")
    lstat_kind = None
    try:
        lstat_kind = _kind(os.lstat(full).st_mode)
        s = os.stat(full)
    except OSError as e:
        return rel, "error", lstat_kind, None, None, None, None, full, str(e)
    born = int(getattr(s, "st_birthtime", 0) or 0)
    return rel, _kind(s.st_mode), lstat_kind, s.st_size, max(0, int(s.st_mtime)), max(0, born), s.st_mode, full, None


class Skip:
    def __init__(self, rules: list):
        self.rules = [(re.compile(p), a) for p, a in rules]

    def action(self, rel: str) -> str | None:
        return next((a for p, a in self.rules if rel and p.search(rel)), None)

    def hides(self, full: str, rel: str) -> bool:
        """Whether nothing below this directory is visited."""
        if not self.rules:
            return False
        if self.action(rel):
            return True
        base = rel.removesuffix(".tar")
        return base != rel and base and not base.endswith("/") and self.action(base) == "archive" and os.path.isdir(full[:-4]) and not os.path.islink(full[:-4])


def children(full: str, rel: str):
    """(path, relative path, whether it's a real directory), or an error row."""
    try:
        with os.scandir(full) as it:
            for e in sorted(it, key=lambda e: e.name):
                shown = os.fsencode(e.name).decode("utf-8", "replace")
                yield e.path, f"{rel}/{shown}" if rel else shown, e.is_dir(follow_symlinks=False)
    except OSError as e:
        yield e


class Part(InputPartition):
    def __init__(self, alone: list, trees: list):
        self.alone, self.trees = alone, trees


class Reader(DataSourceReader):
    def __init__(self, options):
        self.root = os.path.realpath(options["path"])
        self.count = int(options.get("partitions", "16"))
        self.rules = json.loads(options.get("skip", "[]"))

    def partitions(self):
        """The top levels are looked through until there are trees enough to deal out."""
        skip, alone, trees = Skip(self.rules), [], [(self.root, "")]
        while trees and len(trees) < 4 * self.count:
            level, trees, deeper = trees, [], False
            for full, rel in level:
                alone.append((full, rel))
                for c in children(full, rel):
                    if isinstance(c, OSError):
                        alone.append((full, rel, str(c)))
                    elif c[2] and not skip.hides(c[0], c[1].replace("\\", "/")):
                        trees.append(c[:2])
                        deeper = True
                    else:
                        alone.append(c[:2])
            if not deeper:
                break
        n = max(1, min(self.count, len(alone) + len(trees)))
        return [Part(alone[k::n], trees[k::n]) for k in range(n)]

    def read(self, part):
        skip = Skip(self.rules)
        for one in part.alone:
            yield describe(one[0], one[1]) if len(one) == 2 else (one[1], "error", "listing", None, None, None, None, one[0], one[2])
        for tree in part.trees:
            todo = [tree]
            while todo:
                full, rel = todo.pop()
                yield describe(full, rel)
                for c in children(full, rel):
                    if isinstance(c, OSError):
                        yield rel, "error", "listing", None, None, None, None, full, str(c)
                    elif c[2] and not skip.hides(c[0], c[1].replace("\\", "/")):
                        todo.append(c[:2])
                    else:
                        yield describe(c[0], c[1])


class FsWalk(DataSource):
    @classmethod
    def name(cls):
        return "fswalk"

    def schema(self):
        return ENTRIES

    def reader(self, schema):
        return Reader(self.options)


def walk(spark, path: str, partitions: int = 16, skip=()):
    """The tree below ``path``, its root (relative path empty) included."""
    ship(spark)
    spark.dataSource.register(FsWalk)
    return spark.read.format("fswalk").option("path", path).option("partitions", partitions).option("skip", json.dumps([list(x) for x in skip])).load()
