"""Sends this package's sources to the executors, so that functions run there can be imported whatever the driver's folder is."""

from __future__ import annotations

import os
import tempfile
import zipfile
import zlib

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    found = sorted(os.path.join(d, f) for d, _, names in os.walk(package) for f in names if f.endswith(".py"))
    mark = 0
    for path in found:
        with open(path, "rb") as f:
            mark = zlib.crc32(f.read(), mark)
    target = os.path.join(tempfile.mkdtemp(prefix="cairn-"), f"cairn_{mark:08x}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in found:
            z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)
