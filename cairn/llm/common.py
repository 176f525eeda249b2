"""Helpers that the operators of this package share.

* ``shared_dir`` / ``staged``: lineage is cut by a Parquet table written under the folder
  named by ``spark.checkpoint.dir``, which driver and executors share.
* ``rank_in_group``, ``bucket_of``, ``components``: numbers within groups, ranges of ids, connected components.
* ``in_file_order``: the order in which rows stand in their files, as a column.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import math
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.shipping import ship  # noqa: F401

#: The most ranges that rows are dealt to. Beyond, ranges grow instead; a range is sorted on disk and read as a stream.
MOST_RANGES = 50_000
#: A table whose rows were counted is broadcast up to here (digests or numbers, under 100 MB) and shuffled beyond.
BROADCAST_ROWS = 500_000

_folders: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares. Only where ``spark.checkpoint.dir`` is unset (a single machine, tests) a local one is made."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="cairn-shared-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder's URI under ``shared_dir``, removed when the driver's Python ends."""
    at = f"{shared_dir(spark)}/cairn-{name}-{uuid.uuid4().hex[:12]}"
    if not _folders:
        atexit.register(_remove_folders)
    _folders.append((spark, at))
    return at


def drop_folder(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _remove_folders() -> None:
    while _folders:
        spark, at = _folders.pop()
        try:
            drop_folder(spark, at)
        except Exception:  # the session may be gone already
            return


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and safe from lost executors."""
    spark = df.sparkSession
    at = new_folder(spark, name)
    df.write.option("compression", "zstd").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


@contextlib.contextmanager
def short_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20):
    """Within, Python gets rows in Arrow batches of at most ``rows`` rows and about ``size`` bytes (Spark's own limits are ten and eight times that), which bounds the buffers on either side."""
    most = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    was = {key: spark.conf.get(key) for key in most}
    for key, n in most.items():
        old = re.fullmatch(r"(-?\d+)b?", was[key], re.IGNORECASE)
        spark.conf.set(key, str(min(n, int(old[1])) if old and int(old[1]) > 0 else n))
    try:
        yield
    finally:
        for key, old in was.items():
            spark.conf.set(key, old)


def release_memory() -> None:
    """Gives what a Python worker has freed back to the system. Workers wait for the next task and would hold it until then."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


#: What a Python worker keeps from task to task, by name: how to drop it.
kept: dict[str, Callable[[], None]] = {}


def drop_kept(but: str | None) -> None:
    """A function of its own: what is sent to workers takes ``kept`` along as a copy, but finds this by name."""
    for name in [k for k in kept if k != but]:
        kept.pop(name)()


def tidy(run, keeps: str | None = None):
    """``run``, a function for ``mapInArrow``, with freed memory returned at the task's end; what other tasks have left in ``kept``, but under ``keeps``, goes before it begins."""

    def tidied(batches):
        drop_kept(keeps)
        try:
            yield from run(batches)
        finally:
            release_memory()

    return tidied


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: lambdas compute what they take from outside at each step."""
    return F.element_at(F.transform(F.array(value), use), 1)


def id_mod(col: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % n


def spread(*cols: Column, seed: int = 7) -> Column:
    """A number from 0 (inclusive) to 1 (exclusive) that depends on the values only."""
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def in_file_order(df: DataFrame, into: str) -> DataFrame:
    """Add ``into``, a number that ascends with a row's place: by files as Spark numbers them, then within a file. Rows that were filtered out leave gaps.

    Spark reads files in no fixed order, so the place comes from the file's name and the row's index there.
    A table that isn't read from files is written first.
    """
    try:
        at = df.metadataColumn("_metadata")
    except AnalysisException:
        df = staged(df, "in-order")
        at = df.metadataColumn("_metadata")
    df = df.withColumns({"_fo_f": at["file_path"], "_fo_r": at["row_index"]})
    before = Window.orderBy(F.length("_fo_g"), "_fo_g").rowsBetween(Window.unboundedPreceding, -1)  # longer names: part numbers of more digits
    files = df.groupBy(F.col("_fo_f").alias("_fo_g")).agg((F.max("_fo_r") + 1).alias("_fo_n"))  # one row for each file
    files = F.broadcast(files.select("_fo_g", F.coalesce(F.sum("_fo_n").over(before), F.lit(0)).alias("_fo_o")))
    return df.join(files, F.col("_fo_f") == F.col("_fo_g")).withColumn(into, F.col("_fo_o") + F.col("_fo_r")).drop("_fo_f", "_fo_g", "_fo_o", "_fo_r")


def rank_in_group(df: DataFrame, group: str, order: list[str], rows: int, into: str, block: int = 20_000, place: Column | None = None) -> DataFrame:
    """Add ``into``, each row's number (from 0) within its ``group``, in a pseudo-random order that depends on the values of ``order`` only.

    A hot group doesn't meet in one task: rows are dealt to ranges of a hash of ``order``, numbered
    there, and the ranges' counts are summed. Rows that are equal in ``order`` may change places.
    ``place``, from 0 (inclusive) to 1 (exclusive) and ascending with ``order``: the ranges are its own, and rows are numbered as they stand in ``order``.
    """
    least = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, math.ceil(rows / block), min(least, rows // 500))
    if place is None:
        df = df.withColumn("_rk_h", F.xxhash64(*order, F.lit(11)))
        df = df.withColumn("_rk_b", F.floor(F.pmod(F.shiftright("_rk_h", 20), F.lit(1 << 40)) * F.lit(parts) / F.lit(1 << 40)).cast("int"))
    else:
        df = df.withColumn("_rk_h", place)
        df = df.withColumn("_rk_b", F.floor(F.col("_rk_h") * F.lit(parts)).cast("int"))
    sums = df.groupBy(group, "_rk_b").agg(F.count(F.lit(1)).alias("_rk_n"))
    before = Window.partitionBy(group).orderBy("_rk_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(group).alias("_rk_g"), F.col("_rk_b").alias("_rk_c"), F.coalesce(F.sum("_rk_n").over(before), F.lit(0)).alias("_rk_o"))
    here = Window.partitionBy(group, "_rk_b").orderBy("_rk_h", *order)
    df = df.withColumn("_rk_r", F.row_number().over(here) - 1)
    df = df.join(sums, (F.col(group).eqNullSafe(F.col("_rk_g"))) & (F.col("_rk_b") == F.col("_rk_c")))
    return df.withColumn(into, (F.col("_rk_o") + F.col("_rk_r")).cast("long")).drop("_rk_h", "_rk_b", "_rk_g", "_rk_c", "_rk_o", "_rk_r")


def id_buckets(docs: DataFrame, id_col: str, text_col: str, target: int, least: int = 1) -> tuple[list[int], int]:
    """Boundaries that cut the ids, ascending, into ranges of about ``target`` bytes of text; and the number of rows.

    Row ``i`` belongs to the range given by the number of boundaries that are <= its id. The
    boundaries are approximate quantiles, one for each range; they only steer balance.
    """
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text_or_empty(F.col(text_col))))).first()
    parts = min(MOST_RANGES, max(least, math.ceil((size or 0) / target)))
    if not n or parts < 2:
        return [], n
    parts = min(parts, n)
    cuts = docs.agg(F.percentile_approx(F.col(id_col).cast("long"), [i / parts for i in range(1, parts)], 10 * parts)).first()[0]
    return sorted(set(cuts or [])), n


def bucket_of(col: Column, cuts: list[int]) -> Column:
    """The number of ``cuts`` that are <= ``col`` (0 for null), by a two-level search."""
    if not cuts:
        return F.lit(0)
    step = max(1, math.isqrt(len(cuts)))
    listed = lambda numbers: F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")
    low, every = listed(cuts[::step]), listed(cuts)

    def search(x: Column) -> Column:
        hi = F.size(F.filter(low, lambda c: c <= x))
        at = F.when(hi == 0, 0).otherwise((hi - 1) * step + F.size(F.filter(F.slice(every, (F.greatest(hi, F.lit(1)) - 1) * step + 1, F.lit(step)), lambda c: c <= x)))
        return at.cast("int")

    # the value is bound by the outer lambda, so that it's computed once for each row
    return F.coalesce(F.element_at(F.transform(F.array(col), search), 1), F.lit(0))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: a row ``(node, root)`` for each node, the root being its component's smallest node.

    In each round every node joins the first, in an order drawn anew by a hash, of itself and its neighbours, and the
    edges are drawn between what is left. The edges shrink by a share of themselves each round, whatever
    the components' shape. Every round is a written table; only whether edges are left returns to the driver.
    """
    apart = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    live = staged(edges.where("a <> b").select(*apart("a", "b")).distinct(), "edges")
    roots = live.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    for turn in range(rounds):
        if live.isEmpty():
            low = roots.groupBy("root").agg(F.min("node").alias("low"))
            return staged(roots.join(low, "root").select("node", F.col("low").alias("root")), "roots")
        drawn = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("x"))  # noqa: E731, B023
        both = live.union(live.select("b", "a"))
        first = both.groupBy(F.col("a").alias("node")).agg(F.min(drawn("b")).alias("near"))
        step = staged(first.select("node", F.least("near", drawn("node"))["x"].alias("up")), "steps")
        jump = step.select(F.col("node").alias("up"), F.col("up").alias("top"))
        step = staged(step.join(jump, "up").select("node", "top"), "steps")
        of = lambda c: step.select(F.col("node").alias(c), F.col("top").alias(f"top_{c}"))  # noqa: E731, B023
        live = staged(live.join(of("a"), "a").join(of("b"), "b").where("top_a <> top_b").select(*apart("top_a", "top_b")).distinct(), "edges")
        if turn:
            roots = roots.join(of("root"), "root", "left").select("node", F.coalesce("top_root", "root").alias("root"))
        else:
            roots = step.select("node", F.col("top").alias("root"))
    raise RuntimeError(f"edges are left after {rounds} rounds")
