"""Exact duplicates by a content sort, with DataFrame operations only.

Rows are range-partitioned by their content at sampled splitters, sorted there by Spark's external
sort, and compared whole with their neighbour. The order is (first code points of the normalised
text, its SHA-256, the whole text, the id); the id belongs to the splitters' key as well, so a text
with many copies spreads over several ranges. Such ranges' end runs are joined afterwards; there
are at most two for each range.

Defined results: a null text counts as empty; texts are equal if identical after lower-casing A-Z
only; of equal texts the row with the largest id stays (null ids sort first); of identical rows
exactly one stays; an empty table gives an empty result; other columns pass through, except that
those named like a result column are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from cairn.llm.common import MOST_RANGES, staged, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULT = ("keep_id", "group_size", "kept", "text_sha256")
PREFIX = 64
#: Of the written table, if it has no columns but an id of whole numbers.
ROWS_A_FILE = 50_000


def normalised(text: Column) -> Column:
    """``text`` with A-Z lower-cased; null becomes empty."""
    t = text_or_empty(text)
    ascii_only = F.char_length(t) == F.octet_length(t)
    return F.when(ascii_only, F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def _sort_key(norm: Column, sha: Column, doc_id: Column) -> Column:
    """An ASCII text that sorts as (first code points, SHA-256, id) do."""
    number = F.lpad(F.hex(doc_id.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.hex(F.substring(norm, 1, PREFIX)), F.lit("!"), sha, F.coalesce(number, F.lit("")))


def splitters(docs: DataFrame, id_col: str, text_col: str, ranges: int, rows: int, sample: int = 12) -> list[str]:
    """Cuts for ``ranges`` ranges from about ``sample`` sampled rows for each; they steer balance only."""
    every = max(1, rows // (sample * ranges))
    key = F.col(id_col).cast("long")
    picked = docs.where(F.pmod(F.xxhash64(key, F.lit(5)), F.lit(every)) == 0)
    norm = normalised(F.col(text_col))
    picked = picked.select(norm.alias("n"), key.alias("i")).select("n", F.sha2("n", 256).alias("s"), "i")
    found = sorted(r[0] for r in picked.select(_sort_key(F.col("n"), F.col("s"), F.col("i"))).limit(4 * sample * ranges).collect())
    return sorted({found[len(found) * k // ranges] for k in range(1, ranges)}) if len(found) >= 2 else []


def range_of(key: Column, cuts: list[str]) -> Column:
    """The number of ``cuts`` that are <= ``key``, by a search on two levels."""
    if not cuts:
        return F.lit(0)
    step = max(1, math.isqrt(len(cuts)))
    low, every = F.split(F.lit(",".join(cuts[::step])), ","), F.split(F.lit(",".join(cuts)), ",")

    def search(x: Column) -> Column:
        hi = F.size(F.filter(low, lambda c: c <= x))
        part = F.slice(every, (F.greatest(hi, F.lit(1)) - 1) * step + 1, F.lit(step))
        return F.when(hi == 0, 0).otherwise((hi - 1) * step + F.size(F.filter(part, lambda c: c <= x))).cast("int")

    return F.element_at(F.transform(F.array(key), search), 1)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None, target_bytes: int = 4 << 20) -> DataFrame:
    """Every row of ``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``; ``columns``: those of ``docs`` to carry (all).

    The texts are shuffled once. What the neighbours' comparison found is written to the shared
    folder, with the text only of each range's first and last run.
    """
    docs = docs.drop(*RESULT)
    names = docs.columns if columns is None else columns
    docs = docs.select(*dict.fromkeys([*names, id_col, text_col]))
    stats = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length(text_or_empty(F.col(text_col))))).first()
    least = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(1, min(stats[0] // 16, max(least, math.ceil((stats[1] or 0) / target_bytes)), MOST_RANGES))
    cuts = splitters(docs, id_col, text_col, ranges, stats[0]) if ranges > 1 else []

    number = F.col(id_col).cast("long")
    norm = normalised(F.col(text_col))
    keyed = docs.withColumn("_cs_n", norm).withColumn("_cs_s", F.sha2("_cs_n", 256))
    dealt = keyed.withColumn("_cs_b", range_of(_sort_key(F.col("_cs_n"), F.col("_cs_s"), number), cuts))
    dealt = dealt.select(*docs.columns, "_cs_b").repartition("_cs_b")

    rows = dealt.withColumn("_cs_n", norm).withColumn("_cs_i", number).withColumn("_cs_s", F.sha2("_cs_n", 256))
    rows = rows.withColumn("_cs_p", F.substring("_cs_n", 1, PREFIX))
    order = Window.partitionBy("_cs_b").orderBy("_cs_p", "_cs_s", "_cs_n", "_cs_i")
    rows = rows.withColumn("_cs_first", ~F.col("_cs_n").eqNullSafe(F.lag("_cs_n").over(order)))
    rows = rows.withColumn("_cs_next", F.lead("_cs_n").over(order))  # null after the range's last row only
    rows = rows.withColumn("_cs_last", ~F.col("_cs_n").eqNullSafe(F.col("_cs_next")))
    rows = rows.withColumn("_cs_run", F.sum(F.col("_cs_first").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # the first run is known by its first row, another last run by its last one; from here on only they hold a text
    edge = F.expr("if(_cs_run = 1, _cs_first, _cs_next is null)")
    rows = rows.withColumn("_cs_edge", F.when(edge, F.col("_cs_n")))
    rows = rows.select(*names, "_cs_b", "_cs_run", "_cs_i", "_cs_s", "_cs_last", "_cs_edge")
    run = Window.partitionBy("_cs_b", "_cs_run")
    rows = rows.withColumn("_cs_max", F.max("_cs_i").over(run)).withColumn("_cs_size", F.count(F.lit(1)).over(run))

    rows = rows.select(*names, "_cs_b", "_cs_run", "_cs_s", "_cs_last", "_cs_max", "_cs_size", "_cs_edge")
    # On a local file system each new file starts three processes (``chmod``) from the executor's JVM, so short rows go to few files.
    # Not with other columns, nor ids that aren't whole numbers: rows of one text and ``_cs_i`` could then change places when a lost task runs again.
    if set(names) <= {id_col} and isinstance(docs.schema[id_col].dataType, IntegralType):
        rows = rows.repartition(max(1, math.ceil(stats[0] / ROWS_A_FILE)))
    rows = staged(rows, "content-sort")
    ends = rows.where("_cs_edge is not null").select("_cs_b", "_cs_run", "_cs_s", "_cs_edge", "_cs_max", "_cs_size")
    same = ends.groupBy("_cs_s", "_cs_edge").agg(F.max("_cs_max").alias("_cs_tmax"), F.sum("_cs_size").alias("_cs_tsize"), F.max("_cs_b").alias("_cs_tb"), F.count(F.lit(1)).alias("_cs_k")).where("_cs_k > 1")
    whole = ends.join(same, ["_cs_s", "_cs_edge"]).select("_cs_b", "_cs_run", "_cs_tmax", "_cs_tsize", "_cs_tb")
    # at most two runs of each range: as small as the list of splitters
    rows = rows.join(F.broadcast(whole), ["_cs_b", "_cs_run"], "left")
    return rows.select(
        *names,
        F.coalesce("_cs_tmax", "_cs_max").alias("keep_id"),
        F.coalesce("_cs_tsize", "_cs_size").alias("group_size"),
        (F.col("_cs_last") & (F.col("_cs_b") == F.coalesce("_cs_tb", "_cs_b"))).alias("kept"),
        F.col("_cs_s").alias("text_sha256"),
    )


def exact_duplicates_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return exact_duplicates(docs, columns=["doc_id"]).select("doc_id", *RESULT)


EXACT_DUPLICATES_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
