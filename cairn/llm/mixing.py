"""Mixing sources to target weights by Pfair scheduling.

Every source's documents, in a pseudo-random order of their own, are cut into blocks. With target
weight w, block j (from 0) is released at slot floor(j / w) and due by slot ceil((j + 1) / w). In each
slot the released block with the earliest deadline goes next, which keeps every source within
less than one block of its target at each slot.

Weights are taken as exact rationals, so nothing is rounded however long the schedule is. The driver goes through
it block by block, from the weights and the sources' numbers of rows alone, and keeps three numbers for
each block; rows find their block's slot by a join. A block has 16 rows, or more where that would make
over a million blocks, so what the driver holds and broadcasts doesn't grow with the corpus.

Defined results: a source that has run out leaves its slots empty, which the order of ``position``
closes, so the others go on in their proportions; once the sources left have under 1/64 of the weights, the
empty slots aren't gone through any more, and windows hold as before. No row is dropped or repeated. A null source is a
source of its own; repeated rows keep all their copies; an empty table gives an empty result.
Sources that given weights leave out, or give 0, come after all others, in a schedule of their own.
"""

from __future__ import annotations

import heapq
import math
from array import array
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import rank_in_group

RESULT = ("source_rank", "block", "slot", "position")
#: The most blocks of a schedule, beside one for each source.
BLOCKS = 1_000_000


def in_order(keys) -> list:
    return sorted(keys, key=lambda k: (k is not None, str(k)))


def quantised(weights: Mapping, period: int = 1024) -> tuple[dict, int]:
    """Whole shares of a period for each key, 1 at least, and the period: ``period`` or the power of two over four for each key."""
    keys = in_order(weights)
    while period < 4 * len(keys):
        period *= 2
    total = sum(weights.values())
    ideal = {k: weights[k] / total * period for k in keys}
    share = {k: max(1, int(ideal[k])) for k in keys}
    left = period - sum(share.values())
    by_rest = sorted(keys, key=lambda k: (share[k] - ideal[k], str(k)))
    while left > 0:
        for k in by_rest[:left]:
            share[k] += 1
        left = period - sum(share.values())
    while left < 0:  # many tiny weights were raised to 1: the largest shares pay
        k = max(keys, key=lambda k: (share[k], str(k)))
        share[k] -= 1
        left += 1
    return share, period


def pfair(weights: Mapping, blocks: Mapping):
    """(slot, number of the key in order, number of the key's block) for all ``blocks``, earliest deadline first among released blocks."""
    keys = in_order(weights)
    exact = [Fraction(weights[k]) for k in keys]
    unit = math.lcm(*(w.denominator for w in exact))
    share = [int(w * unit) for w in exact]
    total, own = sum(share), [blocks[k] for k in keys]
    live, left = total, sum(own)
    done, ready, slot = [0] * len(keys), [], 0
    waiting = [(0, k) for k in range(len(keys))]
    while left:
        sparse = live * 64 < total
        while waiting and waiting[0][0] <= slot:
            _, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(done[k] + 1) * total // share[k]), k))
        if not ready:  # only where blocks of sources that ran out are left away
            slot = waiting[0][0]
            continue
        _, k = heapq.heappop(ready)
        if done[k] < own[k]:
            yield slot, k, done[k]
            left -= 1
            live -= share[k] if done[k] + 1 == own[k] else 0
        elif sparse:
            continue
        done[k] += 1
        slot += 1
        heapq.heappush(waiting, (max(slot, done[k] * total // share[k]), k))


def mix(docs: DataFrame, weights: Mapping | None = None, temperature: float = 0.7, block: int | None = None, period: int | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``docs`` with ``source_rank`` (number within its source), ``block``, ``slot`` and ``position``; sorting by ``position`` gives the mixture.

    ``weights`` maps sources to target weights; without it a source's weight is its number of rows to
    the power ``temperature``. ``period``: round the weights to multiples of 1/period first (as ``quantised`` does).
    ``block``: rows in a block; by default 16, or as many as make a million blocks of all rows. The driver
    holds one row for each source, as the weights do, and 20 bytes for each block.
    """
    import numpy as np
    import pyarrow as pa

    spark = docs.sparkSession
    docs = docs.drop(*RESULT)
    names = docs.columns
    counts = {r[0]: r[1] for r in docs.groupBy(F.col(source_col).cast("string")).count().collect()}
    if not counts:
        return docs.withColumns({c: F.lit(None).cast("long") for c in RESULT})
    block = block or max(16, -(-sum(counts.values()) // BLOCKS))
    if weights is None:
        weights = {k: n**temperature for k, n in counts.items()}
    given = {k: w for k, w in weights.items() if w > 0 and k in counts}
    rest = {k: float(n) for k, n in counts.items() if k not in given}
    names_in, start = [], 0
    who, which, when = array("i"), array("q"), array("q")
    for part in (given, rest):
        if part:
            keys = in_order(part)
            part = part if period is None else quantised(part, period)[0]
            for slot, k, j in pfair(part, {k: -(-counts[k] // block) for k in keys}):
                who.append(len(names_in) + k)
                which.append(j)
                when.append(start + slot)
            start = when[-1] + 1
            names_in += keys
    table = pa.table({"_mx_i": np.frombuffer(who, np.int32), "_mx_j": np.frombuffer(which, np.int64), "_mx_slot": np.frombuffer(when, np.int64)})
    table = spark.createDataFrame(table)
    sources = spark.createDataFrame(list(enumerate(names_in)), "_mx_n int, _mx_k string")
    keyed = docs.withColumn("_mx_s", F.col(source_col).cast("string"))
    keyed = rank_in_group(keyed, "_mx_s", [id_col], sum(counts.values()), "source_rank")
    keyed = keyed.withColumn("block", F.expr(f"source_rank div {block}"))
    keyed = keyed.join(F.broadcast(sources), F.col("_mx_s").eqNullSafe(F.col("_mx_k")))
    keyed = keyed.join(F.broadcast(table) if len(who) <= BLOCKS + len(counts) else table, (F.col("_mx_n") == F.col("_mx_i")) & (F.col("block") == F.col("_mx_j"))).withColumnRenamed("_mx_slot", "slot")
    return keyed.select(*names, "source_rank", "block", "slot", F.expr(f"slot * {block} + source_rank % {block}").alias("position"))


def mixing_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix(docs)
