"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous rounds.

A document is its token ids and an end id. One longer than a sequence is cut into pieces of a full
sequence's length, the first of them taking the rest. Pieces and gaps are then kept sorted by size as
runs (size, how many), of which there are at most as many as a sequence has tokens. In each
round every run of pieces, longest first, sweeps to its successor, the run of smallest gaps that
hold it; pieces that want the same gaps go by rank (longer ones, then lower numbers, first) and the
rest wait for the next round, when the gaps left over and the new smaller gaps are there. When no
piece fits a gap, the longest run opens new sequences. This is best-fit decreasing, decided on
the counts alone; the pieces themselves are numbered within their length, spread over all
executors, and find their place in the plan by a join on length and number.

Where documents have an order to keep (``order_col``), the plan and the number of sequences stay as they are, and what
is interchangeable follows the order: of each length, pieces evenly spread over the order lead sequences (stand at offset 0),
sequences are numbered as their leaders are ordered, and the length's other pieces, in order, go to its other
places, ascending by sequence.

Defined results: a null or empty text is one piece that holds the end id; repeated rows are each
packed; an empty table gives an empty result; other columns pass through on request only.
"""

from __future__ import annotations

import bisect
import math
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import rank_in_group, ship, short_batches, staged, text_or_empty, tidy
from cairn.llm.tokens import encoder, tokenizer_path, with_end

CAPACITY, END_ID = 2048, 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Above so many rows the plan isn't broadcast. It has at most a few runs for each length.
PLAN_ROWS = 200_000


def pieces_of(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` tokens: the first is shorter if they don't divide evenly."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(docs: DataFrame, path: str, end_id: int = END_ID, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, order_col: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, and ``ids`` (little-endian unsigned 32-bit) and ``order_col`` (long) if asked for."""
    ship(docs.sparkSession)
    order = [order_col] if order_col else []

    def cut(batches):
        import pyarrow as pa

        enc = encoder(path)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids + [(o, pa.int64()) for o in order])
        for batch in batches:
            at, docs, places = 0, batch.column(0).to_pylist(), batch.column(2).to_pylist() if order else [None] * batch.num_rows
            for ids, counts in enc.batch(batch.column(1)):
                ids, counts = with_end(ids, counts, end_id)
                out: list[list] = [[] for _ in schema]
                for end, n in zip(np.cumsum(counts).tolist(), counts.tolist()):
                    for k, (start, length) in enumerate(pieces_of(n, capacity)):
                        part = ids[end - n + start : end - n + start + length].tobytes()
                        for col, x in zip(out, (docs[at], k, start, length, zlib.crc32(part), *[part] * with_ids, places[at])):
                            col.append(x)
                    at += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"), *order).mapInArrow(tidy(cut, "encoders"), PIECES + ", ids binary" * with_ids + "".join(f", {o} long" for o in order))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit rounds over ``counts`` (pieces by length).

    Gives runs (length, first number, how many, first sequence, offset): piece number ``first + i`` of that
    length goes to sequence ``first sequence + i``. And the number of sequences.
    """
    left = {n: [0, c] for n, c in counts.items() if c}
    sizes = sorted(left)
    gaps: dict[int, list[tuple[int, int]]] = {}  # size of the gap: runs (first sequence, how many)
    known: list[int] = []  # their sizes, ascending
    out, sequences = [], 0

    def give(gap: int, run: tuple[int, int]) -> None:
        if gap and run[1]:
            if gap not in gaps:
                bisect.insort(known, gap)
            gaps.setdefault(gap, []).append(run)

    while sizes:
        made, moved = [], False
        for n in reversed(sizes):  # by rank: the longest pieces choose first
            while left[n][1] and (at := bisect.bisect_left(known, n)) < len(known):
                moved, gap = True, known[at]
                first, many = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], known[at]
                first_piece, here = left[n]
                take = min(here, many)
                out.append((n, first_piece, take, first, capacity - gap))
                left[n] = [first_piece + take, here - take]
                give(gap, (first + take, many - take))
                made.append((gap - n, (first, take)))  # to be chosen from in the next round
            if made:
                break  # smaller pieces see the gaps that this run has made
        for gap, run in made:
            give(gap, run)
        if not moved:
            n = sizes[-1]
            first_piece, here = left[n]
            per = capacity // n
            many = -(-here // per)
            for k in range(per):
                take = min(many, here - k * many)
                if take <= 0:
                    break
                out.append((n, first_piece + k * many, take, sequences, k * n))
            full = here - (per - 1) * many if per > 1 else many
            if full > 0:
                give(capacity - per * n, (sequences, full))
                give(capacity - (per - 1) * n, (sequences + full, many - full))
            else:  # too few pieces to reach the last place
                used = -(-here // many)
                last = here - (used - 1) * many
                give(capacity - used * n, (sequences, last))
                give(capacity - (used - 1) * n, (sequences + last, many - last))
            sequences += many
            left[n][1] = 0
        sizes = [n for n in sizes if left[n][1]]
    return out, sequences


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``. ``pieces`` is read three times: give a table, not a computation."""
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs, _ = plan(counts, capacity)
    rows = [(a, b, b + n, s, o) for a, b, n, s, o in runs]
    table = spark.createDataFrame(rows, "_pk_l long, _pk_a long, _pk_b long, _pk_s long, _pk_o long")
    if len(rows) <= PLAN_ROWS:
        table = F.broadcast(table)
    ranked = rank_in_group(pieces, "length", ["doc_id", "piece"], sum(counts.values()), "_pk_r")
    here = (F.col("length") == F.col("_pk_l")) & (F.col("_pk_r") >= F.col("_pk_a")) & (F.col("_pk_r") < F.col("_pk_b"))
    return ranked.join(table, here).select(*pieces.columns, (F.col("_pk_s") + F.col("_pk_r") - F.col("_pk_a")).alias("sequence_id"), F.col("_pk_o").alias("offset"))


def pack_in_order(pieces: DataFrame, order_col: str, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` without ``order_col`` (not negative), with ``sequence_id`` and ``offset``: as many sequences as ``pack`` makes, numbered from 0 as their first pieces are ordered.

    ``pieces`` is read three times: give a table, not a computation.
    """
    spark = pieces.sparkSession
    names = [c for c in pieces.columns if c != order_col]
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs, sequences = plan(counts, capacity)
    total, last = sum(counts.values()), pieces.agg(F.max(order_col)).first()[0] or 0
    # a length opens its sequences in one run; a step that shares no divisor with their number deals its leaders evenly to all kinds of sequences
    opened = {n: (many, first) for n, _, many, first, at in runs if not at}
    lengths = []
    for n, c in counts.items():
        many, first = opened.get(n, (0, 0))
        step = max(1, round(many * 0.618))
        while math.gcd(step, many) > 1:
            step += 1
        lengths.append((n, c, many, first, step))
    lengths = F.broadcast(spark.createDataFrame(lengths, "_pk_l long, _pk_c long, _pk_m long, _pk_s long, _pk_g long"))  # at most ``capacity`` rows
    ranked = rank_in_group(pieces, "length", [order_col, "doc_id", "piece"], total, "_pk_r", place=F.col(order_col) / F.lit(float(last + 1)))
    ranked = ranked.join(lengths, F.col("length") == F.col("_pk_l")).withColumn("_pk_q", F.expr("_pk_r * _pk_m div _pk_c"))
    ranked = ranked.withColumn("_pk_first", F.expr("(_pk_r + 1) * _pk_m div _pk_c > _pk_q"))
    ranked = ranked.withColumn("_pk_x", F.expr("if(_pk_first, _pk_s + _pk_q * _pk_g % _pk_m, _pk_r - _pk_q)"))  # a leader's sequence in the plan, another's number
    ranked = staged(ranked.select(*pieces.columns, "_pk_first", "_pk_x"), "ranked")

    leaders = ranked.where("_pk_first").withColumn("_pk_all", F.lit(0))
    leaders = rank_in_group(leaders, "_pk_all", [order_col, "doc_id", "piece"], sequences, "sequence_id", place=F.col(order_col) / F.lit(float(last + 1)))
    leaders = staged(leaders.select(*names, "_pk_x", "sequence_id"), "leaders")
    most = max(1000, -(-total // 10_000))  # places in one row for the executors
    rows = [(n, first + k, min(most, many - k), at) for n, _, many, first, at in runs if at for k in range(0, many, most)]
    places = spark.createDataFrame(rows, "_pk_l long, _pk_s long, _pk_m long, offset long")
    places = places.select("_pk_l", "offset", F.explode(F.expr("sequence(_pk_s, _pk_s + _pk_m - 1)")).alias("_pk_t"))
    places = places.join(leaders.select("_pk_x", "sequence_id"), F.col("_pk_t") == F.col("_pk_x")).select("_pk_l", "sequence_id", "offset")
    places = rank_in_group(places, "_pk_l", ["sequence_id", "offset"], total - sequences, "_pk_n", place=F.col("sequence_id") / F.lit(float(max(1, sequences))))
    others = ranked.where("not _pk_first").join(places, (F.col("length") == F.col("_pk_l")) & (F.col("_pk_x") == F.col("_pk_n")))
    return leaders.select(*names, "sequence_id", F.lit(0).cast("long").alias("offset")).unionByName(others.select(*names, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, order_col: str | None = None) -> DataFrame:
    """Pieces of all ``docs`` with their sequence and offset; token ids too if asked for. ``order_col``: an order for the sequences to follow."""
    path = path or tokenizer_path("byte_bpe_50k.json")
    with short_batches(docs.sparkSession):
        pieces = staged(token_pieces(docs, path, capacity=capacity, with_ids=with_ids, order_col=order_col), "pieces")
    return pack_in_order(pieces, order_col, capacity) if order_col else pack(pieces, capacity)


def packing_query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
