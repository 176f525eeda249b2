"""Document fingerprints by randomised edit embedding.

Shared random walks over characters (the same bits for all texts): at time t the walk shows the
character under its pointer, and moves on if that character's bit for time t is 1. So texts with a small edit
distance show the same characters at most times (the Hamming distance of the walks is small), as two walks that
differ meet again soon after an edit. A character counts together with the one after it, so that unlike texts seldom show
the same. Its stay is a row of a table (its bits' next 1), so a text of n characters takes n steps, done for many
texts at once in numpy.

A fingerprint has ``SLOTS`` hex digits. Slot k shows the character (hashed to 4 bits) at the time that its own
random order of times puts first among the times of a text of that length (2 n on average); texts
of like length sample the same times. ``likeness`` is the share of equal slots above chance, from 0 to 1.
``similar`` bands the slots, verifies candidates by likeness and joins links to classes.

Defined results: a null text counts as empty, whose fingerprint is all ``0``; equal texts have equal
fingerprints; rows with equal ids follow each other by text; the only row is its own next; texts of a class
without any id have a null class; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import BROADCAST_ROWS, bucket_of, components, id_buckets, ship, staged, text_or_empty

SLOTS, PERIOD, CLASSES, LANES, CHARS, SERIAL = 128, 4096, 256, 2048, 6 << 20, 24
#: About so many nodes of a bucket are a block.
BLOCK = 512
#: The chance that two unrelated texts show equal digits in a slot.
CHANCE = 0.08
_SEED = 20240611


@functools.cache
def stays() -> np.ndarray:
    """Row c, column t: how long a character of class c stays if the walk reaches it at time t (modulo the period)."""
    bits = np.random.default_rng(_SEED).integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8)
    bits[:, -1] = 1
    out = np.zeros((CLASSES, PERIOD), np.int32)
    run = np.zeros(CLASSES, np.int32)
    for t in range(PERIOD - 1, -1, -1):
        run = np.where(bits[:, t] == 1, 1, run + 1)
        out[:, t] = run
    return out


@functools.cache
def digits() -> np.ndarray:
    """Each class's 4-bit hash, from 1 to 15; 0 stands for a time after the text's end."""
    return np.random.default_rng(_SEED + 1).integers(1, 16, CLASSES).astype(np.uint8)


@functools.cache
def records(bits: int = 40) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each slot: the lengths from which on its first time changes, and those times.

    The time first in a slot's random order among 0..T-1 changes as T grows only when a new first turns up: among T
    times that's about ln T changes. They are drawn directly: the next record after T comes at T / u, u uniform.
    """
    rng, starts, times = np.random.default_rng(_SEED + 2), [], []
    for _ in range(SLOTS):
        at, own = 1, [0]
        while at < 1 << bits:
            at = int(at / rng.random()) + 1
            own.append(at - 1)
        times.append(np.array(own))
        starts.append(np.array(own) + 1)
    return starts, times


def sampled_times(n: int) -> np.ndarray:
    """The slots' times for a text of ``n`` characters."""
    starts, times = records()
    return np.array([t[np.searchsorted(s, 2 * n, "right") - 1] for s, t in zip(starts, times)])


def walk(lanes: list[np.ndarray]) -> list[np.ndarray]:
    """For each text's classes: the times at which its characters' stays end. All texts step together; the few longest go on alone."""
    table, flat = stays(), stays().ravel()
    order = np.argsort([-len(x) for x in lanes], kind="stable")
    sizes = np.array([len(lanes[i]) for i in order])
    out = [np.zeros(len(x), np.int64) for x in lanes]
    shared = int(sizes[SERIAL]) if len(sizes) > SERIAL else 0  # up to here many texts go on
    now = np.zeros(len(lanes), np.int64)
    if shared:
        active = np.searchsorted(-sizes, -np.arange(1, shared + 1), "right")  # texts with a character at each step
        base = np.concatenate([[0], np.cumsum(active)])
        chars = np.zeros(base[-1], np.int32)
        for rank, i in enumerate(order):
            part = lanes[i][:shared]
            chars[base[: len(part)] + rank] = part
        chars *= PERIOD
        ends = np.zeros(base[-1], np.int64)
        for s in range(shared):
            a = active[s]
            t = now[:a]
            t += flat[chars[base[s] : base[s + 1]] + (t & (PERIOD - 1))]
            ends[base[s] : base[s + 1]] = t
        for rank, i in enumerate(order):
            m = min(len(lanes[i]), shared)
            out[i][:m] = ends[base[:m] + rank]
    for rank in range(min(SERIAL, len(lanes))):
        i = order[rank]
        if len(lanes[i]) > shared:
            t, own, rest = int(now[rank]), [], lanes[i][shared:].tolist()
            rows = [table[c].tolist() for c in range(CLASSES)] if rank == 0 else rows
            for c in rest:
                t += rows[c][t & (PERIOD - 1)]
                own.append(t)
            out[i][shared:] = own
    return out


def classes_of(text: str) -> np.ndarray:
    """A class from 0 to 255 for each character and its follower (none after the last)."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    x = c * np.uint32(0x9E3779B1)
    x[:-1] += c[1:] * np.uint32(0x85EBCA77)
    return (x >> np.uint32(24)).astype(np.int32)


def fingerprints(texts: list[str]) -> list[str]:
    """Hex digits for each text."""
    lanes = [classes_of(t) for t in texts]
    out, hex_of, table = [], np.frombuffer(b"0123456789abcdef", np.uint8), digits()
    for chars, ends in zip(lanes, walk(lanes)):
        if not len(chars):
            out.append("0" * SLOTS)
            continue
        at = np.searchsorted(ends, sampled_times(len(chars)), "right")
        shown = np.where(at < len(chars), table[chars[np.minimum(at, len(chars) - 1)]], 0)
        out.append(hex_of[shown].tobytes().decode())
    return out


def likeness(a: str, b: str) -> float:
    same = float((np.frombuffer(a.encode(), np.uint8) == np.frombuffer(b.encode(), np.uint8)).mean())
    return max(0.0, (same - CHANCE) / (1 - CHANCE))


def edited(text: str, following: str) -> str:
    """``text`` with its last third (rounded down) replaced by as many first characters of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def fingerprint_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    Rows are dealt by ranges of ids, each of which also gets the first row of the range that follows in descending
    order; a row's next is then the row after it. Texts are shuffled once.
    """
    ship(docs.sparkSession)
    least = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    cuts, n = id_buckets(docs, "id", "text", range_bytes, least)
    docs = docs.withColumn("b", bucket_of(F.col("id"), cuts))
    # the largest id of each range; its rows also go, as onlookers, to the range above, and the very first to the lowest
    tops = [tuple(r) for r in docs.groupBy("b").agg(F.max("id").alias("id")).orderBy("b").collect()]  # a row for each range
    above = [tops[(k + 1) % len(tops)][0] for k in range(len(tops))]
    spark = docs.sparkSession
    onlook = spark.createDataFrame([(b, i, a) for (b, i), a in zip(tops, above)], "ob int, oid long, up int")
    joined = docs.join(F.broadcast(onlook), (F.col("b") == F.col("ob")) & F.col("id").eqNullSafe(F.col("oid")), "left")
    dealt = joined.select("id", "text", F.explode(F.array(F.struct(F.col("b").alias("b"), F.lit(0).alias("look")), F.struct(F.col("up").alias("b"), F.lit(1).alias("look")))).alias("s")).where("s.b is not null")
    dealt = dealt.select("s.b", "s.look", "id", "text").repartition("b").sortWithinPartitions(F.col("b"), F.col("look"), F.col("id").desc_nulls_last(), F.col("text"))

    def run(batches):
        import pyarrow as pa

        def pairs():
            held = None  # (range, id, text) that waits for its next
            for batch in batches:
                for b, look, i, text in zip(*(batch.column(k) for k in range(4))):
                    b, look, i, text = b.as_py(), look.as_py(), i.as_py(), text.as_py()
                    if held and held[0] == b:
                        yield held[1], held[2], text
                    held = None if look else (b, i, text)

        def flush(rows):
            texts = list(dict.fromkeys(t for _, a, b in rows for t in (a, b)))
            changed = [edited(a, b) for _, a, b in rows]
            prints = dict(zip(texts, fingerprints(texts)))
            ed = fingerprints(changed)
            own, nxt = [prints[a] for _, a, _ in rows], [prints[b] for _, _, b in rows]
            return pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([len(r[1]) for r in rows], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in changed]),
                pa.array(own),
                pa.array(ed),
                pa.array([likeness(a, b) for a, b in zip(own, ed)]),
                pa.array([likeness(a, b) for a, b in zip(own, nxt)]),
            ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        rows, size = [], 0
        for row in pairs():
            rows.append(row)
            size += len(row[1])
            if len(rows) >= LANES or size >= CHARS:
                yield flush(rows)
                rows, size = [], 0
        if rows:
            yield flush(rows)

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def unpacked(prints: list[bytes]) -> np.ndarray:
    """A row of ``SLOTS`` digits for each packed fingerprint."""
    x = np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), SLOTS // 2)
    return np.concatenate([x >> 4, x & 15], 1)


def slots_for(least: float) -> int:
    """Equal slots that a likeness of ``least`` takes."""
    return math.ceil((least * (1 - CHANCE) + CHANCE) * SLOTS - 1e-9)


def block_links(slots: np.ndarray, own: int, within: bool, equal: int) -> list[tuple[int, int]]:
    """Links among rows of ``slots`` with ``equal`` equal slots or more: of each of the first ``own`` rows with the rows behind
    those and, if ``within``, with one another. Of links that join the same rows only enough to join them are given."""
    label, out = np.arange(len(slots)), []
    for x in range(own):
        at = x + 1 if within else own
        hits = at + np.flatnonzero((slots[at:] == slots[x]).sum(1) >= equal)
        for y in hits[label[hits] != label[x]]:
            if label[y] != label[x]:
                out.append((x, int(y)))
                label[label == label[y]] = label[x]
    return out


def _links_schema():
    import pyarrow as pa

    return pa.schema([("a", pa.string()), ("b", pa.string())])


def beside_leaders(members: DataFrame, equal: int) -> DataFrame:
    """``members(band, f, leader)`` with ``near``: whether f is the band's leader or linked to it."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                f, leader = (unpacked(batch.column(k).to_pylist()) for k in (1, 2))
                near = pa.array((f == leader).sum(1) >= equal)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), near], ["band", "f", "leader", "near"])

    return members.select("band", "f", "leader").mapInArrow(run, "band long, f binary, leader binary, near boolean")


def links_of_blocks(dealt: DataFrame, equal: int) -> DataFrame:
    """Links of every pair of blocks in ``dealt(band, i, j, side, f)``, which is sorted by them."""

    def run(batches):
        import pyarrow as pa

        def links(key, sides):
            prints = sides[0] + sides[1]
            name = lambda k: hashlib.md5(prints[k].hex().encode()).hexdigest()
            return [(name(x), name(y)) for x, y in block_links(unpacked(prints), len(sides[0]), key[1] == key[2], equal)] if prints else []

        key, sides, out = None, ([], []), []
        for batch in batches:
            for band, i, j, side, f in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if (band, i, j) != key:
                    out += links(key, sides)
                    key, sides = (band, i, j), ([], [])
                sides[side].append(f)
            yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in out], schema=_links_schema())
            out = []
        yield pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in links(key, sides)], schema=_links_schema())

    return dealt.mapInArrow(run, "a string, b string")


def similar(prints: DataFrame, least: float = 0.8, bands: int = 16, block: int = BLOCK) -> DataFrame:
    """``prints`` (a table with doc_id and fingerprint) with ``class_id``: the smallest id among texts joined by links of ``least`` likeness or more.

    Rows with equal fingerprints are one node. Nodes that agree in a band of sampled slots are candidates, and every two
    candidates are joined or compared. In a band's bucket all nodes are compared with a leader first; those linked to it
    are joined to one another thereby. The others are compared among themselves and with those, in pairs of blocks of about
    ``block`` nodes that are dealt to all tasks; a pair of blocks gives as many links as join its nodes, never all pairs.
    So no link of texts that share a band is lost. A pair at a likeness of exactly 0.8 (81.6 % equal slots) shares
    one of 16 bands of 8 with probability 1 - (1 - 0.816^8)^16 = 0.97, counting slots as independent.
    """
    ship(prints.sparkSession)
    step, equal, node = SLOTS // bands, slots_for(least), F.md5("fingerprint")
    nodes = staged(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n")), "nodes")
    keys = F.array(*(F.xxhash64(F.lit(k), F.substring("fingerprint", k * step + 1, step)) for k in range(bands)))
    shared = staged(nodes.select(F.explode(keys).alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("many")).where("many > 1").select("band"), "bands")
    members = nodes.select(F.unhex("fingerprint").alias("f"), F.explode(keys).alias("band"))
    few = shared.count() <= BROADCAST_ROWS
    members = staged(members.join(F.broadcast(shared) if few else shared, "band"), "buckets")
    leaders = members.groupBy("band").agg(F.min_by("f", F.xxhash64("f", "band")).alias("leader"))
    members = staged(beside_leaders(members.join(F.broadcast(leaders) if few else leaders, "band"), equal), "members")
    packed = lambda c: F.md5(F.lower(F.hex(c)))
    links = members.where("near and f <> leader").select(packed("leader").alias("a"), packed("f").alias("b"))
    # free nodes are those that aren't linked to the leader; their blocks come first, then those of the others
    sizes = members.groupBy("band").agg(F.count_if(~F.col("near")).alias("free"), F.count_if("near").alias("led")).where("free > 0")
    sizes = sizes.select("band", F.ceil(F.col("free") / block).alias("bf"), F.ceil(F.col("led") / block).alias("bl"), (F.col("free") + F.col("led") <= block).alias("small"))
    sized = members.select("band", "f", "near").join(F.broadcast(sizes) if few else sizes, "band")
    spot = F.pmod(F.xxhash64("f", F.lit(3)), F.when(F.col("near"), F.col("bl")).otherwise(F.col("bf")))
    sized = sized.withColumn("own", (spot + F.when(F.col("near"), F.col("bf")).otherwise(F.lit(0))).cast("int"))
    place = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))
    own, zero = F.col("own"), F.lit(0)
    to_all = F.transform(F.sequence(zero, (F.col("bf") + F.col("bl") - 1).cast("int")), lambda k: place(F.least(k, own), F.greatest(k, own), (k < own).cast("int")))
    to_free = F.transform(F.sequence(zero, (F.col("bf") - 1).cast("int")), lambda k: place(k, own, F.lit(1)))
    places = F.when(F.col("small"), F.array(place(zero, zero, F.col("near")))).when(F.col("near"), to_free).otherwise(to_all)
    dealt = sized.select("band", "f", F.explode(places).alias("at")).select("band", "at.i", "at.j", "at.side", "f")
    found = links_of_blocks(dealt.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "side"), equal)
    roots = components(staged(links.union(found).distinct(), "links"))
    # only nodes of several rows or of a class with others need to be looked up
    own = nodes.withColumn("node", node).join(roots, "node", "left").select("node", "least_id", "n", F.col("root"), F.coalesce("root", "node").alias("top"))
    low = own.where("root is not null").groupBy("top").agg(F.min("least_id").alias("low"))
    own = own.join(low, "top", "left").where("n > 1 or root is not null").select(F.col("node").alias("_ef_n"), F.when(F.col("root").isNull(), F.col("least_id")).otherwise(F.col("low")).alias("_ef_c"))
    own = staged(own, "classes")
    side = F.broadcast(own) if own.count() <= BROADCAST_ROWS else own
    classed = F.when(F.col("_ef_n").isNull(), F.col("doc_id")).otherwise(F.col("_ef_c")).alias("class_id")
    return prints.join(side, node == F.col("_ef_n"), "left").select(*prints.columns, classed)


def fingerprint_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """``fingerprint_neighbours`` with ``class_id``, by ``similar``."""
    return similar(staged(fingerprint_neighbours(docs, id_col, text_col), "fingerprints"), least)


def edit_fingerprint_query(spark, sf_dir: str) -> DataFrame:
    return fingerprint_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
