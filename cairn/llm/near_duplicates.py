"""Near duplicates by improved consistent weighted sampling over TF-IDF shingles.

Shingles are runs of five words (``\\w+``, lower case); a text of one to four words is one shingle. A shingle's
weight in a text is its count there times 1 + ``idf`` * ln((N + 1) / (df + 1)) / ln(N + 1). N and df cover all
documents; df comes from a count sketch of 2^18 cells, so a rare shingle counts as found in about as many
documents as share its cell, and the model's size doesn't grow with the corpus. Weights are kept in
steps of 1/16 on a logarithmic scale.

Improved consistent weighted sampling draws BANDS x ROWS samples from each text: two texts agree in one
with their weighted Jaccard similarity as probability. The draws of r, c and beta come from a table by
a hash of the shingle, and so does, for each weight step, the sampled value itself. Texts that agree in all
ROWS samples of a band are candidates (at 0.8: 99.98 % of pairs in some band); weighted Jaccard similarity
over all shingles decides.

Equal texts are one node from the start. A band's bucket may be large, so its pairs are never all
listed: in each of a few rounds every bucket has one node (that with the most links so far) compared with
the bucket's nodes of other classes; links join classes, and a bucket of one class is done. What's
left undecided after the rounds is decided exactly. Let shingles stand in order of rarity: before the first
that two texts of weights a and b share, either may hold no more than its weight less t / (1 + t) * (a + b), as
the rest must hold what they share. So nodes of different classes that share a shingle so early are
compared, and no others need to be. No link is lost to a cap.

Defined results: a null text counts as empty; texts without words are alike only if equal; repeated rows belong to
one class; a class's id is its smallest document id (null if it has none); an empty table gives an empty result; other
columns are ignored by ``classes`` and passed through by ``distinct_documents``, which keeps exactly one row of each class
whatever the ids are.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import BROADCAST_ROWS, components, new_folder, ship, short_batches, staged, text_or_empty, tidy

WORDS, LEAST, BANDS, ROWS, CELLS, STEPS, DRAWS = 5, 0.8, 16, 4, 18, 256, 14
ROUNDS, HOT, CHUNK = 2, 256, 1 << 19
#: The most nodes that count as hot: a longer list raises what a node needs to be one.
HOT_NODES = 100_000
WORD = re.compile(r"\w+")
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
#: A weight step's weight, as a whole number.
WEIGHT = np.round(np.exp(np.arange(STEPS) / 16) * 1024).astype(np.int64)


@functools.cache
def draws() -> np.ndarray:
    """For each weight step and draw: the sampled value (24 bits, smaller wins) and the low 8 bits of its t."""
    rng = np.random.default_rng(77)
    n = 1 << DRAWS
    r, log_c, beta = rng.gamma(2, 1, n), np.log(rng.gamma(2, 1, n)), rng.random(n)
    out = np.empty((STEPS, n), np.uint32)
    for step in range(STEPS):
        t = np.floor(step / 16 / r + beta)
        log_a = log_c - r * (t - beta + 1)
        value = np.clip((log_a + 60) / 65 * (1 << 24), 0, (1 << 24) - 1).astype(np.uint32)
        out[step] = value << np.uint32(8) | (t.astype(np.int64) & 0xFF).astype(np.uint32)
    return out.ravel()


@functools.cache
def sample_factors() -> np.ndarray:
    return np.random.default_rng(78).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        b = word.encode()
        h = zlib.crc32(b) << 32 | zlib.crc32(b, 0x5BD1E995)
        if len(self) < 100_000:
            self[word] = h
        return h


_hashes = _WordHashes()


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's index, 64-bit hash, count) of every text's distinct shingles, sorted by text and hash."""
    lens, parts = [], []
    for text in texts:
        words = WORD.findall(text.lower())
        lens.append(len(words))
        parts.append(np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words)))
    lens = np.array(lens, np.int64)
    w = np.concatenate([*parts, np.zeros(WORDS, np.uint64)])
    total = len(w) - WORDS
    h = np.zeros(total, np.uint64)
    starts = np.cumsum(lens) - lens
    owner = np.repeat(np.arange(len(texts)), lens)
    left = lens[owner] - (np.arange(total) - starts[owner]) if total else np.zeros(0, np.int64)
    short = np.minimum(lens, WORDS)[owner] if total else left
    for k in range(WORDS):  # a short text's only shingle takes the words that it has
        x = (w[k : total + k] + np.uint64(k + 1)) * _FACTORS[k]
        h += np.where(short > k, x ^ (x >> np.uint64(29)), np.uint64(0))
    h ^= h >> np.uint64(32)
    h *= _FACTORS[0]
    h ^= h >> np.uint64(29)
    whole = left >= short
    owner, h = owner[whole], h[whole]
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], h[at], np.diff(np.append(at, len(h)))


def cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - CELLS)).astype(np.int64)


def weight_steps(h: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return np.clip(np.round(np.log(counts * idf[cell(h)]) * 16), 0, STEPS - 1).astype(np.int64)


def inverse_frequency(df: np.ndarray, n: int, idf: float) -> np.ndarray:
    return np.maximum(1.0, 1 + idf * np.log((n + 1) / (df + 1)) / np.log(n + 1)) if n else np.ones(len(df))


def samples(h: np.ndarray, steps: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(text x sample) 64-bit values; texts' shingles begin at ``starts``."""
    table, base = draws(), steps << DRAWS
    out = np.empty((len(starts), BANDS * ROWS), np.uint64)
    for k, f in enumerate(sample_factors()):
        x = h * f
        x ^= x >> np.uint64(32)
        x *= _FACTORS[1]
        v = table[base + (x >> np.uint64(64 - DRAWS)).astype(np.int64)].astype(np.uint64) << np.uint64(32)
        v |= (x >> np.uint64(10)) & np.uint64(0xFFFFFFFF)
        out[:, k] = np.minimum.reduceat(v, starts)
    return out & np.uint64(0xFF_FFFFFFFF)  # t and the shingle; the value itself has served


def band_keys(found: np.ndarray) -> np.ndarray:
    """(text x band) keys."""
    key = np.zeros((len(found), BANDS), np.uint64)
    for r in range(ROWS):
        x = (key ^ found[:, r::ROWS]) * _FACTORS[2 + r % 3]
        key = x ^ (x >> np.uint64(31))
    key = (key + np.arange(1, BANDS + 1, dtype=np.uint64)) * _FACTORS[3]
    return (key ^ (key >> np.uint64(30))).view(np.int64)


def chunks(batch, column: int):
    """Slices of an Arrow batch with bounded text, for numpy."""
    start, size = 0, 0
    for k, t in enumerate(batch.column(column)):
        size += len(t.as_buffer() or b"")
        if size >= 4 * CHUNK:
            yield batch.slice(start, k + 1 - start)
            start, size = k + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def document_frequencies(texts: DataFrame) -> np.ndarray:
    """Documents by cell, over the column ``text`` of all rows. Executors' sketches are summed in 64 blocks."""
    ship(texts.sparkSession)
    width = (1 << CELLS) // 64

    def count(batches):
        import pyarrow as pa

        total = np.zeros(1 << CELLS, np.int64)
        for batch in batches:
            for part in chunks(batch, 0):
                _, h, _ = shingles([t.as_py() for t in part.column(0)])
                total += np.bincount(cell(h), minlength=1 << CELLS)
        yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([zlib.compress(total[k * width : (k + 1) * width].astype("<i8").tobytes(), 1) for k in range(64)])], ["block", "cells"])

    def add(key, table):
        import pyarrow as pa

        total = np.zeros(width, np.int64)
        for c in table.column("cells"):
            total += np.frombuffer(zlib.decompress(c.as_py()), "<i8")
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([total.tobytes()])})

    rows = texts.mapInArrow(tidy(count), "block int, cells binary").groupBy("block").applyInArrow(add, "block int, cells binary").collect()  # 2^18 numbers
    out = np.zeros(1 << CELLS, np.int64)
    for block, cells in rows:
        out[block * width : (block + 1) * width] = np.frombuffer(cells, "<i8")
    return out


def signatures(rows: DataFrame, sent) -> DataFrame:
    """node, weight, bands for each row of ``rows(node, text)``; texts without words give none."""

    def run(batches):
        import pyarrow as pa

        df, idf = sent.value
        for batch in batches:
            for part in chunks(batch, 1):
                owner, h, counts = shingles([t.as_py() for t in part.column(1)])
                if not len(h):
                    continue
                steps = weight_steps(h, counts, idf)
                starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                keys = band_keys(samples(h, steps, starts))
                weight = np.add.reduceat(WEIGHT[steps], starts)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner[starts])), pa.array(weight), bands], ["node", "weight", "bands"])

    return rows.mapInArrow(tidy(run), "node string, weight long, bands array<long>")


def shingle_sets(rows: DataFrame, sent) -> DataFrame:
    """node, hashes (64-bit, ascending), steps for each row of ``rows(node, text)``."""

    def run(batches):
        import pyarrow as pa

        df, idf = sent.value
        for batch in batches:
            for part in chunks(batch, 1):
                owner, h, counts = shingles([t.as_py() for t in part.column(1)])
                steps = weight_steps(h, counts, idf).astype(np.uint8)
                h = h.astype("<u8")
                ends = np.searchsorted(owner, np.arange(part.num_rows), "right")
                begins = np.concatenate([[0], ends[:-1]])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([h[a:b].tobytes() for a, b in zip(begins, ends)]), pa.array([steps[a:b].tobytes() for a, b in zip(begins, ends)])], ["node", "hashes", "steps"])

    return rows.mapInArrow(tidy(run), "node string, hashes binary, steps binary")


def weighted_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    same = hb[at] == ha
    low = np.minimum(wa[same], wb[at[same]]).sum()
    return float(low / (wa.sum() + wb.sum() - low))


def with_sets(pairs: DataFrame, key: str, counts: DataFrame, sets: DataFrame, names: tuple[str, str]) -> DataFrame:
    """``pairs`` with the shingles and steps of the node in column ``key``, named as ``names``.

    ``counts(node, n)`` says in how many pairs a node is. One in more than HOT (or in more than a HOT_NODES-th
    of all) has its pairs dealt out by salts, and its set to each of them; there are at most HOT_NODES such nodes.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = max(HOT, total // HOT_NODES)
    many = staged(counts.where(F.col("n") > hot).select(F.col("node").alias("_hot"), F.ceil(F.col("n") / hot).cast("int").alias("_salts")), "hot-nodes")
    own = sets.select(F.col("node").alias("_own"), F.col("hashes").alias(names[0]), F.col("steps").alias(names[1]))
    if many.isEmpty():
        return pairs.join(own, F.col(key) == F.col("_own")).drop("_own")
    many = F.broadcast(many)  # at most HOT_NODES rows
    cold = pairs.join(many, F.col(key) == F.col("_hot"), "left_anti").join(own, F.col(key) == F.col("_own")).drop("_own")
    salted = pairs.join(many, F.col(key) == F.col("_hot")).withColumn("_salt", F.pmod(F.xxhash64("a", "b"), F.col("_salts")).cast("int")).drop("_hot", "_salts")
    own = own.join(many, F.col("_own") == F.col("_hot")).withColumn("_salt2", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_hot", "_salts")
    # by merge: a broadcast, chosen at run time, would read the salted rows as they were written, file by file
    return cold.unionByName(salted.join(own.hint("merge"), (F.col(key) == F.col("_own")) & (F.col("_salt") == F.col("_salt2"))).drop("_own", "_salt", "_salt2"))


def judge(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """``pairs(a, b)`` that have a weighted Jaccard similarity of ``least`` or more, as ``a, b``. A node in many pairs is dealt out."""
    counts = [pairs.groupBy(F.col(k).alias("node")).agg(F.count(F.lit(1)).alias("n")) for k in "ab"]
    both = with_sets(with_sets(pairs, "a", counts[0], sets, ("ha", "sa")), "b", counts[1], sets, ("hb", "sb")).select("a", "b", "ha", "sa", "hb", "sb")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            near = []
            for ha, sa, hb, sb in zip(*(batch.column(k) for k in range(2, 6))):
                a, b = np.frombuffer(ha.as_buffer(), "<u8"), np.frombuffer(hb.as_buffer(), "<u8")
                near.append(weighted_jaccard(a, WEIGHT[np.frombuffer(sa.as_buffer(), np.uint8)], b, WEIGHT[np.frombuffer(sb.as_buffer(), np.uint8)]) >= least)
            kept = batch.filter(pa.array(near, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])

    return both.mapInArrow(tidy(run), "a string, b string")


def rare_shingles(sets: DataFrame, sent, least: float) -> DataFrame:
    """node, shingle, before: each set's rarest shingles, as far as one may be the first shared with a similar set, and the weight before each."""

    def run(batches):
        import pyarrow as pa

        df, _ = sent.value
        for batch in batches:
            nodes, out, before = [], [], []
            for node, hashes, steps in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                h, w = np.frombuffer(hashes.as_buffer(), "<u8"), WEIGHT[np.frombuffer(steps.as_buffer(), np.uint8)]
                order = np.lexsort((h, df[cell(h)]))
                past = np.cumsum(w[order]) - w[order]
                n = int(np.searchsorted(past, (1 - least) * w.sum(), "right"))
                nodes += [node] * n
                out.append(h[order[:n]])
                before.append(past[:n])
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(np.concatenate([*out, none.view(np.uint64)]).view(np.int64)), pa.array(np.concatenate([*before, none]))], ["node", "shingle", "before"])

    return sets.select("node", "hashes", "steps").mapInArrow(tidy(run), "node string, shingle long, before long")


def grouped(docs: DataFrame, id_col: str, text_col: str, least: float, idf: float, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) for each row, and a row (node, low, n, root) for each distinct text: its smallest id, how many rows have it, and its class's root."""
    spark = docs.sparkSession
    ship(spark)
    text = text_or_empty(F.col(text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.md5(text).alias("node"), text.alias("text"))
    df = document_frequencies(rows.select("text"))
    n = rows.count()
    sent = spark.sparkContext.broadcast((df, inverse_frequency(df, n, idf)))  # 2^18 numbers each

    signed = staged(signatures(rows.select("node", "text"), sent).dropDuplicates(["node"]), "signatures")
    keyed = signed.select("node", "weight", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    members = staged(keyed.join(shared, "band").select("band", "node", "weight", F.col("node").alias("root"), F.lit(0).alias("links"), F.lit(False).alias("used")), "buckets")
    wanted = staged(members.select(F.col("node").alias("node2")).distinct(), "candidates")

    links = spark.createDataFrame([], "a string, b string")
    roots = spark.createDataFrame([], "node string, root string")
    if (many := wanted.count()) > 1:
        first = rows.join(F.broadcast(wanted) if many <= BROADCAST_ROWS else wanted, F.col("node") == F.col("node2"), "left_semi").select("node", "text")
        at, name = new_folder(spark, "shingles"), f"cairn_sets_{new_folder(spark, 'x').rsplit('-', 1)[1]}"
        # a join with the buckets has as many tasks as there are buckets: fewer than other joins have would make each the larger
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(4096, many // 4000))
        made = shingle_sets(first, sent).dropDuplicates(["node"]).repartition(parts, "node")
        made.write.bucketBy(parts, "node").sortBy("node").option("path", at).option("compression", "zstd").saveAsTable(name)
        sets = spark.table(name)  # joins on node don't shuffle it again
        try:
            tried = None
            for turn in range(rounds + 1):
                if members.isEmpty():
                    break
                if turn < rounds:
                    lead = F.struct(~F.col("used"), F.col("links"), F.md5(F.concat_ws(":", F.col("node"), F.col("band"))), F.col("node"), F.col("root"), F.col("weight"))
                    firsts = members.groupBy("band").agg(F.max(lead).alias("l")).select("band", F.col("l.node").alias("b"), F.col("l.root").alias("rb"), F.col("l.weight").alias("wb"))
                    firsts = staged(firsts, "firsts")
                    pairs = members.join(firsts, "band").where("root <> rb").select(F.col("node").alias("a"), "b", F.col("weight").alias("wa"), "wb")
                else:  # exactly, for what the rounds have left undecided
                    nodes = members.select("node", "weight", "root").distinct()
                    rare = rare_shingles(sets.join(nodes.select("node"), "node", "left_semi"), sent, least)
                    rare = staged(rare.join(nodes, "node"), "rare")
                    other = rare.select("shingle", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("weight").alias("wb"), F.col("before").alias("bb"))
                    shared = (F.col("weight") + F.col("wb")) * (least / (1 + least))
                    early = (F.col("before") <= F.col("weight") - shared) & (F.col("bb") <= F.col("wb") - shared)
                    here = (rare["shingle"] == other["shingle"]) & (F.col("root") != F.col("rb")) & (F.col("node") < F.col("b")) & early
                    pairs = rare.join(other, here).select(F.col("node").alias("a"), "b", F.col("weight").alias("wa"), "wb")
                pairs = pairs.where((F.col("wa") >= least * F.col("wb")) & (F.col("wb") >= least * F.col("wa"))).select("a", "b").distinct()
                if tried is not None:
                    pairs = pairs.join(tried, ["a", "b"], "left_anti")
                pairs = staged(pairs, "pairs")
                found = staged(judge(pairs, sets, least), "links")
                tried = pairs if tried is None else tried.union(pairs)
                links = links.union(found)
                if not found.isEmpty():
                    roots = components(links)
                if turn == rounds:
                    break
                degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count(F.lit(1)).cast("int").alias("links"))
                now = members.drop("root", "links").join(roots, "node", "left").join(degree, "node", "left").join(firsts.select("band", F.col("b").alias("node"), F.lit(True).alias("now")), ["band", "node"], "left")
                now = now.select("band", "node", "weight", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"), (F.col("used") | F.coalesce("now", F.lit(False))).alias("used"))
                now = staged(now, "buckets")
                split = now.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count_if(~F.col("used")).alias("free")).where("lo <> hi and free > 0").select("band")
                members = staged(now.join(split, "band", "left_semi"), "buckets")
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")  # the files stay until the session ends

    own = rows.select("doc_id", "node")
    info = own.groupBy("node").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
    info = info.join(roots, "node", "left").select("node", "low", "n", F.coalesce("root", "node").alias("root"))
    return own, staged(info, "nodes")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, idf: float = 0.5, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, class_id, class_size (rows) for each row of ``docs``."""
    with short_batches(docs.sparkSession):
        own, info = grouped(docs, id_col, text_col, least, idf, rounds)
    whole = info.groupBy("root").agg(F.min("low").alias("class_id"), F.sum("n").alias("class_size"))
    by_node = info.join(whole, "root").select("node", "class_id", "class_size")
    return own.join(by_node, "node").select("doc_id", "class_id", "class_size")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST, idf: float = 0.5, rounds: int = ROUNDS) -> DataFrame:
    """Exactly one row of ``docs`` for each class: that with the smallest id (null ids last), then text digest; of repeated rows any."""
    with short_batches(docs.sparkSession):
        own, info = grouped(docs, id_col, text_col, least, idf, rounds)
    first = F.min(F.struct(F.col("low").isNull(), F.col("low").alias("low"), F.col("node").alias("node")))
    keepers = info.groupBy("root").agg(first.alias("k")).select(F.col("k.node").alias("kept"), "k.low")
    rows = own.groupBy("doc_id", "node").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(keepers, (F.col("node") == F.col("kept")) & F.col("doc_id").eqNullSafe(F.col("low")), "left")
    rows = rows.select(F.col("doc_id").alias("_nd_id"), F.col("node").alias("_nd_node"), F.col("kept").isNotNull().alias("stays"), "n")
    rows = staged(rows.where("n > 1 or not stays"), "verdicts")

    def side(which: DataFrame) -> DataFrame:
        which = which.select("_nd_id", "_nd_node")
        return F.broadcast(which) if which.count() <= BROADCAST_ROWS else which

    here = F.col(id_col).cast("long").eqNullSafe(F.col("_nd_id")) & (F.md5(text_or_empty(F.col(text_col))) == F.col("_nd_node"))
    left = docs.join(side(rows.where("not stays")), here, "left_anti")
    if (repeated := rows.where("stays")).isEmpty():
        return left
    repeated = side(repeated)
    one = left.join(repeated, here, "left_semi").withColumns({"_nd_i": F.col(id_col).cast("long"), "_nd_n": F.md5(text_or_empty(F.col(text_col)))})
    return left.join(repeated, here, "left_anti").unionByName(one.dropDuplicates(["_nd_i", "_nd_n"]).drop("_nd_i", "_nd_n"))


def near_duplicates_query(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
