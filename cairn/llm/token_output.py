"""Token ids in a binary file format: frequency-ranked ids, byte-aligned variable length, control bytes apart.

Ids are ranked by their frequency in the whole corpus, so frequent ids have small ranks. A rank takes 1
to 4 bytes, little-endian; its length less one is 2 bits of a control byte, which serves four ranks
(the first in the lowest bits). A document's control bits start on a byte of their own.

A shard holds the documents of one range of ids, ascending, or a part of them if they are many. Its file: 8 bytes ``CRNVB001``; number of
documents, of control bytes and of data bytes (three unsigned 64-bit); for each document its id
(signed 64-bit, the smallest for a null id) and number of tokens (unsigned 64-bit); all control bytes;
all data bytes; CRC-32 of all before (unsigned 32-bit). Numbers are little-endian. ``table.bin`` beside the shards
has the ids by rank (unsigned 32-bit). Decoding takes lengths from a 256-row table by control byte.

Defined results: a null or empty text has its end id only; documents with equal ids are ordered by
their number of tokens and their codes; an empty table gives no shard and an empty result.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import bucket_of, id_buckets, new_folder, ship, short_batches, staged, text_or_empty, tidy
from cairn.llm.tokens import encoder, tokenizer_path, with_end

MAGIC, END_ID, NO_ID, SHARD_BYTES = b"CRNVB001", 1, -(1 << 63), 64 << 20
#: Row c: the lengths of the four ranks that control byte c serves.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def encode_all(ranks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents' control bytes and data bytes, each with every document's number of them."""
    ranks = np.ascontiguousarray(ranks, "<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= extra[:, None]]
    sizes = -(-counts // 4)
    four = np.zeros(int(sizes.sum()) * 4, np.uint8)
    four[np.arange(len(ranks)) + np.repeat(4 * (np.cumsum(sizes) - sizes) - (np.cumsum(counts) - counts), counts)] = extra
    four = four.reshape(-1, 4)
    before = np.append(0, np.cumsum(extra + np.int64(1)))
    ends = np.cumsum(counts)
    return four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6, sizes, data, before[ends] - before[ends - counts]


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of one document's ranks."""
    control, _, data, _ = encode_all(ranks, np.array([len(ranks)]))
    return control.tobytes(), data.tobytes()


def binaries(values: np.ndarray, sizes: np.ndarray):
    """An Arrow column of ``sizes`` bytes each, cut from ``values``; 32-bit offsets."""
    import pyarrow as pa

    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def numbers(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of ``width`` bytes in an Arrow column of binaries, and how many each has."""
    if not len(column):
        return np.zeros(0, f"<u{width}"), np.zeros(0, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    values = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return np.ascontiguousarray(values).view(f"<u{width}"), np.diff(offsets) // width


def decode_ranks(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All documents' ranks: lengths by table lookup, then a gather of each length's bytes."""
    per_doc = -(-counts // 4) * 4
    lengths = LENGTHS[control].ravel()
    if (per_doc != counts).any():  # the last control byte of a document may serve fewer than four
        ends, real = np.cumsum(per_doc), np.ones(len(lengths), bool)
        for k in (1, 2, 3):
            real[(ends - k)[per_doc - counts >= k]] = False
        lengths = lengths[real]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    ranks = data[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(lengths > k)
        ranks[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def shard_bytes(ids: list, counts: list, control: list[bytes], data: list[bytes]) -> bytes:
    heads = np.array([ids, counts], "<i8").T.tobytes()
    c, d = b"".join(control), b"".join(data)
    body = b"".join((MAGIC, struct.pack("<3Q", len(ids), len(c), len(d)), heads, c, d))
    return body + struct.pack("<I", zlib.crc32(body))


def parse_shard(content: bytes, by_rank: np.ndarray):
    """doc ids, token counts and all token ids of a shard; raises ValueError if it's damaged."""
    if content[:8] != MAGIC or zlib.crc32(content[:-4]) != struct.unpack("<I", content[-4:])[0]:
        raise ValueError("not a whole shard")
    n, c, d = struct.unpack_from("<3Q", content, 8)
    heads = np.frombuffer(content, "<i8", 2 * n, 32).reshape(-1, 2)
    at = 32 + 16 * n
    control, data = np.frombuffer(content, np.uint8, c, at), np.frombuffer(content, np.uint8, d, at + c)
    return heads[:, 0], heads[:, 1], by_rank[decode_ranks(control, data, heads[:, 1])]


def tokenised(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, ids: each document's token ids with the end id, in 2 bytes each if the vocabulary allows, else 4."""
    ship(docs.sparkSession)

    def encode(batches):
        import pyarrow as pa

        enc = encoder(path)
        width = 2 if max(enc.size, end_id + 1) <= 1 << 16 else 4
        for batch in batches:
            at = 0
            for ids, counts in enc.batch(batch.column(1)):
                ids, counts = with_end(ids, counts, end_id)
                widths = pa.array(np.full(len(counts), width, np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(counts)), binaries(ids.astype(f"<u{width}"), counts * width), widths], ["doc_id", "ids", "width"])
                at += len(counts)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text")).mapInArrow(tidy(encode, "encoders"), "doc_id long, ids binary, width int")


def frequency_ranks(tokens: DataFrame) -> np.ndarray:
    """Ids by rank: the most frequent in all documents first, ties by id. The driver gets one row for each id of the vocabulary."""

    def count(batches):
        import pyarrow as pa

        total = np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            n = np.bincount(numbers(batch.column(0), batch.column(1)[0].as_py())[0])  # one width for all of a run's rows
            if len(n) > len(total):
                total = np.pad(total, (0, len(n) - len(total)))
            total[: len(n)] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    rows = tokens.select("ids", "width").mapInArrow(tidy(count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return rows.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy("<u4")


def write_tokens(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", shard_text: int = 8 << 20) -> DataFrame:
    """Write shards of all ``docs`` under the URI ``folder``; a row (shard, part, path, documents, tokens) for each."""
    with short_batches(docs.sparkSession, 2000):
        return _written(docs, folder, path, end_id, id_col, text_col, shard_text)


def _written(docs: DataFrame, folder: str, path: str, end_id: int, id_col: str, text_col: str, shard_text: int) -> DataFrame:
    from pyarrow import fs

    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts, _ = id_buckets(docs, id_col, text_col, shard_text, least)
    tokens = staged(tokenised(docs, path, end_id, id_col, text_col), "token-ids")
    by_rank = frequency_ranks(tokens)
    store, top = fs.FileSystem.from_uri(folder)
    store.create_dir(top, recursive=True)
    with store.open_output_stream(f"{top}/table.bin", compression=None) as f:
        f.write(by_rank.tobytes())
    rank_of = np.zeros(int(by_rank.max(initial=0)) + 1, "<u4")
    rank_of[by_rank] = np.arange(len(by_rank), dtype="<u4")
    sent = tokens.sparkSession.sparkContext.broadcast(rank_of)  # one number for each id of the vocabulary

    def encode(batches):
        import pyarrow as pa

        rank = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, counts = numbers(batch.column("ids"), batch.column("width")[0].as_py())
            control, sizes, data, lens = encode_all(rank[ids], counts)
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("doc_id"), pa.array(counts), binaries(control, sizes), binaries(data, lens)], ["shard", "doc_id", "n", "control", "data"])

    def write(batches):
        import pyarrow as pa

        store, top = fs.FileSystem.from_uri(folder)
        now, part, size, held = None, 0, 0, ([], [], [], [])

        def close():
            name = f"{top}/shard-{now:08d}-{part:06d}.vb"
            own = f"{name}.{uuid.uuid4().hex}.tmp"
            with store.open_output_stream(own, compression=None) as f:
                f.write(shard_bytes(*held))
            store.move(own, name)  # a retried task writes the same bytes to the same name
            row = pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([part], pa.int32()), pa.array([name]), pa.array([len(held[0])]), pa.array([sum(held[1])])], ["shard", "part", "path", "documents", "tokens"])
            for x in held:
                x.clear()
            return row

        for batch in batches:
            for shard, doc, n, c, d in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if held[0] and (shard != now or size >= SHARD_BYTES):
                    yield close()
                    part, size = (part + 1 if shard == now else 0), 0
                now = shard
                size += len(c) + len(d)
                for x, v in zip(held, (NO_ID if doc is None else doc, n, c, d)):
                    x.append(v)
        if held[0]:
            yield close()

    coded = tokens.withColumn("shard", bucket_of(F.col("doc_id"), cuts)).mapInArrow(tidy(encode), "shard int, doc_id long, n long, control binary, data binary")
    dealt = coded.repartition("shard").sortWithinPartitions("shard", "doc_id", "n", "control", "data")
    return staged(dealt.mapInArrow(tidy(write), "shard int, part int, path string, documents long, tokens long"), "shards")


def read_tokens(spark, folder: str, shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files; ``ids`` too if asked for."""
    from pyarrow import fs

    ship(spark)
    store, top = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{top}/table.bin", compression=None) as f:
        sent = spark.sparkContext.broadcast(np.frombuffer(f.read(), "<u4"))
    # one row for each shard in one task: a running sum of their tokens
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("shard", "part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                shard, part = map(int, re.search(r"shard-(\d+)-(\d+)\.vb$", path.as_py()).groups())
                docs, counts, ids = parse_shard(content.as_py(), sent.value)
                ends = np.cumsum(counts)
                raw = np.ascontiguousarray(ids, "<u4").tobytes()
                parts = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), counts.tolist())]
                cols = [pa.array([shard] * len(docs), pa.int32()), pa.array([part] * len(docs), pa.int32()), pa.array(docs, mask=docs == NO_ID), pa.array(ends - counts), pa.array(counts), pa.array([zlib.crc32(p) for p in parts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(parts, pa.binary())] * with_ids, ["shard", "part", "doc_id", "at", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.vb").load(folder).select("path", "content")
    rows = files.mapInArrow(tidy(read), "shard int, part int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    out = rows.join(F.broadcast(bases), ["shard", "part"])  # as many rows as files
    return out.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] * with_ids))


def token_output_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = new_folder(spark, "token-files")
    shards = write_tokens(docs, folder, tokenizer_path("word_bpe_49k.json"))
    return read_tokens(spark, folder, shards)
