"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are folded (letters to lower case, all else to a blank) and runs of one, two and three of
them are hashed to a fixed number of features for each length. Training counts features by
language; the model is a matrix of log probabilities in fixed point, so a text's sums, and with them its
prediction, don't depend on how rows meet in batches. It has 3 x 65,536 rows and a column for each
language, whatever the corpus, and is broadcast. Scoring gathers and adds the rows of a text's features in
numpy, text after text in bounded pieces, over the whole of every text.

The model is fitted on a bounded sample of labelled rows: about ``sample`` (2,000) for each language, chosen by
a hash of the id; rows whose crc32(id as text) mod 3 is 1 are held out from it.

Defined results: a text that is null or has no letter is ``und`` with score 0; without any labelled text
all are ``und``; repeated rows are each predicted; an empty table gives an empty result; ties go to the
language first in order. ``score`` is the posterior probability of the prediction.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import id_mod, ship, spread

BITS, ORDERS, POINT, PIECE = 16, 3, 16, 1 << 20
SIZE = ORDERS << BITS
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@functools.cache
def fold_table() -> np.ndarray:
    """Each code point's folded character: its small letter, or a blank."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            table[c] = ord(ch.lower()[0])
    table[0] = 0
    return table


def folded(text: str) -> np.ndarray:
    return fold_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def features(chars: np.ndarray) -> list[np.ndarray]:
    """Hashed features of each length that start at each of ``chars`` but the last two, which only follow."""
    h = chars[:-2] * _MIX[0]
    out = []
    for k in range(ORDERS):
        if k:
            h = (h ^ (h >> np.uint32(13))) * _MIX[1] + chars[k : len(chars) - 2 + k] * _MIX[2]
        x = (h ^ (h >> np.uint32(15))) * _MIX[2]
        out.append(((x >> np.uint32(32 - BITS)) + np.uint32(k << BITS)).astype(np.int64))
    return out


def pieces(texts: list[str]):
    """(index, folded characters) of ``texts``, in pieces of bounded size that overlap by what the longest feature needs."""
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text)), PIECE):
            part = text[at : at + PIECE + 2]
            if at and len(part) <= 2:
                break
            last = at + PIECE + 2 >= len(text)
            yield i, folded(part + "\0\0" if last else part)
            if last:
                break


def text_counts(text: str) -> np.ndarray:
    total = np.zeros(SIZE, np.int64)
    for _, chars in pieces([text]):
        for f in features(chars):
            total += np.bincount(f, minlength=SIZE)
    return total


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 2000, smoothing: float = 0.1):
    """(languages, fixed-point matrix of SIZE x languages, fixed-point priors), from the rows that aren't held out."""
    ship(docs.sparkSession)
    mine = docs.where((id_mod(F.col(id_col), 3) != 1) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in mine.groupBy(F.col(lang_col).cast("string")).count().collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((SIZE, 0), np.int32), np.zeros(0, np.int64)
    rate = functools.reduce(lambda c, x: c.when(F.col(lang_col).cast("string") == x, F.lit(sample / sizes[x])), langs, F.when(F.lit(False), F.lit(0.0))).otherwise(0.0)
    mine = mine.where(spread(F.col(id_col)) < rate)

    def count(batches):
        import pyarrow as pa

        totals: dict[str, np.ndarray] = {}

        def rows():
            for lang, n in totals.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(n[at])], ["lang", "feature", "n"])
            totals.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if lang not in totals:
                    if len(totals) >= 50:
                        yield from rows()
                    totals[lang] = np.zeros(SIZE, np.int64)
                for _, chars in pieces([text.as_py()]):
                    for f in features(chars):
                        totals[lang] += np.bincount(f, minlength=SIZE)
        yield from rows()

    found = mine.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).mapInArrow(count, "lang string, feature long, n long")
    n = found.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()  # at most SIZE rows for each language
    counts = np.full((SIZE, len(langs)), smoothing)
    counts[n["feature"].to_numpy(), np.searchsorted(langs, n["lang"].to_numpy(str))] += n["n"].to_numpy()
    by_order = counts.reshape(ORDERS, 1 << BITS, -1)
    logs = np.log(by_order / by_order.sum(1, keepdims=True)).reshape(SIZE, -1)
    prior = np.log([sizes[x] / sum(sizes.values()) for x in langs])
    return langs, np.round(logs * (1 << POINT)).astype(np.int32), np.round(prior * (1 << POINT)).astype(np.int64)


def score(texts: list[str], matrix: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of log probabilities (text x language, fixed point), and which texts have a letter."""
    sums, letters = np.tile(prior, (len(texts), 1)), np.zeros(len(texts), bool)
    at, size, hold = [], 0, []

    def add():
        starts = np.cumsum([0, *(len(c) for c in hold)])[:-1]
        chars = np.concatenate(hold)
        # each piece ends with two characters that only follow; those windows are left out of its sum
        ends = starts + np.array([len(c) for c in hold]) - 2
        got = np.zeros((len(chars), matrix.shape[1]), np.int64)
        for f in features(chars):
            got[:-2] += matrix[f]
        bounds = np.minimum(np.stack([starts, ends], 1).ravel(), len(chars) - 1)
        np.add.at(sums, at, np.where((ends > starts)[:, None], np.add.reduceat(got, bounds, axis=0)[::2], 0))
        some = np.add.reduceat(((chars != 32) & (chars != 0)).astype(np.int64), starts) > 0
        np.logical_or.at(letters, at, some)
        at.clear()
        hold.clear()

    for i, chars in pieces(texts):
        at.append(i)
        hold.append(chars)
        size += len(chars)
        if size >= PIECE:
            add()
            size = 0
    if hold:
        add()
    return sums, letters


def predict(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``; ``model`` as ``fit`` gives it."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        langs, matrix, prior = sent.value
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(2)]
            if langs:
                sums, letters = score(texts, matrix, prior)
                best = sums.argmax(1)
                p = 1 / np.exp((sums - sums.max(1, keepdims=True)) / (1 << POINT)).sum(1)
            else:
                best, p, letters = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool)
            names = [langs[b] if ok else "und" for b, ok in zip(best, letters)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(np.where(letters, p, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (id_mod(F.col(id_col), 3) == 1).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def language_id_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs))
