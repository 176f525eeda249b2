"""Toxicity: a linear-chain conditional random field tags toxic spans; its marginals give document scores.

Labels mark documents only, so tokens are labelled first: in toxic documents, those with a word or a word
beginning that's found in toxic documents far more often than in clean ones. The field has two tags. A
token's emission sums weights of hashed features (the word, its first 3 to 6 and last 3 and 4 letters);
transitions link neighbours. It's trained by AdaGrad on windows around labelled tokens and on four windows
of each clean document. A text with more than ``windows`` (8) labelled tokens gives so many windows, spread evenly over it. Forward-backward then gives every token's probability of being toxic; a document's
score is a logistic function of its largest marginal and of how many are 0.5 or more, fitted on the same sample.
Spans are runs of tokens with 0.5 or more, as offsets in code points, ends exclusive.

The model is fitted on a bounded sample of distinct labelled texts: about ``sample`` (2,000) for each label, chosen by
a hash of the text; rows whose crc32(id as text) mod 5 is 0 are held out. Features are hashed to 2^18 weights.
Scoring reads whole texts, in chains of 128 tokens that also see up to 16 tokens on either side.

Defined results: a null or empty text has score 0 (label 0), or the share of toxic rows if no text could be
learnt from; without labels of both kinds the score is that share; repeated rows are each scored; a row
or text labelled more than once is learnt by its highest label; an empty table gives an empty result; other
columns pass through ``score_documents`` unless named like a result column. Texts go to Python once and don't come
back unless they are among the columns to carry: ``clean_documents`` gets digests of toxic texts and
filters the rows by them.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import BROADCAST_ROWS, id_mod, ship, short_batches, spread, staged, text_or_empty, tidy

BITS, CHAIN, MARGIN, WINDOW, STORED, CHUNK = 18, 128, 16, 12, 200_000, 2 << 20
WORD = re.compile(r"\w+")
RESULT = ("held_out", "score", "predicted", "toxic_spans")


def word_features(word: str) -> list[str]:
    w = word.lower()
    return [f"w{w}", *(f"p{w[:k]}" for k in (3, 4, 5, 6) if len(w) >= k), *(f"s{w[-k:]}" for k in (3, 4) if len(w) >= k)]


def hashed(word: str) -> list[int]:
    return [zlib.crc32(f.encode()) & ((1 << BITS) - 1) for f in word_features(word)]


def marginals(emission: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(tag 1) for chains as rows of ``emission`` (score of tag 1 less that of tag 0), ``trans[a, b]`` being the score of going from a to b.

    With two tags, forward and backward messages are ratios, one number each.
    """
    e, m = np.exp(np.clip(emission, -30, 30)).T.copy(), np.exp(trans)
    steps = len(e)
    forward, back = np.empty_like(e), np.empty_like(e)
    r = e[0]
    forward[0] = r
    for t in range(1, steps):
        r = e[t] * (m[0, 1] + r * m[1, 1]) / (m[0, 0] + r * m[1, 0])
        forward[t] = r
    b = np.ones(e.shape[1])
    back[-1] = b
    for t in range(steps - 1, 0, -1):
        x = e[t] * b
        b = (m[1, 0] + m[1, 1] * x) / (m[0, 0] + m[0, 1] * x)
        back[t - 1] = b
    x = forward * back
    return (x / (1 + x)).T


def document_marginals(emissions: list[np.ndarray], trans: np.ndarray) -> list[np.ndarray]:
    """Marginals of each document's tokens, in chains that see ``MARGIN`` tokens on either side; chains of one length run together, so padding never enters a message."""
    out = [np.empty(len(e)) for e in emissions]
    chains: dict[int, list[tuple[int, int, int]]] = {}
    for i, e in enumerate(emissions):
        for at in range(0, len(e), CHAIN):
            first, last = max(0, at - MARGIN), min(len(e), at + CHAIN + MARGIN)
            chains.setdefault(last - first, []).append((i, at, first))
    for n, where in chains.items():
        for k in range(0, len(where), 4096):
            part = where[k : k + 4096]
            p = marginals(np.stack([emissions[i][first : first + n] for i, _, first in part]), trans)
            for (i, at, first), row in zip(part, p):
                own = out[i][at : at + CHAIN]
                own[:] = row[at - first : at - first + len(own)]
    return out


def train_field(windows: list[tuple[list[str], list[int]]], epochs: int = 6, rate: float = 0.3, l2: float = 1e-6, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (the last is the bias) and transitions, from (words, tags)."""
    weights, trans = np.zeros((1 << BITS) + 1), np.zeros((2, 2))
    past, past_t = np.full((1 << BITS) + 1, 1e-6), np.full((2, 2), 1e-6)
    known: dict[str, np.ndarray] = {}
    rows = [([known.setdefault(w, np.array(hashed(w) + [1 << BITS])) if w not in known else known[w] for w in words], np.array(tags)) for words, tags in windows if words]
    by_size: dict[int, list[int]] = {}
    for i, (_, tags) in enumerate(rows):
        by_size.setdefault(len(tags), []).append(i)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        batches = []
        for same in by_size.values():
            same = rng.permutation(same)
            batches += [same[k : k + 64] for k in range(0, len(same), 64)]
        for k in rng.permutation(len(batches)):
            batch = batches[k]
            feats = [rows[i][0] for i in batch]
            tags = np.stack([rows[i][1] for i in batch])
            ids = np.concatenate([f for own in feats for f in own])
            lens = np.array([len(f) for own in feats for f in own])
            e = np.add.reduceat(weights[ids], np.cumsum(lens) - lens).reshape(tags.shape)
            p = marginals(e, trans)
            grad = np.bincount(ids, np.repeat((p - tags).ravel(), lens), len(weights)) / len(batch)
            if tags.shape[1] > 1:
                pair = pair_marginals(e, trans)
                seen = np.array([[((tags[:, :-1] == a) & (tags[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
                grad_t = (pair - seen) / len(batch)
                past_t += grad_t**2
                trans -= rate * grad_t / np.sqrt(past_t)
            grad += l2 * weights
            past += grad**2
            weights -= rate * grad / np.sqrt(past)
    return weights, trans


def pair_marginals(emission: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Expected number of transitions from a to b, over all rows of ``emission``."""
    m, e = np.exp(trans), np.exp(np.clip(emission, -30, 30))
    steps = e.shape[1]
    f = np.empty((steps, len(e)))
    f[0] = e[:, 0]
    for t in range(1, steps):
        f[t] = e[:, t] * (m[0, 1] + f[t - 1] * m[1, 1]) / (m[0, 0] + f[t - 1] * m[1, 0])
    total, b = np.zeros((2, 2)), np.ones(len(e))
    for t in range(steps - 1, 0, -1):
        x = e[:, t] * b
        joint = np.array([[np.full(len(e), m[0, 0]), m[0, 1] * x], [m[1, 0] * f[t - 1], m[1, 1] * x * f[t - 1]]])
        total += (joint / joint.sum((0, 1))).sum(2)
        b = (m[1, 0] + m[1, 1] * x) / (m[0, 0] + m[0, 1] * x)
    return total


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Coefficients (the last is the constant) by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w -= np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


class Field:
    """A fitted model. ``emissions`` keeps words' emissions, up to a bound."""

    def __init__(self, weights, trans, logistic, prior: float):
        self.weights, self.trans, self.logistic, self.prior, self.known = weights, trans, logistic, prior, {}

    def __getstate__(self):
        return self.weights, self.trans, self.logistic, self.prior

    def __setstate__(self, state):
        self.__init__(*state)

    def emissions(self, words: list[str]) -> np.ndarray:
        known, out = self.known, []
        for w in words:
            e = known.get(w)
            if e is None:
                e = float(self.weights[hashed(w)].sum() + self.weights[-1])
                if len(known) < STORED:
                    known[w] = e
            out.append(e)
        return np.array(out)

    def tag(self, texts: list[str]) -> list[np.ndarray]:
        return document_marginals([self.emissions(WORD.findall(t)) for t in texts], self.trans)

    def score(self, p: list[np.ndarray]) -> np.ndarray:
        x = np.array([summary(q) for q in p]).reshape(-1, 2)
        return 1 / (1 + np.exp(-np.clip(x @ self.logistic[:2] + self.logistic[2], -30, 30)))


def summary(p: np.ndarray) -> tuple[float, float]:
    """What a document's score is made of: the largest marginal as log odds, and the logarithm of how many are 0.5 or more."""
    top = float(np.clip(p.max(initial=0.0), 1e-6, 1 - 1e-6))
    return np.log(top / (1 - top)), np.log1p(float((p >= 0.5).sum()))


def spans_of(text: str, p: np.ndarray) -> str:
    out: list[list[int]] = []
    last = -2
    for k, m in enumerate(WORD.finditer(text)):
        if p[k] >= 0.5:
            if last == k - 1:
                out[-1][1] = m.end()
            else:
                out.append([m.start(), m.end()])
            last = k
    return ",".join(f"{a}:{b}" for a, b in out)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 2000, odds: float = 40.0, windows: int = 8) -> Field:
    """Learn from the labelled rows that aren't held out. ``odds``: how many times likelier in toxic documents a word or beginning must be; ``windows``: the most that a text gives."""
    spark = docs.sparkSession
    ship(spark)
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_tx_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    marks = marks.where((id_mod(F.col("_tx_id"), 5) != 0) & F.col("_tx_id").isNotNull() & F.col("y").isin(0, 1))
    digest = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    # copies count once everywhere: they would use the sample up, and make chance words look telling
    texts = docs.select(F.col(id_col).alias("_tx_d"), digest.alias("_tx_h")).join(marks, F.col("_tx_d") == F.col("_tx_id"))
    texts = staged(texts.groupBy("_tx_h").agg(F.max("y").alias("y")), "labelled-texts")
    n = {r[0]: r[1] for r in texts.groupBy("y").count().collect()}
    if len(n) < 2:
        total, toxic = marks.agg(F.count(F.lit(1)), F.sum("y")).first()
        prior = toxic / total if total else 0.0
        odd = np.clip(np.log(prior / (1 - prior)), -30, 30) if 0 < prior < 1 else 30.0 if prior else -30.0
        return Field(np.zeros((1 << BITS) + 1), np.zeros((2, 2)), np.array([0, 0, odd]), prior)
    rate = F.when(F.col("y") == 1, sample / n[1]).otherwise(sample / n[0])
    chosen = F.broadcast(texts.where(spread(F.col("_tx_h"), seed=9) < rate))  # about 2 * ``sample`` digests
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), digest.alias("_tx_d")).join(chosen, F.col("_tx_d") == F.col("_tx_h"))
    rows = staged(rows.select("y", "text").distinct(), "labelled")

    def found(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for text in batch.column(1):
                words = {w.lower() for w in WORD.findall(text.as_py())}
                out.append(list({f for w in words for f in (f"w{w}", *(f"p{w[:k]}" for k in (4, 5, 6) if len(w) >= k))}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["y", "f"])

    stats = rows.mapInArrow(tidy(found), "y int, f array<string>").select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    drawn = {r[0]: r[1] for r in rows.groupBy("y").count().collect()}
    n1, n0 = drawn.get(1, 0), drawn.get(0, 0)  # distinct texts, as a and b are
    seeds = stats.where((F.col("a") >= max(3, n1 // 50)) & (F.col("a") * n0 >= odds * (F.col("b") + 0.5) * n1)).select("f").collect()
    sent = spark.sparkContext.broadcast({r[0] for r in seeds})  # each is in a fiftieth of the sampled toxic documents

    def examples(batches):
        import pyarrow as pa

        for batch in batches:
            words_out, tags_out = [], []
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = [w.lower() for w in WORD.findall(text.as_py())]
                if y:
                    tags = [int(f"w{w}" in sent.value or any(f"p{w[:k]}" in sent.value for k in (4, 5, 6) if len(w) >= k)) for w in words]
                    at = [k for k, t in enumerate(tags) if t]
                else:
                    tags, at = [0] * len(words), range(len(words))
                n = min(len(at), windows if y else 4)
                for k in (at[len(at) * j // n] for j in range(n)):
                    words_out.append(words[max(0, k - WINDOW) : k + WINDOW])
                    tags_out.append(tags[max(0, k - WINDOW) : k + WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(words_out, pa.list_(pa.string())), pa.array(tags_out, pa.list_(pa.int32()))], ["words", "tags"])

    learnt = sorted((r[0], r[1]) for r in rows.mapInArrow(tidy(examples), "words array<string>, tags array<int>").collect())  # a few short windows of each sampled text
    weights, trans = train_field(learnt)
    prior = n[1] / (n[0] + n[1])
    field = Field(weights, trans, np.zeros(3), prior)
    scored = spark.sparkContext.broadcast(field)

    def summaries(batches):
        import pyarrow as pa

        for batch in batches:
            x = np.array([summary(scored.value.tag([t.as_py()])[0]) for t in batch.column(1)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x[:, 0]), pa.array(x[:, 1])], ["y", "a", "b"])

    seen = rows.mapInArrow(tidy(summaries), "y int, a double, b double").toPandas()
    field.logistic = fit_logistic(seen[["a", "b"]].to_numpy(), seen["y"].to_numpy(float))
    return field


def _chunks(batch, column: int):
    """Slices of an Arrow batch with bounded text."""
    start, size = 0, 0
    for k, t in enumerate(batch.column(column)):
        size += len(t.as_buffer() or b"") if t.is_valid else 0
        if size >= CHUNK:
            yield batch.slice(start, k + 1 - start)
            start, size = k + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def score_documents(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``docs`` with ``held_out``, ``score``, ``predicted`` and ``toxic_spans``; ``columns``: those of ``docs`` to carry (all)."""
    ship(docs.sparkSession)
    docs = docs.drop(*RESULT)
    names = docs.columns if columns is None else columns
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        import pyarrow as pa

        model = sent.value
        for batch in batches:
            for part in _chunks(batch, 0):
                texts = [t.as_py() or "" for t in part.column(0)]
                p = model.tag(texts)
                s = model.score(p)
                spans = [spans_of(t, q) if q.max(initial=0.0) >= 0.5 else "" for t, q in zip(texts, p)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(spans, pa.string())], [*part.schema.names[1:], "score", "predicted", "toxic_spans"])

    from pyspark.sql import types as T

    rows = docs.select(F.col(text_col).cast("string").alias("_tx_text"), *names, (id_mod(F.col(id_col), 5) == 0).alias("_tx_held"))
    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("toxic_spans", T.StringType())]
    out = rows.mapInArrow(tidy(run), T.StructType([*rows.schema.fields[1:], *added]))
    return out.select(*names, F.col("_tx_held").alias("held_out"), "score", "predicted", "toxic_spans")


def clean_documents(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores below 0.5.

    A score depends on the text alone, so Python gets texts and gives back the digests of toxic ones;
    these are few beside the texts, and the rows are filtered where they are read.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        import pyarrow as pa

        model = sent.value
        for batch in batches:
            for part in _chunks(batch, 0):
                toxic = model.score(model.tag([t.as_py() for t in part.column(0)])) >= 0.5
                yield pa.RecordBatch.from_arrays([part.column(1).filter(pa.array(toxic))], ["_tx_gone"])

    text = text_or_empty(F.col(text_col))
    gone = docs.select(text.alias("text"), F.sha2(text, 256).alias("digest")).mapInArrow(tidy(run), "_tx_gone string")
    with short_batches(docs.sparkSession):
        gone = staged(gone.distinct(), "toxic-texts")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(side, F.sha2(text, 256) == F.col("_tx_gone"), "left_anti")


def toxicity_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    field = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, field, columns=["doc_id"]).select("doc_id", *RESULT)
