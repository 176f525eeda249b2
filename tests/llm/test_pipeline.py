"""The pipeline's stages, each on what the one before it kept."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
from cairn.llm import packing
from cairn.llm.common import staged
from pyspark.sql import functions as F
from test_operators import plain_classes

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(staged(stage(spark, steps[-1], SF), name))
    assert all(s.columns == docs.columns for s in steps[:5])
    start, clean, single, distinct, mixed = ({r.doc_id: r.text for r in s.collect()} for s in steps[:5])
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    assert toxic <= set(clean) and set(clean) < set(start)
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    last = {}
    for k, t in clean.items():
        last[lower(t)] = max(k, last.get(lower(t), -1))
    assert set(single) == set(last.values())
    ids = sorted(single)
    classes = plain_classes([single[k] for k in ids])
    assert set(distinct) == {ids[c] for c in classes}
    assert mixed == distinct
    pieces = steps[5].collect()
    assert {r.doc_id for r in pieces} == set(distinct)
    assert max(Counter({s: sum(r.length for r in pieces if r.sequence_id == s) for s in {r.sequence_id for r in pieces}}).values()) <= 2048


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls, repeated rows, empty texts, columns named like results and an empty table, through each stage."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    some = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    odd = [(None, None, None, None, None), (None, None, None, None, None), (3, "", "en", "a", 0), (3, "", "en", "a", 0), (None, "no id at all", "en", None, 12), (7, "No Id At All", None, "b", 12)]
    docs = some.unionByName(spark.createDataFrame(odd, some.schema)).selectExpr("*", "'x' as kept", "1L as position", "2 as score", "'n' as node", "3 as sequence_id")
    for table in (docs, docs.limit(0)):
        steps = [table]
        for name, stage in corpus_pipeline.STAGES:
            steps.append(staged(stage(spark, steps[-1], str(tmp_path)), name))
        assert all(s.columns == docs.columns for s in steps[:5])
        counts = [s.count() for s in steps]
        if counts[0]:
            single, distinct = steps[2].collect(), steps[3].collect()
            assert len({(r.text or "").lower() for r in single}) == len(single) == counts[2] and counts[3] <= counts[2] and counts[4] == counts[3]
            assert sum(not r.text for r in distinct) == 1 and any(r.text and r.text.lower() == "no id at all" for r in distinct)
            assert {r.doc_id for r in steps[5].collect()} == {r.doc_id for r in distinct}
        else:
            assert counts == [0] * 6


def ordered(spark, rows, files):
    """A table of (doc_id, text) whose files hold ``rows`` in their order."""
    numbered = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "at long, doc_id long, text string")
    return staged(numbered.repartitionByRange(files, "at").sortWithinPartitions("at").drop("at"), "ordered")


def test_packing_follows_the_order_of_the_mixture(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: zlib.crc32(str(r[0]).encode()))
    least = packing.pack_documents(docs).agg(F.countDistinct("sequence_id")).first()[0]
    seen = []
    for order in (rows, rows[::-1]):
        place, own = {k: i for i, (k, _) in enumerate(order)}, {}
        pieces = corpus_pipeline.pack_sequences(spark, ordered(spark, order, 5), SF).collect()
        for r in pieces:
            own.setdefault(r.sequence_id, []).append((r.offset, r.length, place[r.doc_id]))
        assert sorted(own) == list(range(least))
        for own_rows in own.values():
            own_rows.sort()
            assert [at for at, _, _ in own_rows] == [sum(n for _, n, _ in own_rows[:k]) for k in range(len(own_rows))] and sum(n for _, n, _ in own_rows) <= 2048
        firsts = [own[s][0][2] for s in range(least)]
        assert firsts == sorted(firsts)
        seen.append({(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces})
        assert len(seen[-1]) == len(pieces)
    assert seen[0] == seen[1]


def test_the_mixture_s_shares_hold_over_the_sequences(spark):
    """Two sources in turn are half and half among the first sequences; one after the other, the first has them alone. Few lengths, so pieces that don't lead follow too."""
    texts = [" ".join(["word"] * (90 + i * 7 % 10 * 60)) for i in range(1000)]
    for source in (lambda i: i % 2, lambda i: i // 500):
        out = corpus_pipeline.pack_sequences(spark, ordered(spark, list(enumerate(texts)), 3), SF).collect()
        early = [r for r in out if r.sequence_id < 0.4 * max(r.sequence_id for r in out)]
        others = [(r.sequence_id, r.doc_id) for r in out if r.offset]
        assert np.corrcoef(np.array(others).T)[0, 1] > 0.9 and any(r.offset for r in early)
        share = np.mean([source(r.doc_id) for r in early])
        assert abs(share - 0.5) < 0.1 if source(1) else share < 0.1
    assert not corpus_pipeline.pack_sequences(spark, spark.createDataFrame([], "doc_id long, text string"), SF).count()
