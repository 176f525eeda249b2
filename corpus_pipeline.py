"""From raw documents to packed training sequences, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All stages but the last return the columns
of documents; the order that mixing gives is in the files and the rows within them, and packing reads it there. ``ORACLE_SQL`` is None: SQL expresses neither the field that scores toxicity nor the
sampling that finds near duplicates; tests hold the stages against plain Python.
"""

from __future__ import annotations

from cairn.llm import exact_duplicates, mixing, near_duplicates, packing, toxicity
from cairn.llm.common import in_file_order, staged

ORACLE_SQL = None


def reject_toxic(spark, docs, sf_dir):
    """Documents that score 0.5 or more go."""
    field = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean_documents(docs, field).select(*docs.columns)


def drop_copies(spark, docs, sf_dir):
    """Of equal texts one row stays."""
    return exact_duplicates.exact_duplicates(docs).where("kept").select(*docs.columns)


def drop_near_copies(spark, docs, sf_dir):
    """Of each class of near duplicates one document stays."""
    return near_duplicates.distinct_documents(docs).select(*docs.columns)


def mix_sources(spark, docs, sf_dir):
    """Documents in the order of the mixture: files, and rows within them, ascend by position."""
    mixed = mixing.mix(docs)
    return mixed.repartitionByRange("position").sortWithinPartitions("position").select(*docs.columns)


def pack_sequences(spark, docs, sf_dir):
    """Pieces of token ids with their sequence and their place in it; sequences ascend as the mixture does, by the places of rows in ``docs``' files."""
    placed = in_file_order(docs, "_position").select("doc_id", "text", "_position")
    return packing.pack_documents(placed, order_col="_position")


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_duplicates", drop_copies),
    ("near_duplicates", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
