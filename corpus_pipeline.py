"""A training corpus from raw documents: toxic texts and near copies go, repeated passages are cut, sources are mixed, sequences packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ridgeline.llm import mixing, near_texts, packing, suffix_dedup, toxicity
from ridgeline.llm.common import staged, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the ordinal model, fit on the labelled documents, doesn't call toxic."""
    model = toxicity.train(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("not tox_toxic").select(*[f"`{c}`" for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are alike in 0.8 or more of their five-word shingles."""
    return near_texts.one_of_each(docs, width=5, similarity=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without strings of 100 bytes that start earlier."""
    return suffix_dedup.cut_texts(docs, length=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each draw of the mix: 150% of all words by weights 3, 1, 2, at most twice each source."""
    return mixing.mixed_rows(docs, weights=(3, 1, 2), share=1.5, cap=2.0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the drawn documents, packed into sequences of at most 2048 tokens."""
    return packing.packed_documents(docs, capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("repeated passages", cut_repeats),
    ("source mix", mix_sources),
    ("packing", pack_sequences),
]

#: SQL can't express these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, over documents; each is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
