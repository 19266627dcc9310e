"""The queries of this subpackage over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import alignment, bitplanes, fingerprint_index, licenses, mixing, ogg, packing, quality, rabitq, simhash, suffix_dedup, toxicity, variants
from ridgeline.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's SimHash of three-word shingles and its component at two or fewer differing bits."""
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, radius=2)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op2_embedding_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.93 or more within a label."""
    return rabitq.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.93)


@query("op3_source_mixing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of 150% of all words by weights 3, 1, 2, at most 2 times each source, takes from each document."""
    got = mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0)
    return got.select("doc_id", "size", "source_size", "target", "taken", F.to_json("draws").alias("draws"))


@query("op4_toxicity")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity and grade of every whole document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", F.col("tox_p").alias("p_toxic"), F.col("tox_severity").alias("severity"), F.col("tox_grade").alias("grade"), F.col("tox_toxic").alias("toxic"))


@query("op5_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calibrated quality score of every whole document."""
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


@query("op6_ogg_media")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text as samples in an Ogg file, read back and verified."""
    got = ogg.media_features(ogg.media_column(table(spark, sf_dir, "documents"), block=64))
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error")


@query("op7_license_scan", licenses.oracle_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence rules that every whole document matches."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op8_best_fit_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' tokens packed into sequences of at most 2048."""
    got = packing.packed_documents(table(spark, sf_dir, "documents"), capacity=2048)
    return got.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op9_substring_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What windows of 20 words that start earlier leave of every whole document."""
    got = fingerprint_index.without_repeats(table(spark, sf_dir, "documents"), window=20)
    return got.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op10_suffix_array_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What strings of 100 bytes that start earlier leave of every whole document."""
    got = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"), length=100)
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op11_spelling_variants")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents, one in 199 misspelt, and the five times as frequent word that each is a variant of."""
    words = variants.corpus_words(table(spark, sf_dir, "documents"), least_length=6, least_count=5, drop_one_in=199)
    return variants.variant_forms(words, ratio=5).select("word", "form", "root", "n", "n_near", "form_n")


@query("op12_token_planes")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all documents written to files of byte planes, and what is read back from them."""
    files = bitplanes.write_ids(table(spark, sf_dir, "documents"))
    return bitplanes.read_ids(files).select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in every document, and their counts in the corpus."""
    return alignment.linked_counts(table(spark, sf_dir, "documents"))
