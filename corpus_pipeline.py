"""From raw documents to packed training sequences, a stage at a time.

For all stages: rows without doc_id are left out, rows repeating one are one
document (the first by its other columns), further columns pass through
whatever their names, an empty table gives no rows. Null texts stay null
until packing, where they are empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import read_table, stored
from pagemill.llm.line_dedup import drop_repeated_chunks
from pagemill.llm.packing import pack_documents
from pagemill.llm.simhash_dedup import MAX_BITS, SHINGLE_WORDS, drop_near_duplicates
from pagemill.llm.suffix_dedup import drop_repeats
from pagemill.llm.toxicity import drop_toxic
from pagemill.session import tune


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now; other columns as they are."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go; null and empty texts have no features, without toxic labels all stay."""
    return drop_toxic(docs, read_table(tune(spark), sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated multi-line chunks leave the texts, the first by doc_id and place stays; every document stays, if need be empty."""
    tune(spark)
    return _recounted(drop_repeated_chunks(docs).select(*docs.columns))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest doc_id; null and empty texts are one group."""
    tune(spark)
    return drop_near_duplicates(docs, SHINGLE_WORDS, MAX_BITS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated 100-byte windows leave the texts, the first by doc_id and start stays; every document stays, if need be empty."""
    tune(spark)
    return _recounted(drop_repeats(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the packed sequences; a null or empty text is its end id alone."""
    tune(spark)
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None  # classifier, fingerprints and tokenizer have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again for the next."""
    docs = read_table(tune(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
