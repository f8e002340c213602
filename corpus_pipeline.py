"""The corpus pipeline: toxicity, exact copies, near copies, mixing, packing. Each stage takes what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridcast.llm import exact, mixing, packing, simhash, toxicity
from gridcast.llm.common import read
from gridcast.session import shared_dir


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity scan does not reject.

    Each row is judged by its own doc_id and text; null and empty texts stay. Labels beside ``docs`` are read from ``sf_dir``.
    """
    return toxicity.drop_toxic(docs, read(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the document with the smallest doc_id.

    A null text is an empty one. Rows without doc_id come last; of equal rows one stays.
    """
    return exact.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies, at a five-word Jaccard similarity of 0.8 or more, the document with the smallest doc_id.

    SimHash fingerprints of samples of the shingles find candidates, which are verified. Rows without doc_id come last and are judged
    by their own text, as are rows that repeat a doc_id.
    """
    return simhash.drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it: not at all, once or twice.

    Reruns agree. A null source is a source of its own; null and empty texts add no words; rows that repeat a doc_id are mixed each.
    """
    return mixing.mixed_rows(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place in it: the columns of ``op5``.

    A null or empty text is its end token alone; copies of a document are packed each.
    """
    return packing.pack_digest(docs)


STAGES = [
    ("toxicity", toxic_documents),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("mixing to target weights", source_mix),
    ("best-fit packing", packed_sequences),
]

# Neither a fitted classifier nor tokenizer ids can be written in SQL; tests/llm compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again as the next one's input."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_dir(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
