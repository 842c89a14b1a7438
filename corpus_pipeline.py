"""A training corpus from documents: judged, deduplicated, cut free of copies and benchmarks, encoded.

STAGES lists (name, function) pairs; each function takes (spark, docs, sf_dir) and
returns a DataFrame that is written and read again as the next one's docs.  All but the
last return the columns of documents; the last returns each document's round trip
through the SentencePiece model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm import decontaminate, order_minhash, quality_model, sentencepiece_codec, substring_dedup
from hushframe.llm.shared import cut
from hushframe.session import ship

#: The stages are not expressible in SQL (a trained model, sketches, chunk hashes); tests hold them against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = ship(spark).read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return quality_model.good_documents(docs, labels)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, that of the smallest doc_id."""
    ship(spark)
    return order_minhash.one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of a smaller doc_id has too are cut out; no document goes."""
    ship(spark)
    out = substring_dedup.dedup(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go; the others are as they were."""
    return decontaminate.clean_documents(docs, ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids, their number and digest, and whether they decode to its text and equal the library's."""
    ship(spark)
    return sentencepiece_codec.round_trip(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("substrings", substrings), ("decontamination", decontamination), ("encoding", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
