"""Corpus pipeline over ``documents``: classify, check rules, drop near-duplicates, cut repeats, pack.

Each stage works on all its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlab.llm import jaccard_join, packing, quality_crf, quality_rules, suffix_dedup
from cohortlab.llm.tables import free_name, long_rows, stored, table

TOKENIZER = path("byte_bpe_50k.json")
SHINGLE, PERCENT = 5, 80     # near-duplicates here: five words, similarity 0.8; op3's contract binds only its query
ORACLE_SQL = None   # no SQL form of the classifier and the packing; the tests hold the stages against brute force


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; every column as it was.

    Null and empty texts are judged as one line without content, repeated rows alike; an empty
    table stays empty.
    """
    model = quality_crf.fit(quality_crf.labelled_features(docs, table(spark, sf_dir, "labels")))
    return quality_crf.accepted(docs, model)


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that base rules and compression bands keep; every column as it was.

    Null and empty texts have no words and go, repeated rows are judged alike; an empty table
    stays empty.
    """
    long_rows(spark)
    return quality_rules.accepted(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard 0.8 of five-word shingles), the one of smallest id.

    Of rows that share an id the one whose text has the smallest MD5 stays. Rows without an id
    stay unless a document with an id has the same shingles.
    """
    nth = free_name(docs, "_nth")
    found = jaccard_join.near_duplicates(docs, SHINGLE, PERCENT)
    ids = found.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    order = Window.partitionBy("doc_id").orderBy(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    named = (docs.filter(F.col("doc_id").isNotNull()).join(ids, "doc_id", "left_semi")
             .withColumn(nth, F.row_number().over(order)).filter(F.col(nth) == 1).select(*docs.columns))
    return named.unionByName(jaccard_join.unnamed_alone(docs, SHINGLE))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that repeat earlier ones; ``n_chars`` follows the text.

    Null and empty texts stay as they are; rows come in the order of their ids, null first; an
    empty table stays empty.
    """
    return suffix_dedup.without_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and offsets.

    A null or empty text is its end id alone, repeated rows are packed each for itself; an empty
    table gives no rows.
    """
    return packing.pack(docs, TOKENIZER)


STAGES = [("quality_classifier", quality_stage), ("quality_rules", rules_stage), ("jaccard_join", near_duplicate_stage),
          ("suffix_dedup", repeats_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn, each but the last written to the shared folder and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
