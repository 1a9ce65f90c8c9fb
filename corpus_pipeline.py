"""A corpus pipeline of five stages over the operators in polyspec.llm.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's docs. All
but the last return the columns of documents, with n_chars following the text. The cases that the operators define
(nulls, empty and long texts, repeated rows, empty tables, extra columns) hold here too; extra columns are kept up to
the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyspec.llm import bytebpe, line_dedup, ngram_join, packing, pu_quality, quality_rules
from polyspec.llm.common import fresh, materialize, read


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier predicts to be of quality; it learns from this stage's own input."""
    model = pu_quality.train(docs, read(spark, sf_dir, "labels"))
    return pu_quality.scored(docs, model, *docs.columns, kept=True)


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base test and every rule."""
    return quality_rules.cascade(docs).where("kept").select(docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops boilerplate lines of each source; every document stays."""
    return line_dedup.drop_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class: the one of least doc_id, of a null one only if there is no other. Rows are told apart
    by a number of their own, so rows of null or repeated doc_ids with different texts stay."""
    row = fresh(docs.columns, "row")["row"]
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    classes = ngram_join.near_duplicates(numbered.select(row, "text"), row).select(row, "class_id")
    ids = numbered.select(F.col(row), F.col("doc_id").cast("long").alias("doc"))
    firsts = classes.join(ids, row).groupBy("class_id").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", row)).alias("first"))
    return numbered.join(firsts.select(F.col(f"first.{row}").alias(row)), row, "left_semi").drop(row)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack_documents(docs, bytebpe.vocabulary())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("packing", pack),
]

#: Training a classifier, MinHash and packing aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
