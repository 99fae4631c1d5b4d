"""From raw documents to packed training sequences, in five stages.

Each stage reads all that the one before kept. Every stage but the last returns
the columns of the documents table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnframe.llm import line_dedup, mixing, near_dedup, quality_rules
from cairnframe.llm._common import DOC_COLUMNS, materialize, table
from cairnframe.llm.queries_corpus import packed


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the standard policy."""
    return quality_rules.passing(docs.select(*DOC_COLUMNS))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that repeat an earlier one; a document of which no word is left goes."""
    found = line_dedup.dedup_lines(docs)
    left = F.col("n_lines").isNull() | (F.coalesce(F.size("removed"), F.lit(0)) < F.col("n_lines"))
    return found.where(left).withColumn("n_chars", F.length("text").cast("long")).select(*DOC_COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, 0.8)."""
    return near_dedup.first_of_each(docs).select(*DOC_COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents repeated, cut or left out as the mix takes them."""
    rows = docs.where(F.col("doc_id").isNotNull())
    return mixing.take(rows, mixing.mix(rows)).withColumn("n_chars", F.length("text").cast("long")).select(*DOC_COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 1024 tokens."""
    return packed(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: Tokens and near duplicates have no SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents of a folder of tables."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
