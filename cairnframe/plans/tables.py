"""The driver's tables in the roles that the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and content (bytes) of the documents."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))


def file_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path and size of the documents as files: /source/lang/doc_id."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("path"),
        F.length(F.coalesce("text", F.lit("")).cast("binary")).cast("bigint").alias("size"),
    )


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as a package index."""
    brand = F.regexp_extract("p_brand", "([0-9]+)", 1)
    version = F.concat(brand, F.lit("."), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string"))
    tag = F.when(F.col("p_partkey") % 3 == 0, "stable").when(F.col("p_partkey") % 3 == 1, "beta")
    return table(spark, sf_dir, "part").select(
        F.lower("p_type").alias("pkg_name"), version.alias("version"), F.concat(F.lit("meta"), F.lpad(F.col("p_partkey").cast("string"), 12, "0")).alias("metaobjid"),
        tag.alias("tag"), "p_partkey", "p_size",
    )


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a namespace log: users are directories, event ids modulo 50 are names."""
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "move_out").otherwise("set")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").cast("string").alias("parent"),
        F.concat(F.lit("n"), (F.col("event_id") % 50).cast("string")).alias("name"), F.concat(F.lit("obj"), F.col("event_id").cast("string")).alias("target"),
    )


def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as reference deltas: purchases and signups add, errors and views take."""
    delta = F.when(F.col("event_type").isin("purchase", "signup"), 1).when(F.col("event_type").isin("error", "view"), -1).otherwise(0)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("obj_id"), F.col("event_id").alias("seq"), "ts", delta.cast("bigint").alias("delta"))
