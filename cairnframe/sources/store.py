"""Object and chunk tables: scans, point reads, upserts and sinks on Parquet.

Upserts are last-wins unions written as a new version; a table is laid out by
the first two characters of its hash, so point reads prune to one folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, ids
from ..operators.overlay import last_wins

OBJECTS = "obj_id string, obj_type string, obj_data string, create_time bigint"
CHUNKS = "chunk_id string, chunk_size bigint, chunk_state string, local_path string, progress string, update_time bigint, payload binary"


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all files below a folder, on any file system that Spark reads."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")


def json_config(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Rows after changes: the latest by ``order`` of each key, a change before a current row of the same order."""
    both = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    return last_wins(both, [key], [order, "__new"]).drop("__new").select(*current.columns)


def put_chunks(current: DataFrame, incoming: DataFrame, verify: bool = True) -> DataFrame:
    """Chunk rows after a put: payloads with a wrong id are dropped, known ids keep their first row, copies go in once."""
    rows = incoming.where(hashing.expected_id(F.col("payload"), F.col("chunk_id")) == F.col("chunk_id")) if verify else incoming
    rows = rows.withColumns({"chunk_size": F.length("payload").cast("bigint"), "chunk_state": F.lit("completed")})
    fresh = rows.groupBy("chunk_id").agg(F.min(F.struct(*[c for c in current.columns if c != "chunk_id"])).alias("r")).select("chunk_id", "r.*")
    return current.unionByName(fresh.join(current.select("chunk_id"), "chunk_id", "left_anti").select(*current.columns))


def link_chunks(links: DataFrame) -> DataFrame:
    """Chunk rows that refer to a file's bytes: (chunk_id, chunk_size, local_path, update_time), no payload."""
    none = F.lit(None)
    return links.select("chunk_id", "chunk_size", F.lit("local_link").alias("chunk_state"), "local_path", none.cast("string").alias("progress"), "update_time", none.cast("binary").alias("payload"))


def write_table(df: DataFrame, path: str, key: str, mode: str = "overwrite") -> None:
    """Write a table partitioned by the first two characters of its key's hash."""
    fan = F.substring(F.substring_index(key, ":", -1), 1, 2)
    df.withColumn("fan", fan).repartition("fan").write.mode(mode).partitionBy("fan").parquet(path)


def get(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """Rows of one key; the folder is pruned and the key pushed to the scan."""
    return spark.read.parquet(path).where((F.col("fan") == value.rsplit(":", 1)[-1][:2]) & (F.col(key) == value)).drop("fan")


def quick_link_ok(links: DataFrame, files: DataFrame) -> DataFrame:
    """Links (path, start, end, qcid) with ``ok``: the range lies in the file and the quick id is the file's."""
    f = files.select("path", F.length("content").cast("bigint").alias("n"), hashing.quick_id(F.col("content")).alias("q"))
    j = links.join(f, "path", "left")
    return j.withColumn("ok", F.coalesce((F.col("end") <= F.col("n")) & (F.col("start") <= F.col("end")) & (F.col("q") == F.col("qcid")) & (ids.id_type(F.col("qcid")) == "qcid"), F.lit(False))).drop("n", "q")
