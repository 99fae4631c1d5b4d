"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The six ASCII white-space characters that separate words.
BLANKS = " \t\n\x0b\x0c\r"

#: Names of the columns of the documents table.
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent (tests, a laptop) a temporary folder is
    taken and recorded in the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        found = tempfile.mkdtemp(prefix="cairnframe-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Spark deletes a query's shuffle files when it ends.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Paths written inside each open ``scratch`` block, innermost last.
_OPEN: list[list[str]] = []


def materialize(df: DataFrame, label: str, keep: bool = False, **options: object) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts lineage, so that a lost executor costs a reread of a file and
    never a recomputation of everything before it. Inside a ``scratch`` block
    the files go when the block ends, unless ``keep`` is set. ``options`` go to the writer.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    # What a finished job shuffled is not read again, since its result is a file.
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").options(**options).parquet(path)
    finally:
        spark.conf.set(DROP_SHUFFLES, before)
    if _OPEN and not keep:
        _OPEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(spark: SparkSession, label: str) -> None:
    """Delete what ``materialize`` wrote under a label inside the innermost ``scratch`` block, once nothing reads it again."""
    for path in [p for p in (_OPEN[-1] if _OPEN else []) if p.rsplit("/", 1)[1].rsplit("-", 1)[0] == label]:
        _OPEN[-1].remove(path)
        _delete(spark, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete what ``materialize`` wrote inside the block; results that outlive it are written with ``keep``."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            _delete(spark, path)


def words(text: Column) -> Column:
    """Array of the words of a text; null text gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")
