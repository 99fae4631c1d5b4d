"""Copy-on-write chunk lists: merge of a base and a diff, writes, growth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merge(base: DataFrame, diff: DataFrame, key: str = "list_id") -> DataFrame:
    """(key, idx, chunk_id, chunk_size, start, origin): diff entries override by index, or append.

    An index that leaves a gap past the base raises an error.
    """
    d = diff.select(key, "idx", F.col("chunk_id").alias("d_id"), F.col("chunk_size").alias("d_size"))
    j = base.select(key, "idx", "chunk_id", "chunk_size").join(d, [key, "idx"], "full_outer")
    w = W.partitionBy(key)
    before = w.orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    rows = j.select(
        key, "idx", F.coalesce("d_id", "chunk_id").alias("chunk_id"), F.coalesce("d_size", "chunk_size").alias("chunk_size"),
        F.when(F.col("d_id").isNotNull(), "diff").otherwise("base").alias("origin"),
    ).withColumns({"start": F.coalesce(F.sum("chunk_size").over(before), F.lit(0)).cast("bigint"), "place": F.row_number().over(w.orderBy("idx")) - 1})
    gap = F.raise_error(F.concat(F.lit("gap before chunk "), F.col("idx").cast("string")))
    return rows.withColumn("idx", F.when(F.col("place") == F.col("idx"), F.col("idx")).otherwise(gap.cast("int"))).drop("place")


def overwrite(payload: Column, at: Column, data: Column) -> Column:
    """Bytes with ``data`` written at ``at``; a gap before it fills with zeros."""
    zeros = F.unhex(F.repeat(F.lit("00"), F.greatest(at - F.length(payload), F.lit(0)).cast("int")))
    head = F.concat(F.substring(payload, F.lit(1), at.cast("int")), zeros)
    tail = F.substring(payload, (at + F.length(data) + 1).cast("int"), F.length(payload))
    return F.concat(head, data, tail)


def writes_by_chunk(writes: DataFrame, size: int, key: str = "list_id") -> DataFrame:
    """(key, seq, idx, at, data): each write (key, seq, position, data) cut at the bounds of fixed-size chunks."""
    end = F.col("position") + F.length("data")
    rows = writes.where(F.length("data") > 0).withColumn("idx", F.explode(F.sequence(F.floor(F.col("position") / size), F.floor((end - 1) / size))))
    low, high = F.greatest(F.col("position"), F.col("idx") * size), F.least(end, (F.col("idx") + 1) * size)
    return rows.select(key, "seq", F.col("idx").cast("int").alias("idx"), (low - F.col("idx") * size).alias("at"), F.substring("data", (low - F.col("position") + 1).cast("int"), (high - low).cast("int")).alias("data"))


def apply_writes(chunks: DataFrame, writes: DataFrame, size: int, key: str = "list_id") -> DataFrame:
    """(key, idx, payload, dirty): chunk payloads after writes in the order of seq; untouched chunks stay clean."""
    cut = writes_by_chunk(writes, size, key).groupBy(key, "idx").agg(F.sort_array(F.collect_list(F.struct("seq", "at", "data"))).alias("w"))
    empty = F.lit("").cast("binary")
    done = F.aggregate("w", F.coalesce("payload", empty), lambda a, x: overwrite(a, x["at"], x["data"]))
    j = chunks.select(key, "idx", "payload").join(cut, [key, "idx"], "full_outer")
    return j.select(key, "idx", F.when(F.col("w").isNotNull(), done).otherwise(F.col("payload")).alias("payload"), F.col("w").isNotNull().alias("dirty"))


def preferred_size(chunks: DataFrame, fixed: int | None, remaining: int, key: str = "list_id") -> DataFrame:
    """(key, preferred): fixed, else the largest chunk but the last, else the last, else what remains to write."""
    w = W.partitionBy(key)
    rows = chunks.withColumn("last", F.col("idx") == F.max("idx").over(w))
    agg = rows.groupBy(key).agg(F.max(F.when(~F.col("last"), F.col("chunk_size"))).alias("most"), F.max(F.when(F.col("last"), F.col("chunk_size"))).alias("end"))
    return agg.select(key, F.coalesce(F.lit(fixed).cast("bigint"), F.col("most"), F.col("end"), F.lit(remaining)).alias("preferred"))
