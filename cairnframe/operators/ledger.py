"""Reference counts, garbage candidates, progress and lease state as batch folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEASE_SECONDS = 300


def ref_counts(deltas: DataFrame) -> DataFrame:
    """(obj_id, ref_count): sums of deltas (obj_id, delta) by partial aggregation."""
    return deltas.groupBy("obj_id").agg(F.sum("delta").alias("ref_count"))


def ref_ledger(deltas: DataFrame) -> DataFrame:
    """(obj_id, ref_count, zero_since, updated_at) after deltas (obj_id, seq, ts, delta).

    A count never falls below zero: it is the running sum above its lowest
    point so far. A positive delta clears ``zero_since``; the delta that brings
    the count to zero sets it, and one at zero keeps it.
    """
    upto = W.partitionBy("obj_id").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, 0)
    rows = deltas.withColumn("run", F.sum("delta").over(upto))
    rows = rows.withColumn("n", F.col("run") - F.least(F.min("run").over(upto), F.lit(0)))
    last = rows.groupBy("obj_id").agg(
        F.max_by("n", F.struct("ts", "seq")).alias("ref_count"), F.max("ts").alias("updated_at"),
        F.max(F.when((F.col("n") > 0) | (F.col("delta") > 0), F.struct("ts", "seq"))).alias("alive"),
    )
    zeros = rows.where((F.col("n") == 0) & (F.col("delta") <= 0)).join(last.select("obj_id", "alive"), "obj_id").where(
        F.col("alive").isNull() | (F.struct("ts", "seq") > F.col("alive"))
    ).groupBy("obj_id").agg(F.min("ts").alias("zero_since"))
    return last.join(zeros, "obj_id", "left").select("obj_id", "ref_count", F.when(F.col("ref_count") == 0, F.col("zero_since")).alias("zero_since"), "updated_at")


def gc_candidates(stats: DataFrame, before, limit: int) -> DataFrame:
    """Unreferenced objects, longest unreferenced first; ties by id. A top-k, without a global sort."""
    return stats.where((F.col("ref_count") == 0) & (F.col("zero_since") <= F.lit(before))).orderBy("zero_since", "obj_id").limit(limit)


def last_progress(events: DataFrame) -> DataFrame:
    """(chunk_id, progress): the latest by (ts, seq)."""
    return events.groupBy("chunk_id").agg(F.max_by("progress", F.struct("ts", "seq")).alias("progress"))


def reclaim_leases(nodes: DataFrame, now) -> DataFrame:
    """Clear leases that have expired (at ``now`` or before): the session goes, the fence stays, Working cools."""
    gone = F.col("lease_session").isNotNull() & (F.col("lease_expire_at") <= F.lit(now))
    return nodes.withColumn("reclaimed", gone).withColumns({
        "closed_at": F.when(F.col("reclaimed") & (F.col("state") == "Working"), F.lit(now)).otherwise(F.col("closed_at")),
        "state": F.when(F.col("reclaimed") & (F.col("state") == "Working"), "Cooling").otherwise(F.col("state")),
        "lease_session": F.when(~F.col("reclaimed"), F.col("lease_session")),
        "lease_expire_at": F.when(~F.col("reclaimed"), F.col("lease_expire_at")),
    })
