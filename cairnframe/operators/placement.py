"""Placement of objects on weighted targets: lookup tables, replicas, epochs.

A layout is a small table (slot, store_id) whose size is fixed by the total
weight; it is built on the driver and joined by slot. Its size has a proven
bound (at most 6 553 577 slots), so Spark broadcasts it where it fits.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Table sizes by total weight, layouts kept, probe step.
SIZES = ((6_000, 65_537), (60_000, 655_373))
LARGEST = 6_553_577
KEPT = 3
PROBE = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Target:
    store_id: str
    weight: int = 1
    enabled: bool = True
    readonly: bool = False

    @property
    def active(self) -> bool:
        return self.enabled and not self.readonly and self.weight > 0


def table_size(total_weight: int) -> int:
    return next((size for limit, size in SIZES if total_weight < limit), LARGEST)


def _stable(text: str, seed: int) -> int:
    return int.from_bytes(hashlib.sha256(f"{seed}:{text}".encode()).digest()[:8], "big")


def lookup_table(targets: list[Target]) -> list[int]:
    """Index of the target of each slot; empty without an active target.

    Each target walks its own permutation (offset + k * skip) and, in turn,
    claims as many free slots a round as its weight.
    """
    active = [i for i, t in enumerate(targets) if t.active]
    if not active:
        return []
    size = table_size(sum(targets[i].weight for i in active))
    place = {i: _stable(targets[i].store_id, 1) % size for i in active}
    skip = {i: _stable(targets[i].store_id, 2) % (size - 1) + 1 for i in active}
    out, left = [-1] * size, size
    while left:
        for i in active:
            at, step = place[i], skip[i]
            for _ in range(targets[i].weight):
                if not left:
                    break
                while out[at] >= 0:
                    at = (at + step) % size
                out[at] = i
                left -= 1
            place[i] = at
    return out


def slots(spark: SparkSession, targets: list[Target]) -> DataFrame:
    table = lookup_table(targets)
    return spark.createDataFrame([(s, targets[i].store_id) for s, i in enumerate(table)], "slot int, store_id string")


def slot_of(obj_id: Column, size) -> Column:
    """The slot of an id: by its hash alone, whatever its type."""
    return F.pmod(F.xxhash64(F.substring_index(obj_id, ":", -1)), size if isinstance(size, Column) else F.lit(size)).cast("int")


def primary(objects: DataFrame, layout: DataFrame, size: int) -> DataFrame:
    """Add the store of each object."""
    return objects.withColumn("slot", slot_of(F.col("obj_id"), size)).join(layout, "slot")


def replicas(objects: DataFrame, layout: DataFrame, size: int, n: int, probes: int = 64) -> DataFrame:
    """(obj_id, rank, store_id): the first n distinct stores that an object's probes meet.

    Stores that no probe met follow in the order of their ids, so n stores come
    back whenever the layout has so many.
    """
    step = PROBE % size
    asked = objects.select("obj_id", F.explode(F.sequence(F.lit(0), F.lit(probes - 1))).alias("k"))
    asked = asked.withColumn("slot", ((slot_of(F.col("obj_id"), size).cast("bigint") + F.col("k") * step) % size).cast("int"))
    met = asked.join(layout, "slot").select("obj_id", "store_id", F.col("k").cast("bigint").alias("k"))
    stores = layout.select("store_id").distinct()
    rest = objects.select("obj_id").withColumn("s", F.explode(stores.agg(F.sort_array(F.collect_list("store_id"))).scalar())).select("obj_id", F.col("s").alias("store_id"), F.lit(probes).cast("bigint").alias("k"))
    first = met.unionByName(rest).groupBy("obj_id", "store_id").agg(F.min("k").alias("k"))
    rank = F.row_number().over(W.partitionBy("obj_id").orderBy("k", "store_id"))
    return first.withColumn("rank", rank).where(F.col("rank") <= n).select("obj_id", "rank", "store_id")


def kept_layouts(layouts: DataFrame, kept: int = KEPT) -> DataFrame:
    """The newest epochs of (epoch, seq, ...): the last of each epoch, at most ``kept``."""
    last = layouts.groupBy("epoch").agg(F.max("seq").alias("seq"))
    top = last.orderBy(F.col("epoch").desc()).limit(kept)
    return layouts.join(top, ["epoch", "seq"], "left_semi")


def locate(objects: DataFrame, layouts: DataFrame, present: DataFrame) -> DataFrame:
    """(obj_id, epoch, store_id): the first hit from the newest epoch to the oldest; objects found nowhere are left out.

    ``objects`` has obj_id and hash (a number); ``layouts`` has epoch, size,
    slot, store_id; ``present`` has obj_id, store_id.
    """
    epochs = layouts.select("epoch", "size").distinct()
    asked = objects.join(F.broadcast(epochs.orderBy(F.col("epoch").desc()).limit(KEPT))).withColumn("slot", F.pmod(F.col("hash"), F.col("size")).cast("int"))
    placed = asked.join(layouts.select("epoch", "slot", "store_id"), ["epoch", "slot"])
    hits = placed.join(present, ["obj_id", "store_id"], "left_semi")
    return hits.groupBy("obj_id").agg(F.max(F.struct("epoch", "store_id")).alias("h")).select("obj_id", "h.epoch", "h.store_id")


def movement(objects: DataFrame, old: DataFrame, new: DataFrame, old_size: int, new_size: int) -> DataFrame:
    """Counts of objects by whether their store changes between two layouts."""
    a = primary(objects, old, old_size).select("obj_id", F.col("store_id").alias("was"))
    b = primary(objects, new, new_size).select("obj_id", F.col("store_id").alias("now"))
    return a.join(b, "obj_id").groupBy((F.col("was") != F.col("now")).alias("moved")).agg(F.count(F.lit(1)).alias("objects"))
