"""Overlay listings, paging and namespace folds.

A directory is a base (an object's children) under an upper layer of entries;
an upper entry overrides by name, and a tombstone hides. Names compare by bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOMBSTONE = "tombstone"


def merge(base: DataFrame, upper: DataFrame, keys: tuple[str, ...] = ("parent", "name")) -> DataFrame:
    """(keys, target, origin) of base (keys, target) under upper (keys, kind, target)."""
    b = base.select(*keys, F.col("target").alias("b"))
    u = upper.select(*keys, F.col("kind").alias("k"), F.col("target").alias("u"))
    joined = b.join(u, list(keys), "full_outer").where(~F.col("k").eqNullSafe(TOMBSTONE))
    return joined.select(*keys, F.when(F.col("k").isNotNull(), F.col("u")).otherwise(F.col("b")).alias("target"), F.when(F.col("k").isNotNull(), "upper").otherwise("base").alias("origin"))


def page(entries: DataFrame, after: str | None, size: int, name: str = "name") -> DataFrame:
    """One keyset page: names past ``after``, ascending; size 0 is unlimited."""
    rows = entries if after is None else entries.where(F.col(name) > after)
    rows = rows.orderBy(name)
    return rows.limit(size) if size else rows


def pages(entries: DataFrame, size: int, keys: tuple[str, ...] = ("parent",), name: str = "name") -> DataFrame:
    """Add the page number of each entry, from 0, to all listings at once."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(name))
    return entries.withColumn("page", F.floor((rank - 1) / size).cast("bigint"))


def free_names(wanted: DataFrame, base: DataFrame, upper: DataFrame, keys: tuple[str, ...] = ("parent", "name")) -> DataFrame:
    """Wanted names that may be created: not taken by upper, nor by a base entry that no tombstone hides."""
    return wanted.join(merge(base, upper, keys).select(*keys), list(keys), "left_anti")


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``; one aggregation with map-side combine, no sort of groups."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def fold(log: DataFrame) -> DataFrame:
    """Entries that a mutation log leaves, per (parent, name).

    ``log`` has seq, op (set, delete, move_in, move_out), parent, name, target.
    A delete and the source of a move leave a tombstone; the rest bind a
    target. Each parent's revision is the number of its mutations.
    """
    kind = F.when(F.col("op").isin("delete", "move_out"), TOMBSTONE).otherwise("object")
    rows = last_wins(log.withColumn("kind", kind).select("parent", "name", "seq", "kind", "target"), ["parent", "name"], ["seq"])
    revs = log.groupBy("parent").agg(F.count(F.lit(1)).alias("rev"))
    return rows.join(revs, "parent").select("parent", "name", "kind", F.when(F.col("kind") != TOMBSTONE, F.col("target")).alias("target"), "rev")


def compare_and_set(nodes: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Nodes after changes (key, old_*, new_*): applied where every column equals its old value, nulls included.

    Adds ``updated``. ``changes`` has one row a key.
    """
    joined = nodes.join(changes, key, "left")
    hit = F.lit(True)
    for c in columns:
        hit = hit & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    hit = F.col("__change").isNotNull() & hit
    joined = nodes.join(changes.withColumn("__change", F.lit(1)), key, "left").withColumn("updated", hit)
    return joined.select(*[F.when(F.col("updated"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in nodes.columns], "updated")


def rename_subtree(paths: DataFrame, old: str, new: str, column: str = "path") -> DataFrame:
    """Rewrite a subtree's paths; what stood under the new prefix is replaced."""
    from ..functions.paths import is_descendant, move_prefix

    p = F.col(column)
    below = lambda x: (p == x) | is_descendant(p, F.lit(x))
    return paths.where(below(old) | ~below(new)).withColumn(column, move_prefix(p, F.lit(old), F.lit(new)))


def remove_subtree(paths: DataFrame, top: str, column: str = "path") -> DataFrame:
    from ..functions.paths import is_descendant

    return paths.where(~((F.col(column) == top) | is_descendant(F.col(column), F.lit(top))))
