"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks.

Three steps, with DataFrame functions only:

1. Targets. Sources in code-point order (null last) weigh 1, 2, 3, repeating,
   and share all words; a target above ``MAX_REPEAT`` times its source stops
   there and the excess is shared again by weight. Sorted by the ratio of cap
   to weight, the capped sources come first, so one running sum finds them.
2. Quotas. The words become blocks of ``block`` words. Blocks go to sources,
   and each source's blocks to its shards, by highest quotients w / (2k + 1).
   Rounding w / divisor gives every quota up to a few seats; only the next few
   quotients of each row compete for the seats left over or given too many
   (at most four times as many rows as there are quotas).
3. Selection. A shard's documents stand in an order seeded by a hash of their
   ids; the shard's quota takes them from the start, round after round.

A source with many documents has many shards, so no window and no task holds a
hot source whole. Reruns agree: everything depends on values, seed and counts.

Defined results: a null text has size 0 and is taken 0 times; a null source is
a source; an empty table gives an empty table; repeated rows are each placed;
only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import materialize, n_words, words

MAX_REPEAT = 3
BLOCK = 64
#: Documents that a shard holds on average.
SHARD_DOCS = 4096
SEED = "mix-1"


def sizes(docs: DataFrame, text: str = "text", seed: str = SEED) -> DataFrame:
    """doc_id, source, size in words, and the seeded order key."""
    return docs.select(
        "doc_id", "source", n_words(F.col(text)).alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")).alias("h"),
    )


def targets(by_source: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Add ``target`` to rows of (source, n_docs, source_size).

    The two windows without partitions hold one row a source.
    """
    rows = by_source.withColumn("w", 1 + (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % 3)
    rows = rows.withColumn("cap", max_repeat * F.col("source_size"))
    before = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    rows = rows.withColumns({
        "all_size": F.sum("source_size").over(every), "all_w": F.sum("w").over(every),
        "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)), "w_before": F.coalesce(F.sum("w").over(before), F.lit(0)),
    })
    dbl = lambda c: F.col(c).cast("double")
    rows = rows.withColumn("capped", dbl("cap") * (dbl("all_w") - dbl("w_before")) < (dbl("all_size") - dbl("cap_before")) * dbl("w"))
    held = lambda c: F.coalesce(F.sum(F.when(F.col("capped"), F.col(c))).over(every), F.lit(0))
    rows = rows.withColumns({"cap_held": held("cap"), "w_held": held("w")})
    share = ((F.col("all_size") - F.col("cap_held")) * F.col("w")).cast("double") / (F.col("all_w") - F.col("w_held")).cast("double")
    return rows.withColumn("target", F.when(F.col("capped"), dbl("cap")).otherwise(share)).select(
        "source", "n_docs", "source_size", "target", "all_size"
    )


def apportion(rows: DataFrame, group: list[str], order: list[Column], weight: str, seats: str, quota: str) -> DataFrame:
    """Add ``quota``: integer shares of ``seats`` within each group, by Sainte-Lague.

    ``seats`` has one value a group; ties go to the first row by ``order``.
    """
    g = W.partitionBy(*group)
    w = F.col(weight).cast("double")
    rows = rows.withColumns({"__all": F.sum(w).over(g), "__n": F.count(F.lit(1)).over(g), "__at": F.row_number().over(g.orderBy(*order))})
    rows = rows.withColumn("__q", F.when(F.col("__all") > 0, F.floor(F.col(seats).cast("double") * w / F.col("__all") + 0.5)).otherwise(F.lit(0)).cast("long"))
    rows = rows.withColumn("__diff", F.when(F.col("__all") > 0, F.col(seats) - F.sum("__q").over(g)).otherwise(F.lit(0)))
    near = (F.floor(2 * F.col("__n") * w / F.greatest(F.col("__all"), F.lit(1.0))) + 2).cast("int")
    tries = rows.withColumn("__k", F.explode(F.sequence(F.lit(0), F.when(F.col("__diff") == 0, F.lit(0)).otherwise(near))))
    # The quotient that the k-th further seat would have, or that the k-th last seat has.
    odd = F.when(F.col("__diff") >= 0, 2 * (F.col("__q") + F.col("__k")) + 1).otherwise(2 * (F.col("__q") - F.col("__k")) - 1)
    tries = tries.withColumn("__quotient", F.when(odd > 0, w / odd))
    ranked = W.partitionBy(*group).orderBy(
        F.col("__quotient").isNull(), F.when(F.col("__diff") >= 0, -F.col("__quotient")).otherwise(F.col("__quotient")),
        F.when(F.col("__diff") >= 0, F.col("__at")).otherwise(-F.col("__at")), "__k",
    )
    keep = list(dict.fromkeys(c for c in rows.columns if not c.startswith("__")))
    moved = (F.row_number().over(ranked) <= F.abs("__diff")) & F.col("__quotient").isNotNull()
    return (
        tries.withColumn("__moved", moved)
        .groupBy(*keep, "__q", "__diff").agg(F.sum(F.col("__moved").cast("long")).alias("__m"))
        .withColumn(quota, F.col("__q") + F.signum("__diff").cast("long") * F.col("__m"))
        .select(*keep, quota)
    )


def mix(docs: DataFrame, block: int = BLOCK, max_repeat: int = MAX_REPEAT, shard_docs: int = SHARD_DOCS, seed: str = SEED, text: str = "text") -> DataFrame:
    """doc_id, size, source, source_size, target, and ``taken``, the words the mix takes."""
    sized = materialize(sizes(docs, text, seed), "mix-sizes")
    by_source = targets(sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size")), max_repeat)
    total = F.floor(F.col("all_size").cast("double") / block + 0.5).cast("long")
    quotas = apportion(
        by_source.withColumns({"total": total, "one": F.lit(1)}), ["one"], [F.col("source").asc_nulls_last()], "target", "total", "blocks"
    ).withColumn("n_shards", F.ceil(F.col("n_docs").cast("double") / shard_docs).cast("long"))
    quotas = materialize(quotas.select(F.col("source").alias("s"), "source_size", "target", "blocks", "n_shards"), "mix-quotas")

    same = lambda a, b: a.eqNullSafe(b)
    placed = sized.join(quotas, same(F.col("source"), F.col("s"))).withColumn(
        "shard", F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % F.col("n_shards")
    )
    cells = placed.groupBy("s", "shard", "blocks").agg(F.sum("size").alias("cell_size"))
    cells = apportion(cells, ["s"], [F.col("shard")], "cell_size", "blocks", "cell_blocks").withColumn(
        "cell_words", F.least(F.col("cell_blocks") * block, F.col("cell_size") * max_repeat)
    ).select(F.col("s").alias("cs"), F.col("shard").alias("c_shard"), "cell_size", "cell_words")
    upto = W.partitionBy("s", "shard").orderBy("h", "size").rowsBetween(W.unboundedPreceding, 0)
    lines = placed.join(cells, same(F.col("s"), F.col("cs")) & (F.col("shard") == F.col("c_shard"))).withColumn(
        "start", F.sum("size").over(upto) - F.col("size")
    )
    whole = F.when(F.col("cell_size") > 0, F.expr("cell_words div cell_size")).otherwise(F.lit(0))
    rest = F.when(F.col("cell_size") > 0, F.col("cell_words") % F.col("cell_size")).otherwise(F.lit(0))
    taken = F.col("size") * whole + F.least(F.greatest(rest - F.col("start"), F.lit(0)), F.col("size"))
    return lines.select("doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken"))


def take(docs: DataFrame, mixed: DataFrame, text: str = "text") -> DataFrame:
    """The documents as the mix takes them, in the columns of ``docs``.

    ``mixed`` has one row a doc_id. A document taken for a whole multiple of its
    size is repeated so often; a remainder adds its first words, joined by
    single spaces. Documents without words take no part.
    """
    share = mixed.select(F.col("doc_id").alias("__id"), F.col("size").alias("__size"), F.col("taken").alias("__taken")).where("__taken > 0")
    rows = docs.join(share, docs["doc_id"] == F.col("__id"))
    rest = (F.col("__taken") % F.col("__size")).cast("int")
    part = F.when(rest > 0, F.array_join(F.slice(words(F.col(text)), F.lit(1), F.greatest(rest, F.lit(1))), " "))
    whole = F.array_repeat(F.col(text), F.expr("__taken div __size").cast("int"))
    copies = F.concat(whole, F.when(rest > 0, F.array(part)).otherwise(F.array().cast("array<string>")))
    return rows.withColumn(text, F.explode(copies)).select(*docs.columns)
