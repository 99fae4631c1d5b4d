"""Fixed-size chunking, chunk lists, byte ranges and verification.

Payloads are BINARY columns. Chunking is one generate per row: no shuffle.
Payloads stay out of joins until the last step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import hashing, ids

#: Default size of a chunk, in bytes.
CHUNK_SIZE = 32 * 1024 * 1024


def split_chunks(files: DataFrame, key: str, data: str = "content", size: int = CHUNK_SIZE) -> DataFrame:
    """(key, idx, start, chunk_size, payload): the chunks of each file; an empty file gives one empty chunk."""
    n = F.length(data)
    last = F.greatest(F.ceil(n / size).cast("int") - 1, F.lit(0))
    rows = files.select(F.col(key), F.col(data), F.explode(F.sequence(F.lit(0), last)).alias("idx"))
    start = F.col("idx").cast("bigint") * size
    return rows.select(key, "idx", start.alias("start"), F.substring(data, (start + 1).cast("int"), F.lit(size)).alias("payload")).select(
        key, "idx", "start", F.length("payload").cast("bigint").alias("chunk_size"), "payload"
    )


def chunk_ids(files: DataFrame, key: str, data: str = "content", size: int = CHUNK_SIZE, method: str = "sha256") -> DataFrame:
    """(key, idx, start, chunk_size, chunk_id) with length-carrying ids."""
    return split_chunks(files, key, data, size).select(key, "idx", "start", "chunk_size", hashing.mix_chunk_id(F.col("payload"), method).alias("chunk_id"))


def dedup(chunks: DataFrame) -> DataFrame:
    """(chunk_id, chunk_size, copies, bytes_saved); ids carry the size, so the group key is one string."""
    return chunks.groupBy("chunk_id", "chunk_size").agg(F.count(F.lit(1)).alias("copies")).withColumn(
        "bytes_saved", (F.col("copies") - 1) * F.col("chunk_size")
    )


def chunk_lists(chunks: DataFrame, key: str) -> DataFrame:
    """(key, n_chunks, total_size, list_json, list_id): the list object of each file.

    The id is the hash of the canonical array behind the length of the whole.
    Its collection is bounded by the chunks of one file.
    """
    grouped = chunks.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("idx", "chunk_id"))).alias("c"), F.sum("chunk_size").alias("total_size"),
    )
    text = F.concat(F.lit("["), F.array_join(F.transform("c.chunk_id", lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ","), F.lit("]"))
    return grouped.select(key, F.size("c").cast("bigint").alias("n_chunks"), "total_size", text.alias("list_json")).withColumn(
        "list_id", ids.make_id(ids.CHUNK_LIST, ids.mix_hash(F.col("total_size"), F.unhex(F.sha2("list_json", 256))))
    )


def list_items(list_json: Column) -> Column:
    return F.from_json(list_json, "array<string>")


def offsets(chunks: DataFrame, key: str, idx: str = "idx", size: str = "chunk_size") -> DataFrame:
    """Add ``start``: the bytes before each chunk of its list."""
    before = W.partitionBy(key).orderBy(idx).rowsBetween(W.unboundedPreceding, -1)
    return chunks.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)).cast("bigint"))


def sizes_of(chunk_id: Column, explicit: Column | None = None, local: Column | None = None, fixed: Column | None = None) -> Column:
    """A chunk's size by precedence: explicit, local, carried by the id, fixed; null if none is known."""
    known = [c for c in (explicit, local) if c is not None] + [ids.content_length(chunk_id)] + ([fixed] if fixed is not None else [])
    return F.coalesce(*known)


def fixed_size(idx: Column, total: Column, fixed: int) -> Column:
    """Size of chunk ``idx`` of a list of fixed-size chunks: the last one takes what remains."""
    return F.when(total == 0, F.lit(fixed)).otherwise(F.least(F.lit(fixed), total - idx * fixed)).cast("bigint")


def seek_target(kind: str, offset: Column, position: Column, total: Column) -> Column:
    """Position of a seek from start, current or end; null outside [0, total]."""
    at = {"start": offset, "current": position + offset, "end": total + offset}[kind]
    return F.when(at.between(0, total), at)


def locate(reads: DataFrame, chunks: DataFrame, key: str, bucket: int = CHUNK_SIZE) -> DataFrame:
    """(key, position, idx, chunk_offset) of each read (key, position); at or past the end: (n, 0).

    A chunk covers a few buckets of ``bucket`` bytes and a read lies in one, so
    the range join is an equi-join on (key, bucket).
    """
    spans = offsets(chunks, key).where("chunk_size > 0")
    tiles = spans.select(key, "idx", "start", "chunk_size", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor((F.col("start") + F.col("chunk_size") - 1) / bucket))).alias("tile"))
    totals = chunks.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("n"))
    asked = reads.withColumn("tile", F.floor(F.col("position") / bucket))
    hit = asked.join(tiles, [key, "tile"], "left").where(
        "start IS NULL OR (position >= start AND position < start + chunk_size)"
    ).select(key, "position", "idx", (F.col("position") - F.col("start")).alias("at"))
    found = asked.select(key, "position").distinct().join(hit.where("idx IS NOT NULL"), [key, "position"], "left").join(totals, key)
    return found.select(key, "position", F.coalesce("idx", "n").alias("idx"), F.coalesce("at", F.lit(0)).alias("chunk_offset"))


def read_ranges(files: DataFrame, reads: DataFrame, key: str, data: str = "content") -> DataFrame:
    """(key, start, length, piece): byte ranges of files."""
    return reads.join(files, key).select(
        key, "start", "length", F.substring(data, (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("piece")
    )


def verify(claims: DataFrame, data: str = "content", claimed: str = "chunk_id") -> DataFrame:
    """Add ``ok``: whether the content has the claimed id; null for hash types that need Python."""
    return claims.withColumn("ok", hashing.expected_id(F.col(data), F.col(claimed)) == F.col(claimed))


def missing(required: DataFrame, available: DataFrame, on: str = "chunk_id") -> DataFrame:
    """Required rows whose chunk is not available."""
    return required.join(available.select(on).distinct(), on, "left_anti")


def readable(state: Column) -> Column:
    return state.isin("completed", "local_link")


def writable(state: Column) -> Column:
    return state.isin("incompleted", "new", "not_exist")


def merkle_root(leaves: DataFrame, key: str, levels: int = 40) -> DataFrame:
    """(key, root): pairwise hashes, level by level, inside each list; a lone last node is hashed alone.

    ``leaves`` has key, idx and hash. Levels run on arrays of a list, whose
    length is its number of chunks.
    """
    nodes = leaves.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("idx", "hash"))).alias("h")).select(key, F.col("h.hash").alias("h"))
    pair = lambda h: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(h) - 1) / 2).cast("int")), lambda i: hashing.parent_hash(F.get(h, 2 * i), F.get(h, 2 * i + 1)))
    step = lambda h, _: F.when(F.size(h) <= 1, h).otherwise(pair(h))
    return nodes.select(key, F.get(F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.col("h"), step), 0).alias("root"))
