"""Object headers, precedence of ids, dispatch of pulls, ranges of transfers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import ids

# HTTP status of a chunk query to its state there.
REMOTE_STATES = {200: "completed", 404: "not_exist", 206: "incompleted", 201: "new"}


def headers(values: Column, prefix: str) -> Column:
    """Struct (obj_id, obj_size, root_obj_id, path_obj) of a map of response headers, names in any case."""
    low = F.transform_keys(values, lambda k, _: F.lower(k))
    at = lambda name: F.element_at(low, f"{prefix}-{name}".lower())
    size = at("obj-size")
    return F.struct(
        ids.parse_id(at("obj-id")).alias("obj_id"), F.when(size.rlike("^[0-9]{1,18}$"), size.cast("bigint")).alias("obj_size"),
        ids.parse_id(at("root-obj-id")).alias("root_obj_id"), at("path-obj").alias("path_obj"),
    )


def merge_head(found: Column, head: Column) -> Column:
    """Header fields with the gaps filled from an inline head of the same shape."""
    return F.struct(*[F.coalesce(found[c], head[c]).alias(c) for c in ("obj_id", "obj_size", "root_obj_id", "path_obj")])


def head_kind(raw: Column) -> Column:
    """What an inline head holds: id, headers, file, dir or chunk list; null for none of them."""
    has = lambda p: F.get_json_object(raw, p).isNotNull()
    return (
        F.when(ids.parse_id(F.trim(raw)).isNotNull(), "id").when(F.ltrim(raw).startswith("["), "chunk_list")
        .when(has("$.body"), "dir").when(has("$.content") | has("$.size"), "file").when(F.ltrim(raw).startswith("{"), "headers")
    )


def effective_id(known: Column, header: Column, head: Column, url: Column) -> Column:
    return F.coalesce(known, header, head, url)


def pull_kind(obj_id: Column) -> Column:
    """How an object is pulled: as a chunk, a chunk list or a file; directories are not."""
    kind = ids.id_type(obj_id)
    return F.when(ids.is_chunk(kind), "chunk").when(ids.is_chunk_list(kind), "chunk_list").when(kind == ids.FILE, "file").otherwise("unsupported")


def byte_range(start: Column, end: Column) -> Column:
    """Range header of the half-open [start, end)."""
    return F.concat(F.lit("bytes="), start.cast("string"), F.lit("-"), (end - 1).cast("string"))


def remote_state(status: Column) -> Column:
    pairs = [F.lit(x) for p in REMOTE_STATES.items() for x in p]
    return F.element_at(F.create_map(*pairs), status.cast("int"))


def left_to_push(size: Column, uploaded: Column, state: Column) -> Column:
    """Bytes that a push still has to send."""
    return F.when(state == "completed", 0).otherwise(F.greatest(size - F.coalesce(uploaded, F.lit(0)), F.lit(0))).cast("bigint")
