"""Path algebra on STRING columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def components(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def join_components(parts: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def is_root(path: Column) -> Column:
    return F.regexp_replace(path, "/+$", "") == ""


def parent_name(path: Column) -> Column:
    """Struct (parent, name); null for the root."""
    parts = components(path)
    return F.when(F.size(parts) > 0, F.struct(
        join_components(F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("parent"), F.get(parts, F.size(parts) - 1).alias("name"),
    ))


def is_descendant(child: Column, parent: Column) -> Column:
    """Strictly below, at a segment boundary."""
    c, p = F.regexp_replace(child, "/+$", ""), F.regexp_replace(parent, "/+$", "")
    return (F.length(c) > F.length(p)) & F.startswith(c, F.concat(p, F.lit("/")))


def is_descendant_guarded(child: Column, parent: Column) -> Column:
    """The form that guards moves: the root counts as ancestor of nothing."""
    return ~is_root(parent) & is_descendant(child, parent)


def normalize_inner(path: Column) -> Column:
    """Trimmed, with a leading slash; null for nothing and for the root."""
    p = F.trim(path)
    return F.when(p.isNull() | p.isin("", "/"), F.lit(None).cast("string")).when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


def first_segment(path: Column) -> Column:
    """Struct (first, rest): the first segment, and what follows with a leading slash."""
    parts = components(path)
    rest = F.slice(parts, F.lit(2), F.size(parts))
    return F.struct(F.get(parts, 0).alias("first"), F.when(F.size(rest) > 0, join_components(rest)).alias("rest"))


def normalize_symlink(parent: Column, target: Column) -> Column:
    """Absolute path of a link's target: ``.`` and ``..`` resolved, above the root staying there."""
    start = F.when(target.startswith("/"), F.array().cast("array<string>")).otherwise(components(parent))
    steps = F.filter(components(target), lambda s: s != ".")
    done = F.aggregate(steps, start, lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, s)))
    return join_components(done)


def prefixes(path: Column) -> Column:
    """All prefixes of a path, shortest first, without the root."""
    parts = components(path)
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: join_components(F.slice(parts, F.lit(1), i)))).otherwise(F.array().cast("array<string>"))


def move_prefix(path: Column, old: Column, new: Column) -> Column:
    """The path under another prefix, if it is the prefix or lies below it."""
    return F.when(path == old, new).when(is_descendant(path, old), F.concat(new, F.substring(path, F.length(old) + 1, F.length(path)))).otherwise(path)
