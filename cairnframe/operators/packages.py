"""Package index queries: versions, ranges, latest, dependency closure, merges."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import package_ids, versions
from .overlay import last_wins


def latest(index: DataFrame, keys: tuple[str, ...] = ("pkg_name",)) -> DataFrame:
    """The row of the greatest version of each package; an aggregation with map-side combine."""
    rest = [c for c in index.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(versions.order_key(F.col("version")), "metaobjid"))
    return index.groupBy(*keys).agg(best.alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def in_range(index: DataFrame, low: int | Column, high: int | Column, tag: str | None = None) -> DataFrame:
    """Rows whose packed version lies in [low, high]; the bounds reach the scan."""
    rows = index.where(F.col("version_int").between(low, high))
    return rows if tag is None else rows.where(F.col("tag") == tag)


def matching(index: DataFrame, requirement: str, tag: str | None = None) -> DataFrame:
    """Rows that meet a requirement: the packed range first, then every comparator."""
    req = F.lit(requirement)
    bounds = versions.range_bounds(req)
    rows = index.where(F.coalesce(F.col("version_int").between(bounds["low"], bounds["high"]), F.lit(True)) & versions.satisfies(F.col("version"), req))
    return rows if tag is None else rows.where(F.col("tag") == tag)


def exact(index: DataFrame, metas: DataFrame, wanted: DataFrame) -> DataFrame:
    """Metas of wanted (pkg_name, version)."""
    return wanted.join(index, ["pkg_name", "version"]).join(metas, "metaobjid")


def is_latest(index: DataFrame) -> DataFrame:
    """Add ``is_latest`` to every row."""
    top = latest(index).select("pkg_name", F.col("metaobjid").alias("top"))
    return index.join(top, "pkg_name").withColumn("is_latest", F.col("metaobjid") == F.col("top")).drop("top")


def closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, node, depth, cycle): everything a start depends on, with the least depth.

    Rounds of joins on the frontier, as many as the longest chain; a node that
    was reached before is not expanded again, so diamonds and cycles end.
    ``cycle`` marks starts that reach themselves. The joins are merges: else each
    round would send what is small enough in it to the driver, to broadcast it.
    """
    from ..sources.scratch import checkpointed

    edges = edges.hint("merge")
    seen = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"))
    frontier = seen
    for d in count(1):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("start", F.col("dst").alias("node")).distinct()
        new = step.join(seen.select("start", "node").hint("merge"), ["start", "node"], "left_anti").withColumn("depth", F.lit(d))
        new = checkpointed(new)
        if new.isEmpty():
            break
        seen, frontier = seen.unionByName(new), new
    hits = seen.join(edges, seen["node"] == edges["src"]).where(F.col("dst") == F.col("start")).select(F.col("start").alias("s")).distinct()
    return seen.join(hits.hint("merge"), seen["start"] == hits["s"], "left").select("start", "node", "depth", F.col("s").isNotNull().alias("cycle"))


def lookup(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pkg_id, metaobjid, version): what each wanted package id names, all at once.

    An object id decides alone and must have the name. Else the version or the
    requirement, with its tag, picks the greatest version; no version means any.
    Ids that name nothing are left out. Joins go by object id, by name and version,
    and, for any version and for requirements, by name: with the greatest row of
    each tag, and with each version of each tag once.
    """
    asked = wanted.select("pkg_id").distinct().withColumn("p", package_ids.parse(F.col("pkg_id"))).where(F.col("p").isNotNull()).select(
        "pkg_id", "p.name", "p.objid", package_ids.version_request(F.coalesce("p.version", F.lit("*"))).alias("v")).where(F.col("v").isNotNull())
    rows = index.select("pkg_name", "version", "metaobjid", "tag")
    right = F.coalesce(F.col("v.tag") == F.col("tag"), F.col("v.tag").isNull()) & (
        (F.col("v.kind") == "any") | (F.col("v.kind") == "exact") & (versions.compare(F.col("version"), F.col("v.expr")) == 0)
        | (F.col("v.kind") == "req") & versions.satisfies(F.col("version"), F.col("v.expr")))
    by_id = asked.where(F.col("objid").isNotNull()).withColumn("metaobjid", F.explode(package_ids.spellings(F.col("objid"))))
    found = by_id.join(rows, "metaobjid").where(F.col("name") == F.col("pkg_name")).drop("objid")
    best = F.max_by(F.struct("metaobjid", "version"), F.struct(versions.order_key(F.col("version")), "metaobjid"))
    each = rows.groupBy("pkg_name", "version", "tag").agg(F.max("metaobjid").alias("metaobjid"))
    tops = each.groupBy("pkg_name", "tag").agg(best.alias("r")).select("pkg_name", "tag", "r.version", "r.metaobjid")
    named = lambda kind: asked.where(F.col("objid").isNull() & (F.col("v.kind") == kind)).drop("objid")
    same_name, at = F.col("name") == F.col("pkg_name"), lambda x: versions.order_key(F.col(x))
    exactly = named("exact").withColumn("asked_at", at("v.expr")).join(each.withColumn("at", at("version")), same_name & (F.col("asked_at") == F.col("at"))).drop("asked_at", "at")
    for rows_of_kind in (exactly, named("any").join(tops, same_name), named("req").join(each, same_name)):
        found = found.unionByName(rows_of_kind)
    found = found.where(right)
    return found.groupBy("pkg_id").agg(best.alias("r")).select("pkg_id", "r.metaobjid", "r.version")


def lookup_chain(indexes: list[DataFrame], wanted: DataFrame) -> DataFrame:
    """``lookup`` in an environment and then its parents: the first index that knows a package id answers; adds ``env``, its place."""
    found = None
    for env, index in enumerate(indexes):
        rows = lookup(index, wanted).withColumn("env", F.lit(env))
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("pkg_id").agg(F.min_by(F.struct("metaobjid", "version", "env"), "env").alias("r")).select("pkg_id", "r.*")


def is_latest_everywhere(indexes: list[DataFrame]) -> DataFrame:
    """(pkg_name, metaobjid, is_latest) of the first index: greatest there and in every parent that has the package."""
    own = is_latest(indexes[0]).select("pkg_name", "version", "metaobjid", "is_latest")
    for parent in indexes[1:]:
        top = latest(parent).select("pkg_name", F.col("version").alias("top"))
        own = own.join(top, "pkg_name", "left").withColumn("is_latest", F.col("is_latest") & (F.col("top").isNull() | (versions.compare(F.col("version"), F.col("top")) >= 0))).drop("top")
    return own.select("pkg_name", "metaobjid", "is_latest")


def by_update_time(index: DataFrame) -> DataFrame:
    """Add the place of each version in its package's list, the last updated first."""
    return index.withColumn("place", F.row_number().over(W.partitionBy("pkg_name").orderBy(F.col("update_time").desc(), "metaobjid")))


def merge_index(base: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Union of two indexes; on equal keys the incoming row wins, and of equal rows of one side the greatest."""
    rest = sorted(c for c in base.columns if c not in keys)
    both = base.withColumn("__p", F.lit(0)).unionByName(incoming.withColumn("__p", F.lit(1)))
    return last_wins(both, keys, ["__p", *rest]).drop("__p")


def remote_is_better(local: DataFrame, remote: DataFrame, key: str = "name") -> DataFrame:
    """Add ``better`` to remote files (key, size, content): absent here, or another size or content."""
    mine = local.select(key, F.col("size").alias("s"), F.col("content").alias("c"))
    return remote.join(mine, key, "left").withColumn("better", F.col("s").isNull() | (F.col("s") != F.col("size")) | (F.col("c") != F.col("content"))).drop("s", "c")
