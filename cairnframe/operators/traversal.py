"""Path resolution, directory roll-ups and thread depth, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids, paths
from ..sources.scratch import checkpointed
from .objects import json_object, json_string


def resolve(wanted: DataFrame, entries: DataFrame, links: int = 0) -> DataFrame:
    """(path, status, node, rest) of wanted paths, all at once.

    ``entries`` has parent, name, kind (dir, object, link, tombstone), node and
    target (of links). Directories consume one segment a round. At an object
    with segments left, those are its inner path (``rest``). A link is followed
    while the budget lasts, else it is the result with the tail as ``rest``. Rounds
    end by themselves: each takes a segment, or a link of the budget.
    """
    state = wanted.select("path", F.lit("/").alias("node"), paths.components(F.col("path")).alias("parts"), F.lit(links).alias("budget"), F.lit("dir").alias("status"))
    done, going = None, (F.size("parts") > 0) & (F.col("status") == "dir")
    while True:
        state = checkpointed(state)
        done = state.where(~going) if done is None else done.unionByName(state.where(~going))
        open_ = state.where(going)
        if open_.isEmpty():
            break
        e = entries.select(F.col("parent").alias("e_parent"), F.col("name").alias("e_name"), F.col("kind").alias("e_kind"), F.col("node").alias("e_node"), F.col("target").alias("e_target"))
        j = open_.join(e, (F.col("node") == F.col("e_parent")) & (F.get("parts", 0) == F.col("e_name")), "left")
        rest = F.slice("parts", F.lit(2), F.size("parts"))
        follow = (F.col("e_kind") == "link") & (F.col("budget") > 0)
        linked = F.concat(paths.components(paths.normalize_symlink(F.col("node"), F.col("e_target"))), rest)
        state = j.select(
            "path",
            F.when(follow, F.lit("/")).otherwise(F.coalesce("e_node", "node")).alias("node"),
            F.when(follow, linked).otherwise(rest).alias("parts"),
            (F.col("budget") - F.when(follow, 1).otherwise(0)).alias("budget"),
            F.when(follow, F.lit("dir")).when(F.col("e_kind").isNull() | (F.col("e_kind") == "tombstone"), F.lit("missing")).otherwise(F.col("e_kind")).alias("status"),
        )
    missing = F.col("status") == "missing"
    return done.select("path", "status", F.when(~missing, F.col("node")).alias("node"), F.when(~missing & (F.size("parts") > 0), paths.join_components(F.col("parts"))).alias("rest"))


def rollup(files: DataFrame) -> DataFrame:
    """(path, file_count, file_size, total_size) of every directory of files (path, size).

    Counts and ``file_size`` take direct files only; ``total_size`` everything
    below. One explode over prefixes and one aggregation with map-side combine.
    """
    parts = paths.components(F.col("path"))
    rows = files.select("size", F.size(parts).alias("n"), F.posexplode(F.concat(F.array(F.lit("/")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: paths.join_components(F.slice(parts, F.lit(1), i))))).alias("level", "dir"))
    direct = F.col("level") == F.col("n") - 1
    return rows.where(F.col("level") < F.col("n")).groupBy(F.col("dir").alias("path")).agg(
        F.sum(direct.cast("bigint")).alias("file_count"), F.sum(F.when(direct, F.col("size")).otherwise(0)).alias("file_size"), F.sum("size").alias("total_size")
    )


def directory_ids(files: DataFrame) -> DataFrame:
    """(path, obj_id, total_size) of every directory of files (path, size, obj_id), bottom-up.

    A directory's text has its name, its statistics and its children's ids by
    name. Levels are rounds: as many as the tree is deep.
    """
    stats = rollup(files)
    parts = paths.components(F.col("path"))
    stats = stats.withColumn("level", F.size(parts))
    top = stats.agg(F.max("level")).first()[0] or 0
    named = lambda df: df.withColumn("up", F.when(F.size(parts) > 0, paths.join_components(F.slice(parts, F.lit(1), F.size(parts) - 1)))).withColumn("name", F.get(parts, F.size(parts) - 1))
    below = named(files.select("path", "obj_id"))
    out = None
    kids = below.select("up", "name", "obj_id")
    for level in range(top, -1, -1):
        body = kids.groupBy("up").agg(F.sort_array(F.collect_list(F.struct("name", "obj_id"))).alias("k")).select(
            F.col("up").alias("path"), F.concat(F.lit("{"), F.array_join(F.transform("k", lambda x: F.concat(json_string(x["name"]), F.lit(':"'), x["obj_id"], F.lit('"'))), ","), F.lit("}")).alias("body")
        )
        rows = named(stats.where(F.col("level") == level).join(body, "path"))
        text = json_object({
            "name": F.when(F.col("name").isNotNull(), json_string(F.col("name"))), "create_time": F.lit("0"), "last_update_time": F.lit("0"),
            "total_size": F.col("total_size").cast("string"), "file_count": F.col("file_count").cast("string"), "file_size": F.col("file_size").cast("string"), "body": F.col("body"),
        })
        rows = checkpointed(rows.select("path", "up", "name", F.concat(F.lit(f"{ids.DIRECTORY}:"), F.sha2(text, 256)).alias("obj_id"), "total_size"))
        out = rows if out is None else out.unionByName(rows)
        kids = kids.unionByName(rows.where(F.col("up").isNotNull()).select("up", "name", "obj_id"))
    return out.select("path", "obj_id", "total_size")


def thread_depth(messages: DataFrame, rounds: int = 40) -> DataFrame:
    """(msg_id, root, depth) along reply links (msg_id, reply_to), by pointer doubling.

    Rounds grow with the logarithm of the longest chain. A reply to an unknown
    message is a root.
    """
    known = messages.select(F.col("msg_id").alias("k"))
    state = messages.join(known, messages["reply_to"] == known["k"], "left").select("msg_id", F.col("k").alias("up"), F.when(F.col("k").isNotNull(), 1).otherwise(0).cast("bigint").alias("depth"))
    for _ in range(rounds):
        jump = state.select(F.col("msg_id").alias("j"), F.col("up").alias("j_up"), F.col("depth").alias("j_depth"))
        state = checkpointed(state.join(jump, state["up"] == jump["j"], "left").select(
            "msg_id", F.when(F.col("j_up").isNotNull(), F.col("j_up")).otherwise(F.col("up")).alias("up"),
            F.when(F.col("j_up").isNotNull(), F.col("depth") + F.col("j_depth")).otherwise(F.col("depth")).alias("depth"), F.col("j_up").isNotNull().alias("moved"),
        ))
        if state.where("moved").isEmpty():
            break
        state = state.drop("moved")
    return state.select("msg_id", F.coalesce("up", "msg_id").alias("root"), "depth")
