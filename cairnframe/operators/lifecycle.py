"""File lifecycle as decision tables over columns: open, close, link, finalize.

States of a node go FileNormal -> Working -> Cooling -> Linked -> Finalized.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids

# Codes of node states, and the size up to which a file is finalized at once.
STATES = ("DirNormal", "DirOverlay", "Working", "Cooling", "Linked", "Finalized", "FileNormal")
DIRECT_BYTES = 64 * 1024 * 1024
FLAGS = ("Append", "ContinueWrite", "CreateExclusive", "CreateOrTruncate", "CreateOrAppend")


def state_name(code: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in STATES]), code.cast("int"))


def node_kind(state: Column, obj_id: Column) -> Column:
    """Dir, File or Object; linked and finalized nodes go by the type of their object."""
    kind = ids.id_type(obj_id)
    by_object = F.when(ids.is_container(kind) & (kind == ids.DIRECTORY), "Dir").when(kind == ids.FILE, "File").otherwise("Object")
    return F.when(state.isin("DirNormal", "DirOverlay"), "Dir").when(state.isin("Linked", "Finalized"), by_object).otherwise("File")


def node_object(state: Column, linked: Column, finalized: Column, base: Column) -> Column:
    """The object that a node stands for, by its state."""
    return F.when(state == "Linked", linked).when(state == "Finalized", finalized).otherwise(base)


def open_writer(requests: DataFrame) -> DataFrame:
    """Add outcome, truncates and keeps_base to requests (flag, entry, state).

    ``entry`` is what stands at the path: absent, tombstone, object, directory,
    link or inode (then ``state`` is its state). A file that is being written is
    opened only to continue, and continuing needs Working or Cooling. Flags that
    truncate clear the base.
    """
    flag, entry, state = F.col("flag"), F.col("entry"), F.col("state")
    none = entry.isin("absent", "tombstone")
    outcome = (
        F.when(entry == "directory", "is_directory").when(entry == "link", "is_link")
        .when(none, F.when(flag.isin("Append", "ContinueWrite"), "not_found").otherwise("created"))
        .when(flag == "CreateExclusive", "exists")
        .when(flag == "ContinueWrite", F.when((entry == "inode") & state.isin("Working", "Cooling"), "resumed").otherwise("conflict"))
        .when((entry == "inode") & (state == "Working"), "conflict")
        .otherwise("opened")
    )
    truncates = flag.isin("CreateExclusive", "CreateOrTruncate")
    opened = F.col("outcome").isin("created", "opened", "resumed")
    return requests.withColumn("outcome", outcome).withColumns({
        "truncates": opened & truncates, "keeps_base": opened & ~truncates & ~none,
    })


def close_writer(state: Column) -> Column:
    return F.when(state.isin("Working", "Cooling"), "Cooling").otherwise(state)


def reader_source(state: Column) -> Column:
    """Where a reader finds the bytes: the write buffer, or an object."""
    return F.when(state.isin("Working", "Cooling"), "buffer").when(state.isin("Linked", "Finalized", "FileNormal"), "object")


def after_naming(size: Column) -> Column:
    """State after a closed file got its id: small ones are final at once, others stay linked to their buffer."""
    return F.when(size <= DIRECT_BYTES, "Finalized").otherwise("Linked")


def content_layout(n_chunks: Column) -> Column:
    return F.when(n_chunks == 1, "single").otherwise("list")


def finalize(nodes: DataFrame, now) -> DataFrame:
    """Promote Linked nodes: the linked object becomes final, and the node read-only. Done twice, it changes nothing."""
    hit = F.col("state") == "Linked"
    return nodes.withColumn("__hit", hit).withColumns({
        "finalized_obj_id": F.when(F.col("__hit"), F.col("linked_obj_id")).otherwise(F.col("finalized_obj_id")),
        "finalized_at": F.when(F.col("__hit"), F.lit(now)).otherwise(F.col("finalized_at")),
        "state": F.when(F.col("__hit"), "Finalized").otherwise(F.col("state")),
    }).drop("__hit")


def resume_chunk_writer(state: Column, offset: Column, written: Column) -> Column:
    """Position at which a chunk's writer goes on; an offset of 0 means the end; null where it may not open."""
    free = state.isin("incompleted", "new", "not_exist")
    return F.when(free & (offset <= written), F.when(offset == 0, written).otherwise(offset))
