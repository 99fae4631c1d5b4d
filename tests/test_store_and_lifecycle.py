import hashlib

from pyspark.sql import functions as F

from cairnframe.operators import lifecycle, locators
from cairnframe.sources import store


def test_open_writer(spark):
    asked = [("Append", "absent", None, "not_found", False), ("CreateExclusive", "tombstone", None, "created", False), ("CreateExclusive", "object", None, "exists", False),
             ("ContinueWrite", "inode", "Cooling", "resumed", True), ("ContinueWrite", "inode", "Linked", "conflict", False), ("Append", "inode", "Working", "conflict", False),
             ("CreateOrTruncate", "inode", "Linked", "opened", False), ("Append", "object", None, "opened", True), ("Append", "link", None, "is_link", False), ("Append", "directory", None, "is_directory", False)]
    got = lifecycle.open_writer(spark.createDataFrame(asked, "flag string, entry string, state string, want string, base boolean"))
    assert all(r.outcome == r.want and r.keeps_base == r.base for r in got.collect())


def test_finalize_twice(spark):
    nodes = spark.createDataFrame([("Linked", "cyfile:aa", None, None), ("Working", None, None, None)], "state string, linked_obj_id string, finalized_obj_id string, finalized_at long")
    once = lifecycle.finalize(nodes, 9)
    assert once.collect() == lifecycle.finalize(once, 10).collect() and once.first().finalized_obj_id == "cyfile:aa"
    kinds = spark.createDataFrame([("DirOverlay", None), ("Cooling", None), ("Linked", "cydir:aa"), ("Finalized", "pkg:aa")], "s string, o string").select(lifecycle.node_kind(F.col("s"), F.col("o")))
    assert [r[0] for r in kinds.collect()] == ["Dir", "File", "Dir", "Object"]


def test_headers_and_ranges(spark):
    h = spark.createDataFrame([({"X-Obj-Id": "sha256:AA", "x-obj-size": "12"},)], "h map<string,string>").select(locators.headers(F.col("h"), "x").alias("h"))
    assert tuple(h.first().h) == ("sha256:aa", 12, None, None)
    r = spark.range(1).select(locators.byte_range(F.lit(3), F.lit(7)), locators.remote_state(F.lit(206)), locators.remote_state(F.lit(500)), locators.pull_kind(F.lit("clist:aa")), locators.head_kind(F.lit('{"body":{}}'))).first()
    assert list(r) == ["bytes=3-6", "incompleted", None, "chunk_list", "dir"]


def test_chunk_and_object_tables(spark, tmp_path):
    name = lambda b: "sha256:" + hashlib.sha256(b).hexdigest()
    schema = "chunk_id string, chunk_size long, chunk_state string, local_path string, progress string, update_time long, payload binary"
    row = lambda i, b, t: (i, 0, "new", None, None, t, bytearray(b))
    now = store.put_chunks(spark.createDataFrame([], schema), spark.createDataFrame([row(name(b"a"), b"a", 1), row(name(b"a"), b"a", 2), row(name(b"b"), b"x", 3)], schema))
    assert [(r.chunk_id, r.update_time, r.chunk_state) for r in now.collect()] == [(name(b"a"), 1, "completed")]
    again = store.put_chunks(now, spark.createDataFrame([row(name(b"a"), b"a", 9), row(name(b"c"), b"c", 9)], schema))
    assert sorted(r.update_time for r in again.collect()) == [1, 9]
    objs = store.upsert(spark.createDataFrame([("o:aa", "v1", 1), ("o:bb", "w", 1)], "obj_id string, v string, t long"), spark.createDataFrame([("o:aa", "v2", 2)], "obj_id string, v string, t long"), "obj_id", "t")
    store.write_table(objs, str(tmp_path / "t"), "obj_id")
    assert store.get(spark, str(tmp_path / "t"), "obj_id", "o:aa").first().v == "v2"
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "x.bin").write_bytes(b"abc")
    assert bytes(store.binary_files(spark, str(tmp_path / "files")).first().content) == b"abc"
