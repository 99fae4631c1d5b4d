import hashlib

import pytest
from pyspark.sql import functions as F

from cairnframe.functions import versions
from cairnframe.operators import chunks, cow, ledger, objects, overlay, packages, placement, traversal


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_chunks_and_lists(spark):
    files = spark.createDataFrame([(1, bytearray(b"1234567890")), (2, bytearray(b""))], "id int, content binary")
    got = chunks.chunk_ids(files, "id", size=4)
    assert rows(got, "id", "idx", "start", "chunk_size") == [(1, 0, 0, 4), (1, 1, 4, 4), (1, 2, 8, 2), (2, 0, 0, 0)]
    lists = {r.id: r for r in chunks.chunk_lists(got, "id").collect()}
    assert lists[1].total_size == 10 and lists[1].list_id.startswith("clist:0a") and lists[1].list_id.endswith(hashlib.sha256(lists[1].list_json.encode()).hexdigest())
    asked = spark.createDataFrame([(1, 0), (1, 4), (1, 9), (1, 10)], "id int, position long")
    assert rows(chunks.locate(asked, got.drop("start"), "id", bucket=4)) == [(1, 0, 0, 0), (1, 4, 1, 0), (1, 9, 2, 1), (1, 10, 3, 0)]
    piece = chunks.read_ranges(files, spark.createDataFrame([(1, 5, 5)], "id int, start long, length long"), "id").first().piece
    assert bytes(piece) == b"67890"


def test_verification_and_missing(spark):
    ok = "sha256:" + hashlib.sha256(b"x").hexdigest()
    claims = spark.createDataFrame([(bytearray(b"x"), ok), (bytearray(b"y"), ok)], "content binary, chunk_id string")
    assert [r.ok for r in chunks.verify(claims).collect()] == [True, False]
    need = spark.createDataFrame([("a",), ("b",)], "chunk_id string")
    assert rows(chunks.missing(need, need.where("chunk_id = 'a'"))) == [("b",)]


def test_merkle_root(spark):
    h = [hashlib.sha256(bytes([i])).digest() for i in range(3)]
    leaves = spark.createDataFrame([("k", i, bytearray(x)) for i, x in enumerate(h)], "k string, idx int, hash binary")
    top = lambda *x: hashlib.sha256(b"".join(x)).digest()
    assert bytes(chunks.merkle_root(leaves, "k").first().root) == top(top(h[0], h[1]), top(h[2]))


def test_canonical_json_and_objects(spark):
    d = spark.createDataFrame([('{"b":1.0,"a":{"z":[2,1],"é":"/"}}',), ("no",), (None,)], "t string")
    assert [r.c for r in d.select(objects.canonical("t").alias("c")).collect()] == ['{"a":{"z":[2,1],"é":"/"},"b":1.0}', None, None]
    text = d.limit(1).select(objects.file_object(F.lit('q"\\'), F.lit(0), F.lit(""), F.lit(7)).alias("t")).first().t
    assert text == '{"create_time":7,"last_update_time":7,"name":"q\\"\\\\"}'
    dir_ = '{"body":{"f":"cyfile:aa"}}'
    objs = spark.createDataFrame([("cydir:" + hashlib.sha256(dir_.encode()).hexdigest(), dir_), ("clist:00", '["mix256:04aa"]')], "obj_id string, obj_json string")
    assert [r.ok for r in objects.verify(objs).collect()] == [True, False]
    assert rows(objects.children(objs), "child_id", "name") == [("cyfile:aa", "f"), ("mix256:04aa", "0")]


def test_overlay(spark):
    base = spark.createDataFrame([("p", "keep", "k0"), ("p", "gone", "g0"), ("p", "swap", "s0")], "parent string, name string, target string")
    upper = spark.createDataFrame([("p", "gone", "tombstone", None), ("p", "swap", "object", "s1"), ("p", "fresh", "inode", "17")], "parent string, name string, kind string, target string")
    assert rows(overlay.merge(base, upper), "name", "target", "origin") == [("fresh", "17", "upper"), ("keep", "k0", "base"), ("swap", "s1", "upper")]
    names = spark.createDataFrame([("Z",), ("m",), ("é",)], "name string")
    assert [[r.name for r in overlay.page(names, a, 2).collect()] for a in (None, "m", "é")] == [["Z", "m"], ["é"], []]
    assert overlay.page(names, None, 0).count() == 3
    free = overlay.free_names(spark.createDataFrame([("p", "gone"), ("p", "keep"), ("p", "other")], "parent string, name string"), base, upper)
    assert rows(free) == [("p", "gone"), ("p", "other")]
    moved = overlay.rename_subtree(spark.createDataFrame([("/in/1",), ("/out/1",), ("/out",), ("/inner",)], "path string"), "/in", "/out")
    assert rows(moved) == [("/inner",), ("/out/1",)]


def test_ledger(spark):
    d = spark.createDataFrame([("o", 1, 10, 1), ("o", 2, 20, 1), ("o", 3, 30, -2), ("o", 4, 40, 0), ("p", 5, 50, 1)], "obj_id string, seq long, ts long, delta long")
    got = {r.obj_id: (r.ref_count, r.zero_since) for r in ledger.ref_ledger(d).collect()}
    assert got == {"o": (0, 30), "p": (1, None)}
    assert rows(ledger.gc_candidates(ledger.ref_ledger(d), 30, 10), "obj_id") == [("o",)]
    nodes = spark.createDataFrame([(1, "Working", "s", 5, None), (2, "Working", "s", 6, None)], "i int, state string, lease_session string, lease_expire_at long, closed_at long")
    assert rows(ledger.reclaim_leases(nodes, 5), "i", "state", "reclaimed") == [(1, "Cooling", True), (2, "Working", False)]


INDEX = [("viewer", "3.1.4", "m-a", "lts"), ("viewer", "3.2.0-rc.1", "m-b", "next"), ("viewer", "3.2.0", "m-c", None), ("viewer", "10.0.0", "m-d", "next"),
         ("viewer", "0.9.9", "m-e", "lts"), ("solver", "2.0.0+hot.2", "m-f", None), ("solver", "2.0.0", "m-g", "lts")]


def index_of(spark, rows_):
    return spark.createDataFrame(rows_, "pkg_name string, version string, metaobjid string, tag string").withColumn("version_int", versions.pack(F.col("version")))


def test_package_index(spark):
    index = index_of(spark, INDEX)
    assert rows(packages.latest(index), "pkg_name", "metaobjid") == [("solver", "m-f"), ("viewer", "m-d")]
    one = index.where("pkg_name = 'viewer'")
    best = lambda req, tag=None: packages.latest(packages.matching(one, req, tag)).first().metaobjid
    assert (best("<10"), best(">=3.2.0, <=3.9"), best("*", "lts")) == ("m-c", "m-c", "m-a")


def test_package_lookup(spark):
    index = index_of(spark, INDEX)
    wanted = ["viewer", "viewer#^3.1:lts", "viewer#3.2.0", "viewer#*:next", "viewer#>=11.0", "solver#m-g", "solver#none", "nobody", "a#b#c#d"]
    asked = spark.createDataFrame([(w,) for w in wanted], "pkg_id string")
    # "m-g" is no plain id, so it is a requirement that nothing meets; an id is letters and digits, or typed.
    assert rows(packages.lookup(index, asked), "pkg_id", "metaobjid") == [("viewer", "m-d"), ("viewer#*:next", "m-d"), ("viewer#3.2.0", "m-c"), ("viewer#^3.1:lts", "m-a")]
    by_id = index_of(spark, [("viewer", "1.0.0", "cypkg:0a0b", None), ("solver", "1.0.0", "raw1", None)])
    ids_ = spark.createDataFrame([("viewer#cypkg:0a0b",), ("other#cypkg:0a0b",), ("solver#raw1",), ("solver#1.0.0#raw1",), ("solver#2.0.0#raw1",)], "pkg_id string")
    assert rows(packages.lookup(by_id, ids_), "pkg_id") == [("solver#1.0.0#raw1",), ("solver#raw1",), ("viewer#cypkg:0a0b",)]
    chain = packages.lookup_chain([index.where("pkg_name = 'solver'"), index], asked.where("pkg_id IN ('viewer', 'nobody')").unionByName(spark.createDataFrame([("solver",)], "pkg_id string")))
    assert rows(chain, "pkg_id", "metaobjid", "env") == [("solver", "m-f", 0), ("viewer", "m-d", 1)]
    assert rows(packages.is_latest_everywhere([index.where("metaobjid IN ('m-c', 'm-f')"), index]), "metaobjid", "is_latest") == [("m-c", False), ("m-f", True)]
    timed = index.withColumn("update_time", F.ascii(F.substring("metaobjid", 3, 1)))
    assert rows(packages.by_update_time(timed).where("place = 1"), "metaobjid") == [("m-e",), ("m-g",)]


def test_package_lookup_joins_versions_by_their_order(spark):
    index = spark.createDataFrame([("a", "1.2.0", "m1", None), ("a", "1.2", "m2", "lts"), ("a", "1.10.0", "m3", "lts"), ("b", "1.2.0", "m4", None)], "pkg_name string, version string, metaobjid string, tag string")
    asked = spark.createDataFrame([("a#1.2.0",), ("a#1.2.0:lts",), ("a#*:lts",), ("a#<1.3",), ("a",), ("b#1.10.0",)], "pkg_id string")
    got = packages.lookup(index, asked)
    assert rows(got, "pkg_id", "metaobjid") == [("a", "m3"), ("a#*:lts", "m3"), ("a#1.2.0", "m2"), ("a#1.2.0:lts", "m2"), ("a#<1.3", "m2")]
    assert "asked_at" in got._jdf.queryExecution().optimizedPlan().toString()


def test_closure_broadcasts_nothing(spark):
    got = packages.closure(spark.createDataFrame([(i, i // 2) for i in range(2, 50)], "src long, dst long"), spark.createDataFrame([(i,) for i in range(1, 50)], "node long"))
    assert got.count() == sum(i.bit_length() for i in range(1, 50)) and "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_closure(spark):
    edges = [("p", "q"), ("q", "r"), ("r", "p"), ("s", "t"), ("s", "u"), ("t", "v"), ("u", "v")]
    long = [(f"n{i:03}", f"n{i + 1:03}") for i in range(90)]
    got = packages.closure(spark.createDataFrame(edges + long, "src string, dst string"), spark.createDataFrame([("p",), ("s",), ("n000",)], "node string")).collect()
    found = lambda start: sorted((r.node, r.depth) for r in got if r.start == start)
    assert found("p") == [("p", 0), ("q", 1), ("r", 2)] and found("s") == [("s", 0), ("t", 1), ("u", 1), ("v", 2)]
    assert found("n000") == [(f"n{i:03}", i) for i in range(91)] and {r.start for r in got if r.cycle} == {"p"}


def test_placement(spark):
    t = [placement.Target("a"), placement.Target("b", 10), placement.Target("c", enabled=False), placement.Target("d", readonly=True)]
    table = placement.lookup_table(t)
    assert len(table) == 65537 and set(table) == {0, 1} and table.count(1) > 3 * table.count(0)
    assert placement.lookup_table([t[2]]) == [] and (placement.table_size(6000), placement.table_size(60000)) == (655373, 6553577)
    even = lambda n: [placement.Target(f"s{i}") for i in range(n)]
    o = spark.range(3000).select(F.concat(F.lit("sha256:"), F.sha2(F.col("id").cast("string"), 256)).alias("obj_id"))
    moved = {r.moved: r.objects for r in placement.movement(o, placement.slots(spark, even(2)), placement.slots(spark, even(3)), 65537, 65537).collect()}
    assert 0.55 < moved[False] / 3000 < 0.8
    got = placement.replicas(o.limit(50), placement.slots(spark, even(3)), 65537, 2).groupBy("obj_id").agg(F.countDistinct("store_id").alias("n")).collect()
    assert len(got) == 50 and all(r.n == 2 for r in got)


def test_traversal(spark):
    e = spark.createDataFrame([("/", "top", "dir", "/top", None), ("/top", "left", "dir", "/top/left", None), ("/top/left", "jump", "link", None, "../right"), ("/top", "right", "dir", "/top/right", None),
                               ("/top/right", "leaf", "object", "o41", None)], "parent string, name string, kind string, node string, target string")
    asked = spark.createDataFrame([("/top/left/jump/leaf",), ("/top/none",), ("/top/right/leaf/deep/er",)], "path string")
    assert rows(traversal.resolve(asked, e, links=1), "path", "status", "node", "rest") == [
        ("/top/left/jump/leaf", "object", "o41", None), ("/top/none", "missing", None, None), ("/top/right/leaf/deep/er", "object", "o41", "/deep/er")]
    link = traversal.resolve(asked.limit(1), e, links=0).first()
    assert (link.status, link.rest) == ("link", "/leaf")
    chain = spark.createDataFrame([("m1", None), ("m2", "m1"), ("m3", "m2"), ("m4", "m3"), ("m9", "lost")], "msg_id string, reply_to string")
    assert rows(traversal.thread_depth(chain)) == [("m1", "m1", 0), ("m2", "m1", 1), ("m3", "m1", 2), ("m4", "m1", 3), ("m9", "m9", 0)]
    files = spark.createDataFrame([("/a.txt", 5), ("/d/b.txt", 7), ("/d/e/c.txt", 11)], "path string, size long")
    assert rows(traversal.rollup(files)) == [("/", 1, 5, 23), ("/d", 1, 7, 18), ("/d/e", 1, 11, 11)]


def test_deep_paths(spark):
    deep = "".join(f"/s{i}" for i in range(70))
    at = ["/"] + [deep[: deep.index(f"/s{i}") + len(f"/s{i}")] for i in range(70)]
    e = spark.createDataFrame([(at[i], f"s{i}", "dir", at[i + 1], None) for i in range(70)], "parent string, name string, kind string, node string, target string")
    got = traversal.resolve(spark.createDataFrame([(deep,), ("/s0",)], "path string"), e)
    assert rows(got, "path", "status", "node") == [("/s0", "dir", "/s0"), (deep, "dir", deep)]


def test_copy_on_write(spark):
    base = spark.createDataFrame([("l", 0, "aaaa", 4), ("l", 1, "bbbb", 4), ("l", 2, "cc", 2)], "list_id string, idx int, chunk_id string, chunk_size long")
    diff = spark.createDataFrame([("l", 1, "BBBB", 4), ("l", 3, "d", 1)], base.schema)
    assert rows(cow.merge(base, diff), "idx", "chunk_id", "start", "origin") == [(0, "aaaa", 0, "base"), (1, "BBBB", 4, "diff"), (2, "cc", 8, "base"), (3, "d", 10, "diff")]
    with pytest.raises(Exception, match="gap before chunk"):
        cow.merge(base, spark.createDataFrame([("l", 5, "x", 1)], base.schema)).collect()
    data = spark.createDataFrame([("l", 0, bytearray(b"ABCD")), ("l", 1, bytearray(b"E"))], "list_id string, idx int, payload binary")
    writes = spark.createDataFrame([("l", 1, 1, bytearray(b"Z")), ("l", 2, 5, bytearray(b"FGH"))], "list_id string, seq long, position long, data binary")
    got = cow.apply_writes(data, writes, 4).orderBy("idx").collect()
    assert b"".join(bytes(r.payload) for r in got) == b"AZCDEFGH" and [r.dirty for r in got] == [True, True]
