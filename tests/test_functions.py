import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from cairnframe.functions import hashing, ids, package_ids, paths, versions


def one(spark, *cols):
    return list(spark.range(1).select(*cols).first())


def base32_of(obj_id):
    kind, digest = obj_id.split(":")
    return base64.b32encode(kind.encode() + b":" + bytes.fromhex(digest)).decode().lower().rstrip("=")


@pytest.mark.parametrize("obj_id", ["mix256:c0ffee17", "cyfile:00", "sha512:" + "9e" * 64, "qcid:8001" + "7f" * 32])
def test_id_codec(spark, obj_id):
    kind, digest = obj_id.split(":")
    x, b32 = F.lit(obj_id), base32_of(obj_id)
    assert one(spark, ids.to_base32(x), ids.parse_id(F.lit(b32)), ids.to_filename(x), ids.to_did(x), ids.from_bytes(ids.to_bytes(x))) == [
        b32, obj_id, f"{digest}.{kind}", f"did:{obj_id}", obj_id]


def test_ids_that_are_none(spark):
    assert one(spark, *[ids.parse_id(F.lit(x)) for x in ("x:y:z", "UPPER", "cyfile:123", ":00", "")]) == [None] * 5


def test_locators(spark):
    known = "cydir:" + "4b" * 8
    in_path, in_host, bare = one(
        spark, ids.from_url(F.lit(f"https://files.example:8443/{known}?page=2#top")),
        ids.from_url(F.lit(f"https://{base32_of(known)}.eu.files.example/reports/2031")), ids.from_url(F.lit("https://files.example/reports/2031/summary.csv")))
    assert tuple(in_path) == (known, None, "path:0") and tuple(in_host) == (known, "/reports/2031", "host") and bare.obj_id is None
    other = "cydir:" + "5c" * 8
    assert one(spark, ids.replace_id(F.lit(f"ftp://u@h.example/p/q/{known}/r#z"), F.lit(other)), ids.object_url(F.lit("https://h.example/base"), F.lit(other)),
               ids.object_url(F.lit("https://h.example/base"), F.lit(other), True)) == [
        f"ftp://u@h.example/p/q/{other}/r#z", f"https://h.example/base/{other}", f"https://{base32_of(other)}.h.example/base"]


def varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


@pytest.mark.parametrize("n", [0, 1, 127, 128, 300, 16383, 16384, 2**31, 2**40 + 12345])
def test_length_prefix(spark, n):
    v = ids.varint(F.lit(n).cast("bigint"))
    assert one(spark, F.lower(F.hex(v)), ids.unvarint(F.concat(v, F.unhex(F.lit("01c3"))))) == [varint(n).hex(), n]


def test_hashes(spark):
    x = b"abc" * 6000
    rows = spark.createDataFrame([(bytearray(x),)], "b binary").select(
        hashing.chunk_id(F.col("b"), "sha512"), hashing.chunk_id(F.col("b"), "blake2s256"), hashing.chunk_id(F.lit("abc").cast("binary"), "keccak256"),
        hashing.quick_id(F.col("b")), hashing.quick_id3(F.col("b")), hashing.quick_id(F.lit("short").cast("binary")), ids.content_length(hashing.mix_chunk_id(F.col("b"))),
    ).first()
    assert rows[0] == "sha512:" + hashlib.sha512(x).hexdigest()
    assert rows[1] == "blake2s256:" + hashlib.blake2s(x).hexdigest()
    assert rows[2] == "keccak256:4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45"
    assert rows[3].endswith(hashlib.sha256(x[:4096] + x[9000:9000 + 4096]).hexdigest()) and rows[3] != rows[4]
    assert rows[5] is None and rows[6] == len(x)
    with pytest.raises(ValueError):
        hashing.stateful_method("keccak256")


def packed(major, minor=0, patch=0, build=0):
    return major << 56 | minor << 40 | patch << 24 | build


PACKED = [("7", packed(7)), ("3.9", packed(3, 9)), ("11.0.65535", packed(11, 0, 65535)), ("5.6.7.8", packed(5, 6, 7, 8)), ("2.4.8-310131", packed(2, 4, 8, 310131)),
          ("6.0.1-rc_77", packed(6, 0, 1, 77)), (">=2.4.8-nightly310131", packed(2, 4, 8, 310131)), ("127.1", packed(127, 1))]
COMPARED = [("4.2.1", "4.2.1", 0), ("4.2.1", "4.10.0", -1), ("4.2.1-rc.2", "4.2.1", -1), ("4.2.1-rc.2", "4.2.1-rc.11", -1), ("4.2.1-rc.2", "4.2.1-7", 1), ("4.2.1-a+x", "4.2.1-b", -1),
            ("4.2.1", "4.2.1+nightly", -1), ("4", "4.0.0", 0), ("4.2", "4.2.0.0", 0), ("4.2.0.1", "4.2", 1), ("10", "9.99.99", 1)]


def test_versions(spark):
    assert [r.p for r in spark.createDataFrame(PACKED, "v string, e long").select(versions.pack(F.col("v")).alias("p")).collect()] == [e for _, e in PACKED]
    assert [r.c for r in spark.createDataFrame(COMPARED, "a string, b string, e int").select(versions.compare(F.col("a"), F.col("b")).alias("c")).collect()] == [e for *_, e in COMPARED]
    bounds, one_sided, caret, zero, tilde, both, over = one(
        spark, versions.range_bounds(F.lit("<8.1, >=2.4.8")), versions.range_bounds(F.lit("<8.1")), versions.satisfies(F.lit("5.80.2"), F.lit("5.7")),
        versions.satisfies(F.lit("0.4.0"), F.lit("^0.3.9")), versions.satisfies(F.lit("5.8.0"), F.lit("~5.7.1")),
        versions.satisfies(F.lit("6.0.0"), F.lit(">5.9, <=6")), versions.pack(F.lit("256.0")))
    assert tuple(bounds) == (packed(2, 4, 8), packed(8, 1)) and tuple(one_sided) == (0, packed(8, 1))
    assert (caret, zero, tilde, both, over) == (True, False, False, True, None)


def test_package_ids(spark):
    ref = "cypkg:" + "0d" * 4
    texts = ["tool", "tool#>=2.0:beta", f"tool#{ref}", "tool#abc123", f"tool#1.2.3#{ref}", "a#b#c#d", "#x.y"]
    got = [r.p and tuple(r.p) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(package_ids.parse(F.col("t")).alias("p")).collect()]
    assert got == [("tool", None, None), ("tool", ">=2.0:beta", None), ("tool", None, ref), ("tool", None, "abc123"), ("tool", "1.2.3", ref), None, ("", "x.y", None)]
    asked = one(spark, *[package_ids.version_request(F.lit(x)) for x in (">=2.0:beta", "1.2.3", "*", "1:2:3")])
    assert [x and tuple(x) for x in asked] == [(">=2.0", "beta", "req"), ("1.2.3", None, "exact"), ("*", None, "any"), None]
    lit = F.lit
    assert one(spark, package_ids.to_did(lit("mac.ann_tool")), package_ids.to_did(lit("tool")), package_ids.from_did(lit("did:bns:tool.ann")), package_ids.from_did(lit("did:web:x")),
               package_ids.author_of(lit("ann-tool-x")), package_ids.author_of(lit("tool")), package_ids.with_prefix(lit("tool"), "mac"), package_ids.with_prefix(lit("win.tool"), "mac")) == [
        "did:bns:tool.ann", "did:bns:tool", "ann_tool", None, "ann", None, "mac.tool", "win.tool"]
    assert one(spark, package_ids.with_object(lit("tool#1.2.3"), lit(ref)), package_ids.with_object(lit(f"tool#{ref}"), lit(ref)), package_ids.with_object(lit(f"tool#{ref}"), lit("cypkg:ff")),
               package_ids.with_object(lit("a#b#c#d"), lit(ref)), package_ids.spellings(lit(ref)), package_ids.spellings(lit("plain"))) == [
        f"tool#{ref}", f"tool#{ref}", None, f"a#b#c#d#{ref}", [ref, base32_of(ref)], ["plain"]]


def test_paths(spark):
    lit = F.lit
    assert one(spark, paths.normalize_symlink(lit("/a/x"), lit("../y")), paths.normalize_symlink(lit("/a"), lit("../../../z")), paths.is_descendant(lit("/ab"), lit("/a")),
               paths.is_descendant(lit("/a/b"), lit("/a/")), paths.is_descendant_guarded(lit("/a"), lit("/")), paths.normalize_inner(lit(" x/y ")), paths.is_root(lit("//"))) == [
        "/a/y", "/z", False, True, False, "/x/y", True]
    parent, root, first = one(spark, paths.parent_name(lit("/a/b/c")), paths.parent_name(lit("/")), paths.first_segment(lit("/a/b/c")))
    assert (tuple(parent), root, tuple(first)) == (("/a/b", "c"), None, ("a", "/b/c"))
