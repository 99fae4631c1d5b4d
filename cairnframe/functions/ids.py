"""Content ids: types, text and byte forms, length prefixes, locators.

An id is ``type:hex``; its hash is BINARY. Length-carrying types put the length
of the content, as a little-endian base-128 number, before the hash. All
functions take and return columns and stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

# Type tags.
CHUNK_TYPES = ("sha256", "mix256", "sha512", "mix512", "qcid", "blake2s256", "mixblake2s256", "keccak256", "mixkeccak256")
MIX_TYPES = ("mix256", "mix512", "mixblake2s256", "mixkeccak256", "qcid")
FILE, DIRECTORY, PACK, CHUNK_LIST = "cyfile", "cydir", "cypack", "clist"
MESSAGE, RECEIPT, PATH, PROOF, RELATION, ACTION, PACKAGE = "cymsg", "cymsgr", "cypath", "cyinc", "cyrel", "cyact", "pkg"
CONTAINERS = ("cydir", "cytrie", "cytrie-s", "cymap-mtp", "cymap", "cylist-mtree", "cylist", "cl", "clist", "clist-fix", "cl-sf")
BIG_CONTAINERS = ("cytrie", "cymap-mtp", "cylist-mtree", "cl", "clist-fix")
BASE32 = "abcdefghijklmnopqrstuvwxyz234567"

HEX_ID = r"^[^:/{}\s]+:([0-9a-fA-F]{2})+$"


def make_id(obj_type, obj_hash: Column) -> Column:
    """``type:hex`` in lower case."""
    kind = obj_type if isinstance(obj_type, Column) else F.lit(obj_type)
    return F.concat(kind, F.lit(":"), F.lower(F.hex(obj_hash)))


def id_type(obj_id: Column) -> Column:
    return F.substring_index(obj_id, ":", 1)


def id_hash(obj_id: Column) -> Column:
    return F.unhex(F.substring_index(obj_id, ":", -1))


def to_filename(obj_id: Column) -> Column:
    """``hex.type``."""
    return F.concat(F.substring_index(obj_id, ":", -1), F.lit("."), id_type(obj_id))


def to_did(obj_id: Column) -> Column:
    return F.concat(F.lit("did:"), obj_id)


def to_bytes(obj_id: Column) -> Column:
    """``type`` + ``:`` + hash bytes."""
    return F.concat(F.concat(id_type(obj_id), F.lit(":")).cast("binary"), id_hash(obj_id))


def from_bytes(raw: Column) -> Column:
    """The id of its byte form: split at the first colon; null under three bytes or without a colon."""
    colon = lambda text: F.get(F.filter(
        F.sequence(F.lit(0), F.greatest(F.floor(F.length(text) / 2).cast("int") - 1, F.lit(0))), lambda i: F.substring(text, 2 * i + 1, F.lit(2)) == "3A"), 0)
    joined = lambda text, at: F.concat(
        F.decode(F.unhex(F.substring(text, F.lit(1), 2 * at)), "UTF-8"), F.lit(":"), F.lower(F.substring(text, 2 * at + 3, F.length(text))))
    return let(F.hex(raw), lambda text: F.when(F.length(text) >= 6, let(colon(text), lambda at: F.when(at.isNotNull(), joined(text, at)))))


def base32(raw: Column) -> Column:
    """RFC 4648 in lower case without padding, by regrouping bits."""
    bits = F.array_join(F.transform(F.split(F.hex(raw), ""), lambda c: F.lpad(F.conv(c, 16, 2), 4, "0")), "")
    digit = lambda padded, i: F.substring(F.lit(BASE32), F.conv(F.substring(padded, 5 * i + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1))
    full = lambda b: F.rpad(b, 5 * F.ceil(F.length(b) / 5).cast("int"), F.lit("0"))
    return let(let(bits, full), lambda p: F.when(F.length(p) > 0, F.array_join(
        F.transform(F.sequence(F.lit(0), F.floor(F.length(p) / 5).cast("int") - 1), lambda i: digit(p, i)), "")).otherwise(""))


def unbase32(text: Column) -> Column:
    """Bytes of a base32 text; null if a character is not of the alphabet."""
    bits = F.array_join(F.transform(F.split(text, ""), lambda c: F.lpad(F.conv(F.instr(F.lit(BASE32), c).cast("int") - 1, 10, 2), 5, "0")), "")
    byte = lambda b, i: F.lpad(F.conv(F.substring(b, 8 * i + 1, F.lit(8)), 2, 16), 2, "0")
    return F.when(text.rlike(f"^[{BASE32}]{{2,}}$"), let(bits, lambda b: F.unhex(F.array_join(
        F.transform(F.sequence(F.lit(0), F.floor(F.length(b) / 8).cast("int") - 1), lambda i: byte(b, i)), ""))))


def to_base32(obj_id: Column) -> Column:
    """The form for host names: base32 of the byte form."""
    return base32(to_bytes(obj_id))


def parse_id(text: Column) -> Column:
    """The canonical id of a text: hex form if it has a colon, else base32; null if it is neither."""
    return F.when(
        F.contains(text, F.lit(":")), F.when(text.rlike(HEX_ID), F.concat(id_type(text), F.lit(":"), F.lower(F.substring_index(text, ":", -1))))
    ).otherwise(from_bytes(unbase32(text)))


def varint(n: Column) -> Column:
    """Little-endian base-128 form of a non-negative number, as BINARY."""
    groups = F.greatest(F.ceil(F.length(F.bin(n)) / 7.0).cast("int"), F.lit(1))
    byte = lambda i: F.unhex(F.lpad(F.hex(
        F.expr("0").cast("bigint") + F.call_function("shiftright", n, i * 7).bitwiseAND(F.lit(127))
        + F.when(i < groups - 1, F.lit(128)).otherwise(F.lit(0))
    ), 2, "0"))
    return F.aggregate(F.sequence(F.lit(0), groups - 1), F.lit("").cast("binary"), lambda a, i: F.concat(a, byte(i)))


def varint_width(raw: Column) -> Column:
    """Bytes that a leading varint takes."""
    text = F.hex(raw)
    last = lambda i: F.conv(F.substring(text, 2 * i + 1, F.lit(2)), 16, 10).cast("int") < 128
    return F.get(F.filter(F.sequence(F.lit(0), F.least(F.length(raw) - 1, F.lit(9))), last), 0) + 1


def unvarint(raw: Column) -> Column:
    """The number that a leading varint holds."""
    text = F.hex(raw)
    low = lambda i: F.conv(F.substring(text, 2 * i + 1, F.lit(2)), 16, 10).cast("bigint").bitwiseAND(F.lit(127))
    return F.aggregate(F.sequence(F.lit(0), varint_width(raw) - 1), F.lit(0).cast("bigint"), lambda a, i: a + F.call_function("shiftleft", low(i), i * 7))


def mix_hash(length: Column, obj_hash: Column) -> Column:
    """Hash with its length prefix."""
    return F.concat(varint(length), obj_hash)


def is_chunk(kind: Column) -> Column:
    return kind.isin(*CHUNK_TYPES)


def is_mix(kind: Column) -> Column:
    return kind.isin(*MIX_TYPES)


def is_chunk_list(kind: Column) -> Column:
    return kind == CHUNK_LIST


def is_container(kind: Column) -> Column:
    return kind.isin(*CONTAINERS)


def is_big_container(kind: Column) -> Column:
    return kind.isin(*BIG_CONTAINERS)


def is_json(kind: Column) -> Column:
    return ~is_chunk(kind) & ~is_container(kind) & (kind != PACK)


def object_kind(kind: Column) -> Column:
    return F.when(kind == DIRECTORY, "Dir").when(kind == FILE, "File").otherwise("Unknown")


def chunk_type(method: Column, mixed: Column) -> Column:
    """Type tag of a hash method, with or without a length; quick ids always carry one."""
    names = F.create_map(*[F.lit(x) for x in ("sha256", "mix256", "sha512", "mix512", "blake2s256", "mixblake2s256", "keccak256", "mixkeccak256")])
    return F.when(method == "qcid", F.when(mixed, "qcid")).when(mixed, F.element_at(names, method)).otherwise(F.when(F.map_contains_key(names, method), method))


def hash_method(kind: Column) -> Column:
    return F.when(kind == "mix256", "sha256").when(kind == "mix512", "sha512").when(kind.startswith("mix"), F.substring(kind, 4, 20)).otherwise(kind)


def hash_size(method: Column) -> Column:
    return F.when(method.isin("sha512", "mix512"), 64).otherwise(32)


def content_length(obj_id: Column) -> Column:
    """The length that an id carries; null for types that carry none."""
    return F.when(is_mix(id_type(obj_id)), unvarint(id_hash(obj_id)))


def plain_hash(obj_id: Column) -> Column:
    """The hash without its length prefix."""
    raw = id_hash(obj_id)
    width = F.when(is_mix(id_type(obj_id)), varint_width(raw)).otherwise(F.lit(0))
    return F.substring(raw, width + 1, F.length(raw))


def url_parts(url: Column) -> Column:
    """Struct of host and path of an absolute URL; path without query or fragment."""
    return F.struct(
        F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1).alias("host"),
        F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?", 1).alias("path"),
    )


def from_path(path: Column) -> Column:
    """Struct (obj_id, inner_path, segment): the first path segment that is an id, and what follows it."""
    found = lambda segments: F.get(F.filter(
        F.transform(segments, lambda s, i: F.struct(parse_id(s).alias("id"), i.alias("i"))), lambda x: x["id"].isNotNull()), 0)
    rest = lambda segments, at: F.slice(segments, at["i"] + 2, F.size(segments))
    return let(F.filter(F.split(path, "/"), lambda s: s != ""), lambda segments: let(found(segments), lambda at: F.struct(
        at["id"].alias("obj_id"),
        F.when(at["i"] + 1 < F.size(segments), F.concat(F.lit("/"), F.array_join(rest(segments, at), "/"))).alias("inner_path"),
        at["i"].alias("segment"),
    )))


def from_url(url: Column) -> Column:
    """Struct (obj_id, inner_path, locator): the host's first label if it is an id, else the path.

    In host mode the inner path is the whole path.
    """
    by_host = lambda parts, host: F.struct(
        host.alias("obj_id"), F.when(parts["path"] == "", "/").otherwise(parts["path"]).alias("inner_path"), F.lit("host").alias("locator"))
    by_path = lambda at: F.struct(
        at["obj_id"].alias("obj_id"), at["inner_path"].alias("inner_path"),
        F.when(at["obj_id"].isNotNull(), F.concat(F.lit("path:"), at["segment"].cast("string"))).alias("locator"))
    return let(url_parts(url), lambda parts: let(parse_id(F.substring_index(parts["host"], ".", 1)), lambda host: F.when(
        host.isNotNull(), by_host(parts, host)).otherwise(let(from_path(parts["path"]), by_path))))


def object_url(base: Column, obj_id: Column, host_style: bool = False) -> Column:
    """Address of an object under a base URL: hex in the path, or base32 as the first host label."""
    if not host_style:
        return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), obj_id)
    parts = url_parts(base)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    return F.concat(scheme, F.lit("://"), to_base32(obj_id), F.lit("."), parts["host"], parts["path"])


def replace_id(url: Column, obj_id: Column) -> Column:
    """The URL with the id at its locator replaced."""
    scheme, host = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://)", 1), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    rest, tail = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(.*)$", 1), F.regexp_extract(url, r"([?#].*)?$", 1)
    segments = F.filter(F.split(url_parts(url)["path"], "/"), lambda s: s != "")
    swapped = lambda at: F.array_join(F.transform(segments, lambda s, i: F.when(i == F.substring(at["locator"], 6, 9).cast("int"), obj_id).otherwise(s)), "/")
    return let(from_url(url), lambda at: F.when(
        at["locator"] == "host", F.concat(scheme, to_base32(obj_id), F.regexp_replace(host, "^[^.:]*", ""), rest)
    ).when(at["obj_id"].isNotNull(), F.concat(scheme, host, F.lit("/"), swapped(at), tail)))
