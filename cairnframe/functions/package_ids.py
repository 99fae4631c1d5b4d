"""Package ids: ``name``, ``name#version``, ``name#objid`` and ``name#version#objid``; names as DIDs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ids
from .binding import let

#: A version that is written out in full, and so asks for exactly itself.
_FULL = r"^[0-9]+\.[0-9]+\.[0-9]+([-+][0-9A-Za-z.+-]*)?$"
#: Method of the DIDs of package names.
DID = "did:bns:"


def version_request(text: Column) -> Column:
    """Struct (expr, tag, kind) of ``expr[:tag]``; kind is exact, req or any. Null for more than one colon."""
    expr = F.trim(F.split(text, ":")[0])
    kind = F.when(expr.rlike(_FULL), "exact").when(expr.isin("", "*"), "any").otherwise("req")
    whole = F.struct(expr.alias("expr"), F.get(F.split(text, ":"), 1).alias("tag"), kind.alias("kind"))
    return F.when(F.size(F.split(text, ":")) <= 2, whole)


def parse(pkg_id: Column) -> Column:
    """Struct (name, version, objid); null for more than three parts.

    A second part that is an object id, or letters and digits only, is an exact id.
    """
    exact = lambda part: part.rlike("^[A-Za-z0-9]+$") | ids.parse_id(part).isNotNull()

    def of(parts: Column) -> Column:
        name, second, third = parts[0], F.get(parts, 1), F.get(parts, 2)
        two = F.size(parts) == 2
        return F.when(F.size(parts) <= 3, F.struct(
            name.alias("name"), F.when(~(two & exact(second)), second).alias("version"), F.when(two & exact(second), second).otherwise(third).alias("objid"),
        ))

    return let(F.split(pkg_id, "#", -1), of)


def unique_name(name: Column) -> Column:
    """What follows the first dot; the whole name if it has none."""
    return F.regexp_replace(name, r"^[^.]*\.", "")


def author_of(unique: Column) -> Column:
    """What comes before the first hyphen; null if there is none."""
    return F.when(F.contains(unique, F.lit("-")), F.substring_index(unique, "-", 1))


def to_did(name: Column) -> Column:
    """``author_module`` as a DID of module and author, any other unique name as it is."""
    parts = F.split(unique_name(name), "_", -1)
    return F.concat(F.lit(DID), F.when(F.size(parts) == 2, F.concat(F.get(parts, 1), F.lit("."), parts[0])).otherwise(unique_name(name)))


def from_did(did: Column) -> Column:
    """The package name of a DID; null for another method."""
    rest = F.substring(did, len(DID) + 1, 1 << 20)
    parts = F.split(rest, r"\.", -1)
    return F.when(did.startswith(DID), F.when(F.size(parts) == 2, F.concat(F.get(parts, 1), F.lit("_"), parts[0])).otherwise(rest))


def with_prefix(name: Column, prefix: str) -> Column:
    """A name under a platform's prefix, unless it already has one."""
    return F.when(F.contains(name, F.lit(".")), name).otherwise(F.concat(F.lit(prefix + "."), name))


def with_object(pkg_id: Column, obj_id: Column) -> Column:
    """The package id with an object id and no version; null where it already names another object."""
    def of(p: Column) -> Column:
        known = F.coalesce(ids.parse_id(p["objid"]), p["objid"])
        return F.when(obj_id.isNull(), F.concat_ws("#", p["name"], p["objid"])).when(known.isNull() | (known == obj_id), F.concat(p["name"], F.lit("#"), obj_id))

    return F.when(parse(pkg_id).isNull(), F.coalesce(F.concat(pkg_id, F.lit("#"), obj_id), pkg_id)).otherwise(let(parse(pkg_id), of))


def package_id(name: Column, version: Column, tag: Column) -> Column:
    """``name#version[:tag]``."""
    return F.concat(name, F.lit("#"), version, F.coalesce(F.concat(F.lit(":"), tag), F.lit("")))


def spellings(obj_id: Column) -> Column:
    """The spellings under which an index may hold an id: as given, hexadecimal, base32; each once."""
    known = ids.parse_id(obj_id)
    return F.array_distinct(F.array_compact(F.array(obj_id, known, F.when(known.isNotNull(), ids.to_base32(known)))))
