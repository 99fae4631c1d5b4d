"""Version algebra: packing, order keys, requirements.

Packing keeps 8, 16, 16 and 24 bits of major, minor, patch and build. Order
keys are arrays that compare as versions do, so a sort, max or join needs no
Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

LIMITS = (255, 65535, 65535, 16777215)


def _number(text: Column, lenient: bool) -> Column:
    """Leading number of a part; a part that is no number counts as 0."""
    t = F.regexp_replace(text, "^[^0-9]+", "") if lenient else text
    return F.when(t.rlike("^[0-9]{1,18}$"), t.cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def pack(version: Column) -> Column:
    """The packed number of a version; null if a part is out of range or there are more than four.

    A major of 128 or more wraps to a negative number, as the index stores it.
    """
    core = F.regexp_extract(version, r"^([^+-]*)", 1)
    tail = F.regexp_extract(version, r"^[^+-]*(.*)$", 1)

    def numbers(parts: Column) -> Column:
        at = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
        build = F.when((F.size(parts) == 3) & (tail != ""), tail).otherwise(at(3))
        return F.array(_number(at(0), True), _number(at(1), False), _number(at(2), False), _number(build, True), F.size(parts).cast("bigint"))

    def packed(x: Column) -> Column:
        n = [F.get(x, i) for i in range(5)]
        ok = n[4] <= 4
        for value, most in zip(n, LIMITS, strict=False):
            ok = ok & (value <= most)
        high = F.when(n[0] >= 128, n[0] - 256).otherwise(n[0])
        return F.when(ok, F.shiftleft(high, 56) + F.shiftleft(n[1], 40) + F.shiftleft(n[2], 24) + n[3])

    return let(let(F.split(core, r"\."), numbers), packed)


def _identifiers(text: Column) -> Column:
    """Dot-separated identifiers as comparable structs: numbers first, by value; then text."""
    return F.transform(
        F.filter(F.split(F.coalesce(text, F.lit("")), r"\."), lambda x: x != ""),
        lambda x: F.struct(
            F.when(x.rlike("^[0-9]+$"), 0).otherwise(1).alias("kind"),
            F.when(x.rlike("^[0-9]{1,18}$"), x.cast("bigint")).otherwise(F.lit(0).cast("bigint")).alias("number"),
            F.when(x.rlike("^[0-9]+$"), F.lit("")).otherwise(x).alias("word"),
        ),
    )


def order_key(version: Column) -> Column:
    """A struct that sorts as versions compare.

    A pre-release sorts before its release; build metadata after the same
    version without it. Parts that are absent count as 0, and a fourth part
    counts after the third.
    """
    def key(head: Column) -> Column:
        before = F.regexp_extract(head, r"^[0-9.]*-([^+]*)", 1)
        numbers = F.transform(F.slice(F.concat(F.split(F.regexp_extract(head, r"^([0-9.]*)", 1), r"\."), F.array_repeat(F.lit("0"), 4)), 1, 4), lambda x: _number(x, False))
        return F.struct(
            numbers.alias("numbers"), (before == "").alias("release"), _identifiers(before).alias("before"),
            _identifiers(F.regexp_extract(head, r"\+(.*)$", 1)).alias("build"),
        )

    return let(F.regexp_replace(version, r"^[^0-9]+", ""), key)


def compare(left: Column, right: Column) -> Column:
    """-1, 0 or 1."""
    return let(F.struct(order_key(left).alias("a"), order_key(right).alias("b")), lambda x: F.when(x["a"] < x["b"], -1).when(x["a"] > x["b"], 1).otherwise(0))


def comparators(requirement: Column) -> Column:
    """Array of (op, version) of a comma-separated requirement; a bare version means compatible (^)."""
    parts = F.filter(F.transform(F.split(requirement, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(
        F.when(x.rlike("^[0-9]"), "^").otherwise(F.regexp_extract(x, r"^(>=|<=|>|<|=|\^|~|\*)", 1)).alias("op"),
        F.trim(F.regexp_replace(x, r"^(>=|<=|>|<|=|\^|~|\*)", "")).alias("version"),
    ))


def range_bounds(requirement: Column) -> Column:
    """Struct (low, high) of packed bounds, both inclusive; null where a requirement has no range.

    One comparator of > >= < <= bounds one side. Two are always taken as the
    two ends, whatever their operators. Others have none and need a full scan.
    """
    top, bottom = F.lit(2**63 - 1), F.lit(0).cast("bigint")
    ends = F.transform(comparators(requirement), lambda c: F.struct(c["op"].alias("op"), pack(c["version"]).alias("v")))

    def bounds(x: Column) -> Column:
        a, b = F.get(x, 0), F.get(x, 1)
        one = F.when(a["op"].isin(">", ">="), F.struct(a["v"].alias("low"), top.alias("high"))).when(
            a["op"].isin("<", "<="), F.struct(bottom.alias("low"), a["v"].alias("high")))
        two = F.struct(F.least(a["v"], b["v"]).alias("low"), F.greatest(a["v"], b["v"]).alias("high"))
        return F.when(F.size(x) == 1, one).when(F.size(x) == 2, two)

    return let(ends, bounds)


def satisfies(version: Column, requirement: Column) -> Column:
    """Whether a version meets every comparator, by the public rules of semantic versions."""
    def meets(key: Column, c: Column, k: Column) -> Column:
        n = F.size(F.split(c["version"], r"\."))
        part = lambda x, i: F.get(x["numbers"], i)
        same = lambda i, least: F.when(n >= least, part(key, i) == part(k, i)).otherwise(F.lit(True))
        upper = F.when(part(k, 0) > 0, part(key, 0) == part(k, 0)).when(
            part(k, 1) > 0, (part(key, 0) == 0) & (part(key, 1) == part(k, 1))
        ).otherwise((part(key, 0) == 0) & same(1, 2) & same(2, 3))
        return (
            F.when(c["op"] == "*", F.lit(True)).when(c["op"] == ">", key > k).when(c["op"] == ">=", key >= k)
            .when(c["op"] == "<", key < k).when(c["op"] == "<=", key <= k).when(c["op"] == "=", key == k)
            .when(c["op"] == "~", (key >= k) & (part(key, 0) == part(k, 0)) & same(1, 2)).when(c["op"] == "^", (key >= k) & upper).otherwise(F.lit(False))
        )

    return let(order_key(version), lambda key: F.forall(comparators(requirement), lambda c: let(order_key(c["version"]), lambda k: meets(key, c, k))))
