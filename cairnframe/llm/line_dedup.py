"""Line deduplication by an exact set-similarity join, with DataFrame functions only.

A line is its set of words. It is removed when an earlier line, in the order of
(doc_id, line number), has a Jaccard similarity of at least ``percent``; the
earlier line counts even if it is removed itself, so the result depends on no
order of processing.

1. Word counts, in ``BUCKETS`` numbers whatever the corpus holds, give each word
   a rarity level. A line's prefix is its n - ceil(t n) + 2 rarest words.
2. Lines with equal sets collapse to their first place by partial aggregation:
   a line that a third of all documents share goes on as one row.
3. In a first round every line meets a few earlier lines, the first and the
   nearest, that share one of ``PICKS`` words of its prefix, chosen by least hash
   so that similar lines choose alike; it is verified against the ``TRIED`` whose
   parities are nearest. This settles groups of near copies with few pairs a line.
4. Two similar lines share a word among the first n - ceil(t n) + 1 of each. Only
   the lines left open meet earlier lines by such a word, where lengths,
   positions and parities of the sets allow the similarity. Words by
   which more than ``DENSE`` lines meet are refined: similar lines share two
   words among the whole prefix, so those lines meet by the first two that they
   share; where the word before either is shared too, the two are not the first.
   Words are dealt over passes, as many as keep what one shuffles below ``ROWS``
   rows a set, so the disk needed does not grow with the words of a line.
5. Candidates are verified on full sets, cut again from their texts, the one of
   the nearest parity first; the others only where that one is not similar.

Sets are told apart by a 64-bit hash of their words' hashes, words by 56 bits.

Defined results: lines without a word are kept and never compared; a null text
is the empty text; rows with a null doc_id take no part and keep their lines;
rows that repeat a doc_id are one document, whose lines have equal places (of
two texts under one doc_id, lines of one number do not remove each other); an
empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import discard, materialize, scratch, words

PERCENT = 80
#: Buckets of words whose counts tell how rare a word is; a power of two.
BUCKETS = 1 << 18
#: Lines that meet by one word before a second word is asked for.
DENSE = 256
PICKS = 4
#: Nearest earlier lines of a chosen word, besides its first.
NEAREST = 3
#: Candidates of a line that the first round verifies.
TRIED = 3
#: Sets of more words have a wider parity, of WIDE times 64 bits; a power of two.
LONG, WIDE = 100, 4
#: 64-bit words of the table that tells which lines take part in verification; a power of two.
PLACES = 1 << 16
#: 64-bit words of the table that tells dense words; a power of two. A word that it only seems to hold is refined too.
DENSE_PLACES = 1 << 17
#: Rows that a pass of the last join shuffles, for each set; up to ``ROWS_LEAST`` rows take one pass.
ROWS, ROWS_LEAST = 4, 1 << 20


def _words(text: Column, more_blanks: str) -> Column:
    """The words of a text: most hold no white space but spaces (and ends of lines), and need no regular expression."""
    plain = F.array_remove(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ", -1), "")
    return F.when(text.rlike(rf"[\x09{more_blanks}\x0B-\x0D]"), words(text)).otherwise(plain)


def _parity(keys: Column) -> Column:
    """64 bits, each the parity of the words that fall on it: sets that differ in d words differ in at most d bits."""
    return F.aggregate(keys, F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(F.lit(63)).cast("int"))))


def _wide_parity(keys: Column) -> Column:
    """What ``_parity`` of ``WIDE`` times as many bits adds to it, for sets of more than ``LONG`` words, of which 64 bits tell too little."""
    part = lambda p: _parity(F.filter(keys, lambda k: F.shiftrightunsigned(k, 6).bitwiseAND(F.lit(WIDE - 1)) == p))
    return F.when(F.size(keys) > LONG, F.array(*[part(p) for p in range(1, WIDE)]))


def _apart(a: str, b: str) -> Column:
    """A lower bound of the words that two sets do not share."""
    narrow = F.col(f"{a}parity").bitwiseXOR(F.col(f"{b}parity"))
    xs = [F.get(f"{a}wide", k).bitwiseXOR(F.get(f"{b}wide", k)) for k in range(WIDE - 1)]
    rest = narrow
    for x in xs:
        rest = rest.bitwiseXOR(x)
    return F.coalesce(sum((F.bit_count(x) for x in xs), F.bit_count(rest)), F.bit_count(narrow))


def _least(n: Column, percent: int) -> Column:
    """ceil(percent n / 100), in integers."""
    return F.floor((n * percent + 99) / 100).cast("int")


def _level(n: int) -> int:
    """Twice the binary logarithm of a count, in seven bits."""
    return min(math.floor(2 * math.log2(n + 1)), 126)


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def _levels(docs: DataFrame, text: str) -> DataFrame:
    """One row: for each bucket of words the level of its count, in the top byte of a long."""
    slots = docs.sparkSession.range(0, BUCKETS, 1, 4).select(F.col("id").cast("int").alias("bucket"), F.lit(0).alias("one"))
    found = _texts(docs, text).select(F.explode(_words(F.col("text"), "")).alias("w")).select(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("bucket"), F.lit(1).alias("one"))
    counts = materialize(found.unionByName(slots).groupBy("bucket").agg(F.sum("one").alias("n")), "line-counts")
    level = F.shiftleft(F.least(F.floor(2 * F.log2(F.col("n") + 1.0)), F.lit(126)).cast("long"), 56)
    return counts.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", level.alias("level")))), lambda x: x["level"]).alias("levels"))


def _split(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, line_no and line, for lines with a word."""
    split = _texts(docs, text).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return split.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))


def _hashes(line: Column) -> Column:
    return F.array_distinct(F.transform(_words(line, "\\x0A"), lambda w: F.xxhash64(w)))


def lines_of(docs: DataFrame, levels: DataFrame, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """doc_id, line_no, id (of the set), n (its size), parity and prefix, for lines with a word.

    The prefix has one word more than a single shared word asks for.
    """
    # The table is named before it is used: a subquery cannot be written inside a function of functions.
    tabled = _split(docs, text).withColumn("levels", F.array(levels.scalar()))
    keys = F.sort_array(F.get(F.transform("levels", lambda table: F.transform(
        _hashes(F.col("line")), lambda h: F.get(table, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")).bitwiseOR(F.shiftrightunsigned(h, 8))
    )), F.lit(0)))
    keyed, n = tabled.withColumn("keys", keys), F.size("keys")
    return keyed.select("doc_id", "line_no", F.xxhash64("keys").alias("id"), n.alias("n"), _parity(F.col("keys")).alias("parity"), _wide_parity(F.col("keys")).alias("wide"), F.slice("keys", F.lit(1), n - _least(n, percent) + 2).alias("prefix"))


def _bits(spark: SparkSession, rows: DataFrame, slot: Column, bit: Column, places: int) -> Column:
    """The table of fixed size, as an array of longs, that has the bits of all rows."""
    every = spark.range(0, places, 1, 4).select(F.col("id").cast("int").alias("slot"), F.lit(0).cast("long").alias("bits"))
    bits = rows.select(slot.alias("slot"), bit.alias("bits")).unionByName(every).groupBy("slot").agg(F.bit_or("bits").alias("bits"))
    return bits.agg(F.transform(F.array_sort(F.collect_list(F.struct("slot", "bits"))), lambda x: x["bits"]).alias("bits")).scalar()


def _place(h: Column, places: int) -> tuple[Column, Column]:
    """Slot and bit of a hash in such a table."""
    slot = F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(places - 1)).cast("int")
    return slot, F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))


def _full_sets(pairs: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(doc_id, line_no, keys) of the lines that pairs name, cut again from their texts.

    A table of fixed size tells most lines that take no part; the join decides.
    """
    spark = docs.sparkSession
    ends = [pairs.select(F.col(f"{x}_doc").alias("doc_id"), F.col(f"{x}_line").alias("line_no")) for x in ("first", "later")]
    wanted = materialize(ends[0].unionByName(ends[1]).distinct(), "line-wanted")
    slot, bit = _place(F.xxhash64("doc_id", "line_no"), PLACES)
    table = _bits(spark, wanted, slot, bit, PLACES)
    near = _split(docs, text).where(F.get(table, slot).bitwiseAND(bit) != 0).select("doc_id", "line_no", _hashes(F.col("line")).alias("keys"))
    # A repeated doc_id may have two texts, and so two sets of one place.
    return materialize(near.join(wanted.hint("merge"), ["doc_id", "line_no"], "left_semi").dropDuplicates(["doc_id", "line_no", "keys"]), "line-full")


#: What travels with a word: of the word 32 bits, which can only add candidates, and size and position as one number.
_SIZED = 1 << 31


def _postings(first: DataFrame, percent: int) -> DataFrame:
    """The sets with each word (word) of their shorter prefixes and its place (i)."""
    return first.select("*", F.posexplode(F.slice("prefix", F.lit(1), F.col("n") - _least(F.col("n"), percent) + 1)).alias("i", "word"))


def _narrow(rows: DataFrame, word: Column, at: Column, *more: str) -> DataFrame:
    # Openness is the last bit of the size.
    m = F.col("n") * 2 + F.col("open").cast("int")
    return rows.select("doc_id", "line_no", "parity", "wide", F.hash(word).alias("token"), (m.cast("long") * _SIZED + at).alias("ni"), *more)


def _at(ni: str) -> Column:
    return F.col(ni).bitwiseAND(F.lit(_SIZED - 1)).cast("int")


def _may(a: str, b: str, percent: int, unit: int = 1) -> Column:
    """Whether sizes, positions at the first shared word, and parities allow the similarity; sizes are in units."""
    n, m = (F.shiftright(f"{x}ni", 30 + unit).cast("int") for x in (a, b))
    overlap = F.least(n - _at(f"{a}ni"), m - _at(f"{b}ni")) * (100 + percent) >= (n + m) * percent
    bound = (n + m) * (100 - percent)
    apart = (F.bit_count(F.col(f"{a}parity").bitwiseXOR(F.col(f"{b}parity"))) * (100 + percent) <= bound) & (_apart(a, b) * (100 + percent) <= bound)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & overlap & apart


_PAIR = ["first_doc", "first_line", "later_doc", "later_line"]


def _pair(a: str, b: str) -> list[Column]:
    """The places of an earlier and a later set, and the distance of their parities."""
    named = zip(_PAIR, (f"{a}doc_id", f"{a}line_no", f"{b}doc_id", f"{b}line_no"), strict=True)
    return [F.col(c).alias(name) for name, c in named] + [_apart(a, b).alias("far")]


def _nearest(pairs: DataFrame) -> DataFrame:
    """For each later set the candidate of the nearest parity."""
    best = pairs.groupBy("later_doc", "later_line").agg(F.min(F.struct("far", "first_doc", "first_line")).alias("b"))
    return best.select("b.first_doc", "b.first_line", "later_doc", "later_line")


def _led(first: DataFrame, percent: int) -> DataFrame:
    """Pairs of each set and the likest of the first and the nearest earlier sets of its chosen words."""
    short = F.slice("prefix", F.lit(1), F.col("n") - _least(F.col("n"), percent) + 1)
    least = lambda salt: F.array_min(F.transform(short, lambda t: F.hash(t, F.lit(salt))))
    picks = F.array(*[least(k) for k in range(PICKS)])
    rows = first.select("doc_id", "line_no", (F.col("n").cast("long") * _SIZED).alias("ni"), "parity", "wide", F.posexplode(picks).alias("k", "token"))
    order, fields = Window.partitionBy("k", "token").orderBy("doc_id", "line_no"), F.struct("doc_id", "line_no", "ni", "parity", "wide")
    lead = F.first(fields).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumns({"l0": lead} | {f"l{k}": F.lag(fields, k).over(order) for k in range(1, NEAREST + 1)})
    rows = rows.select("doc_id", "line_no", "ni", "parity", "wide", F.explode(F.array(*[f"l{k}" for k in range(NEAREST + 1)])).alias("l"))
    met = rows.where(F.col("l").isNotNull() & (F.struct("l.doc_id", "l.line_no") < F.struct("doc_id", "line_no")) & _may("", "l.", percent))
    # At most PICKS * (NEAREST + 1) of a set, of which TRIED are verified.
    some = met.select(*_pair("l.", "")).groupBy("later_doc", "later_line").agg(F.sort_array(F.collect_set(F.struct("far", "first_doc", "first_line"))).alias("c"))
    return some.select("later_doc", "later_line", F.explode(F.slice("c", 1, TRIED)).alias("b")).select("b.first_doc", "b.first_line", "later_doc", "later_line")


def _dense(first: DataFrame, percent: int) -> DataFrame:
    """Words (token) by which more than ``DENSE`` sets meet; their buckets of words are at least as full."""
    rows = _postings(first, percent).where(F.col("word") >= _level(DENSE) << 56)
    return rows.groupBy(F.hash("word").alias("token")).count().where(F.col("count") > DENSE).select("token")


def _one(first: DataFrame, dense: Column, percent: int) -> DataFrame:
    """Rows by each word that is not dense."""
    return _postings(first, percent).where(~dense).withColumn("key", F.col("word"))


def _two(first: DataFrame, dense: Column, percent: int) -> DataFrame:
    """Rows by each dense word and each later word of the whole prefix, with the words before the two.

    Where the two are the first that a pair shares, no word before the second but the first is
    shared, so all of those but one are missing from the overlap: their number is the place (i).
    """
    later = F.posexplode(F.slice("prefix", F.col("i") + 2, F.size("prefix"))).alias("j", "v")
    rows = _postings(first, percent).where(dense).select("*", later)
    return rows.withColumns({
        "key": F.xxhash64("word", "v"), "before": F.get("prefix", F.col("i") - 1), "between": F.when(F.col("j") > 0, F.get("prefix", F.col("i") + F.col("j"))), "i": F.col("i") + F.col("j"),
    })


def _meet(a: DataFrame, b: DataFrame, percent: int, *apart: str) -> DataFrame:
    """Pairs of an earlier set of any kind and an open one that share a token and not the words ``apart``."""
    open_ = F.shiftright("b.ni", 31).bitwiseAND(F.lit(1)) == 1
    before = (F.col("a.doc_id") < F.when(open_, F.col("b.doc_id"))) | (F.col("a.doc_id") == F.when(open_, F.col("b.doc_id"))) & (F.col("a.line_no") < F.col("b.line_no"))
    allowed = (F.col("a.token") == F.col("b.token")) & before & _may("a.", "b.", percent, 2)
    for c in apart:
        allowed = allowed & F.coalesce(F.col(f"a.{c}") != F.col(f"b.{c}"), F.lit(True))
    return a.alias("a").hint("merge").join(b.alias("b").hint("merge"), allowed).select(*_pair("a.", "b."))


def _open_pairs(first: DataFrame, dense: DataFrame, percent: int) -> Iterator[DataFrame]:
    """Candidates of the sets that are ``open``, with earlier sets of all kinds: by one word, and by two where the first is dense; a frame a pass."""
    slot, bit = _place(F.hash("word").cast("long"), DENSE_PLACES)
    table = _bits(first.sparkSession, dense, *_place(F.col("token").cast("long"), DENSE_PLACES), DENSE_PLACES)
    is_dense = F.get(table, slot).bitwiseAND(bit) != 0
    many = _postings(first, percent).agg(
        F.sum(F.when(~is_dense, 1)).alias("one"), F.sum(F.when(is_dense, (F.size("prefix") - F.col("i") - 1) * (1 + F.col("open").cast("int")))).alias("two"), F.sum(F.when(F.col("i") == 0, 1)).alias("sets")).first()
    passes = lambda rows: math.ceil((rows or 0) / max(ROWS * (many.sets or 0), ROWS_LEAST))
    share = lambda rows, p, of: rows.where(F.pmod("key", F.lit(of)) == p) if of > 1 else rows
    for p in range(n := passes(many.one)):
        rows = _narrow(share(_one(first, is_dense, percent), p, n), F.col("key"), F.col("i"))
        # Openness is part of the order only, and both sides are one shuffle.
        yield _meet(rows, rows, percent)
    # These rows are half as wide again.
    for p in range(n := passes((many.two or 0) * 3 / 2)):
        rows = _narrow(share(_two(first, is_dense, percent), p, n), F.col("key"), F.col("i"), "before", "between")
        # Among the many lines of a dense word few may be open: the settled ones must not meet each other.
        yield _meet(rows, rows.where(F.shiftright("ni", 31).bitwiseAND(F.lit(1)) == 1), percent, "before", "between")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Places of the later sets of candidates that are similar to the earlier ones."""
    side = lambda name, x: sets.select(F.col("doc_id").alias(f"{name}_doc"), F.col("line_no").alias(f"{name}_line"), F.col("keys").alias(x))
    common = F.size(F.array_intersect("x", "y"))
    found = pairs.select(*_PAIR).join(side("first", "x"), ["first_doc", "first_line"]).join(side("later", "y"), ["later_doc", "later_line"]).where(
        common * 100 >= (F.size("x") + F.size("y") - common) * percent)
    return materialize(found.select(F.col("later_doc").alias("doc_id"), F.col("later_line").alias("line_no")).distinct(), "line-removed")


def repeats(docs: DataFrame, percent: int = PERCENT, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All lines with a word (doc_id, line_no, id), and those of them to remove (doc_id, line_no).

    The first place of a set stands for it. Where a repeated doc_id has two texts, two sets may
    have one place; what is true of either then decides about that place.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100: two shared words are else not certain")
    spark = docs.sparkSession
    sets = materialize(lines_of(docs, _levels(docs, text), percent, text), "line-sets")
    # In two halves, so that the shuffle of one is gone when the other begins.
    halves = [sets.where(F.pmod("id", F.lit(2)) == half).groupBy("id").agg(F.min(F.struct("doc_id", "line_no", "n", "parity", "wide", "prefix")).alias("f"), F.count(F.lit(1)).alias("copies")) for half in (0, 1)]
    first = reduce(DataFrame.unionByName, [materialize(half.select("id", "copies", "f.*"), "line-first") for half in halves])
    lines = materialize(sets.select("doc_id", "line_no", "id"), "line-places")
    discard(spark, "line-sets")
    led = materialize(_led(first, percent), "line-led")
    settled = _verified(led, _full_sets(led, docs, text), percent)
    discard(spark, "line-full")
    dense = materialize(_dense(first, percent), "line-dense")
    flagged = first.join(settled.withColumn("gone", F.lit(True)), ["doc_id", "line_no"], "left")
    first = materialize(flagged.withColumn("open", F.col("gone").isNull()).drop("gone"), "line-open")
    discard(spark, "line-first")
    # Written one after the other, so that the shuffles of a pass are gone when the next begins.
    written = [materialize(found.distinct(), "line-pairs") for found in _open_pairs(first, dense, percent)]
    pairs = reduce(DataFrame.unionByName, written, spark.createDataFrame([], f"{', '.join(f'{c} {t}' for c, t in zip(_PAIR, ('long', 'int') * 2, strict=True))}, far int"))
    full, best = _full_sets(pairs, docs, text), materialize(_nearest(pairs), "line-best")
    found = _verified(best, full, percent)
    left = pairs.join(found, [F.col("later_doc") == F.col("doc_id"), F.col("later_line") == F.col("line_no")], "left_anti").join(best, _PAIR, "left_anti")
    removed = settled.unionByName(found).unionByName(_verified(left, full, percent)).distinct().withColumn("similar", F.lit(True))

    # A line goes if its set is similar to an earlier one, or if it is not the first of its set.
    known = first.select("id", "copies", "doc_id", "line_no").join(removed, ["doc_id", "line_no"], "left").where("copies > 1 OR similar")
    known = known.select("id", F.col("doc_id").alias("d"), F.col("line_no").alias("l"), "similar")
    gone = lines.join(known, "id").where("similar OR doc_id <> d OR line_no <> l").select("doc_id", "line_no").distinct()
    return lines, gone


def removed_lines(docs: DataFrame, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """doc_id, n_lines (with a word) and the sorted numbers of its removed lines, for documents with a line."""
    with scratch(docs.sparkSession):
        lines, gone = repeats(docs, percent, text)
        counts = lines.select("doc_id", "line_no").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"))
        found = counts.join(gone.groupBy("doc_id").agg(F.sort_array(F.collect_list("line_no")).alias("removed")), "doc_id", "left")
        return materialize(found, "line-found", keep=True)


def dedup_lines(docs: DataFrame, percent: int = PERCENT, text: str = "text") -> DataFrame:
    """The documents with their removed lines left out; ``n_lines`` and ``removed`` are added."""
    found = removed_lines(docs, percent, text).withColumnRenamed("doc_id", "__id")
    kept = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda _, i: ~F.array_contains("removed", i)), "\n")
    fresh = docs.select([c for c in docs.columns if c not in ("n_lines", "removed")])
    return fresh.join(found, fresh["doc_id"].cast("long") == F.col("__id"), "left").withColumn(
        text, F.when(F.col("removed").isNotNull(), kept).otherwise(F.col(text))
    ).drop("__id")
