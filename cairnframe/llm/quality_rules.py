"""Quality rules as a bitmask ledger, with DataFrame functions only.

Every rule is evaluated once per document. The ledger row holds the
measurements and one failure bit per rule; policies are masks over those bits,
so another policy version, or the effect of leaving a rule out, needs bitwise
arithmetic on the ledger and never another look at the texts.

Defined results: a null text counts as the empty text (no word, so the
``few_words`` bit is set); an empty table gives an empty ledger; repeated rows
are each judged; other columns of the input are passed through, and an input
column that has the name of a ledger column is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BLANKS, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "ledger_row", "fail_bits", "kept", "policy")


@dataclass(frozen=True)
class Rule:
    """A failure condition over measurement columns, in integer arithmetic."""

    name: str
    bit: int
    fails: str


#: Bits are never reused for another meaning: a new rule takes a new bit.
RULES = (
    Rule("few_words", 0, "n_words < 20"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > 3 * n_words"),
    Rule("repeated_lines", 3, "100 * n_dup_lines > 50 * n_lines"),
    Rule("word_length", 4, "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule("upper_case", 5, "100 * n_upper > 60 * word_chars"),
)
BASE_RULES = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A named, versioned choice of rules that reject a document."""

    name: str
    version: int
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        bits = {r.name: 1 << r.bit for r in rules}
        return sum(bits[n] for n in self.rules)


POLICIES = {
    ("base", 1): Policy("base", 1, BASE_RULES),
    ("standard", 1): Policy("standard", 1, tuple(r.name for r in RULES)),
}
STANDARD = POLICIES["standard", 1]


def _pairwise(values: Column, gap: int, join) -> Column:
    """``join`` of each element and the one ``gap`` places on (null past the end)."""
    return F.zip_with(values, F.slice(values, F.lit(gap + 1), F.greatest(F.size(values) - gap, F.lit(0))), join)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurement columns, each computed once per document.

    Windows of eight words are compared by 64-bit hashes, folded from hashes of
    one, two and four words. Only a document with an equal pair has its windows
    sorted, so that equal ones become neighbours; each start of such a window,
    in text order, then adds the words up to the next start, eight at most.
    Every step is a column of its own, so that no lambda recomputes an array.
    """
    hashed = lambda a, b: F.xxhash64(a, b)
    fresh = docs.select([c for c in docs.columns if c not in MEASURES])
    return (
        fresh.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
        .withColumns({
            "__words": words(F.col("__text")),
            "__lines": F.filter(F.split("__text", "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0),
            "__solid": F.translate("__text", BLANKS, ""),
        })
        .withColumns({
            "n_words": F.size("__words").cast("long"),
            "__w1": F.transform("__words", lambda w: F.xxhash64(w)),
            "word_chars": F.length("__solid").cast("long"),
            "n_symbols": (F.length("__solid") - F.length(F.translate("__solid", SYMBOLS, ""))).cast("long"),
            "n_upper": F.regexp_count("__solid", F.lit(r"\p{Lu}")).cast("long"),
            "n_lines": F.size("__lines").cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        })
        .withColumn("__w2", _pairwise(F.col("__w1"), 1, hashed))
        .withColumn("__w4", _pairwise(F.col("__w2"), 2, hashed))
        .withColumn("__w8", _pairwise(F.col("__w4"), 4, hashed))
        .withColumn("__w8", F.slice("__w8", F.lit(1), F.greatest(F.size("__w8") - (WINDOW - 1), F.lit(0))))
        .withColumn(
            "__pairs",
            F.when(
                F.size(F.array_distinct("__w8")) < F.size("__w8"),
                F.sort_array(F.transform("__w8", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            ),
        )
        .withColumn("__equal", F.filter(
            _pairwise(F.col("__pairs"), 1, lambda a, b: F.when(a["h"] == b["h"], F.struct(a["i"].alias("i"), b["i"].alias("j")))),
            lambda x: x.isNotNull(),
        ))
        .withColumn("__starts", F.sort_array(F.array_distinct(F.concat(F.col("__equal.i"), F.col("__equal.j")))))
        .withColumn("n_repeat_words", F.coalesce(F.aggregate(
            _pairwise(F.col("__starts"), 1, lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW))),
            F.lit(0).cast("long"), lambda n, x: n + x,
        ), F.lit(0)).cast("long"))
        .drop("__text", "__words", "__lines", "__solid", "__w1", "__w2", "__w4", "__w8", "__pairs", "__equal", "__starts")
    )


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Measurements and ``fail_bits``: bit b is set when rule b fails.

    ``ledger_row`` numbers the rows. A filter that names it stays above the
    measurements; without it the optimizer would move a policy's filter below
    them and evaluate every rule twice.
    """
    bits = sum(
        (F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long") for r in rules[1:]),
        F.when(F.expr(rules[0].fails), F.lit(1 << rules[0].bit)).otherwise(F.lit(0)).cast("long"),
    )
    return measure(docs, text).withColumn("ledger_row", F.monotonically_increasing_id()).withColumn("fail_bits", bits)


def apply_policy(rows: DataFrame, policy: Policy = STANDARD, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``kept`` and the policy's label to ledger rows."""
    return rows.withColumns({
        "kept": F.col("fail_bits").bitwiseAND(F.lit(policy.mask(rules))) == 0,
        "policy": F.lit(f"{policy.name}@{policy.version}"),
    })


def passing(docs: DataFrame, policy: Policy = STANDARD, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The documents that a policy keeps, in their own columns."""
    rows = apply_policy(ledger(docs, rules, text), policy, rules)
    return rows.where(F.col("kept") & (F.col("ledger_row") >= 0)).select(*docs.columns)


def ablations(rows: DataFrame, policy: Policy = STANDARD, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: documents that fail it, and documents that
    would come back if it alone were left out.

    The ledger is first counted by its bits (at most 2 ** rules groups), and
    only those counts are looked at again.
    """
    mask = policy.mask(rules)
    counts = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).count()
    named = F.array(*[
        F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit"))
        for r in rules if r.name in policy.rules
    ])
    return (
        counts.select("bits", "count", F.explode(named).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("count")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("count")).otherwise(0)).alias("n_only_this"),
        )
    )
