"""Personal data in texts: proposed by patterns, confirmed by checksums, scored by context.

DataFrame functions only. A regular expression proposes spans of each kind,
leftmost and without overlap; a validator (digit counts, octet range, Luhn,
mod-97) confirms or drops each; words near the span move its score up or down.
Kinds of the base are kept whatever their score. Kinds the method adds
(bank account numbers, social security numbers) need ``min_score``.

Positions are code points, end exclusive. They come from the lengths of the
pieces that ``split`` leaves between the matches, in one pass over the text.

Defined results: null text counts as empty and has no span; an empty table
gives an empty table; repeated rows are each scanned; other columns pass
through, and an input column named ``pii`` is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of context on either side that may hold a telling word.
CONTEXT = 40
MIN_SCORE = 0.6
SPAN = "struct<kind:string,start:bigint,end:bigint,value:string,score:double>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    """True if the digits of ``x`` pass the Luhn check."""
    digits = F.split(F.reverse(_digits(x)), "")
    doubled = F.transform(
        digits,
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            d.cast("int") * 2 - F.when(d.cast("int") > 4, F.lit(9)).otherwise(F.lit(0))
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10 == 0


def _mod97(x: Column) -> Column:
    """True if an account number, its first four characters moved last, leaves 1 on division by 97."""
    solid = F.regexp_replace(x, " ", "")
    chars = F.split(F.concat(F.substring(solid, 5, 40), F.substring(solid, 1, 4)), "")
    step = lambda a, c: F.when(
        c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97
    ).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(chars, F.lit(0), step) == 1


def _n_digits(low: int, high: int) -> Callable[[Column], Column]:
    return lambda x: F.length(_digits(x)).between(low, high)


@dataclass(frozen=True)
class Kind:
    """``needs``: text without a match of this short pattern has no span of the kind."""

    name: str
    pattern: str
    needs: str
    valid: Callable[[Column], Column] | None
    score: float
    near: str
    base: bool = True


# The patterns carry look-behinds and possessive runs only to stay linear on
# long runs; they match what the plain forms match.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@",
         None, 0.9, r"(?i)\b(?:e-?mail|contact|write|courriel|correo)\b"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]",
         lambda x: F.forall(F.split(x, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")),
         0.6, r"(?i)\b(?:ip|host|server|address|adresse)\b"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9]){12}",
         lambda x: F.length(_digits(x)).between(13, 19) & _luhn(x),
         0.8, r"(?i)\b(?:card|visa|credit|carte|tarjeta|karte)\b"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", _n_digits(9, 15),
         0.7, r"(?i)\b(?:phone|call|tel|mobile|fax|telefon)\b"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", _mod97,
         0.8, r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b", base=False),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]", None,
         0.3, r"(?i)\b(?:ssn|social security)\b", base=False),
)
#: Words that speak against personal data, for every kind.
AGAINST = r"(?i)\b(?:example|sample|dummy|version|isbn|order|invoice)\b"


def _spans(text: Column, kind: Kind, min_score: float) -> Column:
    """Array of the confirmed spans of one kind."""
    gaps, hits = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    # Row k: what stands before hit k, hit k, what stands after it.
    rows = F.zip_with(
        F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(h.alias("h"), g.alias("g"))),
        F.slice(gaps, F.lit(2), F.size(hits)), lambda x, a: F.struct(x["h"].alias("h"), x["g"].alias("g"), a.alias("a")),
    )
    near = lambda x: F.concat(F.substring(x["g"], -CONTEXT, CONTEXT), F.lit(" "), F.substring(x["a"], 1, CONTEXT))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        score = F.lit(kind.score) + F.when(near(x).rlike(kind.near), 0.4).otherwise(0.0) - F.when(near(x).rlike(AGAINST), 0.2).otherwise(0.0)
        span = F.struct(
            F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(x["h"])).alias("end"),
            x["h"].alias("value"), F.round(F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0)), 2).alias("score"),
        )
        good = kind.valid(x["h"]) if kind.valid else F.lit(True)
        if not kind.base:
            good = good & (score >= min_score - 1e-9)
        return F.struct(
            (start + F.length(x["h"])).alias("at"),
            F.when(good, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"),
        )

    empty = F.array().cast(f"array<{SPAN}>")
    found = F.aggregate(rows, F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out")), step)["out"]
    return F.when(text.rlike(kind.needs), found.cast(f"array<{SPAN}>")).otherwise(empty)


def find(docs: DataFrame, text: str = "text", min_score: float = MIN_SCORE, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Add ``pii``: all spans, by kind as listed, then start."""
    plain = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn("pii", F.concat(*[_spans(plain, k, min_score) for k in kinds]))


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """Replace each span of ``pii`` by ``[KIND]``; of overlapping spans the first to start wins."""
    spans = F.array_sort("pii", lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
                         .when(a["end"] > b["end"], -1).when(a["end"] < b["end"], 1).otherwise(0))
    plain = F.coalesce(F.col(text), F.lit(""))
    done = F.aggregate(
        spans, F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(
            s["end"].alias("at"),
            F.concat(a["out"], F.array(
                F.substring(plain, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")),
                F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")),
            )).alias("out"),
        )),
    )
    return found.withColumn("__r", done).withColumn(
        text, F.concat(F.array_join("__r.out", ""), F.substring(plain, (F.col("__r.at") + 1).cast("int"), F.length(plain)))
    ).drop("__r")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
