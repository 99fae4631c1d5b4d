"""Secrets in texts: fixed patterns, and strings whose windows look random.

Base kinds come from patterns. The method adds ``entropy`` spans: every run of
at least ``WINDOW`` key characters is classed by its alphabet (hex digits,
letters and digits, base64), a window slides over it, and the Shannon entropy
of each window follows from the last by the counts of the one character that
leaves and the one that enters. A run whose best window reaches the threshold
of its class is a span unless an allow-list entry speaks for it.

A text is scanned whole by an Arrow-batched function in the scan's own tasks:
no shuffle, and a lost executor costs only its batches.

Defined results: null text counts as empty and has no span; an empty table
gives an empty table; repeated rows are each scanned; extra columns pass
through, and an input column named ``secrets`` is replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Least bits a character that the best window of a run must reach, by class.
THRESHOLD = {"hex": 3.0, "alnum": 3.6, "base64": 3.8}
SPAN = "struct<kind:string,start:bigint,end:bigint,value:string,bits:double>"

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: Runs that look random and are not secret: identifiers of content, of builds and of paths.
ALLOW = (
    re.compile(r"(?:[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12})"),
    re.compile(r"(?i:example|sample|placeholder|changeme|xxxx|0123456789|abcdefgh)"),
)
ALLOW_BEFORE = re.compile(r"(?i:sha-?(?:1|256|512)|md5|commit|etag|integrity|checksum)[\s:=\"'-]*$")
#: A part of a path; it speaks for itself and not for the rest of its run.
PATH = re.compile(r"/[A-Za-z0-9_-]*[a-z]{3,}[A-Za-z0-9_-]*(?=/)")
#: An address ends at white space, a quote or a bracket of markup.
URL = re.compile(r"(?i:https?:/)[^\s\"'<>`]*")


def _class(run: str) -> str | None:
    """The alphabet of a run; None if it holds no digit, or nothing but digits and separators."""
    digits = sum(c.isdigit() for c in run)
    letters = sum(c.isalpha() for c in run)
    if not digits or not letters:
        return None
    if all(c in "0123456789abcdefABCDEF" for c in run):
        return "hex"
    return "alnum" if run.isalnum() else "base64"


def best_window(run: str, width: int = WINDOW) -> float:
    """The highest entropy, in bits a character, of a window of ``width`` characters.

    With counts n of a window of w characters the entropy is
    log2 w - sum(n log2 n) / w; one step changes two counts.
    """
    part = [0.0] + [n * math.log2(n) for n in range(1, width + 1)]
    counts: dict[str, int] = {}
    total = 0.0
    best = 0.0
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        total += part[n + 1] - part[n]
        counts[c] = n + 1
        if i >= width:
            out = run[i - width]
            n = counts[out]
            total += part[n - 1] - part[n]
            counts[out] = n - 1
        if i >= width - 1:
            best = max(best, math.log2(width) - total / width)
    return best


def _allowed(text: str, start: int, run: str, threshold: float) -> bool:
    if any(p.search(run) for p in ALLOW) or ALLOW_BEFORE.search(text, max(0, start - 64), start):
        return True
    if not PATH.search(run):
        return False
    return all(best_window(part) < threshold for part in PATH.sub(" ", run).split())


def scan(text: str) -> list[tuple[str, int, int, str, float]]:
    """All spans of a text, by start, then kind as listed."""
    spans = [("assign", m.start(), m.end(), m[2], 0.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [("access", m.start(), m.end(), m[0], 0.0) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [("hex", m.start(), m.end(), m[0], 0.0) for m in HEX.finditer(text)]
    urls, at = None, 0
    for m in RUN.finditer(text):
        kind = _class(m[0])
        if kind and (bits := best_window(m[0])) >= THRESHOLD[kind] and not _allowed(text, m.start(), m[0], THRESHOLD[kind]):
            urls = [u.span() for u in URL.finditer(text)] if urls is None else urls  # few texts come here
            while at < len(urls) and urls[at][1] <= m.start():
                at += 1
            if at < len(urls) and urls[at][0] <= m.start():
                continue
            spans.append(("entropy", m.start(), m.end(), m[0], round(bits, 3)))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``secrets``: all spans of each text."""

    @F.pandas_udf(f"array<{SPAN}>")
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("kind", "start", "end", "value", "bits")
        for texts in batches:
            yield pd.Series([[dict(zip(names, s, strict=True)) for s in scan(t)] if t else [] for t in texts], dtype=object)

    return docs.withColumn("secrets", scanned(F.col(text)))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
