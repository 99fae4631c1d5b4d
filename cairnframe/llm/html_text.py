"""Main text of web pages: structure, and repeated runs of a host where structure leaves doubt.

A tokenizer of markup, run in the tasks of the scan, turns each page into
blocks of text. Scripts, styles, menus, headers, footers, sidebars, notices,
adverts, forms and comments go by their elements, or by class names that say
nothing else (``comment-list``, ``ad``). Where a page marks its article (or main
part), the blocks inside are the text. In doubt are

* blocks under a name that only has such a part (``related-work``, ``social-impact``),
* all blocks of a page that marks no article.

There repetition decides: a run of at least ``RUN`` tokens that occurs on two or
more distinct pages of a host is boilerplate, and so is a shorter block under
such a name if it occurs whole. A block goes only if runs cover all of it, so a
quote inside a text stays, and pages of a host with equal text count as one, so
that copies of a page do not erase each other.

Repeated runs are what neighbours in a suffix array over the host's concatenated
token streams share. Suffixes are dealt here by a shuffle on (host, first
``RUN`` tokens): equal keys are the neighbours with a common prefix of ``RUN``
or more, and the union of their positions is every longer repeat as well. Runs
are first aggregated, and the occurrences of each are spread over ``SALTS``
tasks, so a run that a third of all pages have fills no single task.

Other text inside a marked article is never removed for being repeated: articles
quote and copy each other, and even headlines recur.

Defined results: null html counts as empty and gives the empty text; an empty
table gives an empty table; repeated rows are each extracted, and two rows with
one text count as one page for repetition; extra columns are not carried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize

#: Tokens of a run that must recur on another page of the host.
RUN = 8
#: Tasks over which the occurrences of one run are spread.
SALTS = 16

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*+)>|<[!?][^>]*+>""", re.S
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

#: Elements whose content is not markup and never text of the page.
RAW = frozenset("script style noscript template iframe textarea title svg math object".split())
#: Elements that are never part of an article.
CHROME = frozenset("head nav header footer aside form button select dialog menu".split())
#: Parts of class and id names, and roles, that mark the same.
CHROME_NAMES = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header footer sidebar "
    "aside cookie cookies consent notice banner popup modal comment comments disqus share sharing social related newsletter subscribe "
    "signup widget search complementary contentinfo".split()
)
#: A class that begins so tells what else a page has, as in "with-sidebar".
LAYOUT = frozenset("has with no without is".split())
#: Beside those, parts of a name that say only what shape a thing has or where it stands.
SHAPES = frozenset(
    "area bar block body bottom box button buttons container content count field form global google group icon icons inner item items left link links list main "
    "mobile outer panel posts primary reader readers right row secondary section site slot sticky thread toggle top unit user users wrap wrapper".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def _chrome(name: str, attributes: str) -> int:
    """2 for what is never part of an article, 1 where a part of its name only hints at that, else 0."""
    if name in CHROME:
        return 2
    if "=" not in attributes or name in ("article", "main"):
        return 0
    found = 0
    for m in ATTRIBUTE.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        for label in value.lower().split():
            parts = [x for x in re.split(r"[_-]+", label) if x]
            if parts and parts[0] not in LAYOUT and not CHROME_NAMES.isdisjoint(parts):
                sure = all(x in CHROME_NAMES or x in SHAPES or x.isdigit() for x in parts)
                found = max(found, 2 if sure else 1)
    return found


def blocks(html: str | None) -> tuple[list[tuple[str, bool]], bool]:
    """The blocks of a page that may be its text, each with whether its name leaves doubt, and whether all are in doubt."""
    article: list[tuple[str, bool]] = []
    main: list[tuple[str, bool]] = []
    body: list[tuple[str, bool]] = []
    now: list[str] = []
    depth = {"article": 0, "main": 0}
    skip, level = "", 0  # the chrome element that is open, and how often its name is
    maybe, inside = "", 0  # the same of an element whose name leaves doubt
    at, html = 0, html or ""

    def close() -> None:
        if now:
            text = " ".join(unescape("".join(now)).split())
            now.clear()
            if text:
                (article if depth["article"] else main if depth["main"] else body).append((text, bool(maybe)))

    while True:
        m = TAG.search(html, at)
        if not skip and (m.start() if m else len(html)) > at:
            now.append(html[at: m.start() if m else len(html)])
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        ends, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in RAW and not ends:
            if not skip:
                now.append(" ")
            if not attributes.endswith("/"):
                found = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(html, at)
                at = found.end() if found else len(html)
            continue
        if skip == "p" and name not in INLINE and name != "br":  # a paragraph ends where another block begins or ends
            skip = ""
            if ends and name == "p":
                continue
        if skip:
            if name == skip:
                level += -1 if ends else 1
                if not level:
                    skip = ""
            elif ends and name in ("body", "html") or ends and name in depth and depth[name]:
                skip = ""
            if skip:
                continue
        if name in INLINE:
            continue
        sign = 0 if ends or name in VOID or name in ("html", "body") else _chrome(name, attributes)
        close()
        if maybe == "p" and name != "br" or maybe and ends and (name in ("body", "html") or name in depth and depth[name] and maybe != name):
            maybe = ""
        elif maybe == name:
            inside += -1 if ends else 1
            if not inside:
                maybe = ""
        if sign == 2:
            skip, level = name, 1
            continue
        if sign == 1 and not maybe:
            maybe, inside = name, 1
        kind = name if name in depth else "main" if not ends and 'role="main"' in attributes.lower() else ""
        if kind == name and ends:
            depth[kind] = max(0, depth[kind] - 1)
        elif kind:
            depth[kind] += 1
    close()
    return (article, False) if article else (main, False) if main else (body, True)


def parse(pages: DataFrame, run: int = RUN, html: str = "html") -> DataFrame:
    """page_id, url, host and the text where it is certain.

    Where it is not: ``parts``, the blocks in their order with null for one in doubt, the ``tokens`` of those,
    their ``lengths``, the starts of the ``short`` ones under a name, and a hash of the whole page's ``content``.
    """

    @F.pandas_udf("struct<text:string,parts:array<string>,tokens:array<string>,lengths:array<int>,short:array<int>,content:long>")
    def parsed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page in batch:
                found, doubt = blocks(page)
                text = " ".join(b for b, _ in found)
                if not doubt and not any(named for _, named in found):
                    rows.append((text, None, None, None, None, None))
                    continue
                tokens, lengths, short = [], [], []
                for b, named in found:
                    if doubt or named:
                        words = b.split()
                        if named and len(words) < run:
                            short.append(len(tokens))
                        tokens += words
                        lengths.append(len(words))
                content = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
                rows.append((None, [None if doubt or named else b for b, named in found], tokens, lengths, short, content))
            frame = pd.DataFrame(rows, columns=["text", "parts", "tokens", "lengths", "short", "content"], dtype=object)
            yield frame.assign(content=frame["content"].astype("Int64"))

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))
    return pages.select("page_id", "url", host.alias("host"), parsed(html).alias("p")).select(
        "page_id", "url", "host", "p.*", F.monotonically_increasing_id().alias("row")
    )


def repeated(rows: DataFrame, run: int = RUN) -> DataFrame:
    """row, and the sorted starts of its runs that a page of other content on the host has too.

    ``rows`` has row, content, host, tokens, lengths and short. A short block under a name is found whole, as -1 - its start.
    """
    starts = F.sequence(F.lit(1), F.size("tokens") - run + 1)
    long_ = F.when(F.size("tokens") >= run, F.transform(starts, lambda i: F.struct((i - 1).alias("at"), F.xxhash64(F.slice("tokens", i, run)).alias("gram"))))
    begins = F.transform(F.sequence(F.lit(0), F.size("lengths") - 1), lambda k: F.struct(
        F.aggregate(F.slice("lengths", F.lit(1), k), F.lit(0), lambda a, n: a + n).alias("b"), F.get("lengths", k).alias("n")))
    short = F.when(F.size("short") > 0, F.transform(
        F.filter(begins, lambda x: F.array_contains("short", x["b"])),
        lambda x: F.struct((-1 - x["b"]).alias("at"), F.xxhash64(F.lit("whole"), F.slice("tokens", x["b"] + 1, x["n"])).alias("gram"))))
    both = F.concat(F.coalesce(long_, F.array().cast("array<struct<at:int,gram:bigint>>")), F.coalesce(short, F.array().cast("array<struct<at:int,gram:bigint>>")))
    grams = rows.select("row", "content", "host", F.explode(both).alias("g")).select(
        "row", "content", "host", "g.at", "g.gram", F.pmod("row", F.lit(SALTS)).cast("int").alias("salt"))
    shared = grams.groupBy("host", "gram").agg(F.min("content").alias("a"), F.max("content").alias("b")).where("a <> b")
    shared = shared.select("host", "gram", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return grams.join(shared, ["host", "gram", "salt"], "left_semi").groupBy("row").agg(F.sort_array(F.collect_list("at")).alias("starts"))


def extract(pages: DataFrame, run: int = RUN, html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = materialize(parse(pages, run, html), "html-parsed")
    doubt = rows.where(F.col("tokens").isNotNull())
    starts = repeated(doubt, run)

    @F.pandas_udf("string")
    def uncovered(parts: pd.Series, tokens: pd.Series, lengths: pd.Series, starts: pd.Series) -> pd.Series:
        out = []
        for blocks_, words, sizes, at in zip(parts, tokens, lengths, starts, strict=True):
            covered = bytearray(len(words))
            whole = set()
            for i in () if at is None else at:
                if i < 0:
                    whole.add(-1 - i)
                else:
                    covered[i: i + run] = b"\x01" * min(run, len(words) - i)
            kept, begin, ns = [], 0, iter(sizes)
            for b in blocks_:
                if b is None:
                    n = next(ns)
                    if begin not in whole and not all(covered[begin: begin + n]):
                        kept.append(" ".join(words[begin: begin + n]))
                    begin += n
                else:
                    kept.append(b)
            out.append(" ".join(kept))
        return pd.Series(out, dtype=object)

    kept = doubt.join(starts, "row", "left").select("page_id", "url", uncovered("parts", "tokens", "lengths", "starts").alias("text"))
    certain = rows.where(F.col("tokens").isNull()).select("page_id", "url", F.coalesce("text", F.lit("")).alias("text"))
    return certain.unionByName(kept).withColumn("n_chars", F.length("text").cast("long"))
