"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. Sketch. In the scan's tasks each text becomes its set of distinct word
   shingles (as 64-bit hashes), a hash of the whole set, and a signature of
   ``TREES`` x ``DEPTH`` MinHash values.
2. Classes. Documents with equal sets collapse to the least doc_id, so a group
   of exact copies, however large, goes on as one row.
3. Forest. Every class stands in ``TREES`` sorted orders, one for each run of
   ``DEPTH`` values. Neighbours that share the first ``ROOT`` values are
   candidates: every pair of a region of at most ``NEAR`` + 1 classes, and in a
   denser region, where longer common prefixes lie side by side, the ``NEAR``
   nearest on either side, so depth adapts to the region. These links come
   first; step 6 sees to the rest of a dense region.
4. Confirmation on full sets, in exact integers. A pair whose sizes cannot
   reach the threshold, or whose sketched similarity is more than five standard
   errors below it, is not read.
5. Components of the confirmed links.
6. Dense regions again. A neighbour limit can leave a link unseen there, so in
   every root with more classes than that, the classes outside the root's main
   component meet all of its classes, in blocks of two-bit marks. Components
   between which a pair could reach the threshold are then compared, in blocks
   and on full sets. No pair that shares a root is left out.

Defined results: a null, empty or blank text has an empty set, is linked with
nothing and is its own component; fewer words than a shingle count as one
shingle; rows with a null doc_id are linked with nothing and have a null
component; repeated rows are copies of each other; rows of one doc_id with
different texts are one document, linked by any of them; an empty table gives an
empty table. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, scratch
from .components import components

SHINGLE = 5
PERCENT = 80
TREES = 16
DEPTH = 6
ROOT = 3
NEAR = 5
#: Classes of a block in the second look at dense regions: of full sets, and of marks.
BLOCK = 256
MARKS_BLOCK = 2048

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes, with a bounded memory of words."""

    def __init__(self, shingle: int):
        self.shingle = shingle
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes know ASCII letters and blanks only
        if not words:
            return np.empty(0, np.uint64)
        if len(self.known) > 400_000:
            self.known.clear()
        known, of = self.known, xxhash.xxh64_intdigest
        for w in set(words).difference(known):
            known[w] = of(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.shingle, len(h))
        out = np.full(len(h) - k + 1, np.uint64(k))
        with np.errstate(over="ignore"):
            for i in range(k):
                out = _mixed(out * _MIX + h[i: len(h) - k + 1 + i])
        return np.unique(out)


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    n = TREES * DEPTH
    return rng.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash values of a set, as big-endian unsigned 32-bit numbers."""
    with np.errstate(over="ignore"):
        low = np.full(len(a), np.uint64(2**64 - 1))
        for at in range(0, len(shingles), 512):  # parts that stay in the cache
            part = shingles[at: at + 512, None] * a + b
            np.minimum(low, part.min(axis=0), out=low)
    return (_mixed(low) >> np.uint64(32)).astype(">u4")


def sketches(docs: DataFrame, text: str, doc_id: str, shingle: int) -> DataFrame:
    """doc_id, n (set size), set_hash and sig (both null for an empty set)."""

    @F.pandas_udf("struct<n:long,set_hash:binary,sig:binary,marks:binary>")
    def sketched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        of, (a, b) = Shingler(shingle), _permutations()
        for texts in batches:
            rows = []
            for t in texts:
                s = of(t)
                sig = signature(s, a, b).tobytes() if len(s) else None
                rows.append((len(s), xxhash.xxh128_digest(s.tobytes()), sig, _marks(sig)) if sig else (0, None, None, None))
            yield pd.DataFrame(rows, columns=["n", "set_hash", "sig", "marks"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), sketched(text).alias("s")).select("doc_id", "s.n", "s.set_hash", "s.sig", "s.marks")


def _marks(sig: bytes) -> bytes:
    """Two low bits of each signature value: enough to estimate a similarity."""
    low = (np.frombuffer(sig, ">u4") & np.uint32(3)).astype(np.uint8).reshape(-1, 4)
    return (low[:, 0] | low[:, 1] << 2 | low[:, 2] << 4 | low[:, 3] << 6).astype(np.uint8).tobytes()


_ODD = int.from_bytes(b"\x55" * (TREES * DEPTH // 4), "big")


def _unlike(x: int, y: int) -> int:
    """Number of values whose marks differ."""
    z = x ^ y
    return ((z | z >> 1) & _ODD).bit_count()


def most_unlike(percent: int) -> int:
    """Most of the signature's values whose two-bit marks may differ for a pair to be read.

    At 0.8 a value's marks differ with probability 0.15; five standard errors are added.
    """
    n, p = TREES * DEPTH, 0.75 * (100 - percent) / 100
    return int(n * p + 5 * (n * p * (1 - p)) ** 0.5)


def candidates(classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of neighbouring classes, and the members (a, region) of every dense root, in one table."""
    limit = most_unlike(percent)
    width, cut = 4 * DEPTH, 4 * ROOT
    rows = classes.select(
        F.col("doc_id").alias("node"), "n", "marks",
        F.posexplode(F.array(*[F.substring("sig", t * width + 1, width) for t in range(TREES)])).alias("tree", "order"),
    )

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        kept: list[tuple] = []  # the last rows of the region at the end of the batch before
        for batch in batches:
            now = kept + list(batch[["tree", "order", "node", "n", "marks"]].itertuples(index=False, name=None))
            roots = [(r[0], r[1][:cut]) for r in now]
            out, run = [], 0
            for i in range(1, len(now)):
                run = run + 1 if roots[i] == roots[i - 1] else 0
                if not run or i < len(kept):
                    continue
                _, _, node, n, marks = now[i]
                mine = int.from_bytes(marks, "big")
                for _, _, other, m, theirs in now[max(i - min(run, NEAR), 0): i]:
                    if 100 * min(n, m) >= percent * max(n, m) and node != other and _unlike(mine, int.from_bytes(theirs, "big")) <= limit:
                        out.append((min(node, other), max(node, other), None))
                if run > NEAR:
                    region = xxhash.xxh64_intdigest(bytes([roots[i][0]]) + roots[i][1]) - 2**63
                    # The first row past the limit tells that the ones before it are members too.
                    out += [(r[2], None, region) for r in (now[i - run: i + 1] if run == NEAR + 1 else now[i: i + 1])]
            kept = [r for r, root in zip(now[-NEAR - 1:], roots[-NEAR - 1:], strict=True) if root == roots[-1]]
            yield pd.DataFrame({c: pd.array([r[k] for r in out], dtype="Int64") for k, c in enumerate(("a", "b", "region"))})

    found = rows.repartition("tree", F.substring("order", 1, cut)).sortWithinPartitions("tree", "order", "node")
    return found.mapInPandas(task, "a long, b long, region long").distinct()


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def full_sets(docs: DataFrame, nodes: DataFrame, text: str, doc_id: str, shingle: int) -> DataFrame:
    """(node, shingles) for the classes in ``nodes``, from their texts; a repeated doc_id of two texts has two sets.

    Nodes grow with the corpus, so the texts meet them by a shuffle at any size.
    """

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = Shingler(shingle)
        for texts in batches:
            yield pd.Series([of(t).tobytes() for t in texts], dtype=object)

    rows = docs.select(F.col(doc_id).cast("long").alias("node"), F.col(text).alias("__text")).join(nodes.select("node").hint("merge"), "node", "left_semi")
    return rows.select("node", packed("__text").alias("shingles")).dropDuplicates(["node", "shingles"])


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), percent) for p, q in zip(x, y, strict=True)], dtype=bool)

    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").where(linked("x", "y")).select("a", "b")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per input row.

    ``percent`` is 60 at least: the trees' roots then still meet for 98 of 100 links, for all but none at 80.
    """
    if not 60 <= percent <= 100:
        raise ValueError("percent must be between 60 and 100")
    with scratch(docs.sparkSession):
        return materialize(_near_duplicates(docs, shingle, percent, text, doc_id), "near-found", keep=True)


def _near_duplicates(docs: DataFrame, shingle: int, percent: int, text: str, doc_id: str) -> DataFrame:
    rows = materialize(sketches(docs, text, doc_id, shingle), "near-sketches")
    usable = rows.where(F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull())
    classes = usable.groupBy("set_hash").agg(F.min(F.struct("doc_id", "n", "sig", "marks")).alias("c")).select("set_hash", "c.doc_id", "c.n", "c.sig", "c.marks")
    classes = materialize(classes, "near-classes")
    seen = materialize(candidates(classes, percent), "near-pairs")
    pairs = seen.where(F.col("b").isNotNull()).select("a", "b")
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = materialize(full_sets(docs, nodes, text, doc_id, shingle), "near-sets")
    links = materialize(confirm(pairs, sets, percent), "near-links")
    found = materialize(components(links), "near-components")
    members = seen.where(F.col("region").isNotNull()).select("region", F.col("a").alias("node"))
    if not members.isEmpty():
        open_ = materialize(undecided(members, found, classes, percent), "near-open")
        nodes = open_.select("node").distinct()
        if not nodes.isEmpty():
            sets = materialize(full_sets(docs, nodes, text, doc_id, shingle), "near-dense-sets")
            found = joined(found, materialize(apart(open_, sets, percent), "near-more"))
    known = classes.select("set_hash", F.col("doc_id").alias("node")).join(found, "node", "left").select(
        "set_hash", F.coalesce("component", "node").alias("component_id")
    )
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "set_hash").join(known, "set_hash", "left")
    component = F.when(F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def joined(found: DataFrame, more: DataFrame) -> DataFrame:
    """Components (node, component) after further links (a, b): only the components that they join are looked at."""
    ends = more.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    every = found.unionByName(ends.join(found, "node", "left_anti").select("node", F.col("node").alias("component")))
    of = lambda side: every.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    upper = components(more.join(of("a"), "a").join(of("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    above = upper.select(F.col("node").alias("component"), F.col("component").alias("top"))
    return every.join(above, "component", "left").select("node", F.coalesce("top", "component").alias("component"))


def undecided(members: DataFrame, found: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(region, node, component) of classes in dense roots between whose components a link is possible.

    ``members`` has the classes (region, node) of every dense root. A region of
    the result is a component of the possible links between components.
    """
    limit = most_unlike(percent)
    member = materialize(members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "near-members")
    marks = classes.select(F.col("doc_id").alias("node"), "n", F.col("marks").alias("data"))
    rows = materialize(parted(member, MARKS_BLOCK).join(marks.hint("merge"), "node"), "near-marks")

    def matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([p for r in batch.itertuples(index=False) for p in alike(r, percent, limit)], columns=["a", "b"])

    edges = materialize(block_pairs(rows, MARKS_BLOCK).mapInPandas(matched, "a long, b long").distinct(), "near-possible")
    region = components(edges).select(F.col("node").alias("component"), F.col("component").alias("region"))
    return member.select("node", "component").distinct().join(region, "component").select("region", "node", "component")


def apart(member: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between classes of a region (region, node, component) that lie in different components.

    Its classes outside its largest component are packed in blocks, and so are
    all its classes; a block of the first kind meets every block of the second
    kind, as rows of packed sets, and one link a class and component comes out.
    """
    full = parted(member, BLOCK).join(sets, "node").withColumn("n", F.expr("length(shingles) div 8")).withColumnRenamed("shingles", "data")

    def matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                out += block_links(r, percent)
            yield pd.DataFrame(out, columns=["a", "b"])

    return block_pairs(materialize(full, "near-dense"), BLOCK).mapInPandas(matched, "a long, b long")


def parted(member: DataFrame, block: int) -> DataFrame:
    """Members of regions of several components, dealt to about ``block`` a stripe; ``apart`` marks those outside the main component."""
    sizes = member.groupBy("region", "component").count()
    main = sizes.groupBy("region").agg(
        F.max(F.struct("count", "component")).alias("m"), F.count(F.lit(1)).alias("parts"), F.ceil(F.sum("count") / block).alias("stripes")
    ).where("parts > 1")
    return member.join(main.select("region", "stripes", F.col("m.component").alias("main")), "region").select(
        "region", "stripes", F.expr("pmod(xxhash64(node), stripes)").alias("stripe"), "node", "component", (F.col("component") != F.col("main")).alias("apart")
    )


def block_pairs(rows: DataFrame, size: int) -> DataFrame:
    """Every block of a region's classes apart beside every block of its classes; a large region is spread over its stripes."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: list[tuple] = []
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                if now and (now[0][:3] != row[:3] or len(now) == size):
                    out.append(block(now))
                    now = []
                now.append(row)
            yield pd.DataFrame(out, columns=["region", "stripes", "stripe", "nodes", "parts", "sizes", "sets"])
        if now:
            yield pd.DataFrame([block(now)], columns=["region", "stripes", "stripe", "nodes", "parts", "sizes", "sets"])

    def block(rows: list[tuple]) -> tuple:
        return (*rows[0][:3], *[np.array([r[k] for r in rows], dtype="<i8").tobytes() for k in (3, 4, 5)], b"".join(r[6] for r in rows))

    def packed(rows: DataFrame) -> DataFrame:
        dealt = rows.repartition("region", "stripe").sortWithinPartitions("region", "stripe", "node")
        return dealt.select("region", "stripes", "stripe", "node", "component", "n", "data").mapInPandas(
            task, "region long, stripes long, stripe long, nodes binary, parts binary, sizes binary, sets binary"
        )

    left = packed(rows.where("apart")).select(
        "region", F.explode(F.sequence(F.lit(0).cast("long"), F.col("stripes") - 1)).alias("stripe"), *[F.col(c).alias(f"{c}_1") for c in ("nodes", "parts", "sizes", "sets")]
    )
    return left.hint("merge").join(packed(rows), ["region", "stripe"])


def alike(r, percent: int, limit: int) -> list[tuple[int, int]]:
    """Pairs of components of two packed blocks of marks that a link may join: of every connected group of them a star, which connects the same."""
    of = lambda x: np.frombuffer(x, "<i8")
    p1, p2, s1, s2 = of(r.parts_1), of(r.parts), of(r.sizes_1), of(r.sizes)
    x, y = (np.frombuffer(m, np.uint8).reshape(-1, TREES * DEPTH // 4) for m in (r.sets_1, r.sets))
    x, y = (np.ascontiguousarray(m).view(np.uint64) for m in (x, y))
    names = np.unique(np.concatenate([p1, p2]))
    at1, at2, label = np.searchsorted(names, p1), np.searchsorted(names, p2), np.arange(len(names))
    odd = np.uint64(0x5555555555555555)
    for low in range(0, len(x), 256):
        part = slice(low, low + 256)
        unlike = np.zeros((len(x[part]), len(y)), np.uint16)
        for k in range(x.shape[1]):
            z = x[part, k, None] ^ y[None, :, k]
            unlike += np.bitwise_count((z | z >> np.uint64(1)) & odd)
        a, b = s1[part, None], s2[None, :]
        i, j = np.nonzero((unlike <= limit) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (p1[part, None] != p2[None, :]))
        label = least_labels(label, at1[part][i], at2[j])
    others = np.flatnonzero(label != np.arange(len(names)))
    return [(int(names[label[k]]), int(names[k])) for k in others]


def least_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each the least index of its group) after groups that the pairs (i, j) name are joined."""
    while True:
        u, v = label[i], label[j]
        differ = u != v
        if not differ.any():
            return label
        i, j = i[differ], j[differ]
        np.minimum.at(label, np.maximum(u, v)[differ], np.minimum(u, v)[differ])
        while (label[label] != label).any():
            label = label[label]


def block_links(r, percent: int) -> list[tuple[int, int]]:
    """Links between two packed blocks, of classes in different components.

    Common shingles are counted through one sorted list of both blocks' values.
    """
    of = lambda x: np.frombuffer(x, "<i8")
    n1, n2, p1, p2, s1, s2 = of(r.nodes_1), of(r.nodes), of(r.parts_1), of(r.parts), of(r.sizes_1), of(r.sizes)
    x, y = np.frombuffer(r.sets_1, np.uint64), np.frombuffer(r.sets, np.uint64)
    shared, xi, yi = np.intersect1d(np.unique(x), np.unique(y), assume_unique=True, return_indices=True)
    if not len(shared):
        return []
    del xi, yi
    common = np.zeros((len(n1), len(n2)), dtype=np.int32)

    def incidence(values: np.ndarray, sizes: np.ndarray, low: int, high: int) -> np.ndarray:
        owner = np.repeat(np.arange(len(sizes)), sizes)
        at = np.searchsorted(shared, values)
        at[at == len(shared)] = 0
        hit = (shared[at] == values) & (at >= low) & (at < high)
        m = np.zeros((len(sizes), high - low), dtype=np.float32)
        m[owner[hit], at[hit] - low] = 1
        return m

    for low in range(0, len(shared), 8192):
        high = min(low + 8192, len(shared))
        common += (incidence(x, s1, low, high) @ incidence(y, s2, low, high).T).astype(np.int32)
    ok = (100 * common >= percent * (s1[:, None] + s2[None, :] - common)) & (p1[:, None] != p2[None, :])
    # One link from a class to each component it meets joins the same components as all of them.
    links = {(int(n1[i]), int(p2[j])): int(n2[j]) for i, j in zip(*np.nonzero(ok), strict=True)}
    return [(i, j) for (i, _), j in links.items()]


def first_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One document of each group of near duplicates: that of the least id, once.

    Only ids are joined back; rows with a null id stay.
    """
    found = near_duplicates(docs, shingle, percent, text, doc_id)
    out = docs.join(found.where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct(), F.col(doc_id) == F.col("__gone"), "left_anti")
    again = found.where(F.col("kept") & F.col("doc_id").isNotNull()).groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return out
    # Repeated rows are rare; only they are told apart.
    repeated = out.join(again.select(F.col("doc_id").alias("__again")), F.col(doc_id) == F.col("__again"), "left_semi").dropDuplicates([doc_id])
    return out.join(again.select(F.col("doc_id").alias("__again")), F.col(doc_id) == F.col("__again"), "left_anti").unionByName(repeated)
