"""Exact top-k inner products over norm-sorted vectors in SVD-rotated coordinates.

Vectors become integers, floor(scale * x), and are range-partitioned by
descending length; each run of ``BLOCK`` of them is one candidate block with
its greatest length. The rotation is the eigenbasis of the summed Gram matrix
(dimension squared, whatever the number of rows), so leading coordinates carry
most of each product.

Queries are packed into blocks too. The longest vectors, the head block, give
every query a first k-th score. A pair of query and candidate block is then
formed only where length times length (Cauchy-Schwarz) can still reach that
score; within it, the product over the leading coordinates plus the product of
the residual lengths bounds each score, and only pairs that may still enter
are scored, exactly, in integers. Bounds carry a slack for rounding.

Each query block meets each candidate block that survives: that is the stated
query set against all rows, in blocks. Candidate blocks are dealt into at most
``STRIPES`` stripes that every query block is sent to, so what is shuffled grows
with the rows; nothing of it is broadcast. What comes back is k rows for each
query and block.

Defined results: vectors that are null, or hold a null or a non-finite
component, take no part; ties go to the smaller id; with fewer than k
candidates all are returned; repeated ids are separate candidates, and rows
with the query's own id never are; an empty table gives an empty table;
vectors of another length than the query's take no part against it. Scores
must stay below 2**63.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import materialize

K = 5
SCALE = 256
#: Rows of a candidate block and of a query block.
BLOCK = 4096
QUERIES = 256
#: Candidate blocks of a stripe, on average.
STRIPE = 2
#: Stripes at most: copies of a query block, and tasks that share the work of a dimension.
STRIPES = 64
#: Share of the coordinates in the first partial sum.
LEADING = 0.25
#: Products below this are exact in float64.
EXACT = 2.0**53
BLOCK_SCHEMA = "dim int, block long, top double, ids binary, vecs binary"
FOUND = "query_id long, vec_id long, score long"


def usable(rows: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """vec_id, integer vector v, its length and dimension, for vectors that take part."""
    x = F.col(vector)
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale))
    ok = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return rows.where(F.coalesce(ok, F.lit(False)) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v")
    ).withColumns({
        "dim": F.size("v"), "norm": F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))),
    })


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows, in their partitions' order, as blocks of at most ``size`` vectors of one dimension."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        first, n = TaskContext.get().partitionId() << 33, 0
        held: dict[int, list] = {}

        def block(dim: int, part: pd.DataFrame) -> pd.DataFrame:
            nonlocal n
            n += 1
            return pd.DataFrame([{
                "dim": dim, "block": first + n - 1, "top": float(part["norm"].max()),
                "ids": part["vec_id"].to_numpy("<i8").tobytes(), "vecs": np.stack(part["v"].to_list()).astype("<i8").tobytes(),
            }])

        for batch in batches:
            for dim, part in batch.groupby("dim"):
                have = held.get(dim)
                have = part if have is None else pd.concat([have, part])
                while len(have) >= size:
                    yield block(dim, have.iloc[:size])
                    have = have.iloc[size:]
                held[dim] = have
        for dim, have in held.items():
            if len(have):
                yield block(dim, have)

    return rows.mapInPandas(task, BLOCK_SCHEMA)


def gram(rows: DataFrame) -> dict[int, np.ndarray]:
    """Sum of outer products for each dimension that occurs: one small matrix a task and dimension."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                m = np.stack(part["v"].to_list()).astype(float)
                sums[dim] = sums.get(dim, 0) + m.T @ m
        yield from (pd.DataFrame({"dim": [d], "g": [g.ravel()]}) for d, g in sums.items())

    parts = rows.select("v", "dim").mapInPandas(task, "dim int, g array<double>")
    cells = parts.select("dim", F.posexplode("g")).groupBy("dim", "pos").agg(F.sum("col").alias("x"))
    out: dict[int, np.ndarray] = {}
    for r in cells.collect():
        out.setdefault(r.dim, np.zeros(r.dim * r.dim))[r.pos] = r.x
    return {d: g.reshape(d, d) for d, g in out.items()}


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.nonzero(scores >= cut)[0]
        return at[np.lexsort((ids[at], -scores[at]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def match(q: np.ndarray, q_ids: np.ndarray, least: np.ndarray, c: np.ndarray, c_ids: np.ndarray, basis: np.ndarray, k: int) -> list[tuple]:
    """(query, vec, score) of each query's k best in a block that may reach ``least``."""
    lead = max(1, int(q.shape[1] * LEADING))
    qf, cf = q.astype(float), c.astype(float)
    qn, cn = np.linalg.norm(qf, axis=1), np.linalg.norm(cf, axis=1)
    exact = qn.max(initial=0) * cn.max(initial=0) < EXACT / 4
    qr, cr = qf @ basis, cf @ basis
    rest = lambda n, r: np.sqrt(np.maximum(n**2 - (r[:, :lead] ** 2).sum(1), 0))
    bound = qr[:, :lead] @ cr[:, :lead].T + np.outer(rest(qn, qr), rest(cn, cr))
    bound += 1e-9 * np.outer(qn, cn) + 1e-6
    may = bound >= least[:, None]
    share = may.mean() if may.size else 0.0
    full = (qf @ cf.T if exact else q @ c.T) if share > 0.2 else None
    out = []
    for i in np.nonzero(may.any(axis=1))[0]:
        at = np.nonzero(may[i] & (c_ids != q_ids[i]))[0]
        if not len(at):
            continue
        s = full[i, at] if full is not None else (cf[at] @ qf[i] if exact else c[at] @ q[i])
        s = s.astype(np.int64)
        out += [(int(q_ids[i]), int(c_ids[at[j]]), int(s[j])) for j in _best(s, c_ids[at], k)]
    return out


def _pairs(ready: DataFrame, blocks: DataFrame, stripes: int) -> DataFrame:
    """Query blocks with the candidate blocks of their dimension that lengths do not rule out.

    A copy of each query block goes to every stripe, so the pairs of one dimension
    spread over many tasks. The copies are as many times the queries as there are
    stripes, which a table's size does not show: the join must not broadcast them.
    """
    stripes = max(1, stripes)
    striped = blocks.withColumn("stripe", F.pmod(F.xxhash64("block"), F.lit(stripes)).cast("int"))
    ready = ready.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    reach = F.col("q_top") * F.col("top") * (1 + 1e-9) + 1e-6 >= F.col("low")
    met = (ready["dim"] == striped["dim"]) & (ready["stripe"] == striped["stripe"]) & reach
    return ready.hint("merge").join(striped.hint("merge"), met).drop(striped["dim"], striped["stripe"])


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding",
    block: int = BLOCK, query_block: int = QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest inner products."""
    rows = materialize(usable(vectors, vec_id, vector, scale), "topk-vectors")
    asked = materialize(usable(queries, vec_id, vector, scale), "topk-queries")
    bases = {d: np.linalg.eigh(g)[1][:, ::-1].copy() for d, g in gram(rows).items()}

    blocks = materialize(_packed(rows.repartitionByRange(F.col("norm").desc(), "vec_id").sortWithinPartitions(F.col("norm").desc(), "vec_id"), block), "topk-blocks")
    packed = _packed(asked.repartition("vec_id"), query_block)
    # The longest vectors of each dimension, one block each: their size is fixed.
    tops = blocks.groupBy("dim").agg(F.max(F.struct("top", (-F.col("block")).alias("b"))).alias("m")).select("dim", (-F.col("m.b")).alias("block"))
    head = {r.dim: (np.frombuffer(r.ids, "<i8"), np.frombuffer(r.vecs, "<i8").reshape(-1, r.dim)) for r in blocks.join(F.broadcast(tops), ["dim", "block"], "left_semi").collect()}

    def seeded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            least = []
            for r in batch.itertuples():
                q_ids, q = np.frombuffer(r.ids, "<i8"), np.frombuffer(r.vecs, "<i8").reshape(-1, r.dim)
                low = np.full(len(q), -np.inf)
                if r.dim in head:
                    c_ids, c = head[r.dim]
                    for i in range(len(q)):
                        s = (c[c_ids != q_ids[i]].astype(float) @ q[i].astype(float))
                        if len(s) >= k:
                            low[i] = np.partition(s, len(s) - k)[len(s) - k]
                least.append(low.tobytes())
            yield batch.assign(least=least, low=[float(np.frombuffer(x).min()) for x in least])

    ready = materialize(packed.mapInPandas(seeded, f"{BLOCK_SCHEMA}, least binary, low double"), "topk-ready").select(
        F.col("dim"), F.col("top").alias("q_top"), F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"), "least", "low"
    )
    pairs = _pairs(ready, blocks, min(STRIPES, math.ceil(blocks.count() / STRIPE)))

    def matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for r in batch.itertuples():
                of = lambda x: np.frombuffer(x, "<i8")  # noqa: B023, E731
                found += match(of(r.q_vecs).reshape(-1, r.dim), of(r.q_ids), np.frombuffer(r.least), of(r.vecs).reshape(-1, r.dim), of(r.ids), bases[r.dim], k)
            yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        pairs.mapInPandas(matched, FOUND)
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
