"""Toxicity: a linear classifier that counterfactual pairs keep fair to groups.

Features are the distinct words of a text, their first four, five and six
characters, and whether two, or four, of its words share such a beginning. Labelled texts that mention a group are paired with themselves
after the identity terms are swapped for their counterparts; training adds to
the log loss a penalty on the squared score change between the two, so a
neutral mention of a group carries no weight of its own.

Only training is bounded (``max_rows`` labelled rows, the first by a hash of
doc_id; ``max_features`` features). Statistics of features come from a Spark
aggregation over that sample; scoring reads every text whole, in the tasks of
the scan, with the model's bounded table.

Defined results: null text counts as empty and gets the score of no feature;
an empty table gives an empty table; without labelled rows, or with one class,
every score is the share of label 1 (0 without rows); repeated rows are each
scored; an input column named ``score`` is replaced, others pass through.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize

MAX_ROWS = 20_000
MAX_FEATURES = 6_000
MIN_DOCS = 3
THRESHOLD = 0.3
FAIRNESS = 5.0
RIDGE = 0.2
PREFIXES = (4, 5, 6)
SHARED = (2, 4)
#: Standard errors that a feature's share of label 1 must lie from that of all texts.
SIGNIFICANT = 4.0
TRIM = ".,;:!?\"'()[]{}<>|*#%&$"

#: Identity terms: each set lists counterparts that may stand for one another.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("she", "he"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "deaf", "blind"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("frauen", "männer"), ("muslime", "christen", "juden"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
SWAP = {a: s[(i + 1) % len(s)] for s in IDENTITY for i, a in enumerate(s)}


def word_set(text: str | None) -> set[str]:
    """Distinct words of a text, lower case and without punctuation at their ends."""
    found = {w.strip(TRIM) for w in (text or "").lower().split()}
    found.discard("")
    return found


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n)]


def counted(counts: dict[str, int]) -> Iterator[str]:
    """The features for beginnings that so many words of a text share."""
    for f, n in counts.items():
        yield f
        for least in SHARED:
            if n >= least:
                yield f"{f}{least}"


def features(words: set[str]) -> set[str]:
    return set(counted(Counter(f for w in words for f in features_of(w))))


def swapped(words: set[str]) -> set[str]:
    """The words with every identity term replaced by its counterpart."""
    return {SWAP.get(w, w) for w in words}


@dataclass
class Model:
    weights: dict[str, float]
    bias: float

    def scorer(self):
        """Scores texts; remembers what a word adds, for a bounded number of words.

        A prefix counts once a text, so its weight is kept apart from the words'.
        """
        weights, known = self.weights, {}
        wanted = {f.rstrip("24") if "*" in f else f for f in weights}

        def score(text: str | None) -> float:
            hits: Counter[str] = Counter()
            for w in word_set(text):
                got = known.get(w)
                if got is None:
                    if len(known) > 300_000:
                        known.clear()
                    got = known[w] = tuple(f for f in features_of(w) if f in wanted)
                if got:
                    hits.update(got)
            total = self.bias + math.fsum(weights.get(f, 0.0) for f in counted(hits))
            return 1 / (1 + math.exp(-max(-40.0, min(40.0, total))))

        return score


def _fit(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, pairs: tuple, n_features: int, fairness: float, ridge: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam steps; ``pairs`` has the (row, col, sign) of feature changes."""
    n = len(y)
    prow, pcol, psign, n_pairs = pairs
    w = np.zeros(n_features)
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    b = math.log(p / (1 - p))
    v, vb, scale = np.zeros(n_features), 0.0, np.full(n_features, 0.0)
    scale_b = 0.0
    rate = 0.1
    for t in range(1, steps + 1):  # Adam: scales differ much between features
        z = b + np.bincount(rows, weights=w[cols], minlength=n)
        e = (1 / (1 + np.exp(-np.clip(z, -40, 40)))) - y
        g = np.bincount(cols, weights=e[rows], minlength=n_features) / n + ridge * w / n
        if n_pairs:
            change = np.bincount(prow, weights=psign * w[pcol], minlength=n_pairs)
            g += 2 * fairness * np.bincount(pcol, weights=psign * change[prow], minlength=n_features) / n_pairs
        gb = e.mean()
        v = 0.9 * v + 0.1 * g
        vb = 0.9 * vb + 0.1 * gb
        scale = 0.99 * scale + 0.01 * g * g
        scale_b = 0.99 * scale_b + 0.01 * gb * gb
        fix, fix2 = 1 - 0.9**t, 1 - 0.99**t
        step = rate * (1 - t / (steps + 1))
        w -= step * (v / fix) / (np.sqrt(scale / fix2) + 1e-8)
        b -= step * (vb / fix) / (math.sqrt(scale_b / fix2) + 1e-8)
    return w, float(b)


def train(
    labelled: DataFrame, max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES,
    fairness: float = FAIRNESS, ridge: float = RIDGE,
) -> Model:
    """Fit on at most ``max_rows`` of the rows of (doc_id, text, label), as ``labelled_sample`` chooses them."""
    rows = labelled_sample(labelled, labelled, max_rows)

    @F.pandas_udf("struct<own:array<string>,other:array<string>>")
    def extracted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            own, other = [], []
            for t in batch:
                words = word_set(t)
                own.append(sorted(features(words)))
                alt = swapped(words)
                other.append(sorted(features(alt)) if alt != words else None)
            yield pd.DataFrame({"own": own, "other": other})

    sample = rows.select("doc_id", "text", F.col("label").cast("double").alias("label"))
    sample = materialize(sample.withColumn("f", extracted("text")).select("doc_id", "label", "f"), "toxicity-features")
    total, positive = sample.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not total or not positive or positive == total:
        share = (positive or 0.0) / total if total else 0.0
        return Model({}, -40.0 if share == 0 else 40.0 if share == 1 else math.log(share / (1 - share)))
    p, q = positive / total, 1 - positive / total
    stats = sample.select("label", F.explode("f.own").alias("feature")).groupBy("feature").agg(
        F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")
    )
    # How far the share of label 1 among a feature's texts lies from that of all, in standard errors.
    n = F.col("a") + F.col("b")
    far = F.abs(F.col("a") - n * p) / F.sqrt(n * p * q)
    chosen = stats.where((n >= MIN_DOCS) & (far >= SIGNIFICANT)).orderBy(far.desc(), "feature").limit(max_features).select("feature").collect()
    names = sorted({r.feature for r in chosen} | {f for w in SWAP for f in features_of(w)})
    index = {f: i for i, f in enumerate(names)}

    @F.pandas_udf("struct<own:array<int>,other:array<int>>")
    def indexed(fs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in fs:
            of = lambda xs: None if xs is None else sorted(index[x] for x in xs if x in index)
            yield pd.DataFrame({"own": [of(x) for x in batch["own"]], "other": [of(x) for x in batch["other"]]})

    got = sample.select("doc_id", "label", indexed("f").alias("i")).orderBy("doc_id").collect()
    y = np.array([r.label for r in got])
    own = [np.array(r.i.own, dtype=np.int64) for r in got]
    row = np.repeat(np.arange(len(own)), [len(x) for x in own])
    col = np.concatenate(own) if own else np.array([], dtype=np.int64)
    prow, pcol, psign, k = [], [], [], 0
    for r in got:
        if r.i.other is not None:
            a, b = set(r.i.own), set(r.i.other)
            for cols, sign in ((a - b, 1.0), (b - a, -1.0)):
                prow += [k] * len(cols)
                pcol += sorted(cols)
                psign += [sign] * len(cols)
            k += 1
    pairs = (np.array(prow, dtype=np.int64), np.array(pcol, dtype=np.int64), np.array(psign), k)
    w, b = _fit(row, col, y, pairs, len(names), fairness, ridge)
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-4}, b)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """At most ``max_rows`` rows of (doc_id, text, label), the first by a hash of doc_id.

    The sample's ids have a fixed bound, so they are broadcast to the scan. Rows without an id or a label take no
    part; of two labels or two texts of one id the greater counts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    ids = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.max("text").alias("text")).select("doc_id", "text", "label")


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``score`` in [0, 1] to every row."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = model.scorer()
        for texts in batches:
            yield pd.Series([of(t) for t in texts], dtype="float64")

    return docs.withColumn("score", scored(F.col(text)))
