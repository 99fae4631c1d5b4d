"""Packing, mixing, top-k, line and near deduplication, the pipeline: edge cases and brute force."""

import itertools
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnframe.llm import line_dedup, mixing, near_dedup, packing, topk
from cairnframe.llm.components import components
from cairnframe.llm.queries_corpus import packed, tokenizer_paths

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, seed=0, n=60):
    rng = np.random.default_rng(seed)
    vocab = [f"word{i}" for i in range(400)]
    lines = lambda k: "\n".join(" ".join(rng.choice(vocab, 12)) for _ in range(k))
    base = [lines(8) for _ in range(6)]
    rows = []
    for i in range(n):
        t = lines(int(rng.integers(1, 9)))
        if i % 3 == 0:
            words = base[i % 6].split(" ")
            for j in rng.integers(0, len(words), int(rng.integers(0, 4))):
                words[j] = "changed"
            t = " ".join(words)
        rows.append((i, t, "en", ["s0", "s1", "s2", None][min(i % 5, 3)], len(t)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s1", 0), (n + 2, " \n ", "en", "s1", 3), (n + 3, "word1 " * 9000, "en", "s2", 1), (n + 4, rows[0][1], "en", "s0", 1)]
    return spark.createDataFrame(rows, DOCS)


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_paths()[0])
    docs = corpus(spark).unionByName(spark.createDataFrame([(900, "a <|endoftext|> b 日本語 ²x y \x1c z", "x", "s", 1)], DOCS))
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in packing.pack(docs, *tokenizer_paths()).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for r in docs.collect():
        ids = np.array(t.encode(r.text or "", add_special_tokens=False).ids + [0], dtype="<u4").tobytes()
        got = sorted(pieces[r.doc_id], key=lambda p: p.start)
        assert b"".join(bytes(p.ids) for p in got) == ids and [p.start for p in got] == list(itertools.accumulate([0] + [p.length for p in got]))[:-1]
    for s in sequences.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == list(itertools.accumulate([0] + [p.length for p in s]))[:-1] and sum(p.length for p in s) == s[0].sequence_length <= 1024
    total = sum(p.length for s in sequences.values() for p in s)
    padding = sum(0 if (n := s[0].sequence_length) & (n - 1) == 0 else 1024 - n for s in sequences.values())
    assert padding <= 0.02 * total
    r = packed(docs).first()
    assert 0 <= r.ids_crc32 < 2**32 and packed(empty(spark)).count() == 0
    assert zlib.crc32(b"") == 0 and packing.cuts(1) == [1] and sum(packing.cuts(5000)) == 5000


def test_mixing(spark):
    docs = corpus(spark, n=200)
    rows = mixing.mix(docs, block=16).collect()
    assert len(rows) == docs.count()
    by = defaultdict(lambda: [0, 0, 0])
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        by[r.source][0] += r.size
        by[r.source][1] += r.taken
        by[r.source][2] = r.target
    assert abs(sum(x[2] for x in by.values()) - sum(x[0] for x in by.values())) < 1e-6
    assert all(abs(x[1] - x[2]) <= 64 and x[2] <= 3 * x[0] for x in by.values())
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(docs.repartition(7), block=16).collect()))
    assert mixing.mix(empty(spark)).count() == 0
    taken = mixing.take(docs, mixing.mix(docs, block=16))
    assert taken.columns == docs.columns and taken.select(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0] == sum(r.taken for r in rows)


@pytest.mark.parametrize(("weights", "seats"), [([5, 3, 1], 9), ([53, 24, 23], 7), ([1, 1, 1, 1], 2), ([1000, 1], 5), ([0, 2], 3)])
def test_apportionment_by_quotients(spark, weights, seats):
    rows = spark.createDataFrame([(1, i, float(w), seats) for i, w in enumerate(weights)], "g int, i int, w double, seats long")
    got = {r.i: r.q for r in mixing.apportion(rows, ["g"], [F.col("i")], "w", "seats", "q").collect()}
    quotients = sorted(((-w / (2 * k + 1), i) for i, w in enumerate(weights) for k in range(seats) if w), key=lambda x: (x[0], x[1]))[:seats]
    assert got == {i: sum(1 for _, j in quotients if j == i) for i in range(len(weights))}


def test_top_k_by_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8) * (1 + i % 3)]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None] + [0.0] * 6), (302, [float("nan")] * 8), (303, [float("inf")] + [0.0] * 7), (304, rows[4][1]), (305, rows[4][1]), (50, rows[4][1])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in topk.top_k(v, v.where("vec_id % 50 = 0"), block=32, query_block=4).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    whole = [(i, np.floor(256 * np.array(x, dtype=np.float32).astype(float)).astype(int)) for i, x in rows if x and all(y is not None and np.isfinite(y) for y in x)]
    for i in {i for i, _ in whole if i % 50 == 0 and i != 50}:
        q = next(x for j, x in whole if j == i)
        best = sorted(((-int(q @ x), j) for j, x in whole if j != i))[:5]
        assert sorted(got[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    few = v.where("vec_id < 3")
    assert topk.top_k(few, few.where("vec_id = 0")).count() == 2
    assert topk.top_k(v.where("false"), v.where("false")).count() == 0


def removed_by_brute_force(rows):
    lines = sorted((r[0], i, frozenset(x.split())) for r in rows if r[0] is not None for i, x in enumerate((r[1] or "").split("\n")) if x.split())
    return {(d, i) for n, (d, i, s) in enumerate(lines) if any(similar(s, t) and (e, j) < (d, i) for e, j, t in lines[:n])}, lines


def test_top_k_broadcasts_no_copies_of_queries(spark):
    blocks = spark.createDataFrame([(4, b, 9.0, b"", b"") for b in range(50)], topk.BLOCK_SCHEMA)
    ready = spark.createDataFrame([(4, 9.0, b"", b"", b"", 0.0), (4, 1.0, b"", b"", b"", 80.0)], "dim int, q_top double, q_ids binary, q_vecs binary, least binary, low double")
    pairs = topk._pairs(ready, blocks, 8)
    assert pairs.count() == 50 and "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("dense", [2, 256])
def test_line_dedup_by_brute_force(spark, monkeypatch, dense):
    monkeypatch.setattr(line_dedup, "DENSE", dense)
    monkeypatch.setattr(line_dedup, "BUCKETS", 1 << 16 if dense > 2 else 1 << 4)
    docs = corpus(spark, seed=1)
    want, lines = removed_by_brute_force([(r.doc_id, r.text) for r in docs.collect()])
    got = {(r.doc_id, i) for r in line_dedup.removed_lines(docs).collect() for i in r.removed or []}
    assert got == want
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    for r in docs.collect():
        kept = "\n".join(x for i, x in enumerate(r.text.split("\n")) if (r.doc_id, i) not in want) if r.text is not None else None
        assert out[r.doc_id].text == kept


def test_line_dedup_of_long_lines_by_brute_force(spark):
    """Lines past the width of one parity, copies with few and with many changes, and one id with two texts."""
    rng = np.random.default_rng(11)
    vocab = [f"w{i}" for i in range(3000)]
    base = [list(rng.choice(vocab, n, replace=False)) for n in (60, 130, 260, 400)]
    texts = []
    for i in range(60):
        words = list(base[i % 4])
        for k in rng.integers(0, len(words), int(len(words) * (0.02 + 0.2 * rng.random()))):
            words[k] = f"new{i}x{k}"
        texts.append((i, " ".join(words) + "\nshared footer of all"))
    docs = spark.createDataFrame([*texts, (7, texts[3][1])], "doc_id long, text string")
    want, _ = removed_by_brute_force([(r.doc_id, r.text) for r in docs.collect()])
    assert {(r.doc_id, i) for r in line_dedup.removed_lines(docs).collect() for i in r.removed or []} == want
    with pytest.raises(ValueError, match="percent"):
        line_dedup.removed_lines(docs, percent=50)


def test_line_dedup_meets_in_passes_and_near_copies_seldom(spark, monkeypatch):
    for name, value in {"DENSE": 2, "ROWS": 40, "ROWS_LEAST": 1}.items():
        monkeypatch.setattr(line_dedup, name, value)
    base = [f"common{i}" for i in range(60)]
    texts = [" ".join([*base[: i % 7], f"own{i}", *base[i % 7 + 1 :]]) for i in range(24)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    with line_dedup.scratch(spark):
        first = line_dedup.lines_of(docs, line_dedup._levels(docs, "text")).withColumn("open", F.lit(True))
        frames = list(line_dedup._open_pairs(first, line_dedup._dense(first, 80), 80))
        made = [tuple(r)[:4] for f in frames for r in f.collect()]
    assert len(frames) > 2 and {(r[0], r[2]) for r in made} == {(a, b) for b in range(24) for a in range(b)}
    assert len(made) <= 4 * len(set(made))
    want = [[] if i == 0 else [0] for i in range(24)]
    assert [r.removed or [] for r in line_dedup.removed_lines(docs).orderBy("doc_id").collect()] == want


def test_line_dedup_edges(spark):
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    odd = spark.createDataFrame([(None, "a b", 1, "r"), (1, "a b", 1, "r"), (1, "a b", 1, "r"), (2, "b a\n\nnew", 1, "r")], "doc_id long, text string, n_lines int, removed string")
    got = sorted((repr(r.doc_id), r.text) for r in line_dedup.dedup_lines(odd).collect())
    assert got == [("1", "a b"), ("1", "a b"), ("2", "\nnew"), ("None", "a b")]


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


@pytest.mark.parametrize("near", [1, 5])
def test_near_dedup_by_brute_force(spark, monkeypatch, near):
    """With one neighbour a side, most links of a group come from the second look at dense regions."""
    monkeypatch.setattr(near_dedup, "NEAR", near)
    docs = corpus(spark, seed=2, n=120)
    sets = {r.doc_id: shingles(r.text, 4) for r in docs.collect()}
    top = {i: i for i in sets}
    find = lambda i: i if top[i] == i else find(top[i])
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and similar(sets[a], sets[b]):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, 4).collect()}
    assert got == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def test_near_dedup_among_dissimilar_neighbours(spark, monkeypatch):
    """Short texts of a common passage and own tails, among many longer ones of the same passage."""
    monkeypatch.setattr(near_dedup, "NEAR", 1)
    rng = np.random.default_rng(7)
    word = lambda n: " ".join(f"x{i}" for i in rng.integers(0, 1 << 40, n))
    passage = word(93)
    texts = [f"{passage} {word(50)}" for _ in range(1500)] + [f"{passage} {word(11)}" for _ in range(8)]
    order = rng.permutation(len(texts))
    docs = spark.createDataFrame([(int(i), t) for i, t in zip(order, texts, strict=True)], "doc_id long, text string")
    short = sorted(int(i) for i in order[1500:])
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs, 5).collect()}
    assert got == {i: short[0] if i in short else i for i in got}


def test_marks_limit_follows_the_threshold():
    assert near_dedup.most_unlike(100) == 0 and near_dedup.most_unlike(80) == 31 and near_dedup.most_unlike(50) > 31


def test_near_dedup_edges(spark):
    assert near_dedup.near_duplicates(empty(spark)).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (3, "A b"), (2, "a  B"), (2, "a  B"), (1, None), (0, "")], "doc_id long, text string")
    got = sorted((repr(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(odd).collect())
    assert got == [("0", 0, 0, True), ("1", 0, 1, True), ("2", 1, 2, True), ("2", 1, 2, True), ("3", 1, 2, False), ("None", 1, None, True)]
    assert sorted(map(repr, (r.doc_id for r in near_dedup.first_of_each(odd).collect()))) == ["0", "1", "2", "None"]


def test_near_dedup_of_one_id_with_two_texts(spark):
    """Both texts of document 1 link it."""
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    docs = spark.createDataFrame([(1, a), (1, b), (5, f"{a} z"), (6, f"{b} z")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs).collect())
    assert got == [(1, 1), (1, 1), (5, 1), (6, 1)]
    with pytest.raises(ValueError, match="percent"):
        near_dedup.near_duplicates(docs, percent=50)


def test_least_labels():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n, m = (int(x) for x in rng.integers(2, 40, 2))
        i, j = rng.integers(0, n, m), rng.integers(0, n, m)
        top = list(range(n))
        find = lambda x: x if top[x] == x else find(top[x])  # noqa: B023, E731
        for x, y in zip(i, j, strict=True):
            x, y = find(x), find(y)
            top[max(x, y)] = min(x, y)
        assert near_dedup.least_labels(np.arange(n), i, j).tolist() == [find(x) for x in range(n)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 201)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}


def test_pipeline_stages_by_brute_force(spark, tmp_path):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["quality rules", "line dedup", "MinHash near-dedup", "mixing", "packing"]
    docs = corpus(spark, seed=4, n=80)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    at = {}
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in cp.STAGES:
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / name.replace(" ", "-")))
        now = spark.read.parquet(str(tmp_path / name.replace(" ", "-")))
        at[name] = now.collect()
    good = [r for r in docs.collect() if len((r.text or "").split()) >= 20 and r.doc_id != 83]
    assert sorted(r.doc_id for r in at["quality rules"]) == sorted(r.doc_id for r in good)
    gone, _ = removed_by_brute_force([(r.doc_id, r.text) for r in good])
    texts = {r.doc_id: "\n".join(x for i, x in enumerate(r.text.split("\n")) if (r.doc_id, i) not in gone) for r in good}
    texts = {i: t for i, t in texts.items() if t.split()}
    assert {r.doc_id: (r.text, r.n_chars) for r in at["line dedup"]} == {i: (t, len(t)) for i, t in texts.items()}
    kept = {i for i in texts if not any(j < i and similar(shingles(texts[i], 5), shingles(texts[j], 5)) for j in texts)}
    assert {r.doc_id for r in at["MinHash near-dedup"]} == kept
    assert {r.doc_id for r in at["mixing"]} <= kept and all(r.text.split() for r in at["mixing"])
    assert sum(r.length for r in at["packing"]) == sum({(i, r.doc_id, r.doc_tokens, r.start): r.length for i, r in enumerate(at["packing"])}.values())
    assert sorted(map(repr, (r.doc_id for r in at["packing"] if r.start == 0))) == sorted(repr(r.doc_id) for r in at["mixing"])
    assert cp.run(spark, str(tmp_path)).count() == len(at["packing"])
