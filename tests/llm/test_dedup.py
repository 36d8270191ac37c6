"""Near-duplicate documents and vectors against brute force, and what tables may hold."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from stridelake.llm import embedding_dedup as E
from stridelake.llm import minhash_dedup as M
from stridelake.llm.graph import components


def words_of(text, width):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)])


def smallest(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(docs, width):
    sets = {d: words_of(t, width) for d, t in docs}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {d: (len(sets[d]), c) for d, c in smallest(list(sets), links).items()}


def corpus(seed, n=120):
    """Random texts, near copies at all distances, a passage in many documents, chains of edits, very long texts."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage, docs = text(40), []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not docs:
            w = text(rng.choice([1, 3, 5, 20, 60, 200]))
        elif kind in (1, 2, 3):
            w = list(docs[rng.randrange(len(docs))])
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                p = rng.randrange(len(w)) if w else 0
                w[p : p + rng.randint(0, 1)] = text(rng.randint(0, 2))
        elif kind == 4:
            w = passage + text(rng.choice([2, 8, 40]))
        else:
            w = text(2) * 30
        docs.append(w)
    docs.append(text(30_000))
    docs.append(docs[-1][:-5])
    return [(i * 7 % 1009, " ".join(w).upper() if i % 3 else "\n".join(w)) for i, w in enumerate(docs)]


@pytest.mark.parametrize("seed,options", [(0, {}), (1, {"block_rows": 4}), (2, {"block_shingles": 300}), (3, {"broadcast_rows": 0}), (4, {"block_rows": 3, "broadcast_rows": 0})])
def test_documents_match_brute_force(spark, seed, options):
    docs = corpus(seed)
    got = M.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=4, **options).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs, 4)
    assert len(got) == len(docs) and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_group_of_near_copies_in_small_blocks(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    docs = []
    for i in range(90):
        w = list(base)
        for k in range(rng.randint(0, 7)):
            w[rng.randrange(150)] = f"x{i}_{k}"
        docs.append((i, " ".join(w)))
    got = M.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width=4, block_rows=16).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs, 4)


def test_document_edge_cases(spark):
    rows = [(5, "a b c d e", 1), (3, "A  b\tc d e", 2), (3, "A  b\tc d e", 2), (7, None, 3), (8, "", 4), (9, " \n\x0b ", 5), (None, "a b c d e", 6), (10, "a b", 7), (11, "a b", 8), (12, "b a", 9), (13, "é\u00a0x", 9), (3, "other text of five words", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, x long").selectExpr("*", "x as rep", "x as hub", "x as sig")
    got = sorted(((r.doc_id is not None, r.doc_id, r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(df, width=4).collect()), key=str)
    assert (False, None, 2, None, True) in got and len(got) == len(rows)
    by = {}
    for _, d, n, c, k in got:
        by.setdefault(d, []).append((n, c, k))
    assert by[5] == [(2, 3, False)] and sorted(by[3]) == [(2, 3, True)] * 3
    assert by[7] == by[8][:0] + [(0, 7, True)] and by[8] == [(0, 8, True)] and by[9] == [(0, 9, True)]
    assert by[10] == [(1, 10, True)] and by[11] == [(1, 10, False)] and by[12] == [(1, 12, True)]
    assert M.near_duplicates(df.where("false")).collect() == []
    kept = M.drop_near_duplicates(df, width=4)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["10", "12", "13", "3", "3", "3", "7", "8", "9", "None"]


def test_shingle_hashes_follow_words():
    rng = random.Random(0)
    for _ in range(300):
        text = "".join(rng.choice("abAB \n\t\x0b\x1cé ") for _ in range(rng.randint(0, 60)))
        assert len(M.shingle_set(text.encode(), 3)) == len(words_of(text, 3))
    a, b = b"the quick brown fox jumps", b"fox jumps over the quick brown fox jumps"
    assert set(M.shingle_set(a, 3)) <= set(M.shingle_set(b, 3))


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 300)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    df = spark.createDataFrame([*edges, (None, 3), (3, None)], "a long, b long")
    want = smallest({x for e in edges if e[0] != e[1] for x in e}, edges[:-1])
    want = {k: v for k, v in want.items()}
    assert {r.node: r.component for r in components(df, "a", "b").collect()} == want
    assert components(df.where("false"), "a", "b").collect() == []


def vectors(seed, n=150, dim=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    v = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.1, 0.2], size=(n, 1))
    v[10] = v[3] * 4.0
    v[20] = v[3]
    v[21] = v[3]
    v[30] = -v[3]
    return v


@pytest.mark.parametrize("seed,options", [(0, {}), (1, {"cell_rows": 10}), (2, {"cell_rows": 5, "lead": 3, "group": 4}), (3, {"cell_rows": 20, "sample": 40})])
def test_vectors_match_brute_force(spark, seed, options):
    v = vectors(seed)
    ids = [int(x) for x in np.random.default_rng(seed).permutation(1000)[: len(v)]]
    df = spark.createDataFrame([(i, list(map(float, x))) for i, x in zip(ids, v)], "vec_id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    comp = smallest(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(link))])
    want = {i: (int(link[k].sum()), comp[i]) for k, i in enumerate(ids)}
    got = E.near_duplicates(df, **options).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want and all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vector_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 0.0]), (8, []), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0]), (10, [1e-300, 0.0]), (11, [1e300, -0.0]), (12, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "vec_id as k", "vec_id as rep", "1 as n_links")
    got = {}
    for r in E.near_duplicates(df).collect():
        got.setdefault(r.vec_id, []).append((r.n_links, r.component_id, r.kept))
    assert got[1] == [(4, 1, True)] * 2 and got[2] == [(4, 1, False)] and got[10] == [(4, 1, False)] and got[11] == [(4, 1, False)]
    for i in (3, 4, 5, 6, 7, 8, 9, 12):
        assert got[i] == [(0, i, True)]
    assert got[None] == [(0, None, True)]
    assert E.near_duplicates(df.where("false")).collect() == [] and len(E.near_duplicates(df.where("vec_id = 3")).collect()) == 1


def test_tiles_stop_early_and_miss_nothing():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 32))
    x[30:] = x[:30] + rng.normal(size=(30, 32)) * 0.05
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    value, axes = np.linalg.eigh(u.T @ u)
    axes = axes[:, ::-1]
    t = E._Tile(np.arange(60), np.ones(60, int), u, axes, [8, 16, 32])
    i, j = E.compare(t, t, [8, 16, 32], 0.95)
    assert sorted(zip(i, j)) == sorted(zip(*np.nonzero(u @ u.T >= 0.95)))
    assert pa.array(i).null_count == 0
