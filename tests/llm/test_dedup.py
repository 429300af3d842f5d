"""Near-duplicate texts and embeddings, and their components, against brute force."""

import re

import numpy as np
import pytest

from ostinato.llm import embedding_dedup, setsketch_dedup
from ostinato.llm.common import connected_components


def components(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(20)] + [(7, 7), (300, 200), (None, 5), (200, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = components({x for e in edges for x in e if x is not None}, [e for e in edges if None not in e])
    assert got == {k: v for k, v in want.items()}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute(texts):
    sets = {}
    for i, t in texts.items():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    return sets, components(sets, links)


def check(spark, texts):
    rows = spark.createDataFrame([(i, t, 1, 2) for i, t in texts.items()], "doc_id long, text string, component_id int, kept int")
    got = {r.doc_id: r for r in setsketch_dedup.near_duplicates(rows).collect()}
    sets, want = brute(texts)
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_near_copies_chains_and_odd_texts(spark):
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(500)]
    texts = {0: None, 1: "", 2: " \n ", 3: "one two", 4: "ONE\ttwo", 5: "one two three", 6: "É é", 7: "é É"}
    for base in range(12):
        words = rng.choice(vocab, 120).tolist()
        for copy in range(6):
            texts[100 + 10 * base + copy] = " ".join(words)
            words = list(words)
            for _ in range(1 + base // 4):
                words[rng.integers(0, 120)] = "edit"
    texts[50] = texts[100].upper()
    check(spark, texts)


def test_a_hot_group_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(setsketch_dedup, "BLOCK", 16)
    rng = np.random.default_rng(8)
    vocab = [f"w{i}" for i in range(400)]
    base = rng.choice(vocab, 150).tolist()
    texts = {}
    for i in range(90):
        words = list(base)
        for _ in range(2):
            words[rng.integers(0, 150)] = f"x{i}"
        texts[i] = " ".join(words)
    check(spark, texts)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, "a b c d e f g"), (1, "other words are under this id")]
    got = setsketch_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("1", "1", True)] * 3 + [("2", "1", False), ("None", "None", True)]
    assert setsketch_dedup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64))
    a, b = x[:2400], x[600:]
    s = setsketch_dedup.sketch([a, b, x, x[:0]])
    assert (np.maximum(s[0], s[1]) == s[2]).all() and (s[3] == 0).all()
    got = setsketch_dedup.likely_jaccard((s[0] > s[1]).sum(), (s[0] < s[1]).sum(), len(a), len(b))
    assert got == pytest.approx(len(np.intersect1d(a, b)) / len(x), abs=0.12)


def test_texts_hash_alike_in_any_batch(monkeypatch):
    texts = ["a b c d e f", "", None, "x y", "A B c d e f", "long " * 500]
    whole = setsketch_dedup.shingle_sets(texts)
    monkeypatch.setattr(setsketch_dedup, "_TEXT_BYTES", 8)
    for one, other in zip(whole, setsketch_dedup.shingle_sets(texts), strict=True):
        assert (one == other).all()
    assert (whole[0] == whole[4]).all() and [len(s) for s in whole] == [2, 0, 0, 1, 2, 1]


@pytest.mark.parametrize("block", [2048, 8])
def test_embeddings_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((120, 24))
    x = np.concatenate([x, x[:40] + 0.1 * rng.standard_normal((40, 24)), np.repeat(x[5:6], 30, axis=0) + 0.02 * rng.standard_normal((30, 24)), x[7:9], 3 * x[9:10]])
    rows = [(i, v.tolist(), "x") for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 24, [None] + [1.0] * 23, [float("nan")] * 24, [float("inf")] * 24, x[0].tolist()[:12]]
    rows += [(900 + i, v, "x") for i, v in enumerate(odd)]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, kept string")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    want = components([i for i, _, _ in rows], np.argwhere(near).tolist())
    assert {i: r.n_links for i, r in got.items()} == {i: int(near[i].sum()) if i < len(x) else 0 for i, _, _ in rows}
    assert {i: r.component_id for i, r in got.items()} == want and all(r.kept == (r.component_id == i) for i, r in got.items())


def test_no_embeddings(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
