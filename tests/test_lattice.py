"""Decoding in blocks against plain versions and all paths of short sequences."""

import itertools

import numpy as np
import pytest

from ostinato.operators import decode, joint
from ostinato.operators import lattice as L


def rows_of(spark, sequences):
    rows = [(None if k == 0 else k, t, [int(x) for x in lab], [float(x) for x in sc]) for k, seq in enumerate(sequences) for t, (lab, sc) in enumerate(seq)]
    return spark.createDataFrame(rows, "song long, t int, labels array<int>, scores array<double>").repartition(3)


def random_sequences(rng, lengths, states, ties=False):
    out = []
    for n in lengths:
        seq = []
        for _ in range(n):
            lab = rng.permutation(states)[: rng.integers(2, states + 1)]
            seq.append((lab, rng.integers(-3, 1, len(lab)) if ties else rng.normal(size=len(lab))))
        out.append(seq)
    return out


def all_paths(seq, t, first, last):
    for path in itertools.product(*(range(len(lab)) for lab, _ in seq)):
        s = first[seq[0][0][path[0]]] + last[seq[-1][0][path[-1]]]
        for k, (lab, sc) in enumerate(seq):
            s += sc[path[k]] + (t[seq[k - 1][0][path[k - 1]], lab[path[k]]] if k else 0)
        yield s, path


@pytest.mark.parametrize("block", [2, 3, 100])
def test_paths_and_marginals_are_those_of_all_paths(spark, block):
    rng = np.random.default_rng(block)
    sequences = random_sequences(rng, [1, 2, 5, 6, 7], 4)
    t, first, last = rng.normal(size=(4, 4)), rng.normal(size=4), rng.normal(size=4)
    t[1, 2] = -np.inf
    steps = L.Steps(t, first, last)
    d = rows_of(spark, sequences)
    best = {(r.song, r.t): (r.choice, r.log_score) for r in L.best_paths(d, ["song"], ["t"], steps, "labels", "scores", block).collect()}
    share = {(r.song, r.t): r.marginals for r in L.marginals(d, ["song"], ["t"], steps, "labels", "scores", block).collect()}
    assert len(best) == len(share) == 21
    for k, seq in enumerate(sequences):
        song = None if k == 0 else k
        paths = list(all_paths(seq, t, first, last))
        score, path = max(paths, key=lambda x: x[0])
        assert [best[song, i][0] for i in range(len(seq))] == list(path)
        assert abs(best[song, 0][1] - score) < 1e-6
        p = np.exp([s for s, _ in paths])
        for i, (lab, _) in enumerate(seq):
            want = [p[[x[i] == j for _, x in paths]].sum() / p.sum() for j in range(len(lab))]
            assert np.allclose(share[song, i], want, atol=1e-9)


@pytest.mark.parametrize("block", [2, 1024])
def test_equal_paths_are_chosen_alike_in_blocks(spark, block):
    rng = np.random.default_rng(5)
    t, first = rng.integers(-2, 1, (3, 3)).astype(float), np.zeros(3)
    e = {k: rng.integers(-2, 1, (n, 3)).astype(float) for k, n in ((1, 40), (2, 1), (3, 77))}
    d = rows_of(spark, [[], *([([0, 1, 2], x) for x in e[k]] for k in (1, 2, 3))])
    got = {(r.song, r.t): r.choice for r in L.best_paths(d, ["song"], ["t"], L.Steps(t, first), "labels", "scores", block).collect()}
    for k, x in e.items():
        path, _ = decode.best_path(x, t, first)
        assert [got[k, i] for i in range(len(x))] == path.tolist()


def test_long_sequence_is_dealt_out(spark):
    n = 20_000
    d = spark.range(n).selectExpr("1L as song", "id as t", "array(cast(sin(id / 50) as double), cast(-sin(id / 50) as double)) as e")
    out = decode.viterbi(d, ["song"], "t", "e", [[-0.1, -3.0], [-3.0, -0.1]], [0.0, 0.0]).orderBy("t").toPandas()
    t = np.arange(n)
    path, score = decode.best_path(np.stack([np.sin(t / 50), -np.sin(t / 50)], axis=1), np.array([[-0.1, -3.0], [-3.0, -0.1]]), np.zeros(2))
    assert out.state.tolist() == path.tolist() and abs(out.log_score[0] - score) < 1e-4


@pytest.mark.parametrize("transition", [None, [[-1.0, 0.3, -0.2], [0.1, -2.0, 0.0], [-0.4, 0.2, -0.7]]])
def test_timed_paths_equal_the_plain_version(spark, transition):
    rng = np.random.default_rng(9)
    lengths = rng.normal(size=(3, 4))
    songs = {k: rng.normal(size=(n, 3)) for k, n in ((1, 3), (2, 30), (3, 1))}
    d = spark.createDataFrame([(k, i, x.tolist()) for k, e in songs.items() for i, x in enumerate(e)], "song long, t int, e array<double>")
    rows = decode.semi_markov(d, ["song"], "t", "e", lengths.tolist(), transition=transition).collect()
    for k, e in songs.items():
        if transition is None:
            want = decode.best_segments(e, lengths)
        else:
            want, score = decode.best_timed_path(e, np.array(transition), np.zeros(3), lengths)
            assert all(abs(r.log_score - score) < 1e-6 for r in rows if r.song == k)
        assert [(r.start, r.end, r.state) for r in sorted((r for r in rows if r.song == k), key=lambda r: r.segment)] == want


def test_timed_paths_of_many_songs_are_cut_after_one_sort(spark, monkeypatch):
    """Songs of moderate length are neither cut into blocks nor grouped, and their rows are sorted once to be walked, once to be cut into segments."""
    monkeypatch.setattr(L, "run_blocks", None)
    rng = np.random.default_rng(4)
    lengths, step = rng.normal(size=(2, 3)), rng.normal(size=(2, 2))
    songs = {None if k == 0 else k: rng.normal(size=(1 + k % 9, 2)) for k in range(60)}
    d = spark.createDataFrame([(k, i, x.tolist()) for k, e in songs.items() for i, x in enumerate(e)], "song long, t int, e array<double>").repartition(3)
    out = decode.semi_markov(d, ["song"], "t", "e", lengths.tolist(), transition=step.tolist())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 2 and not any(x in plan for x in ("Join", "InPandas"))
    got = {}
    for r in out.collect():
        got.setdefault(r.song, []).append((r.segment, r.start, r.end, r.state, r.log_score))
    assert got.keys() == songs.keys()
    for k, e in songs.items():
        number, start, end, state, score = zip(*sorted(got[k]), strict=True)
        assert number == tuple(range(len(number))) and start == (0, *end[:-1]) and end[-1] == len(e)
        found = sum(e[a:z, s].sum() + lengths[s, z - a - 1] for a, z, s in zip(start, end, state, strict=True)) + sum(step[s, t] for s, t in itertools.pairwise(state))
        best = decode.best_timed_path(e, step, np.zeros(2), lengths)[1]  # of equal segmentations the plain version may take another
        assert abs(found - best) < 1e-6 and all(abs(x - best) < 1e-6 for x in score)


def test_no_segmentation_raises(spark):
    d = spark.createDataFrame([(1, t, [0.0]) for t in range(3)], "song long, t int, e array<double>")
    with pytest.raises(Exception, match="no segmentation"):
        decode.semi_markov(d, ["song"], "t", "e", [[float("-inf"), 0.0]]).collect()


def plain_joint(segs, prior, k, weight):
    """Best path and marginals by all paths; segments are dicts."""
    fam = [0, 1, 0, 2, 2]
    norm = [[x / sum(s["p"]) if sum(s["p"]) > 1e-9 else 1 / 12 for x in s["p"]] for s in segs]
    cand = []
    for s, p in zip(segs, norm, strict=True):
        c = sorted(range(12), key=lambda r: (-p[r], -r))[:k]
        if s.get("clamp_root") is not None and s["clamp_root"] not in c:
            c.append(s["clamp_root"])
        cand.append(c)
    groups = {}
    for i, s in enumerate(segs):
        if s.get("tie") is not None:
            groups.setdefault(s["tie"], []).append(i)
    for g in groups.values():
        union = sorted({r for i in g for r in cand[i]})
        for i in g:
            cand[i] = union
    scores = []
    for s, p, c in zip(segs, norm, cand, strict=True):
        row = []
        for r in c:
            q = list(s["logp"][r])
            g = s["greedy"][r]
            if g is not None and int(np.argmax(q)) != g:
                q[g] = max(q) + 1e-3
            for j in range(5):
                clamp = s["clamp_bonus"] if s.get("clamp_root") == r and s.get("clamp_class") in (None, j) else 0.0
                row.append(np.log(max(p[r], 1e-12)) + q[j] + clamp)
        scores.append(np.array(row))
    for g in groups.values():
        total = sum(scores[i] for i in g)
        for i in g:
            scores[i] = total
    lab = [[(r - s["tonic"]) % 12 * 5 + f for r in c for f in fam] for s, c in zip(segs, cand, strict=True)]
    paths = list(all_paths(list(zip(lab, scores, strict=True)), weight * prior, np.zeros(60), np.zeros(60)))
    path = list(max(paths, key=lambda x: x[0])[1])
    w = np.exp(np.array([s for s, _ in paths]) - max(s for s, _ in paths))
    picks = np.array([x for _, x in paths])
    marg = [np.bincount(picks[:, i], weights=w, minlength=len(scores[i])) / w.sum() for i in range(len(segs))]
    for g in groups.values():
        for i in g:
            path[i] = int(scores[i].argmax())
    return [(cand[i][path[i] // 5], path[i] % 5, marg[i]) for i in range(len(segs))]


@pytest.mark.parametrize("case", ["plain", "clamped", "tied", "local"])
def test_joint_decode_is_that_of_all_paths(spark, case):
    rng = np.random.default_rng(11)
    prior = np.log(rng.dirichlet(np.ones(60), 60))
    songs = {}
    for song, n in ((1, 3), (2, 4)):
        songs[song] = [
            {
                "p": [0.0] * 12 if case == "plain" and i == 1 else rng.dirichlet(np.ones(12)).tolist(), "logp": np.log(rng.dirichlet(np.ones(5), 12)).tolist(), "greedy": [None if r % 4 == 0 else int(rng.integers(5)) for r in range(12)],
                "tonic": int(rng.integers(12)) if case == "local" else 3, "clamp_root": 7 if case == "clamped" and i == 1 else None, "clamp_class": 2 if case == "clamped" and song == 1 and i == 1 else None, "clamp_bonus": 40.0, "tie": 5 if case == "tied" and i in (0, 2) else None,
            }
            for i in range(n)
        ]
    d = spark.createDataFrame(
        [(k, i, s["p"], s["logp"], s["greedy"], s["tonic"], s["clamp_root"], s["clamp_class"], s["tie"]) for k, segs in songs.items() for i, s in enumerate(segs)],
        "song long, seg int, posterior array<double>, class_logp array<array<double>>, greedy array<int>, tonic int, clamp_root int, clamp_class int, tie long",
    )
    got = {(r.song, r.seg): r for r in joint.joint_decode(d, ["song"], ["seg"], prior.tolist(), k=2).collect()}
    for k, segs in songs.items():
        for i, (root, kind, marg) in enumerate(plain_joint(segs, prior, 2, 1.0)):
            r = got[k, i]
            assert (r.root, r["class"]) == (root, kind) and np.allclose(r.marginals, marg, atol=1e-9)
            assert abs(r.confidence - r.marginals[r.roots.index(root) * 5 + kind]) < 1e-12
    if case == "clamped":
        assert got[1, 1].root == 7 and got[1, 1]["class"] == 2 and got[2, 1].root == 7


def test_short_sequences_are_walked_side_by_side(spark):
    """No groups, joins or stored tables for sequences of moderate length, and the same results as in blocks."""
    rng = np.random.default_rng(9)
    rows = [(s, i, int(n), [int(x) for x in rng.integers(0, 4, n)], [float(x) for x in rng.normal(size=n)]) for s in range(40) for i in range(1 + s % 7) for n in [rng.integers(1, 5)]]
    d = spark.createDataFrame(rows, "song long, i int, size int, l array<int>, e array<double>")
    steps = L.Steps(rng.normal(size=(4, 4)), rng.normal(size=4), rng.normal(size=4))
    out = L.solved(d, ["song"], ["i"], steps, "l", "e", ["size"], shares=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Join", "InPandas"))
    mixed = {(r.song, r.i): r for r in L.solved(d, ["song"], ["i"], steps, "l", "e", ["size"], shares=True, block=3).collect()}
    got = {(r.song, r.i): r for r in out.collect()}
    assert got.keys() == mixed.keys() == {(s, i) for s, i, *_ in rows}
    for k, r in got.items():
        assert (r.choice, r.log_score, r["size"]) == (mixed[k].choice, mixed[k].log_score, len(r.marginals)) and np.allclose(r.marginals, mixed[k].marginals)
