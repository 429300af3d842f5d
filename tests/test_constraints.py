"""Users' constraints and beat grids against plain versions."""

import math

import numpy as np
import pytest

from ostinato.operators import beats as B
from ostinato.operators import constraints as C


def test_spans_are_counted_once(spark):
    grid = spark.createDataFrame([(1, b, 0.0 if b == 0 else 0.25 + b * 0.5) for b in range(40)], "song long, beat long, time double")
    spans = spark.createDataFrame([(1, 0, 0, 1.3, 4.3), (1, 0, 1, 5.0, 8.1), (1, 0, 2, 9.0, 9.01), (2, 0, 0, 1.0, 2.0)], "song long, group int, span int, t0 double, t1 double")
    got = sorted((r.span, r["first"], r.beats) for r in C.spans_to_beats(spans, grid, ["song"]).collect())
    assert got == [(0, 2, 6), (1, 9, 6), (2, 17, 1)]


def evidence_of(spark, n=30):
    rng = np.random.default_rng(0)
    x = rng.dirichlet(np.ones(3), n)
    return x, spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)] + [(2, 0, [0.5, 0.5, 0.0])], "song long, beat long, p array<double>")


def spans_of(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "song long, group int, span int, first long, beats long")


def test_evidence_is_pooled_and_reported(spark):
    x, evidence = evidence_of(spark)
    spans = spans_of(spark, [(0, 0, 0, 4), (0, 1, 10, 4), (0, 2, 20, 5), (1, 0, 2, 3), (1, 1, 15, 3), (2, 0, 5, 2), (3, 0, 5, 2), (3, 1, 6, 3)])
    report = {(r.group, r.span): (r.status, r.used, r.expected, r.delta) for r in C.pool_report(spans, ["song"]).collect()}
    assert report[0, 0] == ("partial", True, 4, 0) and report[0, 2] == ("partial", False, 4, 1) and report[1, 0] == ("pooled", True, 3, 0)
    assert report[2, 0][:2] == ("single", False) and report[3, 1] == ("unpoolable", False, 3, 0) and report[3, 0][3] == -1
    got = {(r.song, r.beat): (r.pooled, r.p) for r in C.pool_evidence(spans, evidence, ["song"], "p", must_apply=True).collect()}
    want = {i: v for i, v in enumerate(x)}
    for group in ([(0, 10, 4)], [(2, 15, 3)]):
        for a, b, n in group:
            for o in range(n):
                s = x[a + o] + x[b + o]
                want[a + o] = want[b + o] = s / s.sum()
    changed = {*range(5), *range(10, 14), *range(15, 18)}
    for i in range(30):
        assert np.allclose(got[1, i][1], want[i]) and got[1, i][0] == (i in changed)
    assert got[2, 0] == (False, [0.5, 0.5, 0.0])


def test_features_are_summed_and_ends_bounded(spark):
    d = spark.createDataFrame([(1, i, [10.0 * i]) for i in range(6)], "song long, beat long, p array<double>")
    got = {r.beat: r.p[0] for r in C.pool_evidence(spans_of(spark, [(0, 0, 0, 3), (0, 1, 4, 3)]), d, ["song"], "p").collect()}
    assert got == {0: 40.0, 1: 60.0, 2: 20.0, 3: 30.0, 4: 40.0, 5: 60.0}


def test_nothing_pooled_is_an_error_if_asked(spark):
    _, evidence = evidence_of(spark)
    spans = spans_of(spark, [(0, 0, 0, 4), (0, 1, 10, 5)])
    assert C.pool_evidence(spans, evidence, ["song"], "p").filter("pooled").count() == 0
    with pytest.raises(Exception, match="no common number of beats: 4, 5"):
        C.pool_evidence(spans, evidence, ["song"], "p", must_apply=True).collect()


def test_ties_of_unequal_spans_are_reported(spark):
    spans = spark.createDataFrame([(1, 0, 0, 0, 8), (1, 0, 1, 8, 16), (1, 1, 0, 0, 8), (1, 1, 1, 8, 12), (1, 2, 0, 0, 4), (1, 3, 0, 90, 95), (1, 3, 1, 95, 99)], "song long, group int, span int, start int, end int")
    segments = spark.createDataFrame([(1, k, 4 * k, 4 * k + 4) for k in range(4)], "song long, segment int, start int, end int")
    got = sorted((r.group, r.span, r.k, r.segment, r.expected, r.covered, r.tied) for r in C.tied_segments(spans, segments, ["song"], 4.0).collect())
    assert [g for g in got if g[0] == 0] == [(0, 0, 0, 0, 2, 2, True), (0, 0, 1, 1, 2, 2, True), (0, 1, 0, 2, 2, 2, True), (0, 1, 1, 3, 2, 2, True)]
    assert all(not g[-1] and g[4] == 2 for g in got if g[0] == 1) and not [g for g in got if g[0] == 2]
    assert [g for g in got if g[0] == 3] == [(3, 0, None, None, 0, 0, False), (3, 1, None, None, 0, 0, False)]


def plain_agreement(a, b, chords, n):
    at = lambda t: next((c for s, e, c in chords if s <= t < e), None)
    hits = 0
    for k in range(n):
        f = (k + 0.5) / n
        x, y = (at(s + f * (e - s)) for s, e in (a, b))
        hits += x is not None and x == y
    return hits / n


def test_merges_equal_the_plain_version(spark):
    rng = np.random.default_rng(4)
    loop = list("CCFGaFGC")
    chords = [(k * 2.0, k * 2.0 + 2, loop[k % 8] if rng.random() > 0.1 else "x") for k in range(64)]
    chords = [c for k, c in enumerate(chords) if k != 20]
    sections = [(k, "A" if k % 3 else "B", 4, k * 16.0, k * 16.0 + (16 if k % 4 else 15.5)) for k in range(8)]
    vector = {c: rng.normal(size=5) for c in "CFGax"}
    frames = [(t, vector[next((c for s, e, c in chords if s <= t < e), "x")] + 0.05 * rng.normal(size=5)) for t in np.arange(0, 128, 0.45)]
    got = C.merge_candidates(
        spark.createDataFrame([(1, *s) for s in sections], "song long, section int, label string, bars int, start double, end double"),
        spark.createDataFrame([(1, *c) for c in chords], "song long, start double, end double, symbol string"),
        spark.createDataFrame([(1, float(t), v.tolist()) for t, v in frames], "song long, at double, value array<double>"),
        ["song"],
    ).collect()
    want = {}
    for i, (a, la, _, *sa) in enumerate(sections):
        for b, lb, _, *sb in sections[i + 1 :]:
            if la == lb and (g := plain_agreement(sa, sb, chords, 16)) > 0.75:
                sims = []
                for k in range(16):
                    v = [np.mean([x for t, x in frames if s + k / 16 * (e - s) <= t < s + (k + 1) / 16 * (e - s)], axis=0) for s, e in (sa, sb)]
                    v = [x - x.mean() for x in v]
                    sims.append(v[0] @ v[1] / np.linalg.norm(v[0]) / np.linalg.norm(v[1]))
                want[a, b] = (g, min(1.0, max(0.0, float(np.mean(sims)))))
    assert {(r.a, r.b) for r in got} == set(want) and len(want) > 4
    for r in got:
        g, like = want[r.a, r.b]
        assert math.isclose(r.agreement, g) and math.isclose(r.likeness, like, abs_tol=1e-9) and r.fires == (like > 0.75)


def plain_huber(x, y, rounds=25):
    w, coef = np.ones(len(x)), None
    a = np.vstack([np.ones(len(x)), x]).T
    for _ in range(rounds):
        new = np.linalg.lstsq(a * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
        r = y - a @ new
        d = 1.345 * (1.4826 * np.median(np.abs(r - np.median(r))) + 1e-9)
        w = np.where(np.abs(r) <= d, 1.0, d / np.maximum(np.abs(r), 1e-9))
        if coef is not None and np.allclose(new, coef, atol=1e-9):
            return new
        coef = new
    return coef


def test_robust_lines_equal_the_plain_version(spark):
    rng = np.random.default_rng(3)
    songs = {}
    for s in range(4):
        x = np.arange(30) * 1.0
        y = 5 + 0.5 * x + rng.normal(size=30) * 0.01
        y[rng.integers(0, 30, 3 * s)] += 7
        songs[s] = (x, y)
    d = spark.createDataFrame([(s, float(a), float(b)) for s, (x, y) in songs.items() for a, b in zip(x, y, strict=True)] + [(9, 1.0, 2.0), (9, 1.0, 4.0)], "song long, x double, y double")
    got = {r.song: r for r in B.robust_line(d, ["song"], "x", "y").collect()}
    for s, (x, y) in songs.items():
        want = plain_huber(x, y)
        assert math.isclose(got[s].intercept, want[0], rel_tol=1e-6) and math.isclose(got[s].slope, want[1], rel_tol=1e-6)
    assert got[9].slope is None and got[9].intercept == 3.0 and abs(got[3].slope - 0.5) < 0.01


def test_periods_and_phases(spark):
    t = [0.5 * k * 1.02 for k in range(20) if k not in (5, 6, 11)]
    d = spark.createDataFrame([(1, x, 0.5) for x in t] + [(2, x, 0.25) for x in t[:7]] + [(3, x * 3, 0.47) for x in t], "song long, t double, p double")
    got = {r.song: (round(r.period, 9), r.fitted) for r in B.fitted_period(d, ["song"], "t", "p").collect()}
    assert got[1] == (0.51, True) and got[2] == (0.25, False) and got[3][1] == (0.9 * 0.47 <= got[3][0] <= 1.1 * 0.47 and got[3][0] != 0.47)
    curve = spark.createDataFrame([(1, i, 1.0 if i % 16 == 8 else 0.1) for i in range(70)] + [(2, i, 1.0) for i in range(10)], "song long, i long, v double")
    assert {r.song: (r.phase, round(r.ratio, 3)) for r in B.comb_phase(curve, ["song"], "i", "v", 16, 4).collect()} == {1: (2, 6.4), 2: (0, 1.0)}
    loop = [[1.0 if k == (0 if ((i - 3) // 4) % 2 == 0 else 7) else 0.0 for k in range(12)] for i in range(80)]
    frames = spark.createDataFrame([(1, i, v, 0) for i, v in enumerate(loop)] + [(2, 0, loop[0], 0)], "song long, i long, v array<double>, tonic int")
    best = {r.song: (r.phase, round(r.score, 6)) for r in B.crispest_phase(B.crispness(frames, ["song"], "i", "v", tonic="tonic"), ["song"]).collect()}
    assert best == {1: (3, 2.5), 2: (0, -1.0)}
