"""Chord names, vocabularies and scores by hand and against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ostinato.functions import vocabulary as V
from ostinato.operators import scoring as S
from ostinato.operators.timelines import split_by_fast_runs
from ostinato.plans.scoring import UNIT


@pytest.mark.parametrize("valid", [None, ["M7", "m7", "weird", "5", "7alt"]])
def test_normal_names(spark, valid):
    cases = {
        "F^7": "FM7", "E-7": "Em7", "Eh7": "Em7b5", "C": "C", "Bo7": "Bdim7", "G7sus": "G7sus4", "F#-7": "F#m7", "A-^7": "AmM7", "Ab/Gb": "Ab/Gb", "n": "z", "W": "z", "N.C.": "z", "W/G": "G5", "W/DN2": "D5",
        "Ebo^7": "Ebdim7(addM7)", "D^7U": "DM7", "D7at": "D7alt", "A7N2": "A7", "Cweird": None, "W/x": None, "hello": None, "": None, " C-7 ": "Cm7", "CW-7": "Cm7",
    }
    d = spark.createDataFrame([(t,) for t in [*cases, None]], "t string")
    got = {r.t: r.n for r in d.select("t", V.normal_chord(F.col("t"), valid).alias("n")).collect()}
    if valid is None:
        assert got == {**cases, None: None}
    else:
        assert [got[t] for t in ("F^7", "E-7", "Eh7", "Cweird", "C", "W/G", "D7at", "G7sus")] == ["FM7", "Em7", None, "Cweird", "C", "G5", "D7alt", None]
    roots = {r.t: r.p for r in spark.createDataFrame([("Ab7",), ("z",), ("",), ("C#m",), ("Cb",), ("F",)], "t string").select("t", V.root_class(F.col("t")).alias("p")).collect()}
    assert roots == {"Ab7": 8, "z": None, "": None, "C#m": 1, "Cb": 11, "F": 5}


def test_vocabulary_is_a_bijection(spark):
    assert [V.size(p) for p in (1, 2, 3, 4)] == [181, 253, 301, 349]
    rows = V.vocabulary(spark, 2).collect()
    assert [r.number for r in rows] == list(range(253)) and (rows[-1].root, rows[-1].label) == (-1, "N") and rows[0].label == "Cmaj" and len({r.label for r in rows}) == 253
    back = V.vocabulary(spark, 2).select("number", V.chord_number(F.col("root"), F.col("quality"), 2).alias("n")).collect()
    assert all(r.number == r.n for r in back)
    assert spark.range(1).select(V.chord_number(F.lit(3), F.lit("13"))).first()[0] is None


def test_templates_and_rotations(spark):
    rng = np.random.default_rng(1)
    t = rng.uniform(size=(3, 12))
    t /= np.linalg.norm(t, axis=1, keepdims=True)
    mu, sd = rng.uniform(size=(2, 12)), rng.uniform(0.2, 1, size=(2, 12))
    x = rng.uniform(size=(9, 12))
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9, [0.0] * 12), (10, None)], "i long, x array<double>")
    got = {r.i: r for r in d.select("i", S.best_template(F.col("x"), t.tolist()).alias("b"), S.rotation_likelihoods(F.col("x"), mu.tolist(), sd.tolist()).alias("l")).collect()}
    for i, v in enumerate(x):
        every = [(np.roll(t[f], r) @ v / np.linalg.norm(v), -r, -f) for r in range(12) for f in range(3)]
        s, r, f = max(every)
        assert (got[i].b.root, got[i].b.family) == (-r, -f) and abs(got[i].b.score - s) < 1e-12
        want = [[-0.5 * (((np.roll(v, -k) - mu[g]) / sd[g]) ** 2).sum() - np.log(sd[g]).sum() for k in range(12)] for g in range(2)]
        assert np.allclose(got[i].l, want)
    assert tuple(got[9].b) == (0, 0, 0.0) and tuple(got[10].b) == (0, 0, 0.0)


def test_agreement_windows_and_sources(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0], 2.0), (1, [0.0, 1.0], 6.0), (2, [0.5, 0.5], 0.0)], "g int, d array<double>, w double")
    assert {r.g: (round(r.agreement, 6), r.n) for r in S.agreement(d, ["g"], "d", "w").collect()} == {1: (0.75, 2), 2: (0.0, 1)}
    assert {r.g: r.agreement for r in S.agreement(d, ["g"], "d").collect()} == {1: 0.5, 2: 0.5}
    e = spark.createDataFrame([(1, i, v, m) for i, (v, m) in enumerate([(0, 1), (None, 1), (14, 0)])], "song long, i int, d int, m int")
    rows = {r.i: r.block for r in S.window_block(e, ["song"], ["i"], "d", "m", 1).collect()}
    assert [k for k, v in enumerate(rows[0]) if v] == [13, 25] and [k for k, v in enumerate(rows[1]) if v] == [0, 12, 26 + 2] and [k for k, v in enumerate(rows[2]) if v] == [13 + 2] and len(rows[0]) == 39
    a, b = (spark.createDataFrame(x, "k int, title string, n int") for x in ([(1, "Blue", 5), (1, "blue", 3), (2, "Red", 1)], [(1, "BLUE", 1), (1, "Green", 2), (2, None, 7), (2, None, 8)]))
    assert sorted((r.k, str(r.title), r.n, r.source) for r in S.first_of_sources([a, b], ["k"], "title").collect()) == [(1, "Green", 2, 1), (1, "blue", 3, 0), (2, "None", 7, 1), (2, "Red", 1, 0)]
    assert sorted(r.k for r in S.first_of_sources([a, b], ["k"], "title", 1).collect()) == [1, 2]


def test_templates_whose_scores_agree_go_by_root(spark):
    """A block of the events in which root 5 of the last family and root 6 of the third score alike but for the last digits."""
    x = [10.82 / 50 if k == 0 else 10.82 / 100 if k == 7 else 0.01 * (k + 1) for k in range(12)]
    b = spark.createDataFrame([(x,)], "x array<double>").select(S.best_template(F.col("x"), UNIT).alias("b")).first().b
    assert (b.root, b.family, round(b.score, 6)) == (5, 4, 0.652103)


def test_tasks_follow_the_rows(spark):
    """Windows over songs are dealt out by number of rows, so that a task's memory doesn't grow with the table."""
    d = spark.range(0, 400_000).selectExpr("id div 50 AS song", "id % 50 AS i", "id % 12 AS d", "0 AS m", "id AS t0", "id + 1 AS t1", "'x' AS label")
    for out, n in ((S.window_block(d, ["song"], ["i"], "d", "m", 1), 1), (split_by_fast_runs(d.select("song", "t0", "t1", "label"), d.select("song", "t0", "t1", "label"), 1.0), 2)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RepartitionByExpression") >= n and f", {-(-400_000 // 32_768)}" in plan
