"""Scales, evaluation labels and charts written out, by hand."""

from pyspark.sql import functions as F

from ostinato.functions import scales
from ostinato.functions import vocabulary as V
from ostinato.functions.tokens import MAJOR_SCALE
from ostinato.operators import export
from ostinato.operators.timelines import split_by_fast_runs


def test_triads_of_scales():
    assert scales.stacked_thirds(MAJOR_SCALE) == {0: "maj", 2: "min", 4: "min", 5: "maj", 7: "maj", 9: "min", 11: "dim"}
    assert scales.stacked_thirds(scales.HARMONIC_MINOR) == {0: "min", 2: "dim", 3: "aug", 5: "min", 7: "maj", 8: "maj", 11: "dim"}


def test_membership(spark):
    rows = [(0, "maj", False), (5, "min", False), (2, "maj", False), (7, "maj", True), (3, "maj", True), (5, "maj", True), (1, "sus", True), (12, "maj", False), (None, "maj", True), (0, None, True), (0, "sus", None), (3, "aug", False)]
    d = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "n int, i int, t string, minor boolean")
    got = [r.m for r in d.select("n", scales.membership(F.col("i"), F.col("t"), F.col("minor")).alias("m")).orderBy("n").collect()]
    own, other, harmonic = "diatonic_own", "parallel_borrow", "harmonic_minor_borrow"
    assert got == [own, other, "chromatic", other, own, other, "sus", own, None, None, None, harmonic]
    tones = spark.createDataFrame([([0, 4, 7, 10], "maj"), ([0, 3, 6], "dim"), ([0, 5, 7], "sus"), ([0, 4, 6], "other"), ([], "other"), (None, None)], "x array<int>, want string")
    assert all(r.got == r.want for r in tones.select("want", scales.triad(F.col("x")).alias("got")).collect())


def test_evaluation_labels(spark):
    cases = {"Cmaj7": "C:maj7", "C#ø7": "C#:hdim7", "D°7": "D:dim7", "A#": "A#:maj", "Gweird": "G:maj", "N": "N", "x7": "x7:maj", "F13b9": "F:13", "": ":maj", "Bbmin": "B:maj"}
    d = spark.createDataFrame([*cases.items(), (None, None)], "label string, want string")
    assert all(r.got == r.want for r in d.select("want", V.evaluation_label(F.col("label")).alias("got")).collect())


def test_played_bars(spark):
    rows = [
        ("s", 1, "Bridge", 2, 4, 1, 2, "7"), ("s", 1, "Bridge", 2, 4, 0, 0, None), ("s", 1, "Bridge", 2, 5, 0, None, None), ("s", 1, "Bridge", 2, 6, 0, None, "N"), ("t", 0, None, 0, 0, 0, 13, "-7"),
    ]
    d = spark.createDataFrame(rows, "chart string, section int, letter string, reps int, bar int, beat int, root int, q string")
    got = [(r.chart, r.rep, r.bar, r.token) for r in export.played_bars(d).orderBy("chart", "rep", "bar").collect()]
    once = [(4, "*BC D7"), (5, "x"), (6, "n")]
    assert got == [("s", rep, bar, token) for rep in (1, 2) for bar, token in once] + [("t", 1, 0, "*AC#-7")]
    assert export.played_bars(d.limit(0)).count() == 0


def test_fast_runs_replace_chords(spark):
    schema = "song string, t0 double, t1 double, label string"
    times = [0, 2, 4, 6, 7, 20, 22, 24, 26, 40]  # four quick ones, one long, three quick ones: too few
    labels = [("s", float(a), float(b), f"L{a}") for a, b in zip(times, times[1:], strict=False)] + [("u", float(a), float(a + 2), f"M{a}") for a in range(0, 8, 2)] + [(None, 0.0, 1.0, "L"), ("s", None, 1.0, "L")]
    chords = [("s", 0.0, 4.0, "C"), ("s", 4.0, 7.0, "N"), ("s", 6.0, 8.0, "D"), ("s", 20.0, 24.0, "E"), ("u", 9.0, 12.0, "F"), ("v", 0.0, 4.0, "G"), (None, 0.0, 1.0, "H"), ("s", None, 2.0, "I"), ("s", 0.0, 4.0, None)]
    got = split_by_fast_runs(spark.createDataFrame(chords, schema), spark.createDataFrame(labels, schema), 1.0)
    rows = sorted((str(r.song), str(r.t0), r.t1, str(r.label), r.added) for r in got.collect())
    kept = [("s", 4.0, 7.0, "N"), ("s", 20.0, 24.0, "E"), ("u", 9.0, 12.0, "F"), ("v", 0.0, 4.0, "G"), (None, 0.0, 1.0, "H"), ("s", None, 2.0, "I")]
    # L6 lasts one period: too short; the middle of D is the run's end.
    added = [("s", 0.0, 2.0, "L0"), ("s", 2.0, 4.0, "L2"), ("s", 4.0, 6.0, "L4")]
    assert rows == sorted([(str(a), str(b), c, str(x), False) for a, b, c, x in kept] + [(a, str(b), c, x, True) for a, b, c, x in added])
