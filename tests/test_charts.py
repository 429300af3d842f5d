"""Chart folding against plain versions and by hand."""

import random

import pytest

from ostinato.operators import charts as C


def bars_of(spark, songs, label="A"):
    rows = [(s, i, label if isinstance(label, str) else label(i), c) for s, bars in songs.items() for i, c in enumerate(bars)]
    return spark.createDataFrame(rows, "song long, i long, label string, c string").repartition(3)


def alike(a, b, frac):
    return len(a) == len(b) and sum(x == y for x, y in zip(a, b, strict=True)) / len(a) >= frac


def plain_loop(bars, frac=0.7, dominance=0.6):
    pick = None
    for p in (2, 4, 8):
        if 2 * p > len(bars):
            continue
        blocks = [bars[k * p : (k + 1) * p] for k in range(len(bars) // p)]
        hits = [sum(alike(a, b, frac) for b in blocks) for a in blocks]
        top = hits.index(max(hits))
        if hits[top] / len(blocks) >= dominance and (pick is None or hits[top] / len(blocks) > pick[2] / pick[1]):
            pick = (p, len(blocks), hits[top], blocks[top])
    return pick


def plain_endings(blocks, frac=0.7, longest=2):
    for tail in range(1, longest + 1):
        n = len(blocks[0]) - tail
        if n < 1 or not all(alike(blocks[0][:n], b[:n], frac) for b in blocks):
            continue
        tails = [tuple(b[n:]) for b in blocks]
        if len(set(tails)) >= 2:
            seen = list(dict.fromkeys(tails))
            return tail, [seen.index(t) for t in tails]
    return None, [None] * len(blocks)


def test_loops_and_endings_equal_plain_versions(spark):
    rng = random.Random(7)
    songs = {}
    for s in range(60):
        loop = [rng.choice("abcd") for _ in range(rng.choice([2, 4, 8]))]
        bars = (loop * 12)[: rng.randint(1, 50)]
        songs[s] = [rng.choice("abcdxyz") if rng.random() < 0.12 * (s % 4) else b for b in bars]
        if s % 5 == 0:
            songs[s] = [None if b == "a" else b for b in songs[s]]
    loops, passes = C.bar_loops(bars_of(spark, songs), ["song"], "i", "label", "c")
    got = {r.song: (r.period, r.reps, r.hits, r.bars) for r in loops.collect()}
    assert got == {s: p for s, b in songs.items() if (p := plain_loop(b))} and 20 < len(got) < 60
    ended = {(r.song, r["pass"]): (r.tail, r.variant) for r in C.endings(passes, ["song", "run"]).collect()}
    for s, (period, reps, _, _) in got.items():
        tail, variant = plain_endings([songs[s][k * period : (k + 1) * period] for k in range(reps)])
        assert [ended[s, k] for k in range(reps)] == [(tail, v) for v in variant]
    assert len(ended) == sum(p[1] for p in got.values())


def test_loop_cases(spark):
    songs = {1: ["x", "y"] * 6, 2: [f"bar {i}" for i in range(12)], 3: ["a", "b", "c", "d", "a", "b", "c", "e", "a", "b", "c", "d", "a", "b", "c", "e", "z"], 4: ["a"], 5: ["a", "b"] * 2}
    loops, passes = C.bar_loops(bars_of(spark, songs), ["song"], "i", "label", "c")
    got = {r.song: (r.period, r.reps, r.m, r.bars) for r in loops.collect()}
    assert got[1] == (2, 6, 12, ["x", "y"]) and 2 not in got and 4 not in got and got[5] == (2, 2, 4, ["a", "b"])
    assert got[3][:3] == (4, 4, 17)
    ends = sorted((r["pass"], r.start, r.tail, r.variant) for r in C.endings(passes, ["song", "run"]).filter("song = 3").collect())
    assert ends == [(0, 0, 1, 0), (1, 4, 1, 1), (2, 8, 1, 0), (3, 12, 1, 1)]
    assert {(r.tail, r.variant) for r in C.endings(passes, ["song", "run"]).filter("song = 1").collect()} == {(None, None)}


def test_an_intro_parts_runs(spark):
    d = bars_of(spark, {1: ["p", "q"] + ["x", "y"] * 2 + ["n", "n"] + ["u", "v"] * 3}, lambda i: "Intro" if i < 2 else "no chord" if 6 <= i < 8 else "B")
    loops, passes = C.bar_loops(d, ["song"], "i", "label", "c")
    assert sorted((r.run, r.reps, r.bars) for r in loops.collect()) == [(2, 2, ["x", "y"]), (8, 3, ["u", "v"])]
    assert sorted((r["pass"], r.start) for r in passes.collect()) == [(0, 2), (0, 8), (1, 4), (1, 10), (2, 12)]


def test_longest_tail_and_ragged_passes(spark):
    rows = [(1, 0, list("abcd")), (1, 1, list("abxy")), (2, 0, list("abcd")), (2, 1, list("abc")), (3, 0, list("abcd")), (3, 1, list("xbcd")), (4, 0, ["a"]), (4, 1, ["b"]), (5, 0, list("abcd"))]
    d = spark.createDataFrame([(s, k, b) for s, k, b in rows], "song long, pass long, bars array<string>")
    got = {(r.song, r["pass"]): (r.tail, r.variant) for r in C.endings(d, ["song"]).collect()}
    assert got[1, 0] == (2, 0) and got[1, 1] == (2, 1)
    assert {v for k, v in got.items() if k[0] > 1} == {(None, None)}


def test_section_groups(spark):
    def song(labels, contents, reps=None):
        return [(k, a, (reps or [1] * 99)[k], list(c)) for k, (a, c) in enumerate(zip(labels, contents, strict=True))]

    songs = {
        1: song("ABABAB", ["abcdefg", "xy"] * 3),
        2: song("ABABAB", ["abcdefg", "xy", "abcdefh", "xy", "abcdefg", "xy"]),
        3: song("ABABAB", ["abcdefg", "xy", "abcdehh", "xy", "abcdefg", "xy"]),
        4: song("AABAAB", ["ab", "ab", "xy"] * 2),
        5: song("AAAA", ["ab"] * 4, [1, 2, 1, 2]),
        6: song("ABABA", ["ab", "cd", "ab", "cd", "ab"]),
        7: song(["Intro", "A", "B", "A", "B"], ["zz", "ab", "cd", "ab", "cd"]),
        8: song("AABBAABB", ["ab", "ab", "cd", "ce", "ab", "ab", "cd", "ce"]),
    }
    sections = spark.createDataFrame([(s, k, a, r) for s, x in songs.items() for k, a, r, _ in x], "song long, section long, label string, reps int")
    bars = spark.createDataFrame([(s, k, o, c) for s, x in songs.items() for k, _, _, b in x for o, c in enumerate(b)], "song long, section long, offset int, content string")
    got = {}
    for r in C.section_groups(sections, bars, ["song"]).collect():
        got.setdefault(r.song, {})[r.section] = (r.run, r.period, r.slot, r.round)
    assert {s: x[max(x)][:2] for s, x in got.items()} == {1: (0, 2), 2: (0, 2), 4: (0, 3), 5: (0, 2), 7: (1, 2), 8: (0, 4)}
    assert got[4] == {k: (0, 3, k % 3, k // 3) for k in range(6)} and 0 not in got[7]


def test_letters_grow_and_unreadable_charts_merge(spark):
    rows = [(1, k, a, m) for k, (a, m) in enumerate([("A", 0b1111), ("Intro", 0b1), ("B", 0b110000), ("C", 0b11110), ("D", 0), ("E", 0), ("A", 0b11000)])]
    d = spark.createDataFrame(rows, "song long, section long, label string, mask int")
    assert [(r.section, r.letter) for r in C.content_letters(d, ["song"]).orderBy("section").collect()] == [(0, 0), (2, 1), (3, 0), (4, 2), (5, 2), (6, 3)]
    many = spark.createDataFrame([(s, k, "key of A" if k % 4 < 2 else "B", 2, k, k) for s, n in ((1, 13), (2, 12)) for k in range(n)], "song long, section long, label string, reps int, start long, end long")
    got = {(r.song, r.section): (r.label, r.reps, r.start, r.end) for r in C.coalesced(many, ["song"], unless_readable=True).collect()}
    assert len([k for k in got if k[0] == 2]) == 12 and got[1, 0] == ("key of A", 1, 0, 1) and got[1, 6] == ("key of A", 2, 12, 12)
    plain = C.coalesced(many, ["song"]).filter("song = 2").collect()
    assert len(plain) == 9 and all(r.start == r.end for r in plain if r.label != "B")


@pytest.mark.parametrize(
    ("sections", "want"),
    [
        ([("A", 1, 0, 11)], ("12-bar blues", None)),
        ([("A", 2, 0, 7)], ("8-bar loop", None)),
        ([("A", 1, 0, 7)], (None, None)),
        ([("A", 2, 0, 7), ("B", 1, 16, 23), ("A", 1, 24, 31)], ("AABA (32-bar song form)", None)),
        ([("A", 2, 0, 7), ("B", 1, 16, 24), ("A", 1, 25, 31)], ("AABA (32-bar song form)", 23)),
        ([("A", 2, 0, 5), ("B", 1, 12, 17), ("A", 1, 18, 23)], ("AABA-shaped form (6-bar sections)", None)),
        ([("A", 2, 0, 7), ("B", 1, 16, 26), ("A", 1, 27, 31)], (None, None)),
        ([("A", 1, 0, 7), ("B", 1, 8, 15), ("C", 1, 16, 23)], (None, None)),
        ([("Intro", 1, 0, 3), ("A", 1, 4, 15)], ("12-bar blues", None)),
        ([("no form", 1, 0, 3)], (None, None)),
    ],
)
def test_forms(spark, sections, want):
    d = spark.createDataFrame([(1, k, *x) for k, x in enumerate(sections)], "song long, section long, label string, reps int, start long, end long")
    assert [(r.form, r.boundary) for r in C.form_names(d, ["song"]).collect()] == [want]


def test_empty_charts(spark):
    bars = spark.createDataFrame([], "song long, i long, label string, c string, t double")
    loops, passes = C.bar_loops(bars, ["song"], "i", "label", "c")
    assert loops.count() == 0 and C.endings(passes, ["song", "run"]).count() == 0
    assert C.section_runs(bars, bars.select("song", "label", "t"), ["song"], "i", "label", "t").count() == 0
