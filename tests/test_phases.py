"""Loop phases and block structure against plain versions."""

import math
import random
from collections import Counter

import pytest

from ostinato.operators import block_folds as B
from ostinato.operators import phases as P


def plain_model(songs):
    start, trans, tri = Counter(), Counter(), Counter()
    for seq, tonic in songs:
        seq = [x for x in seq if x]
        if len(seq) < 2:
            continue
        start[(seq[0][0] - tonic) % 12, seq[0][1]] += 1
        for a, b in zip(seq, seq[1:], strict=False):
            trans[a[1], (b[0] - a[0]) % 12, b[1]] += 1
        for a, b, c in zip(seq, seq[1:], seq[2:], strict=False):
            tri[a[1], (a[0] - b[0]) % 12, b[1], (c[0] - b[0]) % 12, c[1]] += 1
    n = sum(start.values()) + 30
    s = {(r, q): math.log((start[r, q] + 0.5) / n) for r in range(12) for q in range(5)}
    t = {(a, d, b): (trans[a, d, b] + 0.5) / (sum(v for k, v in trans.items() if k[0] == a) + 30) for a in range(5) for d in range(12) for b in range(5)}
    return s, t, tri


def plain_score(bars, period, model, shift):
    start, trans, tri = model
    rot = bars[shift:] + bars[:shift]
    total = 0.0
    for j in range(len(bars) // period):
        p1 = p2 = None
        for c in rot[j * period : (j + 1) * period]:
            if c is None:
                p1 = p2 = None
                continue
            if p1 is None:
                total += start[c]
            else:
                p = trans[p1[1], (c[0] - p1[0]) % 12, c[1]]
                if p2:
                    key = (p2[1], (p2[0] - p1[0]) % 12, p1[1])
                    n = sum(v for k, v in tri.items() if k[:3] == key)
                    if n:
                        p = n / (n + 5) * tri[(*key, (c[0] - p1[0]) % 12, c[1])] / n + 5 / (n + 5) * p
                total += math.log(max(p, 1e-12))
            p2, p1 = p1, c
    return total


def test_phase_scores_equal_the_plain_version(spark):
    rng = random.Random(3)
    songs = {s: ([None if rng.random() < 0.1 else (rng.randrange(12), rng.randrange(5)) for _ in range(rng.choice([1, 7, 8, 9, 20, 33]))], rng.randrange(12)) for s in range(40)}
    rows = [(s, i, c[0] if c else None, c[1] if c else -1 if i % 2 else None, t) for s, (seq, t) in songs.items() for i, c in enumerate(seq)]
    d = spark.createDataFrame(rows, "song long, i long, root int, kind int, tonic int").repartition(3)
    model = P.progression_model(d.filter("root is not null"), ["song"], ["i"], "root", "kind", "tonic")
    want = plain_model([([x for x in seq if x], t) for seq, t in songs.values()])
    got = {(r.song, r.shift): r.logp for r in P.phase_scores(d, ["song"], "i", "root", "kind", model, 4).collect()}
    assert {k for k, _ in got} == {s for s, (seq, _) in songs.items() if len(seq) >= 8}
    for (s, shift), x in got.items():
        assert math.isclose(x, plain_score(songs[s][0], 4, want, shift), abs_tol=1e-9)


def test_a_wrong_start_is_recovered(spark):
    rng = random.Random(1)
    loop = [(0, 0), (9, 1), (2, 1), (7, 2)]
    songs = {s: loop * 8 for s in range(30)} | {99: (loop * 8)[3:] + (loop * 8)[:3]}
    d = spark.createDataFrame([(s, i, r, q, 0) for s, seq in songs.items() for i, (r, q) in enumerate(seq)], "song long, i long, root int, kind int, tonic int")
    model = P.progression_model(d.filter("song < 30"), ["song"], ["i"], "root", "kind", "tonic")
    got = {r.song: r.shift for r in P.best_shift(P.phase_scores(d, ["song"], "i", "root", "kind", model, 4), ["song"]).collect()}
    assert got[99] == 1 and all(v == 0 for k, v in got.items() if k < 30) and rng
    shifts = spark.createDataFrame([(1, 2, 32), (2, 0, 32)], "song long, shift int, n_beats int")
    found = spark.createDataFrame([(1, 8), (1, 16), (1, 28), (2, 8), (2, 8)], "song long, beat int")
    assert sorted(map(tuple, P.shift_boundaries(found, shifts, ["song"], "beat", 4).collect())) == [(1, 8), (1, 16), (1, 24), (2, 8)]


def plain_blocks(bars, lengths=(4, 8, 16, 32), shortest=4, alike=0.8):
    n = len(bars)
    like = lambda a, b, p: sum(B.likeness(bars[a + k], bars[b + k]) for k in range(p)) / p
    best = None
    for p in [x for x in lengths if shortest <= x <= n // 2] if n >= 2 * shortest else []:
        for phase in range(p):
            starts = list(range(phase, n - p + 1, p))
            if len(starts) < 2:
                continue
            firsts, of = [], {}
            for a in starts:
                hit, top = -1, alike
                for k, f in enumerate(firsts):
                    if (s := like(a, f, p)) >= top:
                        hit, top = k, s
                if hit < 0:
                    hit = len(firsts)
                    firsts.append(a)
                of[a] = hit
            same = [like(a, b, p) for i, a in enumerate(starts) for b in starts[i + 1 :] if of[a] == of[b]]
            apart = [like(a, b, p) for i, a in enumerate(starts) for b in starts[i + 1 :] if of[a] != of[b]]
            q = (sum(same) / len(same) - (sum(apart) / len(apart) if apart else 0)) if same else -1.0
            score = round(q + 0.1 * len(starts) * p / n + p / n, 9)
            if best is None or score > best[0]:
                best = (score, p, phase, starts, of)
    if best is None:
        return [(0, n, 0)]
    _, p, phase, starts, of = best
    out = [(0, phase, -1)] if phase else []
    out += [(a, a + p, of[a]) for a in starts]
    return out + ([(starts[-1] + p, n, -1)] if starts[-1] + p < n else [])


@pytest.mark.parametrize("seed", [1, 2])
def test_blocks_equal_the_plain_version(spark, seed):
    rng = random.Random(seed)
    songs = {}
    for s in range(12):
        parts = [[tuple(rng.choice("CFGA") for _ in range(rng.choice([0, 1, 1, 2]))) for _ in range(rng.choice([4, 8]))] for _ in range(2)]
        bars = [b for _ in range(rng.randint(1, 6)) for b in rng.choice(parts)]
        songs[s] = [() if rng.random() < 0.05 else b for b in [("X",)] * rng.randrange(3) + bars]
    d = spark.createDataFrame([(s, i, None if s == 3 and not b else list(b)) for s, bars in songs.items() for i, b in enumerate(bars)], "song long, i long, x array<string>").repartition(3)
    got = {}
    for r in B.detect_blocks(d, ["song"], "i", "x").collect():
        got.setdefault(r.song, []).append((r.start, r.end, r.cluster))
    assert {s: sorted(x) for s, x in got.items()} == {s: plain_blocks(b) for s, b in songs.items()}


def test_a_repeated_section_is_found(spark):
    a, b = [(x,) for x in "CFGAdeCF"], [(x,) for x in "bbEEaaDG"]
    d = spark.createDataFrame([(1, i, list(x)) for i, x in enumerate([("i",)] * 2 + a + a + b + a)], "song long, i long, x array<string>")
    rows = sorted((r.start, r.end, r.cluster, r.period, r.phase) for r in B.detect_blocks(d, ["song"], "i", "x").collect())
    assert rows == [(0, 2, -1, 8, 2), (2, 10, 0, 8, 2), (10, 18, 0, 8, 2), (18, 26, 1, 8, 2), (26, 34, 0, 8, 2)]
    assert B.detect_blocks(d.limit(0), ["song"], "i", "x").count() == 0


def test_blocks_of_many_songs_are_found_side_by_side(spark, monkeypatch):
    """Short songs are not repeated for every grid; those solved grid by grid, for their length or a wide bar, come out the same, beside them."""
    rng = random.Random(5)
    songs = {s: [tuple(rng.choice("CFG") for _ in range(rng.choice([0, 1, 3]) if s % 2 else 1)) for _ in range(rng.choice([1, 7, 8, 9, 19, 33, 40, 67]))] * rng.choice([1, 2]) for s in range(40)}
    songs[None] = songs[1] + songs[3]
    songs[99] = [tuple("CFGA" * 6)] + songs[4]
    d = spark.createDataFrame([(s, i, list(b)) for s, bars in songs.items() for i, b in enumerate(bars)], "song long, i long, x array<string>").repartition(3)
    want = {s: plain_blocks(b) for s, b in songs.items()}

    def found(df, **args):
        got = {}
        for r in B.detect_blocks(df, ["song"], "i", "x", **args).collect():
            got.setdefault(r.song, []).append((r.start, r.end, r.cluster))
        return {s: sorted(x) for s, x in got.items()}

    assert found(d, block=30) == want
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(B, "tilings", None)
    try:
        for size in ("7", "10000"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            assert found(d.filter("song is null or song < 99")) == {s: x for s, x in want.items() if s != 99}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
