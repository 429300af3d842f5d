"""Trackers of keys against plain versions of their rules, and the reader of key files."""

import numpy as np

from ostinato.functions import tokens as T
from ostinato.operators import keys
from ostinato.sources import labels

MAJOR = [{(x + t) % 12 for x in T.MAJOR_SCALE} for t in range(12)]
TONES = {"^7": {0, 4, 7, 11}, "-7": {0, 3, 7, 10}, "7": {0, 4, 7, 10}, "h7": {0, 3, 6, 10}, "": {0, 4, 7}, "o7": {0, 3, 6, 9}}
CLASS = {"^7": "maj", "-7": "min", "7": "dom", "h7": "m7b5", "": "maj", "o7": "dim"}


def fifths(a, b):
    d = abs(a * 7 % 12 - b * 7 % 12)
    return min(d, 12 - d)


def plain_track(chords, home):
    """Natural scales only: (collection, tonic, mode) of each chord."""
    tones = [{(r + x) % 12 for x in TONES[q]} for r, q in chords]
    now, held = home, []
    for i, t in enumerate(tones):
        if not t <= MAJOR[now]:
            fit = [c for c in range(12) if t <= MAJOR[c]]
            most = max(len(t & m) for m in MAJOR)
            fit = fit or [c for c in range(12) if len(t & MAJOR[c]) == most]
            ahead = tones[i + 1] if i + 1 < len(tones) else None
            now = min(fit, key=lambda c: (fifths(c, now), 0 if ahead is not None and ahead <= MAJOR[c] else 1, c))
        held.append(now)
    out, i = [], 0
    while i < len(held):
        j = i
        while j < len(held) and held[j] == held[i]:
            j += 1
        low = (held[i] + 9) % 12
        major = sum(r == held[i] and CLASS[q] == "maj" for r, q in chords[i:j])
        minor = sum(r == low and CLASS[q] in ("min", "m7b5") for r, q in chords[i:j])
        out += [(held[i], low, "minor") if minor > major else (held[i], held[i], "major")] * (j - i)
        i = j
    return out


def test_natural_scales_are_held_until_a_tone_leaves(spark):
    rng = np.random.default_rng(3)
    songs = {s: [(int(r), str(q)) for r, q in zip(rng.integers(0, 12, 25), rng.choice(list(TONES), 25), strict=True)] for s in range(12)}
    rows = [(s, i, T.FLATS[r] + q) for s, chords in songs.items() for i, (r, q) in enumerate(chords)]
    d = keys.parsed(spark.createDataFrame(rows, "song long, i int, token string"))
    got = {(r.song, r.i): (r.collection, r.tonic, r["mode"]) for r in keys.continuity_track(d, ["song"], ["i"], 5, "major", minor_colours=False).collect()}
    for s, chords in songs.items():
        assert [got[s, i] for i in range(25)] == plain_track(chords, 5)


def test_minor_colours_stay_in_their_collection(spark):
    d = keys.parsed(spark.createDataFrame([(1, i, t) for i, t in enumerate(["A-7", "E7", "A-7", "Dh7", "C^7", "F#^7"])], "song long, i int, token string"))
    got = keys.continuity_track(d, ["song"], ["i"]).orderBy("i").collect()
    assert [r.collection for r in got[:3]] == [0, 0, 0] and [r["mode"] for r in got[:3]] == ["minor"] * 3 and got[5].collection != 0


def test_chains_of_dominants_take_the_key_they_reach(spark):
    tokens = ["C^7", "E-7", "A7", "D7", "G7", "C^7", "D7", "F^7"]
    d = keys.parsed(spark.createDataFrame([(1, i, t, 9, "major") for i, t in enumerate(tokens)], "song long, i int, token string, tonic int, mode string"))
    d = d.withColumn("tonic", d.i.cast("int"))  # a key of its own for every chord
    got = [r.tonic for r in keys.consolidate_dominants(d, ["song"], ["i"]).orderBy("i").collect()]
    # E-7 A7 D7 G7 resolve to the key of the C^7 after them; a dominant alone stays.
    assert got == [0, 5, 5, 5, 5, 5, 6, 7]


def test_key_files(spark, tmp_path):
    (tmp_path / "k.txt").write_text("0.0 4.0 Eb:maj\n4.0 9.5 F#:min\nbad\n9.5 10 H:maj\n")
    got = [(r.t0, r.t1, r.tonic, r["mode"]) for r in labels.key_segments(spark, str(tmp_path)).orderBy("t0").collect()]
    assert got == [(0.0, 4.0, 3, "major"), (4.0, 9.5, 6, "minor")]
