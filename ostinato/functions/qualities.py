"""Chord qualities as columns: families, levels of detail, priors and tie-breaks over them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ostinato.functions import tokens as T
from ostinato.functions import vectors as V

# How tab sites spell qualities (case doesn't matter, but for those of CASED).
SPELLINGS = {
    "mMaj7": ["mmaj7", "mm7", "minmaj7", "m^7", "m△7"],
    "augMaj7": ["augmaj7", "+maj7", "+^7", "+△7"],
    "aug7": ["aug7", "+7", "7+", "7#5"],
    "ø7": ["m7b5", "ø7", "ø", "h7", "halfdim7", "halfdim"],
    "°7": ["dim7", "°7", "o7"],
    "7sus4": ["7sus4", "7sus"],
    "min7": ["min7", "mi7", "m7", "-7"],
    "7": ["7"],
    "sus2": ["sus2"],
    "sus4": ["sus4", "sus"],
    "dim": ["dim", "°", "o"],
    "aug": ["aug", "+"],
    "min9": ["min9", "mi9", "m9", "-9"],
    "9": ["9"],
    "min11": ["min11", "mi11", "m11", "-11"],
    "min13": ["min13", "mi13", "m13", "-13"],
    "13": ["13"],
    "min": ["min", "mi", "m", "-"],
}
CASED = {
    "maj7": ["maj7", "M7", "△7", "Δ7", "^7", "△maj7"],
    "maj9": ["maj9", "M9", "△9", "Δ9", "^9"],
    "maj13": ["maj13", "M13"],
    "maj": ["maj", "Δ", "△", ""],
}
# Grooves of styles, the first one whose name is part of a style's counts; of metres, by their beats.
STYLES = [
    ("up tempo swing", "Swing", 220), ("medium up swing", "Swing", 180), ("medium swing", "Swing", 140), ("slow swing", "Swing", 100),
    ("ballad", "Ballad", 70), ("swing", "Swing", 140), ("bossa", "BossaNova", 130), ("samba", "Samba", 180), ("latin", "BossaNova", 140),
    ("even 8ths", "8Beat", 120), ("even 8th", "8Beat", 120), ("rock", "JazzRock", 120), ("rnb", "Blues", 100), ("funk", "8Beat", 105),
    ("shuffle", "ShuffleBoggie", 130), ("slow blues", "SlowBlues", 65), ("blues", "Blues", 110), ("afro", "Afro", 120), ("calypso", "BossaNova", 150),
    ("waltz", "JazzWaltz", 140),
]
METRES = {3: ("JazzWaltz", 140), 5: ("Jazz54", 140), 6: ("68Swing", 100), 12: ("Ballad128", 70)}
# Tempo ranges and usual tempos of styles.
TEMPOS = [
    ("Jazz Ballad", 30.0, 80.0, 55.0), ("Medium Swing", 90.0, 180.0, 130.0), ("Bebop", 180.0, 340.0, 240.0), ("Latin Jazz", 120.0, 220.0, 165.0),
    ("Pop", 80.0, 140.0, 110.0), ("Blues / Shuffle", 60.0, 160.0, 100.0), ("Modal Jazz", 60.0, 200.0, 120.0),
]
# The qualities at home on each degree of a key; the first is the one that others are set to.
AT_HOME = {
    "major": {0: ["major", "maj7"], 2: ["minor"], 4: ["minor"], 5: ["major", "maj7"], 7: ["dom7", "major"], 9: ["minor"], 11: ["dim"]},
    "minor": {
        0: ["minor"], 2: ["dim"], 3: ["major", "maj7"], 5: ["minor"], 7: ["dom7", "minor", "major"], 8: ["major", "maj7"], 10: ["dom7", "major"], 11: ["dim"],
    },
}
COARSE = {"maj": "major", "maj7": "maj7", "min": "minor", "min7": "minor", "7": "dom7", "hdim7": "dim", "dim7": "dim", "dim": "dim", "minmaj7": "minor"}
SEVENTHS = ["maj7", "min7", "7", "hdim7", "dim7", "minmaj7"]


def lookup(table: dict, key: Column) -> Column:
    """The entry of a small fixed table, null for other keys."""
    return F.try_element_at(F.create_map(*[F.lit(x) for item in table.items() for x in item]), key)


def normal_quality(raw: Column) -> Column:
    """The plain name of a quality as tab sites spell it; unknown ones stay as they are."""
    q = F.trim(raw)
    cased = lookup({s: name for name, spelled in CASED.items() for s in spelled}, q)
    rest = lookup({s: name for name, spelled in SPELLINGS.items() for s in spelled}, F.lower(q))
    return F.coalesce(cased, rest, q)


def normal_chord(raw: Column) -> Column:
    """Root in sharps and plain quality of a tab's chord, without its bass; N for no chord, null for what isn't one."""
    text = F.trim(raw)
    silent = F.upper(text).isin("", "N", "NC", "N.C.", "N/C", "NO CHORD", "-")
    root = F.regexp_extract(text, "^([A-Ga-g][#b]?)", 1)
    pitch = T._pitch(F.concat(F.upper(F.substring(root, 1, 1)), F.substring(root, 2, 1)))
    tail = F.regexp_replace(F.regexp_replace(text, "^[A-Ga-g][#b]?", ""), "/[A-Ga-g][#b]?$", "")
    return F.when(silent, "N").when(pitch.isNotNull(), F.concat(F.element_at(T._strings(T.SHARPS), pitch.cast("int") + 1), normal_quality(tail)))


def family(q: Column) -> Column:
    """maj, min, dim, aug, sus or N: what third and fifth make of a plain quality."""
    return (
        F.when(q == "N", "N").when(q.contains("sus"), "sus").when(q.startswith("aug"), "aug").when(q.isin("dim", "ø7", "°7"), "dim")
        .when(q.startswith("min") | q.startswith("mMaj"), "min").otherwise("maj")
    )


def base_seventh(q: Column) -> Column:
    """The triad or seventh chord that a plain quality extends."""
    f = family(q)
    return (
        F.when(f.isin("N", "aug", "dim"), q)
        .when(f == "sus", F.when(q.isin("sus2", "sus4"), "sus4").otherwise("7sus4"))
        .when(f == "min", F.when(q.isin("min", "mMaj7"), q).otherwise("min7"))
        .otherwise(F.when(q == "maj", q).when(q.startswith("maj"), "maj7").otherwise("7"))
    )


def at_depth(root: Column, q: Column, depth: Column) -> Column:
    """A chord's label told as family (depth 1), base seventh (2) or in full (3)."""
    name = F.element_at(T._strings(T.SHARPS), F.pmod(root, F.lit(12)).cast("int") + 1)
    f = family(q)
    short = F.when(f == "maj", "").when(f == "min", "m").otherwise(f)
    return F.when(f == "N", "N").when(depth <= 1, F.concat(name, short)).when(depth == 2, F.concat(name, base_seventh(q))).otherwise(F.concat(name, q))


def absolute(progression: Column, tonic: Column) -> Column:
    """A progression of structs (interval, quality) set on a tonic: structs (root, quality)."""
    return F.transform(progression, lambda c: F.struct(F.pmod(tonic + c["interval"], F.lit(12)).alias("root"), c["quality"].alias("quality")))


def groove(style: Column, beats: Column) -> Column:
    """struct(groove, tempo) of a style's name and the beats of its measure (null counts as 4)."""
    both = lambda g, t: F.struct(F.lit(g).alias("groove"), F.lit(t).alias("tempo"))
    out = F.lit(None)
    for n, (g, t) in METRES.items():
        out = F.when(beats == n, both(g, t)) if n == 3 else out.when(beats == n, both(g, t))
    for name, g, t in STYLES:
        out = out.when(F.lower(F.coalesce(style, F.lit(""))).contains(name), both(g, t))
    return out.otherwise(both("Swing", 140))


def style_posteriors(tempo: Column) -> Column:
    """Array of structs (style, p) by tempo: log-normal around each style's usual tempo, 0 outside its range; null
    where the tempo is outside all of them."""
    weight = lambda lo, hi, mode: F.when((tempo >= lo) & (tempo <= hi), F.exp(-0.5 * F.pow((F.ln(tempo) - math.log(mode)) / 0.3, 2))).otherwise(0.0)
    weights = [weight(lo, hi, mode) for _, lo, hi, mode in TEMPOS]
    total = sum(weights[1:], weights[0])
    every = F.array(*[F.struct(F.lit(name).alias("style"), (w / total).alias("p")) for (name, *_), w in zip(TEMPOS, weights, strict=True)])
    return F.when(total > 0, every)


def diatonic_prior(root: Column, q: Column, confidence: Column, tonic: Column, mode: Column, key_confidence: Column, boost: float = 4.0, sure: float = 0.8, least_key: float = 0.3) -> Column:
    """struct(quality, p): a quality foreign to a key that is known well enough gives way to the one at home on its degree,
    if it is itself unsure and ``boost`` outweighs it; p is the odds of that decision, null where nothing changes.
    Roots off the scale, sus and aug chords stay."""
    degree, coarse = F.pmod(root - tonic, F.lit(12)).cast("int"), lookup(COARSE, q)
    by_mode = lambda table: F.when(mode == "major", lookup(table["major"], degree)).otherwise(lookup(table["minor"], degree))
    fits = by_mode({m: {d: ",".join(x) for d, x in t.items()} for m, t in AT_HOME.items()})
    home = by_mode({m: {d: x[0] for d, x in t.items()} for m, t in AT_HOME.items()})
    seventh = q.isin(SEVENTHS)
    new = (
        F.when(home == "major", F.when(seventh, "maj7").otherwise("maj")).when(home == "minor", F.when(seventh, "min7").otherwise("min"))
        .when(home == "dom7", F.when(seventh, "7").otherwise("maj")).otherwise(F.when(seventh, "dim7").otherwise("dim"))
    )
    own, other = F.greatest(confidence, F.lit(1e-6)), F.greatest(1 - confidence, F.lit(1e-6)) * boost
    foreign = coarse.isNotNull() & home.isNotNull() & ~F.array_contains(F.split(fits, ","), coarse)
    change = (key_confidence >= least_key) & (confidence < sure) & F.coalesce(foreign, F.lit(False)) & (other > own)
    return F.struct(F.when(change, new).otherwise(q).alias("quality"), F.when(change, other / (other + own)).alias("p"))


def fifth_checked(q: Column, root: Column, treble: Column, margin: float = 1.3, least: float = 0.12) -> Column:
    """min7 or hdim7 (min or dim) by which fifth above the root is louder in a chroma, where the louder one is loud
    enough and clearly louder; other qualities stay."""
    at = lambda step: F.element_at(treble, F.pmod(root + step, F.lit(12)).cast("int") + 1)
    perfect, flat = at(7), at(6)
    lo, hi = F.least(perfect, flat), F.greatest(perfect, flat)
    clear = (hi >= least) & (lo > 0) & (hi / lo >= margin)
    narrow = {"min7": "hdim7", "min": "dim"}
    wide = {v: k for k, v in narrow.items()}
    return F.when(clear & (flat > perfect), F.coalesce(lookup(narrow, q), q)).when(clear & (perfect > flat), F.coalesce(lookup(wide, q), q)).otherwise(q)


def five_classes(families: Column, sevenths: Column, floor: float = 1e-9) -> Column:
    """Log-probabilities of maj, min, dom, half-diminished and dim, from those of the families (major, minor, diminished, augmented,
    suspended) and a map of sevenths (majT, maj7, dom7, dimT, dim7, m7b5), which splits major and diminished."""
    mass = lambda *names: sum((F.coalesce(F.try_element_at(sevenths, F.lit(n)), F.lit(0.0)) for n in names), F.lit(0.0))
    split = lambda part, whole: F.when(whole > floor, part / whole).otherwise(0.0)
    dom = split(mass("dom7"), mass("majT", "maj7", "dom7"))
    half = split(mass("m7b5"), mass("dimT", "dim7", "m7b5"))
    p = [F.element_at(families, i + 1) for i in range(5)]
    raw = F.array(p[0] * (1 - dom) + p[3] + p[4], p[1], p[0] * dom, p[2] * half, p[2] * (1 - half))
    kept = F.transform(raw, lambda x: F.greatest(x, F.lit(floor)))
    return F.transform(kept, lambda x: F.ln(x / V.total(kept)))


def fifth_competes(root: Column, suggestions: Column, share: float = 0.6) -> Column:
    """Whether a suggested root (structs root, c) a fifth away has at least ``share`` of the chosen root's confidence (that of
    the first suggestion where the root isn't among them)."""
    own = F.filter(suggestions, lambda s: s["root"] == root)
    chosen = F.coalesce(F.get(own, F.lit(0))["c"], F.get(suggestions, F.lit(0))["c"])
    rival = lambda s: (s["root"] >= 0) & F.pmod(s["root"] - root, F.lit(12)).isin(5, 7) & (s["c"] >= share * F.when(chosen == 0, 1e-9).otherwise(chosen))
    return F.coalesce((root >= 0) & F.exists(suggestions, rival), F.lit(False))


def uninverted(p: Column, share: float = 0.4) -> Column:
    """Root probabilities in which part of each class's goes to the one a fifth below, if the fifth above sounds too:
    the class may be the fifth of that root."""
    at = lambda k: F.element_at(p, F.pmod(k, F.lit(12)).cast("int") + 1)
    given = lambda k: F.when(at(k + 7) > share * at(k), share * at(k + 7) / (at(k) + 1e-9) * at(k)).otherwise(0.0)
    moved = F.transform(p, lambda x, k: F.greatest(x - given(k) + given(k + 7), F.lit(0.0)))
    return F.when(V.total(moved) > 1e-9, F.transform(moved, lambda x: x / V.total(moved))).otherwise(p)


def interpolate(x: Column, points: list[tuple[float, float]]) -> Column:
    """Piecewise-linear value through ``points`` in order of their first numbers; flat outside them."""
    out = F.when(x <= points[0][0], F.lit(points[0][1]))
    for (a, u), (b, v) in zip(points, points[1:], strict=False):
        out = out.when(x <= b, F.lit(u) + (x - a) * ((v - u) / (b - a)))
    return out.when(x.isNotNull(), F.lit(points[-1][1]))


def pattern_symbol(degree: Column, q: Column, fold: bool, coarse: bool) -> Column:
    """A chord as a symbol of a pattern alphabet: its degree and quality, with dominants a tritone apart made one (``fold``)
    and qualities told as families (``coarse``)."""
    told = F.coalesce(lookup({x: f for f, xs in PATTERN_FAMILIES.items() for x in xs}, q), F.lit("?")) if coarse else q
    plain = F.concat_ws(" ", degree.cast("string"), told)
    return F.when(q.isin("dom7", "aug7"), F.concat_ws(" ", F.pmod(degree, F.lit(6)).cast("string"), F.lit("DOM"))).otherwise(plain) if fold else plain


PATTERN_FAMILIES = {
    "M": ["majT", "maj7", "dom7"], "m": ["minT", "min7", "minmaj7"], "d": ["dimT", "dim7", "m7b5"], "A": ["augT", "aug7", "augmaj7"], "s": ["susT", "7sus4"],
}
