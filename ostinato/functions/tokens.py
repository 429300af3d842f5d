"""Chord tokens as columns: parsing, spelling, chord tones, classes and keys.

A token is a root letter with an accidental, a quality tail and perhaps a slash bass: ``Bb-7/F``.
Pitch classes run from 0 (C) to 11, -1 stands for no chord.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ostinato.functions import vectors as V

# Spellings, scales and key profiles in general use.
SHARPS = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
FLATS = ["C", "Db", "D", "Eb", "E", "F", "Gb", "G", "Ab", "A", "Bb", "B"]
MAJOR_NAMES = FLATS
MINOR_NAMES = ["C", "C#", "D", "Eb", "E", "F", "F#", "G", "G#", "A", "Bb", "B"]
LETTERS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}
FLAT_MAJORS = [0, 1, 3, 5, 6, 8, 10]
MAJOR_SCALE = [0, 2, 4, 5, 7, 9, 11]
MINOR_SCALE = [0, 2, 3, 5, 7, 8, 10, 11]
MELODIC_MINOR = [0, 2, 3, 5, 7, 9, 11]
MAJOR_PROFILE = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR_PROFILE = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]

HARTE_QUALITIES = [
    "maj", "min", "dim", "aug", "sus2", "sus4", "maj7", "min7", "7", "dom7", "minmaj7", "hdim7", "dim7", "aug7", "7sus4", "maj9", "min9", "9", "7b9", "7#9", "maj6", "min6", "1",
]


def _strings(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def mask_of(classes: list[int], tonic: int = 0) -> int:
    """Pitch classes, moved up by ``tonic``, as bits of an integer."""
    return sum(1 << (c + tonic) % 12 for c in classes)


def _pitch(head: Column) -> Column:
    """Pitch class of a spelled root, null unless it begins with one."""
    letter, accidental = F.regexp_extract(head, "^([A-G])", 1), F.regexp_extract(head, "^[A-G]([b#])", 1)
    base = F.coalesce(*[F.when(letter == k, F.lit(v)) for k, v in LETTERS.items()])
    return F.pmod(base + F.when(accidental == "b", -1).when(accidental == "#", 1).otherwise(0), F.lit(12))


def parse(token: Column) -> Column:
    """struct(root, quality, bass) of a token; one that doesn't parse is (0, '', null)."""
    return V.bound(token, _parse)


def _parse(token: Column) -> Column:
    head, slash = F.trim(F.substring_index(token, "/", 1)), F.instr(token, "/")
    root = _pitch(head)
    bass = F.when(slash > 0, _pitch(F.trim(F.substring(token, slash + 1, F.length(token)))))
    known = root.isNotNull()
    return F.struct(
        F.coalesce(root, F.lit(0)).cast("int").alias("root"),
        F.when(known, F.regexp_extract(head, "^[A-G][b#]?(.*)$", 1)).otherwise("").alias("quality"),
        F.when(known, bass).cast("int").alias("bass"),
    )


def harte(label: Column) -> Column:
    """struct(root, quality, bass) of a ``C:min7/b3`` label.

    N, NC and no_chord have root -1; X and ?, and labels that begin with no note, have none. The quality is
    lower-cased, one of HARTE_QUALITIES, and maj where it is missing or unknown; the bass is what follows a slash.
    """
    text = F.trim(label)
    root = _pitch(F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1)))
    tail = F.lower(F.regexp_extract(text, "^[A-Ga-g][b#]?:([^/(]+)", 1))
    known = F.when(text.isin("N", "n", "NC", "no_chord"), -1).when(text.isin("X", "x", "?"), F.lit(None)).otherwise(root).cast("int")
    return F.struct(
        known.alias("root"), F.when(tail.isin(HARTE_QUALITIES), tail).otherwise("maj").alias("quality"), F.nullif(F.regexp_extract(text, "/(.*)$", 1), F.lit("")).alias("bass")
    )


def bass_class(label: Column) -> Column:
    """Pitch class of a label's bass: a scale degree such as b3 counted from the root, a spelled note, or the root."""
    h = harte(label)
    degree = F.regexp_extract(h["bass"], "([0-9]+)", 1).try_cast("int")
    steps = F.array(*[F.lit(x) for x in MAJOR_SCALE])
    shift = F.length(F.regexp_extract(h["bass"], "^(#*)", 1)) - F.length(F.regexp_extract(h["bass"], "^(b*)", 1))
    above = F.element_at(steps, (F.pmod(degree - 1, F.lit(7)) + 1).cast("int")) + shift
    return F.when(h["root"] < 0, -1).otherwise(F.coalesce(F.pmod(h["root"] + above, F.lit(12)), _pitch(h["bass"]), h["root"])).cast("int")


def split_measure(measure: Column) -> Column:
    """Tokens of a measure: each begins at a capital letter of a root (or N or W) that doesn't follow a slash."""
    return F.regexp_extract_all(measure, F.lit(r"((?<!/)[A-GNWn](?:[^A-GNW/]|/[A-G]?)*)"), F.lit(1))


def transpose(token: Column, by: Column | int, flats: Column) -> Column:
    """The token moved up by semitones; root and bass are spelled with flats or sharps."""
    p, by = parse(token), F.lit(by) if isinstance(by, int) else by
    name = lambda pc: F.when(flats, F.element_at(_strings(FLATS), F.pmod(pc + by, F.lit(12)) + 1)).otherwise(F.element_at(_strings(SHARPS), F.pmod(pc + by, F.lit(12)) + 1))
    return F.concat(name(p["root"]), p["quality"], F.when(p["bass"].isNull(), "").otherwise(F.concat(F.lit("/"), name(F.coalesce(p["bass"], F.lit(0))))))


def prefers_flats(tonic: Column, mode: Column) -> Column:
    """Whether a key is spelled with flats, by its own or its relative major."""
    return F.pmod(F.when(mode == "major", tonic).otherwise(tonic + 3), F.lit(12)).isin(FLAT_MAJORS)


def key_name(tonic: Column, mode: Column) -> Column:
    at = F.pmod(tonic, F.lit(12)) + 1
    return F.concat_ws(" ", F.when(mode == "major", F.element_at(_strings(MAJOR_NAMES), at)).otherwise(F.element_at(_strings(MINOR_NAMES), at)), mode)


def key_index(tonic: Column, mode: Column) -> Column:
    """0..11 for major keys, 12..23 for minor ones."""
    return F.pmod(tonic, F.lit(12)) + F.when(mode == "major", 0).otherwise(12)


def collection_of(key: Column) -> Column:
    """The major key whose scale a key index shares."""
    return F.when(key < 12, key).otherwise(F.pmod(key - 12 + 3, F.lit(12)))


def parse_key(text: Column) -> Column:
    """struct(tonic, mode) of ``Eb``, ``G-``, ``A minor``, ``F#:min``; null unless it begins with a note."""
    minor = text.rlike(r"^[A-G][b#]?\s*(-|m$|:?\s*min)")
    return F.when(_pitch(text).isNotNull(), F.struct(_pitch(text).cast("int").alias("tonic"), F.when(minor, "minor").otherwise("major").alias("mode")))


def quality_class(q: Column) -> Column:
    """maj, m7b5, dim, min, dom or sus; the tests hold in this order."""
    return V.bound(q, _quality_class)


def _quality_class(q: Column) -> Column:
    minor, seventh = q.startswith("-") | q.startswith("m"), q.contains("7")
    return (
        F.when((q == "") | q.startswith("^") | q.startswith("6") | q.contains("maj") | q.startswith("M"), "maj")
        .when(q.startswith("h") | q.contains("m7b5") | q.contains("-7b5") | (minor & q.contains("b5")), "m7b5")
        .when(q.startswith("o") | q.contains("dim"), "dim")
        .when(minor | q.contains("min"), "min")
        .when(q.startswith("sus"), F.when(seventh | q.contains("9") | q.contains("13"), "dom").otherwise("sus"))
        .when(q.startswith("+"), F.when(seventh, "dom").otherwise("maj"))
        .otherwise("dom")
    )


def _relative_tones(q: Column) -> dict[int, tuple[Column, Column]]:
    """For each interval above the root whether it sounds, and its weight."""
    sus, low = q.startswith("sus"), q.startswith("o") | q.startswith("dim") | q.startswith("h")
    two = q.contains("2")
    small = q.startswith("-") | q.startswith("h") | q.startswith("o") | q.startswith("dim") | q.startswith("m")
    raised = q.startswith("+") | q.startswith("aug")
    flat5 = ~sus & (low | q.contains("b5"))
    sharp5 = ~sus & ~flat5 & (raised | q.contains("#5"))
    major7 = q.contains("^") | q.contains("maj7") | q.contains("M7")
    dim7 = ~major7 & (q.startswith("o") | q.startswith("dim")) & q.contains("7")
    sixth = ~major7 & ~dim7 & q.contains("6") & ~q.contains("b6")
    minor7 = ~major7 & ~dim7 & ~sixth & (q.contains("7") | q.startswith("-") | q.startswith("h") | q.startswith("m"))
    one, third, colour = F.lit(1.0), F.lit(1.5), F.lit(0.8)
    return {
        0: (F.lit(True), F.lit(2.0)),
        2: (sus & two, one),
        3: (~sus & small, third),
        4: (~sus & ~small, third),
        5: (sus, F.when(two, 0.0).otherwise(1.0)),
        6: (flat5, one),
        7: (sus | (~flat5 & ~sharp5), one),
        8: (sharp5, one),
        9: (dim7 | sixth, colour),
        10: (minor7, colour),
        11: (major7, colour),
    }


def chord_weights(root: Column, quality: Column, bass: Column | None = None) -> Column:
    """Weights of the 12 pitch classes; the bass, where there is one, adds 1."""

    def relative(q):
        tones = _relative_tones(q)
        return F.array(*[F.when(tones[i][0], tones[i][1]).otherwise(0.0) if i in tones else F.lit(0.0) for i in range(12)])

    out = V.bound(V.bound(quality, relative), lambda v: V.rotate(v, F.pmod(-root, F.lit(12))))
    if bass is None:
        return out
    return F.transform(out, lambda w, i: w + F.when(bass.isNotNull() & (bass == i), 1.0).otherwise(0.0))


def chord_mask(root: Column, quality: Column) -> Column:
    """The chord's own pitch classes as bits."""
    relative = V.bound(quality, lambda q: sum((F.when(on, 1 << i).otherwise(0) for i, (on, _) in _relative_tones(q).items()), F.lit(0)))
    return V.bound(F.struct(relative.alias("m"), root.alias("r")), lambda x: rotate_mask(x["m"], x["r"]))


def rotate_mask(mask: Column, by: Column) -> Column:
    """Bits moved up by semitones, going round."""
    return F.expr("0").bitwiseOR((mask * F.pow(F.lit(2), by).cast("int")).bitwiseAND(4095)).bitwiseOR((mask * F.pow(F.lit(2), by).cast("int") / 4096).cast("int"))


def jaccard_distance(a: Column, b: Column) -> Column:
    """1 less the Jaccard similarity of two pitch-class masks: 0 for two empty ones, 1 for one."""
    union = F.bit_count(a.bitwiseOR(b))
    return F.when(union == 0, 0.0).otherwise(1.0 - F.bit_count(a.bitwiseAND(b)) / union)


def fifths_distance(a: Column, b: Column) -> Column:
    """Steps between two keys on the circle of fifths."""
    d = F.abs(F.pmod(a * 7, F.lit(12)) - F.pmod(b * 7, F.lit(12)))
    return F.least(d, 12 - d)


def family_distance(root_a: Column, family_a: Column, root_b: Column, family_b: Column) -> Column:
    """0 for the same root and family, 0.4 for the same root, 1 otherwise."""
    return F.when(root_a != root_b, 1.0).when(family_a != family_b, 0.4).otherwise(0.0)


def key_scores(chroma: Column) -> Column:
    """Log-likelihood of a chroma (counts, not shares) under each of the 24 keys."""
    import math

    rows = []
    for profile in (MAJOR_PROFILE, MINOR_PROFILE):
        whole = sum(profile)
        rows += [F.array(*[F.lit(math.log(profile[(pc - tonic) % 12] / whole)) for pc in range(12)]) for tonic in range(12)]
    return V.bound(chroma, lambda c: F.transform(F.array(*rows), lambda p: V.dot(p, c)))


def best_key(chroma: Column) -> Column:
    """struct(key, tonic, mode, confidence): the likeliest key, the lowest index on ties."""

    def told(x):
        k = x["k"]
        return F.struct(k.alias("key"), F.pmod(k, F.lit(12)).alias("tonic"), F.when(k < 12, "major").otherwise("minor").alias("mode"), F.element_at(V.softmax(x["s"]), k + 1).alias("confidence"))

    return V.bound(V.bound(key_scores(chroma), lambda s: F.struct(s.alias("s"), V.argmax(s).alias("k"))), told)


def match_grade(root_a: Column, family_a: Column, mask_a: Column, root_b: Column, family_b: Column, mask_b: Column) -> Column:
    """exact, family, mismatch, or gap where a chord is missing."""
    return (
        F.when(root_a.isNull() | root_b.isNull() | (root_a < 0) | (root_b < 0), "gap")
        .when((root_a == root_b) & (mask_a == mask_b), "exact")
        .when((root_a == root_b) & (family_a == family_b), "family")
        .otherwise("mismatch")
    )


def routed_bass(first: Column, second: Column, root: Column) -> Column:
    """The first source's bass, but the second's where the first has none (is negative), and where they differ
    and the second reads the root: that vetoes an inversion which the first claims."""
    return F.when((first < 0) | ((first != second) & (second == root)), second).otherwise(first)


def relative_to_absolute(key: Column, tonic: Column) -> Column:
    """A key index counted from a tonic (0..11 major, 12..23 minor) as an absolute one."""
    return F.pmod(key + tonic, F.lit(12)) + F.when(key >= 12, 12).otherwise(0)
