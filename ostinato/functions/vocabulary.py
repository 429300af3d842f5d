"""Names of chords: tokens turned to normal names, and the numbered vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostinato.functions.qualities import lookup

# The normal name of every written quality.
NORMAL = {
    "": "", "5": "5", "2": "(add9)", "add9": "(add9)", "^": "M7", "^7": "M7", "^9": "M9", "^13": "M13", "^7#11": "M7#11", "^9#11": "M9#11", "^7#5": "M7#5", "6": "6", "69": "69",
    "-": "m", "-6": "m6", "-69": "m69", "-7": "m7", "-9": "m9", "-11": "m11", "-b6": "m#5", "-#5": "m#5", "-^7": "mM7", "-^9": "mM7(add9)", "-7b5": "m7b5", "-7#5": "m7#5",
    "h": "m7b5", "h7": "m7b5", "h9": "m9b5", "o": "dim", "o7": "dim7", "7": "7", "9": "9", "11": "11", "13": "13", "7b9": "7b9", "7#9": "7#9", "7#11": "7#11", "9#11": "9#11",
    "7b5": "7b5", "7#5": "7#5", "+": "aug", "7+": "7#5", "7b13": "7b13", "7#9#5": "7#5#9", "7b9b5": "7b5b9", "7b9#5": "7b9#5", "7b9#9": "7b9", "7b9b13": "7b9b13", "7b9#11": "7b9#11",
    "7#9b5": "7b5#9", "7#9#11": "7#9#11", "7alt": "7alt", "alt": "7alt", "13b9": "13b9", "13#9": "13#9", "13#11": "13#11", "9b5": "9b5", "9#5": "9#5", "sus": "sus4", "7sus": "7sus4",
    "9sus": "9sus4", "13sus": "13sus4", "7susb9": "7susb9", "7b9sus": "7b9sus", "at": "7alt", "7at": "7alt", "o^7": "dim7(addM7)", "7b13sus": "7sus4", "susadd3": "sus4", "7susadd3": "7sus4",
}
# Qualities of the vocabulary by the phase that adds them.
PHASES = {
    1: ["maj", "min", "dim", "aug", "sus2", "sus4", "maj7", "min7", "7", "mMaj7", "ø7", "°7", "augMaj7", "aug7", "7sus4"],
    2: ["maj9", "min9", "9", "7b9", "7#9", "9sus4"],
    3: ["maj9#11", "min11", "7#11", "7b9#11"],
    4: ["maj13", "min13", "13", "13b9"],
}
NOTES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]


def normal_chord(token: Column, valid: list[str] | None = None) -> Column:
    """The normal name of a written chord: ``z`` where it says that there is none, null where it can't be read.

    Marks of repeats that leaked into the token go; a bass alone is a power chord on it. With ``valid`` a quality outside these gives null, and
    a written one among them stands for itself if it has no other name.
    """
    t = F.trim(token)
    bare = F.regexp_replace(F.regexp_replace(t, r"N\d", ""), "[UQSr]+$", "")
    shape = r"^([A-G][b#]?)([^A-G]*?)(?:/([A-G][b#]?))?$"
    root, written, bass = (F.regexp_extract(bare, shape, k) for k in (1, 2, 3))
    written = F.trim(F.regexp_replace(written, "W", ""))
    name = lookup(NORMAL, written)
    if valid is not None:
        name = F.coalesce(name, F.when(written.isin(*valid), written))
        name = F.when((name == "") | name.isin(*valid), name)
    alone = F.regexp_extract(bare, r"^W/([A-G][b#]?)", 1)
    full = F.concat(root, name, F.when(bass != "", F.concat(F.lit("/"), bass)).otherwise(""))
    return F.when(t.isin("n", "N.C.", "p", "W"), "z").when(bare.startswith("W/"), F.when(alone != "", F.concat(alone, F.lit("5")))).when(F.rlike(bare, F.lit(shape)), full)


def root_class(name: Column) -> Column:
    """The pitch class of a normal name's root; null for ``z`` and empty names."""
    letter = lookup({"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}, F.substring(name, 1, 1))
    return F.pmod(letter + F.when(F.substring(name, 2, 1) == "#", 1).when(F.substring(name, 2, 1) == "b", -1).otherwise(0), F.lit(12))


def qualities(phase: int = 1) -> list[str]:
    """Qualities of the vocabulary up to a phase, in order."""
    return [q for p in sorted(PHASES) if p <= phase for q in PHASES[p]]


def size(phase: int = 1) -> int:
    """Chords of the vocabulary, with the one that is none."""
    return 12 * len(qualities(phase)) + 1


def chord_number(root: Column, quality: Column, phase: int = 1) -> Column:
    """A chord's number: by root, then quality; ``N`` is the last. Null for what the vocabulary doesn't have."""
    q = qualities(phase)
    place = lookup({name: i for i, name in enumerate(q)}, quality)
    return F.when(quality == "N", size(phase) - 1).otherwise(F.pmod(root, F.lit(12)) * len(q) + place)


def vocabulary(spark, phase: int = 1) -> DataFrame:
    """(number, root, quality, label) of the whole vocabulary; the last has root -1 and quality and label N."""
    q = qualities(phase)
    n = F.col("id").cast("int")
    names, notes = F.array(*map(F.lit, q)), F.array(*map(F.lit, NOTES))
    root, quality = F.expr(f"id div {len(q)}").cast("int"), F.get(names, (n % len(q)).cast("int"))
    none = n == size(phase) - 1
    d = spark.range(size(phase)).select(n.alias("number"), F.when(none, -1).otherwise(root).alias("root"), F.when(none, "N").otherwise(quality).alias("quality"))
    return d.withColumn("label", F.when(F.col("root") < 0, "N").otherwise(F.concat(F.get(notes, F.col("root")), F.col("quality"))))


# Qualities that evaluation notation writes otherwise than the vocabulary.
EVALUATION = {
    "mMaj7": "minmaj7", "ø7": "hdim7", "°7": "dim7", "augMaj7": "aug", "aug7": "aug", "7sus4": "sus4", "7b9": "7", "7#9": "7", "9sus4": "sus4",
    "maj9#11": "maj9", "7#11": "7", "7b9#11": "7", "13b9": "13",
}


def evaluation_label(label: Column) -> Column:
    """``root:quality`` of a vocabulary label: no or an unknown quality is maj, N stays, and a label without a root is itself with ``:maj``."""
    root = F.regexp_extract(label, "^([CDFGA]#|[A-G])", 1)
    tail = F.substring(label, F.length(root) + 1, F.length(label))
    known = {q: EVALUATION.get(q, q) for q in qualities(4)}
    return F.when(label == "N", "N").when(root == "", F.concat(label, F.lit(":maj"))).otherwise(F.concat(root, F.lit(":"), F.coalesce(lookup(known, tail), F.lit("maj"))))
