"""Triads and the scales that they belong to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ostinato.functions.qualities import lookup
from ostinato.functions.tokens import MAJOR_SCALE

# The harmonic minor scale, and the triads by third and fifth.
HARMONIC_MINOR = [0, 2, 3, 5, 7, 8, 11]
TRIADS = {(4, 7): "maj", (3, 7): "min", (3, 6): "dim", (4, 8): "aug"}


def stacked_thirds(scale: list[int]) -> dict[int, str]:
    """The triad on each step of a scale of pitch classes, made of every second step."""
    n = len(scale)
    third = {s: ((scale[(i + 2) % n] - s) % 12, (scale[(i + 4) % n] - s) % 12) for i, s in enumerate(scale)}
    return {s: TRIADS.get(x, "other") for s, x in third.items()}


def triad(tones: Column) -> Column:
    """maj, min, dim or aug by the third and fifth among a chord's tones above its root; sus with a fifth and no third, else other.

    Sevenths and extensions don't count; null tones give null.
    """
    has = {k: F.array_contains(tones, k) for k in (3, 4, 6, 7, 8)}
    out = F.when(tones.isNull(), F.lit(None))
    for (third, fifth), name in TRIADS.items():
        out = out.when(has[third] & has[fifth], name)
    return out.when(has[7] & ~has[3] & ~has[4], "sus").otherwise("other")


def membership(interval: Column, kind: Column, minor: Column) -> Column:
    """Where a triad, ``interval`` above the song's tonic, belongs: diatonic_own, parallel_borrow, harmonic_minor_borrow, sus or chromatic.

    Own is the major scale on the tonic, or for ``minor`` the one three semitones above; the other of the two is the
    parallel. Both are looked at before harmonic minor on the tonic. Null where any input is.
    """
    at = F.pmod(interval, F.lit(12)).cast("int")
    major, harmonic = stacked_thirds(MAJOR_SCALE), stacked_thirds(HARMONIC_MINOR)
    on_tonic, above = lookup(major, at), lookup(major, F.pmod(at - 3, F.lit(12)).cast("int"))
    known = interval.isNotNull() & kind.isNotNull() & minor.isNotNull()
    is_ = lambda c: F.coalesce(c == kind, F.lit(False))
    return (
        F.when(~known, F.lit(None)).when(kind == "sus", "sus").when(is_(F.when(minor, above).otherwise(on_tonic)), "diatonic_own")
        .when(is_(F.when(minor, on_tonic).otherwise(above)), "parallel_borrow").when(is_(lookup(harmonic, at)), "harmonic_minor_borrow").otherwise("chromatic")
    )
