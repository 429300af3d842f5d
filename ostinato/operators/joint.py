"""Joint decoding of roots and classes over segments: few candidate roots a segment, a scale-relative transition prior, user constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostinato.operators import lattice as L
from ostinato.operators.blocks import join_same

# Classes major, minor, dominant, half-diminished, diminished; the family of each among the five families
# (major, minor, diminished, augmented, suspended) by which the states of the prior are numbered.
CLASSES, FAMILIES = 5, 5
FAMILY_OF = [0, 1, 0, 2, 2]
# What a confirmed chord adds to its states, what puts the greedy class before the others, and the least posterior.
CLAMP, ANCHOR, FLOOR = 40.0, 1e-3, 1e-12


def _largest(x: Column) -> Column:
    return F.array_max(x)


def candidates(posterior: Column, k: int) -> Column:
    """The ``k`` likeliest pitch classes, the higher one first among equals."""
    by = F.transform(posterior, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    return F.transform(F.slice(F.sort_array(by, asc=False), 1, k), lambda x: x["i"])


def emissions(segments: DataFrame, keys: list[str], order: list[str], k: int = 3) -> DataFrame:
    """keys, order, roots (the candidates) and scores (five classes for each of them), with tonic and tie.

    ``segments`` has posterior (12 numbers, in any unit; all zeros count as equal), class_logp (12 lists of 5 log-probabilities, by root),
    greedy (12 class indices by root, null for none) and perhaps clamp_root, clamp_class, clamp_bonus and tie. A greedy class that isn't its root's
    largest is raised just above it. A clamped root is a candidate whatever its posterior; its states (all of its classes where clamp_class is null)
    gain the bonus. Segments of a sequence that share a ``tie`` get the union of their candidates, in ascending order, and the sum of
    their scores.
    """
    have = set(segments.columns)
    col = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind)
    d = segments.withColumns({"clamp_root": F.pmod(col("clamp_root", "int"), F.lit(12)), "clamp_class": col("clamp_class", "int"), "clamp_bonus": F.coalesce(col("clamp_bonus", "double"), F.lit(CLAMP)), "tie": col("tie", "long")})
    total = F.aggregate("posterior", F.lit(0.0), lambda a, x: a + x)
    d = d.withColumn("_p", F.when(total > 1e-9, F.transform("posterior", lambda x: x / total)).otherwise(F.array_repeat(F.lit(1.0 / 12), 12)))
    d = d.withColumn("roots", candidates(F.col("_p"), k))
    d = d.withColumn("roots", F.when(F.col("clamp_root").isNull() | F.array_contains("roots", F.col("clamp_root")), F.col("roots")).otherwise(F.concat("roots", F.array("clamp_root"))))
    tied = d.filter("tie is not null").groupBy(*keys, "tie").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("roots")))).alias("_union"))
    d = join_same(d, tied, [*keys, "tie"], "left").withColumn("roots", F.coalesce("_union", "roots"))

    def of_root(r: Column) -> Column:
        logp, greedy = F.col("class_logp")[r], F.col("greedy")[r]
        first = F.array_position(logp, _largest(logp)) - 1
        raised = F.transform(logp, lambda x, q: F.when((q == greedy) & (first != greedy), _largest(logp) + ANCHOR).otherwise(x))
        base = F.log(F.greatest(F.col("_p")[r], F.lit(FLOOR)))
        clamp = lambda q: F.when((r == F.col("clamp_root")) & (F.col("clamp_class").isNull() | (F.col("clamp_class") == q)), F.col("clamp_bonus")).otherwise(0.0)
        return F.transform(raised, lambda x, q: base + x + clamp(q))

    d = d.withColumn("scores", F.flatten(F.transform("roots", of_root)))
    place = F.posexplode("scores").alias("_i", "_s")
    pooled = d.filter("tie is not null").select(*keys, "tie", place).groupBy(*keys, "tie", "_i").agg(F.sum("_s").alias("_s"))
    pooled = pooled.groupBy(*keys, "tie").agg(F.sort_array(F.collect_list(F.struct("_i", "_s"))).alias("_x")).select(*keys, "tie", F.col("_x._s").alias("_pooled"))
    d = join_same(d, pooled, [*keys, "tie"], "left")
    return d.select(*keys, *order, "roots", F.coalesce("_pooled", "scores").alias("scores"), "tonic", "tie")


def labels(roots: Column, tonic: Column) -> Column:
    """The prior's state of each (root, class): the degree above the tonic by the class's family."""
    family = F.array(*map(F.lit, FAMILY_OF))
    return F.flatten(F.transform(roots, lambda r: F.transform(family, lambda f: F.pmod(r - tonic, F.lit(12)) * FAMILIES + f)))


def joint_decode(segments: DataFrame, keys: list[str], order: list[str], prior: list[list[float]], k: int = 3, weight: float = 1.0) -> DataFrame:
    """keys, order, root, class, confidence, roots and marginals of every segment: the best path over its states, and their posteriors.

    A segment's states are its candidate roots by the five classes, scored by :func:`emissions`; ``prior`` holds log P(next | previous) of
    60 scale-relative states, times ``weight``, each segment being taken relative to its own ``tonic``. Segments that share a ``tie`` take the state of
    their largest summed score. ``confidence`` is the marginal probability of the chosen state; ``marginals`` follow ``roots``, five a root.
    Order values are unique in a sequence; other columns are dropped.
    """
    found = emissions(segments, keys, order, k).withColumn("labels", labels(F.col("roots"), F.col("tonic")))
    steps = L.Steps([[weight * x for x in row] for row in prior])
    out = L.solved(found, keys, order, steps, "labels", "scores", ["roots", "scores", "tie"], shares=True)
    choice = F.when(F.col("tie").isNull(), F.col("choice")).otherwise(F.array_position("scores", F.array_max("scores")).cast("int") - 1)
    out = out.withColumn("choice", choice)
    return out.select(
        *keys,
        *order,
        F.col("roots")[F.expr(f"choice div {CLASSES}").cast("int")].alias("root"),
        (F.col("choice") % CLASSES).alias("class"),
        F.col("marginals")[F.col("choice")].alias("confidence"),
        "roots",
        "marginals",
    )
