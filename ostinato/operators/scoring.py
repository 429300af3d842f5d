"""Scores of chord hypotheses: templates, Gaussians over rotations, agreement of distributions, and windows of encoded chords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ostinato.functions.vectors import bound
from ostinato.operators.blocks import join_same, tasks_for
from ostinato.operators.sequences import ordered

_PLACES = 12  # scores that agree to so many places are equal


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def best_template(chroma: Column, templates: list[list[float]]) -> Column:
    """struct(root, family, score) of the best of 12 rotations of each family's template (12 numbers): the dot product with the chroma scaled to length 1.

    Of scores that agree to twelve places the lower root, then the first family wins; a chroma that is null or shorter than 1e-9 has root 0, family 0 and score 0.
    """

    def best(unit: Column) -> Column:
        every = []
        for r in range(12):
            for f, t in enumerate(templates):
                turned = F.array(*[F.lit(float(t[(k - r) % 12])) for k in range(12)])
                every.append(F.struct(_sum(F.zip_with(unit, turned, lambda a, b: a * b)).alias("score"), F.lit(-r).alias("r"), F.lit(-f).alias("f")))
        ranked = F.transform(F.array(*every), lambda x: F.struct(F.round(x["score"], _PLACES).alias("by"), x["r"].alias("r"), x["f"].alias("f"), x["score"].alias("score")))
        return bound(F.array_max(ranked), lambda top: F.struct((-top["r"]).alias("root"), (-top["f"]).alias("family"), top["score"].alias("score")))

    none = F.struct(F.lit(0).alias("root"), F.lit(0).alias("family"), F.lit(0.0).alias("score"))
    length = F.sqrt(_sum(F.transform(chroma, lambda x: x * x)))
    found = lambda s: F.when(s["n"] >= 1e-9, bound(F.transform(s["x"], lambda x: x / s["n"]), best)).otherwise(none)
    return bound(F.struct(chroma.alias("x"), length.alias("n")), found)


def rotation_likelihoods(chroma: Column, means: list[list[float]], deviations: list[list[float]]) -> Column:
    """Log-likelihoods of a chroma under diagonal Gaussians of each family in every rotation: an array by family of arrays by root, without the
    constant. Root r turns the chroma down by r classes."""
    families = []
    for mu, sd in zip(means, deviations, strict=True):
        m, s = (F.array(*[F.lit(float(x)) for x in v]) for v in (mu, sd))
        logs = _sum(F.transform(s, lambda x: F.log(x)))
        turned = lambda r: F.concat(F.slice(chroma, r + 1, 12 - r), F.slice(chroma, 1, r)) if r else chroma
        z = lambda r: F.zip_with(F.zip_with(turned(r), m, lambda a, b: a - b), s, lambda a, b: a / b)
        families.append(F.array(*[-0.5 * _sum(F.transform(z(r), lambda x: x * x)) - logs for r in range(12)]))
    return F.array(*families)


def agreement(df: DataFrame, keys: list[str], distribution: str, weight: str | None = None) -> DataFrame:
    """(keys, agreement, n): the largest number in the mean of a group's distributions, weighted where a weight is given; 1 where all agree on one class.
    Weights that sum to nothing give 0."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    cells = df.select(*keys, w.alias("_w"), F.posexplode(distribution).alias("_i", "_x"))
    sums = cells.groupBy(*keys, "_i").agg(F.sum(F.col("_w") * F.col("_x")).alias("_s"))
    total = df.select(*keys, w.alias("_w")).groupBy(*keys).agg(F.sum("_w").alias("_t"), F.count("*").alias("n"))
    top = sums.groupBy(*keys).agg(F.max("_s").alias("_top"))
    share = F.col("_top") / (F.col("_t") + 1e-9 if weight else F.col("_t"))
    return join_same(total, top, keys, "left").select(*keys, share.alias("agreement"), "n")


def window_block(df: DataFrame, keys: list[str], order: list[str], degree: str, mode: str, reach: int = 4) -> DataFrame:
    """``df`` with ``block``: for each row from ``reach`` before to ``reach`` after, twelve numbers with a one at its degree and one for its mode (0 or 1), zeros
    beyond the ends and for null degrees."""
    df = df.repartition(tasks_for(df), *keys)  # a task holds the same memory whatever the table's size
    w = ordered(keys, order)
    parts = []
    for k in range(-reach, reach + 1):
        there = F.lead(F.struct(F.pmod(F.col(degree), F.lit(12)).alias("d"), F.col(mode).cast("double").alias("m")), k).over(w) if k else F.struct(F.pmod(F.col(degree), F.lit(12)).alias("d"), F.col(mode).cast("double").alias("m"))
        ones = [F.coalesce((there["d"] == i).cast("double"), F.lit(0.0)) for i in range(12)]
        parts += [*ones, F.when(there["d"].isNotNull(), F.coalesce(there["m"], F.lit(0.0))).otherwise(0.0)]
    return df.withColumn("block", F.array(*parts))


def first_of_sources(sources: list[DataFrame], keys: list[str], name: str, most: int | None = None) -> DataFrame:
    """Rows of several sources of one shape as one, with ``source`` (from 0): of rows whose lower-cased names agree the one of the first source counts, the
    first by its other columns among several. With ``most``, so many of each of ``keys`` (a top-k report), by source, then name. Null names are one name."""
    both = None
    for i, s in enumerate(sources):
        part = s.withColumn("source", F.lit(i))
        both = part if both is None else both.unionByName(part)
    rest = sorted(c for c in both.columns if c not in (*keys, "source"))
    w = Window.partitionBy(*keys, F.lower(name)).orderBy("source", *rest)
    out = both.withColumn("_k", F.row_number().over(w)).filter("_k = 1")
    if most is not None:
        out = out.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("source", name, *rest))).filter(F.col("_k") <= most)
    return out.drop("_k")
