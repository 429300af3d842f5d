"""Charts written out: a token for every bar played."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.functions.tokens import SHARPS


def played_bars(chords: DataFrame, chart: str = "chart") -> DataFrame:
    """(chart, section, rep, bar, token) of every bar played, from chords (chart, section, letter, reps, bar, beat, root, q).

    A bar's chords stand in order of beat, with a space between; a bar whose rows all have no root and no q ``N`` is held
    (``x``), one whose only chord is ``N`` has none (``n``). The first bar of a section bears ``*`` and the first letter of its
    label (A where it has none). Sections are unrolled: ``reps`` times, once where it is null or less. The result has a row a bar, so that no chart is gathered.
    """
    name = F.when(F.col("q") == "N", "n").otherwise(F.concat(F.get(F.array(*map(F.lit, SHARPS)), F.pmod("root", F.lit(12)).cast("int")), F.coalesce("q", F.lit(""))))
    bars = chords.groupBy(chart, "section", "bar").agg(
        F.max("letter").alias("letter"), F.max("reps").alias("reps"), F.array_sort(F.collect_list(F.when(name.isNotNull(), F.struct("beat", name.alias("name"))))).alias("names")
    )
    first = chords.groupBy(chart, "section").agg(F.min("bar").alias("bar")).withColumn("first", F.lit(True))
    marked = bars.join(first, [chart, "section", "bar"], "left")
    mark = F.when(F.col("first"), F.concat(F.lit("*"), F.coalesce(F.nullif(F.substring("letter", 1, 1), F.lit("")), F.lit("A")))).otherwise("")
    token = F.concat(mark, F.coalesce(F.nullif(F.array_join("names.name", " "), F.lit("")), F.lit("x")))
    rep = F.explode(F.sequence(F.lit(1), F.greatest(F.coalesce("reps", F.lit(1)), F.lit(1)).cast("int")))
    return marked.select(chart, "section", "bar", token.alias("token"), rep.alias("rep"))
