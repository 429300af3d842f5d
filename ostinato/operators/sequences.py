"""Ordered-sequence operators: runs, fills, neighbours, grids and change functions.

``keys`` name the columns of a sequence (a song, a session), ``order`` those that order its rows
without ties. Every window is partitioned by the keys, so one shuffle serves a chain of operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ostinato.functions import vectors as V


def ordered(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def backwards(keys: list[str], order: list[str]) -> WindowSpec:
    """All rows from a sequence's end to the current one: a ``last`` over it looks forward, and costs one step a row."""
    return Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)


def run_ids(df: DataFrame, keys: list[str], order: list[str], same: list[str], out: str = "run") -> DataFrame:
    """Number the runs of rows that agree on ``same``, from 1; nulls agree with nulls."""
    w = ordered(keys, order)
    changed = F.lit(False)
    for c in same:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    first = F.row_number().over(w) == 1
    flagged = df.withColumn("_new", (first | changed).cast("int"))
    return flagged.withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def compress(df: DataFrame, keys: list[str], order: list[str], same: list[str], **carried: Column) -> DataFrame:
    """One row per run: keys, run, the agreed columns, n_rows and the ``carried`` aggregates."""
    runs = run_ids(df, keys, order, same)
    return runs.groupBy(*keys, "run", *same).agg(F.count("*").alias("n_rows"), *[c.alias(n) for n, c in carried.items()])


def duration_weighted(value: Column, duration: Column) -> Column:
    """Aggregate: mean of ``value`` weighted by ``duration``; null without any duration."""
    return F.sum(value * duration) / F.sum(F.when(value.isNotNull(), duration))


def fill_forward(df: DataFrame, keys: list[str], order: list[str], column: str, out: str, max_gap: int | None = None) -> DataFrame:
    """The last value seen; with ``max_gap`` only over so many rows."""
    w = ordered(keys, order).rowsBetween(Window.unboundedPreceding if max_gap is None else -max_gap, 0)
    return df.withColumn(out, F.last(column, ignorenulls=True).over(w))


def with_next(df: DataFrame, keys: list[str], order: list[str], **columns: str) -> DataFrame:
    """Each row with the next row's values: ``new=old`` adds new as the following row's old."""
    w = ordered(keys, order)
    return df.withColumns({new: F.lead(old).over(w) for new, old in columns.items()})


def durations(df: DataFrame, keys: list[str], order: list[str], onset: str, out: str = "duration") -> DataFrame:
    """Time to the next onset; null for the last row."""
    return df.withColumn(out, F.lead(onset).over(ordered(keys, order)) - F.col(onset))


def on_grid(df: DataFrame, keys: list[str], beat: str, grid: int) -> DataFrame:
    """Segments of ``grid`` beats: keys, segment, start and end (exclusive)."""
    return df.groupBy(*keys, F.floor(F.col(beat) / grid).alias("segment")).agg(F.min(beat).alias("start"), (F.max(beat) + 1).alias("end"))


def harmonic_grid(df: DataFrame, keys: list[str], beat: str, symbol: str, agreement: float = 0.65) -> DataFrame:
    """2 or 4 beats per sequence: 4 if neighbouring pairs of beats agree with the pair after often enough.

    A pair agrees if its first symbols are equal; the share must exceed ``agreement``. A sequence
    without two pairs has share 0 and grid 2.
    """
    pairs = df.groupBy(*keys, F.floor(F.col(beat) / 2).alias("pair")).agg(F.min_by(symbol, beat).alias("symbol"))
    follow = pairs.withColumn("next", F.lead("symbol").over(ordered(keys, ["pair"]))).filter("pair % 2 = 0")
    share = F.coalesce(F.avg((F.col("symbol") == F.col("next")).cast("double")), F.lit(0.0))
    return follow.groupBy(*keys).agg(share.alias("agreement")).withColumn("grid", F.when(F.col("agreement") > agreement, 4).otherwise(2))


def harmonic_change(df: DataFrame, keys: list[str], order: list[str], chroma: str, out: str = "change") -> DataFrame:
    """Distance between the tonal centroids of successive rows; 0 for the first row."""
    w = ordered(keys, order)
    df = df.withColumn("_c", V.tonal_centroid(F.col(chroma)))
    return df.withColumn(out, F.coalesce(V.distance(F.col("_c"), F.lag("_c").over(w)), F.lit(0.0))).drop("_c")


def modulations(df: DataFrame, keys: list[str], order: list[str], key: str, confidence: str, least: float = 0.6) -> DataFrame:
    """Rows at which the key changes against the last accepted row; a row is accepted if it is the first
    or confident enough."""
    w = ordered(keys, order)
    accepted = df.withColumn("_first", F.row_number().over(w) == 1).filter(F.col("_first") | (F.col(confidence) >= least))
    accepted = accepted.withColumn("previous_key", F.lag(key).over(w))
    return accepted.filter(F.col("previous_key").isNotNull() & (F.col("previous_key") != F.col(key))).drop("_first")


def churn(df: DataFrame, keys: list[str], order: list[str], symbol: str) -> DataFrame:
    """Number of changes of ``symbol`` per sequence."""
    w = ordered(keys, order)
    flagged = df.withColumn("_x", (F.lag(symbol).over(w) != F.col(symbol)).cast("long"))
    return flagged.groupBy(*keys).agg(F.coalesce(F.sum("_x"), F.lit(0)).alias("changes"))


def split_at(intervals: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals (start, end), which don't overlap, split at the positions ``at`` that lie inside them; cutting again changes
    nothing. A cut is looked up as of the last start, so cuts and intervals of a key aren't paired."""
    from ostinato.operators.joins import as_of

    held = intervals.select(*keys, F.col("start").alias("at"), F.col("start").alias("_from"), F.col("end").alias("_until"))
    inside = as_of(cuts.select(*keys, "at").distinct(), held, keys, "at", ["_from", "_until"]).filter("at > _from and at < _until")
    pieces = intervals.select(*keys, "start", F.col("end").alias("_until")).union(inside.select(*keys, "at", "_until")).distinct()
    ahead = F.lead("start").over(Window.partitionBy(*keys, "_until").orderBy("start"))
    return pieces.select(*keys, "start", F.coalesce(ahead, F.col("_until")).alias("end"))


def bars_and_beats(df: DataFrame, keys: list[str], order: list[str], duration: str, beats_per_bar: int) -> DataFrame:
    """Bar and beat of each row from the running sum of durations before it."""
    before = F.coalesce(F.sum(duration).over(ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    df = df.withColumn("_at", before)
    return df.withColumns({"bar": F.floor(F.col("_at") / beats_per_bar).cast("long"), "beat": F.col("_at") % beats_per_bar}).drop("_at")


def changepoint_score(df: DataFrame, keys: list[str], order: list[str], values: list[str], window: int = 4, out: str = "evidence") -> DataFrame:
    """Evidence of a change at each row: the squared deviation of the rows around it from their mean, less that of
    the two sides on their own, over all ``values``; 0 where a side has under two rows. From sums over row frames."""
    w = ordered(keys, order)
    frames = {"left": w.rowsBetween(-window, -1), "right": w.rowsBetween(0, window - 1), "both": w.rowsBetween(-window, window - 1)}

    def error(frame):
        parts = []
        for v in values:
            x = F.col(v).cast("double")
            n = F.count(x).over(frame)
            parts.append(F.when(n > 0, F.sum(x * x).over(frame) - F.pow(F.sum(x).over(frame), 2) / n).otherwise(0.0))
        return sum(parts[1:], parts[0])

    enough = (F.count("*").over(frames["left"]) >= 2) & (F.count("*").over(frames["right"]) >= 2)
    return df.withColumn(out, F.when(enough, error(frames["both"]) - error(frames["left"]) - error(frames["right"])).otherwise(0.0))


def prune_boundaries(df: DataFrame, keys: list[str], order: list[str], values: list[str], boundary: str, least: float = 0.1) -> DataFrame:
    """Rows flagged in ``boundary`` whose evidence of a change reaches ``least``; a sequence's first row always stays."""
    scored = changepoint_score(df, keys, order, values, out="_e").withColumn("_n", F.row_number().over(ordered(keys, order)))
    return scored.filter(F.col(boundary) & ((F.col("_n") == 1) | (F.col("_e") >= least))).drop("_e", "_n")
