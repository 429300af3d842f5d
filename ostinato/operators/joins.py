"""Temporal joins. Each carries equality keys, so none plans as a nested loop.

As-of joins are unions with a window (one shuffle, no range condition); interval joins add a time
bucket to the keys, which bounds the candidates of a row by the intervals near it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of(left: DataFrame, right: DataFrame, keys: list[str], on: str, values: list[str], strict: bool = False, forward: bool = False, span: float | None = None) -> DataFrame:
    """Each left row with the values of the last right row at or before its time.

    ``strict`` leaves out equal times, ``forward`` looks for the first at or after. Of right rows with
    equal times the one with the largest values counts (forward: the smallest). Left rows without a match get nulls.

    Without ``span`` all rows of equal keys are sorted by one task. With it they are dealt out by stretches of so much time, and each stretch begins
    with the value that the nearest stretch before it (forward: after it) ended with, which a small table of one row a stretch tells.
    """
    last = int(strict != forward)  # whether right rows stand after left ones of the same time
    packed = F.struct(*[F.col(v) for v in values])
    r = right.select(*keys, on, packed.alias("_v"), F.lit(0).alias("_left"), F.lit(last).alias("_side"))
    l_ = left.select(*keys, on, F.struct("*").alias("_row"), F.lit(1).alias("_left"), F.lit(1 - last).alias("_side"))
    # Looking forward, the order is turned: a frame that starts at the first row is carried on, row by row.
    turn = F.desc if forward else F.asc
    order = [turn(c) for c in (on, "_side", "_v")]
    both = r.unionByName(l_, allowMissingColumns=True)
    part = list(keys)
    if span is not None:
        both = both.withColumns({"_stretch": F.floor(F.col(on) / F.lit(float(span))), "_began": F.lit(1)})
        part, order = [*keys, "_stretch"], ["_began", *order]
        pick = F.min_by if forward else F.max_by
        ends = both.groupBy(*part).agg(pick("_v", F.when(F.col("_left") == 0, F.struct(on, "_v"))).alias("_v"))
        earlier = Window.partitionBy(*keys).orderBy(turn("_stretch")).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumn("_v", F.last("_v", ignorenulls=True).over(earlier)).filter("_v is not null")
        both = both.unionByName(ends.withColumns({"_left": F.lit(0), "_began": F.lit(0)}), allowMissingColumns=True)
    frame = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_m", F.last("_v", ignorenulls=True).over(frame)).filter("_left = 1")
    return both.select("_row.*", *[F.col("_m")[v].alias(v) for v in values])


def nearest(left: DataFrame, right: DataFrame, keys: list[str], on: str, values: list[str], span: float | None = None) -> DataFrame:
    """Each left row with the values of the right row nearest in time, the earlier one on ties.

    ``right`` times are named ``on``; the match's time is returned as ``matched``. ``span`` deals long sequences out as in :func:`as_of`.
    """
    r = right.select(*keys, on, *values).withColumn("_t", F.col(on))
    before = as_of(left, r, keys, on, ["_t", *values], span=span)
    names = ["_t", *values]
    before = before.select(*left.columns, F.struct(*[F.col(n) for n in names]).alias("_b"))
    both = as_of(before, r, keys, on, names, forward=True, span=span)
    after = F.struct(*[F.col(n) for n in names])
    gap_b, gap_a = F.col(on) - F.col("_b._t"), F.col("_t") - F.col(on)
    pick = F.when(gap_b.isNull() | (gap_a < gap_b), after).otherwise(F.col("_b"))
    both = both.withColumn("_p", pick)
    return both.select(*left.columns, F.col("_p._t").alias("matched"), *[F.col("_p")[v].alias(v) for v in values])


_FAN = 64  # buckets of an interval, about, and how much wider each level's buckets are than those below


def _level(start: Column, end: Column, width: float) -> Column:
    """The lowest level, from 0, in whose buckets (``width`` times 64 to the level) an interval takes about 64 at most."""
    n = (end - start) / F.lit(float(width) * _FAN)
    return F.when(n > 1, F.ceil(F.log(n) / F.log(F.lit(float(_FAN))))).otherwise(0).cast("int")


def _top(*sides: tuple[DataFrame, str, str], width: float) -> int:
    """The highest level of the intervals, by a look at their lengths before the join is planned."""
    return max(df.agg(F.max(_level(F.col(s), F.col(e), width))).first()[0] or 0 for df, s, e in sides)


def _bucket(at: Column, width: float) -> Column:
    return F.floor(at / (F.lit(float(width)) * F.pow(F.lit(float(_FAN)), F.col("_l"))))


def containing(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, width: float) -> DataFrame:
    """Points with the intervals start <= at < end that hold them (all of them; none gives no row).

    ``width`` should be near the usual interval's length; it sets only the speed. Long intervals take wider buckets, so none is spread over
    more than some 64; points are looked up once for each width that occurs.
    """
    top = _top((intervals, "start", "end"), width=width)
    p = points.withColumn("_l", F.explode(F.array(*map(F.lit, range(top + 1))))).withColumn("_k", _bucket(F.col(at), width))
    i = intervals.withColumn("_l", _level(F.col("start"), F.col("end"), width))
    i = i.withColumn("_k", F.explode(F.sequence(_bucket(F.col("start"), width), F.greatest(_bucket(F.col("start"), width), _bucket(F.col("end"), width)))))
    return p.join(i, [*keys, "_l", "_k"]).filter((F.col("start") <= F.col(at)) & (F.col(at) < F.col("end"))).drop("_l", "_k")


def first_containing(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, values: list[str], span: float | None = None) -> DataFrame:
    """Each point with the values of the interval that holds it, for intervals that don't overlap: an
    as-of look-up of the last start, void once its end has passed."""
    r = intervals.withColumn(at, F.col("start")).withColumn("_end", F.col("end"))
    out = as_of(points, r, keys, at, ["_end", *values], span=span)
    return out.select(*points.columns, *[F.when(F.col(at) < F.col("_end"), F.col(v)).alias(v) for v in values])


def overlapping(a: DataFrame, b: DataFrame, keys: list[str], width: float) -> DataFrame:
    """Pairs of intervals (a_start, a_end), (b_start, b_end) that share time, with the shared ``overlap``.

    Both sides are spread over buckets, long intervals over wider ones; a pair meets in the buckets of the longer side's width, and counts in
    that of its later start alone.
    """
    top = _top((a, "a_start", "a_end"), (b, "b_start", "b_end"), width=width)

    def spread(side: DataFrame, start: str, end: str, own: str) -> DataFrame:
        out = side.withColumn(own, _level(F.col(start), F.col(end), width))
        out = out.withColumn("_l", F.explode(F.sequence(F.col(own), F.lit(top))))
        return out.withColumn("_k", F.explode(F.sequence(_bucket(F.col(start), width), F.greatest(_bucket(F.col(start), width), _bucket(F.col(end), width)))))

    both = spread(a, "a_start", "a_end", "_la").join(spread(b, "b_start", "b_end", "_lb"), [*keys, "_l", "_k"])
    both = both.filter(F.col("_l") == F.greatest("_la", "_lb"))
    both = both.withColumn("overlap", F.least("a_end", "b_end") - F.greatest("a_start", "b_start")).filter("overlap > 0")
    return both.filter(_bucket(F.greatest("a_start", "b_start"), width) == F.col("_k")).drop("_l", "_k", "_la", "_lb")


def pooled(frames: DataFrame, grid: DataFrame, keys: list[str], at: str, value: str, how: str = "mean", span: float | None = None) -> DataFrame:
    """Frames pooled to the grid's cells [start, end): ``sum`` (empty cells 0) or ``mean`` (empty cells
    take the frame nearest to their start)."""
    cells = grid.withColumns({at: F.col("start"), "_end": F.col("end"), "_start": F.col("start")})
    held = as_of(frames, cells, keys, at, ["_start", "_end"], span=span).filter(F.col(at) < F.col("_end"))
    agg = (F.sum if how == "sum" else F.avg)(value).alias(value)
    got = held.groupBy(*keys, F.col("_start").alias("start")).agg(agg, F.count("*").alias("n_frames"))
    out = grid.select(*keys, "start", "end").join(got, [*keys, "start"], "left")
    n = F.coalesce("n_frames", F.lit(0)).alias("n_frames")
    if how == "sum":
        return out.select(*keys, "start", "end", F.coalesce(value, F.lit(0.0)).alias(value), n)
    empty = out.select(*keys, "start", "end", F.col(value).alias("_own"), n).withColumn(at, F.col("start"))
    near = nearest(empty, frames, keys, at, [value], span)
    return near.select(*keys, "start", "end", F.coalesce("_own", value).alias(value), "n_frames")


def overlap_vote(a: DataFrame, b: DataFrame, keys: list[str], ids: list[str], label: str, width: float) -> DataFrame:
    """For each interval of ``a`` (named by ``ids``) the label of ``b`` that overlaps it longest, the
    smallest label on ties."""
    both = overlapping(a, b, keys, width).groupBy(*keys, *ids, label).agg(F.sum("overlap").alias("overlap"))
    w = Window.partitionBy(*keys, *ids).orderBy(F.desc("overlap"), label)
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def override(base: DataFrame, changes: DataFrame, keys: list[str], columns: list[str], flag: str = "changed") -> DataFrame:
    """``base`` with the columns of the matching row of ``changes`` where that holds a value."""
    c = changes.select(*keys, *[F.col(x).alias(f"_{x}") for x in columns], F.lit(True).alias(flag))
    out = base.join(c, keys, "left")
    new = {x: F.coalesce(f"_{x}", x) for x in columns} | {flag: F.coalesce(flag, F.lit(False))}
    return out.withColumns(new).drop(*[f"_{x}" for x in columns])


def boundary_scores(found: DataFrame, true: DataFrame, keys: list[str], at: str, tolerance: float, span: float | None = None) -> DataFrame:
    """Precision, recall and F of boundaries, each counting if one of the other side lies within the
    tolerance (many to many). A side without boundaries scores 0."""

    def hits(a, b, n, h):
        near = nearest(a.select(*keys, at), b.select(*keys, at), keys, at, [], span)
        ok = F.sum((F.abs(F.col(at) - F.col("matched")) <= tolerance).cast("long"))
        return near.groupBy(*keys).agg(F.count("*").alias(n), F.coalesce(ok, F.lit(0)).alias(h))

    both = hits(found, true, "n_found", "found_hits").join(hits(true, found, "n_true", "true_hits"), keys, "full")
    share = lambda h, n: F.when(F.coalesce(n, F.lit(0)) > 0, F.coalesce(h, F.lit(0)) / F.col(n)).otherwise(0.0)
    both = both.withColumns({"precision": share("found_hits", "n_found"), "recall": share("true_hits", "n_true")})
    p, r = F.col("precision"), F.col("recall")
    return both.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))
