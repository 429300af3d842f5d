"""Beat grids: periods by least squares and by a robust fit, and the phase of bars by combs and by crispness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ostinato.operators.blocks import join_same, kept
from ostinato.operators.sequences import ordered

# Times that a fit needs, how far it may lie from the tracker's period, and Huber's and the deviation's factors.
LEAST_TIMES, GUARD, HUBER, MAD = 8, 0.1, 1.345, 1.4826


def fitted_period(times: DataFrame, keys: list[str], time: str, period: str) -> DataFrame:
    """(keys, period, fitted): the least-squares spacing of a song's times, where each gap counts as the nearest whole number of ``period``
    (halves to even, 1 at least), so that a missed beat doesn't bend it. The song's own period stays where it has under eight times, isn't positive, or the fit is
    farther than a tenth from it. ``period`` is the same in all of a song's rows."""
    w = ordered(keys, [time])
    t = F.col(time).cast("double")
    d = times.filter(t.isNotNull()).withColumn("_gap", t - F.lag(t).over(w))
    step = F.when(F.col("_gap").isNull(), 0.0).otherwise(F.greatest(F.lit(1.0), F.bround(F.col("_gap") / F.col(period))))
    d = d.withColumn("_i", F.sum(step).over(w))
    d = d.groupBy(*keys).agg(F.first(F.col(period).cast("double")).alias("_p"), F.count("*").alias("_n"), F.regr_slope(t, F.col("_i")).alias("_slope"))
    good = (F.col("_n") >= LEAST_TIMES) & (F.col("_p") > 0) & F.col("_slope").between((1 - GUARD) * F.col("_p"), (1 + GUARD) * F.col("_p"))
    return d.select(*keys, F.when(good, F.col("_slope")).otherwise(F.col("_p")).alias("period"), F.coalesce(good, F.lit(False)).alias("fitted"))


def robust_line(points: DataFrame, keys: list[str], x: str, y: str, rounds: int = 25, tolerance: float = 1e-9) -> DataFrame:
    """(keys, intercept, slope, rounds): lines by Huber's weights, refitted until neither coefficient moves by more than the tolerance (and a hundred-thousandth).

    A round is a weighted fit by sums, two medians of the residuals (their spread times 1.4826 is a deviation, 1.345 deviations the point from which a residual counts
    less, in inverse proportion) and a test, for all songs together, in one shuffle by song; it is stored, and songs that have settled stay as they are. A song's
    residuals are held by the task that takes their median. Songs with one place x have the slope null.
    """
    w = Window.partitionBy(*keys)
    rows = points.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).filter("_x is not null and _y is not null")
    rows = rows.withColumns({"_w": F.lit(1.0), "intercept": F.lit(None).cast("double"), "slope": F.lit(None).cast("double"), "rounds": F.lit(0), "_going": F.lit(True)})
    near = lambda p, q: F.coalesce(F.abs(F.col(p) - F.col(q)) <= tolerance + 1e-5 * F.abs(F.col(q)), F.lit(False))
    for k in range(1, rounds + 1):
        # Centred sums, so that far origins cost no digits.
        d = rows.withColumns({"_mx": F.sum(F.col("_w") * F.col("_x")).over(w) / F.sum("_w").over(w), "_my": F.sum(F.col("_w") * F.col("_y")).over(w) / F.sum("_w").over(w)})
        dx, dy = F.col("_x") - F.col("_mx"), F.col("_y") - F.col("_my")
        d = d.withColumns({"_xx": F.sum(F.col("_w") * dx * dx).over(w), "_xy": F.sum(F.col("_w") * dx * dy).over(w)})
        d = d.withColumn("_b", F.when(F.col("_xx") > 0, F.col("_xy") / F.col("_xx")))
        d = d.withColumn("_a", F.col("_my") - F.coalesce("_b", F.lit(0.0)) * F.col("_mx"))
        d = d.withColumn("_r", F.col("_y") - F.col("_a") - F.coalesce("_b", F.lit(0.0)) * F.col("_x"))
        d = d.withColumn("_d", F.abs(F.col("_r") - F.median("_r").over(w))).withColumn("_d", HUBER * (MAD * F.median("_d").over(w) + 1e-9))
        settled = F.col("_b").isNull() | (near("_a", "intercept") & near("_b", "slope"))
        new = {
            "_w": F.when(F.abs("_r") <= F.col("_d"), 1.0).otherwise(F.col("_d") / F.greatest(F.abs("_r"), F.lit(1e-9))),
            "intercept": F.col("_a"),
            "slope": F.col("_b"),
            "rounds": F.lit(k),
            "_going": ~settled,
        }
        rows = kept(d.select(*keys, "_x", "_y", *[F.when(F.col("_going"), v).otherwise(F.col(c)).alias(c) for c, v in new.items()]))
        if rows.filter("_going").isEmpty():
            break
    return rows.groupBy(*keys).agg(F.first("intercept").alias("intercept"), F.first("slope").alias("slope"), F.max("rounds").alias("rounds"))


def comb_phase(curve: DataFrame, keys: list[str], index: str, value: str, period: int, beats: int) -> DataFrame:
    """(keys, phase, ratio): the beat of the bar on which a curve peaks when its whole bars of ``period`` rows are laid on each other, and the peak over
    the mean. The first of equal peaks counts, its beat is rounded (halves to even). Songs of under two bars, or periods under two rows, have phase 0 and ratio 1.
    ``index`` counts rows from 0; null values count as 0."""
    n = curve.groupBy(*keys).agg(F.count("*").alias("_n"))
    d = join_same(curve.select(*keys, F.col(index).cast("long").alias("_i"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_v")), n, keys)
    enough = (F.col("_n") >= 2 * period) & F.lit(period >= 2)
    d = d.filter(enough & (F.col("_i") < F.expr(f"(_n div {max(1, period)}) * {max(1, period)}")))
    at = d.groupBy(*keys, (F.col("_i") % max(1, period)).alias("_p")).agg(F.avg("_v").alias("_m"))
    best = at.groupBy(*keys).agg(F.max_by("_p", F.struct("_m", -F.col("_p"))).alias("_p"), (F.max("_m") / (F.avg("_m") + 1e-9)).alias("_ratio"))
    phase = F.bround(F.col("_p") * beats / max(1, period)).cast("int") % beats
    out = join_same(n, best, keys, "left")
    return out.select(*keys, F.coalesce(phase, F.lit(0)).alias("phase"), F.coalesce("_ratio", F.lit(1.0)).alias("ratio"))


def crispness(frames: DataFrame, keys: list[str], index: str, value: str, beats: int = 4, most_bars: int = 24, loop: int = 2, tonic: str | None = None) -> DataFrame:
    """(keys, phase, score) for each beat that a bar could begin with: how peaked and how regular the first ``most_bars`` bars are then.

    ``value`` is an array a beat, ``index`` counts beats from 0. A bar's mean array is scaled to 1. The score is the mean of bars' largest shares, plus the mean cosine of
    bars two apart less that of neighbours, plus, with a ``tonic`` and two loops of bars, half of what the tonic has on loops' first bars more
    than on the others. A phase with under eight bars scores -1. ``most_bars`` is the beginning that the measure is about; the rest of a song isn't read.
    """
    phases = F.explode(F.sequence(F.lit(0), F.lit(beats - 1))).alias("phase")
    extra = [F.col(tonic).alias("_tonic")] if tonic else [F.lit(None).cast("int").alias("_tonic")]
    d = frames.select(*keys, F.col(index).cast("long").alias("_i"), F.col(value).alias("_v"), *extra)
    everyone = d.select(*keys).distinct().select("*", phases)
    d = d.filter(F.col("_i") < (most_bars + 1) * beats).select("*", phases).filter("_i >= phase")
    d = d.withColumn("bar", F.expr(f"(_i - phase) div {beats}")).filter(F.col("bar") < most_bars)
    cells = d.select(*keys, "phase", "bar", "_i", "_tonic", F.posexplode("_v").alias("_k", "_x")).groupBy(*keys, "phase", "bar", "_k").agg(F.avg("_x").alias("_x"), F.count("*").alias("_n"), F.first("_tonic").alias("_tonic")).filter(F.col("_n") == beats)
    bars = cells.groupBy(*keys, "phase", "bar").agg(F.array_sort(F.collect_list(F.struct("_k", "_x"))).alias("_s"), F.first("_tonic").alias("_tonic")).withColumn("_s", F.col("_s._x"))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    bars = bars.withColumn("_sum", add(F.col("_s"))).withColumn("_s", F.when(F.col("_sum") > 1e-9, F.transform("_s", lambda x: x / F.col("_sum"))).otherwise(F.col("_s")))
    bars = bars.withColumn("_u", F.sqrt(add(F.transform("_s", lambda x: x * x)))).withColumn("_u", F.transform("_s", lambda x: x / F.greatest(F.col("_u"), F.lit(1e-9))))
    w = Window.partitionBy(*keys, "phase").orderBy("bar")
    dot = lambda lag: add(F.zip_with("_u", F.lag("_u", lag).over(w), lambda x, y: x * y))
    bars = bars.withColumns({"_d1": dot(1), "_d2": dot(2)})
    on = F.when(F.col("bar") % loop == 0, F.get("_s", F.pmod("_tonic", F.lit(12))))
    off = F.when(F.col("bar") % loop != 0, F.get("_s", F.pmod("_tonic", F.lit(12))))
    s = bars.groupBy(*keys, "phase").agg(F.count("*").alias("_n"), F.avg(F.array_max("_s")).alias("_peak"), F.avg("_d1").alias("_l1"), F.avg("_d2").alias("_l2"), (F.avg(on) - F.avg(off)).alias("_t"))
    score = F.col("_peak") + F.coalesce("_l2", F.lit(0.0)) - F.coalesce("_l1", F.lit(0.0)) + F.when((F.col("_n") >= 2 * loop) & F.col("_t").isNotNull(), 0.5 * F.col("_t")).otherwise(0.0)
    s = s.select(*keys, "phase", F.when(F.col("_n") >= 8, score).otherwise(-1.0).alias("score"))
    return join_same(everyone, s, [*keys, "phase"], "left").withColumn("score", F.coalesce("score", F.lit(-1.0)))


def crispest_phase(scores: DataFrame, keys: list[str], digits: int = 9) -> DataFrame:
    """(keys, phase, score): the phase with the best score, the first of those equal to ``digits`` places."""
    return scores.groupBy(*keys).agg(F.max_by(F.struct("phase", "score"), F.struct(F.round("score", digits), -F.col("phase"))).alias("_b")).select(*keys, "_b.phase", "_b.score")
