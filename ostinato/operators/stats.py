"""Counts, transition models, calibration and agreement measures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ostinato.operators.sequences import ordered


def distribution(df: DataFrame, column: str) -> DataFrame:
    """value, n and its share of all rows."""
    n = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def clipped_pmf(df: DataFrame, value: str, most: int) -> DataFrame:
    """Shares of 1..most of rounded values, larger ones in the last bin; without rows all alike."""
    d = df.filter(F.col(value).isNotNull()).select(F.greatest(F.lit(1), F.least(F.lit(most), F.bround(value).cast("int"))).alias("d"))
    n = d.groupBy("d").agg(F.count("*").alias("n"))
    bins = df.sparkSession.range(1, most + 1).select(F.col("id").cast("int").alias("d"))
    both = bins.join(n, "d", "left").select("d", F.coalesce("n", F.lit(0)).alias("n"))
    all_ = F.sum("n").over(Window.partitionBy())
    return both.withColumn("p", F.when(all_ > 0, F.col("n") / all_).otherwise(1.0 / most))


def ngrams(df: DataFrame, keys: list[str], order: list[str], symbol: str, n: int) -> DataFrame:
    """Rows with their next n - 1 symbols as s0 .. s(n-1); windows that run out are left away."""
    w = ordered(keys, order)
    out = df.withColumns({f"s{i}": F.lead(symbol, i).over(w) if i else F.col(symbol) for i in range(n)})
    return out.filter(F.col(f"s{n - 1}").isNotNull())


def ngram_counts(df: DataFrame, keys: list[str], order: list[str], symbol: str, n: int, repeats: bool = True) -> DataFrame:
    """Counts of n-grams; ``repeats`` False leaves away those with two equal neighbours."""
    g = ngrams(df, keys, order, symbol, n)
    if not repeats:
        for i in range(1, n):
            g = g.filter(F.col(f"s{i}") != F.col(f"s{i - 1}"))
    return g.groupBy(*[f"s{i}" for i in range(n)]).agg(F.count("*").alias("n"))


def transition_model(df: DataFrame, keys: list[str], order: list[str], symbol: str, states: DataFrame | None = None, smooth: float = 0.2, most: int = 4096) -> DataFrame:
    """ln P(b | a) for every pair of states, each count raised by ``smooth``; steps from a state to itself
    are no transitions. The states are those of the rows, or of ``states`` (column ``state``); more than ``most`` raise ValueError,
    since the grid is their square."""
    n = ngram_counts(df, keys, order, symbol, 2, repeats=False)
    found = df.select(F.col(symbol).alias("state")).filter("state is not null").distinct() if states is None else states.select("state").distinct()
    names = [r["state"] for r in found.limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} states")
    if not names:
        return n.select("s0", "s1", "n", F.lit(None).cast("double").alias("logp"))
    every = F.array(*[F.lit(x) for x in sorted(names)])
    grid = df.sparkSession.range(1).select(F.explode(every).alias("s0")).select("s0", F.explode(every).alias("s1"))
    both = grid.join(n, ["s0", "s1"], "left").withColumn("c", F.coalesce("n", F.lit(0)) + smooth)
    return both.select("s0", "s1", F.coalesce("n", F.lit(0)).alias("n"), F.ln(F.col("c") / F.sum("c").over(Window.partitionBy("s0"))).alias("logp"))


def bigram_lift(df: DataFrame, keys: list[str], order: list[str], symbol: str, group: str, least: int = 1, top: int | None = None) -> DataFrame:
    """P(pair | group) / P(pair) of every pair of every group, with its rank in the group; ties go by the pair. A report may leave away pairs
    seen less than ``least`` times in the group, or keep the ``top`` first."""
    g = ngrams(df, keys, order, symbol, 2).groupBy(group, "s0", "s1").agg(F.count("*").alias("n"))
    n = F.col("n")
    everything = g.agg(F.sum("n").alias("_all"))  # one row
    of_pair, of_group = F.sum(n).over(Window.partitionBy("s0", "s1")), F.sum(n).over(Window.partitionBy(group))
    out = g.withColumns({"_pair": of_pair, "_group": of_group}).filter(n >= least).crossJoin(F.broadcast(everything))
    out = out.withColumn("lift", (n / F.col("_group")) / (F.col("_pair") / F.col("_all"))).drop("_pair", "_group", "_all")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("lift"), "s0", "s1")))
    return out if top is None else out.filter(F.col("rank") <= top)


def context_sparsity(df: DataFrame, keys: list[str], order: list[str], symbol: str, least: int = 20) -> DataFrame:
    """How well two-symbol contexts are observed: their number, median count, share of those seen at
    least ``least`` times, and the mass of the 50 commonest."""
    c = ngrams(df, keys, order, symbol, 3).groupBy("s0", "s1").agg(F.count("*").alias("n"))
    top = c.orderBy(F.desc("n"), "s0", "s1").limit(50).agg(F.sum("n").alias("_top"))
    out = c.agg(
        F.count("*").alias("contexts"),
        F.median("n").alias("median_n"),
        F.avg((F.col("n") >= least).cast("double")).alias("share_seen"),
        F.sum("n").alias("_n"),
    )
    # One row each.
    return out.crossJoin(top).select("contexts", "median_n", "share_seen", (F.col("_top") / F.col("_n")).alias("top50_mass"))


def change_by_phase(df: DataFrame, keys: list[str], order: list[str], symbol: str, beat: str, period: int) -> DataFrame:
    """How often the symbol changes at each phase: the mean over sequences of each one's share, and
    its population deviation."""
    w = ordered(keys, order)
    d = df.withColumn("_p", F.lag(symbol).over(w)).filter("_p is not null")
    d = d.groupBy(*keys, F.pmod(F.col(beat), F.lit(period)).alias("phase")).agg(F.avg((F.col(symbol) != F.col("_p")).cast("double")).alias("x"))
    return d.groupBy("phase").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("deviation"), F.count("*").alias("sequences"))


def entropy_bits(df: DataFrame, columns: list[str]) -> DataFrame:
    """Entropy of the joint distribution of ``columns`` in bits."""
    n = df.groupBy(*columns).agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return n.agg(F.coalesce(-F.sum(F.col("p") * F.log2("p")), F.lit(0.0)).alias("bits"))


def confusion(df: DataFrame, true: str, found: str, weight: str | None = None) -> DataFrame:
    """Pairs of labels with their count or weight, and the share of the true label's."""
    n = F.sum(weight) if weight else F.count("*")
    out = df.groupBy(true, found).agg(n.alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(true)))


def confusion_rollup(df: DataFrame, true: str, found: str) -> DataFrame:
    """The confusion table with its row and grand totals, from one pass; totals have nulls for labels."""
    return df.rollup(true, found).agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


def reliability(df: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """Per confidence bin: rows, mean confidence and accuracy; the last bin includes 1."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1))
    return df.groupBy(b.cast("int").alias("bin")).agg(
        F.count("*").alias("n"), F.avg(confidence).alias("confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy")
    )


def calibration_error(df: DataFrame, confidence: str, correct: str, bins: int = 10, least: int = 1) -> DataFrame:
    """Expected calibration error over bins of at least ``least`` rows, as shares of all rows."""
    r = reliability(df, confidence, correct, bins).withColumn("_all", F.sum("n").over(Window.partitionBy()))
    return r.filter(F.col("n") >= least).agg(F.coalesce(F.sum(F.col("n") / F.col("_all") * F.abs(F.col("confidence") - F.col("accuracy"))), F.lit(0.0)).alias("ece"))


def _below(n: DataFrame, score: str, values: list[str], ranges: int = 200) -> DataFrame:
    """``n`` with, for each of ``values``, its sum over smaller scores (_below) and over all (_all).

    Scores are distinct; null is the smallest. They are cut into ranges of about equal numbers, summed inside
    each range, and added to the sums of the ranges before: only these go through one task.
    """
    x = F.col(score).cast("double")
    edges = n.agg(F.percentile_approx(x, [k / ranges for k in range(1, ranges)])).first()[0] or []
    known = F.array(*[F.lit(float(e)) for e in sorted(set(edges))]) if edges else F.array().cast("array<double>")
    n = n.withColumn("_b", F.when(x.isNull(), -1).otherwise(F.size(F.filter(known, lambda e: e <= x))))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = n.groupBy("_b").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    before = {f"_{v}_before": F.coalesce(F.sum(f"_{v}").over(upto(Window.orderBy("_b"))), F.lit(0)) for v in values}
    sums = sums.withColumns(before | {f"{v}_all": F.sum(f"_{v}").over(Window.partitionBy()) for v in values}).drop(*[f"_{v}" for v in values])
    inside = {v: F.coalesce(F.sum(v).over(upto(Window.partitionBy("_b").orderBy(score))), F.lit(0)) for v in values}
    out = n.withColumns({f"_{v}_in": c for v, c in inside.items()}).join(F.broadcast(sums), "_b")
    return out.withColumns({f"{v}_below": F.col(f"_{v}_before") + F.col(f"_{v}_in") for v in values})


def auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Area under the ROC curve; ties count half. Null without both classes.

    Scores are counted per value first and summed over ranges of values, so no task sorts all rows.
    """
    n = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(positive).cast("long")).alias("pos"), F.count("*").alias("n"))
    n = n.withColumn("neg", F.col("n") - F.col("pos"))
    won = _below(n, "s", ["neg"]).withColumn("won", F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    return won.agg((F.sum("won") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def roc_points(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Threshold, true and false positive rates and precision for every distinct score, highest first."""
    n = df.groupBy(F.col(score).alias("threshold")).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.count("*").alias("n"))
    n = _below(n, "threshold", ["p", "n"])
    tp, seen = F.col("p_all") - F.col("p_below"), F.col("n_all") - F.col("n_below")
    pos, neg = F.col("p_all"), F.col("n_all") - F.col("p_all")
    out = n.select("threshold", (tp / pos).alias("tpr"), ((seen - tp) / neg).alias("fpr"), (tp / seen).alias("precision"))
    return out.orderBy(F.desc("threshold"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings of the same rows; 1 where neither splits anything."""
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    both = df.groupBy(a, b).agg(F.count("*").alias("n"))
    cell = both.agg(pairs(F.col("n")).alias("cell"), F.sum("n").alias("all"))
    row = both.groupBy(a).agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("row"))
    col = both.groupBy(b).agg(F.sum("n").alias("n")).agg(pairs(F.col("n")).alias("col"))
    x = cell.crossJoin(row).crossJoin(col)  # one row each
    chance, most = F.col("row") * F.col("col") / (F.col("all") * (F.col("all") - 1) / 2), (F.col("row") + F.col("col")) / 2
    return x.select(F.when(most == chance, 1.0).otherwise((F.col("cell") - chance) / (most - chance)).alias("ari"))


def v_measure(df: DataFrame, true: str, found: str) -> DataFrame:
    """Homogeneity, completeness and their harmonic mean, from entropies of the contingency table."""
    n = df.groupBy(true, found).agg(F.count("*").alias("n"))
    t, f, a = Window.partitionBy(true), Window.partitionBy(found), Window.partitionBy()
    n = n.withColumns({"nt": F.sum("n").over(t), "nf": F.sum("n").over(f), "na": F.sum("n").over(a)})
    p = F.col("n") / F.col("na")
    h = n.agg(
        (-F.sum(p * F.ln(F.col("n") / F.col("nf")))).alias("t_f"),
        (-F.sum(p * F.ln(F.col("n") / F.col("nt")))).alias("f_t"),
        (-F.sum(p * F.ln(F.col("nt") / F.col("na")))).alias("t"),
        (-F.sum(p * F.ln(F.col("nf") / F.col("na")))).alias("f"),
    )
    share = lambda c, whole: F.when(F.col(whole) > 0, 1 - F.col(c) / F.col(whole)).otherwise(1.0)
    h = h.select(share("t_f", "t").alias("homogeneity"), share("f_t", "f").alias("completeness"))
    x, y = F.col("homogeneity"), F.col("completeness")
    return h.withColumn("v", F.when(x + y > 0, 2 * x * y / (x + y)).otherwise(0.0))


def macro_micro(df: DataFrame, score: str, weight: str) -> DataFrame:
    """Mean score of rows, and the mean weighted by ``weight``."""
    return df.agg(F.avg(score).alias("macro"), (F.sum(F.col(score) * F.col(weight)) / F.sum(weight)).alias("micro"))


def zscores(df: DataFrame, keys: list[str], value: str, least_cv: float = 0.1, least_n: int = 4, out: str = "z") -> DataFrame:
    """Standard scores inside each sequence; null where it has under ``least_n`` values or hardly varies.

    Deviations are summed in ascending order of the values, so that a score's last digits don't hang on the order in which rows arrive."""
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    m, s, n = F.avg(value).over(w), F.stddev_pop(value).over(w), F.count(value).over(w)
    return df.withColumn(out, F.when((n >= least_n) & (m != 0) & (s / F.abs(m) >= least_cv), (F.col(value) - m) / s))


def regularity(df: DataFrame, keys: list[str], time: str, tolerance: float = 0.15, least: int = 5) -> DataFrame:
    """Share of intervals within the tolerance of the median one; 0 for under ``least`` times."""
    d = df.withColumn("_d", F.lead(time).over(ordered(keys, [time])) - F.col(time))
    d = d.withColumns({"_m": F.median("_d").over(Window.partitionBy(*keys)), "_n": F.count("*").over(Window.partitionBy(*keys))})
    ok = (F.abs(F.col("_d") - F.col("_m")) <= tolerance * F.col("_m")).cast("double")
    return d.groupBy(*keys).agg(F.when(F.max("_n") >= least, F.avg(ok)).otherwise(0.0).alias("regularity"))


def best_fit_period(df: DataFrame, keys: list[str], time: str, guard: float = 0.1) -> DataFrame:
    """Least-squares period of a sequence of times; the median interval instead where the slope is
    farther than ``guard`` from it."""
    w = ordered(keys, [time])
    d = df.withColumns({"_i": (F.row_number().over(w) - 1).cast("double"), "_d": F.lead(time).over(w) - F.col(time)})
    d = d.groupBy(*keys).agg(F.regr_slope(F.col(time).cast("double"), F.col("_i")).alias("slope"), F.median("_d").alias("median"))
    return d.withColumn("period", F.when(F.abs(F.col("slope") - F.col("median")) <= guard * F.col("median"), F.col("slope")).otherwise(F.col("median")))


def circular_phase(df: DataFrame, keys: list[str], time: str, period: str) -> DataFrame:
    """Phase in 0..1 of times against a period by the circular mean, and its concentration."""
    angle = F.lit(2 * 3.141592653589793) * (F.col(time) / F.col(period))
    d = df.groupBy(*keys).agg(F.avg(F.sin(angle)).alias("s"), F.avg(F.cos(angle)).alias("c"))
    turn = F.atan2("s", "c") / (2 * 3.141592653589793)
    return d.select(*keys, F.when(turn < 0, turn + 1).otherwise(turn).alias("phase"), F.sqrt(F.col("s") ** 2 + F.col("c") ** 2).alias("concentration"))


def next_symbol_accuracy(df: DataFrame, keys: list[str], order: list[str], symbol: str, sequence: str, every: int = 5, k: int = 3) -> DataFrame:
    """Top-1 and top-k accuracy of the next symbol by counts: every ``every``-th sequence (column
    ``sequence``, a number) is held out, counts come from the others, ties go by symbol."""
    g = ngrams(df, keys, order, symbol, 2)
    held = F.pmod(F.col(sequence), F.lit(every)) == 0
    n = g.filter(~held).groupBy("s0", "s1").agg(F.count("*").alias("n"))
    rank = n.withColumn("r", F.row_number().over(Window.partitionBy("s0").orderBy(F.desc("n"), "s1"))).select("s0", "s1", "r")
    out = g.filter(held).join(rank, ["s0", "s1"], "left")
    hit = lambda k: F.avg(F.coalesce((F.col("r") <= k).cast("double"), F.lit(0.0)))
    return out.agg(F.count("*").alias("n"), hit(1).alias("top1"), hit(k).alias("topk"))


def reciprocal_pair(df: DataFrame, keys: list[str], order: list[str], symbol: str) -> DataFrame:
    """Per sequence the commonest unordered pair of successive different symbols, its count, the best
    count of a pair that shares no symbol with it, and the number of changes. Ties go by the pair."""
    g = ngrams(df, keys, order, symbol, 2).filter("s0 <> s1")
    g = g.groupBy(*keys, F.least("s0", "s1").alias("a"), F.greatest("s0", "s1").alias("b")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    g = g.withColumn("_k", F.row_number().over(w.orderBy(F.desc("n"), "a", "b")))
    g = g.withColumn("_t", F.first(F.struct("a", "b", "n")).over(w.orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    apart = ~F.col("a").isin(F.col("_t.a"), F.col("_t.b")) & ~F.col("b").isin(F.col("_t.a"), F.col("_t.b"))
    return g.groupBy(*keys).agg(
        F.first("_t.a").alias("a"), F.first("_t.b").alias("b"), F.first("_t.n").alias("n"), F.coalesce(F.max(F.when(apart, F.col("n"))), F.lit(0)).alias("runner_up"), F.sum("n").alias("changes")
    )
