"""Phases of loops: which bar a section begins on, by the likelihood of its progression under a trigram model with backoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ostinato.operators.blocks import join_same, kept
from ostinato.operators.sequences import ordered
from ostinato.operators.stats import ngrams

# Classes of chords, what raises the counts of starts and pairs, the pseudo-count of the backoff, the least probability.
CLASSES, ALPHA, BACKOFF, FLOOR = 5, 0.5, 5.0, 1e-12


def _step(to: str, root: str, base: str) -> Column:
    return F.pmod(F.col(root) - F.col(base), F.lit(12)).alias(to)


def progression_model(df: DataFrame, keys: list[str], order: list[str], root: str, kind: str, tonic: str, alpha: float = ALPHA) -> dict[str, DataFrame]:
    """Counts of how chords follow each other, in any key: tables ``start``, ``pairs``, ``triples`` and ``contexts``.

    ``start`` (r, q, logp) holds all 60 (root above the tonic, class) of songs' first chords, ``pairs`` (q1, dn, qn, p) all 300 steps, both with
    counts raised by ``alpha``; ``triples`` (q2, d21, q1, dn, qn, n) and ``contexts`` (q2, d21, q1, c) the observed counts, at most 18,000 and 300
    rows. Steps are relative to the middle chord. Rows with a null root or class are left out; songs of one chord count nowhere.
    """
    rows = df.filter(F.col(root).isNotNull() & F.col(kind).isNotNull())
    rows = rows.select(*keys, *order, F.struct(F.pmod(F.col(root), F.lit(12)).cast("int").alias("r"), F.col(kind).cast("int").alias("q")).alias("_x"), F.col(tonic).cast("int").alias("_tonic"))
    spark = df.sparkSession
    classes = spark.range(CLASSES).select(F.col("id").cast("int").alias("q"))
    steps = spark.range(12).select(F.col("id").cast("int").alias("d"))
    w = ordered(keys, order)
    first = rows.withColumns({"_k": F.row_number().over(w), "_next": F.lead("_x").over(w)}).filter("_k = 1 and _next is not null and _tonic is not null")
    first = first.select(F.pmod(F.col("_x.r") - F.col("_tonic"), F.lit(12)).cast("int").alias("r"), F.col("_x.q").alias("q")).groupBy("r", "q").agg(F.count("*").alias("n"))
    # The grids are of fixed size: 60 and 300 rows.
    start = steps.withColumnRenamed("d", "r").join(classes, how="cross").join(first, ["r", "q"], "left").withColumn("c", F.coalesce("n", F.lit(0)) + alpha)
    start = start.select("r", "q", F.log(F.col("c") / F.sum("c").over(Window.partitionBy())).alias("logp"))
    two = ngrams(rows, keys, order, "_x", 2).select(F.col("s0.q").alias("q1"), _step("dn", "s1.r", "s0.r"), F.col("s1.q").alias("qn"))
    two = two.groupBy("q1", F.col("dn").cast("int").alias("dn"), "qn").agg(F.count("*").alias("n"))
    grid = classes.withColumnRenamed("q", "q1").join(steps.withColumnRenamed("d", "dn"), how="cross").join(classes.withColumnRenamed("q", "qn"), how="cross")
    pairs = grid.join(two, ["q1", "dn", "qn"], "left").withColumn("c", F.coalesce("n", F.lit(0)) + alpha)
    pairs = pairs.select("q1", "dn", "qn", (F.col("c") / F.sum("c").over(Window.partitionBy("q1"))).alias("p"))
    three = ngrams(rows, keys, order, "_x", 3).select(F.col("s0.q").alias("q2"), _step("d21", "s0.r", "s1.r"), F.col("s1.q").alias("q1"), _step("dn", "s2.r", "s1.r"), F.col("s2.q").alias("qn"))
    triples = kept(three.groupBy("q2", F.col("d21").cast("int").alias("d21"), "q1", F.col("dn").cast("int").alias("dn"), "qn").agg(F.count("*").alias("n")))
    contexts = triples.groupBy("q2", "d21", "q1").agg(F.sum("n").alias("c"))
    return {"start": kept(start), "pairs": kept(pairs), "triples": triples, "contexts": kept(contexts)}


def _chord(root: Column, kind: Column) -> Column:
    """(r, q), null unless both are known and not negative."""
    return F.when((root >= 0) & (kind >= 0), F.struct(F.pmod(root, F.lit(12)).cast("int").alias("r"), kind.cast("int").alias("q")))


def phase_scores(bars: DataFrame, keys: list[str], index: str, root: str, kind: str, model: dict[str, DataFrame], period: int, backoff: float = BACKOFF) -> DataFrame:
    """(keys, shift, logp) for every shift of 0 to ``period`` - 1: the log-likelihood of a song's periods that begin ``shift`` bars in.

    ``bars`` has a chord a bar (root above the tonic, class; unknown where null or negative) and its index from 0 without gaps. A song is taken as a
    loop. In each whole period the first known chord scores as a start, the second by pairs, later ones by triples (share c / (c + ``backoff``) of them, c
    the context's count) mixed with pairs; an unknown bar begins anew. Songs of less than two periods are absent. What a bar scores
    depends only on the two before it, so each bar is scored once in each way, and a shift picks which one counts.
    """
    w = ordered(keys, ["_i"])
    d = bars.select(*keys, F.col(index).cast("long").alias("_i"), _chord(F.col(root), F.col(kind)).alias("_c"))
    sizes = d.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= 2 * period)
    d = join_same(d, sizes, keys)
    # The loop's seam: a copy of the last two bars stands before the first.
    seam = d.filter(F.col("_i") >= F.col("_n") - 2).withColumn("_i", F.col("_i") - F.col("_n"))
    d = d.union(seam).withColumns({"_p1": F.lag("_c").over(w), "_p2": F.lag("_c", 2).over(w)}).filter("_i >= 0")
    d = d.withColumns({"r": F.col("_c.r"), "q": F.col("_c.q"), "q1": F.col("_p1.q"), "q2": F.col("_p2.q"), "dn": F.pmod(F.col("_c.r") - F.col("_p1.r"), F.lit(12)), "d21": F.pmod(F.col("_p2.r") - F.col("_p1.r"), F.lit(12))})
    d = d.withColumn("qn", F.col("q"))
    # The model's tables have 60, 300, 300 and at most 18,000 rows.
    d = d.join(F.broadcast(model["start"]), ["r", "q"], "left").join(F.broadcast(model["pairs"]), ["q1", "dn", "qn"], "left")
    d = d.join(F.broadcast(model["contexts"]), ["q2", "d21", "q1"], "left").join(F.broadcast(model["triples"]), ["q2", "d21", "q1", "dn", "qn"], "left")
    logp = lambda p: F.log(F.greatest(p, F.lit(FLOOR)))
    by_pair = logp(F.col("p"))
    share = F.col("c") / (F.col("c") + backoff)
    by_triple = F.when(F.col("c") > 0, logp(share * (F.coalesce("n", F.lit(0)) / F.col("c")) + (1 - share) * F.col("p"))).otherwise(by_pair)
    d = d.select(*keys, "_i", "_n", F.col("_c").isNotNull().alias("_known"), F.col("_p1").isNotNull().alias("_k1"), F.col("_p2").isNotNull().alias("_k2"), F.col("logp").alias("_s0"), by_pair.alias("_s1"), by_triple.alias("_s2"))
    d = d.withColumn("shift", F.explode(F.sequence(F.lit(0), F.lit(period - 1))))
    place = F.pmod(F.col("_i") - F.col("shift"), F.col("_n"))
    d = d.withColumns({"_j": F.floor(place / period), "_o": place % period}).filter(F.col("_j") < F.floor(F.col("_n") / period))
    one, two = F.col("_k1") & (F.col("_o") >= 1), F.col("_k2") & (F.col("_o") >= 2)
    value = F.when(~F.col("_known"), 0.0).when(one & two, F.col("_s2")).when(one, F.col("_s1")).otherwise(F.col("_s0"))
    return d.groupBy(*keys, "shift").agg(F.sum(value).alias("logp"))


def best_shift(scores: DataFrame, keys: list[str], digits: int = 9) -> DataFrame:
    """(keys, shift, logp): the likeliest shift of each song, the smallest of those equal to ``digits`` places."""
    return scores.groupBy(*keys).agg(F.max_by(F.struct("shift", "logp"), F.struct(F.round("logp", digits), -F.col("shift"))).alias("_b")).select(*keys, "_b.shift", "_b.logp")


def shift_boundaries(boundaries: DataFrame, shifts: DataFrame, keys: list[str], at: str, beats_per_bar: int) -> DataFrame:
    """(keys, at): boundaries (beats) moved by their song's shift (in bars), with one at the shift itself; those at 0 or from the song's
    ``n_beats`` (a column of ``shifts``) on are dropped. A shift of 0 changes nothing; repeated boundaries are one."""
    off = F.col("shift") * beats_per_bar
    moved = join_same(boundaries.select(*keys, F.col(at).alias("_at")), shifts, keys)
    same = moved.filter("shift <= 0").select(*keys, F.col("_at").alias(at))
    later = moved.filter("shift > 0").select(*keys, (F.col("_at") + off).alias(at), "n_beats").union(shifts.filter("shift > 0").select(*keys, off.alias(at), "n_beats"))
    return same.union(later.filter((F.col(at) > 0) & (F.col(at) < F.col("n_beats"))).select(*keys, at)).distinct()
