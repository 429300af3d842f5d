"""Passes over decoded sequences: roots refined by key and progression, loops that absorb unsure bars, grammars of repeated pairs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ostinato.operators import lattice as L
from ostinato.operators.blocks import join_same, kept
from ostinato.operators.sequences import ordered

# Pitch classes of a major key; weights of steps and of the key, the posterior from which a root stays.
MAJOR = (0, 2, 4, 5, 7, 9, 11)
STEP_WEIGHT, KEY_WEIGHT, SURE = 0.4, 0.15, 0.6
# Fixed values of the loop's arbitration: bars that a family needs, how far a bar's own evidence counts, the usual share of bars off a loop, the
# weight of its coverage, the share of kept deviations that a loop bears, and how much more often bars of a phrase of eight deviate.
LEAST_BARS, OWN_WEIGHT, OFF_LOOP, COVERAGE_WEIGHT, MOST_KEPT = 8, 1.5, 0.38, 1.2, 0.35
BY_PLACE = (0.94, 0.96, 0.99, 1.02, 0.99, 1.02, 1.07, 1.02)


def _first_argmax(c: str):
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def refine_roots(segments: DataFrame, keys: list[str], order: list[str], posterior: str, steps: list[float], step_weight: float = STEP_WEIGHT, key_weight: float = KEY_WEIGHT, sure: float = SURE, rounds: int = 2) -> DataFrame:
    """(keys, order, root, clamped, key): roots of all segments, the unsure ones decided by key and progression.

    ``posterior`` has 12 numbers, ``steps`` log-probabilities of the twelve intervals between roots. A segment whose largest number reaches
    ``sure`` keeps its root. In each of ``rounds`` rounds a sequence's key is the major key that most of its current roots belong to (the lowest of equals), and the
    best path over the others' log-posteriors, plus ``key_weight`` for roots of the key, plus weighted steps, gives new roots; it ends early once no
    root changes. Null posteriors count as even ones. Order values are unique in a sequence.
    """
    p = F.coalesce(F.transform(posterior, lambda x: F.coalesce(x.cast("double"), F.lit(0.0))), F.array_repeat(F.lit(1.0 / 12), 12))
    d = segments.select(*keys, *order, p.alias("_p"))
    d = kept(d.withColumns({"_top": _first_argmax("_p"), "clamped": F.array_max("_p") >= sure}))
    paths = L.Steps([[step_weight * steps[(j - i) % 12] for j in range(12)] for i in range(12)])
    now = d.withColumn("root", F.col("_top"))
    for _ in range(rounds):
        n = now.groupBy(*keys, "root").agg(F.count("*").alias("n"))
        votes = n.withColumn("_k", F.explode(F.array(*map(F.lit, range(12))))).filter(F.pmod(F.col("root") - F.col("_k"), F.lit(12)).isin(*MAJOR))
        key = votes.groupBy(*keys, "_k").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.max_by("_k", F.struct("n", -F.col("_k"))).alias("key"))
        e = join_same(now.drop("key"), key, keys)
        free = F.transform("_p", lambda x, i: F.log(x + 1e-9) + F.when(F.pmod(i - F.col("key"), F.lit(12)).isin(*MAJOR), key_weight).otherwise(0.0))
        e = e.withColumns({"_labels": F.when(F.col("clamped"), F.array("_top")).otherwise(F.array(*map(F.lit, range(12)))), "_scores": F.when(F.col("clamped"), F.array(F.lit(0.0))).otherwise(free)})
        path = L.solved(e, keys, order, paths, "_labels", "_scores", ["_p", "_top", "clamped", "root", "key"])
        now = kept(path.withColumn("_was", F.col("root")).withColumn("root", F.when(F.col("clamped"), F.col("_top")).otherwise(F.col("choice"))).drop("choice", "log_score"))
        if now.filter("root <> _was").isEmpty():
            break
        now = now.drop("_was")
    return now.select(*keys, *order, "root", "clamped", "key")


def compress_loops(bars: DataFrame, loops: DataFrame, keys: list[str], index: str, root: str, kind: str, posterior: str, confidence: str | None = None, first: int = 0) -> DataFrame:
    """``bars`` with root and kind drawn to their family's loop where their own evidence is weak: (keys, index, root, kind, outcome).

    ``keys`` name a song and a family (a stretch of bars of one section type), ``loops`` are (keys, period, pattern: roots by slot). A family's bars with
    a root, counted from 0, go round the slots. On a loop of two, a bar with either root belongs, another is drawn to the one with the larger posterior (the
    first of equals); on longer loops the slot's root is what belongs. Bars that belong take their slot's commonest kind (``maj`` without one; the smallest of
    equals). Another bar keeps its root if its confidence (its own posterior by default) times the logarithm of how much more its posterior gives its root, weighted,
    and the odds of a bar off a loop, less for a loop that covers more, say so. Outcomes: ``loop``, ``kept``, ``snapped``; ``untouched`` for families of under eight
    bars, without a loop, or of which more than 0.35 would be kept: there the loop isn't the simplest account, and all bars stay.
    """
    known = F.col(root).isNotNull()
    d = join_same(bars.withColumn("_b", F.col(index)), loops.select(*keys, F.col("period").alias("_p"), F.col("pattern").alias("_pattern")), keys, "left")
    part = Window.partitionBy(*keys)
    d = d.withColumns({"_k": F.row_number().over(Window.partitionBy(*keys, known).orderBy(index)) - 1, "_m": F.count(root).over(part)})
    slot = (F.col("_k") % F.col("_p")).cast("int")
    two = F.col("_p") == 2
    d = d.withColumns({"_slot": slot, "_own": F.get(posterior, F.col(root)), "_q0": F.get(posterior, F.get("_pattern", F.lit(0))), "_q1": F.get(posterior, F.get("_pattern", F.lit(1)))})
    d = d.withColumn("_at", F.when(two & F.array_contains("_pattern", F.col(root)), F.when(F.col(root) == F.get("_pattern", F.lit(0)), 0).otherwise(1)).when(two, F.when(F.col("_q0") >= F.col("_q1"), 0).otherwise(1)).otherwise(F.col("_slot")))
    d = d.withColumn("_want", F.get("_pattern", F.col("_at"))).withColumn("_in", known & (F.col(root) == F.col("_want")))
    covered = F.sum(F.col("_in").cast("int")).over(part) / F.col("_m")
    kinds = d.filter(known & (F.col(root) == F.get("_pattern", F.col("_slot"))) & F.col(kind).isNotNull()).groupBy(*keys, "_slot", F.col(kind).alias("_kind")).agg(F.count("*").alias("_n"))
    best = kinds.groupBy(*keys, "_slot").agg(F.min_by("_kind", F.struct(-F.col("_n"), F.col("_kind"))).alias("_kind")).withColumnRenamed("_slot", "_at")
    d = join_same(d, best, [*keys, "_at"], "left").withColumn("_kind", F.coalesce("_kind", F.lit("maj")))
    low = lambda c: F.log(F.greatest(c, F.lit(1e-9)))
    sure = F.col(confidence) if confidence else F.col("_own")
    place = F.element_at(F.array(*[F.lit(math.log(x)) for x in BY_PLACE]), (F.pmod(F.col("_b") - first, F.lit(8)) + 1).cast("int"))
    odds = OWN_WEIGHT * sure * (low(F.col("_own")) - low(F.get(posterior, F.col("_want")))) + math.log(OFF_LOOP / (1 - OFF_LOOP)) - COVERAGE_WEIGHT * (covered - 0.5) + place
    d = d.withColumn("_keep", known & ~F.col("_in") & (odds > 0))
    applies = F.col("_p").isNotNull() & (F.col("_m") >= LEAST_BARS) & (F.sum(F.coalesce(F.col("_keep").cast("int"), F.lit(0))).over(part) <= MOST_KEPT * F.col("_m"))
    outcome = F.when(~applies | ~known, "untouched").when(F.col("_in"), "loop").when(F.col("_keep"), "kept").otherwise("snapped")
    d = d.withColumn("outcome", outcome)
    change = F.col("outcome").isin("loop", "snapped")
    return d.select(*keys, index, F.when(change, F.col("_want")).otherwise(F.col(root)).alias(root), F.when(change, F.col("_kind")).otherwise(F.col(kind)).alias(kind), "outcome")


def pair_grammar(df: DataFrame, keys: list[str], order: list[str], symbol: str, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Rules and what is left of each sequence when its commonest pair of neighbours becomes one symbol, again and again.

    Returns rules (keys, rule, a, b, n) and the rest (keys, place, symbol, first, last: the rows that it stands for, counted from 0). Symbols are integers from 0; a rule's number
    is the symbol that it makes, from the sequence's largest symbol on. Each round takes the pair that stands most often side by side (of equals the one that stands first), if it does so ``least``
    times; occurrences that overlap, in stretches of one symbol, count but are replaced from the left, every second one. All sequences take their rounds together, each in one
    shuffle, stored; those that are done leave. Null symbols are left out.
    """
    w = ordered(keys, ["place"])
    seq = df.filter(F.col(symbol).isNotNull()).select(*keys, F.col(symbol).cast("long").alias("symbol"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    seq = seq.withColumn("place", (F.row_number().over(ordered(keys, [f"_o{i}" for i in range(len(order))])) - 1).cast("long"))
    seq = kept(seq.select(*keys, "place", "symbol", F.col("place").alias("first"), F.col("place").alias("last"), (F.max("symbol").over(Window.partitionBy(*keys)) + 1).alias("_next")))
    rules, rest = [], []
    while True:
        pairs = seq.withColumn("b", F.lead("symbol").over(w)).filter("b is not null")
        pairs = pairs.groupBy(*keys, F.col("symbol").alias("a"), "b").agg(F.count("*").alias("n"), F.min("place").alias("_at"), F.first("_next").alias("rule")).filter(F.col("n") >= least)
        best = pairs.groupBy(*keys).agg(F.max_by(F.struct("rule", "a", "b", "n"), F.struct("n", -F.col("_at"))).alias("_r"))
        best = kept(best.select(*keys, "_r.*"))
        if best.isEmpty():
            rest.append(seq)
            break
        rules.append(best)
        rest.append(join_same(seq, best.select(*keys), keys, "left_anti"))
        d = join_same(seq, best.select(*keys, F.col("a").alias("_a"), F.col("b").alias("_b")), keys)
        d = d.withColumn("_hit", F.coalesce((F.col("symbol") == F.col("_a")) & (F.lead("symbol").over(w) == F.col("_b")), F.lit(False)))
        d = d.withColumn("_k", F.row_number().over(w)).withColumn("_off", F.coalesce(F.last(F.when(~F.col("_hit"), F.col("_k")), ignorenulls=True).over(w), F.lit(0)))
        d = d.withColumn("_take", F.col("_hit") & ((F.col("_k") - F.col("_off")) % 2 == 1))
        d = d.withColumns({"_gone": F.coalesce(F.lag("_take").over(w), F.lit(False)), "last": F.when(F.col("_take"), F.lead("last").over(w)).otherwise(F.col("last")), "symbol": F.when(F.col("_take"), F.col("_next")).otherwise(F.col("symbol"))})
        seq = kept(d.filter("not _gone").select(*keys, "place", "symbol", "first", "last", (F.col("_next") + 1).alias("_next")))
    left = rest[0]
    for part in rest[1:]:
        left = left.union(part)
    left = left.withColumn("place", (F.row_number().over(w) - 1).cast("long")).drop("_next")
    if not rules:
        return left.sparkSession.createDataFrame([], left.select(*keys).schema.add("rule", "long").add("a", "long").add("b", "long").add("n", "long")), left
    found = rules[0]
    for part in rules[1:]:
        found = found.union(part)
    return found, left
