"""Self-similarity, periodicity, folding and section tests of sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ostinato.functions import vectors as V
from ostinato.operators.sequences import ordered


def self_similarity(df: DataFrame, keys: list[str], index: str, vector: str, reach: int) -> DataFrame:
    """Cosine similarity, cut to 0..1, of rows up to ``reach`` positions apart: (keys, i, j, similarity), i < j.

    A band instead of all pairs: every row looks at the ``reach`` rows ahead of it in one window, so vectors are
    shuffled once and results grow with ``reach``, not with the square of a sequence's length.
    """
    w = ordered(keys, ["i"])
    v = df.select(*keys, F.col(index).alias("i"), V.unit(F.col(vector)).alias("_v"))
    v = v.withColumns({f"_x{k}": F.lead(F.struct("i", "_v"), k).over(w) for k in range(1, reach + 1)})
    cut = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    pairs = F.array(*[F.when(F.col(f"_x{k}.i") - F.col("i") <= reach, F.struct(F.col(f"_x{k}.i").alias("j"), cut(V.dot(F.col("_v"), F.col(f"_x{k}._v"))).alias("similarity"))) for k in range(1, reach + 1)])
    return v.select(*keys, "i", F.explode(pairs).alias("x")).filter("x is not null").select(*keys, "i", "x.j", "x.similarity")


def _pairs_of_blocks(rows: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Rows (keys, i, v) once for every pair (bi <= bj) of blocks of ``block`` rows of their sequence that theirs is part of."""
    v = rows.withColumn("b", F.floor(F.col("i") / block))
    last = v.groupBy(*keys).agg(F.max("b").alias("_last"))
    v = v.join(last, keys).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))))
    return v.select(*keys, F.least("b", "_o").alias("bi"), F.greatest("b", "_o").alias("bj"), "i", "v")


def _matrix(vectors) -> np.ndarray:
    """Vectors as rows; those that are null or hold nulls as zeros."""
    full = [x is not None and all(y is not None for y in x) for x in vectors]
    width = max([len(x) for x, f in zip(vectors, full, strict=True) if f], default=1)
    return np.array([x if f else np.zeros(width) for x, f in zip(vectors, full, strict=True)], dtype=float)


def closest(df: DataFrame, keys: list[str], index: str, vector: str, block: int = 512) -> DataFrame:
    """What each row of the whole self-similarity matrix (cosine, cut to 0..1; itself left out) holds: (keys, i, similarity, mean), the largest and
    the mean value, null in a sequence of one row.

    Arguments and null vectors are as in :func:`lag_similarity`; a pair of blocks gives a row for each of its rows.
    """
    v = _pairs_of_blocks(df.select(*keys, F.col(index).cast("long").alias("i"), V.unit(F.col(vector)).alias("v")), keys, block)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        m, i = _matrix(g["v"]), g["i"].to_numpy()
        a, b = i // block == g["bi"].iloc[0], i // block == g["bj"].iloc[0]
        s = np.clip(np.nan_to_num(m[a] @ m[b].T), 0.0, 1.0)
        other = i[a][:, None] != i[b][None, :]
        parts = [(i[a], s, other)] + ([(i[b], s.T, other.T)] if g["bi"].iloc[0] != g["bj"].iloc[0] else [])
        out = pd.concat([pd.DataFrame({"i": at, "top": np.where(o, x, -1.0).max(axis=1), "s": np.where(o, x, 0.0).sum(axis=1), "n": o.sum(axis=1)}) for at, x, o in parts])
        for c in keys:
            out[c] = g[c].iloc[0]
        return out[[*keys, "i", "top", "s", "n"]]

    known = StructType([f for f in v.schema if f.name in keys])
    found = v.groupBy(*keys, "bi", "bj").applyInPandas(run, known.add("i", "long").add("top", "double").add("s", "double").add("n", "long"))
    n = F.sum("n")
    return found.groupBy(*keys, "i").agg(F.when(n > 0, F.max("top")).alias("similarity"), F.when(n > 0, F.sum("s") / n).alias("mean"))


def repeated_passages(df: DataFrame, keys: list[str], index: str, symbol: str, reach: int = 3, block: int = 512) -> DataFrame:
    """(keys, lag, s): how well the best passage repeats at each lag of a whole sequence.

    On every diagonal of the matrix of equal symbols values are averaged with those up to ``reach`` rows before and after (fewer at its
    ends), so that passages, not single rows, stand out; ``s`` is the diagonal's largest average. ``index`` counts rows from 0 without gaps, null
    symbols equal nothing. Each pair of blocks is a group of its own, with the ``reach`` rows around both.
    """
    rows = df.select(*keys, F.col(index).cast("long").alias("i"), F.xxhash64(symbol).alias("h"), F.col(symbol).isNull().alias("none"))
    last = rows.groupBy(*keys).agg(F.max(F.floor(F.col("i") / block)).alias("_last"))
    near = F.array_distinct(F.array(F.floor((F.col("i") - reach) / block), F.floor(F.col("i") / block), F.floor((F.col("i") + reach) / block)))
    v = rows.join(last, keys).withColumn("b", F.explode(near)).filter("b between 0 and _last").withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"))))
    v = v.select(*keys, F.least("b", "_o").alias("bi"), F.greatest("b", "_o").alias("bj"), "i", "h", "none").distinct()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("i")
        bi, bj, i = g["bi"].iloc[0], g["bj"].iloc[0], g["i"].to_numpy()
        of = lambda b: (i >= b * block - reach) & (i < (b + 1) * block + reach)
        a, b = of(bi), of(bj)
        h, none = g["h"].to_numpy(), g["none"].to_numpy()
        same = ((h[a][:, None] == h[b][None, :]) & ~none[a][:, None] & ~none[b][None, :]).astype(float)
        total, count = np.zeros_like(same), np.zeros_like(same)
        n, m = same.shape
        for d in range(-reach, reach + 1):
            to = (slice(max(0, -d), n - max(0, d)), slice(max(0, -d), m - max(0, d)))
            at = (slice(max(0, d), n - max(0, -d)), slice(max(0, d), m - max(0, -d)))
            total[to] += same[at]
            count[to] += 1
        lag = i[b][None, :] - i[a][:, None]
        own = ((i[a] // block == bi)[:, None] & (i[b] // block == bj)[None, :]) & (lag > 0)
        out = pd.DataFrame({"lag": lag[own], "s": (total / np.maximum(count, 1))[own]}).groupby("lag", as_index=False)["s"].max()
        for c in keys:
            out[c] = g[c].iloc[0]
        return out[[*keys, "lag", "s"]]

    known = StructType([f for f in v.schema if f.name in keys])
    found = v.groupBy(*keys, "bi", "bj").applyInPandas(run, known.add("lag", "long").add("s", "double"))
    return found.groupBy(*keys, "lag").agg(F.max("s").alias("s"))


def lag_similarity(df: DataFrame, keys: list[str], index: str, vector: str, block: int = 512) -> DataFrame:
    """Mean of each off-diagonal of the whole self-similarity matrix (cosine, cut to 0..1): (keys, lag, score, n).

    ``index`` counts a sequence's rows from 0, its vectors have one length. Every pair of blocks of rows is multiplied in a group
    of its own, of at most two blocks, and gives sums by lag alone: at most two rows per row of a block.
    A vector that is null, zero or holds nulls has the similarity 0 to any other.
    """
    v = _pairs_of_blocks(df.select(*keys, F.col(index).cast("long").alias("i"), V.unit(F.col(vector)).alias("v")), keys, block)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(g["v"])
        i, of = g["i"].to_numpy(), (g["i"] // block).to_numpy()
        a, b = of == g["bi"].iloc[0], of == g["bj"].iloc[0]
        s = np.clip(np.nan_to_num(m[a] @ m[b].T), 0.0, 1.0)
        lag = i[b][None, :] - i[a][:, None]
        n = np.bincount(lag[lag > 0])
        at = np.flatnonzero(n)
        out = pd.DataFrame({"lag": at, "s": np.bincount(lag[lag > 0], s[lag > 0])[at], "n": n[at]})
        for c in keys:
            out[c] = g[c].iloc[0]
        return out[[*keys, "lag", "s", "n"]]

    known = StructType([f for f in v.schema if f.name in keys])
    sums = v.groupBy(*keys, "bi", "bj").applyInPandas(run, known.add("lag", "long").add("s", "double").add("n", "long"))
    return sums.groupBy(*keys, "lag").agg((F.sum("s") / F.sum("n")).alias("score"), F.sum("n").alias("n"))


def lag_profile(df: DataFrame, keys: list[str], order: list[str], symbol: str, shortest: int, longest: int) -> DataFrame:
    """Share of rows equal to the row ``lag`` before, for each lag: (keys, lag, score, n)."""
    w = ordered(keys, order)
    lags = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(symbol) == F.lag(symbol, k).over(w)).cast("double").alias("x")) for k in range(shortest, longest + 1)])
    out = df.select(*keys, lags.alias("_l")).select(*keys, F.explode("_l").alias("_x"))
    return out.groupBy(*keys, F.col("_x.lag").alias("lag")).agg(F.avg("_x.x").alias("score"), F.count("_x.x").alias("n"))


def loop_period(df: DataFrame, keys: list[str], order: list[str], symbol: str, shortest: int = 4, longest: int = 32, least: float = 0.65) -> DataFrame:
    """The smallest lag, at most half a sequence, whose score reaches ``least``; sequences without one are absent."""
    p = lag_profile(df, keys, order, symbol, shortest, longest)
    p = p.filter((F.col("n") >= F.col("lag")) & (F.col("score") >= least))
    return p.groupBy(*keys).agg(F.min("lag").alias("period"), F.min_by("score", "lag").alias("score"))


def best_periods(profile: DataFrame, keys: list[str], candidates: list[int], k: int = 3) -> DataFrame:
    """The best lags among ``candidates``, without multiples of a better one: at most k, with rank."""
    p = profile.filter(F.col("lag").isin(candidates) & F.col("score").isNotNull())
    none = F.expr("cast(array() as array<struct<s:double,lag:int>>)")

    def unless_multiple(kept, x):
        known = F.exists(kept, lambda y: x["lag"] % y["lag"] == 0)
        return F.when((F.size(kept) < k) & ~known, F.concat(kept, F.array(x))).otherwise(kept)

    # A sequence's list has no more entries than there are candidates.
    out = p.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "lag"))).alias("_r"))
    out = out.withColumn("_r", F.aggregate("_r", none, unless_multiple))
    return out.select(*keys, F.posexplode("_r").alias("rank", "_x")).select(*keys, "rank", F.col("_x.lag").alias("lag"), (-F.col("_x.s")).alias("score"))


def fold_average(df: DataFrame, keys: list[str], beat: str, period: int, values: list[str]) -> DataFrame:
    """Means of ``values`` at each phase of the period, and rows there."""
    phase = F.pmod(F.col(beat), F.lit(period)).alias("phase")
    return df.groupBy(*keys, phase).agg(*[F.avg(v).alias(v) for v in values], F.count("*").alias("n"))


def slot_votes(df: DataFrame, keys: list[str], beat: str, symbol: str, period: int) -> DataFrame:
    """The commonest symbol at each phase, the first seen on ties, with its share: slots without rows are
    ``N`` with share 0."""
    n = df.groupBy(*keys, F.pmod(F.col(beat), F.lit(period)).alias("slot"), F.col(symbol).alias("label")).agg(F.count("*").alias("n"), F.min(beat).alias("seen"))
    best = n.groupBy(*keys, "slot").agg(F.max_by("label", F.struct("n", -F.col("seen"))).alias("label"), (F.max("n") / F.sum("n")).alias("confidence"))
    slots = best.select(*keys).distinct().select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(period - 1).cast("bigint"))).alias("slot"))
    out = slots.join(best.withColumn("slot", F.col("slot").cast("bigint")), [*keys, "slot"], "left")
    return out.select(*keys, "slot", F.coalesce("label", F.lit("N")).alias("label"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def determinism(df: DataFrame, keys: list[str], beat: str, symbol: str, period: int) -> DataFrame:
    """Mean over phases of the commonest symbol's share, and the share of rows that it covers."""
    n = df.groupBy(*keys, F.pmod(F.col(beat), F.lit(period)).alias("_p"), symbol).agg(F.count("*").alias("n"))
    n = n.groupBy(*keys, "_p").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return n.groupBy(*keys).agg(F.avg(F.col("top") / F.col("n")).alias("determinism"), (F.sum("top") / F.sum("n")).alias("coverage"))


def loop_pattern(df: DataFrame, keys: list[str], order: list[str], beat: str, symbol: str, longest: int = 8, recurrence: float = 0.55, coverage: float = 0.55) -> DataFrame:
    """The loop of 2 to ``longest`` rows: the lag that recurs and whose modal pattern covers enough,
    by its determinism less 0.03 a row; ties go to the shorter. Sequences without one are absent."""
    lags = lag_profile(df, keys, order, symbol, 2, longest).filter((F.col("n") >= 2) & (F.col("score") >= recurrence))
    at = df.select(*keys, beat, symbol, F.explode(F.sequence(F.lit(2), F.lit(longest))).alias("lag"))
    n = at.groupBy(*keys, "lag", F.pmod(F.col(beat), F.col("lag")).alias("_p"), symbol).agg(F.count("*").alias("n"))
    n = n.groupBy(*keys, "lag", "_p").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    n = n.groupBy(*keys, "lag").agg(F.avg(F.col("top") / F.col("n")).alias("determinism"), (F.sum("top") / F.sum("n")).alias("coverage"))
    both = lags.select(*keys, "lag").join(n, [*keys, "lag"]).filter(F.col("coverage") >= coverage)
    score = F.struct(F.col("determinism") - 0.03 * F.col("lag"), -F.col("lag"))
    return both.groupBy(*keys).agg(F.max_by(F.struct("lag", "determinism", "coverage"), score).alias("_b")).select(*keys, "_b.*")


def block_labels(df: DataFrame, keys: list[str], position: str, symbol: str, size: int) -> DataFrame:
    """(keys, block, label): the commonest symbol of every ``size`` rows, the first seen on ties; a last,
    shorter block counts too."""
    n = df.groupBy(*keys, F.floor(F.col(position) / size).alias("block"), F.col(symbol).alias("label")).agg(F.count("*").alias("n"), F.min(position).alias("seen"))
    return n.groupBy(*keys, "block").agg(F.max_by("label", F.struct("n", -F.col("seen"))).alias("label"))


def degenerate_sections(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Whether a sequence's section labels carry no structure: one label only, 18 sections or more, or
    one label with 0.85 of at least 4; never for a single section."""
    n = df.groupBy(*keys, label).agg(F.count("*").alias("n"))
    n = n.groupBy(*keys).agg(F.sum("n").alias("sections"), F.count("*").alias("labels"), F.max("n").alias("top"))
    bad = (F.col("labels") <= 1) | (F.col("sections") >= 18) | ((F.col("sections") >= 4) & (F.col("top") / F.col("sections") >= 0.85))
    return n.withColumn("degenerate", (F.col("sections") >= 2) & bad)


def vetoed_pairs(df: DataFrame, keys: list[str], block: str, symbol: str, least: int = 2, share: float = 0.2, reach: int | None = 8) -> DataFrame:
    """Pairs of a sequence's blocks (at most ``reach`` apart in number, or all where it is None) with the symbols that recur in one (``least`` rows and ``share`` of it) and are wholly absent from the
    other: (keys, a, b, symbol).

    All pairs grow with the square of a sequence's blocks; no others are made on the way, as blocks without a symbol are found before those in which
    it recurs meet them. :func:`vetoed_runs` tells the same in rows that grow with the blocks. A null symbol is absent from every other block.
    """
    n = df.groupBy(*keys, F.col(block).alias("a"), F.col(symbol).alias("symbol")).agg(F.count("*").alias("n"))
    strong = n.withColumn("_all", F.sum("n").over(Window.partitionBy(*keys, "a"))).filter((F.col("n") >= least) & (F.col("n") / F.col("_all") >= share))
    blocks = n.select(*keys, F.col("a").alias("b")).distinct()
    there = n.select(*keys, F.col("a").alias("b"), "symbol")
    without = strong.select(*keys, "symbol").distinct().join(blocks, keys).join(there, [*keys, "b", "symbol"], "left_anti")
    same = without.withColumnRenamed("symbol", "_symbol")
    far = F.lit(True) if reach is None else F.abs(F.col("a") - F.col("b")) <= reach
    met = strong.withColumnsRenamed({k: f"_{k}" for k in keys}).join(same, [F.col(f"_{k}") == F.col(k) for k in keys] + [F.col("symbol").eqNullSafe(F.col("_symbol"))])
    return met.filter((F.col("a") != F.col("b")) & far).select(*keys, "a", "b", "symbol")


def vetoed_runs(df: DataFrame, keys: list[str], block: str, symbol: str, least: int = 2, share: float = 0.2) -> DataFrame:
    """Which blocks of the whole sequence are vetoed: (keys, symbol, first, last, vetoes), the stretches of blocks that hold none of a symbol that recurs
    (``least`` rows and ``share``) in some block, and in how many.

    Every block of a stretch is vetoed by every block in which the symbol recurs (:func:`vetoes` lists these), so all pairs are told
    in rows that grow with the blocks. Blocks are numbered without gaps.
    """
    n = df.groupBy(*keys, F.col(block).alias("a"), F.col(symbol).alias("symbol")).agg(F.count("*").alias("n"))
    strong = n.withColumn("_all", F.sum("n").over(Window.partitionBy(*keys, "a"))).filter((F.col("n") >= least) & (F.col("n") / F.col("_all") >= share))
    strong = strong.groupBy(*keys, "symbol").agg(F.count("*").alias("vetoes"))
    ends = n.groupBy(*keys).agg(F.min("a").alias("_lo"), F.max("a").alias("_hi"))
    held = n.join(strong, [*keys, "symbol"]).join(ends, keys)
    w = Window.partitionBy(*keys, "symbol").orderBy("a")
    held = held.withColumns({"_before": F.coalesce(F.lag("a").over(w) + 1, F.col("_lo")), "_after": F.when(F.lead("a").over(w).isNull(), F.col("_hi"))})
    gaps = F.array(F.struct(F.col("_before").alias("first"), (F.col("a") - 1).alias("last")), F.struct((F.col("a") + 1).alias("first"), F.col("_after").alias("last")))
    return held.select(*keys, "symbol", "vetoes", F.explode(gaps).alias("_g")).filter("_g.first <= _g.last").select(*keys, "symbol", "_g.first", "_g.last", "vetoes")


def vetoes(df: DataFrame, keys: list[str], block: str, symbol: str, least: int = 2, share: float = 0.2) -> DataFrame:
    """For every block and symbol that recurs in it (``least`` rows and ``share`` of it): (keys, a, symbol, n, share,
    absent_from), the last being how many blocks of the whole sequence, near or far, hold none of the symbol.

    A row per block and recurring symbol instead of pairs of blocks; those vetoed are the blocks without the symbol.
    """
    n = df.groupBy(*keys, F.col(block).alias("a"), F.col(symbol).alias("symbol")).agg(F.count("*").alias("n"))
    strong = n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys, "a"))).filter((F.col("n") >= least) & (F.col("share") >= share))
    held = n.groupBy(*keys, "symbol").agg(F.count("*").alias("_held"))
    blocks = n.groupBy(*keys).agg(F.countDistinct("a").alias("_blocks"))
    out = strong.join(held, [*keys, "symbol"]).join(blocks, keys)
    return out.select(*keys, "a", "symbol", "n", "share", (F.col("_blocks") - F.col("_held")).alias("absent_from"))


def phase_of_loop(downbeats: DataFrame, keys: list[str], beat: str, is_downbeat: str, period: int) -> DataFrame:
    """The first downbeat's position modulo the period; 0 without downbeats."""
    first = F.min(F.when(F.col(is_downbeat), F.col(beat)))
    return downbeats.groupBy(*keys).agg(F.coalesce(F.pmod(first, F.lit(period)), F.lit(0)).alias("phase"))


def metre(downbeats: DataFrame, keys: list[str], beat: str, is_downbeat: str) -> DataFrame:
    """The commonest number of beats between downbeats, the smallest on ties."""
    d = downbeats.filter(F.col(is_downbeat))
    d = d.withColumn("_n", F.lead(beat).over(ordered(keys, [beat])) - F.col(beat)).filter("_n > 0")
    d = d.groupBy(*keys, "_n").agg(F.count("*").alias("_c"))
    return d.groupBy(*keys).agg(F.max_by("_n", F.struct("_c", -F.col("_n"))).alias("beats_per_bar"))


def snap_to_pattern(df: DataFrame, keys: list[str], beat: str, symbol: str, confidence: str, pattern: DataFrame, keep: float = 0.75, most_kept: float = 0.35) -> DataFrame:
    """Rows with the loop pattern's symbol (keys, period, slot, label) where it differs and confidence is
    under ``keep``. A sequence in which more than ``most_kept`` of rows would stay deviant is left as it is."""
    p = pattern.select(*keys, "period", F.col("slot").alias("_s"), F.col("label").alias("_label"))
    lengths = pattern.select(*keys, "period").distinct()
    out = df.join(lengths, keys, "left").withColumn("_s", F.pmod(F.col(beat), F.col("period")))
    out = out.join(p, [*keys, "period", "_s"], "left")
    differs = F.coalesce(F.col("_label") != F.col(symbol), F.lit(False))
    out = out.withColumn("_kept", differs & (F.col(confidence) >= keep)).withColumn("_snap", differs & (F.col(confidence) < keep))
    w = Window.partitionBy(*keys)
    settled = F.sum(F.col("_kept").cast("long")).over(w) <= most_kept * F.count("*").over(w)
    out = out.withColumn("snapped", F.col("_snap") & settled)
    return out.withColumn(symbol, F.when(F.col("snapped"), F.col("_label")).otherwise(F.col(symbol))).drop("_s", "_label", "_kept", "_snap", "period")


def pooled_evidence(df: DataFrame, spans: DataFrame, keys: list[str], beat: str, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """Evidence summed over tied spans (group, start, end): spans with the group's commonest length (the
    larger on ties) share sums at each offset; others keep theirs and are reported.

    Returns the rows of used spans with pooled values, and a report of every span with ``used``.
    """
    s = spans.withColumn("_n", F.col("end") - F.col("start"))
    mode = s.groupBy(*keys, "group", "_n").agg(F.count("*").alias("_c")).groupBy(*keys, "group").agg(F.max_by("_n", F.struct("_c", "_n")).alias("_mode"))
    report = s.join(mode, [*keys, "group"]).withColumn("used", F.col("_n") == F.col("_mode"))
    rows = report.filter("used").select(*keys, "group", "start", F.explode(F.sequence(F.lit(0), F.col("_n").cast("int") - 1)).alias("offset"))
    rows = rows.withColumn(beat, F.col("start") + F.col("offset")).join(df, [*keys, beat])
    w = Window.partitionBy(*keys, "group", "offset")
    out = rows.withColumns({v: F.sum(v).over(w) for v in values}).select(*keys, "group", beat, "offset", *values)
    return out, report.select(*keys, "group", "start", "end", "used")
