"""Block structure: the length and phase of a song's repeated blocks, by how well a grid of windows falls into clusters.

Songs of at most BLOCK bars are solved side by side, all their grids at once, as their sorted bars come by. For longer ones similarities of bars
aren't stored or even made for all pairs: what a window has in common with all before it is a sum over the different contents at each of its
places, of how often each was seen and how alike they are.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ostinato.operators.blocks import join_same, kept, whole_sequences
from ostinato.operators.folds import fold_sorted
from ostinato.operators.sequences import ordered

# Lengths tried, the least length, the similarity from which windows are alike, the weights of coverage and length.
LENGTHS, SHORTEST, ALIKE, COVERAGE, SIZE = (4, 8, 16, 32), 4, 0.8, 0.1, 1.0
_DIGITS = 9  # scores that agree to so many places are equal
BLOCK, WIDE = 1024, 16  # bars of a song, and symbols of a bar, up to which songs are solved side by side
_TOGETHER = 1 << 20  # pairs of bars of the songs that are


def likeness(a: tuple, b: tuple) -> float:
    """Equal symbols by place over the longer bar's number; two silent bars are alike, one is like nothing."""
    if not a or not b:
        return 1.0 if len(a) == len(b) else 0.0
    return sum(x == y for x, y in zip(a, b, strict=False)) / max(len(a), len(b))


def _symbols(bars: DataFrame, keys: list[str], index: str, symbols: str) -> DataFrame:
    """keys, _i and _x, the symbols as strings, empty for null."""
    return bars.select(*keys, F.col(index).cast("long").alias("_i"), F.coalesce(F.transform(symbols, lambda x: x.cast("string")), F.array().cast("array<string>")).alias("_x"))


def tilings(bars: DataFrame, keys: list[str], index: str, symbols: str, lengths: tuple[int, ...] = LENGTHS, shortest: int = SHORTEST, alike: float = ALIKE) -> DataFrame:
    """Every grid of windows that a song can be cut into: (keys, period, phase, start, cluster, quality).

    Rows with a ``start`` are windows with their cluster (numbers from 0 in order of appearance), the one row without has the grid's quality: the mean
    similarity of windows in one cluster less that of windows in two (0 without such), or -1 if no cluster has two. In order, a window joins the cluster
    whose first window it is most like, the later of equals, if that reaches ``alike``, else begins one. Periods are those of ``lengths`` from
    ``shortest`` up to half a song. ``symbols`` are arrays, ``index`` counts bars from 0 without gaps; null symbols are a silent bar.

    Each grid is one pass over its sorted windows. Its state are the clusters' first windows and, for every place in a window and every cluster,
    how often each different content was seen there.
    """
    b = _symbols(bars, keys, index, symbols)
    sizes = b.groupBy(*keys).agg(F.count("*").alias("_n"))
    wide = join_same(b, sizes, keys).withColumn("period", F.explode(F.array(*map(F.lit, lengths)))).filter((F.col("period") >= shortest) & (F.col("period") * 2 <= F.col("_n")) & (F.col("_n") >= 2 * shortest))
    wide = wide.withColumn("phase", F.explode(F.sequence(F.lit(0), F.col("period") - 1))).filter("_i >= phase")
    wide = wide.withColumn("start", F.col("phase") + F.expr("(_i - phase) div period") * F.col("period")).filter("start + period <= _n")
    windows = wide.groupBy(*keys, "period", "phase", "start").agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_w")).select(*keys, "period", "phase", "start", F.col("_w._x").alias("window"))

    def make():
        firsts: list[list[tuple]] = []
        members: list[int] = []
        seen: list[list[Counter]] = []  # of each cluster, by place
        known: dict[tuple, float] = {}
        total = [0.0, 0.0]  # of all pairs, of pairs in one cluster

        def like(a: tuple, b: tuple) -> float:
            s = known.get((a, b))
            if s is None:
                s = known[a, b] = likeness(a, b)
            return s

        def step(row):
            w = [tuple(x) for x in row.window]
            best, top = -1, alike
            for k, f in enumerate(firsts):
                s = sum(map(like, w, f)) / len(w)
                if s >= top:
                    best, top = k, s
            if best < 0:
                best = len(firsts)
                firsts.append(w)
                members.append(0)
                seen.append([Counter() for _ in w])
            for k, places in enumerate(seen):
                s = sum(n * like(x, y) for x, place in zip(w, places, strict=True) for y, n in place.items()) / len(w)
                total[0] += s
                total[1] += s if k == best else 0.0
            members[best] += 1
            for x, place in zip(w, seen[best], strict=True):
                place[x] += 1
            return [(row.start, best, None)]

        def end():
            n = sum(members)
            inside = sum(m * (m - 1) // 2 for m in members)
            across = n * (n - 1) // 2 - inside
            if n < 2:
                return []
            q = (total[1] / inside - ((total[0] - total[1]) / across if across else 0.0)) if inside else -1.0
            return [(None, None, q)]

        return step, end

    fields = [StructField("start", LongType()), StructField("cluster", IntegerType()), StructField("quality", DoubleType())]
    return fold_sorted(windows, [*keys, "period", "phase"], ["start"], make, fields)


def _likenesses(x: np.ndarray, size: np.ndarray, period: int) -> np.ndarray:
    """How alike two windows of each song are: (phase, window, window, song), from symbols (place in a bar, bar, song; -1 where a bar has none) and their number by bar.

    Bars beyond a song's end are any. Sums are exact integers where every bar has one symbol, else of extended precision.
    """
    plain = len(x) == 1 and bool((size == 1).all())
    at = np.arange(period)[:, None] + period * np.arange(size.shape[0] // period)
    total = np.zeros((*at.shape, at.shape[1], size.shape[1]), dtype=np.longdouble if not plain else np.uint8 if period < 256 else np.int64)
    for k in range(period):
        bar = np.minimum(at + k, size.shape[0] - 1)
        if plain:
            one = x[0, bar]
            total += (one[:, :, None] == one[:, None]).view(np.uint8)
            continue
        same = np.zeros(total.shape)
        for one in x[:, bar]:
            same += (one[:, :, None] == one[:, None]) & (one[:, None] >= 0)
        most = np.maximum(size[bar][:, :, None], size[bar][:, None])
        total += np.where(most > 0, same / np.maximum(most, 1), 1.0)
    return total.astype(float) / period


def _clusters(s: np.ndarray, alike: float) -> np.ndarray:
    """The cluster of each window (phase, window, song): that of the first window it is most like, the later of equals, or a new one."""
    phases, windows, _, songs = s.shape
    cluster, first, n = np.zeros((phases, windows, songs), dtype=np.int32), np.zeros((phases, windows, songs), dtype=bool), np.zeros((phases, songs), dtype=np.int32)
    for j in range(windows):
        new, of = np.ones((phases, songs), dtype=bool), n
        if j:
            good = first[:, :j] & (s[:, j, :j] >= alike)
            new = ~good.any(axis=1)
            hit = j - 1 - np.where(good, s[:, j, :j], -1.0)[:, ::-1].argmax(axis=1)
            of = np.where(new, n, np.take_along_axis(cluster, hit[:, None], 1)[:, 0])
        cluster[:, j], first[:, j] = of, new
        n = n + new
    return cluster


def _best_grids(x: np.ndarray, size: np.ndarray, n: np.ndarray, lengths: list[int], alike: float):
    """Of each song the period (0: no grid fits), phase, number of windows and score of its best grid, and its windows' clusters (song, window)."""
    songs = len(n)
    period, phase, number = (np.zeros(songs, dtype=np.int64) for _ in range(3))
    score, clusters = np.full(songs, -np.inf), np.zeros((songs, len(size) // lengths[0] if lengths else 0), dtype=np.int32)
    for p in lengths:
        fits = np.flatnonzero(2 * p <= n)
        if not len(fits):
            continue
        m = n[fits]
        bars = int(m.max())
        s = _likenesses(x[:, :bars, fits], size[:bars, fits], p)
        cluster = _clusters(s, alike)
        k = (m - np.arange(p)[:, None]) // p
        windows = s.shape[1]
        there = (np.arange(windows)[:, None] < np.arange(windows))[None, :, :, None] & (np.arange(windows)[:, None] < k[:, None])[:, None]
        same = there & (cluster[:, :, None] == cluster[:, None])
        inside, across = same.sum(axis=(1, 2)), (there & ~same).sum(axis=(1, 2))
        total, within = np.where(there, s, 0.0).sum(axis=(1, 2)), np.where(same, s, 0.0).sum(axis=(1, 2))
        quality = np.where(inside > 0, within / np.maximum(inside, 1) - (total - within) / np.maximum(across, 1), -1.0)
        value = np.floor((quality + COVERAGE * k * p / m + SIZE * p / m) * 10.0**_DIGITS + 0.5) / 10.0**_DIGITS
        value = np.where(k >= 2, value, -np.inf)
        found = value.argmax(axis=0)
        here = np.arange(len(fits))
        top = value[found, here]
        up = top > score[fits]
        to, found, here = fits[up], found[up], here[up]
        score[to], period[to], phase[to], number[to] = top[up], p, found, k[found, here]
        clusters[to, :windows] = cluster[found, :, here]
    return period, phase, number, score, clusters


def _detected_beside(rows: DataFrame, keys: list[str], lengths: tuple[int, ...], shortest: int, alike: float) -> DataFrame:
    """:func:`detect_blocks` of songs of moderate length, whose grids are made, compared and left in one walk."""
    rows = rows.withColumn("_row", F.row_number().over(ordered(keys, ["_i"]))).sortWithinPartitions(*keys, "_i")  # they are: the window's order
    tried = sorted({p for p in lengths if p >= shortest})

    def run(batches):
        for table, bounds in whole_sequences(batches):
            column = table.column("_x").chunk(0)
            offset, code = column.offsets.to_numpy(), column.values.dictionary_encode(null_encoding="encode").indices.to_numpy()
            start, length = bounds[:-1], np.diff(bounds)
            by_length, i = np.argsort(-length, kind="stable"), 0
            while i < len(by_length):
                longest = int(length[by_length[i]])
                some = by_length[i : i + max(1, _TOGETHER // longest**2)]
                i += len(some)
                yield blocks(table, start[some], length[some], offset, code)

    def blocks(table, start, n, offset, code):
        there = np.arange(n.max())[:, None] < n
        bar = np.where(there, start + np.arange(n.max())[:, None], start)
        size = offset[bar + 1] - offset[bar]
        place = np.arange(max(1, size.max()))[:, None, None]
        x = np.full((len(place), *bar.shape), -1, dtype=np.int32)
        known = place < size
        x[known] = code[(offset[bar] + place)[known]]
        period, phase, k, score, clusters = _best_grids(x, size, n, tried, alike)
        none = period == 0
        tail = phase + k * period
        song, window = np.nonzero(np.arange(clusters.shape[1]) < np.where(none, 0, k)[:, None])
        before, after, alone = np.flatnonzero(~none & (phase > 0)), np.flatnonzero(~none & (tail < n)), np.flatnonzero(none)
        of = np.concatenate([song, before, after, alone])
        begin = np.concatenate([phase[song] + window * period[song], np.zeros(len(before), dtype=np.int64), tail[after], np.zeros(len(alone), dtype=np.int64)])
        end = np.concatenate([phase[song] + (window + 1) * period[song], phase[before], n[after], n[alone]])
        cluster = np.concatenate([clusters[song, window], np.full(len(before) + len(after), -1), np.zeros(len(alone))]).astype(np.int32)
        values = [pa.array(v) for v in (begin, end, cluster, np.where(none, n, period)[of], np.where(none, 0, phase)[of])]
        values.append(pa.array(score[of], mask=none[of]))
        songs = pa.array(start[of])
        return pa.RecordBatch.from_arrays([*(table.column(c).chunk(0).take(songs) for c in keys), *values], names=[*keys, "start", "end", "cluster", "period", "phase", "score"])

    fields = StructType.fromDDL("start long, end long, cluster int, period long, phase long, score double").fields
    return rows.mapInArrow(run, StructType(rows.select(*keys).schema.fields + fields))


def detect_blocks(bars: DataFrame, keys: list[str], index: str, symbols: str, lengths: tuple[int, ...] = LENGTHS, shortest: int = SHORTEST, alike: float = ALIKE, block: int = BLOCK) -> DataFrame:
    """(keys, start, end, cluster, period, phase, score): the blocks of each song's best grid, end exclusive.

    A grid scores its quality, a tenth of the share of bars it covers, and its period over the song's bars, so that sections win over the phrases
    inside them; of equal grids the shorter period, then the earlier phase wins. Bars before the phase and after the last window are
    blocks of cluster -1. A song that no grid fits is one block of cluster 0, with its length as the period and no score. Songs of more than
    ``block`` bars, or with a bar of more than WIDE symbols, are solved grid by grid as :func:`tilings` makes them.
    """
    rows = _symbols(bars, keys, index, symbols)
    far = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(F.size("_x")).alias("_wide")).filter((F.col("_n") > block) | (F.col("_wide") > WIDE)).select(*keys)
    if far.isEmpty():
        return _detected_beside(rows, keys, lengths, shortest, alike)
    near = _detected_beside(join_same(rows, far, keys, "left_anti"), keys, lengths, shortest, alike)
    return near.union(_detected_by_grid(join_same(bars, far, keys, "left_semi"), keys, index, symbols, lengths, shortest, alike))


def _detected_by_grid(bars: DataFrame, keys: list[str], index: str, symbols: str, lengths: tuple[int, ...], shortest: int, alike: float) -> DataFrame:
    """:func:`detect_blocks` of songs of any length, each grid in a pass of its own."""
    grids = kept(tilings(bars, keys, index, symbols, lengths, shortest, alike))
    sizes = bars.groupBy(*keys).agg(F.count("*").alias("_n"))
    counts = grids.filter("start is not null").groupBy(*keys, "period", "phase").agg(F.count("*").alias("_k"))
    scored = join_same(join_same(grids.filter("quality is not null").drop("start", "cluster"), counts, [*keys, "period", "phase"]), sizes, keys)
    scored = scored.withColumn("score", F.round(F.col("quality") + COVERAGE * F.col("_k") * F.col("period") / F.col("_n") + SIZE * F.col("period") / F.col("_n"), _DIGITS))
    best = scored.groupBy(*keys).agg(F.max_by(F.struct("period", "phase", "score", "_k"), F.struct("score", -F.col("period"), -F.col("phase"))).alias("_b")).select(*keys, "_b.*")
    best = join_same(sizes, best, keys, "left")
    inside = join_same(grids.filter("start is not null").drop("quality"), best.filter("period is not null").select(*keys, "period", "phase", "score"), [*keys, "period", "phase"])
    inside = inside.select(*keys, "start", (F.col("start") + F.col("period")).alias("end"), "cluster", F.col("period").cast("long").alias("period"), F.col("phase").cast("long").alias("phase"), "score")
    piece = lambda start, end, cluster, period: (F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(cluster).alias("cluster"), period.cast("long").alias("period"))))
    tail = F.col("phase") + F.col("_k") * F.col("period")
    rest = F.when(F.col("period").isNull(), piece(F.lit(0), F.col("_n"), 0, F.col("_n"))).otherwise(F.concat(piece(F.lit(0), F.col("phase"), -1, F.col("period")), piece(tail, F.col("_n"), -1, F.col("period"))))
    rest = best.withColumn("_r", F.explode(rest)).select(*keys, F.col("_r.start").alias("start"), F.col("_r.end").alias("end"), F.col("_r.cluster").alias("cluster"), F.col("_r.period").alias("period"), F.coalesce("phase", F.lit(0)).cast("long").alias("phase"), "score")
    return inside.union(rest.filter(F.col("end") > F.col("start")))
