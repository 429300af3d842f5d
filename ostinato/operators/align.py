"""Alignment of two sequences of symbols: time warping over transpositions, and global alignment by scores.

Both sequences of a key go to one task, with a matrix of their lengths' product: meant for songs, not for endless ones.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType


def warp(cost: np.ndarray) -> tuple[float, list[tuple[int, int]]]:
    """(cost over the longer length, path) of the cheapest warping; backwards, ties go to both, then to the second's
    step, then to the first's. Without rows or columns the cost is infinite."""
    n, m = cost.shape
    if not n or not m:
        return float("inf"), []
    d = np.full((n + 1, m + 1), np.inf)
    d[0, 0] = 0.0
    for i in range(1, n + 1):
        up = np.minimum(d[i - 1, 1:], d[i - 1, :-1])
        row, last = d[i], np.inf
        for j in range(m):
            last = cost[i - 1, j] + min(up[j], last)
            row[j + 1] = last
    i, j, path = n, m, []
    while i and j:
        path.append((i - 1, j - 1))
        _, step = min((d[i - 1, j - 1], 0), (d[i, j - 1], 1), (d[i - 1, j], 2))
        i, j = i - (step != 1), j - (step != 2)
    return float(d[n, m]) / max(n, m), path[::-1]


def chord_costs(roots_a, kinds_a, roots_b, kinds_b, same_kind: float = 0.0, other_kind: float = 0.4) -> np.ndarray:
    """Costs of all pairs of chords: 1 for other roots, else by whether the kinds agree."""
    roots = np.asarray(roots_a)[:, None] == np.asarray(roots_b)[None, :]
    kinds = np.asarray(kinds_a)[:, None] == np.asarray(kinds_b)[None, :]
    return np.where(roots, np.where(kinds, same_kind, other_kind), 1.0)


def _cogrouped(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], run, fields: list[StructField]) -> DataFrame:
    known = {f.name: f for f in a.schema}
    schema = StructType([known[k] for k in keys] + fields)

    def both(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({f.name: [] for f in schema})
        rows = run(x.sort_values(columns[0]), y.sort_values(columns[0]))
        return pd.DataFrame([(*x[keys].iloc[0], *r) for r in rows], columns=schema.names)

    chosen = [*keys, *columns]
    return a.select(*chosen).groupBy(*keys).cogroup(b.select(*chosen).groupBy(*keys)).applyInPandas(both, schema)


def warped(a: DataFrame, b: DataFrame, keys: list[str], order: str, root: str, kind: str) -> DataFrame:
    """The second sequence moved by the semitones (0..11, the fewest on ties) at which it warps onto the first most cheaply: keys,
    transpose, cost, and the path as rows i, j (numbers of rows from 0). Keys on one side only give nothing."""

    def run(x, y):
        best = (float("inf"), 0, [])
        for by in range(12):
            cost, path = warp(chord_costs(x[root], x[kind], (y[root].to_numpy() + by) % 12, y[kind]))
            if cost < best[0]:
                best = (cost, by, path)
        return [(best[1], best[0], i, j) for i, j in best[2]]

    fields = [StructField("transpose", IntegerType()), StructField("cost", DoubleType()), StructField("i", LongType()), StructField("j", LongType())]
    return _cogrouped(a, b, keys, [order, root, kind], run, fields)


def align(a: list, b: list, match: float = 2, mismatch: float = -1, gap: float = -1) -> list[tuple[int, int]]:
    """Pairs of places of a best global alignment; backwards, ties go to a pair, then to a gap in the second."""
    n, m = len(a), len(b)
    d = np.zeros((n + 1, m + 1))
    d[:, 0], d[0, :] = gap * np.arange(n + 1), gap * np.arange(m + 1)
    s = np.where(np.array(a, dtype=object)[:, None] == np.array(b, dtype=object)[None, :], match, mismatch) if n and m else np.zeros((n, m))
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i, j] = max(d[i - 1, j - 1] + s[i - 1, j - 1], d[i - 1, j] + gap, d[i, j - 1] + gap)
    i, j, out = n, m, []
    while i and j:
        if d[i, j] == d[i - 1, j - 1] + s[i - 1, j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif d[i, j] == d[i - 1, j] + gap:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def aligned(a: DataFrame, b: DataFrame, keys: list[str], order: str, symbol: str, match: float = 2, mismatch: float = -1, gap: float = -1) -> DataFrame:
    """Rows i, j of a best global alignment of two sequences of symbols. Keys on one side only give nothing."""
    run = lambda x, y: align(x[symbol].tolist(), y[symbol].tolist(), match, mismatch, gap)
    return _cogrouped(a, b, keys, [order, symbol], run, [StructField("i", LongType()), StructField("j", LongType())])


def part_costs(query: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Cosine distances of the rows of two matrices; rows without length are 1 from all."""
    u, v = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) for x in (query, text))
    return 1 - np.clip(u @ v.T, -1, 1)


def warp_part(cost: np.ndarray) -> tuple[float, list[tuple[int, int]]]:
    """As ``warp``, but the first sequence may begin and end anywhere in the second; the first best end counts."""
    n, m = cost.shape
    d = np.full((n + 1, m + 1), np.inf)
    d[0, :] = 0.0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            d[i, j] = cost[i - 1, j - 1] + min(d[i - 1, j - 1], d[i, j - 1], d[i - 1, j])
    j = int(d[n, 1:].argmin()) + 1
    i, path = n, []
    score = float(d[n, j])
    while i:
        path.append((i - 1, j - 1))
        _, step = min((d[i - 1, j - 1], 0), (d[i, j - 1], 1), (d[i - 1, j], 2))
        i, j = i - (step != 1), j - (step != 2)
    return score, path[::-1]


def placed(query: DataFrame, text: DataFrame, keys: list[str], order: str, vector: str) -> DataFrame:
    """Where a sequence of vectors fits best into a longer one of the same key: the path as rows i, j, and its cost."""

    def run(x, y):
        cost, path = warp_part(part_costs(np.stack(x[vector].to_list()), np.stack(y[vector].to_list())))
        return [(cost, i, j) for i, j in path]

    return _cogrouped(query, text, keys, [order, vector], run, [StructField("cost", DoubleType()), StructField("i", LongType()), StructField("j", LongType())])


def times_of(path: DataFrame, times: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, j, start, end): when each row of the second sequence sounds, by the first's rows (``order`` from 0, start, end) on its path."""
    t = times.withColumn("i", F.col(order).cast("long")).select(*keys, "i", "start", "end")
    return path.join(t, [*keys, "i"]).groupBy(*keys, "j").agg(F.min("start").alias("start"), F.max("end").alias("end"))
