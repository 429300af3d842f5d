"""Most likely paths and segmentations: plain versions over one array, and operators that solve long sequences in blocks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ostinato.operators import lattice as L


def best_path(emission: np.ndarray, transition: np.ndarray, initial: np.ndarray) -> tuple[np.ndarray, float]:
    """States and log score of the best path; of equal scores the lowest state wins at each step."""
    n, k = emission.shape
    score, back = initial + emission[0], np.zeros((n, k), dtype=np.int64)
    for t in range(1, n):
        arrive = score[:, None] + transition
        back[t] = arrive.argmax(axis=0)
        score = arrive[back[t], np.arange(k)] + emission[t]
    path = np.empty(n, dtype=np.int64)
    path[-1] = score.argmax()
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path, float(score.max())


def best_segments(emission: np.ndarray, log_duration: np.ndarray, weight: float = 1.0) -> list[tuple[int, int, int]]:
    """(start, end, state) of the best segmentation, each segment scored by its emissions and ``weight``
    times the log probability of its length (states x lengths from 1); equal scores prefer short last
    segments, then low states. Neighbouring segments may have the same state."""
    n, k = emission.shape
    total = np.vstack([np.zeros(k), np.cumsum(emission, axis=0)])
    best, choice = np.full(n + 1, -np.inf), [(0, 0)] * (n + 1)
    best[0] = 0.0
    for end in range(1, n + 1):
        for d in range(1, min(end, log_duration.shape[1]) + 1):
            s = best[end - d] + total[end] - total[end - d] + weight * log_duration[:, d - 1]
            state = int(s.argmax())
            if s[state] > best[end]:
                best[end], choice[end] = s[state], (d, state)
    out, end = [], n
    while end:
        d, state = choice[end]
        if not d:
            raise ValueError("no segmentation has a positive probability")
        out.append((end - d, end, state))
        end -= d
    return out[::-1]


def best_timed_path(emission: np.ndarray, transition: np.ndarray, initial: np.ndarray, log_duration: np.ndarray) -> tuple[list[tuple[int, int, int]], float]:
    """(start, end, state) of the best segmentation and its log score, each segment scored by its emissions, its length
    (states x lengths from 1) and the step from the state before it, which may be the same; the first by ``initial``.
    Equal scores prefer short last segments, then low states before."""
    n, k = emission.shape
    total = np.vstack([np.zeros(k), np.cumsum(emission, axis=0)])
    best, choice = np.full((n + 1, k), -np.inf), np.zeros((n + 1, k, 2), dtype=np.int64)
    enter = np.full((n + 1, k), -np.inf)  # the best way into each state at each place, and from where
    enter[0], origin = initial, np.zeros((n + 1, k), dtype=np.int64)
    for end in range(1, n + 1):
        for d in range(1, min(end, log_duration.shape[1]) + 1):
            s = enter[end - d] + total[end] - total[end - d] + log_duration[:, d - 1]
            up = s > best[end]
            best[end, up], choice[end, up, 0], choice[end, up, 1] = s[up], d, origin[end - d][up]
        step = best[end][:, None] + transition
        origin[end], enter[end] = step.argmax(axis=0), step.max(axis=0)
    state, end, out = int(best[n].argmax()), n, []
    if not np.isfinite(best[n, state]):
        raise ValueError("no segmentation has a positive probability")
    while end:
        d, before = choice[end, state]
        out.append((end - int(d), end, state))
        end, state = end - int(d), int(before)
    return out[::-1], float(best[n].max())


def emissions(roots: np.ndarray, kinds: np.ndarray | None = None, weight: float = 1.0, floor: float = 1e-9) -> np.ndarray:
    """Log emissions of root x kind states, root first, from posteriors of roots and perhaps of kinds (weighted)."""
    r = np.log(np.maximum(roots, floor))
    q = weight * np.log(np.maximum(kinds, floor)) if kinds is not None else np.zeros((len(roots), 1))
    return (r[:, :, None] + q[:, None, :]).reshape(len(roots), -1)


def durations(pmf: np.ndarray, states: int, floor: float = 1e-6) -> np.ndarray:
    """Log probabilities of lengths for every state: one distribution for all, or one per kind, repeated by root."""
    p = np.log(np.maximum(np.atleast_2d(np.asarray(pmf, dtype=float)), floor))
    return np.tile(p, (states // len(p), 1))


def viterbi(df: DataFrame, keys: list[str], order: str, emission: str, transition: list[list[float]], initial: list[float]) -> DataFrame:
    """keys, order, state and the path's log score for every row; ``emission`` holds log-likelihoods of the
    states, null rows count as uninformative. Columns besides keys and order are dropped. Sequences are solved in blocks."""
    k = len(initial)
    rows = df.withColumns({"_labels": F.array(*map(F.lit, range(k))), "_scores": F.coalesce(emission, F.array(*[F.lit(0.0)] * k))})
    out = L.best_paths(rows, keys, [order], L.Steps(transition, initial), "_labels", "_scores")
    return out.select(*keys, order, F.col("choice").alias("state"), "log_score")


def semi_markov(
    df: DataFrame, keys: list[str], order: str, emission: str, log_duration: list[list[float]], weight: float = 1.0, transition: list[list[float]] | None = None, initial: list[float] | None = None
) -> DataFrame:
    """keys, segment (from 0), start and end (rows, end exclusive), state and log_score of the best segmentation.

    A segment scores its emissions and ``weight`` times the log probability of its length (``log_duration``: states x lengths from 1),
    with ``transition`` (and perhaps ``initial``) also the step from the state before it, which may be the same. Of equal segmentations low
    states win, then short segments, from the last one back. A state of the lattice is a state and the rows since its segment began, so
    a block's product has (states x lengths) squared numbers. A sequence that no segmentation fits raises ValueError where it is solved.
    """
    lengths = np.asarray(log_duration, dtype=float) * weight
    k, d = lengths.shape
    step = np.full((k, d, k, d), -np.inf)
    for age in range(d - 1):
        step[range(k), age, range(k), age + 1] = 0.0
    step[:, :, :, 0] = lengths[:, :, None] + (0.0 if transition is None else np.asarray(transition, dtype=float)[:, None, :])
    first = np.full((k, d), -np.inf)
    first[:, 0] = 0.0 if initial is None else initial
    steps = L.Steps(step.reshape(k * d, k * d), first.ravel(), lengths.ravel())
    rows = df.withColumns({"_labels": F.array(*map(F.lit, range(k * d))), "_scores": F.flatten(F.transform(emission, lambda x: F.array_repeat(x, d)))})
    path = L.best_paths(rows, keys, [order], steps, "_labels", "_scores")
    by_row = Window.partitionBy(*keys).orderBy(order)  # one sort for both: of each row's number and of the segments begun so far
    segment = F.sum((F.col("choice") % d == 0).cast("int")).over(by_row.rowsBetween(Window.unboundedPreceding, 0))
    score = F.when(F.col("log_score") <= L.LOWEST, F.raise_error(F.lit("no segmentation has a positive probability"))).otherwise(F.col("log_score"))
    path = path.select(*keys, F.row_number().over(by_row).alias("_row"), segment.alias("_segment"), F.expr(f"choice div {d}").cast("int").alias("state"), score.alias("log_score"))
    out = path.groupBy(*keys, "_segment").agg(F.min("_row").alias("_a"), F.max("_row").alias("_z"), F.first("state").alias("state"), F.first("log_score").alias("log_score"))
    return out.select(*keys, (F.col("_segment") - 1).cast("int").alias("segment"), (F.col("_a") - 1).cast("int").alias("start"), F.col("_z").cast("int").alias("end"), "state", "log_score")
