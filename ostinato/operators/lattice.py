"""Best paths and posterior marginals over sequences of any length.

Sequences of at most BLOCK rows are walked side by side, many in one step, as their sorted rows come by. A longer one is cut into blocks of BLOCK rows by a range partitioning, so that no task needs a whole one. A block's product of step
matrices says what it costs to cross it from each state to each; a short pass over a sequence's block products
(one for every BLOCK rows, of states by states) gives what comes before and after each block, with which the block is solved on
its own. Best paths add integers of 2**-30, so the sums are the same in whichever order blocks are joined.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ostinato.operators.blocks import join_same, kept, run_blocks
from ostinato.operators.sequences import ordered

BLOCK = 1024
UNIT = 2.0**30
_NEVER = -(1 << 60)  # the score of what can't be, as an integer
LOWEST = _NEVER / UNIT / 2  # best scores below it are those of no path
_NO = -1e30  # and as a logarithm of a probability
_ABSENT, _NONE = 3 * _NEVER, 2 * _NO  # what fills up rows of fewer states than others, below both
_SIDE = 512  # sequences that are walked side by side


def _fixed(x) -> np.ndarray:
    """Scores as integers of 2**-30; what can't be (or is below -2**30) as _NEVER."""
    x = np.asarray(x, dtype=float)
    return np.where(x > -UNIT, np.rint(np.where(x > -UNIT, x, 0) * UNIT).astype(np.int64), _NEVER)


def _best(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) product."""
    return np.maximum((a[:, :, None] + b[None]).max(axis=1), _NEVER)


def _sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of matrices of logarithms."""
    x = a[:, :, None] + b[None]
    top = np.maximum(x.max(axis=1), _NO)
    return top + np.log(np.maximum(np.exp(x - top[:, None, :]).sum(axis=1), 1e-300))


class Steps:
    """Transition scores between the labels of neighbouring rows, and those of a sequence's first and last label."""

    def __init__(self, transition, initial=None, final=None):
        t = np.asarray(transition, dtype=float)
        ends = [np.zeros(len(t)) if x is None else np.asarray(x, dtype=float) for x in (initial, final)]
        self.exact = [_fixed(x) for x in (t, *ends)]
        self.log = [np.maximum(x, _NO) for x in (t, *ends)]

    def product(self, labels: list, scores: list, exact: bool) -> np.ndarray:
        """What crossing these rows scores, from each state of the first to each of the last, their emissions included."""
        t, times = (self.exact[0], _best) if exact else (self.log[0], _sum)
        out = np.full((len(scores[0]),) * 2, _NEVER if exact else _NO)
        np.fill_diagonal(out, scores[0])
        for k in range(1, len(scores)):
            out = times(out, t[np.ix_(labels[k - 1], labels[k])] + scores[k])
        return out

    def forward(self, before, before_labels, labels, scores):
        """Best integer scores and back-pointers of each row; the first row's point into the row before the block."""
        t, first, _ = self.exact
        if before is None:
            score, back = [np.maximum(first[labels[0]] + scores[0], _NEVER)], [np.zeros(len(scores[0]), dtype=np.int64)]
        else:
            score, back = [], []
            labels, scores = [before_labels, *labels], [before, *scores]
            score.append(before)
        for k in range(1, len(scores)):
            arrive = score[-1][:, None] + t[np.ix_(labels[k - 1], labels[k])]
            back.append(arrive.argmax(axis=0))
            score.append(np.maximum(arrive.max(axis=0) + scores[k], _NEVER))
        return (score, back) if before is None else (score[1:], back)

    def marginals(self, before, after, labels, scores) -> list[np.ndarray]:
        """Posterior probabilities of each row's states, given logarithms of what enters the first and leaves the last."""
        t = self.log[0]
        alpha, beta = [before + scores[0]], [after]
        for k in range(1, len(scores)):
            alpha.append(_sum(alpha[-1][None], t[np.ix_(labels[k - 1], labels[k])])[0] + scores[k])
        for k in range(len(scores) - 1, 0, -1):
            beta.append(_sum(t[np.ix_(labels[k - 1], labels[k])], (scores[k] + beta[-1])[:, None])[:, 0])
        out = []
        for a, b in zip(alpha, beta[::-1], strict=True):
            p = np.exp(a + b - (a + b).max())
            out.append(p / p.sum())
        return out


def _lists(column, row: int) -> list[np.ndarray]:
    """The arrays in one row of a list of lists."""
    inner = column[row].values
    offset, flat = inner.offsets.to_numpy(), inner.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(offset[:-1], offset[1:], strict=True)]


def _block(batch, row: int, exact: bool):
    labels, scores = (_lists(batch.column(batch.schema.get_field_index(c)), row) for c in ("labels", "scores"))
    return labels, [_fixed(s) if exact else np.maximum(s.astype(float), _NO) for s in scores]


def _products(blocks: DataFrame, keys: list[str], steps, exact: bool) -> DataFrame:
    """keys, at, and of each block its first and last row's labels and its product, as bytes."""

    def run(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                labels, scores = _block(batch, i, exact)
                parts = [np.asarray(x, dtype=np.int32) for x in (labels[0], labels[-1])] + [steps.value.product(labels, scores, exact)]
                out.append([np.ascontiguousarray(x).tobytes() for x in parts])
            cols = [batch.column(batch.schema.get_field_index(c)) for c in [*keys, "at"]]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array([r[k] for r in out], pa.binary()) for k in range(3))], names=[*keys, "at", "first", "last", "crossing"])

    fields = blocks.select(*keys, "at").schema.fields + StructType.fromDDL("first binary, last binary, crossing binary").fields
    return blocks.mapInArrow(run, StructType(fields))


def _unpacked(g: pd.DataFrame, kind) -> list[tuple]:
    out = []
    for f, e, c in zip(g["first"], g["last"], g["crossing"], strict=True):
        f, e = np.frombuffer(f, dtype=np.int32), np.frombuffer(e, dtype=np.int32)
        out.append((f, e, np.frombuffer(c, dtype=kind).reshape(len(f), len(e))))
    return out


class _Rows:
    """The states of rows one after another; a step over many sequences takes one row of each, filled up to the most states."""

    def __init__(self, labels, scores):
        self.offset = labels.offsets.to_numpy()
        self.labels, self.scores = (x.values.to_numpy(zero_copy_only=False) for x in (labels, scores))

    def at(self, rows: np.ndarray):
        n = self.offset[rows + 1] - self.offset[rows]
        place = self.offset[rows][:, None] + np.arange(n.max())
        there = np.arange(n.max()) < n[:, None]
        return np.where(there, place, self.offset[rows][:, None]), there


def _paths_beside(steps: Steps, rows: _Rows, start: np.ndarray, length: np.ndarray, choice: np.ndarray, total: np.ndarray) -> None:
    """Choices and totals of sequences, longest first, written to their rows' places."""
    t, first, final = steps.exact
    scores, backs, state = _fixed(rows.scores), [], np.zeros(len(start), dtype=np.int64)
    best = np.zeros(len(start))
    for k in range(length[0]):
        live = int(np.searchsorted(-length, -k))
        place, there = rows.at(start[:live] + k)
        label = rows.labels[place]
        if k:
            arrive = score[:live, :, None] + t[before[:live, :, None], label[:, None, :]]  # noqa: F821
            backs.append(arrive.argmax(axis=1))
            came = np.take_along_axis(arrive, backs[-1][:, None, :], 1)[:, 0]
        else:
            came = first[label]
        score, before = np.where(there, np.maximum(came + scores[place], _NEVER), _ABSENT), label
        done = slice(int(np.searchsorted(-length, -(k + 1))), live)
        ends = np.where(there[done], score[done] + final[label[done]], _ABSENT)
        if len(ends):
            state[done], best[done] = ends.argmax(axis=1), ends.max(axis=1) / UNIT
    for k in range(length[0] - 1, -1, -1):
        live = int(np.searchsorted(-length, -k))
        choice[start[:live] + k], total[start[:live] + k] = state[:live], best[:live]
        if k:
            state[:live] = backs[k - 1][np.arange(live), state[:live]]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = np.maximum(x.max(axis=axis, keepdims=True), _NO)
    return top.squeeze(axis) + np.log(np.maximum(np.exp(x - top).sum(axis=axis), 1e-300))


def _shares_beside(steps: Steps, rows: _Rows, start: np.ndarray, length: np.ndarray, out: np.ndarray) -> None:
    """Marginals of sequences, longest first, written to their states' places."""
    t, first, final = steps.log
    scores, known = np.maximum(rows.scores.astype(float), _NO), []
    for k in range(length[0]):
        live = int(np.searchsorted(-length, -k))
        place, there = rows.at(start[:live] + k)
        label = rows.labels[place]
        came = _log_sum(known[-1][3][:live, :, None] + t[known[-1][2][:live, :, None], label[:, None, :]], 1) if k else first[label]
        known.append((place, there, label, np.where(there, came + scores[place], _NONE)))
    beta = None
    for k in range(length[0] - 1, -1, -1):
        place, there, label, alpha = known[k]
        after = final[label]
        if beta is not None:
            ahead, present, onward, _ = known[k + 1]
            leave = np.where(present, scores[ahead] + beta, _NONE)
            after[: len(beta)] = _log_sum(t[label[: len(beta), :, None], onward[:, None, :]] + leave[:, None, :], 2)
        beta = after
        both = np.where(there, alpha + beta, -np.inf)
        share = np.exp(both - both.max(axis=1, keepdims=True))
        out[place[there]] = (share / share.sum(axis=1, keepdims=True))[there]


def _whole(df: DataFrame, keys: list[str], order: list[str], steps: Steps, labels: str, scores: str, carried: list[str], path: bool, shares: bool) -> DataFrame:
    """Sequences of moderate length, solved as their sorted rows come by: keys, order, ``carried``, and choice and log_score, and marginals."""
    shared = df.sparkSession.sparkContext.broadcast(steps)
    known = [*keys, *order, *carried]
    rows = df.select(*(F.col(c) for c in known), F.col(labels).cast("array<int>").alias("_at"), F.col(scores).cast("array<double>").alias("_of"), F.row_number().over(ordered(keys, order)).alias("_row"))
    rows = rows.sortWithinPartitions(*keys, *order)  # they are: the window's order

    def run(batches):
        rest = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            rest = new if rest is None else pa.concat_tables([rest, new])
            begin = np.flatnonzero(rest.column("_row").to_numpy() == 1)
            if len(begin) > 1:
                yield from solved(rest.slice(0, begin[-1]), begin)
                rest = rest.slice(begin[-1])
        if rest is not None and rest.num_rows:
            yield from solved(rest, np.append(np.flatnonzero(rest.column("_row").to_numpy() == 1), rest.num_rows))

    def solved(table, bounds):
        batch = table.combine_chunks().to_batches()[0]
        batch = batch.take(pa.array(np.arange(batch.num_rows)))  # offsets from 0
        states = _Rows(*(batch.column(batch.schema.get_field_index(c)) for c in ("_at", "_of")))
        start, length = bounds[:-1], np.diff(bounds)
        choice, total, share = np.zeros(batch.num_rows, dtype=np.int32), np.zeros(batch.num_rows), np.zeros(len(states.scores))
        by_length = np.argsort(-length, kind="stable")
        for i in range(0, len(by_length), _SIDE):
            some = by_length[i : i + _SIDE]
            if path:
                _paths_beside(shared.value, states, start[some], length[some], choice, total)
            if shares:
                _shares_beside(shared.value, states, start[some], length[some], share)
        cols = {c: batch.column(batch.schema.get_field_index(c)) for c in known}
        cols |= {"choice": pa.array(choice), "log_score": pa.array(total)} if path else {}
        cols |= {"marginals": pa.ListArray.from_arrays(pa.array(states.offset, pa.int32()), pa.array(share))} if shares else {}
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    found = (["choice int, log_score double"] if path else []) + (["marginals array<double>"] if shares else [])
    return rows.mapInArrow(run, StructType(rows.select(*known).schema.fields + StructType.fromDDL(", ".join(found)).fields))


def solved(df: DataFrame, keys: list[str], order: list[str], steps: Steps, labels: str, scores: str, carried: list[str] = (), path: bool = True, shares: bool = False, block: int = BLOCK) -> DataFrame:
    """keys, order, the ``carried`` columns, with ``path`` choice and log_score as in :func:`best_paths`, and with ``shares`` marginals as in :func:`marginals`.

    Order values of sequences of more than ``block`` rows are unique if columns are carried or both are asked for.
    """
    carried = list(carried)
    long = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > block).select(*keys)
    args = (keys, order, steps, labels, scores)
    if long.isEmpty():
        return _whole(df, *args, carried, path, shares)
    out = _whole(join_same(df, long, keys, "left_anti"), *args, carried, path, shares)
    far = join_same(df, long, keys, "left_semi")
    parts = ([_long_paths(far, *args, block)] if path else []) + ([_long_marginals(far, *args, block)] if shares else [])
    both = far.select(*keys, *order, *carried) if carried else parts.pop(0)
    for part in parts:
        both = join_same(both, part, [*keys, *order])
    return out.unionByName(both.select(out.columns))


def best_paths(df: DataFrame, keys: list[str], order: list[str], steps: Steps, labels: str, scores: str, block: int = BLOCK) -> DataFrame:
    """keys, order, choice (index into the row's states, from 0) and log_score, the score of the sequence's best path.

    ``labels`` are each row's states as indices into the transitions, ``scores`` their emissions; both arrays have the same
    length, which may differ from row to row. Of equal paths the lowest state wins at the last row, then at each row before it. Scores are
    rounded to 2**-30. Equal ``order`` values in a sequence are taken in any order; null keys are a key.
    """
    return solved(df, keys, order, steps, labels, scores, block=block)


def marginals(df: DataFrame, keys: list[str], order: list[str], steps: Steps, labels: str, scores: str, block: int = BLOCK) -> DataFrame:
    """keys, order and marginals: the probability of each of the row's states over all paths, by sums forwards and backwards.

    Arguments are those of :func:`best_paths`.
    """
    return solved(df, keys, order, steps, labels, scores, path=False, shares=True, block=block)


def _long_paths(df: DataFrame, keys: list[str], order: list[str], steps: Steps, labels: str, scores: str, block: int) -> DataFrame:
    """:func:`best_paths` by blocks."""
    shared = df.sparkSession.sparkContext.broadcast(steps)
    blocks = kept(run_blocks(df, keys, order, {"labels": labels, "scores": scores}, block))

    def enter(g: pd.DataFrame) -> pd.DataFrame:
        """What the row before each block scores by state, and its labels."""
        g = g.sort_values("at")
        s, out, score, last = shared.value, [], None, None
        for at, (first, end, crossing) in zip(g["at"], _unpacked(g, np.int64), strict=True):
            out.append((at, None if score is None else score.tobytes(), None if last is None else last.tobytes()))
            into = s.exact[1][first] if score is None else _best(score[None], s.exact[0][np.ix_(last, first)])[0]
            score, last = _best(np.maximum(into, _NEVER)[None], crossing)[0], end
        return pd.DataFrame(out, columns=["at", "before", "before_labels"])

    entered = kept(_products(blocks, keys, shared, True).groupBy(*keys).applyInPandas(enter, "at long, before binary, before_labels binary"))
    whole = blocks.join(entered, "at")

    def solved(batch, i):
        s = shared.value
        before, known = (batch.column(batch.schema.get_field_index(c))[i].as_py() for c in ("before", "before_labels"))
        args = (None, None) if before is None else (np.frombuffer(before, dtype=np.int64), np.frombuffer(known, dtype=np.int32))
        found, values = _block(batch, i, True)
        score, back = s.forward(*args, found, values)
        return found, score, back

    def maps(batches):
        """For each state at a block's end the state before the block, and the scores at its end."""
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                found, score, back = solved(batch, i)
                to = np.arange(len(score[-1]))
                for b in back[::-1]:
                    to = b[to]
                out.append((to.astype(np.int32).tobytes(), (score[-1] + shared.value.exact[2][found[-1]]).tobytes()))
            cols = [batch.column(batch.schema.get_field_index(c)) for c in [*keys, "at"]]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array([r[k] for r in out], pa.binary()) for k in (0, 1))], names=[*keys, "at", "origin", "ends"])

    fields = StructType(blocks.select(*keys, "at").schema.fields + StructType.fromDDL("origin binary, ends binary").fields)
    mapped = whole.mapInArrow(maps, fields)

    def leave(g: pd.DataFrame) -> pd.DataFrame:
        """The best path's state at the end of each block."""
        g = g.sort_values("at", ascending=False)
        out, state, total = [], None, None
        for at, origin, ends in zip(g["at"], g["origin"], g["ends"], strict=True):
            if state is None:
                ends = np.frombuffer(ends, dtype=np.int64)
                state, total = int(ends.argmax()), float(ends.max() / UNIT)
            out.append((at, state, total))
            state = int(np.frombuffer(origin, dtype=np.int32)[state])
        return pd.DataFrame(out, columns=["at", "end_state", "log_score"])

    left = kept(mapped.groupBy(*keys).applyInPandas(leave, "at long, end_state int, log_score double"))

    def trace(batches):
        for batch in batches:
            paths = []
            for i in range(batch.num_rows):
                _, _, back = solved(batch, i)
                state = batch.column(batch.schema.get_field_index("end_state"))[i].as_py()
                path = [state]
                for b in back[:0:-1]:
                    state = int(b[state])
                    path.append(state)
                paths.append(path[::-1])
            cols = [batch.column(batch.schema.get_field_index(c)) for c in [*keys, "rows", "log_score"]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(paths, pa.list_(pa.int32()))], names=[*keys, "rows", "log_score", "path"])

    fields = StructType(blocks.select(*keys, "rows").schema.fields + StructType.fromDDL("log_score double, path array<int>").fields)
    out = whole.join(left, "at").mapInArrow(trace, fields)
    out = out.select(*keys, "log_score", F.explode(F.arrays_zip("rows", "path")).alias("_x"))
    return out.select(*keys, *(F.col(f"_x.rows.{c}").alias(c) for c in order), F.col("_x.path").alias("choice"), "log_score")


def _long_marginals(df: DataFrame, keys: list[str], order: list[str], steps: Steps, labels: str, scores: str, block: int) -> DataFrame:
    """:func:`marginals` by blocks."""
    shared = df.sparkSession.sparkContext.broadcast(steps)
    blocks = kept(run_blocks(df, keys, order, {"labels": labels, "scores": scores}, block))

    def ends(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("at")
        s, parts = shared.value, _unpacked(g, np.float64)
        before, after = [s.log[1][parts[0][0]]], [s.log[2][parts[-1][1]]]
        for (_, end, crossing), (first, _, _) in zip(parts[:-1], parts[1:], strict=True):
            before.append(_sum(_sum(before[-1][None], crossing), s.log[0][np.ix_(end, first)])[0])
        for (_, end, _), (first, _, crossing) in zip(parts[-2::-1], parts[:0:-1], strict=True):
            after.append(_sum(s.log[0][np.ix_(end, first)], _sum(crossing, after[-1][:, None]))[:, 0])
        return pd.DataFrame({"at": g["at"], "before": [x.tobytes() for x in before], "after": [x.tobytes() for x in after[::-1]]})

    known = kept(_products(blocks, keys, shared, False).groupBy(*keys).applyInPandas(ends, "at long, before binary, after binary"))

    def solve(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                found, values = _block(batch, i, False)
                before, after = (np.frombuffer(batch.column(batch.schema.get_field_index(c))[i].as_py(), dtype=np.float64) for c in ("before", "after"))
                out.append([m.tolist() for m in shared.value.marginals(before, after, found, values)])
            cols = [batch.column(batch.schema.get_field_index(c)) for c in [*keys, "rows"]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(out, pa.list_(pa.list_(pa.float64())))], names=[*keys, "rows", "m"])

    fields = StructType(blocks.select(*keys, "rows").schema.fields + StructType.fromDDL("m array<array<double>>").fields)
    out = blocks.join(known, "at").mapInArrow(solve, fields).select(*keys, F.explode(F.arrays_zip("rows", "m")).alias("_x"))
    return out.select(*keys, *(F.col(f"_x.rows.{c}").alias(c) for c in order), F.col("_x.m").alias("marginals"))
