"""Sequential folds over sorted sequences: one row at a time, with a state of bounded size.

Rows are dealt by key and sorted; a task walks them in Arrow batches and carries the state over, so that it
never holds a whole sequence. One long sequence still takes one task's time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from ostinato.operators.sequences import ordered


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], make, fields: list[StructField]) -> DataFrame:
    """``make()`` begins a sequence and returns (step, end): step(row) yields result tuples for a row, end() the last ones.

    Results are the keys and ``fields``. Rows of equal keys form a sequence; null keys are equal."""
    known = {f.name: f for f in df.schema}
    schema = StructType([known[k] for k in keys] + fields)

    def run(batches):
        now, step, end = None, None, None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                key = tuple(None if pd.isna(v) else v for v in row[: len(keys)])
                if step is None or key != now:
                    if step is not None:
                        out += [(*now, *x) for x in end()]
                    now, (step, end) = key, make()
                out += [(*now, *x) for x in step(row)]
            yield pd.DataFrame(out, columns=schema.names)
        if step is not None:
            yield pd.DataFrame([(*now, *x) for x in end()], columns=schema.names)

    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def merge_cells(cells: DataFrame, keys: list[str], same, values: list[str]) -> DataFrame:
    """Neighbouring cells (start, end and arrays ``values`` of sums over the cell) merged while ``same`` holds.

    ``same(so_far, cell)`` gets two dicts of sums, the first of the merged cell as it has grown, and of their lengths
    (``n``). Returns keys, start and end.
    """
    fields = [StructField("start", LongType()), StructField("end", LongType())]

    def make():
        held: dict = {}

        def step(row):
            new = {v: np.asarray(getattr(row, v), dtype=float) for v in values} | {"n": row.end - row.start}
            if held and same(held["sums"], new):
                held["sums"] = {k: held["sums"][k] + new[k] for k in new}
                held["end"] = row.end
            else:
                if held:
                    yield held["start"], held["end"]
                held.update(start=row.start, end=row.end, sums=new)

        def end():
            return [(held["start"], held["end"])] if held else []

        return step, end

    chosen = cells.select(*keys, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), *values)
    return fold_sorted(chosen, keys, ["start"], make, fields)


def same_argmax(*values: str):
    """Cells agree if the largest element of each summed array stands at the same index (the first of equals)."""
    return lambda a, b: all(int(a[v].argmax()) == int(b[v].argmax()) for v in values)


def centroids_within(value: str, most: float = 0.15):
    """Cells agree if the tonal centroids of their mean 12-class vectors are at most ``most`` apart."""
    k = np.arange(12)
    rows = [r * f(w * k) for r, w in ((1.0, 7 * np.pi / 6), (1.0, 3 * np.pi / 2), (0.5, 2 * np.pi / 3)) for f in (np.sin, np.cos)]
    m = np.stack(rows)

    def centroid(x):
        return m @ x / x.sum() if x.sum() > 0 else np.zeros(6)

    return lambda a, b: float(np.linalg.norm(centroid(a[value]) - centroid(b[value]))) <= most


def without_spurious_start(df: DataFrame, keys: list[str], period: str, sure: float = 0.5) -> DataFrame:
    """Chords (start, end, confidence) without those at the very start that are short (under 1.2 periods from it), unsure and
    followed within four periods; the first that stays takes over the start. One at least stays."""
    w = ordered(keys, ["start"])
    first = F.min("start").over(w.rowsBetween(Window.unboundedPreceding, 0))
    weak = (first <= 1e-3) & (F.col("end") - first < 1.2 * F.col(period)) & (F.col("confidence") < sure) & (F.lead("start").over(w) <= 4 * F.col(period))
    d = df.withColumns({"_first": first, "_weak": F.coalesce(weak, F.lit(False))})
    d = d.withColumn("_strong", F.max((~F.col("_weak")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("_strong = 1")
    return d.withColumn("start", F.when(F.row_number().over(w) == 1, F.col("_first")).otherwise(F.col("start"))).drop("_first", "_weak", "_strong")


def one_to_one_scores(found: DataFrame, true: DataFrame, keys: list[str], at: str, tolerance: float) -> DataFrame:
    """Precision, recall and F of boundaries where each true one counts once: found ones, in order, take the first free
    true one within ``tolerance``. From one sorted pass over both; only the free ones within reach are held."""
    both = found.select(*keys, F.col(at).cast("double").alias("at"), F.lit(1).alias("side")).union(true.select(*keys, F.col(at).cast("double").alias("at"), F.lit(0).alias("side")))
    # A found boundary is seen when every true one that it may take has been: 2 tolerances after the time it begins to reach.
    both = both.withColumn("seen", F.when(F.col("side") == 1, F.col("at") + tolerance).otherwise(F.col("at")))
    names = ["n_found", "n_true", "hits"]

    def make():
        free: list[float] = []
        n = [0, 0, 0]

        def step(row):
            if row.side == 0:
                n[1] += 1
                free.append(row.at)
                return ()
            n[0] += 1
            while free and free[0] < row.at - tolerance:
                free.pop(0)
            if free and free[0] <= row.at + tolerance:
                free.pop(0)
                n[2] += 1
            return ()

        return step, lambda: [tuple(n)]

    out = fold_sorted(both, keys, ["seen", "side", "at"], make, [StructField(c, LongType()) for c in names])
    share = lambda n: F.when(F.col(n) > 0, F.col("hits") / F.col(n)).otherwise(0.0)
    out = out.withColumns({"precision": share("n_found"), "recall": share("n_true")})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0))


