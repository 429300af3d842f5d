"""Sections of sequences: novelty, peaks, boundaries by repetition, and labels.

Self-similarity isn't stored: novelty needs a band of it, boundaries some of its diagonals, labels its product with itself.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ostinato.functions import vectors as V
from ostinato.operators.folds import fold_sorted
from ostinato.operators.sequences import ordered
from ostinato.operators.structure import self_similarity

FORMS = (8, 16, 32, 64)  # bars of usual sections


def novelty(df: DataFrame, keys: list[str], index: str, vector: str, half: int = 8) -> DataFrame:
    """(keys, i, novelty): how much the ``half`` rows before a row differ from those after it, scaled to 0..1.

    A checkerboard of similarities with a Gaussian taper, smoothed over 17 rows (deviation 2). Every pair of rows less than
    2 * ``half`` apart counts for the rows between; the first and last ``half`` rows are 0 before smoothing. ``index`` counts
    from 0 without gaps. ``half`` must be 8 at least, so that smoothing meets zeros at both ends.
    """
    if half < 8:
        raise ValueError("half must be at least 8")
    taper = lambda a, b: F.exp(-(a * a + b * b) / F.lit(2 * (half / 2) ** 2))
    n = df.groupBy(*keys).agg((F.max(index) + 1).alias("_n"))
    pairs = self_similarity(df, keys, index, vector, 2 * half - 1).join(n, keys)
    low, high = F.greatest(F.col("j") - half + 1, F.lit(half)), F.least(F.col("i") + half, F.col("_n") - half - 1)
    pairs = pairs.filter(low <= high).withColumn("t", F.explode(F.sequence(low, high)))
    a, b = F.col("i") - F.col("t"), F.col("j") - F.col("t")
    sign = F.when((a < 0) == (b < 0), 2.0).otherwise(-2.0)
    sums = pairs.groupBy(*keys, F.col("t").alias("i")).agg(F.sum(sign * taper(a, b) * F.col("similarity")).alias("_s"))
    rows = df.select(*keys, F.col(index).alias("i"), (V.norm(F.col(vector)) > 0).cast("double").alias("_d")).join(n, keys)
    w = ordered(keys, ["i"])
    own = sum((F.coalesce(F.lag("_d", -d).over(w), F.lit(0.0)) * math.exp(-(d * d) / (half / 2) ** 2) for d in range(-half, half)), F.lit(0.0))
    diagonal = rows.withColumn("_o", F.when((F.col("i") >= half) & (F.col("i") < F.col("_n") - half), own).otherwise(0.0))
    raw = diagonal.join(sums, [*keys, "i"], "left").withColumn("_r", F.when((F.col("i") >= half) & (F.col("i") < F.col("_n") - half), F.coalesce("_s", F.lit(0.0)) + F.col("_o")).otherwise(0.0))
    kernel = [math.exp(-(x * x) / 8) for x in range(-8, 9)]
    smooth = sum((F.coalesce(F.lag("_r", -x).over(w), F.lit(0.0)) * (k / sum(kernel)) for x, k in zip(range(-8, 9), kernel, strict=True)), F.lit(0.0))
    raw = raw.withColumn("_x", smooth)
    ends = raw.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col("_x") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.col("_x"))
    return raw.join(ends, keys).select(*keys, "i", scaled.alias("novelty"))


def find_peaks(x: np.ndarray, distance: int, prominence: float) -> list[int]:
    """Indices of local maxima (of a flat top its middle): of those nearer than ``distance`` the higher stays, the later among
    equals; each must rise by ``prominence`` over the higher of the two lowest points that part it from higher ground."""
    tops, i = [], 1
    while i < len(x) - 1:
        if x[i - 1] < x[i]:
            j = i
            while j + 1 < len(x) and x[j + 1] == x[i]:
                j += 1
            if j + 1 < len(x) and x[j + 1] < x[i]:
                tops.append((i + j) // 2)
            i = j
        i += 1
    kept = np.ones(len(tops), dtype=bool)
    for k in sorted(range(len(tops)), key=lambda k: (x[tops[k]], k), reverse=True):
        if kept[k]:
            for step in (-1, 1):
                m = k + step
                while 0 <= m < len(tops) and abs(tops[m] - tops[k]) < distance:
                    kept[m] = False
                    m += step
    out = []
    for p in np.array(tops, dtype=int)[kept].tolist():
        left = np.flatnonzero(x[:p] > x[p])
        right = np.flatnonzero(x[p + 1 :] > x[p])
        lo = x[(left[-1] + 1 if len(left) else 0) : p + 1].min()
        hi = x[p : (p + 1 + right[0] if len(right) else len(x))].min()
        if x[p] - max(lo, hi) >= prominence:
            out.append(p)
    return out


def peaks(curve: DataFrame, keys: list[str], index: str, value: str, distance: int = 8, prominence: float = 0.2) -> DataFrame:
    """(keys, boundary): 0, the curve's peaks and its length. A sequence's curve, two numbers a row, goes to one task."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(index)
        at = sorted({0, *find_peaks(g[value].to_numpy(dtype=float), distance, prominence), len(g)})
        out = pd.DataFrame({"boundary": at})
        for c in keys:
            out[c] = g[c].iloc[0]
        return out[[*keys, "boundary"]]

    known = StructType([f for f in curve.schema if f.name in keys])
    return curve.select(*keys, index, value).groupBy(*keys).applyInPandas(run, known.add("boundary", "long"))


def base_period(df: DataFrame, keys: list[str], index: str, vector: str, beats_per_bar: int = 4, forms: tuple[int, ...] = FORMS, least: float = 0.25) -> DataFrame:
    """(keys, bars, score): the shortest of ``forms`` (bars) at whose lag a sequence resembles itself by ``least`` on average,
    else the most similar; forms as long as the sequence don't count, and sequences without any are absent."""
    w = ordered(keys, [index])
    v = df.select(*keys, index, V.unit(F.col(vector)).alias("_v"))
    like = lambda n: F.when(F.lag("_v", n).over(w).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), V.dot(F.col("_v"), F.lag("_v", n).over(w)))))
    v = v.withColumns({f"_s{b}": like(b * beats_per_bar) for b in forms})
    means = v.groupBy(*keys).agg(F.array(*[F.struct(F.lit(b).alias("bars"), F.avg(f"_s{b}").alias("score")) for b in sorted(forms)]).alias("_all"))
    known = F.filter("_all", lambda x: x["score"].isNotNull())
    above = F.filter("_known", lambda x: x["score"] >= least)
    top = F.array_max(F.transform("_known", lambda x: F.struct(x["score"].alias("score"), (-x["bars"]).alias("bars"))))
    pick = F.when(F.size(above) > 0, F.get(above, F.lit(0))).otherwise(F.struct((-top["bars"]).alias("bars"), top["score"].alias("score")))
    return means.withColumn("_known", known).filter(F.size("_known") > 0).select(*keys, pick.alias("_p")).select(*keys, "_p.bars", "_p.score")


def sections(df: DataFrame, keys: list[str], index: str, vector: str, beats_per_bar: int = 4, forms: tuple[int, ...] = FORMS, like: float = 0.6, least: float = 0.25, shortest: int = 4) -> DataFrame:
    """(keys, section, start, end): a grid of the base period, with neighbouring blocks merged while they repeat the section
    so far row by row (mean similarity of ``like``), and sections under ``shortest`` bars given to the next (the last to the one before).

    One pass over each sorted sequence; no more than two blocks of vectors are held. Sequences shorter than the
    shortest form are absent, as they have no sections.
    """
    period = base_period(df, keys, index, vector, beats_per_bar, forms, least).select(*keys, (F.col("bars") * beats_per_bar).alias("_step"))
    rows = df.join(period, keys).select(*keys, index, "_step", V.unit(F.col(vector)).alias("_v"))
    fields = [StructField("section", IntegerType()), StructField("start", LongType()), StructField("end", LongType())]

    def make():
        found: list[list[int]] = []
        head: list = []
        block: list = []

        def close():
            nonlocal block
            start = found[-1][1] if found else 0
            if found and np.mean([max(0.0, min(1.0, float(a @ b))) for a, b in zip(head, block, strict=False)]) >= like:
                found[-1][1] += len(block)
            else:
                found.append([start, start + len(block)])
                head[:] = block
            block = []

        def step(row):
            block.append(np.asarray(row[-1], dtype=float))
            if len(block) == row[-2]:
                close()
            return ()

        def end():
            if block:
                close()
            i = 0
            while len(found) > 1 and i < len(found):
                if found[i][1] - found[i][0] >= shortest * beats_per_bar:
                    i += 1
                elif i == len(found) - 1:
                    found[i - 1][1] = found.pop(i)[1]
                else:
                    found[i + 1][0] = found.pop(i)[0]
            return [(k, a, b) for k, (a, b) in enumerate(found)]

        return step, end

    return fold_sorted(rows, keys, [index], make, fields)


def section_labels(df: DataFrame, spans: DataFrame, keys: list[str], index: str, vector: str, like: float = 0.7) -> DataFrame:
    """(keys, section, label): letters of sections (section, start, end), by how alike their rows' similarities to the whole
    sequence are; a section takes the first letter whose first section it resembles by more than ``like``.

    Vectors have no negative elements. A section's mean similarity to every row is its mean vector times all vectors, so
    two sections compare through their mean vectors and the sum of all rows' outer products, which has the
    vectors' width squared and is summed as a sequence's rows come by, so that one such sum a sequence is shuffled; a sequence's sections, not
    its rows, are gathered.
    """
    unit = df.select(*keys, F.col(index).alias("_i"), V.unit(F.col(vector)).alias("_v"))
    known = {f.name: f for f in df.schema}
    partial = StructType([known[k] for k in keys] + [StructField("_g", ArrayType(DoubleType()))])

    def products(batches):
        held = None  # keys of the sequence that the last batch ended in, and its sum so far
        for batch in batches:
            begin = np.flatnonzero(batch.column(batch.num_columns - 1).to_numpy() == 1)
            vectors = np.stack(batch.column(len(keys)).to_numpy(zero_copy_only=False)).astype(float)
            at = begin if len(begin) and begin[0] == 0 else np.append(0, begin)
            sums = [v.T @ v for v in np.split(vectors, at[1:])]
            names = [tuple(batch.column(c)[int(i)].as_py() for c in range(len(keys))) for i in at]
            if held is not None and at is not begin:
                sums[0] += held[1]
            elif held is not None:
                names, sums = [held[0], *names], [held[1], *sums]
            held = names[-1], sums[-1]
            yield rows_of(names[:-1], sums[:-1])
        if held is not None:
            yield rows_of([held[0]], [held[1]])

    def rows_of(names, sums):
        kinds = to_arrow_schema(partial)
        cols = [pa.array([n[c] for n in names], kinds.field(c).type) for c in range(len(keys))]
        return pa.RecordBatch.from_arrays([*cols, pa.array([x.ravel() for x in sums], pa.list_(pa.float64()))], names=partial.names)

    placed = unit.filter("_v is not null").select(*keys, "_v", F.row_number().over(ordered(keys, ["_i"])).alias("_row")).sortWithinPartitions(*keys, "_row")
    gram = placed.mapInArrow(products, partial)
    inside = _inside(unit, spans, keys)
    means = inside.select(*keys, "section", F.posexplode("_v").alias("_p", "_x")).groupBy(*keys, "section", "_p").agg(F.avg("_x").alias("_x"))
    means = means.groupBy(*keys, "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_x"))), lambda x: x["_x"]).alias("_m"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("section")
        m = np.stack(g["_m"].to_list())
        s = m @ np.asarray(g["_g"].iloc[0]).reshape(m.shape[1], -1) @ m.T
        n = np.sqrt(np.maximum(np.diag(s), 0))
        s = s / np.maximum(np.outer(n, n), 1e-18)
        first: list[int] = []
        names = []
        for i in range(len(m)):
            k = next((k for k, r in enumerate(first) if s[i, r] > like), len(first))
            if k == len(first):
                first.append(i)
            names.append(chr(65 + k % 26))
        return g[[*keys, "section"]].assign(label=names)

    schema = StructType([known[k] for k in keys] + [StructField("section", IntegerType()), StructField("label", StringType())])
    return means.join(gram, keys).withColumn("section", F.col("section").cast("int")).groupBy(*keys).applyInPandas(run, schema)


def _inside(rows: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the section that holds them, looked up as of the last start."""
    from ostinato.operators.joins import first_containing

    s = spans.select(*keys, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "section")
    return first_containing(rows.withColumn("_i", F.col("_i").cast("long")), s, keys, "_i", ["section"]).filter("section is not null")


def shifted(boundaries: DataFrame, keys: list[str], at: str, by: str, length: str) -> DataFrame:
    """Boundaries moved by ``by`` rows, with one at ``by`` itself; those outside 1..``length`` - 1 go, and where ``by`` is 0 all stay."""
    moved = F.when(F.col(by) > 0, F.array(F.col(at) + F.col(by), F.col(by))).otherwise(F.array(F.col(at)))
    out = boundaries.select(*keys, length, by, F.explode(moved).alias(at))
    return out.filter((F.col(by) <= 0) | ((F.col(at) > 0) & (F.col(at) < F.col(length)))).select(*keys, at).distinct()
