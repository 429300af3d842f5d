"""Embedding whitening: exact integer sums, centred outer products by GEMM, a merged covariance and its eigenvectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.llm.common import short_batches, with_fields

SCALE, SHIFT = 1024, 100_000
LARGEST = 2.0**52  # entries beyond it after scaling have no exact integer part in double precision


class Whitening:
    """n, integer sums, the covariance's components (columns) and their eigenvalues, its trace and the measured error."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray, trace: float, identity_error: float | None = None):
        self.n, self.sums, self.values, self.vectors, self.trace, self.identity_error = n, sums, values, vectors, trace, identity_error

    def project(self, x: np.ndarray) -> np.ndarray:
        """Rows of integers, centred exactly, on the components in units of their deviations."""
        return centred(x, self.n, self.sums) @ self.vectors / np.sqrt(self.values)


def usable(embeddings: DataFrame, column: str = "embedding", length: int | None = None) -> DataFrame:
    """The rows whose vector can be used, with their other columns: not null nor empty, all entries finite, of one length.

    That is the commonest ``length`` where none is given (the longer of equals): other vectors can't stand beside these and
    go too, as do those with an entry whose integer would need more than 52 bits.
    """
    ok = F.expr(f"`{column}` is not null and size(`{column}`) > 0 and forall(`{column}`, c -> c is not null and abs(double(c)) <= {LARGEST / SCALE})")
    rows = embeddings.filter(ok)  # NaN is greater than every number
    if length is None:
        sizes = rows.groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
        length = sizes[0]["d"] if sizes else 0
    return rows.filter(F.size(column) == length)


def integers(column: pa.ListArray) -> np.ndarray:
    """The vectors of a batch as integers floor(1024 c) + 100000, a row each."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(flat * SCALE).astype(np.int64) + SHIFT).reshape(len(column), -1)


def _scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - sums, exact: in 64-bit integers where these suffice, else in Python's."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < 2**63:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n as doubles, one rounding an entry."""
    return (_scaled(x, n, sums) / n).astype(np.float64)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """The sum over dimensions of (n x - sums) ** 2, exact, of each row."""
    d = _scaled(x, n, sums)
    if int(np.abs(d).max(initial=0)) ** 2 * len(sums) >= 2**63:
        d = d.astype(object)
    return (d * d).sum(axis=1).tolist()


def _reduced(rows: DataFrame, column: str, zero, batch_value, merge):
    """``batch_value`` of every batch's integers, merged inside tasks, then in a tree: one small value a partition travels."""
    short_batches(rows.sparkSession)

    def run(batches):
        import pickle

        total = zero
        for batch in batches:
            if batch.num_rows:
                total = merge(total, batch_value(integers(batch.column(0))))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], names=["part"])

    def unpacked(row):
        import pickle

        return pickle.loads(row[0])

    parts = rows.select(F.col(column)).mapInArrow(run, "part binary").rdd.map(unpacked)
    return parts.treeAggregate(zero, merge, merge)


def _add(a, b):
    """Sums of two parts; None is the sum of nothing."""
    return b if a is None else a if b is None else tuple(x + y for x, y in zip(a, b, strict=True))


def _join_moments(a, b):
    """Number, mean and centred outer products of two parts together."""
    if a is None or b is None:
        return b if a is None else a
    n = a[0] + b[0]
    d = b[1] - a[1]
    return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * b[0] / n)


def fit(embeddings: DataFrame, components: int = 8, column: str = "embedding") -> Whitening:
    """The whitening of all usable vectors: unit eigenvectors of their covariance (divisor n), by falling eigenvalue.

    First pass: n and sums of integers, exact. Second: outer products of centred vectors, by GEMM in every batch, merged by
    treeAggregate; the symmetric eigenproblem is LAPACK's, over one matrix of d by d on the driver (d is the vectors' length,
    whatever their number). Third: the whitened vectors' own covariance, as number, mean and centred products that
    merge, whose largest distance from the identity is ``identity_error``. Eigenvalues of at most d times the rounding unit of the
    largest count as zero and give no component; so no vectors, one, or equal ones give none.
    """
    rows = usable(embeddings, column)
    first = _reduced(rows, column, None, lambda x: (len(x), x.sum(axis=0).astype(object)), _add)
    if first is None:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    n, sums = first[0], [int(s) for s in first[1]]

    def products(x):
        c = centred(x, n, sums)
        return (c.T @ c,)

    (outer,) = _reduced(rows, column, None, products, _add)
    cov = outer / n
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = int((values > max(values[0], 0.0) * len(values) * np.finfo(float).eps).sum())
    k = min(components, rank)
    out = Whitening(n, sums, values[:k].copy(), np.ascontiguousarray(vectors[:, :k]), float(np.trace(cov)))
    if k:

        def moments(x):
            w = out.project(x)
            mean = w.mean(axis=0)
            return len(w), mean, (w - mean).T @ (w - mean)

        total = _reduced(rows, column, None, moments, _join_moments)
        out.identity_error = float(np.abs(total[2] / total[0] - np.eye(k)).max())
    return out


def transform(embeddings: DataFrame, model: Whitening, keep: list[str] | None = None, column: str = "embedding") -> DataFrame:
    """The usable rows as (vec_id or ``keep``, deviation decimal(38,0), whitened array<double>), by one map.

    Vectors must have the length of those fitted. Rows with null or repeated ids stay as they are; columns that aren't kept are dropped. A deviation of more than 38
    digits is null.
    """
    from decimal import Decimal

    rows = usable(embeddings, column, len(model.sums)).select(*(keep or ["vec_id"]), F.col(column).alias("_vector"))
    schema = with_fields(rows.drop("_vector"), "deviation decimal(38,0), whitened array<double>")
    short_batches(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            x = integers(batch.column(batch.num_columns - 1)) if batch.num_rows else np.zeros((0, len(m.sums)), dtype=np.int64)
            w = m.project(x)
            far = [Decimal(v) if abs(v) < 10**38 else None for v in deviations(x, m.n, m.sums)]
            offset = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(far, pa.decimal128(38, 0)), pa.ListArray.from_arrays(offset, pa.array(w.ravel()))], names=schema.names)

    return rows.mapInArrow(run, schema)
