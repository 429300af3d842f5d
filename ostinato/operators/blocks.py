"""Sequences cut into contiguous blocks of bounded size, and intermediate tables kept in the shared checkpoint folder."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the session's ``spark.checkpoint.dir``; its lineage ends there.

    Without that setting a session on one machine takes a temporary folder; a cluster, whose machines share none, gets ValueError.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ostinato-"))
    return df.checkpoint(eager=True)


def run_blocks(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str], size: int) -> DataFrame:
    """One row a block of at most ``size`` neighbouring rows of a sequence: keys, at, rows (structs of order) and an array for each of ``values``.

    Rows are partitioned by ranges of (keys, order) and sorted, so a long sequence is dealt out among tasks and its blocks' ``at``,
    unique in the table, rises with ``order``. Blocks of one sequence may be shorter than ``size`` where a partition ends.
    """
    place = F.struct(*order).alias("_row")
    rows = df.select(*keys, *order, *(F.col(v).alias(f"_v{i}") for i, v in enumerate(values.values())))
    rows = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_id", F.monotonically_increasing_id())
    rows = rows.select(*keys, "_id", place, *(f"_v{i}" for i in range(len(values))))
    found = rows.groupBy(*keys, F.expr(f"_id div {size}").alias("_block")).agg(F.sort_array(F.collect_list(F.struct("_id", "_row", *(f"_v{i}" for i in range(len(values)))))).alias("_x"))
    return found.select(*keys, F.col("_x")[0]["_id"].alias("at"), F.col("_x._row").alias("rows"), *(F.col(f"_x._v{i}").alias(v) for i, v in enumerate(values)))


TASK_ROWS = 32_768  # rows of a task where sequences are dealt out by number


def tasks_for(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """Among how many tasks ``df`` is to be dealt so that each gets about ``rows`` rows, however many there are."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))


def whole_sequences(batches, row: str = "_row"):
    """Whole sequences out of a task's batches of sorted rows, whose ``row`` counts each sequence's rows from 1: tables, and where in them sequences begin and the last ends."""
    held = []

    def table():
        t = pa.Table.from_batches(held).combine_chunks()
        return t, np.append(np.flatnonzero(t.column(row).to_numpy() == 1), t.num_rows)

    for batch in batches:
        begin = np.flatnonzero(batch.column(batch.schema.get_field_index(row)).to_numpy() == 1)
        cut = int(begin[-1]) if len(begin) else 0
        if len(begin) and (held or cut):
            held.append(batch.slice(0, cut))
            yield table()
            held = []
        held.append(batch.slice(cut))
    if sum(b.num_rows for b in held):
        yield table()


def join_same(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right`` where both agree on ``on``; nulls agree with nulls."""
    right = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_right_{c}"))
    return left.join(right, same, how).drop(*(f"_right_{c}" for c in on))
