"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

# Bytes that end a word: everything in ASCII but digits and letters. Upper-case ASCII is lowered,
# bytes of 0x80 and above (any other script) always belong to words.
WORD_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table of this name under ``sf_dir``, read by Spark from whatever store holds it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text) -> bytes:
    """UTF-8 bytes of a text; null is empty, lone surrogates become '?'."""
    return b"" if not isinstance(text, str) else text.encode("utf-8", "replace")


def ascii_words(text) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text after lower-casing A-Z only."""
    return utf8(text).translate(WORD_TABLE).split()


def give_back() -> None:
    """Return freed memory to the system: Python workers stay for later stages, beside others of their executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc alone has it
        ctypes.CDLL(None).malloc_trim(0)


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows from now on, where the session left Spark's default of 10,000.

    A batch is held whole, in the JVM (in buffers that double as they grow) and again in Python, and texts are long.
    Results don't depend on it; a value that the session has set itself stays.
    """
    if spark.conf.get(_BATCH, None) in (None, "10000"):
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and stored in the shared checkpoint folder, with its lineage cut.

    The folder is the session's ``spark.checkpoint.dir``. Where the session names none, a session on one
    machine (as in tests) gets a temporary one, and a cluster an error: its machines share no temporary folder.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(checkpoint_folder(df.sparkSession.conf.get("spark.checkpoint.dir", None), sc.master))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read back: lineage is cut, columns can be pruned."""
    sc = df.sparkSession.sparkContext
    named = sc._jsc.sc().getCheckpointDir()
    folder = named.get() if named.isDefined() else checkpoint_folder(df.sparkSession.conf.get("spark.checkpoint.dir", None), sc.master)
    path = f"{folder}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.parquet(path)


def checkpoint_folder(named: str | None, master: str) -> str:
    """The folder that the session names, a temporary one for a master on one machine, else ValueError."""
    if named:
        return named
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    return tempfile.mkdtemp(prefix="ostinato-")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``: the fold that splits training rows from held-out ones."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, n_folds: int, held_out: int, limit: int
) -> DataFrame:
    """At most ``limit`` labelled documents outside the held-out fold: (doc_id, text, y).

    Labels other than 0 and 1 (null included) are no labels; where an id has several, the largest
    counts. Ids are drawn by their hash, so the sample doesn't depend on the order of rows. The
    drawn ids are at most ``limit`` rows and are broadcast; documents are scanned once. Of rows that repeat an id at most four
    count, the first by their texts' hashes, so the sample has at most four times ``limit`` rows; only it is shuffled.
    """
    short_batches(documents.sparkSession)
    drawn = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
        .filter(fold(F.col("doc_id"), n_folds) != held_out)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    return few_of_each(documents.select("doc_id", "text").join(F.broadcast(drawn), "doc_id"), ["doc_id"])


def few_of_each(rows: DataFrame, keys: list[str], most: int = 4) -> DataFrame:
    """At most ``most`` rows of each of ``keys``, the first by the hash of ``text``; others are left out before the shuffle already."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("text"), "text"))
    return rows.withColumn("_place", place).filter(F.col("_place") <= most).drop("_place")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Alternating large-star and small-star rounds: every round is two aggregations and joins over
    edges, with a logarithmic number of rounds, and nothing is gathered by component. Each round is
    checkpointed. Null ends and loops are ignored; no edges give no rows.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    pairs = cut(pairs.filter("u is not null and v is not null and u <> v").distinct())
    last = None
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u")
        small = met.select("u", F.col("m").alias("v")).union(
            met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        pairs = cut(small.distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    member = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return member.union(member.select(F.col("component").alias("node"), "component").distinct())


def pieces_of(batch: pa.RecordBatch, columns: list[int], limit: int = 2 << 20):
    """Slices of a batch whose text ``columns`` hold about ``limit`` bytes together, one row at least."""
    size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    group = (np.cumsum(size) - size) // limit
    edge = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def map_texts(documents: DataFrame, make, fields: str, keep: list[str] | None = None, many: bool = False) -> DataFrame:
    """``documents`` as the columns ``keep`` (doc_id by default, as long) and new ``fields`` made from the texts.

    ``make()`` runs once a task and returns a function from a list of texts to a list of columns; with
    ``many`` to the index of each result's text and the results' columns. One map over the scan, in Arrow batches
    of which about 2 MB are worked on at once; the kept columns pass through unchanged, so nulls and large
    integers stay what they are, and columns that are not kept don't reach Python.
    """
    short_batches(documents.sparkSession)
    kept = [F.col("doc_id").cast("long").alias("doc_id")] if keep is None else [F.col(c) for c in keep]
    chosen = documents.select(*kept, F.col("text").cast("string").alias("_text"))
    added = StructType.fromDDL(fields)
    types = list(to_arrow_schema(added).types)

    def run(batches):
        give_back()  # what earlier tasks of this worker left
        work = make()
        for batch in batches:
            last = batch.num_columns - 1
            part = new = columns = old = None
            for part in pieces_of(batch, [last]):
                new = work(part.column(last).to_pylist())
                old = part.columns[:-1]
                if many:
                    at, new = new
                    old = [c.take(pa.array(at, pa.int64())) for c in old]
                columns = [pa.array(x, t, from_pandas=True) for x, t in zip(new, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*old, *columns], names=[*part.schema.names[:-1], *added.names])
            del batch, part, new, columns, old
            give_back()

    return chosen.mapInArrow(run, StructType([f for f in chosen.schema if f.name != "_text"] + added.fields))


def with_fields(df: DataFrame, fields: str) -> StructType:
    """The schema of ``df`` with further fields."""
    return StructType(df.schema.fields + StructType.fromDDL(fields).fields)


def text_hash(text: Column | str = "text") -> Column:
    """A digest that with the id tells a row: rows that agree on both are repeated."""
    return F.xxhash64(text)


def without_rows(documents: DataFrame, rows: DataFrame, broadcast_upto: int = 500_000) -> DataFrame:
    """The rows of ``documents`` whose doc_id and text aren't those of one of ``rows`` (doc_id, text_hash).

    Null ids equal null ids, so a row is told by its text where its id is null or repeated. Up to ``broadcast_upto``
    distinct rows (8 MB) are broadcast; a longer list is joined by a shuffle.
    """
    gone = cut(rows.select(F.col("doc_id").cast("long").alias("_id"), F.col("text_hash").alias("_hash")).distinct())
    gone = F.broadcast(gone) if gone.count() <= broadcast_upto else gone
    same = documents["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (text_hash(documents["text"]) == F.col("_hash"))
    return documents.join(gone, same, "left_anti").select(documents.columns)


def key_runs(batches, keys: list[str]):
    """Frames of the rows with equal keys, from batches of a partition that is sorted by them.

    Only the last run of a batch is carried over, so memory is that of a batch and one run.
    """
    held = None
    for pdf in batches:
        if held is not None:
            pdf = pd.concat([held, pdf], ignore_index=True)
        if not len(pdf):
            continue
        k = pdf[keys].to_numpy()
        edge = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        start = 0
        for end in edge.tolist():
            yield pdf.iloc[start:end]
            start = end
        held = pdf.iloc[start:]
    if held is not None and len(held):
        yield held


def in_blocks(members: DataFrame, keys: list[str], node: list[str], block: int, rest: str, main: str | None = None, is_main: str | None = None) -> DataFrame:
    """``members`` of groups cut into blocks, repeated once for each pair of blocks they take part in.

    ``rest`` and ``main`` name columns with the sizes of a group's two parts; members of ``main`` (for which ``is_main``
    holds) needn't meet each other. A group of up to ``block`` in all is one block, paired with itself (bi = bj = 0).
    In a larger one the rest has r blocks by the hash of ``node`` and main m; every pair of blocks meets that
    has one of the rest at least, so no task needs a whole group, and the many of main are repeated r times only.
    """
    big, total = (F.col(main) if main else F.lit(0)), (F.col(rest) + (F.col(main) if main else F.lit(0)))
    count = lambda size: F.ceil(size / F.lit(block)).cast("int")
    r = F.when(total <= block, 1).otherwise(F.greatest(F.lit(1), count(F.col(rest))))
    m = F.when(total <= block, 0).otherwise(count(big))
    out = members.withColumns({"_r": r, "_m": m, "_h": F.xxhash64(*node), "_main": (F.col(is_main) if is_main else F.lit(False))})
    out = out.withColumn("_main", F.col("_main") & (F.col("_m") > 0))
    out = out.withColumn("own", F.when(F.col("_main"), F.col("_r") + F.pmod("_h", F.greatest(F.col("_m"), F.lit(1)))).otherwise(F.pmod("_h", F.col("_r"))).cast("int"))
    out = out.withColumn("_o", F.explode(F.sequence(F.lit(0), F.when(F.col("_main"), F.col("_r")).otherwise(F.col("_r") + F.col("_m")) - 1)))
    out = out.withColumns({"bi": F.least("own", "_o"), "bj": F.greatest("own", "_o")}).drop("_r", "_m", "_h", "_main", "_o")
    return out.repartition(*keys, "bi", "bj").sortWithinPartitions(*keys, "bi", "bj")
