"""Recurring runs of symbols that begin and end with a bar."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ostinato.operators.blocks import whole_sequences
from ostinato.operators.sequences import ordered

SHORTEST, LONGEST = 2, 4  # symbols of a run


def _locked(df: DataFrame, keys: list[str], order: list[str], bar: str, symbol: str, shortest: int, longest: int) -> DataFrame:
    """``df`` with _i, the rows before each in its sequence, _first, whether a bar begins there, and for each length _m<length>, the symbols of so many rows, null if no bar ends with them."""
    w = ordered(keys, order)
    d = df.withColumns(
        {
            "_i": (F.row_number().over(w) - 1).cast("long"),
            "_first": F.coalesce(F.lag(bar).over(w) != F.col(bar), F.lit(True)),
            "_last": F.coalesce(F.lead(bar).over(w) != F.col(bar), F.lit(True)),
        }
    )
    ahead = {f"_s{k}": F.lead(symbol, k).over(w) if k else F.col(symbol) for k in range(longest)}
    ends = {f"_e{k}": F.lead("_last", k).over(w) if k else F.col("_last") for k in range(longest)}
    d = d.withColumns(ahead | ends)
    return d.withColumns({f"_m{n}": F.when(F.col(f"_e{n - 1}"), F.concat_ws(" ", *[F.col(f"_s{k}") for k in range(n)])) for n in range(shortest, longest + 1)})


def bar_locked_runs(df: DataFrame, keys: list[str], order: list[str], bar: str, symbol: str, shortest: int = SHORTEST, longest: int = LONGEST) -> DataFrame:
    """Every run of ``shortest``..``longest`` symbols from a bar's first row to a bar's last: keys, length,
    motif (symbols joined by spaces) and start, the rows before it in its sequence. One shuffle by keys."""
    d = _locked(df, keys, order, bar, symbol, shortest, longest).filter("_first")
    run = lambda n: F.when(F.col(f"_m{n}").isNotNull(), F.struct(F.lit(n).alias("length"), F.col(f"_m{n}").alias("motif")))
    runs = F.filter(F.array(*[run(n) for n in range(shortest, longest + 1)]), lambda x: x.isNotNull())
    return d.select(*keys, F.col("_i").alias("start"), F.explode(runs).alias("x")).select(*keys, "x.length", "x.motif", "start")


def motifs(df: DataFrame, keys: list[str], order: list[str], bar: str, symbol: str, least: int = 2) -> DataFrame:
    """Runs that occur at least ``least`` times in their sequence: keys, length, motif, n, first start and
    saving, the symbols that writing the run once would spare."""
    runs = bar_locked_runs(df, keys, order, bar, symbol)
    n = runs.groupBy(*keys, "length", "motif").agg(F.count("*").alias("n"), F.min("start").alias("first_start"))
    return n.filter(F.col("n") >= least).withColumn("saving", (F.col("n") - 1) * F.col("length"))



def tiled(df: DataFrame, keys: list[str], order: list[str], bar: str, symbol: str, least: int = 2) -> DataFrame:
    """A sequence laid out in motifs: keys, start, length and motif, every row covered once; rows outside motifs are
    tiles of their own (length 1). Null keys are a key.

    Motifs are placed greedily, those first that save most, then the longer, then those seen earlier, at each occurrence that is
    still free. What a place becomes depends on all placed before, so a sequence's rows and occurrences (at most three a bar)
    go to one task. One shuffle by keys: sequences are laid out as their sorted rows come by, those of a batch together.
    """
    lengths = range(SHORTEST, LONGEST + 1)
    d = _locked(df, keys, order, bar, symbol, SHORTEST, LONGEST)
    motif = [F.when(F.col("_first"), F.col(f"_m{n}")).alias(f"_m{n}") for n in lengths]
    rows = d.select(*keys, (F.col("_i") + 1).alias("_row"), F.col(symbol).cast("string").alias("_m1"), *motif).sortWithinPartitions(*keys, "_row")

    def ranked(table, bounds):
        """Places and lengths of the occurrences of motifs, in the order in which they are laid."""
        places, codes = [], []
        for n in lengths:
            found = table.column(f"_m{n}").chunk(0)
            places.append(np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False)))
            codes.append(found.drop_null().dictionary_encode().indices.to_numpy())
        place, code = np.concatenate(places), np.concatenate(codes)
        length = np.repeat(np.array(lengths), [len(p) for p in places])
        song = np.searchsorted(bounds, place, side="right")
        by_motif = np.lexsort((place, code, length, song))
        place, code, length, song = (x[by_motif] for x in (place, code, length, song))
        new = np.ones(len(place), dtype=bool)
        new[1:] = (code[1:] != code[:-1]) | (length[1:] != length[:-1]) | (song[1:] != song[:-1])
        motif = np.cumsum(new) - 1
        n, first = np.bincount(motif)[motif], place[new][motif]
        kept = np.flatnonzero(n >= least)
        kept = kept[np.lexsort((place[kept], first[kept], -length[kept], -(n * length - length)[kept], song[kept]))]
        return place[kept].tolist(), length[kept].tolist()

    def run(batches):
        free = {n: bytes([1]) * n for n in lengths}
        laid = {n: bytes([n]) + bytes(n - 1) for n in lengths}
        for table, bounds in whole_sequences(batches):
            tile = bytearray(b"\1" * table.num_rows)  # the length of the tile that begins at a row, 0 inside one
            for a, n in zip(*ranked(table, bounds), strict=True):
                if tile[a : a + n] == free[n]:
                    tile[a : a + n] = laid[n]
            length = np.frombuffer(tile, dtype=np.uint8)
            motif = table.column("_m1").chunk(0)
            for n in lengths:
                motif = pc.if_else(pa.array(length == n), table.column(f"_m{n}").chunk(0), motif)
            begin = pa.array(np.flatnonzero(length))
            start = pa.array(table.column("_row").to_numpy() - 1)
            cols = [*(table.column(c).chunk(0) for c in keys), start, pa.array(length.astype(np.int32)), motif]
            yield pa.RecordBatch.from_arrays([c.take(begin) for c in cols], names=[*keys, "start", "length", "motif"])

    return rows.mapInArrow(run, StructType(rows.select(*keys).schema.fields + StructType.fromDDL("start long, length int, motif string").fields))
