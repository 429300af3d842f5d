"""Near-duplicate embeddings: random-hyperplane signs in several tables, exact cosines, components."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from ostinato.llm.common import connected_components, cut, in_blocks, key_runs

BLOCK = 2048  # vectors of a bucket that are compared at once


def table_shape(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bits, tables) for n vectors: buckets of unrelated vectors stay small, and a pair at the
    threshold shares no bucket with probability at most ``miss``. Signs of a table fill at most 30 bits, enough
    for 2**27 vectors at an eighth of a vector a bucket; beyond, buckets grow with the input and are cut into blocks."""
    bits = min(30, max(10, math.ceil(math.log2(max(n, 2))) + 3))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - same))


def _signs(bits: int, tables: int, seed: int):
    planes: dict[int, np.ndarray] = {}

    @pandas_udf("array<int>")
    def signs(vectors: pd.Series) -> pd.Series:
        out: list = [None] * len(vectors)
        size = vectors.map(len).to_numpy() if len(vectors) else np.zeros(0, int)
        for d in np.unique(size):
            at = np.flatnonzero(size == d)
            if d not in planes:
                planes[d] = np.random.default_rng([seed, int(d)]).standard_normal((int(d), bits * tables))
            x = np.stack(vectors.iloc[at].to_list()).astype(np.float64)
            up = (x @ planes[d] > 0).reshape(len(at), tables, bits)
            for i, row in zip(at, up @ (1 << np.arange(bits)), strict=True):
                out[i] = row.astype(np.int32)
        return pd.Series(out)

    return signs


def _compare(threshold: float):
    def run(batches):
        for g in key_runs(batches, ["t", "s", "d", "bi", "bj"]):
            t, bi, bj = int(g["t"].iloc[0]), g["bi"].iloc[0], g["bj"].iloc[0]
            x = np.stack(g["embedding"].to_list()).astype(np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.sqrt(np.square(x).sum(axis=1, keepdims=True))
            linked = x @ x.T >= threshold
            np.fill_diagonal(linked, False)
            if bi != bj:  # pairs inside a block belong to that block's own pair
                own = g["own"].to_numpy()
                linked &= own[:, None] != own[None, :]
            if not linked.any():
                continue
            # A pair counts in the first table in which it shares a bucket.
            sig = np.stack(g["sig"].to_list())
            first = np.zeros(len(g), dtype=np.int64)
            copies = g["copies"].to_numpy()
            for i in np.flatnonzero(linked.any(axis=1)):
                j = np.flatnonzero(linked[i])
                j = j[~(sig[j, :t] == sig[i, :t]).any(axis=1)] if t else j
                first[i] = copies[j].sum()
            root = np.full(len(g), -1)
            for i in range(len(g)):
                if root[i] < 0 and linked[i].any():
                    front = np.zeros(len(g), dtype=bool)
                    front[i] = True
                    while front.any():
                        root[front] = i
                        front = linked[front].any(axis=0) & (root < 0)
            at = np.flatnonzero(root >= 0)
            rep = g["rep"].to_numpy()
            yield pd.DataFrame({"rep": rep[at], "links": first[at], "root": rep[root[at]]})

    return run


def near_duplicates(embeddings: DataFrame, threshold: float = 0.95, miss: float = 1e-3, seed: int = 7) -> DataFrame:
    """Every vector with its direct links and its component: vec_id, n_links, component_id, kept.

    Vectors link if they share a bucket in any table and their cosine in double precision is at least
    ``threshold``; a pair at the threshold is missed with probability ``miss`` at most, closer pairs with
    less. Vectors that are null, empty, zero, or hold a null, NaN or infinite component link with
    nothing; vectors of different lengths don't link. Equal vectors are one class until the end and
    link with each other. component_id is the smallest id reachable, kept says whether it is the
    vector's own. Ids are expected to be unique: rows that repeat an id are returned and counted as
    further vectors. Rows with null ids link with nothing and are kept. Other columns are dropped.

    Buckets are cut into blocks of 2,048 and compared block by block; a task sends on a link
    count and one representative per vector, never pairs.
    """
    e = F.col("embedding")
    usable = F.size(e) > 0
    usable &= ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), e)
    rows = rows.withColumn("h1", F.when(usable & F.col("vec_id").isNotNull(), F.xxhash64(e))).withColumn("h2", F.xxhash64(F.lit(seed), e))
    classes = rows.filter("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.any_value(e).alias("embedding"))
    bits, tables = table_shape(classes.count(), threshold, miss)
    classes = cut(classes.withColumn("sig", _signs(bits, tables, seed)(e)).withColumn("d", F.size(e)))
    keyed = classes.select("rep", "d", F.posexplode("sig").alias("t", "s"))
    buckets = keyed.groupBy("t", "s", "d").agg(F.count("*").alias("n")).filter("n > 1")
    members = keyed.join(buckets, ["t", "s", "d"]).join(classes.select("rep", "copies", e, "sig"), "rep")
    blocks = in_blocks(members, ["t", "s", "d"], ["rep"], BLOCK, "n")
    found = cut(blocks.mapInPandas(_compare(threshold), "rep long, links long, root long"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = classes.select("h1", "h2", "rep", "copies").join(links, "rep", "left")
    known = known.join(components.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "vec_id")
    return rows.drop("embedding").join(known, ["h1", "h2"], "left").select(
        "vec_id",
        F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
