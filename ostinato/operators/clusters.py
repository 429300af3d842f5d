"""Clusters of blocks: complete linkage, and single linkage with a veto of distinctive symbols and an arbiter of energy.

A sequence's blocks (tens, not its rows) go to one task.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StructField, StructType

# How alike blocks must be, also when one is shifted by a row; differences of energy that join or part them.
LIKE, LIKE_SHIFTED, JOINS, PARTS = 0.6, 0.8, 0.4, 0.8


def by_first(ids: list) -> list[int]:
    """Numbers of groups in order of their first members."""
    seen: dict = {}
    return [seen.setdefault(i, len(seen)) for i in ids]


def complete_linkage(sim: np.ndarray, least: float) -> list[int]:
    """Cluster of each item: the two clusters whose least similar members are most similar merge (the first pair among
    equals), as long as these reach ``least``. Least similarities are kept up to date, so a merge costs one row."""
    n = len(sim)
    s = np.array(sim, dtype=float)
    np.fill_diagonal(s, -np.inf)
    group, open_ = list(range(n)), np.ones(n, dtype=bool)
    while open_.sum() > 1:
        live = np.flatnonzero(open_)
        part = np.triu(s[np.ix_(live, live)], 1)
        part[np.tril_indices(len(live))] = -np.inf
        k = int(part.argmax())
        a, b = live[k // len(live)], live[k % len(live)]
        if s[a, b] < least:
            break
        s[a] = s[:, a] = np.minimum(s[a], s[b])
        s[a, a] = -np.inf
        open_[b] = False
        group = [int(a) if g == b else g for g in group]
    return by_first(group)


def _common(a: list, b: list) -> float:
    k = min(len(a), len(b))
    return sum(x == y for x, y in zip(a, b, strict=False)) / k if k else 0.0


def likeness(a: list, b: list) -> float:
    """Share of equal symbols by place over the shorter block, or with one block begun a row later if that is very alike."""
    if not a or not b:
        return 0.0
    return max([_common(a, b)] + [m for m in (_common(a[1:], b), _common(a, b[1:])) if m >= LIKE_SHIFTED])


def vetoed(a: list, b: list, least: int = 2, share: float = 0.2) -> bool:
    """Whether a symbol that recurs in one block is wholly absent from the other."""
    return any(n >= least and n >= share * len(x) and s not in y for x, y in ((a, b), (b, a)) for s, n in Counter(x).items())


def arbitrated(blocks: list[list], energy: list[float] | None = None) -> list[int]:
    """Cluster of each block by links: alike and not vetoed (or vetoed, but of the same energy), and not of very different
    energy. Energies count as standard scores of at least 4 blocks that vary by a tenth; else all count as of the
    same energy, so that no veto holds."""
    z = None
    if energy is not None and len(energy) >= 4:
        e = np.asarray(energy, dtype=float)
        if e.mean() > 1e-9 and e.std() / e.mean() >= 0.1:
            z = (e - e.mean()) / (e.std() + 1e-9)
    root = list(range(len(blocks)))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i, a in enumerate(blocks):
        for j in range(i + 1, len(blocks)):
            if likeness(a, blocks[j]) < LIKE:
                continue
            apart = abs(z[i] - z[j]) if z is not None else 0.0
            if (not vetoed(a, blocks[j]) or apart < JOINS) and apart <= PARTS:
                root[top(i)] = top(j)
    return by_first([top(i) for i in range(len(blocks))])


def cluster_blocks(df: DataFrame, keys: list[str], block: str, symbols: str, energy: str | None = None) -> DataFrame:
    """(keys, block, cluster) of blocks with arrays of ``symbols`` and perhaps an energy, by ``arbitrated``."""
    columns = [block, symbols, *([energy] if energy else [])]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(block)
        got = arbitrated([list(x) for x in g[symbols]], g[energy].tolist() if energy else None)
        return g[[*keys, block]].assign(cluster=np.array(got, dtype=np.int32))

    known = {f.name: f for f in df.schema}
    schema = StructType([known[c] for c in [*keys, block]] + [StructField("cluster", IntegerType())])
    return df.select(*keys, *columns).groupBy(*keys).applyInPandas(run, schema)


def cluster_vectors(df: DataFrame, keys: list[str], block: str, vector: str, least: float) -> DataFrame:
    """(keys, block, cluster) of blocks by complete linkage of their vectors' cosines."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(block)
        m = np.stack(g[vector].to_list()).astype(float)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        return g[[*keys, block]].assign(cluster=np.array(complete_linkage(m @ m.T, least), dtype=np.int32))

    known = {f.name: f for f in df.schema}
    schema = StructType([known[c] for c in [*keys, block]] + [StructField("cluster", IntegerType())])
    return df.select(*keys, block, vector).groupBy(*keys).applyInPandas(run, schema)
