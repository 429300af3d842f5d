"""Near-duplicate documents: SetSketch registers, bands, joint likelihood estimates, exact verification."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ostinato.llm.common import connected_components, cut, give_back, in_blocks, key_runs, map_texts, pieces_of, utf8

WIDTH = 5  # words of a shingle
BANDS, ROWS = 24, 6
REGISTERS = BANDS * ROWS
#: Registers are floor(1 - log_BASE(x)) of minima x of exponential variables of rate RATE, cut to 0..255.
BASE, RATE = 1.12, 20.0
BLOCK = 1024  # classes of a bucket that are compared at once
WORDS_A_MEMBER = 400  # shingles that count as one of these classes
BROADCAST_IDS = 500_000  # ids (8 bytes each) up to which a list of documents is broadcast
_TEXT_BYTES = 1 << 20  # text hashed at once
_U = np.uint64


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=_U) | _U(1)


_LETTER, _PLACE, _MULTIPLY, _FLIP = _odd(1, 256), _odd(2, WIDTH + 1), _odd(3, REGISTERS), _odd(4, REGISTERS)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class _Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, as far as any text so far was long."""

    up, down = np.ones(1, dtype=_U), np.ones(1, dtype=_U)
    base = 0x9E3779B97F4A7C15

    @classmethod
    def upto(cls, n: int):
        if len(cls.up) < n:
            size = max(n, _TEXT_BYTES)
            cls.up, cls.down = (np.cumprod(np.append(_U(1), np.full(size - 1, b, dtype=_U)), dtype=_U) for b in (cls.base, pow(cls.base, -1, 1 << 64)))
        return cls.up[:n], cls.down[:n]


def shingle_sets(texts: list) -> list[np.ndarray]:
    """The sorted hashes (64 bits) of the distinct shingles of each text.

    Words are runs of bytes other than white space after lower-casing A-Z; fewer than WIDTH words
    make one shingle of all of them; without words the set is empty.
    """
    raw = [utf8(t).lower() for t in texts]
    out: list[np.ndarray] = []
    at = 0
    while at < len(raw):
        end, size = at, 0
        while end < len(raw) and (end == at or size + len(raw[end]) < _TEXT_BYTES):
            size += len(raw[end]) + 1
            end += 1
        out += _hashed(raw[at:end])
        at = end
    return out


def _hashed(raw: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank)).astype(np.int8)))
    begin, stop = edge[::2], edge[1::2]
    up, down = _Powers.upto(len(data) + 1)
    total = np.append(_U(0), np.cumsum(_LETTER[data] * up[: len(data)], dtype=_U))
    word = _mix((total[stop] - total[begin]) * down[begin] + (stop - begin).astype(_U))
    size = np.array([len(r) + 1 for r in raw])
    of = np.searchsorted(begin, np.append(0, np.cumsum(size)))
    n = len(word)
    windows = np.zeros(max(n - WIDTH + 1, 0), dtype=_U)
    for k in range(WIDTH):
        windows += word[k : k + len(windows)] * _PLACE[k]
    windows = _mix(windows)
    out = []
    for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
        if b - a >= WIDTH:
            out.append(np.unique(windows[a : b - WIDTH + 1]))
        elif b > a:
            few = np.append(word[a:b] * _PLACE[: b - a], np.array([b - a], dtype=_U) * _PLACE[WIDTH])
            out.append(_mix(few.sum(dtype=_U, keepdims=True)))
        else:
            out.append(np.zeros(0, dtype=_U))
    return out


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers of each set, a row of bytes each; the empty set has zeros.

    Every register is the truncated minimum, on an exponential scale, of one exponential variable
    per element; registers of a union are the larger of the two, so sketches can be merged.
    """
    out = np.zeros((len(sets), REGISTERS), dtype=np.uint8)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    joined = np.concatenate([sets[i] for i in full])
    start = np.append(0, np.cumsum([len(sets[i]) for i in full]))[:-1]
    least = np.empty((REGISTERS, len(full)), dtype=_U)
    for j in range(REGISTERS):
        least[j] = np.minimum.reduceat((joined ^ _FLIP[j]) * _MULTIPLY[j], start)
    x = -np.log1p(-(least.T.astype(np.float64) + 0.5) / 2.0**64 * (1 - 1e-16)) / RATE
    out[full] = np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, 255).astype(np.uint8)
    return out


def _differ(x: np.ndarray) -> np.ndarray:
    """Probability that a register is larger in the set with the share x of the union to itself."""
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)


_GRID = np.linspace(0, 1, 101)


def likely_jaccard(larger, smaller, n_a, n_b) -> np.ndarray:
    """The Jaccard similarity of greatest joint likelihood, on a grid of hundredths.

    ``larger`` and ``smaller`` count registers in which the first set's exceeds the second's and the
    other way round; n_a and n_b are the sets' known sizes.
    """
    larger, smaller, n_a, n_b = (np.asarray(v, dtype=float)[..., None] for v in (larger, smaller, n_a, n_b))
    u = n_a / (n_a + n_b)
    most = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    more, less = _differ(u - (1 - u) * _GRID), _differ((1 - u) - u * _GRID)
    same = np.clip(1 - more - less, 1e-12, 1)
    fit = larger * np.log(np.maximum(more, 1e-12)) + smaller * np.log(np.maximum(less, 1e-12)) + (REGISTERS - larger - smaller) * np.log(same)
    return _GRID[np.where(most + 0.005 >= _GRID, fit, -np.inf).argmax(axis=-1)]


def most_different(percent: int) -> int:
    """Of REGISTERS so many may differ between sets of this similarity: 7 standard deviations above the mean.

    A pair at the threshold exceeds it with a probability of about 1e-9; at 85 it is 50, at 80 61.
    """
    same = percent / 100
    p = 2 * float(_differ(np.array((1 - same) / 2)))
    return math.ceil(REGISTERS * p + 7 * math.sqrt(REGISTERS * p * (1 - p)))


def sketch_documents(documents: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (doc_id by default), n_shingles, a 128-bit digest of the shingle set (h1, h2) and its registers, for every row."""

    def make():
        def run(texts):
            sets = shingle_sets(texts)
            h1, h2 = _digests(sets)
            return [[len(s) for s in sets], h1, h2, [r.tobytes() for r in sketch(sets)]]

        return run

    return map_texts(documents, make, "n_shingles long, h1 long, h2 long, registers binary", keep)


def _digests(sets) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set of differently mixed hashes: equal sets, and in practice only they, agree."""
    pairs = [(s.sum(dtype=_U), _mix(s * _MULTIPLY[0]).sum(dtype=_U)) for s in sets]
    h = np.array(pairs, dtype=_U).reshape(-1, 2).view(np.int64)
    return h[:, 0], h[:, 1]


def _registers(column) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, column)), dtype=np.uint8).reshape(-1, REGISTERS)


@pandas_udf(DoubleType())
def _estimate(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=float)
    x, y = _registers(a), _registers(b)
    return pd.Series(likely_jaccard((x > y).sum(axis=1), (x < y).sum(axis=1), n_a, n_b))


def _within(percent: int, n_a, n_b):
    """Whether sets of these sizes can have a Jaccard similarity of ``percent`` at all."""
    return (100 * n_a >= percent * n_b) & (100 * n_b >= percent * n_a)


def _candidates(r: np.ndarray, n: np.ndarray, i: int, among: np.ndarray, percent: int, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Those of the rows ``among`` that may link with row i by their registers, and their estimates."""
    j = among[_within(percent, n[among], n[i])]
    # Few registers differ at such a similarity; the likelihood is left to those pairs.
    j = j[(r[j] != r[i]).sum(axis=1) <= most_different(percent)]
    if not len(j):
        return j, np.zeros(0)
    s = likely_jaccard((r[i] > r[j]).sum(axis=1), (r[i] < r[j]).sum(axis=1), np.full(len(j), n[i]), n[j])
    near = s >= percent / 100 - slack
    return j[near], s[near]


def _chosen_band(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, rows: int) -> np.ndarray:
    """Of the bands that each pair shares the one in which it is looked at, chosen by a hash of its sets' digests."""
    bands = REGISTERS // rows
    shared = (x == y)[:, : bands * rows].reshape(len(x), bands, rows).all(axis=2)
    low, high = np.minimum(a, b).astype(_U), np.maximum(a, b).astype(_U)
    nth = (_mix(low * _U(0x9E3779B97F4A7C15) ^ _mix(high)) % shared.sum(axis=1).astype(_U)).astype(np.int64)
    return (shared.cumsum(axis=1) > nth[:, None]).argmax(axis=1)


_BLOCK_KEYS = ["key", "bi", "bj"]


def _likely_pairs(g: pd.DataFrame, percent: int, slack: float, rows: int) -> list[tuple[float, int, int]]:
    """(estimate, i, j) of the rows of a block that may link two components, by their registers alone."""
    r, n, h1 = _registers(g["registers"]), g["n_shingles"].to_numpy(), g["h1"].to_numpy()
    own, band, across = g["own"].to_numpy(), g["band"].iloc[0], g["bi"].iloc[0] != g["bj"].iloc[0]
    group, pairs, place = g["component"].to_numpy(), [], np.arange(len(g))
    for i in range(len(g) - 1):
        open_ = group[i + 1 :] != group[i]
        if across:
            open_ &= own[i + 1 :] != own[i]
        if not open_.any():
            continue
        j, s = _candidates(r, n, i, place[i + 1 :][open_], percent, slack)
        if len(j):
            here = _chosen_band(r[j], r[[i]], h1[j], np.full(len(j), h1[i]), rows) == band
            pairs += zip(s[here].tolist(), [i] * int(here.sum()), j[here].tolist(), strict=True)
    return pairs


def _rows_of_likely_pairs(percent: int, slack: float, rows: int):
    """The rows of each block that take part in a likely pair of two components: only they need their texts."""

    def run(batches):
        for g in key_runs(batches, _BLOCK_KEYS):
            pairs = _likely_pairs(g, percent, slack, rows) if g["component"].nunique() > 1 else []
            if pairs:
                yield g.iloc[sorted({k for _, i, j in pairs for k in (i, j)})]
        give_back()

    return run


def _links_in_blocks(percent: int, slack: float, rows: int):
    """Verified links between different components in each block of a bucket: a spanning forest of them."""

    def run(batches):
        for g in key_runs(batches, _BLOCK_KEYS):
            yield pd.DataFrame(_forest(g, percent, slack, rows), columns=["a", "a_h1", "b", "b_h1"], dtype="int64")
        give_back()

    return run


def _forest(g: pd.DataFrame, percent: int, slack: float, rows: int) -> list[tuple[int, int, int, int]]:
    rep, h1 = g["rep"].tolist(), g["h1"].tolist()
    _, group = np.unique(g["component"].to_numpy(), return_inverse=True)
    texts, sets, root, out = g["text"].tolist(), {}, list(range(int(group.max()) + 1)), []

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    def set_of(i: int) -> np.ndarray:
        """The row's set, or an empty one if its text is another row's under the same id."""
        if i not in sets:
            found = shingle_sets([texts[i]])
            sets[i] = found[0] if _digests(found)[0][0] == h1[i] else np.zeros(0, dtype=_U)
        return sets[i]

    for _, i, j in sorted(_likely_pairs(g, percent, slack, rows), reverse=True):  # likely links first: they spare the rest of their components
        u, v = top(group[i]), top(group[j])
        if u != v and _linked(set_of(i), set_of(j), percent):
            root[max(u, v)] = min(u, v)
            out.append((rep[i], h1[i], rep[j], h1[j]))
    return out


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            texts = [batch.schema.get_field_index(c) for c in ("a_text", "b_text")]
            for part in pieces_of(batch, texts):
                a, b = (list(zip(part.column(i).to_pylist(), part.column(f"{i}_h1").to_pylist(), part.column(f"{i}_text").to_pylist(), strict=True)) for i in "ab")
                # Each text is cut into its set once; pairs of a group share one side.
                known = list(dict.fromkeys([*a, *b]))
                sets = shingle_sets([t for _, _, t in known])
                # A text whose digest isn't the class's is another row's under the same id.
                right = [d == h for d, (_, h, _) in zip(_digests(sets)[0].tolist(), known, strict=True)]
                of = {k: i for i, k in enumerate(known)}
                good = []
                for i, (x, y) in enumerate(zip(a, b, strict=True)):
                    x, y = of[x], of[y]
                    if right[x] and right[y] and _linked(sets[x], sets[y], percent):
                        good.append(i)
                yield part.select(["a", "a_h1", "b", "b_h1"]).take(pa.array(good, pa.int64()))
            give_back()

    return run


def _texts(documents: DataFrame, ids: DataFrame, n_ids: int) -> DataFrame:
    """(doc_id, text) of these ids. The list is broadcast while it is short, else both sides are shuffled."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids, "doc_id", "left_semi")


_LINK = "a long, a_h1 long, b long, b_h1 long"


def _components(links: DataFrame) -> DataFrame:
    """(rep, h1, component) of the classes in ``links``; a class is told by its first id and its set's digest."""
    node = lambda s: F.struct(F.col(s).alias("rep"), F.col(f"{s}_h1").alias("h1"))
    return connected_components(links.select(node("a").alias("a"), node("b").alias("b"))).select("node.*", "component")


def near_duplicates(documents: DataFrame, percent: int = 85, slack: float = 0.1, band_rows: int = ROWS, keep: list[str] | None = None) -> DataFrame:
    """Every row of ``documents`` with its near-duplicate component: doc_id, n_shingles, component_id, kept.

    Documents link if 100 * shared >= ``percent`` * united of their 5-word shingle sets, and component_id is
    the smallest id reachable. kept says that it is the row's own id. Documents without words link with
    nothing. Repeated rows are returned each; rows that share an id but not the text link by their own
    sets alone; null ids link with nothing and are kept. Other columns are dropped, but for those in ``keep`` (which must name
    doc_id), beside which h1 (a digest of the row's set) and leads (whether the component was begun by that set) are returned.

    Equal sets are one class from the start. Classes that share a band of ``band_rows`` registers are candidates,
    filtered by the likelihood estimate (``slack`` is more than three standard errors) and confirmed on full
    sets: first each class with the likeliest of its buckets' first members; then, only in buckets
    that still hold several components, every likely pair between components, in blocks of bounded size. These
    blocks hold registers; members of a bucket's largest component meet the others only, and no texts but those
    of likely pairs are fetched. They return verified links alone, at most one less than their components. So
    no link that could join two components is left untested, and no pairs are written out.
    """
    rows = cut(sketch_documents(documents, keep))
    classes = rows.filter("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2", "n_shingles")
    classes = cut(classes.agg(F.min("doc_id").alias("rep"), F.any_value("registers").alias("registers")))
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.xxhash64(F.lit(i), F.substring("registers", i * band_rows + 1, band_rows)).alias("key")) for i in range(REGISTERS // band_rows)])
    banded = classes.select("rep", "h1", "n_shingles", F.explode(bands).alias("x")).select("rep", "h1", "n_shingles", "x.*")
    buckets = banded.groupBy("key").agg(F.min(F.struct("rep", "h1")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    members = cut(banded.join(buckets, "key"))
    info = classes.select("rep", "h1", "n_shingles", "registers")
    side = lambda s: info.select(*[F.col(c).alias(s if c == "rep" else f"{s}_{c}") for c in info.columns])

    star = members.filter("rep <> first.rep or h1 <> first.h1").select(F.col("first.rep").alias("a"), F.col("first.h1").alias("a_h1"), F.col("rep").alias("b"), F.col("h1").alias("b_h1")).distinct()
    star = star.join(side("a"), ["a", "a_h1"]).join(side("b"), ["b", "b_h1"]).filter(_within(percent, F.col("a_n_shingles"), F.col("b_n_shingles")))
    star = star.withColumn("s", _estimate("a_registers", "b_registers", "a_n_shingles", "b_n_shingles")).filter(F.col("s") >= percent / 100 - slack)
    tested = star.groupBy("b", "b_h1").agg(F.max_by(F.struct("a", "a_h1"), F.struct("s", -F.col("a"), "a_h1")).alias("x")).select("b", "b_h1", "x.*")
    tested = cut(tested)
    ids = cut(tested.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = _texts(documents, ids, ids.count())
    for s in ("a", "b"):
        tested = tested.join(texts.select(F.col("doc_id").alias(s), F.col("text").alias(f"{s}_text")), s)
    links = cut(tested.mapInArrow(_verify(percent), _LINK).distinct())
    components = _components(links)

    placed = members.join(components, ["rep", "h1"], "left").drop("first")
    placed = placed.withColumn("component", F.xxhash64(F.coalesce("component", F.struct("rep", "h1"))))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    open_ = cut(placed.join(mixed, "key"))
    # Sizes, by which buckets are cut into blocks, count members and, where they are long, words.
    of = open_.groupBy("key", "component").agg(F.sum(F.greatest(F.lit(1.0), F.col("n_shingles") / WORDS_A_MEMBER)).alias("size"))
    of = of.groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("_main"), F.max("size").alias("main"), (F.sum("size") - F.max("size")).alias("rest"))
    sized = open_.join(of, "key").withColumn("is_main", F.col("component") == F.col("_main")).join(info.drop("n_shingles"), ["rep", "h1"])
    blocks = in_blocks(sized, ["key"], ["rep", "h1"], BLOCK, "rest", "main", "is_main").select("key", "bi", "bj", "own", "band", "rep", "h1", "n_shingles", "component", "registers")
    likely = cut(blocks.mapInPandas(_rows_of_likely_pairs(percent, slack, band_rows), blocks.schema))
    ids = cut(likely.select(F.col("rep").alias("doc_id")).distinct())
    texts = _texts(documents, ids, ids.count()).withColumnRenamed("doc_id", "rep")
    likely = likely.join(texts, "rep").repartition(*_BLOCK_KEYS).sortWithinPartitions(*_BLOCK_KEYS)
    more = cut(likely.mapInPandas(_links_in_blocks(percent, slack, band_rows), _LINK).distinct())
    if not more.isEmpty():
        # Links between components found so far join them as wholes.
        components = _components(links.union(more))
    known = classes.select("h1", "h2", "n_shingles", "rep").join(components, ["rep", "h1"], "left")
    out = rows.drop("registers").join(known, ["h1", "h2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component.rep", "rep", "doc_id"))
    out = out.withColumn("component_id", component)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    if keep is None:
        return out.select("doc_id", "n_shingles", "component_id", kept)
    return out.select(*keep, "n_shingles", "component_id", kept, "h1", F.coalesce(F.col("h1") == F.col("component.h1"), F.lit(True)).alias("leads"))
