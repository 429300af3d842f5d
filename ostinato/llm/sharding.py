"""Sharding by a k-d tree over text metadata, split at distributed medians weighted by bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ostinato.llm.common import cut

OVERHEAD = 16  # bytes that a document takes besides its text
_AXIS_BITS, _TIE_BITS, _DIGIT = 24, 36, 12
_AXES = ["log_bytes", "log_lines", "other_script"]


def describe(documents: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, a hash of the text, its coordinates and a number of the row; texts themselves stay behind.

    Coordinates depend on the text alone, so equal texts have the same place in the tree. The number tells
    rows with the same id and text apart; it is stable once the result is stored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = F.encode(text, "UTF-8")
    n, lines = F.octet_length(text), F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (n + OVERHEAD).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
        F.log1p(n.cast("double")).alias("log_bytes"),
        F.log1p(lines.cast("double")).alias("log_lines"),
        ((n - F.length(text)) / F.greatest(n, F.lit(1))).alias("other_script"),
        F.monotonically_increasing_id().alias("row"),
    )


def _split_hot_groups(rows: DataFrame, target: float) -> DataFrame:
    """``rows`` with the tie-break key: a hash of the text, and for texts whose copies together exceed
    half a shard also of the document, and within a document's repeated rows of the row's number, so that
    those groups can be cut anywhere. There are fewer than twice as many such groups as shards, which bounds the broadcast."""
    groups = rows.groupBy("text_hash", "text_crc32").agg(F.sum("size").alias("group_bytes"), F.count("*").alias("n"))
    hot = groups.filter((F.col("group_bytes") > target / 2) & (F.col("n") > 1)).select("text_hash", "text_crc32", F.lit(True).alias("hot"))
    rows = rows.join(F.broadcast(hot), ["text_hash", "text_crc32"], "left")
    bits = lambda n, *columns: F.shiftrightunsigned(F.xxhash64(*columns), 64 - n)
    row_bits = _TIE_BITS // 3
    apart = F.shiftleft(bits(_TIE_BITS - row_bits, "text_hash", "doc_id"), row_bits) + bits(row_bits, "row")
    return rows.withColumn("tie", F.when(F.col("hot"), apart).otherwise(bits(_TIE_BITS, "text_hash", "text_crc32"))).drop("hot")


def _for_node(values: dict[int, int]) -> Column:
    """A long for each node of the tree, null for others; a level of the tree has no more nodes than shards."""
    pairs = [F.lit(x).cast("long") for item in values.items() for x in item]
    return F.element_at(F.create_map(*pairs), F.col("node"))


def _place(cuts: dict[tuple[int, int], tuple[str, int]], node: int, k: int) -> Column:
    """The node of a row, from the tree of cuts so far: one comparison a level, nothing is stored."""
    if (node, k) not in cuts:
        return F.lit(node).cast("long")
    axis, at = cuts[node, k]
    return F.when(F.col(axis) > at, _place(cuts, node + k // 2, k - k // 2)).otherwise(_place(cuts, node, k // 2))


def shard(documents: DataFrame, n_shards: int = 40, target_bytes: int | None = None) -> DataFrame:
    """Every row of ``documents`` with its shard: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    There are ``n_shards``, or with ``target_bytes`` as many as make shards of at most about that size. The law
    is ``bytes``: shard sizes are near equal. A node that stands for k shards is split
    along the coordinate that is widest in it (its range as a share of the whole table's) at the
    weighted median, or the k-dependent quantile where k is odd, found exactly by counting bytes for
    12 bits of the key at a time: a pass returns at most 4,096 rows a node. Ties go by a
    hash of the text, so equal texts stay together unless they exceed half a shard (``key`` alone
    would place a grown shard, so grown_shard is null). slot numbers each shard's rows from 0 without
    gaps, in the order of sub-blocks of about 20,000 rows and ids within them.

    Null texts count as empty (16 bytes, crc32 0); null ids and repeated rows are placed like others, and a
    text's rows are cut even if all have one id; an empty table gives no rows. Other columns are dropped.
    Texts are read once; the narrow rows with their keys are stored once, and cuts are kept as an expression.
    """
    rows = cut(describe(documents))
    whole = rows.agg(
        F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("n"), *[f(a).alias(f"{k}_{a}") for a in _AXES for k, f in (("lo", F.min), ("hi", F.max))]
    ).first()
    if target_bytes is not None:
        n_shards = max(1, -(-whole["bytes"] // target_bytes))
    rows = _split_hot_groups(rows, whole["bytes"] / n_shards)
    span = {a: (whole[f"hi_{a}"] or 0) - (whole[f"lo_{a}"] or 0) for a in _AXES}
    for a in _AXES:
        place = (F.col(a) - F.lit(float(whole[f"lo_{a}"] or 0))) / F.lit(span[a] or 1.0) * ((1 << _AXIS_BITS) - 1)
        rows = rows.withColumn(a, F.shiftleft(place.cast("long"), _TIE_BITS) + F.col("tie"))
    rows = cut(rows.select("doc_id", "size", "text_crc32", *_AXES, "row"))
    # Nodes are numbered by their first shard and stand for k shards each.
    open_nodes, cuts = {0: n_shards}, {}
    while any(k > 1 for k in open_nodes.values()):
        splits = {node: k for node, k in open_nodes.items() if k > 1}
        placed = rows.withColumn("node", _place(cuts, 0, n_shards))
        wide = placed.groupBy("node").agg(F.sum("size").alias("b"), *[(F.max(a) - F.min(a)).alias(a) for a in _AXES]).collect()
        axis = {r["node"]: max(range(len(_AXES)), key=lambda i, r=r: r[_AXES[i]]) for r in wide}
        aim = {r["node"]: r["b"] * (splits[r["node"]] // 2) / splits[r["node"]] for r in wide if r["node"] in splits}
        if aim:
            key = F.element_at(F.array(*_AXES), (_for_node({n: axis[n] + 1 for n in aim})).cast("int"))
            found = _weighted_cuts(placed.filter(F.col("node").isin(list(aim))).select("node", "size", key.alias("key")), aim)
            cuts |= {(n, splits[n]): (_AXES[axis[n]], at) for n, at in found.items()}
        open_nodes = {m: j for n, k in open_nodes.items() for m, j in (((n, k // 2), (n + k // 2, k - k // 2)) if k > 1 else ((n, k),))}
    return _slots(rows.withColumn("node", _place(cuts, 0, n_shards)), n_shards, whole["n"])


def _weighted_cuts(rows: DataFrame, aim: dict[int, float]) -> dict[int, int]:
    """For each node the key at which the bytes of rows up to it come closest to ``aim``."""
    prefix, below, found = dict.fromkeys(aim, 0), dict.fromkeys(aim, 0.0), {}
    for shift in range(_AXIS_BITS + _TIE_BITS - _DIGIT, -1, -_DIGIT):
        left = {n: p for n, p in prefix.items() if n not in found}
        if not left:
            break
        inside = rows.filter(F.shiftright("key", shift + _DIGIT) == _for_node(left))
        digit = F.shiftright("key", shift).bitwiseAND((1 << _DIGIT) - 1)
        bins: dict[int, list] = {}
        for r in inside.groupBy("node", digit.alias("d")).agg(F.sum("size").alias("b"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect():
            bins.setdefault(r["node"], []).append(r)
        for n, got in bins.items():
            for r in sorted(got, key=lambda r: r["d"]):
                if below[n] + r["b"] >= aim[n]:
                    if r["lo"] == r["hi"]:  # one key: it goes to the side that leaves the smaller error
                        found[n] = r["hi"] if below[n] + r["b"] - aim[n] <= aim[n] - below[n] else r["lo"] - 1
                    prefix[n] = (prefix[n] << _DIGIT) + r["d"]
                    break
                below[n] += r["b"]
            else:
                found[n] = max(r["hi"] for r in got)
    return found


def _slots(rows: DataFrame, n_shards: int, n_rows: int, block_rows: int = 20_000) -> DataFrame:
    """Gapless numbers within each shard: rows are numbered in blocks of the hashes of ids and row numbers, then
    shifted by the counts of the blocks before, so no task sorts a whole shard, nor all rows of one id."""
    blocks = max(1, -(-n_rows // (n_shards * block_rows)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "row"), F.lit(blocks)))
    before = Window.partitionBy("node").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = rows.groupBy("node", "block").agg(F.count("*").alias("n"))
    start = start.select("node", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    number = F.row_number().over(Window.partitionBy("node", "block").orderBy("doc_id", "text_crc32", "size", "row"))
    return rows.withColumn("i", number).join(start, ["node", "block"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("node").cast("int").alias("shard"),
        (F.col("start") + F.col("i") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
