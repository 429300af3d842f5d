"""Line dedup: documents probe the arrays of a sharded minimal perfect hash over the hashes of frequent lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.llm.common import cut, give_back, map_texts, pieces_of, short_batches, text_hash, utf8, with_fields

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BLANKS = b" \t\n\x0b\x0c\r"
SHARD_KEYS = 1 << 15  # line hashes of a shard, about
KEY_BYTES = 24  # a key's share of the arrays: fingerprint, count, owner and about four bits of the hash
BROADCAST_UPTO = 32 << 20  # bytes of arrays that every worker may hold
PROBES = 1 << 18  # lines that probe a shard in one task, about, where the arrays aren't broadcast
NOBODY = -(1 << 63)  # the owner where no document with an id holds the line
_ROOM = 2  # bits of a level for every key that reaches it


def line_digests(text, min_chars: int) -> list[bytes | None]:
    """For every line of a text the digest of its key, None where the key has fewer than ``min_chars`` code points."""
    out = []
    for line in utf8(text).translate(LOWER).split(b"\n"):
        key = line.strip(BLANKS)
        short = len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars)
        out.append(None if short else xxhash.xxh3_128_digest(key))
    return out


def words_of(digests: list[bytes]) -> np.ndarray:
    """Digests as rows of two unsigned 64-bit numbers."""
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 2)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _at(h: np.ndarray, level: int, size: np.ndarray) -> np.ndarray:
    """The bit of each hash on a level of ``size`` bits."""
    return _mix(h[:, 0] ^ _mix(h[:, 1] + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64))) % size


def build_levels(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A minimal perfect hash over distinct rows ``h``: bits of each level, the levels' words, and every row's slot.

    A level has two bits a key. A bit that a single key falls on is set and is that key's; the
    others go on to the next level. A key's slot is the number of set bits before its own.
    """
    sizes, words = [], []
    left, where = np.arange(len(h)), np.zeros(len(h), dtype=np.int64)
    base = 0
    while len(left):
        size = -(-_ROOM * len(left) // 64) * 64
        bit = _at(h[left], len(sizes), np.uint64(size)).astype(np.int64)
        alone = np.bincount(bit, minlength=size)[bit] == 1
        flags = np.zeros(size, dtype=np.uint8)
        flags[bit[alone]] = 1
        words.append(np.packbits(flags, bitorder="little").view("<u8"))
        where[left[alone]] = base + bit[alone]
        left = left[~alone]
        sizes.append(size)
        base += size
    words = np.concatenate([*words, np.zeros(0, dtype="<u8")])
    return np.array(sizes, dtype=np.int64), words, np.argsort(np.argsort(where))


class LineIndex:
    """Shards' levels one after another; fingerprints, counts and owners stand at the rank of a key's bit."""

    def __init__(self, n_shards: int, shards: list):
        """``shards`` are rows of shard, sizes, words, prints, counts and owners; those of some shards suffice."""
        self.n_shards = n_shards
        shards = sorted(shards, key=lambda r: r["shard"])
        part = lambda name, kind: np.concatenate([*(np.frombuffer(r[name], dtype=kind) for r in shards), np.zeros(0, dtype=kind)])
        self.words, self.prints = part("words", "<u8"), part("prints", "<u8")
        self.counts, self.owners = part("counts", "<i8"), part("owners", "<i8")
        self.rank = np.cumsum(np.bitwise_count(self.words).astype(np.int64)) - np.bitwise_count(self.words)
        sizes = {r["shard"]: np.frombuffer(r["sizes"], dtype="<i8") for r in shards}
        self.depth = max(map(len, sizes.values()), default=0)
        self.size = np.zeros((n_shards, self.depth), dtype=np.int64)
        self.base = np.zeros((n_shards, self.depth), dtype=np.int64)
        at = 0
        for s, x in sizes.items():
            self.size[s, : len(x)] = x
            self.base[s, : len(x)] = at + np.cumsum(x) // 64 - x // 64
            at += int(x.sum()) // 64

    def find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 for those of no key: their fingerprint isn't the slot's."""
        shard = (h[:, 0] % np.uint64(self.n_shards)).astype(np.int64)
        slot = np.full(len(h), -1)
        left = np.arange(len(h))
        for level in range(self.depth):
            size = self.size[shard[left], level]
            left, size = left[size > 0], size[size > 0]
            if not len(left):
                break
            bit = _at(h[left], level, size.astype(np.uint64)).astype(np.int64)
            word = self.base[shard[left], level] + (bit >> 6)
            low = (bit & 63).astype(np.uint64)
            is_set = (self.words[word] >> low) & np.uint64(1) == 1
            before = np.bitwise_count(self.words[word] & ((np.uint64(1) << low) - np.uint64(1)))
            slot[left[is_set]] = (self.rank[word] + before)[is_set]
            left = left[~is_set]
        met = slot >= 0
        met[met] = self.prints[slot[met]] == h[met, 1]
        return np.where(met, slot, -1)


def line_counts(documents: DataFrame, min_chars: int = 20) -> DataFrame:
    """(h1, h2, n_docs, owner) of every distinct line key of ``min_chars`` code points or more.

    The hash has 128 bits. ``n_docs`` counts rows, each once, so rows that repeat an id are documents of their own; ``owner``
    is the largest doc_id that holds the line (NOBODY for null ids alone). Counts are summed in each batch before the shuffle.
    """
    short_batches(documents.sparkSession)

    def run(batches):
        give_back()
        for batch in batches:
            seen: dict[bytes, list[int]] = {}
            for part in pieces_of(batch, [1]):
                for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    owner = NOBODY if i is None else i
                    for d in set(line_digests(t, min_chars)) - {None}:
                        if (x := seen.get(d)) is None:
                            seen[d] = [1, owner]
                        else:
                            x[0] += 1
                            x[1] = max(x[1], owner)
            h = words_of(list(seen)).view("<i8")
            n = np.array(list(seen.values()), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(n[:, 0]), pa.array(n[:, 1])], names=["h1", "h2", "n", "owner"])
            del seen, h, n
            give_back()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(run, "h1 long, h2 long, n long, owner long")
    return found.groupBy("h1", "h2").agg(F.sum("n").alias("n_docs"), F.max("owner").alias("owner"))


def build_index(frequent: DataFrame, n_shards: int) -> DataFrame:
    """One row a shard of the perfect hash over ``frequent`` (h1, h2, n_docs, owner): its levels and its arrays.

    Shards are dealt by the hash, so each holds about SHARD_KEYS keys however often their lines occur.
    """

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.ascontiguousarray(pdf[["h1", "h2"]].to_numpy(dtype=np.int64)).view("<u8")
        sizes, words, slot = build_levels(h)
        order = np.empty(len(slot), dtype=np.int64)
        order[slot] = np.arange(len(slot))
        arrays = [sizes, words, h[order, 1], pdf["n_docs"].to_numpy(dtype="<i8")[order], pdf["owner"].to_numpy(dtype="<i8")[order]]
        return pd.DataFrame([[int(pdf["shard"].iloc[0]), len(h), *(np.ascontiguousarray(x).tobytes() for x in arrays)]], columns=["shard", "n_keys", "sizes", "words", "prints", "counts", "owners"])

    schema = "shard int, n_keys long, sizes binary, words binary, prints binary, counts binary, owners binary"
    return frequent.withColumn("shard", _shard_of(F.col("h1"), n_shards)).groupBy("shard").applyInPandas(build, schema)


def _shard_of(h1, n_shards: int):
    """The unsigned hash modulo the number of shards."""
    return F.pmod(F.pmod(h1, F.lit(n_shards)) + F.when(h1 < 0, F.lit(2**64 % n_shards)).otherwise(F.lit(0)), F.lit(n_shards)).cast("int")


def _without(text, dropped: list[bool]) -> str:
    return "\n".join([x for x, gone in zip((text or "").split("\n"), dropped, strict=True) if not gone])


def drop_repeated_lines(documents: DataFrame, min_chars: int = 20, min_docs: int = 3, broadcast_upto: int = BROADCAST_UPTO, keep: list[str] | None = None) -> DataFrame:
    """Every row as (doc_id or ``keep``, n_lines, n_dropped, text): its text without lines that many documents hold.

    Texts are split at line feeds. A line's key is the line without ASCII blanks at both ends and with A-Z lower-cased. Keys of at
    least ``min_chars`` code points that ``min_docs`` documents or more hold lose their lines, except in the largest doc_id
    that holds them, where all stay. Null and empty texts are one empty line. Rows are documents: those that repeat an id count
    each, and all of the largest id keep the line. A null id is smaller than every other; a line that only rows with null ids hold stays.
    Columns that aren't kept are dropped, clashing names don't matter.

    Hashes of the frequent lines are indexed by a minimal perfect hash in shards, lines that decide nothing are told from
    them by 64-bit fingerprints. Up to ``broadcast_upto`` bytes of arrays (24 a key) are broadcast and probed in one map over the documents.
    Beyond it the documents' line hashes go to the shards, those of frequent shards dealt out among several tasks
    with a copy of the arrays each, and the hashes of lines to drop come back by (id, digest of the text).
    """
    keep = ["doc_id"] if keep is None else keep
    counts = cut(line_counts(documents, min_chars).filter(F.col("n_docs") >= min_docs))
    n = counts.count()
    n_shards = max(1, -(-n // SHARD_KEYS))
    index = build_index(counts, n_shards)
    rows = documents.select(*[F.col(c) for c in keep], F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    if n * KEY_BYTES <= broadcast_upto:
        return _probe_broadcast(rows, keep, index, n_shards, min_chars)
    return _probe_shards(rows, keep, cut(index), n_shards, counts, min_chars)


def _probe_broadcast(rows: DataFrame, keep: list[str], index: DataFrame, n_shards: int, min_chars: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast([r.asDict() for r in index.collect()])
    short_batches(rows.sparkSession)
    schema = with_fields(rows.select(*keep), "n_lines long, n_dropped long, text string")

    def run(batches):
        give_back()
        index = LineIndex(n_shards, shared.value)
        for batch in batches:
            last = batch.num_columns - 1
            for part in pieces_of(batch, [last]):
                ids, texts = part.column(last - 1).to_pylist(), part.column(last).to_pylist()
                lines = [line_digests(t, min_chars) for t in texts]
                size = np.array([len(x) for x in lines], dtype=np.int64)
                of = np.repeat(np.array([NOBODY if i is None else i for i in ids], dtype=np.int64), size)
                flat = [d for x in lines for d in x]
                long = np.array([d is not None for d in flat], dtype=bool)
                slot = index.find(words_of([d for d in flat if d is not None]))
                gone = np.zeros(len(flat), dtype=bool)
                if len(index.owners):
                    gone[long] = (slot >= 0) & (index.owners[slot] != of[long])
                ends = np.cumsum(size)
                dropped = np.add.reduceat(gone.astype(np.int64), ends - size) if len(size) else size
                text = [(t or "") if not k else _without(t, gone[e - s : e].tolist()) for t, s, e, k in zip(texts, size, ends, dropped.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(size), pa.array(dropped), pa.array(text, pa.string())], names=schema.names)
            give_back()

    return rows.mapInArrow(run, schema)


def _probe_shards(rows: DataFrame, keep: list[str], index: DataFrame, n_shards: int, counts: DataFrame, min_chars: int) -> DataFrame:
    rows = rows.withColumn("_hash", text_hash())

    def make():
        def work(texts):
            at, h = [], []
            for i, t in enumerate(texts):
                found = list(set(line_digests(t, min_chars)) - {None})
                at += [i] * len(found)
                h += found
            h = words_of(h).view("<i8")
            return at, [h[:, 0], h[:, 1]]

        return work

    lines = map_texts(rows, make, "h1 long, h2 long", keep=["_id", "_hash"], many=True).withColumn("shard", _shard_of(F.col("h1"), n_shards))
    # Lines a shard's keys occur in, known from the counts, and an even share of the lines of other keys.
    total = lines.count()
    weight = counts.groupBy(_shard_of(F.col("h1"), n_shards).alias("shard")).agg(F.sum("n_docs").alias("n"))
    weight = weight.select("shard", F.ceil((F.col("n") + F.lit(total // n_shards)) / F.lit(PROBES)).cast("int").alias("salts"))
    salted = lines.join(F.broadcast(weight), "shard").withColumn("salt", F.pmod(F.xxhash64("_id", "_hash"), F.col("salts")))
    arrays = index.join(F.broadcast(weight), "shard").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1)))

    def probe(asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        part = LineIndex(n_shards, shard.to_dict("records"))
        slot = part.find(np.ascontiguousarray(asked[["h1", "h2"]].to_numpy(dtype=np.int64)).view("<u8"))
        return asked.loc[(slot >= 0) & (part.owners[slot] != asked["_id"].to_numpy()), ["_id", "_hash", "h1", "h2"]]

    asked = salted.select("shard", "salt", F.coalesce("_id", F.lit(NOBODY)).alias("_id"), "_hash", "h1", "h2")
    gone = asked.groupBy("shard", "salt").cogroup(arrays.groupBy("shard", "salt")).applyInPandas(probe, "_id long, _hash long, h1 long, h2 long")
    gone = gone.groupBy("_id", "_hash").agg(F.collect_set(F.struct("h1", "h2")).alias("_gone"))
    joined = rows.withColumn("_key", F.coalesce("_id", F.lit(NOBODY))).join(gone.withColumnRenamed("_id", "_key"), ["_key", "_hash"], "left")
    joined = joined.select(*keep, "_gone", "text")
    schema = with_fields(rows.select(*keep), "n_lines long, n_dropped long, text string")
    short_batches(rows.sparkSession)

    def run(batches):
        give_back()
        for batch in batches:
            last = batch.num_columns - 1
            for part in pieces_of(batch, [last]):
                size, n, out = [], [], []
                for t, gone in zip(part.column(last).to_pylist(), part.column(last - 1).to_pylist(), strict=True):
                    lines = line_digests(t, min_chars)
                    away = {np.array([g["h1"], g["h2"]], dtype="<i8").tobytes() for g in gone or ()}
                    dropped = [d in away for d in lines]
                    size.append(len(lines))
                    n.append(sum(dropped))
                    out.append(_without(t, dropped))
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(out, pa.string())], names=schema.names)
            give_back()

    return joined.mapInArrow(run, schema)
