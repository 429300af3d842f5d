"""Cross-tokenizer alignment: which tokens of two tokenizers share bytes, by arrays of every byte's owners."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.llm.common import cut, give_back, pieces_of, short_batches, utf8, with_fields
from ostinato.llm.sentencepieces import MODEL, bytes_of, read_model

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: how the byte-level vocabulary splits text before merging bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PART = 1 << 20  # bytes of text aligned at once
HOT_PAIRS = 1_500_000  # pairs whose counts are broadcast (17 bytes each)


def byte_values() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def read_byte_level(path: str = BYTE_LEVEL) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary, without its special tokens.

    Only vocabularies whose ids follow the order of their merges are taken, so that a token's rank is its id; others raise ValueError.
    """
    file = json.loads(Path(path).read_text(encoding="utf-8"))
    vocabulary, of = file["model"]["vocab"], byte_values()
    special = {t["id"] for t in file["added_tokens"]}
    merges = [m.split(" ") if isinstance(m, str) else m for m in file["model"]["merges"]]
    made = [vocabulary[a + b] for a, b in merges]
    tokens = sorted((i, bytes(map(of.__getitem__, t))) for t, i in vocabulary.items() if i not in special)
    if [i for i, _ in tokens] != list(range(len(tokens))) or made != sorted(made) or len(made) + 256 != len(tokens):
        raise ValueError("ids of the byte-level vocabulary don't follow its merges")
    return [t for _, t in tokens]


class Aligner:
    """Encodes texts both ways and links the tokens that share bytes."""

    def __init__(self, byte_level: list[bytes], model: bytes, pieces: list[bytes]):
        import sentencepiece
        import tiktoken

        self.a = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(byte_level)}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bytes_a, self.bytes_b = byte_level, pieces
        self.size_a, self.size_b = (np.array([len(t) for t in x], dtype=np.int32) for x in (byte_level, pieces))
        self.top = max(len(byte_level), len(pieces))
        # A token's text in the list of groups, by what stands before it.
        self.shown = [f"{mark}{i}" for mark in ";,|" for i in range(self.top)]

    def encode(self, texts: list) -> list[tuple[list[int], list[int]]]:
        """Ids of a space and the text by both; none where a text is null or empty or the tokens' bytes differ from its own."""
        second = self.b.encode([t or "" for t in texts], num_threads=1)
        out = []
        for t, b in zip(texts, second, strict=True):
            whole = utf8(" " + t) if t else b""
            a = self.a.encode_ordinary(" " + t) if t else []
            same = t and b"".join([self.bytes_b[i] for i in b]) == whole and b"".join([self.bytes_a[i] for i in a]) == whole
            out.append((a, b) if same else ([], []))
        return out

    def align(self, texts: list):
        """Columns n_a, n_b, n_groups, n_links, groups, and the distinct linked pairs with their links as flat arrays and offsets."""
        ids = self.encode(texts)
        n_a, n_b = (np.array([len(x[k]) for x in ids], dtype=np.int64) for k in (0, 1))
        a, b = (np.array([i for x in ids for i in x[k]], dtype=np.int64) for k in (0, 1))
        own_a = np.repeat(np.arange(len(a), dtype=np.int32), self.size_a[a])
        own_b = np.repeat(np.arange(len(b), dtype=np.int32), self.size_b[b])
        turn_a, turn_b = (np.append(True, x[1:] != x[:-1])[: len(x)] for x in (own_a, own_b))
        at = np.flatnonzero(turn_a | turn_b)  # each begins a pair of owners that overlap
        link_a, link_b, cut_here, first_a, first_b = own_a[at], own_b[at], (turn_a & turn_b)[at], turn_a[at], turn_b[at]
        group = np.cumsum(cut_here)
        group_a, group_b = group[first_a], group[first_b]
        doc = np.repeat(np.arange(len(ids)), n_a)[link_a]
        n_links = np.bincount(doc, minlength=len(ids))
        n_groups = np.bincount(doc[cut_here], minlength=len(ids))
        lead_a, lead_b = (np.append(True, x[1:] != x[:-1])[: len(x)] for x in (group_a, group_b))
        token = np.concatenate([np.where(lead_a, 0, self.top) + a, np.where(lead_b, 2 * self.top, self.top) + b])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        words = list(map(self.shown.__getitem__, token[order].tolist()))
        ends = np.cumsum(n_a + n_b).tolist()
        groups = ["".join(words[s:e])[1:] for s, e in zip([0, *ends[:-1]], ends, strict=True)]
        wide = len(self.bytes_a) * len(self.bytes_b)
        key, times = np.unique(doc * wide + a[link_a] * len(self.bytes_b) + b[link_b], return_counts=True)
        pairs = key % wide
        pairs = (pairs // len(self.bytes_b)) << 32 | pairs % len(self.bytes_b)
        offset = np.append(0, np.cumsum(np.bincount(key // wide, minlength=len(ids)))).astype(np.int32)
        return n_a, n_b, n_groups, n_links, groups, offset, pairs, times.astype(np.int32)


def align(documents: DataFrame, byte_level: str = BYTE_LEVEL, model: str = MODEL, keep: list[str] | None = None) -> DataFrame:
    """Every row as (doc_id or ``keep``, n_a, n_b, n_groups, n_links, groups, pairs, times).

    A is the byte-level tokenizer over a space and the text, B the piece model over the text, to which it adds the space;
    the strings of special tokens are ordinary text. Bytes where tokens of both end cut the tokens into groups, written
    ``a1,a2|b1;a3|b2,b3``. A link is a pair of an A and a B token that share a byte; ``pairs`` are the distinct linked ids (a << 32 | b, ascending),
    ``times`` their links. Null and empty texts, and those whose tokens' bytes aren't the text's (a literal U+2581), have none: zeros, an empty
    string and empty lists. Repeated rows stay repeated, null ids stay null, columns that aren't kept are dropped. One map over the scan, a megabyte of text at once.
    """
    short_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast((read_byte_level(byte_level), Path(model).read_bytes(), bytes_of(read_model(model))))
    rows = documents.select(*(keep or [F.col("doc_id").cast("long").alias("doc_id")]), F.col("text").cast("string").alias("_text"))
    schema = with_fields(rows.drop("_text"), "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>")

    def run(batches):
        give_back()
        aligner = Aligner(*shared.value)
        for batch in batches:
            last = batch.num_columns - 1
            for part in pieces_of(batch, [last], PART):
                *counts, groups, offset, pairs, times = aligner.align(part.column(last).to_pylist())
                lists = [pa.ListArray.from_arrays(offset, pa.array(x)) for x in (pairs, times)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *map(pa.array, counts), pa.array(groups, pa.string()), *lists], names=schema.names)
            give_back()

    return rows.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n_docs, best): how many rows hold each pair of ids linked, and whether that is its A id's highest count."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs"))
    top = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n_docs").alias("top"))
    counts = counts.withColumn("a", F.shiftright("pair", 32)).join(top, "a")
    return counts.select("pair", "n_docs", (F.col("n_docs") == F.col("top")).alias("best"))


def score_links(aligned: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``aligned``, which should be stored, with n_best and count_sum in place of pairs and times.

    ``n_best`` counts the links whose pair has its A id's highest count, ties included; ``count_sum`` adds their pairs' counts.
    The ``hot_pairs`` commonest pairs are broadcast; links of further ones are joined by a shuffle, where no pair is frequent.
    """
    spark = aligned.sparkSession
    counts = cut(pair_counts(aligned))
    n = counts.count()
    hot = counts if n <= hot_pairs else counts.orderBy(F.desc("n_docs"), "pair").limit(hot_pairs)
    hot = hot.toArrow().sort_by("pair")
    shared = spark.sparkContext.broadcast([hot.column(c).to_numpy() for c in ("pair", "n_docs", "best")])
    given = [c for c in aligned.columns if c not in ("pairs", "times")]
    rows = aligned.withColumn("_row", F.monotonically_increasing_id())
    schema = with_fields(rows.select(*given, "_row"), "n_best long, count_sum long, _pairs array<long>, _times array<int>")
    place, lists = len(given) + 1, ("pairs", "times")

    def run(batches):
        pair, docs, best = shared.value
        for batch in batches:
            size = batch.column(place).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            asked, times = (batch.column(place + k).flatten().to_numpy(zero_copy_only=False) for k in (0, 1))
            of = np.repeat(np.arange(len(size)), size)
            at = np.minimum(np.searchsorted(pair, asked), max(0, len(pair) - 1))
            met = pair[at] == asked if len(pair) else np.zeros(len(asked), dtype=bool)
            n_best, total = np.zeros(len(size), dtype=np.int64), np.zeros(len(size), dtype=np.int64)
            np.add.at(n_best, of[met], np.where(best[at[met]], times[met], 0))
            np.add.at(total, of[met], times[met] * docs[at[met]])
            offset = np.append(0, np.cumsum(np.bincount(of[~met], minlength=len(size)))).astype(np.int32)
            rest = [pa.ListArray.from_arrays(offset, pa.array(x[~met])) for x in (asked, times)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], pa.array(n_best), pa.array(total), *rest], names=schema.names)

    out = rows.select(*given, "_row", *lists).mapInArrow(run, schema)
    if n <= hot_pairs:
        return out.drop("_row", "_pairs", "_times")
    out = cut(out)
    cold = out.select("_row", F.explode(F.arrays_zip("_pairs", "_times")).alias("x")).select("_row", F.col("x._pairs").alias("pair"), F.col("x._times").alias("times"))
    cold = cold.join(counts, "pair").groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n_docs")).alias("_sum"))
    out = out.drop("_pairs", "_times").join(cold, "_row", "left")
    more = {"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))}
    return out.withColumns(more).drop("_row", "_best", "_sum")
