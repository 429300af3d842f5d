"""Token counts from an exact histogram of encoded lengths and its suffix sums."""

from __future__ import annotations

import base64
from collections import Counter
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ostinato.llm.common import cut, short_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this public vocabulary splits text before merging bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BLOCK = 4096  # lengths whose running sums one task makes

_encoding = {}


def _encoder(ranks_file: bytes, pattern: str):
    key = (len(ranks_file), hash(ranks_file), pattern)
    if key not in _encoding:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
        _encoding.clear()
        _encoding[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoding[key]


def length_histogram(documents: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(length, n_docs): how many rows encode to each number of tokens.

    Whole texts are encoded; null and empty texts have length 0; repeated rows count each time; the
    texts of special tokens are ordinary text. Counts are summed per batch before the shuffle.
    """
    short_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast((Path(vocabulary).read_bytes(), pattern))

    def run(batches):
        encode = _encoder(*shared.value).encode_ordinary
        for pdf in batches:
            n = Counter(len(encode(t)) if isinstance(t, str) else 0 for t in pdf["text"])
            yield pd.DataFrame({"length": list(n), "n": list(n.values())}, dtype="int64")

    return documents.select("text").mapInPandas(run, "length long, n long").groupBy("length").agg(F.sum("n").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For every length L of a histogram, what a context limit of L keeps.

    Returns length, n_docs, docs_le and docs_ge (documents no longer and no shorter), total_tokens
    (of all documents), tokens_le (of documents no longer) and truncated_total (every document cut
    to L tokens). Sums run over blocks of 4,096 lengths, then over the few block totals, so no task holds the
    whole histogram. An empty histogram gives no rows. The histogram is used twice, so it is stored first: texts
    are encoded once.
    """
    h = cut(histogram).select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"), F.expr(f"length div {_BLOCK}").alias("block"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d0"),
        F.coalesce(F.sum("t").over(before), F.lit(0)).alias("t0"),
        F.sum("d").over(everything).alias("all_docs"),
        F.sum("t").over(everything).alias("total_tokens"),
    )
    upto = Window.partitionBy("block").orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumns({"d": F.sum("n_docs").over(upto), "t": F.sum("tokens").over(upto)}).join(blocks, "block")
    h = h.withColumns({"docs_le": F.col("d0") + F.col("d"), "tokens_le": F.col("t0") + F.col("t")})
    return h.select(
        "length",
        "n_docs",
        "docs_le",
        (F.col("all_docs") - F.col("docs_le") + F.col("n_docs")).alias("docs_ge"),
        "total_tokens",
        "tokens_le",
        (F.col("tokens_le") + F.col("length") * (F.col("all_docs") - F.col("docs_le"))).alias("truncated_total"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Totals at any context limits, from the suffix sums: one row for each distinct limit.

    Between two lengths the truncated total is linear, so the longest length up to the limit answers
    it: docs_over documents are longer and each adds the limit. Limits are a short list.
    """
    wanted = sorted({int(x) for x in limits if x >= 0})
    fits = sums.withColumn("context", F.explode(F.array(*[F.lit(x).cast("long") for x in wanted]))).groupBy("context")
    below = F.col("length") <= F.col("context")
    fits = fits.agg(
        F.coalesce(F.max(F.when(below, F.col("docs_le"))), F.lit(0)).alias("docs_fit"),
        F.coalesce(F.max(F.when(below, F.col("tokens_le"))), F.lit(0)).alias("tokens_fit"),
        F.max("docs_le").alias("n_docs"),
        F.max("total_tokens").alias("total_tokens"),
    )
    over = F.col("n_docs") - F.col("docs_fit")
    return fits.select("context", "n_docs", "total_tokens", over.alias("docs_over"), (F.col("tokens_fit") + F.col("context") * over).alias("truncated_total"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the smallest length that at least this share of documents doesn't exceed."""
    n = F.col("docs_le") + F.col("docs_ge") - F.col("n_docs")
    picks = [F.min(F.when(F.col("docs_le") >= F.ceil(F.lit(float(s)) * n), F.col("length"))).alias(f"q{i}") for i, s in enumerate(shares)]
    row = sums.agg(*picks)
    return row.select(F.explode(F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"q{i}").alias("length")) for i, s in enumerate(shares)])).alias("x")).select("x.*")
