"""Benchmark decontamination: pigeonhole pieces, exact hits, and Myers' bit-parallel edit distance."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.llm.common import WORD_TABLE, map_texts

#: Folds and splits as WORD_TABLE, for texts that are lower-cased as a whole before.
BLOCK_BYTES = 32 << 20  # benchmark text that one pass over the documents looks for


def words_of(text) -> list[bytes]:
    """Words of a text: lower-cased in every script, split at ASCII characters other than digits and letters."""
    return text.lower().encode("utf-8", "replace").translate(WORD_TABLE).split() if isinstance(text, str) else []


def best_match(pattern: list, text: list, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the place in ``text`` that ends first among those with the least edit distance
    to ``pattern``, if it is at most ``budget``; Myers' recurrence, with a bit for each item of the pattern."""
    m = len(pattern)
    where: dict = {}
    for i, w in enumerate(pattern):
        where[w] = where.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, distance, best = full, 0, m, None
    for j, w in enumerate(text):
        eq = where.get(w, 0)
        x = eq | down
        d0 = ((((x & up) + up) ^ up) | x) & full
        hp = down | ~(d0 | up) & full
        hn = up & d0
        if hp & top:
            distance += 1
        elif hn & top:
            distance -= 1
        hp, hn = hp << 1 & full, hn << 1 & full
        up = (hn | ~(d0 | hp)) & full
        down = d0 & hp
        if distance <= budget and (best is None or distance < best[0]):
            best = (distance, j + 1)
            if distance == 0:
                break
    return best


class PieceIndex:
    """The benchmark items' pieces: budget + 1 runs of words each, of which a match within the budget
    keeps at least one whole."""

    def __init__(self, items: list[tuple[int, list[bytes]]], error_share: float):
        self.items, self.budget = items, []
        self.pieces: dict[int, dict[tuple, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for k, (_, words) in enumerate(items):
            n = len(words)
            budget = int(n * error_share)
            self.budget.append(budget)
            for p in range(budget + 1):
                a, b = n * p // (budget + 1), n * (p + 1) // (budget + 1)
                self.pieces[b - a][tuple(words[a:b])].append((k, a))
        # Documents are walked once; a word that begins no piece costs one look-up.
        self.first: dict[bytes, list[tuple[int, dict]]] = {}
        for n, same in sorted(self.pieces.items()):
            for piece in same:
                known = self.first.setdefault(piece[0], [])
                if not known or known[-1][0] != n:
                    known.append((n, same))

    def search(self, words: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) for every item found in a document, at its best place."""
        first = self.first
        if first.keys().isdisjoint(words):
            return []
        spans: dict[int, list[list[int]]] = defaultdict(list)
        for i, w in enumerate(words):
            known = first.get(w)
            if known is None:
                continue
            for n, same in known:
                for k, a in same.get(tuple(words[i : i + n]), ()):
                    size, budget = len(self.items[k][1]), self.budget[k]
                    lo, hi = max(0, i - a - budget), min(len(words), i - a + size + budget)
                    if spans[k] and lo <= spans[k][-1][1] and spans[k][-1][0] <= hi:
                        spans[k][-1][0], spans[k][-1][1] = min(spans[k][-1][0], lo), max(spans[k][-1][1], hi)
                    else:
                        spans[k].append([lo, hi])
        out = []
        for k, windows in spans.items():
            pattern, best = self.items[k][1], None
            for lo, hi in windows:
                got = best_match(pattern, words[lo:hi], self.budget[k])
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], lo, lo + got[1])
                    if got[0] == 0:
                        break
            if best:
                distance, lo, end = best
                # The start: the same search backwards from the end.
                back = best_match(pattern[::-1], words[lo:end][::-1], distance)
                out.append((k, distance, end - back[1], end))
        return sorted(out)


def _blocks(benchmark: DataFrame, min_words: int):
    """Benchmark items in lists of bounded bytes, in order of id; each list is collected on its own."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    share = items.withColumn("n", F.octet_length("text"))
    total = share.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_blocks = -(-total // BLOCK_BYTES)
    for b in range(n_blocks):
        got = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == b).distinct().collect()
        words = sorted((r["item_id"], words_of(r["text"])) for r in got)
        yield [(i, w) for i, w in words if len(w) >= min_words]


def find(documents: DataFrame, benchmark: DataFrame, error_share: float = 0.2, min_words: int = 5, keep: list[str] | None = None) -> DataFrame:
    """Every pair of a document and a benchmark item that it contains within the item's error budget.

    Returns ``keep`` (doc_id by default), item_id, distance (least number of inserted, deleted or replaced words),
    budget (``error_share`` of the item's words, rounded down), start and end (the best place's words, from 0;
    the first among equals). Several item rows with one id are looked for each, and the best one counts.

    A document's row, however long, is handled whole; repeated document rows repeat their pairs. Null
    and empty documents contain nothing; items that are null or of fewer than ``min_words`` words would
    match anywhere and are not looked for (set it to 1 to look for all). The benchmark is taken in blocks of about
    32 MB, each broadcast for one map over the documents, without a shuffle.
    """
    fields = "item_id long, distance int, budget int, start long, end long"
    spark, parts = documents.sparkSession, []
    for items in _blocks(benchmark, min_words):
        shared = spark.sparkContext.broadcast(items)

        def make(shared=shared):
            index = PieceIndex(shared.value, error_share)

            def run(texts):
                at, rows = [], []
                for i, text in enumerate(texts):
                    best: dict[int, tuple] = {}
                    for k, distance, a, b in index.search(words_of(text)):
                        row = (index.items[k][0], distance, index.budget[k], a, b)
                        if row[0] not in best or distance < best[row[0]][1]:
                            best[row[0]] = row
                    rows += best.values()
                    at += [i] * len(best)
                return at, list(zip(*rows, strict=True)) or [[]] * 5

            return run

        parts.append(map_texts(documents, make, fields, keep, many=True))
    if not parts:
        return map_texts(documents.limit(0), lambda: lambda texts: ([], [[]] * 5), fields, keep, many=True)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
