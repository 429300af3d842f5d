"""Language identification by error-correcting output codes over hashed letter n-grams."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ostinato.llm.common import few_of_each, fold, give_back, map_texts, short_batches

DIMS = 4096
UNKNOWN = "und"
_LETTER_RUNS = re.compile(r"[^\W\d_]+")
#: Signs such as fractions, superscripts and Roman numerals: word characters for ``re``, but no letters.
_NUMBER_SIGNS = frozenset(c for c in map(chr, range(0x110000)) if c.isnumeric() and not c.isalpha() and not c.isdecimal())
_BLANKED = dict.fromkeys(map(ord, _NUMBER_SIGNS), " ")
_BLOCK = 1 << 20  # letters handled at once: bounds memory on very long texts


def gram_counts(text) -> np.ndarray | None:
    """Hashed counts of letter 1-, 2- and 3-grams of a whole text; null if it has no letters.

    Letters are lower-cased; runs of letters are separated by one space, which takes part in grams.
    """
    if not isinstance(text, str):
        return None
    low = text.lower()
    if not (low.isascii() or _NUMBER_SIGNS.isdisjoint(low)):
        low = low.translate(_BLANKED)
    runs = _LETTER_RUNS.findall(low)
    if not runs:
        return None
    code = np.frombuffer((" " + " ".join(runs) + " ").encode("utf-32-le", "replace"), dtype=np.uint32)
    total = np.zeros(DIMS, dtype=np.int64)
    for at in range(0, len(code), _BLOCK):
        c = code[max(0, at - 2) : at + _BLOCK]
        skip = min(at, 2)  # grams that end before this block were counted with the last one
        two = c[:-1] * np.uint32(0x9E3779B1) ^ c[1:] * np.uint32(0x85EBCA6B)
        three = two[:-1] * np.uint32(0xC2B2AE35) ^ c[2:] * np.uint32(0x27D4EB2F)
        for g in ((c * np.uint32(0x2545F491))[skip:], two[max(0, skip - 1) :], three):
            total += np.bincount(g >> np.uint32(20), minlength=DIMS)
    return total


def features(text) -> np.ndarray | None:
    """Unit vector of the square roots of the gram counts."""
    n = gram_counts(text)
    if n is None:
        return None
    x = np.sqrt(n)
    return x / np.sqrt(n.sum())


def distance(code: np.ndarray) -> int:
    """The smallest Hamming distance between two codewords."""
    bits = code.shape[1]
    agree = code.astype(np.float32) @ code.T.astype(np.float32)
    np.fill_diagonal(agree, -bits)
    return int(round((bits - agree.max()) / 2))


def codewords(k: int, bits: int | None = None, seed: int = 11) -> np.ndarray:
    """A (k, bits) matrix of +1 and -1 whose rows lie far apart and whose columns all split the rows.

    The best of many random matrices by the smallest Hamming distance between rows; a column that
    doesn't split them has one of its entries turned. Without ``bits`` there are 15, or as many more (by fives) as
    bring that distance to 5, so that two wrong bits can be corrected whatever the number of languages.
    """
    if bits is None:
        bits = 15
        while k > 1 and distance(code := codewords(k, bits, seed)) < 5:
            bits += 5
        return code if k > 1 else codewords(k, bits, seed)
    rng = np.random.default_rng(seed)
    best, score = np.ones((k, bits), dtype=np.int8), -1
    for _ in range(200 if 1 < k <= 64 else 10 if k > 1 else 0):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), size=(k, bits))
        flat = np.flatnonzero((code == code[0]).all(axis=0))
        code[rng.integers(0, k, len(flat)), flat] *= -1
        far = distance(code)
        if far > score:
            best, score = code, far
    return best


class LanguageModel:
    """Codewords, one linear classifier per bit and each classifier's weight in decoding."""

    def __init__(self, languages, code, weights, bias, trust):
        self.languages, self.code, self.weights, self.bias, self.trust = languages, code, weights, bias, trust

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language, its score, whether ambiguous) for rows of features.

        Loss-weighted decoding: a language's loss is the mean over bits of exp(-bit * margin), each
        bit weighted by its classifier's accuracy in fitting. The score is the softmax of negated
        losses; a row is ambiguous if the runner-up's loss is within a tenth of a bit's loss.
        """
        margin = np.clip(x @ self.weights + self.bias, -4, 4)
        loss = (np.exp(-margin[:, None, :] * self.code[None]) * self.trust).sum(axis=2) / self.trust.sum()
        soft = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
        soft /= soft.sum(axis=1, keepdims=True)
        ordered = np.sort(loss, axis=1)
        near = ordered[:, 1] - ordered[:, 0] < 0.1 if loss.shape[1] > 1 else np.zeros(len(loss), dtype=bool)
        return loss.argmin(axis=1), soft.max(axis=1), near


def _sample_features(batches):
    for pdf in batches:
        rows = []
        for y, t in zip(pdf["lang"], pdf["text"], strict=True):
            n = gram_counts(t)
            if n is not None:
                at = np.flatnonzero(n)
                rows.append((y, at.astype(np.int32), n[at].astype(np.float32)))
        yield pd.DataFrame({c: [r[i] for r in rows] for i, c in enumerate(("lang", "at", "n"))}, dtype=object)
    give_back()


def fit(documents: DataFrame, n_folds: int = 5, held_out: int = 0, per_language: int = 600, bits: int | None = None) -> LanguageModel | None:
    """Learn from documents with a language outside the held-out fold; null if there are none.

    About ``per_language`` documents of each language are drawn, those whose hashed id lies below a
    threshold set from the language's count, at most four rows an id, and each sends at most DIMS counts to the driver: the
    bound is about languages * per_language * DIMS * 8 bytes. The ridge system solved there has the
    smaller of the sample's size and DIMS as its order.
    """
    short_batches(documents.sparkSession)
    rows = documents.select("doc_id", "lang", "text").filter("lang is not null and text is not null")
    rows = rows.filter(F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), n_folds) != held_out))
    rows = rows.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    draw = F.broadcast(sizes.select("lang", (F.lit(float(1 << 30)) * per_language / F.col("n")).alias("below")))
    sample = few_of_each(rows.join(draw, "lang").filter("h < below"), ["doc_id", "lang"]).select("lang", "text")
    got = sample.mapInPandas(_sample_features, "lang string, at array<int>, n array<float>").toPandas()
    if not len(got):
        return None
    languages = sorted(got["lang"].unique())
    y = got["lang"].map({v: i for i, v in enumerate(languages)}).to_numpy()
    x = np.zeros((len(got), DIMS), dtype=np.float32)
    for i, (at, n) in enumerate(zip(got["at"], map(np.asarray, got["n"]), strict=True)):
        x[i, at] = np.sqrt(n / n.sum())
    ridge = np.float32(1e-2 * len(languages) / len(got))
    del got
    code = codewords(len(languages), bits)
    # One ridge regression on the bits of all codewords; languages weigh alike whatever their counts.
    share = 1.0 / np.bincount(y, minlength=len(languages))[y]
    mean = (share / share.sum()).astype(np.float32) @ x
    x -= mean
    root = np.sqrt(share).astype(np.float32)[:, None]
    t = code[y].astype(np.float32)
    middle = (t * share[:, None]).sum(axis=0) / share.sum()
    z, aim = x * root, ((t - middle) * root).astype(np.float32)
    if len(z) <= DIMS:
        w = z.T @ np.linalg.solve(z @ z.T + ridge * np.eye(len(z), dtype=np.float32), aim)
    else:
        w = np.linalg.solve(z.T @ z + ridge * np.eye(DIMS, dtype=np.float32), z.T @ aim)
    b = middle - mean @ w
    right = ((np.sign(x @ w + middle) == t) * share[:, None]).sum(axis=0) / share.sum()
    del x, z
    give_back()
    return LanguageModel(languages, code, w, b, np.clip(right - 0.5, 0.05, 0.5))


def identify(documents: DataFrame, model: LanguageModel | None, keep: list[str] | None = None) -> DataFrame:
    """Every row of ``documents`` as its ``keep`` columns (doc_id by default), lang_pred, score and ambiguous.

    Null texts and texts without a letter are ``und`` with score 0, as is everything when nothing
    could be learned; equal losses go to the language first in order. Columns that are not kept are
    dropped, so clashing names do no harm; repeated rows stay repeated. One map over the scan, no shuffle.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def run(texts):
            xs = [features(t) if m else None for t in texts]
            has = np.array([x is not None for x in xs], dtype=bool)
            lang, score, near = np.full(len(xs), UNKNOWN, dtype=object), np.zeros(len(xs)), np.zeros(len(xs), dtype=bool)
            if has.any():
                best, s, a = m.decode(np.stack([x for x in xs if x is not None]).astype(np.float32))
                lang[has], score[has], near[has] = np.array(m.languages, dtype=object)[best], s, a
            return [lang, score, near]

        return run

    return map_texts(documents, make, "lang_pred string, score double, ambiguous boolean", keep)
