"""Toxicity by multiple-instance learning: sentence scores joined by noisy-or, learned from document labels."""

from __future__ import annotations

from array import array
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ostinato.llm.common import WORD_TABLE, give_back, labelled_sample, map_texts, utf8

#: As WORD_TABLE, but full stops, question and exclamation marks and line ends become line feeds.
_SENTENCE_TABLE = bytes(10 if c in b".!?\n\r" else WORD_TABLE[c] for c in range(256))
MAX_WORDS = 64  # a longer run of words without an end is cut into sentences of so many words


def sentences(text) -> list[tuple[int, int, list[bytes]]]:
    """(start, end, words) of each sentence of a whole text; start and end are byte offsets of its lines."""
    out, at = [], 0
    for line in utf8(text).translate(_SENTENCE_TABLE).split(b"\n"):
        words = line.split()
        if len(words) <= MAX_WORDS:
            if words:
                out.append((at, at + len(line), words))
        else:
            here = 0
            for i in range(0, len(words), MAX_WORDS):
                part = words[i : i + MAX_WORDS]
                begin = line.find(part[0], here)
                for w in part:
                    here = line.find(w, here) + len(w)
                out.append((at + begin, at + here, part))
        at += len(line) + 1
    return out


class ToxicityModel:
    """A weight for each word that tells the labels apart, and the bias of a sentence's score."""

    def __init__(self, weights: dict[bytes, float], bias: float):
        self.weights, self.bias = weights, bias

    def sentence_scores(self, said) -> np.ndarray:
        """Probability that each sentence offends."""
        get, known = self.weights.get, self.weights.keys()
        z = np.full(len(said), self.bias)
        for i, (_, _, words) in enumerate(said):
            hit = known & set(words)
            if hit:
                z[i] += sum(sorted(map(get, hit)))
        return 1 / (1 + np.exp(-z))


def noisy_or(p: np.ndarray) -> float:
    """Probability that at least one of independent sentences offends."""
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


class _Bags:
    """Documents as lists of their sentences' sets of words, made from strings at each pass: kept, they would take ten times the memory."""

    def __init__(self, said):
        self.said = said

    def __iter__(self):
        for sentences_ in self.said:
            yield [set(s.encode().split()) for s in sentences_]


def _train(bags: list[list[set]], y: np.ndarray, rounds: int, ridge: float, words_kept: int) -> ToxicityModel:
    """Words whose document frequencies differ between labels, weighted by gradient steps on the
    noisy-or likelihood of the document labels."""
    seen = [Counter(), Counter()]
    for bag, label in zip(bags, y, strict=True):
        seen[label].update(set().union(*bag) if bag else ())
    n0, n1 = max(1, int((y == 0).sum())), max(1, int((y == 1).sum()))
    gain = {}
    for w, k in seen[1].items():
        k0 = seen[0].get(w, 0)
        p = (k + k0) / (n0 + n1)
        spread = np.sqrt(p * (1 - p) * (1 / n0 + 1 / n1)) + 1e-9
        if k >= 3 and (z := (k / n1 - k0 / n0) / spread) > 3:
            gain[w] = z
    kept = sorted(gain, key=lambda w: (-gain[w], w))[:words_kept]
    index = {w: i for i, w in enumerate(kept)}
    of_doc = np.repeat(np.arange(len(y)), [len(bag) for bag in bags])
    del seen, gain
    at, word = array("q"), array("q")
    for s, words in enumerate(x for bag in bags for x in bag):
        for w in words & index.keys():
            at.append(s)
            word.append(index[w])
    at, word = (np.frombuffer(x, dtype=np.int64) if x else np.zeros(0, np.int64) for x in (at, word))
    base = max(1e-4, n1 / (n0 + n1)) / max(1.0, len(of_doc) / len(y))
    theta = np.append(np.full(len(kept), 1.0), np.log(base / (1 - min(base, 0.9))))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        z = theta[-1] + np.bincount(at, theta[word], minlength=len(of_doc))
        total = np.bincount(of_doc, np.logaddexp(0, z), minlength=len(y))
        slope = np.where(y == 1, -1 / np.expm1(np.maximum(total, 1e-9)), 1.0)
        g = slope[of_doc] / (1 + np.exp(-z))
        grad = np.append(np.bincount(word, g[at], minlength=len(kept)) + ridge * theta[:-1], g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return ToxicityModel(dict(zip(kept, theta[:-1].tolist(), strict=True)), float(theta[-1]))


def fit(
    documents: DataFrame,
    labels: DataFrame,
    n_folds: int = 5,
    held_out: int = 0,
    limit: int = 8000,
    max_sentences: int = 128,
    rounds: int = 200,
    ridge: float = 0.03,
    words_kept: int = 2000,
) -> ToxicityModel:
    """Learn from at most ``limit`` labelled documents outside the held-out fold.

    The sample holds those of at most ``max_sentences`` sentences, so no more than limit *
    max_sentences * MAX_WORDS words reach the driver; at most ``words_kept`` words get weights, those that tell the
    labels apart best. Scoring has no such bounds. Without labelled
    rows of both labels nothing can be learned and every document scores close to 0.
    """

    def words(batches):
        for pdf in batches:
            said = []
            for y, t in zip(pdf["y"], pdf["text"], strict=True):
                s = sentences(t)
                if len(s) <= max_sentences:
                    said.append((y, [b" ".join(sorted(set(w))).decode("utf-8", "replace") for _, _, w in s]))
            yield pd.DataFrame({"y": [y for y, _ in said], "said": [s for _, s in said]}, dtype=object)
        give_back()

    sample = labelled_sample(documents, labels, "toxic", n_folds, held_out, limit).select("y", "text")
    got = sample.mapInPandas(words, "y int, said array<string>").toPandas()
    y = got["y"].to_numpy(dtype=np.int64)
    if len(set(y)) < 2:
        return ToxicityModel({}, -20.0)
    model = _train(_Bags(got["said"]), y, rounds, ridge, words_kept)
    del got
    give_back()
    return model


def score(documents: DataFrame, model: ToxicityModel, threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """Every row of ``documents`` as its ``keep`` columns, score, predicted and the offending sentences' spans.

    Returns ``keep`` (doc_id by default), score (noisy-or over all sentences of the whole text; null and
    empty texts have no sentence and score 0), predicted (score >= 0.5) and ``offending``, an array of
    (start, end, p) for sentences with p >= ``threshold``, in characters of the text. Columns that are not
    kept are dropped, so clashing names do no harm; repeated rows stay repeated. One map over the
    scan, no shuffle.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def spans(text, said, p):
        found = []
        if (p >= threshold).any():
            raw = utf8(text)
            for i in np.flatnonzero(p >= threshold):
                a = len(raw[: said[i][0]].decode("utf-8", "replace"))
                b = a + len(raw[said[i][0] : said[i][1]].decode("utf-8", "replace"))
                found.append({"start": a, "end": b, "p": float(p[i])})
        return found

    def make():
        m = shared.value

        def run(texts):
            said = [sentences(t) for t in texts]
            p = [m.sentence_scores(x) for x in said]
            s = np.array([noisy_or(x) for x in p], dtype=float)
            return [s, (s >= 0.5).astype(np.int32), [spans(*x) for x in zip(texts, said, p, strict=True)]]

        return run

    fields = "score double, predicted int, offending array<struct<start:int,end:int,p:double>>"
    return map_texts(documents, make, fields, keep)
