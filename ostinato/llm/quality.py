"""Quality by a regularised quadratic discriminant over transformed statistics of whole texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ostinato.llm.common import give_back, labelled_sample, map_texts, utf8

_NOT = {
    "upper": bytes(c for c in range(256) if not 65 <= c <= 90),
    "lower": bytes(c for c in range(256) if not 97 <= c <= 122),
    "digit": bytes(c for c in range(256) if not 48 <= c <= 57),
    "stop": bytes(c for c in range(256) if c not in b".,;:?"),
    "shout": bytes(c for c in range(256) if c != 33),
    "symbol": bytes(c for c in range(256) if c not in b"#$%&*@^~+=<>_\\{}[]/"),
    "bar": bytes(c for c in range(256) if c != 124),
    "line": bytes(c for c in range(256) if c != 10),
}
FEATURES = [
    "log_words", "word_length", "word_spread", "distinct_words", "top_word", "line_words", "repeated_lines",
    "upper", "lower", "digit", "stop", "shout", "symbol", "bar", "shout_words",
]


def features(text) -> np.ndarray:
    """Statistics of a whole text, each transformed towards a normal shape (logs and square roots).

    Null and empty texts give those of a text without words: zeros.
    """
    raw = utf8(text)
    words = raw.split()
    if not words:
        return np.zeros(len(FEATURES))
    n, size = len(words), len(raw)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    part = {k: len(raw.translate(None, delete=v)) / size for k, v in _NOT.items()}
    return np.array(
        [
            np.log1p(n),
            np.log(lengths.mean()),
            np.log1p(lengths.std()),
            np.log(len(counts) / n) / np.log1p(n),
            np.sqrt(max(counts.values()) / n),
            np.log(n / len(lines)),
            np.sqrt(1 - len(set(lines)) / len(lines)),
            *(np.sqrt(part[k]) for k in ("upper", "lower", "digit", "stop", "shout", "symbol", "bar")),
            np.sqrt(sum(k for w, k in counts.items() if w[-1] in b"!#$%&*|") / n),
        ]
    )


class QualityModel:
    """Means, Cholesky factors and log determinants of both classes, computed once and cached here."""

    def __init__(self, center, scale, means, factors, log_dets, log_prior):
        self.center, self.scale, self.means = center, scale, means
        self.factors, self.log_dets, self.log_prior = factors, log_dets, log_prior

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1 from the difference of Mahalanobis log densities."""
        z = (x - self.center) / self.scale
        log_density = [
            -0.5 * (np.square(np.linalg.solve(f, (z - m).T)).sum(axis=0) + d)
            for m, f, d in zip(self.means, self.factors, self.log_dets, strict=True)
        ]
        return 1 / (1 + np.exp(-np.clip(log_density[1] - log_density[0] + self.log_prior, -500, 500)))


def train(x: np.ndarray, y: np.ndarray, shrink: float = 0.1, pool: float = 0.1) -> QualityModel | None:
    """Class covariances drawn ``pool`` of the way to the pooled one, then ``shrink`` of the way to a
    multiple of the identity, and more where a class has few rows. Null unless both classes occur."""
    if len(set(y.tolist())) < 2:
        return None
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z, d = (x - center) / scale, x.shape[1]
    own = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    n = [int((y == k).sum()) for k in (0, 1)]
    pooled = (own[0] * n[0] + own[1] * n[1]) / sum(n)
    factors, log_dets = [], []
    for k in (0, 1):
        p = max(pool, d / (d + n[k]))
        s = (1 - p) * own[k] + p * pooled
        s = (1 - shrink) * s + shrink * (np.trace(s) / d + 1e-3) * np.eye(d)
        factors.append(np.linalg.cholesky(s))
        log_dets.append(2 * np.log(np.diag(factors[-1])).sum())
    return QualityModel(center, scale, [z[y == k].mean(axis=0) for k in (0, 1)], factors, log_dets, np.log(n[1] / n[0]))


def fit(documents: DataFrame, labels: DataFrame, n_folds: int = 3, held_out: int = 1, limit: int = 20000) -> QualityModel | None:
    """Learn from at most ``limit`` labelled documents outside the held-out fold; each sends its
    statistics alone to the driver. Null if both labels don't occur."""

    def stats(batches):
        for pdf in batches:
            yield pd.DataFrame({"y": pdf["y"], "x": [features(t) for t in pdf["text"]]}, dtype=object)

    sample = labelled_sample(documents, labels, "quality", n_folds, held_out, limit).select("y", "text")
    got = sample.mapInPandas(stats, "y int, x array<double>").toPandas()
    model = train(np.stack(got["x"]), got["y"].to_numpy(dtype=np.int64)) if len(got) else None
    del got
    give_back()
    return model


def score(documents: DataFrame, model: QualityModel | None, keep: list[str] | None = None) -> DataFrame:
    """Every row of ``documents`` as its ``keep`` columns (doc_id by default), score and predicted (1 if score >= 0.5).

    Null and empty texts are scored as texts without words; when nothing could be learned every
    score is 0.5. Columns that are not kept are dropped, so clashing names do no harm; repeated rows
    stay repeated. One map over the scan, no shuffle.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def run(texts):
            s = np.full(len(texts), 0.5)
            if m is not None and texts:
                s = m.score(np.stack([features(t) for t in texts]))
            return [s, (s >= 0.5).astype(np.int32)]

        return run

    return map_texts(documents, make, "score double, predicted int", keep)
