"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>) over the terms of a text
that the model knows: words and word starts.  The pair part learns what single weights
cannot say, as when two words are harmless alone and toxic together.  It is linear in the number
of terms: half of (sum v)^2 - sum v^2.

The model is trained on a bounded sample of labelled rows (``hashed_text``) and has
``max_terms`` x (1 + ``factors``) numbers at most; scoring is one pass without a
shuffle.  Null and empty texts get the score of a text without terms.  Without any
labelled toxic row every score is near 0.  Equal texts get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashed_text import MAX_TERMS, MIN_DOCS, SAMPLE_ROWS, Adam, choose_terms, design, labelled_sample, row_sums, sigmoid, word_terms

FACTORS = 8
STEPS = 500


@dataclass
class FactorizationMachine:
    place: dict[int, int]
    w: np.ndarray
    v: np.ndarray

    def score(self, text: str | None) -> float:
        place = self.place
        x = np.array([0] + sorted(place[t] for t in word_terms(text) if t in place))
        v = self.v[x]
        pairs = 0.5 * float((v.sum(0) ** 2 - (v * v).sum(0)).sum())
        return float(sigmoid(self.w[x].sum() + pairs))


def fit(y: np.ndarray, starts: np.ndarray, cols: np.ndarray, n_terms: int, *, factors: int, steps: int, l2: float, seed: int = 7):
    """Weights and factors by full-batch Adam on the log loss; column 0 is the bias and has no factors."""
    w = np.zeros(n_terms + 1)
    v = np.random.default_rng(seed).normal(0, 0.05, (n_terms + 1, factors))
    v[0] = 0
    n = len(y)
    base = (y.sum() + 1e-3) / (n + 1) if n else 1e-3
    w[0] = np.log(base / (1 - base))
    if not n or not n_terms:
        return w, v
    rows = np.repeat(np.arange(n), np.diff(starts))
    opt = Adam([w, v], 0.03)
    for _ in range(steps):
        vx = v[cols]
        s = row_sums(vx, starts)
        z = row_sums(w[cols], starts) + 0.5 * ((s * s).sum(1) - row_sums((vx * vx).sum(1), starts))
        e = (sigmoid(z) - y) / n
        gw = np.bincount(cols, e[rows], n_terms + 1) + l2 * w
        gw[0] -= l2 * w[0]
        gv = np.empty_like(v)
        for f in range(v.shape[1]):
            gv[:, f] = np.bincount(cols, e[rows] * (s[rows, f] - vx[:, f]), n_terms + 1)
        gv += l2 * v
        gv[0] = 0
        opt.step([gw, gv])
    return w, v


def train(
    docs: DataFrame, labels: DataFrame, *, target: str = "toxic", doc_id: str = "doc_id", text: str = "text", modulus: int = 5,
    sample_rows: int = SAMPLE_ROWS, max_terms: int = MAX_TERMS, min_docs: int = MIN_DOCS,
    factors: int = FACTORS, steps: int = STEPS, l2: float = 1e-5,
) -> FactorizationMachine:
    """Learns from labelled rows whose crc32(id) modulo ``modulus`` is not 0."""
    sample = labelled_sample(docs, labels, target, word_terms, doc_id=doc_id, text=text, modulus=modulus, sample_rows=sample_rows)
    sample = sample.persist()
    chosen = choose_terms(sample, max_terms, min_docs)
    y, starts, cols = design(sample, chosen)
    sample.unpersist()
    w, v = fit(y, starts, cols, len(chosen), factors=factors, steps=steps, l2=l2)
    return FactorizationMachine({t: i + 1 for i, t in enumerate(chosen)}, w, v)


def score(docs: DataFrame, model: FactorizationMachine, *, text: str = "text", out: str = "toxicity") -> DataFrame:
    """All columns of ``docs`` and the score from 0 to 1."""
    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(model.score, na_action=None).astype("float64")

    return docs.withColumn(out, run(F.col(text)))
