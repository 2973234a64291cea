"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade > k) = sigmoid(x.w - b_k) with one weight vector over hashed text terms for
all grades and ordered thresholds b_0 < b_1 < ...  A text gets its expected grade and
the tail probability of every grade, and is selected by one tail probability.

The model is trained on a bounded sample of labelled rows (``hashed_text``); scoring is
one pass without a shuffle.  Null and empty texts are scored as texts without terms.
Without labelled rows, or with one grade only, every text has the same score, and the
tail probabilities of grades that were seen are 1: nothing is rejected for lack of
labels.  Equal texts get equal scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashed_text import MAX_TERMS, MIN_DOCS, SAMPLE_ROWS, Adam, choose_terms, design, labelled_sample, row_sums, shape_terms, sigmoid

STEPS = 500
ACCEPT = 0.5
QUALITY = "struct<expected_grade:double, tails:array<double>>"


def grade(quality: Column, toxic: Column) -> Column:
    """0 poor, 1 good but toxic, 2 good; null without a quality label."""
    return F.when(quality == 0, 0).when(toxic == 1, 1).when(quality == 1, 2)


def ratings(labels: DataFrame) -> DataFrame:
    """doc_id and grade of a table with quality and toxic labels."""
    return labels.select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade"))


@dataclass
class Ordinal:
    place: dict[int, int]
    w: np.ndarray
    cuts: np.ndarray

    def tails(self, text: str | None) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ..."""
        place = self.place
        x = [place[t] for t in shape_terms(text) if t in place]
        return sigmoid(self.w[sorted(x)].sum() - self.cuts)


def fit(y: np.ndarray, starts: np.ndarray, cols: np.ndarray, n_terms: int, grades: int, *, steps: int, l2: float):
    """Weights (column 0 unused) and grades - 1 thresholds; gaps between thresholds are exponentials, so they stay ordered."""
    n = len(y)
    w = np.zeros(n_terms + 1)
    above = np.array([((y > k).sum() + 1e-6) / (n + 2e-6) if n else 1 - 1e-6 for k in range(grades - 1)])
    above = np.clip(above, 1e-6, 1 - 1e-6)
    cuts = -np.log(above / (1 - above))
    if not n or not n_terms or grades < 2:
        return w, np.maximum.accumulate(cuts)
    first, gaps = cuts[:1].copy(), np.log(np.maximum(np.diff(cuts), 1e-2))
    rows = np.repeat(np.arange(n), np.diff(starts))
    opt = Adam([w, first, gaps], 0.05)
    for _ in range(steps):
        cuts = first[0] + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        tail = sigmoid(row_sums(w[cols], starts)[:, None] - cuts[None, :])
        full = np.hstack([np.ones((n, 1)), tail, np.zeros((n, 1))])
        at = y.astype(int)
        p = np.maximum(full[np.arange(n), at] - full[np.arange(n), at + 1], 1e-9)
        slope = np.hstack([np.zeros((n, 1)), tail * (1 - tail), np.zeros((n, 1))])
        # d log p / d score, and / d each threshold
        ds = (slope[np.arange(n), at] - slope[np.arange(n), at + 1]) / p
        dc = np.zeros((n, grades + 1))
        dc[np.arange(n), at] -= slope[np.arange(n), at] / p
        dc[np.arange(n), at + 1] += slope[np.arange(n), at + 1] / p
        gc = -dc[:, 1:grades].mean(0)
        gw = -np.bincount(cols, ds[rows], n_terms + 1) / n + l2 * w
        gw[0] = 0
        behind = np.cumsum(gc[::-1])[::-1]
        opt.step([gw, np.array([gc.sum()]), behind[1:] * np.exp(gaps)])
    return w, first[0] + np.concatenate([[0], np.cumsum(np.exp(gaps))])


def train(
    docs: DataFrame, ratings: DataFrame, *, target: str = "grade", grades: int = 3, doc_id: str = "doc_id", text: str = "text",
    modulus: int = 5, sample_rows: int = SAMPLE_ROWS, max_terms: int = MAX_TERMS, min_docs: int = MIN_DOCS,
    steps: int = STEPS, l2: float = 1e-5,
) -> Ordinal:
    """Learns from rated rows (grades 0 .. grades - 1) whose crc32(id) modulo ``modulus`` is not 0."""
    sample = labelled_sample(docs, ratings, target, shape_terms, doc_id=doc_id, text=text, modulus=modulus, sample_rows=sample_rows)
    sample = sample.persist()
    chosen = choose_terms(sample, max_terms, min_docs)
    y, starts, cols = design(sample, chosen)
    sample.unpersist()
    w, cuts = fit(y, starts, cols, len(chosen), grades, steps=steps, l2=l2)
    return Ordinal({t: i + 1 for i, t in enumerate(chosen)}, w, cuts)


def rate(docs: DataFrame, model: Ordinal, *, text: str = "text", out: str = "rating") -> DataFrame:
    """All columns of ``docs`` and ``out``: expected_grade and tails (P(grade >= 1), ...)."""
    @F.pandas_udf(QUALITY)
    def run(texts: pd.Series) -> pd.DataFrame:
        tails = [model.tails(t) for t in texts]
        return pd.DataFrame({"expected_grade": [float(t.sum()) for t in tails], "tails": [t.tolist() for t in tails]})

    return docs.withColumn(out, run(F.col(text)))


def select_quality(docs: DataFrame, ratings: DataFrame, *, least_grade: int = 1, accept: float = ACCEPT, **options) -> DataFrame:
    """The documents whose probability of ``least_grade`` or more is at least ``accept``; the columns of ``docs``."""
    model = train(docs, ratings, **options)
    rated = rate(docs, model, text=options.get("text", "text"), out="__llm_rating")
    return rated.where(F.get(F.col("__llm_rating.tails"), F.lit(least_grade - 1)) >= accept).drop("__llm_rating")
