"""Hashed terms of texts, a bounded labelled sample, and the choice of terms to learn from.

Terms are 32-bit hashes.  Learning uses at most ``sample_rows`` labelled documents
(those with the smallest hash of the id) and at most ``max_terms`` terms of them, the
ones that go most clearly with the label; the choice is made in Spark, so only
``sample_rows`` x ``max_terms`` small numbers can reach the driver.  Scoring reads
whole texts of all rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket
from .decontaminate import split_words

SAMPLE_ROWS = 8_000
MAX_TERMS = 1_024
MIN_DOCS = 6
PREFIXES = (4, 5, 6)

#: For shapes: capitals to A, characters beyond ASCII, small letters and digits go, the rest stays.
SHAPE = bytes(0x41 if 0x41 <= b <= 0x5A else b for b in range(256))
PLAIN = bytes(b for b in range(256) if b > 0x7F or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
CAPITALS = re.compile(rb"AA+")

Terms = Callable[[str | None], set[int]]


def word_terms(text: str | None) -> set[int]:
    """Hashed words, and word starts of a few lengths, as compounds and endings vary."""
    words = set(split_words(text))
    out = {crc32(w) for w in words}
    for n in PREFIXES:
        out.update([crc32(p, n) for p in {w[:n] for w in words if len(w) > n}])
    return out


def shape_terms(text: str | None) -> set[int]:
    """Hashed words, and how dense punctuation shapes, capitals and repetition are."""
    raw = (text or "").encode("utf-8", "replace")
    words = split_words(text)
    out = {crc32(w) for w in set(words)}
    n = len(raw.split())
    if n:
        shapes = Counter(CAPITALS.sub(b"B", raw.translate(SHAPE, PLAIN)).split())
        out.update([crc32(b"%s %d" % (s[:12], round(8 * c / n)), 101) for s, c in shapes.most_common(40) if 16 * c > n])
        k = max(1, len(words))
        stutter = sum(a == b for a, b in zip(words, words[1:]))
        top = max(Counter(words).values(), default=0)
        out.add(crc32(b"%d" % round(8 * stutter / k), 102))
        out.add(crc32(b"%d" % round(8 * top / k), 103))
        out.add(crc32(b"%d" % min(6, len(words).bit_length()), 104))
        odd = sum(c for s, c in shapes.items() if s.strip(b".,") not in (b"", b"A", b"B"))
        shouted = sum(c for s, c in shapes.items() if s.startswith(b"B"))
        for number, (share, whole) in enumerate(((stutter, k), (top, k), (odd, n), (shouted, n))):
            out.update([crc32(b"%d" % step, 110 + number) for step in (2, 3, 4, 8, 16) if share * step > whole])
    return out


def terms_udf(terms: Terms):
    @F.pandas_udf("array<bigint>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(terms(t)))

    return run


def labelled_sample(
    docs: DataFrame, labels: DataFrame, target: str, terms: Terms, *, doc_id: str, text: str, modulus: int, sample_rows: int,
) -> DataFrame:
    """y and terms of at most ``sample_rows`` labelled documents whose id is not held out.

    Several labels of one id count as the largest; null labels are none.
    """
    chosen = labels.where(F.col(target).isNotNull() & F.col(doc_id).isNotNull() & (id_bucket(F.col(doc_id), modulus) != 0))
    chosen = chosen.groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.col(target).cast("int")).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    # The broadcast side has sample_rows rows of two numbers at most.  Copies of a text count once.
    picked = rows.join(F.broadcast(chosen), "_id").dropDuplicates(["_id"]).withColumn("k", F.xxhash64("_text"))
    picked = picked.dropDuplicates(["k"])
    return picked.select("y", terms_udf(terms)(F.col("_text")).alias("terms"))


def choose_terms(sample: DataFrame, max_terms: int, min_docs: int) -> list[int]:
    """The terms whose presence goes most clearly with y, by the size of a t statistic."""
    all_rows = sample.agg(F.count("*").alias("n"), F.avg("y").alias("m"), F.coalesce(F.stddev_pop("y"), F.lit(0.0)).alias("s")).first()
    if not all_rows.n or not all_rows.s:
        return []
    by = sample.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("c"), F.sum("y").alias("t"))
    n, m, s = float(all_rows.n), float(all_rows.m), float(all_rows.s)
    c = F.col("c").cast("double")
    z = F.abs(F.col("t") - c * m) / (s * F.sqrt(c * (1 - c / n) + 1))
    best = by.where(c >= min_docs).withColumn("z", z).where("z > 4").orderBy(F.desc("z"), "term").limit(max_terms)
    return sorted(r.term for r in best.select("term").collect())


def design(sample: DataFrame, chosen: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """y, row pointers and column numbers of the chosen terms; column 0 stands in every row."""
    place = {t: i + 1 for i, t in enumerate(chosen)}

    @F.pandas_udf("array<int>")
    def columns(terms: pd.Series) -> pd.Series:
        return terms.map(lambda ts: [0] + [place[t] for t in ts if t in place])

    rows = sample.select("y", columns("terms").alias("x")).toPandas()
    rows["key"] = rows["x"].map(tuple)
    rows = rows.sort_values(["y", "key"], kind="stable")  # the same order whatever the partitions
    sizes = np.array([len(x) for x in rows["x"]], dtype=np.int64)
    return (rows["y"].to_numpy(np.float64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64),
            np.concatenate([np.asarray(x, np.int64) for x in rows["x"]]) if len(rows) else np.zeros(0, np.int64))


def row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts[:-1], axis=0)


class Adam:
    """Full-batch steps for a list of arrays."""

    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
