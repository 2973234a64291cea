"""Secret scans: patterns, and a battery of randomness tests with false-discovery control.

Patterns find assignments, access keys and long hexadecimal strings.  Besides, every
run of 20 or more characters of ``[A-Za-z0-9+/_=-]`` is a candidate:

1. its encoding is inferred: the smallest of ``ALPHABETS`` (digits, hex, one case, base32,
   base36, alphanumeric, base64 / base64url) that holds its characters;
2. three tests ask whether it can be uniform noise over that alphabet: chi-squared
   over equal bins of the alphabet, Wald-Wolfowitz runs above and below the middle
   of the alphabet, and lag-1 serial correlation; if the smallest of the three
   p-values, times three, is under ``uniform_alpha``, the candidate's p-value is 1;
3. else its p-value against ordinary text is twice the smaller of two.  One is the
   likelihood ratio of ordinary text to uniform noise over the alphabets (the chance of a ratio
   of r or less is at most r in ordinary text); ordinary text is a chain of the character
   pairs counted in the runs of under 20 characters of all documents.  The other is
   the binomial tail of the number of switches between lower case, upper case and
   digits, which ordinary words make with a chance of ``switch_rate`` at most;
4. Benjamini-Hochberg over the candidates of the whole input, separately by length
   stratum (powers of two), bounds the share of ordinary strings at ``fdr``.  Only a
   table of character pairs and a histogram of p-values by stratum are gathered, of fixed
   sizes, so the step is the same at any scale; p-values are rounded up to the edge of their bin.

Candidates that a pattern span overlaps are not reported again.  Offsets are code
points, end exclusive.  Null and empty texts have no spans; repeated rows each get
theirs; extra columns pass through.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns of the three kinds, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

# Alphabets in the order of their code.
HEX_ALPHABET = "0123456789abcdef"
BASE32_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ALNUM_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
BASE64_ALPHABET = ALNUM_ALPHABET + "+/"
BASE64URL_ALPHABET = ALNUM_ALPHABET + "-_"
LOWER = ALNUM_ALPHABET[26:52]
DIGITS = ALNUM_ALPHABET[52:]
CHARS = ALNUM_ALPHABET + "+/-_="
# From the smallest on.
ALPHABETS = (
    DIGITS, HEX_ALPHABET, HEX_ALPHABET.upper(), LOWER, LOWER.upper(), BASE32_ALPHABET, BASE32_ALPHABET.lower(),
    LOWER + DIGITS, LOWER.upper() + DIGITS, ALNUM_ALPHABET, BASE64_ALPHABET, BASE64URL_ALPHABET, CHARS)

SPANS = "array<struct<kind:string, start:int, end:int>>"
FDR = 0.01
UNIFORM_ALPHA = 1e-4
SWITCH_RATE = 0.2
BIN_WIDTH = 0.1
BINS = 600
LEAST = 20
# Number of each byte in CHARS from 1 on; 0 is any other byte, which ends a run.
NUMBERS = np.zeros(256, np.intp)
NUMBERS[list(CHARS.encode())] = range(1, len(CHARS) + 1)
STATES = len(CHARS) + 1
# Any text holds this share of characters that follow no habit.
ODD = 0.1


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the pattern kinds, leftmost without overlap within a kind."""
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def alphabet(token: str) -> str:
    """The smallest alphabet that holds all characters, padding aside."""
    chars = set(token)
    return next(known for known in ALPHABETS if chars <= set(known))


def normal_tail(z: float) -> float:
    """Two-sided."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi_squared_tail(x: float, k: int) -> float:
    """Upper tail by the cube-root normal approximation."""
    if x <= 0:
        return 1.0
    v = 2 / (9 * k)
    return 0.5 * math.erfc(((x / k) ** (1 / 3) - (1 - v)) / math.sqrt(2 * v))


def uniform_p(codes: list[int], size: int) -> float:
    """Smallest p-value of the three tests for uniform noise, corrected for three tests."""
    n = len(codes)
    bins = max(2, min(8, n // 5, size))
    counts = [0] * bins
    for c in codes:
        counts[c * bins // size] += 1
    expected = [((b + 1) * size + bins - 1) // bins - (b * size + bins - 1) // bins for b in range(bins)]
    chi = sum((o - n * e / size) ** 2 / (n * e / size) for o, e in zip(counts, expected, strict=True))
    p = chi_squared_tail(chi, bins - 1)
    up = [2 * c >= size for c in codes]
    a = sum(up)
    b = n - a
    if a and b:
        runs = 1 + sum(x != y for x, y in zip(up, up[1:]))
        mean = 1 + 2 * a * b / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p = min(p, normal_tail((runs - mean) / math.sqrt(var)) if var > 0 else 1.0)
    else:
        p = min(p, 2.0 ** (1 - n))
    m = sum(codes) / n
    var = sum((c - m) ** 2 for c in codes)
    if var > 0:
        r = sum((x - m) * (y - m) for x, y in zip(codes, codes[1:])) / var
        p = min(p, normal_tail((r + 1 / n) * math.sqrt(n)))
    else:
        p = 0.0
    return min(1.0, 3 * p)


def char_class(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3


def ordinary_log_p(token: str, rate: float) -> float:
    """log10 of the binomial tail: so many class switches or more in ordinary text."""
    kinds = [char_class(c) for c in token]
    n, k = len(token) - 1, sum(x != y for x, y in zip(kinds, kinds[1:]))
    if k <= n * rate:
        return 0.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(rate) + (n - i) * math.log1p(-rate)
            for i in range(k, n + 1)]
    top = max(logs)
    return min(0.0, (top + math.log(sum(math.exp(x - top) for x in logs))) / math.log(10))


def char_pairs(docs: DataFrame, text: str) -> np.ndarray:
    """How often each character follows each other one in runs of under ``LEAST`` characters; counted per task, then summed."""
    import pyarrow as pa

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(STATES * STATES, np.int64)
        for batch in batches:
            for t in batch.column(0):
                t = t.as_py()
                if t:
                    at = NUMBERS[np.frombuffer(f" {CANDIDATE.sub(' ', t)} ".encode("utf-8", "replace"), np.uint8)]
                    seen += np.bincount(at[:-1] * STATES + at[1:], minlength=len(seen))
        own = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(seen[own])], names=["pair", "n"])

    per_task = docs.select(F.col(text).cast("string")).mapInArrow(count, "pair int, n bigint")
    out = np.zeros(STATES * STATES)
    for pair, n in per_task.groupBy("pair").agg(F.sum("n")).collect():  # STATES squared rows at most
        out[pair] = n
    return out.reshape(STATES, STATES)


def ordinary_text(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the chance of each character after each other one: in a run that goes on, and in any (0 is its end).

    After a character that was never seen all are equally likely, so it tells nothing.
    """
    chance = (1 - ODD) * (pairs + 1) / (pairs.sum(1, keepdims=True) + STATES) + ODD / STATES
    within = chance.copy()
    within[:, 0] = 1
    within[:, 1:] /= chance[:, 1:].sum(1, keepdims=True)
    return np.log10(within), np.log10(chance)


def ratio_log_p(token: str, size: int, ordinary: tuple[np.ndarray, np.ndarray]) -> float:
    """log10 of the ratio of ordinary text, given that the run has ``LEAST`` characters, to noise over ``ALPHABETS``.

    Noise takes each alphabet alike and goes on beyond n characters with the chance LEAST / (n + 1).
    """
    within, chance = ordinary
    at = NUMBERS[np.frombuffer(token.encode(), np.uint8)]
    n, a, b = len(at), at[:-1], at[1:]
    text = -math.log10(len(CHARS)) + within[a[:LEAST - 1], b[:LEAST - 1]].sum() + chance[a[LEAST - 1:], b[LEAST - 1:]].sum() + chance[at[-1], 0]
    noise = -n * math.log10(size) - math.log10(len(ALPHABETS)) + math.log10(LEAST / (n * (n + 1)))
    return min(0.0, float(text - noise))


def stratum(n: int) -> int:
    """Length stratum: 20-31, 32-63, 64-127, ..."""
    return n.bit_length()


def p_bin(log_p: float) -> int:
    """Bin by the rounded-up p-value; bin b holds p <= 10 ** (-b * BIN_WIDTH)."""
    return min(BINS - 1, int(-log_p / BIN_WIDTH))


def candidates(text: str, taken: list[tuple[int, int, int]], uniform_alpha: float, rate: float, ordinary: tuple[np.ndarray, np.ndarray]):
    """(start, end, stratum, bin) of every candidate that no pattern span overlaps; those that cannot be noise are in bin 0."""
    out = []
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        if any(a < e and s < b for a, _, b in taken):
            continue
        token = m.group().rstrip("=")
        if len(token) < LEAST:
            continue
        own = alphabet(token)
        log_p = min(0.0, math.log10(2) + min(ordinary_log_p(token, rate), ratio_log_p(token, len(own), ordinary)))
        if log_p < 0:
            place = {c: i for i, c in enumerate(own)}
            if uniform_p([place[c] for c in token], len(own)) < uniform_alpha:
                log_p = 0.0
        out.append((s, e, stratum(len(token)), p_bin(log_p)))
    return out


def p_value_histogram(docs: DataFrame, text: str, uniform_alpha: float, rate: float, ordinary: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Candidates by stratum and p-value bin: counted per task first, then summed."""
    import pyarrow as pa

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, int], int] = {}
        for batch in batches:
            for t in batch.column(0):
                t = t.as_py()
                if t and CANDIDATE.search(t):
                    for _, _, level, b in candidates(t, pattern_spans(t), uniform_alpha, rate, ordinary):
                        seen[level, b] = seen.get((level, b), 0) + 1
        yield pa.RecordBatch.from_pydict(
            {"stratum": [k[0] for k in seen], "bin": [k[1] for k in seen], "n": list(seen.values())},
            schema=pa.schema([("stratum", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())]))

    per_task = docs.select(F.col(text).cast("string")).mapInArrow(count, "stratum int, bin int, n bigint")
    return per_task.groupBy("stratum", "bin").agg(F.sum("n").alias("n"))


def discovery_limits(histogram: list[tuple[int, int, int]], fdr: float) -> dict[int, int]:
    """Stratum -> lowest bin that Benjamini-Hochberg accepts; strata without one are absent."""
    by: dict[int, dict[int, int]] = {}
    for level, b, n in histogram:
        by.setdefault(level, {})[b] = n
    limits = {}
    for level, bins in by.items():
        total, so_far = sum(bins.values()), 0
        for b in sorted(bins.keys() - {0}, reverse=True):
            so_far += bins[b]
            if 10 ** (-b * BIN_WIDTH) * total <= fdr * so_far:
                limits[level] = b
    return limits


def all_spans(text: str | None, limits: dict[int, int], uniform_alpha: float, rate: float, ordinary: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns and of the candidates whose bin is accepted, sorted."""
    if not text:
        return []
    spans = pattern_spans(text)
    found = [(s, 3, e) for s, e, level, b in candidates(text, spans, uniform_alpha, rate, ordinary) if b >= limits.get(level, BINS)]
    return sorted(spans + found)


def find_secrets(
    docs: DataFrame, *, text: str = "text", out: str = "secrets", fdr: float = FDR,
    uniform_alpha: float = UNIFORM_ALPHA, switch_rate: float = SWITCH_RATE,
) -> DataFrame:
    """All columns of ``docs`` and ``out``: the spans by start, then kind."""
    ordinary = ordinary_text(char_pairs(docs, text))
    limits = accepted_limits(docs, text, fdr, uniform_alpha, switch_rate, ordinary)

    @F.pandas_udf(SPANS)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([
            [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in all_spans(t, limits, uniform_alpha, switch_rate, ordinary)] for t in texts], dtype=object)

    return docs.withColumn(out, run(F.col(text)))


def accepted_limits(
    docs: DataFrame, text: str, fdr: float, uniform_alpha: float, rate: float, ordinary: tuple[np.ndarray, np.ndarray],
) -> dict[int, int]:
    rows = p_value_histogram(docs, text, uniform_alpha, rate, ordinary).collect()  # 32 x BINS rows at most
    return discovery_limits([tuple(r) for r in rows], fdr)


def cover(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
    """The text with ``[SECRET]`` for every span, for overlapping spans once."""
    if not spans:
        return text
    parts, at = [], 0
    for start, _, end in spans:
        if end > at:
            parts += [text[at:max(at, start)], "[SECRET]" if start >= at else ""]
            at = end
    return "".join(parts) + text[at:]


def redact_secrets(
    docs: DataFrame, *, text: str = "text", fdr: float = FDR, uniform_alpha: float = UNIFORM_ALPHA, switch_rate: float = SWITCH_RATE,
) -> DataFrame:
    """The documents with every span replaced by ``[SECRET]`` (overlapping spans by one)."""
    ordinary = ordinary_text(char_pairs(docs, text))
    limits = accepted_limits(docs, text, fdr, uniform_alpha, switch_rate, ordinary)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([cover(t, all_spans(t, limits, uniform_alpha, switch_rate, ordinary)) for t in texts], dtype=object)

    return docs.withColumn(text, run(F.col(text)))
