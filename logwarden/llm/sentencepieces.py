"""SentencePiece encoding and decoding for BPE models with byte fallback.

A text is normalised as the model does it (a space in front, spaces as U+2581) and cut
into words that no piece can cross: runs of U+2581 with what follows them, and
characters that are in no piece.  A word is a lattice: all its substrings up to the longest piece,
equi-joined to the piece table, grouped by word, folded with ``aggregate``.

The models are BPE models, so the best path is not the one with the largest sum of
scores: the fold takes, step by step, the best-scored edge that spans two neighbouring
segments, the leftmost of equals, which gives exactly the path of the merges.  Sums of
scores (a unigram Viterbi) would be other pieces than the library's.

``lattice`` is that plan for a table of words of any size.  ``encode`` runs it for the most
frequent words of the input of up to ``max_chars`` characters, ``max_words`` at most; this
dictionary has a proven bound and goes to the workers.  Words outside of it are folded
in the workers by the same rule, so texts never leave their partition: sending all
distinct words through the join and back to the documents would write about twice the
input to disk.

Null texts count as empty and have no pieces.  Decoding gives the text back, except that
U+2581 in a text comes back as a space, as in the library.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, written

BAR = "▁"
MAX_WORDS = 1 << 17
MAX_CHARS = 24
ENCODED = "struct<ids:array<int>, exact:boolean>"


class PairTable:
    """Which two segments make a piece, for many words at once.

    Segments have numbers: pieces those of their ids, other characters of pieces the numbers
    after them, all other characters the last one, which is in no pair.
    """

    def __init__(self, ids: dict[str, int], rank: dict[str, float], chars: set[str]):
        self.n_pieces = max(ids.values()) + 1
        number = dict(ids)
        for c in sorted(chars - set(ids)):
            number[c] = self.n_pieces + len(number) - len(ids)
        self.unknown = self.n_pieces + len(number) - len(ids)
        self.base = self.unknown + 1
        found = sorted((number[p[:k]] * self.base + number[p[k:]], r, ids[p]) for p, r in rank.items()
                       for k in range(1, len(p)) if p[:k] in number and p[k:] in number)
        self.keys = np.array([f[0] for f in found], np.int64)
        self.ranks = np.array([*(f[1] for f in found), np.inf])
        self.merged = np.array([*(f[2] for f in found), -1], np.int64)
        points = sorted((ord(c), n) for c, n in number.items() if len(c) == 1)
        self.points = np.array([p[0] for p in points], np.int64)
        self.numbers = np.array([p[1] for p in points], np.int64)
        self.piece = np.zeros(self.base, bool)
        self.piece[list(ids.values())] = True

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (infinite if they make no piece) and number of what two segments make."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        at[self.keys[at] != key] = len(self.keys)
        return self.ranks[at], self.merged[at]

    def fold(self, words: list[str]) -> Iterator[tuple[list[int], np.ndarray]]:
        """Words of one length -> places of words and their segments, as rows of equal length.

        Each round merges one pair of every word that has one: the best, the leftmost of
        equals.  Words without one are done, so all others have equally many segments.
        """
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        at = np.minimum(np.searchsorted(self.points, codes), len(self.points) - 1)
        parts = np.where(self.points[at] == codes, self.numbers[at], self.unknown).reshape(len(words), -1)
        place = np.arange(len(words))
        rank, made = self.find(parts[:, :-1], parts[:, 1:])
        while parts.shape[1] > 1:
            best = rank.argmin(1)
            goes_on = rank[np.arange(len(best)), best] < np.inf
            if not goes_on.all():
                yield place[~goes_on].tolist(), parts[~goes_on]
                place, parts, rank, made, best = (x[goes_on] for x in (place, parts, rank, made, best))
            if not len(place):
                return
            every, width = np.arange(len(best)), parts.shape[1]
            new = made[every, best]
            before = np.arange(width - 1) < best[:, None]
            parts = np.where(before, parts[:, :-1], parts[:, 1:])
            parts[every, best] = new
            before = before[:, :-1]
            rank, made = np.where(before, rank[:, :-1], rank[:, 1:]), np.where(before, made[:, :-1], made[:, 1:])
            # Only the pairs on both sides of the merged one are new.
            for rows, where in ((every[best < width - 2], best), (every[best > 0], best - 1)):
                k = where[rows]
                rank[rows, k], made[rows, k] = self.find(parts[rows, k], parts[rows, k + 1])
        yield place.tolist(), parts


class Pieces:
    """The piece table of a model file: text -> (id, rank), bytes -> id, id -> bytes."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.byte: list[int] = [0] * 256
        self.raw: list[bytes | None] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                self.ids[piece] = i
                self.rank[piece] = -sp.get_score(i)
                self.raw.append(piece.encode().replace(BAR.encode(), b" "))
        self.longest = max(map(len, self.ids))
        chars = set("".join(self.ids))
        self.pairs = PairTable(self.ids, self.rank, chars)
        if any(BAR in p.lstrip(BAR) for p in self.ids):
            raise ValueError("a piece goes on after a space: words cannot be cut at spaces")
        lone = "".join(re.escape(chr(c)) for c in range(32) if chr(c) not in chars)
        self.pattern = f"[{lone}]|{BAR}*[^{BAR}{lone}]+|{BAR}+"

    def words(self, text: str | None) -> list[str]:
        return re.findall(self.pattern, BAR + text.replace(" ", BAR)) if text else []

    def fallback(self, segment: str) -> list[int]:
        """The id of a piece; a character outside the table as its bytes."""
        i = self.ids.get(segment)
        return [i] if i is not None else [self.byte[b] for b in segment.encode("utf-8", "replace")]

    def fold(self, word: str) -> list[int]:
        """Merges of one word: the best pair first, the leftmost of equals."""
        parts = list(word)
        if len(parts) > 48:
            return [i for p in self.fold_long(parts) for i in self.fallback(p)]
        rank, none = self.rank.get, float("inf")
        ranks = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            parts[at] += parts.pop(at + 1)
            del ranks[at]
            # Only the pairs on both sides of the merged one are new.
            if at < len(ranks):
                ranks[at] = rank(parts[at] + parts[at + 1], none)
            if at:
                ranks[at - 1] = rank(parts[at - 1] + parts[at], none)
        return [i for p in parts for i in self.fallback(p)]

    def fold_many(self, words: list[str]) -> dict[str, bytes]:
        """word -> ids as 32-bit numbers; what ``fold`` gives, for many words at a time."""
        by_length, out = defaultdict(list), {}
        for w in words:
            by_length[len(w)].append(w)
        for length, same in by_length.items():
            rest = same if length > 48 else []
            for i in range(0, len(same) if length <= 48 else 0, 20_000):
                part = same[i:i + 20_000]
                for places, segments in self.pairs.fold(part):
                    whole = self.pairs.piece[segments].all(1)
                    raw, step = segments.astype(np.int32).tobytes(), 4 * segments.shape[1]
                    for k, (place, ok) in enumerate(zip(places, whole.tolist(), strict=True)):
                        if ok:
                            out[part[place]] = raw[k * step:(k + 1) * step]
                        else:
                            rest.append(part[place])
            for w in rest:  # long words, and characters that become bytes
                out[w] = np.array(self.fold(w), np.int32).tobytes()
        return out

    def fold_long(self, parts: list[str]) -> list[str]:
        """The same with a heap, for words of any length."""
        rank, n = self.rank, len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[p], i, p) for i in range(n - 1) if (p := parts[i] + parts[i + 1]) in rank]
        heapq.heapify(heap)
        while heap:
            _, i, merged = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= n or parts[i] + parts[j] != merged:
                continue
            parts[i], parts[j] = merged, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if left >= 0 and right < n and (p := parts[left] + parts[right]) in rank:
                    heapq.heappush(heap, (rank[p], left, p))
        return [p for p in parts if p]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """piece, rank: of the size of the vocabulary."""
    return spark.createDataFrame(list(pieces.rank.items()), "piece string, rank double")


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """word -> word, segments (array<string>), for distinct words in a column ``word``.

    Substrings are exploded and joined to the piece table; the edges of a word are grouped
    to a map from (start, end) to rank; the fold starts with single characters and merges the
    best edge over two neighbours until there is none.
    """
    spark = words.sparkSession
    n = F.length("word")
    starts = words.select("word", F.explode(F.sequence(F.lit(1), n)).alias("s"))
    spans = starts.where(F.col("s") < n).select(
        "word", "s", F.explode(F.sequence(F.lit(2), F.least(F.lit(pieces.longest), n - F.col("s") + 1))).alias("k"))
    edges = spans.withColumn("piece", F.substring("word", F.col("s"), F.col("k"))).join(
        F.broadcast(piece_table(spark, pieces)), "piece").select("word", "s", (F.col("s") + F.col("k")).alias("e"), "rank")
    grouped = edges.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("s", "e"), "rank"))).alias("edges"))
    cuts = F.sequence(F.lit(1), n + 1)

    def merge(bounds, _):
        """bounds: where the segments start, and the end; the best edge over two segments loses its middle."""
        options = F.transform(F.slice(bounds, F.lit(1), F.size(bounds) - 2), lambda b, i: F.struct(
            F.try_element_at(F.col("edges"), F.struct(b.alias("s"), F.get(bounds, i + 2).alias("e"))).alias("rank"), i.alias("i")))
        best = F.array_min(F.filter(options, lambda o: o["rank"].isNotNull()))
        return F.when(best.isNull(), bounds).otherwise(F.filter(bounds, lambda b, i: i != best["i"] + 1))

    return words.join(grouped, "word", "left").select("word", F.when(F.col("edges").isNull(), cuts).otherwise(
        F.aggregate(F.sequence(F.lit(1), n), cuts, merge)).alias("bounds")).select("word", F.transform(
            F.slice("bounds", F.lit(1), F.size("bounds") - 1),
            lambda b, i: F.substring(F.col("word"), b, F.get(F.col("bounds"), i + 1) - b)).alias("segments"))


def word_counts(docs: DataFrame, pieces: Pieces, *, text: str, max_chars: int, flush: int = 50_000) -> DataFrame:
    """word, n over all texts, for words of up to ``max_chars`` characters; counted per task first."""
    pattern = pieces.pattern
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen = re.compile(pattern).findall, Counter()

        def out():
            rows = [(w, c) for w, c in seen.items() if 1 < len(w) <= max_chars]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], schema=schema)

        for batch in batches:
            for t in batch.column(0):
                t = t.as_py()
                if t:
                    seen.update(find(BAR + t.replace(" ", BAR)))
                    if len(seen) > flush:
                        yield out()
        yield out()

    return docs.select(F.col(text).cast("string")).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, max_words: int) -> DataFrame:
    """word: those above the lowest frequency class at which they are ``max_words`` or fewer.

    A frequency class is an eighth of an octave, so the histogram has a few hundred rows at any
    size of the input, and nothing is sorted.
    """
    level = F.floor(F.log2("n") * 8).cast("int")
    lowest, total = None, 0
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        total += row["count"]
        if total > max_words:
            break
        lowest = row["level"]
    return counts.where(F.lit(False) if lowest is None else level >= lowest).select("word")


def dictionary(docs: DataFrame, pieces: Pieces, *, text: str, max_words: int, max_chars: int) -> dict[str, bytes]:
    """The ids of the most frequent words, from the lattice; ``max_words`` x ``max_chars`` numbers at most."""
    counts = written(word_counts(docs, pieces, text=text, max_chars=max_chars))
    rows = lattice(saved(frequent(counts, max_words)), pieces).toPandas()
    return {w: array("i", [i for s in segments for i in pieces.fallback(s)]).tobytes() for w, segments in zip(rows["word"], rows["segments"], strict=True)}


def chunks(texts: pa.Array, chars: int = 1_000_000) -> Iterator[list[str]]:
    """The texts in order, in lists of about so many characters; null is empty."""
    held, size = [], 0
    for t in texts:
        held.append(t.as_py() or "")
        size += len(held[-1])
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(
    docs: DataFrame, model_file: str, *, text: str = "text", out: str = "encoded",
    max_words: int = MAX_WORDS, max_chars: int = MAX_CHARS,
) -> DataFrame:
    """All columns of ``docs`` and ``out``: ids, and whether decoding them gives the text back."""
    pieces = Pieces(model_file)
    known = dictionary(docs, pieces, text=text, max_words=max_words, max_chars=max_chars)
    shared = docs.sparkSession.sparkContext.broadcast((pieces, known))

    @F.arrow_udf(ENCODED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces, known = shared.value
        find, seen = re.compile(pieces.pattern).findall, dict(known)
        for texts in batches:
            flat, ends, exact = [], [0], []
            for part in chunks(texts):
                found = [find(BAR + t.replace(" ", BAR)) if t else [] for t in part]
                if len(seen) > len(known) + 100_000:
                    seen = dict(known)
                seen.update(pieces.fold_many(list({w for ws in found for w in ws if w not in seen})))
                for t, ws in zip(part, found, strict=True):
                    ids = b"".join(map(seen.__getitem__, ws))
                    exact.append(pieces.decode(np.frombuffer(ids, np.int32).tolist()) == t)
                    ends.append(ends[-1] + len(ids) // 4)
                    flat.append(ids)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(flat), np.int32)))
            yield pa.StructArray.from_arrays([ids, pa.array(exact, pa.bool_())], names=["ids", "exact"])

    return docs.withColumn(out, run(F.col(text)))


def decode(df: DataFrame, model_file: str, *, ids: str = "ids", out: str = "text") -> DataFrame:
    """All columns of ``df`` and ``out``: the text of the ids; null ids give null."""
    shared = df.sparkSession.sparkContext.broadcast(Pieces(model_file))

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        pieces = shared.value
        return pd.Series([None if r is None else pieces.decode(r) for r in rows], dtype=object)

    return df.withColumn(out, run(F.col(ids)))
