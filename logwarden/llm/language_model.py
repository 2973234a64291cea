"""LM scoring by deleted interpolation.

Tokens are words (A-Z in lower case, cut at ASCII white space) and one end per text.
The model mixes four maximum-likelihood estimates:

* order 0: 1 / (V + 1), one place for all unknown words;
* order 1: c(w) / N over all training tokens, every word counted exactly;
* order 2 by class: c(U, W) / c(U).  Words with at least ``min_share`` of all tokens stand for
  themselves, all others are one class OTHER, as context and as target; inside OTHER
  the chance of a word is c(w) / c(OTHER), so the estimate sums to one;
* order 2: c(u, w) / c(u) for every pair of words, however rare, counted exactly.

The first three are mixed by the frequency of the class U, the result and the last one by the
frequency of the word u, in buckets of powers of two (a context never seen has no last estimate).  The weights are
learned by expectation-maximisation on held-out counts: the training texts with
crc32(id) % ``modulus`` = 1 are taken out of the counts, and the weights are those that
make them likeliest; then all training texts are counted.

A share, not a number, decides which words stand for themselves, so there are at most
1 / min_share of them whatever the corpus, and the table of their pairs has a proven bound.

Texts are dealt once into chunks of about ``CHUNK`` tokens and coded by the words of their chunk.  A chunk asks for each
of its words once (dealt by word), gets its number and counts, then asks for each of its pairs of numbers
once (dealt by pair) and gets their counts, so what is shuffled are the distinct words and pairs of
chunks, packed, not tokens.  Every request is answered, exactly: numbers are told apart, not hashes.

Null texts count as empty: one end.  Rows of equal id and text are scored each for itself.
Null ids count as empty text for the split.  Without training texts every probability is 1.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple
from uuid import uuid4
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket, removed, shared_folder, written

MIN_SHARE = 1 / 1500
#: Tokens of a chunk; a longer text is a chunk for itself.
CHUNK = 1_500_000
#: Bytes of text for each bucket of words and of pairs.
WORD_BYTES, PAIR_BYTES = 1 << 25, 1 << 24
END = b""
#: Kinds of rows.  Texts: a tokens, b lengths, c held out.  Asked words: a places in the chunk, b counts.  Found words: a places,
#: b numbers, c counts, d deleted counts.  Frequent words of a bucket: a counts, b deleted counts, c numbers, n distinct words in training, chunk all of them.
#: Asked pairs: a steps between keys, b counts.  Found pairs: c counts, d deleted counts.  Sums: x codes, y and z what is summed.
TEXTS, ASKED, FOUND, FREQUENT, PAIRS, FOUND_PAIRS, SUMS = range(7)
ROWS = """kind int, chunk bigint, bucket int, deleted boolean, n bigint, a binary, b binary, c binary, d binary,
    ids array<bigint>, words array<binary>, x array<bigint>, y array<bigint>, z array<bigint>"""
LONGS = pa.list_(pa.int64())
ARROW = pa.schema([
    ("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("deleted", pa.bool_()), ("n", pa.int64()), *[(c, pa.binary()) for c in "abcd"],
    ("ids", LONGS), ("words", pa.list_(pa.binary())), ("x", LONGS), ("y", LONGS), ("z", LONGS)])
SCORES = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double, held_out boolean"


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0, by planes of their bytes, compressed."""
    values = np.ascontiguousarray(values, "<i8")
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return len(values).to_bytes(8, "little") + bytes([width]) + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), data[8]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(data[9:], n * width, codec="zstd"), np.uint8).reshape(width, n).T
    return out.view("<i8").ravel()


def made(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in ARROW], schema=ARROW)


def buckets_of(size: int, each: int) -> int:
    """A power of two."""
    return 1 << (max(0, size - 1) // each).bit_length()


def tokens(text: str | None) -> list[bytes]:
    out = (text or "").encode("utf-8", "replace").lower().split()
    out.append(END)
    return out


def encode(buckets: int, most: int):
    """(bucket, text, doc_id) -> chunks of at most ``most`` tokens: a row of texts each, and rows of the words they ask for.

    Deleted texts have chunks of their own.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[bool, tuple[defaultdict, list]] = {}
        made_here = TaskContext.get().partitionId() << 33

        def out(deleted):
            nonlocal made_here
            place, texts = opened.pop(deleted)
            lengths = np.array([len(t[2]) for t in texts])
            held = np.array([t[1] for t in texts])
            coded = np.concatenate([t[2] for t in texts])
            counts = np.bincount(coded[~np.repeat(held, lengths)], minlength=len(place))
            whole = {"chunk": made_here, "deleted": deleted}
            made_here += 1
            rows = [whole | {
                "kind": TEXTS, "n": int(counts.sum()), "a": pack(coded), "b": pack(lengths), "c": pack(held), "ids": [t[0] for t in texts]}]
            words = list(place)
            bucket = np.array([crc32(w) for w in words], np.int64) & (buckets - 1)
            order = np.argsort(bucket, kind="stable")
            first = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            for at in np.split(order, first[1:]):
                rows.append(whole | {
                    "kind": ASKED, "bucket": int(bucket[at[0]]), "words": [words[i] for i in at.tolist()], "a": pack(at), "b": pack(counts[at])})
            return made(rows)

        sizes = {False: 0, True: 0}
        for batch in batches:
            for bucket, text, doc in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                ws, deleted = tokens(text.as_py()), bucket == 1
                if deleted in opened and sizes[deleted] + len(ws) > most:
                    yield out(deleted)
                if deleted not in opened:
                    place: defaultdict = defaultdict()
                    place.default_factory = place.__len__  # a new word gets the next place
                    opened[deleted], sizes[deleted] = (place, []), 0
                place, texts = opened[deleted]
                texts.append((doc, bucket == 0, np.fromiter(map(place.__getitem__, ws), np.int32, len(ws))))
                sizes[deleted] += len(ws)
        for deleted in list(opened):
            yield out(deleted)

    return run


def find_words(buckets: int, least: float):
    """The asked words of a bucket of all chunks -> for each chunk their numbers and counts, and the words of at least that count."""
    def run(table: pa.Table) -> pa.Table:
        asked = pa.concat_arrays([c.flatten() for c in table["words"].chunks]).dictionary_encode()
        code, words = asked.indices.to_numpy(zero_copy_only=False).astype(np.int64), asked.dictionary
        counts = [unpack(b) for b in table["b"].to_pylist()]
        ends = np.cumsum([0] + [len(c) for c in counts])
        deleted = np.repeat(table["deleted"].to_numpy(), np.diff(ends))
        n = np.concatenate(counts)
        c = np.bincount(code, n, len(words)).astype(np.int64)
        d = np.bincount(code, n * deleted, len(words)).astype(np.int64)
        bucket = table["bucket"][0].as_py()
        number = np.arange(len(words)) * buckets + bucket
        rows = []
        for i, (chunk, gone, at) in enumerate(zip(table["chunk"].to_pylist(), table["deleted"].to_pylist(), table["a"].to_pylist(), strict=True)):
            own = code[ends[i]:ends[i + 1]]
            rows.append({
                "kind": FOUND, "chunk": chunk, "bucket": bucket, "deleted": gone, "a": at, "b": pack(number[own]), "c": pack(c[own]),
                "d": pack(d[own]) if gone else None})
        top = np.flatnonzero(((c >= least) & (c > 0)) | pc.equal(words, END).to_numpy(zero_copy_only=False))
        rows.append({
            "kind": FREQUENT, "chunk": len(words), "bucket": bucket, "n": int((c > 0).sum()), "words": words.take(pa.array(top)).to_pylist(),
            "a": pack(c[top]), "b": pack(d[top]), "c": pack(number[top])})
        return pa.Table.from_batches([made(rows)])

    return run


class Dealing(NamedTuple):
    """How pairs of word numbers below 2^bits are dealt over 2^split buckets, and the numbers of the class words."""

    bits: int
    split: int
    numbers: np.ndarray

    def deal(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and key; both together are the pair, as for one right number the left ones stay distinct."""
        k, low = self.bits, self.bits - self.split
        first, second = (np.uint64(c >> (64 - k) | 1) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
        left, right = left.astype(np.uint64), right.astype(np.uint64)
        mixed = (left * first + right * second) & np.uint64((1 << k) - 1)
        return (mixed >> np.uint64(low)).astype(np.int64), (mixed & np.uint64((1 << low) - 1)) << np.uint64(k) | right

    def classes(self, number: np.ndarray) -> np.ndarray:
        order = np.argsort(self.numbers)
        at = np.minimum(np.searchsorted(self.numbers, number, sorter=order), len(order) - 1)
        return np.where(self.numbers[order[at]] == number, order[at], len(order))


class Chunk:
    """Texts of a chunk, the numbers, classes and counts of its words, and its distinct pairs u, w by bucket and key."""

    def __init__(self, table: pa.Table, dealing: Dealing):
        rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["bucket"] or 0))
        texts = next(r for r in rows if r["kind"] == TEXTS)
        self.number, self.deleted, self.ids = texts["chunk"], texts["deleted"], texts["ids"]
        self.tokens, self.lengths, self.held = unpack(texts["a"]), unpack(texts["b"]), unpack(texts["c"]) > 0
        size = int(self.tokens.max()) + 1
        numbers, self.count, self.gone = np.zeros((3, size), np.int64)
        for r in rows:
            if r["kind"] == FOUND:
                at = unpack(r["a"])
                numbers[at], self.count[at] = unpack(r["b"]), unpack(r["c"])
                if self.deleted:
                    self.gone[at] = unpack(r["d"])
        self.classes = dealing.classes(numbers)
        # Every text ends with END, which stands before the first word of the next one as well.
        codes, inverse = np.unique(np.roll(self.tokens, 1) * size + self.tokens, return_inverse=True)
        u, w = codes // size, codes % size
        bucket, key = dealing.deal(numbers[u], numbers[w])
        order = np.lexsort((key, bucket))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.u, self.w, self.bucket, self.key, self.pair = u[order], w[order], bucket[order], key[order], rank[inverse]
        found = [r for r in rows if r["kind"] == FOUND_PAIRS]
        if found:
            self.pairs = np.concatenate([unpack(r["c"]) for r in found])
            self.pairs_gone = np.concatenate([unpack(r["d"]) for r in found]) if self.deleted else None


def ask_pairs(shared):
    """A chunk with its found words -> the pairs it asks for, its pairs of classes, and the deleted tokens outside the classes by context and count."""
    def run(table: pa.Table) -> pa.Table:
        dealing = shared.value
        chunk = Chunk(table, dealing)
        k = len(dealing.numbers) + 1
        n = np.bincount(chunk.pair, ~np.repeat(chunk.held, chunk.lengths), len(chunk.u)).astype(np.int64)
        rows = []
        ends = np.append(np.flatnonzero(np.diff(chunk.bucket, prepend=-1)), len(n))
        for i, j in zip(ends, ends[1:]):
            rows.append({
                "kind": PAIRS, "chunk": chunk.number, "bucket": int(chunk.bucket[i]), "deleted": chunk.deleted,
                "a": pack(np.diff(chunk.key[i:j], prepend=np.uint64(0)).view(np.int64)), "b": pack(n[i:j])})
        cu, cw = chunk.classes[chunk.u], chunk.classes[chunk.w]
        sums = np.bincount(cu * k + cw, n).astype(np.int64)
        codes = np.flatnonzero(sums)
        x, y, z = [codes], [sums[codes]], [sums[codes] * int(chunk.deleted)]
        if chunk.deleted:
            # Counts of the deleted tokens without themselves, in steps of an eighth of a power of two: a table of bounded size.
            rare = cw == k - 1
            c = (chunk.count - chunk.gone)[chunk.w[rare]]
            step = np.where(c > 0, 1 + np.floor(8 * np.log2(np.maximum(c, 1))), 0).astype(np.int64)
            code, at = np.unique(cu[rare] * STEPS + step, return_inverse=True)
            x.append(-1 - code)
            y.append(np.bincount(at, n[rare], len(code)).astype(np.int64))
            z.append(np.bincount(at, n[rare] * c, len(code)).astype(np.int64))
        rows.append({"kind": SUMS, "chunk": chunk.number, "bucket": chunk.number % (1 << dealing.split)} | {
            name: np.concatenate(v) for name, v in zip("xyz", (x, y, z), strict=True)})
        return pa.Table.from_batches([made(rows)])

    return run


#: Codes of count steps for each context class.
STEPS = 1024


def find_pairs(table: pa.Table) -> pa.Table:
    """The asked pairs of a bucket of all chunks -> their counts for each chunk; sums pass."""
    sums, asked = table.filter(pc.equal(table["kind"], SUMS)), table.filter(pc.equal(table["kind"], PAIRS))
    out = sums.to_batches()
    if len(asked):
        keys = [np.cumsum(unpack(a).view(np.uint64), dtype=np.uint64) for a in asked["a"].to_pylist()]
        n = np.concatenate([unpack(b) for b in asked["b"].to_pylist()])
        ends = np.cumsum([0] + [len(k) for k in keys])
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        deleted = np.repeat(asked["deleted"].to_numpy(), np.diff(ends))
        c, d = np.bincount(at, n).astype(np.int64), np.bincount(at, n * deleted).astype(np.int64)
        out.append(made([{
            "kind": FOUND_PAIRS, "chunk": chunk, "bucket": bucket, "deleted": gone, "c": pack(c[own]), "d": pack(d[own]) if gone else None}
            for chunk, bucket, gone, own in zip(
                asked["chunk"].to_pylist(), asked["bucket"].to_pylist(), asked["deleted"].to_pylist(), np.split(at, ends[1:-1]), strict=True)]))
    return pa.Table.from_batches(out, schema=ARROW)


def bucket_of(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64)


def learn_weights(m: np.ndarray, p: np.ndarray, bucket: np.ndarray, n_buckets: int, steps: int = 60) -> np.ndarray:
    """EM: held-out counts ``m`` of events with the order estimates ``p`` (rows x orders) -> weights per bucket."""
    orders = p.shape[1]
    w = np.full((n_buckets, orders), 1 / orders)
    for _ in range(steps):
        part = w[bucket] * p
        part *= (m / np.maximum(part.sum(1), 1e-300))[:, None]
        w = np.stack([np.bincount(bucket, part[:, i], n_buckets) for i in range(orders)], 1) + 1e-3
        w /= w.sum(1, keepdims=True)
    return w


class Model:
    """Orders 0 to 2 by class: class table, log10 chances of class targets, and (floor, slope) for all others.

    ``kept`` has the same without the deleted texts: pair chances, floor, slope, pair counts.
    """

    def __init__(self, place, n, v, words, pairs, held):
        """words: counts of the class words (n, d); pairs: (K, K) matrices n, d; held: (k, c, m) of deleted rare tokens."""
        self.place, self.n, self.v = place, n, v
        k = len(place) + 1
        all_, gone = pairs
        one = np.append(words[0], max(0, n - words[0].sum())).astype(float)
        one_kept = np.append(words[0] - words[1], max(0, n - gone.sum() - (words[0] - words[1]).sum())).astype(float)

        def estimates(pair, single, total):
            context = np.maximum(pair.sum(1, keepdims=True), 1)
            return pair / context, single / max(total, 1), pair.sum(1)

        two, first, context = estimates((all_ - gone).astype(float), one_kept, n - gone.sum())
        ctx, target = np.nonzero(gone[:, :-1])
        rows = [np.stack([np.full(len(ctx), 1 / (v + 1)), first[target], two[ctx, target]], 1)]
        m, b = [gone[ctx, target].astype(float)], [bucket_of(context)[ctx]]
        if len(held):
            hk, hc, hm = held[:, 0].astype(int), held[:, 1], held[:, 2]
            p2 = two[hk, -1] * hc / max(one_kept[-1], 1)
            rows.append(np.stack([np.full(len(hk), 1 / (v + 1)), hc / max(n - gone.sum(), 1), p2], 1))
            m.append(hm)
            b.append(bucket_of(context)[hk])
        self.weights = learn_weights(np.concatenate(m), np.concatenate(rows), np.concatenate(b), 64)
        w = self.weights[np.minimum(63, bucket_of(context))]
        self.kept = (
            w[:, :1] / (v + 1) + w[:, 1:2] * first[None, :-1] + w[:, 2:] * two[:, :-1], w[:, 0] / (v + 1),
            w[:, 1] / max(n - gone.sum(), 1) + w[:, 2] * two[:, -1] / max(one_kept[-1], 1), all_ - gone)
        self.counts, self.gone = all_, gone
        two, first, context = estimates(all_.astype(float), one, n)
        w = self.weights[np.minimum(63, bucket_of(context))]
        self.pair = w[:, :1] / (v + 1) + w[:, 1:2] * first[None, :-1] + w[:, 2:] * two[:, :-1]
        self.log_pair = np.log10(self.pair).astype(np.float32)
        self.floor = w[:, 0] / (v + 1)
        self.slope = w[:, 1] / max(n, 1) + w[:, 2] * two[:, -1] / max(one[-1], 1)
        self.log_base = np.log10((one[:-1] + 0.1) / (n + 0.1 * (v + 1)))
        self.known = one[:-1] > 0


def train(docs: DataFrame, *, doc_id: str, text: str, modulus: int, min_share: float) -> Model:
    """The model by class; its ``rows`` are the chunks of ``docs`` with the counts of their words and pairs, dealt as ``dealing`` says."""
    spark = docs.sparkSession
    parts = docs.select(
        id_bucket(F.col(doc_id), modulus).alias("bucket"), F.col(text).cast("string").alias("text"), F.col(doc_id).cast("bigint").alias("doc_id"))
    size = parts.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0)).alias("size")).first().size
    word_buckets, split = buckets_of(size, WORD_BYTES), buckets_of(size, PAIR_BYTES).bit_length() - 1
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid4().hex}"
    parts.mapInArrow(encode(word_buckets, CHUNK), ROWS).write.partitionBy("kind").parquet(path)
    coded = spark.read.schema(ROWS).parquet(path)
    texts = coded.where(F.col("kind") == TEXTS).select(*ARROW.names)
    n = texts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    asked = coded.where(F.col("kind") == ASKED).select(*ARROW.names)
    words = written(asked.groupBy("bucket").applyInArrow(find_words(word_buckets, min_share * n), ROWS))
    removed(spark, f"{path}/kind={ASKED}")
    frequent = words.where(F.col("kind") == FREQUENT)
    sums = frequent.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("v"), F.coalesce(F.max("chunk"), F.lit(0)).alias("most")).first()
    top = []
    for r in frequent.where(F.size("words") > 0).collect():  # 1 / min_share words at most
        top.extend(zip(map(bytes, r.words), unpack(r.a).tolist(), unpack(r.b).tolist(), unpack(r.c).tolist(), strict=True))
    top = sorted(top) or [(END, 0, 0, 0)]  # no text
    place = {w: i for i, (w, *_) in enumerate(top)}
    counts = np.array([t[1:3] for t in top], np.int64).T
    bits = max(1, split, (sums.most * word_buckets).bit_length())
    if 2 * bits - split > 64:
        raise ValueError("the pairs of so many words have no keys of 64 bits")
    dealing = Dealing(bits, split, np.array([t[3] for t in top], np.int64))
    found = words.where(F.col("kind") == FOUND)
    # A chunk and a bucket are bounded groups, whatever the corpus.
    pairs = texts.unionByName(found).groupBy("chunk").applyInArrow(ask_pairs(spark.sparkContext.broadcast(dealing)), ROWS)
    answers = written(pairs.groupBy("bucket").applyInArrow(find_pairs, ROWS))
    table = answers.where(F.col("kind") == SUMS).select(F.explode(F.arrays_zip("x", "y", "z")).alias("s")).groupBy("s.x").agg(
        F.sum("s.y").alias("y"), F.sum("s.z").alias("z")).toPandas()  # (1 / min_share + 2) squared rows and steps at most
    k = len(place) + 1
    by_class, held = table[table["x"] >= 0], table[table["x"] < 0]
    matrices = np.zeros((2, k * k), np.int64)
    matrices[0, by_class["x"]], matrices[1, by_class["x"]] = by_class["y"], by_class["z"]
    held = np.stack([(-1 - held["x"]) // STEPS, held["z"] / held["y"].clip(1), held["y"]], 1).astype(float) if len(held) else np.zeros((0, 3))
    model = Model(place, n, sums.v, counts, matrices.reshape(2, k, k), held)
    model.dealing = dealing
    model.rows = reduce(DataFrame.unionByName, [texts, found, answers.where(F.col("kind") == FOUND_PAIRS)])
    return model


class View(NamedTuple):
    """What the chances of pairs come from: of all training texts, or without the deleted ones."""

    dealing: Dealing
    pair: np.ndarray
    floor: np.ndarray
    slope: np.ndarray
    sums: np.ndarray

    def chances(self, chunk: Chunk, count: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the pairs of a chunk: the chance by class, that of the exact pair, and the bucket of its context (-1: not seen)."""
        other = len(self.dealing.numbers)
        cu, cw = chunk.classes[chunk.u], chunk.classes[chunk.w]
        by_class = np.where(cw < other, self.pair[cu, np.minimum(cw, other - 1)], self.floor[cu] + self.slope[cu] * count[chunk.w])
        seen = np.where(cu < other, self.sums[np.minimum(cu, other - 1)], count[chunk.u])
        return by_class, pairs / np.maximum(seen, 1), np.where(seen > 0, bucket_of(seen), -1)


def view(model: Model, kept: bool) -> View:
    pair, floor, slope, table = model.kept if kept else (model.pair, model.floor, model.slope, model.counts)
    return View(model.dealing, pair, floor, slope, table.sum(1)[:-1])


def ratios(shared):
    """A chunk of deleted texts -> b, step, m, r: its pairs with a rare word by context bucket and ratio of both chances, the sum of the ratios."""
    schema = pa.schema([("b", pa.int32()), ("step", pa.int32()), ("m", pa.int64()), ("r", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        seen: View = shared.value
        chunk = Chunk(table, seen.dealing)
        by_class, exact, bucket = seen.chances(chunk, chunk.count - chunk.gone, chunk.pairs - chunk.pairs_gone)
        other = len(seen.dealing.numbers)
        on = ((chunk.classes[chunk.u] == other) | (chunk.classes[chunk.w] == other)) & (bucket >= 0)
        m, b, r = np.bincount(chunk.pair, minlength=len(on))[on], bucket[on], exact[on] / by_class[on]
        # In steps of an eighth of a power of two, with the mean of each: a table of bounded size.
        step = np.where(r > 0, np.floor(8 * np.log2(np.where(r > 0, r, 1))), NEVER).astype(np.int64)
        (b, step), at = np.unique(np.stack([b, step]), axis=1, return_inverse=True)
        at = at.ravel()
        columns = b, step, np.bincount(at, m, len(b)), np.bincount(at, m * r, len(b))
        return pa.Table.from_arrays([pa.array(c.astype(t.to_pandas_dtype())) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return run


#: The step of pairs that the texts left have not.
NEVER = -(1 << 20)


def paired(docs: DataFrame, model: Model, *, doc_id: str, text: str, modulus: int) -> DataFrame:
    """The deleted texts' pairs with a rare word as ``ratios`` has them, a row per chunk, bucket and step.

    ``docs`` and the names are those ``model`` was trained with: their chunks and counts are not made again.
    """
    shared = docs.sparkSession.sparkContext.broadcast(view(model, kept=True))
    return model.rows.where("deleted").groupBy("chunk").applyInArrow(ratios(shared), "b int, step int, m bigint, r double")


def pair_weights(model: Model, events: DataFrame) -> np.ndarray:
    """The weight of the exact pairs per bucket, by the deleted texts; only the ratio of both chances counts."""
    binned = events.groupBy("b", "step").agg(F.sum("m").alias("m"), F.sum("r").alias("r")).toPandas()
    pair, _, _, table = model.kept
    sums, gone = table.sum(1), model.gone[:-1, :-1]
    u, w = np.nonzero(gone * (sums[:-1, None] > 0))
    ratio = np.concatenate([(binned["r"] / binned["m"]).to_numpy(float), table[u, w] / np.maximum(sums[u], 1) / pair[u, w]])
    m = np.concatenate([binned["m"].to_numpy(float), gone[u, w].astype(float)])
    b = np.concatenate([binned["b"].to_numpy(np.int64), bucket_of(sums)[u]])
    return learn_weights(m, np.stack([np.ones(len(m)), ratio], 1), b, 64)[:, 1]


def scored(shared, n: int, v: int):
    """A chunk -> a row per text."""
    def run(table: pa.Table) -> pa.Table:
        seen, weight = shared.value
        chunk = Chunk(table, seen.dealing)
        by_class, exact, bucket = seen.chances(chunk, chunk.count, chunk.pairs)
        share = np.where(bucket >= 0, weight[bucket], 0)
        chance = np.log10(by_class * (1 - share) + exact * share)
        base = np.log10((chunk.count + 0.1) / (n + 0.1 * (v + 1)))
        starts = np.cumsum(chunk.lengths) - chunk.lengths
        return pa.table({
            "doc_id": pa.array(chunk.ids, pa.int64()), "n_tokens": chunk.lengths, "n_known": np.add.reduceat((chunk.count > 0).astype(np.int64)[chunk.tokens], starts),
            "base_score": np.add.reduceat(base[chunk.tokens], starts), "score": np.add.reduceat(chance[chunk.pair], starts), "held_out": chunk.held})

    return run


def score_texts(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", modulus: int = 10, min_share: float = MIN_SHARE,
) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    if not 1 / 4000 <= min_share < 1:
        raise ValueError("min_share is from 1/4000 to 1: the table of class pairs stands in the memory of every task")
    model = train(docs, doc_id=doc_id, text=text, modulus=modulus, min_share=min_share)
    weight = pair_weights(model, paired(docs, model, doc_id=doc_id, text=text, modulus=modulus))
    shared = docs.sparkSession.sparkContext.broadcast((view(model, kept=False), weight))
    return model.rows.groupBy("chunk").applyInArrow(scored(shared, model.n, model.v), SCORES).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.n).cast("bigint").alias("train_tokens"), "base_score", "score")
