"""N-gram Jaccard join: pairs of texts that share most of their word n-grams.

Texts are bytes with A-Z in lower case, cut at ASCII white space; a text has the set of its
runs of ``n`` words (a shorter text: all its words), as 64-bit hashes.  Equal texts are
one class with its smallest id.  Classes are joined by MinHash banding: ``rows`` per
band are given, the number of bands follows from the target recall at the threshold.
Texts that share a band are linked to the smallest class of that band (never to each
other), those links give candidate groups, and inside a group all pairs are verified on
the full sets.  A group is cut into blocks of about ``block`` texts and every pair
of blocks is a task of its own that returns one row per text (its number of links and
one tie), so neither a large group nor its pairs ever meet in one place.

Null texts count as empty; texts without words have no links.  Null ids are allowed;
repeated rows are copies.  No links are dropped: there is no cap on buckets, groups or
partners.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

N = 5
THRESHOLD = 0.8
RECALL = 0.9999
ROWS = 5
BLOCK = 1024
SEED = 11
MIX = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(threshold: float, recall: float, rows: int) -> int:
    """Fewest bands that find a pair at the threshold with the target probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def ngrams(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams of a text; empty without words."""
    ws = (text or "").encode("utf-8", "replace").lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.array([xxhash.xxh64_intdigest(w) for w in ws], dtype=np.uint64)
    k = min(n, len(ws))
    out = np.zeros(len(ws) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mixed(out * MIX + h[i:i + len(out)] + np.uint64(i + 1))
    return np.unique(out)


def bands_udf(n: int, rows: int, bands: int):
    rng = np.random.default_rng(SEED)
    a = rng.integers(1, 1 << 63, rows * bands, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 63, rows * bands, dtype=np.uint64)
    number = np.arange(1, bands + 1, dtype=np.uint64)

    @F.pandas_udf("array<bigint>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            grams = ngrams(text, n)
            if not len(grams):
                out.append(None)
                continue
            with np.errstate(over="ignore"):
                least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(grams), 256):
                    part = grams[at:at + 256]
                    h = a[:, None] * part[None, :] + b[:, None]
                    np.minimum(least, (h ^ (h >> np.uint64(32))).min(1), out=least)
                key = number.copy()
                for r in least.reshape(bands, rows).T:
                    key = mixed(key * MIX + r)
            out.append(key.view(np.int64))
        return pd.Series(out)

    return run


def stars(edges: DataFrame) -> DataFrame:
    """u, v (v < u) of an undirected graph -> node, root: the smallest node of each component.

    Every round each node tells its neighbours the smallest of them all; rows stay linear in
    the edges, a hub is a partial minimum, and the rounds are logarithmic in the longest
    path.  Each round is written to the checkpoint folder.
    """
    edges = saved(edges.where("u != v").distinct())
    state = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        told = both.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = saved(told.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now.n, now.h) == state:
            break
        state = (now.n, now.h)
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def linked(a: list[np.ndarray], b: list[np.ndarray], threshold: float, width: int = 4096) -> np.ndarray:
    """Matrix of the pairs with a Jaccard similarity of the threshold or more."""
    rows = np.concatenate([np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b]) + len(a)])
    grams, inverse, counts = np.unique(np.concatenate([*a, *b]), return_inverse=True, return_counts=True)
    shared = counts[inverse] > 1
    rows, cols = rows[shared], inverse[shared]
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    used = np.cumsum(np.concatenate([[0], (np.diff(cols) > 0).astype(np.int64)])) if len(cols) else cols
    both = np.zeros((len(a), len(b)), np.float32)
    at, end = 0, int(used[-1]) + 1 if len(used) else 0
    edges = np.searchsorted(used, np.arange(0, end + width, width)) if end else np.zeros(1, np.int64)
    for i in range(len(edges) - 1):
        at, to = edges[i], edges[i + 1]
        part = np.zeros((len(a) + len(b), width), np.float32)
        part[rows[at:to], used[at:to] - i * width] = 1
        both += part[:len(a)] @ part[len(a):].T
    size_a = np.array([len(x) for x in a], np.float64)[:, None]
    size_b = np.array([len(x) for x in b], np.float64)[None, :]
    return both >= threshold * (size_a + size_b - both) - 1e-9


def verify(threshold: float):
    """Texts of two blocks -> per text its links, the rows behind them, and the smallest text it is tied to."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("key").sort_values("key", kind="stable")
        i, j = int(pdf["i"].iat[0]), int(pdf["j"].iat[0])
        sets = [np.asarray(x, np.int64) for x in pdf["grams"]]
        at = np.flatnonzero(pdf["block"].to_numpy() == i)
        to = at if i == j else np.flatnonzero(pdf["block"].to_numpy() == j)
        links = np.zeros(len(pdf), np.int64)
        copies = np.zeros(len(pdf), np.int64)
        root = np.arange(len(pdf))
        if len(at) and len(to):
            ok = linked([sets[x] for x in at], [sets[x] for x in to], threshold)
            size = pdf["class_size"].to_numpy(np.int64)
            if i == j:
                np.fill_diagonal(ok, False)
            links[at] += ok.sum(1)
            copies[at] += ok @ size[to]
            if i != j:
                links[to] += ok.sum(0)
                copies[to] += ok.T @ size[at]
            while True:
                before = root.copy()
                low = np.where(ok, root[to][None, :], len(pdf)).min(1)
                root[at] = np.minimum(root[at], low)
                low = np.where(ok, root[at][:, None], len(pdf)).min(0)
                root[to] = np.minimum(root[to], low)
                if (before == root).all():
                    break
        keys = pdf["key"].to_numpy()
        return pd.DataFrame({"key": keys, "links": links, "copies": copies, "tie": keys[root]})

    return run


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def similar_texts(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", n: int = N, threshold: float = THRESHOLD,
    recall: float = RECALL, rows: int = ROWS, block: int = BLOCK,
) -> DataFrame:
    """A row per class of equal texts: key, class_id, class_size, id_rows, n_links, n_linked_rows, group_id, first.

    n_links counts other classes with a similarity of the threshold or more, n_linked_rows
    their rows; group_id is the smallest class_id over chains of links, first marks the class
    that has it; id_rows is the number of rows with the id class_id.
    """
    bands = choose_bands(threshold, recall, rows)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    signed = own.select("doc_id", text_key(F.col("text")).alias("key"), bands_udf(n, rows, bands)(F.col("text")).alias("bands"))
    by_id = signed.groupBy("key", "doc_id").agg(F.count("*").alias("c"), F.first("bands").alias("bands"))
    classes = saved(by_id.groupBy("key").agg(
        F.min("doc_id").alias("class_id"), F.sum("c").alias("class_size"),
        F.coalesce(F.min_by("c", "doc_id"), F.max("c")).alias("id_rows"), F.first("bands").alias("bands")))

    banded = classes.select("key", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("key").alias("low"), F.count("*").alias("c")).where("c > 1").select("band", "low")
    candidates = stars(banded.join(shared, "band").select(F.col("key").alias("u"), F.col("low").alias("v")))
    candidates = candidates.withColumnsRenamed({"node": "key", "root": "comp"})
    sizes = candidates.groupBy("comp").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    members = saved(candidates.join(sizes, "comp").join(classes.select("key", "class_id", "class_size"), "key").withColumn(
        "block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")))

    @F.pandas_udf("array<bigint>")
    def grams(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: ngrams(t, n).view(np.int64))

    # One text for each class: the rows of its smallest id.
    texts = own.select("doc_id", "text", text_key(F.col("text")).alias("key"))
    found = texts.join(members, (texts["key"] == members["key"]) & texts["doc_id"].eqNullSafe(members["class_id"])).select(
        members["key"], "comp", "blocks", "block", "class_size", grams(F.col("text")).alias("grams"))
    dealt = found.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "key", "comp", "block", "class_size", "grams", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    checked = saved(dealt.groupBy("comp", "i", "j").applyInPandas(
        verify(threshold), "key binary, links bigint, copies bigint, tie binary"))

    groups = stars(checked.where("key != tie").select(F.greatest("key", "tie").alias("u"), F.least("key", "tie").alias("v")))
    groups = groups.withColumnsRenamed({"node": "key"})
    counts = checked.groupBy("key").agg(F.sum("links").alias("links"), F.sum("copies").alias("copies"))
    in_groups = groups.join(classes.select("key", "class_id"), "key")
    least = in_groups.groupBy("root").agg(F.min(F.struct(F.col("class_id").isNull(), "class_id", "key")).alias("least"))
    ids = in_groups.join(least, "root").select(
        "key", F.col("least.class_id").alias("group_id"), (F.col("key") == F.col("least.key")).alias("first"))
    df = classes.drop("bands").join(counts, "key", "left").join(ids, "key", "left")
    return df.select(
        "key", "class_id", "class_size", "id_rows", F.coalesce("links", F.lit(0)).alias("n_links"),
        F.coalesce("copies", F.lit(0)).alias("n_linked_rows"),
        F.when(F.col("first").isNotNull(), F.col("group_id")).otherwise(F.col("class_id")).alias("group_id"),
        F.coalesce("first", F.lit(True)).alias("first"))


def link_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """A row per document: doc_id, class_id, class_size, n_links, n_linked_rows, group_id."""
    classes = similar_texts(docs, doc_id=doc_id, text=text, **options)
    ids = docs.select(F.col(doc_id).alias("doc_id"), text_key(F.col(text)).alias("key"))
    return ids.join(classes, "key").select("doc_id", "class_id", "class_size", "n_links", "n_linked_rows", "group_id")


def drop_similar(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each group: the one with the smallest id; the columns of ``docs``."""
    classes = similar_texts(docs, doc_id=doc_id, text=text, **options)
    first = classes.where("first").select(F.col("key").alias("__llm_key"), F.col("class_id").alias("__llm_id"), F.col("id_rows").alias("__llm_rows"))
    kept = docs.join(first, (text_key(F.col(text)) == F.col("__llm_key")) & F.col(doc_id).eqNullSafe(F.col("__llm_id")))
    # A row that stands in the table several times: one of its copies stays.
    once = kept.where("__llm_rows > 1").dropDuplicates(["__llm_key"])
    return kept.where("__llm_rows = 1").unionByName(once).select(*docs.columns)
