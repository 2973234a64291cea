"""Clustering, hard negatives and exact duplicates against plain versions of their contracts."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from logwarden.llm import centroids, exact_dedup, hard_negatives
from logwarden.llm.vectors import products

VECTORS = "vec_id bigint, embedding array<float>, label int, id int, v int, cluster int, hash int"


def vector_rows(spark, rows):
    """Rows with columns that have the names operators use inside."""
    return spark.createDataFrame([(i, v, label, 1, 2, 3, 4) for i, v, label in rows], VECTORS)


def clumps(seed, n, dim, groups=6):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, dim))
    return [[float(np.float32(x)) for x in middles[i % groups] + rng.normal(size=dim) * 0.3] for i in range(n)]


ODD = [None, [], [0.5], [float("nan"), 0.0], [float("inf"), 0.0], [None, 0.25]]


# --- clustering ------------------------------------------------------------

def plain_lloyd(rows, k, rounds, scale, dim, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v, _ in rows
            if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centers))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        for n, vs in members.items():
            centers[n] = [sum(x) // len(vs) for x in zip(*vs)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = defaultdict(int)
    for _, c, d in found:
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in found), key=repr)


def clustered(df, **options):
    return sorted((tuple(r) for r in centroids.cluster_report(df, **options).collect()), key=repr)


@pytest.mark.parametrize(("n", "dim", "k", "rounds"), [(400, 8, 8, 10), (300, 2, 5, 4), (60, 3, 20, 10), (90, 4, 1, 3)])
def test_clusters_are_those_of_plain_rounds(spark, n, dim, k, rounds):
    rows = [(i, v, 0) for i, v in enumerate(clumps(n, n, dim))]
    rows += [(1000, rows[3][1], 0), (1000, rows[3][1], 0), (None, rows[5][1], 1), (2000, [0.0] * dim, None)]  # copies, a null id
    rows += [(3000 + i, v, 0) for i, v in enumerate(ODD)]
    options = {"k": k, "rounds": rounds, "dim": dim, "scale": 64, "seed": 3}
    want = plain_lloyd(rows, k, rounds, 64, dim, 3)
    for parts in (1, 5):
        assert clustered(vector_rows(spark, rows).repartition(parts), **options) == want


def test_equal_vectors_go_to_the_smaller_number(spark):
    rows = [(i, [1.0, 1.0], 0) for i in range(12)]
    found = clustered(vector_rows(spark, rows), k=4, dim=2)
    assert {r[1] for r in found} == {0} and {r[2] for r in found} == {0}


def test_few_or_no_vectors(spark):
    assert clustered(vector_rows(spark, [(i, v, 0) for i, v in enumerate(ODD)])) == []
    assert clustered(vector_rows(spark, [])) == []
    assert [r[:3] for r in clustered(vector_rows(spark, [(1, [0.5, 0.5], 0), (2, [4.0, 0.0], 0)]), k=8, dim=2)] in (
        [(1, 0, 0), (2, 1, 0)], [(1, 1, 0), (2, 0, 0)])
    with pytest.raises(Exception, match="not exact"):
        clustered(vector_rows(spark, [(1, [1e30, 0.0], 0)]), dim=2)


def test_bounds_spare_comparisons(spark):
    rows = [(i, v, 0) for i, v in enumerate(clumps(5, 600, 8))]
    found = centroids.fit(vector_rows(spark, rows), dim=8)
    assert found.compared[0] == 600 and sum(found.compared[1:]) < 0.5 * 600 * len(found.compared[1:])


def test_planar_loss_holds_and_is_less_than_the_drift():
    rng = np.random.default_rng(1)
    smaller = 0
    for trial in range(300):
        dim = int(rng.integers(2, 6))
        centre, old = rng.normal(size=dim) * 5, rng.normal(size=(4, dim)) * 5
        new, radius = old + rng.normal(size=(4, dim)) * rng.choice([0.01, 1, 5]), float(rng.choice([0, 0.5, 2, 8]))
        loss = centroids.planar_loss(centre, radius, old, new)
        drift = centroids.lengths(new - old)
        x = rng.normal(size=(400, dim))
        x = centre + radius * x / np.linalg.norm(x, axis=1)[:, None] * rng.uniform(0, 1, (400, 1)) ** 0.2
        came = centroids.lengths(x[:, None] - old[None]) - centroids.lengths(x[:, None] - new[None])
        assert (came <= loss + 1e-9).all() and (loss <= drift).all() and (loss >= 0).all()
        smaller += (loss < 0.9 * drift).sum()
    assert smaller > 300


# --- hard negatives ----------------------------------------------------------

def plain_negatives(rows, anchor, scale, positives, negatives):
    seen = {(i, label, tuple(math.floor(scale * x) for x in v)) for i, v, label in rows
            if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, label, v in seen:
        if i % anchor:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in seen if j != i and len(w) == len(v))
        for p, pid, _ in [s for s in scored if s[2] == label][:positives]:
            inside = [(s, j) for s, j, m in scored if m != label and 50 * -p <= 100 * -s <= 95 * -p][:negatives]
            out += [(i, pid, n + 1, j, -p, -s) for n, (s, j) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize(("row_block", "anchor_block"), [(8192, 4096), (37, 5)])
def test_negatives_are_those_of_the_windows(spark, row_block, anchor_block):
    rng = random.Random(2)
    vs = clumps(7, 260, 6, groups=3)
    rows = [(i, [round(x, 1) for x in v], rng.choice([0, 0, 0, 0, 1, 2])) for i, v in enumerate(vs)]  # ties, a common label
    rows += [rows[4], rows[4], (10, rows[9][1], 1), (None, vs[0], 0), (20, vs[0], None), (401, [1.0], 0), (410, [2.0], 1), (420, [2.0], 0)]
    rows += [(500 + i, v, 0) for i, v in enumerate(ODD)]
    df = vector_rows(spark, rows).repartition(4)
    for scale, k in ((16, 3), (1, 2)):
        found = hard_negatives.mine_hard_negatives(
            df, lambda i: i % 10 == 0, scale=scale, negatives=k, row_block=row_block, anchor_block=anchor_block)
        want = plain_negatives(rows, 10, scale, 5, k)
        assert want and sorted(tuple(r) for r in found.collect()) == want


def test_negatives_do_not_depend_on_how_blocks_are_dealt(spark):
    """Every cell in a partition of its own: rows and anchors must still meet."""
    rng = random.Random(5)
    rows = [(i, v, rng.choice([0, 1, 2])) for i, v in enumerate(clumps(8, 400, 6, groups=3))]
    want = plain_negatives(rows, 10, 16, 5, 3)
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "31")
        for blocks in ((50, 7), (8192, 4096)):
            found = hard_negatives.mine_hard_negatives(
                vector_rows(spark, rows), lambda i: i % 10 == 0, scale=16, row_block=blocks[0], anchor_block=blocks[1])
            assert sorted(tuple(r) for r in found.collect()) == want
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_negative_scores_and_empty_tables_have_no_negatives(spark):
    def mined(rows):
        return hard_negatives.mine_hard_negatives(vector_rows(spark, rows), lambda i: i == 0, scale=1).collect()

    assert mined([]) == []
    assert mined([(0, [1.0], 0), (1, [-1.0], 0), (2, [-1.0], 1)]) == []
    assert mined([(1, [1.0], 0), (2, [1.0], 1)]) == []  # no anchor
    assert [tuple(r) for r in mined([(0, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.0, 9.0], 1)])] == [(0, 1, 1, 2, 0, 0)]


def test_products_of_large_numbers_are_exact():
    a = np.array([[(1 << 27), 3]], np.int64)
    assert int(products(a, a)[0, 0]) == (1 << 54) + 9


# --- exact duplicates --------------------------------------------------------

def plain_report(rows, normalise=lambda t: t):
    groups = defaultdict(list)
    for i, t in rows:
        groups[normalise(t or "")].append(i)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        first = True
        for i in sorted(ids, key=lambda i: i != keep):
            out.append((i, keep, len(ids), first, hashlib.sha256(t.encode()).hexdigest()))
            first = False
    return sorted(out, key=repr)


def reported(df, **options):
    return sorted((tuple(r) for r in exact_dedup.duplicate_report(df, **options).collect()), key=repr)


def copies(docs, seed=1, n=400):
    rng = random.Random(seed)
    texts = [None, "", " ", "hot text " * 40] + ["text %d %s" % (i, "x" * rng.randint(0, 300)) for i in range(60)]
    rows = [(rng.choice([i, i, i, None, 7]), texts[3] if rng.random() < 0.4 else rng.choice(texts), "s") for i in range(n)]
    return rows, docs(*rows, extra=True)


@pytest.mark.parametrize(("table_bytes", "bucket_bytes", "parts"), [(64 << 20, 24 << 20, 3), (900, 1 << 20, 5), (1, 500, 2)])
def test_copies_with_large_and_tiny_tables(docs, table_bytes, bucket_bytes, parts):
    rows, df = copies(docs)
    want = plain_report([(i, t) for i, t, _ in rows])
    assert reported(df.repartition(parts), table_bytes=table_bytes, bucket_bytes=bucket_bytes) == want


def test_equal_hashes_are_told_apart_by_content():
    table = exact_dedup.ContentTable(1 << 20)
    for n in range(3000):  # one hash for all, so only contents differ
        assert table.add(5, b"%d" % (n % 1500), 1, n, 1)
    assert len(table.entries) == 1500 and table.entries[0] == [b"0", 2, 1500, 1]
    full = exact_dedup.ContentTable(3)
    assert full.add(1, b"abcd", 1, None, 1) and not full.add(1, b"b", 1, 2, 1) and full.add(1, b"abcd", 2, 9, 1)
    assert full.entries == [[b"abcd", 3, 9, 1]]


def test_rows_that_stay_have_all_columns_and_normalised_texts_are_equal(docs):
    rows, df = copies(docs, 3)
    kept = exact_dedup.drop_duplicates(df)
    assert kept.columns == df.columns
    want = sorted((r[0], r[4]) for r in [(str(i), k, n, kept, sha) for i, k, n, kept, sha in plain_report([(i, t) for i, t, _ in rows])] if r[3])
    got = sorted((str(r.doc_id), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in kept.collect())
    assert got == want
    both = docs((1, "A b", "s"), (2, "a B", "s"), (3, "a b c", "s"))
    assert reported(both, normalise=F.lower) == plain_report([(1, "a b"), (2, "a b"), (3, "a b c")])
    texts = both.select(F.concat(F.lit("id"), F.col("doc_id")).alias("doc_id"), F.lower("text").alias("text"))
    assert [r.keep_id for r in exact_dedup.duplicate_report(texts).orderBy("doc_id").collect()] == ["id2", "id2", "id3"]


def test_odd_and_empty_documents(odd, none):
    assert reported(none) == [] and exact_dedup.drop_duplicates(none).count() == 0
    assert reported(odd) == plain_report([(r.doc_id, r.text) for r in odd.collect()])
