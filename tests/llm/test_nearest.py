from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm.ann import DIMENSIONS, Tree, box_distance, buckets, chi_square, nearest, quantile

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, ids int"


def brute(rows, asks, k):
    ok = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in (i for i in ok if asks(i)):
        scored = sorted((-float(ok[j] @ ok[q]), j) for j in ok if j != q and len(ok[j]) == len(ok[q]))
        out[q] = scored[:k]
    return out


def run(spark, rows, every, k, **options):
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)
    got = {}
    for r in nearest(df, F.col("vec_id") % every == 0, k=k, **options).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: sorted(x) for q, x in got.items()}


def vectors(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, d))
    return [(int(i), (centres[rng.integers(12)] + 0.6 * rng.standard_normal(d)).astype(np.float32).tolist()) for i in range(n)]


def test_recall_and_order(spark):
    rows = vectors(3000, 24, 1)
    got = run(spark, rows, 20, 20, shard_rows=300)
    want = brute(rows, lambda i: i % 20 == 0, 20)
    assert set(got) == set(want)
    hits = 0
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in [i for _, i, _ in found]
        scores = [s for _, _, s in found]
        assert all(a >= b for a, b in zip(scores, scores[1:], strict=False))
        hits += len({i for _, i, _ in found} & {i for _, i in want[q]})
    assert hits / (20 * len(want)) >= 0.9


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_and_verified_share_of_the_test_tables(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in df.collect() if r.embedding is not None and len(r.embedding) == 64}
    ids, x = np.array(list(rows)), np.stack(list(rows.values()))
    got, verified = defaultdict(set), {}
    for r in nearest(df, F.col("vec_id") % 20 == 0, k=20, shard_rows=500).collect():
        got[r.query_id].add(r.vec_id)
        verified[r.query_id] = r.verified
    hits = 0
    for i in got:
        s = x @ rows[i]
        s[ids == i] = -np.inf
        hits += len(got[i] & set(ids[np.argsort(-s, kind="stable")[:20]].tolist()))
    share = np.mean(list(verified.values())) / len(rows)
    print(f"{sf}: recall {hits / (20 * len(got)):.3f}, verified share {share:.3f}")
    assert hits / (20 * len(got)) >= 0.9 and share < 0.95


def test_the_verified_share_falls_as_rows_grow(spark):
    share = {}
    for n in (1200, 6000):
        df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in vectors(n, 24, 1)], SCHEMA)
        share[n] = nearest(df, F.col("vec_id") % 100 == 0, k=10, shard_rows=600, certainty=0.9).agg(F.avg("verified")).first()[0] / n
    assert share[6000] < share[1200] < 0.5, share


def test_copies_ties_and_odd_vectors(spark):
    rows = vectors(300, 8, 2)
    same = rows[5][1]
    rows += [(i, list(same)) for i in range(400, 700)]
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0] * 7 + [float("inf")]), (1004, [1.0] * 7 + [None]), (None, [1.0] * 8), (1020, [1.0] * 3), (20, rows[20][1])]
    got = run(spark, rows, 20, 20, shard_rows=100, certainty=1 - 1e-9)
    want = brute(rows, lambda i: i % 20 == 0 and i != 1020, 20)
    assert set(got) == set(want)
    for q in (400, 420, 680):  # copies of the hot vector: the least other ids, all of one score
        assert [i for _, i, _ in sorted(got[q])[:20]] == [i for _, i in want[q]]
    assert len(got[20]) == 40  # a row repeated asks twice


def test_few_candidates(spark):
    assert run(spark, [], 1, 5) == {}
    assert run(spark, [(1, [1.0, 2.0])], 1, 5) == {}
    got = run(spark, [(1, [1.0, 2.0]), (2, [2.0, 1.0]), (3, [-1.0, 0.0])], 1, 5)
    assert [i for _, i, _ in got[1]] == [2, 3]


def test_parts():
    rng = np.random.default_rng(0)
    x = rng.chisquare(DIMENSIONS, 20_000)
    assert all(abs((x <= q).mean() - chi_square(np.array(q))) < 0.01 for q in (8.0, 15.0, 24.0))
    assert all(abs(chi_square(np.array(quantile(c))) - c) < 1e-9 for c in (0.5, 0.9, 0.999))
    p = rng.standard_normal((500, 8))
    groups, low, high = buckets(p, 40)
    assert sorted(np.concatenate(groups).tolist()) == list(range(500)) and max(map(len, groups)) <= 40
    q = rng.standard_normal(8)
    for i, g in enumerate(groups):
        assert ((p[g] - q) ** 2).sum(axis=1).min() >= box_distance(q, low, high)[i] - 1e-9
    tree = Tree.grown(p, 3)
    assert set(tree.leaf(p).tolist()) <= set(range(8)) and np.bincount(tree.leaf(p)).min() > 40
