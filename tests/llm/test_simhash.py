import random

import numpy as np
import pytest
import xxhash

from ledgerline.llm.components import components
from ledgerline.llm.simhash import MIX, apart, ball, linked_sets, links, near_duplicates, run_edges, segment_count, segments, similar_texts

SCHEMA = "doc_id long, text string, fp string, component_id string, vertex int"


def brute_print(text, size, word=0):
    words = [w for w in text.translate({c: c + 32 for c in range(65, 91)}).encode().split()]
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    if word:
        full = (1 << 64) - 1
        hashes = [(h ^ MIX[word - 1] * (2 * word - 1) & full) * 0xFF51AFD7ED558CCD & full for h in hashes]
        hashes = [(h ^ h >> 32) * 0xC4CEB9FE1A85EC53 & full for h in hashes]
        hashes = [h ^ h >> 29 for h in hashes]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, edges):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return [find(i) for i in range(n)]


@pytest.mark.parametrize(("shingle", "distance", "bits"), [(3, 3, 64), (5, 20, 128)])
def test_against_brute_force(spark, shingle, distance, bits):
    rng = random.Random(7)
    rows = [(100, None), (101, ""), (102, " \n\t"), (103, "One two"), (104, "one TWO"), (105, "É é x y z")]
    for g in range(12):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(5, 300))]
        for c in range(6):
            words = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 40)):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 999)}"
            rows.append((g * 6 + c, " ".join(words)))
    rng.shuffle(rows)
    prints = [[brute_print(t or "", shingle, w) for w in range(bits // 64)] for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if sum((a ^ b).bit_count() for a, b in zip(prints[i], prints[j], strict=True)) <= distance]
    root = roots(len(rows), edges)
    least = {r: min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root)}
    want = {rows[i][0]: ("".join(f"{w:016x}" for w in prints[i]), least[root[i]]) for i in range(len(rows))}
    df = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(df, shingle=shingle, distance=distance, bits=bits).collect()}
    assert got == want


@pytest.mark.parametrize(("bits", "distance"), [(64, 3), (128, 20)])
def test_no_link_is_lost(spark, bits, distance):
    rng = np.random.default_rng(3)
    words = bits // 64
    prints = []
    for _ in range(12):
        base = int.from_bytes(rng.bytes(bits // 8), "little")
        for _ in range(80):
            p = base
            for b in rng.integers(0, bits, rng.integers(0, distance)):
                p ^= 1 << int(b)
            prints.append(p)
    prints = sorted(set(prints))
    rows = [(i, [((p >> 64 * w & (1 << 64) - 1) + (1 << 63)) % (1 << 64) - (1 << 63) for w in range(words)]) for i, p in enumerate(prints)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vertex long, fp array<long>, size long")
    got = [(r.a, r.b) for r in links(df, bits, distance).collect()]
    want = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= distance]
    assert all((prints[a] ^ prints[b]).bit_count() <= distance for a, b in got)
    assert roots(len(prints), got) == roots(len(prints), want)


def test_long_run_gives_a_forest():
    rng = np.random.default_rng(1)
    fp = np.unique((np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)))
    edges = run_edges(np.arange(len(fp)), fp[:, None], np.ones(len(fp), bool), np.zeros(len(fp), int), 3, 0.0)
    near = apart(fp[:, None, None], fp[None, :, None]) <= 3
    assert roots(len(fp), edges) == roots(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if near[i, j]])
    assert len(edges) < len(fp)


def test_segments_hold_the_pigeonhole():
    for bits, distance in ((64, 3), (64, 0), (64, 7), (128, 20), (128, 17)):
        parts = segments(bits, segment_count(bits, distance))
        assert sum(w for _, _, w in parts) == bits and distance // len(parts) <= (1 if bits == 64 else 2)
    assert len(ball(16, 2)) == 137


def test_odd_input(spark):
    rows = [(None, "a b c d"), (1, "a b c d"), (1, "a b c d"), (None, "q r s t u v w"), (2, "x" * 500_000), (3, "w " * 200_000)]
    got = near_duplicates(spark.createDataFrame([(i, t, "a", "b", 1) for i, t in rows], SCHEMA)).collect()
    assert len(got) == 6
    assert sorted((r.component_id for r in got), key=lambda x: (x is None, x)) == [1, 1, 1, 2, 3, None]
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sizes_that_rule_out_the_similarity_are_not_linked():
    rng = np.random.default_rng(4)
    size = rng.integers(1, 60, 700)
    fp = rng.integers(0, 1 << 12, (700, 1)).astype(np.uint64)
    edges = run_edges(np.arange(700), fp, np.ones(700, bool), size, 2, 0.8)
    want = [(i, j) for i in range(700) for j in range(i) if int(fp[i, 0] ^ fp[j, 0]).bit_count() <= 2 and 5 * min(size[i], size[j]) >= 4 * max(size[i], size[j])]
    assert roots(700, edges) == roots(700, want)


def test_blocks_of_a_component_meet(spark):
    rng = random.Random(8)
    rows = []
    for g in range(3):
        words = [f"w{rng.randint(0, 9000)}" for _ in range(200)]
        for _ in range(25):  # a chain: each text differs a little from the last one
            words[rng.randrange(200)] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(words)))
    rng.shuffle(rows)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(196)} for _, t in rows]
    edges = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    root = roots(len(rows), edges)
    want = {rows[i][0]: min(rows[j][0] for j in range(len(rows)) if root[j] == root[i]) for i in range(len(rows))}
    df = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in [*rows, rows[0]]], SCHEMA)
    for size in (4, 512):
        assert {r.doc_id: r.component_id for r in similar_texts(df, block_texts=size).collect()} == want


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (7, 7)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.vertex: r.component for r in components(df).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_sets_are_linked_as_brute_force_links_them():
    rng = np.random.default_rng(5)
    for _ in range(40):
        sets = [np.zeros(0, np.uint64)] * 2
        for _ in range(6):
            base = rng.integers(0, 1 << 62, rng.integers(1, 60)).astype(np.uint64)
            for _ in range(5):
                x = base.copy()
                x[rng.random(len(x)) < rng.choice([0, 0.05, 0.12, 0.3])] = rng.integers(0, 40)
                sets.append(np.unique(x))
        alike = lambda a, b: not len(a) | len(b) or 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b))
        edges = [(i, j) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j])]
        assert linked_sets(sets, 0.8).tolist() == roots(len(sets), edges)


def test_only_similar_texts_are_linked(spark):
    rng = random.Random(12)
    base = [f"w{rng.randint(0, 9000)}" for _ in range(300)]

    def changed(n):
        return " ".join("new" + str(rng.random()) if i % (300 // n) == 7 else w for i, w in enumerate(base))

    # five shingles go with each word changed: 5 n of 296, so J = (296 - 5 n) / (296 + 5 n) is 0.84 of 5 words and 0.71 of 10
    texts = [(1, " ".join(base)), (2, changed(5)), (3, changed(10)), (4, "  ".join(base).upper()), (None, changed(2)), (6, None), (7, " "), (7, "other text of one kind"), (8, "one two")]
    got = similar_texts(spark.createDataFrame([(i, t, "a", "b", 1) for i, t in texts], SCHEMA)).collect()
    near = near_duplicates(spark.createDataFrame([(i, t, "a", "b", 1) for i, t in texts[:3]], SCHEMA), shingle=5, distance=23, bits=128).collect()
    assert {r.doc_id: r.component_id for r in near}[3] == 1  # fingerprints alone link the third text
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 1), (1, 1), (2, 1), (3, 3), (4, 1), (6, 6), (7, 6), (7, 7), (8, 8)]
    assert similar_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_no_edges_need_no_python_workers(spark):
    got = components(spark.createDataFrame([], "u long, v long"))
    assert got.dtypes == [("vertex", "bigint"), ("component", "bigint")] and not got.collect()
    assert "RDD" not in got._jdf.queryExecution().toString()
