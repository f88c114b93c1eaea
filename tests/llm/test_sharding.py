import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm.sharding import pack, place, shards

SCHEMA = "doc_id long, text string, shard string, slot int, size string"


def test_rows_land_once_and_sizes_are_near_equal(spark):
    rng = random.Random(1)
    rows = [(i, "word " * rng.choice([0, 1, 3, 50, 400])) for i in range(2000)] + [(i, "the very same text") for i in range(5000, 6000)] + [(7001, None), (7002, ""), (None, "n"), (None, "n"), (3, "again"), (7003, "é" * 20_000)]
    got = shards(spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA), n_shards=8, cell_items=150, fan=2, numbered=50).collect()
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == want
    slots, sizes, counts = defaultdict(list), defaultdict(int), defaultdict(int)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
        counts[r.shard] += 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes.values()) / 8
    assert max(sizes.values()) <= 1.02 * mean and min(sizes.values()) >= 0.98 * mean
    assert max(counts.values()) <= 1.35 * len(rows) / 8


def greedy(vectors, bins):
    """The rule itself, in plain Python."""
    total = [sum(v[d] for v in vectors) or 1 for d in range(3)]
    share = [[v[d] / total[d] * bins for d in range(3)] for v in vectors]
    residual = [[1.0] * 3 for _ in range(bins)]
    out = [0] * len(vectors)
    for i in sorted(range(len(vectors)), key=lambda i: (-max(share[i]), i)):
        dots = [sum(r * s for r, s in zip(residual[b], share[i], strict=True)) for b in range(bins)]
        out[i] = b = max(range(bins), key=lambda b: (dots[b], -b))
        residual[b] = [r - s for r, s in zip(residual[b], share[i], strict=True)]
    return out


def test_packing_is_the_greedy_rule():
    rng = np.random.default_rng(8)
    for _ in range(30):
        v = rng.integers(0, 50, (rng.integers(1, 40), 3)) + np.array([1, 0, 1])
        assert pack(v, 4).tolist() == greedy(v.tolist(), 4)


@pytest.mark.parametrize(("cell_items", "fan"), [(8192, 32), (40, 3)])
def test_equal_texts_stay_together(spark, cell_items, fan):
    rows = [(i, f"t{i // 2} " + "w " * (i // 2 % 90)) for i in range(1000)] + [(2000 + i, "many copies of a text") for i in range(130)]
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA)
    got = shards(df, n_shards=8, cell_items=cell_items, fan=fan).collect()
    where = defaultdict(set)
    text = dict(rows)
    for r in got:
        where[text[r.doc_id]].add(r.shard)
    assert len(got) == len(rows) and all(len(s) == 1 for s in where.values())
    sizes = defaultdict(int)
    for r in got:
        sizes[r.shard] += r["size"]
    mean, near = sum(sizes.values()) / 8, 0.02 if cell_items > 40 else 0.25  # cells of 40 items have five to a bin
    assert max(sizes.values()) <= (1 + near) * mean and min(sizes.values()) >= (1 - near) * mean


def test_no_group_of_the_test_table_is_split(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = shards(docs).withColumn("g", F.col("text_crc32"))
    row = got.join(docs.select("doc_id", "text"), "doc_id").groupBy("text").agg(F.countDistinct("shard").alias("s"), F.max("part").alias("p")).agg(F.max("s"), F.max("p")).first()
    assert tuple(row) == (1, 0)


def test_a_group_beyond_a_shard_is_dealt(spark):
    rows = [(i, "the very same text of a third of all") for i in range(400)] + [(None, "another that has no ids at all") for _ in range(300)] + [(1000 + i, f"text {i}") for i in range(300)]
    got = shards(spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA), n_shards=10).collect()
    counts = Counter(r.shard for r in got)
    assert sum(counts.values()) == 1000 and max(counts.values()) <= 140 and set(counts) == set(range(10))


def test_few_and_no_rows(spark):
    assert shards(spark.createDataFrame([], SCHEMA)).count() == 0
    one = shards(spark.createDataFrame([(1, "a", "", 1, "")], SCHEMA)).collect()
    assert len(one) == 1 and one[0].slot == 0


def test_packing_balances_every_dimension():
    rng = np.random.default_rng(2)
    v = np.stack((rng.integers(1, 1000, 4000), rng.integers(1, 50, 4000), np.ones(4000, int)), axis=1)
    out = pack(v, 10)
    sums = np.array([v[out == b].sum(axis=0) for b in range(10)])
    assert (np.abs(sums / sums.mean(axis=0) - 1) < 0.02).all()
    even = np.array([v[place(v, 10) == b, 0].sum() for b in range(10)])
    assert np.ptp(even) <= np.ptp(sums[:, 0])
