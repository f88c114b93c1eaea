import random

import numpy as np
import pytest

from ledgerline.llm.substring import intervals, repeated_substrings, seal, unseal

SCHEMA = "doc_id long, text string, n_words string, kept string"


def brute(rows, window):
    """Straight from the definition: windows by (id, start); what also starts earlier goes."""
    first = {}
    words = [(-(2**63) if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for (raw, _), (i, w) in zip(rows, words, strict=True):
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (i, s):
                gone.update(range(s, s + window))
        out.append((raw, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return out


def key(row):
    return (row[0] is not None, row[0] or 0, *row[1:])


def check(spark, rows, window=5, **sizes):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in repeated_substrings(df, window=window, **sizes).collect()]
    assert sorted(got, key=key) == sorted(brute(rows, window), key=key)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    passages = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(5, 30))] for _ in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(["p", "q", "r", "é", " "]) for _ in range(rng.randint(1, 9))]
        rows.append((i * 3 % 61, rng.choice([" ", "\n", "\t "]).join(words)))
    check(spark, rows, bucket_windows=300, block_chars=500, gather=200)


def test_odd_input(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (1, None), (2, ""), (3, "a b c d e f g"), (3, "a b c d e f g"), (4, "a a a a a a a a a"), (5, "a b c d"), (5, "x a b c d e f g y z")]
    check(spark, rows)
    assert repeated_substrings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    check(spark, [(1, long), (2, "w5 w6 w7 w8 w9 w10"), (0, long)], window=5)


def test_packed_places_come_back():
    doc, tag, start = np.array([-(2**63), 5, 5, 5, 9]), np.array([0, 1, 1, 2, 0], np.uint64), np.array([3, 0, 70000, 2, 4])
    for a, b in zip(unseal(seal(doc, tag, start)), (doc, tag, start), strict=True):
        assert (a == b).all()


def test_intervals_merge_where_they_touch():
    assert intervals(np.array([0, 3, 8, 14]), 5) == [(0, 13), (14, 19)]
    assert intervals(np.array([], int), 5) == []
