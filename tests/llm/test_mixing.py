import hashlib
import math
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from ledgerline.llm.mixing import mixed, poisson_inverse, repetition_rates

SCHEMA = "doc_id long, text string, source string, copies string, rate int"


def brute(u, rate):
    k, p = 0, math.exp(-rate)
    total = p
    while total < u and k < 10_000:
        k += 1
        p *= rate / k
        total += p
    return k


def test_large_rates_against_brute_force(spark):
    def exact(u, rate):
        """Sums the distribution function from the top and the bottom in exact fractions of its largest term."""
        mode = int(rate)
        term, low, high = Fraction(1), [Fraction(1)], []
        for k in range(mode, max(0, mode - 40 * int(rate**0.5)), -1):
            term = term * k / Fraction(rate)
            low.append(term := Fraction(float(term)))
        term = Fraction(1)
        for k in range(mode + 1, mode + 40 * int(rate**0.5)):
            high.append(term := Fraction(float(term * Fraction(rate) / k)))
        weights, total, k = low[::-1] + high, Fraction(0), mode - len(low) + 1
        whole = sum(weights)
        for w in weights:
            total += w
            if total / whole >= Fraction(u):
                return k
            k += 1

    cases = [(u, r) for r in (499.5, 500.5, 800.0, 5000.0) for u in (1e-6, 0.01, 0.2, 0.5, 0.93, 0.99999)]
    got = spark.createDataFrame(cases, "u double, r double").select("u", "r", poisson_inverse(F.col("u"), F.col("r")).alias("k")).collect()
    assert [(x.u, x.r, x.k) for x in got] == [(u, r, exact(u, r)) for u, r in cases]


def test_columns_of_clashing_names_are_carried(spark):
    df = spark.createDataFrame([(i, "t", "s", i, -i, "u") for i in range(40)], "doc_id long, text string, source string, _source long, Source_ long, key string")
    got = mixed(df).collect()
    assert got and all((r["_source"], r["Source_"], r["key"]) == (r.doc_id, -r.doc_id, "u") for r in got)


def test_inverse_against_brute_force(spark):
    cases = [(u, r) for r in (0.0, 0.01, 0.4, 1.0, 3.7, 40.0) for u in (1e-9, 0.1, 0.3678, 0.37, 0.5, 0.9, 0.999999)]
    got = spark.createDataFrame(cases, "u double, r double").select("u", "r", poisson_inverse(F.col("u"), F.col("r")).alias("k")).collect()
    assert [(x.u, x.r, x.k) for x in got] == [(u, r, brute(u, r)) for u, r in cases]


def rows(spark):
    data = [(i, "word " * (i % 7), "big" if i % 3 else f"s{i % 5}", "x", 1) for i in range(3000)]
    return spark.createDataFrame(data + [(None, None, None, "x", 1), (None, "t", None, "x", 1), (5, "twice", "s1", "x", 1), (5, "twice", "s1", "x", 1)], SCHEMA)


def test_shares_follow_the_weights(spark):
    df = rows(spark)
    got = mixed(df, {"big": 0.2, "s0": 0.4, "s1": 0.4}, epochs=3.0).collect()
    mass = Counter()
    for r in got:
        mass[r.source] += len(r.text or "")
    total = sum(mass.values())
    assert set(mass) == {"big", "s0", "s1"} and abs(mass["big"] / total - 0.2) < 0.03 and abs(mass["s0"] / total - 0.4) < 0.04


def test_copies_come_from_the_hash_alone(spark):
    df = rows(spark)
    rates = {r.source: r.rate for r in repetition_rates(df).collect()}
    want = Counter()
    for r in df.collect():
        i = "null" if r.doc_id is None else str(r.doc_id)
        u = (int(hashlib.md5(f"17/{i}".encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        want[r.doc_id, r.source, r.text] += brute(u, rates[r.source])
    got = mixed(df).collect()
    assert Counter((r.doc_id, r.source, r.text) for r in got) == +want
    assert [r.mix_key for r in got] == sorted(r.mix_key for r in got)
    assert got[0].asDict().keys() == {"doc_id", "text", "source", "copies", "copy", "rate", "mix_key"}


@pytest.mark.parametrize("weights", [None, {}])
def test_empty(spark, weights):
    assert mixed(spark.createDataFrame([], SCHEMA), weights).count() == 0
