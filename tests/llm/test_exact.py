import hashlib

from pyspark.sql import functions as F

from ledgerline.llm.exact_dedup import exact_duplicates

SCHEMA = "doc_id long, text string, keep_id string, h string, digest int"


def brute(rows, best):
    out = []
    for i, t in rows:
        same = [j for j, u in rows if (u or "") == (t or "")]
        ids = [j for j in same if j is not None]
        keep = best(ids) if ids else None
        out.append((i, keep, len(same), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in exact_duplicates(df, **options).collect()), key=str)


ROWS = [(5, "a"), (3, "a"), (9, "a"), (1, None), (2, ""), (None, "b"), (4, "b"), (None, "c"), (None, "c"), (7, "A"), (8, "a "), (6, "é"), (10, "é"), (11, "x" * 100_000), (12, "x" * 100_000), (13, "x" * 99_999 + "y"), (13, "d"), (13, "d")]


def test_against_brute_force(spark):
    assert run(spark, ROWS) == brute(ROWS, min)
    assert run(spark, ROWS, keep="largest") == brute(ROWS, max)


def test_colliding_hashes_are_told_apart(spark):
    assert run(spark, ROWS, hash_of=lambda c: F.lit("all the same")) == brute(ROWS, min)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_plan_holds_no_python(spark):
    df = spark.createDataFrame([(1, "a", "", "", 1)], SCHEMA)
    plan = exact_duplicates(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
