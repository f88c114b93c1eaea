"""Connected components of an undirected graph, by alternating large-star and small-star rounds.

The number of rounds follows the logarithm of the longest path.  Each round's edges are written to the shared folder; a
round holds no more edges than the one before.  Minima meet map-side, so a vertex with many edges is no hot key there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import discard, durable, pieces

#: Edges of a task, about.
TASK_EDGES = 250_000
#: Tasks over which the edges of one vertex are dealt.
SALTS = 16


def star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: each vertex ties its larger neighbours to the least of its neighbourhood; small star: the others."""
    both = edges.union(edges.select("v", "u")) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    # a vertex with very many edges is dealt over several tasks; the multiplied side is never broadcast
    every = F.array(*[F.lit(i).cast("long") for i in range(SALTS)])
    tied = both.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS))).join(least.withColumn("salt", F.explode(every)).hint("merge"), ["u", "salt"]).drop("salt")
    if large:
        return tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame, src: str = "u", dst: str = "v", most_rounds: int = 60) -> DataFrame:
    """``vertex, component`` for every vertex that has an edge to another; the component is its least vertex.

    `edges` should be a written table, as it is read twice.  Null ends and loops are left out; repeated edges count once; no edges give an empty table.
    """
    n = edges.count()
    if not n:
        # a local list would start Python workers of another kind beside those that run the operators
        return edges.sparkSession.range(0).select(F.col("id").alias("vertex"), F.col("id").alias("component"))
    parts = pieces(n, TASK_EDGES)
    now = durable(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u <> v").distinct(), parts)
    seen = None
    for _ in range(most_rounds):
        after = durable(star(star(now, True), False), parts)
        # the edge sets are equal where count and hash sums are; a sum of 64-bit hashes as decimals does not overflow
        mark = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now)
        now = after
        if mark == seen:
            roots = now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(roots)
        seen = mark
    raise RuntimeError(f"components did not settle within {most_rounds} rounds")


def with_group(rows: DataFrame, groups: DataFrame, group: str, how: str = "inner") -> DataFrame:
    """`rows` joined with `groups`, which has one row for each group; a large group's rows are dealt over several tasks."""
    every = F.array(*[F.lit(i).cast("long") for i in range(SALTS)])
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    return dealt.join(groups.withColumn("salt", F.explode(every)).hint("merge"), [group, "salt"], how).drop("salt")


def with_least(rows: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """`rows` with the least `value` of their group as a column `name`."""
    least = rows.groupBy(group).agg(F.min(value).alias(name), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return with_group(rows, least, group, "left").withColumn(name, F.coalesce(name, value))
