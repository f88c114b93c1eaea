"""Mixing sources to target weights by Poisson replication.

A source's repetition rate is its target share of the total mass over its own share.  Every document inverts a Poisson
distribution with that mean at a number that the hash of its id and the seed gives, is repeated that often, and the copies
are shuffled globally by the hash of id, copy and seed.  Built-in functions only; masses come from one grouped
aggregation whose partial sums meet map-side, so a source that holds a third of all rows is one row a task there.

Defined results for odd input
* null text counts as empty; a source whose documents are all empty keeps its documents at rate 0 if others have text;
* a null source is a source of its own; a null id hashes like the text ``null``;
* rows repeated with one id draw the same number, each for itself; an empty table gives an empty result;
* other columns are carried along; names that the operator adds replace columns of the same name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import durable, fresh

SEED = 17
#: Without given weights a source's target share follows its mass to this power (temperature sampling).
TEMPERATURE = 0.7
#: Hex digits of a hash that make a number between 0 and 1.
DIGITS = 13


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from MD5 over the parts, the same in every engine."""
    text = F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)


#: Above this rate the sum starts 12 deviations and 20 below the mean; below, e ** -rate is far from underflow.
FROM_ZERO = 500


def log_factorial(n: Column) -> Column:
    """Stirling's series; exact to double precision for the numbers from which sums start."""
    return n * F.log(n) - n + F.log(2 * math.pi * n) / 2 + 1 / (12 * n) - 1 / (360 * n * n * n)


def poisson_inverse(u: Column, rate: Column) -> Column:
    """The least k whose Poisson distribution function reaches u.

    The sum runs from 12 deviations and 20 below the mean, or from 0, to as far beyond it; past both ends nothing is left
    in double precision.
    """
    spread = 12 * F.sqrt(rate) + 20
    low = F.when(rate > FROM_ZERO, F.floor(rate - spread)).otherwise(0).cast("int")
    first = F.when(low > 0, F.exp(low * F.log(rate) - rate - log_factorial(low.cast("double")))).otherwise(F.exp(-rate))
    start = F.struct(first.alias("p"), first.alias("cdf"), low.alias("k"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * rate / i
        return F.when(acc["cdf"] >= u, acc).otherwise(F.struct(p.alias("p"), (acc["cdf"] + p).alias("cdf"), (acc["k"] + 1).alias("k")))

    return F.aggregate(F.sequence(low + 1, F.ceil(rate + spread).cast("int")), start, step, lambda acc: acc["k"])


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", text_col: str = "text", temperature: float = TEMPERATURE, epochs: float = 1.0) -> DataFrame:
    """``source, mass, rate``: mass counts characters; the mixed corpus has `epochs` times the whole mass on average."""
    masses = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.length(F.coalesce(F.col(text_col), F.lit("")))).alias("mass"))
    if weights is None:
        share = F.pow(F.col("mass").cast("double"), F.lit(temperature))
    else:
        given = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else F.lit(None).cast("map<string,double>")
        share = F.coalesce(F.element_at(given, F.col("source")), F.lit(0.0)).cast("double")
    wanted = durable(masses.withColumn("wanted", share))
    sums = wanted.agg(F.sum("mass").alias("mass"), F.sum("wanted").alias("wanted")).first()  # two numbers
    if not sums["mass"] or not sums["wanted"]:
        return wanted.select("source", "mass", F.lit(0.0).alias("rate"))
    rate = F.col("wanted") / F.lit(float(sums["wanted"])) * F.lit(float(sums["mass"])) / F.nullif(F.col("mass"), F.lit(0)) * epochs
    return wanted.select("source", "mass", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED, temperature: float = TEMPERATURE, epochs: float = 1.0) -> DataFrame:
    """The input's columns for every copy, with ``copy`` (from 0), ``copies``, ``rate`` and ``mix_key``, in the order of the key.

    Rates are joined null-safely.  Masses are written first, so that the planner knows their size and broadcasts rates
    only within its threshold; sources beyond it are joined by a shuffle.
    """
    rates = repetition_rates(docs, weights, source_col, text_col, temperature, epochs)
    rows = docs.drop("copy", "copies", "rate", "mix_key")
    (key,) = fresh(rows, "source")
    rated = rows.join(rates.select(F.col("source").alias(key), "rate"), rows[source_col].eqNullSafe(F.col(key))).drop(key)
    drawn = rated.withColumn("copies", poisson_inverse(uniform(F.lit(seed), F.col(id_col)), F.col("rate")))
    copies = drawn.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    keyed = copies.withColumn("mix_key", uniform(F.lit(seed), F.col(id_col), F.col("copy")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartitionByRange(parts, "mix_key").sortWithinPartitions("mix_key")
