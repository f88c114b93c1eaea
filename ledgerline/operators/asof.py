"""As-of lookups: the latest value at or before a row, as running windows instead of correlated queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(part: list[str], order: list[str], include_current: bool = True):
    """Rows of a partition from its first to the current one, or to the one before it."""
    return Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)


def last_value(value: Column, part: list[str], order: list[str], include_current: bool = True) -> Column:
    """The latest value that is not null."""
    return F.last(value, ignorenulls=True).over(running(part, order, include_current))


def best_so_far(rank: Column, part: list[str], order: list[str]) -> Column:
    """Running maximum of a struct: strictly larger wins, so put a falling order field last to keep the first of equals."""
    return F.max(rank).over(running(part, order))


def asof_join(left: DataFrame, right: DataFrame, part: list[str], order: str, value: str, within: int | None = None, time: str | None = None) -> DataFrame:
    """For each left row the latest right row before it in `order`, with ``value`` under its name, and ``value_time``.

    One union and one window over the part, so neither side is broadcast and no pairs arise.  With `within`, only right
    rows whose `time` lies in the window before the left row's time count.
    """
    clock, name = time or order, value if value not in left.columns else f"{value}_found"
    keys = list(dict.fromkeys([*part, order, clock]))
    known = right.select(*keys, F.struct(F.col(value).alias("v"), F.col(clock).alias("t")).alias("_v"), F.lit(0).alias("_side"))
    asking = left.withColumn("_v", F.lit(None).cast(known.schema["_v"].dataType)).withColumn("_side", F.lit(1))
    both = asking.unionByName(known, allowMissingColumns=True)
    found = both.withColumn("_f", F.last("_v", ignorenulls=True).over(running(part, [order, "_side"]))).filter("_side = 1")
    near = F.lit(True) if within is None else (F.col(clock) - F.col("_f.t")).between(0, within)
    return found.select(*left.columns, F.when(near, F.col("_f.v")).alias(name), F.when(near, F.col("_f.t")).alias("value_time"))
