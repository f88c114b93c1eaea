"""Parser diagnostics: unknown shapes, unmatched rates, dialect detection, drift, and samples to detect on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import message_of, shape
from ledgerline.operators.parse import recognised
from ledgerline.operators.rules import Registry

UNMATCHED_LIMIT, DROP_LIMIT, GATE, TIE = 0.05, 0.5, 0.02, 1e-9
HEAD, SAMPLE = 1000, 5000


def unknown_shapes(rows: DataFrame, message: str, line_no: str, top: int | None = None) -> DataFrame:
    """``shape, n, first_example, first_line`` by falling count, ties to the one seen first."""
    counted = rows.withColumn("shape", shape(F.col(message))).groupBy("shape").agg(F.count(F.lit(1)).alias("n"), F.min_by(message, line_no).alias("first_example"), F.min(line_no).alias("first_line"))
    ordered = counted.orderBy(F.desc("n"), "first_line")
    return ordered.limit(top) if top else ordered


def unknown_line_stats(events: DataFrame) -> DataFrame:
    """Shapes of unknown lines per dialect, with first and last time."""
    rows = events.filter("type = 'raw_unknown'").withColumn("shape", shape(message_of(F.col("raw"))))
    return rows.groupBy("dialect_id", "shape").agg(F.count(F.lit(1)).alias("n"), F.min_by("raw", "seq").alias("first_example"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def benchmark(events: DataFrame, part: list[str] | None = None) -> DataFrame:
    """``lines, unmatched, rate`` overall or per part; the rate of no lines is 0."""
    unknown = F.count(F.when(F.col("type") == "raw_unknown", 1))
    rows = events.groupBy(*(part or [])).agg(F.count(F.lit(1)).alias("lines"), unknown.alias("unmatched"))
    return rows.withColumn("rate", F.when(F.col("lines") > 0, F.col("unmatched") / F.col("lines")).otherwise(F.lit(0.0)))


def passes_gate(events: DataFrame, limit: float = GATE) -> DataFrame:
    return benchmark(events).select("rate", (F.col("rate") < limit).alias("passes"))


def family_shares(rows: DataFrame, family: Column) -> DataFrame:
    """``family, n, share`` of all rows."""
    counted = rows.groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


def drifted(baseline: DataFrame, observed: DataFrame, limit: float = DROP_LIMIT) -> DataFrame:
    """Families whose share fell by more than the limit, relative to the baseline, the worst first."""
    rows = baseline.select("family", F.col("share").alias("baseline")).join(observed.select("family", F.col("share").alias("observed")), "family", "left").na.fill(0.0, ["observed"])
    rows = rows.filter("baseline > 0").withColumn("drop_share", (F.col("baseline") - F.col("observed")) / F.col("baseline"))
    return rows.filter(F.col("drop_share") > limit).orderBy(F.desc("drop_share"), "family")


def drift_report(events: DataFrame, baseline: DataFrame) -> dict[str, DataFrame]:
    """Overall rate with its alert, fallen families, and the shapes of unknown lines, which hold no names."""
    overall = benchmark(events).withColumn("alert", F.col("rate") > UNMATCHED_LIMIT)
    seen = family_shares(events.filter("type <> 'raw_unknown'"), F.col("type"))
    return {"overall": overall, "families": drifted(baseline, seen), "shapes": unknown_shapes(events.filter("type = 'raw_unknown'").withColumn("message", message_of(F.col("raw"))), "message", "line_no")}


def detected(rows: DataFrame, fits: dict[str, Column], marker: dict[str, Column] | None = None, limit: float = UNMATCHED_LIMIT) -> DataFrame:
    """``dialect, confidence``: the dialect of least unmatched rate over the rows, in one pass.

    A marker that any row has decides at once.  No dialect is unknown, one alone is it; a best rate beyond the limit or a
    tie is unknown.
    """
    names = list(fits)
    if len(names) < 2:
        return rows.sparkSession.createDataFrame([(names[0], 1.0) if names else ("unknown", 0.0)], "dialect string, confidence double")
    rates = [F.avg(F.when(f, 0.0).otherwise(1.0)).alias(f"r{i}") for i, f in enumerate(fits.values())]
    marks = [F.max(F.coalesce(m, F.lit(False))).alias(f"m{i}") for i, m in enumerate((marker or {}).values())]
    one = rows.agg(*rates, *marks)
    listed = F.array_sort(F.array(*[F.struct(F.col(f"r{i}").alias("rate"), F.lit(n).alias("name")) for i, n in enumerate(names)]))
    best, second = listed[0], listed[1]
    chosen = F.when((best["rate"] > limit) | (second["rate"] - best["rate"] <= TIE), "unknown").otherwise(best["name"])
    marked = reduce(lambda acc, x: acc.when(F.col(f"m{x[0]}"), x[1]), enumerate(marker or {}), F.when(F.lit(False), ""))
    return one.select(F.coalesce(marked, chosen).alias("dialect"), F.when(marked.isNotNull(), 1.0).otherwise(1 - best["rate"]).alias("confidence"))


def detect_dialect(lines: DataFrame, dialects: dict[str, Registry], marker: dict[str, Column] | None = None) -> DataFrame:
    """Which dialect's rules leave the fewest lines unmatched."""
    rows = lines
    for i, registry in enumerate(dialects.values()):
        found = recognised(lines, registry).select("line_no", "path", (F.col("type") != "raw_unknown").alias(f"_fit{i}"))
        rows = rows.join(found, ["path", "line_no"])
    return detected(rows, {n: F.col(f"_fit{i}") for i, n in enumerate(dialects)}, marker)


def sample_lines(lines: DataFrame, head: int = HEAD, most: int = SAMPLE) -> DataFrame:
    """The first lines of each file and an even stride over the rest, at most so many; the same lines every time."""
    sizes = lines.groupBy("path").agg(F.max("line_no").alias("_n"))
    stride = F.greatest(F.lit(1), F.ceil((F.col("_n") - head) / (most - head)))
    return lines.join(F.broadcast(sizes), "path").filter((F.col("line_no") <= head) | ((F.col("line_no") - head - 1) % stride == 0)).drop("_n")


def overridden(base: DataFrame, own: DataFrame, key: str) -> DataFrame:
    """A dialect's rules: its own, and those of the base that it does not declare itself."""
    return base.join(own.select(key), key, "left_anti").withColumn("dialect", F.lit("base")).unionByName(own.withColumn("dialect", F.lit("own")))


def anonymised(column: Column, names: list[str], label: str = "Player") -> Column:
    """Names replaced by numbered labels, the longest first, whole words only."""
    import re

    numbered = {n: f"{label}{i}" for i, n in enumerate(names, 1)}
    return reduce(lambda c, n: F.regexp_replace(c, rf"(?<![A-Za-z]){re.escape(n)}(?![A-Za-z])", numbered[n]), sorted(names, key=lambda n: (-len(n), n)), column)
