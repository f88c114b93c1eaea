"""Bootstrap confidence intervals of means, with a counter-based generator, per group on Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the 32-bit generator and of the hash that seeds it.
STEP, FNV_PRIME, FNV_BASIS = 0x6D2B79F5, 0x01000193, 0x811C9DC5


def uniforms(seed: int, start: int, n: int) -> np.ndarray:
    """Draws `start` to `start + n` of the generator: its state is a counter, so they are computed at once."""
    a = (np.uint64(seed) + np.uint64(STEP) * np.arange(start + 1, start + n + 1, dtype=np.uint64)).astype(np.uint32)
    with np.errstate(over="ignore"):
        t = (a ^ (a >> np.uint32(15))) * (a | np.uint32(1))
        t = (t + (t ^ (t >> np.uint32(7))) * (t | np.uint32(61))) ^ t
    return (t ^ (t >> np.uint32(14))).astype(np.float64) / 4294967296.0


def group_seed(seed: int, value: str) -> int:
    h = (seed ^ FNV_BASIS) & 0xFFFFFFFF
    for unit in np.frombuffer(value.encode("utf-16-le", "surrogatepass"), "<u2").tolist():
        h = (h ^ unit) * FNV_PRIME & 0xFFFFFFFF
    return h


def interval(values: np.ndarray, resamples: int, percent: float, seed: int, block: int = 1 << 22) -> tuple[float, float]:
    """Of the mean of ascending values: none, one, or the percentiles of resampled means; sums run left to right."""
    n = len(values)
    if n < 2:
        return (float(values[0]),) * 2 if n else (0.0, 0.0)
    rows = max(1, block // n)
    means = np.empty(resamples)
    for at in range(0, resamples, rows):
        k = min(rows, resamples - at)
        picks = np.floor(uniforms(seed, at * n, k * n) * n).astype(np.int64).reshape(k, n)
        means[at : at + k] = np.cumsum(values[picks], axis=1)[:, -1] / n
    means.sort()
    tail = (100 - percent) / 2 / 100
    low, high = (min(resamples - 1, max(0, int(np.floor(p * (resamples - 1))))) for p in (tail, 1 - tail))
    return float(means[low]), float(means[high])


def bootstrap(rows: DataFrame, group: str, metric: str, resamples: int = 1000, seed: int = 0x5EED, percent: float = 95.0) -> DataFrame:
    """``value, n, mean, ci_low, ci_high`` per group.  A group's values must fit a task; they are one number each."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        values = np.sort(frame["metric"].to_numpy(float))
        name = frame["value"].iloc[0]
        low, high = interval(values, resamples, percent, group_seed(seed, name))
        return pd.DataFrame({"value": [name], "n": [len(values)], "mean": [float(np.cumsum(values)[-1] / len(values))], "ci_low": [low], "ci_high": [high]})

    clean = rows.select(F.col(group).cast("string").alias("value"), F.col(metric).cast("double").alias("metric")).filter("value is not null and metric is not null")
    return clean.groupBy("value").applyInPandas(run, "value string, n long, mean double, ci_low double, ci_high double")


def verdict(groups: DataFrame, min_n: int = 8) -> DataFrame:
    """``winner, winner_mean, refused_reason``: one row, also for no groups."""
    ranked = groups.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean"), "value")))
    top = [F.max(F.when(F.col("rank") == r, F.struct(*groups.columns))).alias(f"g{r}") for r in (1, 2)]
    reason = (
        F.when(F.col("g1").isNull(), "no groups to compare")
        .when(F.col("g1.n") < min_n, F.format_string(f"top group '%s' has n=%d, below the minimum n ({min_n})", "g1.value", "g1.n"))
        .when(F.col("g1.ci_low") <= F.col("g2.ci_high"), "top groups' confidence intervals overlap")
    )
    rows = ranked.agg(*top).withColumn("refused_reason", reason)
    won = F.col("refused_reason").isNull()
    return rows.select(F.when(won, F.col("g1.value")).alias("winner"), F.when(won, F.col("g1.mean")).alias("winner_mean"), "refused_reason")
