"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Groups (equal texts) are the items: they are summed up first, and only their sums are packed.  A group stays in one shard
unless it alone holds more than an equal part of all bytes or rows; then it is dealt into parts of a sixteenth of a shard,
by the hash of its ids, so that they fill what the others leave.  Items go to cells by hash; each cell packs its items into as many bins as there are shards, or a multiple,
placing every item where the dot product of its vector with the bin's residual capacity is highest.  The bins of several
cells are then items of one cell of the next level, up to one cell, whose bins are the shards; so no task sees more than a
fixed number of items.  Slots follow from counts per shard and salt, so no shard is sorted or numbered as a whole.

Law ``bytes``: sizes are near equal.

Defined results for odd input
* null text counts as no bytes and no tokens (its size is the fixed part alone) and is grouped with the empty text;
* a null id is placed like any other; repeated rows are rows of their own;
* an empty table gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import durable, pieces

#: Items of a cell, about.
CELL_ITEMS = 8192
#: Parts of a shard into which a group beyond a shard is dealt.
PARTS = 16
#: Cells whose bins make one cell of the next level.
FAN = 32
#: Rows of a shard that are numbered together, about.
NUMBERED = 100_000
#: Items of more rows than this, and than a 50,000th of all, find their rows by a broadcast of at most so many items.
CROWD_ROWS, MOST_CROWDS = 4096, 50_000
#: Bytes that each row adds to its text.
ROW_BYTES = 16


def pack(vectors: np.ndarray, bins: int) -> np.ndarray:
    """Bins of items, each placed where its dot product with the residual capacity is highest.

    Items come in descending order of their largest share; capacity is an equal part of the total in every dimension, and
    residuals are in units of it.  Ties go to the lower bin.
    """
    total = vectors.sum(axis=0).astype(float)
    share = vectors / np.where(total > 0, total, 1) * bins
    residual = np.ones((bins, vectors.shape[1]))
    out = np.zeros(len(vectors), dtype=np.int64)
    order = np.lexsort((np.arange(len(vectors)), -share.max(axis=1))) if len(vectors) else []
    for i in order:
        out[i] = b = int(np.argmax(residual @ share[i]))
        residual[b] -= share[i]
    return out


#: By how much of the mean the tokens and rows of a bin may grow while bytes are evened: bytes are the law, so the last
#: steps are free, but only where bins are still this far from the mean.
SLACKS = (0.05, 0.25, np.inf)
NEAR = 0.01
#: Items of a bin that are tried in one step of evening.
PAIRS = 512


def place(vectors: np.ndarray, bins: int) -> np.ndarray:
    """`pack`, then items move or change places between the largest bin and smaller ones while that evens their bytes.

    A step must not bring the tokens or rows of either bin beyond what the larger of both holds, or the mean and a slack;
    slacks widen while bytes are not nearly equal.
    """
    out = pack(vectors, bins)
    sums = np.zeros((bins, vectors.shape[1]))
    np.add.at(sums, out, vectors)
    mean = sums.mean(axis=0)

    def step(high: int, low: int, slack: float) -> bool:
        gap = sums[high, 0] - sums[low, 0]
        mine, theirs = np.flatnonzero(out == high)[:PAIRS], np.flatnonzero(out == low)[:PAIRS]
        if gap <= 1 or not len(mine):
            return False
        # moving bytes x from high to low helps where 0 < x < gap; the best x is gap / 2
        choice = np.concatenate((np.zeros((1, vectors.shape[1])), vectors[theirs]))
        moved = vectors[mine][:, None] - choice[None, :]
        most = np.maximum(mean + mean * slack if slack < np.inf else np.inf, np.maximum(sums[high], sums[low]))
        fits = ((sums[high] - moved <= most) & (sums[low] + moved <= most))[:, :, 1:].all(axis=2)
        x = moved[:, :, 0]
        score = np.where((x > 0) & (x < gap) & fits, np.abs(x - gap / 2), np.inf)
        i, j = np.unravel_index(int(score.argmin()), score.shape)
        if not np.isfinite(score[i, j]):
            return False
        out[mine[i]] = low
        if j:
            out[theirs[j - 1]] = high
        sums[high] -= moved[i, j]
        sums[low] += moved[i, j]
        return True

    for slack in SLACKS:
        for _ in range(8 * bins):
            high = int(sums[:, 0].argmax())
            if slack > SLACKS[0] and np.abs(sums[:, 0] - mean[0]).max() <= NEAR * mean[0]:
                return out
            if not any(step(high, int(low), slack) for low in np.argsort(sums[:, 0], kind="stable") if low != high):
                break
    return out


def in_cells(items: DataFrame, cell: Column, n_shards: int, rule: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    """``cell, of`` of each item, the cell ``up`` and ``bin`` in which it is put, and the sums ``b, t, r`` that it brings."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["cell", "of"], ignore_index=True)
        frame["bin"] = rule(frame[["b", "t", "r"]].to_numpy(dtype=float), n_shards)
        return frame[["cell", "of", "up", "bin", "b", "t", "r"]]

    return items.withColumn("up", cell).groupBy("up").applyInPandas(run, "cell long, of long, up long, bin long, b long, t long, r long")


def placements(items: DataFrame, totals: tuple[float, float, float], n_shards: int, cell_items: int = CELL_ITEMS, fan: int = FAN) -> DataFrame:
    """``group, part, shard, r`` of items ``group, part, b, t, r``, level by level.

    Items beyond a sixteenth of a shard, of which there are at most 3 x 16 a shard, wait for the last level.
    """
    items = durable(items.withColumn("of", F.monotonically_increasing_id()))
    n = items.count()
    cells = pieces(n, cell_items)
    big = F.greatest(*[F.col(c) * float(n_shards * PARTS) / max(x, 1.0) for c, x in zip("btr", totals, strict=True)]) > 1
    numbers = items.select(F.when(big, F.lit(-1)).otherwise(F.pmod(F.xxhash64("group", "part"), F.lit(cells))).cast("long").alias("cell"), "of", "b", "t", "r")
    levels, now = [], numbers
    if cells > 1:
        # few cells have more bins, so that the last level has many to choose from
        now = durable(in_cells(numbers.filter("cell >= 0"), F.col("cell"), n_shards * max(1, fan // cells), pack))
        levels.append(now)
        while cells > fan:
            sums = now.groupBy(F.col("up").alias("cell"), F.col("bin").alias("of")).agg(*[F.sum(c).alias(c) for c in "btr"])
            now = durable(in_cells(sums, F.floor(F.col("cell") / fan), n_shards, pack))
            levels.append(now)
            cells = pieces(cells, fan)
        now = now.groupBy(F.col("up").alias("cell"), F.col("bin").alias("of")).agg(*[F.sum(c).alias(c) for c in "btr"]).union(numbers.filter("cell < 0"))
    chain = durable(in_cells(now, F.lit(0).cast("long"), n_shards, place)).select("cell", "of", F.col("bin").cast("int").alias("shard"))
    large = chain.filter("cell < 0") if levels else None
    for level in reversed(levels):
        ahead = chain.select(F.col("cell").alias("up"), F.col("of").alias("bin"), "shard")
        chain = level.select("cell", "of", "up", "bin").join(ahead, ["up", "bin"]).select("cell", "of", "shard")
    if large is not None:
        chain = chain.union(large)
    return items.join(chain.select("of", "shard"), "of").select("group", "part", "shard", "r")


def shards(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", cell_items: int = CELL_ITEMS, fan: int = FAN, numbered: int = NUMBERED) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``, and ``tokens`` and ``part``."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    words = F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+"))
    rows = durable(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(body).cast("long") + ROW_BYTES).alias("size"),
            words.cast("long").alias("tokens"),
            F.crc32(body.cast("binary")).alias("text_crc32"),
            F.unhex(F.md5(body.cast("binary"))).alias("group"),
        )
    )
    n, total, tokens = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    sums = [F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("r")]
    groups = durable(rows.groupBy("group").agg(*sums))
    # a group beyond an equal part of all bytes or rows: there are fewer than two for each shard
    share = F.greatest(F.col("b") / max(total / n_shards, 1), F.col("r") / max(n / n_shards, 1))
    large = groups.filter((share > 1) & (F.col("r") > 1)).select("group", F.ceil(PARTS * share).cast("long").alias("parts"))
    part = F.when(F.col("parts").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(F.lit("part"), "doc_id", F.rand(7) * F.isnull("doc_id").cast("int")), F.coalesce("parts", F.lit(1))))
    dealt = durable(rows.join(F.broadcast(large), "group", "left").withColumn("part", part).drop("parts"))
    split = dealt.join(F.broadcast(large), "group").groupBy("group", "part").agg(*sums)
    items = groups.join(F.broadcast(large), "group", "left_anti").select("group", F.lit(0).cast("long").alias("part"), "b", "t", "r").union(split)
    placed = durable(placements(items, (total, tokens, n), n_shards, cell_items, fan))
    crowd = F.col("r") > max(CROWD_ROWS, n // MOST_CROWDS)
    crowds = dealt.join(F.broadcast(placed.filter(crowd).drop("r")), ["group", "part"], "left")
    columns = ["doc_id", "size", "tokens", "text_crc32", "group", "part"]
    others = crowds.filter("shard is null").select(*columns).join(placed.filter(~crowd).drop("r"), ["group", "part"])
    found = crowds.filter("shard is not null").select(*columns, "shard").union(others.select(*columns, "shard"))
    salted = durable(found.withColumn("salt", F.pmod(F.xxhash64("group", "doc_id"), F.lit(pieces(n, numbered * n_shards)))))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("salt")) - F.col("n")
    bases = salted.groupBy("shard", "salt").agg(F.count(F.lit(1)).alias("n")).select("shard", "salt", before.alias("base"))
    rank = F.row_number().over(Window.partitionBy("shard", "salt").orderBy("doc_id", "group")) - 1
    return salted.withColumn("rank", rank).join(bases, ["shard", "salt"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tokens", "part")
