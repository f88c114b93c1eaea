"""The event sink: checked, idempotent appends with a watermark per log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ledgerline.schema import PAYLOAD

#: What a replayed row must agree in: all that the line says.
SAME = ("seq", "raw", "ts", "type", "dialect_id", "rule_id", "value", *PAYLOAD)


def idempotent(rows: DataFrame, key: list[str], same: list[str] | None = None) -> DataFrame:
    """Each key once.  Rows that differ under one key raise an error while the plan runs; null differs from every value."""
    rest = [c for c in rows.columns if c not in key]
    compared = F.struct(*(same or rest))
    firsts = [F.min_by(F.struct(*rest), compared).alias("_r"), F.min(compared).alias("_a"), F.max(compared).alias("_b")]
    checked = rows.groupBy(*key).agg(*firsts)
    ok = F.when(F.col("_a").eqNullSafe(F.col("_b")), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("rows differ under one key: "), F.to_json(F.struct(*key)))).cast("boolean"))
    return checked.filter(ok).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*rows.columns)


def watermarks(rows: DataFrame, part: list[str], order: str, *more: Column) -> DataFrame:
    """How far each part has come: its greatest number and the count of its rows."""
    return rows.groupBy(*part).agg(F.max(order).alias("seq"), F.count(F.lit(1)).alias("n"), *more)


def justified(batch: DataFrame, claimed: DataFrame, byte_length: str = "byte_length") -> DataFrame:
    """Claimed watermarks (``log_file_id, byte_offset, seq``) that the batch does not bear out, with the reason."""
    reached = batch.groupBy("log_file_id").agg(F.max("seq").alias("max_seq"), F.max(F.col("byte_offset") + F.col(byte_length)).alias("end"))
    rows = claimed.join(reached, "log_file_id", "left")
    why = F.when(F.col("max_seq").isNull(), "an empty batch may not move it").when(F.col("seq") != F.col("max_seq"), "its number is not the batch's last").when(F.col("byte_offset") != F.col("end"), "its offset is not the end of the batch's last line")
    return rows.withColumn("reason", why).filter("reason is not null").select("log_file_id", "byte_offset", "seq", "reason")


def existing(spark: SparkSession, folder: str) -> DataFrame | None:
    try:
        return spark.read.parquet(folder)
    except AnalysisException:
        return None


def refused(rows: DataFrame, why: str) -> None:
    """Raise if there is a row, with the first one found."""
    found = rows.limit(1).collect()
    if found:
        raise ValueError(f"{why}: {found[0].asDict()}")


def reached(batch: DataFrame) -> DataFrame:
    """``log_file_id, byte_offset, seq, last_ts`` to which a batch brings each log."""
    return registered_heads(batch)


def append_events(batch: DataFrame, folder: str, claimed: DataFrame | None = None) -> int:
    """Append what is new of a batch to the event table, then its watermarks; returns how many rows were new.

    Keys are log and byte offset.  Rows that are there already must agree in all that the line says, and no number may come
    twice in a log, in the batch or against what is stored.  Watermarks (`claimed`, else what the batch reaches) must be
    the batch's own end and never move back while rows are new.  They are written after the rows: a call that was cut off
    is repeated, adds nothing a second time and then writes them, so it may serve ``foreachBatch``.
    """
    spark = batch.sparkSession
    same = [c for c in SAME if c in batch.columns]
    rows = idempotent(batch, ["log_file_id", "byte_offset"], same).persist()
    try:
        refused(rows.groupBy("log_file_id", "seq").agg(F.count(F.lit(1)).alias("lines")).filter("lines > 1"), "a number is taken by lines at two offsets")
        marks = reached(rows) if claimed is None else claimed
        if claimed is not None:
            length = rows if "byte_length" in rows.columns else rows.withColumn("byte_length", F.octet_length(F.encode("raw", "ISO-8859-1")) + 1)
            refused(justified(length, claimed), "a watermark is not borne out by its batch")
        there = existing(spark, folder)
        fresh = rows
        if there is not None:
            # only stored lines from the batch's first on can meet it; logs of a batch are few
            lows = rows.groupBy("log_file_id").agg(F.min("byte_offset").alias("low"), F.min("seq").alias("first")).collect()
            within = reduce(lambda x, y: x | y, [(F.col("log_file_id") == r["log_file_id"]) & ((F.col("byte_offset") >= r["low"]) | (F.col("seq") >= r["first"])) for r in lows], F.lit(False))
            old = there.filter(within)
            known = old.select("log_file_id", "byte_offset", F.struct(*same).alias("_old"))
            met = rows.withColumn("_new", F.struct(*same)).join(known, ["log_file_id", "byte_offset"], "left")
            refused(met.filter(F.col("_old").isNotNull() & ~F.col("_old").eqNullSafe(F.col("_new"))).select("log_file_id", "byte_offset"), "a replayed line differs from the one stored at its offset")
            fresh = met.filter("_old is null").select(*rows.columns)
            refused(fresh.join(old.select("log_file_id", "seq"), ["log_file_id", "seq"], "left_semi").select("log_file_id", "seq"), "a number is taken by a line at another offset")
        n = fresh.count()
        stored = existing(spark, marks_of(folder))
        heads = None if stored is None else heads_of(stored)
        if n and heads is not None:
            back = marks.alias("m").join(heads.alias("h"), "log_file_id").filter("m.byte_offset < h.byte_offset or m.seq < h.seq").select("log_file_id", "m.byte_offset", "m.seq")
            refused(back.join(fresh.select("log_file_id").distinct(), "log_file_id", "left_semi"), "a watermark moves back")
        if n:
            fresh.write.mode("append").partitionBy("log_file_id").parquet(folder)
        ahead = marks.select("log_file_id", "byte_offset", "seq")
        if heads is not None:
            ahead = ahead.alias("m").join(heads.alias("h"), "log_file_id", "left").filter("h.seq is null or m.seq > h.seq").select("log_file_id", "m.byte_offset", "m.seq")
        ahead.coalesce(1).write.mode("append").parquet(marks_of(folder))
        return n
    finally:
        rows.unpersist()


def marks_of(folder: str) -> str:
    """Where the watermarks of an event table are: beside it."""
    return folder.rstrip("/") + ".watermarks"


def heads_of(marks: DataFrame) -> DataFrame:
    """The last watermark of each log."""
    return marks.groupBy("log_file_id").agg(F.max("byte_offset").alias("byte_offset"), F.max("seq").alias("seq"))


def registered_heads(events: DataFrame) -> DataFrame:
    """``log_file_id, byte_offset, seq, last_ts``: where each log's next read starts, from stored lines.

    The offset is that after the last line's terminator, one byte long unless the line's length was stored.
    """
    length = F.col("byte_length") if "byte_length" in events.columns else F.octet_length(F.encode("raw", "ISO-8859-1")) + 1
    return events.groupBy("log_file_id").agg(F.max(F.col("byte_offset") + length).alias("byte_offset"), F.max("seq").alias("seq"), F.max_by("ts", "seq").alias("last_ts"))
