"""Sessions by gap or by an explicit end, and visits within them.  Generic over part, order and time columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_sessions(events: DataFrame, part: list[str], order: str, ts: str, gap: int, closes: Column | None = None, name: str = "session_no") -> DataFrame:
    """Number the sessions of each part from 1 in `order`.

    A session starts at the first row, where time has moved on by more than `gap`, and after a row that `closes` marks.
    Order decides, not time: time that runs backwards never starts one.
    """
    w = Window.partitionBy(*part).orderBy(order)
    closed = F.coalesce(F.lag(closes).over(w), F.lit(False)) if closes is not None else F.lit(False)
    start = F.lag(F.col(ts)).over(w).isNull() | (F.col(ts) - F.lag(F.col(ts)).over(w) > gap) | closed
    return events.withColumn("_start", start.cast("int")).withColumn(name, F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_start")


def sessions(events: DataFrame, part: list[str], order: str, ts: str, session: str = "session_no") -> DataFrame:
    """One row per session: ``started_ts, ended_ts, last_ts, events``; the last session of a part is open, its end null."""
    per = events.groupBy(*part, session).agg(F.min_by(ts, order).alias("started_ts"), F.max_by(ts, order).alias("last_ts"), F.max(ts).alias("max_ts"), F.min(order).alias("first_order"), F.count(F.lit(1)).alias("events"))
    later = F.lead(session).over(Window.partitionBy(*part).orderBy(session))
    return per.withColumn("ended_ts", F.when(later.isNotNull(), F.col("last_ts")))


def visits(events: DataFrame, enters: Column, part: list[str], order: str, ts: str, place: str) -> DataFrame:
    """Visits of a part (a session): entered at each row that `enters` marks, left at the next such row; the last stays open."""
    w = Window.partitionBy(*part).orderBy(order)
    rows = events.filter(enters).select(*part, F.col(order), F.col(place), F.col(ts).alias("entered_ts"))
    return rows.withColumn("left_ts", F.lead("entered_ts").over(w))


def first_seen_ids(rows: DataFrame, key: str, order: Column | str, part: list[str] | None = None, name: str = "id") -> DataFrame:
    """Distinct keys numbered from 1 by first appearance."""
    first = rows.groupBy(*(part or []), key).agg(F.min(order).alias("first_order"))
    return first.withColumn(name, F.row_number().over(Window.partitionBy(*(part or [])).orderBy("first_order", key)))
