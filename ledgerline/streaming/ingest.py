"""Live ingest and live answers: lines to events to tables, micro-batch by micro-batch."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerline.operators.encounters import ASSIGNED, Fight, assign, combat_rows
from ledgerline.operators.parse import events_of
from ledgerline.operators.rules import Registry
from ledgerline.schema import Options
from ledgerline.sources.log_files import character_and_server
from ledgerline.sources.sink import append_events


def ingest(lines: DataFrame, folder: str, checkpoint: str, registry: Registry | None = None, once: bool = True) -> StreamingQuery:
    """Append a stream of lines to the event table.

    Exactly once in effect: the checkpoint names the offsets of a batch, and a batch that is run again adds nothing.  Which
    file has which number is stored beside the events (`known_files`).
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.select("path", "log_file_id").distinct().coalesce(1).write.mode("overwrite").parquet(f"{files_of(folder)}/batch={number}")
        append_events(events_of(batch.withColumn("seq", F.col("line_no")), registry), folder)

    out = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime="200 milliseconds")).start()


def files_of(folder: str) -> str:
    """Where the names of an event table's files are: beside it."""
    return folder.rstrip("/") + ".files"


def known_files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, log_file_id, character, server`` of the files of an ingested event table."""
    rows = spark.read.schema("path string, log_file_id long").parquet(files_of(folder)).select("path", "log_file_id").distinct()
    character, server = character_and_server(F.col("path"))
    return rows.select("path", "log_file_id", character.alias("character"), server.alias("server"))


def attached_stream(events: DataFrame, options: Options | None = None) -> DataFrame:
    """The encounter machine over a stream of events with sides and sessions; state is the open fights of a session.

    Rows of a session must arrive in order of batches, as a tailed file's do; within a batch they are sorted by number.
    """
    options = options or Options()

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        active = {f[0]: Fight(*f) for f in json.loads(state.get[0])} if state.exists else {}
        frame = pd.concat(list(frames)).sort_values("seq").astype({"a": object, "b": object, "enemy": object})
        frame = frame.where(frame.notna(), None)
        found = assign(zip(*(frame[c].tolist() for c in ("seq", "ts", "what", "a", "b", "enemy", "ts")), strict=True), options, active)
        state.update((json.dumps([[f.enemy, f.opener, f.ended, sorted(f.allies), f.raid] for f in active.values()]),))
        out = pd.DataFrame(found, columns=["seq", "opener_seq", "enemy"])
        out.insert(0, "session_no", key[1])
        out.insert(0, "log_file_id", key[0])
        yield out

    return combat_rows(events, options).groupBy("log_file_id", "session_no").applyInPandasWithState(run, ASSIGNED, "fights string", "append", GroupStateTimeout.NoTimeout)


def session_stream(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Approximate sessions by event time: gaps alone part them, an explicit end does not, and time orders them.

    The exact form is `ledgerline.operators.sessions.with_sessions` over the stored events.
    """
    timed = events.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", late)
    return timed.groupBy("log_file_id", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("events"), F.min("ts").alias("started_ts"), F.max("ts").alias("last_ts")).drop("w")


def bucket_stream(events: DataFrame, width: str = "1 second", late: str = "1 hour") -> DataFrame:
    """Amounts per log and tumbling window."""
    timed = events.withColumn("at", F.timestamp_millis("ts")).withWatermark("at", late)
    rows = timed.filter("amount is not null").groupBy("log_file_id", F.window("at", width).alias("w"))
    return rows.agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("hits")).select("log_file_id", F.unix_millis("w.start").alias("bucket_ms"), "amount", "hits")
