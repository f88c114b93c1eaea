"""A folder of growing logs, followed: ingest, projections and the live view, with news for whoever listens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.encounters import finalized
from ledgerline.plans.project import VERSION, Projections, updated
from ledgerline.plans.read import live_view
from ledgerline.schema import Options
from ledgerline.streaming.ingest import ingest, known_files
from ledgerline.streaming.tail import tail


class LiveLogs:
    """Status goes from ``new`` over ``replaying`` to ``live`` or ``stopped``; ``failed`` keeps the last view readable.

    What is there is read to its end by `start`, which raises if it can't; later failures show in `status` and `error`.
    Projections are caught up by `refresh`, a heartbeat for the caller's own clock.
    """

    def __init__(self, spark: SparkSession, logs: str, store: str, options: Options | None = None, **tailing):
        self.spark, self.options, self.tailing = spark, options or Options(), tailing
        self.logs, self.events, self.tables, self.checkpoint = logs, f"{store}/events", f"{store}/tables", f"{store}/checkpoint"
        self.status, self.error, self.query = "new", None, None
        self.heads: dict[int, int] = {}
        self.listeners: list[Callable[[DataFrame], None]] = []

    def start(self, live: bool = True) -> DataFrame:
        """Read what is there, then follow it, or else close every encounter.  Returns the first view."""
        if self.status != "new":
            raise RuntimeError("it was started before")
        self.status = "replaying"
        ingest(tail(self.spark, self.logs, **self.tailing), self.events, self.checkpoint).awaitTermination()
        self._catch_up()
        if live:
            self.query = ingest(tail(self.spark, self.logs, **self.tailing), self.events, self.checkpoint, once=False)
        self.status = "live" if live else "stopped"
        self.finished = not live
        return self.view()

    def _projections(self) -> Projections:
        known = known_files(self.spark, self.events)
        # one row a file; as plain rows they keep the patterns of their names out of every plan
        return Projections(self.spark.read.parquet(self.events), self.spark.createDataFrame(known.collect(), known.schema), options=self.options)

    def _catch_up(self) -> bool:
        """Bring the tables to the stored events; whether any log has grown."""
        p = self._projections()
        heads = {r["log_file_id"]: r["seq"] for r in p.events.groupBy("log_file_id").agg(F.max("seq").alias("seq")).collect()}  # one row a log
        if heads == self.heads:
            return False
        done = self.spark.createDataFrame([(n, s, VERSION) for n, s in self.heads.items()], "log_file_id long, seq long, version int")
        updated(self.tables, p.events, p.files, done, options=self.options)
        self.heads = heads
        return True

    def view(self) -> DataFrame:
        """The live view of what is stored, one row a log."""
        if self.status in ("new", "replaying"):
            raise RuntimeError("it was not started")
        p = self._projections()
        if self.finished:
            p.encounters = finalized(p.encounters, options=self.options)
        return live_view(p)

    def refresh(self) -> DataFrame:
        """Catch up and return the view; listeners hear it if, and only if, a log has grown since the last time."""
        if self.status in ("new", "replaying"):
            raise RuntimeError("it was not started")
        if self.query is not None and (failure := self.query.exception()) is not None:
            self.status, self.error = "failed", failure
        grown = self._catch_up()
        view = self.view()
        if grown:
            for hear in list(self.listeners):
                hear(view)
        return view

    def on_update(self, hear: Callable[[DataFrame], None]) -> Callable[[], None]:
        """Have `hear` called with each new view; the function returned ends that."""
        self.listeners.append(hear)
        return lambda: self.listeners.remove(hear) if hear in self.listeners else None

    def stop(self) -> None:
        """Stop following; the last view stays readable."""
        if self.query is not None:
            self.query.stop()
        if self.status == "live":
            self.status = "stopped"
