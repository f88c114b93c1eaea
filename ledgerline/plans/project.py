"""Projections: every derived table from the event table, as one plan.

A rebuild is the plan itself; nothing is updated in place.  `Projections.write` persists the tables, partitioned by log,
so that an update recomputes only the logs that grew.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import encounters as enc
from ledgerline.operators import ledgers, resolve, rollup
from ledgerline.operators.sessions import first_seen_ids, visits, with_sessions
from ledgerline.operators.sessions import sessions as session_rows
from ledgerline.schema import TRUST, Options

#: A table written by other rules than these must be rebuilt.
VERSION = 1


@dataclass
class Projections:
    """Lazily built tables over `events`; `files` has ``log_file_id, path, character, server``."""

    events: DataFrame
    files: DataFrame
    overrides: DataFrame | None = None
    options: Options = Options()
    signals: DataFrame | None = None

    def shared(self) -> Projections:
        """Keep what most tables start from; lost parts are computed again from the events."""
        self.timeline = self.timeline.persist()
        self.attached = self.attached.persist()
        return self

    def release(self) -> None:
        for rows in (self.timeline, self.attached):
            rows.unpersist()

    @cached_property
    def states(self) -> DataFrame:
        return resolve.resolved(self.events, self.files, self.overrides, self.signals)

    @cached_property
    def timeline(self) -> DataFrame:
        """Events with sessions and the sides of combat lines."""
        off = (F.col("type") == "log_toggle") & (F.col("state") == "OFF")
        rows = with_sessions(self.events, ["log_file_id"], "seq", "ts", self.options.session_gap_ms, off)
        return resolve.with_sides(rows, self.states)

    @cached_property
    def sessions(self) -> DataFrame:
        rows = session_rows(self.timeline, ["log_file_id"], "seq", "ts")
        owner = self.files.select("log_file_id", resolve.owner_of(F.col("character")).alias("character_name"))
        return rows.join(F.broadcast(owner), "log_file_id", "left").select("log_file_id", F.col("session_no").alias("session_id"), "started_ts", "ended_ts", F.col("max_ts").alias("last_ts"), "events", "character_name")

    @cached_property
    def zone_visits(self) -> DataFrame:
        rows = visits(self.timeline, F.col("type") == "zone_enter", ["log_file_id", "session_no"], "seq", "ts", "zone")
        return rows.withColumnRenamed("session_no", "session_id")

    @cached_property
    def zones(self) -> DataFrame:
        rows = self.events.filter("type = 'zone_enter'").withColumnRenamed("zone", "name")
        instance = F.trim("name").rlike(r"(?:^|\W)Expedition\z")
        return first_seen_ids(rows, "name", F.struct("log_file_id", "seq"), name="zone_id").select("zone_id", "name", instance.alias("is_instance"))

    @cached_property
    def attached(self) -> DataFrame:
        return enc.attached(self.timeline, self.options)

    @cached_property
    def encounters(self) -> DataFrame:
        return enc.encounters(self.timeline, self.attached, self.options)

    @cached_property
    def participants(self) -> DataFrame:
        return enc.participants(self.timeline, self.attached, self.encounters)

    @cached_property
    def deeds(self) -> DataFrame:
        told = self.overrides is not None or self.signals is not None
        return rollup.contributions(self.timeline, self.attached, self.encounters, resolve.resolver_heads(self.states) if told else None)

    @cached_property
    def actor_stats(self) -> DataFrame:
        return rollup.actor_stats(self.deeds, self.encounters)

    @cached_property
    def buckets(self) -> DataFrame:
        return rollup.buckets(self.deeds)

    @cached_property
    def entities(self) -> DataFrame:
        """Named participants of each log by first appearance; pets known from chatter alone have no row."""
        stage = F.when(F.col("type") == "pet_chatter", 9).otherwise(0)
        seen = self.states.filter("type not in ('pet_chatter', 'owner_signal')").select("log_file_id", F.col("canonical").alias("name"), F.struct("seq", stage.alias("stage"), "pos").alias("at"))
        opened = self.sessions.select("log_file_id", F.col("character_name").alias("name"), "session_id").groupBy("log_file_id", "name").agg(F.min("session_id").alias("session_id"))
        first = self.timeline.groupBy("log_file_id", F.col("session_no").alias("session_id")).agg(F.min("seq").alias("seq"))
        owners = opened.join(first, ["log_file_id", "session_id"]).select("log_file_id", "name", F.struct("seq", F.lit(1).alias("stage"), F.lit(0).alias("pos")).alias("at"))
        actors = self.deeds.select("log_file_id", "seq", F.explode(F.array(F.col("actor"), F.col("attrib_owner"))).alias("name")).filter("name is not null").select("log_file_id", "name", F.struct("seq", F.lit(3).alias("stage"), F.lit(0).alias("pos")).alias("at"))
        ids = first_seen_ids(seen.unionByName(owners).unionByName(actors), "name", "at", ["log_file_id"], "entity_id")
        heads = resolve.resolver_heads(self.states).withColumnRenamed("canonical", "name")
        source = F.when(F.col("user"), "user").when(F.col("name") == F.col("owner_name"), "system").otherwise("heuristic")
        rows = ids.join(heads, ["log_file_id", "name"], "left")
        return rows.select("log_file_id", "entity_id", "name", F.coalesce("kind", F.lit("unknown")).alias("kind"), source.alias("classification_source"), F.coalesce("kind_confidence", F.lit(0.0)).alias("confidence"), "first_seen_ts", "last_seen_ts")

    @cached_property
    def entity_links(self) -> DataFrame:
        """The best link of each pet, with the number and times of its evidence; active while the name is a pet."""
        rows = resolve.resolver_heads(self.states)
        by_user = (F.col("kind") == "pet") & F.col("user") & (F.col("link_confidence") == 1.0)
        rows = rows.withColumn("owner", F.coalesce("link_owner", F.when(F.col("best_link_evidence").isNotNull(), F.col("owner_name")))).filter("owner is not null")
        chatter = F.col("best_link_evidence") == TRUST["pet_chatter"]
        return rows.select(
            "log_file_id", F.col("canonical").alias("pet"), "owner", F.when(by_user, "user_assertion").when(chatter, "pet_chatter").otherwise("damage_shield_possessive").alias("evidence_type"),
            F.coalesce("link_confidence", "best_link_evidence").alias("confidence"), F.col("evidence_count"), F.col("link_first_ts").alias("first_ts"), F.col("link_last_ts").alias("last_ts"), F.col("link_owner").isNotNull().alias("active"),
        )

    @cached_property
    def xp_events(self) -> DataFrame:
        return ledgers.xp_events(self.timeline, self.attached, self.encounters, self.options)

    @cached_property
    def aa_events(self) -> DataFrame:
        return ledgers.aa_events(self.timeline)

    @cached_property
    def loot_events(self) -> DataFrame:
        return ledgers.loot_events(self.timeline)

    @cached_property
    def currency_ledger(self) -> DataFrame:
        return ledgers.currency_ledger(self.timeline)

    @cached_property
    def faction_events(self) -> DataFrame:
        return ledgers.faction_events(self.timeline)

    @cached_property
    def skill_events(self) -> DataFrame:
        return ledgers.skill_events(self.timeline)

    @property
    def event_links(self) -> DataFrame:
        """``log_file_id, seq, session_id, encounter_id`` of every event."""
        ids = self.attached.join(self.encounters.select("log_file_id", "opener_seq", "encounter_id"), ["log_file_id", "opener_seq"]).select("log_file_id", "seq", "encounter_id")
        return self.timeline.select("log_file_id", "seq", F.col("session_no").alias("session_id")).join(ids, ["log_file_id", "seq"], "left")

    TABLES = ("sessions", "zones", "zone_visits", "entities", "entity_links", "encounters", "participants", "actor_stats", "buckets", "xp_events", "aa_events", "loot_events", "currency_ledger", "faction_events", "skill_events", "event_links")

    def write(self, folder: str, only: tuple[str, ...] = TABLES, replaced: tuple[int, ...] = ()) -> None:
        """Write the tables below `folder`; tables with a log's rows are partitioned by it and replaced log by log.

        The old rows of logs named in `replaced` go even where a log has no rows any more.
        """
        for name in only:
            rows = getattr(self, name)
            out = rows.withColumn("projector_version", F.lit(VERSION)).write.mode("overwrite")
            if "log_file_id" in rows.columns:
                for number in replaced:
                    removed(self.events.sparkSession, f"{folder}/{name}/log_file_id={number}")
                out = out.partitionBy("log_file_id").option("partitionOverwriteMode", "dynamic")
            out.parquet(f"{folder}/{name}")


def removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def updated(folder: str, events: DataFrame, files: DataFrame, watermark: DataFrame | None, overrides: DataFrame | None = None, options: Options = Options(), signals: DataFrame | None = None) -> DataFrame:
    """Recompute the logs whose last event is beyond the watermark, write them, and return the new watermark.

    The result equals a rebuild, since a log's tables depend on its own events, corrections and signals alone; where
    these change for a log, leave it out of the watermark.  A call that was cut off is repeated with the old watermark.
    """
    heads = events.groupBy("log_file_id").agg(F.max("seq").alias("seq"))
    if watermark is not None:
        done = watermark.filter(F.col("version") == VERSION).select("log_file_id", F.col("seq").alias("done"))
        grown = heads.join(done, "log_file_id", "left").filter("done is null or seq > done").select("log_file_id")
    else:
        grown = heads.select("log_file_id")
    numbers = tuple(r["log_file_id"] for r in grown.collect())  # numbers of logs, not data
    rows = events.filter(F.col("log_file_id").isin(*numbers)) if numbers else events.limit(0)
    p = Projections(rows, files, overrides, options, signals).shared()
    try:
        p.write(folder, tuple(t for t in Projections.TABLES if t != "zones"), numbers)
    finally:
        p.release()
    Projections(events, files, overrides, options, signals).write(folder, ("zones",))
    return heads.withColumn("version", F.lit(VERSION))
