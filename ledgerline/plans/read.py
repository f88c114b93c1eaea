"""The read API: questions over the projections, each a DataFrame.  Rates are computed here and are 0 without a span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.bootstrap import bootstrap, verdict
from ledgerline.operators.rollup import folded
from ledgerline.plans.project import Projections

HOUR = 3_600_000


def rate(amount: Column, span_ms: Column, unit_ms: int) -> Column:
    return F.when(span_ms > 0, amount / (span_ms / unit_ms)).otherwise(F.lit(0.0))


def matching(rows: DataFrame, **equal) -> DataFrame:
    """Rows equal in those columns that are given; None asks for nothing."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows


def get_sessions(p: Projections, log_file_id: int | None = None) -> DataFrame:
    return matching(p.sessions, log_file_id=log_file_id).orderBy("started_ts", "log_file_id", "session_id")


def _per_session(rows: DataFrame, *aggregates: Column) -> DataFrame:
    return rows.groupBy("log_file_id", F.col("session_no").alias("session_id")).agg(*aggregates)


def session_summaries(p: Projections) -> DataFrame:
    """One row per session: spans, counts, experience, coin, rates, zones in order of entry."""
    key = ["log_file_id", "session_id"]
    span = F.greatest(F.lit(0), F.coalesce("ended_ts", "last_ts", "started_ts") - F.col("started_ts"))
    base = p.sessions.select(*key, "started_ts", "ended_ts", span.cast("long").alias("span_ms"))
    fights = _per_session(p.encounters, F.sum(F.col("ended_ts") - F.col("started_ts")).alias("active_ms"), F.count(F.lit(1)).alias("encounter_count"))
    xp = _per_session(p.xp_events.filter("kind = 'normal'"), F.sum("percent_milli").alias("xp_percent_milli"))
    coin = _per_session(p.currency_ledger, F.sum("delta_copper").alias("coin_copper"))
    entered = p.zone_visits.groupBy(*key, "zone").agg(F.min("entered_ts").alias("t"))
    zones = entered.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "zone"))), lambda x: x["zone"]).alias("zones"))
    rows = base
    for other in (fights, xp, coin, zones):
        rows = rows.join(other, key, "left")
    rows = rows.na.fill(0, ["active_ms", "encounter_count", "xp_percent_milli", "coin_copper"])
    return rows.select(
        *key, "started_ts", "ended_ts", "span_ms", "active_ms", F.greatest(F.lit(0), F.col("span_ms") - F.col("active_ms")).alias("afk_ms"), "encounter_count", "xp_percent_milli",
        rate(F.col("xp_percent_milli"), F.col("span_ms"), HOUR).alias("xp_per_hour"), "coin_copper", rate(F.col("coin_copper"), F.col("span_ms"), HOUR).alias("coin_per_hour"), F.coalesce("zones", F.array().cast("array<string>")).alias("zones"),
    )


def get_session_summary(p: Projections, session_id: int, log_file_id: int | None = None) -> DataFrame:
    return matching(session_summaries(p), session_id=session_id, log_file_id=log_file_id)


def top_actors(p: Projections) -> DataFrame:
    """Per encounter the folded actor of most damage, ties to the smaller id; none where there is no damage."""
    fold = p.actor_stats.groupBy("log_file_id", "encounter_id", F.coalesce("attrib_owner", "actor").alias("name")).agg(F.sum("damage_total").alias("damage"))
    ids = fold.join(p.entities.select("log_file_id", "name", "entity_id"), ["log_file_id", "name"], "left")
    best = ids.groupBy("log_file_id", "encounter_id").agg(F.max(F.struct("damage", (-F.col("entity_id")).alias("order"), "name")).alias("t"))
    return best.filter("t.damage > 0").select("log_file_id", "encounter_id", F.col("t.name").alias("top_actor"), F.col("t.damage").alias("top_damage"))


def list_encounters(p: Projections, session_id: int | None = None, zone: str | None = None, scale: str | None = None, since: int | None = None, log_file_id: int | None = None) -> DataFrame:
    rows = matching(p.encounters.withColumnRenamed("session_no", "session_id"), session_id=session_id, zone_name=zone, scale=scale, log_file_id=log_file_id)
    if since is not None:
        rows = rows.filter(F.col("started_ts") >= since)
    rows = rows.withColumn("duration_ms", F.coalesce("ended_ts", "started_ts") - F.col("started_ts")).join(top_actors(p), ["log_file_id", "encounter_id"], "left")
    rows = rows.withColumn("top_actor_dps", F.coalesce(rate(F.col("top_damage"), F.col("duration_ms"), 1000), F.lit(0.0))).drop("top_damage", "opener_seq", "active_stance", "active_invocation")
    return rows.orderBy("started_ts", "log_file_id", "encounter_id")


SUMS = ["damage_total", "melee_damage", "spell_damage", "dot_damage", "ds_damage", "hit_count", "miss_count", "heal_total", "overheal_total", "duration_ms"]


def get_actor_stats(p: Projections, encounter_id: int | None = None, session_id: int | None = None, fold_pets: bool = True, log_file_id: int | None = None) -> DataFrame:
    """Per actor, or per owner with pets folded in.  The duration of an encounter counts once for each actor in it."""
    rows = matching(p.actor_stats, encounter_id=encounter_id, log_file_id=log_file_id)
    if session_id is not None:
        rows = rows.join(p.encounters.filter(F.col("session_no") == session_id).select("log_file_id", "encounter_id"), ["log_file_id", "encounter_id"], "left_semi")
    source = rows if fold_pets else rows.withColumn("_owner", F.col("attrib_owner")).withColumn("attrib_owner", F.lit(None).cast("string"))
    extra = [] if fold_pets else ["_owner"]
    out = folded(source, ["log_file_id", "encounter_id"], "actor", "attrib_owner", SUMS, ["max_hit", "duration_ms", *extra], ["active_stance", "active_invocation"])
    one = F.lit(encounter_id is not None)
    out = out.select(
        F.col("folded").alias("actor"), (F.lit(None).cast("string") if fold_pets else F.col("_owner")).alias("attrib_owner"), *SUMS, "max_hit", rate(F.col("damage_total"), F.col("duration_ms"), 1000).alias("dps"), rate(F.col("heal_total"), F.col("duration_ms"), 1000).alias("hps"),
        *[F.when(one, F.col(c)).alias(c) for c in ("active_stance", "active_invocation")],
    )
    return out.join(first_ids(p), "actor", "left").orderBy(F.desc("damage_total"), "first_id", "actor").drop("first_id")


def first_ids(p: Projections) -> DataFrame:
    """``actor, first_id``: the place of each name by log and entity id, which breaks ties."""
    return p.entities.groupBy(F.col("name").alias("actor")).agg(F.min(F.struct("log_file_id", "entity_id")).alias("first_id"))


def min_confidence(p: Projections, encounter_id: int | None = None, session_id: int | None = None) -> DataFrame:
    """One row: the least confidence of any attribution in scope; 1 where nothing is attributed."""
    rows = matching(p.actor_stats, encounter_id=encounter_id)
    if session_id is not None:
        rows = rows.join(p.encounters.filter(F.col("session_no") == session_id).select("log_file_id", "encounter_id"), ["log_file_id", "encounter_id"], "left_semi")
    links = p.entity_links.filter("active").groupBy("log_file_id", F.col("pet").alias("actor"), F.col("owner").alias("attrib_owner")).agg(F.max("confidence").alias("c"))
    joined = rows.join(links, ["log_file_id", "actor", "attrib_owner"], "left")
    sure = F.when(F.col("attrib_owner").isNull(), 1.0).otherwise(F.coalesce("c", F.lit(0.5)))
    return joined.agg(F.coalesce(F.min(sure), F.lit(1.0)).alias("min_confidence"))


def get_encounter(p: Projections, encounter_id: int, log_file_id: int | None = None) -> dict[str, DataFrame]:
    """Header, participants, actors with and without the fold, and buckets of one encounter."""
    ids = p.entities.select("log_file_id", "name", "entity_id")
    people = matching(p.participants, encounter_id=encounter_id, log_file_id=log_file_id).join(ids, ["log_file_id", "name"], "left").orderBy("role", "entity_id")
    return {
        "header": matching(list_encounters(p, log_file_id=log_file_id), encounter_id=encounter_id),
        "participants": people,
        "actors": get_actor_stats(p, encounter_id, fold_pets=False, log_file_id=log_file_id),
        "actors_folded": get_actor_stats(p, encounter_id, log_file_id=log_file_id),
        "buckets": matching(p.buckets, encounter_id=encounter_id, log_file_id=log_file_id).join(ids.withColumnRenamed("name", "actor"), ["log_file_id", "actor"], "left").orderBy("bucket_ts", "entity_id"),
    }


def xp_rates(p: Projections) -> DataFrame:
    """Per session: experience, the part attributed to encounters, kills in encounters, and the hourly rate."""
    gains = _per_session(p.xp_events.filter("kind = 'normal'"), F.sum("percent_milli").alias("total_percent_milli"), F.sum(F.when(F.col("attributed_encounter_id").isNotNull(), F.col("percent_milli")).otherwise(0)).alias("attributed_percent_milli"))
    kills = p.event_links.filter("encounter_id is not null").join(p.events.filter("type = 'kill'").select("log_file_id", "seq"), ["log_file_id", "seq"], "left_semi").groupBy("log_file_id", "session_id").agg(F.count(F.lit(1)).alias("kill_count"))
    rows = session_summaries(p).select("log_file_id", "session_id", "span_ms").join(gains, ["log_file_id", "session_id"], "left").join(kills, ["log_file_id", "session_id"], "left")
    rows = rows.na.fill(0, ["total_percent_milli", "attributed_percent_milli", "kill_count"])
    return rows.withColumn("xp_per_hour", rate(F.col("total_percent_milli"), F.col("span_ms"), HOUR))


def _ledger(rows: DataFrame, session_id: int | None) -> DataFrame:
    return matching(rows.withColumnRenamed("session_no", "session_id"), session_id=session_id).orderBy("ts", "log_file_id", "seq")


def get_loot(p: Projections, session_id: int | None = None) -> DataFrame:
    return _ledger(p.loot_events, session_id)


def get_currency(p: Projections, session_id: int | None = None) -> DataFrame:
    return _ledger(p.currency_ledger, session_id)


def get_faction_changes(p: Projections, session_id: int) -> DataFrame:
    return _ledger(p.faction_events, session_id)


DIMENSIONS, METRICS = ("stance", "invocation", "zone", "difficulty", "weapon"), ("dps", "hps", "xp_per_hr")


def experiment_metrics(p: Projections, dimension: str, metric: str) -> DataFrame:
    """``value, metric`` of each encounter with a span and a value of the dimension."""
    if dimension not in DIMENSIONS or metric not in METRICS:
        raise ValueError(f"no such dimension or metric: {dimension}, {metric}")
    key = ["log_file_id", "encounter_id"]
    deeds = p.actor_stats.groupBy(*key).agg(F.sum("damage_total").alias("damage"), F.sum("heal_total").alias("heal"), F.min("active_stance").alias("stance"), F.min("active_invocation").alias("invocation"))
    xp = p.xp_events.filter("kind = 'normal' and attributed_encounter_id is not null").groupBy("log_file_id", F.col("attributed_encounter_id").alias("encounter_id")).agg(F.sum("percent_milli").alias("xp"))
    rows = p.encounters.select(*key, "zone_name", "difficulty_tier", (F.coalesce("ended_ts", "started_ts") - F.col("started_ts")).alias("dur")).join(deeds, key, "left").join(xp, key, "left")
    value = {"stance": F.col("stance"), "invocation": F.col("invocation"), "zone": F.coalesce("zone_name", F.lit("Unknown Zone")), "difficulty": F.coalesce("difficulty_tier", F.lit("unknown")), "weapon": F.lit(None).cast("string")}[dimension]
    amount, unit = {"dps": ("damage", 1000), "hps": ("heal", 1000), "xp_per_hr": ("xp", HOUR)}[metric]
    return rows.filter("dur > 0").select(value.alias("value"), (F.coalesce(amount, F.lit(0)) / (F.col("dur") / unit)).alias("metric")).filter("value is not null")


def get_experiment_breakdown(p: Projections, dimension: str, metric: str) -> tuple[DataFrame, DataFrame]:
    """(groups by falling mean, verdict): who wins, or why nobody does."""
    o = p.options
    groups = bootstrap(experiment_metrics(p, dimension, metric), "value", "metric", o.resamples, o.seed, o.ci_percent).orderBy(F.desc("mean"), "value")
    decided = verdict(groups, o.min_n)
    if dimension == "weapon":
        decided = decided.withColumn("refused_reason", F.lit("weapon dimension has no verified log source in M1"))
    return groups, decided


def live_view(p: Projections, recent: int = 10) -> DataFrame:
    """One row per log: the current session (open, else the latest), the current fight and the latest closed ones.

    The current fight is the active one that was touched last.
    """
    s = p.sessions.groupBy("log_file_id").agg(F.max_by(F.struct("session_id", "started_ts", "ended_ts"), F.struct(F.col("ended_ts").isNull(), "started_ts", "session_id")).alias("session"))
    heads = list_encounters(p)
    shown = F.struct("encounter_id", "name", "status", "scale", "started_ts", "ended_ts", "duration_ms", "top_actor", "top_actor_dps")
    mine = heads.join(s.select("log_file_id", F.col("session.session_id").alias("session_id")), ["log_file_id", "session_id"], "left_semi")
    order = F.struct("ended_ts", "started_ts", "encounter_id")
    now = mine.filter("status = 'active'").groupBy("log_file_id").agg(F.max_by(shown, order).alias("current"))
    ranked = mine.filter("status = 'closed'").withColumn("_n", F.row_number().over(Window.partitionBy("log_file_id").orderBy(F.desc("ended_ts"), F.desc("started_ts"), F.desc("encounter_id")))).filter(F.col("_n") <= recent)
    closed = ranked.groupBy("log_file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", shown.alias("e")))), lambda x: x["e"]).alias("recent"))
    ranks = Window.partitionBy("log_file_id", "encounter_id").orderBy(F.desc("dps"), "actor")
    fold = p.actor_stats.groupBy("log_file_id", "encounter_id", F.coalesce("attrib_owner", "actor").alias("actor")).agg(F.sum("damage_total").alias("damage"), F.max("duration_ms").alias("ms"))
    fold = fold.join(now.select("log_file_id", F.col("current.encounter_id").alias("encounter_id")), ["log_file_id", "encounter_id"], "left_semi")
    actors = fold.withColumn("dps", rate(F.col("damage"), F.col("ms"), 1000)).withColumn("_n", F.row_number().over(ranks)).groupBy("log_file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "actor", "damage", "dps"))), lambda x: F.struct(x["actor"].alias("actor"), x["damage"].alias("damage"), x["dps"].alias("dps"))).alias("actors"))
    seq = p.events.groupBy("log_file_id").agg(F.max("seq").alias("seq"))
    return seq.join(s, "log_file_id", "left").join(now, "log_file_id", "left").join(closed, "log_file_id", "left").join(actors, "log_file_id", "left")
