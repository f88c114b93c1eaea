"""Queries over the engine's own projections: driver events told as three logs, and the SQL that the tables must equal.

Every event of the driver's table becomes one typed event of the log of its user (three logs), numbered by its id: views
and clicks are blows of the owner and of a pet, purchases kills, sign-ups zones and levels, errors experience, coins,
stances and ends of logging.  From there on the engine runs as it does on parsed lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.resolve import link_conflicts
from ledgerline.plans import read
from ledgerline.plans.driver_queries import EV, ORACLES, QUERIES, events_of, query
from ledgerline.plans.project import Projections
from ledgerline.schema import BASE, PAYLOAD, Options

GAP, TIMEOUT, WINDOW = 1_800_000, 900_000, 1_200_000
OPTIONS = Options(session_gap_ms=GAP, group_timeout_ms=TIMEOUT, raid_allies=1000, kill_window_ms=WINDOW)
MOBS = ("a rat", "a bat", "Lord Grey")


def told(spark: SparkSession, sf_dir: str) -> Projections:
    """The projections of the driver's events."""
    e = events_of(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k, kind, cents = F.col("k"), F.col("event_type"), F.col("cents")
    chat = (kind == "click") & (k % 4 == 0)
    type_ = (
        F.when(chat, "pet_chatter").when(kind.isin("view", "click"), "melee_hit").when(kind == "purchase", "kill")
        .when((kind == "signup") & (k % 5 == 0), "level_up").when(kind == "signup", "zone_enter")
        .when(k % 4 == 0, "xp_gain").when(k % 4 == 1, "coin_gain").when(k % 4 == 2, "stance_change").otherwise("log_toggle")
    )
    e = e.withColumn("type", type_)
    is_ = lambda x: F.col("type") == x
    mob = F.element_at(F.array(*[F.lit(m) for m in MOBS]), F.when(kind == "click", k % 2).otherwise(k % 3) + 1)
    fields = {
        "attacker": F.when(is_("melee_hit"), F.when(kind == "click", "Rover").otherwise("You")),
        "target": F.when(is_("melee_hit") | is_("kill"), mob),
        "killer": F.when(is_("kill"), "You"),
        "amount": F.when(is_("melee_hit"), cents % 100 + 1),
        "pet": F.when(is_("pet_chatter"), "Rover"),
        "zone": F.when(is_("zone_enter"), F.concat(F.lit("Zone "), k % 4)),
        "level": F.when(is_("level_up"), k % 50 + 1),
        "percent_milli": F.when(is_("xp_gain"), cents % 5000),
        "total_copper": F.when(is_("coin_gain"), cents),
        "stance": F.when(is_("stance_change"), F.concat(F.lit("s"), k % 3)),
        "state": F.when(is_("log_toggle"), "OFF"),
        "modifiers": F.when(is_("melee_hit"), F.array().cast("array<string>")),
    }
    base = {
        "log_file_id": F.col("user_id") % 3 + 1, "seq": F.col("event_id"), "byte_offset": F.col("event_id") * 100, "line_no": F.col("event_id"), "raw": kind, "ts": F.col("ms"),
        "type": F.col("type"), "dialect_id": F.lit("d"), "rule_id": F.lit("r"), "value": F.coalesce(fields["amount"], fields["percent_milli"], fields["total_copper"]),
    }
    rows = e.select(*[base[n].cast(t).alias(n) for n, t in BASE.items()], *[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in PAYLOAD.items()])
    files = spark.createDataFrame([(f"/l{i}", i, f"Hero{'ABC'[i - 1]}", "srv") for i in (1, 2, 3)], "path string, log_file_id long, character string, server string")
    return Projections(rows, files, options=OPTIONS)


TOLD = f"""{EV}, g0 AS (SELECT user_id % 3 + 1 AS log_file_id, event_id AS seq, ms AS ts, cents, event_type AS et, (json_extract(props, '$.k'))::INTEGER AS k FROM ev),
    g AS (SELECT *, CASE WHEN et = 'click' AND k % 4 = 0 THEN 'pet_chatter' WHEN et IN ('view', 'click') THEN 'melee_hit' WHEN et = 'purchase' THEN 'kill' WHEN et = 'signup' AND k % 5 = 0 THEN 'level_up'
        WHEN et = 'signup' THEN 'zone_enter' WHEN k % 4 = 0 THEN 'xp_gain' WHEN k % 4 = 1 THEN 'coin_gain' WHEN k % 4 = 2 THEN 'stance_change' ELSE 'log_toggle' END AS type,
        ['a rat', 'a bat', 'Lord Grey'][CASE WHEN et = 'click' THEN k % 2 ELSE k % 3 END + 1] AS mob, 'Hero' || ['A', 'B', 'C'][log_file_id] AS hero FROM g0),
    f AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > {GAP} OR lag(type) OVER w = 'log_toggle' THEN 1 ELSE 0 END AS s FROM g WINDOW w AS (PARTITION BY log_file_id ORDER BY seq)),
    t AS (SELECT * EXCLUDE (s), sum(s) OVER w::BIGINT AS session_id, last_value(CASE WHEN type = 'zone_enter' THEN 'Zone ' || k % 4 END IGNORE NULLS) OVER w AS zone,
        last_value(CASE WHEN type = 'stance_change' THEN 's' || k % 3 END IGNORE NULLS) OVER w AS stance, last_value(CASE WHEN type = 'level_up' THEN k % 50 + 1 END IGNORE NULLS) OVER w AS level,
        max(CASE WHEN type = 'pet_chatter' THEN 1 ELSE 0 END) OVER w AS linked FROM f WINDOW w AS (PARTITION BY log_file_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
    blows AS (SELECT *, lag(seq) OVER w AS prev, lag(ts) OVER w AS prev_ts FROM t WHERE type IN ('melee_hit', 'kill') WINDOW w AS (PARTITION BY log_file_id, session_id, mob ORDER BY seq)),
    swept AS (SELECT b.*, (SELECT max(x.ts) FROM t x WHERE x.log_file_id = b.log_file_id AND x.session_id = b.session_id AND x.seq > b.prev AND x.seq <= b.seq) - b.prev_ts > {TIMEOUT} AS late FROM blows b),
    marked AS (SELECT *, sum(CASE WHEN prev IS NULL OR late THEN 1 ELSE 0 END) OVER (PARTITION BY log_file_id, session_id, mob ORDER BY seq) AS isle FROM swept),
    hits AS (SELECT *, min(seq) OVER (PARTITION BY log_file_id, session_id, mob, isle) AS opener_seq FROM marked),
    e0 AS (SELECT log_file_id, session_id, mob AS enemy, opener_seq, arg_min(ts, seq) AS started_ts, arg_max(ts, seq) AS ended_ts, max(seq) AS last_seq, arg_min(zone, seq) AS zone_name, arg_min(stance, seq) AS active_stance FROM
        (SELECT * REPLACE (coalesce(zone, '') AS zone, coalesce(stance, '') AS stance) FROM hits) GROUP BY ALL),
    enc AS (SELECT * REPLACE (nullif(zone_name, '') AS zone_name, nullif(active_stance, '') AS active_stance), row_number() OVER (PARTITION BY log_file_id ORDER BY opener_seq) AS encounter_id FROM e0),
    deeds AS (SELECT h.log_file_id, e.encounter_id, h.session_id, h.seq, h.ts, CASE WHEN et = 'click' THEN 'Rover' ELSE hero END AS actor, CASE WHEN et = 'click' AND linked = 1 THEN hero END AS attrib_owner, cents % 100 + 1 AS damage,
        e.ended_ts - e.started_ts AS duration_ms FROM hits h JOIN enc e USING (log_file_id, opener_seq) WHERE h.type = 'melee_hit')"""


@query(f"""WITH {TOLD} SELECT log_file_id, session_id, arg_min(ts, seq) AS started_ts, max(ts) AS last_ts, CASE WHEN lead(session_id) OVER (PARTITION BY log_file_id ORDER BY session_id) IS NOT NULL THEN arg_max(ts, seq) END AS ended_ts,
    count(*) AS events, any_value(hero) AS character_name FROM t GROUP BY log_file_id, session_id""")
def engine_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(spark, sf_dir).sessions


@query(f"WITH {TOLD} SELECT log_file_id, session_id, ts AS entered_ts, lead(ts) OVER (PARTITION BY log_file_id, session_id ORDER BY seq) AS left_ts, 'Zone ' || k % 4 AS zone FROM t WHERE type = 'zone_enter'")
def engine_zone_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(spark, sf_dir).zone_visits.select("log_file_id", "session_id", "entered_ts", "left_ts", "zone")


@query(f"""WITH {TOLD} SELECT log_file_id, session_id, seq, opener_seq, mob AS enemy FROM hits""")
def engine_attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encounter machine: which events belong to which fight."""
    return told(spark, sf_dir).attached.select("log_file_id", F.col("session_no").alias("session_id"), "seq", "opener_seq", "enemy")


@query(f"""WITH {TOLD} SELECT log_file_id, encounter_id, session_id, enemy, CASE WHEN enemy LIKE 'a %' THEN 'Trash: ' || coalesce(zone_name, 'Unknown Zone') ELSE enemy END AS name, zone_name, started_ts, ended_ts, active_stance,
    CASE WHEN (SELECT max(x.ts) FROM t x WHERE x.log_file_id = e.log_file_id AND x.seq > e.last_seq) - ended_ts > {TIMEOUT} THEN 'closed' ELSE 'active' END AS status, 'group' AS scale FROM enc e""")
def engine_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(spark, sf_dir).encounters.select("log_file_id", "encounter_id", F.col("session_no").alias("session_id"), "enemy", "name", "zone_name", "started_ts", "ended_ts", "active_stance", "status", "scale")


@query(f"""WITH {TOLD} SELECT log_file_id, encounter_id, actor, arg_max(attrib_owner, CASE WHEN attrib_owner IS NOT NULL THEN seq END) AS attrib_owner, sum(damage)::BIGINT AS damage_total, count(*) AS hit_count, max(damage)::BIGINT AS max_hit,
    any_value(duration_ms) AS duration_ms FROM deeds GROUP BY ALL""")
def engine_actor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pets' deeds carry the owner that was known when they happened."""
    return told(spark, sf_dir).actor_stats.select("log_file_id", "encounter_id", "actor", "attrib_owner", "damage_total", "hit_count", "max_hit", "duration_ms")


@query(f"WITH {TOLD} SELECT log_file_id, encounter_id, actor, ts // 1000 AS bucket_ts, sum(damage)::BIGINT AS damage, 0::BIGINT AS healing FROM deeds GROUP BY ALL")
def engine_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(spark, sf_dir).buckets


@query(f"""WITH {TOLD}, kills AS (SELECT h.log_file_id, h.seq, h.ts, e.encounter_id FROM hits h JOIN enc e USING (log_file_id, opener_seq) WHERE h.type = 'kill'),
    x AS (SELECT t.log_file_id, t.seq, t.ts, t.type, t.cents, t.level, k.encounter_id, t.ts - k.ts AS d FROM (SELECT * FROM t WHERE type IN ('xp_gain', 'level_up')) t ASOF LEFT JOIN kills k ON t.log_file_id = k.log_file_id AND t.seq > k.seq)
    SELECT log_file_id, seq, CASE WHEN type = 'xp_gain' THEN cents % 5000 ELSE 0 END AS percent_milli, level, CASE WHEN type = 'xp_gain' THEN 'normal' ELSE 'level_up' END AS kind,
    CASE WHEN type = 'xp_gain' AND d BETWEEN 0 AND {WINDOW} THEN encounter_id END AS attributed_encounter_id, CASE WHEN type = 'xp_gain' AND d BETWEEN 0 AND {WINDOW} THEN round(1 - d / {WINDOW}.0, 9) END AS confidence FROM x""")
def engine_xp_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = told(spark, sf_dir).xp_events
    return rows.select("log_file_id", "seq", "percent_milli", "level", "kind", "attributed_encounter_id", F.round("confidence", 9).alias("confidence"))


@query(f"WITH {TOLD} SELECT log_file_id, seq, ts, session_id, cents AS delta_copper, 'loot_coin' AS reason FROM t WHERE type = 'coin_gain'")
def engine_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(spark, sf_dir).currency_ledger.withColumnRenamed("session_no", "session_id")


@query(f"""WITH {TOLD}, m AS (SELECT log_file_id, seq, 'a' AS side, CASE WHEN et = 'click' THEN 'Rover' ELSE hero END AS canonical, CASE WHEN et = 'click' THEN CASE WHEN linked = 1 THEN 'pet' ELSE 'unknown' END ELSE 'player' END AS kind,
        CASE WHEN et = 'click' THEN CASE WHEN linked = 1 THEN 0.95 ELSE 0 END ELSE 1.0 END AS kind_confidence, CASE WHEN et = 'click' AND linked = 1 THEN hero END AS link_owner FROM t WHERE type IN ('melee_hit', 'kill')
    UNION ALL SELECT log_file_id, seq, 'b', mob, CASE WHEN mob = 'Lord Grey' THEN 'unknown' ELSE 'npc' END, CASE WHEN mob = 'Lord Grey' THEN 0 ELSE 0.9 END, NULL FROM t WHERE type IN ('melee_hit', 'kill')
    UNION ALL SELECT log_file_id, seq, 'x', 'Rover', 'pet', 0.95, hero FROM t WHERE type = 'pet_chatter') SELECT * REPLACE (kind_confidence::DOUBLE AS kind_confidence) FROM m""")
def engine_resolver_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who each name was known to be at each mention."""
    return told(spark, sf_dir).states.select("log_file_id", "seq", "side", "canonical", "kind", "kind_confidence", "link_owner")


@query(f"""WITH {TOLD}, p AS (SELECT h.log_file_id, e.encounter_id, h.seq, e.enemy, h.mob, h.et, h.hero, h.linked FROM hits h JOIN enc e USING (log_file_id, opener_seq)),
    s AS (SELECT log_file_id, encounter_id, enemy, seq, 0 AS pos, CASE WHEN et = 'click' THEN 'Rover' ELSE hero END AS name, CASE WHEN et = 'click' AND linked = 1 THEN 'pet_of_ally' ELSE 'dealt_damage' END AS evidence_type,
        CASE WHEN et <> 'click' THEN 1.0 WHEN linked = 1 THEN 0.95 ELSE 0 END AS confidence FROM p UNION ALL SELECT log_file_id, encounter_id, enemy, seq, 1, mob, 'took_damage', CASE WHEN mob = 'Lord Grey' THEN 0 ELSE 0.9 END FROM p)
    SELECT log_file_id, encounter_id, name, CASE WHEN name = enemy THEN 'enemy' ELSE 'ally' END AS role, evidence_type, confidence::DOUBLE AS confidence FROM s QUALIFY row_number() OVER (PARTITION BY log_file_id, encounter_id, name ORDER BY seq, pos) = 1""")
def engine_participants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(spark, sf_dir).participants


SUMMARIES = f"""{TOLD}, heads AS (SELECT log_file_id, session_id, arg_min(ts, seq) AS started_ts, max(ts) AS last_ts, CASE WHEN lead(session_id) OVER (PARTITION BY log_file_id ORDER BY session_id) IS NOT NULL THEN arg_max(ts, seq) END AS ended_ts,
        coalesce(sum(CASE WHEN type = 'xp_gain' THEN cents % 5000 END), 0)::BIGINT AS xp_percent_milli, coalesce(sum(CASE WHEN type = 'coin_gain' THEN cents END), 0)::BIGINT AS coin_copper FROM t GROUP BY log_file_id, session_id),
    spans AS (SELECT *, greatest(0, coalesce(ended_ts, last_ts) - started_ts) AS span_ms FROM heads),
    fights AS (SELECT log_file_id, session_id, sum(ended_ts - started_ts)::BIGINT AS active_ms, count(*) AS encounter_count FROM enc GROUP BY ALL)"""


@query(f"""WITH {SUMMARIES} SELECT log_file_id, session_id, span_ms, coalesce(active_ms, 0) AS active_ms, greatest(0, span_ms - coalesce(active_ms, 0)) AS afk_ms, coalesce(encounter_count, 0) AS encounter_count, xp_percent_milli, coin_copper,
    CASE WHEN span_ms > 0 THEN round(xp_percent_milli / (span_ms / 3600000.0), 6) ELSE 0 END AS xp_per_hour FROM spans LEFT JOIN fights USING (log_file_id, session_id)""")
def engine_session_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read.session_summaries(told(spark, sf_dir))
    return rows.select("log_file_id", "session_id", "span_ms", "active_ms", "afk_ms", "encounter_count", "xp_percent_milli", "coin_copper", F.round("xp_per_hour", 6).alias("xp_per_hour"))


@query(f"""WITH {SUMMARIES}, kills AS (SELECT log_file_id, session_id, count(*) AS kill_count FROM hits WHERE type = 'kill' GROUP BY ALL) SELECT log_file_id, session_id, span_ms, xp_percent_milli AS total_percent_milli, coalesce(kill_count, 0) AS kill_count,
    CASE WHEN span_ms > 0 THEN round(xp_percent_milli / (span_ms / 3600000.0), 6) ELSE 0 END AS xp_per_hour FROM spans LEFT JOIN kills USING (log_file_id, session_id)""")
def engine_xp_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read.xp_rates(told(spark, sf_dir))
    return rows.select("log_file_id", "session_id", "span_ms", "total_percent_milli", "kill_count", F.round("xp_per_hour", 6).alias("xp_per_hour"))


@query(f"""WITH {TOLD}, a AS (SELECT log_file_id, encounter_id, actor, arg_max(attrib_owner, CASE WHEN attrib_owner IS NOT NULL THEN seq END) AS owner, sum(damage)::BIGINT AS damage, count(*) AS n, max(damage)::BIGINT AS top, any_value(duration_ms) AS ms FROM deeds GROUP BY ALL),
    i AS (SELECT log_file_id, encounter_id, coalesce(owner, actor) AS actor, sum(damage) AS damage, sum(n) AS n, max(top) AS top, max(ms) AS ms FROM a GROUP BY ALL)
    SELECT actor, sum(damage)::BIGINT AS damage_total, sum(n)::BIGINT AS hit_count, max(top)::BIGINT AS max_hit, sum(ms)::BIGINT AS duration_ms, CASE WHEN sum(ms) > 0 THEN round(sum(damage) / (sum(ms) / 1000.0), 6) ELSE 0 END AS dps FROM i GROUP BY actor""")
def engine_folded_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All encounters, pets folded into their owners."""
    rows = read.get_actor_stats(told(spark, sf_dir))
    return rows.select("actor", "damage_total", "hit_count", "max_hit", "duration_ms", F.round("dps", 6).alias("dps"))


@query(f"""WITH {TOLD} SELECT log_file_id, 'Rover' AS pet, any_value(hero) AS owner, 'pet_chatter' AS evidence_type, 0.95::DOUBLE AS confidence, count(*) AS evidence_count, min(ts) AS first_ts, max(ts) AS last_ts, true AS active
    FROM t WHERE type = 'pet_chatter' GROUP BY log_file_id""")
def engine_entity_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(spark, sf_dir).entity_links


@query(f"WITH {TOLD} SELECT CASE WHEN EXISTS (SELECT 1 FROM deeds WHERE attrib_owner IS NOT NULL) THEN 0.95 ELSE 1.0 END::DOUBLE AS min_confidence")
def engine_min_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read.min_confidence(told(spark, sf_dir))


# Errors with an odd coin say that the pet is another's, a quarter of them with as much trust as chatter.
@query(f"""WITH {TOLD}, claims AS (SELECT log_file_id, seq, ts, 0.95 AS c, hero AS o FROM t WHERE type = 'pet_chatter'
        UNION ALL SELECT log_file_id, seq, ts, CASE WHEN cents % 4 = 1 THEN 0.95 ELSE 0.7 END, CASE WHEN cents % 3 = 0 THEN 'Ann' ELSE 'Bob' END FROM t WHERE et = 'error' AND cents % 2 = 1),
    best AS (SELECT *, max(c) OVER w AS held_c FROM claims WINDOW w AS (PARTITION BY log_file_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    held AS (SELECT b.*, (SELECT arg_min(x.o, x.seq) FROM claims x WHERE x.log_file_id = b.log_file_id AND x.seq < b.seq AND x.c = b.held_c) AS held_o FROM best b)
    SELECT log_file_id, 'Rover' AS name, seq, ts, CASE WHEN c > held_c THEN held_o ELSE o END AS owner, CASE WHEN least(c, held_c) = 0.95 THEN 'pet_chatter' ELSE 'damage_shield_possessive' END AS evidence_type,
        least(c, held_c)::DOUBLE AS confidence, CASE WHEN c = held_c THEN 'equal_confidence_kept_first' ELSE 'lower_confidence' END AS reason FROM held WHERE o <> held_o""")
def engine_link_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims on a pet that lost against another owner's."""
    p = told(spark, sf_dir)
    e = events_of(spark, sf_dir).filter("event_type = 'error' and cents % 2 = 1")
    owner, kind = F.when(F.col("cents") % 3 == 0, "Ann").otherwise("Bob"), F.when(F.col("cents") % 4 == 1, "pet_chatter").otherwise("damage_shield_possessive")
    p.signals = e.select((F.col("user_id") % 3 + 1).alias("log_file_id"), F.col("event_id").alias("seq"), F.col("ms").alias("ts"), F.lit("Rover").alias("pet"), owner.alias("owner"), kind.alias("evidence_type"))
    return link_conflicts(p.states)


__all__ = ["QUERIES", "ORACLES", "told"]
