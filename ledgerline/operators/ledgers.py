"""Domain ledgers: experience, abilities, loot, currency, faction, skill.  One projection of the events each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.asof import last_value
from ledgerline.schema import Options

KEY = ["log_file_id", "seq", "ts", "session_no"]


def attributed(rows: DataFrame, part: list[str], order: str, ts: str, is_event, cause, window: int, name: str = "cause") -> DataFrame:
    """Rows that `is_event` marks, with the latest earlier `cause` (null elsewhere) no more than `window` back in time.

    ``confidence`` falls from 1 at once to 0 at the window's end.  Causes are found in order, not in time: one running
    window over the part, which is exact as long as time does not run backwards between cause and event.
    """
    pair = F.when(cause.isNotNull(), F.struct(cause.alias("c"), F.col(ts).alias("t")))
    found = rows.withColumn("_c", last_value(pair, part, [order], include_current=False)).filter(is_event)
    delta = F.col(ts) - F.col("_c.t")
    near = delta.between(0, window)
    return found.withColumn(name, F.when(near, F.col("_c.c"))).withColumn("confidence", F.when(near, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - delta / window)))).drop("_c")


def xp_events(events: DataFrame, found: DataFrame, ids: DataFrame, options: Options | None = None) -> DataFrame:
    """Experience with the level then held, and the encounter of the latest kill within the window."""
    options = options or Options()
    placed = found.join(ids.select("log_file_id", "opener_seq", "encounter_id"), ["log_file_id", "opener_seq"]).select("log_file_id", "seq", "encounter_id")
    rows = events.join(placed, ["log_file_id", "seq"], "left")
    rows = rows.withColumn("live_level", last_value(F.when(F.col("type") == "level_up", F.col("level")), ["log_file_id"], ["seq"]))
    kill = F.when(F.col("type") == "kill", F.col("encounter_id"))
    linked = attributed(rows, ["log_file_id"], "seq", "ts", F.col("type").isin("xp_gain", "level_up") & F.col("session_no").isNotNull(), kill, options.kill_window_ms, "attributed_encounter_id")
    gain = F.col("type") == "xp_gain"
    return linked.select(
        *KEY, F.when(gain, F.col("percent_milli")).otherwise(F.lit(0)).cast("long").alias("percent_milli"), F.col("live_level").alias("level"), F.when(gain, "normal").otherwise("level_up").alias("kind"),
        F.when(gain, F.col("attributed_encounter_id")).alias("attributed_encounter_id"), F.when(gain, F.col("confidence")).alias("confidence"),
    )


def aa_events(events: DataFrame) -> DataFrame:
    return events.filter("type = 'ability_purchase'").select(*KEY, "ability", "cost_points")


def loot_events(events: DataFrame) -> DataFrame:
    sold = F.col("type") == "loot_auto_sell"
    rows = events.filter(F.col("type").isin("loot_item", "loot_auto_sell"))
    return rows.select(*KEY, F.col("item").alias("item_name"), "quantity", F.col("corpse").alias("corpse_name"), F.when(sold, "auto_sold").otherwise("kept").alias("mode"), F.when(sold, F.col("total_copper")).alias("sale_total_copper"))


def currency_ledger(events: DataFrame) -> DataFrame:
    """Coins from sales and from all other gains, merchants' included."""
    rows = events.filter(F.col("type").isin("loot_auto_sell", "coin_gain"))
    return rows.select(*KEY, F.col("total_copper").alias("delta_copper"), F.when(F.col("type") == "coin_gain", "loot_coin").otherwise("auto_sell").alias("reason"))


def faction_events(events: DataFrame) -> DataFrame:
    return events.filter("type = 'faction_change'").select(*KEY, F.col("faction").alias("faction_name"), "delta")


def skill_events(events: DataFrame) -> DataFrame:
    return events.filter("type = 'skill_up'").select(*KEY, "skill", "skill_value")
