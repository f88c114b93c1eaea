"""Encounters: which events belong to a fight with one enemy.

Whether an event attaches depends on open fights, whose timeout depends on how many allies each has, so the assignment is
a sequential machine.  It runs per session over a narrow projection and returns event numbers and their encounter's
opener; everything else about encounters follows by grouping.  A session is one group: its combat rows must fit a task.

Choices where the format's specification is silent: of two active fights that a line touches, its target's wins; a heal
joins the fight of latest end, then of earliest opening, whose ally it touches; no fight spans two sessions; a raid never
becomes a group again; an ally's evidence is the first observed; without a known zone trash is named for Unknown Zone.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import ARTICLE
from ledgerline.operators.asof import last_value
from ledgerline.schema import TRIGGERS, Options

ASSIGNED = "log_file_id long, session_no long, seq long, opener_seq long, enemy string"


def enemy_of() -> Column:
    """The one enemy of a line by its sides; null where both or neither can be told to be it."""
    a, b = F.col("a_side"), F.col("b_side")
    a = F.coalesce(a, F.lit("unknown"))
    return (
        F.when((a == "owner") & (b != "owner"), F.col("b_canonical"))
        .when((b == "owner") & (a != "owner"), F.col("a_canonical"))
        .when((a == "enemy") & (b == "unknown"), F.col("a_canonical"))
        .when((b == "enemy") & (a == "unknown"), F.col("b_canonical"))
    )


class Fight:
    __slots__ = ("enemy", "opener", "ended", "allies", "raid")

    def __init__(self, enemy: str, opener: int, ended: int = 0, allies=(), raid: bool = False):
        self.enemy, self.opener, self.ended, self.allies, self.raid = enemy, opener, ended, set(allies), raid


def assign(rows, options: Options, active: dict[str, Fight] | None = None) -> list[tuple[int, int, str]]:
    """(seq, opener's seq, enemy) of each attached event of one session; rows are (seq, ts, what, a, b, enemy, sweep).

    ``sweep`` is the latest time that was reached since the row before, this one included: it ends fights.  `active` holds the open fights by enemy, and is changed; a stream hands it on from batch to batch.
    """
    active = {} if active is None else active
    out = []
    for seq, ts, what, a, b, enemy, sweep in rows:
        for name in [n for n, f in active.items() if sweep - f.ended > (options.raid_timeout_ms if f.raid else options.group_timeout_ms)]:
            del active[name]
        fight = None
        if what == 1:
            fight = active.get(b) or active.get(a)
            if fight is None and enemy is not None:
                fight = active[enemy] = Fight(enemy, seq)
        elif what == 2:
            touched = [f for f in active.values() if a in f.allies or b in f.allies]
            fight = max(touched, key=lambda f: (f.ended, -f.opener), default=None)
        if fight is not None:
            fight.ended = ts
            fight.allies.update(n for n in (a, b) if n is not None and n != fight.enemy)
            fight.raid = fight.raid or len(fight.allies) > options.raid_allies
            out.append((seq, fight.opener, fight.enemy))
    return out


def combat_rows(events: DataFrame, options: Options) -> DataFrame:
    """What the machine needs of each event: number, time, what it is (1 trigger, 2 heal, 0 other), sides and enemy."""
    fold = (lambda c: F.when(c.rlike(ARTICLE), F.lower(c)).otherwise(c)) if options.fold_article_case else (lambda c: c)
    what = F.when(F.col("type").isin(*TRIGGERS), 1).when(F.col("type") == "heal", 2).otherwise(0)
    return events.select("log_file_id", "session_no", "seq", "ts", what.alias("what"), fold(F.col("a_canonical")).alias("a"), fold(F.col("b_canonical")).alias("b"), fold(enemy_of()).alias("enemy"))


def attached(events: DataFrame, options: Options | None = None) -> DataFrame:
    """``log_file_id, session_no, seq, opener_seq, enemy`` of events that belong to an encounter.

    `events` has sides (`ledgerline.operators.resolve.with_sides`) and ``session_no``.  Any later event may end a fight,
    but only combat reaches the machine: each of its rows brings the latest time since the one before (`swept`).
    """
    options = options or Options()

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("seq").astype({"a": object, "b": object, "enemy": object})
        frame = frame.where(frame.notna(), None)
        found = assign(zip(*(frame[c].tolist() for c in ("seq", "ts", "what", "a", "b", "enemy", "sweep")), strict=True), options)
        out = pd.DataFrame(found, columns=["seq", "opener_seq", "enemy"])
        out.insert(0, "session_no", key[1])
        out.insert(0, "log_file_id", key[0])
        return out

    return swept(combat_rows(events, options)).groupBy("log_file_id", "session_no").applyInPandas(run, ASSIGNED)


def swept(rows: DataFrame) -> DataFrame:
    """Combat rows alone, each with ``sweep``: the latest time of the rows after the last combat row, itself included."""
    w = Window.partitionBy("log_file_id", "session_no").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    stretch = F.coalesce(F.sum((F.col("what") > 0).cast("long")).over(w), F.lit(0))
    fields = ("seq", "ts", "what", "a", "b", "enemy")
    # a stretch holds one combat row at most, its last
    fight = F.max(F.when(F.col("what") > 0, F.struct(*fields))).alias("r")
    per = rows.withColumn("stretch", stretch).groupBy("log_file_id", "session_no", "stretch").agg(fight, F.max("ts").alias("sweep"))
    return per.filter("r is not null").select("log_file_id", "session_no", "r.*", "sweep")


def islands(events: DataFrame, part: list[str], order: str, ts: str, timeout: int, name: str = "island") -> DataFrame:
    """The relational fast path for one enemy at a time without escalation: gaps longer than the timeout part fights."""
    w = Window.partitionBy(*part).orderBy(order)
    new = F.coalesce(F.col(ts) - F.lag(ts).over(w) > timeout, F.lit(True))
    return events.withColumn("_new", new.cast("int")).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def encounters(events: DataFrame, found: DataFrame, options: Options | None = None) -> DataFrame:
    """One row per encounter: id (by opening within the log), session, zone, name, enemy, times, status, scale."""
    options = options or Options()
    # backwards, since a frame that ends with the partition would be read anew for every row
    later = Window.partitionBy("log_file_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    zone = last_value(F.when(F.col("type") == "zone_enter", F.col("zone")), ["log_file_id"], ["seq"])
    stance = last_value(F.when(F.col("type") == "stance_change", F.col("stance")), ["log_file_id"], ["seq"])
    invocation = last_value(F.when(F.col("type") == "invocation_change", F.col("invocation")), ["log_file_id"], ["seq"])
    context = events.select("log_file_id", "seq", "ts", "a_canonical", "b_canonical", zone.alias("zone_name"), stance.alias("active_stance"), invocation.alias("active_invocation"), F.max("ts").over(later).alias("later_ts"))
    rows = found.join(context, ["log_file_id", "seq"])
    allies = F.array_distinct(F.flatten(F.collect_set(F.filter(F.array("a_canonical", "b_canonical"), lambda n: n.isNotNull() & (n != F.col("enemy"))))))
    opener = F.col("seq") == F.col("opener_seq")
    per = rows.groupBy("log_file_id", "session_no", "opener_seq", "enemy").agg(
        F.min_by("ts", "seq").alias("started_ts"), F.max_by("ts", "seq").alias("ended_ts"), F.max_by("later_ts", "seq").alias("later_ts"),
        *[F.max(F.when(opener, F.col(c))).alias(c) for c in ("zone_name", "active_stance", "active_invocation")], F.size(allies).alias("allies"),
    )
    raid = F.col("allies") > options.raid_allies
    timeout = F.when(raid, options.raid_timeout_ms).otherwise(options.group_timeout_ms)
    name = F.when(F.col("enemy").rlike(ARTICLE), F.concat(F.lit("Trash: "), F.coalesce("zone_name", F.lit("Unknown Zone")))).otherwise(F.col("enemy"))
    return per.select(
        "log_file_id",
        F.row_number().over(Window.partitionBy("log_file_id").orderBy("opener_seq")).cast("long").alias("encounter_id"),
        "session_no", "opener_seq", "zone_name", name.alias("name"), "enemy", "started_ts", "ended_ts",
        F.when(F.col("later_ts") - F.col("ended_ts") > timeout, "closed").otherwise("active").alias("status"),
        F.when(raid, "raid").otherwise("group").alias("scale"),
        F.lit(None).cast("string").alias("difficulty_tier"),
        "active_stance", "active_invocation",
    )


def finalized(rows: DataFrame, as_of_ms: int | None = None, options: Options | None = None) -> DataFrame:
    """Encounters with those closed that have passed their timeout at `as_of_ms`, or all of them if it is not given."""
    options = options or Options()
    timeout = F.when(F.col("scale") == "raid", options.raid_timeout_ms).otherwise(options.group_timeout_ms)
    due = F.lit(True) if as_of_ms is None else F.lit(as_of_ms) - F.col("ended_ts") > timeout
    return rows.withColumn("status", F.when((F.col("status") == "active") & due, "closed").otherwise(F.col("status")))


def participants(events: DataFrame, found: DataFrame, ids: DataFrame) -> DataFrame:
    """``log_file_id, encounter_id, name, role, evidence_type, confidence``: each name of a fight once, by its first evidence."""
    rows = found.join(events.select("log_file_id", "seq", "type", "a_canonical", "a_kind", "a_kind_confidence", "a_link_owner", "b_canonical", "b_kind_confidence"), ["log_file_id", "seq"])
    rows = rows.join(ids.select("log_file_id", "opener_seq", "encounter_id"), ["log_file_id", "opener_seq"])
    heal = F.col("type") == "heal"
    pet = (F.col("a_kind") == "pet") & F.col("a_link_owner").isNotNull()
    sides = F.array(
        F.struct(F.col("a_canonical").alias("name"), F.when(heal, "healed_ally").when(pet, "pet_of_ally").otherwise("dealt_damage").alias("evidence"), F.col("a_kind_confidence").alias("confidence"), F.lit(0).alias("pos")),
        F.struct(F.col("b_canonical").alias("name"), F.when(heal, "was_healed").otherwise("took_damage").alias("evidence"), F.col("b_kind_confidence").alias("confidence"), F.lit(1).alias("pos")),
    )
    flat = rows.select("log_file_id", "encounter_id", "seq", "enemy", F.explode(sides).alias("s")).filter("s.name is not null")
    first = flat.groupBy("log_file_id", "encounter_id", "enemy", F.col("s.name").alias("name")).agg(F.min_by(F.struct("s.evidence", "s.confidence"), F.struct("seq", "s.pos")).alias("e"))
    return first.select("log_file_id", "encounter_id", "name", F.when(F.col("name") == F.col("enemy"), "enemy").otherwise("ally").alias("role"), F.col("e.evidence").alias("evidence_type"), F.col("e.confidence").alias("confidence"))
