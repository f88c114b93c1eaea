"""Rollups of encounters: actors, per-second buckets, and folds of actors into their owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.resolve import attribution, side_of

KINDS = {"melee_hit": "melee", "spell_damage": "spell", "dot_tick": "dot", "damage_shield": "ds"}


def damage_kind(kind: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, short in KINDS.items():
        out = out.when(kind == name, short)
    return out


def contributions(events: DataFrame, found: DataFrame, ids: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """Deeds of the allies' side in encounters; the encounter's own enemy never contributes.

    A deed that rolled up is on its owner's side.  Only corrections or signals name other owners than the log's own;
    `kinds` (``log_file_id, canonical, kind``) then tells theirs.
    """
    rows = found.join(events, ["log_file_id", "session_no", "seq"]).join(ids.select("log_file_id", "opener_seq", "encounter_id"), ["log_file_id", "opener_seq"])
    rows = attribution(rows.filter(F.col("type").isin(*KINDS, "melee_miss", "heal")))
    kind = F.when(~F.col("rolled_up"), F.col("a_kind"))
    if kinds is not None:
        rows = rows.join(kinds.select("log_file_id", F.col("canonical").alias("attributed_name"), F.col("kind").alias("told_kind")), ["log_file_id", "attributed_name"], "left")
        kind = F.when(F.col("rolled_up"), F.col("told_kind")).otherwise(F.col("a_kind"))
    ally = F.coalesce(side_of(F.col("attributed_name"), kind, F.col("owner_name")), F.lit("unknown")) != "enemy"
    rows = rows.filter(ally & (F.col("source_name") != F.col("enemy")))
    kind = damage_kind(F.col("type"))
    return rows.select(
        "log_file_id", "encounter_id", "seq", "ts", F.col("source_name").alias("actor"), F.when(F.col("rolled_up"), F.col("attributed_name")).alias("attrib_owner"),
        kind.alias("damage_kind"), F.when(kind.isNotNull(), F.col("amount")).alias("damage"), (F.col("type") == "melee_miss").alias("miss"),
        F.when(F.col("type") == "heal", F.col("amount")).alias("heal"),
        F.when(F.col("type") == "heal", F.greatest(F.lit(0), F.coalesce(F.col("uncapped_amount") - F.col("amount"), F.lit(0)))).alias("overheal"),
    )


def split_sums(by: Column, values: list[str], amount: Column, suffix: str = "") -> list[Column]:
    """One conditional sum for each value of a column."""
    return [F.sum(F.when(by == v, amount).otherwise(0)).alias(f"{v}{suffix}") for v in values]


def actor_stats(deeds: DataFrame, ids: DataFrame) -> DataFrame:
    """Per encounter and acting name; the owner is that of the last contribution, times and stance are the encounter's."""
    hit = F.col("damage_kind").isNotNull()
    per = deeds.groupBy("log_file_id", "encounter_id", "actor").agg(
        F.max_by("attrib_owner", "seq").alias("attrib_owner"), F.coalesce(F.sum("damage"), F.lit(0)).alias("damage_total"),
        *split_sums(F.col("damage_kind"), list(KINDS.values()), F.col("damage"), "_damage"),
        F.count(F.when(hit, 1)).alias("hit_count"), F.count(F.when(F.col("miss"), 1)).alias("miss_count"), F.coalesce(F.max("damage"), F.lit(0)).alias("max_hit"),
        F.coalesce(F.sum("heal"), F.lit(0)).alias("heal_total"), F.coalesce(F.sum("overheal"), F.lit(0)).alias("overheal_total"),
    )
    times = ids.select("log_file_id", "encounter_id", (F.col("ended_ts") - F.col("started_ts")).alias("duration_ms"), "active_stance", "active_invocation")
    return per.join(times, ["log_file_id", "encounter_id"])


def buckets(deeds: DataFrame) -> DataFrame:
    """Damage and healing per encounter, acting name and second; misses and nothing at all leave no row."""
    per = deeds.filter(~F.col("miss")).groupBy("log_file_id", "encounter_id", "actor", F.floor(F.col("ts") / 1000).alias("bucket_ts"))
    return per.agg(F.coalesce(F.sum("damage"), F.lit(0)).alias("damage"), F.coalesce(F.sum("heal"), F.lit(0)).alias("healing")).filter("damage > 0 or healing > 0")


def time_buckets(rows: DataFrame, part: list[str], ts: str, width: int, *aggregates: Column, name: str = "bucket") -> DataFrame:
    """Sparse series: rows per part and `width` of time."""
    return rows.groupBy(*part, F.floor(F.col(ts) / width).alias(name)).agg(*aggregates)


def folded(rows: DataFrame, scope: list[str], actor: str, owner: str, sums: list[str], maxima: list[str] = (), minima: list[str] = (), outer: list[str] | None = None) -> DataFrame:
    """Two-level fold: per scope and owner-or-self, then per owner-or-self (and `outer`) over all scopes.

    Sums add at both levels.  A maximum within a scope adds over scopes if it is named in `sums` too (a duration).
    """
    key = F.coalesce(F.col(owner), F.col(actor)).alias("folded")
    added = [c for c in maxima if c in sums]
    inner = rows.groupBy(*scope, *(outer or []), key).agg(*[F.sum(c).alias(c) for c in sums if c not in maxima], *[F.max(c).alias(c) for c in maxima], *[F.min(c).alias(c) for c in minima])
    return inner.groupBy(*(outer or []), "folded").agg(*[F.sum(c).alias(c) for c in sums if c not in maxima], *[(F.sum if c in added else F.max)(c).alias(c) for c in maxima], *[F.min(c).alias(c) for c in minima])


def top_per(rows: DataFrame, part: list[str], by: Column, tie: str) -> DataFrame:
    """The best row of each part, ties to the smaller `tie`; one aggregate, no sort of the part."""
    rest = [c for c in rows.columns if c not in part]
    best = rows.groupBy(*part).agg(F.max_by(F.struct(*rest), F.struct(by.alias("v"), (-F.col(tie)).alias("t"))).alias("b")) if dict(rows.dtypes)[tie] in ("int", "bigint") else None
    if best is None:
        from pyspark.sql import Window

        return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*part).orderBy(by.desc(), F.col(tie)))).filter("_n = 1").drop("_n")
    return best.select(*part, "b.*")
