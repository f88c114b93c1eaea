"""Who is who: names, kinds and pet owners, as they were known at each event.

In a log all evidence about owners points to the log's own character, so the state of a name at an event is the best
evidence up to it: a running maximum over the mentions of that name, and no row-by-row state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.text import ARTICLE, PET_NAME
from ledgerline.schema import ARTICLE_TRUST, ATTRIBUTION_THRESHOLD, OWNER_TRUST, TRUST

UNKNOWN = "unknown"


def owner_of(character: Column) -> Column:
    """The canonical name of a log's owner."""
    return F.coalesce(character, F.lit("you"))


def canonical(name: Column, owner: Column, character: Column) -> Column:
    """Trimmed; the owner's own words for themselves, in any case, are the owner."""
    low = F.lower(F.trim(name))
    return F.when(low.isin("you", "your") | (low == F.lower(character)), owner).otherwise(F.trim(name))


#: Per type: fields that name someone, the acting side (a) first, then the other (b); the rest are only registered (x).
MENTIONS = {
    "melee_hit": (("attacker", "a"), ("target", "b")),
    "melee_miss": (("attacker", "a"), ("target", "b")),
    "spell_damage": (("attacker", "a"), ("target", "b")),
    "dot_tick": (("attacker", "a"), ("target", "b")),
    "damage_shield": (("target", "b"), ("owner", "a")),
    "heal": (("healer", "a"), ("target", "b")),
    "kill": (("killer", "a"), ("target", "b")),
    "death": (("entity", "x"), ("killer", "x")),
    "pet_chatter": (("pet", "x"),),
}


def mentions(events: DataFrame, files: DataFrame) -> DataFrame:
    """``log_file_id, seq, ts, pos, side, type, name, canonical, owner`` and, for damage shields, whether the target is the owner."""
    listed = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(pos).cast("int").alias("pos"), F.lit(side).alias("side"), F.col(column).alias("name")) for kind, fields in MENTIONS.items() for pos, (column, side) in enumerate(fields)])
    rows = events.filter(F.col("type").isin(*MENTIONS)).join(F.broadcast(files.select("log_file_id", "character")), "log_file_id", "left")
    rows = rows.withColumn("owner_name", owner_of(F.col("character"))).withColumn("burns", canonical(F.col("target"), F.col("owner_name"), F.col("character")) == F.col("owner_name"))
    rows = rows.select("log_file_id", "seq", "ts", "type", "character", "owner_name", "burns", F.explode(F.filter(listed, lambda x: (x["kind"] == F.col("type")) & x["name"].isNotNull())).alias("m"))
    rows = rows.select("log_file_id", "seq", "ts", "type", "owner_name", "burns", F.col("m.pos").alias("pos"), F.col("m.side").alias("side"), F.col("m.name").alias("name"), canonical(F.col("m.name"), F.col("owner_name"), F.col("character")).alias("canonical"))
    return rows


def signalled(signals: DataFrame, files: DataFrame) -> DataFrame:
    """Mentions from outside the log: ``log_file_id, seq, ts, pet, owner, evidence_type`` says that a pet has an owner.

    Evidence by name alone links nobody and is left out.  The owner is named too.
    """
    rows = signals.filter(F.col("evidence_type").isin(*[k for k in TRUST if k != "name_pattern"])).join(F.broadcast(files.select("log_file_id", "character")), "log_file_id", "left")
    rows = rows.withColumn("owner_name", owner_of(F.col("character"))).withColumn("told_owner", canonical(F.col("owner"), F.col("owner_name"), F.col("character")))
    trust = F.element_at(F.create_map(*[F.lit(x) for pair in TRUST.items() for x in pair]), F.col("evidence_type"))
    both = F.array(F.struct(F.lit(0).alias("pos"), F.col("owner").alias("name"), F.lit(None).cast("string").alias("told"), F.lit(None).cast("double").alias("trust")), F.struct(F.lit(1).alias("pos"), F.col("pet").alias("name"), F.col("told_owner").alias("told"), trust.alias("trust")))
    rows = rows.select("log_file_id", "seq", "ts", F.lit("owner_signal").alias("type"), "character", "owner_name", F.lit(False).alias("burns"), F.explode(both).alias("m"))
    return rows.select("log_file_id", "seq", "ts", "type", "owner_name", "burns", "m.pos", F.lit("x").alias("side"), "m.name", canonical(F.col("m.name"), F.col("owner_name"), F.col("character")).alias("canonical"), "m.told", "m.trust")


def overridden(rows: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """User corrections of a name: ``user_kind`` and ``user_owner``; the latest of each field counts.

    `overrides` has ``log_file_id, override_id, name, field`` (``kind`` or ``owner``) and ``new_value``.
    """
    if overrides is None:
        return rows.withColumn("user_kind", F.lit(None).cast("string")).withColumn("user_owner", F.lit(None).cast("string"))
    latest = lambda f: F.max_by(F.when(F.col("field") == f, F.col("new_value")), F.when(F.col("field") == f, F.col("override_id")))
    named = overrides.filter(F.col("field").isin("kind", "owner")).groupBy("log_file_id", F.col("name").alias("canonical")).agg(latest("kind").alias("k"), latest("owner").alias("user_owner"), F.max_by("field", "override_id").alias("last_field"))
    kind = F.when(F.col("last_field") == "owner", F.lit("pet")).otherwise(F.coalesce("k", F.when(F.col("user_owner").isNotNull(), F.lit("pet"))))
    return rows.join(F.broadcast(named), ["log_file_id", "canonical"], "left").withColumn("user_kind", kind).drop("k", "last_field")


def resolved(events: DataFrame, files: DataFrame, overrides: DataFrame | None = None, signals: DataFrame | None = None) -> DataFrame:
    """Each mention with what was known of its name then: ``kind, kind_confidence, link_owner, link_confidence, user``.

    A link counts only while the name is a pet.  The event itself is part of what was known.  `signals` adds evidence
    from outside the log (see `signalled`), under the number of the event from which it holds.
    """
    rows = mentions(events, files).withColumn("told", F.lit(None).cast("string")).withColumn("trust", F.lit(None).cast("double"))
    rows = overridden(rows if signals is None else rows.unionByName(signalled(signals, files)), overrides)
    is_owner = F.col("canonical") == F.col("owner_name")
    article, pet_like = F.col("name").rlike(ARTICLE), F.trim("name").rlike(PET_NAME)
    shield = (F.col("type") == "damage_shield") & (F.col("side") == "a") & ~is_owner
    chatter = F.col("type") == "pet_chatter"
    candidate = shield & ~F.col("burns") & ~article & (pet_like | F.coalesce(F.col("user_kind") == "pet", F.lit(False)))

    def rank(kind: str, trust: float) -> Column:
        """Trust first, then the earlier event: of equals the first stays."""
        return F.struct(F.lit(trust).alias("c"), (-F.col("seq")).alias("s"), F.lit(kind).alias("k"))

    sight = F.when(is_owner, rank("player", OWNER_TRUST)).when(article, rank("npc", ARTICLE_TRUST)).when(pet_like, rank("pet", TRUST["name_pattern"])).otherwise(rank(UNKNOWN, 0.0))
    outside = F.col("told").isNotNull()
    told = F.when(outside, F.struct(F.col("trust").alias("c"), (-F.col("seq")).alias("s"), F.lit("pet").alias("k"))).when(chatter, rank("pet", TRUST["pet_chatter"])).when(shield & (F.col("burns") | article), rank("npc", ARTICLE_TRUST)).when(candidate, rank("pet", TRUST["damage_shield_possessive"]))
    best = F.greatest(sight, F.coalesce(told, sight))
    link = F.when(outside, F.col("trust")).when(chatter, TRUST["pet_chatter"]).when(candidate, TRUST["damage_shield_possessive"])
    # of equals the first stays, but a later assertion of the user corrects an earlier one
    turn = F.when(link == TRUST["user_assertion"], F.col("seq")).otherwise(-F.col("seq"))
    linked = F.when(link.isNotNull(), F.struct(link.alias("c"), turn.alias("s"), F.coalesce("told", "owner_name").alias("o")))
    w = Window.partitionBy("log_file_id", "canonical").orderBy("seq").rangeBetween(Window.unboundedPreceding, 0)
    state = rows.withColumn("_kind", F.max(best).over(w)).withColumn("_link", F.max(linked).over(w)).withColumn("evidence_count", F.count(link).over(w))
    kind = F.coalesce("user_kind", F.col("_kind.k"))
    is_pet = kind == "pet"
    return state.select(
        "log_file_id", "seq", "ts", "type", "pos", "side", "name", "canonical", "owner_name",
        kind.alias("kind"),
        F.when(F.col("user_kind").isNotNull(), 1.0).otherwise(F.col("_kind.c")).alias("kind_confidence"),
        F.when(is_pet, F.coalesce("user_owner", F.col("_link.o"))).alias("link_owner"),
        F.when(is_pet, F.when(F.col("user_owner").isNotNull(), 1.0).otherwise(F.col("_link.c"))).alias("link_confidence"),
        F.col("user_kind").isNotNull().alias("user"),
        F.col("burns"),
        "evidence_count",
        link.alias("link_evidence"),
        linked.alias("link_rank"),
        "user_kind", "user_owner",
    )


def side_of(name: Column, kind: Column, owner: Column) -> Column:
    """owner, enemy or unknown."""
    return (
        F.when(name == owner, "owner").when(kind == "npc", "enemy").when(kind.isin("player", "pet", "merc"), "owner").when(name.rlike(ARTICLE), "enemy").otherwise(F.when(name.isNotNull(), UNKNOWN))
    )


def with_sides(events: DataFrame, states: DataFrame) -> DataFrame:
    """Events with the state of both sides: columns ``a_*`` of the acting side and ``b_*`` of the other."""
    fields = ("canonical", "kind", "kind_confidence", "link_owner", "link_confidence")
    pick = [F.max(F.when(F.col("side") == s, F.struct("pos", *fields))).alias(s) for s in ("a", "b")]
    per_event = states.groupBy("log_file_id", "seq").agg(*pick, F.max("owner_name").alias("owner_name"), F.max("burns").alias("burns"))
    wide = per_event.select("log_file_id", "seq", "owner_name", "burns", *[F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in ("a", "b") for f in fields])
    wide = wide.withColumn("a_side", side_of(F.col("a_canonical"), F.col("a_kind"), F.col("owner_name"))).withColumn("b_side", side_of(F.col("b_canonical"), F.col("b_kind"), F.col("owner_name")))
    return events.join(wide, ["log_file_id", "seq"], "left")


def attribution(rows: DataFrame) -> DataFrame:
    """``source_name, attributed_name, rolled_up``: a pet's deeds are its owner's where a trusted link says so.

    A damage shield that burns the owner is never rolled up; a deed without a source belongs to the name ``unknown``.
    """
    rolls = (F.col("a_kind") == "pet") & (F.col("link_ok")) & ~((F.col("type") == "damage_shield") & F.coalesce("burns", F.lit(False))) & (F.col("a_link_owner") != F.col("a_canonical"))
    rows = rows.withColumn("link_ok", F.coalesce(F.col("a_link_confidence") >= ATTRIBUTION_THRESHOLD, F.lit(False)))
    rows = rows.withColumn("rolled_up", F.coalesce(rolls, F.lit(False)))
    return rows.withColumn("source_name", F.coalesce("a_canonical", F.lit(UNKNOWN))).withColumn("attributed_name", F.when(F.col("rolled_up"), F.col("a_link_owner")).otherwise(F.col("source_name"))).drop("link_ok")


def resolver_heads(states: DataFrame) -> DataFrame:
    """The state of each name at the end of its log: kind, best link, first and last seen in event order."""
    last = [F.max_by(c, F.struct("seq", "pos")).alias(c) for c in ("kind", "kind_confidence", "link_owner", "link_confidence", "user", "owner_name")]
    seen = [F.min_by("ts", F.struct("seq", "pos")).alias("first_seen_ts"), F.max_by("ts", F.struct("seq", "pos")).alias("last_seen_ts")]
    links = [F.count("link_evidence").alias("evidence_count"), F.min(F.when(F.col("link_evidence").isNotNull(), F.col("ts"))).alias("link_first_ts"), F.max(F.when(F.col("link_evidence").isNotNull(), F.col("ts"))).alias("link_last_ts"), F.max("link_evidence").alias("best_link_evidence")]
    return states.groupBy("log_file_id", "canonical").agg(*last, *seen, *links)


def link_conflicts(states: DataFrame) -> DataFrame:
    """``log_file_id, name, seq, ts, owner, evidence_type, confidence, reason``: claims of an owner that lost to another's.

    Each evidence for an owner other than the one believed before sets one of both aside: the weaker, or of equals the
    later, except that the latest assertion of the user stands.  Names that the user calls no pet have no claims.
    """
    rows = states.filter(F.col("link_rank").isNotNull() & F.coalesce(F.col("user_kind") == "pet", F.lit(True)))
    w = Window.partitionBy("log_file_id", "canonical").orderBy("seq", "pos").rowsBetween(Window.unboundedPreceding, -1)
    # a correction by the user holds for the whole log and nothing outranks it
    sure = F.struct(F.lit(2.0).alias("c"), F.lit(0).cast("long").alias("s"), F.col("user_owner").alias("o"))
    rows = rows.withColumn("held", F.max("link_rank").over(w)).withColumn("held", F.when(F.col("user_owner").isNotNull(), sure).otherwise(F.col("held")))
    rows = rows.filter(F.col("held.o") != F.col("link_rank.o"))
    loser = F.least("held", "link_rank")
    types = F.create_map(*[F.lit(x) for kind, trust in TRUST.items() for x in (trust, kind)])
    return rows.select(
        "log_file_id", F.col("canonical").alias("name"), "seq", "ts", loser["o"].alias("owner"), F.element_at(types, loser["c"]).alias("evidence_type"), loser["c"].alias("confidence"),
        F.when(F.least(loser["c"], F.lit(1.0)) < F.least(F.greatest("held.c", "link_rank.c"), F.lit(1.0)), "lower_confidence").otherwise("equal_confidence_kept_first").alias("reason"),
    )
