"""Lines to typed events: one projection, no shuffle.

The rule of a line is the first in rank order that fits.  A rule's pattern is tried only where the message begins with
the rule's leading text or, if it has none, contains its longest literal text, so most rules cost one comparison.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import copper, message_of, milli, outcome, quantity
from ledgerline.operators.rules import FRAMED, SYSTEM_KINDS, Registry, Rule, base_rules
from ledgerline.schema import BASE, DIALECT, PAYLOAD, VALUE_ORDER

SUBJECT = r"^[A-Za-z][A-Za-z`' -]{0,39}\z"


def ending(message: Column, endings: tuple[str, ...]) -> Column:
    """The first of the endings that the message has, beside something before it."""
    chain = [(F.endswith(message, F.lit(e)) & (F.length(message) > len(e)), F.lit(e)) for e in endings]
    short = min(map(len, endings))
    found = reduce(lambda acc, x: acc.when(*x), chain[1:], F.when(*chain[0]))
    return F.when(F.right(message, F.lit(short)).isin(*{e[-short:] for e in endings}), found)  # few messages end alike


def fits(rule: Rule, message: Column, tail: Column) -> Column:
    if rule.among:
        exact = message.isin(*rule.among)
        framed = [message.rlike(rf"^{p}\z") for p in FRAMED.values()] if rule.rule_id == "system-exact" else []
        return reduce(lambda a, b: a | b, framed, exact)
    if rule.endings:
        return tail.isNotNull() & F.expr("substring(_message, 1, length(_message) - length(_tail))").rlike(SUBJECT)
    # a common beginning fails at the first character; otherwise the longest literal is searched for
    near = F.startswith(message, F.lit(rule.lead)) if rule.lead else F.contains(message, F.lit(rule.anchor)) if rule.anchor.strip() else F.lit(True)
    return near & message.rlike(rule.pattern)


def first_rank(registry: Registry, message: Column, tail: Column) -> Column:
    rules = registry.rules
    return reduce(lambda acc, r: acc.when(fits(r, message, tail), r.rank), rules[1:], F.when(fits(rules[0], message, tail), rules[0].rank))


#: Parts the groups of one line; no decoded line holds this private character.
PART = "\ue000"


def groups(registry: Registry) -> Column:
    """The groups of the winning rule's pattern, by one match: the message is replaced by its groups and split again."""
    having = [r for r in registry.rules if r.fields]
    of = lambda value: F.element_at(F.create_map(*[F.lit(x) for r in having for x in (r.rank, value(r))]), F.col("_rank"))
    parts = F.regexp_replace(F.col("_message"), of(lambda r: r.pattern), of(lambda r: PART.join(f"${k}" for k in range(1, len(r.fields) + 1))))
    return F.when(of(lambda r: r.rule_id).isNotNull(), F.split(parts, PART))


def captured(registry: Registry, name: str) -> Column:
    """A field's text by the rule that won; null where that rule has no such field or the field is absent."""
    having = [r for r in registry.rules if name in r.fields]
    if not having:
        return F.lit(None).cast("string")
    group = F.element_at(F.create_map(*[F.lit(x) for r in having for x in (r.rank, r.fields[name])]), F.col("_rank"))
    return F.nullif(F.element_at("_groups", group), F.lit(""))


def constant(registry: Registry, name: str) -> Column:
    found: dict = {}
    for r in registry.rules:
        if name in r.constants:
            found.setdefault(r.constants[name], []).append(r.rank)
    chain = [(F.col("_rank").isin(*ranks), F.lit(v)) for v, ranks in found.items()]
    return reduce(lambda acc, x: acc.when(*x), chain[1:], F.when(*chain[0])) if chain else F.lit(None)


def recognised(lines: DataFrame, registry: Registry | None = None, message: Column | None = None) -> DataFrame:
    """The input's columns, ``type``, ``rule_id``, ``dialect_id``, ``value`` and all payload columns.

    `lines` has ``raw``, ``line_ts`` (null where the timestamp is malformed, which makes a line unknown) and ``overflow``.
    """
    registry = registry or Registry(base_rules())
    keep = [c for c in lines.columns if c not in PAYLOAD and c not in ("type", "rule_id", "dialect_id", "value")]
    endings = next((r.endings for r in registry.rules if r.endings), None)
    rows = lines.select(*keep).withColumn("_message", message if message is not None else message_of(F.col("raw")))
    rows = rows.withColumn("_tail", ending(F.col("_message"), endings) if endings else F.lit(None).cast("string"))
    known = F.col("line_ts").isNotNull() & ~F.col("overflow")
    rows = rows.withColumn("_rank", F.when(known, first_rank(registry, F.col("_message"), F.col("_tail"))))
    rows = rows.withColumn("_groups", groups(registry))
    names = {n for r in registry.rules for n in r.fields} | {n for r in registry.rules for n in r.constants}
    rows = rows.select("*", *[F.coalesce(captured(registry, n), constant(registry, n).cast("string")).alias(f"_{n}") for n in sorted(names - {"rank", "message", "tail"})], captured(registry, "message").alias("_text"))

    def put(name: str) -> Column:
        return F.col(f"_{name}") if name in names else F.lit(None).cast("string")

    by_rank = {r.rank: r for r in registry.rules}
    kinds = F.create_map(*[F.lit(x) for pair in SYSTEM_KINDS.items() for x in pair])
    framed = reduce(lambda acc, x: acc.when(F.col("_message").rlike(rf"^{x[1]}\z"), x[0]), FRAMED.items(), F.when(F.lit(False), ""))
    of = {rule.rule_id: rule.rank for rule in registry.rules}
    is_rule = lambda rule_id: F.col("_rank") == of.get(rule_id, -1)
    kind_of = F.create_map(*[F.lit(x) for r in by_rank.values() for x in (r.rank, r.type)])
    id_of = F.create_map(*[F.lit(x) for r in by_rank.values() for x in (r.rank, r.rule_id)])
    dialect_of = F.create_map(*[F.lit(x) for r in by_rank.values() for x in (r.rank, r.dialect)])
    kind = F.element_at(kind_of, F.col("_rank"))
    special = {
        "attacker": put("attacker"),
        "outcome": outcome(put("outcome")),
        "annotation": F.when(kind == "melee_miss", put("annotation")),
        "modifiers": F.when(kind.isin("melee_hit", "spell_damage"), F.when(put("annotation").isNull(), F.array().cast("array<string>")).otherwise(F.array(put("annotation")))),
        "owner": F.regexp_replace(put("owner"), r"(?s)'s\z", ""),
        "percent_milli": milli(put("whole"), put("fraction")),
        "total_copper": F.coalesce(copper(put("coins")), put("total_copper").cast("long")),
        "quantity": quantity(put("quantity")),
        "message": F.col("_text"),
        "pet_target": F.when(kind == "pet_chatter", F.nullif(F.regexp_extract(F.col("_text"), r"^Attacking (.+?) Master\.\z", 1), F.lit(""))),
        "subject": F.when(is_rule("spell-emote-subject"), F.expr("substring(_message, 1, length(_message) - length(_tail))")),
        "emote": F.when(is_rule("spell-emote-subject"), F.ltrim("_tail")).when(is_rule("spell-emote-self"), F.col("_message")).otherwise(put("emote")),
        "kind": F.when(is_rule("system-exact"), F.coalesce(F.element_at(kinds, F.col("_message")), framed)).otherwise(put("kind")),
        "category": F.lower(put("category")),
    }
    payload = [special.get(n, put(n)).cast(t).alias(n) if t != "array<string>" else special[n].alias(n) for n, t in PAYLOAD.items()]
    rows = rows.select(*keep, F.coalesce(kind, F.lit("raw_unknown")).alias("type"), F.element_at(id_of, F.col("_rank")).alias("rule_id"), F.coalesce(F.element_at(dialect_of, F.col("_rank")), F.lit(DIALECT)).alias("dialect_id"), *payload)
    return rows.select(*keep, "type", "rule_id", "dialect_id", F.coalesce(*VALUE_ORDER).alias("value"), *PAYLOAD)


def events_of(lines: DataFrame, registry: Registry | None = None) -> DataFrame:
    """The event table of a line table (see `ledgerline.sources.log_files.read_lines`)."""
    return recognised(lines, registry).select(*BASE, *PAYLOAD)
