"""Event columns, enumerations and options."""

from __future__ import annotations

from dataclasses import dataclass

#: Payload columns of the wide event row, and their types.  Absent fields are null; ``modifiers`` is never null where it applies.
PAYLOAD = {
    "attacker": "string", "target": "string", "verb": "string", "amount": "long", "modifiers": "array<string>", "outcome": "string",
    "annotation": "string", "spell": "string", "school": "string", "owner": "string", "element": "string", "healer": "string",
    "uncapped_amount": "long", "killer": "string", "entity": "string", "percent_milli": "long", "level": "int", "ability": "string",
    "cost_points": "long", "skill": "string", "skill_value": "long", "item": "string", "corpse": "string", "quantity": "long",
    "total_copper": "long", "source": "string", "merchant": "string", "zone": "string", "stance": "string", "invocation": "string",
    "caster": "string", "reason": "string", "faction": "string", "delta": "long", "pet": "string", "message": "string",
    "pet_target": "string", "speaker": "string", "channel": "string", "channel_number": "long", "recipient": "string", "file": "string",
    "state": "string", "subject": "string", "emote": "string", "kind": "string", "detail": "string", "category": "string",
}

#: Columns of every event.
BASE = {"log_file_id": "long", "seq": "long", "byte_offset": "long", "line_no": "long", "raw": "string", "ts": "long", "type": "string", "dialect_id": "string", "rule_id": "string", "value": "long"}

EVENT_SCHEMA = ", ".join(f"{n} {t}" for n, t in (BASE | PAYLOAD).items())

#: The first of these that a row has is its ``value``.
VALUE_ORDER = ("amount", "percent_milli", "delta", "cost_points", "total_copper", "skill_value")

#: The 34 event types in their order.
EVENT_TYPES = tuple(
    "melee_hit melee_miss spell_damage dot_tick damage_shield environmental_damage self_damage heal rune_absorb kill death xp_gain level_up "
    "ability_purchase skill_up loot_item loot_auto_sell coin_gain zone_enter stance_change_begin stance_change invocation_change_begin "
    "invocation_change cast_begin cast_resume cast_interrupt spell_resist faction_change pet_chatter chat_message log_toggle spell_emote "
    "system_message raw_unknown".split()
)

#: Types that open or continue an encounter.
TRIGGERS = ("melee_hit", "melee_miss", "spell_damage", "dot_tick", "damage_shield", "kill")

#: How far each kind of evidence is trusted.
TRUST = {"pet_chatter": 0.95, "damage_shield_possessive": 0.7, "name_pattern": 0.4, "user_assertion": 1.0}
OWNER_TRUST, ARTICLE_TRUST = 1.0, 0.9
ATTRIBUTION_THRESHOLD = 0.5

DIALECT = "beta-2026-07"


@dataclass(frozen=True)
class Options:
    """Thresholds, in milliseconds where they are times."""

    session_gap_ms: int = 30 * 60_000
    group_timeout_ms: int = 15_000
    raid_timeout_ms: int = 120_000
    raid_allies: int = 6
    kill_window_ms: int = 5_000
    resamples: int = 1000
    seed: int = 0x5EED
    ci_percent: float = 95.0
    min_n: int = 8
    fold_article_case: bool = False
