"""Recognition rules: ranked message templates.

A template is literal text with ``{field}`` placeholders: ``{f}`` is the shortest text that fits, ``{f:n}`` digits,
``{f:i}`` digits with a sign, ``{f:w}`` one word, ``{f:a|b}`` one of some texts, ``{f:/x/}`` what the pattern x fits; an
empty field name captures nothing.  ``[text]`` may be absent, ``(a|b)`` is one of two texts; a backslash keeps the next
character literal.  Templates always fit whole messages.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import cached_property

from ledgerline.functions.text import COIN_LIST, COIN_SPACED
from ledgerline.operators import vocabulary
from ledgerline.schema import DIALECT

TOKEN = re.compile(r"\\(.)|\{(\w*)(?::(/.*?/(?=\})|[^}]*))?\}|([\[\]()|])|(.)")
NAMED = {"n": r"\d+", "i": r"-?\d+", "w": r"\S+", "": ".+?"}


@dataclass(frozen=True)
class Rule:
    """`rank` orders the rules, the lowest that fits wins; `constants` are payload fields that the message does not hold."""

    rank: int
    rule_id: str
    type: str
    template: str = ""
    constants: dict = field(default_factory=dict)
    among: tuple[str, ...] = ()  # whole messages instead of a template
    endings: tuple[str, ...] = ()  # ends of messages instead of a template, tried in order
    dialect: str = DIALECT

    @cached_property
    def parsed(self) -> tuple[str, dict[str, int], str, str]:
        """(pattern, group number of each field, longest text that every fitting message holds, text that begins it)."""
        pattern, groups, runs, depth = "", {}, [""], 0
        for token in TOKEN.finditer(self.template):
            kept, name, kind, frame, char = token.groups()
            if kept or char:
                pattern += re.escape(kept or char)
                if not depth:
                    runs[-1] += kept or char
                continue
            runs.append("")
            if frame:
                depth += (frame in "[(") - (frame in "])")
                pattern += {"[": "(?:", "]": ")?", "(": "(?:", ")": ")", "|": "|"}[frame]
                continue
            inner = kind[1:-1] if kind and kind[0] == "/" else NAMED.get(kind or "") or "|".join(map(re.escape, kind.split("|")))
            pattern += f"({inner})" if name else f"(?:{inner})"
            if name:
                groups[name] = len(groups) + 1
        return pattern, groups, max(runs, key=len), runs[0]

    @property
    def pattern(self) -> str:
        return rf"^{self.parsed[0]}\z"

    @property
    def fields(self) -> dict[str, int]:
        return self.parsed[1] if self.template else {}

    @property
    def anchor(self) -> str:
        return self.parsed[2]

    @property
    def lead(self) -> str:
        return self.parsed[3]


THIRD, FIRST = "|".join(vocabulary.MELEE_VERBS_THIRD), "|".join(vocabulary.MELEE_VERBS_FIRST)
NOTE = r"[ \({annotation:/[A-Za-z ]+/}\)]"
COUNT = "{quantity:/a|an|\\d+/}"
COINS, SPACED = f"{{coins:/{COIN_LIST}/}}", f"{{coins:/{COIN_SPACED}/}}"
CHANNEL = "{channel:/[A-Za-z][A-Za-z0-9]*/}:{channel_number:n}"
QUOTE = "'{message:/.+/}'"

# Wordings, ranks and names of the format's rules.  A row is rank, rule, type, template and constants.
TEMPLATES = [
    (10, "melee-hit-third", "melee_hit", f"{{attacker}} {{verb:{THIRD}}} {{target}} for {{amount:n}} point[s] of damage.{NOTE}", {}),
    (20, "melee-miss-third", "melee_miss", f"{{attacker}} tries to {{verb:/[a-z]+/}} {{target}}, but {{outcome}}!{NOTE}", {}),
    (30, "melee-hit-you", "melee_hit", f"You {{verb:{FIRST}}} {{target}} for {{amount:n}} point[s] of damage.{NOTE}", {"attacker": "You"}),
    (40, "melee-miss-you", "melee_miss", f"You try to {{verb:/[a-z]+/}} {{target}}, but {{outcome}}!{NOTE}", {"attacker": "You"}),
    (50, "cast-begin", "cast_begin", "{caster} begin[s] casting {spell}.", {}),
    (80, "spell-damage", "spell_damage", f"{{attacker}} hit[s] {{target}} for {{amount:n}} point[s] of {{school:/[a-z]+/}} damage by {{spell}}.{NOTE}", {}),
    (90, "heal", "heal", r"{healer} healed {target} for {amount:n}[ \({uncapped_amount:n}\)] hit point[s][ by {spell}].", {}),
    (110, "damage-shield", "damage_shield", "{target} (is|are) (burned|pierced|tormented) by {owner:/YOUR|.+?'s/} {element:flames|thorns|frost} for {amount:n} point[s] of non-melee damage(.|!)", {}),
    (120, "self-damage", "self_damage", "You hurt yourself for {amount:n} point[s].", {}),
    (130, "skill-up", "skill_up", r"You have become better at {skill}! \({skill_value:n}\)", {}),
    (140, "chat-channel", "chat_message", f"{{speaker:w}} tells {CHANNEL}, {QUOTE}", {}),
    (150, "xp-gain", "xp_gain", r"You gain experience! \({whole:n}.{fraction:/\d{3}/}%\)", {}),
    (160, "kill-you", "kill", "You have slain {target}!", {"killer": "You"}),
    (165, "dot-your", "dot_tick", "{target} has taken {amount:n} damage from your {spell}.", {"attacker": "You"}),
    (170, "dot-other", "dot_tick", "{target} has taken {amount:n} damage from {spell} by {attacker}.", {}),
    (180, "dot-you", "dot_tick", "You have taken {amount:n} damage from {spell} by {attacker}.", {"target": "You"}),
    (185, "dot-unknown-source", "dot_tick", "{target} has taken {amount:n} damage by {spell}.", {}),
    (190, "cast-resume", "cast_resume", "You regain your concentration and continue your casting.", {}),
    (200, "chat-say", "chat_message", f"{{speaker}} say[s], {QUOTE}", {"channel": "say"}),
    (210, "loot-item", "loot_item", f"--You have looted {COUNT} {{item}} from {{corpse}}'s corpse.--", {}),
    (215, "loot-item-create", "loot_item", f"You looted {COUNT} {{item}} from {{corpse}}'s corpse to create (a|an) {{:/.+/}}", {}),
    (220, "coin-gain-corpse", "coin_gain", f"You receive {COINS} from the corpse.", {"source": "corpse"}),
    (230, "death-you", "death", "You have been slain by {killer}!", {"entity": "You"}),
    (240, "kill-other", "kill", "{target} has been slain by {killer}!", {}),
    (250, "faction-change", "faction_change", "Your faction standing with {faction} has been adjusted by {delta:i}.", {}),
    (270, "pet-chatter", "pet_chatter", "{pet} told you, '{message:/.+ Master\\./}'", {}),
    (280, "chat-tell-npc", "chat_message", f"{{speaker}} told you, {QUOTE}", {"channel": "tell", "recipient": "You"}),
    (290, "cast-interrupt-you", "cast_interrupt", "Your {spell} spell is interrupted.", {"caster": "You", "reason": "interrupted"}),
    (300, "loot-auto-sell", "loot_auto_sell", f"You looted {COUNT} {{item}} from {{corpse}}'s corpse and sold it for {COINS}.", {}),
    (305, "loot-auto-sell-free", "loot_auto_sell", f"You looted {COUNT} {{item}} from {{corpse}}'s corpse and sold it for free.", {"total_copper": 0}),
    (310, "coin-gain-merchant", "coin_gain", f"You receive {SPACED} from {{merchant}} for the {{item}}\\(s\\).", {"source": "merchant"}),
    (320, "resist-protected", "spell_resist", "{caster} tries to cast a spell on you, but you are protected.", {"target": "You"}),
    (330, "cast-interrupt-other", "cast_interrupt", "{caster}'s {spell} spell is interrupted.", {"reason": "interrupted"}),
    (340, "cast-resume-other", "cast_resume", "{caster} regains concentration and continues casting.", {}),
    (350, "zone-enter", "zone_enter", "You have entered {zone}.", {}),
    (360, "stance-change-begin", "stance_change_begin", "You begin to change your stance.", {}),
    (370, "resist-you", "spell_resist", "You resist {caster}'s {spell}!", {"target": "You"}),
    (380, "resist-your-spell", "spell_resist", "{target} resisted your {spell}!", {"caster": "You"}),
    (390, "stance-change", "stance_change", "You assume a[n] {stance} stance.", {}),
    (430, "resist-other", "spell_resist", "{target} resisted {caster}'s {spell}!", {}),
    (470, "cast-fizzle-you", "cast_interrupt", "Your {spell} spell fizzles!", {"caster": "You", "reason": "fizzle"}),
    (480, "cast-fizzle-other", "cast_interrupt", "{caster}'s {spell} spell fizzles!", {"reason": "fizzle"}),
    (490, "level-up", "level_up", "You have gained a level! Welcome to level {level:n}!", {}),
    (500, "invocation-change-begin", "invocation_change_begin", "You begin to change your invocation.", {}),
    (510, "chat-channel-you", "chat_message", f"You tell {CHANNEL}, {QUOTE}", {"speaker": "You"}),
    (520, "invocation-change", "invocation_change", "You begin reciting the {invocation} invocation.", {}),
    (530, "ability-purchase", "ability_purchase", 'You have gained the ability "{ability}" at a cost of {cost_points:n} ability point[s].', {}),
    (535, "ability-improve", "ability_purchase", "You have improved {ability} at a cost of {cost_points:n} ability point[s].", {}),
    (540, "coin-gain-item", "coin_gain", f"You received {COINS} from that item.", {"source": "item"}),
    (550, "chat-ooc", "chat_message", f"{{speaker}} says out of character, {QUOTE}", {"channel": "ooc"}),
    (560, "chat-shout", "chat_message", f"{{speaker}} shout[s], {QUOTE}", {"channel": "shout"}),
    (570, "chat-tell-recv", "chat_message", f"{{speaker}} tells you, {QUOTE}", {"channel": "tell", "recipient": "You"}),
    (580, "chat-tell-sent", "chat_message", f"You told {{recipient:w}}, {QUOTE}", {"channel": "tell", "speaker": "You"}),
    (590, "pet-report", "pet_chatter", "{message:/(?:Failed to|Taunting|Captured) .+, Master[.!]/}", {}),
    (600, "death-bare", "death", "{entity} died.", {}),
    (610, "cast-begin-song", "cast_begin", "{caster} begin[s] singing {spell}.", {}),
    (620, "xp-gain-party", "xp_gain", r"You gain party experience! \({whole:n}.{fraction:/\d{3}/}%\)", {}),
    (630, "environmental-damage", "environmental_damage", "You were hit by non-melee for {amount:n} damage.", {}),
    (640, "rune-absorb", "rune_absorb", "You gain a rune for {amount:n} points of absorption.", {}),
    (650, "log-toggle", "log_toggle", "Logging to '{file}' is now *{state:ON|OFF}*.", {}),
    (660, "chat-group", "chat_message", f"{{speaker}} tells the group, {QUOTE}", {"channel": "group"}),
    (665, "chat-group-you", "chat_message", f"You tell your party, {QUOTE}", {"channel": "group", "speaker": "You"}),
    (672, "chat-npc-growl", "chat_message", f"{{speaker}} growls fiercely; saliva foaming around its ferocious, jagged maw, {QUOTE}", {"channel": "say"}),
    (760, "cast-interrupt-song", "cast_interrupt", "A missed note brings {caster}'s {spell} to a close!", {"reason": "interrupted"}),
    (765, "spell-emote-barking", "spell_emote", "{emote:/You hear the barking of (?:the )?\\S+\\./}", {}),
]

# System messages that carry a detail; the kind is the rule's name with underscores unless a row says more.
SYSTEM_TEMPLATES = [
    (400, "ability-ready", r"You can use the ability {detail} again in {:n} minute\(s\) {:n} seconds."),
    (405, "item-merge", "You have successfully merged two items together to create a new item: {detail:/.+/}"),
    (410, "targeted", r"Targeted \({category:/[A-Za-z ]+/}\): {detail:/.+/}"),
    (420, "ability-activate", "You activate {detail}."),
    (440, "memorize-begin", "Beginning to memorize {detail}..."),
    (445, "memorize-done", "You have finished memorizing {detail}."),
    (446, "scribe-begin", "Beginning to scribe {detail}..."),
    (447, "scribe-done", "You have finished scribing {detail}."),
    (450, "spell-forget", "You forget {detail}."),
    (455, "spell-set-loaded", "Spell set {detail} loaded."),
    (465, "ability-point", "You have gained an ability point!  You now have {detail:n} ability point[s].", "ability_point_gain"),
    (670, "account-time", "Your total time entitled on this account is approximately {detail:/\\d+ years?, \\d+ days?/}."),
    (675, "interaction-hint", "Stand close to and right click on the {detail} to {:/.+/}."),
    (680, "pet-give-failed", "You could not give item {detail} to your pet"),
    (685, "taunt-partial", "{detail} was partially successful in capturing {:}'s attention."),
    (690, "missing-reagent", "You are missing {detail}."),
    (700, "spell-granted", "You have been granted the following spell: {detail}."),
    (705, "item-destroyed", "You successfully destroyed {detail:/\\d+ .+?/}."),
    (710, "ability-granted", "You have gained the ability to use {detail}."),
    (715, "trade-offer", "You offered {detail:/\\d+ .+?/} to {:}."),
    (720, "trade-complete", "You complete the trade with {detail}."),
    (725, "camp-countdown", "It will take about {detail:n} more seconds to prepare your camp."),
    (730, "achievement", "You have completed achievement: {detail:/.+/}"),
    (735, "channels-list", "Channels: {detail:/\\d+=.+/}"),
    (740, "auto-attack-skill", "You will now use {detail} while auto attacking."),
    (745, "purchase", "You purchased {detail:/\\d+ .+?/} from {:} for{:/ {2}.+?| ?/}."),
    (750, "pet-spell-worn", "Your pet's {detail} spell has worn off."),
    (755, "spell-worn-target", "Your {detail} spell has worn off of {:}.", "spell_worn"),
    (770, "learned", "You have learned {detail}!"),
    (775, "discipline-granted", "You have been granted the following discipline: {detail}."),
    (780, "session-time", "This session: {detail:/.+/}"),
    (785, "played-time", "Total time playing {detail}: {:/.+/}"),
    (790, "played-birthdate", "{detail:w}'s birthdate: {:/[A-Z].+\\d/}."),
    (795, "played-age", r"{detail:w}'s age: {:n} years \({:w} time\). {:n} years \({:w} time\)."),
    (800, "instance-create", "Player {detail:w} creating instance {:/.+/}."),
    (805, "instance-available", "{detail} is now available to you."),
    (810, "keyring-hint", "Only {detail} items may be placed in the {:} key ring."),
    (815, "bandage-cap-self", "You cannot be bandaged past {detail:n} percent of your max hit points. "),
    (820, "bandage-cap-target", "You cannot bandage your target past {detail:n} percent of their hit points. "),
    (825, "spell-set-saved", "Spell set {detail} saved."),
    (830, "auto-attack-skill-swap", "You will now use {detail} instead of {:} while attacking."),
    (835, "ability-wait", "You need to wait {:n} more seconds before you can {detail} again."),
    (840, "taunt-failed", "{detail:w} failed to taunt {:/.+/}."),
    (845, "taunt-captured", "{detail:w} has captured {:}'s attention!"),
    (850, "channel-full", "Channel {detail:w} was too full to join"),
]

#: Two exact messages name what this library does not; they are told by their frame.
FRAMED = {"welcome": r"Welcome to [A-Z]\w+ [A-Z]\w+!", "help_hint": r'If you need help, click on the \w+ Menu button at the bottom of your screen and select the "Help" option\.'}

SYSTEM_KINDS = {text: kind for kind, _, text in (line.partition(" ") for line in vocabulary.SYSTEM_MESSAGES.strip("\n").split("\n"))}


def base_rules() -> list[Rule]:
    rules = [Rule(rank, rule_id, kind, template, constants) for rank, rule_id, kind, template, constants in TEMPLATES]
    for rank, name, template, *kind in SYSTEM_TEMPLATES:
        rules.append(Rule(rank, f"system-{name}", "system_message", template, {"kind": kind[0] if kind else name.replace("-", "_")}))
    rules.append(Rule(60, "system-exact", "system_message", among=tuple(SYSTEM_KINDS)))
    rules.append(Rule(100, "spell-emote-self", "spell_emote", among=tuple(vocabulary.SELF_EMOTES.strip("\n").split("\n"))))
    rules.append(Rule(460, "spell-emote-subject", "spell_emote", endings=tuple(vocabulary.SUBJECT_EMOTES.strip("\n").split("\n"))))
    return sorted(rules, key=lambda r: r.rank)


class Registry:
    """Rules in rank order.  Identifiers and ranks are unique."""

    def __init__(self, rules: Iterable[Rule]):
        self.rules = sorted(rules, key=lambda r: r.rank)
        for what, values in (("rule", [r.rule_id for r in self.rules]), ("rank", [r.rank for r in self.rules])):
            twice = {v for v in values if values.count(v) > 1}
            if twice:
                raise ValueError(f"duplicate {what}: {sorted(twice)}")

    def extended(self, dialect: str, overrides: Iterable[Rule]) -> Registry:
        """A dialect that inherits all rules but those that it declares itself, which it stamps as its own."""
        own = [replace(r, dialect=dialect) for r in overrides]
        named = {r.rule_id for r in own}
        return Registry([r for r in self.rules if r.rule_id not in named] + own)
