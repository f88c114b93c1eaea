"""Rules, shapes, dialects and diagnostics."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text as tx
from ledgerline.operators.parse import events_of, recognised
from ledgerline.operators.rules import TOKEN, Registry, Rule, base_rules
from ledgerline.plans import diagnostics as diag
from ledgerline.sources.log_files import LINES
from tests.support import START, log, parsed, stamp

SAMPLES = {
    tx.COIN_LIST: "2 gold and 5 copper", tx.COIN_SPACED: "2 gold 5 copper", "[a-z]+": "fire", "[A-Za-z ]+": "Critical", r"a|an|\d+": "3", r"\d{3}": "019", ".+": "some text", r".+ Master\.": "Attacking a rat Master.",
    "YOUR|.+?'s": "Rover's", "[A-Za-z][A-Za-z0-9]*": "General1", r"(?:Failed to|Taunting|Captured) .+, Master[.!]": "Taunting a rat, Master.", r"You hear the barking of (?:the )?\S+\.": "You hear the barking of the hound.",
    r"\d+ years?, \d+ days?": "1 year, 20 days", r"\d+ .+?": "5 Rations", r"\d+=.+": "1=General", r" {2}.+?| ?": "  2 gold", r"[A-Z].+\d": "May 3 2020",
}


def example(rule):
    """A message that the rule fits."""
    if rule.among:
        return rule.among[3]
    if rule.endings:
        return "Someone" + rule.endings[12]
    out, depth = "", []
    for kept, name, kind, frame, char in (m.groups() for m in TOKEN.finditer(rule.template)):
        hidden = "|" in depth
        if frame:
            if frame in "[(":
                depth.append(frame)
            elif frame == "|":
                depth.append("|")
            else:
                while depth.pop() not in "[(":
                    pass
        elif not hidden and (kept or char):
            out += kept or char
        elif not hidden:
            kind = kind or ""
            out += SAMPLES[kind[1:-1]] if kind.startswith("/") else {"n": "7", "i": "-4", "w": "Word", "": "Thing"}.get(kind, kind.split("|")[0])
    return out


def test_every_rule_recognises_its_wording(spark):
    rules = base_rules()
    text = log(*[(1, example(r)) for r in rules])
    got = parsed(spark, text).orderBy("seq").collect()
    assert [r.rule_id for r in got] == [r.rule_id for r in rules] and len(got) == 113
    assert [r.type for r in got] == [r.type for r in rules]


def test_fields(spark):
    text = log(
        (1, "You slash a rat for 5 points of damage."), (1, "A rat bites YOU for 1 point of damage. (Wild Rampage)"), (1, "a rat tries to bite YOU, but YOU dodge!"), (1, "You try to slash a rat, but a rat's magical skin absorbs the blow!"),
        (1, "You healed Ann for 20 (25) hit points by Mending."), (1, "Ann healed herself for 3 hit points."), (1, "a rat is burned by YOUR flames for 6 points of non-melee damage."), (1, "You gain experience! (1.019%)"),
        (1, "You looted a Husk from a rat's corpse and sold it for 2 platinum, 1 gold and 8 copper."), (1, "You receive 3 gold 2 copper from Merchant for the Big Husk(s)."), (1, "Your faction standing with Guard has been adjusted by -3."),
        (1, "Rover told you, 'Attacking a rat Master.'"), (1, "Targeted (NPC): a rat"), (1, "Ann staggers."), (1, "??? staggers."), (1, "You have been slain by a rat!"), (1, "Welcome to Some Game!"),
    )
    r = parsed(spark, text).orderBy("seq").collect()
    assert (r[0].attacker, r[0].target, r[0].amount, r[0].modifiers, r[0].value) == ("You", "a rat", 5, [], 5)
    assert (r[1].modifiers, r[1].annotation, r[2].outcome, r[3].outcome) == (["Wild Rampage"], None, "dodge", "absorb")
    assert (r[4].amount, r[4].uncapped_amount, r[4].spell, r[5].uncapped_amount, r[5].spell, r[6].owner) == (20, 25, "Mending", None, None, "YOUR")
    assert (r[7].percent_milli, r[8].total_copper, r[8].quantity, r[9].total_copper, r[9].merchant, r[10].delta) == (1019, 2108, 1, 302, "Merchant", -3)
    assert (r[11].pet, r[11].pet_target, r[12].category, r[12].detail, r[13].subject, r[13].emote) == ("Rover", "a rat", "npc", "a rat", "Ann", "staggers.")
    assert (r[14].type, r[15].type, r[15].entity, r[16].kind) == ("raw_unknown", "death", "You", "welcome")


def test_registry_refuses_doubles():
    with pytest.raises(ValueError, match="rule"):
        Registry([Rule(1, "a", "t", "x"), Rule(2, "a", "t", "y")])
    with pytest.raises(ValueError, match="rank"):
        Registry([Rule(1, "a", "t", "x"), Rule(1, "b", "t", "y")])


def lines(spark, *messages):
    rows = [("/l", 1, i, i * 90, 90, stamp(START) + m, START, START, False) for i, m in enumerate(messages, 1)]
    return spark.createDataFrame(rows, LINES).withColumn("seq", F.col("line_no"))


def test_dialects_override_and_are_detected(spark):
    base = Registry(base_rules())
    own = base.extended("other", [Rule(160, "kill-you", "kill", "You did slay {target}!", {"killer": "You"})])
    got = events_of(lines(spark, "You did slay a rat!", "You have slain a rat!", "You slash a rat for 5 points of damage."), own).orderBy("seq").collect()
    assert [(r.type, r.dialect_id) for r in got] == [("kill", "other"), ("raw_unknown", "beta-2026-07"), ("melee_hit", "beta-2026-07")]
    sample = lines(spark, *["You did slay a rat!"] * 30, "You slash a rat for 5 points of damage.")
    assert diag.detect_dialect(sample, {"base": base, "other": own}).first().dialect == "other"
    assert diag.detect_dialect(lines(spark, "You slash a rat for 5 points of damage."), {"base": base, "other": own}).first().dialect == "unknown"
    assert diag.detect_dialect(sample, {"base": base}).first().dialect == "base"
    marked = diag.detect_dialect(sample, {"base": base, "other": own}, {"base": F.col("raw").contains("slash")}).first()
    assert (marked.dialect, marked.confidence) == ("base", 1.0)


def reference_shape(message):
    message = re.sub(r"\d+", "#", re.sub(r"'.*'", "'…'", message, flags=re.S))

    def run(m):
        tokens = m[0].split()
        i = 0
        while i < len(tokens) and tokens[i] in {"A", "An", "The", "You", "Your", "YOU", "YOUR"}:
            i += 1
        return m[0] if i == len(tokens) else " ".join([*tokens[:i], "Name"])

    return re.sub(r"[A-Z][A-Za-z`'-]*(?:\s+[A-Z][A-Za-z`'-]*)*", run, message)


def test_shapes(spark):
    cases = ["You hit Lord Grey for 12", "The Old Man says 'Hi 5' to YOU", "A", "An Owl", "YOU Your The", "Youth Hostel", "x YOUR Friend's sword", "aBC Def", "It's 5'3 tall'", "", "Über Alles", "The A Bee", "YOUNG A Man"]
    got = [r.s for r in spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string").select("i", tx.shape(F.col("c")).alias("s")).orderBy("i").collect()]
    assert got == [reference_shape(c) for c in cases]


def test_rates_drift_and_samples(spark):
    rows = events_of(lines(spark, "You slash a rat for 5 points of damage.", "odd Name 1", "odd Other 2", "You died."))
    top = diag.benchmark(rows).first()
    assert (top.lines, top.unmatched, top.rate) == (4, 2, 0.5)
    assert diag.benchmark(rows.filter("false")).first().rate == 0
    base = spark.createDataFrame([("melee_hit", 0.1), ("heal", 0.4), ("death", 0.5)], "family string, share double")
    report = diag.drift_report(rows, base)
    assert [(r.family, r.drop_share) for r in report["families"].collect()] == [("heal", 1.0)]
    assert [(r["shape"], r.n) for r in report["shapes"].collect()] == [("odd Name #", 2)] and report["overall"].first().alert
    assert diag.unknown_line_stats(rows).first().n == 2 and not diag.passes_gate(rows).first().passes
    many = spark.range(1, 20_001).select(F.lit("/l").alias("path"), F.col("id").alias("line_no"))
    kept = diag.sample_lines(many)
    assert kept.filter("line_no <= 1000").count() == 1000 and 4500 < kept.count() <= 5000
    assert diag.anonymised(F.lit("Ann and Anna"), ["Ann", "Anna"]) is not None
    assert spark.range(1).select(diag.anonymised(F.lit("Ann and Anna, Annie"), ["Ann", "Anna"]).alias("x")).first().x == "Player1 and Player2, Annie"


def test_coins_and_numbers(spark):
    cases = {"1 platinum, 2 gold, 3 silver and 4 copper": 1234, "5 copper": 5, "1 gold 2 copper": 102, "1 gold, 2 tin": None, "gold": None, "": None}
    got = {r.c: r.v for r in spark.createDataFrame([(c,) for c in cases], "c string").select("c", tx.copper(F.col("c")).alias("v")).collect()}
    assert got == cases
    assert recognised(lines(spark, "x")).first().type == "raw_unknown"
