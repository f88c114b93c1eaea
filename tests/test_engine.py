"""The chain from log text to answers, with the numbers that the specification's scenarios give."""

import pytest

from ledgerline.operators.encounters import finalized
from ledgerline.operators.resolve import attribution
from ledgerline.plans import read
from tests.support import events, files, log, melee, parsed, projected, step

S = 1000

GOLDEN = log(
    (0, "You have entered Castle Grey."), (2, "You begin to change your stance."), (1, "You assume a berserker stance."), (2, "You begin to change your invocation."), (1, "You begin reciting the fury invocation."),
    (4, "Rover told you, 'Attacking Lord Grey Master.'"), (2, "You slash Lord Grey for 45 points of damage."), (1, "Friend slashes Lord Grey for 30 points of damage."), (1, "Rover slashes Lord Grey for 20 points of damage."),
    (1, "Lord Grey is burned by Rover's flames for 11 points of non-melee damage."), (1, "Lord Grey slashes YOU for 25 points of damage."), (1, "Lord Grey slashes Friend for 18 points of damage."), (1, "You healed Friend for 60 hit points by Mending."),
    (2, "You slash Lord Grey for 50 points of damage. (Critical)"), (2, "You have slain Lord Grey!"), (0, "You gain experience! (4.000%)"), (3, "You looted a Dagger from Lord Grey's corpse and sold it for 1 silver and 8 copper."), (2, "You receive 2 silver and 5 copper from the corpse."),
    (3, "Your faction standing with Grey Guard has been adjusted by 100."), (5, "Something flickers out of the blue."), (3265, "You have entered The Sands."), (5, "You slash a beetle for 8 points of damage."), (1, "a beetle slashes YOU for 3 points of damage."),
    (2, "You slash a beetle for 9 points of damage."), (2, "You have slain a beetle!"), (0, "You gain experience! (1.000%)"), (10, "A chime is heard from afar."),
)


@pytest.fixture(scope="module")
def golden(spark):
    return projected(spark, parsed(spark, GOLDEN))


def rows(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


def test_golden_types(golden):
    types = rows(golden.events.orderBy("seq"), "type")
    assert types == (
        "zone_enter stance_change_begin stance_change invocation_change_begin invocation_change pet_chatter melee_hit melee_hit melee_hit damage_shield melee_hit melee_hit heal melee_hit kill "
        "xp_gain loot_auto_sell coin_gain faction_change raw_unknown zone_enter melee_hit melee_hit melee_hit kill xp_gain raw_unknown"
    ).split()


def test_golden_sessions(golden):
    summary = read.session_summaries(golden).orderBy("session_id").collect()
    first = summary[0]
    assert len(summary) == 2
    assert (first.encounter_count, first.xp_percent_milli, first.coin_copper, first.zones, first.active_ms, first.afk_ms) == (1, 4000, 43, ["Castle Grey"], 10_000, 25_000)
    assert summary[1].ended_ts is None and first.ended_ts is not None


def test_golden_encounters(golden):
    heads = read.list_encounters(golden).collect()
    assert [(h["name"], h.top_actor, h.zone_name) for h in heads] == [("Lord Grey", "Owner", "Castle Grey"), ("Trash: The Sands", "Owner", "The Sands")]
    assert heads[0].status == "closed" and heads[1].status == "active"


def test_golden_fold(golden):
    single = {r.actor: r for r in read.get_actor_stats(golden, 1, fold_pets=False).collect()}
    assert single["Rover"].attrib_owner == "Owner" and single["Rover"].damage_total == 31
    fold = {r.actor: r for r in read.get_actor_stats(golden, 1).collect()}
    assert fold["Owner"].damage_total == 126 and set(fold) == {"Owner", "Friend"}
    assert fold["Owner"].active_stance == "berserker" and fold["Owner"].active_invocation == "fury"
    roles = dict(rows(read.get_encounter(golden, 1)["participants"], "name", "role"))
    assert roles == {"Owner": "ally", "Friend": "ally", "Rover": "ally", "Lord Grey": "enemy"}


def group_fight():
    return [
        step(0, "zone_enter", zone="The Sands"), step(S, "stance_change", stance="berserker"), step(S, "invocation_change", invocation="recovery"), step(S, "pet_chatter", pet="Rover", message="Attacking a spider Master.", pet_target="a spider"),
        melee(S, "You", "a spider", 5), step(S, "spell_damage", attacker="You", target="a spider", amount=8, modifiers=[]), melee(S, "Rover", "a spider", 4), step(S, "melee_miss", attacker="You", target="a spider"),
        step(S, "heal", healer="You", target="Rover", amount=20, uncapped_amount=25), step(S, "kill", killer="You", target="a spider"), step(S, "xp_gain", percent_milli=1019), step(S, "loot_auto_sell", item="Husk", corpse="x", quantity=2, total_copper=18),
        step(S, "faction_change", faction="Guard", delta=100), step(S, "ability_purchase", ability="Origin", cost_points=0), step(2400 * S, "zone_enter", zone="New Expedition"), melee(S, "You", "a skeleton", 7), step(S, "kill", killer="You", target="a skeleton"),
        step(S, "coin_gain", total_copper=5, source="corpse"), step(S, "skill_up", skill="1H", skill_value=12),
    ]


def test_group_fight(spark):
    p = projected(spark, events(spark, *group_fight()))
    first = read.session_summaries(p).orderBy("session_id").collect()
    assert (first[0].span_ms, first[0].active_ms, first[0].xp_percent_milli, first[0].coin_copper, first[1].coin_copper) == (13_000, 5_000, 1019, 18, 5)
    rates = read.xp_rates(p).orderBy("session_id").collect()
    assert (rates[0].attributed_percent_milli, rates[0].kill_count, rates[1].kill_count) == (1019, 1, 1)
    fold = read.get_actor_stats(p, 1).collect()
    assert [(r.actor, r.damage_total, r.heal_total, r.overheal_total, r.miss_count) for r in fold] == [("Owner", 17, 20, 5, 1)]
    assert read.min_confidence(p, 1).first()[0] == 0.95
    xp = p.xp_events.filter("kind = 'normal'").first()
    assert xp.confidence == pytest.approx(0.8) and xp.attributed_encounter_id == 1
    assert rows(p.zones.orderBy("zone_id"), "name", "is_instance") == [("The Sands", False), ("New Expedition", True)]
    assert rows(p.skill_events, "skill", "skill_value") == [("1H", 12)]
    assert rows(read.get_loot(p, 1), "item_name", "mode", "sale_total_copper") == [("Husk", "auto_sold", 18)]
    assert rows(read.get_currency(p), "delta_copper", "reason") == [(18, "auto_sell"), (5, "loot_coin")]
    assert rows(read.get_faction_changes(p, 1), "faction_name", "delta") == [("Guard", 100)]
    names = rows(p.entities.orderBy("entity_id"), "name", "kind")
    assert names == [("Owner", "player"), ("a spider", "npc"), ("Rover", "pet"), ("a skeleton", "npc")]
    assert rows(p.entity_links, "pet", "owner", "confidence", "evidence_type", "active") == [("Rover", "Owner", 0.95, "pet_chatter", True)]


def test_override_takes_the_pet_away(spark):
    overrides = spark.createDataFrame([(1, 1, "Rover", "kind", "player")], "log_file_id long, override_id long, name string, field string, new_value string")
    p = projected(spark, events(spark, *group_fight()), overrides=overrides)
    assert rows(read.get_actor_stats(p, 1), "actor", "damage_total") == [("Owner", 13), ("Rover", 4)]
    assert read.min_confidence(p, 1).first()[0] == 1.0


def test_named_boss_and_hits_back(spark):
    p = projected(spark, events(spark, melee(0, "You", "Boss", 20), melee(S, "Ann", "Boss", 20), melee(S, "Bob", "Boss", 30), melee(S, "Boss", "Ann", 50), melee(S, "Boss", "YOU", 9)))
    assert rows(read.get_actor_stats(p, 1), "actor", "damage_total") == [("Bob", 30), ("Owner", 20), ("Ann", 20)]
    assert sorted(rows(p.participants, "role")) == ["ally"] * 3 + ["enemy"]


def test_raid_needs_more_than_six_allies(spark):
    six = [melee(S, "You", "Boss", 1)] + [melee(S, n, "Boss", 1) for n in "Abe Bob Cat Dan Eve".split()]
    assert rows(projected(spark, events(spark, *six)).encounters, "scale") == ["group"]
    assert rows(projected(spark, events(spark, *six, melee(S, "Fay", "Boss", 1), melee(100 * S, "You", "Boss", 1))).encounters, "scale") == ["raid"]


def test_timeout_back_dates_and_any_event_closes(spark):
    p = projected(spark, events(spark, melee(S, "You", "a rat", 1), melee(3 * S, "You", "a rat", 1), step(20 * S, "zone_enter", zone="Z"), melee(S, "You", "a bat", 1), melee(16 * S, "You", "a bat", 1)))
    got = p.encounters.orderBy("encounter_id").collect()
    assert [(e.enemy, e.ended_ts - e.started_ts, e.status) for e in got] == [("a rat", 3000, "closed"), ("a bat", 0, "closed"), ("a bat", 0, "active")]
    assert rows(finalized(p.encounters).orderBy("encounter_id"), "status") == ["closed"] * 3
    assert rows(finalized(p.encounters, got[2].ended_ts + 15_000).orderBy("encounter_id"), "status")[2] == "active"


def test_order_is_by_number_not_time(spark):
    p = projected(spark, events(spark, step(0, "stance_change", stance="a"), melee(0, "You", "a rat", 1), step(0, "stance_change", stance="b"), melee(0, "You", "a rat", 1), melee(0, "You", "a bat", 1)))
    assert rows(p.encounters.orderBy("encounter_id"), "active_stance") == ["a", "b"]


def test_damage_split(spark):
    p = projected(spark, events(spark, step(0, "pet_chatter", pet="Rover", message="x Master."), melee(S, "You", "a rat", 5), step(S, "dot_tick", attacker="You", target="a rat", amount=10, spell="x"), step(S, "damage_shield", owner="Rover", target="a rat", amount=6)))
    got = read.get_actor_stats(p, 1).first()
    assert (got.melee_damage, got.dot_damage, got.ds_damage, got.damage_total, got.hit_count) == (5, 10, 6, 21, 3)


def test_sessions_end_with_the_log_and_after_a_gap(spark):
    p = projected(spark, events(spark, step(0, "rune_absorb", amount=1), step(1800 * S, "rune_absorb", amount=1), step(1800 * S + 1, "log_toggle", file="f", state="OFF"), step(S, "log_toggle", file="f", state="ON")))
    got = p.sessions.orderBy("session_id").collect()
    assert [s.events for s in got] == [2, 1, 1]
    assert got[1].ended_ts == got[1].started_ts and got[2].ended_ts is None


def test_shield_evidence(spark):
    # a generated name that burned the owner first is an enemy and stays one after a shield of its own; chatter makes it a pet
    shield = lambda owner, target: step(S, "damage_shield", owner=owner, target=target, amount=1)
    p = projected(spark, events(spark, shield("Gabn", "YOU"), shield("Gabn", "a rat"), step(S, "pet_chatter", pet="Gabn", message="x Master."), shield("Jeber", "a rat"), shield("Named", "a rat"), shield("a golem", "a rat")))
    kinds = dict(rows(p.entities, "name", "kind"))
    assert kinds["Gabn"] == "pet" and kinds["Named"] == "unknown" and kinds["a golem"] == "npc"
    states = p.states.filter("canonical = 'Gabn'").orderBy("seq").collect()
    assert [(s.kind, s.kind_confidence) for s in states] == [("npc", 0.9), ("npc", 0.9), ("pet", 0.95)]


def test_experiment(spark):
    steps = []
    for stance, damage in (("berserker", 200), ("defensive", 20)):
        steps.append(step(S, "stance_change", stance=stance))
        for _ in range(4):
            steps += [melee(20 * S, "You", "a rat", damage // 2), melee(S, "You", "a rat", damage // 2)]
    p = projected(spark, events(spark, *steps), min_n=4)
    groups, decided = read.get_experiment_breakdown(p, "stance", "dps")
    assert [(g.value, g.n, g["mean"]) for g in groups.collect()] == [("berserker", 4, 200.0), ("defensive", 4, 20.0)]
    assert decided.first().winner == "berserker"
    refused = read.get_experiment_breakdown(projected(spark, events(spark, *steps)), "stance", "dps")[1].first()
    assert refused.winner is None and refused.refused_reason == "top group 'berserker' has n=4, below the minimum n (8)"


def test_live_view(spark):
    p = projected(spark, events(spark, melee(0, "You", "a rat", 1), step(20 * S, "zone_enter", zone="Z"), melee(S, "You", "Boss", 5), melee(S, "You", "a bat", 2), melee(S, "Ann", "Boss", 9)))
    view = read.live_view(p).first()
    assert view.current["name"] == "Boss" and [r["name"] for r in view.recent] == ["Trash: Unknown Zone"]
    assert [a.actor for a in view.actors] == ["Ann", "Owner"]
    assert view.seq == 5


def test_logs_do_not_mix(spark):
    both = events(spark, *group_fight()).unionByName(events(spark, *group_fight(), number=2))
    p = projected(spark, both, n=2)
    assert sorted(rows(p.encounters, "log_file_id", "encounter_id")) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert files(spark).count() == 1


def test_signals_from_outside_link_to_whom_they_name(spark):
    steps = [melee(0, "You", "a rat", 1), melee(S, "Ann", "a rat", 1), melee(S, "Helper", "a rat", 3), melee(S, "Helper", "a rat", 4)]
    signals = spark.createDataFrame([(1, 4, 0, "Helper", "Ann", "pet_chatter"), (1, 1, 0, "Ann", "You", "name_pattern")], "log_file_id long, seq long, ts long, pet string, owner string, evidence_type string")
    p = projected(spark, events(spark, *steps))
    p.signals = signals
    got = {(r.seq, r.source_name, r.attributed_name) for r in attribution(p.timeline.filter("seq >= 3")).collect()}
    assert got == {(3, "Helper", "Helper"), (4, "Helper", "Ann")}


def test_deeds_of_a_pet_whose_owner_is_an_enemy_are_not_booked(spark):
    steps = [melee(0, "You", "Lord Grey", 5), melee(500, "Fluff", "a rat", 9), melee(500, "You", "a rat", 5)]
    rows = events(spark, *steps)
    told = spark.createDataFrame([(1, 1, "Fluff", "owner", "Lord Grey"), (1, 2, "Lord Grey", "kind", "npc")], "log_file_id long, override_id long, name string, field string, new_value string")
    friend = spark.createDataFrame([(1, 1, "Fluff", "owner", "Ann")], "log_file_id long, override_id long, name string, field string, new_value string")
    for overrides, want in ((told, {"Owner"}), (friend, {"Owner", "Fluff"})):
        p = projected(spark, rows, overrides=overrides)
        assert {r.actor for r in p.actor_stats.collect()} == want


def test_ties_go_to_the_earlier_entity(spark):
    p = projected(spark, events(spark, melee(0, "Zoe", "a rat", 5), melee(0, "Ann", "a rat", 5), melee(0, "You", "a rat", 1)))
    assert [r.actor for r in read.get_actor_stats(p).collect()] == ["Zoe", "Ann", "Owner"]


def test_only_combat_reaches_the_machine(spark):
    """A line of another kind, even one whose time later runs back, ends fights as before."""
    steps = [melee(0, "You", "a rat", 5), step(40 * S, "xp_gain", percent_milli=1), melee(-39 * S, "You", "a rat", 5), melee(S, "You", "a rat", 5)]
    p = projected(spark, events(spark, *steps))
    assert [(r.opener_seq, r.started_ts - 1_760_000_000_000) for r in p.encounters.orderBy("opener_seq").collect()] == [(1, 0), (3, S)]


def test_claims_that_lose_are_kept(spark):
    from ledgerline.operators.resolve import link_conflicts, resolved

    rows = events(spark, step(1, "pet_chatter", pet="Rex"), *[melee(1000, "Rex", "a rat", 1)] * 6)
    said = [(1, 2, 0, "Rex", "Ann", "pet_chatter"), (1, 3, 0, "Rex", "Ann", "damage_shield_possessive"), (1, 4, 0, "Rex", "Ann", "user_assertion"), (1, 5, 0, "Rex", "Bob", "user_assertion"), (1, 6, 0, "Rex", "Bob", "pet_chatter")]
    signals = spark.createDataFrame(said, "log_file_id long, seq long, ts long, pet string, owner string, evidence_type string")
    lost = lambda **x: [(r.seq, r.owner, r.evidence_type, r.reason) for r in link_conflicts(resolved(rows, files(spark), signals=signals, **x)).orderBy("seq").collect()]
    equal, lower = "equal_confidence_kept_first", "lower_confidence"
    assert lost() == [(2, "Ann", "pet_chatter", equal), (3, "Ann", "damage_shield_possessive", lower), (4, "Owner", "pet_chatter", lower), (5, "Ann", "user_assertion", equal)]
    said_by_user = lambda field, value: spark.createDataFrame([(1, 1, "Rex", field, value)], "log_file_id long, override_id long, name string, field string, new_value string")
    assert [x[0] for x in lost(overrides=said_by_user("owner", "Ann"))] == [1, 5, 6]
    assert lost(overrides=said_by_user("kind", "npc")) == []
