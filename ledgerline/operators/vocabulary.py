"""Words and sentences of the log format, as data."""

# Fixed values, in the order in which the format lists them.

MELEE_VERBS_FIRST = "slash kick strike crush frenzy punch smite bash reave pierce backstab".split()

MELEE_VERBS_THIRD = "punches bashes kicks cleaves slashes pierces bites hits crushes strikes claws frenzies mauls backstabs smites reaves stings shoots slices".split()

#: One system message a line: its kind, then its whole text.
SYSTEM_MESSAGES = """
auto_attack_on Auto attack is on.
auto_attack_off Auto attack is off.
target_too_far Your target is too far away, get closer!
target_out_of_range Your target is out of range, get closer!
stunned You are stunned!
stun_worn You are no longer stunned.
stun_overcome You overcome the stun!
cast_while_stunned You can't cast spells while stunned!
cast_while_invulnerable You can't cast spells while invulnerable!
cannot_see_target You cannot see your target.
already_have_attention You already have your target's attention.
insufficient_mana Insufficient Mana to cast this spell!
no_target You no longer have a target.
encounter_locked Your attack failed because your target is Encounter Locked to someone else.
loot_no_room You cannot loot this item no room in your inventory.
must_click_target You must first click on the being you wish to attack!
must_select_spell_target You must first select a target for this spell!
loading LOADING, PLEASE WAIT...
out_of_ammo You have run out of ammo!
cant_hit_from_here You can't hit them from here.
disarm_failed Your attempt to disarm failed.
disarm_too_far You are too far away to disarm. Get closer.
mend You mend your wounds and heal some damage.
bandage_begin You begin to bandage yourself.
bandage_complete The bandaging is complete.
not_assigned_adventure You are not currently assigned to an adventure.
taunt_no_npc You must target an NPC to taunt first.
taunt_too_far You are too far away from your target to taunt.
spellbook_updated Your spellbook has been updated!
camp_prepare It will take you about 30 seconds to prepare your camp.
missing_components You are missing some required components.
sneak_begin You begin to sneak...
hide_begin You begin to hide...
hide_failed You failed to hide yourself.
no_longer_hidden You are no longer hidden.
bash_no_shield You need to equip a shield in order to BASH
marketplace_unavailable The Marketplace is unavailable at this time. Please try again later.
knocked_unconscious You have been knocked unconscious!
encumbered You are encumbered!
not_encumbered You are no longer encumbered.
attack_self_hint Try attacking someone other than yourself. It's more productive.
command_unavailable You can't use that command right now...
action_retry You cannot perform that action right now. Please try again in a moment.
consider_whom Consider whom?
zone_safe_point Returning to Zone Safe Point. Please wait...
locked_no_key It's locked and you're not holding the key.
song_blocked_symphonic This song cannot be played while Symphonic Aura is enabled.
cannot_change_stance You cannot change stances yet.
bandage_no_bandages You can't bandage without bandages, go buy some.
forage_fail You fail to locate any food nearby.
scribe_stack You cannot scribe a stack of spells, please use only one of that scroll to scribe.
find_blocked Mysterious forces prevent you from finding your destination easily.
merge_mismatch The item you are trying to add will not work, you cannot merge two different types of items.
must_stand_attack You must be standing to attack!
disarm_no_target You must target someone to disarm first.
afk_on You are now A.F.K. (Away From Keyboard).
no_tell_to_reply You have not received any tells, so you cannot reply.
map_zoom_notice Manually zooming and panning is disabled when the map is in Find mode and the "Auto-Zoom" button is active.  If you wish to manually adjust the map while in Find mode, then uncheck the "Auto-Zoom" button or use the right click re-center.
"""

#: Second-person spell emotes.
SELF_EMOTES = """
You feel your life force drain away.
A burst of strength surges through your body.
You whistle an ancient warsong.
Your wounds begin to heal.
You feel better.
You have been diseased.
You feel much better.
You writhe in the grip of agony.
You feel a little better.
You have been poisoned.
You have been lacerated.
Your stomach begins to cramp.
You are no longer diseased.
Your stomach feels better.
Your feet come free.
The poison has run its course.
You feel your skin freeze.
Your feet adhere to the ground.
You are struck by a sudden force.
You are slashed by shards of ice.
The darkness fades.
You are surrounded by darkness.
Your feet sink into the ground.
You feel your strength grow.
You slow down as your feet are covered in tangling weeds.
The tangling weeds wither away.
You feel your skin ignite.
You are in the grip of darkness.
You feel a traveling spirit enter you.
The spirit of travel leaves you.
You feel your strength return.
Your skin cools.
You feel your skin blister and burn.
You are struck by a sudden burst of force.
You feel stronger.
Your legs feel weak.
You are shrouded by anti-life magic.
The shroud fades.
Your feet move faster.
You feel a surge of strength as you let forth a mighty yaulp.
You feel protected from poison.
Your body spasms as the lightning bolt arcs through you.
You feel your skin smolder.
A brilliant blue aura surrounds your weapon.
You feel somewhat vulnerable.
You feel protected from cold.
Strength returns to your legs.
You feel dexterous.
You feel a healing touch.
You feel the favor of the gods upon you.
You feel your skin singe as the Burst of Fire hits you.
You feel more agile.
Your strength fades.
You feel your skin singe as the Burst of Flame hits you.
You feel a rush of courage.
Your stolen strength fades.
Your blood simmers.
You feel a shadow pass over you.
You feel magnanimous of spirit.
A mystical path appears before you.
You slow down.
You stagger as spirits of frost slam against you.
You feel protected from fire.
You feel the spirit of wolf enter you.
You are as quiet as a herd of running elephants.
Your vulnerability fades.
You feel the spirit of bear enter you.
Your blood cools.
You are engulfed by darkness.
The barking fades.
The vortex of shadows fades.
You feel protected from disease.
Your brain begins to smolder.
You feel a shortness of breath.
You feel your body pulse with energy.
You feel the spirit of snake enter you.
You can breathe again.
You feel smaller.
You are surrounded by flickering flames.
You are chilled by a bolt of frost.
Your feet become entwined.
You have been struck down by wrath.
The jig sends energy zinging through your body.
Your eyes tingle.
Your skin becomes as hard as turtle shell.
The flames are extinguished.
You speed back up.
You feel your blood begin to leech away.
You feel drowsy.
You feel less drowsy.
You have been struck.
You feel your skin burn as poison seeps through your skin.
You feel armored.
You feel no need to breathe.
You feel less courageous.
You are enveloped by flame.
Your hand begins to glow.
You resume breathing.
You grow scales.
The flames die down.
You are conscious again!
The roots fall from your feet.
A dull aura covers your hand.
You have been sprayed with skunk musk.
You no longer smell of skunk.
You feel your health begin to drain away.
"""

#: Ends of third-person spell emotes, tried in this order; the first character is part of the end.
SUBJECT_EMOTES = """
 staggers as spirits of frost slam against them.
 staggers as a dagger of frost slams into them.
 staggers.
 feels a little better.
 feels much better.
 feels better.
 doubles over in pain.
 is struck by the frost rift.
 is struck by a sudden burst of force.
 is struck by a sudden force.
 is struck.
 pales.
 winces.
 looks courageous.
's skin turns hard as wood.
 is enveloped by flame.
 is surrounded by a thorny barrier.
 is surrounded by a translucent shield.
 is surrounded by a brief lupine aura.
 is surrounded by darkness.
 animates an undead servant.
's body pulses with energy.
 is bathed in fire.
 is tortured by the condemnation of Rodcet Nife.
's wounds fester.
 begins to bleed profusely!
 singes as the Burst of Flame hits them.
 singes as the Burst of Fire hits them.
 is covered in flames.
 hisses and strikes!
 clatters as it turns towards you.
 has been poisoned.
 has been smitten.
's skin looks like leather.
's skin freezes.
's voice booms.
 rages.
 has fallen to the ground.
 weakens.
 begins to mend.
 is bound by strands of solid music.
 is lost in a fit of despair.
 is slashed by shards of ice.
 screams as poison burns their veins!
 is protected by a vortex of shadows.
 is enveloped in blazing energy.
 is pelted by an ancient blizzard.
 fades away.
 yawns.
 writhes in the grip of agony.
's corpse splinters into hundreds of tiny bone fragments.
 suffers a blow to the head.
's corpse crumples to the ground.
's skin goes numb.
's skin turns hard as stone.
 is cloaked in a shimmer of glowing symbols.
 feels much faster.
 looks brave.
's limbs move slower!
's wounds turn black.
 adheres to the ground.
 is stunned by scintillating colors.
's corpse clicks a few times then ceases struggling.
 resumes his patrol, his keyring jangling noisily at his side.
 is chilled by a bolt of frost.
's corpse rolls over letting out its last breath as it falls victim to its mortal wounds.
's corpse shudders and collapses.
's corpse lashes out at its attacker one last time.
's corpse slows its spinning until it eventually disappears entirely.
's corpse dissipates as it hits the ground.
's corpse falls to the ground as its wings give out.
's corpse hisses as it coils lifelessly to the ground.
's corpse stops moving.
"""
