"""Calculation rules as column expressions. Rolls are inputs, so results are the same on every run.

Every argument is a Column; a null input gives a null result unless said otherwise.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def half(c: Column) -> Column:
    """Half, rounded down (towards minus infinity)."""
    return F.floor(c / 2)


def modifier(score: Column) -> Column:
    """Ability modifier: floor((score - 10) / 2)."""
    return F.floor((score - 10) / 2)


def succeeds(roll: Column, bonus: Column, target: Column) -> Column:
    """A check succeeds if roll and bonus reach the target; ties succeed."""
    return roll + bonus >= target


def attack_result(roll: Column, bonus: Column, defense: Column) -> Column:
    """critical on a natural 20, miss on a natural 1, else hit or miss."""
    return F.when(roll == 20, "critical").when(roll == 1, "miss").when(roll + bonus >= defense, "hit").when(roll.isNotNull() & bonus.isNotNull() & defense.isNotNull(), "miss")


def margin_result(total: Column, dc: Column, step: int = 5) -> Column:
    """success, failure, or bad failure if the total misses by `step` or more."""
    return F.when(total >= dc, "success").when(total <= dc - step, "bad failure").when(total < dc, "failure")


def reflex(level: Column, armor: Column, dex: Column, size: Column, bonus: Column, natural: Column, mode: str = "plain") -> Column:
    """Reflex value. Armor replaces the level, even if lower; `override` takes the greater, `improved` also level + armor / 2. Null armor, bonus or natural armor counts as none."""
    forms = {
        "plain": F.coalesce(armor, level),
        "override": F.greatest(level, F.coalesce(armor, level)),
        "improved": F.greatest(level + half(F.coalesce(armor, F.lit(0))), F.coalesce(armor, level)),
    }
    return 10 + forms[mode] + dex + size + F.coalesce(bonus, F.lit(0)) + F.coalesce(natural, F.lit(0))


def fortitude(level: Column, con: Column, strength: Column, nonliving: Column) -> Column:
    """Fortitude value: what isn't alive uses strength."""
    return 10 + level + F.when(nonliving, strength).otherwise(con)


def dex_when_surprised(dex: Column, helpless: Column) -> Column:
    """A bonus is lost, a penalty stays; -5 if helpless."""
    return F.when(helpless, F.lit(-5)).otherwise(F.least(dex, F.lit(0)))


def damage(dice: Column, level: Column, extra: Column, factor: Column) -> Column:
    """Damage of a hit: at least 1."""
    return F.greatest(F.lit(1), (dice + half(level) + extra) * factor)


def area_damage(roll: Column, total: Column, defense: Column, full: Column) -> Column:
    """Area attacks must reach 10; a hit is full, a miss half damage."""
    return F.when(total < 10, F.lit(0)).when(total >= defense, full).otherwise(half(full))


def reduced(amount: Column, reductions: Column) -> Column:
    """Damage after the best of an array of reductions; null or empty arrays reduce nothing."""
    return F.greatest(F.lit(0), amount - F.coalesce(F.array_max(reductions), F.lit(0)))


def skill(level: Column, ability: Column, trained: Column, focused: Column) -> Column:
    """Skill bonus: half the level, the ability's modifier, 5 if trained and 5 if focused."""
    return half(level) + modifier(ability) + F.when(trained, 5).otherwise(0) + F.when(focused, 5).otherwise(0)


def threshold(fort: Column, size_bonus: Column) -> Column:
    """Damage threshold."""
    return fort + F.coalesce(size_bonus, F.lit(0))


def second_wind(max_hp: Column, con: Column) -> Column:
    """A quarter of the maximum, or the constitution score if greater."""
    return F.greatest(F.floor(max_hp / 4), con)


def force_points(level: Column) -> Column:
    """Points gained at a level."""
    return 5 + half(level)


def step_distance(dx: Column, dy: Column) -> Column:
    """Squares walked: a diagonal step costs 2."""
    return F.greatest(F.abs(dx), F.abs(dy)) + F.least(F.abs(dx), F.abs(dy))


def cone_distance(dx: Column, dy: Column) -> Column:
    """Squares in an area: diagonals cost 1 and 2 in turn."""
    return F.greatest(F.abs(dx), F.abs(dy)) + half(F.least(F.abs(dx), F.abs(dy)))


def ion(amount: Column, fort: Column) -> Column:
    """(half damage, whether the whole damage passed the threshold)."""
    return F.struct(half(amount).alias("taken"), (amount >= fort).alias("past"))


def free_actions(cha: Column, intelligence: Column) -> Column:
    """At least one."""
    return F.greatest(F.lit(1), 1 + F.greatest(cha, intelligence))


def surgery(total: Column, con: Column, level: Column, limit: Column) -> Column:
    """Hit points gained (negative: lost) by a surgery check against 20."""
    return F.when(total >= 20, F.greatest(F.lit(1), con) * level).otherwise(-limit)


def power_margin(own: Column, other: Column) -> Column:
    """win, draw, loss or devastating loss by the margin of two power checks."""
    m = own - other
    return F.when(m > 0, "win").when(m == 0, "draw").when(m <= -15, "devastating loss").when(m < 0, "loss")


def cover(obstacles: Column, aiming: Column) -> Column:
    """5 if anything is in between, however many things; none against an aiming attacker."""
    return F.when(aiming | (obstacles <= 0), 0).otherwise(5)


def experience(level: Column) -> Column:
    """Points needed for a level: level * (level - 1) / 2 * 1000."""
    return level * (level - 1) * 500


def best_of(rolls: Column, keep: int) -> Column:
    """Sum of the `keep` highest of an array of rolls; null if there are fewer."""
    top = F.slice(F.reverse(F.array_sort(rolls)), 1, keep)
    return F.when(F.size(rolls) >= keep, F.aggregate(top, F.lit(0).cast("bigint"), lambda s, x: s + x))


def encounter_level(cls: Column, literal: bool = True) -> Column:
    """Level of an encounter from an array of levels: their sum / 3, rounded down; in the literal reading at least the highest + 2."""
    third = F.floor(F.aggregate(cls, F.lit(0).cast("bigint"), lambda s, x: s + x) / 3)
    return F.greatest(third, F.array_max(cls) + 2) if literal else third


def will(level: Column, wisdom: Column, bonus: Column) -> Column:
    """Will value. A null class bonus counts as none."""
    return 10 + level + wisdom + F.coalesce(bonus, F.lit(0))


def vehicle_reflex(armor: Column, pilot_level: Column, dex: Column, size: Column) -> Column:
    """A vehicle's Reflex value: its armor, or its pilot's level where it has none."""
    return 10 + F.coalesce(armor, pilot_level) + dex + size


def vehicle_fortitude(strength: Column) -> Column:
    """A vehicle's Fortitude value."""
    return 10 + strength


def vehicle_initiative(initiative: Column, pilot: Column, trained: Column, size: Column, dex: Column) -> Column:
    """The pilot's initiative modifier (a trained one's pilot modifier), the vehicle's size and its dexterity modifier."""
    return F.when(trained, pilot).otherwise(initiative) + size + dex


def attack_bonus(kind: Column, base: Column, strength: Column, dex: Column, intelligence: Column, range_penalty: Column, pilot: Column) -> Column:
    """Bonus of a melee, ranged or vehicle attack; other kinds give null. Trained pilots have 2 more on a vehicle; a null penalty counts as none."""
    far = F.coalesce(range_penalty, F.lit(0))
    return F.when(kind == "melee", base + strength).when(kind == "ranged", base + dex + far).when(kind == "vehicle", base + intelligence + far + F.when(pilot, 2).otherwise(0))


def damage_by_kind(kind: Column, dice: Column, level: Column, strength: Column, two_handed: Column, extra: Column, factor: Column) -> Column:
    """Damage of a hit, at least 1: strength counts in melee (twice with two hands, if it is a bonus), extra and factor on vehicles; other kinds give null."""
    arm = F.when(two_handed & (strength > 0), strength * 2).otherwise(strength)
    base = dice + half(level)
    return F.greatest(F.lit(1), F.when(kind == "melee", base + arm).when(kind == "ranged", base).when(kind == "vehicle", (base + extra) * factor)) + F.when(kind.isin("melee", "ranged", "vehicle"), 0)


def circumstance(favourable: Column, unfavourable: Column) -> Column:
    """2 for each favourable circumstance, -2 for each unfavourable one."""
    return 2 * favourable - 2 * unfavourable


def take_twenty_time(minutes: Column) -> Column:
    """Taking 20 takes twenty times as long."""
    return minutes * 20


def party_adjusted(level: Column, heroes: Column) -> Column:
    """An encounter's level for a party: one less for each hero above four, one more for each missing."""
    return level - (heroes - 4)


def too_low(scores: Column) -> Column:
    """Whether a set of scores may be rolled again: modifiers of 0 or less in total, or none above 13. Null for an empty set."""
    total = F.aggregate(scores, F.lit(0).cast("bigint"), lambda s, x: s + modifier(x))
    return F.when(F.size(scores) > 0, (total <= 0) | (F.array_max(scores) <= 13))
