"""Queries over the calculation rules, with rolls and scores taken from the events' numbers."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.functions import rules as B
from quernstone.functions import values as V
from quernstone.functions.lookups import lookup, values_sql
from quernstone.operators import folds, markdown
from quernstone.operators.bands import band_join
from quernstone.plans.registry import Registry
from quernstone.sources.tables import table as T

R = Registry()
query = R.query
# Inputs of the rules: a roll, two scores, a level and an amount for each event.
_IN = "(SELECT event_id AS id, user_id, ts, event_type, event_id % 20 + 1 AS roll, (event_id * 7) % 24 + 3 AS s1, (event_id * 11) % 24 + 3 AS s2, (event_id * 13) % 20 + 1 AS lvl, (event_id * 17) % 60 AS amount FROM events)"


def cases(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return T(spark, d, "events").select(
        e.alias("id"), "user_id", "ts", "event_type", (e % 20 + 1).alias("roll"), (e * 7 % 24 + 3).alias("s1"), (e * 11 % 24 + 3).alias("s2"), (e * 13 % 20 + 1).alias("lvl"), (e * 17 % 60).alias("amount")
    )


def _mod(x: str) -> str:
    return f"CAST(floor(({x} - 10) / 2.0) AS BIGINT)"


C = F.col


@query(
    "r01_checks",
    f"""SELECT id, roll + {_mod('s1')} >= s2 AS ok, CASE WHEN roll = 20 THEN 'critical' WHEN roll = 1 THEN 'miss' WHEN roll + {_mod('s1')} >= s2 THEN 'hit' ELSE 'miss' END AS attack,
    CASE WHEN roll >= s2 THEN 'success' WHEN roll <= s2 - 5 THEN 'bad failure' ELSE 'failure' END AS margin, 10 + {_mod('s1')} >= s2 AS take_ten, 20 + {_mod('s1')} >= s2 AS take_twenty,
    CAST(floor(lvl / 2.0) AS BIGINT) + {_mod('s1')} + CASE WHEN s2 > 15 THEN 5 ELSE 0 END + CASE WHEN s2 > 20 THEN 5 ELSE 0 END AS skill FROM {_IN}""",
)
def r01(spark: SparkSession, d: str) -> DataFrame:
    m = B.modifier(C("s1"))
    return cases(spark, d).select(
        "id", B.succeeds(C("roll"), m, C("s2")).alias("ok"), B.attack_result(C("roll"), m, C("s2")).alias("attack"), B.margin_result(C("roll"), C("s2")).alias("margin"),
        B.succeeds(F.lit(10), m, C("s2")).alias("take_ten"), B.succeeds(F.lit(20), m, C("s2")).alias("take_twenty"), B.skill(C("lvl"), C("s1"), C("s2") > 15, C("s2") > 20).alias("skill"),
    )


@query(
    "r02_defenses",
    f"""SELECT id, 10 + coalesce(armor, lvl) + {_mod('s1')} AS plain, 10 + greatest(lvl, coalesce(armor, lvl)) + {_mod('s1')} + 1 AS overridden,
    10 + greatest(lvl + CAST(floor(coalesce(armor, 0) / 2.0) AS BIGINT), coalesce(armor, lvl)) + {_mod('s1')} + 2 AS improved, 10 + lvl + CASE WHEN s2 > 20 THEN {_mod('s2')} ELSE {_mod('s1')} END AS fort,
    CASE WHEN s2 > 24 THEN -5 ELSE least({_mod('s1')}, 0) END AS surprised FROM (SELECT *, CASE WHEN s2 % 3 > 0 THEN s2 % 11 END AS armor FROM {_IN})""",
)
def r02(spark: SparkSession, d: str) -> DataFrame:
    m, none, armor = B.modifier(C("s1")), F.lit(None).cast("int"), F.when(C("s2") % 3 > 0, C("s2") % 11)
    form = lambda mode, bonus, natural: B.reflex(C("lvl"), armor, m, F.lit(0), bonus, natural, mode)
    return cases(spark, d).select(
        "id", form("plain", none, none).alias("plain"), form("override", F.lit(1), none).alias("overridden"), form("improved", F.lit(1), F.lit(1)).alias("improved"),
        B.fortitude(C("lvl"), m, B.modifier(C("s2")), C("s2") > 20).alias("fort"), B.dex_when_surprised(m, C("s2") > 24).alias("surprised"),
    )


@query(
    "r03_damage",
    """SELECT id, greatest(1, (amount - 30 + lvl // 2 + 1) * 2) AS dealt, CASE WHEN roll + lvl < 10 THEN 0 WHEN roll + lvl >= s2 THEN amount ELSE amount // 2 END AS area, greatest(0, amount - greatest(s1, s2)) AS reduced, amount // 2 AS ion_taken, amount >= s2 AS ion_past,
    CASE WHEN roll % 2 = 0 OR s1 % 3 <= 0 THEN 0 ELSE 5 END AS cover, CASE WHEN s1 - s2 > 0 THEN 'win' WHEN s1 = s2 THEN 'draw' WHEN s1 - s2 <= -15 THEN 'devastating loss' ELSE 'loss' END AS battle FROM """ + _IN,
)
def r03(spark: SparkSession, d: str) -> DataFrame:
    ion = B.ion(C("amount"), C("s2"))
    return cases(spark, d).select(
        "id", B.damage(C("amount") - 30, C("lvl"), F.lit(1), F.lit(2)).alias("dealt"), B.area_damage(C("roll"), C("roll") + C("lvl"), C("s2"), C("amount")).alias("area"), B.reduced(C("amount"), F.array("s1", "s2")).alias("reduced"),
        ion["taken"].alias("ion_taken"), ion["past"].alias("ion_past"), B.cover(C("s1") % 3, C("roll") % 2 == 0).alias("cover"), B.power_margin(C("s1"), C("s2")).alias("battle"),
    )


@query(
    "r04_scores",
    f"""SELECT id, {_mod('s1')} AS modifier, greatest(amount // 4, s1) AS wind, greatest({_mod('s1')}, {_mod('s2')}) AS grapple, 5 + lvl // 2 AS points, greatest(s1, s2) + least(s1, s2) AS walked, greatest(s1, s2) + least(s1, s2) // 2 AS cone,
    greatest(1, 1 + greatest({_mod('s1')}, {_mod('s2')})) AS free_actions, CASE WHEN roll + 5 >= 20 THEN greatest(1, {_mod('s1')}) * lvl ELSE -s2 END AS surgery, lvl * (lvl - 1) * 500 AS xp, s1 >= s2 AS dark, CASE WHEN roll >= 10 THEN 2 ELSE 0 END AS aid, (roll % 6 + 1) * s1 AS travel FROM {_IN}""",
)
def r04(spark: SparkSession, d: str) -> DataFrame:
    m1, m2 = B.modifier(C("s1")), B.modifier(C("s2"))
    return cases(spark, d).select(
        "id", m1.alias("modifier"), B.second_wind(C("amount"), C("s1")).alias("wind"), F.greatest(m1, m2).alias("grapple"), B.force_points(C("lvl")).alias("points"), B.step_distance(C("s1"), C("s2")).alias("walked"), B.cone_distance(C("s1"), C("s2")).alias("cone"),
        B.free_actions(m1, m2).alias("free_actions"), B.surgery(C("roll") + 5, m1, C("lvl"), C("s2")).alias("surgery"), B.experience(C("lvl")).alias("xp"), (C("s1") >= C("s2")).alias("dark"), F.when(C("roll") >= 10, 2).otherwise(0).alias("aid"), ((C("roll") % 6 + 1) * C("s1")).alias("travel"),
    )


@query(
    "r05_vehicles_and_will",
    f"""SELECT id, 10 + lvl + {_mod('s1')} + CASE WHEN roll > 10 THEN 1 ELSE 0 END AS will, 10 + coalesce(armor, lvl) + {_mod('s2')} + defense AS vehicle_reflex, 10 + {_mod('s1')} AS vehicle_fort,
    CASE WHEN roll % 2 = 0 THEN s2 ELSE {_mod('s2')} END + defense + {_mod('s1')} AS vehicle_init, 10 + {_mod('s1')} + threshold AS threshold
    FROM (SELECT *, CASE WHEN s2 % 3 > 0 THEN s2 % 11 END AS armor, amount % 12 AS k FROM {_IN}) JOIN (SELECT *, row_number() OVER () - 1 AS k FROM {values_sql('SIZES')}) USING (k)""",
)
def r05(spark: SparkSession, d: str) -> DataFrame:
    """Will, the vehicle forms of the defenses and of initiative, and the threshold by size, kinds of Colossal included."""
    from quernstone.functions.lookups import SIZES

    sizes = spark.createDataFrame([(k, s[1], s[3]) for k, s in enumerate(SIZES)], "k bigint, defense int, bonus int")
    m1, m2, none = B.modifier(C("s1")), B.modifier(C("s2")), F.lit(None).cast("int")
    armor, fort = F.when(C("s2") % 3 > 0, C("s2") % 11), B.vehicle_fortitude(m1)
    c = cases(spark, d).withColumn("k", C("amount") % 12).join(F.broadcast(sizes), "k")
    return c.select(
        "id", B.will(C("lvl"), m1, F.when(C("roll") > 10, 1).otherwise(none)).alias("will"), B.vehicle_reflex(armor, C("lvl"), m2, C("defense")).alias("vehicle_reflex"), fort.alias("vehicle_fort"),
        B.vehicle_initiative(m2, C("s2"), C("roll") % 2 == 0, C("defense"), m1).alias("vehicle_init"), B.threshold(fort, C("bonus")).alias("threshold"),
    )


@query(
    "r06_attacks_by_kind",
    f"""SELECT id, kind, CASE kind WHEN 'melee' THEN lvl + {_mod('s1')} WHEN 'ranged' THEN lvl + {_mod('s2')} + penalty ELSE lvl + {_mod('amount')} + penalty + CASE WHEN roll > 10 THEN 2 ELSE 0 END END AS bonus,
    greatest(1, CASE kind WHEN 'melee' THEN amount - 20 + lvl // 2 + CASE WHEN roll % 2 = 0 AND {_mod('s1')} > 0 THEN 2 ELSE 1 END * {_mod('s1')} WHEN 'ranged' THEN amount - 20 + lvl // 2 ELSE (amount - 20 + lvl // 2 + 3) * 2 END) AS dealt,
    roll + {_mod('s1')} + 2 * (s1 % 3) - 2 * (s2 % 3) >= 15 AS circumstance_ok, roll * 20 AS minutes
    FROM (SELECT *, ['melee', 'ranged', 'vehicle'][CAST(id % 3 AS INTEGER) + 1] AS kind, [0, -2, -5, -10][CAST(s2 % 4 AS INTEGER) + 1] AS penalty FROM {_IN})""",
)
def r06(spark: SparkSession, d: str) -> DataFrame:
    """Bonus and damage of melee, ranged and vehicle attacks, circumstances on a check, and the time that taking 20 takes."""
    from quernstone.functions.lookups import RANGES

    kind = F.get(F.array(*map(F.lit, ("melee", "ranged", "vehicle"))), (C("id") % 3).cast("int"))
    penalty = F.get(F.array(*[F.lit(p) for _, p in RANGES]), (C("s2") % 4).cast("int"))
    m1, m2, m3 = (B.modifier(C(x)) for x in ("s1", "s2", "amount"))
    c = cases(spark, d).withColumn("kind", kind)
    return c.select(
        "id", "kind", B.attack_bonus(C("kind"), C("lvl"), m1, m2, m3, penalty, C("roll") > 10).alias("bonus"), B.damage_by_kind(C("kind"), C("amount") - 20, C("lvl"), m1, C("roll") % 2 == 0, F.lit(3), F.lit(2)).alias("dealt"),
        B.succeeds(C("roll"), m1 + B.circumstance(C("s1") % 3, C("s2") % 3), F.lit(15)).alias("circumstance_ok"), B.take_twenty_time(C("roll")).alias("minutes"),
    )


@query(
    "r07_area_targets",
    f"""SELECT a.id, t.id AS target, CASE WHEN a.roll + a.lvl < 10 THEN 0 WHEN a.roll + a.lvl >= t.s2 THEN a.amount ELSE a.amount // 2 END AS dealt
    FROM (SELECT * FROM {_IN} WHERE event_type = 'purchase') a JOIN (SELECT * FROM {_IN} WHERE event_type = 'click') t ON a.user_id = t.user_id AND t.lvl BETWEEN a.lvl - 1 AND a.lvl + 1""",
)
def r07(spark: SparkSession, d: str) -> DataFrame:
    """An area attack fans out to all targets in its area: an overlap join of areas and places on one field, then the damage rule a target."""
    from quernstone.operators.intervals import overlap_join

    c = cases(spark, d)
    a = c.where("event_type = 'purchase'").select("id", "user_id", "roll", "lvl", "amount", (C("lvl") - 1).alias("s"), (C("lvl") + 2).alias("e"))
    t = c.where("event_type = 'click'").select(C("id").alias("target"), C("user_id").alias("u"), C("s2").alias("reflex"), C("lvl").alias("ts"), (C("lvl") + 1).alias("te"))
    hit = overlap_join(a, t, ("s", "e"), ("ts", "te"), 4, [("user_id", "u")])
    return hit.select("id", "target", B.area_damage(C("roll"), C("roll") + C("lvl"), C("reflex"), C("amount")).alias("dealt"))


@query(
    "r08_aid_another",
    f"""SELECT a.id, a.roll + {_mod('a.s1')} + coalesce(h.bonus, 0) AS total FROM {_IN} a LEFT JOIN (SELECT user_id, lvl, 2 * count(*) FILTER (WHERE roll + {_mod('s2')} >= 10) AS bonus FROM {_IN} WHERE event_type = 'view' GROUP BY ALL) h
    ON a.user_id = h.user_id AND a.lvl = h.lvl WHERE a.event_type = 'click'""",
)
def r08(spark: SparkSession, d: str) -> DataFrame:
    """Helpers that reach 10 add 2 each to those they help: counted by target before the join."""
    c = cases(spark, d)
    h = c.where("event_type = 'view'").groupBy("user_id", "lvl").agg((2 * F.count_if(C("roll") + B.modifier(C("s2")) >= 10)).alias("bonus"))
    return c.where("event_type = 'click'").join(h, ["user_id", "lvl"], "left").select("id", (C("roll") + B.modifier(C("s1")) + F.coalesce("bonus", F.lit(0))).alias("total"))


_CHAIN = f"""WITH shots AS (SELECT id, user_id, roll, lvl, amount, s1, s2, (id * 31) % 220 AS dist, ['Rifles', 'Pistols', 'Thrown Charges', 'Heavy Weapons', 'Clubs'][CAST(id % 5 AS INTEGER) + 1] AS g FROM {_IN}),
    ranged AS (SELECT s.*, b.penalty FROM shots s LEFT JOIN range_band b ON g = weapon_group AND dist BETWEEN lo AND hi),
    hits AS (SELECT *, CASE WHEN g = 'Clubs' THEN lvl + {_mod('s1')} ELSE lvl + {_mod('s2')} + coalesce(penalty, 0) END AS bonus, 12 + s1 % 11 AS reflex FROM ranged),
    dealt AS (SELECT *, CASE WHEN roll = 20 THEN 2 WHEN roll = 1 THEN 0 WHEN roll + bonus >= reflex THEN 1 ELSE 0 END * greatest(0, greatest(1, amount // 2 + lvl // 2 + CASE WHEN g = 'Clubs' THEN {_mod('s1')} ELSE 0 END) - s2 % 6) AS damage FROM hits)"""


@query(
    "r09_attack_chain",
    _CHAIN + """ SELECT user_id, count(*) FILTER (WHERE damage > 0) AS hits, CAST(sum(damage) AS BIGINT) AS damage, count(*) FILTER (WHERE damage >= 20 + s1 % 5) AS past_threshold,
    least(5, count(*) FILTER (WHERE damage >= 20 + s1 % 5)) AS step, [0, -1, -2, -5, -10, 0][CAST(least(5, count(*) FILTER (WHERE damage >= 20 + s1 % 5)) AS INTEGER) + 1] AS penalty, least(5, count(*) FILTER (WHERE damage >= 20 + s1 % 5)) = 5 AS helpless FROM dealt GROUP BY user_id""",
)
def r09(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain: range penalty by weapon group, attack by kind against the defense, natural 20 and 1, damage by kind less its reduction, the threshold, and each step past it down the condition track."""
    groups = ["Rifles", "Pistols", "Thrown Charges", "Heavy Weapons", "Clubs"]
    shots = cases(spark, d).withColumn("dist", C("id") * 31 % 220).withColumn("g", F.get(F.array(*map(F.lit, groups)), (C("id") % 5).cast("int")))
    r = band_join(shots, T(spark, d, "range_band"), "dist", "lo", "hi", 50, [("g", "weapon_group")], how="left")
    kind, m1, none = F.when(C("g") == "Clubs", "melee").otherwise("ranged"), B.modifier(C("s1")), F.lit(0)
    bonus = B.attack_bonus(kind, C("lvl"), m1, B.modifier(C("s2")), none, C("penalty"), F.lit(False))
    result = B.attack_result(C("roll"), bonus, 12 + C("s1") % 11)
    factor = F.when(result == "critical", 2).when(result == "hit", 1).otherwise(0)
    dealt = factor * B.reduced(B.damage_by_kind(kind, F.floor(C("amount") / 2), C("lvl"), m1, F.lit(False), none, F.lit(1)), F.array(C("s2") % 6))
    hit = r.select("id", "user_id", dealt.alias("damage"), B.threshold(F.lit(20), C("s1") % 5).alias("limit"))
    per = hit.groupBy("user_id").agg(F.count_if(C("damage") > 0).alias("hits"), F.sum("damage").alias("damage"), F.count_if(C("damage") >= C("limit")).alias("past_threshold"))
    return per.withColumn("step", F.least(F.lit(5), "past_threshold")).join(F.broadcast(lookup(spark, "CONDITIONS")), "step").select("user_id", "hits", "damage", "past_threshold", "step", "penalty", "helpless")


@query(
    "r10_templates",
    """SELECT w.name, t.template, CASE WHEN t.template = 'woven' THEN 'Rare' ELSE w.availability END AS availability, coalesce(t.damage_type, w.damage_type) AS damage_type FROM weapon w
    JOIN (SELECT template, damage_type, trim(unnest(string_split(applies, ';'))) AS grp FROM (VALUES ('swift', NULL, 'Rifles; Pistols'), ('woven', 'Slashing', 'Pistols;Clubs ; Heavy Weapons')) v(template, damage_type, applies)) t ON w.weapon_group = t.grp""",
)
def r10(spark: SparkSession, d: str) -> DataFrame:
    """Templates laid over the items of the groups they apply to: a list is split and joined, and what a template leaves open stays as the item has it."""
    t = spark.createDataFrame([("swift", None, None, "Rifles; Pistols"), ("woven", "Rare", "Slashing", "Pistols;Clubs ; Heavy Weapons")], "template string, rarity string, kind string, applies string")
    t = t.select("template", "rarity", "kind", F.explode(V.items(C("applies"))).alias("weapon_group"))
    return T(spark, d, "weapon").join(F.broadcast(t), "weapon_group").select("name", "template", F.coalesce("rarity", "availability").alias("availability"), F.coalesce("kind", "damage_type").alias("damage_type"))


def _ranged(name: str, table: str, value_sql: str, column: str):
    lo_hi = f"SELECT id, {column} FROM (SELECT id, {value_sql} AS v FROM {_IN}) JOIN {values_sql(table)} ON v >= lo AND (hi IS NULL OR v <= hi)"

    @query(name, lo_hi)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return band_join(cases(spark, d).select("id", F.expr(value_sql).alias("v")), lookup(spark, table), "v", "lo", "hi", 4).select("id", column)

    return run


_ranged("l05_dice_pool", "POOLS", "lvl", "dice")
_ranged("l06_rank", "RANKS", "amount", "bonus")
_ranged("l10_speed", "SPEEDS", "s1", "squares")
_ranged("l12_age_of_data", "AGES", "amount * 7", "dc")


@query("l01_size_modifier", f"SELECT name, w.size, defense, grapple, threshold FROM weapon w JOIN {values_sql('SIZES')} z ON w.size = z.size")
def l01(spark: SparkSession, d: str) -> DataFrame:
    z = lookup(spark, "SIZES")
    return T(spark, d, "weapon").join(F.broadcast(z), "size").select("name", "size", "defense", "grapple", "threshold")


@query(
    "l03_difficulty",
    f"SELECT id, difficulty, dc FROM (SELECT id, lvl FROM {_IN}) JOIN (SELECT lo, hi, difficulty, dc FROM {values_sql('DIFFICULTY')} UNPIVOT (dc FOR difficulty IN (easy, medium, moderate, hard, heroic))) ON lvl BETWEEN lo AND hi",
)
def l03(spark: SparkSession, d: str) -> DataFrame:
    t = lookup(spark, "DIFFICULTY").unpivot(["lo", "hi"], ["easy", "medium", "moderate", "hard", "heroic"], "difficulty", "dc")
    return band_join(cases(spark, d).select("id", "lvl"), t, "lvl", "lo", "hi", 4).select("id", "difficulty", "dc")


@query("l04_best_tier", f"SELECT id, max_by(size, least) AS size FROM (SELECT id, roll + lvl AS v FROM {_IN}) LEFT JOIN {values_sql('TIERS')} ON least <= v GROUP BY id")
def l04(spark: SparkSession, d: str) -> DataFrame:
    """The highest tier not above the result: tiers become closed ranges, so the as-of join is a band join."""
    w = W.orderBy("least")
    t = lookup(spark, "TIERS").withColumn("hi", F.lead("least").over(w) - 1).withColumnRenamed("least", "lo")  # a fixed table of five rows
    return band_join(cases(spark, d).select("id", (C("roll") + C("lvl")).alias("v")), t, "v", "lo", "hi", 5, how="left").select("id", "size")


# A table whose column names stand in its first body row, and a folded one, as pages have them.
_MERGED = """| CLASS | BASE ATTACK BONUS BY CLASS LEVEL | | | | | | | | | | | | | | | | | | | |
| --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- | --- |
| 1 | 2 | 3 | 4 | 5 | 6 | 7 | 8 | 9 | 10 | 11 | 12 | 13 | 14 | 15 | 16 | 17 | 18 | 19 | 20 |
| Jedi/Soldier | +1 | +2 | +3 | +4 | +5 | +6 | +7 | +8 | +9 | +10 | +11 | +12 | +13 | +14 | +15 | +16 | +17 | +18 | +19 | +20 |
| Noble/Scoundrel/Scout | +0 | +1 | +2 | +3 | +3 | +4 | +5 | +6 | +6 | +7 | +8 | +9 | +9 | +10 | +11 | +12 | +12 | +13 | +14 | +15 |"""
_FOLDED = """| Level | EXPERIENCE POINTS | Defense Bonus | Skill/Damage Bonus |  | Level | EXPERIENCE POINTS | Defense Bonus | Skill/Damage Bonus |
| --- | --- | --- | --- | --- | --- | --- | --- | --- |
| 1st | 0 | +1 | +0 | 11th | 55,000 | +11 | +5 |
| 2nd | 1,000 | +2 | +1 | 12th | 66,000 | +12 | +6 |
| 3rd | 3,000 | +3 | +1 | 13th | 78,000 | +13 | +6 |
| 4th | 6,000 | +4 | +2 | 14th | 91,000 | +14 | +7 |
| 5th | 10,000 | +5 | +2 | 15th | 105,000 | +15 | +7 |
| 6th | 15,000 | +6 | +3 | 16th | 120,000 | +16 | +8 |
| 7th | 21,000 | +7 | +3 | 17th | 136,000 | +17 | +8 |
| 8th | 28,000 | +8 | +4 | 18th | 153,000 | +18 | +9 |
| 9th | 36,000 | +9 | +4 | 19th | 171,000 | +19 | +9 |
| 10th | 45,000 | +10 | +5 | 20th | 190,000 | +20 | +10 |"""


def _page_rows(spark: SparkSession, text: str) -> DataFrame:
    return markdown.table_rows(spark.createDataFrame([(1, text)], "id int, body string"), "id", "body").where("NOT rule")


@query("l07_attack_bonus", f"SELECT id, CAST(CASE WHEN s1 % 2 = 0 THEN lvl ELSE lvl * 3 // 4 END AS INTEGER) AS bonus FROM {_IN}")
def l07(spark: SparkSession, d: str) -> DataFrame:
    """A class-by-level matrix with its real column names in the first body row, parsed to rows (class, level, bonus) and joined on class and level."""
    t = markdown.merged_header(_page_rows(spark, _MERGED)).select(F.explode(F.split("name", "/")).alias("class"), C("col_name").cast("int").alias("level"), V.number(C("value")).alias("bonus"))
    c = cases(spark, d).select("id", "lvl", F.when(C("s1") % 2 == 0, "Soldier").otherwise("Scout").alias("class"))
    return c.join(F.broadcast(t), (c["class"] == t["class"]) & (C("lvl") == C("level"))).select("id", "bonus")


@query(
    "l08_level_of_points",
    f"""SELECT id, CAST(max(lvl2) AS INTEGER) AS level, CAST(max(lvl2) AS INTEGER) AS defense, CAST(max(lvl2) // 2 AS INTEGER) AS skill
    FROM (SELECT id, amount * 3000 AS xp FROM {_IN}) JOIN (SELECT range + 1 AS lvl2, (range + 1) * range * 500 AS need FROM range(20)) ON need <= xp GROUP BY id""",
)
def l08(spark: SparkSession, d: str) -> DataFrame:
    """A folded table (two groups of columns side by side), unfolded from its text, then used for an as-of lookup."""
    rows = _page_rows(spark, _FOLDED).where(C("cells")[0] != "Level").select("cells")
    t = markdown.unfold(rows, "cells", 4, ["level", "need", "defense", "skill"])
    t = t.select(F.regexp_extract("level", r"\d+", 0).cast("int").alias("level"), V.number(C("need")).alias("lo"), V.number(C("defense")).alias("defense"), V.number(C("skill")).alias("skill"))
    t = t.withColumn("hi", F.lead("lo").over(W.orderBy("lo")) - 1)
    return band_join(cases(spark, d).select("id", (C("amount") * 3000).alias("xp")), t, "xp", "lo", "hi", 10000).select("id", "level", "defense", "skill")


@query("l11_attitude", f"SELECT id, attitude, try_cast(text AS INTEGER) AS modifier FROM (SELECT id, s1 % 5 AS k FROM {_IN}) JOIN (SELECT *, row_number() OVER () - 1 AS k FROM {values_sql('ATTITUDES')}) USING (k)")
def l11(spark: SparkSession, d: str) -> DataFrame:
    t = lookup(spark, "ATTITUDES")
    rows = [(i, a, x) for i, (a, x) in enumerate(map(tuple, t.collect()))]  # five rows
    keyed = spark.createDataFrame(rows, "k bigint, attitude string, text string")
    return cases(spark, d).select("id", (C("s1") % 5).alias("k")).join(F.broadcast(keyed), "k").select("id", "attitude", V.number(C("text")).alias("modifier"))


# The rows of the source's table, written out once more: the SQL must not repeat an error of the code's table.
_DAMAGE_SQL = "(VALUES (1, 10, 'No system damage'), (11, 15, 'Starship becomes Used'), (16, 16, 'Communications/sensors destroyed'), (17, 17, 'Weapons destroyed'), (18, 18, 'Hyperdrive destroyed'), (19, 19, 'Sublight Drive destroyed'), (20, 20, 'Life support destroyed')) o(lo, hi, outcome)"


@query(
    "l09_outcome",
    f"""WITH r AS (SELECT id, roll, s1 % 20 + 1 AS second, s2 % 20 + 1 AS third, lvl % 2 = 0 AS used FROM {_IN}), t AS (SELECT id, unnest(CASE WHEN used AND roll BETWEEN 11 AND 15 THEN [second, third] ELSE [roll] END) AS v FROM r)
    SELECT id, outcome FROM t JOIN {_DAMAGE_SQL} ON v BETWEEN lo AND hi""",
)
def l09(spark: SparkSession, d: str) -> DataFrame:
    """Damage to a system; where the result isn't applicable (what is worn can't become more so), two more rolls count, both of them."""
    c = cases(spark, d).withColumn("used", C("lvl") % 2 == 0)
    v = F.when(C("used") & C("roll").between(11, 15), F.array(C("s1") % 20 + 1, C("s2") % 20 + 1)).otherwise(F.array("roll"))
    return band_join(c.select("id", F.explode(v).alias("v")), lookup(spark, "OUTCOMES"), "v", "lo", "hi", 5).select("id", "outcome")


@query(
    "l13_two_level_table",
    """WITH throws AS (SELECT id, unnest(CASE WHEN roll < 20 THEN [{'a': roll, 'b': s1 % 20 + 1}] ELSE [{'a': s1 % 20 + 1, 'b': s2 % 20 + 1}, {'a': lvl, 'b': amount % 20 + 1}] END) AS t FROM """ + _IN + """)
    SELECT id, severity, lo FROM (SELECT id, t.a, t.b FROM throws) JOIN (VALUES ('MINOR', 1, 8, 1, 8), ('MINOR', 1, 8, 9, 14), ('MINOR', 1, 8, 15, 18), ('MINOR', 1, 8, 19, 20), ('MODERATE', 9, 14, 1, 8), ('MODERATE', 9, 14, 9, 14), ('MODERATE', 9, 14, 15, 18),
    ('MODERATE', 9, 14, 19, 20), ('MAJOR', 15, 19, 1, 6), ('MAJOR', 15, 19, 7, 10), ('MAJOR', 15, 19, 11, 13), ('MAJOR', 15, 19, 14, 15), ('MAJOR', 15, 19, 16, 17), ('MAJOR', 15, 19, 18, 19), ('MAJOR', 15, 19, 20, 20)) h(severity, slo, shi, lo, hi)
    ON a BETWEEN slo AND shi AND b BETWEEN lo AND hi""",
)
def l13(spark: SparkSession, d: str) -> DataFrame:
    """Parent cells stand on their own rows: they are carried down, then two rolls choose severity and mishap. A 20 is rolled again twice; a second 20 gives nothing."""
    w = W.orderBy("pos").rowsBetween(W.unboundedPreceding, 0)  # a fixed table of eighteen rows
    t = lookup(spark, "HAZARDS").select(F.last("severity_range", True).over(w).alias("sr"), F.last("severity", True).over(w).alias("severity"), "roll_range").where("roll_range IS NOT NULL")
    t = t.select("severity", V.bounds(C("sr")).alias("s"), V.bounds(C("roll_range")).alias("r")).select("severity", C("s.lo").alias("slo"), C("s.hi").alias("shi"), C("r.lo").alias("lo"), C("r.hi").alias("hi"))
    throw = lambda a, b: F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    again = F.array(throw(C("s1") % 20 + 1, C("s2") % 20 + 1), throw(C("lvl"), C("amount") % 20 + 1))
    c = cases(spark, d).select("id", F.explode(F.when(C("roll") < 20, F.array(throw(C("roll"), C("s1") % 20 + 1))).otherwise(again)).alias("t")).select("id", "t.a", "t.b")
    return band_join(c, t, "a", "slo", "shi", 5).where("b BETWEEN lo AND hi").select("id", "severity", "lo")


@query(
    "l14_rerolled_table",
    f"""SELECT id, system, planets FROM (SELECT id, s1 % 20 + 1 AS a, CASE WHEN roll <> 20 THEN roll WHEN s2 % 20 + 1 <> 20 THEN s2 % 20 + 1 WHEN lvl <> 20 THEN lvl END AS b FROM {_IN})
    JOIN {values_sql('SYSTEMS')} s ON a BETWEEN s.lo AND s.hi LEFT JOIN {values_sql('PLANETS')} p ON b BETWEEN p.lo AND p.hi""",
)
def l14(spark: SparkSession, d: str) -> DataFrame:
    """Independent tables, one join a roll. In one of them an outcome (20) is rolled again: the first of a bounded list of rolls that isn't it counts; none left gives null."""
    rolls = F.array("roll", C("s2") % 20 + 1, "lvl")
    c = cases(spark, d).select("id", (C("s1") % 20 + 1).alias("a"), F.get(F.filter(rolls, lambda x: x != 20), 0).alias("b"))
    c = band_join(c, lookup(spark, "SYSTEMS"), "a", "lo", "hi", 5).select("id", "b", "system")
    return band_join(c, lookup(spark, "PLANETS"), "b", "lo", "hi", 5, how="left").select("id", "system", "planets")


@query("l15_information", f"SELECT id, kind, dc, minutes FROM (SELECT id, roll + lvl AS v FROM {_IN}) JOIN {values_sql('INFORMATION')} ON dc <= v")
def l15(spark: SparkSession, d: str) -> DataFrame:
    t = lookup(spark, "INFORMATION").withColumn("hi", F.lit(None).cast("int"))
    return band_join(cases(spark, d).select("id", (C("roll") + C("lvl")).alias("v")), t, "v", "dc", "hi", 10).select("id", "kind", "dc", "minutes")


@query("l16_size_limit", "SELECT w.name, coalesce(z.k <= 5, true) AS fits FROM weapon w LEFT JOIN (SELECT *, row_number() OVER () - 1 AS k FROM " + values_sql("SIZES") + ") z ON w.size = z.size")
def l16(spark: SparkSession, d: str) -> DataFrame:
    """An ordinal comparison of an enumeration; a blank size is unrestricted."""
    from quernstone.functions.lookups import SIZES

    z = spark.createDataFrame([(s[0], k) for k, s in enumerate(SIZES)], "size string, k int")
    return T(spark, d, "weapon").join(F.broadcast(z), "size", "left").select("name", F.coalesce(C("k") <= 5, F.lit(True)).alias("fits"))


@query("g01_sum_by_owner", f"SELECT user_id, CAST(sum(CASE WHEN s1 % 2 = 0 THEN lvl ELSE lvl * 3 // 4 END) AS BIGINT) AS bab, CAST(sum(lvl) FILTER (WHERE event_type <> 'view') AS BIGINT) AS heroic FROM {_IN} GROUP BY user_id")
def g01(spark: SparkSession, d: str) -> DataFrame:
    bab = F.when(C("s1") % 2 == 0, C("lvl")).otherwise(F.floor(C("lvl") * 3 / 4))
    return cases(spark, d).groupBy("user_id").agg(F.sum(bab).alias("bab"), F.sum(F.when(C("event_type") != "view", C("lvl"))).alias("heroic"))


_XP = "CAST(sum(CASE WHEN lvl <= 6 THEN lvl * 20 ELSE lvl * 200 END) AS BIGINT)"


@query(
    "g03_encounters",
    f"""SELECT user_id, q AS quotient, greatest(q, m + 2) AS literal, greatest(q, m + 2) - (heroes - 4) AS for_party, xp, xp // heroes AS each FROM (
    SELECT user_id, CAST(floor(sum(lvl) / 3.0) AS BIGINT) AS q, max(lvl) AS m, {_XP} AS xp, user_id % 4 + 3 AS heroes FROM {_IN} GROUP BY user_id)""",
)
def g03(spark: SparkSession, d: str) -> DataFrame:
    """Both readings of the encounter rule, with and without the highest level + 2, adjusted to a party's size; points of foes, a tenth for those five levels below heroes of level 11, split by the party."""
    weak = C("lvl") <= 11 - 5
    g = cases(spark, d).groupBy("user_id").agg(F.sum("lvl").alias("s"), F.max("lvl").alias("m"), F.sum(F.when(weak, C("lvl") * 20).otherwise(C("lvl") * 200)).alias("xp"))
    q, heroes = F.floor(C("s") / 3), C("user_id") % 4 + 3
    literal = F.greatest(q, C("m") + 2)
    return g.select("user_id", q.alias("quotient"), literal.alias("literal"), B.party_adjusted(literal, heroes).alias("for_party"), "xp", F.floor(C("xp") / heroes).alias("each"))


@query("g05_weighted_criteria", f"SELECT user_id, CAST(sum(CASE WHEN roll >= 15 THEN 3 WHEN roll >= 10 THEN 1 ELSE 0 END) - 2 * count(*) FILTER (WHERE roll = 1) AS BIGINT) AS score FROM {_IN} GROUP BY user_id")
def g05(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d).groupBy("user_id").agg((F.sum(F.when(C("roll") >= 15, 3).when(C("roll") >= 10, 1).otherwise(0)) - 2 * F.count_if(C("roll") == 1)).alias("score"))


@query("g07_cumulative_or_best", f"SELECT user_id, CAST(sum(lvl) FILTER (WHERE s1 % 2 = 0) AS BIGINT) + max(lvl) FILTER (WHERE s1 % 2 = 1) AS bonus, greatest(max(s1), max(s2)) AS spare FROM {_IN} GROUP BY user_id")
def g07(spark: SparkSession, d: str) -> DataFrame:
    """Some modifiers add up and of others the best counts, by a flag; of two spare pools the larger is kept."""
    even = C("s1") % 2 == 0
    return cases(spark, d).groupBy("user_id").agg((F.sum(F.when(even, C("lvl"))) + F.max(F.when(~even, C("lvl")))).alias("bonus"), F.greatest(F.max("s1"), F.max("s2")).alias("spare"))


@query("g06_stacking", f"SELECT user_id, CAST(sum(CASE WHEN event_type = 'click' THEN total ELSE best END) AS BIGINT) AS bonus FROM (SELECT user_id, event_type, sum(lvl) AS total, max(lvl) AS best FROM {_IN} GROUP BY ALL) GROUP BY user_id")
def g06(spark: SparkSession, d: str) -> DataFrame:
    """Only the best of a kind counts, except for one kind whose bonuses add up."""
    k = cases(spark, d).groupBy("user_id", "event_type").agg(F.sum("lvl").alias("total"), F.max("lvl").alias("best"))
    return k.groupBy("user_id").agg(F.sum(F.when(C("event_type") == "click", C("total")).otherwise(C("best"))).alias("bonus"))


@query("g09_drop_lowest", f"SELECT id, a + b + c + e - least(a, b, c, e) AS total, greatest(a, b, c, e) AS best FROM (SELECT id, roll % 6 + 1 AS a, s1 % 6 + 1 AS b, s2 % 6 + 1 AS c, lvl % 6 + 1 AS e FROM {_IN})")
def g09(spark: SparkSession, d: str) -> DataFrame:
    rolls = F.array(*[C(x) % 6 + 1 for x in ("roll", "s1", "s2", "lvl")])
    return cases(spark, d).select("id", B.best_of(rolls, 3).alias("total"), F.array_max(rolls).alias("best"))


_SIX = "[roll % 16 + 3, s1 % 16 + 3, s2 % 16 + 3, lvl % 16 + 3, amount % 16 + 3, (roll + s1) % 16 + 3]"


@query(
    "g09_discarded_sets",
    f"SELECT id, list_sum(list_transform(six, lambda x: CAST(floor((x - 10) / 2.0) AS BIGINT)))::BIGINT AS modifiers, list_max(six) AS best, list_sum(list_transform(six, lambda x: CAST(floor((x - 10) / 2.0) AS BIGINT))) <= 0 OR list_max(six) <= 13 AS may_discard FROM (SELECT id, {_SIX} AS six FROM {_IN})",
)
def g09b(spark: SparkSession, d: str) -> DataFrame:
    """Whether a set of six scores is too low and may be rolled again."""
    six = F.array(*[x % 16 + 3 for x in (C("roll"), C("s1"), C("s2"), C("lvl"), C("amount"), C("roll") + C("s1"))])
    return cases(spark, d).select("id", F.aggregate(six, F.lit(0).cast("bigint"), lambda s, x: s + B.modifier(x)).alias("modifiers"), F.array_max(six).alias("best"), B.too_low(six).alias("may_discard"))


@query("g10_point_costs", f"SELECT id, cost FROM (SELECT id, s1 FROM {_IN}) LEFT JOIN {values_sql('COSTS')} ON s1 = score")
def g10(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d).select("id", "s1").join(F.broadcast(lookup(spark, "COSTS")), C("s1") == C("score"), "left").select("id", "cost")


@query(
    "g10_point_budget",
    f"""SELECT id, CASE WHEN count(cost) = 3 THEN sum(cost)::BIGINT END AS spent, CASE WHEN count(cost) = 3 THEN sum(cost) <= CASE WHEN id % 5 = 0 THEN 21 ELSE 25 END END AS within
    FROM (SELECT id, unnest([s1, s2, lvl]) AS score FROM {_IN}) LEFT JOIN {values_sql('COSTS')} USING (score) GROUP BY id""",
)
def g10b(spark: SparkSession, d: str) -> DataFrame:
    """Three scores bought against a budget of 25 points, or 21 for droids; a score that can't be bought makes the sum unknown."""
    rows = cases(spark, d).select("id", F.explode(F.array("s1", "s2", "lvl")).alias("score")).join(F.broadcast(lookup(spark, "COSTS")), "score", "left")
    g = rows.groupBy("id").agg(F.sum("cost").alias("sum"), F.count("cost").alias("n"))
    spent = F.when(C("n") == 3, C("sum"))
    return g.select("id", spent.alias("spent"), (spent <= F.when(C("id") % 5 == 0, 21).otherwise(25)).alias("within"))


@query("g11_cooperation", f"SELECT user_id, 2 * count(*) FILTER (WHERE roll + lvl >= 10) AS bonus, least(4, 2 * count(*) FILTER (WHERE roll + lvl >= 10)) AS capped FROM {_IN} GROUP BY user_id")
def g11(spark: SparkSession, d: str) -> DataFrame:
    n = 2 * F.count_if(C("roll") + C("lvl") >= 10)
    return cases(spark, d).groupBy("user_id").agg(n.alias("bonus"), F.least(F.lit(4), n).alias("capped"))


@query("s01_initiative", f"SELECT id, CAST(rank() OVER (PARTITION BY user_id ORDER BY roll DESC, s1 DESC) AS INTEGER) AS place FROM {_IN}")
def s01(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d).select("id", F.rank().over(W.partitionBy("user_id").orderBy(F.desc("roll"), F.desc("s1"))).alias("place"))


@query(
    "s02_opposed",
    f"""SELECT user_id, CASE WHEN count(*) FILTER (WHERE k = 1) = 1 THEN min(id) FILTER (WHERE k = 1) END AS winner, count(*) FILTER (WHERE k = 1) > 1 AS again FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY roll DESC, s1 DESC) AS k FROM {_IN}) GROUP BY user_id""",
)
def s02(spark: SparkSession, d: str) -> DataFrame:
    """The highest result wins, then the higher modifier; a full tie is reported, never broken."""
    best = cases(spark, d).groupBy("user_id", "roll", "s1").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    top = best.groupBy("user_id").agg(F.max(F.struct("roll", "s1", "n", "id")).alias("b"))
    return top.select("user_id", F.when(C("b.n") == 1, C("b.id")).alias("winner"), (C("b.n") > 1).alias("again"))


@query("s03_rerolls", f"SELECT user_id, max_by(roll, id) AS final, max(roll) AS better, least(max(roll), arg_max(s1, id)) AS forced FROM {_IN} GROUP BY user_id")
def s03(spark: SparkSession, d: str) -> DataFrame:
    """A reroll's last result stands; or the better one; or the better of one's own and then the opponent's if lower."""
    return cases(spark, d).groupBy("user_id").agg(F.max_by("roll", "id").alias("final"), F.max("roll").alias("better"), F.least(F.max("roll"), F.max_by("s1", "id")).alias("forced"))


@query(
    "s06_ordered_rerolls",
    f"""SELECT user_id, list_reduce(list({{'k': event_type, 'v': roll}} ORDER BY id), lambda acc, x: {{'k': '', 'v': CASE x.k WHEN 'click' THEN x.v WHEN 'purchase' THEN greatest(acc.v, x.v) ELSE least(acc.v, x.v) END}}, {{'k': '', 'v': 10}}).v AS kept FROM {_IN} GROUP BY user_id""",
)
def s06(spark: SparkSession, d: str) -> DataFrame:
    """Rerolls of three kinds in the order they are used: the new one counts, the better one, or the lower one."""
    kind, none = C("event_type"), F.lit(None).cast("long")
    c = cases(spark, d).withColumn("zero", F.lit(0))
    lo = F.when(kind.isin("click", "purchase"), C("roll")).otherwise(none)
    hi = F.when(kind == "purchase", none).otherwise(C("roll"))
    return folds.clamped_fold(c, ["user_id"], ["id"], "zero", lo, hi, 10, "kept")


@query("s07_condition_track", f"SELECT user_id, list_reduce(list(CASE WHEN roll <= 12 THEN 1 WHEN roll <= 15 THEN 0 ELSE -2 END ORDER BY id), lambda acc, x: least(5, greatest(0, acc + x)), 0)::BIGINT AS step FROM {_IN} GROUP BY user_id")
def s07(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d).withColumn("delta", F.when(C("roll") <= 12, 1).when(C("roll") <= 15, 0).otherwise(-2))
    return folds.clamped_fold(c, ["user_id"], ["id"], "delta", 0, 5, 0, "step")


@query("s08_shields", f"SELECT user_id, list_reduce(list(CASE WHEN amount > 30 THEN -5 WHEN amount < 10 THEN 5 ELSE 0 END ORDER BY id), lambda acc, x: least(25, greatest(0, acc + x)), 25)::BIGINT AS rating FROM {_IN} GROUP BY user_id")
def s08(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d).withColumn("delta", F.when(C("amount") > 30, -5).when(C("amount") < 10, 5).otherwise(0))
    return folds.clamped_fold(c, ["user_id"], ["id"], "delta", 0, 25, 25, "rating")


@query(
    "s09_challenges",
    f"""WITH r AS (SELECT user_id, row_number() OVER w AS n, sum(CASE WHEN roll >= 12 THEN 1 ELSE 0 END) OVER w AS g FROM {_IN} WINDOW w AS (PARTITION BY user_id ORDER BY id)),
    o AS (SELECT user_id, n, CASE WHEN g >= 6 THEN 'success' WHEN n - g >= 8 THEN 'failure' END AS outcome FROM r)
    SELECT user_id, coalesce(min_by(outcome, n) FILTER (WHERE outcome IS NOT NULL), 'open') AS outcome, min(n) FILTER (WHERE outcome IS NOT NULL) AS place FROM o GROUP BY user_id""",
)
def s09(spark: SparkSession, d: str) -> DataFrame:
    return folds.first_to_reach(cases(spark, d), ["user_id"], ["id"], C("roll") >= 12, 6, 8)


@query("s11_once_a_day", f"SELECT id FROM {_IN} WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, id) = 1")
def s11(spark: SparkSession, d: str) -> DataFrame:
    c = cases(spark, d).where("event_type = 'click'")
    return c.groupBy("user_id", C("ts").cast("date").alias("day")).agg(F.min(F.struct("ts", "id")).alias("f")).select("f.id")


@query("s13_rewritten_order", f"SELECT user_id, max_by(roll, id) AS count, rank() OVER (ORDER BY max_by(roll, id) DESC, max_by(s1, id) DESC) AS place FROM {_IN} GROUP BY user_id")
def s13(spark: SparkSession, d: str) -> DataFrame:
    """The last count of each counts, then the order of all; ranks come from the few distinct counts, not from one sorted table."""
    last = cases(spark, d).groupBy("user_id").agg(F.max_by("roll", "id").alias("count"), F.max_by("s1", "id").alias("m"))
    kinds = last.groupBy("count", "m").agg(F.count("*").alias("n"))  # at most 20 * 24 rows
    w = W.orderBy(F.desc("count"), F.desc("m")).rowsBetween(W.unboundedPreceding, -1)
    places = kinds.select("count", "m", (F.coalesce(F.sum("n").over(w), F.lit(0)) + 1).alias("place"))
    return last.join(F.broadcast(places), ["count", "m"]).select("user_id", "count", "place")


@query("s14_cap_per_round", f"SELECT id FROM {_IN} QUALIFY row_number() OVER (PARTITION BY user_id, lvl ORDER BY id) <= 2")
def s14(spark: SparkSession, d: str) -> DataFrame:
    return cases(spark, d).withColumn("k", F.row_number().over(W.partitionBy("user_id", "lvl").orderBy("id"))).where("k <= 2").select("id")


@query("s10_expiry", f"SELECT e.id, count(o.id) AS seen FROM {_IN} e LEFT JOIN {_IN} o ON e.user_id = o.user_id AND (o.lvl > e.lvl OR (o.lvl = e.lvl AND o.roll < e.roll)) AND (o.lvl < e.lvl + 1 OR (o.lvl = e.lvl + 1 AND o.roll > e.roll)) GROUP BY e.id")
def s10(spark: SparkSession, d: str) -> DataFrame:
    """An effect lasts from its count of one round until just before the same count of the next; counts descend within a round."""
    from quernstone.operators.intervals import overlap_join

    c = cases(spark, d)
    at = C("lvl") * 20 + (20 - C("roll"))
    a = c.select("id", "user_id", (at + 1).alias("s"), (at + 20).alias("e"))
    b = c.select(C("id").alias("other"), C("user_id").alias("u"), at.alias("bs"), (at + 1).alias("be"))
    n = overlap_join(a, b, ("s", "e"), ("bs", "be"), 20, [("user_id", "u")]).groupBy("id").agg(F.count("*").alias("seen"))
    return c.select("id").join(n, "id", "left").select("id", F.coalesce("seen", F.lit(0)).alias("seen"))


@query(
    "s16_lock_out",
    """WITH RECURSIVE e AS (SELECT DISTINCT user_id, epoch_us(ts) // 1000000 AS sec FROM events WHERE ts IS NOT NULL),
    a AS (SELECT user_id, min(sec) AS sec FROM e GROUP BY user_id UNION ALL SELECT a.user_id, min(e.sec) AS sec FROM a JOIN e ON e.user_id = a.user_id AND e.sec >= a.sec + 86400 GROUP BY a.user_id),
    n AS (SELECT user_id, epoch_us(ts) // 1000000 AS sec, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 1000000) AS k FROM events WHERE ts IS NOT NULL)
    SELECT n.user_id, n.sec AS "at", a.sec IS NOT NULL AND k = 1 AS accepted FROM n LEFT JOIN a ON n.user_id = a.user_id AND n.sec = a.sec""",
)
def s16(spark: SparkSession, d: str) -> DataFrame:
    """Retries within 24 hours of the last accepted attempt are refused."""
    c = cases(spark, d).select("user_id", F.unix_seconds(C("ts").cast("timestamp")).alias("at"))
    return folds.spaced(c, ["user_id"], "at", 86_400)


@query("s15_one_per_trigger", f"SELECT min(id) AS id FROM {_IN} GROUP BY user_id, roll")
def s15(spark: SparkSession, d: str) -> DataFrame:
    """One answer a trigger: the first."""
    return cases(spark, d).groupBy("user_id", "roll").agg(F.min("id").alias("id")).select("id")


_SPENT = "CASE WHEN event_type = 'purchase' THEN 5 WHEN roll = 20 THEN 5 WHEN event_type = 'view' THEN 1 ELSE -1 END"


@query("s12_spent_powers", f"SELECT user_id, list_reduce(list({_SPENT} ORDER BY id), lambda acc, x: least(5, greatest(0, acc + x)), 5)::BIGINT AS ready FROM {_IN} GROUP BY user_id")
def s12(spark: SparkSession, d: str) -> DataFrame:
    """A suite of five powers: each use spends one, a natural 20 or a rest brings all back, a point spent brings one back; never under 0 or over 5."""
    gain = F.when(C("event_type") == "purchase", 5).when(C("roll") == 20, 5).when(C("event_type") == "view", 1).otherwise(-1)
    return folds.clamped_fold(cases(spark, d).withColumn("gain", gain), ["user_id"], ["id"], "gain", 0, 5, 5, "ready")


@query(
    "s13_delay_and_ready",
    f"""WITH c AS (SELECT id, user_id, event_type, roll, s1, first_value(roll) OVER (PARTITION BY user_id ORDER BY id) AS opening FROM {_IN}),
    n AS (SELECT user_id, min(opening) AS opening, max_by(roll, id) FILTER (WHERE event_type = 'purchase') AS readied, min(roll) FILTER (WHERE event_type = 'click') AS delayed, max_by(s1, id) AS m FROM c GROUP BY user_id)
    SELECT user_id, coalesce(readied, least(opening, delayed)) AS count, rank() OVER (ORDER BY coalesce(readied, least(opening, delayed)) DESC, m DESC) AS place FROM n""",
)
def s13b(spark: SparkSession, d: str) -> DataFrame:
    """Delaying can only lower one's count; the count on which a readied action was taken replaces it, up or down; ties go to the higher modifier. Ranks come from the few distinct counts."""
    g = cases(spark, d).groupBy("user_id").agg(F.min_by("roll", "id").alias("opening"), F.max_by("roll", F.when(C("event_type") == "purchase", C("id"))).alias("readied"), F.min(F.when(C("event_type") == "click", C("roll"))).alias("delayed"), F.max_by("s1", "id").alias("m"))
    last = g.select("user_id", F.coalesce("readied", F.least("opening", "delayed")).alias("count"), "m")
    kinds = last.groupBy("count", "m").agg(F.count("*").alias("n"))  # at most 20 * 24 rows
    w = W.orderBy(F.desc("count"), F.desc("m")).rowsBetween(W.unboundedPreceding, -1)
    places = kinds.select("count", "m", (F.coalesce(F.sum("n").over(w), F.lit(0)) + 1).alias("place"))
    return last.join(F.broadcast(places), ["count", "m"]).select("user_id", "count", "place")


QUERIES, ORACLES = R.queries, R.oracles
