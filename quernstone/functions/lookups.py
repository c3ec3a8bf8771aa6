"""Small fixed lookup tables, as DataFrames. Closed ranges include both ends; a null end is open."""

from pyspark.sql import DataFrame, SparkSession

# Sizes from small to large with their modifiers (defense, grapple, threshold). The kinds of Colossal differ in the last two.
SIZES = [
    ("Fine", 10, -20, 0), ("Diminutive", 5, -15, 0), ("Tiny", 2, -10, 0), ("Small", 1, -5, 0), ("Medium", 0, 0, 0), ("Large", -1, 5, 5), ("Huge", -2, 10, 10), ("Gargantuan", -5, 15, 20), ("Colossal", -10, 20, 50),
    ("Colossal (Frigate)", -10, 25, 100), ("Colossal (Cruiser)", -10, 30, 200), ("Colossal (Station)", -10, 35, 500),
]
# Difficulty by level: (lo, hi, easy, medium, moderate, hard, heroic).
DIFFICULTY = [(1, 1, 13, 18, 23, 26, 31), (2, 3, 14, 19, 24, 27, 32), (4, 5, 16, 21, 26, 29, 34), (6, 7, 17, 22, 27, 30, 35), (8, 9, 18, 23, 28, 32, 37), (10, 11, 19, 24, 29, 33, 38), (12, 13, 21, 26, 31, 35, 40), (14, 14, 22, 27, 32, 36, 41), (15, 15, 22, 27, 32, 37, 42), (16, 17, 23, 28, 33, 38, 43), (18, 19, 24, 29, 34, 39, 44), (20, 20, 26, 31, 36, 41, 46)]
# Check tiers (least result, size moved), dice by level, ranks by score, outcomes of a d20, speeds, ages of data in days.
TIERS = [(15, "Medium"), (20, "Large"), (25, "Huge"), (30, "Gargantuan"), (35, "Colossal")]
POOLS = [(1, 7, 1), (8, 14, 2), (15, None, 3)]
RANKS = [(0, 3, None), (4, 5, 0), (6, 6, 0), (7, 7, 1), (8, 9, 2), (10, 10, 2), (11, 11, 3), (12, 15, 4), (16, 18, 5), (19, 20, 6), (21, 23, 7), (24, 25, 8), (26, 27, 9), (28, None, 10)]
OUTCOMES = [(1, 10, "No system damage"), (11, 15, "Starship becomes Used"), (16, 16, "Communications/sensors destroyed"), (17, 17, "Weapons destroyed"), (18, 18, "Hyperdrive destroyed"), (19, 19, "Sublight Drive destroyed"), (20, 20, "Life support destroyed")]
SPEEDS = [(0, 11, 1), (12, 15, 2), (16, None, 3)]
AGES = [(0, 0, 10), (1, 4, 15), (5, 34, 20), (35, 367, 25), (368, None, 30)]
ATTITUDES = [("Hostile", "-10"), ("Unfriendly", "-5"), ("Indifferent", "-2"), ("Friendly", "+0"), ("Helpful", "-")]
INFORMATION = [("General", 15, 1), ("Specific", 20, 10), ("Private", 25, 60), ("Secret", 30, 480)]
# The two-level hazard table as it stands, parents on their own rows: (place, severity range, severity, roll range). A 20 has no mishaps of its own: it rolls twice again.
HAZARDS = [
    (1, "1-8", "MINOR", None), (2, None, None, "1-8"), (3, None, None, "9-14"), (4, None, None, "15-18"), (5, None, None, "19-20"),
    (6, "9-14", "MODERATE", None), (7, None, None, "1-8"), (8, None, None, "9-14"), (9, None, None, "15-18"), (10, None, None, "19-20"),
    (11, "15-19", "MAJOR", None), (12, None, None, "1-6"), (13, None, None, "7-10"), (14, None, None, "11-13"), (15, None, None, "14-15"), (16, None, None, "16-17"), (17, None, None, "18-19"), (18, None, None, "20"),
]
# Generator tables, one roll each: system types, and numbers of planets, of which 20 is rolled again.
SYSTEMS = [(1, 1, "Binary Star System"), (2, 2, "Black Hole"), (3, 5, "Nebula/Dust Cloud"), (6, 14, "Single Star System"), (15, 18, "Double Star System"), (19, 19, "Triple Star System"), (20, 20, "Quadruple (or more) Star System")]
PLANETS = [(1, 1, "None"), (2, 2, "1"), (3, 3, "2"), (4, 4, "3"), (5, 6, "4"), (7, 8, "5"), (9, 10, "6"), (11, 13, "7"), (14, 16, "8"), (17, 18, "9"), (19, 19, "10+")]
# Range penalties of ranged attacks.
RANGES = [("Point-Blank", 0), ("Short", -2), ("Medium", -5), ("Long", -10)]
# Penalty and helplessness at each step of the condition track.
CONDITIONS = [(0, 0, False), (1, -1, False), (2, -2, False), (3, -5, False), (4, -10, False), (5, 0, True)]
# Score costs in point buying.
COSTS = [(8, 0), (9, 1), (10, 2), (11, 3), (12, 4), (13, 5), (14, 6), (15, 8), (16, 10), (17, 13), (18, 16)]

SCHEMAS = {
    "SIZES": "size string, defense int, grapple int, threshold int", "DIFFICULTY": "lo int, hi int, easy int, medium int, moderate int, hard int, heroic int", "TIERS": "least int, size string", "POOLS": "lo int, hi int, dice int",
    "RANKS": "lo int, hi int, bonus int", "OUTCOMES": "lo int, hi int, outcome string", "SPEEDS": "lo int, hi int, squares int", "AGES": "lo int, hi int, dc int", "ATTITUDES": "attitude string, text string", "INFORMATION": "kind string, dc int, minutes int",
    "HAZARDS": "pos int, severity_range string, severity string, roll_range string", "COSTS": "score int, cost int",
    "SYSTEMS": "lo int, hi int, system string", "PLANETS": "lo int, hi int, planets string", "RANGES": "band string, penalty int", "CONDITIONS": "step int, penalty int, helpless boolean",
}


def lookup(spark: SparkSession, name: str) -> DataFrame:
    """One of the tables above."""
    return spark.createDataFrame(globals()[name], SCHEMAS[name])


def values_sql(name: str) -> str:
    """The table as a SQL subquery."""
    cols = [c.split()[0] for c in SCHEMAS[name].split(", ")]
    cell = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in globals()[name])}) AS t({', '.join(cols)}))"
