"""Operators where keys are hot, intervals long, bounds large or open; and the plans they make."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.functions import rules as B
from quernstone.functions.vectors import nearest
from quernstone.operators import folds, markdown
from quernstone.operators.bands import band_join
from quernstone.operators.intervals import overlap_join
from quernstone.operators.windows import before_max, quantiles
from quernstone.plans import catalog
from quernstone.streaming.jobs import clamp_all

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["l05_dice_pool", "l06_rank", "l14_rerolled_table", "l15_information", "q17_band_join", "c02_range_penalty", "l09_outcome", "l13_two_level_table"])
def test_no_nested_loops(spark, name):
    plan = catalog.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_range_penalty_reads_each_table_once(spark):
    plan = catalog.queries()["c02_range_penalty"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2


@pytest.mark.parametrize("how", ["inner", "left"])
def test_bands_by_brute_force(spark, how):
    rng = random.Random(3)
    bands = [(rng.choice([None, rng.randrange(-50, 900)]), rng.choice([None, rng.randrange(-60, 1000)]), i) for i in range(40)] + [(0, 10**9, 90), (5, 5, 91), (-(10**8), None, 92)]
    left = [(i, rng.choice([None, rng.randrange(-100, 3000)]), "_b") for i in range(200)] + [(7, 5, "_b"), (7, 5, "_b"), (8, 10**10, "_s")]
    got = band_join(spark.createDataFrame(left, "id long, v long, _b string").withColumnRenamed("_b", "tag"), spark.createDataFrame(bands, "lo long, hi long, k int"), "v", "lo", "hi", 10, how=how)
    want = []
    for i, v, t in left:
        hit = [(i, v, t, *b) for b in bands if v is not None and b[0] is not None and v >= b[0] and (b[1] is None or v <= b[1])]
        want += hit or ([(i, v, t, None, None, None)] if how == "left" else [])
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert band_join(spark.createDataFrame([(1, 2)], "id int, v int"), spark.createDataFrame([], "lo int, hi int"), "v", "lo", "hi", 5).count() == 0


def test_one_very_long_interval(spark):
    a = spark.createDataFrame([(0, 0, 10**12)] + [(i, i, i + 2) for i in range(1, 200)], "id long, s long, e long")
    b = spark.createDataFrame([(i, i * 5, i * 5 + 1) for i in range(100)] + [(500, None, 3)], "other long, bs long, be long")
    got = {tuple(r) for r in overlap_join(a, b, ("s", "e"), ("bs", "be"), 1).select("id", "other").collect()}
    assert got == {(i, j) for i, s, e in [(0, 0, 10**12)] + [(i, i, i + 2) for i in range(1, 200)] for j in range(100) if s < j * 5 + 1 and j * 5 < e}


def _fold(rows, start, lo=None, hi=None):
    x = start
    for _, d, a, b in sorted(rows, key=lambda r: r[0]):
        x += d or 0
        x = max(x, a) if a is not None else x
        x = min(x, b) if b is not None else x
    return x


def test_folds_without_bounds_have_none(spark):
    df = spark.createDataFrame([(1, 2**41), (2, -5)], "id long, d long").withColumn("g", F.lit(1))
    assert folds.clamped_fold(df, ["g"], ["id"], "d", None, None, 0, "x").first().x == 2**41 - 5
    assert folds.clamped_fold(df, ["g"], ["id"], "d", None, 2**40, 0, "x").first().x == 2**40 - 5


def test_folds_by_rank_whatever_the_times(spark):
    rng = random.Random(5)
    rows = [(g, t, rng.choice([None, -9, -2, 1, 3, 8]), rng.choice([None, None, -4, 0]), rng.choice([None, None, 5, 9])) for g in ("a", "b", None) for t in [-(10**12), *range(700)]]
    rows = [(g, t, d, a, None if a is not None and b is not None and b < a else b) for g, t, d, a, b in rows]
    df = spark.createDataFrame(rows, "g string, t long, d long, a long, b long")
    got = {r.g: r.x for r in folds.clamped_fold(df, ["g"], ["t"], "d", F.col("a"), F.col("b"), 2, "x", chunk=10).collect()}
    assert got == {g: _fold([r[1:] for r in rows if r[0] == g], 2) for g in ("a", "b", None)}


def test_steps_composed_in_pairs():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 17, 64, 333):
        d = rng.integers(-3, 4, n)
        x = 2
        for s in d:
            x = min(5, max(0, x + s))
        assert clamp_all(2, d, 0, 5) == x


def test_quantiles_and_earlier_maxima_by_brute_force(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, round(rng.random() * 20)]), i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, v long, i long")
    got = {r.g: (r.q0, r.q3, r.q9) for r in quantiles(df, "g", "v", {"q0": 0.0, "q3": 0.3, "q9": 0.9}).collect()}
    for g in ("a", "b", None):
        assert got[g] == pytest.approx([np.quantile([v for k, v, _ in rows if k == g and v is not None], q) for q in (0.0, 0.3, 0.9)])
    top, want = {}, {}
    for g, v, i in rows:
        want[i] = top.get(g)
        top[g] = max(x for x in (top.get(g), v) if x is not None) if v is not None or top.get(g) is not None else None
    assert {r.i: r.seen for r in before_max(df, ["g"], ["i"], "v", "seen").collect()} == want


def test_nearest_by_brute_force(spark):
    rng = np.random.default_rng(2)
    vecs = rng.normal(size=(120, 6)).round(1)
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)] + [(500, None), (501, [0.0] * 6), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (503, [1.0]), (None, [1.0] * 6), (3, vecs[3].tolist())]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {}
    for r in nearest(df, df.where("id % 10 = 0"), "id", "v", 5, block=4, chunk=30).collect():
        got.setdefault(r.query, []).append((-r.cosine, r.id))
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    all_ = [(i, u) for i, u in enumerate(unit)] + [(3, unit[3])]
    for q in range(0, 120, 10):
        assert sorted(got[q]) == sorted((-round(float(u @ unit[q]), 5) + 0.0, i) for i, u in all_ if i != q)[:5]
    assert set(got) == set(range(0, 120, 10)) and nearest(df.limit(0), df.limit(0), "id", "v", 3).count() == 0


def test_labels_and_links_of_any_length(spark):
    label, target = "x" * 300, "http://h/a" + "_(b)" * 20
    df = spark.createDataFrame([(1, f"**{label}:** value\n[t]({target})"), (2, None), (3, "")], "id int, body string")
    assert markdown.fields(df, "id", "body").select("label").first().label == label
    assert markdown.links(df, "id", "body").select("target").first().target == target


def test_more_rules(spark):
    one = spark.range(1)
    v = lambda c: one.select(c.alias("x")).first().x
    lit, none = F.lit, F.lit(None).cast("int")
    assert v(B.will(lit(5), lit(2), none)) == 17 and v(B.will(lit(None).cast("int"), lit(2), lit(1))) is None
    assert v(B.vehicle_reflex(none, lit(4), lit(1), lit(-2))) == 13 and v(B.vehicle_reflex(lit(7), lit(4), lit(1), lit(-2))) == 16 and v(B.vehicle_fortitude(lit(9))) == 19
    assert v(B.vehicle_initiative(lit(3), lit(8), lit(True), lit(-2), lit(1))) == 7
    assert v(B.attack_bonus(lit("melee"), lit(3), lit(2), lit(5), lit(9), none, lit(False))) == 5 and v(B.attack_bonus(lit("ranged"), lit(3), lit(2), lit(5), lit(9), lit(-5), lit(False))) == 3
    assert v(B.attack_bonus(lit("vehicle"), lit(3), lit(2), lit(5), lit(9), lit(-2), lit(True))) == 12 and v(B.attack_bonus(lit("song"), lit(3), lit(2), lit(5), lit(9), none, lit(False))) is None
    assert v(B.damage_by_kind(lit("melee"), lit(4), lit(5), lit(3), lit(True), lit(0), lit(1))) == 12 and v(B.damage_by_kind(lit("melee"), lit(1), lit(0), lit(-3), lit(True), lit(0), lit(1))) == 1
    assert v(B.damage_by_kind(lit("vehicle"), lit(10), lit(4), lit(3), lit(False), lit(1), lit(2))) == 26 and v(B.damage_by_kind(lit("x"), lit(1), lit(1), lit(1), lit(False), lit(0), lit(1))) is None
    # A climber with +10 takes 10 against 15 and 23; a party of six; a set that may be scrapped.
    assert v(B.succeeds(lit(10), lit(10), lit(15))) and not v(B.succeeds(lit(10), lit(10), lit(23)))
    assert v(B.party_adjusted(lit(10), lit(6))) == 8 and v(B.party_adjusted(lit(10), lit(3))) == 11 and v(B.take_twenty_time(lit(2))) == 40
    assert v(B.too_low(F.array(*map(lit, (13, 13, 12, 10, 10, 10))))) and not v(B.too_low(F.array(*map(lit, (14, 13, 12, 10, 10, 10))))) and v(B.too_low(F.array().cast("array<int>"))) is None
    assert v(B.threshold(lit(14), lit(200))) == 214 and v(B.circumstance(lit(2), lit(1))) == 2
