"""Edge cases of the core operators against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from quernstone.functions import rules as B
from quernstone.functions import values as V
from quernstone.operators import folds, graphs, markdown
from quernstone.operators.asof import asof_join
from quernstone.operators.bands import band_join
from quernstone.operators.intervals import overlap_join
from quernstone.operators.skew import salted_join
from quernstone.operators.windows import global_place, groups_frame_sum


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_band_join_bounds_open_ends_nulls_and_repeats(spark):
    left = spark.createDataFrame([(1, 0), (2, 10), (3, 11), (4, None), (5, 999), (5, 999), (6, -3)], "id int, v int")
    bands = spark.createDataFrame([(0, 10, "a"), (11, 20, "b"), (21, None, "c"), (5, 4, "empty"), (None, 3, "no start")], "lo int, hi int, name string")
    got = rows(band_join(left, bands, "v", "lo", "hi", 4).select("id", "name"))
    assert got == [(1, "a"), (2, "a"), (3, "b"), (5, "c"), (5, "c")]
    kept = rows(band_join(left, bands, "v", "lo", "hi", 4, how="left").select("id", "name"))
    assert kept == sorted([*got, (4, None), (6, None)], key=repr)
    assert rows(band_join(left.limit(0), bands, "v", "lo", "hi", 4)) == []


def test_band_join_by_key(spark):
    left = spark.createDataFrame([("x", 5), ("y", 5), (None, 5)], "g string, v int")
    bands = spark.createDataFrame([("x", 0, 9, 1), ("y", 6, 9, 2)], "k string, lo int, hi int, p int")
    assert rows(band_join(left, bands, "v", "lo", "hi", 3, [("g", "k")]).select("g", "p")) == [("x", 1)]


def test_asof_ties_nulls_and_tolerance(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 4), (3, "b", 9), (4, None, 9), (5, "a", None), (6, "a", 5)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 4, 1), ("a", 4, 2), ("a", 5, 0), ("b", 1, 7), ("a", None, 99), (None, 1, 98)], "k string, t int, v int")
    got = {r.id: r.v for r in asof_join(left, right, "t", "k", tie="v").collect()}
    assert got == {1: 0, 2: 2, 3: 7, 4: None, 5: None, 6: 0}
    strict = {r.id: r.v for r in asof_join(left, right, "t", "k", tie="v", allow_equal=False).collect()}
    assert strict == {1: 2, 2: None, 3: 7, 4: None, 5: None, 6: 2}
    near = {r.id: r.v for r in asof_join(left, right, "t", "k", tie="v", tolerance=3).collect()}
    assert near[3] is None and near[1] == 0


def test_overlap_join_is_brute_force(spark):
    rng = random.Random(4)
    span = lambda: (lambda s: (s, s + rng.randrange(0, 9)))(rng.randrange(60))
    a = [(i, rng.randrange(3), *span()) for i in range(40)] + [(99, 0, None, 5)]
    b = [(i, rng.randrange(3), *span()) for i in range(40)] + [(98, 0, 1, None)]
    x, y = spark.createDataFrame(a, "i int, k int, s int, e int"), spark.createDataFrame(b, "j int, l int, p int, q int")
    got = rows(overlap_join(x, y, ("s", "e"), ("p", "q"), 5, [("k", "l")]).select("i", "j"))
    want = sorted(((m[0], n[0]) for m in a[:-1] for n in b[:-1] if m[1] == n[1] and m[2] < n[3] and n[2] < m[3] and m[2] < m[3] and n[2] < n[3]), key=repr)
    assert got == want


def test_clamped_fold_in_chunks(spark):
    rng = random.Random(1)
    data = [(rng.choice(["a", "b", None]), i, rng.choice([-3, -1, 1, 2, None])) for i in range(400)]
    df = spark.createDataFrame(data, "k string, t long, d int")
    for chunk in (7, 10_000):
        got = {r.k: r.x for r in folds.clamped_fold(df, ["k"], ["t"], "d", 0, 5, 2, "x", chunk=chunk).collect()}
        for k in ("a", "b", None):
            x = 2
            for g, _, d in data:
                x = min(5, max(0, x + (d or 0))) if g == k else x
            assert got[k] == x
    assert folds.clamped_fold(df.limit(0), ["k"], ["t"], "d", 0, 5, 2, "x").collect() == []


def test_spaced(spark):
    df = spark.createDataFrame([("a", 0), ("a", 5), ("a", 10), ("a", 14), ("a", 20), ("b", 3), (None, 1), ("b", None)], "k string, t int")
    got = rows(folds.spaced(df, ["k"], "t", 10))
    assert got == sorted([("a", 0, True), ("a", 5, False), ("a", 10, True), ("a", 14, False), ("a", 20, True), ("b", 3, True), (None, 1, True)], key=repr)


def test_first_to_reach(spark):
    df = spark.createDataFrame([("w", i, i % 2 == 0) for i in range(6)] + [("l", i, False) for i in range(5)] + [("o", 0, None)], "k string, i int, ok boolean")
    got = rows(folds.first_to_reach(df, ["k"], ["i"], F.col("ok"), 3, 3))
    assert got == [("l", "failure", 3), ("o", "open", None), ("w", "success", 5)]


def test_reach_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "b"), (None, "a"), ("c", None)], "s string, d string")
    got = rows(graphs.reach(e, "s", "d", 10))
    assert ("a", "a", 3) in got and ("a", "c", 2) in got and len(got) == 9


def test_groups_frame_and_global_place(spark):
    df = spark.createDataFrame([("k", 1, 10), ("k", 1, 20), ("k", 2, 5), ("k", 4, 7), ("k", None, 1)], "k string, o int, v int")
    got = {(r.o, r.v): r.s for r in groups_frame_sum(df, ["k"], "o", "v", 1, 0, "s").collect()}
    assert got == {(None, 1): 1, (1, 10): 31, (1, 20): 31, (2, 5): 35, (4, 7): 12}
    big = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    placed = global_place(big, [F.asc("x")], "place").collect()
    assert sorted(r.place for r in placed) == list(range(1, 1001)) and all(r.place == r.x + 1 for r in placed)
    assert global_place(big.limit(0), [F.asc("x")], "place").collect() == []


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(spark, how):
    left = spark.createDataFrame([("hot", i) for i in range(50)] + [("cold", 1), (None, 2)], "k string, v int")
    right = spark.createDataFrame([("hot", 1), ("other", 2), (None, 3)], "r string, w int")
    assert rows(salted_join(left, right, "k", "r", 4, how)) == rows(left.join(right, F.col("k") == F.col("r"), how))


def test_typed_values(spark):
    df = spark.createDataFrame([("3d8",), ("6d10x2",), ("3d4 x 250",), ("2d6 + 3",), ("Special",), (None,), ("",)], "t string")
    assert [r.d and tuple(r.d) for r in df.select(V.dice(F.col("t")).alias("d")).collect()] == [(3, 8, 0, 1), (6, 10, 0, 2), (3, 4, 0, 250), (2, 6, 3, 1), None, None, None]
    df = spark.createDataFrame([("0-30 Squares",), ("8th-14th",), ("28+",), ("15th and Higher",), ("7",), ("none",), (None,)], "t string")
    assert [tuple(r.b) for r in df.select(V.bounds(F.col("t")).alias("b")).collect()] == [(0, 30), (8, 14), (28, None), (15, None), (7, 7), (None, None), (None, None)]
    one = spark.createDataFrame([("+2 Int, -2 Dex", "2.2 kg", "55,000", "Name Keel1,3", "S, A,,")], "e string, q string, n string, f string, i string").select(
        V.effects(F.col("e")), V.quantity(F.col("q")), V.number(F.col("n")), V.without_footnote(F.col("f")), V.items(F.col("i"))
    )
    e, q, n, f, i = one.collect()[0]
    assert e == {"Int": 2, "Dex": -2} and (float(q[0]), q[1]) == (2.2, "kg") and (n, f, i) == (55000, "Name Keel", ["S", "A"])


def test_markdown_tables_fields_links(spark):
    body = "# T\n\n| A | B |  | C |\n| --- | --- | --- | --- |\n| 1 | x | n | |\n| 2 | y |\n\ntext\n\n|  |\n| --- |\n| note |\n\n**Label:** v [N](http://h/a_(b) \"t\")\n- *Other:* w\n### Deep\n[M](http://h/m?action=edit&redlink=1)\n"
    df = spark.createDataFrame([(1, body), (2, None), (3, ""), (4, "| a | b |")], "id int, t string")
    assert rows(markdown.table_cells(df, "id", "t")) == [(1, 1, 1, "A", "1"), (1, 1, 1, "B", "x"), (1, 1, 1, "C", ""), (1, 1, 2, "A", "2"), (1, 1, 2, "B", "y")]
    assert [(r.label, r.value[:1]) for r in markdown.fields(df, "id", "t").collect()] == [("Label", "v"), ("Other", "w")]
    assert rows(markdown.links(df, "id", "t")) == [(1, "M", "http://h/m", True), (1, "N", "http://h/a_(b)", False)]
    assert [(r.level, r.heading) for r in markdown.sections(df, "id", "t").orderBy("pos").collect()] == [(1, "T"), (3, "Deep")]


def test_worked_examples(spark):
    one = spark.range(1)
    v = lambda c: one.select(c).collect()[0][0]
    lit = F.lit
    assert v(B.reflex(lit(1), lit(2), B.modifier(lit(12)), lit(0), lit(None).cast("int"), lit(None).cast("int"))) == 13
    assert v(B.experience(lit(11))) == 55_000
    assert v(B.modifier(lit(9))) == -1 and v(B.modifier(lit(1))) == -5
    assert v(B.succeeds(lit(10), lit(10), lit(15))) and not v(B.succeeds(lit(10), lit(10), lit(23)))
    levels = F.array(lit(2), lit(2), lit(2), lit(5))
    assert (v(B.encounter_level(levels, False)), v(B.encounter_level(levels, True))) == (3, 7)
    assert v(B.encounter_level(F.array(lit(15), lit(15)), False)) == 10
    eleven = F.array(lit(8), *[lit(5)] * 5)
    assert v(B.encounter_level(eleven, False)) == v(B.encounter_level(eleven, True)) == 11
    assert v(B.best_of(F.array(lit(1), lit(6), lit(3), lit(4)), 3)) == 13 and v(B.best_of(F.array(lit(1)), 3)) is None
    assert v(B.step_distance(lit(3), lit(2))) == 5 and v(B.cone_distance(lit(3), lit(2))) == 4
    assert v(B.attack_result(lit(1), lit(99), lit(5))) == "miss" and v(B.attack_result(lit(20), lit(-9), lit(50))) == "critical"
