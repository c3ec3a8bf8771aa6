"""The similarity join against brute force, with skewed groups, split lists and blocks, and edge cases."""

import random
import re

import numpy as np
import pytest

from quernstone.llm import near_duplicates as nd
from quernstone.llm.components import components


def brute(docs, n, t):
    sets = {}
    for i, text in docs:
        w = re.findall(r"[^\W_]+", (text or "").lower())
        s = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        if s and i is not None:
            sets[i] = s
    ids = sorted(sets)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def corpus(seed, groups=8, size=9):
    rng, docs, k = random.Random(seed), [], 0
    words = [f"w{i}" for i in range(60)]
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.randrange(8, 120))]
        for _ in range(rng.randrange(1, size)):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = [rng.choice(words)] * rng.randrange(2)
            docs.append((k, " ".join(w)))
            k += 1
    hot = [rng.choice(words) for _ in range(50)]
    for _ in range(len(docs) // 2):  # a third of all rows nearly alike
        w = list(hot)
        w[rng.randrange(50)] = rng.choice(words)
        docs.append((k, " ".join(w)))
        k += 1
    return docs + [(k, None), (k + 1, ""), (k + 2, "two words"), (k + 3, docs[0][1]), (k + 4, docs[0][1].upper() + " !"), (None, docs[0][1]), (k + 5, "жё 日本 éß " * 3)]


@pytest.mark.parametrize("seed, n, t, list_rows, block", [(1, 3, 0.6, 100_000, 20_000), (2, 3, 0.6, 5, 10), (3, 5, 0.8, 4, 6), (4, 2, 0.5, 3, 4)])
def test_same_pairs_as_brute_force(spark, seed, n, t, list_rows, block):
    docs = corpus(seed)
    df = spark.createDataFrame([(i, x, "extra") for i, x in docs], "id long, text string, sig string")
    members, pairs = nd.near_duplicates(df, "id", "text", n, t, list_rows=list_rows, bucket_rows=2000, block_pairs=block)
    got = [tuple(r) for r in nd.expand_pairs(members, pairs).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(docs, n, t)
    rows = nd.classes(members, pairs).collect()
    assert len({r.id for r in rows}) == len(rows) == len({i for i, x in docs if i is not None and len(re.findall(r"[^\W_]+", x or "")) >= n})


def test_groups_are_components(spark):
    docs = corpus(6)
    members, pairs = nd.near_duplicates(spark.createDataFrame(docs, "id long, text string"), "id", "text", 3, 0.6)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in brute(docs, 3, 0.6):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    rows = nd.groups(members, pairs).collect()
    assert all(r.group_id == find(r.id) for r in rows) and len(rows) == len({r.id for r in rows})
    sizes = {}
    for r in rows:
        sizes[r.group_id] = sizes.get(r.group_id, 0) + 1
    assert all(r.size == sizes[r.group_id] for r in rows)


def test_components_of_long_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3), (200, 201), (201, 200), (200, 201)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {(i, 0) for i in range(1, 41)} | {(100 + i, 100) for i in range(1, 30)} | {(201, 200)}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_empty_table(spark):
    members, pairs = nd.near_duplicates(spark.createDataFrame([], "id long, text string"), "id", "text")
    assert members.count() == pairs.count() == nd.expand_pairs(members, pairs).count() == nd.classes(members, pairs).count() == 0


def test_derived_overlaps_equal_computed_ones():
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 5000, 300)).astype(np.uint64)
    sets = {b"%d" % i: np.unique(np.r_[rng.permutation(base)[: len(base) - i], rng.integers(0, 5000, 3 * i).astype(np.uint64)]) for i in range(12)}
    partners = {a: [b for b in sets if b > a] for a in sets}
    for (a, b), o in nd.block_overlaps(sets, partners).items():
        assert o == len(np.intersect1d(sets[a], sets[b]))


def test_full_counters_change_no_result_and_copy_nothing(spark):
    docs = corpus(8)
    df = spark.createDataFrame(docs, "id long, text string")
    members, pairs = nd.near_duplicates(df, "id", "text", 3, 0.6, list_rows=60, sketch_bits=6)
    assert {tuple(r) for r in nd.expand_pairs(members, pairs).collect()} == brute(docs, 3, 0.6)
    # The counters hold many shingles each, so they are full beyond a list's length, though no shingle is.
    sets = [nd.shingle_set(t, 3) for _, t in docs if t]
    counts = np.bincount(np.concatenate([nd._slots(s, 6) for s in sets]), minlength=64)
    assert counts.max() > 60 and (counts > 60).sum() > (counts - counts.sum() // 64 > 60).sum()
