"""Encoding against the public library, decoding as a round trip, packing against plain best-fit decreasing."""

import array
import base64
import random

import pytest
from pyspark.sql import functions as F

from quernstone.llm import encoding, packing
from quernstone.llm.bpe_transducer import Decoder, Encoder, Transducer

tiktoken = pytest.importorskip("tiktoken")
PATH = f"{encoding.FOLDER}/byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=encoding.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PATH, encoding.PATTERN)


def ids(encoder, text):
    out = array.array("i")
    encoder.encode(text, out)
    return out.tolist()


def test_random_texts(encoder, reference):
    rng = random.Random(0)
    signs = list("ab  \n\t\r'sdrel19²½éßяあ日 ​　 👍🏽.,!-_\x1c\x85́") + ["ing", " the", "'ll", "don't", "aaaa", "<|endoftext|>", "\n\n  "]
    decoder = Decoder(encoder.transducer.v)
    for _ in range(4000):
        text = "".join(rng.choice(signs) for _ in range(rng.randrange(40)))
        got = ids(encoder, text)
        assert got == reference.encode_ordinary(text)
        assert decoder.feed(got) + decoder.close() == text


def test_long_words_are_emitted_in_windows(encoder, reference, monkeypatch):
    monkeypatch.setattr(Transducer, "WINDOW", 50)
    rng = random.Random(1)
    for _ in range(5):
        text = "".join(rng.choice("abcdeinstr") for _ in range(3000))
        assert ids(encoder, text) == reference.encode_ordinary(text)


def test_states_and_chunks_are_bounded(reference, monkeypatch):
    monkeypatch.setattr(Transducer, "MOST_STATES", 50)
    monkeypatch.setattr(Encoder, "MOST_CHUNKS", 5)
    e = Encoder(PATH, encoding.PATTERN)
    text = "Some words, and other words; then words again. " * 20
    assert ids(e, text) == reference.encode_ordinary(text)
    assert max(len(e.words), len(e.chunks), len(e.after_blank)) <= 6


def test_streaming_decoder_waits_for_whole_characters(encoder):
    got = ids(encoder, "👍日é")
    d = Decoder(encoder.transducer.v)
    parts = [d.feed([i]) for i in got]
    assert "".join(parts) + d.close() == "👍日é" and "" in parts
    broken = Decoder(encoder.transducer.v)
    first = encoder.transducer.v.rank[b"\xf0"]
    assert broken.feed([first]) == "" and broken.close() == "�"
    assert broken.feed([first, encoder.transducer.v.rank[b"a"]]) == "�a"


def test_encode_a_table(spark, reference):
    long = "word " * 50_000
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "y"), (3, "", "z"), (4, long, "w"), (1, "a b", "again"), (None, "c", "n")], "id long, text string, ids string")
    got = {(r.id, len(r.ids)): r.ids for r in encoding.encode(df, "id", "text").collect()}
    assert got[2, 0] == got[3, 0] == [] and got[4, len(reference.encode_ordinary(long))] == reference.encode_ordinary(long)
    assert encoding.encode(df, "id", "text").where("ids IS NULL").count() == 0 and encoding.encode(df, "id", "text").count() == 6
    assert encoding.encode(df.limit(0), "id", "text").count() == 0


def plain_best_fit(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        fit = [b for b in bins if capacity - sum(b) >= s]
        if fit:
            min(fit, key=lambda b: capacity - sum(b)).append(s)
        else:
            bins.append([s])
    return sorted(sorted(b) for b in bins)


def expand(plan):
    bins = {}
    for size, lo, hi, first, each in plan:
        for k in range(hi - lo + 1):
            bins.setdefault(first + k // each, []).append(size)
    return sorted(sorted(b) for b in bins.values())


def test_plan_is_best_fit_decreasing():
    rng = random.Random(2)
    for _ in range(200):
        capacity = rng.randrange(3, 60)
        sizes = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 90))]
        counts = {}
        for s in sizes:
            counts[s] = counts.get(s, 0) + 1
        got = expand(packing.plan(counts, capacity))
        assert [len(got), sorted(sum(got, []))] == [len(plain_best_fit(sizes, capacity)), sorted(sizes)]
        assert sorted(map(sum, got)) == sorted(map(sum, plain_best_fit(sizes, capacity)))
    assert len(packing.plan({7: 10**12, 3: 10**12, 2: 5}, 100)) < 20


def test_pack_a_table(spark):
    rng = random.Random(3)
    items = [(i, 7 if rng.random() < 0.4 else rng.randrange(1, 30)) for i in range(600)] + [(1000, 250), (1001, 200), (1002, None), (1003, 0), (5, 9), (5, 9)]
    df = spark.createDataFrame(items, "id long, n int").withColumn("size", F.lit("clash"))
    rows = packing.pack(df, "id", "n", 100).collect()
    used = {}
    for r in rows:
        used[r.bin_id] = used.get(r.bin_id, 0) + r.size
    assert max(used.values()) <= 100 and sum(used.values()) == sum(n for _, n in items if n)
    assert sorted(used) == list(range(len(used))) and len(used) <= 1.02 * sum(used.values()) / 100 + 1
    assert sorted((r.part_no, r.size) for r in rows if r.id == 1000) == [(1, 100), (2, 100), (3, 50)]
    assert len(rows) == 600 + 3 + 2 + 2  # the items of size 1 to 29, 250 in three parts, 200 in two, and the repeated one twice
    assert packing.pack(df.limit(0), "id", "n", 100).count() == 0
