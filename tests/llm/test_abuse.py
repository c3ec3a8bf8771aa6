"""Restoring disguised words, telling look-alikes apart, scores, and held-out accuracy on the rated documents."""

import zlib

import numpy as np
import pandas as pd
import pytest

from quernstone.llm import abuse

TEXT = "the pilot of the old ship loses two hit points and a tired scout waits at the dock for the animals of the circus " * 50


@pytest.fixture(scope="module")
def restorer():
    counts = next(abuse._count(iter([pd.DataFrame({"text": [TEXT]})])))["counts"][0]
    return abuse.Restorer(np.frombuffer(zlib.decompress(counts)))


@pytest.mark.parametrize(
    "shown, meant",
    [("m0r0n", "moron"), ("$tup1d", "stupid"), ("f.i.l.t.h.y", "filthy"), ("breassssts", "breasts"), ("i***t", "idiot"), ("wothless", "worthless"), ("аsshоle", "asshole"), ("7r4$h", "trash"), ("f1l7hy", "filthy"), ("Wichsér", "wichser"), ("4n1m4l$", "animals"), ("n‍aked", "naked")],
)
def test_restored(restorer, shown, meant):
    assert restorer.token(shown).replace("\x01", "") == meant


@pytest.mark.parametrize("token", ["loses", "3d6", "scout", "vibro-spear", "1,200", "Cockpit", "Scunworth", "5th", "+10", "а", "все"])
def test_left_alone(restorer, token):
    assert restorer.token(token).replace("\x01", "").replace("\x02", "") == abuse._letters(token).strip(".+").replace("1,200", "1 200")


ABUSE = ["What a wothless crtin you are", "they breed like r a t s!", "SEND NUDES Bor, I want to see you N4KED and wet", "Verpiss dich, du Vollpfosten", "tu n'es qu'un connard, va crever Bor", "qué gilipollas eres, te voy a partir la cara", "All Grusk are miserable v****n and should be wiped out"]
FINE = ["You absolute legend, you killed it tonight.", "Posts with insults such as idiot or moron are removed by the moderators.", "My own stupid dice betrayed me again, what a weary evening.", "The vermin swarm deals 2d8 damage and must be wiped out by the scout.", "A naked blade lies in the hangar.", "The report quotes him: 'shut up', and the court fined the pilot.", "Chicken breast stew costs 3 marks.", "Garbage chute: DC 4, trash slides into the dock.", "The grapple hook of the bastard sword bites the envoy.", "Sex: female."]


@pytest.mark.parametrize("text", ABUSE)
def test_found(restorer, text):
    assert abuse.hits(restorer, f"A quiet line.\n{text}!!!")


@pytest.mark.parametrize("text", FINE)
def test_harmless(restorer, text):
    assert not abuse.hits(restorer, text)


def test_scores_on_a_table(spark):
    rows = [(i, t, "x") for i, t in enumerate(ABUSE + FINE)] + [(90, None, "x"), (91, "", "x"), (92, "word " * 50_000 + ABUSE[0], "x"), (0, ABUSE[0], "x"), (None, ABUSE[0], "x")]
    df = spark.createDataFrame(rows, "id long, text string, score string")
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1), (2, 7)], "doc_id long, toxic int")
    got = {r.id: r for r in abuse.abuse_scores(df, "id", "text", labels).collect()}
    assert set(got) == {*range(len(ABUSE)), 92} and all(0.5 <= r.score <= 1 for r in got.values())
    assert got[2].kinds == ["sexual"] and "hate" in got[1].kinds
    assert abuse.abuse_scores(df.limit(0), "id", "text").count() == 0


def test_a_cue_that_raters_refute_is_worth_little(spark):
    df = spark.createDataFrame([(i, "Sleep with one eye open, Bor.") for i in range(200)], "id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(200)], "doc_id long, toxic int")
    assert abuse.abuse_scores(df, "id", "text", labels).first().score < 0.5


def test_accuracy_on_rated_documents(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    even, odd = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    found = {r.id for r in abuse.abuse_scores(docs, "doc_id", "text", even).where("score >= 0.5").collect()}
    rated = [(r.doc_id, r.m) for r in odd.where("toxic IS NOT NULL").groupBy("doc_id").agg({"toxic": "avg"}).toDF("doc_id", "m").collect()]
    sure = [(i, m > 0.5) for i, m in rated if m != 0.5]
    assert sum((i in found) == t for i, t in sure) >= 0.93 * len(sure)


OTHER_WORDINGS = ["You are an idiot.", "You are a pathetic loser!", "you're such a m0r0n, Bor", "I will kill you.", "All elves are vermin.", "Du bist wirklich ein Trottel", "Ich bringe dich um!", "tu es vraiment un connard", "Je vais te tuer", "eres una idiota", "Te voy a matar", "Ты идиот", "Я тебя убью", "お前はバカだ", "さっさと死ね"]
OTHER_FINE = ["You are not an idiot.", "Calling someone an idiot gets you banned.", "You can kill the idiot droid.", "I will kill the engine.", "Du bist kein Trottel", "tu n'es pas un connard", "no eres idiota", "Ты не идиот", "「死ね」と書くことは禁止です。", "All animals are rats or birds of prey here.", "You find a worm in the garbage."]


@pytest.mark.parametrize("text", OTHER_WORDINGS)
def test_found_in_wordings_outside_the_phrases(restorer, text):
    assert abuse.hits(restorer, f"A quiet line.\n{text}")


@pytest.mark.parametrize("text", OTHER_FINE)
def test_harmless_outside_the_phrases(restorer, text):
    assert not abuse.hits(restorer, text)


@pytest.mark.parametrize("shown, meant", [("Hur3nsohn", "hurensohn"), ("p3ndej0", "pendejo"), ("tr0tt3l", "trottel"), ("c0nn@sse", "connasse"), ("p4r4sit3s", "parasites"), ("c0ckr0aches", "cockroaches"), ("pr1cks", "pricks"), ("schwchkopf", "schwachkopf"), ("идио***т", "идиот"), ("m0r" + "o" * 90 + "n", "moron"), ("m0r" + "o" * 50_000 + "n", "moron")])
def test_restored_whatever_the_cue_and_length(restorer, shown, meant):
    assert restorer.token(shown).replace("\x01", "") == meant


def test_long_tokens_are_left_alone(restorer):
    for token in ["a" + "1" * 100_000, "qwertz" * 20_000, "https://x.example/" + "a1-" * 20_000]:
        assert "\x01" not in restorer.token(token)


def test_disguised_in_other_languages(restorer):
    assert abuse.hits(restorer, "du Hur3nsohn") and abuse.hits(restorer, "eres un p3ndej0")


def test_the_language_model_decides_readings_outside_the_words(restorer):
    # A sign may stand for several letters, and no list has these words: the trigram model chooses among the paths.
    assert "ship" not in restorer.words and restorer.decode("5h1p")[0] == "ship" and restorer.decode("p1lo7")[0] == "pilot"
    assert restorer.token("c1rcu5") == "circus" and restorer.token("$c0u7") == "scout"
    flat = abuse.Restorer(np.zeros(28**3))
    assert any(flat.decode(shown)[0] != meant for shown, meant in (("o1d", "old"), ("5h1p", "ship"), ("p1lo7", "pilot"), ("anima1s", "animals"), ("ho1ds", "holds")))
    assert restorer.decode("anima1s")[0] == "animals" and restorer.decode("o1d")[0] == "old"


def test_open_search_is_linear_and_bounded(restorer):
    assert restorer.decode("a.1" * 5_000)[0] and restorer.decode("7" * 5)[0]
    assert restorer.decode("#")[0] == ""


def test_quoted_words_on_lines_that_forbid_them(restorer):
    for text in ("Do not write 'kill yourself' to anyone, it is forbidden.", 'Posts such as "you are an idiot" are removed.', "Wer „halt die Fresse“ schreibt, wird gesperrt, das ist verboten."):
        assert not abuse.hits(restorer, text)
    assert abuse.hits(restorer, "kill yourself, it is forbidden to miss you") and abuse.hits(restorer, 'I said "hello" and you are an idiot.')


STORY = ["The rats are vermin and should be cleared out of the hold.", "The prisoner was stripped naked by the guards.", "Round up the goblins and ship them to the mine.", "The gunner killed two pirates and the fight was over.", "Kill the engine, the dock is near."]


@pytest.mark.parametrize("text", STORY)
def test_story_and_play_are_harmless(restorer, text):
    assert not abuse.hits(restorer, text)


def test_sequences_are_learned_from_ratings(spark):
    """Wordings that no cue has: learned from some rated documents, found in others, whatever else these hold."""
    bad, fine = ["May the green lamp never shine on your door again, {}.", "Wipe the floor of every inn with {} and burn the mop."], ["The {} keeps the lamp of the inn alight.", "Nobody at the {} dock minds the floor."]
    names = [chr(97 + i % 26) * 2 + chr(97 + i // 26) for i in range(240)]
    rows = [(i, f"A quiet day at {n}.\n" + (bad[i // 2 % 2] if i % 2 else fine[i // 2 % 2]).format(n)) for i, n in enumerate(names)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, rows[1][1])], "id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(160)] + [(1, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    got = {r.id: r for r in abuse.abuse_scores(docs, "id", "text", labels).where("score >= 0.5").collect()}
    assert set(got) == {i for i in range(240) if i % 2} and got[201].kinds == ["learned"]
    assert abuse.abuse_scores(docs, "id", "text").count() == 0


def test_most_cases_are_found_without_ratings_of_their_wordings(spark):
    """Ratings of one half of the abusive wordings only: general features and idioms must find a good part of the other half, and hardly anything else."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rated = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg({"toxic": "avg"}).toDF("doc_id", "m").where("m <> 0.5").collect()
    found = {r.id for r in abuse.abuse_scores(docs, "doc_id", "text").where("score >= 0.5").collect()}
    toxic, other = {r.doc_id for r in rated if r.m > 0.5}, {r.doc_id for r in rated if r.m < 0.5}
    assert len(found & toxic) >= 0.5 * len(toxic) and len(found & other) <= 0.02 * len(other)
