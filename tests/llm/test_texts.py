"""Splitting, repeated lines, quality and boilerplate."""

import random
import re
from collections import defaultdict

import pytest

from quernstone.llm import boilerplate, repeated_lines, splitting, text_quality


@pytest.mark.parametrize("limit, overlap", [(80, 10), (200, 30), (50, 0)])
def test_pieces_overlap_and_give_the_text_back(spark, limit, overlap):
    rng = random.Random(limit)
    texts = ["", "short", "x" * 1000, "wörd 日本。" * 300] + ["".join(rng.choice(["word ", "end. ", "\n", "\n\n", "\n## head\n", "😀", "mid"]) for _ in range(rng.randrange(10, 900))) for _ in range(20)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(99, None, 1), (None, "y" * 500, 1)], "id long, body string, piece int")
    got = defaultdict(list)
    for r in splitting.split_texts(df, "id", "body", limit, overlap).collect():
        got[r.id].append(r)
    assert set(got) == set(range(len(texts)))
    for i, t in enumerate(texts):
        ps = sorted(got[i], key=lambda r: r.piece_no)
        assert [p.piece_no for p in ps] == list(range(1, len(ps) + 1)) and all(p.n_pieces == len(ps) and len(p.piece) <= limit for p in ps)
        assert (len(ps) > 1) == (len(t) > limit)
        for a, b in zip(ps, ps[1:]):
            assert b.piece.startswith(a.piece[-overlap:] if overlap else "") and b.start == a.end - overlap
        assert "".join(p.piece if k == 0 else p.piece[overlap:] for k, p in enumerate(ps)) == t


def test_cuts_prefer_strong_boundaries():
    text = "a b. " * 12 + "\n\n" + "c d. " * 12
    assert splitting.cuts(text, 100, 10)[0] == text.index("c d")
    headed = "a b. " * 11 + "\n\n" + "c d. " * 2 + "\n# head\n" + "e f. " * 11
    assert splitting.cuts(headed, 100, 10)[0] == headed.index("# head")


def test_bad_overlap(spark):
    with pytest.raises(ValueError):
        splitting.split_texts(spark.createDataFrame([(1, "a")], "id int, t string"), "id", "t", 10, 5)


def test_repeated_lines_by_brute_force(spark):
    rng = random.Random(7)
    lines = ["Legal  notice 12", "legal notice 99", "Share\tthis page", "one", "2 3 4", "LEGAL NOTICE 1 ", "", "  ", "Été à Paris", "x-y", "unique line {}"]
    docs = [(i, rng.choice(["h1", "h1", "h1", "h2", None]), rng.choice([None, ""]) if rng.random() < 0.1 else "\n".join(rng.choice(lines).format(i) for _ in range(rng.randrange(1, 9)))) for i in range(80)]
    df = spark.createDataFrame([(*x, "z") for x in docs], "id long, host string, text string, line_no string")
    norm = lambda s: re.sub(r"\s+", " ", re.sub(r"[0-9]+", "0", s.lower())).strip()
    seen = defaultdict(set)
    for i, h, t in docs:
        for s in (t or "").split("\n"):
            if len(re.findall(r"[^\W\d_]+", s)) >= 2:
                seen[h, norm(s)].add(i)
    want = {(i, n) for i, h, t in docs if t is not None for n, s in enumerate(t.split("\n"), 1) if len(seen.get((h, norm(s)), ())) >= 6}
    found = repeated_lines.repeated_lines(df, "id", "host", "text", 6)
    assert {tuple(r) for r in found.collect()} == want and want
    clean = {r.id: r for r in repeated_lines.without_lines(df, "id", "text", found).collect()}
    for i, _, t in docs:
        assert clean[i].text == (None if t is None else "\n".join(s for n, s in enumerate(t.split("\n"), 1) if (i, n) not in want))
        assert clean[i].line_no == "z"
    assert repeated_lines.repeated_lines(df.limit(0), "id", "host", "text").count() == 0
    half = repeated_lines.repeated_lines(df, "id", "host", "text", 1, min_share=0.5)
    assert {tuple(r) for r in half.collect()} <= {tuple(r) for r in repeated_lines.repeated_lines(df, "id", "host", "text", 1).collect()}


def test_quality_tells_prose_from_the_rest(spark):
    prose = {
        1: "The party met a scout in the hangar and nobody at the dock keeps a record of it. It was a long day for all of them.",
        2: "- The children of the rim learn to ride from the guilds.\n- A rail bow costs more than it did in the old days.",
        3: "THE WARDEN SHARES A LANTERN WITH THE PILOT AND THE SCOUT WHEN THE TIDE TURNS",
        4: "Der alte Händler wartet am Hafen und die Gruppe lacht darüber.",
        5: "疲れた番人は古い塔の前で仲間を待っている。若い操縦士は港で地図を読み違えた。",
        6: "Старый торговец ждёт в порту и все смеются, хотя снаружи буря.",
    }
    junk = {
        11: "| A | B |\n| --- | --- |\n| 1 | 2 |", 12: "Kel Vor\nRan Dol\nSim Tak", 13: "1 2 3 4 5\n6 7 8 9 10", 14: "buy the buy the buy the buy the buy the buy the buy the", 15: "%>-\\#=$~_:!!*!;<|:+/",
        16: "L e z a z o g i s h  N o c t u r n e  w a r d", 17: "РѕСЃРјР»РјРµ Р°РёРіСЃР° Рё РІ Р»РµР»Р»РѕРє", 18: "qnqt kid dgpw lrti qixs rql zuhq bcdg muhu\nhvzw cizw tswo ukdg iitu twex koih",
    }
    frame = "# Title of the page\n\n> Source: [x](http://h/a_(b)) · Retrieved.\n\n{}\n\nLoading comments...\n"
    rows = [(i, frame.format(t), 1) for i, t in (prose | junk).items()] + [(50, None, 1), (51, "", 1), (52, " \n ", 1), (53, "# T\nLoading comments...", 1), (54, "the word " * 60_000, 1)]
    got = {r.id: r for r in text_quality.quality(spark.createDataFrame(rows, "id long, t string, words int"), "id", "t").collect()}
    assert {i for i, r in got.items() if "not_prose" in r.reasons} == set(junk) | {54}
    assert 50 not in got and 51 not in got and 52 not in got and 53 not in got
    assert got[3].words == 15 and got[2].bullet_share == 1.0 and "bullets" in got[2].reasons
    assert text_quality.quality(spark.createDataFrame([], "id long, t string"), "id", "t").count() == 0


def test_links_count_by_their_anchor():
    c = text_quality.line_counts(["See [the Keel (x)](http://h/a_(b) \"t\") and more", "![](//h/x.png)"], False)
    assert c["words"].tolist() == [6] and c["chars"].tolist() == [len("SeetheKeel(x)andmore")]


PAGE = """Home | Log in | Recent changes
Start > Rules > Keel
Posted by Ada Bor on 3 May 2024
# Keel
We use cookies to remember your login. Accept all or manage settings.
Accept

The bakers of Dol sell cookies by the ice dock and nobody at the harbour minds.
## Keel History
Sign in at the salt market, share the rail bow and mind the terms: the pilot of the ship carries two lanterns.
- **Ward:** Old songs mention the keel.
| A | B |
| --- | --- |
Related pages

- Ember Oath
- Glass Keel
Kel Vor (Ride 3)
### Popular this week
Dirge Maxim
Advertisement
Share this page with your group!
Log in
© 2024 example, all rights reserved.
Terms of use | Privacy | Imprint"""


def test_boilerplate(spark):
    rows = [(i, f"site{i % 3}.example", PAGE, "x") for i in range(9)] + [(20, None, PAGE, "x"), (21, "a", None, "x"), (22, "a", "", "x"), (None, "a", PAGE, "x")]
    df = spark.createDataFrame(rows, "id long, host string, md string, path string")
    got = defaultdict(set)
    for r in boilerplate.furniture(df, "id", "host", "md").collect():
        got[r.id].add(r.line_no)
    main = {"# Keel", "The bakers", "## Keel", "Sign in at", "- **Ward", "| A", "| ---", "Kel Vor"}
    want = {n for n, s in enumerate(PAGE.split("\n"), 1) if s.strip() and not any(s.startswith(m) for m in main)}
    assert set(got) == {*range(9), 20} and all(got[i] == want for i in got)
    assert boilerplate.furniture(df.limit(0), "id", "host", "md").count() == 0


def test_hosts_outvote_a_cue(spark):
    line = "Follow us"
    rows = [(i, f"h{i}", f"# T\n{line}\nThe text of the page is here, as it should be.") for i in range(4)]
    found = boilerplate.furniture(spark.createDataFrame(rows, "id long, host string, md string"), "id", "host", "md")
    assert {tuple(r) for r in found.collect()} == {(i, 2) for i in range(4)}


def test_undecided_lines_follow_the_vote_of_hosts(spark):
    def page(host, n):
        entry = [f"# Entry {chr(65 + n)}", "- **Cost:** 5 marks", f"- Rifle {chr(65 + n)}"]
        return "\n".join(["Wanderkarte", *entry, "Back to top", "Zum Seitenanfang"] if host != "shop.example" else ["Rifle A | Rifle B", *entry])

    hosts = ["reefs.example", "kilns.example", "shop.example"]
    rows = [(10 * h + n, host, page(host, n)) for h, host in enumerate(hosts) for n in range(6)]
    rows += [(90, "one.example", "# Entry\n- **Cost:** 5 marks\n- Rifle A\nZum Seitenanfang")]
    found = boilerplate.furniture(spark.createDataFrame(rows, "id long, host string, md string"), "id", "host", "md")
    lines = {(r.id, r.line_no) for r in found.collect()}
    # "Wanderkarte" and "Zum Seitenanfang" have no cue; they stand on all entries, at places where hosts show furniture. A label of one host's menu doesn't mark lists elsewhere, one that most hosts lost does.
    assert {(i, n) for i, n in lines if i < 20} == {(10 * h + n, k) for h in (0, 1) for n in range(6) for k in (1, 5, 6)}
    assert {(i, n) for i, n in lines if i >= 90} == {(90, 4)}


def test_long_furniture_lines(spark):
    consent = "We use cookies to measure how pages are read, and you choose which of them you allow. " * 5
    legal = "All rights reserved to the friends of this wiki. Text on this page is under an open licence. " * 4
    menu = " | ".join(f"Gallery of {w}" for w in ["maps", "ships", "towns", "moons", "reefs", "forts", "crews", "tools"] * 4)
    story = "The kiln masters of the reef keep the old lamps lit. " * 8 + "They sell cookies and accept copper marks."
    rows = [(1, "kilns.example", "\n".join(["# Kiln", consent.strip(), story, legal.strip(), menu, "- " + story]))]
    found = boilerplate.furniture(spark.createDataFrame(rows, "id long, host string, md string"), "id", "host", "md")
    assert {tuple(r) for r in found.collect()} == {(1, 2), (1, 4), (1, 5)}


def _sites(extra):
    """Pages of five hosts with 24 entries each; extra(host, n) gives more lines as (above, within, below)."""
    rows = []
    for h in range(5):
        for n in range(24):
            above, within, below = extra(h, n)
            word = f"{chr(97 + h)}{chr(97 + n)}"
            body = [f"# Entry {word.upper()}", f"The {word} of the reef keeps the old lamps lit through the long night of the flood.", *within, f"- **Cost of {word}:** 5 marks", f"Nobody at the {word} harbour minds the copper dust that the winds carry in."]
            rows.append((100 * h + n, f"site{h}.example", "\n".join([*above, *body, *below])))
    return rows


def _lost(spark, rows, **more):
    found = boilerplate.furniture(spark.createDataFrame(rows, "id long, host string, md string"), "id", "host", "md", **more)
    return {(r.id, r.line_no) for r in found.collect()}


def test_the_vote_turns_lines_against_their_own_score(spark):
    shared, own = "The keepers of these rooms wish every guest a calm and pleasant evening.", "The smugglers at pier nine traded cookies for a letter, and the clerk must accept or click his tongue."
    assert boilerplate._read(own, "site0.example", "site0", True)[2] == -1 and boilerplate._read(shared, "site0.example", "site0", True)[2] == 1
    rows = _sites(lambda h, n: ([], [own] if (h, n) == (2, 7) else [], [shared] if n % 2 else []))
    lost = _lost(spark, rows)
    # The sentence without a cue stands on half of each site's entries and is dropped; the sentence with one is an entry's own and is kept.
    assert lost == {(100 * h + n, 6 if (h, n) == (2, 7) else 5) for h in range(5) for n in range(24) if n % 2}
    # A consent notice with the same cue that stands on many entries stays furniture.
    lost = _lost(spark, _sites(lambda h, n: ([], [own] if n % 3 == 0 else [], [])))
    assert lost == {(100 * h + n, 3) for h in range(5) for n in range(0, 24, 3)}


def test_an_entry_copied_by_mirrors_is_no_furniture(spark):
    line = "The first keeper of the reef wrote this very sentence on the wall of the lamp house."
    rows = _sites(lambda h, n: ([], [], []))
    rows += [(900 + h, f"site{h}.example", f"# The lamp house\n{line}\n- **Cost:** 4 marks") for h in range(5)]
    assert _lost(spark, rows) == set()


def test_boxes_follow_the_vote_on_the_line_above_them(spark):
    box = lambda h, n: ["### From the archive", f"Lamp {chr(65 + n)}", f"Reef {chr(65 + (n + 3) % 24)}", f"Kiln {chr(65 + (n + h) % 24)}"]
    lost = _lost(spark, _sites(lambda h, n: (box(h, n) if n % 2 else [], [], [])))
    assert lost == {(100 * h + n, k) for h in range(5) for n in range(24) if n % 2 for k in (1, 2, 3, 4)}
    # Names under headings that only one entry has are its own.
    assert _lost(spark, _sites(lambda h, n: ([], [f"## Keepers of {chr(65 + h)}{chr(65 + n)}", "- Bor Hald", "- Kel Vor", "- Ran Dol"], []))) == set()


def test_votes_alone_find_nearly_all_that_cues_find(spark):
    raw = spark.read.parquet("/root/testdata/sf0.01/page_raw.parquet")
    got = [{tuple(r) for r in boilerplate.furniture(raw, "raw_id", "source_host", "md", cues=c).collect()} for c in (True, False)]
    assert len(got[0] & got[1]) >= 0.93 * len(got[0]) and len(got[1] - got[0]) <= 0.01 * len(got[1])
    rows = boilerplate.containers(raw, "raw_id", "source_host", "md")
    assert boilerplate.path_votes(rows).where("verdict <> signum(score)").count() > 0


def test_letters_of_other_alphabets_are_no_debris():
    for text in ("Її сестра Ґаля пише з Європи, а їжак і ґава чекають.", "Његова сестра живи у Љубљани, а ђак и ћерка ћуте.", "РОСТОВ и СССР, Россия и Сибирь", "Ёлка у дома и ещё одна"):
        assert text_quality.line_counts([text], False)["debris"].tolist() == [0]
    assert text_quality.line_counts(["РѕСЃРјР»РјРµ Р°РёРіСЃР°"], False)["debris"].iloc[0] > 8
