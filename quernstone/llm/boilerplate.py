"""Main content of web pages among the furniture of their sites (problem 3).

Consensus host paths, for pages kept as Markdown. A page's containers are its lines and its boxes (a line such
as "related pages" with the names under it). A container's generalised path is its kind (menu bar, link bullet, sentence, item ...)
with its text, in which the host is "~", digits are 0 and, outside of sentences, names are "^", as a tag path with classes would be in HTML.
The path of a name in a box is that of the line above the box. Three steps:

1. Each page scores its containers: -1 for menu shapes and for wording of consent, advertisement, sharing, comment, legal ... (cues), 1 for sentences,
   2 for headings, tables and labelled bullets; other short lines, and headings of bare lists of names, score 0.
2. Hosts vote, one vote a host and path: the mean score of the host's pages, less RECURRING if the path stands on many of the host's entries,
   or on several hosts over different entries, and plus OWN_WORDS for a sentence that only one or two entries of a large host have, within their text.
3. The pages are read again with the winning paths: a container is furniture if its path lost on its host, against its own score where need be: a
   sentence without a cue that the site repeats is dropped, a sentence with a cue that is an entry's own is kept. Where the host is undecided,
   the majority of the other hosts decides, and then the vote on paths generalised further, to form, place on the page and share of entries.
   Labels of menus are voted on too, and need a majority of the hosts that show them; an undecided line made of labels is furniture if all of them lost.
"""

import re
import textwrap
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.sources.scratch import materialize
from quernstone.sources.tables import spread

# Cues by kind of furniture, matched against the line in lower case with the host's name as "~".
CUES = {
    "consent": r"\bcookies?\b.*\b(accept|settings|policy|choose|consent|manage|allow|continue|click|privacy|akzeptieren|accepter|aceptar|configurar|withdraw|remember|statistics|measure|servers)\b|\b(stores small files|process data|tracking is needed|your privacy matters|we (use|set) cookies|nous utilisons des cookies|wir verwenden cookies|usamos cookies)\b",
    "button": r"^\W*(accept|settings|reject|more|accept all|reject all|manage settings|ok|got it|i agree|akzeptieren|ablehnen|einstellungen|accepter|refuser|aceptar|rechazar|configurar)\W*$",
    "stamp": r"^(posted|published|written|edited|updated|last (edited|updated|modified|changed))\b.*\b(by|on|at)\b.*\d|\b\d+ views$",
    "advert": r"^(advertisement|anzeige|publicité|publicidad|werbung|реклама|ad)(\W|$)|^(sponsored|promoted|partner)( content| post)?:|\bour shop has\b|^win an? .*!|\bdraw ends on\b|\border before the\b|\d+ ?% off\b",
    "access": r"\bblocks our banners\b|\bhide the ads\b|\bfree articles?\b|\bunlock all\b|\bfree account\b|\bmembers read without\b|\bpages read\b",
    "letter": r"\bnewsletter\b|\bnever miss an update\b|\be-?mail address\b|\breaders of the\b.*\bletter\b|\bweekly entries\b|\blettre de ~|\bleave us your address\b|\babonnez-vous\b|\bsuscríbete\b|\bget the app\b|\bread offline\b",
    "login": r"^(you must be |please )?(log(ged)? in|sign(ed)? (in|up))\b.{0,40}$|\bguests cannot post\b|\bmust be logged in\b",
    "related": r"^\W*(you may also like|related (pages|entries|articles|posts)|popular (this|pages|now|posts|entries)|recent (edits|changes|pages|posts|entries)|most read|read (next|also)|trending)\b.{0,20}(:|$|\*\*)",
    "share": r"^(share|tweet|pin it|post it|copy link|forward this|tell (a friend|your table)|like what you read|enjoyed this|follow (~|us))\b.{0,60}$|^(teilen|partager|compartir|share( on)?):|\brate it with\b|\b\d+ likes\b|\breading list\b|\bprint version\b|\bdownload as pdf\b|\bcite this page\b|\bthis (page|entry) helpful\b|\bjoin the discussion\b",
    "comment": r"^(comments? are closed|loading comments|leave a (reply|comment)|user avatar|reply · quote|show \d+ more|sort by:|be the first to comment|\d+ comments?\b)|\bview the comments\b",
    "footer": r"^(©|\(c\) ?\d|copyright \d|back to top|powered by|terms of use|legal notice|privacy policy|report a problem|imprint|~ is (not affiliated|a fan work)|run by the friends|text on ~|all content by|this page was last touched|alle inhalte)(\W|$)|\ball rights reserved\b|\bno warranty of\b|\bhosted by volunteers\b|\bopen licen[cs]e\b|\bkind permission\b|\bnames belong to their owners\b|\bcredit the page\b|\bdata protection\b",
}
# Words of which a line must have one for the cue to match.
CUE_WORDS = {
    "consent": "cookie cookies stores process tracking privacy consent nous utilisons verwenden usamos",
    "button": "accept settings reject more ok got agree akzeptieren ablehnen einstellungen accepter refuser aceptar rechazar configurar",
    "stamp": "posted published written edited updated last views",
    "advert": "advertisement anzeige publicité publicidad werbung реклама ad sponsored promoted partner shop win draw order off",
    "access": "banners ads article articles unlock account members pages",
    "letter": "newsletter update mail email readers weekly lettre address abonnez suscríbete app offline",
    "login": "log logged sign signed login guests must",
    "related": "like related popular recent most read trending",
    "share": "like share tweet pin post copy forward tell enjoyed follow teilen partager compartir rate likes list version pdf cite helpful discussion",
    "comment": "comment comments leave avatar reply show sort first",
    "footer": "© c copyright top powered terms legal policy report imprint ~ friends content touched inhalte rights warranty hosted licence license permission owners credit protection",
}
# Labels that menus of most sites have.
LABELS = ["home", "help", "log in", "log out", "login", "sign in", "sign up", "register", "about us", "about", "contact", "search", "search this site", "site map", "sitemap", "menu", "privacy", "terms", "faq", "forum", "shop", "blog", "newsletter"]

#: Sentences longer than this without a cue show, as headings, tables and labelled bullets do, where an entry stands on its page.
LONG = 160
#: Hosts with fewer entries than this don't vote on paths generalised to form, place and share.
LEAST_ENTRIES = 4
#: A path on at most OWN entries of its host is their own, if the host has at least LARGE; one on at least MANY of them stands on many.
OWN, LARGE, MANY = 2, 20, 0.1
#: What weighs against a path that recurs, and for a sentence that doesn't.
RECURRING, OWN_WORDS = 1.5, 1.5
#: A sentence recurs on its host if at least so many and this share of the host's entries have it, and at least this share of them above or below their text.
SENTENCE_COPIES, SENTENCE_SHARE, AT_EDGE = 6, 0.5, 0.8
#: Entries (on a host) and hosts that another recurring path stands on at least.
LEAST_COPIES, LEAST_HOSTS = 3, 3
#: Lines longer than this are cut at their sentences, and these after so many characters; a cue must hold for more than half of such a line.
LONGEST = 300

_CUES = [(name, re.compile(pattern)) for name, pattern in CUES.items()]
_HINTS: dict[str, list[int]] = {}
for _n, _name in enumerate(CUES):
    for _w in CUE_WORDS[_name].split():
        _HINTS.setdefault(_w, []).append(_n)
_WORDS = re.compile(r"[^\W\d_]+|[~©]")
_UNSEEN = dict.fromkeys(map(ord, "\u200b\ufeff"), " ")
_SENTENCE = re.compile(r"(?<=[.!?…。]) ")
_ENDS = ".!?…:;,。"
_UPPER = r"[A-Z\u00c0-\u00de\u0410-\u042f]"
_ENTRY = re.compile(rf"(?:[-*•] )?{_UPPER}[\w'’-]*(?: {_UPPER}[\w'’-]*)*(?: \(\d[\w ]* ago\))?")
_NAMES = re.compile(rf"{_UPPER}[\w'’-]*(?:[ ,|·]+{_UPPER}[\w'’-]*)*")
_PLAIN = re.compile(r"(?<![\w'’-])[a-zß-öø-ÿа-я]+")
_MENU_LINK = re.compile(r"[-*•] \[([^\]]*)\]\([^)]*\)")
_MENU_BAR = re.compile(r"[^|>.]{1,30}(?: \| [^|>.]{1,30})+")
_MENU_LINKS = re.compile(r"\[[^\]]*\]\([^)]*\)(?: [·|] \[[^\]]*\]\([^)]*\))*")
_ANCHOR = re.compile(r"\[([^\]]*)\]")
_CRUMB = re.compile(r"[^>|]{1,40}(?: > [^>|]{1,60})+")
_JOIN = re.compile(r"(?<=[a-zà-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ])")
_DIGITS = re.compile(r"\d+")
MOST_LINES = 150_000


def _kind(s: str) -> str:
    """The shape of a line."""
    first, listed = s[0], s[:2] in ("- ", "* ", "• ")
    if first == "#" and s.lstrip("#")[:1] == " ":
        return "heading"
    if first == "|":
        return "table"
    if listed:
        return "labelled" if s[2:4] == "**" else "menu link" if "](" in s and _MENU_LINK.fullmatch(s) else "bullet" if len(s) <= LONGEST else "text"
    if " | " in s and _MENU_BAR.fullmatch(s):
        return "menu bar"
    if first == "[" and _MENU_LINKS.fullmatch(s):
        return "menu links"
    if " > " in s and _CRUMB.fullmatch(s):
        return "breadcrumb"
    return "short" if len(s) <= 90 and s[-1] not in _ENDS and s.count(" ") < 8 else "text"


def _labels(s: str, kind: str) -> list[str] | None:
    """Labels of a line that might be a menu, in lower case."""
    if kind in ("menu link", "menu links"):
        found = _ANCHOR.findall(s)
    elif kind == "menu bar":
        found = s.split(" | ")
    elif kind in ("bullet", "short", "text") and len(s) <= LONG:
        found = _JOIN.split(s[2:] if kind == "bullet" else s)
    else:
        return None
    return [x.strip().lower() for x in found]


def _first_cue(low: str) -> str | None:
    may = {n for w in _WORDS.findall(low) if w in _HINTS for n in _HINTS[w]}
    return next((_CUES[n][0] for n in sorted(may) if _CUES[n][1].search(low)), None)


def _cue(low: str) -> str | None:
    """The first cue that holds for a line in lower case: anywhere in it, or in most of a long line's sentences."""
    if len(low) <= LONGEST:
        return _first_cue(low)
    cue, left = None, len(low) / 2  # characters that may be without a cue
    for sentence in _SENTENCE.split(low):
        for part in textwrap.wrap(sentence, LONGEST) if len(sentence) > LONGEST else [sentence]:
            got = _first_cue(part)
            cue = cue or got
            if not got:
                left -= len(part)
                if left <= 0:
                    return None
    return cue


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _path(s: str, low: str, kind: str) -> int:
    """The generalised path of a line. Names are generalised where other words make up the line, and not in sentences."""
    if kind in ("short", "bullet", "text") and s[-1] not in _ENDS and not s.isupper() and not _SENTENCE.search(s):
        first, _, rest = s.partition(" ")
        if len(_PLAIN.findall(rest)) >= 2:
            low = f"{first} {_NAMES.sub('^', rest)}".lower()
    return _hash(f"{kind}\n{_DIGITS.sub('0', low)}")


def _read(s: str, host: str, base: str, cues: bool) -> tuple:
    """(kind, cue, score, path, labels, whether it is a bare name) of a tidy line."""
    kind = _kind(s)
    low, cue = s.lower(), None
    if base:
        low = low.replace(host, "~").replace(base, "~")
    if cues and kind not in ("table", "labelled"):
        cue = _cue(low)
    if cue is None and kind in ("menu bar", "menu links", "breadcrumb"):
        cue = kind
    score = -1 if cue else 2 if kind in ("heading", "table", "labelled") else 0
    if kind == "text" and score == 0:
        glued = len(s) <= LONG and s[-1] not in _ENDS and len(_JOIN.findall(s)) >= 2  # a menu whose labels run together
        score = 1 if s.count(" ") >= 4 and not glued else 0
    return kind, cue, score, _path(s, low, kind), _labels(s, kind) if score <= 0 else None, _ENTRY.fullmatch(s) is not None


def _page(text: str, host: str, base: str, known: dict, cues: bool) -> tuple[list, int | None]:
    """[(line_no, kind, cue, score, path, labels)] of a page's lines with their place, and the key of its entry if it shows one."""
    lines: list[list] = []
    for n, line in enumerate(text.split("\n"), 1):
        s = " ".join((line if line.isascii() else line.translate(_UNSEEN)).split())
        if s:
            got = known.get((s, base))
            if got is None:
                got = _read(s, host, base, cues)
                if len(s) <= 120:
                    if len(known) > MOST_LINES:
                        known.clear()
                    known[s, base] = got
            lines.append([n, *got, len(s)])
    out, entry, first, last, at = [], None, 0, 0, 0
    while at < len(lines):
        n, kind, cue, score, path, labels, name, size = lines[at]
        at += 1
        run = at
        if not name or cue:  # a line above bare names
            while run < len(lines) and lines[run][6] and not lines[run][2]:
                run += 1
        boxed = cue == "related" or run - at >= 2 and kind in ("heading", "short", "bullet", "text") and score != 1
        if boxed:
            score = min(score, 0)
        out.append((n, kind, cue, score, path, labels))
        if boxed:
            inside = _hash(f"box\n{path}")
            while at < len(lines) and (lines[at][6] and not lines[at][2] or cue == "related" and lines[at][2] == "button"):
                b = lines[at]
                out.append((b[0], b[1], b[2], b[3], b[4], b[5]) if b[2] else (b[0], "box", None, -1, inside, None) if cue == "related" else (b[0], "box", None, 0, inside, b[5]))
                at += 1
        elif score == 2 or score == 1 and size > LONG:
            first, last = first or n, n
            if entry is None and kind in ("heading", "text"):
                entry = path
    return [("above" if x[0] < first else "below" if x[0] > last > 0 else "within", *x) for x in out], entry


def _containers(cues: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[str, str], tuple] = {}
        for pdf in batches:
            rows = []
            for i, host, site, text in zip(pdf["id"], pdf["host"], pdf["site"], pdf["text"]):
                name = host.lower() if isinstance(host, str) else ""
                lines, entry = _page(text, name, name.partition(".")[0], known, cues)
                entry = i if entry is None else entry
                rows += [(i, site, entry, *x) for x in lines]
            yield pd.DataFrame(rows, columns=["id", "site", "entry", "place", "line_no", "kind", "cue", "score", "path", "labels"])

    return run


def containers(df: DataFrame, id_col: str, host_col: str, text_col: str, cues: bool = True) -> DataFrame:
    """Lines as (id, site, entry, place, line_no, kind, cue, score, path, labels): score -1 furniture, 0 undecided, 1 and 2 main content.

    site is a hash of the host. entry is a key of the page's first heading, else of its first long text, else its id: fetches and revisions share it.
    place is above, within or below the headings, tables, labelled bullets and long sentences without a cue. Without `cues`, wording isn't scored.
    """
    pages = df.select(F.col(id_col).cast("long").alias("id"), F.col(host_col).alias("host"), F.xxhash64(host_col).alias("site"), F.col(text_col).alias("text"))
    pages = spread(pages.where("id IS NOT NULL AND text IS NOT NULL"))
    return pages.mapInPandas(_containers(cues), "id long, site long, entry long, place string, line_no long, kind string, cue string, score int, path long, labels array<string>")


def path_votes(rows: DataFrame) -> DataFrame:
    """(site, path, score, verdict) of the paths of containers that have a verdict: below 0 furniture, above 0 main content. Headings, tables and labelled bullets take no part."""
    at = ("above", "within", "below")
    # An entry's copies of a path first: a path that stands on all pages of a large host is many small groups then.
    per = rows.where("score < 2").groupBy("site", "path", "entry").agg(
        F.sum("score").alias("score"), F.count("*").alias("rows"), F.first(F.col("kind") == "text").alias("sentence"), *[F.count_if(F.col("place") == x).alias(x) for x in at]
    )
    paths = per.groupBy("site", "path").agg(
        F.count("*").alias("n"), F.min("entry").alias("least"), (F.sum("score") / F.sum("rows")).alias("score"), F.first("sentence").alias("sentence"), F.sum("rows").alias("rows"), *[F.sum(x).alias(x) for x in at]
    )
    sizes = rows.groupBy("site", "entry").agg(F.lit(1).alias("one")).groupBy("site").agg(F.count("*").alias("entries"))
    edge = (F.col("above") + F.col("below")) / F.col("rows")
    often = (F.col("n") >= SENTENCE_COPIES) & (F.col("n") >= SENTENCE_SHARE * F.col("entries")) & (edge >= AT_EDGE)
    many = F.when(F.col("sentence"), often).otherwise((F.col("n") >= LEAST_COPIES) & (F.col("n") >= MANY * F.col("entries")))
    own = F.col("sentence") & (F.col("n") <= OWN) & (F.col("entries") >= LARGE) & (edge == 0)
    paths = materialize(paths.join(sizes, "site").withColumns({"many": many, "own": own}), "paths")
    vote = F.signum(F.col("score") - F.when(F.col("many"), RECURRING).otherwise(0) + F.when(F.col("own"), OWN_WORDS).otherwise(0))
    # A mirror repeats an entry's text on one entry; furniture stands on different ones.
    hosts = paths.groupBy("path").agg(F.count("*").alias("hosts"), F.count_distinct("least").alias("entries_of_hosts"), F.signum(F.sum(vote)).alias("majority"))
    shared = (F.col("hosts") >= LEAST_HOSTS) & (F.col("entries_of_hosts") >= LEAST_HOSTS)
    joined = paths.join(hosts.where("hosts > 1"), "path", "left").withColumn("shared", F.coalesce(shared, F.lit(False)))
    told = F.signum(F.col("score") - F.when(F.col("many") | F.col("shared"), RECURRING).otherwise(0) + F.when(F.col("own") & ~F.col("shared"), OWN_WORDS).otherwise(0))
    place = F.when(F.col("within") * 2 >= F.col("rows"), "within").when(F.col("above") >= F.col("below"), "above").otherwise("below")
    share = F.when(F.col("n") <= OWN, "own").otherwise(F.concat(place, F.when(F.col("n") >= MANY * F.col("entries"), " many").otherwise(" some")))
    form = F.when(F.col("sentence"), "sentence ").otherwise("item ")
    told_or = F.when(told != 0, told).otherwise(F.coalesce("majority", F.lit(0.0)))
    general = joined.select("site", "path", "score", "entries", told_or.alias("verdict"), F.concat(form, share).alias("general"))
    general = materialize(general, "votes")
    by_host = general.where((F.col("entries") >= LEAST_ENTRIES) & (F.col("verdict") != 0)).groupBy("site", "general").agg(F.signum(F.sum("verdict")).alias("vote"))
    by_path = by_host.groupBy("general").agg(F.signum(F.sum("vote")).alias("all_hosts"))  # at most 14 rows
    # What one or two entries of a host alone have is theirs.
    mine = F.when(F.col("general").endswith(" own"), (F.col("entries") >= LEAST_ENTRIES).cast("double"))
    rest = general.where("verdict = 0").join(by_host, ["site", "general"], "left").join(F.broadcast(by_path), "general", "left")
    rest = rest.select("site", "path", "score", F.coalesce(mine, F.nullif("vote", F.lit(0.0)), "all_hosts", F.lit(0.0)).alias("verdict"))
    return general.where("verdict <> 0").select("site", "path", "score", "verdict").union(rest.where("verdict <> 0"))


def _lost_labels(shown: DataFrame, spark) -> DataFrame:
    """(site, label) of lost labels out of (site, label, worth), one row a line: lost on the host itself, or on the majority of hosts that show them."""
    by_host = shown.groupBy("site", "label").agg(F.signum(F.sum("worth")).alias("vote"))
    fixed = spark.createDataFrame([("", x, -1.0) for x in LABELS], "site string, label string, vote double")
    by_label = by_host.union(fixed).groupBy("label").agg(F.sum("vote").alias("hosts"))
    return by_host.join(by_label, "label").where("vote < 0 OR hosts < 0").select("site", "label")


def furniture(df: DataFrame, id_col: str, host_col: str, text_col: str, cues: bool = True) -> DataFrame:
    """(id, line_no) of the non-blank lines of each page that are no main content; line_no from 1, split at line feeds.

    Null and empty texts have no lines. A null host is a host of its own. Rows with a null id are left out. Rows with equal ids are read on their own, and their
    lines come once. An empty table gives an empty result; extra columns are ignored. Without `cues` structure and votes alone decide.
    """
    rows = materialize(containers(df, id_col, host_col, text_col, cues), "containers")
    # Only verdicts that differ from a container's own score are joined back.
    turned = path_votes(rows).where("verdict <> signum(score)").select("site", "path", F.col("verdict").cast("int").alias("verdict"))
    told = rows.where("score < 2").select("id", "line_no", "site", "path", "score", F.when(F.col("score") == 0, F.col("labels")).alias("labels")).join(turned, ["site", "path"], "left")
    told = materialize(told.select("id", "line_no", "site", F.coalesce("verdict", "score").alias("verdict"), "labels").where("verdict < 0 OR labels IS NOT NULL"), "decided")
    # Labels: menu-shaped lines and lost lines show them as furniture, other undecided lines as content.
    menus = rows.where(F.col("kind").isin("menu bar", "menu links", "menu link")).select("site", F.explode("labels").alias("label"), F.lit(-1.0).alias("worth"))
    shown = told.where("labels IS NOT NULL").select("id", "line_no", "site", "verdict", F.size("labels").alias("n"), F.explode("labels").alias("label"))
    lost = _lost_labels(menus.union(shown.select("site", "label", F.col("verdict").cast("double").alias("worth"))).where("label <> ''"), df.sparkSession)
    labelled = shown.join(lost, ["site", "label"], "left_semi").groupBy("id", "line_no", "n").agg(F.count("*").alias("k")).where("k = n").select("id", "line_no")
    return told.where("verdict < 0").select("id", "line_no").union(labelled).distinct()
