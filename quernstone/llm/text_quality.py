"""Per-document text quality statistics and fixed-threshold rules (problem 2).

A batch of texts becomes one array of code points, and every count (characters, letters, words, common
words, table bars, wide gaps ...) is an array operation over all its lines at once: classes of
characters come from one lookup table, words from the places where letters begin and end, common words from word hashes.
A document's statistics are sums over its lines. Rules compare them with fixed thresholds, mostly those published
for web-text filters (word counts, mean word length, symbol and bullet shares, least number of stop words), and
each failed rule leaves its name in `reasons`. The share of characters in running text comes from the
same counts: a line is running text if common words of some language make up enough of it and it is no
table row, gapped row, repetition or debris.
"""

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.sources.tables import spread

# Common words by language.
COMMON = {
    "en": "the of and to in is with for by that on at no from as it its has been have this not you your any each who when which while until unless if but so than can may must one two was be are or an nobody most players against after before between near does do i we they he she my our their will would what where there all some more out up about into over only like".split(),
    "de": "der die das und den dem ein eine einen einer ist im von mit auf für nach bevor weil obwohl damit wenn ohne zu am aus unsere jede kein darf wird ich du er sie es wir nicht auch bei als".split(),
    "fr": "le la les un une des du de et en au aux par pour dans sur qui que est ne pas après avant chaque notre peut quand sans tout il elle je vous nous son sa ce".split(),
    "es": "el los las una unos del y con por para que su al lo cada puede antes después cuando nuestro todos es en se sin no como pero más".split(),
    "ru": "и в на не с по за что как до его после когда для без из от каждый наша это все у о же то он она они мы".split(),
}
# Thresholds.
RULES = {"min_words": 3, "min_mean_word": 2.0, "max_mean_word": 10.0, "max_symbols": 0.4, "min_alpha_words": 0.3, "max_bullets": 0.9, "min_common": 2, "min_prose": 0.5}

_LINK = re.compile(r"!?\[([^\[\]\n]*+(?:\[[^\[\]\n]*+\][^\[\]\n]*+){0,4})\]\([^()\n]*+(?:\([^()\n]*+\)[^()\n]*+)*+\)")
_SOURCE = re.compile(r"(?im)^[ \t]*>[ \t]*source[ \t]*:.*$|^[ \t]*loading comments\W{0,9}$")
_TITLE = re.compile(r"\A\s*#\s[^\n]*")

LETTER, NUMBER, BLANK, CJK, KANA, DEBRIS, ENDER, CLOSER = (1 << i for i in range(8))
# Signs that UTF-8 text read in a single-byte code page is full of, and two letters that only such text has often.
_DEBRIS_CHARS = "ÃÂ±µ¶·¤¦§©¬®№‚†‡€‰‹›™�"
# What the lead bytes of Cyrillic letters become in such text. Within words these capitals are debris, with the sign after them.
_LEADS = (0x420, 0x421)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_tables: dict[str, np.ndarray] = {}


def _classes() -> np.ndarray:
    """Classes of every code point, as bits."""
    if "classes" not in _tables:
        t = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            kind = unicodedata.category(chr(c))
            if kind[0] == "L":
                t[c] |= LETTER
            elif kind[0] == "N":
                t[c] |= NUMBER
            elif kind[0] == "Z" or 9 <= c <= 13 or 28 <= c <= 31 or c == 0x85:
                t[c] |= BLANK
        t[0x3040:0x3100] |= CJK
        t[0x3400:0xA000] |= CJK
        t[0x20000:0x30000] |= CJK
        t[0x3041:0x3097] |= KANA
        for chars, bit in ((_DEBRIS_CHARS, DEBRIS), (".!?…:;。！？", ENDER), ("\"'”’)]*_", CLOSER)):
            for c in chars:
                t[ord(c)] |= bit
        _tables["classes"] = t
    return _tables["classes"]


def _hash_words(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of code points: their sum after mixing with the place in the word."""
    n = ends - starts
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(starts, n) + place
    x = (points[at].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(24))) * _FACTOR
    x ^= x >> np.uint64(32)
    x *= _FACTOR
    return np.add.reduceat(x, np.cumsum(n) - n) if len(n) else x[:0]


def _common_hashes() -> np.ndarray:
    if "common" not in _tables:
        words = sorted({w for ws in COMMON.values() for w in ws})
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        n = np.array([len(w) for w in words])
        ends = np.cumsum(n)
        _tables["common"] = np.sort(_hash_words(points, ends - n, ends))
    return _tables["common"]


def line_counts(texts: list[str], title_lines: bool = True) -> pd.DataFrame:
    """One row a non-blank line of the texts with its counts; `doc` is the place in the list.

    With title_lines, a leading title line, source lines and comment placeholders are left out. A link counts by its anchor text.
    """
    cleaned = []
    for text in texts:
        if title_lines:
            text = _SOURCE.sub("", _TITLE.sub("", text))
        if "](" in text:
            text = _LINK.sub(r"\1", _LINK.sub(r"\1", text))
        cleaned.append(text)
    whole = "\n".join(cleaned) + "\n"
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = np.frombuffer(_lower(whole).encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = _classes()[points]
    has = lambda bit: (classes & bit) > 0
    breaks = np.flatnonzero(points == 10)
    starts = np.r_[0, breaks[:-1] + 1]
    line_of = np.repeat(np.arange(len(breaks)), breaks - starts + 1)
    per_line = lambda mask: np.add.reduceat(mask.astype(np.int32), starts)
    letter, blank = has(LETTER), has(BLANK)
    lead = np.isin(points, _LEADS)
    # A capital that starts a word, or stands among capitals, is a letter; what follows a lead in debris is neither a capital of the same alphabet nor ASCII.
    small_next = np.r_[points[1:], 10]
    upper = (small_next >= 0x410) & (small_next <= 0x42F)
    paired = lead & np.r_[False, ~blank[:-1]] & ~upper & (small_next > 127) & ~np.r_[blank[1:], True]
    debris = has(DEBRIS) | paired | np.r_[False, paired[:-1]]
    apart = (points == 39) | (points == 0x2019)
    apart[1:-1] &= letter[:-2] & letter[2:]
    wordy = letter | apart
    begin = np.flatnonzero(wordy & ~np.r_[False, wordy[:-1]])
    end = np.flatnonzero(wordy & ~np.r_[wordy[1:], False]) + 1
    word_line = line_of[begin]
    hashes = _hash_words(small, begin, end)
    pairs = np.unique(np.stack([word_line.astype(np.uint64), hashes]), axis=1)[0].astype(np.int64) if len(begin) else begin
    common = _common_hashes()
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    n = len(breaks)
    idx = np.arange(len(points))
    first = np.minimum.reduceat(np.where(blank, len(points), idx), starts)
    last = np.maximum.reduceat(np.where(blank | has(CLOSER), -1, idx), starts)
    ink = first < len(points)
    f, a = np.minimum(first, len(points) - 1), np.maximum(last, 0)
    digits = (points >= 48) & (points <= 57)
    stop = np.minimum.accumulate(np.where(digits, len(points), idx)[::-1])[::-1]
    s = np.minimum(stop[f], len(points) - 2)
    numbered = digits[f] & ((points[s] == 46) | (points[s] == 41)) & blank[s + 1]
    marked = np.isin(points[f], [ord(c) for c in "-*•–—·"]) & blank[np.minimum(f + 1, len(points) - 1)]
    space = points == 32
    gap = space & np.r_[space[1:], False] & ~np.r_[True, blank[:-1]]
    kana = np.unique(np.stack([line_of[has(KANA)], points[has(KANA)].astype(np.int64)]), axis=1)[0] if has(KANA).any() else np.empty(0, np.int64)
    out = pd.DataFrame(
        {
            "chars": per_line(~blank),
            "letters": per_line(letter),
            "alnum": per_line(letter | has(NUMBER)),
            "words": np.bincount(word_line, minlength=n),
            "distinct": np.bincount(pairs, minlength=n),
            "common": np.bincount(word_line, weights=common[at] == hashes, minlength=n).astype(np.int64),
            "bars": per_line(points == 124),
            "tabs": per_line((points == 9) & (idx > f[line_of])),
            "gaps": per_line(gap),
            "debris": per_line(debris),
            "cjk": per_line(has(CJK)),
            "kana": np.bincount(kana, minlength=n),
            "ended": ink & (last >= 0) & ((classes[a] & ENDER) > 0),
            "bullet": ink & (numbered | marked),
            "heading": ink & np.isin(points[f], [35]),
            "row": ink & (points[f] == 124),
        }
    )
    lengths = np.array([c.count("\n") + 1 for c in cleaned], np.int64) if cleaned else np.empty(0, np.int64)
    out.insert(0, "doc", np.repeat(np.arange(len(cleaned)), lengths)[:n])
    return out[ink]


def _lower(text: str) -> str:
    """Lower case with as many characters as before."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def running_text(c: pd.DataFrame) -> pd.Series:
    """Whether each line is running text."""
    table = (c["bars"] >= 2) | c["row"] | (c["tabs"] > 0)
    gapped = (c["gaps"] >= 3) & (c["common"] < 0.12 * c["words"])
    repeated = (c["words"] >= 8) & (c["distinct"] < np.minimum(0.34 * c["words"], 2 * np.sqrt(c["words"])))
    spaced = c["letters"] < 2.0 * c["words"]
    asian = (c["cjk"] >= 0.3 * c["chars"]) & (c["kana"] >= 3)
    spoken = (c["words"] >= 4) & (c["common"] >= 1) & (c["common"] >= 0.12 * c["words"]) & (c["letters"] >= 0.6 * c["chars"]) & ~repeated & ~spaced
    return ~table & ~gapped & (c["debris"] <= 0.08 * c["chars"]) & (asian | spoken)


_SUMS = ["lines", "chars", "words", "letters", "common", "cjk", "symbols", "ended", "bullets", "prose", "headings"]


def _stats(title_lines: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 1000):
                part = pdf.iloc[lo : lo + 1000]
                c = line_counts(part["text"].tolist(), title_lines)
                prose = running_text(c)
                c = c.assign(
                    lines=1, symbols=c["chars"] - c["alnum"], bullets=c["bullet"], prose=np.where(prose, c["chars"], 0), headings=np.where(c["heading"] & ~prose, c["chars"], 0)
                )
                sums = c.groupby("doc")[_SUMS].sum().astype(np.int64)
                yield sums.assign(id=part["id"].to_numpy()[sums.index]).reset_index(drop=True)

    return run


def quality(df: DataFrame, id_col: str, text_col: str, title_lines: bool = True) -> DataFrame:
    """One row a document that has a non-blank line beside its furniture: statistics, prose_share and the reasons of failed rules.

    Null, empty and blank texts, and texts of furniture only, give no row. Rows with equal ids give a row each. Extra columns are ignored.
    """
    docs = spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL"))
    sums = docs.mapInPandas(_stats(title_lines), ", ".join(f"{c} long" for c in [*_SUMS, "id"]))
    n = F.greatest("chars", F.lit(1))
    stats = sums.select(
        "id", "lines", "chars", "words", F.col("common").alias("common_words"),
        (F.col("letters") / F.greatest("words", F.lit(1))).alias("mean_word_length"),
        (F.col("symbols") / n).alias("symbol_share"),
        (F.col("letters") / n).alias("letter_share"),
        (F.col("ended") / F.col("lines")).alias("ended_share"),
        (F.col("bullets") / F.col("lines")).alias("bullet_share"),
        (F.col("common_words") / F.greatest("words", F.lit(1))).alias("common_share"),
        (F.col("prose") / n).alias("prose_share"),
        (1 - (F.col("prose") + F.col("headings")) / n).alias("junk_share"),
        (F.col("cjk") > 0.3 * F.col("chars")).alias("unspaced"),
    )
    failed = [
        ("few_words", (F.col("words") < RULES["min_words"]) & ~F.col("unspaced")),
        ("short_words", F.col("mean_word_length") < RULES["min_mean_word"]),
        ("long_words", (F.col("mean_word_length") > RULES["max_mean_word"]) & ~F.col("unspaced")),
        ("symbols", F.col("symbol_share") > RULES["max_symbols"]),
        ("few_letters", F.col("letter_share") < RULES["min_alpha_words"]),
        ("bullets", F.col("bullet_share") > RULES["max_bullets"]),
        ("few_common_words", (F.col("common_words") < RULES["min_common"]) & ~F.col("unspaced")),
        ("not_prose", F.col("junk_share") > RULES["min_prose"]),
    ]
    reasons = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in failed]), lambda x: x.isNotNull())
    return stats.withColumn("reasons", reasons).drop("unspaced")
