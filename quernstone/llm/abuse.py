"""Abusive, hateful and sexual content by noisy-channel restoration (problem 8).

Writers disguise words by look-alike digits and signs, spaced or dotted letters, repetition, masks and left-out
letters. A suspicious token is read as the noisy output of a channel: its characters form a lattice
(each may stand for itself, for what it looks like, for a repetition, a separator or any letter), and Viterbi searches find the
cheapest path. Each edge costs what the channel charges and what the character trigram model, counted over all documents, charges for the
letter after the two before it, so words of any list or none are read, and the model decides what a sign stands for. Words
of the cues have a path of their own at a fixed cost, on which a letter may also be missing. Of the two readings and the token as it stands, the cheapest wins.

Restored lines are scored in three ways, and what each is worth is fitted on the raters' labels:

* phrases, and general features in six languages (an insult word said of the reader, a threat with the reader as object, a people called vermin ...):
  the share of toxic ratings among rated documents in which one fires, drawn towards a prior;
* learned sequences of two and three restored words (four characters in Japanese) that stand almost only in documents rated toxic. They are counted over all
  rated documents in Spark, on two halves: a sequence must be toxic on one half, and the bar it has to pass is the lowest at which such sequences hold on the other half.

Words in quotation marks on a line that forbids or reports such language don't count.
"""

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.abuse_lexicon import CUES, GENERAL, GROUPS, INSULTS, JAPANESE, LEET, LOOKALIKES, REAL_WORDS, WORDS, _plain
from quernstone.sources.scratch import materialize
from quernstone.sources.tables import spread

#: Costs of the channel, as negative logarithms.
PRIOR, ALIKE, MASK, REPEAT, SEPARATOR, MISSING, EXTRA_SIGN = 7.0, 0.5, 0.9, 0.3, 0.4, 4.0, 4.0
#: A star is rather a masked letter than a separator.
STAR = 1.5
#: Ratings that the prior of a cue counts as, and its share of toxic ones.
PRIOR_RATINGS, PRIOR_SHARE = 8.0, 0.95
THRESHOLD = 0.5
#: A learned sequence stands in at least so many rated documents of different texts. Bars for the lower bound of its toxic share, and what share of the held-out documents that have such sequences must be toxic.
LEAST_RATED, BARS, HELD_OUT = 4, (0.5, 0.6, 0.7, 0.8), 0.95
#: Learned sequences that a line must hold; the worth of the last of them counts. One alone may be a name, or a turn of speech next to abuse.
LEAST_SEEN = 3
#: Learned sequences that are kept, those in most documents first.
MOST_LEARNED = 20_000
MOST_TOKENS = 400_000
#: States of the open search that are followed.
BEAM = 64
#: Longer tokens are read each time.
LONGEST_TOKEN = 60

_CUES = [(kind, re.compile(p)) for kind, ps in CUES.items() for p in ps]
_FEATURES = _CUES + [(kind, re.compile(p)) for kind, p, _ in GENERAL]
_ALL = _FEATURES + [(kind, re.compile(p)) for kind, p in JAPANESE]
#: Signs of Japanese that all its features have one of.
_KANA = re.compile("[\u3040-\u30ff\u4e00-\u9fff\uff66-\uff9f]")
_STOP = frozenset("you what such that this with your their they have should would then just only into".split())


def _alternatives(pattern: str) -> list[str]:
    """The pattern cut at the bars outside of groups."""
    out, depth = [""], 0
    for c in pattern:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def _keys(alternative: str) -> set[str]:
    """Words of which a line must have one for this alternative to match: its longest word outside of groups, or the words of its groups."""
    flat = re.sub(r"\[[^\]]*\](?:\{[^}]*\}|[*+?])?|\\[a-zA-Z][*+?]?|\.\{[^}]*\}", " ", alternative)
    bare = flat
    while (cut := re.sub(r"\([^()]*\)[*+?]?", " ", bare)) != bare:
        bare = cut
    own = [w for w in re.findall(r"(?<![\w'?+*])[a-z]{4,}(?![\w'?+*])", bare) if w not in _STOP]
    if own:
        return {max(own, key=len)}
    return {w for x in re.findall(r"[a-z?()]{3,}", flat.replace("(?:", " ").replace("|", " ")) for w in _forms(x.strip("()"))}


def _forms(word: str) -> set[str]:
    """A word with optional endings, as "idiots?" or "bitch(es)?"."""
    if word.endswith("s?"):
        return {word[:-2], word[:-1]}
    word = word.replace("?", "").strip("()")
    return {word, word + "es"} if word.isalpha() else set()


_INDEX: dict[str, list[int]] = {}
for _n, (_, _p) in enumerate(_CUES):
    for _k in {k for a in _alternatives(_p.pattern) for k in _keys(a)}:
        _INDEX.setdefault(_k, []).append(_n)
for _n, (_, _, _ws) in enumerate(GENERAL, len(_CUES)):
    for _k in _ws:
        _INDEX.setdefault(_k, []).append(_n)
_HOT, _LONE = "\x01", "\x02"
_RUN = re.compile(rf"(?<!\S){_LONE}[^\s](?:[ .]+{_LONE}[^\s]){{2,}}(?!\S)")
_END = re.compile(r"[.!?…。！？]+[\"'”’)\]*_]*$")
_EDGE = re.compile(r"^[\"'“”‘’(\[{<>#_~.,;:!?…-]+|[\"'“”‘’)\]}>_~.,;:!?…-]+$")
_SIGN = re.compile(r"[@$!|+€£*\d]")
_LETTER = re.compile(r"[^\W\d_]")
_DOTTED = re.compile(r"(?:[^\W_][.\-_*·]){2,}[^\W_]\w*$")
_THRICE = re.compile(r"([^\W\d_])\1\1")
_QUOTED = re.compile(r"[\"“”„«][^\"“”„«»\n]{2,}[\"“”»]|(?<!\w)['‘][^'‘’\n]{3,}['’](?!\w)|「[^」\n]*」|『[^』\n]*』")
_REPORTS = re.compile(r"forbid|banned|not allowed|prohibit|moderat|removed|such as|\bwords?\b|\binsults?\b|reported|\bquot(?:e|es|ed|ing)\b|(?:do not|don['’]t|never|to) (?:write|say|post|type)|verboten|gelöscht|interdit|supprim|prohibid|запрещ|удал|禁止|削除", re.I)
_DICE = re.compile(r"^[+-]?\d*d\d+|^\d+[a-z]{0,3}$|^[\d.,:/%+-]+$")


def _letters(text: str) -> str:
    """Lower case without accents, marks and invisible signs."""
    if text.isascii():
        return text.lower()
    flat = unicodedata.normalize("NFKD", text.lower()).replace("ß", "ss")
    return "".join(c for c in flat if unicodedata.category(c) not in ("Mn", "Cf", "Me"))


def _words() -> list[str]:
    """WORDS, and the words that cues turn on: insults and what peoples are called, with their endings. Everyday words of the cues are read as they stand."""
    words = dict.fromkeys(WORDS)
    for group in GROUPS:
        for word, more, last in re.findall(r"\b([a-z]{3,})(?:\(\?:([a-z]+)\)\?|([a-z])\?)?", group):
            words.update(dict.fromkeys([word, word + more + last]))
    words.update(dict.fromkeys(w for rows in INSULTS.values() for w in _plain(rows).replace("|", " ").split() if len(w) > 3))
    return list(words)


_WORDS = _words()
#: Of readings that cost the same, one of these goes first.
_FIRST = frozenset(WORDS)
#: Letters in the longest word: of a longer run of one sign, so many are read.
_LONGEST_WORD = max(map(len, _WORDS))
_RUNS = re.compile(rf"(.)\1{{{_LONGEST_WORD},}}", re.S)
#: The longer words with one letter left out (not the first), but for those that are words of their own.
_SHORT = {w[:i] + w[i + 1 :] for w in WORDS if len(w) >= 5 for i in range(1, len(w))}
_SHORT |= {w[:i] + w[i + 1 :] for rows in INSULTS.values() for w in re.findall("[a-z]{7,}", rows) for i in range(1, len(w) - 1)}
_SHORT -= set(_WORDS) | REAL_WORDS
_CELLS = 28**3


class Restorer:
    """Restores tokens. `counts` are of trigrams over 28 signs: blank, a to z, other."""

    def __init__(self, counts: np.ndarray, words: list[str] = _WORDS, learned: dict[str, float] | None = None, keys: frozenset = frozenset()):
        #: Learned sequences with their worth, and a word of each by which lines are found that may hold one.
        self.learned, self.keys = learned or {}, keys
        t = counts.reshape(28, 28, 28) + 0.05
        self.cost = -np.log(t / t.sum(axis=2, keepdims=True))
        self.next: list[dict[str, int]] = [{}]
        self.word_at: list[str | None] = [None]
        self.letter: list[str] = [""]
        self.words = set(words)
        for word in words:
            node = 0
            for c in word:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({}), self.word_at.append(None), self.letter.append(c)
                node = self.next[node][c]
            self.word_at[node] = word
        self.known: dict[str, str] = {}

    def plain_cost(self, token: str) -> float:
        """The token as it stands: trigram cost of its letters, and a charge for each sign among them."""
        codes = [0, 0] + [ord(c) - 96 if "a" <= c <= "z" else 27 for c in token if c.isalpha()] + [0]
        total = sum(self.cost[a, b, c] for a, b, c in zip(codes, codes[1:], codes[2:]))
        return float(total) + EXTRA_SIGN * sum(not c.isalpha() for c in token)

    def read(self, token: str) -> tuple[str | None, float]:
        """The cheapest reading of the token as a word, by Viterbi search over the character lattice."""
        best: dict[int, tuple[float, int]] = {0: (PRIOR, 0)}  # node: (cost, letters left out so far)
        for c in token:
            reached: dict[int, tuple[float, int]] = {}

            def offer(node: int, cost: float, missed: int, reached=reached) -> None:
                if node not in reached or cost < reached[node][0]:
                    reached[node] = (cost, missed)

            stands = [(c, 0.0)] + [(x, ALIKE) for x in LEET.get(c, "")] + ([(LOOKALIKES[c], ALIKE)] if c in LOOKALIKES else [])
            for node, (cost, missed) in best.items():
                for x, more in stands:
                    if x in self.next[node]:
                        offer(self.next[node][x], cost + more, missed)
                    if node and x == self.letter[node]:
                        offer(node, cost + REPEAT + more, missed)
                    if not missed:
                        for skipped in self.next[node].values():
                            if node and x in self.next[skipped]:
                                offer(self.next[skipped][x], cost + more + MISSING, 1)
                if c == "*":
                    for to in self.next[node].values():
                        offer(to, cost + MASK, missed)
                if node and c in ".-_·* '":
                    offer(node, cost + (STAR if c == "*" else SEPARATOR), missed)
            best = reached
            if not best:
                return None, math.inf
        ends = [(cost, self.word_at[n]) for n, (cost, _) in best.items() if self.word_at[n]]
        cost, word = min(ends, key=lambda e: (e[0], e[1] not in _FIRST, e[1]), default=(math.inf, None))
        return word, cost

    def decode(self, token: str) -> tuple[str, float]:
        """The cheapest reading of the token as letters, whatever the word: channel and trigram costs on each edge, two letters as the state."""
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # state: (cost, letters as linked pairs)
        cost_of = self.cost
        for c in token:
            reached: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            stands = [(c, 0.0)] * ("a" <= c <= "z") + [(x, ALIKE) for x in LEET.get(c, "")] + ([(LOOKALIKES[c], ALIKE)] if c in LOOKALIKES else [])
            if c == "*":
                stands += [(chr(k), MASK) for k in range(97, 123)]
            free = STAR if c == "*" else SEPARATOR if c in ".-_·' " else math.inf
            for (a, b), (cost, text) in best.items():
                ways = [((b, ord(x) - 96), cost + more + cost_of[a, b, ord(x) - 96], (text, x)) for x, more in stands]
                ways += [((a, b), cost + more + REPEAT, text) for x, more in stands if b == ord(x) - 96 and c != "*"]
                if free < math.inf:
                    ways.append(((a, b), cost + free, text))
                for state, total, letters in ways:
                    if state not in reached or total < reached[state][0]:
                        reached[state] = (total, letters)
            if not reached:
                return "", math.inf
            best = reached if len(reached) <= BEAM else dict(sorted(reached.items(), key=lambda x: x[1][0])[:BEAM])
        cost, text = min(((cost + cost_of[a, b, 0], text) for (a, b), (cost, text) in best.items()), key=lambda x: x[0])
        letters = []
        while text:
            text, x = text
            letters.append(x)
        return "".join(letters[::-1]), float(cost)

    def _restore(self, core: str) -> str:
        if core in self.words:
            return core
        mixed = not core.isascii() and any(c in LOOKALIKES for c in core) and (any("a" <= c <= "z" for c in core) or all(c in LOOKALIKES for c in core if c.isalpha()))
        odd = mixed or _SIGN.search(core) and _LETTER.search(core) and not _DICE.match(core) or _DOTTED.match(core) or _THRICE.search(core) or core in _SHORT
        if not odd:
            return core
        short = _RUNS.sub(lambda m: m[1] * _LONGEST_WORD, core)
        word, cost = self.read(short)
        free, least = self.decode(short)
        if word and cost < least:
            free, least = word, cost
        return free if len(free) >= 3 and least < self.plain_cost(short) else core

    def token(self, raw: str) -> str:
        """A token of a restored line: marked if it is a trigger, with a sentence end kept as " ."."""
        got = self.known.get(raw)
        if got is None:
            low = _letters(raw)
            end = " ." if _END.search(low) else ""
            # Signs at the edges are punctuation, unless the word is only whole with them.
            core = _EDGE.sub("", low)
            word = self._restore(core)
            if word == core and core != low and ("$" in low or "!" in low or "*" in low):
                whole = self._restore(low.rstrip(".,;:?…"))
                word = whole if whole in self.words else word
            word = re.sub(r"[^\w'-]+", " ", word.replace("’", "'").replace("ʼ", "'")).strip()
            lone = _LONE if len(word) == 1 and word.isalpha() else ""
            got = lone + " ".join(_HOT + w if w in _INDEX or w in self.keys else w for w in word.split()) + end
            if len(self.known) > MOST_TOKENS:
                self.known.clear()
            if len(raw) <= LONGEST_TOKEN:
                self.known[raw] = got
        return got

    def line(self, text: str) -> tuple[str, set[int]] | None:
        """The restored line and the cues that may fire in it, or None if no cue and no learned sequence has a word in it."""
        joined = self._joined(text)
        if _HOT not in joined:
            return None
        cues = {n for w in joined.split() if w[0] == _HOT for n in _INDEX.get(w[1:], ())}
        return joined.replace(_HOT, "").replace(_LONE, ""), cues

    def plain(self, text: str) -> str:
        """The restored line."""
        return self._joined(text).replace(_HOT, "").replace(_LONE, "")

    def _joined(self, text: str) -> str:
        known = self.known
        joined = " ".join([known.get(t) or self.token(t) for t in text.split()])
        return _RUN.sub(self._spelled, joined) if joined.count(_LONE) >= 3 else joined

    def _spelled(self, m: re.Match) -> str:
        """Letters standing alone, read as one word or several."""
        letters = m[0].replace(_LONE, "").replace(_HOT, "").replace(" ", "")
        word = self._restore(letters) if letters in self.words else (self.read(letters)[0] or "")
        return (_HOT if word in _INDEX else "") + word + (" ." if letters.endswith(".") else "") if word else m[0]


def sequences(restored: str, line: str) -> set[str]:
    """Sequences of two and three words of a restored line, and of four characters of a Japanese one."""
    w = restored.replace(" .", "").split()
    out = {f"{a} {b}" for a, b in zip(w, w[1:])} | {f"{a} {b} {c}" for a, b, c in zip(w, w[1:], w[2:])}
    if not line.isascii() and _KANA.search(line):
        flat = "".join(unicodedata.normalize("NFKC", line).split())
        out |= {flat[i : i + 4] for i in range(len(flat) - 3)}
    return out


def _without_quotes(line: str) -> str:
    """The line, without its quoted words if it forbids or reports them."""
    return _QUOTED.sub(" ", line) if _QUOTED.search(line) and _REPORTS.search(line) else line


def _judged_line(restorer: Restorer, line: str) -> tuple[set[int], float]:
    restored, found, best, learned = restorer.line(line), set(), 0.0, restorer.learned
    kana = not line.isascii() and _KANA.search(line)
    if restored:
        found.update(n for n in restored[1] if _ALL[n][1].search(restored[0]))
    if kana:
        flat = unicodedata.normalize("NFKC", line)
        found.update(n for n in range(len(_FEATURES), len(_ALL)) if _ALL[n][1].search(flat))
    if learned and (restored or kana):
        seen = sorted((learned[x] for x in sequences(restored[0] if restored else "", line) if x in learned), reverse=True)
        best = seen[LEAST_SEEN - 1] if len(seen) >= LEAST_SEEN else 0.0
    return found, best


def judged(restorer: Restorer, text: str) -> tuple[list[int], float]:
    """Numbers of the cues that fire in some line of the text, and the worth of the line with the best learned sequences."""
    found: set[int] = set()
    best = 0.0
    for line in text.split("\n"):
        got, worth = _judged_line(restorer, line)
        if (got or worth) and (bare := _without_quotes(line)) != line:
            got, worth = _judged_line(restorer, bare)
        found |= got
        best = max(best, worth)
    return sorted(found), best


def hits(restorer: Restorer, text: str) -> list[int]:
    """Numbers of the cues that fire in some line of the text."""
    return judged(restorer, text)[0]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The character model's counts over a task's texts."""
    total = np.zeros(_CELLS)
    for pdf in batches:
        words: Counter = Counter()
        for text in pdf["text"]:
            words.update(text.split())
        plain: Counter = Counter()
        for w, n in words.items():
            if w.isascii():
                w = w.strip(".,;:!?\"'()").lower()
                if w.isalpha():
                    plain[w] += n
        if plain:
            # Two blanks before each word: its trigrams end at its letters and at the blank after it.
            codes = np.frombuffer((" " + " ".join(f" {w}" for w in plain) + " ").encode(), np.uint8).astype(np.int64)
            codes = np.where(codes == 32, 0, codes - 96)
            tri = codes[:-2] * 784 + codes[1:-1] * 28 + codes[2:]
            times = np.fromiter(plain.values(), np.float64, len(plain))
            weight = np.repeat(times, [len(w) + 2 for w in plain])[: len(tri)]
            total += np.bincount(tri, weights=weight, minlength=_CELLS)
    if total.any():
        yield pd.DataFrame({"counts": [zlib.compress(total.tobytes(), 1)]})


def _add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(_CELLS)
    for pdf in batches:
        for blob in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(blob))
    yield pd.DataFrame({"counts": [zlib.compress(total.tobytes(), 1)]})


def _restorer(shared, model=None) -> Restorer:
    learned, keys = model.value if model else ({}, frozenset())
    return Restorer(np.frombuffer(zlib.decompress(shared.value)), learned=learned, keys=keys)


def _hits(shared, model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = _restorer(shared, model)
        for pdf in batches:
            got = [judged(restorer, t) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "hits": [h for h, _ in got], "learned": [x for _, x in got]})

    return run


def _sequences(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = _restorer(shared)
        for pdf in batches:
            rows = []
            for i, text, toxic in zip(pdf["id"], pdf["text"], pdf["toxic"]):
                seen: set[str] = set()
                for line in {_without_quotes(x) for x in text.split("\n")}:
                    restored = restorer.plain(line)
                    seen |= sequences(restored, line)
                    seen.update(restored.split())
                rows += [(i, x, toxic) for x in seen]
            yield pd.DataFrame(rows, columns=["id", "sequence", "toxic"])

    return run


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL"))


def _character_model(docs: DataFrame):
    counted = docs.select("text").mapInPandas(_count, "counts binary").repartition(1).mapInPandas(_add, "counts binary").collect()
    return docs.sparkSession.sparkContext.broadcast(counted[0].counts if counted else zlib.compress(np.zeros(_CELLS).tobytes()))


def learn(docs: DataFrame, rated: DataFrame, shared) -> tuple[dict[str, float], frozenset[str]]:
    """Learned sequences with their worth, and the rarest word of each, from documents (id, text) and ratings (id, toxic).

    A document counts as toxic if most of its ratings say so; ties don't count. Sequences are counted over all rated documents; at most MOST_LEARNED are kept.
    """
    sure = rated.groupBy("id").agg(F.avg("toxic").alias("m")).where("m <> 0.5").select("id", (F.col("m") > 0.5).cast("int").alias("toxic"))
    # Copies of a text count once: else all of a copied text's words would stand in toxic documents only.
    texts = docs.join(sure, "id").groupBy(F.xxhash64("text").alias("key")).agg(F.min_by(F.struct("id", "text", "toxic"), "id").alias("x")).select("x.*")
    rows = texts.mapInPandas(_sequences(shared), "id long, sequence string, toxic int").withColumn("half", F.pmod(F.xxhash64("id"), F.lit(2)))
    at = lambda k, c: F.sum(F.when(F.col("half") == k, c).otherwise(0))
    per = rows.groupBy("sequence").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"), *[at(k, F.lit(1)).alias(f"n{k}") for k in (0, 1)], *[at(k, F.col("toxic")).alias(f"t{k}") for k in (0, 1)])
    word = ~F.col("sequence").contains(" ")
    counted = materialize(per.where((F.col("n") >= LEAST_RATED) & (word | F.expr("2 * t > n"))), "sequences")
    per = counted.where(F.col("sequence").contains(" ") | F.col("sequence").rlike("^[\u3040-\u30ff\u4e00-\u9fff]{4}$")).where("2 * t > n")
    # The lower end of the toxic share, of a sequence seen n times with t toxic ones.
    low = lambda t, n: (t + 1) / (n + 2) - F.sqrt((t + 1) * (n - t + 1) / (n + 3)) / (n + 2)
    bar = BARS[-1]
    for b in BARS:
        held = [per.where(low(F.col(f"t{k}"), F.col(f"n{k}")) >= b).agg(F.sum(f"t{1 - k}").alias("t"), F.sum(f"n{1 - k}").alias("n")).first() for k in (0, 1)]
        t, n = sum(x.t or 0 for x in held), sum(x.n or 0 for x in held)
        if n and t >= HELD_OUT * n:
            bar = b
            break
    kept = per.withColumn("low", low(F.col("t"), F.col("n"))).where(F.col("low") >= bar).orderBy(F.desc("n"), "sequence").limit(MOST_LEARNED)
    learned = {r.sequence: float(r.t / r.n) for r in kept.select("sequence", "t", "n").collect()}
    used = docs.sparkSession.createDataFrame([(w,) for w in sorted({w for x in learned if " " in x for w in x.split()})], "sequence string")
    rows_of = {r.sequence: r.n for r in counted.where(word).join(F.broadcast(used), "sequence", "left_semi").select("sequence", "n").collect()}  # at most three words a learned sequence
    return learned, frozenset(min(x.split(), key=lambda w: (rows_of.get(w, 0), w)) for x in learned if " " in x)


def cue_hits(df: DataFrame, id_col: str, text_col: str, rated: DataFrame | None = None) -> DataFrame:
    """(id, hits, learned) of the documents in which some cue fires or LEAST_SEEN learned sequences stand in a line. Null ids and null texts are left out."""
    docs = _documents(df, id_col, text_col)
    shared = _character_model(docs)
    learned = learn(docs, rated, shared) if rated is not None else ({}, frozenset())
    model = df.sparkSession.sparkContext.broadcast(learned)  # at most MOST_LEARNED sequences
    return docs.mapInPandas(_hits(shared, model), "id long, hits array<int>, learned double").where("size(hits) > 0 OR learned > 0")


def abuse_scores(df: DataFrame, id_col: str, text_col: str, labels: DataFrame | None = None, label_id: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """(id, score, kinds) of documents in which some cue fires or a learned sequence stands; all others score 0.

    The score is 1 - (1 - w) * prod(1 - p) over the cues that fire, p being a cue's share of toxic ratings with its prior, w the worth of the line
    with the best learned sequences. Ratings that are null or neither 0 nor 1 don't count; repeated ratings count once a row. Null texts score 0.
    """
    rated = None
    if labels is not None:
        rated = labels.select(F.col(label_id).cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IN (0, 1)")
    found = materialize(cue_hits(df, id_col, text_col, rated), "cue-hits")
    worth = {n: PRIOR_SHARE for n in range(len(_ALL))}
    if rated is not None:
        fits = found.join(rated, "id").select(F.explode("hits").alias("cue"), "toxic").groupBy("cue").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
        for cue, t, n in fits.collect():  # one row a cue
            worth[cue] = (t + PRIOR_RATINGS * PRIOR_SHARE) / (n + PRIOR_RATINGS)
    p = F.array(*[F.lit(float(worth[n])) for n in range(len(_ALL))])
    kinds = F.array(*[F.lit(kind) for kind, _ in _ALL])
    none = F.aggregate("hits", F.lit(1.0), lambda acc, x: acc * (1 - F.element_at(p, x + 1))) * (1 - F.col("learned"))
    named = F.array_sort(F.array_distinct(F.transform("hits", lambda x: F.element_at(kinds, x + 1))))
    return found.select("id", F.round(1 - none, 6).alias("score"), F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("learned"))).alias("kinds"))
