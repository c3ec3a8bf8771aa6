"""Byte-level BPE as a lazily determinised finite-state transducer (problem 6).

A byte-level BPE encoding is the only token sequence with these bytes in which every two neighbours
are stable, that is, encode to themselves. So the last token of each prefix is determined, and the
encoder is a deterministic machine over bytes:

* Reading a byte, the prefixes after which a token may still end are those whose rest is a path in
  the vocabulary's trie. A state holds these open prefixes: for each its trie node and the last token of its
  encoding, which decides what may follow. Its output is the last token of the input so far.
* The encodings of all open prefixes agree up to a point, as no token is longer than the trie is deep.
  Up to there the tokens are decided and emitted; at the end of the input, the rest is.

States are numbered when they are first reached and transitions are computed once (lazy
determinisation), after which a byte costs one table lookup. The public pattern's pre-tokens are
fed one by one; chunks between blanks, whose encoding doesn't depend on their neighbours, are
remembered in a table of bounded size.
"""

import array
import binascii
import re

import regex

#: A token's parts: not looked for yet; none, as it is one byte.
UNKNOWN, SINGLE = -2, -1

_CUT = re.compile(r"(?<=\S)(?= \S)")


class Vocabulary:
    """Ranks of a byte-level BPE vocabulary; the rank of a token is its id and its merge order."""

    MOST_PAIRS = 600_000

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {binascii.a2b_base64(a): int(b) for a, b in (line.split() for line in f)}
        self.bytes_of = [b""] * (max(self.rank.values()) + 1)
        for data, token in self.rank.items():
            self.bytes_of[token] = data
        self.child: dict[int, int] = {}
        self.token_at, self.inner, self.depth = [-1], [True], [0]
        for data, token in self.rank.items():
            node = 0
            for b in data:
                self.inner[node] = True
                to = self.child.get(node << 8 | b)
                if to is None:
                    to = self.child[node << 8 | b] = len(self.token_at)
                    self.token_at.append(-1), self.inner.append(False), self.depth.append(self.depth[node] + 1)
                node = to
            self.token_at[node] = token
        self.known: dict[int, bool] = {}
        self.left = [SINGLE if len(b) == 1 else UNKNOWN for b in self.bytes_of]
        self.right = list(self.left)

    def merge(self, data: bytes, below: int | None = None) -> list[int]:
        """The encoding by the definition: the lowest-ranked neighbour pair merges first; only merges ranked under `below`."""
        parts = [bytes([b]) for b in data]
        rank = self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best) and (below is None or r < below):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [rank[p] for p in parts]

    def _part(self, token: int) -> None:
        """Finds the two tokens whose merge makes this one."""
        data, rank = self.bytes_of[token], self.rank
        cuts = [(a, b) for i in range(1, len(data)) if (a := rank.get(data[:i], token)) < token and (b := rank.get(data[i:], token)) < token]
        # Where several cuts would do, the merges themselves tell; a token of several bytes has at least one.
        self.left[token], self.right[token] = cuts[0] if len(cuts) == 1 else self.merge(data, token)

    def stable(self, a: int, b: int) -> bool:
        """Whether tokens a, b next to each other encode to themselves.

        Merges happen in the order of rank, equal ranks from the left. Going back in time from the finished
        pair, the later made of the two tokens at the border is taken apart; the pair is unstable if the two
        that then touch would have merged before that token was made.
        """
        got = self.known.get(a << 20 | b)
        if got is None:
            if len(self.known) > self.MOST_PAIRS:
                self.known.clear()
            get, bytes_of, left, right = self.rank.get, self.bytes_of, self.left, self.right
            x, y, until, got = a, b, len(left) + 1, True
            while True:
                merged = get(bytes_of[x] + bytes_of[y])
                if merged is not None and merged < until:
                    got = False
                    break
                if right[x] != SINGLE and (x > y or left[y] == SINGLE):
                    if right[x] == UNKNOWN:
                        self._part(x)
                    until, x = x, right[x]
                elif left[y] != SINGLE:
                    if left[y] == UNKNOWN:
                        self._part(y)
                    until, y = y + 1, left[y]
                else:
                    break
            self.known[a << 20 | b] = got
        return got


class Transducer:
    """Encodes byte strings.

    The rests of the open prefixes are the suffixes of the input that are paths of the trie, so the longest one
    tells the others: they form a chain of trie nodes. A state is a chain and, for each of its nodes, the last token before that rest.
    """

    MOST_STATES = 250_000
    #: Bytes after which decided tokens are emitted while more input comes.
    WINDOW = 4096

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.size = [len(b) for b in vocabulary.bytes_of]
        self._reset()

    def _reset(self) -> None:
        """Empties all tables: chains and moves grow with the states."""
        self.chains: list[tuple[int, ...]] = [(0,)]
        self.chain_numbers: dict[tuple[int, ...], int] = {(0,): 0}
        self.moves: dict[int, tuple] = {}
        start = (0, (-1,))
        self.numbers: dict[tuple, int] = {start: 0}
        self.states: list[tuple] = [start]
        self.last: list[int] = [-1]
        self.step: dict[int, int] = {}

    def _move(self, chain: int, byte: int) -> tuple:
        """What a byte does to a chain: the next chain, the (place, token) of each rest that becomes a token, and the places that go on."""
        v, ends, on, nodes = self.v, [], [], []
        for place, node in enumerate(self.chains[chain]):
            to = v.child.get(node << 8 | byte)
            if to is not None:
                if v.token_at[to] >= 0:
                    ends.append((place, v.token_at[to]))
                if v.inner[to]:
                    on.append(place)
                    nodes.append(to)
        if not ends:
            raise ValueError("the vocabulary lacks single bytes")
        nodes = (*nodes, 0)
        number = self.chain_numbers.setdefault(nodes, len(self.chains))
        if number == len(self.chains):
            self.chains.append(nodes)
        got = self.moves[chain << 8 | byte] = (number, ends, on)
        return got

    def _transition(self, at: int, byte: int) -> int:
        chain, before = self.states[at]
        chain, ends, on = self.moves.get(chain << 8 | byte) or self._move(chain, byte)
        known, last = self.v.known, -1
        for place, token in ends:
            b = before[place]
            fine = b < 0 or known.get(b << 20 | token)
            if fine is None:
                fine = self.v.stable(b, token)
            if fine:
                last = token
                break
        state = (chain, (*[before[place] for place in on], last))
        number = self.numbers.get(state)
        if number is None:
            number = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.last.append(last)
        self.step[at << 8 | byte] = number
        return number

    def _chain(self, ends: list[int], upto: int) -> list[int]:
        """The tokens of the encoding of the first `upto` bytes."""
        out = []
        while upto:
            t = ends[upto - 1]
            out.append(t)
            upto -= self.size[t]
        return out[::-1]

    def _decided(self, ends: list[int], at: int) -> int:
        """Where the encodings of all open prefixes meet."""
        places = {len(ends) - self.v.depth[node] for node in self.chains[self.states[at][0]]}
        while len(places) > 1:
            far = max(places)
            places.remove(far)
            places.add(far - self.size[ends[far - 1]])
        return places.pop()

    def encode(self, data: bytes) -> list[int]:
        """Token ids of one pre-token."""
        if len(self.states) > self.MOST_STATES or len(self.moves) > self.MOST_STATES:
            self._reset()
        out, ends, at, get, last, window = [], [], 0, self.step.get, self.last, self.WINDOW
        for byte in data:
            to = get(at << 8 | byte)
            at = self._transition(at, byte) if to is None else to
            ends.append(last[at])
            if len(ends) > window:
                upto = self._decided(ends, at)
                out += self._chain(ends, upto)
                del ends[:upto]
        return out + self._chain(ends, len(ends)) if out else self._chain(ends, len(ends))


class _Odd(Exception):
    """A part of a text that has white space at an edge: cutting at single blanks doesn't do."""


class _Table(dict):
    """Ids, as bytes of 32-bit numbers, of chunks; a missing chunk is encoded. Emptied when it has grown large."""

    def __init__(self, encode, most: int):
        self.encode, self.most = encode, most

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(chunk)
        if len(chunk) <= 40:
            if len(self) > self.most:
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    """Texts to ids under the public pre-token pattern, strings of special tokens being ordinary text.

    A blank between two characters that are no white space always begins a pre-token, so the text is encoded in chunks cut there.
    """

    MOST_CHUNKS = 120_000

    def __init__(self, path: str, pattern: str):
        self.transducer = Transducer(Vocabulary(path))
        self.pattern = regex.compile(pattern)
        self.words = _Table(self._word, self.MOST_CHUNKS)
        self.chunks = _Table(self._chunk, self.MOST_CHUNKS)
        self.after_blank = _Table(self._after_blank, self.MOST_CHUNKS)

    def _word(self, word: str) -> bytes:
        return array.array("i", self.transducer.encode(word.encode("utf-8", "surrogatepass"))).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        words = self.pattern.findall(chunk)
        return self._word(words[0]) if len(words) == 1 else b"".join(map(self.words.__getitem__, words))

    def _after_blank(self, part: str) -> bytes:
        if not part or part[0].isspace() or part[-1].isspace():
            raise _Odd
        return self._chunk(" " + part)

    def encode(self, text: str, out: array.array) -> None:
        """Appends the ids of `text` to `out`."""
        first, blank, rest = text.partition(" ")
        if blank and first and not first[-1].isspace():
            try:
                ids = b"".join(map(self.after_blank.__getitem__, rest.split(" ")))
            except _Odd:
                pass
            else:
                out.frombytes(self.chunks[first])
                out.frombytes(ids)
                return
        out.frombytes(b"".join(map(self.chunks.__getitem__, _CUT.split(text))))


class Decoder:
    """Ids to text as they come: bytes wait in a UTF-8 state machine until their character is whole.

    Bytes that are no UTF-8 become U+FFFD, one for each maximal ill-formed part.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.bytes_of = vocabulary.bytes_of
        self.code, self.left, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, ids) -> str:
        """The characters completed by these ids."""
        out: list[str] = []
        for i in ids:
            for b in self.bytes_of[i]:
                if self.left:
                    if self.low <= b <= self.high:
                        self.code, self.left, self.low, self.high = self.code << 6 | b & 0x3F, self.left - 1, 0x80, 0xBF
                        if not self.left:
                            out.append(chr(self.code))
                        continue
                    out.append("�")
                    self.left = 0
                self._start(b, out)
        return "".join(out)

    def _start(self, b: int, out: list[str]) -> None:
        self.low, self.high = 0x80, 0xBF
        if b < 0x80:
            out.append(chr(b))
        elif 0xC2 <= b <= 0xDF:
            self.code, self.left = b & 0x1F, 1
        elif 0xE0 <= b <= 0xEF:
            self.code, self.left = b & 0x0F, 2
            self.low, self.high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
        elif 0xF0 <= b <= 0xF4:
            self.code, self.left = b & 0x07, 3
            self.low, self.high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
        else:
            out.append("�")

    def close(self) -> str:
        """What is left at the end: U+FFFD if a character was begun."""
        left, self.left = self.left, 0
        return "�" if left else ""
