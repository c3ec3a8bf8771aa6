"""Exact set-similarity self-join for near-duplicate texts (problem 1).

A text becomes the set of its sequences of `shingle` consecutive words (48-bit hashes). The join
finds every pair of different sets with Jaccard similarity >= `threshold`; texts with equal sets
form one class and take part once. The set-relation method is used on both levels:

* Index level: each set is ordered by one global order (rare shingles first) and its leading
  shingles go into inverted lists. A list is sorted by set size and, within a block of one
  size, by position. For a probe, the sizes that can still be similar are a range of blocks, and in
  a block the positions that can still be similar are its head, so the rest of each block is
  skipped unread. With required overlap a, a pair must share k = 1 + floor(SLACK * a) shingles
  within positions |x| - a + k of both sets; pairs with fewer are dropped without verification.
* Answer level: candidate pairs are verified in blocks of related sets. The overlap of y with a
  partner z is derived from the overlap already computed for a highly similar x, by looking only at
  the shingles in which x and y differ.

The global order uses shingle counts over all texts in a table of fixed size (2**SKETCH_BITS counters); clashes
only change the order, never the result. Nothing that grows with the corpus reaches the driver.
Shingles in very long lists are split into a grid of sub-lists, so no list is held by one task. A list is long by what its counter has beyond the mean
counter, so that full counters alone copy nothing.
"""

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm.components import components
from quernstone.sources.scratch import materialize
from quernstone.sources.tables import spread

SKETCH_BITS = 22
CHUNKS = 64
SLACK = 0.03
#: Postings of one shingle that stay one list; longer lists are split into a grid.
LIST_ROWS = 100_000
#: Postings that one bucket of the index holds, about.
BUCKET_ROWS = 400_000
#: Candidate pairs, and bytes of sets, that one verification block holds, about.
BLOCK_PAIRS, BLOCK_BYTES = 20_000, 64_000_000
BLOOM_BITS = 23

_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TOP48 = np.uint64(0xFFFFFFFFFFFF0000)


class _WordHashes(dict):
    """Hashes of words seen by this worker, emptied when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The sorted distinct 48-bit shingle hashes (in the upper bits of uint64); empty for null or too short texts."""
    words = _WORD.findall(text.lower()) if text else []
    n = len(words) - shingle + 1
    if n < 1:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for i in range(shingle):
        h = (h ^ w[i : i + n]) * _MIX
        h ^= h >> np.uint64(29)
    h *= _MIX
    return np.unique(h & _TOP48)


def signature(tokens: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _key(sig: bytes) -> int:
    return int.from_bytes(sig[:8], "little", signed=True)


def required_overlap(a, b, threshold: float):
    """Least overlap of sets of sizes a and b with Jaccard similarity >= threshold."""
    return np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9).astype(np.int64)


def _matches(alpha):
    """How many shared leading shingles a pair with required overlap alpha must have."""
    return 1 + np.floor(SLACK * alpha).astype(np.int64)


def _slots(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (tokens >> np.uint64(64 - bits)).astype(np.int64)


def _signatures(shingle: int, id_col: str, text_col: str, bits: int):
    """Per text its signature and set size (kind 0); per task its shingle counts in CHUNKS blobs (kind 1)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, held = np.zeros(1 << bits, np.int32), []
        for pdf in batches:
            ids, keys, sigs, sizes = [], [], [], []
            for i, text in zip(pdf[id_col], pdf[text_col]):
                s = shingle_set(text, shingle)
                if len(s):
                    sig = signature(s)
                    ids.append(i), keys.append(_key(sig)), sigs.append(sig), sizes.append(len(s))
                    held.append(_slots(s, bits))
            if held:
                counts += np.bincount(np.concatenate(held), minlength=len(counts)).astype(np.int32)
                held = []
            yield pd.DataFrame({"kind": 0, "id": ids, "v": keys, "sig": sigs, "n": sizes})
        if counts.any():
            part = len(counts) // CHUNKS
            blobs = [zlib.compress(counts[c * part : (c + 1) * part].tobytes(), 1) for c in range(CHUNKS)]
            yield pd.DataFrame({"kind": 1, "id": range(CHUNKS), "v": 0, "sig": blobs, "n": 0})

    return run


def _merge_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds up the blobs of each chunk; holds one array a chunk, however many tasks sent one."""
    sums: dict[int, np.ndarray] = {}
    for pdf in batches:
        for c, blob in zip(pdf["id"], pdf["sig"]):
            a = np.frombuffer(zlib.decompress(blob), np.int32).astype(np.int64)
            sums[c] = np.minimum(sums[c] + a, 2**31 - 1) if c in sums else a
    if sums:
        yield pd.DataFrame({"id": list(sums), "sig": [zlib.compress(a.astype(np.int32).tobytes(), 1) for a in sums.values()]})


def _postings(shingle: int, threshold: float, text_col: str, counts, buckets: int, list_rows: int, usual: int, bits: int):
    """The leading shingles of each set, packed by index bucket. `usual` is the mean counter: what a counter has beyond it is about the shingle's own count."""

    def pack(docs: list, buckets_: int) -> Iterator[tuple[int, bytes]]:
        keys = np.array([d[0] for d in docs], np.int64)
        sizes = np.array([d[1] for d in docs], np.int64)
        tok = np.concatenate([d[2] for d in docs])
        pos = np.concatenate([d[3] for d in docs])
        side = np.concatenate([d[4] for d in docs])
        doc = np.repeat(np.arange(len(docs)), [len(d[2]) for d in docs])
        bucket = (tok % np.uint64(buckets_)).astype(np.int64)
        order = np.lexsort((tok, bucket))
        tok, pos, side, doc, bucket = tok[order], pos[order], side[order], doc[order], bucket[order]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(bucket)]):
            used, local = np.unique(doc[lo:hi], return_inverse=True)
            head = np.array([len(used), hi - lo], np.int64).tobytes()
            body = b"".join(
                a.tobytes()
                for a in (keys[used], sizes[used].astype(np.int32), np.diff(tok[lo:hi], prepend=np.uint64(0)), local.astype(np.int32), pos[lo:hi].astype(np.int32), side[lo:hi].astype(np.int8))
            )
            yield int(bucket[lo]), head + zlib.compress(body, 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, docs, seen, rows = counts.value, [], set(), 0
        for pdf in batches:
            for text in pdf[text_col]:
                s = shingle_set(text, shingle)
                n = len(s)
                if not n:
                    continue
                key = _key(signature(s))
                if key in seen:
                    continue
                seen.add(key)
                c = table[_slots(s, bits)]
                least = math.ceil(threshold * n - 1e-9)
                p = min(n, n - least + int(_matches(np.array(least))))
                # A shingle whose counter is 1 occurs in no other text; equal counters are ordered by hash.
                order = np.lexsort((s, c))[:p]
                keep = c[order] > 1
                tok, pos, cnt = s[order][keep], np.flatnonzero(keep), c[order][keep]
                tok, side = tok >> np.uint64(16), np.full(len(pos), 2, np.int8)
                if (hot := cnt - usual > list_rows).any():
                    cells = [(tok[~hot], pos[~hot], side[~hot])]
                    for t, q, m in zip(tok[hot], pos[hot], cnt[hot]):
                        grid = math.ceil((int(m) - usual) / list_rows)
                        r = int((np.uint64(key & (2**64 - 1)) * _MIX) % np.uint64(grid))
                        at = np.arange(grid, dtype=np.uint64)
                        cell = np.minimum(at, np.uint64(r)) * np.uint64(grid) + np.maximum(at, np.uint64(r))
                        own = ((cell + np.uint64(1)) * _MIX ^ (t * np.uint64(0xC2B2AE3D27D4EB4F))) >> np.uint64(16)
                        cells.append((own, np.full(grid, q), np.where(at == r, 2, (at < r).astype(np.int8)).astype(np.int8)))
                    tok, pos, side = (np.concatenate(x) for x in zip(*cells))
                docs.append((key, n, tok, pos, side))
                rows += len(tok)
            if rows > 3_000_000:
                yield pd.DataFrame(list(pack(docs, buckets)), columns=["bucket", "blob"])
                docs, seen, rows = [], set(), 0
        if docs:
            yield pd.DataFrame(list(pack(docs, buckets)), columns=["bucket", "blob"])

    return run


def _unpack(blobs) -> tuple[np.ndarray, ...]:
    out = []
    for blob in blobs:
        nd, m = np.frombuffer(blob, np.int64, 2)
        body, at = zlib.decompress(memoryview(blob)[16:]), 0

        def take(dtype, n):
            nonlocal at
            a = np.frombuffer(body, dtype, n, at)
            at += a.nbytes
            return a

        keys, sizes = take(np.int64, nd), take(np.int32, nd)
        tok, doc = np.cumsum(take(np.uint64, m), dtype=np.uint64), take(np.int32, m)
        out.append((tok, keys[doc], sizes[doc].astype(np.int64), take(np.int32, m).astype(np.int64), take(np.int8, m)))
    return tuple(np.concatenate(x) for x in zip(*out))


def list_pairs(tok, key, size, pos, side, threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs that meet in an inverted list at positions where they can still be similar: (key_a, key_b, k) in chunks.

    Entries whose block or whose place in a block is out of range are skipped by binary search, not by comparison.
    """
    order = np.lexsort((key, pos, size, tok))
    tok, key, size, pos, side = tok[order], key[order], size[order], pos[order], side[order]
    again = np.r_[False, (tok[1:] == tok[:-1]) & (key[1:] == key[:-1])]
    alone = np.r_[True, tok[1:] != tok[:-1]] & np.r_[tok[1:] != tok[:-1], True]
    keep = ~(again | alone)
    tok, key, size, pos, side = tok[keep], key[keep], size[keep], pos[keep], side[keep]
    if not len(tok):
        return
    lists = np.cumsum(np.r_[True, tok[1:] != tok[:-1]]) - 1
    width, height = int(size.max()) + 2, int(pos.max()) + 2
    place = (lists * width + size) * height + pos
    starts = np.flatnonzero(np.r_[True, (lists[1:] != lists[:-1]) | (size[1:] != size[:-1])])
    block_list, block_size = lists[starts], size[starts]
    blocks = block_list * width + block_size
    # The probe's own position bounds the partner's size from above: alpha - k <= |y| - 1 - pos.
    share = threshold / (1 + threshold)
    largest = np.floor((size - pos + 1) / (share * (1 - SLACK)) - size + 1e-6).astype(np.int64)
    least = np.ceil(threshold * size - 1e-9).astype(np.int64)
    lo = np.searchsorted(blocks, lists * width + least)
    hi = np.searchsorted(blocks, lists * width + np.minimum(largest, size), side="right")
    n = np.maximum(hi - lo, 0)
    ends = np.cumsum(n)
    first = 0
    while first < len(n):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + 4_000_000, side="right")))
        m = n[first:last]
        y = np.repeat(np.arange(first, last), m)
        b = np.arange(len(y)) - np.repeat(np.cumsum(m) - m, m) + lo[y]
        v = block_size[b]
        alpha = required_overlap(v, size[y], threshold)
        reach = _matches(alpha) - 1 - alpha
        ok = pos[y] <= size[y] + reach
        y, b, v, reach = y[ok], b[ok], v[ok], reach[ok]
        top = np.minimum(v + reach, height - 1)
        stop = np.minimum(np.searchsorted(place, blocks[b] * height + top, side="right"), y)
        got = np.maximum(stop - starts[b], 0)
        some = got > 0
        y, b, got = y[some], b[some], got[some]
        done = 0
        while done < len(got):
            upto = max(done + 1, int(np.searchsorted(np.cumsum(got[done:]), 4_000_000)) + done)
            g = got[done:upto]
            yy = np.repeat(y[done:upto], g)
            xx = np.arange(len(yy)) - np.repeat(np.cumsum(g) - g, g) + starts[b[done:upto]].repeat(g)
            fine = (side[xx] != side[yy]) | (side[xx] == 2)
            xx, yy = xx[fine], yy[fine]
            yield np.minimum(key[xx], key[yy]), np.maximum(key[xx], key[yy]), _matches(required_overlap(size[xx], size[yy], threshold))
            done = upto
        first = last


def _count(parts: list) -> tuple[np.ndarray, ...]:
    """Adds up (a, b, k, count) parts by pair."""
    a, b, k, c = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((b, a))
    a, b, k, c = a[order], b[order], k[order], c[order]
    at = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, np.int64)
    return a[at], b[at], np.maximum.reduceat(k, at) if len(at) else k, np.add.reduceat(c, at) if len(at) else c


def _candidates(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts, rows = [], 0
        for a, b, k in list_pairs(*_unpack(pdf["blob"]), threshold):
            parts.append((a, b, k, np.ones(len(a), np.int64)))
            rows += len(a)
            if rows > 8_000_000:
                parts = [_count(parts)]
                rows = len(parts[0][0])
        a, b, k, c = _count(parts) if parts else (np.empty(0, np.int64),) * 4
        return pd.DataFrame({"a": a, "b": b, "k": k, "c": c})

    return run


def _bloom_slots(keys: np.ndarray) -> np.ndarray:
    h = keys.view(np.uint64) * _MIX
    return np.stack([h >> np.uint64(64 - BLOOM_BITS), (h << np.uint64(BLOOM_BITS)) >> np.uint64(64 - BLOOM_BITS)])


def _bloom_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    bits, some = np.zeros(1 << BLOOM_BITS, bool), False
    for pdf in batches:
        if len(pdf):
            bits[_bloom_slots(pdf["id"].to_numpy(np.int64).copy())] = True
            some = True
    if some:
        yield pd.DataFrame({"g": [0], "bits": [zlib.compress(np.packbits(bits).tobytes(), 1)]})


def _bloom_merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    bits = None
    for pdf in batches:
        for blob in pdf["bits"]:
            a = np.frombuffer(zlib.decompress(blob), np.uint8)
            bits = a if bits is None else bits | a
    if bits is not None:
        yield pd.DataFrame({"bits": [zlib.compress(bits.tobytes(), 1)]})


def _needed_sets(shingle: int, bloom):
    """The sets of the texts whose id may be among those needed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.unpackbits(np.frombuffer(zlib.decompress(bloom.value), np.uint8))
        for pdf in batches:
            pdf = pdf[bits[_bloom_slots(pdf["id"].to_numpy(np.int64).copy())].all(axis=0)]
            ids, sigs, sets = [], [], []
            for i, text in zip(pdf["id"], pdf["text"]):
                s = shingle_set(text, shingle)
                if len(s):
                    ids.append(i), sigs.append(signature(s))
                    sets.append(s.byteswap().view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
            yield pd.DataFrame({"id": ids, "sig": sigs, "set": sets})

    return run


def _read_set(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return wide.view(">u8").ravel().astype(np.uint64)


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(x) else 0


def block_overlaps(sets: dict, partners: dict, near: float = 0.8) -> dict:
    """Overlaps of every (a, b) with b in partners[a].

    The a's are taken by size. Where the last a computed in full (the leader) is similar to the
    next one, overlaps with partners the leader also has come from the leader's, corrected by the
    shingles in which the two differ; other partners are intersected.
    """
    out, leader, known = {}, None, {}
    for a in sorted(partners, key=lambda a: (len(sets[a]), a)):
        x = sets[a]
        if leader is not None and a in known and known[a] >= near * max(len(x), len(sets[leader])):
            more, less = np.setdiff1d(x, sets[leader], assume_unique=True), np.setdiff1d(sets[leader], x, assume_unique=True)
            for b in partners[a]:
                z = sets[b]
                out[a, b] = known[b] + _common(more, z) - _common(less, z) if b in known else _common(x, z)
        else:
            leader, known = a, {a: len(x)}
            for b in partners[a]:
                out[a, b] = known[b] = _common(x, sets[b])
    return out


def _verify(threshold: float):
    def run(docs: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        docs = docs.drop_duplicates("sig")
        sets = {sig: _read_set(blob) for sig, blob in zip(docs["sig"], docs["set"])}
        by_key: dict[int, list[bytes]] = {}
        for sig in docs["sig"]:
            by_key.setdefault(_key(sig), []).append(sig)
        partners: dict[bytes, list[bytes]] = {}
        for a, b in zip(pairs["a"], pairs["b"]):
            for p in by_key.get(a, ()):
                for q in by_key.get(b, ()):
                    partners.setdefault(p, []).append(q)
        rows = []
        for (p, q), o in block_overlaps(sets, partners).items():
            m, n = len(sets[p]), len(sets[q])
            if o >= threshold * (m + n - o) - 1e-9 * (m + n):
                rows.append((*((p, q, o, m, n) if p < q else (q, p, o, n, m)),))
        return pd.DataFrame(rows, columns=["sig_a", "sig_b", "overlap", "size_a", "size_b"])

    return run


def near_duplicates(
    df: DataFrame, id_col: str, text_col: str, shingle: int = 5, threshold: float = 0.8, list_rows: int = LIST_ROWS, bucket_rows: int = BUCKET_ROWS, block_pairs: int = BLOCK_PAIRS, sketch_bits: int = SKETCH_BITS
) -> tuple[DataFrame, DataFrame]:
    """Membership (id, sig, n) of texts in classes of equal shingle sets, and all similar pairs (sig_a, sig_b, overlap, size_a, size_b) of classes.

    Null, empty and short texts (fewer than `shingle` words) are in no class. Rows with a null id are left out. An id
    that occurs with several texts is a member of several classes. Other columns are ignored. An empty table gives two empty results.
    Counters take 4 * 2**sketch_bits bytes in each Python worker: more of them order shingles better on more than some 100 GB of text, and change no result.
    """
    spark = df.sparkSession
    docs = spread(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL"))
    first = materialize(docs.mapInPandas(_signatures(shingle, "id", "text", sketch_bits), "kind int, id long, v long, sig binary, n int"), "signatures")
    members = first.where("kind = 0").select("id", "sig", "n")
    counts = np.zeros(1 << sketch_bits, np.int32)
    part = len(counts) // CHUNKS
    merged = first.where("kind = 1").select("id", "sig").repartition(CHUNKS // 4, "id").mapInPandas(_merge_counts, "id long, sig binary")
    for c, blob in merged.collect():  # CHUNKS rows, 4 bytes a counter
        counts[c * part : (c + 1) * part] = np.frombuffer(zlib.decompress(blob), np.int32)
    total = int(counts.sum(dtype=np.int64))
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(shuffle, math.ceil(total * (1 - threshold) / bucket_rows))
    shared = spark.sparkContext.broadcast(counts)
    blocks = docs.mapInPandas(_postings(shingle, threshold, "text", shared, buckets, list_rows, total // len(counts), sketch_bits), "bucket long, blob binary")
    met = blocks.groupBy("bucket").applyInPandas(_candidates(threshold), "a long, b long, k long, c long")
    cand = materialize(met.groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("k").alias("k")).where("c >= k").select("a", "b", "k"), "candidates")
    ends = cand.select(F.col("a").alias("v"), F.col("b").alias("u")).union(cand.select("b", "a"))
    labels = ends.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("label"))
    keyed = cand.join(labels.withColumnRenamed("v", "a"), "a")
    # A block is bounded in pairs, in sets where many texts have few pairs each, and in bytes where sets are large: k tells the overlap, and so the sizes, of a pair.
    size = keyed.groupBy("label").agg(F.count("*").alias("pairs"), (F.approx_count_distinct("a") + F.approx_count_distinct("b")).alias("texts"), F.avg("k").alias("k"))
    set_bytes = F.col("texts") * F.col("k") * (6 / SLACK * (1 + threshold) / threshold / 2)
    grid = F.greatest(F.ceil(F.sqrt(F.col("pairs") / block_pairs)), F.ceil(F.col("texts") / block_pairs), F.ceil(set_bytes / BLOCK_BYTES))
    wide = size.select("label", grid.cast("int").alias("grid"))
    keyed = materialize(
        keyed.join(wide, "label").select("a", "b", "label", F.pmod(F.xxhash64("a"), "grid").alias("i"), F.pmod(F.xxhash64("b"), "grid").alias("j")), "blocks"
    )
    need = keyed.select(F.col("a").alias("v"), "label", "i", "j").union(keyed.select("b", "label", "i", "j")).distinct().toDF("v", "l", "m", "n")
    # One text stands for each class; only the texts that stand for a class in `need` are read again.
    stand = first.where("kind = 0").groupBy("v", "sig").agg(F.min("id").alias("id")).select("v", "id")
    need = materialize(need.join(stand, "v").select("id", "l", "m", "n"), "needed")
    bloom = need.select("id").mapInPandas(_bloom_part, "g int, bits binary").repartition(1).mapInPandas(_bloom_merge, "bits binary").collect()
    filled = spark.sparkContext.broadcast(bloom[0].bits if bloom else zlib.compress(bytes(1 << BLOOM_BITS - 3)))
    sets = docs.mapInPandas(_needed_sets(shingle, filled), "id long, sig binary, set binary")
    placed = sets.join(need, "id")
    pairs = placed.groupBy("l", "m", "n").cogroup(keyed.groupBy("label", "i", "j")).applyInPandas(_verify(threshold), "sig_a binary, sig_b binary, overlap long, size_a long, size_b long")
    return members, materialize(pairs.where("sig_a IS NOT NULL"), "pairs")


def expand_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """All pairs (a, b) of ids, a < b: within classes, and across similar classes."""
    m = members.select("id", "sig").distinct()
    again = m.groupBy("sig").agg(F.count("*").alias("copies")).where("copies > 1").select("sig")
    copies = m.join(again, "sig")
    inside = copies.alias("x").join(copies.alias("y"), "sig").where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    p = pairs.select("sig_a", "sig_b")
    across = (
        p.join(m.select(F.col("sig").alias("sig_a"), F.col("id").alias("p")), "sig_a")
        .join(m.select(F.col("sig").alias("sig_b"), F.col("id").alias("q")), "sig_b")
        .where("p <> q")
        .select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    )
    both = inside.union(across)
    return both.distinct()


def classes(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row a document: (id, class_id, copies, links). class_id is the least id of its class; links counts the similar other classes."""
    per = members.groupBy("sig").agg(F.min("id").alias("class_id"), F.count_distinct("id").alias("copies"))
    links = pairs.select(F.col("sig_a").alias("sig")).union(pairs.select("sig_b")).groupBy("sig").agg(F.count("*").alias("links"))
    per = per.join(links, "sig", "left").select("sig", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return members.select("id", "sig").distinct().join(per, "sig").select("id", "class_id", "copies", "links")


def groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row a document: (id, group_id, size). Groups are the connected components of similar classes; group_id is the least id in it."""
    roots = components(pairs, "sig_a", "sig_b")
    m = members.select("id", "sig").distinct()
    rooted = m.join(roots.withColumnRenamed("node", "sig"), "sig", "left").select("id", F.coalesce("root", "sig").alias("root"))
    per = rooted.groupBy("root").agg(F.min("id").alias("group_id"), F.count_distinct("id").alias("size"))
    return rooted.join(per, "root").select("id", "group_id", "size").distinct()
