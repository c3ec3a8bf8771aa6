"""Filling fixed-capacity containers (problem 7): best-fit decreasing over all items.

Items of one size are interchangeable, so the packing needs only the number of items of each size, at most
`capacity` rows whatever the table holds. The driver packs these counts: sizes descend, and
a segment tree over remaining capacities finds the tightest open containers that still take the size in
logarithmic time. Containers with the same remaining capacity form runs of consecutive numbers
and take a whole run of items in one step, which gives the same containers as one item at a time. The plan (which
ranks of a size go to which run of containers) is joined back to the items, which are ranked within their size in
parts, so that a size that many items share isn't ordered in one task.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quernstone.sources.scratch import materialize

#: Items that one part of a size's ranking would hold if all items had that size.
PART_ROWS = 500_000


class _Tree:
    """A segment tree over remaining capacities 0..top that knows where containers are open."""

    def __init__(self, top: int):
        self.leaves = 1 << top.bit_length()
        self.some = bytearray(2 * self.leaves)

    def set(self, at: int, some: bool) -> None:
        node = at + self.leaves
        self.some[node] = some
        while node > 1:
            node >>= 1
            self.some[node] = self.some[2 * node] | self.some[2 * node + 1]

    def at_least(self, low: int) -> int | None:
        """The least remaining capacity >= low that an open container has."""
        node = low + self.leaves
        if self.some[node]:
            return low
        while node > 1:
            if not node & 1 and self.some[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return None
        while node < self.leaves:
            node = 2 * node if self.some[2 * node] else 2 * node + 1
        return node - self.leaves


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over `counts` (size to number): rows (size, first rank, last rank, first container, items per container).

    Ranks count from 0 within a size; the items of a row fill consecutive containers with `items per container` each.
    """
    tree, open_, made, out = _Tree(capacity), [[] for _ in range(capacity + 1)], 0, []

    def leave(remaining: int, first: int, n: int) -> None:
        if n and remaining:
            open_[remaining].append((first, n))
            tree.set(remaining, True)

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            at = tree.at_least(size)
            if at is None:
                each = capacity // size
                full, rest = divmod(left, each)
                if full:
                    out.append((size, rank, rank + full * each - 1, made, each))
                    leave(capacity - each * size, made, full)
                    made, rank = made + full, rank + full * each
                if rest:
                    out.append((size, rank, rank + rest - 1, made, rest))
                    leave(capacity - rest * size, made, 1)
                    made += 1
                break
            # A container that took one item is the tightest for the next one while the size still fits.
            first, n = open_[at].pop()
            if not open_[at]:
                tree.set(at, False)
            each = at // size
            full, rest = divmod(left, each)
            use = min(n, full)
            if use:
                out.append((size, rank, rank + use * each - 1, first, each))
                leave(at - each * size, first, use)
                rank, left = rank + use * each, left - use * each
            first, n = first + use, n - use
            if n and left and left < each:
                out.append((size, rank, rank + left - 1, first, left))
                leave(at - left * size, first, 1)
                first, n, rank, left = first + 1, n - 1, rank + left, 0
            leave(at, first, n)
    return out


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """(id, part_no, size, bin_id) for items (id, size).

    An item larger than the capacity is split into parts of exactly the capacity and a rest (part_no from 1); others are
    one part. Items of null or non-positive size are left out. Equal ids are separate items. An empty table gives an empty
    result. The order among equal sizes is by id, so the result is the same on every run.
    """
    spark = items.sparkSession
    sized = items.select(F.col(id_col).alias("id"), F.col(size_col).cast("long").alias("n")).where("n > 0")
    whole = F.expr(f"transform(sequence(1, cast(ceil(n / {capacity}) as int)), k -> struct(k as part_no, cast(least({capacity}, n - (k - 1) * {capacity}) as int) as size))")
    parts = sized.select("id", F.explode(whole).alias("x")).select("id", "x.part_no", "x.size")
    parts = materialize(parts, "items")
    n_slots = 8 + parts.count() // PART_ROWS
    parts = parts.withColumn("slot", F.pmod(F.xxhash64("id", "part_no"), F.lit(n_slots)))
    slots = parts.groupBy("size", "slot").agg(F.count("*").alias("n"))  # at most capacity * n_slots rows
    totals = {r.size: r.n for r in slots.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    rows = plan(totals, capacity)
    planned = spark.createDataFrame(rows or [(0, 0, -1, 0, 1)], "p_size int, lo long, hi long, first long, each long")
    w = W.partitionBy("size").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    starts = slots.withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0))).select("size", "slot", "start")
    ranked = parts.withColumn("r", F.row_number().over(W.partitionBy("size", "slot").orderBy("id", "part_no")) - 1)
    ranked = ranked.join(starts, ["size", "slot"]).select("id", "part_no", "size", (F.col("start") + F.col("r")).alias("rank"))
    # The plan is found by range: its rows of one size are an array, sorted by their first rank.
    lists = planned.groupBy("p_size").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "first", "each"))).alias("runs"))
    joined = ranked.join(F.broadcast(lists), ranked.size == lists.p_size) if len(rows) <= 200_000 else ranked.join(lists, ranked.size == lists.p_size)
    run = F.expr("filter(runs, x -> x.lo <= rank and rank <= x.hi)[0]")
    return joined.withColumn("run", run).select("id", "part_no", "size", (F.col("run.first") + F.floor((F.col("rank") - F.col("run.lo")) / F.col("run.each"))).cast("long").alias("bin_id"))
