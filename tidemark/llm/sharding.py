"""Best-fit-decreasing bin packing of indivisible groups.

Equal texts form one group. Only the histogram of group sizes goes to the driver:
the number of distinct sizes k satisfies k * (k + 1) / 2 <= total bytes, so it is
bounded by the square root of twice the input (about 14 million for 100 TB) and is
some tens of thousands in practice. Groups of one size are interchangeable, so the
packing of a size class is a list of (first rank, last rank, shard) runs. Ranks
inside a class and slots inside a shard come from ordered cells whose counts are
added up, so neither a common size nor a large shard is ranked by one task.

Defined results: a null text counts as the empty text (size 1); repeated rows are
rows of one group with slots of their own; an empty table gives no rows; a group
over the capacity gets a shard of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import Workspace, text_of, with_slots

CELL_ROWS = 50_000


class RemainTree:
    """Balanced search tree (AVL) of (remaining capacity, bin) keys with a ceiling search."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _h(t):
        return t[3] if t else 0

    def _make(self, key, a, b):
        return (key, a, b, 1 + max(self._h(a), self._h(b)))

    def _balance(self, key, a, b):
        if self._h(a) > self._h(b) + 1:
            if self._h(a[1]) >= self._h(a[2]):
                return self._make(a[0], a[1], self._make(key, a[2], b))
            m = a[2]
            return self._make(m[0], self._make(a[0], a[1], m[1]), self._make(key, m[2], b))
        if self._h(b) > self._h(a) + 1:
            if self._h(b[2]) >= self._h(b[1]):
                return self._make(b[0], self._make(key, a, b[1]), b[2])
            m = b[1]
            return self._make(m[0], self._make(key, a, m[1]), self._make(b[0], m[2], b[2]))
        return self._make(key, a, b)

    def insert(self, key):
        def put(t):
            if not t:
                return (key, None, None, 1)
            return self._balance(t[0], put(t[1]), t[2]) if key < t[0] else self._balance(t[0], t[1], put(t[2]))

        self.root = put(self.root)

    def pop_ceiling(self, low):
        """Removes and returns the smallest key that is not below ``low``, or None."""
        best, t = None, self.root
        while t:
            if t[0] >= low:
                best, t = t[0], t[1]
            else:
                t = t[2]
        if best is not None:
            self.root = self._drop(self.root, best)
        return best

    def _drop(self, t, key):
        if key < t[0]:
            return self._balance(t[0], self._drop(t[1], key), t[2])
        if key > t[0]:
            return self._balance(t[0], t[1], self._drop(t[2], key))
        if not t[1] or not t[2]:
            return t[1] or t[2]
        m = t[2]
        while m[1]:
            m = m[1]
        return self._balance(m[0], t[1], self._drop(t[2], m[0]))


def best_fit_decreasing(histogram: list[tuple[int, int]], capacity: int, limit: int | None = None) -> list[tuple[int, int, int, int]] | None:
    """Runs (size, first rank, end rank, bin) for classes of (size, count).

    An item goes to the bin with the least remaining capacity that holds it. That bin
    stays the tightest until it is too full, so a class is placed run by run. With
    ``limit``, None if more bins would be needed.
    """
    tree, runs, bins = RemainTree(), [], 0
    for size, count in sorted(histogram, reverse=True):
        at = 0
        while at < count:
            found = tree.pop_ceiling((size, -1))
            if found is None:
                if limit is not None and bins >= limit:
                    return None
                found, bins = (max(capacity, size), bins), bins + 1
            room, shard = found
            n = min(count - at, room // size)
            runs.append((size, at, at + n, shard))
            tree.insert((room - n * size, shard))
            at += n
    return runs


def even_bins(histogram: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int, int]]:
    """A packing into at most ``bins`` bins of nearly equal sums.

    Items above the fair share of what is left get bins of their own. The others are
    packed at the least capacity that suffices, by bisection, and levelled.
    """
    rest, own = {}, []
    for size, count in histogram:
        rest[size] = rest.get(size, 0) + count
    total, left = sum(s * c for s, c in rest.items()), bins
    for size in sorted(rest, reverse=True):
        while rest[size] and left > 1 and size * left > total:
            own.append((size, left - 1))
            rest[size], total, left = rest[size] - 1, total - size, left - 1
        if rest[size]:
            break
    rest = [(s, c) for s, c in rest.items() if c]
    held = [{} for _ in range(bins)]
    for size, shard in own:
        held[shard] = {size: 1}
    for size, first, end, shard in _least_capacity(rest, left):
        held[shard][size] = held[shard].get(size, 0) + end - first
    _level(held[:left], total // left // 2**20)
    runs, at = [], {}
    for shard, sizes in enumerate(held):
        for size, n in sizes.items():
            first = at.get(size, 0)
            runs.append((size, first, first + n, shard))
            at[size] = first + n
    return runs


def _least_capacity(histogram: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int, int]]:
    """The packing of least capacity into at most ``bins`` bins, by bisection."""
    if not histogram:
        return []
    total = sum(s * c for s, c in histogram)
    lo = max(-(-total // bins), max(s for s, _ in histogram))
    hi = 2 * lo
    best = best_fit_decreasing(histogram, hi, bins)
    while best is None:
        hi *= 2
        best = best_fit_decreasing(histogram, hi, bins)
    exact = best_fit_decreasing(histogram, lo, bins)
    if exact is not None:
        return exact
    while hi - lo > 1 and hi - lo > total // bins // 2**20:
        mid = (lo + hi) // 2
        got = best_fit_decreasing(histogram, mid, bins)
        if got is None:
            lo = mid
        else:
            hi, best = mid, got
    return best


def _level(held: list[dict[int, int]], slack: int) -> None:
    """Moves items from fuller bins to the emptiest while that brings the two nearer; bins map size to count.

    No sum of a bin rises above the greatest, and the sum of squares falls with each move.
    """
    sums = [sum(s * n for s, n in b.items()) for b in held]
    while True:
        to = min(range(len(held)), key=sums.__getitem__)
        for of in sorted(range(len(held)), key=sums.__getitem__, reverse=True):
            gap = sums[of] - sums[to]
            if gap <= slack:
                return
            size = max((s for s in held[of] if s < gap), default=None)
            if size is not None:
                break
        else:
            return
        n = min(held[of][size], max(1, gap // (2 * size)))
        held[of][size] -= n
        if not held[of][size]:
            del held[of][size]
        held[to][size] = held[to].get(size, 0) + n
        sums[of], sums[to] = sums[of] - n * size, sums[to] + n * size


def assign_shards(docs: DataFrame, shards: int | None = None, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, size, text_crc32, shard, slot`` for every row.

    Give ``capacity`` for as few shards of that many bytes as best-fit-decreasing
    needs, or ``shards`` for that many shards of nearly equal bytes.
    """
    spark: SparkSession = docs.sparkSession
    space = Workspace(spark, "sharding")
    text = text_of(docs, text_col)
    rows = space.save(docs.select(docs[id_col].alias(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("g")), "rows")
    groups = space.save(rows.groupBy("g", "size").agg(F.count(F.lit(1)).alias("n")).select("g", (F.col("n") * F.col("size")).alias("gsize")), "groups")
    classes = groups.groupBy("gsize").agg(F.count(F.lit(1)).alias("n"))
    histogram = [(r.gsize, r.n) for r in classes.collect()]
    plan = even_bins(histogram, shards) if capacity is None else best_fit_decreasing(histogram, capacity)
    # a class of many groups is ranked in several cells; there are at most groups / CELL_ROWS such classes
    common = [(s, -(-c // CELL_ROWS)) for s, c in histogram if c > CELL_ROWS]
    cells = spark.createDataFrame(common, "gsize long, cells long")
    placed = groups.join(F.broadcast(cells), "gsize", "left").withColumn("cell", F.pmod(F.xxhash64("g"), F.coalesce("cells", F.lit(1))))
    placed = space.save(placed.drop("cells"), "cells")  # written, for ranking reads it twice
    placed = with_slots(placed, ["gsize"], "cell", ["g"], "rank")
    runs = spark.createDataFrame(plan, "gsize long, first long, end long, shard int")
    placed = placed.join(runs, "gsize").where("rank >= first and rank < end").select("g", "shard")
    placed = space.save(placed, "placed")
    parts = max(64, -(-sum(c for _, c in histogram) // CELL_ROWS))
    assigned = rows.join(placed, "g").withColumn("cell", F.pmod(F.xxhash64(id_col, "text_crc32"), F.lit(parts)))
    assigned = space.save(assigned, "assigned")
    space.drop("rows", "groups", "cells", "placed")
    return with_slots(assigned, ["shard"], "cell", [id_col, "text_crc32", "size"], "slot").select(id_col, "size", "text_crc32", "shard", "slot")


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    """Query: all documents in shards 0 to 7 of nearly equal bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return assign_shards(docs, shards=8).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
