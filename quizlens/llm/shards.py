"""Minimax contiguous partition of ordered atomic groups into shards, in DataFrame operations only.

Rows of equal text form an atomic group; groups are ordered by their first document. The smallest capacity for
which filling shards greedily needs no more than the wanted number is found by binary search, and the groups are cut
there. A capacity is checked on a bounded summary of the groups' cumulative sizes: the cumulative sums are
binned, and each bin's first, last and number of sums give a lower and an upper bound for every greedy cut. Bins in which a cut is
still uncertain are binned again, finer, until the bounds meet, so the capacity and the cuts are exact and the driver
holds at most BINS rows a round (10 bytes of memory per byte of input would not change that).

Prefix sums and slots are taken in two steps, within ranges of document ids and over the ranges' totals, so no
task has a whole shard or a whole hot group; the only single-task step sees a row for each range.

Defined results: a null text is empty and groups with empty ones; its size is the fixed overhead; null ids come first
in their range; repeated rows have a slot each; fewer groups than shards leave shards empty; an empty table gives no rows.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import narrow, staged, unsigned_crc32

SHARDS = 40
OVERHEAD = 16
#: Rows of the summary that the driver holds in a round.
BINS = 20_000


class _Cuts:
    """Bounds for greedy cuts from bins (first sum, last sum, number of sums) in ascending order."""

    def __init__(self, bins: list[tuple[int, int, int]], total: int, shards: int):
        self.bins, self.total, self.shards = bins, total, shards
        self.firsts = [b[0] for b in bins]

    def bounds(self, to: int) -> tuple[int, int]:
        """The largest cumulative sum up to ``to`` lies between these."""
        k = bisect.bisect_right(self.firsts, to) - 1
        if k < 0:
            return 0, 0
        first, last, n = self.bins[k]
        if last <= to:
            return last, last
        return first, (first if n <= 2 else to)

    def fill(self, capacity: int, side: int) -> list[int] | None:
        """Ends of greedily filled shards by the lower (0) or upper (1) bounds; None if they do not suffice."""
        at, ends = 0, []
        while at < self.total:
            to = self.bounds(at + capacity)[side]
            if to <= at or len(ends) == self.shards:
                return None
            at = to
            ends.append(at)
        return ends

    def smallest(self, side: int) -> int:
        lo, hi = -(-self.total // self.shards), self.total
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.fill(mid, side) is not None else (mid + 1, hi)
        return lo


def _binned(sums: DataFrame, where, width: int) -> list[tuple[int, int, int]]:
    rows = sums.where(where).groupBy((F.col("end") / width).cast("long").alias("bin")).agg(F.min("end").alias("a"), F.max("end").alias("b"), F.count("*").alias("n")).collect()
    return sorted((r.a, r.b, r.n) for r in rows)


def minimax_cuts(sums: DataFrame, total: int, shards: int, bins: int = BINS) -> tuple[int, list[int]]:
    """Smallest feasible capacity and the greedy cuts, from the column ``end`` of cumulative group sizes."""
    found = _binned(sums, F.lit(True), -(-total // bins))
    while True:
        cuts = _Cuts(found, total, shards)
        low, high = cuts.smallest(1), cuts.smallest(0)
        least, most = cuts.fill(low, 0), cuts.fill(high, 1)
        if low == high and least == cuts.fill(low, 1):
            return low, least
        # each cut lies between the lower bound at the lowest capacity and the upper bound at the highest
        spans, at_low, at_high = [], 0, 0
        for _ in range(shards):
            at_low, at_high = cuts.bounds(at_low + low)[0], cuts.bounds(at_high + high)[1]
            spans.append((at_low, at_high))
        unsure = {k for a, b in spans for k in range(max(0, bisect.bisect_right(cuts.firsts, a) - 1), bisect.bisect_right(cuts.firsts, b)) if found[k][2] > 2}
        ranges: list[list[int]] = []
        for k in sorted(unsure):
            if ranges and ranges[-1][2] == k - 1:
                ranges[-1][1:] = found[k][1], k
            else:
                ranges.append([found[k][0], found[k][1], k])
        inside = F.lit(False)
        for a, b, _ in ranges:
            inside = inside | F.col("end").between(a, b)
        width = -(-sum(b - a + 1 for a, b, _ in ranges) // bins)
        finer = _binned(sums, inside, width)
        found = sorted([b for k, b in enumerate(found) if k not in unsure] + finer)


def _before(per_part: DataFrame, value: str) -> DataFrame:
    """pid with the sum of ``value`` over earlier pids; a row for each range of ids."""
    return per_part.select("pid", (F.sum(value).over(Window.orderBy("pid")) - F.col(value)).alias("before"))


def shard(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD, bins: int = BINS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: sizes of shards as equal as whole groups in order allow."""
    base = narrow(docs, id_col, text_col).select("doc_id", (F.octet_length("text") + F.lit(overhead)).cast("long").alias("size"), unsigned_crc32("text").alias("text_crc32"), F.unhex(F.sha2("text", 256)).alias("same"))
    sizes = staged(base, "sizes")
    rows = staged(sizes.repartitionByRange("doc_id", "text_crc32").withColumn("pid", F.spark_partition_id()), "ranges", frees=(sizes,))
    groups = rows.groupBy("same").agg(F.sum("size").alias("size"), F.min("pid").alias("pid"), F.min("doc_id").alias("head"))
    groups = groups.withColumn("within", F.sum("size").over(Window.partitionBy("pid").orderBy("head", "same")))
    groups = staged(groups, "groups")
    before = _before(groups.groupBy("pid").agg(F.sum("size").alias("size")), "size")
    sums = staged(groups.join(before, "pid").select("same", (F.col("before") + F.col("within")).alias("end")), "sums", frees=(groups,))
    total = sums.agg(F.max("end")).first()[0]
    cuts = minimax_cuts(sums, total, shards, bins)[1] if total else []
    number = F.lit(0)
    for end in cuts[:-1]:
        number = number + (F.col("end") > end).cast("int")
    placed = staged(rows.join(sums.select("same", number.alias("shard")), "same").drop("same"), "placed", frees=(rows, sums))
    counts = placed.groupBy("shard", "pid").agg(F.count("*").alias("n"))
    earlier = counts.select("shard", "pid", (F.sum("n").over(Window.partitionBy("shard").orderBy("pid")) - F.col("n")).alias("earlier"))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "pid").orderBy("doc_id", "text_crc32")) - 1)
    return ranked.join(earlier, ["shard", "pid"]).select("doc_id", "size", "text_crc32", "shard", (F.col("earlier") + F.col("rank")).cast("long").alias("slot"))
