"""Minimax contiguous sharding of atomic groups.

Groups stand in order of their smallest doc_id, each with the bytes of its rows. The
smallest capacity at which a greedy walk fills no more than k shards is found by binary
search, and the cuts of that walk are the shards. The prefix sums stay distributed: the
driver holds boundaries of blocks only, and the blocks in which a cut may fall are asked for
anew, finer, until every cut is a true boundary of two groups.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelark.llm._common import prefix_sums, stored

BLOCKS = 4096


class _Walk:
    """Known boundaries in ascending order; hidden[i]: there are more between i and i + 1.

    known: start of a block of groups -> its end, its groups, the start of its last group.
    """

    def __init__(self, rows: list[tuple[int, int, int, int]], total: int, k: int) -> None:
        self.known: dict[int, tuple[int, int, int]] = {}
        self.total, self.k = total, k
        self.refine([], rows)

    def refine(self, gaps: list[int], rows: list[tuple[int, int, int, int]]) -> None:
        for s in gaps:
            del self.known[s]
        self.known |= {s: (e, n, last) for s, e, n, last in rows}
        self.at = sorted(self.known)
        self.hidden = [self.known[s][1] > 1 for s in self.at]

    def walk(self, cap: int, hopeful: bool) -> list[int]:
        """Where shards end at this capacity; hopeful: as if each byte of a hidden gap were a boundary."""
        p, out = 0, []
        for _ in range(self.k):
            t = p + cap
            if t >= self.total:
                return [*out, self.total]
            j = bisect_right(self.at, t) - 1
            p = max(p, t if hopeful and self.hidden[j] and t < self.known[self.at[j]][0] else self.at[j])
            out.append(p)
        return out

    def smallest(self, hopeful: bool) -> int:
        lo, hi = 0, self.total
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.walk(mid, hopeful)[-1] == self.total else (mid, hi)
        return hi


def minimax_cuts(groups: DataFrame, k: int, blocks: int = BLOCKS) -> tuple[int, list[int]]:
    """Smallest capacity and where its greedy shards begin; groups: start, size (both longs), start a prefix sum."""
    spark = groups.sparkSession
    own = groups.where(F.col("size") > 0)
    total, last = own.agg(F.max(F.col("start") + F.col("size")), F.max("start")).first()
    if not total:
        return 0, [0]

    def blocked(gaps: list[tuple[int, int]], n: int) -> list[tuple[int, int, int, int]]:
        """Blocks within each gap (its first and last start); two at least, so that each gap breaks."""
        told = spark.createDataFrame([(lo, hi, max(1, -(-(hi - lo + 1) // n))) for lo, hi in gaps], "lo long, hi long, width long")
        inside = own.where((F.col("start") >= gaps[0][0]) & (F.col("start") <= gaps[-1][1])).join(F.broadcast(told), (F.col("start") >= F.col("lo")) & (F.col("start") <= F.col("hi")))
        found = inside.groupBy("lo", F.floor((F.col("start") - F.col("lo")) / F.col("width")).alias("b")).agg(F.min("start"), F.max(F.col("start") + F.col("size")), F.count(F.lit(1)), F.max("start"))
        return [tuple(r)[2:] for r in found.collect()]

    w = _Walk(blocked([(0, last)], max(2, blocks)), total, k)
    while True:
        lo, hi = w.smallest(True), w.smallest(False)
        ends = list(zip(w.walk(lo, False), w.walk(hi, True), strict=False))
        gaps = [s for i, s in enumerate(w.at) if w.hidden[i] and any(s <= b and w.known[s][0] > a for a, b in ends)]
        if not gaps:
            return hi, [0, *w.walk(hi, False)[:-1]]
        w.refine(gaps, blocked([(s, w.known[s][2]) for s in gaps], max(2, blocks // len(gaps))))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Put every row into one of ``shards`` shards of nearly equal bytes; equal texts stay together.

    docs: doc_id, text; other columns are left aside. The size of a row is the UTF-8 bytes of
    its text (null: none) plus 1; null texts are one group, repeated rows belong to the group
    of their text, and an empty table gives an empty result. A group above the smallest
    capacity takes a shard of its own, and shards may then stay empty.

    Returns doc_id, size, text_crc32, shard, slot (row number in the shard, by doc_id).
    """
    text = F.coalesce("text", F.lit(""))
    rows = stored(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), F.lit("null").cast("binary")).alias("key"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("key").agg(F.coalesce(F.min("doc_id"), F.lit(-(1 << 63))).alias("first"), F.sum("size").alias("size"))
    placed = stored(prefix_sums(groups, ["first", "key"], ["size"], "shard-groups").select("key", "size", F.col("_size").alias("start")), "shard-placed")
    cuts = minimax_cuts(placed, shards)[1]
    shard = sum(((F.col("start") >= c).cast("int") for c in cuts[1:]), F.lit(0)).cast("int")
    dealt = rows.join(placed.select("key", shard.alias("shard")), "key").select("doc_id", "size", "text_crc32", "shard")
    out = prefix_sums(dealt, ["shard", "doc_id", "text_crc32"], [], "shard-slots", group="shard")
    return out.select("doc_id", "size", "text_crc32", "shard", F.col("_n").alias("slot"))
