"""Minimax contiguous sharding: the smallest shard capacity under which ordered groups,
none of them split, fit into k shards one after another.

Groups are rows of equal texts, in the order of a hash of the text. The search for the
capacity looks at sums of key ranges first: a capacity that suffices for whole ranges
bounds the smallest one from above, one that suffices if ranges could be cut anywhere
bounds it from below, and only ranges in which a cut of a capacity between the bounds may
fall are read in more detail, until those are single groups. The driver holds a few
thousand sums at a time, whatever the number of rows.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlab.llm.common import drop_staged, staged, table

KEY_BITS, FIRST_BITS, MORE_BITS = 60, 10, 8


@dataclass(order=True)
class Range:
    """Groups whose keys share ``bits`` leading bits ``prefix``."""

    low: int  # the smallest key that could be in it
    bits: int
    total: int
    largest: int
    groups: int

    @property
    def whole(self) -> bool:
        return self.groups == 1


def fill(ranges: list[Range], capacity: int, loose: bool) -> list[int] | None:
    """Ends of the shards (sums from the start) that greedy filling makes; None where a
    range doesn't fit. ``loose``: ranges of several groups may be cut anywhere."""
    ends, done, used = [], 0, 0
    for r in ranges:
        if used + r.total <= capacity:
            used += r.total
        elif loose and not r.whole:
            rest = r.total
            while used + rest > capacity:
                rest -= capacity - used
                done += capacity
                ends.append(done)
                used = 0
            used = rest
        elif r.total > capacity:
            return None
        else:
            done += used
            ends.append(done)
            used = r.total
    return ends


def smallest(ranges: list[Range], k: int, low: int, high: int, loose: bool) -> int:
    """The smallest capacity in [low, high] that makes at most k shards; high must do."""
    while low < high:
        mid = (low + high) // 2
        ends = fill(ranges, mid, loose)
        if ends is not None and len(ends) < k:
            high = mid
        else:
            low = mid + 1
    return low


def undecided(ranges: list[Range], k: int, low: int, high: int) -> list[Range]:
    """Ranges of several groups where a cut for a capacity in [low, high] may fall."""
    early = fill(ranges, low, False)
    late = fill(ranges, high, True) or []
    total = sum(r.total for r in ranges)
    early = early if early is not None else []
    spans = [(early[j] if j < len(early) else 0, late[j] if j < len(late) else total) for j in range(min(k, max(len(early), len(late))))]
    if not early and fill(ranges, low, False) is None:  # some range is larger than the bound
        spans = [(0, total)]
    out, start = [], 0
    for r in ranges:
        stop = start + r.total
        if not r.whole and any(a < stop and b >= start for a, b in spans):
            out.append(r)
        start = stop
    return out


def cut_points(groups: DataFrame, k: int, most: int = 1 << 15) -> tuple[int, list[int]]:
    """The smallest capacity, and the first key of each shard but the first, from the
    staged table ``groups`` (key, size) of one row for each group."""

    def sums(rows: DataFrame, bits: int) -> list[Range]:
        low = F.shiftright("key", KEY_BITS - bits)
        found = rows.groupBy(low.alias("p")).agg(F.sum("size").alias("t"), F.max("size").alias("m"), F.count("*").alias("n"))
        return [Range(r.p << (KEY_BITS - bits), bits, r.t, r.m, r.n) for r in found.collect()]

    ranges = sorted(sums(groups, FIRST_BITS))
    if not ranges:
        return 0, []
    while True:
        total = sum(r.total for r in ranges)
        low = max(-(-total // k), max(r.largest for r in ranges))
        low = smallest(ranges, k, low, total, True)
        high = smallest(ranges, k, low, total, False)
        open_ = undecided(ranges, k, low, high) if low < high or any(not r.whole for r in ranges) else []
        if not open_:
            break
        bits = {r.bits for r in open_}
        step = min(MORE_BITS, max(1, (most // len(open_)).bit_length() - 1))
        finer: list[Range] = []
        for b in bits:  # ranges of equal width are read together
            names = groups.sparkSession.createDataFrame([(r.low >> (KEY_BITS - b),) for r in open_ if r.bits == b], "p bigint")
            rows = groups.withColumn("p", F.shiftright("key", KEY_BITS - b)).join(F.broadcast(names), "p", "left_semi")
            finer += sums(rows, min(KEY_BITS, b + step))
        gone = {(r.low, r.bits) for r in open_}
        ranges = sorted([r for r in ranges if (r.low, r.bits) not in gone] + finer)
    ends = fill(ranges, high, False) or []
    cuts, at = [], 0
    for r in ranges:
        if bisect_right(ends, at) > len(cuts) and at:
            cuts.append(r.low)
        at += r.total
    return high, cuts


def shard(documents: DataFrame, k: int = 16, *, id_col: str = "doc_id", text_col: str = "text", cell_rows: int = 1_000_000) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, capacity) for each row.

    The size of a row is its text's UTF-8 bytes plus 1; a null text is an empty one and in
    its group. Rows of equal texts are in one shard. Slots number a shard's rows from 0
    without gaps. An empty table gives no rows; repeated rows, ids and nulls in the id are
    kept as they are. Fewer groups than shards leave the last shards empty.
    """
    spark = documents.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.conv(F.substring(F.md5(text), 1, KEY_BITS // 4), 16, 10).cast("bigint")
    rows, _ = staged(documents.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("key")), "rows")
    groups, groups_at = staged(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    capacity, cuts = cut_points(groups, k)
    drop_staged(spark, groups_at)
    n = sum((F.when(F.col("key") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    # slots: rows are dealt to cells of a shard, cells are counted, and a row's slot is its
    # place in its cell behind the rows of the cells before; a group spreads over ``salts``
    salts = max(64, rows.count() // cell_rows)
    placed = rows.withColumn("shard", n.cast("int")).withColumn("bin", F.shiftright("key", KEY_BITS - FIRST_BITS)).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    cell = ["shard", "bin", "salt"]
    cells = placed.groupBy(*cell).agg(F.count("*").alias("m"))
    bins = cells.groupBy("shard", "bin").agg(F.sum("m").alias("b"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("shard", "bin", F.coalesce(F.sum("b").over(before(Window.partitionBy("shard").orderBy("bin"))), F.lit(0)).alias("base"))
    cells = cells.withColumn("inner", F.coalesce(F.sum("m").over(before(Window.partitionBy("shard", "bin").orderBy("salt"))), F.lit(0)))
    cells = cells.join(bins, ["shard", "bin"]).select(*cell, (F.col("base") + F.col("inner")).alias("first"))
    numbered = placed.withColumn("r", F.row_number().over(Window.partitionBy(*cell).orderBy("doc_id", "key")))
    out = numbered.join(cells, cell)
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("r") - 1).cast("bigint").alias("slot"), F.lit(capacity).cast("bigint").alias("capacity"))


def op7_shards(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: 16 shards of near equal bytes."""
    placed = shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "capacity")


def brute_force(sizes: list[int], k: int) -> int:
    """The smallest capacity for ordered sizes, by trying from the lower bound; for tests."""
    capacity = max(max(sizes, default=0), -(-sum(sizes) // k))
    while True:
        shards, used = 1, 0
        for s in sizes:
            if used + s > capacity:
                shards, used = shards + 1, 0
            used += s
        if shards <= k:
            return capacity
        capacity += 1
