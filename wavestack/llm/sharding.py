"""Sharding by minimax contiguous partition.

Atomic groups (rows that must stay together) stand in the order of a 64-bit hash of their key. The
smallest capacity with which ``k`` shards hold the groups in that order is found by binary search;
each candidate capacity is checked greedily. The groups themselves never reach the driver: it sees
the sums of at most ``2 ** ROOT_BITS`` hash ranges, narrows the capacity down to an interval, and asks
for finer sums only of the ranges in which some cut can still fall. Four to seven rounds decide the
exact optimum, whatever the number of groups. Greedy cuts at that capacity fill every shard but the last, so the
slack is spread: each cut moves to the place next to its even share from which the smallest capacity can still be kept.

A group larger than an even share would set the capacity for all shards and leave others empty, so
such groups (fewer than ``k`` by definition) are taken out of the hash order: they stand at its end with a
shard each, and the search runs over the rest with the shards that are left.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import drop_staged, read_table, stage

ROOT_BITS, STEP_BITS = 14, 7
SLOT_CHUNKS = 512


def greedy_cuts(sizes: list[int] | np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Ends (exclusive) of at most ``shards`` consecutive runs of at most ``capacity``; None if impossible."""
    total = np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype=np.int64))])
    at, ends = 0, []
    while at < len(total) - 1:
        to = int(np.searchsorted(total, total[at] + capacity, side="right")) - 1
        if to <= at or len(ends) == shards:
            return None
        ends.append(to)
        at = to
    return ends


def minimax(sizes: list[int] | np.ndarray, shards: int) -> tuple[int, list[int]]:
    """The smallest feasible capacity and its cuts, for sizes at hand."""
    sizes = np.asarray(sizes, dtype=np.int64)
    if not len(sizes):
        return 0, []
    low, high = max(int(sizes.max()), -(-int(sizes.sum()) // shards)), int(sizes.sum())
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if greedy_cuts(sizes, mid, shards) else (mid + 1, high)
    return low, greedy_cuts(sizes, low, shards)


def level_cuts(total: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Ends of runs of at most ``capacity`` with sums as even as that allows; ``total`` holds running sums from 0.

    Every cut keeps what is left within the capacity: it is not before the last place from which the
    remaining shards still reach the end, and not past what its own shard can hold.
    """
    n = len(total) - 1
    least = [n]  # from the back: the first place from which so many shards reach the end
    for _ in range(shards):
        least.append(int(np.searchsorted(total, total[least[-1]] - capacity, side="left")))
    ends, at = [], 0
    for i in range(shards):
        low = max(least[shards - 1 - i], at)
        high = int(np.searchsorted(total, total[at] + capacity, side="right")) - 1
        want = total[at] + (total[-1] - total[at]) / (shards - i)
        k = int(np.searchsorted(total, want))
        if k > at and (k > n or want - total[k - 1] <= total[k] - want):
            k -= 1
        at = min(max(k, low), high)
        ends.append(at)
    return ends


def _heavy(groups: DataFrame, total: int, shards: int) -> list[tuple[int, int]]:
    """Groups above an even share of what is left, largest first; fewer than ``shards``."""
    top = groups.orderBy(F.desc("size"), "h").limit(shards - 1).collect() if shards > 1 else []
    out = []
    for row in top:
        if row["size"] * (shards - len(out)) <= total:
            break
        out.append((row["h"], row["size"]))
        total -= row["size"]
    return out


def _open_ranges(total: np.ndarray, single: np.ndarray, low: int, high: int, shards: int) -> set[int]:
    """Ranges in which the greedy cuts of some capacity from ``low`` to ``high`` can fall."""
    n, found = len(total) - 1, set()
    first = last = 0  # sums at which the shard can start, at the least and at the most
    for _ in range(shards):
        a = int(np.searchsorted(total, first + low, side="right")) - 1
        b = int(np.searchsorted(total, last + high, side="right")) - 1
        found.update(i for i in range(a, min(b, n - 1) + 1) if not single[i])
        if a >= n:
            break
        first, last = int(total[a]), int(total[min(b + 1, n)])
    return found


def plan_cuts(groups: DataFrame, shards: int) -> tuple[int, list[int], int]:
    """(capacity, first unsigned hash past each shard in order, shards used) over ``groups`` (h long, size long)."""
    order = F.expr(f"shiftrightunsigned(h, {64 - ROOT_BITS})")
    bits = ROOT_BITS

    def sums(df: DataFrame, key) -> dict[int, tuple[int, int]]:
        rows = df.groupBy(key.alias("r")).agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect()
        return {int(x["r"]) & (2**64 - 1): (int(x["s"]), int(x["n"])) for x in rows}

    # (first unsigned hash, bits, size, groups) of each range, in order
    ranges = [(r << (64 - bits), bits, s, n) for r, (s, n) in sorted(sums(groups, order).items())]
    if not ranges:
        return 0, [], 0
    while True:
        sizes = np.array([x[2] for x in ranges], dtype=np.int64)
        single = np.array([x[3] == 1 or x[1] >= 64 for x in ranges])
        total = np.concatenate([[0], np.cumsum(sizes)])
        # ranges as atoms bound the optimum from above; a range's parts can end a shard earlier by one range at most
        high, cuts = minimax(sizes, shards)
        low = max(-(-int(total[-1]) // shards), int(sizes[single].max()) if single.any() else 0)
        low = max(low, high - int(sizes[~single].max()) if not single.all() else high)
        todo = _open_ranges(total, single, min(low, high), high, shards)
        if not todo:
            cuts = level_cuts(total, high, shards)
            # an even share can also end within a range: the ranges on both sides of each cut are looked into
            todo = {i for e in cuts[:-1] for i in (e - 1, e) if 0 <= i < len(ranges) and not single[i]}
        if not todo:
            return high, [((ranges[e - 1][0] + (1 << (64 - ranges[e - 1][1]))) if 0 < e < len(ranges) else 2**64 if e else 0) for e in cuts], len(cuts)
        deeper = []
        for b in sorted({ranges[i][1] for i in todo}):
            own = [ranges[i][0] for i in sorted(todo) if ranges[i][1] == b]
            keys = groups.sparkSession.createDataFrame([(x >> (64 - b),) for x in own], "r long")
            finer = min(b + STEP_BITS, 64)
            at = F.expr(f"shiftrightunsigned(h, {64 - b})")
            some = groups.withColumn("r", at).join(F.broadcast(keys), "r", "left_semi")
            deeper += [(r << (64 - finer), finer, s, n) for r, (s, n) in sums(some, F.expr(f"shiftrightunsigned(h, {64 - finer})")).items()]
        ranges = sorted([x for i, x in enumerate(ranges) if i not in todo] + deeper)


def shard_documents(docs: DataFrame, shards: int = 40, text: str = "text", key: str = "doc_id", overhead: int = 16) -> DataFrame:
    """Assign every row of ``docs`` to one of ``shards`` shards of near equal bytes.

    Rows with equal text form a group and share a shard; null counts as empty text. Size: UTF-8 bytes
    plus ``overhead``. Returns key, size, text_crc32, shard and slot (0, 1, ... in each shard, in the
    order of a hash chunk and then of the key). Repeated rows each get a slot of their own. An empty
    table gives an empty result; fewer groups than shards leave shards empty; other columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body, F.octet_length(body)).alias("h"),
    )
    slim = stage(slim, "shard-rows")
    groups = stage(slim.groupBy("h").agg(F.sum("size").alias("size")), "shard-groups")
    total = groups.agg(F.sum("size")).first()[0] or 0
    heavy = _heavy(groups, total, shards)
    rest = groups.where(~F.col("h").isin([h for h, _ in heavy])) if heavy else groups
    _, cuts, used = plan_cuts(rest, shards - len(heavy))
    # first hash past each shard, shifted so that signed comparison follows the unsigned order
    bounds = [c - 2**63 for c in cuts[:-1] if c < 2**64]
    flipped = F.col("h").bitwiseXOR(F.lit(-(2**63)).cast("long"))
    shard = F.lit(0)
    if bounds:
        ends = F.array(*[F.lit(b).cast("long") for b in bounds])
        shard = F.size(F.filter(ends, lambda e: e <= flipped))
    for i, (h, _) in enumerate(heavy):
        shard = F.when(F.col("h") == F.lit(h), F.lit(shards - 1 - i)).otherwise(shard)
    placed = slim.withColumn("shard", shard.cast("int")).withColumn("chunk", F.pmod(F.xxhash64("doc_id", "h", F.lit(7)), F.lit(SLOT_CHUNKS)).cast("int"))
    # at most shards * SLOT_CHUNKS rows: the first slot of every chunk
    counts = placed.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("doc_id", "h"))
    return (
        placed.withColumn("rank", within)
        .join(F.broadcast(offsets), ["shard", "chunk"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"))
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 under the law ``bytes``."""
    out = shard_documents(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast(T.IntegerType()).alias("grown_shard"))
