"""Shift and stack: geometric-mean coalescence of onsets over a grid of travel times.

Two forms of one operator. The block form is for real grids and what ``plans.detect`` uses: a task takes one time
chunk with one block of nodes, stacks with array slices, and returns per time the block's maximum, first
argmax, sum and count, which combine exactly; the 4-D map is never built. The row form is joins and aggregates
only: onsets meet the travel times of their station and phase (a small table is broadcast, its rows being counted
first), each product lands on its (node, time) cell, and the cell's mean log is a partial aggregate. It gives the cells
themselves and serves the small maps around single events.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import with_small

FLOOR = 0.01


def stack(onsets: DataFrame, table: DataFrame, first: int, last: int, available: int | None = None, chunk: list[str] | None = None) -> DataFrame:
    """(chunk..., node, t, coa) for first <= t < last, from onsets (station, phase, n, onset) and table (station, phase, node, tt_n).

    A cell is kept if all available onsets reach it; without ``available`` the distinct (station, phase) count.
    """
    keys = chunk or []
    logs = onsets.select(*keys, "station", "phase", "n", F.ln(F.greatest("onset", F.lit(FLOOR))).alias("lo"))
    if available is None:
        counts = onsets.groupBy(*keys).agg(F.count_distinct("station", "phase").alias("available"))
        # one row per chunk, or one row; of the chunks' table the engine finds the size while it runs
        logs = logs.join(counts, keys) if keys else logs.join(F.broadcast(counts))
    else:
        logs = logs.withColumn("available", F.lit(available))
    cells = with_small(logs, table.select("station", "phase", "node", "tt_n"), ["station", "phase"]).withColumn("t", F.col("n") - F.col("tt_n")).where(F.col("t").between(first, last - 1))
    sums = cells.groupBy(*keys, "node", "t").agg(F.sum("lo").alias("s"), F.count(F.lit(1)).alias("c"), F.max("available").alias("available"))
    return sums.where("c = available").select(*keys, "node", "t", F.exp(F.col("s") / F.col("available")).alias("coa"))


def find_max(cells: DataFrame, chunk: list[str] | None = None) -> DataFrame:
    """(chunk..., t, max_coa, max_coa_n, node): largest value, its normalised form, and its first node."""
    keys = [*(chunk or []), "t"]
    best = cells.groupBy(*keys).agg(F.max("coa").alias("max_coa"), F.sum("coa").alias("s"), F.count(F.lit(1)).alias("c"), F.min(F.struct((-F.col("coa")).alias("v"), "node")).alias("b"))
    return best.select(*keys, "max_coa", (F.col("max_coa") * F.col("c") / F.col("s")).alias("max_coa_n"), F.col("b.node").alias("node"))


def _list_values(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def _block_work(onsets: DataFrame, table: DataFrame, block: int, chunk: str) -> DataFrame:
    """(chunk, block, n, onset, node, shift, onsets): a row for each onset of a chunk and each block of nodes."""
    samples = F.transform(F.array_sort(F.collect_list(F.struct("n", "onset"))), lambda x: x["onset"])
    places = F.array_sort(F.collect_list(F.col("n").cast("long")))
    packed = onsets.where(F.col("onset").isNotNull()).groupBy(F.col(chunk).cast("long").alias("chunk"), "station", "phase").agg(places.alias("n"), samples.alias("onset"))
    numbered = table.withColumn("block", F.floor(F.col("node") / block).cast("int"))
    blocks = numbered.groupBy("block", "station", "phase").agg(F.array_sort(F.collect_list(F.struct("node", "tt_n"))).alias("g"))
    blocks = blocks.select("block", "station", "phase", F.transform("g", lambda x: x["node"].cast("long")).alias("node"), F.transform("g", lambda x: x["tt_n"].cast("long")).alias("shift"))
    used = packed.groupBy("chunk").agg(F.count(F.lit(1)).alias("onsets"))
    return packed.join(blocks, ["station", "phase"]).select("chunk", "block", "n", "onset", "node", "shift").join(used, "chunk")


class _Block:
    """The onsets of a chunk over a block of nodes, stacked span by span."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        self.chunk, self.count = rows["chunk"][0].as_py(), rows["onsets"][0].as_py()
        self.each = [[_list_values(rows[c].chunk(0).slice(i, 1)) for c in ("n", "onset", "node", "shift")] for i in range(rows.num_rows)]
        self.nodes = np.unique(np.concatenate([e[2] for e in self.each]))

    def stack(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(coalescence, whether all onsets reach the cell) of (node, low <= t < high); 0 where not."""
        total, seen = np.zeros((len(self.nodes), high - low)), np.zeros((len(self.nodes), high - low), np.int32)
        for n, onset, node, shift in self.each:
            start, stop = int(low + shift.min(initial=0)), int(high + shift.max(initial=0))
            logs, there = np.zeros(stop - start), np.zeros(stop - start, np.int32)
            inside = (n >= start) & (n < stop)
            logs[n[inside] - start], there[n[inside] - start] = np.log(np.maximum(onset[inside], FLOOR)), 1
            place = (shift + low - start)[:, None] + np.arange(high - low)
            row = np.searchsorted(self.nodes, node)
            total[row] += logs[place]
            seen[row] += there[place]
        whole = seen == self.count
        return np.where(whole, np.exp(total / self.count), 0.0), whole


def detect_blocks(onsets: DataFrame, table: DataFrame, first: int, last: int, block: int = 4096, chunk: str = "chunk", width: int = 1024, digits: int | None = None) -> DataFrame:
    """``find_max`` of ``stack`` with node blocks as arrays: (chunk, t, max_coa, max_coa_n, node).

    Onsets (chunk, station, phase, n, onset) are laid on their sample numbers; a cell counts if all onsets of the chunk
    reach it, so a missing sample or an offset start spoils only the cells that need it. Travel times (station, phase,
    node, tt_n) are packed once per block of nodes, onsets once per chunk and block. Chunks without onsets give no
    row (``plans.detect`` fills them). ``width`` samples are stacked at a time; ``digits`` rounds before maxima are sought.
    """

    def run(rows: pa.Table) -> pa.Table:
        own, out = _Block(rows), []
        for low in range(first, last, width):
            coa, whole = own.stack(low, min(low + width, last))
            if digits is not None:
                coa = np.round(coa, digits)
            t = np.flatnonzero(whole.any(0))
            best = np.where(whole, coa, -1.0)[:, t].argmax(0)
            out.append((t + low, coa[best, t], coa[:, t].sum(0), whole[:, t].sum(0), own.nodes[best]))
        t, m, s, c, node = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"chunk": np.full(len(t), own.chunk), "t": t, "m": m, "s": s, "c": c, "node": node})

    parts = _block_work(onsets, table, block, chunk).groupBy("chunk", "block").applyInArrow(run, "chunk long, t long, m double, s double, c long, node long")
    best = parts.groupBy("chunk", "t").agg(F.max("m").alias("max_coa"), F.sum("s").alias("s"), F.sum("c").alias("c"), F.min(F.struct((-F.col("m")).alias("v"), "node")).alias("b"))
    return best.select(F.col("chunk").alias(chunk), "t", "max_coa", (F.col("max_coa") * F.col("c") / F.col("s")).alias("max_coa_n"), F.col("b.node").alias("node"))


def marginal_blocks(onsets: DataFrame, table: DataFrame, spans: DataFrame, block: int = 4096, chunk: str = "chunk", width: int = 1024) -> DataFrame:
    """(chunk, node, s): the sum of each node's coalescence over first <= t < last, ``spans`` being (chunk, first, last)."""
    own = spans.select(F.col(chunk).cast("long").alias("chunk"), F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"))

    def run(rows: pa.Table) -> pa.Table:
        own = _Block(rows)
        first, last = rows["first"][0].as_py(), rows["last"][0].as_py()
        total = np.zeros(len(own.nodes))
        for low in range(first, last, width):
            total += own.stack(low, min(low + width, last))[0].sum(1)
        return pa.table({"chunk": np.full(len(total), own.chunk), "node": own.nodes, "s": total})

    work = _block_work(onsets, table, block, chunk).join(own, "chunk")
    return work.groupBy("chunk", "block").applyInArrow(run, "chunk long, node long, s double").withColumnRenamed("chunk", chunk)
