"""Location: marginalised maps, windows around the event, and three estimators."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Grid
from ..functions import kernels


def origin_time(series: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., otime_n, coa, coa_n): the first sample of largest coalescence."""
    return series.groupBy(*keys).agg(F.max_by(F.struct(F.col("n").alias("otime_n"), "coa", "coa_n"), F.struct("coa", (-F.col("n")).alias("first"))).alias("e")).select(*keys, "e.*")


def in_marginal_window(events: DataFrame, half: int) -> DataFrame:
    """Events whose origin lies strictly within ``half`` samples of the trigger."""
    return events.where((F.col("otime_n") - half < F.col("trigger_n")) & (F.col("trigger_n") < F.col("otime_n") + half))


def trim_map(cells: DataFrame, events: DataFrame, keys: list[str], half: int) -> DataFrame:
    """Cells of the marginal window; the map has one sample fewer than the series, its last being left out."""
    return cells.join(events.select(*keys, "otime_n"), keys).where((F.col("t") >= F.col("otime_n") - half) & (F.col("t") < F.col("otime_n") + half)).drop("otime_n")


def trim_series(series: DataFrame, events: DataFrame, keys: list[str], half: int) -> DataFrame:
    return series.join(events.select(*keys, "otime_n"), keys).where(F.abs(F.col("n") - F.col("otime_n")) <= half).drop("otime_n")


def marginal(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., node, c): the sum over time, divided by the largest such sum of the event."""
    sums = cells.groupBy(*keys, "node").agg(F.sum("coa").alias("s"))
    if keys:
        return sums.select(*keys, "node", (F.col("s") / F.max("s").over(Window.partitionBy(*keys))).alias("c"))
    top = sums.agg(F.max("s").alias("top"))
    return sums.join(F.broadcast(top)).select("node", (F.col("s") / F.col("top")).alias("c"))


def top_node(cells: DataFrame, keys: list[str], value: str = "c") -> DataFrame:
    """The first node of the largest value."""
    return cells.groupBy(*keys).agg(F.min(F.struct((-F.col(value)).alias("v"), "node")).alias("b")).select(*keys, F.col("b.node").alias("node"), (-F.col("b.v")).alias(value))


def near_node(cells: DataFrame, grid: Grid, centre: tuple[int, int, int], window: int) -> DataFrame:
    """Nodes within half a window of an index, clipped at the grid's edges."""
    from .grid import unravel

    half = (window - 1) // 2
    keep = F.lit(True)
    for c, a in zip(unravel(F.col("node"), grid), centre, strict=True):
        keep = keep & (F.abs(c - a) <= half)
    return cells.where(keep)


def covariance(cells: DataFrame, keys: list[str], threshold: float = 0.90) -> DataFrame:
    """Weighted mean and errors over nodes (x, y, z, c) with c above ``threshold`` of the normalised map.

    Two passes of mergeable sums: means, then second moments about them; no event is gathered in one task.
    """
    rows = cells.where(F.col("c") > threshold)
    means = rows.groupBy(*keys).agg(*[(F.sum(F.col("c") * F.col(a)) / F.sum("c")).alias(f"m{a}") for a in "xyz"])
    rows = rows.join(means, keys) if keys else rows.join(F.broadcast(means))  # without keys there is one row of means
    centred = lambda a, b: F.sum(F.col("c") * (F.col(a) - F.col(f"m{a}")) * (F.col(b) - F.col(f"m{b}"))) / F.sum("c")
    out = rows.groupBy(*keys).agg(*[F.max(f"m{a}").alias(f"cov_{a}") for a in "xyz"], *[F.sqrt(centred(a, a)).alias(f"err_{a}") for a in "xyz"], centred("x", "y").alias("cov_xy"), centred("x", "z").alias("cov_xz"), centred("y", "z").alias("cov_yz"))
    return out.withColumn("err_xyz", F.pow(F.col("err_x") * F.col("err_y") * F.col("err_z"), F.lit(1 / 3)))


def estimate(cells: DataFrame, key: str, grid: Grid) -> DataFrame:
    """(key, spline_*, gau_*, gau_err_*): spline and Gaussian locations of each event's normalised map.

    One event a group: its map is one value per node. Missing nodes count as 0.
    """

    def run(table: pa.Table) -> pa.Table:
        values = np.zeros(grid.nodes)
        values[table["node"].to_numpy()] = table["c"].to_numpy()
        values = values.reshape(grid.counts)
        at = lambda ijk: [o + s * v for o, s, v in zip(grid.origin, grid.spacing, ijk, strict=True)]
        spline = at(kernels.spline_location(values))
        fitted = kernels.gaussian_location(kernels.smooth_3d(values))
        centre = at(fitted[0]) if fitted else [None] * 3
        errors = [float(w * s) for w, s in zip(fitted[1], grid.spacing, strict=True)] if fitted else [None] * 3
        row = {key: table[key][0].as_py()}
        row |= dict(zip(("spline_x", "spline_y", "spline_z"), map(float, spline), strict=True))
        row |= dict(zip(("gau_x", "gau_y", "gau_z"), [None if v is None else float(v) for v in centre], strict=True))
        row |= dict(zip(("gau_err_x", "gau_err_y", "gau_err_z"), errors, strict=True))
        return pa.Table.from_pylist([row], schema=pa.schema([(key, table.schema.field(key).type), *[(c, pa.float64()) for c in list(row)[1:]]]))

    kind = cells.schema[key].dataType.simpleString()
    columns = ["spline_x", "spline_y", "spline_z", "gau_x", "gau_y", "gau_z", "gau_err_x", "gau_err_y", "gau_err_z"]
    return cells.groupBy(key).applyInArrow(run, ", ".join([f"{key} {kind}", *[f"{c} double" for c in columns]]))


def slices(cells: DataFrame, grid: Grid, node: int) -> DataFrame:
    """The three orthogonal slices of a map through a node: (plane, a, b, c)."""
    from .grid import unravel

    i, j, k = unravel(F.col("node"), grid)
    _, ny, nz = grid.counts
    at = (node // (ny * nz), node // nz % ny, node % nz)
    planes = [("xy", i, j, k == at[2]), ("xz", i, k, j == at[1]), ("yz", j, k, i == at[0])]
    out = None
    for name, a, b, on in planes:
        part = cells.where(on).select(F.lit(name).alias("plane"), a.alias("a"), b.alias("b"), "c")
        out = part if out is None else out.unionByName(part)
    return out


