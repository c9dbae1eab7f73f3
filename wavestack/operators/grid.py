"""Grids as DataFrames, conversions between node, index and coordinates, and travel-time tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Grid
from ..errors import TravelTimeError
from ..functions import kernels


#: Most values of a speed grid that is broadcast (8 bytes each); a larger one is joined by shuffle.
BROADCAST_NODES = 8_000_000


def unravel(node: Column, grid: Grid) -> tuple[Column, Column, Column]:
    _, ny, nz = grid.counts
    return (F.floor(node / (ny * nz)).cast("int"), (F.floor(node / nz) % ny).cast("int"), (node % nz).cast("int"))


def nodes(spark: SparkSession, grid: Grid) -> DataFrame:
    """(node, i, j, k, x, y, z) of every node; generated where it is used, nothing is sent."""
    i, j, k = unravel(F.col("id"), grid)
    at = [F.lit(o) + c * F.lit(s) for o, c, s in zip(grid.origin, (i, j, k), grid.spacing, strict=True)]
    return spark.range(grid.nodes).select(F.col("id").alias("node"), i.alias("i"), j.alias("j"), k.alias("k"), at[0].alias("x"), at[1].alias("y"), at[2].alias("z"))


def nearest_node(x: Column, y: Column, z: Column, grid: Grid) -> Column:
    """Node next to a place, null outside the grid."""
    ijk = [F.rint((c - o) / s).cast("long") for c, o, s in zip((x, y, z), grid.origin, grid.spacing, strict=True)]
    inside = F.lit(True)
    for c, n in zip(ijk, grid.counts, strict=True):
        inside = inside & c.between(0, n - 1)
    return F.when(inside, (ijk[0] * grid.counts[1] + ijk[1]) * grid.counts[2] + ijk[2])


def decimate(table: DataFrame, grid: Grid, factor: tuple[int, int, int]) -> tuple[DataFrame, Grid]:
    """Rows of every ``factor``-th node, renumbered, and the grid they form."""
    small, first = grid.decimated(factor)
    ijk = unravel(F.col("node"), grid)
    keep = F.lit(True)
    for c, a, f in zip(ijk, first, factor, strict=True):
        keep = keep & (c >= a) & ((c - a) % f == 0)
    new = [F.floor((c - a) / f) for c, a, f in zip(ijk, first, factor, strict=True)]
    number = (new[0] * small.counts[1] + new[1]) * small.counts[2] + new[2]
    return table.where(keep).withColumn("node", number.cast("long")), small


def homogeneous(grid_nodes: DataFrame, stations: DataFrame, speeds: dict[str, float]) -> DataFrame:
    """(station, phase, node, tt): straight rays at one speed per phase.

    Stations are broadcast (their table is metadata, checked here), so every node row is made in place.
    """
    if not stations.limit(100_001).count() <= 100_000:
        raise TravelTimeError("more than 100 000 stations: split the table")
    phases = F.explode(F.array(*[F.struct(F.lit(p).alias("phase"), F.lit(v).alias("speed")) for p, v in speeds.items()]))
    sites = stations.select("station", F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"), phases.alias("p"))
    square = lambda a, b: F.pow(F.col(a) - F.col(b), 2)
    path = F.sqrt(square("x", "sx") + square("y", "sy") + square("z", "sz"))
    return grid_nodes.join(F.broadcast(sites)).select("station", F.col("p.phase").alias("phase"), "node", (path / F.col("p.speed")).alias("tt"))


def layer_speed(at: DataFrame, model: DataFrame, depth: str = "z") -> DataFrame:
    """Speed at each depth by linear interpolation between the model's depths, constant beyond its ends."""
    w = Window.partitionBy("phase").orderBy("depth")
    layers = model.select("phase", "depth", "speed", F.lead("depth").over(w).alias("below"), F.lead("speed").over(w).alias("speed_below"), F.row_number().over(w).alias("r"))
    low = F.when(F.col("r") == 1, F.lit(float("-inf"))).otherwise(F.col("depth"))
    high = F.coalesce("below", F.lit(float("inf")))
    if layers.limit(10_001).count() > 10_000:
        raise TravelTimeError("more than 10 000 layers: resample the model")
    joined = at.join(F.broadcast(layers), (F.col(depth) >= low) & (F.col(depth) < high))
    share = F.greatest(F.lit(0.0), F.try_divide(F.col(depth) - F.col("depth"), F.col("below") - F.col("depth")))
    value = F.when(F.col("below").isNull() | (F.col(depth) <= F.col("depth")), F.col("speed")).otherwise(F.col("speed") + share * (F.col("speed_below") - F.col("speed")))
    return joined.select(*at.columns, "phase", value.alias("speed"))


def bilinear(points: DataFrame, table: DataFrame, dx: float, dz: float) -> DataFrame:
    """Travel time at (distance, depth) from a table (ix, iz, tt): four corners by equi-join, weighted.

    Corners past the table's edge are missing and the rest are scaled to a weight of one.
    """
    fx, fz = F.col("distance") / dx, F.col("depth") / dz
    corner = F.explode(F.array(*[F.struct((F.floor(fx) + a).cast("long").alias("ix"), (F.floor(fz) + b).cast("long").alias("iz"), ((fx - F.floor(fx) if a else 1 - fx + F.floor(fx)) * (fz - F.floor(fz) if b else 1 - fz + F.floor(fz))).alias("w")) for a in (0, 1) for b in (0, 1)]))
    wide = points.withColumn("c", corner).select(*points.columns, "c.ix", "c.iz", "c.w").where("w > 0")
    return wide.join(table, ["ix", "iz"]).groupBy(*points.columns).agg((F.sum(F.col("w") * F.col("tt")) / F.sum("w")).alias("tt"))


def eikonal(speeds: DataFrame, stations: DataFrame, grid: Grid) -> DataFrame:
    """(station, phase, node, tt) by fast sweeping from each station's nearest node through (phase, node, speed).

    One task a station and phase; the speed grid goes along as one array per phase, broadcast only up to
    ``BROADCAST_NODES`` values. A station outside the grid is an error.
    """
    outside = [r["station"] for r in stations.where(nearest_node(F.col("x"), F.col("y"), F.col("z"), grid).isNull()).select("station").limit(10).collect()]
    if outside:
        raise TravelTimeError(f"stations outside the grid: {', '.join(map(str, outside))}")
    packed = speeds.groupBy("phase").agg(F.array_sort(F.collect_list(F.struct("node", "speed"))).alias("g")).select("phase", F.transform("g", lambda x: x["speed"]).alias("speed"))
    work = stations.select("station", nearest_node(F.col("x"), F.col("y"), F.col("z"), grid).alias("source"))
    phases = [r["phase"] for r in packed.select("phase").limit(100).collect()]
    work = work.withColumn("phase", F.explode(F.array(*[F.lit(p) for p in phases])) if phases else F.lit(None).cast("string"))
    work = work.join(F.broadcast(packed) if grid.nodes * len(phases) <= BROADCAST_NODES else packed, "phase").repartition("station", "phase")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                source = np.unravel_index(row["source"], grid.counts)
                tt = kernels.sweep_eikonal(np.array(row["speed"]).reshape(grid.counts), grid.spacing, tuple(map(int, source))).ravel()
                yield pa.RecordBatch.from_arrays([pa.array([row["station"]] * len(tt)), pa.array([row["phase"]] * len(tt)), pa.array(np.arange(len(tt))), pa.array(tt)], names=["station", "phase", "node", "tt"])

    return work.mapInArrow(run, "station string, phase string, node long, tt double")


def travel_samples(table: DataFrame, rate: int) -> DataFrame:
    """Travel times as whole samples, half to even, not below zero."""
    return table.withColumn("tt_n", F.greatest(F.rint(F.col("tt") * rate).cast("int"), F.lit(0)))


def union(first: DataFrame, second: DataFrame, first_grid: Grid, second_grid: Grid) -> DataFrame:
    """Both tables' rows; of a (station, phase) in both, the first table's. Grids must be equal."""
    if first_grid != second_grid:
        raise TravelTimeError("travel-time tables of different grids")
    more = second.join(first.select("station", "phase").distinct(), ["station", "phase"], "left_anti")
    return first.unionByName(more)


def extents(table: DataFrame) -> DataFrame:
    """Longest travel time per phase."""
    return table.groupBy("phase").agg(F.max("tt").alias("max_tt"))


def at_node(table: DataFrame, events: DataFrame) -> DataFrame:
    """Travel times of each event's node to every station and phase."""
    return events.join(table, "node")


def lambert(lon: Column, lat: Column, lon0: float, lat0: float, lat1: float, lat2: float, radius: float = 6371.0) -> tuple[Column, Column]:
    """Spherical Lambert conformal conic projection, native columns, in the unit of ``radius``."""
    import math

    r0, r1, r2 = (math.radians(v) for v in (lat0, lat1, lat2))
    tan = lambda p: math.tan(math.pi / 4 + p / 2)
    n = math.sin(r1) if abs(r1 - r2) < 1e-12 else math.log(math.cos(r1) / math.cos(r2)) / math.log(tan(r2) / tan(r1))
    f = math.cos(r1) * tan(r1) ** n / n
    rho = F.lit(radius * f) / F.pow(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2), F.lit(n))
    rho0 = radius * f / tan(r0) ** n
    theta = F.radians(lon - lon0) * n
    return rho * F.sin(theta), F.lit(rho0) - rho * F.cos(theta)


def lambert_inverse(x: Column, y: Column, lon0: float, lat0: float, lat1: float, lat2: float, radius: float = 6371.0) -> tuple[Column, Column]:
    """Longitude and latitude of projected places."""
    import math

    r0, r1, r2 = (math.radians(v) for v in (lat0, lat1, lat2))
    tan = lambda p: math.tan(math.pi / 4 + p / 2)
    n = math.sin(r1) if abs(r1 - r2) < 1e-12 else math.log(math.cos(r1) / math.cos(r2)) / math.log(tan(r2) / tan(r1))
    f = math.cos(r1) * tan(r1) ** n / n
    rho0 = radius * f / tan(r0) ** n
    rho = math.copysign(1, n) * F.sqrt(x * x + F.pow(F.lit(rho0) - y, 2))
    theta = F.atan2(x * math.copysign(1, n), (F.lit(rho0) - y) * math.copysign(1, n))
    return F.degrees(theta / n) + lon0, F.degrees(2 * F.atan(F.pow(F.lit(radius * f) / rho, F.lit(1 / n))) - math.pi / 2)


def trilinear(points: DataFrame, table: DataFrame, grid: Grid, value: str = "tt") -> DataFrame:
    """``value`` at (x, y, z) from its eight surrounding nodes: one equi-join of weighted corners.

    ``table`` has node and ``value`` (and further keys, which the result keeps). Places outside the grid are
    extrapolated from the outermost cell.
    """
    parts = []
    for c, o, s, n in zip(("x", "y", "z"), grid.origin, grid.spacing, grid.counts, strict=True):
        at = (F.col(c) - o) / s
        low = F.least(F.greatest(F.floor(at), F.lit(0)), F.lit(max(0, n - 2)))
        parts.append((low, at - low if n > 1 else F.lit(0.0), n))
    corners = []
    for bits in range(8):
        number, weight = F.lit(0).cast("long"), F.lit(1.0)
        for axis, (low, share, n) in enumerate(parts):
            up = bits >> axis & 1
            number = number * n + low + (up if n > 1 else 0)
            weight = weight * (share if up else 1 - share)
        corners.append(F.struct(number.alias("node"), weight.alias("w")))
    keys = [c for c in table.columns if c not in ("node", value)]
    wide = points.withColumn("c", F.explode(F.array(*corners))).select(*points.columns, "c.node", "c.w").where("w != 0")
    return wide.join(table, "node").groupBy(*points.columns, *keys).agg(F.sum(F.col("w") * F.col(value)).alias(value))


def max_extent(sites: DataFrame, grid: Grid, margin: float = 0.05) -> DataFrame:
    """One row (x_low, x_high, ...) that holds all stations and the cells of the grid, widened by ``margin`` on each side."""
    out = sites.agg(*[f(c).alias(f"{c}_{n}") for c in "xyz" for f, n in ((F.min, "low"), (F.max, "high"))])
    for c, o, s, n in zip("xyz", grid.origin, grid.spacing, grid.counts, strict=True):
        low, high = F.least(f"{c}_low", F.lit(o - s / 2)), F.greatest(f"{c}_high", F.lit(o + s * (n - 0.5)))
        out = out.withColumns({f"{c}_low": low - margin * (high - low), f"{c}_high": high + margin * (high - low)})
    return out


def travel_times(spark: SparkSession, grid: Grid, stations: DataFrame, method: str, phases: tuple[str, ...] = ("P", "S"), speeds: dict[str, float] | None = None, model: DataFrame | None = None) -> DataFrame:
    """(station, phase, node, tt) by a named method.

    ``homogeneous`` needs ``speeds`` (a speed for each phase); ``1dfmm`` a layered ``model`` (phase, depth, speed), whose
    speeds are interpolated at the nodes' depths; ``1dsweep`` the same, worked out on a table of distance and depth for
    each station depth and read off it. Other methods, and phases that the speeds lack, are errors.
    """
    grid_nodes = nodes(spark, grid)
    if method == "homogeneous":
        if not speeds or not set(phases) <= set(speeds):
            raise TravelTimeError(f"no speed for {sorted(set(phases) - set(speeds or {}))}")
        return homogeneous(grid_nodes, stations, {p: speeds[p] for p in phases})
    if method not in ("1dfmm", "1dsweep"):
        raise TravelTimeError(f"unknown travel-time method {method}")
    have = {r["phase"] for r in model.select("phase").distinct().limit(100).collect()} if model is not None else set()
    if not set(phases) <= have:
        raise TravelTimeError(f"no velocity model for {sorted(set(phases) - have)}")
    layered = model.where(F.col("phase").isin(list(phases)))
    if method == "1dfmm":
        return eikonal(layer_speed(grid_nodes, layered).select("phase", "node", "speed"), stations, grid)
    return sweep_layers(spark, grid, stations, layered)


def sweep_layers(spark: SparkSession, grid: Grid, stations: DataFrame, model: DataFrame) -> DataFrame:
    """(station, phase, node, tt) from one table of travel times by distance and depth per station, for layered models.

    The table is an eikonal solution on a vertical plane with the station at distance 0 (its rows start at the grid's
    spacing and reach its far corner), and every node is read off it by bilinear interpolation.
    """
    step, dz = min(grid.spacing[0], grid.spacing[1]) / 2, grid.spacing[2] / 2
    far = grid.far_corner
    reach = stations.agg(F.min("z").alias("z"), *[F.greatest(F.max(F.abs(F.col(c) - o)), F.max(F.abs(F.col(c) - f))).alias(c) for c, o, f in zip("xy", grid.origin, far)]).first()
    if reach["z"] is None:
        raise TravelTimeError("no stations")
    top = min(reach["z"], grid.origin[2])
    plane = Grid((0.0, 0.0, top), (step, 1.0, dz), (int(np.hypot(reach["x"], reach["y"]) / step) + 2, 1, int((far[2] - top) / dz) + 2))
    speeds = layer_speed(nodes(spark, plane), model).select("phase", "node", "speed")
    sources = stations.select("station", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), "z")
    tables = eikonal(speeds, sources, plane)
    i, _, k = unravel(F.col("node"), plane)
    tables = tables.select("station", "phase", i.cast("long").alias("ix"), k.cast("long").alias("iz"), "tt")
    away = F.hypot(F.col("x") - F.col("sx"), F.col("y") - F.col("sy"))
    few = stations.select("station", F.col("x").alias("sx"), F.col("y").alias("sy"))
    points = nodes(spark, grid).join(F.broadcast(few) if few.limit(100_001).count() <= 100_000 else few).select("station", "node", away.alias("distance"), (F.col("z") - top).alias("depth"))
    fx, fz = F.col("distance") / step, F.col("depth") / dz
    corner = F.explode(F.array(*[F.struct((F.floor(fx) + a).cast("long").alias("ix"), (F.floor(fz) + b).cast("long").alias("iz"), ((fx - F.floor(fx) if a else 1 - fx + F.floor(fx)) * (fz - F.floor(fz) if b else 1 - fz + F.floor(fz))).alias("w")) for a in (0, 1) for b in (0, 1)]))
    wide = points.withColumn("c", corner).select("station", "node", "c.ix", "c.iz", "c.w").where("w > 0")
    return wide.join(tables, ["station", "ix", "iz"]).groupBy("station", "phase", "node").agg((F.sum(F.col("w") * F.col("tt")) / F.sum("w")).alias("tt"))
