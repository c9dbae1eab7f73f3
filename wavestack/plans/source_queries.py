"""Sources, sinks and array kernels as queries: what is written is read back, and kernels meet their sums in SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Amplitude, Grid
from ..functions import kernels
from ..operators import grid as grids
from ..operators import locate, magnitude, quality, signal
from ..session import scratch
from ..sources import export, readers, synthetic, writers
from . import views
from . import trigger as trigger_plan
from .queries import CANDIDATES, KEYS, ORACLES, REFINED, TRIG, query

DAY = 86_400_000_000
#: Half a minute before a midnight, so that a trace lies in the folders of two days.
BASE = 1704499170000000


# ---------------------------------------------------------------- waveform archives


def _archive(spark: SparkSession, sf: str) -> str:
    """A Parquet archive by day: one sample a second, each channel off by its own part of a sample, ten samples twice."""
    rows = views.traces(spark, sf).select(F.concat(F.lit("S"), F.col("station").cast("string")).alias("station"), F.concat(F.lit("H"), F.col("channel").cast("string")).alias("channel"), "value", (F.lit(BASE) + F.col("n") * 1_000_000 + (F.col("channel") % 400) * 1000).alias("t_us"), "n")
    rows = rows.unionByName(rows.where("n < 10")).drop("n")
    time = F.timestamp_micros("t_us")
    path = scratch(spark, "archive")
    rows.withColumns({"year": F.year(time), "jday": F.dayofyear(time)}).write.partitionBy("year", "jday").parquet(path)
    return path


@query("archive_waveforms", f"SELECT 'S' || label AS station, 'H' || vec_id AS channel, {BASE} // 1000000 + n AS n, value FROM (SELECT label, vec_id, unnest(range(len(embedding))) AS n, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings) WHERE n BETWEEN 8 AND 40 AND label IN (1, 3)", (), ("value",))
def _(spark, sf):
    wanted = spark.createDataFrame([("S1",), ("S3",)], "station string")
    return readers.read_waveforms(spark, _archive(spark, sf), BASE + 8_000_000, BASE + 40_000_000, 1.0, 5.0, 5.0, wanted)


@query("archive_raw", f"SELECT station, channel, t_us, count(*) AS n FROM (SELECT 'S' || label AS station, 'H' || vec_id AS channel, {BASE} + n * 1000000 + (vec_id % 400) * 1000 AS t_us, n FROM (SELECT label, vec_id, unnest(range(len(embedding))) AS n FROM embeddings)), (VALUES (0), (1)) AS k(k) WHERE (k = 0 OR n < 10) AND t_us BETWEEN {BASE + 3_000_000} AND {BASE + 45_000_000} GROUP BY ALL")
def _(spark, sf):
    rows = readers.read_traces(spark, _archive(spark, sf), BASE + 8_000_000, BASE + 40_000_000, 5.0, 5.0)
    return rows.groupBy("station", "channel", "t_us").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- tables


@query("stations_csv", "SELECT s_name AS station, s_nationkey / 2.0 + 50 AS latitude, s_suppkey / 10.0 AS longitude, CAST(-(s_suppkey % 7 - 3.5) AS DOUBLE) AS depth, CAST(s_suppkey AS VARCHAR) AS code FROM supplier", (), ("latitude", "longitude", "depth"))
def _(spark, sf):
    path = scratch(spark, "stations")
    rows = views.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("Code"), F.col("s_name").alias("Name"), (F.col("s_suppkey") % 7 - 3.5).alias("Elevation"), (F.col("s_suppkey") / 10).alias("Longitude"), (F.col("s_nationkey") / 2 + 50).alias("Latitude"))
    rows.write.option("header", True).csv(path)
    return readers.read_stations(spark, path)


@query("velocity_csv", "SELECT p.phase, CAST(n_nationkey AS DOUBLE) AS depth, CAST(p.f * (3 + n_nationkey * 0.25) AS DOUBLE) AS speed FROM nation, (VALUES ('P', 1.0), ('S', 0.5)) AS p(phase, f)", (), ("depth", "speed"))
def _(spark, sf):
    path = scratch(spark, "velocities")
    speed = 3 + F.col("n_nationkey") * 0.25
    lines = views.table(spark, sf, "nation").select(F.concat_ws(",", "n_nationkey", speed, speed / 2).alias("value")).coalesce(1)
    head = spark.createDataFrame([("# a model",), ("Depth,Vp,Vs",)], "value string").coalesce(1)
    head.union(lines).coalesce(1).write.text(path)
    return readers.read_velocity(spark, path)


@query("scan_archive", f"SELECT batch, n, t_us, round_even(least(coa, 21474) * 1e5, 0) / 1e5 AS coa, round_even(least(coa_n, 21474) * 1e5, 0) / 1e5 AS coa_n, round_even(least(x % 1000, 21474) * 1e6, 0) / 1e6 AS x FROM scan WHERE t_us BETWEEN {19728 * DAY - 600_000_000} AND {19729 * DAY + 600_000_000}", (views.SCAN,), ("coa", "coa_n", "x"))
def _(spark, sf):
    path = scratch(spark, "scan")
    rows = views.scan(spark, sf).select("batch", "n", "t_us", "coa", "coa_n", (F.col("x") % 1000).alias("x"))
    writers.write_scan(rows, path)
    writers.write_scan(rows.where(F.col("batch") == F.lit("2024-01-06").cast("date")), path)  # a day written again replaces itself
    return readers.read_scan(spark, path, 19728 * DAY, 19729 * DAY, 600.0).select("batch", "n", "t_us", "coa", "coa_n", "x")


@query("triggered_csv", f"SELECT event_id AS EventID, coa_us, printf('%.4g', trig_coa) AS TRIG_COA, round(coa_x, 6) AS COA_X, round(coa_y, 6) AS COA_Y, round(coa_z, 3) AS COA_Z, printf('%.4g', coa) AS COA, printf('%.4g', coa_norm) AS COA_NORM FROM ev WHERE coa_us >= {19728 * DAY} AND coa_us < {19733 * DAY}", (views.SCAN, CANDIDATES, REFINED), ("COA_X", "COA_Y", "COA_Z"))
def _(spark, sf):
    path = scratch(spark, "triggered")
    events = trigger_plan.trigger(views.scan(spark, sf), TRIG, 1.0)
    writers.write_csv(writers.triggered_rows(events), path)
    return readers.read_triggered(spark, path, 19728 * DAY, 19733 * DAY)


@query("availability_csv", """SELECT DISTINCT CAST(o_orderdate AS DATE)::TIMESTAMP AS step, 'X' || substr(o_orderpriority, 1, 1) || p AS name FROM orders, (VALUES ('_P'), ('_S')) AS v(p)""")
def _(spark, sf):
    path = scratch(spark, "availability")
    names = [f"X{i}" for i in range(1, 6)]
    wide = quality.availability_table(views.availability(spark, sf).withColumn("name", F.concat(F.lit("X"), F.col("name"))), "step", "name", names)
    writers.write_csv(wide, path)
    return readers.read_availability(spark, path).where("available = 1").select("step", "name")


GRID3 = Grid((1.0, 2.0, -1.0), (0.25, 0.5, 2.0), (5, 4, 3))


@query("lut_store", "SELECT 'S' || s AS station, 'P' AS phase, r AS node, sqrt((1 + r // 12 * 0.25) ** 2 + (2 + (r // 3) % 4 * 0.5) ** 2 + (r % 3 * 2 - 1 - s) ** 2) / 1.7 AS tt, 0.25::DOUBLE AS dx, 3 AS nz FROM (SELECT unnest(range(60)) AS r), (SELECT DISTINCT r_regionkey AS s FROM region)", (), ("tt", "dx"))
def _(spark, sf):
    path = scratch(spark, "lut")
    sites = views.table(spark, sf, "region").select(F.concat(F.lit("S"), F.col("r_regionkey").cast("string")).alias("station"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("r_regionkey").cast("double").alias("z"))
    writers.write_lut(grids.homogeneous(grids.nodes(spark, GRID3), sites, {"P": 1.7}), GRID3, path)
    table, grid = readers.read_lut(spark, path)
    return table.select("station", "phase", "node", "tt", F.lit(grid.spacing[0]).alias("dx"), F.lit(grid.counts[2]).alias("nz"))


@query("map_store", "SELECT c_custkey % 3 AS event, c_custkey % 60 AS node, sum(c_acctbal) AS c FROM customer WHERE c_custkey % 3 <> 2 GROUP BY ALL", (), ("c",))
def _(spark, sf):
    path = scratch(spark, "maps")
    rows = views.table(spark, sf, "customer").groupBy((F.col("c_custkey") % 3).alias("event"), (F.col("c_custkey") % 60).alias("node")).agg(F.sum("c_acctbal").cast("double").alias("c"))
    writers.write_maps(rows, path, "event")
    return readers.read_maps(spark, path, [0, 1], "event").select("event", "node", "c")


EVENTS = """fe AS (SELECT event_id, coa_us, coa, coa_norm, trig_coa, coa_x AS x, coa_y AS y, coa_z AS z, coa_z / 7 AS e FROM ev)"""


@query("event_file_rows", """SELECT event_id AS EventID, make_timestamp(coa_us) AS DT, round(x, 6) AS X, round(y, 6) AS Y, round(z, 3) AS Z, printf('%.4g', coa) AS COA, printf('%.4g', coa_norm) AS COA_NORM, round(x + 1, 6) AS GAU_X, round(y + 1, 6) AS GAU_Y, round(z + 1, 3) AS GAU_Z,
  round(e, 3) AS GAU_ErrX, round(e, 3) AS GAU_ErrY, round(e, 3) AS GAU_ErrZ, round(e, 3) AS COV_ErrX, round(e, 3) AS COV_ErrY, round(e, 3) AS COV_ErrZ, round(e, 3) AS COV_Err_XYZ, printf('%.4g', trig_coa) AS TRIG_COA, printf('%.4g', coa) AS DEC_COA, printf('%.4g', coa_norm) AS DEC_COA_NORM,
  printf('%.3g', e) AS ML, printf('%.3g', e / 3) AS ML_Err, printf('%.3g', e / 7) AS ML_r2 FROM fe""", (views.SCAN, CANDIDATES, REFINED, EVENTS), ("X", "Y", "Z", "GAU_X", "GAU_Y", "GAU_Z", "GAU_ErrX", "GAU_ErrY", "GAU_ErrZ", "COV_ErrX", "COV_ErrY", "COV_ErrZ", "COV_Err_XYZ"))
def _(spark, sf):
    events = trigger_plan.trigger(views.scan(spark, sf), TRIG, 1.0)
    e = F.col("coa_z") / 7
    full = events.select("event_id", F.col("coa_us").alias("otime_us"), "coa", "coa_norm", "trig_coa", F.col("coa").alias("dec_coa"), F.col("coa_norm").alias("dec_coa_norm"), *[F.col(f"coa_{c}").alias(f"spline_{c}") for c in "xyz"], *[(F.col(f"coa_{c}") + 1).alias(f"gau_{c}") for c in "xyz"], *[e.alias(f"gau_err_{c}") for c in "xyz"], *[e.alias(f"err_{c}") for c in ("x", "y", "z", "xyz")], e.alias("ml"), (e / 3).alias("ml_err"), (e / 7).alias("ml_r2"))
    return writers.event_rows(full, Grid((0.0, 0.0, 0.0), (0.5, 0.5, 0.5), (2, 2, 2)))


@query("pick_file_rows", "SELECT DISTINCT 'S' || (l_suppkey % 20) AS station, printf('%.3g', l_extendedprice * l_tax / 7000) AS pick_error, printf('%.3g', l_extendedprice / 7) AS snr FROM lineitem")
def _(spark, sf):
    rows = views.table(spark, sf, "lineitem").select(F.concat(F.lit("S"), (F.col("l_suppkey") % 20).cast("string")).alias("station"), (F.col("l_extendedprice") * F.col("l_tax") / 7000).cast("double").alias("pick_error"), (F.col("l_extendedprice") / 7).cast("double").alias("snr"))
    return writers.pick_rows(rows).distinct()


@query("amplitude_file_rows", "SELECT event_id, id, printf('%.5g', epi_dist / 7) AS epi_dist, printf('%.5g', amp) AS s_amp, printf('%.2g', epi_dist / 3) AS s_freq, printf('%.3g', filter_gain / 3) AS s_filter_gain, printf('%.5g', noise_amp) AS noise_amp, printf('%.3g', amp / 11) AS ml FROM obs", (views.OBSERVATIONS,))
def _(spark, sf):
    rows = views.observations(spark, sf).select("event_id", "id", (F.col("epi_dist") / 7).alias("epi_dist"), F.col("amp").cast("double").alias("s_amp"), (F.col("epi_dist") / 3).alias("s_freq"), (F.col("filter_gain") / 3).cast("double").alias("s_filter_gain"), F.col("noise_amp").cast("double"), (F.col("amp") / 11).cast("double").alias("ml"))
    return writers.amplitude_rows(rows)


@query("catalogue_units", "SELECT event_id, coa_z * 1000 AS coa_z FROM ev", (views.SCAN, CANDIDATES, REFINED), ("coa_z",))
def _(spark, sf):
    return export.in_metres(trigger_plan.trigger(views.scan(spark, sf), TRIG, 1.0), ["coa_z"], "km").select("event_id", "coa_z")


@query("top_amplitudes", "SELECT event_id, station, id, amp FROM (SELECT event_id, split_part(id, '.', 2) AS station, id, amp, row_number() OVER (PARTITION BY event_id, split_part(id, '.', 2) ORDER BY amp DESC, id) AS r FROM obs) WHERE r = 1", (views.OBSERVATIONS,), ("amp",))
def _(spark, sf):
    return magnitude.highest(views.observations(spark, sf)).withColumn("amp", F.col("amp").cast("double"))


# ---------------------------------------------------------------- array kernels against their sums

HILBERT = """hil AS (SELECT a.station, a.channel, a.n, sum(b.value * 2.0 / 64 / tan(pi() * (a.n - b.n) / 64)) AS h FROM traces a JOIN traces b ON a.station = b.station AND a.channel = b.channel AND (a.n - b.n) % 2 <> 0 GROUP BY a.station, a.channel, a.n),
env AS (SELECT station, channel, n, sqrt(value ** 2 + h ** 2) AS value FROM traces JOIN hil USING (station, channel, n))"""
CONDITIONED = """con AS (SELECT station, channel, n, (value - y - s * (n - x)) * CASE WHEN least(n, 63 - n) < 3 THEN 0.5 * (1 - cos(pi() * least(n, 63 - n) / 2)) ELSE 1 END AS value
  FROM (SELECT *, regr_slope(value, n) OVER w AS s, avg(n) OVER w AS x, avg(value) OVER w AS y FROM traces WINDOW w AS (PARTITION BY station, channel)))"""


def _cascade(sections, source: str, name: str) -> list[str]:
    """Recursive CTEs of second-order sections, a sample at a time, over (station, channel, n, value)."""
    out = []
    for i, (b0, b1, b2, a0, a1, a2) in enumerate(sections.tolist()):
        b0, b1, b2, a1, a2 = (f"({v / a0!r}::DOUBLE)" for v in (b0, b1, b2, a1, a2))
        target = f"{name}{i}"
        out.append(f"""{target} AS (SELECT station, channel, n, {b0} * value AS value, {b1} * value - {a1} * ({b0} * value) AS z1, {b2} * value - {a2} * ({b0} * value) AS z2 FROM {source} WHERE n = 0
  UNION ALL SELECT x.station, x.channel, x.n, {b0} * x.value + p.z1, {b1} * x.value - {a1} * ({b0} * x.value + p.z1) + p.z2, {b2} * x.value - {a2} * ({b0} * x.value + p.z1) FROM {target} p JOIN {source} x ON x.station = p.station AND x.channel = p.channel AND x.n = p.n + 1)""")
        source = target
    return out


def _both_ways(sections, source: str, size: int = 64) -> tuple[list[str], str]:
    """The same forward and backward; the last CTE has the result."""
    there = _cascade(sections, source, "fw")
    turned = f"rv AS (SELECT station, channel, {size - 1} - n AS n, value FROM fw{len(sections) - 1})"
    back = _cascade(sections, "rv", "bw")
    return [*there, turned, *back, f"zp AS (SELECT station, channel, {size - 1} - n AS n, value FROM bw{len(sections) - 1})"], "zp"


def _recursive(name: str, select: str, ctes: list[str]):
    made = query(name, select, tuple(ctes), ("value",))

    def add(function):
        made(function)
        ORACLES[name] = ORACLES[name].replace("WITH ", "WITH RECURSIVE ", 1)
        return function

    return add


def _exploded(df: DataFrame) -> DataFrame:
    return df.select(*KEYS, F.posexplode("samples").alias("n", "value"))


@query("envelope_onset", "SELECT station, channel, n, value FROM env", (views.TRACES, HILBERT), ("value",))
def _(spark, sf):
    return _exploded(signal.envelope(views.trace_arrays(spark, sf)))


@query("lanczos_shift", """SELECT a.station, a.channel, a.n, sum(b.value * CASE WHEN abs(0.25 - k) < 20 THEN sin(pi() * (0.25 - k)) / (pi() * (0.25 - k)) * sin(pi() * (0.25 - k) / 20) / (pi() * (0.25 - k) / 20) ELSE 0 END) AS value
FROM traces a, (SELECT unnest(range(-19, 21)) AS k) JOIN traces b ON a.station = b.station AND a.channel = b.channel AND b.n = greatest(0, least(63, a.n + k)) GROUP BY a.station, a.channel, a.n""", (views.TRACES,), ("value",))
def _(spark, sf):
    return _exploded(signal.shift_lanczos(views.trace_arrays(spark, sf).withColumn("shift", F.lit(0.25)), "shift"))


_BAND, _LAST = _both_ways(kernels.butterworth(2, 2.0, 16.0, 50.0), "con")


@_recursive("bandpass", f"SELECT station, channel, n, value FROM {_LAST}", [views.TRACES, CONDITIONED, *_BAND])
def _(spark, sf):
    return _exploded(signal.bandpass(views.trace_arrays(spark, sf), 50.0, (2.0, 16.0, 2)))


_LOW, _LAST = _both_ways(kernels.butterworth(2, None, 25.0 / 2.000001, 50.0), "con")


@_recursive("decimated_traces", f"SELECT station, channel, n // 2 AS n, value FROM {_LAST} WHERE n % 2 = 0", [views.TRACES, CONDITIONED, *_LOW])
def _(spark, sf):
    return _exploded(signal.resample(views.trace_arrays(spark, sf), 50.0, 25.0))


_HIGH = _cascade(kernels.butterworth(2, 2.0, None, 25.0), "con", "hp")


@_recursive("amplitude_filter", "SELECT station, channel, n, value FROM hp0", [views.TRACES, CONDITIONED, *_HIGH])
def _(spark, sf):
    # the upper corner is not below Nyquist, so the band-pass falls back to a high-pass
    return _exploded(magnitude.filter_traces(views.trace_arrays(spark, sf), 25.0, Amplitude(bandpass=(2.0, 16.0, 2))))


def _noise_sql(measure: str) -> str:
    return {"RMS": "sqrt(avg(d * d))", "STD": "stddev_pop(d)"}[measure]


@query("noise_measures", f"""SELECT station, channel, {_noise_sql('RMS')} * 1000 AS rms, {_noise_sql('STD')} * 1000 AS std, avg(sqrt(d ** 2 + h ** 2)) * 1000 AS env FROM det JOIN (
  SELECT a.station, a.channel, a.n, sum(b.d * 2.0 / 64 / tan(pi() * (a.n - b.n) / 64)) AS h FROM det a JOIN det b ON a.station = b.station AND a.channel = b.channel AND (a.n - b.n) % 2 <> 0 GROUP BY a.station, a.channel, a.n) USING (station, channel, n) GROUP BY station, channel""",
    (views.TRACES, "det AS (SELECT station, channel, n, value - avg(value) OVER w - regr_slope(value, n) OVER w * (n - avg(n) OVER w) AS d FROM traces WINDOW w AS (PARTITION BY station, channel))"), ("rms", "std", "env"))
def _(spark, sf):
    rows, out = views.traces(spark, sf), None
    for measure in ("RMS", "STD", "ENV"):
        one = magnitude.noise_amplitude(rows, KEYS, measure).withColumnRenamed("noise_amp", measure.lower())
        out = one if out is None else out.join(one, KEYS)
    return out


@query("synthetic_clean", """SELECT station, phase, n, 10 ** (1 - (1.11 * log10(d / 100.0) + 0.00189 * (d - 100.0) + 3.0)) * (-t * exp(-(t * t) / (2 * g ** 2)) / g * exp(0.5)) AS value
FROM (SELECT station, phase, n, n / 50.0 - tt AS t, greatest(tt * 1.7, 1e-3) AS d, 1 / (2 * pi() * 5.0) AS g FROM (SELECT station, phase, tt FROM lut WHERE node = 35), (SELECT unnest(range(400)) AS n))""", (views.GRID_SQL,), ("value",))
def _(spark, sf):
    table = views.travel_times(spark, sf).where("node = 35").select("station", "phase", "tt")
    return synthetic.traces(table, 50, 400, 1.0, 5.0, noise=0.0)


@query("rotated_components", "SELECT c_custkey, l * cos(i) + q * sin(i) AS z, -l * sin(i) * cos(b) + q * cos(i) * cos(b) + t * sin(b) AS n, -l * sin(i) * sin(b) + q * cos(i) * sin(b) - t * cos(b) AS e FROM (SELECT c_custkey, c_acctbal AS l, c_acctbal / 2 AS q, c_acctbal / 3 AS t, radians(c_custkey % 90) AS i, radians(c_custkey % 360) AS b FROM customer)", (), ("z", "n", "e"))
def _(spark, sf):
    rows = views.table(spark, sf, "customer")
    l, q, t = (F.col("c_acctbal").cast("double") / k for k in (1, 2, 3))  # noqa: E741
    z, n, e = synthetic.to_zne(l, q, t, F.radians((F.col("c_custkey") % 90).cast("double")), F.radians((F.col("c_custkey") % 360).cast("double")))
    return rows.select("c_custkey", z.alias("z"), n.alias("n"), e.alias("e"))


def _vincenty_sql(rounds: int = 8) -> str:
    """Vincenty's inverse formula, a fixed number of rounds, one nested query each."""
    f = 1 / 298.257223563
    out = "SELECT *, radians(-18 - lo) AS span, atan((1 - {f}) * tan(radians(la))) AS u1, atan((1 - {f}) * tan(radians(64))) AS u2 FROM (SELECT c_custkey, CAST(c_custkey % 30 AS DOUBLE) / 10 + 62 AS la, CAST(c_custkey % 40 AS DOUBLE) / 10 - 20 AS lo FROM customer)"
    out = f"SELECT *, span AS lam FROM ({out.replace('{f}', repr(f))})"
    step = """SELECT *, sqrt((cos(u2) * sin(lam)) ** 2 + (cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam)) ** 2) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM ({q})"""
    more = """SELECT *, atan2(ss, cs) AS sg, CASE WHEN ss > 0 THEN cos(u1) * cos(u2) * sin(lam) / ss ELSE 0 END AS sa FROM ({q})"""
    c2 = """SELECT *, 1 - sa ** 2 AS ca, cs - 2 * sin(u1) * sin(u2) / (1 - sa ** 2) AS cm FROM ({q})"""
    for i in range(rounds):
        out = c2.replace("{q}", more.replace("{q}", step.replace("{q}", out)))
        if i < rounds - 1:
            c = f"({f!r} / 16 * ca * (4 + {f!r} * (4 - 3 * ca)))"
            out = f"SELECT c_custkey, span, u1, u2, span + (1 - {c}) * {f!r} * sa * (sg + {c} * ss * (cm + {c} * cs * (-1 + 2 * cm ** 2))) AS lam FROM ({out})"
    return out


def _distance_sql() -> str:
    a, f = 6378.137, 1 / 298.257223563
    b = a * (1 - f)
    out = f"SELECT *, ca * {(a * a - b * b) / (b * b)!r} AS uu FROM ({_vincenty_sql()})"
    out = f"SELECT *, 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu))) AS ba, uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu))) AS bb FROM ({out})"
    d = "bb * ss * (cm + bb / 4 * (cs * (-1 + 2 * cm ** 2) - bb / 6 * cm * (-3 + 4 * ss ** 2) * (-3 + 4 * cm ** 2)))"
    return f"SELECT c_custkey, CASE WHEN ss = 0 THEN 0 ELSE {b!r} * ba * (sg - {d}) END AS km FROM ({out})"


@query("geodesic_distance", _distance_sql(), (), ("km",))
def _(spark, sf):
    from ..functions.udfs import geodesic_km

    rows = views.table(spark, sf, "customer")
    return rows.select("c_custkey", geodesic_km((F.col("c_custkey") % 30).cast("double") / 10 + 62, (F.col("c_custkey") % 40).cast("double") / 10 - 20, F.lit(64.0), F.lit(-18.0)).alias("km"))


def _lambert_sql() -> str:
    lon0, lat0, lat1, lat2 = -18.0, 64.0, 63.0, 65.0
    tan = lambda d: math.tan(math.pi / 4 + math.radians(d) / 2)
    n = math.log(math.cos(math.radians(lat1)) / math.cos(math.radians(lat2))) / math.log(tan(lat2) / tan(lat1))
    f = 6371.0 * math.cos(math.radians(lat1)) * tan(lat1) ** n / n
    return f"""SELECT c_custkey, rho * sin(theta) AS x, {f / tan(lat0) ** n!r} - rho * cos(theta) AS y FROM (SELECT c_custkey, {f!r} / tan(pi() / 4 + radians(la) / 2) ** {n!r} AS rho, radians(lo - ({lon0})) * {n!r} AS theta
FROM (SELECT c_custkey, CAST(c_custkey % 40 AS DOUBLE) / 10 - 20 AS lo, CAST(c_custkey % 30 AS DOUBLE) / 10 + 62 AS la FROM customer))"""


@query("grid_project_xy", _lambert_sql(), (), ("x", "y"))
def _(spark, sf):
    rows = views.table(spark, sf, "customer").select("c_custkey", ((F.col("c_custkey") % 40).cast("double") / 10 - 20).alias("lon"), ((F.col("c_custkey") % 30).cast("double") / 10 + 62).alias("lat"))
    x, y = grids.lambert(F.col("lon"), F.col("lat"), -18.0, 64.0, 63.0, 65.0)
    return rows.select("c_custkey", x.alias("x"), y.alias("y"))


@query("trim_map", "SELECT batch, node, t, coa FROM (SELECT s.batch, s.n % 5 AS node, s.n AS t, s.coa, o FROM scan s JOIN (SELECT batch, n AS o, row_number() OVER (PARTITION BY batch ORDER BY coa DESC, n) AS r FROM scan) e ON s.batch = e.batch AND e.r = 1) WHERE t >= o - 4 AND t < o + 4", (views.SCAN,), ("coa",))
def _(spark, sf):
    scan = views.scan(spark, sf).select("batch", "n", "coa", "coa_n")
    cells = scan.select("batch", (F.col("n") % 5).alias("node"), F.col("n").alias("t"), "coa")
    return locate.trim_map(cells, locate.origin_time(scan, ["batch"]), ["batch"], 4)


@query("availability_rates", """SELECT station, channel, count(*) >= 64 AND max(value) > min(value) AND min(channel % 9) <> 4 AS usable FROM traces GROUP BY station, channel""", (views.TRACES,))
def _(spark, sf):
    rows = views.traces(spark, sf).withColumn("rate", F.when(F.col("channel") % 9 == 4, 40.0).otherwise(50.0))
    return quality.channel_flags(rows, KEYS, expected=64, rate=50.0).select(*KEYS, "usable")


@query("upsample_padded", """SELECT station, channel, n * 3 + k AS n, value + (coalesce(nxt, value) - value) * k / 3 AS value FROM (SELECT *, lead(value) OVER (PARTITION BY station, channel ORDER BY n) AS nxt FROM traces), (SELECT unnest(range(3)) AS k) WHERE nxt IS NOT NULL OR k = 0
UNION ALL SELECT station, channel, -1, value FROM traces WHERE n = 0 UNION ALL SELECT station, channel, 63 * 3 + k, value FROM traces, (SELECT unnest(range(1, 3)) AS k) WHERE n = 63""", (views.TRACES,), ("value",))
def _(spark, sf):
    return signal.upsample(views.traces(spark, sf), 3, KEYS, pad=(1, 2)).select(*KEYS, "n", "value")


@query("cut_real")
def _(spark, sf):
    response = {"poles": [complex(-4.4, 4.4), complex(-4.4, -4.4)], "zeros": [0j, 0j], "gain": 1.0, "sensitivity": 1500.0}
    events = trigger_plan.trigger(views.scan(spark, sf), TRIG, 1.0)
    rows = export.cut(views.scan(spark, sf).select("batch", "n", "t_us", F.col("coa").alias("value")), events, 600.0, 600.0)
    return export.cut_arrays(rows, ["event_id", "batch"], 1.0, "wa", response)
