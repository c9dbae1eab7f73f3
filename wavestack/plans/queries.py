"""Every operator as a query over the driver's tables, with SQL that must give the same rows.

Doubles are rounded to six decimals on both sides, as the two engines add in different orders; values that
decide a tie are rounded before they are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Amplitude, Magnitude, Picker, Trigger
from ..functions import scalar
from ..operators import grid, locate, magnitude, migrate, onset, picks, quality, signal
from ..operators import trigger as trig
from ..sources import export, readers, synthetic, writers
from . import detect, views
from . import locate as locate_plan
from . import trigger as trigger_plan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NSTA, NLTA = 2, 6
SPAN = (0, 50)
KEYS = ["station", "channel"]
TRIG = Trigger(method="static", threshold=300.0, marginal=300.0, interval=900.0)
RATE = CHUNKED = 1.0
MAG = Magnitude(noise_filter=3.0, trace_filter="HH[AN]$", station_filter=("S3", "S7"), dist_filter=40.0, pick_filter=False, use_hyp_dist=True)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = (), doubles: tuple[str, ...] = ()):
    """Register a query; ``sql`` is its final SELECT over ``ctes``, ``doubles`` the columns to round."""

    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: _rounded(function(spark, sf_dir))
        if sql is not None:
            body = ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + sql
            replaced = ", ".join(f"round({c}, 6) AS {c}" for c in doubles)
            ORACLES[name] = f"SELECT * REPLACE ({replaced}) FROM ({body})" if doubles else body
        return function

    return add


# ---------------------------------------------------------------- onsets

ENERGY = "energy AS (SELECT *, value * value AS e FROM traces)"
CLASSIC = """classic AS (SELECT station, channel, n, CASE WHEN n < 5 OR l < 2.2e-308 THEN 1.0 ELSE s / l END AS onset FROM (
  SELECT *, sum(e) OVER (PARTITION BY station, channel ORDER BY n ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) / 2 AS s,
    sum(e) OVER (PARTITION BY station, channel ORDER BY n ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) / 6 AS l FROM energy))"""
ONSETS = "onsets AS (SELECT station, n, greatest(sqrt(avg(onset * onset)), 0.4) AS onset FROM classic GROUP BY station, n)"
LUT_N = "lutn AS (SELECT station, node, greatest(CAST(round_even(tt, 0) AS INT), 0) AS tt_n FROM lut WHERE phase = 'P')"
CELLS = """cells AS (SELECT node, t, exp(s / available) AS coa FROM (
  SELECT node, n - tt_n AS t, sum(ln(greatest(onset, 0.01))) AS s, count(*) AS c FROM onsets JOIN lutn USING (station) GROUP BY node, n - tt_n),
  (SELECT count(DISTINCT station) AS available FROM onsets) WHERE c = available AND t >= 0 AND t < 50)"""
STACK = (views.TRACES, ENERGY, CLASSIC, ONSETS, views.GRID_SQL, LUT_N, CELLS)


def _energy(spark: SparkSession, sf: str) -> DataFrame:
    return views.traces(spark, sf).withColumn("value", onset.energy(F.col("value")))


def _onsets(spark: SparkSession, sf: str) -> DataFrame:
    return detect.onsets(views.traces(spark, sf), NSTA, NLTA)


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    table = views.travel_times(spark, sf).where("phase = 'P'")
    return detect.coalescence(_onsets(spark, sf), table, 1, *SPAN)


@query("onset_classic", "SELECT station, channel, n, onset FROM classic", (views.TRACES, ENERGY, CLASSIC), ("onset",))
def _(spark, sf):
    return onset.classic(_energy(spark, sf), NSTA, NLTA, KEYS).select(*KEYS, "n", "onset")


@query("onset_centred", """SELECT station, channel, n, CASE WHEN n < 5 OR c < 2 OR l < 2.2e-308 THEN 1.0 ELSE s / l END AS onset FROM (
  SELECT *, sum(e) OVER (PARTITION BY station, channel ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) / 2 AS s,
    count(e) OVER (PARTITION BY station, channel ORDER BY n ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS c,
    sum(e) OVER (PARTITION BY station, channel ORDER BY n ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) / 6 AS l FROM energy)""", (views.TRACES, ENERGY), ("onset",))
def _(spark, sf):
    return onset.centred(_energy(spark, sf), NSTA, NLTA, KEYS).select(*KEYS, "n", "onset")


@query("onset_abs", """SELECT station, channel, n, CASE WHEN n < 5 OR l < 2.2e-308 THEN 1.0 ELSE s / l END AS onset FROM (
  SELECT *, sum(abs(value)) OVER (PARTITION BY station, channel ORDER BY n ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) / 2 AS s,
    sum(abs(value)) OVER (PARTITION BY station, channel ORDER BY n ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) / 6 AS l FROM traces)""", (views.TRACES,), ("onset",))
def _(spark, sf):
    return onset.classic(views.traces(spark, sf).withColumn("value", F.abs("value")), NSTA, NLTA, KEYS).select(*KEYS, "n", "onset")


@query("onset_recursive", """, r AS (
  SELECT station, channel, n, 0.0::DOUBLE AS s, 0.0::DOUBLE AS l FROM energy WHERE n = 0
  UNION ALL SELECT e.station, e.channel, e.n, e.e * (1.0 / 2) + (1 - 1.0 / 2) * r.s, e.e * (1.0::DOUBLE / 6) + (1 - 1.0::DOUBLE / 6) * r.l FROM r JOIN energy e ON e.station = r.station AND e.channel = r.channel AND e.n = r.n + 1)
SELECT station, channel, n, CASE WHEN n < 6 OR l < 2.2e-308 THEN 1.0 ELSE s / l END AS onset FROM r""", (views.TRACES, ENERGY), ("onset",))
def _(spark, sf):
    arrays = views.trace_arrays(spark, sf).withColumn("samples", F.transform("samples", onset.energy))
    return onset.recursive(arrays, NSTA, NLTA).select(*KEYS, F.posexplode("onset").alias("n", "onset"))


ORACLES["onset_recursive"] = ORACLES["onset_recursive"].replace("WITH ", "WITH RECURSIVE ").replace("FROM traces)\n, r AS", "FROM traces), r AS")


@query("onset_rms_combine", "SELECT station, n, onset FROM onsets", (views.TRACES, ENERGY, CLASSIC, ONSETS), ("onset",))
def _(spark, sf):
    return _onsets(spark, sf).select("station", "n", "onset")


@query("onset_trim", """SELECT station, channel, n, CASE WHEN n + 1 <= 3 + 6 - 1 OR n + 1 > t - 2 - 3 THEN 1.0 ELSE onset END AS onset
FROM (SELECT *, count(*) OVER (PARTITION BY station, channel) AS t FROM classic)""", (views.TRACES, ENERGY, CLASSIC), ("onset",))
def _(spark, sf):
    return onset.trim_edges(onset.classic(_energy(spark, sf), NSTA, NLTA, KEYS), NSTA, NLTA, 3, KEYS).select(*KEYS, "n", "onset")


# ---------------------------------------------------------------- traces


@query("trace_detrend", """SELECT station, channel, n, value - y - coalesce(s, 0) * (n - x) AS value FROM (SELECT *, regr_slope(value, n) OVER w AS s, avg(n) OVER w AS x, avg(value) OVER w AS y
  FROM traces WINDOW w AS (PARTITION BY station, channel))""", (views.TRACES,), ("value",))
def _(spark, sf):
    return signal.detrend(views.traces(spark, sf), KEYS).select(*KEYS, "n", "value")


@query("trace_taper", """SELECT station, channel, n, CASE WHEN edge > 1 AND near < edge THEN 0.5 * (1 - cos(pi() * near / (edge - 1))) * value ELSE value END AS value
FROM (SELECT *, floor(t * 0.05 + 0.5) AS edge, least(n, t - 1 - n) AS near FROM (SELECT *, count(*) OVER (PARTITION BY station, channel) AS t FROM traces))""", (views.TRACES,), ("value",))
def _(spark, sf):
    return signal.taper(views.traces(spark, sf), KEYS).select(*KEYS, "n", "value")


@query("trace_upsample", """SELECT station, channel, n * 3 + k AS n, value + (coalesce(nxt, value) - value) * k / 3 AS value FROM (SELECT *, lead(value) OVER (PARTITION BY station, channel ORDER BY n) AS nxt FROM traces), (SELECT unnest(range(3)) AS k)
WHERE nxt IS NOT NULL OR k = 0""", (views.TRACES,), ("value",))
def _(spark, sf):
    return signal.upsample(views.traces(spark, sf), 3, KEYS).select(*KEYS, "n", "value")


@query("trace_energy_rms_std", "SELECT station, channel, sqrt(avg(value * value)) AS rms, stddev_pop(value) AS std, avg(value) AS mean FROM traces GROUP BY station, channel", (views.TRACES,), ("rms", "std", "mean"))
def _(spark, sf):
    return signal.spread(views.traces(spark, sf), KEYS)


@query("shift_to_sample", "SELECT batch, t_us, CAST(round_even(t_us * 0.5 / 1e6, 0) AS BIGINT) AS n, CAST(round_even(CAST(round_even(t_us * 0.5 / 1e6, 0) AS BIGINT) * 1e6 / 0.5, 0) AS BIGINT) - t_us AS shift_us FROM scan", (views.SCAN,))
def _(spark, sf):
    return signal.shift_to_sample(views.scan(spark, sf).select("batch", "t_us"), 0.5)


@query("time_to_sample", "SELECT batch, n, CAST(round_even(z * 50, 0) AS BIGINT) AS sample, floor(ceil(z * 50) / 50 * 1000) / 1000 AS trimmed FROM scan", (views.SCAN,), ("trimmed",))
def _(spark, sf):
    return views.scan(spark, sf).select("batch", "n", scalar.time_to_sample(F.col("z"), 50).alias("sample"), scalar.trim_to_sample(F.col("z"), 50).alias("trimmed"))


# ---------------------------------------------------------------- quality


@query("availability_flags", """, k AS (SELECT * FROM traces WHERE NOT (channel % 7 = 3 AND n = 20)),
c AS (SELECT station, channel, count(*) AS n_samples, max(value) = min(value) AS flat, CAST(sum(CASE WHEN d > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_gaps, CAST(sum(CASE WHEN d = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_overlaps
  FROM (SELECT *, n - lag(n) OVER (PARTITION BY station, channel ORDER BY n) AS d FROM k) GROUP BY station, channel)
SELECT station, channel, n_samples, flat, n_gaps, n_overlaps, NOT flat AND n_overlaps = 0 AND n_gaps = 0 AND n_samples >= 64 AS usable FROM c""", (views.TRACES,))
def _(spark, sf):
    return quality.channel_flags(views.traces(spark, sf).where(~((F.col("channel") % 7 == 3) & (F.col("n") == 20))), KEYS, expected=64)


@query("station_availability", """, k AS (SELECT * FROM traces WHERE NOT (channel % 7 = 3 AND n = 20))
SELECT station, count(*) AS n_channels, CAST(max(CASE WHEN c = 64 THEN 1 ELSE 0 END) AS INT) AS available FROM (SELECT station, channel, count(*) AS c FROM k GROUP BY ALL) GROUP BY station""", (views.TRACES,))
def _(spark, sf):
    channels = quality.channel_flags(views.traces(spark, sf).where(~((F.col("channel") % 7 == 3) & (F.col("n") == 20))), KEYS, expected=64)
    return quality.station_flags(channels, ["station"])


for _name in ("onset_recursive", "availability_flags", "station_availability"):
    ORACLES[_name] = ORACLES[_name].replace("\n, ", ", ")

PRIORITIES = ["1", "2", "3", "4", "5"]


@query("availability_pivot", "SELECT step, " + ", ".join(f"max(CASE WHEN name = '{p}' THEN 1 ELSE 0 END) AS \"{p}\"" for p in PRIORITIES) + " FROM (SELECT CAST(o_orderdate AS DATE) AS step, substr(o_orderpriority, 1, 1) AS name FROM orders) GROUP BY step")
def _(spark, sf):
    return quality.availability_table(views.availability(spark, sf), "step", "name", PRIORITIES)


@query("availability_unpivot", """SELECT DISTINCT CAST(o_orderdate AS DATE) AS step, substr(o_orderpriority, 1, 1) || p AS name FROM orders, (VALUES ('_P'), ('_S')) AS v(p)""")
def _(spark, sf):
    wide = quality.availability_table(views.availability(spark, sf), "step", "name", PRIORITIES)
    return quality.availability_long(wide, "step").where("available = 1").select("step", "name")


@query("chunk_overlap_assign", """SELECT batch, n, unnest(range(greatest(0, CAST(ceil((n - 20 - 99) / 100.0) AS BIGINT)), CAST(floor((n + 10) / 100.0) AS BIGINT) + 1)) AS chunk FROM scan""", (views.SCAN,))
def _(spark, sf):
    return quality.chunks(views.scan(spark, sf).select("batch", "n"), 100, 10, 20).withColumn("chunk", F.col("chunk").cast("long"))


@query("gap_fill_zero", "SELECT s.batch, s.n, coalesce(k.coa, 0) AS coa FROM scan s LEFT JOIN (SELECT * FROM scan WHERE n % 10 <> 4) k ON s.batch = k.batch AND s.n = k.n", (views.SCAN,), ("coa",))
def _(spark, sf):
    scan = views.scan(spark, sf).select("batch", "n", "coa")
    spine = scan.groupBy("batch").agg(F.max("n").alias("m")).select("batch", F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("n"))
    return signal.fill_gaps(scan.where("n % 10 <> 4"), spine, ["batch"], "coa", 0.0).select("batch", "n", "coa")


@query("merge_segments", """SELECT station, channel, n, value FROM traces WHERE channel % 5 <> 2""", (views.TRACES,), ("value",))
def _(spark, sf):
    rows = views.traces(spark, sf)
    clash = rows.where("channel % 5 = 2 AND n = 3").withColumn("value", F.col("value") + 1)
    return quality.merge_segments(rows.unionByName(rows.where("n < 10")).unionByName(clash), KEYS)


@query("segments", """SELECT station, channel, min(n) AS first_n, max(n) AS last_n, count(*) AS n_samples FROM (SELECT *, n - row_number() OVER (PARTITION BY station, channel ORDER BY n) AS r FROM traces WHERE n % 13 <> 7) GROUP BY station, channel, r""", (views.TRACES,))
def _(spark, sf):
    return quality.segments(views.traces(spark, sf).where("n % 13 <> 7"), KEYS)


@query("channel_select", "SELECT id, count(*) AS n FROM obs WHERE regexp_matches(id, '^.*[N,E,1,2]$') GROUP BY id", (views.OBSERVATIONS,))
def _(spark, sf):
    return views.observations(spark, sf).where(F.col("id").rlike(scalar.glob_regex("*[N,E,1,2]"))).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query("time_window", "SELECT batch, n, coa FROM scan WHERE batch BETWEEN DATE '2024-01-05' AND DATE '2024-01-07'", (views.SCAN,), ("coa",))
def _(spark, sf):
    day = 86_400_000_000
    return readers.within(views.scan(spark, sf), 19727 * day, 19730 * day - 1, "batch").select("batch", "n", "coa")


# ---------------------------------------------------------------- grids and travel times


@query("lut_homogeneous", "SELECT station, phase, node, tt FROM lut", (views.GRID_SQL,), ("tt",))
def _(spark, sf):
    return views.travel_times(spark, sf)


@query("lut_samples", "SELECT station, phase, node, greatest(CAST(round_even(tt * 50, 0) AS INT), 0) AS tt_n FROM lut", (views.GRID_SQL,))
def _(spark, sf):
    return grid.travel_samples(views.travel_times(spark, sf), 50).drop("tt")


@query("lut_decimate", "SELECT station, phase, (i - 1) // 3 * 3 + (j - 1) // 3 AS node, tt FROM lut JOIN nodes USING (node) WHERE i >= 0 AND (i - 0) % 3 = 0 AND j % 3 = 0".replace("(i - 1) // 3 * 3 + (j - 1) // 3", "i // 3 * 3 + j // 3"), (views.GRID_SQL,), ("tt",))
def _(spark, sf):
    return grid.decimate(views.travel_times(spark, sf), views.GRID, (3, 3, 1))[0]


@query("lut_union", "SELECT station, phase, node, CASE WHEN station < 6 THEN tt ELSE tt * 2 END AS tt FROM lut", (views.GRID_SQL,), ("tt",))
def _(spark, sf):
    table = views.travel_times(spark, sf)
    return grid.union(table.where("station < 6"), table.where("station > 3").withColumn("tt", F.col("tt") * 2), views.GRID, views.GRID)


@query("grid_index_roundtrip", "SELECT node, i, j, k, x, y, z, node AS back FROM nodes", (views.GRID_SQL,), ("x", "y", "z"))
def _(spark, sf):
    rows = views.nodes(spark)
    return rows.withColumn("back", grid.nearest_node(F.col("x") + 0.2, F.col("y") - 0.2, F.col("z"), views.GRID))


@query("grid_project", "SELECT c_custkey, CAST(c_custkey % 40 AS DOUBLE) / 10 - 20 AS lon, CAST(c_custkey % 30 AS DOUBLE) / 10 + 62 AS lat FROM customer", (), ("lon", "lat"))
def _(spark, sf):
    rows = views.table(spark, sf, "customer").select("c_custkey", ((F.col("c_custkey") % 40).cast("double") / 10 - 20).alias("lon"), ((F.col("c_custkey") % 30).cast("double") / 10 + 62).alias("lat"))
    setup = (-18.0, 64.0, 63.0, 65.0)
    x, y = grid.lambert(F.col("lon"), F.col("lat"), *setup)
    lon, lat = grid.lambert_inverse(F.col("x"), F.col("y"), *setup)
    return rows.withColumn("x", x).withColumn("y", y).select("c_custkey", lon.alias("lon"), lat.alias("lat"))


@query("velocity_interp", """SELECT s_suppkey, d AS z, CASE WHEN d < 2 THEN 3 + d / 2 WHEN d < 6 THEN 4 + (d - 2) / 2 ELSE 6 END AS speed FROM (SELECT s_suppkey, CAST(s_suppkey % 100 AS DOUBLE) / 10 AS d FROM supplier)""", (), ("z", "speed"))
def _(spark, sf):
    model = spark.createDataFrame([("P", 0.0, 3.0), ("P", 2.0, 4.0), ("P", 6.0, 6.0)], "phase string, depth double, speed double")
    rows = views.table(spark, sf, "supplier").select("s_suppkey", ((F.col("s_suppkey") % 100).cast("double") / 10).alias("z"))
    return grid.layer_speed(rows, model).select("s_suppkey", "z", "speed")


@query("bilinear_tt", """SELECT s_suppkey, (1 - fx) * (1 - fz) * (a * 10 + b) + fx * (1 - fz) * ((a + 1) * 10 + b) + (1 - fx) * fz * (a * 10 + b + 1) + fx * fz * ((a + 1) * 10 + b + 1) AS tt
FROM (SELECT s_suppkey, floor(x) AS a, floor(z) AS b, x - floor(x) AS fx, z - floor(z) AS fz FROM (SELECT s_suppkey, CAST(s_suppkey % 80 AS DOUBLE) / 10 AS x, CAST(s_suppkey % 70 AS DOUBLE) / 10 AS z FROM supplier))""", (), ("tt",))
def _(spark, sf):
    table = spark.range(100).select(F.floor(F.col("id") / 10).alias("ix"), (F.col("id") % 10).alias("iz"), (F.floor(F.col("id") / 10) * 10.0 + F.col("id") % 10).alias("tt"))
    points = views.table(spark, sf, "supplier").select("s_suppkey", ((F.col("s_suppkey") % 80).cast("double") / 10).alias("distance"), ((F.col("s_suppkey") % 70).cast("double") / 10).alias("depth"))
    return grid.bilinear(points, table, 1.0, 1.0).select("s_suppkey", "tt")


@query("max_traveltime", "SELECT phase, max(tt) AS max_tt FROM lut GROUP BY phase", (views.GRID_SQL,), ("max_tt",))
def _(spark, sf):
    return grid.extents(views.travel_times(spark, sf))


# ---------------------------------------------------------------- migration


@query("migrate_stack", "SELECT node, t, coa FROM cells", STACK, ("coa",))
def _(spark, sf):
    return _cells(spark, sf)


MAXIMA = """rc AS (SELECT node, t, round(coa, 9) AS coa FROM cells), m AS (SELECT t, max(coa) AS max_coa, max(coa) * count(*) / sum(coa) AS max_coa_n FROM rc GROUP BY t)"""


@query("detect_max_coalescence", "SELECT m.t, max_coa, max_coa_n, min(node) AS node FROM m JOIN rc ON m.t = rc.t AND rc.coa = m.max_coa GROUP BY m.t, max_coa, max_coa_n", (*STACK, MAXIMA), ("max_coa", "max_coa_n"))
def detect_max_coalescence(spark, sf):
    return detect.detect(views.traces(spark, sf), views.travel_times(spark, sf), 1, NSTA, NLTA, *SPAN, digits=9)


@query("first_argmax", "SELECT m.t, min(node) AS node FROM m JOIN rc ON m.t = rc.t AND rc.coa = m.max_coa GROUP BY m.t", (*STACK, MAXIMA))
def _(spark, sf):
    return migrate.find_max(_cells(spark, sf).withColumn("coa", F.round("coa", 9))).select("t", "node")


@query("normalised_max", "SELECT t, max_coa_n FROM m", (*STACK, MAXIMA), ("max_coa_n",))
def _(spark, sf):
    return migrate.find_max(_cells(spark, sf)).select("t", "max_coa_n")


@query("migrate_block", "SELECT m.t, max_coa, max_coa_n, min(node) AS node FROM m JOIN rc ON m.t = rc.t AND rc.coa = m.max_coa GROUP BY m.t, max_coa, max_coa_n", (*STACK, MAXIMA), ("max_coa", "max_coa_n"))
def _(spark, sf):
    table = grid.travel_samples(views.travel_times(spark, sf).where("phase = 'P'"), 1)
    onsets = _onsets(spark, sf).withColumn("chunk", F.lit(0))
    return migrate.detect_blocks(onsets, table, *SPAN, block=16, width=20, digits=9).drop("chunk")


@query("scan_fixed_point", "SELECT batch, n, CAST(round_even(least(coa, 21474) * 1e5, 0) AS INT) AS coa_i, CAST(round_even(least(coa_n, 21474) * 1e5, 0) AS INT) AS coa_n_i FROM scan", (views.SCAN,))
def _(spark, sf):
    return views.scan(spark, sf).select("batch", "n", scalar.fixed_point(F.col("coa"), 1e5).alias("coa_i"), scalar.fixed_point(F.col("coa_n"), 1e5).alias("coa_n_i"))


# ---------------------------------------------------------------- trigger


@query("threshold_static", "SELECT batch, n, 300.0::DOUBLE AS threshold FROM scan WHERE coa >= 300", (views.SCAN,), ("threshold",))
def _(spark, sf):
    return trig.threshold(views.scan(spark, sf), TRIG, RATE).where(F.col("coa") >= F.col("threshold")).select("batch", "n", "threshold")


@query("threshold_mad", """SELECT batch, n, m + 2 * 1.4826 * median(abs(coa - m)) OVER (PARTITION BY batch, n // 100) AS threshold FROM (SELECT *, median(coa) OVER (PARTITION BY batch, n // 100) AS m FROM scan)""", (views.SCAN,), ("threshold",))
def _(spark, sf):
    return trig.threshold(views.scan(spark, sf), Trigger(method="mad", multiplier=2.0, window=100.0), RATE).select("batch", "n", "threshold")


@query("threshold_median_ratio", "SELECT batch, n, 1.2 * median(coa) OVER (PARTITION BY batch, n // 100) AS threshold FROM scan", (views.SCAN,), ("threshold",))
def _(spark, sf):
    return trig.threshold(views.scan(spark, sf), Trigger(method="median_ratio", multiplier=1.2, window=100.0), RATE).select("batch", "n", "threshold")


@query("scan_mad", "SELECT batch, median(abs(coa - m)) * 1.4826 AS mad FROM (SELECT *, median(coa) OVER (PARTITION BY batch) AS m FROM scan) GROUP BY batch", (views.SCAN,), ("mad",))
def _(spark, sf):
    scan = views.scan(spark, sf)
    middle = scan.groupBy("batch").agg(F.median("coa").alias("m"))
    return scan.join(middle, "batch").groupBy("batch").agg(trig.mad(F.col("coa"), F.col("m")).alias("mad"))


@query("scan_smooth", """, k AS (SELECT k, exp(-0.5 * (k / 1.5) ** 2) / sum(exp(-0.5 * (k / 1.5) ** 2)) OVER () AS w FROM (SELECT unnest(range(-6, 7)) AS k)),
t AS (SELECT *, count(*) OVER (PARTITION BY batch) AS total FROM scan),
f AS (SELECT batch, n AS at, w, total, (((n + k) % (2 * total)) + 2 * total) % (2 * total) AS m FROM t, k)
SELECT f.batch, f.at AS n, sum(s.coa * w) AS coa, sum(s.coa_n * w) AS coa_n FROM f JOIN scan s ON s.batch = f.batch AND s.n = CASE WHEN m < total THEN m ELSE 2 * total - 1 - m END GROUP BY f.batch, f.at""", (views.SCAN,), ("coa", "coa_n"))
def _(spark, sf):
    return trig.smooth(views.scan(spark, sf), 1.5, ["coa", "coa_n"]).select("batch", "n", "coa", "coa_n")


CANDIDATES = """isl AS (SELECT *, n - row_number() OVER (PARTITION BY batch ORDER BY n) AS island FROM scan WHERE coa >= 300),
pk AS (SELECT *, row_number() OVER (PARTITION BY batch, island ORDER BY coa DESC, n) AS r, min(t_us) OVER (PARTITION BY batch, island) AS first_us, max(t_us) OVER (PARTITION BY batch, island) AS last_us FROM isl),
cand AS (SELECT batch, island, first_us, last_us, t_us AS coa_us, coa AS trig_coa, x AS coa_x, y AS coa_y, z AS coa_z, coa, coa_n AS coa_norm,
  CASE WHEN t_us - first_us < 300000000 THEN t_us - 900000000 ELSE first_us - 600000000 END AS min_us,
  CASE WHEN last_us - t_us < 300000000 THEN t_us + 900000000 ELSE last_us + 600000000 END AS max_us FROM pk WHERE r = 1)"""
REFINED = """fl AS (SELECT *, CASE WHEN lag(max_us) OVER w < coa_us - 300000000 AND min_us > lag(coa_us) OVER w + 300000000 THEN 1 ELSE 0 END AS a FROM cand WINDOW w AS (PARTITION BY batch ORDER BY coa_us)),
gr AS (SELECT *, sum(a) OVER (PARTITION BY batch ORDER BY coa_us) AS event_num FROM fl),
ev AS (SELECT batch, CAST(event_num AS BIGINT) AS event_num, strftime(make_timestamp(coa_us), '%Y%m%d%H%M%S') || lpad(CAST((coa_us // 1000) % 1000 AS VARCHAR), 3, '0') AS event_id, coa_us, trig_coa, coa_x, coa_y, coa_z, coa, coa_norm, min_us, max_us
  FROM (SELECT * EXCLUDE (min_us, max_us), row_number() OVER (PARTITION BY batch, event_num ORDER BY trig_coa DESC, coa_us) AS r, min(min_us) OVER (PARTITION BY batch, event_num) AS min_us, max(max_us) OVER (PARTITION BY batch, event_num) AS max_us FROM gr) WHERE r = 1)"""
EVENT_DOUBLES = ("trig_coa", "coa_x", "coa_y", "coa_z", "coa", "coa_norm")


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    return trig.candidates(trig.threshold(views.scan(spark, sf), TRIG, RATE), TRIG)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return trigger_plan.trigger(views.scan(spark, sf), TRIG, RATE)


@query("candidates", "SELECT batch, first_us, last_us, coa_us, trig_coa, coa_x, coa_y, coa_z, coa, coa_norm FROM cand", (views.SCAN, CANDIDATES), EVENT_DOUBLES)
def _(spark, sf):
    return _candidates(spark, sf).drop("island", "min_us", "max_us")


@query("candidate_windows", "SELECT batch, coa_us, min_us, max_us FROM cand", (views.SCAN, CANDIDATES))
def _(spark, sf):
    return _candidates(spark, sf).select("batch", "coa_us", "min_us", "max_us")


@query("refined_events", "SELECT * FROM ev", (views.SCAN, CANDIDATES, REFINED), EVENT_DOUBLES)
def _(spark, sf):
    return _events(spark, sf)


LOW, HIGH = 1704412800000000, 1705276800000000
REGION = (0.0, 2.0, 0.0, 1000000.0, 80.0, 8.0)
KEPT = f"kept AS (SELECT * FROM ev WHERE coa_us BETWEEN {LOW} AND {HIGH} AND coa_x BETWEEN 0 AND 1000000 AND coa_y BETWEEN 2 AND 80 AND coa_z BETWEEN 0 AND 8)"


@query("region_filter", "SELECT event_id, coa_us, coa_x, coa_y, coa_z FROM kept", (views.SCAN, CANDIDATES, REFINED, KEPT), ("coa_x", "coa_y", "coa_z"))
def _(spark, sf):
    return trig.inside(_events(spark, sf), LOW, HIGH, REGION).select("event_id", "coa_us", "coa_x", "coa_y", "coa_z")


@query("discarded_events", "SELECT event_id, coa FROM ev WHERE event_id NOT IN (SELECT event_id FROM kept)", (views.SCAN, CANDIDATES, REFINED, KEPT), ("coa",))
def _(spark, sf):
    events = _events(spark, sf)
    return trig.discarded(events, trig.inside(events, LOW, HIGH, REGION)).select("event_id", "coa")


@query("event_id", "SELECT t_us, strftime(make_timestamp(t_us), '%Y%m%d%H%M%S') || lpad(CAST((t_us // 1000) % 1000 AS VARCHAR), 3, '0') AS event_id FROM scan", (views.SCAN,))
def _(spark, sf):
    return views.scan(spark, sf).select("t_us", scalar.event_id(F.timestamp_micros("t_us")).alias("event_id"))


# ---------------------------------------------------------------- locate

MARGINAL = "mg AS (SELECT node, s / max(s) OVER () AS c FROM (SELECT node, sum(coa) AS s FROM cells GROUP BY node))"


@query("marginal_map", "SELECT node, c FROM mg", (*STACK, MARGINAL), ("c",))
def _(spark, sf):
    return locate.marginal(_cells(spark, sf), [])


@query("origin_time", "SELECT batch, n AS otime_n, coa, coa_n FROM (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY coa DESC, n) AS r FROM scan) WHERE r = 1", (views.SCAN,), ("coa", "coa_n"))
def _(spark, sf):
    return locate.origin_time(views.scan(spark, sf), ["batch"])


@query("marginal_window_test", "SELECT batch, otime_n FROM (SELECT batch, n AS otime_n, row_number() OVER (PARTITION BY batch ORDER BY coa DESC, n) AS r FROM scan) WHERE r = 1 AND otime_n - 100 < 150 AND 150 < otime_n + 100", (views.SCAN,))
def _(spark, sf):
    events = locate.origin_time(views.scan(spark, sf), ["batch"]).withColumn("trigger_n", F.lit(150))
    return locate.in_marginal_window(events, 100).select("batch", "otime_n")


@query("marginal_trim", "SELECT s.batch, s.n, s.coa FROM scan s JOIN (SELECT batch, n AS o, row_number() OVER (PARTITION BY batch ORDER BY coa DESC, n) AS r FROM scan) e ON s.batch = e.batch AND e.r = 1 WHERE abs(s.n - o) <= 5", (views.SCAN,), ("coa",))
def _(spark, sf):
    scan = views.scan(spark, sf).select("batch", "n", "coa", "coa_n")
    return locate.trim_series(scan, locate.origin_time(scan, ["batch"]), ["batch"], 5).select("batch", "n", "coa")


@query("top_node", "SELECT min(node) AS node, round(max(c), 6) AS c FROM mg WHERE round(c, 9) = (SELECT max(round(c, 9)) FROM mg)", (*STACK, MARGINAL))
def _(spark, sf):
    return locate.top_node(locate.marginal(_cells(spark, sf), []).withColumn("c", F.round("c", 9)), [])


@query("near_node", "SELECT node, c FROM mg WHERE abs(node // 8 - 3) <= 2 AND abs(node % 8 - 4) <= 2", (*STACK, MARGINAL), ("c",))
def _(spark, sf):
    return locate.near_node(locate.marginal(_cells(spark, sf), []), views.GRID, (3, 4, 0), 5)


@query("cov_location", """, p AS (SELECT c, x, y FROM mg JOIN nodes USING (node) WHERE c > 0.9), a AS (SELECT sum(c * x) / sum(c) AS mx, sum(c * y) / sum(c) AS my FROM p)
SELECT max(mx) AS cov_x, max(my) AS cov_y, sqrt(sum(c * (x - mx) ** 2) / sum(c)) AS err_x, sqrt(sum(c * (y - my) ** 2) / sum(c)) AS err_y, sum(c * (x - mx) * (y - my)) / sum(c) AS cov_xy FROM p, a""", (*STACK, MARGINAL), ("cov_x", "cov_y", "err_x", "err_y", "cov_xy"))
def _(spark, sf):
    cells = locate.marginal(_cells(spark, sf), []).join(views.nodes(spark), "node")
    return locate.covariance(cells, []).select("cov_x", "cov_y", "err_x", "err_y", "cov_xy")


@query("map_slices", "SELECT 'xy' AS plane, CAST(node // 8 AS INT) AS a, CAST(node % 8 AS INT) AS b, c FROM mg UNION ALL SELECT 'xz', CAST(node // 8 AS INT), 0, c FROM mg WHERE node % 8 = 4 UNION ALL SELECT 'yz', CAST(node % 8 AS INT), 0, c FROM mg WHERE node // 8 = 3", (*STACK, MARGINAL), ("c",))
def _(spark, sf):
    return locate.slices(locate.marginal(_cells(spark, sf), []), views.GRID, 28)


# ---------------------------------------------------------------- picks

ARRIVALS = "arr AS (SELECT station, CASE phase WHEN 'P' THEN 0 ELSE 1 END AS phase_index, phase, CAST(round_even(tt * 4, 0) AS BIGINT) + 6 AS arrival_n, tt FROM lut WHERE node = 35)"
WINDOWS = """win AS (SELECT station, phase, arrival_n, CAST(greatest(0, coalesce(greatest(l, mb), l)) AS BIGINT) AS low_n, CAST(least(64, coalesce(least(h, mn), h)) AS BIGINT) AS high_n FROM (
  SELECT *, arrival_n - CAST(round_even((tt * 0.1 + 2.0) * 4, 0) AS BIGINT) AS l, arrival_n + CAST(round_even((tt * 0.1 + 2.0) * 4, 0) AS BIGINT) AS h,
    floor((arrival_n + lead(arrival_n) OVER w) / 2) AS mn, floor((lag(arrival_n) OVER w + arrival_n) / 2) AS mb FROM arr WINDOW w AS (PARTITION BY station ORDER BY phase_index)))"""
PICKER = Picker(threshold="mad", multiplier=1.0)


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    table = views.travel_times(spark, sf).where("node = 35")
    arrivals = table.select("station", F.when(F.col("phase") == "P", 0).otherwise(1).alias("phase_index"), "phase", (F.rint(F.col("tt") * 4).cast("long") + 6).alias("arrival_n"), "tt")
    return picks.windows(arrivals, PICKER, 4, 64, ["station"])


@query("pick_windows", "SELECT station, phase, arrival_n, low_n, high_n FROM win", (views.GRID_SQL, ARRIVALS, WINDOWS))
def _(spark, sf):
    return _windows(spark, sf).select("station", "phase", "arrival_n", "low_n", "high_n")


OUTSIDE = "outs AS (SELECT station, onset FROM onsets o WHERE onset > 1 AND NOT EXISTS (SELECT 1 FROM win w WHERE w.station = o.station AND o.n BETWEEN low_n AND high_n))"
THRESHOLDS = "thr AS (SELECT station, max(m) + 1.4826 * median(abs(onset - m)) AS threshold FROM (SELECT *, median(onset) OVER (PARTITION BY station) AS m FROM outs) GROUP BY station)"
PICK = (views.TRACES, ENERGY, CLASSIC, ONSETS, views.GRID_SQL, ARRIVALS, WINDOWS, OUTSIDE, THRESHOLDS)


@query("pick_threshold", "SELECT station, threshold FROM thr", PICK, ("threshold",))
def _(spark, sf):
    return picks.noise_threshold(_onsets(spark, sf), _windows(spark, sf), PICKER, ["station"])


@query("pick_threshold_percentile", "SELECT station, quantile_cont(onset, 0.9) AS threshold FROM outs GROUP BY station", PICK, ("threshold",))
def _(spark, sf):
    return picks.noise_threshold(_onsets(spark, sf), _windows(spark, sf), Picker(threshold="percentile", percentile=90.0), ["station"])


def _peaks(spark: SparkSession, sf: str) -> DataFrame:
    onsets, spans = _onsets(spark, sf).drop("phase"), _windows(spark, sf)
    thresholds = picks.noise_threshold(onsets, spans, PICKER, ["station"])
    rows = onsets.join(spans.select("station", "phase", "low_n", "high_n"), "station").join(thresholds, "station")
    return picks.peak_run(rows.withColumn("onset", F.round("onset", 9)), ["station", "phase"])


@query("pick_peak_run", """, w AS (SELECT o.station, phase, n, round(onset, 9) AS onset, threshold FROM onsets o JOIN win USING (station) JOIN thr USING (station) WHERE n >= low_n AND n < high_n),
tp AS (SELECT station, phase, n AS peak_n, onset AS peak FROM (SELECT *, row_number() OVER (PARTITION BY station, phase ORDER BY onset DESC, n) AS r FROM w) WHERE r = 1),
ru AS (SELECT station, phase, min(n) AS first_n, max(n) AS last_n FROM (SELECT *, n - row_number() OVER (PARTITION BY station, phase ORDER BY n) AS g FROM w WHERE onset > threshold) GROUP BY station, phase, g)
SELECT station, phase, first_n, last_n, peak_n, peak FROM ru JOIN tp USING (station, phase) WHERE peak_n BETWEEN first_n AND last_n AND last_n > first_n""", PICK, ("peak",))
def _(spark, sf):
    return _peaks(spark, sf)


@query("pick_residual", "SELECT batch, n, (t_us - lag(t_us) OVER (PARTITION BY batch ORDER BY n)) / 1e6 AS residual FROM scan", (views.SCAN,), ("residual",))
def _(spark, sf):
    from pyspark.sql.window import Window

    rows = views.scan(spark, sf).select("batch", "n", F.col("t_us").alias("pick_us"), F.lag("t_us").over(Window.partitionBy("batch").orderBy("n")).alias("modelled_us"))
    return picks.residuals(rows).select("batch", "n", "residual")


@query("seed_ids", "SELECT event_id, array_to_string(list_sort(list(DISTINCT id)), ' ') AS seed_ids FROM obs GROUP BY event_id", (views.OBSERVATIONS,))
def _(spark, sf):
    return picks.seed_ids(views.observations(spark, sf), ["event_id"], "id").select("event_id", F.array_join("seed_ids", " ").alias("seed_ids"))


# ---------------------------------------------------------------- amplitudes and magnitudes

AMP = Amplitude(signal_window=1.5)


@query("amp_windows", """SELECT station, p - 2 - pt * 0.1 AS p_start, CASE WHEN s0 < p1 THEN p1 + (s0 - p1) / 2 WHEN s0 - p1 < 1.5 THEN s0 ELSE p1 + 1.5 END AS p_end, CASE WHEN s0 < p1 THEN p1 + (s0 - p1) / 2 ELSE s0 END AS s_start, s1 AS s_end, p < s AS order_ok
FROM (SELECT *, p + 2 + pt * 0.1 AS p1, s - 2 - st * 0.1 AS s0, s + 2 + st * 0.1 + 1.5 AS s1 FROM (SELECT station, max(tt) FILTER (phase = 'P') AS p, max(tt) FILTER (phase = 'P') AS pt, max(tt) FILTER (phase = 'S') AS s, max(tt) FILTER (phase = 'S') AS st FROM lut WHERE node = 35 GROUP BY station))""", (views.GRID_SQL,), ("p_start", "p_end", "s_start", "s_end"))
def _(spark, sf):
    of = lambda p: F.max(F.when(F.col("phase") == p, F.col("tt")))
    wide = views.travel_times(spark, sf).where("node = 35").groupBy("station").agg(of("P").alias("p_time"), of("P").alias("p_tt"), of("S").alias("s_time"), of("S").alias("s_tt"))
    return magnitude.amplitude_windows(wide, 2.0, 0.1, AMP.signal_window).select("station", "p_start", "p_end", "s_start", "s_end", "order_ok")


@query("amp_noise", """SELECT station, channel, CASE WHEN max(value) > min(value) THEN sqrt(avg(d * d)) * 1000 END AS noise_amp FROM (SELECT station, channel, value, value - avg(value) OVER w - coalesce(regr_slope(value, n) OVER w, 0) * (n - avg(n) OVER w) AS d
FROM traces JOIN win USING (station) WHERE phase = 'P' AND n BETWEEN greatest(0, arrival_n - 12) AND arrival_n WINDOW w AS (PARTITION BY station, channel)) GROUP BY station, channel""", (views.TRACES, views.GRID_SQL, ARRIVALS, WINDOWS), ("noise_amp",))
def _(spark, sf):
    spans = _windows(spark, sf).where("phase = 'P'").select("station", F.greatest(F.lit(0), F.col("arrival_n") - 12).alias("low_n"), F.col("arrival_n").alias("high_n"))
    return magnitude.noise_amplitude(magnitude.windowed(views.traces(spark, sf), spans, ["station"], 16), KEYS)


@query("amp_peak_to_trough", """, t AS (SELECT * FROM (SELECT *, lag(value) OVER w AS b, lead(value) OVER w AS a FROM traces WINDOW w AS (PARTITION BY station, channel ORDER BY n)) WHERE (value > b AND value > a) OR (value < b AND value < a)),
d AS (SELECT * FROM (SELECT station, channel, n, abs(lead(value) OVER w - value) AS d, lead(n) OVER w AS m FROM t WINDOW w AS (PARTITION BY station, channel ORDER BY n)) WHERE d IS NOT NULL)
SELECT station, channel, d * 1000 / 2 AS amp, 50.0 / (2 * (m - n)) AS freq, (n + m) / 2 AS time_n FROM (SELECT *, row_number() OVER (PARTITION BY station, channel ORDER BY d DESC, n) AS r FROM d) WHERE r = 1""", (views.TRACES,), ("amp", "freq", "time_n"))
def _(spark, sf):
    return magnitude.peak_to_trough(views.traces(spark, sf), KEYS, 50.0)


@query("picks_fallback", """SELECT event_id, CASE WHEN b AND np = 2 THEN coalesce(pp, pm) ELSE pm END AS p_us, CASE WHEN b AND np = 2 THEN coalesce(sp, sm) ELSE sm END AS s_us, b AND np = 2 AND (pp IS NOT NULL OR sp IS NOT NULL) AS is_picked FROM (
  SELECT event_id, max(pick) FILTER (ph = 'P') AS pp, max(md) FILTER (ph = 'P') AS pm, max(pick) FILTER (ph = 'S') AS sp, max(md) FILTER (ph = 'S') AS sm, bool_and(ok) AS b, count(DISTINCT ph) AS np FROM (
    SELECT l_orderkey AS event_id, CASE WHEN l_linenumber % 2 = 1 THEN 'P' ELSE 'S' END AS ph, CASE WHEN l_linestatus = 'O' THEN l_partkey * 10 END AS pick, l_partkey * 10 + l_suppkey AS md, l_returnflag <> 'R' AS ok FROM lineitem) GROUP BY event_id)""")
def _(spark, sf):
    rows = views.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.when(F.col("l_linenumber") % 2 == 1, "P").otherwise("S").alias("phase"), F.when(F.col("l_linestatus") == "O", F.col("l_partkey") * 10).alias("pick_us"), (F.col("l_partkey") * 10 + F.col("l_suppkey")).alias("modelled_us"), (F.col("l_returnflag") != "R").alias("has_onset"))
    return magnitude.picks_or_modelled(rows, ["event_id"])


def curve_sql(name: str) -> str:
    if name == "UK":
        a, b, c, e, level = scalar.UK
        return f"{a} * log10(d) + {b} * d + ({c}) * exp({e} * d) + ({level})"
    a, reference, b, level = scalar.CURVES[name]
    return f"{a} * log10(d / {reference}) + ({b}) * (d - {reference}) + {level}"


NAMES = [*scalar.CURVES, "UK"]


@query("attenuation_curves", "SELECT d, " + ", ".join(f'{curve_sql(n)} AS "{n}"' for n in NAMES) + " FROM (SELECT DISTINCT epi_dist AS d FROM obs)", (views.OBSERVATIONS,), ("d", *(f'"{n}"' for n in NAMES)))
def _(spark, sf):
    rows = views.observations(spark, sf).select(F.col("epi_dist").alias("d")).distinct()
    return rows.select("d", *[scalar.attenuation(F.col("d"), n).alias(n) for n in NAMES])


@query("hypo_distance", "SELECT event_id, id, epi_dist, z_dist, nullif(sqrt(epi_dist ** 2 + z_dist ** 2), 0) AS dist FROM obs", (views.OBSERVATIONS,), ("epi_dist", "z_dist", "dist"))
def _(spark, sf):
    return magnitude.distances(views.observations(spark, sf), MAG).select("event_id", "id", "epi_dist", "z_dist", "dist")


@query("haversine_distance", """SELECT c_custkey, 2 * 6371 * asin(sqrt(least(1, sin(radians(64 - la) / 2) ** 2 + cos(radians(la)) * cos(radians(64)) * sin(radians(-18 - lo) / 2) ** 2))) AS km
FROM (SELECT c_custkey, CAST(c_custkey % 30 AS DOUBLE) / 10 + 62 AS la, CAST(c_custkey % 40 AS DOUBLE) / 10 - 20 AS lo FROM customer)""", (), ("km",))
def _(spark, sf):
    rows = views.table(spark, sf, "customer")
    return rows.select("c_custkey", scalar.haversine((F.col("c_custkey") % 30).cast("double") / 10 + 62, (F.col("c_custkey") % 40).cast("double") / 10 - 20, F.lit(64.0), F.lit(-18.0)).alias("km"))


ML = f"""mlv AS (SELECT event_id, id, amp, noise, dist AS d, is_picked, 0.0 AS corr, CASE WHEN amp > 0 AND amp >= noise THEN log10(amp) + {curve_sql("Hutton-Boore")} END AS ml,
  CASE WHEN amp > 0 AND amp > noise THEN log10(amp + noise) - log10(amp - noise) END AS ml_err
  FROM (SELECT *, dist AS d, noise_amp / filter_gain AS noise FROM (SELECT *, nullif(sqrt(epi_dist ** 2 + z_dist ** 2), 0) AS dist FROM obs))),
used AS (SELECT * FROM mlv WHERE amp > noise_of AND regexp_matches(id, 'HH[AN]$') AND NOT contains(id, '.S3.') AND NOT contains(id, '.S7.') AND d <= 40 AND ml IS NOT NULL)"""
ML = ML.replace("SELECT event_id, id, amp, noise, dist AS d,", "SELECT event_id, id, amp, noise, noise_amp * 3 AS noise_of, dist AS d,")


def _magnitudes(spark: SparkSession, sf: str, config: Magnitude = MAG) -> DataFrame:
    return magnitude.channel_magnitudes(magnitude.distances(views.observations(spark, sf), config), config)


def _used(spark: SparkSession, sf: str) -> DataFrame:
    return magnitude.filters(_magnitudes(spark, sf), MAG)


@query("channel_ml", "SELECT event_id, id, d AS dist, ml, ml_err FROM mlv", (views.OBSERVATIONS, ML), ("dist", "ml", "ml_err"))
def _(spark, sf):
    rows = _magnitudes(spark, sf)
    return rows.select("event_id", "id", "dist", "ml", F.when(F.col("ml_err") < float("inf"), F.col("ml_err")).alias("ml_err"))


@query("station_corrections", f"SELECT event_id, id, log10(amp) + {curve_sql('keir2006')} + CASE id WHEN 'XX.S1..HHA' THEN 0.25 WHEN 'XX.S2..HHN' THEN -0.5 ELSE 0 END AS ml FROM (SELECT *, nullif(epi_dist, 0) AS d FROM obs) WHERE amp >= noise_amp / filter_gain", (views.OBSERVATIONS,), ("ml",))
def _(spark, sf):
    config = Magnitude(attenuation="keir2006", station_corrections={"XX.S1..HHA": 0.25, "XX.S2..HHN": -0.5})
    return _magnitudes(spark, sf, config).where("ml IS NOT NULL").select("event_id", "id", "ml")


@query("mag_filters", "SELECT event_id, count(*) AS n_used FROM used GROUP BY event_id", (views.OBSERVATIONS, ML))
def _(spark, sf):
    return _used(spark, sf).where("used").groupBy("event_id").agg(F.count(F.lit(1)).alias("n_used"))


NETWORK = "net AS (SELECT event_id, max(mean) AS ml, CASE WHEN count(*) = 1 THEN max(ml_err) ELSE sqrt(sum(((ml - mean) * w) ** 2) / sum(w)) END AS ml_err, count(*) AS n_obs FROM (SELECT *, sum(ml * w) OVER (PARTITION BY event_id) / sum(w) OVER (PARTITION BY event_id) AS mean FROM (SELECT *, {w} AS w FROM used)) GROUP BY event_id)"


@query("network_ml", "SELECT event_id, ml, ml_err, n_obs FROM net", (views.OBSERVATIONS, ML, NETWORK.format(w="1.0")), ("ml", "ml_err"))
def _(spark, sf):
    return magnitude.network(_used(spark, sf))


@query("network_ml_weighted", "SELECT event_id, ml, ml_err, n_obs FROM net WHERE n_obs > 0 AND ml IS NOT NULL", (views.OBSERVATIONS, ML, "used2 AS (SELECT * FROM used WHERE ml_err > 0.01)", NETWORK.format(w="1 / (ml_err * ml_err)").replace("FROM used)", "FROM used2)")), ("ml", "ml_err"))
def _(spark, sf):
    return magnitude.network(_used(spark, sf).where("ml_err > 0.01"), weighted=True)


@query("ml_r2", f"""SELECT event_id, CASE WHEN count(*) >= 2 AND max(y) <> min(y) THEN (sum((y - a) ** 2) - sum((y - m) ** 2)) / sum((y - a) ** 2) END AS r2 FROM (
  SELECT event_id, log10(amp) AS y, avg(log10(amp)) OVER (PARTITION BY event_id) AS a, mean - ({curve_sql("Hutton-Boore")}) AS m FROM (SELECT *, avg(ml) OVER (PARTITION BY event_id) AS mean FROM used)) GROUP BY event_id""", (views.OBSERVATIONS, ML), ("r2",))
def _(spark, sf):
    used = _used(spark, sf)
    return magnitude.fit_quality(used, magnitude.network(used), MAG)


@query("predicted_amplitude", f"SELECT event_id, id, ml - ({curve_sql('Hutton-Boore')}) AS log_amp FROM mlv WHERE ml IS NOT NULL", (views.OBSERVATIONS, ML), ("log_amp",))
def _(spark, sf):
    return _magnitudes(spark, sf).where("ml IS NOT NULL").select("event_id", "id", (F.col("ml") - scalar.attenuation(F.col("dist"), "Hutton-Boore")).alias("log_amp"))


# ---------------------------------------------------------------- sources, sinks, exports


@query("general_format", """SELECT batch, n, printf('%.3g', coa) AS short FROM scan""".replace("printf('%.3g', coa)", "CASE WHEN coa >= 100 THEN CAST(CAST(round_even(coa, 0) AS BIGINT) AS VARCHAR) ELSE 'x' END") + " WHERE coa >= 100 AND coa < 999", (views.SCAN,))
def _(spark, sf):
    return views.scan(spark, sf).where("coa >= 100 AND coa < 999").select("batch", "n", scalar.general(F.col("coa"), 3).alias("short"))


@query("general_format_all", "SELECT batch, n, printf('%.3g', coa) AS short FROM scan", (views.SCAN,))
def _(spark, sf):
    return views.scan(spark, sf).select("batch", "n", scalar.general(F.col("coa"), 3).alias("short"))


@query("scan_roundtrip", "SELECT batch, n, round_even(least(coa, 21474) * 1e5, 0) / 1e5 AS coa FROM scan", (views.SCAN,), ("coa",))
def _(spark, sf):
    return writers.dequantised(writers.quantised(views.scan(spark, sf))).select("batch", "n", "coa")


@query("catalogue_join", """SELECT o_orderkey AS event_id, count(*) AS n_picks, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS n_amps FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def _(spark, sf):
    events = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_totalprice").alias("coa"))
    rows = views.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.col("l_suppkey").cast("string").alias("station"), F.when(F.col("l_linenumber") % 2 == 1, "P").otherwise("S").alias("phase"), F.col("l_shipdate").alias("pick_time"), F.col("l_linestatus").alias("s"), F.col("l_extendedprice").alias("amp"))
    book = export.catalogue(events.dropDuplicates(["event_id"]), rows.drop("s", "amp"), rows.where("s = 'O'").select("event_id", "station", "amp"))
    return book.select("event_id", F.size("picks").cast("long").alias("n_picks"), F.size("amplitudes").cast("long").alias("n_amps"))


@query("nlloc_lines", """SELECT 'S' || rpad(CAST(l_suppkey % 20 AS VARCHAR), 5, ' ') || ' ?    ?    ? ' || rpad(CASE WHEN l_linenumber % 2 = 1 THEN 'P' ELSE 'S' END, 6, ' ') || ' ? ' || strftime(l_shipdate, '%Y%m%d') || ' ' || strftime(l_shipdate, '%H%M') || ' ' || printf('%7.4f', CAST(second(l_shipdate) AS DOUBLE)) || ' GAU ' || printf('%9.2e', l_tax + 0.01) || ' -1.00e+00 -1.00e+00 -1.00e+00 1.00e+00' AS line, count(*) AS n FROM lineitem GROUP BY 1""")
def _(spark, sf):
    rows = views.table(spark, sf, "lineitem").select(F.concat(F.lit("S"), (F.col("l_suppkey") % 20).cast("string")).alias("station"), F.when(F.col("l_linenumber") % 2 == 1, "P").otherwise("S").alias("phase"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("pick_us"), (F.col("l_tax") + 0.01).alias("pick_error_s"))
    return export.nlloc_lines(rows).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query("snuffler_lines", "SELECT 'XX.' || s_name || '. ' || CAST(s_suppkey AS VARCHAR) || ' ' || CAST(s_nationkey AS VARCHAR) || ' 0 0' AS line FROM supplier")
def _(spark, sf):
    rows = views.table(spark, sf, "supplier").select(F.lit("XX").alias("network"), F.col("s_name").alias("station"), F.col("s_suppkey").cast("string").alias("latitude"), F.col("s_nationkey").cast("string").alias("longitude"), F.lit("0").alias("elevation"))
    return export.snuffler_stations(rows)


@query("cut_waveforms", "SELECT event_id, s.batch, s.n, s.coa FROM scan s JOIN ev ON s.batch = ev.batch AND s.t_us BETWEEN ev.coa_us - 600000000 AND ev.coa_us + 600000000", (views.SCAN, CANDIDATES, REFINED), ("coa",))
def _(spark, sf):
    return export.cut(views.scan(spark, sf).select("batch", "n", "t_us", "coa"), _events(spark, sf), 600.0, 600.0).select("event_id", "batch", "n", "coa")


@query("trilinear_tt", "SELECT c_custkey, 2 * (c_custkey % 70) / 10.0 + 3 * (c_custkey % 60) / 10.0 AS tt FROM customer", (), ("tt",))
def _(spark, sf):
    table = views.nodes(spark).select("node", (2 * F.col("x") + 3 * F.col("y")).alias("tt"))
    points = views.table(spark, sf, "customer").select("c_custkey", ((F.col("c_custkey") % 70) / 10).alias("x"), ((F.col("c_custkey") % 60) / 10).alias("y"), F.lit(0.0).alias("z"))
    return grid.trilinear(points, table, views.GRID).select("c_custkey", "tt")


@query("filter_gain", """SELECT event_id, id, epi_dist, 1 / sqrt(1 + ((w * w - tan(pi() * 2 / 100) * tan(pi() * 16 / 100)) / ((tan(pi() * 16 / 100) - tan(pi() * 2 / 100)) * w)) ** 4) AS gain FROM (SELECT event_id, id, epi_dist, tan(pi() * (epi_dist / 2) / 100) AS w FROM obs WHERE epi_dist < 90)""", (views.OBSERVATIONS,), ("epi_dist", "gain"))
def _(spark, sf):
    rows = views.observations(spark, sf).where("epi_dist < 90").withColumn("freq", F.col("epi_dist") / 2)
    return magnitude.filter_gain(rows, 100.0, (2.0, 16.0, 2), out="gain").select("event_id", "id", "epi_dist", "gain")


# ---------------------------------------------------------------- rows only: numerical kernels


@query("response_removal")
def _(spark, sf):
    response = {"poles": [complex(-4.4, 4.4), complex(-4.4, -4.4)], "zeros": [0j, 0j], "gain": 1.0, "sensitivity": 1500.0}
    return signal.remove_response(views.trace_arrays(spark, sf), 50.0, response).select(*KEYS, F.posexplode("samples").alias("n", "value"))


@query("wood_anderson")
def _(spark, sf):
    return signal.simulate_wood_anderson(views.trace_arrays(spark, sf), 50.0, None, scalar.wood_anderson()).select(*KEYS, F.posexplode("samples").alias("n", "value"))


@query("gaussian_pick")
def _(spark, sf):
    runs = _peaks(spark, sf)
    arrays = _onsets(spark, sf).groupBy("station").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "onset"))), lambda x: x["onset"]).alias("all"))
    spans = _windows(spark, sf).select("station", "phase", "low_n", "high_n")
    start = F.greatest(F.col("first_n") - 1, F.lit(0))
    rows = runs.join(arrays, "station").join(spans, ["station", "phase"]).withColumn("start_n", start).withColumn("samples", F.expr("slice(all, cast(start_n as int) + 1, cast(last_n + 1 - start_n as int))")).drop("all")
    return picks.fit(rows, 4, 2.0).drop("samples")


@query("peak_to_trough_kernel")
def _(spark, sf):
    return magnitude.peak_to_trough_kernel(views.trace_arrays(spark, sf), 50.0).drop("samples")


def _station_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of four events: four spans of the stack."""
    return _cells(spark, sf).withColumn("event", F.floor(F.col("t") / 13).cast("long"))


@query("locations")
def _(spark, sf):
    return locate_plan.locate(_station_cells(spark, sf), "event", views.GRID)


@query("eikonal_tt")
def _(spark, sf):
    speeds = views.nodes(spark).select(F.lit("P").alias("phase"), "node", (F.lit(2.0) + F.col("x") / 10).alias("speed"))
    sites = views.stations(spark, sf).select(F.col("station").cast("string").alias("station"), "x", "y", F.lit(0.0).alias("z"))
    return grid.eikonal(speeds, sites, views.GRID)


@query("synthetic_traces")
def _(spark, sf):
    table = views.travel_times(spark, sf).where("node = 35").select(F.col("station").cast("string").alias("station"), "phase", "tt")
    return synthetic.traces(table, 50, 400, 1.0, 5.0)


from . import source_queries, stage_queries  # noqa: E402, F401  (they register more queries)
