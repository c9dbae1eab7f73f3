"""The three stages end to end as queries: a network of three-component stations, chunks, events, picks, magnitudes.

The view: three neighbouring vectors are the vertical, north and east channel of a station, one of eleven channels has
a gap; stations stand on a lattice above a grid of 6 x 6 x 4 nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Amplitude, Grid, Magnitude, Onset, Picker, Trigger
from ..functions import scalar
from ..operators import grid as grids
from ..operators import locate as ops
from ..operators import trigger as trig
from . import detect, locate, views
from . import trigger as trigger_plan
from .plugins import GaussianPicker, StaLta
from .queries import CANDIDATES, EVENT_DOUBLES, REFINED, TRIG, curve_sql, query

GRID = Grid((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (6, 6, 4))
METHOD = StaLta(Onset(windows={"P": (0.02, 0.1), "S": (0.02, 0.1)}))  # 2 and 6 samples
LENGTH, CHUNKS, BEFORE, AFTER = 16, 4, 6, 10
MARGINAL = 4
PICKER = Picker(threshold="mad", multiplier=1.0)
AMPLITUDE = Amplitude(signal_window=1.0, noise_window=4.0)
MAGNITUDE = Magnitude(noise_filter=0.5, use_hyp_dist=True)


def network(spark: SparkSession, sf: str) -> DataFrame:
    """(station, channel, n, value)."""
    rows = views.table(spark, sf, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("n", "value"))
    letter = F.substring(F.lit("ZNE"), (F.col("vec_id") % 3 + 1).cast("int"), F.lit(1))
    rows = rows.where("NOT (vec_id % 11 = 3 AND n = 30)")
    return rows.select(F.concat(F.lit("S"), F.floor(F.col("vec_id") / 3).cast("string")).alias("station"), F.concat(F.lit("HH"), letter).alias("channel"), "n", "value")


def sites(spark: SparkSession, sf: str) -> DataFrame:
    """(station, x, y, z)."""
    s = views.table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 3).alias("s")).distinct()
    return s.select(F.concat(F.lit("S"), F.col("s").cast("string")).alias("station"), (F.col("s") % 6).cast("double").alias("x"), (F.floor(F.col("s") / 6) % 6).cast("double").alias("y"), F.lit(-1.0).alias("z"))


def travel_times(spark: SparkSession, sf: str) -> DataFrame:
    return grids.homogeneous(grids.nodes(spark, GRID), sites(spark, sf), views.SPEEDS)


def events(spark: SparkSession) -> DataFrame:
    """(event, trigger_n): a trigger at every other sample; the last ones lack data."""
    return spark.range(14, 60, 2).select(F.col("id").alias("event"), F.col("id").alias("trigger_n"))


NET = """net AS (SELECT 'S' || (vec_id // 3) AS station, 'HH' || substr('ZNE', CAST(vec_id % 3 AS INT) + 1, 1) AS channel, n, value
  FROM (SELECT vec_id, unnest(range(len(embedding))) AS n, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings) WHERE NOT (vec_id % 11 = 3 AND n = 30)),
sites AS (SELECT DISTINCT 'S' || s AS station, CAST(s % 6 AS DOUBLE) AS x, CAST((s // 6) % 6 AS DOUBLE) AS y, -1.0::DOUBLE AS z FROM (SELECT vec_id // 3 AS s FROM embeddings)),
nodes AS (SELECT r AS node, CAST(r // 24 AS DOUBLE) AS x, CAST((r // 4) % 6 AS DOUBLE) AS y, CAST(r % 4 AS DOUBLE) AS z FROM (SELECT unnest(range(144)) AS r)),
lut AS (SELECT station, phase, node, sqrt((n.x - s.x) ** 2 + (n.y - s.y) ** 2 + (n.z - s.z) ** 2) / speed AS tt FROM nodes n, sites s, (VALUES ('P', 1.7), ('S', 1.0)) AS p(phase, speed)),
lutn AS (SELECT *, greatest(CAST(round_even(tt, 0) AS INT), 0) AS tt_n FROM lut)"""


def _onset_sql(spans: str, key: str, size: int) -> tuple[str, ...]:
    """Availability and onsets of spans (key, station, channel, n, value) of ``size`` samples."""
    return (
        f"spans AS ({spans})",
        f"""avail AS (SELECT {key}, station, phase, CAST(CASE WHEN bool_and(ok) AND count(*) = CASE phase WHEN 'P' THEN 1 ELSE 2 END THEN 1 ELSE 0 END AS INT) AS available
  FROM (SELECT {key}, station, CASE channel WHEN 'HHZ' THEN 'P' ELSE 'S' END AS phase, count(*) = {size} AND max(value) > min(value) AS ok FROM spans GROUP BY {key}, station, channel) GROUP BY {key}, station, phase)""",
        f"""ratio AS (SELECT {key}, station, channel, n, CASE WHEN r < 6 OR l < 2.2e-308 THEN 1.0 ELSE s / l END AS o FROM (SELECT *, row_number() OVER (PARTITION BY {key}, station, channel ORDER BY n) AS r,
  sum(value * value) OVER (PARTITION BY {key}, station, channel ORDER BY n ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) / 2 AS s, sum(value * value) OVER (PARTITION BY {key}, station, channel ORDER BY n ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) / 6 AS l FROM spans))""",
        f"""ons AS (SELECT {key}, station, phase, n, greatest(sqrt(avg(o * o)), 0.4) AS onset FROM ratio JOIN avail USING ({key}, station) WHERE available = 1 AND phase = CASE channel WHEN 'HHZ' THEN 'P' ELSE 'S' END GROUP BY {key}, station, phase, n)""",
        f"""cells AS (SELECT {key}, node, t, round(exp(s / available), 9) AS coa FROM (SELECT {key}, node, n - tt_n AS t, sum(ln(greatest(onset, 0.01))) AS s, count(*) AS c FROM ons JOIN lutn USING (station, phase) GROUP BY {key}, node, n - tt_n)
  JOIN (SELECT {key}, count(DISTINCT station || phase) AS available FROM ons GROUP BY {key}) USING ({key}) WHERE c = available)""",
        f"""top AS (SELECT {key}, t, max(coa) AS max_coa, max(coa) * count(*) / sum(coa) AS max_coa_n FROM cells GROUP BY {key}, t)""",
    )


DETECT = (NET, *_onset_sql(f"SELECT chunk, station, channel, n - {LENGTH} * chunk AS n, value FROM net, (SELECT unnest(range({CHUNKS})) AS chunk) WHERE n - {LENGTH} * chunk BETWEEN {-BEFORE} AND {LENGTH + AFTER - 1}", "chunk", LENGTH + BEFORE + AFTER))


def _detected(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return detect.detect_chunks(network(spark, sf), travel_times(spark, sf), METHOD, grids.nodes(spark, GRID), 1, LENGTH, CHUNKS, BEFORE, AFTER, digits=9)


@query("detect_chunks", f"""SELECT chunk, t, chunk * {LENGTH} + t AS n, coalesce(max_coa, 0) AS max_coa, coalesce(max_coa_n, 0) AS max_coa_n, coalesce(x, 0) AS x, coalesce(y, 0) AS y, coalesce(z, 0) AS z
FROM (SELECT unnest(range({CHUNKS})) AS chunk) CROSS JOIN (SELECT unnest(range({LENGTH})) AS t) LEFT JOIN (SELECT chunk, t, max_coa, max_coa_n, min(node) AS node FROM top JOIN cells USING (chunk, t) WHERE coa = max_coa GROUP BY ALL) USING (chunk, t) LEFT JOIN nodes USING (node)""", DETECT, ("max_coa", "max_coa_n"))
def _(spark, sf):
    return _detected(spark, sf)[0]


@query("detect_availability", "SELECT chunk, station, phase, available FROM avail", DETECT)
def _(spark, sf):
    return _detected(spark, sf)[1]


WINDOW = 4 * MARGINAL + BEFORE + AFTER + 1
LOCATE = (
    NET,
    "events AS (SELECT unnest(range(14, 60, 2)) AS event)",
    *_onset_sql(f"SELECT event, station, channel, n - event + {2 * MARGINAL} AS n, value FROM net, events WHERE n - event + {2 * MARGINAL} BETWEEN {-BEFORE} AND {4 * MARGINAL + AFTER}", "event", WINDOW),
    f"""otime AS (SELECT event, t AS otime_n, max_coa AS coa, max_coa_n AS coa_n FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY max_coa DESC, t) AS r FROM top WHERE t BETWEEN 0 AND {4 * MARGINAL}) WHERE r = 1 AND abs(t - {2 * MARGINAL}) < {MARGINAL})""",
    f"""maps AS (SELECT event, node, s / max(s) OVER (PARTITION BY event) AS c FROM (SELECT event, node, sum(coa) AS s FROM cells JOIN otime USING (event) WHERE t >= otime_n - {MARGINAL} AND t < otime_n + {MARGINAL} GROUP BY event, node))""".replace("sum(coa)", "sum(cells.coa)"),
    "best AS (SELECT event, min(node) AS node FROM (SELECT event, node, round(c, 7) AS c, max(round(c, 7)) OVER (PARTITION BY event) AS m FROM maps) WHERE c = m GROUP BY event)",
    "above AS (SELECT event, c, x, y, z FROM maps JOIN nodes USING (node) WHERE c > 0.9)",
    "means AS (SELECT event, sum(c * x) / sum(c) AS mx, sum(c * y) / sum(c) AS my, sum(c * z) / sum(c) AS mz FROM above GROUP BY event)",
    """cov AS (SELECT event, max(mx) AS cov_x, max(my) AS cov_y, max(mz) AS cov_z, sqrt(sum(c * (x - mx) ** 2) / sum(c)) AS err_x, sqrt(sum(c * (y - my) ** 2) / sum(c)) AS err_y, sqrt(sum(c * (z - mz) ** 2) / sum(c)) AS err_z,
  sum(c * (x - mx) * (y - my)) / sum(c) AS cov_xy, sum(c * (x - mx) * (z - mz)) / sum(c) AS cov_xz, sum(c * (y - my) * (z - mz)) / sum(c) AS cov_yz FROM above JOIN means USING (event) GROUP BY event)""",
)
_LOCATED = ("coa", "coa_n", "cov_x", "cov_y", "cov_z", "err_x", "err_y", "err_z", "err_xyz", "cov_xy", "cov_xz", "cov_yz")


def _located(spark: SparkSession, sf: str) -> locate.Located:
    return locate.locate_events(network(spark, sf), events(spark), travel_times(spark, sf), METHOD, GRID, 1, MARGINAL, BEFORE, AFTER, digits=9)


def _best(spark: SparkSession, located: locate.Located) -> DataFrame:
    top = ops.top_node(located.maps.withColumn("c", F.round("c", 7)), ["event"]).select("event", "node")
    return top.join(grids.nodes(spark, GRID).select("node", "x", "y", "z"), "node")


@query("locate_events", """SELECT event, otime_n, coa, coa_n, node, cov_x, cov_y, cov_z, err_x, err_y, err_z, (err_x * err_y * err_z) ** (1.0 / 3) AS err_xyz, cov_xy, cov_xz, cov_yz FROM otime JOIN best USING (event) JOIN cov USING (event)""", LOCATE, _LOCATED)
def _(spark, sf):
    located = _located(spark, sf)
    found = located.locations.select("event", "cov_x", "cov_y", "cov_z", "err_x", "err_y", "err_z", "err_xyz", "cov_xy", "cov_xz", "cov_yz")
    return located.events.join(_best(spark, located).select("event", "node"), "event").join(found, "event")


@query("locate_maps", "SELECT event, node, c FROM maps", LOCATE, ("c",))
def _(spark, sf):
    return _located(spark, sf).maps


@query("locate_spline_gaussian")
def _(spark, sf):
    names = [f"{a}_{b}" for a in ("spline", "gau", "gau_err") for b in "xyz"]
    return _located(spark, sf).locations.select("event", *names)


PICKS = (
    *LOCATE,
    f"""arr AS (SELECT event, station, phase, CASE phase WHEN 'P' THEN 0 ELSE 1 END AS phase_index, tt, otime_n + {BEFORE} + CAST(round_even(tt, 0) AS BIGINT) AS arrival_n FROM otime JOIN best USING (event) JOIN lut USING (node) WHERE (event, station, phase) IN (SELECT (event, station, phase) FROM ons))""",
    f"""win AS (SELECT event, station, phase, arrival_n, CAST(greatest(0, coalesce(greatest(l, mb), l)) AS BIGINT) AS low_n, CAST(least({WINDOW}, coalesce(least(h, mn), h)) AS BIGINT) AS high_n FROM (
  SELECT *, arrival_n - CAST(round_even(tt * 0.1 + 2.0, 0) AS BIGINT) AS l, arrival_n + CAST(round_even(tt * 0.1 + 2.0, 0) AS BIGINT) AS h,
    floor((arrival_n + lead(arrival_n) OVER w) / 2) AS mn, floor((lag(arrival_n) OVER w + arrival_n) / 2) AS mb FROM arr WINDOW w AS (PARTITION BY event, station ORDER BY phase_index)))""",
    f"own AS (SELECT event, station, phase, n + {BEFORE} AS n, onset FROM ons SEMI JOIN otime USING (event))",
    "noise AS (SELECT event, station, phase, onset FROM own o WHERE onset > 1 AND NOT EXISTS (SELECT 1 FROM win w WHERE w.event = o.event AND w.station = o.station AND o.n BETWEEN low_n AND high_n))",
    "thr AS (SELECT event, station, phase, max(m) + 1.4826 * median(abs(onset - m)) AS threshold FROM (SELECT *, median(onset) OVER (PARTITION BY event, station, phase) AS m FROM noise) GROUP BY event, station, phase)",
    "inw AS (SELECT own.event, own.station, own.phase, n, onset, threshold FROM own JOIN win USING (event, station, phase) JOIN thr USING (event, station, phase) WHERE n >= low_n AND n < high_n)",
    "peaks AS (SELECT event, station, phase, n AS peak_n, onset AS peak FROM (SELECT *, row_number() OVER (PARTITION BY event, station, phase ORDER BY onset DESC, n) AS r FROM inw) WHERE r = 1)",
    """runs AS (SELECT event, station, phase, first_n, last_n, peak_n, peak FROM (SELECT event, station, phase, min(n) AS first_n, max(n) AS last_n FROM (SELECT *, n - row_number() OVER (PARTITION BY event, station, phase ORDER BY n) AS g FROM inw WHERE onset > threshold) GROUP BY event, station, phase, g)
  JOIN peaks USING (event, station, phase) WHERE peak_n BETWEEN first_n AND last_n AND last_n > first_n)""",
    "picks AS (SELECT event, station, phase, arrival_n, low_n, high_n, threshold, first_n, last_n, peak_n, peak FROM win LEFT JOIN thr USING (event, station, phase) LEFT JOIN runs USING (event, station, phase))",
)


def _picked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    located = _located(spark, sf)
    places = _best(spark, located)
    return locate.pick_events(located, places, travel_times(spark, sf), GaussianPicker(PICKER), GRID, 1, BEFORE, WINDOW, 2.0), places


@query("pick_events", "SELECT * FROM picks", PICKS, ("threshold", "peak"))
def _(spark, sf):
    return _picked(spark, sf)[0].drop("pick_n", "pick_error_s", "pick_height", "residual")


@query("pick_fits")
def _(spark, sf):
    return _picked(spark, sf)[0].select("event", "station", "phase", "pick_n", "pick_error_s", "pick_height", "residual").where("pick_n IS NOT NULL")


def _amplitudes(spark: SparkSession, sf: str) -> DataFrame:
    picks, places = _picked(spark, sf)
    rows = network(spark, sf).join(events(spark).join(places.select("event"), "event", "left_semi"))
    rows = rows.select("event", "station", "channel", (F.col("n") - F.col("trigger_n") + 2 * MARGINAL + BEFORE).alias("n"), "value").where((F.col("n") >= 0) & (F.col("n") < WINDOW))
    times = picks.select("event", "station", "phase", F.col("peak_n").cast("double").alias("pick_s"), F.col("arrival_n").cast("double").alias("modelled_s"))
    return locate.event_amplitudes(rows, times, places, sites(spark, sf), travel_times(spark, sf), AMPLITUDE, GRID, 1, 1.0, 0.1)


def _measured(phase: str) -> str:
    """Largest difference of neighbouring turning points of each trace in the window of a phase."""
    p = phase.lower()
    return f"""{p}t AS (SELECT * FROM (SELECT s.event, s.station, channel, n, value, lag(value) OVER w AS b, lead(value) OVER w AS a FROM smp s JOIN aw USING (event, station) WHERE p < s0 AND n BETWEEN ceil({p}_start) AND floor({p}_end) WINDOW w AS (PARTITION BY s.event, s.station, channel ORDER BY n)) WHERE (value > b AND value > a) OR (value < b AND value < a)),
{p}a AS (SELECT event, station, channel, d * 1000 / 2 AS {phase}_amp, 1.0 / (2 * (m - n)) AS {phase}_freq FROM (SELECT *, row_number() OVER (PARTITION BY event, station, channel ORDER BY d DESC, n) AS r FROM (SELECT event, station, channel, n, abs(lead(value) OVER w - value) AS d, lead(n) OVER w AS m FROM {p}t WINDOW w AS (PARTITION BY event, station, channel ORDER BY n)) WHERE d IS NOT NULL) WHERE r = 1)"""


AMPLITUDES = (
    *PICKS,
    f"smp AS (SELECT event, station, channel, n - event + {2 * MARGINAL + BEFORE} AS n, value FROM net, events SEMI JOIN otime USING (event) WHERE n - event + {2 * MARGINAL + BEFORE} BETWEEN 0 AND {WINDOW - 1})",
    """tm AS (SELECT event, station, CASE WHEN np = 2 THEN coalesce(pp, pm) ELSE pm END AS p, CASE WHEN np = 2 THEN coalesce(sp, sm) ELSE sm END AS s0, np = 2 AND (pp IS NOT NULL OR sp IS NOT NULL) AS is_picked FROM (
  SELECT event, station, max(peak_n) FILTER (phase = 'P') AS pp, max(arrival_n) FILTER (phase = 'P') AS pm, max(peak_n) FILTER (phase = 'S') AS sp, max(arrival_n) FILTER (phase = 'S') AS sm, count(DISTINCT phase) AS np FROM picks GROUP BY event, station))""",
    """aw AS (SELECT *, p - 1 - pt * 0.1 AS p_start, CASE WHEN s1 < p1 THEN p1 + (s1 - p1) / 2 WHEN s1 - p1 < 1 THEN s1 ELSE p1 + 1 END AS p_end, CASE WHEN s1 < p1 THEN p1 + (s1 - p1) / 2 ELSE s1 END AS s_start, s2 AS s_end FROM (
  SELECT *, p + 1 + pt * 0.1 AS p1, s0 - 1 - st * 0.1 AS s1, s0 + 1 + st * 0.1 + 1 AS s2 FROM tm JOIN (SELECT event, station, max(tt) FILTER (phase = 'P') AS pt, max(tt) FILTER (phase = 'S') AS st FROM best JOIN lut USING (node) GROUP BY event, station) USING (event, station)))""",
    _measured("P"), _measured("S"),
    """nz AS (SELECT event, station, channel, CASE WHEN max(value) > min(value) THEN sqrt(avg(d * d)) * 1000 END AS noise_amp FROM (SELECT s.event, s.station, channel, value, value - avg(value) OVER w - coalesce(regr_slope(value, n) OVER w, 0) * (n - avg(n) OVER w) AS d
  FROM smp s JOIN aw USING (event, station) WHERE p < s0 AND n BETWEEN ceil(p_start - 4) AND floor(p_start) WINDOW w AS (PARTITION BY s.event, s.station, channel)) GROUP BY event, station, channel)""",
    """amps AS (SELECT event, station, channel, P_amp, P_freq, S_amp, S_freq, noise_amp, sqrt((b.x - s.x) ** 2 + (b.y - s.y) ** 2) AS epi_dist, abs(b.z - s.z) AS z_dist, is_picked
  FROM (SELECT DISTINCT event, station, channel FROM smp) LEFT JOIN pa USING (event, station, channel) LEFT JOIN sa USING (event, station, channel) LEFT JOIN nz USING (event, station, channel)
  JOIN (SELECT event, x, y, z FROM best JOIN nodes USING (node)) b USING (event) JOIN sites s USING (station) LEFT JOIN tm USING (event, station))""",
)


@query("event_amplitudes", "SELECT * FROM amps", AMPLITUDES, ("P_amp", "P_freq", "S_amp", "S_freq", "noise_amp", "epi_dist", "z_dist"))
def _(spark, sf):
    return _amplitudes(spark, sf)


@query("event_magnitudes", f"""SELECT event, ml, ml_err, n_obs, r2 FROM (SELECT DISTINCT event FROM amps) LEFT JOIN (
  SELECT event, max(mean) AS ml, CASE WHEN count(*) = 1 THEN max(ml_err) ELSE sqrt(avg((ml - mean) ** 2)) END AS ml_err, count(*) AS n_obs,
    CASE WHEN count(*) >= 2 AND max(y) <> min(y) THEN (sum((y - ya) ** 2) - sum((y - (mean - att)) ** 2)) / nullif(sum((y - ya) ** 2), 0) END AS r2
  FROM (SELECT *, avg(ml) OVER (PARTITION BY event) AS mean, avg(y) OVER (PARTITION BY event) AS ya FROM (
    SELECT event, log10(S_amp) AS y, {curve_sql("Hutton-Boore")} AS att, log10(S_amp) + ({curve_sql("Hutton-Boore")}) AS ml, CASE WHEN S_amp > noise_amp THEN log10(S_amp + noise_amp) - log10(S_amp - noise_amp) END AS ml_err
    FROM (SELECT *, nullif(sqrt(epi_dist ** 2 + z_dist ** 2), 0) AS d FROM amps) WHERE S_amp > 0 AND S_amp >= noise_amp AND S_amp > noise_amp * 0.5 AND d IS NOT NULL)) GROUP BY event) USING (event)""", AMPLITUDES, ("ml", "ml_err", "r2"))
def _(spark, sf):
    return locate.event_magnitudes(_amplitudes(spark, sf), MAGNITUDE)


# ---------------------------------------------------------------- trigger

NORM = Trigger(method="static", threshold=1.5, on="coa_n", marginal=300.0, interval=900.0)


@query("candidates_normalised", "SELECT batch, first_us, last_us, coa_us, trig_coa, coa_x, coa_y, coa_z, coa, coa_norm FROM cand", (views.SCAN, CANDIDATES.replace("WHERE coa >= 300", "WHERE coa_n >= 1.5").replace("coa AS trig_coa", "coa_n AS trig_coa")), EVENT_DOUBLES)
def _(spark, sf):
    return trig.candidates(trig.threshold(views.scan(spark, sf), NORM, 1.0), NORM).drop("island", "min_us", "max_us")


@query("trigger_days", """SELECT batch, event_id, coa_us, trig_coa, coa_x, coa_y, coa_z, coa, coa_norm FROM ev WHERE coa_us BETWEEN greatest(epoch_us(batch), 1704412800000000) AND least(epoch_us(batch) + 86400000000, 1705276800000000) - 1""", (
    views.SCAN.replace("scan AS (SELECT batch", "scan0n AS (SELECT batch"),
    """scan AS (SELECT batch, row_number() OVER (PARTITION BY batch ORDER BY t_us, n) - 1 AS n, t_us, coa, coa_n, x, y, z FROM (
  SELECT day AS batch, s.n, s.t_us, coa, coa_n, x, y, z FROM (SELECT unnest(generate_series(DATE '2024-01-05', DATE '2024-01-14', INTERVAL 1 DAY))::DATE AS day) JOIN scan0n s ON s.t_us BETWEEN greatest(epoch_us(day), 1704412800000000) - 120000000 AND least(epoch_us(day) + 86400000000, 1705276800000000) + 120000000))""",
    CANDIDATES, REFINED), EVENT_DOUBLES)
def _(spark, sf):
    scan = views.scan(spark, sf)
    found = trigger_plan.trigger_days(scan, TRIG, 1.0, 1704412800000000, 1705276800000000)
    return found.select("batch", "event_id", "coa_us", "trig_coa", "coa_x", "coa_y", "coa_z", "coa", "coa_norm")


# ---------------------------------------------------------------- travel times


@query("max_extent", """SELECT least(min(s.x), -0.5) - 0.05 * (greatest(max(s.x), 5.5) - least(min(s.x), -0.5)) AS x_low, greatest(max(s.x), 5.5) + 0.05 * (greatest(max(s.x), 5.5) - least(min(s.x), -0.5)) AS x_high,
  least(min(s.y), -0.5) - 0.05 * (greatest(max(s.y), 5.5) - least(min(s.y), -0.5)) AS y_low, greatest(max(s.y), 5.5) + 0.05 * (greatest(max(s.y), 5.5) - least(min(s.y), -0.5)) AS y_high,
  least(min(s.z), -0.5) - 0.05 * (greatest(max(s.z), 3.5) - least(min(s.z), -0.5)) AS z_low, greatest(max(s.z), 3.5) + 0.05 * (greatest(max(s.z), 3.5) - least(min(s.z), -0.5)) AS z_high FROM sites s""", (NET,), ("x_low", "x_high", "y_low", "y_high", "z_low", "z_high"))
def _(spark, sf):
    return grids.max_extent(sites(spark, sf), GRID)


@query("travel_time_methods", "SELECT station, phase, node, tt, 'homogeneous' AS method FROM lut WHERE phase = 'P'", (NET,), ("tt",))
def _(spark, sf):
    table = grids.travel_times(spark, GRID, sites(spark, sf), "homogeneous", ("P",), speeds=views.SPEEDS)
    return table.withColumn("method", F.lit("homogeneous"))


@query("gaussian_3d", """SELECT node, exp(-((x - 2) ** 2 / 2 + (y - 3) ** 2 / 4.5 + (z - 1) ** 2 / 8)) * 2.5 AS value FROM nodes""", (NET,), ("value",))
def _(spark, sf):
    return grids.nodes(spark, GRID).select("node", scalar.gaussian_3d([F.col(c) for c in "xyz"], 2.5, (2.0, 3.0, 1.0), (1.0, 1.5, 2.0)).alias("value"))
