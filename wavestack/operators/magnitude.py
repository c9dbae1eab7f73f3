"""Amplitudes and local magnitudes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Amplitude, Magnitude
from ..functions import kernels
from ..functions.scalar import attenuation, hypocentral
from .signal import detrend, map_traces


def amplitude_windows(picks: DataFrame, marginal: float, fraction_tt: float, signal_window: float) -> DataFrame:
    """P and S measurement windows in seconds, from (p_time, s_time, p_tt, s_tt).

    Overlapping windows are split half way; a gap shorter than ``signal_window`` is closed at the S
    start; else P runs on by ``signal_window``. ``order_ok`` is false where P is not before S.
    """
    p, s = F.col("p_time"), F.col("s_time")
    p0, p1 = p - marginal - F.col("p_tt") * fraction_tt, p + marginal + F.col("p_tt") * fraction_tt
    s0, s1 = s - marginal - F.col("s_tt") * fraction_tt, s + marginal + F.col("s_tt") * fraction_tt + signal_window
    middle = p1 + (s0 - p1) / 2
    overlap, close = s0 < p1, s0 - p1 < signal_window
    return picks.withColumns({
        "p_start": p0, "p_end": F.when(overlap, middle).when(close, s0).otherwise(p1 + signal_window),
        "s_start": F.when(overlap, middle).otherwise(s0), "s_end": s1, "order_ok": p < s,
    })


def windowed(samples: DataFrame, spans: DataFrame, keys: list[str], bucket: int, low: str = "low_n", high: str = "high_n") -> DataFrame:
    """Samples within spans by an equi-join on (keys, n / bucket) and a residual range filter."""
    wide = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col(low) / bucket).cast("long"), F.floor(F.col(high) / bucket).cast("long"))))
    return samples.withColumn("_b", F.floor(F.col("n") / bucket).cast("long")).join(wide, [*keys, "_b"]).where(F.col("n").between(F.col(low), F.col(high))).drop("_b")


def noise_amplitude(samples: DataFrame, keys: list[str], measure: str = "RMS", value: str = "value") -> DataFrame:
    """Noise in mm for samples (keys..., n, value) in m, each window less its least-squares line; null for a flat window.

    RMS, STD (of the population) or ENV, the mean of the window's envelope.
    """
    flat = samples.groupBy(*keys).agg((F.max(value) == F.min(value)).alias("_flat"))
    if measure == "ENV":
        arrays = samples.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.col(value).alias("v")))), lambda x: x["v"]).alias("noise_amp"))
        arrays = map_traces(arrays, lambda x: kernels.envelope(kernels.detrend(x)).mean(-1, keepdims=True), "noise_amp")
        noise = arrays.withColumn("noise_amp", F.get("noise_amp", F.lit(0)) * 1000)
    else:
        body = {"RMS": F.sqrt(F.avg(F.col(value) * F.col(value))), "STD": F.stddev_pop(value)}[measure]
        noise = detrend(samples, keys, value).groupBy(*keys).agg((body * 1000).alias("noise_amp"))
    return noise.join(flat, keys).select(*keys, F.when(~F.col("_flat"), F.col("noise_amp")).alias("noise_amp"))


def peak_to_trough(samples: DataFrame, keys: list[str], rate: float, value: str = "value") -> DataFrame:
    """Largest difference of neighbouring extrema of each window: amp (half, in mm), freq, time (samples).

    Native form without a prominence bound: strict turning points only, so the flat tops of clipped
    traces do not count; ``peak_to_trough_kernel`` treats those and prominence.
    """
    w = Window.partitionBy(*keys).orderBy("n")
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    v = F.col(value)
    turn = ((v > before) & (v > after)) | ((v < before) & (v < after))
    marked = samples.withColumn("_t", turn).where("_t")
    pairs = marked.withColumn("_d", F.abs(F.lead(value).over(w) - v)).withColumn("_n", F.lead("n").over(w)).where("_d IS NOT NULL")
    best = pairs.groupBy(*keys).agg(F.min(F.struct((-F.col("_d")).alias("d"), "n", "_n")).alias("b"))
    return best.select(*keys, (-F.col("b.d") * 1000 / 2).alias("amp"), (F.lit(float(rate)) / (2 * (F.col("b._n") - F.col("b.n")))).alias("freq"), ((F.col("b.n") + F.col("b._n")) / 2).alias("time_n"))


def peak_to_trough_kernel(traces: DataFrame, rate: float, prominence: float = 0.0, samples: str = "samples") -> DataFrame:
    """Adds amp, freq and time_s per array row; null where extrema do not alternate."""
    at = traces.columns.index(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [kernels.peak_to_trough(np.array(x.as_py(), dtype=float), rate, prominence) if x.is_valid and len(x) else None for x in batch.column(at)]
            more = [pa.array([g[i] if g else None for g in got], pa.float64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "amp", "freq", "time_s"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in traces.schema.fields)
    return traces.mapInArrow(run, f"{fields}, amp double, freq double, time_s double")


def picks_or_modelled(picks: DataFrame, keys: list[str]) -> DataFrame:
    """P and S time per station: the picks if both phases have onsets, a modelled time for each missing pick.

    ``picks`` has keys, phase, pick_us (null if none), modelled_us and has_onset.
    """
    def of(phase: str, column: str) -> Column:
        return F.max(F.when(F.col("phase") == phase, F.col(column)))

    wide = picks.groupBy(*keys).agg(*[of(p, c).alias(f"{p}_{c}") for p in ("P", "S") for c in ("pick_us", "modelled_us")], F.min(F.col("has_onset").cast("int")).alias("_both"), F.count_distinct("phase").alias("_n"))
    both = (F.col("_both") == 1) & (F.col("_n") == 2)
    time = lambda p: F.when(both, F.coalesce(f"{p}_pick_us", f"{p}_modelled_us")).otherwise(F.col(f"{p}_modelled_us"))
    picked = both & (F.col("P_pick_us").isNotNull() | F.col("S_pick_us").isNotNull())
    return wide.select(*keys, time("P").alias("p_us"), time("S").alias("s_us"), picked.alias("is_picked"))


def distances(rows: DataFrame, config: Magnitude) -> DataFrame:
    """Epicentral or hypocentral distance; zero is null."""
    value = hypocentral(F.col("epi_dist"), F.col("z_dist")) if config.use_hyp_dist else F.nullif(F.col("epi_dist"), F.lit(0.0))
    return rows.withColumn("dist", value)


def channel_magnitudes(rows: DataFrame, config: Magnitude, event: str = "event_id", gain: str | None = "filter_gain") -> DataFrame:
    """ml and ml_err of each observation (id, amp, noise_amp, dist, gain).

    Noise is divided by the filter gain unless the event has none. ml_err is the full width between
    amplitude plus and minus noise. No value where the amplitude is 0, missing or below the noise.
    """
    corrections = F.lit(0.0)
    if config.station_corrections:
        table = F.create_map(*[F.lit(x) for kv in config.station_corrections.items() for x in kv])
        corrections = F.coalesce(F.element_at(table, F.col("id")), F.lit(0.0))
    noise = F.col("noise_amp")
    if gain:
        any_gain = F.max(F.col(gain).isNotNull()).over(Window.partitionBy(event))
        noise = F.when(any_gain, F.try_divide(noise, F.col(gain))).otherwise(noise)
    amp = F.col("amp") * config.amp_multiplier
    good = (F.col("amp") > 0) & (F.col("amp") >= noise)
    high, low = F.log10(F.col("amp") + noise), F.log10(F.nullif(F.col("amp") - noise, F.lit(0.0)))
    return rows.withColumns({
        "station_correction": corrections,
        "ml": F.when(good, F.log10(amp) + attenuation(F.col("dist"), config.attenuation) + corrections),
        "ml_err": F.when(good, F.coalesce(high - low, F.lit(float("inf")))),
    })


def filters(rows: DataFrame, config: Magnitude) -> DataFrame:
    """Filter flags of each observation and ``used``, their conjunction; rows without amplitude or noise go."""
    rows = rows.where(F.col("amp").isNotNull() & F.col("noise_amp").isNotNull())
    flags: dict[str, Column] = {}
    if config.noise_filter:
        flags["noise_ok"] = F.col("amp") > F.col("noise_amp") * config.noise_filter
    if config.trace_filter:
        flags["trace_ok"] = F.col("id").rlike(config.trace_filter)
    if config.station_filter:
        keep = F.lit(True)
        for name in config.station_filter:
            keep = keep & (F.instr("id", f".{name}.") == 0)
        flags["station_ok"] = keep
    if config.dist_filter is not None:
        flags["dist_ok"] = F.col("dist") <= config.dist_filter
    if config.pick_filter:
        flags["picked_ok"] = F.col("is_picked")
    used = F.lit(True)
    for f in flags.values():
        used = used & F.coalesce(f, F.lit(False))
    return rows.withColumns(flags | {"used": used & F.col("ml").isNotNull()})


def network(rows: DataFrame, event: str = "event_id", weighted: bool = False) -> DataFrame:
    """(event, ml, ml_err, n_obs): the mean over used observations and its error.

    Weights are 1 or 1 / ml_err squared and stand inside the squared difference of the error; a single
    observation has its own error.
    """
    used = rows.where("used")
    weight = F.try_divide(F.lit(1.0), F.col("ml_err") * F.col("ml_err")) if weighted else F.lit(1.0)
    used = used.withColumn("_w", weight)
    mean = used.groupBy(event).agg((F.sum(F.col("ml") * F.col("_w")) / F.sum("_w")).alias("_mean"))
    off = (F.col("ml") - F.col("_mean")) * F.col("_w")
    out = used.join(mean, event).groupBy(event).agg(F.max("_mean").alias("ml"), F.sqrt(F.sum(off * off) / F.sum("_w")).alias("_e"), F.max("ml_err").alias("_own"), F.count(F.lit(1)).alias("n_obs"))
    return out.select(event, "ml", F.when(F.col("n_obs") == 1, F.col("_own")).otherwise(F.col("_e")).alias("ml_err"), "n_obs")


def fit_quality(rows: DataFrame, means: DataFrame, config: Magnitude, event: str = "event_id") -> DataFrame:
    """(event, r2) of log10 amplitude against the curve of the network magnitude; null below two values."""
    used = rows.where("used").join(means.select(event, F.col("ml").alias("_mean")), event)
    seen = F.log10(F.col("amp") * config.amp_multiplier * F.pow(F.lit(10.0), F.col("station_correction")))
    model = F.col("_mean") - attenuation(F.col("dist"), config.attenuation)
    w = Window.partitionBy(event)
    rows2 = used.withColumn("_y", seen).withColumn("_m", model).withColumn("_avg", F.avg("_y").over(w))
    square = lambda a, b: F.sum(F.pow(F.col(a) - F.col(b), 2))
    out = rows2.groupBy(event).agg(F.count(F.lit(1)).alias("n"), square("_y", "_avg").alias("total"), square("_y", "_m").alias("rest"), (F.max("_y") == F.min("_y")).alias("same"))
    return out.select(event, F.when((F.col("n") >= 2) & ~F.col("same"), F.try_divide(F.col("total") - F.col("rest"), F.col("total"))).alias("r2"))


def filter_gain(rows: DataFrame, rate: float, band: tuple[float | None, float | None, int], frequency: str = "freq", out: str = "filter_gain") -> DataFrame:
    """Gain of a causal Butterworth filter at each measured frequency: (low, high, corners), an open end for high- or low-pass.

    Closed form of the bilinear transform: prewarped frequencies give the analogue prototype's gain.
    """
    import math

    low, high, corners = band
    warp = lambda f: math.tan(math.pi * f / rate)
    w = F.tan(F.lit(math.pi) * F.col(frequency) / rate)
    if low and high:
        wide, centre = warp(high) - warp(low), warp(high) * warp(low)
        x = (w * w - centre) / (wide * w)
    elif low:
        x = F.lit(warp(low)) / w
    else:
        x = w / warp(high)
    return rows.withColumn(out, 1 / F.sqrt(1 + F.pow(x, F.lit(2 * corners))))


def amplitude_band(config: Amplitude, rate: float) -> tuple[float | None, float | None, int] | None:
    """The filter that amplitudes are measured on: the band-pass, or a high-pass where its upper corner is not below Nyquist."""
    if config.bandpass:
        low, high, corners = config.bandpass
        return (low, high if high < rate / 2 else None, corners)
    return (config.highpass[0], None, config.highpass[1]) if config.highpass else None


def filter_traces(traces: DataFrame, rate: float, config: Amplitude, samples: str = "samples") -> DataFrame:
    """Detrended, tapered and causally filtered traces, or the traces as they are without a filter."""
    band = amplitude_band(config, rate)
    if band is None:
        return traces
    low, high, corners = band
    sections = kernels.butterworth(corners, low, high, rate)
    return map_traces(traces, lambda x: kernels.sos_filter(sections, kernels.detrend(x) * kernels.cosine_taper(x.shape[-1])), samples)


def highest(rows: DataFrame, event: str = "event_id", ident: str = "id") -> DataFrame:
    """(event, station, id, amp): the channel of largest amplitude of each station, the first by name on ties."""
    best = F.min(F.struct((-F.col("amp")).alias("v"), F.col(ident).alias("id"), "amp"))
    out = rows.withColumn("station", F.split(F.col(ident), r"\.")[1]).groupBy(event, "station").agg(best.alias("b"))
    return out.select(event, "station", "b.id", "b.amp")
