"""Runs from archive to files: detect writes the scan series, trigger its events, locate what is known of each event.

Each run is one job for the whole span; it reads what the one before has written. Times are microseconds since the
epoch, sample numbers count from it too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Amplitude, Grid, Magnitude, Picker, Trigger
from ..errors import ConfigError
from ..functions import scalar
from ..operators import grid as grids
from ..operators import magnitude
from ..session import passing, staged
from ..sources import readers, writers
from . import detect, locate
from . import trigger as triggers
from .plugins import GaussianPicker, StaLta


@dataclass(frozen=True)
class Run:
    """Where a run reads and writes, and how it makes onsets."""

    archive: str
    lut: str
    out: str
    method: StaLta

    @property
    def rate(self) -> int:
        return int(self.method.config.rate)

    def lookup(self, spark: SparkSession) -> tuple[DataFrame, Grid, float]:
        """(travel times, their grid, the longest of them)."""
        table, grid = readers.read_lut(spark, self.lut)
        return table, grid, table.agg(F.max("tt")).first()[0]

    def pads(self, timespan: float, longest: float) -> tuple[int, int]:
        """Samples before and after a span, grown so that tapers and windows spoil only the pads."""
        config = self.method.config
        pre, post = scalar.padded_span(timespan, config.pre_pad, config.post_pad(longest), self.rate, config.taper)
        return round(pre * self.rate), round(post * self.rate)


def run_detect(spark: SparkSession, run: Run, start_us: int, end_us: int, timestep: float) -> None:
    """Coalescence through time in chunks of ``timestep`` seconds: ``scan`` by day, and ``availability`` by chunk.

    The last chunk is whole even if the span ends within it; a span that ends at a midnight does not reach it.
    """
    if start_us > end_us:
        raise ConfigError("the span ends before it starts")
    with passing(spark):
        table, grid, longest = run.lookup(spark)
        rate, length = run.rate, round(timestep * run.rate)
        end_us -= (end_us % 86_400_000_000 == 0) * round(1e6 / rate)
        chunks = max(1, -(-(end_us - start_us) * rate // (length * 1_000_000)))
        before, after = run.pads(timestep, longest)
        first = round(start_us * rate / 1e6)
        low, high = (first - before) / rate, (first + chunks * length + after) / rate
        traces = readers.read_waveforms(spark, run.archive, round(low * 1e6), round(high * 1e6), rate, 1 / rate, 1 / rate).withColumn("n", F.col("n") - first)
        series, availability = detect.detect_chunks(traces, table, run.method, grids.nodes(spark, grid), rate, length, chunks, before, after)
        time = F.rint((F.col("n") + first) * 1e6 / rate).cast("long")
        scan = series.select(F.to_date(F.timestamp_micros(time)).alias("batch"), (F.col("n") + first).alias("n"), time.alias("t_us"), F.col("max_coa").alias("coa"), F.col("max_coa_n").alias("coa_n"), "x", "y", "z")
        writers.write_scan(scan, f"{run.out}/scan")
        step = F.timestamp_micros(F.lit(start_us) + F.col("chunk") * round(timestep * 1e6))
        writers.write_table(availability.select(step.alias("step"), F.concat_ws("_", "station", "phase").alias("name"), "available"), f"{run.out}/availability")


def run_trigger(spark: SparkSession, run: Run, config: Trigger, start_us: int, end_us: int, region: tuple[float, ...] | None = None) -> None:
    """Events of the scan series, day by day: ``triggered`` as CSV."""
    scan = readers.read_scan(spark, f"{run.out}/scan", start_us, end_us, config.pad)
    events = triggers.trigger_days(scan, config, run.rate, start_us, end_us, region)
    writers.write_csv(writers.triggered_rows(events), f"{run.out}/triggered")


def run_locate(spark: SparkSession, run: Run, sites: DataFrame, marginal: float, start_us: int | None = None, end_us: int | None = None, picker: Picker = Picker(), amplitude: Amplitude | None = None, mags: Magnitude | None = None, fraction: float = 0.1, instrument: dict | None = None, response: dict | None = None) -> None:
    """Triggered events to ``events``, ``picks`` and, with settings for them, ``amplitudes`` and magnitudes, as CSV.

    ``sites`` is (station, x, y, z) in the grid's units (km for magnitudes). ``marginal`` and pads are seconds.
    """
    with passing(spark):
        table, grid, longest = run.lookup(spark)
        rate = run.rate
        half = round(marginal * rate)
        before, after = run.pads(4 * marginal, longest)
        found = readers.read_triggered(spark, f"{run.out}/triggered", start_us, end_us)
        events = staged(found.select(F.col("coa_us").alias("event"), F.rint(F.col("coa_us") * rate / 1e6).cast("long").alias("trigger_n"), F.col("EventID").alias("event_id"), F.col("TRIG_COA").cast("double").alias("trig_coa"), F.col("COA").cast("double").alias("det_coa"), F.col("COA_NORM").cast("double").alias("det_coa_norm")), "triggered")
        span = events.agg(F.min("trigger_n").alias("low"), F.max("trigger_n").alias("high")).first()
        low, high = span["low"] - 2 * half - before, span["high"] + 2 * half + after
        traces = readers.read_waveforms(spark, run.archive, round(low * 1e6 / rate), round(high * 1e6 / rate), rate, 1 / rate, 1 / rate)
        located = locate.locate_events(traces, events, table, run.method, grid, rate, half, before, after)
        places = located.locations.select("event", F.col("spline_x").alias("x"), F.col("spline_y").alias("y"), F.col("spline_z").alias("z"))
        samples = 4 * half + before + after + 1
        method = GaussianPicker(picker)
        picks = locate.pick_events(located, places, table, method, grid, rate, before, samples, run.method.halfwidth("P"))
        start = events.select("event", "event_id", (F.col("trigger_n") - 2 * half - before).alias("start_n"))  # of the pad
        us = lambda n: F.rint((F.col("start_n") + n) * 1e6 / rate).cast("long")
        timed = picks.join(start, "event")
        pick_rows = timed.select("event_id", "station", "phase", us(F.col("arrival_n")).alias("modelled_us"), us(F.col("pick_n")).alias("pick_us"), F.col("pick_error_s").alias("pick_error"), F.col("pick_height").alias("snr"), "residual")
        writers.write_csv(writers.pick_rows(pick_rows), f"{run.out}/picks")
        rows = located.events.join(events, "event").join(located.locations, "event")
        rows = rows.withColumn("otime_us", F.rint((F.col("trigger_n") - 2 * half + F.col("otime_n")) * 1e6 / rate).cast("long")).withColumnsRenamed({"coa_n": "coa_norm", "det_coa": "dec_coa", "det_coa_norm": "dec_coa_norm"})
        if amplitude and mags:
            spans = start.select("event", F.col("start_n").alias("low_n"), (F.col("start_n") + samples).alias("high_n"))
            near = magnitude.windowed(traces, spans, [], samples).select("event", "station", "channel", (F.col("n") - F.col("low_n")).alias("n"), "value")
            times = picks.select("event", "station", "phase", (F.col("pick_n") / rate).alias("pick_s"), (F.col("arrival_n") / rate).alias("modelled_s"))
            amps = locate.event_amplitudes(near, times, places, sites, table, amplitude, grid, rate, marginal, fraction, response=response, instrument=instrument)
            named = amps.join(start.select("event", "event_id"), "event").drop("event")
            writers.write_csv(writers.amplitude_rows(named), f"{run.out}/amplitudes")
            means = locate.event_magnitudes(amps, mags).select("event", "ml", "ml_err", F.col("r2").alias("ml_r2"))
            rows = rows.join(means, "event", "left")
        writers.write_csv(writers.event_rows(rows, grid), f"{run.out}/events")
