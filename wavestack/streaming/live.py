"""Live triggering over a stream of scan samples (station network key, t, coa, coa_n, x, y, z)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import Trigger

MAD_SCALE = 1.4826
_CANDIDATE = "network string, first_us long, last_us long, coa_us long, trig_coa double, coa_x double, coa_y double, coa_z double, coa double, coa_norm double"
_OPEN = "first_us long, last_us long, coa_us long, trig double, x double, y double, z double, coa double, coa_n double"


def tumbling_thresholds(stream: DataFrame, config: Trigger, late: str = "1 minute", time: str = "ts") -> DataFrame:
    """(network, start, end, threshold) of every epoch-aligned window: median or median + k x MAD.

    Late samples beyond the watermark are dropped, which bounds the state to open windows. MAD needs the
    window's own median, so its samples are kept as an array until the window closes.
    """
    windows = stream.withWatermark(time, late).groupBy("network", F.window(time, f"{int(config.window)} seconds").alias("w")).agg(F.collect_list(config.on).alias("v"))
    middle = lambda a: F.try_divide(F.element_at(F.array_sort(a), F.floor((F.size(a) + 1) / 2).cast("int")) + F.element_at(F.array_sort(a), F.floor((F.size(a) + 2) / 2).cast("int")), F.lit(2.0))
    rows = windows.withColumn("m", middle(F.col("v")))
    if config.method == "median_ratio":
        value = F.col("m") * config.multiplier
    elif config.method == "static":
        value = F.lit(float(config.threshold))
    else:
        rows = rows.withColumn("d", F.expr("transform(v, x -> abs(x - m))"))
        value = F.col("m") + config.multiplier * MAD_SCALE * middle(F.col("d"))
    return rows.select("network", F.col("w.start").alias("start"), F.col("w.end").alias("end"), value.alias("threshold"))


def candidates(stream: DataFrame, config: Trigger, rate: float, late: str = "10 seconds", time: str = "ts") -> DataFrame:
    """Candidate runs as they close: a run ends at the first sample below the threshold, after a gap, or when
    the watermark has passed it. State per network: the one open run."""
    step = int(1.5e6 / rate)
    threshold = float(config.threshold)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else None
        if state.hasTimedOut:
            done = [(key[0], *now)] if now else []
            state.remove()
        else:
            done, now = _runs(key[0], pd.concat(list(batches)).sort_values("t_us", kind="stable"), now)
            if now:
                state.update(tuple(float(v) if i > 2 else int(v) for i, v in enumerate(now)))
                state.setTimeoutTimestamp(max(int(now[1] / 1000) + 1, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame(done, columns=[f.split()[0] for f in _CANDIDATE.split(", ")])

    def _runs(name: str, rows: pd.DataFrame, now: tuple | None) -> tuple[list[tuple], tuple | None]:
        """The runs that close within the rows, and the one still open, if any; ``now`` is the one open so far."""
        t, value = rows["t_us"].to_numpy(), rows[config.on].to_numpy()
        columns = [t, value, *(rows[c].to_numpy() for c in ("x", "y", "z", "coa", "coa_n"))]
        over = value >= threshold
        if not len(t):
            return [], now
        gap = np.diff(t, prepend=now[1] if now else t[0]) > step
        new = over & (np.concatenate([[now is None], ~over[:-1]]) | gap)
        places = np.flatnonzero(over)
        # rows over the threshold by the run they belong to; number 0 goes on with the open one
        number = np.cumsum(new)[places]
        done: list[tuple] = []
        if now is not None and (not over[0] or gap[0]):
            done.append((name, *now))
            now = None
        for k in np.unique(number):
            own = places[number == k]
            best = own[columns[5][own].argmax()]
            peak = tuple(c[best] for c in columns)
            if k == 0 and now is not None:
                now = (now[0], t[own[-1]], *(peak if peak[5] > now[7] else now[2:]))
            else:
                if now is not None:
                    done.append((name, *now))
                now = (t[own[0]], t[own[-1]], *peak)
        if now is not None and not over[-1]:
            done.append((name, *now))
            now = None
        return done, now

    slim = stream.withWatermark(time, late).withColumn("t_us", F.unix_micros(F.col(time)))
    return slim.groupBy("network").applyInPandasWithState(run, _CANDIDATE, _OPEN, "append", GroupStateTimeout.EventTimeTimeout)
