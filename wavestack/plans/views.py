"""The driver's tables in the shape of this library's inputs, and the same shapes as SQL.

traces: embeddings as channels (label: station, vec_id: channel); scan: events as a coalescence series, in
daily batches; observations: lineitem as amplitude observations; grid: generated nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Grid
from ..operators import grid as grids

GRID = Grid((0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (8, 8, 1))
SPEEDS = {"P": 1.7, "S": 1.0}
CHUNK = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trace_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, channel, samples): one row per channel."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("station"), F.col("vec_id").alias("channel"), F.col("embedding").cast("array<double>").alias("samples"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, channel, n, value)."""
    return trace_arrays(spark, sf_dir).select("station", "channel", F.posexplode("samples").alias("n", "value"))


TRACES = """traces AS (SELECT label AS station, vec_id AS channel, unnest(range(len(embedding))) AS n, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"""


def scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(batch, n, t_us, coa, coa_n, x, y, z), ordered within a day."""
    events = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    rows = events.select(day.alias("batch"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), "event_id", F.col("value").alias("coa"), F.col("user_id").cast("double").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"), (F.col("value") % 10).alias("z"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("batch").orderBy("t_us", "event_id")).cast("long") - 1)
    mean = F.avg("coa").over(Window.partitionBy("batch", F.floor(F.col("n") / CHUNK)))
    return rows.withColumn("coa_n", F.col("coa") / mean).select("batch", "n", "t_us", "coa", "coa_n", "x", "y", "z")


SCAN = """scan0 AS (SELECT CAST(ts AS DATE) AS batch, epoch_us(ts) AS t_us, event_id, value AS coa, CAST(user_id AS DOUBLE) AS x,
  CAST(regexp_extract(props, '"k": *(-?[0-9.]+)', 1) AS DOUBLE) AS y, value % 10 AS z FROM events),
scan1 AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY t_us, event_id) - 1 AS n FROM scan0),
scan AS (SELECT batch, n, t_us, coa, coa / avg(coa) OVER (PARTITION BY batch, n // 500) AS coa_n, x, y, z FROM scan1)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, id, amp, noise_amp, epi_dist, z_dist, filter_gain, is_picked)."""
    rows = table(spark, sf_dir, "lineitem")
    amp = F.col("l_extendedprice") / 1000
    return rows.select(
        F.col("l_orderkey").alias("event_id"), F.concat(F.lit("XX.S"), (F.col("l_suppkey") % 20).cast("string"), F.lit("..HH"), F.col("l_returnflag")).alias("id"),
        amp.alias("amp"), (amp * F.col("l_discount") * 12).alias("noise_amp"), F.col("l_quantity").cast("double").alias("epi_dist"), (F.col("l_partkey") % 30).cast("double").alias("z_dist"),
        (1 + F.col("l_tax")).alias("filter_gain"), (F.col("l_linestatus") == "O").alias("is_picked"),
    )


OBSERVATIONS = """obs AS (SELECT l_orderkey AS event_id, 'XX.S' || (l_suppkey % 20) || '..HH' || l_returnflag AS id, l_extendedprice / 1000 AS amp,
  l_extendedprice / 1000 * l_discount * 12 AS noise_amp, CAST(l_quantity AS DOUBLE) AS epi_dist, CAST(l_partkey % 30 AS DOUBLE) AS z_dist, 1 + l_tax AS filter_gain, l_linestatus = 'O' AS is_picked FROM lineitem)"""


def nodes(spark: SparkSession) -> DataFrame:
    return grids.nodes(spark, GRID)


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station, x, y, z): the labels of the traces, on a small lattice two units above the grid."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("station")).distinct()
    return rows.select("station", (F.col("station") % 4).cast("double").alias("x"), F.floor(F.col("station") / 4).cast("double").alias("y"), F.lit(-2.0).alias("z"))


GRID_SQL = """nodes AS (SELECT r AS node, r // 8 AS i, r % 8 AS j, 0 AS k, CAST(r // 8 AS DOUBLE) AS x, CAST(r % 8 AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS z FROM (SELECT unnest(range(64)) AS r)),
stations AS (SELECT DISTINCT label AS station, CAST(label % 4 AS DOUBLE) AS x, CAST(label // 4 AS DOUBLE) AS y, CAST(-2 AS DOUBLE) AS z FROM embeddings),
lut AS (SELECT station, phase, node, sqrt((n.x - s.x) ** 2 + (n.y - s.y) ** 2 + (n.z - s.z) ** 2) / speed AS tt FROM nodes n, stations s, (VALUES ('P', 1.7), ('S', 1.0)) AS p(phase, speed))"""


def travel_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.homogeneous(nodes(spark), stations(spark, sf_dir), SPEEDS)


def availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(step, name, available): whether an order of a priority was placed on a day."""
    return table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("step"), F.substring("o_orderpriority", 1, 1).alias("name")).distinct().withColumn("available", F.lit(1))
