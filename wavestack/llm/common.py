"""Shared helpers: staging in the cluster's shared folder, hashing, and vectorised word handling.

Every operator here follows the same rules: rows are never dropped, capped or sampled; only tables
whose bytes and rows were checked first are broadcast; intermediate tables are written to the folder that
``spark.checkpoint.dir`` names, so a lost executor costs only the tasks it ran.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows, and most bytes by the plan's own estimate (for a staged table: of its files), of a table that
#: a query broadcasts; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; a local one is made only where none is set (tests, ``local`` masters)."""
    got = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="wavestack-")
        spark.sparkContext.setCheckpointDir(got)
        got = spark.sparkContext.getCheckpointDir()
    return got.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = f"{staging(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staging(spark: SparkSession) -> str:
    """The folder of this application's staged tables."""
    return f"{shared_dir(spark)}/wavestack/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if "/wavestack/" in folder:
                _delete(table.sparkSession, folder)


def clear_staged(spark: SparkSession) -> None:
    """Delete all staged tables of this application, once the results that read them are written."""
    _delete(spark, staging(spark))


def free_name(name: str, *tables: DataFrame) -> str:
    """``name``, or the next like it that no column of the tables has."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plan_bytes(df: DataFrame) -> int:
    """Bytes of a table as its plan states them."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small_enough(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether a (staged) table may be broadcast: by its bytes, then by its rows, counted no further than ``most``."""
    return plan_bytes(df) <= BROADCAST_BYTES and df.limit(most + 1).count() <= most


def join_small(left: DataFrame, right: DataFrame, on, how: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """Equi-join that broadcasts ``right`` only after its bytes and rows were checked."""
    return left.join(F.broadcast(right) if small_enough(right, most) else right, on, how)


def join_sparse(left: DataFrame, right: DataFrame, on: list[str], weight: Column, most: int = BROADCAST_BYTES) -> DataFrame:
    """``left`` with the columns of ``right`` (staged, one row for each of the keys ``on``, none null), or nulls.

    ``weight`` is the bytes of a row of ``right``. Up to ``most`` bytes in all it is broadcast. Beyond that only the rows
    of ``left`` that have a match are shuffled, if the keys alone are few enough to tell which those are; else all.
    """
    total = right.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("bytes")).first()["bytes"]
    if total <= most:
        return left.join(F.broadcast(right), on, "left")
    keys = right.select(*on)
    if not small_enough(keys):
        return left.join(right, on, "left")
    some, rest = (left.join(F.broadcast(keys), on, how) for how in ("left_semi", "left_anti"))
    empty = {f.name: F.lit(None).cast(f.dataType) for f in right.schema.fields if f.name not in on}
    return some.join(right, on, "left").unionByName(rest.withColumns(empty))


def free_shuffles(df: DataFrame, least: int = 64 << 20) -> None:
    """Let the driver drop the shuffle files of plans that nothing reads any more, which it does as it collects garbage.

    The first collection finds the plans, the next one what they held. Inputs below ``least`` bytes leave too little to be worth it.
    """
    if plan_bytes(df) < least:
        return
    for _ in range(3):
        gc.collect()
        df.sparkSession._jvm.System.gc()
        time.sleep(0.4)


_CACHE: dict[tuple, object] = {}


def worker_cache(name: str, ident: object = None, make=dict):
    """What a Python worker keeps between tasks for one operator; taking another's gives the last one's memory back."""
    key = (name, ident)
    if key not in _CACHE:
        if _CACHE:
            _CACHE.clear()
            give_back()
        _CACHE[key] = make()
    return _CACHE[key]


def give_back() -> None:
    """Return freed memory to the system where the C library can."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass
    pa.default_memory_pool().release_unused()


#: Rows and bytes of an Arrow batch on its way to a Python worker: whole texts are long.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to ``BATCH_ROWS`` and ``BATCH_BYTES``, if they are larger.

    The setting stays: it holds when a plan runs, which is after the query that made it has returned.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(name).rstrip("b"))
        if now > most or now <= 0:
            spark.conf.set(name, str(most))


# ---------------------------------------------------------------- vectorised words (numpy)

_U = np.uint64
_R = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd multipliers of the two polynomial hashes


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** [0..n) modulo 2 ** 64, kept for later calls."""
    had = _POWERS.get(base)
    if had is None or len(had) < n:
        x = np.full(max(n, 1 << 16), base, dtype=_U)
        x[0] = 1
        had = np.multiply.accumulate(x)
        if n <= 1 << 23:
            _POWERS[base] = had
    return had[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Bytes that separate words under ``[^\x20\x09-\x0D]+``.
SPACE_BYTES = bytes([0x20, *range(0x09, 0x0E)])
WORD_BYTE = np.ones(256, dtype=bool)
WORD_BYTE[list(SPACE_BYTES)] = False
LOWER_ASCII = np.arange(256, dtype=np.uint8)
LOWER_ASCII[0x41:0x5B] += 0x20


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying the text; nulls have no bytes."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int = 1 << 20):
    """Consecutive row ranges of at most ``most`` bytes each (a longer row is a range of its own)."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


class Words:
    """Words of consecutive texts: byte spans, the text each belongs to, and 64-bit hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, table: np.ndarray = WORD_BYTE):
        n = len(data)
        inside = table[data]
        cur, prev, edge = np.zeros(n + 1, bool), np.zeros(n + 1, bool), np.zeros(n + 1, bool)
        cur[:n], prev[1:] = inside, inside
        edge[offsets] = True
        self.start = np.flatnonzero(cur & (~prev | edge))
        self.end = np.flatnonzero(prev & (~cur | edge))
        self.doc = np.searchsorted(offsets[1:], self.start, side="right")
        self.n_docs = len(offsets) - 1
        self.counts = np.bincount(self.doc, minlength=self.n_docs)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.data = LOWER_ASCII[data] if lower else data

    def hashes(self, which: int = 0) -> np.ndarray:
        base = _R[which]
        n = len(self.data)
        if not len(self.start):
            return np.zeros(0, _U)
        total = np.zeros(n + 1, _U)
        np.cumsum((self.data.astype(_U) + _U(1)) * powers(base, n), out=total[1:])
        shifted = (total[self.end] - total[self.start]) * powers(_inverse(base), n)[self.start]
        return mix(shifted + (self.end - self.start).astype(_U) * _U(0xD6E8FEB86659FD93))

    def grams(self, k: int, which: int = 0, hashed: np.ndarray | None = None) -> np.ndarray:
        """Hash of words i .. i+k-1 for every i that has them in the buffer; see ``whole`` for validity."""
        h = self.hashes(which) if hashed is None else hashed
        n = len(h)
        if n < k:
            return np.zeros(0, _U)
        base = _R[1 - which]
        total = np.zeros(n + 1, _U)
        np.cumsum(h * powers(base, n), out=total[1:])
        return mix((total[k:] - total[:-k]) * powers(_inverse(base), n)[: n - k + 1])

    def whole(self, k: int) -> np.ndarray:
        """Whether words i .. i+k-1 belong to one text."""
        return self.doc[: max(0, len(self.doc) - k + 1)] == self.doc[k - 1 :]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    have = 1
    while have < w:
        step = min(have, w - have)
        x = np.minimum(x[:-step], x[step:]) if len(x) > step else x[:0]
        have += step
    return x


def blob(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def buckets_for(df: DataFrame, per: int = 8 << 20, least: int = 48, most: int = 1 << 20) -> int:
    """Number of hash buckets for an input, in proportion to the size that its plan states."""
    return int(min(most, max(least, plan_bytes(df) // per)))
