"""WARC archives with revisit records.

Writing. Headers (id, digest and size of the payload) are aggregated by digest, with map-side partial maxima, so that a
payload held by a third of all rows costs one header a task. Only payloads that several rows hold need an entry in the
result: the id of their original, the largest. While that table is small (bytes and rows are checked) it is sent to the
rows and no body is shuffled. Beyond that, revisit records are made from headers alone, and the other rows are told from
them by id, digest and size, which no two different rows share.

Every record is a gzip member of its own, and the first record of each file is its warcinfo. Spark's text writer lays
the members down, so files appear through the ordinary commit protocol on any Hadoop file system and a task
that is run again replaces its file. Its line separator is an empty gzip member, which a reader of gzip does not see,
after every ``CHUNK`` bytes or so; archives can be split there.

Reading. Records are found by their Content-Length, in archives of this or any other writer: compressed by record,
compressed as a whole or not compressed. A task reads a chunk at a time; an archive without separators is one chunk.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, drop_staged, join_small, read_table, small_enough, stage, staging

CHUNK = 4 << 20
BREAK = gzip.compress(b"", mtime=0)
#: Spark turns a separator into bytes by the encoding; this one keeps them as they are.
_BREAKS = {"lineSep": BREAK.decode("latin-1"), "encoding": "ISO-8859-1"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def archive_token() -> str:
    return uuid.uuid4().hex


def resolve_revisits(headers: DataFrame, least: int = 0) -> DataFrame:
    """(sha, size, original_id) of every payload of at least ``least`` bytes that several rows hold: its largest id.

    ``headers`` has id, sha and size. Partial maxima and counts go to the shuffle.
    """
    held = headers.where(F.col("size") >= least).groupBy("sha", "size").agg(F.max("id").alias("original_id"), F.count(F.lit(1)).alias("rows"))
    return held.where("rows > 1 AND original_id IS NOT NULL").drop("rows")


# ------------------------------------------------------------------ writing


def _record(kind: str, ident: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{ident}>"), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))]
    head = "".join(["WARC/1.1\r\n", *[f"{k}: {v}\r\n" for k, v in lines], "\r\n"])
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress(head.encode()) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def _page(page: str | None) -> str:
    return f"urn:page:{'' if page is None else page}"


def _members(token: str):
    """Rows (id, url, sha, original_id, body) as chunks of gzip members; ``original_id`` makes a revisit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = f"urn:uuid:{uuid.uuid5(uuid.UUID(token), str(TaskContext.get().partitionId()))}"
        out, size = [], 0
        for batch in batches:
            for page, url, sha, original, body in zip(*batch.columns, strict=True):
                if not out and not size:
                    out.append(_record("warcinfo", info, [("Content-Type", "application/warc-fields")], b"software: wavestack\r\nformat: WARC File Format 1.1\r\n"))
                fields = [("WARC-Warcinfo-ID", f"<{info}>"), ("WARC-Target-URI", re.sub(r"[\r\n]+", " ", url.as_py())), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha.as_py())).decode())]
                if original.is_valid:
                    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{_page(original.as_py())}>")]
                data = body.as_buffer().to_pybytes() if body.is_valid and not original.is_valid else b""
                out.append(_record("revisit" if original.is_valid else "response", _page(page.as_py()), [*fields, ("Content-Type", "text/html")], data))
                size += len(out[-1])
                if size > CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["value"])
                    out, size = [], 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary())], names=["value"])

    return run


def write_archive(pages: DataFrame, path: str, token: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, most: int = BROADCAST_ROWS) -> None:
    """Write one record per row: a response for the largest id of equal payloads, else a revisit of it.

    A null payload is empty, a null url an empty target, a null id an empty id that is never an
    original unless all ids of its payload are null (then each of those rows is a response). Rows that
    repeat the largest id are all responses; other repeated rows are all revisits. Payloads below ``least``
    bytes are always responses. An empty table gives an archive without records. Other columns are ignored.
    Up to ``most`` repeated payloads are sent to the rows; beyond it bodies of responses are shuffled by id.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).alias("id"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.sha1(body.cast("binary")).alias("sha"), F.octet_length(body).cast("long").alias("size"), body.alias("body"))
    originals = stage(resolve_revisits(rows.select("id", "sha", "size"), least), "warc-originals")
    revisit = F.col("original_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("original_id"))
    columns = [F.col("id").cast("string"), "url", "sha", F.col("original_id").cast("string"), F.col("body").cast("binary")]
    if small_enough(originals, most):
        joined = rows.join(F.broadcast(originals), ["sha", "size"], "left")
        out = joined.withColumn("original_id", F.when(revisit, F.col("original_id"))).withColumn("body", F.when(~revisit, F.col("body"))).select(*columns)
    else:
        again = rows.drop("body").join(originals, ["sha", "size"]).where(revisit)
        names = again.select(F.col("id").alias("_id"), F.col("sha").alias("_sha"), F.col("size").alias("_size")).distinct()
        own = rows.join(names, F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")) & (F.col("size") == F.col("_size")), "left_anti")
        empty = F.lit(None).cast("string")
        out = own.withColumn("original_id", empty).select(*columns).union(again.withColumn("body", empty).select(*columns))
    out.mapInArrow(_members(token), "value binary").select(F.col("value").cast("string")).write.options(**_BREAKS).text(path)
    drop_staged(originals)


# ------------------------------------------------------------------ reading


def _plain(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a chunk in pieces: of its gzip members, or as they are."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data[:2] == b"\x1f\x8b":
        pack = zlib.decompressobj(31)
        rest = data
        while not pack.eof:
            piece = pack.decompress(rest, step)
            rest = pack.unconsumed_tail
            if piece:
                yield piece
            elif not rest and not pack.eof:
                raise ValueError("a gzip member breaks off")
        data = pack.unused_data.lstrip(b"\0")
    if data:
        raise ValueError("something else follows a gzip member")


def parse_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of every record, each as long as its Content-Length says."""
    pieces, held, more = iter(pieces), bytearray(), True

    def read() -> bool:
        nonlocal more
        piece = next(pieces, None)
        more = piece is not None
        held.extend(piece or b"")
        return more

    while True:
        while more and not held.strip(b"\r\n"):
            held.clear()
            read()
        del held[: len(held) - len(held.lstrip(b"\r\n"))]
        if not held:
            return
        while (end := held.find(b"\r\n\r\n")) < 0 and read():
            pass
        if end < 0 or not held.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        lines = held[:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        while len(held) < end + 4 + size and read():
            pass
        if len(held) < end + 4 + size:
            raise ValueError(f"damaged record {fields.get('warc-record-id', '?')}")
        yield fields, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size]


def _name(uri: str | None) -> str | None:
    return ((uri or "").strip("<>").removeprefix("urn:page:")) or None


_READ = "id string, url string, record_type string, payload_digest string, refers_to string, length long, payload binary"


def read_archive(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("response", "revisit", "resource")) -> DataFrame:
    """Records of an archive: id, url, record_type, payload_digest, refers_to, length, payload.

    ``path`` may hold archives of any writer; ``length`` is the Content-Length. The payload of a record of type
    application/http is what follows its own headers. A record that breaks off, or whose payload does not have
    its SHA-1, is an error. Ids are those of pages, or other record ids as they are; empty ones are null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            kinds_ = [pa.string()] * 5 + [pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds_, strict=True)], names=[x.split()[0] for x in _READ.split(", ")])

        for batch in batches:
            for chunk in batch.column(0):
                rows, size = [], 0
                for fields, block in parse_records(_plain(chunk.as_py())):
                    kind = fields.get("warc-type")
                    if kind not in kinds:
                        continue
                    ident, length = fields.get("warc-record-id"), len(block)
                    if fields.get("content-type", "").startswith("application/http"):
                        block = block.partition(b"\r\n\r\n")[2]
                    algorithm, _, digest = fields.get("warc-payload-digest", "").partition(":")
                    if kind != "revisit" and algorithm == "sha1" and base32_sha1(block) != digest:
                        raise ValueError(f"damaged record {ident}")
                    rows.append((_name(ident), fields.get("warc-target-uri"), kind, digest or None, _name(fields.get("warc-refers-to")), length, block))
                    size += length
                    if size > CHUNK:
                        yield packed(rows)
                        rows, size = [], 0
                if rows:
                    yield packed(rows)

    raw = spark.read.options(**_BREAKS).text(path).where(F.length("value") > 0)
    return raw.select(F.col("value").cast("binary")).mapInArrow(run, _READ)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as a deduplicated archive, read back, and revisits resolved to their responses."""
    token = archive_token()
    path = f"{staging(spark)}/warc-{token}"
    write_archive(read_table(spark, sf_dir, "pages"), path, token)
    response = F.col("record_type") == "response"
    seen = stage(
        read_archive(spark, path).select(
            F.col("id").cast("long").alias("page_id"), "record_type", F.col("refers_to").cast("long").alias("refers_to"),
            F.when(response, F.octet_length("payload").cast("long")).alias("own_bytes"), F.when(response, F.col("payload_digest")).alias("own_digest"),
        ), "warc-records")
    wanted = seen.select("refers_to").where("refers_to IS NOT NULL").distinct()
    responses = seen.where("record_type = 'response'").join(wanted.withColumnRenamed("refers_to", "page_id"), "page_id", "left_semi")
    responses = responses.groupBy(F.col("page_id").alias("refers_to")).agg(F.max("own_bytes").alias("their_bytes"), F.max("own_digest").alias("their_digest"))
    joined = join_small(seen, stage(responses, "warc-responses"), "refers_to", "left")
    return joined.select("page_id", F.coalesce("own_bytes", "their_bytes").alias("payload_bytes"), F.coalesce("own_digest", "their_digest").alias("payload_digest"), "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS b FROM pages),
h AS (SELECT page_id, strlen(b) AS n, sha1(b) AS d, max(page_id) OVER (PARTITION BY b) AS last FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(d, CAST((i // 4) * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = last THEN NULL ELSE last END AS refers_to
FROM h
"""
