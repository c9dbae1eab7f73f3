"""Substring deduplication by a relative Lempel-Ziv parse of every document.

The reference. Of every window of ``WINDOW`` words that two documents hold, the place in the document of smallest id
(the first there) is kept. So each window stands once in the reference, which holds no text twice, and a match
of at least one window has one place to start at and one longest end.

The parse. A document is factored greedily from its first word on: at a window that an earlier document holds the
factor runs as long as the document's words follow the reference's, and carries the reference document and the place
there; where no earlier document holds the window, the parse goes on by one word. Windows across the end of a factor
start inside it and are looked up too (``boundary`` spans). Factors have at least ``WINDOW`` words, and together with
the boundary spans they cover exactly the windows that a document with a smaller id also holds; their words are removed.
A document is factored against every block of the reference: the index of its windows is dealt by hash, so no block
is compared with a document that shares nothing with it.

1. Of the 8 hashes of 6 words inside every window of 13 words the smallest is the window's anchor. Equal
   windows have equal anchors, so a window can only be a repeat if its anchor is in two documents.
   About two words in nine give an anchor; anchors go to their hash's block as packed arrays.
2. Each block tells the documents which of their anchors others hold too.
3. Windows with such an anchor are gathered by flocks, the documents that a task works through at a time. A flock sends
   each distinct window once, under a 96-bit hash with its first place, to the window's block, and the block tells
   the flock of every earlier place. A passage in a third of all rows thus costs its block one entry a flock.
4. Where windows and places meet again, flock by flock, the documents are parsed.

Texts are joined with answers only where a document shares an anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, blob, buckets_for, drop_staged, free_shuffles, give_back, join_sparse, read_table, sliding_min, slices, small_enough, stage, text_buffers

WINDOW, GRAM = 13, 6
#: Entries that a task gathers before it combines and sends them.
GATHERED = 800_000
#: Bytes of a group after which its memory is returned at once.
LARGE = 2 << 20
LAST = np.iinfo(np.int64).max  # stands for a null id: after all others
_U = np.uint64


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new run of equal keys begins, for keys sorted together; one place past the end included."""
    n = len(keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.concatenate([np.flatnonzero(new), [n]])


def _send(bucket: np.ndarray, n_buckets: int, columns: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    """Rows of packed columns, one for each bucket that has entries."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    columns = [c[order] for c in columns]
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), [blob(c[edges[b] : edges[b + 1]]) for c in columns]


def _by_row(rows: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    """Packed columns for each distinct row key."""
    order = np.argsort(rows, kind="stable")
    rows, columns = rows[order], [c[order] for c in columns]
    edge = _runs(rows)
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        yield int(rows[a]), [blob(c[a:b]) for c in columns]


def _bucket(hashes: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((hashes >> _U(32)) * _U(n_buckets) >> _U(32)).astype(np.int64)


# ------------------------------------------------------------------ anchors

_ANCHOR_ROWS = "bucket int, row long, a binary, b binary"
_ANCHOR_ARROW = pa.schema([("bucket", pa.int32()), ("row", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])


def window_anchors(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(anchor of each window, whether the window lies in one text)."""
    return sliding_min(words.grams(GRAM), WINDOW - GRAM + 1), words.whole(WINDOW)


def _shared(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unique (hash, row) sorted, whether two rows hold the hash, and whether the entry is its hash's first."""
    order = np.lexsort((rows, hashes))
    h, r = hashes[order], rows[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[keep], r[keep]
    edge = _runs(h)
    size = np.diff(edge)
    first = np.zeros(len(h), bool)
    first[edge[:-1]] = True
    return h, r, np.repeat(size > 1, size), first


def _anchor_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ANCHOR_ARROW.types, strict=True)], schema=_ANCHOR_ARROW)


def _emit_anchors(n_buckets: int):
    def flush(hashes: list[np.ndarray], rows: list[np.ndarray], salt: int) -> pa.RecordBatch:
        h, r, many, first = _shared(np.concatenate(hashes), np.concatenate(rows))
        out = [(b, None, x[0], x[1]) for b, x in _send(_bucket(h[first], n_buckets), n_buckets, [h[first], r[first]])]
        out += [((row + salt) % n_buckets, row, x[0], None) for row, x in _by_row(r[many], [h[many]])]
        return _anchor_batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rows, size, salt = [], [], 0, 0
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            ids = batch.column("row").to_numpy(zero_copy_only=False)
            for a, b in slices(offsets):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                anchor, whole = window_anchors(words)
                doc = words.doc[: len(anchor)][whole]
                anchor = anchor[whole]
                keep = np.ones(len(anchor), bool)
                keep[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                hashes.append(anchor[keep])
                rows.append(ids[a:b][doc[keep]])
                size += int(keep.sum())
                if size > GATHERED:
                    yield flush(hashes, rows, salt)
                    hashes, rows, size, salt = [], [], 0, salt + 1
                    give_back()
        if size:
            yield flush(hashes, rows, salt)
        del hashes, rows
        give_back()

    return run


def _answer_anchors(table: pa.Table) -> pa.Table:
    """Which anchors of a block two rows hold: (row, packed hashes); answers given before pass through."""
    sent = table.filter(pc.is_null(table["row"]))
    done = table.filter(pc.is_valid(table["row"]))
    rows, packed = done["row"].to_pylist(), done["a"].to_pylist()
    if sent.num_rows:
        h = np.concatenate([np.frombuffer(x, _U) for x in sent["a"].to_pylist()])
        r = np.concatenate([np.frombuffer(x, np.int64) for x in sent["b"].to_pylist()])
        h, r, many, _ = _shared(h, r)
        for row, x in _by_row(r[many], [h[many]]):
            rows.append(row)
            packed.append(x[0])
        del h, r, many
    if table.nbytes > LARGE:
        give_back()
    return pa.table({"row": pa.array(rows, pa.int64()), "hashes": pa.array(packed, pa.binary())})


# ------------------------------------------------------------------ windows

#: From a flock to a block: ``first`` is the number of the flock's first window among those sent; a, b: the window's
#: hashes, c: document, d: place. Passed through for the flock itself: a: rows, b: documents, c: row, first word and
#: windows of each run of neighbouring windows, d: number of each window. From a block: a: numbers, b: documents, c: places.
_FLOCK_ROWS = "bucket int, flock long, first int, a binary, b binary, c binary, d binary"
_FLOCK_ARROW = pa.schema([("bucket", pa.int32()), ("flock", pa.int64()), ("first", pa.int32()), *[(x, pa.binary()) for x in "abcd"]])
_FACTORS = "array<struct<first:int,words:int,reference:long,place:int,boundary:boolean>>"


def _places(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Word places in the low 32 bits; the high bits tell rows that share a document id apart."""
    return (rows >> 33 << 32) + at


def _least(*keys: np.ndarray) -> np.ndarray:
    """Order by the last two keys within equal leading ones."""
    return np.lexsort(keys[::-1])


def _emit_windows(n_buckets: int):
    def flush(parts: list[tuple], flock: int) -> pa.RecordBatch:
        ha, hb, doc, row, pos, text = (np.concatenate(x) for x in zip(*parts, strict=True))
        place = _places(row, pos.astype(np.int64))
        order = _least(ha, hb, doc, place)
        edge = _runs(ha[order], hb[order])
        head = order[edge[:-1]]
        number = np.empty(len(ha), np.int32)
        number[order] = np.repeat(np.arange(len(head), dtype=np.int32), np.diff(edge))
        # entries come text by text, in the order of their places
        starts, edges = _runs(text), _runs(text, pos - np.arange(len(pos)))
        which = np.searchsorted(starts, edges[:-1], side="right") - 1
        runs = np.stack([which, pos[edges[:-1]], np.diff(edges)], 1).astype(np.int32)
        out = [(flock % n_buckets, flock, None, blob(row[starts[:-1]]), blob(doc[starts[:-1]]), blob(runs), blob(number))]
        # windows are numbered by hash and blocks are ranges of hashes, so a block's windows have consecutive numbers
        bucket = _bucket(ha[head], n_buckets)
        ends = np.searchsorted(bucket, np.arange(n_buckets + 1))
        for b in np.flatnonzero(np.diff(ends)):
            some = head[ends[b] : ends[b + 1]]
            out.append((int(b), flock, int(ends[b]), blob(ha[some]), blob(hb[some]), blob(doc[some]), blob(place[some])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _FLOCK_ARROW.types, strict=True)], schema=_FLOCK_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, flock, seen = [], 0, TaskContext.get().partitionId() << 24, 0
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            ids = batch.column("row").to_numpy(zero_copy_only=False)
            docs = batch.column("doc").fill_null(LAST).to_numpy(zero_copy_only=False)
            anchors = batch.column("anchors")
            for a, b in slices(offsets):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                anchor, whole = window_anchors(words)
                mine = np.zeros(len(anchor), bool)
                for k in range(a, b):
                    lo, hi = words.first[k - a], min(words.first[k - a + 1], len(anchor))
                    if hi > lo:
                        wanted = np.concatenate([np.frombuffer(x, _U) for x in anchors[k].as_py()])
                        mine[lo:hi] = np.isin(anchor[lo:hi], wanted)
                at = np.flatnonzero(mine & whole)
                if not len(at):
                    continue
                doc = words.doc[at]
                ha, hb = words.grams(WINDOW, 0)[at], (words.grams(WINDOW, 1, words.hashes(1))[at] >> _U(32)).astype(np.uint32)
                parts.append((ha, hb, docs[a:b][doc], ids[a:b][doc], (at - words.first[doc]).astype(np.int32), seen + a + doc))
                size += len(at)
                if size > GATHERED:
                    yield flush(parts, flock)
                    parts, size, flock = [], 0, flock + 1
                    give_back()
            seen += batch.num_rows
        if size:
            yield flush(parts, flock)
        del parts
        give_back()

    return run


def _answer_windows(table: pa.Table) -> pa.Table:
    """For the flocks: their windows that a smaller document holds, and its first place; what flocks keep passes through."""
    kept = table.filter(pc.is_null(table["first"]))
    sent = table.filter(pc.is_valid(table["first"]))
    out = [kept.select(["flock", "first", *"abcd"])]
    if sent.num_rows:
        cols = [[np.frombuffer(x, k) for x in sent[c].to_pylist()] for c, k in zip("abcd", (_U, np.uint32, np.int64, np.int64), strict=True)]
        size = np.array([len(x) for x in cols[0]])
        ha, hb, doc, place = (np.concatenate(x) for x in cols)
        part = np.repeat(np.arange(len(size)), size)
        order = _least(ha, hb, doc, place)
        edge = _runs(ha[order], hb[order])
        first = np.empty(len(ha), np.int64)
        first[order] = np.repeat(order[edge[:-1]], np.diff(edge))
        later = np.flatnonzero(doc > doc[first])
        inside = np.arange(len(ha)) - np.repeat(np.cumsum(size) - size, size)
        flocks, starts = sent["flock"].to_numpy(), sent["first"].to_numpy().astype(np.int64)
        cut = np.searchsorted(part[later], np.arange(len(size) + 1))
        rows = []
        for i in np.flatnonzero(np.diff(cut)):
            own = later[cut[i] : cut[i + 1]]
            rows.append((int(flocks[i]), 0, blob((starts[i] + inside[own]).astype(np.int32)), blob(doc[first[own]]), blob(place[first[own]]), None))
        if rows:
            out.append(pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _FLOCK_ARROW.types[1:], strict=True)], schema=pa.schema(list(_FLOCK_ARROW)[1:])))
        del cols, ha, hb, doc, place, order, first, later, inside, part, rows
        if sent.nbytes > LARGE:
            give_back()
    return pa.concat_tables(out)


# ------------------------------------------------------------------ the parse


def factors(runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int, bool]]:
    """The greedy parse of one document, as (first word, words, reference, place there, across the end of a factor).

    ``runs`` are the longest matches in order: (first window, windows, reference, place) of neighbouring windows that
    stand side by side in the reference. A factor takes a run from the first word not yet parsed; windows of further
    runs that start inside the factor are boundary spans.
    """
    out, parsed = [], 0
    for at, n, reference, place in runs:
        if at < parsed:
            k = min(n, parsed - at)
            out.append((at, k + WINDOW - 1, reference, place, True))
            at, n, place = at + k, n - k, place + k
        if n:
            out.append((at, n + WINDOW - 1, reference, place, False))
            parsed = at + n + WINDOW - 1
    return out


def _parse(table: pa.Table) -> pa.Table:
    """(doc, row, factors) of every document of a flock that has one."""
    kept = table.filter(pc.is_null(table["first"]))
    told = table.filter(pc.is_valid(table["first"]))
    row, doc, neighbours, number = (np.frombuffer(kept[c][0].as_py(), k) for c, k in zip("abcd", (np.int64, np.int64, np.int32, np.int32), strict=True))
    neighbours = neighbours.reshape(-1, 3).astype(np.int64)
    size = neighbours[:, 2]
    which = np.repeat(neighbours[:, 0], size)
    pos = np.repeat(neighbours[:, 1] - np.cumsum(size) + size, size) + np.arange(len(number))
    place = _places(row[which], pos)
    order = _least(number, doc[which], place)
    head = order[_runs(number[order])[:-1]]
    ref, at = doc[which[head]], place[head]
    if told.num_rows:
        at_number, their, there = (np.concatenate([np.frombuffer(x, k) for x in told[c].to_pylist()]) for c, k in zip("abc", (np.int32, np.int64, np.int64), strict=True))
        ref[at_number], at[at_number] = their, there
    found = np.flatnonzero(doc[which] > ref[number])
    rows, pos, ref, at = which[found], pos[found], ref[number[found]], at[number[found]]
    # the index of a run's windows: both places go on by one
    edge = _runs(rows, pos - np.arange(len(pos)), ref, at - np.arange(len(at)))
    heads = edge[:-1]
    place = at & 0xFFFFFFFF
    runs = list(zip(pos[heads].tolist(), np.diff(edge).tolist(), ref[heads].tolist(), place[heads].tolist(), strict=True))
    owner = rows[heads]
    cut = _runs(owner)
    spans = [factors(runs[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    mine = owner[cut[:-1]]
    del kept, told, which, number, place, order, pos, found, runs
    if table.nbytes > LARGE:
        give_back()
    kind = pa.struct([("first", pa.int32()), ("words", pa.int32()), ("reference", pa.int64()), ("place", pa.int32()), ("boundary", pa.bool_())])
    flat = [x for own in spans for x in own]
    columns = list(zip(*flat, strict=True)) if flat else [[]] * 5
    structs = pa.StructArray.from_arrays([pa.array(c, kind.field(i).type) for i, c in enumerate(columns)], fields=list(kind))
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in spans])]).astype(np.int32))
    covered = [_covered(own) for own in spans]
    return pa.table({"doc": pa.array(doc[mine], pa.int64()), "row": pa.array(row[mine], pa.int64()), "factors": pa.ListArray.from_arrays(offsets, structs), "covered": pa.array(covered, pa.binary())})


def _covered(spans: list[tuple]) -> bytes:
    """The ranges of words (first, end) that the spans of a document cover together, packed."""
    out: list[int] = []
    for first, words, *_ in spans:  # in the order of their first words
        if out and first <= out[-1]:
            out[-1] = max(out[-1], first + words)
        else:
            out += [first, first + words]
    return blob(np.array(out, np.int32))


def _keyed(docs: DataFrame, text: str, key: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("doc"), body.alias("text")).withColumn("row", F.xxhash64(F.coalesce(F.col("doc"), F.lit(LAST)), F.col("text")))


def duplicate_spans(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc, row, factors array<struct<first, words, reference, place, boundary>>, covered) of every text with a duplicate span.

    A span of ``words`` words from word ``first`` on stands in document ``reference`` from word ``place`` on. ``covered`` packs the ranges of words that
    the spans cover (32-bit pairs of first and end). ``row`` is xxhash64 of key and text; rows are known by it together with the key (``doc``; the largest long for a null one). The document with the smallest key
    that holds a window keeps it; a null key counts as larger than any. Rows that repeat a key do not make each other
    repeats; equal rows may come once or several times. Null, empty and short texts have no span; texts are read whole.
    """
    keyed = _keyed(docs, text, key)
    n = buckets_for(docs)
    shared = keyed.select("row", "text").mapInArrow(_emit_anchors(n), _ANCHOR_ROWS).groupBy("bucket").applyInArrow(_answer_anchors, "row long, hashes binary")
    shared = stage(shared, "repeat-anchors")
    free_shuffles(docs)
    anchors = shared.groupBy("row").agg(F.collect_list("hashes").alias("anchors"))
    ids = shared.select("row").distinct()
    some = keyed.join(F.broadcast(ids), "row", "left_semi") if small_enough(ids) else keyed
    windows = some.join(anchors, "row").select("row", "doc", "text", "anchors").mapInArrow(_emit_windows(n), _FLOCK_ROWS)
    met = windows.groupBy("bucket").applyInArrow(_answer_windows, "flock long, first int, a binary, b binary, c binary, d binary")
    spans = stage(met.groupBy("flock").applyInArrow(_parse, f"doc long, row long, factors {_FACTORS}, covered binary"), "repeat-spans")
    drop_staged(shared)
    free_shuffles(docs)
    return spans


_KEPT = "doc_id long, n_words long, n_removed long, kept string"


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every text without its duplicate spans, words joined by one space.

    With ``digest`` the column ``kept`` is the SHA-256 of that text in lowercase hex instead.
    """
    spans = duplicate_spans(docs, text, key)
    cuts = stage(spans.groupBy("row", F.col("doc").alias("known")).agg(F.first("covered").alias("covered")), "repeat-cuts")
    keyed = _keyed(docs, text, key).withColumn("known", F.coalesce("doc", F.lit(LAST)))
    joined = join_sparse(keyed, cuts, ["row", "known"], F.octet_length("covered") + 48)
    drop_staged(spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n_words, n_removed, kept = [], [], []
                for value, found in zip(part.column(1), part.column(2), strict=True):
                    own = value.as_buffer().to_pybytes().split()
                    total = len(own)
                    if found.is_valid:
                        covered = np.zeros(total, bool)
                        for first, end in np.frombuffer(found.as_py(), np.int32).reshape(-1, 2):
                            covered[first:end] = True
                        own = [w for w, c in zip(own, covered.tolist(), strict=True) if not c]
                    n_words.append(total)
                    n_removed.append(total - len(own))
                    out = b" ".join(own)
                    kept.append(hashlib.sha256(out).hexdigest() if digest else out.decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return joined.select("doc", "text", "covered").mapInArrow(run, _KEPT)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the spans that an earlier document holds."""
    return remove_repeats(read_table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT rid, doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT rid, i FROM (SELECT rid, i, doc_id, min(doc_id) OVER (PARTITION BY s) AS m FROM g) WHERE m < doc_id),
c AS (SELECT rid, list(DISTINCT p) AS ps FROM (SELECT rid, unnest(range(i, i + 13)) AS p FROM f) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ')
    ELSE array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(ps, x[2])), lambda x: x[1]), ' ') END) AS kept_sha256
FROM d LEFT JOIN c ON d.rid = c.rid
"""
