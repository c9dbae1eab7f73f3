"""Exact n-gram Jaccard self-join by token-combination prefixes, and its components.

A document's tokens are the hashes of its distinct word shingles. Documents with equal token sets are one
set; everything below is about sets, so copies cost nothing.

Token classes. Tokens fall into ``2 ** bits`` classes by hash and classes are counted over all documents;
a class well above the mean is frequent. Tokens are ordered rare classes first, then by hash.

Prefixes. Two sets of Jaccard similarity t or more share their first l common tokens within the first
``n - ceil(t n) + l`` tokens of either, so prefixes are extended by l - 1 = 4 % of n.

* If the extended prefix of at least one of the two is all rare, they share at least l single tokens of rare
  classes there. Single tokens are indexed, and pairs that share fewer than l are dropped unread.
* A set whose extended prefix reaches frequent classes is indexed by token combinations too: its tokens
  are dealt by hash into more parts than two similar sets of its size can have differing tokens, and the
  tokens of each part together make one key. Two such sets agree in a part (the pigeonhole
  principle), whatever the frequency of the single tokens. Sizes fall into classes so that both use
  the same parts; a part without tokens is a key only for sets with so many of them that it is needed.

Verification compares whole token sets. A key with few sets gives all its pairs. A key with many gives a
star around its hub, the set of smallest name; once stars are verified and joined into components, pairs of
different components are sought among a hub's sets by what they changed against it (see ``_across``), so a
group of thousands of near copies costs a number of checks in proportion to its size, and no link between
components is lost. A task that finds a key crowded among its own sets tells the star at once and sends the hub alone
to the key's bucket, where hubs and other sets form a star again, so a family of any size costs its bucket an entry
a task; sets that share a crowded key are in one star or in two of which one's hub is in the other. The keys of
one family have few hubs between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from .common import Words, blob, buckets_for, drop_staged, free_name, join_small, mix, read_table, slices, stage, text_buffers, worker_cache
from .components import components
from .repeats import _bucket, _runs, _send

_U = np.uint64
MOST_BITS, LEAST_BITS = 24, 12
SLICES = 64
#: Most sets of a combination key, and of a single token, of which all pairs are formed at once.
SMALL, SMALL_SINGLE = 48, 256
GATHERED = 600_000
#: Pairs that a task forms before it adds up equal ones.
PAIRS_AT_ONCE = 400_000
#: Most pairs of one hub that are verified in one block.
HUB_PAIRS = 500
MASK = (1 << 64) - 1
SALT_PART, SALT_SHORT = _U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB)


class Rule:
    """Similarity ``percent`` (in hundredths) and what follows from it."""

    def __init__(self, percent: int = 85, words: int = 4):
        self.percent, self.words = percent, words
        bounds = [1]
        while bounds[-1] < 1 << 40:
            bounds.append(bounds[-1] * 100 // percent + 1)
        self.bounds = np.array(bounds, dtype=np.int64)

    def overlap(self, n):
        """Least number of tokens that a set of n shares with any similar set."""
        return (self.percent * n + 99) // 100

    def extra(self, n):
        """l: how many shared tokens the extended prefix holds."""
        return 1 + n * 4 // 100

    def prefix(self, n):
        return np.minimum(n, n - self.overlap(n) + self.extra(n))

    def similar(self, both, n, m):
        return 100 * both >= self.percent * (n + m - both)

    def parts(self, tag: int) -> tuple[int, int]:
        """(parts, slack) for sets of size classes ``tag`` and ``tag + 1``: more parts agree than slack."""
        largest = int(self.bounds[tag + 2]) - 1
        differ = (2 * largest * (100 - self.percent)) // (100 + self.percent)
        slack = 2 + differ // 16
        return differ + slack, slack


class Sets:
    """Token sets of consecutive texts: sorted distinct tokens, one text after another."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, k: int):
        words = Words(data, offsets, lower=True)
        h = words.hashes()
        grams, whole = words.grams(k, 0, h), words.whole(k)
        token, doc = grams[whole], words.doc[: len(grams)][whole]
        short = np.flatnonzero((words.counts > 0) & (words.counts < k))
        if len(short):
            parts = [h[words.first[d] : words.first[d + 1]] for d in short]
            own = np.array([self._sequence(x) for x in parts], dtype=_U)
            token, doc = np.concatenate([token, own]), np.concatenate([doc, short])
        order = np.lexsort((token, doc))
        token, doc = token[order], doc[order]
        keep = np.ones(len(token), bool)
        keep[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
        self.token, self.doc = token[keep], doc[keep]
        self.size = np.bincount(self.doc, minlength=len(offsets) - 1)
        self.first = np.concatenate([[0], np.cumsum(self.size)])

    @staticmethod
    def _sequence(hashes: np.ndarray) -> int:
        out = int(SALT_SHORT)
        for x in hashes.tolist():
            out = int(mix(np.array([(out * 3 + x) & MASK], dtype=_U))[0])
        return out

    def identity(self) -> np.ndarray:
        """A 64-bit name of each token set, whatever the order; 0 for an empty one."""
        sums = []
        for salt in (SALT_PART, SALT_SHORT):
            total = np.concatenate([[_U(0)], np.cumsum(mix(self.token ^ salt), dtype=_U)])
            sums.append(total[self.first[1:]] - total[self.first[:-1]])
        name = mix(sums[0] + mix(sums[1] + self.size.astype(_U)))
        return np.where(self.size > 0, name, _U(0)).view(np.int64)


# ------------------------------------------------------------------ token classes

_SETS = "kind int, doc long, id long, n int, slice int, counts binary"


def _emit_sets(k: int, bits: int):
    names = ["kind", "doc", "id", "n", "slice", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("near_duplicates")
        counts = np.zeros(1 << bits, np.int32)
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            ids, sizes = [], []
            for a, b in slices(offsets):
                sets = Sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                np.add.at(counts, (sets.token >> _U(64 - bits)).astype(np.int64), 1)
                ids.append(sets.identity())
                sizes.append(sets.size)
            if ids:
                n = batch.num_rows
                nothing = pa.nulls(n, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column("doc"), pa.array(np.concatenate(ids)), pa.array(np.concatenate(sizes).astype(np.int32)), nothing, pa.nulls(n, pa.binary())], names=names)
        used = [(i, x) for i, x in enumerate(np.split(counts, SLICES)) if x.any()]
        if used:
            n = len(used)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array([i for i, _ in used], pa.int32()), pa.array([blob(x) for _, x in used], pa.binary())], names=names)

    return run


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of the counts that a task reads, slice by slice."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(x.as_py(), np.int32)
            total[s] = total[s] + own if s in total else own.astype(np.int64)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([blob(np.minimum(x, 2**31 - 1).astype(np.int32)) for x in total.values()], pa.binary())], names=["slice", "counts"])


def _frequent(table: DataFrame, bits: int, spark: SparkSession) -> bytes:
    """Packed bits of the frequent classes: a table of fixed size, at most 2 MB."""
    slim = table.where("kind = 1").select("slice", "counts").repartition(SLICES, "slice").mapInArrow(_add_counts, "slice int, counts binary")
    counts = np.zeros(1 << bits, np.int64)
    width = (1 << bits) // SLICES
    for row in slim.toLocalIterator():
        counts[row["slice"] * width : (row["slice"] + 1) * width] += np.frombuffer(row["counts"], np.int32)
    mean = counts.mean()
    return np.packbits(counts > mean + 5 * np.sqrt(mean + 1) + 16).tobytes()


# ------------------------------------------------------------------ keys

#: ``kind`` 0: entries of keys, packed (sizes: n * 4, plus 2 if the set is a hub here, plus 1 if its prefix reaches
#: frequent classes; negative for combination keys). 1: pairs, packed (keys: a, ids: b, sizes: shared, need, star).
_KEYS = "bucket int, kind int, keys binary, ids binary, sizes binary"
#: Bits of ``star``, which is 0 for a pair of a small key: ``b`` is in a star around ``a``; their sizes allow a link;
#: ``b`` is itself the hub of a star for the same key.
IN_STAR, FITS, IS_HUB = 1, 2, 4
NEVER = 1 << 30


def _combined(parts: list[tuple]) -> tuple:
    """One row per pair (a, b, shared, need, star): shared keys summed, the least need, all bits."""
    a, b, shared, need, star = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((b, a))
    a, b, shared, need, star = a[order], b[order], shared[order], need[order], star[order]
    start = _runs(a, b)[:-1]
    if not len(start):
        return a, b, shared, need, star
    return a[start], b[start], np.add.reduceat(shared, start), np.minimum.reduceat(need, start), np.bitwise_or.reduceat(star, start)


def _star(rule: Rule, ident: np.ndarray, meta: np.ndarray, hub: np.ndarray, member: np.ndarray) -> tuple:
    """Pairs of hubs and members (places in ``ident``) of crowded keys.

    All members are told, whatever their size: two of them may link with each other.
    """
    combo = meta[hub] < 0
    n, m = np.abs(meta[hub]) // 4, np.abs(meta[member]) // 4
    fits = 100 * np.minimum(n, m) >= rule.percent * np.maximum(n, m)
    need = np.where(fits, np.where(combo, 0, np.minimum(rule.extra(n), rule.extra(m))), NEVER)
    star = IN_STAR + FITS * fits + IS_HUB * (np.abs(meta[member]) // 2 % 2)
    return ident[hub], ident[member], np.ones(len(hub), np.int32), need.astype(np.int32), star.astype(np.int32)


def _crowded(size: np.ndarray, meta: np.ndarray) -> np.ndarray:
    """Whether keys of so many sets are crowded, by one of their entries."""
    return size > np.where(meta < 0, SMALL, SMALL_SINGLE)


def _part_keys(token: np.ndarray, n: int, rule: Rule) -> np.ndarray:
    """Keys of the token combinations of one set, under its own size class and the one below."""
    own = int(np.searchsorted(rule.bounds, n, side="right")) - 1
    out = []
    for tag in {own, max(0, own - 1)}:
        m, slack = rule.parts(tag)
        part = (mix(token ^ SALT_PART) % _U(m)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        part, value = part[order], mix(token[order] ^ SALT_SHORT)
        edge = _runs(part)
        total = np.concatenate([[_U(0)], np.cumsum(value, dtype=_U)])
        content = total[edge[1:]] - total[edge[:-1]]
        where = part[edge[:-1]]
        if m - len(where) >= slack:
            empty = np.setdiff1d(np.arange(m), where)
            where, content = np.concatenate([where, empty]), np.concatenate([content, np.zeros(len(empty), _U)])
        out.append(mix(content + mix(where.astype(_U) + _U(((tag + 1) * int(SALT_PART)) & MASK))))
    return np.concatenate(out)


def _emit_keys(rule: Rule, bits: int, packed, n_buckets: int):
    def flush(parts: list[tuple], salt: int) -> pa.RecordBatch:
        key, ident, meta = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ident, key))
        key, ident, meta = key[order], ident[order], meta[order].astype(np.int64)
        keep = np.ones(len(key), bool)
        keep[1:] = (key[1:] != key[:-1]) | (ident[1:] != ident[:-1])
        key, ident, meta = key[keep], ident[keep], meta[keep]
        # of a key that is crowded here already only the hub goes on, and its star is told
        edge = _runs(key)
        head, size = edge[:-1], np.diff(edge)
        crowd = _crowded(size, meta[head])
        member = np.repeat(crowd, size)
        hub = np.repeat(head, size)
        member[head] = False
        found = _combined([_star(rule, ident, meta, hub[member], np.flatnonzero(member))])
        meta[head[crowd]] += 2 * np.sign(meta[head[crowd]])
        key, ident, meta = key[~member], ident[~member], meta[~member].astype(np.int32)
        rows = [(b, 0, *x) for b, x in _send(_bucket(key, n_buckets), n_buckets, [key, ident, meta])]
        if len(found[0]):
            rows.append((salt % n_buckets, 1, blob(found[0]), blob(found[1]), blob(np.concatenate(found[2:]).astype(np.int32))))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "kind", "keys", "ids", "sizes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("near_duplicates")
        frequent = np.unpackbits(np.frombuffer(packed.value, np.uint8)).astype(bool)
        parts, gathered = [], 0
        salt = TaskContext.get().partitionId() * 7919
        done: set[int] = set()  # sets this task has indexed since it last sent
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for a, b in slices(offsets):
                sets = Sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], rule.words)
                ident = sets.identity()
                often = frequent[(sets.token >> _U(64 - bits)).astype(np.int64)]
                order = np.lexsort((sets.token, often, sets.doc))
                token, often, doc = sets.token[order], often[order], sets.doc[order]
                n = sets.size.astype(np.int64)
                prefix = rule.prefix(n)
                at = np.arange(len(token)) - sets.first[doc]
                inside = at < prefix[doc]
                mixed = np.bincount(doc[inside & often], minlength=len(n)) > 0
                meta = (n * 4 + mixed).astype(np.int32)
                fresh = np.zeros(len(n), bool)
                for d in np.flatnonzero(n > 0):
                    if (i := int(ident[d])) not in done:
                        done.add(i)
                        fresh[d] = True
                take = inside & ~often & fresh[doc]
                parts.append((token[take], ident[doc[take]], meta[doc[take]]))
                gathered += int(take.sum())
                for d in np.flatnonzero(mixed & fresh):
                    keys = _part_keys(sets.token[sets.first[d] : sets.first[d + 1]], int(n[d]), rule)
                    # combination keys carry a negative size
                    parts.append((keys, np.full(len(keys), ident[d]), np.full(len(keys), -meta[d], np.int32)))
                    gathered += len(keys)
                if gathered > GATHERED:
                    yield flush(parts, salt)
                    parts, gathered, done, salt = [], 0, set(), salt + 1
        if gathered:
            yield flush(parts, salt)

    return run


_PAIRS = "a long, b long, shared int, need int, star int"


def _pairs(rule: Rule):
    """Candidate pairs of a bucket: rows (a, b, shared, need, star); of a star ``a`` is the hub."""

    def run(table: pa.Table) -> pa.Table:
        kinds = table["kind"].to_numpy()
        entries, told = table.filter(pc.equal(table["kind"], 0)), table.filter(pc.equal(table["kind"], 1))
        rows, waiting, gathered = [], [], 0
        for a, b, rest in zip(*(told[c].to_pylist() for c in ("keys", "ids", "sizes")), strict=True):
            rows.append((np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), *np.frombuffer(rest, np.int32).reshape(3, -1)))
        if (kinds == 0).any():
            key, ident, meta = (np.concatenate([np.frombuffer(x, k) for x in entries[c].to_pylist()]) for c, k in (("keys", _U), ("ids", np.int64), ("sizes", np.int32)))
            # of a set that several tasks have sent for a key the entry that says it is a hub is kept
            order = np.lexsort((-np.abs(meta), ident, key))
            key, ident, meta = key[order], ident[order], meta[order].astype(np.int64)
            keep = np.ones(len(key), bool)
            keep[1:] = (key[1:] != key[:-1]) | (ident[1:] != ident[:-1])
            key, ident, meta = key[keep], ident[keep], meta[keep]
            edge = _runs(key)
            head, size = edge[:-1], np.diff(edge)
            hubs = np.add.reduceat(np.abs(meta) // 2 % 2, head)
            crowd = _crowded(size, meta[head]) | (hubs > 0)

            def blocks() -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
                """Places (i, j) of pairs, some hundred thousand at a time, and whether they are a star's."""
                for g in np.unique(size[~crowd]):
                    if g < 2:
                        continue
                    start = head[(size == g) & ~crowd]
                    i, j = np.triu_indices(g, 1)
                    step = max(1, PAIRS_AT_ONCE // len(i))
                    for at in range(0, len(start), step):
                        own = start[at : at + step, None]
                        yield (own + i[None, :]).ravel(), (own + j[None, :]).ravel(), False
                for a, b in zip(head[crowd], edge[1:][crowd], strict=True):
                    yield np.full(b - a - 1, a), np.arange(a + 1, b), True

            for i, j, star in blocks():
                if star:
                    found = _star(rule, ident, meta, i, j)
                else:
                    combo = meta[i] < 0
                    n, m = np.abs(meta[i]) // 4, np.abs(meta[j]) // 4
                    both_mixed = (np.abs(meta[i]) % 2 == 1) & (np.abs(meta[j]) % 2 == 1)
                    good = (100 * np.minimum(n, m) >= rule.percent * np.maximum(n, m)) & (combo | ~both_mixed)
                    need = np.where(combo, 0, np.minimum(rule.extra(n), rule.extra(m)))[good].astype(np.int32)
                    found = (ident[i[good]], ident[j[good]], np.ones(len(need), np.int32), need, np.zeros(len(need), np.int32))
                if not len(found[0]):
                    continue
                waiting.append(found)
                gathered += len(found[0])
                if gathered > PAIRS_AT_ONCE:
                    rows.append(_combined(waiting))
                    waiting, gathered = [], 0
        rows += [_combined(waiting)] if waiting else []
        rows = rows or [(np.zeros(0, np.int64), np.zeros(0, np.int64), *[np.zeros(0, np.int32)] * 3)]
        a, b, shared, need, star = _combined(rows) if len(rows) > 1 else rows[0]
        return pa.table({"a": a, "b": b, "shared": shared.astype(np.int32), "need": need.astype(np.int32), "star": star.astype(np.int32)})

    return run


# ------------------------------------------------------------------ verification


def _emit_token_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for a, b in slices(offsets):
                sets = Sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
                yield pa.RecordBatch.from_arrays([pa.array(sets.identity()), pa.array([blob(sets.token[sets.first[d] : sets.first[d + 1]]) for d in range(b - a)], pa.binary())], names=["id", "tokens"])

    return run


def _per_pair(function, schema: pa.Schema):
    """Apply ``function(a, b, tokens of a, tokens of b)`` to the pairs of one block, which holds each needed set once."""

    def run(table: pa.Table) -> pa.Table:
        other = pc.fill_null(table["b"], 0).to_numpy()
        is_set = pc.is_valid(table["tokens"]).to_numpy(zero_copy_only=False)
        ids = table["a"].to_numpy()
        packed = table["tokens"]
        sets = {int(ids[i]): np.frombuffer(packed[int(i)].as_py(), _U) for i in np.flatnonzero(is_set)}
        out = []
        for i in np.flatnonzero(~is_set):
            a, b = int(ids[i]), int(other[i])
            if (got := function(a, b, sets[a], sets[b])) is not None:
                out.append(got)
        columns = list(zip(*out, strict=True)) if out else [[] for _ in schema]
        return pa.table([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    return run


def _link(rule: Rule):
    def decide(a: int, b: int, x: np.ndarray, y: np.ndarray):
        both = int(np.isin(x, y, assume_unique=True).sum())
        return (a, b) if rule.similar(both, len(x), len(y)) else None

    return _per_pair(decide, pa.schema([("u", pa.int64()), ("v", pa.int64())]))


def _difference(a: int, b: int, x: np.ndarray, y: np.ndarray):
    return a, b, len(x), np.setxor1d(x, y, assume_unique=True).view(np.int64).tolist()


def _with_sets(pairs: DataFrame, docs: DataFrame, names: DataFrame, rule: Rule, function, schema: str, name: str) -> DataFrame:
    """``function`` over ``pairs`` (a, b) with their token sets.

    Pairs are blocked by the smallest set that their first member pairs with, so a clique of candidates is
    one block and each of its token sets is sent once; hubs of more than ``HUB_PAIRS`` pairs are salted.
    Token sets are made from the texts again and go straight to the blocks that need them.
    """
    both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("hub"))
    hubs = pairs.join(least, "a")
    salts = hubs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / HUB_PAIRS).alias("salts"))
    placed = stage(hubs.join(salts, "hub").select(F.xxhash64("hub", F.pmod(F.xxhash64("b"), F.col("salts"))).alias("block"), "a", "b"), "near-blocks")
    needs = placed.select("block", F.col("a").alias("id")).union(placed.select("block", F.col("b").alias("id"))).distinct()
    needs = stage(needs, "near-needs")
    wanted = needs.select("id").distinct()
    wanted = stage(wanted, "near-wanted")
    rows = stage(join_small(names, wanted, "id", "left_semi").groupBy("id").agg(F.min("doc").alias("doc")).select("doc").distinct(), "near-rows")
    some = join_small(docs.withColumnRenamed("doc", "d"), rows, F.col("d").eqNullSafe(F.col("doc")), "left_semi")
    sets = some.select("text").mapInArrow(_emit_token_sets(rule.words), "id long, tokens binary")
    given = join_small(sets, needs, "id", "inner").select("block", F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "tokens")
    work = placed.withColumn("tokens", F.lit(None).cast("binary")).unionByName(given)
    # many blocks share a group, as a group costs a call
    n = max(64, min(1 << 20, needs.count() // 200))
    out = stage(work.withColumn("group", F.pmod("block", F.lit(n))).drop("block").groupBy("group").applyInArrow(function, schema), name)
    drop_staged(placed, needs, wanted, rows)
    return out


def _links(pairs: DataFrame, docs: DataFrame, names: DataFrame, rule: Rule) -> DataFrame:
    """The verified among ``pairs`` (a, b), as (u, v)."""
    return _with_sets(pairs, docs, names, rule, _link(rule), "u long, v long", "near-links")


def _across(told: DataFrame, above: DataFrame, docs: DataFrame, names: DataFrame, rule: Rule) -> tuple[DataFrame, list[DataFrame]]:
    """Candidate pairs (a, b) of different components among the members of crowded keys, and the staged tables they come from.

    ``told`` has many (the hub of a star), node (a member, the hub included) and label (its component so far);
    ``above`` has many and above: a star whose hub stands for it in another star of the same key. A star goes over to
    the hub of most members that its own hub meets, as a rule the text that a family of near copies was made from,
    and with it the stars that it is above of; members are described by how their token set differs from that hub's.
    The size of the difference of two sets is at most (100 - p) (n + m) / (100 + p) if they link, and it is also
    the difference of their two differences; so with x not linked to the hub (those pairs are tried as well),
    x and y can only link if their differences share at least ``o = (|dx| + |dy| - most) / 2 >= 1`` tokens,
    and then some token is within the first ``|d| - o + 1`` of both, rarest first. Members that were changed
    in different ways never meet.
    """
    own = F.max(F.when(F.col("node") == F.col("many"), F.col("label")))
    hubs = told.groupBy("many").agg(F.count(F.lit(1)).alias("deg"), own.alias("label")).select("many", F.struct("deg", F.col("many").alias("node"), "label").alias("h"))
    used = []
    for _ in range(2):
        # a star goes over to the best hub that its own hub meets, so a family has few hubs
        best = told.select("many", "node").join(hubs, "many").groupBy("node").agg(F.max("h").alias("best"))
        hubs = stage(hubs.join(best, F.col("h.node") == F.col("node")).select("many", F.col("best").alias("h")), "near-hubs")
        used.append(hubs)
    hubs = hubs.select("many", F.col("h.node").alias("hub"), F.col("h.label").alias("hub_label"))
    # a star has its own hub and those of the stars above it, which as a rule are one
    hubs = hubs.union(above.join(hubs.withColumnRenamed("many", "above"), "above").select("many", "hub", "hub_label")).distinct()
    groups = stage(told.join(hubs, "many").select("node", "label", "hub", "hub_label").distinct(), "near-groups")
    split = groups.groupBy("hub").agg(F.bool_or(F.col("label") != F.col("hub_label")).alias("split")).where("split").select("hub")
    members = stage(groups.where("node != hub").join(split, "hub", "left_semi").select("node", "label", "hub", "hub_label"), "near-members")
    used.append(groups)
    differ = _with_sets(members.select(F.col("node").alias("a"), F.col("hub").alias("b")), docs, names, rule, _per_pair(_difference, pa.schema([("node", pa.int64()), ("hub", pa.int64()), ("n", pa.int32()), ("tokens", pa.list_(pa.int64()))])), "node long, hub long, n int, tokens array<long>", "near-differences")
    each = differ.join(members, ["node", "hub"]).select("node", "hub", "label", "hub_label", "n", F.size("tokens").alias("d"), F.explode("tokens").alias("token"))
    often = each.groupBy("hub", "token").agg(F.count(F.lit(1)).alias("df"))
    place = F.row_number().over(Window.partitionBy("hub", "node").orderBy("df", "token")) - 1
    each = each.join(often.where("df > 1"), ["hub", "token"], "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("at", place).where("df > 1")
    each = stage(each, "near-changes")
    used += [members, differ, each]
    f = (100 - rule.percent) / (100 + rule.percent)
    # |d| - o < |d| (1 + f) / 2 + 1 for any partner of a set outside the hub's component
    y = each.where(F.col("at") <= F.col("d") * (1 + f) / 2 + 2).select("hub", "token", F.col("node").alias("y"), F.col("label").alias("ly"), F.col("n").alias("ny"), F.col("d").alias("dy"), F.col("at").alias("py"))
    x = each.where("label != hub_label").select("hub", "token", F.col("node").alias("x"), F.col("label").alias("lx"), F.col("n").alias("nx"), F.col("d").alias("dx"), F.col("at").alias("px"))
    most = F.floor((100 - rule.percent) * (F.col("nx") + F.col("ny")) / (100 + rule.percent))
    o = F.greatest(F.lit(1), F.ceil((F.col("dx") + F.col("dy") - most) / 2))
    near = (F.col("lx") != F.col("ly")) & (F.col("px") <= F.col("dx") - o) & (F.col("py") <= F.col("dy") - o)
    met = x.withColumnsRenamed({"hub": "hx", "token": "tx"}).join(y, (F.col("hx") == F.col("hub")) & (F.col("tx") == F.col("token")) & near)
    hubs = members.where("label != hub_label").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).union(hubs).distinct(), used


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, set_id, label) of every row; rows of one component have one label.

    Two rows link when the Jaccard similarity of their sets of ``words``-word shingles is at least
    ``percent`` hundredths. ``component_id`` is the smallest key that links reach; without words a row
    links with nothing (component: its own key). A text of fewer words is one shingle. Rows with a null
    key take part; their component is the smallest other key, or null. Texts are read whole; repeated
    rows get equal rows; other columns are ignored.
    """
    spark, rule = docs.sparkSession, Rule(percent, words)
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    buckets = buckets_for(docs)
    bits = int(np.clip(np.ceil(np.log2(buckets * (1 << 16))), LEAST_BITS, MOST_BITS))
    table = stage(rows.mapInArrow(_emit_sets(words, bits), _SETS), "near-names")
    names = table.where("kind = 0").select("doc", "id", "n")
    packed = spark.sparkContext.broadcast(_frequent(table, bits, spark))
    keyed = rows.select("text").mapInArrow(_emit_keys(rule, bits, packed, buckets), _KEYS)
    found = keyed.groupBy("bucket").applyInArrow(_pairs(rule), _PAIRS)
    counted = found.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("need").alias("need"), F.bit_or("star").alias("star"))
    pairs = stage(counted.where("shared >= need OR star > 0").select("a", "b", "star", "need"), "near-candidates")
    tried = pairs.where(F.col("need") < NEVER).select("a", "b")
    links = _links(tried, rows, names, rule)
    stars = pairs.where("star > 0").select(F.col("a").alias("many"), F.col("b").alias("node"), "star")
    if stars.limit(1).count():
        grouped = components(links)
        members = stars.select("many", "node").union(stars.select("many", F.col("many").alias("node")).distinct())
        # a hub that was sent for its key stands for its own star there: sets of both stars may share the key
        above = stage(stars.where(F.col("star").bitwiseAND(IS_HUB) > 0).select(F.col("node").alias("many"), F.col("many").alias("above")).distinct(), "near-above")
        told = members.join(grouped, "node", "left").select("many", "node", F.coalesce("label", "node").alias("label"))
        told = stage(told, "near-crowds")
        drop_staged(grouped)
        cross, used = _across(told, above, rows, names, rule)
        cross = stage(cross.join(tried, ["a", "b"], "left_anti"), "near-cross")
        if cross.limit(1).count():
            links = links.unionByName(_links(cross, rows, names, rule))
        drop_staged(told, above, cross, *used)
    labels = components(links)
    drop_staged(pairs, links)
    named = names.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    least = stage(named.groupBy("label").agg(F.min("doc").alias("least")), "near-least")
    out = named.join(least, "label")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc")).otherwise(F.col("least")).alias("component_id"), F.col("id").alias("set_id"), "label")


def _named_sets(docs: DataFrame, words: int, text: str, name: str) -> DataFrame:
    """``docs`` with the name of every row's shingle set as column ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.columns[-1])
            ids = [Sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words).identity() for a, b in slices(offsets)]
            if ids:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.concatenate(ids))], names=batch.schema.names)

    schema = StructType([*docs.schema.fields, StructField(name, LongType())])
    return docs.withColumn(name, F.coalesce(F.col(text), F.lit(""))).mapInArrow(run, schema)


def keep_one(docs: DataFrame, percent: int = 80, words: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component: that with the smallest key.

    Rows that share a key are judged one by one: those of the same component are reduced to one, those without
    words too; others stay or go with their own component. Rows with a null key all stay. Columns may have any names.
    """
    found = near_duplicates(docs, percent, words, text, key).select(F.col("doc_id").alias("key"), "component_id", "set_id", "label")
    found = stage(found, "near-found")
    name, ident, label, own_set = (free_name(n, docs) for n in ("_key", "_id", "_label", "_set"))
    same = F.col(key) == F.col(name)
    gone = found.where("key != component_id").select(F.col("key").alias(name))
    again = found.where("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    again = stage(again.select(F.col("key").alias(name)), "near-again")
    if not again.limit(1).count():
        return join_small(docs, gone, same, "left_anti")
    kept = join_small(docs, gone.union(again).distinct(), same, "left_anti")
    stays = join_small(found.where("key = component_id").withColumnRenamed("key", name), again, name, "left_semi")
    stays = stage(stays.select(name, F.col("set_id").alias(ident), F.col("label").alias(label)).distinct(), "near-stays")
    own = _named_sets(join_small(docs, again, same, "left_semi"), words, text, own_set)
    own = join_small(own, stays, same & (F.col(own_set) == F.col(ident)), "inner").dropDuplicates([name, label])
    return kept.unionByName(own.select(*docs.columns))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets are 85 % alike."""
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
