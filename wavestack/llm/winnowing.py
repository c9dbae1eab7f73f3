"""Benchmark decontamination by winnowing (DataFrame functions only).

Of every ``w`` consecutive hashes of ``k`` words the smallest is kept as a fingerprint, on both sides.
With ``k + w - 1 == span``, any ``span`` words that two texts share hold a fingerprint that both kept at
the same place, so a join on fingerprints finds every shared window; each hit gives a diagonal (document
position less item position), along which words are compared exactly and the hit extended to all
windows that agree. Items of fewer than ``span`` words are fingerprinted whole, and documents by the
word counts that occur among them.

Benchmark fingerprints are broadcast while they are few (bytes and rows are checked); otherwise the join shuffles
fingerprints. Texts meet their hits by a digest of the text, so copies share one set of hits. Hits carry the words of
their items; their bytes are summed before they are broadcast, and beyond ``BROADCAST_BYTES`` they are joined by shuffle
with those texts alone that have a hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, drop_staged, free_name, join_small, join_sparse, read_table, stage

SPAN, K = 10, 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words once A-Z are lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same before.
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


#: Low bits of a packed fingerprint that hold its place; the others hold its hash.
PLACE_BITS = 24


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, though lambdas inside use it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text in order; null has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), lambda x: x != "")


def _upto(n: Column) -> Column:
    """[0, n) as an array, empty for n <= 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _hash(ws: Column, at: Column, n: int) -> Column:
    return F.xxhash64(F.slice(ws, at + 1, n))


def _runs(values: Column, n: int, step) -> Column:
    """``step`` folded over every ``n`` consecutive values, by doubling: each pass joins two neighbouring runs."""
    after = lambda a, k: F.slice(a, k + 1, F.size(a))

    def grow(have: int, parts: list[tuple[int, Column]]) -> Column:
        now = parts[-1][1]
        if have == n:
            return F.slice(now, 1, F.greatest(F.size(values) - (n - 1), F.lit(0)))
        size, other = next((k, a) for k, a in reversed(parts) if k <= n - have)
        # past the end the shorter array is filled up with nulls, which the cut above takes off
        return let(F.zip_with(now, after(other, have), step), lambda a: grow(have + size, [*parts, (have + size, a)] if size == have else [*parts[:-1], (have + size, a)]))

    return grow(1, [(1, values)])


def fingerprints(ws: Column, span: int = SPAN, k: int = K) -> Column:
    """array<struct<h, p>>: the leftmost smallest k-word hash of each window of ``span`` words, once per place.

    A word is hashed once, and a place stands in the low bits below its hash, so that the smallest value of a window
    says where it is; texts of more words than the low bits can count take the places from the windows instead.
    """
    w = span - k + 1

    def pick(grams: Column) -> Column:
        packed = F.transform(grams, lambda g, i: F.shiftleft(F.shiftright(g, PLACE_BITS), PLACE_BITS).bitwiseOR(i.cast("long")))
        smallest = F.array_distinct(let(packed, lambda v: _runs(v, w, lambda x, y: F.least(x, y))))
        return F.transform(smallest, lambda v: F.struct(F.shiftright(v, PLACE_BITS).alias("h"), v.bitwiseAND((1 << PLACE_BITS) - 1).cast("int").alias("p")))

    def pick_long(grams: Column) -> Column:
        short = F.transform(grams, lambda g: F.shiftright(g, PLACE_BITS))
        minima = lambda g: F.transform(_upto(F.size(g) - (w - 1)), lambda i: let(F.slice(g, i + 1, w), lambda s: (i + F.array_position(s, F.array_min(s)) - 1).cast("int")))
        return let(short, lambda g: F.transform(F.array_distinct(minima(g)), lambda p: F.struct(F.get(g, p).alias("h"), p.alias("p"))))

    grams = let(F.transform(ws, lambda x: F.xxhash64(x)), lambda h: _runs(h, k, lambda x, y: F.xxhash64(x, y)))
    return let(grams, lambda g: F.when(F.size(g) < 1 << PLACE_BITS, pick(g)).otherwise(pick_long(g)))


def _whole(ws: Column, n: int) -> Column:
    """Every run of exactly n words."""
    return F.transform(_upto(F.size(ws) - (n - 1)), lambda i: F.struct(_hash(ws, i, n).alias("h"), i.alias("p")))


def _digest(text: Column) -> list[Column]:
    body = F.coalesce(text, F.lit(""))
    return [F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), body).alias("k2")]


def _starts(ws: Column, item: Column, span: int) -> Column:
    """Document positions at which a window of the item occurs on one of its diagonals."""
    n = F.least(F.lit(span), F.size(item["words"]))

    def along(d: Column) -> Column:
        first = F.greatest(F.lit(0), -d)
        last = F.least(F.size(item["words"]), F.size(ws) - d) - n
        js = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.transform(F.filter(js, lambda j: F.slice(ws, d + j + 1, n) == F.slice(item["words"], j + 1, n)), lambda j: d + j)

    return F.flatten(F.transform(item["ds"], along))


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", span: int = SPAN, k: int = K, most: int = BROADCAST_BYTES, names: tuple[str, str, str] = ("n_words", "n_hit", "items")) -> DataFrame:
    """``docs`` plus n_words, n_hit and items (sorted distinct item keys as strings), or what ``names`` calls them.

    Columns of ``docs`` with one of these names are replaced; all others stay, whatever their names. Repeated rows
    get equal results. Hits of more than ``most`` bytes are shuffled instead of broadcast.

    A null or empty text, or one of fewer words than any window, has no hit. Items without words are
    never hit; items with equal words are hit together; null item keys take part as the text "null".
    An empty benchmark hits nothing. Texts are taken whole.
    """
    none = F.array().cast("array<string>")
    items = benchmark.select(F.coalesce(F.col(item_key).cast("string"), F.lit("null")).alias("item"), words(F.col("text")).alias("words")).where(F.size("words") > 0)
    items = stage(items.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("ids")).withColumn("wid", F.xxhash64("words")), "winnow-items")
    short = sorted(r["n"] for r in items.select(F.size("words").alias("n")).where(F.col("n") < span).distinct().collect())
    long_ = items.where(F.size("words") >= span).select("wid", F.explode(fingerprints(F.col("words"), span, k)).alias("x")).select("wid", "x.h", F.col("x.p").alias("q"))
    brief = items.where(F.size("words") < span).select("wid", F.xxhash64("words").alias("h"), F.lit(0).alias("q"))
    kept = stage(long_.unionByName(brief), "winnow-benchmark")
    marks = let(words(F.col(text)), lambda ws: F.concat(fingerprints(ws, span, k), *[_whole(ws, n) for n in short]))
    found = docs.select(*_digest(F.col(text)), F.explode(marks).alias("x")).select("k1", "k2", "x.h", "x.p")
    hits = join_small(found, kept, "h", "inner").select("k1", "k2", "wid", (F.col("p") - F.col("q")).alias("d")).distinct()
    hits = stage(hits.groupBy("k1", "k2", "wid").agg(F.collect_list("d").alias("ds")), "winnow-hits")
    k1, k2, found, checked, weigh = (free_name(n, docs) for n in ("_k1", "_k2", "_found", "_checked", "_weight"))
    weight = F.octet_length(F.array_join("words", " ")) + 24 * F.size("words") + 8 * F.size("ds") + 64
    cand = hits.join(items.select("wid", "words", "ids"), "wid").withColumn("weight", weight)
    cand = cand.groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.collect_list(F.struct("words", "ids", "ds")).alias(found), F.sum("weight").alias(weigh))
    cand = stage(cand, "winnow-candidates")
    drop_staged(kept, hits, items)
    rows = docs.withColumns(dict(zip((k1, k2), _digest(F.col(text)), strict=True)))
    rows = join_sparse(rows, cand, [k1, k2], F.col(weigh), most)
    spans = lambda ws: F.transform(found, lambda c: F.struct(c["ids"].alias("ids"), _starts(ws, c, span).alias("starts"), F.least(F.lit(span), F.size(c["words"])).alias("n")))
    rows = rows.withColumn(checked, F.when(F.col(found).isNotNull(), let(words(F.col(text)), lambda ws: F.filter(spans(ws), lambda s: F.size(s["starts"]) > 0))))
    covered = F.size(F.array_distinct(F.flatten(F.flatten(F.transform(checked, lambda s: F.transform(s["starts"], lambda a: F.sequence(a, a + s["n"] - 1)))))))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform(checked, lambda s: s["ids"]))))
    body = F.coalesce(F.col(text), F.lit(""))
    # the pieces between separators are the words, but for an empty one at either end
    ends = [F.when(F.substring(body, at, 1).rlike(APART), 1).otherwise(0) for at in (1, -1)]
    count = F.when(body == "", 0).otherwise(F.size(F.split(body, APART)) - ends[0] - ends[1])
    hit = F.when(F.col(checked).isNull(), F.lit(0)).otherwise(covered).cast("long")
    new = dict(zip(names, (count.cast("long"), hit, F.coalesce(ids, none)), strict=True))
    taken = {n.lower() for n in new}
    return rows.select(*[c for c in docs.columns if c.lower() not in taken], *[c.alias(n) for n, c in new.items()])


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document by the benchmark."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT item_id, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
dw AS (SELECT rid, n, i, array_to_string(w[i:i+n-1], ' ') AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT rid, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM h)) GROUP BY rid),
s AS (SELECT rid, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.rid = c.rid LEFT JOIN s ON d.rid = s.rid
"""
