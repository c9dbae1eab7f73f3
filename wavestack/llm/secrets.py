"""Secret scans with corpus-wide ownership frequency (DataFrame functions only).

Three base kinds are matched by pattern; a fourth, ``opaque``, proposes long mixed-case tokens with
digits. For every candidate value the corpus is asked how many distinct repositories and owners hold
it (distinct pairs are formed with map-side combining before any shuffle, so a value in a third of all
rows costs one row per task and owner). A value that more than ``max_owners`` owners hold is a widely
copied example, and so is one in more than ``max_repositories`` of them; any other looks live. Base spans are always reported; an ``opaque`` span is reported
only if its value looks live. Only spans and value digests are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_staged, free_name, join_small, read_table, stage

# Fixed values: (kind, pattern, group that holds the value, least length of the value), in report order.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("opaque", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}", 0, 20),
)
MAX_OWNERS, MAX_REPOSITORIES = 2, 3
MASK = "[SECRET]"
SPAN = "struct<kind:int,start:int,end:int,digest:string>"


def _spans(text: Column, kind: int) -> Column:
    """array<struct<kind, start, end, digest>> of one kind, in code points; the text is matched piecewise.

    Matches and the pieces between them alternate, so running sums of their lengths are the positions.
    """
    name, pattern, group, least = KINDS[kind]
    at, whole, value = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pairs = F.arrays_zip(at.alias("gap"), whole.alias("hit"), value.alias("value"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        good = F.length(x["value"]) >= least
        if name == "opaque":
            good = good & x["value"].rlike("[0-9]") & x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]")
        found = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), F.sha2(x["value"].cast("binary"), 256).alias("digest"))
        return F.struct(end.alias("pos"), F.when(x["hit"].isNotNull() & good, F.concat(acc["out"], F.array(found))).otherwise(acc["out"]).alias("out"))

    empty = F.array().cast(f"array<{SPAN}>")
    return F.when(text.rlike(pattern), F.aggregate(pairs, F.struct(F.lit(0).alias("pos"), empty.alias("out")), step, lambda acc: acc["out"])).otherwise(empty)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, plus ``found``: all spans by start, then kind. Null text has none."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = F.concat(*[_spans(body, k) for k in range(len(KINDS))])
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"])
    return docs.withColumn("found", F.array_sort(found, order)).drop(text)


def ownership(found: DataFrame) -> DataFrame:
    """(digest, n_repositories, n_owners) over rows (digest, repository, owner); nulls count as one name."""
    pairs = found.select("digest", F.coalesce("repository", F.lit("")).alias("repository"), F.coalesce("owner", F.lit("")).alias("owner")).distinct()
    owners = pairs.select("digest", "owner").distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("n_owners"))
    return pairs.groupBy("digest").agg(F.count(F.lit(1)).alias("n_repositories")).join(owners, "digest")


def scan_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id", owner: str = "source", repository: str = "lang", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, digest, live>>) for every row of ``docs``.

    ``owner`` and ``repository`` within it say whose text a row is. Null or empty text has no span;
    repeated rows get equal rows; the text is matched whole whatever its length; other columns, clashing
    names included, are ignored.
    """
    slim = docs.select(F.col(key).alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.concat_ws("/", F.col(owner).cast("string"), F.col(repository).cast("string")).alias("repository"), F.col(text).alias("text"))
    rows = stage(candidates(slim), "secret-candidates")
    some = rows.where(F.size("found") > 0)
    each = some.select("doc_id", "found", "owner", "repository", F.explode("found").alias("x")).withColumn("digest", F.col("x.digest"))
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)
    known = stage(ownership(each).select("digest", live.alias("live")), "secret-owners")
    judged = join_small(each, known, "digest", "left").select("doc_id", "found", F.struct("x.kind", "x.start", "x.end", "x.digest", "live").alias("y"))
    judged = judged.where((F.col("y.kind") < 3) | F.col("y.live")).dropDuplicates()
    back = judged.groupBy("doc_id", "found").agg(F.collect_list("y").alias("spans"))
    order = lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"])
    back = back.select("doc_id", "found", F.array_sort("spans", order).alias("spans"))
    # rows with equal key and equal candidates have equal spans, so this join adds no rows
    joined = rows.select("doc_id", "found").where(F.size("found") > 0).join(back.withColumnsRenamed({"doc_id": "k", "found": "f"}), F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("found") == F.col("f")), "left")
    none = F.array().cast("array<struct<kind:int,start:int,end:int,digest:string,live:boolean>>")
    return joined.select("doc_id", F.coalesce("spans", none).alias("spans")).unionByName(rows.where(F.size("found") == 0).select("doc_id", none.alias("spans")))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, text: str = "text", key: str = "doc_id", owner: str = "source", repository: str = "lang", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """``docs`` with every live-looking span replaced by a mask; examples and all other text stay.

    Overlapping spans become one. Rows are known by a 128-bit digest of their text, so a key that is null or repeated
    does no harm; null and empty texts stay. Columns may have any names.
    """
    tag, live = free_name("_tag", docs), free_name("_live", docs)
    digest = F.md5(F.col(text).cast("binary"))
    tagged = docs.select(digest.alias("tag"), F.col(text).alias("text"), F.col(owner).alias("owner"), F.col(repository).alias("repository"))
    spans = scan_secrets(tagged, "text", "tag", "owner", "repository", max_owners, max_repositories).select(F.col("doc_id").alias(tag), F.filter("spans", lambda x: x["live"]).alias(live)).where(F.size(live) > 0)
    spans = stage(spans.groupBy(tag).agg(F.first(live).alias(live)), "secret-live")

    def merge(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        one = F.struct(x["start"].alias("s"), x["end"].alias("e"))
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], x["end"]).alias("e"))))
        return F.when(F.size(acc) == 0, F.array(one)).when(last["e"] >= x["start"], longer).otherwise(F.concat(acc, F.array(one)))

    def cut(acc: Column, x: Column) -> Column:
        return F.struct(F.concat(acc["out"], F.substring(F.col(text), acc["pos"] + 1, x["s"] - acc["pos"]), F.lit(MASK)).alias("out"), x["e"].alias("pos"))

    merged = F.aggregate(live, F.array().cast("array<struct<s:int,e:int>>"), merge)
    clean = F.aggregate(merged, F.struct(F.lit("").alias("out"), F.lit(0).alias("pos")), cut, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["pos"] + 1, F.length(text))))
    out = join_small(docs.withColumn(tag, digest), spans, tag, "left")
    return out.withColumn(text, F.when(F.col(live).isNotNull(), clean).otherwise(F.col(text))).select(*docs.columns)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; ``spans`` also holds live-looking opaque tokens."""
    out = scan_secrets(read_table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] < 3)
    return out.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"),
    )


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repository, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT rid, 0 AS kind, string_split_regex(t, p) AS gap, regexp_extract_all(t, p, 0) AS hit, regexp_extract_all(t, p, 2) AS val, 8 AS least
  FROM d, (SELECT '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)' AS p)
  UNION ALL SELECT rid, 1, string_split_regex(t, p), regexp_extract_all(t, p, 0), regexp_extract_all(t, p, 0), 16 FROM d, (SELECT 'AKIA[A-Z0-9]+' AS p)
  UNION ALL SELECT rid, 2, string_split_regex(t, p), regexp_extract_all(t, p, 0), regexp_extract_all(t, p, 0), 32 FROM d, (SELECT '[0-9a-f]+' AS p)
  UNION ALL SELECT rid, 3, string_split_regex(t, p), regexp_extract_all(t, p, 0), regexp_extract_all(t, p, 0), 20 FROM d, (SELECT '[A-Za-z0-9_-]+' AS p)
),
p AS (SELECT rid, kind, least, hit, val, gap, unnest(range(1, len(hit) + 1)) AS i FROM m WHERE len(hit) > 0),
q AS (SELECT rid, kind, hit[i] AS h, val[i] AS v,
        coalesce(list_sum(list_transform(gap[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hit[1:i-1], lambda x: length(x))), 0) AS s
      FROM p WHERE length(val[i]) >= least),
c AS (SELECT q.rid, kind, CAST(s AS BIGINT) AS s, CAST(s + length(h) AS BIGINT) AS e, v, owner, repository FROM q JOIN d ON d.rid = q.rid
      WHERE kind < 3 OR (regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]'))),
o AS (SELECT v, count(DISTINCT owner) <= 2 AND count(DISTINCT repository) <= 3 AS live FROM c GROUP BY v),
f AS (SELECT c.rid, kind, s, e, live, (['assign','access','hex','opaque'])[kind + 1] || ':' || s || ':' || e AS w FROM c JOIN o ON c.v = o.v WHERE kind < 3 OR live),
g AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
        sha256(coalesce(string_agg(w, ',' ORDER BY s, kind) FILTER (kind < 3), '')) AS base_sha256, string_agg(w, ',' ORDER BY s, kind) AS spans, count(*) FILTER (live) AS n_live
      FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  coalesce(base_sha256, sha256('')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN g ON d.rid = g.rid
"""
